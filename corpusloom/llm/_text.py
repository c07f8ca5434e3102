"""What the operators of this subpackage share."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of the contracts: runs of anything but space, tab, LF, VT, FF and CR.
SPACES = " \t\n\x0b\x0c\r"
WORD_SPLIT = "[ \\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value``, which is evaluated once however often ``body`` names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    """The words of a text as array<string>; null and empty texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_SPLIT), lambda w: w != "")


def _trim() -> None:
    """Memory that this Python process no longer needs goes back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library: it gives memory back when it likes


def released(spark: SparkSession) -> None:
    """What the driver no longer needs goes back to the system, of Python, of the heap and of what the JVM has beside it.

    With the garbage of ended lineages Spark's cleaner drops their shuffle files, broadcasts and checkpoints.
    """
    _trim()
    jvm = spark._jvm
    jvm.System.gc()
    try:
        # What compilers and buffers leave in the C library: 200 MB after a run of the pipeline. JVMs before 17.0.9 can't.
        invoke = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
        args = spark.sparkContext._gateway.new_array(jvm.Object, 4)
        args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), args)
    except Py4JError:
        pass


_HELD: dict[Any, Any] = {}


def held(key: Any, make: Callable[[], Any] = lambda: None) -> Any:
    """``make()``, kept in this Python worker from task to task until one with another key begins.

    Workers outlive their tasks and serve all operators; what one of them builds must not stay in memory while the next works.
    """
    if key not in _HELD:
        if any(v is not None for v in _HELD.values()):
            _HELD.clear()
            _trim()
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in slices of ``rows`` rows, and of about ``most_bytes`` where rows are large, so that few are Python objects at once."""
    for b in batches:
        step = max(1, min(rows, int(b.num_rows * most_bytes / max(1, b.nbytes))))
        for at in range(0, b.num_rows, step):
            yield b.slice(at, step)


class RecentTable(dict):
    """What ``make`` gives for keys (str or bytes), kept up to about ``most_bytes``.

    There are two generations. When the newer has half the bound, :meth:`turn` lets the older go; keys that are met again
    move on from it. Keys longer than ``longest`` are not kept.
    """

    def __init__(self, make: Callable[[Any], bytes], most_bytes: int, longest: int = 64):
        super().__init__()
        self.make, self.most_bytes, self.longest = make, most_bytes, longest
        self.old: dict[Any, bytes] = {}
        self.bytes = 0

    def __missing__(self, key: Any) -> bytes:
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= self.longest:
            # Two objects and a place in the table.
            self.bytes += 150 + len(key) + len(value)
            self[key] = value
        return value

    def turn(self) -> RecentTable:
        if self.bytes > self.most_bytes // 2:
            self.old, self.bytes = dict(self), 0
            self.clear()
        return self


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of ``df`` has it (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``, else (as in tests) one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="corpusloom-"))
    return sc.getCheckpointDir()


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here and outlives lost executors.

    The table goes when the Python driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}.parquet"
    df.write.parquet(path)
    atexit.register(_drop, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _drop(spark: SparkSession, path: str) -> None:
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session is gone: whoever owns the shared folder clears it
        return


def checkpointed(df: DataFrame) -> DataFrame:
    """``checkpoint()`` in the shared folder. Its files go with the reference, where ``cleanCheckpoints`` is set for Spark's cleaner."""
    shared_dir(df.sparkSession)
    return df.checkpoint()
