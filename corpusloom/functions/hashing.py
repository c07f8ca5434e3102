"""Hashes as keys: digests, exact modulo of 256-bit digests, stable fractions, splits and shards."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def digest_mod(digest: Column, modulus: int) -> Column:
    """A 64-digit hexadecimal digest modulo ``modulus`` (below 2**31), by Horner over eight groups of eight digits."""
    if not 0 < modulus < 1 << 31:
        raise ValueError("modulus must lie between 1 and 2**31 - 1")
    rest = F.lit(0).cast("long")
    for k in range(8):
        group = F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long")
        rest = F.pmod(rest * F.lit((1 << 32) % modulus) + group, F.lit(modulus))
    return rest


def head_number(digest: Column) -> Column:
    """The first 16 hexadecimal digits as decimal(20,0)."""
    return F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)")


def stable_fraction(key: Column) -> Column:
    """A number in [0, 1] that depends on the key alone."""
    return head_number(sha256(key)).cast("double") / F.lit(float((1 << 64) - 1))


def in_shard(key: Column, shards: int, shard: int) -> Column:
    return (head_number(sha256(key)) % F.lit(shards).cast("decimal(20,0)")).cast("int") == shard


def group_split(group: Column, seed: str, buckets: int = 10000, validation: int = 100) -> Column:
    """'validation' for the first buckets of the seeded hash of a group, else 'train'."""
    bucket = digest_mod(sha256(F.concat(F.lit(seed + ":"), group)), buckets)
    return F.when(bucket < validation, F.lit("validation")).otherwise(F.lit("train"))


def query_split(key: Column, relation: Column, source: Column, version: str = "sft-v1") -> Column:
    """'test' stays; else a tenth of the (key, relation) pairs is 'validation' and the rest 'train'."""
    bucket = digest_mod(sha256(F.concat_ws(":", F.lit(version), key, relation)), 100)
    return F.when(source == "test", F.lit("test")).when(bucket < 10, F.lit("validation")).otherwise(F.lit("train"))
