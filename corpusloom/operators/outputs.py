"""Model outputs: the JSON object in a completion, strictly typed."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, BooleanType, StringType, StructField, StructType

OUTPUT = StructType([StructField("labels", ArrayType(StringType())), StructField("parse_ok", BooleanType()), StructField("parse_error", StringType())])

_DECODER = json.JSONDecoder()


def parse_tails(text: str | None) -> tuple[list[str], bool, str | None]:
    """Labels under "tails" of the first JSON object in a text, whether that worked, and why not.

    A code fence around the object is taken off. Only a list of strings counts; blank ones are left out.
    A null text has no object.
    """
    body = (text or "").strip()
    if body.startswith("```"):
        lines = body.splitlines()[1:]
        if len(lines) >= 2 and lines[-1].strip() == "```":
            lines.pop()
        body = "\n".join(lines)
    at = body.find("{")
    if at < 0:
        return [], False, "no_json_object"
    try:
        found, _ = _DECODER.raw_decode(body[at:])
    except json.JSONDecodeError as e:
        return [], False, f"invalid_json: {e}"
    tails = found.get("tails")
    if not isinstance(tails, list) or not all(isinstance(x, str) for x in tails):
        return [], False, "tails_must_be_a_string_list"
    return [x.strip() for x in tails if x.strip()], True, None


@pandas_udf(OUTPUT)
def parse_output(text: pd.Series) -> pd.DataFrame:
    rows = [parse_tails(t) for t in text]
    return pd.DataFrame({"labels": [r[0] for r in rows], "parse_ok": [r[1] for r in rows], "parse_error": [r[2] for r in rows]})
