"""Training examples: prompt and completion token ids of a record, compacted until they fit; the tokenizer is passed in.

A set record must keep all its candidates: its prompt is rebuilt with smaller texts until prompt and completion fit, and it
is an error if that fails. A pointwise prompt is cut at its end. The completion always stays whole.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame

from corpusloom.operators.token_blocks import (
    COMPLETION_RESERVE,
    FRAME_RESERVE,
    IGNORED,
    LEAST_CANDIDATE,
    LEAST_CONTENT,
    LEAST_QUERY,
    MOST_QUERY,
    QUERY_SHARE,
)

SCHEMA = "query_id string, input_ids array<int>, attention_mask array<int>, labels array<int>"

# How often and how far a prompt is compacted.
ROUNDS = 6
SHRINK_SLACK, LEAST_LIMIT = 128, 1024


@dataclass(frozen=True)
class Tokenizer:
    """``encode`` and ``decode`` of plain text, and ``chat``: the ids of messages, with or without the cue to answer."""

    encode: Callable[[str], list[int]]
    decode: Callable[[list[int]], str]
    chat: Callable[[list[dict[str, str]], bool], list[int]]
    eos: str = ""


def budgets(candidates: int, limit: int) -> tuple[int, int]:
    """Tokens of the query and of each candidate; a fixed reserve, so that lengths say nothing of the answer."""
    content = max(LEAST_CONTENT, limit - COMPLETION_RESERVE - FRAME_RESERVE)
    query = min(MOST_QUERY, max(LEAST_QUERY, content // QUERY_SHARE))
    return query, max(LEAST_CANDIDATE, (content - query) // max(1, candidates))


def truncated(tokenizer: Tokenizer, text: str, most: int) -> str:
    return tokenizer.decode(tokenizer.encode(text)[:most]) if most > 0 else ""


def compacted(record: dict[str, Any], tokenizer: Tokenizer, limit: int) -> list[dict[str, str]]:
    """The messages of a set record with its query and candidates cut to the budgets of ``limit``."""
    candidates = record["candidate_records"]
    for_query, for_each = budgets(len(candidates), limit)
    body = [f"Query issue {record['query_uid']}:", truncated(tokenizer, record["query_text"], for_query)]
    body += [f"Relation: {record['relation']}", f"Relation definition: {record['relation_definition']}", "Candidates:"]
    body += [f"{c['label']}: {truncated(tokenizer, c['text'], for_each)}" for c in candidates]
    return [record["prompt"][0], {"role": "user", "content": "\n".join(body)}]


def split_ids(tokenizer: Tokenizer, prompt: list[dict[str, str]], completion: list[dict[str, str]]) -> tuple[list[int], list[int]]:
    """Prompt and completion ids: the rest of the whole conversation if the prompt is its prefix, else the answer alone."""
    asked, whole = tokenizer.chat(prompt, True), tokenizer.chat(prompt + completion, False)
    if whole[: len(asked)] == asked:
        return asked, whole[len(asked) :]
    return asked, tokenizer.encode(completion[0]["content"] + tokenizer.eos)


def encode_record(record: dict[str, Any], tokenizer: Tokenizer, is_set: bool, most: int) -> dict[str, Any]:
    """query_id, input_ids, attention_mask and labels (the prompt masked) of at most ``most`` tokens; ValueError if that can't be."""

    def attempts() -> Iterator[tuple[list[int], list[int]]]:
        limit = most
        for _ in range(ROUNDS):
            prompt = compacted(record, tokenizer, limit) if is_set else record["prompt"]
            asked, answer = split_ids(tokenizer, prompt, record["completion"])
            yield asked, answer
            limit = max(LEAST_LIMIT, limit - (len(asked) + len(answer) - most) - SHRINK_SLACK)

    for asked, answer in attempts():
        if not is_set or len(asked) + len(answer) <= most:
            break
    if len(answer) >= most:
        raise ValueError(f"the completion of {record['query_id']} alone has {len(answer)} tokens, {most} is the limit")
    if len(asked) + len(answer) > most:
        if is_set:
            raise ValueError(f"the candidates of {record['query_id']} do not all fit {most} tokens")
        asked = asked[: most - len(answer)]
    ids = asked + answer
    return {"query_id": record["query_id"], "input_ids": ids, "attention_mask": [1] * len(ids), "labels": [IGNORED] * len(asked) + answer}


def encode(records: DataFrame, make_tokenizer: Callable[[], Tokenizer], task: str, most: int) -> DataFrame:
    """Encoded examples of set or pointwise records; ``make_tokenizer`` is called once in a task."""
    if task not in ("set_retrieval", "pointwise"):
        raise ValueError(f"unknown task {task}")
    needed = ["query_id", "prompt", "completion"]
    if task == "set_retrieval":
        needed += ["query_uid", "query_text", "relation", "relation_definition", "candidate_records"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokenizer = make_tokenizer()
        for batch in batches:
            made = [encode_record(json.loads(r), tokenizer, task == "set_retrieval", most) for r in batch["record"]]
            yield pd.DataFrame(made, columns=["query_id", "input_ids", "attention_mask", "labels"])

    # Nested records travel as JSON, so that lists and structs are plain Python in the task.
    packed = records.selectExpr(f"to_json(struct({', '.join(needed)}), map('ignoreNullFields', 'false')) AS record")
    return packed.mapInPandas(run, SCHEMA)
