"""Queries of metrics, sampling, token blocks, stream combinators and model outputs.

Orders stand for retrieval queries: their parts by falling price are the ranking, returned parts the
prediction, parts with a discount of 5 % or more the gold, those already shipped the gold in the pool.
Labelled documents stand for scored pairs, with a score made of their length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import numeric
from corpusloom.functions import text as T
from corpusloom.operators import metrics, outputs, records, sampling, sinks, token_blocks
from corpusloom.plans.registry import query
from corpusloom.streaming import events
from corpusloom.tables import table

LISTS_SQL = """
    parts AS (
        SELECT l_orderkey AS query_id, 'P' || l_partkey AS p, max(l_extendedprice) AS price, bool_or(l_returnflag = 'R') AS pred, bool_or(l_discount >= 0.05) AS gold,
               bool_or(l_discount >= 0.05 AND l_linestatus = 'F') AS pool
        FROM lineitem GROUP BY ALL
    ), placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY price DESC, p) AS rank FROM parts)"""

PER_SQL = (
    LISTS_SQL
    + """, flagged AS (SELECT *, sum(CAST(gold AS INTEGER)) OVER (PARTITION BY query_id ORDER BY rank) AS hits, count(*) FILTER (gold) OVER (PARTITION BY query_id) AS g FROM placed),
    per AS (
        SELECT query_id, CAST(count(*) AS INTEGER) AS n_candidates, CAST(count(*) FILTER (gold) AS INTEGER) AS n_full, CAST(count(*) FILTER (pool) AS INTEGER) AS n_pool, CAST(count(*) FILTER (pred) AS INTEGER) AS n_predicted,
               CAST(count(*) FILTER (pred AND gold) AS INTEGER) AS tp_full, CAST(count(*) FILTER (pred AND pool) AS INTEGER) AS tp_pool,
               CAST(bool_and(pred = gold) AS INTEGER) AS exact_full, CAST(bool_and(pred = pool) AS INTEGER) AS exact_pool,
               coalesce(sum(hits::DOUBLE / rank) FILTER (gold) / nullif(max(g), 0), 0.0) AS map, coalesce(1.0::DOUBLE / min(rank) FILTER (gold), 0.0) AS mrr,
               coalesce(count(*) FILTER (gold AND rank <= 5)::DOUBLE / nullif(max(g), 0), 0.0) AS recall_5,
               coalesce(sum(1 / log2(rank + 1)) FILTER (gold AND rank <= 5) / list_sum(list_transform(range(1, least(5, max(g)) + 1), lambda i: 1 / log2(i + 1))), 0.0) AS ndcg_5
        FROM flagged GROUP BY query_id)"""
)


def lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    pooled = (F.col("l_discount") >= 0.05) & (F.col("l_linestatus") == "F")
    parts = items.groupBy(F.col("l_orderkey").alias("query_id"), F.concat(F.lit("P"), "l_partkey").alias("p")).agg(
        F.max("l_extendedprice").alias("price"), F.bool_or(F.col("l_returnflag") == "R").alias("pred"), F.bool_or(F.col("l_discount") >= 0.05).alias("gold"), F.bool_or(pooled).alias("pool")
    )
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("price")).alias("o"), "p", "pred", "gold", "pool")))
    pick = lambda cond: F.transform(F.filter("x", cond), lambda s: s["p"])
    gathered = parts.groupBy("query_id").agg(ordered.alias("x"))
    named = gathered.select(
        "query_id",
        F.transform("x", lambda s: s["p"]).alias("ranked"),
        F.transform("x", lambda s: s["p"]).alias("candidates"),
        pick(lambda s: s["pred"]).alias("predicted"),
        pick(lambda s: s["gold"]).alias("full_gold"),
        pick(lambda s: s["pool"]).alias("pool_gold"),
    )
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("query_id"), F.col("o_orderpriority").alias("repository"))
    return named.join(orders, "query_id")


@query(
    "query_metrics",
    "WITH" + PER_SQL + """ SELECT query_id, n_candidates, n_full, n_pool, n_predicted, tp_full, tp_pool, exact_full, exact_pool, round(map, 9) AS map, round(mrr, 9) AS mrr, round(recall_5, 9) AS recall_5, round(ndcg_5, 9) AS ndcg_5
    FROM per JOIN orders ON o_orderkey = query_id""",
)
def query_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = metrics.query_metrics(lists(spark, sf_dir))
    counts = ("query_id", "n_candidates", "n_full", "n_pool", "n_predicted", "tp_full", "tp_pool", "exact_full", "exact_pool")
    return per.select(*counts, *(F.round(c, 9).alias(c) for c in ("map", "mrr", "recall_5", "ndcg_5")))


@query(
    "retrieval_metrics",
    "WITH" + PER_SQL + """ SELECT CASE WHEN grouping(o_orderpriority) = 1 THEN 'overall' ELSE o_orderpriority END AS scope, count(*) AS queries, CAST(sum(n_full) AS BIGINT) AS gold_tails, CAST(sum(n_predicted) AS BIGINT) AS predicted_tails,
        round(sum(tp_full)::DOUBLE / sum(n_predicted), 9) AS full_precision, round(sum(tp_full)::DOUBLE / sum(n_full), 9) AS full_recall,
        round(2.0 * sum(tp_full) / (sum(n_predicted) + sum(n_full)), 9) AS full_f1, round(sum(exact_pool)::DOUBLE / count(*), 9) AS pool_exact,
        count(*) FILTER (n_full = 0) AS empty_gold_queries, round(avg(map), 7) AS macro_map, round(avg(mrr), 7) AS macro_mrr, round(avg(ndcg_5), 7) AS macro_ndcg_5
    FROM per JOIN orders ON o_orderkey = query_id GROUP BY ROLLUP (o_orderpriority)""",
)
def retrieval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = metrics.retrieval_metrics(metrics.query_metrics(lists(spark, sf_dir)))
    return found.select(
        "scope", "queries", "gold_tails", "predicted_tails", *(F.round(c, 9).alias(c) for c in ("full_precision", "full_recall", "full_f1", "pool_exact")), F.col("empty_gold_queries").cast("long").alias("empty_gold_queries"), *(F.round(c, 7).alias(c) for c in ("macro_map", "macro_mrr", "macro_ndcg_5"))
    )


SCORED_SQL = "scored AS (SELECT (d.n_chars % 997) / 997.0::DOUBLE AS score, l.quality AS label FROM documents d JOIN labels l USING (doc_id))"


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", ((F.col("n_chars") % 997) / F.lit(997.0)).alias("score"))
    return docs.join(table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label")), "doc_id").select("score", "label")


@query(
    "binary_metrics",
    "WITH " + SCORED_SQL + """, c AS (SELECT count(*) AS examples, CAST(sum(label) AS BIGINT) AS positive_labels, count(*) FILTER (score >= 0.5 AND label = 1) AS tp, count(*) FILTER (score >= 0.5 AND label = 0) AS fp,
        count(*) FILTER (score < 0.5 AND label = 0) AS tn, count(*) FILTER (score < 0.5 AND label = 1) AS fn FROM scored)
    SELECT *, 0.5::DOUBLE AS threshold, round((tp + tn)::DOUBLE / examples, 9) AS accuracy, round(tp::DOUBLE / (tp + fp), 9) AS precision, round(tp::DOUBLE / (tp + fn), 9) AS recall, round(2.0 * tp / (2 * tp + fp + fn), 9) AS f1 FROM c""",
)
def binary_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.confusion(scored(spark, sf_dir), 0.5).withColumns({c: F.round(c, 9) for c in ("accuracy", "precision", "recall", "f1")})


@query(
    "roc_auc",
    "WITH " + SCORED_SQL + """ SELECT round((SELECT sum(CASE WHEN p.score > n.score THEN 1.0 WHEN p.score = n.score THEN 0.5 ELSE 0 END) FROM scored p, scored n WHERE p.label = 1 AND n.label = 0)::DOUBLE
        / ((SELECT count(*) FROM scored WHERE label = 1) * (SELECT count(*) FROM scored WHERE label = 0)), 9) AS auroc""",
)
def roc_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.roc_auc(metrics.score_curve(scored(spark, sf_dir))).withColumn("auroc", F.round("auroc", 9))


CURVE_SQL = "WITH " + SCORED_SQL + """, g AS (SELECT score, sum(label) AS pos, count(*) AS n FROM scored GROUP BY score),
    c AS (SELECT score, pos, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(n) OVER (ORDER BY score DESC) AS seen, sum(pos) OVER () AS p FROM g)"""


@query("average_precision", CURVE_SQL + " SELECT round(sum(pos * tp::DOUBLE / seen) / max(p), 9) AS average_precision FROM c")
def average_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.binary_average_precision(metrics.score_curve(scored(spark, sf_dir))).withColumn("average_precision", F.round("average_precision", 9))


@query("best_f1", CURVE_SQL + " SELECT round(score, 9) AS threshold, round(2.0 * tp / (seen + p), 9) AS f1 FROM c ORDER BY 2.0::DOUBLE * tp / (seen + p) DESC, score DESC LIMIT 1")
def best_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.best_f1_threshold(metrics.score_curve(scored(spark, sf_dir))).select(F.round("threshold", 9).alias("threshold"), F.round("f1", 9).alias("f1"))


def _phase(n: str) -> str:
    return f"CAST(CAST('0x' || substr(sha256('42:items:pointwise-negative-phase'), 1, 16) AS UBIGINT) % ({n}) AS BIGINT)"


@query(
    "negative_selector",
    f"""WITH r AS (SELECT event_id, CAST(event_type = 'purchase' AS INTEGER) AS label FROM events), n AS (SELECT count(*) AS n, CAST(round_even(0.1 * count(*), 0) AS BIGINT) AS k FROM r WHERE label = 0),
    o AS (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS i FROM r WHERE label = 0)
    SELECT event_id, label FROM r WHERE label = 1 UNION ALL
    SELECT event_id, 0 FROM o, n WHERE ({_phase("n")} + (i + 1) * k) // n > ({_phase("n")} + i * k) // n""",
)
def negative_selector(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", (F.col("event_type") == "purchase").cast("int").alias("label"))
    return sampling.balanced_selector(rows, ["event_id"], 0.1, 42, "items")


@query("mixture_weights", "WITH s AS (SELECT source AS repository, count(*) AS n FROM documents GROUP BY source) SELECT repository, n, round(pow(n, 0.5) / (SELECT sum(pow(n, 0.5)) FROM s), 7) AS weight FROM s")
def mixture_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("repository")).agg(F.count("*").alias("n"))
    return sampling.mixture_weights(sizes, 0.5).withColumn("weight", F.round("weight", 7))


@query(
    "step_plan",
    """WITH m AS (SELECT o_orderpriority AS repository, count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS positives FROM orders GROUP BY ALL),
    r AS (SELECT CAST(sum(positives + CAST(round_even(0.03 * (total - positives), 0) AS BIGINT)) AS BIGINT) AS records FROM m), s AS (SELECT records, CAST(ceil(records / 16.0) AS BIGINT) AS max_steps FROM r)
    SELECT *, greatest(10, CAST(ceil(max_steps / 1000.0) AS BIGINT)) AS logging_steps, greatest(250, CAST(ceil(max_steps / 20.0) AS BIGINT)) AS eval_steps, least(1000, greatest(250, CAST(ceil(max_steps / 20.0) AS BIGINT))) AS save_steps FROM s""",
)
def step_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifests = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("repository")).agg(F.count("*").alias("total"), F.count_if(F.col("o_orderstatus") == "F").alias("positives"))
    return sampling.step_plan(manifests, 0.03, 4, 4)


BLOCK = 512
BLOCKS_SQL = r"""WITH d AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM documents),
    t AS (SELECT doc_id, {batch} AS batch, unnest(w) AS tok, generate_subscripts(w, 1) AS j FROM d),
    n AS (SELECT batch, tok, row_number() OVER (PARTITION BY batch ORDER BY doc_id, j) - 1 AS k FROM t)
    SELECT batch, k // 512 AS block, md5(string_agg(tok, ' ' ORDER BY k)) AS tokens_md5 FROM n GROUP BY ALL HAVING count(*) = 512"""


def _blocks(spark: SparkSession, sf_dir: str, batch: int | None) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", T.words(F.col("text")).alias("tokens"))
    return token_blocks.blocks(rows, BLOCK, ["doc_id"], batch).select("batch", "block", F.md5(F.array_join("tokens", " ")).alias("tokens_md5"))


@query("token_packing", BLOCKS_SQL.replace("{batch}", "CAST(0 AS BIGINT)"))
def token_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _blocks(spark, sf_dir, None)


@query("token_packing_batched", BLOCKS_SQL.replace("{batch}", "i // 100"))
def token_packing_batched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _blocks(spark, sf_dir, 100)


@query("json_props", "SELECT event_id, CAST(props->>'$.k' AS BIGINT) AS k FROM events")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


STREAMS_SQL = """WITH s AS (SELECT lang, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS no, c FROM (SELECT lang, count(*) AS c FROM documents GROUP BY lang))"""


def streams(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """The documents (doc_id, lang) of every language, null first."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    found = [r["lang"] for r in docs.select("lang").distinct().collect()]
    return [docs.where(F.col("lang").eqNullSafe(x)) for x in sorted(found, key=lambda x: (x is not None, x))]


@query("stream_round_robin", STREAMS_SQL + """, n AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS turn FROM documents)
    SELECT doc_id, turn * (SELECT count(*) FROM s) + no AS position FROM n JOIN s ON n.lang IS NOT DISTINCT FROM s.lang WHERE turn < (SELECT min(c) FROM s)""")
def stream_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.round_robin(streams(spark, sf_dir), ["doc_id"]).select("doc_id", "position")


@query("stream_concat", STREAMS_SQL + " SELECT doc_id, CAST(no AS INTEGER) AS source_no FROM documents d JOIN s ON d.lang IS NOT DISTINCT FROM s.lang")
def stream_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.concatenate(streams(spark, sf_dir)).select("doc_id", "source_no")


@query("stream_weighted")
def stream_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources in given proportions until all are exhausted; statistical, so without an oracle."""
    sources = streams(spark, sf_dir)
    shares = [1 + k % 2 for k in range(len(sources))]
    return sampling.weighted_interleave(sources, [x / sum(shares) for x in shares], ["doc_id"])


@query(
    "completion_scores",
    """WITH s AS (SELECT l_orderkey, sum(-CAST(l_discount AS DOUBLE)) AS v, sum(-CAST(l_tax AS DOUBLE)) AS i, count(*) AS n FROM lineitem GROUP BY ALL)
    SELECT l_orderkey, round(v, 9) AS valid, round(v / n, 9) AS valid_mean, round(1 / (1 + exp(i - v)), 9) AS share, round(1 / (1 + exp((i - v) / n)), 9) AS share_of_means FROM s""",
)
def completion_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order stand for the tokens of two completions, discount and tax for their log-probabilities."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(-F.col("l_discount").cast("double"), -F.col("l_tax").cast("double"))).alias("t"))
    valid, invalid = F.transform("t", lambda x: x["col1"]), F.transform("t", lambda x: x["col2"])
    columns = {"valid": numeric.log_likelihood(valid), "valid_mean": numeric.log_likelihood(valid, mean=True), "share": numeric.completion_share(valid, invalid), "share_of_means": numeric.completion_share(valid, invalid, mean=True)}
    return lines.select("l_orderkey", *(F.round(c, 9).alias(k) for k, c in columns.items()))


@query(
    "ordered_roles",
    "SELECT conv_id, string_agg(role, ',' ORDER BY t) AS roles, replace(replace(string_agg(role, '/' ORDER BY t), '/', '-'), '_', '-') AS slug FROM (SELECT conv_id, role, min(turn) AS t FROM conversations WHERE role IS NOT NULL GROUP BY ALL) GROUP BY conv_id",
)
def ordered_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The roles of a conversation in the order in which they first speak, and a name made of them."""
    turns = table(spark, sf_dir, "conversations").where("role is not null").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("t"))
    roles = numeric.ordered_unique(F.transform("t", lambda x: x["role"]))
    return turns.select("conv_id", F.array_join(roles, ",").alias("roles"), numeric.slug(F.array_join(roles, "/")).alias("slug"))


@query("parse_tail_output")
def parse_tail_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completions made of event properties, parsed strictly; Python's JSON has no faithful SQL form."""
    made = F.concat(F.lit("```json\n{\"tails\": [\""), "event_type", F.lit("\", \"\"]} \n```"))
    return table(spark, sf_dir, "events").select("event_id", outputs.parse_output(made).alias("o")).select("event_id", "o.*")


@query("conversation_runs", """WITH c AS (SELECT *, CASE WHEN role = lag(role) OVER w THEN 0 ELSE 1 END AS new FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
    SELECT conv_id, turn, CAST(sum(new) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS run FROM c""")
def conversation_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.runs(table(spark, sf_dir, "conversations"), "role", ["conv_id"], ["turn"]).select("conv_id", "turn", "run")


@query("conversation_render", """SELECT conv_id, md5(string_agg(upper(substr(role, 1, 1)) || lower(substr(role, 2)) || ':' || chr(10) || text || chr(10), '' ORDER BY turn) || 'Assistant:' || chr(10)) AS prompt_md5 FROM conversations GROUP BY conv_id""")
def conversation_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    grouped = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(turns.alias("m"))
    return grouped.select("conv_id", F.md5(records.fallback_chat(F.col("m"), cue=True)).alias("prompt_md5"))


@query("experiment_matrix", "SELECT r_name AS dataset, init, task FROM region, (SELECT unnest(['base', 'cpt']) AS init), (SELECT unnest(['set', 'pointwise']) AS task)")
def experiment_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five regions, two starts and two tasks: the sides that are crossed are the two literal lists."""
    return table(spark, sf_dir, "region").select(F.col("r_name").alias("dataset"), F.explode(F.array(F.lit("base"), F.lit("cpt"))).alias("init")).select("*", F.explode(F.array(F.lit("set"), F.lit("pointwise"))).alias("task"))


@query("example_masks", r"""WITH w AS (SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS INTEGER) AS n FROM documents)
    SELECT doc_id, CAST(least(n, 60) + 4 AS INTEGER) AS length, CAST(least(n, 60) AS INTEGER) AS masked FROM w""")
def example_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word lengths stand for token ids; a completion of four tokens stays whole within 64."""
    ids = F.transform(T.words(F.col("text")), F.length)
    made = table(spark, sf_dir, "documents").select("doc_id", token_blocks.example(ids, F.array(*map(F.lit, (1, 2, 3, 4))), 64).alias("e"))
    return made.select("doc_id", F.size("e.input_ids").alias("length"), F.size(F.filter("e.labels", lambda x: x == token_blocks.IGNORED)).alias("masked"))


@query(
    "compact_prompts",
    r"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM documents),
    b AS (SELECT *, greatest(24, 922 // greatest(1, len(w) % 50)) AS each FROM w)
    SELECT doc_id, CAST(230 AS INTEGER) AS query_budget, CAST(each AS INTEGER) AS candidate_budget, md5(array_to_string(list_slice(w, 1, each), ' ')) AS compact_md5 FROM b""",
)
def compact_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as candidates of prompts of 2048 tokens; the number of candidates is made of their length."""
    rows = table(spark, sf_dir, "documents").select("doc_id", T.words(F.col("text")).alias("w"))
    for_query, for_each = token_blocks.prompt_budgets(F.size("w") % 50, 2048)
    cut = token_blocks.compact_prompt(F.col("w"), for_each)
    return rows.select("doc_id", for_query.alias("query_budget"), for_each.alias("candidate_budget"), F.md5(cut).alias("compact_md5"))


_KEPT = "CAST('0x' || substr(sha256('42:' || {key}), 1, 16) AS UBIGINT)::DOUBLE / 18446744073709551615::DOUBLE < 0.25"


@query(
    "kept_records",
    f"""SELECT d.doc_id, (coalesce(quality = 1, false) OR {_KEPT.format(key="d.doc_id || ':' || coalesce(lang, '')")}) AS keep_pointwise,
    (coalesce(toxic = 1, false) OR {_KEPT.format(key="d.doc_id")}) AS keep_set FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
)
def kept_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which training records stay: good documents as positives, toxic ones as queries with gold."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang").join(labels, "doc_id", "left")
    uid = F.col("doc_id").cast("string")
    point = sampling.keep_pointwise(F.coalesce("quality", F.lit(0)), uid, F.coalesce("lang", F.lit("")), 42, 0.25)
    gold = F.when(F.col("toxic") == 1, F.array(uid)).otherwise(F.array().cast("array<string>"))
    return rows.select("doc_id", point.alias("keep_pointwise"), sampling.keep_set(gold, uid, 42, 0.25).alias("keep_set"))


@query("rerank_pointwise", "SELECT l_orderkey AS query_id, 'P' || l_partkey AS candidate_uid, l_linenumber AS retriever_rank, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_discount DESC, l_linenumber, 'P' || l_partkey) AS INTEGER) AS rank FROM lineitem")
def rerank_pointwise(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.concat(F.lit("P"), "l_partkey").alias("candidate_uid"), F.col("l_linenumber").alias("retriever_rank"), F.col("l_discount").alias("probability"))
    return metrics.rerank(rows).drop("probability")


@query("manifest_summary", "SELECT coalesce(l_returnflag, 'total') AS repository, count(*) FILTER (l_linestatus = 'O') AS train, count(*) FILTER (l_linestatus = 'F') AS validation FROM lineitem GROUP BY ROLLUP (l_returnflag)")
def manifest_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("repository")).agg(F.count_if(F.col("l_linestatus") == "O").alias("train"), F.count_if(F.col("l_linestatus") == "F").alias("validation"))
    return sinks.summary(per)


@query("events_windowed", "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(28, 6))) AS DECIMAL(28, 6)) AS total FROM events GROUP BY ALL")
def events_windowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = events.windowed_counts(table(spark, sf_dir, "events"))
    return found.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.col("total").cast("decimal(28,6)").alias("total"))




@query("shuffled_take", "SELECT doc_id FROM documents ORDER BY sha256('42:' || doc_id), CAST(doc_id AS VARCHAR) LIMIT 100")
def shuffled_take(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 100 of a seeded shuffle (the limit is the feature)."""
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return sampling.shuffled(docs, F.col("doc_id").cast("string"), 42).limit(100)


@query(
    "padded_batches",
    r"""WITH w AS (SELECT doc_id, doc_id // 8 AS batch_id, CAST(least(len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')), 60) + 4 AS INTEGER) AS n FROM documents)
    SELECT doc_id, batch_id, max(n) OVER (PARTITION BY batch_id) AS length, max(n) OVER (PARTITION BY batch_id) - n AS padding FROM w""",
)
def padded_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = F.transform(T.words(F.col("text")), F.length)
    made = table(spark, sf_dir, "documents").select("doc_id", F.expr("doc_id div 8").alias("batch_id"), token_blocks.example(ids, F.array(*map(F.lit, (1, 2, 3, 4))), 64).alias("e"))
    padded = token_blocks.pad(made.select("doc_id", "batch_id", "e.*"), 0)
    return padded.select("doc_id", "batch_id", F.size("input_ids").alias("length"), F.size(F.filter("attention_mask", lambda x: x == 0)).alias("padding"))


@query(
    "label_mapping",
    """WITH c AS (SELECT l_orderkey AS q, l_linenumber AS n, min(l_partkey) AS p, bool_or(l_returnflag = 'R') AS r FROM lineitem GROUP BY ALL)
    SELECT q AS query_id, coalesce(string_agg(CASE WHEN r THEN 'P' || p END, ',' ORDER BY n), '') AS predicted, 'C999' AS invalid,
           coalesce(string_agg(CASE WHEN r THEN 'C' || lpad(CAST(n AS VARCHAR), 3, '0') END, ',' ORDER BY n), '') AS duplicates
    FROM c GROUP BY q""",
)
def label_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each returned line is answered twice, and one label is unknown."""
    label = F.format_string("C%03d", "l_linenumber")
    line = F.struct("l_linenumber", label.alias("label"), F.concat(F.lit("P"), "p").alias("issue_uid"), "r")
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"), F.bool_or(F.col("l_returnflag") == "R").alias("r"))
    per = lines.groupBy(F.col("l_orderkey").alias("query_id")).agg(F.array_sort(F.collect_list(line)).alias("candidates"))
    answered = F.transform(F.filter("candidates", lambda c: c["r"]), lambda c: c["label"])
    rows = per.select("query_id", "candidates", F.concat(answered, F.array(F.lit("C999")), answered).alias("labels"))
    found = metrics.map_labels(rows)
    return found.select("query_id", F.array_join("predicted_uids", ",").alias("predicted"), F.array_join("invalid_labels", ",").alias("invalid"), F.array_join("duplicate_labels", ",").alias("duplicates"))
