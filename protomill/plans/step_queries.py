"""Queries of step operators: lines of documents stand in for steps, short lines for headings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from protomill.functions import fixed_values as V
from protomill.functions import text as X
from protomill.operators import steps as S
from protomill.plans.registry import query, table
from protomill.plans.text_queries import FAMILIES, LINES, TRIM, whole_words

#: A line of fewer characters sets the stage to its first word.
SHORT = 60
NAMES = list(FAMILIES)
SCORE_FROM = 18.0


def raw_rows(spark: SparkSession, sf: str) -> DataFrame:
    """doc_id, line_no, section and text."""
    lines = S.lines_of(table(spark, sf, "documents"))
    head = F.when(F.length(X.normalize(F.col("line"))) < SHORT, F.element_at(F.split(X.normalize(F.col("line")), " "), 1)).otherwise(F.lit(""))
    return lines.select("doc_id", "line_no", head.alias("section"), F.col("line").alias("text"))


def steps(spark: SparkSession, sf: str) -> DataFrame:
    titles = table(spark, sf, "documents").select("doc_id", F.col("source").alias("title"))
    return S.build_steps(raw_rows(spark, sf), titles, "doc_id", "line_no")


STEPS = f"""{LINES},
raw AS (SELECT doc_id, line_no, {TRIM.format('line')} AS description FROM lines),
cut AS (SELECT doc_id, line_no, description, CASE WHEN length(description) < {SHORT} THEN string_split(description, ' ')[1] ELSE '' END AS section FROM raw WHERE description <> ''),
filled AS (SELECT *, last_value(nullif(section, '') IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no) AS carried,
           row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS idx FROM cut),
steps AS (SELECT f.doc_id, idx, coalesce(carried, d.source) AS stage, description, carried IS NULL AS fallback FROM filled f JOIN documents d USING (doc_id))"""


@query(f"WITH {STEPS} SELECT doc_id, idx, stage, md5(description) AS digest, fallback FROM steps")
def w1_stage_fill(spark: SparkSession, sf: str) -> DataFrame:
    return steps(spark, sf).select("doc_id", "idx", "stage", F.md5("description").alias("digest"), "fallback")


@query(f"WITH {STEPS} SELECT doc_id, count(*) FILTER (fallback) AS fallbacks, count(DISTINCT stage) AS stages, max(idx) AS n FROM steps GROUP BY doc_id")
def w2_step_counts(spark: SparkSession, sf: str) -> DataFrame:
    return steps(spark, sf).groupBy("doc_id").agg(F.count_if("fallback").alias("fallbacks"), F.count_distinct("stage").alias("stages"), F.max("idx").alias("n"))


@query(
    "SELECT user_id, event_id, coalesce(last_value(CASE WHEN event_type = 'view' THEN props END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id), '') AS carried FROM events"
)
def w3_carry_forward(spark: SparkSession, sf: str) -> DataFrame:
    mark = F.when(F.col("event_type") == "view", F.col("props")).otherwise(F.lit(""))
    rows = table(spark, sf, "events").select("user_id", "event_id", F.struct("ts", "event_id").alias("pos"), mark.alias("mark"))
    return S.carry_forward(rows, "user_id", "pos", "mark", "carried").select("user_id", "event_id", "carried")


GENERIC = "(length(trim(lower(description))) < 18 OR regexp_matches(trim(lower(description)), '^\\s*(cleaning|preparation|mouse preparation|stereotaxic surgery|injection cannulas circuit preparation|apparatus preparation)\\.?\\s*$'))"
FEATURES = f"""{STEPS},
features AS (SELECT doc_id, idx, nullif(stage, '') AS stage, {', '.join(f"CAST(regexp_matches(lower(description), '{p}') AS INT) AS f_{f}" for f, p in FAMILIES.items())},
  least(len(regexp_extract_all(description, '[-+]?\\d+(?:\\.\\d+)?')), 4) AS numbers, len(regexp_extract_all(description, '[-+]?\\d+(?:\\.\\d+)?')) AS all_numbers, CAST({GENERIC} AS INT) AS generic FROM steps)"""


def _windows_sql(lengths: list[int]) -> str:
    one = lambda n: (
        f"SELECT doc_id, idx AS start, {n} AS length, count(*) OVER w AS rows_in, {', '.join(f'sum(f_{f}) OVER w AS c_{f}' for f in NAMES)}, sum(numbers) OVER w AS numbers, sum(all_numbers) OVER w AS all_numbers, "
        f"sum(generic) OVER w AS generic, len(list_distinct(list(stage) OVER w)) AS stages FROM features WINDOW w AS (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN CURRENT ROW AND {n - 1} FOLLOWING)"
    )
    return f"{FEATURES}, windows AS (SELECT * FROM (" + " UNION ALL ".join(one(n) for n in lengths) + ") WHERE rows_in = length)"


def windows(spark: SparkSession, sf: str) -> DataFrame:
    return S.sliding_windows(S.step_features(steps(spark, sf), FAMILIES), S.window_lengths(6, 10), NAMES)


def _sum(parts: list[str]) -> str:
    return "(" + " + ".join(parts) + ")"


_DISTINCT = _sum([f"CAST(c_{f} > 0 AS INT)" for f in NAMES])
SCORED = f"""{_windows_sql([6, 8, 10])},
scored AS (SELECT *, {_DISTINCT} AS distinct_families, 1.5 * length + 2 * {_DISTINCT} + 3 * {_sum([f"greatest(c_{f} - 1, 0)" for f in NAMES if f in V.REPEAT_FAMILIES])}
  + 1.75 * {_sum([f"CAST(c_{f} >= 2 AS INT)" for f in NAMES])} + 2.5 * {_sum([f"CAST(c_{f} >= 2 AS INT)" for f in NAMES if f in V.CORE_FAMILIES])}
  + 0.75 * numbers + CASE WHEN stages <= 2 THEN 2 ELSE 0 END - 0.75 * c_device - 2 * generic AS score FROM windows),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, length, start) AS place FROM scored WHERE score >= {SCORE_FROM} AND distinct_families >= 2) WHERE place <= 5)"""


def best_first() -> list[Column]:
    """The order of windows, with the length and the start to break ties."""
    return [F.desc("score"), F.col("length"), F.col("start")]


def best_windows(spark: SparkSession, sf: str) -> DataFrame:
    scored = S.score_windows(windows(spark, sf), NAMES)
    return S.top_per_group(scored.where(f"score >= {SCORE_FROM} and distinct_families >= 2"), "doc_id", best_first(), 5)


@query(f"WITH {_windows_sql([6, 8, 10])} SELECT doc_id, start, length, numbers, generic, stages, c_transfer, c_mix FROM windows")
def w4_sliding_windows(spark: SparkSession, sf: str) -> DataFrame:
    return windows(spark, sf).select("doc_id", "start", "length", "numbers", "generic", "stages", "c_transfer", "c_mix")


@query(f"WITH {SCORED} SELECT doc_id, start, length, distinct_families, CAST(score AS DOUBLE) AS score FROM scored")
def a9_window_scores(spark: SparkSession, sf: str) -> DataFrame:
    return S.score_windows(windows(spark, sf), NAMES).select("doc_id", "start", "length", "distinct_families", "score")


@query(f"WITH {SCORED} SELECT doc_id, start, length, CAST(score AS DOUBLE) AS score FROM best")
def w6_best_windows(spark: SparkSession, sf: str) -> DataFrame:
    return best_windows(spark, sf).select("doc_id", "start", "length", "score")


@query(f"WITH {SCORED} SELECT doc_id, start, length, {_sum([f'CAST(c_{f} >= 2 AS INT)' for f in NAMES if f in V.REPEAT_FAMILIES])} >= 2 AND all_numbers >= 5 AND length >= 8 AS hard FROM scored")
def f13_hard_windows(spark: SparkSession, sf: str) -> DataFrame:
    scored = S.score_windows(windows(spark, sf), NAMES)
    return scored.select("doc_id", "start", "length", S.is_hard(NAMES).alias("hard"))


@query(
    f"WITH {SCORED}, capped AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, length, start) AS turn FROM best) "
    "SELECT doc_id, start, length, CAST(score AS DOUBLE) AS score FROM capped WHERE turn <= 2 ORDER BY capped.score DESC, doc_id, length, start LIMIT 200"
)
def select_windows(spark: SparkSession, sf: str) -> DataFrame:
    """The flagship: the best windows of steps, at most two of a document, 200 in all."""
    order = [F.desc("score"), F.col("doc_id"), F.col("length"), F.col("start")]
    return S.select_capped(best_windows(spark, sf), "doc_id", order, 2, 200).select("doc_id", "start", "length", "score")


@query(
    "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS turn FROM orders) "
    "WHERE turn <= 1 ORDER BY o_totalprice DESC, o_orderkey LIMIT 50"
)
def w7_capped_selection(spark: SparkSession, sf: str) -> DataFrame:
    order = [F.desc("o_totalprice"), F.col("o_orderkey")]
    return S.select_capped(table(spark, sf, "orders"), "o_custkey", order, 1, 50).select("o_custkey", "o_orderkey", "o_totalprice")


@query(
    "WITH l AS (SELECT l_orderkey, l_linenumber, min(l_returnflag) AS stage, max(l_quantity) AS q FROM lineitem GROUP BY 1, 2), rel AS (SELECT * FROM l WHERE q > 45), "
    "near AS (SELECT s.l_orderkey, s.l_linenumber, min(abs(s.l_linenumber - r.l_linenumber)) AS distance, bool_or(x.stage = s.stage) AS same_stage FROM l s "
    "JOIN rel r ON s.l_orderkey = r.l_orderkey AND abs(s.l_linenumber - r.l_linenumber) <= 2 JOIN rel x ON x.l_orderkey = s.l_orderkey WHERE s.q <= 45 GROUP BY 1, 2) "
    "SELECT l_orderkey, l_linenumber, distance, same_stage FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY distance, same_stage DESC, l_linenumber) AS k FROM near) WHERE k <= 3"
)
def j5_nearby_steps(spark: SparkSession, sf: str) -> DataFrame:
    """Lines near those with a large quantity, in the same order."""
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("stage"), F.max("l_quantity").alias("q"))
    found = S.nearby(lines, lines.where("q > 45"), "l_orderkey", "l_linenumber", k=3)
    return found.select("l_orderkey", "l_linenumber", "distance", "same_stage")


@query("SELECT user_id, event_id, event_type || '#' || row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS label FROM events")
def w9_occurrence_labels(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events").withColumn("pos", F.struct("ts", "event_id"))
    return S.occurrences(events, "user_id", "pos", "event_type").select("user_id", "event_id", "label")


@query("SELECT l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS k FROM lineitem) WHERE k <= 8")
def w6_top_per_supplier(spark: SparkSession, sf: str) -> DataFrame:
    order = [F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber")]
    return S.top_per_group(table(spark, sf, "lineitem"), "l_suppkey", order, 8).select("l_orderkey", "l_linenumber")


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders ORDER BY o_orderstatus DESC, o_totalprice, o_orderkey")
def o1_mixed_order(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").orderBy(F.desc("o_orderstatus"), "o_totalprice", "o_orderkey").select("o_orderkey", "o_orderstatus", "o_totalprice")


@query("SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 20")
def o2_top_n(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").orderBy(F.desc("n_chars"), "doc_id").limit(20).select("doc_id", "n_chars")


@query("SELECT event_id, user_id FROM events ORDER BY event_id LIMIT 500")
def o3_limit(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").orderBy("event_id").limit(500).select("event_id", "user_id")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type ORDER BY n DESC, event_type LIMIT 3")
def o9_most_common(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "event_type").limit(3)


_LOW = whole_words("press", "the", "balance", "seal").replace("the", "the er")


@query(
    f"WITH {STEPS}, joined AS (SELECT doc_id, string_agg(lower(description), chr(10) ORDER BY idx) AS body FROM steps GROUP BY doc_id) SELECT doc_id, regexp_matches(body, '{_LOW}') AS low_level FROM joined"
)
def f15_low_level_trigger(spark: SparkSession, sf: str) -> DataFrame:
    rows = steps(spark, sf).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "description"))), lambda x: F.lower(x["description"])), "\n").alias("body"))
    return rows.select("doc_id", F.col("body").rlike(_LOW).alias("low_level"))


def _pool_sql() -> str:
    lists = lambda names: "[" + ", ".join(f"'{n}'" for n in names) + "]"
    case = lambda cond, names: f"CASE WHEN {cond} THEN {lists(names)} ELSE [] END"
    has = lambda f: f"list_contains(families, '{f}')"
    parts = [case(has(f), V.FAMILY_ACTIONS[f]) for f in sorted(V.FAMILY_ACTIONS) if f != "manipulate"]
    parts += [
        case(f"{has('transfer')} AND NOT {has('wash')}", V.FAMILY_ACTIONS["wash"]),
        case(f"{has('wash')} AND NOT {has('transfer')}", V.FAMILY_ACTIONS["transfer"]),
        case(f"{has('incubate')} AND NOT {has('device')}", ("seal_plate",)),
        case(has("centrifuge"), ("wash_pellet", "discard_supernatant", "resuspend_pellet")),
        case(has("mix"), ("incubate_sample", "cool_sample")),
        case(has("measure"), ("store_sample", "mix_sample")),
        lists(V.DISTRACTOR_ACTIONS),
        case("doc_id % 2 = 0", V.LOW_LEVEL_ACTIONS),
    ]
    return "flatten([" + ", ".join(parts) + "])"


_FOUND = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(lower(text), '{FAMILIES[f]}') THEN '{f}' END" for f in sorted(FAMILIES)) + "], lambda x: x IS NOT NULL)"


@query(
    f"WITH f AS (SELECT doc_id, {_FOUND} AS families FROM documents), n AS (SELECT doc_id, {_pool_sql()} AS names FROM f), "
    "u AS (SELECT doc_id, unnest(names) AS name, generate_subscripts(names, 1) AS pos FROM n), d AS (SELECT doc_id, name, min(pos) AS pos FROM u GROUP BY doc_id, name), "
    "k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS k FROM d) "
    "SELECT doc_id, string_agg(name, ',' ORDER BY pos) AS pool FROM k WHERE k <= CASE WHEN doc_id % 3 = 0 THEN 14 ELSE 12 END GROUP BY doc_id"
)
def x6_action_pool(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", X.families(F.col("text"), FAMILIES).alias("families"))
    pool = S.action_pool(F.col("families"), F.col("doc_id") % 2 == 0, F.col("doc_id") % 3 == 0)
    return docs.select("doc_id", F.array_join(pool, ",").alias("pool"))
