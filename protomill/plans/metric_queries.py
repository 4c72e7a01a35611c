"""Queries of scores: answers, sequences, programs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from protomill.functions import programs as P
from protomill.operators import compare as C
from protomill.operators import metrics as M
from protomill.plans.registry import query, table


def answers(spark: SparkSession, sf: str) -> DataFrame:
    """Gold and predicted letters from the two labels; every seventh prediction is invalid."""
    letter = lambda c: F.when(F.col(c) == 1, "A").otherwise("B")
    pred = F.when(F.col("doc_id") % 7 != 0, letter("toxic"))
    return table(spark, sf, "labels").select("doc_id", letter("quality").alias("gold"), pred.alias("pred"), (F.col("doc_id") % 3).cast("string").alias("cost"), F.concat(F.lit("m"), F.col("doc_id") % 2).alias("model"))


_ANSWERS = "a AS (SELECT doc_id, CASE quality WHEN 1 THEN 'A' ELSE 'B' END AS gold, CASE WHEN doc_id % 7 <> 0 THEN CASE toxic WHEN 1 THEN 'A' ELSE 'B' END END AS pred FROM labels)"


@query(f"WITH {_ANSWERS} SELECT doc_id, gold IS NOT DISTINCT FROM pred AS correct FROM a")
def m1_answer_match(spark: SparkSession, sf: str) -> DataFrame:
    return answers(spark, sf).select("doc_id", F.col("pred").eqNullSafe(F.col("gold")).alias("correct"))


@query(
    f"WITH {_ANSWERS} SELECT count(*) AS count, count(*) FILTER (gold = pred) AS correct, count(*) FILTER (pred IS NULL) AS invalid, round(avg(CASE WHEN gold = pred THEN 1.0 ELSE 0 END), 6) AS accuracy, "
    "CAST(sum(doc_id % 3) AS DOUBLE) AS cost, string_agg(DISTINCT 'm' || doc_id % 2, ',' ORDER BY 'm' || doc_id % 2) AS models FROM a"
)
def a7_answer_summary(spark: SparkSession, sf: str) -> DataFrame:
    return M.answer_summary(answers(spark, sf), cost="cost", model="model").withColumn("accuracy", F.round("accuracy", 6))


@query("SELECT count(*) AS count, count(*) FILTER (l_linenumber > 5) AS invalid, round(avg(CASE WHEN l_linenumber > 5 THEN 0 ELSE l_discount END), 6) AS strict, round(avg(CASE WHEN l_linenumber > 5 THEN 0 ELSE l_tax END), 6) AS relaxed FROM lineitem")
def a8_mean_scores(spark: SparkSession, sf: str) -> DataFrame:
    keep = F.col("l_linenumber") <= 5
    rows = table(spark, sf, "lineitem").select(F.when(keep, F.col("l_discount").cast("double")).alias("strict"), F.when(keep, F.col("l_tax").cast("double")).alias("relaxed"))
    return M.mean_scores(rows, ["strict", "relaxed"]).select("count", "invalid", F.round("strict", 6).alias("strict"), F.round("relaxed", 6).alias("relaxed"))


def sequences(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Each user's events in the order of time, and in the order of value; some users lack their last one."""
    events = table(spark, sf, "events")
    gold = events.select("user_id", F.struct("ts", "event_id").alias("pos"), "event_type")
    pred = events.where("user_id % 5 <> 0 or event_id % 20 <> 0").select("user_id", F.struct("value", "event_id").alias("pos"), "event_type")
    return gold, pred


_SEQ = """e AS (SELECT * FROM events),
g AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k FROM e),
p AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) AS j, row_number() OVER (PARTITION BY user_id, event_type ORDER BY value, event_id) AS k FROM e WHERE user_id % 5 <> 0 OR event_id % 20 <> 0)"""


@query(
    f"WITH {_SEQ}, b AS (SELECT coalesce(g.user_id, p.user_id) AS user_id, i, j FROM g FULL JOIN p ON g.user_id = p.user_id AND g.event_type = p.event_type AND g.k = p.k), "
    "n AS (SELECT user_id, count(*) AS n, count(*) FILTER (i IS NULL OR j IS NULL) AS odd FROM b GROUP BY 1), v AS (SELECT x.user_id, count(*) AS inv FROM b x JOIN b y ON x.user_id = y.user_id AND x.i < y.i AND x.j > y.j GROUP BY 1) "
    "SELECT n.user_id, round(CASE WHEN odd > 0 THEN 0 WHEN n <= 1 THEN 1 ELSE 1 - coalesce(inv, 0) / (n * (n - 1) / 2) END, 6) AS similarity FROM n LEFT JOIN v USING (user_id)"
)
def m2_sequence_similarity(spark: SparkSession, sf: str) -> DataFrame:
    gold, pred = sequences(spark, sf)
    return M.sequence_similarity(gold, pred, "user_id", "pos", "event_type")


@query(
    f"WITH {_SEQ}, b AS (SELECT coalesce(g.user_id, p.user_id) AS user_id, g.event_type AS ge, p.event_type AS pe FROM g FULL JOIN p ON g.user_id = p.user_id AND g.i = p.j) "
    "SELECT user_id, round(count(*) FILTER (ge = pe) / greatest(count(*), 1), 6) AS similarity FROM b GROUP BY 1"
)
def m4_positional_similarity(spark: SparkSession, sf: str) -> DataFrame:
    gold, pred = sequences(spark, sf)
    return M.positional_similarity(gold, pred, "user_id", "pos", "event_type")


@query(
    "SELECT coalesce(a.conv_id, b.conv_id) AS conv_id, coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'extra' WHEN b.k IS NULL THEN 'missing' ELSE 'paired' END AS status FROM "
    "(SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations WHERE role = 'user') a FULL JOIN "
    "(SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations WHERE role = 'assistant') b ON a.conv_id = b.conv_id AND a.k = b.k"
)
def j8_positional_join(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    c = table(spark, sf, "conversations")
    k = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    side = lambda role, name: c.where(F.col("role") == role).select("conv_id", k.alias("k"), F.lit(True).alias(name))
    both = side("user", "a").join(side("assistant", "b"), ["conv_id", "k"], "full")
    return both.select("conv_id", "k", F.when(F.col("a").isNull(), "extra").when(F.col("b").isNull(), "missing").otherwise("paired").alias("status"))


@query("SELECT l_orderkey, l_linenumber, round((l_discount + l_tax) / 2, 6) AS final FROM lineitem")
def m6_final_scores(spark: SparkSession, sf: str) -> DataFrame:
    final = F.round((F.col("l_discount").cast("double") + F.col("l_tax").cast("double")) / 2, 6)
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", final.alias("final"))


@query("SELECT round(sum(turn % 2) / count(*), 6) AS step_accuracy FROM conversations")
def m7_step_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").agg(F.round(F.sum(F.col("turn") % 2) / F.count("*"), 6).alias("step_accuracy"))


@query("SELECT event_type, round(avg(CASE WHEN value > 50 THEN 1.0 ELSE 0 END), 6) AS rate, count(*) AS episodes FROM events GROUP BY event_type")
def m8_success_rates(spark: SparkSession, sf: str) -> DataFrame:
    rates = M.success_rates(table(spark, sf, "events").withColumn("won", F.col("value") > 50), "event_type", "won")
    return rates.withColumn("rate", F.round("rate", 6))


def programs(spark: SparkSession, sf: str) -> DataFrame:
    """A gold program for each document and a prediction that departs from it in one way or another."""
    d, way = F.col("doc_id"), F.col("doc_id") % 5
    n = (d % 20 + 1).cast("string")
    first = F.concat(F.lit("a = add_reagent(sample=tube, volume_ul="), n, F.lit(")\n"))
    second = F.lit("b = mix_sample(sample=a, speed=-5)\n")
    third = F.lit("c = wash_sample(sample=b, times=3)\n")
    gold = F.concat(first, second, third)
    pred = (
        F.when(way == 0, gold)
        .when(way == 1, F.concat(first, third.substr(F.lit(1), F.lit(4)), F.lit("mix_sample(sample=a, speed=-5)\n")))
        .when(way == 2, F.concat(F.lit("Here it is:\n```python\n"), F.replace(gold, F.lit("times=3"), F.lit("times=4")), F.lit("```")))
        .when(way == 3, F.concat(F.lit("x = add_reagent(sample=tube, volume_ul="), n, F.lit(".0)\ny = mix_sample(sample=x, speed=-5)\nz = wash_sample(sample=y, times=3)")))
        .otherwise(F.lit("I cannot do that"))
    )
    return table(spark, sf, "documents").select("doc_id", gold.alias("gold"), pred.alias("pred"))


@query("SELECT doc_id, 3 AS n_steps, 'add_reagent,mix_sample,wash_sample' AS actions, 4 AS literals FROM documents")
def u2_parse_programs(spark: SparkSession, sf: str) -> DataFrame:
    rows = programs(spark, sf).select("doc_id", P.parse_program("gold").alias("s"), P.numeric_literals("gold").alias("literals"))
    return rows.select("doc_id", F.size("s").alias("n_steps"), F.array_join(F.transform("s", lambda x: x["action"]), ",").alias("actions"), "literals")


@query("SELECT doc_id, doc_id % 5 <> 4 AS found FROM documents")
def u3_extract_programs(spark: SparkSession, sf: str) -> DataFrame:
    return programs(spark, sf).select("doc_id", P.extract_program("pred").isNotNull().alias("found"))


_WAYS = "(SELECT doc_id, doc_id % 5 AS way FROM documents)"


@query(
    "SELECT doc_id, CASE way WHEN 4 THEN 0 WHEN 1 THEN 0 ELSE 1 END AS sequence, round(CASE way WHEN 0 THEN 1 WHEN 3 THEN 1 WHEN 4 THEN 0 ELSE 2 / 3 END, 6) AS parameters, "
    "CASE way WHEN 1 THEN 2 WHEN 4 THEN 0 ELSE 3 END AS aligned, CASE way WHEN 2 THEN 1 WHEN 1 THEN 1 WHEN 4 THEN 3 ELSE 0 END AS errors, "
    f"CASE way WHEN 1 THEN 'missing_step' WHEN 2 THEN 'times:value:3!=4' WHEN 4 THEN 'missing_step;missing_step;missing_step' ELSE '' END AS told FROM {_WAYS}"
)
def u6_compare_programs(spark: SparkSession, sf: str) -> DataFrame:
    """All twelve results for each document's two programs; shown are scores, counts and the errors of the strict comparison."""
    rows = programs(spark, sf).select("doc_id", P.parse_program("gold").alias("g"), P.parse_program(P.extract_program("pred")).alias("p"))
    s = rows.select("doc_id", C.scores(F.col("g"), F.col("p"), F.array(F.lit("tube"))).alias("s"))
    told = F.array_join(F.flatten(F.transform("s.details", lambda d: d["errors"])), ";")
    return s.select("doc_id", "s.sequence", F.round("s.parameters", 6).alias("parameters"), "s.aligned", "s.errors", told.alias("told"))


@query("SELECT doc_id, k.key AS key, CASE k.key WHEN 'sample' THEN CASE WHEN s.step = 1 THEN 'raw_var' ELSE 'generated_var' END ELSE 'literal' END AS kind, s.step FROM documents, (VALUES (1), (2), (3)) s(step), (VALUES ('sample'), ('other')) k(key)")
def u4_classify_arguments(spark: SparkSession, sf: str) -> DataFrame:
    steps = programs(spark, sf).select("doc_id", P.parse_program("gold").alias("s"))
    outputs = F.transform("s", lambda x: x["output"])
    each = steps.select("doc_id", outputs.alias("outputs"), F.posexplode("s").alias("at", "x"))
    rows = each.select("doc_id", "outputs", "at", F.explode("x.inputs").alias("key", "a"))
    place = F.array_position("outputs", F.col("a.value"))
    kind = (
        F.when(F.col("a.kind") != "name", F.col("a.kind"))
        .when((place > 0) & (place <= F.col("at")), F.lit("generated_var"))
        .when(place > 0, F.lit("future_generated_var"))
        .when(F.col("a.value") == "tube", F.lit("raw_var"))
        .otherwise(F.lit("unknown_var"))
    )
    return rows.select("doc_id", F.when(F.col("key") == "sample", "sample").otherwise("other").alias("key"), kind.alias("kind"), (F.col("at") + 1).alias("step"))
