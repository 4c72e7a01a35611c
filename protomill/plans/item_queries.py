"""Queries of work items: validators, assignment, prompts, and model calls with a stub."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from protomill.functions import fixed_values as V
from protomill.functions import programs as P
from protomill.functions import text as X
from protomill.operators import items as I
from protomill.plans.registry import query, table
from protomill.streaming.ingest import call_model

CUES = ["asset function", "container capacity", "gentle handling", "tion the"]
_KEY = "trim(regexp_replace(lower(q), '[^a-z0-9]+', ' ', 'g'))"


@query(
    "WITH s AS (SELECT doc_id, lower(source) AS term, CASE WHEN doc_id % 3 = 0 THEN 'After 10 min at 2-3 h ' ELSE 'Once ' END || text || CASE WHEN doc_id % 4 = 0 THEN ' ' || source ELSE '' END AS q FROM documents), "
    f"k AS (SELECT *, {_KEY} AS key, len(regexp_extract_all(q, '\\b\\d+(?:\\.\\d+)?(?:[–-]\\d+(?:\\.\\d+)?)?\\b')) AS numbers FROM s) "
    "SELECT doc_id, concat_ws(',', CASE WHEN contains(key, term) THEN 'leaks_identity' END, CASE WHEN " + " OR ".join(f"contains(key, '{c}')" for c in CUES) + " THEN 'leaks_function' END, "
    "CASE WHEN numbers < 2 THEN 'few_numbers' END, CASE WHEN NOT (" + " OR ".join(f"contains(key, '{c}')" for c in ("already", "just", "after", "before", "previous", "prior", "then", "next")) + ") THEN 'no_sequence' END) AS reasons FROM k"
)
def f6_stem_validator(spark: SparkSession, sf: str) -> DataFrame:
    d = F.col("doc_id")
    q = F.concat(F.when(d % 3 == 0, "After 10 min at 2-3 h ").otherwise("Once "), F.col("text"), F.when(d % 4 == 0, F.concat(F.lit(" "), "source")).otherwise(""))
    return table(spark, sf, "documents").select("doc_id", F.array_join(I.stem_failures(q, F.array(F.lower("source")), CUES), ",").alias("reasons"))


@query(
    "SELECT doc_id, concat_ws(',', CASE WHEN doc_id % 6 = 1 THEN 'last_is_not_none' END, CASE WHEN doc_id % 6 = 2 THEN 'zero_argument' END, CASE WHEN doc_id % 6 = 3 THEN 'off_context' END, "
    "CASE WHEN doc_id % 6 = 4 THEN 'magnetic_holder' END, CASE WHEN doc_id % 6 = 5 THEN 'rack_as_tool' END) AS reasons FROM documents"
)
def f7_option_validator(spark: SparkSession, sf: str) -> DataFrame:
    way = F.col("doc_id") % 6
    pick = lambda *v: F.element_at(F.array(*[F.lit(x) for x in v]), (way + 1).cast("int"))
    letter = pick("J", "J", "A", "B", "C", "D")
    option = pick("none_of_the_above()", "mix_sample(times=1)", "mix_sample(duration_min=0, times=1)", "robot_arm(times=1)", "magnetic_hold(times=2)", "aspirate_sample(volume_ul=5)")
    function = F.regexp_extract(option, r"^(\w+)\(", 1)
    group = pick("beaker", "beaker", "beaker", "beaker", "tube_rack", "pipette_rack")
    return table(spark, sf, "documents").select("doc_id", F.array_join(I.option_failures(letter, option, function, F.lower("lang"), group), ",").alias("reasons"))


def options(spark: SparkSession, sf: str) -> DataFrame:
    """Ten options for each document; some sets are broken in one way."""
    d = F.col("doc_id")
    names = ["mix_sample", "heat_sample", "wash_sample"]
    rows = [F.struct(F.lit("ABCDEFGHI"[i]).alias("letter"), F.concat(F.lit(f"{names[i // 3]}(times="), (i % 3 + d % 7 + 1).cast("string"), F.lit(", tube='x')")).alias("option")) for i in range(9)]
    rows.append(F.struct(F.lit("J").alias("letter"), F.lit("none_of_the_above()").alias("option")))
    each = table(spark, sf, "documents").select("doc_id", F.explode(F.array(*rows)).alias("o")).select("doc_id", "o.*")
    broken = (
        F.when((d % 5 == 1) & (F.col("letter") == "B"), F.regexp_replace("option", "mix_sample", "stir_sample"))
        .when((d % 5 == 2) & (F.col("letter") == "B"), F.regexp_replace("option", "tube=", "cup="))
        .when((d % 5 == 3) & (F.col("letter") == "B"), F.regexp_replace("option", "'x'", "'y'"))
        .when((d % 5 == 4) & (F.col("letter") == "B"), F.regexp_replace("option", r"times=\d+", F.concat(F.lit("times="), (d % 7 + 1).cast("string"))))
        .otherwise(F.col("option"))
    )
    return each.withColumn("option", broken).withColumn("answer", F.lit("A"))


@query(
    "SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'functions_differ' WHEN 2 THEN 'keywords_differ,not_one_change,not_a_number' WHEN 3 THEN 'not_one_change,not_a_number' ELSE 'repeated_options,not_one_change' END AS reasons FROM documents"
)
def f8_difficulty_structure(spark: SparkSession, sf: str) -> DataFrame:
    calls = options(spark, sf).withColumn("call", I.parse_call("option")).select("doc_id", "letter", "option", "answer", "call.*")
    return I.trio_failures(calls, "doc_id").select("doc_id", F.array_join("reasons", ",").alias("reasons"))


@query("SELECT doc_id, 10 AS distinct_options FROM documents")
def g5_repair_repeats(spark: SparkSession, sf: str) -> DataFrame:
    return I.repair_repeats(options(spark, sf), "doc_id").groupBy("doc_id").agg(F.count_distinct("option").alias("distinct_options"))


_FIRST = "(doc_id % 7 + 1)"


@query(
    "SELECT doc_id, k AS letter, CASE WHEN k = 'J' THEN 'none_of_the_above()' ELSE CASE WHEN k < 'D' THEN 'mix' WHEN k < 'G' THEN 'heat' ELSE 'wash' END || '_sample(times=' || "
    f"CASE WHEN k = 'B' AND doc_id % 5 <> 0 THEN CASE WHEN {_FIRST} > 1 THEN {_FIRST} - 1 ELSE {_FIRST} + 1 END ELSE {_FIRST} + (ascii(k) - 65) % 3 END || ', tube=''x'')' END AS option "
    "FROM (SELECT doc_id, unnest(string_split('A,B,C,D,E,F,G,H,I,J', ',')) AS k FROM documents)"
)
def g6_repair_family(spark: SparkSession, sf: str) -> DataFrame:
    return I.repair_family(options(spark, sf), "doc_id").select("doc_id", "letter", "option")


@query("SELECT o.doc_id, o.k AS letter, CASE WHEN o.k = 'J' THEN 'none_of_the_above' WHEN o.k < 'D' THEN CASE WHEN doc_id % 5 = 1 AND o.k = 'B' THEN 'stir_sample' ELSE 'mix_sample' END WHEN o.k < 'G' THEN 'heat_sample' ELSE 'wash_sample' END AS function FROM (SELECT doc_id, unnest(string_split('A,B,C,D,E,F,G,H,I,J', ',')) AS k FROM documents) o")
def u5_parse_calls(spark: SparkSession, sf: str) -> DataFrame:
    return options(spark, sf).select("doc_id", "letter", I.parse_call("option")["function"].alias("function"))


@query(
    "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'constraints,outside_pool' WHEN 2 THEN 'few_numbers,unknown_name' ELSE 'no_program' END AS reasons FROM documents"
)
def f12_task_validator(spark: SparkSession, sf: str) -> DataFrame:
    way = F.col("doc_id") % 4
    lines = [f"v{i} = {'mix' if i % 2 else 'wash'}(sample={'tube' if i == 0 else f'v{i - 1}'}, times={i})" for i in range(6)]
    good = "\n".join(lines)
    bare = "\n".join(f"v{i} = mix(sample={'cup' if i == 0 else f'v{i - 1}'})" for i in range(6))
    code = F.when(way == 2, bare).when(way == 3, "x +").otherwise(good)
    pool = F.when(way == 1, F.array(F.lit("mix"))).otherwise(F.array(F.lit("mix"), F.lit("wash")))
    rows = table(spark, sf, "documents").select(
        "doc_id",
        P.parse_program(code).alias("steps"),
        P.numeric_literals(code).alias("literals"),
        pool.alias("pool"),
        F.array(F.lit("tube"), F.lit("rack"), F.lit("tip")).alias("inputs"),
        F.when(way == 1, 2).otherwise(4).alias("n_constraints"),
    )
    rows = rows.withColumn("literals", F.when(F.col("steps").isNull(), F.lit(99)).otherwise(F.col("literals")))
    return I.task_failures(rows).select("doc_id", F.array_join("reasons", ",").alias("reasons"))


_GROUPS = "[" + ", ".join(f"'{g}'" for g in V.MATCH_GROUPS) + f"][p_partkey % {len(V.MATCH_GROUPS)} + 1]"
_ONE_OF = lambda names: "(" + ", ".join(f"'{n}'" for n in names) + ")"


@query(f"SELECT p_partkey, g AS group_id, CASE WHEN g IN {_ONE_OF(V.ACTIVE_DEVICES)} THEN 0 WHEN g IN {_ONE_OF(V.PASSIVE_CONTAINERS)} THEN 2 ELSE 1 END AS rank FROM (SELECT p_partkey, {_GROUPS} AS g FROM part)")
def o4_difficulty_order(spark: SparkSession, sf: str) -> DataFrame:
    """Each part with one of the groups, active devices first and passive containers last, in a seeded order within."""
    group = F.element_at(F.array(*[F.lit(g) for g in V.MATCH_GROUPS]), (F.col("p_partkey") % len(V.MATCH_GROUPS) + 1).cast("int"))
    rows = table(spark, sf, "part").select("p_partkey", group.alias("group_id"))
    return rows.select("p_partkey", "group_id", I.difficulty(F.col("group_id")).alias("rank")).orderBy("rank", F.xxhash64("p_partkey", F.lit(7)))


_PAIRS = "p AS (SELECT DISTINCT e, doc_id FROM (SELECT source AS e, doc_id FROM documents UNION ALL SELECT lang, doc_id FROM documents))"


@query(f"WITH {_PAIRS} SELECT e AS entry, least(count(*), 3) AS jobs, least(count(*), 3) AS distinct_items FROM p GROUP BY e")
def o5_assign_items(spark: SparkSession, sf: str) -> DataFrame:
    """Three rounds of jobs: sources and languages take documents, each one that nobody has had while there is one."""
    docs = table(spark, sf, "documents")
    pairs = docs.select(F.col("source").alias("entry"), "doc_id").unionByName(docs.select(F.col("lang").alias("entry"), "doc_id"))
    entries = pairs.select("entry").distinct().count()
    jobs = I.assign(pairs.withColumn("late", F.length("entry") == 2), "entry", "doc_id", 3 * entries, last="late", seed=7)
    return jobs.groupBy("entry").agg(F.count("*").alias("jobs"), F.count_distinct("doc_id").alias("distinct_items"))


@query()
def o6_some_views(spark: SparkSession, sf: str) -> DataFrame:
    views = F.create_map(*[x for v in ("front", "left", "top", "free") for x in (F.lit(v), F.lit(f"{v}.png"))])
    chosen = I.some_views(views, ["front", "right", "left", "top", "free", "back", "bottom"], seed=5)
    return table(spark, sf, "part").select("p_partkey", F.array_join(chosen, ",").alias("views"))


@query(
    "WITH n AS (SELECT count(*) AS n, greatest(1, CAST(round(count(*) * 0.2) AS BIGINT)) AS quota FROM documents), "
    "l AS (SELECT chr(65 + CAST(k AS INT)) AS letter, CASE WHEN k = 9 THEN quota ELSE (n - quota - k + 8) // 9 END AS items FROM n, range(10) r(k)) SELECT letter, items FROM l WHERE items > 0"
)
def o7_quota_letters(spark: SparkSession, sf: str) -> DataFrame:
    """How many documents get each letter: a fifth the last one, the others in turn."""
    dealt = I.quota_letters(table(spark, sf, "documents").select("doc_id"), "doc_id", seed=97)
    return dealt.groupBy("letter").agg(F.count("*").alias("items"))


@query("SELECT doc_id, 'Title: ' || source || chr(10) || 'Answer with one letter (' || CASE WHEN lang = 'en' THEN 'English' ELSE 'other' END || ').' || chr(10) || CASE WHEN length(trim(regexp_replace(text, '\\s+', ' ', 'g'))) > 60 THEN rtrim(trim(regexp_replace(text, '\\s+', ' ', 'g'))[1:59]) || '...' ELSE trim(regexp_replace(text, '\\s+', ' ', 'g')) END AS prompt FROM documents")
def g1_prompts(spark: SparkSession, sf: str) -> DataFrame:
    guard = F.when(F.col("lang") == "en", "English").otherwise("other")
    prompt = F.concat_ws("\n", F.concat(F.lit("Title: "), "source"), F.concat(F.lit("Answer with one letter ("), guard, F.lit(").")), X.compact(F.col("text"), 60))
    return table(spark, sf, "documents").select("doc_id", prompt.alias("prompt"))


def _even(prompt: str) -> str:
    """A stub model: answers by the prompt's length, and fails on long ones."""
    if len(prompt) > 120:
        raise TimeoutError("too long")
    return f"Final Answer: {'A' if len(prompt) % 2 == 0 else 'B'}"


@query("SELECT doc_id, CASE WHEN length(text) > 120 THEN NULL WHEN length(text) % 2 = 0 THEN 'A' ELSE 'B' END AS answer FROM documents")
def m9_evaluate_records(spark: SparkSession, sf: str) -> DataFrame:
    from protomill.functions.answers import answer_letter

    called = call_model(table(spark, sf, "documents").select("doc_id", "text"), "text", _even, tries=1)
    return called.select("doc_id", answer_letter(F.col("reply")).alias("answer"))


def _model(prompt: str) -> str:
    return "good" if "refused" in prompt else "bad"


def _validate(reply: str) -> str | None:
    return None if reply == "good" else "it is bad"


@query("SELECT doc_id, 'good' AS result, 2 AS tries FROM documents")
def g4_generate_with_feedback(spark: SparkSession, sf: str) -> DataFrame:
    return I.generate(table(spark, sf, "documents").select("doc_id", "source"), "source", _model, _validate).select("doc_id", "result", "tries")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1 AND toxic = 0)")
def g7_adversarial_rejection(spark: SparkSession, sf: str) -> DataFrame:
    solved = table(spark, sf, "labels").where("quality = 1 and toxic = 0")
    return table(spark, sf, "documents").join(solved, "doc_id", "left_anti").select("doc_id")
