"""Queries of the remaining operators: parsers by source, reply contents, alignment, stored outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from protomill.functions import programs as P
from protomill.functions import text as X
from protomill.operators import compare as C
from protomill.operators import records as R
from protomill.plans.metric_queries import programs
from protomill.plans.registry import query, table
from protomill.sources.files import entry_views
from protomill.streaming.ingest import call_all


@query("SELECT doc_id, source || chr(10) || lang AS said FROM documents")
def c11_message_text(spark: SparkSession, sf: str) -> DataFrame:
    """A list of parts, of which those with text count, as one text."""
    parts = F.to_json(F.array(F.create_map(F.lit("text"), F.col("source")), F.create_map(F.lit("image"), F.lit("x.png")), F.create_map(F.lit("text"), F.col("lang"))))
    said = F.transform(F.from_json(parts, "array<map<string,string>>"), lambda p: F.try_element_at(p, F.lit("text")))
    return table(spark, sf, "documents").select("doc_id", F.array_join(F.filter(said, lambda t: F.trim(t) != ""), "\n").alias("said"))


_CODE = "'v = mix(sample=tube, times=[' || array_to_string(regexp_extract_all(CAST(n_chars AS VARCHAR) || CAST(doc_id AS VARCHAR), '\\d'), ', ') || '])'"


@query(f"SELECT doc_id, len(regexp_extract_all({_CODE}, '\\d')) AS literals FROM documents")
def c20_numeric_literals(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers of a program whose list holds the digits of a document's length and id."""
    digits = F.regexp_extract_all(F.concat(F.col("n_chars").cast("string"), F.col("doc_id").cast("string")), F.lit(r"\d"), F.lit(0))
    code = F.concat(F.lit("v = mix(sample=tube, times=["), F.array_join(digits, ", "), F.lit("])"))
    return table(spark, sf, "documents").select("doc_id", code.alias("code")).select("doc_id", P.numeric_literals("code").alias("literals"))


def _scores(spark: SparkSession, sf: str) -> DataFrame:
    rows = programs(spark, sf).select("doc_id", P.parse_program("gold").alias("g"), P.parse_program(P.extract_program("pred")).alias("p"))
    return rows.select("doc_id", C.scores(F.col("g"), F.col("p"), F.array(F.lit("tube"))).alias("s"))


@query("SELECT doc_id, CASE doc_id % 5 WHEN 1 THEN 2 WHEN 4 THEN 0 ELSE 3 END AS aligned FROM documents")
def j9_alignment(spark: SparkSession, sf: str) -> DataFrame:
    return _scores(spark, sf).select("doc_id", F.col("s.aligned").alias("aligned"))


@query("SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 1.0 WHEN 1 THEN 0.666667 WHEN 2 THEN 0.666667 WHEN 3 THEN 1.0 ELSE 0.0 END AS parameters FROM documents")
def m3_strict_parameters(spark: SparkSession, sf: str) -> DataFrame:
    return _scores(spark, sf).select("doc_id", F.round("s.parameters", 6).alias("parameters"))


@query("SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 1.0 WHEN 1 THEN 0.666667 WHEN 2 THEN round(5 / 6, 6) WHEN 3 THEN 1.0 ELSE 0.0 END AS parameters FROM documents")
def m5_relaxed_parameters(spark: SparkSession, sf: str) -> DataFrame:
    return _scores(spark, sf).select("doc_id", F.round("s.relaxed_parameters", 6).alias("parameters"))


@query("SELECT source, count(*) AS full_rows, count(*) FILTER (quality = 1) AS slim_rows FROM documents JOIN labels USING (doc_id) GROUP BY source")
def k3_full_and_slim(spark: SparkSession, sf: str) -> DataFrame:
    """What the full and the slim output of one pass hold, from one scan."""
    both = table(spark, sf, "documents").select("doc_id", "source").join(table(spark, sf, "labels"), "doc_id")
    return both.groupBy("source").agg(F.count("*").alias("full_rows"), F.count_if(F.col("quality") == 1).alias("slim_rows"))


@query("SELECT user_id, count(*) AS saved, arg_max(event_id, struct_pack(ts := ts, id := event_id)) AS current FROM events GROUP BY user_id")
def k5_checkpoint_state(spark: SparkSession, sf: str) -> DataFrame:
    """The state that an append-only checkpoint amounts to: the last row of each key."""
    return R.checkpoint_state(table(spark, sf, "events"), "user_id", "event_id", ["ts", "event_id"])


@query("SELECT p_partkey AS entry_id, v.view AS view, p_name || '/' || v.view || '.png' AS path FROM part, (VALUES ('top'), ('left')) v(view)")
def s4_entry_views(spark: SparkSession, sf: str) -> DataFrame:
    path = lambda v: F.concat(F.col("p_name"), F.lit(f"/{v}.png"))
    views = F.create_map(F.lit("top"), path("top"), F.lit("left"), path("left"))
    manifest = table(spark, sf, "part").select(F.array(F.struct(F.col("p_partkey").alias("entry_id"), views.alias("views"))).alias("entries"))
    return entry_views(manifest)


@query("SELECT page_id, regexp_replace(lower(list_last(string_split(split_part(split_part(url, '#', 1), '?', 1), '/'))), '[^a-z0-9]+', '_', 'g') AS slug FROM pages")
def s15_listing_keys(spark: SparkSession, sf: str) -> DataFrame:
    bare = F.split_part(F.split_part("url", F.lit("#"), F.lit(1)), F.lit("?"), F.lit(1))
    return table(spark, sf, "pages").select("page_id", F.regexp_replace(F.lower(F.element_at(F.split(bare, "/"), -1)), "[^a-z0-9]+", "_").alias("slug"))


@query("SELECT doc_id, 3 AS parts, 'data:image/png;base64,' || base64(encode(source)) AS picture FROM documents")
def g2_solver_content(spark: SparkSession, sf: str) -> DataFrame:
    """A message of one text and two pictures."""
    text = F.struct(F.lit("text").alias("type"), X.compact(F.col("text"), 100).alias("value"))
    picture = lambda c: F.struct(F.lit("image").alias("type"), X.data_url(F.encode(c, "UTF-8"), F.lit("v.png")).alias("value"))
    content = F.array(text, picture("source"), picture("lang"))
    return table(spark, sf, "documents").select("doc_id", F.size(content).alias("parts"), F.get(content, 1)["value"].alias("picture"))


@query("SELECT doc_id, 'Goal: ' || source || chr(10) || 'Actions:' || chr(10) || '- add_reagent' || chr(10) || '- mix_sample' AS prompt FROM documents")
def g3_program_prompt(spark: SparkSession, sf: str) -> DataFrame:
    actions = F.array_join(F.transform(F.array(F.lit("add_reagent"), F.lit("mix_sample")), lambda a: F.concat(F.lit("- "), a)), "\n")
    return table(spark, sf, "documents").select("doc_id", F.concat_ws("\n", F.concat(F.lit("Goal: "), "source"), F.lit("Actions:"), actions).alias("prompt"))


@query("SELECT doc_id, count(*) AS options, count(*) FILTER (letter = 'J') AS none FROM (SELECT doc_id, unnest(string_split('A,B,C,D,E,F,G,H,I,J', ',')) AS letter FROM documents) GROUP BY doc_id")
def f10_question_fields(spark: SparkSession, sf: str) -> DataFrame:
    from protomill.plans.item_queries import options

    return options(spark, sf).groupBy("doc_id").agg(F.count("*").alias("options"), F.count_if(F.col("letter") == "J").alias("none"))


def _strict(text: str) -> str:
    """A stub model that fails on texts with a digit."""
    if any(c.isdigit() for c in text):
        raise ValueError("a digit")
    return f"{len(text)}"


@query("SELECT doc_id, CASE WHEN regexp_matches(text, '[0-9]') THEN 'ValueError: a digit' ELSE CAST(length(text) AS VARCHAR) END AS outcome FROM documents")
def t5_failure_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Calls of which some fail, kept as rows with a reason and no result."""
    called = call_all(table(spark, sf, "documents").select("doc_id", "text"), "text", _strict, "record", tries=1)
    return called.select("doc_id", F.coalesce("error", "reply").alias("outcome"))


@query("SELECT user_id AS id, count(*) AS lines FROM events WHERE event_id % 2 = 0 GROUP BY user_id UNION ALL SELECT user_id, 0 FROM events GROUP BY user_id HAVING count(*) FILTER (event_id % 2 = 0) = 0")
def t2_overlapping_shards(spark: SparkSession, sf: str) -> DataFrame:
    """Two shards of users that overlap, saved one after the other: each user once, with the lines of the first shard that has them."""
    from protomill.sources.files import shared_folder
    from protomill.sources.manifest import Manifest

    events = table(spark, sf, "events")
    m = Manifest(spark, shared_folder(spark, "manifest"), "id")
    m.save(events.where("event_id % 2 = 0").groupBy(F.col("user_id").alias("id")).agg(F.count("*").alias("lines")))
    m.save(events.groupBy(F.col("user_id").alias("id")).agg(F.lit(0).cast("long").alias("lines")))
    return m.rows()


@query("SELECT DISTINCT source AS key, 'text of ' || source AS text FROM documents")
def s7_read_through(spark: SparkSession, sf: str) -> DataFrame:
    """Texts of all sources through a cache: the first read stores half of them, the second fetches the rest."""
    from protomill.sources.files import shared_folder
    from protomill.sources.manifest import read_through

    docs, folder = table(spark, sf, "documents").select(F.col("source").alias("key")), shared_folder(spark, "cache")
    fetch = lambda key: f"text of {key}"
    read_through(docs.where("key < 'src5'"), "key", folder, fetch)
    return read_through(docs, "key", folder, fetch)


@query("SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k FROM events) WHERE k = 1")
def t1_idempotent_ingest(spark: SparkSession, sf: str) -> DataFrame:
    from protomill.operators.steps import first_wins

    return first_wins(table(spark, sf, "events"), [F.col("user_id"), F.col("event_type")], [F.col("ts"), F.col("event_id")]).select("user_id", "event_type", "event_id")
