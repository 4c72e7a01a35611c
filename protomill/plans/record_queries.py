"""Queries of record operators: gates, deduplication, reports, upserts, unions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from protomill.functions import text as X
from protomill.operators import records as R
from protomill.plans.registry import query, table
from protomill.sources import files


def raw_records(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with the counts that gates look at, derived from their ids and lines."""
    d = F.col("doc_id")
    return table(spark, sf, "documents").select(
        "doc_id",
        "source",
        (d % 9).alias("n_reagents"),
        (d % 3).alias("n_equipment"),
        F.size(F.split("text", "\n")).cast("bigint").alias("n_steps"),
        (d % 2).alias("n_troubleshooting"),
        F.col("text").alias("materials_raw"),
        F.when(d % 11 == 0, "").otherwise(F.col("source")).alias("title"),
        F.when(d % 4 == 0, "").otherwise("10.1/x").alias("doi"),
        F.lit("").alias("pmcid"),
        F.when(d % 5 == 0, "1 h").otherwise("").alias("timing"),
        F.lit("a").alias("abstract"),
    )


RAW = """raw AS (SELECT doc_id, source, doc_id % 9 AS n_reagents, doc_id % 3 AS n_equipment, len(string_split(text, chr(10))) AS n_steps, doc_id % 2 AS n_troubleshooting,
 text AS materials_raw, CASE WHEN doc_id % 11 = 0 THEN '' ELSE source END AS title, CASE WHEN doc_id % 4 = 0 THEN '' ELSE '10.1/x' END AS doi, CASE WHEN doc_id % 5 = 0 THEN '1 h' ELSE '' END AS timing FROM documents),
gated AS (SELECT *, concat_ws(',', CASE WHEN n_reagents < 3 THEN 'reagents_lt_min' END, CASE WHEN n_equipment < 1 AND length(materials_raw) < 150 THEN 'materials_thin' END,
 CASE WHEN n_steps < 3 THEN 'steps_lt_min' END, CASE WHEN title = '' THEN 'no_title' END, CASE WHEN doi = '' THEN 'no_id' END) AS flags,
 n_reagents >= 3 AND (n_equipment >= 1 OR length(materials_raw) >= 150) AND n_steps >= 3 AND title <> '' AS qc_pass,
 CAST(round(0.3 * least(n_reagents / 10, 1) + 0.2 * least(n_equipment / 3, 1) + 0.3 * least(n_steps / 20, 1) + CASE WHEN n_troubleshooting > 0 THEN 0.1 ELSE 0 END
 + CASE WHEN timing <> '' THEN 0.05 ELSE 0 END + 0.05, 3) AS DOUBLE) AS qc_score FROM raw)"""


@query(f"WITH {RAW} SELECT doc_id, qc_pass, qc_score, flags FROM gated")
def f1_quality_gate(spark: SparkSession, sf: str) -> DataFrame:
    return R.quality_gate(raw_records(spark, sf)).select("doc_id", "qc_pass", "qc_score", F.array_join("qc_flags", ",").alias("flags"))


def _min_rows(spark: SparkSession, sf: str) -> DataFrame:
    d = F.col("doc_id")
    return table(spark, sf, "documents").select(
        "doc_id",
        F.when(d % 17 == 0, "").otherwise(F.concat(F.col("source"), F.lit(":"), (d % 300).cast("string"))).alias("id"),
        F.when(d % 13 == 0, "").otherwise("t").alias("title"),
        F.lit("b").alias("background"),
        (d % 40).alias("n_reagents"),
        (d % 9).alias("n_equipment"),
        F.size(F.split("text", "\n")).alias("n_steps"),
        (d % 8).alias("n_stages"),
    )


MIN = """m AS (SELECT doc_id, CASE WHEN doc_id % 17 = 0 THEN '' ELSE source || ':' || doc_id % 300 END AS id, CASE WHEN doc_id % 13 = 0 THEN '' ELSE 't' END AS title,
 doc_id % 40 AS n_reagents, doc_id % 9 AS n_equipment, len(string_split(text, chr(10))) AS n_steps, doc_id % 8 AS n_stages FROM documents),
ok AS (SELECT *, id <> '' AND title <> '' AND n_reagents >= 5 AND n_equipment >= 2 AND n_steps >= 2 AND n_stages >= 3 AS fine FROM m),
seen AS (SELECT *, coalesce(bool_or(fine) OVER (PARTITION BY id ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS dup FROM ok),
judged AS (SELECT doc_id, id, split_part(id, ':', 1) AS source, n_stages, concat_ws(',', CASE WHEN id = '' THEN 'empty_id' END, CASE WHEN id <> '' AND dup THEN 'duplicate_id' END, CASE WHEN title = '' THEN 'empty_title' END,
 CASE WHEN n_reagents < 5 THEN 'reagents' END, CASE WHEN n_equipment < 2 THEN 'equipment' END, CASE WHEN n_steps < 2 THEN 'steps' END, CASE WHEN n_stages < 3 THEN 'unique_stages' END) AS reasons FROM seen)"""


def _judged(spark: SparkSession, sf: str) -> DataFrame:
    return R.minimal_gate(_min_rows(spark, sf), [F.col("doc_id")], min_steps=2)


@query(f"WITH {MIN} SELECT doc_id, reasons FROM judged")
def f2_minimal_gate(spark: SparkSession, sf: str) -> DataFrame:
    return _judged(spark, sf).select("doc_id", F.array_join("reasons", ",").alias("reasons"))


@query(f"WITH {MIN} SELECT reason, count(*) AS n FROM (SELECT unnest(string_split(reasons, ',')) AS reason FROM judged WHERE reasons <> '') GROUP BY reason")
def a3_drop_reasons(spark: SparkSession, sf: str) -> DataFrame:
    return R.reason_counts(_judged(spark, sf))


@query(f"WITH {MIN} SELECT CASE WHEN source = '' THEN 'unknown' ELSE source END AS source, count(*) FILTER (reasons = '') AS kept, count(*) FILTER (reasons <> '') AS dropped, round(avg(n_stages), 2) AS mean_stages FROM judged GROUP BY 1")
def k2_keep_report(spark: SparkSession, sf: str) -> DataFrame:
    none = F.size("reasons") == 0
    rows = _judged(spark, sf).withColumn("source", X.source_of_id(F.col("id")))
    return rows.groupBy("source").agg(F.count_if(none).alias("kept"), F.count_if(~none).alias("dropped"), F.round(F.avg("n_stages"), 2).alias("mean_stages"))


@query("SELECT doc_id, source || ':' || CASE WHEN doc_id % 2 = 0 THEN 'PMC' || doc_id ELSE '10.1/' || doc_id END AS id, coalesce(nullif(lang, 'en'), 'unknown') AS license FROM documents")
def p24_typed_record(spark: SparkSession, sf: str) -> DataFrame:
    d = F.col("doc_id")
    pmcid = F.when(d % 2 == 0, F.concat(F.lit("PMC"), d)).otherwise(F.lit(""))
    key = R.record_id(F.col("source"), pmcid, F.concat(F.lit("10.1/"), d))
    rows = table(spark, sf, "documents").select("doc_id", key.alias("id"), F.nullif("lang", F.lit("en")).alias("license"))
    return R.with_defaults(rows, license="unknown")


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_name ELSE p_type END AS background, p_brand || '/' || p_name AS first_reagent, p_size % 2 AS n_troubleshooting FROM part")
def p25_minimal_record(spark: SparkSession, sf: str) -> DataFrame:
    size = F.col("p_size")
    abstract = F.when(size % 3 == 0, "").otherwise(F.col("p_type"))
    rows = table(spark, sf, "part").select(
        "p_partkey",
        F.col("p_name").alias("title"),
        abstract.alias("abstract"),
        F.array(F.struct(F.col("p_brand").alias("name"), F.col("p_name").alias("catalog_id"))).alias("reagents"),
        F.array(F.struct(F.col("p_type").alias("name"), F.col("p_brand").alias("model"))).alias("equipment"),
        F.array(F.struct(F.when(size % 2 == 1, "p").otherwise("").alias("problem"), F.lit("").alias("solution"))).alias("troubleshooting"),
    )
    made = R.minimal_record(rows)
    first = F.get(F.col("materials.reagents"), 0)
    return made.select("p_partkey", "background", F.concat_ws("/", first["name"], first["identifier"]).alias("first_reagent"), F.size("procedure.troubleshooting").alias("n_troubleshooting"))


@query(
    "SELECT p_partkey, p_name FROM (SELECT *, row_number() OVER (PARTITION BY p_size % 5, lower(p_type), lower(p_brand), lower(p_brand) ORDER BY p_partkey) AS k FROM part) WHERE k = 1"
)
def a12_dedupe_items(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "part").withColumn("doc", F.col("p_size") % 5)
    return R.dedupe_items(rows, "doc", "p_partkey", "p_type", "p_brand", "p_brand").select("p_partkey", "p_name")


@query("SELECT source, count(*) FILTER (quality = 1) AS passed, count(*) FILTER (quality = 0) AS failed, count(*) AS total FROM labels JOIN documents USING (doc_id) GROUP BY source")
def a1_pass_counts(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "source"), "doc_id")
    good = F.col("quality") == 1
    return rows.groupBy("source").agg(F.count_if(good).alias("passed"), F.count_if(~good).alias("failed"), F.count("*").alias("total"))


@query(
    "WITH r AS (SELECT l_returnflag, list_sort(list(CAST(l_quantity AS INT))) AS q, list_sort(list(CAST(l_linenumber AS INT))) AS n FROM lineitem GROUP BY l_returnflag) "
    "SELECT l_returnflag, q[len(q) // 2 + 1] AS median_quantity, n[len(n) // 2 + 1] AS median_line FROM r"
)
def a2_upper_medians(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select("l_returnflag", F.col("l_quantity").cast("int").alias("quantity"), F.col("l_linenumber").cast("int").alias("line"))
    return R.upper_medians(rows, "l_returnflag", ["quantity", "line"])


@query(
    f"WITH {RAW}, f AS (SELECT source, unnest(string_split(flags, ',')) AS flag FROM gated WHERE flags <> ''), c AS (SELECT source, flag, count(*) AS n FROM f GROUP BY 1, 2), "
    "k AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, flag) AS k FROM c) SELECT source, flag, n FROM k WHERE k <= 3"
)
def a2_top_flags(spark: SparkSession, sf: str) -> DataFrame:
    from protomill.operators.steps import top_per_group

    flags = R.quality_gate(raw_records(spark, sf)).select("source", F.explode("qc_flags").alias("flag")).groupBy("source", "flag").agg(F.count("*").alias("n"))
    return top_per_group(flags, "source", [F.desc("n"), F.col("flag")], 3)


@query(f"WITH {RAW} SELECT CAST(floor(qc_score * 10) AS INT) AS tenth, count(*) AS n FROM gated GROUP BY 1")
def a14_score_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return R.score_tenths(R.quality_gate(raw_records(spark, sf)), "qc_score")


@query(
    "SELECT CASE WHEN text LIKE '%CC BY-NC%' THEN 'BY-NC' WHEN text LIKE '%CC BY%' THEN 'BY' WHEN text LIKE '%Apache License%' OR text LIKE '%MIT License%' THEN 'other' ELSE 'unknown' END AS bucket, count(*) AS n FROM documents GROUP BY 1"
)
def a14_license_buckets(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").groupBy(R.license_bucket(F.col("text")).alias("bucket")).agg(F.count("*").alias("n"))


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY event_type")
def a15_distribution(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))


@query("SELECT count(DISTINCT source) AS sources, count(DISTINCT lang) AS langs FROM documents")
def a11_distinct_counts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").agg(F.count_distinct("source").alias("sources"), F.count_distinct("lang").alias("langs"))


@query("SELECT user_id, max(n) AS most, string_agg(event_type, ',' ORDER BY event_type) FILTER (n >= 2) AS repeated FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY user_id")
def a10_action_counts(spark: SparkSession, sf: str) -> DataFrame:
    counted = R.action_counts(table(spark, sf, "events"), "user_id", "event_type")
    return counted.select("user_id", "most", F.nullif(F.array_join("repeated", ","), F.lit("")).alias("repeated"))


@query(
    "WITH a AS (SELECT source, doc_id % 5 = 0 AS skipped, doc_id % 7 = 0 AS bad, quality = 1 AS ok FROM documents JOIN labels USING (doc_id)) "
    "SELECT source, count(*) FILTER (skipped) AS skipped, count(*) FILTER (NOT skipped) AS fetched, count(*) FILTER (NOT skipped AND bad) AS errors, "
    "count(*) FILTER (NOT skipped AND NOT bad) AS parsed, count(*) FILTER (NOT skipped AND NOT bad AND ok) AS passed, count(*) FILTER (NOT skipped AND NOT bad AND NOT ok) AS failed FROM a GROUP BY source"
)
def a5_run_counters(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").select("doc_id", "source").join(table(spark, sf, "labels"), "doc_id")
    attempts = rows.select("source", (F.col("doc_id") % 5 == 0).alias("skipped"), F.when(F.col("doc_id") % 7 == 0, "timeout").alias("error"), (F.col("quality") == 1).alias("qc_pass"))
    return R.run_counters(attempts, "source")


@query("SELECT lang, count(*) AS n, count(*) FILTER (n_chars > 2000) AS long_ones FROM documents GROUP BY lang")
def a13_counts_by_project(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.col("n_chars") > 2000).alias("long_ones"))


@query(
    "SELECT doc_id, md5(text) AS digest FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS k FROM documents WHERE n_chars >= 100) WHERE k = 1"
)
def w8_first_wins(spark: SparkSession, sf: str) -> DataFrame:
    """The first document of each text among those that are long enough.

    Keyed by a digest of the text, so the shuffle carries 16 bytes for each row instead of the text.
    """
    rows = table(spark, sf, "documents").where("n_chars >= 100").select("doc_id", F.md5("text").alias("digest"))
    return rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id"))


@query("SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1")
def w8_last_wins(spark: SparkSession, sf: str) -> DataFrame:
    return R.latest(table(spark, sf, "events"), "user_id", [F.col("ts"), F.col("event_id")]).select("user_id", "event_id", "value")


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def j6_resume(spark: SparkSession, sf: str) -> DataFrame:
    done = table(spark, sf, "labels").withColumn("answer", F.when(F.col("quality") == 1, F.lit("A")))
    return R.pending(table(spark, sf, "documents"), done, "doc_id", "answer", [F.col("toxic")]).select("doc_id", "source")


@query("SELECT doc_id FROM documents WHERE doc_id IS NOT NULL AND lang <> 'de' AND doc_id NOT IN (SELECT doc_id FROM labels)")
def f3_skip_seen(spark: SparkSession, sf: str) -> DataFrame:
    return R.unseen(table(spark, sf, "documents").where("lang <> 'de'"), table(spark, sf, "labels"), "doc_id").select("doc_id")


@query("SELECT count(*) FILTER (quality = 1) AS valid, count(*) FILTER (quality <> 1) AS again FROM labels")
def f16_valid_cache(spark: SparkSession, sf: str) -> DataFrame:
    answer = F.when(F.col("quality") == 1, F.lit("A"))
    return R.cache_counts(table(spark, sf, "labels").select(answer.alias("answer")), "answer")


@query(
    "SELECT o.o_orderkey, CASE WHEN u.k IS NOT NULL THEN 'X' ELSE o.o_orderstatus END AS o_orderstatus, CASE WHEN u.k IS NOT NULL THEN u.total ELSE o.o_totalprice END AS o_totalprice "
    "FROM orders o LEFT JOIN (SELECT l_orderkey AS k, round(sum(l_extendedprice), 2) AS total FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) u ON o.o_orderkey = u.k"
)
def j7_upsert(spark: SparkSession, sf: str) -> DataFrame:
    changes = table(spark, sf, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("o_orderkey"))
    changes = changes.agg(F.round(F.sum("l_extendedprice"), 2).alias("o_totalprice"), F.lit("X").alias("o_orderstatus"))
    return R.upsert(table(spark, sf, "orders"), changes, "o_orderkey", ["o_orderstatus", "o_totalprice"]).select("o_orderkey", "o_orderstatus", "o_totalprice")


@query("SELECT c_custkey AS k, c_name AS name, 'customer' AS kind FROM customer UNION ALL SELECT s_suppkey, s_name, 'supplier' FROM supplier")
def x1_union(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.lit("customer").alias("kind"))
    s = table(spark, sf, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_name").alias("name"), F.col("s_suppkey").alias("k"))
    return c.unionByName(s)


@query(
    "WITH w AS (SELECT p_partkey, string_split(p_name, ' ') AS a, string_split(lower(p_type), ' ') AS b FROM part) "
    "SELECT p_partkey, len(list_distinct(list_concat(a, b))) AS n_union, len(list_intersect(a, b)) AS n_both, len(list_filter(list_distinct(a), lambda x: NOT list_contains(b, x))) AS n_only FROM w"
)
def x2_key_sets(spark: SparkSession, sf: str) -> DataFrame:
    a, b = F.split("p_name", " "), F.split(F.lower("p_type"), " ")
    return table(spark, sf, "part").select(
        "p_partkey", F.size(F.array_union(a, b)).alias("n_union"), F.size(F.array_intersect(a, b)).alias("n_both"), F.size(F.array_except(a, b)).alias("n_only")
    )


@query("SELECT doc_id, CASE WHEN quality = 1 THEN 'parsed' WHEN doc_id % 3 = 0 THEN 'parsed' ELSE 'rejected' END AS place FROM labels")
def x3_promote(spark: SparkSession, sf: str) -> DataFrame:
    from protomill.streaming.ingest import promote

    rows = table(spark, sf, "labels").select("doc_id", (F.col("quality") == 1).alias("qc_pass"))
    again = rows.where("not qc_pass and doc_id % 2 = 1 or not qc_pass and doc_id % 3 = 0").withColumn("qc_pass", F.col("doc_id") % 3 == 0)
    passed, stays = promote(rows.where("not qc_pass"), again, "doc_id")
    parsed = rows.where("qc_pass").unionByName(passed)
    return parsed.select("doc_id", F.lit("parsed").alias("place")).union(stays.select("doc_id", F.lit("rejected")))


@query(
    "WITH t AS (SELECT p_partkey, [lower(p_name), lower(p_brand), replace(replace(lower(p_type), ' ', '_'), '_', ' ')] || string_split(replace(lower(p_type), ' ', '_'), '_') AS raw FROM part), "
    "k AS (SELECT p_partkey, list_transform(raw, lambda x: trim(regexp_replace(x, '[^a-z0-9]+', ' ', 'g'))) AS keys FROM t), u AS (SELECT p_partkey, unnest(keys) AS term, generate_subscripts(keys, 1) AS pos FROM k), "
    "d AS (SELECT p_partkey, term, min(pos) AS pos FROM u WHERE length(term) >= 4 OR term = 'pcr' GROUP BY 1, 2) SELECT p_partkey, string_agg(term, '|' ORDER BY pos) AS terms FROM d GROUP BY 1"
)
def x4_search_terms(spark: SparkSession, sf: str) -> DataFrame:
    terms = X.search_terms(F.array("p_name"), F.col("p_brand"), F.replace(F.lower("p_type"), F.lit(" "), F.lit("_")))
    return table(spark, sf, "part").select("p_partkey", F.nullif(F.array_join(terms, "|"), F.lit("")).alias("terms")).where("terms is not null")


@query(
    "WITH have AS (SELECT doc_id, lower(source) AS name FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, lang FROM documents WHERE doc_id % 4 = 0 UNION ALL SELECT doc_id, 'third' FROM documents WHERE doc_id % 8 = 0), "
    "mined AS (SELECT doc_id, 'EN' AS name FROM documents UNION ALL SELECT doc_id, 'extra' FROM documents), full_ones AS (SELECT doc_id FROM have GROUP BY 1 HAVING count(*) >= 3) "
    "SELECT doc_id, name FROM have UNION ALL SELECT doc_id, name FROM mined m WHERE doc_id NOT IN (SELECT doc_id FROM full_ones) AND NOT EXISTS (SELECT 1 FROM have h WHERE h.doc_id = m.doc_id AND lower(h.name) = lower(m.name))"
)
def x5_fallback_union(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    have = d.where("doc_id % 2 = 0").select("doc_id", F.lower("source").alias("name")).union(d.where("doc_id % 4 = 0").select("doc_id", "lang")).union(d.where("doc_id % 8 = 0").select("doc_id", F.lit("third")))
    mined = d.select("doc_id", F.explode(F.array(F.lit("EN"), F.lit("extra"))).alias("name"))
    return R.add_missing(have, mined, "doc_id", 3)


@query("SELECT doc_id, source, lang FROM documents")
def s1_strict_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Documents written as JSON lines, with blank lines between, and read back with an explicit schema."""
    folder = files.shared_folder(spark, "lines")
    line = F.to_json(F.struct("doc_id", "source", "lang"))
    table(spark, sf, "documents").select(F.concat(line, F.lit("\n")).alias("value")).write.text(folder)
    return files.strict_lines(spark, folder, "doc_id bigint, source string, lang string")


@query("SELECT doc_id FROM documents WHERE doc_id % 10 <> 0")
def s2_tolerant_lines(spark: SparkSession, sf: str) -> DataFrame:
    line = F.to_json(F.struct("doc_id", "source"))
    broken = F.when(F.col("doc_id") % 10 == 0, F.left(line, F.length(line) - 3)).otherwise(line)
    folder = files.shared_folder(spark, "lines")
    table(spark, sf, "documents").select(broken.alias("value")).write.text(folder)
    return files.tolerant_lines(spark, folder, "doc_id bigint, source string").select("doc_id")


@query("SELECT doc_id FROM documents WHERE doc_id % 10 = 0")
def s2_bad_lines(spark: SparkSession, sf: str) -> DataFrame:
    """The lines that the tolerant scan leaves out, by the id that they start with."""
    line = F.to_json(F.struct("doc_id", "source"))
    broken = F.when(F.col("doc_id") % 10 == 0, F.left(line, F.length(line) - 3)).otherwise(line)
    folder = files.shared_folder(spark, "lines")
    table(spark, sf, "documents").select(broken.alias("value")).write.text(folder)
    bad = files.bad_lines(spark, folder, "doc_id bigint, source string")
    return bad.select(F.regexp_extract("_corrupt_record", r"^\{\"doc_id\":(\d+)", 1).cast("bigint").alias("doc_id"))


@query("SELECT source, quality = 1 AS qc_pass, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY 1, 2")
def k1_routed_save(spark: SparkSession, sf: str) -> DataFrame:
    """Rows saved by the router, counted by the folders that they are read back from."""
    rows = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "source"), "doc_id")
    folder = files.shared_folder(spark, "routed")
    files.save_routed(rows.select("doc_id", "source", (F.col("quality") == 1).alias("qc_pass")), folder, ["doc_id", "source", "qc_pass"])
    saved = spark.read.schema("doc_id bigint, source string, qc_pass boolean").json(f"{folder}/records")
    return saved.groupBy("source", "qc_pass").agg(F.count("*").alias("n"))


@query("SELECT user_id, string_agg(event_type || '=' || n, ',' ORDER BY event_type) AS views FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY 1")
def k8_view_map(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    made = F.map_from_entries(F.array_sort(F.collect_list(F.struct("event_type", "n"))))
    pairs = F.transform(F.map_entries("views"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))
    return n.groupBy("user_id").agg(made.alias("views")).select("user_id", F.array_join(pairs, ",").alias("views"))
