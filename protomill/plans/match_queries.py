"""Queries that match documents with catalogs, and joins of entries."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from protomill.functions import fixed_values as V
from protomill.functions import text as X
from protomill.operators import items as I
from protomill.operators import matching as M
from protomill.plans.registry import query, table

#: Groups of phrases from invented prose, which stand in for assets.
GROUPS = {
    "articles": ("the", "of the", "and the"),
    "endings": ("ing", "tion", "ed in"),
    "french": ("de la", "le", "que la"),
    "german": ("der", "und", "die"),
    "never": ("microcentrifuge tube", "pcr plate"),
}
VALUES = ", ".join(f"({i}, '{g}', '{a}')" for i, (g, al) in enumerate(GROUPS.items()) for a in al)
KEY = "trim(regexp_replace(translate(lower({0}), 'µμ', 'uu'), '[^a-z0-9]+', ' ', 'g'))"
MATCHED = f"""a(ord, group_id, alias) AS (VALUES {VALUES}), c AS (SELECT doc_id, ' ' || {KEY.format("text")} || ' ' AS corpus FROM documents),
matched AS (SELECT DISTINCT doc_id, group_id, ord FROM c, a WHERE contains(corpus, ' ' || alias || ' '))"""


def corpus(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", X.search_key(F.col("text")).alias("corpus"))


def matched(spark: SparkSession, sf: str) -> DataFrame:
    return M.match_aliases(corpus(spark, sf), M.alias_table(spark, GROUPS), "doc_id", "corpus")


@query(f"WITH {MATCHED} SELECT doc_id, group_id FROM matched")
def j2_alias_join(spark: SparkSession, sf: str) -> DataFrame:
    return matched(spark, sf)


@query(f"WITH {MATCHED} SELECT doc_id, group_id FROM matched")
def f5_whole_word_predicate(spark: SparkSession, sf: str) -> DataFrame:
    return corpus(spark, sf).select("doc_id", F.explode(M.groups_of(F.col("corpus"), GROUPS)).alias("group_id"))


@query(f"WITH {MATCHED} SELECT g.group_id, coalesce(n, 0) AS n FROM (SELECT DISTINCT group_id FROM a) g LEFT JOIN (SELECT group_id, count(*) AS n FROM matched GROUP BY 1) USING (group_id)")
def a4_group_counts(spark: SparkSession, sf: str) -> DataFrame:
    return M.group_counts(matched(spark, sf), M.alias_table(spark, GROUPS))


@query(
    f"WITH {MATCHED}, e AS (SELECT ord, group_id, group_id || '_' || k AS entry_id FROM (SELECT DISTINCT ord, group_id FROM a), range(2) t(k)), "
    "j AS (SELECT doc_id, m.ord, m.group_id, entry_id FROM matched m JOIN e USING (group_id)) "
    "SELECT doc_id, (SELECT string_agg(group_id, ',' ORDER BY ord) FROM matched x WHERE x.doc_id = j.doc_id) AS matched_groups, string_agg(entry_id, ',' ORDER BY ord, entry_id) AS candidates FROM j GROUP BY doc_id"
)
def j3_candidate_entries(spark: SparkSession, sf: str) -> DataFrame:
    rows = [(i, g, f"{g}_{k}") for i, g in enumerate(GROUPS) for k in range(2)]
    entries = spark.createDataFrame(rows, "ord int, group_id string, entry_id string")
    out = M.attach_entries(matched(spark, sf), entries, "doc_id")
    return out.select("doc_id", F.array_join("matched_groups", ",").alias("matched_groups"), F.array_join("candidate_entries", ",").alias("candidates"))


@query(f"SELECT doc_id, md5({KEY.format("source || ' ' || lang || ' ' || source || ' steps troubleshooting'")}) AS published, md5({KEY.format("source || ' ' || lang || ' ' || source || ' ' || text")}) AS intended FROM documents")
def p26_search_corpus(spark: SparkSession, sf: str) -> DataFrame:
    names = F.array("source")
    return table(spark, sf, "documents").select(
        "doc_id",
        F.md5(M.search_corpus(F.col("source"), F.col("lang"), names)).alias("published"),
        F.md5(M.search_corpus(F.col("source"), F.col("lang"), names, F.split("text", "\n"))).alias("intended"),
    )


@query("SELECT l.l_orderkey, l.l_linenumber, coalesce(p.p_name, 'unknown') AS name, coalesce(p.p_brand, l.l_shipinstruct_) AS brand FROM (SELECT *, l_returnflag AS l_shipinstruct_ FROM lineitem) l JOIN part p ON p.p_partkey = l.l_partkey WHERE p.p_size > 25")
def j1_entry_manifest_join(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part").where("p_size > 25").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_brand")
    joined = table(spark, sf, "lineitem").join(part, "l_partkey")
    return joined.select("l_orderkey", "l_linenumber", F.coalesce("p_name", F.lit("unknown")).alias("name"), F.coalesce("p_brand", "l_returnflag").alias("brand"))


@query("SELECT event_id, c_name FROM events JOIN customer ON c_custkey = user_id % 50 WHERE c_acctbal > 0")
def j4_unnest_lookup(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events").select("event_id", F.explode(F.array(F.col("user_id") % 50)).alias("c_custkey"))
    return events.join(table(spark, sf, "customer").where("c_acctbal > 0"), "c_custkey").select("event_id", "c_name")


@query("SELECT n_name, r_name FROM nation LEFT JOIN (SELECT * FROM region WHERE r_regionkey < 3) ON n_regionkey = r_regionkey")
def j11_optional_lookup(spark: SparkSession, sf: str) -> DataFrame:
    region = table(spark, sf, "region").where("r_regionkey < 3").select(F.col("r_regionkey").alias("n_regionkey"), "r_name")
    return table(spark, sf, "nation").join(region, "n_regionkey", "left").select("n_name", "r_name")


def _key(alias: str) -> str:
    return re.sub("[^a-z0-9]+", " ", alias.lower()).strip()


#: The real groups' normalised aliases as (number of the group, group, alias).
ALIASES = sorted({(i, g, _key(a)) for i, (g, al) in enumerate(V.MATCH_GROUPS.items()) for a in al})
_ALIASES = "a(ord, group_id, alias) AS (VALUES " + ", ".join(f"({i}, '{g}', '{a}')" for i, g, a in ALIASES) + ")"
_PHRASES = "[" + ", ".join(f"'{a}'" for _, _, a in ALIASES) + "]"


@query(f"WITH {_ALIASES}, n AS (SELECT ord, group_id, count(*) AS aliases FROM a GROUP BY 1, 2) SELECT p_partkey, group_id, aliases FROM part JOIN n ON p_partkey % {len(V.MATCH_GROUPS)} = ord")
def s14_match_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Each part with one of the groups, and how many aliases that has."""
    groups = M.alias_table(spark).groupBy("ord", "group_id").agg(F.count("*").alias("aliases"))
    parts = table(spark, sf, "part").select("p_partkey", (F.col("p_partkey") % len(V.MATCH_GROUPS)).cast("int").alias("ord"))
    return parts.join(F.broadcast(groups), "ord").select("p_partkey", "group_id", "aliases")  # a row for each group


@query(
    f"WITH {_ALIASES}, c AS (SELECT doc_id, ' ' || {KEY.format(f"text || CASE WHEN doc_id % 2 = 0 THEN ' ' || {_PHRASES}[doc_id % {len(ALIASES)} + 1] ELSE '' END")} || ' ' AS corpus FROM documents) "
    "SELECT DISTINCT doc_id, group_id FROM c, a WHERE contains(corpus, ' ' || alias || ' ')"
)
def j2_real_aliases(spark: SparkSession, sf: str) -> DataFrame:
    """Every second document ends with an alias of the real groups; all groups that it holds are found."""
    phrase = F.element_at(F.array(*[F.lit(a) for _, _, a in ALIASES]), (F.col("doc_id") % len(ALIASES) + 1).cast("int"))
    text = F.concat("text", F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit(" "), phrase)).otherwise(""))
    docs = table(spark, sf, "documents").select("doc_id", X.search_key(text).alias("corpus"))
    return M.match_aliases(docs, M.alias_table(spark), "doc_id", "corpus")


_FAMILY = "[" + ", ".join(f"'{f}'" for f in V.FAMILY_ACTIONS) + f"][p_partkey % {len(V.FAMILY_ACTIONS)} + 1]"


@query(f"SELECT p_partkey, family, place, action FROM (SELECT p_partkey, {_FAMILY} AS name FROM part) JOIN (VALUES {', '.join(f"('{f}', {i}, '{n}')" for f, names in V.FAMILY_ACTIONS.items() for i, n in enumerate(names))}) t(family, place, action) ON name = family")
def j10_family_actions(spark: SparkSession, sf: str) -> DataFrame:
    """Each part with one of the families, and that family's actions in order."""
    known = F.create_map(*[x for f, names in V.FAMILY_ACTIONS.items() for x in (F.lit(f), F.array(*[F.lit(n) for n in names]))])
    family = F.element_at(F.array(*[F.lit(f) for f in V.FAMILY_ACTIONS]), (F.col("p_partkey") % len(V.FAMILY_ACTIONS) + 1).cast("int"))
    return table(spark, sf, "part").select("p_partkey", family.alias("family")).select("p_partkey", "family", F.posexplode(F.try_element_at(known, F.col("family"))).alias("place", "action"))


@query("SELECT p_partkey FROM part WHERE p_brand NOT IN ('Brand#11', 'Brand#22') AND p_size % 5 >= 2 AND p_size % 2 = 0")
def f4_eligible_entries(spark: SparkSession, sf: str) -> DataFrame:
    views = F.map_from_entries(F.transform(F.sequence(F.lit(0), F.col("p_size") % 5), lambda i: F.struct(F.concat(F.lit("v"), i), i)))
    entries = table(spark, sf, "part").select("p_partkey", F.col("p_brand").alias("entry_id"), (F.col("p_size") % 2 == 0).alias("protocol_matchable"), views.alias("views"))
    return I.eligible(entries, ["Brand#11", "Brand#22"]).select("p_partkey")


@query("SELECT p_partkey, CASE WHEN p_size < 10 THEN 'scene_prim' WHEN p_size < 25 THEN 'standalone_mesh' ELSE 'package' END AS reference_kind, replace(p_name, ' ', '%20') AS url FROM part")
def p27_inventory_row(spark: SparkSession, sf: str) -> DataFrame:
    size = F.col("p_size")
    kind = F.when(size < 10, "scene_prim").when(size < 25, "standalone_mesh").otherwise("package")
    return table(spark, sf, "part").select("p_partkey", kind.alias("reference_kind"), F.replace(F.url_encode("p_name"), F.lit("+"), F.lit("%20")).alias("url"))


@query("SELECT doc_id, 'level1_q' || lpad(CAST(doc_id AS VARCHAR), 6, '0') AS question_id, 'A=' || source || ';B=' || lang AS options FROM documents")
def p28_question_record(spark: SparkSession, sf: str) -> DataFrame:
    options = F.create_map(F.lit("A"), F.col("source"), F.lit("B"), F.col("lang"))
    flat = F.array_join(F.transform(F.map_entries(options), lambda e: F.concat_ws("=", e["key"], e["value"])), ";")
    return table(spark, sf, "documents").select("doc_id", F.concat(F.lit("level1_q"), F.lpad(F.col("doc_id").cast("string"), 6, "0")).alias("question_id"), flat.alias("options"))


TERMS = ["the", "tion", "que", "ung"]
_HITS = " + ".join(f"CAST(contains({KEY.format('line')}, '{t}') AS INT)" for t in TERMS)


@query(
    "WITH lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents), "
    f"h AS (SELECT doc_id, line_no, {_HITS} AS score FROM lines), top AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, line_no) AS k FROM h WHERE score > 0) "
    "SELECT doc_id, sum(score) AS score, count(*) AS steps FROM top WHERE k <= 8 GROUP BY doc_id"
)
def a6_candidate_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Term hits over the eight best lines of each document."""
    from protomill.operators.steps import lines_of, top_per_group

    hits = X.term_hits(X.search_key(F.col("line")), F.array(*[F.lit(t) for t in TERMS]))
    scored = lines_of(table(spark, sf, "documents")).select("doc_id", "line_no", hits.alias("score")).where("score > 0")
    top = top_per_group(scored, "doc_id", [F.desc("score"), F.col("line_no")], 8)
    return top.groupBy("doc_id").agg(F.sum("score").alias("score"), F.count("*").alias("steps"))
