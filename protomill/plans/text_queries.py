"""Queries of scalar functions and of extraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from protomill.functions import answers as A
from protomill.functions import fixed_values as V
from protomill.functions import text as X
from protomill.operators import extract as E
from protomill.operators import steps as S
from protomill.plans.registry import query, table

TRIM = "trim(regexp_replace(coalesce({0}, ''), '\\s+', ' ', 'g'))"
TEXT = TRIM.format("text")
LINES = "lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents)"
# strip_tags() resolves every entity; these are all that the pages have
STRIP = (
    "trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace({0}, '<[^>]+>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), "
    "'&quot;', '\"'), '&#39;', ''''), '&nbsp;', ' '), '&middot;', '·'), '&copy;', '©'), '&amp;', '&'), '\\s+', ' ', 'g'))"
)


@query(f"SELECT doc_id, md5({TEXT}) AS digest, length({TEXT}) AS n FROM documents")
def c1_normalize(spark: SparkSession, sf: str) -> DataFrame:
    x = X.normalize(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.md5(x).alias("digest"), F.length(x).alias("n"))


@query("SELECT doc_id, md5(trim(regexp_replace(translate(lower(text), 'µμ', 'uu'), '[^a-z0-9]+', ' ', 'g'))) AS digest FROM documents")
def c2_search_key(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.md5(X.search_key(F.col("text"))).alias("digest"))


@query(
    "WITH ids AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN source || ':' || doc_id WHEN 1 THEN source WHEN 2 THEN ':' || source ELSE source || ':a:' || doc_id END AS id FROM documents) "
    "SELECT doc_id, CASE WHEN contains(id, ':') AND split_part(id, ':', 1) <> '' THEN split_part(id, ':', 1) ELSE 'unknown' END AS source_name FROM ids"
)
def c3_source_of_id(spark: SparkSession, sf: str) -> DataFrame:
    s, d = F.col("source"), F.col("doc_id")
    made = (
        F.when(d % 4 == 0, F.concat_ws(":", s, d)).when(d % 4 == 1, s).when(d % 4 == 2, F.concat(F.lit(":"), s)).otherwise(F.concat_ws(":a:", s, d))
    )
    return table(spark, sf, "documents").select("doc_id", X.source_of_id(made).alias("source_name"))


@query(
    f"SELECT doc_id, CASE WHEN length({TEXT}) <= 140 THEN {TEXT} ELSE rtrim({TEXT}[1:139]) || '...' END AS loose, "
    f"CASE WHEN length({TEXT}) <= 140 THEN {TEXT} ELSE rtrim({TEXT}[1:137]) || '...' END AS exact FROM documents"
)
def c4_compact_text(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf, "documents").select("doc_id", X.compact(t, 140).alias("loose"), X.compact(t, 140, exact=True).alias("exact"))


TERMS = ["the", "tion", "ing", "que", "ung", "zzz"]


@query("SELECT doc_id, " + " + ".join(f"CAST(contains(lower(text), '{t}') AS INT)" for t in TERMS) + " AS hits FROM documents")
def c5_term_hits(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", X.term_hits(F.lower("text"), F.array(*[F.lit(t) for t in TERMS])).alias("hits"))


def whole_words(*words: str) -> str:
    """A pattern for whole words whose boundaries both engines read alike."""
    return r"(^|[^\p{L}\p{N}_])(" + "|".join(words) + r")([^\p{L}\p{N}_]|$)"


#: Families of common words, which stand in for those of laboratory verbs in invented prose.
FAMILIES = {
    "transfer": whole_words("the", "de", "der"),
    "mix": whole_words("of", "la", "die"),
    "incubate": whole_words("and", "le", "und"),
    "centrifuge": whole_words("to", "les", "das"),
    "wash": whole_words("in", "des", "ein"),
    "separate": whole_words("is", "du", "von"),
    "measure": whole_words("it", "un", "ist"),
    "device": whole_words("for", "et", "zu"),
}


@query(
    f"WITH {LINES} SELECT doc_id, line_no, array_to_string(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(lower(line), '{FAMILIES[f]}') THEN '{f}' END" for f in sorted(FAMILIES)) + "], lambda x: x IS NOT NULL), ',') AS families FROM lines"
)
def c6_step_families(spark: SparkSession, sf: str) -> DataFrame:
    lines = S.lines_of(table(spark, sf, "documents"))
    return lines.select("doc_id", "line_no", F.array_join(X.families(F.col("line"), FAMILIES), ",").alias("families"))


#: Steps that hold words of the real families, one of which goes behind each document.
STEPS = ("Vortex the tube and spin it at 500 x g.", "Wash the pellet; discard what is left.", "Open the lid, then incubate overnight.", "Measure on the nanodrop and collect.", "Nothing of the kind.")
_STEPPED = "lower(text || ' ' || [" + ", ".join(f"'{t}'" for t in STEPS) + f"][doc_id % {len(STEPS)} + 1])"


@query("SELECT doc_id, array_to_string(list_filter([" + ", ".join(f"CASE WHEN regexp_matches({_STEPPED}, '{V.FAMILY_PATTERNS[f]}') THEN '{f}' END" for f in sorted(V.FAMILY_PATTERNS)) + "], lambda x: x IS NOT NULL), ',') AS families FROM documents")
def c6_real_families(spark: SparkSession, sf: str) -> DataFrame:
    """The real families' patterns on documents that end with such a step."""
    step = F.element_at(F.array(*[F.lit(t) for t in STEPS]), (F.col("doc_id") % len(STEPS) + 1).cast("int"))
    found = X.families(F.concat("text", F.lit(" "), step), V.FAMILY_PATTERNS)
    return table(spark, sf, "documents").select("doc_id", F.array_join(found, ",").alias("families"))


@query("SELECT page_id, len(regexp_extract_all(html, '[-+]?\\d+(?:\\.\\d+)?')) AS numbers FROM pages")
def c7_number_mentions(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", X.number_mentions(F.col("html")).alias("numbers"))


@query(
    "SELECT l_orderkey, l_linenumber, CAST(round(0.3 * least(l_linenumber / 10, 1) + 0.2 * least((l_partkey % 5) / 3, 1) + 0.3 * least(CAST(l_quantity AS INT) / 20, 1) "
    "+ CASE WHEN l_returnflag = 'R' THEN 0.1 ELSE 0 END + CASE WHEN l_linestatus = 'O' THEN 0.05 ELSE 0 END + CASE WHEN l_suppkey % 2 = 0 THEN 0.05 ELSE 0 END, 3) AS DOUBLE) AS score FROM lineitem"
)
def c8_qc_score(spark: SparkSession, sf: str) -> DataFrame:
    score = X.qc_score(
        F.col("l_linenumber"), F.col("l_partkey") % 5, F.col("l_quantity").cast("int"), F.col("l_returnflag") == "R", F.col("l_linestatus") == "O", F.col("l_suppkey") % 2 == 0
    )
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", score.alias("score"))


@query("SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug FROM part")
def c9_slug(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", X.slug(F.col("p_name")).alias("slug"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def c10_json_object(spark: SparkSession, sf: str) -> DataFrame:
    reply = F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```"))
    return table(spark, sf, "events").select("event_id", F.get_json_object(A.json_object(reply), "$.k").cast("bigint").alias("k"))


@query()
def c12_reasoning_steps(spark: SparkSession, sf: str) -> DataFrame:
    steps = A.reasoning_steps(F.col("text"))
    return table(spark, sf, "conversations").select("conv_id", "turn", F.size(steps).alias("n"), F.array_join(steps, "|").alias("steps"))


@query(
    "SELECT conv_id, turn, CASE conv_id % 5 WHEN 0 THEN chr(65 + CAST(turn % 10 AS INT)) WHEN 1 THEN chr(65 + CAST(turn % 10 AS INT)) WHEN 2 THEN NULL "
    "WHEN 3 THEN chr(65 + CAST(turn % 10 AS INT)) ELSE NULL END AS letter FROM conversations"
)
def c13_answer_letter(spark: SparkSession, sf: str) -> DataFrame:
    """Replies in five forms: a final line alone, tags, tags that disagree, JSON, and none."""
    letter = F.char(65 + F.col("turn") % 10)
    form = F.col("conv_id") % 5
    reply = (
        F.when(form == 0, F.concat(F.lit("Final Answer: "), letter))
        .when(form == 1, F.concat(F.lit("<step>one</step> <answer> "), F.lower(letter), F.lit(" </answer>")))
        .when(form == 2, F.lit("<answer>A</answer> or <answer>B</answer>"))
        .when(form == 3, F.concat(F.lit('```json\n{"answer": "'), letter, F.lit('"}\n```')))
        .otherwise(F.lit("no marker at all"))
    )
    return table(spark, sf, "conversations").select("conv_id", "turn", A.answer_letter(reply).alias("letter"))


@query(
    "WITH s AS (SELECT l_orderkey, l_linenumber, CAST(l_partkey AS BIGINT) AS v, CASE WHEN abs(l_partkey) >= 1000 THEN 100 WHEN abs(l_partkey) >= 100 THEN 10 ELSE 1 END AS d FROM lineitem) "
    "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 AND v - d > 0 THEN v - d ELSE v + d END AS near_miss FROM s"
)
def c14_perturbed_number(spark: SparkSession, sf: str) -> DataFrame:
    v = F.col("l_partkey").cast("bigint")
    near = X.perturbed(v, X.numeric_step(v), F.col("l_linenumber"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", near.alias("near_miss"))


@query(
    "SELECT l_orderkey, l_linenumber, abs(l_quantity - l_linenumber * 5) <= greatest(0.1 * greatest(abs(l_quantity), abs(l_linenumber * 5)), 1e-6) AS agree FROM lineitem"
)
def c15_numbers_agree(spark: SparkSession, sf: str) -> DataFrame:
    agree = X.numbers_agree(F.col("l_quantity").cast("double"), (F.col("l_linenumber") * 5).cast("double"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", agree.alias("agree"))


@query("SELECT doc_id, text[1:200] AS head FROM documents")
def c16_truncate(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.left("text", F.lit(200)).alias("head"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso, CAST(floor(epoch(ts)) AS BIGINT) AS seconds FROM events")
def c17_timestamps(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        "event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("iso"), F.unix_timestamp("ts").alias("seconds")
    )


@query(
    "SELECT page_id, split_part(split_part(url, '#', 1), '?', 1) AS bare, list_last(string_split(split_part(split_part(url, '#', 1), '?', 1), '/')) AS last_part, "
    "split_part(url, '#', 2) AS fragment FROM pages"
)
def c18_path_parts(spark: SparkSession, sf: str) -> DataFrame:
    bare = F.split_part(F.split_part("url", F.lit("#"), F.lit(1)), F.lit("?"), F.lit(1))
    return table(spark, sf, "pages").select(
        "page_id", bare.alias("bare"), F.element_at(F.split(bare, "/"), -1).alias("last_part"), F.split_part("url", F.lit("#"), F.lit(2)).alias("fragment")
    )


@query(
    f"WITH {LINES} SELECT doc_id, md5(string_agg(line_no || '. ' || {TRIM.format('line')}, chr(10) ORDER BY line_no)) AS digest FROM lines GROUP BY doc_id"
)
def c19_render_steps(spark: SparkSession, sf: str) -> DataFrame:
    lines = S.lines_of(table(spark, sf, "documents"))
    row = F.struct("line_no", F.concat(F.col("line_no"), F.lit(". "), X.normalize(F.col("line"))).alias("r"))
    ordered = F.transform(F.array_sort(F.collect_list(row)), lambda x: x["r"])
    return lines.groupBy("doc_id").agg(F.md5(F.array_join(ordered, "\n")).alias("digest"))


@query(f"SELECT page_id, md5({STRIP.format('html')}) AS digest FROM pages")
def p1_strip_tags(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", F.md5(X.strip_tags(F.col("html"))).alias("digest"))


@query(
    f"SELECT page_id, {STRIP.format("regexp_extract(html, '(?s)<title[^>]*>(.*?)</title>', 1)")} AS title, regexp_extract(html, '<html[^>]*lang=\"([^\"]+)\"', 1) AS lang, "
    "len(regexp_extract_all(html, '<a [^>]*href=\"([^\"]+)\"', 1)) AS links FROM pages"
)
def p4_page_metadata(spark: SparkSession, sf: str) -> DataFrame:
    h = F.col("html")
    return table(spark, sf, "pages").select(
        "page_id",
        X.strip_tags(F.regexp_extract(h, r"(?s)<title[^>]*>(.*?)</title>", 1)).alias("title"),
        F.regexp_extract(h, r'<html[^>]*lang="([^"]+)"', 1).alias("lang"),
        F.size(F.regexp_extract_all(h, F.lit(r'<a [^>]*href="([^"]+)"'), F.lit(1))).alias("links"),
    )


@query("SELECT doc_id, '10.1/' || doc_id AS doi, 'A ' || source AS title, '20' || lpad(CAST(doc_id % 25 AS VARCHAR), 2, '0') AS pub_year, 'https://l/' || lang AS license, source || ',' || lang AS authors FROM documents")
def p4_article_metadata(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    xml = F.concat(
        F.lit('<article-id pub-id-type="doi">10.1/'), "doc_id", F.lit("</article-id><article-title>A <i>"), "source",
        F.lit("</i></article-title><pub-date><year>20"), F.lpad((F.col("doc_id") % 25).cast("string"), 2, "0"),
        F.lit('</year></pub-date><license xlink:href="https://l/'), "lang", F.lit('">x</license><surname>'), "source", F.lit("</surname><surname>"), "lang", F.lit("</surname>"),
    )
    m = E.metadata(xml)
    return d.select("doc_id", *[m[c].alias(c) for c in ("doi", "title", "pub_year", "license")], F.array_join(m["authors"], ",").alias("authors"))


@query(
    "WITH items AS (SELECT page_id, unnest(regexp_extract_all(html, '(?s)<li\\b[^>]*>(.*?)</li>', 1)) AS raw FROM pages), "
    f"texts AS (SELECT page_id, {STRIP.format('raw')} AS t FROM items) "
    "SELECT page_id, count(*) AS n, sum(length(t)) AS chars FROM texts WHERE length(t) >= 15 GROUP BY page_id"
)
def p5_list_items(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "pages").select("page_id", F.explode(E.list_items(F.col("html"), "li")).alias("i"))
    return rows.groupBy("page_id").agg(F.count("*").alias("n"), F.sum(F.length("i.text")).alias("chars"))


@query("SELECT p_partkey, 2 AS n_rows, p_name || '|' || p_type || '|' || p_brand AS second_row FROM part")
def p6_table_rows(spark: SparkSession, sf: str) -> DataFrame:
    cell = lambda c: F.concat(F.lit("<td>"), F.col(c), F.lit("</td>"))
    html = F.concat(F.lit("<table><tr><th>a</th><th>b</th></tr><tr class='x'>"), cell("p_name"), cell("p_type"), cell("p_brand"), F.lit("</tr></table>"))
    rows = E.table_rows(html)
    return table(spark, sf, "part").select("p_partkey", F.size(rows).alias("n_rows"), F.array_join(F.element_at(rows, 2), "|").alias("second_row"))


@query("SELECT doc_id, least(doc_id % 4, doc_id % 3) AS pairs, CASE WHEN least(doc_id % 4, doc_id % 3) > 0 THEN 'p0/s0' ELSE '' END AS first_pair FROM documents")
def j12_zip_shorter(spark: SparkSession, sf: str) -> DataFrame:
    made = lambda letter, n: F.slice(F.array(*[F.lit(f"{letter}{i}") for i in range(4)]), F.lit(1), (F.col("doc_id") % n).cast("int"))
    pairs = E.zip_shorter(made("p", 4), made("s", 3), "problem", "solution")
    first = F.coalesce(F.concat_ws("/", F.get(pairs, 0)["problem"], F.get(pairs, 0)["solution"]), F.lit(""))
    return table(spark, sf, "documents").select("doc_id", F.size(pairs).cast("bigint").alias("pairs"), first.alias("first_pair"))


@query(
    "WITH items AS (SELECT page_id, unnest(regexp_extract_all(html, '(?s)<p\\b[^>]*>(.*?)</p>', 1)) AS raw FROM pages), "
    f"texts AS (SELECT page_id, {STRIP.format('raw')} AS t FROM items), "
    "names AS (SELECT page_id, regexp_replace(trim(string_split_regex(regexp_replace(t, '^\\s*\\d+\\.\\s+', ''), '[\\(,]')[1]), '\\.+$', '') AS name FROM texts "
    "WHERE length(t) BETWEEN 5 AND 600 AND NOT regexp_matches(t, '^[A-Z]\\.\\s') AND NOT (len(string_split(t, ' ')) <= 3 AND regexp_matches(t[1:1], '\\p{Lu}'))) "
    "SELECT page_id, name[1:200] AS name FROM names WHERE length(name) >= 3"
)
def p8_entities(spark: SparkSession, sf: str) -> DataFrame:
    found = E.entities(F.col("html"), tag="list-item")
    return table(spark, sf, "pages").select("page_id", F.explode(found).alias("e")).select("page_id", F.col("e.name").alias("name"))


NUMBERED = "CASE (line_no - 1) % 5 WHEN 0 THEN chr(65 + CAST(line_no % 7 AS INT)) || '. Part' ELSE line_no || '. ' || " + TRIM.format("line") + " END"


@query(
    f"WITH {LINES}, t AS (SELECT doc_id, line_no, {NUMBERED} AS t, (line_no - 1) % 5 = 0 AS heading, {TRIM.format('line')} AS body FROM lines), "
    "f AS (SELECT *, last_value(CASE WHEN heading THEN t END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no) AS section FROM t) "
    "SELECT doc_id, CAST(line_no AS VARCHAR) AS step_no, body[1:2000] AS text, section FROM f WHERE NOT heading AND body <> ''"
)
def p9_numbered_steps(spark: SparkSession, sf: str) -> DataFrame:
    lines = S.lines_of(table(spark, sf, "documents"))
    heading = F.concat(F.char(65 + F.col("line_no") % 7), F.lit(". Part"))
    made = F.when((F.col("line_no") - 1) % 5 == 0, heading).otherwise(F.concat(F.col("line_no"), F.lit(". "), X.normalize(F.col("line"))))
    texts = F.transform(F.array_sort(F.collect_list(F.struct("line_no", made.alias("t")))), lambda x: x["t"])
    paragraphs = lines.groupBy("doc_id").agg(texts.alias("p"))
    return E.numbered_steps(paragraphs, "doc_id", F.col("p")).select("doc_id", "step_no", "text", "section")


@query("SELECT doc_id, 'reagent ' || source AS name, 'Vendor ' || upper(lang) AS vendor, 'AB-' || doc_id || '7' AS catalog_id FROM documents")
def p10_inline_reagents(spark: SparkSession, sf: str) -> DataFrame:
    mention = F.concat(F.lit("using reagent "), "source", F.lit(" (Vendor "), F.upper("lang"), F.lit(", cat# AB-"), "doc_id", F.lit("7); reagent "), "source", F.lit(" (Other, X123)."))
    found = E.inline_reagents(table(spark, sf, "documents"), "doc_id", mention)
    return found.select("doc_id", "name", "vendor", "catalog_id")


@query(
    "WITH x AS (SELECT page_id, unnest(regexp_extract_all(html, '(?s)<h1\\b[^>]*>.*?</h1>|<li\\b[^>]*>.*?</li>')) AS e, "
    "generate_subscripts(regexp_extract_all(html, '(?s)<h1\\b[^>]*>.*?</h1>|<li\\b[^>]*>.*?</li>'), 1) AS pos FROM pages), "
    f"y AS (SELECT page_id, pos, starts_with(e, '<h1') AS head, {STRIP.format('e')} AS t FROM x), "
    "z AS (SELECT *, last_value(CASE WHEN head THEN t END IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY pos) AS section FROM y) "
    "SELECT page_id, pos, t AS text, coalesce(section, '') AS section FROM z WHERE NOT head AND length(t) >= 10"
)
def p11_titled_items(spark: SparkSession, sf: str) -> DataFrame:
    both = F.regexp_extract_all(F.col("html"), F.lit(r"(?s)<h1\b[^>]*>.*?</h1>|<li\b[^>]*>.*?</li>"), F.lit(0))
    rows = table(spark, sf, "pages").select("page_id", F.posexplode(both).alias("p", "e"))
    rows = rows.select("page_id", (F.col("p") + 1).alias("pos"), F.startswith("e", F.lit("<h1")).alias("head"), X.strip_tags(F.col("e")).alias("text"))
    rows = rows.withColumn("title", F.when(F.col("head"), F.col("text")).otherwise(F.lit("")))
    return S.carry_forward(rows, "page_id", "pos", "title", "section").where("not head and length(text) >= 10").select("page_id", "pos", "text", "section")


@query("SELECT p_partkey, p_name AS name, p_brand AS vendor, contains(lower(p_name || ' ' || p_type), 'steel') AS is_equipment FROM part")
def p16_table_materials(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "part").select("p_partkey", F.lit(0).alias("pos"), F.array("p_name", "p_brand", F.lit("x"), "p_type").alias("cells"))
    return E.materials_from_rows(rows, "p_partkey", ("steel",)).select("p_partkey", "name", "vendor", "is_equipment")


@query(
    "WITH r AS (SELECT p_partkey % 50 AS doc, p_partkey AS pos, p_name, p_brand, p_partkey % 7 = 0 AS head, lower(p_type) AS cat FROM part), "
    "f AS (SELECT *, coalesce(last_value(CASE WHEN head THEN cat END IGNORE NULLS) OVER (PARTITION BY doc ORDER BY pos), '') AS category FROM r) "
    "SELECT doc, pos, p_name AS name, 'N' || pos AS catalog_id, 'AB_' || pos AS rrid, category FROM f WHERE NOT head AND NOT contains(upper(p_name), 'REAGENT')"
)
def p20_key_resources(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("p_partkey")
    ident = F.concat(F.lit("Cat# N"), key, F.lit("; RRID: AB_"), key)
    cells = F.when(key % 7 == 0, F.array("p_type", F.lit(""), F.lit(""))).otherwise(F.array("p_name", "p_brand", ident))
    rows = table(spark, sf, "part").select((key % 50).alias("doc"), key.alias("pos"), cells.alias("cells"))
    return E.key_resources(rows, "doc", V.EQUIPMENT_WORDS).select("doc", "pos", "name", "catalog_id", "rrid", "category")


@query(
    "WITH s AS (SELECT page_id, string_split_regex(html, '(?s)<h1\\b[^>]*>') AS parts FROM pages), "
    "b AS (SELECT page_id, unnest(parts[2:]) AS part, generate_subscripts(parts[2:], 1) AS pos FROM s) "
    f"SELECT page_id, pos, {STRIP.format("string_split(part, '</h1>')[1]")} AS title FROM b"
)
def p22_titled_sections(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "pages").select("page_id", F.posexplode(E.titled_sections(F.col("html"), "h1")).alias("p", "s"))
    return rows.select("page_id", (F.col("p") + 1).alias("pos"), F.col("s.title").alias("title"))


@query(f"WITH {LINES} SELECT doc_id, line_no FROM lines WHERE length(trim(lower(line))) < 18 OR regexp_matches(trim(lower(line)), '^\\s*(cleaning|preparation|mouse preparation|stereotaxic surgery|injection cannulas circuit preparation|apparatus preparation)\\.?\\s*$')")
def f14_generic_steps(spark: SparkSession, sf: str) -> DataFrame:
    lines = S.lines_of(table(spark, sf, "documents"))
    return lines.where(X.is_generic_step(F.col("line"), V.GENERIC_HEADINGS)).select("doc_id", "line_no")


@query("SELECT doc_id, regexp_matches(text || CASE WHEN doc_id % 10 = 0 THEN '混合' ELSE '' END, '[\\x{3400}-\\x{4dbf}\\x{4e00}-\\x{9fff}\\x{3000}-\\x{303f}\\x{ff00}-\\x{ffef}]') AS cjk FROM documents")
def f11_cjk(spark: SparkSession, sf: str) -> DataFrame:
    made = F.concat("text", F.when(F.col("doc_id") % 10 == 0, "混合").otherwise(""))
    return table(spark, sf, "documents").select("doc_id", X.has_cjk(made).alias("cjk"))


@query("SELECT page_id, 'data:image/png;base64,' || base64(encode(url)) AS data FROM pages")
def s16_data_url(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", X.data_url(F.encode("url", "UTF-8"), F.lit("a/b.png")).alias("data"))


@query("SELECT page_id, regexp_replace(url, '[^A-Za-z0-9]+', '_', 'g') AS key FROM pages")
def s8_cache_key(spark: SparkSession, sf: str) -> DataFrame:
    from protomill.sources.files import cache_key

    return table(spark, sf, "pages").select("page_id", cache_key(F.col("url")).alias("key"))


@query("SELECT doc_id, md5(regexp_replace(text, '[<>&]', ' ', 'g') || '<sec><title>Inner</title>' || source || '</sec> end') AS first, 2 AS \"all\" FROM documents")
def p2_balanced_sections(spark: SparkSession, sf: str) -> DataFrame:
    xml = F.concat(
        F.lit("<sec><title>Other</title>x</sec><sec id='a'><title> Procedure </title>"), F.regexp_replace("text", "[<>&]", " "), F.lit("<sec><title>Inner</title>"), "source", F.lit("</sec> end</sec><sec><title>Procedure</title>2</sec>")
    )
    d = table(spark, sf, "documents").select("doc_id", xml.alias("xml"))
    found = d.select("doc_id", E.sections(F.col("xml"), "Procedure").alias("bodies"))
    return found.select("doc_id", F.md5(F.get("bodies", 0)).alias("first"), F.size("bodies").alias("all"))
