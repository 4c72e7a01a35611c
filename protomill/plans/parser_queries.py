"""Queries of the article parsers: each document becomes an article, and SQL says what its parser must find.

An article and what is expected of it are written as templates; ``{source}``, ``{lang}``, ``{doc_id}`` and ``{body}`` (the document's text) are filled in by
Spark for the article, and by SQL for the expected values.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from protomill.functions import text as X
from protomill.operators import extract as E
from protomill.operators import parsers
from protomill.plans.registry import query, table

_PLACE = re.compile(r"(\{\w+\})")
#: A document's text as it stands in an article, without what would be markup or a mention of its own.
BODY = "trim(regexp_replace(regexp_replace(text, '[<>&()]', ' ', 'g'), '\\s+', ' ', 'g'))"


def filled(template: str) -> Column:
    """The template with a document's values."""
    values = {"{source}": F.col("source"), "{lang}": F.col("lang"), "{doc_id}": F.col("doc_id").cast("string"), "{body}": F.regexp_replace("text", "[<>&()]", " ")}
    return F.concat(*[values.get(p, F.lit(p)) for p in _PLACE.split(template) if p])


def in_sql(template: str) -> str:
    """The same as an SQL expression."""
    values = {"{source}": "source", "{lang}": "lang", "{doc_id}": "CAST(doc_id AS VARCHAR)", "{body}": BODY}
    parts = [values.get(p, "'" + p.replace("'", "''").replace("\n", "' || chr(10) || '") + "'") for p in _PLACE.split(template) if p]
    return "(" + " || ".join(parts) + ")" if parts else "''"


def item(text: str, label: str = "") -> str:
    return f"<list-item>{label and f'<label>{label}</label>'}<p>{text}</p></list-item>"


def section(title: str, *parts: str) -> str:
    return f"<sec><title>{title}</title>{''.join(parts)}</sec>"


FRONT = '<article-id pub-id-type="doi">10.1/{doc_id}</article-id><article-title>On <i>{source}</i></article-title>'
FILLER = "filler words of this section " * 7 + "end"
#: Materials as list items, as text, and as (name, vendor, catalog number).
ITEMS = ("Buffer {source} number one (Vendor {lang}, cat# A{doc_id}77)", "Second salt of {lang} kind (Other Co, B{doc_id}9)", "Plain {source} water without any number")
LISTED = "Buffer {source} number one|Vendor {lang}|A{doc_id}77;Second salt of {lang} kind|Other Co|B{doc_id}9;Plain {source} water without any number||"
MATERIALS = "".join(map(item, ITEMS))
TEXT = " ".join(ITEMS)
WAIT, SPIN, MIX = "Leave the sample on ice for long.", "Spin the tube once again then.", "Mix everything on ice for long."


def step(number: str, title: str, text: str, when: str = "TRUE") -> str:
    """An expected step in SQL; null, and so left out, unless the condition holds."""
    return f"CASE WHEN {when} THEN '{number}|' || {in_sql(title)} || '|' || md5(left({in_sql(text)}, 2000)) END"


def shown(rows: DataFrame) -> DataFrame:
    """A record in columns that SQL can give: lists as text, long texts as digests."""
    row = lambda *fields: lambda x: F.concat_ws("|", *[x[f] for f in fields])
    listed = lambda c, *fields: F.array_join(F.transform(c, row(*fields)), ";").alias(c)
    steps = F.transform("steps", lambda s: F.concat_ws("|", s["step_no"], s["section"], F.md5(s["text"])))
    return rows.select(
        "doc_id",
        "doi",
        "title",
        listed("reagents", "name", "vendor", "catalog_id"),
        listed("equipment", "name", "vendor", "model"),
        F.md5("materials_raw").alias("materials"),
        F.array_join(steps, ";").alias("steps"),
        listed("troubleshooting", "problem", "solution"),
    )


def expected(reagents: str, equipment: str, materials: str, steps: list[str], troubleshooting: str = "''", doi: str = "'10.1/' || doc_id", title: str = "'On ' || source") -> str:
    return (
        f"SELECT doc_id, {doi} AS doi, {title} AS title, {in_sql(reagents)} AS reagents, {in_sql(equipment)} AS equipment, md5({in_sql(materials)}) AS materials, "
        f"concat_ws(';', {', '.join(steps)}) AS steps, {troubleshooting} AS troubleshooting FROM documents"
    )


def parsed(spark: SparkSession, sf: str, source: str, *parts: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", filled("".join(parts)).alias("xml"))
    return shown(parsers.parse(docs, source, "xml", ["doc_id"]))


_LONG = f"length({BODY}) >= 15"
_ANY = f"length({BODY}) > 0"
_NUMBERED = "<p>A. Part {source}</p><p>1. {body}</p><p>2. " + WAIT + "</p>"
_NUMBERED_STEPS = [step("1", "A. Part {source}", "{body}", _ANY), step("2", "A. Part {source}", WAIT)]


@query(f"SELECT doc_id, 1 AS n, {BODY}[1:500] AS problem, source AS solution FROM documents")
def p7_troubleshooting(spark: SparkSession, sf: str) -> DataFrame:
    body = filled("<title>Problem 1</title><p>{body}</p><title>Potential solution</title><p>{source}</p><title>Problem 2</title>")
    rows = table(spark, sf, "documents").select("doc_id", E.troubleshooting(body).alias("pairs"))
    return rows.select("doc_id", F.size("pairs").alias("n"), F.get("pairs", 0)["problem"].alias("problem"), F.get("pairs", 0)["solution"].alias("solution"))


@query(expected(LISTED, "Bench centrifuge model two|Maker|C{doc_id}", TEXT + " " + FILLER, _NUMBERED_STEPS, in_sql("The {lang} cells do not grow.|")))
def p12_bioprot_parser(spark: SparkSession, sf: str) -> DataFrame:
    """Numbered paragraphs below a lettered heading, listed materials, and list items as problems."""
    device, trouble = item("Bench centrifuge model two (Maker, catalog number: C{doc_id})"), item("The {lang} cells do not grow.")
    materials = section("Materials and reagents", MATERIALS, f"<p>{FILLER}</p>")
    return parsed(spark, sf, "bioprot", FRONT, materials, section("Equipment", device), section("Procedure", _NUMBERED), section("Troubleshooting", trouble))


@query(
    expected(
        LISTED,
        "Heat block of the {lang} kind|Maker|C{doc_id}7",
        TEXT + " Heat block of the {lang} kind (Maker, C{doc_id}7)\nMix the {lang} salts. " + FILLER,
        [step("1", "Harvest {source}", "{body}", f"length({BODY}) >= 10"), step("2a", "Harvest {source}", SPIN)],
    )
)
def p13_curprot_parser(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled items below the last title, devices among the materials, and recipes."""
    materials = section("Materials", MATERIALS, item("Heat block of the {lang} kind (Maker, C{doc_id}7)"))
    steps = section("Harvest {source}", item("{body}", "1"), item("2. A note that has no label."), item(SPIN, "2a."))
    return parsed(spark, sf, "curprot", FRONT, materials, steps, section("REAGENTS AND SOLUTIONS", "<p>Mix the {lang} salts.</p>", f"<p>{FILLER}</p>"))


_PROSE = f"length({BODY}) BETWEEN 21 AND 1999"


@query(
    expected(
        LISTED,
        "Heating rack||",
        TEXT + " " + FILLER,
        [step("1", "Prep {source}", "{body}", _PROSE), step("2", "Prep {source}", WAIT, _PROSE), step("1", "Prep {source}", WAIT, f"NOT {_PROSE}")],
    )
)
def p14_f1000_parser(spark: SparkSession, sf: str) -> DataFrame:
    """Prose of the first part of the methods, and listed devices."""
    methods = section("Methods", section("Prep {source}", "<p>{body}</p><p>short</p>", f"<p>{WAIT}</p>"), section("Later", f"<p>{SPIN}</p>"))
    return parsed(spark, sf, "f1000", FRONT, section("Materials and reagents", MATERIALS, f"<p>{FILLER}</p>"), section("Equipment setup", item("Heating rack, with a {lang} lid")), methods)


def _cells(*cells: str) -> str:
    return "<tr>" + "".join(f"<td>{c}</td>" for c in cells) + "</tr>"


_TABLE = [("Name of Material", "Company", "Number"), ("{source} buffer", "Vendor {lang}", "A{doc_id}"), ("Reference material", "NIST", "19"), ("Rocking shaker", "Rock", "S1"), ("Salt", "Shop", "B{doc_id}")]


@query(
    expected(
        "{source} buffer|Vendor {lang}|A{doc_id};Reference material|NIST|19;Salt|Shop|B{doc_id}",
        "Rocking shaker|Rock|S1",
        " ".join(" ".join(r) for r in _TABLE) + " " + FILLER,
        [step("1", "", "{body}", _LONG), step("2", "", SPIN)],
    )
)
def p17_jove_parser(spark: SparkSession, sf: str) -> DataFrame:
    """A table of materials, whose words tell devices, and a numbered protocol section."""
    materials = section("Table of Materials", f"<table-wrap>{''.join(_cells(*r) for r in _TABLE)}</table-wrap><p>{FILLER}</p>")
    return parsed(spark, sf, "jove", FRONT, materials, section("Protocol 1", item("{body}", "1"), item(SPIN, "2")))


@query(expected(LISTED, "", TEXT + " " + FILLER, _NUMBERED_STEPS, in_sql("Keep the {lang} parts dark.|")))
def p18_mimb_parser(spark: SparkSession, sf: str) -> DataFrame:
    """Numbered paragraphs of the methods, and notes as problems."""
    return parsed(spark, sf, "mimb", FRONT, section("Materials", MATERIALS, f"<p>{FILLER}</p>"), section("Methods", _NUMBERED), section("Notes", item("Keep the {lang} parts dark.")))


@query(
    expected(
        LISTED,
        "Water bath with a lid|Bath|W{doc_id}",
        TEXT + "\nWater bath with a lid (Bath, W{doc_id})\n\nWarm the {lang} bath.",
        [step("1", "Lysis {source}", "{body}", _LONG), step("2", "Lysis {source}", SPIN)],
    )
)
def p19_nprot_parser(spark: SparkSession, sf: str) -> DataFrame:
    """Steps of the procedure's parts before items outside of them, and the set-up of devices among the materials."""
    parts = section("Reagents", MATERIALS), section("Equipment", item("Water bath with a lid (Bath, W{doc_id})")), section("Equipment setup", "<p>Warm the {lang} bath.</p>")
    return parsed(spark, sf, "nprot", FRONT, *parts, section("Procedure", item(MIX, "0"), section("Lysis {source}", item("{body}", "1"), item(SPIN, "2"))))


@query(
    expected(
        "Anti {source}|Vendor {lang}|ab{doc_id};Salt|Shop|S1",
        "ImageJ|NIH|https://i.j",
        "Kept at the {lang} bench.",
        [step("1", "Lysis {source}", "{body}", _LONG), step("2", "Lysis {source}", SPIN)],
        in_sql("No {lang} bands.|Load more of {source}."),
    )
)
def p21_star_parser(spark: SparkSession, sf: str) -> DataFrame:
    """A key resources table with categories, and pairs of problems and solutions."""
    rows = [("REAGENT or RESOURCE", "SOURCE", "IDENTIFIER"), ("Antibodies", "", ""), ("Anti {source}", "Vendor {lang}", "Cat# ab{doc_id}; RRID: AB_{doc_id}"), ("Salt", "Shop", "Cat# S1")]
    rows += [("Software and algorithms",), ("ImageJ", "NIH", "https://i.j")]
    resources = section("Key resources table", "<table-wrap>", *[_cells(*r) for r in rows], "</table-wrap>")
    details = section("Step-by-step method details", section("Lysis {source}", item("{body}", "1"), item(SPIN, "2")))
    trouble = section("Troubleshooting", section("Problem 1", "<p>No {lang} bands.</p>"), section("Potential solution", "<p>Load more of {source}.</p>"), section("Problem 2", "<p>Smear.</p>"))
    return parsed(spark, sf, "star", FRONT, resources, section("Materials and equipment", "<p>Kept at the {lang} bench.</p>"), details, trouble)


_LINE = f"length({BODY}) BETWEEN 3 AND 1000"


@query(
    expected(
        LISTED,
        "Bench centrifuge||",
        TEXT + " Bench centrifuge " + FILLER,
        [step("1", "Procedure", "{body}", f"{_LINE} AND {_LONG}")]
        + [step(str(k + 1), "Procedure", t, _LINE) for k, t in enumerate((MIX, WAIT, SPIN), 1)]
        + [step(str(k), "Procedure", t, f"NOT {_LINE}") for k, t in enumerate((MIX, WAIT, SPIN), 1)],
        doi="''",
        title="''",
    )
)
def p23_wiki_parser(spark: SparkSession, sf: str) -> DataFrame:
    """A wiki page: materials and steps by headings, devices by their words."""
    entries = lambda *texts: "".join(f"<li>{t}</li>" for t in texts)
    materials = f'<h2>Materials<span class="mw-editsection">[edit]</span></h2><ul>{entries(*ITEMS, "Bench centrifuge")}</ul><p>{FILLER}</p>'
    return parsed(spark, sf, "oww", '<div id="toc"><div>x</div> </div>', materials, f"<h2>Procedure</h2><ol>{entries('{body}', MIX, WAIT, SPIN)}</ol><h2>References</h2>{entries('A paper that is long.')}")


@query(
    "WITH k AS (SELECT *, ['bioprot', 'curprot', 'f1000', 'jove', 'mimb', 'nmeth', 'nprot', 'oww', 'star'][doc_id % 9 + 1] AS kind FROM documents) "
    "SELECT doc_id, kind AS source, CASE WHEN kind = 'oww' THEN '' ELSE '10.1/' || doc_id END AS doi, CASE WHEN kind IN ('f1000', 'jove', 'oww', 'star') THEN 0 ELSE 1 END AS n_steps FROM k"
)
def u1_parser_registry(spark: SparkSession, sf: str) -> DataFrame:
    """Each document as an article, read in one pass by the parser that its kind names; those without a procedure section find no step."""
    names = sorted(parsers.REGISTRY)
    xml = filled(FRONT + section("Materials", MATERIALS) + section("Procedure", item("{source} and {lang}, spun for long.", "1")))
    kind = F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("doc_id") % len(names) + 1).cast("int"))
    docs = table(spark, sf, "documents").select("doc_id", xml.alias("xml"), kind.alias("kind"))
    return parsers.parse_each(docs, "kind", "xml", ["doc_id"]).select("doc_id", "source", "doi", F.size("steps").alias("n_steps"))


@query(f"SELECT doc_id, md5({BODY}) AS said FROM documents")
def p1_article_text(spark: SparkSession, sf: str) -> DataFrame:
    """An article's text without its markup."""
    return table(spark, sf, "documents").select("doc_id", F.md5(X.strip_tags(filled("<sec><p>{body}</p></sec>"))).alias("said"))
