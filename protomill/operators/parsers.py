"""Parsers of article sources: each turns a column of XML or HTML into one common record.

A parser is a function of a text column and its sections to metadata, materials and steps, made of native expressions.  register() adds one
under a name, parse() applies one, and parse_each() applies to each row the one that a column names, in a single pass.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from protomill.functions import fixed_values as V
from protomill.functions import text as X
from protomill.operators import extract as E

#: Of a text and its sections the columns of a record, where materials_raw is a function of the column of reagents.
Parser = Callable[[Column, "Sections"], dict[str, "Column | Callable[[Column], Column]"]]
REGISTRY: dict[str, Parser] = {}
#: Version of what the parsers give.
VERSION = "2"
_REAGENTS = "array<struct<name:string,vendor:string,catalog_id:string,rrid:string,category:string>>"
_EQUIPMENT = "array<struct<name:string,vendor:string,model:string>>"
_STEPS = "array<struct<step_no:string,text:string,section:string,duration:string>>"
#: Kinds of the columns that parsers fill, in the order of the record.
RECORD = {
    "doi": "string",
    "pmcid": "string",
    "pmid": "string",
    "title": "string",
    "authors": "array<string>",
    "journal": "string",
    "pub_year": "string",
    "license": "string",
    "abstract": "string",
    "reagents": _REAGENTS,
    "equipment": _EQUIPMENT,
    "materials_raw": "string",
    "steps": _STEPS,
    "troubleshooting": "array<struct<problem:string,solution:string>>",
    "timing": "string",
    "parser_version": "string",
}


def register(name: str) -> Callable:
    def add(f: Parser) -> Parser:
        REGISTRY[name] = f
        return f

    return add


class Sections:
    """The sections of a text by title; the titles asked for are noted, so that each is looked for once."""

    def __init__(self, found: Column | None = None, titles: dict[str, int] | None = None):
        self.titles: dict[str, int] = titles if titles is not None else {}
        self.found = found

    def all(self, title: str) -> Column:
        """Bodies of all sections with the title."""
        at = self.titles.setdefault(title, len(self.titles))
        return F.get(self.found, at) if self.found is not None else F.array().cast("array<string>")

    def first(self, *titles: str) -> Column:
        """The body of the first section with one of the titles, the titles in order; empty if none."""
        return F.coalesce(*[F.nullif(F.get(self.all(t), 0), F.lit("")) for t in titles], F.lit(""))


def parse(pages: DataFrame, source: str, text_col: str, keep: list[str]) -> DataFrame:
    """``keep``, source and the columns of RECORD (missing ones empty)."""
    return parse_each(pages.withColumn("__kind", F.lit(source)), "__kind", text_col, keep, [source])


def parse_each(pages: DataFrame, kind_col: str, text_col: str, keep: list[str], sources: list[str] | None = None) -> DataFrame:
    """As parse(), each row by the parser that ``kind_col`` names; rows of other kinds are left out."""
    sources = sorted(REGISTRY) if sources is None else sources
    asked = Sections()
    for s in sources:
        REGISTRY[s](F.col(text_col), asked)
    rows = pages.where(F.col(kind_col).isin(*sources)).select(*keep, F.col(kind_col).alias("source"), F.coalesce(F.col(text_col), F.lit("")).alias("__xml"))
    rows = rows.withColumn("__pieces", E.section_pieces(F.col("__xml")))
    titles = list(asked.titles)
    found = F.array(*[E.sections_in(F.col("__pieces"), t) for t in titles]) if titles else F.array().cast("array<array<string>>")
    rows = rows.withColumn("__sections", found)
    empty = {k: F.array() if kind.startswith("array") else F.lit("") for k, kind in RECORD.items()}
    records = {s: empty | {"parser_version": F.lit(f"{s}-{VERSION}")} | REGISTRY[s](F.col("__xml"), Sections(F.col("__sections"), asked.titles)) for s in sources}

    def column(name: str) -> Column:
        given = {s: r[name](F.col("__reagents")) if callable(r[name]) and not isinstance(r[name], Column) else r[name] for s, r in records.items()}
        shaped = {s: c.cast(RECORD[name]) for s, c in given.items()}
        if len(sources) == 1:
            return shaped[sources[0]]
        return reduce(lambda rest, s: F.when(F.col("source") == s, shaped[s]).otherwise(rest), sources, F.lit(None).cast(RECORD[name]))

    rows = rows.withColumn("__reagents", column("reagents"))  # materials may be made from them
    return rows.select(*keep, "source", *[(F.col("__reagents") if name == "reagents" else column(name)).alias(name) for name in RECORD])


def _reagents(items: Column) -> Column:
    """Items as reagents; what only key resources tables have is empty."""
    return F.transform(items, lambda i: F.struct(i["name"].alias("name"), i["vendor"].alias("vendor"), i["catalog_id"].alias("catalog_id"), F.lit("").alias("rrid"), F.lit("").alias("category")))


def _equipment(items: Column) -> Column:
    return F.transform(items, lambda i: F.struct(i["name"].alias("name"), i["vendor"].alias("vendor"), i["catalog_id"].alias("model")))


def _holds(text: Column, words: tuple[str, ...]) -> Column:
    low = F.lower(text)
    return F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(low, w))


def _timed(steps: Column) -> Column:
    return F.transform(steps, lambda s: F.struct(s["step_no"].alias("step_no"), s["text"].alias("text"), s["section"].alias("section"), F.lit("").alias("duration")))


def _steps(items: Column, section: Column | str = "") -> Column:
    title = F.lit(section) if isinstance(section, str) else section
    return F.transform(items, lambda i: F.struct(i["num"].alias("step_no"), F.left(i["text"], F.lit(2000)).alias("text"), title.alias("section"), F.lit("").alias("duration")))


def _cascade(*options: Column) -> Column:
    """The first array that isn't empty."""
    return reduce(lambda rest, x: X.let(x, lambda found: F.when(F.size(found) > 0, found).otherwise(rest)), reversed(options))


def _inner(body: Column, labelled: bool = False) -> Column:
    """array<struct<title, body>> of the inner sections, each up to its first closing tag; ``labelled`` ones may have a label before the title."""
    label = r"(?:<label[^>]*>[^<]*</label>\s*)?" if labelled else ""
    pattern = F.lit(rf"(?s)<sec\b[^>]*>\s*{label}<title[^>]*>(.*?)</title>(.*?)</sec>")
    heads, bodies = (F.regexp_extract_all(body, pattern, F.lit(i)) for i in (1, 2))
    return F.transform(F.arrays_zip(heads.alias("t"), bodies.alias("b")), lambda x: F.struct(X.strip_tags(x["t"]).alias("title"), x["b"].alias("body")))


def _subsections(body: Column, labelled: bool = False) -> Column:
    """List items of the inner sections as steps."""
    return F.flatten(F.transform(_inner(body, labelled), lambda x: _steps(E.list_items(x["body"]), x["title"])))


def _paragraphs(body: Column, section: Column | str = "") -> Column:
    """Every paragraph of 21 to 1,999 characters as a step, numbered from 1."""
    title = F.lit(section) if isinstance(section, str) else section
    texts = F.filter(F.transform(E.elements(body, "p"), X.strip_tags), lambda t: (F.length(t) > 20) & (F.length(t) < 2000))
    return F.transform(texts, lambda t, i: F.struct((i + 1).cast("string").alias("step_no"), t.alias("text"), title.alias("section"), F.lit("").alias("duration")))


def _listed(reagents: Column, limit: int) -> Column:
    """A materials text made from reagents."""
    lines = F.transform(reagents, lambda r: F.concat(r["name"], F.lit(" ("), r["vendor"], F.lit(", "), r["catalog_id"], F.lit(")")))
    return F.left(F.array_join(lines, "\n"), F.lit(limit))


def _materials(text: Column, reagents: Column, limit: int = 5000, fewest: int = 1) -> Column:
    """A text, or one made from reagents where it is short and there are enough of them."""
    return X.let(text, lambda raw: F.when((F.length(raw) < 150) & (F.size(reagents) >= fewest), _listed(reagents, limit)).otherwise(raw))


def _section_text(body: Column, limit: int = 5000) -> Column:
    return F.left(X.strip_tags(body), F.lit(limit))


def _with_mined(reagents: Column, text: Column, **options: bool) -> Column:
    """With the items that running text names, where fewer than three are listed."""

    def more(listed: Column) -> Column:
        mined = X.let(X.strip_tags(text), lambda t: E.inline_items(t, **options))
        new = X.let(F.transform(listed, lambda r: F.lower(r["name"])), lambda have: F.filter(mined, lambda m: ~F.array_contains(have, F.lower(m["name"]))))
        return F.when(F.size(listed) < 3, F.concat(listed, _reagents(new))).otherwise(listed)

    return X.let(reagents.cast(_REAGENTS), more)


def _problems(body: Column, limit: int = 300) -> Column:
    """List items as problems without a solution."""
    return F.transform(E.list_items(body), lambda i: F.struct(F.left(i["text"], F.lit(limit)).alias("problem"), F.lit("").alias("solution")))


def _pairs(s: Sections) -> Column:
    return E.troubleshooting(s.first("Troubleshooting"))


@register("bioprot")
def bioprot(x: Column, s: Sections) -> dict[str, Column]:
    materials, procedure = s.first("Materials and reagents", "Materials"), s.first("Procedure")
    reagents = _with_mined(_reagents(E.entities(materials)), x)
    return E.metadata(x) | {
        "reagents": reagents,
        "equipment": _equipment(E.entities(s.first("Equipment"))),
        "materials_raw": lambda rs: _materials(_section_text(materials), rs),
        "steps": _cascade(_steps(E.list_items(procedure)), _subsections(procedure), _timed(E.paragraph_steps(procedure))),
        "troubleshooting": _problems(s.first("(?:General notes and )?[Tt]roubleshooting")),
    }


@register("star")
def star(x: Column, s: Sections) -> dict[str, Column]:
    rows = E.resource_rows(E.table_rows(s.first("Key resources table")))
    device = lambda r: r["category"].rlike("|".join(V.EQUIPMENT_CATEGORIES)) | _holds(r["name"], V.EQUIPMENT_WORDS)
    reagents = F.filter(rows, lambda r: ~device(r))
    body, materials = s.first("Step-by-step method details"), s.first("Materials and equipment")
    return E.metadata(x) | {
        "reagents": reagents,
        "equipment": _equipment(F.filter(rows, device)),
        "materials_raw": lambda rs: _materials(_section_text(materials), rs, fewest=5),
        "steps": _cascade(_subsections(body), _steps(E.list_items(body))),
        "troubleshooting": _pairs(s),
        "timing": _section_text(s.first("Timing"), 500),
    }


@register("jove")
def jove(x: Column, s: Sections) -> dict[str, Column]:
    section, body = s.first("Table of [Mm]aterials", "Materials", "Reagents(?: and equipment)?"), s.first(r"Protocol(?:\s+\d+)?")
    rows = E.materials_table(x, section)

    def data(all_rows: Column) -> Column:
        header = F.exists(F.coalesce(F.get(all_rows, 0), F.array().cast("array<string>")), lambda c: _holds(c, V.HEADER_CELLS))
        return F.when(header, F.slice(all_rows, F.lit(2), F.size(all_rows))).otherwise(all_rows)

    def item(r: Column) -> Column:
        probe = F.concat(F.get(r, 0), F.lit(" "), F.when(F.size(r) > 3, F.element_at(r, -1)).otherwise(F.lit("")))
        return F.struct(F.left(F.get(r, 0), F.lit(200)).alias("name"), F.get(r, 1).alias("vendor"), F.coalesce(F.get(r, 2), F.lit("")).alias("catalog_id"), _holds(probe, V.TABLE_EQUIPMENT_WORDS).alias("device"))

    filled = F.filter(X.let(rows, data), lambda r: (F.size(r) >= 2) & F.length(F.get(r, 0)).between(2, 300))
    items = F.transform(filled, item)
    reagents = _with_mined(_reagents(F.filter(items, lambda i: ~i["device"])), x, reject_short_words=True)
    lines = F.transform(F.filter(rows, lambda r: F.size(r) > 0), lambda r: F.array_join(F.filter(r, lambda c: c != ""), " | "))
    raw = F.when(section != "", _section_text(section)).otherwise(F.left(F.array_join(lines, "\n"), F.lit(5000)))
    return E.metadata(x) | {
        "reagents": reagents,
        "equipment": _equipment(F.filter(items, lambda i: i["device"])),
        "materials_raw": lambda rs: _materials(raw, rs, 8000),
        "steps": _cascade(_subsections(body), _steps(E.list_items(body))),
        "troubleshooting": _pairs(s),
    }


@register("curprot")
def curprot(x: Column, s: Sections) -> dict[str, Column]:
    bodies, recipes = s.all("Materials"), s.first("REAGENTS AND SOLUTIONS")
    items = F.flatten(F.transform(bodies, lambda b: E.entities(b)))
    device = lambda i: _holds(i["raw"], V.LISTED_EQUIPMENT_WORDS)
    reagents = _with_mined(_reagents(F.filter(items, lambda i: ~device(i))), x)
    parts = F.concat(F.transform(bodies, X.strip_tags), F.when(recipes != "", F.array(X.strip_tags(recipes))).otherwise(F.array().cast("array<string>")))
    return E.metadata(x) | {
        "reagents": reagents,
        "equipment": _equipment(F.filter(items, device)),
        "materials_raw": lambda rs: _materials(F.left(F.array_join(parts, "\n"), F.lit(8000)), rs, 8000),
        "steps": _timed(E.titled_steps(x)),
        "troubleshooting": _pairs(s),
    }


@register("f1000")
def f1000(x: Column, s: Sections) -> dict[str, Column]:
    materials = s.first(r"Materials(?:\s+and\s+reagents)?", r"Reagents(?:\s+and\s+equipment)?")
    methods, devices = s.first("Methods?", "Protocol"), s.first(r"Equipment(?:\s+setup)?")

    def item(i: Column) -> Column:
        named = F.get(E.mentions(i["text"]), 0)
        return F.struct(
            E.plain_name(i["text"]).alias("name"), F.coalesce(named["vendor"], F.lit("")).alias("vendor"), F.coalesce(named["catalog_id"], F.lit("")).alias("catalog_id")
        )

    fits = lambda i: F.length(i["name"]).between(3, 200)
    listed = F.filter(F.transform(E.list_items(materials), item), fits)
    reagents = _with_mined(_reagents(listed), F.concat(materials, F.lit(" "), methods))
    names = F.filter(F.transform(E.list_items(devices), lambda i: F.struct(E.plain_name(i["text"]).alias("name"), F.lit("").alias("vendor"), F.lit("").alias("catalog_id"))), fits)
    # of the inner sections the first with paragraphs
    told = F.filter(F.transform(_inner(methods), lambda p: _paragraphs(p["body"], p["title"])), lambda found: F.size(found) > 0)
    prose = F.coalesce(F.get(told, 0), F.array().cast(_STEPS))
    return E.metadata(x) | {
        "reagents": reagents,
        "equipment": _equipment(names),
        "materials_raw": lambda rs: _materials(_section_text(materials), rs),
        "steps": _cascade(_steps(E.list_items(methods)), prose, _paragraphs(methods)),
        "troubleshooting": _pairs(s),
    }


@register("mimb")
def mimb(x: Column, s: Sections) -> dict[str, Column]:
    materials, methods = s.first(r"Materials(?:\s+and\s+[Rr]eagents)?"), s.first("Methods", "Procedure")
    reagents = _with_mined(_reagents(E.entities(materials)), x)
    return E.metadata(x) | {
        "reagents": reagents,
        "materials_raw": lambda rs: _materials(_section_text(materials), rs),
        "steps": _cascade(_steps(E.list_items(methods)), _subsections(methods, labelled=True), _timed(E.paragraph_steps(methods)), _paragraphs(methods)),
        "troubleshooting": _cascade(_pairs(s), _problems(s.first("Notes?"))),
    }


@register("nprot")
def nprot(x: Column, s: Sections) -> dict[str, Column]:
    parts = [s.first(t) for t in ("Reagents", "Equipment", "Reagent setup", "Equipment setup")]
    body = s.first("Procedure")
    return E.metadata(x) | {
        "reagents": _reagents(E.entities(parts[0])),
        "equipment": _equipment(E.entities(parts[1])),
        "materials_raw": F.left(F.concat_ws("\n", *[X.strip_tags(p) for p in parts]), F.lit(8000)),
        "steps": _cascade(_subsections(body), _steps(E.list_items(body))),
        "troubleshooting": _cascade(_pairs(s), _problems(s.first("Troubleshooting"), 500)),
        "timing": _section_text(s.first("Timing"), 500),
    }


REGISTRY["nmeth"] = REGISTRY["nprot"]


def _wiki_lines(body: Column) -> Column:
    """List items of 3 to 1,000 characters; where there are fewer than two, numbered paragraphs instead, if there are any."""
    items = F.filter(F.transform(E.elements(body, "li"), X.strip_tags), lambda t: F.length(t).between(3, 1000))
    number = r"(?s)^\s*\d+[.)]\s+(.+)"
    told = F.filter(F.transform(F.transform(E.elements(body, "p"), X.strip_tags), lambda t: F.regexp_extract(t, number, 1)), lambda t: F.length(t) >= 10)
    return X.let(items, lambda found: F.when(F.size(found) >= 2, found).otherwise(X.let(told, lambda ps: F.when(F.size(ps) > 0, F.transform(ps, lambda t: F.trim(t))).otherwise(found))))


@register("oww")
def oww(x: Column, s: Sections) -> dict[str, Column]:
    clean = F.regexp_replace(F.regexp_replace(x, r'(?s)<span class="mw-editsection.*?</span>', ""), r'(?s)<div id="toc"[^>]*>.*?</div>\s*</div>', "")
    lead = F.struct(F.lit("").alias("title"), F.element_at(F.split(clean, r"(?s)<h2\b[^>]*>", 2), 1).alias("body"))
    parts = F.concat(F.array(lead), E.titled_sections(clean))
    holds_materials = lambda p: p["title"].rlike(V.WIKI_MATERIALS)
    holds_steps = lambda p: ~holds_materials(p) & p["title"].rlike(V.WIKI_STEPS)
    other = lambda p: ~holds_materials(p) & ~holds_steps(p) & ~F.trim(p["title"]).rlike(rf"(?i)^(?:{'|'.join(V.WIKI_NO_STEPS)})")

    def item(t: Column, title: Column) -> Column:
        return X.let(
            E.sale(t),
            lambda m: F.struct(
                F.left(E.plain_name(t), F.lit(200)).alias("name"),
                F.coalesce(m["vendor"], F.lit("")).alias("vendor"),
                F.coalesce(m["catalog_id"], F.lit("")).alias("catalog_id"),
                (_holds(t, V.WIKI_EQUIPMENT_WORDS) | title.rlike("(?i)^equipment")).alias("device"),
            ),
        )

    def items_of(p: Column) -> Column:
        lines = F.filter(F.transform(E.elements(p["body"], "li"), X.strip_tags), lambda t: F.length(t).between(3, 1000))
        return F.filter(F.transform(lines, lambda t: item(t, p["title"])), lambda i: F.length(i["name"]) >= 3)

    def steps_of(p: Column) -> Column:
        numbered = F.transform(_wiki_lines(p["body"]), lambda t, i: F.struct((i + 1).cast("string").alias("step_no"), F.left(t, F.lit(2000)).alias("text"), p["title"].alias("section"), F.lit("").alias("duration")))
        return F.filter(numbered, lambda r: F.length(r["text"]) >= 15)

    def steps(all_parts: Column) -> Column:
        own = F.flatten(F.transform(F.filter(all_parts, holds_steps), steps_of))
        more = F.flatten(F.transform(F.filter(all_parts, other), steps_of))
        # those of other headings go on with the numbers of steps kept
        renumbered = lambda first: F.transform(more, lambda r, i: F.struct((F.size(first) + i + 1).cast("string").alias("step_no"), r["text"].alias("text"), r["section"].alias("section"), r["duration"].alias("duration")))
        return X.let(own, lambda found: F.when(F.size(found) >= 3, found).otherwise(F.concat(found, renumbered(found))))

    items = X.let(parts, lambda ps: F.flatten(F.transform(F.filter(ps, holds_materials), items_of)))
    everything = X.let(parts, lambda ps: F.array_join(F.transform(ps, lambda p: p["body"]), " "))
    reagents = _with_mined(_reagents(F.filter(items, lambda i: ~i["device"])), everything, loose=True)
    raw = X.let(parts, lambda ps: F.left(F.array_join(F.transform(F.filter(ps, holds_materials), lambda p: X.strip_tags(p["body"])), "\n"), F.lit(8000)))
    return {
        "journal": F.lit("OpenWetWare"),
        "license": F.lit(V.WIKI_LICENSE),
        "reagents": reagents,
        "equipment": _equipment(F.filter(items, lambda i: i["device"])),
        "materials_raw": lambda rs: _materials(raw, rs, 8000),
        "steps": X.let(parts, steps),
    }
