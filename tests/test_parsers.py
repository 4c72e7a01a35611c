"""Parsers on worked articles, compared field by field."""

from __future__ import annotations

import html
import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from protomill.functions import programs as P
from protomill.functions import text as X
from protomill.operators import extract as E
from protomill.operators import parsers

FRONT = (
    '<article-id pub-id-type="doi">10.1/x</article-id><article-id pub-id-type="pmc">PMC7</article-id><article-id pub-id-type="pmid">9</article-id>'
    "<journal-title>Lab &amp; Bench</journal-title><article-title>A <i>short</i> assay at 37&#xb0;C</article-title><surname>Ito</surname><surname>Roe</surname>"
    "<pub-date><year>2021</year></pub-date><abstract>Why &alpha;-tubulin.</abstract>"
)
TROUBLE = (
    "<sec><title>Troubleshooting</title><sec><title>Problem 1</title><p>No bands.</p></sec><sec><title>Potential solution</title><p>Load more.</p></sec>"
    # a solution counts if another problem follows
    "<sec><title>Problem 2</title><p>Smear.</p></sec><sec><title>Potential solution</title><p>Load less.</p></sec></sec>"
)
TABLE = "<tr><td>Name of Material</td><td>Company</td><td>Number</td></tr><tr><td>Agarose gel</td><td>Acme</td><td>A1</td></tr><tr><td>Tabletop centrifuge</td><td>Spin</td><td>C2</td></tr>"


def item(text, label=""):
    return f"<list-item>{label and f'<label>{label}</label>'}<p>{text}</p></list-item>"


def parsed(spark, source, body):
    docs = spark.createDataFrame([(1, FRONT + body + TROUBLE)], "doc_id long, xml string")
    return parsers.parse(docs, source, "xml", ["doc_id"]).first().asDict(recursive=True)


def names(items):
    return [(i["name"], i["vendor"], i["catalog_id"]) for i in items]


def steps(row):
    return [(s["step_no"], s["text"], s["section"]) for s in row["steps"]]


def devices(row):
    return [(i["name"], i["vendor"], i["model"]) for i in row["equipment"]]


def test_metadata_and_pairs_of_problems(spark):
    row = parsed(spark, "star", "<sec><title>Step-by-step method details</title>" + item("Spin the tube for five minutes.", "1") + "</sec><sec><title>Timing</title><p>2 h</p></sec>")
    want = {"doi": "10.1/x", "pmcid": "PMC7", "pmid": "9", "journal": "Lab & Bench", "pub_year": "2021", "title": "A short assay at 37°C", "abstract": "Why α-tubulin.", "authors": ["Ito", "Roe"]}
    assert {k: row[k] for k in want} == want
    assert row["troubleshooting"] == [{"problem": "No bands.", "solution": "Load more."}]
    assert steps(row) == [("1", "Spin the tube for five minutes.", "")] and row["timing"] == "2 h" and row["parser_version"].startswith("star-")


def test_bioprot(spark):
    body = (
        "<sec><title>Materials and Reagents</title><p>1. Tris buffer solution (Acme, catalog number: T100)</p><p>A. Heading of things</p></sec>"
        "<sec><title>Equipment</title><p>1. Bench centrifuge of any kind (Spin Co, catalog number: C5)</p></sec>"
        "<sec><title>Procedure</title><p>A. Cell Culture</p><p>1. Thaw the cells in a bath.</p><p>2. Spin them down.</p><p>B. Lysis</p><p>1. Add the Blocking serum (Vend Co, BS-22).</p></sec>"
        "<sec><title>General notes and troubleshooting</title>" + item("The cells do not grow at all.") + "</sec>"
    )
    row = parsed(spark, "bioprot", body)
    assert names(row["reagents"])[0] == ("Tris buffer solution", "Acme", "T100") and names(row["reagents"])[-1][1:] == ("Vend Co", "BS-22")
    assert devices(row) == [("Bench centrifuge of any kind", "Spin Co", "C5")]
    assert steps(row) == [("1", "Thaw the cells in a bath.", "A. Cell Culture"), ("2", "Spin them down.", "A. Cell Culture"), ("1", "Add the Blocking serum (Vend Co, BS-22).", "B. Lysis")]
    assert row["troubleshooting"] == [{"problem": "The cells do not grow at all.", "solution": ""}]
    assert row["materials_raw"].startswith("Tris buffer solution (Acme, T100)\n")  # the section is short, so it is made from the reagents


@pytest.mark.parametrize("source, title", [("bioprot", "Procedure"), ("mimb", "Methods"), ("curprot", "Anything"), ("jove", "Protocol"), ("f1000", "Methods")])
def test_reagents_of_running_text_where_few_are_listed(spark, source, title):
    body = (
        "<sec><title>Materials</title>" + item("Tris buffer solution (Acme, T100)") + "</sec>"
        f"<sec><title>{title}</title>" + item("Wash it; Blocking serum (Vend Co, BS-22), and the tris buffer solution (Acme, T100) again.", "1") + "</sec>"
    )
    row = parsed(spark, source, body)
    found = names(row["reagents"])
    assert ("Blocking serum", "Vend Co", "BS-22") in found
    assert sum(n.lower() == "tris buffer solution" for n, _, _ in found) == (source != "jove")  # which has no lists of reagents


def test_star_key_resources(spark):
    cells = lambda *c: "<tr>" + "".join(f"<td>{x}</td>" for x in c) + "</tr>"
    table = (
        cells("REAGENT or RESOURCE", "SOURCE", "IDENTIFIER") + cells("Antibodies", "", "") + cells("Anti-tubulin", "Acme", "Cat# ab290; RRID: AB_303395")
        + cells("Confocal microscope", "Lens Co", "M1") + cells("Software and algorithms") + cells("ImageJ", "NIH", "https://imagej.net") + cells("two", "cells")
    )
    body = f"<sec><title>Key resources table</title><table-wrap>{table}</table-wrap></sec><sec><title>Step-by-step method details</title><sec><title>Lysis</title>" + item("Add the lysis buffer.", "1") + "</sec></sec>"
    row = parsed(spark, "star", body)
    assert row["reagents"] == [{"name": "Anti-tubulin", "vendor": "Acme", "catalog_id": "ab290", "rrid": "AB_303395", "category": "antibodies"}]
    assert devices(row) == [("Confocal microscope", "Lens Co", "M1"), ("ImageJ", "NIH", "https://imagej.net")]
    assert steps(row) == [("1", "Add the lysis buffer.", "Lysis")] and row["materials_raw"] == ""


def test_jove_table_and_protocol(spark):
    table = "<tr><td>Name</td><td>Company</td></tr><tr><td>Reference material 1941b</td><td>NIST</td><td>19</td></tr><tr><td>Rocking shaker</td><td>Rock</td><td>S1</td></tr><tr><td>Tube</td><td>T</td><td>9</td><td>for the incubator</td></tr><tr><td>alone</td></tr>"
    long = "All of these have to be at hand before the work begins. " * 4
    body = f"<sec><title>Materials</title><p>{long}</p><table-wrap>{table}</table-wrap></sec><sec><title>Protocol 1</title>" + item("Use the Neurobasal medium now.", "1") + "</sec><p>Then; Neurobasal medium (Gibco, 21103049)</p><p>Nothing here (Vend, abc)</p>"
    row = parsed(spark, "jove", body)
    assert names(row["reagents"]) == [("Reference material 1941b", "NIST", "19"), ("Neurobasal medium", "Gibco", "21103049")]
    assert devices(row) == [("Rocking shaker", "Rock", "S1"), ("Tube", "T", "9")]
    assert row["materials_raw"].startswith("All of these have") and steps(row) == [("1", "Use the Neurobasal medium now.", "")]


@pytest.mark.parametrize(
    "body",
    [
        f"<sec><title>Table of Materials</title><table-wrap>{TABLE}</table-wrap></sec>",
        f"<table-wrap><caption>Other</caption><tr><td>x</td></tr></table-wrap><table-wrap><caption><p>Table of Materials</p></caption>{TABLE}</table-wrap>",
        f"<table-wrap><caption>Other</caption><tr><td>x</td></tr></table-wrap><table-wrap>{TABLE}</table-wrap>",
    ],
)
def test_the_table_of_materials_is_found(spark, body):
    row = parsed(spark, "jove", body)
    assert names(row["reagents"]) == [("Agarose gel", "Acme", "A1")] and devices(row) == [("Tabletop centrifuge", "Spin", "C2")]


def test_no_table_of_materials(spark):
    assert parsed(spark, "jove", "<table-wrap><caption>Other</caption><tr><td>x</td></tr></table-wrap>")["reagents"] == []


def test_curprot_steps_carry_the_title(spark):
    body = (
        "<sec><title>Materials</title>" + item("Sonicator with a fine tip (Son, S9)") + item("Sodium chloride of any grade (Salt Co, NA-1)") + "</sec>"
        "<sec><title>Harvest</title>" + item("Collect the cells.", "1") + item("2. This is a note that has no label.") + item("Spin again for long.", "2a.") + item("short", "3") + "</sec>"
        "<sec><title>REAGENTS AND SOLUTIONS</title><p>" + "Mix the salts in water and keep them cold. " * 4 + "</p></sec>"
    )
    row = parsed(spark, "curprot", body)
    assert steps(row) == [("1", "Collect the cells.", "Harvest"), ("2a", "Spin again for long.", "Harvest")]
    assert names(row["reagents"])[0] == ("Sodium chloride of any grade", "Salt Co", "NA-1") and devices(row) == [("Sonicator with a fine tip", "Son", "S9")]
    assert "Mix the salts" in row["materials_raw"]


def test_f1000_lists_and_prose(spark):
    body = (
        "<sec><title>Reagents and equipment</title>" + item("Agarose powder, molecular grade (Acme, A100)") + item("Ethanol at seventy percent.") + "</sec>"
        "<sec><title>Equipment setup</title>" + item("Heating block with a lid, any kind") + "</sec>"
        "<sec><title>Methods</title><sec><title>Prep</title><p>Warm all buffers to room temperature.</p><p>short</p><p>Label every tube on its side.</p></sec><sec><title>Run</title><p>Load the gel and run it for an hour.</p></sec></sec>"
    )
    row = parsed(spark, "f1000", body)
    assert names(row["reagents"])[:2] == [("Agarose powder", "Acme", "A100"), ("Ethanol at seventy percent", "", "")]
    assert devices(row) == [("Heating block with a lid", "", "")]
    assert steps(row) == [("1", "Warm all buffers to room temperature.", "Prep"), ("2", "Label every tube on its side.", "Prep")]


def test_mimb_cascade_and_notes(spark):
    text = "<sec><title>Methods</title><p>Mix both parts in one tube.</p><p>short</p><p>Leave on ice for one hour.</p></sec><sec><title>Notes</title>" + item("Keep it dark at all times.") + "</sec>"
    docs = spark.createDataFrame([(1, text)], "doc_id long, xml string")
    row = parsers.parse(docs, "mimb", "xml", ["doc_id"]).first().asDict(recursive=True)
    assert steps(row) == [("1", "Mix both parts in one tube.", ""), ("2", "Leave on ice for one hour.", "")]
    assert row["troubleshooting"] == [{"problem": "Keep it dark at all times.", "solution": ""}]
    numbered = "<sec><title>Methods</title><p>A. Part One</p><p>1. Mix both parts in one tube.</p><p>2. Leave on ice for one hour.</p></sec>"
    assert steps(parsed(spark, "mimb", numbered)) == [("1", "Mix both parts in one tube.", "A. Part One"), ("2", "Leave on ice for one hour.", "A. Part One")]
    labelled = "<sec><title>Methods</title><sec><label>2.1</label><title>Lysis</title><list><list-item><p>Add the lysis buffer.</p></list-item></list></sec></sec>"
    assert [t for _, t, _ in steps(parsed(spark, "mimb", labelled))] == ["Add the lysis buffer."]


def test_nprot_prefers_subsections(spark):
    body = (
        "<sec><title>Reagents</title>" + item("Sodium chloride of any grade (Salt Co, NA-1)") + "</sec><sec><title>Equipment</title>" + item("Water bath with a lid (Bath, B1)") + "</sec>"
        "<sec><title>Equipment setup</title><p>Warm the bath.</p></sec><sec><title>Procedure</title>" + item("Outside of any part, this one.", "0") + "<sec><title>Lysis</title>" + item("Add the lysis buffer.", "1") + "</sec></sec>"
    )
    row = parsed(spark, "nprot", body)
    assert steps(row) == [("1", "Add the lysis buffer.", "Lysis")]
    assert row["materials_raw"] == "Sodium chloride of any grade (Salt Co, NA-1)\nWater bath with a lid (Bath, B1)\n\nWarm the bath."
    assert names(row["reagents"]) == [("Sodium chloride of any grade", "Salt Co", "NA-1")] and devices(row) == [("Water bath with a lid", "Bath", "B1")]


def test_wiki_pages(spark):
    html = (
        '<div id="toc" class="x"><div><h2>Contents</h2></div>\n</div><h2>Materials<span class="mw-editsection">[edit]</span></h2><ul><li>Taq polymerase (NEB, cat# M0273)</li><li>Bench centrifuge</li><li>Tip</li></ul>'
        "<h2>Procedure</h2><ol><li>Mix everything on ice for long.</li><li>short one</li></ol><h2>References</h2><ul><li>A paper that is quite long.</li><li>Another one.</li></ul>"
        "<h2>cDNA Synthesis</h2><p>1. Heat the tube to 42 degrees.</p><p>2) Cool it down again now.</p>"
    )
    docs = spark.createDataFrame([(1, html)], "doc_id long, xml string")
    row = parsers.parse(docs, "oww", "xml", ["doc_id"]).first().asDict(recursive=True)
    assert names(row["reagents"])[:2] == [("Taq polymerase", "NEB", "M0273"), ("Tip", "", "")] and devices(row) == [("Bench centrifuge", "", "")]
    assert steps(row) == [("1", "Mix everything on ice for long.", "Procedure"), ("2", "Heat the tube to 42 degrees.", "cDNA Synthesis"), ("3", "Cool it down again now.", "cDNA Synthesis")]
    assert row["license"].endswith("/by/3.0/") and row["journal"] == "OpenWetWare"


def by_counting(xml, title):
    """Sections by a counter of open tags, as the definition says."""
    head = re.compile(rf"<sec\b[^>]*>\s*(?:<label[^>]*>[^<]*</label>\s*)?<title[^>]*>\s*(?:{title})\s*</title>", re.I | re.S)
    out = []
    for m in head.finditer(xml):
        depth = 0
        for tag in re.finditer(r"</?sec\b[^>]*>", xml[m.start() :]):
            depth += -1 if tag.group().startswith("</") else 1
            if depth == 0:
                out.append(xml[m.end() : m.start() + tag.start()])
                break
    return out


def test_sections_nested_and_unclosed(spark):
    rng = random.Random(8)
    parts = ["<sec>", "<sec id='a'>", "</sec>", "<title>A</title>", "<sec><title> A </title>", "<sec><label>1</label><title>A</title>", "<sec><title>B</title>", "text ", "<section>", "</sec>"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randrange(14)))) for i in range(300)]
    got = spark.createDataFrame(rows, "i int, xml string").select("i", E.sections(F.col("xml"), "A").alias("s")).collect()
    assert {r["i"]: r["s"] for r in got} == {i: by_counting(x, "A") for i, x in rows}


def test_problems_and_solutions(spark):
    t = lambda *parts: "".join(f"<title>{h}</title><p>{b}</p>" for h, b in parts)
    bodies = [
        t(("Problem 1", "a"), ("Potential solution", "b"), ("Problem 2", "c"), ("Potential solution", "d"), ("Problem 3", "e")),
        t(("Problem", "a"), ("Detail", "x"), ("Potential solution", "b"), ("Potential solution", "b2"), ("problem 2", "c")),
        t(("Problem", "a"), ("Potential solution", "b")),
        "",
    ]
    rows = spark.createDataFrame(list(enumerate(bodies)), "i int, b string").select("i", E.troubleshooting(F.col("b")).alias("p")).collect()
    got = {r["i"]: [tuple(x) for x in r["p"]] for r in rows}
    assert got == {0: [("a", "b"), ("c", "d")], 1: [("a Detail x", "b Potential solution b2")], 2: [], 3: []}


def test_each_row_by_its_own_parser(spark):
    xml = FRONT + "<sec><title>Materials</title>" + item("Tris buffer solution (Acme, T100)") + "</sec><sec><title>Procedure</title>" + item("Spin the tube for five minutes.", "1") + "</sec>"
    kinds = sorted(parsers.REGISTRY)
    docs = spark.createDataFrame([(i, k, xml) for i, k in enumerate([*kinds, "other"])], "i int, kind string, xml string")
    together = {r["i"]: r.asDict(recursive=True) for r in parsers.parse_each(docs, "kind", "xml", ["i"]).collect()}
    assert sorted(together) == list(range(len(kinds)))
    for i in (0, 4):
        assert parsers.parse(docs.where(F.col("i") == i), kinds[i], "xml", ["i"]).first().asDict(recursive=True) == together[i]


def test_entities_equal_the_standard_library(spark):
    texts = ["&lt;b&gt; &amp;lt; &amp;amp; &#38;lt;", "5&#x2009;&micro;l, &alpha;&beta; &#945; &#x3B1;", "&deg;C &nbsp;x &apos; &quot;q&quot; &times;", "&nosuch; & && &; a&b;", "&#128512; &#x1F600; caf&eacute;", "plain", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", X.unescape(F.col("t")).alias("u")).collect()
    assert {r["i"]: r["u"] for r in rows} == {i: t if t is None else html.unescape(t) for i, t in enumerate(texts)}


def test_first_names(spark):
    items = F.expr("array(named_struct('name', 'Ab'), named_struct('name', 'x'), named_struct('name', 'aB'))")
    assert [r["name"] for r in spark.range(1).select(E.first_names(items).alias("a")).first()["a"]] == ["Ab", "x"]


def longest_pairs(gold, pred):
    """All longest common subsequences as index pairs, by trying every choice of gold indices."""
    for size in range(min(len(gold), len(pred)), 0, -1):
        found = [
            list(zip(a, b, strict=True))
            for a in itertools.combinations(range(len(gold)), size)
            for b in itertools.combinations(range(len(pred)), size)
            if [gold[i] for i in a] == [pred[j] for j in b]
        ]
        if found:
            return found
    return [[]]


def by_rule(gold, pred, i=0, j=0):
    """Equal actions pair; else the gold index advances unless that loses a pair."""
    if i == len(gold) or j == len(pred):
        return []
    if gold[i] == pred[j]:
        return [(i, j), *by_rule(gold, pred, i + 1, j + 1)]
    return max(by_rule(gold, pred, i + 1, j), by_rule(gold, pred, i, j + 1), key=len)


def test_alignment_is_a_longest_one_and_gold_advances_first():
    rng = random.Random(4)
    for _ in range(150):
        gold, pred = ([rng.choice("abc") for _ in range(rng.randrange(6))] for _ in range(2))
        options = longest_pairs(gold, pred)
        got = P.aligned(gold, pred)
        assert got in options
        assert got == by_rule(gold, pred)
