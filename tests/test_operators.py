"""Worked examples and edge cases of the library's own operators."""

from __future__ import annotations

import base64
import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from protomill.functions import answers as A
from protomill.functions import fixed_values as V
from protomill.functions import programs as P
from protomill.functions import text as X
from protomill.operators import extract as E
from protomill.operators import items as I
from protomill.operators import matching as M
from protomill.operators import metrics
from protomill.operators import records as R
from protomill.operators import steps as S


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


def test_normalize_and_keys(spark):
    assert one(spark, X.normalize(F.lit(" a  b\n"))) == "a b"
    assert one(spark, X.normalize(F.lit(None).cast("string"))) == ""
    assert one(spark, X.search_key(F.lit("10 µL of 1.5-mL"))) == "10 ul of 1 5 ml"


@pytest.mark.parametrize("given, want", [("star:PMC1", "star"), ("x", "unknown"), (":y", "unknown")])
def test_source_of_id(spark, given, want):
    assert one(spark, X.source_of_id(F.lit(given))) == want


def test_compact(spark):
    assert one(spark, X.compact(F.lit("abcdefghijkl"), 10)) == "abcdefghi..."
    assert one(spark, X.compact(F.lit("abcdefghijkl"), 10, exact=True)) == "abcdefg..."


@pytest.mark.parametrize("size", [0, 57, 58, 500])
def test_data_url_is_one_line(spark, size):
    content = bytes(i % 251 for i in range(size))
    assert one(spark, X.data_url(F.lit(bytearray(content)), F.lit("a.PNG"))) == "data:image/png;base64," + base64.b64encode(content).decode()
    assert one(spark, X.data_url(F.lit(bytearray(content)), F.lit("a.gif"))) is None


def test_qc_score(spark):
    yes, no = F.lit(True), F.lit(False)
    assert one(spark, X.qc_score(F.lit(10), F.lit(3), F.lit(20), yes, no, yes)) == 0.95
    assert one(spark, X.qc_score(F.lit(5), F.lit(1), F.lit(10), no, no, no)) == 0.367


@pytest.mark.parametrize("value, variant, want", [(5, 0, 4), (5, 1, 6), (1, 0, 2), (1500, 0, 1400)])
def test_perturbed(spark, value, variant, want):
    assert one(spark, X.perturbed(F.lit(value), X.numeric_step(F.lit(value)), F.lit(variant))) == want


def test_numbers_agree(spark):
    assert one(spark, X.numbers_agree(F.lit(100.0), F.lit(110.0)))
    assert not one(spark, X.numbers_agree(F.lit(100.0), F.lit(112.0)))


@pytest.mark.parametrize(
    "reply, want",
    [
        ("Final Answer: B", "B"),
        ("some reasoning\nFinal Answer: B", "B"),
        ("<answer>A</answer> <answer>B</answer>", None),
        ("<answer> c </answer>", "C"),
        ('```json\n{"answer": "D", "reasoning": "x"}\n```', "D"),
        ("The answer is a bit unclear", "A"),
        ("nothing", None),
        ("Final Answer: Z", None),
        ("", None),
    ],
)
def test_answer_letter(spark, reply, want):
    assert one(spark, A.answer_letter(F.lit(reply))) == want


def test_reasoning_steps(spark):
    assert one(spark, A.reasoning_steps(F.lit("1. one\n- two\n\nthree"))) == ["one", "two", "three"]
    assert one(spark, A.reasoning_steps(F.lit("First. Then this!"))) == ["First.", "Then this!"]


def test_stage_fill_drops_empty_rows_first(spark):
    raw = spark.createDataFrame([(1, 1, "", "a"), (1, 2, "A", "b"), (1, 3, "", "c"), (1, 4, "B", ""), (1, 5, "", "d")], "id int, pos int, section string, text string")
    titles = spark.createDataFrame([(1, "T")], "id int, title string")
    got = S.build_steps(raw, titles, "id", "pos").orderBy("idx").collect()
    assert [r["stage"] for r in got] == ["T", "A", "A", "A"]
    assert [r["fallback"] for r in got] == [True, False, False, False]


def test_window_count_and_score(spark):
    rows = [(1, i, "s", f"step {i} with enough text") for i in range(1, 13)]
    steps = spark.createDataFrame(rows, "doc_id int, idx int, stage string, description string")
    w = S.sliding_windows(S.step_features(steps), S.window_lengths(6, 10), list(V.FAMILY_PATTERNS))
    assert {r["length"]: r["count"] for r in w.groupBy("length").count().collect()} == {6: 7, 8: 5, 10: 3}


def test_score_of_a_known_window(spark):
    texts = ["add 1 item to the tube", "add 2 items to the tube", "transfer 3 items to it now", "mix everything very well", "vortex it for a while 4", "look at the whole of it"]
    steps = spark.createDataFrame([(1, i, "s", t) for i, t in enumerate(texts)], "doc_id int, idx int, stage string, description string")
    w = S.score_windows(S.sliding_windows(S.step_features(steps), [6], list(V.FAMILY_PATTERNS)), list(V.FAMILY_PATTERNS))
    assert w.first()["score"] == 35.5


def test_capped_selection_equals_the_greedy_loop(spark):
    rng = random.Random(4)
    rows = [(i, rng.randrange(12), rng.randrange(40)) for i in range(200)]
    df = spark.createDataFrame(rows, "k int, g int, s int")
    got = [r["k"] for r in S.select_capped(df, "g", [F.desc("s"), F.col("k")], 2, 15).orderBy(F.desc("s"), "k").collect()]
    taken, want = {}, []
    for k, g, s in sorted(rows, key=lambda r: (-r[2], r[0])):
        if taken.get(g, 0) < 2 and len(want) < 15:
            taken[g] = taken.get(g, 0) + 1
            want.append(k)
    assert got == want


def test_gate_flags(spark):
    row = [(3, 0, 3, 0, "m" * 150, "t", "", "", "", "")]
    df = spark.createDataFrame(row, "n_reagents int, n_equipment int, n_steps int, n_troubleshooting int, materials_raw string, title string, doi string, pmcid string, timing string, abstract string")
    got = R.quality_gate(df).first()
    assert got["qc_pass"] and got["qc_flags"] == ["no_id"]


def test_duplicate_id_needs_a_kept_row(spark):
    rows = [(1, "p", 0), (2, "p", 9), (3, "p", 9)]
    df = spark.createDataFrame(rows, "n int, id string, r int").select("n", "id", F.lit("t").alias("title"), F.lit("b").alias("background"), F.col("r").alias("n_reagents"), *[F.lit(50).alias(c) for c in ("n_equipment", "n_steps", "n_stages")])
    got = [r["reasons"] for r in R.minimal_gate(df, [F.col("n")]).orderBy("n").collect()]
    assert got == [["reagents"], [], ["duplicate_id"]]


def test_dedupe_items(spark):
    df = spark.createDataFrame([(1, 1, "X", "v", "i"), (1, 2, "x", "V", "i"), (1, 3, "", "v", "i")], "id int, pos int, name string, vendor string, identifier string")
    assert [r["name"] for r in R.dedupe_items(df, "id", "pos").collect()] == ["X"]


def test_upper_medians(spark):
    df = spark.createDataFrame([("g", x) for x in (1, 2, 3, 10)], "g string, x int")
    assert R.upper_medians(df, "g", ["x"]).first()["median_x"] == 3
    assert df.groupBy("g").agg(R.upper_median(F.col("x")).alias("m")).first()["m"] == 3


def test_alias_join_equals_the_pattern_form(spark):
    texts = ["use 10 mL tubes", "use 10-mL tube.", "110 ml tube", "a 1.5 ml screw cap tube here", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, t string").select("id", X.search_key(F.col("t")).alias("c"))
    aliases = M.alias_table(spark)
    fast, slow = M.match_aliases(docs, aliases, "id", "c").collect(), M.match_by_pattern(docs, aliases, "id", "c").collect()
    assert sorted(fast) == sorted(slow)
    assert {r["id"] for r in fast if r["group_id"] == "centrifuge_tube_10ml"} == {0, 1}


def test_sequence_similarity(spark):
    make = lambda s: spark.createDataFrame([(i, k, a) for i, x in enumerate(s) for k, a in enumerate(x)], "id int, pos int, action string")
    gold, pred = make(["alsp", "ab", "a"]), make(["aslp", "ac", "a"])
    got = {r["id"]: r["similarity"] for r in metrics.sequence_similarity(gold, pred, "id", "pos", "action").collect()}
    assert got == {0: round(1 - 1 / 6, 6), 1: 0.0, 2: 1.0}
    for g, p in (("alsp", "aslp"), ("ab", "ac"), ("a", "a")):
        assert round(P.sequence_similarity(list(g), list(p)), 6) in got.values()
    flat = {r["id"]: r["similarity"] for r in metrics.positional_similarity(make(["abc"]), make(["ac"]), "id", "pos", "action").collect()}
    assert flat == {0: round(1 / 3, 6)}


def test_programs():
    gold = P.steps_of("a = f(x=tube, n=1)\nb = g(x=a, n=100)")
    assert P.compare(gold, gold, {"tube"})["final"] == 1.0
    near = P.steps_of("p = f(x=tube, n=1)\nq = g(x=p, n=105)")
    score = P.compare(gold, near, {"tube"})
    assert score["parameters"] == 0.5 and score["relaxed_parameters"] == 1.0
    assert P.aligned(list("abc"), list("bac")) == [(1, 0), (2, 2)]
    assert P.program_in("text\n```python\nx = f(a=1)\n```") == "x = f(a=1)"
    assert P.program_in("f(1)") is None and P.program_in("") is None
    with pytest.raises(ValueError):
        P.steps_of("x = 1")


def test_numeric_literals(spark):
    assert one(spark, P.numeric_literals(F.lit("x=f(a=-5,b=True,c=3)"))) == 4


def test_sections_are_balanced(spark):
    xml = "<sec><title>A</title>one<sec><title>B</title>two</sec>three</sec><sec><title>A</title>four</sec>"
    assert one(spark, E.sections(F.lit(xml), "A")) == ["one<sec><title>B</title>two</sec>three", "four"]
    assert one(spark, E.sections(F.lit("<sec><title>A</title>open"), "A")) == []


def test_list_items_and_tables(spark):
    xml = F.lit("<list-item><label>1a</label><p>long enough to be kept</p></list-item><list-item>2) another one that is long</list-item><list-item>no</list-item>")
    assert [(r["num"], r["text"]) for r in one(spark, E.list_items(xml))] == [("1a", "long enough to be kept"), ("2", "another one that is long")]
    assert one(spark, E.table_rows(F.lit("<tr><th>a</th><th>b</th></tr><tr><td>1</td></tr>"))) == [["a", "b"], ["1"]]


def test_quota_letters(spark):
    got = I.quota_letters(spark.range(20), "id").groupBy("letter").count().collect()
    assert {r["letter"]: r["count"] for r in got} == {"J": 4, **dict.fromkeys("ABCDEFG", 2), "H": 1, "I": 1}


def test_action_pool(spark):
    families = F.array(*[F.lit(f) for f in ("centrifuge", "incubate", "mix", "separate", "transfer", "wash")])
    pool = one(spark, S.action_pool(families, F.lit(False), F.lit(True)))
    assert len(pool) == 14 and "magnetic_separate" in pool and "transfer_liquid" not in pool


def test_generate_retries_with_the_reason(spark):
    df = spark.createDataFrame([("p",)], "prompt string")
    got = I.generate(df, "prompt", lambda p: "ok" if "refused" in p else "no", lambda r: None if r == "ok" else "bad").first()
    assert (got["result"], got["tries"]) == ("ok", 2)


@pytest.mark.parametrize(
    "gold, other, want",
    [
        ("f(a=1, b='x')", "f(a=2, b='x')", True),
        ("f(a=1, b='x')", "f(a=1, b='y')", False),
        ("f(a=1, b=1)", "f(a=2, b=2)", False),
        ("f(a=1)", "g(a=2)", False),
        ("f(a=1)", "f(b=1)", False),
        ("f(a=1)", "f(a=1)", False),
        ("f(a=1", "f(a=2)", False),
    ],
)
def test_one_number_apart(gold, other, want):
    assert I.one_number_apart(gold, other) is want


def test_repair_family(spark):
    rows = [(1, k, o, "A") for k, o in zip("ABCD", ["f(n=1)", "f(n=1)", "g(n=1)", "f(n=2)"], strict=True)] + [(2, "A", "f()", "A"), (2, "B", "g()", "A"), (3, "A", "x", None), (3, "J", None, None)]
    df = spark.createDataFrame(rows, "id int, letter string, option string, answer string")
    got = {(r["id"], r["letter"]): r["option"] for r in I.repair_family(df, "id").collect()}
    assert [got[1, k] for k in "ABCD"] == ["f(n=1)", "f(n=3)", "f(n=4)", "f(n=2)"]  # 2 is taken by D
    assert (got[2, "B"], got[3, "A"], got[3, "J"]) == ("g()", "x", None)  # a call without a number repairs nothing
    assert I.repair_family(df.where("id > 9"), "id").count() == 0


def test_generate_holds_few_prompts_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(I, "PIECE_BYTES", 50)
    df = spark.range(40).repartition(1).select("id", F.when(F.col("id") % 4 > 0, F.concat(F.lit("prompt "), "id")).alias("p"), F.array("id").alias("more"))
    made = I.generate(df, "p", lambda p: p.upper(), lambda r: None)
    assert "MapInPandas" not in plan_of(made)
    want = sorted((i, [i], f"PROMPT {i}" if i % 4 else None, None if i % 4 else "no prompt", min(i % 4, 1)) for i in range(40))
    assert sorted((r["id"], r["more"], r["result"], r["error"], r["tries"]) for r in made.collect()) == want


def test_programs_are_parsed_in_pieces(monkeypatch):
    held = []

    def one(x):
        held.append(x)
        return x and x + x

    monkeypatch.setattr(P, "PIECE_ROWS", 3)
    values = pa.array(["a", None, "b", "", "c", "d", "e"])
    assert P.in_pieces(values, one, pa.string()).to_pylist() == ["aa", None, "bb", "", "cc", "dd", "ee"] and len(held) == 7
    assert len(P.in_pieces(values.slice(7), one, pa.string())) == 0


def test_guarded_patterns_find_the_same():
    rng = random.Random(3)
    assert X.guarded("a+b|c") == "a+b|c"
    for pattern in V.FAMILY_PATTERNS.values():
        words = pattern.replace(r"\b", "").split("|")
        assert X.guarded(pattern) != pattern
        for _ in range(500):
            text = "".join(rng.choice([*words, " ", "s", "re", "_", "1", "-"]) for _ in range(6))
            assert bool(re.search(pattern, text)) == bool(re.search(X.guarded(pattern), text))


def plan_of(df):
    return df._jdf.queryExecution().toString()


def test_repair_repeats(spark):
    """Other columns stay, null texts and items of one option too; items are not groups of a Python task."""
    rows = [(1, k, o, {"k": k}) for k, o in zip("DCBA", ["f(n=1)", "f(n=1)", "f(n=2)", "f(n=1)"], strict=True)]
    rows += [(2, "A", "f()", None), (2, "B", "f()", None), (3, "A", None, None), (3, None, None, None), (None, "A", "x", None), (None, "B", "x 1", None)]
    df = spark.createDataFrame(rows, "id int, letter string, option string, more map<string,string>")
    fixed = I.repair_repeats(df, "id")
    assert fixed.schema.simpleString() == df.schema.simpleString() and "FlatMapGroupsInPandas" not in plan_of(fixed)
    got = {(r["id"], r["letter"]): (r["option"], r["more"]) for r in fixed.collect()}
    assert [got[1, k] for k in "ABCD"] == [("f(n=1)", {"k": "A"}), ("f(n=2)", {"k": "B"}), ("f(n=3)", {"k": "C"}), ("f(n=4)", {"k": "D"})]
    assert [got[i][0] for i in ((2, "A"), (2, "B"), (3, "A"), (3, None), (None, "A"), (None, "B"))] == ["f()", "f()", None, None, "x", "x 1"]


def test_repair_family_takes_batches_of_items(spark):
    rows = [(i, k, f"f(n={i % 3 + 2})", answer) for i, answer in enumerate(["A", "C", "E", "J", "", None] * 5) for k in "CBADEJ"]
    df = spark.createDataFrame(rows, "id int, letter string, option string, answer string")
    fixed = I.repair_family(df, "id")
    assert "FlatMapGroupsInPandas" not in plan_of(fixed)
    want = {}
    for i, answer in enumerate(["A", "C", "E", "J", "", None] * 5):
        gold = f"f(n={i % 3 + 2})"
        texts = dict.fromkeys("ABCDEJ", gold)
        for k in {"A": "BC", "C": "AB", "E": "D"}.get(answer, ""):
            texts[k] = next(t for t in (I.moved(gold, n) for n in range(12)) if t not in [o for x, o in texts.items() if x != k])
        want |= {(i, k): t for k, t in texts.items()}
    assert {(r["id"], r["letter"]): r["option"] for r in fixed.collect()} == want


def test_groups_of_equals_the_join(spark):
    texts = ["use 10 mL tubes", "use 10-mL tube.", "110 ml tube", "a 1.5 ml screw cap tube here", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, t string").select("id", X.search_key(F.col("t")).alias("c"))
    want = sorted(tuple(r) for r in M.match_aliases(docs, M.alias_table(spark), "id", "c").collect())
    assert sorted(tuple(r) for r in docs.select("id", F.explode(M.groups_of(F.col("c")))).collect()) == want


def test_records_with_missing_parts(spark):
    df = spark.createDataFrame([("s", "PMC1", "d", None), ("s", "", "d", ""), ("s", None, None, "CC")], "source string, pmcid string, doi string, license string")
    got = R.with_defaults(df, license="unknown").select(R.record_id(F.col("source"), F.col("pmcid"), F.col("doi")), "license").collect()
    assert [tuple(r) for r in got] == [("s:PMC1", "unknown"), ("s:d", "unknown"), ("s", "CC")]
    pair = "array<struct<problem:string,solution:string>>"
    item = lambda key: f"array<struct<name:string,{key}:string>>"
    rows = [("t", "", [("r", "c1")], [("e", "m1")], [("", ""), ("", "s")]), ("t", "a", None, [], None)]
    full = R.minimal_record(spark.createDataFrame(rows, f"title string, abstract string, reagents {item('catalog_id')}, equipment {item('model')}, troubleshooting {pair}")).collect()
    assert [r["background"] for r in full] == ["t", "a"]
    assert full[0]["materials"]["equipment"][0]["identifier"] == "m1" and len(full[0]["procedure"]["troubleshooting"]) == 1
    assert full[1]["materials"]["reagents"] is None and full[1]["procedure"]["troubleshooting"] is None


def test_run_counters(spark):
    rows = [("a", True, None, None), ("a", False, "timeout", None), ("a", False, None, True), ("a", False, None, False)]
    df = spark.createDataFrame(rows, "source string, skipped boolean, error string, qc_pass boolean")
    assert R.run_counters(df, "source").first().asDict() == {"source": "a", "skipped": 1, "fetched": 3, "errors": 1, "parsed": 2, "passed": 1, "failed": 1}


def test_assign_gives_each_entry_its_turns(spark):
    df = spark.createDataFrame([(e, i) for e in "abc" for i in range(3 + ord(e) - 97)], "entry string, item int")
    got = I.assign(df, "entry", "item", count=100, seed=1).collect()
    for e in "abc":
        mine = sorted((r["round"], r["item"]) for r in got if r["entry"] == e)
        assert [m[0] for m in mine] == list(range(1, 3 + ord(e) - 97 + 1)) and len({m[1] for m in mine}) == len(mine)
    assert I.assign(df.limit(0), "entry", "item", count=3).count() == 0


def test_some_views_are_drawn_from_those_that_exist(spark):
    views = F.map_from_arrays(F.array(*[F.lit(v) for v in ("back", "front", "left", "odd", "top")]), F.array(*[F.lit("x")] * 5))
    preferred = ["front", "right", "left", "top", "back"]
    draws = {tuple(one(spark, I.some_views(views, preferred, seed=s))) for s in range(20)}
    assert len(draws) > 1 and all(len(d) == 3 and list(d) == [v for v in preferred if v in d] and "right" not in d and "odd" not in d for d in draws)


def test_inversions_equal_the_quadratic_count(spark):
    import random

    from protomill.operators import metrics as M

    rng = random.Random(3)
    rows, want = [], {}
    for who, n in enumerate((1, 2, 7, 40, 100)):
        order = list(range(1, n + 1))
        rng.shuffle(order)
        rows += [(who, i, j) for i, j in enumerate(order, 1)]
        want[who] = sum(order[a] > order[b] for a in range(n) for b in range(a + 1, n))
    df = spark.createDataFrame(rows, "who long, i int, j int").repartition(3)
    for block in (4, 4096):
        assert {r["who"]: r["inversions"] for r in M.inversions(df, "who", "i", "j", block).collect()} == {k: v for k, v in want.items() if v}


def test_inversions_of_a_long_sequence(spark):
    from protomill.operators import metrics as M

    n = 50_000
    df = spark.range(1, n + 1).selectExpr("1 as who", "id as i", f"{n} + 1 - id as j")
    assert M.inversions(df, "who", "i", "j").first()["inversions"] == n * (n - 1) // 2


def one_after_the_other(pairs, count, late, seed):
    """Jobs by entries that choose in turn, by the definition; pairs are (entry, item, hash), entries (entry, hash)."""
    turn = lambda e: (late.get(e, False), pairs["entries"][e], e)
    jobs, used, had = [], set(), set()
    number = 0
    while len(jobs) < count:
        number += 1
        before = len(jobs)
        for e in sorted(pairs["entries"], key=turn):
            mine = sorted((h, i) for (x, i), h in pairs["wishes"].items() if x == e and (e, i) not in had)
            if not mine or len(jobs) >= count:
                continue
            _, i = next(((h, i) for h, i in mine if i not in used), mine[0])
            jobs.append((e, i, number))
            used.add(i)
            had.add((e, i))
        if len(jobs) == before:
            break
    return jobs


def test_jobs_are_dealt_as_if_entries_chose_in_turn(spark):
    import random

    from protomill.operators import items as I

    rng = random.Random(5)
    pairs = sorted({(rng.choice("abcde"), rng.randrange(6)) for _ in range(18)})
    late = {"a": True, "d": True}
    df = spark.createDataFrame([(e, i, late.get(e, False)) for e, i in pairs] + [("a", None, None), pairs[0] + (False,)], "e string, i int, late boolean")
    hashed = df.where("i is not null").select("e", "i", F.xxhash64("e", "i", F.lit(3)).alias("h"), F.xxhash64("e", F.lit(3)).alias("eh")).collect()
    known = {"entries": {r["e"]: r["eh"] for r in hashed}, "wishes": {(r["e"], r["i"]): r["h"] for r in hashed}}
    for count in (7, 100):
        got = [(r["e"], r["i"], r["round"]) for r in I.assign(df, "e", "i", count, last="late", seed=3).collect()]
        assert sorted(got) == sorted(one_after_the_other(known, count, late, 3))


def test_reasoning_tags(spark):
    from protomill.functions import answers as A

    said = ["<step>one  x</step> <STEP>two</STEP><answer>A</answer>", "<reasoning>first\nthen</reasoning><answer>B</answer>", "- a\n- b\n<answer>C</answer>", "<step> </step>Only this. And that.<answer>D</answer>"]
    rows = spark.createDataFrame(list(enumerate(said)), "i int, t string").select("i", A.reasoning_steps(F.col("t")).alias("s")).collect()
    assert {r["i"]: r["s"] for r in rows} == {0: ["one x", "two"], 1: ["first then"], 2: ["a", "b"], 3: ["Only this.", "And that."]}


def random_program(rng):
    names, lines = ["tube", "rack", "x"], []
    for k in range(rng.randrange(0, 6)):
        keys = rng.sample(["sample", "volume", "times", "tool"], rng.randrange(0, 4))
        value = lambda: rng.choice([rng.choice(names), str(rng.choice([1, 5, 5.0, 5.4, 10, -3])), "True", "'s'", "1 + 2", "None"])
        call = f"{rng.choice(['mix', 'wash', 'heat'])}({', '.join(f'{key}={value()}' for key in keys)})"
        out = rng.choice([None, f"v{k}", "x"])
        lines.append(f"{out} = {call}" if out else call)
        names += [out] if out else []
    return "\n".join(lines)


def test_native_comparison_equals_the_one_by_one(spark):
    from protomill.operators import compare as C

    rng = random.Random(12)
    pairs = []
    for i in range(150):
        gold = random_program(rng)
        lines = gold.split("\n")
        near = "\n".join(x for x in (rng.choice([x, x, x.replace("5", "5.2"), x.replace("mix", "wash")]) for x in lines) if rng.random() < 0.9)
        pairs.append((i, gold, rng.choice([random_program(rng), near, gold, "no program"])))
    df = spark.createDataFrame(pairs, "i int, gold string, pred string").repartition(2)
    parsed = df.select("i", P.parse_program("gold").alias("g"), P.parse_program("pred").alias("p"))
    got = {r["i"]: r["s"] for r in parsed.select("i", C.scores(F.col("g"), F.col("p"), F.array(F.lit("tube"), F.lit("rack"))).alias("s")).collect()}
    for i, gold, pred in pairs:
        want = P.compare(P._parsed(gold) or [], P._parsed(pred) or [], {"tube", "rack"})
        assert {k: round(got[i][k], 9) for k in want} == {k: round(v, 9) for k, v in want.items()}, (gold, pred)
        assert len([d for d in got[i]["details"] if d["errors"]]) == want["errors"] and sum(d["matched"] for d in got[i]["relaxed_details"]) == want["matched"]


def test_details_of_a_comparison(spark):
    from protomill.operators import compare as C

    gold = "a = mix(sample=tube, times=3)\nb = wash(sample=a, tool='x')\nheat(sample=b)"
    pred = "q = mix(sample=tube, times=4)\nr = wash(sample=q, tool='y')\n"
    df = spark.createDataFrame([(gold, pred)], "g string, p string").select(P.parse_program("g").alias("g"), P.parse_program("p").alias("p"))
    s = df.select(C.scores(F.col("g"), F.col("p"), F.array(F.lit("tube"))).alias("s")).first()["s"]
    assert [(d["step"], d["errors"]) for d in s["details"]] == [(1, ["times:value:3!=4"]), (2, ["sample:generated_ref:a!=q", "tool:value:x!=y"]), (3, ["missing_step"])]
    assert [(d["status"], d["matched"], d["total"]) for d in s["relaxed_details"]] == [("aligned", 1, 2), ("aligned", 1, 2), ("missing_step", 0, 1)]
