"""Whole questions: every rule of the validator, and the parts of a prompt."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from protomill.operators import questions as Q

STEM = "After 10 min at 4 C, what comes next?"


def options(**changed):
    names = ("mix_sample", "heat_sample", "wash_sample")
    made = {k: f"{names[i // 3]}(times={i % 3 + 1}, tube='x')" for i, k in enumerate("ABCDEFGHI")} | {"J": "none_of_the_above()"}
    return made | changed


def reply(**changed):
    made = {"question": STEM, "options": options(), "reasoning_steps": ["one", "two"], "answer": "B"} | changed
    return json.dumps({k: v for k, v in made.items() if v is not ...}, ensure_ascii=False)


CASES = [
    (reply(), []),
    (reply(answer=" B\n", extra=1), []),
    (reply(protocol_alignment={"title": "fine", "混合": [1]}), []),  # only values are judged
    (None, ["not_an_object"]),
    ("", ["not_an_object"]),
    ("[1]", ["not_an_object"]),
    ("{", ["not_an_object"]),
    (reply(answer=...), ["missing_answer"]),
    (reply(question=..., reasoning_steps=None), ["missing_question", "missing_reasoning_steps"]),
    (reply(question=5), ["question_is_not_text"]),
    (reply(question=" \n\u00a0"), ["question_is_not_text"]),
    (reply(question="Then 1 and 2 混合"), ["not_english"]),
    (reply(reasoning_steps=["a", "混合"]), ["not_english"]),
    (reply(protocol_alignment={"a": ["b", {"c": "混合"}]}), ["not_english"]),
    (reply(question="After 10 min at 4 C in the tube rack"), ["leaks_identity"]),
    (reply(question="After 10 min, gentle handling"), ["leaks_function", "few_numbers"]),
    (reply(question="Take 1 and 2"), ["no_sequence"]),
    (reply(options={"A": "f()"}), ["options_are_not_the_letters"]),
    (reply(options="A"), ["options_are_not_the_letters"]),
    (reply(options=options(D=7)), ["option_is_not_text"]),
    (reply(options=options(D="a + b")), ["option_is_not_a_call"]),
    (reply(options=options(J="none()")), ["last_is_not_none"]),
    (reply(options=options(D="none_of_the_above()")), ["none_elsewhere", "repeated_options", "functions_differ", "keywords_differ"]),
    (reply(options=options(D="heat_sample(times=1, tube='magnetic')")), ["magnetic_holder"]),
    (reply(options=options(D="heat_sample(times=1, tube='robot')")), ["off_context"]),
    (reply(answer="K"), ["answer_is_not_a_letter"]),
    (reply(answer=["B"]), ["answer_is_not_a_letter"]),
    (reply(answer="C"), ["answer_is_not_the_target"]),
    (reply(answer="J"), ["answer_is_not_the_target"]),  # the last letter has no family
    (reply(reasoning_steps=["a"]), ["steps_are_not_two_to_six"]),
    (reply(reasoning_steps="a"), ["steps_are_not_two_to_six"]),
    (reply(reasoning_steps=["a", 1]), ["step_is_not_text"]),
    (reply(options=options(D="heat_sample(times=2, tube='x')")), ["repeated_options"]),
    (reply(options=options(D="stir_sample(times=1, tube='x')")), ["functions_differ"]),
    (reply(options=options(D="heat_sample(times=1, cup='x')")), ["keywords_differ"]),
    (reply(options=options(**{k: f"mix_sample(times={i}, tube='x')" for i, k in enumerate("DEF", 4)})), ["families_repeat"]),
    (reply(options=options(A="mix_sample(times=1, tube='y')")), ["not_one_change", "not_a_number"]),
    (reply(options=options(A="mix_sample(times=2, tube='x1')")), ["not_a_number"]),  # one change, but of a text
]


def test_every_rule(spark):
    rows = [(i, r, "B", ["tube rack"], "", "tube_rack", "kept") for i, (r, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "id int, reply string, target string, identity array<string>, context string, group string, options string")
    judged = Q.question_failures(df, ["gentle handling"])
    assert judged.columns == [*df.columns, "reasons"]  # a column of the name of a field is no field
    got = {r["id"]: r["reasons"] for r in judged.collect()}
    assert [(i, got[i]) for i in range(len(CASES))] == [(i, want) for i, (_, want) in enumerate(CASES)]
    assert Q.question_failures(df.where("id > 999"), []).count() == 0


def test_no_shuffle(spark):
    df = spark.range(1).select(F.lit("{}").alias("reply"), F.lit("B").alias("target"), F.array(F.lit("x")).alias("identity"), F.lit("").alias("context"), F.lit("").alias("group"))
    plan = Q.question_failures(df, [])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("ArrowEvalPython") == 1


def test_fewer_options_have_no_families(spark):
    df = spark.createDataFrame([(json.dumps({"question": STEM, "options": {"A": "f(a=1)", "B": "g(a=1)"}, "reasoning_steps": ["a", "b"], "answer": "A"}), "A", None, None, None)], "reply string, target string, identity array<string>, context string, group string")
    assert Q.question_failures(df, [], option_count=2).first()["reasons"] == []


@pytest.mark.parametrize("group, want", [("tube_rack", "only holds"), ("beaker", "a vessel"), ("pipette", "by hand"), ("pipette_tip", "thrown away"), ("centrifuge", "powered device"), ("glass_rod", "Keep to")])
def test_guardrail(spark, group, want):
    said = spark.range(1).select(Q.guardrail(F.lit(group), F.lit(" ")).alias("x")).first()["x"]
    assert said.startswith("- Purpose: not stated\n- ") and want in said


def test_prompt_parts(spark):
    entry = {k: F.lit(v) for k, v in {"name": "Rack", "group": "tube_rack", "purpose": "Holds tubes.", "title": "", "background": None}.items()} | {"views": F.array(F.lit("top: a.png"))}
    step = F.struct(F.lit(3).alias("idx"), F.lit("Prep").alias("stage"), F.lit("Mix.").alias("description"))
    none = F.slice(F.array(step), 1, 0)
    said = spark.range(1).select(Q.question_prompt(entry, F.array(step), none, F.array(F.lit("z"), F.lit("tube rack")), F.lit("C")).alias("x")).first()["x"]
    assert "The answer is C." in said and "must not use: tube rack, z" in said and "Steps:\n- Step 3 | Prep: Mix.\nSteps nearby:\n(none)" in said
    assert "- top: a.png" in said and "Protocol: (none)\n(none)" in said and "- Purpose: Holds tubes." in said


def test_solved_items_are_refused_with_advice(spark):
    """The first reply is solved in its second round; the next one isn't."""
    from protomill.operators import items as I

    asked = []

    def solved(reply):
        asked.append(reply)
        return reply == "easy" and len(asked) % 2 == 0

    df = spark.createDataFrame([("p",), (None,)], "prompt string")
    model = lambda p: "hard" if p.endswith("was solved (round 2 of 2) Make it harder.") else "easy"
    got = I.generate(df, "prompt", model, lambda r: None, solved=solved, rounds=2, advice={"solved": "Make it harder."}).collect()
    assert [(r["result"], r["tries"]) for r in got] == [("hard", 2), (None, 0)]
    assert got[1]["error"] == "no prompt"
