"""Queries of whole questions: the validator on replies made of table values, prompts, and a solver that refuses easy items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from protomill.functions import fixed_values as V
from protomill.operators import items as I
from protomill.operators import questions as Q
from protomill.plans.item_queries import CUES
from protomill.plans.registry import query, table


def replies(spark: SparkSession, sf: str) -> DataFrame:
    """A question for each document: its text is the stem and, cut at full stops, the reasoning; its length makes the numbers of the options."""
    n = F.col("n_chars")
    number = lambda c: c.cast("string")
    call = lambda name, key, c: F.concat(F.lit(f"{name}({key}="), number(c), F.lit(", tube='x')"))
    third = F.when(F.col("lang") == "en", "wash").otherwise("mix")
    options = {"A": call("mix_sample", "duration_min", n % 5), "B": call("mix_sample", "duration_min", n % 5 + 1), "C": call("mix_sample", "duration_min", n % 7)}
    options |= {k: call("heat_sample", "volume_ul", n + i) for i, k in enumerate("DEF", 1)}
    options |= {k: F.concat(third, call("_sample", "duration_min", n + 20 + i)) for i, k in enumerate("GHI")}
    options["J"] = F.when(n % 11 == 0, "none()").otherwise("none_of_the_above()")
    right = F.char((n % 3 + 65).cast("int"))
    reply = F.to_json(
        F.struct(
            F.col("text").alias("question"),
            F.struct(*[v.alias(k) for k, v in options.items()]).alias("options"),
            F.split("text", r"\. ").alias("reasoning_steps"),
            F.when(n % 13 == 0, "K").otherwise(right).alias("answer"),
        )
    )
    target = F.when(n % 2 == 0, right).otherwise("B")
    return table(spark, sf, "documents").select(
        "doc_id", reply.alias("reply"), target.alias("target"), F.array(F.lower("source")).alias("identity"), F.lit("").alias("context"), F.lit("beaker").alias("group")
    )


_STEM_KEY = "trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'))"
_SOME = lambda words: "(" + " OR ".join(f"contains(key, '{w}')" for w in words) + ")"
_NUMBER = r"\b\d+(?:\.\d+)?(?:[–-]\d+(?:\.\d+)?)?\b"


@query(
    f"WITH d AS (SELECT *, {_STEM_KEY} AS key, string_split(text, '. ') AS parts, n_chars % 5 AS a, n_chars % 5 + 1 AS b, n_chars % 7 AS c, n_chars % 13 = 0 AS unknown, chr(CAST(65 + n_chars % 3 AS INT)) AS answer FROM documents), "
    "e AS (SELECT *, CASE answer WHEN 'A' THEN a WHEN 'B' THEN b ELSE c END AS gold FROM d) "
    "SELECT doc_id, concat_ws(',', CASE WHEN regexp_matches(text, '[㐀-䶿一-鿿　-〿＀-￯]') THEN 'not_english' END, "
    "CASE WHEN unknown THEN 'answer_is_not_a_letter' WHEN n_chars % 2 = 1 AND answer <> 'B' THEN 'answer_is_not_the_target' END, "
    "CASE WHEN len(parts) NOT BETWEEN 2 AND 6 THEN 'steps_are_not_two_to_six' END, CASE WHEN len(list_filter(parts, lambda x: NOT regexp_matches(x, '\\S'))) > 0 THEN 'step_is_not_text' END, "
    f"CASE WHEN contains(key, lower(source)) THEN 'leaks_identity' END, CASE WHEN {_SOME(CUES)} THEN 'leaks_function' END, "
    f"CASE WHEN len(regexp_extract_all(text, '{_NUMBER}')) < 2 THEN 'few_numbers' END, CASE WHEN NOT {_SOME(V.SEQUENCE_CUES)} THEN 'no_sequence' END, "
    "CASE WHEN a = 0 OR c = 0 THEN 'zero_argument' END, CASE WHEN n_chars % 11 = 0 THEN 'last_is_not_none' END, "
    "CASE WHEN c IN (a, b) THEN 'repeated_options' END, CASE WHEN lang <> 'en' THEN 'families_repeat' END, "
    "CASE WHEN NOT unknown AND ((answer <> 'A' AND a = gold) OR (answer <> 'B' AND b = gold) OR (answer <> 'C' AND c = gold)) THEN 'not_one_change' END) AS reasons FROM e"
)
def f10_question_validator(spark: SparkSession, sf: str) -> DataFrame:
    """All rules that each document's question breaks."""
    return Q.question_failures(replies(spark, sf), CUES).select("doc_id", F.array_join("reasons", ",").alias("reasons"))


_GROUP = "[" + ", ".join(f"'{g}'" for g in V.MATCH_GROUPS) + f"][p_partkey % {len(V.MATCH_GROUPS)} + 1]"
_IN = lambda names: "(" + ", ".join(f"'{n}'" for n in names) + ")"


@query(
    f"WITH g AS (SELECT *, {_GROUP} AS grp FROM part) SELECT p_partkey, 'The answer is ' || chr(CAST(65 + p_size % 10 AS INT)) || '.' AS answer, 'Words that the question must not use: ' || p_brand || ', ' || p_name AS words, "
    "'- Purpose: ' || p_type AS purpose, "
    f"CASE WHEN grp IN {_IN(V.PASSIVE_HOLDERS)} THEN 'holds' WHEN grp IN {_IN(V.PASSIVE_CONTAINERS)} THEN 'vessel' WHEN grp = 'pipette' THEN 'hand' WHEN grp = 'pipette_tip' THEN 'tip' "
    f"WHEN grp IN {_IN(V.ACTIVE_DEVICES)} THEN 'device' ELSE 'purpose' END AS rule, '- Step ' || p_size || ' | ' || p_brand || ': ' || p_name AS step FROM g"
)
def g1_question_prompt(spark: SparkSession, sf: str) -> DataFrame:
    """The prompt for each part, and its lines read back: the answer, the banned words, the purpose, which rule holds, and the first step."""
    group = F.element_at(F.array(*[F.lit(g) for g in V.MATCH_GROUPS]), (F.col("p_partkey") % len(V.MATCH_GROUPS) + 1).cast("int"))
    step = F.struct(F.col("p_size").alias("idx"), F.col("p_brand").alias("stage"), F.col("p_name").alias("description"))
    entry = {"name": F.col("p_name"), "group": group, "purpose": F.col("p_type"), "title": F.col("p_brand"), "background": F.col("p_type"), "views": F.array(F.col("p_name"))}
    prompt = Q.question_prompt(entry, F.array(step), F.slice(F.array(step), 1, 0), F.array("p_name", "p_brand"), F.char((F.col("p_size") % 10 + 65).cast("int")))
    said = table(spark, sf, "part").select("p_partkey", F.split(prompt, "\n").alias("lines"))
    line = lambda start: F.get(F.filter("lines", lambda x: F.startswith(x, F.lit(start))), 0)
    purpose = F.array_position("lines", line("- Purpose: ")).cast("int")
    words = {"holds": "only holds", "vessel": "a vessel", "hand": "by hand", "tip": "thrown away", "device": "powered device", "purpose": "Keep to"}
    after = F.get("lines", purpose)
    rule = F.coalesce(*[F.when(F.contains(after, F.lit(w)), F.lit(k)) for k, w in words.items()])
    return said.select(
        "p_partkey", line("The answer").alias("answer"), line("Words").alias("words"), line("- Purpose: ").alias("purpose"), rule.alias("rule"), line("- Step").alias("step")
    )


def _word(prompt: str) -> str:
    """A stub model: the text's first word, and its second (if there is one) once it was refused."""
    text, refused, _ = prompt.partition("\nThe last reply was refused")
    return text.split(" ")[:2][-1 if refused else 0]


@query(
    "WITH w AS (SELECT doc_id, string_split(text, ' ')[1] AS a, coalesce(string_split(text, ' ')[2], string_split(text, ' ')[1]) AS b FROM documents) "
    "SELECT doc_id, CASE WHEN length(a) > 4 THEN a WHEN length(b) > 4 THEN b END AS result, CASE WHEN length(a) > 4 OR length(b) > 4 THEN NULL ELSE 'it was solved (round 1 of 2)' END AS error, "
    "CASE WHEN length(a) > 4 THEN 1 ELSE 2 END AS tries FROM w"
)
def g7_solver_rounds(spark: SparkSession, sf: str) -> DataFrame:
    """Two tries for each document against a solver that knows all words of up to four characters."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    made = I.generate(docs, "text", _word, lambda reply: None, tries=2, solved=lambda reply: len(reply) <= 4, rounds=2, advice={"solved": "Take a longer word."})
    return made.select("doc_id", "result", "error", "tries")
