"""Generated questions as a whole: a reply's JSON is read once, and every rule is tested on the same row, without a shuffle."""

from __future__ import annotations

import ast

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from protomill.functions import fixed_values as V
from protomill.functions import text as X
from protomill.operators.items import TRIOS, option_failures, stem_failures
from protomill.operators.records import reasons

FIELDS = ("question", "options", "reasoning_steps", "answer")
_ARGUMENT = T.StructType([T.StructField("value", T.StringType()), T.StructField("number", T.BooleanType())])
_CALL = T.StructType([T.StructField("function", T.StringType()), T.StructField("arguments", T.MapType(T.StringType(), _ARGUMENT))])


def _call(text: str | None) -> dict | None:
    try:
        call = ast.parse((text or "").strip(), mode="eval").body
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None
    if not isinstance(call, ast.Call) or not isinstance(call.func, ast.Name):
        return None
    return {"function": call.func.id, "arguments": {k.arg or "": _argument(k.value) for k in call.keywords}}


def _argument(node: ast.expr) -> dict:
    constants = [node] if isinstance(node, ast.Constant) else [n for n in ast.walk(node) if isinstance(n, ast.Constant)]
    number = any(isinstance(n.value, (int, float)) for n in constants)
    return {"value": repr(node.value) if constants == [node] else ast.unparse(node), "number": number}


@F.pandas_udf(T.ArrayType(_CALL))
def parse_calls(options: pd.Series) -> pd.Series:
    """Calls of an array of texts; null where a text isn't the call of a plain name."""
    return pd.Series([None if texts is None else [_call(t) for t in texts] for texts in options], dtype=object)


def trio_reasons(options: Column, calls: Column, answer: Column) -> dict[str, Column]:
    """Conditions on ten options and their calls, both in the order of letters; what isn't a call differs from everything."""
    at = lambda letter: F.get(calls, ord(letter) - 65)
    name = lambda letter: at(letter)["function"]
    keys = lambda letter: F.array_sort(F.map_keys(at(letter)["arguments"]))
    alike = lambda of: F.forall(F.array(*[of(t[0]).eqNullSafe(of(k)) for t in TRIOS for k in t[1:]]), lambda x: x)
    first = F.array(*[name(t[0]) for t in TRIOS])
    place = F.ascii(answer) - 65
    family = F.slice(calls, (place / 3).cast("int") * 3 + 1, 3)

    def changes(gold: Column) -> Column:
        others = F.transform(family, lambda c, i: F.struct(c.alias("c"), i.alias("i")))
        others = F.filter(others, lambda o: o["i"] != place % 3)

        def changed(o: Column) -> Column:
            theirs = lambda k: F.try_element_at(o["c"]["arguments"], k)
            moved = F.filter(F.map_keys(gold["arguments"]), lambda k: ~F.try_element_at(gold["arguments"], k)["value"].eqNullSafe(theirs(k)["value"]))
            number = lambda k: F.try_element_at(gold["arguments"], k)["number"] & F.coalesce(theirs(k)["number"], F.lit(False))
            return F.struct(F.size(moved).alias("n"), F.forall(moved, number).alias("numbers"))

        return F.transform(others, changed)

    right = place.between(0, 8)
    near = F.when(right, X.let(F.get(calls, place), changes))
    return {
        "repeated_options": F.size(F.array_distinct(options)) < F.size(options),
        "functions_differ": ~alike(name),
        "keywords_differ": ~alike(keys),
        "families_repeat": F.size(F.array_distinct(first)) < len(TRIOS),
        "not_one_change": F.exists(near, lambda c: c["n"] != 1),
        "not_a_number": F.exists(near, lambda c: ~c["numbers"]),
    }


def question_failures(items: DataFrame, cues: list[str], option_count: int = 10) -> DataFrame:
    """Adds reasons (empty: accepted) to rows with reply (JSON text), target (a letter), identity (normalised terms), context (normalised text) and group.

    Every failing rule is named, in a fixed order.  A null reply, or one that isn't a JSON object, is ``not_an_object`` and nothing else; fields that
    are absent or null are ``missing_...``; unknown fields are ignored.  Options are judged if there is one text for each letter, families if there are
    ten options that are calls.  Rows that repeat are judged alike.
    """
    letters = [chr(65 + i) for i in range(option_count)]
    kind = F.schema_of_variant
    field = lambda name: F.try_variant_get("__v", f"$.{name}", "variant")
    is_object = lambda v: F.coalesce(F.startswith(kind(v), F.lit("OBJECT")), F.lit(False))
    is_text = lambda v: F.coalesce(kind(v) == "STRING", F.lit(False))
    as_text = lambda v: F.when(is_text(v), F.try_variant_get(v, "$", "string"))
    full_text = lambda t: F.coalesce(t.rlike(r"(?U)\S"), F.lit(False))
    filled = lambda v: full_text(as_text(v))
    there = lambda name: F.coalesce(kind(F.col(f"__{name}")) != "VOID", F.lit(False))

    read = items.withColumn("__v", F.try_parse_json("reply"))
    read = read.withColumns({f"__{n}": field(n) for n in (*FIELDS, "protocol_alignment")})
    options = F.when(is_object(F.col("__options")), F.try_variant_get("__options", "$", "map<string,variant>"))
    steps = F.when(F.startswith(kind(F.col("__reasoning_steps")), F.lit("ARRAY")), F.try_variant_get("__reasoning_steps", "$", "array<variant>"))
    read = read.withColumns({"__map": options, "__steps": steps, "__answer": F.regexp_replace(as_text(F.col("__answer")), r"(?U)^\s+|\s+$", ""), "__has_answer": there("answer"), "__stem": as_text(F.col("__question"))})
    full = F.array_sort(F.map_keys("__map")) == F.array(*[F.lit(k) for k in letters])
    texts = F.when(full, F.array(*[as_text(F.try_element_at("__map", F.lit(k))) for k in letters]))
    read = read.withColumn("__texts", texts).withColumn("__calls", parse_calls("__texts"))

    each = F.transform(F.arrays_zip("__texts", "__calls"), lambda o, i: F.struct(F.char(i + 65).alias("k"), o["__texts"].alias("t"), o["__calls"].alias("c")))
    context, group = F.coalesce("context", F.lit("")), F.coalesce("group", F.lit(""))
    judged = F.transform(each, lambda o: option_failures(o["k"], F.coalesce(o["t"], F.lit("")), F.coalesce(o["c"]["function"], F.lit("")), context, group))
    found = F.array_distinct(F.flatten(judged))
    stem = F.when(full_text(F.col("__stem")), stem_failures(F.col("__stem"), F.col("identity"), cues))
    ten = option_count == 10
    whole = F.forall("__calls", lambda c: c.isNotNull()) if ten else F.lit(False)
    values = F.regexp_replace(F.to_json("__protocol_alignment"), r'"(?:[^"\\]|\\.)*"\s*:', "")
    english = F.array_compact(
        F.array(F.col("__stem"), F.array_join(F.col("__texts"), " "), F.array_join(F.transform("__steps", as_text), " "), F.when(there("protocol_alignment"), values))
    )
    order = reasons(
        **{f"missing_{n}": ~(F.col("__has_answer") if n == "answer" else there(n)) for n in FIELDS},
        question_is_not_text=there("question") & ~filled(F.col("__question")),
        options_are_not_the_letters=there("options") & ~F.coalesce(full, F.lit(False)),
        option_is_not_text=F.exists("__texts", lambda t: ~full_text(t)),
        option_is_not_a_call=F.exists(each, lambda o: full_text(o["t"]) & o["c"].isNull()),
        not_english=F.exists(english, X.has_cjk),
        answer_is_not_a_letter=F.col("__has_answer") & ~F.coalesce(F.col("__answer").isin(*letters), F.lit(False)),
        answer_is_not_the_target=F.col("__answer").isin(*letters) & (F.col("__answer") != F.col("target")),
        steps_are_not_two_to_six=there("reasoning_steps") & ~F.coalesce(F.size("__steps").between(2, 6), F.lit(False)),
        step_is_not_text=F.exists("__steps", lambda s: ~filled(s)),
    )
    trios = F.when(whole, reasons(**trio_reasons(F.col("__texts"), F.col("__calls"), F.when(F.col("__answer").isin(*letters), F.col("__answer"))))) if ten else F.lit(None)
    none = F.array().cast("array<string>")
    all_of_them = F.concat(order, F.coalesce(stem, none), F.coalesce(found, none), F.coalesce(trios.cast("array<string>"), none))
    told = F.when(is_object(F.col("__v")), all_of_them).otherwise(F.array(F.lit("not_an_object")))
    return read.withColumn("reasons", told).select(*items.columns, "reasons")


def guardrail(group: Column, purpose: Column) -> Column:
    """What a question on an asset of the group may claim of it, below the asset's purpose."""
    rule = (
        F.when(group.isin(*V.PASSIVE_HOLDERS), "It only holds or orders things: it has no power, magnet, heat, mixing or spinning unless its data say so.")
        .when(group.isin(*V.PASSIVE_CONTAINERS), "It is a vessel or a measure for samples: never call it a powered instrument.")
        .when(group == "pipette", "It moves liquid by hand: operations are aspirating, dispensing and transferring.")
        .when(group == "pipette_tip", "It is a tip that is thrown away: it isn't a rack, a heater, a mixer or a meter.")
        .when(group.isin(*V.ACTIVE_DEVICES), "It is a powered device: the right operation fits what it does and what the protocol says.")
        .otherwise("Keep to its stated purpose and to the protocol: claim no special ability that the data don't name.")
    )
    stated = F.coalesce(F.nullif(F.trim(purpose), F.lit("")), F.lit("not stated"))
    return F.concat(F.lit("- Purpose: "), stated, F.lit("\n- "), rule)


def question_prompt(entry: dict[str, Column], steps: Column, nearby: Column, forbidden: Column, target: Column, option_count: int = 10, most_terms: int = 16) -> Column:
    """The request for one question: rules, the asset, its pictures, the protocol's steps, and the letter that must be right.

    ``entry`` has name, group, purpose, title, background and views (an array of texts); steps are arrays of structs of idx, stage and description.
    Null or empty parts are shown as (none).
    """
    letters = ", ".join(chr(65 + i) for i in range(option_count))
    last = chr(64 + option_count)
    shown = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit("(none)"))
    lines = lambda s: shown(F.array_join(F.transform(s, lambda x: F.concat(F.lit("- Step "), x["idx"].cast("string"), F.lit(" | "), x["stage"], F.lit(": "), x["description"])), "\n"))
    terms = shown(F.array_join(F.slice(F.array_sort(forbidden), 1, most_terms), ", "))
    rules = (
        f"Write one multiple-choice question in English on the pictured asset, as one JSON object with {', '.join(FIELDS)} and protocol_alignment.\n"
        "The question names two numbers of the protocol and what was done before, and never the asset.\n"
        f"Options are {letters}, each a Python call; A-C, D-F and G-I are three families of one function and one set of keywords, {last} is none_of_the_above().\n"
        "Wrong members of the right family change one number; the other families are steps nearby.\n"
        "reasoning_steps has 3 to 5 texts."
    )
    return F.concat_ws(
        "\n",
        F.lit(rules),
        F.concat(F.lit("The answer is "), target, F.lit(".")),
        F.concat(F.lit("Words that the question must not use: "), terms),
        F.lit("Asset:"),
        F.concat(F.lit("- Name: "), shown(entry["name"])),
        F.concat(F.lit("- Group: "), shown(entry["group"])),
        guardrail(entry["group"], entry["purpose"]),
        F.lit("Pictures:"),
        shown(F.array_join(F.transform(entry["views"], lambda v: F.concat(F.lit("- "), v)), "\n")),
        F.concat(F.lit("Protocol: "), shown(entry["title"])),
        shown(entry["background"]),
        F.lit("Steps:"),
        lines(steps),
        F.lit("Steps nearby:"),
        lines(nearby),
    )
