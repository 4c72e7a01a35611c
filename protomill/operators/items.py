"""Work items: who gets which document, what is offered, and whether a generated item is valid."""

from __future__ import annotations

import ast
from collections.abc import Callable, Iterator
from functools import lru_cache, partial

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from protomill.functions import fixed_values as V
from protomill.functions import text as X
from protomill.operators.records import reasons
from protomill.sources.files import shared_folder

TRIOS = ("ABC", "DEF", "GHI")
#: Bytes of prompts that are Python strings at a time, about.
PIECE_BYTES = 1 << 20


def difficulty(group: Column) -> Column:
    """Active devices first, passive containers last."""
    return F.when(group.isin(*V.ACTIVE_DEVICES), 0).when(group.isin(*V.PASSIVE_CONTAINERS), 2).otherwise(1)


def eligible(entries: DataFrame, denied: list[str], scenes: bool = False, fewest_views: int = 3) -> DataFrame:
    """Entries that are not denied, can be matched (unless scenes are wanted) and have enough views."""
    kept = entries.where(~F.col("entry_id").isin(*denied) & (F.size(F.map_keys("views")) >= fewest_views))
    return kept if scenes else kept.where("protocol_matchable")


def assign(candidates: DataFrame, entry: str, item: str, count: int, last: str | None = None, seed: int = 0) -> DataFrame:
    """entry, item, round and turn of at most ``count`` jobs, dealt in rounds.

    In every round each entry takes one of its candidate items that it hasn't had, in a seeded order of entries (those with ``last``, a boolean column, after the others).  It takes an item that no
    entry has had, if it has such a candidate, else the first in its own seeded order.  Rounds end when ``count`` jobs are dealt or no candidate is left; the last round is cut in the order of entries.

    Within a round entries propose: each its first unused item; an item keeps the proposer whose turn is first, the others propose anew.  As items prefer
    entries by their turn, this gives what entries choosing one after the other would get, but all proposals of a pass are one join.  Each pass is a stored table.
    """
    spark = candidates.sparkSession
    kept = lambda df: _stored(df, "jobs")
    late = F.coalesce(F.col(last), F.lit(False)) if last else F.lit(False)
    each = candidates.where(F.col(entry).isNotNull() & F.col(item).isNotNull()).select(F.col(entry).alias("e"), F.col(item).alias("i"), late.alias("late"))
    pairs = each.groupBy("e", "i").agg(F.max("late").alias("late"))
    turns = pairs.groupBy("e").agg(F.max("late").alias("late"))
    turns = turns.select("e", F.struct("late", F.xxhash64("e", F.lit(seed)).alias("h"), "e").alias("turn"))
    wish = F.struct(F.xxhash64("e", "i", F.lit(seed)).alias("h"), F.col("i"))
    left = kept(pairs.join(turns, "e").select("e", "i", "turn", wish.alias("wish")))
    made, jobs, number = 0, None, 0
    taken = spark.createDataFrame([], left.select("i").schema)
    while made < count:
        number += 1
        open_ = kept(left.join(taken, "i", "left_anti"))
        held = spark.createDataFrame([], left.schema)
        while True:  # proposals until nobody is refused
            waiting = open_.join(held.select("e"), "e", "left_anti")
            asked = waiting.groupBy("e").agg(F.min_by(F.struct("i", "turn", "wish"), "wish").alias("x")).select("e", "x.*")
            both = held.select("e", "i", "turn", "wish").unionByName(asked.select("e", "i", "turn", "wish"))
            best = both.groupBy("i").agg(F.min_by(F.struct("e", "turn", "wish"), "turn").alias("x")).select("x.e", "i", "x.turn", "x.wish")
            now = kept(best.select("e", "i", "turn", "wish"))
            refused = kept(both.join(now.select("e", "i"), ["e", "i"], "left_anti").select("e", "i"))
            if not refused.take(1):
                held = now
                break
            held, open_ = now, kept(open_.join(refused, ["e", "i"], "left_anti"))
        again = left.join(held.select("e"), "e", "left_anti").groupBy("e").agg(F.min_by(F.struct("i", "turn", "wish"), "wish").alias("x")).select("e", "x.*")
        round_ = kept(held.select("e", "i", "turn", "wish").unionByName(again.select("e", "i", "turn", "wish")))
        n = round_.count()
        if not n:
            break
        if made + n > count:
            round_ = kept(round_.orderBy("turn").limit(count - made))
        made += n
        told = round_.select("e", "i", F.lit(number).alias("round"), "turn")
        jobs = told if jobs is None else jobs.unionByName(told)
        taken = kept(taken.unionByName(round_.select("i")).distinct())
        left = kept(left.join(round_.select("e", "i"), ["e", "i"], "left_anti"))
    if jobs is None:
        jobs = left.limit(0).select("e", "i", F.lit(0).alias("round"), "turn")
    return jobs.select(F.col("e").alias(entry), F.col("i").alias(item), "round", "turn")


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def quota_letters(items: DataFrame, id_col: str, options: int = 10, none_rate: float = 0.2, seed: int = 0) -> DataFrame:
    """Adds letter: a quota of the last one, and the others in turn, over items in a seeded order.

    The order is global, and so is the quota: ranks come from range-partitioned counts, not from one sorted task.
    """
    keyed = items.withColumn("__h", F.xxhash64(F.col(id_col), F.lit(seed)))
    bucket = F.shiftright("__h", 54)
    counts = keyed.groupBy(bucket.alias("__b")).agg(F.count("*").alias("__n"))  # 1,024 rows at most
    before = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    shift = counts.select("__b", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__s"), F.sum("__n").over(Window.partitionBy()).alias("__all"))
    inside = keyed.withColumn("__b", bucket).withColumn("__r", F.row_number().over(Window.partitionBy("__b").orderBy("__h", id_col)))
    ranked = inside.join(F.broadcast(shift), "__b").withColumn("__k", F.col("__r") + F.col("__s") - 1)
    quota = F.greatest(F.lit(1), F.round(F.col("__all") * none_rate).cast("long"))
    place = F.when(F.col("__k") < quota, F.lit(options - 1)).otherwise(F.pmod(F.col("__k") - quota, F.lit(options - 1)))
    return ranked.withColumn("letter", F.char(65 + place)).drop("__h", "__b", "__r", "__s", "__all", "__k")


def some_views(views: Column, preferred: list[str], seed: int = 0, k: int = 3) -> Column:
    """k of the views that exist, drawn with a seed and given in the preferred order."""
    there = F.filter(F.array(*[F.lit(v) for v in preferred]), lambda v: F.array_contains(F.map_keys(views), v))
    # by a hash of the views and the view, so that a lost task draws the same again
    key = F.array_join(F.array_sort(F.map_keys(views)), ",")
    hashed = F.array_sort(F.transform(there, lambda v: F.struct(F.xxhash64(F.concat(key, v), F.lit(seed)), v.alias("view"))))
    drawn = F.transform(F.slice(hashed, 1, k), lambda x: x["view"])
    return F.filter(there, lambda v: F.array_contains(drawn, v))


def stem_failures(question: Column, identity: Column, cues: list[str]) -> Column:
    """Why a question's stem is refused: it names the asset, hints at its function, or lacks numbers or sequence."""
    numbers = F.regexp_extract_all(question, F.lit(r"\b(\d+(?:\.\d+)?(?:[–-]\d+(?:\.\d+)?)?)\b"), F.lit(1))

    def told(key: Column) -> Column:
        return reasons(
            leaks_identity=F.exists(identity, lambda t: (t != "") & F.contains(key, t)),
            leaks_function=_any_of(key, cues),
            few_numbers=F.size(numbers) < 2,
            no_sequence=~_any_of(key, V.SEQUENCE_CUES),
        )

    return X.let(X.search_key(question, fold_micro=False), told)


def _any_of(key: Column, words: tuple[str, ...] | list[str]) -> Column:
    """Whether a text holds any of the words; without lambdas, in which the text would be made anew for each word."""
    return F.coalesce(*[F.when(F.contains(key, F.lit(w)), F.lit(True)) for w in words], F.lit(False))


def option_failures(letter: Column, option: Column, function: Column, context: Column, group: Column) -> Column:
    """Why an option's text is refused."""
    last = letter == "J"
    none = F.trim(option) == "none_of_the_above()"

    def told(key: Column) -> Column:
        off = F.coalesce(*[F.when(F.contains(key, F.lit(t)) & ~F.contains(context, F.lit(t)), F.lit(True)) for t in V.SUSPICIOUS_TOKENS], F.lit(False))
        return reasons(
            last_is_not_none=last & ~none,
            none_elsewhere=~last & (function == "none_of_the_above"),
            zero_argument=~last & option.rlike(V.ZERO_ARGUMENT),
            off_context=~last & off,
            magnetic_holder=~last & group.isin(*V.PASSIVE_HOLDERS) & F.contains(key, F.lit("magnetic")) & ~F.contains(context, F.lit("magnetic")),
            rack_as_tool=~last & (group == "pipette_rack") & function.rlike("aspirat|dispens|aliquot|transfer"),
        )

    return X.let(X.search_key(option, fold_micro=False), told)


@F.pandas_udf(T.StructType([T.StructField("function", T.StringType()), T.StructField("arguments", T.MapType(T.StringType(), T.StringType()))]))
def parse_call(option: pd.Series) -> pd.DataFrame:
    """The function and keyword arguments of a call's text; null if it isn't one."""

    def one(text: str | None) -> tuple[str | None, dict | None]:
        try:
            call = ast.parse((text or "").strip(), mode="eval").body
        except (SyntaxError, ValueError):
            return None, None
        if not isinstance(call, ast.Call) or not isinstance(call.func, ast.Name):
            return None, None
        return call.func.id, {k.arg or "": ast.unparse(k.value) for k in call.keywords}

    return pd.DataFrame([one(x) for x in option], columns=["function", "arguments"])


def trio_failures(options: DataFrame, id_col: str) -> DataFrame:
    """id and reasons from options (id, letter, option, function, arguments) and their answer.

    Three letters form a family: one function and one set of keywords; the three functions differ; no two options are equal; and the
    wrong members of the answer's family differ from it in one keyword only, by a number.
    """
    trio = F.when(F.col("letter").isin(*"ABC"), 0).when(F.col("letter").isin(*"DEF"), 1).when(F.col("letter").isin(*"GHI"), 2)
    rows = options.withColumn("trio", trio)
    signature = F.array_join(F.array_sort(F.map_keys("arguments")), ",")
    per = rows.where("trio is not null").groupBy(id_col, "trio").agg(
        F.count_distinct("function").alias("functions"), F.count_distinct(signature).alias("signatures"), F.min("function").alias("function")
    )
    shape = per.groupBy(id_col).agg(F.max("functions").alias("functions"), F.max("signatures").alias("signatures"), F.count_distinct("function").alias("families"))
    texts = options.groupBy(id_col).agg((F.count("*") - F.count_distinct("option")).alias("repeats"))
    right = rows.where("letter = answer and trio is not null").select(id_col, "trio", F.col("arguments").alias("gold"))
    wrong = rows.where("letter <> answer").join(right, [id_col, "trio"])
    changed = F.filter(F.map_keys("gold"), lambda k: ~F.coalesce(F.try_element_at("gold", k) == F.try_element_at("arguments", k), F.lit(False)))
    numeric = F.forall("changed", lambda k: F.try_element_at("gold", k).rlike("[0-9]") & F.coalesce(F.try_element_at("arguments", k), F.lit("")).rlike("[0-9]"))
    near = wrong.withColumn("changed", changed).groupBy(id_col).agg(F.bool_or(F.size("changed") != 1).alias("not_one"), F.bool_or(~numeric).alias("not_number"))
    joined = shape.join(texts, id_col).join(near, id_col, "left")
    return joined.select(
        id_col,
        reasons(
            repeated_options=F.col("repeats") > 0,
            functions_differ=F.col("functions") > 1,
            keywords_differ=F.col("signatures") > 1,
            families_repeat=F.col("families") < 3,
            not_one_change=F.col("not_one"),
            not_a_number=F.col("not_number"),
        ).alias("reasons"),
    )


@lru_cache(1 << 12)
def moved(text: str, n: int) -> str:
    """A call whose first number is moved by the n-th step, down and up in turn but never to zero or below; unchanged if it has none."""
    try:
        tree = ast.parse(text, mode="eval")
    except (SyntaxError, ValueError):
        return text
    for node in ast.walk(tree):
        if isinstance(node, ast.Constant) and isinstance(node.value, (int, float)) and not isinstance(node.value, bool):
            size = abs(node.value)
            whole = isinstance(node.value, int)
            step = (100 if size >= 1000 else 10 if size >= 100 else 1) if whole else (10.0 if size >= 100 else 1.0 if size >= 10 else 0.5 if size >= 1 else 0.1)
            lower = node.value - step * (n // 2 + 1)
            node.value = lower if n % 2 == 0 and lower > 0 else node.value + step * (n // 2 + 1)
            return ast.unparse(tree)
    return text


@lru_cache(1 << 12)
def _call_parts(text: str) -> tuple[str, dict] | None:
    """A call's function and the texts of its keywords' values; None if it isn't one."""
    try:
        call = ast.parse(text.strip(), mode="eval").body
    except (SyntaxError, ValueError):
        return None
    return (ast.dump(call.func), {k.arg: ast.unparse(k.value) for k in call.keywords}) if isinstance(call, ast.Call) else None


def one_number_apart(gold: str, other: str) -> bool:
    """Whether two calls have one function and the same keywords, and differ in the value of one of them, a number in both."""
    a, b = _call_parts(gold), _call_parts(other)
    if a is None or b is None or a[0] != b[0]:
        return False
    mine, theirs = a[1], b[1]
    changed = [k for k in mine if mine[k] != theirs.get(k)]
    return mine.keys() == theirs.keys() and len(changed) == 1 and all(any(c.isdigit() for c in v[changed[0]]) for v in (mine, theirs))


def _repaired(options: DataFrame, id_col: str, fix: Callable[..., list], inputs: list[str], needed: Callable[[Column], Column] | None = None) -> DataFrame:
    """``options`` with the texts that ``fix`` gives for an item's columns ``inputs``, lists in the order of letters.

    An item has ten options at most, so its rows become one row of arrays; Python sees a batch of items at a time, and of these only the texts
    that are ``needed``.
    """

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def fixed(*columns: pa.Array) -> pa.Array:
        items = zip(*(c.to_pylist() for c in columns), strict=True)
        return pa.array([None if x[0] is None else fix(*x) for x in items], pa.list_(pa.string()))

    items = options.groupBy(F.col(f"`{id_col}`").alias("__id")).agg(F.collect_list(F.struct(*[F.col(f"`{c}`") for c in options.columns])).alias("__rows"))
    column = lambda c: F.transform("__rows", lambda r: r[c])
    asked = [F.when(needed(column("option")), column(c)) if needed else column(c) for c in inputs]
    each = items.select("__rows", fixed(*asked).alias("__new")).select(F.posexplode("__rows").alias("__at", "__row"), "__new")
    new = F.when(F.col("__new").isNull(), F.col("__row.option")).otherwise(F.get("__new", F.col("__at")))
    return each.select(*[(new if c == "option" else F.col(f"__row.`{c}`")).alias(c) for c in options.columns])


def _by_letter(letters: list[str | None]) -> list[int]:
    """Places in the order of letters, none last."""
    return sorted(range(len(letters)), key=lambda i: (letters[i] is None, letters[i] or ""))


def family_texts(letters: list[str | None], texts: list[str | None], answers: list[str | None], tries: int = 12) -> list[str | None]:
    """An item's options after ``repair_family``."""
    order = _by_letter(letters)
    by_letter = {letters[i]: texts[i] or "" for i in order}
    answer = answers[order[0]]
    trio = next((t for t in TRIOS if isinstance(answer, str) and len(answer) == 1 and answer in t), "")
    gold = by_letter.get(answer, "")
    for letter in trio:
        if letter == answer or letter not in by_letter or one_number_apart(gold, by_letter[letter]):
            continue
        taken = {t for k, t in by_letter.items() if k != letter}
        by_letter[letter] = next((t for t in (moved(gold, n) for n in range(tries)) if t not in taken), by_letter[letter])
    return [by_letter[k] if isinstance(o, str) or by_letter[k] else None for k, o in zip(letters, texts, strict=True)]


def repair_family(options: DataFrame, id_col: str, tries: int = 12) -> DataFrame:
    """Wrong members of the answer's trio become the right call with its first number moved, unless they are one number apart from it already.

    Each takes the first step whose text no other option has; a member stays as it is if the right call has no number.  Rows are (id, letter, option,
    answer), ten for an item.
    """
    return _repaired(options, id_col, partial(family_texts, tries=tries), ["letter", "option", "answer"])


def distinct_texts(letters: list[str | None], texts: list[str | None], tries: int = 5) -> list[str | None]:
    """An item's options after ``repair_repeats``."""
    seen: set[str | None] = set()
    fixed = list(texts)
    for i in _by_letter(letters):
        steps = () if texts[i] is None else (moved(texts[i], n) for n in range(tries))
        fixed[i] = next((t for t in (texts[i], *steps) if t not in seen), texts[i])
        seen.add(fixed[i])
    return fixed


def repair_repeats(options: DataFrame, id_col: str, tries: int = 5) -> DataFrame:
    """Options whose text repeats an earlier one get the first number moved by a step, until it is new; items without a repeat stay in Spark."""
    repeats = lambda texts: F.size(F.array_distinct(texts)) < F.size(texts)
    return _repaired(options, id_col, partial(distinct_texts, tries=tries), ["letter", "option"], repeats)


def task_failures(tasks: DataFrame, hard: bool = False) -> DataFrame:
    """Adds reasons to tasks with steps (parsed), literals, pool, inputs (names) and n_constraints."""
    low, high, least, chain = (7, 13, 5, True) if hard else (6, 12, 3, False)
    steps, inputs, names = F.col("steps"), F.col("inputs"), F.col("pool")
    outputs = F.transform(steps, lambda s: s["output"])
    actions = F.transform(steps, lambda s: s["action"])
    used = lambda s: F.transform(F.filter(F.map_values(s["inputs"]), lambda a: a["kind"] == "name"), lambda a: a["value"])
    made_before = lambda i: F.slice(outputs, F.lit(1), i)
    unknown = F.exists(F.transform(steps, lambda s, i: F.size(F.array_except(used(s), F.array_union(inputs, made_before(i)))) > 0), lambda x: x)
    references = F.aggregate(F.transform(steps, lambda s, i: F.size(F.filter(used(s), lambda n: F.array_contains(made_before(i), n)))), F.lit(0), lambda a, x: a + x)
    identifier = lambda x: x.rlike("^[A-Za-z_][A-Za-z0-9_]*$")
    tests = {
        "constraints": ~F.col("n_constraints").between(3, 10 if hard else 6),
        "inputs": ~F.size(inputs).between(3, 8) | ~F.forall(inputs, identifier) | (F.size(F.array_distinct(inputs)) < F.size(inputs)),
        "no_program": steps.isNull(),
        "program_length": ~F.size(steps).between(low, high),
        "outside_pool": F.size(F.array_except(actions, names)) > 0,
        "no_repeat": F.size(F.array_distinct(actions)) == F.size(actions),
        "few_numbers": F.col("literals") < least,
        "unassigned": F.exists(outputs, lambda o: o.isNull()),
        "expression": F.exists(steps, lambda s: F.exists(F.map_values(s["inputs"]), lambda a: a["kind"] == "expression")),
        "unknown_name": unknown,
    }
    if chain:
        tests["short_chain"] = references < F.greatest(F.lit(4), F.floor(F.size(steps) / 2).cast("int"))
    return tasks.withColumn("reasons", reasons(**tests))


def generate(items: DataFrame, prompt_col: str, model, validate, tries: int = 3, solved=None, rounds: int = 1, advice: dict[str, str] | None = None) -> DataFrame:
    """``items`` with result and error: a model's reply is validated, and a refusal's reason is added to the next prompt.

    ``model`` maps a prompt to a reply, ``validate`` a reply to None or a reason.  ``solved`` tells whether a solver answers a valid reply correctly; one
    that it answers in any of ``rounds`` is too easy and is refused as well.  ``advice`` maps a part of a reason to what is said after it.  A null prompt isn't sent.
    """
    schema = ", ".join(f"`{n}` {t}" for n, t in items.dtypes) + ", result string, error string, tries int"

    def refusal(reply: str) -> str | None:
        reason = validate(reply)
        if reason is None and solved is not None:
            n = next((n for n in range(1, rounds + 1) if solved(reply)), None)
            return n and f"it was solved (round {n} of {rounds})"
        return reason

    def one(prompt: str | None) -> tuple[str | None, str | None, int]:
        if not isinstance(prompt, str):
            return None, "no prompt", 0
        said = prompt
        reason = "no try"
        for n in range(1, tries + 1):
            try:
                reply = model(said)
                reason = refusal(reply)
            except Exception as e:  # noqa: BLE001  any failure of a call or of a check is a refusal
                reply, reason = None, f"{type(e).__name__}: {e}"
            if reason is None:
                return reply, None, n
            hints = "".join(f" {text}" for part, text in (advice or {}).items() if part in reason)
            said = f"{prompt}\nThe last reply was refused: {reason}{hints}"
        return None, reason, tries

    at = items.columns.index(prompt_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = max(1, batch.num_rows * PIECE_BYTES // max(1, batch.column(at).nbytes))
            for piece in (batch.slice(i, size) for i in range(0, batch.num_rows, size)):
                found = [one(p) for p in piece.column(at).to_pylist()]
                made = [pa.array([f[i] for f in found], kind) for i, kind in enumerate((pa.string(), pa.string(), pa.int32()))]
                yield pa.RecordBatch.from_arrays([*piece.columns, *made], names=[*piece.schema.names, "result", "error", "tries"])

    return items.mapInArrow(run, schema)
