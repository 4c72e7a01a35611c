"""Operators on ordered steps of procedures: stages, windows, scores, selection.

A table of steps has one row for each step: an id, a position, a stage (may be empty), a text.  Window functions are
partitioned by the id, so a task sorts one procedure's steps at a time.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from protomill.functions import fixed_values as V
from protomill.functions import text as X


def lines_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Steps from the lines of a text: id, line_no (from 1), line."""
    cut = F.posexplode(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")).alias("p", "line")
    return docs.select(id_col, cut).select(id_col, (F.col("p") + 1).alias("line_no"), "line")


def carry_forward(df: DataFrame, id_col: str, pos_col: str, value_col: str, out_col: str, default: Column | None = None) -> DataFrame:
    """The last non-empty value up to each row; ``default`` (or empty) before the first."""
    w = Window.partitionBy(id_col).orderBy(pos_col).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = F.last(F.nullif(F.col(value_col), F.lit("")), ignorenulls=True).over(w)
    return df.withColumn(out_col, F.coalesce(filled, default if default is not None else F.lit("")))


def build_steps(raw: DataFrame, titles: DataFrame, id_col: str, pos_col: str) -> DataFrame:
    """id, idx, stage, description and fallback from raw rows (id, pos, section, text) and titles (id, title).

    Rows with an empty text go before they can set the stage.  Before the first section the title stands in.
    """
    kept = raw.withColumns({"description": X.normalize(F.col("text")), "own": X.normalize(F.col("section"))}).where("description <> ''")
    joined = kept.join(titles.select(id_col, X.normalize(F.col("title")).alias("title")), id_col, "left")
    filled = carry_forward(joined, id_col, pos_col, "own", "carried")
    order = Window.partitionBy(id_col).orderBy(pos_col)
    return filled.select(
        id_col,
        F.row_number().over(order).alias("idx"),
        F.coalesce(F.nullif("carried", F.lit("")), "title", F.lit("")).alias("stage"),
        "description",
        (F.col("carried") == "").alias("fallback"),
    )


def step_features(steps: DataFrame, patterns: dict[str, str] | None = None, headings: str = V.GENERIC_HEADINGS, shortest: int = 18) -> DataFrame:
    """Adds a 0/1 column f_<family> for each family, numbers (capped at 4), all_numbers and generic."""
    patterns = patterns or V.FAMILY_PATTERNS
    low = F.lower("description")
    mentions = X.number_mentions(F.col("description"))
    return steps.withColumns(
        {f"f_{f}": low.rlike(p).cast("int") for f, p in patterns.items()}
        | {
            "numbers": F.least(mentions, F.lit(4)),
            "all_numbers": mentions,
            "generic": X.is_generic_step(F.col("description"), headings, shortest).cast("int"),
        }
    )


def window_lengths(shortest: int, longest: int) -> list[int]:
    return sorted({shortest, longest, max(shortest, min(longest, (shortest + longest) // 2))})


def sliding_windows(steps: DataFrame, lengths: list[int], names: list[str], id_col: str = "doc_id", pos_col: str = "idx") -> DataFrame:
    """Every full window of the given lengths, with the counts that scoring needs.

    The result has id, start, length, counts c_<family>, numbers, all_numbers, generic, and stages (distinct and non-empty).
    The frames of all lengths share one sort of each procedure.
    """
    order = Window.partitionBy(id_col).orderBy(pos_col)
    found: dict[str, Column] = {}
    for n in lengths:
        frame = order.rowsBetween(Window.currentRow, n - 1)
        found[f"w{n}"] = F.struct(
            F.lit(n).alias("length"),
            F.count(F.lit(1)).over(frame).alias("rows"),
            *[F.sum(f"f_{f}").over(frame).alias(f"c_{f}") for f in names],
            *[F.sum(c).over(frame).alias(c) for c in ("numbers", "all_numbers", "generic")],
            F.size(F.collect_set(F.nullif("stage", F.lit(""))).over(frame)).alias("stages"),
        )
    wide = steps.select(id_col, F.col(pos_col).alias("start"), *[c.alias(k) for k, c in found.items()])
    each = wide.select(id_col, "start", F.explode(F.array(*found)).alias("w"))
    return each.where("w.rows = w.length").select(id_col, "start", "w.*").drop("rows")


def _total(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns, F.lit(0))


def score_windows(windows: DataFrame, names: list[str], repeat: tuple = V.REPEAT_FAMILIES, core: tuple = V.CORE_FAMILIES, device: str = "device") -> DataFrame:
    """Adds distinct_families and score to sliding_windows()."""
    count = {f: F.col(f"c_{f}") for f in names}
    distinct = _total([(count[f] > 0).cast("int") for f in names])
    repeats = _total([F.greatest(count[f] - 1, F.lit(0)) for f in names if f in repeat])
    rich = _total([(count[f] >= 2).cast("int") for f in names])
    cores = _total([(count[f] >= 2).cast("int") for f in names if f in core])
    penalty = 0.75 * count[device] if device in count else F.lit(0.0)
    score = (
        1.5 * F.col("length")
        + 2.0 * distinct
        + 3.0 * repeats
        + 1.75 * rich
        + 2.5 * cores
        + 0.75 * F.col("numbers")
        + F.when(F.col("stages") <= 2, F.lit(2.0)).otherwise(F.lit(0.0))
        - penalty
        - 2.0 * F.col("generic")
    )
    return windows.withColumns({"distinct_families": distinct, "score": score})


def is_hard(names: list[str], families: tuple = V.REPEAT_FAMILIES, repeated: int = 2, numbers: int = 5, steps: int = 8) -> Column:
    """Two repeated families, five numbers and eight steps at least."""
    again = _total([(F.col(f"c_{f}") >= 2).cast("int") for f in names if f in families])
    return (again >= repeated) & (F.col("all_numbers") >= numbers) & (F.col("length") >= steps)


def top_per_group(df: DataFrame, group: str | list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group; the order should end with a tie-breaker."""
    keys = [group] if isinstance(group, str) else group
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rank", rank).where(F.col("__rank") <= k).drop("__rank")


def select_capped(df: DataFrame, group: str, order: list[Column], cap: int, count: int) -> DataFrame:
    """A greedy scan in ``order`` that takes at most ``cap`` rows of a group and stops at ``count``."""
    return top_per_group(df, group, order, cap).orderBy(*order).limit(count)


def nearby(steps: DataFrame, relevant: DataFrame, id_col: str, pos_col: str, distance: int = 2, k: int = 8) -> DataFrame:
    """Steps within ``distance`` of a relevant one that are not relevant themselves; at most k for each id, nearest first.

    Both tables have id, position and stage; the result adds distance and same_stage.  The band join is written as an equality
    join on (id, position), each relevant step being spread over its neighbours, so no task compares all pairs of a long procedure.
    """
    offset = F.explode(F.sequence(F.lit(-distance), F.lit(distance)))
    spread = relevant.select(id_col, F.col(pos_col).alias("__at"), offset.alias("__off"))
    spread = spread.select(id_col, (F.col("__at") + F.col("__off")).alias(pos_col), F.abs("__off").alias("__d"))
    reach = spread.groupBy(id_col, pos_col).agg(F.min("__d").alias("distance")).where("distance > 0")
    stages = relevant.where("stage <> ''").select(id_col, X.search_key(F.col("stage"), False).alias("__stage")).distinct().withColumn("__same", F.lit(True))
    near = steps.join(reach, [id_col, pos_col]).withColumn("__stage", X.search_key(F.col("stage"), False))
    near = near.join(stages, [id_col, "__stage"], "left").withColumn("same_stage", F.coalesce("__same", F.lit(False)) & (F.col("__stage") != ""))
    order = [F.col("distance"), F.col("same_stage").desc(), F.col(pos_col)]
    return top_per_group(near.drop("__same", "__stage"), id_col, order, k)


def first_wins(df: DataFrame, keys: list[Column], order: list[Column]) -> DataFrame:
    """The first row of each combination of keys."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def occurrences(df: DataFrame, id_col: str, pos_col: str, action_col: str) -> DataFrame:
    """Adds label: the action with the number of its occurrence, as ``wash#2``."""
    n = F.row_number().over(Window.partitionBy(id_col, action_col).orderBy(pos_col))
    return df.withColumn("label", F.concat(F.col(action_col), F.lit("#"), n.cast("string")))


def action_pool(families: Column, low_level: Column, hard: Column) -> Column:
    """Names of the actions offered for a window, from its sorted families; cut to 12, or 14 when hard."""
    has = lambda f: F.array_contains(families, f)
    some = lambda names: F.array(*[F.lit(n) for n in names])
    none = F.array().cast("array<string>")
    only_if = lambda cond, names: F.when(cond, some(names)).otherwise(none)
    parts = [only_if(has(f), V.FAMILY_ACTIONS[f]) for f in sorted(V.FAMILY_ACTIONS) if f != "manipulate"]
    parts += [
        only_if(has("transfer") & ~has("wash"), V.FAMILY_ACTIONS["wash"]),
        only_if(has("wash") & ~has("transfer"), V.FAMILY_ACTIONS["transfer"]),
        only_if(has("incubate") & ~has("device"), ("seal_plate",)),
        only_if(has("centrifuge"), ("wash_pellet", "discard_supernatant", "resuspend_pellet")),
        only_if(has("mix"), ("incubate_sample", "cool_sample")),
        only_if(has("measure"), ("store_sample", "mix_sample")),
        some(V.DISTRACTOR_ACTIONS),
        only_if(low_level, V.LOW_LEVEL_ACTIONS),
    ]
    return F.slice(F.array_distinct(F.concat(*parts)), F.lit(1), F.when(hard, 14).otherwise(12))
