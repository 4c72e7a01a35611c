"""Operators on whole records: gates with reasons, minimal records, deduplication, reports, upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from protomill.functions import text as X


def reasons(**failed: Column) -> Column:
    """An array of the names whose condition holds, in the order given (a null condition counts as not failed)."""
    return F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in failed.items()]))


def quality_gate(df: DataFrame, min_reagents: int = 3, min_steps: int = 3, min_chars: int = 150) -> DataFrame:
    """Adds qc_flags, qc_pass and qc_score to rows with n_reagents, n_equipment, n_steps, materials_raw, title, doi, pmcid, ...

    A missing id is flagged and doesn't fail a row.
    """
    thin = (F.col("n_equipment") < 1) & (F.length("materials_raw") < min_chars)
    flags = {
        "reagents_lt_min": F.col("n_reagents") < min_reagents,
        "materials_thin": thin,
        "steps_lt_min": F.col("n_steps") < min_steps,
        "no_title": F.col("title") == "",
        "no_id": (F.col("doi") == "") & (F.col("pmcid") == ""),
    }
    failing = flags["reagents_lt_min"] | flags["materials_thin"] | flags["steps_lt_min"] | flags["no_title"]
    score = X.qc_score(
        F.col("n_reagents"), F.col("n_equipment"), F.col("n_steps"), F.col("n_troubleshooting") > 0, F.col("timing") != "", F.col("abstract") != ""
    )
    return df.withColumns({"qc_flags": reasons(**flags), "qc_pass": ~failing, "qc_score": score})


def minimal_gate(df: DataFrame, order: list[Column], min_reagents: int = 5, min_equipment: int = 2, min_steps: int = 20, min_stages: int = 3) -> DataFrame:
    """Adds reasons (empty: kept) to rows with id, title, background, n_reagents, n_equipment, n_steps and n_stages.

    ``duplicate_id`` holds only if an earlier row (in ``order``) with the id passed all other tests.
    """
    others = {
        "empty_title": F.col("title") == "",
        "empty_background": F.col("background") == "",
        "reagents": F.col("n_reagents") < min_reagents,
        "equipment": F.col("n_equipment") < min_equipment,
        "steps": F.col("n_steps") < min_steps,
        "unique_stages": F.col("n_stages") < min_stages,
    }
    checked = df.withColumn("__fine", ~F.exists(F.array(*[F.coalesce(c, F.lit(False)) for c in others.values()]), lambda x: x) & (F.col("id") != ""))
    before = Window.partitionBy("id").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    seen = F.coalesce(F.bool_or("__fine").over(before), F.lit(False))
    first = {"empty_id": F.col("id") == "", "duplicate_id": (F.col("id") != "") & F.col("__seen")}
    # rows without an id repeat none, and could all meet in one task of the window
    named = F.coalesce(F.col("id") != "", F.lit(False))
    whole = checked.where(named).withColumn("__seen", seen).unionByName(checked.where(~named).withColumn("__seen", F.lit(False)))
    return whole.withColumn("reasons", reasons(**first, **others)).drop("__fine", "__seen")


def dedupe_items(df: DataFrame, id_col: str, pos_col: str, name: str = "name", vendor: str = "vendor", identifier: str = "identifier") -> DataFrame:
    """The first of items with the same name, vendor and identifier in any case; items without a name go."""
    keys = [F.col(id_col), *[F.lower(F.col(c)) for c in (name, vendor, identifier)]]
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(pos_col))
    return df.where(F.col(name) != "").withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def upper_median(c: Column) -> Column:
    """The element at half the count of the sorted values, as ``sorted(x)[len(x) // 2]``.

    An aggregate that collects a group's values, for groups known to be small; upper_medians() counts instead.
    """
    return F.element_at(F.sort_array(F.collect_list(c)), (F.floor(F.count(c) / 2) + 1).cast("int"))


def upper_medians(df: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """upper_median() of several integer columns by group, from frequencies instead of collected lists."""
    out = None
    for c in columns:
        counted = df.where(F.col(c).isNotNull()).groupBy(group, c).agg(F.count("*").alias("__n"))
        upto = Window.partitionBy(group).orderBy(c).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        whole = Window.partitionBy(group)
        placed = counted.withColumns({"__upto": F.sum("__n").over(upto), "__all": F.sum("__n").over(whole)})
        one = placed.where(F.col("__upto") > F.floor(F.col("__all") / 2)).groupBy(group).agg(F.min(c).alias(f"median_{c}"))
        out = one if out is None else out.join(one, group, "full")
    return out


def latest(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The last row of each key."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*[c.desc() for c in order]))
    return df.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def upsert(base: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``base`` with ``columns`` replaced in every row whose key is in ``changes`` (one row for each key there)."""
    new = changes.select(key, F.lit(True).alias("__hit"), *[F.col(c).alias(f"__{c}") for c in columns])
    joined = base.join(new, key, "left")
    return joined.select(*[F.when(F.col("__hit"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in base.columns])


def pending(todo: DataFrame, done: DataFrame, key: str, value: str, order: list[Column]) -> DataFrame:
    """Work items without a valid last result."""
    valid = latest(done, key, order).where(F.col(value).isNotNull())
    return todo.join(valid.select(key), key, "left_anti")


def reason_counts(df: DataFrame, column: str = "reasons") -> DataFrame:
    return df.select(F.explode(column).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def first_of_name(rows: DataFrame, id_col: str, pos_col: str, name: str = "name") -> DataFrame:
    """The first row of each name (in any case) of an id."""
    rank = F.row_number().over(Window.partitionBy(id_col, F.lower(F.col(name))).orderBy(pos_col))
    return rows.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def add_missing(have: DataFrame, mined: DataFrame, id_col: str, fewest: int, name: str = "name") -> DataFrame:
    """``have`` and, for ids with fewer than ``fewest`` rows there, the mined rows whose name isn't there yet.

    Ids that have no row at all are served as well.
    """
    enough = have.groupBy(id_col).agg(F.count("*").alias("__n")).where(F.col("__n") >= fewest).select(id_col)
    extra = mined.join(enough, id_col, "left_anti").withColumn("__key", F.lower(F.col(name)))
    known = have.select(id_col, F.lower(F.col(name)).alias("__key")).distinct()
    return have.unionByName(extra.join(known, [id_col, "__key"], "left_anti").drop("__key"), allowMissingColumns=True)


def record_id(source: Column, pmcid: Column, doi: Column) -> Column:
    """``source:pmcid``, or ``source:doi`` where the pmcid is null or empty."""
    return F.concat_ws(":", source, F.coalesce(F.nullif(pmcid, F.lit("")), doi))


def with_defaults(df: DataFrame, **defaults: object) -> DataFrame:
    """``df`` with a default wherever one of the named columns is null or empty."""
    return df.withColumns({c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(v)) for c, v in defaults.items()})


def minimal_record(df: DataFrame) -> DataFrame:
    """Adds background, materials and procedure to rows with title, abstract, reagents, equipment and troubleshooting.

    The abstract stands for the background, and the title where it is null or empty; a reagent's identifier is its catalog number, a device's its model; pairs of a
    problem and a solution stay unless both are empty.
    """
    named = lambda items, key: F.transform(items, lambda x: F.struct(x["name"].alias("name"), x[key].alias("identifier")))
    told = F.filter("troubleshooting", lambda t: (t["problem"] != "") | (t["solution"] != ""))
    return df.withColumns(
        {
            "background": F.coalesce(F.nullif("abstract", F.lit("")), F.col("title")),
            "materials": F.struct(named(F.col("reagents"), "catalog_id").alias("reagents"), named(F.col("equipment"), "model").alias("equipment")),
            "procedure": F.struct(told.alias("troubleshooting")),
        }
    )


def unseen(rows: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """Rows that have a key which isn't in ``seen`` yet: what a crawl goes on with."""
    return rows.where(F.col(key).isNotNull()).join(seen.select(key), key, "left_anti")


def cache_counts(cache: DataFrame, value: str) -> DataFrame:
    """One row: results that are valid (not null), and those that are due again."""
    return cache.agg(F.count(value).alias("valid"), F.count_if(F.col(value).isNull()).alias("again"))


def run_counters(attempts: DataFrame, by: str) -> DataFrame:
    """Counters of a crawl from its attempts (skipped, error, qc_pass): skipped ones are not fetched, failed ones not parsed."""
    tried = ~F.col("skipped")
    parsed = tried & F.col("error").isNull()
    counters = {
        "skipped": F.col("skipped"), "fetched": tried, "errors": tried & F.col("error").isNotNull(),
        "parsed": parsed, "passed": parsed & F.col("qc_pass"), "failed": parsed & ~F.col("qc_pass"),
    }
    return attempts.groupBy(by).agg(*[F.count_if(c).alias(n) for n, c in counters.items()])


def action_counts(rows: DataFrame, key: str, action: str) -> DataFrame:
    """The count of each key's commonest action, and the actions that repeat, in order."""
    n = rows.groupBy(key, action).agg(F.count("*").alias("n"))
    names = F.array_sort(F.collect_list(F.when(F.col("n") >= 2, F.col(action))))
    return n.groupBy(key).agg(F.max("n").alias("most"), names.alias("repeated"))


def license_bucket(text: Column) -> Column:
    """A coarse class of the license that a text names."""
    return F.when(text.contains("CC BY-NC"), "BY-NC").when(text.contains("CC BY"), "BY").when(text.contains("Apache License") | text.contains("MIT License"), "other").otherwise("unknown")


def score_tenths(df: DataFrame, score: str) -> DataFrame:
    """A histogram of scores by tenths."""
    return df.groupBy(F.floor(F.col(score) * 10).cast("int").alias("tenth")).agg(F.count("*").alias("n"))


def checkpoint_state(saved: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    """What an append-only checkpoint amounts to: how often each key was saved, and its last value."""
    return saved.groupBy(key).agg(F.count("*").alias("saved"), F.max_by(value, F.struct(*order)).alias("current"))
