"""Matching documents with a catalog of aliases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from protomill.functions import fixed_values as V
from protomill.functions import text as X


def alias_table(spark: SparkSession, groups: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """(ord, group_id, alias, n_words) with normalised aliases; a catalog of some hundred rows."""
    rows = [(i, g, a) for i, (g, aliases) in enumerate((groups or V.MATCH_GROUPS).items()) for a in aliases]
    table = spark.createDataFrame(rows, "ord int, group_id string, alias string")
    keyed = table.withColumn("alias", X.search_key(F.col("alias")))
    return keyed.withColumn("n_words", F.size(F.split("alias", " "))).distinct()


def search_corpus(title: Column, background: Column, names: Column, steps: Column | None = None) -> Column:
    """The text that aliases are looked up in.

    Without ``steps`` the two keys of a procedure stand for it, as in published matches; with them, the steps' text.
    """
    tail = F.array_join(steps, " ") if steps is not None else F.lit("steps troubleshooting")
    return X.search_key(F.concat_ws(" ", title, background, F.array_join(names, " "), tail))


def match_aliases(docs: DataFrame, aliases: DataFrame, id_col: str, corpus_col: str) -> DataFrame:
    """(id, group_id) for every group with an alias in the normalised text, at word boundaries.

    The words' n-grams meet the aliases in a hash join; a theta join would test every pattern on every text.  Inside the array of a text's words only those that start some alias are kept,
    each with as many words behind it as the longest alias has.  The catalog is a bounded literal, so its first words are listed on the driver and it is broadcast.
    """
    heads = aliases.select(F.split_part("alias", F.lit(" "), F.lit(1)).alias("first"), "alias", "n_words", "group_id")
    known = heads.groupBy("first").agg(F.max("n_words").alias("n")).collect()
    firsts, longest = [r["first"] for r in known], max((r["n"] for r in known), default=1)
    words = docs.select(id_col, F.split(F.col(corpus_col), " ").alias("w"))
    spot = lambda x, i: F.when(x.isin(*firsts), F.struct(x.alias("first"), F.slice("w", i + 1, F.lit(longest)).alias("words")))
    starts = words.select(id_col, F.explode(F.array_compact(F.transform("w", spot))).alias("s")).select(id_col, "s.first", "s.words")
    hit = starts.join(F.broadcast(heads), "first")
    return hit.where(F.array_join(F.slice("words", F.lit(1), F.col("n_words")), " ") == F.col("alias")).select(id_col, "group_id").distinct()


def match_by_pattern(docs: DataFrame, aliases: DataFrame, id_col: str, corpus_col: str) -> DataFrame:
    """The same by padded substring test, for checks on small tables."""
    padded = F.concat(F.lit(" "), F.col(corpus_col), F.lit(" "))
    hit = docs.join(F.broadcast(aliases), F.contains(padded, F.concat(F.lit(" "), F.col("alias"), F.lit(" "))))
    return hit.select(id_col, "group_id").distinct()


def groups_of(corpus: Column, groups: dict[str, tuple[str, ...]] | None = None) -> Column:
    """The groups with an alias at word boundaries of one normalised text, as padded substring tests.

    A predicate on each row, without a join; match_aliases() is meant for catalogs of many aliases.
    """
    padded = F.concat(F.lit(" "), corpus, F.lit(" "))
    holds = lambda aliases: F.exists(
        F.array(*[X.search_key(F.lit(a)) for a in aliases]), lambda a: F.contains(padded, F.concat(F.lit(" "), a, F.lit(" ")))
    )
    return F.array_compact(F.array(*[F.when(holds(aliases), F.lit(g)) for g, aliases in (groups or V.MATCH_GROUPS).items()]))


def attach_entries(matched: DataFrame, entries: DataFrame, id_col: str) -> DataFrame:
    """Groups and candidate entries of every matched id, each entry once, in group order.

    ``entries`` has ord, group_id and entry_id; ids without a group are left out.
    """
    joined = matched.join(entries, "group_id")  # small catalogs are broadcast by their size
    firsts = joined.groupBy(id_col, "entry_id").agg(F.min("ord").alias("ord"))
    groups = joined.groupBy(id_col).agg(F.array_sort(F.collect_set(F.struct("ord", "group_id"))).alias("g"))
    listed = firsts.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("ord", "entry_id"))).alias("e"))
    return groups.join(listed, id_col).select(
        id_col, F.array_distinct(F.transform("g", lambda x: x["group_id"])).alias("matched_groups"), F.transform("e", lambda x: x["entry_id"]).alias("candidate_entries")
    )


def group_counts(matched: DataFrame, aliases: DataFrame) -> DataFrame:
    """Matched ids of every group, zero included."""
    n = matched.groupBy("group_id").agg(F.count("*").alias("n"))
    return aliases.select("group_id").distinct().join(n, "group_id", "left").select("group_id", F.coalesce("n", F.lit(0)).alias("n"))
