"""Scores of answers and sequences, as joins and aggregates."""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from protomill.operators.steps import occurrences

#: Ranks of a sequence that are counted together.
BLOCK = 4096


def answer_summary(df: DataFrame, gold: str = "gold", pred: str = "pred", cost: str | None = None, model: str | None = None) -> DataFrame:
    """count, correct, invalid and accuracy (an invalid answer is wrong), with cost and models if named."""
    right = F.col(pred).eqNullSafe(F.col(gold))
    extra = [F.round(F.coalesce(F.sum(F.col(cost).try_cast("double")), F.lit(0.0)), 6).alias("cost")] if cost else []
    extra += [F.array_join(F.sort_array(F.collect_set(model)), ",").alias("models")] if model else []
    return df.agg(
        F.count("*").alias("count"),
        F.count_if(right).alias("correct"),
        F.count_if(F.col(pred).isNull()).alias("invalid"),
        F.coalesce(F.avg(right.cast("double")), F.lit(0.0)).alias("accuracy"),
        *extra,
    )


def mean_scores(df: DataFrame, columns: list[str]) -> DataFrame:
    """Means over all rows, missing scores as zero, and the number of rows without any."""
    none = F.coalesce(*[F.col(c) for c in columns]).isNull()
    return df.agg(F.count("*").alias("count"), F.count_if(none).alias("invalid"), *[F.avg(F.coalesce(F.col(c), F.lit(0.0))).alias(c) for c in columns])


def sequence_similarity(gold: DataFrame, pred: DataFrame, id_col: str, pos_col: str, action_col: str) -> DataFrame:
    """similarity by id: one less the share of inverted pairs, zero unless both sides have the same actions equally often.

    Both sides label occurrences and are joined on the label; a sequence may have any length.
    """
    g = occurrences(gold, id_col, pos_col, action_col).select(id_col, "label", F.row_number().over(_in(id_col, pos_col)).alias("i"))
    p = occurrences(pred, id_col, pos_col, action_col).select(id_col, "label", F.row_number().over(_in(id_col, pos_col)).alias("j"))
    both = g.join(p, [id_col, "label"], "full")
    per = both.groupBy(id_col).agg(F.count_if(F.col("i").isNull() | F.col("j").isNull()).alias("odd"), F.count("*").alias("n"))
    inverted = inversions(both.where("i is not null and j is not null"), id_col, "i", "j")
    per = per.join(inverted, id_col, "left").withColumn("inversions", F.coalesce("inversions", F.lit(0)))
    whole = F.col("n") * (F.col("n") - 1) / 2
    score = F.when(F.col("odd") > 0, F.lit(0.0)).when(F.col("n") <= 1, F.lit(1.0)).otherwise(1 - F.col("inversions") / whole)
    return per.select(id_col, F.round(score, 6).alias("similarity"))


def inversions(rows: DataFrame, id_col: str, first: str, second: str, block: int = BLOCK) -> DataFrame:
    """id and inversions: the pairs of an id's rows that ``first`` and ``second`` (ranks from 1, none twice) order differently; ids without any are left out.

    Ranks are cut into blocks on both sides.  Pairs within a block of first ranks, and pairs within a block of second ranks that are of different first
    ones, are counted by tasks that hold one block in memory; all others follow from how many rows each two blocks share.  So a sequence of n rows takes
    n log n steps, its rows are dealt to many tasks, and no pairs are made.
    """
    at = lambda c: F.floor((F.col(c) - 1) / block).cast("int")
    dealt = rows.select(F.col(id_col).alias("id"), F.col(first).cast("long").alias("i"), F.col(second).cast("long").alias("j"), at(first).alias("b"), at(second).alias("c"))
    kind = dict(dealt.dtypes)["id"]
    schema = f"id {kind}, inversions long"
    inside = dealt.repartition("id", "b").sortWithinPartitions("id", "b", "i").select("id", "b", "i", "j").mapInPandas(_inside, schema)
    across = dealt.repartition("id", "c").sortWithinPartitions("id", "c", "i").select("id", "c", "b", "j").mapInPandas(_across, schema)
    cells = dealt.groupBy("id", "b", "c").agg(F.count("*").alias("n"))
    apart = cells.repartition("id").sortWithinPartitions("id", "b", "c").mapInPandas(_apart, schema)
    found = inside.unionByName(across).unionByName(apart).groupBy("id").agg(F.sum("inversions").alias("inversions"))
    return found.where("inversions > 0").withColumnRenamed("id", id_col)


def _runs(batches: Iterator[pd.DataFrame], keys: int) -> Iterator[tuple[tuple, bool, list[tuple]]]:
    """(key, whether the run is new, rows) of neighbouring rows with equal first columns; a run may go on in the next batch."""
    last: object = object()
    for pdf in batches:
        if not len(pdf):
            continue
        columns = [pdf[c].to_numpy() for c in pdf.columns]
        change = np.zeros(len(pdf), dtype=bool)
        change[0] = True
        for c in columns[:keys]:
            change[1:] |= c[1:] != c[:-1]
        starts = np.nonzero(change)[0]
        for low, high in zip(starts, [*starts[1:], len(pdf)], strict=True):
            key = tuple(c[low] for c in columns[:keys])
            yield key, key != last, list(zip(*[c[low:high].tolist() for c in columns[keys:]], strict=True))
            last = key


def _inside(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Inversions within each block of first ranks; rows come by id, block and first rank."""
    below: list[int] = []
    for key, new, rows in _runs(batches, 2):
        below, count = [] if new else below, 0
        for _, j in rows:
            count += len(below) - bisect_right(below, j)
            insort(below, j)
        yield pd.DataFrame({"id": [key[0]], "inversions": [count]})


def _across(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Inversions of rows of one block of second ranks and different ones of first ranks; rows come by id, block and first rank."""
    done: list[int] = []
    own: list[int] = []
    at = -1
    for key, new, rows in _runs(batches, 2):
        if new:
            done, own, at = [], [], -1
        count = 0
        for b, j in rows:
            if b != at:
                done, own, at = sorted([*done, *own]), [], b
            count += len(done) - bisect_right(done, j)
            own.append(j)
        yield pd.DataFrame({"id": [key[0]], "inversions": [count]})


def _apart(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Inversions of rows that share neither block, from the numbers of rows by both; they come by id and blocks."""
    done = np.zeros(0, dtype=np.int64)
    own: dict[int, int] = {}
    at, above = -1, done
    for key, new, rows in _runs(batches, 1):
        if new:
            done, own, at, above = np.zeros(0, dtype=np.int64), {}, -1, np.zeros(0, dtype=np.int64)
        count = 0
        for b, c, n in rows:
            if b != at:
                size = max([len(done), *[x + 1 for x in own]])
                done = np.pad(done, (0, size - len(done)))
                for x, m in own.items():
                    done[x] += m
                above = np.append(np.cumsum(done[::-1])[::-1], 0)  # rows of earlier blocks with this second block or a later one
                own, at = {}, b
            count += n * int(above[min(c + 1, len(above) - 1)]) if len(above) else 0
            own[c] = n
        yield pd.DataFrame({"id": [key[0]], "inversions": [count]})


def _in(id_col: str, pos_col: str):
    from pyspark.sql import Window

    return Window.partitionBy(id_col).orderBy(pos_col)


def positional_similarity(gold: DataFrame, pred: DataFrame, id_col: str, pos_col: str, action_col: str) -> DataFrame:
    """similarity by id: equal actions at equal places over the longer length."""
    g = gold.select(id_col, F.row_number().over(_in(id_col, pos_col)).alias("k"), F.col(action_col).alias("g"))
    p = pred.select(id_col, F.row_number().over(_in(id_col, pos_col)).alias("k"), F.col(action_col).alias("p"))
    both = g.join(p, [id_col, "k"], "full")
    return both.groupBy(id_col).agg(F.round(F.count_if(F.col("g") == F.col("p")) / F.greatest(F.count("*"), F.lit(1)), 6).alias("similarity"))


def success_rates(df: DataFrame, task_col: str, success_col: str) -> DataFrame:
    """The success rate of each task."""
    return df.groupBy(task_col).agg(F.avg(F.col(success_col).cast("double")).alias("rate"), F.count("*").alias("episodes"))
