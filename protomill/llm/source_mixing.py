"""Mixing sources to target weights by Pfair scheduling of blocks.

The documents of a source are ranked by id and cut into blocks of ``block_docs``.  Block j (from 0) of a
source with share w is released at slot floor(j / w) and due by slot ceil((j + 1) / w); of the released
blocks the one with the earliest deadline takes the next slot.  With shares that sum to one, each source's
count of blocks then stays within one block of its share of the slots.

Shares are exact: weights become whole parts over their common denominator, and a period has as many slots as there are
parts (a float counts as the decimal that it prints as).  All deviations are zero at the end of a period, so the schedule of one
period repeats, and the slot of any block follows from its number by arithmetic.  When a source runs out, a new phase
with the remaining sources' shares begins at that slot; there are at most as many phases as sources.  Nothing is dropped:
the last phase ends with the last block of the last source.  The driver schedules one period of a phase, or the phase up to its
end if that is shorter, and so never more slots than there are blocks.

What reaches the driver is one count for each source; the schedule has a row for each source and phase, so at most the square of the
number of sources (a few thousand sources are what it is meant for).  Ranks come from two levels: documents are dealt into
(source, bucket) groups of about ``bucket_docs`` rows, ranked there, and shifted by the counts of the
source's earlier buckets, so a source with a third of all rows is ranked by many tasks.

Null sources form a source of their own, with the weight given for ``None`` (1 by default, like every source
without a weight).  Weights must be positive.  Rows that repeat are ranked next to each other.  Columns may have any names; those of the new ones are replaced.  An empty table gives no rows.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from fractions import Fraction
from math import gcd, lcm

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from protomill.llm.common import numbered

#: Numbers of a schedule up to which it is broadcast (32 MB).
BROADCAST_NUMBERS = 1 << 22

def parts_of(weights: dict, period: int | None = None) -> dict:
    """Whole parts for each source that stand to each other exactly as the weights do.

    With ``period``, parts of so many slots by largest remainders instead, one at least.
    """
    given = {s: Fraction(str(w)) if isinstance(w, float) else Fraction(w) for s, w in weights.items()}
    if period is None:
        common = lcm(*[w.denominator for w in given.values()])
        parts = {s: int(w * common) for s, w in given.items()}
        shared = gcd(*parts.values())
        return {s: p // shared for s, p in parts.items()}
    total = sum(given.values())
    period = max(period, len(weights))
    exact = {s: w * period / total for s, w in given.items()}
    parts = {s: max(1, int(x)) for s, x in exact.items()}
    order = sorted(exact, key=lambda s: (int(exact[s]) - exact[s], str(s)))
    k = 0
    while sum(parts.values()) < period:
        parts[order[k % len(order)]] += 1
        k += 1
    while sum(parts.values()) > period:
        largest = max(parts, key=lambda s: (parts[s], str(s)))
        parts[largest] -= 1
    return parts


def one_period(parts: dict, blocks: dict | None = None) -> list:
    """The source of each slot of a period: earliest deadline first among released blocks.

    With counts of ``blocks``, it ends early at the slot of the first source's last block.
    """
    period = sum(parts.values())
    left = dict(blocks or {})
    coming = [(0, str(s), k, s, 0) for k, s in enumerate(parts)]  # every source's next block by release
    heapq.heapify(coming)
    ready, slots = [], []
    for t in range(period):
        while coming and coming[0][0] <= t:
            _, name, k, s, j = heapq.heappop(coming)
            p = parts[s]
            heapq.heappush(ready, (-(-(j + 1) * period // p), name, k, s))
            if j + 1 < p:
                heapq.heappush(coming, ((j + 1) * period // p, name, k, s, j + 1))
        s = heapq.heappop(ready)[3]
        slots.append(s)
        if blocks is not None:
            left[s] -= 1
            if not left[s]:
                break
    return slots


def phases(blocks: dict, weights: dict, period: int | None = None) -> list[dict]:
    """The schedule in closed form, for counts of blocks by source.

    Each phase has its first slot ``at``, the ``offset`` of every active source's blocks, its ``parts`` of ``size`` slots, and for
    each source the slots in ``pattern``: those of one period, or of the whole phase if it ends within the first.
    """
    left, done, at, out = {s: n for s, n in blocks.items() if n > 0}, {s: 0 for s in blocks}, 0, []
    while left:
        parts = parts_of({s: weights.get(s, 1) for s in left}, period)
        size = sum(parts.values())
        slots = one_period(parts, left)
        pattern: dict = {s: [] for s in left}
        for t, s in enumerate(slots):
            pattern[s].append(t)
        # the slot after the first source's last block
        end = len(slots)
        if end == size:
            end = min((n - 1) // parts[s] * size + pattern[s][(n - 1) % parts[s]] + 1 for s, n in left.items())
        out.append({"at": at, "size": size, "end": at + end, "offset": {s: done[s] for s in left}, "parts": parts, "pattern": pattern})
        whole, rest = divmod(end, size)
        for s in list(left):
            used = whole * parts[s] + bisect_left(pattern[s], rest)
            left[s] -= used
            done[s] += used
            if not left[s]:
                del left[s]
        at += end
    return out


def ranked(df: DataFrame, source_col: str, order_cols: list[str], bucket_docs: int = 5000) -> DataFrame:
    """Adds ``__rank``, the row's number (from 0) in its source; no task holds a whole source."""
    rows = df.count()
    buckets = max(1, -(-rows // bucket_docs))
    key = F.struct(*[F.col(c) for c in order_cols])
    dealt = df.withColumn("__bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    group = [F.col(source_col), F.col("__bucket")]
    counts = dealt.groupBy(group[0].alias("__s"), group[1].alias("__b")).agg(F.count("*").alias("__n"))
    before = Window.partitionBy("__s").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    shift = counts.withColumn("__shift", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    inside = dealt.withColumn("__in", F.row_number().over(Window.partitionBy(*group).orderBy(*order_cols)) - 1)
    on = inside[source_col].eqNullSafe(shift["__s"]) & (inside["__bucket"] == shift["__b"])
    out = inside.join(shift, on).withColumn("__rank", F.col("__in") + F.col("__shift"))
    return out.drop("__bucket", "__s", "__b", "__n", "__shift", "__in")


def mix(
    df: DataFrame,
    weights: dict | None = None,
    source_col: str = "source",
    id_col: str = "doc_id",
    block_docs: int = 16,
    period: int | None = None,
    tie_cols: list[str] | None = None,
) -> DataFrame:
    """``df`` with its place in the mixture: block, slot, release, deadline and position.

    ``block`` counts within the source, ``slot`` over the whole mixture; ``release`` and ``deadline`` are the
    block's window of slots; ``position`` numbers a document within its slot.  ``tie_cols`` order rows with the same id.
    """
    weights = weights or {}
    spark = df.sparkSession
    added = ["block", "slot", "release", "deadline", "position"]
    kept = df.drop(*added)
    own, names = numbered(kept, [source_col, id_col, *(tie_cols or [])])
    counts = {r[0]: r[1] for r in own.groupBy(source_col).count().collect()}
    plan = phases({s: -(-n // block_docs) for s, n in counts.items()}, weights, period)
    table = []
    for p in plan:
        for s, slots in p["pattern"].items():
            size, parts = p["size"], p["parts"][s]
            begins = [j * size // parts for j in range(len(slots))]
            ends = [-(-(j + 1) * size // parts) for j in range(len(slots))]
            # what ends within its first period never steps into a second
            step, each = (size, parts) if len(slots) == parts else (0, max(1, len(slots)))
            table.append((s, p["offset"][s], p["at"], step, each, slots, begins, ends))
    lists = ", ".join(f"{c} array<long>" for c in ("__slots", "__begins", "__ends"))
    schema = f"__s {dict(own.dtypes)[source_col]}, __first long, __at long, __size long, __parts long, {lists}"
    made = spark.createDataFrame(table, schema)
    # a phase of a source holds the blocks from its offset up to the next phase's
    nxt = F.lead("__first").over(Window.partitionBy("__s").orderBy("__at"))
    made = made.withColumn("__last", F.coalesce(nxt, F.lit(1 << 62)))
    rows = ranked(own, source_col, [id_col, *(tie_cols or [])])
    rows = rows.withColumn("block", F.floor(F.col("__rank") / block_docs).cast("long"))
    on = rows[source_col].eqNullSafe(made["__s"]) & (rows["block"] >= made["__first"]) & (rows["block"] < made["__last"])
    # a row for each source and phase, with its slots of one period; with very many sources or phases, too many to send to every task
    small = sum(6 + 3 * len(row[5]) for row in table) <= BROADCAST_NUMBERS
    out = rows.join(F.broadcast(made) if small else made, on)
    j = F.col("block") - F.col("__first")
    base = F.col("__at") + F.floor(j / F.col("__parts")) * F.col("__size")
    at = F.pmod(j, F.col("__parts")).cast("int")  # get() gives null outside a list: a filter may look at rows before the join does
    placed = out.select(
        *names,
        "block",
        (base + F.get("__slots", at)).cast("long").alias("slot"),
        (base + F.get("__begins", at)).cast("long").alias("release"),
        (base + F.get("__ends", at)).cast("long").alias("deadline"),
        F.pmod(F.col("__rank"), F.lit(block_docs)).cast("int").alias("position"),
    )
    return placed.toDF(*kept.columns, *added)


def in_order(mixed: DataFrame) -> DataFrame:
    """The documents in the order of the mixture, over as many files as the session shuffles to."""
    return mixed.repartitionByRange("slot", "position").sortWithinPartitions("slot", "position")
