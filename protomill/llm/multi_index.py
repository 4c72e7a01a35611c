"""Approximate nearest neighbours by an inverted multi-index.

Each half of a vector is quantised with its own codebook of ``centroids`` entries, so a pair of centroids names a
cell.  A query ranks the centroids of each half by its half's inner product; the sum for a pair estimates the inner product with the
cell's vectors.  A heap walks the pairs from the best sum down until the visited cells hold the wanted share of all
vectors, and every vector in them is reranked with its exact inner product in double precision.

The codebooks are fitted on at most ``SAMPLE`` vectors (those whose ids have the smallest hashes); every vector is indexed.  The counts of
the cells (centroids squared) are the only other thing on the driver.

Vectors are dealt into blocks of about ``BLOCK_BYTES``: neighbouring small cells share one, and a cell beyond that size is spread over several, so no cell fills a task.  A query goes once to each
block that it visits, with the numbers of the cells it wants there.  Queries are dealt into parts of about ``PART_BYTES`` and each block meets each part in a task of its own, so both
sides of a task are bounded whatever the table.  Small tables make at least ``LEAST_BLOCKS`` blocks, so that there is work for many tasks.  What is shuffled is then the vectors once for each part, and
the queries once for each block.  Each task gives the best of every query; a window then takes the best over the tasks.  Codebooks fit directions, but scores
use vectors as they are: a product of matrices only finds those near the best, which are then summed one by one, so that equal vectors have equal scores.

Vectors that are null, zero, of another length than most of the sample's, or hold a null or a component that isn't finite take no part, as
query or candidate.  Ties go to the smaller id.  With fewer candidates than asked for, all are returned.  Repeated ids are separate vectors, but none is its own id's neighbour.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Vectors that codebooks are fitted on at most.
SAMPLE = 20_000
#: Bytes of the vectors of a block and of the queries of a part, about.
BLOCK_BYTES, PART_BYTES = 32 << 20, 16 << 20
#: Blocks that a table is dealt into at least.
LEAST_BLOCKS = 12
#: Queries whose scores are held at once.
ROUND = 64


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, vector as doubles) of the vectors that take part."""
    v = F.col("vector")
    out = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return out.where(F.col("id").isNotNull() & v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0))


def codebook(rows: np.ndarray, centroids: int, rounds: int = 8, seed: int = 3) -> np.ndarray:
    """Centroids by Lloyd's rounds from a random start; at most as many as rows."""
    rng = np.random.default_rng(seed)
    k = min(centroids, len(rows))
    books = rows[rng.choice(len(rows), k, replace=False)].copy()
    for _ in range(rounds):
        nearest = (rows @ books.T - (books**2).sum(1) / 2).argmax(1)
        sums = np.zeros_like(books)
        np.add.at(sums, nearest, rows)
        counts = np.bincount(nearest, minlength=k)
        books[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return books


class MultiIndex:
    """Two codebooks and the number of vectors in each cell."""

    def __init__(self, first: np.ndarray, second: np.ndarray):
        self.first, self.second, self.half = first, second, first.shape[1]
        self.counts = np.zeros((len(first), len(second)), dtype=np.int64)

    def cells(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b = vectors[:, : self.half], vectors[:, self.half :]
        return (a @ self.first.T - (self.first**2).sum(1) / 2).argmax(1), (b @ self.second.T - (self.second**2).sum(1) / 2).argmax(1)

    def visit(self, query: np.ndarray, wanted: int) -> dict[int, list[int]]:
        """Second centroids to visit by first centroid: pairs by falling sum until they hold ``wanted`` vectors."""
        sa, sb = self.first @ query[: self.half], self.second @ query[self.half :]
        a, b = np.argsort(-sa, kind="stable"), np.argsort(-sb, kind="stable")
        sa, sb = sa[a].tolist(), sb[b].tolist()
        counts = self.counts[np.ix_(a, b)].tolist()
        heap, reached, out, found = [(-sa[0] - sb[0], 0, 0)], [0] * len(sb), {}, 0
        # row j of the walk is the j-th second centroid; reached[j] first centroids of it are done
        while heap and found < wanted:
            _, i, j = heapq.heappop(heap)
            reached[j] = i + 1
            if counts[i][j]:
                out.setdefault(int(a[i]), []).append(int(b[j]))
                found += counts[i][j]
            if i + 1 < len(sa) and (j == 0 or reached[j - 1] > i + 1):
                heapq.heappush(heap, (-sa[i + 1] - sb[j], i + 1, j))
            if j + 1 < len(sb) and reached[j + 1] == i:
                heapq.heappush(heap, (-sa[i] - sb[j + 1], i, j + 1))
        return out


def fit(vectors: DataFrame, centroids: int) -> MultiIndex | None:
    """Codebooks from a bounded sample; None if there are no vectors."""
    rows = [r[0] for r in vectors.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("vector").collect()]  # SAMPLE rows at most
    if not rows:
        return None
    width = Counter(map(len, rows)).most_common(1)[0][0]
    sample = np.array([r for r in rows if len(r) == width])
    half = (width + 1) // 2
    return MultiIndex(codebook(sample[:, :half], centroids), codebook(sample[:, half:], centroids) if width > half else np.zeros((1, 0)))


def dealt_cells(counts: np.ndarray, block_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(first block, number of blocks) of each cell, for counts of vectors by cell: blocks hold about ``block_rows``, and twice as many at most."""
    counts = counts.ravel()
    first = (np.cumsum(counts) - counts) // block_rows
    return first, np.maximum(1, -(-counts // block_rows))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of vectors of one length."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = flat.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(flat), -1) if len(flat) else np.zeros((0, 0))


def _lists(rows: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(r) for r in rows]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(rows) if rows else [], type=kind))


def nearest(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = 20,
    every: int = 20,
    centroids: int = 32,
    share: float = 0.6,
    block_bytes: int = BLOCK_BYTES,
    part_bytes: int = PART_BYTES,
) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the ``k`` largest inner products found for every query.

    Queries are the vectors whose id is divisible by ``every``; candidates are all others.
    """
    spark = vectors.sparkSession
    all_ = usable(vectors, id_col, vector_col)
    index = fit(all_, centroids)
    if index is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    width = index.half + index.second.shape[1]
    seconds = len(index.second)
    all_ = all_.where(F.size("vector") == width)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                i, j = index.cells(_matrix(batch.column(0)))
                yield pa.RecordBatch.from_arrays([pa.array(i * seconds + j, pa.int32())], names=["cell"])

    for r in all_.select("vector").mapInArrow(cells, "cell int").groupBy("cell").count().collect():  # centroids squared rows at most
        index.counts.ravel()[r[0]] = r[1]
    total = int(index.counts.sum())
    wanted = max(int(share * total), min(total, 50 * k))
    block_rows = max(1, min(block_bytes // (8 * width), -(-total // LEAST_BLOCKS)))
    first, spread = dealt_cells(index.counts, block_rows)
    asking = all_.where(F.col("id") % every == 0)
    parts = max(1, -(-asking.count() * 8 * width // part_bytes))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                i, j = index.cells(_matrix(batch.column(1)))
                cell = i * seconds + j
                dealt = (batch.column(0).to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
                block = first[cell] + (dealt % spread[cell].astype(np.uint64)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cell, pa.int32()), pa.array(block, pa.int32())], names=["id", "vector", "cell", "block"])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whose, blocks, lists = [], [], []
            for n, vector in enumerate(_matrix(batch.column(1))):
                found = np.array([i * seconds + j for i, js in index.visit(vector, wanted).items() for j in js])
                of = np.repeat(found, spread[found])
                at = np.arange(len(of)) - np.repeat(np.cumsum(spread[found]) - spread[found], spread[found]) + first[of]
                order = np.argsort(at, kind="stable")
                at, of = at[order], of[order]
                cuts = np.nonzero(np.append(True, at[1:] != at[:-1]))[0]
                lists += np.split(of, cuts[1:])
                blocks.append(at[cuts])
                whose.append(np.full(len(cuts), n))
            if whose:
                rows = pa.array(np.concatenate(whose))
                columns = [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(np.concatenate(blocks), pa.int32()), _lists(lists, pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "vector", "block", "cells"])

    queries = asking.mapInArrow(deal, "id long, vector array<double>, block int, cells array<int>")
    queries = queries.withColumn("part", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(parts)).cast("int"))
    entries = all_.mapInArrow(place, "id long, vector array<double>, cell int, block int")
    entries = entries.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

    def best(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]]
        if left.num_rows and right.num_rows:
            right = right.sort_by("id")
            data, ids, cell = _matrix(right.column("vector")), right.column("id").to_numpy(), right.column("cell").to_numpy()
            asked, names, lists = _matrix(left.column("vector")), left.column("id").to_numpy(), left.column("cells").combine_chunks()
            largest, visited = np.abs(data).max(), np.zeros(len(first), dtype=bool)
            for at in range(0, len(asked), ROUND):
                scores = asked[at : at + ROUND] @ data.T
                for n, mine in enumerate(scores, at):
                    wants = lists[n].values.to_numpy()
                    visited[wants] = True
                    allowed = np.nonzero(visited[cell] & (ids != names[n]))[0]
                    visited[wants] = False
                    mine = mine[allowed]
                    if len(mine) > k:
                        edge = np.partition(mine, len(mine) - k)[len(mine) - k]
                        near = 1e-12 * np.abs(asked[n]).sum() * largest  # beyond what the order of a sum can change
                        allowed = allowed[mine >= edge - near]
                    exact = (data[allowed] * asked[n]).sum(1)
                    order = np.argsort(-exact, kind="stable")[:k]  # ids rise, so ties go to the smaller
                    for column, x in zip(out, (np.full(len(order), names[n]), ids[allowed[order]], exact[order]), strict=True):
                        column.append(x)
        return pa.table([np.concatenate(c) for c in out], names=["query_id", "vec_id", "score"])

    found = queries.groupBy("block", "part").cogroup(entries.groupBy("block", "part")).applyInArrow(best, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
