"""Substring dedup: relative Lempel-Ziv parsing of all documents against blocks of all documents.

The aim: every word that lies in a window of ``window`` consecutive words whose word sequence starts anywhere else too.

Reference blocks.  A window owns its smallest k-word gram (by hash; the leftmost of equals).  Equal windows own equal grams, at the same
place, so all copies of a window meet under that gram.  The windows that own one occurrence of a gram are neighbours and span a block of ``window`` to
2 x window - k words.  Every block of every document is indexed by (gram, hash of the whole block); about one for each 14 words.

Matches.  A block that stands elsewhere as a whole matches there: its reference is the first place of the block in the index (another, for that
place itself; very many places are met in groups, each with a first of its own).  A block that is unique as a whole, but whose gram occurs in other blocks, may still share a part with them: that is where a factor begins or
ends.  Only these blocks, and one copy of each block they may share with, are expanded to window hashes (128 bits), which are matched in the same way.
Grams that occur once end the factor and cost nothing more.

Factors.  Each document is parsed greedily from the left: a factor starts at the first window that matches anywhere, and goes on for as long as the next
windows match the same document at the next places.  A factor is (place, length, reference document,
place there); it has ``window`` words at least, is as long as its reference allows, and its words are the duplicate span.

Keys with a large part of all rows (a passage in a third of all documents) are joined by a broadcast of at most 10,000 keys, met in groups of
bounded size and aggregated with partial sums, so they fill no task.  Blocks and matches are tables in the shared folder, deleted once the factors are stored.
Two copies of a text count as copies of all its windows; rows of a batch that repeat with their ids are parsed once and counted as often as they stand.

Null and empty texts have no words; texts with fewer words than the window lose none.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from protomill.llm.common import discard, document_keys, hot_split_join, memory, new_fields, slices, stored, with_fields

#: Words of a gram.
GRAM = 8
#: Occurrences of one block that meet in one group, about.
GROUP_ROWS = 20_000
#: Words of a document (as a power of two) whose blocks meet others in one group.
STRETCH_BITS = 16
#: Words whose hashes one Python worker remembers; then it starts anew.
MEMORY_WORDS = 400_000
_B1, _B2 = 0x9E3779B97F4A7C15 | 1, 0xD1342543DE82EF95 | 1
_MASK = (1 << 64) - 1


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, as long as needed."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            for name, b in (("up", self.base), ("down", self.inverse)):
                factors = np.full(size, b & _MASK, dtype=np.uint64)
                factors[0] = 1
                setattr(self, name, np.multiply.accumulate(factors))
        return self.up[:n], self.down[:n]


_POWERS = (Powers(_B1), Powers(_B2))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def spans_hash(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray, which: int = 0) -> np.ndarray:
    """Hashes of spans of word hashes, from prefix sums of a polynomial."""
    up, down = _POWERS[which].get(len(values) + 1)
    v = values if not which else _mix(values)
    prefix = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(v * up[: len(v)], out=prefix[1:])
    return _mix((prefix[starts + lengths] - prefix[starts]) * down[starts] + lengths.astype(np.uint64))


def word_hashes(words: list[bytes]) -> np.ndarray:
    from xxhash import xxh64_intdigest

    known = memory("words")
    if len(known) > MEMORY_WORDS:
        known.clear()
    out = []
    for w in words:
        h = known.get(w)
        if h is None:
            h = known[w] = xxh64_intdigest(w, 5)
        out.append(h)
    return np.array(out, dtype=np.uint64)


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """Index of the smallest value (leftmost of equals) of each run of ``width`` values, by doubling."""
    n = len(values) - width + 1
    best = np.arange(len(values))
    span = 1
    while span < width:
        shift = min(span, width - span)
        a, b = best[: len(best) - shift], best[shift:]
        best = np.where(values[b] < values[a], b, a)
        span += shift
    return best[:n]


def blocks_of(values: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(gram hash, block hash, first window, number of windows) of each block of a document of word hashes."""
    n = len(values)
    none = np.zeros(0, dtype=np.int64)
    if n < window:
        return none.view(np.uint64), none.view(np.uint64), none, none
    at = np.arange(n - gram + 1)
    grams = spans_hash(values, at, np.full(len(at), gram))
    owner = sliding_argmin(grams, window - gram + 1)
    new = np.ones(len(owner), dtype=bool)
    new[1:] = owner[1:] != owner[:-1]
    first = np.nonzero(new)[0]
    count = np.diff(np.append(first, len(owner)))
    place = owner[first]
    block = spans_hash(values, first, count + window - 1, 1)
    # where the gram stands in the block, so that equal blocks also own the same windows
    block = _mix(block ^ (place - first).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))
    return grams[place], block, first, count


def _signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def _blocks(window: int, gram: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 2):
            ids, keys = part.column(0).to_numpy(), part.column(1).to_numpy(zero_copy_only=False)
            columns: list[list[np.ndarray]] = [[] for _ in range(7)]
            times = Counter(zip(ids.tolist(), keys.tolist(), strict=True))
            for i, text in enumerate(part.column(2).to_pylist()):
                m = times.pop((ids[i], keys[i]), 0)  # none if a row with the same id and text came before
                words = text.encode().split() if m and text else []
                if len(words) < window:
                    continue
                g, b, first, count = blocks_of(word_hashes(words), window, gram)
                row = (_signed(g), _signed(b), *(np.full(len(g), x) for x in (ids[i], keys[i])), first.astype(np.int32), count.astype(np.int32), np.full(len(g), m, dtype=np.int32))
                for column, x in zip(columns, row, strict=True):
                    column.append(x)
            if columns[0]:
                names = ["g", "b", "d", "k", "at", "n", "m"]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in columns], names=names)

    return run


def _windows(window: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 2):
            ids, keys = part.column(0).to_numpy(), part.column(1).to_numpy(zero_copy_only=False)
            edges = part.column(3).to_pylist()
            columns: list[list[np.ndarray]] = [[] for _ in range(6)]
            for i, text in enumerate(part.column(2).to_pylist()):
                values = word_hashes(text.encode().split())
                ranges = sorted((e["at"], e["n"], e["whole"]) for e in edges[i])
                count = np.array([r[1] for r in ranges])
                at = np.repeat(np.array([r[0] for r in ranges]) - (np.cumsum(count) - count), count) + np.arange(count.sum())
                whole = np.repeat(np.array([r[2] for r in ranges]), count)
                size = np.full(len(at), window)
                h1, h2 = spans_hash(values, at, size), spans_hash(values, at, size, 1)
                for column, x in zip(columns, (_signed(h1), _signed(h2), np.full(len(at), ids[i]), np.full(len(at), keys[i]), at.astype(np.int32), whole), strict=True):
                    column.append(x)
            names = ["h1", "h2", "d", "k", "at", "whole"]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in columns], names=names)

    return run


def _other(place: Column, *places: str) -> Column:
    """The first of the places that isn't the row's own, else its own."""
    return F.coalesce(*[F.when(F.col(p) != place, F.col(p)) for p in places], place)


def _columns(ref: Column) -> list[Column]:
    return [ref[c].alias(f"ref_{c}") for c in ("d", "k", "at")]


def equal_blocks(met: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(groups, firsts): stored tables of which block stands where else.

    ``met`` has g, b, d, k, at, n, m, c (occurrences of the gram) and mixed.  Occurrences of one block are met in groups of about ``GROUP_ROWS``, however
    many there are; ``groups`` has each with the first and last place of its group, and ``firsts`` the first of each group (rep) with those of all groups, their
    rows (all) and its number among them.
    """
    place = F.struct("d", "k", "at")
    # a document that repeats a passage very often is dealt out too, in stretches that leave its factors whole
    part = F.pmod(F.xxhash64("d", "k", F.shiftright("at", STRETCH_BITS)), F.ceil(F.col("c") / GROUP_ROWS)).alias("part")
    group = Window.partitionBy("g", "b", "part")
    within = met.select("g", "b", part, "d", "k", "at", "n", "m", "mixed").withColumns({"one": F.min(place).over(group), "other": F.max(place).over(group), "rows": F.sum("m").over(group)})
    groups = stored(within.withColumn("rep", F.col("one") == place).drop("part", "m"), "groups")
    block = Window.partitionBy("g", "b")
    firsts = groups.where("rep").select("g", "b", "d", "k", "at", "n", "mixed", "rows", F.col("other").alias("mine"))
    firsts = firsts.withColumns(
        {"one": F.min(place).over(block), "other": F.max(place).over(block), "all": F.sum("rows").over(block), "number": F.row_number().over(block.orderBy("d", "k", "at"))}
    )
    return groups, stored(firsts.drop("g", "b", "rows"), "firsts")


def matches(keyed: DataFrame, window: int, gram: int) -> tuple[DataFrame, list[DataFrame]]:
    """Rows (d, k, at, n, ref_d, ref_k, ref_at) and the tables that they are read from.

    The n windows from word ``at`` on, of the document with key (d, k), stand at the reference too.  Rows of a document share no
    window, but for rows that repeat.  ``keyed`` has __d, __k and __text.
    """
    blocks = stored(keyed.mapInArrow(_blocks(window, gram), "g long, b long, d long, k long, at int, n int, m int"), "blocks")
    # grams of two occurrences at least; mixed: in different blocks
    grams = blocks.groupBy("g").agg(F.count("*").alias("c"), F.sum("m").alias("all"), F.min("b").alias("lo"), F.max("b").alias("hi")).where("all > 1")
    grams = stored(grams.select("g", "c", (F.col("lo") != F.col("hi")).alias("mixed")), "grams")
    groups, firsts = equal_blocks(hot_split_join(blocks, grams, ["g"], "c", blocks.count()))
    place = F.struct("d", "k", "at")
    whole = groups.where("not rep").select("d", "k", "at", "n", *_columns(F.col("one")))
    whole = whole.unionByName(firsts.where("all > 1").select("d", "k", "at", "n", *_columns(_other(place, "mine", "one", "other"))))
    # factor boundaries: unique blocks under a shared gram, and one copy of each block they may share windows with
    edge = F.struct("at", "n", (F.col("all") > 1).alias("whole")).alias("e")
    edges = firsts.where("mixed and number = 1").select("d", "k", edge).groupBy("d", "k").agg(F.collect_list("e").alias("edges"))
    texts = keyed.select(F.col("__d").alias("d"), F.col("__k").alias("k"), "__text")
    joined = texts.join(edges, ["d", "k"]).select("d", "k", "__text", "edges")
    windows = stored(joined.mapInArrow(_windows(window), "h1 long, h2 long, d long, k long, at int, whole boolean"), "windows")
    shared = stored(windows.groupBy("h1", "h2").agg(F.count("*").alias("c")).where("c > 1"), "shared")
    again = stored(hot_split_join(windows, shared, ["h1", "h2"], "c", windows.count()), "again")
    # the rows of a hash lie in few files, so that partial aggregates leave little to shuffle
    places = stored(again.groupBy("h1", "h2").agg(F.count("*").alias("c"), F.min(place).alias("one"), F.max(place).alias("other")), "places")
    single = hot_split_join(again.where("not whole").drop("c"), places, ["h1", "h2"], "c", again.count())
    out = whole.unionByName(single.select("d", "k", "at", F.lit(1).alias("n"), *_columns(_other(place, "one", "other"))))
    return out, [blocks, grams, groups, firsts, windows, shared, again, places]


def greedy_factors(found: np.ndarray, window: int) -> np.ndarray:
    """Rows (d, k, at, length, ref_d, ref_k, ref_at) of the factors, from matches (d, k, at, n, ref_d, ref_k, ref_at) sorted by d, k and at."""
    d, k, at, n, ref_d, ref_k, ref_at = found.T
    same = (d[1:] == d[:-1]) & (k[1:] == k[:-1])
    # a row that repeats with its id brings its matches again
    once = np.append(True, ~(same & (at[1:] == at[:-1])))
    if not once.all():
        return greedy_factors(found[once], window)
    on = same & (at[1:] == at[:-1] + n[:-1]) & (ref_d[1:] == ref_d[:-1]) & (ref_k[1:] == ref_k[:-1]) & (ref_at[1:] - at[1:] == ref_at[:-1] - at[:-1])
    first = np.nonzero(np.append(True, ~on))[0]
    last = np.append(first[1:], len(at)) - 1
    out = found[first]
    out[:, 3] = at[last] + n[last] - at[first] + window - 1
    return out


_FACTORS = ["d", "k", "at", "length", "ref_d", "ref_k", "ref_at"]
_KINDS = ["long", "long", "int", "int", "long", "long", "int"]


def _parse(window: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From matches, sorted by document and place, to one row of arrays for each document; a document may go on in the next batch."""

    def rows(found: np.ndarray) -> pa.RecordBatch:
        parsed = greedy_factors(found, window)
        new = np.append(True, (parsed[1:, 0] != parsed[:-1, 0]) | (parsed[1:, 1] != parsed[:-1, 1]))
        first = np.nonzero(new)[0]
        cuts = pa.array(np.append(first, len(parsed)), type=pa.int32())
        columns = [pa.array(parsed[first, i]) for i in (0, 1)]
        for i in range(2, 7):
            kind = pa.int64() if _KINDS[i] == "long" else pa.int32()
            columns.append(pa.ListArray.from_arrays(cuts, pa.array(parsed[:, i]).cast(kind)))
        return pa.RecordBatch.from_arrays(columns, names=_FACTORS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for part in batches:
            if not part.num_rows:
                continue
            found = np.column_stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in part.columns])
            ends = np.nonzero((found[1:, 0] != found[:-1, 0]) | (found[1:, 1] != found[:-1, 1]))[0]
            if held and (held[-1][-1, :2] != found[0, :2]).any():
                yield rows(np.concatenate(held))
                held = []
            if len(ends):
                cut = int(ends[-1]) + 1
                yield rows(np.concatenate([*held, found[:cut]]))
                held, found = [], found[cut:]
            held.append(found)
        if held:
            yield rows(np.concatenate(held))

    return run


def factors(keyed: DataFrame, window: int = 35, gram: int = GRAM) -> DataFrame:
    """The factors of every document that has any: its key (d, k) and arrays at, length, ref_d, ref_k, ref_at, one entry for each factor.

    ``keyed`` has __d, __k and __text.  A stored table.
    """
    found, tables = matches(keyed, window, gram)
    by_doc = found.repartition("d", "k").sortWithinPartitions("d", "k", "at")
    schema = ", ".join(f"{c} {kind}" if i < 2 else f"{c} array<{kind}>" for i, (c, kind) in enumerate(zip(_FACTORS, _KINDS, strict=True)))
    out = stored(by_doc.mapInArrow(_parse(window), schema), "factors")
    discard(*tables)
    return out


def _remove(names: list[str], fields: list[tuple[str, pa.DataType]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    kept = len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, kept):
            rows: list[tuple] = []
            spans = zip(part.column(kept + 1).to_pylist(), part.column(kept + 2).to_pylist(), strict=True)
            for text, (begins, lengths) in zip(part.column(kept).to_pylist(), spans, strict=True):
                words = text.encode().split() if text else []
                if not begins:
                    left = words
                else:
                    at, n = np.array(begins), np.array(lengths)
                    edge = np.bincount(at, minlength=len(words) + 1) - np.bincount(at + n, minlength=len(words) + 1)
                    gone = np.cumsum(edge[: len(words)]) > 0
                    left = [words[i] for i in np.nonzero(~gone)[0].tolist()]
                joined = b" ".join(left)
                rows.append((len(words), len(words) - len(left), hashlib.sha256(joined).hexdigest(), joined.decode() if begins else text or ""))
            columns = [part.column(i) for i in range(kept)]
            columns += [pa.array([r[i] for r in rows], type=kind) for i, (_, kind) in enumerate(fields)]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, *[name for name, _ in fields]])

    return run


def remove_duplicates(
    df: DataFrame, keep: list[str], text_col: str = "text", id_col: str = "doc_id", window: int = 35, gram: int = GRAM, texts: bool = False
) -> DataFrame:
    """``keep`` and n_words, n_removed and kept_sha256 of every row; with ``texts`` also kept_text.

    A kept column with the name of a new one is replaced.

    ``kept_text`` is the unchanged text where no word goes, else the kept words joined by single spaces.
    """
    schema = "n_words long, n_removed long, kept_sha256 string" + (", kept_text string" if texts else "")
    new = [name for name, _ in new_fields(schema)]
    keep = [c for c in keep if c not in new]
    plain = df.select(*[F.col(c).alias(f"__c{i}") for i, c in enumerate(keep)], F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    keyed = document_keys(plain, "__text", "__id")
    found = factors(keyed.select("__d", "__k", "__text"), window, gram).select("d", "k", "at", "length")
    on = (F.col("__d") == F.col("d")) & (F.col("__k") == F.col("k"))
    held = [f"__c{i}" for i in range(len(keep))]
    whole = keyed.join(found, on, "left").select(*held, "__text", "at", "length")
    out = whole.mapInArrow(_remove(held, new_fields(schema)), with_fields(whole, len(keep), schema))
    return out.toDF(*keep, *new)
