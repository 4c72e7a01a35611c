"""Cross-tokenizer alignment by a dictionary of groups.

Two tokenizers cut the same bytes.  Where tokens of both end at the same byte, a group ends; inside a group every token of the one is linked
with every token of the other.  Asked for is, over all documents, how many hold a pair of ids linked, and for each document what its links count.

Texts repeat the same groups endlessly, so groups are interned and links are expanded once for each distinct group:

* Documents.  A worker cuts a text at places where both tokenizers are known to cut (before a single space between two other
  characters, and around a single line feed), encodes each distinct piece once, aligns it to groups and remembers it.  The documents of one slice of an Arrow batch are one batch, with a
  dictionary of their distinct groups and the number of its documents that hold each; a document is the numbers of its groups and how often each stands in it.
* Pairs.  The dictionaries are added up to one row for each distinct group.  Its distinct pairs are expanded there and take its number of documents.  A document whose
  groups hold a pair m times over would count m times, so the worker notes m - 1 for the pair; the notes, added up by batch, are subtracted.  The sums are exact.
* Values.  What a group's links count follows from its pairs' counts, and is joined back to the batches' dictionaries by the group's key, then to the documents by batch.

No row of all occurrences, and none for each document and group, is shuffled.  Frequent pairs meet a broadcast of bounded size.  A batch holds
``SLICE_BYTES`` of text, or one document.

The pieces' ids are those that the libraries give for whole texts: one whole text of each slice is held against both, and the job fails if they differ.  Null and empty texts, and
texts that either tokenizer doesn't give back byte by byte (those with U+2581, which one takes for a space), have no tokens.  Special tokens' names inside texts are plain
text.  Rows that repeat are documents of their own.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from protomill.llm.common import discard, hot_split_join, memory, slices, stored, with_fields
from protomill.llm.sentencepiece_codec import MARK, MergeVocabulary
from protomill.llm.token_counts import _rule_of

#: Text of one batch of documents.
SLICE_BYTES = 8 << 20
#: Pieces that one Python worker remembers (about 250 bytes each); then it starts anew.
MEMORY_PIECES = 500_000
#: Pieces that are encoded at once.
ENCODED = 4096
#: Where both tokenizers cut: before a single space or line feed between two other characters, and behind such a line feed.
_CUT = re.compile(rf"(?<=[^\s{MARK}])(?=[ \n][^\s{MARK}])|(?<=[^\s{MARK}]\n)(?=[^\s{MARK}])")
#: Documents, groups of a batch, and pairs that a document holds in several groups.
DOCUMENT, GROUP, REPEAT = 0, 1, 2


def byte_letters() -> dict[str, int]:
    """Bytes by the letters that stand for them in byte-level vocabularies: printable ones by themselves, the others by letters from 256 on."""
    own = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Pieces(dict):
    """Numbers of pieces; a new piece gets the next number and is queued."""

    def __init__(self, lead: str, own: Aligner):
        super().__init__()
        self.lead, self.own = lead, own

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self.own.links) + len(self.own.queue)
        self.own.queue.append(self.lead + word)
        return number


class Aligner:
    """Both tokenizers, and what is known of pieces of text and of groups."""

    def __init__(self, json_path: str, model_path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs a worker on each core
        from tokenizers import Tokenizer

        self.first = Tokenizer.from_file(json_path)
        self.first.encode_special_tokens = True
        self.first.no_truncation()
        self.first.no_padding()
        letters = byte_letters()
        size = self.first.get_vocab_size(with_added_tokens=False)
        self.bytes_a = [bytes(map(letters.__getitem__, self.first.id_to_token(i))) for i in range(size)]
        self.second = MergeVocabulary(model_path)
        sp = self.second
        self.bytes_b = [bytes([sp.byte_of[i]]) if i in sp.byte_of else p.replace(MARK, " ").encode() for i, p in enumerate(sp.piece_of)]
        self.lengths_a = [len(x) for x in self.bytes_a]
        self.widths_a, self.widths_b = np.array(self.lengths_a), np.array([len(x) for x in self.bytes_b])
        with open(json_path, encoding="utf-8") as f:
            self.cuts = _rule_of(json.load(f)) == "spaces" and sp.cut_at_space and sp.cut_at_line
        self.start_anew()

    def start_anew(self) -> None:
        self.queue: list[str] = []  # pieces that are numbered but not encoded
        self.spaced, self.bare = Pieces(" ", self), Pieces("", self)
        # of each piece: ids of either tokenizer, links, and where its groups begin in the list of all; one without groups isn't given back
        self.ids_a, self.ids_b, self.links, self.begin, self.groups = array("i"), array("i"), array("q"), array("q", [0]), array("i")
        # of each group: its name, and its distinct pairs, each as a number (first id x 65,536 + second id)
        self.group_number: dict[str | int, int] = {}
        self.names: list[str] = []
        self.pairs_begin, self.pairs = array("q", [0]), array("q")

    def encode_a(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.first.encode_batch(texts, add_special_tokens=False)]

    def numbers(self, text: str) -> np.ndarray:
        """The numbers of a text's pieces; the space that goes before it is part of the first."""
        words = text.split()
        gaps = len(words) - 1
        # single spaces and line feeds between words, and no other white space
        if self.cuts and gaps == text.count(" ") + text.count("\n") == len(text) - sum(map(len, words)):
            out: list[int] = []
            for i, line in enumerate(text.split("\n")):
                words = line.split(" ")
                if i:
                    out += [self.bare["\n"], self.bare[words[0]]]
                    words = words[1:]
                out += map(self.spaced.__getitem__, words)
        else:
            parts = _CUT.split(" " + text) if self.cuts else [" " + text]
            out = [self.spaced[p[1:]] if p[0] == " " else self.bare[p] for p in parts]
        return np.array(out, dtype=np.int64)

    def learn(self) -> None:
        """Encodes and aligns the queued pieces."""
        for at in range(0, len(self.queue), ENCODED):
            self._learn(self.queue[at : at + ENCODED])
        self.queue.clear()

    def _learn(self, new: list[str]) -> None:
        ids = self.encode_a(new), self.second.merge_all([t.replace(" ", MARK) for t in new])
        given = np.array([all(b"".join(map(known.__getitem__, x)) == raw for known, x in zip((self.bytes_a, self.bytes_b), each, strict=True)) for raw, *each in zip((t.encode() for t in new), *ids, strict=True)])
        # of the pieces that both give back, the bytes in a row: a group ends wherever tokens of both end
        kept = [[x for x, ok in zip(side, given.tolist(), strict=True) if ok] for side in ids]
        flat = [np.array(list(chain.from_iterable(side)), dtype=np.int64) for side in kept]
        ends = [np.cumsum(widths[f]) for widths, f in zip((self.widths_a, self.widths_b), flat, strict=True)]
        common = np.intersect1d(*ends, assume_unique=True)
        last = [np.searchsorted(e, common) for e in ends]
        sizes = [np.diff(x, prepend=-1) for x in last]
        number = np.empty(len(common), dtype=np.int64)
        alone = (sizes[0] == 1) & (sizes[1] == 1)
        codes, inverse = np.unique(flat[0][last[0][alone]] << 16 | flat[1][last[1][alone]], return_inverse=True)
        number[alone] = np.array([self._intern(c, [c >> 16], [c & 0xFFFF]) for c in codes.tolist()], dtype=np.int64)[inverse]
        for k in np.nonzero(~alone)[0].tolist():
            a, b = (f[x[k] - n[k] + 1 : x[k] + 1].tolist() for f, x, n in zip(flat, last, sizes, strict=True))
            number[k] = self._intern(None, a, b)
        # back to pieces: a piece ends where its bytes do
        bytes_of = np.cumsum([sum(map(self.lengths_a.__getitem__, x)) for x in kept[0]])
        groups = np.zeros(len(new), dtype=np.int64)
        groups[given] = np.diff(np.searchsorted(common, bytes_of, side="right"), prepend=0)
        links = np.concatenate(([0], np.cumsum(sizes[0] * sizes[1])))
        upto = np.cumsum(groups)
        self.groups.extend(number.tolist())
        self.ids_a.extend(map(len, ids[0]))
        self.ids_b.extend(map(len, ids[1]))
        self.links.extend(np.diff(links[upto], prepend=0).tolist())
        self.begin.extend((upto + self.begin[-1]).tolist())

    def _intern(self, code: int | None, a: list[int], b: list[int]) -> int:
        """The number of a group, by its code if it is one pair, else by its name."""
        name = "" if code in self.group_number else ",".join(map(str, a)) + "|" + ",".join(map(str, b))
        key = name if code is None else code
        number = self.group_number.setdefault(key, len(self.names))
        if number == len(self.names):
            self.names.append(name)
            self.pairs.extend(sorted(x << 16 | y for x in set(a) for y in set(b)))
            self.pairs_begin.append(len(self.pairs))
        return number

    def held_against_libraries(self, text: str, groups: list[int]) -> None:
        want = [",".join(map(str, x)) for x in (self.encode_a([" " + text])[0], self.second.library.encode(text))]
        sides = [self.names[g].split("|") for g in groups]
        if [",".join(s[i] for s in sides) for i in (0, 1)] != want:
            raise RuntimeError("ids of pieces differ from those of a whole text")


def aligner(json_path: str, model_path: str) -> Aligner:
    """One aligner for each pair of files in a Python worker, which serves many tasks."""
    known, key = memory("alignment"), (json_path, model_path)
    if key not in known:
        known[key] = Aligner(*key)
    return known[key]


def _ranges(begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The numbers from each ``begin`` on, ``length`` of them, in a row."""
    return np.repeat(begin - (np.cumsum(length) - length), length) + np.arange(length.sum())


class Batch:
    """The documents of a slice, with the dictionary of their groups."""

    def __init__(self, own: Aligner, texts: list[str]):
        if len(own.links) > MEMORY_PIECES:
            own.start_anew()
        pieces = [own.numbers(t) if t and MARK not in t else np.zeros(0, np.int64) for t in texts]
        own.learn()
        begin, groups = np.array(own.begin), np.array(own.groups)
        length = np.diff(begin)
        pieces = [p if length[p].all() else p[:0] for p in pieces]  # texts that aren't given back have no tokens
        sizes = np.array([len(p) for p in pieces])
        flat = np.concatenate(pieces) if pieces else np.zeros(0, np.int64)
        of = np.repeat(np.arange(len(pieces)), sizes)
        n = length[flat]
        found = groups[_ranges(begin[flat], n)]
        total = lambda x: np.bincount(of, weights=x, minlength=len(pieces)).astype(np.int64)
        self.totals = [total(np.array(x)[flat]) for x in (own.ids_a, own.ids_b)] + [total(n), total(np.array(own.links)[flat])]
        self.digests = [""] * len(pieces)
        ends = np.cumsum(self.totals[2]).tolist()
        checked = max((i for i, p in enumerate(pieces) if len(p)), key=lambda i: (zlib.crc32(texts[i].encode()), i), default=-1)
        for i, (low, high) in enumerate(zip([0, *ends], ends, strict=False)):
            if low < high:
                listed = found[low:high].tolist()
                self.digests[i] = hashlib.sha256(";".join(map(own.names.__getitem__, listed)).encode()).hexdigest()
                if i == checked:
                    own.held_against_libraries(texts[i], listed)
        # distinct groups of each document, numbered in the batch
        count = len(own.names)
        key, self.times = np.unique(np.repeat(of, n) * max(count, 1) + found, return_counts=True)
        of, each = key // max(count, 1), key % max(count, 1)
        used, numbers = np.unique(each, return_inverse=True)
        cuts = np.searchsorted(of, np.arange(len(pieces) + 1))
        self.offsets, self.numbers = cuts.astype(np.int32), numbers.astype(np.int32)
        self.documents = np.bincount(numbers, minlength=len(used))
        self.names = [own.names[g] for g in used.tolist()]
        self._repeats(own, of, each)

    def _repeats(self, own: Aligner, of: np.ndarray, each: np.ndarray) -> None:
        """Pairs that a document holds in several groups: how many more than one, over all documents."""
        first, pairs = np.array(own.pairs_begin), np.array(own.pairs)
        width = np.diff(first)
        among_several = np.unique(pairs[_ranges(first[:-1][width > 1], width[width > 1])])
        telling = width > 1
        telling[width == 1] = np.isin(pairs[first[:-1][width == 1]], among_several)  # a group of one pair repeats none but those of larger groups
        of, each = of[telling[each]], each[telling[each]]
        held = pairs[_ranges(first[each], width[each])]
        codes, held = np.unique(held, return_inverse=True)
        key, times = np.unique(np.repeat(of, width[each]) * max(len(codes), 1) + held, return_counts=True)
        more = np.bincount(key % max(len(codes), 1), weights=times - 1, minlength=len(codes)).astype(np.int64)
        self.repeats = dict(zip(codes[more > 0].tolist(), more[more > 0].tolist(), strict=True))


_FIELDS = [
    ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()),
    ("numbers", pa.list_(pa.int32())), ("times", pa.list_(pa.int64())),
    ("kind", pa.int32()), ("batch", pa.int64()), ("number", pa.int32()), ("key", pa.string()), ("documents", pa.int64()), ("a", pa.int32()), ("b", pa.int32()),
]
_DDL = (
    "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, numbers array<int>, times array<long>, "
    "kind int, batch long, number int, key string, documents long, a int, b int"
)


def _rows(length: int, kept: list[tuple[str, pa.DataType]], **columns: object) -> pa.RecordBatch:
    fields = [*kept, *_FIELDS]
    return pa.RecordBatch.from_arrays([columns[n] if n in columns else pa.nulls(length, t) for n, t in fields], names=[n for n, _ in fields])


def aligned_batches(docs: DataFrame, keep: list[str], json_path: str, model_path: str, text_col: str) -> DataFrame:
    """Rows of three kinds: documents (``keep``, their counts and groups), groups of batches, and repeated pairs of batches."""
    chosen = docs.select(*keep, F.col(text_col).alias("__text"))
    schema = with_fields(chosen, len(keep), _DDL)
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in schema.fields])  # rows of other kinds have nulls everywhere

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, serial = aligner(json_path, model_path), TaskContext.get().partitionId() << 32
        for part in slices(batches, len(keep), SLICE_BYTES):
            serial += 1
            kept = [(part.schema.names[i], part.schema.types[i]) for i in range(len(keep))]
            found = Batch(own, [x or "" for x in part.column(len(keep)).to_pylist()])
            n = part.num_rows
            columns = {name: part.column(i) for i, (name, _) in enumerate(kept)}
            columns |= {f: pa.array(x, t) for (f, t), x in zip(_FIELDS[:5], [*found.totals, found.digests], strict=True)}
            offsets = pa.array(found.offsets)
            columns |= {"numbers": pa.ListArray.from_arrays(offsets, pa.array(found.numbers)), "times": pa.ListArray.from_arrays(offsets, pa.array(found.times))}
            yield _rows(n, kept, kind=pa.array([DOCUMENT] * n, pa.int32()), batch=pa.array([serial] * n, pa.int64()), **columns)
            if n := len(found.names):
                numbers = pa.array(np.arange(n), pa.int32())
                key, documents = pa.array(found.names), pa.array(found.documents)
                yield _rows(n, kept, kind=pa.array([GROUP] * n, pa.int32()), batch=pa.array([serial] * n, pa.int64()), number=numbers, key=key, documents=documents)
            if n := len(found.repeats):
                codes = np.array(list(found.repeats), dtype=np.int64)
                a, b = pa.array(codes >> 16, pa.int32()), pa.array(codes & 0xFFFF, pa.int32())
                yield _rows(n, kept, kind=pa.array([REPEAT] * n, pa.int32()), batch=pa.array([serial] * n, pa.int64()), documents=pa.array(list(found.repeats.values()), pa.int64()), a=a, b=b)

    return chosen.mapInArrow(run, schema)


def linked(groups: DataFrame) -> DataFrame:
    """(key, documents, a, b, times) of the distinct pairs of every distinct group; ``times`` is how often the group links them."""
    ids = lambda i: F.split(F.get(F.split("key", r"\|"), i), ",")
    one = groups.select("key", "documents", ids(0).alias("as"), ids(1).alias("bs"))
    one = one.select("key", "documents", "as", "bs", F.explode(F.array_distinct("as")).alias("a"))
    both = one.select("key", "documents", "as", "bs", "a", F.explode(F.array_distinct("bs")).alias("b"))
    often = lambda ids, x: F.size(F.filter(ids, lambda y: y == F.col(x))).cast("long")
    return both.select("key", "documents", F.col("a").cast("int").alias("a"), F.col("b").cast("int").alias("b"), (often("as", "a") * often("bs", "b")).alias("times"))


def pair_counts(groups: DataFrame, repeats: DataFrame) -> DataFrame:
    """(a, b, count, groups): documents that hold each pair linked, and the distinct groups that hold it."""
    held = linked(groups).select("a", "b", "documents", F.lit(1).alias("one"))
    less = repeats.select("a", "b", (-F.col("documents")).alias("documents"), F.lit(0).alias("one"))
    return held.unionByName(less).groupBy("a", "b").agg(F.sum("documents").alias("count"), F.sum("one").alias("groups"))


def align(docs: DataFrame, json_path: str, model_path: str, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep`` and n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every document.

    n_best counts the links whose pair is in as many documents as any of its first id; count_sum adds up all links' counts.  Kept columns may have any names;
    one with the name of a new column is replaced.
    """
    new = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    kept = [c for c in keep if c not in new]
    own = [f"k{i}" for i in range(len(kept))]
    plain = docs.select(*[F.col(f"`{c}`").alias(o) for c, o in zip(kept, own, strict=True)], F.col(f"`{text_col}`").alias("text"))
    found = stored(aligned_batches(plain, own, json_path, model_path, "text"), "aligned")
    dictionary = found.where(F.col("kind") == GROUP).select("batch", "number", "key", "documents")
    groups = stored(dictionary.groupBy("key").agg(F.sum("documents").alias("documents")), "groups")
    counts = stored(pair_counts(groups, found.where(F.col("kind") == REPEAT)), "pairs")
    most = counts.groupBy("a").agg(F.max("count").alias("most"))  # a row for each id of the first vocabulary at most
    judged = counts.join(F.broadcast(most), "a").select("a", "b", "count", (F.col("count") == F.col("most")).cast("long").alias("best"), "groups")
    rows = counts.agg(F.sum("groups")).first()[0] or 0
    valued = hot_split_join(linked(groups), judged, ["a", "b"], "groups", rows)
    worth = valued.groupBy("key").agg(F.sum(F.col("times") * F.col("count")).alias("total"), F.sum(F.col("times") * F.col("best")).alias("best"))
    values = stored(dictionary.join(worth, "key").select("batch", "number", "total", "best"), "group-values")
    discard(groups, counts)
    documents = found.where(F.col("kind") == DOCUMENT).select(*own, *new[:4], new[6], "numbers", "times", "batch")
    schema = with_fields(documents, len(own) + 4, "n_best long, count_sum long, groups_sha256 string")

    def finish(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        total, best = np.zeros(right.num_rows, np.int64), np.zeros(right.num_rows, np.int64)
        at = right.column("number").to_numpy()
        total[at], best[at] = right.column("total").to_numpy(), right.column("best").to_numpy()
        left = left.combine_chunks()
        sums: dict[str, list[int]] = {"n_best": [], "count_sum": []}
        for numbers, times in zip(left.column("numbers"), left.column("times"), strict=True):
            n, t = numbers.values.to_numpy(), times.values.to_numpy()
            sums["n_best"].append(int((best[n] * t).sum()))
            sums["count_sum"].append(int((total[n] * t).sum()))
        columns = {c: left.column(c) for c in [*own, *new[:4], new[6]]} | {c: pa.array(v, pa.int64()) for c, v in sums.items()}
        return pa.table([columns[c] for c in schema.names], names=schema.names)

    out = documents.groupBy("batch").cogroup(values.groupBy("batch")).applyInArrow(finish, schema)
    return out.select(*[F.col(o).alias(c) for c, o in zip(kept, own, strict=True)], *new)
