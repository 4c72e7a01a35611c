"""SimHash near-duplicates with vantage-point trees.

Fingerprints.  A text is lower-cased (A-Z), cut into words at ASCII white space, and each shingle of some words is hashed with XXH64 (seed 42).
A bit of the fingerprint is set if it is set in over half of the shingles' hashes, repeats included.  A text with fewer words is one
shingle; one without words (empty or null) has fingerprint zero and links like any other.  Wider fingerprints take
further 64-bit lanes from mixes of the same hashes.

Search.  Equal fingerprints become one node.  A vantage-point tree, built on the driver from at most ``SAMPLE`` nodes, cuts the
space of first lanes: each inner vertex has a vantage point and a radius, and a fingerprint goes inside or outside by its Hamming
distance.  The leaves are the shards.  Every node is at home in one leaf; by the triangle inequality a node x has no partner
in a subtree unless its distance to each vantage point on the way lies within ``max_bits`` of that side, so it visits only those leaves, and
of these only the ones numbered below its own, which meets every pair once.  Leaves with many nodes are cut into blocks, the later of
which visit the earlier, and the visitors of a leaf into parts; a task meets one block and one part, both of bounded size.  A vertex whose boundary band would hold the whole outside is not split, since nothing would be pruned.

Every pair within ``max_bits`` is thus compared exactly, in one task.  A task emits a spanning forest of the links it finds, not the
pairs, so a group of thousands of near copies costs as many rows as it has members.  The forests of all tasks are joined into components by
alternating large-star and small-star rounds on tables in the shared folder.  No fingerprints (but for the sample), links or
components reach the driver.

Exact similarity.  ``shingle_components`` links texts by the Jaccard similarity of their sets of shingles.  Rows with equal sets are one node.  The tree search
above gives the candidates within ``TREE_BITS`` of the first lane, whatever their minima.  Fingerprints of texts at 0.8 may differ in more (25 of 64 must be
allowed), and there no vantage point's bounds prune anything: distances between unrelated texts all lie within that of half the bits, and a
tree would compare all pairs.  So the candidates beyond come from minima: a text goes to one shard for each of ``BANDS`` bands of
``BAND_ROWS`` minima of its shingles' hashes, so a pair at similarity s shares none with probability (1 - s ** BAND_ROWS) ** BANDS (2.7e-5 at 0.8).  Nodes that
the tree links or that share a shard join into candidate components, and only nodes of the same one can be linked.  The shingle hashes
of a component's nodes are joined to them and met once, a pair of blocks of the component in each task (many small components share one).
A pair is compared if its SimHash fingerprints differ in few enough bits, and linked if the exact similarity of its sets reaches the bound.
Nodes without any candidate ship no shingles.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from fractions import Fraction
from functools import cache
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from protomill.llm.common import discard, document_keys, map_texts, stored

#: Nodes that the driver sees to build a tree.
SAMPLE = 4096
#: Nodes of a leaf at which splitting ends.
LEAF_NODES = 2048
#: Leaves of a tree at most.
MAX_LEAVES = 1024
#: Nodes and shingles of a block of a candidate component, about.
BLOCK_NODES, BLOCK_SHINGLES = 2048, 1 << 20
#: Differing bits up to which the tree finds the candidates for an exact similarity.
TREE_BITS = 4
#: Bands of minima that deal sets of shingles to shards, and the minima of each.
BANDS, BAND_ROWS = 20, 4
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def shingle_hashes(text: str, words: int) -> np.ndarray:
    """XXH64 (seed 42) of each shingle, repeats included; empty if there is no word."""
    from xxhash import xxh64_intdigest

    w = text.encode().lower().split()  # bytes: A-Z only, and ASCII white space only
    if not w:
        return np.zeros(0, dtype=np.uint64)
    joined = b" ".join(w)
    ends = list(accumulate(len(x) + 1 for x in w))
    n = max(1, len(w) - words + 1)
    starts = [0, *ends[: n - 1]]
    last = [e - 1 for e in ends[words - 1 :]] or [len(joined)]
    return np.array([xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts, last, strict=True)], dtype=np.uint64)


def fingerprint(hashes: np.ndarray, lanes: int = 1) -> list[int]:
    """Majority bits of the hashes, as signed 64-bit integers, one for each lane."""
    out = []
    for lane in range(lanes):
        if not len(hashes):
            out.append(0)
            continue
        h = hashes
        if lane:
            h = h + np.uint64(lane * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
            h = (h ^ (h >> np.uint64(30))) * _M1
            h = (h ^ (h >> np.uint64(27))) * _M2
            h = h ^ (h >> np.uint64(31))
        counts = np.unpackbits(h.view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
        bits = np.packbits(counts * 2 > len(h), bitorder="little")
        out.append(int(bits.view(np.int64)[0]))
    return out


@cache
def _factors(count: int) -> np.ndarray:
    """Odd multipliers, each of which puts hashes in an order of its own."""
    return np.random.default_rng(29).integers(0, 1 << 63, size=count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def band_keys(hashes: np.ndarray, bands: int = BANDS, rows: int = BAND_ROWS) -> np.ndarray:
    """A key for each band, from the least hashes of a set in ``rows`` orders; none for an empty set."""
    if not len(hashes):
        return np.zeros(0, dtype=np.uint64)
    factors = _factors(bands * rows)
    mixed = hashes ^ (hashes >> np.uint64(32))
    least = np.full(len(factors), np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(mixed), 256):
        least = np.minimum(least, (mixed[at : at + 256, None] * factors[None, :]).min(0))
    key = np.arange(bands, dtype=np.uint64)
    for column in least.reshape(bands, rows).T:
        key = (key ^ column) * _M1
        key ^= key >> np.uint64(29)
    return key


def fingerprints(df: DataFrame, keep: list[str], words: int, lanes: int = 1, text_col: str = "text", distinct: bool = False, sets: bool = False) -> DataFrame:
    """``keep`` and f0, f1, ... and shingles (how many) of every whole text; narrow, no shuffle.

    With ``distinct``, repeats don't count, and n is a digest of the set and bands holds its 64-bit band keys; or with ``sets``, hashes its sorted hashes.
    """

    def make() -> Callable[[list[str]], list[list]]:
        def work(texts: list[str]) -> list[list]:
            hashes = [shingle_hashes(t, words) for t in texts]
            if distinct:
                hashes = [np.unique(h) for h in hashes]
            found = [fingerprint(h, lanes) for h in hashes]
            columns = [[f[i] for f in found] for i in range(lanes)] + [[len(h) for h in hashes]]
            if sets:
                columns.append([h.tobytes() for h in hashes])
            elif distinct:
                columns.append([hashlib.md5(h.tobytes()).digest() for h in hashes])
                columns.append([band_keys(h).tobytes() for h in hashes])
            return columns

        return work

    schema = ", ".join(f"f{i} long" for i in range(lanes)) + ", shingles long"
    schema += ", hashes binary" if sets else ", n binary, bands binary" if distinct else ""
    return map_texts(df, keep, text_col, schema, make)


class VantageTree:
    """A vantage-point tree over 64-bit fingerprints; its vertices are arrays, its leaves numbers."""

    def __init__(self, sample: np.ndarray, nodes: int, max_bits: int, leaf_nodes: int = LEAF_NODES, max_leaves: int = MAX_LEAVES):
        self.max_bits = max_bits
        self.vertices: list[tuple[int, int, int, int]] = []  # vantage, radius, inside, outside; leaves are -1 - number
        self.leaves = 0
        rng = np.random.default_rng(11)
        share = nodes / max(1, len(sample))

        def build(some: np.ndarray, room: int) -> int:
            split = None
            if len(some) * share > leaf_nodes and len(some) >= 8 and room > 1:
                split = self._split(some, rng)
            if split is None:
                self.leaves += 1
                return -self.leaves
            vantage, radius = split
            at = len(self.vertices)
            self.vertices.append((0, 0, 0, 0))
            near = np.bitwise_count(some ^ np.uint64(vantage)) <= radius
            inside = build(some[near], room // 2)
            outside = build(some[~near], room // 2)
            self.vertices[at] = (vantage, radius, inside, outside)
            return at

        self.root = build(sample, max_leaves)

    def _split(self, some: np.ndarray, rng: np.random.Generator) -> tuple[int, int] | None:
        """The vantage point and radius that leave the fewest comparisons, if they save a tenth at least."""
        best, choice, n = 0.45, None, len(some)
        for vantage in rng.choice(some, size=min(8, n), replace=False):
            d = np.bitwise_count(some ^ vantage).astype(int)
            upto = np.cumsum(np.bincount(d, minlength=66 + self.max_bits)) / n
            for radius in np.unique(np.quantile(d, (0.3, 0.4, 0.5, 0.6, 0.7)).astype(int)):
                inside = upto[radius]
                band = upto[min(64, radius + self.max_bits)] - inside
                cost = inside**2 / 2 + (1 - inside) ** 2 / 2 + inside * band
                if 0 < inside < 1 and cost < best:
                    best, choice = cost, (int(vantage), int(radius))
        return choice

    def route(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(home leaf of each fingerprint, index of a visitor, leaf that it may have partners in)."""
        home = np.zeros(len(prints), dtype=np.int32)
        who, where = [], []
        todo = [(self.root, np.arange(len(prints)), np.ones(len(prints), dtype=bool))]
        while todo:
            at, some, own = todo.pop()
            if not len(some):
                continue
            if at < 0:
                home[some[own]] = -1 - at
                who.append(some)
                where.append(np.full(len(some), -1 - at, dtype=np.int32))
                continue
            vantage, radius, inside, outside = self.vertices[at]
            d = np.bitwise_count(prints[some] ^ np.uint64(vantage)).astype(int)
            goes_in, goes_out = d <= radius + self.max_bits, d > radius - self.max_bits
            todo.append((inside, some[goes_in], (own & (d <= radius))[goes_in]))
            todo.append((outside, some[goes_out], (own & (d > radius))[goes_out]))
        if not who:
            return home, np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int32)
        return home, np.concatenate(who), np.concatenate(where)


def forest(prints: np.ndarray, home: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(member, root) indices of a spanning forest of the links that have an end at home in the shard.

    A link needs at most ``max_bits`` differing bits.
    """
    n = len(prints)
    label = np.arange(n)
    own = np.nonzero(home)[0]
    step = max(1, (1 << 18) // max(1, n))
    for at in range(0, len(own), step):
        rows = own[at : at + step]
        near = np.bitwise_count(prints[rows][:, None] ^ prints[None, :]) <= max_bits
        near[np.arange(len(rows)), rows] = False
        a, b = np.nonzero(near)
        if not len(a):
            continue
        a = rows[a]
        differ = label[a] != label[b]
        a, b = a[differ], b[differ]
        for i in np.unique(a):
            labels = np.unique(np.append(label[b[a == i]], label[i]))
            if len(labels) > 1:
                label[np.isin(label, labels)] = labels[0]
    member = np.nonzero(label != np.arange(n))[0]
    return member, label[member]


def exact_forest(sets: list[np.ndarray], lanes: np.ndarray, home: np.ndarray, max_bits: int, all_bits: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """(member, root) indices of a spanning forest of the pairs whose sets have at least the Jaccard similarity.

    Pairs are candidates by their fingerprints, and have one end at home, or both if all are; those connected already are not looked at.
    """
    n = len(sets)
    sizes = np.array([len(x) for x in sets], dtype=np.int64)
    label = np.arange(n)
    _, index = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(sizes)
    member_of = [index[e - k : e] for e, k in zip(ends.tolist(), sizes.tolist(), strict=True)]
    mark = np.zeros(int(index.max()) + 1 if len(index) else 1, dtype=bool)
    # a quotient of whole numbers, so that no rounding decides at the bound
    bound = Fraction(str(similarity))
    over, under = bound.numerator, bound.denominator
    for a in np.nonzero(home)[0]:
        some = np.nonzero(label != label[a])[0]
        some = some[some > a] if home.all() else some[~home[some]]  # two blocks: pairs within one are met in a task of their own
        small, large = np.minimum(sizes[some], sizes[a]), np.maximum(sizes[some], sizes[a])
        some = some[small * under >= large * over]
        some = some[np.bitwise_count(lanes[some, 0] ^ lanes[a, 0]) <= max_bits]
        some = some[np.bitwise_count(lanes[some] ^ lanes[a]).sum(1, dtype=np.int64) <= all_bits]
        if not len(some) or not sizes[a]:
            continue
        mark[member_of[a]] = True
        for b in some.tolist():
            if label[b] == label[a]:
                continue
            both = int(np.count_nonzero(mark[member_of[b]]))
            if both * under >= int(sizes[a] + sizes[b] - both) * over:
                low, high = sorted((label[a], label[b]))
                label[label == high] = low
        mark[member_of[a]] = False
    member = np.nonzero(label != np.arange(n))[0]
    return member, label[member]


def exact_links(docs: DataFrame, placed: DataFrame, words: int, lanes: int, max_bits: int, all_bits: int, similarity: float) -> DataFrame:
    """Edges (a, b) that connect exactly the nodes that candidate pairs of at least the similarity connect.

    ``docs`` has __d, __k and text; ``placed`` has n, root (its candidate component), shingles, and the __d and __k of one of its rows.
    """
    counts = placed.groupBy("root").agg(F.count("*").alias("__nodes"), F.sum("shingles").alias("__all"))
    blocks = F.floor(F.col("__nodes") / BLOCK_NODES + F.col("__all") / BLOCK_SHINGLES).cast("int") + 1
    counts = counts.where("__nodes > 1").select("root", blocks.alias("blocks"))
    chosen = placed.select("n", "root", "shingles", "__d", "__k").join(counts, "root")
    texts = docs.select("__d", "__k", "text").join(chosen.drop("shingles"), ["__d", "__k"]).dropDuplicates(["n"])
    own = F.pmod(F.xxhash64("n"), F.col("blocks")).cast("int").alias("own")
    # computed once, then sent to each pair of blocks
    sets = stored(fingerprints(texts.select("n", "root", "blocks", own, "text"), ["n", "root", "blocks", "own"], words, lanes, distinct=True, sets=True), "sets")
    size = sets.where("blocks = 1").agg(F.count("*"), F.sum("shingles")).first()
    # components of one block are dealt together, about a block's worth to a group
    groups = 2 * max(-(-size[0] // BLOCK_NODES), -(-(size[1] or 0) // BLOCK_SHINGLES), 1)
    whole = F.pmod(F.xxhash64("root"), F.lit(groups)).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = sets.withColumn("other", other).withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")})
    together = F.when(F.col("blocks") > 1, F.col("root")), F.when(F.col("blocks") == 1, whole)
    dealt = dealt.withColumns({"alone": together[0], "together": together[1]})

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        values = np.stack([pdf[f"f{i}"].to_numpy() for i in range(lanes)], axis=1).astype(np.int64).view(np.uint64)
        found = [np.frombuffer(x, dtype=np.uint64) for x in pdf["hashes"]]
        home = (pdf["own"] == pdf["i"]).to_numpy()
        n, members, heads = pdf["n"].to_numpy(), [], []
        for some in pdf.groupby("root").indices.values():
            if len(some) > 1:
                member, head = exact_forest([found[i] for i in some], values[some], home[some], max_bits, all_bits, similarity)
                members.append(n[some[member]])
                heads.append(n[some[head]])
        return pd.DataFrame({"a": np.concatenate(members), "b": np.concatenate(heads)} if members else {"a": [], "b": []})

    columns = ["alone", "together", "root", "i", "j", "own", "n", *[f"f{i}" for i in range(lanes)], "hashes"]
    return dealt.select(*columns).groupBy("alone", "together", "i", "j").applyInPandas(compare, "a binary, b binary")


def shared_bands(nodes: DataFrame) -> DataFrame:
    """Edges (a, b) that connect the nodes which share a shard: each to the least node of the shard.

    ``nodes`` has n and bands.  A shard of a third of all nodes is one row of a partial aggregate, and edges go to no task as a group.
    """
    keys = F.expr("transform(sequence(1, int(length(bands) / 8)), i -> substring(bands, 8 * i - 7, 8))")
    dealt = nodes.select("n", F.explode(keys).alias("key")).select("n", F.xxhash64("key").alias("key"))
    shards = dealt.groupBy("key").agg(F.min("n").alias("b"), F.max("n").alias("__hi")).where("b <> __hi").select("key", "b")
    return dealt.join(shards, "key").where("n <> b").select(F.col("n").alias("a"), "b").distinct()


def tree_candidates(nodes: DataFrame, max_bits: int) -> DataFrame:
    """Edges (a, b) that connect the nodes (n, f0) whose fingerprints differ in ``max_bits`` at most: the tree meets one node of each fingerprint."""
    prints = stored(nodes.groupBy("f0").agg(F.min("n").alias("n")), "tree")
    equal = nodes.select("f0", F.col("n").alias("a")).join(prints.select("f0", F.col("n").alias("b")), "f0").where("a <> b").select("a", "b")
    return links(prints, max_bits).unionByName(equal)


def shingle_classes(
    docs: DataFrame,
    max_bits: int,
    all_bits: int,
    similarity: float,
    words: int = 5,
    lanes: int = 4,
) -> tuple[DataFrame, DataFrame]:
    """(prints, classes): ``prints`` is ``docs`` (less its text) with n, the set that the text has; ``classes`` has n, least, __row and root, the class.

    ``docs`` has __id, __d, __k and text.  Texts whose sets have at least the Jaccard similarity are linked, and classes are the components of links.
    ``least`` is the smallest __id of a node, and __row (no id, __d, __k) its first row by the same order.
    """
    prints = stored(fingerprints(docs, [c for c in docs.columns if c != "text"], words, lanes, distinct=True), "prints")
    names = [f"f{i}" for i in range(lanes)]
    firsts = [F.first(c).alias(c) for c in ("f0", "shingles", "bands")]  # the same in all rows of a node
    row = F.min(F.struct(F.col("__id").isNull().alias("none"), "__d", "__k")).alias("__row")
    nodes = stored(prints.groupBy("n").agg(F.min("__id").alias("least"), row, *firsts), "nodes")
    candidates = connected(tree_candidates(nodes, TREE_BITS).unionByName(shared_bands(nodes)))
    candidates = candidates.union(candidates.select(F.col("root").alias("node"), "root")).distinct()
    placed = nodes.select("n", "shingles", "__row.__d", "__row.__k").join(candidates.withColumnRenamed("node", "n"), "n")
    roots = connected(exact_links(docs, stored(placed, "placed"), words, lanes, max_bits, all_bits, similarity))
    classes = nodes.select("n", "least", "__row").join(roots.withColumnRenamed("node", "n"), "n", "left").withColumn("root", F.coalesce("root", "n"))
    return prints.drop("bands", "shingles", *names), classes


def shingle_components(
    df: DataFrame,
    max_bits: int,
    all_bits: int,
    similarity: float,
    words: int = 5,
    lanes: int = 4,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """A row for each input row: its id and component_id, over links of texts whose sets of shingles have at least the Jaccard similarity.

    Pairs are compared if they differ in ``max_bits`` of the first lane and ``all_bits`` of all lanes at most.  ``component_id`` is as in
    ``simhash_components``.  Texts without a word have equal (empty) sets, and link with each other only.
    """
    docs = document_keys(df.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text")), "text", "__id")
    prints, classes = shingle_classes(docs, max_bits, all_bits, similarity, words, lanes)
    smallest = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    out = prints.select("__id", "n").join(classes.join(smallest, "root").select("n", "component_id"), "n")
    return out.select(F.col("__id").alias(id_col), "component_id")


def one_of_each(
    df: DataFrame, max_bits: int, all_bits: int, similarity: float, words: int = 5, lanes: int = 4, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row of each component of ``shingle_components``, and all its columns.

    That with the smallest id stays (rows without an id come last), of texts under one id that with the smallest hash, and of
    rows with equal id and text one: the first by a hash of its other columns.
    """
    keyed = document_keys(df, text_col, id_col)
    docs = keyed.select(F.col(f"`{id_col}`").cast("long").alias("__id"), "__d", "__k", F.col(f"`{text_col}`").alias("text"))
    _, classes = shingle_classes(docs, max_bits, all_bits, similarity, words, lanes)
    keep = classes.groupBy("root").agg(F.min("__row").alias("__row")).select("__row.__d", "__row.__k")
    columns = [F.col(f"`{c}`") for c in df.columns]
    order = F.struct(F.col(f"`{id_col}`").isNull(), F.xxhash64(*[F.to_json(F.struct(c)) for c in columns]))
    # repeated rows meet in partial aggregates, so that many of them fill no task
    rows = keyed.groupBy("__d", "__k").agg(F.min_by(F.struct(*columns), order).alias("__whole"))
    return rows.join(keep, ["__d", "__k"], "left_semi").select("__whole.*")


def links(nodes: DataFrame, max_bits: int, block_nodes: int = LEAF_NODES) -> DataFrame:
    """Edges (a, b) between node ids that connect exactly the nodes that links connect.

    ``nodes`` has n (the node's id) and f0.  A task's group is one block of a leaf's nodes and one part of the leaf's visitors, each of about
    ``block_nodes`` nodes, however large the table.
    """
    total = nodes.count()
    sample = [r[0] for r in nodes.orderBy(F.xxhash64("f0"), "f0").limit(SAMPLE).select("f0").collect()]  # SAMPLE rows at most
    tree = VantageTree(np.array(sample, dtype=np.int64).view(np.uint64), total, max_bits, block_nodes)

    def census(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The nodes at home in each leaf and the visitors from later leaves, of each batch."""
        for pdf in batches:
            home, who, where = tree.route(pdf["f0"].to_numpy().view(np.uint64))
            at_home = np.bincount(home, minlength=tree.leaves)
            visits = np.bincount(where[where < home[who]], minlength=tree.leaves)
            leaf = np.nonzero(at_home + visits)[0]
            yield pd.DataFrame({"leaf": leaf.astype(np.int32), "nodes": at_home[leaf], "visits": visits[leaf]})

    counted = nodes.select("f0").mapInPandas(census, "leaf int, nodes long, visits long").groupBy("leaf").agg(F.sum("nodes"), F.sum("visits")).collect()
    blocks, parts = np.zeros(tree.leaves, dtype=np.int64), np.ones(tree.leaves, dtype=np.int64)  # MAX_LEAVES at most
    for leaf, own, visits in counted:
        blocks[leaf] = -(-own // block_nodes)
        parts[leaf] = max(1, -(-(visits + (own if blocks[leaf] > 1 else 0)) // block_nodes))

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            prints = pdf["f0"].to_numpy().view(np.uint64)
            home, who, where = tree.route(prints)
            mixed = (prints * _M1) ^ ((prints * _M2) >> np.uint64(32))
            block = ((mixed >> np.uint64(20)) % blocks[home].astype(np.uint64)).astype(np.int64)

            def each(index: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
                """Every index so many times, numbered from 0."""
                return np.repeat(index, times), np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)

            # a node is at home in its block, which meets every part of the visitors
            some, part = each(np.arange(len(pdf)), parts[home])
            rows = [(some, home[some], block[some], part, np.ones(len(some), dtype=bool))]
            # it visits the earlier blocks of its own leaf, and all blocks of the earlier leaves that it may have partners in
            lower = where < home[who]
            for index, leaf, upto in ((np.arange(len(pdf)), home, block), (who[lower], where[lower], blocks[where[lower]])):
                at, number = each(np.arange(len(index)), upto)
                node, to = index[at], leaf[at]
                part = ((mixed[node] >> np.uint64(7)) % parts[to].astype(np.uint64)).astype(np.int64)
                rows.append((node, to, number, part, np.zeros(len(node), dtype=bool)))
            index, *place = (np.concatenate(x) for x in zip(*rows, strict=True))
            # what goes to one shard from here travels as one row of arrays
            order = np.lexsort(place[::-1])
            index, place = index[order], [x[order] for x in place]
            new = np.ones(len(index), dtype=bool)
            new[1:] = np.any([x[1:] != x[:-1] for x in place], axis=0)
            first = np.nonzero(new)[0]
            packed = {c: np.split(pdf[c].to_numpy()[index], first[1:]) for c in ("n", "f0")}
            yield pd.DataFrame(packed | {c: x[first] for c, x in zip(("leaf", "block", "part", "home"), place, strict=True)})

    kind = dict(nodes.dtypes)["n"]

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        n, prints = (np.concatenate([np.asarray(x) for x in pdf[c]]) for c in ("n", "f0"))
        home = np.repeat(pdf["home"].to_numpy(), [len(x) for x in pdf["n"]])
        member, root = forest(prints.astype(np.int64).view(np.uint64), home, max_bits)
        return pd.DataFrame({"a": n[member], "b": n[root]})

    dealt = nodes.select("n", "f0").mapInPandas(deal, f"n array<{kind}>, f0 array<long>, leaf int, block int, part int, home boolean")
    return dealt.groupBy("leaf", "block", "part").applyInPandas(compare, f"a {kind}, b {kind}")


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) for every node that has an edge; the root is the smallest node of the component.

    Alternating rounds: in a large-star round every node hands its greater neighbours its smallest neighbour, in a small-star round
    its smaller ones; a round's edges are a table in the shared folder.  The number of rounds grows with the logarithm of the nodes.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = stored(e, "edges")
    seen = None
    while True:
        mark = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen or not mark[0]:
            return e.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
        seen = mark
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select("b", "a"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lowest, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        small = small.union(lowest.select("a", F.col("m").alias("b")))
        last, e = e, stored(small.distinct(), "edges")
        discard(last)


def simhash_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, max_bits: int = 4, block_nodes: int = LEAF_NODES) -> DataFrame:
    """A row for each input row: its id, fingerprint (hex) and component_id.

    ``component_id`` is the smallest id reachable over links, the row's own included (null ids are passed over; null only if the component has
    no other).
    """
    prints = stored(fingerprints(df, [id_col], words, 1, text_col), "prints")
    nodes = stored(prints.groupBy("f0").agg(F.min(id_col).alias("least")).withColumn("n", F.col("f0")), "nodes")
    roots = connected(links(nodes, max_bits, block_nodes))
    placed = nodes.join(roots.withColumnRenamed("node", "n"), "n", "left").withColumn("root", F.coalesce("root", "n"))
    smallest = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    out = prints.join(placed.join(smallest, "root").select("f0", "component_id"), "f0")
    return out.select(id_col, F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), "component_id")
