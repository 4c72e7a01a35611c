"""Operators that compare rows with each other."""

from __future__ import annotations

import hashlib
import math
import random
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from protomill.llm import common
from protomill.llm import multi_index as N
from protomill.llm import simhash_dedup as H
from protomill.llm import source_mixing as M
from protomill.llm import substring_dedup as D
from protomill.llm import url_filter as U
from protomill.llm.common import document_keys
from protomill.llm.queries import URL_RULES
from tests.llm.conftest import awkward_rows, prose

URLS = [
    (1, "https://m.a.example.org/en/1x#top"),
    (2, "http://example.org/es/5"),
    (3, "HTTP://News.EXAMPLE.com/fr/a?b://c"),
    (4, "https://x.com/de"),
    (5, "https://x.com/de/?q"),
    (6, "no scheme"),
    (7, None),
    (8, ""),
    (9, "http://notexample.org/es/1"),
    (10, "http://x.net?page=2"),
    (11, "http://www.x.net/a.html"),
    (12, "ftp://x.net/a/"),
    (12, "ftp://x.net/a/"),
    (13, "http://com/fr/"),
    (14, "http://a://b/c"),
]


def judge(url, listed):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min((path.find(c) for c in "?#" if c in path), default=len(path))]
    fit = [(h + p, v) for v, h, p in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    rule, verdict = max(fit, key=lambda f: len(f[0]), default=(None, None))
    short = host.removeprefix("www.") if host.startswith("www.") else host.removeprefix("m.")
    page = path.removesuffix(".html") if path.endswith(".html") else path.removesuffix("/")
    return host, path, rule, verdict or ("block" if host and short + page in listed else "allow")


@pytest.mark.parametrize("blocks", [1, 1 << 17])
def test_urls(spark, monkeypatch, blocks):
    """Also with a filter so small that it passes nearly everything: verdicts don't change."""
    monkeypatch.setattr(U, "BLOCKS", blocks)
    pages = spark.createDataFrame([(*u, "old") for u in URLS], "page_id long, url string, rule string")
    listed = spark.createDataFrame([("x.net/a",), ("x.net/a",), (None,), ("y.net/b",)], "canonical string")
    got = U.judge_urls(pages, URL_RULES, listed)
    assert got.columns == ["page_id", "url", "host", "path", "canonical", "rule", "verdict"]
    rows = sorted((r["page_id"], r["host"], r["path"], r["rule"] or "", r["verdict"]) for r in got.collect())
    want = sorted((i, h, p, r or "", v) for i, u in URLS for h, p, r, v in [judge(u, {"x.net/a", "y.net/b"})])
    assert rows == want
    assert U.judge_urls(pages.limit(0), URL_RULES, listed).count() == 0
    long = spark.createDataFrame([(1, "https://x.net/" + "a/" * 50_000, 3, 4)], "page_id long, url string, __block int, __mask int")
    found = U.judge_urls(long.withColumns({c: F.lit("old") for c in ("host", "path", "canonical", "verdict", "__host", "__probe", "__listed")}), URL_RULES, listed)
    assert [(r["host"], len(r["path"]), r["verdict"]) for r in found.collect()] == [("x.net", 100_001, "allow")]
    assert U.judge_urls(pages, [], listed.limit(0)).where("verdict = 'block' or rule is not null").count() == 0


def test_bloom_filter_has_no_false_negatives(spark):
    keys = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("k"))
    blocks = U.blocks_for(3000)
    table = {r[0]: r[1] for r in U.bloom_filter(keys, "k", blocks).collect()}
    block, mask = U._block_and_mask(F.col("k"), blocks)
    probed = keys.union(spark.range(3000).select(F.concat(F.lit("z"), "id"))).select("k", block.alias("b"), mask.alias("m")).collect()
    passed = [r["k"] for r in probed if table.get(r["b"], 0) & r["m"] == r["m"]]
    assert sum(k.startswith("k") for k in passed) == 3000 and sum(k.startswith("z") for k in passed) < 180


@pytest.mark.parametrize("weights", [{"a": 1, "b": 1}, {"a": 5, "b": 1, "c": 1}, {"a": 997, "b": 2, "c": 1}, {"a": 1, "b": 3, "c": 7, "d": 11}])
def test_schedule_stays_within_a_block(weights):
    parts = M.parts_of(weights)
    slots = M.one_period(parts)
    size = sum(parts.values())
    assert Counter(slots) == parts
    done = Counter()
    for t, s in enumerate(slots, 1):
        done[s] += 1
        assert all(abs(done[x] - t * p / size) < 1 for x, p in parts.items())


def test_phases_keep_every_block():
    counts, weights = {"a": 37, "b": 5, "c": 1, "d": 0}, {"a": 1, "b": 4, "c": 2}
    plan = M.phases(counts, weights, 100)
    assert plan[-1]["end"] == sum(counts.values())
    assert [p["at"] for p in plan[1:]] == [p["end"] for p in plan[:-1]]


def test_mix(spark, awkward, empty):
    rng = random.Random(1)
    rows = [(i, rng.choice(["hot"] * 5 + ["x", "y", None])) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, source string").withColumn("slot", F.lit("old"))
    got = M.mix(docs, {"hot": 2, "x": 1}, block_docs=4, period=100).collect()
    assert len(got) == 900 and {r["doc_id"] for r in got} == set(range(900))
    blocks = defaultdict(list)
    for r in got:
        blocks[r["source"], r["block"]].append(r)
    slots = [b[0]["slot"] for b in blocks.values()]
    assert sorted(slots) == list(range(len(blocks)))  # every slot once
    for (source, block), b in blocks.items():
        assert len({r["slot"] for r in b}) == 1 and sorted(r["position"] for r in b) == list(range(len(b)))
        assert b[0]["release"] <= b[0]["slot"] < b[0]["deadline"]
        last = max(k for s, k in blocks if s == source)
        assert len(b) == 4 or block == last
    order = [s for _, s in sorted((b[0]["slot"], s or "") for (s, _), b in blocks.items())]
    parts = M.parts_of({"hot": 2, "x": 1, "y": 1, "": 1}, 100)
    first = min(order[::-1].index(s) for s in parts)  # while no source has run out
    alive = len(order) - max(order[::-1].index(s) for s in parts)
    done = Counter()
    for t, s in enumerate(order[:alive], 1):
        done[s] += 1
        assert all(abs(done[x] - t * p / 100) < 1 for x, p in parts.items())
    assert first == 0
    assert M.mix(awkward, tie_cols=["text"]).count() == awkward.count()
    assert M.mix(empty).count() == 0


def test_mix_with_clashing_columns(clashing, awkward):
    wide = clashing.withColumns({c: F.lit(7) for c in ("release", "deadline", "position", "__s", "__rank", "__slots", "__bucket")})
    got = M.mix(wide, tie_cols=["text"])
    assert got.count() == awkward.count() and got.where("slot <> 7").count() > 0


def brute_mix(counts, weights):
    """The source of each slot: earliest deadline first among released blocks, all by exact fractions, with a new start when a source has run out."""
    left, out = {s: n for s, n in counts.items() if n}, []
    while left:
        total = sum(Fraction(str(weights.get(s, 1))) for s in left)
        share = {s: Fraction(str(weights.get(s, 1))) / total for s in left}
        done = dict.fromkeys(left, 0)
        t = 0
        while all(left.values()):
            ready = [s for s in left if math.floor(done[s] / share[s]) <= t]
            s = min(ready, key=lambda s: (math.ceil((done[s] + 1) / share[s]), str(s)))
            done[s] += 1
            left[s] -= 1
            out.append(s)
            t += 1
        left = {s: n for s, n in left.items() if n}
    return out


@pytest.mark.parametrize("weights", [{"a": 5}, {"a": 0.5, "b": 1.25, "c": 3}, {}])
def test_mix_equals_a_brute_force_schedule(spark, weights):
    counts = {"a": 41, "b": 17, "c": 30, "d": 3}
    rows = [(i, s) for i, s in enumerate(s for s, n in counts.items() for _ in range(n))]
    got = M.mix(spark.createDataFrame(rows, "doc_id long, source string"), weights, block_docs=1).orderBy("slot").collect()
    assert [r["source"] for r in got] == brute_mix(counts, weights)


def worst_deviation(counts, weights):
    """Of any source's blocks from its exact share of the slots, while no source has run out; from the closed form."""
    first = M.phases(counts, weights)[0]
    order = np.full(first["end"], -1)
    names = list(counts)
    for k, s in enumerate(names):
        slots, parts, size = np.array(first["pattern"][s], dtype=int), first["parts"][s], first["size"]
        j = np.arange(counts[s])
        if len(slots) == parts:
            at = j // parts * size + slots[j % parts]
        else:
            at = slots
        order[at[at < first["end"]]] = k
    assert (order >= 0).all()  # every slot once
    total = sum(weights.get(s, 1) for s in names)
    t = np.arange(1, len(order) + 1)
    return max(float(np.abs(np.cumsum(order == k) - t * (weights.get(s, 1) / total)).max()) for k, s in enumerate(names))


def test_schedule_keeps_the_given_weights_over_many_periods():
    names = [f"src{i}" for i in range(20)]
    assert worst_deviation({s: 25_000 if s == "src0" else 5_000 for s in names}, {"src0": 5}) < 1
    assert worst_deviation({"a": 20_000, "b": 20_000, "c": 20_000}, {"a": 0.1, "b": 0.33, "c": 1 / 8}) < 1


def test_schedule_keeps_the_given_weights_of_many_sources():
    counts = {f"src{i}": 50 if i == 0 else 10 for i in range(1500)}
    assert worst_deviation(counts, {"src0": 5}) < 1
    assert worst_deviation({"a": 30, "b": 3_000, "c": 40}, {"a": 0.123457, "b": 12.3456789, "c": 0.2}) < 1  # a period longer than the phase


def test_mix_keeps_the_given_weights(spark):
    rows = [(i, "hot" if i % 24 < 5 else f"s{i % 24}") for i in range(24 * 150)]
    got = M.mix(spark.createDataFrame(rows, "doc_id long, source string"), {"hot": 5}, block_docs=1).orderBy("slot").collect()
    assert [r["slot"] for r in got] == list(range(len(rows)))
    assert all(r["release"] <= r["slot"] < r["deadline"] for r in got)
    done = Counter()
    for t, r in enumerate(got[: 24 * 149], 1):  # in the last period sources run out
        done[r["source"]] += 1
        assert abs(done[r["source"]] * 24 - t * (5 if r["source"] == "hot" else 1)) < 24
        assert r["release"] == r["block"] * 24 // (5 if r["source"] == "hot" else 1)


def brute_dedup(texts, window=35):
    words = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return out


def patchwork(seed, n=60):
    """Texts pasted together from shared passages of many lengths, so that windows straddle every kind of edge."""
    rng = random.Random(seed)
    pool = [prose(rng, rng.choice([20, 34, 35, 36, 50, 80, 150])) for _ in range(12)]
    texts = [" ".join(rng.choice([prose(rng, rng.randrange(1, 60)), rng.choice(pool), " ".join(rng.choice(pool).split()[rng.randrange(20) :])]) for _ in range(rng.randrange(1, 7))) for _ in range(n)]
    return texts + ["a b " * 100, "a b " * 60 + "c", "z " * 36]


@pytest.mark.parametrize("seed, group", [(1, 20_000), (2, 20_000), (3, 2), (4, 5)])
def test_substrings_equal_brute_force(spark, monkeypatch, seed, group):
    """Also where the occurrences of a block are met in several groups."""
    monkeypatch.setattr(D, "GROUP_ROWS", group)
    texts = patchwork(seed)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in D.remove_duplicates(docs, ["doc_id"]).collect()}
    assert [got[i] for i in range(len(texts))] == brute_dedup(texts)


def test_factors_match_their_references(spark):
    """Each factor's words stand at its reference too, no factor could go on with the same reference, and together they are the duplicate words."""
    texts = patchwork(4)
    docs = spark.createDataFrame([*enumerate(texts), (0, texts[0])], "doc_id long, text string").repartition(4)
    keyed = document_keys(docs).select("__d", "__k", F.col("text").alias("__text"))
    words = [t.split() for t in texts]
    gone = [set() for _ in texts]
    parsed = D.factors(keyed).collect()
    assert len({r["d"] for r in parsed}) == len(parsed)
    for r in parsed:
        mine, ends = words[r["d"]], set()
        for at, length, ref, ref_at in zip(r["at"], r["length"], r["ref_d"], r["ref_at"], strict=True):
            assert length >= 35 and mine[at : at + length] == words[ref][ref_at : ref_at + length]
            assert (ref, ref_at) != (r["d"], at) or r["d"] == 0  # the row that repeats
            assert (ref, ref_at - at, at) not in ends
            ends.add((ref, ref_at - at, at + length - 34))
            gone[r["d"]] |= set(range(at, at + length))
    assert [len(g) for g in gone] == [n for _, n, _ in brute_dedup([*texts, texts[0]])[: len(texts)]]


def test_a_long_copy_is_one_factor(spark):
    rng = random.Random(8)
    passage = prose(rng, 4000)
    docs = spark.createDataFrame([(1, prose(rng, 50) + " " + passage), (2, passage + " " + prose(rng, 70))], "doc_id long, text string")
    rows = D.factors(document_keys(docs).select("__d", "__k", F.col("text").alias("__text"))).orderBy("d").collect()
    assert [(r["d"], r["at"], r["length"], r["ref_d"], r["ref_at"]) for r in rows] == [(1, [50], [4000], [2], [0]), (2, [0], [4000], [1], [50])]


def test_documents_go_on_in_the_next_batch():
    rows = np.array([(1, 1, 0, 5, 9, 9, 3), (1, 1, 5, 2, 9, 9, 8), (1, 1, 5, 2, 9, 9, 8), (1, 1, 7, 1, 9, 9, 11), (1, 2, 8, 1, 9, 9, 11), (2, 2, 9, 4, 9, 9, 12)])
    want = [(1, 1, [0, 7], [41, 35]), (1, 2, [8], [35]), (2, 2, [9], [38])]
    for size in (1, 2, 3, 6):
        batches = (pa.RecordBatch.from_arrays([pa.array(c) for c in rows[i : i + size].T], names=list("abcdefg")) for i in range(0, len(rows), size))
        got = [r for b in D._parse(35)(batches) for r in b.to_pylist()]
        assert [(r["d"], r["k"], r["at"], r["length"]) for r in got] == want


@pytest.mark.parametrize("share", [0.0, 1.0])
def test_hot_keys_are_joined_whole(spark, monkeypatch, share):
    monkeypatch.setattr(common, "HOT_SHARE", share)
    left = spark.createDataFrame([("hot", i) for i in range(300)] + [(f"k{i}", i) for i in range(50)], "k string, v int")
    right = spark.createDataFrame([("hot", 300), ("k1", 1), ("none", 0)], "k string, c int")
    got = common.hot_split_join(left, right, ["k"], "c", 350).collect()
    assert len(got) == 301 and {r["v"] for r in got if r["k"] == "k1"} == {1}


def test_substrings_awkward(spark, awkward, empty, clashing):
    texts = [r[1] for r in awkward_rows()]
    want = Counter(brute_dedup(texts))
    assert Counter((r["n_words"], r["n_removed"], r["kept_sha256"]) for r in D.remove_duplicates(awkward, ["doc_id"]).collect()) == want
    wide = D.remove_duplicates(clashing, clashing.columns, texts=True)
    assert Counter((r["n_words"], r["n_removed"], r["kept_sha256"]) for r in wide.collect()) == want
    assert all(r["n_removed"] or r["kept_text"] == (r["text"] or "") for r in wide.collect())
    assert D.remove_duplicates(empty, ["doc_id"]).count() == 0


def test_blocks_cover_every_window_once():
    rng = random.Random(3)
    for text in (prose(rng, 35), prose(rng, 400), "same " * 90, "a b c " * 40):
        _, _, first, count = D.blocks_of(D.word_hashes(text.encode().split()), 35, 8)
        covered = [i for f, c in zip(first.tolist(), count.tolist(), strict=True) for i in range(f, f + c)]
        assert covered == list(range(len(text.split()) - 34)) and count.max() <= 28


def brute_components(prints, ids, bits):
    n = len(prints)
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(n):
        for j in np.nonzero(np.bitwise_count(prints[i + 1 :] ^ prints[i]) <= bits)[0]:
            a, b = find(i), find(i + 1 + int(j))
            root[max(a, b)] = min(a, b)
    groups = defaultdict(list)
    for i in range(n):
        groups[find(i)].append(i)
    least = {}
    for members in groups.values():
        known = [ids[i] for i in members if ids[i] is not None]
        for i in members:
            least[i] = min(known) if known else None
    return [least[i] for i in range(n)]


def naive_fingerprint(text, words):
    import xxhash

    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))] if w else []
    values = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in values) > len(values))


@pytest.mark.parametrize("bits, leaf", [(4, 8), (4, 2048), (10, 8)])
def test_simhash_equals_brute_force(spark, bits, leaf):
    rng = random.Random(9)
    texts = []
    for _ in range(40):
        words = prose(rng, rng.randrange(1, 200)).split()
        for _ in range(rng.randrange(1, 5)):
            copy = list(words)
            for _ in range(rng.randrange(3)):
                copy[rng.randrange(len(copy))] = "changed"
            texts.append(" ".join(copy))
    texts += ["", None, "one", "ONE", "one two", *[r[1] for r in awkward_rows()]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in H.simhash_components(docs, max_bits=bits, block_nodes=leaf).collect()}
    prints = np.array([naive_fingerprint(t, 4) for t in texts], dtype=np.uint64)
    want = brute_components(prints, list(range(len(texts))), bits)
    assert [got[i] for i in range(len(texts))] == [(f"{int(p):016x}", c) for p, c in zip(prints, want, strict=True)]


def test_simhash_groups_are_bounded(spark, monkeypatch):
    """No task meets more than about one block and one part, also where a leaf has many nodes and many visitors."""
    rng = np.random.default_rng(6)
    base = rng.integers(0, 1 << 63, dtype=np.int64)
    prints = sorted({int(base ^ (1 << int(a)) ^ (1 << int(b))) for a, b in rng.integers(0, 63, (1500, 2))})
    nodes = spark.createDataFrame([(p, p) for p in prints], "n long, f0 long").repartition(3)
    sizes = []
    own = type(nodes.groupBy("n"))
    monkeypatch.setattr(own, "applyInPandas", lambda self, f, schema: sizes.append(self) or self._df)
    dealt = H.links(nodes, 4, 64)
    rows = dealt.groupBy("leaf", "block", "part").agg(F.sum(F.when(F.col("home"), F.size("n")).otherwise(0)).alias("own"), F.sum(F.when(~F.col("home"), F.size("n")).otherwise(0)).alias("visitors")).collect()
    assert sizes and len(rows) > 50
    assert max(r["own"] for r in rows) < 3 * 64 and max(r["visitors"] for r in rows) < 3 * 64


def test_spark_hash_is_the_same(spark):
    """The shingles' hash is Spark's own xxhash64."""
    got = spark.sql("select xxhash64('one two three four') h").first()["h"]
    assert got & (1 << 64) - 1 == int(H.shingle_hashes("One two\tthree  four", 4)[0])


def test_simhash_awkward(awkward, empty, clashing):
    got = H.simhash_components(awkward).collect()
    assert len(got) == awkward.count()
    by_id = {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] is not None}
    assert by_id[2] == by_id[0] == 0 and by_id[9] == by_id[8] == by_id[10] == 8
    assert [r["component_id"] for r in got if r["doc_id"] is None] == [0]
    assert H.simhash_components(clashing).count() == awkward.count()
    assert H.simhash_components(empty).count() == 0
    linked = {r["doc_id"]: r["component_id"] for r in H.shingle_components(awkward, 25, 73, 0.8).collect()}
    assert linked[1] == 0 and linked[3] == 3 and linked[6] == 6


def test_a_large_group_gives_a_forest():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, dtype=np.uint64)
    prints = np.array([base ^ np.uint64(1 << int(b)) for b in rng.integers(0, 63, 500)] + list(rng.integers(0, 1 << 63, 100, dtype=np.uint64)), dtype=np.uint64)
    member, root = H.forest(prints, np.ones(600, dtype=bool), 4)
    assert len(member) == 499 and len(set(root.tolist())) == 1


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def brute_nearest(rows, k=20, every=20):
    good = [(i, np.array(v, dtype=np.float32).astype(float)) for i, v, _ in rows if i is not None and v is not None and len(v) == 16 and None not in v and np.isfinite(v).all() and any(v)]
    out = {}
    for q, x in good:
        if q % every == 0:
            out[q] = sorted(((-float(x @ v), i) for i, v in good if i != q))[:k]
    return out


def test_nearest_recall_and_scores(spark):
    rng = np.random.default_rng(5)
    rows = [(int(i), [float(x) for x in v], 0) for i, v in enumerate(rng.normal(size=(3000, 16)))]
    want = brute_nearest(rows)
    got = defaultdict(list)
    for r in N.nearest(vectors(spark, rows), block_bytes=200 * 128, centroids=8, part_bytes=7 * 128).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    assert set(got) == set(want)
    by_id = {i: np.array(v, dtype=np.float32).astype(float) for i, v, _ in rows}
    hits = 0
    for q, found in got.items():
        assert len(found) == 20 and q not in [i for i, _ in found]
        assert all(abs(by_id[q] @ by_id[i] - s) < 1e-9 for i, s in found)
        assert [s for _, s in found] == sorted((s for _, s in found), reverse=True)
        hits += len({i for i, _ in found} & {i for _, i in want[q]})
    assert hits / (20 * len(want)) >= 0.9
    whole = N.nearest(vectors(spark, rows[:400]), share=1.0, centroids=4).collect()
    exact = brute_nearest(rows[:400])
    assert {(r["query_id"], r["rank"]): r["vec_id"] for r in whole} == {(q, n + 1): i for q, f in exact.items() for n, (_, i) in enumerate(f)}


def test_cells_are_dealt_into_bounded_blocks():
    rng = np.random.default_rng(3)
    counts = rng.integers(0, 60, (8, 8)) * (rng.random((8, 8)) < 0.7)
    counts[3, 3] = 1000
    first, spread = N.dealt_cells(counts, 100)
    held = np.zeros(200)
    for n, f, s in zip(counts.ravel(), first, spread, strict=True):
        held[f : f + s] += n / s
    assert held.max() <= 200 and abs(held.sum() - counts.sum()) < 1e-6 and spread[3 * 8 + 3] == 10


def test_nearest_awkward(spark):
    rng = np.random.default_rng(6)
    plain = [(int(i), [float(x) for x in v], 0) for i, v in enumerate(rng.normal(size=(30, 16)))]
    odd = [(40, None, 0), (60, [0.0] * 16, 0), (80, [float("nan")] * 16, 0), (100, [1.0], 0), (120, [], 0), (None, [1.0] * 16, 0), (31, [None] + [1.0] * 15, 0), (32, [float("inf")] * 16, 0)]
    same = [(200 + i, plain[3][1], 0) for i in range(15)]  # ties
    rows = plain + odd + same
    got = {(r["query_id"], r["rank"]): r["vec_id"] for r in N.nearest(vectors(spark, rows), share=1.0, centroids=4).collect()}
    assert got == {(q, n + 1): i for q, f in brute_nearest(rows).items() for n, (_, i) in enumerate(f)}
    few = N.nearest(vectors(spark, plain[:5])).collect()
    assert [r["query_id"] for r in few] == [0] * 4
    assert N.nearest(vectors(spark, [])).count() == 0


def test_nearest_with_clashing_columns(spark):
    rng = np.random.default_rng(9)
    rows = [(int(i), [float(x) for x in v], 0) for i, v in enumerate(rng.normal(size=(60, 16)))]
    wide = vectors(spark, rows).withColumns({c: F.lit(7) for c in ("id", "vector", "i", "j", "block", "part", "js", "rank", "score", "query_id")})
    got = {(r["query_id"], r["rank"]): r["vec_id"] for r in N.nearest(wide, share=1.0, centroids=4).collect()}
    assert got == {(q, n + 1): i for q, f in brute_nearest(rows).items() for n, (_, i) in enumerate(f)}


def test_heap_walk_is_in_order():
    rng = np.random.default_rng(7)
    index = N.MultiIndex(rng.normal(size=(6, 4)), rng.normal(size=(5, 4)))
    index.counts[:] = rng.integers(0, 4, (6, 5))
    q = rng.normal(size=8)
    sums = sorted(((-float(index.first[i] @ q[:4] + index.second[j] @ q[4:]), i, j) for i in range(6) for j in range(5)))
    for wanted in (1, 7, 20, 10_000):
        want, n = set(), 0
        for _, i, j in sums:
            if n >= wanted:
                break
            if index.counts[i, j]:
                want.add((i, j))
                n += index.counts[i, j]
        assert {(i, j) for i, js in index.visit(q, wanted).items() for j in js} == want
