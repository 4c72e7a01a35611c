"""The pipeline and the queries of the subpackage."""

from __future__ import annotations

import random
from pathlib import Path

import numpy as np
import pytest

import corpus_pipeline
from protomill.llm import queries as Q
from protomill.llm import simhash_dedup
from protomill.llm.queries import SOURCE_WEIGHTS
from protomill.llm.source_mixing import mix
from tests.llm.conftest import prose
from tests.llm.test_tables import brute_dedup

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="the tables are not here")


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    out = [("documents", docs)]
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, FOLDER).cache()
        out.append((name, docs))
    return dict(out)


def test_columns(stages):
    first = stages["documents"].dtypes
    for name in list(stages)[1:-1]:
        assert stages[name].dtypes == first


def test_each_stage_takes_effect(spark, stages):
    sizes = {k: v.count() for k, v in stages.items()}
    assert sizes["documents"] > sizes["quality"] > sizes["near_duplicates"] == sizes["repeated_passages"] == sizes["mixture"] == sizes["tokens"]
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    good = labels.where("quality = 1").join(stages["documents"], "doc_id").count()
    kept = labels.where("quality = 1").join(stages["quality"], "doc_id").count()
    assert kept >= 0.98 * good


def test_exact_copies_go_and_passages_too(stages):
    texts = [r["text"] for r in stages["near_duplicates"].collect()]
    assert len(set(texts)) == len(texts)
    before = {r["doc_id"]: r["text"] for r in stages["near_duplicates"].collect()}
    after = {r["doc_id"]: r["text"] for r in stages["repeated_passages"].collect()}
    ids = list(before)
    for i, (n, removed, _) in zip(ids, brute_dedup([before[i] for i in ids]), strict=True):
        assert len(after[i].split()) == n - removed and (removed or after[i] == before[i])


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_near(texts):
    """The least index that each text's links of Jaccard similarity 0.8 or more lead to."""
    sets = [shingle_set(t) for t in texts]
    label = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if label[i] != label[j] and 5 * len(a & b) >= 4 * len(a | b):
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    return label


@pytest.mark.parametrize("block_nodes", [7, 2048])
def test_near_duplicates_are_those_of_exact_similarity(spark, monkeypatch, block_nodes):
    monkeypatch.setattr(simhash_dedup, "BLOCK_NODES", block_nodes)
    rng = random.Random(17)
    texts = ["", None, " \n", "one two", "ONE two", "one two three"]
    for size in (8, 9, 13, 16, 20, 40, 150, 400):
        for _ in range(6):
            words = prose(rng, size).split()
            texts.append(" ".join(words))
            texts.append(" ".join(words[: max(1, size * 4 // 5 + rng.randrange(3))]))  # a prefix, near the bound
            copy = list(words)
            for at in rng.sample(range(size), max(1, size // 45)):
                copy[at] = "changed"  # each takes five shingles away
            texts.append(" ".join(copy))
    base = prose(rng, 60).split()
    texts += [" ".join(base), " ".join(base * 3), " ".join([*base, *base[:56], *base])]  # repeated lines
    group = prose(rng, 100).split()
    for _ in range(40):  # below the bar to each other, and candidates nearly all
        copy = list(group)
        for at in rng.sample(range(100), 3):
            copy[at] = prose(rng, 1)
        texts.append(" ".join(copy))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    want = {i for i, low in enumerate(brute_near(texts)) if i == low}
    assert {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()} == want


def test_near_duplicates_come_from_the_tree(spark, monkeypatch):
    """Without minima, the tree alone finds copies of few differing bits, also those with equal fingerprints and other sets."""
    monkeypatch.setattr(simhash_dedup, "shared_bands", lambda nodes: nodes.select(nodes["n"].alias("a"), nodes["n"].alias("b")).limit(0))
    rng = random.Random(29)
    rows = []
    for i in range(0, 300, 3):
        words = prose(rng, 600).split()
        rows += [(i, " ".join(words)), (i + 1, " ".join([*words, "more"])), (i + 2, " ".join(words[:598]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    one = {i: simhash_dedup.fingerprint(np.unique(simhash_dedup.shingle_hashes(t, 5)))[0] for i, t in rows}
    apart = lambda a, b: ((one[a] ^ one[b]) & (1 << 64) - 1).bit_count()
    near = [i for i, _ in rows if i % 3 == 0 and max(apart(i, i + 1), apart(i, i + 2)) <= simhash_dedup.TREE_BITS]
    assert len(near) > 80 and any(one[i] == one[i + 1] for i in near)
    kept = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()}
    assert kept >= {i for i, _ in rows if i % 3 == 0} and not kept & {i + k for i in near for k in (1, 2)}


def test_rows_that_repeat_or_share_an_id_lose_no_text(spark, tmp_path):
    """Two equal rows under an id, two without an id, one text under two ids, and another text under one of these."""
    rng = random.Random(23)
    a, b, c, d = (prose(rng, 100) for _ in range(4))
    rows = [(1, a), (1, a), (None, b), (None, b), (3, c), (7, c), (7, d)]
    docs = spark.createDataFrame([(i, t, "en", "src0", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    for stage in (corpus_pipeline.near_duplicates, corpus_pipeline.repeated_passages):
        docs = stage(spark, docs, "")
        got = sorted(((r["doc_id"] or 0, r["text"]) for r in docs.collect()))
        assert got == sorted([(1, a), (0, b), (3, c), (7, d)])


def test_bands_find_pairs_at_the_bound():
    """Of 400 pairs of sets at similarity 0.8, all share a band; unrelated sets share none."""
    import numpy as np

    rng = np.random.default_rng(2)
    met = other = 0
    for _ in range(400):
        both, x, y = (rng.integers(0, 1 << 63, n, dtype=np.uint64) for n in (160, 20, 20))
        one, two = (set(keys_of(np.concatenate((both, z)))) for z in (x, y))
        met += bool(one & two)
        other += bool(one & set(keys_of(rng.integers(0, 1 << 63, 180, dtype=np.uint64))))
    assert met == 400 and other == 0


def keys_of(hashes):
    return simhash_dedup.band_keys(hashes).tolist()


def test_mixture_keeps_every_row(stages):
    key = lambda df: sorted((r["doc_id"], r["text"]) for r in df.collect())
    assert key(stages["mixture"]) == key(stages["repeated_passages"])


@pytest.mark.parametrize("kept", ["stored", "cached"])
def test_tokens_return_the_place_in_the_mixture(spark, stages, tmp_path, kept):
    """Also where readers pack large files first, which turns the order of the files around."""
    docs = stages["repeated_passages"]
    mixed = mix(docs, SOURCE_WEIGHTS, tie_cols=["text"]).orderBy("slot", "position").collect()
    want = [(r["doc_id"], r["source"]) for r in mixed]
    rows = corpus_pipeline.mixture(spark, docs, FOLDER)
    if kept == "stored":
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        rows.write.parquet(str(tmp_path / "mixture"))
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        rows = spark.read.parquet(str(tmp_path / "mixture"))
        assert len(rows.inputFiles()) > 1
    else:
        rows = rows.cache()
    got = corpus_pipeline.tokens(spark, rows, FOLDER).collect()
    assert sorted(r["place"] for r in got) == list(range(len(want)))
    assert [(r["doc_id"], r["source"]) for r in sorted(got, key=lambda r: r["place"])] == want


def test_awkward_tables(spark, awkward, clashing, empty, tmp_path):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    for docs in (awkward, clashing, empty):
        rows = docs
        for name, stage in corpus_pipeline.STAGES:
            path = str(tmp_path / f"{name}-{len(docs.columns)}-{docs.count()}")
            stage(spark, rows, str(tmp_path)).write.parquet(path)
            rows = spark.read.parquet(path)
            if name != "tokens":
                assert rows.columns == docs.columns


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    ours = Q.queries()[name](spark, FOLDER)
    theirs = con.sql(Q.oracle_sql()[name])
    names = sorted(ours.columns)
    assert names == sorted(theirs.columns)
    show = lambda rows, cols: sorted(tuple(str(r[cols.index(n)]) for n in names) for r in rows)
    assert show(ours.collect(), ours.columns) == show(theirs.fetchall(), theirs.columns)


def test_all_queries_are_registered():
    names = list(Q.queries())
    assert [n.split("_")[0] for n in names[:13]] == [f"op{i}" for i in range(1, 14)] and names[13] == "pipeline"
