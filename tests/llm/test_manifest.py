"""Merkle manifest: brute force, rounds of reduction, proofs."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from protomill.llm import merkle_manifest as M
from protomill.llm import queries as Q


def h(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row: tuple, text) -> str:
    doc_id, _, lang, source, n_chars = row
    return h(*["-" if x is None else f"{len(str(x).encode())}:{x}" for x in (doc_id, source, lang, n_chars, text)])


def grow(leaves: list[str]) -> tuple[str, list[list[tuple[str, str]]]]:
    """The top, and for each leaf what stands left and right of it, level by level; by the definition, a leaf at a time."""
    steps: list[list[tuple[str, str]]] = [[] for _ in leaves]
    level, of = leaves, list(range(len(leaves)))
    while len(level) > 1:
        for i, at in enumerate(of):
            run = level[at - at % 8 : at - at % 8 + 8]
            steps[i].append(("".join(run[: at % 8]), "".join(run[at % 8 + 1 :])))
        level = [h(*level[i : i + 8]) for i in range(0, len(level), 8)]
        of = [at // 8 for at in of]
    return level[0], steps


def brute_force(rows: list[tuple]) -> list[tuple]:
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees = {lang: sorted((r for r in rows if r[2] == lang), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1]))) for lang in langs}
    grown = {lang: grow([leaf(r, r[1]) for r in some]) for lang, some in trees.items()}
    root, upper = grow([grown[lang][0] for lang in langs])
    out = []
    for lang, above in zip(langs, upper, strict=True):
        for r, steps in zip(trees[lang], grown[lang][1], strict=True):
            path = [*steps, *above]
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[1] is not None
            text = "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1]) if tampered else r[1]
            now = leaf(r, text)
            for before, after in path:
                now = h(before, now, after)
            out.append((r[0], leaf(r, r[1]), grown[lang][0], root, h(*[b + a for b, a in path]), now, now == root))
    return sorted(out, key=str)


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def many_rows(n: int, langs: list, seed: int) -> list[tuple]:
    rng = random.Random(seed)
    return [(i * 7 % n, rng.choice(["Some Text", "ÄÖ É", "", None, "x" * 50]) and f"Word {i} ÄÖ", rng.choice(langs), rng.choice(["a", None]), i) for i in range(n)]


def test_query_equals_brute_force(spark, awkward, tmp_path):
    awkward.coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    found = Q.op11_merkle_manifest(spark, str(tmp_path)).collect()
    want = brute_force([tuple(r) for r in awkward.collect()])
    assert sorted(map(tuple, found), key=str) == want
    assert {r["verified"] for r in found} == {True, False}


@pytest.mark.parametrize("n, langs, levels, top", [(700, ["de", "en", None, ""], 4, 4096), (700, ["de", "en"], 1, 4), (90, [f"l{i}" for i in range(40)], 1, 3), (1, ["en"], 4, 4096), (8, ["en"], 1, 1), (65, ["en"], 1, 2)])
def test_rounds_equal_brute_force(spark, n, langs, levels, top):
    rows = many_rows(n, langs, n)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    leaves = docs.select("doc_id", "lang", M.leaf_digest(*[F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]).alias("leaf"))
    made = M.manifest(leaves, ["doc_id"], levels=levels, top=top)
    found = made.select("doc_id", "leaf", "subroot", "root", M.proof_digest(F.col("proof")).alias("p"), M.fold(F.col("leaf"), F.col("proof")).alias("f")).collect()
    want = [w[:5] + (w[3],) for w in brute_force(rows)]
    assert sorted(map(tuple, found), key=str) == sorted(want, key=str)


def test_rows_that_share_an_id_have_places_of_their_own(spark):
    rows = [(1, "same", "en", None, 4)] * 30 + [(1, f"other {i}", "en", None, 4) for i in range(30)] + [(None, "x", None, None, None)] * 9
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    leaves = docs.select("doc_id", "lang", M.leaf_digest(*[F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]).alias("leaf"))
    found = M.manifest(leaves, ["doc_id"], levels=1, top=5).select("doc_id", "leaf", "subroot", "root", M.proof_digest(F.col("proof")).alias("p")).collect()
    assert sorted(map(tuple, found), key=str) == sorted([w[:5] for w in brute_force(rows)], key=str)


def test_a_change_anywhere_is_seen(spark):
    docs = spark.createDataFrame(many_rows(50, ["en"], 3), SCHEMA)
    leaves = docs.select("doc_id", "lang", M.leaf_digest(F.col("doc_id"), F.col("text")).alias("leaf"))
    made = M.manifest(leaves, ["doc_id"])
    wrong = made.select(M.fold(F.sha2(F.concat("leaf", F.lit("x")), 256), F.col("proof")).alias("f"), "root").where("f = root")
    assert not wrong.count()


def test_awkward_tables(empty, clashing):
    leaves = lambda docs: docs.withColumn("leaf", M.leaf_digest(F.col("doc_id"), F.col("text")))
    assert M.manifest(leaves(empty), ["doc_id"]).collect() == []
    kept = [c for c in clashing.columns if c not in ("text", "leaf")]
    out = M.manifest(leaves(clashing), kept)
    assert out.columns == [c for c in kept if c not in ("leaf", "subroot", "root", "proof")] + ["leaf", "subroot", "root", "proof"]
    assert out.count() == clashing.count()
