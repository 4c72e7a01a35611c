"""Cross-tokenizer alignment against a brute force with the libraries on whole texts."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import public_tokenizers as P
import pytest

from protomill.llm import queries as Q
from protomill.llm import tokenizer_alignment as A

JSON, MODEL = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def aligner():
    return A.Aligner(JSON, MODEL)


def whole(text: str | None, own: A.Aligner) -> list[tuple[list[int], list[int]]]:
    """Groups of a whole text, by the libraries and the definition."""
    if not text:
        return []
    a, b = own.first.encode(" " + text, add_special_tokens=False).ids, own.second.library.encode(text)
    one, other = [own.bytes_a[i] for i in a], [own.bytes_b[i] for i in b]
    if not b"".join(one) == b"".join(other) == (" " + text).encode():
        return []
    ends = [{sum(map(len, x[: i + 1])): i for i in range(len(x))} for x in (one, other)]
    groups, i, j = [], 0, 0
    for end in sorted(ends[0].keys() & ends[1].keys()):
        groups.append((a[i : ends[0][end] + 1], b[j : ends[1][end] + 1]))
        i, j = ends[0][end] + 1, ends[1][end] + 1
    return groups


def brute_force(texts: list[str | None], own: A.Aligner) -> list[tuple]:
    groups = [whole(t, own) for t in texts]
    links = [[(x, y) for a, b in g for x in a for y in b] for g in groups]
    count = Counter(pair for some in links for pair in set(some))
    most: dict[int, int] = {}
    for (a, _), n in count.items():
        most[a] = max(most.get(a, 0), n)
    out = []
    for g, some in zip(groups, links, strict=True):
        written = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
        best = sum(count[p] == most[p[0]] for p in some)
        digest = hashlib.sha256(written.encode()).hexdigest() if written else ""
        out.append((sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), len(some), best, sum(count[p] for p in some), digest))
    return out


def hostile(rng: random.Random) -> str:
    parts = ["a", "the", " ", "  ", "\n", "\n\n", "\t", "don't", "'s", "é", "日本", "😀", "ﬁ", "\x00", "\x1c", "\x85", " ", "᠎", "<s>", "</s>", "<0x41>", "<unk>", "<|endoftext|>", "1234", "...", "x" * 30, "ingly", "▁", "Ünïcode", "_", "\r\n"]
    return "".join(rng.choice(parts) + rng.choice(["", "", " ", "\n"]) for _ in range(rng.randrange(1, 12)))


def test_pieces_equal_whole_texts(aligner):
    rng = random.Random(11)
    seen = 0
    for _ in range(60):
        texts = [hostile(rng) for _ in range(50)]
        found = A.Batch(aligner, texts)
        for i, text in enumerate(texts):
            want = whole(text, aligner)
            written = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in want)
            assert found.digests[i] == (hashlib.sha256(written.encode()).hexdigest() if want else ""), text
            assert bool(want) == ("▁" not in text)
            assert [t[i] for t in found.totals] == [sum(len(a) for a, _ in want), sum(len(b) for _, b in want), len(want), sum(len(a) * len(b) for a, b in want)]
            seen += len(want) > 0
    assert seen > 2000


def test_byte_letters_are_a_bijection():
    letters = A.byte_letters()
    assert sorted(letters.values()) == list(range(256)) and letters["Ġ"] == 32 and letters["Ċ"] == 10


@pytest.mark.parametrize("size, memory", [(16 << 20, 250_000), (200, 250_000), (200, 5)])
def test_documents_equal_brute_force(spark, monkeypatch, aligner, size, memory):
    monkeypatch.setattr(A, "SLICE_BYTES", size)
    monkeypatch.setattr(A, "MEMORY_PIECES", memory)
    rng = random.Random(5)
    words = ["the", "antidisestablishment", "résumé", "naïve", "tokenizer", "qzxv", "Ünder", "ing", "don't", "1999", "日本語"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 40))) for _ in range(60)] + [hostile(rng) for _ in range(60)]
    texts += [None, "", "▁", " ", "x" * 3000, texts[0], texts[0], "\n", "a\nb"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found = {r[0]: tuple(r)[1:] for r in A.align(docs, JSON, MODEL, ["doc_id"]).collect()}
    for i, want in enumerate(brute_force(texts, aligner)):
        assert found[i] == want, texts[i]


def test_a_pair_in_several_groups_of_a_document_counts_once(spark, aligner):
    texts = ["tokenizer tokenizers retokenizer", "tokenizer", "the the the"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r[0]: tuple(r)[1:] for r in A.align(docs, JSON, MODEL, ["doc_id"]).collect()}
    assert [found[i] for i in range(3)] == brute_force(texts, aligner)


def test_query_and_awkward_tables(spark, awkward, empty, clashing, aligner, tmp_path):
    awkward.write.parquet(f"{tmp_path}/documents.parquet")
    rows = awkward.select("doc_id", "text").collect()
    want = [(r[0], *w) for r, w in zip(rows, brute_force([r[1] for r in rows], aligner), strict=True)]
    assert sorted(map(tuple, Q.op13_tokenizer_alignment(spark, str(tmp_path)).collect()), key=str) == sorted(want, key=str)
    assert A.align(empty, JSON, MODEL, ["doc_id"]).collect() == []
    kept = [c for c in clashing.columns if c != "text"]
    out = A.align(clashing, JSON, MODEL, kept)
    assert out.count() == clashing.count() and out.columns[-7:] == ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
