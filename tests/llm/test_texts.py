"""Operators that work on each text by itself."""

from __future__ import annotations

import hashlib
import random
import time
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from protomill.llm import jpeg_media as J
from protomill.llm import license_scan as L
from protomill.llm import quality_classifier as Q
from protomill.llm import sentencepiece_codec as S
from protomill.llm import token_counts as C
from protomill.llm.queries import vocabulary
from tests.llm.conftest import awkward_rows

TEXTS = [t or "" for _, t, *_ in awkward_rows()]
BITS = [" ", "  ", "\n", "\t", "a", "the", "é", "▁", "日本", "😀", "\x00", "<s>", "<|endoftext|>", "\u3000", "\u0301", " \u0301", "ﬁ", "ing", "don't 's", "\r\n", "12", "!!", "\x1c", "\x85", "\xa0", "ΑΣ"]


def noise(seed, n, most=40):
    rng = random.Random(seed)
    return ["".join(rng.choice(BITS) for _ in range(rng.randrange(most))) for _ in range(n)]


@pytest.fixture(scope="module")
def pieces():
    return S.Codec(vocabulary("piece_bpe_32k.model"))


def test_codec_equals_the_library(pieces):
    library = pieces.vocabulary.library
    texts = TEXTS + noise(1, 1500)
    for text, (n, ids, decoded) in zip(texts, pieces.run(texts), strict=True):
        want = library.encode(text, add_eos=True)
        assert ids == " ".join(map(str, want)) and n == len(want) and decoded == library.decode(want)


def test_codec_without_cuts_gives_the_same(pieces):
    texts = noise(2, 100)
    own = S.Codec(vocabulary("piece_bpe_32k.model"))
    own.vocabulary.cut_at_space = own.vocabulary.cut_at_line = False
    assert own.run(texts) == pieces.run(texts)


def test_decode_repairs_broken_bytes(pieces):
    v = pieces.vocabulary
    for raw in (b"\xff", b"\xe6\x97", b"\xf0\x9f\x98\x80a", b"\xe6\x97\xa5\xe6"):
        ids = [v.byte_id[b] for b in raw]
        assert v.decode(ids) == v.library.decode(ids)


def test_encode_decode_rows(spark, awkward, empty, clashing):
    path = vocabulary("piece_bpe_32k.model")
    got = S.encode_decode(awkward, path, ["doc_id"], texts=True).collect()
    assert len(got) == awkward.count()
    assert all(r["decoded_sha256"] == hashlib.sha256(r["decoded"].encode()).hexdigest() for r in got)
    assert {r["n_tokens"] for r in got if r["doc_id"] in (8, 9)} == {1}
    assert S.encode_decode(empty, path, ["doc_id"]).count() == 0
    assert S.encode_decode(clashing, path, clashing.columns).where("n_tokens <> 7").count() > 0


@pytest.mark.parametrize("name, rule", [("word_bpe_49k.json", "words"), ("byte_bpe_50k.json", "spaces"), ("piece_bpe_32k.model", "spaces")])
def test_counts_equal_the_library(name, rule):
    own = C.tokenizer(vocabulary(name))
    assert own.rule == rule
    texts = TEXTS + noise(3, 400)
    library = own.library
    want = [len(library.encode(t, add_special_tokens=False)) if name.endswith("json") else len(library.encode(t)) for t in texts]
    assert own.count(texts) == want
    assert [C.count_huge(t, own, 24, 4) for t in texts] == want
    assert [C.count_huge(t, own, 1000, 50) for t in texts[:16]] == want[:16]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_overlaps_widen_where_alignment_fails(name):
    own = C.tokenizer(vocabulary(name))
    count = lambda t: len(own.library.encode(t, add_special_tokens=False) if name.endswith("json") else own.library.encode(t))
    plain = "some words that tokenise well enough " * 20
    for text, wanted in (
        (plain, {"splice"}),
        (plain + "undelimited" * 8 + " " + plain, {"splice", "widen"}),  # the overlap of 16 lies inside a word of 88
        (plain + "x1" * 400 + " " + plain, {"splice", "widen", "grow"}),  # a word longer than a chunk
        ("y" * 700, {"widen", "grow"}),
    ):
        trace: list = []
        assert C.count_huge(text, own, 128, 16, trace) == count(text)
        assert set(trace) == wanted


def test_a_splice_needs_a_token_at_the_same_place_in_both_chunks():
    class Chunk:
        def __init__(self, starts):
            self.starts = starts

        def token_at(self, place):
            return self.starts.index(place) if place in self.starts else -1

    assert C.aligned_at(Chunk([0, 3, 9]), Chunk([4, 9]), [3, 4, 9], 4) == 9
    assert C.aligned_at(Chunk([0, 3]), Chunk([4]), [3, 4, 9], 4) == -1


def test_count_rows(awkward, empty, clashing):
    path = vocabulary("word_bpe_49k.json")
    got = C.count_tokens(awkward, path, ["doc_id"], limit=100, huge=700, chunk=512, overlap=16).collect()
    assert len(got) == awkward.count() and any(r["over_limit"] for r in got)
    assert {(r["n_bytes"], r["n_tokens"]) for r in got if r["doc_id"] in (8, 9)} == {(0, 0)}
    assert C.count_tokens(empty, path, ["doc_id"]).count() == 0
    assert C.count_tokens(clashing, path, ["doc_id", "n_tokens"]).columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]


def test_media_round_trip():
    for text, row in zip(TEXTS, J.media_rows(TEXTS), strict=True):
        payload = J.payload_of(text)
        assert len(payload) % 64 == 0 and payload.rstrip(b"\0") == text.encode().rstrip(b"\0")
        assert row[2] == hashlib.sha256(payload).hexdigest() and row[3] == zlib.crc32(payload[-64:])
    assert J.media_rows(["abc"]) == J.media_rows(["abc", ""])[:1]


def test_coefficients_of_any_kind_come_back():
    rng = np.random.default_rng(1)
    for blocks in (1, 2, 3, 4, 5, 9, 300):
        for share in (0.0, 0.02, 0.5, 1.0):
            raw = np.where(rng.random(64 * blocks) < share, rng.integers(0, 256, 64 * blocks), 128).astype(np.uint8).tobytes()
            ((frame, found),) = J.decode([J.write(raw)])
            assert J.read_payload(frame, found) == raw


def test_pieces_of_a_large_payload_join(monkeypatch):
    payload = np.random.default_rng(2).integers(0, 256, 64 * 40).astype(np.uint8).tobytes()
    whole = J.write(payload)
    monkeypatch.setattr(J, "PIECE_BYTES", 64 * 8)
    assert J.write(payload) == whole


def colour_file(width, height, seed=0):
    """A 4:2:0 file without restarts, written bit by bit, and its luminance DC values."""
    rng = np.random.default_rng(seed)
    dc_code, dc_len = J.DC_TABLE.encoder()
    ac_code, ac_len = J.AC_TABLE.encoder()
    wide, high = -(-width // 16), -(-height // 16)
    bits, last, luma = "", [0, 0, 0], np.zeros((2 * high, 2 * wide), dtype=int)
    for m in range(wide * high):
        for b, part in enumerate((0, 0, 0, 0, 1, 2)):
            dc = int(rng.integers(-90, 90))
            diff, last[part] = dc - last[part], dc
            size = abs(diff).bit_length()
            bits += f"{dc_code[size]:0{dc_len[size]}b}" + (f"{diff if diff > 0 else diff + (1 << size) - 1:0{size}b}" if size else "")
            bits += f"{ac_code[0xF0]:0{ac_len[0xF0]}b}" + f"{ac_code[0x32]:0{ac_len[0x32]}b}" + "10" + f"{ac_code[0]:0{ac_len[0]}b}"
            if part == 0:
                luma[2 * (m // wide) + b // 2, 2 * (m % wide) + b % 2] = dc
    bits += "1" * (-len(bits) % 8)
    data = int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\x00")
    tables = b"".join(bytes((kind,)) + bytes(t.counts) + bytes(t.symbols) for kind, t in ((0x00, J.DC_TABLE), (0x10, J.AC_TABLE)))
    frame = bytes((8, *height.to_bytes(2, "big"), *width.to_bytes(2, "big"), 3, 1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0))
    parts = (b"\xff\xd8", J._segment(0xDB, b"\0" + bytes([8] * 64)), J._segment(0xC4, tables), J._segment(0xC0, frame))
    return b"".join(parts) + J._segment(0xDA, bytes((3, 1, 0, 2, 0, 3, 0, 0, 63, 0))) + data + b"\xff\xd9", luma


def test_colour_files_and_several_at_once():
    made = [colour_file(40, 24, 1), colour_file(16, 16, 2), colour_file(33, 50, 3)]
    payload = J.write(J.payload_of("text between pictures"))
    found = J.decode([made[0][0], payload, made[1][0], made[2][0]])
    assert J.read_payload(*found[1]) == J.payload_of("text between pictures")
    for (_, luma), (frame, blocks) in zip(made, [found[0], *found[2:]], strict=True):
        grid = J.thumbnail(frame, blocks)
        assert grid.shape == (-(-frame.height // 8), -(-frame.width // 8))
        assert (grid == np.clip(luma + 128, 0, 255)[: grid.shape[0], : grid.shape[1]]).all()


@pytest.mark.parametrize("raw", [b"", b"no picture", J.write(bytes(64))[:200], J.write(bytes(64)).replace(b"\xff\xc0", b"\xff\xc2")])
def test_other_files_are_refused(raw):
    with pytest.raises((ValueError, IndexError)):
        J.decode([raw])


def test_media_rows(awkward, empty, clashing):
    got = J.media_columns(awkward, ["doc_id"], files=True).collect()
    assert len(got) == awkward.count()
    assert all(hashlib.sha256(r["media"]).hexdigest() == r["media_sha256"] and len(r["media"]) == r["media_bytes"] for r in got)
    assert J.media_columns(empty, ["doc_id"]).count() == 0
    assert J.media_columns(clashing, ["doc_id", "media"]).count() == awkward.count()


def brute_lcs(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def test_alignment_is_a_common_subsequence():
    rng = random.Random(3)
    for _ in range(300):
        a, b = ([rng.choice("abcdefgh") for _ in range(rng.randrange(12))] for _ in range(2))
        pairs = L.align(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(p < q and r < s for (p, r), (q, s) in zip(pairs, pairs[1:], strict=False))
        assert len(pairs) <= brute_lcs(a, b)
    assert len(L.align(list("abcdef"), list("abcdef"))) == 6


def test_longest_increasing():
    rng = random.Random(4)
    for _ in range(200):
        v = [rng.randrange(20) for _ in range(rng.randrange(12))]
        found = L.longest_increasing(v)
        assert all(v[i] < v[j] and i < j for i, j in zip(found, found[1:], strict=False))
        best = [1] * len(v)
        for i in range(len(v)):
            best[i] = 1 + max((best[j] for j in range(i) if v[j] < v[i]), default=0)
        assert len(found) == max(best, default=0)


def test_licenses_in_texts(awkward, empty):
    templates = L.read_templates()
    tokens = {n: L.words_of(t) for n, t in templates.items()}
    rng = random.Random(6)
    for name, text in templates.items():
        words = text.split()
        around = ["the", "of", "under", "license", "word"] * 300
        rng.shuffle(around)
        assert L.scan(" ".join([*around[:700], *words, *around[700:]]), tokens, 0.8)[:2] == (name, 1.0)
        twice = L.scan(" ".join([*words, "x", *words]), tokens, 0.8)
        assert twice[:2] == (name, 1.0)
        if len(words) < 1000:  # a word put in after each of its words
            spread = [x for w in words for x in (w, rng.choice(["foo", "the", "license"]))]
            assert L.scan(" ".join(spread), tokens, 0.8)[1] >= 0.8, name
    assert L.scan("the license is under this", tokens, 0.8) == (None, 0.0, -1, -1, [])
    both = L.scan(templates["MIT-text"] + " and a word " + templates["GPL-3.0-header"], tokens, 0.8)
    assert both[:2] == ("MIT-text", 1.0) and {"MIT-text", "GPL-3.0-header"} <= set(both[4])
    got = {(r["doc_id"], r["license"]) for r in L.scan_licenses(awkward, ["doc_id"]).collect()}
    assert {(14, "Apache-2.0"), (15, "MIT"), (8, None), (9, None)} <= got
    assert L.scan_licenses(empty, ["doc_id"]).count() == 0
    wide = awkward.withColumns({c: F.lit(7) for c in ("license", "coverage", "licenses", "first_word")})
    again = L.scan_licenses(wide, wide.columns)
    assert len(set(again.columns)) == len(again.columns) and {(r["doc_id"], r["license"]) for r in again.collect()} == got


def noisy_texts(template, n, seed):
    """Texts with one to four copies of a template, with words lost, changed and put in, between words of its own."""
    rng = random.Random(seed)
    words = L.words_of(template)
    for _ in range(n):
        out = []
        for _ in range(rng.randrange(1, 5)):
            out += [rng.choice([*words, "x", "y"]) for _ in range(rng.randrange(30))]
            for w in words:
                if rng.random() > 0.15:
                    out.append(w)
                if rng.random() < 0.12:
                    out.append(rng.choice([*words, "x", "y", "z"]))
        yield out


def test_license_rich_texts_take_bounded_work():
    """20,000 words of licenses: a few times what other words take."""
    tokens = {n: L.words_of(t) for n, t in L.read_templates().items()}
    rng = random.Random(9)
    every = [w for t in tokens.values() for w in t]
    words = [rng.choice(every) for _ in range(20_000)]
    began = time.process_time()
    L.scan(" ".join(words), tokens, 0.8)
    assert time.process_time() - began < 3


@pytest.mark.parametrize("template", ["Licensed under the Apache License, Version 2.0.", "the work of the user is under the license of the work and the user"])
def test_licenses_equal_exhaustive_windows(template):
    """Of all windows of any length that are dense enough, none aligns better than the one found; what is found is aligned as said."""
    its = L.words_of(template)
    for words in noisy_texts(template, 12, 12):
        windows = ((b - a, len(L.align(words[a:b], its))) for a in range(len(words)) for b in range(a + 1, len(words) + 1))
        best = max((n for length, n in windows if n >= L.DENSITY * length), default=0) / len(its)
        where = {}
        for i, w in enumerate(words):
            where.setdefault(w, []).append(i)
        coverage, first, last = L.best_window(words, where, its, 0.8)
        assert coverage == (best if best >= 0.8 else 0.0)
        assert not coverage or (words[first] in its and words[last] in its)


def junk_and_prose(n=300):
    rng = random.Random(8)
    rows = []
    for i in range(n):
        words = ["".join(rng.choice("aeioustrnl") for _ in range(rng.randrange(2, 9))) for _ in range(rng.randrange(5, 200))]
        bad = i % 4 == 0
        rows.append((i, " ".join(w.upper() + "!!" for w in words) if bad else " ".join(words), "en", "s", 1, int(not bad)))
    return rows


def test_classifier_learns_from_the_middle_of_texts(spark):
    """Labels that only the middle of a text shows, over 2,500 characters from both ends."""
    rng = random.Random(23)
    prose = lambda n: "".join(rng.choice("etaoin shrdlu") for _ in range(n))
    junk = lambda n: "".join(rng.choice("#@~|=+") for _ in range(n))
    rows = [(i, prose(2600) + (prose if i % 2 else junk)(2600) + prose(2600), i % 2) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    net = Q.train(docs.select("doc_id", "text"), docs.select("doc_id", "quality"))
    held = docs.where(Q.held_out(F.col("doc_id")))
    got = Q.score(held, net, ["quality"]).collect()
    assert len(got) > 20 and all(r["predicted"] == r["quality"] for r in got)


def test_classifier(spark, awkward, empty):
    rows = junk_and_prose()
    docs = spark.createDataFrame([r[:5] for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(r[0], r[5], 0) for r in rows], "doc_id long, quality int, toxic int")
    net = Q.train(docs, labels)
    got = {r["doc_id"]: r for r in Q.score(docs, net, ["doc_id"]).collect()}
    test = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert np.mean([got[r[0]]["predicted"] == r[5] for r in test]) > 0.95
    odd = Q.score(awkward, net, ["doc_id"]).collect()
    assert len(odd) == awkward.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in odd)
    assert Q.score(empty, net, ["doc_id"]).count() == 0
    untrained = Q.train(docs, labels.limit(0))
    assert 0 <= Q.score_all(untrained, untrained.pairs(), [b""])[0] <= 1


def test_scores_do_not_depend_on_batches():
    rows = junk_and_prose(40)
    texts = [r[1].encode() for r in rows] + [b"", b"long " * 60_000]
    net = Q.fit(texts[:40], np.array([r[5] for r in rows]), epochs=2)
    pairs = net.pairs()
    together = Q.score_all(net, pairs, texts)
    assert np.allclose(together, [Q.score_all(net, pairs, [t])[0] for t in texts], atol=1e-6)
    # against the definition: every place of every chunk, filter by filter
    data = Q.padded(texts[3])
    logits = []
    places = len(data) - Q.WIDTH + 1
    for at in range(0, places, Q.CHUNK):
        n = min(Q.CHUNK, places - at)
        response = sum(net.bytes_[i][data[at + i : at + i + n]] for i in range(Q.WIDTH))
        hidden = np.append(np.maximum(response.max(0) + net.bias, 0), n / Q.CHUNK)
        logits.append(hidden @ net.out + net.out_bias)
    assert abs(together[3] - 1 / (1 + np.exp(-np.mean(logits)))) < 1e-5


def test_held_out_rule(spark):
    got = spark.range(50).select("id", Q.held_out(F.col("id")).alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 5 == 0) for r in got)


def test_classifier_on_held_out_documents(spark):
    """The labels of sf0.01 that nothing is learnt from."""
    folder = "/root/testdata/sf0.01"
    if not Path(folder).exists():
        pytest.skip("the tables are not here")
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    odd = docs.withColumns({c: F.lit(7) for c in ("score", "predicted", "quality", "__data", "__k", "__at", "__part")})
    net = Q.train(odd, labels)
    got = Q.score(odd, net, ["doc_id"]).join(labels, "doc_id").where(Q.held_out(F.col("doc_id"))).select("quality", "predicted").collect()
    assert len(got) > 50 and sum(r["quality"] == r["predicted"] for r in got) >= 0.95 * len(got)
    assert sum(r["predicted"] for r in got if r["quality"]) >= 0.98 * sum(r["quality"] for r in got)
