"""Tables with the awkward cases: nulls, empty and long texts, repeated rows, clashing columns."""

from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng: random.Random, words: int) -> str:
    return " ".join("".join(rng.choice("aeioustrnl") for _ in range(rng.randrange(2, 9))) for _ in range(words))


def awkward_rows() -> list[tuple]:
    rng = random.Random(5)
    passage = prose(rng, 60)
    base = prose(rng, 300)
    words = base.split()
    near = " ".join([*words[:150], "changed", *words[151:]])
    texts = [
        base,
        near,
        base,
        prose(rng, 100) + " " + passage + " " + prose(rng, 40),
        passage + "\n" + prose(rng, 90),
        prose(rng, 34),
        prose(rng, 35),
        "same " * 120,
        "",
        None,
        " \t\n ",
        "é ß 日本 😀 \x00 ▁ <s> <|endoftext|>",
        "x" * 5000,
        prose(rng, 12_000),
        "Licensed under the Apache License, Version 2.0.",
        prose(rng, 20) + " Released under the MIT License. " + prose(rng, 20),
    ]
    rows = [(i, t, "en", f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    rows.append(rows[3])  # a row that repeats
    rows.append((None, base, None, None, None))
    rows.append((5, "another text under an id that repeats", "de", "src1", 1))
    return rows


@pytest.fixture(scope="session")
def awkward(spark):
    return spark.createDataFrame(awkward_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(spark, awkward):
    """More columns, with names that operators use themselves."""
    from pyspark.sql import functions as F

    names = ["n_tokens", "score", "predicted", "f0", "d", "k", "at", "n", "g", "block", "slot", "kept_text", "n_words", "component_id", "__x", "rank", "media"]
    return awkward.withColumns({c: F.lit(7) for c in names})
