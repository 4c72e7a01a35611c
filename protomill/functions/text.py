"""Scalar functions on text columns: normalising, cutting, counting and classifying."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(c: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once; what a lambda mentions from outside is computed for each element."""
    return F.get(F.transform(F.array(c), use), 0)


def normalize(c: Column) -> Column:
    """White space of any kind (no-break spaces too) to single spaces, trimmed; null to empty."""
    return F.coalesce(F.trim(F.regexp_replace(c, r"(?U)\s+", " ")), F.lit(""))


def search_key(c: Column, fold_micro: bool = True) -> Column:
    """Lower case with everything but a-z and 0-9 to single spaces; micro sign and mu count as u if asked for."""
    low = F.lower(F.coalesce(c, F.lit("")))
    if fold_micro:
        low = F.translate(low, "µμ", "uu")
    return F.trim(F.regexp_replace(low, "[^a-z0-9]+", " "))


def source_of_id(c: Column) -> Column:
    """What stands before the first colon, or ``unknown``."""
    prefix = F.split_part(c, F.lit(":"), F.lit(1))
    return F.when(F.contains(c, F.lit(":")) & (prefix != ""), prefix).otherwise(F.lit("unknown"))


def compact(c: Column, limit: int, exact: bool = False) -> Column:
    """White space collapsed and the text cut with an ellipsis.

    By default the cut falls at ``limit`` - 1 characters, so the result may be two longer than the limit; ``exact`` keeps to it.
    """
    x = normalize(c)
    kept = limit - 3 if exact else limit - 1
    return F.when(F.length(x) <= limit, x).otherwise(F.concat(F.rtrim(F.left(x, F.lit(kept))), F.lit("...")))


def term_hits(text: Column, terms: Column) -> Column:
    """How many of an array of terms occur in the text, as substrings."""
    return F.size(F.filter(terms, lambda t: F.contains(text, t)))


def search_terms(aliases: Column, name: Column, group: Column) -> Column:
    """Distinct normalised terms of an asset in first-seen order: aliases, name, group, and the group's words.

    Terms under four characters go, but for ``pcr``.
    """
    raw = F.concat(aliases, F.array(name, F.replace(group, F.lit("_"), F.lit(" "))), F.split(group, "_"))
    keys = F.array_distinct(F.transform(raw, lambda t: search_key(t, fold_micro=False)))
    return F.filter(keys, lambda t: (F.length(t) >= 4) | (t == "pcr"))


def number_mentions(c: Column) -> Column:
    return F.size(F.regexp_extract_all(c, F.lit(r"([-+]?\d+(?:\.\d+)?)"), F.lit(1)))


_PLAIN_WORDS = re.compile(r"(?:\\b)?[a-z][a-z ]*(?:\\b)?(?:\|(?:\\b)?[a-z][a-z ]*(?:\\b)?)*")


def guarded(pattern: str) -> str:
    """A pattern that is found where ``pattern`` is; alternatives of plain words are tried only at their first letters, once for all with a boundary before them."""
    if not _PLAIN_WORDS.fullmatch(pattern):
        return pattern
    words = pattern.split("|")
    starts = [[w.removeprefix(r"\b") for w in words if w.startswith(r"\b") is bound] for bound in (True, False)]
    return "|".join(f"(?=[{''.join(sorted({w[0] for w in some}))}]){bound}(?:{'|'.join(some)})" for some, bound in zip(starts, (r"\b", ""), strict=True) if some)


def families(c: Column, patterns: dict[str, str]) -> Column:
    """The families whose pattern occurs in the lower-cased text, in the order of the names."""
    return let(F.lower(c), lambda low: F.array_compact(F.array(*[F.when(low.rlike(guarded(patterns[f])), F.lit(f)) for f in sorted(patterns)])))


def is_generic_step(c: Column, headings: str, shortest: int = 18) -> Column:
    """Too short, or nothing but a heading."""
    low = F.lower(F.trim(c))
    return (F.length(low) < shortest) | low.rlike(headings)


def has_cjk(c: Column) -> Column:
    return c.rlike("[\\u3400-\\u4dbf\\u4e00-\\u9fff\\u3000-\\u303f\\uff00-\\uffef]")


def slug(c: Column) -> Column:
    """Lower case with runs of other characters to underscores, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), "^_+|_+$", "")


#: Characters of the named entities, as HTML 4 lists them, and the apostrophe's of XML.
ENTITIES = {name: chr(code) for name, code in name2codepoint.items()} | {"apos": "'"}
_REFERENCE = r"(&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);)"


def _character(reference: Column) -> Column:
    """What a reference such as ``&mu;``, ``&#956;`` or ``&#x3bc;`` stands for; itself if that isn't known."""
    hexadecimal = F.conv(F.regexp_extract(reference, "^&#[xX]([0-9a-fA-F]+);", 1), 16, 10).cast("long")
    number = F.coalesce(F.regexp_extract(reference, "^&#([0-9]+);", 1).try_cast("long"), hexadecimal)
    drawn = let(number, lambda n: F.when(n.between(1, 0xD7FF) | n.between(0xE000, 0x10FFFF), F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")))
    named = F.try_element_at(F.from_json(F.lit(json.dumps(ENTITIES)), "map<string,string>"), F.substring(reference, F.lit(2), F.length(reference) - 2))
    return F.coalesce(named, drawn, reference)


def unescape(c: Column) -> Column:
    """Character references to characters, each once: ``&amp;lt;`` becomes ``&lt;``."""

    def resolved(text: Column) -> Column:
        found = F.array_distinct(F.regexp_extract_all(text, F.lit(_REFERENCE), F.lit(1)))
        others = F.filter(F.transform(found, lambda r: F.struct(r.alias("r"), _character(r).alias("c"))), lambda x: x["c"] != "&")
        return F.regexp_replace(F.aggregate(others, text, lambda t, x: F.replace(t, x["r"], x["c"])), "&(?:amp|#0*38|#[xX]0*26);", "&")

    return let(c, lambda text: F.when(F.contains(text, F.lit("&")), resolved(text)).otherwise(text))


def strip_tags(c: Column) -> Column:
    """Tags to spaces, entities to characters, white space collapsed."""
    return normalize(unescape(F.regexp_replace(F.coalesce(c, F.lit("")), "<[^>]+>", " ")))


def qc_score(reagents: Column, equipment: Column, steps: Column, troubleshooting: Column, timing: Column, abstract: Column) -> Column:
    """Completeness of a protocol from counts and presence, 0 to 1, rounded to three places."""
    share = lambda x, full: F.least(x / F.lit(float(full)), F.lit(1.0))
    there = lambda x, weight: F.when(x, F.lit(weight)).otherwise(F.lit(0.0))
    score = 0.3 * share(reagents, 10) + 0.2 * share(equipment, 3) + 0.3 * share(steps, 20)
    return F.round(score + there(troubleshooting, 0.1) + there(timing, 0.05) + there(abstract, 0.05), 3)


def numeric_step(value: Column) -> Column:
    """By how much a whole number is changed to make a near miss."""
    size = F.abs(value)
    return F.when(size >= 1000, F.lit(100)).when(size >= 100, F.lit(10)).otherwise(F.lit(1))


def decimal_step(value: Column) -> Column:
    """As numeric_step(), for numbers with decimals."""
    size = F.abs(value)
    return F.when(size >= 100, F.lit(10.0)).when(size >= 10, F.lit(1.0)).when(size >= 1, F.lit(0.5)).otherwise(F.lit(0.1))


def perturbed(value: Column, step: Column, variant: Column) -> Column:
    """Even variants subtract the step and odd ones add it; what would be zero or less is added to instead."""
    lower = value - step
    return F.when((variant % 2 == 0) & (lower > 0), lower).otherwise(value + step)


def numbers_agree(a: Column, b: Column, relative: float = 0.1, absolute: float = 1e-6) -> Column:
    """Within a tenth of the larger magnitude."""
    return F.abs(a - b) <= F.greatest(F.lit(relative) * F.greatest(F.abs(a), F.abs(b)), F.lit(absolute))


def data_url(content: Column, path: Column) -> Column:
    """``data:`` URL of a file's bytes, by suffix; null for other suffixes.  base64() breaks lines after 76 characters, which a URL must not."""
    suffix = F.lower(F.regexp_extract(path, r"\.([A-Za-z]+)$", 1))
    kind = F.when(suffix == "png", "image/png").when(suffix.isin("jpg", "jpeg"), "image/jpeg").when(suffix == "webp", "image/webp")
    return F.concat(F.lit("data:"), kind, F.lit(";base64,"), F.replace(F.base64(content), F.lit("\r\n"), F.lit("")))
