"""Token counts of whole texts, with overlapping chunks for huge documents.

A text longer than ``HUGE_CHARS`` is cut into chunks of ``CHUNK_CHARS`` that overlap.  The library encodes each chunk with token
offsets.  Two neighbours are spliced at a position of their overlap where both encodings start a token and which
is a proven boundary: one at which the tokenizer cuts whatever stands on either side.  If alignment fails, because the overlap
holds none, it is widened, first to the left down to the last splice, then to the right until the text ends.
So the sum of the spliced counts is the count of the whole text, and no call sees more than a few
chunks unless the text itself has no boundary for so long.

Proven boundaries, by kind of tokenizer:

* ``words``: the pre-tokenizer drops white space and no pattern can match any; a boundary lies at every
  start of a run of other characters.  Words are then independent, so for texts that are not huge a worker counts each distinct
  word once with the library and remembers it (it is too slow to encode all of them as wholes within the limits).
* ``spaces``: every single space joins the word that follows (byte-level BPE, or pieces that start with
  a space mark); a boundary lies before a space between two other characters.
* none known: the text is encoded as one.

Null and empty texts have no tokens.  Special strings inside texts are handled as the library does by
default, and no special tokens are added.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from protomill.llm.common import map_texts, memory

#: A text of more characters is encoded in overlapping chunks.
HUGE_CHARS = 32_768
#: Characters of a chunk.
CHUNK_CHARS = 16_384
#: Characters that two chunks share at first.
OVERLAP_CHARS = 256
#: Words that one Python worker remembers; then it starts anew.
MEMORY_WORDS = 500_000
_WORD = re.compile(r"[^ \n\t\r]+")


class JsonChunk:
    """The library's encoding of text[left:right]."""

    def __init__(self, library, text: str, left: int, right: int):
        self.encoding, self.left = library.encode(text[left:right], add_special_tokens=False), left
        self.tokens = len(self.encoding)

    def token_at(self, place: int) -> int:
        """The number of the token that starts at a character of the whole text; -1 if none does."""
        at = place - self.left
        i = self.encoding.char_to_token(at)
        if i is None:  # offsets that leave out the space which a token begins with
            at += 1
            i = self.encoding.char_to_token(at)
        return i if i is not None and self.encoding.token_to_chars(i)[0] == at else -1


class PieceChunk:
    """The same from the sentencepiece library."""

    def __init__(self, library, text: str, left: int, right: int):
        # the library puts a space mark before a text; at a chunk that starts with a space it stands for that space
        skip = int(left > 0 and text[left] == " ")
        part = text[left + skip : right]
        raw = np.frombuffer(part.encode(), dtype=np.uint8)
        characters = np.append(np.cumsum((raw & 0xC0) != 0x80) - 1, len(part))  # the library counts bytes
        starts = characters[np.array([p.begin for p in library.encode(part, return_type="proto").pieces], dtype=np.int64)]
        starts[1:] += skip
        self.starts, self.tokens = starts + left, len(starts)

    def token_at(self, place: int) -> int:
        i = int(np.searchsorted(self.starts, place))
        return i if i < self.tokens and self.starts[i] == place else -1


class JsonTokenizer:
    """A tokenizer file of the tokenizers library."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            self.rule = _rule_of(json.load(f))
        self.counts: dict[str, int] = {}

    def _learn(self, split: list[list[str]]) -> None:
        known = self.counts
        if len(known) > MEMORY_WORDS:
            known.clear()
        new = list(set().union(*split).difference(known))
        if new:
            found = self.library.encode(new, is_pretokenized=True, add_special_tokens=False)
            known.update(zip(new, np.bincount(np.array(found.word_ids, dtype=np.int64), minlength=len(new)).tolist(), strict=True))
        known[""] = 0

    def count(self, texts: list[str]) -> list[int]:
        if self.rule != "words":
            return [len(x) for x in self.library.encode_batch(texts, add_special_tokens=False)]
        split = [_WORD.findall(t) if "\t" in t or "\r" in t else t.replace("\n", " ").split(" ") for t in texts]
        self._learn(split)
        known = self.counts
        counts = [sum(map(known.__getitem__, words)) for words in split]
        if texts:  # one whole text of each slice, any by its hash, is held against the library
            at = max(range(len(texts)), key=lambda i: (bool(texts[i]), zlib.crc32(texts[i].encode()), -i))
            if len(self.library.encode(texts[at], add_special_tokens=False)) != counts[at]:
                raise RuntimeError("counts by word differ from the library's count of a text")
        return counts

    def chunk(self, text: str, left: int, right: int) -> JsonChunk:
        return JsonChunk(self.library, text, left, right)


class PieceTokenizer:
    """A model file of the sentencepiece library."""

    def __init__(self, path: str):
        from protomill.llm.sentencepiece_codec import MergeVocabulary

        vocabulary = MergeVocabulary(path)
        self.library = vocabulary.library
        self.rule = "spaces" if vocabulary.cut_at_space else ""

    def count(self, texts: list[str]) -> list[int]:
        return [len(x) for x in self.library.encode(texts, num_threads=1)]

    def chunk(self, text: str, left: int, right: int) -> PieceChunk:
        return PieceChunk(self.library, text, left, right)


def _rule_of(config: dict) -> str:
    """Which boundaries are proven for a tokenizer, from its own description."""
    steps = config.get("pre_tokenizer") or {}
    steps = steps.get("pretokenizers", [steps])
    first = steps[0] if steps else {}
    if first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert"):
        outside = re.sub(r"\[\^[^\]]*\\s[^\]]*\]", "", first["pattern"].get("Regex", " "))
        if not re.search(r"\\s|\\S|\\W|\\D|\.| |\[\^", outside):
            return "words"
    if first.get("type") == "ByteLevel" and first.get("use_regex", True) and not config.get("normalizer"):
        return "spaces"
    return ""


def boundaries(text: str, rule: str, start: int, end: int) -> list[int]:
    """Proven boundaries p with start < p < end."""
    base = max(0, start - 1)
    part = text[base : end + 1]
    pattern = {"words": r"(?<=[ \n\t\r])[^ \n\t\r]", "spaces": r"(?<=[^\s▁]) (?=[^\s▁])"}.get(rule)
    found = [base + m.start() for m in re.finditer(pattern, part)] if pattern else []
    return [p for p in found if start < p < end]


def aligned_at(one, other, places: list[int], middle: int) -> int:
    """The place nearest to the middle at which both encodings start a token; -1 if there is none."""
    for p in sorted(places, key=lambda p: abs(p - middle)):
        if one.token_at(p) >= 0 and other.token_at(p) >= 0:
            return p
    return -1


def count_huge(text: str, tokenizer, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS, trace: list | None = None) -> int:
    """Tokens of one text, encoded in overlapping chunks that are spliced at proven boundaries.

    ``trace`` collects what happened at the ends of chunks: "splice", "widen" or "grow".
    """
    log = trace.append if trace is not None else lambda event: None
    total, cut, end = 0, 0, min(chunk, len(text))
    now, first = tokenizer.chunk(text, 0, end), 0  # the encoding that covers the last cut, and its token there
    while end < len(text):
        shared, splice = overlap, -1
        while splice < 0:
            left = max(cut, end - shared)
            right = min(len(text), end + chunk)
            following = tokenizer.chunk(text, left, right)
            splice = aligned_at(now, following, boundaries(text, tokenizer.rule, left, end), (left + end) // 2)
            if splice >= 0:
                log("splice")
            elif left > cut:
                log("widen")
                shared *= 2
            else:  # nothing to splice at since the last cut: the chunk itself grows
                log("grow")
                end, now, first = right, following, 0
                if end == len(text):
                    return total + now.tokens
                shared = overlap
        total += now.token_at(splice) - first
        cut, end, now, first = splice, right, following, following.token_at(splice)
    return total + now.tokens - first


def tokenizer(path: str):
    """One tokenizer for each file in a Python worker, which serves many tasks."""
    known = memory("token counts")
    if path not in known:
        known[path] = PieceTokenizer(path) if path.endswith(".model") else JsonTokenizer(path)
    return known[path]


def count_tokens(
    df: DataFrame,
    path: str,
    keep: list[str],
    text_col: str = "text",
    limit: int = 2048,
    huge: int = HUGE_CHARS,
    chunk: int = CHUNK_CHARS,
    overlap: int = OVERLAP_CHARS,
) -> DataFrame:
    """``keep`` and n_bytes, n_tokens, over_limit of every whole text; narrow, no shuffle."""

    def make() -> Callable[[list[str]], list[list]]:
        own = tokenizer(path)

        def work(texts: list[str]) -> list[list]:
            small = [t for t in texts if len(t) <= huge]
            counted = iter(own.count(small))
            counts = [next(counted) if len(t) <= huge else count_huge(t, own, chunk, overlap) for t in texts]
            return [[len(t.encode()) for t in texts], counts]

        return work

    out = map_texts(df, keep, text_col, "n_bytes long, n_tokens long", make)
    return out.withColumn("over_limit", F.col("n_tokens") > F.lit(limit))
