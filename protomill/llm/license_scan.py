"""License scans: patience alignment of texts with license templates.

Words are runs of letters and digits (and dots inside them), lower-cased.  To align a piece of text with a template, words that
occur exactly once in both are anchors; the longest increasing subsequence of their positions keeps the
order; the gaps between neighbouring anchors are aligned the same way.  The coverage is the share of the template's words that were aligned.

A gap without anchors is aligned by a table of longest common subsequences if it is small, else at its ends.

A long text may hold a template more than once, or hold some of its words often.  So the text is not aligned
as a whole but window by window.  A window starts and ends at a word of the template.  It holds the template if the aligned words are at least ``THRESHOLD``
of the template's and at least ``DENSITY`` of the window's; so a template is found with one and a half words put in after each of its words, and common words strewn over a long text
are no license.  By that rule no window longer than the template's words over ``DENSITY`` can count, and no other bound is set: of all windows the best is found.

An alignment can't cover more than the longest common subsequence of window and template, whose length is kept up word by word in the bits of one integer.  Starts are looked at in ranges: a range whose
whole reach has too little in common with the template for the threshold, or for more than the best alignment so far, is passed over; others are halved.

Templates are files of the folder ``licenses``: a version and named parts, each a template of its own.

Null and empty texts: no license, coverage 0.  All templates that reach the threshold are reported; the headline is the one of the best
coverage, ties going to the longer template, then to the first name.  Of equally good windows the first counts.  Rows that repeat are scanned each.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame

from protomill.llm.common import map_texts

#: Where the templates are.
FOLDER = Path(__file__).parent / "licenses"
#: Coverage from which a license counts as found.
THRESHOLD = 0.8
#: Share of a window's words that are aligned, at least.
DENSITY = 0.4
#: Pairs of words of a gap that is aligned by a table.
TABLE = 4096
_WORD = re.compile(r"[^\W_]+(?:\.[^\W_]+)*")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def longest_increasing(values: list[int]) -> list[int]:
    """Indices of a longest strictly increasing subsequence, by patience sorting."""
    tops: list[int] = []
    at: list[int] = []
    back = [-1] * len(values)
    for i, v in enumerate(values):
        k = bisect_left(tops, v)
        back[i] = at[k - 1] if k else -1
        if k == len(tops):
            tops.append(v)
            at.append(i)
        else:
            tops[k], at[k] = v, i
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def common_words(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Pairs of positions of a longest common subsequence."""
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in reversed(range(len(a))):
        for j in reversed(range(len(b))):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def align(text: list[str], template: list[str]) -> list[tuple[int, int]]:
    """Pairs of positions of equal words, increasing in both."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(text), 0, len(template))]
    while todo:
        a, b, c, d = todo.pop()
        if a >= b or c >= d:
            continue
        mine, its = Counter(text[a:b]), Counter(template[c:d])
        place = {w: i for i, w in enumerate(text[a:b], a) if mine[w] == 1}
        shared = [(place[w], j) for j, w in enumerate(template[c:d], c) if its[w] == 1 and w in place]
        anchors = [shared[i] for i in longest_increasing([p for p, _ in shared])]
        if not anchors and (b - a) * (d - c) <= TABLE:
            out += [(a + i, c + j) for i, j in common_words(text[a:b], template[c:d])]
            continue
        if not anchors:
            while a < b and c < d and text[a] == template[c]:
                out.append((a, c))
                a, c = a + 1, c + 1
            while a < b and c < d and text[b - 1] == template[d - 1]:
                out.append((b - 1, d - 1))
                b, d = b - 1, d - 1
            continue
        out += anchors
        edges = [(a - 1, c - 1), *anchors, (b, d)]
        todo += [(p + 1, q, r + 1, s) for (p, r), (q, s) in zip(edges, edges[1:], strict=False)]
    return sorted(out)


def read_templates(folder: Path = FOLDER) -> dict[str, str]:
    """Template texts by name: that of the file for its notice, with the part's name behind for other parts."""
    out = {}
    for path in sorted(folder.glob("*.txt")):
        version, *parts = re.split(r"^\[(\w+)\]$", path.read_text(encoding="utf-8"), flags=re.MULTILINE)
        if version.strip() != "version 1":
            raise ValueError(f"{path.name}: a version that is not known")
        for part, text in zip(parts[::2], parts[1::2], strict=True):
            out[path.stem if part == "notice" else f"{path.stem}-{part}"] = text.strip()
    return out


class Template:
    """The words of a template, and the lengths of longest common subsequences with it."""

    def __init__(self, words: list[str]):
        self.words, self.counts = words, Counter(words)
        self.full = (1 << len(words)) - 1
        self.bits = dict.fromkeys(words, 0)
        for j, w in enumerate(words):
            self.bits[w] |= 1 << j

    def lengths(self, words: list[str]) -> list[int]:
        """Of each beginning of ``words``, all of which are the template's."""
        out, apart, bits, full, size = [], self.full, self.bits, self.full, len(self.words)  # a zero for each word in common
        for w in words:
            met = apart & bits[w]
            apart = (apart + met | apart - met) & full
            out.append(size - apart.bit_count())
        return out

    def length(self, words: list[str]) -> int:
        apart, bits, full = self.full, self.bits, self.full
        for w in words:
            met = apart & bits[w]
            apart = (apart + met | apart - met) & full
        return len(self.words) - apart.bit_count()


def best_window(words: list[str], where: dict[str, list[int]], template: list[str] | Template, threshold: float, density: float = DENSITY) -> tuple[float, int, int]:
    """(coverage, first word, last word) of the window that aligns best, (0, -1, -1) if none holds the template."""
    its = template if isinstance(template, Template) else Template(template)
    template, size = its.words, len(its.words)
    best = (0.0, -1, -1)
    needed = max(1, -int(-threshold * size // 1))  # aligned words at the threshold
    if not size or sum(min(n, len(where.get(w, ()))) for w, n in its.counts.items()) < needed:
        return best
    places = sorted(p for w in its.counts if w in where for p in where[w])
    mine = [words[p] for p in places]
    reach, covered = int(size / density), needed - 1
    ranges = [(0, len(places))]
    while ranges:
        low, high = ranges.pop()
        end = bisect_left(places, places[high - 1] + reach)
        if end - low <= covered or its.length(mine[low:end]) <= covered:
            continue
        if high - low > 1:
            middle = (low + high) // 2
            ranges += [(middle, high), (low, middle)]
            continue
        for n, k in sorted((-n, k) for k, n in enumerate(its.lengths(mine[low:end]))):
            if -n <= covered:
                break
            first, last = places[low], places[low + k]
            pairs = align(words[first : last + 1], template)
            if len(pairs) > covered and len(pairs) >= density * (last + 1 - first):
                covered = len(pairs)
                best = (covered / size, first + pairs[0][0], first + pairs[-1][0])
        if covered == size:
            break
    return best


def scan(text: str, templates: dict[str, list[str] | Template], threshold: float) -> tuple[str | None, float, int, int, list[str]]:
    """(license, coverage, first word, last word) of the best template of a whole text, and the names of all that reach the threshold, best first."""
    templates = {name: t if isinstance(t, Template) else Template(t) for name, t in templates.items()}
    words = words_of(text) if text else []
    where: dict[str, list[int]] = {}
    for i, w in enumerate(words):
        where.setdefault(w, []).append(i)
    found = []
    for name, template in templates.items():
        coverage, first, last = best_window(words, where, template, threshold) if where else (0.0, -1, -1)
        if coverage:
            found.append((-coverage, -len(template.words), name, first, last))
    found.sort()
    if not found:
        return None, 0.0, -1, -1, []
    coverage, _, name, first, last = found[0]
    return name, -coverage, first, last, [f[2] for f in found]


def scan_licenses(
    df: DataFrame, keep: list[str], templates: dict[str, str] | None = None, threshold: float = THRESHOLD, text_col: str = "text"
) -> DataFrame:
    """``keep`` and license (null if none), coverage, first_word and last_word (-1 if none), and licenses (all names found); narrow, no shuffle.

    A kept column with the name of a new one is replaced.
    """
    tokens = {name: Template(words_of(t)) for name, t in sorted((templates or read_templates()).items())}

    def make() -> Callable[[list[str]], list[list]]:
        def work(texts: list[str]) -> list[list]:
            found = [scan(t, tokens, threshold) for t in texts]
            return [[f[i] for f in found] for i in range(5)]

        return work

    return map_texts(df, keep, text_col, "license string, coverage double, first_word int, last_word int, licenses array<string>", make)
