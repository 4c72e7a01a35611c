"""SentencePiece encoding and decoding of merge-type (BPE) vocabularies.

The encoder keeps an agenda of adjacent symbol pairs ordered by the score of the piece they would
form.  The best pair (leftmost among equals) is merged, its new neighbours join the agenda, and so on
until no pair forms a piece.  Characters without a piece become byte pieces.  Words of up to ``SHORT`` symbols are encoded together: those
of one length are the rows of a table of symbols, their agendas the rows of a table of ranks, and a step merges the best pair of
every row that has one.  Longer words keep a heap each.

Two facts of the vocabulary, checked when it is loaded, let one worker remember what it has encoded:
no piece goes on after a character other than the space mark with a space mark, so a text can be cut
before each run of spaces, and no piece holds a line feed besides others, so it is a cut as well.
Where a vocabulary lacks the first property, whole texts are encoded at once.

Every word that a worker has not met is also given to the sentencepiece library, in one call for
each slice of an Arrow batch, together with one whole text of the slice; the ids and the decoded texts must
agree, or the job fails.  Null texts count as empty, and an empty text has the end id only.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame

from protomill.llm.common import map_texts, memory

#: The mark that stands for a space inside pieces.
MARK = "▁"
#: Words that one Python worker remembers (about 150 bytes each); then it starts anew.
MEMORY_WORDS = 500_000
#: Symbols up to which words are encoded together, and with a heap of their own beyond.
SHORT = 48
#: Stands in an agenda for a pair that forms no piece.
NO_PAIR = (1 << 62) - 1


class MergeVocabulary:
    """Pieces, scores and ids of a merge-type model file, with an encoder and a decoder."""

    def __init__(self, model_path: str):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self.piece_of: list[str] = []
        self.rank: dict[str, float] = {}  # the negated score, so that a heap gives the best piece first
        self.id_of: dict[str, int] = {}
        self.byte_id = [-1] * 256
        self.byte_of: dict[int, int] = {}
        self.silent: set[int] = set()
        self.unknown = sp.unk_id()
        self.end = sp.eos_id()
        self.plain: dict[int, str] = {}
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            self.piece_of.append(piece)
            if sp.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_id[value], self.byte_of[i] = i, value
            elif sp.is_control(i):
                self.silent.add(i)
            elif sp.is_unused(i):
                raise ValueError("vocabularies with unused pieces are not supported")
            elif i != self.unknown:
                self.plain[i] = piece.replace(MARK, " ")
                self.id_of[piece], self.rank[piece] = i, -sp.get_score(i)
        self.byte_fallback = min(self.byte_id) >= 0
        long = [p for p in self.id_of if len(p) > 1]
        self.cut_at_space = not any(MARK in p.lstrip(MARK) for p in long)
        self.cut_at_line = not any("\n" in p for p in long)
        probe = sp.encode("a  b ", out_type=str)
        if "".join(probe) != f"{MARK}a{MARK}{MARK}b{MARK}":
            raise ValueError("only models without normalisation, with a leading space mark, are supported")

        self._make_pairs()

    def _make_pairs(self) -> None:
        """Every pair of symbols that forms a piece, by sorted key, with the piece's rank (in the high bits) and id.

        A symbol is the id of its piece, or the number of pieces and its code point if it has none.  Pieces of equal score have equal ranks.
        """
        self.base = len(self.piece_of)
        rank_of = {r: k for k, r in enumerate(sorted(set(self.rank.values())))}
        self.of_character = np.arange(0x110000, dtype=np.int64) + self.base
        for p, i in self.id_of.items():
            if len(p) == 1:
                self.of_character[ord(p)] = i
        keys: dict[int, int] = {}
        for p, i in self.id_of.items():
            for cut in range(1, len(p)):
                left, right = (self.id_of.get(x, self.base + ord(x) if len(x) == 1 else -1) for x in (p[:cut], p[cut:]))
                if left >= 0 and right >= 0:
                    keys[left << 24 | right] = rank_of[self.rank[p]] << 24 | i
        self.pair_keys = np.array(sorted(keys), dtype=np.int64)
        self.pair_ranks = np.array([keys[k] for k in self.pair_keys.tolist()], dtype=np.int64)
        self.names = [str(i) for i in range(self.base)]

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank and id of what each two symbols form."""
        wanted = left << 24 | right
        if not len(self.pair_keys):
            return np.full(wanted.shape, NO_PAIR, dtype=np.int64)
        at = np.searchsorted(self.pair_keys, wanted)
        at[at == len(self.pair_keys)] = 0
        return np.where(self.pair_keys[at] == wanted, self.pair_ranks[at], NO_PAIR)

    def merge_all(self, words: list[str]) -> list[list[int]]:
        """Ids of many words in which spaces are marks already."""
        out: list[list[int]] = [[]] * len(words)
        by_length: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            by_length.setdefault(len(w), []).append(i)
        for length, where in by_length.items():
            if not length:
                continue
            if length > SHORT:
                for i in where:
                    out[i] = self.merge(words[i])
                continue
            points = np.frombuffer("".join([words[i] for i in where]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
            for row, symbols in self._merge_table(self.of_character[points].reshape(-1, length)):
                for i, ids in zip(row.tolist(), symbols.tolist(), strict=True):
                    out[where[i]] = ids if max(ids) < self.base else self._with_bytes([self._symbol(x) for x in ids])
        return out

    def _symbol(self, number: int) -> str:
        return self.piece_of[number] if number < self.base else chr(number - self.base)

    def _merge_table(self, symbols: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """(rows, their final symbols) of words of one length: each step takes the best pair from each row's agenda."""
        rows, done = np.arange(len(symbols)), []
        agenda = self._ranks(symbols[:, :-1], symbols[:, 1:])
        while len(rows) and agenda.shape[1]:
            each, at = np.arange(len(rows)), (agenda >> 24).argmin(1)  # the leftmost of equals
            best = agenda[each, at]
            ended = best == NO_PAIR
            if ended.any():
                done.append((rows[ended], symbols[ended]))
                go = ~ended
                rows, symbols, agenda, at, best, each = rows[go], symbols[go], agenda[go], at[go], best[go], each[: int(go.sum())]
                if not len(rows):
                    break
            piece = best & 0xFFFFFF
            symbols[each, at] = piece
            # a row loses the pair's right symbol and the pair
            stays = np.ones(symbols.shape, dtype=bool)
            stays[each, at + 1] = False
            symbols = symbols[stays].reshape(len(rows), -1)
            stays = np.ones(agenda.shape, dtype=bool)
            stays[each, at] = False
            agenda = agenda[stays].reshape(len(rows), -1)
            right = np.nonzero(at < agenda.shape[1])[0]
            agenda[right, at[right]] = self._ranks(piece[right], symbols[right, at[right] + 1])
            left = np.nonzero(at)[0]
            agenda[left, at[left] - 1] = self._ranks(symbols[left, at[left] - 1], piece[left])
        if len(rows):
            done.append((rows, symbols))
        return done

    def merge(self, symbols: str) -> list[int]:
        """Ids of a text in which spaces are marks already."""
        parts = self._merge_long(list(symbols))
        try:
            return [self.id_of[p] for p in parts]
        except KeyError:
            return self._with_bytes(parts)

    def _merge_long(self, parts: list[str]) -> list[str]:
        """The agenda as a heap."""
        rank, n = self.rank, len(parts)
        agenda = [(rank[p], i, i + 1, p) for i, p in enumerate(map(str.__add__, parts, parts[1:])) if p in rank]
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heapify(agenda)
        while agenda:
            _, left, right, piece = heappop(agenda)
            if after[left] != right or parts[left] + parts[right] != piece:
                continue  # one of the two was merged meanwhile
            parts[left], parts[right] = piece, ""
            nxt = after[left] = after[right]
            after[right] = -2
            if nxt >= 0:
                before[nxt] = left
                if (p := piece + parts[nxt]) in rank:
                    heappush(agenda, (rank[p], left, nxt, p))
            prev = before[left]
            if prev >= 0 and (p := parts[prev] + piece) in rank:
                heappush(agenda, (rank[p], prev, left, p))
        return [p for p in parts if p]

    def _with_bytes(self, parts: list[str]) -> list[int]:
        """Ids of symbols some of which have no piece."""
        ids: list[int] = []
        for p in parts:
            found = self.id_of.get(p)
            if found is not None:
                ids.append(found)
            elif self.byte_fallback:
                ids += [self.byte_id[b] for b in p.encode()]
            elif not ids or ids[-1] != self.unknown:  # neighbours that are unknown make one id
                ids.append(self.unknown)
        return ids

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text, without an end id."""
        if not text:
            return []
        return self._encode_marked(MARK + text.replace(" ", MARK))

    def encode_all(self, words: list[str]) -> list[list[int]]:
        """As encode() for each of many words; an empty word is a space mark alone."""
        marked = [MARK + w.replace(" ", MARK) if " " in w else MARK + w for w in words]
        out = self.merge_all(["" if len(m) > SHORT and "\n" in m else m for m in marked])
        for i, m in enumerate(marked):
            if len(m) > SHORT and "\n" in m:
                out[i] = self._encode_marked(m)
        return out

    def _encode_marked(self, marked: str) -> list[int]:
        """As merge(), cut at line feeds where no piece joins them to anything."""
        if not (self.cut_at_line and "\n" in marked):
            return self.merge(marked)
        ids: list[int] = []
        for k, line in enumerate(marked.split("\n")):
            if k:
                ids += self.merge("\n")
            ids += self.merge(line)
        return ids

    def decode(self, ids: list[int], drop_first_space: bool = True) -> str:
        """The text of ids; control ids are silent, byte pieces form characters or U+FFFD."""
        try:
            text = "".join([self.plain[i] for i in ids])
        except KeyError:
            text = self._decode_with_bytes(ids)
        return text[1:] if drop_first_space and text[:1] == " " else text

    def _decode_with_bytes(self, ids: list[int]) -> str:
        out: list[str] = []
        raw = bytearray()
        for i in ids:
            if i in self.byte_of:
                raw.append(self.byte_of[i])
                continue
            if raw:
                out.append(_characters(raw))
                raw = bytearray()
            if i == self.unknown:
                out.append(" ⁇ ")
            elif i not in self.silent:
                out.append(self.plain[i])
        if raw:
            out.append(_characters(raw))
        return "".join(out)


def _characters(raw: bytearray) -> str:
    """UTF-8 with one U+FFFD for each byte that belongs to no character."""
    out, at = [], 0
    while at < len(raw):
        for width in (1, 2, 3, 4):
            try:
                out.append(raw[at : at + width].decode())
                at += width
                break
            except UnicodeDecodeError:
                pass
        else:
            out.append("�")
            at += 1
    return "".join(out)


class Codec:
    """Encodes texts word by word with a memory, and checks what is new against the library."""

    def __init__(self, model_path: str, check: bool = True):
        self.vocabulary = MergeVocabulary(model_path)
        self.check = check
        self.known: dict[str, str] = {}  # ids of a word, decimal and joined by spaces
        self.odd: dict[str, str] = {}  # what such a word is decoded to, where that isn't the word

    def _words(self, text: str) -> list[str]:
        """The text cut before each run of spaces; each word stands for one space mark and itself."""
        text = text.replace(MARK, " ")  # the two are one symbol
        if not self.vocabulary.cut_at_space:
            return [text]
        words = text.split(" ")
        if "" not in words:
            return words
        merged, spaces = [], 0
        for w in words[:-1]:
            if w:
                merged.append(" " * spaces + w)
                spaces = 0
            else:
                spaces += 1
        merged.append(" " * spaces + words[-1])
        return merged

    def run(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """(number of ids with the end id, decimal ids joined by spaces, decoded text) of each text."""
        split = [self._words(t) if t else [] for t in texts]
        known, vocabulary = self.known, self.vocabulary
        if len(known) > MEMORY_WORDS:
            known.clear()
            self.odd.clear()
        new = list(set().union(*split).difference(known))
        encoded = vocabulary.encode_all(new)
        names = vocabulary.names
        for w, ids in zip(new, encoded, strict=True):
            known[w] = " ".join([names[i] for i in ids])
            if (decoded := vocabulary.decode(ids)) != w:
                self.odd[w] = decoded
        out = []
        end = str(vocabulary.end)
        for words in split:
            ids = " ".join([*map(known.__getitem__, words), end])
            decoded = " ".join([self.odd.get(w, w) for w in words] if self.odd else words)
            out.append((ids.count(" ") + 1, ids, decoded))
        if self.check:
            self._compare(new, encoded, texts, out)
        return out

    def _compare(self, new: list[str], encoded: list[list[int]], texts: list[str], out: list) -> None:
        library = self.vocabulary.library
        some = [(w, ids) for w, ids in zip(new, encoded, strict=True) if w]
        if some:
            words, ours = [w for w, _ in some], [ids for _, ids in some]
            # a word begins with a space mark, so that all decoded at once are the words joined by spaces
            decoded = " ".join([self.odd.get(w, w) for w in words])
            if library.encode(words, num_threads=1) != ours or library.decode(list(chain.from_iterable(ours))) != decoded:
                raise RuntimeError("the encoder and the sentencepiece library differ on a word")
        if texts:
            at = max(range(len(texts)), key=lambda i: (bool(texts[i]), zlib.crc32(texts[i].encode()), -i))  # any, by its hash
            ids = library.encode(texts[at], add_eos=True)
            if " ".join(map(str, ids)) != out[at][1] or library.decode(ids) != out[at][2]:
                raise RuntimeError("the encoder and the sentencepiece library differ on a text")


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def codec(model_path: str) -> Codec:
    """One codec for each model file in a Python worker, which serves many tasks."""
    known = memory("pieces")
    if model_path not in known:
        known[model_path] = Codec(model_path)
    return known[model_path]


def encode_decode(df: DataFrame, model_path: str, keep: list[str], text_col: str = "text", texts: bool = False) -> DataFrame:
    """Encodes every whole text and decodes the ids again.

    Returns the columns ``keep`` and ``n_tokens``, ``ids_sha256``, ``decoded_sha256``; with ``texts``
    also ``ids`` (decimal, joined by spaces) and ``decoded``.  One row for each input row, no shuffle.
    Null and empty texts: the end id alone, decoded to the empty text.
    """

    def make() -> Callable[[list[str]], list[list]]:
        coder = codec(model_path)

        def work(batch: list[str]) -> list[list]:
            rows = coder.run(batch)
            columns = [[r[0] for r in rows], [_digest(r[1]) for r in rows], [_digest(r[2]) for r in rows]]
            return columns + ([[r[1] for r in rows], [r[2] for r in rows]] if texts else [])

        return work

    schema = "n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids string, decoded string" if texts else "")
    return map_texts(df, keep, text_col, schema, make)
