"""Quality classifier: a byte-level convolutional network in numpy.

A text's UTF-8 bytes are cut into overlapping chunks that cover the whole document.  Learned filters of ``WIDTH`` bytes slide over
them; each filter's largest response in a chunk passes a rectifier, a linear layer makes the chunk's
logit of these and of how full the chunk is, and the mean of the chunks' logits gives the document's probability.

A filter's response is a sum of one learned weight for each byte and place.  For scoring, the weights of two
neighbouring places are added up beforehand for all 65,536 byte pairs, so a response is WIDTH / 2 table rows.

The network is fitted on the driver with at most ``sample_docs`` labelled documents, those with the smallest hashes of
their ids (a documented bound; scoring covers every byte of every document), and on all their chunks, which cover the whole of each text as in scoring.  Every document weighs the same, however many chunks it has.
Null and empty texts are one chunk of padding.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from protomill.llm.common import map_texts

#: Bytes that a filter sees.
WIDTH = 6
#: Filters.
FILTERS = 16
#: Places of a filter in one chunk; chunks overlap by WIDTH - 1 bytes.
CHUNK = 256
#: Rows scored at once.
PIECE = 1 << 17


@dataclass
class Network:
    """Weights: one for each place, byte and filter; bias of the filters; linear layer and its bias."""

    bytes_: np.ndarray  # (WIDTH, 256, FILTERS)
    bias: np.ndarray
    out: np.ndarray  # (FILTERS + 1): the last weighs how full the chunk is
    out_bias: float

    def pairs(self) -> np.ndarray:
        """(WIDTH / 2, 65536, FILTERS): what two neighbouring places give together, for the index 256 x first + second."""
        w = self.bytes_
        return np.stack([(w[i][:, None, :] + w[i + 1][None, :, :]).reshape(65536, -1) for i in range(0, WIDTH, 2)])


def padded(text: bytes) -> np.ndarray:
    """The bytes with padding, so that the last filter place starts at the last byte."""
    return np.frombuffer((text or b"\0") + bytes(WIDTH - 1), dtype=np.uint8)


def chunks_of(text: bytes) -> list[np.ndarray]:
    """The chunks that a text is scored by."""
    data = padded(text)
    return [data[at : at + CHUNK + WIDTH - 1] for at in range(0, len(data) - WIDTH + 1, CHUNK)]


def fit(texts: list[bytes], labels: np.ndarray, epochs: int = 12, rate: float = 0.01, seed: int = 7) -> Network:
    """Trains on all chunks of each text, and a crop of one, with Adam; deterministic for a given order of the texts."""
    rng = np.random.default_rng(seed)
    rows, marks = [], []
    for text, label in zip(texts, labels, strict=True):
        pieces = chunks_of(text)
        whole = pieces[int(rng.integers(len(pieces)))]
        whole = whole[: len(whole) - WIDTH + 1]
        short = int(rng.integers(4, 96))  # a crop, so that shortness is not taken for a mark of either label
        at = int(rng.integers(0, max(1, len(whole) - short)))
        parts = [*pieces, padded(whole[at : at + short].tobytes())]
        for part in parts:
            rows.append(np.pad(part, (0, CHUNK + WIDTH - 1 - len(part))))
            marks.append((label, max(1, min(CHUNK, len(part) - WIDTH + 1)), 1 / len(parts)))
    net = Network(rng.normal(0, 0.1, (WIDTH, 256, FILTERS)).astype(np.float32), np.zeros(FILTERS, np.float32), np.append(rng.normal(0, 0.3, FILTERS), 0).astype(np.float32), 0.0)
    if not rows:
        return net
    data, target = np.stack(rows), np.array([m[0] for m in marks], dtype=np.float32)
    places = np.array([m[1] for m in marks])
    share = np.array([m[2] for m in marks])
    share /= share.mean()
    positive = min(max(float((target * share).mean()), 1e-3), 1 - 1e-3)
    weight = (np.where(target > 0, 0.5 / positive, 0.5 / (1 - positive)) * share).astype(np.float32)
    params = [net.bytes_, net.bias, net.out, np.zeros(1, np.float32)]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step, size = 0, 64
    response, one = (np.empty((size, CHUNK, FILTERS), np.float32) for _ in range(2))
    at_place = np.arange(CHUNK, dtype=np.int16)[None, :, None]
    filters = np.arange(FILTERS)[None, :]
    for epoch in range(epochs):
        order = rng.permutation(len(data))
        for at in range(0, len(order), size):
            some = order[at : at + size]
            x, y, n = data[some].astype(np.intp), target[some], len(some)
            best, top = _best_places(net, x, places[some], response[:n], one[:n], at_place)
            top = top + net.bias
            hidden = np.column_stack((np.maximum(top, 0), places[some] / np.float32(CHUNK))).astype(np.float32)
            logit = np.clip(hidden @ net.out + params[3][0], -30, 30)
            delta = (1 / (1 + np.exp(-logit)) - y) * weight[some] / n
            back = delta[:, None] * net.out[:-1] * (top > 0)
            cells = [(np.take_along_axis(x, best + i, 1) * FILTERS + filters).ravel() for i in range(WIDTH)]
            by_byte = [np.bincount(c, weights=back.ravel(), minlength=256 * FILTERS).reshape(256, FILTERS) for c in cells]
            grads = [np.stack(by_byte).astype(np.float32), back.sum(0), hidden.T @ delta, np.array([delta.sum()], np.float32)]
            step += 1
            pace = rate * (0.5 if epoch >= epochs * 2 // 3 else 1.0)
            for p, g, m, v in zip(params, grads, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= (pace * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    net.out_bias = float(params[3][0])
    return net


def _best_places(net: Network, x: np.ndarray, places: np.ndarray, response: np.ndarray, one: np.ndarray, at_place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place (the first of equals) and the size of each filter's largest response in every row."""
    np.take(net.bytes_[0], x[:, :CHUNK], axis=0, out=response, mode="clip")
    for i in range(1, WIDTH):
        np.take(net.bytes_[i], x[:, i : i + CHUNK], axis=0, out=one, mode="clip")
        response += one
    for row in np.nonzero(places < CHUNK)[0]:
        response[row, places[row] :] = -1e9
    top = response.max(1)
    best = np.where(response == top[:, None, :], at_place, np.int16(CHUNK)).min(1).astype(np.intp)
    return best, top


def score_all(net: Network, pairs: np.ndarray, texts: list[bytes]) -> list[float]:
    """The probability of label 1 for each whole text."""
    out: list[float] = []
    group: list[np.ndarray] = []
    size = 0
    for text in texts:
        data = padded(text)
        if size and size + len(data) > PIECE:
            out += _score_group(net, pairs, group)
            group, size = [], 0
        group.append(data)
        size += len(data)
    return out + (_score_group(net, pairs, group) if group else [])


def _score_group(net: Network, pairs: np.ndarray, group: list[np.ndarray]) -> list[float]:
    lengths = np.array([len(g) for g in group])
    begins = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    # chunks as (first place, end), none across texts
    per = -(-(lengths - WIDTH + 1) // CHUNK)
    text_of = np.repeat(np.arange(len(group)), per)
    number = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
    start = begins[text_of] + number * CHUNK
    end = np.minimum(start + CHUNK, (begins + lengths - WIDTH + 1)[text_of])
    data = np.concatenate(group).astype(np.int32)
    index = (data[:-1] << 8) | data[1:]
    logits = np.zeros(len(start))
    # a text longer than PIECE goes through in several rounds
    at = 0
    while at < len(start):
        stop = max(at + 1, int(np.searchsorted(start, start[at] + PIECE)))
        lo, hi = int(start[at]), int(end[stop - 1])
        response = pairs[0][index[lo:hi]]
        for i in range(1, WIDTH // 2):
            response += pairs[i][index[lo + 2 * i : hi + 2 * i]]
        # places between two texts belong to no chunk
        cuts = np.empty(2 * (stop - at), dtype=np.int64)
        cuts[0::2], cuts[1::2] = start[at:stop] - lo, end[at:stop] - lo
        if cuts[-1] == hi - lo:
            cuts = cuts[:-1]
        best = np.maximum.reduceat(response, cuts, axis=0)[0::2]
        fill = (end[at:stop] - start[at:stop]) / CHUNK
        logits[at:stop] = np.maximum(best + net.bias, 0) @ net.out[:-1] + fill * net.out[-1] + net.out_bias
        at = stop
    total = np.bincount(text_of, weights=logits, minlength=len(group)) / per
    return (1 / (1 + np.exp(-np.clip(total, -30, 30)))).tolist()


def held_out(doc_id: Column) -> Column:
    """True for the fifth of the documents that no label is learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, sample_docs: int = 4000) -> Network:
    """Fits a network on at most ``sample_docs`` labelled documents outside the held-out part.

    Labels other than 0 and 1, and null ids or labels, are left out.  Of rows that repeat, each counts.
    """
    known = labels.where(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id"))).select("doc_id", "quality")
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample_docs)  # the documented bound
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("__data")
    found = docs.select("doc_id", text).join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", "__data")
    rows = found.orderBy(F.xxhash64("doc_id"), "doc_id", "quality", F.xxhash64("__data")).limit(sample_docs).collect()
    rows.sort(key=lambda r: (r["doc_id"], r["quality"], bytes(r["__data"])))
    return fit([bytes(r["__data"]) for r in rows], np.array([r["quality"] for r in rows]))


def score(df: DataFrame, net: Network, keep: list[str], text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """``keep`` and score and predicted of every whole text; narrow, no shuffle."""
    # the network is 100 kB and travels with the tasks
    weights = (net.bytes_, net.bias, net.out, net.out_bias)

    def make() -> Callable[[list[str]], list[list]]:
        own = Network(*weights)
        pairs = own.pairs()

        def work(texts: list[str]) -> list[list]:
            found = score_all(own, pairs, [t.encode() for t in texts])
            return [found, [int(x >= threshold) for x in found]]

        return work

    return map_texts(df, keep, text_col, "score double, predicted int", make)
