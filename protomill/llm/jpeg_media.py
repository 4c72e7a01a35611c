"""Media columns: baseline JPEG files written and read in numpy.

Writing: a text's UTF-8 bytes, padded with zero bytes to a positive multiple of 64, become the quantised coefficients of
one 8x8 block for each 64 bytes (byte minus 128, in zigzag order).  Samples would not come back exactly, since the
transform rounds; quantised coefficients are the unit that baseline JPEG stores without loss.  The frame is a
grey image of ``wide`` by ``high`` blocks; blocks beyond the payload are empty, and a comment segment holds the payload's
length.  The scan restarts every ``RESTART`` blocks.

Reading works on any baseline file with one interleaved scan: markers are parsed, and all restart intervals of all files of a batch are Huffman-decoded
together, one symbol of each interval at a step, with table lookups on 16-bit prefixes.  The DC coefficients alone
make the luminance thumbnail (a pixel for each block), of which a difference hash is taken.

Null texts count as empty (one block).  Equal texts give equal files and features.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame

from protomill.llm.common import map_texts

#: Blocks between restart markers in files that are written.
RESTART = 4
#: Payload bytes that are written or read at once.
PIECE_BYTES = 2 << 20
BLOCK = 64


def canonical_codes(counts: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(code, length) of the symbols of a table in order, from the number of codes of each length 1 to 16."""
    codes, lengths, code = [], [], 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            codes.append(code)
            lengths.append(length)
            code += 1
        code <<= 1
    return np.array(codes, dtype=np.int64), np.array(lengths, dtype=np.int64)


@dataclass(frozen=True)
class Table:
    """A Huffman table: number of codes by length, and the symbols in the order of their codes."""

    counts: tuple[int, ...]
    symbols: tuple[int, ...]

    def encoder(self) -> tuple[np.ndarray, np.ndarray]:
        """Code and length by symbol (length 0: no code)."""
        codes, lengths = canonical_codes(list(self.counts))
        code, length = np.zeros(256, dtype=np.int64), np.zeros(256, dtype=np.int64)
        code[list(self.symbols)], length[list(self.symbols)] = codes, lengths
        return code, length

    def decoder(self) -> np.ndarray:
        """For each 16-bit prefix: 256 x length + symbol, or 0 where no code fits."""
        codes, lengths = canonical_codes(list(self.counts))
        out = np.zeros(1 << 16, dtype=np.int32)
        for c, n, s in zip(codes.tolist(), lengths.tolist(), self.symbols, strict=True):
            out[c << (16 - n) : (c + 1) << (16 - n)] = n << 8 | s
        return out


def text_tables() -> tuple[Table, Table]:
    """Tables for text bytes, by rule: 4-bit codes for DC sizes; for AC the end of block and sizes 1 to 8 without zeros
    before them get 4 bits, the next 90 symbols 8 bits, and the rest 10 bits."""
    dc = Table((0, 0, 0, 12, *[0] * 12), tuple(range(12)))
    short = [0x00, *range(0x01, 0x09)]
    rest = [r << 4 | s for r in range(16) for s in range(11) if (s or r == 15) and (r << 4 | s) not in short]
    return dc, Table((0, 0, 0, 9, 0, 0, 0, 90, 0, len(rest) - 90, *[0] * 6), (*short, *rest))


DC_TABLE, AC_TABLE = text_tables()
#: Quantisation by which the DC of a block is the plain mean of its samples.
QUANT = np.full(64, 8, dtype=np.uint8)


def _segment(marker: int, body: bytes) -> bytes:
    return bytes((0xFF, marker)) + (len(body) + 2).to_bytes(2, "big") + body


def _header(wide: int, high: int, payload: int) -> bytes:
    tables = b"".join(bytes((kind,)) + bytes(t.counts) + bytes(t.symbols) for kind, t in ((0x00, DC_TABLE), (0x10, AC_TABLE)))
    return b"".join(
        (
            b"\xff\xd8",
            _segment(0xFE, b"payload=%d" % payload),
            _segment(0xDB, b"\x00" + QUANT.tobytes()),
            _segment(0xC0, bytes((8, *(8 * high).to_bytes(2, "big"), *(8 * wide).to_bytes(2, "big"), 1, 1, 0x11, 0))),
            _segment(0xC4, tables),
            _segment(0xDD, RESTART.to_bytes(2, "big")),
            _segment(0xDA, bytes((1, 1, 0x00, 0, 63, 0))),
        )
    )


_SIZES = np.array([int(abs(v)).bit_length() for v in range(-2048, 2048)], dtype=np.int64)


def scan_bytes(blocks: np.ndarray, first_interval: int) -> bytes:
    """Entropy-coded data of whole restart intervals; ``blocks`` (n, 64) holds coefficients in zigzag order.

    A restart marker precedes every interval but the scan's first.
    """
    dc_code, dc_len = DC_TABLE.encoder()
    ac_code, ac_len = AC_TABLE.encoder()
    n = len(blocks)
    prev = np.zeros(n, dtype=np.int64)
    prev[1:] = blocks[:-1, 0]
    prev[::RESTART] = 0
    dc = blocks[:, 0] - prev
    rows, cols = np.nonzero(blocks[:, 1:])
    cols = cols + 1
    values = blocks[rows, cols]
    new_row = np.ones(len(rows), dtype=bool)
    new_row[1:] = rows[1:] != rows[:-1]
    before = np.zeros(len(rows), dtype=np.int64)
    before[1:] = cols[:-1]
    before[new_row] = 0
    run = cols - before - 1
    skips = run >> 4  # sixteen zeros each
    last = np.zeros(n, dtype=np.int64)
    last[rows] = cols  # the last of equal indices stays
    # every symbol as (block, place in it, bits, number of bits)
    size = _SIZES[dc + 2048]
    parts = [(np.arange(n), np.zeros(n, dtype=np.int64), dc_code[size] << size | np.where(dc < 0, dc + (1 << size) - 1, dc), dc_len[size] + size)]
    size = _SIZES[values + 2048]
    symbol = (run & 15) << 4 | size
    parts.append((rows, 4 * cols + 3, ac_code[symbol] << size | np.where(values < 0, values + (1 << size) - 1, values), ac_len[symbol] + size))
    for k in range(int(skips.max(initial=0))):
        some = skips > k
        parts.append((rows[some], 4 * cols[some] + k, np.full(int(some.sum()), ac_code[0xF0]), np.full(int(some.sum()), ac_len[0xF0])))
    ended = np.nonzero(last < 63)[0]
    parts.append((ended, np.full(len(ended), 4 * 64), np.full(len(ended), ac_code[0]), np.full(len(ended), ac_len[0])))
    row, place, bits, width = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(row * 512 + place, kind="stable")
    row, bits, width = row[order], bits[order], width[order]
    interval = row // RESTART
    count = -(-n // RESTART)
    ends = np.cumsum(width)
    upto = np.concatenate(([0], ends[np.searchsorted(interval, np.arange(count), side="right") - 1]))
    total = np.diff(upto)
    room = -(-total // 8)  # whole bytes, filled with ones
    start = np.concatenate(([0], np.cumsum(room)))
    at = ends - width + np.repeat(8 * start[:-1] - upto[:-1], np.bincount(interval, minlength=count))
    # a symbol lies in one or two words of 32 bits; symbols share no bit, so sums are unions
    shifted = bits << (64 - width - (at & 31))
    size = int(start[-1]) // 4 + 2
    upper = np.bincount(at >> 5, weights=(shifted.view(np.uint64) >> np.uint64(32)).astype(np.float64), minlength=size)
    lower = np.bincount((at >> 5) + 1, weights=(shifted & 0xFFFFFFFF).astype(np.float64), minlength=size)
    words = (upper[:size] + lower[:size]).astype(np.uint32).astype(">u4").view(np.uint8)
    pad = room * 8 - total
    words[start[1:] - 1] |= ((1 << pad) - 1).astype(np.uint8)
    words = words[: int(start[-1])]
    # 0xFF in data is followed by 0x00; markers go between intervals
    number = first_interval + np.arange(count)
    stuffed = np.nonzero(words == 0xFF)[0] + 1
    marked = number > 0
    mark_at, mark = start[:-1][marked], 0xD0 + (number[marked] - 1) % 8
    where = np.concatenate((mark_at, mark_at, stuffed))
    what = np.concatenate((np.full(len(mark), 0xFF), mark, np.zeros(len(stuffed), dtype=np.int64))).astype(np.uint8)
    rank = np.concatenate((np.full(len(mark), 1), np.full(len(mark), 2), np.zeros(len(stuffed), dtype=np.int64)))
    order = np.lexsort((rank, where))
    return np.insert(words, where[order], what[order]).tobytes()


def payload_of(text: str) -> bytes:
    raw = text.encode()
    return raw + bytes(-len(raw) % BLOCK or (BLOCK if not raw else 0))


def write(payload: bytes) -> bytes:
    """A baseline JPEG file that holds a payload of a positive multiple of 64 bytes."""
    n = len(payload) // BLOCK
    wide = 1
    while wide * wide < n:
        wide += 1
    high = -(-n // wide)
    if 8 * max(wide, high) > 65535:
        raise ValueError("the payload exceeds the largest frame of a JPEG file")
    out = [_header(wide, high, len(payload))]
    step = PIECE_BYTES // BLOCK // RESTART * RESTART
    total = wide * high
    for at in range(0, total, step):
        some = np.frombuffer(payload, dtype=np.uint8, count=max(0, min(n - at, step)) * BLOCK, offset=min(at, n) * BLOCK)
        blocks = np.zeros((min(step, total - at), BLOCK), dtype=np.int64)
        blocks[: len(some) // BLOCK] = some.reshape(-1, BLOCK).astype(np.int64) - 128
        out.append(scan_bytes(blocks, at // RESTART))
    return b"".join(out) + b"\xff\xd9"


@dataclass
class Frame:
    """What the markers of a file say."""

    width: int = 0
    height: int = 0
    quant: dict[int, np.ndarray] = field(default_factory=dict)
    dc: dict[int, Table] = field(default_factory=dict)
    ac: dict[int, Table] = field(default_factory=dict)
    parts: list[tuple[int, int, int, int]] = field(default_factory=list)  # id, horizontal, vertical, quant
    scan: list[tuple[int, int]] = field(default_factory=list)  # dc and ac table of each part
    restart: int = 0
    comment: bytes = b""
    data: int = 0

    @property
    def mcus(self) -> tuple[int, int]:
        h, v = max(p[1] for p in self.parts), max(p[2] for p in self.parts)
        if len(self.parts) == 1:
            h = v = 1
        return -(-self.width // (8 * h)), -(-self.height // (8 * v))

    @property
    def layout(self) -> list[int]:
        """The part of each block of an MCU."""
        if len(self.parts) == 1:
            return [0]
        return [i for i, p in enumerate(self.parts) for _ in range(p[1] * p[2])]


def parse(raw: bytes) -> Frame:
    """Reads the markers up to the scan; only baseline files with one scan of all parts are accepted."""
    if raw[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG file")
    out, at = Frame(), 2
    while True:
        while raw[at] == 0xFF and raw[at + 1] == 0xFF:
            at += 1
        if raw[at] != 0xFF:
            raise ValueError("a marker is missing")
        marker, length = raw[at + 1], int.from_bytes(raw[at + 2 : at + 4], "big")
        body, at = raw[at + 4 : at + 2 + length], at + 2 + length
        if marker == 0xDB:
            while body:
                width = 1 + (body[0] >> 4)
                out.quant[body[0] & 15] = np.frombuffer(body[1 : 1 + 64 * width], dtype=f">u{width}").astype(np.int64)
                body = body[1 + 64 * width :]
        elif marker == 0xC4:
            while body:
                counts = tuple(body[1:17])
                table = Table(counts, tuple(body[17 : 17 + sum(counts)]))
                (out.ac if body[0] >> 4 else out.dc)[body[0] & 15] = table
                body = body[17 + sum(counts) :]
        elif marker == 0xC0:
            out.height, out.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            out.parts = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(body[5])]
        elif 0xC1 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            raise ValueError("only baseline files are read")
        elif marker == 0xDD:
            out.restart = int.from_bytes(body[:2], "big")
        elif marker == 0xFE:
            out.comment += body
        elif marker == 0xDA:
            if body[0] != len(out.parts):
                raise ValueError("only files with a single scan are read")
            out.scan = [(body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])]
            out.data = at
            return out


def intervals(raw: bytes, start: int) -> tuple[np.ndarray, np.ndarray]:
    """(the scan's data without stuffing and markers, first byte of each restart interval in it)."""
    data = np.frombuffer(raw, dtype=np.uint8, offset=start)
    flag = np.nonzero(data[:-1] == 0xFF)[0]
    kind = data[flag + 1]
    stop = flag[(kind != 0) & ((kind < 0xD0) | (kind > 0xD7)) & (kind != 0xFF)]
    end = int(stop[0]) if len(stop) else len(data)
    inside = flag < end
    flag, kind = flag[inside], kind[inside]
    marks = flag[kind != 0]
    keep = np.ones(end, dtype=bool)
    keep[flag[kind == 0] + 1] = False
    keep[marks] = keep[marks + 1] = False
    index = np.cumsum(keep)
    return data[:end][keep], np.concatenate(([0], index[marks]))


def decode(files: list[bytes]) -> list[tuple[Frame, np.ndarray]]:
    """(frame, coefficients (blocks, 64) in zigzag order, DC differences resolved) of each file.

    All intervals of all files advance together, one Huffman symbol at each step.
    """
    frames = [parse(f) for f in files]
    tables: dict[Table, int] = {}
    data, starts, first, count, layout_of, restarts = [], [], [], [], [], []
    layouts: dict[tuple, int] = {}
    sizes, at, total = [], 0, 0
    for f, raw in zip(frames, files, strict=True):
        part, begin = intervals(raw, f.data)
        wide, high = f.mcus
        own = tuple((tables.setdefault(f.dc[f.scan[c][0]], len(tables)), tables.setdefault(f.ac[f.scan[c][1]], len(tables)), c) for c in f.layout)
        per = f.restart or wide * high
        need = -(-wide * high // per)
        if need > len(begin):
            raise ValueError("restart intervals are missing")
        lane = np.arange(need)
        data.append(part)
        starts.append(begin[:need] + at)
        first.append(total + lane * per * len(own))
        count.append(np.minimum(per, wide * high - lane * per) * len(own))
        layout_of.append(np.full(need, layouts.setdefault(own, len(layouts))))
        at += len(part)
        sizes.append(wide * high * len(own))
        total += sizes[-1]
    stream = np.concatenate([*data, np.full(16, 0xFF, dtype=np.uint8)]).astype(np.uint64)
    n = len(stream) - 7
    window = np.zeros(n, dtype=np.uint64)
    for k in range(8):
        window |= stream[k : k + n] << np.uint64(56 - 8 * k)
    lookup = np.concatenate([t.decoder() for t in tables])
    width = max(len(x) for x in layouts)
    dc_table, ac_table = np.zeros((len(layouts), width), dtype=np.int64), np.zeros((len(layouts), width), dtype=np.int64)
    length = np.array([len(x) for x in layouts])
    for k, own in enumerate(layouts):
        dc_table[k, : len(own)] = [x[0] << 16 for x in own]
        ac_table[k, : len(own)] = [x[1] << 16 for x in own]
    bit = np.concatenate(starts).astype(np.int64) * 8
    block, left, kind = np.concatenate(first), np.concatenate(count), np.concatenate(layout_of)
    k, turn = np.zeros(len(bit), dtype=np.int64), np.zeros(len(bit), dtype=np.int64)
    out = np.zeros(total * 64, dtype=np.int32)
    simple = len(layouts) == 1 and width == 1
    while len(bit):
        bits = window[np.minimum(bit >> 3, n - 1)] << (bit & 7).astype(np.uint64)
        if simple:
            table = np.where(k == 0, dc_table[0, 0], ac_table[0, 0])
        else:
            table = np.where(k == 0, dc_table[kind, turn], ac_table[kind, turn])
        entry = lookup[table + (bits >> np.uint64(48)).astype(np.int64)]
        if not entry.all():
            raise ValueError("the scan holds a code that is in no table")
        used, symbol = entry >> 8, entry & 255
        size, run = symbol & 15, np.where(k == 0, 0, symbol >> 4)
        rest = bits << used.astype(np.uint64)
        value = (rest >> np.uint64(1) >> (63 - size).astype(np.uint64)).astype(np.int64)
        value -= np.where(rest >> np.uint64(63), 0, (1 << size) - 1)
        place = k + run
        if place.max() > 63:
            raise ValueError("the scan holds more coefficients than a block has")
        out[block * 64 + place] = value  # zero where only zeros are skipped
        ended = (k > 0) & (symbol == 0)
        k = np.where(ended, 64, place + 1)
        bit += used + size
        full = k == 64
        block, left, k = block + full, left - full, np.where(full, 0, k)
        if not simple:
            turn = turn + full
            turn = np.where(turn == length[kind], 0, turn)
        if not left.all():
            on = left > 0
            bit, block, left, k, turn, kind = bit[on], block[on], left[on], k[on], turn[on], kind[on]
    out = out.reshape(-1, 64)
    result, at = [], 0
    for f, size in zip(frames, sizes, strict=True):
        own = out[at : at + size]
        wide, high = f.mcus
        layout = f.layout
        per = (f.restart or wide * high) * len(layout)
        for c in range(len(f.parts)):
            mine = np.nonzero(np.tile(np.array(layout) == c, wide * high))[0]
            summed = np.cumsum(own[mine, 0], dtype=np.int64)
            begins = np.nonzero(np.diff(mine // per, prepend=-1))[0]
            offset = np.concatenate(([0], summed))[begins]
            own[mine, 0] = summed - np.repeat(offset, np.diff(np.append(begins, len(mine))))
        result.append((f, own))
        at += size
    return result


def thumbnail(frame: Frame, blocks: np.ndarray) -> np.ndarray:
    """DC-only luminance, one pixel for each 8x8 block, as the file's rows and columns."""
    h, v = (1, 1) if len(frame.parts) == 1 else frame.parts[0][1:3]
    wide, high = frame.mcus
    layout = np.array(frame.layout)
    dc = blocks.reshape(high, wide, len(layout), 64)[:, :, layout == 0, 0].reshape(high, wide, v, h)
    grid = dc.transpose(0, 2, 1, 3).reshape(high * v, wide * h)
    step = int(frame.quant[frame.parts[0][3]][0])
    grid = np.clip((grid.astype(np.int64) * step + 4) // 8 + 128, 0, 255).astype(np.uint8)
    return grid[: -(-frame.height // 8), : -(-frame.width // 8)]


def thumbnail_hash(grid: np.ndarray) -> int:
    """A 64-bit difference hash: the thumbnail averaged to 8 x 9 cells, each compared with its right neighbour."""
    rows = np.linspace(0, grid.shape[0], 9).astype(int)
    cols = np.linspace(0, grid.shape[1], 10).astype(int)
    sums = np.zeros((grid.shape[0] + 1, grid.shape[1] + 1), dtype=np.int64)
    sums[1:, 1:] = grid.astype(np.int64).cumsum(0).cumsum(1)
    top, bottom = np.minimum(rows[:-1], grid.shape[0] - 1), np.maximum(rows[1:], np.minimum(rows[:-1], grid.shape[0] - 1) + 1)
    west, east = np.minimum(cols[:-1], grid.shape[1] - 1), np.maximum(cols[1:], np.minimum(cols[:-1], grid.shape[1] - 1) + 1)
    total = sums[np.ix_(bottom, east)] - sums[np.ix_(top, east)] - sums[np.ix_(bottom, west)] + sums[np.ix_(top, west)]
    mean = total * 256 // ((bottom - top)[:, None] * (east - west)[None, :])
    return int("".join("1" if x else "0" for x in (mean[:, 1:] > mean[:, :-1]).ravel()), 2)


def read_payload(frame: Frame, blocks: np.ndarray) -> bytes:
    """The payload of a file made by write()."""
    if not frame.comment.startswith(b"payload="):
        raise ValueError("the file holds no payload")
    return (blocks[: int(frame.comment[8:]) // BLOCK] + 128).astype(np.uint8).tobytes()


def media_rows(texts: list[str]) -> list[tuple]:
    """n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, width, height, media of each text."""
    out: list[tuple] = []
    media = [write(payload_of(t)) for t in texts]
    at = 0
    while at < len(media):
        end, size = at, 0
        while end < len(media) and (end == at or size + len(media[end]) <= PIECE_BYTES):
            size += len(media[end])
            end += 1
        for t, m, (frame, blocks) in zip(texts[at:end], media[at:end], decode(media[at:end]), strict=True):
            payload = read_payload(frame, blocks)
            grid = thumbnail(frame, blocks)
            feature = f"{frame.width}x{frame.height}:{grid.shape[1]}x{grid.shape[0]}:{thumbnail_hash(grid):016x}"
            tail = zlib.crc32(payload[-BLOCK:])
            out.append((len(t.encode()), len(payload), hashlib.sha256(payload).hexdigest(), tail, len(m), hashlib.sha256(m).hexdigest(), feature, frame.width, frame.height, m))
        at = end
    return out


def media_columns(df: DataFrame, keep: list[str], text_col: str = "text", files: bool = False) -> DataFrame:
    """``keep`` and the media columns of every whole text; with ``files`` also the stored file; narrow, no shuffle."""
    schema = (
        "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, "
        "width int, height int" + (", media binary" if files else "")
    )

    def make() -> Callable[[list[str]], list[list]]:
        def work(texts: list[str]) -> list[list]:
            rows = media_rows(texts)
            return [[r[i] for r in rows] for i in range(10 if files else 9)]

        return work

    return map_texts(df, keep, text_col, schema, make)
