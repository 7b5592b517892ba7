"""Media columns: payloads stored in baseline JPEG files, read back by an own decoder.

The decoder parses markers and Huffman-decodes the scans of baseline JPEG files in numpy. Restart intervals are
independent bit streams, so all intervals of all files of a batch are decoded in lock-step: each step reads one symbol
and its extra bits from every stream. The DC coefficients alone, times their quantisers, give the luminance thumbnail.

A payload is stored losslessly in the format's own unit, the quantised coefficient: 64 bytes fill a block in zigzag
order. Byte b becomes b - 255 below 128 and b from there on, so that each coefficient has size category 8 and its
extra bits are the byte itself; a restart marker after each block keeps DC values free of prediction.

Columns of media_documents: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256,
feature, width, height. feature is width x height, an average hash and a difference hash of the 8 x 8 thumbnail, and
the CRC of the full thumbnail.

Defined cases: a null text counts as empty and fills one block of zeros; equal texts give equal values; an empty table
gives an empty result; any further columns are ignored; a file that is not baseline JPEG raises ValueError.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from vitalframe.llm.common import pick, small_batches

#: Bytes of payload that are encoded or decoded at once.
CHUNK = 2 << 20
#: Fixed value: the largest side of a JPEG image in pixels, in blocks.
MOST_BLOCKS = 65535 // 8
#: Quantiser of DC coefficients in written files; spreads a byte over half the luminance range. AC coefficients take 1.
DC_STEP = 4


# --- writing -----------------------------------------------------------------------------------------------------


def _marker(code: int, body: bytes) -> bytes:
    return bytes([0xFF, code]) + (len(body) + 2).to_bytes(2, "big") + body


def _head(width: int, height: int, payload: int) -> bytes:
    one_code = lambda kind, symbols: bytes([kind]) + bytes([1] * len(symbols) + [0] * (16 - len(symbols))) + bytes(symbols)
    return b"".join([
        b"\xff\xd8",
        _marker(0xFE, b"payload " + str(payload).encode()),
        _marker(0xDB, bytes([0, DC_STEP] + [1] * 63)),
        _marker(0xC0, bytes([8]) + height.to_bytes(2, "big") + width.to_bytes(2, "big") + bytes([1, 1, 0x11, 0])),
        _marker(0xC4, one_code(0x00, [8])),  # DC: '0' is size 8
        _marker(0xC4, one_code(0x10, [0x08, 0x00, 0xF0])),  # AC: '0' is a size 8 without a run, '10' end of block, '110' 16 zeros
        _marker(0xDD, (1).to_bytes(2, "big")),
        _marker(0xDA, bytes([1, 1, 0x00, 0, 63, 0])),
    ])


def grid(blocks: int) -> tuple[int, int]:
    """Rows and columns of blocks: as few rows as the format allows, and no more blocks than that needs."""
    rows = -(-blocks // MOST_BLOCKS)
    if rows > MOST_BLOCKS:
        raise ValueError("the payload exceeds one JPEG file")
    return rows, -(-blocks // rows)


def encode_payload(payload: bytes) -> bytes:
    """A baseline JPEG file whose coefficients are the payload, whose length is a positive multiple of 64."""
    blocks = len(payload) // 64
    rows, columns = grid(blocks)
    head = _head(8 * columns, 8 * rows, len(payload))
    return head + _scan(np.frombuffer(payload + bytes(64 * (rows * columns - blocks)), np.uint8)) + b"\xff\xd9"


def _scan(data: np.ndarray) -> bytes:
    out, total = [], len(data) // 64
    for at in range(0, total, CHUNK // 64):
        part = data[64 * at : 64 * at + CHUNK].reshape(-1, 64)
        n = len(part)
        bits = np.zeros((n * 64, 9), np.uint8)
        bits[:, 1:] = np.unpackbits(part.reshape(-1)).reshape(-1, 8)
        rows = np.empty((n, 74), np.uint8)
        rows[:, :72] = np.packbits(bits.reshape(n, 576), axis=1)
        rows[:, 72] = 0xFF
        rows[:, 73] = 0xD0 + (np.arange(at, at + n) & 7)
        stuffed = rows == 0xFF
        stuffed[:, 72] = False
        flat, twice = rows.reshape(-1), stuffed.reshape(-1)
        where = np.flatnonzero(twice)
        if len(where):
            flat = np.repeat(flat, 1 + twice)
            flat[where + np.arange(1, len(where) + 1)] = 0
        out.append(flat.tobytes())
    return b"".join(out)[:-2]  # no restart marker after the last block


# --- reading -----------------------------------------------------------------------------------------------------


@dataclass
class Parsed:
    """What a file's markers say, and its entropy-coded intervals without stuffing."""

    width: int = 0
    height: int = 0
    quantisers: dict[int, np.ndarray] = field(default_factory=dict)
    tables: dict[int, bytes] = field(default_factory=dict)  # by class << 4 | id: the 16 counts and the symbols
    components: list[tuple[int, int, int, int]] = field(default_factory=list)  # id, horizontal, vertical, quantiser
    order: list[tuple[int, int, int]] = field(default_factory=list)  # of the scan: component's place, DC and AC table
    interval: int = 0
    comment: bytes = b""
    data: np.ndarray | None = None  # intervals one after another
    starts: np.ndarray | None = None  # where each begins


def parse(file: bytes) -> Parsed:
    """Read the markers of a baseline JPEG file up to its scan and cut the scan at its restart markers."""
    if file[:2] != b"\xff\xd8":
        raise ValueError("no start of image")
    p, at = Parsed(), 2
    while True:
        while file[at : at + 1] == b"\xff" and file[at + 1 : at + 2] == b"\xff":
            at += 1
        if at + 4 > len(file) or file[at] != 0xFF:
            raise ValueError("a marker is missing")
        code, size = file[at + 1], int.from_bytes(file[at + 2 : at + 4], "big")
        body = file[at + 4 : at + 2 + size]
        at += 2 + size
        if code == 0xC0:
            if body[0] != 8:
                raise ValueError("samples are not 8 bits wide")
            p.height, p.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            p.components = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(body[5])]
        elif 0xC1 <= code <= 0xCF and code not in (0xC4, 0xC8, 0xCC):
            raise ValueError("not a baseline file")
        elif code == 0xC4:
            while body:
                n = 17 + sum(body[1:17])
                p.tables[body[0]], body = body[1:n], body[n:]
        elif code == 0xDB:
            while body:
                wide = body[0] >> 4
                n = 65 + 64 * wide
                p.quantisers[body[0] & 15] = np.frombuffer(body[1:n], ">u2" if wide else np.uint8).astype(np.int64)
                body = body[n:]
        elif code == 0xDD:
            p.interval = int.from_bytes(body, "big")
        elif code == 0xFE:
            p.comment = body
        elif code == 0xDA:
            place = {c[0]: i for i, c in enumerate(p.components)}
            p.order = [(place[body[1 + 2 * i]], body[2 + 2 * i] >> 4, 0x10 | body[2 + 2 * i] & 15) for i in range(body[0])]
            break
    raw = np.frombuffer(file, np.uint8, offset=at)
    full = np.flatnonzero(raw[:-1] == 0xFF)
    follows = raw[full + 1]
    ends = full[(follows != 0) & ((follows < 0xD0) | (follows > 0xD7)) & (follows != 0xFF)]
    end = int(ends[0]) if len(ends) else len(raw)
    full, follows = full[full < end], follows[full < end]
    keep = np.ones(end, bool)
    keep[full[follows == 0] + 1] = False
    cut = full[(follows >= 0xD0) & (follows <= 0xD7)]
    keep[cut] = keep[cut + 1] = False
    p.data = raw[:end][keep]
    before = np.concatenate([[0], np.cumsum(keep)])
    p.starts = np.concatenate([[0], before[cut]]).astype(np.int64)
    return p


def _lookup(table: bytes) -> np.ndarray:
    """Code length << 8 | symbol for each 16 bits that may follow; 0 where no code fits."""
    out, code, at = np.zeros(1 << 16, np.uint32), 0, 16
    for length in range(1, 17):
        for _ in range(table[length - 1]):
            first = code << (16 - length)
            out[first : first + (1 << (16 - length))] = length << 8 | table[at]
            code, at = code + 1, at + 1
        code <<= 1
    return out


def _layout(p: Parsed) -> tuple[list[tuple[int, int, int]], int, list[tuple[int, int]]]:
    """The blocks of one coded unit (component, DC table, AC table), the number of units, each component's blocks down and across."""
    widest, tallest = max(c[1] for c in p.components), max(c[2] for c in p.components)
    if len(p.order) == 1:  # one component: units are its own blocks
        c = p.components[p.order[0][0]]
        across = -(-(-(-p.width * c[1] // widest)) // 8)
        down = -(-(-(-p.height * c[2] // tallest)) // 8)
        return [p.order[0]], across * down, [(down, across)]
    unit = [o for o in p.order for _ in range(p.components[o[0]][1] * p.components[o[0]][2])]
    across, down = -(-p.width // (8 * widest)), -(-p.height // (8 * tallest))
    return unit, across * down, [(down * p.components[o[0]][2], across * p.components[o[0]][1]) for o in p.order]


def decode_coefficients(files: list[Parsed]) -> list[np.ndarray]:
    """Each file's coefficients in scan order, (blocks, 64) in zigzag order, DC predictions undone.

    A lane is one restart interval; lanes of all files advance together, one symbol a step.
    """
    tables: dict[bytes, int] = {}
    units, data, at = [], [], 0
    bit, blocks, base, dc, ac, per_unit, shapes = [], [], [], [], [], [], []
    total = 0
    for p in files:
        unit, n, _ = _layout(p)
        every = p.interval or n
        lanes = -(-n // every)
        if lanes > len(p.starts):
            raise ValueError("restart intervals are missing")
        of = [(tables.setdefault(p.tables[d], len(tables)), tables.setdefault(p.tables[a], len(tables))) for _, d, a in unit]
        units.append((of, [c for c, _, _ in unit]))
        count = np.full(lanes, every * len(unit), np.int64)
        count[-1] = (n - every * (lanes - 1)) * len(unit)
        bit.append((p.starts[:lanes] + at) * 8)
        blocks.append(count)
        base.append(total + np.arange(lanes, dtype=np.int64) * every * len(unit))
        per_unit.append(np.full(lanes, len(units) - 1))
        shapes.append((total, n * len(unit)))
        total += n * len(unit)
        data.append(p.data)
        at += len(p.data)
    longest = max(len(u[0]) for u in units)
    dc_of, ac_of, size_of = (np.zeros((len(units), longest), np.int64), np.zeros((len(units), longest), np.int64), np.array([len(u[0]) for u in units]))
    for i, (of, _) in enumerate(units):
        for j, (d, a) in enumerate(of):
            dc_of[i, j], ac_of[i, j] = d, a
    codes = np.concatenate([_lookup(t) for t in tables])
    buffer = np.concatenate([*data, np.full(16, 0xFF, np.uint8)])
    words = np.ndarray(shape=(len(buffer) - 8,), dtype=">u8", buffer=buffer, strides=(1,))
    out = np.zeros((total, 64), np.int16)
    flat = out.reshape(-1)
    pos, left, block, unit_of = np.concatenate(bit), np.concatenate(blocks), np.concatenate(base), np.concatenate(per_unit)
    k, turn = np.zeros(len(pos), np.int64), np.zeros(len(pos), np.int64)
    table = dc_of[unit_of, 0] << 16
    end = len(words) - 1
    while len(pos):
        w = words[np.minimum(pos >> 3, end)].astype(np.uint64) << (pos & 7).astype(np.uint64)
        found = codes[table + (w >> np.uint64(48)).astype(np.int64)].astype(np.int64)
        length, symbol = found >> 8, found & 255
        if not length.all():
            raise ValueError("bits that are no code")
        size, run = symbol & 15, symbol >> 4
        extra = ((w << length.astype(np.uint64)) >> np.uint64(1) >> (63 - size).astype(np.uint64)).astype(np.int64)
        value = np.where(extra < (1 << size >> 1), extra - (1 << size) + 1, extra)
        pos = pos + length + size
        is_ac = k > 0
        target = k + np.where(is_ac, run, 0)
        if (target > 63).any() and ((target > 63) & (size > 0)).any():
            raise ValueError("a coefficient beyond its block")
        flat[block * 64 + np.minimum(target, 63)] += np.where(size > 0, value, 0).astype(np.int16)
        k = np.where(is_ac & (size == 0) & (run < 15), 64, target + 1)
        done = k >= 64
        if done.any() or not is_ac.all():
            left, block, turn = left - done, block + done, turn + done
            if longest > 1:
                turn = turn % size_of[unit_of]
            else:
                turn = np.zeros_like(turn)
            k = np.where(done, 0, k)
            table = np.where(k == 0, dc_of[unit_of, turn], ac_of[unit_of, turn]) << 16
            live = left > 0
            if not live.all():
                pos, left, block, unit_of, k, turn, table = (x[live] for x in (pos, left, block, unit_of, k, turn, table))
    result = []
    for (first, n), p, (of, comps) in zip(shapes, files, units):
        own = out[first : first + n]
        every = p.interval * len(of) or n
        if every > 1:
            order = np.resize(np.array(comps), n)
            for c in set(comps):
                mine = np.flatnonzero(order == c)
                diff = own[mine, 0].astype(np.int64)
                sums = np.cumsum(diff)
                group = mine // every
                begins = np.searchsorted(group, group)
                own[mine, 0] = sums - np.where(begins > 0, sums[begins - 1], 0)
        result.append(own)
    return result


def thumbnail(p: Parsed, coefficients: np.ndarray) -> np.ndarray:
    """One luminance pixel per block of the first component, from its DC coefficient alone."""
    unit, n, sides = _layout(p)
    dc = coefficients[:, 0].astype(np.int64) * int(p.quantisers[p.components[p.order[0][0]][3]][0])
    grey = np.clip((dc + 4) // 8 + 128, 0, 255).astype(np.uint8)
    down, across = sides[0]
    if len(p.order) == 1:
        return grey.reshape(down, across)
    c = p.components[p.order[0][0]]
    high, wide = c[2], c[1]
    first = grey.reshape(n, len(unit))[:, : high * wide]
    return first.reshape(down // high, across // wide, high, wide).transpose(0, 2, 1, 3).reshape(down, across)


def _resized(image: np.ndarray, rows: int, columns: int) -> np.ndarray:
    """Means over equal shares of the image; small images repeat their pixels."""
    def shares(n: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
        low = np.arange(parts) * n // parts
        return low, np.maximum(low + 1, (np.arange(parts) + 1) * n // parts)

    sums = np.zeros((image.shape[0] + 1, image.shape[1] + 1), np.int64)
    sums[1:, 1:] = image.astype(np.int64).cumsum(0).cumsum(1)
    (top, bottom), (a, b) = shares(image.shape[0], rows), shares(image.shape[1], columns)
    area = (bottom - top)[:, None] * (b - a)[None, :]
    return (sums[bottom][:, b] - sums[top][:, b] - sums[bottom][:, a] + sums[top][:, a]) // area


def feature_of(p: Parsed, image: np.ndarray) -> str:
    small, wider = _resized(image, 8, 8), _resized(image, 8, 9)
    bits = lambda x: np.packbits(x.reshape(-1)).tobytes().hex()
    return f"{p.width}x{p.height}:{bits(small * 64 > small.sum())}:{bits(wider[:, 1:] > wider[:, :-1])}:{zlib.crc32(image.tobytes()):08x}"


def payload_of(p: Parsed, coefficients: np.ndarray) -> bytes:
    """The bytes that encode_payload stored."""
    size = int(p.comment.removeprefix(b"payload "))
    value = coefficients.reshape(-1)[:size]
    return np.where(value < 0, value + 255, value).astype(np.uint8).tobytes()


def _digest(texts: list[bytes]) -> Iterator[tuple]:
    """Store each text, read the stored files back together, and describe them."""
    files = [encode_payload(t + bytes(-len(t) % 64 if t else 64)) for t in texts]
    parsed = [parse(f) for f in files]
    for t, f, p, c in zip(texts, files, parsed, decode_coefficients(parsed)):
        payload = payload_of(p, c)
        yield (len(t), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(f), hashlib.sha256(f).hexdigest(), feature_of(p, thumbnail(p, c)), p.width, p.height)


def media_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every text through its stored form, inside its own scan task: nothing is shuffled."""
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32()]
    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [(t or "").encode() for t in b.column(1).to_pylist()]
            rows, some, held = [], [], 0
            for t in texts:
                some.append(t)
                held += len(t) + 64
                if held >= CHUNK:
                    rows += _digest(some)
                    some, held = [], 0
            if some:
                rows += _digest(some)
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(x, kind) for x, kind in zip(zip(*rows) if rows else [[]] * len(kinds), kinds)]], ["doc_id", *names])

    rows = small_batches(pick(docs, doc_id, text)).toDF("doc_id", "text")
    columns = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, width int, height int"
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {columns}")
