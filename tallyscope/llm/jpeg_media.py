"""Baseline JPEG columns: store bytes as DC-only images, read dimensions and thumbnails back.

Reading follows the public baseline standard: markers are parsed, scans are Huffman-decoded far
enough to keep the DC coefficient of every block, and the luminance DC plane is the picture at one
eighth of its size. All restart intervals of all images of a batch are decoded side by side as
lanes of numpy arrays, one symbol (or one flat block) of every lane per step.

Writing puts one payload byte into one flat 8x8 block: a quantised DC coefficient of byte - 128
with step 8 gives samples equal to the byte, so the thumbnail holds the payload without loss. Rows
of 64 blocks are restart intervals; payloads above the height limit continue in a further image.
"""
from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyscope.llm.common import by_size, short_batches, text_of

#: Blocks in a row, rows in one image (65,535 samples), payload bytes handled at once by a task.
ROW = 64
MOST_ROWS = 8191
AT_ONCE = 1 << 20

#: Code lengths of the standard luminance DC table; its symbols are 0 to 11.
DC_LENGTHS = (0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0)
#: The AC table of written images: one code, for "end of block".
AC_LENGTHS = (1, *[0] * 15)
_END_OF_SCAN = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]")


class BadImage(ValueError):
    """Not a baseline JPEG, or cut short."""


def _codes(lengths: tuple[int, ...], symbols: bytes) -> list[tuple[int, int, int]]:
    """Canonical Huffman codes as (symbol, code, length)."""
    found, code, at = [], 0, 0
    for length, n in enumerate(lengths, 1):
        for _ in range(n):
            found.append((symbols[at], code, length))
            code, at = code + 1, at + 1
        code <<= 1
    return found


def _lookup(lengths: tuple[int, ...], symbols: bytes) -> np.ndarray:
    """length * 256 + symbol by the next 16 bits; 0 where no code matches."""
    table = np.zeros(1 << 16, np.uint32)
    for symbol, code, length in _codes(lengths, symbols):
        low = code << (16 - length)
        table[low:low + (1 << (16 - length))] = length << 8 | symbol
    return table


# --- writing -----------------------------------------------------------------------------------

def _segment(marker: int, body: bytes) -> bytes:
    return bytes((0xFF, marker)) + (len(body) + 2).to_bytes(2, "big") + body


def _header(rows: int) -> bytes:
    height, width = 8 * rows, 8 * ROW
    return b"".join((
        b"\xff\xd8", _segment(0xDB, bytes([0, 8]) + bytes([1] * 63)),
        _segment(0xC0, bytes([8]) + height.to_bytes(2, "big") + width.to_bytes(2, "big") + bytes([1, 1, 0x11, 0])),
        _segment(0xC4, bytes([0x00, *DC_LENGTHS, *range(12)])),
        _segment(0xC4, bytes([0x10, *AC_LENGTHS, 0])),
        _segment(0xDD, ROW.to_bytes(2, "big")),
        _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0])),
    ))


def _block_codes() -> tuple[np.ndarray, np.ndarray]:
    """Bits and bit count of a flat block by its DC difference + 255: DC code, value bits, end of block."""
    code = {symbol: (bits, length) for symbol, bits, length in _codes(DC_LENGTHS, bytes(range(12)))}
    bits, counts = np.zeros(511, np.uint64), np.zeros(511, np.uint64)
    for diff in range(-255, 256):
        size = abs(diff).bit_length()
        value = diff if diff >= 0 else diff + (1 << size) - 1
        head, length = code[size]
        bits[diff + 255] = (head << size | value) << 1
        counts[diff + 255] = length + size + 1
    return bits, counts


def _entropy_rows(payload: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Entropy-coded bytes (without stuffing) of all rows of 64 payload bytes, and bytes per row."""
    level = payload.reshape(-1, ROW).astype(np.int16) - 128
    diff = level.copy()
    diff[:, 1:] -= level[:, :-1]
    diff += 255
    bits, counts = tables[0][diff], tables[1][diff]
    for _ in range(2):  # four blocks of at most 15 bits share one 64-bit value
        bits = bits[:, ::2] << counts[:, 1::2] | bits[:, 1::2]
        counts = counts[:, ::2] + counts[:, 1::2]
    length = counts.sum(1)
    n_bytes = (length + np.uint64(7)) >> np.uint64(3)
    pad = (n_bytes << np.uint64(3)) - length
    bits = np.concatenate([bits, ((np.uint64(1) << pad) - np.uint64(1))[:, None]], axis=1)
    counts = np.concatenate([counts, pad[:, None]], axis=1)
    row_start = (np.cumsum(n_bytes) - n_bytes) << np.uint64(3)
    start = (row_start[:, None] + np.cumsum(counts, axis=1) - counts).ravel()
    bits, counts = bits.ravel(), counts.ravel()
    word, inside = (start >> np.uint64(6)).astype(np.int64), start & np.uint64(63)
    total = int(n_bytes.sum())
    words = np.zeros(total // 8 + 2, np.uint64)
    fits = inside + counts <= 64
    left = np.where(fits, np.uint64(64) - inside - counts, np.uint64(0)) & np.uint64(63)
    over = np.where(fits, np.uint64(0), inside + counts - np.uint64(64))
    np.add.at(words, word, np.where(counts == 0, np.uint64(0), bits << left >> over))
    cut = ~fits
    np.add.at(words, word[cut] + 1, bits[cut] << (np.uint64(64) - over[cut]))
    return words.astype(">u8").view(np.uint8)[:total], n_bytes.astype(np.int64)


def encode_payloads(payloads: list[bytes]) -> list[bytes]:
    """Store byte strings (lengths: positive multiples of 64) as concatenated baseline JPEG images."""
    if not payloads:
        return []
    pieces = [(i, p[at:at + ROW * MOST_ROWS]) for i, p in enumerate(payloads) for at in range(0, len(p), ROW * MOST_ROWS)]
    data, per_row = _entropy_rows(np.frombuffer(b"".join(p for _, p in pieces), np.uint8), _block_codes())
    rows = np.array([len(p) // ROW for _, p in pieces])
    full = data == 0xFF
    headers = [_header(int(r)) for r in rows]
    last_row = np.zeros(len(per_row), bool)
    last_row[np.cumsum(rows) - 1] = True
    first_row = np.r_[True, last_row[:-1]]
    before = np.zeros(len(per_row), np.int64)
    before[first_row] = [len(h) for h in headers]
    row_at = np.repeat(np.arange(len(per_row)), per_row)
    ends = np.cumsum(per_row)
    stuffed = np.add.reduceat(full, ends - per_row, dtype=np.int64)
    size = before + per_row + stuffed + 2
    begin = np.cumsum(size) - size + before
    out = np.zeros(int(size.sum()), np.uint8)
    seen = np.cumsum(full) - full
    place = np.arange(len(data)) - (ends - per_row)[row_at] + begin[row_at] + seen - seen[(ends - per_row)][row_at]
    out[place] = data
    tail = begin + per_row + stuffed
    in_image = np.arange(len(per_row)) - np.repeat(np.cumsum(rows) - rows, rows)
    out[tail] = 0xFF
    out[tail + 1] = np.where(last_row, 0xD9, 0xD0 + in_image % 8)
    starts = (begin - before)[first_row]
    for at, header in zip(starts.tolist(), headers):
        out[at:at + len(header)] = np.frombuffer(header, np.uint8)
    bounds = [*starts.tolist(), len(out)]
    images: list[list[bytes]] = [[] for _ in payloads]
    raw = out.tobytes()
    for (i, _), low, high in zip(pieces, bounds, bounds[1:]):
        images[i].append(raw[low:high])
    return [b"".join(parts) for parts in images]


# --- reading -----------------------------------------------------------------------------------

@dataclass
class Frame:
    """One image: its size, its components and the scans that carry them."""
    width: int = 0
    height: int = 0
    #: (id, horizontal factor, vertical factor, quantiser number)
    components: list[tuple[int, int, int, int]] = field(default_factory=list)
    quantisers: dict[int, int] = field(default_factory=dict)
    #: (components as indices, DC tables, AC tables, restart interval, entropy-coded bytes)
    scans: list[tuple[list[int], list[bytes], list[bytes], int, bytes]] = field(default_factory=list)
    #: DC plane of the first component, filled in by decoding
    thumbnail: np.ndarray | None = None


def parse_images(data: bytes) -> list[Frame]:
    """Read the markers of one or several concatenated baseline images."""
    frames, at = [], 0
    while at < len(data):
        if data[at:at + 2] != b"\xff\xd8":
            raise BadImage("no start of image")
        frame, at = _parse_one(data, at + 2)
        frames.append(frame)
    if not frames:
        raise BadImage("empty")
    return frames


def _parse_one(data: bytes, at: int) -> tuple[Frame, int]:
    frame, tables, interval = Frame(), {}, 0
    while True:
        if at + 4 > len(data) and data[at:at + 2] != b"\xff\xd9" or data[at] != 0xFF:
            raise BadImage("a marker is missing")
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        if marker == 0xD9:
            if not frame.scans:
                raise BadImage("no scan")
            return frame, at + 2
        size = int.from_bytes(data[at + 2:at + 4], "big")
        body = data[at + 4:at + 2 + size]
        if len(body) != size - 2:
            raise BadImage("a segment is cut short")
        at += 2 + size
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                frame.quantisers[body[0] & 15] = int.from_bytes(body[1:3], "big") if wide else body[1]
                body = body[1 + 64 * (1 + wide):]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                tables[body[0]] = body[1:17 + n]
                body = body[17 + n:]
        elif marker in (0xC0, 0xC1):
            if body[0] != 8:
                raise BadImage("samples are not 8 bits")
            frame.height, frame.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            frame.components = [(c[0], c[1] >> 4, c[1] & 15, c[2]) for c in (body[6 + 3 * i:9 + 3 * i] for i in range(body[5]))]
            if not (frame.height and frame.width and frame.components):
                raise BadImage("no size")
        elif 0xC2 <= marker <= 0xCF and marker != 0xC8 and marker != 0xCC:
            raise BadImage("not baseline")
        elif marker == 0xDD:
            interval = int.from_bytes(body[:2], "big")
        elif marker == 0xDA:
            ids = [c[0] for c in frame.components]
            chosen = [(body[1 + 2 * i], body[2 + 2 * i]) for i in range(body[0])]
            end = _END_OF_SCAN.search(data, at)
            if not end:
                raise BadImage("the scan does not end")
            try:
                frame.scans.append(([ids.index(c) for c, _ in chosen], [tables[t >> 4] for _, t in chosen],
                                    [tables[16 + (t & 15)] for _, t in chosen], interval, data[at:end.start()]))
            except (KeyError, ValueError):
                raise BadImage("a scan names an unknown table or component") from None
            at = end.start()


def _scan_shape(frame: Frame, chosen: list[int]) -> tuple[list[int], int, list[tuple[int, int]]]:
    """Component of each block in a coding unit, number of units, blocks (rows, columns) per component."""
    most_h = max(c[1] for c in frame.components)
    most_v = max(c[2] for c in frame.components)
    grid = []
    for _, h, v, _ in frame.components:
        rows = -(-(-(-frame.height * v // most_v)) // 8)
        columns = -(-(-(-frame.width * h // most_h)) // 8)
        grid.append((rows, columns))
    if len(chosen) == 1:
        return [chosen[0]], grid[chosen[0]][0] * grid[chosen[0]][1], grid
    units = -(-frame.width // (8 * most_h)) * -(-frame.height // (8 * most_v))
    return [c for c in chosen for _ in range(frame.components[c][1] * frame.components[c][2])], units, grid


def _lanes(entropy: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Bytes without stuffing and restart markers, and where each restart interval begins."""
    raw = np.frombuffer(entropy, np.uint8)
    marks = np.flatnonzero(raw[:-1] == 0xFF) if len(raw) else np.zeros(0, np.int64)
    gone = np.ones(len(raw), bool)
    gone[marks[raw[marks + 1] == 0] + 1] = False
    restarts = marks[(raw[marks + 1] >= 0xD0) & (raw[marks + 1] <= 0xD7)]
    gone[restarts] = False
    gone[restarts + 1] = False
    kept = np.cumsum(gone)
    return raw[gone], np.r_[0, kept[restarts]].astype(np.int64)


def decode_frames(frames: list[Frame]) -> None:
    """Fill in the thumbnails: one DC value per luminance block, as samples of 0 to 255."""
    groups: dict[tuple, list[tuple[Frame, int]]] = {}
    for frame in frames:
        for s, (chosen, dc, ac, _, _) in enumerate(frame.scans):
            units = tuple(_scan_shape(frame, chosen)[0])
            if 0 in chosen:
                groups.setdefault((units, tuple(dc), tuple(ac), tuple(chosen)), []).append((frame, s))
    for (units, dc, ac, chosen), members in groups.items():
        _decode_group(list(units), dc, ac, chosen, members)
    for frame in frames:
        if frame.thumbnail is None:
            raise BadImage("no luminance scan")


def _decode_group(units: list[int], dc: tuple, ac: tuple, chosen: tuple, members: list[tuple[Frame, int]]) -> None:
    """Decode scans that share tables and layout, all restart intervals side by side."""
    tables = np.stack([_lookup(tuple(t[:16]), t[16:]) for t in (*dc, *ac)])
    slot = np.array([chosen.index(u) for u in units])
    per_unit, n_tables = len(units), len(dc)
    chunks, starts, lane_blocks, shift, out_start = [], [], [], 0, []
    total_blocks, spans = 0, []
    for frame, s in members:
        _, n_units, _ = _scan_shape(frame, list(chosen))
        interval = frame.scans[s][3] or n_units
        data, begin = _lanes(frame.scans[s][4])
        n_lanes = -(-n_units // interval)
        if len(begin) != n_lanes:
            raise BadImage("restart markers do not match the size")
        blocks = np.full(n_lanes, interval * per_unit, np.int64)
        blocks[-1] = (n_units - interval * (n_lanes - 1)) * per_unit
        chunks.append(data)
        starts.append(begin + shift)
        lane_blocks.append(blocks)
        out_start.append(total_blocks + np.arange(n_lanes) * interval * per_unit)
        spans.append((total_blocks, n_units * per_unit))
        shift += len(data)
        total_blocks += n_units * per_unit
    data = np.concatenate([*chunks, np.full(16, 0xFF, np.uint8)])
    windows = np.ndarray((len(data) - 8,), ">u8", data, strides=(1,))
    position = np.concatenate(starts) * 8
    left, place = np.concatenate(lane_blocks), np.concatenate(out_start)
    levels = np.zeros(total_blocks, np.int32)
    predicted = np.zeros((len(left), n_tables), np.int64)
    done, coefficient = np.zeros(len(left), np.int64), np.zeros(len(left), np.int64)
    u = np.uint64
    end = len(windows) - 1
    lut, one = tables.ravel(), len(units) == 1
    while len(left):
        window = windows[np.minimum(position >> 3, end)].astype(np.uint64) << (position & 7).astype(np.uint64)
        which = np.zeros(len(left), np.int64) if one else slot[done % per_unit]
        fresh = coefficient == 0
        entry = lut[np.where(fresh, which, which + n_tables) << 16 | (window >> u(48)).astype(np.int64)].astype(np.int64)
        length, symbol = entry >> 8, entry & 255
        if not length.all():
            raise BadImage("a code is unknown")
        size = symbol & 15
        bits = (window << length.astype(np.uint64) >> u(1) >> (63 - size).astype(np.uint64)).astype(np.int64)
        value = np.where(bits >> np.maximum(size - 1, 0), bits, bits - (1 << size) + 1)
        value[size == 0] = 0
        used = length + size
        # a block whose next code ends it is finished in the same step
        after = (window << used.astype(np.uint64) >> u(48)).astype(np.int64)
        follow = lut[(which + n_tables) << 16 | after].astype(np.int64)
        flat = fresh & ((follow & 255) == 0) & (follow > 0)
        position = position + used + np.where(flat, follow >> 8, 0)
        if fresh.all():
            lanes = np.arange(len(left))
            predicted[lanes, which] += value
            levels[place + done] = predicted[lanes, which]
        else:
            lanes = np.flatnonzero(fresh)
            predicted[lanes, which[lanes]] += value[lanes]
            levels[place[lanes] + done[lanes]] = predicted[lanes, which[lanes]]
        run = np.where(symbol == 0xF0, 16, np.where(symbol == 0, 64, (symbol >> 4) + 1))
        coefficient = np.where(flat, 64, np.where(fresh, 1, coefficient + run))
        finished = coefficient > 63
        done = done + finished
        coefficient = np.where(finished, 0, coefficient)
        if (done == left).any():
            stay = done < left
            position, left, place, done, coefficient, predicted = (
                x[stay] for x in (position, left, place, done, coefficient, predicted))
    for (frame, _), (low, n) in zip(members, spans):
        frame.thumbnail = _plane(frame, units, chosen, levels[low:low + n])


def _plane(frame: Frame, units: list[int], chosen: tuple, levels: np.ndarray) -> np.ndarray:
    """Order the blocks of component 0 as a picture and turn levels into samples."""
    _, _, grid = _scan_shape(frame, list(chosen))
    rows, columns = grid[0]
    if len(chosen) > 1:
        _, h, v, _ = frame.components[0]
        across = -(-frame.width // (8 * max(c[1] for c in frame.components)))
        own = levels.reshape(-1, len(units))[:, [i for i, c in enumerate(units) if c == 0]]
        levels = own.reshape(-1, across, v, h).transpose(0, 2, 1, 3).reshape(-1, across * h)[:rows, :columns]
    step = frame.quantisers.get(frame.components[0][3])
    if step is None:
        raise BadImage("no quantiser")
    samples = np.floor_divide(levels.reshape(rows, columns).astype(np.int64) * step + 4, 8) + 128
    return np.clip(samples, 0, 255).astype(np.uint8)


def thumbnail_hash(thumbnail: np.ndarray) -> str:
    """64-bit average hash: which of 8x8 areas of the thumbnail are brighter than the mean."""
    rows, columns = thumbnail.shape
    at = np.arange(9)
    down, right = at * rows // 8, at * columns // 8
    sums = np.zeros((rows + 1, columns + 1), np.int64)
    np.cumsum(np.cumsum(thumbnail, 0, dtype=np.int64), 1, out=sums[1:, 1:])
    low_r, high_r = np.minimum(down[:8], rows - 1), np.maximum(down[1:], np.minimum(down[:8], rows - 1) + 1)
    low_c, high_c = np.minimum(right[:8], columns - 1), np.maximum(right[1:], np.minimum(right[:8], columns - 1) + 1)
    area = np.outer(high_r - low_r, high_c - low_c)
    cell = (sums[np.ix_(high_r, high_c)] - sums[np.ix_(low_r, high_c)] - sums[np.ix_(high_r, low_c)] + sums[np.ix_(low_r, low_c)])
    bits = cell * thumbnail.size > area * sums[-1, -1]
    return np.packbits(bits.ravel()).tobytes().hex()


# --- columns -----------------------------------------------------------------------------------

_STORED = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("n_bytes", T.LongType()),
    T.StructField("payload_bytes", T.LongType()), T.StructField("payload_sha256", T.StringType()),
    T.StructField("tail_crc32", T.LongType()), T.StructField("media_bytes", T.LongType()),
    T.StructField("media_sha256", T.StringType()), T.StructField("feature", T.StringType()),
])


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: list[list] = [[] for _ in _STORED.fields]
        buffers = [v.as_buffer() for v in batch.column(1)]
        for low, high in by_size([b.size + ROW for b in buffers], AT_ONCE):
            sizes = [b.size for b in buffers[low:high]]
            images = encode_payloads([
                b.to_pybytes() + bytes(max(ROW, -(-b.size // ROW) * ROW) - b.size) for b in buffers[low:high]])
            parsed = [parse_images(image) for image in images]
            decode_frames([f for frames in parsed for f in frames])
            for doc, size, image, frames in zip(batch.column(0)[low:high].to_pylist(), sizes, images, parsed):
                thumbnail = np.concatenate([f.thumbnail for f in frames])
                payload = thumbnail.tobytes()
                values = (
                    doc, size, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-ROW:]),
                    len(image), hashlib.sha256(image).hexdigest(),
                    f"{frames[0].width}x{sum(f.height for f in frames)}:{thumbnail_hash(thumbnail)}")
                for column, value in zip(rows, values):
                    column.append(value)
        yield pa.RecordBatch.from_arrays(
            [pa.array(v, pa.string() if isinstance(f.dataType, T.StringType) else pa.int64())
             for v, f in zip(rows, _STORED.fields)], names=_STORED.fieldNames())


def stored_texts(docs: DataFrame) -> DataFrame:
    """Store each text as JPEG media, read it back, and describe both; one row per document.

    The payload is the UTF-8 text and zero bytes up to a positive multiple of 64; null texts are
    empty. ``payload_*`` and ``tail_crc32`` come from the decoded image, ``feature`` is its width,
    height and thumbnail hash. Equal texts give equal values; repeated rows and null ids give a
    row each; further columns are ignored.
    """
    short_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(docs).alias("text")).mapInArrow(_store, _STORED)


_FEATURES = T.StructType([
    T.StructField("key", T.LongType()), T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()),
    T.StructField("thumbnail", T.BinaryType()), T.StructField("thumbnail_hash", T.StringType()),
    T.StructField("problem", T.StringType()),
])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for key, value in zip(batch.column(0).to_pylist(), batch.column(1)):
            try:
                frame = parse_images(value.as_py() or b"")[0]
                decode_frames([frame])
                rows.append((key, frame.width, frame.height, frame.thumbnail.tobytes(), thumbnail_hash(frame.thumbnail), None))
            except (BadImage, IndexError) as problem:
                rows.append((key, None, None, None, None, str(problem) or "cut short"))
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in rows], t) for i, t in enumerate(
                (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.string(), pa.string()))], names=_FEATURES.fieldNames())


def image_features(media: DataFrame, key: str, column: str) -> DataFrame:
    """Dimensions, thumbnail and hash of the first image of a binary column of baseline JPEGs.

    Rows whose bytes are null, empty or no baseline JPEG have nulls and say why in ``problem``.
    """
    return media.select(F.col(key).cast("long").alias("key"), F.col(column).alias("media")).mapInArrow(_features, _FEATURES)
