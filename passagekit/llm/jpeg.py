"""Media columns: payloads as coefficients of baseline JPEG images, read back with DC-only luminance thumbnails.

A payload of 64*k bytes becomes a grey image of k blocks: byte b is the quantised coefficient b-128 (below 128) or
b-127, never zero, in zigzag order.  Each block is a restart interval, so that all blocks of a batch are Huffman-decoded
in lock-step.  The reader parses markers, accepts any baseline one-component scan (other tables, zero runs, end of
block, longer or no restart intervals), and reports dimensions, coefficients and the thumbnail of block means.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import clean, documents, map_batches, slices
from .textkit import buffers

SCHEMA = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string,"
    " feature string, width int, height int"
)

# Code lengths of our Huffman tables: (symbol, bits).  A symbol is run << 4 | size of the coefficient.
DC_LENGTHS = [(5, 2), (7, 2), (4, 3), (6, 3), (3, 4), (8, 4), (2, 5), (1, 6), (0, 7)]
AC_LENGTHS = [(4, 2), (5, 2), (3, 3), (7, 3), (6, 4), (2, 4), (1, 5), (8, 5), (0, 6), (9, 6)]


def canonical(lengths: list[tuple[int, int]]) -> tuple[dict[int, tuple[int, int]], bytes]:
    """Symbol -> (code, bits), and the table's body in a DHT segment."""
    codes, code, last, counts = {}, 0, 0, [0] * 16
    for symbol, bits in sorted(lengths, key=lambda x: x[1]):
        code <<= bits - last
        codes[symbol] = (code, bits)
        code, last = code + 1, bits
        counts[bits - 1] += 1
    return codes, bytes(counts) + bytes(s for s, _ in sorted(lengths, key=lambda x: x[1]))


def _byte_codes(lengths: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """For each byte: the bits of its coefficient's symbol and value, and their number."""
    codes, _ = canonical(lengths)
    word, bits = np.zeros(256, np.uint32), np.zeros(256, np.int64)
    for b in range(256):
        v = b - 128 if b < 128 else b - 127
        size = abs(v).bit_length()
        code, n = codes[size]
        word[b] = code << size | (v if v > 0 else v + (1 << size) - 1)
        bits[b] = n + size
    return word, bits


_DC, _AC = _byte_codes(DC_LENGTHS), _byte_codes(AC_LENGTHS)
_WORD = np.stack([_DC[0]] + [_AC[0]] * 63)
_BITS = np.stack([_DC[1]] + [_AC[1]] * 63)


def shape(blocks: int) -> tuple[int, int]:
    """Columns and rows of blocks: near to square, and within 65535 pixels a side."""
    columns = min(8191, max(1, int(np.ceil(np.sqrt(blocks)))))
    rows = -(-blocks // columns)
    if rows > 8191:
        raise ValueError("payload beyond a JPEG's dimensions")
    return columns, rows


def _head(columns: int, rows: int, n_bytes: int, payload: int) -> bytes:
    segment = lambda marker, body: struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body
    return (
        b"\xff\xd8"
        + segment(0xFE, b"bytes %d of %d" % (n_bytes, payload))
        + segment(0xDB, b"\0" + b"\x01" * 64)
        + segment(0xC0, struct.pack(">BHHB", 8, rows * 8, columns * 8, 1) + b"\x01\x11\x00")
        + segment(0xC4, b"\x00" + canonical(DC_LENGTHS)[1])
        + segment(0xC4, b"\x10" + canonical(AC_LENGTHS)[1])
        + segment(0xDD, struct.pack(">H", 1))
        + segment(0xDA, b"\x01\x01\x00\x00\x3f\x00")
    )


def encode(payloads: np.ndarray, blocks: np.ndarray, n_bytes: np.ndarray) -> list[bytes]:
    """One JPEG for each run of blocks[i] rows of 64 bytes; trailing blocks of the grid are all-zero."""
    dc0, ac0 = canonical(DC_LENGTHS)[0][0], canonical(AC_LENGTHS)[0][0]
    coef = payloads.reshape(-1, 64)
    k = np.arange(64)
    bits, word = _BITS[k, coef], _WORD[k, coef]
    ends = np.cumsum(bits, axis=1)
    length = (ends[:, -1] + 7) >> 3
    base = np.concatenate([[0], np.cumsum(length)])
    at = (base[:-1, None] * 8 + ends - bits).ravel()
    shifted = word.ravel().astype(np.uint64) << (np.uint64(32) - (at & 7).astype(np.uint64) - bits.ravel().astype(np.uint64))
    out = np.zeros(base[-1] + 4)
    for i in range(4):
        out += np.bincount((at >> 3) + i, ((shifted >> np.uint64(24 - 8 * i)) & np.uint64(255)).astype(np.float64), len(out))
    out = out[:-4].astype(np.uint8)
    spare = length * 8 - ends[:, -1]
    out[base[1:] - 1] |= ((1 << spare) - 1).astype(np.uint8)
    # stuffing, and a marker behind each block
    where, of_doc = np.flatnonzero(out == 255), np.repeat(np.arange(len(blocks)), blocks)
    nth = np.arange(len(coef)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    insert = np.concatenate([where + 1, np.repeat(base[1:], 2)])
    values = np.zeros(len(insert), np.uint8)
    values[len(where) :: 2] = 255
    values[len(where) + 1 :: 2] = 0xD0 + (nth & 7)
    order = np.argsort(insert, kind="stable")
    body = np.insert(out, insert[order], values[order])
    stuffed = np.bincount(np.searchsorted(base, where, "right") - 1, minlength=len(coef)) if len(where) else 0
    per_doc = np.bincount(of_doc, length + 2 + stuffed, len(blocks)).astype(np.int64)
    stop = np.cumsum(per_doc)
    images = []
    for i, b in enumerate(blocks.tolist()):
        columns, rows = shape(b)
        scan, grid = body[stop[i] - per_doc[i] : stop[i]].tobytes(), columns * rows
        (c0, n0), (c1, n1) = dc0, ac0
        n = -(-(n0 + n1) // 8)
        zero = ((c0 << n1 | c1) << (n * 8 - n0 - n1) | (1 << (n * 8 - n0 - n1)) - 1).to_bytes(n, "big").replace(b"\xff", b"\xff\x00")
        fill = b"".join(zero + bytes((255, 0xD0 + (j & 7))) for j in range(b, grid))
        images.append(_head(columns, rows, int(n_bytes[i]), b * 64) + (scan + fill)[:-2] + b"\xff\xd9")
    return images


@dataclass
class Image:
    width: int
    height: int
    coefficients: np.ndarray  # blocks x 64, zigzag order, quantised
    thumbnail: np.ndarray  # block means of luminance, rows x columns of uint8
    comment: bytes


def _parse(data: bytes) -> dict:
    """The segments before the scan of a baseline JPEG of one component."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("no JPEG")
    x, at = {"interval": 0, "dht": {}, "dqt": {}, "comment": b""}, 2
    while True:
        if len(data) < at + 4 or data[at] != 0xFF:
            raise ValueError("a JPEG cut off or damaged before its scan")
        marker, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xFE:
            x["comment"] = body
        elif marker == 0xDB:
            while body:
                wide = body[0] >> 4
                x["dqt"][body[0] & 15] = int.from_bytes(body[1 : 2 + wide], "big")  # the DC step
                body = body[1 + 64 * (1 + wide) :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                x["dht"][body[0]] = body[1 : 17 + n]
                body = body[17 + n :]
        elif marker == 0xC0:
            x["height"], x["width"], parts = struct.unpack(">HHB", body[1:6])
            x["step"] = body[8]
            if body[0] != 8 or parts != 1:
                raise ValueError("only 8-bit images of one component")
        elif 0xC1 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
            raise ValueError("no baseline JPEG")
        elif marker == 0xDD:
            x["interval"] = int.from_bytes(body, "big")
        elif marker == 0xDA:
            if len(body) < 3 or "width" not in x or x["step"] not in x["dqt"] or not {body[2] >> 4, 16 | body[2] & 15} <= x["dht"].keys():
                raise ValueError("a JPEG without the tables of its scan")
            x["tables"] = x["dht"][body[2] >> 4], x["dht"][16 | body[2] & 15]
            return x | {"scan": at}


def _lookup(table: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Symbol and bits by the next 16 bits."""
    symbol, bits, code, at = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), 0, 16
    for n in range(1, 17):
        for _ in range(table[n - 1]):
            lo, hi = code << (16 - n), (code + 1) << (16 - n)
            symbol[lo:hi], bits[lo:hi] = table[at], n
            code, at = code + 1, at + 1
        code <<= 1
    return symbol, bits


def _decode(scan: np.ndarray, start: np.ndarray, blocks: np.ndarray, tables: tuple[bytes, bytes]) -> np.ndarray:
    """Huffman-decode intervals in lock-step.  scan: bytes without stuffing and markers, with 8 spare ones at the end;
    start: of each interval; blocks: in each interval.  Returns the coefficients of all blocks in order."""
    (dc_symbol, dc_bits), (ac_symbol, ac_bits) = _lookup(tables[0]), _lookup(tables[1])
    wide = np.zeros(len(scan) - 7, np.uint64)
    for i in range(8):
        wide = wide << np.uint64(8) | scan[i : len(scan) - 7 + i]
    first = np.cumsum(blocks) - blocks
    out = np.zeros((int(blocks.sum()), 64), np.int16)
    position, predicted = start.astype(np.int64) * 8, np.zeros(len(start), np.int64)

    def take(who: np.ndarray, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p = position[who]
        window = wide[p >> 3] << (p & 7).astype(np.uint64)
        code = (window >> np.uint64(48)).astype(np.int64)
        symbol, n = symbols[code], lengths[code]
        if not n.all():
            raise ValueError("no such Huffman code")
        size = symbol & 15
        value = (window << n.astype(np.uint64) >> np.uint64(1) >> (63 - size).astype(np.uint64)).astype(np.int64)
        value = np.where((size > 0) & (value < (np.int64(1) << np.maximum(size - 1, 0))), value - (np.int64(1) << size) + 1, value)
        position[who] = p + n + size
        return symbol, value

    for nth in range(int(blocks.max(initial=0))):
        live = np.flatnonzero(blocks > nth)
        row = first[live] + nth
        _, diff = take(live, dc_symbol, dc_bits)
        predicted[live] += diff
        out[row, 0] = predicted[live]
        k = np.ones(len(live), np.int64)
        while len(live):
            symbol, value = take(live, ac_symbol, ac_bits)
            k += symbol >> 4
            some = (symbol & 15) > 0
            out[row[some], k[some]] = value[some]
            k += 1
            on = (k < 64) & (symbol != 0)
            if not on.all():
                live, row, k = live[on], row[on], k[on]
    return out


def decode(images: list[bytes]) -> list[Image]:
    """Read JPEGs; those with the same Huffman tables are decoded together.  A ValueError tells what cannot be read."""
    heads = [_parse(x) for x in images]
    groups: dict[tuple, list[int]] = {}
    for i, h in enumerate(heads):
        groups.setdefault(h["tables"], []).append(i)
    out: list[Image | None] = [None] * len(images)
    for tables, own in groups.items():
        raw = np.frombuffer(b"".join(images[i][heads[i]["scan"] : -2] + b"\xff\xd9" for i in own), np.uint8)
        after = np.append(raw[1:], 0)
        mark = (raw == 255) & (after != 0) & (np.append(0, raw[:-1]) != 255)
        # markers go, a stuffed zero goes, what is left is entropy-coded
        keep = ~mark
        keep[1:] &= ~mark[:-1]
        keep[1:] &= ~((raw[:-1] == 255) & (raw[1:] == 0))
        left = np.cumsum(keep)
        ends = left[np.flatnonzero(mark)]
        starts = np.append(0, ends[:-1])
        counts, last = [], np.flatnonzero(after[np.flatnonzero(mark)] == 0xD9)
        parts = np.diff(np.append(-1, last))
        for i, n in zip(own, parts.tolist(), strict=True):
            grid, step = -(-heads[i]["width"] // 8) * -(-heads[i]["height"] // 8), heads[i]["interval"]
            counts.append(np.minimum(step, grid - step * np.arange(n)) if step else np.array([grid]))
        scan = np.append(raw[keep], np.full(8, 255, np.uint8))
        coefficients = _decode(scan, starts, np.concatenate(counts), tables)
        at = 0
        for i in own:
            h = heads[i]
            columns, rows = -(-h["width"] // 8), -(-h["height"] // 8)
            mine = coefficients[at : at + columns * rows]
            at += columns * rows
            mean = np.clip(np.rint(mine[:, 0] * (h["dqt"][h["step"]] / 8.0) + 128), 0, 255).astype(np.uint8)
            out[i] = Image(h["width"], h["height"], mine, mean.reshape(rows, columns), h["comment"])
    return out


def thumbnail_hash(thumbnail: np.ndarray) -> str:
    """64 bits: which cells of an 8x8 averaging of the thumbnail lie above their median."""
    rows = np.arange(9) * thumbnail.shape[0] // 8
    cols = np.arange(9) * thumbnail.shape[1] // 8
    sums = np.zeros((thumbnail.shape[0] + 1, thumbnail.shape[1] + 1))
    sums[1:, 1:] = thumbnail.astype(np.float64).cumsum(0).cumsum(1)
    r0, r1 = rows[:-1], np.maximum(rows[1:], rows[:-1] + 1)
    c0, c1 = cols[:-1], np.maximum(cols[1:], cols[:-1] + 1)
    r0, c0 = np.minimum(r0, r1 - 1), np.minimum(c0, c1 - 1)
    cell = sums[np.ix_(r1, c1)] - sums[np.ix_(r0, c1)] - sums[np.ix_(r1, c0)] + sums[np.ix_(r0, c0)]
    cell /= np.outer(r1 - r0, c1 - c0)
    return np.packbits(cell.ravel() > np.median(cell)).tobytes().hex()


def unpack(image: Image) -> bytes:
    """The payload that encode() has stored."""
    size = int(image.comment.split()[-1])
    v = image.coefficients.ravel()[:size]
    return np.where(v < 0, v + 128, v + 127).astype(np.uint8).tobytes()


def pad(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts as UTF-8 with zeros up to a positive multiple of 64: all bytes, blocks and unpadded bytes of each."""
    data, at = buffers(column)
    size = np.diff(at)
    blocks = np.maximum(1, -(-size // 64))
    out = np.zeros(int(blocks.sum()) * 64, np.uint8)
    begin = (np.cumsum(blocks) - blocks) * 64
    out[np.arange(len(data)) + np.repeat(begin - at[:-1], size)] = data
    return out, blocks, size


def media_features(df: DataFrame) -> DataFrame:
    """(doc_id, text) -> digests of the stored JPEG and of what is read back from it.

    Null and empty texts become one block of zeros; repeated texts give equal values and repeated rows repeated results;
    null ids stay null; an empty table gives an empty result.  There is no size limit below a JPEG's 65535 x 65535 pixels
    (4.2 GB of text).
    """

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in slices(batch, limit=1 << 20):
            payload, blocks, size = pad(part.column(1))
            images = encode(payload, blocks, size)
            rows = []
            for i, (image, media) in enumerate(zip(decode(images), images, strict=True)):
                back = unpack(image)
                rows.append(
                    {
                        "doc_id": part.column(0)[i].as_py(),
                        "n_bytes": int(size[i]),
                        "payload_bytes": len(back),
                        "payload_sha256": hashlib.sha256(back).hexdigest(),
                        "tail_crc32": zlib.crc32(back[-64:]),
                        "media_bytes": len(media),
                        "media_sha256": hashlib.sha256(media).hexdigest(),
                        "feature": f"{image.width}x{image.height}:{thumbnail_hash(image.thumbnail)}",
                        "width": image.width,
                        "height": image.height,
                    }
                )
            yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    return map_batches(df, run, SCHEMA)


_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64())]
    + [("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("width", pa.int32()), ("height", pa.int32())]
)


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_features(documents(spark, sf_dir).select(*clean()))
