"""Media columns: payloads stored as the quantised coefficients of baseline JPEGs, and features from reading them back.

A byte b is stored as the coefficient b - 128 (b < 128) or b - 127, never zero, 64 to a block in zigzag order. Huffman
coding of quantised coefficients is lossless, so what a baseline decoder finds before it dequantises is the payload. A
restart marker stands after each 9 blocks (576 bytes), where the bits begin anew at a whole byte and the DC prediction at 0.

The reader parses markers and tables, cuts scans at their restart markers and Huffman-decodes the pieces of all files of a
slice side by side: each step takes one symbol of every piece by a table of all 16-bit prefixes, with its run of zeros
and its value bits. Scans of several components are decoded symbol by symbol.

Features: width, height and a hash of the luminance thumbnail, which holds one pixel a block, from the DC coefficients
alone. Edge cases: a null or empty text is stored as one 24 x 24 image of bytes 255; very long texts get wider images;
equal texts and repeated rows give equal values; an empty table gives an empty result; other columns are not looked at,
whatever their names. doc_id must be a long.
"""

from __future__ import annotations

import functools
import hashlib
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from countloom.llm.words import slices

UNIT = 576


class BadJpeg(ValueError):
    pass


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _counts(lengths: list[int]) -> bytes:
    return bytes(lengths.count(n) for n in range(1, 17))


def codes(counts: bytes, symbols: bytes) -> list[tuple[int, int, int]]:
    """(length, code, symbol) of a Huffman table as a DHT segment has it."""
    out, code, k = [], 0, 0
    for n in range(1, 17):
        for _ in range(counts[n - 1]):
            out.append((n, code, symbols[k]))
            code, k = code + 1, k + 1
        code <<= 1
    return out


#: Lengths of the codes of DC categories and AC sizes, by what letters, spaces and UTF-8 bytes need.
DC_LENGTHS = {4: 3, 5: 3, 6: 3, 7: 3, 3: 4, 8: 4, 2: 5, 9: 5, 0: 6, 1: 6}
AC_LENGTHS = {4: 2, 5: 2, 7: 2, 3: 4, 6: 4, 8: 5, 1: 6, 2: 6}
RESTART = 9


def _table(lengths: dict[int, int]) -> tuple[bytes, bytes]:
    return _counts(list(lengths.values())), bytes(lengths)


DC_TABLE, AC_TABLE = _table(DC_LENGTHS), _table(AC_LENGTHS)


def _fields(table: tuple[bytes, bytes], most: int) -> tuple[np.ndarray, np.ndarray]:
    """Code and value bits as one number, and how many bits, of each value -most..most; 0 bits for what has no code."""
    by = {s: (n, c) for n, c, s in codes(*table)}
    v = np.arange(-most, most + 1)
    size = np.array([abs(x).bit_length() for x in v.tolist()])
    code, bits = (np.array([by.get(x, (0, 0))[k] for x in size.tolist()], np.int64) for k in (1, 0))
    return code << size | np.where(v >= 0, v, v + (1 << size) - 1), np.where(bits > 0, bits + size, 0)


DC_FIELDS, AC_FIELDS = _fields(DC_TABLE, 256), _fields(AC_TABLE, 128)


def header(blocks: int, wide: int, n_bytes: int) -> bytes:
    """All before the scan's data; the coefficients' true byte count stands in a comment."""
    quant = bytes([8] + [1] * 63)  # a DC coefficient is the mean of 8 x 8 samples, times 8
    return b"".join([
        b"\xff\xd8", _segment(0xFE, b"payload %d" % n_bytes), _segment(0xDB, b"\0" + quant),
        _segment(0xC0, struct.pack(">BHHB", 8, blocks // wide * 8, wide * 8, 1) + b"\x01\x11\x00"),
        _segment(0xC4, b"\x00" + b"".join(DC_TABLE) + b"\x10" + b"".join(AC_TABLE)), _segment(0xDD, struct.pack(">H", RESTART)),
        _segment(0xDA, b"\x01\x01\x00\x00\x3f\x00"),
    ])


def encode_pieces(payload: np.ndarray) -> list[bytes]:
    """The scan data between restart markers, of each 576 bytes."""
    v = payload.astype(np.int64).reshape(-1, RESTART, 64) - 128
    v[v >= 0] += 1
    dc = np.diff(v[:, :, 0], axis=1, prepend=0)
    field, bits = AC_FIELDS[0][v + 128], AC_FIELDS[1][v + 128]
    field[:, :, 0], bits[:, :, 0] = DC_FIELDS[0][dc + 256], DC_FIELDS[1][dc + 256]
    field, bits = field.reshape(len(v), -1), bits.reshape(len(v), -1)
    size = bits.sum(axis=1)
    first = np.concatenate([[0], np.cumsum(-(-size // 8))])  # bytes
    at = (np.cumsum(bits, axis=1) - bits + first[:-1, None] * 8).ravel()
    field, bits = field.ravel(), bits.ravel()
    three = field << (24 - (at & 7) - bits)  # a field lies within three bytes
    n = first[-1] + 2
    out = sum(np.bincount((at >> 3) + k, three >> (16 - 8 * k) & 255, n) for k in range(3)).astype(np.int64)
    out[first[1:] - 1] += (1 << (-size & 7)) - 1  # ones fill the last byte
    raw = out.astype(np.uint8).tobytes()
    return [raw[a:b].replace(b"\xff", b"\xff\x00") for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]


def store_all(texts: list[bytes]) -> list[bytes]:
    """The files of texts: their payloads, and in the last row of a wide image more blocks of bytes 255."""
    sizes, shapes, padded = [], [], []
    for text in texts:
        n = max(UNIT, -(-len(text) // UNIT) * UNIT)
        blocks = n // 64
        wide = 3 if blocks <= 3 * 8191 else 9 * -(-blocks // (9 * 8191))
        whole = -(-blocks // wide) * wide
        sizes.append(n)
        shapes.append((whole, wide))
        padded.append(text.ljust(whole * 64, b"\xff"))
    whole, step = np.frombuffer(b"".join(padded), np.uint8), UNIT * 1024
    pieces = [p for i in range(0, len(whole), step) for p in encode_pieces(whole[i : i + step])]
    out, i = [], 0
    for n, (blocks, wide) in zip(sizes, shapes, strict=True):
        own = pieces[i : i + blocks // RESTART]
        i += len(own)
        marked = [p for k, piece in enumerate(own) for p in (piece, MARKERS[k & 7])]
        out.append(header(blocks, wide, n) + b"".join(marked[:-1]) + b"\xff\xd9")
    return out


MARKERS = [bytes([0xFF, 0xD0 + k]) for k in range(8)]


def parse(data: bytes) -> dict:
    """Frame, tables, comment and the scans' data of a baseline JPEG; anything else raises BadJpeg."""
    if data[:2] != b"\xff\xd8":
        raise BadJpeg("no start of image")
    out: dict = {"quant": {}, "huffman": {}, "comment": b"", "restart": 0, "scans": []}
    i = 2
    while True:
        while data[i : i + 2] == b"\xff\xff":
            i += 1
        if i + 2 > len(data) or data[i] != 0xFF:
            raise BadJpeg("no marker where one must be")
        marker = data[i + 1]
        if marker == 0xD9:
            return out
        n = int.from_bytes(data[i + 2 : i + 4], "big")
        body = data[i + 4 : i + 2 + n]
        if n < 2 or len(body) != n - 2:
            raise BadJpeg("a segment is cut off")
        i += 2 + n
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                size = 64 * (1 + wide)
                out["quant"][body[0] & 15] = np.frombuffer(body[1 : 1 + size], ">u2" if wide else "u1").astype(np.int64)
                body = body[1 + size :]
        elif marker == 0xC4:
            while body:
                k = sum(body[1:17])
                out["huffman"][body[0]] = (body[1:17], body[17 : 17 + k])
                body = body[17 + k :]
        elif marker == 0xC0:
            bits, high, wide, parts = struct.unpack(">BHHB", body[:6])
            if bits != 8:
                raise BadJpeg("samples are not of 8 bits")
            out |= {"height": high, "width": wide, "parts": [(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(parts)]}
        elif 0xC1 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            raise BadJpeg("not a baseline frame")
        elif marker == 0xDD:
            out["restart"] = int.from_bytes(body, "big")
        elif marker == 0xFE:
            out["comment"] = body
        elif marker == 0xDA:
            end = i
            while True:
                end = data.find(b"\xff", end)
                if end < 0 or end + 1 >= len(data):
                    raise BadJpeg("a scan has no end")
                if data[end + 1] == 0 or 0xD0 <= data[end + 1] <= 0xD7:
                    end += 2
                    continue
                break
            out["scans"].append(([(body[1 + 2 * k], body[2 + 2 * k] >> 4, body[2 + 2 * k] & 15) for k in range(body[0])], data[i:end]))
            i = end


@functools.lru_cache(maxsize=64)
def prefixes(counts: bytes, symbols: bytes) -> np.ndarray:
    """Length and symbol (length << 8 | symbol) of the code that each 16 bits begin with; -1 if there is none."""
    out = np.full(1 << 16, -1, np.int32)
    for n, code, symbol in codes(counts, symbols):
        out[code << (16 - n) : (code + 1) << (16 - n)] = n << 8 | symbol
    return out


def side_by_side(pieces: list[bytes], blocks: np.ndarray, tables: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Coefficients of pieces of scans of one component, blocks one after the other; tables: prefixes() by table and kind
    (DC, AC); of: each piece's table."""
    raw = b"".join(pieces) + bytes(16)
    data = np.frombuffer(raw, np.uint8)
    eights = np.ndarray(len(data) - 7, ">u8", data, strides=(1,))
    size = np.array([len(p) for p in pieces], np.int64)
    at = (np.cumsum(size) - size) * 8
    end = at + size * 8
    first = np.cumsum(blocks) - blocks
    out = np.zeros((int(blocks.sum()), 64), np.int32)
    live, k, row, last = np.flatnonzero(blocks > 0), np.zeros(len(pieces), np.int64), first.copy(), np.zeros(len(pieces), np.int64)
    stop, flat = first + blocks, tables.reshape(-1)
    base = of.astype(np.int64) << 17
    while len(live):
        here, kk = at[live], k[live]
        if (here > end[live]).any():
            raise BadJpeg("a scan is too short")
        bits = eights[here >> 3].astype(np.uint64) << (here & 7).astype(np.uint64)
        found = flat[base[live] + ((kk > 0).astype(np.int64) << 16) + (bits >> np.uint64(48)).astype(np.int64)]
        if (found < 0).any():
            raise BadJpeg("a code is not in its table")
        n, symbol = found >> 8, found & 255
        s = np.where(kk > 0, symbol & 15, symbol)
        value = ((bits << n.astype(np.uint64)) >> np.uint64(1) >> (63 - s).astype(np.uint64)).astype(np.int64)
        value = np.where((s > 0) & (value >> np.maximum(s - 1, 0) == 0), value - (1 << s) + 1, value)
        at[live] = here + n + s
        dc = kk == 0
        last[live[dc]] += value[dc]
        value[dc] = last[live[dc]]
        run = np.where(dc, 0, symbol >> 4)
        place = kk + run
        put = dc | (s > 0)
        if (place[put] > 63).any():
            raise BadJpeg("a run leaves its block")
        out[row[live[put]], place[put]] = value[put]
        kk = np.where(put, place + 1, np.where(run == 15, kk + 16, 64))
        done = kk >= 64
        row[live[done]] += 1
        k[live] = np.where(done, 0, kk)
        live = live[row[live] < stop[live]] if done.any() else live
    if (at > end).any():
        raise BadJpeg("a scan is too short")
    return out


def cut(data: bytes) -> list[bytes]:
    """A scan's data between its restart markers, without stuffing."""
    return [p.replace(b"\xff\x00", b"\xff") for p in re.split(rb"\xff[\xd0-\xd7]", data)]


class _Bits:
    def __init__(self, data: bytes):
        self.data, self.at, self.bits, self.n = data, 0, 0, 0

    def take(self, n: int) -> int:
        while self.n < n:
            if self.at >= len(self.data):
                raise BadJpeg("a scan is too short")
            self.bits = (self.bits << 8 | self.data[self.at]) & 0xFFFFFFFF
            self.at += 1
            self.n += 8
        self.n -= n
        return self.bits >> self.n & ((1 << n) - 1)

    def symbol(self, table: dict) -> int:
        code = 0
        for n in range(1, 17):
            code = code << 1 | self.take(1)
            if (n, code) in table:
                return table[n, code]
        raise BadJpeg("a code is not in its table")

    def value(self, s: int) -> int:
        v = self.take(s) if s else 0
        return v if not s or v >> (s - 1) else v - (1 << s) + 1


def one_component(image: dict, names: list) -> int:
    """Blocks of a scan of one component."""
    most = [max(x[i] for _, *x in image["parts"]) for i in (0, 1)]
    h, v = next((h, v) for c, h, v, _ in image["parts"] if c == names[0][0])
    return -(-image["width"] * h // (8 * most[0])) * -(-image["height"] * v // (8 * most[1]))


def _huffman(image: dict, names: list) -> dict:
    if any(d not in image["huffman"] or 16 + a not in image["huffman"] for _, d, a in names):
        raise BadJpeg("a Huffman table is missing")
    return {c: (image["huffman"][d], image["huffman"][16 + a]) for c, d, a in names}


def interleaved(image: dict, names: list, data: bytes) -> dict[int, np.ndarray]:
    """Coefficients of a scan of several components, symbol by symbol."""
    parts = {c: (h, v) for c, h, v, _ in image["parts"]}
    most = [max(x[i] for x in parts.values()) for i in (0, 1)]
    huff = _huffman(image, names)
    if len(names) == 1:
        units, each = one_component(image, names), {names[0][0]: 1}
    else:
        units, each = (-(-image["width"] // (8 * most[0]))) * (-(-image["height"] // (8 * most[1]))), {c: parts[c][0] * parts[c][1] for c, _, _ in names}
    tables = {c: [{(n, code): s for n, code, s in codes(*t)} for t in pair] for c, pair in huff.items()}
    found: dict[int, list] = {c: [] for c in each}
    done = 0
    for piece in cut(data):
        bits, last_dc = _Bits(piece), dict.fromkeys(each, 0)
        for _ in range(min(image["restart"] or units, units - done)):
            done += 1
            for c, times in each.items():
                for _ in range(times):
                    row = np.zeros(64, np.int32)
                    last_dc[c] += bits.value(bits.symbol(tables[c][0]))
                    row[0] = last_dc[c]
                    k = 1
                    while k < 64:
                        rs = bits.symbol(tables[c][1])
                        if rs & 15 == 0:
                            if rs != 0xF0:
                                break
                            k += 16
                            continue
                        k += rs >> 4
                        if k > 63:
                            raise BadJpeg("a run leaves its block")
                        row[k] = bits.value(rs & 15)
                        k += 1
                    found[c].append(row)
    return {c: np.array(rows, np.int32).reshape(-1, 64) for c, rows in found.items()}


def coefficients(images: list[dict]) -> list[dict[int, np.ndarray]]:
    """For each image: component id -> quantised coefficients, zigzag order, a row a block in scan order (with sampling
    factors: in the order of its MCUs). All scans of one component are decoded together."""
    out: list[dict[int, np.ndarray]] = [{} for _ in images]
    tables: dict[tuple, int] = {}
    pieces, blocks, of, scans = [], [], [], []
    for i, image in enumerate(images):
        for names, data in image["scans"]:
            if len(names) > 1:
                out[i] |= interleaved(image, names, data)
                continue
            huff = _huffman(image, names)[names[0][0]]
            units, own = one_component(image, names), cut(data)
            each = image["restart"] or units
            if len(own) != max(1, -(-units // max(each, 1))):
                raise BadJpeg("restart markers are missing")
            scans.append((i, names[0][0], units))
            pieces += own
            blocks += [min(each, units - k * each) for k in range(len(own))]
            of += [tables.setdefault(huff, len(tables))] * len(own)
    if pieces:
        rows = side_by_side(pieces, np.array(blocks), np.stack([np.stack([prefixes(*t) for t in pair]) for pair in tables]), np.array(of))
        begin = 0
        for i, c, units in scans:
            out[i][c] = rows[begin : begin + units]
            begin += units
    return out


def thumbnail(image: dict, coefs: dict[int, np.ndarray]) -> np.ndarray:
    """Luminance, one pixel a block, from the DC coefficients of the first component (which must not be subsampled
    within its MCU rows: one sampling factor of 1, or a single component)."""
    c, _, _, q = image["parts"][0]
    wide = -(-image["width"] // 8)
    dc = coefs[c][:, 0] * image["quant"][q][0] // 8 + 128
    return np.clip(dc[: len(dc) // wide * wide], 0, 255).astype(np.uint8).reshape(-1, wide)


def read_all(files: list[bytes]) -> list[tuple[bytes, np.ndarray, int, int]]:
    """Payload, thumbnail, width, height of stored files."""
    images, out = [parse(f) for f in files], []
    for image, coefs in zip(images, coefficients(images), strict=True):
        v = coefs[image["parts"][0][0]]
        if ((v == 0) | (np.abs(v) > 128)).any() or not image["comment"].startswith(b"payload "):
            raise BadJpeg("this file holds no payload")
        payload = (v + np.where(v < 0, 128, 127)).astype(np.uint8).tobytes()[: int(image["comment"][8:])]
        out.append((payload, thumbnail(image, coefs), image["width"], image["height"]))
    return out


def store(text: bytes) -> bytes:
    return store_all([text])[0]


def read(data: bytes) -> tuple[bytes, np.ndarray, int, int]:
    return read_all([data])[0]


COLUMNS = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def media(docs: DataFrame, with_file: bool = True) -> DataFrame:
    """Each document's stored file (`media` binary, if asked for) and what reading it back gives."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, off in slices(batches):
            raw, out = data.tobytes(), []
            texts = [raw[a:b] for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
            files = store_all(texts)
            for text, file, (payload, thumb, wide, high) in zip(texts, files, read_all(files), strict=True):
                feature = f"{wide}x{high}:{hashlib.sha1(thumb.tobytes()).hexdigest()}"
                out.append((len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(file), hashlib.sha256(file).hexdigest(), feature, *([file] if with_file else [])))
            cols = list(zip(*out, strict=True))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
            names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "media"]
            yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=False)]], ["doc_id", *names[: len(cols)]])

    return docs.select("doc_id", "text").mapInArrow(rows, COLUMNS + ", media binary" * with_file)


def op3_media(spark, sf_dir: str) -> DataFrame:
    return media(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_file=False)
