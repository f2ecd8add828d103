"""Media columns as baseline JPEG.

Decoding parses the markers, Huffman-decodes the scans and rebuilds the DC-only luminance thumbnail
(one sample for each 8 x 8 block) in numpy. All restart intervals of many images are decoded side by
side: a step decodes one block in each of them.

Payload bytes are stored losslessly as such samples: a block is flat, its DC coefficient is the byte
less 128 with a quantiser of 8, so the thumbnail is the payload. 64 blocks make a row, which is a
restart interval too. An image has at most 8191 rows; longer payloads are several images, end to end.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkloom.llm._shared import documents, map_arrow, slices

ROW = 64
MAX_ROWS = 8191
#: Payload or media bytes that are encoded, or decoded, side by side.
GROUP_BYTES = 1 << 20
#: Code lengths of the DC size categories of stored payloads; the AC table has only end of block, one bit.
DC_LENGTHS = {4: 2, 7: 2, 3: 3, 5: 3, 1: 4, 2: 4, 0: 5, 6: 5, 8: 6}


def canonical(lengths: dict[int, int]) -> dict[int, tuple[int, int]]:
    """JPEG's code for each symbol: (code, length), shorter codes first, in the order of the symbols given."""
    out, code, last = {}, 0, 0
    for symbol, n in sorted(lengths.items(), key=lambda x: x[1]):
        code <<= n - last
        out[symbol] = (code, n)
        code, last = code + 1, n
    return out


def _dht(kind: int, lengths: dict[int, int]) -> bytes:
    symbols = [s for s, _ in sorted(lengths.items(), key=lambda x: x[1])]
    body = bytes([kind]) + bytes(sum(1 for x in lengths.values() if x == n) for n in range(1, 17)) + bytes(symbols)
    return b"\xff\xc4" + struct.pack(">H", len(body) + 2) + body


@lru_cache(1)
def _diff_codes() -> tuple[np.ndarray, np.ndarray]:
    """Bits and their number for each DC difference from -255 to 255, with the end-of-block bit."""
    table = canonical(DC_LENGTHS)
    codes, lens = np.zeros(511, np.uint32), np.zeros(511, np.uint8)
    for d in range(-255, 256):
        size = abs(d).bit_length()
        code, n = table[size]
        codes[d + 255] = (code << size | (d if d > 0 else d + (1 << size) - 1)) << 1
        lens[d + 255] = n + size + 1
    return codes, lens


def _head(rows: int) -> bytes:
    return b"".join([
        b"\xff\xd8\xff\xdb", struct.pack(">HB", 67, 0), bytes([8] + [1] * 63),
        b"\xff\xc0", struct.pack(">HBHHB", 11, 8, 8 * rows, 8 * ROW, 1), bytes([1, 0x11, 0]),
        _dht(0x00, DC_LENGTHS), _dht(0x10, {0: 1}),
        b"\xff\xdd", struct.pack(">HH", 4, ROW), b"\xff\xda", struct.pack(">HB", 8, 1), bytes([1, 0, 0, 63, 0]),
    ])


def encode_payloads(payloads: list[bytes]) -> list[bytes]:
    """Each payload, of a positive multiple of 64 bytes, as one or more baseline JPEG images.

    Images are made a few at a time, so memory follows GROUP_BYTES and not the longest payload.
    """
    most = ROW * MAX_ROWS
    parts = [(i, p[a : a + most]) for i, p in enumerate(payloads) for a in range(0, len(p), most)]
    made: list[list[bytes]] = [[] for _ in payloads]
    start = held = 0
    for k, (_, part) in enumerate(parts):
        held += len(part)
        if held >= GROUP_BYTES or k + 1 == len(parts):
            for (i, _), image in zip(parts[start : k + 1], _encode_images([x for _, x in parts[start : k + 1]])):
                made[i].append(image)
            start, held = k + 1, 0
    return [own[0] if len(own) == 1 else b"".join(own) for own in made]


def _encode_images(payloads: list[bytes]) -> list[bytes]:
    """Each payload, of at most MAX_ROWS rows, as one image."""
    rows = np.array([len(p) // ROW for p in payloads])
    level = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, ROW).T.astype(np.int16) - 128
    diff = np.diff(level, axis=0, prepend=np.int16(0))
    codes, lens = _diff_codes()
    code, size = codes[diff + 255], lens[diff + 255].astype(np.int32)
    ends = np.cumsum(size, axis=0, dtype=np.int32)
    n_bytes = (ends[-1] + 7) >> 3
    base = np.cumsum(n_bytes, dtype=np.int64) - n_bytes
    bit = ends - size
    value = code << (24 - size - (bit & 7)).astype(np.uint32)
    at = base + (bit >> 3)
    out = np.zeros(int(n_bytes.sum()) + 2, np.uint8)
    for j in range(ROW):  # intervals own distinct bytes, so no index repeats within a step
        i, v = at[j], value[j]
        out[i] |= (v >> 16).astype(np.uint8)
        out[i + 1] |= (v >> 8).astype(np.uint8)
        out[i + 2] |= v.astype(np.uint8)
    out = out[:-2]
    out[base + n_bytes - 1] |= ((1 << (-ends[-1] & 7)) - 1).astype(np.uint8)
    # An image's rows count from 0; a marker follows every row but its last.
    first = np.cumsum(rows) - rows
    in_image = np.arange(len(base)) - np.repeat(first, rows)
    last = np.zeros(len(base), bool)
    last[first + rows - 1] = True
    stuffed = out == 255
    marker = np.where(last, 0, 2)
    shift = np.repeat(np.cumsum(marker) - marker, n_bytes)
    place = np.arange(len(out)) + shift
    place[1:] += np.cumsum(stuffed[:-1])
    scan = np.zeros(len(out) + int(stuffed.sum()) + int(marker.sum()), np.uint8)
    scan[place] = out
    row_end = np.append(place[base[1:]] if len(base) > 1 else [], len(scan)).astype(np.int64)
    row_end[:-1] -= marker[:-1]
    inner = np.flatnonzero(~last)
    scan[row_end[inner]] = 0xFF
    scan[row_end[inner] + 1] = 0xD0 + in_image[inner] % 8
    stops = (np.flatnonzero(last)).tolist()
    raw, images, start = scan.tobytes(), [], 0
    for stop in stops:
        images.append(b"".join([_head(int(in_image[stop]) + 1), raw[start : int(row_end[stop])], b"\xff\xd9"]))
        start = int(row_end[stop])
    return images


class Image:
    """What the markers of one baseline image say, and where its scan lies."""

    def __init__(self, raw: bytes, at: int = 0) -> None:
        self.quant: dict[int, int] = {}
        self.tables: dict[int, tuple[tuple[int, int, int], ...]] = {}
        self.interval, self.width, self.height = 0, 0, 0
        if raw[at : at + 2] != b"\xff\xd8":
            raise ValueError("not a JPEG image")
        at += 2
        while True:
            if at + 4 > len(raw) or raw[at] != 0xFF:
                raise ValueError("broken JPEG marker")
            kind = raw[at + 1]
            if kind == 0xFF:
                at += 1
                continue
            (size,) = struct.unpack_from(">H", raw, at + 2)
            body, at = raw[at + 4 : at + 2 + size], at + 2 + size
            if kind == 0xDB:
                i = 0
                while i < len(body):
                    wide = body[i] >> 4
                    self.quant[body[i] & 15] = struct.unpack_from(">H" if wide else ">B", body, i + 1)[0]
                    i += 1 + 64 * (1 + wide)
            elif kind == 0xC0:
                depth, self.height, self.width, n = struct.unpack_from(">BHHB", body)
                if depth != 8:
                    raise ValueError("not 8-bit JPEG")
                self.components = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
            elif 0xC1 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
                raise ValueError("not a baseline JPEG")
            elif kind == 0xC4:
                i = 0
                while i < len(body):
                    counts = body[i + 1 : i + 17]
                    symbols = body[i + 17 : i + 17 + sum(counts)]
                    sizes = [n + 1 for n, c in enumerate(counts) for _ in range(c)]
                    self.tables[body[i]] = tuple((s, *canonical_next) for s, canonical_next in zip(symbols, _codes(sizes)))
                    i += 17 + len(symbols)
            elif kind == 0xDD:
                (self.interval,) = struct.unpack(">H", body)
            elif kind == 0xDA:
                self.scan = {body[1 + 2 * i]: (body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])}
                if len(self.scan) != len(self.components):
                    raise ValueError("not an interleaved scan of all components")
                break
        self.start = at
        while True:
            at = raw.find(b"\xff", at)
            if at < 0 or at + 1 >= len(raw):
                self.stop = self.end = len(raw)
                break
            if raw[at + 1] == 0 or 0xD0 <= raw[at + 1] <= 0xD7:
                at += 2
                continue
            self.stop, self.end = at, at + 2 if raw[at + 1] == 0xD9 else at
            break

    def layout(self) -> tuple:
        """The blocks of an MCU, in order: (component, DC table, AC table); images of one layout decode together."""
        one = len(self.components) == 1
        return tuple((i, self.tables[self.scan[c][0]], self.tables[16 + self.scan[c][1]]) for i, (c, h, v, _) in enumerate(self.components) for _ in range(1 if one else h * v))

    def mcus(self) -> tuple[int, int]:
        one = len(self.components) == 1
        h = 1 if one else max(c[1] for c in self.components)
        v = 1 if one else max(c[2] for c in self.components)
        return -(-self.height // (8 * v)), -(-self.width // (8 * h))

    def thumbnail(self, dc: np.ndarray, blocks: list[int]) -> np.ndarray:
        """Luminance samples from the scan's DC values (MCU, block of the MCU)."""
        rows, columns = self.mcus()
        _, h, v, q = self.components[0]
        if len(self.components) == 1:
            h = v = 1
        luma = dc[:, [i for i, c in enumerate(blocks) if c == 0]].reshape(rows, columns, v, h).transpose(0, 2, 1, 3).reshape(rows * v, columns * h)
        most = max(c[1] for c in self.components), max(c[2] for c in self.components)
        luma = luma[: -(-self.height * v // (8 * (1 if len(self.components) == 1 else most[1]))), : -(-self.width * h // (8 * (1 if len(self.components) == 1 else most[0])))]
        return np.clip((luma * self.quant[q] + 4) // 8 + 128, 0, 255).astype(np.uint8)


def _codes(sizes: list[int]) -> list[tuple[int, int]]:
    out, code, last = [], 0, sizes[0] if sizes else 0
    for n in sizes:
        code <<= n - last
        out.append((code, n))
        code, last = code + 1, n
    return out


@lru_cache(64)
def _lookup(table: tuple[tuple[int, int, int], ...]) -> tuple[np.ndarray, np.ndarray]:
    """By the next 16 bits: the symbol, and its code's length (0: no code)."""
    symbol, length = np.zeros(1 << 16, np.uint8), np.zeros(1 << 16, np.uint8)
    for s, code, n in table:
        symbol[code << (16 - n) : (code + 1) << (16 - n)] = s
        length[code << (16 - n) : (code + 1) << (16 - n)] = n
    return symbol, length


@lru_cache(64)
def _fused(dc: tuple, ac: tuple) -> tuple[np.ndarray, np.ndarray]:
    """By the next 16 bits: DC difference and length of a whole block without AC values (length 0: decode step by step)."""
    window = np.arange(1 << 16)
    size, n = (x.astype(np.int64) for x in _lookup(dc))
    extra = (window >> np.maximum(0, 16 - n - size)) & ((1 << size) - 1)
    diff = np.where(extra >= (1 << np.maximum(size - 1, 0)), extra, extra - (1 << size) + 1)
    diff[size == 0] = 0
    rest = (window << (n + size)) & 0xFFFF
    symbol, more = _lookup(ac)
    total = n + size + more[rest]
    good = (n > 0) & (more[rest] > 0) & (symbol[rest] == 0) & (total <= 16)
    return diff.astype(np.int16), np.where(good, total, 0).astype(np.int8)


def _decode(raw: bytes, images: list[Image], offsets: list[int], layout: tuple) -> list[np.ndarray]:
    """DC values (MCU, block) of images of one layout. offsets: where each image's bytes begin in raw."""
    buffer = np.frombuffer(raw, np.uint8)
    starts = np.array([o + m.start for o, m in zip(offsets, images)], np.int64)
    stops = np.array([o + m.stop for o, m in zip(offsets, images)], np.int64)
    inside = np.zeros(len(buffer) + 1, np.int8)
    np.add.at(inside, starts, 1)
    np.add.at(inside, stops, -1)
    keep = np.cumsum(inside[:-1], dtype=np.int8).view(bool)
    ff = np.flatnonzero((buffer[:-1] == 255) & keep[:-1])
    after = buffer[ff + 1]
    marks = ff[(after & 0xF8) == 0xD0]
    marks = marks[keep[marks]]
    keep[ff[after == 0] + 1] = False
    keep[marks] = keep[marks + 1] = False
    begin = np.sort(np.concatenate([starts, marks + 2]))
    kept = np.concatenate([[0], np.cumsum(keep)])
    data = np.concatenate([buffer[keep], np.zeros(16, np.uint8)]).astype(np.uint32)
    pos = kept[begin] * 8
    # How many MCUs each restart interval holds.
    total = np.array([m.mcus()[0] * m.mcus()[1] for m in images])
    step = np.array([m.interval or t for m, t in zip(images, total)])
    per = -(-total // step)
    if int(per.sum()) != len(begin):
        raise ValueError("restart markers do not match the image")
    owner = np.repeat(np.arange(len(images)), per)
    nth = np.arange(len(begin)) - np.repeat(np.cumsum(per) - per, per)
    count = np.minimum(step[owner], total[owner] - nth * step[owner])
    order = np.argsort(-count, kind="stable")
    pos, left = pos[order], count[order]
    blocks = len(layout)
    dc = np.zeros((int(count.max()), blocks, len(begin)), np.int16)
    last = np.zeros((max(c for c, _, _ in layout) + 1, len(begin)), np.int16)
    limit = 8 * (len(data) - 4)

    def window(p: np.ndarray) -> np.ndarray:
        p = np.minimum(p, limit)
        i = p >> 3
        return ((data[i] << 16 | data[i + 1] << 8 | data[i + 2]) >> (8 - (p & 7)).astype(np.uint32)) & 0xFFFF

    for t in range(dc.shape[0]):
        live = int(np.searchsorted(-left, -t, "left"))
        for b, (component, dc_table, ac_table) in enumerate(layout):
            diffs, lengths = _fused(dc_table, ac_table)
            p = pos[:live]
            w = window(p)
            d, n = diffs[w], lengths[w]
            pos[:live] = p + n
            slow = np.flatnonzero(n == 0)
            if len(slow):
                d[slow], pos[slow] = _block(window, p[slow], dc_table, ac_table)
            last[component, :live] += d
            dc[t, b, :live] = last[component, :live]
    where = np.empty(len(order), np.int64)
    where[order] = np.arange(len(order))
    dc = np.ascontiguousarray(dc.transpose(2, 0, 1))[where]
    ends = np.cumsum(per)
    return [dc[e - k : e].reshape(-1, blocks)[:t] if t == k * dc.shape[1] else np.concatenate([dc[i, :c] for i, c in zip(range(e - k, e), count[e - k : e])]) for e, k, t in zip(ends.tolist(), per.tolist(), total.tolist())]


def _block(window, pos: np.ndarray, dc_table: tuple, ac_table: tuple) -> tuple[np.ndarray, np.ndarray]:
    """One block at each bit position, symbol by symbol: the DC difference, and where the next block begins."""
    symbol, length = _lookup(dc_table)
    w = window(pos)
    size, n = symbol[w].astype(np.int64), length[w].astype(np.int64)
    if (n == 0).any():
        raise ValueError("no such DC code")
    pos = pos + n
    extra = window(pos).astype(np.int64) >> (16 - size)
    diff = np.where(extra >= (1 << np.maximum(size - 1, 0)), extra, extra - (1 << size) + 1)
    diff[size == 0] = 0
    pos = pos + size
    symbol, length = _lookup(ac_table)
    k = np.ones(len(pos), np.int64)
    while (k < 64).any():
        on = np.flatnonzero(k < 64)
        w = window(pos[on])
        s, n = symbol[w].astype(np.int64), length[w].astype(np.int64)
        if (n == 0).any():
            raise ValueError("no such AC code")
        pos[on] += n + (s & 15)
        k[on] = np.where(s == 0, 64, k[on] + (s >> 4) + 1)
    return diff, pos


def thumbnails(media: list[bytes]) -> list[list[tuple[Image, np.ndarray]]]:
    """For each value, its images in order, each with its luminance thumbnail."""
    found: list[tuple[int, Image, int]] = []
    at = 0
    for i, raw in enumerate(media):
        begin = 0
        while begin < len(raw):
            image = Image(raw, begin)
            found.append((i, image, at))
            begin = image.end
        at += len(raw)
    groups: dict[tuple, list[int]] = {}
    for k, (_, image, _) in enumerate(found):
        groups.setdefault(image.layout(), []).append(k)
    joined = b"".join(media) + b"\0"
    out: list[list[tuple[Image, np.ndarray]]] = [[] for _ in media]
    ready: dict[int, np.ndarray] = {}
    for layout, members in groups.items():
        for k, dc in zip(members, _decode(joined, [found[k][1] for k in members], [found[k][2] for k in members], layout)):
            ready[k] = found[k][1].thumbnail(dc.astype(np.int32), [b[0] for b in layout])
    for k, (i, image, _) in enumerate(found):
        out[i].append((image, ready[k]))
    return out


def thumbnail_groups(media: list[bytes], most_bytes: int = 2 * GROUP_BYTES) -> Iterator[list[tuple[int, Image, np.ndarray]]]:
    """All images of all values in order, each with its value's index and its thumbnail, in groups of about most_bytes.

    Values together below that are decoded at once; else images are cut out first, so that memory does not
    follow the longest value.
    """
    if sum(map(len, media)) <= 2 * most_bytes:
        yield [(i, image, thumb) for i, own in enumerate(thumbnails(media)) for image, thumb in own]
        return
    held: list[tuple[int, bytes]] = []
    size = 0
    for i, raw in enumerate(media):
        begin = 0
        while begin < len(raw):
            end = Image(raw, begin).end
            held.append((i, raw[begin:end]))
            size, begin = size + end - begin, end
            if size >= most_bytes:
                yield [(k, *own[0]) for (k, _), own in zip(held, thumbnails([x for _, x in held]))]
                held, size = [], 0
    if held:
        yield [(k, *own[0]) for (k, _), own in zip(held, thumbnails([x for _, x in held]))]


def difference_hash(thumb: np.ndarray) -> int:
    """64 bits: over an 8 x 9 grid of cell means, whether each cell is brighter than the one to its left."""
    h, w = thumb.shape
    top, left = np.arange(8) * h // 8, np.arange(9) * w // 9
    sums = np.add.reduceat(np.add.reduceat(thumb.astype(np.int64), top, 0), left, 1)
    tall, wide = np.maximum(np.diff(top, append=h), 1), np.maximum(np.diff(left, append=w), 1)
    means = sums / (tall[:, None] * wide)
    return int.from_bytes(np.packbits(means[:, 1:] > means[:, :-1]).tobytes(), "big")


def pad(raw: bytes) -> bytes:
    return raw + b"\0" * (-len(raw) % ROW or (0 if raw else ROW))


MEDIA = "doc_id long, n_bytes long, media binary"
FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in slices(batch, "text", 1 << 20):
            raw = piece.column(1).cast(pa.binary()).fill_null(b"").to_pylist()
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array([len(x) for x in raw], pa.int64()), pa.array(encode_payloads([pad(x) for x in raw]), pa.binary())], names=["doc_id", "n_bytes", "media"])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in slices(batch, "media", 2 << 20):
            stored = piece.column(2).to_pylist()
            digests, sizes, tails = [hashlib.sha256() for _ in stored], [0] * len(stored), [b""] * len(stored)
            found: list[list[str]] = [[] for _ in stored]
            for group in thumbnail_groups(stored):
                for i, image, thumb in group:
                    payload = thumb.tobytes()
                    digests[i].update(payload)
                    sizes[i] += len(payload)
                    tails[i] = (tails[i] + payload[-ROW:])[-ROW:]
                    found[i].append(f"{image.width}x{image.height}:{difference_hash(thumb):016x}")
            rows = [(n, d.hexdigest(), zlib.crc32(t), len(raw), hashlib.sha256(raw).hexdigest(), ",".join(f)) for n, d, t, raw, f in zip(sizes, digests, tails, stored, found)]
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))], names=[x.split()[0] for x in FEATURES.split(", ")])


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media: each text's padded UTF-8 as JPEG, one row a row of docs, repeated ids included.

    Null text counts as empty; other columns are ignored; an empty table gives an empty result.
    """
    return map_arrow(_texts(docs), _store, MEDIA)


def features(media: DataFrame) -> DataFrame:
    """Reads stored images back. feature: width x height:thumbnail hash of each image, comma-joined.

    One row a row of media, repeated ids and equal media included; equal media give equal values.
    """
    return map_arrow(media.select("doc_id", "n_bytes", "media"), _features, FEATURES)


def stored_features(docs: DataFrame) -> DataFrame:
    """features(store(docs)) in one worker, so that images need not travel between two."""
    return map_arrow(_texts(docs), lambda batches: _features(_store(batches)), FEATURES)


def op4_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored_features(documents(spark, sf_dir))
