"""Baseline JPEG as a media column: read and write in numpy.

The reader parses markers, decodes the Huffman-coded scan and rebuilds the
luminance thumbnail that the DC coefficients alone give (one pixel per 8 x 8
block).  Restart intervals are independent, so all intervals of the images of a
batch that share tables are decoded side by side, one symbol of each at a time.
Images with few intervals, like those of cameras and the web, are decoded one
interval after the other.

The writer stores bytes without loss.  The format's unit that survives coding
is the quantized coefficient: 64 bytes make a block, one coefficient each in
zigzag order.  The values +-128..255 are exactly the 256 of size category 8, so
a byte is that category's code and its own eight bits.  A restart follows each
block, which makes DC differences the DC values themselves.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_lengths, guarded_id, guarded_type, restored_id, runs, text_bytes

SIZE = 8
#: Quantizer of the DC coefficient: with it a DC of +-255 spans the luminance range.
DC_STEP = 4
MAX_SIDE = 65535 // 8


def _marker(code: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, code, len(body) + 2) + body


# Huffman tables of the writer: code lengths 1..16 (how many codes each), then symbols.
_DC_TABLE = bytes([1, 1] + [0] * 14) + bytes([SIZE, 0])
_AC_TABLE = bytes([1, 1] + [0] * 14) + bytes([SIZE, 0])


def encode(payloads: list[bytes]) -> list[bytes]:
    """A JPEG for each payload, whose length must be a positive multiple of 64."""
    grids = []
    for p in payloads:
        n = len(p) // 64
        wide = max(-(-n // MAX_SIDE), int(np.ceil(np.sqrt(n))))
        grids.append((n, wide, -(-n // wide)))
    blank = bytes(64)
    raw = np.frombuffer(b"".join(x for p, (n, w, h) in zip(payloads, grids, strict=True) for x in (p, blank * (w * h - n))), np.uint8).reshape(-1, 8, 8)
    bits = np.zeros((len(raw), 8, 9), np.uint8)  # eight symbols of nine bits: a 0 (the code of SIZE) and the byte
    for j in range(9):
        if j:
            bits[:, :, j] = raw[:, :, j - 1] << (8 - j) if j < 8 else raw[:, :, 7]
        if j < 8:
            bits[:, :, j] |= raw[:, :, j] >> (j + 1)
    coded = np.empty((len(raw), 74), np.uint8)
    coded[:, :72] = bits.reshape(-1, 72)
    coded[:, 72] = 0xFF
    out, at = [], 0
    for p, (n, w, h) in zip(payloads, grids, strict=True):
        scan = coded[at : at + w * h]
        at += w * h
        scan[:, 73] = 0xD0 + np.arange(w * h) % 8
        scan[-1, 73] = 0xD9
        if (scan[:, :72] == 0xFF).any():
            body = b"".join(row[:72].tobytes().replace(b"\xff", b"\xff\x00") + row[72:].tobytes() for row in scan)
        else:
            body = scan.tobytes()
        out.append(
            b"\xff\xd8" + _marker(0xFE, b"payload %d" % len(p)) + _marker(0xDB, b"\x00" + bytes([DC_STEP]) + bytes([1] * 63))
            + _marker(0xC0, struct.pack(">BHHB", 8, h * 8, w * 8, 1) + bytes([1, 0x11, 0])) + _marker(0xC4, b"\x00" + _DC_TABLE)
            + _marker(0xC4, b"\x10" + _AC_TABLE) + _marker(0xDD, struct.pack(">H", 1)) + _marker(0xDA, bytes([1, 1, 0x00, 0, 63, 0])) + body
        )
    return out


@dataclass
class Header:
    width: int = 0
    height: int = 0
    components: list[tuple[int, int, int, int]] = field(default_factory=list)  # id, h, v, quantizer
    quantizers: dict[int, np.ndarray] = field(default_factory=dict)
    tables: dict[tuple[int, int], bytes] = field(default_factory=dict)
    scan: list[tuple[int, int, int]] = field(default_factory=list)  # component, DC table, AC table
    restart: int = 0
    comment: bytes = b""
    at: int = 0


def parse(data: bytes) -> Header:
    """The markers up to the first scan of a baseline JPEG; ValueError for any other."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("no start of image")
    out, at = Header(), 2
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            raise ValueError(f"no marker at {at}")
        code = data[at + 1]
        if code == 0xFF:
            at += 1
            continue
        length = struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + length]
        at += 2 + length
        if code == 0xDB:
            while body:
                wide = body[0] >> 4
                out.quantizers[body[0] & 15] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else np.uint8).astype(np.int32)
                body = body[65 + 64 * wide :]
        elif code == 0xC4:
            while body:
                n = 17 + sum(body[1:17])
                out.tables[body[0] >> 4, body[0] & 15] = body[1:n]
                body = body[n:]
        elif code == 0xC0:
            bits, out.height, out.width, n = struct.unpack_from(">BHHB", body)
            if bits != 8:
                raise ValueError("not 8 bits a sample")
            out.components = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
        elif 0xC1 <= code <= 0xCF and code != 0xC8 and code != 0xCC:
            raise ValueError("not baseline")
        elif code == 0xDD:
            out.restart = struct.unpack(">H", body)[0]
        elif code == 0xFE:
            out.comment = body
        elif code == 0xDA:
            ids = [c[0] for c in out.components]
            out.scan = [(ids.index(body[1 + 2 * i]), body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])]
            out.at = at
            return out
    raise ValueError("no scan")


#: Tables whose lookups are kept, 256 KB each.
LOOKUPS = 64


@lru_cache(LOOKUPS)
def _lookup(table: bytes) -> np.ndarray:
    """For the next 16 bits: code length * 256 + symbol; 0 where no code starts so."""
    out, code, at = np.zeros(65536, np.int32), 0, 16
    for length in range(1, 17):
        for _ in range(table[length - 1]):
            first = code << (16 - length)
            out[first : first + (1 << (16 - length))] = length << 8 | table[at]
            code, at = code + 1, at + 1
        code <<= 1
    return out


def _segments(scan: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The scan's bytes without stuffing and markers, and where each restart interval begins and ends in them."""
    ff = np.flatnonzero(scan[:-1] == 0xFF)
    follows = scan[ff + 1]
    stuffed, restarts = ff[follows == 0], ff[(follows >= 0xD0) & (follows <= 0xD7)]
    other = ff[(follows != 0) & (follows != 0xFF) & ((follows < 0xD0) | (follows > 0xD7))]
    end = int(other[0]) if len(other) else len(scan)
    restarts, stuffed = restarts[restarts < end], stuffed[stuffed < end]
    keep = np.ones(end, bool)
    keep[stuffed + 1] = False
    keep[restarts] = False
    keep[restarts + 1] = False
    place = np.concatenate(([0], np.cumsum(keep)))
    starts = np.concatenate(([0], restarts + 2))
    return scan[:end][keep], place[np.minimum(starts, end)], place[np.concatenate((restarts, [end]))]


_BROKEN = (ValueError, IndexError, KeyError, OverflowError, struct.error)


def _units(header: Header) -> tuple[tuple, int]:
    """The scan's components (sampling, DC table, AC table), and how many units it has."""
    shape = tuple((header.components[c][1:3], header.tables[0, d], header.tables[1, a]) for c, d, a in header.scan)
    most_h, most_v = max(c[1] for c in header.components), max(c[2] for c in header.components)
    size = shape[0][0] if len(shape) == 1 else (1, 1)
    return shape, -(-header.width * size[0] // (8 * most_h)) * -(-header.height * size[1] // (8 * most_v))


def _checked(data: bytes) -> tuple[Header, tuple, int] | None:
    """Header, components and units of a restart interval; None if it isn't a baseline JPEG, or says more blocks than its bytes can hold."""
    try:
        header = parse(data)
        shape, units = _units(header)
        blocks = units * (1 if len(shape) == 1 else sum(h * v for (h, v), _, _ in shape))
        scan = len(data) - header.at
        # a block has two codes at least, of a bit each
        if not 0 < blocks <= 4 * scan:
            return None
        _, starts, _ = _segments(np.frombuffer(data, np.uint8)[header.at :])
        interval = min(header.restart or units, units)
        return (header, shape, interval) if len(starts) == -(-units // interval) else None
    except _BROKEN:
        return None


def decode(images: list[bytes], keep: int = 64) -> list[tuple[Header, list[np.ndarray]] | None]:
    """Header and, for each component, its quantized coefficients (blocks down, blocks across, the first ``keep`` of 64 in zigzag order).

    None for what isn't a whole baseline JPEG: other formats, truncated or
    altered data whose codes don't fit.  Work and memory are bounded by the
    bytes there are.
    """
    checked = [_checked(x) for x in images]
    headers = [x and x[0] for x in checked]
    groups: dict[tuple, list[int]] = {}
    for i, x in enumerate(checked):
        if x:
            groups.setdefault(x[1:], []).append(i)
    out: list[list[np.ndarray] | None] = [[] if x else None for x in checked]
    for (shape, interval), members in groups.items():
        try:
            _decode_group(images, headers, members, shape, interval, out, keep)
        except _BROKEN:  # one of them; which?
            for i in members:
                out[i] = []
                try:
                    _decode_group(images, headers, [i], shape, interval, out, keep)
                except _BROKEN:
                    out[i] = None
    return [None if parts is None else (header, parts) for header, parts in zip(headers, out, strict=True)]


#: Restart intervals that are worth a step of numpy for each symbol; fewer are read one after the other.
SIDE_BY_SIDE = 128
#: Bytes 0 behind the data: more than the codes of a block can reach.
_BEHIND = 512


def _read_lane(word, at: int, end: int, units: int, order, blocks, keep: int) -> bool:
    """The units of one restart interval, symbol by symbol from bit ``at``; False if its codes don't fit.

    ``word`` has the 32 bits from each byte on, ``blocks`` a flat view of the
    coefficients of each component.
    """
    past, spots = [0] * len(order), [0] * len(order)
    for _ in range(units):
        for k, times, dc, ac in order:
            here = blocks[k]
            for _ in range(times):
                if at > end:
                    return False
                got = dc[(word[at >> 3] >> (16 - (at & 7))) & 0xFFFF]
                if not got:
                    return False
                at += got >> 8
                size = got & 15
                if size:
                    value = (word[at >> 3] >> (32 - (at & 7) - size)) & ((1 << size) - 1)
                    at += size
                    past[k] += value if value >> (size - 1) else value - (1 << size) + 1
                if not -32768 <= past[k] <= 32767:
                    return False
                begin = spots[k]
                spots[k] += keep
                here[begin] = past[k]
                spot = 1
                while spot < 64:
                    got = ac[(word[at >> 3] >> (16 - (at & 7))) & 0xFFFF]
                    if not got:
                        return False
                    at += got >> 8
                    size = got & 15
                    if not size:
                        if got & 255 != 0xF0:
                            break
                        spot += 16
                        continue
                    spot += (got & 255) >> 4
                    if spot < keep:
                        value = (word[at >> 3] >> (32 - (at & 7) - size)) & ((1 << size) - 1)
                        here[begin + spot] = value if value >> (size - 1) else value - (1 << size) + 1
                    at += size
                    spot += 1
    return at <= end


def _decode_group(images, headers, members, shape, interval, out, keep) -> None:
    """Images with the same tables and interval, all their intervals side by side, or each by itself if they are few."""
    datas, begins, ends, lanes, todo, base = [], [], [], [], [], 0
    for i in members:
        data, start, end = _segments(np.frombuffer(images[i], np.uint8)[headers[i].at :])
        datas.append(data)
        begins.append(start + base)
        ends.append(end + base)
        lanes.append(len(start))
        todo += [interval] * (len(start) - 1) + [_units(headers[i])[1] - interval * (len(start) - 1)]  # the last may be shorter
        base += len(data)
    data = np.concatenate([*datas, np.zeros(_BEHIND, np.uint8)]).astype(np.uint32)
    word = data[:-3] << 24 | data[1:-2] << 16 | data[2:-1] << 8 | data[3:]
    word = word.astype(np.int64)
    last = len(word) - 1
    at = np.concatenate(begins).astype(np.int64) * 8
    strange = np.zeros(len(at), bool)  # lanes with a code that no table has
    single = len(shape) == 1
    order = [(k, 1 if single else size[0] * size[1], _lookup(dc), _lookup(ac)) for k, (size, dc, ac) in enumerate(shape)]
    blocks = [np.zeros((len(at), interval * times, keep), np.int16) for _, times, _, _ in order]
    if len(at) < SIDE_BY_SIDE:
        plain = [(k, times, memoryview(dc), memoryview(ac)) for k, times, dc, ac in order]
        for lane, (begin, end, count) in enumerate(zip(at.tolist(), (np.concatenate(ends) * 8).tolist(), todo, strict=True)):
            strange[lane] = not _read_lane(memoryview(word), begin, end, count, plain, [memoryview(x[lane].reshape(-1)) for x in blocks], keep)
        _gather(headers, members, lanes, strange, blocks, shape, interval, out)
        return
    past = [np.zeros(len(at), np.int32) for _ in order]
    masks = (1 << np.arange(17)) - 1

    def take(rows, table):
        """Next symbol of the lanes ``rows`` (a slice or indexes) and the value of its extra bits."""
        p = at[rows]
        got = table[(word[np.minimum(p >> 3, last)] >> (16 - (p & 7))) & 0xFFFF]
        strange[rows] |= got == 0
        p += got >> 8
        symbol = got & 255
        size = symbol & 15
        extra = (word[np.minimum(p >> 3, last)] >> np.maximum(32 - (p & 7) - size, 0)) & masks[size]
        at[rows] = p + size
        return symbol, np.where(extra < (1 << size) >> 1, extra - masks[size], extra)

    everyone, todo = slice(None), np.array(todo)
    ended, failed = np.zeros_like(at), np.zeros_like(strange)  # where a lane stood after its last unit
    for mcu in range(interval):
        over = todo == mcu
        ended[over], failed[over] = at[over], strange[over]
        for k, times, dc, ac in order:
            for b in range(times):
                here = blocks[k][:, mcu * times + b]
                _, value = take(everyone, dc)
                past[k] += value.astype(np.int32)
                strange |= np.abs(past[k]) > 32767
                here[:, 0] = past[k]
                spot, rows = np.ones(len(at), np.int64), everyone
                together = 1  # all lanes at the same coefficient, until one differs
                while True:
                    symbol, value = take(rows, ac)
                    run = symbol >> 4
                    if together and not run.any() and (symbol & 15).all():
                        if together < keep:
                            here[:, together] = value
                        together += 1
                        if together == 64:
                            break
                        continue
                    if together:
                        spot, together, rows = np.full(len(at), together), 0, np.arange(len(at))
                    spot = spot + run
                    hit = ((symbol & 15) > 0) & (spot < keep)
                    here[rows[hit], spot[hit]] = value[hit]
                    go = (spot + 1 < 64) & (((symbol & 15) > 0) | (symbol == 0xF0))
                    rows, spot = rows[go], spot[go] + 1
                    if not len(rows):
                        break
    over = todo == interval
    ended[over], failed[over] = at[over], strange[over]
    strange = failed | (ended > np.concatenate(ends) * 8)
    _gather(headers, members, lanes, strange, blocks, shape, interval, out)


def _gather(headers, members, lanes, strange, blocks, shape, interval, out) -> None:
    """The lanes' blocks as a grid for each image and component; None where a lane is strange."""
    single, lane = len(shape) == 1, 0
    for i, n in zip(members, lanes, strict=True):
        h = headers[i]
        if strange[lane : lane + n].any():
            out[i] = None
            lane += n
            continue
        most_h, most_v = max(c[1] for c in h.components), max(c[2] for c in h.components)
        across, down = -(-h.width // (8 * most_h)), -(-h.height // (8 * most_v))
        for k, (size, _, _) in enumerate(shape):
            times = blocks[k].shape[1] // interval
            keep = blocks[k].shape[2]
            flat = blocks[k][lane : lane + n].reshape(-1, times, keep)
            if single:
                wide, high = -(-h.width * size[0] // (8 * most_h)), -(-h.height * size[1] // (8 * most_v))
                out[i].append(flat[: wide * high].reshape(high, wide, keep))
            else:
                grid = flat[: across * down].reshape(down, across, size[1], size[0], keep)
                out[i].append(grid.transpose(0, 2, 1, 3, 4).reshape(down * size[1], across * size[0], keep))
        lane += n


def thumbnail(header: Header, luminance: np.ndarray) -> np.ndarray:
    """One pixel per block of the first component: the block's mean, from its DC alone."""
    step = int(header.quantizers[header.components[0][3]][0])
    return np.clip(np.rint(luminance[:, :, 0].astype(np.int32) * step / 8 + 128), 0, 255).astype(np.uint8)


def average_hash(pixels: np.ndarray) -> str:
    """64 bits: which of 8 x 8 sampled pixels lie above their mean."""
    h, w = pixels.shape
    small = pixels[(np.arange(8) * 2 + 1) * h // 16][:, (np.arange(8) * 2 + 1) * w // 16]
    return np.packbits(small > small.mean()).tobytes().hex()


def payload_of(header: Header, luminance: np.ndarray) -> bytes:
    """The bytes that encode() stored."""
    flat = luminance.reshape(-1)[: int(header.comment.split()[1])]
    return np.where(flat > 0, flat, flat + 255).astype(np.uint8).tobytes()


def describe(media: list[bytes | None]) -> list[tuple[int, int, str, str] | None]:
    """Width, height, thumbnail hash and thumbnail checksum of each JPEG; None where it isn't a baseline JPEG."""
    out: list = [None] * len(media)
    there = [i for i, x in enumerate(media) if x]
    for i, found in zip(there, decode([media[i] for i in there], keep=1), strict=True):
        try:
            if found:
                pixels = thumbnail(found[0], found[1][0])
                out[i] = (found[0].width, found[0].height, average_hash(pixels), f"{zlib.crc32(pixels.tobytes()):08x}")
        except _BROKEN:  # its quantizer is missing
            pass
    return out


def add_media_features(df: DataFrame, media: str = "media") -> DataFrame:
    """Add width, height, thumb_hash and thumb_crc to a table with a binary column of JPEGs.

    NULL, empty, broken, truncated and non-baseline images get NULL in all
    four.  Repeated rows are read each; an empty table gives no rows; columns
    of the four names are replaced, all others stay.
    """

    @F.pandas_udf("width int, height int, thumb_hash string, thumb_crc string")
    def features(column: pd.Series) -> pd.DataFrame:
        rows = []
        held = [None if x is None else bytes(x) for x in column]
        for a, b in runs(byte_lengths([x or b"" for x in held])):
            rows += [x or (None, None, None, None) for x in describe(held[a:b])]
        out = pd.DataFrame(rows, columns=["width", "height", "thumb_hash", "thumb_crc"])
        return out.astype({"width": "Int32", "height": "Int32"})

    held = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), features(F.col(media)).alias("_features"))
    names = ["width", "height", "thumb_hash", "thumb_crc"]
    return held.select(*[F.col(f"_row.`{c}`") for c in df.columns if c not in names], *[f"_features.{c}" for c in names])


def store_texts(df: DataFrame, id_col: str = "doc_id", text: str = "text", with_media: bool = False) -> DataFrame:
    """Store each text in a JPEG, read it back and describe both.

    (id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes,
    media_sha256, feature[, media]).  NULL is stored like an empty text, 64
    bytes 0; a text of any length is stored whole.  Repeated rows are stored
    each; an empty table gives no rows; other columns are not read.
    """
    schema = f"_id {guarded_type(df, id_col)}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string" + (", media binary" if with_media else "")

    def store(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for a, b in runs(byte_lengths(pdf["_text"])):
                texts = [bytes(x) for x in pdf["_text"][a:b]]
                media = encode([t + bytes(max(64, -(-len(t) // 64) * 64) - len(t)) for t in texts])
                rows = []
                for key, t, m, (header, parts) in zip(pdf["_id"][a:b], texts, media, decode(media), strict=True):
                    back, pixels = payload_of(header, parts[0]), thumbnail(header, parts[0])
                    feature = f"{header.width}x{header.height}:{average_hash(pixels)}:{zlib.crc32(pixels.tobytes()):08x}"
                    row = (key, len(t), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(m), hashlib.sha256(m).hexdigest(), feature)
                    rows.append(row + ((m,) if with_media else ()))
                yield pd.DataFrame(rows, columns=[f.split()[0] for f in schema.split(", ")])

    stored = df.select(guarded_id(df, id_col), text_bytes(text).alias("_text")).mapInPandas(store, schema)
    return stored.select(restored_id(df, id_col), *stored.columns[1:])


def op5(spark, sf_dir: str) -> DataFrame:
    return store_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
