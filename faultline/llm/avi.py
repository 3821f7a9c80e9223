"""AVI motion-JPEG as a media column (operator 2).

A payload is a column of bytes. It is stored as 8-bit grey samples in frames of ``WIDTH`` x ``HEIGHT``, each
a lossless JPEG image (SOF3: left predictor, Huffman-coded differences, one restart interval a
line) in a ``00dc`` chunk of a RIFF/AVI file with header, stream and ``idx1`` index; the last frame is
filled with zeros, and a ``strd`` chunk holds the payload's true length. Reading follows the index
to the intra frames, decodes them, and detects shots: the distance of the grey histograms of
neighbouring frames counts as a cut where it exceeds the mean of the distances before it in the
shot by ``SIGMAS`` of their standard deviations, and ``LEAST`` at least. Clips are timed by the
header's frame duration.

Lines are independent, so coding and decoding work on all lines of many files at once, one sample
of every line a step, in slabs of bounded size.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store
from .tokens import groups_of

WIDTH, HEIGHT, MICROS = 64, 16, 40_000
FRAME = WIDTH * HEIGHT
SLAB = 1 << 20
SIGMAS, LEAST, BINS = 3.0, 0.12, 16
#: Huffman code length of each difference category from 0 to 8
CODE_LENGTHS = (5, 5, 4, 3, 2, 4, 6, 2, 6)


def _codes() -> dict[int, tuple[int, int]]:
    code, last, out = 0, 0, {}
    for n, cat in sorted((n, c) for c, n in enumerate(CODE_LENGTHS)):
        code <<= n - last
        out[cat], code, last = (code, n), code + 1, n
    return out


def _jpeg_header(width: int, height: int) -> bytes:
    order = [c for _, c in sorted((n, c) for c, n in enumerate(CODE_LENGTHS))]
    counts = bytes(CODE_LENGTHS.count(n) for n in range(1, 17))
    dht = b"\0" + counts + bytes(order)
    return b"".join([
        b"\xff\xd8",
        b"\xff\xc4" + struct.pack(">H", len(dht) + 2) + dht,
        b"\xff\xc3" + struct.pack(">HBHHB", 11, 8, height, width, 1) + b"\x01\x11\x00",
        b"\xff\xdd" + struct.pack(">HH", 4, width),
        b"\xff\xda" + struct.pack(">HB", 8, 1) + b"\x01\x00" + b"\x01\x00\x00",
    ])


_tables: dict[str, object] = {}


def _encode_table():
    """For each difference + 255: number of bits, and the bits."""
    import numpy as np

    if "enc" not in _tables:
        codes, bits, value = _codes(), np.zeros(511, np.int64), np.zeros(511, np.int64)
        for d in range(-255, 256):
            cat = abs(d).bit_length()
            code, n = codes[cat]
            extra = d if d >= 0 else d + (1 << cat) - 1
            bits[d + 255], value[d + 255] = n + cat, code << cat | extra
        _tables["enc"] = (bits, value)
    return _tables["enc"]


def _decode_table(counts: bytes, symbols: bytes):
    """For each value of the next bits: difference and number of bits used, from a frame's own DHT."""
    import numpy as np

    key = ("dec", counts, symbols)
    if key not in _tables:
        rows, code, i = [], 0, 0
        for n in range(1, 17):
            for _ in range(counts[n - 1]):
                rows.append((n, code, symbols[i]))
                code, i = code + 1, i + 1
            code <<= 1
        most = max(n + cat for n, _, cat in rows)
        diff, used = np.zeros(1 << most, np.int16), np.zeros(1 << most, np.int8)
        for n, code, cat in rows:
            a = code << (most - n)
            x = np.arange(1 << (most - n)) >> (most - n - cat)
            diff[a : a + len(x)] = np.where(x >= (1 << cat >> 1), x, x - (1 << cat) + 1) if cat else 0
            used[a : a + len(x)] = n + cat
        _tables[key] = (most, diff, used)
    return _tables[key]


def _jpegs(samples) -> list[bytes]:
    """A JPEG image for each FRAME samples."""
    import numpy as np

    head = _jpeg_header(WIDTH, HEIGHT)
    nbits, value = _encode_table()
    x = samples.reshape(-1, WIDTH).astype(np.int32)
    d = np.empty_like(x)
    d[:, 0] = x[:, 0] - 128
    np.subtract(x[:, 1:], x[:, :-1], out=d[:, 1:])
    d += 255
    n = nbits[d]
    ends = n.cumsum(axis=1)
    row_bits = ends[:, -1]
    row_bytes = (row_bits + 7) >> 3
    lead = np.zeros(len(x), np.int64)
    lead[::HEIGHT] = len(head)
    row_at = np.cumsum(lead + row_bytes + 2) - row_bytes - 2
    p = (row_at[:, None] * 8 + ends - n).ravel()
    n = n.ravel()
    v = value[d].ravel() << (24 - n - (p & 7))
    at = p >> 3
    size = int(row_at[-1] + row_bytes[-1] + 2)
    buf = np.zeros(size + 2, np.float64)
    for k, part in enumerate((v >> 16, v >> 8 & 255, v & 255)):
        buf += np.bincount(at + k, weights=part, minlength=size + 2)[: size + 2]
    pad = row_bytes * 8 - row_bits
    buf[row_at + row_bytes - 1] += (1 << pad) - 1
    buf = buf[:size].astype(np.uint8)
    stuff = np.flatnonzero(buf == 255)
    mark = row_at + row_bytes
    buf[mark] = 255
    buf[mark + 1] = 0xD0 + np.arange(len(x)) % HEIGHT % 8
    buf[mark[HEIGHT - 1 :: HEIGHT] + 1] = 0xD9
    starts = row_at[::HEIGHT] - len(head)
    buf[(starts[:, None] + np.arange(len(head))).ravel()] = np.tile(np.frombuffer(head, np.uint8), len(starts))
    raw = np.insert(buf, stuff + 1, 0).tobytes()
    cut = starts + np.searchsorted(stuff, starts)
    cut = [*cut.tolist(), len(raw)]
    return [raw[a:b] for a, b in zip(cut, cut[1:])]


def _chunk(name: bytes, data: bytes) -> bytes:
    return name + struct.pack("<I", len(data)) + data + b"\0" * (len(data) & 1)


def _avi(frames: list[bytes], n_bytes: int, payload_bytes: int) -> bytes:
    n, most = len(frames), max(map(len, frames))
    avih = struct.pack("<14I", MICROS, most * 1_000_000 // MICROS, 0, 0x10, n, 0, 1, most, WIDTH, HEIGHT, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIIIHHHH", 0, 0, 0, 0, MICROS, 1_000_000, 0, n, most, 0xFFFFFFFF, 0, 0, 0, WIDTH, HEIGHT)
    strf = struct.pack("<IiiHH4sIiiII", 40, WIDTH, HEIGHT, 1, 8, b"MJPG", FRAME, 0, 0, 0, 0)
    strl = b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf) + _chunk(b"strd", struct.pack("<QQ", n_bytes, payload_bytes))
    hdrl = b"hdrl" + _chunk(b"avih", avih) + _chunk(b"LIST", strl)
    movi, index, at = [b"movi"], [], 4
    for f in frames:
        movi.append(c := _chunk(b"00dc", f))
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        at += len(c)
    return _chunk(b"RIFF", b"AVI " + _chunk(b"LIST", hdrl) + _chunk(b"LIST", b"".join(movi)) + _chunk(b"idx1", b"".join(index)))


def encode(payloads: list[bytes], lengths: list[int]) -> list[bytes]:
    """An AVI file for each payload (any length from 1); ``lengths`` are the true lengths to be noted."""
    import numpy as np

    counts = [max(1, -(-len(p) // FRAME)) for p in payloads]
    frames: list[bytes] = []
    whole = b"".join(p + b"\0" * (n * FRAME - len(p)) for p, n in zip(payloads, counts))
    for a in range(0, len(whole), SLAB):
        frames += _jpegs(np.frombuffer(whole, np.uint8, min(SLAB, len(whole) - a), a))
    out, at = [], 0
    for p, n, size in zip(payloads, counts, lengths):
        out.append(_avi(frames[at : at + n], size, len(p)))
        at += n
    return out


def parse(media: bytes) -> dict:
    """Header fields and the frames (as (start, size)) that the file's index names."""
    if media[:4] != b"RIFF" or media[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    out = {"frames": []}
    movi, index = None, None

    def walk(a: int, b: int) -> None:
        nonlocal movi, index
        while a + 8 <= b:
            name, size = media[a : a + 4], int.from_bytes(media[a + 4 : a + 8], "little")
            if name == b"LIST":
                if media[a + 8 : a + 12] == b"movi":
                    movi = a + 8
                else:
                    walk(a + 12, a + 8 + size)
            elif name == b"avih":
                out["micros"], out["width"], out["height"] = struct.unpack_from("<I28xII", media, a + 8)
            elif name == b"strd":
                out["n_bytes"], out["payload_bytes"] = struct.unpack_from("<QQ", media, a + 8)
            elif name == b"idx1":
                index = (a + 8, size)
            a += 8 + size + (size & 1)

    walk(12, 8 + int.from_bytes(media[4:8], "little"))
    for i in range(index[0], index[0] + index[1], 16):
        name, flags, at, size = struct.unpack_from("<4sIII", media, i)
        if name[2:] == b"dc" and flags & 0x10:
            out["frames"].append((movi + at + 8, size))
    return out


_headers: dict[bytes, tuple] = {}


def _image_header(media: bytes, a: int) -> tuple[int, int, int, bytes, bytes]:
    """Length of the header, width, height, code counts and symbols."""
    i, shape, table = a + 2, None, None
    while True:
        kind, n = media[i + 1], int.from_bytes(media[i + 2 : i + 4], "big")
        if kind == 0xC4:
            table = media[i + 5 : i + 21], media[i + 21 : i + 2 + n]
        elif kind == 0xC3:
            shape = struct.unpack_from(">HH", media, i + 5)
        i += 2 + n
        if kind == 0xDA:
            return i - a, shape[1], shape[0], *table


def _decode_slab(images: list[tuple[bytes, int, int]]):
    """Samples of all frames, which share one header."""
    import numpy as np

    media, a, _ = images[0]
    head, width, height, counts, symbols = _image_header(media, a)
    most, diff, used = _decode_table(counts, symbols)
    raw = np.frombuffer(b"".join([m[a + head : a + n] for m, a, n in images]) + b"\0" * 8, np.uint8)
    ff = np.flatnonzero(raw == 255)
    after = raw[ff + 1]
    stuffed = ff[after == 0] + 1
    marks = ff[(after >= 0xD0) & (after <= 0xD9)]
    starts = np.concatenate([[0], marks[:-1] + 2])
    starts = starts - np.searchsorted(stuffed, starts)
    clean = np.delete(raw, stuffed).astype(np.uint32)
    words = (clean[:-3] << 24) | (clean[1:-2] << 16) | (clean[2:-1] << 8) | clean[3:]
    pos = starts.astype(np.int64) * 8
    out = np.empty((width, len(starts)), np.uint8)
    now = np.full(len(starts), 128, np.int16)
    shift = np.uint32(32 - most)
    for k in range(width):
        top = (words[pos >> 3] << (pos & 7).astype(np.uint32)) >> shift
        now = now + diff[top]
        pos += used[top]
        out[k] = now
    if len(starts) != len(images) * height:
        raise ValueError("a frame lacks lines")
    return out.T.reshape(len(images), height * width)


def decode(media: list[bytes]) -> list[tuple[dict, object]]:
    """(header fields, frames as an array of one row of samples each) of every file."""
    import numpy as np

    heads = [parse(m) for m in media]
    images = [(m, a, n) for m, h in zip(media, heads) for a, n in h["frames"]]
    size = max(1, SLAB // FRAME)
    alike: dict[bytes, list[int]] = {}
    for i, (m, a, _) in enumerate(images):
        alike.setdefault(m[a : a + 20], []).append(i)
    frames: list = [None] * len(images)
    for own in alike.values():
        for a in range(0, len(own), size):
            for i, f in zip(own[a : a + size], _decode_slab([images[i] for i in own[a : a + size]])):
                frames[i] = f
    out, at = [], 0
    for h in heads:
        n = len(h["frames"])
        out.append((h, np.stack(frames[at : at + n])))
        at += n
    return out


def shots(frames, sigmas: float = SIGMAS, least: float = LEAST) -> tuple[list[int], list[float]]:
    """First frame of each shot, and the histogram distances (0 to 1) of neighbouring frames."""
    import numpy as np

    n = len(frames)
    hist = np.bincount(((frames >> 4) + (np.arange(n) * BINS)[:, None]).ravel(), minlength=n * BINS).reshape(n, BINS)
    if n == 1:
        return [0], []
    far = (np.abs(np.diff(hist, axis=0)).sum(axis=1) / (2 * frames.shape[1])).tolist()
    starts, total, square, k = [0], 0.0, 0.0, 0
    for i, x in enumerate(far):
        mean = total / k if k else x
        sd = max(0.0, square / k - mean * mean) ** 0.5 if k else 0.0
        if x > max(least, mean + sigmas * sd):
            starts.append(i + 1)
            total = square = k = 0
        else:
            total, square, k = total + x, square + x * x, k + 1
    return starts, far


def _payload(text: str | None) -> tuple[bytes, int]:
    raw = (text or "").encode()
    return raw + b"\0" * (-len(raw) % 64 or 64 * (not raw)), len(raw)


def to_media(rows: DataFrame, text: str = "text") -> DataFrame:
    """``rows`` plus ``media``: each text as a file of its own. Null texts are stored as empty ones; a column media is replaced."""
    store.small_batches(rows.sparkSession, 500)
    rows = rows.drop("media")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
            for a, b in groups_of(texts, 2_000_000):
                made = encode(*map(list, zip(*map(_payload, texts[a:b]))))
                yield batch.slice(a, b - a).append_column("media", pa.array(made, pa.binary()))

    return rows.mapInArrow(run, f"{schema}, media binary")


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def digests(media: DataFrame) -> DataFrame:
    """What is read back from each file: payload digests and the shots as one string."""

    def rows(doc, m, head, frames):
        payload = frames.tobytes()[: head["payload_bytes"]]
        starts, far = shots(frames)
        ends = [*starts[1:], len(frames)]
        clips = ",".join(f"{a * head['micros'] / 1e6:.2f}-{b * head['micros'] / 1e6:.2f}" for a, b in zip(starts, ends))
        feature = f"frames={len(frames)};shots={len(starts)};motion={sum(far) / len(far) if far else 0:.4f};clips={clips}"
        return [(doc, head["n_bytes"], len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(m), hashlib.sha256(m).hexdigest(), feature)]

    return _read(media, rows, DIGEST)


def clips(media: DataFrame) -> DataFrame:
    """One row a shot: doc_id, clip, start_s, end_s, n_frames, mean_grey."""

    def rows(doc, m, head, frames):
        starts, _ = shots(frames)
        ends, s = [*starts[1:], len(frames)], head["micros"] / 1e6
        return [(doc, k, a * s, b * s, b - a, float(frames[a:b].mean())) for k, (a, b) in enumerate(zip(starts, ends))]

    return _read(media, rows, "doc_id long, clip int, start_s double, end_s double, n_frames int, mean_grey double")


def _read(media: DataFrame, rows_of, schema: str) -> DataFrame:
    kinds = [x.split()[-1] for x in schema.split(", ")]
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        import pyarrow as pa

        types = [{"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string()}[k] for k in kinds]
        for batch in batches:
            ids, files = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in groups_of(files, 3_000_000):
                out = [r for doc, m, (head, frames) in zip(ids[a:b], files[a:b], decode(files[a:b])) for r in rows_of(doc, m, head, frames)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    return media.select("doc_id", "media").mapInArrow(run, schema)


def op2_avi_mjpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return digests(to_media(docs.select("doc_id", "text")))
