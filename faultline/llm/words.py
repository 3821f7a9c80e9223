"""Words and their 64-bit hashes, for operators that work on word sequences.

A word is a run of bytes other than space and 0x09 to 0x0D, with A-Z lower-cased if asked.
"""

from __future__ import annotations

_BASE = 0x9E3779B97F4A7C17  # odd, so powers have inverses; _BASE - 1 is 2 mod 4, so order counts in all bits but one
_tables: dict = {}


def _powers(n: int):
    """Powers of the base and their inverses, mod 2 ** 64."""
    import numpy as np

    if len(_tables.get("powers", ((),))[0]) < n:
        m = max(4096, 2 * n)
        up = np.cumprod(np.full(m, _BASE, np.uint64))
        down = np.cumprod(np.full(m, pow(_BASE, -1, 1 << 64), np.uint64))
        _tables["powers"] = up, down
    return _tables["powers"]


def _bytes():
    """A fixed 64-bit number for each byte value, and whether it ends words."""
    import numpy as np

    if "bytes" not in _tables:
        _tables["bytes"] = mix(np.arange(1, 257, dtype=np.uint64)), np.isin(np.arange(256), (0x20, *range(0x09, 0x0E)))
    return _tables["bytes"]


def words(text: str | None, lower: bool = True) -> list[bytes]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return (raw.lower() if lower else raw).split()


def text_hashes(text: str | None, lower: bool = True):
    """A 64-bit hash of each word of a text: a polynomial in its bytes, by prefix sums over the whole text."""
    import numpy as np

    raw = (text or "").encode("utf-8", "surrogatepass")
    x = np.frombuffer(raw.lower() if lower else raw, np.uint8)
    codes, blank = _bytes()
    edge = np.flatnonzero(np.diff(blank[x], prepend=True, append=True))
    if not len(edge):
        return np.empty(0, np.uint64)
    starts, ends = edge[::2], edge[1::2]
    up, down = _powers(len(x))
    sums = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(codes[x] * up[: len(x)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] ^ (ends - starts).astype(np.uint64))


def mix(h):
    """A 64-bit finaliser (splitmix64), so that equal low or high bits mean nothing."""
    import numpy as np

    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def grams(h, n: int):
    """Hash of each n consecutive words; empty if there are fewer."""
    import numpy as np

    m = len(h) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    out = h[:m].copy()
    for k in range(1, n):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += h[k : k + m]
    return mix(out)


def gram_set(h, n: int):
    """Sorted distinct n-gram hashes; fewer words than n make one gram, no words none."""
    import numpy as np

    if 0 < len(h) < n:
        return grams(h, len(h))
    return np.unique(grams(h, n))


#: Buckets (as a power of two) of the sketch of word frequencies, and levels of commonness.
SKETCH, LEVELS, _SLICE = 20, 32, 4096


def commonness(docs, lower: bool = True):
    """A level from 0 (rare) to LEVELS - 1 for each bucket of word hashes, from counts over all texts.

    Each task counts into a table of fixed size; slices of the tables are added up in parallel, and one byte a
    bucket comes to the driver (1 MB, whatever the input). The levels only order n-grams, so
    words that share a bucket cost time at most, never a result.
    """
    import numpy as np
    from pyspark.sql import functions as F

    from . import store

    def count(batches):
        import pyarrow as pa

        table = np.zeros(1 << SKETCH, np.int64)
        for batch in batches:
            for t in batch.column(0).to_pylist():
                h = text_hashes(t, lower)
                if len(h):
                    np.add.at(table, bucket(h), 1)
        rows = [(k, s.tobytes()) for k, s in enumerate(table.reshape(-1, _SLICE)) if s.any()]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int32()), pa.array([s for _, s in rows], pa.binary())], ["slice", "counts"])
        store.trim()

    def add(batches):
        import pyarrow as pa

        sums: dict = {}
        for batch in batches:
            for k, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                a = np.frombuffer(s, np.int64)
                sums[k] = sums[k] + a if k in sums else a
        # an eighth of an octave a step
        small = {k: np.floor(8 * np.log2(1 + a)).astype(np.uint16).tobytes() for k, a in sums.items()}
        yield pa.RecordBatch.from_arrays([pa.array(list(small), pa.int32()), pa.array(list(small.values()), pa.binary())], ["slice", "logs"])

    store.small_batches(docs.sparkSession)
    parts = min(64, store.partitions(docs.sparkSession))
    slices = docs.select("text").mapInArrow(count, "slice int, counts binary").repartition(parts, F.col("slice")).mapInArrow(add, "slice int, logs binary")
    out = np.zeros(1 << SKETCH, np.float64)
    for k, logs in slices.collect():
        out[k * _SLICE : (k + 1) * _SLICE] = np.frombuffer(logs, np.uint16)
    return np.floor(out * (LEVELS - 1) / max(1.0, out.max())).astype(np.uint8)


def bucket(h):
    import numpy as np

    return (h >> np.uint64(64 - SKETCH)).astype(np.int64)


def ordered_grams(h, n: int, levels):
    """Each gram of n words as a number whose top five bits are the level of its rarest word: rare grams are small."""
    import numpy as np

    n = min(n, len(h))
    g = grams(h, n) if n else h
    least, width = levels[bucket(h)], 1
    while width < n:
        step = min(width, n - width)
        least = np.minimum(least[: len(least) - step], least[step:])
        width += step
    return (least.astype(np.uint64) << np.uint64(59)) | (g >> np.uint64(5))
