"""Substring deduplication with compressed FM-indexes (operator 3).

A window is ``WINDOW`` consecutive words. Every window is owned by the smallest of its ``GRAM``-word
grams (common grams last, by a sketch of fixed size; the leftmost of equals), so equal windows, wherever
they are, have equal owners. Consecutive windows with one owner make a segment of words. Segments whose
owner occurs once are done; the others, one of each content with its number of copies, are dealt to
shards by owner. A shard builds an FM-index over its segments (Burrows-Wheeler transform in a wavelet
matrix of as many bits a word as the shard's vocabulary needs, with small rank directories) and streams the segments
against it: backward search extends a match leftwards while at least two places match, which gives matching statistics;
windows inside a match of ``WINDOW`` words or more are repeated, and so are those of a segment with several copies.
All rounds of the search run on all segments of a shard at once. :func:`intervals` reports what is found as
maximal intervals of words of each document.

An owner with more than ``OWNER_SEGMENTS`` different segments has its windows dealt one by one, by their
content, over as many shards as it needs.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store
from .words import grams, mix, text_hashes, words

WINDOW, GRAM = 35, 12
SKETCH, SHARD_WORDS, OWNER_SEGMENTS = 20, 400_000, 20_000
MOST_WINDOWS = 60  # of a segment: their flags are one 64-bit number


def _bucket(g):
    import numpy as np

    return (g >> np.uint64(64 - SKETCH)).astype(np.int64)


def common_grams(docs: DataFrame, gram: int = GRAM) -> list[int]:
    """Buckets of the sketch that hold common grams, 32 hits and four times the mean or more; at most 2 ** SKETCH numbers."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        sketch = np.zeros(1 << SKETCH, np.int64)
        for batch in batches:
            for t in batch.column(0).to_pylist():
                b = _bucket(grams(text_hashes(t, lower=False), gram))
                if len(b):
                    np.add.at(sketch, b, 1)
        mean = sketch.mean()
        hot = np.flatnonzero(sketch > mean + 6 * mean**0.5 + 8)
        # the total, as bucket -1
        yield pa.RecordBatch.from_arrays([pa.array(np.append(hot, -1).astype(np.int32)), pa.array(np.append(sketch[hot], sketch.sum()))], ["bucket", "hits"])

    store.small_batches(docs.sparkSession)
    found = docs.select("text").mapInArrow(run, "bucket int, hits long").groupBy("bucket").agg(F.sum("hits").alias("hits"))
    hits = dict(map(tuple, found.filter((F.col("hits") >= 32) | (F.col("bucket") < 0)).collect()))
    least = max(32, 4 * hits.pop(-1, 0) / (1 << SKETCH))
    return sorted(b for b, n in hits.items() if n >= least)


def segments(h, common, window: int = WINDOW, gram: int = GRAM):
    """(owner's hash, first window, number of windows) of each segment, as arrays; none below ``window`` words.

    A run of more than MOST_WINDOWS windows is cut; its parts have the same owner, so they meet what the whole would.
    """
    import numpy as np

    n = len(h) - window + 1
    if n <= 0:
        none = np.empty(0, np.int64)
        return np.empty(0, np.uint64), none, none
    g = grams(h, gram)
    v = (g >> np.uint64(1)) | (common[_bucket(g)].astype(np.uint64) << np.uint64(63))
    width, at, best = 1, np.arange(len(v)), v
    target = window - gram + 1
    while width < target:
        step = min(width, target - width)
        m = len(best) - step
        right = best[step:] < best[:m]
        at = np.where(right, at[step:], at[:m])
        best = np.where(right, best[step:], best[:m])
        width += step
    cut = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    if target > MOST_WINDOWS:
        place = np.arange(n) - np.repeat(cut, np.diff(np.append(cut, n)))
        cut = np.flatnonzero(place % MOST_WINDOWS == 0)
    return g[at[cut]], cut, np.diff(np.append(cut, n))


class Bits:
    """A bit vector with rank: 64-bit words, and a directory of 16 bits a word and 32 bits every 16 words."""

    def __init__(self, bit):
        import numpy as np

        n = len(bit)
        self.words = np.packbits(np.concatenate([bit, np.zeros(-n % 64 + 64, bool)]), bitorder="little").view("<u8")
        ones = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])[:-1]
        self.far = ones[::16].astype(np.int32)
        self.near = (ones - np.repeat(self.far, 16)[: len(ones)]).astype(np.uint16)
        self.bytes = self.words.nbytes + self.far.nbytes + self.near.nbytes

    def rank(self, i):
        """Ones before places ``i``."""
        import numpy as np

        w = i >> 6
        below = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.far[w >> 4] + self.near[w] + np.bitwise_count(self.words[w] & below)


class FmIndex:
    """Burrows-Wheeler transform of a sequence of symbols from 0 up, sorted to ``depth`` symbols, in a wavelet matrix."""

    def __init__(self, seq, depth: int):
        import numpy as np

        n = len(seq)
        rank, h = seq.astype(np.int64), 1
        order = np.argsort(rank, kind="stable")
        while h < depth:
            nxt = np.zeros(n, np.int64)
            nxt[: n - h] = rank[h:] + 1 if h < n else 0
            key = rank * (n + int(seq.max()) + 2) + nxt
            order = np.argsort(key, kind="stable")
            k = key[order]
            new = np.concatenate([[0], np.cumsum(k[1:] != k[:-1])])
            rank = np.empty(n, np.int64)
            rank[order] = new
            h *= 2
            if new[-1] == n - 1:
                break
        bwt = seq[order - 1]
        size = int(seq.max()) + 1
        self.n, self.counts = n, np.concatenate([[0], np.cumsum(np.bincount(seq, minlength=size))])
        self.bits = max(1, (size - 1).bit_length())
        self.levels = []
        for b in range(self.bits - 1, -1, -1):
            bit = (bwt >> b & 1).astype(bool)
            self.levels.append((b, Bits(bit), int(n - bit.sum())))
            bwt = np.concatenate([bwt[~bit], bwt[bit]])
        symbols = np.arange(size)
        self.base = self.counts[:-1] - self._down(symbols, np.zeros(size, np.int64))

    def _down(self, c, i):
        import numpy as np

        for b, bits, zeros in self.levels:
            r = bits.rank(i)
            i = np.where(c >> b & 1, zeros + r, i - r)
        return i

    def extend(self, c, lo, hi):
        """Rows whose suffixes begin with symbol c followed by what rows lo to hi begin with."""
        import numpy as np

        m = len(c)
        both = self._down(np.concatenate([c, c]), np.concatenate([lo, hi])) + np.concatenate([self.base[c], self.base[c]])
        return both[:m], both[m:]


def repeated_windows(contents: list[list[bytes]], copies: list[int], window: int = WINDOW) -> list[int]:
    """For each segment of words a number whose bit s is set if the window from word s on occurs again."""
    import numpy as np

    ids: dict[bytes, int] = {}
    sizes = np.array([len(c) for c in contents])
    seq = np.zeros(int(sizes.sum()) + len(sizes), np.int64)
    at, starts = 0, []
    for c in contents:
        starts.append(at)
        seq[at : at + len(c)] = [ids.setdefault(w, len(ids) + 1) for w in c]
        at += len(c) + 1  # symbol 0 ends a segment
    index = FmIndex(seq, int(sizes.max()))
    start = np.array(starts)
    k = len(sizes)
    flags = np.zeros((k, int(sizes.max()) - window + 1), bool)
    r = sizes - 1  # right end of the match sought
    i = r.copy()  # next symbol to take
    lo, hi = np.zeros(k, np.int64), np.full(k, index.n)
    live = np.arange(k)
    while len(live):
        a, b = index.extend(seq[start[live] + i[live]], lo[live], hi[live])
        good = b - a >= 2
        g = live[good]
        lo[g], hi[g] = a[good], b[good]
        i[g] -= 1
        stop = np.concatenate([live[~good], g[i[g] < 0]])
        if len(stop):
            left, right = i[stop] + 1, r[stop]  # words left to right occur at least twice, one more to the left doesn't
            long = right - left + 1 >= window
            for s, x, y in zip(stop[long].tolist(), left[long].tolist(), right[long].tolist()):
                flags[s, x : y - window + 2] = True
            # the next window not decided begins at the word that failed, or ends one word earlier
            r[stop] = np.where(long, left + window - 2, right - 1)
            i[stop], lo[stop], hi[stop] = r[stop], 0, index.n
            done = np.zeros(k, bool)
            done[stop] = (r[stop] < window - 1) | (i[stop] < 0)
            done[stop[left == 0]] |= long[left == 0]
            live = live[~done[live]]
    out = []
    for row, n, m in zip(flags, (sizes - window + 1).tolist(), copies):
        out.append((1 << n) - 1 if m > 1 else int(sum(1 << s for s in np.flatnonzero(row[:n]).tolist())))
    return out


def _parts(docs: DataFrame, common: list[int], window: int, gram: int) -> DataFrame:
    """doc_id, cid (fingerprint of the text), n_words, sha (of all words), and the segments: owner, start, n, seg."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import xxhash

        flags = np.zeros(1 << SKETCH, bool)
        flags[common] = True
        weights = None
        for batch in batches:
            out = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ws = words(text, lower=False)
                h = text_hashes(text, lower=False)
                owner, start, n = segments(h, flags, window, gram)
                if len(owner):
                    # a segment's fingerprint from prefix sums of h * B ** i, taken back to power 0
                    if weights is None or len(weights[0]) < len(h):
                        b = np.full(2 * len(h), 0x9E3779B97F4A7C15, np.uint64)
                        inv = np.full(2 * len(h), pow(0x9E3779B97F4A7C15, -1, 1 << 64), np.uint64)
                        weights = np.cumprod(b), np.cumprod(inv)
                    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h) * weights[0][: len(h)])])
                    seg = mix((sums[start + n + window - 1] - sums[start]) * weights[1][start]) ^ n.astype(np.uint64)
                else:
                    seg = owner
                out.append((doc, xxhash.xxh3_64_intdigest((text or "").encode()) - (1 << 63), len(ws), hashlib.sha256(b" ".join(ws)).hexdigest(), owner.view(np.int64), start.astype(np.int32), n.astype(np.int32), seg.view(np.int64)))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [[]] * 8, types)], ["doc_id", "cid", "n_words", "sha", "owner", "start", "n", "seg"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, cid long, n_words long, sha string, owner array<long>, start array<int>, n array<int>, seg array<long>")


def _contents(asked: DataFrame, window: int) -> DataFrame:
    """shard key, seg, bit, content, copies of each segment asked for, or of each of its windows where the owner is split."""

    def run(batches):
        import pyarrow as pa
        import xxhash

        for batch in batches:
            out = []
            for text, rows in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ws = words(text, lower=False)
                for r in rows:
                    a, n, split = r["start"], r["n"], r["split"]
                    if split <= 1:
                        out.append((r["owner"], r["seg"], 0, b" ".join(ws[a : a + n + window - 1]), r["copies"]))
                        continue
                    for s in range(n):
                        c = b" ".join(ws[a + s : a + s + window])
                        out.append((r["owner"] ^ (xxhash.xxh3_64_intdigest(c) % split + 1), r["seg"], s, c, r["copies"]))
            types = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [[]] * 5, types)], ["key", "seg", "bit", "content", "copies"])

    return asked.select("text", "rows").mapInArrow(run, "key long, seg long, bit int, content binary, copies long")


def _searched(contents: DataFrame, parts: int, window: int) -> DataFrame:
    """seg, mask of repeated windows; an index for each run of whole keys of at least SHARD_WORDS words in a partition."""

    def run(batches):
        import pyarrow as pa

        def done(rows):
            masks = repeated_windows([c.split(b" ") for _, _, _, c, _ in rows], [m for *_, m in rows], window)
            hit = [(seg, m << bit) for (_, seg, bit, _, _), m in zip(rows, masks) if m]
            cols = list(zip(*hit)) or [[], []]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["seg", "mask"])

        rows, size = [], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if size >= SHARD_WORDS and row[0] != rows[-1][0]:
                    yield done(rows)
                    rows, size = [], 0
                rows.append(row)
                size += row[3].count(b" ") + 2
        if rows:
            yield done(rows)

    return contents.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(run, "seg long, mask long")


def _covered(spans: DataFrame, window: int) -> DataFrame:
    """cid, n_removed, sha, kept of each text, and its maximal intervals (start, n_words), from its windows found repeated."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            out = []
            for cid, text, rows in zip(*(c.to_pylist() for c in batch.columns)):
                ws = words(text, lower=False)
                step = np.zeros(len(ws) + 1, np.int64)
                for r in rows:
                    m, s = r["mask"], r["start"]
                    while m:
                        if m & 1:
                            step[s] += 1
                            step[s + window] -= 1
                        m, s = m >> 1, s + 1
                keep = np.cumsum(step[:-1]) == 0
                kept = b" ".join([w for w, k in zip(ws, keep.tolist()) if k])
                edge = np.flatnonzero(np.diff(~keep, prepend=False, append=False))
                out.append((cid, int(len(ws) - keep.sum()), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace"), edge[::2], edge[1::2] - edge[::2]))
            types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [[]] * 6, types)], ["cid", "n_removed", "sha", "kept", "starts", "lengths"])

    return spans.select("cid", "text", "rows").mapInArrow(run, "cid long, n_removed long, sha string, kept string, starts array<long>, lengths array<long>")


def find_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, owner_segments: int = OWNER_SEGMENTS) -> tuple[DataFrame, DataFrame]:
    """(doc_id, cid, n_words, sha of all words) of every row, and (cid, n_removed, sha, kept, starts, lengths) of texts that lose words.

    Null texts have no words; texts below ``window`` words lose none. Equal texts are one class (cid,
    a 64-bit fingerprint) with its number of copies; rows that share a doc_id stay apart.
    """
    spark = docs.sparkSession
    n_parts = store.partitions(spark)
    docs = docs.select("doc_id", "text")
    parts = store.written(_parts(docs, common_grams(docs, gram), window, gram))
    long_rows = parts.filter(F.size("owner") > 0)
    classes = store.written(long_rows.groupBy("cid").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")))
    reps = long_rows.join(classes, "cid").filter(F.col("doc_id").eqNullSafe(F.col("rep"))).dropDuplicates(["cid"])
    segs = reps.select("cid", "copies", F.explode(F.arrays_zip("owner", "start", "n", "seg")).alias("s")).select("cid", "copies", "s.*")
    often = store.written(segs.groupBy("owner").agg(F.sum("copies").alias("c")).filter(F.col("c") > 1).select("owner"))
    cand = store.written(segs.join(often, "owner", "left_semi"))
    first = cand.groupBy("seg").agg(F.min(F.struct("cid", "start", "n", "owner")).alias("f"), F.sum("copies").alias("copies")).select("seg", "copies", "f.*")
    distinct = store.written(first)
    large = distinct.groupBy("owner").agg(F.ceil(F.count("*") / owner_segments).alias("split")).filter(F.col("split") > 1)
    nodes = cand.select("cid").distinct().join(classes, "cid").select("cid", F.col("rep").alias("doc_id"))
    texts = store.written(_same_text(docs.join(nodes, docs["doc_id"].eqNullSafe(nodes["doc_id"])).select("cid", "text")))
    asked = distinct.join(large, "owner", "left").withColumn("split", F.coalesce("split", F.lit(1)).cast("long"))
    asked = asked.groupBy("cid").agg(F.collect_list(F.struct("owner", "seg", "start", "n", "copies", "split")).alias("rows")).join(texts, "cid")
    masks = _searched(_contents(asked, window), n_parts, window).groupBy("seg").agg(F.bit_or("mask").alias("mask"))
    masks = store.written(masks)
    spans = cand.join(masks, "seg").groupBy("cid").agg(F.collect_list(F.struct("start", "mask")).alias("rows")).join(texts, "cid")
    covered = store.written(_covered(spans, window))
    return parts.select("doc_id", "cid", "n_words", "sha"), covered


def _same_text(rows: DataFrame) -> DataFrame:
    """Rows (cid, text) whose text has the fingerprint, one of each."""

    def run(batches):
        import pyarrow as pa
        import xxhash

        for batch in batches:
            keep = [k for k, (c, t) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())) if xxhash.xxh3_64_intdigest((t or "").encode()) - (1 << 63) == c]
            yield batch.take(pa.array(keep, pa.int32()))

    return rows.mapInArrow(run, "cid long, text string").dropDuplicates(["cid"])


@store.tidy
def intervals(docs: DataFrame, window: int = WINDOW, **options) -> DataFrame:
    """doc_id, start, n_words: the maximal runs of words of each row that windows which occur elsewhere cover."""
    rows, covered = find_repeats(docs, window, **options)
    spans = covered.select("cid", F.explode(F.arrays_zip("starts", "lengths")).alias("_s"))
    return rows.join(spans, "cid").select("doc_id", F.col("_s.starts").alias("start"), F.col("_s.lengths").alias("n_words"))


def _with_cid(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` plus the fingerprint of the text, under that name."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def run(batches):
        import pyarrow as pa
        import xxhash

        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            yield batch.append_column(name, pa.array([xxhash.xxh3_64_intdigest((t or "").encode()) - (1 << 63) for t in texts], pa.int64()))

    return docs.mapInArrow(run, f"{schema}, `{name}` long")


@store.tidy
def remove_repeats(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with the words of repeated windows gone from text; texts that lose nothing stay as they are.

    What a text loses depends on the text alone, so rows are joined by its fingerprint, whatever their doc_id.
    """
    _, covered = find_repeats(docs, **options)
    own, kept = store.spare(docs.columns, "_cid", "_kept")
    per = covered.select(F.col("cid").alias(own), F.col("kept").alias(kept))
    return _with_cid(docs, own).join(per, own, "left").withColumn("text", F.coalesce(kept, "text")).select(docs.columns)


@store.tidy
def op3_fm_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, covered = find_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    joined = rows.join(covered.select("cid", "n_removed", F.col("sha").alias("_sha")), "cid", "left")
    return joined.select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("_sha", "sha").alias("kept_sha256"))


OP3_SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), p AS (
  SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS s FROM w
), k AS (
  SELECT doc_id, s, md5(array_to_string(ws[s:s + 34], ' ')) AS h FROM p
), r AS (
  SELECT doc_id, s FROM k WHERE h IN (SELECT h FROM k GROUP BY h HAVING count(*) > 1)
), g AS (
  SELECT DISTINCT doc_id, unnest(range(s, s + 35)) AS i FROM r
), x AS (
  SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w
), y AS (
  SELECT x.doc_id, x.i, x.word FROM x LEFT JOIN g ON g.doc_id = x.doc_id AND g.i = x.i WHERE g.i IS NULL
), z AS (
  SELECT doc_id, count(*) AS kept, string_agg(word, ' ' ORDER BY i) AS text FROM y GROUP BY doc_id
)
SELECT w.doc_id, len(w.ws)::BIGINT AS n_words, (len(w.ws) - coalesce(z.kept, 0))::BIGINT AS n_removed, sha256(coalesce(z.text, '')) AS kept_sha256
FROM w LEFT JOIN z ON z.doc_id = w.doc_id
"""
