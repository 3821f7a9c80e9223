"""Benchmark decontamination by greedy string tiling (operator 5).

A document and a benchmark item are compared if they share a seed, a run of ``MIN_MATCH`` words.
Running Karp-Rabin greedy string tiling then marks longest common runs that don't overlap, from long
to short, until none of ``MIN_MATCH`` words is left; the order of the runs does not matter, so a
passage that is cut up and reordered is still covered. The pair is reported if tiles cover at
least ``COVERAGE`` of the item's words.
"""

from __future__ import annotations

from heapq import heapify, heappop, heappush

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store
from .words import _powers, grams, text_hashes

MIN_MATCH, COVERAGE = 5, 0.8
#: Benchmarks of at most so many characters are sent to every task; larger ones are joined by seed.
BROADCAST_CHARS = 16_000_000
SCHEMA = "doc_id long, item_id long, n_tiles int, covered int, n_words int, coverage double"


def _prefix(x):
    """Sums of powers of an odd base, mod 2 ** 64, of the words before each place."""
    import numpy as np

    out = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(x * _powers(len(x) + 1)[0][: len(x)], out=out[1:])
    return out


def _windows(sums, free, s: int):
    """Places where ``s`` free words begin, and the Karp-Rabin hash of these words."""
    import numpy as np

    taken = np.concatenate([[0], np.cumsum(~free)])
    at = np.flatnonzero(taken[s:] == taken[: len(taken) - s])
    return at, (sums[at + s] - sums[at]) * _powers(len(sums))[1][at]


def _matches(a, b, sums_a, sums_b, free_a, free_b, s: int):
    """(-length, place in a, place in b) of runs of ``s`` or more equal free words that can't begin earlier or end later."""
    import numpy as np

    at_a, h_a = _windows(sums_a, free_a, s)
    at_b, h_b = _windows(sums_b, free_b, s)
    order = np.argsort(h_b, kind="stable")
    at_b, h_b = at_b[order], h_b[order]
    lo, hi = np.searchsorted(h_b, h_a), np.searchsorted(h_b, h_a, "right")
    at_a, lo, hi = at_a[hi > lo], lo[hi > lo], hi[hi > lo]
    open_, found = {}, []  # runs by diagonal: begin in a, and where the last window began
    for k, x, y in zip(at_a.tolist(), lo.tolist(), hi.tolist()):
        met = {}
        for j in at_b[x:y].tolist():
            d = k - j
            begin, last = open_.get(d, (k, k))
            if last < k - 1:
                found.append((last + s - begin, begin, begin - d))
                begin = k
            met[d] = begin, k
        open_.update(met)
    found += [(last + s - begin, begin, begin - d) for d, (begin, last) in open_.items()]
    return [(-n, k, j) for n, k, j in found if (a[k : k + n] == b[j : j + n]).all()]


def tiles(a, b, least: int = MIN_MATCH, gaps=None) -> list[tuple[int, int, int]]:
    """(place in a, place in b, length) of greedy tiles of at least ``least`` equal words; no tile covers a place in ``gaps`` of a.

    A round hashes all free runs of s words (Karp-Rabin) and joins equal ones on their diagonals. The longest run is marked
    first, the leftmost of equals; of a run that a tile has cut, the free parts of s words or more queue up again, and
    shorter ones are left to a later round, so at any time the longest free run of all comes next. s begins at the length of b, so that a text
    of one repeated word costs no more than its length, and falls by half from round to round.
    """
    import numpy as np

    a, b = np.asarray(a, np.uint64), np.asarray(b, np.uint64)
    sums_a, sums_b = _prefix(a), _prefix(b)
    free_a, free_b = np.ones(len(a), bool), np.ones(len(b), bool)
    if gaps is not None:
        free_a[gaps] = False
    out, s = [], max(least, len(b))
    while True:
        heap = _matches(a, b, sums_a, sums_b, free_a, free_b, s) if min(free_a.sum(), free_b.sum()) >= s else []
        heapify(heap)
        while heap:
            n, k, j = heappop(heap)
            both = free_a[k : k - n] & free_b[j : j - n]
            if both.all():
                free_a[k : k - n] = free_b[j : j - n] = False
                out.append((k, j, -n))
                continue
            edge = np.flatnonzero(np.diff(both, prepend=False, append=False))
            for x, y in zip(edge[::2].tolist(), edge[1::2].tolist()):
                if y - x >= s:
                    heappush(heap, (x - y, k + x, j + x))
        if s == least:
            return out
        s = max(least, s // 2)


def _pair(h, hits, item, least: int) -> tuple[int, int]:
    """Tiles and covered words of a pair. Only words of the document's seeds in the item can be touched; what lies between is a gap."""
    import numpy as np

    near = np.unique((np.asarray(hits)[:, None] + np.arange(least)).ravel())
    near = near[near < len(h)]
    # one gap where places are not consecutive
    jump = np.flatnonzero(np.diff(near) > 1) + 1
    got = tiles(np.insert(h[near], jump, 0), item, least, gaps=jump + np.arange(len(jump)))
    return len(got), sum(n for _, _, n in got)


class Index:
    """Seeds of the benchmark rows: sorted hashes with the rows that hold them, by seed length.

    Rows are told apart by their place, so rows that share an item_id, or have none, are tiled each by itself.
    """

    def __init__(self, items: list[tuple[int | None, str | None]], least: int):
        import numpy as np

        self.least, self.items, by = least, {}, {}
        for row, (item, text) in enumerate(items):
            h = text_hashes(text)
            if len(h):
                self.items[row] = item, h
                n = min(least, len(h))
                by.setdefault(n, []).append((grams(h, n), row))
        self.by = {}
        for n, rows in by.items():
            keys = np.concatenate([g for g, _ in rows])
            owner = np.concatenate([np.full(len(g), i, np.int64) for g, i in rows])
            order = np.argsort(keys, kind="stable")
            self.by[n] = keys[order], owner[order]

    def scan(self, text: str | None, coverage: float):
        import numpy as np

        h = text_hashes(text)
        for n, (keys, owner) in self.by.items():
            g = grams(h, n)
            lo = np.searchsorted(keys, g)
            lo[lo == len(keys)] = 0
            hit = np.flatnonzero(keys[lo] == g)
            if not len(hit):
                continue
            a, b = np.searchsorted(keys, g[hit]), np.searchsorted(keys, g[hit], "right")
            places: dict[int, list[int]] = {}
            for p, x, y in zip(hit.tolist(), a.tolist(), b.tolist()):
                for row in dict.fromkeys(owner[x:y].tolist()):
                    places.setdefault(row, []).append(p)
            for row, hits in places.items():
                item, words = self.items[row]
                k, covered = _pair(h, hits, words, n)
                size = len(words)
                if covered >= coverage * size:
                    yield item, k, covered, size, covered / size


@store.tidy
def leaks(docs: DataFrame, benchmark: DataFrame, least: int = MIN_MATCH, coverage: float = COVERAGE, broadcast_chars: int = BROADCAST_CHARS) -> DataFrame:
    """Pairs of a document and a benchmark item that it covers: doc_id, item_id, n_tiles, covered, n_words, coverage.

    Items shorter than ``least`` words must occur whole. Null and empty texts, on either side, pair
    with nothing; a repeated row reports again, and so does one whose id is repeated or null, on either side;
    empty tables give an empty result.
    """
    spark = docs.sparkSession
    store.small_batches(spark)
    items = benchmark.select("item_id", "text").filter(F.col("text").isNotNull())
    size = items.agg(F.coalesce(F.sum(F.length("text") + 50), F.lit(0))).head()[0]
    if size > broadcast_chars:
        return _joined(docs, items, least, coverage)
    rows = [(r[0], r[1]) for r in items.collect()]  # of a size just checked

    def run(batches):
        import pyarrow as pa

        index = Index(rows, least)
        for batch in batches:
            out = [(d, *x) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for x in index.scan(t, coverage)]
            yield _table(pa, out)

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


@store.tidy
def decontaminate(docs: DataFrame, benchmark: DataFrame, least: int = MIN_MATCH, coverage: float = COVERAGE, broadcast_chars: int = BROADCAST_CHARS) -> DataFrame:
    """``docs`` (any columns, among them doc_id and text) without the rows that cover a benchmark item."""
    spark = docs.sparkSession
    store.small_batches(spark)
    items = benchmark.select("item_id", "text").filter(F.col("text").isNotNull())
    size = items.agg(F.coalesce(F.sum(F.length("text") + 50), F.lit(0))).head()[0]
    if size > broadcast_chars:
        (leak,) = store.spare(docs.columns, "_leak")
        found = _pairs(docs, items, least, coverage).select(F.col("_doc").alias(leak)).distinct()
        return docs.join(found, _content("text") == F.col(leak), "left_anti")
    rows = [(r[0], r[1]) for r in items.collect()]  # of a size just checked

    def run(batches):
        import pyarrow as pa

        index = Index(rows, least)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            yield batch.take(pa.array([k for k, t in enumerate(texts) if next(index.scan(t, coverage), None) is None], pa.int32()))
        store.trim()

    return docs.mapInArrow(run, docs.schema)


def _table(pa, out):
    types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64())
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [[]] * 6, types)], names)


def _content(text: str):
    """A text's key on the join path: pairs depend on the two texts alone, and no id tells rows apart."""
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def _seeds(rows: DataFrame, key: str, least: int, lengths: list[int]) -> DataFrame:
    """key, n, seed: a text's distinct seeds, for documents of each of the ``lengths``, for items of the item's own."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                h = text_hashes(t)
                sizes = lengths if key == "_doc" else [min(least, len(h))] * (len(h) > 0)
                g = [np.unique(grams(h, n)) for n in sizes]
                for n, x in zip(sizes, g):
                    if len(x):
                        yield pa.RecordBatch.from_arrays([pa.array([k] * len(x), pa.string()), pa.array([n] * len(x), pa.int32()), pa.array(x.view("<i8"))], [key, "n", "seed"])

    return rows.select(key, "text").mapInArrow(run, f"{key} string, n int, seed long")


def _pairs(docs: DataFrame, items: DataFrame, least: int, coverage: float) -> DataFrame:
    """_doc, _item (contents) and the figures of each leaking pair of texts; equal texts are one. Seeds are joined, then the texts of each pair."""
    doc = docs.select(_content("text").alias("_doc"), "text").filter(F.col("text").isNotNull())
    item = items.select(_content("text").alias("_item"), "text").dropDuplicates(["_item"])
    seeds = store.written(_seeds(item, "_item", least, []))
    lengths = sorted(r[0] for r in seeds.select("n").distinct().collect())  # at most ``least`` numbers
    met = store.written(_seeds(doc, "_doc", least, lengths).join(seeds, ["n", "seed"]).select("_doc", "_item").distinct())
    one = doc.join(met.select("_doc").distinct(), "_doc", "left_semi").dropDuplicates(["_doc"])  # few texts meet an item
    texts = met.join(one.withColumnRenamed("text", "doc"), "_doc").join(item.withColumnRenamed("text", "item"), "_item")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for d, i, doc, item in zip(*(c.to_pylist() for c in batch.columns)):
                out += [(d, i, *x[1:]) for x in Index([(None, item)], least).scan(doc, coverage)]
            types = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [[]] * 6, types)], ["_doc", "_item", "n_tiles", "covered", "n_words", "coverage"])

    return store.written(texts.select("_doc", "_item", "doc", "item").mapInArrow(run, "_doc string, _item string, n_tiles int, covered int, n_words int, coverage double"))


def _joined(docs: DataFrame, items: DataFrame, least: int, coverage: float) -> DataFrame:
    """The same result for a benchmark of any size: every row of either side with a leaking pair's text reports."""
    found = _pairs(docs, items, least, coverage)
    rows = found.join(docs.select("doc_id", _content("text").alias("_doc")), "_doc").join(items.select("item_id", _content("text").alias("_item")), "_item")
    return rows.select("doc_id", "item_id", "n_tiles", "covered", "n_words", "coverage")


def op5_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
