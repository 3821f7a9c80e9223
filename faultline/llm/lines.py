"""Line deduplication with levelled sorted runs of line hashes (operator 6), DataFrame functions only.

Documents come in batches of ascending doc_id. A run is a table of (h1, h2, owner): a line's 128-bit
hash and the smallest doc_id that held it, bucketed by hash with one sorted file a bucket. A
batch's lines are reduced to one row a hash, which is merge-joined with every run: runs are read in
their order, without exchange or sort. What no run holds is new and becomes a run of level 0
(the anti-join); what a run holds, or two documents of the batch, is a repeated line, and only
such hashes are joined with the batch's lines. When ``FAN_IN`` runs of a level have gathered, they are
merge-joined into one run of the next, so n batches leave O(log n) runs and each hash is rewritten
O(log n) times.

A hash that a third of all documents hold is one row after map-side aggregation; in the join of
lines with repeated hashes, both sides are plain exchanges, so adaptive execution splits its partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store

MIN_CHARS, BATCHES, FAN_IN = 10, 4, 2
BLANKS = " \t\n\x0b\f\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def stripped(line: Column) -> Column:
    """``line`` without blanks at both ends; a line that does not end in one skips the costly search from its end."""
    last = F.lit(False)
    for c in BLANKS:
        last = last | F.endswith(line, F.lit(c))
    return F.when(last, F.btrim(line, F.lit(BLANKS))).otherwise(F.ltrim(line, F.lit(BLANKS)))


def lowered(line: Column) -> Column:
    """A-Z lower-cased and nothing else: ``lower`` does just that where every character has one byte."""
    ascii_only = F.octet_length(line) == F.char_length(line)
    return F.when(ascii_only, F.lower(line)).otherwise(F.translate(line, _UPPER, _LOWER))


def line_key(line: Column) -> Column:
    return lowered(stripped(line))


def _lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """doc_id, _t, pos, h1, h2 of every line whose key is long enough."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("_t"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("pos", "line"))
    # lower-casing A-Z keeps the length, so the filter needs no key
    long = rows.filter(F.char_length(stripped(F.col("line"))) >= min_chars)
    keyed = long.select("doc_id", "_t", "pos", line_key(F.col("line")).alias("_k"))
    return keyed.select("doc_id", "_t", "pos", F.xxhash64("_k").alias("h1"), F.xxhash64(F.lit(11), "_k").alias("h2"))


class Runs:
    """Levelled sorted runs of (h1, h2, owner), disjoint in their hashes."""

    def __init__(self, spark: SparkSession, fan_in: int = FAN_IN):
        self.spark, self.fan_in = spark, fan_in
        self.buckets = store.partitions(spark)
        self.levels: list[list[DataFrame]] = []

    def met(self, hashes: DataFrame) -> DataFrame:
        """``hashes`` (h1, h2, one row each) plus known, the owner in the run that holds the hash, and old, whether one does."""
        known, old, out = F.lit(None).cast("long"), F.lit(False), hashes
        for k, run in enumerate(r for level in self.levels for r in level):
            side = run.select("h1", "h2", F.col("owner").alias(f"_o{k}"), F.lit(True).alias(f"_m{k}"))
            out = out.join(side.hint("merge"), ["h1", "h2"], "left")
            known, old = F.coalesce(known, f"_o{k}"), old | F.coalesce(f"_m{k}", F.lit(False))
        return out.select(*hashes.columns, known.alias("known"), old.alias("old"))

    def add(self, batch: DataFrame) -> DataFrame:
        """New hashes of a batch (h1, h2, owner, some, one row each) become a run; full levels are compacted.

        Returns the hashes whose lines may go (h1, h2, owner): some document of the batch is not the owner.
        """
        with store.ordered(self.spark):
            merged = store.bucketed(self.met(batch), ["h1", "h2"], self.buckets)
            run = store.bucketed(merged.filter(~F.col("old")).select("h1", "h2", "owner"), ["h1", "h2"], self.buckets)
            repeated = store.written(merged.filter(F.col("old") | F.col("some")).select("h1", "h2", F.when(F.col("old"), F.col("known")).otherwise(F.col("owner")).alias("owner")))
        store.dropped(merged)
        self._put(0, run)
        return repeated

    def _put(self, level: int, run: DataFrame) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) == self.fan_in:
            old = self.levels[level]
            self.levels[level] = []
            merged = old[0]
            # runs hold disjoint hashes, so a full merge join keeps every row of both
            for r in old[1:]:
                merged = merged.select(*merged.columns, F.lit(True).alias("_m")).join(r.withColumnRenamed("owner", "_o").hint("merge"), ["h1", "h2"], "full")
                merged = merged.select("h1", "h2", F.when(F.col("_m"), F.col("owner")).otherwise(F.col("_o")).alias("owner"))
            with store.ordered(self.spark):
                run = store.bucketed(merged, ["h1", "h2"], self.buckets)
            for r in old:
                store.dropped(r)
            self._put(level + 1, run)


def dropped_lines(docs: DataFrame, min_chars: int = MIN_CHARS, batches: int = BATCHES, fan_in: int = FAN_IN) -> DataFrame:
    """doc_id, _t, gone: positions (from 0) of the lines that each document loses."""
    cuts = docs.select(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)], 1000)).head()[0] if batches > 1 else []
    cuts = sorted(set(cuts or []))
    runs, parts = Runs(docs.sparkSession, fan_in), []
    # rows without doc_id come last: they own a line only among themselves, and then keep it
    for i in range(len(cuts) + 1):
        part = docs
        if i:
            part = part.filter(F.col("doc_id").isNull() | (F.col("doc_id") > cuts[i - 1])) if i == len(cuts) else part.filter(F.col("doc_id") > cuts[i - 1])
        if i < len(cuts):
            part = part.filter(F.col("doc_id") <= cuts[i])
        lines = _lines(part, min_chars)
        some = (F.min("doc_id") < F.max("doc_id")) | (F.count("doc_id") < F.count("*"))
        repeated = runs.add(lines.groupBy("h1", "h2").agg(F.min("doc_id").alias("owner"), F.coalesce(some, F.lit(False)).alias("some")))
        found = lines.join(repeated, ["h1", "h2"]).filter(F.col("owner").isNotNull() & ~F.col("doc_id").eqNullSafe(F.col("owner")))
        parts.append(store.written(found.select("doc_id", "_t", "pos").distinct()))
        store.dropped(repeated)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("doc_id", "_t").agg(F.collect_list("pos").alias("gone"))


@store.tidy
def dedup_lines(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with repeated lines gone from text, plus n_lines (before) and n_dropped.

    Lines are split at line feeds; a null text is one empty line. Rows that share doc_id are one
    document to the rule. All other columns stay, whatever their names, but for those called
    n_lines or n_dropped, which are replaced.
    """
    gone = dropped_lines(docs.select("doc_id", "text"), **options)
    t, d, u, g = store.spare(docs.columns, "_t", "_d", "_u", "gone")
    left = docs.withColumn(t, F.xxhash64("text"))
    right = gone.select(F.col("doc_id").alias(d), F.col("_t").alias(u), F.col("gone").alias(g))
    joined = left.join(right, F.col("doc_id").eqNullSafe(F.col(d)) & (F.col(t) == F.col(u)), "left")
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    none = F.coalesce(g, F.array().cast("array<int>"))
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), none)
    text = F.when(F.size(none) == 0, F.coalesce("text", F.lit(""))).otherwise(F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n"))
    return joined.withColumns({"text": text, "n_lines": F.size(lines).cast("long"), "n_dropped": F.size(none).cast("long")}).drop(t, d, u, g)


def op6_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return dedup_lines(docs.select("doc_id", "text")).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP6_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents
), k AS (
  SELECT doc_id, pos, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), o AS (
  SELECT key, min(doc_id) AS owner FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1
), j AS (
  SELECT k.*, o.owner IS NOT NULL AND o.owner <> k.doc_id AS gone FROM k LEFT JOIN o ON k.key = o.key
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count_if(gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""
