"""Best-fit packing by hierarchical residual merging (operator 8).

Pieces of exactly the capacity are sequences of their own. The others are packed best-fit,
longest first, inside each partition. Bins that are nearly full, or that nothing left could
enter, are emitted; the underfull ones become items, and groups of them are packed again, ``FAN_IN``
groups at a time, until one group is left.

What reaches a group stays small. Best-fit leaves at most one bin of half the capacity or less in
a group, and two bins above half never share one, so at most as many bins above half can still
gain anything as there are bins at or below half. Each group passes on no more bins of one fill
than that number, and the rest are emitted unchanged: no packing is lost by it.
"""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store
from .tokens import array_groups, encoder, vocabulary

CAPACITY, FAN_IN, NEARLY_FULL = 1024, 8, 1.0


def best_fit(sizes: list[int], capacity: int) -> tuple[list[int], list[int], list[int]]:
    """Bin and offset of each item, and each bin's fill; longest items first, ties in order given."""
    bins: list[list[int]] = [[] for _ in range(capacity + 1)]  # by room left
    room_mask, fills = 0, []
    at, offset = [0] * len(sizes), [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        size = sizes[i]
        fitting = room_mask >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            b = bins[room].pop()
            if not bins[room]:
                room_mask &= ~(1 << room)
        else:
            b, room = len(fills), capacity
            fills.append(0)
        at[i], offset[i] = b, fills[b]
        fills[b] += size
        left = room - size
        if left:
            bins[left].append(b)
            room_mask |= 1 << left
    return at, offset, fills


def pieces(docs: DataFrame, tokenizer: str, kind: str, end_id: int, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids): documents over the capacity are cut, the first piece may be shorter."""
    store.small_batches(docs.sparkSession, 5000)

    def cut(batches):
        import pyarrow as pa

        enc = encoder(tokenizer, kind, end_id)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for a, b in array_groups(texts):
                rows = []
                for doc, raw in zip(ids[a:b], enc.encode(texts.slice(a, b - a))):
                    n, start = len(raw) // 4, 0
                    size = n % capacity or capacity
                    for k in range(-(-n // capacity)):
                        part = raw[4 * start : 4 * (start + size)]
                        rows.append((doc, k, start, size, zlib.crc32(part), part if with_ids else None))
                        start, size = start + size, capacity
                types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["doc_id", "piece", "start", "length", "ids_crc32", "ids"])
        store.trim()

    out = docs.select("doc_id", "text").mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary")
    return out if with_ids else out.drop("ids")


@store.tidy
def pack(items: DataFrame, capacity: int = CAPACITY, nearly_full: float = NEARLY_FULL) -> DataFrame:
    """``items`` (any columns, with ``length`` from 1 to the capacity) plus sequence_id and offset.

    ``items`` is read more than once, so it should be a written table. Equal rows are packed one by
    one; an empty table gives an empty one. Columns called sequence_id or offset are replaced.
    """
    spark = items.sparkSession
    items = items.drop("sequence_id", "offset")
    names = items.columns
    own, fill = store.spare([*names, "sequence_id", "offset"], "_bin", "_fill")
    into, at_, old = store.spare([*names, "sequence_id", "offset", own, fill], "_into", "_at", "_old")

    def local(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 40
        held, rows = [], 0

        def packed(table):
            nonlocal first
            sizes = table.column("length").to_pylist()
            at, offset, fills = best_fit(sizes, capacity)
            out = table.append_column(own, pa.array([first + b for b in at], pa.int64()))
            out = out.append_column("offset", pa.array(offset, pa.int64()))
            out = out.append_column(fill, pa.array([fills[b] for b in at], pa.int64()))
            first += len(fills)
            return out.to_batches()

        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= 1_000_000:
                yield from packed(pa.Table.from_batches(held))
                held, rows = [], 0
        if held:
            yield from packed(pa.Table.from_batches(held))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema.fields)
    with store.setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", 50_000):
        first = store.written(items.mapInArrow(local, f"{schema}, `{own}` long, offset long, `{fill}` long"))
    full = capacity * nearly_full
    bins = first.filter((F.col("offset") == 0) & (F.col(fill) < full)).select(F.col(own).alias("bin"), F.col(fill).alias("fill"), F.shiftright(own, 40).cast("int").alias("grp"))
    where = None  # of each bin that was merged: the bin it is in now, and its place there
    used: list[DataFrame] = []
    while True:
        bins = _useful(bins, capacity)
        if bins is None:
            break
        used.append(bins)
        groups = bins.agg(F.countDistinct("grp")).head()[0]
        merged = store.written(
            bins.withColumn("grp", F.floor(F.col("grp") / FAN_IN).cast("int")).groupBy("grp").applyInPandas(lambda g: _merge(g, capacity), "grp int, bin long, into long, at long, fill long")
        )
        used.append(merged)
        step = merged.select("bin", "into", "at")
        if where is None:
            where = step
        else:
            moved = step.select(F.col("bin").alias("into"), F.col("into").alias("next"), F.col("at").alias("more"))
            where = where.join(moved, "into", "left").select("bin", F.coalesce("next", "into").alias("into"), (F.col("at") + F.coalesce("more", F.lit(0))).alias("at")).unionByName(
                step.join(where.select("bin"), "bin", "left_anti")
            )
            where = store.written(where)
            used.append(where)
        if groups <= 1:
            break
        bins = merged.filter((F.col("at") == 0) & (F.col("fill") < full)).select(F.col("into").alias("bin"), "fill", "grp")
    if where is None:
        return first.select(*names, F.col(own).alias("sequence_id"), "offset")
    moved = where.filter((F.col("bin") != F.col("into")) | (F.col("at") != 0)).select(F.col("bin").alias(old), F.col("into").alias(into), F.col("at").alias(at_))
    return first.join(moved, F.col(own) == F.col(old), "left").select(*names, F.coalesce(into, own).alias("sequence_id"), (F.col("offset") + F.coalesce(at_, F.lit(0))).alias("offset"))


def _useful(bins: DataFrame, capacity: int) -> DataFrame | None:
    """The bins that a merge could still improve; None if there is none."""
    low = F.col("fill") * 2 <= capacity
    x = bins.agg(F.count_if(low).alias("n"), F.min("fill").alias("least"), F.count("*").alias("all")).head()
    if not x["n"] or x["all"] < 2:
        return None
    from pyspark.sql import Window

    fitting = bins.filter(low | (F.col("fill") + x["least"] <= capacity))
    rank = F.row_number().over(Window.partitionBy("grp", "fill").orderBy("bin"))
    out = store.written(fitting.withColumn("_r", rank).filter(low | (F.col("_r") <= x["n"])).drop("_r"))
    return out if out.count() > 1 else None


def _merge(group, capacity: int):
    import pandas as pd

    group = group.sort_values(["fill", "bin"], ascending=[False, True], kind="stable")
    ids = group["bin"].tolist()
    at, offset, fills = best_fit(group["fill"].tolist(), capacity)
    head = {}
    for i, b in enumerate(at):
        head.setdefault(b, ids[i])  # a merged bin is called after its first part, which is at 0
    return pd.DataFrame({"grp": group["grp"].iloc[0], "bin": ids, "into": [head[b] for b in at], "at": offset, "fill": [fills[b] for b in at]})


@store.tidy
def pack_documents(docs: DataFrame, tokenizer: str, kind: str = "byte", end_id: int = 2, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of all documents with the sequence and offset they go to. Null texts are empty: one end id."""
    cut = store.written(pieces(docs, tokenizer, kind, end_id, capacity))
    return pack(cut, capacity)


def sequences(docs: DataFrame, placed: DataFrame, tokenizer: str, kind: str = "byte", end_id: int = 2, capacity: int = CAPACITY) -> DataFrame:
    """The token ids of every packed sequence: sequence_id, n_tokens, ids (32-bit, little-endian)."""
    full = pieces(docs, tokenizer, kind, end_id, capacity, with_ids=True)
    keys = ["doc_id", "piece", "start", "length", "ids_crc32"]
    # rows that agree in all of these hold the same ids
    ids = full.dropDuplicates(keys)
    cond = [placed[k].eqNullSafe(ids[k]) for k in keys]
    joined = placed.join(ids, cond).select(placed["sequence_id"], placed["offset"], placed["length"], ids["ids"])
    return joined.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.expr("array_join(transform(array_sort(collect_list(struct(offset, ids))), x -> hex(x.ids)), '')").alias("_h")).select(
        "sequence_id", "n_tokens", F.unhex("_h").alias("ids")
    )


def op8_residual_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack_documents(docs, vocabulary("byte_bpe_50k.json"))
