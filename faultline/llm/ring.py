"""Sharding by a consistent-hash ring with virtual nodes and bounded loads (operator 10).

Every shard has ``VNODES`` points on a ring, and a row's home is the first point clockwise from its
key's hash. No shard takes more than its capacity; a row that finds its shard full goes on clockwise to
the next point of one that isn't. The walk is done on counts: rows are counted by unit, an arc between two
points or a part of one that begins at a hash prefix, and only those counts (a number bounded by
the ring, whatever the input) come to the driver, which deals each unit's rows clockwise. In a unit,
rows are ranked, and ranks meet quotas in a join. Units of more than ``UNIT_ROWS`` rows are cut by a hash of
the row for that, so that rows which share one key are not ranked in one task.

With ``law="rows"`` the capacities are the shares, which differ by one row at most, and so do the
shards. ``slack`` gives room above them: loads are then at most (1 + slack) times the mean, and one more
shard moves few rows. With ``law="key"`` there is no bound on loads: a row's shard depends on doc_id and
the number of shards alone, and one more shard takes rows only into itself.
"""

from __future__ import annotations

import hashlib
from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import store

VNODES, CELL_BITS, SHARDS, UNIT_ROWS = 64, 13, 16, 1_000_000


def ring_hash(key: Column) -> Column:
    """52 bits of the md5 of the key as text; a null key hashes like the empty text."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 13), 16, 10).cast("long")


def points(shards: int, vnodes: int = VNODES) -> list[tuple[int, int]]:
    """(position, shard) of all virtual nodes in ring order; a shard's points don't depend on the others."""
    return sorted((int(hashlib.md5(f"shard-{s}-{v}".encode()).hexdigest()[:13], 16), s) for s in range(shards) for v in range(vnodes))


def capacities(total: int, shards: int, slack: float = 0.0) -> list[int]:
    """Rows that each shard may take: equal shares, one row apart at most, or (1 + slack) times the mean, rounded up."""
    if slack:
        return [ceil((1 + slack) * total / shards)] * shards
    return [total // shards + (s < total % shards) for s in range(shards)]


def deal(counts: dict[tuple[int, int], int], shards: int, vnodes: int = VNODES, slack: float = 0.0) -> list[tuple[int, int, int, int, int, int]]:
    """(home, cell, shard, first rank, end rank, first slot): each unit's rows dealt clockwise within the capacities.

    A unit is (home, cell): the place of its home point in ring order, and its hash prefix. First all rows that fit go home;
    the overflow then walks on. Both passes follow the ring's order, so the outcome depends on the counts alone.
    """
    room = capacities(sum(counts.values()), shards, slack)
    ring = points(shards, vnodes)
    taken: dict[tuple[int, int], list[tuple[int, int]]] = {}
    left = {}
    order = sorted(counts, key=lambda u: (u[1], u[0] or len(ring)))  # home 0 also ends the ring
    for u in order:
        s = ring[u[0]][1]
        n = min(room[s], counts[u])
        room[s] -= n
        taken[u] = [(s, n)] if n else []
        left[u] = counts[u] - n
    for u in order:
        i = u[0]
        while left[u]:
            i = (i + 1) % len(ring)
            s = ring[i][1]
            n = min(room[s], left[u])
            if n:
                room[s] -= n
                left[u] -= n
                taken[u].append((s, n))
    slots, out = [0] * shards, []
    for u in order:
        rank = 0
        for s, n in taken[u]:
            out.append((*u, s, rank, rank + n, slots[s]))
            slots[s] += n
            rank += n
    return out


def _homes(rows: DataFrame, hash_: str, cell: str, home: str, shards: int, cell_bits: int, vnodes: int) -> DataFrame:
    """``rows`` plus cell (the hash's first bits) and home, the place in ring order of the first point at or after the hash.

    Each cell's few points come with a table of 2 ** cell_bits rows, whatever the input.
    """
    ring = points(shards, vnodes)
    width = 52 - cell_bits
    inside: dict[int, list[int]] = {}
    for p, _ in ring:
        inside.setdefault(p >> width, []).append(p)
    table, before = [], 0
    for c in range(1 << cell_bits):
        table.append((c, before, inside.get(c, [])))
        before += len(inside.get(c, []))
    first, own = store.spare([*rows.columns, hash_, cell, home], "_first", "_points")
    cells = rows.sparkSession.createDataFrame(table, f"`{cell}` int, `{first}` int, `{own}` array<long>")
    placed = rows.withColumn(cell, F.shiftright(hash_, width).cast("int")).join(F.broadcast(cells), cell)
    at = F.col(first) + F.size(F.filter(own, lambda p: p < F.col(hash_)))
    return placed.withColumn(home, (at % len(ring)).cast("int")).drop(first, own)


@store.tidy
def shard_rows(rows: DataFrame, key: str = "doc_id", shards: int = SHARDS, cell_bits: int = CELL_BITS, ties: tuple[str, ...] = (), slack: float = 0.0, vnodes: int = VNODES, unit_rows: int = UNIT_ROWS) -> DataFrame:
    """``rows`` plus shard and slot (gapless from 0 in each shard); without ``slack`` counts are at most one apart.

    Rows with the same key and the same ``ties`` are interchangeable; which of them gets which
    place is open. An empty table gives an empty one. Other columns stay, whatever their names, but for those
    called shard or slot, which are replaced and so can't be the key.
    """
    spark = rows.sparkSession
    if {key, *ties} & {"shard", "slot"}:
        raise ValueError("shard and slot are columns of the result")
    rows = rows.drop("shard", "slot")
    names = rows.columns
    h, cell, home, salt, rank, k, before, start, end, slot = store.spare([*names, "shard", "slot"], "_h", "_cell", "_home", "_salt", "_rank", "_cuts", "_before", "_from", "_to", "_slot")
    placed = _homes(rows.withColumn(h, ring_hash(F.col(key))), h, cell, home, shards, cell_bits, vnodes)
    counts = {(r[1], r[0]): r[2] for r in placed.groupBy(cell, home).count().collect()}  # at most 2 ** cell_bits + shards * vnodes rows
    # at most one row a unit
    large = [(c, p, -(-n // unit_rows)) for (p, c), n in counts.items() if n > unit_rows]
    if large:
        cuts = F.broadcast(spark.createDataFrame(large, f"`{cell}` int, `{home}` int, `{k}` int"))
        placed = placed.join(cuts, [cell, home], "left").withColumn(salt, F.pmod(F.xxhash64(key, *ties), F.coalesce(k, F.lit(1))).cast("int")).drop(k)
        # at most one row a unit and one more for each ``unit_rows`` rows
        parts = store.written(placed.join(cuts, [cell, home], "left_semi").groupBy(cell, home, salt).agg(F.count("*").alias(before)))
        below = Window.partitionBy(cell, home).orderBy(salt).rowsBetween(Window.unboundedPreceding, -1)
        placed = placed.join(F.broadcast(parts.withColumn(before, F.coalesce(F.sum(before).over(below), F.lit(0)))), [cell, home, salt], "left")
    else:
        placed = placed.withColumn(salt, F.lit(0)).withColumn(before, F.lit(0))
    quotas = spark.createDataFrame(deal(counts, shards, vnodes, slack), f"`{home}` int, `{cell}` int, shard int, `{start}` long, `{end}` long, `{slot}` long")
    order = Window.partitionBy(cell, home, salt).orderBy(h, key, *ties)
    ranked = placed.withColumn(rank, F.row_number().over(order).cast("long") - 1 + F.coalesce(before, F.lit(0)))
    # quotas has at most one row a unit and one more for each time a unit is split
    joined = ranked.join(F.broadcast(quotas), [cell, home]).filter((F.col(rank) >= F.col(start)) & (F.col(rank) < F.col(end)))
    return joined.select(*names, "shard", (F.col(slot) + F.col(rank) - F.col(start)).alias("slot"))


def shard_keys(rows: DataFrame, key: str = "doc_id", shards: int = SHARDS, cell_bits: int = CELL_BITS, vnodes: int = VNODES) -> DataFrame:
    """``rows`` plus shard by the key alone (law ``key``): the first point clockwise, loads unbounded. A column shard is replaced."""
    if key == "shard":
        raise ValueError("shard is a column of the result")
    rows = rows.drop("shard")
    h, cell, home = store.spare([*rows.columns, "shard"], "_h", "_cell", "_home")
    placed = _homes(rows.withColumn(h, ring_hash(F.col(key))), h, cell, home, shards, cell_bits, vnodes)
    owners = F.array(*[F.lit(s) for _, s in points(shards, vnodes)])
    return placed.select(*rows.columns, F.get(owners, F.col(home)).alias("shard"))


def op10_bounded_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.select(
        "doc_id",
        (F.octet_length(F.coalesce("text", F.lit(""))) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
    )
    return shard_rows(rows, ties=("text_crc32", "size")).select("doc_id", "size", "text_crc32", "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
