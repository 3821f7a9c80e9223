"""Gradient-boosted trees, many models at a time, over one table of binned features.

The trees are those of MLlib's classifier: the loss 2 log(1 + exp(-2yF)) of a label y of -1 or 1, trees of variance gain
on its gradient whose leaves are means, a first tree of weight 1 on the labels, later ones of weight ``rate``, and a share
of the rows in each tree and of the columns at each node. Only the table differs: MLlib keeps a copy of the rows with 4
bytes a value for each model and reads it at each level of each tree; here one table of a byte a value, in chunks of
rows, is read once a level for all models. A pass follows the trees so far, adds up gradients by node, column and bin, and
sends sums of fixed size to the driver, which splits the nodes. Of two siblings only the smaller is added up, the
other is the rest of the parent.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bins of a column, rows of a chunk, and rows that the bins' bounds are taken from (as in MLlib, which samples as many).
BINS, CHUNK_ROWS, BOUND_ROWS = 32, 10_000, 10_000
SUBSAMPLE, COLUMN_SHARE = 0.8, 0.7
#: Gradients (below 4) are multiples of 1 / GRAIN, so sums of them are exact in any order. Rows of weight 1 add ONE and their gradient
#: to one sum: the gradients of a chunk stay below ONE / 2 together.
GRAIN, ONE = 2.0**20, 2.0**17


@dataclass
class Tree:
    """Nodes in level order. A node that isn't split sends all rows left, to a node of its own mean."""

    depth: int
    column: list[int] = field(default_factory=list)
    bound: list[int] = field(default_factory=list)  # the last bin that goes left
    value: list[float] = field(default_factory=list)  # of the leaves

    def place(self, bins, level: int):
        """Of each row (columns of ``bins``), the place in ``level``, from 0."""
        import numpy as np

        out = np.zeros(bins.shape[1], np.uint8)
        if not level:
            return out
        right = [bins[self.column[k]] > self.bound[k] for k in range(2**level - 1)]
        taken: list = []  # the turn at each level so far
        for d in range(level):
            options = right[2**d - 1 : 2 ** (d + 1) - 1]
            for turn in reversed(taken):  # the latest turn tells neighbours apart
                options = [(turn & b) | (~turn & a) for a, b in zip(options[::2], options[1::2])]
            taken.append(options[0])
            out = (out << 1) | options[0]
        return out


@dataclass
class Model:
    fold: int | None  # rows of this fold are left out
    seed: int
    trees: list[Tree] = field(default_factory=list)

    def margin(self, bins, rate: float):
        import numpy as np

        out = np.zeros(bins.shape[1])
        for k, t in enumerate(self.trees):
            out += (1.0 if k == 0 else rate) * np.array(t.value)[t.place(bins, t.depth)]
        return out


def bounds(features: DataFrame, columns: list[str], rows: int) -> list:
    """Up to BINS - 1 ascending bounds of each column: middles between all values of few, or quantiles; x goes left if x <= bound."""
    import numpy as np

    known = features.select(_key(columns).alias("_k"), *_numbers(columns))
    if rows > BOUND_ROWS:
        known = known.filter(F.pmod(F.col("_k"), F.lit(1_000_003)) < math.ceil(1_000_003 * BOUND_ROWS / rows))
    table, out = known.toArrow(), []
    for k in range(len(columns)):
        x = np.sort(table.column(k + 1).to_numpy())
        values = np.unique(x)
        if len(values) > BINS:
            out.append(np.unique(x[np.arange(1, BINS) * len(x) // BINS]))
        else:
            out.append((values[1:] + values[:-1]) / 2)
    return out


def _key(columns: list[str]):
    return F.xxhash64("id", "step", *columns)


def _numbers(columns: list[str]) -> list:
    return [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"_x{k}") for k, c in enumerate(columns)]


def chunks(features: DataFrame, columns: list[str], cuts: list, weight: str | None) -> DataFrame:
    """The table: a row for each chunk, with its rows' identity (an Arrow batch of id, step, label, fold), draws, weights and bins, column by column."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            bins = np.empty((len(cuts), batch.num_rows), np.uint8)
            for k, c in enumerate(cuts):
                bins[k] = np.searchsorted(c, batch.column(6 + k).to_numpy())
            rows = pa.RecordBatch.from_arrays(batch.columns[:4], ["id", "step", "label", "fold"])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows.schema) as out:
                out.write_batch(rows)
            data = [sink.getvalue().to_pybytes(), batch.column(4).to_numpy().tobytes(), batch.column(5).to_numpy().tobytes(), bins.tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in data], ["rows", "draws", "weights", "bins"])

    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    wide = features.select("id", "step", "label", "fold", _key(columns).alias("_k"), w.alias("_w"), *_numbers(columns))
    return wide.mapInArrow(run, "rows binary, draws binary, weights binary, bins binary")


def _opened(row, width: int):
    """The batch of identities, draws, weights and bins of a chunk."""
    import numpy as np
    import pyarrow as pa

    rows = pa.ipc.open_stream(row["rows"].as_buffer()).read_all().combine_chunks()
    n = rows.num_rows
    draws, weights = (np.frombuffer(row[c].as_buffer(), t) for c, t in (("draws", np.uint64), ("weights", np.float64)))
    return rows, draws, weights, np.frombuffer(row["bins"].as_buffer(), np.uint8).reshape(width, n)


def _drawn(draws, seed: int, turn: int):
    """Whether each row is in the sample of this tree: a mix of the row's own hash, the seed and the tree's number."""
    import numpy as np

    x = draws ^ np.uint64((seed * 1_000_003 + turn + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return (x ^ (x >> np.uint64(31))) < np.uint64(int(SUBSAMPLE * 2**63) << 1)


def _sums(table: DataFrame, models: list[Model], growing: list[Tree], level: int, slots: list, width: int, rate: float) -> list:
    """Of each model, sums (slot, column, bin, [weight, gradient]); ``slots`` gives each node of the level a slot, or none (255)."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        size = [max((s for s in x if s != 255), default=-1) + 1 for x in slots]
        total = [np.zeros((2, width, n * BINS)) for n in size]
        for batch in batches:
            for row in _rows(batch):
                rows, draws, weights, bins = _opened(row, width)
                y = np.where(rows.column("label").to_numpy() > 0.5, 1.0, -1.0)
                fold = rows.column("fold").to_numpy()
                sample = {s: _drawn(draws, s, len(models[0].trees)) for s in {m.seed for m in models}}
                plain = bool((weights == 1).all())
                for k, (model, tree) in enumerate(zip(models, growing)):
                    if not size[k]:
                        continue
                    slot = np.array(slots[k], np.uint8)[tree.place(bins, level)]
                    chosen = np.flatnonzero(sample[model.seed] & (slot != 255) & (True if model.fold is None else fold != model.fold))
                    if not len(chosen):
                        continue
                    part, yk = np.take(bins, chosen, axis=1), y[chosen]
                    gradient = 4 * yk / (1 + np.exp(2 * yk * model.margin(part, rate))) if model.trees else yk
                    part += slot[chosen] * np.uint8(BINS)
                    gradient = np.round(gradient * GRAIN) / GRAIN
                    n, both = size[k] * BINS, np.empty((2, width, size[k] * BINS))
                    if plain:
                        gradient += ONE
                        for c in range(width):
                            both[1, c] = np.bincount(part[c], gradient, n)
                        np.round(both[1] / ONE, out=both[0])
                        both[1] -= both[0] * ONE
                    else:
                        w = weights[chosen]
                        gradient *= w
                        for c in range(width):
                            both[0, c], both[1, c] = np.bincount(part[c], w, n), np.bincount(part[c], gradient, n)
                    total[k] += both
        yield pa.RecordBatch.from_arrays([pa.array(range(len(models)), pa.int32()), pa.array([t.tobytes() for t in total], pa.binary())], ["model", "sums"])

    def add(group):
        import numpy as np
        import pyarrow as pa

        total = sum(np.frombuffer(x.as_buffer()) for x in group.column("sums"))
        return pa.table({"model": group.column("model").slice(0, 1), "sums": pa.array([total.tobytes()], pa.binary())})

    import numpy as np

    parts = table.mapInArrow(run, "model int, sums binary").groupBy("model").applyInArrow(add, "model int, sums binary").collect()
    out = [np.zeros((0, width, BINS, 2))] * len(models)
    for r in parts:
        out[r.model] = np.frombuffer(r.sums).reshape(2, width, -1, BINS).transpose(2, 1, 3, 0)
    return out


def _rows(batch):
    return ({c: batch.column(k)[i] for k, c in enumerate(batch.schema.names)} for i in range(batch.num_rows))


def _split(sums, chosen):
    """The best column among ``chosen`` and its last bin to the left; None if no split gains anything."""
    import numpy as np

    part = sums[chosen]
    left = np.cumsum(part, axis=1)[:, :-1]
    total = part.sum(axis=1)[:, None]
    right = total - left
    ok = (left[..., 0] > 1e-9) & (right[..., 0] > 1e-9)
    square = lambda s: s[..., 1] ** 2 / np.maximum(s[..., 0], 1e-9)
    gain = np.where(ok, square(left) + square(right) - square(total), -1.0)
    best = int(gain.argmax())
    if gain.flat[best] <= 1e-9:
        return None
    c, b = divmod(best, gain.shape[1])
    return int(chosen[c]), b


def train(table: DataFrame, models: list[Model], width: int, rounds: int, rate: float, depth: int) -> None:
    """Grows ``rounds`` trees in each model, all in step."""
    import numpy as np

    if depth > 4:
        raise ValueError("bins and slots of a level share a byte: a depth of 4 at most")
    share = math.ceil(COLUMN_SHARE * width)
    for turn in range(rounds):
        growing = [Tree(depth) for _ in models]
        sums: list[list] = [[] for _ in models]  # of the nodes of the level
        draws = [np.random.default_rng((m.seed, turn, 0 if m.fold is None else m.fold + 1)) for m in models]
        means = [[0.0] for _ in models]
        slots = [[0] for _ in models]
        for level in range(depth):
            got = _sums(table, models, growing, level, slots, width, rate)
            for k, tree in enumerate(growing):
                if level:  # the others are the rest of their parents
                    of = {node: got[k][s] for node, s in enumerate(slots[k]) if s != 255}
                    sums[k] = [of[n] if n in of else sums[k][n // 2] - of[n ^ 1] if n ^ 1 in of else None for n in range(2**level)]
                else:
                    sums[k] = [got[k][0]] if len(got[k]) else [None]
                following, slots[k] = [], []
                for n, s in enumerate(sums[k]):
                    best = None if s is None else _split(s, np.sort(draws[k].permutation(width)[:share]))
                    weight, total = (0.0, 0.0) if s is None else s[0].sum(axis=0)
                    mean = total / weight if weight > 1e-9 else means[k][n]
                    tree.column.append(best[0] if best else 0)
                    tree.bound.append(best[1] if best else 255)
                    if best:
                        left = s[best[0], : best[1] + 1].sum(axis=0)
                        right = s[best[0], best[1] + 1 :].sum(axis=0)
                        following += [left[1] / left[0], right[1] / right[0]]
                        used = max((x for x in slots[k] if x != 255), default=-1) + 1
                        slots[k] += [used, 255] if left[0] <= right[0] else [255, used]
                    else:
                        following += [mean, mean]
                        slots[k] += [255, 255]
                means[k] = [float(x) for x in following]
        for k, (model, tree) in enumerate(zip(models, growing)):
            tree.value = means[k]
            model.trees.append(tree)


def scores(table: DataFrame, models: list[Model], width: int, rate: float, schema: str) -> DataFrame:
    """Each row with the mean log-odds of the models that left its fold out."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for row in _rows(batch):
                rows, _, _, bins = _opened(row, width)
                fold, score = rows.column("fold").to_numpy(), np.zeros(rows.num_rows)
                for k in np.unique(fold):
                    at, own = np.flatnonzero(fold == k), [m for m in models if m.fold == k]
                    score[at] = 2 * sum(m.margin(bins[:, at], rate) for m in own) / len(own)
                for part in rows.append_column("score", pa.array(score)).select(["id", "step", "label", "score", "fold"]).to_batches():
                    yield part

    return table.mapInArrow(run, schema)
