"""Quality classifier: a byte-level convolutional network in numpy (operator 4).

``FILTERS`` learned filters of ``SPAN`` bytes pass over every byte of a text. Their outputs are
max-pooled over overlapping chunks of two blocks of ``BLOCK`` places each, that cover the whole text; tanh of
these gives a chunk's vector. Mean, maximum and minimum over a text's chunks enter a logistic
unit. As the first layer sees one-hot bytes, a filter is a sum of table rows, one a byte.

The network learns from whole texts of at most ``SAMPLE`` labelled rows, the first by a hash of doc_id whose texts have
``SAMPLE_CHARS`` characters at most together (documented bounds on the sample); scoring covers all texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store
from .tokens import groups_of

FILTERS, SPAN, BLOCK = 16, 5, 128
SAMPLE, SAMPLE_CHARS = 6000, 24_000_000
EPOCHS, BATCH, RATE, SEED = 8, 32, 0.02, 7
_PAD = 256


class ByteCnn:
    def __init__(self, params: dict | None = None):
        import numpy as np

        rng = np.random.default_rng(SEED)
        self.p = params or {
            "t": rng.normal(0, 0.3, (SPAN, 257, FILTERS)).astype(np.float32),
            "b": np.full(FILTERS, -0.5, np.float32),
            "w": np.zeros(3 * FILTERS, np.float32),
            "c": np.zeros(1, np.float32),
        }
        self._fix()

    def _fix(self) -> None:
        self.p["t"][:, _PAD] = 0
        self.p["t"][0, _PAD] = -1e9  # no filter starts in the padding

    def _laid_out(self, texts: list[bytes]):
        import numpy as np

        blocks = np.array([max(1, -(-len(t) // BLOCK)) for t in texts])
        x = np.full(int(blocks.sum()) * BLOCK + SPAN - 1, _PAD, np.int16)
        at = 0
        for t, n in zip(texts, blocks.tolist()):
            x[at : at + len(t)] = np.frombuffer(t, np.uint8)
            at += n * BLOCK
        return x, blocks

    def _pooled(self, x, places: bool):
        """Each block's maximum of each filter, and where it is."""
        import numpy as np

        t, step = self.p["t"], BLOCK << 10
        best, where = [], []
        n = len(x) - SPAN + 1
        for a in range(0, n, step):
            b = min(n, a + step)
            acc = t[0].take(x[a:b], axis=0)
            for j in range(1, SPAN):
                acc += t[j].take(x[a + j : b + j], axis=0)
            acc = acc.reshape(-1, BLOCK, FILTERS)
            if places:
                at = acc.argmax(axis=1)
                where.append(at + a + (np.arange(len(acc)) * BLOCK)[:, None])
                best.append(np.take_along_axis(acc, at[:, None], 1)[:, 0])
            else:
                best.append(acc.max(axis=1))
        return np.concatenate(best), np.concatenate(where) if places else None

    def _forward(self, texts: list[bytes], places: bool = False):
        import numpy as np

        x, blocks = self._laid_out(texts)
        best, where = self._pooled(x, places)
        first = np.cumsum(blocks) - blocks
        last = np.zeros(len(best), bool)
        last[first + blocks - 1] = True
        nxt = np.minimum(np.arange(len(best)) + 1, len(best) - 1)
        right = (best[nxt] > best) & ~last[:, None]  # a chunk is a block and the next one of its text
        chunk = np.where(right, best[nxt], best)
        h = np.tanh(np.maximum(chunk, -30) + self.p["b"])
        mean = np.add.reduceat(h, first) / blocks[:, None]
        feats = np.concatenate([mean, np.maximum.reduceat(h, first), np.minimum.reduceat(h, first)], axis=1).astype(np.float32)
        logit = feats @ self.p["w"] + self.p["c"][0]
        return x, blocks, first, nxt, right, where, h, feats, logit

    def score(self, texts: list[bytes]):
        import numpy as np

        return 1 / (1 + np.exp(-np.clip(self._forward(texts)[-1].astype(np.float64), -40, 40)))

    def _gradients(self, texts: list[bytes], y, weight):
        import numpy as np

        x, blocks, first, nxt, right, where, h, feats, logit = self._forward(texts, places=True)
        d = (1 / (1 + np.exp(-logit)) - y) * weight / len(texts)
        doc = np.repeat(np.arange(len(texts)), blocks)
        df = d[:, None] * self.p["w"]
        most, least = feats[:, FILTERS : 2 * FILTERS], feats[:, 2 * FILTERS :]
        dh = (df[:, :FILTERS] / blocks[:, None])[doc]
        for ref, part in ((most, df[:, FILTERS : 2 * FILTERS]), (least, df[:, 2 * FILTERS :])):
            same = h == ref[doc]
            dh = dh + part[doc] * same / np.maximum(1, np.add.reduceat(same, first).astype(np.float32))[doc]
        dc = dh * (1 - h * h)
        place = np.where(right, where[nxt], where)
        g = {"w": feats.T @ d, "c": np.array([d.sum()]), "b": dc.sum(axis=0), "t": np.zeros_like(self.p["t"])}
        f = np.broadcast_to(np.arange(FILTERS), place.shape)
        for j in range(SPAN):
            np.add.at(g["t"][j], (x[place + j], f), dc)
        g["t"][:, _PAD] = 0
        return g

    def fit(self, texts: list[bytes], labels: list[int]) -> ByteCnn:
        import numpy as np

        y = np.array(labels, np.float32)
        if not len(y) or y.min() == y.max():
            self.p["c"][0] = 0.0 if not len(y) else 2.0 if y[0] else -2.0
            return self
        rng = np.random.default_rng(SEED)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(u) for k, u in self.p.items()}
        steps, total = 0, EPOCHS * -(-len(y) // BATCH)
        rare = float(np.sqrt(max(1e-3, y.mean()) / max(1e-3, 1 - y.mean())))
        weight = np.where(y > 0, 1.0, max(1.0, rare)).astype(np.float32)
        for _ in range(EPOCHS):
            order = rng.permutation(len(y))
            for a in range(0, len(order), BATCH):
                own = order[a : a + BATCH]
                steps += 1
                rate = RATE * (1 - steps / (total + 1))
                for k, g in self._gradients([texts[i] for i in own], y[own], weight[own]).items():
                    m[k] += 0.1 * (g - m[k])
                    v[k] += 0.001 * (g * g - v[k])
                    self.p[k] -= (rate * (m[k] / (1 - 0.9**steps)) / (np.sqrt(v[k] / (1 - 0.999**steps)) + 1e-8)).astype(np.float32)
                self._fix()
        return self


def held_out(doc_id):
    """Rows whose labels the model never sees."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_chars: int = SAMPLE_CHARS) -> ByteCnn:
    """Fit on whole texts of at most ``sample`` labelled rows, the first by md5 of doc_id, that aren't held out.

    Of these, rows enter up to the one that would take their texts beyond ``sample_chars`` characters together. Rows without
    label or doc_id are left out; of several labels of one document the largest counts, of several texts the smallest by
    hash. Without labels every text scores 0.5.
    """
    known = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    order = F.md5(F.col("doc_id").cast("string").cast("binary"))
    chosen = known.orderBy(order, "doc_id").limit(sample)
    text = F.coalesce("text", F.lit(""))
    met = docs.select("doc_id", text.alias("text"), F.length(text).alias("n")).join(F.broadcast(chosen), "doc_id")
    one = met.groupBy("doc_id", "quality").agg(F.min_by("n", F.xxhash64("text")).alias("n"))
    ids, total = {}, 0
    for r in one.orderBy(order, "doc_id").collect():  # at most `sample` rows of numbers
        total += r["n"]
        if total > sample_chars:
            break
        ids[r["doc_id"]] = int(r["quality"])
    picked = docs.sparkSession.createDataFrame([(i,) for i in ids], "doc_id long")
    # at most `sample` rows of `sample_chars` characters together reach the driver
    rows = docs.select("doc_id", text.alias("text")).join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text")).orderBy("doc_id").collect()
    return ByteCnn().fit([r["text"].encode() for r in rows], [ids[r["doc_id"]] for r in rows])


def score(docs: DataFrame, model: ByteCnn, text: str = "text") -> DataFrame:
    """``docs`` plus ``score`` (probability of label 1). Null texts score as empty ones."""
    store.small_batches(docs.sparkSession)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name != "score")
    params = model.p

    def run(batches):
        import pyarrow as pa

        net = ByteCnn({k: v.copy() for k, v in params.items()})
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
            for a, b in groups_of(texts, 1_000_000):
                got = net.score([(t or "").encode() for t in texts[a:b]])
                yield batch.slice(a, b - a).append_column("score", pa.array(got, pa.float64()))
        store.trim()

    return docs.drop("score").mapInArrow(run, f"{schema}, score double")


def op4_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
