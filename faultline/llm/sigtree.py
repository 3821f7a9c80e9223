"""N-gram Jaccard join by signature trees (operator 7).

Two documents link if the Jaccard index of their sets of word n-grams is at least num / den. The
steps, each exact:

1. Documents with equal sets are one class (by a 64-bit fingerprint of the sorted set), and one row
   from there on. N-grams are ordered by their rarest word, by a sketch of word counts of fixed size.
2. Linked sets share an n-gram among their first ``size - ceil(t * size) + 1`` in any common order, so
   classes meet in the groups of those n-grams. With rare words first, texts that have only common
   lines or passages in common hardly meet.
3. In a group, a signature tree is built over classes sorted by size: nodes hold OR-combined bitmaps
   and size ranges. Pairs of nodes, then of classes, are dropped if their sizes, places or bitmaps
   bound the overlap below what the index asks for, or if both are in one component already. A pair is
   left to the group of its first common n-gram: each row carries the ``BEFORE`` n-grams that its class
   has in groups before this one, and two rows that share one of these don't meet again.
4. What is left is verified on whole sets. A group whose pairs exceed a budget stops there; it goes on
   in the next round, with the components of verified links known and a larger budget, until no
   group is left. A large group of near copies thus costs a few stars, not all its pairs, and no pair
   between different components is left out. Groups beyond ``GROUP`` classes are cut into blocks, and
   the blocks are compared two by two once each is done.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import store
from .components import components
from .words import commonness, gram_set, ordered_grams, text_hashes

WORDS, NUM, DEN = 4, 85, 100
BITS, LEAF, FAN, GROUP = 1024, 16, 16, 20_000
ROUNDS = 60
#: N-grams of a class before a row's own that the row carries. More of them spare repeated pairs; none changes the result.
BEFORE = 8
#: Up to so many candidates (8 bytes each), their ids are sent to all tasks to fetch their texts; beyond, texts are joined by shuffle.
BROADCAST_ROWS = 1_000_000


def required(a, b, num: int, den: int):
    """Smallest overlap of sets of these sizes that makes a link."""
    return -((-num * (a + b)) // (num + den))


def _first(n: int, num: int, den: int) -> int:
    return n - -(-num * n // den) + 1



def _bitmap(grams):
    import numpy as np

    bits = np.zeros(BITS, bool)
    bits[(grams >> np.uint64(10)) % np.uint64(BITS)] = True
    return np.packbits(bits).tobytes()


def _fingerprint(grams) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(grams.tobytes()) - (1 << 63)


def fingerprints(docs: DataFrame, n: int, num: int, den: int, levels) -> DataFrame:
    """doc_id, size, cid (fingerprint of the set, null if empty), bitmap, grams (the first, in order)."""
    store.small_batches(docs.sparkSession)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            out = []
            for doc, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                s = np.unique(ordered_grams(text_hashes(t), n, levels))
                if len(s):
                    out.append((doc, len(s), _fingerprint(s), _bitmap(s), s[: _first(len(s), num, den)].view(np.int64)))
                else:
                    out.append((doc, 0, None, None, None))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [[]] * 5, types)], ["doc_id", "size", "cid", "bitmap", "grams"])
        store.trim()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, size long, cid long, bitmap binary, grams array<long>")


def _partnered(gram, size, pos, num: int, den: int):
    """Rows whose group (rows sorted by gram, then size) holds another row that sizes and places let them link with.

    The smallest other size that the index admits asks for the least overlap, so a row that fails with it fails with all.
    """
    import numpy as np

    n = len(gram)
    group = np.cumsum(np.concatenate([[False], gram[1:] != gram[:-1]])) << 40
    here = np.arange(n)
    at = np.searchsorted(group + size, group + -(-num * size // den))
    at = np.where(at == here, at + 1, at)
    other = np.minimum(at, n - 1)
    need = required(size, size[other], num, den)
    return (at < n) & (group[other] == group) & (size[other] >= need) & (size - pos >= need)


def _shared(rows: DataFrame, parts: int, num: int, den: int) -> DataFrame:
    """gram, i, j (block and block again), cid, size, pos of n-grams that at least two classes hold; blocks of at most twice GROUP rows."""
    limit = GROUP

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def emit(cols, block):
            if not block:
                for _ in range(2):
                    if len(cols[0]):
                        keep = _partnered(cols[0], cols[2].astype(np.int64), cols[3].astype(np.int64), num, den)
                        cols = [c[keep] for c in cols]
            blocks = pa.array(np.full(len(cols[0]), block, np.int32))
            return pa.RecordBatch.from_arrays([pa.array(cols[0]), blocks, blocks, *map(pa.array, cols[1:])], ["gram", "i", "j", "cid", "size", "pos"])

        held, block = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [c.to_numpy() for c in batch.columns]
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols)]
            cut = int(np.searchsorted(cols[0], cols[0][-1]))
            first = int(np.searchsorted(cols[0], cols[0][0], "right")) if block else 0
            if cut:
                if block:  # the rest of an n-gram whose first blocks are out
                    yield emit([c[:first] for c in cols], block + 1)
                    block = 0
                yield emit([c[first:cut] for c in cols], 0)
            held = [c[cut:] for c in cols]
            while len(held[0]) >= 2 * limit:
                yield emit([c[:limit] for c in held], block + 1)
                held, block = [c[limit:] for c in held], block + 1
        if held is not None:
            yield emit(held, block + 1 if block else 0)
        store.trim()

    placed = rows.select("gram", "cid", "size", "pos").repartition(parts, "gram").sortWithinPartitions("gram", "size", "cid")
    return placed.mapInArrow(run, "gram long, i int, j int, cid long, size long, pos int")


class Tree:
    """A signature tree over rows sorted by size: levels of (OR bitmap, least and largest size, excess, least and largest component)."""

    def __init__(self, size, bits, comp):
        import numpy as np

        self.size, self.bits, self.comp = size, bits, comp
        excess = size - np.bitwise_count(bits).sum(axis=1)
        level = (bits, size, size, excess, comp, comp)
        self.levels = [level]
        fan = LEAF
        while len(self.levels[-1][0]) > 1:
            starts = np.arange(0, len(self.levels[-1][0]), fan)
            b, lo, hi, ex, c0, c1 = self.levels[-1]
            self.levels.append((np.bitwise_or.reduceat(b, starts), np.minimum.reduceat(lo, starts), np.maximum.reduceat(hi, starts), np.maximum.reduceat(ex, starts), np.minimum.reduceat(c0, starts), np.maximum.reduceat(c1, starts)))
            fan = FAN

    def near(self, node: int, least: int, num: int, den: int):
        """Leaf rows (from ``least`` on) that some row of a first-level node could link with."""
        import numpy as np

        qb, qlo, qhi, qex, q0, q1 = (x[node] for x in self.levels[1])
        nodes = np.arange(len(self.levels[-1][0]))
        for depth in range(len(self.levels) - 1, -1, -1):
            b, lo, hi, ex, c0, c1 = (x[nodes] for x in self.levels[depth])
            most = np.minimum(np.bitwise_count(b & qb).sum(axis=1) + np.minimum(ex, qex), np.minimum(hi, qhi))
            nodes = nodes[(most >= required(lo, qlo, num, den)) & ~((c0 == c1) & (q0 == q1) & (c0 == q0))]
            if depth:
                fan = LEAF if depth == 1 else FAN
                nodes = (nodes[:, None] * fan + np.arange(fan)).ravel()
                nodes = nodes[nodes < len(self.levels[depth - 1][0])]
        return nodes[nodes >= least]


def pairs_of(cid, size, pos, bits, before, comp, side, start: int, budget: int, num: int, den: int):
    """Pairs (a, b) of classes that may link, from row ``start`` on, and the row to go on from (None: done).

    Rows are sorted by (size, cid). With two sides only pairs across them count. ``before`` (rows x BEFORE, 0 for none) are
    n-grams in whose groups a row's class is too; a pair with a common one is found there.
    """
    import numpy as np

    m = len(cid)
    tree = Tree(size, bits, comp) if m > 2 * LEAF else None
    out_a, out_b, total, node, near = [], [], 0, -1, None
    for i in range(start, m - 1):
        if tree is None:
            js = np.arange(i + 1, m)
        else:
            if i // LEAF != node:
                node = i // LEAF
                near = tree.near(node, node * LEAF, num, den)
            js = near[np.searchsorted(near, i + 1) :]
        js = js[(comp[js] != comp[i]) & (side[js] | side[i] == 3)]
        if len(js):
            need = required(size[js], size[i], num, den)
            js = js[np.minimum(size[js] - pos[js], size[i] - pos[i]) >= need]
        if len(js):
            need = required(size[js], size[i], num, den)
            b = bits[js]
            most = np.minimum(size[js] - np.bitwise_count(b & ~bits[i]).sum(axis=1), size[i] - np.bitwise_count(bits[i] & ~b).sum(axis=1))
            js = js[most >= need]
        if len(js):
            own = before[i][before[i] != 0]
            js = js[~np.isin(before[js], own).any(axis=1)]
        if len(js):
            out_a.append(np.full(len(js), cid[i]))
            out_b.append(cid[js])
            total += len(js)
            if total >= budget and i + 1 < m - 1:
                return np.concatenate(out_a), np.concatenate(out_b), i + 1
    none = np.empty(0, np.int64)
    return (np.concatenate(out_a), np.concatenate(out_b), None) if out_a else (none, none, None)


def _candidates(groups: DataFrame, factor: int, num: int, den: int) -> DataFrame:
    """Rows (a, b) of pairs to verify, and rows (gram, i, j, next) of groups that go on.

    ``groups``: gram, i, j, side, cid, size, pos, bitmap, before, comp, start; a group's rows come together.
    """

    def run(batches):
        import numpy as np
        import pyarrow as pa

        names = ["a", "b", "gram", "i", "j", "next"]

        def emit(a, b, more):
            k = len(more)
            cols = [
                pa.concat_arrays([pa.array(a, pa.int64()), pa.nulls(k, pa.int64())]),
                pa.concat_arrays([pa.array(b, pa.int64()), pa.nulls(k, pa.int64())]),
                *(pa.concat_arrays([pa.nulls(len(a), t), pa.array([x[c] for x in more], t)]) for c, t in enumerate((pa.int64(), pa.int32(), pa.int32(), pa.int32()))),
            ]
            return pa.RecordBatch.from_arrays(cols, names)

        def work(cols, cuts):
            out_a, out_b, more = [], [], []
            gram, i, j, side, cid, size, pos, bits, before, comp, start = cols
            for x, y in zip(cuts, cuts[1:]):
                if y - x < 2 or comp[x] == comp[x + 1] and (comp[x:y] == comp[x]).all():
                    continue
                a, b, nxt = pairs_of(cid[x:y], size[x:y], pos[x:y], bits[x:y], before[x:y], comp[x:y], side[x:y], int(start[x]), max(3, factor * (y - x - 1)), num, den)
                if len(a):
                    out_a.append(a)
                    out_b.append(b)
                if nxt is not None:
                    more.append((int(gram[x]), int(i[x]), int(j[x]), nxt))
            none = np.empty(0, np.int64)
            return emit(np.concatenate(out_a) if out_a else none, np.concatenate(out_b) if out_b else none, more)

        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [c.to_numpy(zero_copy_only=False) for k, c in enumerate(batch.columns) if k not in (7, 8)]
            cols.insert(7, np.frombuffer(b"".join(batch.column(7).to_pylist()), ">u8").astype(np.uint64).reshape(-1, BITS // 64))
            cols.insert(8, batch.column(8).flatten().to_numpy().reshape(-1, BEFORE))
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols)]
            gram, i, j = cols[:3]
            cuts = np.flatnonzero((gram[1:] != gram[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
            if not len(cuts):
                held = cols
                continue
            yield work([c[: cuts[-1]] for c in cols], [0, *cuts.tolist()])
            held = [c[cuts[-1] :] for c in cols]
        if held is not None:
            yield work(held, [0, len(held[0])])

    return groups.mapInArrow(run, "a long, b long, gram long, i int, j int, next int")


def _verified(pairs: DataFrame, texts: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose whole sets link. Texts: cid, text."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        last, s = None, None
        for batch in batches:
            keep = []
            for k, (a, _, ta, tb) in enumerate(zip(*(c.to_pylist() for c in batch.columns))):
                if a != last:
                    last, s = a, gram_set(text_hashes(ta), n)
                t = gram_set(text_hashes(tb), n)
                both = len(np.intersect1d(s, t, assume_unique=True))
                if den * both >= num * (len(s) + len(t) - both):
                    keep.append(k)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int32())), batch.column(1).take(pa.array(keep, pa.int32()))], ["a", "b"])

    left = pairs.join(texts.select(F.col("cid").alias("a"), F.col("text").alias("ta")), "a")
    both = left.join(texts.select(F.col("cid").alias("b"), F.col("text").alias("tb")), "b")
    return both.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


@store.tidy
def jaccard_components(docs: DataFrame, n: int = WORDS, num: int = NUM, den: int = DEN) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``docs`` (doc_id, text).

    component_id is the smallest doc_id reached by links. Texts without words have an empty set and
    link with nothing. Rows that share a doc_id are one node, rows without doc_id are in no link and
    get a null component. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    parts = store.partitions(spark)
    docs = docs.select("doc_id", "text")
    levels = commonness(docs)
    own = store.written(fingerprints(docs, n, num, den, levels))
    sets = own.filter(F.col("cid").isNotNull() & F.col("doc_id").isNotNull())
    classes = store.written(sets.groupBy("cid").agg(F.min("doc_id").alias("rep"), F.min("size").alias("size"), F.first("bitmap").alias("bitmap")))
    reps = classes.select(F.col("rep").alias("doc_id"), "cid")
    first = sets.select("doc_id", "cid", "size", "grams").join(reps, ["doc_id", "cid"]).dropDuplicates(["cid"])
    rows = first.select("cid", "size", F.posexplode("grams").alias("pos", "gram"))
    shared = store.written(_shared(rows, parts, num, den))
    of_class = Window.partitionBy("cid").orderBy("pos")
    before = F.array(*[F.coalesce(F.lag("gram", k).over(of_class), F.lit(0).cast("long")) for k in range(1, BEFORE + 1)])
    groups = store.written(shared.join(classes.select("cid", "bitmap"), "cid").withColumn("before", before).withColumn("side", F.lit(3)).withColumn("start", F.lit(0)))
    store.dropped(shared)
    links = _search(groups, lambda nodes: _texts(docs, nodes, reps, n, levels), classes, parts, n, num, den)
    # a doc_id with several sets ties their classes together
    several = sets.join(classes.select("cid", "rep"), "cid").groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).filter(F.col("a") != F.col("b"))
    extra = sets.join(several.select("doc_id", "a"), "doc_id").join(classes.select("cid", "rep"), "cid").select("a", F.col("rep").alias("b"))
    edges = links.unionByName(extra)
    labels = components(edges)
    out = own.join(classes.select("cid", "rep"), "cid", "left").join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    return out.select("doc_id", F.col("size").alias("n_shingles"), F.coalesce("label", "rep", "doc_id").alias("component_id")).withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id")))


@store.tidy
def one_of_each(docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """``docs`` with one row of each component: the one with the smallest doc_id. Rows without doc_id stay, and so do all columns.

    Of several rows with that doc_id one stays, whichever.
    """
    found = store.written(jaccard_components(docs, n, num, den))
    gone = found.filter(F.col("component_id") != F.col("doc_id")).select("doc_id").distinct()
    kept = docs.join(F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone, "doc_id", "left_anti").select(docs.columns)
    if found.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").count().filter(F.col("count") > 1).isEmpty():
        return kept
    (alone,) = store.spare(docs.columns, "_alone")
    return kept.withColumn(alone, F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id())).dropDuplicates(["doc_id", alone]).drop(alone)


def _texts(docs: DataFrame, nodes: DataFrame, reps: DataFrame, n: int, levels) -> DataFrame:
    """cid, text of the representatives of these classes (cid)."""
    met = store.written(reps.join(nodes, "cid", "left_semi"))
    rows = docs.join(F.broadcast(met) if met.count() <= BROADCAST_ROWS else met, "doc_id")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            # a doc_id may have several texts
            keep = [k for k, (c, t) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())) if _fingerprint(np.unique(ordered_grams(text_hashes(t), n, levels))) == c]
            yield batch.take(pa.array(keep, pa.int32()))

    return store.written(rows.select("cid", "text").mapInArrow(run, "cid long, text string").dropDuplicates(["cid"]))


def _search(groups: DataFrame, texts_of, classes: DataFrame, parts: int, n: int, num: int, den: int) -> DataFrame:
    """Links (a, b) between class representatives, enough of them to connect every component."""
    spark = groups.sparkSession
    reps = classes.select("cid", "rep")
    links = spark.createDataFrame([], "a long, b long")
    blocks = groups
    crossed = False
    factor = 1
    for _ in range(ROUNDS):
        if links.isEmpty():
            labelled = groups.withColumn("comp", F.col("cid"))
        else:
            labels = store.written(components(links).join(reps, F.col("node") == F.col("rep")).select("cid", F.col("label").alias("_l")))
            labelled = groups.join(labels, "cid", "left").join(reps, "cid").withColumn("comp", F.coalesce("_l", "rep"))
        cols = ["gram", "i", "j", "side", "cid", "size", "pos", "bitmap", "before", "comp", "start"]
        together = labelled.select(cols).repartition(parts, "gram", "i", "j").sortWithinPartitions("gram", "i", "j", "size", "cid")
        found = store.written(_candidates(together, factor, num, den))
        pairs = found.filter(F.col("a").isNotNull()).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        texts = texts_of(pairs.select(F.col("a").alias("cid")).unionByName(pairs.select(F.col("b").alias("cid"))).distinct())
        new = _verified(pairs, texts, n, num, den)
        named = new.join(reps.select(F.col("cid").alias("a"), F.col("rep").alias("ra")), "a").join(reps.select(F.col("cid").alias("b"), F.col("rep").alias("rb")), "b")
        links = store.written(links.unionByName(named.select(F.col("ra").alias("a"), F.col("rb").alias("b"))))
        store.dropped(texts)
        more = found.filter(F.col("gram").isNotNull()).select("gram", "i", "j", F.col("next").alias("start"))
        if more.isEmpty():
            if crossed:
                break
            crossed = True
            # blocks of one n-gram, two by two
            ids = blocks.select("gram", "i").distinct()
            others = ids.select("gram", F.col("i").alias("k"))
            two = ids.join(others, "gram").filter(F.col("i") < F.col("k"))
            if two.isEmpty():
                break
            a = two.join(blocks, ["gram", "i"]).select("gram", "i", F.col("k").alias("j"), F.lit(1).alias("side"), "cid", "size", "pos", "bitmap", "before", F.lit(0).alias("start"))
            b = two.withColumnRenamed("i", "_i").withColumnRenamed("k", "i").join(blocks, ["gram", "i"]).select("gram", F.col("_i").alias("i"), F.col("i").alias("j"), F.lit(2).alias("side"), "cid", "size", "pos", "bitmap", "before", F.lit(0).alias("start"))
            groups, factor = store.written(a.unionByName(b)), 1
            continue
        groups = store.written(groups.drop("start").join(more, ["gram", "i", "j"]))
        factor *= 8
    else:
        raise RuntimeError("groups are left")
    return links


def op7_signature_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP7_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' '))) END AS g FROM w
), c AS (
  SELECT doc_id, len(g)::BIGINT AS n_shingles, g FROM s
), t AS (
  SELECT DISTINCT doc_id, unnest(g) AS g FROM c
), p AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM t x JOIN t y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL
), e AS (
  SELECT a, b FROM p JOIN c ca ON ca.doc_id = a JOIN c cb ON cb.doc_id = b WHERE 100 * k >= 85 * (ca.n_shingles + cb.n_shingles - k)
), u AS (
  SELECT a, b FROM e UNION SELECT b, a FROM e
), r AS (
  SELECT doc_id, doc_id AS reach FROM c
  UNION
  SELECT r.doc_id, u.b FROM r JOIN u ON r.reach = u.a
)
SELECT c.doc_id, c.n_shingles, min(r.reach) AS component_id FROM c JOIN r ON r.doc_id = c.doc_id GROUP BY c.doc_id, c.n_shingles
"""
