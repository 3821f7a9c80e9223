"""The pipeline on the smallest tables, each stage against its operator's rule."""

import random
from collections import Counter

import corpus_pipeline as P
from faultline.llm import quality, tiling
from faultline.llm.words import words
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_stages_keep_and_drop(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = docs.count()
    for name, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == P.COLUMNS
        assert 0.6 * seen <= docs.count() <= seen, name
        seen = docs.count()
    packed = P.STAGES[-1][1](spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 1024").isEmpty()


def test_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("false")
    for _, stage in P.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0


def prose(n, seed):
    rng = random.Random(seed)
    return " ".join("".join(rng.choices("abcdefghijklmnopqrst", k=rng.randint(3, 8))) for _ in range(n))


def junk(n, seed):
    return " | ".join(prose(n, seed).split())


def planted(folder, spark):
    """Clean and junk documents, near copies, copies, shared lines and leaks, with labels and a benchmark."""
    base, item = prose(90, 1), prose(40, 2)
    near = base.split()
    near[45] = "changed"
    rows = [(k, (prose if k % 3 else junk)(60, 100 + k)) for k in range(240)]
    rows += [(300, base), (301, " ".join(near)), (302, base), (303, prose(90, 3))]
    rows += [(310 + k, f"One Shared Header Line\n{prose(40, 400 + k)}\n  one shared header line\nshort\n{prose(30, 500 + k)}") for k in range(5)]
    rows += [(320, prose(20, 600) + " " + item + " " + prose(20, 601)), (321, " ".join([*item.split()[20:], *prose(9, 7).split(), *item.split()[:20]])), (322, " ".join(item.split()[:20]) + " " + prose(30, 8))]
    rows += [(330, None), (331, "")]
    spark.createDataFrame([(i, t, "en", "web", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(k, int(k % 3 > 0), 0) for k in range(240)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item), (2, prose(40, 9)), (3, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return dict(rows), item


def brute_lines(docs):
    norm = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    owner = {}
    for i, t in sorted(docs.items()):
        for x in (t or "").split("\n"):
            owner.setdefault(norm(x), i)
    return {i: "\n".join(x for x in (t or "").split("\n") if len(norm(x)) < 10 or owner[norm(x)] == i) for i, t in docs.items()}


def brute_near(docs):
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()} for i, w in ((i, words(t)) for i, t in docs.items())}
    group = {i: i for i in sets}
    linked = [(i, j) for i in sets for j in sets if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    for _ in sets:
        for i, j in linked:
            group[i] = group[j] = min(group[i], group[j])
    return {i: t for i, t in docs.items() if group[i] == i}


def longest_cover(doc, item, least=5):
    """Words of ``item`` that greedy tiles cover, longest run first, by trying all places."""
    a, b = words(doc), words(item)
    free_a, free_b, covered = [True] * len(a), [True] * len(b), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and free_a[i + n] and free_b[j + n] and a[i + n] == b[j + n]:
                    n += 1
                best = max(best, (n, -i, -j))
        n, i, j = best[0], -best[1], -best[2]
        if n < least:
            return covered
        free_a[i : i + n] = free_b[j : j + n] = [False] * n
        covered += n


def test_run_equals_brute_force(spark, tmp_path):
    folder = f"file://{tmp_path}"
    docs, item = planted(folder, spark)
    table = spark.read.parquet(f"{folder}/documents.parquet")
    model = quality.train(table, spark.read.parquet(f"{folder}/labels.parquet"))
    ids = list(docs)
    want = [{i: docs[i] for i, p in zip(ids, model.score([(docs[i] or "").encode() for i in ids])) if p >= 0.5}]
    assert {300, 301, 302, 303, 310, 314, 320, 321, 322} <= want[0].keys() and 160 > sum(i < 240 for i in want[0]) - 10
    want.append(brute_lines(want[0]))
    want.append(brute_near(want[1]))
    bench = [t for (t,) in spark.read.parquet(f"{folder}/benchmark.parquet").select("text").collect() if t]
    share = tiling.COVERAGE
    want.append({i: t for i, t in want[2].items() if not any(longest_cover(t, x) >= share * len(words(x)) for x in bench)})
    assert 301 not in want[2] and 300 in want[2] and want[1][302] == ""  # a copy of one line loses it
    assert want[2].keys() - want[3].keys() == {320, 321}
    got = table
    for (name, stage), rows in zip(P.STAGES[:-1], want):
        got = stage(spark, got, folder).cache()
        assert {r.doc_id: r.text for r in got.collect()} == rows, name
        assert got.count() == len(rows), name
    pieces = P.STAGES[-1][1](spark, got, folder).collect()
    run = P.run(spark, folder).collect()
    key = lambda rows: Counter((r.doc_id, r.piece, r.start, r.length) for r in rows)
    assert key(run) == key(pieces) and {r.doc_id for r in run} == want[3].keys()
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(P.vocabulary("byte_bpe_50k.json"))
    tokens = Counter()
    for r in run:
        tokens[r.doc_id] += r.length
    assert tokens == {i: len(lib.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in want[3].items()}
