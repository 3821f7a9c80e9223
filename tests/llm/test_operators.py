"""Edge cases and brute-force checks of the training-data operators."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from faultline.llm import avi, fmindex, html_crf, lines, packing, quality, ring, sigtree, sstable, store, tiling, tokens
from faultline.llm.components import components
from faultline.llm.tokens import Encoder, vocabulary
from faultline.llm.words import words

RNG = random.Random(5)
VOCAB = ["".join(RNG.choices("abcdefghijklmnopqrst", k=RNG.randint(2, 7))) for _ in range(400)]


def prose(n, seed):
    return " ".join(random.Random(seed).choices(VOCAB, k=n))


def make_docs():
    base = prose(120, 1)
    near = base.split()
    near[60] = "changed"
    passage = prose(60, 2)
    long = prose(9000, 3)
    rows = [(0, base), (1, base), (2, " ".join(near)), (3, None), (4, ""), (5, " \n\t "), (6, "one two"), (7, "one two"), (8, long)]
    rows += [(10 + k, prose(30, 50 + k) + " " + passage + " " + prose(20, 90 + k)) for k in range(6)]
    rows += [(20 + k, "A Shared Header Line\n" + prose(15, 200 + k) + "\n  a shared header line \nshort\n" + prose(12, 300 + k)) for k in range(6)]
    rows += [(30, base), (30, base), (None, base), (None, prose(50, 7))]
    return rows


DOCS = make_docs()
SCHEMA = "doc_id long, text string, _t string, score double, sequence_id int, media string"


@pytest.fixture(scope="module")
def docs(spark):
    # extra columns whose names clash with the operators' own
    return spark.createDataFrame([(i, t, "x", 0.5, 1, "m") for i, t in DOCS], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def key(i):
    return (i is not None, i or 0)


@pytest.mark.parametrize("name,kind,end", [("word_bpe_49k.json", "word", 1), ("byte_bpe_50k.json", "byte", 2)])
def test_encoder_equals_the_library(name, kind, end):
    enc = Encoder(vocabulary(name), kind, end)
    odd = ["don't stop", "it's  x'll a's,", "é x", "Ａ b", "ΑΒΣ abcΣ", "a_b c123d 12,3", "  lead", "trail ", "a\n\nb", " \n x", "x\ty", " nb a b", "İst ŁÓ", "", None, "<|endoftext|> hi", "a\0b c", "'s 's't", "ab'cd','ef", "x\x1cy z\x85w", "日本 語abc", "a≠b", "\r\n a\r\nb", "a?'s 9's"]
    for t, got in zip(odd + [t for _, t in DOCS], enc.encode(odd + [t for _, t in DOCS])):
        assert got == np.array([*enc.lib.encode(t or "", add_special_tokens=False).ids, end], "<u4").tobytes(), t


@pytest.mark.parametrize("name,kind", [("word_bpe_49k.json", "word"), ("byte_bpe_50k.json", "byte")])
def test_added_tokens_as_the_plain_library_call_gives_them(name, kind):
    from tokenizers import Tokenizer

    enc, lib = Encoder(vocabulary(name), kind), Tokenizer.from_file(vocabulary(name))
    texts = ["foo <|endoftext|> bar", "<|endoftext|>", "a<|endoftext|>b\nc", "<|startoftext|>x y<|endoftext|>", "<|ENDOFTEXT|> a", "<|end oftext|>", "plain text", None]
    for t, got in zip(texts, enc.encode(texts)):
        assert got == np.array(lib.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes(), t
    end = lib.token_to_id("<|endoftext|>")
    assert end in np.frombuffer(enc.encode(texts)[0], "<u4")


def test_op1_shards(spark, docs, empty):
    folder, manifest = sstable.write_shards(docs, vocabulary("word_bpe_49k.json"), "word", 1, shards=3, shard_bytes=2000)
    got = sorted(sstable.read_shards(spark, folder, manifest).collect(), key=lambda r: (r.start, r.n_tokens))
    assert [r.doc_id for r in got] == sorted((i for i, _ in DOCS), key=key)
    at = 0
    for r in got:
        assert (r.start, r.ids_crc32, len(r.ids)) == (at, zlib.crc32(r.ids), 4 * r.n_tokens)
        at += r.n_tokens
    assert manifest.count() > 3
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    want = Counter((i, np.array([*lib.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes()) for i, t in DOCS)
    assert Counter((r.doc_id, bytes(r.ids)) for r in got) == want
    assert [x.tolist() for x in sstable.lookup(folder, manifest, 4)] == [[1]]
    assert len(sstable.lookup(folder, manifest, 30)) == 2 and len(sstable.lookup(folder, manifest, None)) == 2
    assert sstable.lookup(folder, manifest, 12345) == [] and sstable.lookup(folder, manifest, 9) == []
    (long,) = [x.tobytes() for x in sstable.lookup(folder, manifest, 8)]
    assert want[8, long] == 1
    folder, manifest = sstable.write_shards(empty, vocabulary("word_bpe_49k.json"), "word", 1)
    assert sstable.read_shards(spark, folder, manifest).count() == 0 and sstable.lookup(folder, manifest, 1) == []


def test_op1_lookup_reads_ranges(tmp_path):
    from pyarrow import fs

    w = sstable.Writer()
    for k in range(4000):
        w.add(3 * k, np.random.default_rng(k).integers(0, 1 << 16, 200).astype("<u4").tobytes())
    data = w.finish()
    (tmp_path / "x.sst").write_bytes(data)
    with fs.LocalFileSystem().open_input_file(str(tmp_path / "x.sst")) as f:
        r = sstable.Reader(f)
        assert r.get(3 * 777)[0].tolist() == np.random.default_rng(777).integers(0, 1 << 16, 200).tolist()
        assert r.get(3 * 777 + 1) == [] and r.asked < 0.15 * len(data)


def test_op2_media_is_lossless(spark, docs, empty):
    for p in (b"a" * 64, bytes(range(256)) * 40, bytes(random.Random(1).randbytes(64 * 99)), b"\xff" * 64 * 17, b"\0" * 64):
        ((head, frames),) = avi.decode(avi.encode([p], [len(p)]))
        assert frames.tobytes()[: head["payload_bytes"]] == p
    media = avi.to_media(docs)
    want = {(i, hashlib.sha256(avi._payload(t)[0]).hexdigest()) for i, t in DOCS}
    got = avi.digests(media).collect()
    assert {(r.doc_id, r.payload_sha256) for r in got} == want and len(got) == len(DOCS)
    assert {r.media_bytes for r in got if r.doc_id in (3, 4)} == {len(avi.encode([b"\0" * 64], [0])[0])}
    flat, busy = np.zeros((4, avi.FRAME), np.uint8), np.full((4, avi.FRAME), 200, np.uint8)
    assert avi.shots(np.concatenate([flat, busy]))[0] == [0, 4]
    clips = avi.clips(media).groupBy("doc_id").count().count()
    assert clips == len({i for i, _ in DOCS})
    assert avi.digests(avi.to_media(empty)).count() == 0


def brute_repeats(rows, window):
    ws = [words(t, lower=False) for _, t in rows]
    seen = Counter(tuple(w[s : s + window]) for w in ws for s in range(len(w) - window + 1))
    out = []
    for (i, _), w in zip(rows, ws):
        gone = {k for s in range(len(w) - window + 1) if seen[tuple(w[s : s + window])] > 1 for k in range(s, s + window)}
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=lambda r: (key(r[0]), r[1:]))


@pytest.mark.parametrize("limit", [20_000, 1])
def test_op3_equals_brute_force(spark, docs, empty, limit):
    def run(d):
        rows, covered = fmindex.find_repeats(d, owner_segments=limit)
        j = rows.join(covered.select("cid", "n_removed", F.col("sha").alias("s")), "cid", "left")
        return sorted([(r[0], r[1], r[2], r[3]) for r in j.select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0)), F.coalesce("s", "sha")).collect()], key=lambda r: (key(r[0]), r[1:]))

    assert run(docs) == brute_repeats(DOCS, 35)
    assert run(empty) == []


def test_op3_removal_with_repeated_and_null_ids(spark):
    shared, alone = prose(40, 31), [prose(60, 32 + k) for k in range(4)]
    rows = [(None, "a " + shared + " b"), (None, alone[0]), (1, "c " + shared + " d"), (1, alone[1]), (None, alone[2]), (2, shared), (None, None), (3, alone[3] + "\n  tail ")]
    table = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, row int")
    got = fmindex.remove_repeats(table)
    assert got.columns == table.columns
    want = ["a b", alone[0], "c d", alone[1], alone[2], "", None, alone[3] + "\n  tail "]
    assert [(r.doc_id, r.text) for r in got.orderBy("row").collect()] == [(i, t) for (i, _), t in zip(rows, want)]


@pytest.mark.parametrize("window", [35, 100])
def test_op3_intervals_and_long_windows(spark, window):
    shared = prose(130, 31)
    rows = [(1, "a b " + shared + " c"), (2, shared + " d"), (3, prose(200, 5)), (4, None), (4, "e " + shared), (5, prose(80, 6) + " " + shared + " x y " + shared)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.start, r.n_words) for r in fmindex.intervals(table, window).collect())
    assert got == [(1, 2, 130), (2, 0, 130), (4, 1, 130), (5, 80, 130), (5, 212, 130)]
    found, covered = fmindex.find_repeats(table, window)
    lost = {r.cid: r.n_removed for r in covered.collect()}
    assert sorted((r.doc_id, r.n_words, lost.get(r.cid, 0)) for r in found.collect()) == [x[:3] for x in brute_repeats(rows, window)]


def test_op3_bit_vectors():
    rng = np.random.default_rng(6)
    for n in (1, 63, 64, 65, 5000):
        for bit in (rng.random(n) < 0.5, np.zeros(n, bool), np.ones(n, bool), np.repeat(rng.random(n) < 0.5, 100)[:n]):
            v, at = fmindex.Bits(bit), np.arange(n + 1)
            assert v.rank(at).tolist() == np.concatenate([[0], np.cumsum(bit)]).tolist()
    # an index is smaller than the text that it holds
    text = [" ".join(rng.choice(VOCAB, 60)).encode().split() for _ in range(200)]
    index = fmindex.FmIndex(np.concatenate([[*rng.integers(1, 400, len(t)), 0] for t in text]), 60)
    assert sum(b.bytes for _, b, _ in index.levels) < 0.5 * sum(len(w) + 1 for t in text for w in t)


def test_op3_random_sequences():
    rng = random.Random(9)
    for _ in range(30):
        segs = [[rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randint(5, 12))] for _ in range(rng.randint(2, 12))]
        seen = Counter(tuple(s[k : k + 5]) for s in segs for k in range(len(s) - 4))
        got = fmindex.repeated_windows(segs, [1] * len(segs), window=5)
        assert got == [sum(1 << k for k in range(len(s) - 4) if seen[tuple(s[k : k + 5])] > 1) for s in segs]


def test_op4_learns_and_takes_odd_rows(spark, docs, empty):
    texts = [(k, prose(60, 1000 + k) if k % 4 else " | ".join(prose(60, 1000 + k).split())) for k in range(240)]
    table = spark.createDataFrame([*texts, (9999, None)], "doc_id long, text string")
    labels = spark.createDataFrame([*((k, int(k % 4 > 0)) for k, _ in texts), (None, 1), (3, None)], "doc_id long, quality int")
    model = quality.train(table, labels)
    rows = quality.score(table, model).withColumn("held", quality.held_out(F.col("doc_id"))).collect()
    held = [r for r in rows if r.held and r.doc_id < 240]
    assert sum((r.score >= 0.5) == (r.doc_id % 4 > 0) for r in held) >= 0.95 * len(held)
    got = quality.score(docs, model).collect()
    assert len(got) == len(DOCS) and all(0 <= r.score <= 1 for r in got) and got[0]._t == "x"
    assert quality.score(empty, model).count() == 0
    none = quality.train(table, labels.filter("false"))
    assert {r.score for r in quality.score(docs, none).collect()} == {0.5}


def test_op4_scores_equal_a_plain_network():
    import math

    rng = np.random.default_rng(2)
    net = quality.ByteCnn()
    net.p |= {"w": rng.normal(0, 1, 3 * quality.FILTERS).astype(np.float32), "c": np.array([0.2], np.float32)}
    t, b = net.p["t"].astype(float), net.p["b"].astype(float)
    texts = [b"", b"abc", bytes(rng.integers(0, 256, 128).tolist()), bytes(rng.integers(97, 123, 700).tolist())]
    for text, got in zip(texts, net.score(texts)):
        n = max(1, -(-len(text) // quality.BLOCK))
        places = [sum(t[j][text[i + j]] for j in range(quality.SPAN) if i + j < len(text)) for i in range(len(text))]
        chunks = []
        for k in range(n):
            inside = places[k * quality.BLOCK : (k + 2) * quality.BLOCK]
            chunks.append(np.tanh((np.max(inside, axis=0) if inside else np.full(quality.FILTERS, -30.0)) + b))
        f = np.concatenate([np.mean(chunks, axis=0), np.max(chunks, axis=0), np.min(chunks, axis=0)])
        assert got == pytest.approx(1 / (1 + math.exp(-(f @ net.p["w"] + 0.2))), abs=1e-4)


def test_op4_learns_from_whole_texts_of_a_bounded_sample(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality.ByteCnn, "fit", lambda self, texts, labels: seen.append((texts, labels)) or self)
    long = prose(2000, 1) + " the end"
    rows = [(k, long if k == 0 else prose(20, k)) for k in range(40)] + [(0, "another text of row 0")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, quality int")
    quality.train(docs, labels)
    (texts, got), known = seen[0], [k for k in range(40) if zlib.crc32(str(k).encode()) % 3 != 1]
    assert len(texts) == len(known) == len(got)
    assert set(texts) <= {t.encode() for _, t in rows} and {t for t in texts if len(t) > 9000} <= {long.encode()}
    quality.train(docs, labels, sample_chars=500)
    assert 0 < len(seen[1][0]) < len(known) and sum(map(len, seen[1][0])) <= 500
    quality.train(docs, labels, sample=3)
    assert len(seen[2][0]) == 3


def brute_coverage(doc, item, least=5):
    """Greedy string tiling by definition: the longest common run of unmarked words first, the leftmost of equals."""
    a, b = doc.split(), item.split()
    free_a, free_b, covered = [True] * len(a), [True] * len(b), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and free_a[i + n] and free_b[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < least:
            return covered
        for k in range(n):
            free_a[i + k] = free_b[j + k] = False
        covered += n


def test_op5_covers_what_greedy_tiling_by_definition_covers():
    rng = random.Random(12)
    for n in range(80):
        item = " ".join(rng.choices(VOCAB[: rng.choice((4, 30, 400))], k=rng.randint(5, 40)))
        w = item.split()
        cut = rng.randint(0, len(w))
        doc = " ".join([*prose(rng.randint(0, 9), n).split(), *w[cut:], *prose(rng.randint(0, 3), n + 99).split(), *w[:cut]] + (w[:7] if n % 3 else []))
        ((_, _, got, size, _),) = list(tiling.Index([(1, item)], 5).scan(doc, 0.0)) or [(0, 0, 0, len(w), 0)]
        assert (size, got) == (len(w), brute_coverage(doc, item)), (doc, item)
    one = tiling.Index([(1, " ".join(["the"] * 200))], 5)
    assert list(one.scan(" ".join(["the"] * 5000), 0.8)) == [(1, 1, 200, 200, 1.0)]


def test_clashing_columns_stay_or_are_replaced(spark):
    rows = [(k, prose(30, k) + "\nA Shared Header Line here\n" + prose(5, k), 40 + k) for k in range(4)]
    own = {"_t": "x", "_d": 1, "_u": 2, "gone": 3, "_h": 4, "_cell": 5, "_home": 6, "_salt": 7, "_rank": 8, "_from": 9, "_to": 10, "_slot": 11, "_bin": 12, "_fill": 13, "_into": 14, "_at": 15, "bin": 16, "_alone": 17, "_leak": 18, "_cid": 19, "_kept": 20, "cid": 21}
    docs = spark.createDataFrame(rows, "doc_id long, text string, length long")
    for name, value in own.items():
        docs = docs.withColumn(name, F.lit(value))
    lost = ["media", "shard", "slot", "offset", "sequence_id", "n_lines", "n_dropped", "score"]
    for name in lost:
        docs = docs.withColumn(name, F.lit(-1))
    bench = spark.createDataFrame([(1, prose(12, 777))], "item_id long, text string")
    for f, made in [
        (avi.to_media, ["media"]), (lambda d: ring.shard_rows(d, shards=2), ["shard", "slot"]), (lambda d: ring.shard_rows(d, shards=2, unit_rows=1), ["shard", "slot"]), (lambda d: ring.shard_keys(d, shards=2), ["shard"]),
        (lambda d: packing.pack(store.written(d), 64), ["sequence_id", "offset"]), (lines.dedup_lines, ["n_lines", "n_dropped"]), (lambda d: sigtree.one_of_each(d, 5, 80, 100), []),
        (lambda d: quality.score(d, quality.ByteCnn()), ["score"]), (lambda d: tiling.decontaminate(d, bench), []), (lambda d: tiling.decontaminate(d, bench, broadcast_chars=0), []),
        (fmindex.remove_repeats, []),
    ]:
        got = f(docs)
        assert sorted(got.columns) == sorted(docs.columns)
        kept = got.collect()
        assert sorted(r.doc_id for r in kept) == [0, 1, 2, 3]
        assert all(r[n] == v for r in kept for n, v in own.items())
        assert all(r[n] == -1 for r in kept for n in lost if n not in made) and all(r[n] != -1 for r in kept for n in made)


def test_tables_of_an_operator_are_deleted(spark, docs):
    before = set(store._made)
    out = sigtree.jaccard_components(docs)
    left = set(store._made) - before
    assert out.count() == len(DOCS) and 0 < len(left) <= 6
    store.release(out)
    assert not set(store._made) - before
    before = set(store._made)
    out = lines.dedup_lines(docs)
    assert out.count() == len(DOCS)
    store.release(out)
    assert not set(store._made) - before


def test_op7_family_just_below_the_threshold(spark):
    base, rows = prose(100, 4).split(), []
    for k in range(120):  # 97 shingles; two changed words, far apart, cost 8 of them, so two members share at most 81 of 113
        w = list(base)
        for p in (20 + k % 7 * 5, 70 + k % 5 * 5):
            w[p] = f"edit{k}x{p}"
        rows.append((k, " ".join(w)))
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, sigtree.jaccard_components(table, 4, 85, 100).collect()))
    assert got == brute_components(rows, 4, 85, 100) and len({c for *_, c in got}) > 100


def test_op5_tiles_reordered_passages(spark, docs, empty):
    item = prose(40, 77).split()
    swapped = " ".join([*prose(30, 5).split(), *item[20:], *prose(3, 6).split(), *item[:20]])
    bench = spark.createDataFrame([(1, " ".join(item)), (2, None), (3, ""), (4, "one two"), (5, prose(30, 888))], "item_id long, text string")
    rows = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(500, swapped), (501, " ".join(item[:20]))], "doc_id long, text string"))
    want = [(6, 4, 1), (7, 4, 1), (500, 1, 2)]
    for limit in (tiling.BROADCAST_CHARS, 0):
        got = tiling.leaks(rows, bench, broadcast_chars=limit).select("doc_id", "item_id", "n_tiles").collect()
        assert sorted(map(tuple, got)) == want
        kept = {r[0] for r in tiling.decontaminate(rows, bench, broadcast_chars=limit).select("doc_id").collect()}
        assert kept == ({i for i, _ in DOCS} | {501}) - {6, 7, 500}
    assert tiling.leaks(empty, bench).count() == 0 and tiling.leaks(rows, bench.filter("false")).count() == 0


@pytest.mark.parametrize("limit", [tiling.BROADCAST_CHARS, 0])
def test_op5_rows_with_repeated_and_null_ids(spark, limit):
    items = [prose(40, 700 + k) for k in range(4)]
    bench = spark.createDataFrame([(1, items[0]), (1, items[1]), (None, items[2]), (None, items[3]), (2, items[0])], "item_id long, text string")
    leak = [prose(10, 800 + k) + " " + t + " " + prose(10, 900 + k) for k, t in enumerate(items)]
    rows = [(5, leak[0]), (5, prose(50, 1)), (6, leak[1]), (None, leak[2]), (None, prose(50, 2)), (7, leak[3]), (8, None), (None, None), (6, leak[1])]
    table = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, row int")
    got = Counter((r.doc_id, r.item_id, r.covered) for r in tiling.leaks(table, bench, broadcast_chars=limit).collect())
    assert got == Counter({(5, 1, 40): 1, (5, 2, 40): 1, (6, 1, 40): 2, (None, None, 40): 1, (7, None, 40): 1})
    kept = tiling.decontaminate(table, bench, broadcast_chars=limit)
    assert kept.columns == table.columns and sorted(r.row for r in kept.collect()) == [1, 4, 6, 7]


@pytest.mark.parametrize("batches,fan_in", [(1, 4), (3, 2), (5, 2)])
def test_op6_equals_brute_force(docs, empty, batches, fan_in):
    owner, held = {}, {}
    split = lambda t: (t or "").split("\n")
    norm = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    for i, t in DOCS:
        for k in map(norm, split(t)):
            held.setdefault(k, set()).add(i)
            if i is not None:
                owner[k] = min(owner.get(k, i), i)
    want = []
    for i, t in DOCS:
        keep = [x for x in split(t) if len(norm(x)) < 10 or len(held[norm(x)]) < 2 or owner.get(norm(x), i) == i]
        want.append((i, len(split(t)), len(split(t)) - len(keep), "\n".join(keep)))
    got = [(r.doc_id, r.n_lines, r.n_dropped, r.text) for r in lines.dedup_lines(docs, batches=batches, fan_in=fan_in).collect()]
    order = lambda r: (key(r[0]), r[1:])
    assert sorted(got, key=order) == sorted(want, key=order)
    assert lines.dedup_lines(empty).count() == 0


def brute_components(rows, n, num, den):
    sets = [(i, {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} - {()}) for i, w in ((i, words(t)) for i, t in rows)]
    up = {i: i for i, _ in sets if i is not None}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for x, (i, a) in enumerate(sets):
        for j, b in sets[:x]:
            if i is not None and j is not None and a and b and den * len(a & b) >= num * len(a | b):
                p, q = find(i), find(j)
                up[max(p, q)] = min(p, q)
    return sorted(((i, len(s), None if i is None else find(i)) for i, s in sets), key=lambda r: (key(r[0]), r[1]))


@pytest.mark.parametrize("n,num,den,group", [(4, 85, 100, 20_000), (5, 80, 100, 20_000), (2, 60, 100, 4)])
def test_op7_equals_brute_force(spark, docs, empty, monkeypatch, n, num, den, group):
    monkeypatch.setattr(sigtree, "GROUP", group)
    rows = list(DOCS)
    base = prose(80, 4).split()
    for k in range(70):  # a family of near copies, some of them further apart
        w = list(base)
        for p in random.Random(k).sample(range(80), k % 6):
            w[p] = f"edit{k}x{p}"
        rows.append((100 + k, " ".join(w)))
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, sigtree.jaccard_components(table, n, num, den).collect()), key=lambda r: (key(r[0]), r[1]))
    assert got == brute_components(rows, n, num, den)
    if group == 20_000 and n == 4:
        assert sigtree.jaccard_components(empty).count() == 0
        kept = sigtree.one_of_each(table, n, num, den).select("doc_id").collect()
        want = Counter({c for i, _, c in brute_components(rows, n, num, den) if i is not None})
        want[None] = sum(i is None for i, _ in rows)
        assert Counter(r[0] for r in kept) == want


def test_components_of_chains_and_stars(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 30)] + [(7, 7)]
    got = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert got == {**{k: 0 for k in range(41)}, **{100 + k: 100 for k in range(30)}}


@pytest.mark.parametrize("capacity", [32, 1024])
def test_op8_places_every_token_once(spark, docs, empty, capacity):
    path = vocabulary("byte_bpe_50k.json")
    placed = packing.pack_documents(docs, path, capacity=capacity).collect()
    enc = Encoder(path, "byte", 2)
    want = Counter((i, len(x) // 4) for (i, _), x in zip(DOCS, enc.encode([t for _, t in DOCS])))
    assert sum(r.length for r in placed) == sum(n * c for (_, n), c in want.items())
    assert all(0 < r.length <= capacity for r in placed)
    assert all(r.piece == 0 or r.length == capacity for r in placed)
    by = {}
    for r in placed:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in by.values():
        at = 0
        for o, n in sorted(spans):
            assert o == at
            at += n
        assert at <= capacity
    assert len(by) <= len(packing.best_fit([r.length for r in placed], capacity)[2]) + 1
    assert packing.pack_documents(empty, path).count() == 0


def test_op8_sequences_hold_the_ids(spark):
    path = vocabulary("byte_bpe_50k.json")
    table = spark.createDataFrame([(k, prose(40 + 13 * k, k)) for k in range(20)], "doc_id long, text string")
    placed = store.written(packing.pack_documents(table, path, capacity=128))
    enc = Encoder(path, "byte", 2)
    ids = {k: x for k, x in enumerate(enc.encode([prose(40 + 13 * k, k) for k in range(20)]))}
    seqs = {r.sequence_id: bytes(r.ids) for r in packing.sequences(table, placed, path, capacity=128).collect()}
    for r in placed.collect():
        assert seqs[r.sequence_id][4 * r.offset : 4 * (r.offset + r.length)] == ids[r.doc_id][4 * r.start : 4 * (r.start + r.length)]


def test_op9_held_out_pages_and_odd_rows(spark):
    crf, wrong, total = html_crf.model(), 0, 0
    for page, labels in html_crf.labelled_pages(150, 4242):
        rows = html_crf.features(page)
        got = crf.viterbi(crf.scores(rows))
        wrong += sum(a != b for a, b in zip(got, labels))
        total += len(labels)
    assert wrong < 0.02 * total
    page = "<html><head><title>t</title></head><body><nav><ul><li><a href=x>Menu</a></ul></nav><article><h1>Head</h1><p>One &amp; <b>two</b>.<br>Three.<p>Four<script>var a='</p>'</script></article><footer>&copy; x</footer>"
    table = spark.createDataFrame([(1, "u", page, 3), (2, None, None, 3), (3, "u", "", 3), (None, "u", page, 3)], "page_id long, url string, html string, text int")
    got = {r.page_id: (r.text, r.n_chars) for r in html_crf.extract(table).collect()}
    want = "Head One & two. Three. Four"
    assert got == {1: (want, len(want)), 2: ("", 0), 3: ("", 0), None: (want, len(want))}
    assert html_crf.extract(table.filter("false")).count() == 0


#: Pages in layouts that the trainer's generator does not make, each with the text of its article.
LAYOUTS = {
    "table": ("<html><body><table><tr><td class='left-menu'><a href=/a>Home</a><br><a href=/b>News</a><br><a href=/c>About us</a></td><td class='content'><h2>River floods again</h2>"
              "<p>The river rose by two metres on Monday. Many roads were closed, and trains stopped running.</p><p>Officials said that the water would fall by the weekend.</p></td></tr>"
              "<tr><td colspan=2 class=footer>Copyright 2019 The Paper. All rights reserved.</td></tr></table></body></html>",
              "River floods again The river rose by two metres on Monday. Many roads were closed, and trains stopped running. Officials said that the water would fall by the weekend."),
    "wiki": ("<body><div id=mw-navigation><ul class=menu><li><a href=/m>Main page</a><li><a href=/r>Random page</a></ul></div><div id=content><h1>Granite</h1><div class=mw-parser-output>"
             "<p><b>Granite</b> is a coarse-grained <a href=/ig>igneous rock</a> composed mostly of quartz, alkali feldspar, and plagioclase.</p><h2>Uses</h2><p>It is used as a building stone&mdash;and for floors.</p>"
             "<ul><li>Kerbs and steps in many old towns of the north.</li><li>Tombstones, which last for centuries.</li></ul></div></div><footer id=footer><ul><li><a href=/p>Privacy policy</a></li></ul></footer></body>",
             "Granite Granite is a coarse-grained igneous rock composed mostly of quartz, alkali feldspar, and plagioclase. Uses It is used as a building stone\u2014and for floors. "
             "Kerbs and steps in many old towns of the north. Tombstones, which last for centuries."),
    "divs": ("<body><div class='top-nav'><div class=navitem><a href=1>Shop</a></div><div class=navitem><a href=2>Blog</a></div></div><div><div class='cookie-notice'><div>We use cookies to improve your visit.</div></div>"
             "<div class='post-body'><div><div>How to bake bread at home</div><div>Mix flour, water and salt. Wait for an hour. Then knead it well.</div><div>Bake it for forty minutes, until the crust is brown.</div></div></div>"
             "<div class='comments'><div class=comment><div>Great recipe, thanks a lot for it!</div></div></div></div></body>",
             "How to bake bread at home Mix flour, water and salt. Wait for an hour. Then knead it well. Bake it for forty minutes, until the crust is brown."),
    "news": ("<body><header role=banner><p>The Daily Globe</p></header><nav><a href=/w>World</a> <a href=/s>Sport</a></nav><main><article><header><h1>Markets calm</h1></header><p>Shares were little changed on Friday.</p>"
             "<div class='advert'>Buy one, get one free!</div><p>Analysts expect <math><mi>x</mi><mo>=</mo><mn>3</mn></math> percent growth, as before.</p></article></main>"
             "<aside class='related'><h3>Related</h3><ul><li><a href=/1>Oil falls</a></li></ul></aside><form action=/n><p>Sign up for our letter.</p><button>Go</button></form></body>",
             "Markets calm Shares were little changed on Friday. Analysts expect x=3 percent growth, as before."),
}


def test_op9_layouts_written_by_hand():
    crf, kept, lost, wrong = html_crf.model(), 0, 0, 0
    for page, want in LAYOUTS.values():
        got, truth = Counter(crf.extract(page).split()), Counter(want.split())
        kept, lost, wrong = kept + (got & truth).total(), lost + (truth - got).total(), wrong + (got - truth).total()
    assert lost <= 0.1 * (kept + lost) and wrong <= 0.1 * kept, (kept, lost, wrong)


def test_op9_viterbi_and_gradient_equal_all_labellings():
    import itertools
    import math

    crf = html_crf.Crf()
    crf.t = [[0.3, -0.7], [-0.2, 0.9]]
    rng = random.Random(8)
    for n in (1, 2, 6):
        s = [rng.uniform(-2, 2) for _ in range(n)]
        value = lambda y: sum(x for x, l in zip(s, y) if l) + sum(crf.t[a][b] for a, b in zip(y, y[1:]))  # noqa: B023, E731
        assert value(crf.viterbi(s)) == max(map(value, itertools.product((0, 1), repeat=n)))
    # one step of learning moves each feature by its label less its probability
    rows, y = [(f"f{k}",) for k in range(4)], [1, 0, 1, 1]
    fresh = html_crf.Crf()
    fresh.t, fresh.w = [[0.3, -0.7], [-0.2, 0.9]], {f"f{k}": 0.1 * k for k in range(4)}
    weigh = lambda l: math.exp(sum(0.1 * k for k in range(4) if l[k]) + sum(crf.t[a][b] for a, b in zip(l, l[1:])))
    total = sum(map(weigh, itertools.product((0, 1), repeat=4)))
    p = [sum(weigh(l) for l in itertools.product((0, 1), repeat=4) if l[k]) / total for k in range(4)]
    fresh.fit([(rows, y)], epochs=1, rate=0.5, decay=0.0)
    for k in range(4):
        assert fresh.w[f"f{k}"] == pytest.approx(0.1 * k + 0.5 * (y[k] - p[k]))


def walk(keys, shards, slack):
    """Loads by home point: row by row, first all that fit go home, then the rest goes on clockwise; rows in ring order."""
    top = ring.points(shards)
    cap = ring.capacities(len(keys), shards, slack)
    of = lambda k: int(hashlib.md5(("" if k is None else str(k)).encode()).hexdigest()[:13], 16)
    homes = sorted((of(k), sum(p < of(k) for p, _ in top)) for k in keys)
    got, late = Counter(), []
    for _, at in homes:
        s = top[at % len(top)][1]
        if cap[s]:
            cap[s] -= 1
            got[at % len(top), s] += 1
        else:
            late.append(at)
    for at in late:
        i = at
        while not cap[top[i % len(top)][1]]:
            i += 1
        cap[top[i % len(top)][1]] -= 1
        got[at % len(top), top[i % len(top)][1]] += 1
    return got


@pytest.mark.parametrize("slack,unit", [(0.0, 1_000_000), (0.25, 1_000_000), (0.0, 3)])
def test_op10_equals_a_walk_row_by_row(spark, slack, unit):
    keys = [None, *range(1500), *[7] * 300]
    rows = spark.createDataFrame([(k, n) for n, k in enumerate(keys)], "doc_id long, n int")
    got = ring.shard_rows(rows, shards=7, slack=slack, ties=("n",), unit_rows=unit).collect()
    top = ring.points(7)
    of = lambda k: int(hashlib.md5(("" if k is None else str(k)).encode()).hexdigest()[:13], 16)
    assert Counter((sum(p < of(r.doc_id) for p, _ in top) % len(top), r.shard) for r in got) == walk(keys, 7, slack)
    for s in range(7):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    by_key = ring.shard_keys(rows, shards=7).collect()
    assert all(r.shard == top[sum(p < of(r.doc_id) for p, _ in top) % len(top)][1] for r in by_key)


def test_op10_growth_moves_few_rows_with_slack(spark):
    rows = spark.range(20_000).withColumnRenamed("id", "doc_id")
    share = {}
    for slack in (0.0, 0.25):
        a, b = ({r.doc_id: r.shard for r in ring.shard_rows(rows, shards=n, slack=slack).collect()} for n in (10, 11))
        share[slack] = sum(a[k] != b[k] for k in a) / len(a)
        assert max(Counter(b.values()).values()) <= -(-(1 + slack) * len(a) // 11)
    assert share[0.25] < 0.2 and share[0.0] < 0.5, share


def test_op10_loads_differ_by_one_and_movement_is_small(spark, docs, empty):
    rows = spark.range(5000).withColumnRenamed("id", "doc_id")
    got = ring.shard_rows(rows, shards=7).collect()
    loads = Counter(r.shard for r in got)
    assert max(loads.values()) - min(loads.values()) <= 1 and len(got) == 5000
    for s in range(7):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(loads[s]))
    a = {r.doc_id: r.shard for r in ring.shard_keys(rows, shards=7).collect()}
    b = {r.doc_id: r.shard for r in ring.shard_keys(rows, shards=8).collect()}
    assert all(b[k] in (a[k], 7) for k in a)
    assert sum(a[r.doc_id] == r.shard for r in got) > 0.7 * 5000
    odd = ring.shard_rows(docs.select("doc_id", "text"), shards=4).collect()
    loads = Counter(r.shard for r in odd)
    assert sum(loads.values()) == len(DOCS) and max(loads.values()) - min(loads.get(s, 0) for s in range(4)) <= 1
    assert ring.shard_rows(empty.select("doc_id"), shards=4).count() == 0


@pytest.mark.parametrize("name, kind", [("byte_bpe_50k.json", "byte"), ("word_bpe_49k.json", "word")])
def test_units_in_use_are_learned_once(name, kind, monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_UNITS", 40)
    enc = Encoder(vocabulary(name), kind)
    learned, learn = [], enc._learn
    monkeypatch.setattr(enc, "_learn", lambda units: learned.extend(units) or learn(units))
    letters = "abcdefghijklmnopqrstuvwxyz"
    for k in range(26):
        text = "common words " + " ".join(f"x{letters[k]}{a}" for a in letters[:20])
        got = enc.encode([text])[0]
        assert [int.from_bytes(got[i : i + 4], "little") for i in range(0, len(got), 4)] == enc.lib.encode(text, add_special_tokens=False).ids
        assert len(enc.units) <= 40 + 22 and len(enc.older) <= 40 + 22
    assert [u.strip() for u in learned].count("common") == [u.strip() for u in learned].count("words") == 1
