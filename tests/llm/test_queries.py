"""The registered queries over their whole tables: rows, digests and SQL."""

import glob
import hashlib
import os
import zlib

import duckdb
import numpy as np
import pytest

from faultline.llm import packing, queries
from faultline.llm.tokens import vocabulary

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


@pytest.fixture(scope="module")
def texts(duck):
    return dict(duck.sql("SELECT doc_id, coalesce(text, '') FROM documents").fetchall())


def run(spark, name):
    return queries.QUERIES[name](spark, SF).collect()


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, duck, name):
    rel = duck.sql(queries.ORACLES[name])
    got = run(spark, name)
    assert sorted(tuple(r[c] for c in rel.columns) for r in got) == sorted(rel.fetchall())


def test_op1_ids_are_the_plain_library_call(spark, texts):
    from tokenizers import Tokenizer

    lib, start = Tokenizer.from_file(vocabulary("word_bpe_49k.json")), 0
    got = {r.doc_id: r for r in run(spark, "op1_sstable")}
    assert got.keys() == texts.keys()
    for i in sorted(texts):
        ids = [*lib.encode(texts[i], add_special_tokens=False).ids, 1]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_op2_payloads(spark, texts):
    got = {r.doc_id: r for r in run(spark, "op2_avi_mjpeg")}
    assert got.keys() == texts.keys()
    for i, t in texts.items():
        raw = t.encode()
        payload = raw + bytes(-len(raw) % 64 or 64 * (not raw))
        assert (got[i].n_bytes, got[i].payload_bytes, got[i].payload_sha256, got[i].tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))


def test_op4_scores_and_held_out_rows(spark, duck, texts):
    got = {r.doc_id: r for r in run(spark, "op4_byte_cnn")}
    assert got.keys() == texts.keys()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) and r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())


def test_op5_pairs_equal_tiling_by_definition(spark, duck, texts):
    from .test_operators import brute_coverage

    bench = dict(duck.sql("SELECT item_id, text FROM benchmark").fetchall())
    clean = lambda t: " ".join("".join(c.lower() if "A" <= c <= "Z" else c for c in t).split())
    got = {(r.doc_id, r.item_id): r.covered for r in run(spark, "op5_string_tiling")}
    grams = lambda w: {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    items = {i: (clean(t), grams(clean(t).split())) for i, t in bench.items()}
    want = {}
    for d, t in texts.items():
        w = clean(t).split()
        own = grams(w)
        for i, (item, seeds) in items.items():
            hit = own & seeds
            if 5 * len(hit) < 0.3 * len(item.split()):
                continue  # so few seeds cannot cover 0.8 of the item
            near = [k for k in range(len(w)) if any(tuple(w[j : j + 5]) in hit for j in range(max(0, k - 4), k + 1))]
            parts = " ".join(w[k] if k - 1 in near or k == near[0] else f"| {w[k]}" for k in near)
            n = brute_coverage(parts, item)
            if n >= 0.8 * len(item.split()):
                want[d, i] = n
    assert got == want


def test_op8_places(spark, texts):
    rows = run(spark, "op8_residual_packing")
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in by.values():
        spans.sort()
        assert [o for o, _ in spans] == [sum(n for _, n in spans[:k]) for k in range(len(spans))] and sum(n for _, n in spans) <= 1024
    assert {r.doc_id for r in rows} == texts.keys()
    assert len(by) <= len(packing.best_fit([r.length for r in rows], 1024)[2]) + 1


def test_op9_rows(spark, duck):
    got = run(spark, "op9_crf_html")
    assert sorted(r.page_id for r in got) == sorted(x for (x,) in duck.sql("SELECT page_id FROM pages").fetchall())
    assert all(r.n_chars == len(r.text) for r in got)


def test_op10_equals_a_walk_row_by_row(spark, texts):
    from .test_operators import ring, walk

    got = run(spark, "op10_bounded_ring")
    loads = {}
    for (_, shard), n in walk(list(texts), 16, 0.0).items():
        loads[shard] = loads.get(shard, 0) + n
    assert {s: sum(r.shard == s for r in got) for s in range(16)} == loads
    assert all(r.size == len(texts[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) and r.law == "rows" for r in got)
    assert len(ring.points(16)) == 16 * ring.VNODES
