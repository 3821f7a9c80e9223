"""Token ids in sorted-string-table shards (operator 1).

Layout of a shard::

    data block*  index  Bloom filter  footer

A data block holds entries in ascending key order, compressed as a whole with zstd. An entry is
``shared u8 | rest u8 | count u32 | key[shared:] | ids``: the key's first ``shared`` bytes are those
of the key before it (0 at the start of a block). Keys are 8 bytes, big-endian, with the sign bit
turned, so byte order is numeric order; a null key is empty and sorts first. Ids are stored in 16
bits if all fit, else in 32. The sparse index has one entry per block: last key, offset, length.
The Bloom filter has ``BLOOM_BITS`` bits a key and ``BLOOM_HASHES`` probes. A lookup asks the filter,
searches the index by bisection and scans one block, or more where a key is repeated.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_left

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import store
from .tokens import array_groups, encoder, vocabulary

BLOCK_BYTES, SHARD_BYTES = 64 << 10, 16 << 20
BLOOM_BITS, BLOOM_HASHES = 10, 7
_ENTRY, _FOOTER, _MAGIC = struct.Struct("<BBI"), struct.Struct("<QQQQQQI8s"), b"FLSST001"


def key_of(doc_id: int | None) -> bytes:
    return b"" if doc_id is None else (doc_id + (1 << 63)).to_bytes(8, "big")


def doc_of(key: bytes) -> int | None:
    return int.from_bytes(key, "big") - (1 << 63) if key else None


def _probes(key: bytes, bits: int):
    import xxhash

    h = xxhash.xxh3_128_intdigest(key)
    a, b = h & 0xFFFFFFFFFFFFFFFF, (h >> 64) | 1
    return [(a + i * b) % bits for i in range(BLOOM_HASHES)]


class Writer:
    """Takes (doc_id, ids as little-endian unsigned 32-bit bytes) in ascending order of doc_id."""

    def __init__(self, width: int = 2):
        self.width, self.out, self.size = width, [], 0
        self.index, self.keys, self.tokens, self.block, self.last, self.raw = [], [], 0, [], b"", 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        import numpy as np

        key = key_of(doc_id)
        if self.keys and key < self.keys[-1]:
            raise ValueError("keys must ascend")
        shared = 0
        if self.block:
            while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
                shared += 1
        n = len(ids) // 4
        if self.width == 2:
            ids = np.frombuffer(ids, "<u4").astype("<u2").tobytes()
        self.block += [_ENTRY.pack(shared, len(key) - shared, n), key[shared:], ids]
        self.raw += len(ids) + 14
        self.last = key
        self.keys.append(key)
        self.tokens += n
        if self.raw >= BLOCK_BYTES:
            self._end_block()

    def _end_block(self) -> None:
        import zstandard

        if self.block:
            data = zstandard.ZstdCompressor(level=1).compress(b"".join(self.block))
            self.index.append((self.last, self.size, len(data)))
            self.out.append(data)
            self.size += len(data)
            self.block, self.raw, self.last = [], 0, b""

    def finish(self) -> bytes:
        import numpy as np

        self._end_block()
        index = b"".join(struct.pack("<BQQ", len(k), o, n) + k for k, o, n in self.index)
        bits = max(64, BLOOM_BITS * len(self.keys))
        flags = np.zeros(bits, bool)
        for k in set(self.keys):
            flags[_probes(k, bits)] = True
        bloom = np.packbits(flags, bitorder="little").tobytes()
        at = self.size + len(index)
        return b"".join([*self.out, index, bloom, _FOOTER.pack(self.size, len(index), at, bits, len(self.keys), self.tokens, self.width, _MAGIC)])


class Reader:
    """A shard: whole scans, and lookups by key that read footer, index, filter and one block.

    ``source`` is the shard's bytes, or an open file that reads ranges (``size`` and ``read_at``).
    """

    def __init__(self, source):
        self.source, self.asked = source, 0
        size = source.size() if hasattr(source, "read_at") else len(source)
        self.index_at, n, self.bloom_at, self.bits, self.n, self.tokens, self.width, magic = _FOOTER.unpack(self._at(size - _FOOTER.size, _FOOTER.size))
        if magic != _MAGIC:
            raise ValueError("not a shard")
        index, i, self.blocks = self._at(self.index_at, n), 0, []
        while i < n:
            k, o, size = struct.unpack_from("<BQQ", index, i)
            self.blocks.append((index[i + 17 : i + 17 + k], o, size))
            i += 17 + k
        self.last_keys = [k for k, _, _ in self.blocks]
        self._bloom = None

    def _at(self, offset: int, n: int) -> bytes:
        self.asked += n
        return bytes(self.source.read_at(n, offset)) if hasattr(self.source, "read_at") else bytes(self.source[offset : offset + n])

    def _block(self, b: int):
        import zstandard

        _, o, n = self.blocks[b]
        raw = zstandard.ZstdDecompressor().decompress(self._at(o, n))
        i, key = 0, b""
        while i < len(raw):
            shared, rest, count = _ENTRY.unpack_from(raw, i)
            i += _ENTRY.size
            key = key[:shared] + raw[i : i + rest]
            i += rest
            yield key, raw[i : i + count * self.width]
            i += count * self.width

    def ids(self, raw: bytes):
        import numpy as np

        return np.frombuffer(raw, f"<u{self.width}").astype("<u4")

    def __iter__(self):
        for b in range(len(self.blocks)):
            for key, raw in self._block(b):
                yield doc_of(key), self.ids(raw)

    def may_hold(self, doc_id: int | None) -> bool:
        if self._bloom is None:
            self._bloom = self._at(self.bloom_at, -(-self.bits // 8))
        return all(self._bloom[p // 8] >> p % 8 & 1 for p in _probes(key_of(doc_id), self.bits))

    def get(self, doc_id: int | None) -> list:
        """The ids of every entry with this key, in order."""
        key, found = key_of(doc_id), []
        if self.n and self.may_hold(doc_id):
            b = bisect_left(self.last_keys, key)
            while b < len(self.blocks):
                found += [self.ids(raw) for k, raw in self._block(b) if k == key]
                if self.last_keys[b] > key:
                    break
                b += 1
        return found


def _save(uri: str, data: bytes) -> None:
    from pyarrow import fs

    where, path = fs.FileSystem.from_uri(uri)
    where.create_dir(path.rpartition("/")[0], recursive=True)
    with where.open_output_stream(path) as f:
        f.write(data)


MANIFEST = "part int, seq int, file string, n_docs long, n_tokens long, first_id long, last_id long, has_null boolean"


def write_shards(docs: DataFrame, tokenizer: str, kind: str, end_id: int, shards: int | None = None, shard_bytes: int = SHARD_BYTES) -> tuple[str, DataFrame]:
    """Encode ``docs`` (doc_id, text) into shards in ascending doc_id order.

    Null or empty texts have only the end id; null doc_ids sort first; rows that share a doc_id stay
    apart, beside each other. Returns the shards' folder and a manifest, a written table of one row a shard: part, seq,
    file, n_docs, n_tokens, first_id and last_id, has_null (whether null doc_ids are in it), and start, which counts all
    ids of earlier shards. A file bears its task attempt in its name, so what a lost or repeated task left is no
    shard: only files in the manifest are.
    """
    spark = docs.sparkSession
    folder = store.shared_dir(spark)
    n = shards or store.partitions(spark)
    store.small_batches(spark, 5000)

    def write(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        ctx, enc = TaskContext.get(), encoder(tokenizer, kind, end_id)
        part, attempt = ctx.partitionId(), ctx.taskAttemptId()
        width = 2 if enc.lib.get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else 4
        writer, seq, held, made = Writer(width), 0, 0, []

        def close():
            name = f"{part:06d}-{seq:06d}-{attempt}.sst"
            _save(f"{folder}/{name}", writer.finish())
            known = [k for k in (writer.keys[0], next((k for k in writer.keys if k), b""), writer.keys[-1])]
            made.append((part, seq, name, len(writer.keys), writer.tokens, doc_of(known[1]), doc_of(known[2]), not known[0]))

        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for a, b in array_groups(texts):
                for doc, raw in zip(ids[a:b], enc.encode(texts.slice(a, b - a))):
                    writer.add(doc, raw)
                    held += len(raw)
                    if held >= shard_bytes * 4 // writer.width:
                        close()
                        writer, seq, held = Writer(width), seq + 1, 0
        if writer.keys:
            close()
        types = (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*made)) or [[]] * 8, types)], [x.split()[0] for x in MANIFEST.split(", ")])

    rows = docs.select("doc_id", "text").repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id")
    made = store.written(rows.mapInArrow(write, MANIFEST))
    before = lambda w: F.coalesce(F.sum("n_tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # one row a partition, then the shards of each
    parts = made.groupBy("part").agg(F.sum("n_tokens").alias("n_tokens")).select("part", before(Window.orderBy("part")).alias("_start"))
    manifest = made.withColumn("_in", before(Window.partitionBy("part").orderBy("seq"))).join(parts, "part")
    return folder, store.written(manifest.withColumn("start", F.col("_start") + F.col("_in")).drop("_start", "_in"))


def read_shards(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """Every entry of every shard: doc_id, start, n_tokens, ids_crc32, file, ids (32-bit, little-endian)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.sst").load(folder) if manifest.head(1) else None
    schema = "file string, doc_id long, within long, n_tokens long, ids_crc32 long, ids binary"

    def read(batches):
        import pyarrow as pa

        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                name, at, rows, held = path.rpartition("/")[2], 0, [], 0
                for doc, ids in Reader(data.as_buffer()):
                    raw = ids.tobytes()
                    rows.append((name, doc, at, len(ids), zlib.crc32(raw), raw))
                    at += len(ids)
                    held += len(raw)
                    if held > 8 << 20:
                        yield _batch(pa, rows)
                        rows, held = [], 0
                if rows:
                    yield _batch(pa, rows)

    def _batch(pa, rows):
        types = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["file", "doc_id", "within", "n_tokens", "ids_crc32", "ids"])

    entries = files.select("path", "content").mapInArrow(read, schema) if files is not None else spark.createDataFrame([], schema)
    return entries.join(manifest.select("file", "start"), "file").select(
        "doc_id", (F.col("start") + F.col("within")).alias("start"), "n_tokens", "ids_crc32", "file", "ids"
    )


def lookup(folder: str, manifest: DataFrame, doc_id: int | None) -> list:
    """The ids stored for one document: the manifest's key ranges name the shards, and of each only footer, index, filter and a block are read."""
    from pyarrow import fs

    hit = F.col("has_null") if doc_id is None else (F.col("first_id") <= doc_id) & (F.col("last_id") >= doc_id)
    out = []
    # shards are cut by key, so that one key is in few of them
    for r in manifest.filter(hit).select("part", "seq", "file").orderBy("part", "seq").toLocalIterator():
        where, path = fs.FileSystem.from_uri(f"{folder}/{r['file']}")
        with where.open_input_file(path) as f:
            out += Reader(f).get(doc_id)
    return out


def op1_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder, manifest = write_shards(docs, vocabulary("word_bpe_49k.json"), "word", 1)
    return read_shards(spark, folder, manifest).select("doc_id", "start", "n_tokens", "ids_crc32", "file")
