"""The folder that the driver and all executors share, and tables written there to cut lineage."""

from __future__ import annotations

import atexit
import functools
import shutil
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_made: dict[str, str | None] = {}  # folders of tables not deleted yet, and their names where they have one


def shared_dir(spark: SparkSession) -> str:
    """URI of a new folder below ``spark.checkpoint.dir``.

    Where that setting is unset, a local session (tests) gets a temporary folder; a session on a
    cluster is refused, as its executors would not see one another's files.
    """
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir")
    if not base:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if sc.applicationId not in _own:
            _own[sc.applicationId] = tempfile.mkdtemp(prefix="faultline-")
            atexit.register(shutil.rmtree, _own[sc.applicationId], True)
        base = f"file://{_own[sc.applicationId]}"
    if "://" not in base and base.startswith("/"):
        base = f"file://{base}"
    return f"{base.rstrip('/')}/faultline-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back: its lineage ends here."""
    spark = df.sparkSession
    path = shared_dir(spark)
    schema = df.schema
    _made[path] = None
    df.write.parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out._faultline_path = path
    return out


def bucketed(df: DataFrame, keys: list[str], buckets: int) -> DataFrame:
    """``df``, hashed by ``keys`` to ``buckets`` partitions, written with one file a bucket, sorted by the keys.

    Under :func:`ordered` a join by the keys reads the table with neither exchange nor sort.
    """
    spark = df.sparkSession
    path, name = shared_dir(spark), f"faultline_{uuid.uuid4().hex}"
    _made[path] = name
    df.write.format("parquet").bucketBy(buckets, *keys).sortBy(*keys).option("path", path).saveAsTable(name)
    out = spark.table(name)
    out._faultline_path = path
    return out


@contextmanager
def setting(spark: SparkSession, key: str, value):
    """A session setting for the plans run inside, given back afterwards."""
    old = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if old is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, old)


def ordered(spark: SparkSession):
    """Plans run inside use the order in the files of :func:`bucketed` tables."""
    return setting(spark, "spark.sql.legacy.bucketedTableScan.outputOrdering", "true")


def reads(df: DataFrame) -> set[str]:
    """The folders that the plan of ``df`` reads."""
    out, leaves = set(), df._jdf.queryExecution().analyzed().collectLeaves()
    for k in range(leaves.size()):
        leaf = leaves.apply(k)
        if leaf.getClass().getSimpleName() == "LogicalRelation" and leaf.relation().getClass().getSimpleName() == "HadoopFsRelation":
            roots = leaf.relation().location().rootPaths()
            out |= {roots.apply(i).toString() for i in range(roots.size())}
    return out


def tidy(f):
    """The operator ``f`` with the tables deleted that it writes and its result does not read."""

    @functools.wraps(f)
    def run(*args, **options):
        before = set(_made)
        out = f(*args, **options)
        kept = {p.rpartition("/")[2] for p in reads(out)}
        for path in _made.keys() - before:
            if path.rpartition("/")[2] not in kept:
                delete(out.sparkSession, path)
        return out

    return run


def release(df: DataFrame) -> None:
    """Delete the written tables that ``df`` reads, once its rows are used: the owner of a result calls it."""
    names = {p.rpartition("/")[2] for p in reads(df)}
    for path in [p for p in _made if p.rpartition("/")[2] in names]:
        delete(df.sparkSession, path)


def spare(columns: list[str], *names: str) -> list[str]:
    """``names`` with underscores added until no column has them, so that an operator's own columns clash with none."""
    taken, out = {c.lower() for c in columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def dropped(df: DataFrame) -> None:
    """Delete the files of a table made by :func:`written` that no later plan reads."""
    path = getattr(df, "_faultline_path", None)
    if path:
        delete(df.sparkSession, path)


def delete(spark: SparkSession, path: str) -> None:
    name = _made.pop(path, None)
    if name:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of few rows: texts can be long, and a Python worker holds a batch at a time.

    The setting counts when a plan runs, and results are run by the caller, so it stays; see :func:`setting` for plans run at once.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)


def trim() -> None:
    """Give a worker's free memory back to the system, at the end of a task: idle workers then stay small."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library
