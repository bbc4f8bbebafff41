"""Helpers that the corpus operators share: shared storage, worker paths, batching and components."""

from __future__ import annotations

import ctypes
import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


#: Bytes of a batch that goes to a Python worker, whatever its rows hold; set unless the session names a size of its own.
BATCH, BATCH_BYTES, BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", 12 << 20, "67108864b"


def prepare(spark: SparkSession) -> None:
    """Let Python workers on this machine import the package, and bound their batches; clusters ship the package with --py-files."""
    if spark.conf.get(BATCH, None) == BATCH_DEFAULT:
        spark.conf.set(BATCH, str(BATCH_BYTES))
    env = spark.sparkContext.environment
    have = [p for p in env.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep) if p]
    if ROOT not in have:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *have])


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder that all executors see, under spark.checkpoint.dir (set here only where it is unset)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "/tmp/ledgerline-checkpoints"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df as Parquet into the shared folder and read it back."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dealt(files: DataFrame) -> DataFrame:
    """Rows that each name a file, dealt evenly to a task each, or to some rounds of tasks where there are very many."""
    spark = files.sparkSession
    most = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return files.repartition(max(1, min(files.count(), most)))


def column(df: DataFrame, name: str, kind: str) -> Column:
    """df[name] cast to kind; null where the column is missing."""
    return df[name].cast(kind) if name in df.columns else F.lit(None).cast(kind)


def texts_of(docs: DataFrame) -> DataFrame:
    """(doc_id bigint, text string): rows without an id are dropped, null texts become empty.

    Other columns, whatever their names, are left behind here."""
    return docs.select(column(docs, "doc_id", "bigint").alias("doc_id"), F.coalesce(column(docs, "text", "string"), F.lit("")).alias("text")).filter("doc_id IS NOT NULL")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges of at most `most` bytes each; a longer row stands alone."""
    n, a = len(offsets) - 1, 0
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + most, side="right")) - 1
        b = min(n, max(b, a + 1))
        yield a, b
        a = b


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of an Arrow string or binary array, without copying rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, offsets


#: Fixed odd multipliers of the hash functions (from the golden ratio and the splitmix64 finaliser).
GOLD, MIX1, MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser over uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * MIX1
    x ^= x >> np.uint64(27)
    x *= MIX2
    x ^= x >> np.uint64(31)
    return x


def powers(n: int, _kept: dict = {}) -> tuple[np.ndarray, np.ndarray]:  # noqa: B006  a cache for the worker's life
    """B**i and B**-i modulo 2**64 for i < n."""
    if len(_kept.get("p", ())) < n:
        base = 0xD6E8FEB86659FD93
        for k, b in (("p", base), ("q", pow(base, -1, 1 << 64))):
            x = np.full(max(n, 1 << 20), np.uint64(b))
            x[0] = 1
            _kept[k] = np.cumprod(x, dtype=np.uint64)
    return _kept["p"][:n], _kept["q"][:n]


def byte_values(seed: int) -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * GOLD + np.uint64(seed)) | np.uint64(1)


def prefix_hash(data: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P with P[e] - P[s] = B**s * hash(data[s:e]), and the inverse powers that take B**s away."""
    p, q = powers(len(data) + 1)
    out = np.empty(len(data) + 1, np.uint64)
    out[0] = 0
    np.cumsum(values[data] * p[: len(data)], out=out[1:])
    return out, q


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Connected components of (a, b): returns (id, component), component the least id reachable; only of nodes on edges.

    Alternating large-star and small-star rounds: every group is only ever reduced to its minimum, so a
    node with very many neighbours is pre-aggregated map-side, and no group is gathered in one task."""
    spark = edges.sparkSession
    e = stored(edges.select(F.least("a", "b").alias("b"), F.greatest("a", "b").alias("a")).filter("a <> b").select("a", "b").distinct(), "cc")
    last = None
    for _ in range(most_rounds):
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        low2 = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low2, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low2.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()
        e = stored(small, "cc")
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if last == now:
            break
        last = now
    else:
        raise RuntimeError("components did not converge")
    star = e.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("id"), "component")
    return star.union(e.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())


def keyed_runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Regroup batches that are sorted by key: yields tables that hold whole keys only (several keys each)."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        k = batch.column(key).to_numpy(zero_copy_only=False)
        cut = np.flatnonzero(k != k[-1])
        cut = int(cut[-1]) + 1 if len(cut) else 0
        if cut or (held and held[-1].column(key)[-1].as_py() != k[-1]):
            done = [*held, batch.slice(0, cut)] if cut else held
            yield pa.Table.from_batches(done)
            held = [batch.slice(cut)]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def frugal(run):
    """run over batches; when its task ends, the worker, which lives on for other stages, gives freed memory back to the system."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
            if trim:
                trim(0)

    return own


def schema(text: str) -> T.StructType:
    return T.StructType.fromDDL(text) if hasattr(T.StructType, "fromDDL") else T._parse_datatype_string(text)
