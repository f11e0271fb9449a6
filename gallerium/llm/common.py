"""Shared helpers: scratch tables in the shared folder, vectorised string hashing, connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
_MULTIPLIER = 0x9E3779B97F4A7C15 | 1


def scratch_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: spark.checkpoint.dir, or one of our own where it is unset."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = f"file://{tempfile.gettempdir()}/gallerium-scratch"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write `df` once to the shared folder and read it back: cuts lineage so that lost executors cost no recomputation."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def arrow_map(df: DataFrame, schema: str, make: Callable[[], Callable[[pa.RecordBatch], Iterator[dict]]]) -> DataFrame:
    """mapInArrow where `make()` is called once a task and returns a function from a batch to dicts of columns."""
    probe = df.sparkSession.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(probe)

    def run(batches):
        step = make()
        for batch in batches:
            for columns in step(batch):
                yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, probe)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, elementwise."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def seeds(n: int, salt: int) -> np.ndarray:
    """n odd 64-bit multipliers, a fixed function of salt."""
    return mix64(np.arange(1, n + 1, dtype=np.uint64) * U64(_MULTIPLIER) + U64(salt)) | U64(1)


_BYTE_VALUES = mix64(np.arange(256, dtype=np.uint64) + U64(0x51ED27))
_POWERS: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P**i and P**-i modulo 2**64 for i < n at least; the tables grow by doubling."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        inverse = pow(_MULTIPLIER, -1, 1 << 64)
        tables = []
        for base in (_MULTIPLIER, inverse):
            table = np.full(size, base, dtype=np.uint64)
            table[0] = 1
            tables.append(np.multiply.accumulate(table))
        _POWERS[:] = tables
    return _POWERS[0], _POWERS[1]


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """Prefix sums of values[i] * P**i, with a leading 0: the polynomial of a slice s..e is (C[e]-C[s]) * P**-s."""
    power, _ = powers(len(values) + 1)
    out = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * power[: len(values)], out=out[1:])
    return out


def byte_values(data: np.ndarray) -> np.ndarray:
    return _BYTE_VALUES[data]


def window_hashes(values: np.ndarray, width: int) -> np.ndarray:
    """64-bit hashes of all windows of `width` values (empty if there is none)."""
    n = len(values) - width + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    prefix = prefix_hash(values)
    _, inverse = powers(len(values) + 1)
    return mix64((prefix[width:] - prefix[:n]) * inverse[:n])


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum over each window of `width` values, in linear time (blockwise prefix and suffix minima)."""
    n = len(values) - width + 1
    if n <= 0:
        return np.empty(0, dtype=values.dtype)
    blocks = -(-len(values) // width)
    padded = np.full(blocks * width, np.iinfo(values.dtype).max, dtype=values.dtype)
    padded[: len(values)] = values
    grid = padded.reshape(blocks, width)
    forward = np.minimum.accumulate(grid, axis=1).ravel()
    backward = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(backward[:n], forward[width - 1 : width - 1 + n])


def connected_components(edges: DataFrame, name: str = "cc") -> DataFrame:
    """Edges (a, b: long) to (node, component): the smallest node reachable, for every node of an edge.

    Alternating large-star and small-star steps. A union-find within each partition first contracts the edges, so a hub
    of many neighbours is summed before any shuffle; each round is written to the shared folder."""

    def contract():
        def step(batch):
            parent: dict[int, int] = {}

            def find(x):
                root = x
                while parent.setdefault(root, root) != root:
                    root = parent[root]
                while parent[x] != root:
                    parent[x], x = root, parent[x]
                return root

            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                a, b = find(a), find(b)
                if a != b:
                    parent[max(a, b)] = min(a, b)
            nodes = [x for x in parent if find(x) != x]
            yield {"a": nodes, "b": [find(x) for x in nodes]}

        return step

    edges = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b")
    current = materialize(arrow_map(edges, "a long, b long", contract).distinct(), name)
    seen = None
    while True:
        both = current.select("a", "b").unionAll(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        current = materialize(small, name)
        mark = current.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen = mark
    members = current.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return members.unionAll(members.select(F.col("component").alias("node"), "component").distinct())
