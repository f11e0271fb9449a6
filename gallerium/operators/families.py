"""Families: items that share a key or show the same image, folded into a representative."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from functools import reduce
from math import comb

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T


BLOCK_ROWS = 128  # of unlike vectors in a block, about
LEAST_BITS = 12  # so that tables are no fewer for small inputs, and what is dealt grows with the rows
SKETCH = 128  # signs that met vectors are told apart by, a multiple of 64
SIGNED_AT_ONCE = 1024  # vectors


def shared_folder(spark: SparkSession) -> str:
    """Where driver and executors both write: spark.checkpoint.dir, or a folder of our own where it is unset."""
    return (spark.conf.get("spark.checkpoint.dir", None) or f"file://{tempfile.gettempdir()}/gallerium-scratch").rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """Written to the shared folder and read again, which cuts lineage."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/components-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dedupe_keys(curated: str = "curated") -> Column:
    """All keys of an item as strings; two items that share any belong together. Each text is folded once."""
    is_curated = F.col("source") == curated
    key = lambda kind, *parts: F.concat_ws("\x1f", F.lit(kind), *parts)

    def of_texts(m: Column) -> Column:
        title, artist, words = F.array_join(m["title"], " "), m["artist"], T.terms(m["title"])
        return F.array_compact(F.array(
            F.when((F.col("source") != "") & (F.col("work_id") != ""), key("work-id", F.col("source"), F.col("work_id"))),
            F.when(m["address"] != "", key("image", m["address"])),
            F.when((title != "") & ((artist != "") | (F.size(words) >= 6)), key("work", title, artist, m["date"])),
            F.when(is_curated & (artist != "") & (F.size(words) >= 3), key("title-words", artist, F.array_join(F.array_sort(words), " "))),
            F.when(is_curated & (F.length(m["description"]) >= 80), key("description", m["description"])),
        ))

    texts = F.struct(T.fold_tokens("title").alias("title"), T.fold("artist").alias("artist"), T.fold("date").alias("date"), F.when(is_curated, T.fold("description")).alias("description"), T.canonical_url("image_url").alias("address"))
    return T.let(T.let(texts, of_texts), lambda keys: F.when(F.size(keys) > 0, keys).otherwise(F.array(key("id", F.col("id")))))


def components(edges: DataFrame) -> DataFrame:
    """Edges (a, b) to (node, component), the smallest node reachable: labels sink along edges and are then followed to
    their own labels, until nothing changes. Hubs are summed in the tasks before each shuffle."""
    both = stored(edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    labels = stored(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component")))
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("component").alias("near"))
        sunk = labels.join(near, F.col("node") == F.col("a")).select("node", F.least("component", "near").alias("c"), F.col("component").alias("old"))
        jump = labels.select(F.col("node").alias("c"), F.col("component").alias("further"))
        new = stored(sunk.join(jump, "c", "left").select("node", F.coalesce("further", "c").alias("component"), "old"))
        if not new.where("component <> old").limit(1).count():
            return new.select("node", "component")
        labels = new.select("node", "component")


def key_edges(items: DataFrame, node: str) -> DataFrame:
    """Each item linked to the first item of each of its keys: as many edges as keys, however many items share one."""
    keyed = items.select(F.col(node).alias("node"), F.explode(dedupe_keys()).alias("key"))
    first = keyed.groupBy("key").agg(F.min("node").alias("first"), F.count("*").alias("n")).where("n > 1")
    return keyed.join(first, "key").select(F.col("node").alias("a"), F.col("first").alias("b"))


def resolution_order() -> list[Column]:
    """Better first: primary views, known sizes, larger areas and sides, higher scores, earlier ranks."""
    area = F.col("width").cast("long") * F.col("height")
    return [(~F.col("is_primary_view")).cast("int"), (area == 0).cast("int"), -area, -F.least("width", "height"), -F.col("rank_score"), F.col("provider_rank")]


def _members(items: DataFrame, labels: DataFrame, node: str) -> DataFrame:
    joined = items.join(labels, items[node] == labels["node"], "left").withColumn("component", F.coalesce("component", F.col(node)))
    return joined.withColumn("__order", F.struct(*[c.alias(f"k{i}") for i, c in enumerate(resolution_order())], F.col(node).alias("k9")))


def collapse(items: DataFrame, labels: DataFrame, node: str) -> DataFrame:
    """A row a family: its best member, the highest score of all, and how many more there are; tasks fold members before any
    shuffle, and no family is gathered."""
    best = _members(items, labels, node).groupBy("component").agg(F.min_by(F.struct(node, "title", "width", "height"), "__order").alias("best"), F.max("rank_score").alias("rank_score"), (F.count("*") - 1).alias("duplicate_count"))
    return best.select("component", "best.*", "rank_score", "duplicate_count")


def alternates(items: DataFrame, labels: DataFrame, node: str) -> DataFrame:
    """(component, place, node) of the members of each family but its best, in order, a row each."""
    own = Window.partitionBy("component").orderBy("__order")
    placed = _members(items, labels, node).withColumn("place", F.row_number().over(own) - 1)
    return placed.where("place > 0").select("component", "place", node)


def met_pairs(vectors: DataFrame, threshold: float, miss: float) -> DataFrame:
    """Pairs (a, b), a below b, that may be at or above a cosine; of those that are, `miss` at most lack. Signs of random
    projections block them: a table has as many bits as leave about `BLOCK_ROWS` rows a block, and there are as many tables as
    miss a pair at the threshold with half of `miss`. Only ids and SKETCH other signs meet in the blocks; pairs in which more
    of these differ than in a pair at the threshold, but for the other half of `miss`, go at once. A block of many near copies
    is that large however many bits it has, and its pairs are the result."""
    import numpy as np
    import pyarrow as pa

    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<float>").alias("embedding"))
    about = rows.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("width")).first()
    bits = int(min(24, max(LEAST_BITS, np.ceil(np.log2(max(about.n, 1) / BLOCK_ROWS)))))
    differ = np.arccos(threshold) / np.pi
    tables = int(np.ceil(np.log(miss / 2) / np.log1p(-((1 - differ) ** bits))))
    most = _most_differing(differ, miss / 2)
    rng = np.random.default_rng(7)
    planes = rng.normal(size=(tables * bits + SKETCH, about.width or 1)).astype("float32")
    words = [f"s{i}" for i in range(SKETCH // 64)]

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, SIGNED_AT_ONCE):
                some = batch.slice(at, SIGNED_AT_ONCE)
                signs = some.column(1).flatten().to_numpy().reshape(some.num_rows, -1) @ planes.T > 0
                keys = signs[:, :-SKETCH].reshape(len(signs), tables, bits) @ (1 << np.arange(bits))
                sketch = np.packbits(signs[:, -SKETCH:], axis=1).view("int64")
                yield pa.RecordBatch.from_pydict({"vec_id": some.column(0), "keys": pa.array(list(keys.astype("int32")), pa.list_(pa.int32())), **{w: sketch[:, i] for i, w in enumerate(words)}})

    blocked = stored(rows.where("embedding is not null").mapInArrow(run, f"vec_id long, keys array<int>, {', '.join(f'{w} long' for w in words)}"))
    # a table and its key are one number; the sides are equal but for names, so Spark deals the rows once
    dealt = blocked.select(F.posexplode("keys").alias("table", "key"), "vec_id", *words).select((F.col("table").cast("long") * (1 << bits) + F.col("key")).alias("block"), "vec_id", *words)
    side = lambda n: dealt.select("block", F.col("vec_id").alias(n), *[F.col(w).alias(f"{w}_{n}") for w in words])
    apart = reduce(lambda x, y: x + y, [F.bit_count(F.col(f"{w}_a").bitwiseXOR(F.col(f"{w}_b"))) for w in words])
    return side("a").join(side("b").hint("merge"), "block").where((F.col("a") < F.col("b")) & (apart <= most)).select("a", "b").distinct()


def image_pairs(vectors: DataFrame, threshold: float = 0.9, miss: float = 1e-4, same: Callable[[DataFrame], Column] | None = None) -> DataFrame:
    """Pairs (a, b, cosine) of unit vectors (vec_id, embedding) at or above a cosine, and for which `same` holds, a rule over
    the pair's columns. The vectors of each pair that `met_pairs` leaves are looked up once."""
    from ..functions.scoring import dot

    vectors = stored(vectors)  # read for the blocks and for both sides of the met pairs
    pairs = met_pairs(vectors, threshold, miss)
    own = lambda n: vectors.select(*[F.col(c).alias(n if c == "vec_id" else f"{c}_{n}") for c in vectors.columns])
    both = pairs.join(own("a"), "a").join(own("b"), "b").withColumn("cosine", dot(F.col("embedding_a"), F.col("embedding_b"))).where(F.col("cosine") >= threshold)
    return (both.where(same(both)) if same else both).select("a", "b", "cosine")


def _most_differing(share: float, miss: float) -> int:
    """The fewest of SKETCH signs, each differing with probability `share`, that more differ than with probability `miss`."""
    left = 1.0
    for k in range(SKETCH):
        left -= comb(SKETCH, k) * share**k * (1 - share) ** (SKETCH - k)
        if left <= miss:
            return k
    return SKETCH
