"""Staged search for large images: stages of rising size are merged in order of discovery and ranked by size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

STAGES = (4, 9, 16, 25)  # megapixels


def merge(rows: DataFrame) -> DataFrame:
    """Rows (stage, stage_rank, key, width, height) of all stages to a row a key: its largest image, where it was found
    first, and all its stages."""
    pixels = F.col("width").cast("long") * F.col("height")
    return rows.withColumn("pixels", pixels).groupBy("key").agg(
        F.max_by(F.struct("width", "height"), F.struct("pixels", -F.col("stage"), -F.col("stage_rank"))).alias("best"),
        F.max("pixels").alias("pixels"),
        F.min(F.struct("stage", "stage_rank")).alias("first"),
        F.array_sort(F.collect_set("stage")).alias("stages"),
    )


def rank(rows: DataFrame, top: int) -> DataFrame:
    """The `top` keys by rank points times size. Points fall with the order of discovery, which is counted by stage and rank
    ranges rather than in one task."""
    merged = merge(rows)
    ordered = merged.select("key", "pixels", "best.*", F.col("first.stage").alias("stage"), F.col("first.stage_rank").alias("stage_rank"), F.size("stages").alias("n_stages"))
    sizes = ordered.groupBy("stage").agg(F.count("*").alias("n"))
    before = sizes.select("stage", (F.sum("n").over(Window.orderBy("stage")) - F.col("n")).alias("before"), F.sum("n").over(Window.partitionBy()).alias("total"))  # a row a stage
    place = F.row_number().over(Window.partitionBy("stage").orderBy("stage_rank", "key")) - 1 + F.col("before")
    points = ordered.join(F.broadcast(before), "stage").withColumn("discovery", place)
    score = (F.col("total") - F.col("discovery")) * F.log2(F.greatest(F.col("pixels"), F.lit(1)).cast("double"))
    return points.withColumn("final_score", F.round(score, 4)).orderBy(F.desc("final_score"), "discovery").limit(top)


MOST_SCANNED = 200  # fixed value: what one page gives


def page_union(page: list[str], parts: list[DataFrame], known: DataFrame, most: int = MOST_SCANNED, within: tuple[str, ...] = ()) -> DataFrame:
    """What a rendered page shows, from its parts in order (cards of the viewer, anchors, scripts; each with `page` columns,
    place, image_id, image_url, page_url, width, height): one row an image, by its id or else its address, as the first part
    has it. A size that it lacks is any part's or one that is known (key, width, height); `most` rows a page, in order. Of rows of
    one image at one place, the first by the columns `within` counts."""
    key = F.coalesce(F.nullif("image_id", F.lit("")), F.nullif("image_url", F.lit("")))
    every = None
    for k, part in enumerate(parts):
        one = part.select(*page, F.lit(k).alias("part"), "place", *within, key.alias("key"), "image_url", "page_url", *[F.nullif(F.coalesce(c, F.lit(0)), F.lit(0)).alias(c) for c in ("width", "height")])
        every = one if every is None else every.unionByName(one)
    sized = F.when(F.col("width").isNotNull() & F.col("height").isNotNull(), F.struct("part", "place", *within, "width", "height"))
    best = every.where("key is not null").groupBy(*page, "key").agg(F.min(F.struct("part", "place")).alias("at"), F.min_by(F.struct("image_url", "page_url"), F.struct("part", "place", *within)).alias("r"), F.min(sized).alias("size"))
    named = known.select("key", F.col("width").alias("__w"), F.col("height").alias("__h"))
    filled = best.join(named, "key", "left")
    own = Window.partitionBy(*page).orderBy("at", "key")
    ranked = filled.withColumn("position", F.row_number().over(own) - 1).where(F.col("position") < most)
    return ranked.select(*page, "position", "key", "r.image_url", "r.page_url", F.coalesce("size.width", "__w", F.lit(0)).alias("width"), F.coalesce("size.height", "__h", F.lit(0)).alias("height"))

