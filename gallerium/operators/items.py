"""Items: the common record of all sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import images as I
from ..functions import text as T

DEFAULTS = {
    "source_id": "", "work_id": "", "title": "Untitled", "artist": "", "date": "", "medium": "", "license": "unknown",
    "attribution": "", "page_url": "", "image_url": "", "description": "", "match_highlight_mode": "whole_word",
}
HIGHLIGHT_MODES = ("whole_word", "english_stem", "prefix")


def result_id(source: Column, source_id: Column, image_url: Column) -> Column:
    return F.substring(F.sha1(F.concat_ws("|", *[F.coalesce(x, F.lit("")) for x in (source, source_id, image_url)])), 1, 16)


def _text(df: DataFrame, name: str, default: str = "") -> Column:
    value = F.col(name).cast("string") if name in df.columns else F.lit(None).cast("string")
    return F.coalesce(F.nullif(F.trim(value), F.lit("")), F.lit(default))


def normalize(df: DataFrame) -> DataFrame:
    """Any source's rows as items: defaults for what is missing, derived addresses, a generated description where none is
    given, and the page's search terms."""
    out = {k: _text(df, k, v) for k, v in DEFAULTS.items()} | {"source": _text(df, "source"), "thumb_url": _text(df, "thumb_url")}
    whole = lambda k: T.safe_int(k) if k in df.columns else F.lit(0)
    base = df.select(*[c.alias(k) for k, c in out.items()], *[whole(k).alias(k) for k in ("width", "height", "provider_rank")], (F.col("is_primary_view").cast("boolean") if "is_primary_view" in df.columns else F.lit(False)).alias("is_primary_view"))
    facts = F.concat_ws(" · ", *[F.nullif(F.col(k), F.lit("")) for k in ("artist", "date", "medium")])
    generated = F.concat(F.col("title"), F.lit(" from "), F.col("source"), F.lit("."))
    return base.withColumns({
        "id": result_id(F.col("source"), F.col("source_id"), F.col("image_url")),
        "thumb_url": F.when(F.col("thumb_url") == "", F.col("image_url")).otherwise(F.col("thumb_url")),
        "preview_url": F.coalesce(F.nullif("page_url", F.lit("")), F.col("image_url")),
        "description": F.when(F.col("description") != "", F.col("description")).when(facts != "", facts).otherwise(generated),
        "match_highlight_mode": F.when(F.col("match_highlight_mode").isin(*HIGHLIGHT_MODES), F.col("match_highlight_mode")).otherwise("whole_word"),
    }).withColumn("page_text_terms", T.page_terms("title", "artist", "date", "medium", "description", "attribution", "license"))


def provider_window(df: DataFrame, order: list, offset: int, size: int, key: str = "source") -> DataFrame:
    """Rows offset .. offset + size of each source in its own order, numbered from 0. The rank limit is pushed below the
    shuffle, so that a source sends offset + size rows a task at most."""
    ranked = df.withColumn("provider_rank", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    return ranked.where(F.col("provider_rank") <= offset + size).where(F.col("provider_rank") > offset).withColumn("provider_rank", F.col("provider_rank") - 1)


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row a key, the first in order, as an aggregate: combined in the tasks before any shuffle."""
    rest = [c for c in df.columns if c not in keys]
    ranked = df.withColumn("__order", F.struct(*order))
    best = ranked.groupBy(*keys).agg(F.min_by(F.struct(*rest), "__order").alias("__row"))
    return best.select(*keys, "__row.*")


def ordered_union(frames: list[DataFrame], keys: list[str], order: list[str]) -> DataFrame:
    """Union without repeats of a key: rows of earlier frames win, then those first in order."""
    tagged = [f.withColumn("priority", F.lit(k)) for k, f in enumerate(frames)]
    union = tagged[0]
    for f in tagged[1:]:
        union = union.unionByName(f)
    return first_by(union, keys, [F.col("priority"), *map(F.col, order)])


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New rows replace old ones of the same key."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def resolve_dimensions(items: DataFrame, dims: DataFrame, on: str) -> DataFrame:
    """Width and height from `dims` where the item lacks either."""
    joined = items.join(dims.select(on, F.col("width").alias("w"), F.col("height").alias("h")), on, "left")
    lacks = (F.col("width") == 0) | (F.col("height") == 0)
    return joined.withColumns({"width": F.when(lacks, F.coalesce("w", "width")).otherwise(F.col("width")), "height": F.when(lacks, F.coalesce("h", "height")).otherwise(F.col("height"))}).drop("w", "h")


def probe_sizes(items: DataFrame, files: DataFrame, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Items whose width or height is missing with the sizes that their images' headers tell, and all probed sizes (url, width,
    height) to be known next time. `files` (url, content) are images by address. An item's image counts, else its thumbnail;
    each address is probed once; what no header tells is 0, so it isn't asked for again."""
    address = F.coalesce(F.nullif("image_url", F.lit("")), F.nullif("thumb_url", F.lit("")))
    lacks = (F.coalesce("width", F.lit(0)) == 0) | (F.coalesce("height", F.lit(0)) == 0)
    wanted = items.where(lacks).select(address.alias("url")).where("url is not null").distinct()
    if known is not None:
        wanted = wanted.join(known.select("url"), "url", "left_anti")
    probed = first_by(files.select("url", "content").join(wanted, "url", "left_semi"), ["url"], [F.col("content")])
    size = probed.select("url", I.header_sizes(F.col("content")).alias("s")).select("url", F.coalesce("s.width", F.lit(0)).alias("width"), F.coalesce("s.height", F.lit(0)).alias("height"))
    sizes = size if known is None else known.select("url", "width", "height").unionByName(size)
    found = sizes.select("url", F.col("width").alias("__w"), F.col("height").alias("__h"))
    joined = items.withColumn("__lacks", lacks).withColumn("__url", F.when(F.col("__lacks"), address)).join(found, F.col("__url") == F.col("url"), "left")
    filled = joined.withColumns({"width": F.when(F.col("__lacks"), F.coalesce("__w", F.lit(0))).otherwise(F.col("width")), "height": F.when(F.col("__lacks"), F.coalesce("__h", F.lit(0))).otherwise(F.col("height"))})
    return filled.drop("__lacks", "__url", "__w", "__h", "url"), sizes
