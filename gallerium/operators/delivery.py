"""How an item is shown: where a click leads, what may be downloaded, which hosts a proxy may fetch from."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def previews(df: DataFrame, curated: str = "curated", mirrored: str = "aic", delivery: str = "commons") -> DataFrame:
    """df (source, page_url, image_url, full_resolution_url, image_delivery, requires_source_visit) with preview_click_url,
    preview_click_action and download_url. Curated items open their image, others their page; items of the mirrored source
    that aren't delivered by the open mirror must be visited."""
    value = lambda c: F.coalesce(F.col(c), F.lit(""))
    filled = lambda c: F.nullif(value(c), F.lit(""))
    visit = F.coalesce(F.col("requires_source_visit"), F.lit(False)) | ((value("source") == mirrored) & (value("image_delivery") != "") & (value("image_delivery") != delivery))
    original = (value("source") == curated) & (value("image_url") != "")
    return df.withColumns({
        "preview_click_url": F.when(original, F.col("image_url")).otherwise(F.coalesce(filled("page_url"), filled("full_resolution_url"), value("image_url"))),
        "preview_click_action": F.when(original, "open_original").otherwise("open_page"),
        "download_url": F.when(visit, "").otherwise(value("image_url")),
    })


def full_size_url(url: Column) -> Column:
    """An address of the web, or nothing."""
    return F.when(url.rlike("^(?i)https?://[^/\\s]+"), url).otherwise("")


def may_proxy(url: Column, hosts: Iterable[str] | Column) -> Column:
    """Only secure addresses of listed hosts; a column holds the one listed host that a row was joined with, or null."""
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    listed = host == hosts if isinstance(hosts, Column) else host.isin(*hosts)
    return F.coalesce((F.try_parse_url(url, F.lit("PROTOCOL")) == "https") & listed, F.lit(False))


def enough_pixels(width: Column, height: Column, megapixels: float) -> Column:
    """Whether an image has at least so many million pixels; unknown sizes have none."""
    return F.coalesce(width.cast("long") * height >= megapixels * 1_000_000, F.lit(False))


def slug(title: Column | str) -> Column:
    """Lower-case ASCII words of a title joined by hyphens; other letters are lost."""
    return F.array_join(T.fold_tokens(title), "-")


def artwork_url(base: str, object_id: Column, title: Column | str) -> Column:
    words = slug(title)
    return F.concat(F.lit(base), object_id, F.when(words != "", F.concat(F.lit("-"), words)).otherwise(""))


def in_sources(df: DataFrame, sources: list[str], query: str = "", all_terms: bool = False) -> DataFrame:
    """Items of the chosen sources, and with all words of the query if asked for."""
    kept = df.where(F.col("source").isin(*sources)) if sources else df.where("false")
    return kept.where(T.has_all_terms(F.col("page_text_terms"), query)) if all_terms else kept


def source_of_domain(df: DataFrame, host: str, domains: list[tuple[str, str]]) -> DataFrame:
    """df with the first source, in order, whose domain is the host or a suffix of it: an expression, as domains are few."""
    found = F.coalesce(*[F.when(T.host_matches(F.col(host), domain), F.lit(source)) for source, domain in domains])
    return df.withColumn("source", found)


def attach_vectors(df: DataFrame, vectors: DataFrame) -> DataFrame:
    """df with the vector of its thumbnail, else of its image. Both addresses are looked up in one join; each row then keeps
    its first answer."""
    rows = df.withColumn("__id", F.monotonically_increasing_id())
    asked = rows.select("__id", F.posexplode(F.array("thumb_url", "image_url")).alias("at", "url")).where("url <> ''")
    found = asked.join(vectors.select("url", "vector"), "url").groupBy("__id").agg(F.min_by("vector", "at").alias("vector"))
    return rows.join(found, "__id", "left").drop("__id")
