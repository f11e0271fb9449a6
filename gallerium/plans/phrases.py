"""Searches for exact phrases: results of several phrases that agree, and batches that are verified before they are cut."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..functions import text as T
from ..operators.families import stored

# The window of a batch, in batches, and its bounds.
WINDOW_BATCHES, LEAST_WINDOW, MOST_WINDOW = 20, 40, 400
KEY = ("source_id", "page_url", "image_url")


def result_key(*names: str) -> Column:
    return F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in names or KEY])


def in_every_group(groups: list[DataFrame], *key: str) -> DataFrame:
    """Rows of the first group whose key is in all others, as they stand there."""
    first, *others = groups
    out = first.withColumn("__key", result_key(*key))
    for other in others:
        out = out.join(other.select(result_key(*key).alias("__key")).distinct(), "__key", "left_semi")
    return out.drop("__key")


def candidates(search: Callable[[str], DataFrame], free: str, phrases: list[str], *key: str) -> DataFrame:
    """What a source that takes one phrase at a time finds for all phrases; without phrases, for the free text."""
    return in_every_group([search(p) for p in phrases or [free]], *key)


def batch(rows: DataFrame, order: list[Column], offset: int, size: int) -> tuple[DataFrame, bool]:
    """Rows `offset` to `offset + size` in order, numbered in provider_rank, and whether there are none beyond. The limit is
    pushed below the sort's exchange."""
    window = rows.orderBy(*order).limit(offset + size + 1).collect()  # a window, not a table
    schema = StructType([*rows.schema.fields, StructField("provider_rank", LongType())])
    cut = [(*r, k) for k, r in enumerate(window[: offset + size]) if k >= offset]
    return rows.sparkSession.createDataFrame(cut, schema), len(window) <= offset + size


def exact_batch(fetch: Callable[[int], DataFrame], fields: list[str], phrases: list[str], order: list[Column], offset: int, size: int) -> tuple[DataFrame, bool, int]:
    """A batch of rows that hold every phrase, whether there are none beyond, and the window that was fetched. fetch(n) gives
    a provider's first n rows. The window doubles until enough are verified, the provider has no more, or it is at its most."""
    window = min(max(size * WINDOW_BATCHES, LEAST_WINDOW), MOST_WINDOW)
    while True:
        fetched = stored(fetch(window))
        verified = fetched.where(T.matches_phrases(fields, phrases))
        more = fetched.count() >= window and window < MOST_WINDOW
        if not more or verified.count() >= offset + size:
            rows, ends = batch(verified, order, offset, size)
            return rows, ends and not more, window
        window = min(2 * window, MOST_WINDOW)


PAGE = 1000  # fixed value: candidates of an exact search that a provider gives at once


def phrase_pages(fetch: Callable[[int, int], tuple[DataFrame, int]], query: str, fields: list[str], need: int, exact: bool = False) -> DataFrame:
    """The first `need` rows of a provider whose search knows no phrases: fetch(skip, limit) gives candidates in order (with
    `ordinal`) and how many there are. With quotation marks, or if exact, pages are read until enough rows hold every phrase
    in one field, or none are left; without, one page of twice as many as needed is taken as it is."""
    parsed = T.parse_query(query, exact)
    if not parsed["phrases"]:
        return fetch(0, need * 2)[0].orderBy("ordinal").limit(need * 2)
    found, at, total = None, 0, 1
    while at < total and (found is None or found.count() < need):
        page, total = fetch(at, PAGE)
        held = stored(page.where(T.matches_phrases(fields, parsed["phrases"])))
        found = held if found is None else found.unionByName(held)
        at += PAGE
    return found.orderBy("ordinal").limit(need)
