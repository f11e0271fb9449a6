"""Whole searches: scored items, families, related items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scoring as S
from ..functions import text as T
from ..operators import families



def order() -> list[Column]:
    return [F.desc("rank_score"), F.asc("provider_rank"), F.asc("source"), F.asc("title"), F.asc("id")]


def scored(items: DataFrame, query: str) -> DataFrame:
    """Items with their text score as rank_score."""
    description = F.concat_ws(" ", "description", "medium", "artist", "date")
    words = items.withColumns({"__title": T.fold_tokens("title"), "__description": T.fold_tokens(description)})
    score = S.metadata_score(query, F.col("__title"), F.col("__description"), F.col("provider_rank"), F.col("source"), F.col("license"))
    return words.withColumn("rank_score", score).drop("__title", "__description")


def top(items: DataFrame, n: int) -> DataFrame:
    """The first n items in order, with their position: the limit runs in the tasks, the numbering over n rows."""
    from pyspark.sql import Window

    return items.orderBy(*order()).limit(n).withColumn("position", F.row_number().over(Window.orderBy(*order())))


def matching(items: DataFrame, query: str) -> DataFrame:
    """Items that hold the query's phrases and all its words."""
    parsed = T.parse_query(query)
    return items.where(T.matches_phrases(("title", "artist", "description"), parsed["phrases"]) & T.has_all_terms(F.col("page_text_terms"), parsed["retrieval"]))


def search(items: DataFrame, query: str, n: int) -> DataFrame:
    """Scored items folded into families, best first."""
    ranked = scored(items, query)
    labels = families.components(families.key_edges(ranked, "id"))
    return families.collapse(ranked, labels, "id").orderBy(F.desc("rank_score"), "id").limit(n)


def related(vectors: DataFrame, target, n: int) -> DataFrame:
    """The items nearest to a target by cosine."""
    return vectors.withColumn("similarity", F.round(S.dot(F.col("embedding"), S.vector_literal(target)), 4)).orderBy(F.desc("similarity"), "vec_id").limit(n)
