"""Catalogs: an inverted index with BM25, focus rules, fuzzy search, and incremental refresh."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .families import stored
from .items import upsert

K1, B = 1.2, 0.75
FIELD_BOOSTS = {"title": 1.12, "filename": 1.10, "alt": 1.06, "keywords": 1.05, "figures": 1.05}
FUZZY_LEAST = 0.72


def _weighted(fields: dict[str, float]) -> Column:
    """The tokens of all fields, each with its field's weight."""

    def one(name: str, weight: float) -> Column:
        return F.transform(T.fold_tokens(name), lambda t: F.struct(t.alias("token"), F.lit(float(weight)).alias("w")))

    return F.concat(*[one(c, w) for c, w in fields.items()])


def bm25(docs: DataFrame, key: str, fields: dict[str, float], query: str) -> DataFrame:
    """(key, score) of rows that hold every query token (a single token also as a prefix); lower is better."""
    terms = list(dict.fromkeys(T.fold_exact_py(query).split()))
    if not terms:
        return docs.where("false").select(key, F.lit(0.0).alias("score"))
    hit = lambda t, term: t["token"].startswith(term) if len(terms) == 1 else t["token"] == term
    frequency = lambda term: F.aggregate(F.filter("t", lambda t: hit(t, term)), F.lit(0.0), lambda s, t: s + t["w"])
    rows = docs.select(key, _weighted(fields).alias("t")).select(key, F.size("t").alias("size"), *[frequency(x).alias(f"f{i}") for i, x in enumerate(terms)])
    rows = stored(rows)  # a few numbers a row, read twice: for the statistics of the whole table and for the scores
    found = rows.agg(F.count("*").alias("rows"), F.avg("size").alias("average"), *[F.count_if(F.col(f"f{i}") > 0).alias(f"n{i}") for i in range(len(terms))]).first()
    score = F.lit(0.0)
    for i in range(len(terms)):
        n = found[f"n{i}"]
        idf = math.log((found.rows - n + 0.5) / (n + 0.5))
        f = F.col(f"f{i}")
        score = score - (idf if idf > 0 else 1e-6) * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("size") / F.lit(found.average)))
    every = F.lit(True)
    for i in range(len(terms)):
        every = every & (F.col(f"f{i}") > 0)
    return rows.where(every).select(key, score.alias("score"))


def terms_are_close(tokens: Column, terms: list[str], reach: int = 12) -> Column:
    """All terms stand within `reach` tokens of some occurrence of the first one. Each term's places are found once."""
    places = lambda t: F.array(*[F.filter(F.transform(t, lambda x, i: F.when(x == term, i)), lambda i: i.isNotNull()) for term in terms])
    near = lambda at, others: F.exists(others, lambda i: F.abs(i - at) <= reach)
    each = lambda p: F.exists(p[0], lambda at: F.forall(F.slice(p, 2, max(len(terms) - 1, 1)), lambda others: near(at, others)))
    return T.let(T.let(tokens, places), each)


def fuzzy_score(record: dict, phrase: str, words: list[str]) -> tuple[float, str]:
    """The best weighted field: a field that holds the phrase scores 1, else the token set ratio."""
    best, name = 0.0, ""
    for field, value in record.items():
        folded = T.fold_exact_py(value)
        if not [w for w in folded.split() if len(w) > 1 and w not in T.FUZZY_STOP_WORDS]:
            continue
        score = (1.0 if phrase in folded else T.token_set_ratio(phrase, folded) / 100) * FIELD_BOOSTS.get(field, 1.0)
        if score > best:
            best, name = score, field
    return min(best, 1.0), name


def fuzzy_search(records: DataFrame, key: str, fields: list[str], query: str, limit: int) -> DataFrame:
    """(key, fuzzy_score, fuzzy_field) of the best records, then by key; an empty query or limit finds nothing."""
    phrase = T.fold_exact_py(query)
    words = T.query_tokens(query, T.FUZZY_STOP_WORDS)
    kind = records.schema[key].dataType.simpleString()

    def run(frames):
        for frame in frames:
            scored = [fuzzy_score(dict(zip(fields, row)), phrase, words) for row in frame[fields].itertuples(index=False)]
            yield pd.DataFrame({key: frame[key], "fuzzy_score": [s for s, _ in scored], "fuzzy_field": [f for _, f in scored]})

    scored = records.select(key, *fields).mapInPandas(run, f"{key} {kind}, fuzzy_score double, fuzzy_field string")
    return scored.where((F.col("fuzzy_score") >= FUZZY_LEAST) & F.lit(bool(words) and limit > 0)).orderBy(F.desc("fuzzy_score"), key).limit(max(limit, 0)).withColumn("fuzzy_score", F.round("fuzzy_score", 4))


def refresh(cached: DataFrame, changed: DataFrame, full: DataFrame, key: str, stamp: str) -> tuple[str, DataFrame]:
    """Unchanged if count and latest stamp agree, else merged with what changed if that gives the full count, else replaced."""
    have = cached.agg(F.count("*").alias("n"), F.max(stamp).alias("latest")).first()
    there = full.agg(F.count("*").alias("n"), F.max(stamp).alias("latest")).first()
    if (have.n, have.latest) == (there.n, there.latest):
        return "unchanged", cached
    merged = upsert(cached, changed, key)
    return ("incremental", merged) if merged.count() == there.n else ("full", full)


def overlap(stamp: Column, seconds: int = 2) -> Column:
    """Where an incremental load begins: a little before the latest stamp."""
    return stamp - F.expr(f"INTERVAL {seconds} SECONDS")
