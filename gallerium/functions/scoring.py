"""Scores as column expressions: text, size, semantic and learned ones, and image similarity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as T

# The constants of the scoring formulas.
TITLE_PHRASE, DESCRIPTION_PHRASE = 5.0, 2.4
TITLE_COVERAGE, DESCRIPTION_COVERAGE, PRECISION, ALL_TERMS = 4.6, 2.8, 1.1, 1.0
PROVIDER_ORDER, CURATED_BOOST, OPEN_LICENSE = 1.55, 0.22, 0.10
SEMANTIC_LOW, SEMANTIC_SPAN = -0.05, 0.27
ARTIFACT_MIDPOINT, ARTIFACT_TEMPERATURE, CLIP = -0.0466, 0.0113, 8.0
FEATURE_WEIGHTS = {"color": 0.52, "gray": 0.18, "dhash": 0.22, "aspect": 0.08}


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """x within bounds; null stays null, which greatest and least would take for a bound."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def metadata_score(query: str, title_words: Column, description_words: Column, provider_rank: Column, source: Column, license: Column, curated: str = "curated") -> Column:
    """The text score of an item: phrases, coverage of title and description (given as folded words, so that a plan folds
    each text once), provider order and small boosts."""
    q, n = T.fold_exact_py(query), len(T.query_tokens(query))

    def by_words(m: Column) -> Column:
        in_title, in_description = F.size(m["title"]), F.size(m["description"])
        score = F.when(m["title_phrase"], TITLE_PHRASE).when(m["description_phrase"], DESCRIPTION_PHRASE).otherwise(0.0)
        if n:
            score = score + TITLE_COVERAGE * (in_title / F.lit(float(n))) + DESCRIPTION_COVERAGE * (in_description / F.lit(float(n)))
            score = score + F.when(in_title > 0, PRECISION * (in_title / F.greatest(m["title_size"], F.lit(1)))).otherwise(0.0)
            score = score + F.when(F.size(F.array_union(m["title"], m["description"])) == n, ALL_TERMS).otherwise(0.0)
        return score

    phrase = lambda words: F.array_join(words, " ").contains(q) if q else F.lit(False)
    title, description = T.terms(title_words), T.terms(description_words)
    met = F.struct(
        T.let(title, lambda t: F.struct(T.matched(query, t).alias("title"), F.size(t).alias("title_size"))).alias("t"),
        T.matched(query, description).alias("description"), phrase(title_words).alias("title_phrase"), phrase(description_words).alias("description_phrase"),
    )
    flat = lambda m: F.struct(m["t"]["title"].alias("title"), m["t"]["title_size"].alias("title_size"), m["description"].alias("description"), m["title_phrase"].alias("title_phrase"), m["description_phrase"].alias("description_phrase"))
    score = T.let(T.let(met, flat), by_words)
    score = score + PROVIDER_ORDER / F.sqrt(F.greatest(F.coalesce(provider_rank, F.lit(0)), F.lit(0)) + 1.0)
    score = score + F.when(source == curated, CURATED_BOOST).otherwise(0.0)
    open_license = T.let(T.fold(license), lambda folded: folded.contains("cc0") | folded.contains("public domain") | folded.contains("cc by"))
    return F.round(score + F.when(open_license, OPEN_LICENSE).otherwise(0.0), 5)


def size_score(width: Column, height: Column) -> Column:
    area = width.cast("double") * height.cast("double")
    return F.when((width > 0) & (height > 0), F.log2(area)).otherwise(0.0)


def rank_score(width: Column, height: Column, learned: Column, rerank: Column, semantic: Column, metadata: Column) -> Column:
    """Size times the learned score where reranking applies, else times the semantic score, else the text score."""
    size = size_score(width, height)
    return F.round(F.when(rerank & learned.isNotNull(), size * clamp(learned)).when(semantic.isNotNull(), size * clamp(semantic)).otherwise(metadata), 5)


def dot(a: Column, b: Column) -> Column:
    """The dot product; for unit vectors, the cosine."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def vector_literal(values) -> Column:
    return F.array(*[F.lit(float(x)) for x in values])


def semantic_score(cosine: Column) -> Column:
    return F.round(clamp((cosine - SEMANTIC_LOW) / SEMANTIC_SPAN), 5)


def sigmoid(z: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-clamp(z, -CLIP, CLIP)))


def learned_scores(raw: Column, center: float, scale: float, artifact: Column, digits: int = 6) -> dict[str, Column]:
    """The learned score's parts: base sigmoid of the robustly scaled projection, retention of artworks over book pages."""
    base, retention = sigmoid((raw - center) / scale), sigmoid((artifact - ARTIFACT_MIDPOINT) / ARTIFACT_TEMPERATURE)
    return {k: F.round(c, digits) for k, c in (("raw_score", raw), ("base_score", base), ("retention", retention), ("learned_score", base * retention))}


def aspect(width: Column, height: Column) -> Column:
    one = lambda x: F.when(F.coalesce(x, F.lit(0)) == 0, 1).otherwise(x)
    return F.greatest(one(width) / F.greatest(F.coalesce(height, F.lit(1)), F.lit(1)), F.lit(0.05))


def aspect_distance(w1: Column, h1: Column, w2: Column, h2: Column) -> Column:
    return F.abs(F.log(aspect(w1, h1) / aspect(w2, h2)))


def same_image(semantic: Column, distance: Column, perceptual: Column) -> Column:
    """The same-image cascade: the nearer the vectors, the less the fingerprints must agree; null fingerprints need more."""
    near = (semantic >= 0.90) & (distance <= 0.20)
    tier = (
        F.when(perceptual.isNull(), (semantic >= 0.992) & (distance < 0.08))
        .when(semantic >= 0.98, perceptual >= 0.70)
        .when(semantic >= 0.965, perceptual >= 0.86)
        .when(semantic >= 0.955, perceptual >= 0.92)
        .otherwise((perceptual >= 0.955) & (distance < 0.08))
    )
    return F.coalesce(near & tier, F.lit(False))


def feature_similarity(a: Column, b: Column) -> Column:
    """Likeness of two fingerprints (color, gray: unit arrays; dhash: booleans; aspect)."""
    agree = F.aggregate(F.zip_with(a["dhash"], b["dhash"], lambda x, y: (x == y).cast("double")), F.lit(0.0), lambda s, x: s + x) / F.size(a["dhash"])
    w = FEATURE_WEIGHTS
    return w["color"] * dot(a["color"], b["color"]) + w["gray"] * dot(a["gray"], b["gray"]) + w["dhash"] * agree + w["aspect"] * F.exp(-F.abs(a["aspect"] - b["aspect"]))


def metadata_fallback(words1: Column, words2: Column, distance: Column) -> Column:
    """Likeness by words and proportions, for images without fingerprints."""
    union = F.size(F.array_union(words1, words2))
    return 0.7 * F.when(union > 0, F.size(F.array_intersect(words1, words2)) / union).otherwise(0.0) + 0.3 * F.exp(-distance)


def quantiles(frame: DataFrame, column: str, shares: list[float], error: float = 1e-4) -> list[float | None]:
    """Exact quantiles, interpolated between neighbours; None of no values. Bounds around each come from sketches that tasks
    merge, and only values between them, a few times `error` of all, are sorted; no task has all values."""
    values = frame.where(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("v"))
    n = values.count()
    if not n:
        return [None] * len(shares)
    edges = sorted({min(1.0, max(0.0, s + d)) for s in shares for d in (-3 * error - 2 / n, 3 * error + 2 / n)})
    bounds = dict(zip(edges, values.approxQuantile("v", edges, error)))
    out = []
    for s in shares:
        low, high = (bounds[min(1.0, max(0.0, s + d))] for d in (-3 * error - 2 / n, 3 * error + 2 / n))
        at = s * (n - 1)
        skip = int(at) - values.where(F.col("v") < low).count()
        inside = [r.v for r in values.where(F.col("v").between(low, high)).orderBy("v").offset(max(skip, 0)).limit(2).collect()]
        out.append(inside[0] if len(inside) == 1 or at == int(at) else inside[0] + (at - int(at)) * (inside[1] - inside[0]))
    return out
