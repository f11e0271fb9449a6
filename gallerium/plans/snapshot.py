"""Snapshots of a search: finished scores, families by key and by likeness, positions, pending fingerprints; similar items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring as S
from ..operators import families
from ..operators.items import ordered_union

PERCEPTUAL = 24  # candidates whose fingerprints are compared
SEMANTIC_SHARE = 0.72


def finish(items: DataFrame, semantic: Column, learned: Column) -> DataFrame:
    """Items with their scores and whether they are complete; rank_score is of the best kind there is."""
    shown = items.withColumns({"semantic_score": S.semantic_score(semantic), "learned_score": S.clamp(learned)})
    whole = shown.withColumns({"rerank": F.col("learned_score").isNotNull(), "scoring_complete": F.col("semantic_score").isNotNull() & F.col("learned_score").isNotNull()})
    score = S.rank_score(F.col("width"), F.col("height"), F.col("learned_score"), F.col("rerank"), F.col("semantic_score"), F.col("metadata_score"))
    return whole.withColumn("rank_score", score)


def vector_classes(items: DataFrame) -> DataFrame:
    """(rep, embedding) and members: items of one vector speak through the smallest id, so copies never pair up."""
    return items.where("embedding is not null").groupBy("embedding").agg(F.min("vec_id").alias("rep"))


def image_edges(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Items (vec_id, embedding, width, height, ready, color, gray, dhash, aspect) to edges (a, b) of the same image and to
    ids whose fingerprint a decision waits for (pending). Pairs come from random projections, between different vectors;
    items of equal vectors meet through the first item of their vector, and are judged by the same rules."""
    near = families.image_pairs(vector_classes(items).select(F.col("rep").alias("vec_id"), "embedding"))
    reps = items.join(vector_classes(items), "embedding").select("rep", "vec_id").where("rep <> vec_id")
    pairs = near.select("a", "b", "cosine").unionAll(reps.select(F.col("rep").alias("a"), F.col("vec_id").alias("b"), F.lit(1.0).alias("cosine")))
    parts = F.struct("color", "gray", "dhash", "aspect")
    own = lambda n: items.select(F.col("vec_id").alias(n), F.struct("width", "height", "ready", parts.alias("f")).alias(f"i{n}"))
    both = pairs.join(own("a"), "a").join(own("b"), "b").withColumn("distance", S.aspect_distance(F.col("ia.width"), F.col("ia.height"), F.col("ib.width"), F.col("ib.height"))).where("distance <= 0.2")
    ready = F.col("ia.ready") & F.col("ib.ready")
    perceptual = F.when(F.col("ia.f.color").isNotNull() & F.col("ib.f.color").isNotNull(), S.feature_similarity(F.col("ia.f"), F.col("ib.f")))
    edges = both.where(ready).where(S.same_image(F.col("cosine"), F.col("distance"), perceptual)).select("a", "b")
    waits = both.where(~ready).select(F.explode(F.array_compact(F.array(F.when(~F.col("ia.ready"), F.col("a")), F.when(~F.col("ib.ready"), F.col("b"))))).alias("vec_id")).distinct()
    return edges, waits


def positions(ranked: DataFrame, labels: DataFrame, n: int) -> DataFrame:
    """(component, representative, position) of the first n families. Only members with a learned score count for the
    position; the shown representative is the one of best resolution, which may be another member."""
    member = ranked.join(labels, ranked["id"] == labels["node"], "left").withColumn("component", F.coalesce("component", "id"))
    order = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(families.resolution_order())], F.col("id").alias("k9"))
    scored = F.col("learned_score").isNotNull() & F.col("rerank")
    quality = F.when(scored, F.struct((-F.col("rank_score")).alias("s"), F.col("provider_rank").alias("p"), F.col("source").alias("c"), F.col("title").alias("t")))
    best = member.groupBy("component").agg(F.min_by("id", order).alias("representative"), F.min(quality).alias("q")).where("q is not null")
    return best.orderBy("q", "representative").limit(n).withColumn("position", F.row_number().over(Window.orderBy("q", "representative"))).select("component", "representative", "position")


def similar(items: DataFrame, target: dict, n: int) -> DataFrame:
    """The n items most like the target (embedding, words, width, height, and optionally a fingerprint): cosine, or words and
    proportions without vectors, name the candidates for the fingerprint's comparison, whose part is 28 of 100."""
    distance = S.aspect_distance(F.col("width"), F.col("height"), F.lit(target["width"]), F.lit(target["height"]))
    fallback = S.metadata_fallback(F.col("words"), F.array(*map(F.lit, target["words"])).cast("array<string>"), distance)
    cosine = S.dot(F.col("embedding"), S.vector_literal(target["embedding"])) if target.get("embedding") is not None else F.lit(None).cast("double")
    judged = items.withColumns({"__c": cosine, "__m": fallback}).withColumn("__first", F.coalesce("__c", "__m"))
    blend = lambda second: F.round(F.when(F.col("__c").isNotNull(), SEMANTIC_SHARE * F.col("__c") + (1 - SEMANTIC_SHARE) * second).otherwise(second), 4)
    if target.get("fingerprint") is None:
        return judged.withColumn("similarity", blend(F.col("__m"))).orderBy(F.desc("similarity"), F.desc("rank_score"), "id").limit(n).drop("__c", "__m", "__first")
    f = target["fingerprint"]
    mine = F.struct(S.vector_literal(f["color"]).alias("color"), S.vector_literal(f["gray"]).alias("gray"), F.array(*[F.lit(bool(x)) for x in f["dhash"]]).alias("dhash"), F.lit(float(f["aspect"])).alias("aspect"))
    nominated = judged.orderBy(F.desc("__first"), F.desc("rank_score"), "id").limit(PERCEPTUAL).select("id", F.lit(True).alias("__near"))
    rows = judged.join(F.broadcast(nominated), "id", "left")  # at most PERCEPTUAL rows
    like = F.when(F.col("__near") & F.col("fingerprint").isNotNull(), S.feature_similarity(F.col("fingerprint"), mine)).otherwise(F.col("__m"))
    return rows.withColumn("similarity", blend(like)).orderBy(F.desc("similarity"), F.desc("rank_score"), "id").limit(n).drop("__c", "__m", "__first", "__near")


def related(items: DataFrame, labels: DataFrame, target_id: str, target: dict, n: int) -> tuple[DataFrame, DataFrame]:
    """The target's alternates by area and side, and the items similar to it outside its family."""
    own = labels.where(F.col("node") == target_id).select("component")
    family = labels.join(F.broadcast(own), "component").select(F.col("node").alias("id"))  # `own` is one row
    area = F.col("width").cast("long") * F.col("height")
    alternates = items.join(family, "id", "left_semi").where(F.col("id") != target_id).orderBy(F.desc(area), F.desc(F.least("width", "height")), "id")
    others = items.join(family, "id", "left_anti").where(F.col("id") != target_id)
    return alternates, similar(others, target, n)


def catalog_search(standard: DataFrame, fuzzy: DataFrame, variants: list[DataFrame], n: int) -> DataFrame:
    """Standard results, then those of word forms where the fuzzy search found nothing, then fuzzy ones; each source_id once,
    from the first list that has it. All lists have the columns source_id and ord."""
    lists = [standard, *([] if fuzzy.limit(1).count() else variants), fuzzy]
    merged = ordered_union([f.where("source_id <> ''") for f in lists], ["source_id"], ["ord"])
    return merged.orderBy("priority", "ord").limit(2 * n)

