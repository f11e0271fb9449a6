"""From raw documents to packed training sequences: five stages, each written and read again before the next one.

A stage carries the columns of documents that its input has (doc_id and text at least) and leaves out all others. Null and
empty texts are no error in any stage: language ID drops them, as it finds no letters. An empty table stays empty."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gallerium.llm import language, minhash_join, packing, suffix_dedup, toxicity
from gallerium.llm.common import arrow_map, documents, scratch_dir
from gallerium.llm.queries import vocabulary

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
LEAST_LANGUAGE_SCORE = 0.15  # the share of n-grams that the best language explains; text in any learned language is far above
WORDS, PERCENT = 5, 80


def _kinds(docs: DataFrame) -> list[str]:
    return [c for c in docs.columns if c in COLUMNS]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a learned language explains; texts without letters or in none of the languages go."""
    filters = language.learn(docs.where("lang is not null").select("doc_id", "text", "lang"))
    found = language.identify(docs, filters, ["text", *(c for c in _kinds(docs) if c != "text")])
    return found.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE_SCORE)).select(*_kinds(docs))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents not predicted toxic; null and empty texts stay, rows that repeat are scored each."""
    model = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model, _kinds(docs)).where("predicted = 0").select(*_kinds(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates, the one with the smallest doc_id (then text hash). Documents without
    words have no duplicates, and rows without a doc_id stay. Rows that share a doc_id are documents of their own; of rows
    with one doc_id and text the first by their other columns stays."""
    found = minhash_join.components(docs, WORDS, PERCENT).where("kept")
    linked = found.where("link_group is not null").groupBy("link_group").agg(F.min(F.struct("doc_id", "text_key")).alias("first")).select("first.*")
    kept = linked.unionByName(found.where("link_group is null").select("doc_id", "text_key").distinct())
    keyed = docs.select(*_kinds(docs), F.xxhash64(F.col("text").cast("string")).alias("text_key"))
    own = Window.partitionBy("doc_id", "text_key").orderBy(*[c for c in _kinds(docs) if c not in ("doc_id", "text")], "text")
    one = keyed.join(kept, ["doc_id", "text_key"], "left_semi").withColumn("copy", F.row_number().over(own)).where("copy = 1")
    return one.select(*_kinds(docs)).unionByName(docs.where("doc_id is null").select(*_kinds(docs)))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes that repeat anywhere; what is left of a cut character goes, too. A text of which nothing but
    white space is left goes."""
    rows = suffix_dedup.repeated_spans(docs.select(*_kinds(docs)))
    carried = [c for c in _kinds(docs) if c not in ("text", "n_chars")]
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carried)

    def make():
        def step(batch):
            texts = []
            for text, spans in zip(batch.column("text"), batch.column("spans")):
                data = (text.as_py() or "").encode("utf-8", "surrogatepass")
                texts.append(suffix_dedup.kept_bytes(data, suffix_dedup.merged(spans.as_py())).decode("utf-8", "ignore") if spans.is_valid else text.as_py())
            yield {"text": texts, **{c: batch.column(c) for c in carried}}

        return step

    cut = arrow_map(rows, f"text string, {kinds}", make)
    return cut.where(F.trim(F.coalesce("text", F.lit(""))) != "").withColumn("n_chars", F.length("text").cast("long")).select(*_kinds(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of full sequences; a null or empty text is its end mark alone, rows that repeat are packed each."""
    return packing.pack(docs, vocabulary())


STAGES = [("language_id", language_id), ("toxicity", drop_toxic), ("near_dedup", near_dedup), ("suffix_dedup", cut_repeats), ("packing", pack)]

#: The stages learn models and cut texts by hashes and vocabularies that SQL has no words for; tests/llm runs them by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table `documents` of `sf_dir`; the result is the last one's."""
    docs = documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
    raise AssertionError
