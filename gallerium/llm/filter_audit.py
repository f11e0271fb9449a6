"""How filters interact: what every order of them keeps, removes and removes in vain, by aggregation over a lattice's edges.

A document fails a set of the filters. All that any order does with it at a step depends on that set, on the filters applied
before the step (as a set, not as an order) and on the step's filter: 80 pairs (applied subset, next filter) are the edges of
the lattice of subsets. Documents are counted by their failures first, these few counts contribute to the 80 edges, and the 600
steps of the 120 orders are paths of edges: a join of two small tables. A filter's Shapley sum weighs each edge by the number of
orders that pass through it.

Null texts count as empty, a null part as an empty string. Rows that repeat count each; a document that shares its doc_id with
an equal one doesn't repeat it, as only a smaller doc_id does. A null doc_id is neither smaller nor larger than another and has
no labels; of several labels of a document the largest counts. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations, permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

FILTERS = "ABCDE"
REPEATED = "E"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
LEAST_WORDS, LEAST_DISTINCT_PERCENT, MOST_UPPER_PERCENT = 200, 50, 2
_SPACE = r"[\x20\x09-\x0D]+"


def bit(name: str) -> int:
    return 1 << FILTERS.index(name)


def bits(names) -> int:
    return sum(map(bit, names))


def own_failures(text: Column, words: Column) -> Column:
    """The failures that a text alone decides, as bits."""
    n = F.size(words)
    fails = {
        "A": n < LEAST_WORDS,
        "B": 100 * F.size(F.array_distinct(words)) < LEAST_DISTINCT_PERCENT * n,
        "C": 100 * (F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))) > MOST_UPPER_PERCENT * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }
    return sum((F.when(failed, bit(name)).otherwise(0) for name, failed in fails.items()), F.lit(0))


def failures(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """(part, fails, quality, toxic, n): rows of `docs` (doc_id, text, part) counted by the bits of the filters that they fail.

    The texts are read once; what is shuffled after that is a digest a document. Copies of one text never meet in one task:
    the smallest doc_id of each digest is pre-aggregated and met by (digest, doc_id) again."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    split = docs.select("doc_id", F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    split = split.select("doc_id", "part", "text", F.array_remove(F.split("text", _SPACE), "").alias("words"))
    rows = materialize(split.select("doc_id", "part", own_failures(F.col("text"), F.col("words")).alias("own"), F.unhex(F.sha2("text", 256)).alias("digest")), "failures")
    first = rows.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    marked = rows.join(first, ["digest", "doc_id"], "left")
    own = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    repeats = F.when(F.col("first").isNull() & F.col("doc_id").isNotNull(), bit(REPEATED)).otherwise(0)
    known = marked.join(own, "doc_id", "left")
    return known.groupBy("part", (F.col("own") + repeats).alias("fails"), (F.coalesce("quality", F.lit(0)) == 1).alias("good"), (F.coalesce("toxic", F.lit(0)) == 1).alias("toxic")).agg(F.count("*").alias("n"))


def edges() -> list[tuple[int, int, int]]:
    """(applied subset, next filter, number of orders through it), as bits."""
    out = []
    for name in FILTERS:
        others = FILTERS.replace(name, "")
        for size in range(len(FILTERS)):
            through = factorial(size) * factorial(len(others) - size)
            out += [(bits(some), bit(name), through) for some in combinations(others, size)]
    return out


def steps() -> list[tuple[str, int, int, int]]:
    """(order, step, applied subset, the step's filter) of every order of the filters."""
    return [("".join(order), k + 1, bits(order[:k]), bit(name)) for order in permutations(FILTERS) for k, name in enumerate(order)]


def edge_counts(failed: DataFrame) -> DataFrame:
    """(part, applied, next, counts of COUNTS, through): what happens on each edge of the lattice, zeros included."""
    spark = failed.sparkSession
    lattice = spark.createDataFrame(edges(), "applied int, next int, through int").collect()
    every = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in e.asDict().items()]) for e in lattice])
    each = failed.select("*", F.explode(every).alias("e")).select("*", "e.*")
    passed, fails = F.col("fails").bitwiseAND(F.col("applied")) == 0, F.col("fails").bitwiseAND(F.col("next")) != 0
    removed = passed & fails
    counted = {
        "kept": passed & ~fails,
        "removed": removed,
        "redundant": ~passed & fails,
        "unique_fails": F.col("fails") == F.col("next"),
        "good_lost": removed & F.col("good"),
        "toxic_lost": removed & F.col("toxic"),
    }
    sums = [F.sum(F.when(counted[c], F.col("n")).otherwise(0)).alias(c) for c in COUNTS]
    return each.groupBy("part", "applied", "next", "through").agg(*sums)


def audit(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """(part, filter_order, step, counts of COUNTS, shapley): one row a part, order and step."""
    spark = docs.sparkSession
    counted = materialize(edge_counts(failures(docs, labels, part)), "edges")  # 80 rows a part
    shapley = counted.groupBy("part", "next").agg(F.sum(F.col("removed") * F.col("through")).alias("shapley"))
    paths = spark.createDataFrame(steps(), "filter_order string, step int, applied int, next int")
    joined = counted.join(shapley, ["part", "next"]).join(F.broadcast(paths), ["applied", "next"])  # broadcast: 600 rows
    return joined.select("part", "filter_order", "step", *COUNTS, "shapley")
