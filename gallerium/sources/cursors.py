"""Cursors over sources that answer with growing windows, or page by page: what was accepted once is kept in a buffer between
calls, so that calls of any sizes read one sequence without repeats.

Many sources are read in one call. A call appends its new rows and its states as folders `call=n` and is there once the states
are written whole; one that dies in between is written again by the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..streaming.session import numbered

LEAST_PAGE = 20  # fixed value: what a page is asked for at least
STATE = "source string, requested long, held long, next_offset long, exhausted boolean"


class Cursors:
    """Buffers in a shared folder. Rows of a source have `source`, `ordinal` (their place in the answer) and the columns of
    `identity`, of which the first that isn't empty says which record a row is; others are kept as they are."""

    def __init__(self, spark: SparkSession, folder: str, identity: tuple[str, ...] = ("source_id", "image_url")):
        self.spark, self.folder, self.identity = spark, folder.rstrip("/"), identity

    def calls(self) -> list[int]:
        return numbered(self.spark, f"{self.folder}/states", "call")

    def states(self) -> DataFrame:
        """The last state of each source."""
        calls = self.calls()
        if not calls:
            return self.spark.createDataFrame([], STATE)
        every = self.spark.read.schema(f"{STATE}, call int").parquet(f"{self.folder}/states").where(F.col("call") <= calls[-1])
        columns = [c.split()[0] for c in STATE.split(", ")][1:]
        return every.groupBy("source").agg(F.max_by(F.struct(*columns), "call").alias("s")).select("source", "s.*")

    def buffer(self) -> DataFrame | None:
        """(source, position, key, ...) of all accepted rows."""
        calls = self.calls()
        return self.spark.read.option("basePath", f"{self.folder}/rows").parquet(*[f"{self.folder}/rows/call={c}" for c in calls]).drop("call") if calls else None

    def _key(self) -> Column:
        return F.coalesce(*[F.nullif(F.col(c).cast("string"), F.lit("")) for c in self.identity], F.lit(""))

    def _accept(self, fresh: DataFrame, ends: DataFrame) -> None:
        """Appends the rows of `fresh` that the buffer lacks, each record once, and the states `ends` (source, requested,
        next_offset, exhausted; a null next_offset leaves it)."""
        calls = self.calls()
        number = calls[-1] + 1 if calls else 0
        before, held = self.buffer(), self.states().select("source", F.col("held").alias("__held"), F.col("next_offset").alias("__offset"))
        first = Window.partitionBy("source", "key").orderBy("ordinal")
        rows = fresh.withColumn("key", self._key()).withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")
        if before is not None:
            rows = rows.join(before.select("source", "key"), ["source", "key"], "left_anti")
        own = Window.partitionBy("source").orderBy("ordinal")
        placed = rows.join(held.drop("__offset"), "source", "left").withColumn("position", F.coalesce("__held", F.lit(0)) + F.row_number().over(own) - 1).drop("__held", "ordinal")
        placed.write.mode("overwrite").parquet(f"{self.folder}/rows/call={number}")
        new = self.spark.read.parquet(f"{self.folder}/rows/call={number}").groupBy("source").agg(F.count("*").alias("n"))
        states = ends.join(held, "source", "left").join(new, "source", "left").select(
            "source", "requested", (F.coalesce("__held", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("held"), F.coalesce("next_offset", "__offset", F.lit(0).cast("long")).alias("next_offset"), "exhausted"
        )
        states.write.mode("overwrite").parquet(f"{self.folder}/states/call={number}")

    def _open(self, requests: DataFrame, again: bool) -> DataFrame:
        """(source, requested, held, next_offset) of the sources that must be asked."""
        known = self.states().withColumnRenamed("requested", "__before")
        short = requests.select("source", F.col("requested").cast("long").alias("requested")).join(known, "source", "left")
        done = F.coalesce("exhausted", F.lit(False)) | (F.coalesce("held", F.lit(0)) >= F.col("requested"))
        return short.where(~done if again else F.col("__before").isNull() | ~done).select("source", "requested", F.coalesce("held", F.lit(0).cast("long")).alias("held"), F.coalesce("next_offset", F.lit(0).cast("long")).alias("next_offset"))

    def window(self, requests: DataFrame, fetch: Callable[[DataFrame], DataFrame]) -> DataFrame | None:
        """The buffers after `requests` (source, requested). fetch(sources with `requested`) gives the first `requested` rows
        of each as they are now; rows that were accepted stay, in their places, however the answer's order changes. A source
        that gives fewer than asked for is exhausted."""
        ask = self._open(requests, again=False).select("source", "requested")
        if ask.limit(1).count():
            fresh = fetch(ask)
            counts = fresh.groupBy("source").agg(F.count("*").alias("n"))
            ends = ask.join(counts, "source", "left").select("source", "requested", F.lit(None).cast("long").alias("next_offset"), (F.coalesce("n", F.lit(0)) < F.col("requested")).alias("exhausted"))
            self._accept(fresh, ends)
        return self._held(requests)

    def pages(self, requests: DataFrame, fetch: Callable[[DataFrame], tuple[DataFrame, DataFrame]], most: int = 1000) -> DataFrame | None:
        """The same by pages: fetch(sources with `next_offset` and `n`) gives the rows of a page of each, and (source,
        next_offset, exhausted). All open sources turn a page together. An offset that doesn't advance is an error."""
        for _ in range(most):
            ask = self._open(requests, again=True)
            if not ask.limit(1).count():
                break
            fresh, ends = fetch(ask.select("source", "next_offset", F.greatest(F.lit(LEAST_PAGE), F.col("requested") - F.col("held")).alias("n")))
            both = ask.select("source", "requested", F.col("next_offset").alias("__at")).join(ends, "source")
            stuck = both.where((F.col("next_offset") <= F.col("__at")) & ~F.col("exhausted")).select("source").limit(5).collect()
            if stuck:
                raise ValueError(f"the cursor doesn't advance: {', '.join(r.source for r in stuck)}")
            self._accept(fresh, both.select("source", "requested", "next_offset", "exhausted"))
        return self._held(requests)

    def _held(self, requests: DataFrame) -> DataFrame | None:
        held = self.buffer()
        return None if held is None else held.join(requests.select("source"), "source", "left_semi")
