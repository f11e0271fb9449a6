"""The live session: continuation rules per source, idempotent merging of batches, snapshots."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

BUSY = ("fetching", "scoring", "evaluating")
BATCH, TOP = 10, 50


def continuation() -> dict[str, Column]:
    """Whether a source goes on, and its stage, from its state: the first rule that applies decides. Columns: selected,
    stop_reason, stage, rounds, exhausted, scoring_done, failed_scores, dirty, pending, latest, top_hits, complete."""
    c = F.col
    go = (
        F.when(~c("selected") | c("stop_reason").isNotNull() | c("stage").isin(*BUSY), False)
        .when(c("rounds") == 0, True)
        .when(c("exhausted") | ~c("scoring_done") | c("dirty") | (c("pending") > 0), False)
        .when(c("latest") < BATCH, True)
        .when((c("failed_scores") > 0) & (c("top_hits") == 0), False)
        .otherwise(c("top_hits") > 0)
    )
    stage = (
        F.when(~c("selected"), "hidden")
        .when(c("stop_reason").isNotNull(), "failed")
        .when(c("stage").isin(*BUSY), c("stage"))
        .when(c("rounds") == 0, "queued")
        .when(c("exhausted") & c("scoring_done") & (c("failed_scores") > 0), "incomplete")
        .when(c("exhausted"), "finished")
        .when(~c("scoring_done") | c("dirty") | (c("pending") > 0), "evaluating")
        .when(c("latest") < BATCH, "queued")
        .when((c("failed_scores") > 0) & (c("top_hits") == 0), "incomplete")
        .when(c("top_hits") > 0, "queued")
        .when(c("complete"), "finished")
        .otherwise("paused")
    )
    return {"continues": go, "next_stage": stage, "retryable": stage.isin("failed", "incomplete")}


def continuation_by_rounds() -> Column:
    """The other, round-based rule: previews first, then only while the last batch reaches the top."""
    c = F.col
    return (
        F.when(~c("selected"), False)
        .when((c("rounds") == 0) & c("stop_reason").isNull(), True)
        .when(c("stop_reason").isNotNull() | c("empty_first") | c("exhausted"), False)
        .when(c("exact") & (c("rounds") <= c("previews")), True)
        .when((c("fetched") < BATCH) & (c("rounds") <= c("previews")) & (c("last_count") == c("planned")), True)
        .otherwise(c("top_hits") > 0)
    )


def merge_in_order(batches: DataFrame) -> DataFrame:
    """Batches (source, offset, n) that count: each must begin where the ones before it ended, so a repeat is ignored. The
    first batch of an offset wins; a gap stops its source."""
    from pyspark.sql import Window

    first = batches.groupBy("source", "offset").agg(F.min_by("n", "arrival").alias("n"), F.min("arrival").alias("arrival"))
    own = Window.partitionBy("source").orderBy("offset")
    sums = first.withColumn("expected", F.coalesce(F.sum("n").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    good = F.min((F.col("offset") == F.col("expected")).cast("int")).over(own.rowsBetween(Window.unboundedPreceding, 0))
    return sums.withColumn("good", good).where("good = 1").select("source", "offset", "n", "arrival")


def top_hits(ranked: DataFrame, latest: DataFrame) -> DataFrame:
    """For each source, how many distinct representatives of its latest ids are among the top."""
    return latest.join(ranked.where(F.col("position") <= TOP), "id").groupBy("source").agg(F.count_distinct("family").alias("top_hits"))


def snapshot_changes(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """What happens to each row from one snapshot to the next: insert, remove, move or retain."""
    both = old.select(key, F.col("position").alias("was")).join(new.select(key, F.col("position").alias("now")), key, "full")
    return both.withColumn("change", F.when(F.col("was").isNull(), "insert").when(F.col("now").isNull(), "remove").when(F.col("was") != F.col("now"), "move").otherwise("retain"))


class RankedStream:
    """A running query whose end is followed by one more ranking, if items came after the last."""

    def __init__(self, query: StreamingQuery, settle: Callable[[], None]):
        self.query, self.settle = query, settle

    def awaitTermination(self, timeout: int | None = None) -> bool | None:
        done = self.query.awaitTermination(timeout)
        if done is not False:
            self.settle()
        return done

    def processAllAvailable(self) -> None:
        self.query.processAllAvailable()
        self.settle()

    def stop(self) -> None:
        self.query.stop()
        self.settle()

    def __getattr__(self, name):
        return getattr(self.query, name)


def numbered(spark: SparkSession, folder: str, name: str) -> list[int]:
    """The numbers of the folders `name`=number that are written whole."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [f.getPath() for f in files.listStatus(path)] if files.exists(path) else []
    whole = [p.getName() for p in found if files.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(int(n.removeprefix(f"{name}=")) for n in whole if n.startswith(f"{name}="))


def stream_items(items: DataFrame, rank: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str, every: int = 4) -> RankedStream:
    """Ranks again after every `every` micro-batches and once more when the stream has ended, over all items so far; each
    result is a folder of `sink` named by its batch, so that a repeated batch overwrites itself. What is ranked is read from
    the sink, so a run that ends between its batches and its last ranking is made up for: by the next run's start, if it is
    behind its items, and by its end."""
    spark = items.sparkSession

    def ranked(number: int) -> None:
        rank(spark.read.parquet(f"{sink}/items")).write.mode("overwrite").parquet(f"{sink}/ranked/at={number}")

    def settle() -> None:
        came, done = numbered(spark, f"{sink}/items", "batch"), numbered(spark, f"{sink}/ranked", "at")
        if came and (not done or came[-1] > done[-1]):
            ranked(came[-1])

    def step(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/items/batch={number}")
        if number % every == 0:
            ranked(number)

    settle()
    return RankedStream(items.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(), settle)


def last_ranking(spark: SparkSession, sink: str) -> DataFrame:
    """The latest result of a sink."""
    return spark.read.parquet(f"{sink}/ranked/at={numbered(spark, f'{sink}/ranked', 'at')[-1]}")


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts and sums by event-time window and type, for a stream or a table."""
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    return timed.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
