"""The rest of a live session: late scores, stale rankings, hidden and retried sources, session limits, cached batches,
progress and traces."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.families import stored
from ..operators.items import first_by, ordered_union

# Limits of sessions and caches, and the stages of progress in the order that they are told.
SESSION_MINUTES, SESSIONS, BATCH_SECONDS, BATCHES = 30, 24, 300, 256
STAGES = "finished fetching scoring evaluating queued paused incomplete failed".split()
QUIET_SECONDS, LOST_SECONDS = 30, 15


def merge_scores(items: DataFrame, scores: DataFrame, columns: list[str]) -> DataFrame:
    """Scores of known ids replace theirs; scores of unknown ids, and null ones, change nothing."""
    new = scores.select("id", *[F.col(c).alias(f"__{c}") for c in columns])
    return items.join(new, "id", "left").withColumns({c: F.coalesce(f"__{c}", c) for c in columns}).drop(*[f"__{c}" for c in columns])


def current(rankings: DataFrame, revisions: DataFrame) -> DataFrame:
    """Rankings (session, generation, ...) made of their session's latest data; stale ones are dropped."""
    return rankings.join(revisions.select("session", F.col("revision").alias("generation")), ["session", "generation"], "left_semi")


def retry(states: DataFrame) -> DataFrame:
    """Failed and incomplete sources are queued again, without their reason and failures."""
    again = F.col("stage").isin("failed", "incomplete")
    return states.withColumns({"stop_reason": F.when(~again, F.col("stop_reason")), "failed_scores": F.when(again, 0).otherwise(F.col("failed_scores")), "stage": F.when(again, "queued").otherwise(F.col("stage"))})


def choose(states: DataFrame, sources: list[str]) -> DataFrame:
    """Shows the chosen sources and hides the others; what was found stays."""
    return states.withColumn("selected", F.col("source").isin(*sources) if sources else F.lit(False))


def live_sessions(sessions: DataFrame, now: Column) -> DataFrame:
    """Sessions not older than their time, and of these the last used ones."""
    young = sessions.where(F.col("created") > now - F.expr(f"INTERVAL {SESSION_MINUTES} MINUTES"))
    return young.orderBy(F.desc("touched"), "session").limit(SESSIONS)


def cached_batches(batches: DataFrame, now: Column) -> DataFrame:
    """The last answer of each request (key, at, ...) that isn't too old; the newest requests only."""
    fresh = batches.where(F.col("at") > now - F.expr(f"INTERVAL {BATCH_SECONDS} SECONDS"))
    return first_by(fresh.withColumn("__at", F.col("at")), ["key"], [-F.col("__at").cast("timestamp").cast("double")]).drop("__at").orderBy(F.desc("at"), "key").limit(BATCHES)


def coalesced(requests: DataFrame, batches: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Requests (id, key, at) that come together: those that a young cached batch (key, at, answer) answers, with its answer,
    and of the others one a key to fetch, the first, with the ids that wait for it. A key's waiting ids are one micro-batch's."""
    have = cached_batches(batches, now).select("key", "answer")
    known = requests.join(have, "key", "left")
    waiting = known.where("answer is null").groupBy("key").agg(F.min(F.struct("at", "id")).alias("first"), F.array_sort(F.collect_list("id")).alias("ids"))
    return known.where("answer is not null").select("id", "key", "answer"), waiting.select(F.col("first.id").alias("id"), "key", "ids")


def admitted(requests: DataFrame, each: int = 2, total: int = 8) -> DataFrame:
    """The requests (source, at, id) that run now: a few of each source, oldest first, and a few at all."""
    own = Window.partitionBy("source").orderBy("at", "id")
    return requests.withColumn("turn", F.row_number().over(own)).where(F.col("turn") <= each).orderBy("turn", "at", "id").limit(total)


def progress(states: DataFrame) -> DataFrame:
    """(stage, n) of shown sources, in the order of stages."""
    at = F.array_position(F.array(*map(F.lit, STAGES)), F.col("stage"))
    return states.where("selected").groupBy("stage").agg(F.count("*").alias("n")).withColumn("ordinal", at)


def connection(running: Column, silent: Column, age: Column) -> Column:
    """What a caller is told, by the seconds since the last contact and since anything new came."""
    return (
        F.when(~running, "")
        .when(silent > LOST_SECONDS, "Connection uncertain — reconnect to check this search.")
        .when(age + silent >= QUIET_SECONDS, F.format_string("Still connected · no new results or completed work for %ds", F.floor(age + silent)))
        .otherwise("Connected · search in progress")
    )


def milestones(events: DataFrame, scored: int = 50) -> DataFrame:
    """(session, first_visible, first_scored, fifty_scored, settled): when the first item was seen and scored, when `scored`
    items were, and when the top changed last. Events: session, at, kind (visible, scored, top), n."""
    when = lambda c: F.min(F.when(c, F.col("at")))
    k = F.col("kind")
    return events.groupBy("session").agg(
        when(k == "visible").alias("first_visible"), when((k == "scored") & (F.col("n") > 0)).alias("first_scored"), when((k == "scored") & (F.col("n") >= scored)).alias("fifty_scored"), F.max(F.when(k == "top", F.col("at"))).alias("settled")
    )


def metrics(events: DataFrame) -> DataFrame:
    """(name, total, peak, events) of traced counters."""
    return events.groupBy("name").agg(F.sum("value").alias("total"), F.max("value").alias("peak"), F.count("*").alias("events"))


def deadlines(work: DataFrame, now: Column, seconds: dict[str, int], attempts: int = 2) -> DataFrame:
    """Work (kind, started, attempt, done) with what becomes of it: finished, running, retried once, or failed."""
    limit = F.element_at(F.create_map(*[F.lit(x) for pair in seconds.items() for x in pair]), F.col("kind"))
    seconds_of = lambda t: t.cast("timestamp").cast("double")
    late = seconds_of(F.col("started")) + limit < seconds_of(now)
    return work.withColumn("outcome", F.when(F.col("done"), "finished").when(~late, "running").when(F.col("attempt") < attempts, "retry").otherwise("failed"))


def write_lines(rows: DataFrame, path: str) -> None:
    """Rows as lines of JSON."""
    rows.write.mode("overwrite").json(path)


def accepted_batches(batches: DataFrame, timeout_minutes: int = SESSION_MINUTES) -> DataFrame:
    """A stream of batches (source, offset, n) to those that count, by keyed state: where each source stands. A repeat is
    ignored, a batch that comes too early waits in the state for those before it, and an idle source's state goes after the
    session's time. The state of a source is a number and its waiting batches."""
    kind = "source string, offset long, n long, fetched long"

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        fetched, kept = state.get if state.exists else (0, "{}")
        waiting = {int(k): v for k, v in json.loads(kept).items()}
        for frame in frames:
            for offset, n in zip(frame["offset"], frame["n"]):
                if offset >= fetched:
                    waiting.setdefault(int(offset), int(n))
        rows = []
        while fetched in waiting:
            n = waiting.pop(fetched)
            rows.append((key[0], fetched, n, fetched + n))
            if n == 0:
                break
            fetched += n
        state.update((fetched, json.dumps({str(k): v for k, v in waiting.items() if k >= fetched})))
        state.setTimeoutDuration(timeout_minutes * 60_000)
        yield pd.DataFrame(rows, columns=["source", "offset", "n", "fetched"])

    return batches.groupBy("source").applyInPandasWithState(step, kind, "fetched long, waiting string", "append", GroupStateTimeout.ProcessingTimeTimeout)


def run_session(spark: SparkSession, fetch: Callable[[str, int], DataFrame | None], sources: list[str], rank: Callable[[DataFrame], DataFrame], most: int = 100) -> Iterator[tuple[str, DataFrame | None]]:
    """Events of a live search: every source's first batch, then the next one of each source that goes on; a snapshot where
    the ranking changed, a heartbeat where it didn't, and at last complete. fetch(source, offset) gives items (id, ...) or
    None at the end; a source that fails stops alone. Each round's items are written, so the plan doesn't grow with rounds."""
    found, last, at, active = None, None, dict.fromkeys(sources, 0), list(sources)
    for _ in range(most):
        new, still = [], []
        for source in active:
            try:
                batch = fetch(source, at[source])
                n = batch.count() if batch is not None else 0
            except Exception as e:  # one source must not stop the others
                yield f"failed {source}: {e}", None
                continue
            at[source] += n
            if n:
                new.append(batch)
                still.append(source)
        active = still
        if new:
            batches = [b.withColumn("__at", F.monotonically_increasing_id()) for b in new]
            before = [] if found is None else [found.withColumn("__at", F.lit(0).cast("long"))]
            found = stored(ordered_union([*before, *batches], ["id"], ["__at"]).drop("__at", "priority"))  # the first row of an id stays
            ranking = rank(found)
            signature = tuple(r[0] for r in ranking.select("id").limit(50).collect())
            yield ("snapshot", ranking) if signature != last else ("heartbeat", None)
            last = signature
        if not active:
            break
    yield "complete", None if found is None else rank(found)


class Progress(StreamingQueryListener):
    """Remembers the last progress of each running query, up to `most` of them, and counts the ones that were dropped."""

    def __init__(self, most: int = 64):
        self.last: dict[str, dict] = {}
        self.most, self.dropped = most, 0

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        p = event.progress
        self.last.pop(str(p.id), None)
        self.last[str(p.id)] = {"batch": p.batchId, "rows": p.numInputRows, "rate": p.processedRowsPerSecond}
        if len(self.last) > self.most:
            self.last.pop(next(iter(self.last)))
            self.dropped += 1

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        pass
