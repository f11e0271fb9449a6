"""Live sessions as one keyed stream: events in, what a session's owner and its fetchers are told out.

All that a session knows lies in the state store (its sources, its items' scores, what was last told) and its clock in timers, so a
query that ends anywhere and starts again from its checkpoint goes on as if nothing had happened, and no driver or task remembers
anything. Told rows are numbered by session, so a sink can drop what a repeated batch tells twice.

Events (EVENT) in: `start` shows sources; `batch` brings a source's rows `ids` and `scores` from `offset` on (`exhausted` where that
was all, `reason` where it failed); `score` brings scores of known ids; `choose` shows other sources; `cancel` ends the session.
Told rows (TOLD) out: `fetch` asks for a source's next batch, `retry` for missing scores once more, `snapshot` brings the best ids
where they changed, `heartbeat` says that nothing did, `failed` that a source stops, and `complete` ends the session.

Times are those of the events and the watermark (mode "EventTime") or of the machine (mode "ProcessingTime"). Events of one
micro-batch are taken in the order of `at`, then of kinds, sources and offsets; a batch that doesn't begin where its source
stands is ignored; events of an unknown or ended session are, too."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# Seconds between heartbeats, for a fetch and for scores, batches that wait for one ranking, and the top.
HEARTBEAT, FETCH_SECONDS, SCORE_SECONDS = 5, 120, 90
DIRTY_BATCHES, TOP, BATCH = 4, 50, 10
EVENT = "session string, at timestamp, kind string, source string, offset long, exhausted boolean, reason string, ids array<string>, scores array<double>"
TOLD = "session string, number long, at timestamp, kind string, source string, offset long, revision long, ids array<string>, reason string"
_TOLD = TOLD.replace("at timestamp", "ms long")
KINDS = ("start", "choose", "batch", "score", "cancel")
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_FETCHING, _SCORING, _IDLE, _STOPPED = "fetching", "scoring", "idle", "stopped"


class Sessions(StatefulProcessor):
    """A session's state is a row about itself, a row a source and a row an item. The first two are read once a call and written
    at its end, as each access goes to the JVM and back; items are read when a ranking needs them, and then only those that
    came since."""

    SESSION = "number long, revision long, dirty long, top string, beat long, settle long, closed boolean"
    SOURCE = "fetched long, rounds long, shown boolean, exhausted boolean, stage string, due long, attempt long, latest string"
    ITEM = "source string, score double"

    def __init__(self, event_time: bool):
        self.event_time = event_time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.session = handle.getValueState("session", self.SESSION)
        self.sources = handle.getMapState("sources", "source string", self.SOURCE)
        self.items = handle.getMapState("items", "id string", self.ITEM)

    def close(self) -> None:
        pass

    def _open(self) -> None:
        names = [part.split()[0] for part in self.SESSION.split(", ")]
        self._row = dict(zip(names, self.session.get())) if self.session.exists() else None
        self._held: dict[str, dict] | None = None  # the sources, once they are needed
        self._changed: set[str] = set()
        self._written = self._row
        self._best: tuple[set, list] | None = None  # the shown sources and their best rows, as _top gives them

    def _flush(self) -> None:
        if self._row is not None and self._row is not self._written:
            self.session.update(tuple(self._row.values()))
        for name in sorted(self._changed):
            self.sources.updateValue((name,), tuple(self._held[name].values()))

    # What happens

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = [e for frame in rows for e in frame.itertuples(index=False)]  # one session's events of one micro-batch
        told, force = [], False
        self._open()
        for e in sorted(events, key=_turn):
            now = int(e.ms) if self.event_time else int(timerValues.getCurrentProcessingTimeInMs())
            if e.kind == "start" and self._row is None:
                self._save(number=0, revision=0, dirty=0, top="", beat=0, settle=0, closed=False)
                self._show(list(e.ids), told, now)
                self._beat(now)
            if self._row is None or self._row["closed"]:
                continue
            if e.kind == "choose":
                self._show(list(e.ids), told, now)
                force = True
            elif e.kind == "cancel":
                self._end("cancelled", told, now)
                break
            elif e.kind == "batch":
                force |= self._batch(e, told, now)
            elif e.kind == "score":
                force |= self._scores(e, now)
            self._settle(told, now, force)
            force = False
        self._flush()
        yield self._frame(key, told)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, told = int(expiredTimerInfo.getExpiryTimeInMs()), []
        self._open()
        if self._row is not None and not self._row["closed"]:
            late = False
            for name, s in list(self._all_sources()):
                if s["due"] and s["due"] <= now:
                    late = True
                    self._late(name, s, told, now)
            s = self._load()
            self._settle(told, now, late or 0 < s["settle"] <= now)
            s = self._load()
            if not s["closed"] and s["beat"] <= now:
                if not any(t["kind"] == "snapshot" for t in told):
                    self._tell(told, now, "heartbeat")
                self._beat(now)
        self._flush()
        yield self._frame(key, told)

    # State

    def _load(self) -> dict:
        return self._row

    def _save(self, **changes) -> None:
        self._row = (self._row or {}) | changes

    def _all_sources(self) -> Iterator[tuple[str, dict]]:
        if self._held is None:
            names = [part.split()[0] for part in self.SOURCE.split(", ")]
            self._held = {name[0]: dict(zip(names, value)) for name, value in self.sources.iterator()}
        for name, source in self._held.items():
            yield name, dict(source)

    def _put(self, name: str, source: dict) -> None:
        dict(self._all_sources())  # reads those that are there, if nothing has yet
        self._held[name] = source
        self._changed.add(name)

    def _timer(self, at: int) -> int:
        self.handle.registerTimer(at)
        return at

    def _beat(self, now: int) -> None:
        self._save(beat=self._timer(now + HEARTBEAT * 1000))

    def _tell(self, told: list, now: int, kind: str, source: str | None = None, offset: int | None = None, ids: list | None = None, reason: str | None = None) -> None:
        s = self._row
        told.append({"number": s["number"], "ms": now, "kind": kind, "source": source, "offset": offset, "revision": s["revision"], "ids": ids, "reason": reason})
        self._save(number=s["number"] + 1)

    def _frame(self, key, told: list) -> pd.DataFrame:
        columns = [part.split()[0] for part in _TOLD.split(", ")]
        return pd.DataFrame([{"session": key[0], **t} for t in told], columns=columns)

    # Rules

    def _show(self, chosen: list, told: list, now: int) -> None:
        known = dict(self._all_sources())
        for name, s in known.items():
            s["shown"] = name in chosen
            self._put(name, s)
        for name in chosen:
            if name not in known:
                self._put(name, dict(fetched=0, rounds=0, shown=True, exhausted=False, stage=_IDLE, due=0, attempt=0, latest=""))
                self._ask(name, told, now)

    def _ask(self, name: str, told: list, now: int) -> None:
        s = dict(self._all_sources())[name]
        s |= {"stage": _FETCHING, "due": self._timer(now + FETCH_SECONDS * 1000), "attempt": 0}
        self._put(name, s)
        self._tell(told, now, "fetch", name, s["fetched"])

    def _batch(self, e, told: list, now: int) -> bool:
        """Merges a batch that begins where its source stands. Returns whether a ranking must follow at once."""
        s = dict(self._all_sources()).get(e.source)
        if s is None or s["stage"] == _STOPPED or int(e.offset) != s["fetched"]:
            return False
        if isinstance(e.reason, str):
            self._put(e.source, s | {"stage": _STOPPED, "due": 0})
            self._tell(told, now, "failed", e.source, s["fetched"], reason=e.reason)
            return True
        ids = [] if e.ids is None else list(e.ids)
        scores = [None] * len(ids) if e.scores is None else list(e.scores)
        scores = [None if score is None or pd.isna(score) else float(score) for score in scores]
        for item, score in zip(ids, scores):
            self.items.updateValue((item,), (e.source, score))
        self._add(e.source, ids, scores)
        waits = any(score is None for score in scores)
        s |= {"fetched": s["fetched"] + len(ids), "rounds": s["rounds"] + 1, "exhausted": bool(e.exhausted) or not ids, "latest": "\x1f".join(ids), "attempt": 0}
        s |= {"stage": _SCORING, "due": self._timer(now + SCORE_SECONDS * 1000)} if waits else {"stage": _IDLE, "due": 0}
        self._put(e.source, s)
        if ids:
            self._save(dirty=self._load()["dirty"] + 1)
        return False

    def _scores(self, e, now: int) -> bool:
        """Scores of known ids replace theirs."""
        changed = False
        for item, score in zip(e.ids, e.scores):
            if score is not None and not pd.isna(score) and self.items.containsKey((item,)):
                source, _ = self.items.getValue((item,))
                self.items.updateValue((item,), (source, float(score)))
                changed = True
        if changed:
            self._best = None
            for name, s in list(self._all_sources()):
                if s["stage"] == _SCORING and not self._missing(s):
                    self._put(name, s | {"stage": _IDLE, "due": 0})
            self._save(dirty=self._load()["dirty"] + 1)
        return changed

    def _missing(self, source: dict) -> list[str]:
        return [i for i in source["latest"].split("\x1f") if i and self.items.getValue((i,))[1] is None]

    def _late(self, name: str, s: dict, told: list, now: int) -> None:
        """A fetch that takes too long stops its source; missing scores are asked for once more, then go without."""
        if s["stage"] == _FETCHING:
            self._put(name, s | {"stage": _STOPPED, "due": 0})
            self._tell(told, now, "failed", name, s["fetched"], reason="fetch deadline exceeded")
        elif s["stage"] == _SCORING and s["attempt"] == 0:
            self._put(name, s | {"attempt": 1, "due": self._timer(now + SCORE_SECONDS * 1000)})
            self._tell(told, now, "retry", name, s["fetched"], ids=self._missing(s))
        else:
            self._put(name, s | {"stage": _IDLE, "due": 0})

    def _settle(self, told: list, now: int, force: bool) -> None:
        """Ranks if it must be: at first, when forced, after enough batches, or when no source is busy any more; else a timer
        makes up for it. Then asks for what comes next, and ends the session when nothing does."""
        s = self._load()
        sources = dict(self._all_sources())
        busy = any(x["stage"] in (_FETCHING, _SCORING) for x in sources.values() if x["shown"])
        if s["dirty"] and not (force or not s["revision"] or s["dirty"] >= DIRTY_BATCHES or not busy):
            if not s["settle"]:
                self._save(settle=self._timer(now + HEARTBEAT * 1000))
            return
        top = self._top(sources)
        if s["dirty"] or force:
            joined = "\x1f".join(top)
            self._save(dirty=0, settle=0, revision=s["revision"] + 1, top=joined)
            if joined != s["top"]:
                self._tell(told, now, "snapshot", ids=top)
                self._beat(now)
        best = set(top)
        for name, x in sources.items():
            if x["shown"] and x["stage"] == _IDLE and not x["exhausted"] and (not x["rounds"] or best & set(x["latest"].split("\x1f"))):
                self._ask(name, told, now)
                busy = True
        if not busy:
            self._end(None, told, now)

    def _top(self, sources: dict) -> list[str]:
        """The best scored items of shown sources, and after them those without a score; the items pass one by one, once a call
        unless sources or scores change."""
        shown = {name for name, s in sources.items() if s["shown"]}
        if self._best is None or self._best[0] != shown:
            rows = ((score is None, -(score or 0.0), key[0]) for key, (source, score) in self.items.iterator() if source in shown)
            self._best = shown, heapq.nsmallest(TOP, rows)
        return [i for _, _, i in self._best[1]]

    def _add(self, source: str, ids: list[str], scores: list[float | None]) -> None:
        """Brings new items to the best ones. An item that comes again replaces itself: if it was among the best, the next may
        be any other, and all are read again."""
        if self._best is None:
            return
        shown, best = self._best
        if not {i for _, _, i in best}.isdisjoint(ids):
            self._best = None
        elif source in shown:
            rows = {i: (score is None, -(score or 0.0), i) for i, score in zip(ids, scores)}  # the last of an id, as in the state
            self._best = shown, heapq.nsmallest(TOP, [*best, *rows.values()])

    def _end(self, reason: str | None, told: list, now: int) -> None:
        self._tell(told, now, "complete", reason=reason)
        self._save(closed=True)
        self.items.clear()


def _turn(e) -> tuple:
    """The order of events of one micro-batch; events without a source or an offset come after those with one."""
    source, offset = (e.source is None or pd.isna(e.source)), (e.offset is None or pd.isna(e.offset))
    return e.ms, KINDS.index(e.kind) if e.kind in KINDS else len(KINDS), source, "" if source else e.source, offset, 0 if offset else e.offset


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Queries that start inside keep their state in STORE."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, STORE)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def told(events: DataFrame, mode: str = "EventTime", late: str = "10 seconds") -> DataFrame:
    """A stream of EVENT rows to one of TOLD rows. The session's state store must be STORE."""
    spark = events.sparkSession
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") != STORE:
        raise ValueError(f"spark.sql.streaming.stateStore.providerClass must be {STORE}")
    timed = events.withWatermark("at", late) if mode == "EventTime" else events
    rows = timed.withColumn("ms", F.unix_millis("at")).groupBy("session").transformWithStateInPandas(Sessions(mode == "EventTime"), _TOLD, "Append", mode)
    return rows.select(*[F.timestamp_millis("ms").alias("at") if c == "ms" else c for c in rows.columns])


def start(events: DataFrame, sink: str, checkpoint: str, mode: str = "EventTime", late: str = "10 seconds", **trigger):
    """Runs sessions into a folder of `sink` a micro-batch, which a repeated batch overwrites."""

    def step(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return told(events, mode, late).writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def last_snapshots(told_rows: DataFrame) -> DataFrame:
    """(session, revision, ids, complete) of each session from its told rows: the last best ids, and whether it has ended."""
    shown = F.when(F.col("kind") == "snapshot", F.col("number"))
    return told_rows.groupBy("session").agg(F.max_by("revision", shown).alias("revision"), F.max_by("ids", shown).alias("ids"), F.max(F.col("kind") == "complete").alias("complete"))


def trace(told_rows: DataFrame) -> DataFrame:
    """A line an event of each session, as they are written for later: (session, event, elapsed, source, revision, results)."""
    began = told_rows.groupBy("session").agg(F.min("at").alias("began"))
    elapsed = F.round(F.col("at").cast("double") - F.col("began").cast("double"), 4)
    return told_rows.join(began, "session").select("session", "number", F.col("kind").alias("event"), elapsed.alias("elapsed"), "source", "revision", F.coalesce(F.size("ids"), F.lit(0)).alias("results"), "reason")


def metrics(lines: DataFrame) -> DataFrame:
    """Counters and milestones of each session from its trace."""
    is_ = lambda k: F.col("event") == k
    first = lambda c: F.min(F.when(c, F.col("elapsed")))
    return lines.groupBy("session").agg(
        *[F.count_if(is_(k)).alias(n) for k, n in (("fetch", "fetches"), ("snapshot", "snapshots"), ("retry", "retries"), ("failed", "failures"), ("heartbeat", "heartbeats"))],
        first(is_("snapshot") & (F.col("results") > 0)).alias("first_visible"), first(is_("snapshot") & (F.col("results") >= TOP)).alias("fifty_visible"),
        F.max(F.when(is_("snapshot"), F.col("elapsed"))).alias("settled"), F.max("revision").alias("revisions"), F.max("results").alias("most_visible"),
    )

