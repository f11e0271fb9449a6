"""Live sessions by keyed state: fetching, coalesced rankings, deadlines, heartbeats, and restarts."""

import datetime as dt
import uuid

import pandas as pd
import pytest

from gallerium.streaming import keyed

T0 = dt.datetime(2024, 1, 1)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def event(session, seconds, kind, source=None, offset=None, ids=None, scores=None, exhausted=False, reason=None):
    return (session, at(seconds), kind, source, offset, exhausted, reason, ids, scores)


@pytest.fixture(scope="module")
def store(spark):
    with keyed.state_store(spark):
        yield spark


class Run:
    """Event files in order, a checkpoint, and the told rows."""

    def __init__(self, spark, folder):
        self.spark, self.folder, self.n = spark, f"{folder}/{uuid.uuid4().hex}", 0

    def feed(self, *rows):
        frame = self.spark.createDataFrame(list(rows), keyed.EVENT)
        frame.coalesce(1).write.mode("append").parquet(f"{self.folder}/in")
        self.n += 1

    def run(self):
        events = self.spark.readStream.schema(keyed.EVENT).option("maxFilesPerTrigger", 1).parquet(f"{self.folder}/in")
        query = keyed.start(events, f"{self.folder}/out", f"{self.folder}/check")
        query.awaitTermination()
        return self

    def told(self):
        rows = self.spark.read.parquet(f"{self.folder}/out").drop("batch").orderBy("session", "number").collect()
        return [tuple(r) for r in rows]

    def kinds(self, session):
        return [(r[3], r[4], r[7] if r[3] == "snapshot" else r[8]) for r in self.told() if r[0] == session]


def batches(session, source, start, n, size, base, last=False):
    """n batches of `size` scored items each, a second apart."""
    return [event(session, start + k, "batch", source, k * size, [f"{source}{k * size + i}" for i in range(size)], [float(base - k * size - i) for i in range(size)], last and k == n - 1) for k in range(n)]


def test_a_session_from_start_to_end(store, tmp_path):
    run = Run(store, tmp_path)
    run.feed(event("s", 0, "start", ids=["a", "b"]))
    run.feed(event("s", 1, "batch", "a", 0, ["a1", "a2"], [1.0, 3.0], True))
    run.feed(event("s", 2, "batch", "b", 0, ["b1"], [2.0], True), event("s", 3, "batch", "b", 5, ["no"], [9.0], True), event("other", 3, "batch", "b", 0, ["no"], [9.0]))
    kinds = run.run().kinds("s")
    assert kinds == [("fetch", "a", None), ("fetch", "b", None), ("snapshot", None, ["a2", "a1"]), ("snapshot", None, ["a2", "b1", "a1"]), ("complete", None, None)]
    assert run.kinds("other") == []  # it never started


def test_rankings_are_coalesced_and_none_is_lost(store, tmp_path):
    """Six batches while another source still works: one ranking at first, one after four more; the rest by the timer."""
    run = Run(store, tmp_path)
    run.feed(event("s", 0, "start", ids=["a", "b"]))
    run.feed(*batches("s", "a", 1, 6, 2, 100))
    run.run()
    assert [k for k, *_ in run.kinds("s") if k == "snapshot"] == ["snapshot"] * 2
    run.feed(event("t", 30, "start", ids=["x"]))
    run.feed(event("t", 60, "batch", "x", 0, ["x1"], [1.0], True))
    run.run()
    shown = [r for r in run.told() if r[0] == "s" and r[3] == "snapshot"]
    assert len(shown) == 3 and len(shown[-1][7]) == 12


def test_deadlines(store, tmp_path):
    """A fetch that isn't answered stops its source; missing scores are asked for again once, then the session goes on."""
    run = Run(store, tmp_path)
    run.feed(event("s", 0, "start", ids=["a", "b"]), event("s", 1, "batch", "a", 0, ["a1", "a2"], [1.0, None], True))
    run.feed(event("t", 100, "start", ids=["x"]), event("u", 400, "start", ids=["x"]))
    run.feed(event("u", 401, "cancel"))
    kinds = [k for k in run.run().kinds("s") if k[0] != "heartbeat"]
    assert ("failed", "b", "fetch deadline exceeded") in kinds and ("retry", "a", None) in kinds and kinds[-1][0] == "complete"
    assert [r[7] for r in run.told() if r[0] == "s" and r[3] == "retry"] == [["a2"]]
    assert [r[7] for r in run.told() if r[0] == "s" and r[3] == "snapshot"][-1] == ["a1", "a2"]
    assert run.kinds("u")[-1] == ("complete", None, "cancelled")
    assert any(k[0] == "heartbeat" for k in run.kinds("s"))


def test_late_scores_and_chosen_sources(store, tmp_path):
    run = Run(store, tmp_path)
    run.feed(event("s", 0, "start", ids=["a", "b"]), event("s", 1, "batch", "a", 0, ["a1"], None, True), event("s", 1, "batch", "b", 0, ["b1"], [0.5]))
    run.feed(event("s", 2, "score", ids=["a1", "unknown"], scores=[0.9, 1.0]), event("s", 3, "choose", ids=["b"]), event("s", 4, "choose", ids=["a", "b"]))
    run.feed(event("s", 5, "batch", "b", 1, reason="no connection"))
    shown = [r[7] for r in run.run().told() if r[3] == "snapshot"]
    assert shown == [["a1"], ["a1", "b1"], ["b1"], ["a1", "b1"]]  # the second batch waits, and comes with the score
    assert run.kinds("s")[-2:] == [("failed", "b", "no connection"), ("complete", None, None)]


def test_a_restart_tells_the_same(store, tmp_path):
    """Stopped after every file and started again from its checkpoint, or never stopped: the told rows are the same."""
    files = [[event("s", 0, "start", ids=["a", "b"]), event("t", 0, "start", ids=["a"])], batches("s", "a", 1, 3, 2, 50), [*batches("t", "a", 2, 2, 3, 70, True), event("s", 5, "batch", "b", 0, ["b1"], [99.0], True)]]
    files += [[event("s", 6, "batch", "a", 6, ["a9"], [1000.0], False)], [event("z", 200, "start", ids=["q"])]]
    whole, parted = Run(store, tmp_path), Run(store, tmp_path)
    for rows in files:
        whole.feed(*rows)
    whole.run()
    for rows in files:
        parted.feed(*rows)
        parted.run()
    assert [r for r in whole.told() if r[3] != "heartbeat"] and {r[0] for r in whole.told()} == {"s", "t", "z"}
    pick = lambda run: {(r.session, r.revision, tuple(r.ids or ()), r.complete) for r in keyed.last_snapshots(store.read.parquet(f"{run.folder}/out")).collect()}
    assert pick(whole) == pick(parted)
    assert [r[1] for r in parted.told() if r[0] == "s"] == list(range(len([r for r in parted.told() if r[0] == "s"])))


def test_the_state_store_is_named(spark, tmp_path):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider")
    try:
        with pytest.raises(ValueError):
            keyed.told(spark.readStream.schema(keyed.EVENT).parquet(str(tmp_path)))
    finally:
        spark.conf.set(key, before)


class Stores(dict):
    """State in memory that counts its accesses."""

    def getValueState(self, name, kind):
        return self.setdefault(name, Store())

    getMapState = lambda self, name, key, kind: self.setdefault(name, Store())

    def registerTimer(self, when):
        pass


class Store:
    def __init__(self):
        self.rows, self.calls = {}, {}

    def _count(self, name):
        self.calls[name] = self.calls.get(name, 0) + 1

    def exists(self):
        self._count("exists")
        return () in self.rows

    def get(self):
        self._count("get")
        return self.rows[()]

    def update(self, row):
        self._count("update")
        self.rows[()] = row

    def updateValue(self, key, value):
        self._count("updateValue")
        self.rows[key] = value

    def iterator(self):
        self._count("iterator")
        return iter(list(self.rows.items()))

    def clear(self):
        self.rows.clear()


def test_a_call_reads_and_writes_each_state_once():
    """Batches in one micro-batch, with an id that comes again worse than before: a pass over the items for each
    source of changes, not for each event, and one row of the session read and written."""
    stores, sessions = Stores(), keyed.Sessions(True)
    sessions.init(stores)
    rows = [event("s", 0, "start", ids=["a"]), *batches("s", "a", 1, 12, 10, 1000)]
    rows[4] = event("s", 4, "batch", "a", 30, ["a0", *(f"x{i}" for i in range(9))], [-5.0, *(2000.0 + i for i in range(9))])
    columns = [part.split()[0] for part in keyed.EVENT.split(", ")]
    frame = pd.DataFrame(rows, columns=columns).rename(columns={"at": "ms"})
    frame["ms"] = [int((r[1] - T0).total_seconds() * 1000) for r in rows]
    (out,) = sessions.handleInputRows(("s",), iter([frame]), None)
    shown = out[out["kind"] == "snapshot"]["ids"].iloc[-1]
    assert shown[:9] == [f"x{i}" for i in range(8, -1, -1)] and shown[9] == "a1" and len(shown) >= 38
    assert stores["session"].calls["update"] == 1 and stores["session"].calls["exists"] == 1 and stores["items"].calls["iterator"] <= 2
    assert stores["sources"].calls == {"iterator": 1, "updateValue": 1}
