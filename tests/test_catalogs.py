"""Live catalogs, versions, sources that fail, exact quantiles, paged phrases and the common subsequence."""

import random

import pytest
from pyspark.sql import functions as F

from gallerium.functions import scoring, text
from gallerium.plans import phrases
from gallerium.sources import live_catalog, registry, stores

KIND = "id int, modified string, title string"


class Provider:
    """Records that can change, and what was asked."""

    def __init__(self, spark, rows):
        self.spark, self.rows, self.asked, self.broken = spark, rows, [], False

    def probe(self):
        if self.broken:
            raise OSError("no connection")
        return max((r[1] for r in self.rows), default=""), len(self.rows)

    def fetch(self, after):
        self.asked.append(after)
        return self.spark.createDataFrame([r for r in self.rows if after is None or r[1] > after], KIND)


@pytest.fixture()
def provider(spark):
    return Provider(spark, [(1, "2024-01-01T00:00:00", "blue rose"), (2, "2024-01-02T00:00:00", "red cross")])


def made(spark, tmp_path, provider):
    return live_catalog.LiveCatalog(spark, f"{tmp_path}/catalog", provider.probe, provider.fetch)


def test_refresh_modes(spark, tmp_path, provider):
    catalog = made(spark, tmp_path, provider)
    assert catalog.records() is None and catalog.status()["records"] is None
    assert [catalog.refresh(10.0), catalog.refresh(20.0)] == ["full", "unchanged"] and provider.asked == [None]
    provider.rows[0] = (1, "2024-01-03T00:00:00", "blue lily")
    provider.rows.append((3, "2024-01-02T00:00:00", "written in the last second"))
    assert catalog.refresh(30.0) == "incremental" and provider.asked[-1] == "2024-01-01T23:59:58"
    assert {r.id: r.title for r in catalog.records().collect()} == {1: "blue lily", 2: "red cross", 3: "written in the last second"}
    del provider.rows[1]
    assert catalog.refresh(40.0) == "full" and {r.id for r in catalog.records().collect()} == {1, 3}
    status = made(spark, tmp_path, provider).status()  # another process
    assert (status["records"], status["latest"], status["total"], status["mode"], status["updated_at"], status["error"]) == (2, "2024-01-03T00:00:00", 2, "full", 40.0, "")


def test_a_failure_leaves_the_records(spark, tmp_path, provider):
    catalog = made(spark, tmp_path, provider)
    catalog.refresh(10.0)
    provider.broken = True
    with pytest.raises(OSError):
        catalog.refresh(20.0)
    assert catalog.status()["error"] == "OSError: no connection" and catalog.records().count() == 2


def test_a_search_refreshes_a_stale_catalog(spark, tmp_path, provider):
    catalog = made(spark, tmp_path, provider)
    assert catalog.search(["title"], "rose", 5, 0.0) is None  # it begins to load
    catalog._worker.join()
    assert [r.id for r in catalog.search(["title"], "blue rose", 5, live_catalog.STALE_SECONDS - 1.0).collect()] == [1]
    assert provider.asked == [None] and not catalog.refresh_if_stale(live_catalog.STALE_SECONDS - 1.0)
    provider.rows.append((4, "2024-02-01T00:00:00", "blue rose too"))
    assert catalog.refresh_if_stale(live_catalog.STALE_SECONDS * 2.0, wait=True) and catalog.status()["mode"] == "incremental"
    assert sorted(r.id for r in catalog.search(["title"], "blue rose", 5, live_catalog.STALE_SECONDS * 2.0).collect()) == [1, 4]


def test_versions_rise_and_old_ones_go(spark, tmp_path):
    folder = f"{tmp_path}/table"
    for k in range(7):
        assert stores.save(spark.createDataFrame([(k,)], "k int"), folder, keep=3) == k
    assert stores.versions(spark, folder) == [4, 5, 6] and stores.load(spark, folder).first().k == 6


def test_a_source_that_fails_as_it_runs(spark):
    sources = registry.Registry()
    one = lambda s, name: s.createDataFrame([(name, "1", "https://i.test/1")], "source string, source_id string, image_url string")
    sources.add("a", "A", lambda s, q: one(s, "a"))
    sources.add("b", "B", lambda s, q: one(s, "b").where(F.raise_error(F.lit("late")).cast("boolean")))
    got, errors = sources.load(spark, "q", ["a", "b"])
    assert [r.source for r in got.collect()] == ["a"] and "late" in errors["b"]
    _, planned = sources.load(spark, "q", ["a", "b"], lazy=True)
    assert planned == {}


@pytest.mark.parametrize("values", [[], [3.0], [1.0, 2.0], [5.0] * 400, [float(k % 37) for k in range(5000)], [random.Random(1).gauss(0, 1) for _ in range(20_001)]])
def test_quantiles_are_exact(spark, values):
    import numpy as np

    frame = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double").repartition(5)
    got = scoring.quantiles(frame, "v", [0.0, 0.25, 0.5, 0.75, 1.0], error=0.01)
    assert got == ([None] * 5 if not values else pytest.approx(list(np.quantile(values, [0.0, 0.25, 0.5, 0.75, 1.0]))))


def test_pages_until_enough_hold_the_phrase(spark):
    rows = [(k, "tea and coffee service" if k < 1000 else "A TEA—SERVICE: for six", "") for k in range(1005)] + [(1005, "Tea", "Service for six"), (1006, "teaservice", "")]
    frame, asked = spark.createDataFrame(rows, "ordinal int, title string, description string"), []

    def fetch(skip, n):
        asked.append((skip, n))
        return frame.where((F.col("ordinal") >= skip) & (F.col("ordinal") < skip + n)), len(rows)

    exact = phrases.phrase_pages(fetch, '"tea service"', ["title", "description"], 3)
    assert [r.ordinal for r in exact.collect()] == [1000, 1001, 1002] and asked == [(0, 1000), (1000, 1000)]
    assert phrases.phrase_pages(fetch, "tea service", ["title"], 99, exact=True).count() == 5
    asked.clear()
    assert phrases.phrase_pages(fetch, "tea service", ["title"], 4).count() == 8 and asked == [(0, 8)]


def test_common_subsequence_by_bits():
    def plain(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            before = 0
            for j, y in enumerate(b, 1):
                before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
        return row[-1]

    rng = random.Random(3)
    for _ in range(500):
        a, b = ("".join(rng.choices("abcé漢", k=rng.randrange(0, 90))) for _ in "ab")
        want = 200.0 * plain(a, b) / (len(a) + len(b)) if a or b else 100.0
        assert text.indel_ratio(a, b) == want
