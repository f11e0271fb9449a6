"""Crawls over stored pages, rendered pages, requests that come together, and traces of sessions."""

import datetime as dt

from pyspark.sql import functions as F

from gallerium import provider_queries
from gallerium.operators import staged
from gallerium.sources import pages
from gallerium.streaming import keyed, live


def test_crawl(spark):
    site = [
        ("https://s.test/en/galleries", "<a href='/en/gallery/teachings'><h6>The Teachings</h6></a><a href='other'><h6>Other</h6></a><a href='/en/gallery/teachings'><h6>again</h6></a><a href='/en/lost'><h6>Lost</h6></a>"),
        ("https://s.test/en/gallery/teachings", "<a href='/en/gallery/teachings/grand-man'><img src='/img/grand-man.jpg' alt=' PLATE 25:  Grand Man '></a><a href='/shop'><img src='no.jpg'></a><a href='/en/gallery/teachings/none.html'><img src='n.jpg' alt='No page'></a>"),
        ("https://s.test/en/other", "<a href='gallery/teachings/grand-man'><img src='late.jpg' alt='late'></a><a href='/en/gallery/x/own'><img src='own.jpg' alt=''></a>"),
        ("https://s.test/en/gallery/teachings/grand-man", "<span id='Text'> Such is <em>Adam</em>, the first. </span><p>else</p>"),
        ("https://s.test/unlinked", "<a href='/en/gallery/u'><img src='u.jpg'></a>"), ("https://s.test/en/null", None),
    ]
    frame = spark.createDataFrame(site, "page_url string, html string")
    got = {r.source_id: r for r in pages.crawl(frame, "https://s.test/en/galleries", "/en/gallery/", ["Text"]).collect()}
    assert set(got) == {"grand-man", "none", "own"}
    man = got["grand-man"]
    assert (man.title, man.gallery, man.image_url, man.description) == ("PLATE 25: Grand Man", "The Teachings", "https://s.test/img/grand-man.jpg", "Such is Adam, the first.")
    assert got["none"].description == "" and got["own"].image_url == "https://s.test/en/own.jpg"
    assert pages.crawl(frame, "https://s.test/nowhere", "/", ["Text"]).count() == 0


def test_parts_of_a_rendered_page(spark):
    kind = "page int, place int, image_id string, image_url string, page_url string, width int, height int"
    cards = spark.createDataFrame([(1, 5, "a", "ua", "pa", 0, 0), (1, 2, "b", "ub", "pb", 10, 20)], kind)
    anchors = spark.createDataFrame([(1, 1, "c", "uc", "pc", 0, 0), (1, 2, "a", "other", "p", 30, 40), (1, 3, "", "u only", "p", 1, 1), (1, 4, "", "", "p", 9, 9)], kind)
    scripts = spark.createDataFrame([(1, 1, "b", "x", "x", 99, 99), (1, 2, None, "u only", "p", 2, 2), (2, 1, "c", "uc2", "p", None, None)], kind)
    known = spark.createDataFrame([("c", 7, 8), ("a", 1, 1)], "key string, width int, height int")
    rows = staged.page_union(["page"], [cards, anchors, scripts], known).orderBy("page", "position").collect()
    assert [(r.page, r.key, r.image_url, r.width, r.height) for r in rows] == [(1, "b", "ub", 10, 20), (1, "a", "ua", 30, 40), (1, "c", "uc", 7, 8), (1, "u only", "u only", 1, 1), (2, "c", "uc2", 7, 8)]
    assert staged.page_union(["page"], [cards, anchors, scripts], known, 2).count() == 3


def test_lines_of_one_number_stand_in_their_order(spark, tmp_path):
    """Two lines of one order, part and number have sizes of 200 and 100: the first of the file counts, as SQL meets them in order."""
    kind = "l_orderkey long, l_linenumber long, l_partkey long, l_suppkey long, l_returnflag string"
    lines = [(1, 3, 5, 2, "N"), (1, 3, 5, 1, "A"), (2, 3, 5, 1, "N"), (2, 3, 5, 2, "N"), (2, 3, 40, 0, "N"), (2, 3, 6, 0, "R")]
    spark.createDataFrame(lines, kind).coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(5,), (6,), (40,)], "p_partkey long").write.parquet(f"{tmp_path}/part.parquet")
    rows = provider_queries.rendered_pages(spark, str(tmp_path)).orderBy("page", "position").collect()
    assert [tuple(r) for r in rows] == [(1, 0, "5", 200), (2, 0, "6", 7), (2, 1, "40", 7), (2, 2, "5", 100)]


def test_requests_that_come_together(spark):
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    requests = spark.createDataFrame([(1, "a", at(0)), (2, "a", at(1)), (3, "b", at(0)), (4, "c", at(2)), (5, "c", at(1))], "id int, key string, at timestamp")
    batches = spark.createDataFrame([("b", at(-100), "young"), ("b", at(-200), "older"), ("c", at(-400), "stale")], "key string, at timestamp, answer string")
    answered, fetch = live.coalesced(requests, batches, F.lit(at(0)))
    assert [tuple(r) for r in answered.collect()] == [(3, "b", "young")]
    assert sorted(tuple(r) for r in fetch.collect()) == [(1, "a", [1, 2]), (5, "c", [4, 5])]


def test_traces_and_metrics(spark):
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    rows = [("s", 0, at(0), "fetch", "a", 0, 0, None, None), ("s", 1, at(1.5), "snapshot", None, None, 1, ["x"], None), ("s", 2, at(7), "heartbeat", None, None, 1, None, None), ("s", 3, at(9), "snapshot", None, None, 2, [str(i) for i in range(50)], None), ("s", 4, at(9), "failed", "a", 0, 2, None, "late")]
    lines = keyed.trace(spark.createDataFrame(rows, keyed.TOLD))
    assert [(r.event, r.elapsed, r.results) for r in lines.orderBy("number").collect()] == [("fetch", 0.0, 0), ("snapshot", 1.5, 1), ("heartbeat", 7.0, 0), ("snapshot", 9.0, 50), ("failed", 9.0, 0)]
    (m,) = keyed.metrics(lines).collect()
    assert (m.fetches, m.snapshots, m.failures, m.heartbeats, m.retries, m.first_visible, m.fifty_visible, m.settled, m.revisions) == (1, 2, 1, 1, 0, 1.5, 9.0, 9.0, 2)
