"""Provider payloads, word matching, paging, snapshots and live sessions on small inputs and by brute force."""

import json
import random
import uuid

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gallerium import provider_queries, queries
from gallerium.functions import images, text, words
from gallerium.operators import delivery, families, matches
from gallerium.plans import snapshot
from gallerium.sources import pages, paging, records
from gallerium.streaming import live


@pytest.mark.parametrize("word,want", [("escaping", "escap"), ("running", "run"), ("stories", "story"), ("boxes", "box"), ("cats", "cat"), ("bed", "bed"), ("stopped", "stop"), ("gas", "gas"), ("", "")])
def test_stems_agree(spark, word, want):
    assert words.stem_py(word) == want == spark.createDataFrame([(word,)], "w string").select(words.stem(F.col("w"))).first()[0]


@pytest.mark.parametrize("a,b,want", [("prison", "prisons", True), ("botticelli", "boticelli", True), ("cat", "car", False), ("tree", "streets", False), ("wisdom", "kingdom", False)])
def test_same_word(a, b, want):
    assert words.same_word(a, b) is want and words.same_word(b, a) is want


def test_relevance(spark):
    rows = [("Saint Peter freed from prison", True), ("Peter", False), ("", False), (None, False), ("peters prison escaped " * 1000, True)]
    got = spark.createDataFrame([r[:1] for r in rows], "t string").select(words.relevant("Peter escapes from prison", F.col("t"))).collect()
    assert [r[0] for r in got] == [w for _, w in rows]
    assert spark.range(1).select(words.relevant("the of", F.lit("x"))).first()[0] is False


def test_match_score(spark):
    frame = spark.createDataFrame([("The Kabbalistic Tree of Life",), ("streets of life",), (None,)], "t string")
    assert [r[0] for r in frame.select(words.match_score("tree life")("t")).collect()] == [102.0, 0.5, 0.0]


def test_centered_excerpt():
    long = "Nothing here. " * 40 + "Before it. The lion sleeps. After it. More."
    assert words.centered(long, "lions", 200) == "Before it. The lion sleeps. After it."
    assert words.centered("short", "x") == "short" and words.centered(None, "x") == ""
    assert words.centered("word " * 100, "word", 20) == "word word word word…"


def test_word_forms():
    assert words.word_forms("running man") == ["running man", "run man", "runn man", "runne man"]
    assert words.word_forms("plain words") == ["plain words"]


def test_fingerprints(spark):
    rng = np.random.default_rng(1)
    pixels = rng.integers(0, 256, (20, 30, 3), dtype="uint8")
    rows = [(pixels.tobytes(), 30, 20), (b"", 3, 2), (None, 1, 1), (b"abc", 1, 1), (bytes(200 * 300 * 3), 300, 200)]
    got = [r[0] for r in spark.createDataFrame(rows, "d binary, w int, h int").select(images.fingerprints(F.col("d"), F.col("w"), F.col("h"))).collect()]
    want = np.concatenate([np.histogram(pixels[..., c], bins=16, range=(0, 256))[0] for c in range(3)]).astype(float)
    assert np.allclose(got[0].color, want / np.linalg.norm(want), atol=1e-6) and got[0].aspect == pytest.approx(np.log(1.5))
    assert got[1].color is None and got[2].color is None and len(got[3].dhash) == 64 and not any(got[4].dhash)
    assert np.linalg.norm(got[4].gray) == pytest.approx(1, abs=1e-5)


def test_fingerprints_of_one_size_are_taken_together(monkeypatch):
    """Many images of two sizes cost a few calls, in bounded steps, and each keeps its own values."""
    rng, calls, whole = np.random.default_rng(2), [], images.fingerprint
    monkeypatch.setattr(images, "fingerprint", lambda pixels: calls.append(len(pixels)) or whole(pixels))
    monkeypatch.setattr(images, "AT_ONCE", 96 * 300)
    sizes = [(8, 4) if i % 2 else (2, 16) for i in range(1000)]
    raw = [rng.integers(0, 256, 96, dtype="uint8").tobytes() for _ in sizes]
    got = images._fingerprints(pd.Series([*raw, None]), pd.Series([*[w for w, _ in sizes], 1]), pd.Series([*[h for _, h in sizes], 1]))
    assert sorted(calls) == [200, 200, 300, 300] and got["color"].iloc[1000] is None
    for i in (0, 1, 998, 999):
        one = whole(np.frombuffer(raw[i], dtype="uint8").reshape(1, sizes[i][1], sizes[i][0], 3))
        assert all(np.allclose(got[part].iloc[i], one[part][0], atol=1e-6) for part in one)


def test_evidence(spark):
    rows = [("Blue Rose", "a rose that is red"), ("none", "a\n blue   rose"), (None, ""), ("x", "y" * 50_000)]
    got = matches.evidence(spark.createDataFrame(rows, "title string, description string"), "blue rose").collect()
    assert [(r.match_context, r.matched_fields, r.missing_query_terms) for r in got] == [("Blue Rose", ["Title", "Description"], []), ("a blue rose", ["Description"], []), ("", [], ["blue", "rose"]), ("", [], ["blue", "rose"])]
    assert got[2].match_evidence_status == matches.NONE_VISIBLE
    extra = matches.evidence(spark.createDataFrame([("x",)], "title string"), "rose", F.create_map(F.lit("wall_label"), F.lit("the rose"))).first()
    assert extra.matched_fields == ["Wall Label"]


def test_previews(spark):
    rows = [("curated", "p", "i", "", "", False), ("aic", "p", "i", "", "mirror", None), ("met", None, "i", "full", "", True)]
    got = delivery.previews(spark.createDataFrame(rows, "source string, page_url string, image_url string, full_resolution_url string, image_delivery string, requires_source_visit boolean")).collect()
    assert [(r.preview_click_url, r.download_url) for r in got] == [("i", "i"), ("p", ""), ("full", "")]


def test_proxy_and_full_size(spark):
    urls = ["https://ok.test/a", "http://ok.test/a", "https://bad.test/", None, "not a url"]
    got = spark.createDataFrame([(u,) for u in urls], "u string").select(delivery.may_proxy(F.col("u"), ["ok.test"]), delivery.full_size_url(F.col("u"))).collect()
    assert [r[0] for r in got] == [True, False, False, False, False] and got[1][1] == "http://ok.test/a" and got[4][1] == ""


def test_credits(spark):
    rows = [("1503", "Engraved by Hans Weiditz (born 1495), about 1520–30.", "", "Museum of X", ""), ("t", "A scene (1888), showing x", "Artist: Bo", "", "Date made: 1901"), ("c. 1400", None, None, "© someone", None), ("t", None, None, " Ann ", None)]
    stated = records.credits(*[F.col(c) for c in "abcde"])
    got = spark.createDataFrame(rows, "a string, b string, c string, d string, e string").select(*[c.alias(k) for k, c in stated.items()]).collect()
    assert [tuple(r) for r in got] == [("Hans Weiditz", "about 1520–30"), ("Bo", "1901"), ("", "c. 1400"), ("Ann", "")]


def test_payloads_bear_nonsense(spark):
    frame = spark.createDataFrame([(1, None), (2, ""), (3, "{"), (4, "[1]"), (5, "{}"), (6, json.dumps({"representation": None, "items": None}))], "k int, payload string")
    assert records.linked_records(frame, "k").count() == 0
    assert records.matching_pages(frame, "k", "x").count() == 0 and records.contexts(frame, "k", "x").count() == 0
    for reader in (records.styled_images, records.media_library):
        assert reader(frame.where("k <> 4")).count() == 0
    assert records.open_content(frame, "", "").count() == 0


def test_deep_json():
    assert sum(1 for _ in records.nodes(json.loads('{"a":' * 900 + "1" + "}" * 900))) == 900


def test_context():
    record = {"a": [{"content": "<b>A lion</b> and a lamb"}, {"_label": "lion lamb"}], "content": "lion"}
    assert records.query_context(json.dumps(record), "lions lamb") == "lion lamb"


def manifest(rng) -> dict:
    label = lambda: rng.choice([{"en": [" ".join(rng.choices(["lion", "lions", "lamb", "Lamb", "of", "sun", "Éland", "ox"], k=rng.randint(1, 4)))]}, "lion lamb", {"none": ["LION lamb"]}, "Main View", "", None])
    body = lambda: rng.choice([{"id": f"http://i.test/{rng.random()}"}, {"type": "Choice", "items": [{"id": "https://c.test/1"}, {"id": "no"}]}, {"id": ""}])
    items = [{"id": f"https://m.test/c{k}", "label": label(), "items": [{"items": [{"body": body()}]}]} for k in range(rng.randint(0, 5))]
    listed = [{"type": "Canvas", "id": f"https://m.test/c{rng.randint(0, 6)}", "label": label()} for _ in range(rng.choice([0, 0, 1, 4]))]
    return {"items": items, "structures": [{"type": "Range", "items": listed}]}


def test_matching_pages_by_brute_force(spark):
    """Manifests of a volume are met together: labels of any table of contents hide those of the pages."""
    rng, rows = random.Random(9), []
    for k in range(300):
        rows += [(k, manifest(rng)) for _ in range(rng.choice([1, 1, 2, 3]))]
    want = {}
    for k in range(300):
        found = []
        for body in (body for j, body in rows if j == k):
            pages = {c["id"]: c for c in body["items"]}
            listed = [(0, c["label"], c["id"]) for c in body["structures"][0]["items"] if c["id"] in pages]
            found += [(rank, records.label_text(label), key, pages[key]) for rank, label, key in [*listed, *[(1, c["label"], i) for i, c in pages.items() if c["label"] != "Main View"]] if records.label_text(label)]
        least = min((f[0] for f in found), default=None)
        met = [(len(w), t.lower(), t, key.rsplit("/", 1)[-1], records.page_image(page)) for rank, t, key, page in found if rank == least and (w := set(words.words_of(t))) and words.hits(["lion", "lamb"], w) == 2]
        first = min((m[:4] for m in met), default=None)
        want[k] = {(m[2], m[4], m[3]) for m in met if m[:4] == first}  # manifests of a volume may tie
    got = records.matching_pages(spark.createDataFrame([(k, json.dumps(body)) for k, body in rows], "k int, payload string"), "k", "lions lamb").collect()
    told = {r.k: tuple(r)[1:] for r in got}
    assert len(told) == len(got) > 40 and all(told[k] in want[k] for k in told)
    assert all("" in {image for _, image, _ in ties} for k, ties in want.items() if k not in told and ties)


def test_only_a_manifests_best_page_is_looked_into(monkeypatch):
    looked, whole = [], records.page_image
    monkeypatch.setattr(records, "page_image", lambda page: looked.append(page["id"]) or whole(page))
    body = {"items": [{"id": f"m/{k}", "label": f"lion {'and more ' * k}", "items": [{"body": {"id": f"http://i/{k}"}}]} for k in range(50)]}
    assert records.best_page(json.dumps(body), ["lion"])["image_url"] == "https://i/0" and looked == ["m/0"]
    assert records.best_page(json.dumps(body), ["ox"]) == {"rank": 1, "unmatched": True} and records.best_page("{}", ["ox"]) is None


@pytest.mark.parametrize("name,reader", [("manifest_pages", "matching_pages"), ("linked_records", "linked_records")])
def test_payloads_of_parts_are_dealt(spark, monkeypatch, name, reader):
    """As many tasks read payloads as their rows need, however few bytes the parts take."""
    met, whole = [], getattr(records, reader)
    monkeypatch.setattr(provider_queries, "ROWS_A_TASK", 20)
    monkeypatch.setattr(records, reader, lambda frame, *a: met.append(frame.rdd.getNumPartitions()) or whole(frame, *a))
    rows = spark.read.parquet("/root/testdata/sf0.001/part.parquet").count()
    assert queries.QUERIES[name](spark, "/root/testdata/sf0.001").count() and met == [rows // 20 + 1]


def test_linked_image_prefers_services():
    direct = {"format": "image/jpeg", "width": 5, "height": 5, "access_point": [{"id": "http://x/a.jpg"}]}
    assert records.linked_image({"representation": [direct, {**direct, "width": 9}]})[2] == 9
    assert records.linked_image({"representation": [direct, {"type": "DigitalService", "access_point": [{"id": "http://s/"}]}]})[0] == "https://s/full/max/0/default.jpg"


@pytest.mark.parametrize("line,want", [("Ms - Ann - Paris - France - 1300", ("Ann", "Paris, France", "1300")), ("Ms", ("", "", "")), ("Ms - 1300", ("", "", "1300")), ("Ms - Artiste non identifié", ("", "", "")), (None, ("", "", ""))])
def test_creation_unit(spark, line, want):
    frame = spark.createDataFrame([(line,)], "l string")
    assert tuple(frame.select(*[c.alias(k) for k, c in records.creation_unit(F.col("l")).items()]).first()) == want


def test_pages_must_advance():
    assert list(paging.pages(lambda at, n: (list(range(at, at + 3)), at + 3), 0, 7)) == list(range(7))
    assert list(paging.pages(lambda at, n: ([at], -1), 5, 7)) == [5]
    with pytest.raises(ValueError):
        list(paging.pages(lambda at, n: ([1], at), 0, 3))


def test_identities_by_brute_force(spark):
    rng = random.Random(3)
    rows = [(k, rng.choice(["", None, *map(str, range(40))]), rng.choice(["", *map(str, range(40))])) for k in range(200)]
    taken, want = set(), []
    for k, a, b in rows:
        keys = {x for x in (("a", a), ("b", b)) if x[1]}
        if not keys & taken:
            taken |= keys
            want.append(k)
    got = paging.first_of_identities(spark.createDataFrame(rows, "k int, a string, b string"), "k", ["a", "b"])
    assert sorted(r.k for r in got.collect()) == want
    assert paging.first_of_identities(spark.createDataFrame([], "k int, a string, b string"), "k", ["a", "b"]).count() == 0


def test_sections(spark):
    html = "<div id=a>Label: one<br> <span>two</span></div><p>no</p><div class='b x'>three</div><a href=/g/x><h2>Head</h2></a><a href=/g/x><h2>Again</h2></a>"
    frame = spark.createDataFrame([(1, html), (2, None), (3, "</div><<")], "page_id long, html string")
    assert [r.text for r in pages.section_texts(frame, ["b", "a"], ("Label:",)).orderBy("page_id").collect()] == ["three\n\none two", "", ""]
    assert pages.gallery_index(html) == [("/g/x", "Head")]


def test_snapshot(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=64)
    base /= np.linalg.norm(base)
    far = rng.normal(size=64)
    far /= np.linalg.norm(far)
    one = lambda i, v, ready=True, w=10: (i, [float(x) for x in v], w, 10, ready, [1.0], [1.0], [True], 0.0)
    rows = [one(1, base), one(2, base), one(3, base, False), one(4, far), one(5, base, True, 100)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, width int, height int, ready boolean, color array<float>, gray array<float>, dhash array<boolean>, aspect double")
    edges, waits = snapshot.image_edges(frame)
    assert [tuple(r) for r in edges.collect()] == [(1, 2)] and [r[0] for r in waits.collect()] == [3]


def test_positions_count_scored_members(spark):
    rows = [("a", 9.0, None, 100), ("b", 5.0, 0.5, 10), ("c", 7.0, 0.9, 10), ("d", 99.0, None, 10)]
    ranked = spark.createDataFrame(rows, "id string, rank_score double, learned_score double, width int").selectExpr("*", "10 AS height", "false AS is_primary_view", "0 AS provider_rank", "'s' AS source", "id AS title", "true AS rerank")
    labels = spark.createDataFrame([("a", "a"), ("b", "a")], "node string, component string")
    assert [tuple(r) for r in snapshot.positions(ranked, labels, 10).orderBy("position").collect()] == [("c", "c", 1), ("a", "a", 2)]


def test_similar_uses_fingerprints(spark):
    f = ([1.0], [1.0], [True], 0.0)
    rows = [("a", None, ["x"], 10, 10, 0.0, f), ("b", None, ["x"], 10, 10, 1.0, None)]
    items = spark.createDataFrame(rows, "id string, embedding array<float>, words array<string>, width int, height int, rank_score double, fingerprint struct<color:array<float>,gray:array<float>,dhash:array<boolean>,aspect:double>")
    target = {"words": ["y"], "width": 10, "height": 10, "fingerprint": dict(zip(("color", "gray", "dhash", "aspect"), f))}
    assert [(r.id, r.similarity) for r in snapshot.similar(items, target, 5).collect()] == [("a", 1.0), ("b", 0.3)]
    alternates, others = snapshot.related(items, spark.createDataFrame([("t", "t"), ("b", "t")], "node string, component string"), "t", target, 5)
    assert [r.id for r in alternates.collect()] == ["b"] and [r.id for r in others.collect()] == ["a"]


def test_accepted_batches_stream(spark, tmp_path):
    source, order = str(tmp_path / "in"), [("s", 10, 10), ("s", 0, 10), ("s", 0, 10), ("t", 5, 1), ("s", 20, 3)]
    name = f"accepted_{uuid.uuid4().hex}"
    for k, row in enumerate(order):
        spark.createDataFrame([row], "source string, offset long, n long").coalesce(1).write.mode("append").parquet(f"{source}/{k}")
    stream = spark.readStream.schema("source string, offset long, n long").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(source)
    running = live.accepted_batches(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    running.awaitTermination(120)
    got = sorted(tuple(r) for r in spark.table(name).collect())
    assert got == [("s", 0, 10, 10), ("s", 10, 10, 20), ("s", 20, 3, 23)]


def test_live_search(spark):
    def fetch(source, offset):
        if source == "bad":
            raise OSError("down")
        return spark.range(offset, offset + 2).select(F.concat(F.lit(source), "id").alias("id")) if offset < 4 else None

    events = list(live.run_session(spark, fetch, ["a", "bad", "b"], lambda df: df.orderBy("id")))
    assert [k for k, _ in events] == ["failed bad: down", "snapshot", "snapshot", "complete"]
    assert events[-1][1].count() == 8


def test_hidden_sources_keep_results(spark):
    states = spark.createDataFrame([("a", "failed", "x", 3), ("b", "finished", None, 0)], "source string, stage string, stop_reason string, failed_scores int")
    assert [r.selected for r in live.choose(states, ["b"]).orderBy("source").collect()] == [False, True]
    assert not live.choose(states, []).where("selected").count()
    assert [r.stage for r in live.retry(states).orderBy("source").collect()] == ["queued", "finished"]


def test_finish(spark):
    rows = [(100, 100, 0.22, 0.5, 3.0), (100, 100, 0.085, None, 3.0), (0, 100, None, None, 3.0)]
    frame = spark.createDataFrame(rows, "width int, height int, c double, l double, metadata_score double")
    got = snapshot.finish(frame, F.col("c"), F.col("l")).collect()
    size = np.log2(10000)
    assert [r.rank_score for r in got] == [pytest.approx(size / 2, abs=1e-5), pytest.approx(size / 2, abs=1e-5), 3.0]
    assert [r.scoring_complete for r in got] == [True, False, False]


def test_lines(spark, tmp_path):
    path = f"file://{tmp_path}/lines"
    live.write_lines(spark.createDataFrame([(1, None)], "a int, b string"), path)
    assert [tuple(r) for r in spark.read.schema("a int, b string").json(path).collect()] == [(1, None)]
