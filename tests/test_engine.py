"""The engine's functions and operators on small inputs, and every registered query against its SQL."""

import math
import random

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gallerium import provider_queries, queries  # noqa: F401
from gallerium.functions import scoring, text
from gallerium.operators import catalog, evidence, families, items, staged, tournament
from gallerium.plans import search
from gallerium.sources import pages, providers, registry
from gallerium.streaming import session

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages".split()


def shown(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 6) + 0.0)
    return str(pd.Timestamp(value).tz_localize(None)) if hasattr(value, "isoformat") else str(value)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    frame = queries.QUERIES[name](spark, DATA)
    rows = frame.collect()
    if name not in queries.ORACLES:
        assert rows or name == "fuzzy_search"
        return
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = db.sql(queries.ORACLES[name])
    columns = want.columns
    assert sorted(columns) == sorted(frame.columns)
    assert sorted(tuple(shown(r[c]) for c in columns) for r in rows) == sorted(tuple(map(shown, r)) for r in want.fetchall())


def item(**own):
    base = {"source": "a", "source_id": "1", "title": "Title", "license": "CC0", "page_url": "", "image_url": "https://x.test/1.jpg", "thumb_url": "", "width": 1200, "height": 800, "artist": "", "date": "", "medium": "", "description": "", "work_id": "", "is_primary_view": False, "provider_rank": 0}
    return base | own


@pytest.mark.parametrize("value", ["Élan vital, Émile đ ß", "ＡＢ", "", None, "a1-B2", "ﬁn"])
def test_fold(spark, value):
    frame = spark.createDataFrame([(value,)], "t string")
    assert frame.select(text.fold_exact("t")).first()[0] == text.fold_exact_py(value)
    if value not in ("ＡＢ", "ﬁn"):
        assert frame.select(text.fold("t")).first()[0] == text.fold_exact_py(value)


def test_concepts_and_coverage(spark):
    assert text.concepts("escape from prison jail") == [text.concept_of("escape"), text.concept_of("jail")]
    frame = spark.createDataFrame([("Liberation of Peter from jail",)], "t string")
    assert frame.select(text.coverage("Peter escaping prison", text.tokens("t"))).first()[0] == 1.0
    assert frame.select(text.coverage("", text.tokens("t"))).first()[0] == 0.0


def test_parse_query():
    assert text.parse_query('saint “blue rose” peter')["phrases"] == ["blue rose"]
    assert text.parse_query("blue rose", exact=True)["phrases"] == ["blue rose"]
    with pytest.raises(ValueError):
        text.parse_query('an "open quote')
    with pytest.raises(ValueError):
        text.validate_query("x" * 241)


def test_phrases_stay_in_a_field(spark):
    frame = spark.createDataFrame([("the blue", "rose garden"), ("a BLUE, rose", ""), ("bluerose", "")], "a string, b string")
    assert [r[0] for r in frame.select(text.matches_phrases(["a", "b"], ["blue rose"])).collect()] == [False, True, False]


@pytest.mark.parametrize("url,want", [("HTTPS://X.Test/A/?size=large#f", "https://x.test/A"), ("", ""), (None, ""), ("http://u:1/p//", "http://u:1/p")])
def test_canonical_url(spark, url, want):
    assert spark.createDataFrame([(url,)], "u string").select(text.canonical_url("u")).first()[0] == want


def test_ratios():
    assert text.indel_ratio("kitten", "sitting") == pytest.approx(200 * 4 / 13)
    assert text.token_set_ratio("fuzzy was a bear", "fuzzy fuzzy was a bear") == 100
    assert text.token_set_ratio("", "x") == 0


def test_metadata_score_prefers_exact_titles_and_synonyms(spark):
    rows = [item(title="Liberation of Saint Peter from Prison", provider_rank=3), item(title="Saint Peter appearing to Saint Agatha in prison", source_id="2")]
    ranked = search.scored(items.normalize(spark.createDataFrame(rows)), "Saint Peter escaping prison").orderBy(*search.order()).collect()
    assert ranked[0].title.startswith("Liberation")


def test_rank_score_modes(spark):
    frame = spark.range(1).select(scoring.rank_score(F.lit(1200), F.lit(800), F.lit(1.0), F.lit(True), F.lit(0.2), F.lit(9.0)).alias("a"), scoring.rank_score(F.lit(1200), F.lit(800), F.lit(1.0), F.lit(False), F.lit(0.5), F.lit(9.0)).alias("b"), scoring.rank_score(F.lit(0), F.lit(8), F.lit(None).cast("double"), F.lit(True), F.lit(None).cast("double"), F.lit(9.0)).alias("c"))
    r = frame.first()
    assert (r.a, r.b, r.c) == (pytest.approx(math.log2(960000), abs=1e-5), pytest.approx(math.log2(960000) / 2, abs=1e-5), 9.0)


@pytest.mark.parametrize("s,d,p,want", [(0.89, 0, 1, False), (0.99, 0.21, 1, False), (0.992, 0.07, None, True), (0.98, 0.1, 0.7, True), (0.97, 0.1, 0.85, False), (0.956, 0, 0.92, True), (0.91, 0.07, 0.955, True), (0.91, 0.09, 0.99, False), (None, 0, 1, False)])
def test_same_image(spark, s, d, p, want):
    frame = spark.createDataFrame([(s, float(d), None if p is None else float(p))], "s double, d double, p double")
    assert frame.select(scoring.same_image(F.col("s"), F.col("d"), F.col("p"))).first()[0] is want


def test_feature_similarity(spark):
    frame = spark.createDataFrame([(([1.0, 0.0], [1.0], [True, False], 0.5),)], "f struct<color:array<float>,gray:array<float>,dhash:array<boolean>,aspect:double>")
    assert frame.select(scoring.feature_similarity(F.col("f"), F.col("f"))).first()[0] == pytest.approx(1.0)


def test_normalize_defaults(spark):
    r = items.normalize(spark.createDataFrame([("met", None, "https://i.test/1")], "source string, title string, image_url string")).first()
    assert (r.title, r.license, r.thumb_url, r.width, r.description) == ("Untitled", "unknown", "https://i.test/1", 0, "Untitled from met.")
    assert len(r.id) == 16 and r.page_text_terms == ["from", "met", "unknown", "untitled"]


def test_families(spark):
    rows = [item(source_id=str(k), image_url=u, width=w, work_id=v, is_primary_view=p, title=f"t{k}") for k, (u, w, v, p) in enumerate([("https://x.test/a?size=large", 100, "", False), ("https://x.test/a", 900, "", False), ("https://x.test/b", 50, "w", True), ("https://x.test/c", 999, "w", False), ("https://x.test/d", 10, "", False)])]
    shown = items.normalize(spark.createDataFrame(rows))
    got = search.search(shown, "t", 10).collect()
    assert sorted((r.title, r.duplicate_count) for r in got) == [("t1", 1), ("t2", 1), ("t4", 0)]
    ranked = search.scored(shown, "t")
    others = families.alternates(ranked, families.components(families.key_edges(ranked, "id")), "id").join(shown.select("id", "title"), "id").collect()
    assert sorted((r.place, r.title) for r in others) == [(1, "t0"), (1, "t3")]


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(50)] + [(k, k + 1) for k in range(200, 240)]
    label = {x: x for e in edges for x in e if e[0] != e[1]}
    for _ in range(90):
        for a, b in edges:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    assert {r.node: r.component for r in families.components(spark.createDataFrame(edges, "a long, b long")).collect()} == label


def test_tournament(spark):
    rows = [("a", "b", "left")] * 5 + [("c", "b", "tie"), ("a", "c", "no_opinion"), ("a", "a", "left")]
    votes = spark.createDataFrame(rows, "left_id string, right_id string, choice string")
    score = {r.id: r.score for r in tournament.fit(votes, spark.createDataFrame([("a",), ("b",), ("c",)], "id string")).collect()}
    assert score["a"] > score["c"] > score["b"]
    items = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    shown = spark.createDataFrame(rows[:6], "left_id string, right_id string, choice string")
    assert "c" in tuple(tournament.next_pair(items, shown, spark.createDataFrame(list(score.items()), "id string, score double")).first())


def test_catalog(spark):
    docs = spark.createDataFrame([(1, "rose cross rose", "x"), (2, "rose", "cross y"), (3, "lily", "z"), (4, "tulip", "z"), (5, "oak", "z")], "id long, title string, note string")
    got = {r.id: r.score for r in catalog.bm25(docs, "id", {"title": 8.0, "note": 1.0}, "rose cross").collect()}
    assert set(got) == {1, 2} and got[1] < got[2] < 0
    assert {r.id for r in catalog.bm25(docs, "id", {"title": 1.0}, "li").collect()} == {3}
    assert catalog.bm25(docs, "id", {"title": 1.0}, " ?").count() == 0
    close = docs.withColumn("t", text.fold_tokens("title")).where(catalog.terms_are_close(F.col("t"), ["rose", "cross"], 1))
    assert [r.id for r in close.collect()] == [1]


def test_fuzzy_search(spark):
    docs = spark.createDataFrame([(7, "Đức Phật thiền định", "buddhist meditation"), (8, "A ship", "sea")], "id long, title string, description string")
    assert [r.id for r in catalog.fuzzy_search(docs, "id", ["title", "description"], "budhist meditating", 5).collect()] == [7]
    assert catalog.fuzzy_search(docs, "id", ["title"], "the", 5).count() == 0


def test_refresh(spark):
    full = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id long, modified string")
    assert catalog.refresh(full, full.limit(0), full, "id", "modified")[0] == "unchanged"
    assert catalog.refresh(full.where("id < 3"), full.where("id = 3"), full, "id", "modified")[0] == "incremental"
    assert catalog.refresh(full.where("id < 2"), full.where("id = 3"), full, "id", "modified")[0] == "full"


def test_staged(spark):
    rows = [(4, 0, "a", 2000, 2000), (4, 1, "b", 2100, 2000), (9, 0, "a", 4000, 3000), (9, 1, "c", 3000, 3000)]
    got = {r.key: r for r in staged.rank(spark.createDataFrame(rows, "stage int, stage_rank long, key string, width int, height int"), 10).collect()}
    assert (got["a"].pixels, got["a"].discovery, got["a"].n_stages, got["c"].discovery) == (12_000_000, 0, 2, 2)


def test_evidence():
    found = evidence.excerpt("Nothing. A rose grows by the wall. It is red.", {"rose", "wall"}, 40)
    assert found.startswith("A rose grows")
    assert evidence.segments("Teaching a Teacher", "teach", "prefix") == [("Teaching", True), (" a ", False), ("Teacher", True)]
    assert evidence.segments("Walls", "wall", "english_stem") == [("Walls", True)]
    assert evidence.segments("Walls", "wall") == [("Walls", False)]


def test_registry(spark):
    sources = registry.Registry()
    sources.add("a", "A", lambda s, q: s.createDataFrame([item()]))
    sources.add("b", "B", lambda s, q: 1 / 0)
    sources.add("c", "C", lambda s, q: s.createDataFrame([item(source="c")]), opt_in=True)
    assert sources.select("") == ["a", "b"] and sources.select("c, a,c") == ["c", "a"] and sources.select("", allow_empty=True) == []
    with pytest.raises(ValueError):
        sources.select("zzz")
    got, errors = sources.load(spark, "q", ["a", "b", "c"])
    assert got.count() == 2 and set(errors) == {"b"} and sources.table(spark).where("is_default").count() == 2


def test_providers(spark):
    media = '{"query":{"pages":{"1":{"pageid":1,"title":"File:Rose.jpg","index":2,"imageinfo":[{"url":"u","mime":"image/jpeg","width":3,"height":4,"extmetadata":{"Artist":{"value":"<b>Ann</b>"},"LicenseShortName":{"value":"CC-BY 4.0"}}}]},"2":{"pageid":2,"title":"File:X.pdf","imageinfo":[{"mime":"application/pdf"}]}}}}'
    library = '{"results":[{"id":"r","title":"t","digitized":true,"rights":"No known restrictions","image":[{"url":"s","width":100,"height":100},{"url":"m","width":1000,"height":900},{"url":"l","width":4000,"height":3000}],"resources":[{"files":1}]},{"id":"x","digitized":true,"image":[{"url":"s","width":1,"height":1}],"resources":[{"files":9,"fulltext":"y"}]}]}'
    found = '{"hits":{"hits":[{"_source":{"id":"5","title":"t","rights_type":"Public Domain","image":"valid","public_access":1}},{"_source":{"id":"6","rights_type":"Copyright","image":"valid","public_access":1}}]}}'
    one = lambda payload: spark.createDataFrame([(payload,)], "payload string")
    (r,) = providers.media_wiki(one(media)).collect()
    assert (r.title, r.artist, r.license, r.provider_rank) == ("Rose", "Ann", "CC-BY 4.0", 2)
    (r,) = providers.library_results(one(library)).collect()
    assert (r.image_url, r.thumb_url, r.license) == ("l", "m", "public domain")
    assert [r.source_id for r in providers.hits(one(found), "https://images.test/").collect()] == ["5"]


def test_pages(spark):
    html = '<a href="/imgres?imgurl=https%3A%2F%2Fx.test%2F1.jpg&imgrefurl=p&w=30&h=40"><img src=t></a><script type="application/ld+json">{"@graph":[{"description":"short"},{"description":"the longer one"}]}</script>'
    frame = spark.createDataFrame([(1, html), (2, None)], "page_id long, html string")
    (r,) = pages.image_anchors(frame).collect()
    assert (r.image_url, r.width, r.height) == ("https://x.test/1.jpg", 30, 40)
    assert {r.page_id: (r.n_images, r.description) for r in pages.page_facts(frame).collect()} == {1: (1, "the longer one"), 2: (0, "")}


def test_merge_in_order(spark):
    rows = [("a", 0, 10, 1), ("a", 10, 10, 2), ("a", 10, 10, 3), ("a", 30, 10, 4), ("b", 5, 10, 1)]
    got = session.merge_in_order(spark.createDataFrame(rows, "source string, offset long, n int, arrival long")).collect()
    assert sorted((r.source, r.offset, r.arrival) for r in got) == [("a", 0, 1), ("a", 10, 2)]


def test_continuation_by_rounds(spark):
    state = {"selected": True, "stop_reason": None, "rounds": 1, "empty_first": False, "exhausted": False, "exact": True, "previews": 1, "fetched": 4, "last_count": 4, "planned": 4, "top_hits": 0}
    schema = "selected boolean, stop_reason string, rounds int, empty_first boolean, exhausted boolean, exact boolean, previews int, fetched int, last_count int, planned int, top_hits int"
    goes = lambda **own: spark.createDataFrame([tuple((state | own).values())], schema).select(session.continuation_by_rounds()).first()[0]
    assert goes() and not goes(selected=False) and not goes(exhausted=True) and goes(rounds=0) and not goes(exact=False, rounds=2) and goes(exact=False, rounds=2, top_hits=1)


def test_top_hits(spark):
    ranked = spark.createDataFrame([(1, "f", 3), (2, "f", 3), (3, "g", 60)], "id long, family string, position int")
    latest = spark.createDataFrame([(1, "s"), (2, "s"), (3, "s")], "id long, source string")
    assert session.top_hits(ranked, latest).first().top_hits == 1


def test_stream(spark, tmp_path):
    for k in range(3):
        spark.range(10 * k, 10 * k + 10).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    running = session.stream_items(stream, lambda d: d.orderBy(F.desc("id")).limit(3), f"{tmp_path}/out", f"{tmp_path}/check", every=1)
    running.awaitTermination()
    assert {r.id for r in session.last_ranking(spark, f"{tmp_path}/out").collect()} == {29, 28, 27}


def test_matching(spark):
    rows = [item(title="Blue rose", description="a cross"), item(title="Blue", description="rose", source_id="2")]
    frame = items.normalize(spark.createDataFrame(rows))
    assert search.matching(frame, '"blue rose"').count() == 1 and search.matching(frame, "rose blue").count() == 2
    assert search.top(search.scored(frame, "blue rose"), 1).first().position == 1


def test_texts_of_a_batch_are_taken_one_by_one(spark):
    """A text function sees plain texts and nulls, and its batch stays Arrow's: no pandas Series of all texts is made."""
    from pyspark.util import PythonEvalType

    from gallerium.functions import words
    from gallerium.operators import evidence

    made = [words.match_score("tree life"), words.centered_excerpts("x", 10), evidence.highlighted("was"), evidence.excerpts("was")]
    assert {f.evalType for f in made} == {PythonEvalType.SQL_SCALAR_ARROW_UDF}
    frame = spark.createDataFrame([("It was. was it?",), (None,), ("",)], "t string")
    assert [tuple(r) for r in frame.select(made[0]("t"), made[1]("t"), made[2]("t"), made[3]("t")).collect()] == [(0.0, "It was.…", 2, "It was. was it?"), (0.0, "", 0, ""), (0.0, "", 0, "")]
