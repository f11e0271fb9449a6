"""Thesaurus searches and cursors with buffers."""

import pytest
from pyspark.sql import functions as F

from gallerium.plans import translation
from gallerium.sources import paging
from gallerium.sources.cursors import Cursors

KEYWORDS = """<section><h2>unicorn</h2><a href='x("UD_DESCRIPTEUR", "licorne")'>go</a></section>
<section><h2>brazen <b>serpent</b></h2><a href='x("UD_DESCRIPTEUR" , "serpent d&#39;airain")'>go</a></section>
<section><h2>serpent (non identifi&eacute;)</h2><a href='x("UD_DESCRIPTEUR", "serpent (non identifié)")'>go</a></section>
<section><h2>Chevalier au Dragon</h2><a href='x("UD_DESCRIPTEUR", "Chevalier au Dragon")'>go</a><a href="other">no</a></section>
<section><h2>virgin</h2><a href='x("UD_DESCRIPTEUR", "Vierge")'>go</a></section>"""


@pytest.fixture(scope="module")
def thesaurus(spark):
    return translation.thesaurus_pages(spark.createDataFrame([(1, KEYWORDS), (2, None)], "page_id long, html string"), "UD_DESCRIPTEUR")


def test_only_whole_labels_translate(spark, thesaurus):
    terms = spark.createDataFrame([("Unicorn",), ("brazen serpent",), ("serpent",), ("dragon",), ("",)], "term string")
    got = {r.term: [(p.label, p.keyword) for p in r.pairs] for r in translation.translations(terms, thesaurus).collect()}
    assert got == {"Unicorn": [("unicorn", "licorne")], "brazen serpent": [("brazen serpent", "serpent d'airain")], "serpent": [("serpent (non identifié)", "serpent (non identifié)")]}


def test_searches_in_order(spark, thesaurus):
    queries = ["unicorn", "unicorn and virgin", "saint george", "unicorn knight", "serpent", "one two three four five", "the", ""]
    frame = spark.createDataFrame(list(enumerate(queries)), "query_id int, query string")
    got = {}
    for r in translation.searches(frame, thesaurus).orderBy("query_id", "rank").collect():
        got.setdefault(queries[r.query_id], []).append((r.kind, r.words, r.evidence, r.if_empty))
    assert got == {
        "unicorn": [("keyword", ["licorne"], ["licorne (unicorn)"], False), ("text", ["licorne"], ["unicorn → licorne"], False)],
        "unicorn and virgin": [("text", ["licorne", "vierge"], ["unicorn → licorne", "virgin → Vierge"], False), ("text", ["unicorn", "and", "virgin"], [], True)],
        "saint george": [("text", ["saint", "george"], [], False)],
        "unicorn knight": [("text", ["unicorn", "knight"], [], False), ("text", ["licorne"], ["unicorn → licorne"], True)],
        "serpent": [("keyword", ["serpent (non identifié)"], [], False), ("text", ["serpent"], ["serpent (non identifié) → serpent"], False)],
        "one two three four five": [("text", ["one", "two", "three", "four", "five"], [], False)],
        "the": [("text", ["the"], [], False)],
    }


def test_results_stand_in_and_repeat_no_identity(spark, thesaurus):
    records = spark.createDataFrame([
        ("r1", "i1", 1, "La licorne", ["licorne"]), ("r2", "i2", 2, "Une licorne et la Vierge", None), ("r3", "i1", 3, "licorne, same folio", ["licorne"]),
        ("r4", "i4", 4, "saint George", []), ("r1", "i5", 5, "licorne again", ["licorne"]), ("r6", "i5", 6, "licorne whose image came with a dropped record", ["licorne"]),
    ], "source_id string, image_url string, ordinal int, text string, keywords array<string>")
    queries = spark.createDataFrame([(0, "unicorn"), (1, "unicorn and virgin"), (2, "saint george"), (3, "unicorn knight"), (4, "nothing")], "query_id int, query string")
    found = translation.run(translation.searches(queries, thesaurus), records, 10).orderBy("query_id", "place").collect()
    got = {}
    for r in found:
        got.setdefault(r.query_id, []).append((r.rank, r.source_id))
    assert got == {0: [(0, "r1"), (0, "r6"), (1, "r2")], 1: [(0, "r2")], 2: [(0, "r4")], 3: [(1, "r1"), (1, "r2"), (1, "r6")]}
    assert [r.evidence for r in found if r.query_id == 3][0] == ["unicorn → licorne"]


def test_pages_end_where_results_are_enough(spark, thesaurus):
    rows = [(f"r{i}", f"i{i // 2}", i, "licorne", ["licorne"] if i < 130 else []) for i in range(400)]
    records = spark.createDataFrame(rows, "source_id string, image_url string, ordinal int, text string, keywords array<string>")
    query = spark.createDataFrame([(0, "unicorn")], "query_id int, query string")
    for need, want in ((10, 25), (26, 25), (60, 50), (110, 75), (160, 100)):  # a page has fifty records of 25 images, and a search as many pages as `need` fills
        assert translation.run(translation.searches(query, thesaurus), records, need).count() == want, need


# Cursors


def answers(spark, sizes, shift=0):
    """Sources that repeat every third record; fetch gives the first rows asked for."""
    rows = [(s, i, f"{s}{(i + shift) - (1 if (i + shift) % 3 == 2 else 0)}", "") for s, n in sizes.items() for i in range(n)]
    every = spark.createDataFrame(rows, "source string, ordinal int, source_id string, image_url string")
    return lambda ask: every.join(ask, "source").where("ordinal < requested").drop("requested")


def asked(spark, **sizes):
    return spark.createDataFrame(list(sizes.items()), "source string, requested int")


def listed(frame):
    out = {}
    for r in frame.orderBy("source", "position").collect():
        assert r.position == len(out.setdefault(r.source, []))
        out[r.source].append(r.source_id)
    return out


def test_calls_of_any_sizes_give_one_sequence(spark, tmp_path):
    fetch = answers(spark, {"a": 40, "b": 7})
    one = listed(Cursors(spark, f"{tmp_path}/one").window(asked(spark, a=30, b=30), fetch))
    for sizes in ((3, 30), (1, 2, 8, 9, 30), (30, 4)):
        cursors = Cursors(spark, f"{tmp_path}/{'-'.join(map(str, sizes))}")
        for n in sizes:
            got = listed(Cursors(spark, cursors.folder).window(asked(spark, a=n, b=n), fetch))  # a new object, as after a restart
        assert got == one
    assert len(set(one["a"])) == len(one["a"]) == 20 and one["b"] == ["b0", "b1", "b3", "b4", "b6"]


def test_what_was_accepted_keeps_its_place(spark, tmp_path):
    cursors = Cursors(spark, f"{tmp_path}/c")
    before = listed(cursors.window(asked(spark, a=6), answers(spark, {"a": 40})))["a"]
    after = listed(cursors.window(asked(spark, a=12), answers(spark, {"a": 40}, shift=3)))["a"]
    assert after[: len(before)] == before and len(set(after)) == len(after)
    state = {r.source: r for r in cursors.states().collect()}["a"]
    assert (state.requested, state.held, state.exhausted) == (12, len(after), False)


def test_an_exhausted_source_is_not_asked(spark, tmp_path):
    cursors, calls = Cursors(spark, f"{tmp_path}/c"), []

    def fetch(ask):
        calls.append(sorted(r.source for r in ask.collect()))
        return answers(spark, {"a": 4, "b": 90})(ask)

    cursors.window(asked(spark, a=10, b=5), fetch)
    cursors.window(asked(spark, a=20, b=3), fetch)  # a is exhausted, b holds enough
    cursors.window(asked(spark, a=20, b=8), fetch)
    assert calls == [["a", "b"], ["b"]]


def test_pages_keep_their_surplus(spark, tmp_path):
    every = spark.createDataFrame([("a", i, f"a{i // 2}", "") for i in range(100)], "source string, ordinal int, source_id string, image_url string")
    asks = []

    def fetch(ask):
        asks.append([tuple(r) for r in ask.collect()])
        rows = every.join(ask, "source").where((F.col("ordinal") >= F.col("next_offset")) & (F.col("ordinal") < F.col("next_offset") + F.col("n"))).drop("next_offset", "n")
        return rows, ask.select("source", (F.col("next_offset") + F.col("n")).alias("next_offset"), (F.col("next_offset") + F.col("n") >= 100).alias("exhausted"))

    cursors = Cursors(spark, f"{tmp_path}/c")
    assert len(listed(cursors.pages(asked(spark, a=15), fetch))["a"]) == 20 and asks == [[("a", 0, 20)], [("a", 20, 20)]]
    assert len(listed(cursors.pages(asked(spark, a=18), fetch))["a"]) == 20 and len(asks) == 2
    assert listed(cursors.pages(asked(spark, a=500), fetch))["a"] == [f"a{i}" for i in range(50)]
    with pytest.raises(ValueError, match="advance"):
        Cursors(spark, f"{tmp_path}/d").pages(asked(spark, a=50), lambda ask: (every.limit(3), ask.select("source", "next_offset", F.lit(False).alias("exhausted"))))


# Pages by tokens


def token_fetch(chain, token):
    """Three pages whose tokens are words; the second repeats an id of the first."""
    pages = {"": (["a0", "a1"], "go"), "go": (["a1", "a2"], "on"), "on": (["a3"], None), "back": (["b"], "back")}
    rows, following = pages[token]
    return [(r,) for r in rows], following


def test_chains_are_followed(spark):
    rows = paging.read_chains(spark, "chains_a", "id string", token_fetch, ["x", "y"], 4)
    assert sorted((r.chain, r.ordinal, r.id) for r in rows.collect()) == [(c, k, i) for c in "xy" for k, i in enumerate(["a0", "a1", "a1", "a2"])]
    assert [i for _, (i,) in paging.followed(token_fetch, "x", 99, "go")] == ["a1", "a2", "a3"]
    with pytest.raises(ValueError, match="leads back"):
        list(paging.followed(token_fetch, "x", 99, "back"))


def test_a_stream_goes_on_at_its_token(spark, tmp_path):
    """A page a run; a run whose batch was not committed reads the same page again."""
    seen = []
    for k in range(4):
        stream = paging.stream_chain(spark, "chain_stream", "id string", token_fetch, "x")

        def step(batch, number, k=k):
            seen.append((number, sorted(r.id for r in batch.collect())))
            if k == 1:
                raise RuntimeError("lost")

        running = stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        try:
            running.awaitTermination()
        except Exception as e:
            assert "lost" in str(e)
    pages = [ids for _, ids in seen if ids]
    assert pages[0] == ["a0", "a1"] and pages[1] == pages[2] == ["a1", "a2"] and pages[-1] == ["a3"]


def test_fields_are_united_titles_first(spark):
    found = spark.createDataFrame([("text", 0, "wrong"), ("text", 1, "both"), ("text", 2, "text"), ("title", 0, "title"), ("title", 1, "both")], "field string, ordinal int, id string")
    records = spark.createDataFrame([
        ("wrong", "Watch at Night", "A guard observes the city."), ("text", "City Guard", "A night-watch patrol crosses the square."),
        ("title", "Copy of the Night Watch", "A painted copy."), ("both", "night watch", "the night watch"), ("apart", "Night", "Watch"),
    ], "id string, title string, text string")
    got = paging.field_union(found, ["title", "text"], "night watch", records, ["title", "text"], 10)
    assert [r.id for r in got.orderBy("position").collect()] == ["title", "both", "text"]
    assert [r.id for r in paging.field_union(found, ["title", "text"], "night watch", records, ["title", "text"], 2).orderBy("position").collect()] == ["title", "both"]
