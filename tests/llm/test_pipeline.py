"""The pipeline's stages against plain versions of what each decides."""

import random
import sys
from collections import Counter

import corpus_pipeline
import pytest
from gallerium.llm import queries

from .test_operators import check_packing, components_of, library, prose, removed

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rng = random.Random(11)
    speak = {"aa": "the an re er ing".split(), "bb": "ció que ado las ez".split()}
    say = lambda k, n: " ".join("".join(rng.choices(speak[k], k=3)) for _ in range(n))
    rows, labels = [], []
    for i in range(120):
        k = "ab"[i % 2] * 2
        text = say(k, 80)
        toxic = i % 6 == 0
        if toxic:
            text += " idiot and moron. you stupid loser"
        rows.append((i, text, k, f"s{i % 3}", len(text)))
        labels.append((i, 1, int(toxic)))
    copy = rows[1][1]
    rows += [(200, copy, "bb", "s", 1), (201, copy + " end", "bb", "s", 1), (202, None, None, "s", 0), (203, "12 34", None, "s", 5), (None, say("aa", 50), "aa", "s", 9)]
    passage = say("aa", 60)
    rows += [(300 + k, say("aa", 150) + " " + passage + " " + say("aa", 150), "aa", "s", 1) for k in range(3)]
    return rows, labels


def test_stages(spark, tmp_path):
    rows, labels = corpus()
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if name != "packing":
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        kept[name] = docs.collect()
    ids = lambda name: {r.doc_id for r in kept[name]}
    assert ids("language_id") == {r[0] for r in rows} - {202, 203}
    assert ids("toxicity") == ids("language_id") - {i for i, _, y in labels if y}
    before = [(r.doc_id, r.text) for r in kept["toxicity"] if r.doc_id is not None]
    label = components_of(before, 5, 80)
    assert ids("near_dedup") == {i for i, (_, root) in label.items() if i == root} | {None}
    assert 1 in ids("near_dedup") and not {200, 201} & ids("near_dedup")
    texts = {r.doc_id: r.text for r in kept["near_dedup"]}
    want = {i: r[3].decode("utf-8", "ignore") for i, r in zip(texts, removed([t.encode() for t in texts.values()]))}
    assert {r.doc_id: r.text for r in kept["suffix_dedup"]} == want
    assert all(r.n_chars == len(r.text) for r in kept["suffix_dedup"])
    tokenizer = library()
    check_packing(kept["packing"], {i: [*tokenizer.encode(t, add_special_tokens=False).ids, 1] for i, t in want.items()})
    whole = {tuple(r) for r in queries.pipeline(spark, str(tmp_path)).collect()}
    assert {(r.doc_id, r.start, r.length, r.ids_crc32) for r in kept["packing"]} == {x[:4] for x in whole}


EDGES = [
    (1, "the an re er ing the an re er ing one", "aa", "s", 1), (1, "the an re er ing the an re er ing another text of one id", "aa", "s", 1), (1, "the an re er ing the an re er ing one", "aa", "s", 1),
    (None, "the an re er ing of no id", "aa", None, None), (2, None, None, None, None), (3, "", "aa", "s", 0), (4, "ció que ado las ez ció que ado", "bb", "s", 1), (5, "word " * 9000, "aa", "s", 1),
]


def edge_frame(spark, rows=EDGES):
    """Columns that clash with those of the stages."""
    kind = COLUMNS + ", score double, predicted int, spans string, link_group long, text_key long, kept boolean, component_id long"
    return spark.createDataFrame([(*r, 0.1, 1, "x", 7, 8, True, 9) for r in rows], kind)


@pytest.fixture()
def edge_dir(spark, tmp_path):
    edge_frame(spark).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (4, 1, 0), (5, 0, 0), (None, 1, 1), (1, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_each_stage_bears_odd_rows(spark, edge_dir, name):
    """Nulls in any column, empty texts, rows that repeat, one id with two texts, clashing columns, and an empty table."""
    stage = dict(corpus_pipeline.STAGES)[name]
    docs = spark.read.parquet(f"{edge_dir}/documents.parquet")
    out = stage(spark, docs, edge_dir)
    rows = out.collect()
    given = Counter((r[0], r[1]) for r in EDGES)
    if name == "packing":
        assert sum(r.start == 0 for r in rows) == len(EDGES)  # each row begins once
    else:
        assert out.columns == [c.split()[0] for c in COLUMNS.split(", ")]
        got = Counter((r.doc_id, r.text) for r in rows)
    if name == "language_id":
        assert {k for k in got if k[0] != 5} == {(i, t) for i, t in given if t and i != 5} and all(given[k] == n for k, n in got.items())
    if name == "toxicity":
        assert got == given
    if name == "near_dedup":
        assert set(got) == set(given) and set(got.values()) == {1}
    if name == "suffix_dedup":  # all of the text of one word repeats
        assert {i for i, _ in got} == {1, None, 4} and not any(t is None or not t.strip() for _, t in got)
    none = stage(spark, spark.createDataFrame([], docs.schema), edge_dir)
    assert none.collect() == []


def test_an_empty_table_stays_empty(spark, tmp_path):
    edge_frame(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_the_whole_pipeline_bears_odd_rows(spark, edge_dir):
    pieces = corpus_pipeline.run(spark, edge_dir).collect()
    assert {r.doc_id for r in pieces} <= {1, None, 4, 5} and 4 in {r.doc_id for r in pieces}


def test_registered():
    sys.modules.pop("__spark_entry__", None)
    import __spark_entry__

    assert {f"op{n}" for n in range(1, 14)} | {"pipeline"} <= {k.split("_")[0] for k in __spark_entry__.queries()}
