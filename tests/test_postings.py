"""The stored index: pruned reads, segments, concepts, focus, and scores like the full scan's."""

import pytest
from pyspark.sql import functions as F

from gallerium.operators import catalog
from gallerium.sources import postings

WORKS = "id string, title string, artist string, date string, medium string, classification string, description string"
FIELDS = ["title", "artist", "date", "medium", "classification", "description"]


def built(spark, folder, rows):
    index = postings.Index(spark, f"{folder}/index", "id", FIELDS, buckets=16)
    index.add(spark.createDataFrame(rows, WORKS))
    return index


def found(index, query, need=10):
    return [r.id for r in postings.search(index, query, need).orderBy("position").collect()]


def test_words_of_several_fields(spark, tmp_path):
    index = built(spark, tmp_path, [
        ("7", "The Liberation of Saint Peter", "Example Artist", "1642", "oil on canvas", "Painting", "Saint Peter escaping prison"),
        ("8", "Unrelated Work", "Other Artist", "1700", "ink", "Drawing", "Not open"),
    ])
    assert found(index, "Peter prison") == ["7"] and found(index, "PRIS") == ["7"] and found(index, "drawing") == ["8"]
    assert found(index, "x ?") == [] and found(index, "peter nothing") == []


def test_a_concept_is_met_by_its_alias_or_its_phrase(spark, tmp_path):
    index = built(spark, tmp_path, [
        ("1", "Dr. Robert Fludd Physician and Rosicrucian", "Unknown", "1600", "engraving", "Print", "Portrait of a Rosicrucian physician"),
        ("2", "Christ on the Cross", "Unknown", "1500", "hand-colored in rose", "Print", "A figure on a wooden cross"),
        ("3", "Miner's Chair - Hand Made", "Rose Campbell-Gerke", "1940", "watercolor", "Drawing", "A chair with crossed legs"),
        ("4", "Rosette", "Unknown", "1940", "watercolor", "Drawing", "A cross-shaped ornament"),
        ("5", "The Rose Cross", "Unknown", "1940", "watercolor", "Drawing", ""),
        ("6", "Study", "Unknown", "1940", "rose cross", "Drawing", "medium alone can't carry it"),
    ])
    assert sorted(found(index, "rose cross")) == ["1", "5"]


def test_one_strong_field_must_carry_all_words(spark, tmp_path):
    far = " ".join(["word"] * 12)
    index = built(spark, tmp_path, [
        ("1", "Blue Study", "Example Artist", "1900", "ink", "Drawing", "An angel appears in blue robes"),
        ("2", "Another Study", "Blue Artist", "1900", "ink", "Drawing", "An angel appears"),
        ("3", "Third Study", "Example Artist", "1900", "blue pigment", "Drawing", "An angel appears"),
        ("4", "Fourth", "", "", "", "", f"blue {far} angel"),
        ("5", "Fifth", None, None, None, None, f"angel {far[5:]} blue"),
    ])
    assert sorted(found(index, "blue angel")) == ["1", "5"]


def test_marks_and_other_scripts(spark, tmp_path):
    index = built(spark, tmp_path, [("1", "Été à Paris", "", "", "", "", ""), ("2", "Война и мир", "", "", "", "", "漢字"), (None, "no key", "", "", "", "", "")])
    assert found(index, "ete") == ["1"] and found(index, "ÉTÉ") == ["1"] and found(index, "война мир") == ["2"] and found(index, "漢字") == ["2"]
    assert found(index, "key") == []


def test_segments_replace_rows(spark, tmp_path):
    index = built(spark, tmp_path, [("1", "old rose", "", "", "", "", ""), ("2", "rose", "", "", "", "", "")])
    index.add(spark.createDataFrame([("1", "new lily", "", "", "", "", ""), ("3", "rose garden", "", "", "", "", "")], WORKS))
    assert sorted(found(index, "rose")) == ["2", "3"] and found(index, "lily") == ["1"] and found(index, "old") == []
    last = index.segments()[-1]
    assert (last.segment, last.live, last.words) == (1, 3, 5)
    small = index.compact(f"{tmp_path}/small")
    assert [(s.live, s.words) for s in small.segments()] == [(3, 5)]
    assert [r.asDict() for r in postings.search(small, "rose", 5).orderBy("position").collect()] == [r.asDict() for r in postings.search(index, "rose", 5).orderBy("position").collect()]


def test_an_unnamed_segment_is_not_there(spark, tmp_path):
    index = built(spark, tmp_path, [("1", "rose", "", "", "", "", "")])
    lost = postings.postings(spark.createDataFrame([("9", "rose", "", "", "", "", "")], WORKS), "id", FIELDS)
    lost.withColumn("bucket", postings._bucket(F.col("token"), index.buckets)).write.partitionBy("bucket").parquet(f"{index.folder}/postings/segment=1")
    assert found(index, "rose") == ["1"]


def test_only_the_querys_buckets_are_read(spark, tmp_path):
    rows = [(str(i), f"w{chr(97 + i % 26)}{chr(97 + i % 7)}x word{i}", "", "", "", "", "rose" if i % 9 == 0 else "") for i in range(300)]
    index = built(spark, tmp_path, rows)
    plan = postings.hits(index, postings.parse("rose"))._jdf.queryExecution().executedPlan().toString()
    (bucket,) = spark.range(1).select(postings._bucket(F.lit("rose"), index.buckets)).first()
    assert f"(bucket#" in plan.split("PartitionFilters")[1] and f" = {bucket})" in plan.split("PartitionFilters")[1]
    assert "StringStartsWith(token,rose)" in plan
    two = postings.hits(index, postings.parse("rose waax"))._jdf.queryExecution().executedPlan().toString()
    assert " IN (" in two.split("PartitionFilters")[1] and "EqualTo(token,rose)" in two


def test_scores_are_those_of_the_scan(spark, tmp_path):
    rows = [(str(i), " ".join(["rose"] * (i % 4) + ["cross"] * (i % 3) + ["filler"] * i), "", "", "", "", "rose" * (i % 2)) for i in range(40)]
    index, frame = built(spark, tmp_path, rows), spark.createDataFrame(rows, WORKS)
    for query in ("rose filler", "fill"):
        want = {r.id: r.score for r in catalog.bm25(frame, "id", postings.WEIGHTS, query).collect()}
        got = {r.key: r.score for r in postings.hits(index, postings.parse(query)).collect()}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_no_index_and_an_empty_one(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        postings.search(postings.Index(spark, str(tmp_path / "none"), "id", FIELDS), "rose", 3)
    index = built(spark, tmp_path, [])
    assert found(index, "rose") == [] and [tuple(s)[:3] for s in index.segments()] == [(0, 0, 0)]


def test_no_task_writes_a_whole_bucket(spark, tmp_path, monkeypatch):
    """Rows and postings of one bucket are dealt over several parts once there are more rows than one part holds."""
    monkeypatch.setattr(postings, "ROWS_A_PART", 100)
    index = postings.Index(spark, str(tmp_path / "dealt"), "id", ["title"], buckets=1)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        index.add(spark.range(1000).select("id", F.concat(F.lit("word "), "id").alias("title")))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for kind in ("rows", "postings"):
        files = spark.read.parquet(str(tmp_path / "dealt" / kind)).groupBy(F.input_file_name()).count().collect()
        assert len(files) > 1 and max(r["count"] for r in files) < sum(r["count"] for r in files) * 0.7
    assert {r.id for r in postings.search(index, "word 77", 50).collect()} >= {77}
