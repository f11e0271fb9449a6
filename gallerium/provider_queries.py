"""Registered queries of provider payloads, word matching, delivery, snapshots and live sessions, with their SQL."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from .functions import images
from .functions import scoring as S
from .functions import text as T
from .functions import words as W
from .operators import delivery, families, items, matches, staged, tournament
from .plans import phrases, snapshot, translation
from .queries import FOLD, HOLDS, TOKENS, document_items, first_vector, query, table, votes, with_copies
from .sources import pages as html
from .sources import archives, composed, cursors, live_catalog as live_catalogs, paging, records, registry, stores
from .streaming import live

# Word matching and evidence


def undoubled(k: int) -> str:
    base = f"left(w, length(w) - {k})"
    return f"CASE WHEN length({base}) > 2 AND {base}[-1] = {base}[-2] THEN left({base}, length({base}) - 1) ELSE {base} END"


@query(
    f"""WITH t AS (SELECT DISTINCT unnest({FOLD.format('text')}) AS w FROM documents) SELECT w, CASE WHEN length(w) > 5 AND w LIKE '%ies' THEN left(w, length(w) - 3) || 'y' WHEN length(w) > 5 AND w LIKE '%ing' THEN {undoubled(3)}
    WHEN length(w) > 4 AND w LIKE '%ed' THEN {undoubled(2)} WHEN length(w) > 4 AND w LIKE '%es' THEN left(w, length(w) - 2) WHEN length(w) > 3 AND w LIKE '%s' THEN left(w, length(w) - 1) ELSE w END AS stem FROM t"""
)
def word_stems(spark, sf_dir):
    words = table(spark, sf_dir, "documents").select(F.explode(T.fold_tokens("text")).alias("w")).distinct()
    return words.select("w", W.stem(F.col("w")).alias("stem"))


@query()
def concept_relevance(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", W.matched_words("motion stations theater")("text").alias("matched"), W.relevant("motion stations theater", F.col("text")).alias("relevant"))


@query()
def gallery_scores(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", W.match_score("tion was his")("text").alias("score")).where("score > 0")


@query()
def centered_excerpts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", W.centered_excerpts("tion", 300)("text").alias("excerpt"))


@query(
    f"""WITH i AS (SELECT doc_id, coalesce(string_split(text, '.')[1], '') AS title, coalesce(text, '') AS description FROM documents),
    m AS (SELECT doc_id, list_sort(list_intersect({TOKENS.format('title')}, ['tion', 'was'])) AS a, list_sort(list_intersect({TOKENS.format('description')}, ['tion', 'was'])) AS b FROM i),
    f AS (SELECT doc_id, a, b, list_sort(list_distinct(list_concat(a, b))) AS ab FROM m)
    SELECT doc_id, array_to_string(list_concat(CASE WHEN len(a) > 0 THEN ['Title'] ELSE [] END, CASE WHEN len(b) > 0 THEN ['Description'] ELSE [] END), '|') AS fields, array_to_string(ab, '|') AS found,
    array_to_string([x FOR x IN ['tion', 'was'] IF NOT list_contains(ab, x)], '|') AS missing, CASE WHEN len(ab) > 0 THEN 'supported' ELSE 'provider_returned_without_visible_evidence' END AS status FROM f"""
)
def match_evidence(spark, sf_dir):
    docs = document_items(spark, sf_dir).select("doc_id", "title", F.col("text").alias("description"))
    found = matches.evidence(docs, "was tion")
    joined = {"fields": "matched_fields", "found": "matched_query_terms", "missing": "missing_query_terms"}
    return found.select("doc_id", *[F.array_join(c, "|").alias(k) for k, c in joined.items()], F.col("match_evidence_status").alias("status"))


# Delivery


@query(
    """WITH i AS (SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'curated' WHEN 1 THEN 'aic' ELSE 'met' END AS source, CASE WHEN p_size % 4 = 0 THEN '' ELSE 'https://p.test/' || p_partkey END AS page, CASE WHEN p_size % 5 = 0 THEN '' ELSE 'https://i.test/' || p_partkey END AS image, CASE WHEN p_size % 2 = 0 THEN 'commons' ELSE 'mirror' END AS d FROM part)
    SELECT p_partkey, CASE WHEN source = 'curated' AND image <> '' THEN image WHEN page <> '' THEN page ELSE image END AS preview_click_url, CASE WHEN source = 'curated' AND image <> '' THEN 'open_original' ELSE 'open_page' END AS preview_click_action, CASE WHEN source = 'aic' AND d <> 'commons' THEN '' ELSE image END AS download_url FROM i"""
)
def preview_rules(spark, sf_dir):
    size = F.col("p_size")
    address = lambda host, k: F.when(size % k == 0, "").otherwise(F.concat(F.lit(f"https://{host}.test/"), "p_partkey"))
    part = table(spark, sf_dir, "part").select("p_partkey", F.when(size % 3 == 0, "curated").when(size % 3 == 1, "aic").otherwise("met").alias("source"), address("p", 4).alias("page_url"), address("i", 5).alias("image_url"), F.lit("").alias("full_resolution_url"), F.when(size % 2 == 0, "commons").otherwise("mirror").alias("image_delivery"), F.lit(False).alias("requires_source_visit"))
    return delivery.previews(part).select("p_partkey", "preview_click_url", "preview_click_action", "download_url")


@query("SELECT page_id, url LIKE 'https://%' AND regexp_extract(url, '//([^/]*)', 1) LIKE 'th%.example.com' AS may, CASE WHEN regexp_extract(url, '//([^/]*)', 1) LIKE '%.example.com' THEN 'example' END AS source FROM pages")
def proxy_hosts(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.parse_url("url", F.lit("HOST")).alias("host"))
    allowed = pages.where("host like 'th%.example.com'").select(F.lower("host").alias("allowed")).distinct()
    told = pages.join(allowed, F.lower("host") == F.col("allowed"), "left")
    return delivery.source_of_domain(told, "host", [("example", "example.com"), ("net", "example.net")]).select("page_id", delivery.may_proxy(F.col("url"), F.col("allowed")).alias("may"), F.when(F.col("source") == "example", F.col("source")).alias("source"))


@query("SELECT p_partkey, 'https://w.test/' || p_partkey || '-' || trim(regexp_replace(lower(strip_accents(p_name || ' É ' || p_type)), '[^a-z0-9]+', '-', 'g'), '-') AS url FROM part")
def artwork_slugs(spark, sf_dir):
    title = F.concat("p_name", F.lit(" É "), "p_type")
    return table(spark, sf_dir, "part").select("p_partkey", delivery.artwork_url("https://w.test/", F.col("p_partkey").cast("string"), title).alias("url"))


@query(
    """WITH i AS (SELECT p_partkey, ['jpg', 'jpeg', 'png', 'tif', 'bmp'][p_size % 5 + 1] AS e, p_size % 7 AS w, p_size % 6 AS h FROM part)
    SELECT p_partkey, CASE e WHEN 'jpg' THEN 'JPG' WHEN 'jpeg' THEN 'JPG' WHEN 'png' THEN 'PNG' WHEN 'tif' THEN 'TIFF' ELSE 'GIF' END AS kind, round(greatest(least(CASE WHEN w > 0 AND h > 0 THEN w / h ELSE 1.38 END, 2.8), 0.62), 4)::DOUBLE AS ratio FROM i"""
)
def tile_projections(spark, sf_dir):
    size = F.col("p_size")
    part = table(spark, sf_dir, "part").withColumn("e", F.element_at(F.array(*map(F.lit, ("jpg", "jpeg", "png", "tif", "bmp"))), (size % 5 + 1).cast("int")))
    return part.select("p_partkey", images.file_type(F.concat(F.lit("https://i.test/a."), "e", F.lit("?x=1")), F.lit("image/gif")).alias("kind"), F.round(images.tile_ratio(size % 7, size % 6), 4).alias("ratio"))


@query("SELECT p_partkey, ['image/jpeg', 'image/png', 'image/gif', 'image/webp', NULL][p_size % 5 + 1] AS mime FROM part")
def mime_types(spark, sf_dir):
    heads = ("FFD8FFE000104A464946000101", "89504E470D0A1A0A0000000D49", "474946383961010001000000", "524946460000000057454250AA", "00112233")
    data = F.unhex(F.element_at(F.array(*map(F.lit, heads)), (F.col("p_size") % 5 + 1).cast("int")))
    return table(spark, sf_dir, "part").select("p_partkey", images.mime_type(data).alias("mime"))


@query()
def image_fingerprints(spark, sf_dir):
    """Of 8 by 4 pixels made from a hash of each part."""
    raw = F.unhex(F.concat(*[F.sha2(F.concat(F.col("p_partkey").cast("string"), F.lit(s)), 256) for s in "abc"]))
    f = images.fingerprints(raw, F.lit(8), F.lit(4))
    return table(spark, sf_dir, "part").select("p_partkey", f.alias("f")).select("p_partkey", F.size("f.color").alias("bins"), F.size(F.filter("f.dhash", lambda x: x)).alias("rises"), F.round("f.aspect", 4).alias("aspect"))


# Provider payloads, made from parts and read back

ROWS_A_TASK = 20_000


def dealt_parts(spark, sf_dir):
    """Parts in tasks of so many rows, by key: a row of few bytes becomes a payload of many, so that a reader's splits, which go
    by bytes, are too few and too large."""
    part = table(spark, sf_dir, "part")
    return part.repartition(part.count() // ROWS_A_TASK + 1, "p_partkey")


@query("SELECT p_partkey::VARCHAR AS source_id, p_name AS title, 'a' || p_brand || '; b' AS artist, 'https://i.test/u' || p_partkey || '/full/max/0/default.jpg' AS image_url, p_size % 3 = 0 AS is_volume FROM part WHERE p_size % 2 = 0")
def open_content_records(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    license = F.when(F.col("p_size") % 2 == 0, f"{records.CC0_LICENSES[0]}/").otherwise("all rights reserved")
    producers = F.array(*[F.struct(n.alias("primary_name")) for n in (F.concat(F.lit("a"), "p_brand"), F.lit(" "), F.lit("b"), F.lit("fourth"))])
    record = F.struct(F.concat(F.lit("object/"), "p_partkey").alias("id"), F.col("p_name").alias("primary_name"), (F.col("p_size") % 3 == 0).alias("is_parent"), producers.alias("producers"), F.struct(F.concat(F.lit("u"), "p_partkey").alias("thumbUuid"), license.alias("license")).alias("manifest"))
    payloads = part.select(F.to_json(F.struct(F.array(record).alias("data"))).alias("payload"))
    return records.open_content(payloads, "https://i.test", "https://p.test").select("source_id", "title", "artist", "image_url", "is_volume")


@query("SELECT p_partkey AS key, 'page ' || p_brand || ' stations' AS label, 'https://i.test/' || p_partkey || '/full/max/0/default.jpg' AS image_url, 'c2' AS canvas_id FROM part WHERE p_size % 2 = 0")
def manifest_pages(spark, sf_dir):
    part = dealt_parts(spark, sf_dir)
    label = lambda text: F.struct(F.array(text).alias("en")).alias("label")
    body = F.struct(F.concat(F.lit("http://i.test/"), "p_partkey", F.lit("/full/max/0/default.jpg")).alias("id")).alias("body")
    canvas = lambda k, text: F.struct(F.lit(f"https://m.test/c{k}").alias("id"), label(text), F.array(F.struct(F.array(F.struct(body)).alias("items"))).alias("items"))
    second = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("page "), "p_brand", F.lit(" stations"))).otherwise("Main View")
    manifest = F.struct(F.array(canvas(1, F.lit("cover")), canvas(2, second), canvas(3, F.concat(second, F.lit(" and another longer label")))).alias("items"))
    return records.matching_pages(part.select(F.col("p_partkey").alias("key"), F.to_json(manifest).alias("payload")), "key", "page station").select("key", "label", "image_url", "canvas_id")


@query("SELECT p_partkey AS key, p_name AS title, 'maker ' || p_brand AS artist, 'https://i.test/' || p_partkey || '/full/max/0/default.jpg' AS image_url, p_size AS width, 'A ' || p_type AS description FROM part WHERE p_size % 3 = 0")
def linked_records(spark, sf_dir):
    part = dealt_parts(spark, sf_dir)
    access = F.array(F.struct(F.concat(F.lit("http://i.test/"), "p_partkey", F.lit("/")).alias("id"))).alias("access_point")
    image = F.array(F.struct(F.lit("DigitalService").alias("type"), F.col("p_size").alias("width"), access)).alias("representation")
    statement = lambda text, language: F.struct(text.alias("content"), F.array(F.struct(F.lit("Description").alias("_label"))).alias("classified_as"), F.array(F.struct(F.lit(language).alias("id"))).alias("language"))
    rights = F.when(F.col("p_size") % 3 == 0, "Public Domain").otherwise("in copyright").alias("rights")
    made = F.struct(F.array(F.struct(F.array(F.struct(F.concat(F.lit("maker "), "p_brand").alias("_label"))).alias("carried_out_by"))).alias("part")).alias("produced_by")
    record = F.struct(F.concat(F.lit("https://l.test/data/"), "p_partkey").alias("id"), F.col("p_name").alias("_label"), F.lit(records.MUSEUMS[0]).alias("member_of"), rights, image, made, F.array(statement(F.lit("Eine"), "x"), statement(F.concat(F.lit("<p>A "), "p_type", F.lit("</p>")), records.ENGLISH)).alias("referred_to_by"))
    return records.linked_records(part.select(F.col("p_partkey").alias("key"), F.to_json(record).alias("payload")), "key").select("key", "title", "artist", "image_url", "width", "description")


@query("SELECT p_partkey::VARCHAR AS source_id, p_name AS title, 'https://i.test/a/' || p_partkey || '.jpg' AS image_url, p_brand AS artist, p_type AS medium FROM part WHERE p_size % 4 <> 0")
def styled_images(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    thumb = F.when(F.col("p_size") % 4 != 0, F.concat(F.lit("http://i.test/a/styles/small/public/"), "p_partkey", F.lit(".jpg?itok=1")))
    entity = lambda c, name: F.array(F.struct(F.struct(c.alias(name)).alias("entity")))
    record = F.struct(F.col("p_partkey").cast("string").alias("entityId"), F.col("p_name").alias("title"), entity(thumb, "vignette").alias("fieldVisuelsPrincipals"), entity(F.col("p_brand"), "name").alias("fieldOeuvreAuteurs"), entity(F.col("p_type"), "name").alias("fieldMateriauxTechnique"))
    payloads = part.select(F.to_json(F.struct(F.struct(F.struct(F.array(record).alias("entities")).alias("nodeQuery")).alias("data"))).alias("payload"))
    return records.styled_images(payloads).select("source_id", "title", "image_url", "artist", "medium")


@query(
    """SELECT p_partkey AS id, p_name AS title, CASE p_size % 3 WHEN 0 THEN 'Ann ' || p_brand WHEN 1 THEN 'Bea' ELSE 'Cy' END AS artist, CASE p_size % 3 WHEN 0 THEN '1' || (100 + p_size) WHEN 1 THEN 'circa 1500' ELSE '' END AS date,
    CASE WHEN p_size % 2 = 0 THEN 'https://w.test/up/a b.jpg'.replace(' ', '%20') ELSE 'https://w.test/up/x-scaled.jpg' END AS image_url, CASE WHEN p_size % 2 = 0 THEN 0 ELSE p_size END::INT AS width, 'https://w.test/up/x-m.jpg' AS thumb_url FROM part"""
)
def media_library(spark, sf_dir):
    part, size = table(spark, sf_dir, "part"), F.col("p_size")
    rich = F.when(size % 3 == 0, F.concat(F.lit("Artist: Ann "), "p_brand", F.lit("\nDate: 1"), size + 100)).when(size % 3 == 1, "Painted by Bea (born here), circa 1500 or so").otherwise("Nothing stated")
    details = F.struct(size.alias("width"), size.alias("height"), F.when(size % 2 == 0, "a b.jpg").alias("original_image"), F.create_map(F.lit("medium"), F.struct(F.lit("https://w.test/up/x-m.jpg").alias("source_url"))).alias("sizes"), F.struct(F.lit("Cy").alias("credit")).alias("image_meta"))
    record = F.struct(F.col("p_partkey").alias("id"), F.struct(F.concat(F.lit("<b>"), "p_name", F.lit("</b>")).alias("rendered")).alias("title"), F.lit("https://w.test/up/x-scaled.jpg").alias("source_url"), details.alias("media_details"), F.struct(rich.alias("description")).alias("jetpack_videopress"))
    payloads = part.select(F.to_json(F.array(record)).alias("payload"))
    return records.media_library(payloads).select("id", "title", "artist", "date", "image_url", "width", "thumb_url")


@query("SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN '' ELSE p_brand END AS artist, CASE WHEN p_size % 2 = 0 THEN p_type || ', x' ELSE p_type END AS place, CASE WHEN p_size % 3 = 0 THEN 'XIe siècle' ELSE '' END AS date FROM part")
def creation_units(spark, sf_dir):
    size = F.col("p_size")
    line = F.concat_ws(" - ", F.lit("Ms. 1"), F.when(size % 4 == 0, "Artiste non identifié").otherwise(F.col("p_brand")), "p_type", F.when(size % 2 == 0, "x"), F.when(size % 3 == 0, "XIe siècle"))
    return table(spark, sf_dir, "part").select("p_partkey", *[c.alias(k) for k, c in records.creation_unit(line).items()])


@query("SELECT p_partkey, p_size % 3 = 0 AND p_size % 2 <> 0 AS bare FROM part")
def document_pages(spark, sf_dir):
    size = F.col("p_size")
    title = F.when(size % 3 == 0, "File:Illustrations_of_Oaks - DPLA - 0123456789abcdef01 (page 7).jpg").otherwise("File:Oak.jpg")
    text = F.when(size % 2 == 0, "Illustrations of Oaks, plate 4").otherwise("Illustrations of Oaks")
    return table(spark, sf_dir, "part").select("p_partkey", records.bare_document_page(title, [text], [F.lit(None).cast("string")]).alias("bare"))


@query("SELECT 'MET ' || p_size AS categories, min(p_partkey) AS number FROM part GROUP BY p_size")
def primary_views(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(F.concat(F.lit("front DT"), "p_partkey", F.lit(".jpg")).alias("title"), F.concat(F.lit("MET "), "p_size", F.lit("")).alias("categories"))
    two_digits = part.withColumn("categories", F.regexp_replace("categories", r"^MET (\d)$", "MET 0$1"))
    found = records.primary_views(two_digits)
    return found.select(F.regexp_replace("categories", r"^MET 0", "MET ").alias("categories"), F.regexp_extract("title", r"DT(\d+)", 1).cast("long").alias("number"))


@query("SELECT p_partkey, p_type || ' Series: b. Other title: ' || p_brand || '.' AS narrative FROM part")
def narratives(spark, sf_dir):
    one = lambda text, kind, at: F.struct(text.alias("title"), F.lit(kind).alias("titletype"), F.lit(at).alias("displayorder"))
    titles = F.array(one(F.col("p_brand"), "", 0), one(F.upper("p_name"), "Main", 1), one(F.lit("<i>b</i>"), "Series", 2))
    return table(spark, sf_dir, "part").select("p_partkey", records.narrative(F.col("p_name"), titles, F.lit(""), F.col("p_type")).alias("narrative"))


@query("SELECT event_id AS id, value FROM events")
def paged_source(spark, sf_dir):
    """Events as a provider that gives them by offsets, at most two hundred at once; its pages lie in the shared folder."""
    events = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "value")
    folder = f"{families.shared_folder(spark)}/offsets-{uuid.uuid4().hex}"
    events.withColumn("page", F.floor(F.col("id") / 200)).repartition("page").write.partitionBy("page").parquet(folder)

    def fetch(offset: int, need: int):
        import pyarrow.parquet as pq
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
        files = [f.path for f in system.get_file_info(fs.FileSelector(f"{path}/page={offset // 200}", allow_not_found=True)) if f.path.endswith(".parquet")]
        held = [pq.read_table(f, filesystem=system, partitioning=None).to_pydict() for f in files]
        rows = sorted((i, v) for t in held for i, v in zip(t["id"], t["value"]) if i >= offset)[:need]
        return rows, offset + len(rows)

    return paging.read_paged(spark, f"paged_{uuid.uuid4().hex}", "id long, value double", fetch, events.count(), 700)


@query()
def identity_fold(spark, sf_dir):
    """Events as rows of pages that name a user and a value: those whose identities no earlier accepted row has."""
    events = table(spark, sf_dir, "events").select("event_id", F.col("user_id").cast("string").alias("source_id"), F.round(F.col("value") * 10).cast("long").cast("string").alias("image_url"))
    return paging.first_of_identities(events, "event_id", ["source_id", "image_url"])


@query("SELECT p_name AS source_id, min(p_partkey) AS page_id, arg_min('i' || p_partkey || '.jpg', p_partkey) AS image_url, arg_min(p_type, p_partkey) AS title FROM part GROUP BY p_name")
def gallery_pages(spark, sf_dir):
    """Pages made from parts: an image in a gallery anchor, one elsewhere."""
    page = F.concat(F.lit('<a href="/shop/x.html"><img src="no.jpg"></a><a href="/gallery/'), "p_name", F.lit('.html"><img src="i'), "p_partkey", F.lit('.jpg" alt="'), "p_type", F.lit('"></a>'))
    pages = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("page_id"), page.alias("html"))
    return html.gallery_images(pages, "/gallery/").select("source_id", "page_id", "image_url", "title")


# Snapshots


@query(
    """WITH b AS (SELECT vec_id, embedding::DOUBLE[] AS v, [0.985, 0.97, 0.96, 0.93][vec_id % 4 + 1]::DOUBLE AS a FROM embeddings),
    m AS (SELECT vec_id + 1000000 AS vec_id, list_transform(range(1, 65), lambda i: a * v[i] + sqrt(1 - a * a) * v[i % 64 + 1]) AS v FROM b),
    n AS (SELECT vec_id, v FROM b UNION ALL SELECT vec_id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) FROM m),
    p AS (SELECT x.vec_id AS a, y.vec_id AS b FROM n x JOIN n y ON x.vec_id < y.vec_id WHERE list_dot_product(x.v, y.v) >= 0.9)
    SELECT 'edge' AS kind, a, b FROM p WHERE a % 5 <> 0 AND b % 5 <> 0 UNION SELECT 'pending', a, 0 FROM p WHERE a % 5 = 0 UNION SELECT 'pending', b, 0 FROM p WHERE b % 5 = 0"""
)
def snapshot_images(spark, sf_dir):
    one = F.array(F.lit(1.0).cast("float"))
    items = with_copies(spark, sf_dir).select("vec_id", "embedding", F.lit(10).alias("width"), F.lit(10).alias("height"), (F.col("vec_id") % 5 != 0).alias("ready"), one.alias("color"), one.alias("gray"), F.array(F.lit(True)).alias("dhash"), F.lit(0.0).alias("aspect"))
    edges, waits = snapshot.image_edges(items)
    return edges.select(F.lit("edge").alias("kind"), "a", "b").unionAll(waits.select(F.lit("pending"), "vec_id", F.lit(0).cast("long")))


@query(
    """WITH q AS (SELECT embedding::DOUBLE[] AS v, label FROM embeddings WHERE vec_id = 0), c AS (SELECT vec_id AS id, list_dot_product(embedding::DOUBLE[], v) AS cosine, (embeddings.label = q.label)::INT AS same, abs(ln(1.0 / (1 + vec_id % 3))) AS d FROM embeddings, q WHERE vec_id <> 0)
    SELECT id, round(0.72 * cosine + 0.28 * (0.7 * same + 0.3 * exp(-d)), 4)::DOUBLE AS similarity FROM c ORDER BY similarity DESC, id LIMIT 16"""
)
def similar_items(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    me = vectors.where("vec_id = 0").first()
    items = vectors.where("vec_id <> 0").select(F.col("vec_id").alias("id"), "embedding", F.array(F.col("label").cast("string")).alias("words"), F.lit(100).alias("width"), (100 * (1 + F.col("vec_id") % 3)).alias("height"), F.lit(0.0).alias("rank_score"))
    return snapshot.similar(items, {"embedding": first_vector(vectors), "words": [str(me.label)], "width": 100, "height": 100}, 16).select("id", "similarity")


@query("SELECT p_partkey, coalesce(CASE WHEN p_size % 3 = 0 THEN p_size END, CASE WHEN p_size % 5 = 0 THEN p_size + 100 END)::INT AS vector FROM part")
def vector_attach(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("t"), "p_partkey").alias("thumb_url"), F.concat(F.lit("i"), "p_partkey").alias("image_url"), "p_size")
    vectors = part.where("p_size % 3 = 0").select(F.col("thumb_url").alias("url"), F.col("p_size").alias("vector")).unionAll(part.where("p_size % 5 = 0").select("image_url", F.col("p_size") + 100))
    return delivery.attach_vectors(part.drop("p_size"), vectors).select("p_partkey", "vector")


@query(
    """WITH l AS (SELECT p_partkey AS k, 0 AS priority FROM part WHERE p_size % 7 = 0 UNION ALL SELECT p_partkey, 1 FROM part WHERE p_size % 5 = 0)
    SELECT k::VARCHAR AS source_id, min(priority)::INT AS priority FROM l GROUP BY k ORDER BY min(priority), k LIMIT 100"""
)
def catalog_merge(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("source_id"), F.col("p_partkey").alias("ord"), "p_size")
    pick = lambda k: part.where(F.col("p_size") % k == 0).drop("p_size")
    return snapshot.catalog_search(pick(7), pick(5), [pick(2)], 50).select("source_id", "priority")


@query()
def tournament_ranking(spark, sf_dir):
    fitted = tournament.fit(votes(spark, sf_dir), spark.range(200))
    return fitted.orderBy(F.desc(fitted.columns[1]), "id").limit(100)


# Live sessions


EVENT_STATE = "SELECT event_id, ['finished', 'fetching', 'queued', 'failed', 'incomplete'][event_id % 5 + 1] AS stage, event_id % 3 <> 0 AS selected FROM events"


def event_states(spark, sf_dir):
    stage = F.element_at(F.array(*map(F.lit, ("finished", "fetching", "queued", "failed", "incomplete"))), (F.col("event_id") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", stage.alias("stage"), (F.col("event_id") % 3 != 0).alias("selected"), F.lit("why").alias("stop_reason"), F.lit(2).alias("failed_scores"))


@query(f"WITH s AS ({EVENT_STATE}) SELECT stage, count(*) AS n, list_position(['finished', 'fetching', 'scoring', 'evaluating', 'queued', 'paused', 'incomplete', 'failed'], stage)::BIGINT AS ordinal FROM s WHERE selected GROUP BY stage")
def session_progress(spark, sf_dir):
    return live.progress(event_states(spark, sf_dir))


@query(f"WITH s AS ({EVENT_STATE}) SELECT event_id, CASE WHEN stage IN ('failed', 'incomplete') THEN 'queued' ELSE stage END AS stage, CASE WHEN stage NOT IN ('failed', 'incomplete') THEN 'why' END AS stop_reason FROM s")
def session_retry(spark, sf_dir):
    return live.retry(event_states(spark, sf_dir)).select("event_id", "stage", "stop_reason")


@query("SELECT event_id AS id, CASE WHEN event_id % 3 = 0 AND event_id % 2 = 0 THEN event_id ELSE value END::DOUBLE AS score FROM events")
def session_scores(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    scores = events.where("event_id % 3 = 0").select((F.col("event_id")).alias("id"), F.when(F.col("event_id") % 2 == 0, F.col("event_id").cast("double")).alias("score"))
    unknown = scores.select((F.col("id") + 10_000_000_000).alias("id"), "score")
    return live.merge_scores(events.select(F.col("event_id").alias("id"), F.col("value").alias("score")), scores.unionAll(unknown), ["score"]).select("id", "score")


@query("SELECT event_id FROM (SELECT event_id, user_id % 4 AS g, max(user_id % 4) OVER (PARTITION BY user_id % 50) AS r FROM events) WHERE g = r")
def session_generations(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 50).alias("session"), (F.col("user_id") % 4).alias("generation"))
    return live.current(events, events.groupBy("session").agg(F.max("generation").alias("revision"))).select("event_id")


@query("WITH n AS (SELECT max(ts) AS t FROM events) SELECT event_id AS session FROM events, n WHERE ts > t - INTERVAL 30 MINUTES ORDER BY ts DESC, event_id LIMIT 24")
def session_limits(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    now = F.lit(events.agg(F.max("ts")).first()[0])
    return live.live_sessions(events.select(F.col("event_id").alias("session"), F.col("ts").alias("created"), F.col("ts").alias("touched")), now).select("session")


@query("WITH n AS (SELECT max(ts) AS t FROM events), f AS (SELECT user_id AS key, max(ts) AS latest, arg_max(event_id, ts) AS event_id FROM events, n WHERE ts > t - INTERVAL 300 SECONDS GROUP BY user_id) SELECT key, event_id FROM f ORDER BY latest DESC, key LIMIT 256")
def batch_cache(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    now = F.lit(events.agg(F.max("ts")).first()[0])
    return live.cached_batches(events.select(F.col("user_id").alias("key"), F.col("ts").alias("at"), "event_id"), now).select("key", "event_id")


@query("WITH r AS (SELECT event_id AS id, user_id % 3 AS source, ts, row_number() OVER (PARTITION BY user_id % 3 ORDER BY ts, event_id) AS turn FROM events) SELECT id, source FROM r WHERE turn <= 2 ORDER BY turn, ts, id LIMIT 5")
def fair_admission(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), (F.col("user_id") % 3).alias("source"), F.col("ts").alias("at"))
    return live.admitted(events, 2, 5).select("id", "source")


@query(
    """SELECT event_id, CASE WHEN event_id % 4 = 0 THEN '' WHEN event_id % 20 > 15 THEN 'Connection uncertain — reconnect to check this search.' WHEN event_id % 50 + event_id % 20 >= 30 THEN 'Still connected · no new results or completed work for ' || (event_id % 50 + event_id % 20) || 's' ELSE 'Connected · search in progress' END AS text FROM events"""
)
def connection_text(spark, sf_dir):
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select("event_id", live.connection(e % 4 != 0, e % 20, e % 50).alias("text"))


@query("SELECT user_id AS session, min(ts) FILTER (event_type = 'view') AS first_visible, min(ts) FILTER (event_type = 'click') AS first_scored, min(ts) FILTER (event_type = 'click' AND event_id % 100 >= 50) AS fifty_scored, max(ts) FILTER (event_type = 'purchase') AS settled FROM events GROUP BY user_id")
def search_milestones(spark, sf_dir):
    t = F.col("event_type")
    kind = F.when(t == "view", "visible").when(t == "click", "scored").when(t == "purchase", "top")
    return live.milestones(table(spark, sf_dir, "events").select(F.col("user_id").alias("session"), F.col("ts").alias("at"), kind.alias("kind"), F.greatest(F.col("event_id") % 100, F.lit(1)).alias("n")))


@query("SELECT event_type AS name, round(sum(value), 2) AS total, max(value) AS peak, count(*) AS events FROM events GROUP BY event_type")
def trace_metrics(spark, sf_dir):
    return live.metrics(table(spark, sf_dir, "events").select(F.col("event_type").alias("name"), "value")).withColumn("total", F.round("total", 2))


@query("WITH n AS (SELECT max(ts) AS t FROM events) SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'finished' WHEN NOT epoch(ts) + CASE WHEN event_id % 2 = 0 THEN 60 ELSE 3600 END < epoch(t) THEN 'running' WHEN event_id % 3 < 2 THEN 'retry' ELSE 'failed' END AS outcome FROM events, n")
def work_deadlines(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    now, e = F.lit(events.agg(F.max("ts")).first()[0]), F.col("event_id")
    work = events.select("event_id", F.when(e % 2 == 0, "score").otherwise("fetch").alias("kind"), F.col("ts").alias("started"), (e % 3).alias("attempt"), (e % 5 == 0).alias("done"))
    return live.deadlines(work, now, {"score": 60, "fetch": 3600}).select("event_id", "outcome")


# Searches in a collection's own words, and cursors

LABELS = ((0, "german", "de"), (1, "french (language)", "fr"), (2, "the", "der"), (3, "tion", "cion"), (4, "ing", "ung (suffix)"))
ASKED = ((0, "german"), (1, "French"), (2, "ing tion"), (3, "was tion"), (4, "was nowhere"), (5, "tion was his of and or not"))
NEED = 120
#: What the thesaurus makes of the queries: query, rank, kind, words, whether it stands in.
SEARCHES = """(0, 0, 'keyword', ['de'], false), (0, 1, 'text', ['de'], false), (1, 0, 'keyword', ['fr'], false), (1, 1, 'text', ['fr'], false), (2, 0, 'text', ['ung', 'cion'], false), (2, 1, 'text', ['ing', 'tion'], true),
    (3, 0, 'text', ['was', 'tion'], false), (3, 1, 'text', ['cion'], true), (4, 0, 'text', ['was', 'nowhere'], false), (5, 0, 'text', ['tion', 'was', 'his', 'of', 'and', 'or', 'not'], false)"""


@query(
    f"""WITH s(query_id, rank, kind, words, if_empty) AS (VALUES {SEARCHES}), d AS (SELECT doc_id, 'images/' || md5(text) AS image_url, lang, list_distinct({FOLD.format('text')}) AS held FROM documents),
    m AS (SELECT query_id, rank, if_empty, doc_id, image_url, row_number() OVER (PARTITION BY query_id, rank ORDER BY doc_id) - 1 AS nth FROM d, s WHERE CASE kind WHEN 'text' THEN len(list_intersect(held, words)) = len(words) ELSE list_contains(words, lang) END),
    l AS (SELECT *, nth // 50 AS page FROM m WHERE nth < 150),
    p AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY query_id, image_url ORDER BY rank, nth) = 1),
    c AS (SELECT query_id, rank, page, count(*) AS n FROM p GROUP BY ALL),
    e AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY query_id ORDER BY rank, page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c),
    b AS (SELECT query_id, rank, min(before) AS before FROM e GROUP BY ALL),
    k AS (SELECT p.* FROM p JOIN e USING (query_id, rank, page) JOIN b USING (query_id, rank) WHERE e.before < {NEED} AND NOT (p.if_empty AND b.before > 0))
    SELECT query_id, rank, (row_number() OVER (PARTITION BY query_id ORDER BY rank, nth) - 1)::INT AS place, doc_id FROM k"""
)
def thesaurus_search(spark, sf_dir):
    """Documents as records whose keyword is their language; a text's image is the same for equal texts."""
    docs = table(spark, sf_dir, "documents")
    found = docs.select(F.col("doc_id").alias("source_id"), F.concat(F.lit("images/"), F.md5("text")).alias("image_url"), F.col("doc_id").alias("ordinal"), "text", F.array("lang").alias("keywords"))
    planned = translation.searches(spark.createDataFrame(ASKED, "query_id int, query string"), spark.createDataFrame(LABELS, "ordinal long, label string, keyword string"))
    return translation.run(planned, found, NEED).select("query_id", "rank", "place", F.col("source_id").alias("doc_id"))


@query(
    """WITH r AS (SELECT source, doc_id, md5(text) AS key, row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id) AS ordinal FROM documents),
    w AS (SELECT * FROM r WHERE ordinal <= 40 QUALIFY row_number() OVER (PARTITION BY source, key ORDER BY ordinal) = 1)
    SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY ordinal) - 1 AS position, (SELECT count(*) FROM r x WHERE x.source = w.source) < 40 AS exhausted FROM w"""
)
def cursor_buffer(spark, sf_dir):
    """Every source read by three calls of growing windows; equal texts are one record."""
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars", F.md5("text").alias("source_id"))
    sources = docs.select("source").distinct()

    def fetch(ask):
        ranked = docs.withColumn("ordinal", F.row_number().over(Window.partitionBy("source").orderBy("n_chars", "doc_id")))
        return ranked.join(ask, "source").where("ordinal <= requested").drop("requested", "n_chars")

    reader = cursors.Cursors(spark, f"{families.shared_folder(spark)}/cursor-{uuid.uuid4().hex}", ("source_id",))
    for n in (7, 15, 40):
        held = reader.window(sources.withColumn("requested", F.lit(n)), fetch)
    return held.join(reader.states().select("source", "exhausted"), "source").select("source", "doc_id", "position", "exhausted")


def stored_page(folder: str, size: int):
    """fetch(chain, token) over pages that lie as Parquet folders chain=c/page=n, whose token is the page's number."""

    def fetch(chain, token):
        import pyarrow.parquet as pq
        from pyarrow import fs

        page = int(token or 0)
        system, path = fs.FileSystem.from_uri(folder)
        at = f"{path}/chain={chain}/page={page}"
        files = [f.path for f in system.get_file_info(fs.FileSelector(at, allow_not_found=True)) if f.path.endswith(".parquet")]
        ids = sorted(i for f in files for i in pq.read_table(f, columns=["id"], filesystem=system, partitioning=None).column("id").to_pylist())
        return [(i,) for i in ids], str(page + 1) if len(ids) == size else None

    return fetch


TITLE_HOLDS = HOLDS.replace("text", "title")


@query(
    f"""WITH i AS (SELECT doc_id, source, text, coalesce(string_split(text, '.')[1], '') AS title FROM documents),
    f AS (SELECT doc_id, source, 1 AS priority FROM i WHERE {TITLE_HOLDS.replace('{0}', 'and the')} UNION ALL SELECT doc_id, source, 2 FROM i WHERE {HOLDS.replace('{0}', 'and the')}),
    o AS (SELECT *, row_number() OVER (PARTITION BY source, priority ORDER BY doc_id) AS ordinal FROM f),
    u AS (SELECT source, doc_id, min(priority * 1000000000 + ordinal) AS first FROM o WHERE ordinal <= 30 GROUP BY ALL)
    SELECT source, doc_id AS id, row_number() OVER (PARTITION BY source ORDER BY first) - 1 AS position FROM u QUALIFY position < 25"""
)
def token_paged_union(spark, sf_dir):
    """Searches of titles and texts of each source, answered in pages of ten that name the next one, followed by a task each and
    united, titles first."""
    docs = document_items(spark, sf_dir)
    hits = lambda field, c: docs.where(T.contains_phrase(c, "and the")).select(F.concat(F.lit(f"{field}-"), F.hex("source")).alias("chain"), F.col("doc_id").alias("id"))
    numbered = hits("title", "title").unionByName(hits("text", "text")).withColumn("page", F.floor((F.row_number().over(Window.partitionBy("chain").orderBy("id")) - 1) / 10))
    folder = f"{families.shared_folder(spark)}/pages-{uuid.uuid4().hex}"
    numbered.repartition("chain").write.partitionBy("chain", "page").parquet(folder)
    chains = [r.chain for r in numbered.select("chain").distinct().collect()]  # two a source
    rows = paging.read_chains(spark, f"pages{uuid.uuid4().hex[:8]}", "id long", stored_page(folder, 10), chains, 30)
    found = rows.select(F.split("chain", "-")[0].alias("field"), F.unhex(F.split("chain", "-")[1]).cast("string").alias("source"), "ordinal", "id")
    records = docs.select(F.col("doc_id").alias("id"), "title", "text")
    return paging.field_union(found, ["title", "text"], "and the", records, ["title", "text"], 25, ["source"]).select("source", "id", F.col("position").cast("long").alias("position"))


# Headers, archives and composed scans


@query(
    """SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 7 WHEN p_partkey % 5 = 4 THEN 0 ELSE p_partkey % 5000 + 1 END::INT AS width, CASE WHEN p_partkey % 3 = 0 THEN 8 WHEN p_partkey % 5 = 4 THEN 0 ELSE p_size END::INT AS height FROM part"""
)
def header_probe(spark, sf_dir):
    """Parts whose images are headers of four formats and of none; a third of the sizes are known."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_size", (F.col("p_partkey") % 5000 + 1).cast("int").alias("w"), F.col("p_size").cast("int").alias("h"), F.concat(F.lit("u"), "p_partkey").alias("url"))
    big = lambda x, n: F.lpad(F.hex(x), 2 * n, "0")
    little = lambda x, n: F.concat(*[F.substring(big(x, n), 2 * k - 1, 2) for k in range(n, 0, -1)])
    w, h, kind = F.col("w"), F.col("h"), F.col("p_partkey") % 5
    made = (
        F.when(kind == 0, F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), big(w, 4), big(h, 4), F.lit("0802000000")))
        .when(kind == 1, F.concat(F.lit("474946383961"), little(w, 2), little(h, 2), F.lit("000000")))
        .when(kind == 2, F.concat(F.lit("FFD8FFE000104A46494600010100000100010000FFC2000B08"), big(h, 2), big(w, 2), F.lit("03")))
        .when(kind == 3, F.concat(F.lit("524946461E00000057454250565038580A00000000000000"), little(w - 1, 3), little(h - 1, 3)))
        .otherwise("3C68746D6C3E")
    )
    known = F.col("p_partkey") % 3 == 0
    shown = part.select("p_partkey", F.col("url").alias("image_url"), F.lit("").alias("thumb_url"), F.when(known, 7).otherwise(0).alias("width"), F.when(known, 8).otherwise(0).alias("height"))
    filled, _ = items.probe_sizes(shown, part.select("url", F.unhex(made).alias("content")))
    return filled.select("p_partkey", "width", "height")


@query("""SELECT doc_id::VARCHAR AS id, row_number() OVER (PARTITION BY source ORDER BY doc_id::VARCHAR) AS number, strlen(text) AS size, CASE WHEN doc_id % 3 > 0 THEN lang ELSE '' END AS lang FROM documents""")
def archive_pool(spark, sf_dir):
    """An archive a source, with its texts as members and their languages in lists beside them; read back in place."""
    folder = f"{families.shared_folder(spark)}/archives-{uuid.uuid4().hex}"
    if "://" not in folder:
        folder = f"file://{folder}"
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")

    def pack(key, frame):
        """One archive; a repeated task writes it again."""
        import io
        import json
        import zipfile

        from pyarrow import fs

        data = io.BytesIO()
        with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as archive:
            for doc, text in zip(frame["doc_id"], frame["text"]):
                archive.writestr(f"images/{doc}.png", (text or "").encode())
            notes = [{"image_path": f"./images/{doc}.png", "image_metadata": {"lang": lang}} for doc, lang in zip(frame["doc_id"], frame["lang"]) if doc % 3]
            archive.writestr("annotations/first.json", json.dumps(notes))
            archive.writestr("annotations/late.json", json.dumps([n | {"image_metadata": {"lang": "late"}} for n in notes]))
        system, path = fs.FileSystem.from_uri(folder)
        system.create_dir(path)
        with system.open_output_stream(f"{path}/{key[0]}.zip") as out:
            out.write(data.getvalue())
        return pd.DataFrame({"path": [f"{folder}/{key[0]}.zip"]})

    paths = [r.path for r in docs.groupBy("source").applyInPandas(pack, "path string").collect()]  # an archive a source
    found = archives.pool(spark, paths)
    return found.select("id", F.col("number").cast("long").alias("number"), "size", F.coalesce(F.col("metadata")["lang"], F.lit("")).alias("lang"))


@query(
    """WITH i AS (SELECT l_orderkey * 10 + l_linenumber AS image, l_partkey, p_name, p_type, p_brand, p_size FROM lineitem LEFT JOIN part ON l_partkey = p_partkey AND p_partkey % 7 > 0 WHERE l_returnflag = 'R'),
    k AS (SELECT * FROM i WHERE p_name IS NOT NULL AND len(list_intersect(regexp_extract_all(lower(p_name || ' ' || p_type), '[a-z0-9]+'), ['widgets', 'widgetss', 'widgetses', 'widget'])) > 0 ORDER BY image LIMIT 500)
    SELECT image::VARCHAR AS source_id, p_brand AS artist, CASE WHEN p_size % 2 = 0 THEN 'https://i.test/image/w' || l_partkey || '/full/max/0/default.jpg' ELSE 'https://i.test/image/m' || image || '/full/max/0/default.jpg' END AS image_url, p_size % 2 = 0 AS is_primary_view FROM k"""
)
def image_works(spark, sf_dir):
    """Returned lines as images of parts; parts of even size are pictures, and some parts are unknown."""
    lines = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ordinal"), F.col("l_partkey").cast("string").alias("work_id"))
    shown = lines.select("ordinal", F.col("ordinal").cast("string").alias("image_id"), "work_id", F.lit("A matched image").alias("title"), F.concat(F.lit("https://i.test/image/m"), "ordinal", F.lit("/info.json")).alias("image_url"), F.lit("x").alias("license"))
    one = lambda c: F.array(F.col(c))
    works = table(spark, sf_dir, "part").where("p_partkey % 7 > 0").select(
        F.col("p_partkey").cast("string").alias("work_id"), F.when(F.col("p_size") % 2 == 0, "Pictures").otherwise("Books").alias("work_type"), F.col("p_name").alias("description"), one("p_brand").alias("artists"), one("p_brand").alias("dates"),
        F.lit("").alias("medium"), F.concat(F.lit("https://i.test/thumbs/w"), "p_partkey", F.lit("/full/200,/0/default.jpg")).alias("thumb_url"), one("p_type").alias("subjects"), F.lit(None).cast("array<string>").alias("notes"),
    )
    return composed.image_works(shown, works, "widgets", 500).select("source_id", "artist", "image_url", "is_primary_view")


@query(
    f"""WITH d AS (SELECT doc_id, source, text, lang, CASE WHEN doc_id % 6 = 0 THEN NULL WHEN doc_id % 6 = 1 THEN 0.000024 ELSE n_chars / 10.0 END AS score, {FOLD.format('text')} AS w FROM documents),
    k AS (SELECT * FROM d WHERE coalesce(score >= 0.01, true) AND list_contains(w, 'tion') AND list_contains(w, 'was'))
    SELECT doc_id AS id, CASE WHEN lang = 'en' AND doc_id % 4 > 0 THEN 'commons' WHEN source IN ('src0', 'src1', 'src2', 'src3') THEN 'archive' ELSE '' END AS image_delivery,
    CASE WHEN lang = 'en' AND doc_id % 4 > 0 THEN 'c' || doc_id WHEN source IN ('src0', 'src1', 'src2', 'src3') THEN 'a' || doc_id ELSE 'own' || doc_id END AS image_url FROM k"""
)
def scored_deliveries(spark, sf_dir):
    """Documents as scored hits: the floor, both ideas of the query, a delivery that a gate of colours lets through, and another."""
    docs = table(spark, sf_dir, "documents")
    score = F.when(F.col("doc_id") % 6 == 1, 0.000024).when(F.col("doc_id") % 6 > 1, F.col("n_chars") / 10.0)
    hits = docs.withColumn("score", score)
    kept = composed.above_floor(hits).where(composed.covers_concepts("tion was", F.col("text"))).select(F.col("doc_id").alias("id"), F.concat(F.lit("own"), "doc_id").alias("image_url"))
    offer = lambda rows, prefix: rows.select(F.col("doc_id").alias("id"), F.concat(F.lit(prefix), "doc_id").alias("url"), F.lit(843).alias("width"), F.lit(0).alias("height"))
    other = F.when(F.col("doc_id") % 4 == 0, 0.01).otherwise(0.2)
    first = offer(docs.where("lang = 'en'").where(composed.keeps_colour(F.lit(0.31), other)), "c")
    second = offer(docs.where(F.col("source").isin("src0", "src1", "src2", "src3")), "a")
    return composed.delivered(kept, [("commons", first), ("archive", second)]).select("id", "image_delivery", "image_url")


@query(
    """WITH f AS (SELECT doc_id, doc_id // 25 AS ordinal, doc_id % 25 AS place, CASE WHEN doc_id % 4 = 0 THEN 'MET ' || (doc_id % 90 + 100) END AS object, 1000000 - doc_id AS asset FROM documents WHERE doc_id % 5 > 0 AND lang <> 'es'),
    g AS (SELECT coalesce(object, 'doc ' || doc_id) AS key, min(doc_id) AS first_id, arg_min(doc_id, asset) AS best FROM f GROUP BY ALL)
    SELECT first_id // 25 AS ordinal, (first_id % 25)::INT AS place, 'File:Document DT' || (1000000 - best) || '.jpg' AS source_id, 'https://c.test/' || best AS image_url FROM g ORDER BY first_id LIMIT 400"""
)
def repository_scan(spark, sf_dir):
    """Documents as a file repository's answers of twenty-five; every fourth is a photograph of an object that others show."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", F.col("source"))
    value = lambda c: F.struct(c.alias("value"))
    key = F.col("doc_id")
    meta = F.create_map(
        F.lit("LicenseShortName"), value(F.when(F.col("lang") == "es", "Copyrighted").otherwise("CC BY-SA 4.0")), F.lit("Categories"), value(F.when(key % 4 == 0, F.concat(F.lit("Of an object, MET "), key % 90 + 100)).otherwise("")), F.lit("Artist"), value(F.concat(F.lit("<b>"), "source", F.lit("</b>")))
    )
    info = F.struct(F.when(key % 5 == 0, "image/tiff").otherwise("image/jpeg").alias("mime"), F.concat(F.lit("http://c.test/"), key).alias("url"), F.lit(3000).alias("width"), meta.alias("extmetadata"))
    page = F.struct(F.concat(F.lit("File:Document DT"), 1000000 - key, F.lit(".jpg")).alias("title"), F.array(info).alias("imageinfo"))
    each = F.concat(F.lit('"'), key % 25, F.lit('":'), F.to_json(page))
    answers = docs.groupBy(F.floor(key / 25).alias("ordinal")).agg(F.array_sort(F.collect_list(F.struct((key % 25).alias("place"), each.alias("page")))).alias("pages"))
    payload = F.concat(F.lit('{"query":{"pages":{'), F.array_join("pages.page", ","), F.lit("}}}"))
    found = composed.repository_scan(answers.select("ordinal", payload.alias("payload")), None, 200)
    return found.select("ordinal", "place", "source_id", "image_url")


# Families, versions, live catalogs and sources that fail

FAMILY = """WITH i AS (SELECT doc_id, md5(text) AS key, n_chars AS width, doc_id % 3 AS height, (doc_id % 11)::DOUBLE AS score, doc_id % 5 = 0 AS is_primary, (doc_id % 7)::INT AS provider_rank FROM documents),
    m AS (SELECT *, min(doc_id) OVER (PARTITION BY key) AS component, row_number() OVER (PARTITION BY key ORDER BY NOT is_primary, (width * height = 0), -width * height, -least(width, height), -score, provider_rank, doc_id) - 1 AS place FROM i)"""


def document_families(spark, sf_dir):
    """Documents as items whose equal texts are a family, and the families' labels."""
    docs = table(spark, sf_dir, "documents")
    shown = docs.select(
        "doc_id", F.concat(F.lit("t"), "doc_id").alias("title"), F.col("n_chars").cast("int").alias("width"), (F.col("doc_id") % 3).cast("int").alias("height"), (F.col("doc_id") % 11).cast("double").alias("rank_score"),
        (F.col("doc_id") % 5 == 0).alias("is_primary_view"), (F.col("doc_id") % 7).cast("int").alias("provider_rank"), F.md5("text").alias("key"),
    )
    first = shown.groupBy("key").agg(F.min("doc_id").alias("b"))
    labels = families.components(shown.join(first, "key").select(F.col("doc_id").alias("a"), "b"))
    return shown, labels


@query(f"{FAMILY} SELECT component, arg_min(doc_id, place) AS doc_id, max(score) AS rank_score, count(*) - 1 AS duplicate_count FROM m GROUP BY component")
def collapsed_families(spark, sf_dir):
    return families.collapse(*document_families(spark, sf_dir), "doc_id").select("component", "doc_id", "rank_score", "duplicate_count")


@query(f"{FAMILY} SELECT component, place, doc_id FROM m WHERE place > 0")
def family_alternates(spark, sf_dir):
    return families.alternates(*document_families(spark, sf_dir), "doc_id").select("component", F.col("place").cast("long").alias("place"), "doc_id")


@query("SELECT o_orderkey, o_totalprice + CASE WHEN o_orderkey % 3 = 0 THEN 2 ELSE 0 END AS price, 2 AS version FROM orders WHERE o_orderkey % 7 > 0")
def stored_versions(spark, sf_dir):
    """Orders saved three times; the latest version counts, and its missing column is filled."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("price"))
    folder = f"{families.shared_folder(spark)}/versions-{uuid.uuid4().hex}"
    stores.save(orders.where("o_orderkey % 2 = 0").withColumn("version", F.lit(0)), folder)
    stores.save(orders, folder)
    third = orders.withColumn("price", F.col("price") + F.when(F.col("o_orderkey") % 3 == 0, 2).otherwise(0))
    stores.save(third.where("o_orderkey % 7 > 0"), folder, keep=2)
    return stores.load(spark, folder, {"version": F.lit(2)}).select("o_orderkey", "price", "version")


@query(
    """SELECT 'full' AS first, 'unchanged' AS second, 'incremental' AS third, 'full' AS fourth, count(*) AS records, max(strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S')) AS latest, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderkey % 10 > 0"""
)
def live_catalog(spark, sf_dir):
    """Orders as a provider's records: loaded, asked again, grown by the later ones, and loaded anew after deletions."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("modified"), "o_totalprice")
    cut = rows.select("modified").distinct().orderBy("modified").limit(1500).agg(F.max("modified")).first()[0]
    now = {"rows": rows.where(F.col("modified") < cut)}
    count = lambda: now["rows"].agg(F.max("modified"), F.count("*")).first()
    fetch = lambda after: now["rows"] if after is None else now["rows"].where(F.col("modified") > after)
    catalog = live_catalogs.LiveCatalog(spark, f"{families.shared_folder(spark)}/live-{uuid.uuid4().hex}", lambda: tuple(count()), fetch)
    modes = [catalog.refresh(1.0), catalog.refresh(2.0)]
    now["rows"] = rows
    modes.append(catalog.refresh(3.0))
    now["rows"] = rows.where("id % 10 > 0")
    modes.append(catalog.refresh(4.0))
    told = [F.lit(m).alias(n) for m, n in zip(modes, ("first", "second", "third", "fourth"))]
    return catalog.records().agg(F.count("*").alias("records"), F.max("modified").alias("latest"), F.round(F.sum("o_totalprice"), 2).alias("total")).select(*told, "records", "latest", "total")


@query("""SELECT 'good' AS source, doc_id::VARCHAR AS source_id FROM documents WHERE lang = 'en' UNION ALL SELECT 'other', doc_id::VARCHAR FROM documents WHERE lang = 'de'""")
def isolated_sources(spark, sf_dir):
    """Four sources, of which one can't be planned and one fails only as it runs."""
    docs = table(spark, sf_dir, "documents")
    items_of = lambda name, rows: rows.select(F.lit(name).alias("source"), F.col("doc_id").cast("string").alias("source_id"), F.concat(F.lit("https://i.test/"), "doc_id").alias("image_url"))
    sources = registry.Registry()
    sources.add("good", "Good", lambda s, q: items_of("good", docs.where("lang = 'en'")))
    sources.add("unplanned", "Unplanned", lambda s, q: docs.select("no_such_column"))
    sources.add("broken", "Broken", lambda s, q: items_of("broken", docs.where(F.when(F.col("doc_id") >= 0, F.raise_error(F.lit("no connection")).cast("boolean")))))
    sources.add("other", "Other", lambda s, q: items_of("other", docs.where("lang = 'de'")))
    found, errors = sources.load(spark, "", sources.select(""))
    if set(errors) != {"unplanned", "broken"}:
        raise AssertionError(errors)
    return found.select("source", "source_id")


@query(f"WITH f AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS ordinal FROM documents WHERE {HOLDS.replace('{0}', 'of the')}) SELECT doc_id FROM f WHERE ordinal <= 60")
def paged_phrase(spark, sf_dir):
    """A quoted query over a provider that knows no phrases: pages of candidates until sixty hold it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.col("doc_id").alias("ordinal"))
    total = docs.count()
    fetch = lambda skip, n: (docs.orderBy("ordinal").offset(skip).limit(n), total)
    return phrases.phrase_pages(fetch, '"of the"', ["text"], 60).select("doc_id")


# Crawls, pages and requests that come together


@query(
    """WITH g AS (SELECT p_partkey, p_size, p_name, row_number() OVER (PARTITION BY p_name ORDER BY p_size, p_partkey) AS k FROM part WHERE p_size > 5)
    SELECT replace(p_name, ' ', '-') AS source_id, 'Gallery ' || p_size AS gallery, 'https://g.test/shown/' || replace(p_name, ' ', '-') || '.html' AS page_url, 'https://g.test/img/' || p_partkey || '.jpg' AS image_url,
    CASE WHEN length(p_name) % 2 = 0 THEN 'About ' || p_name ELSE '' END AS description FROM g WHERE k = 1"""
)
def gallery_crawl(spark, sf_dir):
    """Parts as images in galleries by size, which an index links but for the small ones; every second name has a page of its own."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_name", F.regexp_replace("p_name", " ", "-").alias("stem"))
    join = lambda c, order: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, c.alias("html")))), lambda x: x["html"]), "")
    picture = F.concat(F.lit("<a href='/shown/"), "stem", F.lit(".html'><img src='../img/"), "p_partkey", F.lit(".jpg' alt=' "), "p_name", F.lit("'></a><a href='/shop/'><img src='no.jpg'></a>"))
    galleries = part.groupBy("p_size").agg(join(picture, ["p_partkey"]).alias("html")).select(F.concat(F.lit("https://g.test/list/"), "p_size").alias("page_url"), "html")
    link = F.concat(F.lit("<a href='/list/"), "p_size", F.lit("'><h3>Gallery "), "p_size", F.lit("</h3></a>"))
    index = part.where("p_size > 5").select("p_size").distinct().agg(join(link, ["p_size"]).alias("html")).select(F.lit("https://g.test/index").alias("page_url"), "html")
    own = part.select("p_name", "stem").distinct().where(F.length("p_name") % 2 == 0)
    details = own.select(F.concat(F.lit("https://g.test/shown/"), "stem", F.lit(".html")).alias("page_url"), F.concat(F.lit("<div id='About'>About <em>"), "p_name", F.lit("</em></div><p>else</p>")).alias("html"))
    pages = index.unionByName(galleries).unionByName(details)
    return html.crawl(pages, "https://g.test/index", "/shown/", ["About"]).select("source_id", "gallery", "page_url", "image_url", "description")


@query(
    """WITH c AS (SELECT l_orderkey AS page, 0 AS part, l_linenumber AS place, l_partkey AS key, 0 AS width FROM lineitem WHERE l_returnflag = 'R' UNION ALL SELECT l_orderkey, 1, l_linenumber, l_partkey, 0 FROM lineitem WHERE l_returnflag = 'A'
    UNION ALL SELECT l_orderkey, 2, l_linenumber, l_partkey, (l_suppkey % 3 * 100)::INT FROM lineitem WHERE l_returnflag <> 'R'),
    b AS (SELECT page, key, min(part * 100 + place) AS first, arg_min(width, part * 100 + place) FILTER (width > 0) AS width FROM c GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY first, key::VARCHAR) - 1 AS position FROM b)
    SELECT page, position, key::VARCHAR AS key, coalesce(width, CASE WHEN key % 2 = 0 THEN 7 ELSE 0 END)::INT AS width FROM r WHERE position < 4"""
)
def rendered_pages(spark, sf_dir):
    """Orders as rendered pages: lines as cards, anchors and what scripts tell; half of the sizes are known from before.
    Lines of one number stand in the order of their file."""
    lines = table(spark, sf_dir, "lineitem").withColumns({"file": F.col("_metadata.file_name"), "row": F.col("_metadata.row_index")})
    none = F.lit(0)
    shape = lambda rows, width: rows.select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("place"), "file", "row", F.col("l_partkey").cast("string").alias("image_id"), F.lit("").alias("image_url"), F.lit("").alias("page_url"), width.cast("int").alias("width"), width.cast("int").alias("height"))
    parts = [shape(lines.where("l_returnflag = 'R'"), none), shape(lines.where("l_returnflag = 'A'"), none), shape(lines.where("l_returnflag <> 'R'"), F.col("l_suppkey") % 3 * 100)]
    known = table(spark, sf_dir, "part").where("p_partkey % 2 = 0").select(F.col("p_partkey").cast("string").alias("key"), F.lit(7).alias("width"), F.lit(7).alias("height"))
    return staged.page_union(["page"], parts, known, 4, ("file", "row")).select("page", F.col("position").cast("long").alias("position"), "key", "width")


@query("WITH k AS (SELECT user_id % 500 AS key, min(event_id) AS id, count(*) AS waiting FROM events WHERE event_id % 2 = 0 GROUP BY 1) SELECT key, id, waiting FROM k WHERE key % 3 > 0")
def coalesced_requests(spark, sf_dir):
    """Events as requests of which a third is answered from the cache; the first of each other key is fetched."""
    events = table(spark, sf_dir, "events").where("event_id % 2 = 0").select(F.col("event_id").alias("id"), (F.col("user_id") % 500).alias("key"), F.lit(0).alias("at"))
    now = F.lit("2024-01-01 00:10:00").cast("timestamp")
    young = events.where("key % 3 = 0").select("key", (now - F.expr("INTERVAL 10 SECONDS")).alias("at"), F.lit("answer").alias("answer")).distinct().orderBy("key").limit(200)
    _, waiting = live.coalesced(events, young, now)
    return waiting.select("key", "id", F.size("ids").cast("long").alias("waiting"))


@query(
    """WITH i AS (SELECT l_partkey, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_partkey ORDER BY (l_returnflag <> 'R')::INT, l_linenumber, l_orderkey::VARCHAR) AS k FROM lineitem WHERE l_quantity > 10 AND l_linestatus = 'O')
    SELECT p_partkey::VARCHAR AS source_id, p_name AS title, p_brand AS artist, 'https://a.test/art/' || p_partkey || '-' || replace(p_name, ' ', '-') AS page_url, 'https://i.test/' || l_orderkey || '/full/full/0/default.jpg' AS image_url,
    (l_linenumber * 100)::INT AS width, 'A "view",' || chr(10) || 'line ' || l_linenumber AS description FROM part JOIN i ON l_partkey = p_partkey WHERE k = 1"""
)
def collection_release(spark, sf_dir):
    """Parts as a museum's objects and lines as their images, written as the release's two files, read back and joined."""
    folder = f"{families.shared_folder(spark)}/release-{uuid.uuid4().hex}"
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("objectid"), F.lit("more").alias("accession"), F.col("p_name").alias("title"), F.col("p_brand").alias("attribution"), F.lit("1900").alias("displaydate"), F.lit("ink").alias("medium"), F.col("p_type").alias("classification"))
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("uuid"), F.concat(F.lit("https://i.test/"), "l_orderkey", F.lit("/")).alias("iiifurl"), F.when(F.col("l_returnflag") == "R", "Primary").otherwise("alternate").alias("viewtype"), F.col("l_linenumber").alias("sequence"), (F.col("l_linenumber") * 100).alias("width"), F.lit(9).alias("height"),
        F.when((F.col("l_quantity") > 10) & (F.col("l_linestatus") == "O"), 1).otherwise(0).alias("openaccess"), F.col("l_partkey").alias("depictstmsobjectid"), F.concat(F.lit('A "view",\nline '), "l_linenumber").alias("assistivetext"),
    )
    for name, rows in (("objects", part), ("images", lines)):
        rows.write.option("header", True).option("escape", '"').csv(f"{folder}/{name}")
    works = composed.release_works(*composed.read_release(spark, f"{folder}/objects", f"{folder}/images"), "https://a.test/art/")
    return works.select("source_id", "title", "artist", "page_url", "image_url", "width", "description")


# The same image, by the whole cascade; facts of pages with images and linked data


@query(
    """WITH b AS (SELECT vec_id, embedding::DOUBLE[] AS v, [0.985, 0.97, 0.96, 0.93][vec_id % 4 + 1]::DOUBLE AS a FROM embeddings),
    m AS (SELECT vec_id + 1000000 AS vec_id, list_transform(range(1, 65), lambda i: a * v[i] + sqrt(1 - a * a) * v[i % 64 + 1]) AS v FROM b),
    n AS (SELECT vec_id, v FROM b UNION ALL SELECT vec_id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) FROM m),
    f AS (SELECT *, 100 + vec_id % 3 AS width, 100 AS height, CASE WHEN vec_id % 7 > 0 THEN (vec_id % 13) / 40.0 END AS shade FROM n),
    p AS (SELECT x.vec_id AS a, y.vec_id AS b, list_dot_product(x.v, y.v) AS c, abs(ln((x.width / x.height) / (y.width / y.height))) AS d, 1 - abs(x.shade - y.shade) AS k FROM f x JOIN f y ON x.vec_id < y.vec_id)
    SELECT a, b FROM p WHERE c >= 0.9 AND d <= 0.2 AND CASE WHEN k IS NULL THEN c >= 0.992 AND d < 0.08 WHEN c >= 0.98 THEN k >= 0.7 WHEN c >= 0.965 THEN k >= 0.86 WHEN c >= 0.955 THEN k >= 0.92 ELSE k >= 0.955 AND d < 0.08 END"""
)
def same_image_cascade(spark, sf_dir):
    """Pairs that the whole rule takes for one image: vectors, proportions, and the likeness of fingerprints, where both are known."""
    key = F.col("vec_id")
    shown = with_copies(spark, sf_dir).select("vec_id", "embedding", (100 + key % 3).alias("width"), F.lit(100).alias("height"), F.when(key % 7 > 0, (key % 13) / 40.0).alias("shade"))
    rule = lambda p: S.same_image(F.col("cosine"), S.aspect_distance(F.col("width_a"), F.col("height_a"), F.col("width_b"), F.col("height_b")), 1 - F.abs(F.col("shade_a") - F.col("shade_b")))
    return families.image_pairs(shown, same=rule).select("a", "b")


@query("SELECT page_id, (len(regexp_extract_all(html, '<a ')) + page_id % 3)::INT AS n_links, (page_id % 3)::INT AS n_images, CASE WHEN page_id % 2 = 0 THEN 'Longer words of ' || url ELSE '' END AS description FROM pages")
def page_facts(spark, sf_dir):
    """Pages with up to two more images, and linked data on every second."""
    key = F.col("page_id")
    image = F.repeat(F.lit("<a href='/i'><img src='x.jpg'></a>"), (key % 3).cast("int"))
    data = F.to_json(F.struct(F.lit("short").alias("description"), F.array(F.struct(F.concat(F.lit("Longer words of "), "url").alias("description"))).alias("parts")))
    linked = F.when(key % 2 == 0, F.concat(F.lit("<script type='application/ld+json'>"), data, F.lit("</script>"))).otherwise("")
    pages = table(spark, sf_dir, "pages").select("page_id", F.concat("html", image, linked).alias("html"))
    return html.page_facts(pages).select("page_id", "n_links", "n_images", "description")


@query(
    """SELECT p_partkey::VARCHAR AS source_id, CASE WHEN p_size % 3 = 0 THEN 'English ' || p_name ELSE 'Deutsch ' || p_name END AS description, p_name AS history FROM part WHERE p_size % 5 > 0 AND NOT (p_partkey % 4 = 0 AND p_type = 'ECONOMY')
    AND (len(list_intersect(string_split(p_name, ' '), ['widgets', 'widgetss', 'widgetses', 'widget'])) > 0 OR p_partkey % 10 = 1)"""
)
def aggregator_items(spark, sf_dir):
    """Parts as an aggregator's items, with documents and registers among them; details are merged, and a word must be shown or
    have been recognised."""
    part = table(spark, sf_dir, "part")
    key = F.col("p_partkey").cast("string")
    url = F.concat(F.lit("https://d.test/media/"), key, F.when(F.col("p_size") % 5 == 0, ".pdf").otherwise(""))
    told = F.when(F.col("p_size") % 3 == 0, F.map_from_arrays(F.array(F.lit("de"), F.lit("en")), F.array(F.array(F.concat(F.lit("Deutsch "), "p_name")), F.array(F.concat(F.lit("English "), "p_name"))))).otherwise(F.map_from_arrays(F.array(F.lit("de")), F.array(F.array(F.concat(F.lit("Deutsch "), "p_name")))))
    item = F.struct(key.alias("id"), F.array(F.col("p_name")).alias("title"), F.array(url).alias("edmIsShownBy"), told.alias("dcDescriptionLangAware"))
    payloads = part.select(F.col("p_partkey").alias("ordinal"), F.to_json(F.struct(F.array(item).alias("items"))).alias("payload"))
    assets = part.where("p_partkey % 4 = 0").select(key.alias("asset_id"), F.when(F.col("p_type") == "ECONOMY", "Register").otherwise("Specimen").alias("category"))
    details = part.select(key.alias("source_id"), F.lit("unused").alias("summary"), F.concat(F.lit("<p>"), "p_name", F.lit("</p>")).alias("history"))
    tags = part.where("p_partkey % 5 = 1").select(key.alias("source_id"), F.when(F.col("p_partkey") % 2 == 1, "textdetection").otherwise("colour").alias("kind"), F.array(F.lit("A WIDGET")).alias("words"))
    found = composed.with_details(composed.aggregated(payloads, assets), details, {"history": "Object History"})
    return composed.recognised(found, tags, "widgets", ["title"]).select("source_id", "description", F.col("search_text")["Object History"].alias("history"))

