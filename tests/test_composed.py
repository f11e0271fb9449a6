"""Whole scans: a file repository, images with their works, scored searches and their deliveries."""

import json

import pytest
from pyspark.sql import functions as F

from gallerium.functions import images
from gallerium.sources import composed, postings

DPLA = "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa"


def page(title, mime="image/jpeg", url="https://c.test/x.jpg", license="Public domain", **meta):
    meta = {k: {"value": v} for k, v in {"LicenseShortName": license, **meta}.items() if v is not None}
    return {"title": title, "imageinfo": [{"mime": mime, "url": url, "width": 3000, "height": 2000, "descriptionurl": "http://c.test/page", "extmetadata": meta}]}


def scan(spark, pages, query, need=10):
    rows = [(k, json.dumps({"query": {"pages": {str(n): p for n, p in enumerate(ps)}}})) for k, ps in enumerate(pages)]
    return composed.repository_scan(spark.createDataFrame(rows, "ordinal int, payload string"), query, need).orderBy("ordinal", "place").collect()


def test_repository_files(spark):
    good = page("File:Museum work.jpg", "image/webp", Artist="<b>Example &amp; Artist</b>", DateTimeOriginal="circa 1509date QS:P571,+1509-00-00T00:00:00Z/9", ImageDescription="Saint Peter in prison", license="CC BY-SA 4.0")
    others = [page("File:No.jpg", license="Copyrighted", ImageDescription="Saint Peter"), page("File:Peter.tif", "image/tiff"), page("File:Saint Peter.jpg", url=""), {"title": "File:none"}]
    (item,) = scan(spark, [[good, *others]], "saint peter")
    assert (item.source_id, item.artist, item.date, item.page_url) == ("File:Museum work.jpg", "Example & Artist", "circa 1509", "https://c.test/page")
    assert (item.title, item.width, item.thumb_url) == ("Museum work.jpg", 3000, "https://c.test/x.jpg")


def test_repository_relevance(spark):
    cato = f'File:"Cato" on constitutional "money" and legal tender. In 12 no. from the Charleston mercury - DPLA - {DPLA} (page 24).jpg'
    assert scan(spark, [[page(cato, ObjectName='"Cato" on constitutional "money"', ImageDescription="Issued in a case; Charleston mercury")]], "Caduceus of Mercury") == []
    bare = page(f"File:The caduceus of Mercury - DPLA - {DPLA} (page 7).jpg", ObjectName="The caduceus of Mercury", Description="The caduceus of Mercury, donated by Example Library")
    plate = page(f"File:The caduceus of Mercury - DPLA - {DPLA} (page 8).jpg", ObjectName="The caduceus of Mercury", ImageDescription="The caduceus of Mercury. Plate 8: an engraving depicting Mercury holding the caduceus.")
    assert [r.source_id for r in scan(spark, [[bare, plate]], "Caduceus of Mercury")] == [plate["title"]]
    generic, symbol = page("File:Generic painting.jpg", ImageDescription="A generic landscape"), page("File:Kundalini symbol.jpg", ImageDescription="Diagram of Kundalini energy")
    assert [r.title for r in scan(spark, [[generic, symbol]], "kundalini", 1)] == ["Kundalini symbol.jpg"]  # filtered before the limit
    chain = page("File:Chain with Birds MET DT12030.jpg", license="CC0", ObjectName="Chain with Birds", ImageDescription="Kievan Rus; dress ornament", Categories="Chains with Birds and Trees of Life, MET 17.190.705-6")
    assert scan(spark, [[chain]], "Kabbalistic Tree of Life") == []
    assert len(scan(spark, [[chain, generic]], None)) == 2


def test_repository_views_and_order(spark):
    view = lambda n, url: page(f"File:Geometric Motifs MET DT{n}.jpg", url=url, license="CC0", ObjectName="Geometric Motifs", Categories="Geometric Motifs, MET 17.190.706")
    single = lambda n: page(f"File:Motifs geometric {n}.jpg", license="CC0")
    got = scan(spark, [[single(1), view(12030, "https://c.test/reverse.jpg"), single(2)], [view(12029, "https://c.test/front.jpg"), single(3)]], "geometric motifs")
    assert [r.title for r in got] == ["Motifs geometric 1.jpg", "Geometric Motifs MET DT12029.jpg", "Motifs geometric 2.jpg", "Motifs geometric 3.jpg"]
    assert got[1].image_url == "https://c.test/front.jpg" and (got[1].ordinal, got[1].place) == (0, 1)
    assert len(scan(spark, [[single(k) for k in range(9)]], "geometric motifs", 2)) == 4


# Images and works

IMAGE = "ordinal int, image_id string, work_id string, title string, image_url string, license string"
WORK = "work_id string, work_type string, description string, artists array<string>, dates array<string>, medium string, thumb_url string, subjects array<string>, notes array<string>"


def joined(spark, images_, works_, query, need=10, phrases=()):
    return composed.image_works(spark.createDataFrame(images_, IMAGE), spark.createDataFrame(works_, WORK), query, need, phrases).orderBy("ordinal").collect()


def work(key, kind=None, description=None, artists=None, dates=None, medium=None, thumb=None, subjects=None, notes=None):
    return (key, kind, description, artists, dates, medium, thumb, subjects, notes)


def test_works_enrich_images(spark):
    rows = [(0, "image-1", "work-1", "An etching", "https://i.test/image/info.json", "Public Domain Mark"), (1, "image-2", "gone", "Etching of no work", "https://i.test/image/b.JP2/info.json", None)]
    told = work("work-1", None, "A physician.", ["Primary Artist", "Printmaker"], ["about 1781", "later"], "1 etching")
    one, two = joined(spark, rows, [told], "etching")
    assert (one.artist, one.date, one.medium, one.description, one.license) == ("Primary Artist; Printmaker", "about 1781", "1 etching", "A physician.", "Public Domain Mark")
    assert (two.artist, two.date, two.license, two.is_primary_view) == ("", "", "unknown", False)


def test_the_primary_view_takes_the_place_of_pictures_only(spark):
    rows = [(0, "reverse", "card", "Mercury postcard", "https://i.test/image/CARD_0002.JP2/info.json", "x"), (1, "plate", "book", "Mercury on stone", "https://i.test/image/PLATE_001.JP2/info.json", "x"), (2, "odd", "other", "Mercury", "https://i.test/image/O.JP2/info.json", "x")]
    works = [work("card", "Pictures", thumb="https://i.test/thumbs/CARD_0001.JP2/full/200,/0/default.jpg"), work("book", "Books", thumb="https://i.test/thumbs/TITLE_001.JP2/full/200,/0/default.jpg"), work("other", "Ephemera", thumb="https://i.test/thumbs/T.JP2/full/200,/0/default.jpg")]
    card, book, other = joined(spark, rows, works, "Mercury")
    assert card.image_url == "https://i.test/image/CARD_0001.JP2/full/max/0/default.jpg" and "CARD_0002.JP2" in card.matched_image_url and card.is_primary_view
    assert book.image_url == "https://i.test/image/PLATE_001.JP2/full/max/0/default.jpg" and not book.is_primary_view and not other.is_primary_view


def test_single_words_and_phrases_are_verified(spark):
    rows = [(0, "run", "w1", "Run no risks", "https://i.test/image/r/info.json", "x"), (1, "rune", "w2", "A Viking stone", "https://i.test/image/s/info.json", "x")]
    works = [work("w1", description="A road-safety bottle cap."), work("w2", description="Inscribed with a rune.", subjects=["Guardian—of the threshold"], notes=["Ceremonial object"])]
    assert [r.source_id for r in joined(spark, rows, works, "runes")] == ["rune"]
    assert [r.source_id for r in joined(spark, rows, works, "run")] == ["run"]
    assert [r.source_id for r in joined(spark, rows, works, "any two")] == ["run", "rune"] and len(joined(spark, rows, works, "any two", 1)) == 1
    assert [r.source_id for r in joined(spark, rows, works, "guardian threshold", phrases=["guardian of the threshold"])] == ["rune"]
    assert joined(spark, rows, works, "x y", phrases=["threshold ceremonial"]) == []  # a phrase never spans texts
    assert composed.noun_forms("runes")[:1] == ["runes"] and {"rune"} <= set(composed.noun_forms("runes")) and "run" not in composed.noun_forms("runes")
    assert {"city", "cities"} <= set(composed.noun_forms("city")) & set(composed.noun_forms("cities")) and "glas" not in composed.noun_forms("glass")


# Scored searches


def test_the_score_floor(spark):
    rows = [(1, 0.0000245), (2, 55.6), (3, None), (4, composed.SCORE_FLOOR), (5, composed.SCORE_FLOOR * 0.999)]
    assert {r.id for r in composed.above_floor(spark.createDataFrame(rows, "id int, score double")).collect()} == {2, 3, 4}


@pytest.mark.parametrize("query, text, want", [
    ("paul prison", "Paul Cezanne", False), ("paul prison", "Paul Released from Prison", True), ("paul escape from prison", "Liberation of Saint Peter from Prison", True),
    ("paul escape from prison", "Daniel Mytens Paul Pontius", False), ("Kabbalistic Tree of Life", "Mary Magdalene tree of life", True), ("Kabbalistic Tree of Life", "a tree", False), ("paul", "Metadata can be incomplete", True), ("", "", True),
])
def test_concept_coverage(spark, query, text, want):
    assert spark.createDataFrame([(text, None)], "t string, h string").select(composed.covers_concepts(query, F.col("t"), F.col("h"))).first()[0] is want


def test_hidden_terms_come_to_light(spark):
    hidden = ["satan", "devil/satan/lucifer/beezelbub", "panel painting"]
    frame = spark.createDataFrame([("Demons on horses.", hidden), ("Lucifer falls.", hidden), (None, None)], "d string, h array<string>")
    got = [r[0] for r in frame.select(composed.surfaced(F.col("d"), F.col("h"), "Lucifer")).collect()]
    assert got == ["Demons on horses. Subject term — “devil/satan/lucifer/beezelbub”", "Lucifer falls.", ""]


def test_the_colour_gate(spark):
    rows = [(0.31, 0.01, False), (0.02, 0.01, True), (0.31, 0.30, True), (None, 0.01, True), (0.31, None, True), (composed.COLOURED, composed.MONOCHROME, True), (composed.COLOURED, 0.0399, False), (0.0999, 0.0, True)]
    got = spark.createDataFrame(rows, "current double, other double, want boolean").select(composed.keeps_colour(F.col("current"), F.col("other")).alias("k"), "want").collect()
    assert all(r.k == r.want for r in got)
    pixels = spark.createDataFrame([([255, 0, 0, 0, 255, 0],), ([9, 9, 9, 200, 200, 200],), ([],), (None,)], "p array<int>")
    assert [r[0] for r in pixels.select(images.colourfulness(F.col("p"))).collect()] == [1.0, 0.0, None, None]


def test_deliveries_in_order(spark):
    items = spark.createDataFrame([(1, "own1"), (2, "own2"), (3, "own3")], "id int, image_url string")
    kind = "id int, url string, width int, height int"
    first, last = spark.createDataFrame([(1, "a", 5, 6), (2, "", 1, 1)], kind), spark.createDataFrame([(1, "z", 1, 1), (2, "w", 1686, 0), (2, "x", 1, 1)], kind)
    got = {r.id: (r.image_delivery, r.image_url, r.preview_width) for r in composed.delivered(items, [("commons", first), ("wayback", last)]).collect()}
    assert got == {1: ("commons", "a", 5), 2: ("wayback", "w", 1686), 3: ("", "own3", 0)}
    assert composed.delivered(items, []).where("image_delivery = ''").count() == 3


# Released tables


def test_a_release_is_read_joined_indexed_and_searched(spark, tmp_path):
    (tmp_path / "objects.csv").write_text(
        "\ufeffobjectid,title,attribution,displaydate,medium,classification,other\n7,The Liberation of Saint Peter,Example Artist,1642,oil on canvas,Painting,x\n8,Unrelated Work,Other Artist,1700,ink,Drawing,x\n9,,,,,,x\n,No id,,,,,x\n", encoding="utf-8"
    )
    (tmp_path / "images.csv").write_text(
        "uuid,iiifurl,iiifthumburl,viewtype,sequence,width,height,openaccess,depictstmsobjectid,assistivetext\n"
        'a,https://i.test/iiif/a/,https://i.test/thumb/a,primary,5,3000,2000,1,7,"Saint Peter, escaping\nprison"\n'
        "z,https://i.test/iiif/z,x,alternate,0,1,1,1,7,another view\nb,https://i.test/iiif/b,x,primary,0,1000,900,0,8,Not open access\n"
        "d,https://i.test/iiif/d,x,alternate,2,5,6,1,9,second\nc,https://i.test/iiif/c,x,alternate,1,3,4,1,9,first\ne,,x,primary,0,1,1,1,9,no address\n", encoding="utf-8",
    )
    works = composed.release_works(*composed.read_release(spark, f"{tmp_path}/objects.csv", f"{tmp_path}/images.csv"), "https://m.test/artworks/")
    got = {r.source_id: r for r in works.collect()}
    assert set(got) == {"7", "9"} and got["9"].title == "Untitled" and got["9"].image_url == "https://i.test/iiif/c/full/full/0/default.jpg"
    assert got["7"].page_url == "https://m.test/artworks/7-the-liberation-of-saint-peter" and (got["7"].width, got["7"].height) == (3000, 2000)
    index = postings.Index(spark, f"{tmp_path}/index", "source_id", ["title", "artist", "date", "medium", "classification", "description"], buckets=8)
    index.add(works)
    (r,) = postings.search(index, "Peter prison", 10).collect()
    assert r.source_id == "7" and r.thumb_url == "https://i.test/iiif/a/full/!1024,1024/0/default.jpg" and r.license == "NGA Open Access"


# Aggregators


def test_aggregated_items(spark):
    image = lambda k, url, **more: {"id": k, "title": [k], "edmIsShownBy": [url], **more}
    items = [
        image("en", "https://i.test/work.jpg", dcDescriptionLangAware={"de": ["Deutsch"], "en-GB": ["An angel."]}), image("de", "https://i.test/w2.jpg", dcDescriptionLangAware={"de": ["Deutsch"]}), image("pdf", "https://i.test/x/ii.PDF?page=1", edmPreview=["https://i.test/p.jpg"]),
        image("register", "https://d.test/media/a1"), image("specimen", "https://d.test/media/a2/"), image("unknown", "https://d.test/media/a3"), {"id": "none", "title": ["none"]}, image("plain", "http://i.test/w3.jpg", dcDescription=["Plain"]),
    ]
    assets = spark.createDataFrame([("a1", "Register"), ("a2", "Specimen"), (None, "Register")], "asset_id string, category string")
    frame = spark.createDataFrame([(0, json.dumps({"items": items})), (1, None)], "ordinal int, payload string")
    got = {r.source_id: r for r in composed.aggregated(frame, assets).collect()}
    assert set(got) == {"en", "de", "specimen", "unknown", "plain"}
    assert (got["en"].description, got["de"].description, got["plain"].description, got["unknown"].description) == ("An angel.", "Deutsch", "Plain", "")
    assert got["plain"].image_url == got["plain"].thumb_url == "https://i.test/w3.jpg"


def test_details_describe_and_are_searched(spark):
    items = spark.createDataFrame([("O1", ""), ("O2", "own"), ("O3", None)], "source_id string, description string")
    details = spark.createDataFrame([("O1", "<p>A carved figure &amp; wings.</p>", None), ("O2", "A casket.", "Its lock has a <i>mask</i> of Mercury.")], "source_id string, summary string, history string")
    got = {r.source_id: (r.description, r.search_text) for r in composed.with_details(items, details, {"history": "Object History"}).collect()}
    assert got == {"O1": ("A carved figure & wings.", {}), "O2": ("own", {"Object History": "Its lock has a mask of Mercury."}), "O3": ("", {})}


def test_recognised_words_count_whole(spark):
    items = spark.createDataFrame([("visible", "Stående model, Rune"), ("ocr-run", "Uden titel."), ("ocr-rune", "Blank"), ("none", "x")], "source_id string, title string")
    tags = spark.createDataFrame([("ocr-run", "textdetection", ["RUN"]), ("ocr-rune", "textdetection", ["a RUNE"]), ("ocr-rune", "textdetection", ["RUNES"]), ("none", "colour", ["rune"])], "source_id string, kind string, words array<string>")
    assert sorted(r.source_id for r in composed.recognised(items, tags, "runes", ["title"]).collect()) == ["ocr-rune", "visible"]
    assert composed.recognised(items, tags, "two words", ["title"]).count() == 4

