"""Whole scans of collections, each one plan from payloads to items: a file repository, images with their works, and a scored search
with its deliveries."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import words as W
from ..operators.delivery import artwork_url
from ..operators.items import first_by
from .providers import IMAGE_TYPES, license_is_open
from .records import bare_document_page

# The metadata of a file that may carry a match alone, all that are searched, and what shows what is depicted.
DEPICTED = ("DepictedPeople", "DepictedPlace")
DESCRIBED = ("ObjectName", "ImageDescription", "Description")
PRIMARY_FIELDS = (*DESCRIBED, *DEPICTED, "Artist")
OTHER_FIELDS = ("Categories", "Credit")
MOST_ARTIST, MOST_DESCRIPTION = 160, 700
PICTURE_TYPES = ("pictures", "digital images", "paintings", "drawings", "prints", "photographs")
SCORE_FLOOR = 0.01  # a search without a hit falls back to all records at scores near zero
COLOURED, MONOCHROME = 0.10, 0.04


# A repository of files


def repository_files(payloads: DataFrame) -> DataFrame:
    """(payload, place, title, the first image's info, metadata as texts) of each page of the payloads (payload, ordinal)."""
    info = "struct<url:string,thumburl:string,descriptionurl:string,mime:string,width:int,height:int,extmetadata:map<string,struct<value:string>>>"
    kind = f"struct<query:struct<pages:map<string,struct<title:string,imageinfo:array<{info}>>>>>"
    pages = payloads.select("ordinal", F.posexplode(F.map_values(F.from_json("payload", kind)["query"]["pages"])).alias("place", "p"))
    return pages.select("ordinal", "place", F.coalesce("p.title", F.lit("")).alias("file"), F.get("p.imageinfo", F.lit(0)).alias("i"))


def repository_scan(payloads: DataFrame, query: str | None, need: int) -> DataFrame:
    """Items of a file repository's payloads (ordinal, payload), in their order.

    Files are images of known types under an open licence with an address. A bare page of a scanned work is none, and with a
    query the primary metadata must be relevant as well as all of them. Of several photographs of one accessioned object the
    one of the lowest asset number stands, at the place of the first; twice as many as needed come back."""
    meta = lambda k: F.coalesce(T.plain_text(F.col("i.extmetadata")[k]["value"]), F.lit(""))
    files = repository_files(payloads).where(F.col("i.mime").isin(*IMAGE_TYPES) & (F.coalesce("i.url", F.lit("")) != ""))
    names = (*PRIMARY_FIELDS, *OTHER_FIELDS, "LicenseShortName", "DateTimeOriginal")
    told = files.select("ordinal", "place", "file", "i", *[meta(k).alias(k) for k in names])
    kept = told.where(license_is_open(F.col("LicenseShortName")) & ~bare_document_page(F.col("file"), [F.col(c) for c in DESCRIBED], [F.col(c) for c in DEPICTED]))
    if query is not None:
        shown = F.regexp_replace(F.regexp_replace("file", "^File:", ""), "_", " ")
        text = lambda fields: F.concat_ws(" ", shown, *fields)
        kept = kept.where(W.relevant_item(query, text(PRIMARY_FIELDS), text((*PRIMARY_FIELDS, *OTHER_FIELDS))))
    number = F.coalesce(F.nullif(F.regexp_extract("file", r"(?i)\bDT(\d+)\b", 1), F.lit("")).cast("long"), F.lit(10**12))
    accession = F.nullif(F.lower(F.regexp_extract("Categories", r"\bMET\s+([0-9][0-9A-Za-z.\-]+)", 1)), F.lit(""))
    single = F.concat_ws("\x1f", F.lit("file"), F.col("ordinal"), F.col("place"))
    description = F.coalesce(F.nullif("ImageDescription", F.lit("")), F.col("Description"))
    rows = kept.select(
        "ordinal", "place", F.coalesce(accession, single).alias("key"), F.struct(number, F.lower("file"), "ordinal", "place").alias("view"),
        F.lit("commons").alias("source"), F.col("file").alias("source_id"), F.regexp_replace("file", "^File:", "").alias("title"), F.substring("Artist", 1, MOST_ARTIST).alias("artist"),
        F.trim(F.regexp_replace("DateTimeOriginal", r"(?is)\s*date\s+QS:.*$", "")).alias("date"), F.coalesce(F.nullif("ObjectName", F.lit("")), F.substring("Credit", 1, MOST_ARTIST)).alias("medium"), description.alias("description"), F.col("LicenseShortName").alias("license"),
        T.clean_url(F.coalesce("i.descriptionurl", F.lit(""))).alias("page_url"), T.clean_url("i.url").alias("image_url"), T.clean_url(F.coalesce(F.nullif("i.thumburl", F.lit("")), F.col("i.url"))).alias("thumb_url"),
        F.coalesce("i.width", F.lit(0)).alias("width"), F.coalesce("i.height", F.lit(0)).alias("height"),
    )
    columns = [c for c in rows.columns if c not in ("ordinal", "place", "key", "view")]
    objects = rows.groupBy("key").agg(F.min(F.struct("ordinal", "place")).alias("at"), F.min_by(F.struct(*columns), "view").alias("row"))
    best = objects.orderBy("at").limit(need * 2)
    return best.select(F.col("at.ordinal").alias("ordinal"), F.col("at.place").alias("place"), "row.*").withColumn("description", W.centered_excerpts(query or "", MOST_DESCRIPTION)("description"))


# Images and their works


def service_image(url: Column) -> Column:
    """The whole image of an image service's address, be it the service's description, a thumbnail or a view."""
    base = F.regexp_extract(F.regexp_replace(F.coalesce(url, F.lit("")), r"/thumbs/", "/image/"), r"^(https?://.*?/image/[^/]+|https?://.*?)(?:/info\.json|/full/.*)?$", 1)
    return F.when(base != "", F.concat(base, F.lit("/full/max/0/default.jpg"))).otherwise("")


def can_show_primary(work_type: Column) -> Column:
    """Whether any member of a work is shown by the work's own primary view: for pictures, not for books whose first image is
    a title page, and not where the type is unknown."""
    return F.coalesce(F.lower(F.trim(work_type)).isin(*PICTURE_TYPES), F.lit(False))


def noun_forms(word: str) -> list[str]:
    """A noun's own singular and plural; no other word of the same stem."""
    bare = word.lower()
    forms = [bare, f"{bare}s", f"{bare}es"]
    forms += [f"{bare[:-1]}ies"] if bare.endswith("y") else []
    forms += [f"{bare[:-3]}y"] if len(bare) > 4 and bare.endswith("ies") else []
    forms += [bare[:-1]] if len(bare) > 3 and bare.endswith("s") and not bare.endswith("ss") else []
    forms += [bare[:-2]] if len(bare) > 4 and bare.endswith(("ches", "shes", "xes", "sses", "zes")) else []
    return list(dict.fromkeys(forms))


def single_word_supported(query: str, *texts: Column) -> Column:
    """A query of one word needs that word or its noun form in the texts; others aren't judged."""
    words = T.fold_exact_py(query).split()
    if len(words) != 1:
        return F.lit(True)
    return F.arrays_overlap(F.flatten(F.array(*[T.fold_tokens(t) for t in texts])), F.array(*map(F.lit, noun_forms(words[0]))))


def image_works(images: DataFrame, works: DataFrame, query: str, need: int, phrases: Iterable[str] = ()) -> DataFrame:
    """The first `need` images (ordinal, image_id, work_id, title, image_url, license) with what their works (work_id,
    work_type, description, artists, dates, medium, thumb_url, subjects, notes: arrays but for texts) tell.

    An image whose work isn't known stays as it is. Where the work's type allows, its primary view takes the matched image's
    place, which is kept as matched_image_url. Exact phrases must stand in one text; a single word is verified."""
    told = images.join(works.withColumnRenamed("thumb_url", "work_thumb"), "work_id", "left")
    lists = F.concat(*[F.coalesce(F.col(c), F.array().cast("array<string>")) for c in ("subjects", "notes")])
    fields = told.withColumns({"__lists": lists, "__all": F.concat_ws("\n", "title", "description", F.array_join("artists", "\n"), F.array_join("dates", "\n"), "medium", F.array_join(lists, "\n"))})
    held = F.lit(True)
    for phrase in phrases:
        each = T.contains_phrase("title", phrase) | T.contains_phrase("description", phrase) | T.contains_phrase("medium", phrase)
        held = held & (each | _in_any(F.col("__lists"), phrase))
    kept = fields.where(held & single_word_supported(query, F.col("__all"))).orderBy("ordinal", "image_id").limit(need)
    own, primary = service_image(F.col("image_url")), F.when(can_show_primary(F.col("work_type")), F.nullif(service_image(F.col("work_thumb")), F.lit("")))
    return kept.select(
        "ordinal", F.col("image_id").alias("source_id"), "work_id", F.coalesce("title", F.lit("Untitled")).alias("title"), F.coalesce(F.array_join("artists", "; "), F.lit("")).alias("artist"), F.coalesce(F.get("dates", F.lit(0)), F.lit("")).alias("date"),
        F.coalesce("medium", F.lit("")).alias("medium"), F.coalesce("description", F.lit("")).alias("description"), F.coalesce("license", F.lit("unknown")).alias("license"), F.coalesce(primary, own).alias("image_url"), own.alias("matched_image_url"),
        primary.isNotNull().alias("is_primary_view"), F.lit("english_stem").alias("match_highlight_mode"),
    )


def _in_any(texts: Column, phrase: str) -> Column:
    return F.exists(texts, lambda x: T.contains_phrase(x, phrase))


# Scored searches and their deliveries


def above_floor(hits: DataFrame, score: str = "score") -> DataFrame:
    """Hits that a search really scored; those without a score stay."""
    return hits.where(F.coalesce(F.col(score) >= SCORE_FLOOR, F.lit(True)))


def covers_concepts(query: str, *texts: Column) -> Column:
    """Whether texts, hidden terms among them, hold enough of the query's ideas: both of two, else half of them and two at
    least. A query of one idea is left to the search."""
    ideas = T.concepts(query)
    if len(ideas) < 2:
        return F.lit(True)
    least = 2 if len(ideas) == 2 else max(2, (len(ideas) + 1) // 2)
    held = lambda words: F.size(F.filter(F.array(*[F.arrays_overlap(words, F.array(*map(F.lit, idea))) for idea in ideas]), lambda x: x)) >= least
    return T.let(F.array_distinct(F.flatten(F.array(*[T.fold_tokens(t) for t in texts]))), held)


def surfaced(description: Column, hidden: Column, query: str) -> Column:
    """A description that also shows the hidden terms (an array) which hold a word of the query that it lacks."""
    wanted = F.array(*map(F.lit, T.query_tokens(query) or [""]))
    shown = F.coalesce(description, F.lit(""))
    lacking = F.array_except(wanted, T.fold_tokens(shown))
    telling = T.let(lacking, lambda words: F.filter(F.coalesce(hidden, F.array().cast("array<string>")), lambda h: F.arrays_overlap(T.fold_tokens(h), words)))
    said = F.transform(telling, lambda h: F.concat(F.lit("Subject term — “"), h, F.lit("”")))
    return F.concat_ws(" ", F.nullif(shown, F.lit("")), F.nullif(F.array_join(said, " "), F.lit("")))


def keeps_colour(current: Column, other: Column) -> Column:
    """Whether another reproduction of a work will do: not a monochrome one where the current one is coloured. What isn't
    known speaks against none."""
    return ~F.coalesce((current >= COLOURED) & (other < MONOCHROME), F.lit(False))


def delivered(items: DataFrame, deliveries: list[tuple[str, DataFrame]]) -> DataFrame:
    """Items (id, image_url, ...) with the first delivery that has them: `image_delivery` names it, and its image_url,
    preview_width and preview_height replace or follow the item's. Deliveries (id, url, width, height) may hold an id often."""
    every = None
    for k, (name, table) in enumerate(deliveries):
        one = table.where("url <> ''").select("id", F.lit(k).alias("k"), F.lit(name).alias("name"), "url", "width", "height")
        every = one if every is None else every.unionByName(one)
    first = first_by(every.withColumn("__url", F.col("url")), ["id"], [F.col("k"), F.col("__url")]).drop("__url", "k") if every is not None else None
    if first is None:
        return items.withColumns({"image_delivery": F.lit(""), "preview_width": F.lit(0), "preview_height": F.lit(0)})
    found = first.select("id", F.col("name").alias("__name"), F.col("url").alias("__found"), F.col("width").alias("__w"), F.col("height").alias("__h"))
    return items.join(found, "id", "left").withColumns(
        {"image_delivery": F.coalesce("__name", F.lit("")), "image_url": F.coalesce("__found", "image_url"), "preview_width": F.coalesce("__w", F.lit(0)), "preview_height": F.coalesce("__h", F.lit(0))}
    ).drop("__name", "__found", "__w", "__h")


# A museum's released tables

OBJECTS = "objectid string, title string, attribution string, displaydate string, medium string, classification string"
IMAGES = "uuid string, iiifurl string, iiifthumburl string, viewtype string, sequence string, width string, height string, openaccess string, depictstmsobjectid string, assistivetext string"


def read_release(spark: SparkSession, objects: str, images: str) -> tuple[DataFrame, DataFrame]:
    """The two files of a release, by their headers; further columns are left out, values may hold line ends."""

    def table(path: str, kind: str) -> DataFrame:
        rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("encoding", "UTF-8").csv(path)
        bare = rows.toDF(*[c.lstrip("\ufeff") for c in rows.columns])
        return bare.select(*[F.col(c) if c in bare.columns else F.lit(None).cast("string").alias(c) for c in (part.split()[0] for part in kind.split(", "))])

    return table(objects, OBJECTS), table(images, IMAGES)


def release_works(objects: DataFrame, images: DataFrame, page_base: str) -> DataFrame:
    """A work for each object with an open image that has an address: the primary view, else the first in sequence, of each
    object in one aggregate; then its texts for search and its addresses of the whole and a bounded image."""
    text = lambda c: F.coalesce(F.trim(F.col(c)), F.lit(""))
    usable = images.where((text("openaccess") == "1") & (text("iiifurl") != "") & (text("depictstmsobjectid") != ""))
    shown = usable.select(F.trim("depictstmsobjectid").alias("objectid"), F.regexp_replace(F.trim("iiifurl"), "/+$", "").alias("iiif"), F.lower(text("viewtype")).alias("view"), T.safe_int("sequence").alias("sequence"), "uuid", T.safe_int("width").alias("width"), T.safe_int("height").alias("height"), text("assistivetext").alias("description"))
    best = first_by(shown.withColumn("__uuid", F.col("uuid")), ["objectid"], [(F.col("view") != "primary").cast("int"), F.col("sequence"), F.col("__uuid")])
    rows = objects.where(text("objectid") != "").withColumn("objectid", F.trim("objectid")).join(best, "objectid")
    title = F.coalesce(F.nullif(text("title"), F.lit("")), F.lit("Untitled"))
    return rows.select(
        F.lit("nga").alias("source"), F.col("objectid").alias("source_id"), title.alias("title"), text("attribution").alias("artist"), text("displaydate").alias("date"), text("medium").alias("medium"), text("classification").alias("classification"), "description",
        F.lit("NGA Open Access").alias("license"), artwork_url(page_base, F.col("objectid"), title).alias("page_url"), F.concat("iiif", F.lit("/full/full/0/default.jpg")).alias("image_url"), F.concat("iiif", F.lit("/full/!1024,1024/0/default.jpg")).alias("thumb_url"), "width", "height",
    )


# Aggregators, details and recognised words


def aggregated(payloads: DataFrame, assets: DataFrame) -> DataFrame:
    """Items of an aggregator's payloads (ordinal, payload) that show an image: no document, and no page of a register by its
    provider's own records `assets` (asset_id, category). What these records don't know stays. A description is English if there
    is one, else of the first language."""
    texts = "array<string>"
    item = f"struct<id:string,title:{texts},dataProvider:{texts},edmIsShownBy:{texts},edmPreview:{texts},rights:{texts},dcCreator:{texts},dcDescription:{texts},dcDescriptionLangAware:map<string,{texts}>>"
    rows = payloads.select("ordinal", F.posexplode(F.from_json("payload", f"struct<items:array<{item}>>")["items"]).alias("place", "r")).select("ordinal", "place", "r.*")
    first = lambda c: F.coalesce(F.get(c, F.lit(0)), F.lit(""))
    spoken = F.coalesce("dcDescriptionLangAware", F.create_map().cast(f"map<string,{texts}>"))
    english = F.filter(F.map_keys(spoken), lambda k: F.lower(k).startswith("en"))
    in_english = F.when(F.size(english) > 0, first(F.element_at(spoken, F.get(F.array_sort(english), F.lit(0)))))
    named = F.coalesce(F.nullif(in_english, F.lit("")), F.nullif(first(F.get(F.map_values(spoken), F.lit(0))), F.lit("")), first("dcDescription"))
    shown = rows.withColumn("image", T.clean_url(first("edmIsShownBy"))).where(F.col("image") != "")
    bare = F.regexp_replace("image", r"[?#].*$", "")
    images = shown.where(~F.lower(bare).endswith(".pdf")).withColumn("asset_id", F.regexp_extract(F.regexp_replace(bare, "/+$", ""), r"([^/]*)$", 1))
    registers = assets.where(F.lower(F.trim("category")) == "register").select("asset_id").distinct()
    kept = images.join(registers, "asset_id", "left_anti")
    return kept.select(
        "ordinal", "place", F.lit("europeana").alias("source"), F.col("id").alias("source_id"), F.coalesce(F.nullif(first("title"), F.lit("")), F.lit("Untitled")).alias("title"), first("dcCreator").alias("artist"), named.alias("description"),
        first("rights").alias("license"), first("dataProvider").alias("attribution"), F.col("image").alias("image_url"), F.coalesce(F.nullif(first("edmPreview"), F.lit("")), F.col("image")).alias("thumb_url"),
    )


def with_details(items: DataFrame, details: DataFrame, texts: dict[str, str]) -> DataFrame:
    """Items (source_id, description) with their details (source_id, summary, and the columns named by `texts`): the summary
    describes an item that has no description, and `search_text` holds the other texts by their labels. An item without details stays."""
    parts = [F.struct(F.lit(label).alias("key"), T.strip_tags(c).alias("value")) for c, label in texts.items()]
    told = details.select("source_id", T.plain_text("summary").alias("__summary"), F.map_from_entries(F.filter(F.array(*parts), lambda e: e["value"] != "")).alias("search_text"))
    none = F.create_map().cast("map<string,string>")
    joined = items.join(told, "source_id", "left")
    return joined.withColumns({"description": F.coalesce(F.nullif("description", F.lit("")), "__summary", F.lit("")), "search_text": F.coalesce("search_text", none)}).drop("__summary")


def recognised(items: DataFrame, tags: DataFrame, query: str, texts: list[str]) -> DataFrame:
    """Hits of a query of one word whose own texts hold its noun form, or in whose image it was recognised (`tags`: source_id,
    kind, words): a recognised word counts whole, so that `run` is no sign of runes. Queries of more words aren't judged."""
    wanted = T.fold_exact_py(query).split()
    if len(wanted) != 1:
        return items
    forms = F.array(*map(F.lit, noun_forms(wanted[0])))
    seen = tags.where((F.col("kind") == "textdetection") & F.exists("words", lambda w: F.arrays_overlap(T.fold_tokens(w), forms))).select("source_id").distinct().withColumn("__seen", F.lit(True))
    return items.join(seen, "source_id", "left").where(F.coalesce("__seen", F.lit(False)) | single_word_supported(query, *[F.col(c) for c in texts])).drop("__seen")

