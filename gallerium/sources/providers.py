"""Payloads of providers (a JSON column `payload`) to item columns, by JSON paths and higher-order functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

OPEN_LICENSES = r"(?i)public domain|cc0|cc by|pdm"
CARD_GENRES = ("card catalogs", "card catalog")
IMAGE_TYPES = ("image/jpeg", "image/png", "image/webp")


def license_is_open(license: Column) -> Column:
    return F.coalesce(F.regexp_replace(license, "-", " ").rlike(OPEN_LICENSES), F.lit(False))


def media_wiki(payloads: DataFrame) -> DataFrame:
    """One row a page of a MediaWiki image query: open licences and image types only."""
    info = "struct<url:string,thumburl:string,descriptionurl:string,mime:string,width:int,height:int,extmetadata:map<string,struct<value:string>>>"
    kind = f"struct<query:struct<pages:map<string,struct<pageid:long,title:string,index:int,imageinfo:array<{info}>>>>>"
    pages = payloads.select(F.explode(F.map_values(F.from_json("payload", kind)["query"]["pages"])).alias("p"))
    rows = pages.select("p.pageid", "p.title", "p.index", F.col("p.imageinfo")[0].alias("i"))
    meta = lambda k: T.strip_tags(F.col("i.extmetadata")[k]["value"])
    out = rows.select(
        F.lit("commons").alias("source"), F.col("pageid").cast("string").alias("source_id"),
        F.regexp_replace(F.regexp_replace("title", "^File:", ""), r"\.[A-Za-z]{3,4}$", "").alias("title"),
        meta("Artist").alias("artist"), F.regexp_replace(meta("DateTimeOriginal"), r"\s*(QS:|date QS).*$", "").alias("date"), meta("ImageDescription").alias("description"), meta("LicenseShortName").alias("license"),
        F.col("i.descriptionurl").alias("page_url"), F.col("i.url").alias("image_url"), F.col("i.thumburl").alias("thumb_url"),
        F.col("i.width").alias("width"), F.col("i.height").alias("height"), F.col("i.mime").alias("mime"), F.col("index").alias("provider_rank"),
    )
    return out.where(F.col("mime").isin(*IMAGE_TYPES) & license_is_open(F.col("license"))).drop("mime")


def museum_records(payloads: DataFrame) -> DataFrame:
    """Records with permission level 0, the first image by display order, and an artist by role, else the first person."""
    image = "struct<baseimageurl:string,displayorder:int,width:int,height:int>"
    record = f"struct<id:long,title:string,dated:string,medium:string,imagepermissionlevel:int,url:string,description:string,images:array<{image}>,people:array<struct<name:string,role:string>>>"
    rows = payloads.select(F.explode(F.from_json("payload", f"struct<records:array<{record}>>")["records"]).alias("r")).select("r.*")
    first = F.array_sort(F.transform("images", lambda i: F.struct(F.coalesce(i["displayorder"], F.lit(9999)).alias("o"), i.alias("i"))))[0]["i"]
    artist = F.coalesce(F.filter("people", lambda p: p["role"] == "Artist")[0]["name"], F.col("people")[0]["name"])
    shown = rows.where((F.col("imagepermissionlevel") == 0) & (F.size("images") > 0)).withColumns({"i": first, "artist": artist})
    return shown.select(
        F.lit("harvard").alias("source"), F.col("id").cast("string").alias("source_id"), "title", "artist", F.col("dated").alias("date"), "medium", "description", F.col("url").alias("page_url"),
        F.col("i.baseimageurl").alias("image_url"), F.col("i.width").alias("width"), F.col("i.height").alias("height"),
    )


def catalog_card(genres: Column, captions: Column, notes: Column, collections: Column) -> Column:
    """A scanned catalog card: classed as one, and said to be one by a caption, a note or the collection's name. All are arrays
    of strings."""
    plain = lambda values: F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda x: F.trim(F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), r"\s+", " ")))
    said = lambda values, words: F.array_join(plain(values), " ").contains(words)
    return F.arrays_overlap(plain(genres), F.array(*map(F.lit, CARD_GENRES))) & (said(captions, "card catalog") | said(notes, "digitized catalog card") | said(collections, "card catalog"))


def library_results(payloads: DataFrame) -> DataFrame:
    """Digitised, unrestricted results that are neither texts of many files nor catalog cards; the largest image, and the thumbnail nearest to 1,024."""
    kind = "struct<results:array<struct<id:string,title:string,date:string,digitized:boolean,access_restricted:boolean,rights:string,image:array<struct<url:string,width:int,height:int>>,resources:array<struct<files:int,fulltext:string,caption:string>>,genre:array<string>,subject:array<string>,notes:array<string>,source_collection:array<string>,item:struct<genre:array<string>,subjects:array<string>,notes:array<string>,source_collection:array<string>>>>>"
    rows = payloads.select(F.explode(F.from_json("payload", kind)["results"]).alias("r")).select("r.*")
    text = F.exists(F.coalesce("resources", F.array().cast("array<struct<files:int,fulltext:string,caption:string>>")), lambda x: (x["files"] > 1) & x["fulltext"].isNotNull())
    area = F.array_sort(F.transform("image", lambda i: F.struct((-i["width"].cast("long") * i["height"]).alias("k"), i.alias("i"))))[0]["i"]
    thumb = F.array_sort(F.transform("image", lambda i: F.struct(F.abs(F.greatest(i["width"], i["height"]) - 1024).alias("k"), i.alias("i"))))[0]["i"]
    rights = F.when(F.col("rights").rlike("(?i)no known|public domain"), "public domain").otherwise(F.coalesce("rights", F.lit("unknown")))
    both = lambda *names: F.flatten(F.array(*[F.coalesce(F.col(c), F.array().cast("array<string>")) for c in names]))
    card = catalog_card(both("genre", "subject", "item.genre", "item.subjects"), F.col("resources.caption"), both("notes", "item.notes"), both("source_collection", "item.source_collection"))
    usable = ~card & F.col("digitized") & ~F.coalesce("access_restricted", F.lit(False)) & (F.size("image") > 0) & ~text
    return rows.where(usable).select(
        F.lit("loc").alias("source"), F.col("id").alias("source_id"), "title", "date", rights.alias("license"), F.col("id").alias("page_url"),
        area["url"].alias("image_url"), thumb["url"].alias("thumb_url"), area["width"].alias("width"), area["height"].alias("height"),
    )


def hits(payloads: DataFrame, image_base: str) -> DataFrame:
    """Search hits that are public domain, have a valid image and public access; images are at `image_base` and the id."""
    source = "struct<id:string,title:string,artist:string,dated:string,medium:string,rights_type:string,image:string,public_access:int,image_width:int,image_height:int>"
    rows = payloads.select(F.posexplode(F.from_json("payload", f"struct<hits:struct<hits:array<struct<_source:{source}>>>>")["hits"]["hits"]).alias("k", "h")).select("k", "h._source.*")
    kept = rows.where((F.lower("rights_type") == "public domain") & (F.col("image") == "valid") & (F.col("public_access") == 1))
    return kept.select(
        F.lit("mia").alias("source"), F.col("id").alias("source_id"), "title", "artist", F.col("dated").alias("date"), "medium",
        F.concat(F.lit(image_base), F.url_encode(F.regexp_replace("id", r"[^A-Za-z0-9_-]", ""))).alias("image_url"), F.col("image_width").alias("width"), F.col("image_height").alias("height"), F.col("k").alias("provider_rank"),
    )


def language_text(values: Column) -> Column:
    """The text of a language map: English, else unmarked, else the first."""
    return F.coalesce(values["en"], values["none"], values["@none"], F.map_values(values)[0])
