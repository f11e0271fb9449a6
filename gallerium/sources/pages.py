"""Pages of HTML to rows: anchors of image searches, gallery images, JSON-LD descriptions."""

from __future__ import annotations

import json
import re
import urllib.parse
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Scan(HTMLParser):
    """Collects image anchors, images within anchors, and the bodies of JSON-LD scripts."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.anchors: list[dict] = []
        self.images: list[tuple[str, str]] = []
        self.scripts: list[str] = []
        self.links: list[str] = []
        self._href = ""
        self._script: list[str] | None = None

    def handle_starttag(self, tag, attrs):
        values = {k: v or "" for k, v in attrs}
        if tag == "a":
            self._href = values.get("href", "")
            self.links.append(self._href)
            parts = urllib.parse.urlsplit(self._href)
            if parts.path == "/imgres":
                found = dict(urllib.parse.parse_qsl(parts.query))
                if found.get("imgurl"):
                    self.anchors.append(found)
        elif tag == "img" and self._href:
            self.images.append((self._href, values.get("src", "")))
        elif tag == "script" and values.get("type") == "application/ld+json":
            self._script = []

    def handle_endtag(self, tag):
        if tag == "a":
            self._href = ""
        elif tag == "script" and self._script is not None:
            self.scripts.append("".join(self._script))
            self._script = None

    def handle_data(self, data):
        if self._script is not None:
            self._script.append(data)


def scan(html: str | None) -> Scan:
    out = Scan()
    out.feed(html or "")
    return out


def longest_description(scripts: list[str]) -> str:
    """The longest `description` anywhere in the JSON-LD of a page."""
    best, stack = "", []
    for script in scripts:
        try:
            stack.append(json.loads(script))
        except ValueError:
            continue
    while stack:
        node = stack.pop()
        if isinstance(node, dict):
            text = node.get("description")
            if isinstance(text, str) and len(text) > len(best):
                best = text
            stack.extend(node.values())
        elif isinstance(node, list):
            stack.extend(node)
    return re.sub(r"\s+", " ", best).strip()


def image_anchors(pages: DataFrame) -> DataFrame:
    """(page_id, rank, image_url, page_url, width, height) of the image anchors of each page."""

    def run(frames):
        for frame in frames:
            rows = [
                (page, k, a["imgurl"], a.get("imgrefurl", ""), int(a["w"]) if a.get("w", "").isdigit() else 0, int(a["h"]) if a.get("h", "").isdigit() else 0)
                for page, html in zip(frame["page_id"], frame["html"])
                for k, a in enumerate(scan(html).anchors)
            ]
            yield pd.DataFrame(rows, columns=["page_id", "rank", "image_url", "page_url", "width", "height"])

    return pages.select("page_id", "html").mapInPandas(run, "page_id long, rank int, image_url string, page_url string, width int, height int")


def page_facts(pages: DataFrame) -> DataFrame:
    """(page_id, n_links, n_images, description) of each page."""

    def run(frames):
        for frame in frames:
            found = [scan(h) for h in frame["html"]]
            yield pd.DataFrame({"page_id": frame["page_id"], "n_links": [len(s.links) for s in found], "n_images": [len(s.images) for s in found], "description": [longest_description(s.scripts) for s in found]})

    return pages.select("page_id", "html").mapInPandas(run, "page_id long, n_links int, n_images int, description string")


def key_of(*parts) -> F.Column:
    """A content address for cached pages and answers."""
    return F.substring(F.sha1(F.concat_ws("\x1f", *parts)), 1, 20)


class Sections(HTMLParser):
    """Texts of the elements with chosen ids or classes, and the images of anchors below a path, in page order."""

    VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())

    def __init__(self, names: tuple[str, ...], below: str = ""):
        super().__init__(convert_charrefs=True)
        self.names, self.below = names, below
        self.texts: dict[str, list[str]] = {}
        self.images: list[tuple[str, str, str]] = []
        self.headings: list[tuple[str, str]] = []
        self._open: list[tuple[str, str]] = []
        self._href = ""

    def handle_starttag(self, tag, attrs):
        values = {k: v or "" for k, v in attrs}
        if tag == "a":
            self._href = values.get("href", "")
        if tag == "img" and self._href and urllib.parse.urlsplit(self._href).path.startswith(self.below):
            self.images.append((self._href, values.get("src", ""), values.get("alt", "")))
        if tag not in self.VOID:
            marks = {values.get("id", ""), *values.get("class", "").split()}
            self._open.append((tag, next((n for n in self.names if n in marks), "")))

    def handle_endtag(self, tag):
        if any(t == tag for t, _ in self._open):
            while self._open.pop()[0] != tag:
                pass
        if tag == "a":
            self._href = ""

    def handle_data(self, data):
        for name in {n for _, n in self._open if n}:
            self.texts.setdefault(name, []).append(data)
        if self._href and any(re.fullmatch("h[1-6]", t) for t, _ in self._open):
            self.headings.append((self._href, " ".join(data.split())))


def sections(html: str | None, names: tuple[str, ...], below: str = "") -> Sections:
    out = Sections(names, below)
    out.feed(html or "")
    return out


def section_texts(pages: DataFrame, names: list[str], prefixes: tuple[str, ...] = ()) -> DataFrame:
    """(page_id, text): the named sections of each page in the order of names, without their label, joined by blank lines."""
    wanted = tuple(names)

    def run(frames):
        for frame in frames:
            texts = []
            for page in frame["html"]:
                found = sections(page, wanted).texts
                parts = [" ".join("".join(found.get(n, [])).split()) for n in wanted]
                for prefix in prefixes:
                    parts = [p.removeprefix(prefix).strip() for p in parts]
                texts.append("\n\n".join(p for p in parts if p))
            yield pd.DataFrame({"page_id": frame["page_id"], "text": texts})

    return pages.select("page_id", "html").mapInPandas(run, "page_id long, text string")


def gallery_images(pages: DataFrame, below: str) -> DataFrame:
    """(source_id, page_id, rank, image_url, title) of images in anchors below a path; the stem of the anchor's address is the
    id, of which the first in page order stays."""
    from ..operators.items import first_by

    def run(frames):
        for frame in frames:
            rows = [
                (urllib.parse.urlsplit(href).path.rstrip("/").rsplit("/", 1)[-1].rsplit(".", 1)[0], page, k, src, " ".join(alt.split()))
                for page, html in zip(frame["page_id"], frame["html"])
                for k, (href, src, alt) in enumerate(sections(html, (), below).images)
            ]
            yield pd.DataFrame(rows, columns=["source_id", "page_id", "rank", "image_url", "title"])

    found = pages.select("page_id", "html").mapInPandas(run, "source_id string, page_id long, rank int, image_url string, title string").where("source_id <> ''")
    return first_by(found.withColumns({"__p": F.col("page_id"), "__r": F.col("rank")}), ["source_id"], [F.col("__p"), F.col("__r")]).drop("__p", "__r")


def gallery_index(html: str | None) -> list[tuple[str, str]]:
    """(address, heading) of linked headings, each address once."""
    return list(dict(reversed(sections(html, ()).headings)).items())[::-1]


def page_links(pages: DataFrame) -> DataFrame:
    """(page_url, place, url, heading) of the linked headings of pages (page_url, html), absolute and each once a page."""

    def run(frames):
        for frame in frames:
            rows = [(base, k, urllib.parse.urljoin(base, href), heading) for base, page in zip(frame["page_url"], frame["html"]) for k, (href, heading) in enumerate(gallery_index(page))]
            yield pd.DataFrame(rows, columns=["page_url", "place", "url", "heading"])

    return pages.select("page_url", "html").mapInPandas(run, "page_url string, place int, url string, heading string")


def crawl(pages: DataFrame, index_url: str, below: str, names: list[str]) -> DataFrame:
    """(source_id, title, gallery, page_url, image_url, description) of the galleries that an index page links, over stored
    pages (page_url, html).

    Galleries are followed by a join on their addresses, then their images' own pages for the named sections; an image whose
    page isn't there stays without a description. An image that several galleries show belongs to the first."""
    from ..operators.items import first_by

    index = page_links(pages.where(F.col("page_url") == index_url)).select(F.col("url").alias("gallery_url"), "heading", F.col("place").alias("gallery_place"))
    first = first_by(index.withColumn("__p", F.col("gallery_place")), ["gallery_url"], [F.col("__p")]).drop("__p")
    galleries = pages.join(first, F.col("page_url") == F.col("gallery_url")).select("gallery_url", "heading", "gallery_place", "html")
    kind = "source_id string, gallery string, gallery_place int, rank int, page_url string, image_url string, title string"

    def images(frames):
        for frame in frames:
            rows = []
            for base, heading, place, page in zip(frame["gallery_url"], frame["heading"], frame["gallery_place"], frame["html"]):
                for k, (href, src, alt) in enumerate(sections(page, (), below).images):
                    at = urllib.parse.urljoin(base, href)
                    stem = urllib.parse.urlsplit(at).path.rstrip("/").rsplit("/", 1)[-1].rsplit(".", 1)[0]
                    rows.append((stem, heading, place, k, at, urllib.parse.urljoin(base, src), " ".join(alt.split())))
            yield pd.DataFrame(rows, columns=["source_id", "gallery", "gallery_place", "rank", "page_url", "image_url", "title"])

    shown = galleries.mapInPandas(images, kind).where("source_id <> ''")
    once = first_by(shown.withColumns({"__g": F.col("gallery_place"), "__r": F.col("rank")}), ["source_id"], [F.col("__g"), F.col("__r")]).drop("__g", "__r")
    wanted = pages.select(F.col("page_url").alias("url"), "html").join(once.select(F.col("page_url").alias("url")).distinct(), "url", "left_semi")
    wanted_names = tuple(names)

    def told(frames):
        for frame in frames:
            texts = []
            for page in frame["html"]:
                found = sections(page, wanted_names).texts
                texts.append("\n\n".join(t for n in wanted_names if (t := " ".join("".join(found.get(n, [])).split()))))
            yield pd.DataFrame({"url": frame["url"], "description": texts})

    described = first_by(wanted.mapInPandas(told, "url string, description string"), ["url"], [F.col("description")])
    out = once.join(described, F.col("page_url") == F.col("url"), "left")
    return out.select("source_id", "title", "gallery", "gallery_place", "rank", "page_url", "image_url", F.coalesce("description", F.lit("")).alias("description"))

