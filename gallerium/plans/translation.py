"""Searches in a collection's own words: a thesaurus turns queries into ranked searches, and later ones stand in for earlier.

Many queries go together: their phrases and words meet the thesaurus in one join by folded labels, all their searches meet the
records in one scan, and each query's results are then taken page by page in order of its searches, of which every search adds at
most PAGES pages, so that a query's group has a bound."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# Keywords of a term and words of a query that are looked up, rows a page, and pages a search.
MOST_KEYWORDS, PAGE, PAGES = 4, 50, 8
QUALIFIER = r"\s*\([^)]*\)\s*$"
SEARCH = "rank int, kind string, words array<string>, evidence array<string>, if_empty boolean"


class Labels(HTMLParser):
    """(label, keyword) of a thesaurus page: the headings of a section are the label of the section's keyword links."""

    def __init__(self, mark: str):
        super().__init__(convert_charrefs=True)
        self.mark, self.found, self.label, self.inside = mark, [], [], False

    def handle_starttag(self, tag, attrs):
        if tag == "section":
            self.label = []
        elif tag == "h2":
            self.inside = True
        elif tag == "a":
            _, quoted, rest = (dict(attrs).get("href") or "").partition(f'"{self.mark}"')
            if quoted and (keyword := _quoted(rest)):
                self.found.append((" ".join("".join(self.label).split()), keyword))

    def handle_endtag(self, tag):
        if tag == "h2":
            self.inside = False

    def handle_data(self, data):
        if self.inside:
            self.label.append(data)


def _quoted(text: str) -> str:
    """The first string in double quotes after a comma, without its backslashes."""
    before, comma, after = text.partition(",")
    after = after.lstrip()
    if before.strip() or not comma or not after.startswith('"'):
        return ""
    out, at = [], 1
    while at < len(after) and after[at] != '"':
        at += after[at] == "\\"
        out.append(after[at : at + 1])
        at += 1
    return "".join(out) if at < len(after) else ""


def thesaurus_pages(pages: DataFrame, mark: str) -> DataFrame:
    """(ordinal, label, keyword) of pages (page_id, html), in page order."""

    def run(frames):
        for frame in frames:
            rows = []
            for page, html in zip(frame["page_id"], frame["html"]):
                parser = Labels(mark)
                parser.feed(html or "")
                rows += [(page * 100_000 + k, *pair) for k, pair in enumerate(parser.found)]
            yield pd.DataFrame(rows, columns=["ordinal", "label", "keyword"])

    return pages.select("page_id", "html").mapInPandas(run, "ordinal long, label string, keyword string")


def translations(terms: DataFrame, thesaurus: DataFrame) -> DataFrame:
    """(term, pairs): the keywords (label, keyword) of each term (term) whose label is the term, with or without the label's
    qualifier; a label that only contains the term is no translation. Each keyword once, the first MOST_KEYWORDS by ordinal."""
    keys = F.explode(F.array_distinct(F.array(T.fold("label"), T.fold(F.regexp_replace("label", QUALIFIER, "")))))
    named = thesaurus.where("keyword <> ''").select("ordinal", "label", "keyword", keys.alias("key"))
    met = terms.select("term").distinct().withColumn("key", T.fold("term")).where("key <> ''").join(named, "key")
    one = met.groupBy("term", "keyword").agg(F.min("ordinal").alias("ordinal"), F.min_by("label", "ordinal").alias("label"))
    first = one.withColumn("n", F.row_number().over(Window.partitionBy("term").orderBy("ordinal"))).where(F.col("n") <= MOST_KEYWORDS)
    return first.groupBy("term").agg(F.array_sort(F.collect_list(F.struct("ordinal", "label", "keyword"))).alias("pairs"))


def _bare(keyword: Column) -> Column:
    return F.regexp_replace(keyword, QUALIFIER, "")


def _said(pairs: Column, said) -> Column:
    """What is told of pairs whose label and keyword differ."""
    return F.transform(F.filter(pairs, lambda p: T.fold(p["label"]) != T.fold(p["keyword"])), said)


def searches(queries: DataFrame, thesaurus: DataFrame) -> DataFrame:
    """(query_id, rank, kind, words, evidence, if_empty) for queries (query_id, query).

    A query that is a label becomes a search by its keywords, then one of the text for the first of them. Else, if it has a few
    words, these are translated one by one: with all translated the translation goes first and the query itself stands in if
    that finds nothing; with some, the other way round. The kinds: `keyword` is met by any of the words, `text` by all."""
    tidy = queries.select("query_id", F.trim(F.regexp_replace("query", r"\s+", " ")).alias("query")).where("query <> ''")
    whole = translations(tidy.select(F.col("query").alias("term")), thesaurus).select(F.col("term").alias("query"), F.col("pairs").alias("whole"))
    meant = F.filter(F.array_distinct(F.regexp_extract_all("query", F.lit(r"(?U)([\w'’-]+)"), F.lit(1))), lambda w: (T.fold(w) != "") & ~T.fold(w).isin(*T.STOP_WORDS))
    parts = tidy.select("query_id", "query", meant.alias("meant")).withColumn("meant", F.when((F.size("meant") > 1) & (F.size("meant") <= MOST_KEYWORDS), F.col("meant")))
    words = parts.select("query_id", F.posexplode("meant").alias("at", "term"))
    pairs = words.join(translations(words.select("term"), thesaurus), "term").select("query_id", "at", F.col("pairs")[0]["label"].alias("label"), _bare(F.col("pairs")[0]["keyword"]).alias("keyword"))
    own = pairs.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("at", "label", "keyword"))).alias("pairs"))
    rows = parts.join(whole, "query", "left").join(own, "query_id", "left")

    arrow = lambda p: F.concat(p["label"], F.lit(" → "), p["keyword"])
    none = F.array().cast("array<string>")
    one = lambda kind, words, evidence, if_empty: F.struct(F.lit(kind).alias("kind"), words.alias("words"), evidence.alias("evidence"), F.lit(if_empty).alias("if_empty"))
    literal = lambda if_empty: one("text", T.fold_tokens("query"), none, if_empty)
    translated = lambda if_empty: one("text", T.fold_tokens(F.array_join(F.col("pairs.keyword"), " ")), _said(F.col("pairs"), arrow), if_empty)
    first = F.array(F.struct(F.col("whole")[0]["label"].alias("label"), _bare(F.col("whole")[0]["keyword"]).alias("keyword")))
    by_keyword = F.array(
        one("keyword", F.col("whole.keyword"), _said(F.col("whole"), lambda p: F.concat(p["keyword"], F.lit(" ("), p["label"], F.lit(")"))), False),
        one("text", T.fold_tokens(first[0]["keyword"]), _said(first, arrow), False),
    )
    n = F.coalesce(F.size("pairs"), F.lit(0))
    plan = F.when(F.col("whole").isNotNull(), by_keyword).when(F.col("meant").isNull() | (n <= 0), F.array(literal(False))).when(n == F.size("meant"), F.array(translated(False), literal(True))).otherwise(F.array(literal(False), translated(True)))
    return rows.select("query_id", F.posexplode(plan).alias("rank", "s")).select("query_id", "rank", "s.*")


def run(planned: DataFrame, records: DataFrame, need: int) -> DataFrame:
    """(query_id, rank, place, source_id, image_url, evidence) of records (source_id, image_url, ordinal, text, keywords) for
    planned searches, `place` being the result's place in its query.

    A search gives its records by ordinal, in pages. A record goes if an identity of it, its id or its image, belongs to one
    that came before. After a page that makes the results enough, nothing more is read, and a search that stands in is left out
    if there are results."""
    asked = planned.select("query_id", "rank", "kind", "evidence", "if_empty", F.array_distinct("words").alias("words")).withColumn("n", F.when(F.col("kind") == "text", F.size("words")).otherwise(1))
    wanted = asked.select("query_id", "rank", "kind", "n", F.explode("words").alias("word"))
    held = F.concat(
        F.transform(F.array_distinct(T.fold_tokens("text")), lambda w: F.struct(F.lit("text").alias("kind"), w.alias("word"))),
        F.transform(F.array_distinct(F.coalesce("keywords", F.array().cast("array<string>"))), lambda w: F.struct(F.lit("keyword").alias("kind"), w.alias("word"))),
    )
    words = records.select("source_id", "image_url", "ordinal", F.explode(held).alias("h")).select("source_id", "image_url", "ordinal", "h.*")
    met = words.join(wanted, ["kind", "word"]).groupBy("query_id", "rank", "n", "source_id", "image_url", "ordinal").agg(F.count("*").alias("held")).where(F.col("held") >= F.col("n"))
    pages = min(PAGES, max(1, -(-need // PAGE)))
    ordered = met.withColumn("at", F.row_number().over(Window.partitionBy("query_id", "rank").orderBy("ordinal", "source_id")) - 1).where(F.col("at") < pages * PAGE)
    rows = ordered.join(asked.select("query_id", "rank", "evidence", "if_empty"), ["query_id", "rank"]).select("query_id", "rank", "at", "if_empty", "source_id", "image_url", "evidence")
    kind = planned.schema["query_id"].dataType.simpleString()
    out = f"query_id {kind}, rank int, place int, source_id {records.schema['source_id'].dataType.simpleString()}, image_url string, evidence array<string>"

    def take(frame: pd.DataFrame) -> pd.DataFrame:
        kept, seen = [], set()
        for (_, if_empty), search in frame.sort_values(["rank", "at"]).groupby(["rank", "if_empty"], sort=True):
            if len(kept) >= need or (if_empty and kept):
                break
            for start in range(0, pages * PAGE, PAGE):
                page = search[(search["at"] >= start) & (search["at"] < start + PAGE)]
                for r in page.itertuples():
                    own = {("id", r.source_id), ("image", r.image_url)}
                    if not own & seen:
                        seen |= own
                        kept.append((r.query_id, r.rank, len(kept), r.source_id, r.image_url, r.evidence))
                if len(kept) >= need or len(page) < PAGE:
                    break
        return pd.DataFrame(kept, columns=["query_id", "rank", "place", "source_id", "image_url", "evidence"])

    return rows.groupBy("query_id").applyInPandas(take, out)  # a query's searches times their pages
