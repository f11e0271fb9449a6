"""Why an item matches: the best of its labelled texts, the words found over all of them, and those that are missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

LABELS = {"title": "Title", "description": "Description", "artist": "Artist", "date": "Date", "medium": "Medium", "attribution": "Attribution"}
NONE_VISIBLE = "provider_returned_without_visible_evidence"


def labelled(df: DataFrame, extra: Column | None = None) -> Column:
    """(label, text) of all fields, and of a map `extra` whose keys become titles."""
    fields = F.array(*[F.struct(F.lit(label).alias("label"), F.coalesce(F.col(c).cast("string"), F.lit("")).alias("text")) for c, label in LABELS.items() if c in df.columns])
    if extra is None:
        return fields
    entries = F.transform(F.map_entries(extra), lambda e: F.struct(F.initcap(F.regexp_replace(e["key"], "_", " ")).alias("label"), F.coalesce(e["value"], F.lit("")).alias("text")))
    return F.concat(fields, F.coalesce(entries, F.array().cast("array<struct<label:string,text:string>>")))


def evidence(df: DataFrame, query: str, extra: Column | None = None) -> DataFrame:
    """df with match_context, matched_fields, matched_query_terms, missing_query_terms and match_evidence_status. The best
    text holds the phrase, then most words, then stands first, then is shortest. All in one projection, without a shuffle."""
    wanted = T.query_tokens(query)
    needle = " ".join(T.fold_exact_py(query).split())
    tidy = F.transform(labelled(df, extra), lambda x: F.struct(x["label"].alias("label"), F.trim(F.regexp_replace(x["text"], r"\s+", " ")).alias("text")))

    def judged(x: Column, at: Column) -> Column:
        has_phrase = F.concat(F.lit(" "), T.phrase_tokens(x["text"]), F.lit(" ")).contains(f" {needle} ") if needle else F.lit(False)
        row = lambda found: F.struct(has_phrase.cast("int").alias("phrase"), F.size(found).alias("n"), (-at).alias("order"), (-F.length(x["text"])).alias("length"), x["label"].alias("label"), x["text"].alias("text"), found.alias("found"))
        return T.let(T.matched(query, T.tokens(x["text"])), row)

    rows = df.withColumn("__e", F.filter(F.transform(tidy, judged), lambda x: (x["text"] != "") & ((x["n"] > 0) | (x["phrase"] > 0))))
    best = F.array_max("__e")
    found = F.array_sort(F.array_distinct(F.flatten(F.transform("__e", lambda x: x["found"]))))
    every = F.array(*map(F.lit, wanted)) if wanted else F.array().cast("array<string>")
    return rows.withColumns({
        "match_context": F.coalesce(best["text"], F.lit("")),
        "matched_fields": F.array_distinct(F.transform("__e", lambda x: x["label"])),
        "matched_query_terms": found,
        "missing_query_terms": F.array_sort(F.array_except(every, found)),
        "match_evidence_status": F.when(F.size("__e") > 0, "supported").otherwise(NONE_VISIBLE),
    }).drop("__e")
