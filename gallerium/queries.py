"""Registered queries over the test tables, each with the SQL that DuckDB runs for the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import scoring as S
from .functions import text as T
from .operators import catalog, evidence, families, items, staged, tournament
from .plans import phrases
from .plans import search as plans
from .sources import pages as html
from .sources import postings, providers
from .streaming import keyed, session

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
QUERY = "the tion with"
TERMS = ("the", "tion", "with")


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def document_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as items: the first sentence is the title, the language the medium."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", "text", "source", "lang", F.split("text", r"\.", 2)[0].alias("title"), F.pmod("doc_id", F.lit(7)).cast("int").alias("provider_rank"))


FOLD = "regexp_extract_all(lower(strip_accents({0})), '[a-z0-9]+')"
TOKENS = "list_distinct([x FOR x IN " + FOLD + " IF length(x) > 1 AND x NOT IN (" + ", ".join(f"'{w}'" for w in T.STOP_WORDS) + ")])"
ITEMS = "SELECT doc_id, text, source, lang, string_split(text, '.')[1] AS title, (doc_id % 7)::INT AS provider_rank FROM documents"
COVER = "(len(list_intersect({0}, ['tion']))) / 1.0"


# Text functions and filters


@query(f"SELECT doc_id, len({FOLD.format('text')})::INT AS n_tokens, len({TOKENS.format('text')})::INT AS n_terms, md5(array_to_string({FOLD.format('text')}, ' ')) AS folded FROM documents")
def text_fold(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    words = docs.select("doc_id", T.fold_tokens("text").alias("w"))
    return words.select("doc_id", F.size("w").alias("n_tokens"), F.size(T.terms(F.col("w"))).alias("n_terms"), F.md5(F.array_join("w", " ")).alias("folded"))


@query("SELECT doc_id, length(regexp_replace(lower(text), '[^\\p{L}\\p{M}\\p{N}]+', ' ', 'g').trim())::INT AS n, contains(' ' || regexp_replace(lower(text), '[^\\p{L}\\p{M}\\p{N}]+', ' ', 'g').trim() || ' ', ' and the ') AS has_phrase FROM documents")
def phrase_match(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.length(T.phrase_tokens("text")).alias("n"), T.matches_phrases(["text"], ["And the"]).alias("has_phrase"))


PHRASES = ("and the", "of the")
HOLDS = "contains(' ' || regexp_replace(lower(text), '[^\\p{L}\\p{M}\\p{N}]+', ' ', 'g').trim() || ' ', ' {0} ')"


@query("SELECT doc_id, source FROM documents WHERE " + " AND ".join(HOLDS.replace("{0}", p) for p in PHRASES))
def phrase_intersection(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return phrases.candidates(lambda p: docs.where(T.contains_phrase("text", p)), "", list(PHRASES), "doc_id").select("doc_id", "source")


@query("WITH w AS (SELECT * FROM documents ORDER BY n_chars DESC, doc_id LIMIT 400), v AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) - 1 AS provider_rank FROM w WHERE " + HOLDS.replace("{0}", "and the") + ") SELECT * FROM v WHERE provider_rank BETWEEN 20 AND 29")
def exact_phrase_batch(spark, sf_dir):
    docs, order = table(spark, sf_dir, "documents"), [F.desc("n_chars"), F.col("doc_id")]
    return phrases.exact_batch(lambda n: docs.orderBy(*order).limit(n), ["text"], ["and the"], order, 20, 10)[0].select("doc_id", "provider_rank")


@query(f"SELECT doc_id, len(list_intersect({FOLD.format('text')}, ['was', 'tion'])) = 2 AS has_all FROM documents")
def all_terms_filter(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.has_all_terms(T.page_terms("text"), "was the tion").alias("has_all"))


@query(f"SELECT doc_id, round(len(list_intersect({TOKENS.format('text')}, ['tion', 'was', 'his'])) / 3.0, 4) AS coverage FROM documents")
def query_coverage(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.round(T.coverage("the tion was his", T.tokens("text")), 4).alias("coverage"))


@query("SELECT page_id, regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', '') AS canonical, regexp_extract(url, '//([^/]*)', 1) LIKE '%.example.com' AS in_domain FROM pages")
def url_canonical(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", T.canonical_url("url").alias("canonical"), T.host_matches(F.parse_url("url", F.lit("HOST")), "example.com").alias("in_domain"))


# Items


@query(
    """SELECT substr(sha1(source || '|' || doc_id || '|' || 'https://images.test/' || doc_id), 1, 16) AS id, source, coalesce(nullif(trim(string_split(text, '.')[1]), ''), 'Untitled') AS title,
    coalesce(nullif(trim(text), ''), lang) AS description, 'unknown' AS license, (doc_id % 7)::INT AS provider_rank FROM documents"""
)
def normalize_items(spark, sf_dir):
    docs = document_items(spark, sf_dir)
    raw = docs.select("source", F.col("doc_id").cast("string").alias("source_id"), "title", F.col("text").alias("description"), F.col("lang").alias("medium"), F.concat(F.lit("https://images.test/"), "doc_id").alias("image_url"), "provider_rank")
    return items.normalize(raw).select("id", "source", "title", "description", "license", "provider_rank")


@query("SELECT * FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) - 1 AS provider_rank FROM documents) WHERE provider_rank BETWEEN 10 AND 19")
def provider_window(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars")
    return items.provider_window(docs, [F.desc("n_chars"), "doc_id"], 10, 10).select("source", "doc_id", F.col("provider_rank").cast("long"))


@query("SELECT min(doc_id) AS doc_id, md5(text) AS key FROM documents GROUP BY text")
def provider_cursor(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.md5("text").alias("key"), "doc_id")
    return items.first_by(docs.withColumn("at", F.col("doc_id")), ["key"], [F.col("at")]).select("doc_id", "key")


@query(
    """SELECT key, arg_min(doc_id, p * 1000000000000 + doc_id) AS doc_id, min(p) AS priority FROM (
    SELECT left(md5(text), 3) AS key, doc_id, 0 AS p FROM documents WHERE lang = 'de' UNION ALL SELECT left(md5(text), 3), doc_id, 1 FROM documents WHERE lang = 'en') GROUP BY key"""
)
def ordered_union(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    part = lambda lang: docs.where(F.col("lang") == lang).select(F.substring(F.md5("text"), 1, 3).alias("key"), "doc_id")
    return items.ordered_union([part("de"), part("en")], ["key"], ["doc_id"])


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 0.0 ELSE o_totalprice END AS price FROM orders WHERE o_orderkey % 3 <> 0 UNION ALL SELECT o_orderkey, -1.0 FROM orders WHERE o_orderkey % 3 = 0")
def catalog_upsert(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    old = orders.select("o_orderkey", F.when(F.col("o_orderkey") % 5 == 0, 0.0).otherwise(F.col("o_totalprice")).alias("price"))
    new = orders.where("o_orderkey % 3 = 0").select("o_orderkey", F.lit(-1.0).alias("price"))
    return items.upsert(old, new, "o_orderkey")


@query("SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN p_size + 100 ELSE p_size % 4 END::INT AS width, CASE WHEN p_size % 4 = 0 THEN p_size + 200 ELSE 7 END::INT AS height FROM part")
def resolve_dimensions(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    base = part.select("p_partkey", (F.col("p_size") % 4).alias("width"), F.lit(7).alias("height"))
    dims = part.select("p_partkey", (F.col("p_size") + 100).alias("width"), (F.col("p_size") + 200).alias("height"))
    return items.resolve_dimensions(base, dims, "p_partkey")


# Scores and rankings


RANK = f"""
i AS ({ITEMS}), t AS (SELECT *, {TOKENS.format('title')} AS tt, {TOKENS.format('text')} AS dt, array_to_string({FOLD.format('title')}, ' ') AS ft, array_to_string({FOLD.format('text')}, ' ') AS fd FROM i),
s AS (SELECT doc_id, provider_rank, source, title, round(CASE WHEN contains(ft, '{QUERY}') THEN 5.0 WHEN contains(fd, '{QUERY}') THEN 2.4 ELSE 0.0 END
 + 4.6 * {COVER.format('tt')} + 2.8 * {COVER.format('dt')} + CASE WHEN {COVER.format('tt')} > 0 THEN 1.1 * len(list_intersect(tt, ['tion'])) / greatest(len(tt), 1) ELSE 0.0 END
 + CASE WHEN list_contains(tt, 'tion') OR list_contains(dt, 'tion') THEN 1.0 ELSE 0.0 END + 1.55 / sqrt(provider_rank + 1.0), 3) AS rank_score FROM t)"""


@query(f"WITH {RANK} SELECT doc_id, rank_score, row_number() OVER (ORDER BY rank_score DESC, provider_rank, doc_id)::INT AS position FROM s QUALIFY position <= 50")
def rank_metadata(spark, sf_dir):
    docs = document_items(spark, sf_dir).select("doc_id", "provider_rank", "source", T.fold_tokens("title").alias("t"), T.fold_tokens("text").alias("d"))
    score = S.metadata_score(QUERY, F.col("t"), F.col("d"), F.col("provider_rank"), F.col("source"), F.lit(""))
    ranked = docs.select("doc_id", "provider_rank", F.round(score, 3).alias("rank_score")).orderBy(F.desc("rank_score"), "provider_rank", "doc_id").limit(50)
    return ranked.select("doc_id", "rank_score", F.row_number().over(Window.orderBy(F.desc("rank_score"), "provider_rank", "doc_id")).alias("position"))


@query("SELECT p_partkey, round(CASE WHEN p_size % 5 > 0 THEN log2((p_size % 5) * (p_partkey % 1000 + 1)) ELSE 0.0 END, 4) AS size_score, round(CASE WHEN p_size % 5 > 0 THEN log2((p_size % 5) * (p_partkey % 1000 + 1)) ELSE 0.0 END * least(greatest(p_retailprice / 2000, 0), 1), 4) AS rank_score FROM part")
def size_scores(spark, sf_dir):
    part = table(spark, sf_dir, "part").withColumns({"w": F.col("p_size") % 5, "h": (F.col("p_partkey") % 1000 + 1).cast("int")})
    none = F.lit(None).cast("double")
    return part.select("p_partkey", F.round(S.size_score(F.col("w"), F.col("h")), 4).alias("size_score"), F.round(S.size_score(F.col("w"), F.col("h")) * S.clamp(F.coalesce(none, F.col("p_retailprice") / 2000)), 4).alias("rank_score"))


def first_vector(vectors: DataFrame, n: int = 0) -> list[float]:
    return vectors.where(F.col("vec_id") == n).first().embedding


@query(
    """WITH q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 0), c AS (SELECT vec_id, list_dot_product(embedding::DOUBLE[], v) AS cosine FROM embeddings, q)
    SELECT vec_id, round(cosine, 4) AS cosine, round(least(greatest((cosine + 0.05) / 0.27, 0), 1), 4) AS semantic_score FROM c"""
)
def semantic_scores(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    cosine = S.dot(F.col("embedding"), S.vector_literal(first_vector(vectors)))
    return vectors.select("vec_id", cosine.alias("c")).select("vec_id", F.round("c", 4).alias("cosine"), F.round(S.clamp((F.col("c") - S.SEMANTIC_LOW) / S.SEMANTIC_SPAN), 4).alias("semantic_score"))


@query(
    """WITH q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 1), x AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 2),
    c AS (SELECT vec_id, list_dot_product(embedding::DOUBLE[], q.v) AS raw, list_dot_product(embedding::DOUBLE[], x.v) AS axis FROM embeddings, q, x),
    m AS (SELECT median(raw) AS mid, greatest((quantile_cont(raw, 0.75) - quantile_cont(raw, 0.25)) / 1.349, 1e-6) AS scale FROM c),
    s AS (SELECT vec_id, raw, 1 / (1 + exp(-least(greatest((raw - mid) / scale, -8), 8))) AS base, 1 / (1 + exp(-least(greatest((axis + 0.0466) / 0.0113, -8), 8))) AS retention FROM c, m)
    SELECT vec_id, round(raw, 4) AS raw_score, round(base, 4) AS base_score, round(retention, 4) AS retention, round(base * retention, 4) AS learned_score FROM s"""
)
def learned_scores(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    raw, axis = (S.dot(F.col("embedding"), S.vector_literal(first_vector(vectors, k))) for k in (1, 2))
    projected = families.stored(vectors.select("vec_id", raw.alias("raw"), axis.alias("axis")))  # two numbers a vector
    low, mid, high = S.quantiles(projected, "raw", [0.25, 0.5, 0.75])
    parts = S.learned_scores(F.col("raw"), mid, max((high - low) / 1.349, 1e-6), F.col("axis"), 4)
    return projected.select("vec_id", *[c.alias(k) for k, c in parts.items()])


@query("WITH q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 0) SELECT vec_id, round(list_dot_product(embedding::DOUBLE[], v), 4) AS similarity FROM embeddings, q WHERE vec_id <> 0 ORDER BY similarity DESC, vec_id LIMIT 16")
def related_items(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return plans.related(vectors.where("vec_id <> 0"), first_vector(vectors), 16).select("vec_id", "similarity")


def with_copies(spark, sf_dir):
    """Vectors and near copies of them, at four distances."""
    base = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))
    a = F.element_at(F.array(*map(F.lit, (0.985, 0.97, 0.96, 0.93))), (F.col("vec_id") % 4 + 1).cast("int"))
    turned = F.concat(F.slice("embedding", 2, 63), F.slice("embedding", 1, 1))
    mixed = base.select((F.col("vec_id") + 1000000).alias("vec_id"), F.zip_with("embedding", turned, lambda x, y: a * x + F.sqrt(1 - a * a) * y).alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    return base.unionByName(mixed.select("vec_id", F.transform("v", lambda x: x / norm).alias("embedding")))


@query(
    """WITH b AS (SELECT vec_id, embedding::DOUBLE[] AS v, [0.985, 0.97, 0.96, 0.93][vec_id % 4 + 1]::DOUBLE AS a FROM embeddings),
    m AS (SELECT vec_id + 1000000 AS vec_id, list_transform(range(1, 65), lambda i: a * v[i] + sqrt(1 - a * a) * v[i % 64 + 1]) AS v FROM b),
    n AS (SELECT vec_id, v FROM b UNION ALL SELECT vec_id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) FROM m),
    p AS (SELECT x.vec_id AS a, y.vec_id AS b, list_dot_product(x.v, y.v) AS c FROM n x JOIN n y ON x.vec_id < y.vec_id)
    SELECT a, b, CASE WHEN c >= 0.98 THEN 1 WHEN c >= 0.965 THEN 2 WHEN c >= 0.955 THEN 3 ELSE 4 END AS tier FROM p WHERE c >= 0.9"""
)
def same_image_pairs(spark, sf_dir):
    pairs = families.image_pairs(with_copies(spark, sf_dir))
    c = F.col("cosine")
    return pairs.select("a", "b", F.when(c >= 0.98, 1).when(c >= 0.965, 2).when(c >= 0.955, 3).otherwise(4).alias("tier"))


@query(
    f"""WITH i AS ({ITEMS}), k AS (SELECT doc_id, array_to_string({FOLD.format('title')}, ' ') AS key FROM i WHERE len({TOKENS.format('title')}) >= 6)
    SELECT min(doc_id) AS doc_id, count(*) - 1 AS duplicate_count FROM k GROUP BY key HAVING count(*) > 1"""
)
def title_families(spark, sf_dir):
    docs = document_items(spark, sf_dir)
    blank = {c: F.lit("") for c in ("work_id", "image_url", "artist", "date", "description")}
    shown = docs.select("doc_id", "source", "title", F.col("doc_id").cast("string").alias("id")).withColumns(blank)
    labels = families.components(families.key_edges(shown, "doc_id"))
    return labels.groupBy("component").agg((F.count("*") - 1).alias("duplicate_count")).select(F.col("component").alias("doc_id"), "duplicate_count")


# Tournament


VOTES = """SELECT user_id % 200 AS left_id, (event_id * 7 + user_id) % 200 AS right_id, CASE event_type WHEN 'click' THEN 'left' WHEN 'view' THEN 'right' WHEN 'purchase' THEN 'tie' ELSE 'no_opinion' END AS choice FROM events"""


def votes(spark, sf_dir):
    """Events as votes between two of 200 items."""
    choice = F.when(F.col("event_type") == "click", "left").when(F.col("event_type") == "view", "right").when(F.col("event_type") == "purchase", "tie").otherwise("no_opinion")
    return table(spark, sf_dir, "events").select((F.col("user_id") % 200).alias("left_id"), ((F.col("event_id") * 7 + F.col("user_id")) % 200).alias("right_id"), choice.alias("choice"))


@query(f"WITH v AS ({VOTES}) SELECT choice, count(*) AS votes FROM v GROUP BY choice")
def tournament_counts(spark, sf_dir):
    return tournament.counts(votes(spark, sf_dir))


VALID = "v.choice <> 'no_opinion' AND left_id <> right_id"


@query(f"WITH v AS ({VOTES}) SELECT least(left_id, right_id) AS a, greatest(left_id, right_id) AS b, count(*) AS meetings FROM v WHERE {VALID} GROUP BY ALL")
def tournament_meetings(spark, sf_dir):
    return tournament.meetings(votes(spark, sf_dir))


@query(
    f"""WITH v AS ({VOTES}), s AS (SELECT left_id AS id, CASE choice WHEN 'left' THEN 1.0 WHEN 'tie' THEN 0.5 ELSE 0 END AS w FROM v WHERE {VALID}
    UNION ALL SELECT right_id, CASE choice WHEN 'right' THEN 1.0 WHEN 'tie' THEN 0.5 ELSE 0 END FROM v WHERE {VALID}) SELECT id, (sum(w) + 0.5)::DOUBLE AS wins FROM s GROUP BY id"""
)
def tournament_wins(spark, sf_dir):
    return tournament.wins(votes(spark, sf_dir))


@query(f"WITH v AS ({VOTES}) SELECT id, count(*) AS shown FROM (SELECT left_id AS id FROM v UNION ALL SELECT right_id FROM v) GROUP BY id")
def tournament_exposure(spark, sf_dir):
    return tournament.exposure(votes(spark, sf_dir))


@query()
def tournament_fit(spark, sf_dir):
    return tournament.fit(votes(spark, sf_dir), spark.range(200))


# Catalogs


@query(
    """WITH i AS (SELECT l_partkey, l_orderkey, l_linenumber, l_quantity, row_number() OVER (PARTITION BY l_partkey ORDER BY (l_returnflag <> 'R')::INT, l_linenumber, l_orderkey) AS k FROM lineitem)
    SELECT p_partkey, p_name, l_orderkey, l_linenumber, l_quantity FROM part JOIN i ON l_partkey = p_partkey WHERE k = 1"""
)
def best_image_join(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")
    best = items.first_by(lines, ["l_partkey"], [(F.col("l_returnflag") != "R").cast("int"), F.col("l_linenumber"), F.col("l_orderkey")])
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    return part.join(best, part.p_partkey == best.l_partkey).select("p_partkey", "p_name", "l_orderkey", "l_linenumber", "l_quantity")


@query(
    f"""WITH d AS (SELECT doc_id, {FOLD.format('text')} AS t, {FOLD.format('lang')} AS l FROM documents), f AS (SELECT doc_id, len(t) + len(l) AS size, 8.0 * len([x FOR x IN t IF x = 'was']) AS f0, 8.0 * len([x FOR x IN t IF x = 'tion']) AS f1 FROM d),
    a AS (SELECT count(*) AS n, avg(size) AS av, count(*) FILTER (f0 > 0) AS n0, count(*) FILTER (f1 > 0) AS n1 FROM f),
    w AS (SELECT *, ln((n - n0 + 0.5) / (n0 + 0.5)) AS i0, ln((n - n1 + 0.5) / (n1 + 0.5)) AS i1 FROM a)
    SELECT doc_id, round(-(CASE WHEN i0 > 0 THEN i0 ELSE 1e-6 END) * f0 * 2.2 / (f0 + 1.2 * (0.25 + 0.75 * size / av)) - (CASE WHEN i1 > 0 THEN i1 ELSE 1e-6 END) * f1 * 2.2 / (f1 + 1.2 * (0.25 + 0.75 * size / av)), 4) AS score FROM f, w WHERE f0 > 0 AND f1 > 0"""
)
def catalog_bm25(spark, sf_dir):
    found = catalog.bm25(table(spark, sf_dir, "documents"), "doc_id", {"text": 8.0, "lang": 0.1}, "was tion")
    return found.select("doc_id", F.round("score", 4).alias("score"))


WORDS = "regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}\\p{{M}}]+')"
FOUND_WORDS = ("tion", "was")
PLACES = lambda words, w: f"[i FOR i IN range(1, len({words}) + 1) IF {words}[i] = '{w}']"
NEAR = lambda words: f"len([i FOR i IN {PLACES(words, FOUND_WORDS[0])} IF len([j FOR j IN {PLACES(words, FOUND_WORDS[1])} IF abs(i - j) <= 12]) > 0]) > 0"
BARE_COUNT = lambda words, w: f"len([x FOR x IN {words} IF strip_accents(x) = '{w}'])"
BARE_SUM = lambda w: " + ".join(f"{weight} * {BARE_COUNT(field, w)}" for field, weight in (("t", 8.0), ("a", 2.0), ("m", 0.25), ("d", 3.0)))


@query(
    f"""WITH i AS ({ITEMS}), w AS (SELECT doc_id, {WORDS.format('title')} AS t, {WORDS.format('source')} AS a, {WORDS.format('lang')} AS m, {WORDS.format('text')} AS d FROM i),
    f AS (SELECT doc_id, len(t) + len(a) + len(m) + len(d) AS size, {BARE_SUM('tion')} AS f0, {BARE_SUM('was')} AS f1, ({NEAR('t')}) OR ({NEAR('d')}) AS focus FROM w),
    a AS (SELECT count(*) AS n, sum(size) / count(*) AS av, count(*) FILTER (f0 > 0) AS n0, count(*) FILTER (f1 > 0) AS n1 FROM f),
    k AS (SELECT *, ln((n - n0 + 0.5) / (n0 + 0.5)) AS i0, ln((n - n1 + 0.5) / (n1 + 0.5)) AS i1 FROM a),
    s AS (SELECT doc_id, focus, round(-(CASE WHEN i0 > 0 THEN i0 ELSE 1e-6 END) * f0 * 2.2 / (f0 + 1.2 * (0.25 + 0.75 * size / av)) - (CASE WHEN i1 > 0 THEN i1 ELSE 1e-6 END) * f1 * 2.2 / (f1 + 1.2 * (0.25 + 0.75 * size / av)), 6) AS score FROM f, k WHERE f0 > 0 AND f1 > 0),
    l AS (SELECT * FROM s ORDER BY score, doc_id LIMIT 2000)
    SELECT doc_id, score, (row_number() OVER (ORDER BY score, doc_id) - 1)::INT AS position FROM l WHERE focus ORDER BY score, doc_id LIMIT 100"""
)
def catalog_search(spark, sf_dir):
    """Documents indexed in two segments, of which the second replaces rows of the first, and searched in one call."""
    works = document_items(spark, sf_dir).select("doc_id", "title", F.col("source").alias("artist"), F.col("lang").alias("medium"), F.col("text").alias("description"))
    index = postings.Index(spark, f"{families.shared_folder(spark)}/index-{uuid.uuid4().hex}", "doc_id", ["title", "artist", "medium", "description"], buckets=16)
    later = F.col("doc_id") % 5 == 0
    index.add(works.withColumn("description", F.when(later, "stale tion was").otherwise(F.col("description"))))
    index.add(works.where(later))
    return postings.search(index, " ".join(FOUND_WORDS), 50).select("doc_id", "score", "position")


@query(
    f"""WITH t AS (SELECT doc_id, unnest({FOLD.format('text')}) AS w, generate_subscripts({FOLD.format('text')}, 1) AS i FROM documents), a AS (SELECT * FROM t WHERE w = 'tion'), b AS (SELECT * FROM t WHERE w = 'was')
    SELECT DISTINCT a.doc_id FROM a JOIN b ON a.doc_id = b.doc_id AND abs(a.i - b.i) <= 12"""
)
def focus_policy(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(catalog.terms_are_close(T.fold_tokens("text"), ["tion", "was"])).select("doc_id")


@query()
def fuzzy_search(spark, sf_dir):
    docs = document_items(spark, sf_dir).select("doc_id", F.col("title"), F.col("lang").alias("keywords"))
    return catalog.fuzzy_search(docs, "doc_id", ["title", "keywords"], "ontion theatn", 20)


@query("SELECT 'incremental' AS action, count(*) AS n, max(o_orderdate) AS latest FROM orders")
def catalog_refresh(spark, sf_dir):
    full = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    action, out = catalog.refresh(full.where("o_orderkey % 4 <> 0"), full.where("o_orderkey % 4 = 0"), full, "o_orderkey", "o_orderdate")
    return out.agg(F.count("*").alias("n"), F.max("o_orderdate").alias("latest")).select(F.lit(action).alias("action"), "n", "latest")


# Staged search


STAGED = "SELECT [4, 9, 16, 25][l_linenumber % 4 + 1] AS stage, l_orderkey AS stage_rank, l_partkey AS key, (l_quantity * 100)::INT AS width, (l_partkey % 3000 + 1)::INT AS height FROM lineitem"


@query(
    f"""WITH r AS ({STAGED}), m AS (SELECT key, max(width::BIGINT * height) AS pixels, min(stage * 100000000000 + stage_rank) AS f, count(DISTINCT stage) AS n_stages FROM r GROUP BY key),
    d AS (SELECT *, f // 100000000000 AS stage, row_number() OVER (ORDER BY f // 100000000000, f % 100000000000, key) - 1 AS discovery, count(*) OVER () AS total FROM m)
    SELECT key, pixels, stage::INT AS stage, discovery, n_stages::INT AS n_stages, round((total - discovery) * log2(greatest(pixels, 1)), 4) AS final_score FROM d ORDER BY final_score DESC, discovery LIMIT 100"""
)
def staged_rank(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    stage = F.element_at(F.array(*map(F.lit, staged.STAGES)), (F.col("l_linenumber") % 4 + 1).cast("int"))
    rows = lines.select(stage.alias("stage"), F.col("l_orderkey").alias("stage_rank"), F.col("l_partkey").alias("key"), (F.col("l_quantity") * 100).cast("int").alias("width"), (F.col("l_partkey") % 3000 + 1).cast("int").alias("height"))
    return staged.rank(rows, 100).select("key", "pixels", "stage", "discovery", "n_stages", "final_score")


# Evidence and pages


@query()
def evidence_excerpts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", evidence.excerpts("tion was", 300)("text").alias("excerpt"))


@query(f"SELECT doc_id, len([x FOR x IN {FOLD.format('text')} IF x = 'was'])::INT AS marked, len([x FOR x IN {FOLD.format('text')} IF starts_with(x, 'th')])::INT AS begun FROM documents")
def highlight_segments(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", evidence.highlighted("was")("text").alias("marked"), evidence.highlighted("th", "prefix")("text").alias("begun"))


@query("SELECT page_id, (len(regexp_extract_all(html, '<a '))::INT) AS n_links, 0 AS n_images FROM pages")
def page_scan(spark, sf_dir):
    return html.page_facts(table(spark, sf_dir, "pages")).select("page_id", "n_links", "n_images")


@query("SELECT page_id, substr(sha1(url || chr(31) || page_id), 1, 20) AS key FROM pages")
def cache_keys(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", html.key_of("url", F.col("page_id").cast("string")).alias("key"))


# Sessions


STATE = """SELECT event_id, event_id % 11 <> 0 AS selected, CASE WHEN event_id % 13 = 0 THEN 'stop' END AS stop_reason, ['idle', 'fetching', 'idle', 'scoring', 'idle'][event_id % 5 + 1] AS stage, event_id % 4 AS rounds, event_id % 6 = 0 AS exhausted,
 event_id % 7 <> 0 AS scoring_done, event_id % 3 AS failed_scores, event_id % 17 = 0 AS dirty, (event_id % 19 = 0)::INT AS pending, user_id % 12 AS latest, user_id % 3 AS top_hits, event_id % 2 = 0 AS complete FROM events"""


@query(
    f"""WITH s AS ({STATE}), n AS (SELECT *, CASE WHEN NOT selected THEN 'hidden' WHEN stop_reason IS NOT NULL THEN 'failed' WHEN stage IN ('fetching', 'scoring', 'evaluating') THEN stage WHEN rounds = 0 THEN 'queued'
    WHEN exhausted AND scoring_done AND failed_scores > 0 THEN 'incomplete' WHEN exhausted THEN 'finished' WHEN NOT scoring_done OR dirty OR pending > 0 THEN 'evaluating' WHEN latest < 10 THEN 'queued'
    WHEN failed_scores > 0 AND top_hits = 0 THEN 'incomplete' WHEN top_hits > 0 THEN 'queued' WHEN complete THEN 'finished' ELSE 'paused' END AS next_stage FROM s)
    SELECT event_id, next_stage = 'queued' AS continues, next_stage, next_stage IN ('failed', 'incomplete') AS retryable FROM n"""
)
def continuation_policy(spark, sf_dir):
    e, u = F.col("event_id"), F.col("user_id")
    state = table(spark, sf_dir, "events").select(
        "event_id", (e % 11 != 0).alias("selected"), F.when(e % 13 == 0, "stop").alias("stop_reason"), F.element_at(F.array(*map(F.lit, ("idle", "fetching", "idle", "scoring", "idle"))), (e % 5 + 1).cast("int")).alias("stage"), (e % 4).alias("rounds"),
        (e % 6 == 0).alias("exhausted"), (e % 7 != 0).alias("scoring_done"), (e % 3).alias("failed_scores"), (e % 17 == 0).alias("dirty"), (e % 19 == 0).cast("int").alias("pending"), (u % 12).alias("latest"), (u % 3).alias("top_hits"), (e % 2 == 0).alias("complete"),
    )
    return state.select("event_id", *[c.alias(k) for k, c in session.continuation().items()])


@query(
    """WITH b AS (SELECT o_custkey AS source, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) * 10 + CASE WHEN o_orderkey % 29 = 0 THEN 3 ELSE 0 END AS "offset", 10 AS n FROM orders),
    e AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY source ORDER BY "offset" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS expected FROM b), g AS (SELECT *, min(("offset" = expected)::INT) OVER (PARTITION BY source ORDER BY "offset") AS good FROM e)
    SELECT source, count(*) AS batches, max("offset") AS last_offset FROM g WHERE good = 1 GROUP BY source"""
)
def merge_batches(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    at = (F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1) * 10 + F.when(F.col("o_orderkey") % 29 == 0, 3).otherwise(0)
    batches = orders.select(F.col("o_custkey").alias("source"), at.cast("long").alias("offset"), F.lit(10).alias("n"), F.col("o_orderkey").alias("arrival"))
    return session.merge_in_order(batches).groupBy("source").agg(F.count("*").alias("batches"), F.max("offset").alias("last_offset"))


@query(
    """WITH o AS (SELECT o_custkey AS id, row_number() OVER (ORDER BY sum(o_totalprice) DESC, o_custkey) AS position FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1), n AS (SELECT o_custkey AS id, row_number() OVER (ORDER BY sum(o_totalprice) DESC, o_custkey) AS position FROM orders GROUP BY 1)
    SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'insert' WHEN b.id IS NULL THEN 'remove' WHEN a.position <> b.position THEN 'move' ELSE 'retain' END AS change FROM (SELECT * FROM o WHERE position <= 50) a FULL JOIN (SELECT * FROM n WHERE position <= 50) b ON a.id = b.id"""
)
def snapshot_changes(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")

    def top(rows):
        sums = rows.groupBy(F.col("o_custkey").alias("id")).agg(F.sum("o_totalprice").alias("v")).orderBy(F.desc("v"), "id").limit(50)
        return sums.select("id", F.row_number().over(Window.orderBy(F.desc("v"), "id")).alias("position"))

    return session.snapshot_changes(top(orders.where("o_orderkey % 2 = 0")), top(orders)).select("id", "change")


@query("SELECT source, count(*) AS n, count(*) FILTER (lang = 'en') AS scored FROM documents GROUP BY source")
def scored_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("lang") == "en").alias("scored"))


@query("SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k <= 10")
def latest_ten(spark, sf_dir):
    newest = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return table(spark, sf_dir, "events").withColumn("k", F.row_number().over(newest)).where("k <= 10").select("user_id", "event_id")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def windowed_events(spark, sf_dir):
    return session.windowed_counts(table(spark, sf_dir, "events")).select("start", "event_type", "n", F.round("total", 2).alias("total"))


@query(ORACLES["windowed_events"])
def stream_windowed_events(spark, sf_dir):
    """The same by a stream of five files, ranked again after every third and at the end; the last result read back."""
    events = table(spark, sf_dir, "events")
    folder = f"{families.shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    for k in range(5):
        events.where(F.pmod(F.xxhash64("event_id"), F.lit(5)) == k).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    session.stream_items(stream, session.windowed_counts, folder, f"{folder}/checkpoint", every=3).awaitTermination()
    return session.last_ranking(spark, folder).select("start", "event_type", "n", F.round("total", 2).alias("total"))


def told_sessions(spark, sf_dir):
    """(told rows, answers) of users as live sessions and event types as their sources, which answer in batches of ten. The stream
    runs three times, each time from where its checkpoint left it."""
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    own = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    rows = events.withColumns({"k": F.row_number().over(own) - 1, "n": F.count("*").over(Window.partitionBy("user_id", "event_type"))})
    session_of = F.concat(F.lit("u"), "user_id").alias("session")
    answers = rows.groupBy(session_of, F.col("event_type").alias("source"), F.floor(F.col("k") / keyed.BATCH).alias("b"), "n").agg(F.max("ts").alias("at"), F.collect_list(F.struct("k", F.col("event_id").cast("string").alias("id"), "value")).alias("rows"))
    answers = answers.select("session", "at", F.lit("batch").alias("kind"), "source", (F.col("b") * keyed.BATCH).alias("offset"), (F.col("b") * keyed.BATCH + F.size("rows") == F.col("n")).alias("exhausted"), F.lit(None).cast("string").alias("reason"), F.array_sort("rows")["id"].alias("ids"), F.array_sort("rows")["value"].alias("scores"))
    starts = events.groupBy(session_of).agg((F.min("ts") - F.expr("INTERVAL 1 SECOND")).alias("at"), F.array_sort(F.collect_set("event_type")).alias("ids"))
    starts = starts.select("session", "at", F.lit("start").alias("kind"), F.lit(None).cast("string").alias("source"), F.lit(None).cast("long").alias("offset"), F.lit(False).alias("exhausted"), F.lit(None).cast("string").alias("reason"), "ids", F.lit(None).cast("array<double>").alias("scores"))
    told = families.stored(starts.unionByName(answers))
    folder = f"{families.shared_folder(spark)}/sessions-{uuid.uuid4().hex}"
    place = F.coalesce(F.floor(F.col("offset") / (2 * keyed.BATCH)), F.lit(0))
    for k in range(3):  # the first two batches of all sources, the next two, and the rest
        told.where(place == k if k < 2 else place >= k).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(told.schema).parquet(f"{folder}/in")
        with keyed.state_store(spark):
            keyed.start(stream, f"{folder}/out", f"{folder}/checkpoint", late="60 days").awaitTermination()
    return spark.read.parquet(f"{folder}/out"), answers


@query(
    """WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id::VARCHAR) AS k FROM events)
    SELECT 'u' || user_id AS session, count(*) AS items, string_agg(event_id::VARCHAR, ' ' ORDER BY k) FILTER (k <= 50) AS best, true AS complete FROM r GROUP BY user_id"""
)
def session_stream(spark, sf_dir):
    """The last snapshot of each session's told rows."""
    told, answers = told_sessions(spark, sf_dir)
    last = keyed.last_snapshots(told)
    found = answers.groupBy("session").agg(F.sum(F.size("ids")).alias("items"))
    return last.join(found, "session").select("session", "items", F.array_join("ids", " ").alias("best"), "complete")


@query("SELECT 'u' || user_id AS session, least(count(*), 50)::INT AS most_visible, 0 AS failures, 0 AS retries FROM events GROUP BY user_id")
def session_trace(spark, sf_dir):
    """The same sessions' traces as lines of JSON, read back and counted."""
    told, _ = told_sessions(spark, sf_dir)
    path = f"{families.shared_folder(spark)}/trace-{uuid.uuid4().hex}"
    keyed.trace(told).write.json(path)
    lines = spark.read.schema("session string, event string, elapsed double, revision long, results int").json(path)
    return keyed.metrics(lines).select("session", "most_visible", F.col("failures").cast("int").alias("failures"), F.col("retries").cast("int").alias("retries"))


@query(
    """SELECT p_partkey::VARCHAR AS source_id, p_name AS title, CASE WHEN p_size < 20 THEN 'first' ELSE 'second' END || p_partkey AS image_url, CASE WHEN p_size < 20 THEN 100 ELSE 200 END::INT AS width, 'artist' || p_brand AS artist FROM part WHERE p_size % 3 = 0"""
)
def provider_records(spark, sf_dir):
    """Payloads of a museum's records, read back as items."""
    part = table(spark, sf_dir, "part")
    image = lambda name, order, width: F.struct(F.concat(F.lit(name), "p_partkey").alias("baseimageurl"), order.alias("displayorder"), F.lit(width).alias("width"), F.lit(50).alias("height"))
    person = lambda prefix, role: F.struct(F.concat(F.lit(prefix), "p_brand").alias("name"), F.lit(role).alias("role"))
    record = F.struct(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), (F.col("p_size") % 3).alias("imagepermissionlevel"),
        F.array(image("second", F.lit(20), 200), image("first", F.col("p_size"), 100)).alias("images"), F.array(person("maker", "Maker"), person("artist", "Artist")).alias("people"),
    )
    payloads = part.select(F.to_json(F.struct(F.array(record).alias("records"))).alias("payload"))
    return providers.museum_records(payloads).select("source_id", "title", "image_url", "width", "artist")


# Relational baseline; no counterpart in the system this engine follows


@query(
    """SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 4) AS avg_discount, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL"""
)
def base_pricing(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    return lines.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 4).alias("avg_discount"), F.count("*").alias("n"))


@query(
    """SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey AND s_nationkey = c_nationkey
    JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY n_name"""
)
def base_local_suppliers(spark, sf_dir):
    t = lambda name: table(spark, sf_dir, name)
    lines = t("lineitem").select("l_orderkey", "l_suppkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("v"))
    joined = lines.join(t("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    local = joined.join(t("supplier").select("s_suppkey", "s_nationkey"), (F.col("l_suppkey") == F.col("s_suppkey")) & (F.col("s_nationkey") == F.col("c_nationkey")))
    return local.join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.round(F.sum("v"), 2).alias("revenue"))


@query("SELECT coalesce(p_brand, 'all') AS brand, coalesce(p_type, 'all') AS type, count(*) AS n, grouping_id(p_brand, p_type) AS g FROM part GROUP BY CUBE (p_brand, p_type)")
def base_cube(spark, sf_dir):
    cube = table(spark, sf_dir, "part").cube("p_brand", "p_type").agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    return cube.select(F.coalesce("p_brand", F.lit("all")).alias("brand"), F.coalesce("p_type", F.lit("all")).alias("type"), "n", "g")


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def base_anti(spark, sf_dir):
    customer, orders = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    return customer.join(orders, customer.c_custkey == orders.o_custkey, "left_anti").select("c_custkey", "c_name")


@query("SELECT user_id, event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS moving FROM events")
def base_moving_sum(spark, sf_dir):
    own = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-2, 0)
    return table(spark, sf_dir, "events").select("user_id", "event_id", F.round(F.sum("value").over(own), 4).alias("moving"))
