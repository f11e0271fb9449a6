"""A stored inverted index: postings dealt by token into bucket folders, grown by segments, searched by reading a query's buckets.

`postings/segment=s/bucket=b` has a row a word: its token, its row's key, its field, and where it stands there. A bucket is chosen
by a token's first two characters, so that a token and all that begin with it lie together, and a bucket's files are sorted by
token, so that Parquet's statistics prune within them. `rows/segment=s/bucket=b` keeps the indexed rows themselves, dealt by key,
for the few that a search returns. `segments` has a row a segment: how many live rows and words there are with it, and the rows'
columns. A segment's rows replace those of earlier segments with the same key. A segment that isn't named in `segments` isn't
there, so a writer that dies leaves nothing half seen, and one that repeats writes its segment again."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType

from ..functions import text as T

K1, B = 1.2, 0.75
BUCKETS = 64
ROWS_A_PART = 20_000  # indexed rows; a bucket is written in as many parts as hold so many, so that no task has a whole one
REACH = 12
# The fields of a catalog with their weights, those that can carry a query of several words, and concepts that
# stand for words of a query.
WEIGHTS = {"title": 8.0, "artist": 2.0, "date": 0.1, "medium": 0.25, "classification": 0.5, "description": 3.0}
STRONG = ("title", "artist", "description")
ALIASES = {("rose", "cross"): ("rosicrucian",)}
NAMES = "segment int, live long, words long, columns string"
_LETTERS = r"([\p{L}\p{N}\p{M}\p{Co}]+)"


def _bucket(start: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.substring(start, 1, 2)), F.lit(buckets)).cast("int")


def _key_bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key.cast("string")), F.lit(buckets)).cast("int")


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(_LETTERS), F.lit(1))


def tokens(text: Column) -> Column:
    """(token, exact, at) of each word of any script: without marks as it is looked up, and as it is written, lower-case."""
    bare = lambda w: F.when(F.octet_length(w) == F.length(w), w).otherwise(F.lower(F.translate(w, T.ACCENTED + T.MARKS, T.PLAIN)))
    return F.transform(_words(text), lambda w, i: F.struct(bare(w).alias("token"), w.alias("exact"), i.alias("at")))


def postings(rows: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(token, exact, key, field, at, size) of each word; `size` is the row's number of words over all fields."""
    split = rows.select(F.col(key).alias("key"), F.array(*[F.struct(F.lit(f).alias("field"), tokens(F.col(f).cast("string")).alias("words")) for f in fields]).alias("f"))
    sized = split.select("key", F.aggregate("f", F.lit(0), lambda s, x: s + F.size(x["words"])).alias("size"), F.explode("f").alias("f"))
    return sized.select("key", "size", "f.field", F.explode("f.words").alias("w")).select("w.token", "w.exact", "key", "field", "w.at", "size")


class Index:
    """An index in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, folder: str, key: str, fields: list[str], buckets: int = BUCKETS):
        self.spark, self.folder, self.key, self.fields, self.buckets = spark, folder.rstrip("/"), key, fields, buckets

    def segments(self) -> list:
        """The named segments (segment, live, words), oldest first; as many as there were additions since the last build."""
        try:
            return self.spark.read.schema(NAMES).json(f"{self.folder}/segments").orderBy("segment").collect()
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return []
            raise

    def _read(self, kind: str, segments: list) -> DataFrame:
        base, rows = f"{self.folder}/{kind}", StructType.fromJson(json.loads(segments[-1].columns))
        own = DataType.fromDDL(f"token string, exact string, key {rows[self.key].dataType.simpleString()}, field string, at int, size int")
        schema = (rows if kind == "rows" else own).add("segment", "integer").add("bucket", "integer")
        return self.spark.read.schema(schema).option("basePath", base).parquet(*[f"{base}/segment={s.segment}" for s in segments])

    def add(self, rows: DataFrame) -> int:
        """Indexes rows (key and fields, and what else is to be returned with them) as a new segment; only these are read and
        tokenised. Rows replace indexed ones of the same key; a key comes once in `rows`, and a row without a key has none.
        Returns the segment's number."""
        named = self.segments()
        number = named[-1].segment + 1 if named else 0
        rows = rows.where(F.col(self.key).isNotNull())
        n = rows.count()
        parts = lambda key: F.pmod(F.xxhash64(F.lit("part"), key), F.lit(n // ROWS_A_PART + 1))  # noqa: E731  apart from the buckets' hash
        dealt = postings(rows, self.key, self.fields).withColumn("bucket", _bucket(F.col("token"), self.buckets))
        dealt.repartition(F.col("bucket"), parts("key")).sortWithinPartitions("bucket", "token", "key").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/postings/segment={number}")
        kept = rows.withColumns({"__size": reduce(lambda a, b: a + b, [F.size(_words(F.col(f).cast("string"))) for f in self.fields]), "bucket": _key_bucket(F.col(self.key), self.buckets)})
        kept.repartition(F.col("bucket"), parts(self.key)).sortWithinPartitions("bucket", self.key).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/rows/segment={number}")
        columns = kept.drop("bucket").schema.json()
        new = self._read("rows", [Row(segment=number, columns=columns)]).select(self.key, "bucket", "__size")
        added = new.agg(F.count("*").alias("n"), F.coalesce(F.sum("__size"), F.lit(0)).alias("words")).first()
        live, words = (named[-1].live, named[-1].words) if named else (0, 0)
        if named:
            gone = self.live_rows(named).select(self.key, "bucket", "__size").join(new.select(self.key, "bucket"), [self.key, "bucket"], "left_semi")
            lost = gone.agg(F.count("*").alias("n"), F.coalesce(F.sum("__size"), F.lit(0)).alias("words")).first()
            live, words = live - lost.n, words - lost.words
        self.spark.createDataFrame([(number, live + added.n, words + added.words, columns)], NAMES).coalesce(1).write.mode("append").json(f"{self.folder}/segments")
        return number

    def live_rows(self, segments: list | None = None) -> DataFrame:
        """The rows of all segments that no later one replaces."""
        named = self.segments() if segments is None else segments
        return self._live(self._read("rows", named), self.key, named)

    def _live(self, df: DataFrame, key: str, named: list) -> DataFrame:
        if len(named) == 1:
            return df
        later = self._read("rows", named[1:]).select(F.col(self.key).alias("__key"), F.col("segment").alias("__later"))
        return df.join(later, (F.col(key) == F.col("__key")) & (F.col("segment") < F.col("__later")), "left_anti")

    def compact(self, into: str) -> Index:
        """A new index of one segment in another folder, of the live rows."""
        out = Index(self.spark, into, self.key, self.fields, self.buckets)
        out.add(self.live_rows().drop("__size", "bucket", "segment"))
        return out


@dataclass(frozen=True)
class Unit:
    """What a query counts in a row: words that follow each other in a field; the last can be the beginning of one."""

    words: tuple[str, ...]
    prefix: bool = False


@dataclass(frozen=True)
class Query:
    """Units of which all or any must occur, and the words that one strong field must support."""

    units: tuple[Unit, ...]
    every: bool
    terms: tuple[str, ...]
    aliases: tuple[str, ...] = ()


def parse(query: str, aliases: dict[tuple[str, ...], tuple[str, ...]] = ALIASES) -> Query:
    """One word is met by all that begin with it, several by rows that hold each of them whole; a concept's words are met by
    its aliases, as beginnings, or by its phrase."""
    terms = tuple(t for t in T.word_tokens_py(query) if len(t) > 1)
    known = aliases.get(terms, ())
    if known:
        return Query((*(Unit((T.bare_py(a),), True) for a in known), Unit(tuple(map(T.bare_py, terms)))), False, terms, known)
    if len(terms) == 1:
        return Query((Unit((T.bare_py(terms[0]),), True),), True, terms)
    return Query(tuple(Unit((T.bare_py(t),)) for t in terms), True, terms)


def _meets(unit: Unit, at: int) -> Column:
    """Whether a posting is the unit's word `at`."""
    word, begins = unit.words[at], unit.prefix and at == len(unit.words) - 1
    return F.col("token").startswith(word) if begins else F.col("token") == word


def _shifted(places: Column, by: int) -> Column:
    return F.transform(places, lambda p: p - by)


def hits(index: Index, query: Query, weights: dict[str, float] = WEIGHTS, strong: tuple[str, ...] = STRONG) -> DataFrame:
    """(key, score, focused) of the rows that a query meets, by BM25 over weighted fields (lower is better), and whether one
    strong field alone supports it. Only the buckets of the query's words are read, and of them only these words."""
    named = index.segments()
    words = [(i, j) for i, u in enumerate(query.units) for j in range(len(u.words))]
    wanted = sorted({(u.words[j], u.prefix and j == len(u.words) - 1) for u in query.units for j in range(len(u.words))})
    spark = index.spark
    buckets = sorted({r[0] for r in spark.createDataFrame([(w,) for w, _ in wanted], "w string").select(_bucket(F.col("w"), index.buckets)).collect()})  # a few words
    here = reduce(lambda a, b: a | b, [F.col("token").startswith(w) if begins else F.col("token") == w for w, begins in wanted])
    found = index._live(index._read("postings", named).where(F.col("bucket").isin(buckets) & here), "key", named)
    # all that is gathered below lies in one field of one row
    places = [F.collect_list(F.when(_meets(query.units[i], j), F.col("at"))).alias(f"u{i}_{j}") for i, j in words]
    exact = [F.collect_list(F.when(F.col("exact") == t, F.col("at"))).alias(f"t{k}") for k, t in enumerate(query.terms)]
    starts = [F.max(F.col("exact").startswith(a)).alias(f"a{k}") for k, a in enumerate(query.aliases)]
    fields = found.groupBy("key", "size", "field").agg(*places, *exact, *starts)

    def occurrences(i: int) -> Column:
        """Places where all words of a unit follow each other."""
        shifted = [_shifted(F.col(f"u{i}_{j}"), j) for j in range(len(query.units[i].words))]
        return F.size(reduce(F.array_intersect, shifted)) if len(shifted) > 1 else F.size(shifted[0])

    weight = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]), F.col("field")), F.lit(1.0))
    counted = fields.select("key", "size", *[(weight * occurrences(i)).alias(f"f{i}") for i in range(len(query.units))], _supports(query, strong).alias("focus"))
    every = [F.col(f"f{i}") > 0 for i in range(len(query.units))]
    rows = counted.groupBy("key", "size").agg(*[F.sum(f"f{i}").alias(f"f{i}") for i in range(len(query.units))], F.max("focus").alias("focus"))
    rows = rows.where(reduce(lambda a, b: a | b, every))
    last = named[-1]
    met = rows.agg(*[F.count_if(c).alias(f"n{i}") for i, c in enumerate(every)]).first()
    score, average = F.lit(0.0), last.words / max(last.live, 1)
    for i in range(len(query.units)):
        n = met[f"n{i}"]
        idf = math.log((last.live - n + 0.5) / (n + 0.5))
        f = F.col(f"f{i}")
        score = score - (idf if idf > 0 else 1e-6) * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("size") / F.lit(average)))
    holds = reduce(lambda a, b: a & b, every) if query.every else F.lit(True)
    return rows.where(holds).select("key", score.alias("score"), F.coalesce("focus", F.lit(False)).alias("focused"))


def _supports(query: Query, strong: tuple[str, ...]) -> Column:
    """Whether a strong field carries a query of several words: all of them near an occurrence of the first, or an alias or the
    phrase. A single word needs no support."""
    if len(query.terms) <= 1:
        return F.lit(True)
    places, own = [F.col(f"t{k}") for k in range(len(query.terms))], F.col("field").isin(*strong)
    if query.aliases:
        shifted = [_shifted(p, k) for k, p in enumerate(places)]
        return own & reduce(lambda a, b: a | b, [F.coalesce(f"a{k}", F.lit(False)) for k in range(len(query.aliases))], F.size(reduce(F.array_intersect, shifted)) > 0)
    near = lambda at: reduce(lambda a, b: a & b, [F.exists(p, lambda x: F.abs(x - at) <= REACH) for p in places[1:]])
    return own & F.exists(places[0], near)


def search(index: Index, query: str, need: int, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """The indexed rows that a query finds, with score and position: the best by BM25 are looked through for those that one
    strong field supports, and twice as many as needed come back. A query without words of two letters finds nothing."""
    parsed = parse(query)
    target = max(need * 2, 20)
    scanned = min(max(target * 20, 400), 5000)
    named = index.segments()
    if not named:
        raise FileNotFoundError(f"{index.folder} has no index yet")
    if not parsed.terms:
        return index.live_rows(named).where("false").drop("__size", "bucket", "segment").withColumns({"score": F.lit(0.0), "position": F.lit(0)})
    best = hits(index, parsed, weights).withColumn("score", F.round("score", 6)).orderBy("score", "key").limit(scanned).where("focused").orderBy("score", "key").limit(target)
    chosen = best.collect()  # `target` rows of a key and a number
    rows = index.live_rows(named)
    kind = rows.schema[index.key].dataType
    places = {r.bucket for r in index.spark.createDataFrame([(c.key,) for c in chosen] or [(None,)], f"key {kind.simpleString()}").select(_key_bucket(F.col("key"), index.buckets).alias("bucket")).collect()}
    scores = index.spark.createDataFrame([(c.key, c.score, k) for k, c in enumerate(chosen)], f"`{index.key}` {kind.simpleString()}, score double, position int")
    there = rows.where(F.col("bucket").isin([p for p in places if p is not None]) & F.col(index.key).isin([c.key for c in chosen]))
    return there.drop("__size", "bucket", "segment").join(F.broadcast(scores), index.key)  # broadcast: `target` rows
