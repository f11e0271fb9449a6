"""Paged sources: Python data sources that read a provider page by page, by offsets or by continuation tokens, and identities
across pages."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

from ..functions.text import matches_phrases
from ..operators.families import components, stored

Fetch = Callable[[int, int], tuple[list, int]]


def pages(fetch: Fetch, start: int, need: int) -> Iterator:
    """Rows of fetch(offset, n) -> (rows, next offset) until `need` rows or an offset that ends; an offset that doesn't
    advance is an error, as it would never end."""
    at, left = start, need
    while left > 0:
        rows, following = fetch(at, left)
        yield from rows[:left]
        left -= len(rows)
        if following < 0 or not rows:
            return
        if following <= at:
            raise ValueError(f"a page at {at} leads back to {following}")
        at = following


class Span(InputPartition):
    def __init__(self, start: int, size: int):
        self.start, self.size = start, size


class Reader(DataSourceReader):
    def __init__(self, fetch: Fetch, total: int, span: int):
        self.fetch, self.total, self.span = fetch, total, span

    def partitions(self):
        return [Span(at, min(self.span, self.total - at)) for at in range(0, self.total, self.span)]

    def read(self, partition):
        yield from pages(self.fetch, partition.start, partition.size)


def read_paged(spark: SparkSession, name: str, schema: str, fetch: Fetch, total: int, span: int = 1000) -> DataFrame:
    """`total` rows of a provider; each task reads its own span of offsets, so a lost executor costs a span."""
    kind, called, made = schema, name, (fetch, total, span)

    class Paged(DataSource):
        @classmethod
        def name(cls):
            return called

        def schema(self):
            return kind

        def reader(self, schema):
            return Reader(*made)

    spark.dataSource.register(Paged)
    return spark.read.format(name).load()


# Pages by continuation tokens

TokenFetch = Callable[[str, str], tuple[list, str | None]]
END = "\x00end"


def followed(fetch: TokenFetch, chain: str, need: int, token: str = "") -> Iterator[tuple[int, tuple]]:
    """(ordinal, row) of fetch(chain, token) -> (rows, next token or None), page after page, up to `need` rows. A token that
    came before is an error, as it would never end."""
    n, seen = 0, set()
    while n < need:
        if token in seen:
            raise ValueError(f"{chain}: a page leads back to the token {token!r}")
        seen.add(token)
        rows, following = fetch(chain, token)
        for row in rows[: need - n]:
            yield n, tuple(row)
            n += 1
        if following is None:
            return
        token = following


class Chain(InputPartition):
    def __init__(self, name: str):
        self.name = name


def read_chains(spark: SparkSession, name: str, schema: str, fetch: TokenFetch, chains: list[str], need: int) -> DataFrame:
    """(chain, ordinal, ...) of chains of pages, each followed by a task of its own, as only a page says where the next is; a
    lost executor costs its chains."""
    kind, called, made = f"chain string, ordinal long, {schema}", name, (fetch, list(chains), need)

    class Pages(DataSourceReader):
        def partitions(self):
            return [Chain(c) for c in made[1]]

        def read(self, partition):
            for n, row in followed(made[0], partition.name, made[2]):
                yield (partition.name, n, *row)

    class Chained(DataSource):
        @classmethod
        def name(cls):
            return called

        def schema(self):
            return kind

        def reader(self, schema):
            return Pages()

    spark.dataSource.register(Chained)
    return spark.read.format(name).load()


def stream_chain(spark: SparkSession, name: str, schema: str, fetch: TokenFetch, chain: str) -> DataFrame:
    """A chain as a stream whose offset is the token: a micro-batch is a page, one that is repeated reads its page again, and
    a query that starts again from its checkpoint goes on at its token."""
    kind, called, made = schema, name, (fetch, chain)

    class Pages(SimpleDataSourceStreamReader):
        def initialOffset(self):
            return {"token": ""}

        def read(self, start):
            if start["token"] == END:
                return iter([]), start
            rows, following = made[0](made[1], start["token"])
            return iter([tuple(r) for r in rows]), {"token": END if following is None else following}

        def readBetweenOffsets(self, start, end):
            return self.read(start)[0]

    class Streamed(DataSource):
        @classmethod
        def name(cls):
            return called

        def schema(self):
            return kind

        def simpleStreamReader(self, schema):
            return Pages()

    spark.dataSource.register(Streamed)
    return spark.readStream.format(name).load()


def field_union(found: DataFrame, fields: list[str], phrase: str, records: DataFrame, texts: list[str], need: int, group: list[str] | None = None) -> DataFrame:
    """The first `need` ids (of each `group`) that searches of several fields found: `found` (field, ordinal, id), those of an
    earlier field first, each id once, and only records (id and texts) of which one text alone holds the phrase."""
    from pyspark.sql import Window

    group = group or []
    at = F.array_position(F.array(*map(F.lit, fields)), F.col("field"))
    once = found.withColumn("priority", at).groupBy(*group, "id").agg(F.min(F.struct("priority", "ordinal")).alias("first"))
    met = records.where(matches_phrases(texts, [phrase])).select("id")
    own = Window.partitionBy(*group).orderBy("first", "id")
    return once.join(met, "id").withColumn("position", F.row_number().over(own) - 1).where(F.col("position") < need).select(*group, "id", "position")


def first_of_identities(rows: DataFrame, order: str, identities: list[str]) -> DataFrame:
    """Keeps a row, in order, unless an identity of it belongs to a row kept before. Rows that share none with another stay
    at once; the others are decided in rounds: a row goes if it shares an identity with a kept one, and stays once nothing
    undecided before it shares one. Each round keeps at least the first row of each linked group."""
    keyed = lambda df: df.select(order, F.explode(F.array_compact(F.array(*[F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat_ws("\x1f", F.lit(c), F.col(c))) for c in identities]))).alias("key"))
    left = stored(keyed(rows))
    kept = None
    while left.limit(1).count():
        least = left.groupBy("key").agg(F.min(order).alias("m"))
        wins = stored(left.join(least, "key").groupBy(order).agg(F.min((F.col(order) == F.col("m")).cast("int")).alias("w")).where("w = 1").select(order))
        kept = wins if kept is None else kept.unionAll(wins)
        taken = left.join(wins, order, "left_semi").select("key").distinct()
        gone = left.join(taken, "key", "left_semi").select(order).distinct()
        left = stored(left.join(gone, order, "left_anti"))
    anonymous = rows.where(F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in identities]).isNull())
    return anonymous if kept is None else anonymous.unionByName(rows.join(kept, order, "left_semi"))


def same_identity(rows: DataFrame, order: str, identities: list[str]) -> DataFrame:
    """(order, component) of rows linked by any identity, however far."""
    keyed = rows.select(order, F.explode(F.array_compact(F.array(*[F.concat_ws("\x1f", F.lit(c), F.col(c)) for c in identities]))).alias("key"))
    first = keyed.groupBy("key").agg(F.min(order).alias("b"))
    return components(keyed.join(first, "key").select(F.col(order).alias("a"), "b"))
