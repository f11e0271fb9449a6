"""Order MinHash fingerprints: for each of SKETCHES hash functions the ELL smallest occurrence-numbered k-mers, put back
into text order and hashed as a tuple. Two texts agree in a place with a probability that follows their edit distance."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, arrow_map, mix64, seeds, window_hashes

K, ELL, SKETCHES = 6, 2, 24
NULL_RANGES = 64  # that rows without a doc_id are dealt to
_MULTIPLIERS = seeds(SKETCHES, 4242)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def occurrence_numbers(kmers: np.ndarray) -> np.ndarray:
    """How many equal k-mers stand before each."""
    n = len(kmers)
    order = np.argsort(kmers, kind="stable")
    ordered = kmers[order]
    at = np.arange(n)
    first = np.maximum.accumulate(np.where(np.concatenate([[True], ordered[1:] != ordered[:-1]]), at, 0))
    out = np.empty(n, dtype=np.uint64)
    out[order] = at - first
    return out


def fingerprint(codes: np.ndarray) -> str:
    """Eight hex digits for each hash function; an empty text has an empty fingerprint, one below K characters one k-mer."""
    if not len(codes):
        return ""
    kmers = window_hashes(mix64(codes.astype(np.uint64)), min(K, len(codes)))
    items = mix64(kmers + occurrence_numbers(kmers) * U64(0x9E3779B97F4A7C15))
    picked = np.empty((SKETCHES, min(ELL, len(items))), dtype=np.int64)
    step = max(1, (1 << 22) // len(items))
    for s in range(0, SKETCHES, step):
        values = items[None, :] * _MULTIPLIERS[s : s + step, None]
        rows = np.arange(len(values))
        for k in range(picked.shape[1]):
            picked[s : s + step, k] = low = values.argmin(axis=1)
            values[rows, low] = np.iinfo(np.uint64).max
    picked.sort(axis=1)
    out = np.arange(SKETCHES, dtype=np.uint64)
    for k in range(picked.shape[1]):
        out = mix64(out * U64(0x9E3779B97F4A7C15) + kmers[picked[:, k]])
    return (out >> U64(32)).astype(">u4").tobytes().hex()


def likeness(a: str, b: str) -> float:
    """The share of equal places, 0 to 1; two empty texts are alike, an empty one and another aren't."""
    if not a or not b:
        return float(a == b)
    x, y = (np.frombuffer(bytes.fromhex(t), dtype=np.uint32) for t in (a, b))
    return float((x == y).mean())


def fingerprints(docs: DataFrame) -> DataFrame:
    """`docs` (doc_id, text) with n_chars and fingerprint; null counts as empty."""

    def make():
        def step(batch):
            codes = [code_points(x.as_py() or "") for x in batch.column(1)]
            yield {"doc_id": batch.column(0), "n_chars": [len(c) for c in codes], "fingerprint": [fingerprint(c) for c in codes]}

        return step

    return arrow_map(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), "doc_id long, n_chars long, fingerprint string", make)


def with_next(docs: DataFrame) -> DataFrame:
    """Deals rows by ranges of doc_id, in falling order, each range followed by the first row of the next one (the last by
    the first of all), so that a task sees each row's successor without one task holding all rows. Rows without a doc_id come
    last, in ranges of their texts' hashes; rows that repeat a doc_id in order of that hash and the text."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long"), text.alias("text"), F.xxhash64(text).alias("h"))
    shares = [k / parts for k in range(1, parts)]
    bounds = sorted(set(rows.agg(F.percentile_approx("doc_id", shares, 10000)).first()[0] or []), reverse=True) if shares else []
    array = F.lit(bounds) if bounds else F.array().cast("array<long>")
    by_hash = F.shiftrightunsigned(F.col("h").bitwiseXOR(F.lit(-(1 << 63))), 64 - NULL_RANGES.bit_length() + 1).cast("int")
    bucket = F.when(F.col("doc_id").isNull(), len(bounds) + by_hash).otherwise(F.size(F.filter(array, lambda b: F.col("doc_id") < b)))
    rows = rows.withColumn("bucket", bucket)
    firsts = rows.groupBy("bucket").agg(F.max(F.struct("doc_id", F.bitwise_not("h").alias("h"))).alias("first")).collect()  # a row a range
    order = sorted(firsts, key=lambda r: r.bucket)
    hosts = spark.createDataFrame([(r.bucket, order[k - 1].bucket, r.first.doc_id, ~r.first.h) for k, r in enumerate(order)], "bucket int, host int, first long, first_h long")
    told = rows.join(F.broadcast(hosts), "bucket")  # broadcast: a row a range
    own, guest = (F.struct(F.col(b).alias("bucket"), F.lit(g).alias("guest")) for b, g in (("bucket", 0), ("host", 1)))
    is_first = F.col("doc_id").eqNullSafe(F.col("first")) & (F.col("h") == F.col("first_h"))
    dealt = told.select("doc_id", "h", "text", F.explode(F.when(is_first, F.array(own, guest)).otherwise(F.array(own))).alias("t"))
    dealt = dealt.select(F.col("t.bucket").alias("bucket"), F.col("t.guest").alias("guest"), "doc_id", "text", "h")
    return dealt.repartition(parts, "bucket").sortWithinPartitions("bucket", "guest", F.desc_nulls_last("doc_id"), "h", "text").drop("h")


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text: the last floor(n_chars / 3) code points replaced by the first as many (or all) of the next document in
    falling order of doc_id; the last one's next is the first. A table of one row has itself as next. Null texts are empty;
    rows without a doc_id come last and rows that repeat one stand side by side, in order of their texts."""

    def make():
        held: list = []  # bucket, doc_id, codes, fingerprint of the row before

        def step(batch):
            out: dict[str, list] = {k: [] for k in ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")}
            for bucket, guest, doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
                codes = code_points(text.as_py() or "")
                mark = fingerprint(codes)
                if held and held[0] == bucket:
                    _, own, before, own_mark = held
                    cut = len(before) // 3
                    edited = np.concatenate([before[: len(before) - cut], codes[:cut]])
                    edited_mark = fingerprint(edited)
                    sha = hashlib.sha256(edited.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")).hexdigest()
                    for k, x in zip(out, (own, len(before), sha, own_mark, edited_mark, likeness(own_mark, edited_mark), likeness(own_mark, mark))):
                        out[k].append(x)
                held[:] = [] if guest else [bucket, doc, codes, mark]
            yield out

        return step

    return arrow_map(with_next(docs), "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double", make)
