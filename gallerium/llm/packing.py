"""Packing of token pieces into fixed windows by non-negative least squares over the length histogram.

Documents are cut at the window; what is left of each is shorter than it. The driver sees the histogram of lengths only (at
most `window` counts), enumerates shallow combinations of lengths that fill a window exactly, solves for how often each is
repeated, rounds down, and maps rank ranges of each length to slots. What rounding leaves is packed greedily, end to end and
cut at window borders; the last part is cut into powers of two, which need no padding.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import alphabet, compile_lexicon, encoder
from .common import arrow_map, materialize

WINDOW = 2048
END = 1  # the id that ends each document
RANKED = 1_000_000  # pieces of one length that a task ranks
DENSE_LENGTHS = 96  # the most frequent lengths, of which combinations of three are enumerated
COPIES = 24  # pieces of one length that a combination repeats at most
SWEEPS = 60


Combination = tuple[tuple[int, int], ...]  # lengths and how many of each


def combinations(histogram: np.ndarray, window: int) -> list[Combination]:
    """Combinations of lengths in the histogram that add up to the window: all of up to `COPIES` pieces of one length and one
    of another, and the threes with two of the most frequent lengths."""
    have = np.flatnonzero(histogram)
    present = set(have.tolist())
    counted = lambda c: tuple(sorted(Counter(c).items(), reverse=True))
    out = []
    for a in have.tolist():
        for copies in range(1, min(COPIES, window // a) + 1):
            left = window - copies * a
            if left in present and (copies > 1 or left >= a):
                out.append(counted({a: copies, left: 1} if left != a else {a: copies + 1}))
            elif not left and copies > 1:
                out.append(((a, copies),))
    dense = sorted(have[np.argsort(-histogram[have], kind="stable")][:DENSE_LENGTHS].tolist(), reverse=True)
    out += [counted((a, b, left)) for i, a in enumerate(dense) for b in dense[i:] if (left := window - a - b) > 0 and left in present]
    return list(dict.fromkeys(out))


def solve(histogram: np.ndarray, columns: list[Combination]) -> np.ndarray:
    """Non-negative repeat counts whose use of lengths is nearest to the histogram in squares, by coordinate descent."""
    rest = histogram.astype(float).tolist()
    norm = [sum(n * n for _, n in c) for c in columns]
    x = [0.0] * len(columns)
    for _ in range(SWEEPS):
        moved = 0.0
        for j, c in enumerate(columns):
            step = max(-x[j], sum(n * rest[k] for k, n in c) / norm[j])
            if step:
                x[j] += step
                moved = max(moved, abs(step))
                for k, n in c:
                    rest[k] -= n * step
        if moved < 0.01:
            break
    return np.array(x)


def plan(histogram: np.ndarray, window: int) -> dict:
    """Slots: for each length the rank ranges with their first sequence and offset; then the stream of the residue."""
    left = histogram.astype(np.int64).copy()
    columns = combinations(histogram, window)
    segments: list[tuple[int, int, int, int, int]] = []  # length, first rank, ranks, first sequence, offset
    taken, sequence = np.zeros(window + 1, dtype=np.int64), 0

    def give(combination: Combination, times: int) -> None:
        nonlocal sequence
        offset = 0
        for length, copies in combination:
            for _ in range(copies):
                segments.append((length, int(taken[length]), times, sequence, offset))
                taken[length] += times
                left[length] -= times
                offset += length
        sequence += times

    if left[window]:
        give(((window, 1),), int(left[window]))
    for combination, repeats in zip(columns, solve(left, columns)):
        times = min(int(repeats + 1e-6), *(int(left[k]) // n for k, n in combination))
        if times > 0:
            give(combination, times)
    base = np.concatenate([[0], np.cumsum(left * np.arange(window + 1))])
    total = int(base[-1])
    tail = [1 << b for b in range(window.bit_length(), -1, -1) if total % window >> b & 1]
    segments.sort()
    return {"segments": np.array(segments, dtype=np.int64).reshape(-1, 5), "taken": taken, "base": base[:-1], "full": total // window, "tail": np.cumsum([0, *tail]), "sequence": sequence}


def place(length: int, rank: int, p: dict, first: np.ndarray, window: int):
    """Where a piece goes: (skip, count, sequence, offset), several of them if it is cut."""
    if rank < p["taken"][length]:
        rows = p["segments"][first[length] : first[length + 1]]
        _, at, _, sequence, offset = rows[np.searchsorted(rows[:, 1], rank, "right") - 1].tolist()
        return [(0, length, sequence + rank - at, offset)]
    at = int(p["base"][length] + (rank - p["taken"][length]) * length)
    out, skip = [], 0
    while skip < length:
        number, offset = divmod(at + skip, window)
        room = window - offset
        if number >= p["full"]:
            k = int(np.searchsorted(p["tail"], offset, "right")) - 1
            number, offset, room = p["full"] + k, offset - int(p["tail"][k]), int(p["tail"][k + 1]) - offset
        count = min(room, length - skip)
        out.append((skip, count, p["sequence"] + number, offset))
        skip += count
    return out


def tokenized(docs: DataFrame, path: str, window: int) -> DataFrame:
    """The pieces of each document: whole windows with their checksum, and the rest with its ids."""
    with open(path, "rb") as file:
        spec = file.read()
    sent = docs.sparkSession.sparkContext.broadcast((spec, alphabet(), compile_lexicon({})))  # no lexicon: words are merged and remembered

    def make():
        coder = encoder(*sent.value)

        def step(batch):
            texts = batch.column(1).to_pylist()
            for s in range(0, len(texts), 1024):
                rows: list[list] = [[] for _ in range(6)]
                for doc, ids in zip(batch.column(0).slice(s, 1024).to_pylist(), coder.encode(texts[s : s + 1024])):
                    ids += np.array([END], dtype="<u4").tobytes()
                    n = len(ids) // 4
                    for at in range(0, n, window):
                        part = ids[4 * at : 4 * (at + window)]
                        whole = len(part) == 4 * window
                        narrow = np.frombuffer(part, dtype="<u4")
                        narrow = narrow.astype("<u2") if narrow.max() < 1 << 16 else narrow
                        for column, x in zip(rows, (doc, at, len(part) // 4, n, zlib.crc32(part) if whole else None, None if whole else narrow.tobytes())):
                            column.append(x)
                yield dict(zip(("doc_id", "start", "length", "doc_tokens", "crc", "ids"), rows))

        return step

    return arrow_map(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), "doc_id long, start long, length int, doc_tokens long, crc long, ids binary", make)


def pack(docs: DataFrame, path: str, window: int = WINDOW) -> DataFrame:
    """A row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_tokens.

    Every id of every document (its text's ids, then END; a null or empty text has END only) lies in exactly one piece;
    offsets of a sequence are gapless from 0; a null doc_id is kept as it is. Each sequence is full or a power of two long, so none needs padding. Rows
    that repeat a doc_id are packed as documents of their own."""
    spark = docs.sparkSession
    pieces = materialize(tokenized(docs, path, window), "pieces")
    histogram = np.zeros(window + 1, dtype=np.int64)
    for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect():  # at most `window` rows
        histogram[r.length] = r.n
    p = plan(histogram, window)
    parts = F.element_at(F.lit(np.maximum(1, -(-histogram // RANKED)).tolist()), F.col("length") + 1)
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start", "doc_tokens"), parts))
    counts = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = counts.select("length", "salt", (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"))
    rank = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "start")) - 1
    ranked = salted.withColumn("rank", rank).join(F.broadcast(before), ["length", "salt"])  # a row a length and RANKED pieces
    sent = spark.sparkContext.broadcast((p, np.searchsorted(p["segments"][:, 0], np.arange(window + 2))))

    def make():
        chosen, first = sent.value

        def step(batch):
            rows: list[list] = [[] for _ in range(8)]
            tail = np.diff(chosen["tail"])
            for doc, start, length, tokens, crc, ids, rank, before in zip(*(c.to_pylist() for c in batch.columns)):
                data = None
                for skip, count, sequence, offset in place(length, rank + before, chosen, first, window):
                    if crc is None or count < length:
                        if data is None:
                            data = np.frombuffer(ids, dtype="<u2" if len(ids) == 2 * length else "<u4").astype("<u4").tobytes()
                        crc = zlib.crc32(data[4 * skip : 4 * (skip + count)])
                    over = sequence - chosen["sequence"] - chosen["full"]
                    for column, x in zip(rows, (doc, start + skip, count, crc, tokens, sequence, offset, int(tail[over]) if over >= 0 else window)):
                        column.append(x)
                    if data is not None:
                        crc = None
            yield dict(zip(("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_tokens"), rows))

        return step

    return arrow_map(ranked.select("doc_id", "start", "length", "doc_tokens", "crc", "ids", "rank", "before"), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long", make)
