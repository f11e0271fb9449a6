"""Removal of repeated byte strings by blockwise suffix sorting with a difference cover.

Every suffix of `WIDTH` bytes falls into the bucket of the smallest hash among its `GRAM`-byte substrings, so equal strings
share a bucket, and neighbouring suffixes mostly do too: a run of them is one row. Buckets met once hold no repeat and are
dropped before any text moves; of texts that are copies of each other one stays, and all are removed. The others are dealt out with the text of their runs, and each task sorts them a block of
buckets at a time. Ties are resolved by ranks of the block's cover samples - positions whose residue modulo 7 is in the
perfect difference cover {0, 1, 3}, ranked by prefix doubling, which stays within a residue class - so that two suffixes of
any residues are compared by one rank and at most 11 bytes, and a block needs memory in proportion to its text only.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, byte_values, materialize, sliding_min, window_hashes

WIDTH, GRAM = 200, 80
FINE_GRAM = 150  # buckets of more than HOT runs are parted again by the smallest of these
HOT = 2048
BLOCK = 4 << 20  # bytes of text that a task sorts at once, unless one bucket has more
PERIOD, COVER = 7, (0, 1, 3)
_SLOT = np.full(PERIOD, -1, dtype=np.int64)
_SLOT[list(COVER)] = range(len(COVER))


def runs_of(data: np.ndarray, gram: int):
    """The maximal runs of suffixes of one bucket: hash, start, number of suffixes, weight (2 if the hash occurs again in
    the same bytes)."""
    grams = window_hashes(byte_values(data), gram)
    low = sliding_min(grams, WIDTH - gram + 1)
    cut = np.flatnonzero(low[1:] != low[:-1]) + 1
    start = np.concatenate([[0], cut])
    length = np.diff(np.concatenate([start, [len(low)]]))
    hashes = low[start]
    ordered = np.sort(grams)
    weight = np.ones(len(start), dtype=np.int32)
    if (ordered[1:] == ordered[:-1]).any():
        weight += np.searchsorted(ordered, hashes, "right") - np.searchsorted(ordered, hashes, "left") > 1
    return hashes, start, length, weight


def _dense_rank(keys: np.ndarray) -> np.ndarray:
    """Ranks (32 bits) of keys; equal keys, equal ranks."""
    order = np.argsort(keys)
    ordered = keys[order]
    rank = np.empty(len(keys), dtype=np.uint32)
    rank[order] = np.cumsum(np.concatenate([[0], ordered[1:] != ordered[:-1]]), dtype=np.uint32)
    return rank


def _bytes_at(padded: np.ndarray, at: np.ndarray, count: int) -> np.ndarray:
    out = np.zeros(len(at), dtype=np.uint64)
    for k in range(count):
        out = (out << np.uint64(8)) | padded[at + k].astype(np.uint64)
    return out


def cover_ranks(padded: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Ranks of all cover samples by their first 196 and 189 bytes. A sample p is at index 3 * (p // 7) + slot; a shift
    by a multiple of 7 keeps the slot."""
    cycles = size // PERIOD + 1
    at = (np.arange(cycles, dtype=np.int64)[:, None] * PERIOD + np.array(COVER)).ravel()
    rank = _dense_rank(_bytes_at(padded, at, PERIOD))

    def joined(shift: int) -> np.ndarray:
        key = rank.astype(np.uint64) << np.uint64(32)
        step = shift // PERIOD * len(COVER)
        key[: len(rank) - step] |= rank[step:]
        return _dense_rank(key)

    for shift in (7, 14, 28, 56):
        rank = joined(shift)
    return joined(84), joined(77)


def repeated(text: np.ndarray, suffixes: np.ndarray) -> np.ndarray:
    """Which of the suffixes (positions in text with WIDTH bytes each) equal another one in their first WIDTH bytes."""
    padded = np.concatenate([text, np.zeros(2 * WIDTH, dtype=np.uint8)])
    by196, by189 = cover_ranks(padded, len(text) + WIDTH)
    found = np.zeros(len(suffixes), dtype=bool)
    residue = suffixes % PERIOD
    for shift in range(PERIOD):  # two residues meet in exactly one shift
        chosen = np.flatnonzero(_SLOT[(residue + shift) % PERIOD] >= 0)
        at = suffixes[chosen]
        sample = at + shift
        index = sample // PERIOD * len(COVER) + _SLOT[sample % PERIOD]
        if shift <= 4:
            rest = (_bytes_at(padded, at, shift) << np.uint64(8 * (4 - shift))) | _bytes_at(padded, sample + 196, 4 - shift)
            keys = [(by196[index].astype(np.uint64) << np.uint64(32)) | rest]
        else:
            head, tail = _bytes_at(padded, at, shift), _bytes_at(padded, sample + 189, 11 - shift)
            keys = [(by189[index].astype(np.uint64) << np.uint64(32)) | (head >> np.uint64(8 * (shift - 4))), ((head & np.uint64(0xFFFF)) << np.uint64(48)) | tail]
        order = np.argsort(keys[0]) if len(keys) == 1 else np.lexsort(keys)
        same = np.ones(max(0, len(order) - 1), dtype=bool)
        for key in keys:
            ordered = key[order]
            same &= ordered[1:] == ordered[:-1]
        found[chosen[order[1:][same]]] = True
        found[chosen[order[:-1][same]]] = True
    return found


def covered(flags: np.ndarray) -> list[tuple[int, int]]:
    """Byte spans covered by the flagged suffixes of a run, overlapping ones joined."""
    at = np.flatnonzero(flags)
    if not len(at):
        return []
    cut = np.flatnonzero(np.diff(at) > WIDTH)
    return list(zip(at[np.concatenate([[0], cut + 1])].tolist(), (at[np.concatenate([cut, [len(at) - 1]])] + WIDTH).tolist()))


def sort_block(buckets: list[dict[bytes, list]]) -> list:
    """Spans of a block of buckets, each from a run's text to the rows (doc key, text key, start) that hold it."""
    out, held, texts, size = [], [], [], 0

    def give(rows, spans):
        out.extend((d, t, at + s, at + e) for d, t, at in rows for s, e in spans)

    for bucket in buckets:
        for text, rows in bucket.items():
            whole = len(rows) > 1
            if whole:
                give(rows, [(0, len(text))])
            if len(bucket) > 1 or not whole:
                held.append((len(text), size, None if whole else rows))
                texts.append(text)
                size += len(text)
    if held:
        starts = np.array([at for _, at, _ in held])
        counts = np.array([n - WIDTH + 1 for n, _, _ in held])
        first = np.concatenate([[0], np.cumsum(counts)])
        suffixes = np.arange(first[-1]) - np.repeat(first[:-1] - starts, counts)
        flags = repeated(np.frombuffer(b"".join(texts), dtype=np.uint8), suffixes)
        for (_, _, rows), s, e in zip(held, first, first[1:]):
            if rows:
                give(rows, covered(flags[s:e]))
    return out


def _find_runs(docs: DataFrame) -> DataFrame:
    """Rows h, did, tk, start, length, weight of all runs, and one row for each text (h null, copy its digest, weight 1, or 2
    if it has a copy in the same partition, whose runs are then written once)."""

    def make():
        seen: dict[bytes, list] = {}  # of the first copy: its keys, and whether it is known to have another

        def step(batch):
            rows: list[list] = [[], [], [], [], [], [], []]
            for did, tk, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                data = (text.as_py() or "").encode("utf-8", "surrogatepass")
                if len(data) < WIDTH:
                    continue
                mark = hashlib.blake2b(data, digest_size=16).digest()
                copy = int.from_bytes(mark[:8], "little", signed=True)
                first = seen.get(mark)
                again = [(did, tk, 2)] if first else [(did, tk, 1)]
                if first and not first[2]:
                    again.append((first[0], first[1], 2))
                    first[2] = True
                for a, b, weight in again:
                    for column, x in zip(rows, (None, copy, a, b, 0, len(data), weight)):
                        column.append(x)
                if first:
                    continue
                seen[mark] = [did, tk, False]
                hashes, start, length, weight = runs_of(np.frombuffer(data, dtype=np.uint8), GRAM)
                n = len(start)
                for column, x in zip(rows, (hashes.view(np.int64).tolist(), [None] * n, [did] * n, [tk] * n, start.tolist(), length.tolist(), weight.tolist())):
                    column.extend(x)
            if rows[2]:
                yield dict(zip(("h", "copy", "did", "tk", "start", "length", "weight"), rows))

        return step

    return arrow_map(docs.select("did", "tk", "text"), "h long, copy long, did long, tk int, start int, length int, weight int", make)


def _run_texts(joined: DataFrame) -> DataFrame:
    """The text of each shared run; hot buckets are parted again, and a task sends a run of a hot bucket only once."""

    def make():
        sent: dict[bytes, tuple] = {}

        def step(batch):
            rows = []
            for did, tk, text, runs in zip(*(batch.column(k) for k in ("did", "tk", "text", "runs"))):
                if not runs.is_valid:
                    continue
                did, tk, data = did.as_py(), tk.as_py(), text.as_py().encode("utf-8", "surrogatepass")
                for run in runs.as_py():
                    h, start, length = run["h"], run["start"], run["length"]
                    if not run["hot"]:
                        rows.append((h, did, tk, start, data[start : start + length + WIDTH - 1]))
                        continue
                    piece = data[start : start + length + WIDTH - 1]
                    for fine, s, n, _ in zip(*(x.tolist() for x in runs_of(np.frombuffer(piece, dtype=np.uint8), FINE_GRAM))):
                        part = piece[s : s + n + WIDTH - 1]
                        key = int(np.uint64(fine ^ (h & (1 << 64) - 1)).view(np.int64))
                        mark = hashlib.blake2b(part, digest_size=16).digest()
                        before = sent.get(mark)
                        if before is None:
                            sent[mark] = (did, tk, start + s)
                        if before is None:
                            rows.append((key, did, tk, start + s, part))
                        else:
                            rows.append((did, did, tk, start + s, len(part)))
                            if before:
                                rows.append((before[0], before[0], before[1], before[2], len(part)))
                                sent[mark] = ()
            if rows:
                key, did, tk, start, piece = zip(*rows)
                yield {"key": key, "did": did, "tk": tk, "start": start, "whole": [x if isinstance(x, int) else None for x in piece], "piece": [None if isinstance(x, int) else x for x in piece]}

        return step

    return arrow_map(joined, "key long, did long, tk int, start int, whole int, piece binary", make)


def _sorted_spans(dealt: DataFrame) -> DataFrame:
    def run(batches):
        buckets: list[dict[bytes, list]] = []
        size, last = 0, None
        schema = pa.schema([("did", pa.int64()), ("tk", pa.int32()), ("s", pa.int32()), ("e", pa.int32())])

        def table(rows):
            return pa.RecordBatch.from_arrays([pa.array(x, type=f.type) for x, f in zip(zip(*rows), schema)], schema=schema)

        for batch in batches:
            direct = []
            for key, did, tk, start, whole, piece in zip(*(c.to_pylist() for c in batch.columns)):
                if piece is None:
                    direct.append((did, tk, start, start + whole))
                    continue
                if key != last:
                    if size >= BLOCK:
                        if rows := sort_block(buckets):
                            yield table(rows)
                        buckets, size = [], 0
                    buckets.append({})
                    last = key
                rows = buckets[-1].setdefault(piece, [])
                size += len(piece) * (not rows)
                rows.append((did, tk, start))
            if direct:
                yield table(direct)
        if rows := sort_block(buckets):
            yield table(rows)

    return dealt.mapInArrow(run, "did long, tk int, s int, e int")


def repeated_spans(docs: DataFrame) -> DataFrame:
    """`docs` (text and any other columns but did, tk, runs and spans) with the columns did, tk and spans: the (s, e) byte
    spans of each text that repeat anywhere in the table. Texts are dealt by key once: both joins ask for the same columns in
    the same way, so that they share that exchange."""
    text = F.col("text").cast("string")
    keyed = docs.withColumns({"text": text, "did": F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(text)), "tk": F.hash(text)})
    runs = materialize(_find_runs(keyed.select("did", "tk", "text")), "runs")
    buckets = runs.where("h is not null").groupBy("h").agg(F.sum("weight").alias("c")).where("c > 1").select("h", (F.col("c") > HOT).alias("hot"))
    shared = runs.where("h is not null").select("h", "did", "tk", "start", "length").join(buckets, "h")
    texts = runs.where("copy is not null").select("copy", "did", "tk", "length", "weight")
    copied = texts.groupBy("copy", "tk").agg(F.sum("weight").alias("c"), F.min(F.when(F.col("weight") == 1, F.col("did"))).alias("first")).where("c > 1")  # weight 1: its runs are written
    copies = texts.join(copied, ["copy", "tk"]).select("did", "tk", "length", (F.col("did") != F.col("first")).alias("later"))
    wanted = shared.groupBy("did", "tk").agg(F.collect_list(F.struct("h", "start", "length", "hot")).alias("runs"))
    wanted = wanted.join(copies.where("later").select("did", "tk"), ["did", "tk"], "left_anti")  # of copies the first with runs speaks
    dealt = _run_texts(keyed.join(wanted, ["did", "tk"], "left")).repartition("key").sortWithinPartitions("key")
    spans = _sorted_spans(dealt).unionByName(copies.select("did", "tk", F.lit(0).alias("s"), F.col("length").alias("e")))
    return keyed.join(spans.groupBy("did", "tk").agg(F.collect_list(F.struct("s", "e")).alias("spans")), ["did", "tk"], "left")


def merged(spans) -> list[list[int]]:
    """Sorted, with overlapping and touching spans joined."""
    out: list[list[int]] = []
    for s, e in sorted((x["s"], x["e"]) for x in spans or ()):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return out


def kept_bytes(data: bytes, spans: list[list[int]]) -> bytes:
    at, kept = 0, []
    for s, e in spans:
        kept.append(data[at:s])
        at = e
    return b"".join([*kept, data[at:]])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """One row for each row of `docs`: doc_id, n_bytes, n_removed, n_spans, kept (binary).

    A byte goes if a 200-byte string that covers it also starts elsewhere in the table, in the same text or another; a row
    that repeats counts as elsewhere. Null and short texts lose nothing; a null text is empty."""

    def make():
        def step(batch):
            out: dict[str, list] = {k: [] for k in ("n_bytes", "n_removed", "n_spans", "kept")}
            for text, spans in zip(batch.column("text"), batch.column("spans")):
                data = (text.as_py() or "").encode("utf-8", "surrogatepass")
                joined = merged(spans.as_py()) if spans.is_valid else []
                kept = kept_bytes(data, joined)
                for k, x in zip(out, (len(data), len(data) - len(kept), len(joined), kept)):
                    out[k].append(x)
            yield {"doc_id": batch.column("doc_id"), **out}

        return step

    spans = repeated_spans(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")))
    return arrow_map(spans, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary", make)
