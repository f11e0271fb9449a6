"""Language identification by bit-sliced Bloom filters of character n-grams.

One table holds the filters of up to 64 languages: a slot is a word whose bit l belongs to language l, so that the AND of an
n-gram's slots is the set of all languages that contain it; more languages take more tables of the same slots. A text's language is the one whose bits are set most often, once
each count is corrected for its filter's false positives.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, arrow_map, mix64, window_hashes

GRAM = 4
HASHES = 3
SAMPLE_PER_LANGUAGE = 2000  # labelled rows a language that the filters are learned from, in expectation
LEAST_SHARE = 0.005  # of a language's sampled rows, that hold an n-gram of its filter
SLOTS_PER_GRAM = 16
UNKNOWN = "und"
BITS = 64
_LETTERS: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    """For each code point its lower-case letter, or a space."""
    if not _LETTERS:
        table = np.full(0x110000, 32, dtype=np.uint32)
        for c in range(0x110000):
            x = chr(c)
            if x.isalpha():
                low = x.lower()
                table[c] = ord(low) if len(low) == 1 else c
        _LETTERS.append(table)
    return _LETTERS[0]


def grams(text: str | None) -> np.ndarray:
    """Hashes of the n-grams of the lower-case letters of a text, every run of other characters being one space, with a space
    at both ends; empty if it has no letter."""
    if not text:
        return np.empty(0, dtype=np.uint64)
    codes = letter_table()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
    space = codes == 32
    if space.all():
        return np.empty(0, dtype=np.uint64)
    codes = codes[~(space & np.concatenate([[False], space[:-1]]))]
    codes = np.concatenate([[32], codes, np.full(GRAM - 1, 32)]) if len(codes) < GRAM else np.concatenate([[32], codes, [32]])
    return window_hashes(mix64(codes.astype(np.uint64)), GRAM)


class Filters:
    def __init__(self, languages: list[str], members: list[np.ndarray]):
        self.languages = languages
        most = max([1, *map(len, members)])
        self.size = 1 << max(10, (SLOTS_PER_GRAM * most - 1).bit_length())
        self.tables = np.zeros((-(-len(languages) // BITS), self.size), dtype=np.uint64)
        self.false = []
        for k, own in enumerate(members):
            table, bit = self.tables[k // BITS], U64(k % BITS)
            for at in self.slots(own):
                table[at] |= U64(1) << bit
            self.false.append(float(((table >> bit) & U64(1)).mean()) ** HASHES)

    def slots(self, hashes: np.ndarray):
        step = mix64(hashes) | U64(1)
        return [((hashes + step * U64(k)) & U64(self.size - 1)).astype(np.int64) for k in range(HASHES)]

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language and the share of n-grams that it explains. No letter or no filter: `und`, 0. If no filter explains any
        n-gram, the first language (the most frequent) with 0."""
        hashes = grams(text)
        if not len(hashes) or not self.languages:
            return UNKNOWN, 0.0
        first, *rest = self.slots(hashes)
        counts = []
        for table in self.tables:
            masks = table[first]
            for at in rest:
                masks &= table[at]
            counts += [int(((masks >> U64(bit)) & U64(1)).sum()) for bit in range(min(BITS, len(self.false) - len(counts)))]
        n = len(hashes)
        share = [max(0.0, (c / n - p) / (1 - p)) if p < 1 else 0.0 for c, p in zip(counts, self.false)]
        best = int(np.argmax(share))
        return self.languages[best], min(1.0, share[best])


def learn(labelled: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> Filters:
    """Filters from labelled rows (doc_id, text, lang). Of each language about `per_language` rows are sampled by a hash of
    their doc_id; only n-gram counts of the sample leave the executors."""
    counts = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row a language
    languages = sorted(counts, key=lambda x: (-counts[x], x))
    if not languages:
        return Filters([], [])
    million = 1_000_000
    below = F.create_map(*[F.lit(x) for k in languages for x in (k, min(million, int(per_language / counts[k] * million) + 1))])
    sample = labelled.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(million)) < below[F.col("lang")])

    def make():
        def step(batch):
            for lang in set(batch.column(1).to_pylist()):
                own = [np.unique(grams(t)) for t, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if x == lang]
                values, n = np.unique(np.concatenate(own), return_counts=True)
                yield {"lang": [lang] * len(values), "gram": values.view(np.int64), "n": n, "docs": np.zeros(len(n), dtype=np.int64)}
                yield {"lang": [lang], "gram": [None], "n": [0], "docs": [len(own)]}

        return step

    summed = arrow_map(sample.select("text", "lang"), "lang string, gram long, n long, docs long", make).groupBy("lang", "gram").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    enough = {k: max(2, int(LEAST_SHARE * min(per_language, counts[k]))) if counts[k] > 4 else 1 for k in languages}
    least = F.create_map(*[F.lit(x) for k, v in enough.items() for x in (k, v)])
    rows = summed.where(F.col("gram").isNotNull() & (F.col("n") >= least[F.col("lang")])).select("lang", "gram").toArrow()  # at most a text's n-grams / LEAST_SHARE a language
    lang, gram = np.array(rows.column("lang").to_pylist(), dtype=object), rows.column("gram").to_numpy().view(np.uint64)
    return Filters(languages, [gram[lang == k] for k in languages])


def identify(docs: DataFrame, filters: Filters, keep: list[str] | None = None) -> DataFrame:
    """`docs` with lang_pred and score; `keep` names the columns to carry (default: doc_id). A text that is null or has no
    letter is `und` with 0; rows that repeat are predicted each; an empty table stays empty."""
    keep = keep or ["doc_id"]
    sent = docs.sparkSession.sparkContext.broadcast(filters)  # SLOTS_PER_GRAM words an n-gram of the largest filter
    kinds = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keep)

    def make():
        model = sent.value

        def step(batch):
            found = [model.predict(x.as_py()) for x in batch.column(0)]
            yield {k: batch.column(i + 1) for i, k in enumerate(keep)} | {"lang_pred": [x for x, _ in found], "score": [x for _, x in found]}

        return step

    return arrow_map(docs.select(F.col("text").cast("string").alias("__text"), *keep), f"{kinds}, lang_pred string, score double", make)
