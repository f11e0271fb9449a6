"""Quality rules judged by host: failures are aggregated by host, rates shrunk to an empirical beta prior, and verdicts joined back.

A document fails the base rule or one of the soft rules by its own counts. For each rule, the hosts' failures give a beta prior
(mean and spread by moments), and a host's rate is the posterior mean: a host of few documents stays near the corpus. A host
whose rate of any rule is over REJECT goes whole. Elsewhere a document that fails a soft rule goes unless its host fails that rule
at a rate below TRUST, where a lone failure is forgiven; a document that fails the base rule always goes, and one that fails
none stays.

Null texts have no words; a null host is a host of its own, the empty one. Rows that repeat count each, a null doc_id is a row
like others, an empty table stays empty, and other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, materialize

LEAST_WORDS, MOST_REPEATED_PERCENT = 50, 50
REJECT, TRUST = 0.5, 0.02
HOT_SHARE = 1000  # a host of more than a thousandth of all rows is hot, so there are fewer than this many
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
_SPACES, _INNER = b" \t\n\v\f\r", bytes(range(0x80, 0xC0))
_SYMBOLS = b"#*$%&|<>"


def rules() -> dict[str, Column]:
    """The rules on a document's counts: whether it fails. The first decides alone, hosts or not."""
    c = F.col
    return {
        "base": (c("n_words") < LEAST_WORDS) | (100 * c("n_repeat_words") > MOST_REPEATED_PERCENT * c("n_words")),
        "symbols": 10 * c("n_symbols") > c("n_words"),
        "lines": 100 * c("n_dup_lines") > 30 * c("n_lines"),
        "lengths": (c("word_chars") < 3 * c("n_words")) | (c("word_chars") > 10 * c("n_words")),
    }


SOFT = ("symbols", "lines", "lengths")


def repeated_words(words: list[bytes]) -> int:
    """Words within windows of three that occur twice or more."""
    if len(words) < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), dtype=np.int64, count=len(words))
    if len(number) > len(words) - 3:  # the second of two equal windows has three words that occurred before
        return 0
    pairs = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)[1]
    _, place, times = np.unique(pairs[:-1] * len(number) + ids[2:], return_inverse=True, return_counts=True)
    again = times[place] > 1
    covered = np.zeros(len(words), dtype=bool)
    for k in range(3):
        covered[k : k + len(again)] |= again
    return int(covered.sum())


def counts_of(data: bytes) -> tuple[int, ...]:
    """COUNTS of one text in UTF-8; words lie between spaces and the five controls that follow 8."""
    words = data.split()
    lines = [line for line in data.split(b"\n") if line.strip()]
    return len(words), len(data.translate(None, _SPACES + _INNER)), len(data) - len(data.translate(None, _SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words), len(lines)


def document_counts(docs: DataFrame, host: str = "source") -> DataFrame:
    """(doc_id, host, COUNTS) of every row of `docs` (doc_id, host, text)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def make():
        def step(batch):
            rows = [counts_of(text.as_py() or b"") for text in batch.column(2)]
            yield {"doc_id": batch.column(0), "host": batch.column(1), **{c: [r[k] for r in rows] for k, c in enumerate(COUNTS)}}

        return step

    rows = docs.select("doc_id", F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"), F.col("text").cast("binary").alias("text"))
    return arrow_map(rows, f"doc_id {kind}, host string, " + ", ".join(f"{c} long" for c in COUNTS), make)


def host_rates(counted: DataFrame) -> DataFrame:
    """(host, rule, n, failed, rate): each host's shrunk rate of failure of each rule.

    The prior of a rule has the mean of all rows and a weight by the analysis of variance between hosts: hosts that differ no
    more than chance shrink to the mean, hosts that differ freely keep their own rates."""
    sums = counted.groupBy("host").agg(F.count("*").alias("n"), *[F.count_if(fails).alias(name) for name, fails in rules().items()])
    pairs = F.explode(F.array(*[F.struct(F.lit(name).alias("rule"), F.col(name).alias("failed")) for name in rules()]))
    long = materialize(sums.select("host", "n", pairs.alias("p")).select("host", "n", "p.*"), "host-sums")
    n, k = F.sum("n"), F.sum("failed")
    square = F.sum(F.col("n").cast("decimal(38,0)") * F.col("n")).cast("double")
    spread = long.groupBy("rule").agg(F.count("*").alias("hosts"), n.alias("rows"), (k / n).alias("mean"), (square / n).alias("big"), (F.sum(F.col("failed") * F.col("failed") / F.col("n")) - k * k / n).alias("between"))
    noise = F.col("mean") * (1 - F.col("mean"))
    excess = F.try_divide(F.col("between") - noise * (F.col("hosts") - 1), noise * (F.col("rows") - F.col("big") - (F.col("hosts") - 1)))
    share = F.least(F.greatest(F.coalesce(excess, F.lit(0.0)), F.lit(1e-6)), F.lit(0.999))  # null: one host, or a rule that all or none fail
    prior = spread.select("rule", "mean", (1 / share - 1).alias("weight"))  # a row a rule
    rate = (F.col("failed") + F.col("mean") * F.col("weight")) / (F.col("n") + F.col("weight"))
    return long.join(F.broadcast(prior), "rule").select("host", "rule", "n", "failed", rate.alias("rate"))


def host_verdicts(rates: DataFrame) -> DataFrame:
    """(host, n, rejected, strict): whether a host goes whole, and the rules (of SOFT) that it isn't forgiven."""
    strict = F.array_sort(F.collect_set(F.when((F.col("rate") >= TRUST) & F.col("rule").isin(*SOFT), F.col("rule"))))  # a few rules at most
    return rates.groupBy("host").agg(F.max("n").alias("n"), F.max(F.col("rate") > REJECT).alias("rejected"), strict.alias("strict"))


def judge(docs: DataFrame, host: str = "source") -> DataFrame:
    """(doc_id, host, COUNTS, base_failed, kept, reason) of every row of `docs` (doc_id, host, text).

    Texts are read once; what is joined are counts. Rows of hot hosts get their verdicts by a broadcast of fewer than
    HOT_SHARE rows, the others by a join on the host, in which none is hot."""
    counted = materialize(document_counts(docs, host), "counts")
    verdicts = materialize(host_verdicts(host_rates(counted)), "verdicts")
    total = verdicts.agg(F.sum("n")).first()[0] or 0
    hot = F.col("n") * HOT_SHARE > total
    known = counted.join(F.broadcast(verdicts.where(hot).drop("n")), "host", "left")
    others = known.where("rejected is null").drop("rejected", "strict").join(verdicts.where(~hot).drop("n"), "host")
    both = known.where("rejected is not null").unionByName(others)
    failed = rules()
    unforgiven = F.lit(False)
    for name in SOFT:
        unforgiven = unforgiven | (failed[name] & F.array_contains("strict", name))
    reason = F.when(failed["base"], "base").when(F.col("rejected"), "host").when(unforgiven, "rule")
    return both.select("doc_id", "host", *COUNTS, failed["base"].alias("base_failed"), reason.isNull().alias("kept"), reason.alias("reason"))
