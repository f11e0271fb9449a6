"""Fill-in-middle by bit-parallelism over big integers.

A text's UTF-8 bytes become integers with a bit a byte: bytes.translate writes the digits of a class mask. A token, a run of
ASCII letters or one other code point, starts at each first byte of a character but for letters that follow a letter; that is
two masks, a shift and two boolean operations. Their bit_count is the number of tokens, and halving the integer again and again
finds the bit of a rank, all in time linear in the text.

The cut points and the form are a fixed function of doc_id, so a recomputed task gives the same rows. Null texts count as empty
and a null doc_id as an empty string; rows that repeat are cut each, an empty table stays empty, and other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN_FROM, SPM_BELOW = 90, 20  # of 100
_LETTERS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_LETTER_DIGITS = bytes(b"01"[c in _LETTERS] for c in range(256))
_FIRST_DIGITS = bytes(b"10"[0x80 <= c < 0xC0] for c in range(256))


def class_mask(data: bytes, digits: bytes) -> int:
    """The integer whose bit i is the class of byte i."""
    return int(data.translate(digits)[::-1], 2) if data else 0


def token_starts(data: bytes) -> tuple[int, int]:
    """Masks of the bytes that begin a token, and of those that begin a character."""
    letters, first = class_mask(data, _LETTER_DIGITS), class_mask(data, _FIRST_DIGITS)
    return first ^ (letters & (letters << 1)), first


def ranked_bit(mask: int, rank: int, width: int) -> int:
    """The position of the set bit with `rank` set bits below it, in a mask of `width` bits."""
    at = 0
    while width > 1:
        half = width // 2
        low = mask & ((1 << half) - 1)
        below = low.bit_count()
        if rank < below:
            mask, width = low, half
        else:
            mask, width, rank, at = mask >> half, width - half, rank - below, at + half
    return at


def cut(data: bytes, draws: tuple[int, int, int, int]) -> tuple[int, str, int | None, int | None, bytes]:
    """(tokens, form, characters of the prefix and of the middle, output) of one text; `draws` are four random integers."""
    starts, first = token_starts(data)
    n = starts.bit_count()
    if not data or draws[2] % 100 >= PLAIN_FROM or any(mark.encode() in data for mark in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, data
    a, b = (ranked_bit(starts, k, len(data)) if k < n else len(data) for k in sorted((draws[0] % (n + 1), draws[1] % (n + 1))))
    form = "spm" if draws[3] % 100 < SPM_BELOW else "psm"
    parts = (PREFIX.encode(), data[:a]), (SUFFIX.encode(), data[b:])
    ordered = parts if form == "psm" else parts[::-1]
    output = b"".join([*ordered[0], *ordered[1], MIDDLE.encode(), data[a:b]])
    before, through = ((first & ((1 << end) - 1)).bit_count() for end in (a, b))
    return n, form, before, through - before, output


def draws_of(key: Column) -> Column:
    """Four integers of 32 bits from the SHA-256 of `1:` and the key."""
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return F.array(*[F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)])


def transform(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, n, form, prefix_chars, middle_chars, output) of each row of `docs` (key, text)."""
    kind = docs.schema[key].dataType.simpleString()

    def make():
        def step(batch):
            rows = [cut(text.as_py() or b"", tuple(draws.as_py())) for text, draws in zip(batch.column(2), batch.column(1))]
            n, form, before, middle, output = zip(*rows) if rows else ([],) * 5
            yield {key: batch.column(0), "n": n, "form": form, "prefix_chars": before, "middle_chars": middle, "output": output}

        return step

    rows = docs.select(F.col(key), draws_of(F.col(key)).alias("__draws"), F.col("text").cast("binary").alias("__text"))
    made = arrow_map(rows, f"`{key}` {kind}, n long, form string, prefix_chars long, middle_chars long, output binary", make)
    return made.withColumn("output", F.col("output").cast("string"))


def restored(form: Column, output: Column) -> Column:
    """The text that an output was made from. A mark can't straddle a part's end, as it begins with a sign that is nowhere
    else in it, so the first mark is the one that was put there."""

    def after(text: Column, head: Column) -> Column:
        return F.substring(text, F.length(head) + len(MIDDLE) + 1, F.length(text))

    body = F.substring(output, F.lit(len(PREFIX) + 1), F.length(output))
    one = F.when(form == "psm", F.substring_index(body, SUFFIX, 1)).otherwise(F.substring_index(body, PREFIX, 1))
    rest = after(body, one)
    two = F.substring_index(rest, MIDDLE, 1)
    middle = after(rest, two)
    return F.when(form == "plain", output).when(form == "psm", F.concat(one, middle, two)).otherwise(F.concat(two, middle, one))
