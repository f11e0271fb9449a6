"""Text functions as column expressions. The tokenisers stay apart on purpose: they differ in folding and in stop words."""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Callable, Iterable

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no meaning in a query, and words that count as one idea.
STOP_WORDS = "a an and at by for from in of on the to with image art artwork painting".split()
SYNONYM_GROUPS = (
    "escape escaping escaped liberation deliverance release released releases rescue rescued free freed".split(),
    "prison prisoner imprisoned jail cell captivity".split(),
    "wisdom sophia".split(),
    "engraving engraved etching etched print".split(),
    "teaching teach teacher instructing instruction".split(),
)
FUZZY_STOP_WORDS = "a an and at by for from in of on the to with image photo picture art artwork mot va cua cho trong tren voi hinh anh".split()


def _decompositions() -> tuple[str, str, str, dict[str, str]]:
    """Marks to drop; characters whose compatibility decomposition has one ASCII letter or digit, and these; and those whose
    decomposition has more, with it."""
    marks, one, many = [], {}, {}
    for point in range(0x80, 0x110000):
        if 0xD800 <= point < 0xE000:
            continue
        c = chr(point)
        bare = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if not bare:
            marks.append(c)
        elif bare != c and any(x.isascii() and x.isalnum() for x in bare):
            (one if len(bare) == 1 else many)[c] = bare
    return "".join(marks), "".join(one), "".join(one.values()), many


MARKS, ACCENTED, PLAIN, LIGATURES = _decompositions()


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """`then` of a value that is computed once a row, however often `then` uses it."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _opened(text: Column) -> Column:
    """Characters of several letters (ligatures, fractions) as these letters. Few texts have one: they show in what is left
    without ASCII, and only these are rebuilt one character at a time."""
    rare = F.regexp_replace(text, r"[\x00-\x7F]+", "")
    known = F.str_to_map(F.lit("\n".join(f"{c}\t{letters}" for c, letters in LIGATURES.items())), F.lit("\n"), F.lit("\t"))
    rebuilt = F.array_join(F.transform(F.split(text, ""), lambda c: F.coalesce(F.element_at(known, c), c)), "")
    return F.when(F.length(F.translate(rare, "".join(LIGATURES), "")) < F.length(rare), rebuilt).otherwise(text)


def fold_tokens(text: Column | str) -> Column:
    """Lower-case ASCII words and numbers of a text in compatibility form without marks; letters that don't decompose to
    ASCII part words. Texts in ASCII, which have as many characters as bytes, need no decomposition."""
    text = F.coalesce(_col(text).cast("string"), F.lit(""))
    bare = F.when(F.octet_length(text) == F.length(text), text).otherwise(F.translate(_opened(text), ACCENTED + MARKS, PLAIN))
    return F.regexp_extract_all(F.lower(bare), F.lit("([a-z0-9]+)"), F.lit(1))


def fold(text: Column | str) -> Column:
    return F.array_join(fold_tokens(text), " ")


def fold_exact_py(text: object) -> str:
    """The same for any script, by full compatibility decomposition."""
    bare = "".join(c for c in unicodedata.normalize("NFKD", str(text or "")) if not unicodedata.combining(c))
    return " ".join(re.findall("[a-z0-9]+", bare.lower()))


_BARE = str.maketrans(ACCENTED, PLAIN, MARKS)


def bare_py(word: str) -> str:
    """A lower-case word of any script without marks, and with ASCII letters where they decompose to one."""
    return word.lower().translate(_BARE).lower()


def word_tokens_py(text: object) -> list[str]:
    """Words of any script as a query's: compatibility form, folded case, runs of letters, digits and underscores."""
    return re.findall(r"\w+", unicodedata.normalize("NFKC", str(text or "")).casefold())


def by_text(function: Callable[[str | None], object], kind: str):
    """A vectorised function of a text column by a function of one text. Texts become Python's one by one, so that a task holds
    a batch as Arrow has it and one text of it besides."""
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import DataType

    arrow = to_arrow_type(DataType.fromDDL(kind))

    @F.arrow_udf(kind)
    def run(text: pa.Array) -> pa.Array:
        return pa.array((function(t.as_py()) for t in text), arrow)

    return run


def fold_exact(text: Column | str) -> Column:
    def run(values: pd.Series) -> pd.Series:
        return values.map(fold_exact_py)

    return F.pandas_udf(run, "string")(_col(text))


def terms(words: Column, stop_words: Iterable[str] = STOP_WORDS) -> Column:
    """The set of meaningful words among folded ones: longer than one character, no stop word."""
    return F.array_except(F.filter(words, lambda t: F.length(t) > 1), F.array(*map(F.lit, stop_words)))


def tokens(text: Column | str, stop_words: Iterable[str] = STOP_WORDS) -> Column:
    return terms(fold_tokens(text), stop_words)


def query_tokens(query: str, stop_words: Iterable[str] = STOP_WORDS) -> list[str]:
    return sorted({t for t in fold_exact_py(query).split() if len(t) > 1} - set(stop_words))


def concept_of(token: str) -> list[str]:
    return next((g for g in SYNONYM_GROUPS if token in g), [token])


def concepts(query: str) -> list[list[str]]:
    """The ideas of a query: synonyms are one."""
    return [list(x) for x in dict.fromkeys(tuple(concept_of(t)) for t in query_tokens(query))]


def matched(query: str, field_tokens: Column) -> Column:
    """The query's words that a field holds, themselves or by a synonym. The field is met once, with all synonyms."""
    words = query_tokens(query)
    if not words:
        return F.array().cast("array<string>")
    every = F.array(*map(F.lit, dict.fromkeys(s for t in words for s in concept_of(t))))
    found = lambda held: [F.when(F.arrays_overlap(held, F.array(*map(F.lit, concept_of(t)))), F.lit(t)) for t in words]
    return let(F.array_intersect(every, field_tokens), lambda held: F.array_compact(F.array(*found(held))))


def coverage(query: str, field_tokens: Column) -> Column:
    """The share of the query's words that a field holds; 0 for an empty query."""
    n = len(query_tokens(query))
    return F.size(matched(query, field_tokens)) / F.lit(float(n)) if n else F.lit(0.0)


def phrase_tokens(text: Column | str) -> Column:
    """Runs of letters, marks and digits of any script, lower-case, joined by spaces."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(_col(text).cast("string"), F.lit(""))), r"[^\p{L}\p{M}\p{N}]+", " "))


def contains_phrase(text: Column | str, phrase: str) -> Column:
    """Whether a phrase is a run of whole words of a field."""
    needle = " ".join(re.findall(r"\w+", unicodedata.normalize("NFKC", phrase).casefold()))
    return F.concat(F.lit(" "), phrase_tokens(text), F.lit(" ")).contains(f" {needle} ")


def matches_phrases(fields: Iterable[str], phrases: Iterable[str]) -> Column:
    """Every phrase is in one of the fields; a phrase never spans fields."""
    fields = list(fields)
    out = F.lit(True)
    for phrase in phrases:
        one = F.lit(False)
        for field in fields:
            one = one | contains_phrase(field, phrase)
        out = out & one
    return out


def page_terms(*fields: Column | str) -> Column:
    return F.array_sort(F.array_distinct(F.flatten(F.array(*[fold_tokens(f) for f in fields]))))


def has_all_terms(terms: Column, query: str, stop_words: Iterable[str] = STOP_WORDS) -> Column:
    """All query words but stop words are among the terms; an empty query is met."""
    wanted = [t for t in dict.fromkeys(fold_exact_py(query).split()) if t not in set(stop_words)]
    return F.size(F.array_except(F.array(*map(F.lit, wanted)), terms)) == 0 if wanted else F.lit(True)


def clean_url(url: Column | str) -> Column:
    return F.regexp_replace(F.trim(_col(url)), "^http://", "https://")


def canonical_url(url: Column | str) -> Column:
    """Scheme and authority lower-case, no trailing slash, query or fragment; empty stays empty."""
    url = F.coalesce(_col(url), F.lit(""))
    base = F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), r"/+$", "")
    head = F.regexp_extract(base, r"^([^/]*//[^/]*)", 1)
    return F.concat(F.lower(head), F.substring(base, F.length(head) + 1, F.lit(1 << 30)))


def host_matches(host: Column, domain: str) -> Column:
    return (F.lower(host) == domain) | F.lower(host).endswith(f".{domain}")


def strip_tags(markup: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(_col(markup), F.lit("")), "<[^>]*>", " "), r"\s+", " "))


def _unescaped(values: pd.Series) -> pd.Series:
    return values.map(html.unescape, na_action="ignore")


def plain_text(markup: Column | str) -> Column:
    """A text without tags, its character references decoded; null stays null."""
    return F.trim(F.pandas_udf(_unescaped, "string")(F.regexp_replace(_col(markup), "<[^>]+>", "")))


TRUE_WORDS = ("1", "true", "yes", "on")  # fixed values, as the next line
LEAST_LIMIT, MOST_LIMIT, DEFAULT_LIMIT = 1, 24, 12


def validate_limit(raw: object) -> int:
    """How many results are wanted; none given means the default."""
    if raw in (None, ""):
        return DEFAULT_LIMIT
    try:
        limit = int(raw)
    except (TypeError, ValueError):
        raise ValueError("the limit isn't a number") from None
    if limit not in range(LEAST_LIMIT, MOST_LIMIT + 1):
        raise ValueError(f"the limit is {LEAST_LIMIT} to {MOST_LIMIT}")
    return limit


def is_true(value: Column | str) -> Column:
    """Whether a written flag is set; anything else, and null, is not."""
    return F.coalesce(F.lower(F.trim(_col(value).cast("string"))).isin(*TRUE_WORDS), F.lit(False))


def safe_int(value: Column | str) -> Column:
    return F.coalesce(F.greatest(_col(value).try_cast("int"), F.lit(0)), F.lit(0))


def parse_query(raw: str, exact: bool = False) -> dict:
    """A query's free text and quoted phrases. A quote that isn't closed is an error; with `exact` all free text is one phrase."""
    closing = {'"': '"', "“": "”", "„": "“"}
    free, phrases, at = [], [], 0
    while at < len(raw):
        if raw[at] in closing:
            end = raw.find(closing[raw[at]], at + 1)
            if end < 0:
                raise ValueError("a quotation mark isn't closed")
            if phrase := raw[at + 1 : end].strip():
                phrases.append(phrase)
            at = end + 1
        else:
            nxt = min([k for q in closing if (k := raw.find(q, at)) >= 0], default=len(raw))
            free.append(raw[at:nxt])
            at = nxt
    text = " ".join(" ".join(free).split())
    if exact and text:
        phrases.append(text)
    return {"raw": raw, "retrieval": " ".join([text, *[p for p in phrases if p != text]]).strip(), "phrases": phrases, "exact": exact or bool(phrases)}


def validate_query(raw: str | None, most: int = 240) -> str:
    text = " ".join((raw or "").split())
    if not text or len(text) > most:
        raise ValueError(f"a query has 1 to {most} characters")
    return text


def indel_ratio(a: str, b: str) -> float:
    """100 * 2 * LCS / (len a + len b), the normalised insertion-deletion similarity; two empty strings are equal."""
    if not a and not b:
        return 100.0
    places: dict[str, int] = {}
    for k, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << k
    open_, whole = (1 << len(a)) - 1, (1 << len(a)) - 1
    for c in b:  # zeros of the row are the letters of a that a longest common subsequence with b so far ends with
        met = open_ & places.get(c, 0)
        open_ = ((open_ + met) | (open_ - met)) & whole
    return 200.0 * (len(a) - open_.bit_count()) / (len(a) + len(b))


def token_set_ratio(a: str, b: str) -> float:
    """The best ratio among the common words and what either side adds to them."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, left, right = sorted(x & y), sorted(x - y), sorted(y - x)
    if both and (not left or not right):
        return 100.0
    s, sa, sb = " ".join(both), " ".join([*both, *left]), " ".join([*both, *right])
    return max(indel_ratio(sa, sb), indel_ratio(s, sa) if both else 0.0, indel_ratio(s, sb) if both else 0.0)
