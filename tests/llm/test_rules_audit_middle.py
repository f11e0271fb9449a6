"""Host rules, filter audit and fill-in-middle against plain versions, with nulls, empty and long texts, ties, repeated rows,
empty tables and extra columns with clashing names."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from itertools import permutations
from math import isclose

import pytest
from pyspark.sql import functions as F

from gallerium.llm import fill_middle, filter_audit, host_rules, html_text, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows():
    rng = random.Random(11)
    pool = ["the", "a", "Über", "été", "漢字", "x y", "ROAD", "no#e", "50%", "<P", "P>", "<|", "end.", "𝒳z"]
    text = lambda n: "".join(rng.choice(pool) + rng.choice([" ", "\n", "\t", "  ", "\x0b", "\r\n"]) for _ in range(n))
    texts = [None, "", " \n\t ", "a", "a b", "a a a a", "<P>", "x<S>y", "q<M>", "#" * 400, "w" * 5000, "a b c " * 4000, "same line\n" * 90, "ABC " * 300]
    texts += [text(n) for n in (3, 30, 60, 60, 120, 250, 400, 2500)]
    texts += [" ".join(f"w{rng.randrange(10**6)}" for _ in range(n)) for n in (60, 80, 220, 300)]
    texts += texts[-6:] + texts[-6:] + [texts[4]]
    out = [(i, t, rng.choice(["h1", "h2", None, "", "h3"])) for i, t in enumerate(texts)]
    out += [(None, "no id", "h1"), (None, None, None), (None, texts[-2], "h2"), out[-2], out[-2], (5, "another text of 5", "h9")]
    return out + [(1000 + k, " ".join(f"v{rng.randrange(10**6)}" for _ in range(70)) + (" ###" * 30 if k < 80 else ""), "bad") for k in range(100)]


@pytest.fixture(scope="module")
def docs(spark):
    given = [(i, t, s, "en", 9, "clash", 3, 4, "5", True) for i, t, s in rows()]
    return spark.createDataFrame(given, "doc_id long, text string, source string, lang string, n long, host string, applied int, next int, words string, rejected boolean").repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string")


# Host rules


def plain_counts(text):
    words = WORD.findall(text or "")
    windows = Counter(zip(words, words[1:], words[2:]))
    repeated = {i + k for i, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for k in range(3)}
    lines = [line for line in (text or "").split("\n") if WORD.search(line)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(repeated), len(lines)


def plain_verdicts(judged):
    """The method over plain numbers: (doc_id, host, counts) to reasons."""

    def fails(c):
        n, chars, symbols, dup, again, lines = c
        return {"base": n < 50 or 100 * again > 50 * n, "symbols": 10 * symbols > n, "lines": 100 * dup > 30 * lines, "lengths": chars < 3 * n or chars > 10 * n}

    size, failed = Counter(h for _, h, _ in judged), defaultdict(Counter)
    for _, host, c in judged:
        for rule, bad in fails(c).items():
            failed[rule][host] += bad
    rates = defaultdict(dict)
    for rule, k in failed.items():
        total = sum(size.values())
        mean = sum(k.values()) / total
        between = sum(k[h] ** 2 / size[h] for h in size) - sum(k.values()) ** 2 / total
        noise, free = mean * (1 - mean), len(size) - 1
        below = noise * (total - sum(n * n for n in size.values()) / total - free)
        share = min(max((between - noise * free) / below if below else 0.0, 1e-6), 0.999)
        weight = 1 / share - 1
        for h in size:
            rates[h][rule] = (k[h] + mean * weight) / (size[h] + weight)
    out = []
    for doc, host, c in judged:
        bad = fails(c)
        if bad["base"]:
            out.append((doc, "base"))
        elif max(rates[host].values()) > host_rules.REJECT:
            out.append((doc, "host"))
        else:
            out.append((doc, "rule" if any(bad[r] and rates[host][r] >= host_rules.TRUST for r in host_rules.SOFT) else None))
    return out, rates


def test_host_rules(docs):
    got = host_rules.judge(docs).collect()
    counted = [(i, s or "", plain_counts(t)) for i, t, s in rows()]
    assert Counter((r.doc_id, r.host, tuple(r[c] for c in host_rules.COUNTS)) for r in got) == Counter(counted)
    want, _ = plain_verdicts(counted)
    assert Counter((r.doc_id, r.reason) for r in got) == Counter(want)
    assert {r for _, r in want} == {None, "base", "host", "rule"}  # each verdict occurs
    assert all(r.kept == (r.reason is None) and r.base_failed == (r.reason == "base") for r in got)


def test_host_rates_shrink(spark, docs):
    counted = host_rules.document_counts(docs)
    _, want = plain_verdicts([(i, s or "", plain_counts(t)) for i, t, s in rows()])
    for r in host_rules.host_rates(counted).collect():
        assert isclose(r.rate, want[r.host][r.rule], rel_tol=1e-9), (r.host, r.rule)


def test_a_small_host_is_not_judged_by_one_document(spark):
    """One document of marks: forgiven nowhere, but its host isn't rejected, as its rate stays near the corpus; a host full
    of them is. A lone failure at a host that is otherwise clean is forgiven."""
    rng = random.Random(3)
    clean = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(60))
    given = [(i, clean(), f"h{i % 20}") for i in range(4000)]
    given += [(5000 + i, clean() + " #" * 40, "junk") for i in range(60)] + [(6000, clean() + " #" * 40, "tiny"), (6001, clean(), "tiny"), (6002, clean(), "junk")]
    given += [(7000, clean() + " #" * 40, "h1")]
    got = {r.doc_id: r.reason for r in host_rules.judge(spark.createDataFrame(given, "doc_id long, text string, source string")).collect()}
    assert got[6002] == got[5000] == "host" and got[7000] is None
    assert got[6000] in ("rule", "host") and sum(r is not None for r in got.values()) <= 63


def test_host_rules_hot_and_cold_hosts_agree(docs, monkeypatch):
    want = Counter(map(tuple, host_rules.judge(docs).collect()))
    monkeypatch.setattr(host_rules, "HOT_SHARE", 4)  # most hosts go by the join
    assert Counter(map(tuple, host_rules.judge(docs).collect())) == want


def test_host_rules_of_nothing(spark, empty):
    assert host_rules.judge(empty).collect() == []
    one = spark.createDataFrame([(1, None, None)], "doc_id long, text string, source string")
    assert [(r.n_words, r.base_failed, r.kept) for r in host_rules.judge(one).collect()] == [(0, True, False)]


def test_repeated_words():
    for words in ("a a a", "a a a a", "a b c a b c", "a b c d a b c", "a b a b a b", "a b c d e", "", "a b"):
        data = words.encode()
        assert host_rules.counts_of(data) == plain_counts(words)


# Filter audit


def plain_audit(given, labels):
    text = [t or "" for _, t, _ in given]
    least = {}
    for (i, _, _), t in zip(given, text):
        if i is not None:
            least[t] = min(least.get(t, i), i)
    masks = []
    for (i, _, part), t in zip(given, text):
        w = WORD.findall(t)
        f = ("A" if len(w) < 200 else "") + ("B" if 100 * len(set(w)) < 50 * len(w) else "") + ("C" if 100 * len(re.findall("[A-Z]", t)) > 2 * len(t) else "")
        f += ("D" if re.search(r"[#$%&*|]", t) else "") + ("E" if i is not None and i > least[t] else "")
        masks.append((part or "", f, labels.get(i, (0, 0))))
    out, removed = {}, Counter()
    for part in {p for p, _, _ in masks}:
        own = [(f, label) for p, f, label in masks if p == part]
        for order in permutations("ABCDE"):
            left = own
            for step, name in enumerate(order, 1):
                here = [(f, label) for f, label in left if name in f]
                left = [(f, label) for f, label in left if name not in f]
                redundant = sum(name in f for f, _ in own) - len(here)
                out[part, "".join(order), step] = [len(left), len(here), redundant, sum(f == name for f, _ in own), sum(g == 1 for _, (g, _) in here), sum(x == 1 for _, (_, x) in here)]
                removed[part, name] += len(here)
    return {k: (*v, removed[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def label_frame(spark, given):
    return spark.createDataFrame(given, "doc_id long, quality int, toxic int, part string, first boolean, n int")


def test_filter_audit(spark, docs):
    rng = random.Random(5)
    known = {i: (rng.randrange(2), rng.randrange(2)) for i, _, _ in rows() if i is not None and rng.random() < 0.7}
    labels = label_frame(spark, [(i, q, t, "x", True, 2) for i, (q, t) in known.items()] + [(None, 1, 1, "x", True, 2), (next(iter(known)), 0, 0, "x", True, 2), (10**9, 1, 1, None, None, None)])
    got = {(r.part, r.filter_order, r.step): tuple(r[c] for c in (*filter_audit.COUNTS, "shapley")) for r in filter_audit.audit(docs, labels).collect()}
    assert got == plain_audit(rows(), known)


def test_filter_audit_has_a_row_a_part_order_and_step(spark, docs):
    parts = len({s or "" for _, _, s in rows()})
    assert filter_audit.audit(docs, label_frame(spark, [])).count() == parts * 600
    assert len(filter_audit.edges()) == 80 and len(filter_audit.steps()) == 600
    assert sum(through for _, _, through in filter_audit.edges()) == 600


def test_filter_audit_of_nothing(spark, empty):
    assert filter_audit.audit(empty, label_frame(spark, [])).collect() == []


# Fill in the middle


def plain_cut(doc, text):
    text = text or ""
    w = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if doc is None else doc}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc, len(w), "plain", None, None, text
    a, b = sorted((h[0] % (len(w) + 1), h[1] % (len(w) + 1)))
    p, m, s = ("".join(x) for x in (w[:a], w[a:b], w[b:]))
    form = "spm" if h[3] % 100 < 20 else "psm"
    return doc, len(w), form, len(p), len(m), f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}"


def test_fill_middle(docs):
    made = fill_middle.transform(docs)
    got = made.withColumn("restored", fill_middle.restored(F.col("form"), F.col("output"))).collect()
    want = Counter((*plain_cut(i, t), t or "") for i, t, _ in rows())
    assert Counter((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.restored) for r in got) == want
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_fill_middle_of_nothing(empty):
    assert fill_middle.transform(empty).collect() == []


@pytest.mark.parametrize("text", ["<", "<P", "P><", "<S<M", "a<P b<S>".replace(">", ""), "<<<>>>", "𝒳" * 50 + "abc" * 50, "\n\r\t" * 30, "é" * 9 + "z"])
def test_every_cut_is_found_and_restored(spark, text):
    """All pairs of cuts, with parts that end in the beginning of a mark."""
    data, w = text.encode(), re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    starts, _ = fill_middle.token_starts(data)
    at = [len("".join(w[:k]).encode()) for k in range(len(w))]
    assert starts.bit_count() == len(w) and [fill_middle.ranked_bit(starts, k, len(data)) for k in range(len(w))] == at
    cuts = [fill_middle.cut(data, (a, b, 0, form)) for a in range(min(len(w) + 1, 12)) for b in range(min(len(w) + 1, 12)) for form in (0, 50)]
    frame = spark.createDataFrame([(c[1], c[4].decode()) for c in cuts], "form string, output string")
    assert {r[0] for r in frame.select(fill_middle.restored(F.col("form"), F.col("output"))).collect()} == {text}


def test_ranked_bits_of_long_masks():
    rng = random.Random(1)
    places = sorted(rng.sample(range(300_000), 5000))
    mask = sum(1 << p for p in places)
    for k in (0, 1, 2500, 4998, 4999):
        assert fill_middle.ranked_bit(mask, k, 300_000) == places[k]


# Blocks and clauses


def test_comments_and_adverts_in_an_article_go_by_any_name():
    prose = "The article's own text goes on for a while, as it is about the things that were said to have been there before."
    for name in ("user-comments", "reader-comments", "comment-thread", "google-ad", "article__comments-list", "top-banner-ad"):
        page = f"<article><h1>On a title</h1><p>{prose}</p><div class='{name}'><p>{prose[::-1]}</p></div><p>{prose} End.</p></article>"
        assert html_text.main_text(page) == f"On a title {prose} {prose} End.", name
    for name in ("related-work", "has-sidebar", "no-ads", "comment-on-law", "commentary", "advertorial", "reading-list"):
        page = f"<article><p>{prose}</p><div class='{name}'><p>{prose} More.</p></div></article>"
        assert html_text.main_text(page) == f"{prose} {prose} More.", name


def test_a_long_text_may_speak_of_rights():
    prose = "The sign © is one that is set before the name of the one who has the right to a work, and it has been there for as long as there have been such rights in the laws of most of the states that are known to us."
    assert html_text.main_text(f"<body><div>{prose}</div><div>© 2020 The Owners of the Rights</div></body>") == prose


def test_html_rows_that_repeat_and_clashing_columns(spark):
    rows = [(1, "u", "<p>One and the same text.</p>", "x", 9)] * 3 + [(2, None, None, "x", 9), (3, "u", "", "x", 9)]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")).collect()
    assert Counter((r.page_id, r.text, r.n_chars) for r in got) == {(1, "One and the same text.", 22): 3, (2, "", 0): 1, (3, "", 0): 1}


CLASSES = toxicity.Classes(toxicity.given_lexicon())


def patterns(text):
    return {toxicity.PATTERNS[k] for k, n in enumerate(toxicity.features(text, CLASSES)) if n}


@pytest.mark.parametrize("text, want", [
    ("you are an idiot", {"insult at a target"}), ("idiot, you", {"insult at a target"}), ("what an idiot", {"insult named"}), ("that was stupid", {"insult named"}), ("the idiot box was on", {"insult of a thing"}),
    ("a stupid question", {"insult of a thing"}), ("Idiot!", {"lone insult"}), ("he said this idiot", {"insult denied or reported"}), ("no idiot", {"insult denied or reported"}), ("i will kill you", {"threat at a target", "threat announced"}),
    ("they could kill", {"threat at nobody", "threat announced"}), ("to kill time", {"threat at nobody"}), ("you are not only an idiot but a moron", {"insult at a target", "several of them"}),
    ("you are not an idiot", {"insult denied or reported"}), ("nothing of the kind", set()), ("", set()), (None, set()),
])
def test_clause_patterns(text, want):
    assert patterns(text) == want


def test_transducer_tables_equal_their_parts():
    """Composed tables against the parts one after the other, over random clauses."""
    t = toxicity
    forwards = [t.denied(), t.near(t.REPORT, "r", None, t.BOTH), t.near(t.TARGET + t.OBJECT, "t", 4, t.INSULT), t.near(t.OBJECT, "t", 2, t.THREAT), t.predicated(), t.near(t.ARTICLE + t.BEING, "p", 1, t.INSULT), t.near(t.MODAL, "m", 2, t.THREAT)]
    rng = random.Random(4)
    for _ in range(300):
        letters = "".join(rng.choices(t.LETTERS, k=rng.randrange(1, 30)))
        states, want = [p.start for p in forwards], []
        for letter in letters:
            symbol = letter
            for k, part in enumerate(forwards):
                states[k], symbol = part.step(states[k], symbol)
            want.append(symbol[1:])
        assert t.marks_of(letters, t._FORWARDS) == want


def test_toxicity_of_long_repeated_and_odd_rows(spark):
    rows = [(1, "you idiot " * 50_000, 1, "c", 0.5)] * 2 + [(2, None, 0, "c", 0.5), (3, "", 0, "c", 0.5), (None, "a quiet text", 0, "c", 0.5)] + [(k, "you are an idiot and a moron" if k % 2 else "a quiet day by the sea", k % 2, "c", 0.5) for k in range(10, 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int, stem string, score double")
    model = toxicity.learn(docs, docs.select("doc_id", "toxic").where("doc_id >= 10"))
    got = Counter((r.doc_id, r.predicted) for r in toxicity.score(docs.drop("score", "stem"), model).collect())
    assert got[(1, 1)] == 2 and got[(2, 0)] == got[(3, 0)] == got[(None, 0)] == 1 and sum(n for (d, p), n in got.items() if d and d >= 10 and p == d % 2) == 50
    assert toxicity.score(docs.limit(0), model).collect() == []
