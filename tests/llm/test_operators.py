"""Each operator against a brute-force version, with nulls, empty and long texts, ties, repeated rows, empty tables and extra
columns with clashing names."""

import hashlib
import html
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from gallerium.llm import avi, bpe, chat, common, html_text, language, minhash_join, order_minhash, packing, queries, suffix_dedup, toxicity

SYLLABLES = "the an re er in tion ou ha nd st ble é ñ ß 漢".split()


def prose(rng, words):
    return " ".join("".join(rng.choices(SYLLABLES, k=rng.randint(1, 4))) for _ in range(words))


def fixture_rows():
    rng = random.Random(5)
    base = [prose(rng, n) for n in (5, 40, 90, 200, 400, 3000)]
    texts = [None, "", "   \n\t ", "a", "Ab aB ab", "x" * 900, "ab" * 300, *base, base[2], base[2], base[3]]
    for k in range(12):  # near copies
        words = base[3].split()
        for _ in range(k % 4):
            words[rng.randrange(len(words))] = "changed"
        texts.append(" ".join(words))
    passage = prose(rng, 60)
    texts += [prose(rng, 30) + " " + passage + " " + prose(rng, k) for k in range(6)]
    return [(i, t) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "xx", "s", 1, 2, "c") for i, t in fixture_rows()]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, did long, component long, spans string").repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.vocabulary())


def components_of(rows, words, percent):
    def shingles(text):
        found = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return {tuple(found[i : i + words]) for i in range(max(1, len(found) - words + 1))} if found else set()

    sets = {i: shingles(t) for i, t in rows}
    label = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if label[a] < label[b] and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                    label[b], changed = label[a], True
    return {i: (len(sets[i]), label[i]) for i in sets}


@pytest.mark.parametrize("words,percent", [(3, 85), (5, 80)])
def test_near_duplicates(docs, words, percent):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash_join.components(docs, words, percent).collect()}
    assert got == components_of(fixture_rows(), words, percent)


def test_near_duplicates_in_dense_and_large_groups(spark, monkeypatch):
    """Small limits send every group through branching, salted parts and edge-wise confirmation."""
    rng = random.Random(2)
    base = prose(rng, 120).split()
    rows = []
    for i in range(150):
        words = list(base)
        for _ in range(i % 3):
            words[rng.randrange(len(words))] = f"w{i}"
        rows.append((i, " ".join(words)))
    want = components_of(rows, 3, 85)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    for name, value in (("LEAF", 8), ("PART", 20), ("CLUSTER_SETS", 10), ("STAR", 7)):
        monkeypatch.setattr(minhash_join, name, value)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash_join.components(frame, 3, 85).collect()}
    assert got == want


def test_large_clusters_lose_no_link(spark, monkeypatch):
    """Chains just above and just below the threshold, in clusters that are all too large for a task."""
    rng = random.Random(4)
    rows = []
    for chain in range(4):
        words = [f"c{chain}w{k}" for k in range(60)]
        for _ in range(40):
            rows.append((len(rows), " ".join(words)))
            for k in rng.sample(range(60), rng.choice([1, 1, 2])):
                words[k] = f"x{rng.randrange(10**9)}"
    rng.shuffle(rows)
    rows = [(k, t) for k, (_, t) in enumerate(rows)]
    for name, value in (("CLUSTER_SETS", 3), ("QUERY_SETS", 7), ("SLICE_SETS", 11), ("QUERY_SHINGLES", 900), ("LEAF", 8), ("PART", 20)):
        monkeypatch.setattr(minhash_join, name, value)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash_join.components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()}
    assert got == components_of(rows, 3, 85)


@pytest.mark.parametrize("percent, path", [(80, "task"), (85, "blocks")])
def test_near_duplicates_of_low_estimate(spark, monkeypatch, percent, path):
    rng = random.Random(percent)
    low = round(64 * (percent / 100 - 0.13)) - 1  # equal tokens of about one in a few hundred pairs at the threshold
    while True:
        words = [f"w{rng.getrandbits(40)}" for _ in range(120)]
        other = [*words[: 110 if percent == 85 else 107], *(f"w{rng.getrandbits(40)}" for _ in range(9 if percent == 85 else 12))]
        pair = [" ".join(words), " ".join(other)]
        a, b = (minhash_join.shingle_set(t, 3) for t in pair)
        if minhash_join.similar(a, b, percent) and (minhash_join.min_tokens(a) == minhash_join.min_tokens(b)).sum() <= low:
            break
    if path == "blocks":
        monkeypatch.setattr(minhash_join, "CLUSTER_SETS", 1)
        monkeypatch.setattr(minhash_join, "confirmed", lambda texts, members, edges, *_: edges.limit(0))
    frame = spark.createDataFrame(list(enumerate(pair)), "doc_id long, text string")
    assert {r.component_id for r in minhash_join.components(frame, 3, percent).collect()} == {0}


def test_near_duplicates_empty_null_id_and_repeats(spark, empty):
    assert minhash_join.components(empty).count() == 0
    frame = spark.createDataFrame([(None, "a b c d e"), (3, "a b c d e"), (3, "a b c d e"), (4, None)], "doc_id long, text string")
    got = Counter((r.doc_id, r.component_id, r.kept) for r in minhash_join.components(frame).collect())
    assert got == Counter({(None, 3, None): 1, (3, 3, True): 2, (4, 4, True): 1})


def test_near_duplicates_of_one_doc_id(spark):
    """Texts that share a doc_id only aren't linked; their groups tell them apart."""
    texts = [" ".join(f"{k}w{i}" for i in range(30)) for k in range(3)]
    rows = [(5, texts[0]), (5, texts[1]), (7, texts[1]), (9, texts[0] + " more"), (9, texts[2]), (2, texts[2]), (5, ""), (5, None)]
    got = minhash_join.components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    groups = defaultdict(list)
    for r in got:
        groups[r.link_group].append((r.doc_id, r.n_shingles, r.component_id, r.kept))
    assert sorted(sorted(g) for g in groups.values()) == [[(2, 26, 2, True), (9, 26, 2, False)], [(5, 0, 5, True), (5, 0, 5, True)], [(5, 26, 5, True), (7, 26, 5, False)], [(5, 26, 5, True), (9, 27, 5, False)]]


@pytest.mark.parametrize("percent, cluster", [(85, 1024), (80, 1024), (80, 1)])
def test_near_duplicates_at_the_threshold(spark, monkeypatch, percent, cluster):
    """Isolated pairs exactly at the threshold, of which a tree's nodes or an estimate could lose some."""
    monkeypatch.setattr(minhash_join, "CLUSTER_SETS", cluster)
    rng = random.Random(percent)
    common_words, own = (170, 15) if percent == 85 else (160, 20)  # a shingle of one word: 170 / 200 and 160 / 200
    rows = []
    for _ in range(700):
        words = [f"w{rng.getrandbits(48)}" for _ in range(common_words + 2 * own)]
        rows += [(len(rows), " ".join(words[: common_words + own])), (len(rows) + 1, " ".join(words[:common_words] + words[common_words + own :]))]
    got = {r.doc_id: r.component_id for r in minhash_join.components(spark.createDataFrame(rows, "doc_id long, text string"), 1, percent).collect()}
    assert got == {i: i - i % 2 for i, _ in rows}


def test_connected_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(160)] + [(k, k + 1) for k in range(1000, 1100)]
    label = {x: x for e in edges for x in e if e[0] != e[1]}
    for _ in range(200):
        for a, b in edges:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    got = {r.node: r.component for r in common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == label


def removed(texts):
    seen = Counter(t[p : p + 200] for t in texts for p in range(len(t) - 199))
    out = []
    for t in texts:
        mask = bytearray(len(t))
        for p in range(len(t) - 199):
            if seen[t[p : p + 200]] > 1:
                mask[p : p + 200] = b"\1" * 200
        spans = len(re.findall(b"\1+", bytes(mask)))
        out.append((len(t), sum(mask), spans, bytes(b for b, m in zip(t, mask) if not m)))
    return out


@pytest.mark.parametrize("hot,block", [(2048, 4 << 20), (1, 1000)])
def test_suffix_dedup(docs, monkeypatch, hot, block):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(suffix_dedup, "BLOCK", block)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.remove_repeats(docs).collect()}
    rows = fixture_rows()
    assert got == dict(zip((i for i, _ in rows), removed([(t or "").encode() for _, t in rows])))


def test_suffix_dedup_edges(spark, empty):
    assert suffix_dedup.remove_repeats(empty).count() == 0
    text = prose(random.Random(3), 90)
    frame = spark.createDataFrame([(1, text), (1, text), (None, text + "!")], "doc_id long, text string")
    assert {(r.n_removed, bytes(r.kept)) for r in suffix_dedup.remove_repeats(frame).collect()} == {(len(text.encode()), b""), (len(text.encode()), b"!")}


def test_suffix_dedup_copies_read_in_any_order(spark):
    rng = random.Random(21)
    passages, bodies = [prose(rng, 60) for _ in range(4)], [prose(rng, 40) for _ in range(8)]
    copied = [f"{bodies[k]} {passages[k]} {bodies[k + 4]}" for k in range(4)]
    alone = [f"{prose(rng, 20)} {p} {prose(rng, 20)}" for p in passages]  # each shares a passage with one copied text only
    ids = [(90, 5, 3), (80, None), (None, 70), (60, 61)]
    rows = [(i, t) for t, group in zip(copied, ids) for i in group] + [(20 - k, t) for k, t in enumerate(alone)]
    want = sorted((i or 0, *w) for (i, _), w in zip(rows, removed([t.encode() for _, t in rows])))
    assert [w[2] > 200 for w in want].count(True) == len(rows)
    for frame in (spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), spark.createDataFrame(rows[::-1], "doc_id long, text string").repartition(3)):
        assert sorted((r.doc_id or 0, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.remove_repeats(frame).collect()) == want


def test_repeated_suffixes_of_any_residue():
    rng = random.Random(8)
    piece = bytes(rng.randrange(4) for _ in range(230))
    text = b"".join(bytes(rng.randrange(4) for _ in range(rng.randrange(9))) + piece + b"\xff" for _ in range(9))
    at = np.arange(len(text) - 199)
    count = Counter(text[p : p + 200] for p in at)
    assert suffix_dedup.repeated(np.frombuffer(text, dtype=np.uint8), at).tolist() == [count[text[p : p + 200]] > 1 for p in at]


def test_bpe(docs, empty):
    tokenizer = library()
    texts = {i: t or "" for i, t in fixture_rows()}
    for r in bpe.encode(docs, queries.vocabulary()).collect():
        ids = tokenizer.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert np.frombuffer(bytes(r.ids), dtype="<u4").tolist() == ids
        assert r.decoded == tokenizer.decode(ids, skip_special_tokens=False)
    assert bpe.encode(empty, queries.vocabulary()).count() == 0


@pytest.mark.parametrize("text", ["Hello <|endoftext|> it's 12 ÉÉ\x1cx ΟΔΟΣ İ ① ª² '' 'll<|startoftext|>", "é ​ x y DON'T \x00 \x85 ǅ ß 北京 한국어 👍🏽 a_b é", "", " 　"])
def test_bpe_odd_texts(text):
    (ids,) = coder_of(["hello", "it's", "don't"]).encode([text])
    assert np.frombuffer(ids, dtype="<u4").tolist() == library().encode(text, add_special_tokens=False).ids


def vocabulary_bytes():
    with open(queries.vocabulary(), "rb") as file:
        return file.read()


def coder_of(words):
    spec = vocabulary_bytes()
    return bpe.Encoder(spec, bpe.alphabet(), bpe.lexicon_of(words, spec))


def test_bpe_every_code_point():
    """Letters, numbers, spaces, marks and lower case are the library's, for all code points and in company."""
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    shown = lambda c: f"Ab{c}1x {c}'s e{c}\u0316\u0301 ." if ord(c) < 0x20000 else f"a{c}b"
    texts = [" ".join(map(shown, points[k : k + 64])) for k in range(0, len(points), 64)]
    coder, tokenizer = coder_of(["ab", "e"]), library()
    for s in range(0, len(texts), 1024):
        want = tokenizer.encode_batch(texts[s : s + 1024], add_special_tokens=False)
        for text, ids, w in zip(texts[s:], coder.encode(texts[s : s + 1024]), want):
            assert np.frombuffer(ids, dtype="<u4").tolist() == w.ids, text


@pytest.mark.parametrize("kind", ["random", "one letter", "words", "bytes"])
def test_bpe_long_pieces(kind):
    rng = random.Random(12)
    make = {"random": lambda n: "".join(rng.choices("abcdefghijklmnop", k=n)), "one letter": lambda n: "a" * n, "words": lambda n: "theandinger" * (n // 11), "bytes": lambda n: "".join(rng.choices("漢é🙂ßж", k=n))}[kind]
    coder, tokenizer = coder_of([]), library()
    texts = [make(n) for n in (250, 257, 3000, 100_000)] + [make(300) + " and " + make(1000)]
    for text, ids in zip(texts, coder.encode(texts)):
        assert np.frombuffer(ids, dtype="<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    list(coder.encode(["next"]))
    assert all(len(w) < bpe.LONG_PIECE for w in coder.ids)


def test_lexicon_is_minimal_and_exact():
    words = {w: [i, i + 1][: i % 3] for i, w in enumerate(sorted({a + b + c for a in "abc" for b in ("", "x", "é") for c in ("ing", "ed", "")}))}
    found = bpe.Lexicon(bpe.compile_lexicon(words))
    assert found.find([*words, "zz", "", "abcdef"]) == [*(np.array(x, dtype="<u4").tobytes() for x in words.values()), None, None, None]
    assert len(found.final) < len({w[:k] for w in words for k in range(len(w) + 1)})
    assert bpe.Lexicon(bpe.compile_lexicon({})).find(["a"]) == [None]


def test_frequent_words(spark, empty):
    texts = ["a a a b b c", "A b d e", None, "a f"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spec = vocabulary_bytes()
    assert {r.word: r.n for r in bpe.count_words(frame, spec).collect()} == {"a": 5, "b": 3, "c": 1, "d": 1, "e": 1, "f": 1}
    assert bpe.frequent_words(frame, spec) == ["a", "b"] and bpe.frequent_words(frame, spec, 1) == ["a"] and bpe.frequent_words(empty, spec) == []


def check_packing(rows, ids, window=2048):
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
        assert r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], dtype="<u4").tobytes())
    for key, own in pieces.items():
        at = 0
        for start, length in sorted(own):
            assert start == at and length > 0
            at += length
        assert at == len(ids[key])
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= window and at & (at - 1) == 0
    assert pieces.keys() == ids.keys()


def test_packing(docs, empty):
    tokenizer = library()
    ids = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, packing.END] for i, t in fixture_rows()}
    check_packing(packing.pack(docs, queries.vocabulary()).collect(), ids)
    assert packing.pack(empty, queries.vocabulary()).count() == 0


def test_packing_plan_places_every_token_once():
    rng = np.random.default_rng(4)
    histogram = rng.integers(0, 30, 65)
    histogram[0] = 0
    p = packing.plan(histogram, 64)
    first = np.searchsorted(p["segments"][:, 0], np.arange(66))
    used = defaultdict(list)
    for length in range(1, 65):
        for rank in range(histogram[length]):
            spots = packing.place(length, rank, p, first, 64)
            assert sum(c for _, c, _, _ in spots) == length
            for _, count, sequence, offset in spots:
                used[sequence].append((offset, count))
    for own in used.values():
        own.sort()
        assert own[0][0] == 0 and all(a + b == c for (a, b), (c, _) in zip(own, own[1:]))
        size = sum(own[-1])
        assert size == 64 or size & (size - 1) == 0
    solved = packing.solve(histogram, columns := packing.combinations(histogram, 64))
    assert (solved >= 0).all() and all(sum(k * n for k, n in c) == 64 for c in columns)


@pytest.mark.parametrize("window", [16, 40])
def test_packing_solves_the_least_squares(window):
    """Non-negative least squares: no count can be moved to lower the residual (the conditions of Karush, Kuhn and Tucker)."""
    rng = np.random.default_rng(window)
    for _ in range(5):
        histogram = rng.integers(0, 1000, window + 1)
        histogram[[0, window]] = 0
        columns = packing.combinations(histogram, window)
        matrix = np.array([[dict(c).get(k, 0) for c in columns] for k in range(window + 1)], dtype=float)
        x = packing.solve(histogram, columns)
        slope = matrix.T @ (matrix @ x - histogram)
        assert (x >= 0).all() and (slope > -8).all() and (np.abs(slope[x > 1e-9]) < 8).all()


def test_packing_places_most_by_combinations():
    rng = np.random.default_rng(9)
    histogram = np.bincount(np.clip(rng.lognormal(5, 1, 200_000).astype(int), 1, 2047), minlength=2049)
    p = packing.plan(histogram, 2048)
    placed = (p["segments"][:, 0] * p["segments"][:, 2]).sum() / (histogram * np.arange(2049)).sum()
    assert placed > 0.5


def test_packing_ranks_in_parts(docs, monkeypatch):
    monkeypatch.setattr(packing, "RANKED", 2)
    tokenizer = library()
    ids = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, packing.END] for i, t in fixture_rows()}
    check_packing(packing.pack(docs, queries.vocabulary()).collect(), ids)


def test_order_minhash(docs, empty, spark):
    rows = dict(fixture_rows())
    order = sorted(rows, reverse=True)
    following = dict(zip(order, [*order[1:], order[0]]))
    marks = {i: order_minhash.fingerprint(order_minhash.code_points(t or "")) for i, t in rows.items()}
    got = order_minhash.edited_fingerprints(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        text, after = rows[r.doc_id] or "", rows[following[r.doc_id]] or ""
        edited = text[: len(text) - len(text) // 3] + after[: len(text) // 3]
        assert (r.n_chars, r.fingerprint, r.edited_sha256) == (len(text), marks[r.doc_id], hashlib.sha256(edited.encode()).hexdigest())
        assert r.near_next == order_minhash.likeness(marks[r.doc_id], marks[following[r.doc_id]])
        assert r.near_edited == order_minhash.likeness(r.fingerprint, r.edited_fingerprint)
    assert order_minhash.edited_fingerprints(empty).count() == 0
    (alone,) = order_minhash.edited_fingerprints(spark.createDataFrame([(1, "abcdef")], "doc_id long, text string")).collect()
    assert alone.near_next == 1.0


def plain_fingerprint(text):
    """Order MinHash by the book, in whole numbers: no arrays."""
    mask = (1 << 64) - 1

    def mixed(x):
        x = ((x ^ x >> 30) * 0xBF58476D1CE4E5B9) & mask
        x = ((x ^ x >> 27) * 0x94D049BB133111EB) & mask
        return x ^ x >> 31

    if not text:
        return ""
    base, k = common._MULTIPLIER, min(order_minhash.K, len(text))
    kmers = [mixed(sum(mixed(ord(c)) * pow(base, j, 1 << 64) for j, c in enumerate(text[i : i + k])) & mask) for i in range(len(text) - k + 1)]
    seen, items = Counter(), []
    for x in kmers:
        items.append(mixed((x + seen[x] * 0x9E3779B97F4A7C15) & mask))
        seen[x] += 1
    out = ""
    for s, m in enumerate(order_minhash._MULTIPLIERS.tolist()):
        least = sorted(range(len(items)), key=lambda i: (items[i] * m & mask, i))[: order_minhash.ELL]
        value = s
        for i in sorted(least):
            value = mixed((value * 0x9E3779B97F4A7C15 + kmers[i]) & mask)
        out += f"{value >> 32:08x}"
    return out


def test_order_minhash_against_plain():
    rng = random.Random(6)
    for text in ["", "a", "abcde", "abcdef", "aaaaaaaaaa", "ab" * 50, "漢字🙂é" * 9, prose(rng, 60)]:
        assert order_minhash.fingerprint(order_minhash.code_points(text)) == plain_fingerprint(text)


def test_order_minhash_of_null_and_repeated_ids(spark):
    rows = [(None, f"text {k} without id") for k in range(40)] + [(3, "x y z"), (3, "x y z"), (3, "p q r"), (8, None), (1, "")] + [(None, None)] * 3
    got = order_minhash.edited_fingerprints(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    want = Counter((i, len(t or ""), plain_fingerprint(t or "")) for i, t in rows)
    assert Counter((r.doc_id, r.n_chars, r.fingerprint) for r in got) == want
    marks = Counter(plain_fingerprint(t or "") for _, t in rows)
    assert sum(r.near_next == 1.0 for r in got) <= sum(n for n in marks.values() if n > 1)  # each row has one other row after it


def test_order_minhash_follows_edits_and_order():
    rng = random.Random(3)
    words = prose(rng, 400).split()
    mark = lambda w: order_minhash.fingerprint(order_minhash.code_points(" ".join(w)))
    one, many, moved = list(words), list(words), words[200:] + words[:200]
    one[50] = "other"
    for k in range(0, 400, 4):
        many[k] = "other"
    base = mark(words)
    assert 1.0 == order_minhash.likeness(base, base) > order_minhash.likeness(base, mark(one)) > order_minhash.likeness(base, mark(many))
    assert order_minhash.likeness(base, mark(moved)) < order_minhash.likeness(base, mark(one))


def test_occurrence_numbers():
    values = np.array([7, 9, 7, 7, 9], dtype=np.uint64) << np.uint64(30)
    assert order_minhash.occurrence_numbers(values).tolist() == [0, 0, 1, 2, 1]


def test_language_filters_against_sets():
    rng = random.Random(14)
    letters = [chr(0x100 + k) for k in range(300)]
    names, members, texts = [], [], []
    for k in range(130):  # more languages than a slot has bits
        own = rng.sample(letters, 12)
        sample = [" ".join("".join(rng.choices(own, k=4)) for _ in range(60)) for _ in range(3)]
        names.append(f"l{k}")
        members.append(np.unique(np.concatenate([language.grams(t) for t in sample])))
        texts.append(sample[0])
    filters = language.Filters(names, members)
    for k, text in enumerate(texts):
        have = language.grams(text).tolist()
        share = [sum(x in own for x in have) / len(have) for own in (set(m.tolist()) for m in members)]
        found, score = filters.predict(text)
        assert found == names[k] == names[int(np.argmax(share))] and abs(score - max(share)) < 0.01


def test_language_learns_any_number(spark):
    rng = random.Random(15)
    rows = [(i, " ".join("".join(rng.choices([chr(0x400 + 3 * (i % 70) + j) for j in range(3)], k=4)) for _ in range(20)), f"l{i % 70}") for i in range(700)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    filters = language.learn(frame)
    assert len(filters.languages) == 70
    got = language.identify(frame.withColumn("lang_pred", F.lit("x")), filters, ["doc_id", "lang"]).collect()
    assert sum(r.lang == r.lang_pred for r in got) > 0.95 * len(rows)


def test_avi_round_trip(docs, empty):
    rows = dict(fixture_rows())
    for r in avi.read_media(avi.to_media(docs)).collect():
        data = (rows[r.doc_id] or "").encode()
        payload = avi.payload_of(data)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert [c.first_frame for c in r.clips] == sorted({c.first_frame for c in r.clips}) and sum(c.frames for c in r.clips) * 576 == len(payload)
    assert avi.clip_rows(avi.read_media(avi.to_media(docs))).count() >= len(rows)
    assert avi.read_media(avi.to_media(empty)).count() == 0


def test_avi_samples_and_shots():
    rng = np.random.default_rng(1)
    samples = rng.integers(0, 256, (7, 576)).astype(np.uint8)
    samples[0], samples[1] = 255, 0
    film = avi.read_avi(avi.write_avi(avi.encode_frames(samples)))
    assert (film["width"], film["height"], film["rate"]) == (24, 24, 25)
    assert (np.array(avi.decode_frames(film["frames"])) == samples).all()
    scene = np.concatenate([np.full((20, 576), 30), np.full((15, 576), 200), np.full((9, 576), 90)]).astype(np.uint8)
    assert avi.shots(scene) == [0, 20, 35]
    with pytest.raises(ValueError):
        avi.read_avi(b"RIFFxxxxWAVE")


BYTE_CODES = bytes([0] * 7 + [255] + [0] * 8) + bytes(range(255))  # each symbol below 255 is its own code of eight bits


def segment(mark, body):
    return bytes([255, mark]) + (len(body) + 2).to_bytes(2, "big") + body


def scan_bytes(bits):
    bits += "1" * (-len(bits) % 8)
    return int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\x00")


def signed_bits(value):
    size = abs(value).bit_length()
    return size, format(value if value > 0 else value + (1 << size) - 1, f"0{size}b") if size else ""


@pytest.mark.parametrize("sampling, restart", [([(1, 1)], 0), ([(2, 2), (1, 1), (1, 1)], 0), ([(1, 1), (1, 1), (1, 1)], 2), ([(2, 1), (1, 1)], 1)])
def test_avi_reads_foreign_baseline_frames(sampling, restart):
    """Frames by a plain encoder of our own for the test: other tables, markers, sampling and restarts."""
    rng = np.random.default_rng(5)
    height, width = 21, 37
    wide, high = max(h for h, _ in sampling), max(v for _, v in sampling)
    down, across = -(-height // (8 * high)), -(-width // (8 * wide))
    y, x = np.mgrid[: down * high * 8, : across * wide * 8]
    luma = np.clip(128 + 60 * np.sin(x / 5) + 40 * np.cos(y / 4) + rng.integers(-9, 9, x.shape), 0, 255)
    planes = [luma, *(np.full((down * v * 8, across * h * 8), 90.0) for h, v in sampling[1:])]
    wave = np.array([[(0.125**0.5 if u == 0 else 0.5) * np.cos((2 * k + 1) * u * np.pi / 16) for u in range(8)] for k in range(8)])
    order = sorted(range(64), key=lambda k: (k // 8 + k % 8, k // 8 if (k // 8 + k % 8) % 2 else k % 8))
    scans, bits, before = [], "", [0] * len(sampling)
    for unit in range(down * across):
        if restart and unit and unit % restart == 0:
            scans.append(scan_bytes(bits))
            bits, before = "", [0] * len(sampling)
        for n, (h, v) in enumerate(sampling):
            for k in range(h * v):
                top, left = 8 * (unit // across * v + k // h), 8 * (unit % across * h + k % h)
                block = np.round(wave.T @ (planes[n][top : top + 8, left : left + 8] - 128) @ wave / 2).astype(int).ravel()[order].tolist()
                size, more = signed_bits(block[0] - before[n])
                before[n] = block[0]
                bits += format(size, "08b") + more
                zeros = 0
                for value in block[1:]:
                    if value:
                        bits += "11110000" * (zeros // 16)
                        size, more = signed_bits(value)
                        bits += format(zeros % 16 * 16 + size, "08b") + more
                        zeros = 0
                    else:
                        zeros += 1
                if zeros:
                    bits += "00000000"
    scans.append(scan_bytes(bits))
    data = b"".join(s + bytes([255, 0xD0 + k % 8]) for k, s in enumerate(scans[:-1])) + scans[-1]
    n = len(sampling)
    frame = b"\xff\xd8" + segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0") + segment(0xFE, b"\xff\xda") + segment(0xDB, bytes([0]) + bytes([2] * 64))
    frame += segment(0xC0, bytes([8, 0, height, 0, width, n]) + b"".join(bytes([k + 1, h << 4 | v, 0]) for k, (h, v) in enumerate(sampling)))
    frame += segment(0xC4, b"\x00" + BYTE_CODES + b"\x11" + BYTE_CODES) + segment(0xDD, bytes([0, restart]))
    frame += segment(0xDA, bytes([n]) + b"".join(bytes([k + 1, 0x01]) for k in range(n)) + bytes([0, 63, 0])) + data + b"\xff\xd9"
    (found,) = avi.decode_frames([frame])
    assert np.abs(found.reshape(height, width) - luma[:height, :width]).max() <= 6


@pytest.mark.parametrize("predictor", [1, 2, 3, 4, 5, 6, 7])
def test_avi_reads_foreign_lossless_frames(predictor):
    rng = np.random.default_rng(predictor)
    frames, want = [], []
    for _ in range(3):
        grid = rng.integers(0, 256, (5, 7)).tolist()
        bits = ""
        for y in range(5):
            for x in range(7):
                a, b, c = grid[y][x - 1], grid[y - 1][x], grid[y - 1][x - 1]
                guess = [a, b, c, a + b - c, a + (b - c >> 1), b + (a - c >> 1), a + b >> 1][predictor - 1] if x and y else a if x else b if y else 128
                size, more = signed_bits(grid[y][x] - guess)
                bits += format(size, "08b") + more
        want.append(np.array(grid).ravel())
        frames.append(b"\xff\xd8" + segment(0xC4, b"\x01" + BYTE_CODES) + segment(0xC3, bytes([8, 0, 5, 0, 7, 1, 1, 0x11, 0])) + segment(0xDA, bytes([1, 1, 0x10, predictor, 0, 0])) + scan_bytes(bits) + b"\xff\xd9")
    assert (np.array(avi.decode_frames(frames)) == np.array(want)).all()
    with pytest.raises(ValueError):
        avi.decode_frames([frames[0][:-12]])


def test_avi_table_is_made_from_data(monkeypatch):
    lengths = avi.code_lengths([100, 50, 20, 5, 0, 1])
    assert lengths[4] == 0 and lengths[0] == 1 and lengths == sorted(lengths[:4]) + lengths[4:]
    assert sum(2.0**-n for n in lengths if n) < 1  # the code of ones only is free
    monkeypatch.setattr(avi, "DECODED", 3)  # many slices
    text = np.frombuffer(prose(random.Random(1), 4000).encode()[: 576 * 11], dtype=np.uint8).reshape(-1, 576)
    frames = avi.encode_frames(text)
    assert (np.array(avi.decode_frames(frames)) == text).all()
    assert sum(map(len, frames)) < 576 * 11 * 1.1


def test_language(spark, empty):
    rng = random.Random(6)
    speak = {"aa": "the an re er ing".split(), "bb": "ció que ado las ez".split(), "cc": "漢 字 語 学 校".split()}
    rows = [(i, " ".join("".join(rng.choices(speak[k], k=3)) for _ in range(60)), k) for i, k in enumerate(rng.choices(list(speak), k=150))]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    filters = language.learn(frame.where("doc_id < 100"))
    got = {r.doc_id: r for r in language.identify(frame, filters).collect()}
    assert all(got[i].lang_pred == k for i, _, k in rows)
    assert all(0 <= r.score <= 1 for r in got.values())
    for text in (None, "", "12 %$ 3"):
        assert filters.predict(text) == ("und", 0.0)
    assert filters.predict("Q")[0] in speak
    nothing = language.learn(empty.where("lang is not null"))
    assert nothing.predict("abc") == ("und", 0.0) and language.identify(empty, nothing).count() == 0


def test_language_filters_hold_their_members():
    members = [common.mix64(np.arange(1, 2000, dtype=np.uint64)), common.mix64(np.arange(1500, 3000, dtype=np.uint64))]
    filters = language.Filters(["a", "b"], members)
    for bit, own in enumerate(members):
        masks = np.bitwise_and.reduce([filters.tables[0][s] for s in filters.slots(own)])
        assert ((masks >> np.uint64(bit)) & np.uint64(1)).all()
    assert max(filters.false) < 0.02


def test_toxicity(spark, empty):
    rng = random.Random(7)
    rows, labels = [], []
    for i in range(240):
        words = prose(rng, 60).split()
        toxic = i % 4 == 0
        for _ in range(4 if toxic else 0):
            words.insert(rng.randrange(len(words)), "grumpf" + rng.choice(SYLLABLES))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    rows += [(900, None), (901, "")]
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.learn(docs, marks.where("doc_id < 160"))
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert all(got[i].predicted == y for i, y in labels)
    assert got[900].score == got[901].score < 0.5 and len(got) == len(rows)
    unlearned = toxicity.learn(docs, marks.where("false"))
    assert toxicity.score(empty, unlearned).count() == 0


def patterns(text):
    counts = toxicity.features(text, toxicity.Classes(toxicity.given_lexicon()))
    return {name: n for name, n in zip(toxicity.PATTERNS, counts) if n}


@pytest.mark.parametrize("text, pattern", [
    ("what an idiot", "insult named"),
    ("Idiot!", "lone insult"),
    ("an idiot box", "insult of a thing"),
    ("idiot, you", "insult at a target"),
    ("you are such an idiot", "insult at a target"),
    ("You’re an idiot!", "insult at a target"),
    ("vous, vous êtes stupid", "insult at a target"),
    ("you are no idiot", "insult denied or reported"),
    ("nobody is an idiot", "insult denied or reported"),
    ("they said idiot", "insult denied or reported"),
    ("an idiot, he said", "insult denied or reported"),
    ("I kill you", "threat at a target"),
    ("dich umbringen", "threat at a target"),
    ("I kill time", "threat at nobody"),
    ("you kill time", "threat at nobody"),
    ("we will not kill you", "threat denied or reported"),
])
def test_toxicity_grammar(text, pattern):
    assert patterns(text) == {pattern: 1}


def test_toxicity_counts_clauses():
    assert patterns("not he. idiot") == {"lone insult": 1}
    assert patterns("idiot, moron, scum. a loser") == {"lone insult": 1, "insult named": 1, "several of them": 1}
    assert patterns("I will kill you") == patterns("ich werde dich umbringen") == {"threat at a target": 1, "threat announced": 1}
    assert patterns("you idiot\nyou idiot") == {"insult at a target": 2}
    assert patterns("nothing here") == {} == patterns(None)
    model = toxicity.Model(toxicity.given_lexicon(), np.array([toxicity.GIVEN_BIAS, *toxicity.GIVEN_WEIGHTS]))
    score = lambda t: model.score(toxicity.features(t, toxicity.Classes(model.lexicon)))
    assert score("I will kill you") > 0.5 > score("I kill time") and score("you idiot") > 0.5 > score("you are no idiot")


def plain_patterns(letters):
    """The clause patterns by looking around each word."""
    found = set()
    for i, letter in enumerate(letters):
        if letter not in "IH":
            continue

        def trigger(kinds, reach, step):
            return any(letters[j] in kinds for j in range(i + step, i + step * (reach + 1), step) if 0 <= j < len(letters))

        negated = any(letters[j] == "N" and "Y" not in letters[j:i] for j in range(max(0, i - 4), i))
        denied = negated or trigger("R", 99, -1) or trigger("R", 4, 1) or (letter == "I" and trigger("N", 2, 1))
        near = trigger("TO", 4, -1) or trigger("TO", 3, 1) if letter == "I" else trigger("O", 2, -1) or trigger("TO", 2, 1)
        said = any(letters[j] == "T" and letters[j + 1] == "B" for j in range(i - 1))
        if denied:
            found.add(4 if letter == "I" else 5)
        elif letter == "H":
            found |= {2 if near else 3} | ({9} if trigger("M", 2, -1) else set())
        else:
            found.add(0 if near or said else 8 if trigger("o", 1, 1) else 7 if trigger("AB", 1, -1) else 1)
    return found | ({6} if sum(x in "IH" for x in letters) > 1 else set())


def test_toxicity_transducers_against_plain():
    rng = random.Random(19)
    for _ in range(3000):
        letters = "".join(rng.choices("ooooIHTONRABMY", k=rng.randint(1, 12)))
        assert toxicity.patterns_of(letters) == plain_patterns(letters), letters


PAGES = [
    (1, "<html><body><nav><a href=x>Home</a> <a>About us</a></nav><article><h1>T&amp;t</h1><p>One\n two<br>three</p><p>Short</p><script>var a='<p>no</p>'</script><!-- <p>no --></article><footer>&copy; x</footer></body></html>", "T&t One two three Short"),
    (2, "<div id=cookie-notice>We use cookies to be nice to you and all of the people on this page, as it is.</div><article><p>Body &lt;3 &#233; <b>bold</b></p><div class='comments'><p>first!</p></div><form>Name <input></form></article>", "Body <3 é bold"),
    (3, "<p>" + "this is the text of an old page that has no article and it is not short at all " * 4 + "</p><p>and this is its end</p><div class=sidebar><p>other</p></div>", None),
    (4, "<article><p>cut in a tag</p><p", "cut in a tag"),
    (5, "", ""),
    (6, None, ""),
    (7, "a < b and 3 <4", None),
    (8, "<article></article>", ""),
]


def test_html(spark):
    frame = spark.createDataFrame([(i, "u", h, "t", 1) for i, h, _ in PAGES], "page_id long, url string, html string, text string, n_chars long")
    got = {r.page_id: r for r in html_text.extract(frame).collect()}
    for i, _, want in PAGES:
        assert got[i].n_chars == len(got[i].text)
        if want is not None:
            assert got[i].text == want
    assert "old page" in got[3].text and "other" not in got[3].text and got[3].text.endswith("its end")
    assert html_text.extract(frame.where("false")).count() == 0


def made_page(rng):
    """A page from known parts, and its main text: what stands in the article's own blocks."""
    text, kept = lambda n: prose(rng, rng.randint(1, n)), []

    def keep(words):
        kept.append(words)
        return words

    linked = lambda words: f"<a href='/x'>{words}</a>"
    good = [
        lambda: f"<p>{keep(text(60))}",
        lambda: f"<p>{linked(keep(text(40)))}</p>",  # a paragraph that is a link altogether
        lambda: f"<div class='{rng.choice(['related-work', 'has-sidebar', 'no-ads-here', 'banner-of-peace', 'cookie-recipe', 'lead'])}'><p>{keep(text(30))}</p></div>",
        lambda: f"<section id='comment-on-law'><h2>{keep(text(4))}</h2><blockquote>{keep(text(50))}</blockquote></section>",
        lambda: "<b><i>" * 30 + f"<p>{keep(text(20))}</p>" + "</i></b>" * 30,
        lambda: f"<ul><li>{keep(text(20))} <li>{keep(text(3) + ' x')} </ul>",
        lambda: f"<table><tr><td>{keep(text(9))}<td>{keep(text(9))}</table>",
        lambda: f"<header><p>{keep(text(9))}</p></header>",
    ]
    bad = [
        lambda: f"<div class='ad box'>{text(50)}</div>",
        lambda: f"<nav><ul><li>{linked(text(3))}<li>{linked(text(3))}</ul></nav>",
        lambda: f"<aside><article><p>{text(40)}</p></article></aside>",
        lambda: f"<div class='share-buttons'>{linked(text(3))}</div>",
        lambda: f"<section class='comments'><article class='comment'><p>{text(60)}</p></article></section>",
        lambda: f"<form><label>{text(4)}</label><select><option>{text(2)}</select></form>",
        lambda: f"<script>var a = '<p>{text(5)}</p>';</script><style>p {{}}</style><!-- <p>{text(5)}</p> -->",
        lambda: f"<div role=banner>{text(20)}</div></span></li></section-x>",
    ]
    inner = "".join(rng.choice(good if rng.random() < 0.7 else bad)() for _ in range(rng.randint(1, 12)))
    furniture = lambda: "".join(rng.choice(bad)() for _ in range(rng.randint(0, 3)))
    wrap, end = rng.choice([("<div class='page has-sidebar'>", "</div>"), ("<main class='main sidebar'>", "</main>"), ("", "")])
    return f"<html><head><title>{text(5)}</title></head><body><header>{text(6)}</header>{furniture()}{wrap}<article class='post'>{inner}</article>{end}{furniture()}<footer>&copy; {text(9)}</footer></body></html>", " ".join(kept)


def test_html_of_made_pages():
    rng = random.Random(31)
    for _ in range(400):
        page, want = made_page(rng)
        assert html_text.main_text(page) == want, page


@pytest.mark.parametrize("kind", ["</b>", "<b>", "<div>", "<p><b>", "</div>", "<a ", "<", "<!--", "<li><i>"])
def test_html_takes_linear_time(kind):
    import time

    began = time.process_time()
    html_text.main_text("<article><b><div>" + kind * 100_000 + "x</article>")
    assert time.process_time() - began < 5


def test_html_long_page():
    body = "".join(f"<p>the block number {k} of a page that is very long and has many blocks</p>" for k in range(5000))
    assert html_text.main_text(f"<nav><a>x</a></nav><article>{body}</article>") == " ".join(re.findall(r"<p>(.*?)</p>", html.unescape(body)))


def conversation_rows():
    rng = random.Random(9)
    rows = [(1, 0, "system", "be <s>kind</s>"), (2, 0, "user", "</s>[INST] ok \\ <\\ [/INST]"), (2, 1, "assistant", "a<n>b\\\\<"), (3, 0, None, None), (3, 1, "assistant", ""), (4, 5, "assistant", "x"), (4, 5, "assistant", "x"), (4, None, "odd\nrole<", "y")]
    rows += [(1, t, ("assistant", "user")[t % 2], prose(rng, rng.randint(1, 500))) for t in range(1, 60)]
    return rows


def test_chat(spark):
    rows = conversation_rows()
    frame = spark.createDataFrame([(*r, 0, "z") for r in rows], "conv_id long, turn long, role string, text string, seq int, body string").repartition(3)
    formatted = chat.windows(frame)
    got = {r.conv_id: r for r in chat.read_back(formatted).collect()}
    by = defaultdict(list)
    for c, turn, role, text in rows:
        by[c].append((turn is not None, turn or 0, role or "", text or ""))
    for c, turns in by.items():
        turns.sort()
        assert got[c].n_turns == len(turns)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for _, _, r, t in turns).encode()).hexdigest()
        loss = "".join(t for _, _, r, t in turns if r == "assistant")
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    shown = sorted(r for r in formatted.where("conv_id = 1").select("window", "formatted", "n_repeated", "tokens").collect())
    assert len(shown) > 3 and all(r.formatted.startswith("<s>system<n>be <\\s>kind<\\/s></s>") for r in shown) and all(r.n_repeated >= 1 for r in shown[1:]) and any(r.n_repeated >= 2 for r in shown)
    assert chat.read_back(chat.windows(frame.where("false"))).count() == 0


def test_chat_windows_keep_to_the_budget(spark):
    rng = random.Random(23)
    budget, history = 200, 40
    rows = []
    for c in range(30):
        if c % 2:
            rows.append((c, 0, "system", " ".join("rule" for _ in range(rng.randint(1, 60)))))
        rows += [(c, t + 1, ("user", "assistant")[t % 2], " ".join("word" for _ in range(rng.choice([1, 5, 20, 45, 300])))) for t in range(rng.randint(1, 25))]
    got = defaultdict(list)
    for r in chat.windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), budget, history).collect():
        got[r.conv_id].append(r)
    size = lambda text: len(text.split()) + chat.TURN_TOKENS
    for c, windows in got.items():
        turns = [(role, text) for i, _, role, text in rows if i == c]
        system = size(turns[0][1]) if turns[0][0] == "system" else 0
        at = 0
        for w in sorted(windows, key=lambda w: w.window):
            new = turns[at : at + w.n_new]
            repeated = w.tokens - sum(size(t) for _, t in new) - (system if w.window else 0)
            assert 0 <= repeated <= history
            assert w.tokens <= budget or (w.n_new == 1 and size(new[0][1]) > (budget - history - system) // 2)
            assert len(w.loss) == sum(role == "assistant" for role, _ in new)
            at += w.n_new
        assert at == len(turns)


def test_chat_main_path_is_native(spark):
    frame = spark.createDataFrame(conversation_rows(), "conv_id long, turn long, role string, text string")
    plan = chat.read_back(chat.windows(frame))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_chat_escape(spark):
    texts = ["\\", "<", "<\\", "\\<", "</s>", "<s><n>\\\\<<", "", "plain"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.unescape(chat.escape(F.col("t"))).alias("u"), chat.escape(F.col("t")).alias("e")).collect()
    assert all(r.t == r.u for r in rows)
    assert not any(m in r.e for r in rows for m in (chat.OPEN, chat.CUT, chat.CLOSE))
