"""BPE encoding and decoding through a minimal acyclic transducer of frequent words.

A word is what lies between white space after normalisation (NFC, lower case); no token of the vocabulary with word ends
crosses it. The driver counts words over all texts, compiles the most frequent into a minimal acyclic automaton whose arcs
carry integer outputs (their sum along a path is the word's number, and so the place of its ids), and ships the compiled
bytes, which every worker maps into memory. Words outside it are merged exactly, pair by pair; a bounded memo keeps what a
worker has met. The vocabulary file is a parameter. What is a letter, a number, white space or a lower-case letter is asked
of the library's own normaliser and pre-tokeniser once, as its Unicode tables differ from Python's.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import mmap
import re
import struct
import tempfile
import unicodedata
from collections import Counter
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, Tokenizer, normalizers, pre_tokenizers

from .common import arrow_map, materialize

LEXICON_WORDS = 50_000
MEMO_WORDS = 200_000  # that a worker remembers
GROUP_TEXTS = 1024  # that are coded together
_NEVER = 1 << 30
_BETWEEN = b"\xff" * 4  # no id: the vocabulary has fewer than 2**24
_SLOTS = 1 << 19  # of the table of merges
LONG_PIECE = 256  # bytes from which a piece is merged by a heap, and a word isn't remembered
# The contractions of the published vocabulary file's pre-tokeniser, and where Unicode has characters.
CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
_ASSIGNED = (range(0xD800), range(0xE000, 0x34000), range(0xE0000, 0xE0200))


class Alphabet(NamedTuple):
    """What the library's Unicode tables say: classes as ranges for a regular expression, and the code points whose
    normal form or lower case Python's tables tell otherwise."""

    letters: str
    numbers: str
    spaces: str
    odd: str


@lru_cache(1)
def alphabet() -> Alphabet:
    """Asks the library about every code point, many in a call."""
    chars = [chr(c) for r in _ASSIGNED for c in r if c != 10]
    odd = set()

    def compare(normaliser, own, before="", after=""):
        told = normaliser.normalize_str("\n".join(before + c + after for c in chars)).split("\n")
        for c, x in zip(chars, told, strict=True):
            if x != own(before + c + after):
                odd.update((c, *x) if len(x) < 4 else c)

    compare(normalizers.Lowercase(), str.lower)
    compare(normalizers.NFD(), lambda x: unicodedata.normalize("NFD", x))
    overlay, iota = "\u0334", "\u0345"  # marks of the least and the greatest class: what moves across them is a mark, too
    compare(normalizers.NFD(), lambda x: unicodedata.normalize("NFD", x), after=overlay)
    compare(normalizers.NFD(), lambda x: unicodedata.normalize("NFD", x), before=iota)
    odd -= {overlay, iota} | {c for c in odd if c.isascii()}

    def ranges(pattern: str) -> str:
        found = pre_tokenizers.Split(Regex(pattern), "removed", invert=True).pre_tokenize_str("\n" + "".join(chars))
        return "".join(_range(run) for run, _ in found)

    return Alphabet(ranges(r"\p{L}+"), ranges(r"\p{N}+"), ranges(r"\s+"), "".join(map(re.escape, sorted(odd))))


def _range(run: str) -> str:
    """Consecutive characters as ranges; a run can leave out code points that aren't characters."""
    out, at = [], 0
    for k in range(1, len(run) + 1):
        if k == len(run) or ord(run[k]) != ord(run[k - 1]) + 1:
            out.append(re.escape(run[at]) if k - at == 1 else f"{re.escape(run[at])}-{re.escape(run[k - 1])}")
            at = k
    return "".join(out)


_ODD, _SPACE, _ASTRAL = 1, 2, 4


class Splitter:
    """Normal forms, words and pieces as the library makes them."""

    def __init__(self, classes: Alphabet, spec: bytes):
        self.spaces = re.compile(f"[{classes.spaces}]+")
        self.wide_spaces = re.compile(f"(?![\x00-\x7f])[{classes.spaces}]")
        self.kinds = np.zeros(0x110000, dtype=np.uint8)
        self.kinds[0x10000:] = _ASTRAL
        every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        for kind, found in ((_ODD, classes.odd), (_SPACE, classes.spaces)):
            for c in re.findall(f"[{found}]", every) if found else ():
                self.kinds[ord(c)] |= kind
        self.kinds[:128] = 0
        self.pieces = {wide: self._pieces(classes, wide) for wide in (False, True)}
        self.normaliser = Tokenizer.from_str(spec.decode("utf-8")).normalizer

    @staticmethod
    def _pieces(classes: Alphabet, wide: bool) -> re.Pattern:
        """Letters first, as they are what there is most of; without the rare planes, whose ranges are searched one by one."""
        letters, numbers, spaces = (x if wide else re.sub(r"(\\?[\U00010000-\U0010FFFF](-\\?[\U00010000-\U0010FFFF])?)+", "", x) for x in classes[:3])
        return re.compile(f"[{letters}]+|[{numbers}]|{CONTRACTIONS}|[^\n{spaces}{letters}{numbers}]+|\n")

    def kind(self, text: str) -> int:
        """Which kinds of code points a text holds."""
        return int(np.bitwise_or.reduce(self.kinds[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)], initial=0))

    def normalized(self, text: str) -> str:
        """A text in the vocabulary's normal form, with ASCII white space only."""
        if not text.isascii():
            kind = self.kind(text)
            if kind & _ODD:
                return self.spaces.sub(" ", self.normaliser.normalize_str(text))
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # lower() would look at a sigma's neighbours
            if kind & _SPACE:
                text = self.wide_spaces.sub(" ", text)
        return text.lower()

    def cut(self, words: str) -> list[str]:
        """The pieces of words that line feeds part, with these."""
        return self.pieces[not words.isascii() and bool(self.kind(words) & _ASTRAL)].findall(words)

    def words_of(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The distinct words of texts without special tokens, the place of each word there, and where each text's words begin."""
        lists = pc.ascii_split_whitespace(pa.array([self.normalized(t) for t in texts], pa.string()))
        coded = lists.values.dictionary_encode()
        return coded.dictionary.to_pylist(), coded.indices.to_numpy(), lists.offsets.to_numpy()


def _slot(keys: np.ndarray) -> np.ndarray:
    return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(45)).astype(np.int64)


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: itself, or the next free one from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b if b in shown else next(free)) for b in range(256)]


class Bpe:
    """Exact merging: the vocabulary, the ranks of its merges, and special tokens."""

    def __init__(self, spec: bytes, classes: Alphabet):
        model = json.loads(spec)
        self.vocab = model["model"]["vocab"]
        self.suffix = model["model"]["end_of_word_suffix"] or ""
        self.special = {x["content"]: x["id"] for x in model["added_tokens"]}
        self.cut = re.compile("(" + "|".join(re.escape(x) for x in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.text_of = {i: x for x, i in self.vocab.items()} | {i: x for x, i in self.special.items()}
        alphabet = byte_alphabet()
        self.inner = np.array([self.vocab[c] for c in alphabet], dtype=np.int64)
        self.last = np.array([self.vocab[c + self.suffix] for c in alphabet], dtype=np.int64)
        self.slot_keys, self.slot_ranks = np.full(_SLOTS, -1, dtype=np.int64), np.zeros(_SLOTS, dtype=np.int64)
        merges = [x.split(" ") if isinstance(x, str) else x for x in model["model"]["merges"]]
        self.made = np.array([self.vocab[a + b] for a, b in merges], dtype=np.int64)
        keys = np.array([self.vocab[a] << 20 | self.vocab[b] for a, b in merges], dtype=np.int64)
        for rank, (key, at) in enumerate(zip(keys.tolist(), _slot(keys).tolist())):
            while self.slot_keys[at] >= 0:
                at = at + 1 & _SLOTS - 1
            self.slot_keys[at], self.slot_ranks[at] = key, rank
        self.splitter = Splitter(classes, spec)
        self.rank_of: dict[int, int] = {}
        self.keys = keys.tolist()
        self.merged: dict[str, bytes] = {"\n": _BETWEEN}

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of symbols, _NEVER where there is none: linear probing in the table of merges."""
        key = left << 20 | right
        at = _slot(key)
        found = self.slot_keys[at]
        out = np.where(found == key, self.slot_ranks[at], _NEVER)
        open_ = np.flatnonzero((found != key) & (found >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & _SLOTS - 1
            found = self.slot_keys[at[open_]]
            hit = found == key[open_]
            out[open_[hit]] = self.slot_ranks[at[open_[hit]]]
            open_ = open_[~hit & (found >= 0)]
        return out

    def merge(self, pieces: list[str]) -> list[bytes]:
        """The ids of each piece as little-endian 32-bit integers."""
        raw = [p.encode("utf-8", "surrogatepass") for p in pieces]
        if max(map(len, raw), default=0) < LONG_PIECE:
            return self.merge_short(raw)
        out = [self.merge_long(x) if len(x) >= LONG_PIECE else b"" for x in raw]
        short = [k for k, x in enumerate(raw) if len(x) < LONG_PIECE]
        for k, ids in zip(short, self.merge_short([raw[k] for k in short])):
            out[k] = ids
        return out

    def merge_long(self, piece: bytes) -> bytes:
        """One piece by a heap of its pairs, the lowest rank first and the leftmost of equal ones: n log n steps."""
        if not self.rank_of:
            for rank, key in enumerate(self.keys):
                self.rank_of[key] = rank
        data = np.frombuffer(piece, dtype=np.uint8)
        start = self.inner[data]
        start[-1] = self.last[data[-1]]
        ranks = self.pair_ranks(start[:-1], start[1:])
        at = np.flatnonzero(ranks < _NEVER)
        heap = (ranks[at] << 32 | at).tolist()  # sorted by rank, then place
        heapq.heapify(heap)
        symbols, rank_at = start.tolist(), [*ranks.tolist(), _NEVER]
        n, made, rank_of = len(symbols), self.made.tolist(), self.rank_of
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            rank, i = divmod(heapq.heappop(heap), 1 << 32)
            if rank_at[i] != rank:
                continue
            j = after[i]
            symbols[i], symbols[j], rank_at[j] = made[rank], -1, _NEVER
            k = after[i] = after[j]
            rank_at[i] = _NEVER
            if k < n:
                before[k] = i
                if (new := rank_of.get(symbols[i] << 20 | symbols[k])) is not None:
                    rank_at[i] = new
                    heapq.heappush(heap, new << 32 | i)
            if (h := before[i]) >= 0:
                rank_at[h] = new = rank_of.get(symbols[h] << 20 | symbols[i], _NEVER)
                if new < _NEVER:
                    heapq.heappush(heap, new << 32 | h)
        return np.array([x for x in symbols if x >= 0], dtype="<u4").tobytes()

    def merge_short(self, raw: list[bytes]) -> list[bytes]:
        """All pieces are merged side by side: a round takes the first of the lowest-ranked pairs of each (what it makes ranks
        above those left), and finished pieces leave."""
        out: list[bytes] = [b""] * len(raw)
        if not raw:
            return out
        size = np.array([len(x) for x in raw], dtype=np.int64)
        data = np.frombuffer(b"".join(raw), dtype=np.uint8)
        ends = np.cumsum(size)
        symbols = self.inner[data]
        symbols[ends - 1] = self.last[data[ends - 1]]
        owner = np.arange(len(raw))
        while len(owner):
            starts = ends - size
            ranks = np.full(len(symbols), _NEVER, dtype=np.int64)
            ranks[:-1] = self.pair_ranks(symbols[:-1], symbols[1:])
            ranks[ends - 1] = _NEVER
            least = np.minimum.reduceat(ranks, starts)
            busy = least < _NEVER
            if not busy.all():
                whole = symbols.astype("<u4").tobytes()
                for k in np.flatnonzero(~busy).tolist():
                    out[owner[k]] = whole[4 * starts[k] : 4 * ends[k]]
                keep = np.repeat(busy, size)
                symbols, ranks = symbols[keep], ranks[keep]
                owner, size, least = owner[busy], size[busy], least[busy]
                ends = np.cumsum(size)
                if not len(owner):
                    break
            place = np.repeat(np.arange(len(owner)), size)
            at = np.flatnonzero(ranks == least[place])
            where = place[at]
            at = at[np.concatenate([[True], where[1:] != where[:-1]])]
            symbols[at] = self.made[least]
            keep = np.ones(len(symbols), dtype=bool)
            keep[at + 1] = False
            symbols = symbols[keep]
            size = size - 1
            ends = np.cumsum(size)
        return out

    def words(self, words: list[str]) -> list[bytes]:
        """The ids of each word; pieces are remembered, as words differ in punctuation more than in letters."""
        if not words:
            return []
        pieces = self.splitter.cut("\n".join(words))
        new = list(set(pieces).difference(self.merged))
        if len(self.merged) + len(new) > MEMO_WORDS:
            self.merged = {"\n": _BETWEEN}
            new = list(set(pieces) - {"\n"})
        self.merged.update(zip(new, self.merge(new)))
        out = b"".join(map(self.merged.__getitem__, pieces)).split(_BETWEEN)
        if max(map(len, new), default=0) >= LONG_PIECE:
            for piece in new:
                if len(piece) >= LONG_PIECE:
                    del self.merged[piece]
        return out


def compile_lexicon(entries: dict[str, list[int]]) -> bytes:
    """The minimal acyclic automaton of the words, built from sorted words by merging equal suffix states as each is
    left behind. Layout: counts, arc keys (state * 256 + byte, sorted), arc targets, arc outputs, final flags, id offsets, ids."""
    words = sorted((w.encode("utf-8", "surrogatepass"), ids) for w, ids in entries.items())
    register: dict[tuple, int] = {}
    states: list[tuple[bool, tuple]] = []  # finished: final, arcs (byte, state)
    path: list[list] = [[False, []]]  # of the last word: final, arcs; an arc's state comes once it is finished
    before = b""

    def finish(depth: int) -> None:
        while len(path) > depth + 1:
            final, arcs = path.pop()
            key = (final, tuple(arcs))
            if key not in register:
                register[key] = len(states)
                states.append(key)
            path[-1][1].append((before[len(path) - 1], register[key]))

    for word, _ in words:
        same = 0
        while same < min(len(word), len(before)) and word[same] == before[same]:
            same += 1
        finish(same)
        path.extend([False, []] for _ in range(len(word) - same))
        path[-1][0] = True
        before = word
    finish(0)
    root = len(states)
    states.append((path[0][0], tuple(path[0][1])))
    below: list[int] = []  # words from each state on; targets come before their sources
    keys, targets, outputs = [], [], []
    for state, (final, arcs) in enumerate(states):
        count = int(final)
        for byte, target in arcs:
            keys.append(state * 256 + byte)
            targets.append(target)
            outputs.append(count)
            count += below[target]
        below.append(count)
    ids = [i for _, x in words for i in x]
    offsets = np.cumsum([0, *(len(x) for _, x in words)])
    head = struct.pack("<5q", root, len(states), len(keys), len(words), len(ids))
    parts = ((keys, "<i8"), (targets, "<i4"), (outputs, "<i4"), ([f for f, _ in states], "<i4"), (offsets, "<i4"), (ids, "<u4"))
    return head + b"".join(np.asarray(x, dtype=t).tobytes() for x, t in parts)


class Lexicon:
    """A compiled automaton in mapped memory; many words are walked at once, a byte a step."""

    def __init__(self, compiled: bytes):
        with tempfile.TemporaryFile() as file:
            file.write(compiled)
            file.flush()
            self.map = mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ)
        self.root, states, arcs, words, ids = struct.unpack_from("<5q", self.map)
        at = 40
        tables = []
        for kind, n in (("<i8", arcs), ("<i4", arcs), ("<i4", arcs), ("<i4", states), ("<i4", words + 1), ("<u4", ids)):
            tables.append(np.frombuffer(self.map, dtype=kind, count=n, offset=at))
            at += tables[-1].nbytes
        self.keys, self.targets, self.outputs, self.final, self.offsets, self.ids = tables

    def find(self, words: list[str]) -> list[bytes | None]:
        """The ids of each word as little-endian 32-bit integers; None outside the lexicon."""
        if not words or not len(self.keys):
            return [None] * len(words)
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        length = np.array([len(x) for x in raw])
        start = np.concatenate([[0], np.cumsum(length)[:-1]])
        data = np.frombuffer(b"".join(raw), dtype=np.uint8)
        live, state, number = np.arange(len(raw)), np.full(len(raw), self.root, dtype=np.int64), np.zeros(len(raw), dtype=np.int64)
        out: list[bytes | None] = [None] * len(raw)
        step = 0
        while len(live):
            done = length[live] == step
            for k in np.flatnonzero(done & (self.final[state] > 0)):
                out[live[k]] = self.ids[self.offsets[number[k]] : self.offsets[number[k] + 1]].tobytes()
            live, state, number = live[~done], state[~done], number[~done]
            key = state * 256 + data[start[live] + step]
            arc = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            good = self.keys[arc] == key
            arc, live = arc[good], live[good]
            state, number = self.targets[arc].astype(np.int64), number[good] + self.outputs[arc]
            step += 1
        return out


class Encoder:
    """Texts to ids and token texts, by memo, lexicon and exact merges."""

    def __init__(self, spec: bytes, classes: Alphabet, lexicon: bytes):
        self.bpe, self.lexicon = Bpe(spec, classes), Lexicon(lexicon)
        self.ids: dict[str, bytes] = {}
        self.again: set[str] = set()
        self.long: list[str] = []  # words that aren't remembered beyond their group

    def learn(self, words: set[str]) -> None:
        """Puts words into the memo. When it is full, those stay that were asked for again since it was full before."""
        for word in self.long:
            del self.ids[word]
        new = words.difference(self.ids)
        self.again |= words - new
        self.long = [w for w in new if len(w) >= LONG_PIECE] if max(map(len, new), default=0) >= LONG_PIECE else []
        if len(self.ids) + len(new) > MEMO_WORDS:
            if len(self.again) > MEMO_WORDS // 2:
                self.again = words - new
            self.ids = {w: self.ids[w] for w in self.again if w in self.ids}
            self.again = set()
        rest = list(new)
        known = self.lexicon.find(rest)
        self.ids.update((w, x) for w, x in zip(rest, known) if x is not None)
        rest = [w for w, x in zip(rest, known) if x is None]
        self.ids.update(zip(rest, self.bpe.words(rest)))

    def encode(self, texts: list[str | None]):
        """For each text, its ids as bytes. Special tokens are cut out before anything else."""
        cut = self.bpe.cut
        for s in range(0, len(texts), GROUP_TEXTS):
            pieces: list[str] = []
            layout: list[list] = []
            for text in texts[s : s + GROUP_TEXTS]:
                parts = cut.split(text) if text and cut is not None else [text or ""]
                layout.append([struct.pack("<I", self.bpe.special[x]) if k % 2 else len(pieces) + k // 2 for k, x in enumerate(parts)])
                pieces += parts[::2]
            coded = self._coded(pieces)
            for parts in layout:
                yield coded[parts[0]] if len(parts) == 1 else b"".join(p if isinstance(p, bytes) else coded[p] for p in parts)

    def _coded(self, pieces: list[str]) -> list[bytes]:
        """The ids of texts without special tokens: each distinct word is looked up once, the rest is gathering."""
        words, places, begins = self.bpe.splitter.words_of(pieces)
        self.learn(set(words))
        known = [self.ids[w] for w in words]
        size = np.array([len(x) // 4 for x in known], dtype=np.int64)
        start = np.cumsum(size) - size
        table = np.frombuffer(b"".join(known), dtype="<u4")
        counts = size[places]
        ends = np.concatenate([[0], np.cumsum(counts)])
        at = np.arange(ends[-1]) + np.repeat(start[places] - ends[:-1], counts)
        data = table[at].tobytes()
        cuts = (4 * ends[begins]).tolist()
        return [data[a:b] for a, b in zip(cuts, cuts[1:])]

    def decode(self, ids: bytes) -> str:
        """The token texts joined by spaces, as the library does for a file without a decoder; unknown ids are skipped."""
        texts = self.bpe.text_of
        return " ".join(texts[i] for i in np.frombuffer(ids, dtype="<u4").tolist() if i in texts)


_ENCODERS: dict[bytes, Encoder] = {}


def encoder(spec: bytes, classes: Alphabet, lexicon: bytes) -> Encoder:
    """One encoder a worker for each vocabulary and lexicon; a worker's later tasks find it, with its memo."""
    key = hashlib.blake2b(spec + lexicon, digest_size=16).digest()
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(spec, classes, lexicon)
    return _ENCODERS[key]


def count_words(docs: DataFrame, spec: bytes) -> DataFrame:
    """word, n over all texts, summed within each task before the shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast((alphabet(), spec))

    def run(batches):
        words_of = Splitter(*sent.value).words_of
        counts: Counter = Counter()

        def flush():
            out = pa.RecordBatch.from_pydict({"word": pa.array(list(counts), pa.string()), "n": pa.array(list(counts.values()), pa.int64())})
            counts.clear()
            return out

        for batch in batches:
            texts = batch.column(0).to_pylist()
            for s in range(0, len(texts), GROUP_TEXTS):
                words, places, _ = words_of([t or "" for t in texts[s : s + GROUP_TEXTS]])
                for word, n in zip(words, np.bincount(places, minlength=len(words)).tolist()):
                    counts[word] += n
                if len(counts) > MEMO_WORDS:
                    yield flush()
        counts.pop("", None)
        yield flush()

    counted = docs.select(F.col("text").cast("string")).mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(docs: DataFrame, spec: bytes, limit: int = LEXICON_WORDS) -> list[str]:
    """The words counted most often over all texts, at most `limit`; that bounds the automaton, not what can be encoded.

    The least count is found by a histogram of counts in eighths of powers of two, so that no task sends more than the words
    chosen, however many tasks there are. Words met once never come in."""
    step = F.floor(F.log2("n") * 8).cast("int")
    counted = materialize(count_words(docs, spec).where("n > 1").withColumn("step", step), "words")
    least, total = None, 0
    for r in counted.groupBy("step").agg(F.count("*").alias("words")).orderBy(F.desc("step")).collect():  # at most 512 rows
        total += r.words
        if total > limit:
            break
        least = r.step
    return [] if least is None else sorted(r.word for r in counted.where(F.col("step") >= least).select("word").collect())


def lexicon_of(words: list[str], spec: bytes) -> bytes:
    coded = Bpe(spec, alphabet()).words(words)
    return compile_lexicon({w: np.frombuffer(x, dtype="<u4").tolist() for w, x in zip(words, coded)})


def encode(docs: DataFrame, path: str, lexicon_words: list[str] | None = None) -> DataFrame:
    """One row for each row of `docs` (doc_id, text): doc_id, ids (binary, little-endian 32-bit) and decoded (string).

    A null or empty text has no ids and decodes to an empty text; rows that repeat are coded each. `path` is the vocabulary file on the driver."""
    with open(path, "rb") as file:
        spec = file.read()
    compiled = lexicon_of(frequent_words(docs, spec) if lexicon_words is None else lexicon_words, spec)
    sent = docs.sparkSession.sparkContext.broadcast((spec, alphabet(), compiled))  # bounded: the file and LEXICON_WORDS words

    def make():
        coder = encoder(*sent.value)

        def step(batch):
            texts = batch.column(1).to_pylist()
            for s in range(0, len(texts), GROUP_TEXTS):
                ids = list(coder.encode(texts[s : s + GROUP_TEXTS]))
                yield {"doc_id": batch.column(0).slice(s, GROUP_TEXTS), "ids": ids, "decoded": [coder.decode(x) for x in ids]}

        return step

    return arrow_map(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), "doc_id long, ids binary, decoded string", make)
