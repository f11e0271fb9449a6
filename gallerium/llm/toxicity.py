"""Toxicity by a weighted finite-state grammar of clauses.

Words become class letters by a lexicon (learned insult stems, given insults, threats, targets, negations, reporting verbs,
articles, verbs of being and modal verbs). Transducers over these letters mark the insults and threats of a clause by the words
that they stand with: an insult named with an article or a verb of being, or said of a thing as its adjective; a threat that a
modal verb announces; either near a target, under a negation or reported. Some read a clause forwards, others backwards, so that
"you idiot" and "idiot, you" are the same; those of one direction are composed into one table. "Not only" denies nothing, and
what a target is said to be lasts to the clause's end.

The marks say which patterns a clause matches, and a text's score weighs how many clauses match each, however many of its words
do; labelled rows move the weights from given ones. A word in none of these constructions is a pattern of its own with a weight of
its own: where labels call it toxic, it counts.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, materialize

TRAIN_ROWS = 20_000  # labelled rows that are learned from, in expectation
STEMS = (4, 5, 6)
LEAST_ODDS, LEAST_DOCS, LEAST_SHARE, MARGIN = 2.5, 3, 0.003, 6.0
MEMO_WORDS = 200_000
OTHER, INSULT, THREAT, TARGET, OBJECT, NEGATION, REPORT, BREAK = "o", "I", "H", "T", "O", "N", "R", "."
ARTICLE, BEING, MODAL, ONLY = "A", "B", "M", "Y"
LETTERS = (OTHER, INSULT, THREAT, TARGET, OBJECT, NEGATION, REPORT, BREAK, ARTICLE, BEING, MODAL, ONLY)
# The given classes. An object can stand before its verb.
GIVEN = {
    INSULT: "idiot idiots moron morons imbecile imbeciles cretin cretins stupid pathetic worthless loser losers scum scumbag scumbags disgusting bastard bastards asshole assholes dumbass idiotin vollidiot arschloch schwachkopf abschaum connard connasse crétin abruti imbécile idiote idiota imbécil estúpido estúpida pendejo gilipollas",
    THREAT: "kill murder hurt destroy strangle stab shoot töten umbringen verprügeln erwürgen tuer tuerai tuez frapper étrangler matar mataré matarte pegarte",
    TARGET: "you your you're you'll yours yourself u du ihr tu toi vous usted ustedes vosotros he she they him her them his their",
    OBJECT: "dich dir euch te os le",
    NEGATION: "not no never nobody none nor neither without isn't aren't wasn't weren't don't doesn't didn't won't wouldn't can't cannot nicht kein keine keinen keiner niemand nie ohne pas aucun aucune personne niemals jamais sans nunca nadie ningún ninguna sin",
    ARTICLE: "a an the such what that this ein eine einen der die das so une un le la les quel quelle una el los las qué ese esa",
    BEING: "is are was were am be been being ist sind war bist seid bin sei est sont était êtes suis es son era eres soy ser",
    MODAL: "will would shall should must might could can gonna going i'll we'll they'll i'd want wants wanna let's werde werden wird muss soll vais va allons veux voy vamos quiero",
    ONLY: "only just merely nur bloß seulement solo sólo solamente",
    REPORT: "said says saying wrote written writes quoted quotes called calls calling named reported sagte sagt schrieb nannte nennt écrit écrivait disait dit appelait dijo dice escribió llamó llamaba",
}
#: What a clause can match, and the weights that labels move: log(1 + clauses) times these, and the last is the bias.
PATTERNS = (
    "insult at a target", "lone insult", "threat at a target", "threat at nobody", "insult denied or reported", "threat denied or reported", "several of them",
    "insult named", "insult of a thing", "threat announced",
)
GIVEN_WEIGHTS = np.array([4.0, 2.0, 5.0, 0.5, 0.5, 0.5, 1.0, 3.0, 1.0, 1.5])
GIVEN_BIAS = -2.0
_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*|[.!?;:]")


def stems_of(word: str) -> list[str]:
    return [word, *(word[:k] + "*" for k in STEMS if len(word) > k)]


class Transducer:
    """Deterministic letter-to-letter: (state, input) to (state, output); what isn't listed keeps its letter and takes the
    state's default."""

    def __init__(self, start, step):
        self.start, self.step = start, step

    def compose(self, other: Transducer) -> Transducer:
        def step(state, symbol):
            a, out = self.step(state[0], symbol)
            b, out = other.step(state[1], out)
            return (a, b), out

        return Transducer((self.start, other.start), step)


def near(triggers: str, mark: str, reach: int | None, kinds: str) -> Transducer:
    """Marks words of `kinds` up to `reach` words after a trigger (None: to the end of the clause)."""

    def step(state, symbol):
        kind = symbol[0]
        if kind == BREAK:
            return 0, symbol
        left = max(state - 1, 0) if reach is not None else state
        if kind in triggers:
            return (reach or 1), symbol
        return left, symbol + mark if state and kind in kinds else symbol

    return Transducer(0, step)


def denied() -> Transducer:
    """Marks insults and threats up to four words after a negation; "not only" isn't one."""
    plain = near(NEGATION, "n", 4, BOTH)

    def step(state, symbol):
        return (0, symbol) if symbol[0] == ONLY else plain.step(state, symbol)

    return Transducer(0, step)


def predicated() -> Transducer:
    """Marks all insults of a clause after a target and, right behind it, a verb of being."""

    def step(state, symbol):
        kind = symbol[0]
        if kind == BREAK:
            return 0, symbol
        if state == 2:
            return 2, symbol + "t" if kind == INSULT else symbol
        if kind == TARGET:
            return 1, symbol
        return (2 if state == 1 and kind == BEING else 0), symbol

    return Transducer(0, step)


def composed(*parts: Transducer) -> Transducer:
    first, *rest = parts
    for part in rest:
        first = first.compose(part)
    return first


BOTH = INSULT + THREAT
FORWARDS = composed(denied(), near(REPORT, "r", None, BOTH), near(TARGET + OBJECT, "t", 4, INSULT), near(OBJECT, "t", 2, THREAT), predicated(), near(ARTICLE + BEING, "p", 1, INSULT), near(MODAL, "m", 2, THREAT))
BACKWARDS = composed(near(NEGATION, "n", 2, INSULT), near(REPORT, "r", 4, BOTH), near(TARGET + OBJECT, "t", 3, INSULT), near(TARGET + OBJECT, "t", 2, THREAT), near(OTHER, "a", 1, INSULT))


def table_of(grammar: Transducer) -> tuple[int, dict]:
    """The start and all reachable transitions, states numbered: (state, letter) to (state, marks)."""
    number, todo, table = {grammar.start: 0}, [grammar.start], {}
    while todo:
        state = todo.pop()
        for letter in LETTERS:
            to, out = grammar.step(state, letter)
            if to not in number:
                number[to] = len(number)
                todo.append(to)
            table[number[state], letter] = number[to], out[1:]
    return 0, table


_FORWARDS, _BACKWARDS = table_of(FORWARDS), table_of(BACKWARDS)


def marks_of(letters: str, grammar: tuple[int, dict]) -> list[str]:
    state, table = grammar
    out = []
    for letter in letters:
        state, marks = table[state, letter]
        out.append(marks)
    return out


def patterns_of(clause: str) -> frozenset[int]:
    """The places in PATTERNS of what a clause, as class letters, matches."""
    before, after = marks_of(clause, _FORWARDS), marks_of(clause[::-1], _BACKWARDS)[::-1]
    found, several = set(), sum(map(clause.count, BOTH)) > 1
    for letter, a, b in zip(clause, before, after):
        if letter in BOTH:
            marks = a + b
            if "n" in marks or "r" in marks:
                found.add(4 if letter == INSULT else 5)
            elif letter == THREAT:
                found.add(2 if "t" in marks else 3)
                if "m" in marks:
                    found.add(9)
            elif "t" in marks:
                found.add(0)
            elif "a" in marks:  # before a word that it can describe: an idiot box, a stupid question
                found.add(8)
            else:
                found.add(7 if "p" in marks else 1)
    return frozenset(found | {6} if several else found)


class Classes(dict):
    """From what stands between white space to class letters; a bounded memo."""

    def __init__(self, lexicon: dict[str, str]):
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, chunk: str) -> str:
        if len(self) > MEMO_WORDS:
            self.clear()
        out = []
        for word in _WORD.findall(chunk):
            out.append(BREAK if word in ".!?;:" else next((self.lexicon[s] for s in stems_of(word) if s in self.lexicon), OTHER))
        self[chunk] = found = "".join(out)
        return found


def features(text: str | None, classes: Classes) -> list[int]:
    """How many clauses match each pattern, once each."""
    out = [0] * len(PATTERNS)
    for line in (text or "").lower().replace("’", "'").split("\n"):
        letters = "".join(map(classes.__getitem__, line.split()))
        if INSULT not in letters and THREAT not in letters:
            continue
        for clause in letters.split(BREAK):
            if INSULT in clause or THREAT in clause:
                for k in patterns_of(clause):
                    out[k] += 1
    return out


class Model:
    def __init__(self, lexicon: dict[str, str], weights: np.ndarray):
        self.lexicon, self.weights = lexicon, weights

    def score(self, counts: list[int]) -> float:
        z = float(self.weights[0] + self.weights[1:] @ np.log1p(counts))
        return 1 / (1 + float(np.exp(-np.clip(z, -30, 30))))


def fit_weights(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 60) -> np.ndarray:
    """Ridge logistic regression by damped Newton steps, drawn to the given weights instead of none; the bias is free."""
    design = np.concatenate([np.ones((len(x), 1)), x], axis=1)
    given = np.array([GIVEN_BIAS, *GIVEN_WEIGHTS])
    weights = given.copy()
    penalty = np.diag([1e-6, *[ridge] * x.shape[1]])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(design @ weights, -30, 30)))
        step = np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + penalty, design.T @ (y - p) - penalty @ (weights - given))
        weights += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return weights


def given_lexicon() -> dict[str, str]:
    return {word: kind for kind, words in GIVEN.items() for word in words.split()}


def learn(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Lexicon and weights from labelled rows: `labels` (doc_id, toxic) of documents `docs` (doc_id, text). About `rows` of
    them are sampled by a hash of doc_id. Repeated labels of a document count once (the largest)."""
    labels = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = labels.count()
    million = 1_000_000
    chosen = labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(million)) < min(million, int(rows / max(n, 1) * million) + 1))
    sample = materialize(docs.select("doc_id", F.col("text").cast("string")).join(F.broadcast(chosen), "doc_id").select("text", F.col("toxic").cast("int")), "labelled")  # broadcast: about `rows` rows of two numbers
    sizes = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    lexicon = given_lexicon()
    if n1 and n0:

        def counts(wanted):
            def make():
                def step(batch):
                    seen: Counter = Counter()
                    for text in batch.column(0):
                        words = {w for w in _WORD.findall((text.as_py() or "").lower()) if len(w) > 2}
                        found = {s for w in words for s in stems_of(w)}
                        seen.update(found if wanted is None else found & wanted)
                    yield {"stem": list(seen), "n": list(seen.values())}

                return step

            return make

        def summed(frame, wanted, least):
            out = arrow_map(frame, "stem string, n long", counts(wanted)).groupBy("stem").agg(F.sum("n").alias("n"))
            return {r.stem: r.n for r in out.where(F.col("n") >= least).collect()}  # stems in a share of the sample's toxic rows

        least = max(LEAST_DOCS, int(LEAST_SHARE * n1))
        toxic = summed(sample.where("toxic = 1").select("text"), None, least)
        clean = summed(sample.where("toxic = 0").select("text"), frozenset(toxic), 1)
        for stem, a in toxic.items():
            b = clean.get(stem, 0)
            odds = np.log((a + 0.5) / (n1 + 1)) - np.log((b + 0.5) / (n0 + 1))
            expected = (a + b) * n1 / (n1 + n0)
            surprise = 2 * (a * np.log(a / expected) + (b * np.log(b / (a + b - expected)) if b else 0))
            if odds >= LEAST_ODDS and surprise >= 2 * np.log(len(toxic)) + MARGIN:  # beyond the luckiest of that many stems
                lexicon.setdefault(stem, INSULT)
    x = arrow_map(sample, "toxic int, counts array<int>", lambda: _featured(Classes(lexicon))).toArrow()  # `rows` rows of a few numbers
    y = x.column("toxic").to_numpy().astype(float)
    if not len(y):
        return Model(lexicon, np.array([GIVEN_BIAS, *GIVEN_WEIGHTS]))
    return Model(lexicon, fit_weights(np.log1p(np.array(x.column("counts").to_pylist())), y))


def _featured(classes: Classes):
    def step(batch):
        yield {"toxic": batch.column(1), "counts": [features(t.as_py(), classes) for t in batch.column(0)]}

    return step


def score(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """`docs` with score (0 to 1) and predicted (1 from 0.5 on); null and empty texts get the score of no match, rows
    that repeat are scored each, an empty table stays empty."""
    keep = keep or ["doc_id"]
    sent = docs.sparkSession.sparkContext.broadcast((model.lexicon, model.weights))  # stems of LEAST_SHARE of the sample
    kinds = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keep)

    def make():
        own = Model(*sent.value)
        classes = Classes(own.lexicon)
        nothing = own.score([0] * len(PATTERNS))

        def step(batch):
            scores = []
            for text in batch.column(0):
                counts = features(text.as_py(), classes)
                scores.append(own.score(counts) if any(counts) else nothing)
            yield {k: batch.column(i + 1) for i, k in enumerate(keep)} | {"score": scores, "predicted": [int(s >= 0.5) for s in scores]}

        return step

    return arrow_map(docs.select(F.col("text").cast("string").alias("__text"), *keep), f"{kinds}, score double, predicted int", make)
