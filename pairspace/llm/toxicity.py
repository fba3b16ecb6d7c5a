"""Toxicity by a weighted finite-state grammar over clauses.

Three transducers read a text's tokens side by side: one keeps track of negation, one of reported speech, one of whom a
clause is about. Composed, they are one table of states and steps, and an insult or a threat read in
a state puts out a match with that state's modifiers. Clauses are scored by their matches, texts by their clauses.

Which words insult is learnt from labelled texts (stems and whole words with their weights), and so are the
weights of the modifiers; the words for negation, speech, threats and persons are fixed.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairspace.plans.storage import materialise

from .rows import col, map_rows

# labelled rows of each class that learning reads at most
TRAIN_ROWS = 10_000
STEMS = range(4, 9)
MIN_PLACES = 5
# least smoothed log-odds of a toxic use against a clean one
MIN_WEIGHT = 3.0
MAX_SHARE = 0.5

# Function words of the grammar in English, German, French and Spanish.
NEGATION = frozenset("not no never without isn aren don doesn wasn nicht kein keine keinen nie ne pas jamais aucun sin nunca jamás tampoco".split())
SPEECH = frozenset(
    "said says say wrote writes quoted quotes claimed claims called reported reportedly sagte sagt schrieb meinte zitierte "
    "dit disait écrit prétend cité dijo dice escribió afirmó citó".split()
)
PERSONS = frozenset(
    "you your he she they him her them his their du dich dir ihr euch er sie ihn ihm tu te toi vous il elle ils lui leur tú usted ustedes él ella ellos".split()
)
THREATS = frozenset("kill hurt murder destroy töten umbringen verletzen tuer frapper matar golpear".split())
TOKEN = re.compile(r"[^\W\d_]+|[.!?;:\n\"“”„«»]")
QUOTES = frozenset('"“”„«»')
ENDS = frozenset(".!?;:\n")

# symbols that the grammar reads
OTHER, NEG, SAID, QUOTE, PERSON, END, INSULT, THREAT = range(8)
NEGATED, REPORTED, TARGETED = 1, 2, 4
#: how many tokens a negation reaches
REACH = 3


@dataclass(frozen=True)
class Transducer:
    """``steps[state][symbol]`` is the next state; ``marks[state]`` the modifiers that a match in it gets."""

    steps: tuple[tuple[int, ...], ...]
    marks: tuple[int, ...]


def negation() -> Transducer:
    """State n: a negation is n tokens from wearing off."""
    steps = [[max(0, s - 1)] * 8 for s in range(REACH + 1)]
    for s in steps:
        s[NEG], s[END] = REACH, 0
    return Transducer(tuple(map(tuple, steps)), (0, *[NEGATED] * REACH))


def reported_speech() -> Transducer:
    """0: own words, 1: after a verb of saying, 2: in quotation marks; quotations go on over clause ends."""
    steps = [[0] * 8, [1] * 8, [2] * 8]
    steps[0][SAID], steps[0][QUOTE] = 1, 2
    steps[1][END], steps[1][QUOTE] = 0, 2
    steps[2][QUOTE] = 0
    return Transducer(tuple(map(tuple, steps)), (0, REPORTED, REPORTED))


def target() -> Transducer:
    """1: the clause has named a person."""
    steps = [[0] * 8, [1] * 8]
    steps[0][PERSON], steps[1][END] = 1, 0
    return Transducer(tuple(map(tuple, steps)), (0, TARGETED))


def compose(one: Transducer, other: Transducer) -> Transducer:
    """Both at once: a state of the result is a pair of states."""
    width = len(other.steps)
    steps = [
        tuple(a * width + b for a, b in zip(s, t, strict=True)) for s in one.steps for t in other.steps
    ]
    return Transducer(tuple(steps), tuple(m | n for m in one.marks for n in other.marks))


def grammar() -> Transducer:
    return compose(compose(negation(), reported_speech()), target())


@dataclass
class Lexicon:
    """Weights of whole words and of stems that begin a word."""

    words: dict[str, float]
    stems: dict[str, float]

    def weight(self, word: str) -> float:
        found = self.words.get(word, 0.0)
        for n in STEMS:
            if n > len(word):
                break
            found = max(found, self.stems.get(word[:n], 0.0))
        return found


FEATURES = 5


class Reader:
    """Turns texts into features with the composed grammar; keeps the symbols of a bounded number of words."""

    def __init__(self, lexicon: Lexicon, remembered: int = 300_000) -> None:
        self.lexicon, self.g, self.remembered = lexicon, grammar(), remembered
        self.symbols: dict[str, tuple[int, float]] = {}

    def symbol(self, token: str) -> tuple[int, float]:
        weight = self.lexicon.weight(token)
        kind = (
            INSULT if weight > 0
            else THREAT if token in THREATS
            else NEG if token in NEGATION
            else SAID if token in SPEECH
            else PERSON if token in PERSONS
            else END if token in ENDS
            else QUOTE if token in QUOTES
            else OTHER
        )
        if len(self.symbols) >= self.remembered:
            self.symbols.clear()
        self.symbols[token] = kind, weight
        return kind, weight

    def features(self, text: str) -> tuple[float, ...]:
        """Logarithms of the weights of plain, targeted, negated and reported insults, and of targeted threats.

        The weight of a clause is that of its strongest match and half of all the others.
        """
        known, symbol = self.symbols.get, self.symbol
        read = [known(t) or symbol(t) for t in TOKEN.findall(text.lower())]
        if not any(kind >= INSULT for kind, _ in read):
            return (0.0,) * FEATURES
        steps, marks, state = self.g.steps, self.g.marks, 0
        sums = [0.0] * FEATURES
        clause: list[tuple[float, int]] = []
        person = False
        for kind, weight in [*read, (END, 0.0)]:
            if kind == INSULT:
                mark = marks[state]
                clause.append((weight, 2 if mark & NEGATED else 3 if mark & REPORTED else 1 if mark & TARGETED else 0))
            elif kind == THREAT and marks[state] & TARGETED:
                clause.append((1.0, 4))
            elif kind == PERSON:
                person = True
            elif kind == END and clause:
                clause.sort(reverse=True)
                for i, (w, place) in enumerate(clause):
                    # a person named after the insult is its target as well
                    sums[1 if place == 0 and person else place] += w if i == 0 else w / 2
                clause = []
            if kind == END:
                person = False
            state = steps[state][kind]
        return tuple(math.log1p(s) for s in sums)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weights of a logistic regression with a constant first, by Newton's method; all zero without both classes."""
    x = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(x.shape[1])
    if len(set(y.tolist())) < 2:
        return w
    penalty = ridge * len(x) / 1000 * np.eye(x.shape[1])
    penalty[0, 0] = 1e-9
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty + 1e-9 * np.eye(len(w)), x.T @ (y - p) - penalty @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


@dataclass
class Model:
    lexicon: Lexicon
    weights: np.ndarray


def held_out(doc_id: Column) -> Column:
    """Fixed rule of the contract: ids that no label is learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, train_rows: int = TRAIN_ROWS) -> Model:
    """Learn the lexicon and the weights from at most ``train_rows`` labelled rows of each class.

    Rows with ``held_out`` ids, null ids, null texts or null labels are never read. The rows are those with the smallest hashes
    of their ids. A stem or word joins the lexicon if toxic texts have it after ``MIN_PLACES`` different words, no one of
    which comes before more than ``MAX_SHARE`` of its uses (so that copies of one passage teach nothing), and
    the smoothed log-odds of its use in toxic against clean texts, which are its weight, reach ``MIN_WEIGHT``; single clean uses (quoted,
    negated, mislabelled) only lower the weight. Without both classes nothing is learnt.
    """
    known = labels.select(col(key).alias("id"), col(label).cast("int").alias("y")).filter(
        F.col("id").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("id"))
    )
    known = known.groupBy("id").agg(F.max("y").alias("y"))
    # two bounded lists of ids
    picked = [known.filter(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(train_rows) for y in (0, 1)]
    ids = materialise(picked[0].unionByName(picked[1]), "toxicity-ids")
    texts = docs.select(col(key).alias("id"), col(text).alias("text")).filter(F.col("text").isNotNull())
    train = materialise(texts.join(F.broadcast(ids), "id").dropDuplicates(["id"]), "toxicity-rows")
    size = {r["y"]: r["n"] for r in train.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(size) < 2:
        return Model(Lexicon({}, {}), np.zeros(FEATURES + 1))
    words = F.expr(r"regexp_extract_all(lower(text), '\\p{L}+', 0)")
    said = train.select("y", words.alias("w")).select("y", "w", F.slice(F.concat(F.array(F.lit("")), "w"), F.lit(1), F.size("w")).alias("p"))
    said = said.select("y", F.explode(F.arrays_zip("w", "p")).alias("z")).select("y", F.col("z.w").alias("word"), F.col("z.p").alias("prev"))
    said = said.filter(F.length("word") >= 3)
    stems = F.concat(
        F.array(F.concat(F.lit("="), "word")),
        F.transform(F.filter(F.array(*map(F.lit, STEMS)), lambda n: n <= F.length("word")), lambda n: F.substring(F.col("word"), F.lit(1), n)),
    )
    toxic = said.filter("y = 1").groupBy("word", "prev").agg(F.count("*").alias("n")).withColumn("stem", F.explode(stems))
    toxic = toxic.groupBy("stem", "prev").agg(F.sum("n").alias("n")).groupBy("stem")
    toxic = toxic.agg(F.sum("n").alias("uses"), F.count("*").alias("places"), F.max("n").alias("top"))
    toxic = materialise(
        toxic.filter((F.col("places") >= MIN_PLACES) & (F.col("top") <= MAX_SHARE * F.col("uses"))), "toxicity-stems"
    )
    clean = said.filter("y = 0").groupBy("word").agg(F.count("*").alias("n")).withColumn("stem", F.explode(stems))
    clean = clean.join(toxic.select("stem"), "stem", "left_semi").groupBy("stem").agg(F.sum("n").alias("clean"))
    weight = F.log((F.col("uses") + 0.5) / (F.col("clean") + 0.5) * F.lit(size[0] / size[1]))
    kept = (
        toxic.join(clean, "stem", "left").fillna(0, ["clean"]).select("stem", weight.alias("weight")).filter(F.col("weight") >= MIN_WEIGHT)
    )
    words_found: dict[str, float] = {}
    stems_found: dict[str, float] = {}
    for r in sorted(kept.collect(), key=lambda r: (r["stem"][0] == "=", len(r["stem"]), r["stem"])):
        stem = r["stem"]
        covered = any(stem.lstrip("=")[:n] in stems_found for n in STEMS)
        if not covered:
            (words_found if stem[0] == "=" else stems_found)[stem.lstrip("=")] = max(0.1, r["weight"])
    lexicon = Lexicon(words_found, stems_found)
    features = map_rows(train, ["text"], T.StructType().add("f", T.ArrayType(T.DoubleType())), _reader_of(lexicon), ["y"])
    read = features.groupBy("y", "f").agg(F.count("*").alias("n")).collect()
    x = np.array([r["f"] for r in read for _ in range(r["n"])], dtype=float)
    y = np.array([r["y"] for r in read for _ in range(r["n"])], dtype=float)
    return Model(lexicon, fit_logistic(x, y))


def _reader_of(lexicon: Lexicon) -> Callable[[], Callable[..., list[list]]]:
    def start() -> Callable[..., list[list]]:
        reader = Reader(lexicon)
        return lambda texts: [[list(reader.features((t or b"").decode())) for t in texts]]

    return start


SCORE = T.StructType().add("score", "double").add("predicted", "integer")


def score(docs: DataFrame, text: str, model: Model) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on).

    Null and empty texts, and texts without any match, get the score of a text without matches. Repeated rows
    get equal scores, an empty table stays empty, input columns of the added names are replaced. Nothing is shuffled.
    """
    sent = docs.sparkSession.sparkContext.broadcast((model.lexicon.words, model.lexicon.stems, model.weights.tolist()))

    def start() -> Callable[..., list[list]]:
        words, stems, weights = sent.value
        reader = Reader(Lexicon(words, stems))

        def work(texts: list) -> list[list]:
            scores = []
            for t in texts:
                z = weights[0] + sum(w * f for w, f in zip(weights[1:], reader.features((t or b"").decode()), strict=True))
                scores.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
            return [scores, [int(s >= 0.5) for s in scores]]

        return work

    return map_rows(docs, [text], SCORE, start)
