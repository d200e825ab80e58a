"""Toxicity by a weighted finite-state pattern grammar.

Five machines are composed:

* the insult transducer reads a word letter by letter: stems with weights, each with the endings it may have
  (learned stems take any); the longest stem wins and puts its weight out;
* the threat transducer does the same with verbs of harm and their endings;
* the target machine: has the clause a word for the person spoken to or of?
* the negation machine: is a negation at most three words back?
* the reported-speech machine: has a verb of saying come before in the clause?

The first two are united into one letter transducer, which gives each word a class and a weight.  ``compose``
multiplies the five clause machines over these classes into one; its state at a matched word names the tape
(insult or threat; plain, negated or reported; aimed at a target or not) on which the weight is put out, times
the tape's factor.  The factors are the grammar's: an aimed insult counts more than one that is not, a
negated or reported one less, and a clause in whose final state insult, threat and target have met counts more.
So the same word counts differently in different clauses.

A clause's score is what the machine puts out for it; scores of clauses, not of words, make the text's
features: their sum (as a logarithm), the strongest clause, the share of clauses that matched.  A logistic
function of them is the score; its weights are fitted, but none of these three may be negative, so a text's
score never falls when a clause's rises.

What is learned comes from labelled rows outside the held-out fold only, at most ``sample_rows`` of them, by
the least digests of their ids: stems and weights (log odds over documents) from two of the other three
folds, the weights of the features from the third.  With too few labels the stated default is used.  The words of a
text are the only input of its score.

Defined results: null and empty texts have the score of a text without matches; long texts are read whole,
and sums grow without a limit, as logarithms; a null id is outside the fold; an id that
several labels have counts as toxic if one says so; repeated rows are scored each; ties among stems go to the
first in order of letters; an empty table gives no rows; other columns, whatever their names, play no part.
"""

from __future__ import annotations

import itertools
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.shipping import ship
from .shared import bound_batches, freeing, read_table, release, settle

#: Words to start from, and closed classes in the languages of the corpus.
INSULTS = "idiot moron stupid trash pathetic disgusting worthless clown loser scum dumb fool ugly vermin filth".split()
THREATS = "kill hurt destroy smash beat stab shoot burn hang crush töten schlagen tuer frapper matar golpear".split()
TARGETS = "you your yours u he she they him her them his their du dich dein ihr tu toi ton vous votre ils usted ustedes ellos".split()
#: Endings that a word of the lists above may have; fixed values.
ENDINGS = ("", "s", "es", "ed", "d", "ing", "er", "ers", "en", "t", "te", "st", "ez", "ent", "an", "ada", "ado", "ic", "y", "ty")
NEGATIONS = "not no never isn't aren't wasn't don't doesn't nicht kein keine nie ne pas jamais nunca jamás".split()
SAYING = "said says say told wrote writes called claimed quoted sagte sagt schrieb dit disait écrit dijo dice escribió".split()

PUNCTUATION = ".,;:!?\"'()[]«»…"
CLAUSE_ENDS = ".,;:!?…"
STEM_LENGTHS = range(4, 9)
PLAIN, TARGET, NEGATION, REPORT, INSULT, THREAT = CLASSES = ("plain", "target", "negation", "report", "insult", "threat")
TAPES = tuple(itertools.product(("insult", "threat"), ("plain", "negated", "reported"), (False, True)))
#: What a weight is worth on a tape: by how it is said, and by whether the clause has a target.
HOW = {"plain": 1.0, "negated": 0.3, "reported": 0.4}
AIMED = 1.5
#: Times what a clause is worth in which insult, threat and target have met.
WORST = 1.5
FACTOR = {(kind, how, aimed): HOW[how] * (AIMED if aimed else 1.0) for kind, how, aimed in TAPES}
FEATURES = 3

#: Machines as (start, {(state, class): next}); a pair that isn't listed stays in its state.
TARGET_MACHINE = ("none", {("none", TARGET): "aimed"})
NEGATION_MACHINE = (0, {(k, c): max(0, k - 1) if c != NEGATION else 3 for k in range(4) for c in CLASSES})
REPORT_MACHINE = ("own", {("own", REPORT): "reported"})
INSULT_MACHINE = ("clean", {("clean", INSULT): "insult"})
THREAT_MACHINE = ("calm", {("calm", THREAT): "threat"})


def compose(*machines):
    """The product of machines over the same classes."""
    start = tuple(m[0] for m in machines)
    table, queue = {}, [start]
    while queue:
        state = queue.pop()
        for c in CLASSES:
            to = tuple(m[1].get((s, c), s) for s, m in zip(state, machines))
            if (state, c) not in table:
                table[state, c] = to
                queue.append(to)
    return start, table


CLOSED = {w: TARGET for w in TARGETS} | {w: NEGATION for w in NEGATIONS} | {w: REPORT for w in SAYING}


class LetterTransducer:
    """Stems with their endings as states over letters; a word is put out as (class, weight) of its longest stem."""

    def __init__(self):
        self.arcs: list[dict[str, int]] = [{}]
        self.final: dict[int, tuple[str, float]] = {}  # the word may end here
        self.open: dict[int, tuple[str, float]] = {}  # from here any letters may follow

    def _path(self, letters: str, state: int = 0) -> int:
        for c in letters:
            to = self.arcs[state].get(c)
            if to is None:
                to = self.arcs[state][c] = len(self.arcs)
                self.arcs.append({})
            state = to
        return state

    def add(self, stem: str, out: tuple[str, float], endings: tuple[str, ...] | None) -> None:
        end = self._path(stem)
        if endings is None:
            self.open[end] = out
            return
        for ending in endings:
            self.final.setdefault(self._path(ending, end), out)

    def read(self, word: str) -> tuple[str, float] | None:
        state, best = 0, None
        for c in word:
            best = self.open.get(state, best)
            state = self.arcs[state].get(c)
            if state is None:
                return best
        return self.final.get(state) or self.open.get(state, best)


def lexicon_of(stems: dict[str, float]) -> LetterTransducer:
    """The union of both lexicons: threats, the listed insults and the learned stems."""
    out = LetterTransducer()
    for word in THREATS:
        out.add(word, (THREAT, 1.0), ENDINGS)
    for stem, w in stems.items():
        out.add(stem, (INSULT, w), None)
    return out


class Lexicon(dict):
    """Piece of text, lower case → None, or its class and weight.  Emptied when its strings exceed FULL bytes."""

    FULL = 8_000_000

    def __init__(self, stems: dict[str, float]):
        super().__init__()
        self.letters, self.held = lexicon_of(stems), 0

    def __missing__(self, piece: str):
        self.held += len(piece)
        if self.held > self.FULL:
            self.clear()
            self.held = len(piece)
        found = self[piece] = self.letters.read(piece.strip(PUNCTUATION))
        return found


class Grammar:
    def __init__(self, stems: dict[str, float]):
        self.lexicon = Lexicon(stems)
        self.start, self.table = compose(TARGET_MACHINE, NEGATION_MACHINE, REPORT_MACHINE, INSULT_MACHINE, THREAT_MACHINE)

    def clauses(self, text: str):
        """The scores of the clauses with a match, and the number of all clauses."""
        pieces = text.lower().split()
        hits = [k for k, found in enumerate(map(self.lexicon.__getitem__, pieces)) if found]
        matched, at = [], 0
        while at < len(hits):
            first = last = hits[at]
            while first and pieces[first - 1][-1] not in CLAUSE_ENDS:
                first -= 1
            while last < len(pieces) - 1 and pieces[last][-1] not in CLAUSE_ENDS:
                last += 1
            matched.append(clause_score(*self._run(pieces[first : last + 1])))
            while at < len(hits) and hits[at] <= last:
                at += 1
        ends = sum(p[-1] in CLAUSE_ENDS for p in pieces)
        return matched, ends + bool(pieces and pieces[-1][-1] not in CLAUSE_ENDS)

    def _run(self, pieces: list[str]) -> tuple[list[tuple[tuple, float]], tuple]:
        """The composed machine on one clause: what it puts out on which tape, and the state it ends in."""
        state, out = self.start, []
        for piece in pieces:
            found = self.lexicon[piece]
            state = self.table[state, found[0] if found else CLOSED.get(piece.strip(PUNCTUATION), PLAIN)]
            if found:
                out.append((found[0], "reported" if state[2] == "reported" else "negated" if state[1] else "plain", found[1]))
        aimed = state[0] == "aimed"  # a target may also come behind
        return [((kind, how, aimed), w) for kind, how, w in out], state

    def features(self, text: str | None) -> list[float]:
        scores, n = self.clauses(text or "")
        return [math.log1p(sum(scores)), max(scores, default=0.0), 10.0 * len(scores) / (n + 4)]


def clause_score(out: list[tuple[tuple, float]], state: tuple) -> float:
    worst = state[0] == "aimed" and state[3] == "insult" and state[4] == "threat"
    return sum(FACTOR[tape] * w for tape, w in out) * (WORST if worst else 1.0)


#: Before anything is learned: an insult in a clause makes a text more likely toxic than not.
DEFAULT = np.array([-3.0, 1.5, 0.5, 0.2])


def stems_in(text: str) -> set[str]:
    words = {w.strip(PUNCTUATION) for w in set(text.lower().split())}
    return {w[:n] for w in words for n in STEM_LENGTHS if len(w) >= n}


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Ridge logistic regression with weights of zero or more: Newton steps over the weights that are free.

    A weight is held at zero as long as its slope points below.  Columns are scaled; the coefficients are those of raw ones.
    """
    scale = x.std(0) + 1e-9
    a = np.c_[np.ones(len(x)), x / scale]
    b = np.zeros(a.shape[1])
    pull = np.r_[1e-6, np.full(x.shape[1], ridge)]
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
        slope = a.T @ (y - p) - pull * b
        free = (b > 0) | (slope > 0)
        free[0] = True
        curve = (a * (p * (1 - p) + 1e-9)[:, None]).T @ a + np.diag(pull)
        step = np.zeros_like(b)
        step[free] = np.linalg.solve(curve[np.ix_(free, free)], slope[free])
        new = b + step
        new[1:] = np.maximum(new[1:], 0.0)
        done = np.abs(new - b).max() < 1e-6
        b = new
        if done:
            break
    return np.r_[b[0], b[1:] / scale]


def fold(key):
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(4))


class Model:
    def __init__(self, stems: dict[str, float], weights: np.ndarray):
        self.stems, self.weights = stems, weights

    def score(self, text) -> DataFrame:
        stems, weights = self.stems, self.weights

        @F.arrow_udf("double")
        def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            grammar = Grammar(stems)
            try:
                for batch in batches:
                    x = np.array([grammar.features(t) for t in batch.to_pylist()]).reshape(-1, FEATURES)
                    z = np.clip(weights[0] + x @ weights[1:], -30, 30)
                    yield pa.array(1 / (1 + np.exp(-z)), pa.float64())
            finally:
                del grammar
                release()

        return scored(text)


def learn(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "toxic", sample_rows: int = 20_000, stems_kept: int = 3_000) -> Model:
    """The model, from the labelled rows that are not held out."""
    ship(docs.sparkSession)
    bound_batches(docs.sparkSession)
    own = labels.filter(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias("id")).agg(F.max(label).alias("y"))
    own = own.withColumn("fold", fold(F.col("id"))).filter("fold != 2").orderBy(F.xxhash64("id"), "id").limit(sample_rows)
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text")).join(F.broadcast(own), "id")  # of sample_rows at most
    rows = rows.groupBy(F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest")).agg(F.min(F.struct("id", "text", "y", "fold")).alias("r")).select("r.*")
    rows = settle(rows, "toxic-sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, docs_of = (Counter(), Counter()), [0, 0]
        for batch in batches:
            for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                docs_of[y > 0] += 1
                seen[y > 0].update(stems_in(t or ""))
        seen[0][""], seen[1][""] = docs_of
        names = sorted({*seen[0], *seen[1]})
        for k in range(0, len(names), 50_000):
            part = names[k : k + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array([seen[1][s] for s in part], pa.int64()), pa.array([seen[0][s] for s in part], pa.int64())], names=["stem", "bad", "good"])

    counts = rows.filter("fold != 3").select("text", "y").mapInArrow(freeing(count), "stem string, bad long, good long").groupBy("stem").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    counts = settle(counts, "toxic-stems")
    total = counts.filter("stem = ''").select("bad", "good").first()
    n_bad, n_good = (total.bad or 0, total.good or 0) if total else (0, 0)
    stems = {w: 2.0 for w in INSULTS}
    if min(n_bad, n_good) >= 10:
        odds = F.log((F.col("bad") + 0.5) / F.lit(n_bad + 1.0)) - F.log((F.col("good") + 0.5) / F.lit(n_good + 1.0))
        sure = odds / F.sqrt(1 / (F.col("bad") + 0.5) + 1 / (F.col("good") + 0.5))
        kept = counts.filter((F.col("bad") >= 4) & (F.col("stem") != "")).select("stem", odds.alias("odds"), sure.alias("sure")).filter("odds > 1.2 AND sure > 3")
        stems |= {r.stem: min(r.odds, 5.0) for r in kept.orderBy(F.desc("sure"), "stem").limit(stems_kept).collect()}

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(stems)
        for batch in batches:
            x = [grammar.features(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column(1).cast(pa.float64())], names=["x", "y"])

    seen = rows.filter("fold = 3").orderBy("id").select("text", "y").mapInArrow(freeing(features), "x array<double>, y double").toArrow()
    y = seen["y"].to_numpy()
    weights = DEFAULT
    if len(y) and min(y.sum(), (1 - y).sum()) >= 10:
        weights = fit_logistic(np.array(seen["x"].to_pylist()), y)
    return Model(stems, weights)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = learn(docs, read_table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", (F.coalesce(fold(F.col("doc_id")), F.lit(-1)) == 2).alias("held_out"), model.score(F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))
