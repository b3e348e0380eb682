"""Toxicity by noisy-channel deobfuscation.

A written token may hide a word: letters replaced by look-alike signs, set apart
by spaces or signs, or repeated.  Every token with a sign or a doubled letter is
read as a lattice: each character may stand for itself, for the letters it looks
like, for the letter before it once more, or (signs) for nothing or a word's end.
Viterbi decoding over all states of the lattice, the last two letters each, finds
the letters of highest probability under a character trigram model and the
channel's costs; a token that hides nothing is best read as itself.  The restored
words, with the other words of the text, are scored by a logistic model of words
and their beginnings.

The trigram model is counted over the whole texts of all rows that are not held
out.  The classifier is fitted on at most about ``positive`` and ``negative``
labelled rows that are not held out, chosen by a hash of the id; its features are
those more frequent in toxic rows, found in three of them at least, with an L1
penalty.  Language, source and id are never read by a score.

Nulls and odd inputs: a null or empty text gets the score of a text without a
feature; a label without its document, a null label or a null id teaches
nothing; of several labels of one id the largest counts; without labelled rows
of both kinds every score is the share of toxic labels (0 without labels); equal
texts get equal scores; texts are read whole; an empty table gives no rows.
Other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from .common import by_batch, held_out

#: Labelled rows of each kind that the classifier learns from, about.
POSITIVE, NEGATIVE = 3000, 5000
#: Buckets of the trigram model's hashed counts, and tokens that a worker keeps.
BUCKETS, KNOWN = 1 << 18, 200_000
PREFIXES = (3, 4, 5, 6, 7)

#: The letters that a sign or digit can stand for.
LOOKS_LIKE = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i",
}
SEPARATORS = frozenset(" .-_*~'`^,:;/\\")

_LETTER = r"[^\W\d_]"
_WORD = re.compile(f"{_LETTER}+")
_DOUBLED = re.compile(rf"({_LETTER})\1")
#: Four letters or more, each set apart by one or two separators; a letter is no separator, so there is one way to read a run.
_APART = re.compile(r"(?<!\S)(?:[^\s.\-_*][ .\-_*]{1,2}){3,}[^\s.\-_*](?!\S)")
#: Signs around a token that belong to the sentence.
_AROUND = ".,;:?\"'()[]"


_STEP = 0x9E3779B97F4A7C15


def _bucket(gram: str) -> int:
    value = len(gram)
    for c in gram:
        value = (value ^ ord(c)) * _STEP % 2**64
        value ^= value >> 29
    return (value >> 32) % BUCKETS


def _buckets(points: np.ndarray, order: int) -> np.ndarray:
    """_bucket() of the n-gram that ends at each place from the third on."""
    n = len(points)
    value = np.full(n - 2, order, np.uint64)
    for i in range(order):
        value = (value ^ points[3 - order + i : n + 1 - order + i]) * np.uint64(_STEP)
        value ^= value >> np.uint64(29)
    return ((value >> np.uint64(32)) % np.uint64(BUCKETS)).astype(np.int64)


def gram_counts(words: Counter) -> np.ndarray:
    """Counts of 1-, 2- and 3-grams that end in a word or at its end, two marks standing before it."""
    out = np.zeros(BUCKETS)
    if not words:
        return out
    points = np.frombuffer(("  " + "   ".join(words) + " ").encode("utf-32-le"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    times = np.fromiter(words.values(), np.float64, len(words))
    # of each word's places with its end, and of the two marks that follow it, which count nothing
    weight = np.repeat(np.column_stack([times, np.zeros(len(words))]).ravel(), np.column_stack([sizes + 1, np.full(len(words), 2)]).ravel())[: len(points) - 2]
    for order in (1, 2, 3):
        out += np.bincount(_buckets(points, order), weight, BUCKETS)
    out[_bucket("  ")] += times.sum()  # the context that begins a word
    return out


class Letters:
    """Character trigram model over words between marks, from hashed counts of 1-, 2- and 3-grams."""

    def __init__(self, counts: np.ndarray, total: float):
        self.counts, self.total = counts, total
        self.costs = Costs(self)

    def cost(self, before: str, c: str) -> float:
        """Minus log of the interpolated probability of c after two characters."""
        n = self.counts
        one = (n[_bucket(c)] + 0.1) / (self.total + 100)
        pair = (n[_bucket(before[1] + c)] + 2 * one) / (n[_bucket(before[1])] + 2)
        three = (n[_bucket(before + c)] + 4 * pair) / (n[_bucket(before)] + 4)
        return -math.log(max(min(0.8 * three + 0.15 * pair + 0.05 * one, 1.0), 1e-9))


class Costs(dict):
    """Costs of trigrams that have been asked for, at most KNOWN of them."""

    def __init__(self, letters: Letters):
        super().__init__()
        self.letters = letters

    def __missing__(self, gram: str) -> float:
        if len(self) > KNOWN:
            self.clear()
        cost = self[gram] = self.letters.cost(gram[:2], gram[2])
        return cost

    def __reduce__(self):
        return Costs, (self.letters,)


#: Channel costs in nats: a sign for a letter, a repeated letter, a separator left out, a word's end at a separator, a sign left out.
SIGN, REPEAT, SKIP, BREAK, NOTHING = 1.0, 1.5, 0.2, 2.0, 5.0


def restore(token: str, letters: Letters) -> str:
    """The most probable words behind a token in lower case, by Viterbi decoding of its lattice.

    A state is the last two letters; each keeps its least cost and the path to
    it.  Of equal costs the first found stays.
    """
    states: dict[str, tuple[float, tuple | None]] = {"  ": (0.0, None)}
    last, costs = "", letters.costs
    for c in token:
        letter_itself = c.isalpha()
        if letter_itself and c != last and len(states) == 1:  # nothing to choose
            ((state, (cost, path)),) = states.items()
            states, last = {state[1] + c: (cost + costs[state + c], (path, c))}, c
            continue
        after: dict[str, tuple[float, tuple | None]] = {}
        stands_for = c if letter_itself else LOOKS_LIKE.get(c, "")
        sign = 0.0 if letter_itself else SIGN
        apart = c in SEPARATORS
        for state, (cost, path) in states.items():
            end = state[1]
            for letter in stands_for:
                new, total = end + letter, cost + sign + costs[state + letter]
                if new not in after or total < after[new][0]:
                    after[new] = (total, (path, letter))
            if c == last and end in stands_for and (state not in after or cost + REPEAT < after[state][0]):
                after[state] = (cost + REPEAT, path)
            if not letter_itself:
                total = cost + (SKIP if apart else NOTHING)
                if state not in after or total < after[state][0]:
                    after[state] = (total, path)
                if apart and end != " ":
                    total = cost + BREAK + costs[state + " "]
                    if "  " not in after or total < after["  "][0]:
                        after["  "] = (total, (path, " "))
        states, last = after, c
    _, (_, path) = min(states.items(), key=lambda s: (s[1][0] + costs[s[0] + " "], s[0]))
    out: list[str] = []
    while path is not None:
        path, c = path
        out.append(c)
    return "".join(reversed(out))


class Reader:
    """The features of whole texts: words and their beginnings, restored where they are hidden."""

    def __init__(self, letters: Letters | None):
        self.letters = letters
        self.plain: set[str] = set()  # tokens that are read as themselves
        self.known: dict[str, tuple[str, ...]] = {}

    def words(self, text: str | None) -> set[str]:
        """Distinct words of the restored text."""
        if not text:
            return set()
        lower, plain, known = text.lower(), self.plain, self.known
        for kept in (plain, known):
            if len(kept) > KNOWN:
                kept.clear()
        tokens = set(lower.split())
        out = tokens & plain
        for token in tokens - plain:
            if (found := known.get(token)) is not None:
                out.update(found)
            elif token.isalpha() and not _DOUBLED.search(token):
                plain.add(token)
                out.add(token)
            else:
                found = known[token] = self._token(token)
                out.update(found)
        if self.letters:
            for m in _APART.finditer(lower):
                out.update(restore(m[0], self.letters).split())
        return out

    def _token(self, token: str) -> tuple[str, ...]:
        bare = token.strip(_AROUND)
        if self.letters and (not bare.isalpha() or _DOUBLED.search(bare)):
            return tuple(restore(bare, self.letters).split())
        return tuple(_WORD.findall(bare))


def features(word: str) -> list[str]:
    """A word and its beginnings (marked, so that they differ from words)."""
    return [word] + [word[:k] + "~" for k in PREFIXES if len(word) > k]


@dataclass
class Classifier:
    weights: dict[str, float]
    base: float
    letters: Letters | None

    def scorer(self):
        reader, weights, base = Reader(self.letters), self.weights, self.base
        # a word that has a feature begins as one of them does
        heads = {f.rstrip("~")[: PREFIXES[0]] for f in weights}

        def score(text: str | None) -> float:
            found = {f for w in reader.words(text) if w[: PREFIXES[0]] in heads for f in features(w) if f in weights}
            z = base + sum(weights[f] for f in sorted(found))
            return 1 / (1 + math.exp(-max(min(z, 500.0), -500.0)))

        return score


def letter_model(docs: DataFrame, text: str) -> Letters:
    """Trigram counts of every whole text; a task sends at most BUCKETS sums, and so does Spark to the driver."""

    def make():
        total = np.zeros(BUCKETS)

        def work(batch):
            if batch is not None:
                total[:] += gram_counts(Counter(w for t in batch.column(0) if t.is_valid for w in _WORD.findall(t.as_py().lower())))
                return None
            at = np.flatnonzero(total)
            return {"bucket": pa.array(at, pa.int32()), "n": pa.array(total[at].astype(np.int64))}

        work.last = True
        return work

    found = by_batch(docs.select(F.col(text).cast("string").alias("text")), make, "bucket int, n long")
    counts = np.zeros(BUCKETS)
    for row in found.groupBy("bucket").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[row.bucket] = row.n
    return Letters(counts, float(counts.sum()) / 3)


def fit(rows: list[tuple[int, np.ndarray]], n: int, *, share: float = 0.375, l1: float = 0.0005, steps: int = 400) -> tuple[np.ndarray, float]:
    """Weights and base of a logistic model with an L1 penalty, by accelerated proximal gradient steps.

    Rows weigh so that positive ones count for ``share``, however many there are.
    """
    y = np.array([r[0] for r in rows], float)
    each = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    sizes = np.array([len(r[1]) for r in rows])
    columns = np.concatenate([r[1] for r in rows]).astype(np.int64) if sizes.sum() else np.empty(0, np.int64)
    lines = np.repeat(np.arange(len(rows)), sizes)
    w, base = np.zeros(n), math.log(share / (1 - share))
    vw, vb, t = w.copy(), base, 1.0
    # a bound of the curvature: the largest singular value by a few power steps
    u = np.ones(n + 1) / math.sqrt(n + 1)
    for _ in range(20):
        z = np.bincount(lines, u[columns], len(rows)) + u[-1]
        u = np.append(np.bincount(columns, z[lines], n), z.sum())
        size = np.linalg.norm(u)
        u /= size
    step = 4 * len(rows) / (size * each.max())
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(np.bincount(lines, vw[columns], len(rows)) + vb)))
        g = each * (p - y) / len(rows)
        new = vw - step * np.bincount(columns, g[lines], n)
        new = np.sign(new) * np.maximum(np.abs(new) - step * l1, 0)
        new_base = vb - step * g.sum()
        t2 = (1 + math.sqrt(1 + 4 * t * t)) / 2
        vw, vb = new + (t - 1) / t2 * (new - w), new_base + (t - 1) / t2 * (new_base - base)
        w, base, t = new, new_base, t2
    return w, base


def train(
    docs: DataFrame, labels: DataFrame, *, positive: int = POSITIVE, negative: int = NEGATIVE, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic"
) -> Classifier:
    """The letter model of all rows that are not held out, and a classifier of a bounded sample of labelled ones."""
    own = labels.where(F.col(doc_id).isNotNull() & F.col(toxic).isNotNull() & ~held_out(doc_id))
    own = own.groupBy(F.col(doc_id).alias("id")).agg((F.max(toxic) > 0).cast("int").alias("toxic"))
    counts = {r.toxic: r["count"] for r in own.groupBy("toxic").count().collect()}
    letters = letter_model(docs.where(~held_out(doc_id)), text)
    share = counts.get(1, 0) / max(sum(counts.values()), 1)
    if len(counts) < 2:
        return Classifier({}, 40.0 if share == 1 else -40.0, letters)
    wanted = F.when(F.col("toxic") == 1, F.lit(positive / counts[1])).otherwise(F.lit(negative / counts[0]))
    chosen = own.where(F.pmod(F.xxhash64(F.lit("toxicity"), "id"), F.lit(1 << 20)) < wanted * (1 << 20))
    # bounded by positive + negative rows, about: safe to broadcast
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text")).join(F.broadcast(chosen), "id").select("toxic", "text")

    def count():
        reader = Reader(letters)

        def work(batch):
            sums: Counter = Counter()
            for y, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = {f for w in reader.words(t) for f in features(w)}
                sums.update((f, y) for f in found)
            both = {f for f, _ in sums}
            return {"f": list(both), "n1": [sums[f, 1] for f in both], "n0": [sums[f, 0] for f in both]}

        return work

    total = {r.toxic: r["count"] for r in chosen.groupBy("toxic").count().collect()}
    ratio = ((F.col("n1") + 0.5) / (total.get(1, 0) + 1)) / ((F.col("n0") + 0.5) / (total.get(0, 0) + 1))
    table = by_batch(rows, count, "f string, n1 long, n0 long").groupBy("f").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
    best = table.where(F.col("n1") >= 3).withColumn("r", F.log(ratio)).where("r > 1")
    # bounded by the words of the chosen rows
    names = {f: i for i, f in enumerate(sorted(r.f for r in best.select("f").collect()))}
    if not names:
        return Classifier({}, math.log(share / (1 - share)), letters)

    def place():
        reader = Reader(letters)

        def work(batch):
            texts = batch.column(1).to_pylist()
            found = [sorted({names[f] for w in reader.words(t) for f in features(w) if f in names}) for t in texts]
            return {"toxic": batch.column(0), "at": found}

        return work

    placed = by_batch(rows, place, "toxic int, at array<int>").collect()
    weights, base = fit([(r.toxic, np.array(r["at"], np.int64)) for r in placed], len(names))
    return Classifier({f: float(weights[i]) for f, i in names.items() if weights[i]}, float(base), letters)


def score_toxicity(docs: DataFrame, model: Classifier, *, threshold: float = 0.7, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """All rows of docs with toxic_score and toxic_predicted; they replace columns of these names."""
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("toxic_score", "toxic_predicted")])

    names = docs.columns
    at = names.index(text)

    def make():
        score = model.scorer()

        def work(batch):
            scores = [score(t.as_py()) for t in batch.column(at).cast("string")]
            return {c: batch.column(i) for i, c in enumerate(names)} | {"toxic_score": scores, "toxic_predicted": [int(s >= threshold) for s in scores]}

        return work

    return by_batch(docs, make, StructType([*docs.schema.fields, StructField("toxic_score", DoubleType()), StructField("toxic_predicted", IntegerType())]))
