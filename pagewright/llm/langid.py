"""Language identification by interpolated Kneser-Ney character models.

Texts are read as letters: other characters end a word, case is folded, and a
word stands between space marks.  For each language the counts of all character
n-grams up to ``order`` are taken over the words of its labelled rows; the
highest order counts occurrences, the lower ones distinct left neighbours, and
each order is discounted and interpolated with the next lower, down to a uniform
share.  A model is, for each order, a sorted array of 64-bit n-gram hashes with
the discounted probability, and one of context hashes with the weight that goes
to the lower order; looking up is a binary search.

A text goes to the language with the least cross-entropy a character.  The score
is a softmax over the languages of the cross-entropies times the number of
characters, with a temperature fitted on labelled rows that the counts leave out;
a text is rejected if its score, or its
cross-entropy, is worse than that of nearly all those rows.

Training takes at most about ``sample`` whole rows a language, chosen by a hash
of the id; rows that are held out never are.  The sample alone bounds the models:
all its n-grams are counted, by Spark, and all are kept.  Scoring reads whole texts.

Nulls and odd inputs: a null or empty text, or one without a letter, is ``und``
with score 0; an unseen character costs the uniform share; rows with a null
label teach nothing; ties go to the language first in code-point order; without
any labelled row every text is ``und`` with score 0; equal texts get equal rows;
an empty table gives no rows.  Columns other than id, text and (for training)
lang are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_batch, held_out, stored

ORDER = 4
#: Rows a language that the models learn from, about.
SAMPLE = 1500
UND = "und"
#: Words whose costs a worker keeps at most, but for those of one batch.
KNOWN = 150_000

_WORD = re.compile(r"[^\W\d_]+")
_MUL = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.casefold()) if text else []


def chars(words: list[str]) -> np.ndarray:
    """Code points of the words with a space mark before each and one at the end."""
    return np.frombuffer((" " + " ".join(words) + " ").encode("utf-32-le"), np.uint32).astype(np.uint64)


def _start(order: int) -> int:
    return order * 0xD6E8FEB86659FD93 % 2**64


def gram_hashes(points: np.ndarray, order: int) -> np.ndarray:
    """Hash of the n-gram that ends at each place, of places with a whole n-gram."""
    n = len(points) - order + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    mixed = np.full(n, _start(order), np.uint64)
    for i in range(order):
        mixed = (mixed ^ points[i : i + n]) * _MUL
        mixed ^= mixed >> np.uint64(29)
    return mixed


@dataclass
class Language:
    """One language's counts made into sorted arrays: for each order from 1, hashes with discounted probabilities, and context hashes with the weight of the lower order."""

    name: str
    grams: list[tuple[np.ndarray, np.ndarray]]
    contexts: list[tuple[np.ndarray, np.ndarray]]
    uniform: float


def count_grams(lists: list[list[str]], order: int) -> Counter:
    """Occurrences of every n-gram of the words up to the order, words apart."""
    counts: Counter = Counter()
    for word, times in Counter(w for words in lists for w in words).items():
        marked = f" {word} "
        for k in range(1, order + 1):
            for i in range(len(marked) - k + 1):
                counts[marked[i : i + k]] += times
    return counts


def kneser_ney(name: str, counts: dict[str, int], order: int, alphabet: int) -> Language:
    """The interpolated model of n-gram counts."""
    levels: list[dict[str, int]] = [{} for _ in range(order)]
    for gram, c in counts.items():
        if len(gram) == order or gram[0] == " ":  # nothing stands before the mark that begins a word
            levels[len(gram) - 1][gram] = c
    left: list[Counter] = [Counter() for _ in range(order)]
    for gram in counts:
        if len(gram) > 1:
            left[len(gram) - 2][gram[1:]] += 1
    for k in range(order - 1):
        for gram, n in left[k].items():
            if gram[0] != " ":
                levels[k][gram] = n
    levels[0].pop(" ", None)
    if left[0][" "]:
        levels[0][" "] = left[0][" "]
    grams, contexts = [], []
    for k, level in enumerate(levels):
        ones, twos = sum(c == 1 for c in level.values()), sum(c == 2 for c in level.values())
        discount = ones / (ones + 2 * twos) if ones and twos else 0.5
        total, kinds = Counter(), Counter()
        for gram, c in level.items():
            total[gram[:-1]] += c
            kinds[gram[:-1]] += 1
        items = list(level.items())
        heads, hashes = _hashed([g for g, _ in items], k + 1), None
        value = np.array([max(c - discount, 0) / total[g[:-1]] for g, c in items])
        grams.append(_sorted(heads, value))
        if k == 0:
            weight = discount * kinds[""] / total[""] if total[""] else 1.0
            contexts.append((np.zeros(1, np.uint64), np.array([weight])))
        else:
            names = list(total)
            hashes = _hashed(names, k)
            contexts.append(_sorted(hashes, np.array([discount * kinds[c] / total[c] for c in names])))
    return Language(name, grams, contexts, 1.0 / alphabet)


def _hashed(grams: list[str], k: int) -> np.ndarray:
    if not grams:
        return np.empty(0, np.uint64)
    points = np.frombuffer("".join(grams).encode("utf-32-le"), np.uint32).astype(np.uint64).reshape(-1, k)
    mixed = np.full(len(points), _start(k), np.uint64)
    for i in range(k):
        mixed = (mixed ^ points[:, i]) * _MUL
        mixed ^= mixed >> np.uint64(29)
    return mixed


def _sorted(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    by = np.argsort(keys)
    return keys[by], values[by]


class Tables:
    """The languages' arrays side by side: one sorted hash array for each order, with a column of values a language."""

    def __init__(self, models: list[Language]):
        order = len(models[0].grams)
        self.uniform = np.array([m.uniform for m in models])
        self.grams = [self._side_by_side([m.grams[k] for m in models], 0.0) for k in range(order)]
        self.contexts = [self._side_by_side([m.contexts[k] for m in models], 1.0) for k in range(order)]

    @staticmethod
    def _side_by_side(pairs: list[tuple[np.ndarray, np.ndarray]], missing: float) -> tuple[np.ndarray, np.ndarray]:
        keys = np.unique(np.concatenate([k for k, _ in pairs]))
        # a last row stands for whatever is not found
        values = np.full((len(keys) + 1, len(pairs)), missing)
        for column, (own, value) in enumerate(pairs):
            values[np.searchsorted(keys, own), column] = value
        return keys, values

    @staticmethod
    def _find(table: tuple[np.ndarray, np.ndarray], wanted: np.ndarray) -> np.ndarray:
        keys, values = table
        if not len(keys):
            return values[np.zeros(len(wanted), np.int64)]
        at = np.searchsorted(keys, wanted)
        at[at == len(keys)] = 0
        return values[np.where(keys[at] == wanted, at, len(keys))]

    def probabilities(self, points: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """(place, language): of each character after the first mark, given those of its word before it.

        points: words between single marks, which stand at ``ends``.
        """
        n = len(points) - 1
        places = np.arange(n)
        starts = np.zeros(n, np.int64)
        starts[ends[:-1]] = places[ends[:-1]]
        before = places - np.maximum.accumulate(starts)  # letters of the word before each place
        p = np.broadcast_to(self.uniform, (n, len(self.uniform)))
        p = self._find(self.grams[0], gram_hashes(points, 1)[1:]) + self.contexts[0][1][0] * p
        for k in range(2, len(self.grams) + 1):
            use = np.flatnonzero(before >= k - 2)
            if not len(use):
                break
            at = use - (k - 2)
            own = self._find(self.grams[k - 1], gram_hashes(points, k)[at])
            weight = self._find(self.contexts[k - 1], gram_hashes(points[:-1], k - 1)[at])
            p[use] = own + weight * p[use]
        return p


@dataclass
class Identifier:
    models: list[Language]
    temperature: float = 1.0
    least_score: float = 0.0
    most_entropy: float = float("inf")


class Scorer:
    """Costs of whole texts in nats; a word's cost does not depend on its neighbours, so words are kept in a bounded table."""

    def __init__(self, own: Identifier):
        self.own = own
        self.tables = Tables(own.models) if own.models else None
        self._clear()

    def _clear(self) -> None:
        self.at: dict[str, int] = {}
        self.costs = np.empty((KNOWN, len(self.own.models) + 1))

    def learn(self, words: list[str]) -> None:
        """Work out the words' costs in every language, and their sizes, together."""
        first = len(self.at)
        while len(self.costs) < first + len(words):
            self.costs = np.concatenate([self.costs, np.empty_like(self.costs)])
        for i in range(0, len(words), 8192):
            part = words[i : i + 8192]
            points = chars(part)
            ends = np.flatnonzero(points == 32)
            logs = -np.log(self.tables.probabilities(points, ends))
            self.costs[first + i : first + i + len(part)] = np.column_stack([np.add.reduceat(logs, ends[:-1], axis=0), np.diff(ends)])
        self.at.update(zip(words, range(first, first + len(words)), strict=True))

    def entropies(self, texts: list[str | None]) -> list[tuple[np.ndarray | None, int]]:
        """For each text its cost a character in each language, and its number of characters."""
        if len(self.at) > KNOWN:
            self._clear()
        every = [words_of(t) for t in texts]
        new = set().union(*every).difference(self.at)
        # signs that count as digits elsewhere are no letters
        odd = {w for w in new if not any(map(str.isalpha, w))}
        if self.tables is None:
            return [(None, 0)] * len(texts)
        self.learn(sorted(new - odd))
        out: list[tuple[np.ndarray | None, int]] = []
        for words in every:
            if odd:
                words = [w for w in words if w not in odd]
            if not words:
                out.append((None, 0))
                continue
            total = self.costs[np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))].sum(axis=0)
            out.append((total[:-1] / total[-1], int(total[-1])))
        return out

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, float, bool]]:
        """For each text language, score, cross-entropy and whether it is rejected."""
        return [self._decide(each, n) for each, n in self.entropies(texts)]

    def _decide(self, each: np.ndarray | None, n: int) -> tuple[str, float, float, bool]:
        if each is None:
            return UND, 0.0, 0.0, True
        own = self.own
        best = int(each.argmin())
        scaled = -(each - each[best]) * n / own.temperature
        score = float(1 / np.exp(scaled).sum())
        return own.models[best].name, score, float(each[best]), score < own.least_score or float(each[best]) > own.most_entropy


def train(docs: DataFrame, *, order: int = ORDER, sample: int = SAMPLE, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Identifier:
    """Models and calibration from labelled rows that are not held out.

    The counts are summed by Spark; the driver gets the n-grams of the sample, and
    the calibration rows' entropies (a tenth of the sample).
    """
    rows = docs.where(F.col(lang).isNotNull() & ~held_out(doc_id)).select(F.col(lang).cast("string").alias("lang"), F.col(doc_id).cast("string").alias("id"), F.col(text).cast("string").alias("text"))
    sizes = rows.groupBy("lang").count()
    share = F.pmod(F.xxhash64(F.lit("langid"), "id"), F.lit(1 << 20)) * F.col("count") < F.lit(sample << 20)
    chosen = stored(rows.join(F.broadcast(sizes) if sizes.count() <= 10_000 else sizes, "lang").where(share).select("lang", "text", (F.pmod(F.xxhash64(F.lit("check"), "id"), F.lit(10)) == 0).alias("check")), "langid-sample")

    def make():
        def work(batch):
            by: dict[str, list] = {}
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by.setdefault(name, []).append(words_of(text))
            out = [(name, gram, n) for name, lists in by.items() for gram, n in count_grams(lists, order).items()]
            return {"lang": [o[0] for o in out], "gram": [o[1] for o in out], "n": [o[2] for o in out]}

        return work

    counted = by_batch(chosen.where("not check").select("lang", "text"), make, "lang string, gram string, n long")
    counted = stored(counted.groupBy("lang", "gram").agg(F.sum("n").alias("n")), "langid-counts")
    grams: dict[str, dict[str, int]] = {}
    for r in counted.toLocalIterator():
        grams.setdefault(r.lang, {})[r.gram] = r.n
    if not grams:
        return Identifier([])
    alphabet = len({g for own in grams.values() for g in own if len(g) == 1}) + 1
    models = [kneser_ney(name, dict(sorted(grams[name].items())), order, alphabet) for name in sorted(grams)]
    return calibrate(Identifier(models), chosen.where("check").select("lang", "text"))


def calibrate(own: Identifier, rows: DataFrame) -> Identifier:
    """Temperature of least log-loss on the rows, and bounds that nearly all of them meet."""
    names = [m.name for m in own.models]

    def make():
        scorer = Scorer(own)

        def work(batch):
            out = []
            for name, (each, n) in zip(batch.column(0).to_pylist(), scorer.entropies(batch.column(1).to_pylist()), strict=True):
                if each is not None and name in names:
                    out.append((names.index(name), n, each.tolist()))
            return {"truth": [o[0] for o in out], "n": [o[1] for o in out], "each": [o[2] for o in out]}

        return work

    found = by_batch(rows, make, "truth int, n long, each array<double>").collect()
    if not found:
        return own
    truth = np.array([f.truth for f in found])
    each = np.array([f.each for f in found])
    size = np.array([f.n for f in found])[:, None]

    def scores(t: float) -> np.ndarray:
        scaled = -(each - each.min(axis=1, keepdims=True)) * size / t
        e = np.exp(scaled)
        return e / e.sum(axis=1, keepdims=True)

    grid = [2.0**k for k in np.arange(-2, 13, 0.5)]
    at = np.arange(len(truth))
    own.temperature = min(grid, key=lambda t: -np.log(np.maximum(scores(t)[at, truth], 1e-12)).mean())
    right = each.argmin(axis=1) == truth
    if right.any():
        own.least_score = float(np.quantile(scores(own.temperature).max(axis=1)[right], 0.01))
        own.most_entropy = float(each.min(axis=1)[right].max() * 1.25)
    return own


def identify(docs: DataFrame, own: Identifier, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, entropy, rejected) of every whole text."""

    def make():
        scorer = Scorer(own)

        def work(batch):
            rows = scorer.predict(batch.column(1).to_pylist())
            names = ("lang_pred", "score", "entropy", "rejected")
            return {doc_id: batch.column(0)} | {n: [r[i] for r in rows] for i, n in enumerate(names)}

        return work

    chosen = docs.select(doc_id, F.col(text).cast("string").alias("text"))
    kind = chosen.schema[0].dataType.simpleString()
    return by_batch(chosen, make, f"`{doc_id}` {kind}, lang_pred string, score double, entropy double, rejected boolean")
