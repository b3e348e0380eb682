"""Language models against a plain Kneser-Ney; training over all n-grams of its rows."""

import random
from collections import Counter

import numpy as np

from pagewright.llm import langid


class Plain:
    """Interpolated Kneser-Ney over marked words, straight from its definition."""

    def __init__(self, words, order, alphabet):
        self.order, self.alphabet = order, alphabet
        raw = Counter(f" {w} "[i : i + k] for w in words for k in range(1, order + 1) for i in range(len(w) + 3 - k))
        self.count = {}
        for k in range(1, order + 1):
            level = {}
            for g in (g for g in raw if len(g) == k):
                before = {x[0] for x in raw if len(x) == k + 1 and x[1:] == g}
                # the highest order, and what begins a word, count occurrences; the others what stands before them
                n = raw[g] if k == order or g[0] == " " and k > 1 else len(before)
                if n:
                    level[g] = n
            self.count[k] = level

    def discount(self, k):
        ones, twos = (sum(c == n for c in self.count[k].values()) for n in (1, 2))
        return ones / (ones + 2 * twos) if ones and twos else 0.5

    def p(self, c, history):
        if len(history) >= self.order:
            history = history[1 - self.order :] if self.order > 1 else ""
        level, d = self.count[len(history) + 1], self.discount(len(history) + 1)
        followers = {g: n for g, n in level.items() if g[:-1] == history}
        lower = self.p(c, history[1:]) if history else 1 / self.alphabet
        if not followers:
            return lower
        total = sum(followers.values())
        return max(followers.get(history + c, 0) - d, 0) / total + d * len(followers) / total * lower


def test_models_are_kneser_neys():
    rng = random.Random(31)
    for order in (2, 3, 4):
        words = ["".join(rng.choice("abcde") for _ in range(rng.randrange(1, 7))) for _ in range(60)]
        plain = Plain(words, order, 9)
        model = langid.kneser_ney("x", dict(langid.count_grams([words], order)), order, 9)
        tables = langid.Tables([model])
        for word in [*words[:10], "edcba", "zzz", "az", "e"]:
            points = langid.chars([word])
            got = tables.probabilities(points, np.array([0, len(points) - 1]))[:, 0]
            marked = f" {word} "
            want = [plain.p(marked[i], marked[:i]) for i in range(1, len(marked))]
            assert np.allclose(got, want, rtol=1e-9), (order, word)


def test_probabilities_of_all_letters_sum_to_one():
    words = ["banana", "band", "cab", "dab", "a"]
    plain = Plain(words, 3, 6)  # a b c d n and the mark
    for history in (" ", " b", " ba", "an", "zz"):
        assert abs(sum(plain.p(c, history) for c in "abcdn ") - 1) < 1e-9


def test_training_keeps_every_gram(spark):
    rng = random.Random(5)
    texts = [("xx", " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(40))) for _ in range(40)] + [("yy", "one two three " * 5)] * 10
    rows = [(i, t, lang) for i, (lang, t) in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    own = langid.train(docs)
    found = next(m for m in own.models if m.name == "xx")
    from pagewright.llm.common import held_out
    from pyspark.sql import functions as F

    check = F.pmod(F.xxhash64(F.lit("check"), F.col("doc_id").cast("string")), F.lit(10)) == 0
    used = [r.text for r in docs.where("lang = 'xx'").where(~held_out() & ~check).collect()]
    grams = langid.count_grams([langid.words_of(t) for t in used], langid.ORDER)
    assert len(found.grams[-1][0]) == sum(len(g) == langid.ORDER for g in grams)
    assert min(grams.values()) == 1


def test_a_long_text_is_surer_than_its_beginning():
    lists = [["the", "house", "of", "them"], ["das", "haus", "von", "dem"]]
    models = [langid.kneser_ney(n, dict(langid.count_grams([words * 5], 3)), 3, 20) for n, words in zip(("en", "de"), lists, strict=True)]
    scorer = langid.Scorer(langid.Identifier(models, temperature=50.0))
    short, long = scorer.predict(["the house", "the house " * 400])
    assert (short[0], long[0]) == ("en", "en")
    assert short[1] < long[1] <= 1
