"""Toxicity: decoding against all paths, tokens that must reach the lattice, texts that must end."""

import math
import random
import time
from collections import Counter

import pytest

from pagewright.llm import toxicity

WORDS = "stupid idiot shit ass well will letter book the of and there is a hello trash loser clown hit pit sit tip bit bill still spit".split()


@pytest.fixture(scope="module")
def letters():
    counts = toxicity.gram_counts(Counter(dict.fromkeys(WORDS, 50)))
    return toxicity.Letters(counts, float(counts.sum()) / 3)


def all_paths(token, letters):
    """(cost, letters) of every path through the lattice, none left out."""
    paths = [(0.0, "  ")]
    last = ""
    for c in token:
        after = []
        for cost, out in paths:
            options = c if c.isalpha() else toxicity.LOOKS_LIKE.get(c, "")
            for x in options:
                after.append((cost + letters.cost(out[-2:], x) + (0 if c.isalpha() else toxicity.SIGN), out + x))
            if c == last and out[-1] in options:
                after.append((cost + toxicity.REPEAT, out))
            if not c.isalpha():
                after.append((cost + (toxicity.SKIP if c in toxicity.SEPARATORS else toxicity.NOTHING), out))
                if c in toxicity.SEPARATORS and out[-1] != " ":
                    after.append((cost + toxicity.BREAK + letters.cost(out[-2:], " "), out + "  "))
        paths, last = after, c
    return [(cost + letters.cost(out[-2:], " "), " ".join(out.split())) for cost, out in paths]


def test_decoding_finds_the_best_of_all_paths(letters):
    rng = random.Random(17)
    signs = "01345@$!|+.-* _"
    tokens = ["5h17", "@55", "stuupid", "1d!0+", "s-t-u-p-i-d", "4$$", "||||||", "1!1!1!", "bo0ok"]
    for _ in range(400):
        word = rng.choice(WORDS)[:5]
        tokens.append("".join((rng.choice(signs) if rng.random() < 0.35 else c) * rng.choice([1, 1, 1, 2]) for c in word)[:7])
    for token in tokens:
        paths = all_paths(token, letters)
        best = min(cost for cost, _ in paths)
        found = " ".join(toxicity.restore(token, letters).split())
        assert any(math.isclose(cost, best, abs_tol=1e-9) and out == found for cost, out in paths), token


def test_hidden_words_are_restored(letters):
    reader = toxicity.Reader(letters)
    for token, word in {"5h17": "shit", "@55": "ass", "stuupid": "stupid", "1d10t": "idiot", "$tup!d,": "stupid", "s.t.u.p.i.d": "stupid", "stuuuupid!": "stupid", "(tr@sh)": "trash"}.items():
        assert word in reader.words(f"the {token} of"), token
    assert reader.words("s t u p i d") >= {"stupid"}


def test_clean_words_are_read_as_themselves(letters):
    reader = toxicity.Reader(letters)
    assert reader.words("Well, the letter of hello will book there.") == {"well", "the", "letter", "of", "hello", "will", "book", "there"}


def test_every_token_with_a_sign_or_a_doubled_letter_is_decoded(letters, monkeypatch):
    seen = []
    restore = toxicity.restore
    monkeypatch.setattr(toxicity, "restore", lambda token, model: seen.append(token) or restore(token, model))
    toxicity.Reader(letters).words("plain words 5h17 stuupid @55 x_y e-mail (clean) 2024 letter. clean, ok!")
    assert set(seen) == {"5h17", "stuupid", "@55", "x_y", "e-mail", "2024", "letter", "ok!"}


@pytest.mark.parametrize(
    "text",
    ["-" * 200 + "word", "- " * 5000 + "word", "a.b-c_" * 5000 + "zz", "a b c d " * 5000, "1" * 5000, "!" * 5000 + "x", "o" * 5000, ("." * 60 + "x ") * 500, "a - " * 5000],
    ids=lambda t: t[:8],
)
def test_odd_texts_end(letters, text):
    start = time.perf_counter()
    toxicity.Reader(letters).words(text)
    assert time.perf_counter() - start < 10


def test_all_states_are_kept(letters):
    """Signs with two readings in a row: a narrow search would lose the cheap end."""
    token = "11||66" * 3
    # a plain dynamic programme over the last two letters and what was written, without any limit
    best, last = {"  ": 0.0}, ""
    for c in token:
        after = {}
        for state, cost in best.items():
            for x in toxicity.LOOKS_LIKE[c]:
                after[state[1] + x] = min(after.get(state[1] + x, math.inf), cost + toxicity.SIGN + letters.cost(state, x))
            if c == last and state[1] in toxicity.LOOKS_LIKE[c]:
                after[state] = min(after.get(state, math.inf), cost + toxicity.REPEAT)
            after[state] = min(after.get(state, math.inf), cost + toxicity.NOTHING)
        best, last = after, c
    want = min(cost + letters.cost(state, " ") for state, cost in best.items())
    assert len(best) > 4
    # the path found costs what the programme says: its letters are at most that dear by themselves
    out = "  " + toxicity.restore(token, letters)
    own = sum(letters.cost(out[i - 2 : i], out[i]) for i in range(2, len(out))) + letters.cost(out[-2:], " ")
    assert own <= want + 1e-9
