"""Each method against a plain account of what it should give."""

import itertools
import math
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from pagewright.llm import common, extract, langid, media, mixing, neardup, quality, sentencepiece_bpe, toxicity
from pagewright.llm import queries as own


@pytest.fixture(scope="module")
def proto():
    return sentencepiece_bpe.read_model(public_tokenizers.path(own.TOKENIZER))


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return own.table(spark, sf_dir, "documents")


# --- sentencepiece


def test_encoding_is_the_librarys(proto, docs):
    lib, ours = sentencepiece.SentencePieceProcessor(model_proto=proto), sentencepiece_bpe.Model(proto)
    rng = random.Random(3)
    texts = [r.text for r in docs.select("text").collect()]
    texts += ["".join(rng.choice("  ab▁eth\n\té①🙂the ing \x00 梦ขข<s>0x1") for _ in range(rng.randrange(40))) for _ in range(3000)]
    texts += [c * n for c in (" ", "a", "▁", "\n") for n in range(40)]
    for t in texts:
        ids = lib.encode(t)
        assert list(ours.encode(t)) == ids
        assert ours.decode(ids) == lib.decode(ids)


def test_decoding_of_any_ids_is_the_librarys(proto):
    lib, ours = sentencepiece.SentencePieceProcessor(model_proto=proto), sentencepiece_bpe.Model(proto)
    rng = random.Random(4)
    for _ in range(3000):
        ids = [rng.choice([rng.randrange(32000), rng.randrange(260), rng.choice([28705, 259, 0, 1, 2, 229, 153, 132])]) for _ in range(rng.randrange(7))]
        assert ours.decode(ids) == lib.decode(ids)


def test_pairs_fit_as_merging_says(proto):
    ours, rng = sentencepiece_bpe.Model(proto), random.Random(5)
    pieces = [p for p in ours.rank if len(p) < 8 and not p.endswith("▁")]
    for _ in range(20000):
        left, right = rng.choice(pieces), rng.choice(pieces).lstrip("▁") or "a"
        if len(right) == 1 or right in ours.rank:
            assert ours.compatible(left, right) == ours.remerged(left, right)


# --- media


def test_every_row_filter_is_undone():
    rng = np.random.default_rng(1)
    image = rng.integers(0, 256, (12, 17), dtype=np.uint8)

    def predicted(kind, left, up, corner):
        if kind == 4:
            p = left + up - corner
            return min((abs(p - left), 0, left), (abs(p - up), 1, up), (abs(p - corner), 2, corner))[2]
        return (0, left, up, (left + up) // 2)[kind]

    rows = []
    for y in range(12):
        kind = (y * 7 + y // 5) % 5
        row = [kind]
        for x in range(17):
            left = int(image[y, x - 1]) if x else 0
            up = int(image[y - 1, x]) if y else 0
            corner = int(image[y - 1, x - 1]) if x and y else 0
            row.append((int(image[y, x]) - predicted(kind, left, up, corner)) % 256)
        rows.append(row)
    assert (media._unfilter(np.array(rows, np.uint8)) == image).all()


@pytest.mark.parametrize("height", [1, 24, 31, 2049, 5000])
def test_png_round_trip(height):
    rng = np.random.default_rng(height)
    image = rng.integers(0, 256, (height, 24), dtype=np.uint8)
    image[: height // 2] = image[: height // 2].cumsum(axis=0, dtype=np.uint8)
    assert (media.read_png(media.write_png(image)) == image).all()


def test_changed_files_are_refused():
    file = media.write_png(np.zeros((24, 24), np.uint8))
    for at in (0, 20, 45, len(file) - 3):
        broken = bytearray(file)
        broken[at] ^= 1
        with pytest.raises(ValueError, match="."):
            media.read_png(bytes(broken))
    with pytest.raises(ValueError, match="cut|end"):
        media.read_png(file[:-6])


def test_hash_of_like_images_is_like():
    rng = np.random.default_rng(2)
    image = np.kron(rng.integers(20, 236, (8, 8)), np.ones((6, 6))).astype(np.uint8)  # energy in every low frequency
    near = (image.astype(int) + rng.integers(-3, 4, image.shape)).clip(0, 255).astype(np.uint8)
    other = rng.integers(0, 256, image.shape, dtype=np.uint8)
    bits = lambda a, b: bin(int(media.cosine_hash(a), 16) ^ int(media.cosine_hash(b), 16)).count("1")
    assert bits(image, near) <= 6 < bits(image, other)


def test_media_query_columns(spark, sf_dir, docs):
    import hashlib
    import zlib

    got = {r.doc_id: r for r in own.op3_media(spark, sf_dir).collect()}
    for r in docs.collect():
        raw = (r.text or "").encode()
        pad = raw + b"\xff" * (-len(raw) % 576 or (0 if raw else 576))
        g = got[r.doc_id]
        assert (g.n_bytes, g.payload_bytes, g.payload_sha256, g.tail_crc32) == (len(raw), len(pad), hashlib.sha256(pad).hexdigest(), zlib.crc32(pad[-32:]))


# --- near duplicates


def brute(texts, words, percent):
    sets = {}
    for i, t in texts:
        w = (t or "").encode().lower().split()
        k = min(words, len(w))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if w else set()
    comp = {i: i for i in sets}

    def top(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * len(sets[a] | sets[b]):
            x, y = sorted((top(a), top(b)))
            comp[y] = x
    return {i: (len(s), top(i)) for i, s in sets.items()}


def variants(seed=7):
    """Families whose members drift, so that links chain and some pairs lie just beside the threshold."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    out, n = [], 0
    for size, length in [(40, 60), (25, 30), (10, 200), (8, 5), (6, 1), (30, 12)]:
        text = [rng.choice(vocabulary) for _ in range(length)]
        for _ in range(size):
            out.append((n, " ".join(text)))
            n += 1
            text = list(text)
            for _ in range(max(1, length // 25) if rng.random() < 0.7 else 0):
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
            if rng.random() < 0.3:
                text = text[1:] + [rng.choice(vocabulary)]
    rng.shuffle(out)
    return out + [(n, None), (n + 1, ""), (n + 2, "A b C"), (n + 3, "a B c")]


@pytest.mark.parametrize(("words", "percent"), [(2, 80), (5, 80), (2, 60)])
def test_components_are_those_of_all_pairs(spark, words, percent):
    texts = variants()
    rows = (6, 40) if percent == 80 else (3, 60)
    got = neardup.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string"), words=words, percent=percent, rows=rows[0], bands=rows[1]).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(texts, words, percent)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_links_that_miss_the_smallest_id_are_found(spark):
    """a is like b and c but linked to neither; b and c are linked: the last round has to find it."""
    rng = random.Random(1)
    base = [f"x{i}" for i in range(100)]
    a = base[:]
    for i in range(0, 100, 12):
        a[i] = f"a{i}"
    b = base[:]
    c = base[:50] + ["c"] + base[51:]
    texts = [(1, " ".join(a)), (2, " ".join(b)), (3, " ".join(c))]
    rng.shuffle(texts)
    want = brute(texts, 2, 90)
    assert want[2][1] == want[3][1] == 2
    got = neardup.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string"), words=2, percent=90, rows=2, bands=100).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want


def test_repeated_ids_join_their_texts(spark):
    long = " ".join(f"q{i}" for i in range(40))
    texts = [(5, long), (5, "one two three four"), (7, long), (9, "one two three four")]
    got = neardup.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string"), words=2).collect()
    assert {r.component_id for r in got} == {5}


def test_paths_settle(spark):
    n = 300
    order = list(range(n))
    random.Random(2).shuffle(order)
    links = [(order[i], order[i + 1]) for i in range(n - 1)] + [(1000, 1001)]
    got = {r.id: r.comp for r in neardup.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(n), 0), 1000: 1000, 1001: 1000}


def test_estimate_is_close():
    rng = np.random.default_rng(3)
    for share in (0.5, 0.8, 0.95):
        a = rng.integers(0, 2**63, 4000, dtype=np.uint64)
        keep = int(4000 * 2 * share / (1 + share))
        b = np.concatenate([a[:keep], rng.integers(0, 2**63, 4000 - keep, dtype=np.uint64)])
        n = 960
        x, y = (np.frombuffer(neardup.packed(neardup.minima(s, n)), np.uint8).reshape(neardup.BITS, -1) for s in (a, b))
        same = n - int(np.bitwise_count(np.bitwise_or.reduce(x ^ y, axis=0)).sum())
        assert abs(neardup.similarity(np.array([same]), n)[0] - share) < 0.06


# --- mixing


def test_water_filling_is_the_fixpoint(spark):
    rng = random.Random(5)
    for case in range(6):
        sizes = [rng.choice([0, 5, 50, 500, 5000]) for _ in range(9)]
        share = rng.choice([0.3, 1.0, 2.5, 4.0])
        table = spark.createDataFrame([(f"k{i}", rng.choice([1, 2, 3]), s) for i, s in enumerate(sizes)], "mix_key string, mix_weight int, mix_source_size long")
        got = {r.mix_key: r.mix_target for r in mixing.water_fill(table, share, 3).collect()}
        source = {r.mix_key: (r.mix_weight, r.mix_source_size) for r in table.collect()}
        fixed, wanted = {}, sum(sizes) * share
        while True:  # clamp and share the rest again, until none is above
            left = sum(w for k, (w, _) in source.items() if k not in fixed)
            rest = wanted - sum(fixed.values())
            now = {k: rest * w / left for k, (w, _) in source.items() if k not in fixed} if left else {}
            over = {k: 3.0 * source[k][1] for k, t in now.items() if t >= 3.0 * source[k][1]}
            if not over:
                break
            fixed |= over
        want = fixed | now
        assert got.keys() == want.keys(), case
        assert all(math.isclose(got[k], want[k], rel_tol=1e-9, abs_tol=1e-6) for k in want)


def test_taken_words_come_near_the_targets(spark, sf_dir):
    got = own.op1_mixing(spark, sf_dir).groupBy("source_size", "target").agg(F.sum("taken").alias("taken"), F.max("size").alias("most")).collect()
    assert all(abs(r.taken - r.target) <= r.most for r in got)


def test_mix_stands_as_often_as_it_says(docs):
    mixed = mixing.mix(docs)
    want = mixed.where("mix_reps > 0").groupBy("doc_id").agg(F.sum("mix_reps").alias("n"))
    got = mixing.repeated(mixed, docs.columns).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


# --- language


def test_probabilities_sum_to_one():
    counts = langid.count_grams([["the", "then", "hat", "tea"]] * 3, 3)
    model = langid.kneser_ney("x", counts, 3, alphabet=7)
    for start in ("", "t", "th", "he"):
        total = 0.0
        for c in "thena ":
            points = np.array([32, *map(ord, start + c)], np.uint64)
            total += float(langid.Tables([model]).probabilities(points, np.array([0, len(points) - 1]))[len(start), 0])
        # letters that the model has never seen share what is left
        assert 0.9 < total <= 1 + 1e-9


def test_held_out_languages(spark, sf_dir, docs):
    got = own.op8_langid(spark, sf_dir).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in got) / len(got) > 0.95


# --- toxicity


def test_hidden_words_are_restored():
    from collections import Counter

    counts = toxicity.gram_counts(Counter(["idiot", "stupid", "loser", "trash", "hello", "letter", "school", "people"] * 50))
    reader = toxicity.Reader(toxicity.Letters(counts, counts.sum() / 3))
    for hidden, word in (("1d10t", "idiot"), ("stuuupid", "stupid"), ("l.o.s.e.r", "loser"), ("tr@$h", "trash"), ("l o s e r", "loser"), ("5tup1d", "stupid"), ("idiooot!", "idiot")):
        assert word in reader.words(f"hello {hidden} people"), hidden
    assert {"letter", "school", "hello"} <= reader.words("Letter school, hello!")


def test_gram_counts_are_those_of_a_loop():
    from collections import Counter

    words, want = Counter({"ab": 2, "é": 3, "abc": 1}), np.zeros(toxicity.BUCKETS)
    for w, n in words.items():
        m = f"  {w} "
        for i in range(2, len(m)):
            for g in (m[i - 2 : i + 1], m[i - 1 : i + 1], m[i]):
                want[toxicity._bucket(g)] += n
        want[toxicity._bucket("  ")] += n
    assert (toxicity.gram_counts(words) == want).all()


def test_scores_hold_on_held_out_rows(spark):
    rng = random.Random(9)
    words = [f"{a}{b}{c}" for a in ("ta", "me", "ro", "li") for b in ("na", "so", "ke") for c in ("", "t", "ri")]
    toxic = ["gruma", "grumat", "grumari", "zaxel"]
    rows, labels = [], []
    for i in range(600):
        bad = i % 4 == 0
        text = [rng.choice(words) for _ in range(30)]
        if bad:
            text[rng.randrange(30)] = rng.choice(toxic)
        rows.append((i, " ".join(text)))
        labels.append((i, int(bad)))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = toxicity.score_toxicity(docs, toxicity.train(docs, marks)).where(common.held_out()).join(marks, "doc_id").collect()
    assert sum(r.toxic_predicted == r.toxic for r in got) / len(got) > 0.97


# --- quality


def repeated_words(words, window=3):
    grams = [tuple(words[i : i + window]) for i in range(len(words) - window + 1)]
    covered = set()
    for i, g in enumerate(grams):
        if grams.count(g) > 1:
            covered.update(range(i, i + window))
    return len(covered)


def test_repeated_words(spark):
    rng = random.Random(11)
    texts = [" ".join(rng.choice("abc") for _ in range(n)) for n in range(30)] + ["a a a a a", "x y z q x y z", "one two"]
    got = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").select("doc_id", quality.counts(F.col("text"))["n_repeat_words"].alias("n")).collect()
    assert {r.doc_id: r.n for r in got} == {i: repeated_words(t.split()) for i, t in enumerate(texts)}


def test_quality_runs_no_python(spark, sf_dir, capsys):
    own.op5_quality(spark, sf_dir).explain()
    own.op9_linededup(spark, sf_dir).explain()
    plan = capsys.readouterr().out
    assert "Python" not in plan and "Arrow" not in plan


# --- pages

PAGES = {
    "<html><head><title>t</title></head><body><div class='nav-bar'><a href=1>Home</a> <a>More</a></div><div id='content'><h1>Head &amp; more</h1><p>First, long enough paragraph\n of text,  with commas.</p><p>Second<br>line</p></div><div class='comments'><p>I, for one, am a reader with a long, long, long opinion</p></div></body></html>": "Head & more\nFirst, long enough paragraph of text, with commas.\nSecond line",
    "<article><header><h1>T</h1></header><p>a<script>var x='</p>'</script>b</p><ul><li>x<li>y</ul><aside>no</aside></article><footer>f</footer>": "T\nab\nx\ny",
    "<header><h1>Site</h1></header><main><p>Text &eacute; &#233; &lt;i&gt;</p><form><p>Name</p><input></form></main>": "Text é é <i>",
    "<p><b>bold<br><p>next</p>": "bold\nnext",
    "<body><nav>a</nav>": "",
    "<body><ul><li><a>One</a><li><a>Two</a><li><a>Three</a></ul><div class='content has-sidebar'><p>Real text, here it is.</p></div><div id='leftSidebar'>no</div><div class='site-footer'>no</div></body>": "Real text, here it is.",
    "<article><p>Links:</p><ul><li><a>One</a><li><a>Two</a><li><a>Three</a></ul></article>": "Links:\nOne\nTwo\nThree",
    "<div class='post'><div class='entry-header'><h2>Title</h2></div><p>Body text, and more of it.</p><div class='cookieNotice'>ok</div><ol class='comment-list'><li>me too</ol></div>": "Title\nBody text, and more of it.",
}


@pytest.mark.parametrize("page", PAGES)
def test_main_text(page):
    assert extract.extract(page) == PAGES[page]


def test_broken_pages_never_fail():
    rng = random.Random(12)
    parts = ["<p>", "</p>", "<div class=ad>", "</div>", "<", ">", "<!--", "-->", "<script>", "</script>", "text", "&amp", "<a href='", "'>", "</b>", "<td>", "<li>", "<article>", "\x00", "é"]
    for _ in range(3000):
        extract.extract("".join(rng.choice(parts) for _ in range(rng.randrange(30))))
    assert extract.extract("<div>" * 20000 + "deep") == "deep"


def test_articles_of_the_table(spark, sf_dir):
    import html
    import re

    got = {r.page_id: r.text for r in own.op10_extract(spark, sf_dir).collect()}
    for r in own.table(spark, sf_dir, "pages").collect():
        body = r.html.split("<article>")[1].split("</article>")[0]
        blocks = (" ".join(html.unescape(re.sub("<[^>]+>", " ", b)).split()) for b in re.split("</?p>|</?h1>", body))
        assert got[r.page_id] == "\n".join(b for b in blocks if b)


# --- pipeline


def test_pipeline_stages(spark, sf_dir):
    rows = own.table(spark, sf_dir, "documents")
    columns = rows.columns
    before = rows.count()
    toxic = [r.doc_id for r in own.table(spark, sf_dir, "labels").where("toxic = 1").collect()]
    for name, stage in corpus_pipeline.STAGES:
        after = common.stored(stage(spark, rows, sf_dir), "test-stage")
        if name != "sentencepiece":
            assert after.columns == columns
        if name == "toxicity":
            gone = before - after.count()
            assert 0 < gone < 0.3 * before
            assert after.where(F.col("doc_id").isin(toxic)).count() < len(toxic)
        if name == "near_dedup":
            want = brute([(r.doc_id, r.text) for r in rows.collect()], 5, 80)
            assert sorted(r.doc_id for r in after.collect()) == sorted(i for i, (_, c) in want.items() if i == c)
        if name == "sentencepiece":
            assert after.count() == rows.count()
        rows = after
