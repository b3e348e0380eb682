"""Hot keys: joins and bucket blocks that split them give what plain joins and all pairs give."""

import itertools
import random

from pyspark.sql import functions as F
from test_methods import brute

from pagewright.llm import common, neardup


def test_hot_join_is_a_join(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 10)
    rows = spark.createDataFrame([(k, i) for k in range(30) for i in range(400 if k == 3 else 1 + k % 5)] + [(None, 1)], "k int, v int")
    table = spark.createDataFrame([(k, f"t{k}") for k in range(0, 40, 3)], "k int, name string")
    want = sorted(tuple(r) for r in rows.join(table, ["k"]).collect())
    got = common.hot_join(rows, table, ["k"])
    assert got.columns == ["k", "v", "name"]
    assert sorted(tuple(r) for r in got.collect()) == want
    counted = table.join(rows.groupBy("k").count(), "k")
    assert sorted(tuple(r) for r in common.hot_join(rows, counted, ["k"], counts="count").collect()) == want
    assert common.hot_join(rows, table.where("k < 0"), ["k"]).collect() == []
    assert len(common.hot_join(rows, table, ["k"], most=3).collect()) == len(want)


def test_blocks_hold_all_pairs_of_different_components(spark, monkeypatch):
    monkeypatch.setattr(neardup, "MEMBERS", 10)
    rng = random.Random(4)
    members = [(1, i, 0 if i < 95 else i) for i in range(130)]  # nearly one component
    members += [(2, i, rng.choice([200, 201, 202])) for i in range(200, 245)] + [(3, i, i) for i in range(300, 306)] + [(4, i, 4) for i in range(400, 430)]
    rest = spark.createDataFrame(members, "bucket long, id long, comp long")
    plan = neardup.block_plan(rest)
    assert {r.bucket: (r.main, r.k1) for r in plan.collect()}[1] == (0, 10)
    met, copies, together = set(), 0, {}
    for r in neardup.in_blocks(rest, plan).collect():
        together.setdefault((r.bucket, r.p, r.q), []).append(r)
        copies += r.bucket == 1
    for (_, p, q), group in together.items():
        for x, y in itertools.combinations(group, 2):
            if x.comp != y.comp and (p == q or x.part != y.part):
                met.add((x.bucket, *sorted((x.id, y.id))))
    want = {(b, *sorted((i, j))) for (b, i, c), (b2, j, d) in itertools.combinations(members, 2) if b == b2 and c != d}
    assert met == want
    assert copies < 130 * 8  # 95 members 4 times, 35 members 14 times: not 13 times each


def test_components_with_small_blocks_and_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(neardup, "MEMBERS", 5)
    monkeypatch.setattr(neardup, "PART", 3)
    monkeypatch.setattr(common, "HOT_ROWS", 4)
    rng = random.Random(6)
    words = [f"w{i}" for i in range(400)]
    base = [rng.choice(words) for _ in range(60)]
    texts = [" ".join(base)] * 40
    for n in range(60):  # one large group of near copies and what drifts away from it
        t = base[:]
        for _ in range(rng.choice([1, 3, 6, 9])):
            t[rng.randrange(60)] = rng.choice(words)
        texts.append(" ".join(t))
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=2, percent=80, bands=60, rows=3).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows, 2, 80)


def test_only_the_result_keeps_its_tables(spark, tmp_path, monkeypatch):
    made = []
    stored = common.folders.stored
    monkeypatch.setattr(common.folders, "stored", lambda df, *a: made.append(stored(df, *a)) or made[-1])
    got = neardup.near_duplicates(spark.createDataFrame([(i, f"a b c d e {i // 4}") for i in range(40)], "doc_id long, text string"), words=2)
    assert got.where(F.col("kept")).count() < 40

    def there(table):
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table.inputFiles()[0])
        return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)

    assert 0 < sum(there(t) for t in made) <= 2 < len(made)
