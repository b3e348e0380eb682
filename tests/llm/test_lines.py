"""Line dedup: its runs, its keys, and whole results against plain Python."""

import hashlib
import random
import time

import pytest

from pagewright.llm import linededup
from pagewright.llm import queries as own

SCHEMA = "h1 long, h2 long, n_docs long, max_doc long"


@pytest.fixture
def runs(spark):
    made = linededup.Runs(spark, min_docs=3, fanout=3)
    yield made
    for run in made.all():
        made.drop(run)


def rows_of(runs, name):
    return sorted(tuple(r) for r in runs.spark.table(name).collect())


def test_runs_merge_by_levels(spark, runs):
    for at, keys in enumerate(((1, 2), (2, 3), (3, 4), (1, 5), (5, 6))):
        runs.add(runs.deal(spark.createDataFrame([(k, 0, 1, 100 - at) for k in keys], SCHEMA)))
    assert [len(level) for level in runs.levels] == [2, 1]
    with linededup.reading_runs(spark):
        merged = runs.merged(runs.all()).collect()
    assert {r.h1: (r.n_docs, r.max_doc) for r in merged} == {1: (2, 100), 2: (2, 100), 3: (2, 99), 4: (1, 98), 5: (2, 97), 6: (1, 96)}


def test_the_anti_join_decides_what_a_run_takes(spark, runs):
    deal = lambda *rows: runs.deal(spark.createDataFrame(rows, SCHEMA))
    runs.add(deal((1, 0, 3, 90), (2, 0, 2, 90)))
    second = runs.add(deal((1, 0, 50, 80), (2, 0, 1, 80), (3, 0, 1, 80)))
    assert rows_of(runs, second) == [(2, 0, 1, 80), (3, 0, 1, 80)]  # key 1 is settled
    runs.add(deal((4, 0, 9, 70)))  # the level is full: one run, in which key 2 is settled
    last = runs.add(deal((1, 0, 9, 60), (2, 0, 9, 60), (3, 0, 2, 60)))
    assert rows_of(runs, last) == [(3, 0, 2, 60)]
    assert {r.h1: r.max_doc for r in runs.common().collect()} == {1: 90, 2: 90, 3: 80, 4: 70}


def test_a_batch_meets_the_runs_without_a_shuffle(spark, runs, capsys):
    first = runs.deal(spark.createDataFrame([(k, k, 3, k) for k in range(500)], SCHEMA).repartition(runs.buckets, "h1", "h2"))
    second = runs.deal(spark.createDataFrame([(k, k, 3, k) for k in range(250, 900)], SCHEMA).repartition(runs.buckets, "h1", "h2"))
    with linededup.reading_runs(spark):
        new = spark.table(second).join(runs.settled(first).hint("merge"), ["h1", "h2"], "left_anti")
        new.explain()
        assert new.count() == 400
    plan = capsys.readouterr().out
    assert "SortMergeJoin" in plan and "Exchange" not in plan and "Sort [" not in plan
    runs.levels = [[first, second]]


def plain(docs, min_chars=20, min_docs=3):
    """What the contract says, line by line."""
    key = lambda line: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))
    holders = {}
    for i, t in docs:
        for line in (t or "").split("\n"):
            if i is not None and len(key(line)) >= min_chars:
                holders.setdefault(key(line), set()).add(i)
    out = []
    for i, t in docs:
        lines = (t or "").split("\n")
        stay = [x for x in lines if i is None or len(holders.get(key(x), ())) < min_docs or i == max(holders[key(x)])]
        out.append((i, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return sorted(out, key=repr)


def deduped(spark, docs, **options):
    got = linededup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string"), **options).select("doc_id", "line_n", "line_dropped", "line_kept")
    return sorted((tuple(r) for r in got.collect()), key=repr)


def test_random_lines(spark):
    rng = random.Random(8)
    ends = ["", " ", "\t", "\r", "\x85", " ", " ", "\xa0", " \x85", "\x0b\x0c"]
    lines = [f"a line of more than twenty letters {k}" for k in range(12)] + ["short", "", "exactly twenty chars"]
    docs = [(rng.choice([None, *range(40)]) if k % 9 == 0 else k, "\n".join(rng.choice(ends) + (x.upper() if rng.random() < 0.2 else x) + rng.choice(ends) for x in rng.choices(lines, k=rng.randrange(8)))) for k in range(120)]
    docs += [(7, None), (8, ""), (9, docs[9][1])]
    assert deduped(spark, docs) == plain(docs)
    assert deduped(spark, docs, batches=1) == plain(docs)
    assert deduped(spark, docs, batches=7, fanout=2, min_docs=5) == plain(docs, min_docs=5)


def test_unicode_line_ends_are_no_white_space(spark):
    line = "abcdefghijklmnopqrst"
    docs = [(i, line) for i in (1, 2, 3)] + [(i, line + " " + end) for i, end in ((11, "\x85"), (12, " "), (13, " "))]
    assert deduped(spark, docs) == plain(docs)
    assert sum(r[2] for r in deduped(spark, docs)) == 2


def test_a_line_of_many_spaces_takes_no_time(spark):
    line = "x" + " " * 100_000 + "y"
    docs = [(i, line) for i in range(4)]
    deduped(spark, docs[:1])
    start = time.perf_counter()
    assert deduped(spark, docs) == plain(docs)
    assert time.perf_counter() - start < 60


def test_very_common_lines_are_looked_up_by_broadcast(spark, monkeypatch):
    monkeypatch.setattr(linededup, "SPLIT", 5)
    docs = [(i, f"the line that every document holds\nown line of document number {i}\nthe line of every second one {i % 2}") for i in range(60)]
    assert deduped(spark, docs) == plain(docs)


def test_nothing_is_left_in_the_catalog(spark, sf_dir):
    own.op9_linededup(spark, sf_dir).count()
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("line_run_")]
