"""Line dedup with levelled sorted runs of line hashes.

Documents come in batches of id ranges, the largest ids first.  A run holds
(h1, h2, n_docs, max_doc) for the line keys of one or more batches: the number of
their documents that hold the key and the largest id among them.  Runs are tables
bucketed and sorted by hash, so a new batch, dealt the same way once, meets each
run in a merge join without another shuffle.  The anti-join takes out the keys
that a run already holds in ``min_docs`` documents: their survivor, which has a
larger id, and their fate are known.  What is left of the batch becomes a run of
level 0.  When a level has ``fanout`` runs, they are merged into one run of the
next level, so there are never more than ``fanout`` runs a level and a key is
rewritten once a level.  At the end every line is looked up in the merged runs.

A line's key is the line without white space at its ends and with A-Z in lower
case, taken as a 128-bit hash.  Keys of ``min_chars`` or more code points in
``min_docs`` or more documents lose all their lines but those of the largest id.
Keys that more than ``split`` documents of a batch hold are looked up by
broadcast, so that their lines don't meet in one task; there are fewer of them
than lines / split, and split grows with the lines.

Nulls and odd inputs: ids are whole numbers; a null or empty text is one empty
line, which has no key; a null id keeps all its lines, counts as no document;
rows that repeat an id are one document for the counts and get equal decisions; a
row whose text is null gives an empty text; an empty table gives no rows.  Only
the id and text columns are read by the search; others pass through, and the
operator's own columns begin with ``line_``, replacing input columns that begin
so.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget, scratch, stored

KEY = ("h1", "h2")
#: Documents of a batch from which a key's lines are looked up by broadcast, and such keys at most.
SPLIT, HEAVY = 1000, 1_000_000


def line_key(line: Column) -> Column:
    """Without white space at both ends, A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(" \t\n\x0b\x0c\r")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def key_hash(key: Column) -> Column:
    """Two hashes with different seeds: 128 bits."""
    return F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("line"), key).alias("h2"))


def key_lines(docs: DataFrame, doc_id: str, text: str, min_chars: int) -> DataFrame:
    """(line_doc, line_text, h1, h2, line_pos): a row for each line whose key is long enough.

    line_text is a hash of the whole text: with the id it names a row's text.
    """
    lines = F.posexplode(F.split(F.col("t"), "\n", -1)).alias("line_pos", "line")
    rows = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("line_doc"), F.col(text).alias("t"))
    rows = rows.select("line_doc", F.xxhash64("t").alias("line_text"), lines).withColumn("key", line_key(F.col("line")))
    return rows.where(F.char_length("key") >= min_chars).select("line_doc", "line_text", key_hash(F.col("key")).alias("k"), "line_pos").select("line_doc", "line_text", "k.*", "line_pos")


#: While runs are read, a scan counts as sorted, as each bucket is one sorted file; and a union of
#: runs does not count as dealt by hash (Spark reports its buckets but does not keep them together).
READING = {"spark.sql.legacy.bucketedTableScan.outputOrdering": "true", "spark.sql.unionOutputPartitioning": "false"}


@contextmanager
def reading_runs(spark: SparkSession) -> Iterator[None]:
    """The session with READING, and afterwards as it was."""
    was = {name: spark.conf.get(name, None) for name in READING}
    for name, value in READING.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in was.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


@dataclass
class Runs:
    """Levelled sorted runs: tables below one shared folder, all with the same buckets."""

    spark: SparkSession
    min_docs: int = 3
    fanout: int = 3
    levels: list[list[str]] = field(default_factory=list)
    buckets: int = 0

    def __post_init__(self) -> None:
        self.buckets = self.buckets or int(self.spark.conf.get("spark.sql.shuffle.partitions"))

    def all(self) -> list[str]:
        return [run for level in self.levels for run in level]

    def deal(self, rows: DataFrame) -> str:
        """The name of a bucketed table of rows, sorted by hash in each bucket.

        Rows that an aggregation or join has dealt by hash give one file a bucket.
        """
        name = f"line_run_{uuid.uuid4().hex}"
        rows = rows.select(*KEY, "n_docs", "max_doc").write.bucketBy(self.buckets, *KEY).sortBy(*KEY)
        rows.option("compression", "zstd").option("path", scratch(self.spark, "line-run")).saveAsTable(name)
        return name

    def drop(self, name: str) -> None:
        """Forget a run and delete its files."""
        rows = self.spark.table(name)
        self.spark.catalog.refreshTable(name)
        forget(rows)
        self.spark.sql(f"DROP TABLE {name}")

    def settled(self, run: str) -> DataFrame:
        """Keys that a run holds in min_docs documents."""
        return self.spark.table(run).where(F.col("n_docs") >= self.min_docs).select(*KEY)

    def add(self, batch: str) -> str:
        """Take in a dealt batch whose ids are smaller than those of the runs.

        Its keys that no run has settled, found by merge anti-joins, become a
        run of level 0, which takes the batch's place.  Returns that run's name.
        """
        if not self.levels:
            self.levels.append([])
        name = batch
        if runs := self.all():
            with reading_runs(self.spark):
                new = reduce(lambda rows, run: rows.join(self.settled(run).hint("merge"), list(KEY), "left_anti"), runs, self.spark.table(batch))
                name = self.deal(new)
            self.drop(batch)
        self.levels[0].append(name)
        self.compact()
        return name

    def merged(self, runs: list[str]) -> DataFrame:
        """A row for each key of the runs, which hold counts of disjoint documents; to be run while reading_runs() lasts."""
        every = reduce(DataFrame.unionByName, [self.spark.table(r) for r in runs])
        return every.groupBy(*KEY).agg(F.sum("n_docs").alias("n_docs"), F.max("max_doc").alias("max_doc"))

    def compact(self) -> None:
        """Merge each full level into one run of the next."""
        for at in range(len(self.levels)):
            if len(self.levels[at]) >= self.fanout:
                full, self.levels[at] = self.levels[at], []
                if at + 1 == len(self.levels):
                    self.levels.append([])
                with reading_runs(self.spark):
                    self.levels[at + 1].append(self.deal(self.merged(full)))
                for run in full:
                    self.drop(run)

    def common(self) -> DataFrame:
        """Keys in min_docs documents or more, each with the largest id that holds it, as a table of its own."""
        with reading_runs(self.spark):
            return stored(self.merged(self.all()).where(F.col("n_docs") >= self.min_docs).select(*KEY, "max_doc"), "line-common")


def id_ranges(docs: DataFrame, doc_id: str, batches: int) -> Column:
    """The batch of ``line_doc``: 0 for the largest ids, and so on down."""
    shares = [i / batches for i in range(1, batches)]
    cuts = docs.agg(F.percentile_approx(F.col(doc_id).cast("long"), shares)).first()[0] or []
    return reduce(lambda a, b: a + b, [(F.col("line_doc") <= c).cast("int") for c in cuts], F.lit(0))


def dedup_lines(
    docs: DataFrame, *, min_chars: int = 20, min_docs: int = 3, batches: int = 4, fanout: int = 3, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """docs with line_kept (the text that stays), line_n and line_dropped (lines before, lines lost)."""
    docs = docs.drop(*[c for c in docs.columns if c.lower().startswith("line_")])
    spark = docs.sparkSession
    path = scratch(spark, "line-keys")
    found = key_lines(docs, doc_id, text, min_chars).withColumn("line_batch", id_ranges(docs, doc_id, batches))
    found.write.partitionBy("line_batch").option("compression", "zstd").parquet(path)
    found = spark.read.schema(found.schema).parquet(path)
    split = max(SPLIT, found.count() // HEAVY)

    runs = Runs(spark, min_docs, fanout)
    heavy = []
    for batch in range(batches):
        # a line that many documents hold is counted before it is dealt by key
        once = found.where(F.col("line_batch") == batch).select(*KEY, "line_doc").distinct()
        dealt = runs.deal(once.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_docs"), F.max("line_doc").alias("max_doc")))
        heavy.append(stored(spark.table(dealt).where(F.col("n_docs") > split).select(*KEY), "line-heavy"))
        runs.add(dealt)

    common = runs.common()
    for run in runs.all():
        runs.drop(run)
    hot = F.broadcast(common.join(F.broadcast(reduce(DataFrame.unionByName, heavy).distinct()), list(KEY)))
    rest = found.join(hot, list(KEY), "left_anti").join(common, list(KEY))
    lost = found.join(hot, list(KEY)).unionByName(rest).where(F.col("line_doc") != F.col("max_doc"))
    lost = lost.groupBy("line_doc", "line_text").agg(F.collect_set("line_pos").alias("line_lost"))

    marked = docs.withColumns({"line_mark": F.xxhash64(text), "line_all": F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)})
    joined = marked.join(lost, (F.col(doc_id) == F.col("line_doc")) & (F.col("line_mark") == F.col("line_text")), "left")
    lines, gone = F.col("line_all"), F.coalesce(F.col("line_lost"), F.array().cast("array<int>"))
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
    kept = F.when(F.size(gone) == 0, F.coalesce(F.col(text), F.lit(""))).otherwise(F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n"))
    own = {"line_kept": kept, "line_n": F.size(lines).cast("long"), "line_dropped": F.size(gone).cast("long")}
    return joined.select(*[F.col(f"`{c}`") for c in docs.columns], *[v.alias(k) for k, v in own.items()])
