"""Near-duplicate documents by b-bit MinHash.

A document's set is its distinct shingles of ``words`` words (A-Z in lower case;
a word is a run of anything but ASCII white space); with fewer words the whole
sequence is the one shingle.  Documents are linked if 100 * |A and B| >=
``percent`` * |A or B|; the result gives each the smallest id it can reach.

* One pass takes from each whole text the size of its set, a 128-bit hash of the
  set, the ``bands`` x ``rows`` minima of as many hash functions as one hash a
  band, and the lowest ``BITS`` bits of every minimum, packed.
* Documents with equal sets are one class, so copies never meet as pairs.
* Classes that share a band are candidates.  Of each bucket the members are
  paired with its smallest id only, one pair a member (the most alike, by bit
  counts), confirmed and joined to components.  Then the pairs that remain, of
  buckets whose members lie in different components, are taken: to the smallest
  id, and at last members with members, in blocks of a bucket that are compared
  within a task: only pairs that pass the next tests leave it.  Members of one
  component need no pair: no pair of theirs can change the result.
* Before a pair is confirmed, equal bits of the two packed signatures estimate
  the similarity, corrected for chance collisions.  Pairs are put aside only
  when the estimate lies ``SIGMAS`` standard deviations below the threshold.
* A second test can't put aside a link at all: each set also keeps the parity of
  its hashes in a few bits a shingle.  Two sets that differ in d shingles have
  parities that differ in d bits at most, so more differing bits than the
  threshold allows prove that they are not linked.
* In a bucket of more than ``MEMBERS`` members, those of its largest component
  meet only the others, so a bucket that is nearly one component costs its size.
* Keys that many rows share (a class of copies, a bucket, a smallest id) are
  joined by broadcast, and the rest by shuffle: see ``hot_join``.
* Confirmation reads the full sets.  Those of all members of buckets are written
  once; pairs are dealt by their smaller id, hot ones in parts, and a task holds
  one such set while it streams the others.
* Components come from label rounds in Spark; nothing is collected.

With 40 bands of 6 rows a pair at the threshold of 0.8 is missed with
probability 5e-6, and one at 0.9 with 1e-13.

Nulls and odd inputs: a null text, or one without words, has an empty set, is
linked with nothing and is its own component; rows that repeat an id are one
document, linked by each of their texts; a row with a null id gets a null
component and is kept; texts have no largest length (minima are taken in
blocks); an empty table gives no rows.  Columns other than id and text are not
read.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_batch, forget, hot_join, stored, temporary

BITS, SIGMAS, SEED = 2, 6.0, 20240101
#: Ids that are broadcast at most (16 MB); above, the join is by shuffle.
BROADCAST_IDS = 1_000_000
#: Pairs of one smaller id that a task takes together.
PART = 256
#: Members of a bucket that are compared with others at a time.
MEMBERS = 1024
#: Parity bits for each shingle, and bits of a set at least and at most.
PARITY, PARITY_LEAST, PARITY_MOST = 4, 256, 1 << 17
#: Bounds of a worker's table of word hashes, and shingles hashed at a time.
KNOWN_WORDS, BLOCK = 300_000, 2048

_MIX1, _MIX2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_STEP = np.uint64(0x9E3779B97F4A7C15)


class Shingler:
    """The set of a text as sorted 64-bit hashes."""

    def __init__(self, words: int):
        self.words, self.known = words, {}

    def __call__(self, text: bytes) -> np.ndarray:
        tokens = text.lower().split()  # on bytes: A-Z only, ASCII white space only
        if not tokens:
            return np.empty(0, np.uint64)
        if len(self.known) > KNOWN_WORDS:
            self.known = {}
        known = self.known
        for token in set(tokens).difference(known):
            known[token] = xxhash.xxh3_64_intdigest(token)
        ids = np.fromiter(map(known.__getitem__, tokens), np.uint64, len(tokens))
        k = min(self.words, len(ids))
        mixed = np.full(len(ids) - k + 1, np.uint64(k), np.uint64)
        for i in range(k):
            mixed = (mixed ^ ids[i : len(ids) - k + 1 + i]) * _STEP
            mixed ^= mixed >> np.uint64(32)
        mixed = (mixed ^ (mixed >> np.uint64(33))) * _MIX1
        mixed = (mixed ^ (mixed >> np.uint64(33))) * _MIX2
        return np.unique(mixed ^ (mixed >> np.uint64(33)))


def minima(grams: np.ndarray, n: int) -> np.ndarray:
    """The minima of n hash functions over a non-empty set."""
    rng = np.random.default_rng(SEED)
    odd = rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    add = rng.integers(0, 2**63, n, dtype=np.uint64)
    least = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    step = max(1, BLOCK)
    for at in range(0, len(grams), step):
        part = grams[at : at + step]
        hashed = odd[:, None] * part[None, :]
        hashed += add[:, None]
        np.minimum(least, hashed.min(axis=1), out=least)
    return least


def packed(least: np.ndarray) -> bytes:
    """The lowest BITS bits of every minimum's upper half (the well mixed one), one bit plane after the other."""
    low = (least >> np.uint64(40)) & np.uint64((1 << BITS) - 1)
    return b"".join(np.packbits(((low >> np.uint64(b)) & np.uint64(1)).astype(np.uint8)).tobytes() for b in range(BITS))


def band_hashes(least: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit hash a band, which holds the band's number too."""
    grid = least.reshape(bands, rows)
    mixed = np.arange(1, bands + 1, dtype=np.uint64) * _STEP
    for i in range(rows):
        mixed = (mixed ^ grid[:, i]) * _MIX1
        mixed ^= mixed >> np.uint64(29)
    return (mixed * _MIX2).view(np.int64)


def parity(grams: np.ndarray) -> bytes:
    """Whether an odd number of the set's hashes falls on each place; the places are the lowest bits of a hash."""
    size = PARITY_LEAST
    while size < min(PARITY * len(grams), PARITY_MOST):
        size *= 2
    odd = np.bincount((grams & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def folded(bits: np.ndarray, size: int) -> np.ndarray:
    """Parities (rows of bytes) of so many bytes: two places that become one add up."""
    while bits.shape[-1] > size:
        half = bits.shape[-1] // 2
        bits = bits[..., :half] ^ bits[..., half:]
    return bits


def differing_bits(x: bytes, y: bytes) -> int:
    """At most the number of shingles that only one of the two sets has."""
    size = min(len(x), len(y))
    a, b = (folded(np.frombuffer(z, np.uint8), size) for z in (x, y))
    return int(np.bitwise_count(a ^ b).sum())


def may_differ(total, percent: int):
    """The most shingles in which two linked sets, of so many shingles together, can differ."""
    return total * (100 - percent) // (100 + percent)


def least_agreement(percent: int, n: int) -> float:
    """Share of equal minima below which a pair is put aside."""
    s, chance = percent / 100, 1 / (1 << BITS)
    agree = s + (1 - s) * chance
    return agree - SIGMAS * (agree * (1 - agree) / n) ** 0.5


def equal_minima(x: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
    """How many of n minima agree in all BITS bits; x and y are rows of packed signatures."""
    differ = np.bitwise_or.reduce((x ^ y).reshape(len(y), BITS, -1), axis=1)
    return n - np.bitwise_count(differ).sum(axis=1).astype(np.int64)


def similarity(same: np.ndarray, n: int) -> np.ndarray:
    """The similarity estimated from how many of n minima agree in all BITS bits: chance agrees in 1 of 2**BITS."""
    chance = 1 / (1 << BITS)
    return (same / n - chance) / (1 - chance)


def signatures(docs: DataFrame, *, words: int, bands: int, rows: int, doc_id: str, text: str) -> DataFrame:
    """(id, n_shingles, k1, k2, sig, parity, hashes) of every whole text; without words, n_shingles is 0 and the rest null."""

    def make():
        shingler = Shingler(words)

        def one(data: bytes | None):
            grams = shingler(data or b"")
            if not len(grams):
                return 0, None, None, None, None, None
            least = minima(grams, bands * rows)
            raw = grams.tobytes()
            key = xxhash.xxh3_128_digest(raw)
            k1, k2 = np.frombuffer(key, np.int64).tolist()
            return len(grams), k1, k2, packed(least), parity(grams), band_hashes(least, bands, rows)

        def work(batch):
            found = [one(t.as_py()) for t in batch.column(1)]
            names = ("n_shingles", "k1", "k2", "sig", "parity", "hashes")
            return {"id": batch.column(0)} | {n: [f[i] for f in found] for i, n in enumerate(names)}

        return work

    chosen = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("binary").alias("text"))
    return by_batch(chosen, make, "id long, n_shingles long, k1 long, k2 long, sig binary, parity binary, hashes array<long>")


def shingle_sets(docs: DataFrame, words: int) -> DataFrame:
    """(id, grams): the sorted hashes of each text's set, 8 bytes each."""

    def make():
        shingler = Shingler(words)

        def work(batch):
            return {"id": batch.column(0), "grams": [shingler(t.as_py() or b"").tobytes() for t in batch.column(1)]}

        return work

    return by_batch(docs, make, "id long, grams binary")


def likely(pairs: DataFrame, sigs: DataFrame, n: int, percent: int) -> DataFrame:
    """Pairs (a, b) with score, the bit-count estimate in thousandths, without those that are not linked by either test."""
    side = lambda x: sigs.select(F.col("id").alias(x), F.col("sig").alias(f"sig_{x}"), F.col("parity").alias(f"parity_{x}"), F.col("n_shingles").alias(f"n_{x}"))
    # a hot smaller id has its signature, of PARITY_MOST bits at most, broadcast
    joined = hot_join(pairs, side("a"), ["a"], most=1000).join(side("b"), "b")
    # sets whose sizes differ too much can't reach the threshold
    joined = joined.where((F.col("n_a") * 100 >= F.col("n_b") * percent) & (F.col("n_b") * 100 >= F.col("n_a") * percent))

    def make():
        least = least_agreement(percent, n)

        def work(batch):
            rows = [np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for i in (2, 3)]
            same = equal_minima(*rows, n)
            most = may_differ(batch.column(6).to_numpy(zero_copy_only=False), percent)
            keep = [i for i in np.flatnonzero(same >= least * n) if differing_bits(batch.column(4)[i].as_py(), batch.column(5)[i].as_py()) <= most[i]]
            if not keep:
                return None
            score = np.round(similarity(same[keep], n) * 1000).astype(np.int64)
            return {"a": batch.column(0).take(keep), "b": batch.column(1).take(keep), "score": score}

        return work

    rows = joined.select("a", "b", "sig_a", "sig_b", "parity_a", "parity_b", (F.col("n_a") + F.col("n_b")).alias("n"))
    return by_batch(rows, make, "a long, b long, score long")


class Block:
    """Members of one bucket (or of two of its parts), smaller sets first."""

    def __init__(self, rows: list[tuple], n: int, percent: int, least: float):
        self.ids, self.comps, self.parts, self.sizes = (np.array([r[i] for r in rows], np.int64) for i in (0, 1, 2, 3))
        self.sigs = np.frombuffer(b"".join([r[4] for r in rows]), np.uint8).reshape(len(rows), -1)
        self.raw = [np.frombuffer(r[5], np.uint8) for r in rows]
        self.n, self.percent, self.least = n, percent, least
        self.places: dict[int, np.ndarray] = {}

    def _parities(self, size: int) -> np.ndarray:
        """Of the members whose parity has so many bytes or more, which are the last ones."""
        if size not in self.places:
            some = [folded(r, size) for r in self.raw if len(r) >= size]
            self.places[size] = np.stack(some)
        return self.places[size]

    def pairs(self, crossing: bool) -> list[tuple[int, int]]:
        """Pairs of different components that both tests leave: between the two parts, or within the one."""
        out: list[tuple[int, int]] = []
        ends = np.searchsorted(self.sizes, self.sizes * 100 // self.percent, side="right")
        for i, end in enumerate(ends.tolist()):
            if end <= i + 1:
                continue
            other = slice(i + 1, end)
            keep = self.comps[other] != self.comps[i]
            if crossing:
                keep &= self.parts[other] != self.parts[i]
            at = np.flatnonzero(keep) + i + 1
            if len(at):
                at = at[equal_minima(self.sigs[i], self.sigs[at], self.n) >= self.least * self.n]
            if len(at):
                size = len(self.raw[i])
                every = self._parities(size)
                first = len(self.raw) - len(every)
                differ = np.bitwise_count(every[at - first] ^ self.raw[i]).sum(axis=1)
                at = at[differ <= may_differ(self.sizes[at] + self.sizes[i], self.percent)]
            one = int(self.ids[i])
            out += [(min(one, b), max(one, b)) for b in self.ids[at].tolist()]
        return out


def block_plan(rest: DataFrame) -> DataFrame:
    """(bucket, main, k1, k2) of each bucket of more than MEMBERS members (bucket, id, comp).

    main is its largest component, k1 and k2 the numbers of parts of MEMBERS
    members, about, of main and of the others.
    """
    per = rest.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("n"))
    per = per.groupBy("bucket").agg(F.sum("n").alias("n"), F.max(F.struct("n", "comp")).alias("m")).where(F.col("n") > MEMBERS)
    parts = lambda n: F.ceil(n / MEMBERS).cast("int")
    return per.select("bucket", F.col("m.comp").alias("main"), parts(F.col("m.n")).alias("k1"), parts(F.col("n") - F.col("m.n")).alias("k2"))


def in_blocks(rest: DataFrame, plan: DataFrame) -> DataFrame:
    """Members (bucket, id, comp) with their part of the bucket, once for each two parts (p, q) that are compared.

    Parts of the largest component meet those of the others only.
    """
    few = plan.count() <= BROADCAST_IDS
    rows = rest.join(F.broadcast(plan) if few else plan, "bucket", "left").where("k2 is null or k2 > 0")
    place = lambda k: F.pmod(F.xxhash64("id"), k).cast("int")
    main = F.col("comp") == F.col("main")
    part = F.when(F.col("k1").isNull(), F.lit(0)).when(main, place(F.col("k1"))).otherwise(F.col("k1") + place(F.col("k2")))
    last = F.col("k1") + F.col("k2") - 1
    others = F.when(F.col("k1").isNull(), F.array(F.lit(0))).when(main, F.sequence(F.col("k1"), last)).otherwise(F.sequence(F.lit(0), last))
    rows = rows.select("bucket", "id", "comp", part.alias("part"), F.explode(others).alias("other"))
    return rows.select("bucket", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"), "id", "comp", "part")


def within_buckets(rest: DataFrame, sigs: DataFrame, n: int, percent: int) -> DataFrame:
    """Pairs (a, b) of members (bucket, id, comp) in one bucket but not one component, that both tests leave.

    Members are dealt at once by bucket and two of its parts, and compared where they meet.
    """
    rows = in_blocks(rest, stored(block_plan(rest), "near-blocks"))
    rows = rows.join(sigs, "id").select("bucket", "p", "q", "id", "comp", "part", "n_shingles", "sig", "parity")
    rows = rows.repartition("bucket", "p", "q").sortWithinPartitions("bucket", "p", "q", "n_shingles", "id")

    def make():
        least = least_agreement(percent, n)
        held: list = [None, []]

        def done() -> list[tuple[int, int]]:
            key, own = held
            return Block(own, n, percent, least).pairs(crossing=key[1] != key[2]) if len(own) > 1 else []

        def work(batch):
            out: list[tuple[int, int]] = []
            if batch is not None:
                columns = [c.to_pylist() for c in batch.columns]
                for row in zip(*columns, strict=True):
                    if row[:3] != held[0]:
                        out += done()
                        held[:] = [row[:3], []]
                    held[1].append(row[3:])
            else:
                out = done()
            return {"a": [p[0] for p in out], "b": [p[1] for p in out]}

        work.last = True
        return work

    return by_batch(rows, make, "a long, b long").distinct()


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold."""
    pairs = stored(pairs.select("a", "b"), "near-pairs")
    per = stored(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > PART), "near-hubs")
    few = per.count() <= BROADCAST_IDS
    part = F.pmod(F.xxhash64("b"), F.ceil(F.coalesce("n", F.lit(1)) / PART).cast("long")).cast("int")
    dealt = pairs.join(F.broadcast(per) if few else per, "a", "left").select("a", part.alias("part"), "b")
    members = dealt.join(sets.withColumnRenamed("id", "b"), "b").select("a", "part", F.lit(1).alias("member"), "b", "grams")
    hubs = dealt.select("a", "part").distinct().join(sets.withColumnRenamed("id", "a"), "a").select("a", "part", F.lit(0).alias("member"), F.col("a").alias("b"), "grams")
    rows = hubs.unionByName(members).repartition("a", "part").sortWithinPartitions("a", "part", "member")

    def make():
        held: list = [None, []]  # the smaller id and part, and its sets: rows that repeat an id have several

        def one(a, part, member, b, grams) -> bool:
            own = np.frombuffer(grams, np.uint64)
            if held[0] != (a, part):
                held[:] = [(a, part), []]
            if not member:
                held[1].append(own)
                return False
            for hub in held[1]:
                both = len(np.intersect1d(hub, own, assume_unique=True))
                if both and 100 * both >= percent * (len(hub) + len(own) - both):
                    return True
            return False

        def work(batch):
            columns = [c.to_pylist() for c in batch.columns]
            keep = [i for i, row in enumerate(zip(*columns, strict=True)) if one(*row)]
            return {"a": [columns[0][i] for i in keep], "b": [columns[3][i] for i in keep]}

        return work

    return by_batch(rows, make, "a long, b long").distinct()


def components(links: DataFrame, *, rounds: int = 60) -> DataFrame:
    """(id, comp): the smallest id that each end of a link can reach.

    Each round hangs every neighbour of a node on the smallest node around it
    (larger ones, then smaller ones), so paths shorten by more than half; edges
    are written to the shared folder between rounds.
    """
    edges = stored(links.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).where("v != u").distinct(), "near-edges")
    for _ in range(rounds):
        both = edges.select("v", "u").unionByName(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("v").agg(F.min("u").alias("m")).withColumn("m", F.least("v", "m"))
        large = both.join(least, "v").where(F.col("u") > F.col("v")).select(F.col("u").alias("v"), F.col("m").alias("u")).where("v != u")
        large = stored(large.distinct(), "near-large")
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(least, "v").select(F.when(F.col("u") == F.col("m"), F.col("v")).otherwise(F.col("u")).alias("v"), F.col("m").alias("u"))
        after = stored(small.where("v != u").distinct(), "near-edges")
        settled = _digest(after) == _digest(edges)
        forget(large)
        forget(after if settled else edges)
        if settled:
            break
        edges = after
    else:
        raise RuntimeError("components did not settle")
    tops = edges.select(F.col("u").alias("id"), F.col("u").alias("comp")).distinct()
    return edges.select(F.col("v").alias("id"), F.col("u").alias("comp")).unionByName(tops)


def _digest(edges: DataFrame) -> tuple:
    """Number of edges and an order-free hash of them."""
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def relabelled(comps: DataFrame, more: DataFrame) -> DataFrame:
    """Components of the links so far, with further links between them."""
    ends = more.join(comps.select(F.col("id").alias("a"), F.col("comp").alias("ca")), "a", "left")
    ends = ends.join(comps.select(F.col("id").alias("b"), F.col("comp").alias("cb")), "b", "left")
    between = ends.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    upper = stored(components(between), "near-upper")
    moved = comps.join(upper.withColumnRenamed("comp", "top").withColumnRenamed("id", "comp"), "comp", "left")
    moved = moved.select("id", F.coalesce("top", "comp").alias("comp"))
    # nodes that only the new links reach
    fresh = upper.join(comps.select("id"), "id", "left_anti")
    return moved.unionByName(fresh)


def near_duplicates(
    docs: DataFrame, *, words: int = 5, percent: int = 80, bands: int = 40, rows: int = 6, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of docs."""
    with temporary() as keep:
        every = _near_duplicates(docs, words, percent, bands, rows, doc_id, text, keep)
    kept = F.coalesce(F.col("id") == F.col("comp"), F.lit(True))
    return every.select(F.col("id").alias(doc_id), "n_shingles", F.col("comp").alias("component_id"), kept.alias("kept"))


def _near_duplicates(docs: DataFrame, words: int, percent: int, bands: int, rows: int, doc_id: str, text: str, keep: list[DataFrame]) -> DataFrame:
    """(id, n_shingles, comp) of every row of docs; the tables that it reads are noted in ``keep``."""
    n = bands * rows
    found = stored(signatures(docs, words=words, bands=bands, rows=rows, doc_id=doc_id, text=text), "near-sigs")
    keep.append(found)
    filled = found.where("n_shingles > 0 and id is not null")
    classes = stored(filled.groupBy("k1", "k2").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n")), "near-classes")
    # one row for each class, that of its smallest id: joined by id, so copies of one text don't meet
    own_class = classes.select(F.col("rep").alias("id"), "k1", "k2")
    reps = filled.join(own_class, ["id", "k1", "k2"], "left_semi").dropDuplicates(["id", "k1", "k2"])
    reps = stored(reps.select("id", "k1", "k2", "n_shingles", "sig", "parity", "hashes"), "near-reps")

    banded = reps.select("id", F.explode("hashes").alias("bucket"))
    buckets = banded.groupBy("bucket").agg(F.min("id").alias("hub"), F.max("id").alias("top"), F.count(F.lit(1)).alias("n")).where("hub != top").select("bucket", "hub", "n")
    members = stored(hot_join(banded, buckets, ["bucket"], counts="n").select("bucket", "hub", "id").distinct(), "near-members")
    sigs = reps.select("id", "n_shingles", "sig", "parity")

    star = stored(members.where("id != hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct(), "near-star")
    star = stored(likely(star, sigs, n, percent), "near-likely")
    involved = members.select("id").distinct()
    few = involved.count() <= BROADCAST_IDS
    source = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("binary").alias("text"))
    texts = source.join(F.broadcast(involved) if few else involved, "id", "left_semi")
    sets = stored(shingle_sets(texts, words), "near-sets", codec="lz4")

    # an id with several texts links their classes
    several = filled.groupBy("id").agg(F.min("k1").alias("x"), F.max("k1").alias("y"), F.min("k2").alias("z"), F.max("k2").alias("w")).where("x != y or z != w").select("id")
    own = filled.join(several, "id").join(classes, ["k1", "k2"]).where("id != rep").select(F.col("rep").alias("a"), F.col("id").alias("b"))
    best = star.groupBy("b").agg(F.max(F.struct("score", (-F.col("a")).alias("a"))).alias("best")).select((-F.col("best.a")).alias("a"), "b")
    first = confirmed(best, sets, percent)
    comps = stored(components(first), "near-comps")

    def apart(pairs: DataFrame) -> DataFrame:
        ends = pairs.join(comps.select(F.col("id").alias("a"), F.col("comp").alias("ca")), "a", "left")
        ends = ends.join(comps.select(F.col("id").alias("b"), F.col("comp").alias("cb")), "b", "left")
        return ends.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")

    second = confirmed(apart(star.join(best, ["a", "b"], "left_anti")), sets, percent)
    comps = stored(relabelled(comps, second), "near-comps")

    # what is left: buckets with several components, less their smallest id
    placed = stored(members.join(comps, "id", "left").withColumn("comp", F.coalesce("comp", "id")), "near-placed")
    mixed = placed.groupBy("bucket").agg(F.min("comp").alias("c1"), F.max("comp").alias("c2"), F.count(F.lit(1)).alias("n")).where("c1 != c2").select("bucket", "n")
    rest = stored(hot_join(placed, mixed, ["bucket"], counts="n").where("id != hub").select("bucket", "id", "comp"), "near-rest")
    third = confirmed(within_buckets(rest, sigs, n, percent), sets, percent)
    comps = stored(relabelled(comps, third.unionByName(own.distinct())), "near-comps")

    least = classes.join(comps.withColumnRenamed("id", "rep"), "rep", "left").select("k1", "k2", F.coalesce("comp", "rep").alias("comp"), "n")
    filled = hot_join(filled.select("id", "n_shingles", "k1", "k2"), least, ["k1", "k2"], counts="n", keep=keep).select("id", "n_shingles", "comp")
    empty = found.where("n_shingles = 0 or id is null").select("id", "n_shingles", F.col("id").alias("comp"))
    return filled.unionByName(empty)
