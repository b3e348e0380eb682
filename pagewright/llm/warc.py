"""Content-addressed web archive.

A record's payload bytes are stored once, under their SHA-256; its exact header
bytes are kept apart, in a table of records that names the digest.  The record
with the largest id among equal payloads is the response, the others are
revisits of it; payloads below ``min_bytes`` are never shared.  Reading joins
the records to the payloads again and tests, from the stored bytes, that the
SHA-256 is the address, that the header's digest is the payload's SHA-1 and that
lengths agree; a failure raises an error in the query.

An archive is a folder that driver and executors share, with two Parquet tables:

* ``payloads`` (digest, payload, owner): a row for each distinct payload, with
  the largest id that has it;
* ``records`` (page_id, digest, header): a row for each record; ``header`` is the
  exact block from ``WARC/1.1`` to the empty line.

Nulls and odd inputs: a null payload is an empty one; a null url gives an empty
target; line ends in a url are percent-encoded, so that they can't end a header;
rows that repeat an id are records of their own, and if they hold the largest id
of their payload they are all responses; a null id is a record whose id is
written ``null`` and is a response only where no other id has the payload; an
empty table gives an empty archive.  Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The base 32 alphabet of RFC 4648.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
DATE = "2024-01-01T00:00:00Z"


def base32_sha1(data: Column) -> Column:
    """Upper-case base 32 of the SHA-1: 160 bits are 32 digits, 5 bytes are 8 of them."""
    hexed = F.sha1(data)
    parts = []
    for at in range(0, 40, 10):  # 40 bits fit a long
        bits = F.conv(F.substring(hexed, at + 1, 10), 16, 10).cast("long")
        for shift in range(35, -1, -5):
            parts.append(F.substring(F.lit(BASE32), (F.shiftright(bits, shift).bitwiseAND(31) + 1).cast("int"), F.lit(1)))
    return F.concat(*parts)


def _field(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))


def header(page_id: Column, url: Column, digest: Column, n_bytes: Column, refers_to: Column) -> Column:
    """The exact header bytes of a record; refers_to is null for a response."""
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    target = F.regexp_replace(F.regexp_replace(F.coalesce(url, F.lit("")), "\r", "%0D"), "\n", "%0A")
    revisit = refers_to.isNotNull()
    text = F.concat(
        F.lit("WARC/1.1\r\n"),
        _field("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _field("WARC-Record-ID", name(page_id)),
        _field("WARC-Date", F.lit(DATE)),
        _field("WARC-Target-URI", target),
        _field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), digest)),
        F.when(revisit, F.concat(_field("WARC-Refers-To", name(refers_to)), _field("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")))).otherwise(""),
        _field("Content-Type", F.lit("text/html")),
        _field("Content-Length", F.when(revisit, F.lit("0")).otherwise(n_bytes.cast("string"))),
        F.lit("\r\n"),
    )
    return text.cast("binary")


def write_archive(pages: DataFrame, folder: str, *, page_id: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = 0) -> None:
    """Write the two tables of an archive below folder.

    Payloads are grouped by digest, so each crosses the network once at most for
    every task that holds it; the records join only ids and digests.
    """
    spark = pages.sparkSession
    body = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("url"), body.alias("payload"))
    rows = rows.withColumn("digest", F.unhex(F.sha2("payload", 256)))

    owners = rows.groupBy("digest").agg(F.first("payload").alias("payload"), F.max("page_id").alias("owner"))
    owners.write.option("compression", "zstd").parquet(f"{folder}/payloads")
    # the digest of each payload is taken once more from the stored bytes, when they are read
    stored = spark.read.parquet(f"{folder}/payloads")
    facts = stored.select("digest", "owner", base32_sha1(F.col("payload")).alias("sha1"), F.octet_length("payload").cast("long").alias("n_bytes"))
    shared = (F.col("n_bytes") >= min_bytes) & F.col("owner").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("owner"))
    records = rows.select("page_id", "url", "digest").join(facts, "digest")
    records = records.withColumn("refers_to", F.when(shared, F.col("owner")))
    records = records.select("page_id", "digest", header(F.col("page_id"), F.col("url"), F.col("sha1"), F.col("n_bytes"), F.col("refers_to")).alias("header"))
    records.write.option("compression", "zstd").parquet(f"{folder}/records")


def _value(head: Column, name: str) -> Column:
    return F.nullif(F.regexp_extract(head, rf"(?md)^{name}: ([^\r\n]*)\r\n", 1), F.lit(""))


def parsed(head: Column) -> dict[str, Column]:
    """Fields of a record's header bytes."""
    text = head.cast("string")
    page = r"<urn:page:(-?[0-9]+|null)>"
    number = lambda name: F.regexp_extract(text, rf"(?md)^{name}: {page}\r\n", 1)
    as_id = lambda c: F.when(c.rlike("^-?[0-9]+$"), c).cast("long")
    return {
        "page_id": as_id(number("WARC-Record-ID")),
        "record_type": _value(text, "WARC-Type"),
        "url": F.coalesce(_value(text, "WARC-Target-URI"), F.lit("")),
        "payload_digest": F.regexp_extract(text, r"(?md)^WARC-Payload-Digest: sha1:([A-Z2-7]{32})\r\n", 1),
        "refers_to": as_id(number("WARC-Refers-To")),
        "content_length": F.regexp_extract(text, r"(?md)^Content-Length: ([0-9]+)\r\n", 1).cast("long"),
    }


def read_archive(spark: SparkSession, folder: str, *, payloads: bool = True) -> DataFrame:
    """Every record again: its header's fields, header, payload_bytes and (unless payloads is false) payload and record bytes.

    Each stored payload is tested once, each record against its payload.
    ``record`` is header, own block and two line ends: a revisit's block is empty.
    """
    store = spark.read.parquet(f"{folder}/payloads").select("digest", "payload")
    tested = store.select(
        F.when(F.unhex(F.sha2("payload", 256)) == F.col("digest"), F.col("digest")).otherwise(F.raise_error(F.lit("payload digest")).cast("binary")).alias("digest"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        base32_sha1(F.col("payload")).alias("sha1"),
        *([F.col("payload")] if payloads else []),
    )
    records = spark.read.parquet(f"{folder}/records").select("digest", "header").withColumns(parsed(F.col("header")))
    joined = records.join(tested, "digest", "left")
    length = F.when(F.col("record_type") == "revisit", F.lit(0)).otherwise(F.col("payload_bytes"))
    sound = (F.col("sha1") == F.col("payload_digest")) & (length == F.col("content_length"))
    joined = joined.withColumn("payload_digest", F.when(sound, F.col("payload_digest")).otherwise(F.raise_error(F.lit("record digest or length")).cast("string")))
    if payloads:
        block = F.when(F.col("record_type") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
        joined = joined.withColumn("record", F.concat(F.col("header"), block, F.lit(b"\r\n\r\n")))
    return joined.drop("sha1", "digest", "content_length")
