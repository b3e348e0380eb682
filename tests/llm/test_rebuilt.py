"""The archive's query takes what it returns from the rebuilt bytes."""

from pyspark.sql import functions as F

from pagewright.llm import queries, warc


def test_op6_reads_joined_bytes(spark, sf_dir, monkeypatch):
    whole = queries.op6_warc(spark, sf_dir)
    want = {r.page_id: (r.payload_bytes, r.payload_digest) for r in whole.collect()}
    pages = {r.page_id: r.n for r in queries.table(spark, sf_dir, "pages").select("page_id", F.octet_length("html").alias("n")).collect()}
    assert {k: n for k, (n, _) in want.items()} == pages
    real = warc.read_archive

    def longer(*a, **kw):
        read = real(*a, **kw)
        return read.withColumns({c: F.concat(F.col(c), F.lit(b"x")) for c in ("payload", "record") if c in read.columns}).where("record_type <> 'revisit'")

    monkeypatch.setattr(warc, "read_archive", longer)
    got = queries.op6_warc(spark, sf_dir).collect()
    assert got and all(r.payload_bytes == want[r.page_id][0] + 1 and r.payload_digest != want[r.page_id][1] for r in got)
