"""Queries of readers and sinks: tables go out as files below the shared scratch folder and are read back.

Named files are few (nations, regions) since the driver writes them; coverage and
mutant reports are written by tasks, one bounded group a file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import checkpoints, decode, snapshot
from ..sources import evidence, generators, images, schemas, sinks
from ..sources.scratch import scratch, stored
from .census import KIND, D, P, byte_of, text_pages
from .census import images as text_images


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _placed(rows: DataFrame, path: Column, content: Column, name: str) -> str:
    """A new folder with one named file a row."""
    root = scratch(rows.sparkSession, name)
    sinks.write_files(rows.select(path.alias("path"), content.cast("binary").alias("content")), root)
    return root


def _grouped(rows: DataFrame, group: Column, doc: Column, name: str) -> str:
    """A new folder with one JSON document a group, which doc aggregates."""
    root = scratch(rows.sparkSession, name)
    rows.groupBy(group.alias("part")).agg(F.to_json(doc).alias("value")).repartition("part").write.partitionBy("part").text(root)
    return root


def _key() -> Column:
    return F.col("n_nationkey")


def _name() -> Column:
    return F.col("n_name")


def _tree_path() -> Column:
    """A nation's file at the top, below its region, or deep below folders with odd names."""
    file = F.concat(_name(), F.lit(".txt"))
    return F.when(_key() % 3 == 0, file).when(_key() % 3 == 1, F.concat_ws("/", F.col("n_regionkey"), file)).otherwise(F.concat_ws("/", F.lit("a+b (c)/x.y/z"), _name()))


def _moved_path() -> Column:
    return F.concat_ws("/", F.when(_key() % 4 == 0, "quarantine").otherwise("kept"), _name())


def tree_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of a tree with size, digest and depth; some lie too deep."""
    root = _placed(_read(spark, sf_dir, "nation"), _tree_path(), _name(), "tree")
    return evidence.tree_files(spark, root, max_entries=100, max_depth=3)


def verified_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest's entries against the files: some missing, of another size or digest."""
    nations = _read(spark, sf_dir, "nation")
    root = _placed(nations.where(_key() % 5 != 3), _name(), _name(), "corpus")
    size = F.octet_length("n_name") + F.when(_key() % 5 == 1, 1).otherwise(0)
    digest = F.when(_key() % 5 == 2, F.repeat(F.lit("0"), F.lit(64))).otherwise(F.sha2("n_name", 256))
    entry = F.struct(_key().cast("string").alias("id"), _name().alias("path"), size.alias("size_bytes"), digest.alias("sha256"))
    whole = nations.agg(F.to_json(F.struct(F.collect_list(entry).alias("files"))).alias("doc"))
    listed = evidence.manifest(spark, _placed(whole, F.lit("manifest.json"), F.col("doc"), "manifest"))
    return evidence.verified_corpus(listed, evidence.tree_files(spark, root)).select("id", "path", "size", "error_code")


def unquarantined_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of a tree without its quarantined ones."""
    root = _placed(_read(spark, sf_dir, "nation"), _moved_path(), _name(), "corpus")
    return evidence.without_quarantined(evidence.tree_files(spark, root)).select("path", "size", "sha256")


def json_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as JSON that is sound, repeats a key, holds no finite number, is cut, too deep, too long or missing."""
    plain = F.concat(F.lit('"'), F.regexp_replace("text", '["\\\\\\x00-\\x1f]', ""), F.lit('"'))
    number = F.col("doc_id").cast("string")
    forms = [
        F.concat(F.lit('{"a":'), number, F.lit("}")), F.concat(F.lit('{"a":1,"b":'), number, F.lit(',"a":2}')), F.concat(F.lit('{"a":[NaN,'), number, F.lit("]}")),
        F.concat(F.lit('{"a":1e999,"b":'), number, F.lit("}")), F.concat(F.lit('{"a":'), number), F.concat(F.repeat(F.lit("["), F.lit(70)), number, F.repeat(F.lit("]"), F.lit(70))), plain,
    ]
    text = F.element_at(F.array(*forms), (F.col("doc_id") % 7 + 1).cast("int"))
    return _read(spark, sf_dir, "documents").select("doc_id", evidence.json_errors(max_bytes=2000)(text).alias("error_code"))


def strict_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON files by a declared schema; some repeat a key."""
    doc = F.concat(F.lit('{"a":'), _key().cast("string"), F.when(_key() % 6 == 5, F.lit(',"a":0}')).otherwise("}"))
    root = _placed(_read(spark, sf_dir, "nation"), F.concat(_key().cast("string"), F.lit(".json")), doc, "strict")
    found = evidence.strict_json(spark, root, "a int")
    return found.select(F.regexp_extract("path", r"([0-9]+)\.json\z", 1).cast("int").alias("n_nationkey"), F.col("doc.a").alias("a"), "error_code")


def document_schema_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as documents against a schema: place and keyword of what does not fit."""
    schema = {
        "type": "object", "required": ["key", "status"], "additionalProperties": False,
        "properties": {
            "key": {"type": "integer", "minimum": 10}, "status": {"enum": ["F", "O"]}, "tags": {"type": "array", "uniqueItems": True, "items": {"$ref": "#/$defs/tag"}},
            "when": {"anyOf": [{"type": "null"}, {"type": "string", "format": "date-time"}]},
        },
        "$defs": {"tag": {"type": "string", "maxLength": 4, "pattern": "^[0-9]"}},
    }
    key, status = F.col("o_orderkey"), F.col("o_orderstatus")
    extra = F.element_at(
        F.array(*map(F.lit, (',"tags":["1","2"]', ',"tags":["1","x"]', ',"tags":["1","1"]', ',"tags":["12345"]', ',"when":"2024-01-01"', ',"when":"2024-01-01T00:00:00Z"', ',"other":1'))), (key % 7 + 1).cast("int")
    )
    text = F.concat(F.lit('{"key":'), key.cast("string"), F.lit(',"status":"'), status, F.lit('"'), extra, F.lit("}"))
    return _read(spark, sf_dir, "orders").select("o_orderkey", schemas.schema_errors(schema)(text).alias("error_code"))


def page_store_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blobs named by their digest: some of another size, other bytes or a name that is no digest."""
    raw = F.unhex(F.md5("n_name"))
    name = F.when(_key() % 5 == 3, F.concat(F.lit("n"), _key().cast("string"))).otherwise(F.sha2(raw, 256))
    held = F.when(_key() % 5 == 1, F.concat(raw, F.lit(b"x"))).when(_key() % 5 == 2, F.unhex(F.md5("n_regionkey"))).otherwise(raw)
    root = _placed(_read(spark, sf_dir, "nation").withColumn("n_regionkey", F.col("n_regionkey").cast("string")), F.concat(name, F.lit(".bin")), held, "store")
    return evidence.page_store(spark, root, 16).select("sha256", F.octet_length("raw").alias("n_bytes"), "error_code")


def benchmark_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark cases and their estimates from a result tree, whose base folders are not read."""
    nations = _read(spark, sf_dir, "nation")
    n = (_key() * 64).cast("long")
    through = F.struct(F.when(_key() % 3 == 0, n).alias("Bytes"), F.when(_key() % 3 == 1, n).alias("Elements"))
    case = F.to_json(F.struct(F.col("n_regionkey").cast("string").alias("group_id"), F.lit("f").alias("function_id"), _key().cast("string").alias("value_str"), F.concat_ws("/", F.col("n_regionkey"), F.lit("f"), _key()).alias("full_id"), through.alias("throughput")))
    time = F.to_json(F.struct(F.struct((_key() + 0.5).cast("double").alias("point_estimate")).alias("median")))
    every = F.explode(F.array(*[F.struct(F.lit(f"{run}/{name}.json").alias("file"), doc.alias("doc")) for run in ("new", "base") for name, doc in (("benchmark", case), ("estimates", time))]))
    root = _placed(nations.select(_key(), every.alias("e")), F.concat_ws("/", _key(), F.col("e.file")), F.col("e.doc"), "bench")
    return evidence.benchmark_tree(spark, root)


def lcov_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as source files, their lines as covered lines, in LCOV reports that tasks write."""
    line = F.concat_ws(",", F.concat(F.lit("DA:"), F.col("l_linenumber").cast("string")), (F.col("l_quantity").cast("long") % 3).cast("string"))
    records = _read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.sort_array(F.collect_list(line)), "\n").alias("lines"))
    root = scratch(spark, "lcov")
    records.select(F.concat(F.lit("TN:\nSF:"), F.col("l_orderkey").cast("string"), F.lit("\n"), F.col("lines"), F.lit("\nend_of_record")).alias("value")).write.text(root)
    return evidence.lcov(spark, root)


def coverage_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as source files of coverage exports, a thousand an export."""
    size = F.col("p_size").cast("long")
    one = F.struct(F.col("p_partkey").cast("string").alias("filename"), F.struct(F.struct(size.alias("count"), (size % 7).alias("covered")).alias("lines")).alias("summary"))
    doc = F.struct(F.array(F.struct(F.collect_list(one).alias("files"))).alias("data"))
    return evidence.coverage_json(spark, _grouped(_read(spark, sf_dir, "part"), F.floor(F.col("p_partkey") / 1000), doc, "coverage"))


def mutant_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as mutants of a run's outcomes, a thousand a run; the baseline is no mutant."""
    summary = F.element_at(F.array(*map(F.lit, ("CaughtMutant", "MissedMutant", "Timeout", "Unviable"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    mutant = F.struct(F.col("p_brand").alias("file"), F.struct(F.col("p_name").alias("function_name")).alias("function"), F.struct(F.struct(F.col("p_partkey").alias("line")).alias("start")).alias("span"), F.col("p_type").alias("genre"))
    one = F.to_json(F.struct(F.struct(mutant.alias("Mutant")).alias("scenario"), summary.alias("summary")))
    rows = _read(spark, sf_dir, "part").groupBy(F.floor(F.col("p_partkey") / 1000).alias("part")).agg(F.array_join(F.collect_list(one), ",").alias("all"))
    root = scratch(spark, "mutants")
    baseline = '{"scenario":"Baseline","summary":"Success"}'
    rows.select("part", F.concat(F.lit(f'{{"outcomes":[{baseline},'), F.col("all"), F.lit("]}")).alias("value")).repartition("part").write.partitionBy("part").text(root)
    return evidence.mutant_outcomes(spark, root)


def classifier_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page kinds of each image as canonical JSON."""
    return sinks.classifier_json(text_pages(spark, sf_dir))


_SIGNED = [b"\0\0\0\0" + t for t in (b"Standard Jet DB", b"Jet System DB 1", b"Temp Jet DB xyz", b"Standard Jet DC")]


def _signed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as images behind a signature of each kind, or a near miss; every other one filled up to whole pages of 64 bytes."""
    start = F.element_at(F.array(*map(F.lit, _SIGNED)), (F.col("image_id") % 4 + 1).cast("int"))
    size = F.col("length") + 19
    fill = F.when(F.col("image_id") % 8 < 4, F.encode(F.repeat(F.lit("."), F.pmod(-size, F.lit(64)).cast("int")), "UTF-8")).otherwise(F.lit(b""))
    return text_images(spark, sf_dir).withColumn("content", F.concat(start, F.col("content"), fill)).withColumn("length", F.octet_length("content").cast("long"))


def probe_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a probe without a scan says of each image, as JSON."""
    found = decode.candidates(_signed(spark, sf_dir), page_size=64)
    rows = found.select("image_id", "length", "kind", F.col("page_count").alias("pages_visited"), F.lit(0).alias("work_units"), F.lit(None).cast("string").alias("fnv1a64"), "error_code")
    return sinks.probe_json(rows, 64)


def database_page_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page zero of each image with a known signature and whole pages, and whether it still has the signature."""
    found = decode.database_pages(_signed(spark, sf_dir), page_size=64)
    return found.select("image_id", "kind", "page_count", "error_code", F.sha2("raw", 256).alias("sha256"), "signature_unchanged")


def canonical_order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as canonical JSON lines: keys in order at every depth."""
    orders = _read(spark, sf_dir, "orders")
    nested = F.struct(F.col("o_totalprice").alias("b"), F.col("o_orderstatus").alias("a"), F.array(F.col("o_orderkey"), F.lit(None)).alias("0"))
    return sinks.canonical_lines(orders.select(nested.alias("nested"), F.col("o_orderkey").alias("key"), F.lit(None).cast("string").alias("none"))).select(F.col("value").alias("json"))


def written_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder written once and read back; the second write is refused."""
    rows, path = _read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), scratch(spark, "once")
    sinks.write_once(rows, path)
    try:
        sinks.write_once(rows.limit(0), path)
        refused = False
    except Exception as e:
        refused = "PATH_ALREADY_EXISTS" in str(e)
    return spark.read.parquet(path).withColumn("refused", F.lit(refused))


def published_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table published, then updated in place; an update that fails its validation changes nothing."""
    rows, path = _read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), scratch(spark, "published")
    sinks.publish(rows, path, validate=lambda df: df.count() == rows.count())
    sinks.update(spark, path, lambda df: df.withColumn("c_nationkey", F.col("c_nationkey") + 100), validate=lambda df: df.where("c_nationkey < 100").isEmpty())
    try:
        sinks.update(spark, path, lambda df: df.withColumn("c_nationkey", F.lit(0)), validate=lambda df: False)
        refused = False
    except ValueError:
        refused = True
    return spark.read.parquet(path).withColumn("refused", F.lit(refused))


def mask_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nation keys of each region as a bit mask in a file of its own, read back as images."""
    sets = _read(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.collect_list("n_nationkey").alias("offs"))
    root = scratch(spark, "masks")
    sinks.write_masks(sets.select(F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("name"), sinks.pack_bits("offs", F.lit(32)).alias("mask")), root)
    return images.binary_images(spark, root).select(F.regexp_extract("image_id", r"(r[0-9]+)\.bin\z", 1).alias("name"), "length", F.lower(F.hex("content")).alias("mask"))


def generated_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the generated probe images and byte runs."""
    made = generators.probe_images(spark, [0, 1, 2]).unionByName(generators.random_bytes(spark, [64, 4096]))
    return made.select("image_id", "length", F.sha2("content", 256).alias("sha256"))


def holdout_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands and types of small parts as frozen models, and whether large parts have them too."""
    parts = _read(spark, sf_dir, "part").select("p_brand", "p_type", "p_size")
    path = scratch(spark, "frozen")
    digest = checkpoints.freeze(parts.where("p_size < 20").select("p_brand", "p_type").distinct(), path)
    return checkpoints.holdout(path, digest, parts.where("p_size >= 20"), "p_brand", "p_type")


def tables_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as tables of a region's snapshot, in canonical order: the n-th row has the n-th place."""
    tables = _read(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("snapshot_id"), F.col("n_name").alias("name"))
    return _numbered(snapshot.sorted_tables(tables))


def columns_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as columns of a table, by ordinal."""
    columns = _read(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("snapshot_id"), F.col("l_orderkey").alias("table_name"), F.col("l_linenumber").alias("ordinal")).agg(F.count(F.lit(1)).alias("n"))
    return _numbered(snapshot.sorted_columns(columns))


def _numbered(ordered: DataFrame) -> DataFrame:
    """ordered as written and read in its order, with whether each row stands after its predecessor in the file."""
    rows = stored(ordered.withColumn("at", F.monotonically_increasing_id()), "sorted")
    return rows.drop("at").withColumn("ordered", F.lit(_rising(rows)))


def _rising(rows: DataFrame) -> bool:
    """Whether rows sorted by what they hold stand in the order in which they were written."""
    from pyspark.sql import Window

    keys = rows.columns[:2] if "ordinal" not in rows.columns else ["snapshot_id", "table_name", "ordinal"]
    within = Window.partitionBy("snapshot_id").orderBy(*keys[1:])
    return rows.withColumn("was", F.lag("at").over(within)).where("at < was").isEmpty()


def subtree_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two readings of parts whose differences below some parts are allowed as a whole, with lists of another length."""
    parts = _read(spark, sf_dir, "part")
    kinds = {"p_name": "text", "p_size": "long"}
    left = snapshot.flattened(snapshot.from_table(parts, "s", "part", F.col("p_partkey"), kinds))
    moved = parts.withColumn("p_size", F.when(F.col("p_partkey") % 5 == 2, F.col("p_size") + 1).otherwise(F.col("p_size")))
    right = snapshot.flattened(snapshot.from_table(moved, "s", "part", F.col("p_partkey"), kinds))
    lists = lambda n: parts.select(F.concat(F.lit("/keys/"), F.col("p_partkey").cast("string")).alias("path"), F.lit("array").alias("type"), n.cast("string").alias("value"))
    left, right = left.unionByName(lists(F.lit(3))), right.unionByName(lists(F.when(F.col("p_partkey") % 6 == 0, 4).otherwise(3)))
    allowed = parts.where("p_partkey % 10 in (1, 2)").select(F.concat(F.lit("/part/"), F.col("p_partkey").cast("string")).alias("path"))
    return snapshot.deep_diff(left, right, allowed)


QUERIES = {
    f.__name__: f
    for f in (
        tree_entries, verified_manifest, unquarantined_files, json_refusals, strict_files, document_schema_errors, page_store_files, benchmark_files, lcov_files, coverage_files, mutant_files,
        classifier_documents, probe_reports, database_page_zero, canonical_order_lines, written_once, published_table, mask_files, generated_images, holdout_models, tables_in_order,
        columns_in_order, subtree_diff,
    )
}

_FILE = """f AS (SELECT *, CASE n_nationkey % 3 WHEN 0 THEN n_name || '.txt' WHEN 1 THEN n_regionkey || '/' || n_name || '.txt' ELSE 'a+b (c)/x.y/z/' || n_name END AS path FROM nation)"""
_IMAGE = f"""{D}, s AS (SELECT image_id, ['Standard Jet DB', 'Jet System DB 1', 'Temp Jet DB xyz', 'Standard Jet DC'][(image_id % 4 + 1)::INT] AS sig, b, length + 19 AS n FROM d),
  t AS (SELECT *, CASE WHEN image_id % 8 < 4 THEN (64 - n % 64) % 64 ELSE 0 END AS fill FROM s),
  i AS (SELECT image_id, n + fill AS length, '00000000' || hex(encode(sig)) || hex(b) || repeat('2E', fill::BIGINT) AS h, CASE image_id % 4 WHEN 0 THEN 'standard' WHEN 1 THEN 'system' WHEN 2 THEN 'temporary' END AS kind FROM t),
  c AS (SELECT *, CASE WHEN length % 64 = 0 THEN length // 64 END AS page_count, CASE WHEN kind IS NULL THEN 'unrecognized_signature' WHEN length % 64 <> 0 THEN 'partial_page' END AS error_code FROM i)"""

SQL = {
    "tree_entries": f"WITH {_FILE} SELECT path, octet_length(encode(n_name)) AS size, sha256(n_name) AS sha256, len(string_split(path, '/')) AS depth, CASE WHEN len(string_split(path, '/')) > 3 THEN 'too_deep' END AS error_code FROM f",
    "verified_manifest": """SELECT n_nationkey::VARCHAR AS id, n_name AS path, octet_length(encode(n_name)) + (n_nationkey % 5 = 1)::INT AS size,
      CASE n_nationkey % 5 WHEN 1 THEN 'size_differs' WHEN 2 THEN 'digest_differs' WHEN 3 THEN 'missing_file' END AS error_code FROM nation""",
    "unquarantined_files": "SELECT 'kept/' || n_name AS path, octet_length(encode(n_name)) AS size, sha256(n_name) AS sha256 FROM nation WHERE n_nationkey % 4 <> 0",
    "json_refusals": r"""SELECT doc_id, CASE doc_id % 7 WHEN 1 THEN 'duplicate_key' WHEN 2 THEN 'malformed' WHEN 3 THEN 'malformed' WHEN 4 THEN 'malformed' WHEN 5 THEN 'too_deep'
      WHEN 6 THEN CASE WHEN text IS NULL THEN 'missing' WHEN octet_length(encode(regexp_replace(text, '["\\\x00-\x1f]', '', 'g'))) + 2 > 2000 THEN 'too_large' END END AS error_code FROM documents""",
    "strict_files": "SELECT n_nationkey, CASE WHEN n_nationkey % 6 <> 5 THEN n_nationkey END AS a, CASE WHEN n_nationkey % 6 = 5 THEN 'duplicate_key' END AS error_code FROM nation",
    "document_schema_errors": """SELECT o_orderkey, CASE WHEN o_orderkey < 10 THEN '$.key: minimum' WHEN o_orderstatus NOT IN ('F', 'O') THEN '$.status: enum' ELSE
      ['', '$.tags[1]: pattern', '$.tags: uniqueItems', '$.tags[0]: maxLength', '$.when: anyOf', '', '$.other: additionalProperties'][(o_orderkey % 7 + 1)::INT] END AS e,
      nullif(e, '') AS error_code FROM orders""",
    "page_store_files": """SELECT CASE WHEN n_nationkey % 5 = 3 THEN '' ELSE sha256(unhex(md5(n_name))) END AS sha256, 16 + (n_nationkey % 5 = 1)::INT AS n_bytes,
      CASE n_nationkey % 5 WHEN 1 THEN 'bad_size' WHEN 2 THEN 'digest_differs' WHEN 3 THEN 'bad_name' END AS error_code FROM nation""",
    "benchmark_files": """SELECT n_regionkey || '/f/' || n_nationkey AS full_id, n_regionkey::VARCHAR AS group_id, CASE n_nationkey % 3 WHEN 0 THEN 'Bytes' WHEN 1 THEN 'Elements' END AS unit,
      CASE WHEN n_nationkey % 3 < 2 THEN n_nationkey::BIGINT * 64 END AS quantity, n_nationkey + 0.5::DOUBLE AS median_ns FROM nation""",
    "lcov_files": "SELECT l_orderkey::VARCHAR AS file, count(*) FILTER (trunc(l_quantity)::BIGINT % 3 <> 0) AS covered, count(*) AS total FROM lineitem GROUP BY 1",
    "coverage_files": "SELECT p_partkey::VARCHAR AS file, (p_size % 7)::BIGINT AS covered, p_size::BIGINT AS total FROM part",
    "mutant_files": "SELECT p_brand AS file, p_partkey AS line, p_name AS function, p_type AS genre, ['killed', 'survived', 'timeout', 'unviable'][(p_partkey % 4 + 1)::INT] AS status FROM part",
    "classifier_documents": f"""WITH {P}, k AS (SELECT image_id, {KIND} AS kind, v FROM (SELECT image_id, page, {byte_of('x', 0)} AS v FROM p)), n AS (SELECT image_id, kind, CASE WHEN kind = 'unknown' THEN v END AS v, count(*) AS n FROM k GROUP BY ALL),
      s AS (SELECT image_id, coalesce(string_agg('"' || v || '":' || n, ',' ORDER BY v) FILTER (kind = 'unknown'), '') AS unknown, sum(n)::BIGINT AS total, """
    + ", ".join(f"coalesce(sum(n) FILTER (kind = '{k}'), 0)::BIGINT AS {k}" for k in ("data", "database_definition", "extended_usage_bitmap", "intermediate_index", "leaf_index", "table_definition"))
    + """ FROM n GROUP BY image_id)
      SELECT image_id, '{"data":' || data || ',"database_definition":' || database_definition || ',"extended_usage_bitmap":' || extended_usage_bitmap || ',"intermediate_index":' || intermediate_index
        || ',"leaf_index":' || leaf_index || ',"page_count":' || total || ',"table_definition":' || table_definition || ',"unknown":{' || unknown || '}}' AS json FROM s""",
    "probe_reports": f"""WITH {_IMAGE} SELECT image_id, CASE WHEN error_code IS NULL THEN '{{"schema_version":1,"ok":true,"signature_kind":"' || kind || '","candidate_geometry":{{"page_size_bytes":64,"page_count":' || page_count
      || ',"source_length_bytes":' || length || '}},"raw_scan":null,"caveats":["generic_signature_only","jet_generation_not_identified","encryption_state_not_inspected","database_structure_not_validated","compatibility_not_established"]}}'
      ELSE '{{"schema_version":1,"ok":false,"error":"' || error_code || '","compatibility_established":false}}' END AS json FROM c""",
    "database_page_zero": f"""WITH {_IMAGE} SELECT image_id, kind, page_count, error_code, CASE WHEN error_code IS NULL THEN sha256(unhex(left(h, 128))) END AS sha256, CASE WHEN error_code IS NULL THEN true END AS signature_unchanged FROM c""",
    "canonical_order_lines": """SELECT '{"key":' || o_orderkey || ',"nested":{"0":[' || o_orderkey || ',null],"a":"' || o_orderstatus || '","b":' || o_totalprice || '},"none":null}' AS json FROM orders""",
    "written_once": "SELECT c_custkey, c_mktsegment, true AS refused FROM customer",
    "published_table": "SELECT c_custkey, c_nationkey + 100 AS c_nationkey, true AS refused FROM customer",
    "mask_files": """WITH m AS (SELECT n_regionkey, sum(1::BIGINT << n_nationkey)::BIGINT AS m FROM nation GROUP BY 1)
      SELECT 'r' || n_regionkey AS name, 4::BIGINT AS length, printf('%02x%02x%02x%02x', m & 255, (m >> 8) & 255, (m >> 16) & 255, (m >> 24) & 255) AS mask FROM m""",
    "generated_images": """WITH p AS (SELECT n, CASE WHEN n = 0 THEN '' ELSE '00000000' || hex(encode('Standard Jet DB')) || (SELECT string_agg(printf('%02X', i % 251), '' ORDER BY i) FROM range(19, 2048 * 2) t(i) WHERE i < 2048 * n) END AS h FROM range(0, 3) u(n)),
      b AS (SELECT n, (SELECT string_agg(printf('%02X', ((i::HUGEINT * 11400714819323198485) % 18446744073709551616 // 140737488355328 % 256)::INT), '' ORDER BY i) FROM range(0, 4096) t(i) WHERE i < n) AS h FROM (VALUES (64), (4096)) u(n))
      SELECT 'probe-' || n AS image_id, n * 2048 AS length, sha256(unhex(h)) AS sha256 FROM p UNION ALL SELECT 'bytes-' || n, n, sha256(unhex(h)) FROM b""",
    "holdout_models": """WITH a AS (SELECT DISTINCT p_brand, p_type FROM part WHERE p_size < 20), b AS (SELECT DISTINCT p_brand, p_type FROM part WHERE p_size >= 20)
      SELECT p_brand, p_type, (p_brand, p_type) IN (SELECT (p_brand, p_type) FROM b) AS held FROM a""",
    "tables_in_order": "SELECT n_regionkey AS snapshot_id, n_name AS name, true AS ordered FROM nation",
    "columns_in_order": "SELECT l_returnflag AS snapshot_id, l_orderkey AS table_name, l_linenumber AS ordinal, count(*) AS n, true AS ordered FROM lineitem GROUP BY 1, 2, 3",
    "subtree_diff": """WITH p AS (SELECT p_partkey AS k, p_partkey % 5 = 2 AS moved, p_partkey % 10 IN (1, 2) AS allowed FROM part)
      SELECT '/part/' || k || '/p_size' AS path, 'value_difference' AS error_code FROM p WHERE moved AND NOT allowed
      UNION ALL SELECT '/part/' || k, 'allowed_difference_not_observed' FROM p WHERE allowed AND NOT moved UNION ALL SELECT '/keys/' || k, 'length_difference' FROM p WHERE k % 6 = 0""",
}
SQL["document_schema_errors"] = f"SELECT o_orderkey, error_code FROM ({SQL['document_schema_errors']})"
