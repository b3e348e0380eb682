"""Typed table snapshots: value checks, canonical order, canonical JSON, deep comparison.

Relations: rows (snapshot_id, table_name, canonical_key, values MAP<STRING,
STRUCT<kind, value, raw_hex, code_page>>), columns, indexes, relationships.
Semantic values are kept as text and read by kind.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import canonical_double, canonical_numbers, canonical_single, has_shape, json_string, pointer_token

#: The kinds of a typed value.
KINDS = ("null", "boolean", "byte", "integer", "long", "single", "double", "decimal", "currency", "datetime", "text", "memo", "binary", "ole", "guid")
#: Ranges of the whole-number kinds.
RANGES = {"byte": (0, 255), "integer": (-32768, 32767), "long": (-2147483648, 2147483647)}

TYPED_VALUE = "struct<kind string, value string, raw_hex string, code_page int>"
ROWS = f"snapshot_id string, table_name string, canonical_key string, values map<string, {TYPED_VALUE}>"


def value_error(kind: Column, value: Column, code_page: Column | None = None) -> Column:
    """What is wrong with a typed value, or null."""
    code = F.when(~kind.isin(*KINDS) | kind.isNull(), "unknown_kind")
    code = code.when((kind == "null") & value.isNotNull(), "null_has_value").when((kind != "null") & value.isNull(), "missing_value")
    code = code.when((kind == "boolean") & ~value.isin("true", "false"), "not_boolean")
    whole = F.when(value.rlike(r"^-?[0-9]{1,18}\z"), value.cast("long"))
    for name, (low, high) in RANGES.items():
        code = code.when((kind == name) & ~F.coalesce(whole.between(low, high), F.lit(False)), "out_of_range")
    number = value.try_cast("double")
    finite = F.coalesce(~F.isnan(number) & (F.abs(number) != float("inf")), F.lit(False))
    code = code.when(kind.isin("single", "double") & ~finite, "not_finite")
    code = code.when((kind == "single") & (F.abs(number) > 3.4028234663852886e38), "not_finite")
    code = code.when(kind.isin("decimal", "currency") & ~has_shape(value, "decimal"), "not_decimal")
    code = code.when((kind == "datetime") & ~has_shape(value, "datetime"), "not_datetime")
    code = code.when(kind.isin("binary", "ole") & ~has_shape(value, "hex"), "not_hex")
    code = code.when((kind == "guid") & ~has_shape(value, "guid"), "not_guid")
    if code_page is not None:
        code = code.when(code_page.isNotNull() & ~kind.isin("text", "memo"), "code_page_not_allowed")
    return code


def semantic_json(kind: Column, value: Column) -> Column:
    """A typed value's JSON spelling."""
    return (
        F.when(kind == "null", "null")
        .when(kind.isin("boolean", *RANGES), value)
        .when(kind == "single", canonical_single(value.try_cast("double")))
        .when(kind == "double", canonical_double(value.try_cast("double")))
        .otherwise(json_string(value))
    )


def named_order(rows: DataFrame, *keys: str, name: str = "name", position: str = "position") -> DataFrame:
    """rows with error_code: a name before its predecessor is out of order, an equal one a duplicate."""
    before = F.lag(name).over(Window.partitionBy(*keys).orderBy(position))
    return rows.withColumn("error_code", F.when(before > F.col(name), "non_canonical_order").when(before == F.col(name), "duplicate"))


def sorted_tables(tables: DataFrame) -> DataFrame:
    """Canonical order of tables, indexes or relationships: by name, in code points."""
    return tables.orderBy("snapshot_id", "name")


def sorted_columns(columns: DataFrame) -> DataFrame:
    return columns.orderBy("snapshot_id", "table_name", "ordinal")


def values_json(values: Column) -> Column:
    """A row's values as canonical JSON: keys sorted, no spaces, a value's own fields sorted too."""
    entries = F.array_sort(F.map_entries(values))
    numbers = canonical_numbers(F.transform(entries, lambda e: e["value"]["kind"]), F.transform(entries, lambda e: e["value"]["value"]))

    def one(z: Column) -> Column:
        e, v = z["entry"], z["entry"]["value"]
        page = F.when(v["code_page"].isNotNull(), F.concat(F.lit('"code_page":'), v["code_page"].cast("string"), F.lit(","))).otherwise("")
        raw = F.when(v["raw_hex"].isNotNull(), F.concat(F.lit('"raw_hex":'), json_string(v["raw_hex"]), F.lit(","))).otherwise("")
        plain = F.when(v["kind"] == "null", "null").when(v["kind"].isin("boolean", *RANGES), v["value"]).when(v["kind"].isin("single", "double"), z["number"]).otherwise(json_string(v["value"]))
        return F.concat(json_string(e["key"]), F.lit(":{"), page, F.lit('"kind":'), json_string(v["kind"]), F.lit(","), raw, F.lit('"value":'), plain, F.lit("}"))

    return F.concat(F.lit("{"), F.array_join(F.transform(F.arrays_zip(entries.alias("entry"), numbers.alias("number")), one), ","), F.lit("}"))


def ordered_rows(rows: DataFrame, canonical: Column) -> DataFrame:
    """rows with position: by key, then by canonical JSON; repeats stay, in a table of their own order."""
    order = Window.partitionBy("snapshot_id", "table_name").orderBy("canonical_key", "canon")
    return rows.withColumn("canon", canonical).withColumn("position", F.row_number().over(order))


def row_order(rows: DataFrame) -> DataFrame:
    """Rows that stand before their predecessor by key and canonical JSON (equal ones may repeat)."""
    order = Window.partitionBy("snapshot_id", "table_name").orderBy("position")
    before, now = F.lag(F.struct("canonical_key", "canon")).over(order), F.struct("canonical_key", "canon")
    return rows.withColumn("error_code", F.when(before > now, "non_canonical_order"))


def sorted_map(values: Column) -> Column:
    return F.map_from_entries(F.array_sort(F.map_entries(values)))


def unique_digests(fixtures: DataFrame, digest: str = "sha256") -> DataFrame:
    """Fixtures by digest; an equal digest is a refusal."""
    n = F.count(F.lit(1)).over(Window.partitionBy(digest))
    return fixtures.withColumn("error_code", F.when(n > 1, "duplicate")).orderBy(digest)


def flattened(rows: DataFrame, canonical_only: bool = False) -> DataFrame:
    """(path, type, value) of every value of a snapshot's rows, the path a JSON pointer."""
    one = rows.select("table_name", "canonical_key", F.explode("values").alias("column", "v"))
    path = F.concat(F.lit("/"), pointer_token(F.col("table_name")), F.lit("/"), pointer_token(F.col("canonical_key")), F.lit("/"), pointer_token(F.col("column")))
    return one.select(path.alias("path"), F.col("v.kind").alias("type"), F.col("v.value").alias("value"))


def deep_diff(left: DataFrame, right: DataFrame, allowed: DataFrame) -> DataFrame:
    """(path, error_code): unexpected differences, and allowed ones that were not seen.

    left and right: (path, type, value); allowed: (path), of a value or of all
    that lies below it.  Differing keys come before differing types, those before
    lengths (of rows of type array, whose value is their length) and values.  An
    allowance must see a difference; one below another is never looked at.  Only
    differences are dealt by the paths above them.
    """
    a = left.select("path", F.col("type").alias("lt"), F.col("value").alias("lv"), F.lit(True).alias("in_left"))
    b = right.select("path", F.col("type").alias("rt"), F.col("value").alias("rv"), F.lit(True).alias("in_right"))
    both = a.join(b, "path", "full")
    same_type = F.col("lt").eqNullSafe(F.col("rt"))
    code = (
        F.when(F.col("in_left").isNull() | F.col("in_right").isNull(), "key_difference")
        .when(~same_type, "type_difference")
        .when(~F.col("lv").eqNullSafe(F.col("rv")), F.when(F.col("lt") == "array", "length_difference").otherwise("value_difference"))
    )
    differ = both.select("path", code.alias("error_code")).where("error_code is not null")
    tokens = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(tokens)), lambda n: F.array_join(F.slice(tokens, F.lit(1), n), "/"))
    given = allowed.select(F.col("path").alias("above")).distinct()
    met = differ.select("path", F.explode(above).alias("above")).join(given, "above").groupBy("path").agg(F.min_by("above", F.length("above")).alias("above"))
    unseen = given.join(met.select("above").distinct(), "above", "left_anti").select(F.col("above").alias("path"), F.lit("allowed_difference_not_observed").alias("error_code"))
    return differ.join(met.select("path"), "path", "left_anti").unionByName(unseen)


def from_table(table: DataFrame, snapshot: str, name: str, key: Column, kinds: dict[str, str]) -> DataFrame:
    """A plain table read into snapshot rows: key as text, every column a typed value."""
    one = lambda c, k: F.struct(
        F.when(F.col(c).isNull(), "null").otherwise(k).alias("kind"), F.col(c).cast("string").alias("value"), F.lit(None).cast("string").alias("raw_hex"), F.lit(None).cast("int").alias("code_page")
    )
    entries = [x for c, k in kinds.items() for x in (F.lit(c), one(c, k))]
    return table.select(F.lit(snapshot).alias("snapshot_id"), F.lit(name).alias("table_name"), key.cast("string").alias("canonical_key"), F.create_map(*entries).alias("values"))


def scan_matches(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """Rows (id, error_code) where an ordered scan and the expected rows differ: missing, unexpected, or another payload."""
    a = actual.select("id", F.col("payload").alias("got"), F.lit(True).alias("has"))
    b = expected.select("id", F.col("payload").alias("want"), F.lit(True).alias("wanted"))
    both = a.join(b, "id", "full")
    code = F.when(F.col("has").isNull(), "missing_row").when(F.col("wanted").isNull(), "unexpected_row").when(~F.col("got").eqNullSafe(F.col("want")), "payload_differs")
    return both.select("id", code.alias("error_code")).where("error_code is not null")
