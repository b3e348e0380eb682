"""Writers: staged publication and update, canonical JSON, probe reports, write-once folders, blob stores, byte patches."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import canonical_double, canonical_numbers, canonical_single, json_string
from ..operators.census import kind_snapshot, new_blobs
from .images import PAGE_SIZE

#: The stages that a hook is told, in order.
STAGES = ("stage", "copy", "validate", "publish", "confirm")
UPDATE_STAGES = ("stage", "copy", "mutate", "metadata", "validate", "sync", "ready", "publish", "confirm")

#: What a probe does not claim.
CAVEATS = ("generic_signature_only", "jet_generation_not_identified", "encryption_state_not_inspected", "database_structure_not_validated", "compatibility_not_established")


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def publish(df: DataFrame, path: str, *, validate: Callable[[DataFrame], bool], hook: Callable[[str], None] = lambda stage: None) -> None:
    """Write beside the target, read back, validate, and move into place by one rename.

    A target that exists is never replaced; whatever fails, the staged files go
    and the target stays as it was.  ``hook`` is told each stage, for fault tests.
    """
    spark = df.sparkSession
    staged = f"{path.rstrip('/')}.staged"
    fs, target = _fs(spark, path)
    _, temp = _fs(spark, staged)
    try:
        hook("stage")
        if fs.exists(target):
            raise FileExistsError(path)
        fs.delete(temp, True)
        hook("copy")
        df.write.mode("errorifexists").parquet(staged)
        hook("validate")
        if not validate(spark.read.parquet(staged)):
            raise ValueError("validation failed")
        hook("publish")
        if fs.exists(target) or not fs.rename(temp, target):
            raise FileExistsError(path)
        hook("confirm")
    finally:
        fs.delete(temp, True)


def update(spark: SparkSession, path: str, mutate: Callable[[DataFrame], DataFrame], *, validate: Callable[[DataFrame], bool], max_bytes: int | None = None, hook: Callable[[str], None] = lambda stage: None) -> None:
    """Replace a table that exists by mutate() of itself, written beside it and validated first.

    A target above max_bytes is refused before anything is written.  The new
    folder gets the old one's permissions and must hold the writer's mark of a
    whole job.  A failure before publication is told to ``hook`` as cleanup: the
    staged folder goes and the target stays as it was.  Folders cannot be
    exchanged by one rename, so the old one is kept as ``.previous`` in between,
    is put back if the second rename fails, and is found there by the next
    update if this process dies.
    """
    base = path.rstrip("/")
    staged = f"{base}.staged"
    fs, target = _fs(spark, base)
    _, temp = _fs(spark, staged)
    _, previous = _fs(spark, f"{base}.previous")
    if fs.exists(previous) and not fs.exists(target):
        fs.rename(previous, target)
    if not fs.exists(target):
        raise FileNotFoundError(path)
    try:
        hook("stage")
        fs.delete(temp, True)
        hook("copy")
        if max_bytes is not None and fs.getContentSummary(target).getLength() > max_bytes:
            raise ValueError("copy_limit_exceeded")
        hook("mutate")
        mutate(spark.read.parquet(base)).write.mode("errorifexists").parquet(staged)
        hook("metadata")
        fs.setPermission(temp, fs.getFileStatus(target).getPermission())
        hook("validate")
        if not validate(spark.read.parquet(staged)):
            raise ValueError("validation failed")
        hook("sync")
        if not fs.exists(_fs(spark, f"{staged}/_SUCCESS")[1]):
            raise OSError("staged folder is not whole")
        hook("ready")
        hook("publish")
        fs.delete(previous, True)
        if not fs.rename(target, previous):
            raise OSError("publication failed")
        if not fs.rename(temp, target):
            fs.rename(previous, target)
            raise OSError("publication failed")
    except BaseException:
        hook("cleanup")
        fs.delete(temp, True)
        raise
    hook("confirm")
    fs.delete(previous, True)


def write_once(df: DataFrame, path: str) -> None:
    """A folder that a second write refuses."""
    df.write.mode("errorifexists").parquet(path)


def canonical_lines(df: DataFrame) -> DataFrame:
    """Rows as canonical JSON lines: keys sorted at every depth, nulls kept, no spaces, numbers in their shortest spelling.

    Not a number and infinities fail the query.  Floats may stand in structs and
    in arrays of floats, not within other collections (their spelling is a pandas
    function, which SQL lambdas can't call).
    """
    return df.select(_canonical(F.struct(*[F.col(f"`{c}`") for c in df.columns]), df.schema).alias("value"))


def _canonical(c: Column, kind: T.DataType, inside: bool = False) -> Column:
    refused = F.raise_error(F.lit("not_finite")).cast("string")
    if isinstance(kind, T.StructType):
        fields = [F.concat(json_string(F.lit(f.name)), F.lit(":"), _canonical(c.getField(f.name), f.dataType, inside)) for f in sorted(kind.fields, key=lambda f: f.name)]
        text = F.concat(F.lit("{"), F.concat_ws(",", *fields), F.lit("}"))
    elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FractionalType) and not isinstance(kind.elementType, T.DecimalType) and not inside:
        name = "single" if isinstance(kind.elementType, T.FloatType) else "double"
        spelled = canonical_numbers(F.transform(c, lambda x: F.lit(name)), F.transform(c, lambda x: x.cast("string")))
        both = F.transform(F.arrays_zip(c.alias("x"), spelled.alias("s")), lambda z: F.when(z["x"].isNull(), "null").otherwise(F.coalesce(z["s"], refused)))
        text = F.concat(F.lit("["), F.array_join(both, ","), F.lit("]"))
    elif isinstance(kind, T.ArrayType):
        text = F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: _canonical(x, kind.elementType, True)), ","), F.lit("]"))
    elif isinstance(kind, T.MapType):
        entry = lambda e: F.concat(json_string(e["key"].cast("string")), F.lit(":"), _canonical(e["value"], kind.valueType, True))
        text = F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(F.map_entries(c)), entry), ","), F.lit("}"))
    elif isinstance(kind, T.FloatType | T.DoubleType):
        if inside:
            raise ValueError("floats within collections have no canonical spelling here")
        text = F.coalesce(canonical_single(c) if isinstance(kind, T.FloatType) else canonical_double(c), refused)
    elif isinstance(kind, T.NumericType | T.BooleanType | T.NullType):
        text = c.cast("string")
    elif isinstance(kind, T.BinaryType):
        text = json_string(F.base64(c))
    else:
        text = json_string(c.cast("string"))
    return F.when(c.isNull(), "null").otherwise(text)


def classifier_json(pages: DataFrame) -> DataFrame:
    """(image_id, json) of each image's page kinds: sorted keys, unknown first bytes in numeric order."""
    snap = kind_snapshot(pages)
    named = ["data", "database_definition", "extended_usage_bitmap", "intermediate_index", "leaf_index", "table_definition"]
    number = lambda c: F.concat(F.lit(f'"{c}":'), F.col(c).cast("string"))
    unknown = F.concat(F.lit('"unknown":{'), F.array_join(F.transform("unknown", lambda u: F.concat(F.lit('"'), u["tag"].cast("string"), F.lit('":'), u["n_pages"].cast("string"))), ","), F.lit("}"))
    body = F.concat_ws(",", number(named[0]), number(named[1]), number(named[2]), number(named[3]), number(named[4]), number("page_count"), number(named[5]), unknown)
    return snap.select("image_id", F.concat(F.lit("{"), body, F.lit("}")).alias("json"))


def error_json(code: Column) -> Column:
    """What a user sees of a refusal."""
    return F.concat(F.lit('{"schema_version":1,"ok":false,"error":'), json_string(code), F.lit(',"compatibility_established":false}'))


def probe_json(probed: DataFrame, page_size: int = PAGE_SIZE) -> DataFrame:
    """(image_id, json) of probe(): signature, geometry, the raw scan (null where no digest was taken) and caveats, or the error."""
    text = lambda key, value: F.concat(F.lit(f'"{key}":'), value)
    number = lambda key, value: text(key, value.cast("string"))
    braces = lambda *parts: F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))
    pages, size = F.col("pages_visited"), F.col("pages_visited") * page_size
    shape = braces(number("page_size_bytes", F.lit(page_size)), number("page_count", pages), number("source_length_bytes", F.col("length")))
    scan = braces(
        F.lit('"checksum_algorithm":"fnv1a64"'), text("checksum_hex", json_string(F.col("fnv1a64"))), number("pages_read", pages), number("bytes_read", size), number("hash_work_units", size),
        number("total_work_units", F.col("work_units")),
    )
    scan = F.when(F.col("fnv1a64").isNull(), "null").otherwise(scan)
    caveats = "[" + ",".join(f'"{c}"' for c in CAVEATS) + "]"
    good = braces(F.lit('"schema_version":1'), F.lit('"ok":true'), text("signature_kind", json_string(F.col("kind"))), text("candidate_geometry", shape), text("raw_scan", scan), F.lit(f'"caveats":{caveats}'))
    return probed.select("image_id", F.when(F.col("error_code").isNull(), good).otherwise(error_json(F.col("error_code"))).alias("json"))


def add_blobs(pages: DataFrame, store: DataFrame, path: str, max_blobs: int) -> int:
    """Append the blobs that the store lacks, unless that would pass its ceiling; returns how many."""
    fresh = new_blobs(pages, store)
    n_new, n_old = fresh.count(), store.count()
    if n_new + n_old > max_blobs:
        raise ValueError("blob_ceiling")
    fresh.select("sha256", "raw").write.mode("append").parquet(path)
    return n_new


def patched(content: Column, at: Column, new: Column) -> Column:
    """content with bytes written over at a place; null where they would not fit: images have a fixed size."""
    size = F.octet_length(new)
    fits = (at >= 0) & (at + size <= F.octet_length(content))
    return F.when(fits, F.concat(F.substring(content, F.lit(1), at.cast("int")), new, F.substring(content, (at + size + 1).cast("int"), F.lit(2**31 - 1))))


def write_files(rows: DataFrame, root: str) -> None:
    """(path, content) as one named file a row below a shared folder; a file that exists is never written over.

    The driver writes them one by one: for reports, manifests and masks, of which
    there are few and each is of bounded size.
    """
    spark = rows.sparkSession
    for row in rows.select("path", "content").toLocalIterator():
        fs, target = _fs(spark, f"{root.rstrip('/')}/{row['path']}")
        out = fs.create(target, False)
        out.write(bytearray(row["content"]))
        out.close()


def write_masks(masks: DataFrame, path: str) -> None:
    """(name, mask) as one file a mask."""
    write_files(masks.select(F.concat("name", F.lit(".bin")).alias("path"), F.col("mask").alias("content")), path)


@F.pandas_udf(T.BinaryType())
def pack_bits(offsets: pd.Series, length: pd.Series) -> pd.Series:
    """Arrays of offsets as bit masks of so many bits, lowest bit first."""
    out = []
    for own, n in zip(offsets, length, strict=True):
        mask = bytearray((int(n) + 7) // 8)
        for o in own:
            mask[o >> 3] |= 1 << (o & 7)
        out.append(bytes(mask))
    return pd.Series(out, dtype=object)
