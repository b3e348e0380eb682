"""Text forms that evidence files share: float spelling, pointers, names, paths, times."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Anchored shapes of the closed text kinds.
SHAPES = {
    "sha256": r"^[0-9a-f]{64}\z",
    "hex": r"^(?:[0-9a-f]{2})*\z",
    "guid": r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\z",
    "decimal": r"^-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?\z",
    "datetime": r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(?:\.[0-9]+)?\z",
    "commit": r"^[0-9a-f]{40}\z",
    "scenario_id": r"^DAO-(?:GEN|READ|WRITE|UPDATE)-[A-Z0-9][A-Z0-9_-]{2,63}\z",
}


def has_shape(value: Column, shape: str) -> Column:
    """Whether a text has one of the SHAPES; a time's parts are not tested for range."""
    return F.coalesce(value.rlike(SHAPES[shape]), F.lit(False))


def _spell(x: float | None, single: bool) -> str | None:
    if x is None or x != x or x in (float("inf"), float("-inf")):
        return None
    if not single:
        return repr(float(x))
    import numpy as np

    digits = np.format_float_scientific(np.float32(x), unique=True, trim="-", exp_digits=1)
    mantissa, exponent = digits.split("e")
    if -4 <= int(exponent) < 16:
        fixed = np.format_float_positional(np.float32(x), unique=True, trim="0")
        return fixed
    return f"{mantissa}e{exponent[0] if exponent[0] in '+-' else '+'}{abs(int(exponent)):02d}"


@F.pandas_udf(T.StringType())
def canonical_double(value: pd.Series) -> pd.Series:
    """Shortest text that reads back: fixed for exponents -4 to 15, else mantissa and a signed exponent of two digits or more."""
    return value.map(lambda x: _spell(x, False))


@F.pandas_udf(T.StringType())
def canonical_single(value: pd.Series) -> pd.Series:
    return value.map(lambda x: _spell(x, True))


@F.pandas_udf(T.ArrayType(T.StringType()))
def canonical_numbers(kinds: pd.Series, values: pd.Series) -> pd.Series:
    """Of arrays of kinds and values the canonical text of singles and doubles, null for others."""
    spell = lambda k, v: _spell(float(v), k == "single") if k in ("single", "double") and v is not None else None
    return pd.Series([None if ks is None else [spell(k, v) for k, v in zip(ks, vs, strict=True)] for ks, vs in zip(kinds, values, strict=True)])


def pointer_token(value: Column) -> Column:
    """A key as a token of a JSON pointer."""
    return F.replace(F.replace(value, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))


def json_string(value: Column) -> Column:
    """A quoted JSON string: quote, backslash and control characters escaped, all else as it is."""
    out = F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    short = {8: "\\b", 9: "\\t", 10: "\\n", 12: "\\f", 13: "\\r"}
    for code in range(32):
        out = F.replace(out, F.lit(chr(code)), F.lit(short.get(code, f"\\u{code:04x}")))
    return F.concat(F.lit('"'), out, F.lit('"'))


def payload(role: Column, row_id: Column, width: int = 240) -> Column:
    """A row's payload: a token of role and id, repeated to the width."""
    token = F.concat(F.lit("A1|"), role, F.lit("|"), row_id.cast("string"), F.lit("|"))
    return F.substring(F.repeat(token, F.ceil(F.lit(width) / F.length(token)).cast("int")), 1, width)


def throughput(quantity: Column, median_ns: Column, unit: Column) -> Column:
    """Quantity a second for the units Bytes and Elements; null for others or without time."""
    return F.when(unit.isin("Bytes", "Elements") & (median_ns > 0), quantity * F.lit(1e9) / median_ns)


def case_id(group_id: Column, full_id: Column) -> Column:
    return F.concat(group_id, F.lit("--"), F.upper(F.substring(F.sha2(full_id.cast("binary"), 256), 1, 16)))


def safe_path(path: Column) -> Column:
    """A relative path with forward slashes, without empty, . or .. parts."""
    parts = F.split(path, "/", -1)
    odd = F.exists(parts, lambda p: p.isin("", ".", ".."))
    return F.coalesce((F.length(path) > 0) & ~path.contains("\\") & ~path.rlike(r"^[A-Za-z]:") & ~odd, F.lit(False))


def utc_time(text: Column) -> Column:
    """A time that says it is UTC, as a timestamp; null if it does not."""
    says = text.rlike(r"(?:Z|\+00:00)\z")
    return F.when(says, F.try_to_timestamp(F.regexp_replace(text, r"(?:Z|\+00:00)\z", "Z")))


#: What logs say.
SANITIZER = ("ERROR: AddressSanitizer", "ERROR: MemorySanitizer", "ERROR: LeakSanitizer", "ERROR: ThreadSanitizer", "runtime error:")
LIMIT = ("out-of-memory", "rss limit exceeded", "libFuzzer: timeout")
PANIC = ("panicked at", "thread '", 'thread "')
PROGRESS, RSS = r"(?m)^#(\d+)\s", r"\brss:\s*(\d+)Mb\b"


def plain_log(log: Column) -> Column:
    """A log without terminal colour codes."""
    return F.regexp_replace(log, "\x1b\\[[0-9;]*m", "")


def largest_number(log: Column, pattern: str) -> Column:
    """The largest number that group 1 of the pattern finds in a log; null where none."""
    return F.array_max(F.transform(F.regexp_extract_all(plain_log(log), F.lit(pattern), F.lit(1)), lambda x: x.cast("long")))


def log_result(log: Column, exit_code: Column, timed_out: Column) -> Column:
    """What a run came to; the first that holds of hang, finding, limit, panic, then clean or crash by exit code."""
    plain = plain_log(log)
    some = lambda words: F.coalesce(F.greatest(F.lit(False), *[plain.contains(w) for w in words]), F.lit(False))
    return (
        F.when(timed_out, "hang")
        .when(some(SANITIZER), "sanitizer_finding")
        .when(some(LIMIT), "limit_exceeded")
        .when(some(PANIC[:1]) | some(PANIC) & some(("stack backtrace:",)), "panic")
        .when(exit_code == 0, "clean")
        .otherwise("crash")
    )
