"""probe <file> [--max-input-bytes N] [--scan-pages --max-scan-bytes N --max-pages N]

Prints one JSON line; exit codes: 0 done, 1 refused, 2 wrong use, 74 no output.
"""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators.census import probe, scan_ceiling
from .operators.decode import candidates
from .sources.images import PAGE_SIZE, binary_images
from .sources.sinks import probe_json

LIMIT_OPTIONS = ("--max-input-bytes", "--max-scan-bytes", "--max-pages")


class Usage(Exception):
    """Wrong arguments; the text is the error code."""


def parse(args: list[str]) -> dict:
    """Options of a command line, or Usage with a stable code."""
    if not args or args[0] in ("--help", "--version") and len(args) > 1 or args[0] not in ("probe", "--help", "--version"):
        raise Usage("unexpected_argument" if args and args[0] in ("--help", "--version") else "unknown_command")
    if args[0] != "probe":
        return {"command": args[0]}
    if len(args) < 2 or args[1].startswith("--"):
        raise Usage("missing_file")
    out: dict = {"command": "probe", "file": args[1], "scan": False}
    rest = args[2:]
    while rest:
        option = rest.pop(0)
        if option in out or option == "--scan-pages" and out["scan"]:
            raise Usage("duplicate_option")
        if option == "--scan-pages":
            out["scan"] = True
        elif option in LIMIT_OPTIONS:
            if not rest:
                raise Usage("missing_option_value")
            value = rest.pop(0)
            if not (value.isascii() and value.isdigit() and int(value) > 0):
                raise Usage("invalid_limit")
            out[option] = int(value)
        elif option.startswith("--"):
            raise Usage("unknown_option")
        else:
            raise Usage("unexpected_argument")
    limits = [o in out for o in LIMIT_OPTIONS[1:]]
    if out["scan"] and not all(limits):
        raise Usage("scan_limits_required")
    if any(limits) and not out["scan"]:
        raise Usage("scan_not_requested")
    return out


def refusal(code: str) -> str:
    """The JSON line of a code, without a session: the codes need no escapes."""
    return f'{{"schema_version":1,"ok":false,"error":"{code}","compatibility_established":false}}'


def run(spark: SparkSession, options: dict) -> tuple[str, int]:
    """The JSON line and exit code of a probe."""
    try:
        images = binary_images(spark, options["file"])
        most = options.get("--max-input-bytes", 256 << 20)
        if options["scan"]:
            rows = probe(images, page_size=PAGE_SIZE, max_bytes=most, max_pages=options["--max-pages"])
            over = scan_ceiling(F.col("length"), F.floor(F.col("length") / PAGE_SIZE), options["--max-scan-bytes"], options["--max-pages"])
            rows = rows.withColumn("error_code", F.coalesce("error_code", over))
        else:
            found = candidates(images, page_size=PAGE_SIZE, max_bytes=most)
            rows = found.select("image_id", "length", "kind", F.col("page_count").alias("pages_visited"), F.lit(0).alias("work_units"), F.lit(None).cast("string").alias("fnv1a64"), "error_code")
        code = F.when(F.col("error_code") == "partial_page", "not_2k_aligned").otherwise(F.col("error_code"))
        rows = rows.withColumn("error_code", code)
        row = probe_json(rows).join(rows.select("image_id", "error_code"), "image_id").first()
    except Exception as e:  # the path is not there or can't be read
        if "PATH_NOT_FOUND" not in str(e) and "FileNotFound" not in str(e):
            raise
        return refusal("open_failed"), 1
    return row.json, int(row.error_code is not None)


def main(args: list[str]) -> int:
    try:
        options = parse(args)
    except Usage as e:
        print(refusal(str(e)), file=sys.stderr)
        return 2
    if options["command"] != "probe":
        print(__doc__ if options["command"] == "--help" else "pagewright 0.1")
        return 0
    line, code = run(SparkSession.builder.getOrCreate(), options)
    try:
        print(line, file=sys.stderr if code else sys.stdout, flush=True)
    except OSError:
        return 74
    return code


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
