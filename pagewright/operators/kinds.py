"""Page kinds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The kinds of pages by their first byte; page zero is 0.
KINDS = {
    0: "database_definition",
    1: "data",
    2: "table_definition",
    3: "intermediate_index",
    4: "leaf_index",
    5: "extended_usage_bitmap",
}


def page_kind(page: Column, tag: Column) -> tuple[Column, Column]:
    """(kind, tag): tag is kept only where the kind is unknown."""
    named = F.when((page == 0) & (tag == 0), F.lit(KINDS[0]))
    for value, name in KINDS.items():
        if value:
            named = named.when((page > 0) & (tag == value), F.lit(name))
    kind = named.otherwise(F.lit("unknown"))
    return kind, F.when(kind == "unknown", tag)
