"""Names for helper columns that clash with nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame


def free_name(name: str, *frames: DataFrame) -> str:
    """``name``, with underscores until no column of any frame has it."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
