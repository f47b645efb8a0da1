"""Names for columns that operators add for themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame


def own(df: DataFrame, *names: str) -> list[str]:
    """The names, longer by underscores where the table already has such a column (names differ by more than case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
