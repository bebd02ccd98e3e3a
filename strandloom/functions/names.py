"""Working names of columns."""

from __future__ import annotations

from pyspark.sql import DataFrame


def fresh(df: DataFrame, *names: str) -> list[str]:
    """One column name for each given one that df hasn't got, whatever the case of letters."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        k, free = 0, f"_{name}"
        while free.lower() in taken:
            k += 1
            free = f"_{name}_{k}"
        taken.add(free.lower())
        out.append(free)
    return out
