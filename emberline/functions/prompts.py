"""Prompts as text columns, from parts that are data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def joined(parts: Sequence[Column], gap: str = "\n\n") -> Column:
    """The parts that are neither NULL nor blank, with a gap between them."""
    return F.concat_ws(gap, *[F.when(F.trim(p) != "", p) for p in parts])


def examples(items: Column, title: str = "Example") -> Column:
    """An array of texts as numbered blocks; NULL for NULL and empty arrays."""
    blocks = F.transform(items, lambda x, i: F.concat(F.lit(f"{title} "), (i + 1).cast("string"), F.lit(":\n"), x))
    return F.when(F.size(items) > 0, F.array_join(blocks, "\n\n"))


def tile_prompt(role: Column, context: Column, shots: Column, question: Column, grounded: Column) -> Column:
    """Grounded prompts carry the regulatory context and the worked examples, plain ones only role and question."""
    return F.when(grounded, joined([role, context, examples(shots), question])).otherwise(joined([role, question]))
