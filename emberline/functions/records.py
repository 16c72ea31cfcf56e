"""Projections over tile results, chips and summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def effective_list(nested: str = "result.detections", flat: str = "detections") -> Column:
    """PRJ-09: the nested list when it is non-empty, else the flat one, else an empty list."""
    return F.when(F.size(nested) > 0, F.col(nested)).otherwise(F.coalesce(F.col(flat), F.slice(F.col(nested), 1, 0)))


def effective_field(name: str, nested: str = "result.detections", flat: str = "detections") -> Column:
    """PRJ-09 for one field of the elements, as an array; only that field is read from the file."""
    inner = F.col(f"{nested}.{name}")
    return F.when(F.size(inner) > 0, inner).otherwise(F.coalesce(F.col(f"{flat}.{name}"), inner))


def effective_structs(names: Sequence[str]) -> Column:
    """PRJ-09 for some fields of the elements, as an array of structs; only those fields are read from the file."""
    zipped = F.arrays_zip(*[effective_field(n).alias(n) for n in names])
    return F.transform(zipped, lambda x: F.struct(*[x[n].alias(n) for n in names]))


def one_row_each(df: DataFrame, key: str) -> DataFrame:
    """Rows sent again under the same key and with the same content count once; NULL keys leave.

    The first row wins by partial aggregation, so a key that holds a third of all rows is reduced before the shuffle.
    """
    rest = [c for c in df.columns if c != key]
    kept = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.first(F.struct(*rest)).alias("__row"))
    return kept.select(key, *[F.col(f"__row.`{c}`").alias(c) for c in rest])


def merged_maps(base: Column, later: Column) -> Column:
    """Map of both, the later one's values winning; a NULL map counts as empty (NULL only if both are)."""
    both = F.map_concat(F.map_filter(base, lambda k, v: ~F.map_contains_key(later, k)), later)
    return F.when(base.isNull(), later).when(later.isNull(), base).otherwise(both)


def tagged(array: Column, field: str, value: str) -> Column:
    """Every struct of the array with the field set to a constant; NULL elements stay NULL."""
    return F.transform(array, lambda x: F.when(x.isNotNull(), x.withField(field, F.lit(value))))


def defaults(array: Column, values: dict[str, str]) -> Column:
    """Every struct of the array with its NULL text fields filled in."""

    def filled(x: Column) -> Column:
        for name, value in values.items():
            x = x.withField(name, F.coalesce(x[name], F.lit(value)))
        return x

    return F.transform(array, filled)
