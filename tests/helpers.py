"""Comparing rows of two engines without regard to their order."""

from __future__ import annotations

import math
from typing import Any


def plain(v: Any) -> str:
    if isinstance(v, bool) or v is None:
        return str(v)
    if hasattr(v, "as_tuple"):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v + 0.0, 8))
    if isinstance(v, int):
        return str(v)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    return str(v)


def same_rows(df, con, sql: str) -> None:
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    want = sorted(tuple(plain(r[names.index(c)]) for c in order) for r in got.fetchall())
    have = sorted(tuple(plain(r[c]) for c in order) for r in df.collect())
    # whole numbers may be doubles on one side
    strip = lambda rows: sorted(tuple(x[:-2] if x.endswith(".0") else x for x in r) for r in rows)
    assert strip(have) == strip(want)
