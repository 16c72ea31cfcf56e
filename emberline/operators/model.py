"""The hook for external models: rows in, answers out, errors as data.

A model is a callable from a list of dicts to a list of dicts of the same length; it is loaded once per worker process
by a factory. The stub answers deterministically from a hash, for tests.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

Model = Callable[[list[dict]], list[dict]]


def run_model(rows: DataFrame, factory: Callable[[], Model], answer: str, width: int | None = None, batch: int = 32) -> DataFrame:
    """rows with `answer` (JSON) and `error`; a batch that raises gives its rows one at a time, then an error text.

    width: number of parallel callers (partitions); filters belong before this node, as none is pushed below it.
    """
    placed = rows.repartition(width) if width else rows
    keep = [f for f in rows.schema if f.name not in (answer, "error")]
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keep)
    names = [f.name for f in keep]

    def safe(model: Model, items: list[dict]) -> list[tuple[str | None, str | None]]:
        try:
            return [(json.dumps(a), None) for a in model(items)]
        except Exception as e:  # noqa: BLE001
            if len(items) == 1:
                return [(None, f"{type(e).__name__}: {e}")]
            return [safe(model, [x])[0] for x in items]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = factory()
        for frame in frames:
            items = frame[names].to_dict("records")
            got = [x for i in range(0, len(items), batch) for x in safe(model, items[i : i + batch])]
            yield frame[names].assign(**{answer: [g[0] for g in got], "error": [g[1] for g in got]})

    return placed.select(*names).mapInPandas(run, f"{ddl}, `{answer}` string, error string")


def stub(classes: tuple[str, ...] = ("propane_tank", "vehicle"), key: str = "id") -> Callable[[], Model]:
    """Factory of a model that returns one detection per row, chosen by the MD5 of its key."""

    def load() -> Model:
        def answer(items: list[dict]) -> list[dict]:
            out = []
            for x in items:
                h = int(hashlib.md5(str(x.get(key)).encode()).hexdigest(), 16)
                out.append({"detections": [{"object_class": classes[h % len(classes)], "confidence": "LOW", "zone": f"Zone_{h % 3}"}]})
            return out

        return answer

    return load
