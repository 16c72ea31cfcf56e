"""Filling containers of fixed capacity, with windows that keep target proportions of the sources.

Each source is a queue in a fixed pseudo-random order. Deficit round-robin gives queue s a quantum q_s per round; an
item whose queue has brought C tokens up to and with it leaves in round ceil(C / q_s), whatever the other queues do.
So the round of every item follows from a running total per queue: the deficit left after an item is carried to the
next round, window and partition by arithmetic, and no task serves a queue alone. A second running total over
(round, source) cuts the stream into windows of equal size; each window is packed by best fit in one small task.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberline.operators.scan import running_total
from emberline.session import cut

CAPACITY = 4096


def best_fit(sizes: list[int], capacity: int) -> list[int]:
    """Container number of each item: largest first, each into the fullest container that still takes it."""
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    place, free, made = [0] * len(sizes), [], 0  # free: sorted (room, container)
    for i in order:
        at = bisect_left(free, (sizes[i], -1))
        if at < len(free):
            room, container = free.pop(at)
        else:
            room, container, made = capacity, made, made + 1
        place[i] = container
        insort(free, (room - sizes[i], container))
    return place


def pieces(items: DataFrame, key: str, source: str, size: str, capacity: int = CAPACITY) -> DataFrame:
    """item, source, piece_no, pieces, token_from, size: items above the capacity in pieces of full capacity and a rest.

    NULL sizes count 0; an item of size 0 is one piece of size 0. A NULL source is a queue of its own.
    """
    n = F.greatest(F.coalesce(F.col(size).cast("long"), F.lit(0)), F.lit(0))
    count = F.greatest(F.ceil(n / capacity), F.lit(1)).cast("int")
    out = items.select(F.col(key).alias("item"), F.col(source).alias("source"), n.alias("n"), count.alias("pieces"))
    out = out.select("*", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece_no"))
    start = F.col("piece_no").cast("long") * capacity
    return out.select(
        "item", "source", "piece_no", "pieces", start.alias("token_from"),
        F.least(F.lit(capacity).cast("long"), F.col("n") - start).alias("size"),
    )


def assign_windows(parts: DataFrame, shares: dict[str | None, float] | None, window: int, round_tokens: int, least: int = 1) -> DataFrame:
    """parts with `round` and `window`, by deficit round-robin. An item takes at least `least` tokens of a window, which bounds a window's rows.

    shares: target proportion per source; default is each source's own share of all tokens, so that all queues end
    together. Sources that `shares` lacks get their own share as well. When a queue is empty the others go on, so
    windows stay full.
    """
    keyed = parts.withColumn("order", F.xxhash64("item"))
    queued = cut(running_total(keyed, ["source", "order", "item", "piece_no"], "size", "queued"))
    # one row per source; a queue's own running total is the one over (source, order) less what lies before its first item
    totals = queued.groupBy("source").agg(F.sum("size").alias("total"), F.min("queued").alias("start"))
    everything = queued.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n")).first()["n"]
    share = F.col("total") / F.lit(max(everything, 1))
    for name, wanted in (shares or {}).items():
        share = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(float(wanted))).otherwise(share)
    limits = cut(totals.select(F.col("source").alias("__source"), "start", F.greatest(share * round_tokens, F.lit(1.0)).alias("quantum")))
    joined = queued.join(limits, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    turn = F.greatest(F.ceil((F.col("queued") - F.col("start") + F.col("size")) / F.col("quantum")), F.lit(1))
    turned = joined.withColumn("round", turn.cast("long")).drop("start", "quantum", "queued")
    # small items count `least` tokens here, so that a window is of bounded rows too
    turned = turned.withColumn("__room", F.greatest(F.col("size"), F.lit(least)))
    placed = running_total(turned, ["round", "source", "order", "item", "piece_no"], "__room", "before")
    return placed.withColumn("window", F.floor(F.col("before") / window).cast("long")).drop("before", "order", "__room")


def pack(
    items: DataFrame,
    key: str,
    source: str,
    size: str,
    capacity: int = CAPACITY,
    shares: dict[str | None, float] | None = None,
    containers_per_window: int = 256,
) -> DataFrame:
    """window, container, item, source, piece_no, pieces, token_from, size: every item, none left out.

    Pieces of full capacity fill a container each and are numbered below 0 within their window; the others are packed
    by best fit. A window holds at most containers_per_window capacities of tokens and 256 times as many items (and the item that
    crosses its end), whatever the data: items of less than a 256th of the capacity, empty ones too, count as one. Rows repeated in `items` are packed as often as they come; keys should be unique.
    """
    window_tokens = capacity * containers_per_window
    parts = pieces(items, key, source, size, capacity)
    placed = cut(assign_windows(parts, shares, window_tokens, max(window_tokens // 4, 1), max(capacity // 256, 1)))
    names = ["window", "item", "source", "piece_no", "pieces", "token_from", "size"]
    full = placed.filter(F.col("size") == capacity)
    # a window has at most containers_per_window + 1 of them
    number = -F.row_number().over(Window.partitionBy("window").orderBy("item", "piece_no"))
    full = full.select(*names, number.cast("long").alias("container"))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["size", "item", "piece_no"], ascending=[False, True, True], kind="stable")
        group["container"] = best_fit(group["size"].tolist(), capacity)
        return group

    schema = {f.name: f.dataType.simpleString() for f in placed.schema}
    ddl = ", ".join(f"`{c}` {schema[c]}" for c in names) + ", container long"
    rest = placed.filter(F.col("size") < capacity).select(*names).groupBy("window").applyInPandas(run, ddl)
    return full.unionByName(rest)


def divided(packed: DataFrame) -> DataFrame:
    """item, containers: the items that lie in more than one container."""
    per = packed.groupBy("item").agg(F.countDistinct("window", "container").alias("containers"))
    return per.filter("containers > 1")


def fill_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """containers, tokens, unused_share, of all containers."""
    per = packed.groupBy("window", "container").agg(F.sum("size").alias("tokens"))
    return per.agg(
        F.count("*").alias("containers"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"),
        (1 - F.sum("tokens") / (F.count("*") * capacity)).alias("unused_share"),
    )


def window_report(packed: DataFrame) -> DataFrame:
    """window, source, tokens, share of the window's tokens."""
    per = packed.groupBy("window", "source").agg(F.sum("size").alias("tokens"))
    return per.withColumn("share", F.col("tokens") / F.greatest(F.sum("tokens").over(Window.partitionBy("window")), F.lit(1)))


