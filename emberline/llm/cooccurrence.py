"""How often items occur together, kept incrementally.

The state is three tables in a shared folder, each in hash buckets that are folders of their own: baskets (the item set last seen
of each basket), marginal counts, and pairs with their count and both marginals. A batch of changed baskets meets only the buckets that its
baskets fall in; what differs emits signed deltas, +1 for a pair that came and -1 for one that went. Deltas are summed with
map-side combine and merged into the buckets they fall in; pairs of which only a marginal changed are found by a scan that reads
the pairs' names, and their buckets are written with them. All other buckets stay where they are: a version is a list of the
folder that holds each bucket.

A version's list is written last, so a run that dies before leaves the former version in force and can simply be repeated.
"""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.session import cut, new_path

SCHEMAS = {
    "baskets": "basket string, items array<string>",
    "singles": "item string, n long",
    "pairs": "item_a string, item_b string, n long, n_a long, n_b long",
}
# A basket of more items is paired in blocks of so many, spread over all cores.
BLOCK = 256


def item_set(items: Column) -> Column:
    """Trimmed, lower-cased, distinct, sorted; NULL and blank elements ignored; a NULL array is an empty set."""
    clean = F.transform(items, lambda x: F.lower(F.trim(x)))
    kept = F.filter(clean, lambda x: x.isNotNull() & (x != ""))
    return F.coalesce(F.array_sort(F.array_distinct(kept)), F.array().cast("array<string>"))


def signed_pairs(moved: DataFrame, block: int = BLOCK) -> DataFrame:
    """item_a, item_b, d of baskets (was, now: sorted sets): +1 for each pair that only `now` has, -1 for one that only `was` has.

    Only pairs with an item that came or went are formed, all of them. One row makes at most block x block pairs; the
    blocks of wider baskets are spread over all cores.
    """
    marked = lambda items, new: F.transform(items, lambda x: F.struct(x.alias("x"), F.lit(new).alias("new")))
    side = lambda items, other, sign: F.struct(
        F.array_sort(F.concat(marked(F.array_except(items, other), True), marked(F.array_intersect(items, other), False))).alias("s"), F.lit(sign).alias("d")
    )
    sides = moved.select(F.explode(F.array(side(F.col("now"), F.col("was"), 1), side(F.col("was"), F.col("now"), -1))).alias("e"))
    sides = sides.select("e.s", "e.d").filter(F.exists("s", lambda x: x["new"]) & (F.size("s") > 1))

    def paired(rows: DataFrame) -> DataFrame:
        """Rows with two arrays, a and b: a pair of either, in the order of the names, one end of it new."""
        out = rows.select("d", "b", F.explode("a").alias("p")).select("d", "p", F.explode(F.filter("b", lambda x: x["x"] > F.col("p.x"))).alias("q"))
        return out.filter(F.col("p.new") | F.col("q.new")).select(F.col("p.x").alias("item_a"), F.col("q.x").alias("item_b"), "d")

    narrow = paired(sides.filter(F.size("s") <= block).select("d", F.col("s").alias("a"), F.col("s").alias("b")))
    wide = sides.filter(F.size("s") > block).withColumn("n", F.ceil(F.size("s") / block).cast("int"))
    wide = wide.select("s", "d", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i")).select("s", "d", "i", F.explode(F.sequence("i", F.col("n") - 1)).alias("j"))
    part = lambda i: F.slice("s", F.col(i) * block + 1, F.lit(block))
    wide = wide.select("d", part("i").alias("a"), part("j").alias("b"))
    spark = moved.sparkSession
    width = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # items are sorted, so a pair across blocks has its lesser name in the lower one
    return narrow.unionByName(paired(wide.repartition(width, F.xxhash64("a", "b"))))


class PairTable:
    """Persistent co-occurrence counts.

    spark: session; path: folder of the state, a new one in the shared folder by default; buckets: number of hash
    buckets per table, fixed for the life of a state: enough of them that one is written by one task.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int = 16):
        self.spark, self.buckets = spark, buckets
        self.path = path or new_path(spark, "pairs")
        self._dir = self._at(self.path)
        self._fs = self._dir.getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, path: str):  # noqa: ANN202
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _versions(self) -> list[int]:
        if not self._fs.exists(self._dir):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._dir)]
        return sorted(int(n[5:]) for n in names if n.startswith("LIST-"))

    @property
    def version(self) -> int | None:
        done = self._versions()
        return done[-1] if done else None

    def listed(self, version: int | None) -> dict:
        """n (baskets), and per table the version that wrote each bucket (as text; a bucket that is not named is empty)."""
        if version is None:
            return {"n": 0, **{t: {} for t in SCHEMAS}}
        return json.loads(self.spark.read.text(f"{self.path}/LIST-{version}", wholetext=True).first()[0])

    def _read(self, version: int | None, table: str, buckets: Iterable[int] | None = None) -> DataFrame:
        held = self.listed(version)[table]
        wanted = held if buckets is None else [str(b) for b in buckets if str(b) in held]
        paths = [f"{self.path}/{table}/v{held[b]}/bucket={b}" for b in wanted]
        return self.spark.read.schema(SCHEMAS[table]).parquet(*paths) if paths else self.spark.createDataFrame([], SCHEMAS[table])

    def _bucket(self, *columns: str) -> Column:
        return F.pmod(F.xxhash64(*columns), F.lit(self.buckets)).cast("int")

    def _touched(self, rows: DataFrame) -> list[int]:
        """Buckets of rows that have a column of that name; at most `buckets`."""
        return sorted(r["bucket"] for r in rows.select("bucket").distinct().collect())

    def _write(self, rows: DataFrame, table: str, version: int, buckets: list[int], held: dict[str, int]) -> dict[str, int]:
        """The table's list after `buckets` were written anew from rows (which have `bucket`, one task each)."""
        if buckets:
            rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{table}/v{version}")
        at = self._at(f"{self.path}/{table}/v{version}")
        made = {s.getPath().getName()[7:] for s in self._fs.listStatus(at) if s.isDirectory()} if buckets and self._fs.exists(at) else set()
        kept = {b: v for b, v in held.items() if int(b) not in set(buckets)}
        return kept | {b: version for b in made}

    def apply(self, batch: DataFrame, basket: str, items: str, order: str | None = None) -> None:
        """Merge a batch of new or changed baskets into the state.

        A basket that comes again replaces its former item set; if a batch has one basket several times, the row of the greatest
        `order` counts (NULL is the least), and of equal ones the least item set. Rows with a NULL basket leave. An empty batch changes
        nothing but the version.
        """
        old, new = self.version, (self.version or 0) + 1
        held = self.listed(old)
        keyed = batch.filter(F.col(basket).isNotNull()).select(
            F.col(basket).cast("string").alias("basket"), item_set(F.col(items)).alias("now"), (F.lit(0) if order is None else F.col(order)).alias("o")
        )
        # per basket and order the least set, then the greatest order; both combine before the shuffle
        came = keyed.groupBy("basket", "o").agg(F.min("now").alias("now")).groupBy("basket").agg(F.max_by("now", F.struct("o")).alias("now"))
        came = cut(came.withColumn("bucket", self._bucket("basket")))
        at = self._touched(came)
        width = max(len(at), 1)
        known = self._read(old, "baskets", at).select("basket", F.col("items").alias("was"))
        # one join of the touched buckets yields the deltas and the next baskets
        both = cut(known.join(came.select("basket", "now"), "basket", "full"))
        after = both.select("basket", F.coalesce("now", "was").alias("items")).withColumn("bucket", self._bucket("basket"))
        baskets = self._write(after.repartition(width, "bucket"), "baskets", new, at, held["baskets"])

        empty = F.array().cast("array<string>")
        changed = both.filter(F.col("now").isNotNull() & (F.col("was").isNull() | (F.col("was") != F.col("now"))))
        fresh = changed.filter(F.col("was").isNull()).count()
        moved = changed.select(F.coalesce("was", empty).alias("was"), "now")
        ends = lambda a, b, d: F.transform(F.array_except(a, b), lambda x: F.struct(x.alias("item"), F.lit(d).alias("d")))
        ones = moved.select(F.explode(F.concat(ends("now", "was", 1), ends("was", "now", -1))).alias("e"))
        ones = ones.groupBy(F.col("e.item").alias("item")).agg(F.sum("e.d").cast("long").alias("n")).filter("n <> 0")
        ones = cut(ones.withColumn("bucket", self._bucket("item")))
        at = self._touched(ones)
        merged = self._read(old, "singles", at).unionByName(ones.drop("bucket")).withColumn("bucket", self._bucket("item")).repartition(max(len(at), 1), "bucket")
        merged = merged.groupBy("bucket", "item").agg(F.sum("n").alias("n")).filter("n <> 0")
        singles = self._write(merged, "singles", new, at, held["singles"])

        pairs = signed_pairs(moved).groupBy("item_a", "item_b").agg(F.sum("d").cast("long").alias("n")).filter("n <> 0")
        pairs = cut(pairs.withColumn("bucket", self._bucket("item_a", "item_b")))
        names = ones.select("item")
        stored = self._read(old, "pairs").select("item_a", "item_b").withColumn("bucket", self._bucket("item_a", "item_b"))
        hit = stored.join(names.withColumnRenamed("item", "item_a"), "item_a", "left_semi").unionByName(
            stored.join(names.withColumnRenamed("item", "item_b"), "item_b", "left_semi")
        )
        at = self._touched(pairs.select("bucket").distinct().unionByName(hit.select("bucket").distinct()))
        merged = self._read(old, "pairs", at).select("item_a", "item_b", "n").unionByName(pairs.drop("bucket"))
        merged = merged.groupBy("item_a", "item_b").agg(F.sum("n").alias("n")).filter("n <> 0")
        marginals = self._listed_singles(singles).select("item", "n")
        for end in ("a", "b"):
            merged = merged.join(marginals.select(F.col("item").alias(f"item_{end}"), F.col("n").alias(f"n_{end}")), f"item_{end}")
        merged = merged.select("item_a", "item_b", "n", "n_a", "n_b").withColumn("bucket", self._bucket("item_a", "item_b"))
        written = self._write(merged.repartition(max(len(at), 1), "bucket"), "pairs", new, at, held["pairs"])
        self._publish(new, {"n": held["n"] + fresh, "baskets": baskets, "singles": singles, "pairs": written})

    def _listed_singles(self, held: dict[str, int]) -> DataFrame:
        paths = [f"{self.path}/singles/v{v}/bucket={b}" for b, v in held.items()]
        return self.spark.read.schema(SCHEMAS["singles"]).parquet(*paths) if paths else self.spark.createDataFrame([], SCHEMAS["singles"])

    def _publish(self, version: int, held: dict) -> None:
        draft = self._at(f"{self.path}/_draft-{version}")
        out = self._fs.create(draft, True)
        out.write(json.dumps(held).encode())
        out.close()
        self._fs.rename(draft, self._at(f"{self.path}/LIST-{version}"))

    def total(self) -> int:
        """Number of baskets, empty ones included."""
        return self.listed(self.version)["n"]

    def singles(self) -> DataFrame:
        return self._read(self.version, "singles")

    def pairs(self) -> DataFrame:
        return self._read(self.version, "pairs")

    def scores(self, least_count: int = 1, since: int | None = None) -> DataFrame:
        """item_a, item_b, n_ab, n_a, n_b, n, lift, pmi, npmi, llr, jaccard; pairs with fewer than least_count leave.

        Counts and marginals lie in the pair's row, so a score is arithmetic on it and the number of baskets; nothing is joined. since: only pairs
        whose own count or marginals may have changed after that version, those of the buckets written since, less the rows
        that are the same in both; the scores of all others follow from their former ones by the number of baskets alone (lift grows by its ratio).
        Scores are doubles; counts are exact.
        """
        pairs = self.pairs() if since is None else self._since(since)
        out = pairs.filter(F.col("n") >= least_count).select("item_a", "item_b", F.col("n").alias("n_ab"), "n_a", "n_b", F.lit(self.total()).cast("long").alias("n"))
        nab, na, nb, total = (F.col(c).cast("double") for c in ("n_ab", "n_a", "n_b", "n"))
        lift = nab * total / (na * nb)
        pmi = F.log2(lift)
        npmi = F.when(nab == total, F.lit(1.0)).otherwise(pmi / -F.log2(nab / total))
        cell = lambda k, e: F.when(k > 0, k * F.log(k / e)).otherwise(0.0)
        llr = 2 * (
            cell(nab, na * nb / total)
            + cell(na - nab, na * (total - nb) / total)
            + cell(nb - nab, (total - na) * nb / total)
            + cell(total - na - nb + nab, (total - na) * (total - nb) / total)
        )
        return out.select(
            "item_a", "item_b", "n_ab", "n_a", "n_b", "n",
            lift.alias("lift"), pmi.alias("pmi"), npmi.alias("npmi"), llr.alias("llr"),
            (nab / (na + nb - nab)).alias("jaccard"),
        )

    def _since(self, version: int) -> DataFrame:
        was, now = self.listed(version)["pairs"], self.listed(self.version)["pairs"]
        fresh = [int(b) for b, v in now.items() if was.get(b) != v]
        rows, before = self._read(self.version, "pairs", fresh), self._read(version, "pairs", fresh)
        return rows.join(before, ["item_a", "item_b", "n", "n_a", "n_b"], "left_anti")
