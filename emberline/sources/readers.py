"""Readers for the shapes that the pipeline keeps on disk."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.functions.text import squeeze

MANIFEST = (
    "tile_path string, parcel_id string, site string, row int, col int, zone string, gsd_cm double, "
    "chm_mean_in_tile double, chm_max_in_tile double, tile_size_px int, row_start_px int, col_start_px int"
)
TAXONOMY = "object_class string, aliases array<string>, typical_zone string, aerial_visible boolean, approximate_size_ft string, notes string"
RULES = (
    "calfire_id string, zone string, item_label string, requirement_text string, object_mentions array<string>, "
    "aerial_detectable boolean, requirement_type string, severity string"
)
SECTIONS = "section_id string, full_text string, zone_scope string, requirement_type string"
DETECTION = (
    "struct<object_class: string, bounding_box_pixels: array<double>, zone: string, compliance_status: string, "
    "confidence: string, severity: string, cot_trace: string, imagery_source: string>"
)
TILE = (
    "tile_path string, parcel_id string, zone string, gsd_cm string, row string, col string, model string, "
    f"result struct<detections: array<{DETECTION}>, overall_parcel_risk: string, aerial_limitations: array<string>, "
    f"raw_output: string, parse_failed: boolean>, detections array<{DETECTION}>, overall_parcel_risk string, "
    "aerial_limitations array<string>, parse_failed boolean, elapsed_s double, backend string"
)
_GRAPHML_DATA = "data array<struct<_key: string, _VALUE: string>>"


def json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON document that is an array (or one object) per file."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def tile_files(spark: SparkSession, folder: str, glob: str = "*_r*_c*.json", schema: str = TILE) -> DataFrame:
    """One JSON document per file with a name filter; unreadable ones are dropped. Adds file_name."""
    df = spark.read.schema(schema).option("multiLine", True).option("pathGlobFilter", glob).option("mode", "DROPMALFORMED")
    return df.option("recursiveFileLookup", True).json(folder).withColumn("file_name", F.col("_metadata.file_name"))


def manifest(spark: SparkSession, path: str, schema: str = MANIFEST) -> DataFrame:
    """CSV with a header; values that do not fit their type become NULL."""
    return spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").csv(path)


def graphml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes(id, attributes), edges(src, dst, attributes)); attributes map from name to text, by the file's key table."""
    read = lambda tag, ddl: spark.read.format("xml").option("rowTag", tag).schema(ddl).load(path)
    keys = read("key", "_id string, `_attr.name` string").select(F.col("_id").alias("k"), F.col("`_attr.name`").alias("name"))
    keys = keys.groupBy("k").agg(F.min("name").alias("name"))

    def attributes(rows: DataFrame, ends: list[str]) -> DataFrame:
        """Rows with their data elements named; a row number keeps repeated elements apart."""
        numbered = rows.withColumn("__row", F.monotonically_increasing_id())
        entries = numbered.select("__row", *ends, F.explode_outer("data").alias("d")).select("__row", *ends, F.col("d._key").alias("k"), F.col("d._VALUE").alias("v"))
        named = entries.join(keys, "k", "left").withColumn("name", F.coalesce("name", "k"))
        pairs = F.collect_list(F.when(F.col("name").isNotNull(), F.struct("name", "v")))  # the data elements of one node or edge
        return named.groupBy("__row", *ends).agg(F.map_from_entries(pairs).alias("attributes")).drop("__row")

    nodes = read("node", f"_id string, {_GRAPHML_DATA}").select(F.col("_id").alias("id"), "data")
    edges = read("edge", f"_source string, _target string, {_GRAPHML_DATA}").select(F.col("_source").alias("src"), F.col("_target").alias("dst"), "data")
    return attributes(nodes, ["id"]), attributes(edges, ["src", "dst"])


def whole_texts(spark: SparkSession, path: str, fallback: str, least: int = 200) -> DataFrame:
    """path, text: one row per file; a text shorter than `least` after trimming is replaced by the fallback."""
    df = spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("path"), "value")
    return df.select("path", F.when(F.length(F.trim("value")) < least, fallback).otherwise(F.col("value")).alias("text"))


def listing(spark: SparkSession, folder: str, glob: str) -> DataFrame:
    """path, length: files by name filter; contents are not read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(folder).select("path", "length")


def images_base64(spark: SparkSession, folder: str, glob: str) -> DataFrame:
    """path, payload: file contents as base64."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(folder)
    return files.select("path", F.base64("content").alias("payload"))


def done_keys(spark: SparkSession, path: str, column: str = "parcel_id") -> DataFrame:
    """The distinct lines of an append-only log."""
    return spark.read.text(path).select(F.trim("value").alias(column)).filter(F.col(column) != "").distinct()


def catalog_search(items: DataFrame, x0: float, y0: float, x1: float, y1: float, year: int, fallback: int) -> DataFrame:
    """Catalog items (x0, y0, x1, y1, year) that overlap a box in a year, or in the fallback year if that year has none."""
    over = items.filter((F.col("x0") < x1) & (F.col("x1") > x0) & (F.col("y0") < y1) & (F.col("y1") > y0))
    found = over.filter(F.col("year") == year).limit(1).count()
    return over.filter(F.col("year") == (year if found else fallback))


class _Visible(HTMLParser):
    """Visible text of a page, and of each wanted tag in it, in one pass."""

    def __init__(self, wanted: tuple[str, ...]):
        super().__init__()
        self.parts: dict[str | None, list[str]] = {w: [] for w in (*wanted, None)}
        self.inside, self.hidden = dict.fromkeys(wanted, 0), 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("script", "style"):
            self.hidden += 1
        elif tag in self.inside:
            self.inside[tag] += 1

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style"):
            self.hidden = max(0, self.hidden - 1)
        elif tag in self.inside:
            self.inside[tag] = max(0, self.inside[tag] - 1)

    def handle_data(self, data: str) -> None:
        if not self.hidden and data.strip():
            for w, parts in self.parts.items():
                if w is None or self.inside[w]:
                    parts.append(data.strip())


def html_text(html: Column, selectors: tuple[str, ...] = ("main", "article", "body")) -> Column:
    """Text of the first of the tags that has any, else of the whole page; pieces on lines of their own."""

    @F.pandas_udf("string")
    def pick(column: pd.Series) -> pd.Series:
        def one(page: str | None) -> str | None:
            if page is None:
                return None
            parser = _Visible(selectors)
            parser.feed(page)
            parser.close()
            return next(("\n".join(p) for p in parser.parts.values() if p), "")

        return column.map(one)

    return pick(html)


def titled(path: Column) -> Column:
    """File name without folder and ending."""
    return squeeze(F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", ""))
