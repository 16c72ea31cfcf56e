"""Queries that write a table in a format of the pipeline, read it back and go on with what was read; and a model run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.operators import model, runs
from emberline.plans.tables import table
from emberline.session import new_path
from emberline.sources import readers, writers


def io_json_arrays(spark: SparkSession, sf: str) -> DataFrame:
    """Parcel meta data through documents that are JSON arrays."""
    path = new_path(spark, "json")
    meta = table(spark, sf, "parcel_meta").select("parcel_id", "site", "gsd_cm", "n_tiles", "chm_range")
    writers.json_arrays(meta, path)
    back = readers.json_array(spark, path, "parcel_id string, site string, gsd_cm double, n_tiles int, chm_range array<double>")
    return back.select("parcel_id", "site", "gsd_cm", F.col("n_tiles").cast("long").alias("n_tiles"), F.size(F.coalesce("chm_range", F.array().cast("array<double>"))).cast("long").alias("n_range"))


def io_json_tiles(spark: SparkSession, sf: str) -> DataFrame:
    """The taxonomy through one JSON document per class, found by the ending of its name; a broken one beside them is skipped."""
    path = new_path(spark, "tiles")
    tax = table(spark, sf, "lab_taxonomy").select("object_class", "aliases", "typical_zone", F.col("object_class").alias("part"))
    writers.json_lines(tax, path, "part")
    spark.createDataFrame([("{broken",)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/part=zz")
    back = readers.tile_files(spark, path, "*.*", "object_class string, aliases array<string>, typical_zone string")
    return back.filter("object_class is not null").select("object_class", F.array_join("aliases", "; ").alias("aliases"), "typical_zone")


def io_csv(spark: SparkSession, sf: str) -> DataFrame:
    """Tiles through a CSV manifest with a fixed header; a column that they lack is empty."""
    path = new_path(spark, "csv")
    tiles = table(spark, sf, "tile_results").select("tile_id", "tile_path", "parcel_id", "zone", "elapsed_s").distinct()
    writers.csv(tiles, path, ["tile_path", "parcel_id", "zone", "tile_id", "site"])
    back = readers.manifest(spark, path, "tile_path string, parcel_id string, zone string, tile_id long, site string")
    return back.select("tile_id", "tile_path", "parcel_id", "zone", "site")


def io_sheets(spark: SparkSession, sf: str) -> DataFrame:
    """A workbook of three sheets, read again and counted."""
    path = new_path(spark, "sheets")
    names = ("region", "nation", "lab_taxonomy")
    frames = {n: table(spark, sf, n).select(F.col({"region": "r_name", "nation": "n_name", "lab_taxonomy": "object_class"}[n]).alias("name")) for n in names}
    writers.sheets(frames, path)
    out = None
    for n in names:
        rows = readers.manifest(spark, f"{path}/{n}", "name string").select(F.lit(n).alias("sheet"), "name")
        out = rows if out is None else out.unionByName(rows)
    return out


def _note_files(spark: SparkSession, sf: str) -> str:
    """A folder with one text file per class: its name, its zone and twice its note, without a note only the name."""
    path = new_path(spark, "texts")
    tax = table(spark, sf, "lab_taxonomy")
    body = F.coalesce(F.concat(F.col("object_class"), F.lit(" lies in "), F.col("typical_zone"), F.lit(". "), F.repeat(F.concat("notes", F.lit(" ")), F.lit(6))), F.col("object_class"))
    writers.texts(tax.select("object_class", body.alias("body")), path, "object_class", "body")
    return path


def io_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Whole texts, those that are too short replaced by a text at hand."""
    back = readers.whole_texts(spark, _note_files(spark, sf), "(no text)", 60)
    name = F.regexp_extract("path", "object_class=([^/]+)/", 1)
    return back.select(name.alias("object_class"), F.rtrim("text", F.lit(" \n")).alias("text"))


def io_files(spark: SparkSession, sf: str) -> DataFrame:
    """The same files as a listing with their sizes, and as base64 that is read again."""
    path = _note_files(spark, sf)
    sizes, payloads = readers.listing(spark, path, "*.txt"), readers.images_base64(spark, path, "*.txt")
    name = F.regexp_extract("path", "object_class=([^/]+)/", 1)
    return sizes.join(payloads, "path").select(name.alias("object_class"), F.col("length").alias("n_bytes"), F.md5(F.unbase64("payload")).alias("digest"))


def io_graphml(spark: SparkSession, sf: str) -> DataFrame:
    """Classes, zones and what lies where through GraphML documents: each edge with an attribute of its source."""
    path = new_path(spark, "graphml")
    tax = table(spark, sf, "lab_taxonomy")
    nodes = tax.select(F.col("object_class").alias("id"), F.lit("object").alias("type"), "aerial_visible", "notes", "aliases")
    edges = tax.select(F.col("object_class").alias("src"), F.coalesce("typical_zone", F.lit("ALL")).alias("dst"), F.lit("typically_found_in").alias("relation"))
    writers.graphml(nodes, edges, path)
    back_nodes, back_edges = readers.graphml(spark, path)
    a = F.col("attributes")
    named = back_nodes.select(F.col("id").alias("src"), a["aerial_visible"].alias("aerial"), a["notes"].alias("notes"), F.array_join(F.from_json(a["aliases"], "array<string>"), "; ").alias("aliases"))
    return back_edges.select("src", "dst", a["relation"].alias("relation")).join(named, "src")


def io_done_log(spark: SparkSession, sf: str) -> DataFrame:
    """Parcels not in a log that two runs appended to."""
    path = new_path(spark, "log")
    meta = table(spark, sf, "parcel_meta").select("parcel_id").distinct()
    for part in (0, 1):
        writers.append_done(meta.filter(F.expr(f"ascii(right(parcel_id, 1)) % 3 = {part}")), path, "parcel_id")
    return meta.join(readers.done_keys(spark, path), "parcel_id", "left_anti")


def io_catalog(spark: SparkSession, sf: str) -> DataFrame:
    """Catalogue items that overlap a box in a year that has none, so those of the fallback year."""
    p = table(spark, sf, "part")
    items = p.select("p_partkey", (F.col("p_size") * 1.0).alias("x0"), (F.col("p_partkey") % 50 * 1.0).alias("y0"), (F.col("p_partkey") % 3 + 2020).cast("int").alias("year"))
    items = items.withColumn("x1", F.col("x0") + 5).withColumn("y1", F.col("y0") + 5)
    return readers.catalog_search(items, 10.0, 10.0, 20.0, 20.0, 2030, 2021).select("p_partkey", F.col("year").cast("long").alias("year"))


def _run(spark: SparkSession, sf: str, votes: int) -> tuple[DataFrame, DataFrame]:
    tiles = table(spark, sf, "tile_results").select("tile_id", "parcel_id").distinct()
    planned = tiles.withColumn("x0", F.lit(0)).withColumn("y0", F.lit(0))
    return runs.tile_run(planned, tiles.filter("tile_id % 4 = 0").select("tile_id"), model.stub(("propane_tank", "vehicle"), "tile_id"), votes)


def model_run(spark: SparkSession, sf: str) -> DataFrame:
    """A run of the stub model over the tiles that are not done: one detection each, chosen by the digest of the tile's id."""
    return _run(spark, sf, 0)[0].select("tile_id", "parcel_id", "object_class", "zone", "confidence")


def model_run_voted(spark: SparkSession, sf: str) -> DataFrame:
    """The same with a vote on detections of low confidence: three equal answers agree."""
    return _run(spark, sf, 3)[0].select("tile_id", "object_class", "zone", "compliance_status", "confidence")


_STUB = """t as (select distinct tile_id, parcel_id from tile_results where tile_id % 4 <> 0),
h as (select *, list_sum(list_transform(string_split(md5(tile_id::varchar), ''), lambda c: strpos('0123456789abcdef', c) - 1))::bigint as s,
  strpos('0123456789abcdef', right(md5(tile_id::varchar), 1)) - 1 as last from t)"""
_BODY = "coalesce(object_class || ' lies in ' || typical_zone || '. ' || repeat(notes || ' ', 6), object_class)"

SQL = {
    "io_json_arrays": "select parcel_id, site, gsd_cm, n_tiles, coalesce(len(chm_range), 0) as n_range from parcel_meta",
    "io_json_tiles": "select object_class, array_to_string(aliases, '; ') as aliases, typical_zone from lab_taxonomy",
    "io_csv": "select distinct tile_id, tile_path, parcel_id, zone, null::varchar as site from (select distinct tile_id, tile_path, parcel_id, zone, elapsed_s from tile_results)",
    "io_sheets": "select 'region' as sheet, r_name as name from region union all select 'nation', n_name from nation union all select 'lab_taxonomy', object_class from lab_taxonomy",
    "io_texts": f"select object_class, case when length(trim({_BODY})) < 60 then '(no text)' else rtrim({_BODY}) end as text from lab_taxonomy",
    "io_files": f"select object_class, octet_length(encode({_BODY} || chr(10))) as n_bytes, md5({_BODY} || chr(10)) as digest from lab_taxonomy",
    "io_graphml": """select object_class as src, coalesce(typical_zone, 'ALL') as dst, 'typically_found_in' as relation, aerial_visible::varchar as aerial, notes,
  array_to_string(aliases, '; ') as aliases from lab_taxonomy""",
    "io_done_log": "select distinct parcel_id from parcel_meta where ascii(right(parcel_id, 1)) % 3 not in (0, 1)",
    "io_catalog": "select p_partkey, 2021::bigint as year from part where p_size < 20 and p_size + 5 > 10 and p_partkey % 50 < 20 and p_partkey % 50 + 5 > 10 and p_partkey % 3 = 1",
    "model_run": f"""with {_STUB} select tile_id, parcel_id, case last % 2 when 0 then 'propane_tank' else 'vehicle' end as object_class, 'Zone_' || (s % 3) as zone, 'LOW' as confidence from h""",
    "model_run_voted": f"""with {_STUB} select tile_id, case last % 2 when 0 then 'propane_tank' else 'vehicle' end as object_class, 'Zone_' || (s % 3) as zone,
  'UNCERTAIN' as compliance_status, 'LOW' as confidence from h""",
}

QUERIES = {
    f.__name__: f
    for f in (io_json_arrays, io_json_tiles, io_csv, io_sheets, io_texts, io_files, io_graphml, io_done_log, io_catalog, model_run, model_run_voted)
}
