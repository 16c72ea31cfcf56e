"""Writers. Every one is distributed; none gathers rows unless the target is a single document by definition."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from emberline.operators.joins import surrogate_ids
from emberline.session import cut


def json_lines(df: DataFrame, path: str, by: str | None = None) -> None:
    """JSON, one folder per value of `by` if given."""
    writer = (df.repartition(by) if by else df).write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).json(path)


def csv(df: DataFrame, path: str, header: Sequence[str]) -> None:
    """CSV with exactly these columns in this order; others are ignored, missing ones written empty."""
    cols = [F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in header]
    df.select(*cols).write.mode("overwrite").option("header", True).csv(path)


def sheets(frames: dict[str, DataFrame], path: str) -> None:
    """A workbook as one CSV folder per sheet."""
    for name, df in frames.items():
        df.write.mode("overwrite").option("header", True).csv(f"{path}/{name}")


def lines(df: DataFrame, path: str, line: str = "line", order: str = "line_no") -> None:
    """Text lines in order, for reports."""
    df.orderBy(order).select(line).write.mode("overwrite").text(path)


def append_done(df: DataFrame, path: str, column: str) -> None:
    df.select(F.col(column).cast("string").alias("value")).write.mode("append").text(path)


def json_arrays(df: DataFrame, path: str) -> None:
    """JSON documents that are arrays, one per partition, each a file of its own."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [r for b in batches for r in b["j"]]
        yield pd.DataFrame({"value": ["[" + ",\n".join(rows) + "]"] if rows else []}, dtype="object")

    df.select(F.to_json(F.struct("*")).alias("j")).mapInPandas(run, "value string").write.mode("overwrite").text(path)


def texts(df: DataFrame, path: str, name: str, text: str) -> None:
    """One text file per row, in a folder named by the column `name` (unique)."""
    df.select(F.col(name), F.col(text).alias("value")).write.mode("overwrite").partitionBy(name).text(path)


# Frame of a GraphML document.
_HEAD = '<?xml version="1.0" encoding="UTF-8"?>\n<graphml xmlns="http://graphml.graphdrawing.org/xmlns">'
_TAIL = "</graph></graphml>"


def graphml(nodes: DataFrame, edges: DataFrame, path: str, node_id: str = "id", source: str = "src", target: str = "dst") -> None:
    """A folder of GraphML documents, each whole by itself, that readers.graphml() reads as one graph.

    Every other column is an attribute: NULL is left out, all else is text, arrays and structs as JSON. Rows stay where they are; a partition is a document.
    """

    def escaped(c: Column) -> Column:
        for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
            c = F.replace(c, F.lit(a), F.lit(b))
        return c

    def text_of(df: DataFrame, c: str) -> Column:
        plain = df.schema[c].dataType.typeName() not in ("array", "struct", "map")
        return (F.col(f"`{c}`").cast("string") if plain else F.to_json(F.col(f"`{c}`")))

    head = [_HEAD]

    def elements(df: DataFrame, tag: str, own: dict[str, str]) -> DataFrame:
        data = []
        for i, c in enumerate(c for c in df.columns if c not in own.values()):
            key = f"{tag[0]}{i}"
            head.append(f'<key id="{key}" for="{tag}" attr.name="{c}" attr.type="string"/>')
            data.append(F.concat(F.lit(f'<data key="{key}">'), escaped(text_of(df, c)), F.lit("</data>")))
        named = [F.concat(F.lit(f' {k}="'), escaped(F.col(v).cast("string")), F.lit('"')) for k, v in own.items()]
        return df.select(F.concat(F.lit(f"<{tag}"), *named, F.lit(">"), F.concat_ws("", *data), F.lit(f"</{tag}>")).alias("x"))

    both = elements(nodes, "node", {"id": node_id}).unionByName(elements(edges, "edge", {"source": source, "target": target}))
    opening = "\n".join([*head, '<graph edgedefault="directed">'])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        begun = False
        for b in batches:
            if len(b):
                yield pd.DataFrame({"value": ([] if begun else [opening]) + list(b["x"])})
                begun = True
        if begun:
            yield pd.DataFrame({"value": [_TAIL]})

    both.filter("x is not null").mapInPandas(run, "value string").write.mode("overwrite").text(path)


def coco(images: DataFrame, annotations: DataFrame, categories: DataFrame, image_id: str, image_of: str, page: int = 5000) -> DataFrame:
    """doc, page_no, images, annotations, categories: documents ready for JSON, an image with its annotations in one page.

    `doc` is a parcel; one of many images becomes several pages of at most `page` images, so that none is gathered in one task.
    categories is a dimension: at most 10,000 rows, checked.
    """
    listed = categories.orderBy(*categories.columns).limit(10_001).collect()
    if len(listed) > 10_000:
        raise ValueError("more than 10000 categories")
    c = categories.sparkSession.createDataFrame([([r.asDict() for r in listed],)], StructType([StructField("categories", ArrayType(categories.schema))]))
    i = surrogate_ids(images, ["doc", image_id], "__n", 0)
    first = i.groupBy("doc").agg(F.min("__n").alias("__first"))
    i = cut(i.join(first, "doc").withColumn("page_no", F.floor((F.col("__n") - F.col("__first")) / page)).drop("__n", "__first"))
    a = annotations.join(i.select("doc", F.col(image_id).alias(image_of), "page_no"), ["doc", image_of])
    nested = lambda df, into: df.groupBy("doc", "page_no").agg(F.array_sort(F.collect_list(F.struct(*[x for x in df.columns if x not in ("doc", "page_no")]))).alias(into))
    out = nested(i, "images").join(nested(a, "annotations"), ["doc", "page_no"], "left")
    return out.crossJoin(F.broadcast(c))  # one row


def label_tasks(df: DataFrame, number: str, size: int = 500) -> DataFrame:
    """df with batch_no: rows numbered from 1 in `number` (see surrogate_ids) in batches of `size`."""
    return df.withColumn("batch_no", F.floor((F.col(number) - 1) / size).cast("long"))
