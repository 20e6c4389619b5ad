"""Canvas files: JSON with nodes and edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CANVAS = "nodes array<struct<id: string, type: string, text: string, file: string, label: string, x: double, y: double, width: double, height: double>>, edges array<struct<id: string, fromNode: string, toNode: string, label: string>>"


def nodes(canvases: DataFrame, notes: DataFrame) -> DataFrame:
    """(canvas, id, type, x, y, width, height, text): file nodes have their note's text."""
    n = canvases.select("canvas", F.explode(F.from_json("json", CANVAS)["nodes"]).alias("n")).select("canvas", "n.*")
    text = F.coalesce("text", "body", "label")
    return n.join(notes.select(F.col("path").alias("file"), "body"), "file", "left").select("canvas", "id", "type", "x", "y", "width", "height", text.alias("text"))


def edges(canvases: DataFrame) -> DataFrame:
    e = canvases.select("canvas", F.explode(F.from_json("json", CANVAS)["edges"]).alias("e"))
    return e.select("canvas", F.col("e.fromNode").alias("src"), F.col("e.toNode").alias("dst"), F.col("e.label").alias("label"))


def group_edges(placed: DataFrame) -> DataFrame:
    """(canvas, src, dst): a group contains the nodes whose centre lies in it; within a canvas only."""
    g = placed.where("type = 'group'").select("canvas", F.col("id").alias("src"), F.col("x").alias("x0"), F.col("y").alias("y0"), (F.col("x") + F.col("width")).alias("x1"), (F.col("y") + F.col("height")).alias("y1"))
    c = placed.select("canvas", F.col("id").alias("dst"), (F.col("x") + F.col("width") / 2).alias("cx"), (F.col("y") + F.col("height") / 2).alias("cy"))
    return g.join(c, "canvas").where("cx between x0 and x1 and cy between y0 and y1 and src <> dst").select("canvas", "src", "dst")
