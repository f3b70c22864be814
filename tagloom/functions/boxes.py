"""Boxes of view metadata in all their shapes, and their geometry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tagloom.functions.scalars import number

EDGES = ("x_min", "y_min", "x_max", "y_max")


def box(metadata: Column) -> dict[str, Column]:
    """The edges of a box in JSON metadata: `bbox` as an object or a list of four, else `bbox_xyxy` as an object (x_min or
    x1 ...) or a list, else keys of the metadata itself. What is missing or no number is null."""
    get = lambda path: F.get_json_object(metadata, f"$.{path}")
    shape = lambda name: F.substring(get(name), 1, 1)
    short = {"x_min": "x1", "y_min": "y1", "x_max": "x2", "y_max": "y2"}
    found = {}
    for i, edge in enumerate(EDGES):
        value = (
            F.when(shape("bbox") == "{", get(f"bbox.{edge}"))
            .when((shape("bbox") == "[") & get("bbox[3]").isNotNull(), get(f"bbox[{i}]"))
            .when(shape("bbox_xyxy") == "{", F.coalesce(get(f"bbox_xyxy.{edge}"), get(f"bbox_xyxy.{short[edge]}")))
            .when((shape("bbox_xyxy") == "[") & get("bbox_xyxy[3]").isNotNull(), get(f"bbox_xyxy[{i}]"))
            .otherwise(get(edge))
        )
        found[edge] = number(value)
    return found


def geometry(edges: dict[str, Column]) -> dict[str, Column]:
    """Width and height (0 at least), area and centre; null where an edge is missing."""
    width = F.greatest(F.lit(0.0), edges["x_max"] - edges["x_min"])
    height = F.greatest(F.lit(0.0), edges["y_max"] - edges["y_min"])
    whole = edges["x_min"].isNotNull() & edges["x_max"].isNotNull() & edges["y_min"].isNotNull() & edges["y_max"].isNotNull()
    return {
        "width": F.when(whole, width),
        "height": F.when(whole, height),
        "area": F.when(whole, width * height),
        "center_x": F.when(whole, (edges["x_min"] + edges["x_max"]) / 2),
        "center_y": F.when(whole, (edges["y_min"] + edges["y_max"]) / 2),
    }
