"""Layout strings and boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A box and a label in a layout string.
_BOX = r"\[(\d*\.?\d+),(\d*\.?\d+),(\d*\.?\d+),(\d*\.?\d+)\]"
_LABEL = r"\]\[([^\]]+)\]"


def parse_layout(df: DataFrame, layout_col: str) -> DataFrame:
    """The rows exploded to ``pos, x1, y1, x2, y2, label``, one per segment that has a box and a label.

    Segments end with ``[PAIR_SEP]`` or ``[RELATION_SEP]``; ``pos`` counts all of them. Null and
    empty strings give no row.
    """
    keep = [c for c in df.columns if c != layout_col]
    segments = df.select(*keep, F.posexplode(F.split(F.col(layout_col), r"\[(?:PAIR|RELATION)_SEP\]")).alias("pos", "_segment"))
    segments = segments.filter(F.col("_segment").rlike(_BOX) & F.col("_segment").rlike(_LABEL))
    box = [F.regexp_extract("_segment", _BOX, i + 1).cast("double").alias(c) for i, c in enumerate(("x1", "y1", "x2", "y2"))]
    return segments.select(*keep, "pos", *box, F.trim(F.regexp_extract("_segment", _LABEL, 1)).alias("label"))


def to_original(box: Column, padded_w: Column, padded_h: Column, width: Column, height: Column) -> Column:
    """A box of a padded image in the coordinates of the image inside it, clamped, at least a pixel wide and high."""
    left, top = F.floor((padded_w - width) / 2).cast("int"), F.floor((padded_h - height) / 2).cast("int")
    x1, y1 = F.greatest(F.lit(0), box["x1"] - left), F.greatest(F.lit(0), box["y1"] - top)
    x2, y2 = F.least(width, box["x2"] - left), F.least(height, box["y2"] - top)
    x2 = F.when(x2 <= x1, F.least(x1 + 1, width)).otherwise(x2)
    y2 = F.when(y2 <= y1, F.least(y1 + 1, height)).otherwise(y2)
    return F.struct(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"))


def pixel_boxes(boxes: Column, width: int, height: int, side: float = 896.0) -> Column:
    """An ordered array of boxes of a ``side`` x ``side`` space in pixels, each pushed below the one
    before it where the two overlap. A fold over the array, as every box depends on the last."""
    kind = "struct<done:array<struct<x1:int,y1:int,x2:int,y2:int>>,last:struct<x1:int,y1:int,x2:int,y2:int>>"
    clamp = lambda v, hi: F.greatest(F.lit(0), F.least(v, F.lit(hi)))
    scaled = lambda v, n: F.bround(v / side * n).cast("int")
    make = lambda a, b, c, d: F.struct(a.alias("x1"), b.alias("y1"), c.alias("x2"), d.alias("y2"))

    def box(b: Column) -> Column:
        x1, y1 = clamp(scaled(b["x1"], width), width - 1), clamp(scaled(b["y1"], height), height - 1)
        x2, y2 = clamp(scaled(b["x2"], width) + 1, width), clamp(scaled(b["y2"], height) + 1, height)
        return make(x1, y1, F.when(x2 <= x1, F.least(x1 + 1, F.lit(width))).otherwise(x2), F.when(y2 <= y1, F.least(y1 + 1, F.lit(height))).otherwise(y2))

    def step(s: Column, b: Column) -> Column:
        p = s["last"]
        meets = p.isNotNull() & (b["x1"] < p["x2"]) & (b["x2"] > p["x1"]) & (b["y1"] < p["y2"]) & (b["y2"] > p["y1"])
        top = F.when(meets, F.least(p["y2"], F.lit(height - 1))).otherwise(b["y1"])
        now = make(b["x1"], top, b["x2"], F.when(meets & (b["y2"] <= top), F.least(top + 1, F.lit(height))).otherwise(b["y2"]))
        return F.struct(F.concat(s["done"], F.array(now)).alias("done"), now.alias("last"))

    start = F.struct(F.array().cast("array<struct<x1:int,y1:int,x2:int,y2:int>>").alias("done"), F.lit(None).cast("struct<x1:int,y1:int,x2:int,y2:int>").alias("last")).cast(kind)
    return F.aggregate(F.transform(boxes, box), start, step, lambda s: s["done"])
