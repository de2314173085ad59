"""Tile grids over frames and the tiles a box falls into."""

import math

from pyspark.sql import Column, functions as F

from flowlattice.functions.geometry import box


def tile_step(size, overlap):
    return max(1, int(size * (1 - overlap)))


def tile_count(extent, size, overlap):
    """Tiles along one side when edge slivers are not cut (a planning estimate)."""
    return math.ceil((extent - size) / tile_step(size, overlap)) + 1 if size < extent else 1


def tile_grid(frames, size_w=512, size_h=512, overlap=0.2):
    """One row per tile of every frame size; frames need frame_width and frame_height."""
    w, h = F.col("frame_width"), F.col("frame_height")
    sx, sy = tile_step(size_w, overlap), tile_step(size_h, overlap)

    def starts(extent, step):
        return F.when(extent > 0, F.sequence(F.lit(0), extent - 1, F.lit(step))).otherwise(
            F.array().cast("array<int>"))

    columns = frames.select("*", F.posexplode(starts(w, sx)).alias("tile_col", "tx1"))
    cells = columns.select("*", F.posexplode(starts(h, sy)).alias("tile_row", "ty1"))
    return cells.withColumn("tx2", F.least(F.col("tx1") + size_w, w)).withColumn(
        "ty2", F.least(F.col("ty1") + size_h, h))


def tiles_of_box(dets, width, height, size_w=512, size_h=512, overlap=0.2):
    """One row per (box, tile it overlaps). The tile numbers follow from the coordinates. The frame's size may be columns of `dets`."""
    b = box()
    width, height = (v if isinstance(v, Column) else F.lit(v) for v in (width, height))

    def numbers(low, high, size, extent):
        step = tile_step(size, overlap)
        first = F.greatest(F.lit(0).cast("bigint"), F.floor((low - size) / F.lit(float(step))) + 1)
        last = F.least(F.ceil(extent / F.lit(float(step))).cast("bigint") - 1,
                       F.ceil(high / F.lit(float(step))) - 1)
        return F.when((first <= last) & (low < extent), F.sequence(first, last)).otherwise(
            F.array().cast("array<bigint>"))

    rows = dets.select("*", F.explode(numbers(b.x1, b.x2, size_w, width)).alias("tile_col"))
    return rows.select("*", F.explode(numbers(b.y1, b.y2, size_h, height)).alias("tile_row"))


def merge_tiles(boxes, scale=1.0):
    """Boxes found inside tiles (with tile origin tx1, ty1) back in frame pixels."""
    from flowlattice.functions.geometry import crop_to_frame

    moved = crop_to_frame(box(), F.lit(float(scale)), F.col("tx1"), F.col("ty1"))
    return boxes.withColumns(dict(zip(("x1", "y1", "x2", "y2"), moved)))
