"""Density grids with exponential decay, kept sparse."""

import math

from pyspark.sql import functions as F

from flowlattice.operators.lives import last_frames
from flowlattice.schemas import RUN_CAMERA

_LONGEST_BLOCK_BITS = 12
_LEAST_WEIGHT = 1e-290


def _block_bits(decay):
    """Blocks so short that the weight of their first frame stays within the range of a double."""
    if not 0.0 < decay <= 1.0:
        raise ValueError("decay must be above 0 and at most 1")
    if decay == 1.0:
        return _LONGEST_BLOCK_BITS
    frames = math.log(_LEAST_WEIGHT) / math.log(decay)
    return max(0, min(_LONGEST_BLOCK_BITS, int(math.log2(frames))))


def on_frames(rows, cameras):
    """`rows` with the frame size of their camera, from a table (run_id, camera_id, frame_width, frame_height)."""
    return rows.join(cameras.select(*RUN_CAMERA, "frame_width", "frame_height"), list(RUN_CAMERA))


def heat_grid(obs, width=None, height=None, decay=0.995, ends=None, cameras=None):
    """Weight per (camera, pixel): every hit counts decay^(last frame - frame).

    The frame has `width` and `height`, or what `cameras` (see `on_frames`) says of each camera.

    Hits are summed per block of frames first, relative to the block's end, so a busy pixel is
    reduced before anything is shuffled; only the block sums meet the last frame of the run. Take
    `ends` (run_id, camera_id, last_frame_of_run) from run metadata to save a pass.
    """
    ends = last_frames(obs) if ends is None else ends
    if cameras is not None:
        obs, width, height = on_frames(obs, cameras), F.col("frame_width"), F.col("frame_height")
    bits = _block_bits(decay)
    block_end = F.shiftleft(F.shiftright("frame", bits) + 1, bits)
    hits = obs.filter(F.col("cx").between(0, width - 1) & F.col("cy").between(0, height - 1))
    blocks = hits.groupBy(*RUN_CAMERA, F.col("cx").alias("x"), F.col("cy").alias("y"),
                          block_end.alias("_end")).agg(
        F.sum(F.pow(F.lit(decay), (block_end - F.col("frame")).cast("double"))).alias("_sum"))
    shifted = F.col("_sum") * F.pow(F.lit(decay), (
        F.col("last_frame_of_run") - F.col("_end")).cast("double"))
    return blocks.join(ends, list(RUN_CAMERA)).groupBy(*RUN_CAMERA, "x", "y").agg(
        F.sum(shifted).alias("weight"))


def gaussian_kernel(size=31, sigma=5.0):
    half = size // 2
    raw = [math.exp(-(i * i) / (2.0 * sigma * sigma)) for i in range(-half, half + 1)]
    total = sum(raw)
    return [v / total for v in raw]


def default_sigma(size):
    """The published rule for a Gaussian given only its size."""
    return 0.3 * ((size - 1) * 0.5 - 1) + 0.8


def _spread(grid, axis, other, extent, kernel, cameras=None):
    """One pass of the separable stencil; weights beyond an edge are reflected at its pixel."""
    half = len(kernel) // 2
    if cameras is not None:
        grid, extent = on_frames(grid, cameras), F.col(extent)
    taps = F.array(*(F.struct(F.lit(i - half).alias("offset"), F.lit(k).alias("k"))
                     for i, k in enumerate(kernel)))
    # A source at s feeds target t with weight k(t - s), and again through its mirror images.
    last = extent - 1 if cameras is not None else F.lit(extent - 1)
    at, offset = F.col(axis), F.col("offset")
    targets = F.filter(F.array(
        at + offset,
        F.when((at > 0) & (at <= half), -at + offset),
        F.when((at < last) & (at >= last - half), 2 * last - at + offset),
    ), lambda t: t.between(0, last))
    extents = ("frame_width", "frame_height") if cameras is not None else ()
    spread = grid.select(*RUN_CAMERA, *extents, axis, other, "weight", F.inline(taps)).select(
        *RUN_CAMERA, other, "weight", "k", F.explode(targets).alias("_t"))
    return spread.groupBy(*RUN_CAMERA, F.col("_t").alias(axis), other).agg(
        F.sum(F.col("weight") * F.col("k")).alias("weight"))


def heat_smooth(grid, width=None, height=None, size=31, sigma=None, keep=0.05, cameras=None):
    """Gaussian blur, scaled by the camera's peak (at least 1), cells above `keep` only.

    With `cameras` every camera has its own frame size; a frame must be larger than half the kernel.
    """
    size |= 1
    if cameras is not None:
        width, height = "frame_width", "frame_height"
        cameras = cameras.filter(F.least(width, height) > size // 2)
    elif size // 2 >= min(width, height):
        raise ValueError("kernel must be smaller than the frame")
    kernel = gaussian_kernel(size, default_sigma(size) if sigma is None else sigma)
    blurred = _spread(_spread(grid, "x", "y", width, kernel, cameras), "y", "x", height, kernel, cameras)
    # A camera is at most as many rows as its frame has pixels; its peak is a partial maximum.
    peaks = blurred.groupBy(*RUN_CAMERA).agg(F.greatest(F.max("weight"), F.lit(1.0)).alias("_peak"))
    return blurred.join(peaks, list(RUN_CAMERA)).select(
        *RUN_CAMERA, "x", "y", (F.col("weight") / F.col("_peak")).alias("level")).filter(F.col("level") > keep)
