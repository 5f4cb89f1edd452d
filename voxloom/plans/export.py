"""From class scores on the network's grid to a segmentation of the whole image."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.operators import masking, resample, tiles
from voxloom.operators.geometry import Dims, keep_axis
from voxloom.support import ZYX


def export_segmentation(scores: DataFrame, keys: Sequence[str], old: Dims, new: Dims,
                        boxes: DataFrame, cls: str = "class", p: str = "p", regions: Sequence[int] | None = None,
                        separate: int | None = None, postprocess: Callable[[DataFrame], DataFrame] | None = None,
                        ) -> DataFrame:
    """Label voxels (keys, z, y, x, label) in the uncropped image; background is absent.

    Scores are resampled from shape ``old`` to the cropped case's shape ``new``,
    linearly, or nearest along a ``separate`` low-resolution axis.  The class of
    the highest score wins, or with ``regions`` codes are painted in that order
    where a region's score is above one half.  ``postprocess`` sees the labels
    before they are put back at their box.  Absent scores are 0.  Shapes are
    those of all cases, or geometry tables.
    """
    middle = new if separate is None else keep_axis(new, old, separate, keys)
    dense = resample.resample_linear(scores, [*keys, cls], p, old, middle, within=keys)
    if separate is not None:
        dense = resample.resample_nearest(dense, middle, new, keys)
    # sums of the same shares in another order must not decide ties
    dense = dense.withColumn(p, F.round(p, 9))
    place = [*keys, *ZYX]
    if regions is None:
        labels = tiles.argmax_class(dense, place, cls, p).select(*place, F.col(cls).alias("label"))
    else:
        labels = tiles.region_paint(dense, place, cls, p, regions)
    labels = labels.where(F.col("label") != 0)
    if postprocess is not None:
        labels = postprocess(labels)
    return masking.uncrop(labels, boxes, keys)
