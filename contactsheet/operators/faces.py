"""Boxes and landmarks of faces: suppression of overlapping boxes, alignment, pose and quality."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: boxes of one face overlap by more than this.
OVERLAP = 0.4


def suppress(boxes: DataFrame, key: str = "photo_id", *, most: float = OVERLAP) -> DataFrame:
    """Of each photo's boxes, from the highest score down (ties to the lower id), those that overlap none kept before
    by more than ``most``. ``boxes`` (key, id, x1, y1, x2, y2, score), corners inclusive; rows with a null among them take no
    part; a null key is a photo. A photo's boxes are walked in one task, photos one after the other: what is held is the
    boxes kept of one photo."""
    rows = boxes.select(key, "id", "x1", "y1", "x2", "y2", "score").na.drop(subset=["id", "x1", "y1", "x2", "y2", "score"])

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, kept, areas = object(), np.zeros((0, 4)), np.zeros(0)
        for frame in frames:
            stays = np.zeros(len(frame), bool)
            corners = frame[["x1", "y1", "x2", "y2"]].to_numpy(np.float64)
            for i, photo in enumerate(frame[key]):
                photo = None if pd.isna(photo) else photo
                if photo != now:
                    now, kept, areas = photo, np.zeros((0, 4)), np.zeros(0)
                box = corners[i]
                area = (box[2] - box[0] + 1) * (box[3] - box[1] + 1)
                across = np.minimum(kept[:, 2], box[2]) - np.maximum(kept[:, 0], box[0]) + 1
                down = np.minimum(kept[:, 3], box[3]) - np.maximum(kept[:, 1], box[1]) + 1
                both = np.maximum(across, 0) * np.maximum(down, 0)
                if (both / (areas + area - both) <= most).all():
                    stays[i] = True
                    kept, areas = np.vstack([kept, box]), np.append(areas, area)
            yield frame[stays]

    ordered = rows.repartition(key).sortWithinPartitions(F.col(key), F.col("score").desc(), F.col("id"))
    return ordered.mapInPandas(walk, rows.schema)


def similarity(points: list[tuple[Column, Column]], wanted: list[tuple[float, float]]) -> Column:
    """Struct (a, b, tx, ty): the turn, scale and shift that brings landmarks nearest to where they are wanted, by least
    squares: (x, y) goes to (a x - b y + tx, b x + a y + ty). Landmarks that are one point are shifted only."""
    n = len(points)
    mx, my = sum((x for x, _ in points), F.lit(0.0)) / n, sum((y for _, y in points), F.lit(0.0)) / n
    wx, wy = sum(x for x, _ in wanted) / n, sum(y for _, y in wanted) / n
    own = [(x - mx, y - my) for x, y in points]
    there = [(x - wx, y - wy) for x, y in wanted]
    spread = sum((x * x + y * y for x, y in own), F.lit(0.0))
    a = sum((x * u + y * v for (x, y), (u, v) in zip(own, there, strict=True)), F.lit(0.0))
    b = sum((x * v - y * u for (x, y), (u, v) in zip(own, there, strict=True)), F.lit(0.0))
    a, b = F.when(spread > 0, F.try_divide(a, spread)).otherwise(1.0), F.when(spread > 0, F.try_divide(b, spread)).otherwise(0.0)
    return F.struct(a.alias("a"), b.alias("b"), (F.lit(wx) - a * mx + b * my).alias("tx"), (F.lit(wy) - b * mx - a * my).alias("ty"))


def yaw(left: tuple[Column, Column], right: tuple[Column, Column], nose: tuple[Column, Column]) -> Column:
    """How far the nose is from between the eyes, in distances of the eyes: about 0 from the front, beyond 0.5 in profile;
    1 where the eyes are one point."""
    apart = F.sqrt(F.pow(right[0] - left[0], F.lit(2)) + F.pow(right[1] - left[1], F.lit(2)))
    turned = F.try_divide(nose[0] - (left[0] + right[0]) / 2, apart)
    return F.when(apart < 1e-3, 1.0).otherwise(F.greatest(F.lit(-1.5), F.least(F.lit(1.5), turned)))


def quality(score: Column, size: Column, sharpness: Column, turned: Column, norm: Column) -> Column:
    """0 to 1, how well a face can be recognised: by its detection, size, sharpness, pose and the length of its vector."""
    within = lambda x: F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))
    sharp = within((F.log10(F.greatest(sharpness, F.lit(1.0))) - 1.0) / 1.6)
    pose = F.greatest(F.lit(0.0), 1.0 - F.abs(turned) / 0.9)
    return F.round(0.2 * within((score - 0.5) / 0.35) + 0.2 * within((size - 16) / 64) + 0.15 * sharp + 0.2 * pose + 0.25 * within((norm - 8.0) / 14.0), 4)
