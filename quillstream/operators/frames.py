"""Images to observations: locate, crop, test for a gap, score, decide."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import ACCEPT_MARGIN, ACCEPT_P, GAP_RESIDUAL_MAX, GAP_RESIDUAL_NONE_MAX, NONE
from ..functions import vision

#: A scorer takes crops (n, size, size, 3) and gives logits (n, classes).
Scorer = Callable[[np.ndarray], np.ndarray]

OBSERVATION = "status string, x double, y double, residual double, gap boolean, cls int, p double, margin double"


def tensor(crops: np.ndarray) -> np.ndarray:
    """Crops (n, height, width, 3) of bytes as (n, 3, height, width) of 0 to 1, as image networks take them."""
    return np.ascontiguousarray(crops.transpose(0, 3, 1, 2), dtype=np.float32) / 255


def decided(logits: np.ndarray, residual: float) -> tuple[bool, int | None, float, float]:
    """(gap, class, probability, margin) of a scored crop."""
    e = np.exp(logits - logits.max())
    p = e / e.sum()
    best, second = np.argsort(-p, kind="stable")[:2]
    margin = float(p[best] - p[second])
    gap = bool(best == NONE and p[best] >= 0.5 and residual < GAP_RESIDUAL_NONE_MAX)
    sure = p[best] >= ACCEPT_P and margin >= ACCEPT_MARGIN and not gap
    return gap, int(best) if sure else None, float(p[best]), margin


def observe(images: DataFrame, load: Callable[[], Scorer], size: int = 64, keys: tuple[str, ...] = ("img",)) -> DataFrame:
    """keys, width, height, rgb (bytes) -> keys and an observation. ``load`` makes the scorer, once for each task.

    An image is drawn on a raster of fixed width, the frame located on one of half that width, and the crop taken from the
    whole one; x and y are on the raster. Flat crops are gaps and are never scored; the others are scored a batch at a time.
    """
    kinds = ", ".join(f"`{k}` {images.schema[k].dataType.simpleString()}" for k in keys)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = load()
        for frame in frames:
            rows, crops, todo = [], [], []
            for k, (w, h, rgb) in enumerate(zip(frame.width, frame.height, frame.rgb, strict=True)):
                image = vision.work_raster(np.frombuffer(rgb, np.uint8).reshape(h, w, 3))
                status, quad = vision.locate(vision.halved(image))
                quad = None if quad is None else 2 * quad
                crop = vision.cropped(image, quad, size) if quad is not None else vision.centre(image, size)
                residual = vision.texture(crop)
                corner = quad[0] if quad is not None else (None, None)
                rows.append([status, corner[0], corner[1], residual, residual < GAP_RESIDUAL_MAX, None, None, None])
                if residual >= GAP_RESIDUAL_MAX:
                    crops.append(crop)
                    todo.append(k)
            if todo:
                for k, logits in zip(todo, scorer(np.stack(crops)), strict=True):
                    rows[k][4:] = decided(logits, rows[k][3])
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in OBSERVATION.split(", ")])
            yield pd.concat([frame[list(keys)].reset_index(drop=True), out], axis=1)

    return images.mapInPandas(run, f"{kinds}, {OBSERVATION}")


def packed(pixels: DataFrame) -> DataFrame:
    """Pixel rows (img, y, x, r, g, b) to images; an image's pixels are gathered, which its size bounds."""
    byte = lambda c: F.unhex(F.lpad(F.hex(c), 2, "0"))
    ordered = F.array_sort(F.collect_list(F.struct("y", "x", F.concat(byte("r"), byte("g"), byte("b")).alias("c"))))
    rows = pixels.groupBy("img").agg(ordered.alias("p"), (F.max("x") + 1).cast("int").alias("width"), (F.max("y") + 1).cast("int").alias("height"))
    return rows.select("img", "width", "height", F.aggregate("p", F.unhex(F.lit("")), lambda a, x: F.concat(a, x["c"])).alias("rgb"))
