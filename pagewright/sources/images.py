"""Page images: reading them, and the share of white pixels."""

from __future__ import annotations

from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# A channel from here on is white; images are halved to at most so many pixels a side.
WHITE = 250
SAMPLE_SIDE = 200


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Decoded images below a path: origin, width, height, nChannels, data; a broken file has height -1."""
    return spark.read.format("image").load(path).select("image.*")


def white_share(data: bytes | None, width: int, height: int, channels: int) -> float:
    """The share of pixels whose colour channels are all white, after halving by means; 0 for no image."""
    if not data or width < 1 or height < 1 or len(data) != width * height * channels:
        return 0.0
    pixels = np.frombuffer(data, np.uint8).reshape(height, width, channels).astype(np.float64)
    pixels = pixels[:, :, :3] if channels > 3 else pixels
    while max(pixels.shape[:2]) > SAMPLE_SIDE:
        rows, columns = (max(2, n - n % 2) for n in pixels.shape[:2])
        pixels = np.resize(pixels, (max(rows, 2), columns, pixels.shape[2])) if pixels.shape[0] < 2 or pixels.shape[1] < 2 else pixels[:rows, :columns]
        pixels = pixels.reshape(rows // 2, 2, columns // 2, 2, -1).mean(axis=(1, 3))
    return float((np.floor(pixels) >= WHITE).all(axis=2).mean())


@F.arrow_udf(DoubleType())
def _white(data: pa.Array, width: pa.Array, height: pa.Array, channels: pa.Array) -> pa.Array:
    rows = zip(data, width.to_pylist(), height.to_pylist(), channels.to_pylist())
    return pa.array([white_share(d.as_py(), w or 0, h or 0, c or 0) for d, w, h, c in rows], pa.float64())


def white_ratio(data: Column, width: Column, height: Column, channels: Column) -> Column:
    return _white(data, width, height, channels)


def crop_file(spark: SparkSession, source: Path, box: tuple[int, int, int, int], target: Path) -> bool:
    """Write a box (x0, y0, x1, y1) of a JPEG file, clamped to the image, as a JPEG file; False if it is empty or the image is broken."""
    jvm = spark.sparkContext._jvm
    image = jvm.javax.imageio.ImageIO.read(jvm.java.io.File(str(source)))
    if image is None:
        return False
    x0, y0, x1, y1 = max(0, box[0]), max(0, box[1]), min(image.getWidth(), box[2]), min(image.getHeight(), box[3])
    if x1 <= x0 or y1 <= y0:
        return False
    target.parent.mkdir(parents=True, exist_ok=True)
    return jvm.javax.imageio.ImageIO.write(image.getSubimage(x0, y0, x1 - x0, y1 - y0), "jpg", jvm.java.io.File(str(target)))


def crop(data: bytes, width: int, height: int, channels: int, box: tuple[int, int, int, int]) -> bytes:
    """The pixels of a clamped box (x0, y0, x1, y1); empty if the box is."""
    x0, y0, x1, y1 = box
    pixels = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    return pixels[max(0, y0) : max(0, min(height, y1)), max(0, x0) : max(0, min(width, x1))].tobytes()
