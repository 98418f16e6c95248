"""Polygons of ESRI shapefiles (.shp), one row per shape: ``shape`` (its number) and ``geometry``."""

from __future__ import annotations

import itertools
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def polygons(content: bytes) -> Iterator[tuple[int, list[list[tuple[float, float]]]]]:
    """(number, rings of (x, y)) of every polygon in the file's bytes, one after the other; other shapes are left out."""
    at = 100  # after the file's header
    while at + 12 <= len(content):
        number, words = struct.unpack_from(">ii", content, at)
        (kind,) = struct.unpack_from("<i", content, at + 8)
        if kind in (5, 15, 25):
            parts, points = struct.unpack_from("<ii", content, at + 44)
            heads = [*struct.unpack_from(f"<{parts}i", content, at + 52), points]
            flat = struct.unpack_from(f"<{2 * points}d", content, at + 52 + 4 * parts)
            corners = list(zip(flat[::2], flat[1::2]))
            yield number, [corners[a:b] for a, b in zip(heads, heads[1:])]
        at += 8 + 2 * words


def read_shapefile(spark: SparkSession, path: str) -> DataFrame:
    """Each file is read by one task, as its records have no fixed place; shapes are handed on 1,000 at a time."""
    raw = spark.read.format("binaryFile").load(path).select("content")
    kind = pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column("content"):
                shapes = polygons(content.as_py())
                while some := list(itertools.islice(shapes, 1000)):
                    rings = [[[{"x": x, "y": y} for x, y in ring] for ring in g] for _, g in some]
                    yield pa.record_batch([pa.array([n for n, _ in some], pa.int32()), pa.array(rings, kind)], names=["shape", "geometry"])

    shapes = raw.mapInArrow(parse, "shape int, geometry array<array<struct<x:double,y:double>>>")
    return shapes.withColumn("tile_ID", F.col("shape").cast("string"))
