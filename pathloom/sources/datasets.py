"""A catalog of datasets: each has a builder that makes a frame from files that are already there (nothing is downloaded)."""

from __future__ import annotations

import dataclasses
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.frames import Trajectories
from pathloom.operators import spatial, tessellation
from pathloom.sources import files

_CATALOG: dict[str, Dataset] = {}


@dataclasses.dataclass(frozen=True)
class Dataset:
    name: str
    data_type: str
    description: str
    prepare: Callable[[SparkSession, str], object]


def register(name: str, data_type: str, description: str):
    """Adds a builder ``prepare(spark, path)`` to the catalog."""

    def add(prepare):
        _CATALOG[name] = Dataset(name, data_type, description, prepare)
        return prepare

    return add


def list_datasets(details: bool = False, data_types: list[str] | None = None) -> list | dict:
    if data_types is not None and not isinstance(data_types, list):
        raise ValueError("data_types must be a list")
    chosen = {n: d for n, d in sorted(_CATALOG.items()) if data_types is None or d.data_type in data_types}
    return {n: {"data_type": d.data_type, "description": d.description} for n, d in chosen.items()} if details else list(chosen)


def dataset_info(name: str) -> dict:
    if name not in _CATALOG:
        raise ValueError(f"unknown dataset {name!r}")
    d = _CATALOG[name]
    return {"name": d.name, "data_type": d.data_type, "description": d.description}


def load_dataset(spark: SparkSession, name: str, path: str, drop_columns: bool = False):
    """The frame of a dataset from its files in ``path``; with ``drop_columns`` a trajectory keeps only the reserved columns."""
    if not isinstance(name, str) or name not in _CATALOG:
        raise ValueError(f"unknown dataset {name!r}; there are {list_datasets()}")
    if not isinstance(drop_columns, bool):
        raise ValueError("drop_columns must be True or False")
    frame = _CATALOG[name].prepare(spark, path)
    if drop_columns and isinstance(frame, Trajectories):
        frame = frame.select(*[c for c in ("uid", "tid", "lat", "lng", "datetime") if c in frame.df.columns])
    return frame


@register("foursquare_nyc", "trajectory", "check-ins in New York: tab-separated, columns 0 user, 4 latitude, 5 longitude, 7 time in UTC")
def _checkins(spark: SparkSession, path: str) -> Trajectories:
    raw = spark.read.csv(path, sep="\t", encoding="ISO-8859-1")
    raw = raw.toDF(*[str(i) for i in range(len(raw.columns))])
    month = F.regexp_replace("7", r"^\w{3} ", "")
    when = F.try_to_timestamp(F.regexp_replace(month, r"\+0000 ", ""), F.lit("MMM dd HH:mm:ss yyyy"))
    return Trajectories.of(raw.withColumn("7", when), spark, "4", "5", "7", "0")


@register("flow_foursquare_nyc", "flow", "flows of the check-ins between squares of 4 km")
def _checkin_flows(spark: SparkSession, path: str):
    t = _checkins(spark, path)
    b = spatial.bounds(t.df).first()
    return t.to_flows(tessellation.squares(spark, (b["min_lng"], b["min_lat"], b["max_lng"], b["max_lat"]), 4000))


@register("taxi_san_francisco", "trajectory", "a cab's log: space-separated latitude, longitude, occupancy and Unix time, seven hours ahead")
def _cab(spark: SparkSession, path: str) -> Trajectories:
    raw = spark.read.csv(path, sep=" ").toDF("lat", "lng", "occupancy", "time")
    local = F.timestamp_seconds(F.col("time").cast("long") - 7 * 3600)
    return Trajectories.of(raw.withColumn("datetime", local).withColumn("uid", F.regexp_extract(F.col("_metadata.file_name"), r"new_(\w+)\.", 1)).drop("time"), spark)


@register("parking_san_francisco", "auxiliar", "parking meters as they are")
def _parking(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True)


@register("nyc_boundaries", "shape", "boundaries, from a shapefile or GeoJSON")
def _boundaries(spark: SparkSession, path: str) -> DataFrame:
    if path.endswith(".shp"):
        from pathloom.sources.shapefile import read_shapefile

        return read_shapefile(spark, path)
    return files.read_geojson(spark, path)
