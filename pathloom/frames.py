"""Trajectories and flows as immutable wrappers: a DataFrame, its reference system and the record of what was done to it."""

from __future__ import annotations

import dataclasses
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom import schema
from pathloom.operators import preprocess, spatial

DEFAULT_CRS = {"init": "epsg:4326"}


@dataclasses.dataclass(frozen=True)
class Trajectories:
    """Points of moving individuals. Derived frames keep ``crs`` and ``parameters`` as long as they keep the required columns."""

    df: DataFrame
    crs: dict = dataclasses.field(default_factory=lambda: dict(DEFAULT_CRS))
    parameters: dict = dataclasses.field(default_factory=dict)

    def __post_init__(self):
        if not isinstance(self.df, DataFrame):
            raise TypeError("df must be a DataFrame")
        if not isinstance(self.crs, dict):
            raise TypeError("crs must be a dict")
        if not isinstance(self.parameters, dict):
            raise AttributeError("parameters must be a dict")

    @staticmethod
    def of(data: Any, spark: SparkSession | None = None, latitude="lat", longitude="lng", datetime="datetime", user_id="uid", trajectory_id="tid", timestamp: bool = False, crs: dict | None = None, parameters: dict | None = None) -> Trajectories:
        """From a DataFrame, a pandas frame, a dict of columns or a list of rows (then the columns are given as positions).
        Columns are renamed and typed; ``timestamp``: datetimes are seconds since 1970."""
        if not isinstance(data, DataFrame):
            import pandas as pd

            spark = spark or SparkSession.getActiveSession()
            if not isinstance(data, (dict, list, pd.DataFrame)):
                raise TypeError(f"can't make trajectories of {type(data).__name__}")
            frame = data if isinstance(data, pd.DataFrame) else pd.DataFrame(data)
            data = spark.createDataFrame(frame.rename(columns=str))
        names = {str(latitude): "lat", str(longitude): "lng", str(datetime): "datetime", str(user_id): "uid", str(trajectory_id): "tid"}
        df = data.withColumnsRenamed({a: b for a, b in names.items() if a in data.columns and a != b})
        if schema.has_trajectory_columns(df):
            when = F.timestamp_seconds(F.col("datetime").cast("double")) if timestamp else F.col("datetime")
            df = df.withColumns({"lat": F.col("lat").cast("double"), "lng": F.col("lng").cast("double"), "datetime": when.cast("timestamp_ntz")})
        return Trajectories(df, crs or dict(DEFAULT_CRS), parameters or {})

    def with_df(self, df: DataFrame, **done) -> Trajectories | DataFrame:
        """A derived frame; the plain DataFrame where a required column is lost."""
        if not schema.has_trajectory_columns(df):
            return df
        return dataclasses.replace(self, df=df, parameters={**self.parameters, **done})

    def select(self, *columns):
        return self.with_df(self.df.select(*columns))

    def where(self, condition):
        return self.with_df(self.df.where(condition))

    def join(self, other: DataFrame, on, how: str = "inner"):
        return self.with_df(self.df.join(other, on, how))

    def union(self, other: Trajectories | DataFrame):
        """The rows of both, columns matched by name; what was done to this one stays on record."""
        return self.with_df(self.df.unionByName(other if isinstance(other, DataFrame) else other.df, allowMissingColumns=True))

    def distinct(self, columns: list[str] | None = None):
        return self.with_df(self.df.dropDuplicates(columns) if columns else self.df.distinct())

    def order_by(self, *columns):
        return self.with_df(self.df.orderBy(*columns))

    def with_column(self, name: str, value):
        return self.with_df(self.df.withColumn(name, value))

    def set_parameter(self, key: str, value) -> Trajectories:
        return dataclasses.replace(self, parameters={**self.parameters, key: value})

    def set_crs(self, crs: dict) -> Trajectories:
        """The same positions under the name of another reference system (nothing is projected)."""
        return dataclasses.replace(self, crs=dict(crs))

    def settings_from(self, other: Trajectories) -> Trajectories:
        return dataclasses.replace(self, crs=dict(other.crs), parameters=dict(other.parameters))

    def column(self, name: str):
        if name not in self.df.columns:
            raise AttributeError(f"there is no column {name}")
        return self.df[name]

    lat = property(lambda self: self.column("lat"))
    lng = property(lambda self: self.column("lng"))
    datetime = property(lambda self: self.column("datetime"))

    def sort(self) -> Trajectories:
        keys = [c for c in ("uid", "tid") if c in self.df.columns]
        return self.with_df(self.df.orderBy(*keys, "datetime"))

    def to_points(self) -> DataFrame:
        return self.df.withColumn("geometry", F.struct(F.col("lng").alias("x"), F.col("lat").alias("y")))

    def filter(self, **kw) -> Trajectories:
        return self.with_df(preprocess.filter_speed(self.df, **kw), filter=kw)

    def compress(self, spatial_radius_km: float = 0.2) -> Trajectories:
        return self.with_df(preprocess.compress(self.df, spatial_radius_km), compress={"spatial_radius_km": spatial_radius_km})

    def stay_locations(self, spatial_radius_km: float | None = 0.2, **kw) -> Trajectories:
        before = self.parameters.get("compress", {}).get("spatial_radius_km")
        return self.with_df(preprocess.stay_locations(self.df, spatial_radius_km=spatial_radius_km, compress_radius_km=before, **kw), detect={"spatial_radius_km": spatial_radius_km, **kw})

    def cluster(self, **kw) -> Trajectories:
        return self.with_df(preprocess.cluster(self.df, **kw), cluster=kw)

    def map_to(self, tiles: DataFrame, tile_id: str = "tile_ID", remove_na: bool = False) -> Trajectories:
        """With the tile of each point: the one that holds it, or of tiles without rings the nearest."""
        if "geometry" in tiles.columns:
            return self.with_df(spatial.map_to_tiles(self.df, tiles, tile_id, remove_na))
        return self.with_df(spatial.nearest_tile(self.df, tiles, tile_id))

    def to_flows(self, tiles: DataFrame, tile_id: str = "tile_ID", self_loops: bool = True) -> Flows:
        return Flows(spatial.to_flows(self.map_to(tiles, tile_id).df, self_loops), tiles, tile_id, dict(self.parameters))

    def convert_timezone(self, source: str, target: str) -> Trajectories:
        return self.with_df(self.df.withColumn("datetime", F.convert_timezone(F.lit(source), F.lit(target), F.col("datetime"))))


@dataclasses.dataclass(frozen=True)
class Flows:
    """Flows between tiles, with the tiles."""

    df: DataFrame
    tiles: DataFrame
    tile_id: str = "tile_ID"
    parameters: dict = dataclasses.field(default_factory=dict)

    def __post_init__(self):
        if not isinstance(self.tiles, DataFrame):
            raise TypeError("flows need their tiles")

    @staticmethod
    def of(df: DataFrame, tiles: DataFrame, origin="origin", destination="destination", flow="flow", datetime="datetime", tile_id="tile_ID", timestamp: bool = False, parameters: dict | None = None) -> Flows:
        """Columns are renamed and typed; an origin or destination that is no tile is an error."""
        if not isinstance(tiles, DataFrame):
            raise TypeError("flows need their tiles")
        names = {origin: "origin", destination: "destination", flow: "flow", datetime: "datetime"}
        df = df.withColumnsRenamed({a: b for a, b in names.items() if a in df.columns and a != b})
        df = df.withColumns({c: F.col(c).cast("string") for c in ("origin", "destination")})
        if timestamp and "datetime" in df.columns:
            df = df.withColumn("datetime", F.timestamp_seconds(F.col("datetime").cast("double")).cast("timestamp_ntz"))
        spatial.check_flows(df, tiles, tile_id)
        return Flows(df, tiles, tile_id, parameters or {})

    def with_df(self, df: DataFrame) -> Flows | DataFrame:
        """Derived flows; the plain DataFrame where a required column is lost."""
        return dataclasses.replace(self, df=df) if schema.has_flow_columns(df) else df

    def select(self, *columns):
        return self.with_df(self.df.select(*columns))

    def where(self, condition):
        return self.with_df(self.df.where(condition))

    def join(self, other: DataFrame, on, how: str = "inner"):
        return self.with_df(self.df.join(other, on, how))

    def union(self, other: Flows | DataFrame):
        return self.with_df(self.df.unionByName(other if isinstance(other, DataFrame) else other.df, allowMissingColumns=True))

    def distinct(self, columns: list[str] | None = None):
        return self.with_df(self.df.dropDuplicates(columns) if columns else self.df.distinct())

    def set_parameter(self, key: str, value) -> Flows:
        return dataclasses.replace(self, parameters={**self.parameters, key: value})

    def get_flow(self, origin: str, destination: str) -> DataFrame:
        return spatial.flow_between(self.df, self.tiles, origin, destination, self.tile_id)

    def get_geometry(self, tile: str) -> DataFrame:
        return self.tiles.where(F.col(self.tile_id).cast("string") == tile).select(F.col(self.tile_id), "geometry")

    def to_matrix(self) -> DataFrame:
        return spatial.flow_matrix(self.df, self.tiles, self.tile_id)

    def settings_from(self, other: Flows) -> Flows:
        return dataclasses.replace(self, parameters=dict(other.parameters))
