"""Reserved column names and schema tests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# The reserved column names.
UID, TID, LAT, LNG, DATETIME = "uid", "tid", "lat", "lng", "datetime"
ORIGIN, DESTINATION, FLOW, TILE_ID = "origin", "destination", "flow", "tile_ID"
CLUSTER, LEAVING = "cluster", "leaving_datetime"

#: Rings of {x, y} in degrees: the first is the border, later ones are holes.
GEOMETRY = T.ArrayType(T.ArrayType(T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])))


def has_trajectory_columns(df: DataFrame) -> bool:
    return {LAT, LNG, DATETIME} <= set(df.columns)


def is_trajectory(df: DataFrame) -> bool:
    """Whether the required columns are there with their types."""
    if not has_trajectory_columns(df):
        return False
    kinds = {f.name: f.dataType for f in df.schema}
    return all(isinstance(kinds[c], T.DoubleType) for c in (LAT, LNG)) and isinstance(kinds[DATETIME], (T.TimestampType, T.TimestampNTZType))


def has_flow_columns(df: DataFrame) -> bool:
    return {ORIGIN, DESTINATION, FLOW} <= set(df.columns)


def is_flow(df: DataFrame) -> bool:
    if not has_flow_columns(df):
        return False
    kinds = {f.name: f.dataType for f in df.schema}
    return all(isinstance(kinds[c], T.StringType) for c in (ORIGIN, DESTINATION)) and isinstance(kinds[FLOW], T.NumericType)


def is_multi_user(df: DataFrame) -> bool:
    """Whether the frame has more than one ``uid`` (at most two are looked for)."""
    return UID in df.columns and df.select(UID).distinct().limit(2).count() > 1


def is_multi_trajectory(df: DataFrame) -> bool:
    return TID in df.columns and df.select(TID).distinct().limit(2).count() > 1


def user_keys(df: DataFrame) -> list[str]:
    """The column of individuals, or none: then the whole frame is one."""
    return [UID] if UID in df.columns else []
