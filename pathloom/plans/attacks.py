"""Queries for the attacks on privacy, each over all individuals of the event table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pathloom.operators import privacy as p
from pathloom.plans.trajectories import TRAJ_SQL, rounded, trajectories

QUERIES: dict = {}
ORACLE: dict = {}

_PAIRS = f"WITH {TRAJ_SQL}, q AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY datetime, lat, lng) AS i FROM traj), v AS (SELECT uid, lat, lng, count(*)::DOUBLE AS f, count(*) / sum(count(*)) OVER (PARTITION BY uid) AS p FROM traj GROUP BY uid, lat, lng)"
_RISK = "SELECT uid, round(max(r), 6) AS risk FROM (SELECT uid, 1.0::DOUBLE / count(*) OVER (PARTITION BY {0}) AS r FROM own) GROUP BY uid"
_LESS = "(a.lat, a.lng) < (b.lat, b.lng)"


def _attack(name: str, attack, own: str | None, by: str | None) -> None:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        return rounded(attack().assess_risk(trajectories(spark, folder)))

    QUERIES[name] = query
    if own:
        ORACLE[name] = f"{_PAIRS}, own AS ({own}) {_RISK.format(by)}"


_XY = "a.uid, a.lat AS a1, a.lng AS a2, b.lat AS b1, b.lng AS b2"
_BY = "a1, a2, b1, b2"
_attack(
    "attack_location_k2", lambda: p.LocationAttack(2),
    "SELECT DISTINCT a.uid, least((a.lat, a.lng), (b.lat, b.lng)) AS x, greatest((a.lat, a.lng), (b.lat, b.lng)) AS y FROM q a JOIN q b ON a.uid = b.uid AND a.i < b.i", "x, y",
)
_attack("attack_sequence_k2", lambda: p.LocationSequenceAttack(2), f"SELECT DISTINCT {_XY} FROM q a JOIN q b ON a.uid = b.uid AND a.i < b.i", _BY)
_attack(
    "attack_time_k2", lambda: p.LocationTimeAttack(2, "Hour"),
    "SELECT DISTINCT a.uid, least((a.lat, a.lng, date_trunc('hour', a.datetime)), (b.lat, b.lng, date_trunc('hour', b.datetime))) AS x, greatest((a.lat, a.lng, date_trunc('hour', a.datetime)), (b.lat, b.lng, date_trunc('hour', b.datetime))) AS y FROM q a JOIN q b ON a.uid = b.uid AND a.i < b.i", "x, y",
)
_attack("attack_unique_k2", lambda: p.UniqueLocationAttack(2), f"SELECT {_XY} FROM v a JOIN v b ON a.uid = b.uid AND {_LESS}", _BY)
_attack("attack_frequency_k2", lambda: p.LocationFrequencyAttack(2), f"SELECT {_XY}, a.f AS fa, b.f AS fb FROM v a JOIN v b ON a.uid = b.uid AND {_LESS}", f"{_BY}, fa, fb")
_attack("attack_probability_k2", lambda: p.LocationProbabilityAttack(2), f"SELECT {_XY}, a.p AS fa, b.p AS fb FROM v a JOIN v b ON a.uid = b.uid AND {_LESS}", f"{_BY}, fa, fb")
_attack("attack_proportion_k2", lambda: p.LocationProportionAttack(2), f"SELECT {_XY}, a.f / greatest(a.f, b.f) AS fa, b.f / greatest(a.f, b.f) AS fb FROM v a JOIN v b ON a.uid = b.uid AND {_LESS}", f"{_BY}, fa, fb")
_RANKED = "(SELECT * FROM (SELECT uid, lat, lng, row_number() OVER (PARTITION BY uid ORDER BY f, lat, lng) AS r FROM v) WHERE r = {})"
_attack("attack_homework", p.HomeWorkAttack, f"SELECT a.uid, least((a.lat, a.lng), (b.lat, b.lng)) AS x, greatest((a.lat, a.lng), (b.lat, b.lng)) AS y FROM {_RANKED.format(1)} a JOIN {_RANKED.format(2)} b ON a.uid = b.uid", "x, y")
_attack("attack_frequency_tolerance", lambda: p.LocationFrequencyAttack(1, 0.5), None, None)
ORACLE["attack_frequency_tolerance"] = f"""{_PAIRS}, met AS (SELECT a.uid, a.lat, a.lng, count(*) AS n FROM v a JOIN v b ON a.lat = b.lat AND a.lng = b.lng AND a.f >= b.f - b.f * 0.5::DOUBLE AND a.f <= b.f + b.f * 0.5::DOUBLE GROUP BY ALL)
 SELECT uid, round(max(1.0::DOUBLE / n), 6) AS risk FROM met GROUP BY uid"""
