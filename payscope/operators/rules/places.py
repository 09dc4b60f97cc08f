"""Rule 075: how often the debtor has paid from near this place before.

Statistic (ours): settled prior payments of the debtor account within ``maxRadius`` km. Coordinates are compared
as they are; payments at one place are folded to one row per millisecond first. No settled prior payment at all: ``.x01``.

An account's places lie on a grid of cells a radius wide, each divided in four, ``LEVELS`` times. A circle is the sum of
the greatest cells wholly inside it and of the single places that remain in cells it cuts, so a payment asks for a few
running counts however many places its account has near by. That a cell of centre ``c`` lies inside or outside follows
from the distance to ``c`` and a bound on the way from ``c`` to any of its points; only places of cut cells are compared.
"""
from __future__ import annotations

import math
from collections.abc import Mapping
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ...functions import haversine
from ...sources.shared import staged
from ..outcome import outcome, results
from ..timeline import Measure, scan
from .account import fresh

if TYPE_CHECKING:
    from ..kept import Kept

KM_PER_DEGREE = 111.0  # a little under the true length, so that cells are never too small
LONG_DEGREE = 111.2  # a little over it, so that the way to a cell's edge is never too short
LEVELS = 3
SLACK = 1e-6  # km; a cell so close to the circle counts as cut
#: Level of a node that is a single place; its x and y are the place's coordinates.
PLACE = LEVELS + 1


def _band(lat: Column, size: float) -> Column:
    return F.floor(lat / size).cast("int")


def _columns(band: Column, size: float) -> Column:
    """Number of longitude cells in a latitude band, each at least ``size`` degrees of arc wide; one near the poles,
    where a circle may hold all longitudes."""
    edge = F.greatest(F.abs(band), F.abs(band + 1)) * size + size
    arc = F.greatest(F.cos(F.radians(F.least(edge, F.lit(90.0)))), F.lit(1e-9))
    return F.when(arc < math.radians(size) * 2.0, F.lit(1)).otherwise(
        F.greatest(F.floor(360.0 / (size * 1.05 / arc)), F.lit(1)).cast("int"))


def _gridded(places: DataFrame, size: float) -> DataFrame:
    """Places with their cell (band, cell) of ``n`` in the band, and the finest cell (fx, fy) inside it."""
    width = F.lit(360.0) / F.col("n")
    across, up = (F.col("lon") + 180.0) / width, F.col("lat") / size
    fine = lambda v: F.least(F.floor((v - F.floor(v)) * (1 << LEVELS)), F.lit((1 << LEVELS) - 1)).cast("int")
    return (places.withColumn("band", _band(F.col("lat"), size)).withColumn("n", _columns(F.col("band"), size))
            .withColumns({"cell": F.pmod(F.floor(across).cast("int"), F.col("n")), "fx": fine(across), "fy": fine(up)}))


def _cells(gridded: DataFrame, keys: list[str]) -> DataFrame:
    """A row for each cell with its nodes: the parts of all levels that hold places, how many, and the only one if one.
    There are at most 4^0 + ... + 4^LEVELS nodes."""
    part = lambda c, j: F.shiftright(F.col(c), LEVELS - j)
    leaves = gridded.groupBy(*keys, "band", "n", "cell", "fx", "fy").agg(
        F.count(F.lit(1)).alias("places"), F.min(F.struct("lat", "lon")).alias("one"))
    # a cell has at most 4^LEVELS leaves: brought together once, its nodes and their list need no further exchange
    leaves = leaves.repartition(*[F.col(c) for c in (*keys, "band", "n", "cell")])
    up = leaves.select(*keys, "band", "n", "cell", F.inline(F.array(*[F.struct(
        F.lit(j).alias("level"), part("fx", j).alias("x"), part("fy", j).alias("y"), "places", "one")
        for j in range(LEVELS + 1)])))
    nodes = up.groupBy(*keys, "band", "n", "cell", "level", "x", "y").agg(
        F.sum("places").alias("places"), F.min("one").alias("one"))
    return nodes.groupBy(*keys, "band", "n", "cell").agg(F.collect_list(F.struct("level", "x", "y", "places", "one")).alias("nodes"))


def _seekers(places: DataFrame, keys: list[str], size: float) -> DataFrame:
    """Each place with the 3 x 3 cells around it."""
    at_band = _band(F.col("lat"), size)
    rows = (places.withColumn("band", F.explode(F.sequence(at_band - 1, at_band + 1)))
            .withColumn("n", _columns(F.col("band"), size)))
    at = F.floor((F.col("lon") + 180.0) / (360.0 / F.col("n"))).cast("int")
    around = F.array_distinct(F.transform(F.sequence(at - 1, at + 1), lambda c: F.pmod(c, F.col("n"))))
    return rows.select(*keys, "lat", "lon", "band", "n", F.explode(around).alias("cell"))


def nearby(asking: DataFrame, known: DataFrame, keys: list[str], radius_km: float) -> DataFrame:
    """For each asking place the nodes (level, x, y) whose places are those ``known`` ones within the radius, each once."""
    size = radius_km / KM_PER_DEGREE
    gridded = _gridded(known, size)
    met = _seekers(asking, keys, size).join(_cells(gridded, keys), [*keys, "band", "n", "cell"])
    width = F.lit(360.0) / F.col("n")
    nearest = F.when(F.col("band") >= 0, F.col("band")).otherwise(-F.col("band") - 1) * size
    widest = F.cos(F.radians(F.least(nearest, F.lit(90.0))))

    def beyond(level: Column, x: Column, y: Column) -> tuple[Column, Column]:
        """Distance to the centre of a part, and a bound on the way from there to its points."""
        share = F.pow(F.lit(0.5), level)
        lat = (F.col("band") + (y + 0.5) * share) * size
        lon = (F.col("cell") + (x + 0.5) * share) * width - 180.0
        away = haversine(F.col("lat"), lat, F.col("lon"), lon)
        return away, (F.lit(size) + width * widest) * share * (LONG_DEGREE / 2)

    def inside(level: Column, x: Column, y: Column) -> Column:
        away, reach = beyond(level, x, y)
        return away + reach <= radius_km - SLACK

    def above(node: Column, up: Column) -> Column:
        """Whether the part ``up`` levels above the node lies inside."""
        shift = lambda c: F.floor(c * F.pow(F.lit(0.5), up))
        return inside(node["level"] - up, shift(node["x"]), shift(node["y"]))

    def kind(node: Column) -> Column:
        """0: counts as a whole; 1: its only place, or all its places, must be compared; null: not needed here."""
        away, reach = beyond(node["level"], node["x"], node["y"])
        held = F.when(node["level"] > 0, F.exists(F.sequence(F.lit(1), node["level"]), lambda up: above(node, up))).otherwise(False)
        return (F.when(held | (away - reach > radius_km + SLACK), F.lit(None).cast("int"))
                .when(away + reach <= radius_km - SLACK, F.lit(0))
                .when((node["places"] == 1) | (node["level"] == LEVELS), F.lit(1)))

    parents = F.map_from_entries(F.transform(F.filter("nodes", lambda n: n["level"] < LEVELS), lambda n: F.struct(
        F.struct(n["level"].alias("level"), n["x"].alias("x"), n["y"].alias("y")), n["places"])))
    parent = lambda n: F.struct(
        (n["level"] - 1).alias("level"), F.shiftright(n["x"], 1).alias("x"), F.shiftright(n["y"], 1).alias("y"))
    # a part of a cell with one place is not needed: the cell stands for it
    alone = lambda n: F.coalesce(F.element_at(F.col("_parents"), parent(n)) == 1, F.lit(False))
    judged = (met.withColumn("_parents", parents).withColumn("node", F.explode(F.filter("nodes", lambda n: ~alone(n))))
              .drop("nodes", "_parents").withColumn("kind", kind(F.col("node"))).where("kind is not null"))
    close = lambda lat, lon: haversine(F.col("lat"), lat, F.col("lon"), lon) <= radius_km
    whole, alone_in = F.col("kind") == 0, F.col("node.places") == 1
    level, x, y = node_key(F.col("node.level"), F.col("node.x"), F.col("node.y"))
    pick = lambda part, place, cut: F.when(whole, part).when(alone_in, place).otherwise(cut.cast("double"))
    # one pass judges every node; what it finds and what remains cut are told apart when they are read
    found = staged(judged.where(whole | ~alone_in | close(F.col("node.one.lat"), F.col("node.one.lon"))).select(
        *keys, "lat", "lon", "band", "n", "cell", (~whole & ~alone_in).alias("cut"),
        F.when(whole, level).when(alone_in, F.lit(PLACE)).alias("level"),
        pick(x, F.col("node.one.lat"), F.col("node.x")).alias("x"),
        pick(y, F.col("node.one.lon"), F.col("node.y")).alias("y")), "place-judged")
    cut = found.where("cut").select(*keys, "lat", "lon", "band", "n", "cell", F.col("x").cast("int").alias("fx"),
                                    F.col("y").cast("int").alias("fy"))
    inner = gridded.select(*keys, "band", "n", "cell", "fx", "fy", F.col("lat").alias("x"), F.col("lon").alias("y"))
    listed = staged(cut.join(inner, [*keys, "band", "n", "cell", "fx", "fy"]).where(close(F.col("x"), F.col("y")))
                    .select(*keys, "lat", "lon", F.lit(PLACE).alias("level"), "x", "y"), "place-listed")
    return found.where(~F.col("cut")).select(*keys, "lat", "lon", "level", "x", "y").unionByName(listed)


def _neighbours(places: DataFrame, keys: list[str], radius_km: float) -> DataFrame:
    """Pairs of places of one key within the radius, each way round: what ``nearby`` counts, listed."""
    size = radius_km / KM_PER_DEGREE
    homes = _gridded(places, size).select(*keys, "band", "n", "cell", F.col("lat").alias("n_lat"), F.col("lon").alias("n_lon"))
    near = haversine(F.col("lat"), F.col("n_lat"), F.col("lon"), F.col("n_lon")) <= radius_km
    return (_seekers(places, keys, size).join(homes, [*keys, "band", "n", "cell"]).where(near)
            .select(*keys, "lat", "lon", "n_lat", "n_lon"))


def node_key(level: Column, x: Column, y: Column) -> list[Column]:
    """A part by its place on the grid of its level: cells and parts of a band are numbered through."""
    scale = F.pow(F.lit(2.0), level)
    return [level.alias("level"), (F.col("cell") * scale + x).alias("x"), (F.col("band") * scale + y).alias("y")]


def _at_nodes(settled: DataFrame, keys: list[str], size: float) -> DataFrame:
    """Each settled moment at its place and at the parts of all levels that hold it."""
    part = lambda c, j: F.shiftright(F.col(c), LEVELS - j)
    nodes = [F.struct(*node_key(F.lit(j), part("fx", j), part("fy", j))) for j in range(LEVELS + 1)]
    place = F.struct(F.lit(PLACE).alias("level"), F.col("lat").alias("x"), F.col("lon").alias("y"))
    return _gridded(settled, size).select(*keys, "t_ms", "count", F.inline(F.array(*nodes, place)))


def habitual(pay: DataFrame, docs: Mapping[str, dict], kept: "Kept | None" = None) -> DataFrame:
    doc = docs["075"]
    radius = doc["config"]["parameters"]["maxRadius"]
    keys = ["tenant_id", "dbtr_acct"]
    rows = pay.where(fresh(kept))
    one = F.when(F.col("ok"), F.lit(1).cast("bigint"))
    moments = staged(rows.where("lat is not null and lon is not null and dbtr_acct is not null")
                     .groupBy(*keys, "lat", "lon", "t_ms").agg(F.sum(one).alias("count")), "place-moments")
    settled = moments.where("count > 0")
    line = rows.select(*keys, "t_ms", F.lit(True).alias("real"), one.alias("n"))
    if kept is not None:
        before = [*keys, F.lit(kept.closed - 1).alias("t_ms")]
        settled = settled.unionByName(kept.places.select(*before, "lat", "lon", F.col("n").alias("count")))
        line = line.unionByName(kept.debtor.withColumnRenamed("acct", "dbtr_acct").select(
            *before, F.lit(False).alias("real"), F.col("n_all").alias("n")))
    parts = nearby(moments.select(*keys, "lat", "lon").distinct(), settled.select(*keys, "lat", "lon").distinct(), keys, radius)
    node = ["level", "x", "y"]
    wanted = parts.select(*keys, *node).distinct()
    points = (_at_nodes(settled, keys, radius / KM_PER_DEGREE).join(wanted, [*keys, *node], "left_semi")
              .select(*keys, *node, "t_ms", F.lit(False).alias("real"), F.col("count").alias("n")))
    asked = (moments.select(*keys, "lat", "lon", "t_ms").join(parts, [*keys, "lat", "lon"])
             .select(*keys, *node, "t_ms", "lat", "lon"))
    asks = asked.select(*keys, *node, "t_ms", F.lit(True).alias("real"), F.lit(None).cast("bigint").alias("n"))
    counts = scan(points.unionByName(asks), [*keys, *node], "t_ms", [Measure("n", here=True)]).select(
        *keys, *node, "t_ms", (F.col("n") - F.col("n_here")).alias("n"))
    near = (asked.join(counts, [*keys, *node, "t_ms"]).groupBy(*keys, "lat", "lon", "t_ms").agg(F.sum("n").alias("near")))
    history = scan(line, keys, "t_ms", [Measure("n", here=True)]).select(
        *keys, "t_ms", (F.col("n") - F.col("n_here")).alias("prior"))
    wide = pay.join(near, [*keys, "lat", "lon", "t_ms"], "left").join(history, [*keys, "t_ms"], "left")
    located = F.col("lat").isNotNull() & F.col("lon").isNotNull() & F.col("dbtr_acct").isNotNull()
    return results(wide, [outcome(doc, F.when(located, F.coalesce("near", F.lit(0))), F.when(F.col("prior") < 1, ".x01"))])
