"""Locations on the street reference: addresses and crossings by joins, stretches by small line helpers.

Points are structs (x, y) in the metres of their commune; a street's parts are array<array<struct<x, y>>>.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from municipia.functions import constants as K
from municipia.operators import geometry as G
from municipia.operators.locations import _arrow, guarded
from municipia.operators.streets import sequence_ratio
from municipia.sources.tables import shuffled, written

POINT = "struct<x:double,y:double>"
PARTS = f"array<array<{POINT}>>"
#: House numbers tried in turn.
NEIGHBOURS = (0, -2, 2, -4, 4, -6, 6)


def to_metres(lon: Column, lat: Column, lon0: Column, lat0: Column) -> Column:
    return F.struct(((lon - lon0) * G.METRES_LON * F.cos(F.radians(lat0))).alias("x"), ((lat - lat0) * G.METRES_LAT).alias("y"))


def to_degrees(p: Column, lon0: Column, lat0: Column) -> Column:
    return F.struct((p["x"] / (G.METRES_LON * F.cos(F.radians(lat0))) + lon0).alias("lon"), (p["y"] / G.METRES_LAT + lat0).alias("lat"))


def address_points(wanted: DataFrame, addresses: DataFrame) -> DataFrame:
    """commune, street, num, point, found: the address, or the nearest same-side neighbour that exists.

    wanted: commune, street, num int. addresses: commune, street, number int, x, y."""
    asked = wanted.select("commune", "street", "num").distinct().select("commune", "street", "num", F.posexplode(F.array(*[F.lit(d) for d in NEIGHBOURS])).alias("rank", "step"))
    asked = asked.withColumn("number", F.col("num") + F.col("step")).where("number > 0")
    met = asked.join(shuffled(addresses.select("commune", "street", "number", "x", "y")), ["commune", "street", "number"])
    best = met.groupBy("commune", "street", "num").agg(F.min_by(F.struct("x", "y", "number"), F.struct("rank", "x", "y")).alias("p"))
    return best.select("commune", "street", "num", F.struct("p.x", "p.y").alias("point"), F.col("p.number").alias("found"))


def valid_candidates(candidates: DataFrame) -> DataFrame:
    """Candidates of a geocoder that can be trusted: score, street's likeness, house number. Normalised street names."""
    alike = sequence_ratio("found_street", "street") >= 0.75
    return candidates.where((F.col("score") >= 0.5) & F.startswith(F.col("housenumber"), F.col("num").cast("string"))).where(alike)


def read_through(wanted: DataFrame, cache: DataFrame, fresh: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(commune, key, lon, lat, pending for all wanted, the cache afterwards). A key that is cached without a place is a
    known miss; a fresh row with failed is not cached and stays pending."""
    keys = wanted.select("commune", "key").distinct()
    known = keys.join(cache, ["commune", "key"])
    asked = keys.join(cache, ["commune", "key"], "left_anti")
    new = asked.join(fresh, ["commune", "key"], "left").withColumn("pending", F.coalesce("failed", F.lit(True)))
    answers = known.select("commune", "key", "lon", "lat", F.lit(False).alias("pending")).unionByName(new.select("commune", "key", "lon", "lat", "pending"))
    kept = cache.select("commune", "key", "lon", "lat").unionByName(new.where("not pending").select("commune", "key", "lon", "lat"))
    return answers, kept


#: Answers of a geocoder to keys (commune, street, number): candidates, a row without any, or one that failed.
ANSWERS = "commune string, street string, number int, found_street string, score double, housenumber string, x double, y double, failed boolean"
ANSWERS_NAMES = [c.split()[0] for c in ANSWERS.split(", ")]
CACHE = "commune string, street string, number int, x double, y double"


def look_up(wanted: DataFrame, cache: DataFrame, answer: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(addresses: commune, street, number, x, y; pending: commune, street, num; what the cache gains) for the wanted numbers.

    wanted: commune, street, num. A number and its neighbours are looked for in turn up to the first that there is. cache:
    CACHE, without a place where there is known to be none. answer: ANSWERS to the keys that the cache lacks. The best candidate
    that can be trusted (``valid_candidates``) is a new address; none is a new miss; a failed or unanswered key is neither, and
    the numbers whose search came by it are pending. Only keys that some search came by are cached, as written tables."""
    key = ["commune", "street", "number"]
    tried = wanted.select("commune", "street", "num").distinct().select("commune", "street", "num", F.posexplode(F.array(*[F.lit(d) for d in NEIGHBOURS])).alias("rank", "step"))
    tried = written(tried.withColumn("number", F.col("num") + F.col("step")).where("number > 0").drop("step"))
    known = tried.select(*key).distinct().join(cache.select(*key, "x", "y", F.lit(True).alias("cached")), key, "left")
    told = written(answer(known.where("cached is null").select(*key)).select(*ANSWERS_NAMES))
    trusted = valid_candidates(told.where("not coalesce(failed, false)").withColumn("num", F.col("number"))).groupBy(*key).agg(F.max_by(F.struct("x", "y"), F.struct("score", -F.col("x"), -F.col("y"))).alias("best"))
    heard = told.groupBy(*key).agg(F.bool_or(F.coalesce("failed", F.lit(False))).alias("failed")).join(trusted, key, "left")
    met = known.join(heard, key, "left")
    at = F.when(F.col("cached"), F.when(F.col("x").isNotNull(), F.struct("x", "y"))).otherwise(F.col("best"))
    lost = F.col("cached").isNull() & at.isNull() & F.coalesce("failed", F.lit(True))
    settled = met.select(*key, at.alias("at"), lost.alias("lost"), F.col("cached").isNull().alias("new"))
    found = tried.join(settled, key)
    first = found.groupBy("commune", "street", "num").agg(F.min(F.when(F.col("at").isNotNull(), F.col("rank"))).alias("first"))
    came_by = written(found.join(first, ["commune", "street", "num"]).where("first is null or rank <= first").drop("first"))
    seen = came_by.select(*key, "at", "lost", "new").distinct()
    addresses = seen.where("at is not null").select(*key, "at.x", "at.y")
    pending = came_by.where("lost").select("commune", "street", "num").distinct()
    return addresses, pending, seen.where("new and not lost").select(*key, "at.x", "at.y")


def mean_point(points: DataFrame, *keys: str) -> DataFrame:
    """keys, point: the mean of an anchor's one or two addresses, which is precise if there is any."""
    return points.groupBy(*keys).agg(F.avg("point.x").alias("x"), F.avg("point.y").alias("y")).select(*keys, F.struct("x", "y").alias("point"), F.lit("precise").alias("quality"))


def _array(parts: list) -> list[np.ndarray]:
    return [np.array([(p["x"], p["y"]) for p in part], float) for part in parts or []]


def _points(line: np.ndarray | None) -> list[dict] | None:
    return None if line is None else [{"x": float(x), "y": float(y)} for x, y in line]


def per_row(df: DataFrame, result: str, kind: str, of, fault: str | None = None) -> DataFrame:
    """df with a column from a helper that reads one row as a dict, on Arrow batches; with ``fault``, a column of that name
    has the message of a row that fails, else such a row ends the job."""
    shape = _arrow(kind)
    more = [result, fault] if fault else [result]
    schema = StructType([*df.schema.fields, *StructType.fromDDL(f"`{result}` {kind}" + (f", `{fault}` string" if fault else ""))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [guarded(of, r) if fault else (of(r), None) for r in batch.to_pylist()]
            columns = [pa.array([x for x, _ in found], shape), pa.array([e for _, e in found], pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns[: len(more)]], names=[*batch.schema.names, *more])

    return df.mapInArrow(run, schema)


def crossings(pairs: DataFrame, streets: DataFrame) -> DataFrame:
    """commune, a, b, point (null if they don't meet) for the distinct pairs asked for. streets: commune, name, parts."""
    side = lambda s: shuffled(streets.select("commune", F.col("name").alias(s), F.col("parts").alias(f"parts_{s}")))
    met = pairs.select("commune", "a", "b").distinct().join(side("a"), ["commune", "a"]).join(side("b"), ["commune", "b"])
    found = per_row(met, "line", f"array<{POINT}>", lambda r: _points(None if (c := G.crossing(_array(r["parts_a"]), _array(r["parts_b"]))) is None else c[None]))
    return found.select("commune", "a", "b", F.get("line", F.lit(0)).alias("point"))


def clipped(streets: DataFrame, boundaries: DataFrame) -> DataFrame:
    """commune, name, parts within the commune's rings and 30 metres around. boundaries: commune, rings array<array<point>>."""
    met = streets.join(boundaries.select("commune", "rings"), "commune", "left")
    held = per_row(met.select("commune", "name", "parts", "rings"), "kept", PARTS, lambda r: [_points(x) for x in (G.clip(_array(r["parts"]), *_array(r["rings"])) if r["rings"] else _array(r["parts"]))])
    return held.select("commune", "name", F.col("kept").alias("parts"))


def stretches_around(asked: DataFrame, streets: DataFrame) -> DataFrame:
    """asked (commune, street, point, half, ...) with line: half metres to both sides of the point on the street."""
    met = asked.join(streets.select("commune", F.col("name").alias("street"), "parts"), ["commune", "street"])
    return per_row(met, "line", f"array<{POINT}>", lambda r: _points(G.around(_array(r["parts"]), tuple(r["point"].values()), r["half"]))).drop("parts")


def stretches_between(asked: DataFrame, streets: DataFrame) -> DataFrame:
    """asked (commune, street, p, q, ...) with line between the two points along the street."""
    met = asked.join(streets.select("commune", F.col("name").alias("street"), "parts"), ["commune", "street"])
    return per_row(met, "line", f"array<{POINT}>", lambda r: _points(G.between(_array(r["parts"]), tuple(r["p"].values()), tuple(r["q"].values())))).drop("parts")


def line_length(line: Column) -> Column:
    """Metres along array<point>."""
    steps = F.zip_with(F.slice(line, 1, F.greatest(F.size(line) - 1, F.lit(0))), F.slice(line, 2, F.greatest(F.size(line) - 1, F.lit(0))), lambda a, b: F.hypot(b["x"] - a["x"], b["y"] - a["y"]))
    return F.aggregate(steps, F.lit(0.0), lambda t, x: t + x)


#: Levels of cells, each twice as wide as the one before; at the last one a cell is as wide as a country.
LEVELS = 14


def _dealt(segments: DataFrame, reach: float) -> DataFrame:
    """segments (s: struct of two points) by level and cell: at the level where a cell is as wide as the segment, in four cells
    at most, however long it is."""
    extent = F.greatest(F.abs(F.col("s.b.x") - F.col("s.a.x")), F.abs(F.col("s.b.y") - F.col("s.a.y")))
    level = F.least(F.lit(LEVELS - 1), F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(extent, F.lit(reach)) / reach)))).cast("int")
    cell = lambda v: F.floor(v / (reach * F.pow(F.lit(2.0), F.col("level")))).cast("long")
    span = lambda k: F.sequence(cell(F.least(f"s.a.{k}", f"s.b.{k}")), cell(F.greatest(f"s.a.{k}", f"s.b.{k}")))
    return segments.withColumn("level", level).withColumn("cx", F.explode(span("x"))).withColumn("cy", F.explode(span("y")))


def common_streets(asked: DataFrame, streets: DataFrame, reach: float = 60.0) -> DataFrame:
    """commune, id, street, away: the street within reach of both points whose distances sum to the least.

    Long segments are dealt to wide square cells, short ones to those of reach metres; a point looks, at each level that
    occurs, into its own cell and the eight around."""
    ends = F.explode(F.zip_with(F.slice("part", 1, F.size("part") - 1), F.slice("part", 2, F.size("part") - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b"))))
    segments = streets.select("commune", F.col("name").alias("street"), F.explode("parts").alias("part")).where(F.size("part") > 1).select("commune", "street", ends.alias("s"))
    dealt = _dealt(segments, reach)
    levels = sorted(r.level for r in dealt.select("level").distinct().collect()) or [0]
    points = asked.select("commune", "id", F.explode(F.array(F.struct(F.lit(0).alias("end"), F.col("p")), F.struct(F.lit(1).alias("end"), F.col("q").alias("p")))).alias("e")).select("commune", "id", "e.end", "e.p")
    near = F.array(*[F.lit(d) for d in (-1, 0, 1)])
    own = lambda v: F.floor(v / (reach * F.pow(F.lit(2.0), F.col("level")))).cast("long")
    looked = points.withColumn("level", F.explode(F.array(*[F.lit(v) for v in levels]))).withColumn("dx", F.explode(near)).withColumn("dy", F.explode(near))
    looked = looked.select("commune", "id", "end", "p", "level", (own(F.col("p.x")) + F.col("dx")).alias("cx"), (own(F.col("p.y")) + F.col("dy")).alias("cy"))
    met = looked.join(dealt, ["commune", "level", "cx", "cy"])
    dx, dy = F.col("s.b.x") - F.col("s.a.x"), F.col("s.b.y") - F.col("s.a.y")
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((F.col("p.x") - F.col("s.a.x")) * dx + (F.col("p.y") - F.col("s.a.y")) * dy) / F.greatest(dx * dx + dy * dy, F.lit(1e-12))))
    away = F.hypot(F.col("p.x") - F.col("s.a.x") - t * dx, F.col("p.y") - F.col("s.a.y") - t * dy)
    least = met.select("commune", "id", "end", "street", away.alias("away")).where(F.col("away") <= reach).groupBy("commune", "id", "street", "end").agg(F.min("away").alias("away"))
    both = least.groupBy("commune", "id", "street").agg(F.count("*").alias("ends"), F.sum("away").alias("away")).where("ends = 2")
    return both.groupBy("commune", "id").agg(F.min_by(F.struct("street", "away"), F.struct("away", "street")).alias("x")).select("commune", "id", "x.street", "x.away")


#: Why two points give no stretch.
APART, NO_WAY = "Les deux points ne sont pas sur une même rue (cliquez au plus près de la voie).", "Impossible de suivre {} entre ces deux points."


def stretches_of_points(asked: DataFrame, streets: DataFrame) -> DataFrame:
    """commune, id, street, metres, line, error of each pair of points (commune, id, p, q): the stretch between them along
    their common street, its length in whole metres, or why there is none."""
    named = asked.select("commune", "id", "p", "q").join(common_streets(asked, streets).select("commune", "id", "street"), ["commune", "id"], "left")
    drawn = stretches_between(named.where("street is not null"), streets).select("commune", "id", "line")
    met = named.join(drawn, ["commune", "id"], "left")
    error = F.when(F.col("street").isNull(), APART).when(F.col("line").isNull(), F.replace(F.lit(NO_WAY), F.lit("{}"), F.col("street")))
    return met.select("commune", "id", "street", F.bround(line_length(F.col("line"))).cast("long").alias("metres"), "line", error.alias("error"))


def worst_quality(qualities: Column, has_geometry: Column) -> Column:
    """The least precise of a decree's locations; "approx" if that is none though something was drawn."""
    order = F.array(*[F.lit(q) for q in K.QUALITIES])
    worst = F.coalesce(F.get(F.filter(order, lambda q: F.array_contains(qualities, q)), F.lit(0)), F.lit("none"))
    return F.when(has_geometry & (worst == "none"), "approx").otherwise(worst)


def features(rows: DataFrame) -> DataFrame:
    """commune, doc, geojson: a FeatureCollection, impacts before deviations, in order of place.

    rows: commune, doc, role, place, name, type, coordinates (JSON text)."""
    rank = F.when(F.col("role") == "deviation", 1).otherwise(0)
    properties = F.to_json(F.struct("role", "name"))  # escapes names; a null one is left out
    text = F.concat(F.lit('{"type":"Feature","properties":'), properties, F.lit(',"geometry":{"type":"'), "type", F.lit('","coordinates":'), "coordinates", F.lit("}}"))
    lists = rows.groupBy("commune", "doc").agg(F.sort_array(F.collect_list(F.struct(rank.alias("r"), "place", text.alias("t")))).alias("fs"))
    return lists.select("commune", "doc", F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(F.transform("fs", lambda f: f["t"]), ","), F.lit("]}")).alias("geojson"))


def bounds(lines: DataFrame, *keys: str) -> DataFrame:
    """keys, west, south, east, north over array<struct<lon, lat>> in column line."""
    at = lines.select(*keys, F.explode("line").alias("p"))
    return at.groupBy(*keys).agg(F.min("p.lon").alias("west"), F.min("p.lat").alias("south"), F.max("p.lon").alias("east"), F.max("p.lat").alias("north"))


def geojson_error(types: Column, roles: Column) -> Column:
    """Why drawn features are refused, null if they aren't."""
    allowed = F.array(*[F.lit(t) for t in ("Point", "LineString", "MultiLineString", "Polygon", "MultiPolygon")])
    return F.when(types.isNull() | (F.size(types) > 50), "GeoJSON invalide").when(~F.forall(types, lambda t: F.array_contains(allowed, t)), "Type de géométrie non pris en charge")


def lonlat_error(lon: Column, lat: Column) -> Column:
    return F.when(~F.coalesce(lon.between(-180, 180) & lat.between(-90, 90), F.lit(False)), "Coordonnées invalides")


def icon_positions(shapes: DataFrame) -> DataFrame:
    """shapes (..., lines, polygons) with icon (point): see geometry.icon_point."""

    def of(r: dict):
        p = G.icon_point(_array(r["lines"]), _array(r["polygons"]))
        return None if p is None else {"x": round(float(p[0]), 6), "y": round(float(p[1]), 6)}

    return per_row(shapes, "icon", POINT, of)


def merged_streets(ways: DataFrame) -> DataFrame:
    """commune, name, parts, length: each street's ways (coords array<point>) joined end to end."""
    lists = ways.groupBy("commune", "name").agg(F.sort_array(F.collect_list("coords")).alias("ways"))
    held = per_row(lists, "parts", PARTS, lambda r: [_points(x) for x in G.merge(_array(r["ways"]))]).drop("ways")
    return held.withColumn("length", F.aggregate(F.transform("parts", line_length), F.lit(0.0), lambda t, x: t + x))


def boundary_rings(members: DataFrame) -> DataFrame:
    """commune, rings: those that outer members (coords array<point>, role) close; communes without any are left out."""
    lists = members.where("role in ('outer', '')").groupBy("commune").agg(F.sort_array(F.collect_list("coords")).alias("lines"))
    found = per_row(lists, "rings", PARTS, lambda r: [_points(x) for x in G.rings([x for x in _array(r["lines"]) if len(x) > 1])])
    return found.where(F.size("rings") > 0).select("commune", "rings")


def map_centres(ways: DataFrame, boundaries: DataFrame) -> DataFrame:
    """commune, lon0, lat0: the centroid of the boundary, the mean vertex of the ways (commune, coords) without one. In degrees."""
    mean = ways.select("commune", F.explode("coords").alias("p")).groupBy("commune").agg(F.avg("p.x").alias("x"), F.avg("p.y").alias("y"))
    own = per_row(boundaries.select("commune", "rings"), "c", POINT, lambda r: _points(G.centroid(_array(r["rings"]))[None])[0])
    met = mean.join(own.select("commune", "c"), "commune", "full")
    return met.select("commune", F.coalesce("c.x", "x").alias("lon0"), F.coalesce("c.y", "y").alias("lat0"))
