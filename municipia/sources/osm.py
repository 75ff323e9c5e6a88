"""Street references from map data: ways, places and boundaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from municipia import schemas

#: Tags in order of precedence.
PLACE_TAGS = ("place", "amenity", "leisure", "building", "landuse", "highway", "public_transport")
AREA_TAGS = ("amenity", "place", "leisure", "building")


def place_kind(tags: Column) -> Column:
    """The first place tag that is present; a highway counts as a square."""
    has = lambda t: F.array_contains(F.map_keys(tags), t)
    return F.coalesce(*[F.when(has(t), F.lit("square" if t == "highway" else t)) for t in PLACE_TAGS], F.lit("other"))


def route_ways(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ways: commune, id, name, highway, coords; places: commune, id, name, kind, type, coords) from commune, id, tags map,
    coords array<struct<x, y>>: named roads that aren't areas are ways; named objects and car parks are places."""
    tags, c = F.col("tags"), F.col("coords")
    has = lambda t: F.array_contains(F.map_keys(tags), t)
    closed = (F.size(c) >= 4) & (F.get(c, F.lit(0)) == F.element_at(c, -1))
    area = closed & (F.coalesce(tags["area"] == "yes", F.lit(False)) | F.exists(F.array(*[F.lit(t) for t in AREA_TAGS]), lambda t: F.array_contains(F.map_keys(tags), t)) | F.coalesce(tags["highway"] == "pedestrian", F.lit(False)))
    name = F.nullif(tags["name"], F.lit(""))
    told = raw.where(F.size(c) >= 2).withColumns({"name": name, "closed": closed, "road": has("highway") & name.isNotNull() & ~area, "parking": F.coalesce(tags["amenity"] == "parking", F.lit(False))})
    ways = told.where("road").select("commune", "id", "name", tags["highway"].alias("highway"), "coords")
    rest = told.where(~F.col("road") & (F.col("name").isNotNull() | F.col("parking")))
    places = rest.select("commune", F.concat(F.lit("w"), F.col("id").cast("string")).alias("id"), F.coalesce("name", F.lit("Parking")).alias("name"), place_kind(tags).alias("kind"), F.when(F.col("closed"), "Polygon").otherwise("LineString").alias("type"), "coords")
    return ways, places


def read_overpass(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(ways, places, outer members of boundaries: commune, role, coords) from JSON documents of one commune each."""
    elements = spark.read.schema(schemas.OVERPASS).option("multiLine", True).json(path).select("commune", F.explode("elements").alias("e"))
    point = lambda p: F.struct(p["lon"].alias("x"), p["lat"].alias("y"))
    none = F.array().cast("array<struct<x:double,y:double>>")
    tags = F.coalesce("e.tags", F.create_map().cast("map<string,string>"))
    raw = elements.where("e.type = 'way'").select("commune", F.col("e.id").alias("id"), tags.alias("tags"), F.coalesce(F.transform("e.geometry", point), none).alias("coords"))
    ways, places = route_ways(raw)
    nodes = elements.where("e.type = 'node'").withColumn("tags", tags).where("tags['name'] <> ''")
    nodes = nodes.select("commune", F.concat(F.lit("n"), F.col("e.id").cast("string")).alias("id"), F.col("tags")["name"].alias("name"), place_kind(F.col("tags")).alias("kind"), F.lit("Point").alias("type"), F.array(F.struct(F.col("e.lon").alias("x"), F.col("e.lat").alias("y"))).alias("coords"))
    members = elements.where("e.type = 'relation'").select("commune", F.explode("e.members").alias("m")).where("m.type = 'way'").select("commune", F.col("m.role").alias("role"), F.transform("m.geometry", point).alias("coords"))
    return ways, places.unionByName(nodes), members


def resolve_ways(nodes: DataFrame, refs: DataFrame) -> DataFrame:
    """commune, id, tags, coords: ways with their nodes' places in order; references to unknown nodes are dropped.

    nodes: commune, node, x, y. refs: commune, id, tags, nodes array<long>. What can't become a way or place is dropped
    before the references are spread."""
    tags = F.col("tags")
    has = lambda t: F.array_contains(F.map_keys(tags), t)
    named = F.coalesce(tags["name"] != "", F.lit(False))
    kept = refs.where((has("highway") & (named | F.coalesce(tags["highway"] == "pedestrian", F.lit(False)))) | F.coalesce(tags["amenity"] == "parking", F.lit(False)) | (named & F.exists(F.array(*[F.lit(t) for t in AREA_TAGS]), lambda t: F.array_contains(F.map_keys(tags), t))))
    spread = kept.select("commune", "id", F.posexplode("nodes").alias("k", "node"))
    lines = spread.join(nodes, ["commune", "node"]).groupBy("commune", "id").agg(F.sort_array(F.collect_list(F.struct("k", F.struct("x", "y").alias("p")))).alias("ps"))
    return kept.select("commune", "id", "tags").join(lines.select("commune", "id", F.transform("ps", lambda p: p["p"]).alias("coords")), ["commune", "id"])


def read_osm_xml(spark: SparkSession, path: str, commune: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, refs) for resolve_ways from map XML."""
    def rows(tag: str, schema: str) -> DataFrame:
        return spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)

    pairs = "array<struct<_k:string,_v:string>>"
    tagged = F.map_from_entries(F.coalesce(F.transform("tag", lambda t: F.struct(t["_k"].alias("k"), t["_v"].alias("v"))), F.array().cast("array<struct<k:string,v:string>>")))
    nodes = rows("node", f"_id long, _lat double, _lon double, tag {pairs}").select(F.lit(commune).alias("commune"), F.col("_id").alias("node"), F.col("_lon").alias("x"), F.col("_lat").alias("y")).distinct()
    ways = rows("way", f"_id long, nd array<struct<_ref:long>>, tag {pairs}")
    return nodes, ways.select(F.lit(commune).alias("commune"), F.col("_id").alias("id"), tagged.alias("tags"), F.transform("nd", lambda n: n["_ref"]).alias("nodes"))


#: Tags that make a named point of map XML a place.
POINT_TAGS = ("amenity", "place", "leisure")


def _xml(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    pairs = f"{schema}, tag array<struct<_k:string,_v:string>>"
    tagged = F.map_from_entries(F.coalesce(F.transform("tag", lambda t: F.struct(t["_k"].alias("k"), t["_v"].alias("v"))), F.array().cast("array<struct<k:string,v:string>>")))
    return spark.read.format("xml").option("rowTag", tag).schema(pairs).load(path).withColumn("tags", tagged)


def read_osm_points(spark: SparkSession, path: str, commune: str) -> DataFrame:
    """Places, as of ``route_ways``, from the named points of map XML; a point that several files hold counts once."""
    found = _xml(spark, path, "node", "_id long, _lat double, _lon double").dropDuplicates(["_id"])
    telling = F.exists(F.array(*[F.lit(t) for t in POINT_TAGS]), lambda t: F.array_contains(F.map_keys("tags"), t))
    kept = found.where(telling & (F.col("tags")["name"] != ""))
    return kept.select(F.lit(commune).alias("commune"), F.concat(F.lit("n"), F.col("_id").cast("string")).alias("id"), F.col("tags")["name"].alias("name"), place_kind(F.col("tags")).alias("kind"), F.lit("Point").alias("type"), F.array(F.struct(F.col("_lon").alias("x"), F.col("_lat").alias("y"))).alias("coords"))


def read_osm_boundary(spark: SparkSession, path: str, commune: str, code: str) -> DataFrame:
    """Outer members (commune, role, coords) of the relations of map XML whose commune code is that given."""
    relations = _xml(spark, path, "relation", "_id long, member array<struct<_type:string,_ref:long,_role:string>>").where(F.col("tags")["ref:INSEE"] == code)
    asked = relations.select(F.explode("member").alias("m")).where("m._type = 'way' and coalesce(m._role, '') in ('outer', '')").select(F.col("m._ref").alias("id")).distinct()
    nodes, ways = read_osm_xml(spark, path, commune)
    spread = ways.dropDuplicates(["id"]).join(asked, "id").select("commune", "id", F.posexplode("nodes").alias("k", "node")).join(nodes, ["commune", "node"])
    lines = spread.groupBy("commune", "id").agg(F.sort_array(F.collect_list(F.struct("k", F.struct("x", "y").alias("p")))).alias("ps"))
    return lines.select("commune", F.lit("outer").alias("role"), F.transform("ps", lambda p: p["p"]).alias("coords"))


def save_reference(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path, compression="gzip")


def load_reference(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)
