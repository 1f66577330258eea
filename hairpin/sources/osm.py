"""Region files in OSM XML: tables of nodes, ways and relations, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_TAG = "tag array<struct<_k:string,_v:string>>"
_SCHEMAS = {
    "node": f"_id long, _lat double, _lon double, {_TAG}",
    "way": f"_id long, nd array<struct<_ref:long>>, {_TAG}",
    "relation": f"_id long, member array<struct<_type:string,_ref:long,_role:string>>, {_TAG}",
}


def _tags() -> Column:
    pairs = F.coalesce("tag", F.array().cast("array<struct<_k:string,_v:string>>"))
    # the last of repeated keys counts
    return F.aggregate(pairs, F.create_map().cast("map<string,string>"), lambda m, t: F.map_concat(F.map_filter(m, lambda k, v: k != t._k), F.create_map(t._k, t._v)))


def _read(spark: SparkSession, path: str, tag: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", tag).schema(_SCHEMAS[tag]).load(path)


def read_nodes(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, "node").select(F.col("_id").alias("id"), F.col("_lat").alias("lat"), F.col("_lon").alias("lon"), _tags().alias("tags"))


def read_ways(spark: SparkSession, path: str) -> DataFrame:
    refs = F.coalesce("nd", F.array().cast("array<struct<_ref:long>>"))
    return _read(spark, path, "way").select(F.col("_id").alias("id"), F.transform(refs, lambda n: n._ref).alias("node_ids"), _tags().alias("tags"))


def read_relations(spark: SparkSession, path: str) -> DataFrame:
    members = F.coalesce("member", F.array().cast("array<struct<_type:string,_ref:long,_role:string>>"))
    named = F.transform(members, lambda m: F.struct(m._type.alias("type"), m._ref.alias("id"), m._role.alias("role")))
    return _read(spark, path, "relation").select(F.col("_id").alias("id"), named.alias("members"), _tags().alias("tags"))


def degrees(c: Column) -> Column:
    """Seven places, without zeros at the end."""
    return F.regexp_replace(F.regexp_replace(F.format_string("%.7f", c), "0+$", ""), "\\.$", "")


def _xml_tags() -> Column:
    return F.transform(F.map_entries("tags"), lambda e: F.struct(e.key.alias("_k"), e.value.alias("_v"))).alias("tag")


def write_nodes(nodes: DataFrame, path: str) -> None:
    rows = nodes.select(F.col("id").alias("_id"), degrees(F.col("lat")).alias("_lat"), degrees(F.col("lon")).alias("_lon"), _xml_tags())
    rows.write.format("xml").option("rowTag", "node").option("rootTag", "osm").save(path)


def write_ways(ways: DataFrame, path: str) -> None:
    rows = ways.select(F.col("id").alias("_id"), F.transform("node_ids", lambda n: F.struct(n.alias("_ref"))).alias("nd"), _xml_tags())
    rows.write.format("xml").option("rowTag", "way").option("rootTag", "osm").save(path)


def write_relations(relations: DataFrame, path: str) -> None:
    members = F.transform("members", lambda m: F.struct(m.type.alias("_type"), m.id.alias("_ref"), m.role.alias("_role")))
    rows = relations.select(F.col("id").alias("_id"), members.alias("member"), _xml_tags())
    rows.write.format("xml").option("rowTag", "relation").option("rootTag", "osm").save(path)


def in_order(nodes: DataFrame, ways: DataFrame, relations: DataFrame) -> DataFrame:
    """(kind, id) of all objects of a region in file order: nodes, ways, relations, each by id."""
    kinds = [df.select(F.lit(k).alias("kind"), F.col("id").cast("long").alias("id")) for k, df in enumerate((nodes, ways, relations))]
    return kinds[0].unionByName(kinds[1]).unionByName(kinds[2]).orderBy("kind", "id")
