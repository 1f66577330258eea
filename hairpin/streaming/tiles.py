"""Tiles as a stream: documents land in a folder and leave as scored segments."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from hairpin.functions import geo, tags
from hairpin.operators.segments import exploded, score_ways
from hairpin.operators.ways import hard_filter
from hairpin.plans.lineage import shared_folder
from hairpin.sources import tiles


def landing(spark: SparkSession, path: str) -> DataFrame:
    """The stream of documents of a folder."""
    docs = spark.readStream.schema(tiles.SCHEMA).option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    return tiles.with_status(docs.withColumn("tile_key", F.regexp_extract("_metadata.file_name", r"^(.*?)(\.json)?$", 1)))


def features(docs: DataFrame) -> DataFrame:
    """Scored segments of the documents; stateless, so it serves a stream and a table alike."""
    ways = hard_filter(tiles.ways_of(docs))
    return exploded(score_ways(ways), "tile_key", "highway")


def first_seen(segments: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Each segment once, though several tiles bring it; its key is the way and the first point. State is bounded by the watermark."""
    stamped = segments.withColumns({"ingest_ts": F.current_timestamp(), "lon0": F.col("start.lon"), "lat0": F.col("start.lat")})
    return stamped.withWatermark("ingest_ts", delay).dropDuplicatesWithinWatermark(["way_id", "lon0", "lat0"]).drop("lon0", "lat0")


def changed(docs: DataFrame, params_hash: str) -> DataFrame:
    """Of a stream of documents (tile, elements, raw_hash) those whose tile was never scored, or not in this form with these parameters. State is
    one hash for each tile; the documents pass through Python as texts."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, out = (state.get[0] if state.exists else None), []
        for frame in frames:
            for h, body in zip(frame["h"], frame["body"], strict=True):
                if h != last:
                    out.append(body)
                    last = h
        state.update((last,))
        yield pd.DataFrame({"tile": [key[0]] * len(out), "body": out})

    rows = docs.select("tile", F.concat_ws("/", "raw_hash", F.lit(params_hash)).alias("h"), F.to_json(F.struct("elements")).alias("body"))
    kept = rows.groupBy("tile").applyInPandasWithState(step, "tile string, body string", "hash string", "append", GroupStateTimeout.NoTimeout)
    return kept.select("tile", F.from_json("body", tiles.SCHEMA.partition(", remark")[0]).alias("d")).select("tile", "d.elements")


def run_available(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Writes what has landed since the last run and ends."""
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def write_documents(ways: DataFrame, path: str, tile_degrees: float = 1.0) -> None:
    """One document for each tile, of the ways whose first node is in it."""
    first = F.get("geometry", F.lit(0))
    rows = ways.where(F.size("geometry") > 0).select(geo.cell(first.lat, tile_degrees).alias("i"), geo.cell(first.lon, tile_degrees).alias("j"), F.struct(F.col("way_id").alias("id"), _tags().alias("tags"), "geometry").alias("e"))
    rows.groupBy("i", "j").agg(F.collect_list("e").alias("elements")).select(F.to_json(F.struct("elements")).alias("value")).repartition(8, "value").write.text(path)


def _land(ways: DataFrame, path: str, tile_degrees: float = 1.0) -> None:
    """Like :func:`write_documents`, with the tile's name in each document; adds to what the folder has."""
    first = F.get("geometry", F.lit(0))
    key = F.concat_ws("_", geo.cell(first.lat, tile_degrees), geo.cell(first.lon, tile_degrees)).alias("tile")
    rows = ways.where(F.size("geometry") > 0).select(key, F.struct(F.col("way_id").alias("id"), _tags().alias("tags"), "geometry").alias("e"))
    docs = rows.groupBy("tile").agg(F.array_sort(F.collect_list("e"), lambda a, b: (a.id - b.id).cast("int")).alias("elements"))
    docs.select(F.to_json(F.struct("tile", "elements")).alias("value")).write.mode("append").text(path)


def replay_changes(ways: DataFrame, again: DataFrame) -> DataFrame:
    """(tile, versions): how often each tile is scored when ``ways`` land, then all their tiles as ``again`` has them."""
    spark = ways.sparkSession
    at = f"{shared_folder(spark)}/tiles-{uuid.uuid4().hex}"
    for rows in (ways, again):
        _land(rows, f"{at}/in")
        docs = spark.readStream.schema(f"tile string, {tiles.SCHEMA}").json(f"{at}/in")
        run_available(changed(tiles.with_status(docs).where("status = 'loaded'"), tags.fingerprint()), f"{at}/out", f"{at}/state")
    return spark.read.parquet(f"{at}/out").groupBy("tile").agg(F.count("*").alias("versions"))


def replay_repeats(ways: DataFrame) -> DataFrame:
    """One row: how many segments a client sees when every third way comes from two tiles."""
    spark = ways.sparkSession
    at = f"{shared_folder(spark)}/tiles-{uuid.uuid4().hex}"
    _land(ways, f"{at}/in")
    _land(ways.where("way_id % 3 = 0"), f"{at}/in")
    docs = spark.readStream.schema(tiles.SCHEMA).json(f"{at}/in")
    seen = first_seen(features(tiles.with_status(docs.withColumn("tile_key", F.lit("")))).drop("radius"))
    run_available(seen, f"{at}/out", f"{at}/state")
    return spark.read.parquet(f"{at}/out").agg(F.count("*").alias("n"))


def _tags():
    return F.map_filter(F.create_map(*[x for t in tiles.TAGS for x in (F.lit(t), F.col(t))]), lambda k, v: v.isNotNull())


def replay(ways: DataFrame) -> DataFrame:
    """Counts by way and tier of the segments that a stream over the ways' documents brings out."""
    spark = ways.sparkSession
    at = f"{shared_folder(spark)}/tiles-{uuid.uuid4().hex}"
    write_documents(ways, f"{at}/in")
    docs = spark.readStream.schema(tiles.SCHEMA).json(f"{at}/in")
    run_available(features(tiles.with_status(docs.withColumn("tile_key", F.lit("")))).drop("radius"), f"{at}/out", f"{at}/state")
    rows = spark.read.parquet(f"{at}/out")
    return rows.groupBy("tier").agg(F.count("*").alias("n"), F.round(F.sum("length"), 1).alias("length")).select(F.col("tier").cast("long").alias("tier"), "n", "length")
