"""The canonical relations (photos, faces, persons, places, tags) over the star-schema tables the driver gives.

``Library`` builds them as DataFrames; ``WITH`` states the same projection as common table expressions for the SQL
that checks each query.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Library:
    """Lazily built relations of one folder of Parquet tables; only the columns a query uses are read."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def photos(self) -> DataFrame:
        k, day = F.col("o_orderkey"), F.col("o_orderdate")
        source = F.element_at(F.array(*map(F.lit, ("screenshot", "whatsapp", "download", "phone", "phone", "camera", None))), (k % 7 + 1).cast("int"))
        rows = self.table("orders").join(self.table("customer").select("c_custkey", "c_nationkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
        return rows.select(
            k.alias("id"),
            F.when(k % 29 != 0, F.unix_timestamp(day).cast("double")).alias("taken_ts"),
            F.col("o_totalprice").alias("quality_score"),
            source.alias("source_kind"),
            F.when(F.col("o_orderstatus").isin("F", "O"), "ok").otherwise("missing").alias("status"),
            (k % 17 == 0).cast("int").alias("hidden"),
            (k % 23 == 0).cast("int").alias("live_component"),
            (k % 13 == 0).cast("int").alias("archived"),
            F.when(k % 31 != 0, F.col("c_nationkey")).alias("place_id"),
            (k % 6).cast("int").alias("rating"),
            F.concat_ws("/", "c_mktsegment", F.date_format(day, "yyyy"), F.date_format(day, "MM")).alias("folder"),
            F.concat(F.lit("IMG_"), F.date_format(day, "yyyyMMdd"), F.lit("_120000_"), k.cast("string"), F.lit(".jpg")).alias("filename"),
            F.concat(F.lit("cam"), (F.col("o_custkey") % 40).cast("string")).alias("camera_model"),
            (1000 + k % 3000).cast("int").alias("width"),
            (800 + (k * 7) % 3000).cast("int").alias("height"),
            ((k * 1237) % 30_000_000).alias("size"),
            F.when(k % 11 == 0, "video").otherwise("image").alias("media_type"),
            (k % 4).cast("int").alias("face_count"),
            F.concat(F.lit("h"), F.floor(k / 2).cast("string")).alias("sha256"),
            F.when(k % 9 == 0, ".dng").when(k % 9 == 1, ".cr2").otherwise(".jpg").alias("ext"),
            F.when(k % 37 != 0, (k * 31 % 900).cast("double")).alias("blur"),
            F.when((k % 29 == 0) | (k % 19 == 0), "low").otherwise("high").alias("date_confidence"),
            F.when(k % 41 == 0, k + 1).alias("live_video_id"),
            F.when(k % 43 == 0, k * 3).alias("motion_offset"),
            F.when(k % 5 != 0, k - k % 4).alias("stack_id"),
            ((k % 5 != 0) & (k % 4 != 0)).cast("int").alias("stack_hidden"),
            F.when(k % 11 == 0, (k % 97).cast("double")).alias("duration"),
            F.when((k % 31 != 0) & (k % 3 == 0), F.col("c_nationkey") * 6.5 - 80 + (k % 10) * 0.01).alias("lat"),
            F.when((k % 31 != 0) & (k % 3 == 0), F.col("c_nationkey") * 13.0 - 160).alias("lon"),
            (F.unix_timestamp(day) + k % 3600).cast("double").alias("added_ts"),
        )

    @cached_property
    def faces(self) -> DataFrame:
        return self.table("lineitem").select(
            F.col("l_orderkey").alias("photo_id"), F.when(F.col("l_linenumber") != 7, F.col("l_suppkey")).alias("person_id"), (F.col("l_discount") * 10).alias("quality"), F.col("l_quantity").alias("size_px"),
            F.col("l_discount").alias("x1"), (F.col("l_discount") + F.col("l_quantity") / 100).alias("x2"), F.when(F.col("l_returnflag") == "A", "user").otherwise("auto").alias("source"), F.col("l_linestatus").alias("model"),
        )

    @cached_property
    def persons(self) -> DataFrame:
        return self.table("supplier").select(F.col("s_suppkey").alias("id"), F.when(F.col("s_suppkey") % 5 != 0, F.col("s_name")).alias("name"), F.when(F.col("s_suppkey") % 3 == 0, F.date_add(F.lit("1960-01-01").cast("date"), (F.col("s_suppkey") * 37 % 14000).cast("int"))).alias("birth_date"))

    @cached_property
    def places(self) -> DataFrame:
        nation, region = self.table("nation"), self.table("region")
        key = F.col("n_nationkey")
        return nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
            key.alias("id"), F.col("n_name").alias("name"), F.col("r_name").alias("country"), (key * 6.5 - 80).alias("lat"), (key * 13.0 - 160).alias("lon"),
            F.when(key % 4 != 3, F.concat(F.lit("NATION_"), (key - key % 4).cast("string"))).alias("city"), F.concat(F.lit("NATION_"), (key - key % 10).cast("string")).alias("admin1"),
        )

    @cached_property
    def photo_tags(self) -> DataFrame:
        part = self.table("part").select("p_partkey", "p_type")
        return self.table("lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("l_orderkey").alias("photo_id"), F.col("p_type").alias("tag")).agg(F.max(F.round(F.col("l_discount") * 25, 4)).alias("score"))

    @cached_property
    def stream(self) -> DataFrame:
        return self.table("events").select("event_id", "user_id", "event_type", "value", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("ts"))


WITH = """WITH photos AS (
  SELECT o_orderkey AS id, CASE WHEN o_orderkey % 29 <> 0 THEN floor(epoch(o_orderdate))::DOUBLE END AS taken_ts,
    o_totalprice AS quality_score,
    CASE o_orderkey % 7 WHEN 0 THEN 'screenshot' WHEN 1 THEN 'whatsapp' WHEN 2 THEN 'download' WHEN 3 THEN 'phone'
      WHEN 4 THEN 'phone' WHEN 5 THEN 'camera' END AS source_kind,
    CASE WHEN o_orderstatus IN ('F', 'O') THEN 'ok' ELSE 'missing' END AS status,
    (o_orderkey % 17 = 0)::INT AS hidden, (o_orderkey % 23 = 0)::INT AS live_component,
    (o_orderkey % 13 = 0)::INT AS archived,
    CASE WHEN o_orderkey % 31 <> 0 THEN c_nationkey END AS place_id, (o_orderkey % 6)::INT AS rating,
    c_mktsegment || '/' || strftime(o_orderdate, '%Y') || '/' || strftime(o_orderdate, '%m') AS folder,
    'IMG_' || strftime(o_orderdate, '%Y%m%d') || '_120000_' || o_orderkey || '.jpg' AS filename,
    'cam' || (o_custkey % 40) AS camera_model, (1000 + o_orderkey % 3000)::INT AS width,
    (800 + (o_orderkey * 7) % 3000)::INT AS height, (o_orderkey * 1237) % 30000000 AS size,
    CASE WHEN o_orderkey % 11 = 0 THEN 'video' ELSE 'image' END AS media_type, (o_orderkey % 4)::INT AS face_count,
    'h' || (o_orderkey // 2) AS sha256, CASE o_orderkey % 9 WHEN 0 THEN '.dng' WHEN 1 THEN '.cr2' ELSE '.jpg' END AS ext,
    CASE WHEN o_orderkey % 37 <> 0 THEN (o_orderkey * 31 % 900)::DOUBLE END AS blur,
    CASE WHEN o_orderkey % 29 = 0 OR o_orderkey % 19 = 0 THEN 'low' ELSE 'high' END AS date_confidence,
    CASE WHEN o_orderkey % 41 = 0 THEN o_orderkey + 1 END AS live_video_id, CASE WHEN o_orderkey % 43 = 0 THEN o_orderkey * 3 END AS motion_offset,
    CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey - o_orderkey % 4 END AS stack_id, (o_orderkey % 5 <> 0 AND o_orderkey % 4 <> 0)::INT AS stack_hidden,
    CASE WHEN o_orderkey % 11 = 0 THEN (o_orderkey % 97)::DOUBLE END AS duration,
    CASE WHEN o_orderkey % 31 <> 0 AND o_orderkey % 3 = 0 THEN c_nationkey * 6.5::DOUBLE - 80 + (o_orderkey % 10) * 0.01::DOUBLE END AS lat,
    CASE WHEN o_orderkey % 31 <> 0 AND o_orderkey % 3 = 0 THEN c_nationkey * 13.0::DOUBLE - 160 END AS lon,
    floor(epoch(o_orderdate))::DOUBLE + o_orderkey % 3600 AS added_ts
  FROM orders JOIN customer ON o_custkey = c_custkey),
visible AS (SELECT * FROM photos WHERE status = 'ok' AND hidden = 0 AND live_component = 0),
faces AS (SELECT l_orderkey AS photo_id, CASE WHEN l_linenumber <> 7 THEN l_suppkey END AS person_id,
  l_discount * 10 AS quality, l_quantity AS size_px, l_discount AS x1, l_discount + l_quantity / 100 AS x2,
  CASE WHEN l_returnflag = 'A' THEN 'user' ELSE 'auto' END AS source, l_linestatus AS model FROM lineitem),
persons AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 5 <> 0 THEN s_name END AS name,
  CASE WHEN s_suppkey % 3 = 0 THEN DATE '1960-01-01' + (s_suppkey * 37 % 14000)::INT END AS birth_date FROM supplier),
places AS (SELECT n_nationkey AS id, n_name AS name, r_name AS country, n_nationkey * 6.5::DOUBLE - 80 AS lat,
  n_nationkey * 13.0::DOUBLE - 160 AS lon, CASE WHEN n_nationkey % 4 <> 3 THEN 'NATION_' || (n_nationkey - n_nationkey % 4) END AS city,
  'NATION_' || (n_nationkey - n_nationkey % 10) AS admin1 FROM nation JOIN region ON n_regionkey = r_regionkey),
photo_tags AS (SELECT l_orderkey AS photo_id, p_type AS tag, max(round(l_discount * 25, 4)) AS score
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
stream AS (SELECT event_id, user_id, event_type, value, epoch_us(ts) / 1e6 AS ts FROM events)
"""
