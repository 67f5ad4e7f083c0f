"""SRC-2 / ST-1 / SNK-3 / C-17: sensor documents → ``sensors_data`` rows.

The reference polls one device every 6 h and inserts
``(Pond_ID=1, Water_Level, WaterTemp, TDS)``; the insert time becomes
``Updated_at``, pH is never written, and a document that does not parse
inserts nothing.  Here documents arrive as JSON lines in a folder (or a
Kafka value); the same column transform serves the batch twin and the
stream, and the stream is run with ``trigger(availableNow=True)`` by an
outside scheduler in place of the in-process cron.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from farmspark.sources import schemas

DEFAULT_POND = 1


def _field(v: Column, name: str) -> Column:
    return F.try_variant_get(v, f"$.{name}", "double")


def _is_object(v: Column) -> Column:
    """The document is an object: the text parses and is not a bare value."""
    return v.isNotNull() & F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))


def rejected_docs(docs: DataFrame, doc_col: str = "doc", arrived_col: str = "arrived_at") -> DataFrame:
    """(doc, arrived_at, reason) of the documents that give no reading."""
    v = F.try_parse_json(F.col(doc_col))
    return (docs.select(F.col(doc_col).alias("doc"), F.col(arrived_col).cast("timestamp_ntz").alias("arrived_at"),
                        F.when(v.isNull(), F.lit("not JSON")).when(~_is_object(v), F.lit("not an object")).alias("reason"))
            .where(F.col("reason").isNotNull()))


def docs_to_readings(docs: DataFrame, doc_col: str = "doc", arrived_col: str = "arrived_at",
                     pond_col: str | None = None) -> DataFrame:
    """Parse documents once (``try_parse_json``) and map them to the
    ``sensors_data`` schema.  Documents that are not objects give no reading
    (:func:`rejected_docs` lists them); a missing field becomes NULL.  ``pond_col`` keeps a pond id when the source has
    one, otherwise every reading is pond 1 as in the reference."""
    v = F.try_parse_json(F.col(doc_col))
    parsed = docs.select(v.alias("_v"), F.col(arrived_col).alias("_at"),
                         (F.col(pond_col) if pond_col else F.lit(None)).cast("int").alias("_pond"))
    return (parsed.where(_is_object(F.col("_v")))
            .select(F.coalesce(F.col("_pond"), F.lit(DEFAULT_POND)).alias("Pond_ID"),
                    _field(F.col("_v"), "waterLevelInside").alias("Water_Level"),
                    F.lit(None).cast("double").alias("pH"),
                    _field(F.col("_v"), "waterTemp").alias("WaterTemp"),
                    _field(F.col("_v"), "tds").alias("TDS"),
                    F.col("_at").cast("timestamp_ntz").alias("Updated_at")))


def docs_to_source_rows(docs: DataFrame, doc_col: str = "doc", arrived_col: str = "arrived_at") -> DataFrame:
    """SRC-2 the device document as columns (waterLevelInside, waterTemp, tds)."""
    v = F.try_parse_json(F.col(doc_col))
    return (docs.select(v.alias("_v"), F.col(arrived_col).alias("arrived_at"))
            .where(_is_object(F.col("_v")))
            .select(*[_field(F.col("_v"), f.name).alias(f.name) for f in schemas.SENSOR_JSON.fields],
                    "arrived_at"))


def docs_stream(spark: SparkSession, src_dir: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Documents from a folder of JSON-lines files.  The insert time is the
    micro-batch time (``current_timestamp`` is fixed per batch), in the farm's
    zone: the session's."""
    r = spark.readStream.format("text")
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.load(src_dir).select(F.col("value").alias("doc"),
                                  F.current_timestamp().cast("timestamp_ntz").alias("arrived_at"))


def kafka_docs_stream(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    """SRC-2 from a Kafka topic whose values are the device documents; the
    record timestamp is the arrival time.  Needs the spark-sql-kafka
    connector on the cluster (not present in the local test image, so this
    path is not exercised by the tests; the transform is the same one)."""
    return (spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers)
            .option("subscribe", topic).load()
            .select(F.col("value").cast("string").alias("doc"),
                    F.col("timestamp").cast("timestamp_ntz").alias("arrived_at")))


def _query_id(spark: SparkSession, checkpoint: str) -> str:
    """Id of the streaming query, which lives as long as its checkpoint."""
    return json.loads(spark.read.text(f"{checkpoint.rstrip('/')}/metadata", wholetext=True).first()[0])["id"]


def start_ingest(spark: SparkSession, src_dir: str, root: str, checkpoint: str, available_now: bool = True,
                 processing_time: str = "6 hours", docs: DataFrame | None = None) -> StreamingQuery:
    """SNK-3 append readings to ``sensors_data`` of the snapshot ``root``.

    Every micro-batch becomes one part of the table in a new version of the
    snapshot, which lists it; its rejected documents go to
    ``_rejects/sensor_ingest``.  A micro-batch that is run again after a failure
    is not added again; a stream with a new checkpoint is another stream, even
    under an old path.  ``available_now`` processes what has arrived and
    stops (run by an outside scheduler every 6 h); otherwise a processing-time
    trigger keeps the query running.  ``docs``: another source than files."""
    from farmspark.plans.jobs import append_rows

    def put(batch: DataFrame, batch_id: int) -> None:
        stream = _query_id(spark, checkpoint)
        rejected_docs(batch).write.mode("overwrite").parquet(
            f"{root.rstrip('/')}/_rejects/sensor_ingest/batch={stream}-{batch_id}")
        append_rows(docs_to_readings(batch), root, "sensors_data", (stream, batch_id))

    source = docs_stream(spark, src_dir) if docs is None else docs
    w = source.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).outputMode("append")
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=processing_time)
    return w.start()


def append_readings(sensors: DataFrame, readings: DataFrame) -> DataFrame:
    """C-17 new ``sensors_data`` snapshot = old rows ∪ ingested rows."""
    cols = [f.name for f in schemas.SENSORS_DATA.fields]
    return sensors.select(*cols).unionByName(readings.select(*cols))
