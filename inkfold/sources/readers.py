"""Readers: correction archive, training shards, data tables, event topics."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from inkfold.schemas import CORRECTION_ARCHIVE, EVENT_TOPICS, LINE_IMAGES, ML_TABLES, TRAINING_SNAPSHOT
from inkfold.sources.topics import read_topic


def _renamed(schema: StructType, rename: dict[str, str]) -> StructType:
    """The schema with wire names in place of ours."""
    wire = StructType()
    for field in schema.fields:
        wire.add(rename.get(field.name, field.name), field.dataType, field.nullable)
    return wire


def _ddl(text: str) -> StructType:
    return StructType.fromDDL(text)


def read_correction_archive(
    spark: SparkSession, path: str, as_of: Column | str | None = None, one_object_per_file: bool = False
) -> DataFrame:
    """Archived corrections under ``date=*/``. Unreadable records and files are skipped; a missing
    archive is empty. ``as_of`` keeps records archived up to that time. A filter on ``date``
    prunes partitions. ``one_object_per_file`` reads indented single-object files."""
    schema = _ddl(f"{CORRECTION_ARCHIVE}, date STRING, _bad STRING")
    reader = (
        spark.read.schema(schema)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_bad")
        .option("ignoreCorruptFiles", "true")
        .option("ignoreMissingFiles", "true")
        .option("pathGlobFilter", "*.json")
        .option("multiLine", str(one_object_per_file).lower())
    )
    try:
        rows = reader.json(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        rows = spark.createDataFrame([], schema)
    rows = rows.where(F.col("_bad").isNull() & F.col("correction_id").isNotNull()).drop("_bad")
    if as_of is None:
        return rows
    limit = F.to_timestamp(F.lit(as_of)) if isinstance(as_of, str) else as_of
    return rows.where(F.try_to_timestamp("archived_at") <= limit)


def read_training_shards(
    spark: SparkSession, path: str, split: str, schema: str = TRAINING_SNAPSHOT
) -> DataFrame:
    """Shards of one split, from ``path/split=<split>/`` or ``path/<split>/``. No shard is an
    error."""
    fields = _ddl(schema)
    without = StructType([f for f in fields.fields if f.name != "split"])
    for folder, shape in ((f"{path}/split={split}", without), (f"{path}/{split}", fields)):
        try:
            rows = spark.read.schema(shape).parquet(folder)
        except AnalysisException as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            continue
        if rows.isEmpty():
            continue
        return rows.withColumn("split", F.lit(split)).select(*fields.names)
    raise FileNotFoundError(f"no parquet shards of split {split!r} under {path}")


def read_line_images(spark: SparkSession, path: str, split: str) -> DataFrame:
    return read_training_shards(spark, path, split, LINE_IMAGES)


def read_ml_tables(
    spark: SparkSession,
    path: str | None = None,
    jdbc: dict[str, str] | None = None,
    tables: list[str] | None = None,
    partitioning: dict[str, dict[str, str]] | None = None,
    rename: dict[str, str] | None = None,
) -> dict[str, DataFrame]:
    """The relational tables, from Parquet folders or over JDBC.

    ``partitioning[table]`` holds ``partitionColumn``, ``lowerBound``, ``upperBound`` and
    ``numPartitions``, so that a JDBC table is read by many tasks. ``rename`` maps our column
    names to the source's."""
    if (path is None) == (jdbc is None):
        raise ValueError("give either a path or JDBC options")
    wire = rename or {}
    found = {}
    for name in tables or list(ML_TABLES):
        fields = _ddl(ML_TABLES[name])
        if path is not None:
            rows = spark.read.schema(_renamed(fields, wire)).parquet(f"{path}/{name}")
        else:
            options = {**jdbc, "dbtable": name, **(partitioning or {}).get(name, {})}
            rows = spark.read.format("jdbc").options(**options).load()
        found[name] = rows.select(
            *[F.col(wire.get(f.name, f.name)).cast(f.dataType).alias(f.name) for f in fields.fields]
        )
    return found


def parse_events(raw: DataFrame, topic: str, rename: dict[str, str] | None = None) -> DataFrame:
    """JSON ``value`` -> topic columns plus ``ts`` and the ``raw`` text. A record that is no valid
    JSON object has a null ``event_id``. Works on batch and streaming frames."""
    fields = _ddl(EVENT_TOPICS[topic])
    wire = rename or {}
    text = F.col("value").cast("string")
    body = F.from_json(text, _renamed(fields, wire))
    return raw.select(text.alias("raw"), body.alias("b")).select(
        *[F.col("b")[wire.get(f.name, f.name)].alias(f.name) for f in fields.fields],
        F.try_to_timestamp(F.col("b.emitted_at")).alias("ts"),
        "raw",
    )


def read_events(
    spark: SparkSession,
    topic: str,
    path: str | None = None,
    kafka: dict[str, str] | None = None,
    streaming: bool = False,
    rename: dict[str, str] | None = None,
    max_files_per_trigger: int = 1000,
    log: str | None = None,
    group: str | None = None,
) -> DataFrame:
    """An event topic from JSON-lines files, Kafka or a segment log (``topics``), from the earliest offset or, for a stream of a
    log, from where ``group`` committed; as batch or stream. Broken records keep a row with their ``raw`` text."""
    if [path, kafka, log].count(None) != 2:
        raise ValueError("give a path, Kafka options or a log")
    if log is not None:
        return parse_events(read_topic(spark, log, streaming=streaming, group=group), topic, rename)
    reader = spark.readStream if streaming else spark.read
    if kafka is not None:
        raw = (
            reader.format("kafka")
            .option("startingOffsets", "earliest")
            .options(**kafka)
            .load()
            .select("value")
        )
    else:
        if streaming:
            reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
        raw = reader.format("text").load(path)
    return parse_events(raw, topic, rename)


def replay_events(events: DataFrame, from_ts: Column, to_ts: Column) -> DataFrame:
    """Bounded re-read of a topic: events in [from, to), each event id once."""
    return events.where((F.col("ts") >= from_ts) & (F.col("ts") < to_ts)).dropDuplicates(["event_id"])
