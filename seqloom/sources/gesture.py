"""The gesture text format: records parted by blank lines; # begins a comment, @ names the label, other lines are points."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FIELDS_9 = ["x", "y", "z", "acc_x", "acc_y", "acc_z", "pitch", "roll", "yaw"]
FIELDS_6 = ["x", "y", "z", "pitch", "roll", "yaw"]
LABELS = ["PUSH", "WAVE", "SQUARE", "CIRCLE", "FOUR", "NINE"]


def read_gestures(spark: SparkSession, path: str) -> DataFrame:
    """seq_id (from 0, within a file), label (UNKNOWN if it has none), pos (from 0), point (its numbers). One or more blank lines part records; the
    last needs none after it. Files are read whole, one task for each."""
    text = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", "\r", "").alias("value"))
    records = text.select(F.posexplode(F.filter(F.split("value", r"\n[ \t]*\n\s*"), lambda r: r.rlike(r"(?m)^\s*[^#\s]"))).alias("seq_id", "record"))
    lines = F.filter(F.transform(F.split("record", "\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~x.startswith("#"))
    rows = records.select("seq_id", lines.alias("lines"))
    label = F.coalesce(F.get(F.transform(F.filter("lines", lambda x: x.startswith("@")), lambda x: F.trim(F.regexp_replace(x, "^@", ""))), 0), F.lit("UNKNOWN"))
    points = F.filter("lines", lambda x: ~x.startswith("@"))
    rows = rows.select("seq_id", label.alias("label"), F.posexplode(points).alias("pos", "line"))
    return rows.select("seq_id", "label", "pos", F.transform(F.split("line", r"\s+"), lambda x: x.cast("double")).alias("point"))


def write_gestures(points: DataFrame, path: str) -> None:
    """A table as read_gestures gives it, as text; records of one sequence stay together."""
    line = F.array_join(F.transform("point", lambda x: F.regexp_replace(x.cast("string"), r"\.0$", "")), " ")
    records = points.groupBy("seq_id", "label").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", line.alias("s")))), lambda p: p["s"]), "\n").alias("body"))
    text = F.concat(F.lit("# gesture #"), F.col("seq_id") + 1, F.lit("\n@ "), "label", F.lit("\n"), "body", F.lit("\n\n"))
    records.repartitionByRange("seq_id").sortWithinPartitions("seq_id").select(text.alias("value")).write.mode("overwrite").text(path)


def sequences(points: DataFrame) -> DataFrame:
    """seq_id, label, points (array of points in order)."""
    return points.groupBy("seq_id", "label").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "point"))), lambda p: p["point"]).alias("points"))
