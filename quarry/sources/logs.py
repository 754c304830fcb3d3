"""Event rows as log lines, files of log lines, and running totals over time
(SRC12, F23, W5). Everything comes from the event table's own columns."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint_dir

ENTRIES_PER_FILE = 5000


def log_line(ts: Column, level: Column, service: Column, message: Column) -> Column:
    """``[yyyy-MM-dd HH:mm:ss] LEVEL | service | message``, the level
    left-aligned in five characters."""
    return F.concat(F.lit("["), F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), F.lit("] "), F.rpad(level, 5, " "),
                    F.lit(" | "), service, F.lit(" | "), message)


def event_lines(events: DataFrame) -> DataFrame:
    """``event_id, ts, day, level, line``: the event type is the service, and
    events of type ``error`` have level ERROR."""
    kind = F.coalesce("event_type", F.lit("event"))
    level = F.when(kind == "error", "ERROR").otherwise("INFO")
    message = F.concat(F.lit("user_id="), F.coalesce(F.col("user_id").cast("string"), F.lit("-")),
                       F.lit(" | value="), F.when(F.col("value").isNotNull(), F.format_string("%.2f", F.col("value"))).otherwise("-"),
                       F.lit(" | k="), F.coalesce(F.get_json_object("props", "$.k"), F.lit("-")))
    return events.select("event_id", "ts", F.date_format("ts", "yyyyMMdd").alias("day"), level.alias("level"),
                         log_line(F.col("ts"), level, kind, message).alias("line"))


def write_log_files(lines: DataFrame, path: str, entries_per_file: int = ENTRIES_PER_FILE) -> str:
    """SRC12: time-ordered text files of at most ``entries_per_file`` lines,
    one directory per day (``day=yyyyMMdd``)."""
    n = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    (lines.repartitionByRange(n, "ts").sortWithinPartitions("ts", "event_id").select("day", "line")
     .write.mode("overwrite").option("maxRecordsPerFile", entries_per_file).partitionBy("day").text(path))
    return path


def running_total(df: DataFrame, value: Column, time_col: str, key_col: str, out_col: str = "total") -> DataFrame:
    """The sum of ``value`` over all rows up to each one, in the order
    (time, key). Rows without a time come last, by key; null values count
    nothing; rows equal in time and key stand in any order.

    The rows are dealt into ranges of (time, key) of about equal size, so that
    an hour with most of the rows is many ranges; a prefix sum over one row per
    range and a window inside each range give the totals."""
    spark = df.sparkSession
    checkpoint_dir(spark)
    order = [F.asc_nulls_last(time_col), F.asc_nulls_last(key_col)]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.withColumn("__v", F.coalesce(value, F.lit(0))).repartitionByRange(parts, *order).withColumn(
        "__p", F.spark_partition_id()).checkpoint()         # ranges come from a sample, so they are fixed here
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("__p").agg(F.sum("__v").alias("__s")).select(
        "__p", F.coalesce(F.sum("__s").over(before), F.lit(0)).alias("__before"))       # one row a range
    inside = Window.partitionBy("__p").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return dealt.withColumn("__in", F.sum("__v").over(inside)).join(F.broadcast(starts), "__p").withColumn(
        out_col, F.col("__before") + F.col("__in")).drop("__p", "__v", "__in", "__before")
