"""Staging, size-checked joins and distributed numbering.

Nothing here collects data: only counts and other scalars reach the driver.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F
from pyspark.sql.types import ArrayType, BinaryType, MapType, StringType, StructType

BROADCAST_ROWS = 200_000      # a lookup side up to this many rows
BROADCAST_BYTES = 32 << 20    # and of this many bytes is broadcast
HOT_ROWS = 500_000            # a key with more rows than this is salted
BLOCK_ROWS = 1_000_000        # rows of one ordered block


def staging_root(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; a local run may do without one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    root = tempfile.mkdtemp(prefix="siftlog-stage-")
    spark.sparkContext.setCheckpointDir(root)
    return root


def stage(df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: short lineage, known size."""
    spark = df.sparkSession
    path = f"{staging_root(spark)}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _folder(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def folder_exists(spark: SparkSession, path: str) -> bool:
    fs, place = _folder(spark, path)
    return fs.exists(place)


def drop_folder(spark: SparkSession, path: str) -> None:
    fs, place = _folder(spark, path)
    fs.delete(place, True)


def evaluate_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns behind a one-row ``inline``.

    Costly expressions (many regexes) are then worked out once per row: a later
    filter or projection reads the result and is not rewritten into a copy of
    the whole expression below.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def row_bytes(schema: StructType, prefix: str = "") -> Column:
    """About the bytes of a row: 8 for a plain value, the length of texts, the elements of arrays and maps."""
    total = F.lit(0).cast("bigint")
    for f in schema.fields:
        c, kind = F.col(f"{prefix}`{f.name}`"), f.dataType
        if isinstance(kind, (StringType, BinaryType)):
            total = total + F.coalesce(F.octet_length(c), F.lit(0)) + 8
        elif isinstance(kind, (ArrayType, MapType)):
            inner = kind.elementType if isinstance(kind, ArrayType) else kind.valueType
            if isinstance(inner, (StringType, BinaryType, StructType, ArrayType, MapType)):
                total = total + F.coalesce(F.octet_length(F.to_json(c)), F.lit(0)) + 8
            else:
                total = total + F.coalesce(F.size(c), F.lit(0)) * (8 if isinstance(kind, ArrayType) else 32) + 8
        elif isinstance(kind, StructType):
            total = total + row_bytes(kind, f"{prefix}`{f.name}`.")
        else:
            total = total + 8
    return total


def fits(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether ``df`` has at most ``rows`` rows and about ``size`` bytes; reads no more rows than that."""
    n, held = df.limit(rows + 1).agg(F.count(F.lit(1)), F.sum(row_bytes(df.schema))).first()
    return n <= rows and (held or 0) <= size


def null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    test = F.lit(True)
    for k in keys:
        test = test & left[k].eqNullSafe(right[k])
    return test


def lookup_join(facts: DataFrame, dim: DataFrame, keys: list[str], how: str = "inner",
                hot_rows: int = HOT_ROWS, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Join many fact rows to a lookup side with one row per key.

    A lookup side of checked size is broadcast.  A larger one is shuffled, and
    the keys that own more than ``hot_rows`` facts are spread over salts so
    that no task receives a whole hot key.  The list of hot keys is bounded by
    (facts / hot_rows) and is itself checked before it is broadcast.
    """
    if fits(dim, broadcast_rows):
        return facts.join(F.broadcast(dim), keys, how)
    hot = (facts.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > hot_rows)
           .withColumn("_salts", F.ceil(F.col("_n") / F.lit(hot_rows)).cast("int")).drop("_n"))
    hot = stage(hot)
    if not fits(hot, broadcast_rows):
        return lookup_join(facts, dim, keys, how, hot_rows * 10, broadcast_rows)
    # the salt is a function of the row, so a repeated task sends its rows to the same places
    parts = [f.name for f in facts.schema.fields if "map<" not in f.dataType.simpleString() and f.name not in keys]
    row = F.xxhash64(*parts) if parts else F.monotonically_increasing_id()
    spread = (facts.join(F.broadcast(hot), keys, "left")
              .withColumn("_salt", F.when(F.col("_salts").isNull(), 0)
                          .otherwise(F.pmod(row, F.col("_salts")).cast("int"))).drop("_salts"))
    copies = (dim.join(F.broadcast(hot), keys, "left")
              .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1)))
              .drop("_salts"))
    return spread.join(copies, [*keys, "_salt"], how).drop("_salt")


def number_ordered(df: DataFrame, order: list[Column], name: str, partitions: int | None = None) -> DataFrame:
    """Contiguous 0-based positions in a total order, without a single-task sort.

    Rows are range partitioned and sorted, staged once, and each partition's
    start is the running total of the partition sizes (one small row each).
    """
    spark = df.sparkSession
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = (df.repartitionByRange(partitions, *order).sortWithinPartitions(*order)
              .withColumn("_mid", F.monotonically_increasing_id()))
    staged = stage(ranged)
    part = F.shiftright("_mid", 33)
    staged = staged.withColumn("_part", part).withColumn("_at", F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = staged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return (staged.join(F.broadcast(starts), "_part")
            .withColumn(name, (F.col("_start") + F.col("_at")).cast("bigint"))
            .drop("_part", "_at", "_mid", "_start"))


def block_of(position: Column | str, rows: int = BLOCK_ROWS) -> Column:
    position = F.col(position) if isinstance(position, str) else position
    return F.floor(position / F.lit(rows)).cast("bigint")


def number_as_read(df: DataFrame, name: str, start: int = 0) -> DataFrame:
    """Contiguous numbers in reading order: staged once, then one offset per partition."""
    rows = stage(df.withColumn("_mid", F.monotonically_increasing_id()))
    rows = rows.withColumn("_part", F.shiftright("_mid", 33))
    sizes = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_first"))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("_part", "_first", (F.coalesce(F.sum("_n").over(before), F.lit(0)) + start).alias("_off"))
    return (rows.join(F.broadcast(offsets), "_part")                       # one row per read partition
            .withColumn(name, (F.col("_off") + F.col("_mid") - F.col("_first")).cast("bigint"))
            .drop("_part", "_mid", "_first", "_off"))
