"""Lineage cuts in the shared folder, a global order without one big sort, running values over it."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder that spark.checkpoint.dir names, below one folder for each application."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        local = tempfile.mkdtemp(prefix="spark-stage-")
        atexit.register(shutil.rmtree, local, ignore_errors=True)
        folder = f"file://{local}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def clear_stages(spark: SparkSession) -> None:
    """Delete what this application has written to the shared folder; no frame made from it can be used afterwards."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_folder(spark, "x")).getParent()
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stage(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it back."""
    spark: SparkSession = df.sparkSession
    path = shared_folder(spark, "stage")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Shared:
    """A frame that is made when it is first used, and written when it is used again."""

    def __init__(self, make: Callable[[], DataFrame]):
        self.make, self.df, self.uses = make, None, 0

    def __call__(self) -> DataFrame:
        self.uses += 1
        if self.uses == 1:
            self.df = self.make()
        elif self.uses == 2:
            self.df = stage(self.df)
        return self.df


def ranged(df: DataFrame, order: list[str]) -> DataFrame:
    """Rows in range partitions, sorted in place, with their partition (_part) and a number that grows in this order (_at); written, so that a repeated evaluation sees the same partitions."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    done = stage(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    return done.withColumn("_part", F.shiftright("_at", 33))


def global_index(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Number rows 0.. in a total order: range partitions sorted in place, plus the sizes of the ones before.

    The table of sizes has one row per partition.
    """
    done = ranged(df, order)
    local = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = done.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    return done.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_offset") + local).drop("_part", "_offset", "_at")


def running(df: DataFrame, order: list[str], sums: dict[str, Column], largest: dict[str, Column] | None = None) -> DataFrame:
    """Adds running sums (the row included) and running maxima (of the rows before) in a total order.

    The windows are range partitions; the partitions' own sums and maxima are
    carried on in a table of one row per partition.
    """
    largest = largest or {}
    done = ranged(df, order)
    in_part = Window.partitionBy("_part").orderBy("_at")
    upto, before = in_part.rowsBetween(Window.unboundedPreceding, 0), in_part.rowsBetween(Window.unboundedPreceding, -1)
    totals = done.groupBy("_part").agg(*[F.sum(x).alias(f"_s_{k}") for k, x in sums.items()], *[F.max(x).alias(f"_m_{k}") for k, x in largest.items()])
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        "_part",
        *[F.coalesce(F.sum(f"_s_{k}").over(earlier), F.lit(0)).alias(f"_c_{k}") for k in sums],
        *[F.max(f"_m_{k}").over(earlier).alias(f"_c_{k}") for k in largest],
    )
    local = done.withColumns({**{k: F.sum(x).over(upto) for k, x in sums.items()}, **{k: F.max(x).over(before) for k, x in largest.items()}})
    joined = local.join(F.broadcast(carried), "_part")
    joined = joined.withColumns({**{k: F.col(k) + F.col(f"_c_{k}") for k in sums}, **{k: F.greatest(k, f"_c_{k}") for k in largest}})
    return joined.drop("_part", "_at", *[f"_c_{k}" for k in [*sums, *largest]])


class Running(NamedTuple):
    """A running value: ``kind`` is sum, max, last (not null) or xor; ``own`` counts the row itself."""

    kind: str
    column: Column
    own: bool = False


def _whole(kind: str, x: Column) -> Column:
    if kind == "last":
        return F.max_by(x, F.when(x.isNotNull(), F.col("_at")))
    return {"sum": F.sum, "max": F.max, "xor": F.bit_xor}[kind](x)


def _over(kind: str, x: Column, window) -> Column:
    return (F.last(x, ignorenulls=True) if kind == "last" else _whole(kind, x)).over(window)


def _joined(kind: str, earlier: Column, later: Column) -> Column:
    zero = lambda x: F.coalesce(x, F.lit(0))
    if kind == "sum":
        return zero(earlier) + zero(later)
    if kind == "xor":
        return zero(earlier).bitwiseXOR(zero(later))
    return F.greatest(earlier, later) if kind == "max" else F.coalesce(later, earlier)


def scan(done: DataFrame, keys: list[str], values: dict[str, Running]) -> DataFrame:
    """Adds running values within each key to rows that ``ranged`` has put in order of (keys, ...).

    No key is one task: a window ends with its range partition, and what a key
    has gathered in the partitions before is carried on in a table of one row
    per partition.  Null keys are a key of their own.
    """
    key = F.struct(*keys) if keys else F.struct(F.lit(0).alias("all"))
    # of each partition its first key, and its last one with what that has gathered
    each = done.groupBy("_part", key.alias("_key")).agg(
        F.min("_at").alias("_low"), F.max("_at").alias("_high"), F.struct(F.lit(0).alias("_none"), *[_whole(v.kind, v.column).alias(k) for k, v in values.items()]).alias("_t")
    )
    tails = each.groupBy("_part").agg(F.min_by("_key", "_low").alias("_first"), F.max_by(F.struct("_key", "_t"), "_high").alias("_l"))
    tails = tails.select("_part", "_first", F.col("_l._key").alias("_last"), *[F.col(f"_l._t.{k}").alias(f"_t_{k}") for k in values])
    through = Window.partitionBy("_last").orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)
    parts = Window.orderBy("_part")
    goes_on = F.lag("_last").over(parts).eqNullSafe(F.col("_first")) & F.lag(F.lit(1)).over(parts).isNotNull()
    carried = tails.withColumns({f"_t_{k}": _over(v.kind, F.col(f"_t_{k}"), through) for k, v in values.items()}).select(
        "_part", "_first", *[F.when(goes_on, F.lag(f"_t_{k}").over(parts)).alias(f"_c_{k}") for k in values]
    )
    here = Window.partitionBy("_part", *keys).orderBy("_at")
    upto, before = here.rowsBetween(Window.unboundedPreceding, 0), here.rowsBetween(Window.unboundedPreceding, -1)
    out = done.withColumns({f"_v_{k}": _over(v.kind, v.column, upto if v.own else before) for k, v in values.items()}).join(F.broadcast(carried), "_part")
    at_seam = key.eqNullSafe(F.col("_first"))
    out = out.withColumns({k: _joined(v.kind, F.when(at_seam, F.col(f"_c_{k}")), F.col(f"_v_{k}")) for k, v in values.items()})
    return out.drop("_first", *[f"_{x}_{k}" for k in values for x in "cv"])


def segmented(df: DataFrame, keys: list[str], order: list[str], values: dict[str, Running]) -> DataFrame:
    """Running values within each key in the given order, without a window over a key; see ``scan``."""
    return scan(ranged(df, [*keys, *order]), keys, values).drop("_part", "_at")
