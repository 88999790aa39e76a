from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from conductlens.functions.staging import Running, ranged, scan, segmented


def by_window(df):
    w = Window.partitionBy("k").orderBy("o")
    before, upto = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(Window.unboundedPreceding, 0)
    zero = lambda c: F.coalesce(c, F.lit(0))
    return df.select(
        "k", "o", F.sum("v").over(upto).alias("s"), zero(F.sum("v").over(before)).alias("s0"), F.max("v").over(before).alias("m"),
        F.last("t", ignorenulls=True).over(upto).alias("l"), F.last("t", ignorenulls=True).over(before).alias("l0"), zero(F.bit_xor("v").over(upto)).alias("x"),
    )


KINDS = {"s": ("sum", "v", True), "s0": ("sum", "v", False), "m": ("max", "v", False), "l": ("last", "t", True), "l0": ("last", "t", False), "x": ("xor", "v", True)}
COLUMNS = ["k", "o", *KINDS]


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from([None, "a", "b", "c"]), st.integers(-9, 9), st.sampled_from([None, "x", "y"])), max_size=60))
def test_scan_is_the_window(spark, rows):
    df = spark.createDataFrame([(k, o, v, t) for o, (k, v, t) in enumerate(rows)], "k string, o int, v long, t string")
    got = segmented(df, ["k"], ["o"], {k: Running(kind, F.col(c), own) for k, (kind, c, own) in KINDS.items()}).select(*COLUMNS).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, by_window(df).select(*COLUMNS).collect()))


def test_one_key_is_many_tasks(spark):
    """A key that holds all rows is spread over the range partitions, and its values are carried through all of them."""
    df = spark.range(40_000).select(F.lit("hot").alias("k"), F.col("id").alias("o"), F.lit(1).alias("v"))
    done = ranged(df, ["k", "o"])
    sizes = [r.n for r in done.groupBy("_part").agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == 4 and max(sizes) < 13_000
    out = scan(done, ["k"], {"s": Running("sum", F.col("v"), own=True)})
    assert out.where("s <> o + 1").count() == 0


def test_no_key_and_no_rows(spark):
    df = spark.createDataFrame([(2, 1), (1, 5)], "o int, v long")
    assert sorted(tuple(r) for r in segmented(df, [], ["o"], {"s": Running("sum", F.col("v"), own=True)}).select("o", "s").collect()) == [(1, 5), (2, 6)]
    assert segmented(df.limit(0), [], ["o"], {"s": Running("sum", F.col("v"))}).count() == 0
