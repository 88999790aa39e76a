"""Line deduplication over line-ID sequences.

A document is the sequence of the ids of its non-blank lines.  Distributed
prefix doubling ranks all suffixes of all sequences by their first 1, 2, 4, ...
lines: the rank for twice the length is the place of the pair (rank here, rank
``length`` lines on) among the distinct pairs that repeat, in order; a suffix
whose pair is unique has no copy of that length and no rank from there on.
Suffixes of equal rank are one interval of the suffix array whose common prefix
is at least that long, and two overlapping ranks name the interval of any length
between.

A run of lines qualifies when it holds ``min_words`` words.  For every line the
shortest qualifying run that starts there and the shortest that ends there are
looked up; every run whose interval has an earlier member (smaller doc_id, then
earlier line) is a later copy, and its lines are deleted.  The union of these
runs is the union of all maximal repeated qualifying runs with an earlier copy.
Hot lines are combined before they are shuffled: ranks are given to the distinct
pairs that repeat, and an interval's first member is a minimum.

Defined cases: null and empty texts have no lines and stay as they are; lines
are compared after trimming white space; blank lines carry no words and go
with the line before them; a text of many lines is cut in one pass; rows with equal id and text are one document and are
treated alike; a null id comes after all others; an empty table gives no rows;
other columns are kept.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from conductlens.llm.common import global_index, row_key, stage
from conductlens.llm.mixing import word_count

SPACE = " \t\n\x0b\f\r\x00"  # what is trimmed from a line before it is compared


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per line: ``solid`` if it holds more than spaces."""
    line = F.trim("line", F.lit(SPACE))
    return (
        docs.where(F.col(text_col).isNotNull())
        .select(row_key(id_col, text_col).alias("key"), F.col(id_col).cast("long").alias("id"), F.posexplode(F.split(text_col, "\n")).alias("at", "line"))
        .select("key", "id", "at", F.xxhash64(line).alias("line_id"), word_count(F.col("line")).cast("int").alias("words"), (F.trim("line") != "").alias("solid"))
    )


def _rank_pairs(rows: DataFrame, first: str, second: str, name: str) -> DataFrame:
    """Order-preserving rank of (first, second) among the pairs that repeat, joined back; null where one of them is or the pair is unique."""
    pairs = rows.where(F.col(first).isNotNull() & F.col(second).isNotNull()).groupBy(first, second).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    ranked = global_index(pairs.drop("_n"), [first, second], name)
    return rows.join(ranked, [first, second], "left").drop(first, second)


def repeated_runs(docs: DataFrame, id_col: str, text_col: str, min_words: int) -> DataFrame:
    """(key, at, next): lines, by their place in the document, that a later copy of a repeated run covers, and the place of the next solid line."""
    per_doc = Window.partitionBy("key")
    in_doc = per_doc.orderBy("at")
    # dealt by document once, for what follows
    lines = _lines(docs, id_col, text_col).where("solid").repartition("key").dropDuplicates(["key", "at"])
    lines = lines.withColumn("next", F.lead("at").over(in_doc)).where("words > 0")
    # ``pos`` numbers the lines with words; ``upto`` counts the words of a document up to a line's end
    rows = lines.withColumns({"pos": F.row_number().over(in_doc), "upto": F.sum("words").over(in_doc.rowsBetween(Window.unboundedPreceding, 0)), "total": F.sum("words").over(per_doc)})
    rows = rows.withColumn("before", F.col("upto") - F.col("words"))
    # lines of the shortest run of min_words words that starts (m) or ends (k) here; null if there is none
    ahead = F.count(F.lit(1)).over(per_doc.orderBy("before").rangeBetween(0, min_words - 1))
    behind = F.count(F.lit(1)).over(per_doc.orderBy("upto").rangeBetween(1 - min_words, 0))
    rows = rows.withColumn("m", F.when(F.col("total") - F.col("before") >= min_words, ahead)).withColumn("k", F.when(F.col("upto") >= min_words, behind))
    rows = stage(rows.select("key", "id", "at", "next", "pos", "line_id", F.col("m").cast("int").alias("m"), F.col("k").cast("int").alias("k")))

    # prefix doubling; a run with a second copy consists of lines with a second copy
    ranked = stage(_rank_pairs(rows.withColumn("_zero", F.lit(0)), "line_id", "_zero", "r1").where("r1 is not null"))
    longest = ranked.agg(F.greatest(F.max("m"), F.max("k"))).first()[0] or 1
    length = 1
    while length * 2 <= longest:
        here, ahead_ = f"r{length}", f"_next{length}"
        # no repeated run follows: none of twice the length starts here
        follow = F.max(here).over(per_doc.orderBy("pos").rangeBetween(length, length))
        pair_rank = _rank_pairs(ranked.withColumns({"_a": F.col(here), ahead_: follow}), "_a", ahead_, f"r{length * 2}")
        ranked, length = stage(pair_rank), length * 2
    columns = ["key", "id", "pos", "size", *[f"r{1 << b}" for b in range(length.bit_length())]]
    runs = ranked.where("m is not null").withColumn("size", F.col("m")).select(columns)
    if longest > 1:
        # runs of one line are found from their start
        ends = ranked.where("k > 1").select("key", (F.col("pos") - F.col("k") + 1).alias("pos"), F.col("k").alias("size"))
        runs = stage(runs.unionByName(ranked.join(ends, ["key", "pos"]).select(columns)).dropDuplicates(["key", "pos", "size"]))
    named = []
    for b in range(length.bit_length()):
        width = 1 << b
        named.append(runs.where(F.col("size") == width).select("key", "id", "pos", "size", F.col(f"r{width}").alias("head"), F.col(f"r{width}").alias("tail")))
        if width < longest and width > 1:
            tail = ranked.select("key", F.col("pos").alias("_end"), F.col(f"r{width}").alias("tail"))
            here = runs.where((F.col("size") > width) & (F.col("size") < 2 * width)).withColumn("_end", F.col("pos") + F.col("size") - width)
            named.append(here.join(tail, ["key", "_end"]).select("key", "id", "pos", "size", F.col(f"r{width}").alias("head"), "tail"))
    named = stage(reduce(DataFrame.unionByName, named).where("head is not null and tail is not null"))
    place = F.struct(F.col("id").isNull().alias("n"), F.col("id").alias("i"), F.col("key").alias("k"), F.col("pos").alias("p"))
    # staged, so that Spark can split the rows of a hot line in the join
    firsts = stage(named.groupBy("size", "head", "tail").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1"))
    later = named.join(firsts, ["size", "head", "tail"]).where(place > F.col("first"))
    covered = later.select("key", F.explode(F.sequence("pos", F.col("pos") + F.col("size") - 1)).alias("pos")).distinct()
    return ranked.select("key", "pos", "at", "next").join(covered, ["key", "pos"]).select("key", "at", "next")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 5) -> DataFrame:
    """The documents with later copies of repeated line runs deleted, plus n_lines and n_removed."""
    gone = repeated_runs(docs, id_col, text_col, min_words).groupBy(F.col("key").alias("_key"))
    gone = gone.agg(F.sort_array(F.collect_list(F.struct("at", "next"))).alias("_gone"))
    lines = F.split(text_col, "\n")
    # marks of all lines, in one pass over the deleted ones: a deleted line takes the blank lines after it with it
    last = F.coalesce(F.element_at("_gone", -1)["next"], F.col("n_lines"))
    stretch = lambda g, i: F.concat(
        F.array_repeat(F.lit(False), g["at"] - F.when(i > 0, F.get("_gone", i - 1)["next"]).otherwise(0)),
        F.array_repeat(F.lit(True), F.coalesce(g["next"], F.col("n_lines")) - g["at"]),
    )
    marks = F.concat(F.flatten(F.transform("_gone", stretch)), F.array_repeat(F.lit(False), F.col("n_lines") - last))
    kept = F.filter(F.zip_with(lines, marks, lambda x, out: F.struct(x.alias("x"), out.alias("out"))), lambda e: ~e["out"])
    return (
        docs.withColumn("_key", row_key(id_col, text_col))
        .join(gone, "_key", "left")
        .withColumn("n_lines", F.when(F.col(text_col).isNull(), 0).otherwise(F.size(lines)))
        .withColumn("n_removed", F.coalesce(F.size("_gone"), F.lit(0)))
        .withColumn(text_col, F.when(F.col("n_removed") > 0, F.array_join(F.transform(kept, lambda e: e["x"]), "\n")).otherwise(F.col(text_col)))
        .drop("_key", "_gone")
    )
