"""The corpus pipeline: training-data operators applied to ``documents``, one stage after the other.

Each stage takes (spark, docs, sf_dir) and returns what it keeps, written as
Parquet and read again as the next stage's documents:

1. toxicity: documents that are judged toxic go;
2. line_dedup: later copies of repeated line runs go, and documents of which
   nothing is left;
3. near_dedup: one document of each group of near duplicates stays;
4. mixing: documents are dropped or repeated (whole) until each source has its
   share of the words;
5. sentencepiece: documents become token ids.

All stages but the last return the columns of documents.  Rows with equal id
and text count as one document from stage 3 on.

Operators get the columns that they read; a row's other columns travel packed
in one, so a column of documents may have any name and keeps its values (but
for ``n_chars``, which follows the text in stage 2).  A decision finds its rows
by their id and a hash of id and text.  Null and empty texts are clean, have no lines to lose, are near
nothing, are not in the mix, as they have no words, and so end at stage 4.  A
null id is an id.  Very long texts are read whole.  An empty table gives an
empty result, with the columns of the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from conductlens.llm.common import row_key, stage, table
from conductlens.llm.line_dedup import dedup_lines
from conductlens.llm.mixing import mix_sources
from conductlens.llm.near_dedup import near_duplicates
from conductlens.llm.sentencepiece_lattice import encode
from conductlens.llm.toxicity import score_toxicity

READ = ["doc_id", "text"]


def _others(docs: DataFrame) -> dict[str, str]:
    """Names of the other columns -> their names while they are packed."""
    return {c: f"c{k}" for k, c in enumerate(docs.columns) if c not in READ}


def _packed(docs: DataFrame) -> DataFrame:
    """doc_id, text, and the other columns as one."""
    others = [F.col(f"`{c}`").alias(at) for c, at in _others(docs).items()]
    return docs.select(*READ, F.struct(*others, F.lit(0).alias("none")).alias("others"))


def _unpacked(packed: DataFrame, docs: DataFrame) -> DataFrame:
    at = _others(docs)
    return packed.select(*[F.col(c) if c in READ else F.col(f"others.{at[c]}").alias(c) for c in docs.columns])


def _keyed(packed: DataFrame) -> DataFrame:
    return packed.withColumn("key", row_key(*READ))


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """Packed documents but for those of a decision (key, doc_id)."""
    out = gone.select(F.col("key").alias("k"), F.col("doc_id").alias("i")).distinct()
    rows = _keyed(_packed(docs))
    return rows.join(out, (F.col("key") == F.col("k")) & F.col("doc_id").eqNullSafe(F.col("i")), "left_anti").drop("key")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator predicts clean."""
    return _unpacked(_without(docs, score_toxicity(docs.select(*READ), table(spark, sf_dir, "labels")).where("predicted = 1")), docs)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of line runs; n_chars follows the text."""
    out = dedup_lines(_packed(docs)).where((F.col("n_removed") == 0) | (F.length(F.trim("text")) > 0))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        at = _others(docs)["n_chars"]
        now = F.when(F.col("n_removed") > 0, F.length("text").cast(kind)).otherwise(F.col(f"others.{at}"))
        out = out.withColumn("others", F.col("others").withField(at, now))
    return _unpacked(out, docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates."""
    out = _without(docs, near_duplicates(docs.select(*READ)).where("not kept"))
    again = docs.groupBy(row_key(*READ)).agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count()
    return _unpacked(out.dropDuplicates(READ) if again else out, docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as many times as the mix takes it whole."""
    copies = mix_sources(docs.select(*READ, "source")).where("copies > 0").groupBy(F.col("key").alias("k"), F.col("doc_id").alias("i")).agg(F.max("copies").cast("int").alias("n"))
    out = _keyed(_packed(docs)).join(copies, (F.col("key") == F.col("k")) & F.col("doc_id").eqNullSafe(F.col("i")))
    return _unpacked(out.withColumn("copy", F.explode(F.sequence(F.lit(1), "n"))), docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, token_ids and whether they decode to the text."""
    return encode(docs.select(*READ))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("mixing", mix),
    ("sentencepiece", tokenize),
]

#: toxicity, the cube method and token ids cannot be written as SQL; tests/llm holds the stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each stage's result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, apply) in enumerate(STAGES):
        docs = apply(spark, docs, sf_dir)
        docs = docs if k == len(STAGES) - 1 else stage(docs)
    return docs
