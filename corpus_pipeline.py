"""From raw documents to token ids: each stage works on all that the one before
kept, is written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomfit.llm.bpe import encode_documents
from loomfit.llm.common import read, written
from loomfit.llm.lines import cut_lines
from loomfit.llm.mixing import mix_sources
from loomfit.llm.neardup import near_duplicates
from loomfit.llm.quality import keep_good


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return keep_good(docs, read(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines common to three documents stay in the last one only; n_chars follows."""
    held = cut_lines(docs)
    n_chars = F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("row.n_chars"))
    new = {"text": F.col("text"), "n_chars": n_chars}
    return held.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, as one row (the least by
    text, source, lang, n_chars); rows without a doc_id stay as they are."""
    gone = near_duplicates(docs, k=5).where("not kept").select("doc_id").distinct()
    left = docs.join(gone, "doc_id", "left_anti")
    # the row travels as a struct, so no column of it can clash; rows without a doc_id
    # are groups of their own, so that they don't meet in one task
    own = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id())
    rows = left.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.struct("doc_id", own.alias("own")).alias("group"))
    first = F.row_number().over(Window.partitionBy("group").orderBy("row.text", "row.source", "row.lang", "row.n_chars"))
    return rows.select("row", first.alias("first")).where("first = 1").select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each pass of the mix over a document, in training order; documents
    of which the mix takes nothing go."""
    # docs is a table, so the numbers are the same in both places
    rows = docs.select(F.monotonically_increasing_id().alias("id"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    sizes = rows.select("id", "row.doc_id", "row.text", "row.source")
    passes = mix_sources(sizes, carry=("id",)).where("taken > 0").select("id", "positions")
    taken = rows.join(passes, "id").select("row", F.explode("positions").alias("position"))
    taken = taken.select("row", "position", F.col("row.doc_id").alias("doc_id"))
    taken = taken.repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id")
    return taken.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, and whether they decode to its text."""
    import public_tokenizers

    out = encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2("decoded", 256).alias("decoded_sha256"), "ids")


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("bpe", bpe)]

#: SQL can't express the first stage; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
