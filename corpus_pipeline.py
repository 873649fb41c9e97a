"""Cleaning of a training corpus: toxic documents go, repeated lines go, one of each group of near copies stays, documents
with benchmark text go, and what is left becomes token ids. Each stage works on what the one before has kept.

Rows stay or go one by one: a stage that decides by a join numbers its rows first, in a stored table, so null and repeated
ids take no other row along. Null and empty texts are texts without words. Columns besides doc_id and text are carried
along under whatever names; an empty table gives an empty result.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.llm import toxicity
from quarryline.llm.common import ship, small_enough, stored, table
from quarryline.llm.decontamination import leaks
from quarryline.llm.jaccard import near_duplicates
from quarryline.llm.linedup import dedup_lines
from quarryline.llm.queries import held_out, tokenizer_path
from quarryline.llm.viterbi import sp_encode
from quarryline.session import remove, scope


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a number of its own for each row, written down so that it stays, and the new column's name."""
    name = "__row"
    while name in docs.columns:
        name += "_"
    return stored(docs.withColumn(name, F.monotonically_increasing_id()), "rows"), name


def by_row(rows: DataFrame, row: str, chosen: DataFrame, how: str) -> DataFrame:
    """The rows that are among the numbers ``chosen`` (left_semi) or not (left_anti), without their number."""
    chosen = stored(chosen.select(F.col("doc_id").alias("__chosen")).distinct(), "chosen")
    if small_enough(chosen.count(), 16):
        chosen = F.broadcast(chosen)
    return rows.join(chosen, rows[row] == chosen["__chosen"], how).drop(row)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that score below 0.5. The model learns from the labels of ``docs`` but for those that op3 holds out. A null
    or empty text, and a very long one, is scored like others; a null text has no toxic passage."""
    ship(spark)
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").filter(~held_out())
    return toxicity.clean_rows(docs, toxicity.fit(docs, labels))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, without the lines that ten or more of them have; n_chars follows the text. A null text becomes empty."""
    ship(spark)
    return dedup_lines(docs).drop("n_lines", "n_dropped").withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group that links connect: that of the least id, null last, then the one that comes first in the
    stored table. Rows without a word, null texts included, are one group. Rows of equal ids on different texts, and null
    ids, are told apart."""
    ship(spark)
    rows, row = numbered(docs)
    found = stored(near_duplicates(rows.select(F.col(row).alias("doc_id"), "text")), "near")
    named = found.join(rows.select(F.col(row).alias("row"), F.col("doc_id").cast("long").alias("id")), F.col("doc_id") == F.col("row"))
    first = named.groupBy("class_id").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("first"))
    return by_row(rows, row, first.select(F.col("first.row").alias("doc_id")), "left_semi")


def drop_benchmark_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that overlap with no benchmark item. Null and empty texts overlap with none."""
    ship(spark)
    rows, row = numbered(docs)
    found = leaks(rows.select(F.col(row).alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    return by_row(rows, row, found, "left_anti")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids) of every row, whatever its id; a null or empty text is the space mark alone."""
    ship(spark)
    return sp_encode(docs, tokenizer_path("piece_bpe_32k.model")).select("doc_id", "n_tokens", "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("jaccard_join", drop_near_copies),
    ("decontamination", drop_benchmark_text),
    ("sentencepiece", encode),
]

#: A learnt score and a tokenizer's search aren't SQL; tests hold the stages against plain code.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written to the shared folder and read again. What a stage stored on its way
    goes when its result is written, and so does the result before it; the last stage's stays for who reads the rows."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with scope(spark):
            made = stored(stage(spark, docs, sf_dir), name, kept=True)
        if before:
            remove(spark, before)
        docs, before = made, os.path.dirname(made.inputFiles()[0]) if made.inputFiles() else None
    return STAGES[-1][1](spark, docs, sf_dir)
