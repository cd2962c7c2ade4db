"""A pipeline over ``documents``: each stage is one operator of sitelens.llm, applied to all that the last one kept.

Stages decide by row, never by doc_id, which may be null or repeated: see ``row_key``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelens.llm._text import saved
from sitelens.llm.decontaminate import find_contamination
from sitelens.llm.language_id import held_out
from sitelens.llm.near_dup import near_duplicates
from sitelens.llm.packing import pack_documents
from sitelens.llm.suffix_dedup import remove_repeats
from sitelens.llm.toxicity import score_toxicity


def modest_batches(spark, most: int = 2000) -> None:
    """Lets a Python task get ``most`` rows at a time and no more: a batch of documents is what it holds beside its own tables."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= most:
        spark.conf.set(name, most)


def row_key(docs: DataFrame):
    """A hash of all columns and of which are null: rows of one key are equal in every column."""
    return F.xxhash64(*docs.columns, *(F.col(c).isNull() for c in docs.columns))


def drop_toxic(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out the rows with a toxicity of 0.3 or more; labels of documents held out are not learnt from.

    Each row is scored by its own text, also one of a null or repeated doc_id.
    """
    modest_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~held_out())
    found = score_toxicity(docs, labels, carry=[c for c in docs.columns if c != "doc_id"])
    return found.filter(F.col("score") < 0.3).select(docs.columns)


def keep_one_of_each(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each class of near duplicates: that of the least doc_id, of equal ones that of the least row key.

    A null doc_id comes after all others, so a class of such rows alone keeps one as well. Rows of one doc_id with
    different texts are different rows, one class only if their texts are.
    """
    modest_batches(spark)
    keyed = docs.withColumn("_row", row_key(docs))
    classes = near_duplicates(keyed.select(F.col("_row").alias("doc_id"), "text")).select(F.col("doc_id").alias("_row"), "class_id").distinct()
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row"))
    kept = keyed.select("_row", "doc_id").join(classes, "_row").groupBy("class_id").agg(least.alias("least")).select("least._row")
    return keyed.join(kept, "_row", "left_semi").dropDuplicates(["_row"]).select(docs.columns)


def remove_repeated_passages(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out of the texts every byte of a 200-byte string that comes more than once; half characters at its edges go too.

    Every row stays, also one of a null or repeated doc_id.
    """
    modest_batches(spark)
    keyed = docs.withColumn("_doc", F.col("doc_id")).withColumn("doc_id", row_key(docs))
    found = remove_repeats(keyed, carry=["_doc", *(c for c in docs.columns if c not in ("doc_id", "text", "n_chars"))])
    return found.drop("doc_id").withColumnsRenamed({"_doc": "doc_id", "kept_text": "text"}).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def drop_contaminated(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out the rows that hold half of a benchmark item or more, also those of a null or repeated doc_id."""
    modest_batches(spark)
    keyed = docs.withColumn("_row", row_key(docs))
    bad = find_contamination(keyed.select(F.col("_row").alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(F.col("doc_id").alias("_row")).distinct()
    return keyed.join(bad, "_row", "left_anti").select(docs.columns)


def pack_sequences(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into sequences of at most 4096 tokens; every row is packed for itself, whatever its doc_id."""
    modest_batches(spark)
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", keep_one_of_each),
    ("suffix_dedup", remove_repeated_passages),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

#: SQL can't say any of the stages; tests/llm compares each operator with a plain version.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the whole of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
