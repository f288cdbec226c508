"""A training-data pipeline over `documents`: toxicity, exact and near duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir), with docs what the stage before kept, and returns a DataFrame;
all but the last return the columns of documents.

Defined results: other columns are not read; an empty table gives an empty one; null and empty texts are equal and
linked with nothing. Decisions are made for each row, which is known by its id (null is one) and a hash of its text, so
rows of one id with different texts are kept or dropped apart. Of rows alike in id and text one is left by the exact
stage. Near copies that share one id, or have none, are not told apart by it: those that name their group stay together.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.llm import exact_dedup, ngram_join, packing, suffix_dedup, toxicity
from lakeloom.llm.common import Workspace, crc_mod

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _columns(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS)


def _keep(docs: DataFrame, decided: DataFrame, once: bool = False) -> DataFrame:
    """The rows of docs whose doc_id and text stand in decided; a null id stands for itself. With once, one of rows alike."""
    keyed = docs.withColumn("_key", F.xxhash64(F.coalesce("text", F.lit(""))))
    rows = decided.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_kept")).distinct()
    out = keyed.join(rows, keyed["doc_id"].eqNullSafe(rows["_id"]) & (keyed["_key"] == rows["_kept"]), "left_semi")
    return out.dropDuplicates(["doc_id", "_key"]) if once else out


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go; it learns from labelled rows of the training folds."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = toxicity.classify(docs, labels, crc_mod(F.col("doc_id"), 4) == 2)
    return _columns(_keep(docs, scored.where("predicted = 0")))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal without white space one document stays."""
    return _columns(_keep(docs, exact_dedup.deduplicate(docs).where("kept"), once=True))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles at a similarity of 0.8 or more one stays, that with the least id."""
    joined = ngram_join.join(docs)
    return _columns(_keep(docs, joined.where(F.col("doc_id").eqNullSafe(F.col("component_id")))))


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that also start earlier are cut out of the texts; a character that a cut splits goes whole.

    Documents of which a cut leaves nothing go; null and empty texts stay as they are. n_chars is counted anew.
    """
    marked = docs.select(*COLUMNS, F.col("text").isNull().alias("no_text"))
    cut = suffix_dedup.deduplicate(marked, carry=("lang", "source", "no_text"), as_text=True)
    texts = cut.select("doc_id", "n_removed", "carried.*", F.when(~F.col("carried.no_text"), F.col("kept")).alias("text"))
    left = texts.where("n_removed = 0 or length(text) > 0")
    return _columns(left.withColumn("n_chars", F.length("text").cast("long")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens, dealt to sequences."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=False)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("ngram_join", drop_near_copies),
    ("suffix_dedup", cut_repeated_passages),
    ("packing", pack),
]

#: Trained models, shingle components and byte-pair codes are beyond SQL: tests/llm has brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of sf_dir; each stage's result is written and read again."""
    ws = Workspace(spark, "corpus_pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        docs = ws.put(out, name)
    return docs
