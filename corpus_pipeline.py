"""The corpus pipeline: five stages over ``documents``, each written and read again.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before has kept. All but the last return the columns of ``documents``.

Defined cases of all stages: an empty table stays empty; a null text is an empty one; rows that share an id are judged each by its own text; a null id
is an id; extra columns stay, and those that begin with ``__op`` are ours; very long texts are processed whole.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlens.llm import byte_bpe, decontaminate, line_chunks, ngram_join, quality_rules
from pairlens.llm.common import picked, shared_folder, table
from pairlens.llm.queries import tokenizer


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current policy keeps; the whole row travels as the ledger's id. Null and empty texts have too few words; repeated rows share their fate."""
    kept = quality_rules.ledger(docs.select(F.struct(*docs.columns).alias("doc_id"), "text"))
    return picked(kept, quality_rules.keeps()).select("doc_id.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated runs of lines leave the texts; documents of which no word is left go; n_chars follows the text. The first holder (least id, then text) keeps its lines, and so do rows that repeat it."""
    return line_chunks.deduplicate(docs, drop_emptied=True).withColumn("n_chars", F.char_length("text").cast("long")).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of copies and near copies: the least id, of its texts that of the least digest, of rows that repeat both any one."""
    return ngram_join.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage; repeated rows share their fate, and an empty benchmark takes nothing."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every kept text, where each token lies in it, and the digest of what the ids decode to."""
    encoded = byte_bpe.encode(docs, *tokenizer())
    return encoded.select("doc_id", "ids", "starts", "ends", F.size("ids").cast("long").alias("n_tokens"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality rules", quality), ("line dedup", line_dedup), ("n-gram Jaccard join", near_duplicates), ("benchmark decontamination", decontamination), ("byte-level BPE", tokens)]

#: Hash boundaries, MinHash candidates and BPE are not SQL; a brute-force version in the tests stands for it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and reread."""
    shared_folder(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        at = f"{spark.sparkContext.getCheckpointDir()}/{name.replace(' ', '-')}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
    return docs
