"""The corpus pipeline: five operators in a row over ``documents``.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept. ``run`` writes every stage's result to the shared folder and reads it
back, so that a lost executor never costs more than the stage at hand.

* quality rules: rejected documents go;
* near duplicates: fingerprints within three bits, or five-word shingle sets of a
  verified similarity of 0.8 or more; of each group one document stays, that of
  the least id (null ids last; of one id, the text of the least hash);
* decontamination: documents with any benchmark window go, however long they are;
* secrets: every found span is replaced by a mark, documents stay;
* packing: the pieces of fixed windows, as op10 returns them.

Defined cases: null texts are empty, fail the quality rules and go; rows are told
apart by id and text, and of rows equal in both the one least by its other
columns stays; texts of any length are whole; columns that bear the name of an
operator's result keep their own values, for every stage but the last returns
the columns of its input; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontamination, packing, quality_rules, secrets, simhash
from tessera.storage import materialise

ORACLE_SQL = None  # hashes and token ids aren't expressible; tests hold it against a brute-force version


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    trusted = quality_rules.trusted_ids(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_rules.judge(docs, trusted).where("kept").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.representatives(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontamination.cleaned(docs, benchmark)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = secrets.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else out


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_path(), with_ids=False)


STAGES = [
    ("quality_rules", quality),
    ("simhash_dedup", near_duplicates),
    ("decontamination", decontaminate),
    ("secrets", redact_secrets),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialise(docs, name)
    return docs
