"""From raw documents to packed training sequences.

    language      documents without any letter go; a missing language is filled in, by the greatest cosine, and none is overwritten
    near_dedup    of documents linked by five-word shingles at 0.8 similarity, the smallest id stays
    decontaminate documents that hold a benchmark passage go
    personal      personal data is replaced by tags, terms that reveal it are generalised or removed
    packing       token sequences of at most 1024 ids

Each stage works on all that its predecessor kept; all but the last return the columns of documents.
A repeated row (same id and text) counts as a copy and stays once; rows without id can't be
chosen by id and stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.llm.common import shared_folder, table
from feedloom.llm.decontamination import uncontaminated
from feedloom.llm.language import UNKNOWN, fit, predict
from feedloom.llm.minhash import near_duplicates
from feedloom.llm.packing import pack_documents
from feedloom.llm.pii import sanitised

TOKENIZER = "byte_bpe_50k.json"
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    known = docs.select("doc_id", "text", "lang")
    prototypes = fit(known, F.lit(True))
    if not prototypes:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    rows = predict(docs.select(F.struct(*docs.columns).alias("row")), prototypes, "row").where(F.col("lang_pred") != UNKNOWN)
    return rows.select(F.col("row").withField("lang", F.coalesce("row.lang", "lang_pred")).alias("row")).select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = near_duplicates(docs, words=5, threshold=80).where("kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    chosen = docs.where("doc_id IS NOT NULL").join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return chosen.select(*docs.columns).union(docs.where("doc_id IS NULL"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return uncontaminated(docs, table(spark, sf_dir, "benchmark"))


def personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = sanitised(docs)
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return clean


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs, TOKENIZER, forget=True)


STAGES = [
    ("language", language),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("personal", personal),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's rows are written in the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
