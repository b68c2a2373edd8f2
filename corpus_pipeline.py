"""A pipeline that makes packed training sequences out of documents.

Each stage reads what the one before kept.  Documents that a stage rejects go:
those without a language, those of low quality, and all but one of each group
of near-duplicates.  Personal data is masked, and what is left is packed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselark.llm import langid, neardup, packing, pii, quality
from tesselark.llm.queries import tokenizer_file
from tesselark.llm.shared import crc_mod, cut, table

#: A document stays if its language's probability is at least this.
LEAST_LANGUAGE = 0.35


def whole_rows(docs: DataFrame) -> DataFrame:
    """Every row as one column next to its text, so that a labeller can carry rows along."""
    return docs.select(F.struct(*docs.columns).alias("row"), "text")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose text has letters and a language that the network is sure enough of.

    Null and empty texts have none and go.  Where no label was there to learn
    from, texts with letters stay.
    """
    net = langid.train(docs, crc_mod(F.col("doc_id"), 4) != 2)
    if not net.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    found = langid.label(whole_rows(docs), net, id_col="row")
    return found.where((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= LEAST_LANGUAGE)).select("row.*")


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that the quality network predicts as good.

    A null text is scored as an empty one, an empty one like any other; rows
    with a null id and repeated rows are judged one by one.  Other columns stay.
    An empty table gives an empty one.
    """
    net = quality.train(docs, table(spark, sf_dir, "labels"), crc_mod(F.col("doc_id"), 5) != 0)
    return quality.score(whole_rows(docs), net, id_col="row").where("predicted = 1").select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near-duplicates.

    Documents with a null id can't be named as duplicates and stay; rows equal
    in id and text stay once.
    """
    kept = neardup.near_duplicates(docs, words=5, percent=80).where("kept and doc_id is not null").select("doc_id").distinct()
    named = docs.where("doc_id is not null").join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return docs.where("doc_id is null").unionByName(named)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks every span of personal data; n_chars follows the text."""
    masked = pii.redact(docs, pii.find_personal_data(docs))
    return masked.withColumn("n_chars", F.length("text").cast("long"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all documents into sequences of at most 2048 tokens."""
    return packing.pack_documents(docs, tokenizer_file("word_bpe_49k.json"), size=2048, end_id=0)


STAGES = [
    ("language_id", language_id),
    ("quality", quality_filter),
    ("near_dedup", near_dedup),
    ("personal_data", mask_personal_data),
    ("packing", pack),
]

#: The networks and the tokenizer can't be written in SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written before the next reads them."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = cut(docs)
    return docs
