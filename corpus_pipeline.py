"""From raw documents to packed training sequences, stage by stage.

Every stage reads all that its predecessor kept, written as Parquet in the
shared folder, and all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm import decontaminate, langid, packing, pii, simhash
from helixframe.llm.common import forget, store, table
from helixframe.llm.queries import tokenizer


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose language can be told: those with a letter. lang stays as it was given.

    Null texts and those without a letter go. Where no label teaches anything, all with a letter stay. Equal costs keep a
    document whichever language wins; repeated rows are judged alike, other columns come back as they were, an empty table stays empty.
    """
    learned = langid.samples(docs)
    if not learned:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    kept = langid.predict(docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), "text"), learned).where("lang_pred <> 'und'")
    return kept.select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each group of near-copies.

    Null and empty texts are near-copies of each other; rows of the same doc_id stay or go together, rows of a null doc_id stay.
    Other columns come back as they were; an empty table stays empty.
    """
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents in which no benchmark item is found.

    Null and empty texts stay, and all rows if the benchmark is empty; repeated rows are judged alike, a similarity
    that equals the bound is a match. Other columns come back as they were.
    """
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps all documents, with personal data replaced by its kind; n_chars follows.

    Null and empty texts stay as they are, repeated rows are masked alike, where spans overlap the first one's kind is written.
    Other columns come back as they were; an empty table stays empty.
    """
    return pii.mask(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 tokens, mixed by source.

    Null and empty texts are one end token; repeated rows are packed as often as they occur, null sources are a
    source of their own, other columns are ignored, an empty table gives no pieces.
    """
    return packing.pack(docs, tokenizer("word_bpe_49k.json"), window=2048, end_id=1)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("personal_data", personal_data), ("pack", pack)]

#: Automata, fingerprints and tokenizers have no SQL form: tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage's table goes when the next one is written."""
    docs, kept = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if kept is not None:
            forget(kept)
        kept = docs
    return docs
