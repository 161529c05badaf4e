"""Five stages from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before
kept. `run` writes each stage's rows to the shared folder and reads them back
for the next, so a lost executor costs a part of one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilia.llm.common import cut, fresh, table

LEAST_LANGUAGE_SCORE = 0.3
MEMO_WORDS = 300_000  # words whose ids a worker remembers; the workers serve the other stages too


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts of no determinable language go: null ones, those without a letter, and those whose best language has little over an even share.

    Rows with null or repeated keys are judged by their texts like all others; columns keep their names and values.
    """
    from vigilia.llm.language import fit_language, predict

    name, score = fresh(docs.columns, "lang_pred", "score")
    named = predict(docs, fit_language(docs, "doc_id", "text", "lang"), "text", docs.columns, (name, score))
    return named.where((F.col(name) != "und") & (F.col(score) >= LEAST_LANGUAGE_SCORE)).select(docs.columns)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts scored as toxic go; the models learn from the labelled ones among the stage's documents.

    Null and empty texts are no evidence and stay; rows with null or repeated keys are judged by their texts like all others.
    """
    from vigilia.llm.toxicity import fit_toxicity, score_texts

    score, predicted = fresh(docs.columns, "score", "predicted")
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"), "doc_id", "text", "toxic")
    return score_texts(docs, model, "text", docs.columns, (score, predicted)).where(F.col(predicted) == 0).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays, that with the least doc_id.

    Rows that repeat a doc_id are one document, of which one row stays; rows with a null doc_id or text stay.
    """
    from vigilia.llm.neardup import keep_one

    return keep_one(docs, "doc_id", "text").select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item go, whatever their doc_id; null and empty texts hold none."""
    from vigilia.llm.decontaminate import drop_contaminated

    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"), "text")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 4096 tokens; a null or empty text is its end alone, rows with equal or null keys are documents of their own."""
    import public_tokenizers

    from vigilia.llm.packing import pack

    return pack(docs, "doc_id", "text", public_tokenizers.path("word_bpe_49k.json"), memo_words=MEMO_WORDS)


STAGES = [("language ID", language_id), ("toxicity", toxicity), ("near dedup", near_dedup), ("decontamination", decontamination), ("packing", packing)]

#: None: no stage's verdict is expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
    return docs
