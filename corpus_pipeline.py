"""The training-corpus pipeline: five stages over documents, each one of the operators in voxelgrove.llm. Empty tables give empty ones.

Every stage works on all that the stage before kept, and writes Parquet that the next one reads again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelgrove.llm import bpe, langid, linededup, minhash, mixing
from voxelgrove.llm.common import shared_folder
from voxelgrove.llm.queries import rank_file, source_tree

#: Columns of documents that every stage but the last gives back.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: The stage of language ID rejects documents that it can't place, and those it places with less certainty.
MIN_SCORE = 0.3


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select(*(c for c in COLUMNS if c in docs.columns))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language that the network can tell; lang becomes the prediction. Rows are judged one by one, so repeats and ties don't matter."""
    named = langid.identify_languages(docs, with_text=True)
    return _documents(named.where((F.col("lang_pred") != "und") & (F.col("score") >= MIN_SCORE)).withColumn("lang", F.col("lang_pred")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines go; so does a document of which nothing is left. n_chars follows the text. Rows with a null id stay as they are."""
    clean = linededup.remove_boilerplate(docs)
    left = (F.col("n_removed") == 0) | (F.length(F.btrim("text", F.lit(" \t\r\n\x0b\x0c"))) > 0)
    return _documents(clean.where(left).withColumn("n_chars", F.length("text").cast("long")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the one with the smallest id, and all rows that have it. Documents with a null id go."""
    kept = minhash.near_duplicates(docs, words=5, percent=80).where("kept").select("doc_id")
    return _documents(docs.join(kept, "doc_id", "left_semi"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents within their leaf's share of the token budget, each once. Those with a null id go, as they have no place in the order."""
    return _documents(mixing.mix_sources(docs, source_tree(docs), percent=80, epochs=1).where("copies > 0"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The number of tokens of each document, and digests of its token ids and of the bytes that they decode to."""
    return bpe.token_digests(docs, *rank_file())


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mix", mix), ("tokenize", tokenize)]

#: Language ID and tokenising aren't SQL; the tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, with a Parquet table in the shared folder after each but the last."""
    place = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = _documents(spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet"))
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs.write.parquet(f"{place}/{k}-{name}")
            docs = spark.read.parquet(f"{place}/{k}-{name}")
    return docs
