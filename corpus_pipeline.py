"""Corpus pipeline: language ID, near-duplicate removal, secret redaction, mixing, packing.

Each stage takes the documents its predecessor kept and decides on all of them:

1. ``language_id`` drops documents whose language the compression classifier rejects; it learns from the labelled rows
   of its input.
2. ``near_duplicates`` keeps one document of each near-duplicate class.
3. ``secret_scan`` replaces every secret it finds by its kind in brackets; all documents stay.
4. ``source_mixing`` brings the domains that the labels table teaches to their target shares of tokens: documents are
   left out or repeated by their fitted rates.
5. ``best_fit_packing`` tokenises what is left and places every piece in a sequence.

Defined cases, for all stages: documents with a null text, or one without a letter, have no language and go in stage 1; texts
of any length are read whole; of rows that repeat a doc_id, and of texts that are the same or near copies, one document
stays after stage 2 (the smallest id, of one id the text that comes first); rows without a doc_id are never compared, and
stay, until packing, which carries a null id along; ties of rates and places are broken by hashes of id and text, so a rerun
gives the same rows; an empty table passes all stages and gives an empty result; with no usable label every document stays
once in stage 4. Further columns are carried through stages 1 to 4 whatever their names; ``n_chars`` follows the redacted text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veridock.llm import langid, mixing, neardup, packing, secrets
from veridock.llm.common import discard, table, written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.accepted(docs, langid.fit(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.representatives(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs, length_col="n_chars" if "n_chars" in docs.columns else None)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.sampled(docs, mixing.domains_of_labels(table(spark, sf_dir, "labels")), mixing.TARGETS)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("secret_scan", secret_scan),
    ("source_mixing", source_mixing),
    ("best_fit_packing", best_fit_packing),
]

#: No stage can be stated in SQL: compression, signatures and tokenizers decide.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what a stage keeps is written as Parquet in the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES, 1):
        out = stage(spark, docs, sf_dir)
        if number == len(STAGES):
            return out
        docs, before = written(out, name), docs
        discard(before)
    return docs
