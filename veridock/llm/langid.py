"""Language identification by compression.

A text belongs to the language whose dictionary helps zstandard to make it smallest. For each language that the labels
have, a raw-content dictionary is made of pieces from all over a bounded sample of its rows; prediction compresses the
whole text, in short blocks so that the dictionary and not the text's own repetitions decides, once per language.

Defined cases: a null text or one without a letter is ``und`` with score 0 and rejected; rows without a language label
are never learned from but are predicted; equal sizes go to the language that sorts first and count as rejected; repeated
rows are predicted alike; a language whose sampled texts have no letter gets no dictionary; with no labelled row
everything is ``und``; an empty table gives an empty result. Other columns of the input are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from veridock.llm.common import arrow_map, id_and_text, table, tidy

#: Bytes of a language's dictionary, compression level and bytes of the blocks that are compressed on their own.
DICTIONARY_BYTES = 131_072
LEVEL = 3
BLOCK = 1024
#: Bound of the sample: labelled rows of each language that are read, characters of a piece, and pieces of each language that
#: are learned from; rows and pieces are chosen by a hash, pieces from anywhere in the texts.
SAMPLE_ROWS, PIECE_CHARS, PIECES = 640, 1000, 192
#: Bytes that all dictionaries have together at most: with very many languages each gets less.
ALL_BYTES = 64 << 20
#: Languages closer than this share of the second-best size are not told apart.
REJECT_MARGIN = 0.002
UNDETERMINED = "und"

_NOT_LETTERS = re.compile(r"[\W\d_]+")
_SCHEMA = "doc_id long, lang_pred string, score double, margin double, rejected boolean"


def letters(text: str) -> bytes:
    """The text's words in lower case, one space between them."""
    return _NOT_LETTERS.sub(" ", text.lower()).encode("utf-8", "replace")


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    if len(content) < 8:
        content = content + b" " * 8
    words = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    words.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=words, write_content_size=False, write_checksum=False, write_dict_id=False)


class Classifier:
    """Per-language dictionaries; calls itself lazily ready in each worker."""

    def __init__(self, dictionaries: dict[str, bytes], reject_margin: float = REJECT_MARGIN):
        self.dictionaries, self.reject_margin = dictionaries, reject_margin

    def predict(self, text: str | None, ready: list | None = None) -> tuple[str, float, float, bool]:
        """(language, score from 0 to 1, margin, rejected)"""
        ready = self.ready() if ready is None else ready
        if not ready or text is None or not any(map(str.isalpha, text)):
            return UNDETERMINED, 0.0, 0.0, True
        content = letters(text)
        blocks = [content[k : k + BLOCK] for k in range(0, len(content), BLOCK)]
        sizes = [sum(len(squeeze(b)) for b in blocks) for _, squeeze in ready]
        best = min(range(len(sizes)), key=sizes.__getitem__)
        if len(sizes) == 1:
            return ready[0][0], 1.0, 1.0, False
        second = min(s for i, s in enumerate(sizes) if i != best)
        margin = (second - sizes[best]) / max(1, second)
        score = 1.0 / sum(2.0 ** -min(s - sizes[best], 60) for s in sizes)
        return ready[best][0], score, margin, margin < self.reject_margin

    def ready(self) -> list:
        return [(lang, _compressor(self.dictionaries[lang]).compress) for lang in sorted(self.dictionaries)]

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = self.ready()
        for batch in batches:
            rows = [self.predict(text, ready) for text in batch.column("text").to_pylist()]
            lang, score, margin, rejected = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(margin, pa.float64()), pa.array(rejected, pa.bool_())],
                names=["doc_id", "lang_pred", "score", "margin", "rejected"],
            )


def fit(labelled: DataFrame, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", sample_rows: int = SAMPLE_ROWS, pieces: int = PIECES) -> Classifier:
    """Dictionaries for all languages of the labelled rows. Of each language about ``sample_rows`` rows are drawn by a hash and
    read in whole, cut into pieces, and ``pieces`` of these, again by a hash, are learned from. So what any task or the
    driver gets is bounded by the languages, not by their rows, and reruns learn the same; only the number of rows of each
    language, one row a language, is broadcast."""
    rows = labelled.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("lang is not null and text is not null")
    counts = rows.groupBy("lang").agg(F.count("*").alias("n"))
    drawn = rows.withColumn("draw", F.xxhash64(F.lit(17), "doc_id", "text")).join(F.broadcast(counts), "lang")
    texts = drawn.where(F.pmod("draw", F.lit(1 << 40)) < F.lit(float(sample_rows) * (1 << 40)) / F.col("n")).dropDuplicates(["lang", "draw"])
    starts = F.sequence(F.lit(0), F.greatest(F.length("text") - 1, F.lit(0)), F.lit(PIECE_CHARS))
    cut = texts.select("lang", "draw", F.posexplode(F.transform(starts, lambda a: F.substring(F.col("text"), a + 1, F.lit(PIECE_CHARS)))).alias("at", "piece")).where(F.col("piece").rlike(r"\p{L}"))
    order = W.partitionBy("lang").orderBy(F.xxhash64(F.lit(19), "draw", "at"), "draw", "at")
    best = cut.withColumn("n", F.row_number().over(order)).where(F.col("n") <= pieces).select("lang", "n", "piece")
    learned: dict[str, list[tuple[int, bytes]]] = {}
    for r in best.toLocalIterator():
        learned.setdefault(r["lang"], []).append((r["n"], letters(r["piece"])))
    tidy(labelled.sparkSession)
    most = min(DICTIONARY_BYTES, ALL_BYTES // max(1, len(learned)))
    return Classifier({lang: b"".join(x for _, x in sorted(parts))[:most] for lang, parts in learned.items()})


def identify(docs: DataFrame, classifier: Classifier, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, margin, rejected for every row; one pass, no shuffle."""
    return arrow_map(id_and_text(docs, id_col, text_col), classifier, _SCHEMA)


def held_out(id_col: str = "doc_id") -> Column:
    """The fold that is never learned from: crc32 of the key as text leaves 2 when divided by 4."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(~held_out()))
    return identify(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "margin", "rejected")


class _Kept:
    """Rows of a table whose text the classifier accepts, all columns as they are."""

    def __init__(self, classifier: Classifier, text_col: str):
        self.classifier, self.text_col = classifier, text_col

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = self.classifier.ready()
        for batch in batches:
            yield batch.filter(pa.array([not self.classifier.predict(t, ready)[3] for t in batch.column(self.text_col).to_pylist()], pa.bool_()))


def accepted(docs: DataFrame, classifier: Classifier, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose language is rejected."""
    return arrow_map(docs, _Kept(classifier, text_col), docs.schema)


QUERIES = {"op7_language_id": op7_language_id}
SQL: dict[str, str] = {}
