"""Language ID: held-out accuracy, learning only from the given rows, defined cases."""

import re

import zstandard
from pyspark.sql import functions as F

from tests.conftest import DATA
from veridock.llm import langid


def test_held_out_accuracy(spark):
    out = langid.op7_language_id(spark, DATA.replace("0.001", "0.01"))
    docs = spark.read.parquet(f"{DATA.replace('0.001', '0.01')}/documents.parquet").select("doc_id", "lang")
    both = out.join(docs, "doc_id").where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("a"), F.count("*").alias("n")).first()
    assert both["n"] > 200 and both["a"] > 0.95
    assert out.where("score < 0 or score > 1").count() == 0


SCHEMA = "doc_id long, text string, lang string, score double, source string"
ROWS = [(i, f"the cat and the dog number {i} went to the house", "en", 0.0, None) for i in range(30)] + [(i, f"der hund und die katze nummer {i} gingen in das haus", "de", 0.0, None) for i in range(30, 60)]


def test_defined_cases(spark):
    cases = [(100, None, None, 1.0, "x"), (101, "", None, 1.0, "x"), (102, "123 -- !", None, 1.0, "x"), (103, "die katze und der hund " * 3000, None, 1.0, "x"), (103, "die katze und der hund " * 3000, None, 1.0, "x"), (None, "the dog and the cat", "en", 1.0, "x")]
    df = spark.createDataFrame(ROWS + cases, SCHEMA)
    model = langid.fit(df)
    out = {}
    for r in langid.identify(df, model).collect():
        out.setdefault(r.doc_id, []).append(r)
    assert [out[i][0].lang_pred for i in (100, 101, 102)] == ["und"] * 3 and all(out[i][0].score == 0 for i in (100, 101, 102))
    assert [r.lang_pred for r in out[103]] == ["de", "de"] and out[None][0].lang_pred == "en"
    kept = langid.accepted(df, model)
    assert kept.columns == df.columns and {100, 101, 102}.isdisjoint(r.doc_id for r in kept.collect())
    assert kept.count() == len(ROWS) + 3


def plain(texts, dictionaries):
    """The method one text and one language at a time: (language, margin) by the smallest sum of compressed blocks."""
    out = []
    for text in texts:
        words = re.sub(r"[\W\d_]+", " ", text.lower()).encode()
        sizes = {}
        for lang, content in dictionaries.items():
            primed = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            squeeze = zstandard.ZstdCompressor(level=langid.LEVEL, dict_data=primed, write_content_size=False, write_checksum=False, write_dict_id=False)
            sizes[lang] = sum(len(squeeze.compress(words[a : a + langid.BLOCK])) for a in range(0, len(words), langid.BLOCK))
        first, second = sorted(sizes.values())[:2]
        out.append((min(lang for lang, n in sizes.items() if n == first), (second - first) / second))
    return out


def test_predictions_equal_plain_compression(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").where("text is not null")
    model = langid.fit(docs.where(~langid.held_out()))
    assert sorted(model.dictionaries) == sorted(r.lang for r in docs.select("lang").distinct().collect())
    texts = {r.doc_id: r.text for r in docs.collect() if re.search(r"[^\W\d_]", r.text)}
    found = {r.doc_id: (r.lang_pred, r.margin) for r in langid.identify(docs, model).collect() if r.doc_id in texts}
    want = dict(zip(texts, plain(texts.values(), model.dictionaries), strict=True))
    assert {i: w for i, (w, _) in found.items()} == {i: w for i, (w, _) in want.items()}
    assert all(abs(found[i][1] - want[i][1]) < 1e-12 for i in want)


def test_every_language_is_learned_and_from_all_over_the_texts(spark):
    word = lambda k, i: "".join(chr(97 + (k * 7 + i * 3 + j * (k % 5 + 1)) % 26) for j in range(6))
    rows = [(k, " ".join(word(k, i % 9) for i in range(60)), f"l{k:03}", 0.0, None) for k in range(300)]
    model = langid.fit(spark.createDataFrame(rows, SCHEMA))
    assert len(model.dictionaries) == 300
    long = "x " * 40_000 + " ".join(f"tail{c}" for c in "abcdefghij" * 4000)
    model = langid.fit(spark.createDataFrame([(1, long, "en", 0.0, None)], SCHEMA))
    assert b"tailc" in model.dictionaries["en"]


def test_prediction_sees_only_the_text(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    model = langid.fit(df)
    lied = df.withColumn("lang", F.lit("xx")).withColumn("doc_id", -F.col("doc_id"))
    a = sorted((r.lang_pred, r.margin) for r in langid.identify(df, model).collect())
    assert a == sorted((r.lang_pred, r.margin) for r in langid.identify(lied, model).collect())


def test_without_labels_and_rows(spark):
    df = spark.createDataFrame([(1, "the cat", None, 0.0, None)], SCHEMA)
    assert langid.identify(df, langid.fit(df)).first().lang_pred == "und"
    assert langid.identify(df.limit(0), langid.fit(df.limit(0))).count() == 0
    one = langid.identify(df, langid.fit(spark.createDataFrame(ROWS[:5], SCHEMA))).first()
    assert one.lang_pred == "en" and not one.rejected


def test_held_out_fold(spark):
    import zlib

    rows = spark.range(200).select(F.col("id").alias("doc_id")).select("doc_id", langid.held_out().alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
