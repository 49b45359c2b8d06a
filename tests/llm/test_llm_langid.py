import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cuesheet.llm import langid
from cuesheet.sources.tables import read_table

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    return langid.fit(read_table(spark, SF, "documents"), ~langid.held_out(), per_lang=200)


def test_held_out_accuracy(spark, model):
    docs = read_table(spark, SF, "documents").where(langid.held_out())
    rows = langid.identify(docs, model).select("lang", "lang_pred", "rejected", "score").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.97
    assert np.mean([r.rejected for r in rows]) < 0.01
    assert all(0 <= r.score <= 1 for r in rows)
    assert sorted(set(model.langs)) == ["de", "en", "es", "fr"] and len(model.langs) > 8


def test_held_out_rule(spark):
    rows = spark.range(200).select(F.col("id").alias("doc_id"), langid.held_out().alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert spark.sql("select cast(null as long) as doc_id").select(langid.held_out()).first()[0] is True


def test_edges(spark, model):
    text = read_table(spark, SF, "documents").where("lang = 'en' AND n_chars > 2000").orderBy("doc_id").first().text
    rows = [(1, None), (2, ""), (3, "123 !!"), (4, text * 400), (4, text * 400), (None, "ß")]
    df = spark.createDataFrame([(*r, "x", 0.5) for r in rows], "doc_id long, text string, lang_pred string, score double")
    got = langid.identify(df, model).collect()
    assert [r.lang_pred for r in got[:3]] == ["und"] * 3 and all(r.score == 0 and r.rejected for r in got[:3])
    assert got[3].lang_pred == "en" and not got[3].rejected and got[3][1:] == got[4][1:]
    assert got[5].lang_pred in model.langs
    kept = langid.identify(df, model, prefix="__")
    assert kept.columns == ["doc_id", "text", "lang_pred", "score", "__lang_pred", "__score", "__rejected"]


def test_nothing_to_learn_from(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    model = langid.fit(empty, ~langid.held_out())
    df = spark.createDataFrame([(1, "hello there")], "doc_id long, text string")
    found = langid.identify(df, model).first()
    assert found.lang_pred == "und" and found.score == 0 and not found.rejected  # nothing is known against it
    assert langid.identify(df.limit(0), model).count() == 0


def test_pieces_of_a_long_text_count_like_the_whole(monkeypatch):
    text = "Größe, çà et là; the end. " * 50
    whole = langid.trigram_counts(text)[0]
    monkeypatch.setattr(langid, "CHUNK_BYTES", 64)
    assert abs(langid.trigram_counts(text)[0] - whole).sum() <= 2 * (len(text.encode()) // 64 + 1)
    assert langid.trigram_counts("")[1] == 0


def test_foreign_letters_are_rejected(spark, model):
    df = spark.createDataFrame([(1, "日本語の文章です。" * 30), (2, "qzx jjkq xvw " * 60)], "doc_id long, text string")
    assert all(r.rejected for r in langid.identify(df, model).collect())


def test_copies_make_no_language_vanish(spark):
    docs = read_table(spark, SF, "documents").where("lang IN ('en', 'es') AND n_chars > 200").select("text", "lang").toPandas()
    one = docs[docs.lang == "en"].text.iloc[0]
    rows = [(one, "en")] * 6000 + [(t, "es") for t in docs[docs.lang == "es"].text]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, lang string")
    model = langid.fit(df, F.lit(True), per_lang=50)
    assert sorted(set(model.langs)) == ["en", "es"]
    assert langid.identify(df.where("lang = 'en'").limit(1), model).first().lang_pred == "en"
