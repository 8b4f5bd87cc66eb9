"""Inputs that once went wrong."""

import struct

import pytest
from pyspark.sql import functions as F

from strandmill.llm import language, media, mixing, toxicity


def test_texts_without_a_letter_have_no_language(spark):
    texts = ["½ ²", "① ②", "Ⅷ", "123 _ -", "", None, "der Hund und die Katze", "the dog and the cat"]
    docs = spark.createDataFrame([(k, t, "de" if k % 2 == 0 else "en", "s") for k, t in enumerate(["der Hund und die Katze sind im Haus", "the dog and the cat are in the house"] * 40)], "doc_id long, text string, lang string, source string")
    asked = spark.createDataFrame([(1000 + k, t, None, "s") for k, t in enumerate(texts)], docs.schema)
    found = {r.doc_id - 1000: r for r in language.identify(docs.unionByName(asked)).collect() if r.doc_id >= 1000}
    assert [found[k].lang_pred for k in range(6)] == ["und"] * 6 and (found[6].lang_pred, found[7].lang_pred) == ("de", "en")
    assert language.letters_of("½Ab③c_d9") == "abcd"


def test_mixing_with_columns_named_like_its_own(spark):
    rows = [(k, "word " * (k % 5), "s1" if k % 2 else None, k, "x") for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, _uidcopies int, _UID string")
    plain = mixing.mixed_documents(df.select("doc_id", "text", "source")).groupBy("doc_id").count().collect()
    found = mixing.mixed_documents(df)
    assert found.columns == df.columns
    assert sorted(map(tuple, found.groupBy("doc_id").count().collect())) == sorted(map(tuple, plain))


def test_times_that_overflow_or_do_not_agree(spark):
    good = media.store(bytes(640))
    (track,) = media.read_tracks(good)
    at = good.index(b"stts") + 8
    assert track.n == 10 and struct.unpack_from(">II", good, at + 4)[0] == 10
    wrong = good[: at + 4] + struct.pack(">II", (1 << 32) - 1, (1 << 32) - 1) + good[at + 12 :]
    with pytest.raises(ValueError, match="times for another number"):
        media.read_tracks(wrong)
    long = good[: at + 4] + struct.pack(">II", 10, (1 << 32) - 1) + good[at + 12 :]
    assert media.read_tracks(long)[0].duration == 10 * ((1 << 32) - 1) / media.TIMESCALE
    rows = spark.createDataFrame([(1, bytearray(good)), (2, bytearray(wrong))], "id int, media binary")
    found = {r.id: r.n_samples for r in media.media_columns(rows).collect()}
    assert found == {1: 10, 2: None}


def test_a_very_long_text_is_not_learned_from(spark):
    long = "word " * 300_000
    docs = spark.createDataFrame([(k, long if k == 4 else f"text {k}", "en") for k in range(40)], "doc_id long, text string, lang string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    rows = toxicity.labelled_sample(docs, labels, (100, 100))
    assert rows.num_rows > 20 and max(len(t) for t in rows.column("text").to_pylist()) < 20
