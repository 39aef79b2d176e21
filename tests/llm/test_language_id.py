import zlib

import numpy as np
import pytest

from sensorloom.llm import language_id as lang
from sensorloom.llm.queries import QUERIES


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    docs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = QUERIES["op10_language_id"](spark, folder).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert len(held) > 200 and np.mean([r["lang_pred"] == docs[r["doc_id"]] for r in held]) > 0.98
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert sum(r["ambiguous"] for r in rows) < 0.01 * len(rows)


@pytest.mark.parametrize("count", [1, 2, 3, 4, 6, 9, 40])
def test_codewords_differ_and_use_both_sides(count):
    code = lang.codewords(count)
    assert code.shape[0] == count and set(np.unique(code)) <= {-1, 1}
    if count > 1:
        apart = [(code[i] != code[j]).sum() for i in range(count) for j in range(i)]
        assert min(apart) >= max(1, code.shape[1] // 5)
        assert (np.abs(code.sum(axis=0)) < count).all()


def test_a_wrong_bit_is_corrected():
    code = lang.codewords(4)
    model = lang.Model(list("abcd"), code, np.ones(code.shape), np.zeros((lang.DIMENSIONS, code.shape[1])), None)
    for k in range(4):
        for wrong in range(code.shape[1]):
            bits = code[k].astype(float) * 3
            bits[wrong] = -bits[wrong] / 3
            model.bias = bits
            best, _, _ = model.decide(np.zeros((1, lang.DIMENSIONS)))
            assert best[0] == k


def make(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_answers_depend_on_the_text_alone(spark, trouble):
    rows = [(i, "the cat and the dog " * (i % 9 + 1), "en") for i in range(60)] + [(100 + i, "le chat et le chien " * (i % 9 + 1), "fr") for i in range(60)]
    model = lang.train(make(spark, rows + [(300, None, "en"), (301, "quelque chose", None)]))
    texts = make(spark, [(1, "the dog", "fr"), (2, "le chien", None), (None, "the dog", "en"), (3, "le chien " * 5000, "en"), (4, "1234", "en"), (5, None, "en")])
    got = {(r["doc_id"], r["lang_pred"], r["score"] > 0.5, r["ambiguous"]) for r in lang.identify(texts, model).collect()}
    assert got == {(1, "en", True, False), (2, "fr", True, False), (None, "en", True, False), (3, "fr", True, False), (4, "und", False, True), (5, "und", False, True)}
    kept = lang.accepted(texts, model)
    assert kept.columns == texts.columns and {r["doc_id"] for r in kept.collect()} == {1, 2, 3, None}
    und = [r for r in lang.identify(trouble, model).collect() if r["lang_pred"] == "und"]
    assert len(und) == 5 and all(r["score"] == 0 for r in und)


def test_one_language_none_and_empty_tables(spark, nothing):
    one = lang.train(make(spark, [(i, f"some words {i}", "en") for i in range(5)]))
    texts = make(spark, [(1, "anything", None)])
    assert lang.identify(texts, one).first()["lang_pred"] == "en"
    assert lang.train(nothing) is None
    assert lang.identify(texts, None).first()["lang_pred"] == "und"
    assert lang.identify(nothing, one).count() == 0 and lang.accepted(nothing, one).count() == 0


def test_the_sample_is_bounded_and_whole_texts_count(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(lang, "fit", lambda x, names: seen.append(names))
    lang.train(make(spark, [(i, f"text {i}", "en") for i in range(3000)]), rows_per_language=50)
    assert 20 <= len(seen[0]) <= 90
    long = "the cat " * 200_000
    assert lang.features([long]).shape == (1, lang.DIMENSIONS)
    a, b = lang.features(["x " * 400_000 + "zzz"]), lang.features(["x " * 400_000])
    assert (a != b).any()


def test_signs_that_are_no_letters_have_no_language(spark):
    docs = spark.createDataFrame([(i, f"{w} {w} the of" if i % 2 else f"{w} {w} der und") for i, w in enumerate("abcdefgh")], "doc_id long, text string")
    model = lang.train(docs.selectExpr("doc_id", "text", "if(doc_id % 2 = 0, 'de', 'en') as lang"))
    found = lang.decide(model, ["½ ² ①", "½", "², 3", "½ a", None, "٣"], 0.1)
    assert [f[0] == "und" for f in found] == [True, True, True, False, True, True]
