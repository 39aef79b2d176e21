"""The stages against plain versions of what they decide."""

import corpus_pipeline
import pytest
from test_near_copies import slow_components

from sensorloom.llm import decontaminate, language_id, surrogates
from sensorloom.llm.queries import DEMO_KEY


@pytest.fixture(scope="module")
def docs(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")


def test_pipeline_equals_its_plain_version(spark, folder, docs):
    rows = docs.collect()
    model = language_id.train(docs.where(~language_id.held_out()))
    verdicts = language_id.decide(model, [r["text"] for r in rows], language_id.MARGIN)
    rows = [r for r, v in zip(rows, verdicts) if not v[2]]

    first, _ = slow_components([(r["doc_id"], r["text"]) for r in rows])
    rows = [r for r in rows if first[r["doc_id"]] == r["doc_id"]]

    items = decontaminate.Items([tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").select("item_id", "text").collect()])
    leaking = {d for d, *_ in items.found([r["text"] for r in rows])}
    rows = [r for k, r in enumerate(rows) if k not in leaking]
    assert 0 < len(rows) < docs.count()

    made = surrogates.Surrogates(DEMO_KEY.encode())
    texts = {r["doc_id"]: made.rewrite(r["text"])[0] for r in rows}
    want = sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in corpus_pipeline.pack(spark, spark.createDataFrame(list(texts.items()), "doc_id long, text string"), folder).collect())
    got = corpus_pipeline.run(spark, folder)
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got.collect()) == want


def test_stages_keep_the_columns(spark, folder, docs):
    odd = docs.limit(30).withColumnRenamed("source", "component_id")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, odd, folder).columns == odd.columns


def test_stages_take_trouble_and_nothing(spark, folder, trouble, nothing):
    df = trouble.withColumnRenamed("fingerprint", "lang")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, folder).count() == 0
        stage(spark, df, folder).collect()


def test_stages_are_in_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "simhash_near_dedup", "decontamination", "pii_surrogates", "bin_slack_packing"]


def test_of_rows_that_share_an_id_the_same_one_stays(spark, folder):
    rows = [(1, "first text of its own"), (1, "second text of its own"), (2, "another text altogether")]
    df = lambda order: spark.createDataFrame([rows[i] for i in order], "doc_id long, text string").repartition(2)
    stay = [sorted(map(tuple, corpus_pipeline.drop_near_copies(spark, df(o), folder).collect())) for o in ([0, 1, 2], [2, 1, 0], [1, 0, 2])]
    assert stay[0] == stay[1] == stay[2] and [r[0] for r in stay[0]] == [1, 2]
