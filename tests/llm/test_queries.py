"""The registered queries: against SQL where there is some, else in shape and size."""

import pytest
from compare import differences

from sensorloom.llm.queries import ORACLE, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, con, folder, name):
    assert differences(QUERIES[name](spark, folder), con, ORACLE[name]) == []


@pytest.mark.parametrize(
    "name", ["op4_simhash_near_dup", "op5_token_counts", "op6_toxicity", "op8_pii_surrogates", "op10_language_id"]
)
def test_every_document_has_a_row(spark, con, folder, name):
    ids = sorted(r["doc_id"] for r in QUERIES[name](spark, folder).select("doc_id").collect())
    assert ids == sorted(r[0] for r in con.execute("SELECT doc_id FROM documents").fetchall())


def test_there_is_one_query_of_each_number():
    numbers = sorted(int(n[2:].split("_")[0]) for n in QUERIES)
    assert numbers == list(range(1, 14))


def test_chat_formatting_stays_in_the_engine(spark, folder):
    plan = QUERIES["op2_chat_format"](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas"))
