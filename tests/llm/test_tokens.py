import random

import numpy as np
import public_tokenizers
import pytest

from sensorloom.llm import encoders, token_counts

FILES = ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"]
TEXTS = [
    "", " ", "a" * 5000, " " * 3000, "x<|endoftext|>y " * 300, "it's we'll  \n\n  don't " * 200, "日本語テキスト 漢字 " * 300,
    "ab\u00a0cd\u2003 ef " * 300, "\n \t\n word" * 400, "12345 6789.0, (x) — “y” " * 200, "no-break" * 600, "a\x1c b\x85c d" * 200,
]


def library_ids(tool, text):
    if isinstance(tool, encoders.ModelEncoder):
        return tool.processor.encode(text)
    return tool.slow.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("name", FILES)
@pytest.mark.parametrize("chunk, overlap", [(10**6, 64), (700, 1), (257, 16), (64, 200)])
def test_chunked_ids_equal_the_library(con, name, chunk, overlap):
    tool = encoders.encoder(public_tokenizers.path(name))
    texts = [r[0] for r in con.execute("SELECT text FROM documents ORDER BY length(text) DESC LIMIT 8").fetchall()]
    for text in [t[:6000] for t in texts] + TEXTS:
        assert encoders.all_ids(tool, text, chunk, overlap).tolist() == library_ids(tool, text)


def test_random_mixtures(con):
    tool = encoders.encoder(public_tokenizers.path(FILES[0]))
    r = random.Random(5)
    bits = ["the", " ", "  ", "\n", "'s", "'", "<|endoftext|>", "<|endo", "é", "ß", "9", "1.5", "!!", "漢", "\t", "word"]
    for _ in range(300):
        text = "".join(r.choice(bits) for _ in range(r.randint(1, 200)))
        want = library_ids(tool, text)
        assert encoders.all_ids(tool, text, 40, 4).tolist() == want
        assert tool.ids(text).tolist() == want


def test_counts_of_documents_equal_the_library(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    tool = encoders.encoder(public_tokenizers.path(FILES[0]))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in token_counts.token_counts(docs, public_tokenizers.path(FILES[0]), chunk=2000, overlap=32).collect():
        n = len(library_ids(tool, texts[r["doc_id"]]))
        assert (r["n_tokens"], r["n_bytes"], r["over_limit"]) == (n, len(texts[r["doc_id"]].encode()), n > 1024)


@pytest.mark.parametrize("name", FILES)
def test_trouble(spark, trouble, nothing, name):
    path = public_tokenizers.path(name)
    rows = token_counts.token_counts(trouble, path).collect()
    tool = encoders.encoder(path)
    want = sorted((len((r["text"] or "").encode()), len(library_ids(tool, r["text"] or ""))) for r in trouble.collect())
    assert sorted((r["n_bytes"], r["n_tokens"]) for r in rows) == want
    assert token_counts.token_counts(nothing, path).count() == 0


def test_a_cut_is_where_no_token_lies_across():
    tool = encoders.encoder(public_tokenizers.path(FILES[0]))
    found = tool.encode("ab éé cd")
    assert found.cut(2) is not None and found.cut(0) == 0 and found.cut(8) == len(found.ids)
    assert isinstance(found.ids, np.ndarray)
