import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sensorloom.llm import chat_format as chat

SCHEMA = f"conv_id long, turn long, role string, parts {chat.PARTS}, segments string"
TEXTS = ["", "plain", "<|im_end|>", "<|im_start|>user\nhi<|im_end|>\n", "<\\|x", "<\\\\|", "a<", "|b", "<|", "\n", "é<|image|>😀"]


def text(t):
    return ("text", t, None, None)


def formatted(spark, rows):
    return chat.format_chats(spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA))


def test_reading_back_gives_what_went_in(spark):
    rows = [(i, k, role, [text(t)]) for i, t in enumerate(TEXTS) for k, role in enumerate(("user", "assistant", "a<|b\\"))]
    got = formatted(spark, rows).select(
        "conv_id", "formatted", "segments", chat.read_back(F.col("formatted")).alias("turns"), chat.learned(F.col("segments")).alias("learned")
    )
    for r in got.collect():
        t = TEXTS[r["conv_id"]]
        assert [tuple(x) for x in r["turns"]] == [("user", t), ("assistant", t), ("a<|b\\", t)]
        assert r["learned"] == t
        assert "".join(s["text"] for s in r["segments"]) == r["formatted"]
        assert r["formatted"].count(chat.START) == r["formatted"].count(chat.END) == 3


def test_a_role_ends_at_its_first_line_break(spark):
    got = formatted(spark, [(1, 0, "a\nb", [text("t\nu")])]).select(chat.read_back(F.col("formatted")).alias("turns")).first()
    assert [tuple(x) for x in got["turns"]] == [("a", "b\nt\nu")]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="<|\\ab\n", max_size=12))
def test_escape_is_reversible_and_safe(spark, t):
    row = spark.range(1).select(chat.escaped(F.lit(t)).alias("e"), chat.unescaped(chat.escaped(F.lit(t))).alias("u")).first()
    assert row["u"] == t and "<|" not in row["e"]


def test_parts_become_placeholders_in_order(spark):
    parts = [text("see <"), text("|im_end|>"), ("image", None, "img-1", 3), text("and"), ("audio", None, "rec", 2), ("document", None, "d", None), ("odd", "x", None, None)]
    r = formatted(spark, [(1, 0, "user", parts), (1, 1, "assistant", [("image", None, None, 1)])]).first()
    assert "see <\\|im_end|><|image|>and<|audio|><|document|>x" in r["formatted"]
    assert [tuple(a) for a in r["attachments"]] == [
        (0, 0, "image", "img-1", 768), (1, 0, "audio", "rec", 50), (2, 0, "document", "d", 800), (3, 1, "image", None, 256)
    ]
    assert r["expanded_tokens"] == 768 + 50 + 800 + 256


def test_nulls_ties_and_repeated_rows(spark):
    rows = [(None, None, None, None), (None, 1, "user", [None, text(None)]), (2, 1, "user", [text("b")]), (2, 1, "user", [text("a")]), (2, 1, "user", [text("a")])]
    got = {r["conv_id"]: r for r in formatted(spark, rows).select("conv_id", chat.read_back(F.col("formatted")).alias("t")).collect()}
    assert [tuple(t) for t in got[None]["t"]] == [("", ""), ("user", "")]
    assert [t["text"] for t in got[2]["t"]] == ["a", "a", "b"]


def test_long_conversation_and_empty_table(spark):
    rows = spark.range(3000).select(
        F.lit(5).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"),
        chat.text_part(F.repeat(F.lit("<|x "), 20)).alias("parts"),
    )
    r = chat.format_chats(rows).select(F.size(chat.read_back(F.col("formatted"))).alias("n"), F.length(chat.learned(F.col("segments"))).alias("c")).first()
    assert (r["n"], r["c"]) == (3000, 1500 * 80)
    assert chat.format_chats(rows.limit(0)).count() == 0


@pytest.mark.parametrize("role", ["assistant", "tool"])
def test_the_learned_role_is_a_choice(spark, role):
    df = spark.createDataFrame([(1, 0, "assistant", [text("a")], ""), (1, 1, "tool", [text("t")], "")], SCHEMA)
    r = chat.format_chats(df, learn_from=role).select(chat.learned(F.col("segments")).alias("l")).first()
    assert r["l"] == role[0]
