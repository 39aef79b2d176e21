"""Spelling variants: words that differ by one edit, found by partition-and-enumerate signatures.

A word's letters are a multiset, that is, a binary vector with a place for each (letter, occurrence). One
inserted, deleted or replaced letter changes at most two of its places. The places are partitioned by
where in the word a letter stands: ``BLOCKS`` blocks, of which one edit changes a single one. So two
words that are near agree in the multisets of all blocks but one: each word enumerates its blocks, a
signature is all others exactly, signatures are equi-joined and the pairs verified letter by letter.
Parting the letters by value alone makes signatures that anagrams share, hundreds of pairs a word.

A word of length n meets words of its own length under its blocks as they are. To meet words of one
letter less it enumerates once more with the blocks of length n - 1, one block being a letter longer.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stores import forget, over_rows, slices, store

RUN = re.compile("[A-Za-zÀ-ÿ]+")
_GAP = re.compile("[^A-Za-zÀ-ÿ]")
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
SLIP = 31
LEAST_LENGTH = 7
LEAST_COUNT = 2
RATIO = 10
BLOCKS = 6
HELD = 200_000
STRETCH = 1 << 20


def stretches(text: str) -> Iterator[str]:
    """A long text in parts, cut where no run is."""
    low = 0
    while low < len(text):
        gap = _GAP.search(text, low + STRETCH) if len(text) - low > STRETCH else None
        high = gap.end() if gap else len(text)
        yield text[low:high]
        low = high


def runs(text: str | None) -> Counter:
    """How often each run of letters occurs in a whole text, A-Z as a-z."""
    found, counts = Counter(), Counter()
    for part in stretches(text or ""):
        found.update(RUN.findall(part))
    for run, n in found.items():
        counts[run.lower() if run.isascii() else run.translate(_LOWER)] += n
    return counts


def slipped(head: int, run: str) -> str:
    """The run as the document holds it: one in ``SLIP`` lacks a letter. ``head`` is the crc32 of what stands before the run."""
    h = zlib.crc32(run.encode(), head)
    if h % SLIP:
        return run
    return run[: h % len(run)] + run[h % len(run) + 1 :]


def counted(docs: DataFrame, id_col: str, text_col: str, least_length: int) -> DataFrame:
    """(word, n): the words of all documents, counted in each task before they are shuffled."""

    def out(counts: dict[str, int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in slices(batches):
            for doc, text in zip(*(c.to_pylist() for c in batch.columns)):
                head = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                for run, n in runs(text).items():
                    word = slipped(head, run)
                    if len(word) >= least_length:
                        counts[word] += n
            if len(counts) >= HELD:
                yield out(counts)
                counts = Counter()
        yield out(counts)

    narrow = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    return narrow.mapInArrow(work, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def signatures(word: str, blocks: int = BLOCKS) -> list[tuple[int, bool, int, int]]:
    """(signature, whether it is one to meet shorter words, first letter of the block left out, its end in the shorter word)."""
    out = []
    for extra in (0, 1):
        size = len(word) - extra
        count = max(1, min(blocks, size))
        edges = [i * size // count for i in range(count + 1)]
        before = ["".join(sorted(word[a:b])) for a, b in zip(edges, edges[1:])]
        after = ["".join(sorted(word[a + 1 : b + 1])) for a, b in zip(edges, edges[1:])] if extra else before
        for q in range(count):
            kept = "|".join((*before[:q], *after[q + 1 :]))
            out.append((xxhash.xxh64_intdigest(f"{size}|{q}|{kept}") - (1 << 63), bool(extra), edges[q], edges[q + 1]))
    return out


def entries(words: DataFrame, blocks: int) -> DataFrame:
    """(signature, longer, low, high, word, n)."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [signatures(w, blocks) for w in batch.column(0).to_pylist()]
        owner = pa.array([k for k, f in enumerate(found) for _ in f], pa.int64())
        kinds = (pa.int64(), pa.bool_(), pa.int32(), pa.int32())
        columns = [pa.array([s[i] for f in found for s in f], kind) for i, kind in enumerate(kinds)]
        return pa.RecordBatch.from_arrays([*columns, batch.column(0).take(owner), batch.column(1).take(owner)], ["signature", "longer", "low", "high", "word", "n"])

    return words.select("word", "n").mapInArrow(over_rows(work, 4096), "signature long, longer boolean, low int, high int, word string, n long")


def near_pairs(words: DataFrame, blocks: int = BLOCKS) -> DataFrame:
    """(a, a_n, b, b_n): each pair of distinct words that differ by exactly one edit, once.

    A pair may share several signatures; it counts under the first block that the edit may lie in.
    """
    found = store(entries(words, blocks), "signatures")
    a, b = found.where("not longer").alias("a"), found.alias("b")
    pairs = a.join(b, "signature").where("a.low = b.low and (b.longer or a.word < b.word) and length(b.word) = length(a.word) + int(b.longer)")
    same = (
        "substr(a.word, 1, a.low) = substr(b.word, 1, a.low)"
        " and substr(a.word, a.high + 1) = substr(b.word, a.high + 1 + int(b.longer))"
    )
    # An inserted letter may stand in an earlier block too: then all from here on agrees.
    first = "not b.longer or a.low = 0 or substr(a.word, a.low + 1) <> substr(b.word, a.low + 2)"
    return pairs.where(f"{same} and ({first}) and levenshtein(a.word, b.word, 1) = 1").selectExpr(
        "a.word as a", "a.n as a_n", "b.word as b", "b.n as b_n"
    )


def roots(links: DataFrame) -> DataFrame:
    """(word, root): the last of the forms that follow from each word of ``links`` (word, form), by doubling steps.

    A form occurs ``RATIO`` times as often as its word, so there are no rings and a handful of rounds.
    """
    now = store(links.selectExpr("word", "form as root", "true as moved"), "roots")
    while not now.where("moved").isEmpty():
        on = now.select(F.col("word").alias("_word"), F.col("root").alias("_root"))
        further = now.join(on, F.col("root") == F.col("_word"), "left")
        after = store(further.selectExpr("word", "coalesce(_root, root) as root", "_root is not null as moved"), "roots")
        forget(now)
        now = after
    return now.drop("moved")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH,
             least_count: int = LEAST_COUNT, ratio: int = RATIO, blocks: int = BLOCKS) -> DataFrame:
    """(word, n, n_near, form, form_n, root): one row per word of the documents, its near words counted.

    The form is the most frequent near word (of equally frequent ones the first in code-point order) if
    it occurs ``ratio`` times as often, else null; the root is where the forms lead, the word itself
    without one. Null and empty texts have no words, a null id is written as nothing before the colon,
    rows that repeat count again, an empty table gives no rows and further columns are ignored.
    """
    words = store(counted(docs, id_col, text_col, least_length).where(F.col("n") >= least_count), "words")
    pairs = store(near_pairs(words, blocks), "near_pairs")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("b_n").alias("other_n")).union(pairs.select("b", "a", "a_n"))
    near = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("top"))
    has = F.coalesce(-F.col("top.less") >= ratio * F.col("n"), F.lit(False))
    formed = store(
        words.join(near, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
            F.when(has, F.col("top.other")).alias("form"), F.when(has, -F.col("top.less")).alias("form_n"),
        ),
        "formed",
    )
    led = roots(formed.where("form is not null"))
    return formed.join(led, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
