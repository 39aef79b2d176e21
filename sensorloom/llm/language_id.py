"""Language identification with error-correcting output codes.

Every language has a codeword of bits. One binary classifier per bit (logistic regression on
hashed character n-grams) says on which side of the bit a text lies, and a text gets the language
whose codeword is nearest. Decoding is loss-weighted: each bit contributes its logistic loss,
weighted by how often that classifier was right on that language in training. A text whose two
nearest codewords are about as far away is flagged as ambiguous.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stores import over_rows

DIMENSIONS = 1 << 12
SIZES = (2, 3)
ROWS_PER_LANGUAGE = 300
MARGIN = 0.1
UNKNOWN = "und"
BLOCK = 1 << 20
# Finds candidates quickly; signs such as ½ or ① match it too and are no letters.
_LETTER = re.compile(r"[^\W\d_]")
# Small letters stay, as do all bytes of letters beyond ASCII; the rest parts words.
_PLAIN = bytes(b if b > 127 or chr(b).isalpha() else 32 for b in range(256))
_TABLES = np.random.default_rng(11).integers(0, DIMENSIONS, (len(SIZES), max(SIZES), 256), dtype=np.uint16)


def letters(text: str | None) -> np.ndarray:
    """The bytes of a whole text in small letters, one space between words."""
    a = np.frombuffer((" " + (text or "").lower() + " ").encode("utf-8", "replace").translate(_PLAIN), dtype=np.uint8)
    gap = a == 32
    return a[~(gap & np.concatenate(([False], gap[:-1])))]


def has_letter(text: str | None) -> bool:
    return any(m.group().isalpha() for m in _LETTER.finditer(text or ""))


def _gram_counts(data: np.ndarray) -> np.ndarray:
    counts = np.zeros(DIMENSIONS, dtype=np.int64)
    for low in range(0, len(data), BLOCK):
        a = data[low : low + BLOCK + max(SIZES) - 1]
        for tables, size in zip(_TABLES, SIZES):
            n = min(BLOCK, len(a) - size + 1)
            if n <= 0:
                continue
            h = tables[0][a[:n]]
            for k in range(1, size):
                h = h ^ tables[k][a[k : k + n]]
            counts += np.bincount(h, minlength=DIMENSIONS)
    return counts


def features(texts: list[str | None]) -> np.ndarray:
    """Root of the share of each hashed n-gram; one row per text, of length one or zero."""
    out = np.zeros((len(texts), DIMENSIONS), dtype=np.float32)
    for i, text in enumerate(texts):
        counts = _gram_counts(letters(text))
        out[i] = np.sqrt(counts / max(1, counts.sum()))
    return out


def codewords(count: int, seed: int = 7) -> np.ndarray:
    """Rows of -1 and 1, one per language: all splits of up to six, else spread-out random ones."""
    if count <= 6:
        numbers = np.arange(max(1, 2 ** (count - 1) - 1))  # the split that puts all on one side is left out
        return np.array([[1] * len(numbers)] + [((numbers >> k) & 1) * 2 - 1 for k in range(count - 1)])
    rng, bits, best = np.random.default_rng(seed), 10 * (count - 1).bit_length(), None
    for _ in range(50):
        code = rng.choice([-1, 1], size=(count, bits))
        apart = code @ code.T
        apart[np.diag_indices(count)] = -bits
        both_sides = (np.abs(code.sum(axis=0)) < count).all()
        if both_sides and (best is None or apart.max() < best[0]):
            best = apart.max(), code
    return best[1] if best else code


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    reliance: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    def decide(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each row: the language's index, its score and its lead over the second."""
        f = x @ self.weights + self.bias
        loss = np.logaddexp(0.0, -f[:, None, :] * self.code[None])
        distance = (loss * self.reliance[None]).sum(axis=2)
        likely = np.exp(-(distance - distance.min(axis=1, keepdims=True)))
        likely /= likely.sum(axis=1, keepdims=True)
        ranked = np.sort(likely, axis=1)
        second = ranked[:, -2] if ranked.shape[1] > 1 else 0.0
        return likely.argmax(axis=1), ranked[:, -1], ranked[:, -1] - second


def fit(x: np.ndarray, names: list[str], steps: int = 150, ridge: float = 1e-5) -> Model | None:
    """Train the bit classifiers together; None without any rows."""
    if not names:
        return None
    languages = sorted(set(names))
    code = codewords(len(languages)).astype(np.float32)
    y = np.array([languages.index(n) for n in names])
    target = code[y]
    weights, bias = np.zeros((x.shape[1], code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    share = (1 / (len(languages) * np.bincount(y)))[y][:, None].astype(np.float32)
    ahead_w, ahead_b, rate = weights.copy(), bias.copy(), 8.0
    for step in range(steps):  # accelerated gradient descent; rows have length one, so the step is safe
        f = np.clip(x @ ahead_w + ahead_b, -80, 80)
        g = -target / (1 + np.exp(target * f)) * share
        new_w = ahead_w - rate / 2 * (x.T @ g + ridge * ahead_w)
        new_b = ahead_b - rate / 2 * g.sum(axis=0)
        pull = step / (step + 3)
        ahead_w, ahead_b = new_w + pull * (new_w - weights), new_b + pull * (new_b - bias)
        weights, bias = new_w, new_b
    right = (x @ weights + bias) * target > 0
    reliance = np.array([right[y == k].mean(axis=0) for k in range(len(languages))]) + 1e-3
    reliance *= code.shape[1] / reliance.sum(axis=1, keepdims=True)
    return Model(languages, code, reliance, weights, bias)


def train(docs: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text",
          rows_per_language: int = ROWS_PER_LANGUAGE) -> Model | None:
    """A model from about ``rows_per_language`` whole texts of each language in ``docs``.

    The rows are those with the smallest share of a hash of the doc_id, so the choice is the same
    in every run. Rows without text or language teach nothing.
    """
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    counts = {r[0]: r[1] for r in known.groupBy(F.col(lang_col).cast("string")).count().collect()}
    if not counts:
        return None
    place = F.pmod(F.xxhash64(F.col(id_col), F.lit("train")), F.lit(1 << 30))
    limits = F.create_map(
        *[x for k, n in counts.items() for x in (F.lit(k), F.lit(int(min(1.0, rows_per_language / n) * (1 << 30))))]
    )
    chosen = known.where(place < limits[F.col(lang_col).cast("string")]).select(
        F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")
    )

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = features(batch.column(1).to_pylist()).astype(np.float16)
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([row.tobytes() for row in x], pa.binary())], ["lang", "x"]
        )

    rows = sorted((r.lang, bytes(r.x)) for r in chosen.mapInArrow(over_rows(work), "lang string, x binary").collect())
    x = np.frombuffer(b"".join(r[1] for r in rows), dtype=np.float16).reshape(len(rows), DIMENSIONS)
    return fit(x.astype(np.float32), [r[0] for r in rows])


def decide(model: Model | None, texts: list[str | None], margin: float) -> list[tuple[str, float, bool]]:
    """(language, score, ambiguous) of each text; und without a letter or without a model."""
    out = [(UNKNOWN, 0.0, True)] * len(texts)
    usable = [i for i, t in enumerate(texts) if model and has_letter(t)]
    if usable:
        best, score, lead = model.decide(features([texts[i] for i in usable]))
        for i, k, s, gap in zip(usable, best, score, lead):
            out[i] = model.languages[k], float(min(1.0, s)), bool(gap < margin)
    return out


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text",
             margin: float = MARGIN) -> DataFrame:
    """(doc_id, lang_pred, score, ambiguous): one row per row of ``docs``.

    The score is the share of the nearest codeword's weight among all, from 0 to 1; ambiguous
    texts lead the second-nearest by less than ``margin``. A null text or one without a letter is
    und with score 0 and ambiguous; so is every text when nothing could be learned. Equal texts
    get equal answers, extra columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = decide(shared.value, batch.column(1).to_pylist(), margin)
        columns = [pa.array([r[k] for r in found], kind) for k, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))]
        return pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "lang_pred", "score", "ambiguous"])

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(over_rows(work), "doc_id long, lang_pred string, score double, ambiguous boolean")


def accepted(docs: DataFrame, model: Model | None, text_col: str = "text", margin: float = MARGIN) -> DataFrame:
    """The rows of ``docs`` whose language is told without ambiguity; all columns stay, no row moves.

    Null texts and those without a letter go; an empty table stays empty.
    """
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = decide(shared.value, batch.column(at).to_pylist(), margin)
        return batch.filter(pa.array([not r[2] for r in found]))

    return docs.mapInArrow(over_rows(work), docs.schema)


def held_out(id_col: str = "doc_id"):
    """Whether a document is kept from training: crc32 of its id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))
