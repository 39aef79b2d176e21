"""Token ids of whole texts by public tokenizer files, huge texts in overlapping chunks.

Overlap resynchronisation: a chunk and its successor overlap, and both are encoded with
offsets. They are spliced at a position in the overlap that is a boundary in both encodings and
proven stable: a visible character before it and white space after it. No pre-tokenizer of the
supported files joins the two (a piece may start with white space, never hold it further on), so
the tokens on either side do not depend on what lies beyond. If the overlap holds no such position
it is widened, at last to the whole rest of the text.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np

CHUNK = 1 << 16
OVERLAP = 256
_STABLE = re.compile(r"[!-~À-ɏ](?=[ \n])")
# Character classes beyond these may differ between regex libraries; such texts take the file's own library.
_SHARED = re.compile("[^\t\n\r -~¡-ɏ‐-‧€]")


class Encoded:
    """Ids of one chunk, and where its tokens end."""

    def __init__(self, ids: np.ndarray, starts: np.ndarray, ends: np.ndarray, text: str | None = None):
        self.ids, self.starts, self.ends, self.text = ids, starts, ends, text

    def cut(self, place: int) -> int | None:
        """How many tokens lie before a character position; None if a token lies across it."""
        if self.text is not None:  # offsets count bytes
            place = len(self.text[:place].encode())
        k = int(np.searchsorted(self.ends, place, "right"))
        return k if k == len(self.ids) or self.starts[k] >= place else None


class JsonEncoder:
    """A tokenizers file; byte-level BPE with a rank file of the same name beside it runs on that."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        self.fast, self.sizes = None, None
        ranks_path = Path(path).with_suffix(".tiktoken")
        if ranks_path.exists():
            import tiktoken
            from public_tokenizers import PATTERN

            with open(ranks_path, "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            special = {t.content: i for i, t in self.slow.get_added_tokens_decoder().items()}
            self.fast = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
            self.special = set(special)
            self.sizes = np.zeros(self.fast.n_vocab, dtype=np.int64)
            for token, i in [*ranks.items(), *((k.encode(), i) for k, i in special.items())]:
                self.sizes[i] = len(token)

    def _is_shared(self, text: str) -> bool:
        if self.fast is None:
            return False
        try:
            text.encode("latin-1")
            return True
        except UnicodeEncodeError:
            return not _SHARED.search(text)

    def ids(self, text: str) -> np.ndarray:
        if self._is_shared(text):
            return self.fast.encode_to_numpy(text, allowed_special=self.special)
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    def encode(self, text: str) -> Encoded:
        if self._is_shared(text):
            ids = self.fast.encode_to_numpy(text, allowed_special=self.special)
            ends = np.cumsum(self.sizes[ids])
            return Encoded(ids, ends - self.sizes[ids], ends, text)
        found = self.slow.encode(text, add_special_tokens=False)
        offsets = np.array(found.offsets, dtype=np.int64).reshape(-1, 2)
        return Encoded(np.array(found.ids, dtype=np.uint32), offsets[:, 0], offsets[:, 1])


class ModelEncoder:
    """A sentencepiece file."""

    def __init__(self, path: str):
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor(model_file=path)

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.processor.encode(text, num_threads=1), dtype=np.uint32)

    def encode(self, text: str) -> Encoded:
        pieces = self.processor.encode(text, return_type="proto").pieces
        rows = np.array([(p.id, p.begin, p.end) for p in pieces], dtype=np.int64).reshape(-1, 3)
        return Encoded(rows[:, 0].astype(np.uint32), rows[:, 1], rows[:, 2], text)


@lru_cache(maxsize=4)
def encoder(path: str):
    """The encoder of a tokenizer file, loaded once in each worker."""
    return ModelEncoder(path) if path.endswith(".model") else JsonEncoder(path)


def _splice(left: Encoded, right: Encoded, text: str, low: int, start: int, end: int, after: int):
    """The last stable boundary in text[start:end] that both encodings share: (position, cut left, cut right)."""
    for m in reversed(list(_STABLE.finditer(text, start, end))):
        place = m.end()
        if place <= after or place >= end:
            continue
        a, b = left.cut(place - low), right.cut(place - start)
        if a is not None and b is not None:
            return place, a, b
    return None


def parts(tool, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> Iterator[np.ndarray]:
    """The ids of a whole text in consecutive arrays, a chunk in memory at a time."""
    if len(text) <= chunk:
        yield tool.ids(text)
        return
    low, done, high = 0, 0, chunk  # the current chunk, and how many of its tokens are out
    left, place = tool.encode(text[:high]), 0
    while high < len(text):
        width, found = overlap, None
        while found is None:
            start = max(high - width, place)
            end = min(len(text), start + max(chunk, 2 * width))
            right = tool.encode(text[start:end])
            found = _splice(left, right, text, low, start, high, place)
            if found is None and start == place:  # nowhere to splice: the chunk itself grows
                high = min(len(text), high + chunk)
                left = tool.encode(text[low:high])
                if high == len(text):
                    break
                width = overlap
            elif found is None:
                width *= 2
        if found is None:
            break
        place, a, b = found
        yield left.ids[done:a]
        low, high, left, done = start, end, right, b
    yield left.ids[done:]


def count(tool, text: str | None, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    return sum(len(p) for p in parts(tool, text or "", chunk, overlap))


def all_ids(tool, text: str | None, chunk: int = CHUNK, overlap: int = OVERLAP) -> np.ndarray:
    return np.concatenate(list(parts(tool, text or "", chunk, overlap)))
