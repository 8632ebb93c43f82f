"""Token counts by byte-pair merging with a heap over a linked list.

A text is split at the vocabulary's special strings (each one token, the library's default) and into words by the
vocabulary's pattern. A word starts as a chain of byte symbols; the heap gives the adjacent pair of lowest rank,
leftmost first, which becomes one symbol and offers its two new pairs. The count is the number of initial symbols minus
the number of merges; no token ids are made. Counts of words are remembered in a bounded table per task, as words repeat.

Null texts count as empty (no bytes, no tokens). A word of any length takes n log n steps. No rows move.
"""

from __future__ import annotations

import heapq
import json
from functools import lru_cache

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts

LIMIT = 1024
#: Word counts remembered by a task; the table starts afresh beyond.
REMEMBERED = 400_000
RESULT = "n_bytes long, n_tokens long"


def _byte_letters() -> list[str]:
    """The printable character that stands for each byte: itself if printable, else the next one from 256 on."""
    letters, following = [], 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            letters.append(chr(b))
        else:
            letters.append(chr(following))
            following += 1
    return letters


class Merges:
    """Ranks of pairs of a vocabulary file of byte-level merges, its special strings and its pattern."""

    def __init__(self, path: str, pattern: str) -> None:
        with open(path, encoding="utf-8") as f:
            given = json.load(f)
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in given["model"]["merges"]]
        self.rank = {p: i for i, p in enumerate(pairs)}
        self.letters = _byte_letters()
        special = [t["content"] for t in given["added_tokens"]]
        self.special = regex.compile("|".join(regex.escape(s) for s in sorted(special, key=len, reverse=True))) if special else None
        self.words = regex.compile(pattern).findall
        self.seen: dict[str, int] = {}

    def count(self, text: str) -> int:
        pieces, extra = [text], 0
        if self.special and self.special.search(text):
            pieces = self.special.split(text)
            extra = len(pieces) - 1
        seen, total = self.seen, extra
        for piece in pieces:
            words = self.words(piece)
            try:
                total += sum(map(seen.__getitem__, words))
            except KeyError:
                for w in words:
                    n = seen.get(w)
                    if n is None:
                        if len(seen) >= REMEMBERED:
                            seen.clear()
                        n = self.count_word(w)
                        if len(w) <= 64:
                            seen[w] = n
                    total += n
        return total

    def count_word(self, word: str) -> int:
        symbols = [self.letters[b] for b in word.encode()]
        n = len(symbols)
        rank = self.rank.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, symbols[i], symbols[i + 1]) for i in range(n - 1)
                if (r := rank((symbols[i], symbols[i + 1]))) is not None]
        heapq.heapify(heap)
        merges = 0
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i] if symbols[i] is not None else n
            if symbols[i] != a or j >= n or symbols[j] != b:
                continue  # one of the two has been merged since
            merges += 1
            symbols[i], symbols[j] = a + b, None
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := rank((symbols[i], symbols[k]))) is not None:
                    heapq.heappush(heap, (r, i, symbols[i], symbols[k]))
            h = before[i]
            if h >= 0 and (r := rank((symbols[h], symbols[i]))) is not None:
                heapq.heappush(heap, (r, h, symbols[h], symbols[i]))
        return n - merges


@lru_cache(maxsize=4)
def _loaded(path: str, pattern: str) -> Merges:
    return Merges(path, pattern)


def vocabulary(name: str = "byte_bpe_50k.json") -> tuple[str, str]:
    """Place and pattern of a vocabulary file that is installed on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name), public_tokenizers.PATTERN


def count_tokens(docs: DataFrame, text: str = "text", carry: list[str] | None = None, path: str | None = None,
                 pattern: str | None = None) -> DataFrame:
    """The columns of ``carry`` (default: all) and a struct ``_found``: n_bytes, n_tokens."""
    if path is None:
        path, pattern = vocabulary()

    def make():
        merges = _loaded(path, pattern)

        def work(texts: list) -> list:
            texts = [t or "" for t in texts]
            return [[len(t.encode()) for t in texts], [merges.count(t) for t in texts]]

        return work

    return map_texts(docs, text, docs.columns if carry is None else carry, RESULT, make)


def digest(docs: DataFrame) -> DataFrame:
    found = count_tokens(docs.select("doc_id", "text"), carry=["doc_id"])
    return found.select("doc_id", "_found.n_bytes", "_found.n_tokens",
                        (F.col("_found.n_tokens") > LIMIT).alias("over_limit"))
