"""Token counts by a linear longest-match automaton.

The vocabulary is a trie over bytes, in which a word's last byte is a symbol of its own (a piece that ends
a word is another piece than the same letters within one). A failure link leads from a node to where the
walk goes on once the longest pieces that start its string are taken off, and the number of pieces taken
off on the way is stored with it. One walk over a word's symbols, adding those numbers, thus gives the
number of pieces that greedy longest-match-first segmentation makes, without making them.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from portmesh.llm.common import table

#: Words whose counts a worker keeps; only speed depends on it.
KEPT_WORDS = 400_000
#: Added to the byte that ends a word.
LAST = 256

# A word is one of these cuts of the small-letter text.
_CUT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


def symbols(word: bytes) -> list[int]:
    return [*word[:-1], word[-1] + LAST] if word else []


class Automaton:
    """Counts greedy longest-match pieces of words over a vocabulary of symbol sequences.

    Every single symbol must be a piece, so that each word can be cut.
    """

    def __init__(self, pieces):
        self.next: list[dict[int, int]] = [{}]
        ends = [False]
        for piece in pieces:
            node = 0
            for symbol in piece:
                child = self.next[node].get(symbol)
                if child is None:
                    child = self.next[node][symbol] = len(self.next)
                    self.next.append({})
                    ends.append(False)
                node = child
            ends[node] = True
        missing = [s for s in range(2 * LAST) if s not in self.next[0] or not ends[self.next[0][s]]]
        if missing:
            raise ValueError(f"no piece for the symbols {missing[:5]} ...")
        self._link(ends)

    def _link(self, ends: list[bool]) -> None:
        """Breadth first: a node that is a piece pops itself and fails to the root; any other node pops
        what its parent pops, then follows failures until its symbol can be read."""
        n = len(self.next)
        self.fail, self.popped = [-1] * n, [0] * n
        queue = deque([0])
        while queue:
            node = queue.popleft()
            for symbol, child in self.next[node].items():
                if ends[child]:
                    self.fail[child], self.popped[child] = 0, 1
                else:
                    at, popped = self.fail[node], self.popped[node]
                    while at >= 0 and symbol not in self.next[at]:
                        popped += self.popped[at]
                        at = self.fail[at]
                    if at >= 0:
                        self.fail[child], self.popped[child] = self.next[at][symbol], popped
                queue.append(child)

    def count(self, word) -> int:
        """Pieces of a sequence of symbols."""
        node = total = 0
        step, fail, popped = self.next, self.fail, self.popped
        for symbol in word:
            to = step[node].get(symbol)
            while to is None:
                total += popped[node]
                node = fail[node]
                to = step[node].get(symbol)
            node = to
        while node > 0:
            total += popped[node]
            node = fail[node]
        return total


def vocabulary(path: str) -> list[tuple[int, ...]]:
    """The pieces of a ``tokenizers`` BPE file with byte letters and an end-of-word suffix."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    end = model["end_of_word_suffix"]
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in shown}
    letters |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    out = []
    for piece in model["vocab"]:
        body = piece.removesuffix(end)
        if body and all(c in letters for c in body):
            spelt = [letters[c] for c in body]
            if body != piece:
                spelt[-1] += LAST
            out.append(tuple(spelt))
    return out


@lru_cache(maxsize=2)
def automaton(path: str) -> Automaton:
    return Automaton(vocabulary(path))


def words(text: str | None) -> list[str]:
    return _CUT.findall((text or "").lower())


def _count(path: str):
    kept: dict[str, int] = {}

    def pieces(word: str, count) -> int:
        found = kept.get(word)
        if found is None:
            if len(kept) > KEPT_WORDS:
                kept.clear()
            found = count(symbols(word.encode("utf-8", "replace")))
            if len(word) < 64:
                kept[word] = found
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = automaton(path).count
        for batch in batches:
            n_words, n_pieces, longest = [], [], []
            for cell in batch.column(1):
                each = [pieces(w, count) for w in words(cell.as_py())]
                n_words.append(len(each))
                n_pieces.append(sum(each))
                longest.append(max(each, default=0))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(x, pa.int64()) for x in (n_words, n_pieces, longest))],
                names=["doc_id", "n_words", "n_pieces", "longest_word"],
            )

    return run


def token_counts(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """A row per row of ``docs`` (``doc_id``, ``text`` are read): ``n_words``, ``n_pieces`` and
    ``longest_word`` (pieces of the word with most). Null and empty texts have none; rows given twice give
    two rows; an empty table gives none."""
    rows = docs.select(F.col("`doc_id`").cast("long").alias("doc_id"), F.col("`text`").alias("text"))
    return rows.mapInArrow(_count(vocabulary_path), "doc_id long, n_words long, n_pieces long, longest_word long")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_word_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), default_vocabulary())


QUERIES = {"op1_word_pieces": op1_word_pieces}
SQL: dict[str, str] = {}
