"""Token counts by greedy longest match, in one pass over each word, without building pieces.

The vocabulary is a trie over bytes. Where a word can't go on from a node, the node's failure link
leads to the node that is reached after the greedy pieces of the node's string have been popped, and
its pop count says how many pieces these were. So a word's piece count is a sum of pop counts, in
time linear in its bytes. A word is a run of text between white space; it is matched with a space in
front, as the vocabulary marks the start of words.

Edge cases: a null, empty or blank text has 0 tokens; a byte that no piece covers counts as one token
and matching starts anew after it; equal texts give equal counts, repeated or not; of pieces with a common
start the longest that fits counts, so there are no ties; very long words take linear time where every byte
is a piece; an empty table gives no rows; columns in `keep` pass untouched, whatever their names.
"""

from __future__ import annotations

import base64
from collections import deque
from collections.abc import Iterator

from pyspark.sql import DataFrame

from lineshed.llm.textops import map_texts

CACHE = 1_000_000
LONGEST_HELD = 64  # characters; the cache so holds a bounded number of bytes
_held: dict[str, "PieceCounter"] = {}


class PieceCounter:
    """The automaton of a vocabulary of byte strings."""

    def __init__(self, vocabulary: Iterator[bytes]):
        step: dict[int, int] = {}
        children: list[list[tuple[int, int]]] = [[]]
        is_piece = [False]
        depth = [0]
        for piece in vocabulary:
            node = 0
            for byte in piece:
                nxt = step.get(node << 8 | byte)
                if nxt is None:
                    nxt = step[node << 8 | byte] = len(children)
                    children[node].append((byte, nxt))
                    children.append([])
                    is_piece.append(False)
                    depth.append(depth[node] + 1)
                node = nxt
            is_piece[node] = bool(node)
        fail = [-1] * len(children)
        pops = [0] * len(children)
        order = deque((0, byte, node) for byte, node in children[0])
        while order:
            parent, byte, node = order.popleft()
            if is_piece[node]:
                fail[node], pops[node] = 0, 1
            else:
                at, count = fail[parent], pops[parent]
                while at >= 0 and (nxt := step.get(at << 8 | byte)) is None:
                    count += pops[at]
                    at = fail[at]
                if at >= 0:
                    fail[node], pops[node] = nxt, count
            order.extend((node, b, child) for b, child in children[node])
        self.step, self.fail, self.pops, self.is_piece, self.depth = step, fail, pops, is_piece, depth
        self.cache: dict[str, int] = {}

    def count(self, word: bytes) -> int:
        """The number of greedy longest-match pieces of a word."""
        step, fail, pops = self.step, self.fail, self.pops
        node = total = at = 0
        while at < len(word):
            nxt = step.get(node << 8 | word[at])
            while nxt is None:
                if fail[node] < 0:
                    break
                total += pops[node]
                node = fail[node]
                nxt = step.get(node << 8 | word[at])
            if nxt is None:
                # no greedy piece covers what is pending: the slow, exact way for the rest of the word
                return total + self._rest(word[at - self.depth[node] :])
            node = nxt
            at += 1
        while node:
            if fail[node] < 0:
                return total + self._rest(word[len(word) - self.depth[node] :])
            total += pops[node]
            node = fail[node]
        return total

    def _rest(self, word: bytes) -> int:
        total = start = 0
        while start < len(word):
            node, best = 0, start + 1
            for k in range(start, len(word)):
                node = self.step.get(node << 8 | word[k], -1)
                if node < 0:
                    break
                if self.is_piece[node]:
                    best = k + 1
            total += 1
            start = best
        return total

    def of_word(self, word: str) -> int:
        return self.count(b" " + word.encode("utf-8", "surrogatepass"))

    def of_texts(self, texts: list[str]) -> list[int]:
        out = []
        cache = self.cache
        for text in texts:
            total = 0
            for word in text.split():
                n = cache.get(word)
                if n is None:
                    n = self.of_word(word)
                    if len(word) <= LONGEST_HELD:
                        if len(cache) >= CACHE:  # changes speed only
                            cache.clear()
                        cache[word] = n
                total += n
            out.append(total)
        return out


def read_ranks(path: str) -> list[bytes]:
    """The byte strings of a vocabulary file with one base64 string and rank a line."""
    with open(path, "rb") as lines:
        return [base64.b64decode(line.split()[0]) for line in lines if line.strip()]


def token_counts(docs: DataFrame, vocabulary_path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in `keep` and n_tokens for every row."""

    def count(texts: list) -> list:
        counter = _held.get(vocabulary_path)
        if counter is None:
            counter = _held[vocabulary_path] = PieceCounter(read_ranks(vocabulary_path))
        return [counter.of_texts([t or "" for t in texts])]

    return map_texts(docs, text, keep, "n_tokens long", count)
