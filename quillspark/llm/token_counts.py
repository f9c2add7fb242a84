"""Token counts by greedy longest match, in time linear in the text.

The vocabulary's trie has failure links and, for each link, the number of pieces popped by following it
(the linear maximum-matching automaton of Song et al., 2021); word-piece counts are sums of those
numbers, and no piece is built. The distinct words of a slice of texts run through the automaton in step,
one character a round; once few are left, each is walked on for itself, so a long word takes linear time too. A word is a run of characters other than ASCII white space; its pieces start with
the word mark, and a word that has no full segmentation counts as one unknown token.

Edge cases: a null or empty text has zero words and tokens; a text of any length is one row; repeated
rows each have a row; a null doc_id is carried along; columns other than those named are ignored.
"""

from __future__ import annotations

from collections import deque
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import Lookup, as_bytes, code_points, map_slices
from .piece_tokenizer import SPACE, PieceModel

#: Words up to which plain steps are faster than rounds over arrays.
FEW = 64


class Automaton:
    """Counts the greedy longest-match pieces of words that begin with ``mark``."""

    def __init__(self, pieces: list[str], mark: str = SPACE):
        self.mark = mark
        children: list[dict[int, int]] = [{}]
        final = [False]
        for piece in pieces:
            node = 0
            for c in map(ord, piece):
                if c not in children[node]:
                    children[node][c] = len(children)
                    children.append({})
                    final.append(False)
                node = children[node][c]
            final[node] = bool(piece)
        # The link of a node drops its longest leading pieces; -1: no piece leads, so the word is unknown.
        fail, pops = [-1] * len(children), [0] * len(children)
        queue = deque([(0, c, n) for c, n in children[0].items()])
        while queue:
            parent, c, node = queue.popleft()
            if final[node]:
                fail[node], pops[node] = 0, 1
            else:
                at, popped = fail[parent], pops[parent]
                while at >= 0 and c not in children[at]:
                    popped += pops[at]
                    at = fail[at]
                if at >= 0:
                    fail[node], pops[node] = children[at][c], popped
            queue.extend((node, x, n) for x, n in children[node].items())
        self.fail, self.pops = np.array(fail), np.array(pops)
        points = sorted({c for x in children for c in x})
        self.classes = np.full(0x110000 + 1, len(points), np.int64)
        self.classes[points] = np.arange(len(points))
        self.width = len(points) + 1
        edges = sorted((n * self.width + int(self.classes[c]), m) for n, x in enumerate(children) for c, m in x.items())
        self.to = np.array([e[1] for e in edges])
        self.edge = Lookup(np.array([e[0] for e in edges], np.int64))
        self.plain = dict(edges), fail, pops
        self.begin = self._walk(self.classes[list(map(ord, mark))], 0, 0, ends=False)

    def step(self, states: np.ndarray, classes: np.ndarray) -> np.ndarray:
        """The child of each state by each class, -1 where there is none."""
        at = self.edge(states * self.width + classes)
        return np.where(at >= 0, self.to[at], -1)

    def counts(self, words: list[str]) -> np.ndarray:
        """Pieces of each word, -1 for a word without a segmentation."""
        points = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
        return self.counts_of(points, np.fromiter(map(len, words), np.int64, len(words)))

    def counts_of(self, points: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The same for words of so many code points each."""
        if not len(size):
            return np.zeros(0, np.int64)
        classes, start = self.classes[points], np.cumsum(size) - size
        state, total = (np.full(len(size), x, np.int64) for x in self.begin)
        order = np.argsort(-size, kind="stable")  # words that still go on are a prefix of this
        alive = len(order)
        for i in range(int(size.max()) + 1):
            while alive and size[order[alive - 1]] < i:
                alive -= 1
            left = order[:alive]
            left = left[state[left] >= 0]
            if left.size <= FEW:
                for w in left.tolist():
                    state[w], total[w] = self._walk(classes[start[w] + i : start[w] + size[w]], int(state[w]), int(total[w]))
                break
            at_end = size[left] == i
            self._finish(left[at_end], state, total)
            left = left[~at_end]
            self._advance(left, classes[start[left] + i], state, total)
        return np.where(state < 0, -1, total)

    def _walk(self, classes: np.ndarray, state: int, total: int, ends: bool = True) -> tuple[int, int]:
        """State and count after the rest of a word, or after its beginning."""
        children, fail, pops = self.plain
        for c in classes.tolist():
            while (to := children.get(state * self.width + c)) is None:
                total, state = total + pops[state], fail[state]
                if state < 0:
                    return state, total
            state = to
        while ends and state > 0:
            total, state = total + pops[state], fail[state]
        return state, total

    def _advance(self, left: np.ndarray, classes: np.ndarray, state: np.ndarray, total: np.ndarray) -> None:
        while left.size:
            to = self.step(state[left], classes)
            moved = to >= 0
            state[left[moved]] = to[moved]
            left, classes = left[~moved], classes[~moved]
            total[left] += self.pops[state[left]]
            state[left] = self.fail[state[left]]
            ok = state[left] >= 0
            left, classes = left[ok], classes[ok]

    def _finish(self, left: np.ndarray, state: np.ndarray, total: np.ndarray) -> None:
        left = left[state[left] > 0]
        while left.size:
            total[left] += self.pops[state[left]]
            state[left] = self.fail[state[left]]
            left = left[state[left] > 0]


_AUTOMATA: dict[str, Automaton] = {}


def automaton(model_path: str) -> Automaton:
    """The automaton of a model's pieces, built once per process."""
    if model_path not in _AUTOMATA:
        m = PieceModel(model_path)
        _AUTOMATA[model_path] = Automaton([p for p, b, raw in zip(m.pieces, m.is_byte, m.raw) if raw and not b])
    return _AUTOMATA[model_path]


def count_tokens(docs: DataFrame, model_path: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns, n_words, n_tokens and n_unknown_words of each row."""
    kept = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in keep)

    def work():
        run = automaton(model_path)

        def each(part: pa.RecordBatch) -> pa.RecordBatch:
            split = [t.split() for t in as_bytes(part.column("text"))]
            sizes = np.fromiter(map(len, split), np.int64, len(split))
            coded = pa.array(list(chain.from_iterable(split)), pa.binary()).dictionary_encode()
            each = run.counts_of(*code_points(coded.dictionary))[coded.indices.to_numpy()]
            ends = np.concatenate(([0], np.cumsum(sizes)))
            of_each = lambda x: pa.array(np.diff(np.concatenate(([0], np.cumsum(x)))[ends]))
            return pa.RecordBatch.from_arrays([*map(part.column, keep), pa.array(sizes), of_each(np.abs(each)), of_each((each < 0).astype(np.int64))], names=[*keep, "n_words", "n_tokens", "n_unknown_words"])

        return each

    return map_slices(docs.select(*keep, "text"), work, f"{kept}, n_words long, n_tokens long, n_unknown_words long")
