"""Token counts by a linear longest-match automaton.

A vocabulary trie (word-initial and continuation pieces) carries failure links and, at every node, how many
pieces greedy longest-match has already popped when it falls back. One pass over a word gives its number of
pieces in time linear in its length; no piece is ever built.
"""

from __future__ import annotations

import functools

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from .common import claim, id_text, pieces

WORD_START = "▁"
#: Words a task remembers before it starts afresh; longer words are counted anew each time.
REMEMBER, LONGEST_REMEMBERED = 1 << 18, 48


class Automaton:
    """Greedy longest-match lengths over ``initial`` pieces, then ``inner`` ones."""

    def __init__(self, initial: list[str], inner: list[str]):
        # node 0: start of a word; node 1: after a popped piece
        self.edges: list[dict[str, int]] = [{}, {}]
        token = [False, False]
        for root, group in ((0, initial), (1, inner)):
            for piece in group:
                node = root
                for ch in piece:
                    after = self.edges[node].get(ch)
                    if after is None:
                        after = self.edges[node][ch] = len(self.edges)
                        self.edges.append({})
                        token.append(False)
                    node = after
                token[node] |= node > 1
        n = len(self.edges)
        self.fail: list[int] = [-1] * n
        self.popped = [0] * n
        level = [0, 1]
        while level:
            below = []
            for u in level:
                for ch, v in self.edges[u].items():
                    below.append(v)
                    if token[v]:
                        self.fail[v], self.popped[v] = 1, 1
                        continue
                    z, count = self.fail[u], self.popped[u]
                    while z >= 0 and ch not in self.edges[z]:
                        count += self.popped[z]
                        z = self.fail[z]
                    if z >= 0:
                        self.fail[v], self.popped[v] = self.edges[z][ch], count
            level = below

    def count(self, word: str) -> int:
        """Pieces of ``word``; -1 if greedy matching gets stuck (the word is one unknown token)."""
        edges, fail, popped = self.edges, self.fail, self.popped
        node = found = 0
        for ch in word:
            after = edges[node].get(ch)
            while after is None:
                found += popped[node]
                node = fail[node]
                if node < 0:
                    return -1
                after = edges[node].get(ch)
            node = after
        while node > 1:
            found += popped[node]
            node = fail[node]
            if node < 0:
                return -1
        return found


def vocabulary(model_file: str) -> tuple[list[str], list[str]]:
    """Ordinary pieces: those that start a word (mark removed), and the others."""
    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    plain = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
    return [p[1:] for p in plain if p[0] == WORD_START and len(p) > 1], [p for p in plain if p[0] != WORD_START]


@functools.lru_cache(maxsize=2)
def automaton(model_file: str) -> Automaton:
    return Automaton(*vocabulary(model_file))


class _Counts(dict):
    def __init__(self, machine: Automaton):
        super().__init__()
        self.machine = machine

    def __missing__(self, word: str) -> int:
        n = self.machine.count(word)
        if len(word) <= LONGEST_REMEMBERED:
            if len(self) >= REMEMBER:
                self.clear()
            self[word] = n
        return n


def token_counts(docs: DataFrame, model_file: str) -> DataFrame:
    """(doc_id, n_words, n_tokens, n_unknown) for each input row.

    Words are split at white space. A word that greedy matching cannot cover is one unknown token. Null and
    empty texts have no words; repeated rows and null ids give a row each.
    """

    def run(batches):
        claim("wordpiece", automaton.cache_clear)
        counts = _Counts(automaton(model_file))
        for ids, texts in pieces(batches, 1 << 21):
            words, tokens, unknown = [], [], []
            for text in texts.to_pylist():
                each = [counts[w] for w in (text or "").split()]
                bad = each.count(-1)
                words.append(len(each))
                tokens.append(sum(each) + 2 * bad)
                unknown.append(bad)
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(x, pa.int64()) for x in (words, tokens, unknown))], ["doc_id", "n_words", "n_tokens", "n_unknown"])

    return id_text(docs).mapInArrow(run, "doc_id long, n_words long, n_tokens long, n_unknown long")
