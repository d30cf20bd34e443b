"""Token counts by trie-shared dynamic programming over a unigram vocabulary.

A text's tokens are those of its pre-tokens (words, each with its leading space mark), each cut
into the vocabulary's pieces with the highest sum of log-probabilities. The best score of a
prefix does not depend on what follows, so the distinct pre-tokens of a batch are walked as a
trie, depth first: sorted, every pre-token goes on from the last node it shares with the one
before, and the forward scores of shared prefixes are computed once. A terminal node's token
count is stored and a text's count is the sum over its pre-tokens.

The work needs no shuffle: texts meet only the vocabulary, which is a file. Stored counts are
dropped when they pass ``MAX_STORED``, which changes no result.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quarry.llm.common import add_columns

MARK = "▁"
MAX_STORED = 1 << 20
FIELDS = [T.StructField("n_pretokens", T.LongType()), T.StructField("n_tokens", T.LongType())]


class Vocabulary:
    """Pieces of a ``sentencepiece`` file. Its ranks stand in for frequencies, since the public
    files are of the ranked kind: the piece of rank r has log-probability ``-log(r + 1)`` less a
    constant (Zipf's law). A character outside the vocabulary costs one piece per UTF-8 byte, each
    less likely than any listed piece."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = [sp.id_to_piece(i) for i in range(sp.get_piece_size())
                 if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
        self._set(plain)

    def _set(self, ranked: list[str]):
        norm = math.log(sum(1 / (r + 1) for r in range(len(ranked)))) if ranked else 0.0
        self.score = {p: -math.log(r + 1) - norm for r, p in reversed(list(enumerate(ranked))) if p}
        self.byte = min(self.score.values(), default=0.0) - 1.0
        # every tail of a piece, None where it is no piece itself: a longer look back from a
        # string that is no tail cannot succeed
        self.tails: dict[str, float | None] = {}
        for p in self.score:
            for i in range(len(p)):
                self.tails.setdefault(p[i:], None)
        self.tails.update(self.score)
        self.longest = max(map(len, self.score), default=1)

    @classmethod
    def of(cls, ranked: list[str]) -> Vocabulary:
        v = cls.__new__(cls)
        v._set(ranked)
        return v

    def count_all(self, words: list[str]) -> dict[str, int]:
        """Token counts of distinct pre-tokens. Of equally likely cuts the one with fewer pieces
        counts."""
        tails, byte = self.tails, self.byte
        best, pieces, before, out = [0.0], [0], "", {}
        for w in sorted(words):
            shared, top = 0, min(len(before), len(w))
            while shared < top and before[shared] == w[shared]:
                shared += 1
            del best[shared + 1:], pieces[shared + 1:]
            for j in range(shared + 1, len(w) + 1):
                wide = len(w[j - 1].encode("utf-8", "replace"))
                top_score, top_n = best[j - 1] + byte * wide, pieces[j - 1] + wide
                i = j - 1
                while i >= 0:
                    s = tails.get(w[i:j], 0.0)
                    if s is not None:
                        if s == 0.0 and w[i:j] not in tails:
                            break
                        total = best[i] + s
                        if total > top_score or total == top_score and pieces[i] + 1 < top_n:
                            top_score, top_n = total, pieces[i] + 1
                    i -= 1
                best.append(top_score)
                pieces.append(top_n)
            out[w] = pieces[len(w)]
            before = w
        return out


_loaded: dict[str, tuple[Vocabulary, dict[str, int]]] = {}


def _store(path: str) -> tuple[Vocabulary, dict[str, int]]:
    if path not in _loaded:
        _loaded[path] = (Vocabulary(path), {})
    return _loaded[path]


def count_tokens(docs: DataFrame, vocabulary: str, text_col: str = "text") -> DataFrame:
    """``docs`` with ``n_pretokens`` and ``n_tokens`` of every whole text.

    Null, empty and blank texts have none; a text of any length is counted whole, and a word of any
    length is one pre-token; repeated rows get the same counts; an empty table gives an empty
    table. Columns so called are replaced, all others kept. ``vocabulary`` is the path of a file
    that every worker has.
    """
    def rows(texts):
        vocab, known = _store(vocabulary)
        words = [(t or "").split() for t in texts]
        new = {w for ws in words for w in ws}.difference(known)
        counts = vocab.count_all([MARK + w for w in new])
        if len(known) + len(new) > MAX_STORED:
            known.clear()
            new = {w for ws in words for w in ws}
            counts = {**counts, **vocab.count_all([MARK + w for w in new if MARK + w not in counts])}
        known.update((w, counts[MARK + w]) for w in new)
        get = known.__getitem__
        return [len(ws) for ws in words], [int(np.sum(list(map(get, ws)), dtype=np.int64)) if ws else 0 for ws in words]

    return add_columns(docs, FIELDS, rows, [text_col])
