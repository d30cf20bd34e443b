"""SentencePiece encoding and decoding by vectorised merge rounds.

A text is cut into words where a space mark follows anything else, and words are cut again between
two characters that stand side by side in no piece: no merge crosses either. The words of a batch
that are not remembered from earlier ones become one flat numpy array of symbols. Each round finds the
least pair rank of every word (a segmented minimum), merges its occurrences from the left at once,
and moves words without a pair left out of the array, until it is empty. Ids of words are
remembered in a table of bounded size.

The library takes one best pair after the other: higher score first, then the leftmost. Merging all
occurrences of a word's best pair in one round gives the same unless a new symbol makes a pair at
least as good with its neighbour, which the library would take before the next occurrence. Where
that happens, the occurrences of the word up to this one are merged in the round and the rest
wait. A word of up to ``ROUNDS`` symbols ends within ``ROUNDS`` rounds; what is left then, of longer
words, is finished by a queue over the same pairs, so that a megabyte without a space stays about
linear.

Decoding gathers the bytes of all pieces in one array. Bytes that are no UTF-8 become U+FFFD, one
each, as in the library.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quarry.llm.common import ready_for_texts, shielded, without

SPACE = "▁"       # stands for a space inside pieces
ROUNDS = 64
REMEMBERED = 300_000   # words whose ids a task remembers
CHUNK = 4 << 20        # characters of texts that are worked on at once
NONE = np.int64(1 << 40)   # rank of two symbols that make no piece
CHAR_BITS = 21
_NORMAL, _UNKNOWN, _CONTROL, _BYTE = 1, 2, 3, 6  # fixed values: types of pieces in model files


def taken(flat: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The stretches of ``flat`` one after the other."""
    end = np.cumsum(length)
    return flat[np.repeat(start - (end - length), length) + np.arange(int(end[-1]) if len(end) else 0)]


class Keys:
    """Sorted numbers that are looked up by a hash table; a number whose slot went to another one is
    searched for."""

    BITS = 20

    def __init__(self, key: np.ndarray):
        self.key = key if len(key) else np.array([-1], dtype=np.int64)
        slot = self._slot(self.key)
        self.table = np.zeros(1 << self.BITS, dtype=np.int32)
        self.table[slot] = np.arange(len(self.key))
        self.crowded = np.zeros(1 << self.BITS, dtype=bool)
        self.crowded[slot[self.table[slot] != np.arange(len(self.key))]] = True

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.BITS)).astype(np.int64)

    def find(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the numbers are, and which of them are there at all."""
        slot = self._slot(wanted)
        at = self.table[slot]
        there = self.key[at] == wanted
        other = np.flatnonzero(~there & self.crowded[slot])
        if len(other):
            at[other] = np.minimum(np.searchsorted(self.key, wanted[other]), len(self.key) - 1)
            there[other] = self.key[at[other]] == wanted[other]
        return at, there


class PieceModel:
    """A BPE model file with byte fallback and identity normalisation, as tables."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        with open(path, "rb") as f:
            spec = pb.ModelProto.FromString(f.read())
        norm, trained = spec.normalizer_spec, spec.trainer_spec
        kinds = np.array([p.type for p in spec.pieces])
        if (trained.model_type != 2 or not trained.byte_fallback or norm.precompiled_charsmap or norm.remove_extra_whitespaces
                or not norm.add_dummy_prefix or not norm.escape_whitespaces or trained.treat_whitespace_as_suffix
                or not set(kinds) <= {_NORMAL, _UNKNOWN, _CONTROL, _BYTE}):
            raise ValueError("only BPE models with byte fallback that leave texts as they are, but for a space in front")
        pieces = [p.piece for p in spec.pieces]
        self.size = len(pieces)
        own = {p: i for i, p in enumerate(pieces) if kinds[i] == _NORMAL}
        if any(a != SPACE and b == SPACE for p in own for a, b in zip(p, p[1:])):
            raise ValueError("pieces must hold space marks in front only")
        self.of_byte = np.zeros(256, dtype=np.int64)
        for i in np.flatnonzero(kinds == _BYTE):
            self.of_byte[int(pieces[i][3:5], 16)] = i
        # a character is its piece, or its code point beyond all pieces
        known = [(ord(p), i) for p, i in own.items() if len(p) == 1]
        self.char_code, self.char_id = (np.array(x, dtype=np.int64) for x in zip(*sorted(known)))
        _, rank = np.unique([-p.score for p in spec.pieces], return_inverse=True)
        pairs, side = {}, set()
        for p, i in own.items():
            side.update(zip(p, p[1:]))
            for k in range(1, len(p)):
                left, right = (own.get(x, self.size + ord(x) if len(x) == 1 else -1) for x in (p[:k], p[k:]))
                if left >= 0 and right >= 0:
                    pairs[left << CHAR_BITS | right] = (int(rank[i]), i)
        self.pairs = pairs
        self.key = Keys(np.array(sorted(pairs), dtype=np.int64))
        self.rank, self.merged = (np.array([pairs[k][c] for k in sorted(pairs)], dtype=np.int64) for c in (0, 1))
        self.side = Keys(np.array(sorted(ord(a) << CHAR_BITS | ord(b) for a, b in side), dtype=np.int64))

        shown = [b"" if kinds[i] == _CONTROL else trained.unk_surface.encode() if kinds[i] == _UNKNOWN
                 else bytes([int(p[3:5], 16)]) if kinds[i] == _BYTE else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.shown = np.frombuffer(b"".join(shown), dtype=np.uint8)
        self.shown_length = np.array([len(x) for x in shown], dtype=np.int64)
        self.shown_start = np.cumsum(self.shown_length) - self.shown_length
        self.marked = np.array([kinds[i] == _NORMAL and p.startswith(SPACE) for i, p in enumerate(pieces)])
        self.control, self.byte = kinds == _CONTROL, kinds == _BYTE
        self._forget()

    # --- encoding -------------------------------------------------------------------------------

    def _forget(self) -> None:
        self.words: dict[str, int] = {}
        self.ids = np.zeros(0, dtype=np.int32)
        self.length = np.zeros(0, dtype=np.int64)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and where each text's end (from 0)."""
        cut = [re.findall(f"{SPACE}+[^{SPACE}]*", SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        found = set(chain.from_iterable(cut))
        new = [w for w in found if w not in self.words]
        if new and len(self.words) + len(new) > REMEMBERED:
            self._forget()
            new = list(found)
        if new:
            ids, length = self.encode_words(new)
            self.words.update(zip(new, range(len(self.length), len(self.length) + len(new))))
            self.ids, self.length = np.r_[self.ids, ids], np.r_[self.length, length]
        n = np.array([len(c) for c in cut], dtype=np.int64)
        at = np.fromiter(map(self.words.__getitem__, chain.from_iterable(cut)), dtype=np.int64, count=int(n.sum()))
        length = self.length[at]
        ids = taken(self.ids, (np.cumsum(self.length) - self.length)[at], length)
        return ids, np.r_[0, np.cumsum(length)][np.r_[0, np.cumsum(n)]]

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words, which are not empty, one after the other, and the number of each."""
        code = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
        chars = np.array([len(w) for w in words])
        begin = np.cumsum(chars) - chars
        at = np.minimum(np.searchsorted(self.char_code, code), len(self.char_code) - 1)
        symbol = np.where(self.char_code[at] == code, self.char_id[at], self.size + code)
        first = np.ones(len(code), dtype=bool)
        beside = code[:-1] << CHAR_BITS | code[1:]
        first[1:] = ~self.side.find(beside)[1]
        first[begin] = True
        symbol, place = self._merge(symbol, first)
        # what is no piece goes by its bytes
        code = symbol - self.size
        width = np.where(code < 0, 1, 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF))
        start = np.cumsum(width) - width
        ids = np.repeat(symbol, width)
        for w in range(1, 5):
            of = np.flatnonzero((code >= 0) & (width == w))
            for k in range(w):
                bits = code[of] >> 6 * (w - 1 - k)
                ids[start[of] + k] = self.of_byte[bits if w == 1 else bits & 63 | 0x80 if k else bits | (0xF00 >> w & 0xFF)]
        word = np.searchsorted(begin, place, side="right") - 1
        return ids.astype(np.int32), np.bincount(word, weights=width, minlength=len(words)).astype(np.int64)

    def _look(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and piece of pairs of symbols."""
        at, there = self.key.find(left << CHAR_BITS | right)
        return np.where(there, self.rank[at], NONE), self.merged[at]

    def _merge(self, symbol: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of words (``first``: where one begins) after all merges, and their places."""
        place = np.arange(len(symbol))
        rank, into = self._look(symbol, np.r_[symbol[1:], 0])
        rank[np.r_[first[1:], True]] = NONE
        done = []
        for _ in range(ROUNDS):
            begin = np.flatnonzero(first)
            size = np.diff(np.r_[begin, len(symbol)])
            least = np.minimum.reduceat(rank, begin) if len(begin) else np.zeros(0, dtype=np.int64)
            live = np.repeat(least < NONE, size)
            if not live.all():
                done.append((symbol[~live], place[~live]))
                symbol, place, first, rank, into = (x[live] for x in (symbol, place, first, rank, into))
                least, size = least[least < NONE], size[least < NONE]
            if not len(symbol):
                break
            at = np.flatnonzero(rank == np.repeat(least, size))
            # of occurrences that overlap, every other one, from the left
            k = np.arange(len(at))
            run = np.maximum.accumulate(np.where(np.r_[True, np.diff(at) != 1], k, 0))
            at = at[(k - run) % 2 == 0]
            word = np.cumsum(first)[at]
            new_word = np.r_[True, word[1:] != word[:-1]]
            if not new_word.all():
                at = at[self._together(symbol, first, rank, into, at, new_word)]
            symbol[at] = into[at]
            stay = np.ones(len(symbol), dtype=bool)
            stay[at + 1] = False
            symbol, place, first, rank, into = (x[stay] for x in (symbol, place, first, rank, into))
            at = at - np.arange(len(at))
            again = np.r_[at, at[~first[at]] - 1]
            after = np.minimum(again + 1, len(symbol) - 1)
            rank[again], into[again] = self._look(symbol[again], symbol[after])
            rank[again[first[after] | (after == again)]] = NONE
        for a, b in zip(begin := np.flatnonzero(first), np.r_[begin[1:], len(symbol)]):
            kept, where = self._queue(symbol[a:b].tolist())
            done.append((np.array(kept, dtype=np.int64), place[a:b][where]))
        symbol, place = (np.concatenate([d[k] for d in done]) if done else np.zeros(0, dtype=np.int64) for k in (0, 1))
        order = np.argsort(place, kind="stable")
        return symbol[order], place[order]

    def _together(self, symbol, first, rank, into, at, new_word) -> np.ndarray:
        """Which of the occurrences at ``at`` may be merged in one round, see above."""
        new, n = into[at], len(symbol)
        before = np.where(np.r_[False, (at[1:] - at[:-1] == 2) & ~new_word[1:]], np.r_[0, new[:-1]], symbol[np.maximum(at - 1, 0)])
        left = np.where(first[at], NONE, self._look(before, new)[0])
        after = np.minimum(at + 2, n - 1)
        right = np.where((at + 2 >= n) | first[after], NONE, self._look(new, symbol[after])[0])
        bad = np.minimum(left, right) <= rank[at]
        earlier = np.cumsum(bad) - bad
        begin = np.flatnonzero(new_word)
        return earlier == np.repeat(earlier[begin], np.diff(np.r_[begin, len(at)]))

    def _queue(self, symbol: list[int]) -> tuple[list[int], list[int]]:
        """The rest of one long word: symbols and the indexes they began at."""
        n = len(symbol)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []

        def offer(i):
            j = after[i] if i >= 0 else n
            pair = self.pairs.get(symbol[i] << CHAR_BITS | symbol[j]) if j < n else None
            if pair:
                heapq.heappush(heap, (pair[0], i, pair[1], symbol[i], symbol[j]))
        for i in range(n):
            offer(i)
        while heap:
            _, i, piece, left, right = heapq.heappop(heap)
            j = after[i]
            if symbol[i] != left or j >= n or symbol[j] != right:
                continue  # one of the two has changed
            symbol[i], symbol[j] = piece, -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            offer(before[i])
            offer(i)
        kept = [i for i in range(n) if symbol[i] >= 0]
        return [symbol[i] for i in kept], kept

    # --- decoding -------------------------------------------------------------------------------

    def bytes_of(self, ids: np.ndarray) -> np.ndarray:
        """The bytes that the ids stand for, one after the other; the space in front included."""
        return taken(self.shown, self.shown_start[ids], self.shown_length[ids])

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> list[str]:
        """Texts of ids, which end at ``ends`` (from 0)."""
        if len(ids) and (ids.min() < 0 or ids.max() >= self.size):
            raise ValueError("an id is not of this model")
        data = self.bytes_of(ids).tobytes()
        at = np.r_[0, np.cumsum(self.shown_length[ids])][ends]
        out = []
        for k in range(len(ends) - 1):
            own = ids[ends[k]:ends[k + 1]]
            if self.control[own].any():
                out.append(self._decode_slowly(own))
                continue
            try:
                out.append(data[at[k] + (len(own) > 0 and bool(self.marked[own[0]])):at[k + 1]].decode())
            except UnicodeDecodeError:
                out.append(self._decode_slowly(own))
        return out

    def _decode_slowly(self, ids: np.ndarray) -> str:
        """Runs of byte pieces are read for themselves, what is no UTF-8 in them byte by byte."""
        out, i, seen = "", 0, False
        while i < len(ids):
            j = i
            while j < len(ids) and self.byte[ids[j]]:
                j += 1
            if j > i:
                out += _utf8(self.bytes_of(ids[i:j]).tobytes())
                i = j
                continue
            text = self.bytes_of(ids[i:i + 1]).tobytes().decode()
            if self.marked[ids[i]] and not seen and not out:
                text, seen = text[1:], True
            out += text
            i += 1
        return out


def _utf8(data: bytes) -> str:
    out, i = [], 0
    while i < len(data):
        for n in (1, 2, 3, 4):
            try:
                out.append(data[i:i + n].decode())
                i += n
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            i += 1
    return "".join(out)


_models: dict[str, PieceModel] = {}


def model(path: str) -> PieceModel:
    if path not in _models:
        _models[path] = PieceModel(path)
    return _models[path]


def in_chunks(sizes: list[int], most: int = CHUNK) -> list[tuple[int, int]]:
    """Stretches of rows whose sizes add up to about ``most``; a larger row is one of its own."""
    out, a, total = [], 0, 0
    for k, n in enumerate(sizes):
        if k > a and total + n > most:
            out.append((a, k))
            a, total = k, 0
        total += n
    return out + ([(a, len(sizes))] if a < len(sizes) else [])


def _append(df: DataFrame, field: T.StructField, need: str, make) -> DataFrame:
    """``df`` with one column more, an Arrow array that ``make`` gives for each piece of column
    ``need``; a column of that name is replaced."""
    ready_for_texts(df.sparkSession)
    base = without(df, [field.name])
    own, at = shielded(base), base.columns.index(need)
    schema = T.StructType([*own.schema.fields, field])
    kind = to_arrow_schema(T.StructType([field]))[0].type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, made in make(b, b.column(at)):
                yield pa.RecordBatch.from_arrays([*part.columns, made.cast(kind)], names=schema.names)

    return own.mapInArrow(run, schema).toDF(*base.columns, field.name)


def encode_pieces(docs: DataFrame, path: str, text_col: str = "text", name: str = "piece_ids") -> DataFrame:
    """``docs`` with the ids of every whole text, an array of int, as column ``name`` (a column so
    called is replaced). ``path``: a model file that every worker has.

    Null and empty texts have no ids. Texts of any length are encoded whole; repeated rows and ids
    stay rows of their own; an empty table gives an empty table; other columns pass untouched.
    """
    def make(b, texts):
        texts = [t or "" for t in texts.to_pylist()]
        for i, j in in_chunks([len(t) for t in texts]):
            ids, ends = model(path).encode(texts[i:j])
            yield b.slice(i, j - i), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))

    return _append(docs, T.StructField(name, T.ArrayType(T.IntegerType())), text_col, make)


def decode_pieces(docs: DataFrame, path: str, ids_col: str = "piece_ids", name: str = "decoded") -> DataFrame:
    """``docs`` with the text of every array of ids as column ``name`` (replaced if there is one).

    Null and empty arrays give an empty text, null ids inside an array are passed over; ids that
    the model has not raise an error. Control ids give nothing, the unknown id its surface.
    """
    def make(b, lists):
        kept = [[i for i in x or [] if i is not None] for x in lists.to_pylist()] if lists.null_count or lists.flatten().null_count else None
        if kept is not None:
            lists = pa.array(kept, pa.list_(pa.int32()))
        ids = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        ends = lists.offsets.to_numpy().astype(np.int64)
        yield b, pa.array(model(path).decode(ids, ends - ends[0]), pa.string())

    return _append(docs, T.StructField(name, T.StringType()), ids_col, make)
