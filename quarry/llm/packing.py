"""Best-fit packing of token sequences by bin completion with branch and bound.

Documents become pieces of at most ``capacity`` tokens. Pieces of one length are
interchangeable, so what is searched is the histogram of lengths (at most ``capacity`` rows,
whatever the corpus holds). A best-fit-decreasing packing of it is the incumbent. Where that misses
the lower bound, the largest remaining length is completed by the filling that leaves least waste,
over and over; and of the better of the two, the bins that waste most are searched for a packing
with one bin less: branch and bound over all undominated fillings around the largest piece. The
resulting plan has a few thousand patterns and is looked up in the tasks; the rank of a piece among
those of its length decides its bin, so no piece meets another in one task.

Ranks come from counters kept while the pieces are written, one per (task, length), and the sums
of those counters over earlier tasks, so a length that holds a third of all pieces is not
gathered anywhere.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_right
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import materialise, quoted

CAPACITY = 2048
END_ID = 0
SEARCH_NODES = 4_000    # of the search for one bin's fullest filling
TAIL_NODES = 100_000    # of the search for one bin less
FIRST_TAIL, MAX_TAIL = 8, 512  # bins searched together


# Fixed value: how byte-level tokenizers cut a text before merging.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


# --- tokens ---------------------------------------------------------------------------------

class Encoder:
    """Ids of a ``tokenizers`` file. Where the file's merges are a plain byte-level ranking, the
    ids are computed by an equal but faster ``tiktoken`` encoding built from the same file; texts
    that hold a special token, or a run without white space long enough to be slow there, go to
    ``tokenizers``, as does everything if the file is of another kind."""

    LONG_RUN = 2_000

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.fast = self._fast(spec)

    @staticmethod
    def _fast(spec):
        import tiktoken

        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        plain = (model["type"] == "BPE" and spec.get("normalizer") is None and pre.get("type") == "ByteLevel"
                 and not pre.get("add_prefix_space") and pre.get("use_regex", True))
        if not plain:
            return None
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        ids = [model["vocab"].get(a + b, -1) for a, b in merges]
        if any(y <= x for x, y in zip(ids, ids[1:])):  # ids must follow the order of merges
            return None
        # the byte-level alphabet: printable bytes stand for themselves, the rest for code points from 256 on
        keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letters = {chr(b): b for b in keep} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in set(keep))}
        special = {t["content"] for t in spec.get("added_tokens", [])}
        ranks = {bytes(letters[c] for c in tok): i for tok, i in model["vocab"].items() if tok not in special}
        # ranks of single bytes are never compared, those of merges are in order as checked above
        return tiktoken.Encoding("packing", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        if self.fast is None or any(s in text for s in self.special) or (
                len(text) > self.LONG_RUN and max(map(len, text.split()), default=0) > self.LONG_RUN) or "  " * self.LONG_RUN in text:
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, dtype="<u4")
        return np.array(self.fast.encode_ordinary(text), dtype="<u4")


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """``(start, length)`` of the pieces of ``n`` tokens: full ones, the first may be shorter."""
    first = n - (n - 1) // capacity * capacity
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def pieces(docs: DataFrame, id_col: str, text_col: str, tokenizer: str, capacity: int = CAPACITY,
           end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32[, ids], task, rank)``: the pieces of every row,
    with the rank of each among the task's pieces of its length."""
    src = docs.select(quoted(id_col).alias("doc_id"), quoted(text_col).cast("string").alias("text"))
    id_type = src.schema["doc_id"].dataType.simpleString()
    ddl = f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long, " + (
        "ids array<int>, " if with_ids else "") + "task int, rank long"

    def run(batches):
        enc, task, seen = encoder(tokenizer), TaskContext.get().partitionId(), Counter()
        for b in batches:
            row, piece, start, length, crc, ids, rank = [], [], [], [], [], [], []
            for k, text in enumerate(b.column(1).to_pylist()):
                toks = np.append(enc.encode(text or ""), np.uint32(end_id)).astype("<u4")
                for p, (s, n) in enumerate(cut(len(toks), capacity)):
                    row.append(k)
                    piece.append(p)
                    start.append(s)
                    length.append(n)
                    crc.append(zlib.crc32(toks[s:s + n].tobytes()))
                    if with_ids:
                        ids.append(toks[s:s + n].astype(np.int32))
                    rank.append(seen[n])
                    seen[n] += 1
            cols = [b.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                cols.append(pa.array(ids, pa.list_(pa.int32())))
                names.append("ids")
            cols += [pa.array([task] * len(row), pa.int32()), pa.array(rank, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=names + ["task", "rank"])

    return src.mapInArrow(run, ddl)


# --- the plan: patterns over the histogram of lengths ------------------------------------------

def fill(lengths: list[int], counts: dict[int, int], room: int, nodes: int = SEARCH_NODES) -> list[int]:
    """The filling of ``room`` by available lengths with least waste, larger pieces first among
    equals. Branch and bound: the greedy best-fit filling is the incumbent, larger lengths are
    tried before smaller, a branch ends when even all that is left to it cannot beat the
    incumbent, and a filling that another dominates (a smaller piece where a larger one still
    fits) is not opened. ``lengths`` ascends; ``nodes`` bounds the search, after which the
    incumbent stands."""
    best: list[int] = []
    best_sum, budget = 0, nodes
    total_small = np.cumsum([n * counts[n] for n in lengths])

    def search(limit: int, left: int, chosen: list[int], used: Counter, total: int) -> bool:
        nonlocal best, best_sum, budget
        if total > best_sum:
            best, best_sum = list(chosen), total
            if best_sum == room:
                return True
        i = bisect_right(lengths, min(limit, left)) - 1
        while i >= 0:
            budget -= 1
            if budget < 0:
                return True
            n = lengths[i]
            if total + min(left, int(total_small[i])) <= best_sum:
                return False
            if used[n] < counts[n]:
                chosen.append(n)
                used[n] += 1
                if search(n, left - n, chosen, used, total + n):
                    return True
                chosen.pop()
                used[n] -= 1
            i -= 1
        return False

    search(room, room, [], Counter(), 0)
    return best


def complete_bins(hist: dict[int, int], capacity: int, nodes: int = SEARCH_NODES) -> list[tuple[list[int], int]]:
    """Patterns ``(lengths, times)`` by bin completion around the largest remaining length."""
    counts = {n: c for n, c in hist.items() if c > 0}
    lengths = sorted(counts)
    out = []
    while lengths:
        top = lengths[-1]
        counts[top] -= 1
        rest = fill(lengths if counts[top] else lengths[:-1], counts, capacity - top, nodes) if capacity > top else []
        counts[top] += 1
        need = Counter([top, *rest])
        times = min(counts[n] // k for n, k in need.items())
        out.append(([top, *rest], times))
        for n, k in need.items():
            counts[n] -= k * times
            if not counts[n]:
                del counts[n]
                lengths.remove(n)
    return out


def best_fit(hist: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """Best-fit decreasing over the histogram, whole groups of equal bins at a time."""
    open_bins: dict[int, list[list]] = defaultdict(list)  # room left → [[lengths, times]]
    rooms: list[int] = []
    for n in sorted(hist, reverse=True):
        todo = hist[n]
        while todo:
            i = next((i for i, r in enumerate(rooms) if r >= n), None)
            if i is None:
                k = capacity // n
                if todo >= k:
                    took, bins, room = k, todo // k, capacity - k * n
                else:
                    took, bins, room = todo, 1, capacity - todo * n
                put = [([n] * took, bins)]
                todo -= took * bins
            else:
                room = rooms[i]
                lens, times = open_bins[room].pop()
                if not open_bins[room]:
                    rooms.pop(i)
                k = min(room // n, todo)
                use = min(times, todo // k)
                put = [(lens + [n] * k, use)]
                if use < times:
                    _open(open_bins, rooms, room, lens, times - use)
                todo -= k * use
                room -= k * n
            for lens, times in put:
                _open(open_bins, rooms, room, lens, times)
    return [(lens, times) for group in open_bins.values() for lens, times in group]


def _open(open_bins, rooms, room, lens, times):
    if not open_bins[room]:
        rooms.insert(bisect_right(rooms, room), room)
    open_bins[room].append([lens, times])


def least_bins(hist: dict[int, int], capacity: int) -> int:
    """A lower bound of the bins needed: pieces above half the room need one each, and what small
    pieces exceed the room left beside them; the best over all limits between small and large."""
    best = -(-sum(n * c for n, c in hist.items()) // capacity)
    for small in {0, *(n for n in hist if 2 * n <= capacity)}:
        alone = sum(c for n, c in hist.items() if n > capacity - small)
        beside = {n: c for n, c in hist.items() if 2 * n > capacity and n <= capacity - small}
        room = sum((capacity - n) * c for n, c in beside.items())
        rest = sum(n * c for n, c in hist.items() if small <= n and 2 * n <= capacity)
        best = max(best, alone + sum(beside.values()) + max(0, -(-(rest - room) // capacity)))
    return best


class Exhausted(Exception):
    """The search has opened as many nodes as it was given."""


class Completion:
    """Whether the pieces of a histogram fit into ``bins`` bins, by bin completion with branch and
    bound: the bin of the largest piece left gets each undominated filling in turn, as often as the
    counts allow and then less often, and a branch ends when the waste so far exceeds what ``bins``
    bins may waste. Fillings of one largest piece are taken in a fixed order, so that no set of bins
    is met twice. Without ``Exhausted`` the answer is exact."""

    def __init__(self, hist: dict[int, int], capacity: int, bins: int, nodes: int):
        self.counts, self.capacity, self.nodes = dict(hist), capacity, nodes
        self.waste = bins * capacity - sum(n * c for n, c in hist.items())

    def plan(self) -> list[tuple[list[int], int]] | None:
        return self._solve(self.waste, None) if self.waste >= 0 else None

    def _open(self) -> None:
        self.nodes -= 1
        if self.nodes < 0:
            raise Exhausted

    def _solve(self, waste: int, last) -> list[tuple[list[int], int]] | None:
        top = max((n for n, c in self.counts.items() if c), default=0)
        if not top:
            return []
        self.counts[top] -= 1
        options = sorted(self._fillings(self.capacity - top, waste))
        self.counts[top] += 1
        for left, key in options:
            if last is not None and last[0] == top and (left, key) <= last[1]:
                continue
            need = Counter([top, *(-n for n in key)])
            most = min(self.counts[n] // k for n, k in need.items())
            for times in range(min(most, waste // left) if left else most, 0, -1):
                self._open()
                for n, k in need.items():
                    self.counts[n] -= k * times
                rest = self._solve(waste - left * times, (top, (left, key)))
                for n, k in need.items():
                    self.counts[n] += k * times
                if rest is not None:
                    return [([top, *(-n for n in key)], times), *rest]
        return None

    def _fillings(self, room: int, waste: int):
        """``(room left, lengths as negatives)`` of the undominated fillings that waste no more."""
        lengths = sorted((n for n, c in self.counts.items() if c), reverse=True)
        after = [0] * (len(lengths) + 1)  # what all lengths from here on hold
        for i in range(len(lengths) - 1, -1, -1):
            after[i] = after[i + 1] + lengths[i] * self.counts[lengths[i]]

        def go(i: int, left: int, chosen: list[int]):
            if left <= waste and not self._dominated(chosen, left, lengths):
                yield left, tuple(-n for n in chosen)
            for j in range(i, len(lengths)):
                self._open()
                if left - min(left, after[j]) > waste:
                    return
                n = lengths[j]
                for k in range(min(self.counts[n], left // n), 0, -1):
                    yield from go(j + 1, left - k * n, chosen + [n] * k)

        yield from go(0, room, [])

    def _dominated(self, chosen: list[int], left: int, lengths: list[int]) -> bool:
        """Whether a piece that is left could take the place of none, one or more chosen ones: those
        fit wherever that piece would have gone."""
        used, sums, low = Counter(chosen), 1, list(reversed(chosen))
        for n in reversed(lengths):
            while low and low[0] < n:  # sums of the chosen pieces smaller than n
                sums |= sums << low.pop(0)
            if used[n] < self.counts[n]:
                if n <= left or (sums >> max(1, n - left)) & ((1 << (n - max(1, n - left) + 1)) - 1):
                    return True
        return False


def improved(plan: list[tuple[list[int], int]], bins: int, capacity: int, nodes: int) -> list[tuple[list[int], int]] | None:
    """``plan`` with the ``bins`` bins that waste most packed into one bin less, if there is a way."""
    head, tail, todo = [], Counter(), bins
    for lens, times in sorted(plan, key=lambda p: sum(p[0])):
        take = min(times, todo)
        todo -= take
        for n in lens:
            tail[n] += take
        if times > take:
            head.append((lens, times - take))
    if least_bins(tail, capacity) >= bins:
        return None
    try:
        found = Completion(tail, capacity, bins - 1, nodes).plan()
    except Exhausted:
        return None
    return None if found is None else head + found


def plan_bins(hist: dict[int, int], capacity: int = CAPACITY, nodes: int = SEARCH_NODES) -> list[tuple[list[int], int]]:
    """As few bins as the search finds. Best fit is the incumbent, and at the lower bound there is
    no better. Otherwise the greedy completion competes, and then the bins that waste most are
    searched for a packing with one bin less, ever more of them, up to ``MAX_TAIL``; the whole, if
    it has no more bins than that. The packing is then a least one unless the search ran out of
    ``TAIL_NODES`` nodes: bin packing is NP-hard, so no bounded search can always say."""
    size = lambda p: sum(t for _, t in p)
    least = least_bins(hist, capacity)
    plan = best_fit(hist, capacity)
    if size(plan) > least:
        plan = min(complete_bins(hist, capacity, nodes), plan, key=size)
    bins = FIRST_TAIL
    while size(plan) > least:
        better = improved(plan, min(bins, size(plan)), capacity, TAIL_NODES)
        if better is not None:
            plan = better
        elif bins >= min(MAX_TAIL, size(plan)):
            break
        else:
            bins *= 4
    return plan


def plan_table(patterns: list[tuple[list[int], int]]) -> dict[str, np.ndarray]:
    """Sorted lookup: for a length, ranks from ``rank`` on go to bins from ``bin`` on, ``each`` of
    them to a bin, the first at ``offset``."""
    rows, used, bins = [], Counter(), 0
    for lens, times in patterns:
        at = 0
        for n, k in sorted(Counter(lens).items(), reverse=True):
            rows.append((n, used[n], bins, k, at))
            used[n] += k * times
            at += n * k
        bins += times
    a = np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)
    return {"key": (a[:, 0] << 44) + a[:, 1], "rank": a[:, 1], "bin": a[:, 2], "each": a[:, 3], "offset": a[:, 4]}


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
         end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset)``, one row per piece.

    A null text is an empty one and still has its end token; null and repeated ids are documents
    of their own; texts of any length are tokenized whole; an empty table gives an empty table;
    further columns of ``docs`` are not read. ``tokenizer`` is the path of a file that every
    worker has.
    """
    parts = materialise(pieces(docs, id_col, text_col, tokenizer, capacity, end_id, with_ids), "packing-pieces")
    counted = materialise(parts.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n")), "packing-counts")
    hist = {r["length"]: r["n"] for r in counted.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # ≤ capacity rows
    table = docs.sparkSession.sparkContext.broadcast(plan_table(plan_bins(hist, capacity)))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = materialise(counted.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier")),
                          "packing-offsets")
    ranked = parts.join(offsets, ["length", "task"]).withColumn("rank", F.col("rank") + F.col("earlier"))
    keep = [c for c in parts.columns if c not in ("task", "rank")]
    src = ranked.select(*keep, "rank")
    schema = src.select(*keep, F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset")).schema
    at_length = keep.index("length")

    def place(batches):
        t = table.value
        for b in batches:
            n = b.column(at_length).to_numpy()
            rank = b.column(b.num_columns - 1).to_numpy()
            row = np.searchsorted(t["key"], (n << 44) + rank, side="right") - 1
            k = rank - t["rank"][row]
            each = t["each"][row]
            cols = [*b.columns[:-1], pa.array(t["bin"][row] + k // each), pa.array(t["offset"][row] + k % each * n)]
            yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return src.mapInArrow(place, schema)
