"""Benchmark decontamination with one Aho-Corasick automaton over normalised test items.

Items and documents are cut into words the same way. Every run of ``window`` consecutive words
of an item (the whole item if it is shorter) is a pattern of the automaton, whose alphabet is
the word, so that a pattern costs one node per word at most and matches give word positions. A
document is scanned once, whole; hit words are mapped to character offsets of the original text
only where something matched.

The items reach the tasks in blocks of bounded size (``BLOCK_CHARS`` of text, checked by an
aggregate before anything is collected). A test set of more than one block has an automaton for
each; a task then holds up to ``HELD_BYTES`` of documents and takes the automata over them one after
another, so that the corpus is read once and nothing of it is written.
"""

from __future__ import annotations

import math
import re

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quarry.llm.common import quoted, ready_for_texts, shielded, without

WINDOW = 13
BLOCK_CHARS = 1_000_000
HELD_BYTES = 64 << 20

# What separates words, once A-Z are lower-cased.
_TO_WORDS = bytes(c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 0x20
                  for c in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

FIELDS = [T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()),
          T.StructField("hit_words", T.ArrayType(T.ArrayType(T.LongType()))),
          T.StructField("hit_spans", T.ArrayType(T.ArrayType(T.LongType()))),
          T.StructField("hit_items", T.ArrayType(T.StringType()))]


def words(text: str | None) -> list[bytes]:
    """Lower-cased words, as UTF-8."""
    return (text or "").encode("utf-8", "replace").translate(_TO_WORDS).split()


class Automaton:
    """The windows of a block of ``(item id, text)``."""

    def __init__(self, items, window: int):
        self.ids: dict[bytes, int] = {}
        owners: dict[tuple, set] = {}
        for item, text in items:
            w = tuple(self.ids.setdefault(x, len(self.ids) + 1) for x in words(text))
            for i in range(max(1, len(w) - window + 1) if w else 0):
                owners.setdefault(w[i:i + window], set()).add("" if item is None else str(item))
        self.machine = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for key, who in owners.items():
            self.machine.add_word(key, (len(key), who))
        self.empty = not owners
        if owners:
            self.machine.make_automaton()

    def scan(self, doc: list[bytes]) -> tuple[list[list[int]], set[str]]:
        """Merged half-open ranges of hit words, and the items whose windows occur."""
        if self.empty or self.ids.keys().isdisjoint(doc):
            return [], set()
        ranges: list[list[int]] = []
        items: set[str] = set()
        get = self.ids.get
        for last, (n, who) in self.machine.iter(tuple([get(x, 0) for x in doc])):
            items |= who
            ranges.append([last - n + 1, last + 1])
        return merged(ranges), items


def merged(ranges: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def spans(text: str, ranges: list[list[int]]) -> list[list[int]]:
    """Character ranges (code points, half open) of ranges of words."""
    if not ranges:
        return []
    at = np.array([m.span() for m in _WORD.finditer(text)])
    return [[int(at[a][0]), int(at[b - 1][1])] for a, b in ranges]


_cached: dict = {}


def _automaton(block, window: int) -> Automaton:
    """Built once for a block in each Python worker; the last one only is kept."""
    if block.id not in _cached:
        _cached.clear()
        _cached[block.id] = Automaton(block.items.value, window)
    return _cached[block.id]


class _Block:
    def __init__(self, spark, items):
        self.items = spark.sparkContext.broadcast(items)
        self.id = id(self), len(items), hash(tuple(items))


def item_blocks(benchmark: DataFrame, id_col: str, text_col: str, block_chars: int) -> list[_Block]:
    """The items in blocks; which block an item is in depends on its text alone."""
    b = benchmark.select(quoted(id_col).cast("string").alias("id"), quoted(text_col).cast("string").alias("text")).filter(
        "text is not null").distinct()
    chars = b.agg(F.sum(F.length("text"))).first()[0] or 0
    n = 1 if chars <= block_chars else math.ceil(2 * chars / block_chars)
    parts = (b.filter(F.pmod(F.xxhash64("text"), F.lit(n)) == i) if n > 1 else b for i in range(n))
    return [_Block(b.sparkSession, [tuple(r) for r in p.collect()]) for p in parts]


def find_hits(docs: DataFrame, benchmark: DataFrame, doc_text: str = "text", item_id: str = "item_id",
              item_text: str = "text", window: int = WINDOW, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``docs`` with ``n_words``, ``n_hit`` (words inside any occurrence of a window), ``hit_words``
    and ``hit_spans`` (merged half-open ranges, in words and in characters of the original text)
    and ``hit_items`` (ids as sorted strings).

    Null and wordless documents have no words and no hits, null items no windows; an item without
    id is listed as the empty string; rows that share an item id are one item; repeated documents
    are each reported; with an empty test set nothing is hit. Columns of ``docs`` that carry one
    of the five names are replaced, all others are kept.
    """
    ready_for_texts(docs.sparkSession)
    base = without(docs, [f.name for f in FIELDS])
    own, at = shielded(base), base.columns.index(doc_text)
    schema = T.StructType(list(own.schema.fields) + FIELDS)
    arrow = to_arrow_schema(T.StructType(FIELDS))
    blocks = item_blocks(benchmark, item_id, item_text, block_chars)

    def judged(held: list[pa.RecordBatch]):
        found = [[(0, [], set())] * b.num_rows for b in held]
        for block in blocks:
            machine = _automaton(block, window)
            for b, rows in zip(held, found):
                for k, t in enumerate(b.column(at).to_pylist()):
                    w = words(t)
                    ranges, items = machine.scan(w)
                    _, before, others = rows[k]
                    rows[k] = len(w), merged(before + ranges) if before else ranges, others | items
        for b, rows in zip(held, found):
            out = [(n, sum(y - x for x, y in ranges), ranges, spans(b.column(at)[k].as_py(), ranges) if ranges else [], sorted(items))
                   for k, (n, ranges, items) in enumerate(rows)]
            cols = list(zip(*out)) if out else [()] * len(FIELDS)
            arrays = list(b.columns) + [pa.array(list(c), type=f.type) for c, f in zip(cols, arrow)]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    def scan(batches):
        held, size = [], 0
        for b in batches:
            held.append(b)
            size += b.column(at).nbytes
            if len(blocks) == 1 or size >= HELD_BYTES:
                yield from judged(held)
                held, size = [], 0
        yield from judged(held)

    found = own.mapInArrow(scan, schema)
    return found.toDF(*base.columns, *[f.name for f in FIELDS])


def contaminated(share: int = 20):
    """At least one word in ``share`` is hit, and any."""
    return (F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words"))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, doc_text: str = "text", item_id: str = "item_id",
                        item_text: str = "text", window: int = WINDOW, share: int = 20) -> DataFrame:
    """``docs`` without the contaminated ones; all columns as they are, whatever their names. Documents
    that are null or have no words stay, as does every row of an empty test set's corpus; repeated
    rows are judged alike; an empty table gives an empty table."""
    tagged = docs.select(*[quoted(c) for c in docs.columns], quoted(doc_text).alias("__scanned"))
    found = find_hits(tagged.withColumnsRenamed({c: f"__own_{i}" for i, c in enumerate(docs.columns)}), benchmark,
                      "__scanned", item_id, item_text, window)
    kept = found.filter(~contaminated(share))
    return kept.select(*[F.col(f"__own_{i}").alias(c) for i, c in enumerate(docs.columns)])
