"""Secret scans that judge candidates by corpus-wide ownership.

A scan of every whole text finds base spans (assignments to secret-like names, access keys, long
hex runs) and further candidates (long mixed tokens). The values' hashes are aggregated over the
corpus to the number of distinct repositories and owners that hold them: a value held by many is
a widely copied example, one held by a single owner that also looks random is a live-looking
credential. Base spans are always reported; of the further candidates, those judged live are.

Per-value counts go through two map-side-combined aggregates (distinct holders, then their
number), so a value copied into a third of all documents costs one row per task. The verdicts
are written before they are joined back, which leaves the join free to split a hot value.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.common import fresh, materialise, quoted

# The base patterns and the least length of what they find; kinds in listed order.
KINDS = ["assign", "access", "hex", "live"]
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 6, "access": 20, "hex": 24}
ASSIGN_WORDS = ("passw", "secret", "token", "api")
PLACEHOLDERS = re.compile(r"example|sample|changeme|your|dummy|placeholder|test|xxxx|0000|1234|abcd", re.A | re.I)

# The method's own candidates: mixed tokens of some length.
TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
LIVE_BITS = 3.0
MAX_LIVE_OWNERS = 1
MAX_LIVE_REPOS = 3

# In a run of fewer characters no candidate can stand, so most texts are settled by this scan.
_HEX_LONG = re.compile(r"[0-9a-f]{24,}")


def bits(value: str) -> float:
    """Shannon entropy of the characters."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) if n else 0.0


def live_looking(value: str) -> bool:
    return bits(value) >= LIVE_BITS and not PLACEHOLDERS.search(value)


def base_spans(text: str) -> list[tuple[str, int, int, str]]:
    """``(kind, start, end, value)``: leftmost non-overlapping matches of each kind, too short
    ones dropped after matching."""
    out = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        out += [("assign", *m.span(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        out += [("access", *m.span(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]]
    if _HEX_LONG.search(text):
        out += [("hex", *m.span(), m[0]) for m in HEX.finditer(text) if len(m[0]) >= LEAST["hex"]]
    return out


def more_candidates(text: str, base: list[tuple[str, int, int, str]]) -> list[tuple[str, int, int, str]]:
    """Long tokens with a capital, a small letter and a digit that touch no base span."""
    out = []
    for m in TOKEN.finditer(text):
        v = m[0]
        if re.search("[A-Z]", v) and re.search("[a-z]", v) and re.search("[0-9]", v) and live_looking(v) and not any(
                a < m.end() and m.start() < b for _, a, b, _ in base):
            out.append(("live", *m.span(), v))
    return out


SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("kind_no", T.IntegerType()),
                     T.StructField("end", T.LongType()), T.StructField("value", T.LongType()),
                     T.StructField("looks_live", T.BooleanType())])


def _scanned(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` with a row number and the candidates of each text, written once."""
    schema = T.StructType(list(docs.schema.fields) + [T.StructField("__row", T.LongType()),
                                                      T.StructField("__found", T.ArrayType(SPAN))])
    span_type = pa.list_(pa.struct([("start", pa.int64()), ("kind_no", pa.int32()), ("end", pa.int64()),
                                    ("value", pa.int64()), ("looks_live", pa.bool_())]))

    def run(batches):
        row = TaskContext.get().partitionId() << 40
        for b in batches:
            found = []
            for t in b.column(b.schema.get_field_index(text)).to_pylist():
                base = base_spans(t or "")
                every = base + more_candidates(t or "", base)
                found.append([{"start": a, "kind_no": KINDS.index(k), "end": e, "looks_live": live_looking(v),
                               "value": xxhash.xxh64_intdigest(v.encode()) - (1 << 63)} for k, a, e, v in every])
            rows = pa.array(range(row, row + b.num_rows), pa.int64())
            row += b.num_rows
            yield pa.RecordBatch.from_arrays([*b.columns, rows, pa.array(found, type=span_type)], names=schema.names)

    return docs.mapInArrow(run, schema)


def ownership(found: DataFrame) -> DataFrame:
    """``(value, n_repos, n_owners)`` over the whole corpus from rows ``(value, owner, repo)``."""
    holders = found.select("value", "owner", "repo").distinct()
    return holders.groupBy("value").agg(F.count(F.lit(1)).alias("n_repos"), F.count_distinct("owner").alias("n_owners"))


def _listed(spans: Column) -> Column:
    kind = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(kind, s["kind_no"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_secrets(docs: DataFrame, text_col: str = "text", owner_cols: tuple = ("source",),
                 repo_cols: tuple = ("source", "lang"), keep_text: bool = True) -> DataFrame:
    """``docs`` with ``secret_spans``: an array of ``(start, kind_no, end, value, looks_live,
    n_repos, n_owners, live)`` by start, then kind (``KINDS``), offsets in code points with the
    end exclusive. ``live`` marks values that look random and are held by at most
    ``MAX_LIVE_OWNERS`` owners and ``MAX_LIVE_REPOS`` repositories; a repository is told by
    ``repo_cols``, an owner by ``owner_cols``, and nulls there are one unnamed holder.

    Null and empty texts have no spans; repeated rows each get theirs; an empty table gives an
    empty table. A column ``secret_spans`` is replaced, all others are kept, the text only with
    ``keep_text``.
    """
    own = [c for c in docs.columns if c.lower() != "secret_spans"]
    names = {c: f"__own_{i}" for i, c in enumerate(own)}
    src = docs.select(*[quoted(c).alias(n) for c, n in names.items()], quoted(text_col).cast("string").alias("__text"))
    kept = list(names.items()) if keep_text else [(c, n) for c, n in names.items() if c != text_col]
    scan = materialise(_scanned(src, "__text").select(*[n for _, n in kept], "__row", "__found"), "secrets-scan")
    holder = lambda cols: F.xxhash64(*[F.coalesce(F.col(names[c]).cast("string"), F.lit("")) for c in cols])
    found = scan.filter(F.size("__found") > 0).select("__row", holder(owner_cols).alias("owner"),
                                                      holder(repo_cols).alias("repo"), F.inline("__found"))
    counts = materialise(ownership(found), "secrets-owners")
    judged = found.join(counts, "value").withColumn(
        "live", F.col("looks_live") & (F.col("n_owners") <= MAX_LIVE_OWNERS) & (F.col("n_repos") <= MAX_LIVE_REPOS))
    spans = (judged.filter(F.col("live") | (F.col("kind_no") < KINDS.index("live")))
             .groupBy("__row").agg(F.array_sort(F.collect_list(F.struct(
                 "start", "kind_no", "end", "value", "looks_live", "n_repos", "n_owners", "live"))).alias("secret_spans")))
    out = [F.col(n).alias(c) for c, n in kept]
    kind = spans.schema["secret_spans"].dataType
    held = scan.filter(F.size("__found") > 0).join(spans, "__row", "left").select(
        *out, F.coalesce("secret_spans", F.array().cast(kind)).alias("secret_spans"))
    return scan.filter(F.size("__found") == 0).select(*out, F.array().cast(kind).alias("secret_spans")).unionByName(held)


def span_digest(base_only: bool) -> Column:
    """``kind:start:end`` of the spans, comma-joined."""
    spans = F.col("secret_spans")
    live = KINDS.index("live")
    return _listed(F.filter(spans, lambda s: s["kind_no"] < live) if base_only else spans)


def count_kind(kind: str) -> Column:
    k = KINDS.index(kind)
    return F.size(F.filter("secret_spans", lambda s: s["kind_no"] == k)).cast("long")


def redact(docs: DataFrame, text_col: str = "text", owner_cols: tuple = ("source",),
           repo_cols: tuple = ("source", "lang")) -> DataFrame:
    """``docs`` with every reported span replaced by ``[kind]`` (overlapping spans by the first
    one's kind), all in one pass over the text; ``n_chars``, where there is such a column, follows. Texts
    without spans are untouched."""
    kinds = F.array(*[F.lit(f"[{k}]") for k in KINDS])
    copy, new = fresh(docs, "__text"), fresh(docs, "__masked")  # names that no output column has
    found = find_secrets(docs, text_col, owner_cols, repo_cols).withColumn(copy, quoted(text_col))
    text = quoted(copy)
    # (text so far, where it ends) is carried over the spans in order
    start = F.struct(F.lit("").alias("done"), F.lit(0).cast("long").alias("at"))
    step = lambda acc, s: F.struct(
        F.when(s["start"] >= acc["at"], F.concat(acc["done"], F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")),
                                                 F.element_at(kinds, s["kind_no"] + 1))).otherwise(acc["done"]).alias("done"),
        F.greatest(acc["at"], s["end"]).alias("at"))
    folded = F.aggregate("secret_spans", start, step, lambda acc: F.concat(
        acc["done"], F.substring(text, (acc["at"] + 1).cast("int"), F.length(text))))
    untouched = F.size("secret_spans") == 0
    masked = found.withColumn(new, F.when(untouched, text).otherwise(folded))
    cols = []
    for c in docs.columns:
        if c == text_col:
            cols.append(quoted(new).alias(c))
        elif c == "n_chars":
            cols.append(F.when(untouched, quoted(c)).otherwise(F.length(quoted(new)).cast(docs.schema[c].dataType)).alias(c))
        elif c.lower() != "secret_spans":
            cols.append(quoted(c))
    return masked.select(*cols)
