"""Document jobs: overlapping word chunks, metadata, chunk records, collection routing,
encode-once with a text-hash cache, token streams, keyword search, key/value reports.

Every text is processed whole; chunking is array arithmetic inside one row, so a document
of any length is one task-local computation and chunks come out by ``posexplode``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import first_matching_label, word_array
from quarry.sources import store

# Chunking defaults.
CHUNK_SIZE = 512
CHUNK_OVERLAP = 50

# Document type by ordered keyword sets (substring match on lower-cased text).
DOC_TYPE_RULES = [
    ("policy", ["policy", "procedure", "handbook"]),
    ("financial", ["budget", "financial", "expense"]),
    ("hr", ["employee", "hr", "human resources"]),
]
DOC_TYPE_DEFAULT = "general"

# Collection by document type.
COLLECTION_RULES = [
    ("hr_documents", ["hr", "human_resources"]),
    ("finance_documents", ["finance", "financial"]),
]
COLLECTION_DEFAULT = "general_documents"
COLLECTIONS = ["hr_documents", "finance_documents", "general_documents"]


def chunk_starts(n: Column, size: int, overlap: int) -> Column:
    """Start offsets i = 0, step, 2·step, … up to the first i with i + size ≥ n (n > 0)."""
    step = size - overlap
    last = F.greatest(F.lit(0), F.ceil((n - F.lit(size)) / F.lit(step))) * F.lit(step)
    return F.when(n > 0, F.sequence(F.lit(0), last.cast("int"), F.lit(step))).otherwise(
        F.array().cast("array<int>"))


def chunk_text(df: DataFrame, text_col: str, keep: list[str], size: int = CHUNK_SIZE,
               overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """One row per chunk: ``chunk_index``, ``chunk_text`` (words joined by one blank) and
    ``total_chunks``. Words are whitespace-separated tokens of the whole text.

    The word array is bound once as a lambda variable (wrapped in a one-element array), so
    the optimizer cannot inline the split into every chunk's slice: each text is split once.
    """
    if not 0 <= overlap < size:
        raise ValueError("overlap must be in [0, size)")

    def chunks_of(w):
        return F.transform(chunk_starts(F.size(w), size, overlap),
                           lambda s: F.array_join(F.slice(w, s + 1, size), " "))
    chunks = df.select(*keep, F.transform(F.array(word_array(text_col)), chunks_of)[0].alias("__chunks"))
    return chunks.select(*keep, F.size("__chunks").cast("long").alias("total_chunks"),
                         F.posexplode("__chunks").alias("__i", "chunk_text")).select(
        *keep, "total_chunks", F.col("__i").cast("long").alias("chunk_index"), "chunk_text")


def doc_type(text: Column) -> Column:
    return first_matching_label(F.lower(text), DOC_TYPE_RULES, DOC_TYPE_DEFAULT)


def doc_metadata(df: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    t = F.col(text_col)
    return df.select(*keep, F.size(word_array(t)).cast("long").alias("word_count"),
                     F.length(t).cast("long").alias("char_count"), doc_type(t).alias("document_type"))


def collection_for(type_col: Column) -> Column:
    out = None
    for coll, types in COLLECTION_RULES:
        cond = type_col.isin(types)
        out = F.when(cond, coll) if out is None else out.when(cond, coll)
    return out.otherwise(COLLECTION_DEFAULT)


def chunk_records(docs: DataFrame, id_col: str, text_col: str, filename: Column,
                  caller_meta: dict[str, Column], size: int = CHUNK_SIZE,
                  overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """Chunks with metadata = base (filename, counts, type) ⊕ caller metadata (caller wins)
    ⊕ chunk_index/total_chunks, id '<filename>_<i>', and the collection of the type.

    Metadata and chunks come from the same row in one projection (no join back of chunk
    texts to per-document metadata), so the only data movement is the scan itself.
    """
    t = F.col(text_col)

    def chunks_of(w):
        return F.transform(chunk_starts(F.size(w), size, overlap),
                           lambda s: F.array_join(F.slice(w, s + 1, size), " "))
    per_doc = docs.select(
        id_col, filename.alias("filename"), *[c.alias(f"__m_{k}") for k, c in caller_meta.items()],
        F.transform(F.array(word_array(t)), lambda w: F.struct(
            F.size(w).alias("wc"), chunks_of(w).alias("chunks")))[0].alias("__x"),
        F.length(t).alias("char_count"), doc_type(t).alias("document_type"))
    exploded = per_doc.select(
        "*", F.size("__x.chunks").cast("long").alias("total_chunks"),
        F.posexplode("__x.chunks").alias("__i", "chunk_text")).withColumns(
        {"word_count": F.col("__x.wc").cast("long"), "chunk_index": F.col("__i").cast("long")})
    base_map = F.create_map(
        F.lit("filename"), F.col("filename"),
        F.lit("word_count"), F.col("word_count").cast("string"),
        F.lit("char_count"), F.col("char_count").cast("string"),
        F.lit("document_type"), F.col("document_type"))
    caller_map = F.create_map(*[x for k in caller_meta for x in (F.lit(k), F.col(f"__m_{k}").cast("string"))])
    chunk_map = F.create_map(F.lit("chunk_index"), F.col("chunk_index").cast("string"),
                             F.lit("total_chunks"), F.col("total_chunks").cast("string"))
    return exploded.select(
        F.concat_ws("_", "filename", F.col("chunk_index").cast("string")).alias("chunk_id"),
        id_col, "chunk_index", "total_chunks", "chunk_text", "document_type",
        collection_for(F.col("document_type")).alias("collection"),
        F.map_concat(base_map, caller_map, chunk_map).alias("metadata"))


def chunk_counts(docs: DataFrame, id_col: str, text_col: str, size: int = CHUNK_SIZE,
                 overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """(id, document_type, collection, total_chunks) without building any chunk text."""
    t = F.col(text_col)
    typ = doc_type(t)
    return docs.select(id_col, typ.alias("document_type"),
                       F.size(chunk_starts(F.size(word_array(t)), size, overlap)).alias("total_chunks")
                       ).withColumn("collection", collection_for(F.col("document_type")))


def encode_once(docs: DataFrame, id_col: str, text_col: str, cache: DataFrame, encoder) -> DataFrame:
    """Encode each distinct text once: texts whose hash is in ``cache`` (text_hash, embedding)
    are reused, the remaining distinct texts go through ``encoder`` (a DataFrame → DataFrame
    function adding ``embedding``), and the vectors are joined back to every row."""
    hashed = docs.select(id_col, F.sha2(F.col(text_col), 256).alias("text_hash"), text_col)
    distinct = hashed.dropDuplicates(["text_hash"])
    todo = distinct.join(cache.select("text_hash"), "text_hash", "left_anti")
    fresh = encoder(todo).select("text_hash", "embedding", F.lit(False).alias("from_cache"))
    known = cache.select("text_hash", "embedding", F.lit(True).alias("from_cache"))
    vectors = known.unionByName(fresh)
    return hashed.join(vectors, "text_hash", "left").select(id_col, "text_hash", "from_cache", "embedding")


@dataclass
class Encoded:
    """Rows with their vectors, and how many texts had to be encoded for them."""

    rows: DataFrame
    fresh: int


def encode_cached(docs: DataFrame, id_col: str, text_col: str, root: str, encoder, name: str = "encodings") -> Encoded:
    """``encode_once`` against a cache that fills: the table ``name`` of the store ``root``, by the hash of
    the text, in buckets of it. Texts that it has are not encoded; what is new is encoded once and added
    to the buckets it falls into, at once or not at all, so a run that stops has only to be run again.
    A null text has no vector and is not kept; the empty text is a text."""
    spark = docs.sparkSession
    hashed = docs.select(id_col, F.sha2(F.col(text_col), 256).alias("text_hash"), text_col)
    distinct = hashed.filter("text_hash is not null").dropDuplicates(["text_hash"])
    before = 0
    if name in store.tables(spark, root):
        cache = store.read_table(spark, root, name)
        before = cache.count()
        distinct = distinct.join(cache.select("text_hash"), "text_hash", "left_anti")
    fresh = store.load(encoder(distinct).select("text_hash", "embedding"), root, name, ["text_hash"], replace=False) - before
    vectors = store.read_table(spark, root, name)
    return Encoded(hashed.join(vectors, "text_hash", "left").select(id_col, "text_hash", "embedding"), fresh)


def hashing_encoder(dim: int = 64, key: str = "text_hash", text_col: str = "text"):
    """Feature-hashing bag-of-words encoder (unit norm), JVM-side and linear in the text
    length: words are exploded and counted per (key, bucket) with a partial aggregate, then
    the ≤ ``dim`` bucket counts of each key become its vector. A stand-in for a real
    sentence encoder behind the same DataFrame → DataFrame interface, not a semantic model."""
    def enc(df: DataFrame) -> DataFrame:
        buckets = df.select(key, F.explode(word_array(F.lower(text_col))).alias("__w")).select(
            key, F.pmod(F.xxhash64("__w"), F.lit(dim)).cast("int").alias("__b"))
        counts = buckets.groupBy(key, "__b").agg(F.count(F.lit(1)).cast("double").alias("__n"))
        per_key = counts.groupBy(key).agg(
            F.map_from_entries(F.collect_list(F.struct("__b", "__n"))).alias("__m"))
        dense = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)),
                            lambda i: F.coalesce(F.element_at("__m", i), F.lit(0.0)))
        vec = per_key.select(key, dense.alias("__v"))
        norm = F.sqrt(F.aggregate("__v", F.lit(0.0), lambda a, x: a + x * x))
        vec = vec.select(key, F.transform("__v", lambda x: (x / norm).cast("float")).alias("embedding"))
        return df.join(vec, key, "left")
    return enc


def token_stream(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, token, index, total) per whitespace token of the whole text."""
    w = df.select(id_col, word_array(text_col).alias("__w"))
    return w.select(id_col, F.size("__w").cast("long").alias("total"),
                    F.posexplode("__w").alias("__i", "token")).select(
        id_col, "total", F.col("__i").cast("long").alias("index"), "token")


def keyword_search(docs: DataFrame, id_col: str, text_col: str, keywords: list[str],
                   context_chars: int = 60) -> DataFrame:
    """Per keyword: documents searched, documents matching (case-insensitive substring) and
    the excerpt around the first match in the lowest-id matching document."""
    kws = [k.lower() for k in keywords]
    lowered = docs.select(id_col, text_col, F.lower(text_col).alias("__lt"))
    hits = lowered.select(
        id_col, text_col, "__lt",
        F.explode(F.filter(F.array(*[F.lit(k) for k in kws]), lambda k: F.col("__lt").contains(k)))
        .alias("keyword"))
    first = hits.withColumn("__pos", F.instr("__lt", F.col("keyword"))).groupBy("keyword").agg(
        F.count(F.lit(1)).alias("matches"),
        F.min_by(F.struct(F.col(id_col).alias("id"), F.col(text_col).alias("t"), "__pos"),
                 F.col(id_col)).alias("__first"))
    kw_df = docs.sparkSession.createDataFrame([(k,) for k in kws], "keyword string")
    searched = docs.agg(F.count(F.lit(1))).scalar()
    start = F.greatest(F.col("__first.__pos") - context_chars, F.lit(1))
    excerpt = F.substring(F.col("__first.t"), start, F.length("keyword") + 2 * context_chars)
    return kw_df.join(first, "keyword", "left").select(
        "keyword", searched.alias("documents_searched"),
        F.coalesce("matches", F.lit(0)).alias("matches"),
        F.col("__first.id").alias("first_doc_id"), excerpt.alias("excerpt"))


def report_text(tall: DataFrame, group_cols: list[str], title: Column, order_col: str,
                key_col: str, value_col: str, items_col: str | None = None) -> DataFrame:
    """Key/value rows → one text per group: '**Title**' then, in ``order_col`` order, '**Key Name:**
    value', or, for a row whose ``items_col`` (an array of texts, 'name: value' for members) is not
    null, '**Key Name:**' above one bullet line per item. Keys are title-cased with '_' → ' '."""
    key_title = F.initcap(F.regexp_replace(F.col(key_col), "_", " "))
    head = F.concat(F.lit("**"), key_title, F.lit(":**"))
    line = F.concat(head, F.lit(" "), F.coalesce(F.col(value_col), F.lit("None")))
    if items_col:
        bullets = F.transform(F.col(items_col), lambda x: F.concat(F.lit("• "), F.coalesce(x, F.lit("None"))))
        line = F.when(F.col(items_col).isNotNull(), F.array_join(F.concat(F.array(head), bullets), "\n")).otherwise(line)
    grouped = tall.groupBy(*group_cols).agg(
        F.first(title).alias("__title"),
        F.array_sort(F.collect_list(F.struct(F.col(order_col).alias("o"), line.alias("l")))).alias("__lines"))
    body = F.array_join(F.transform("__lines", lambda s: s["l"]), "\n\n")
    return grouped.select(*group_cols, F.concat(F.lit("**"), F.col("__title"), F.lit("**\n\n"), body)
                          .alias("report"))


def type_mix(df: DataFrame, type_col: str) -> DataFrame:
    per = df.groupBy(type_col).agg(F.count(F.lit(1)).alias("documents"))
    return per.select(type_col, "documents",
                      (F.col("documents") / F.sum("documents").over(Window.partitionBy()) * 100)
                      .alias("percent"))
