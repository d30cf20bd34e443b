"""The registered queries of this subpackage: each applies one operator, with production
parameters, to its whole table and derives the digest columns of its contract."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import (cross_align, decontaminate, hard_negatives, html_wrappers, multi_index, packing, piece_bpe, secret_scan,
                        shard_table, simhash, token_count, toxicity, url_filter)
from quarry.session import ship_package

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn
    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """Folder of the public tokenizer files: ``QUARRY_TOKENIZERS``, else the installed package's."""
    folder = os.environ.get("QUARRY_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


_LOWER = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_WORDS = "regexp_extract_all(" + _LOWER + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP2_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS.format('text')} AS w FROM documents),
b AS (SELECT item_id, {_WORDS.format('text')} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 13) AS k,
               unnest(list_transform(range(1, greatest(len(w) - 12, 1) + 1),
                                     lambda i: array_to_string(w[i:i + 12], ' '))) AS win
        FROM b WHERE len(w) > 0),
ks AS (SELECT DISTINCT k FROM win),
dw AS (SELECT r, k, unnest(range(1, len(w) - k + 2)) AS i, w FROM d, ks WHERE len(w) >= k),
hits AS (SELECT dw.r, dw.i, dw.k, win.item_id FROM dw JOIN win ON win.k = dw.k AND win.win = array_to_string(dw.w[dw.i:dw.i + dw.k - 1], ' ')),
pos AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT r, i, k FROM hits)) GROUP BY r),
items AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS varchar), ',' ORDER BY CAST(item_id AS varchar)) AS ids FROM hits GROUP BY r)
SELECT doc_id, CAST(len(w) AS bigint) AS n_words, CAST(coalesce(n_hit, 0) AS bigint) AS n_hit,
       CAST(coalesce(n_items, 0) AS bigint) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN pos USING (r) LEFT JOIN items USING (r)
"""


@query("op2_benchmark_decontamination", OP2_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_hits(table(spark, sf_dir, "documents").select("doc_id", "text"),
                                    table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("hit_items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"),
                        decontaminate.contaminated().alias("contaminated"))


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


def _op3_sql() -> str:
    """Places of matches from the texts between them. Letters in either case are spelled out, since
    the engine's own folding knows more letters than A-Z."""
    names = "|".join(map(_either_case, ("password", "passwd", "secret", "token", "api"))) + "_?" + _either_case("key")
    assign = "(" + names + """)["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
    kinds = [(0, assign, f"regexp_extract(m, '{assign}', 2)", "length(v) >= 6"), (1, "AKIA[A-Z0-9]+", "m", "length(v) >= 20"),
             (2, "[0-9a-f]{24,}", "m", "true"),
             (3, "[A-Za-z0-9+/_=-]{20,}", "m", "regexp_matches(v, '[A-Z]') AND regexp_matches(v, '[a-z]') AND regexp_matches(v, '[0-9]') AND looks")]
    found = "\nUNION ALL ".join(
        f"SELECT r, {k} AS kind, g, ms, i FROM (SELECT r, regexp_split_to_array(t, '{p}') AS g, regexp_extract_all(t, '{p}') AS ms FROM d WHERE regexp_matches(t, '{p}')), "
        f"unnest(range(1, len(ms) + 1)) AS u(i)" for k, p, _, _ in kinds)
    value = "CASE kind " + " ".join(f"WHEN {k} THEN {v}" for k, _, v, _ in kinds) + " END"
    keep = " OR ".join(f"kind = {k} AND {c}" for k, _, _, c in kinds)
    names_sql = "CASE kind " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(secret_scan.KINDS)) + " END"
    said = f"string_agg({names_sql} || ':' || CAST(start AS VARCHAR) || ':' || CAST(stop AS VARCHAR), ',' ORDER BY start, kind)"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, coalesce(source, '') AS owner, coalesce(lang, '') AS lang FROM documents),
found AS ({found}),
placed AS (SELECT r, kind, ms[i] AS m, CAST(list_sum(list_transform(g[:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[:i - 1], lambda x: length(x))), 0) AS BIGINT) AS start FROM found),
valued AS (SELECT *, start + length(m) AS stop, {value} AS v FROM placed),
seen AS (SELECT v, list_sum(list_transform(list_distinct(string_split(v, '')), lambda c:
    -(len(list_filter(string_split(v, ''), lambda x: x = c)) / length(v)) * log2(len(list_filter(string_split(v, ''), lambda x: x = c)) / length(v)))) >= {secret_scan.LIVE_BITS}
    AND NOT regexp_matches(v, '(?i){secret_scan.PLACEHOLDERS.pattern}') AS looks FROM (SELECT DISTINCT v FROM valued)),
kept AS (SELECT valued.*, looks FROM valued JOIN seen USING (v) WHERE {keep}),
cands AS (SELECT * FROM kept a WHERE kind < 3 OR NOT EXISTS (SELECT 1 FROM kept b WHERE b.r = a.r AND b.kind < 3 AND b.start < a.stop AND a.start < b.stop)),
held AS (SELECT v, count(DISTINCT owner) AS owners, count(DISTINCT (owner, lang)) AS repos FROM cands JOIN d USING (r) GROUP BY v),
judged AS (SELECT cands.*, looks AND owners <= {secret_scan.MAX_LIVE_OWNERS} AND repos <= {secret_scan.MAX_LIVE_REPOS} AS live FROM cands JOIN held USING (v)),
spans AS (SELECT * FROM judged WHERE kind < 3 OR live),
per AS (SELECT r, count_if(kind = 0) AS n_assign, count_if(kind = 1) AS n_access, count_if(kind = 2) AS n_hex, count_if(live) AS n_live,
  {said} FILTER (kind < 3) AS base, {said} AS spans FROM spans GROUP BY r)
SELECT doc_id, CAST(coalesce(n_assign, 0) AS BIGINT) AS n_assign, CAST(coalesce(n_access, 0) AS BIGINT) AS n_access, CAST(coalesce(n_hex, 0) AS BIGINT) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, CAST(coalesce(n_live, 0) AS BIGINT) AS n_live
FROM d LEFT JOIN per USING (r)
"""


@query("op3_secret_scan", _op3_sql())
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang"),
                                     keep_text=False)
    counts = [secret_scan.count_kind(k).alias(f"n_{k}") for k in ("assign", "access", "hex")]
    return found.select("doc_id", *counts, F.sha2(secret_scan.span_digest(True), 256).alias("base_sha256"),
                        secret_scan.span_digest(False).alias("spans"),
                        F.size(F.filter("secret_spans", lambda s: s["live"])).cast("long").alias("n_live"))


@query("op7_simhash_near_dedup")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, radius=2)
    return found.select(F.col("id").alias("doc_id"), "fingerprint", "component_id")


@query("op10_best_fit_packing")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


@query("op5_toxicity")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (toxicity.fold("doc_id") == 0).alias("held_out"), "score",
                         F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
             ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def _fits(host: str, path: str) -> str:
    return f"((host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}'))"


def _op1_sql() -> str:
    by_length = sorted(URL_RULES, key=lambda r: -len(r[0] + r[1]))
    rule = "CASE " + " ".join(f"WHEN {_fits(h, p)} THEN '{h + p}'" for h, p, _ in by_length) + " END"
    verdict = "CASE " + " ".join(f"WHEN {_fits(h, p)} THEN '{v}'" for h, p, v in by_length) + " END"
    lo, hi = url_filter.STRENGTH

    def strength(level: str) -> str:
        return (f"(SELECT CASE WHEN g = 0 OR fr = 0 THEN {lo} WHEN sp <= g THEN {hi} "
                f"ELSE least({hi}, greatest({lo}, (1 - (sp - g) / fr) / ((sp - g) / fr))) END FROM (SELECT count(*) AS g, "
                f"coalesce(sum(n - 1), 0) AS fr, sum(n * power(k / n - mu, 2) / greatest(mu * (1 - mu), 1e-6)) AS sp FROM {level} WHERE n > 0))")
    second = ", ".join(f"'{x}'" for x in url_filter.SECOND_LEVEL)
    return f"""
WITH u AS (SELECT page_id,
  translate(coalesce(regexp_extract(url, '(?s)://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  coalesce(regexp_extract(url, '(?s)://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
r AS (SELECT *, {rule} AS rule, {verdict} AS ruled FROM u),
h0 AS (SELECT host, string_split(host, '.') AS l, count(ruled) AS n, count(*) FILTER (ruled = 'block') AS k FROM r GROUP BY host),
h1 AS (SELECT host, n, k, array_to_string(l[greatest(1, len(l) - CASE WHEN len(l) >= 3 AND length(l[len(l)]) = 2
  AND l[len(l) - 1] IN ({second}) THEN 2 ELSE 1 END):], '.') AS domain FROM h0),
h2 AS (SELECT *, CASE WHEN strpos(domain, '.') > 0 THEN substr(domain, strpos(domain, '.') + 1) ELSE domain END AS suffix FROM h1),
tot AS (SELECT (coalesce(sum(k), 0) + 0.5::double) / (coalesce(sum(n), 0) + 1) AS mu FROM h2),
s0 AS (SELECT suffix, sum(n) AS n, sum(k) AS k, any_value(mu) AS mu FROM h2, tot GROUP BY suffix),
s1 AS (SELECT suffix, (k + st * mu) / (n + st) AS mean FROM s0, (SELECT {strength('s0')} AS st)),
d0 AS (SELECT domain, sum(n) AS n, sum(k) AS k, any_value(mean) AS mu FROM h2 JOIN s1 USING (suffix) GROUP BY domain, suffix),
d1 AS (SELECT domain, (k + st * mu) / (n + st) AS mean FROM d0, (SELECT {strength('d0')} AS st)),
e0 AS (SELECT host, n, k, mean AS mu FROM h2 JOIN d1 USING (domain)),
e1 AS (SELECT host, n, k + st * mu AS a, n - k + st * (1 - mu) AS b FROM e0, (SELECT {strength('e0')} AS st)),
e2 AS (SELECT host, n AS n_outcomes, round(a / (a + b), 6) AS bad_mean,
  round(a / (a + b) - {url_filter.Z} * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))), 6) AS bad_bound FROM e1)
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN bad_bound > {url_filter.BLOCK_ABOVE} THEN 'block' ELSE 'allow' END) AS verdict,
  CAST(n_outcomes AS bigint) AS n_outcomes, bad_mean, bad_bound FROM r JOIN e2 USING (host)
"""


@query("op1_url_filter", _op1_sql())
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES).drop("url")


SHARDS = [f"shard-{i:04d}" for i in range(256)]


@query("op6_shard_table")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_table.place(table(spark, sf_dir, "documents").select("doc_id"), ["doc_id"], SHARDS)


@query("op9_token_counts")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_count.count_tokens(docs, tokenizer_path("piece_bpe_32k.model")).drop("text")


OP4_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS double[]) AS e FROM embeddings),
ok AS (SELECT vec_id, e FROM v WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
       AND len(list_filter(e, lambda x: x <> 0)) > 0),
link AS (SELECT a.vec_id AS u, b.vec_id AS w FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
         WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
walk(u, w) AS (SELECT vec_id, vec_id FROM v UNION SELECT walk.u, link.w FROM walk JOIN link ON link.u = walk.w),
comp AS (SELECT u AS vec_id, min(w) AS component_id FROM walk GROUP BY u),
deg AS (SELECT u AS vec_id, count(*) AS n FROM link GROUP BY u)
SELECT v.vec_id, CAST(coalesce(deg.n, 0) AS bigint) AS n_links, comp.component_id, v.vec_id = comp.component_id AS kept
FROM v JOIN comp USING (vec_id) LEFT JOIN deg USING (vec_id)
"""


@query("op4_embedding_near_dedup", OP4_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.near_duplicates(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


@query("op8_html_extraction")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_wrappers.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))


@query("op11_sentencepiece")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_path("piece_bpe_32k.model")
    ids = piece_bpe.encode_pieces(table(spark, sf_dir, "documents").select("doc_id", "text"), path).drop("text")
    said = F.array_join(F.col("piece_ids").cast("array<string>"), ",")
    return piece_bpe.decode_pieces(ids, path).select(
        "doc_id", F.size("piece_ids").cast("long").alias("n_tokens"), F.sha2(said, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


OP12_SQL = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
  list_transform(embedding, lambda x: CAST(x AS double) * 256) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND vec_id IS NOT NULL),
q AS (SELECT r, vec_id, label, list_transform(e, lambda x: floor(x)) AS e FROM v WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.r AS a, a.vec_id AS anchor_id, b.r AS b, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_inner_product(a.e, b.e) AS bigint) AS score
  FROM q a JOIN q b ON a.r <> b.r AND len(a.e) = len(b.e) WHERE a.vec_id % 50 = 0),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, other_id, b) <= 5)
SELECT p.anchor_id, p.other_id AS positive_id,
  CAST(row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.other_id, s.b) AS integer) AS rank,
  s.other_id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.a = p.a AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
QUALIFY row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.other_id, s.b) <= 3
"""


@query("op12_hard_negatives", OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, label=label)


@query("op13_cross_tokenizer_alignment")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_align.align(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"),
                             keep_groups=False)
