"""Column builders for text: whitespace, case, normalisation, hashing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_ws(c) -> Column:
    """Strip leading/trailing whitespace of every kind (``trim`` strips spaces only)."""
    return F.regexp_replace(_c(c), r"^\s+|\s+$", "")


def titlecase(c) -> Column:
    """Whitespace-stripped, title-cased text (first letter of each space-separated word)."""
    return F.initcap(strip_ws(c))


def lower_strip(c) -> Column:
    return F.lower(strip_ws(c))


def content_hash(c, algorithm: str = "sha256") -> Column:
    algorithm = algorithm.lower()
    if algorithm == "md5":
        return F.md5(_c(c))
    if algorithm == "sha1":
        return F.sha1(_c(c))
    if algorithm == "sha256":
        return F.sha2(_c(c), 256)
    raise ValueError(f"unsupported hash algorithm: {algorithm}")


# The whitespace set of Python's str.split(), as a regex class valid in both
# Java regex and RE2.
WS_CLASS = (r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}"
            r"\x{202f}\x{205f}\x{3000}]")


# What is neither a letter or digit of any script, nor an underscore, nor white space; valid in
# Java regex and RE2.
NO_WORD_CLASS = r"[^\p{L}\p{N}_" + WS_CLASS[1:]


def normalize_text(c) -> Column:
    """Lower-case, drop every char that is neither word char nor whitespace (both in the Unicode
    sense), squeeze blanks."""
    kept = F.regexp_replace(F.lower(_c(c)), NO_WORD_CLASS, "")
    return F.trim(F.regexp_replace(kept, f"{WS_CLASS}+", " "))


# the members of WS_CLASS outside Java's \s, mapped to a blank before a plain \s+ split
# (a per-char translate is ~3x cheaper than splitting on the full Unicode class)
_EXTRA_WS = ("\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200b))
             + "\u2028\u2029\u202f\u205f\u3000")


def word_array(c) -> Column:
    """Words of a text split on whitespace runs (Python ``str.split()``), blanks removed."""
    unified = F.translate(_c(c), _EXTRA_WS, " " * len(_EXTRA_WS))
    return F.filter(F.split(unified, r"\s+"), lambda w: w != F.lit(""))


def word_count(c) -> Column:
    return F.size(word_array(c))


def contains_any(c, words) -> Column:
    """True when the text contains any of ``words`` as a substring (not a word match)."""
    col = _c(c)
    cond = F.lit(False)
    for w in words:
        cond = cond | col.contains(w)
    return cond


def first_matching_label(c, rules, default: str) -> Column:
    """Ordered substring rules ``[(label, [words...]), ...]`` → first label whose words match."""
    out = None
    for label, words in rules:
        cond = contains_any(c, words)
        out = F.when(cond, F.lit(label)) if out is None else out.when(cond, F.lit(label))
    return F.lit(default) if out is None else out.otherwise(F.lit(default))
