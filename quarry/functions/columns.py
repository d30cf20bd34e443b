"""Column builders for scalar jobs: dates, contacts, masking, report formatting, ids, ages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# Date formats tried in this order (Python strptime equivalents:
# %Y-%m-%d, %m/%d/%Y, %d/%m/%Y, %Y-%m-%d %H:%M:%S, %m/%d/%Y %H:%M:%S, %B %d, %Y, %d %B %Y).
DATE_FORMATS = ["yyyy-M-d", "M/d/yyyy", "d/M/yyyy", "yyyy-M-d H:m:s", "M/d/yyyy H:m:s",
                "MMMM d, yyyy", "d MMMM yyyy"]


def parse_date_multi(c, formats=None) -> Column:
    """First format that parses the whole text wins; null when none does."""
    formats = formats or DATE_FORMATS
    return F.coalesce(*[F.to_date(F.try_to_timestamp(_c(c), F.lit(f))) for f in formats])


def matched_format(c, formats=None) -> Column:
    formats = formats or DATE_FORMATS
    expr = None
    for f in formats:
        cond = F.try_to_timestamp(_c(c), F.lit(f)).isNotNull()
        expr = F.when(cond, F.lit(f)) if expr is None else expr.when(cond, F.lit(f))
    return expr


# E-mail patterns (strict and loose).
EMAIL_STRICT = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"
EMAIL_LOOSE = r"^[\p{L}\p{N}_.-]+@[\p{L}\p{N}_.-]+\.[\p{L}\p{N}_]+$"


def email_valid(c, pattern: str = EMAIL_STRICT) -> Column:
    return F.coalesce(_c(c).rlike(pattern), F.lit(False))


def phone_digits(c) -> Column:
    return F.length(F.regexp_replace(_c(c), r"\D", "")).cast("long")


def phone_valid(phone, country) -> Column:
    """US: exactly 10 digits; VN: 9 to 11; anything else: 7 to 15."""
    n = phone_digits(phone)
    cc = _c(country)
    return (F.when(cc == "US", n == 10)
            .when(cc == "VN", n.between(9, 11))
            .otherwise(n.between(7, 15)))


def mask(c, mask_char: str = "*", visible: int = 4) -> Column:
    """All but the last ``visible`` chars masked; strings not longer than that fully masked."""
    s = _c(c)
    n = F.length(s)
    return (F.when(n <= visible, F.repeat(F.lit(mask_char), n))
            .otherwise(F.concat(F.repeat(F.lit(mask_char), n - visible), F.right(s, F.lit(visible)))))


# Currency symbols.
CURRENCY_SYMBOLS = {"USD": "$", "EUR": "€", "GBP": "£", "JPY": "¥", "VND": "₫"}


def format_currency(amount, currency) -> Column:
    """USD/EUR/GBP (and unknown codes, shown as prefix) with 2 decimals and thousands
    separators; JPY without decimals; VND without decimals and with the symbol as suffix."""
    a = _c(amount)
    cur = _c(currency)
    sym = F.coalesce(F.element_at(F.create_map(*[x for kv in CURRENCY_SYMBOLS.items()
                                                 for x in (F.lit(kv[0]), F.lit(kv[1]))]),
                                  cur), cur)
    return (F.when(cur == "JPY", F.concat(sym, F.format_number(a, 0)))
            .when(cur == "VND", F.concat(F.format_number(a, 0), F.lit(" "), sym))
            .otherwise(F.concat(sym, F.format_number(a, 2))))


# Size units, 1024 apart.
SIZE_UNITS = ["B", "KB", "MB", "GB", "TB"]


def format_file_size(size_bytes) -> Column:
    """1024 steps up to TB, one decimal (half-even), '0 B' for zero."""
    b = _c(size_bytes).cast("double")
    expr = F.when(b == 0, F.lit("0 B"))
    for i, unit in enumerate(SIZE_UNITS):
        lo = 1024.0 ** i
        hi = 1024.0 ** (i + 1)
        val = F.bround(b / F.lit(lo), 1).cast("decimal(38,1)").cast("string")
        cond = (b < hi) if i < len(SIZE_UNITS) - 1 else F.lit(True)
        if i > 0:
            cond = cond & (b >= lo)
        expr = expr.when(cond, F.concat(val, F.lit(" " + unit)))
    return expr


def truncate(c, max_length: int, suffix: str = "...") -> Column:
    s = _c(c)
    eff = max_length - len(suffix)
    cut = F.lit(suffix[:max_length]) if eff <= 0 else F.concat(F.substring(s, 1, eff), F.lit(suffix))
    return F.when(F.length(s) <= max_length, s).otherwise(cut)


def age_years(birth, ref) -> Column:
    """Whole years: year difference minus one when (month, day) of ``ref`` is before birth's."""
    b, r = _c(birth), _c(ref)
    before = (F.month(r) < F.month(b)) | ((F.month(r) == F.month(b)) & (F.dayofmonth(r) < F.dayofmonth(b)))
    return F.year(r) - F.year(b) - F.when(before, 1).otherwise(0)


def surrogate_id(key, prefix: str = "", length: int = 8) -> Column:
    """Stable id: prefix + '_' + first ``length`` hex chars of sha256(key) (re-runs agree)."""
    h = F.substring(F.sha2(_c(key).cast("string"), 256), 1, length)
    return F.concat(F.lit(prefix + "_"), h) if prefix else h


def stamped_id(prefix: str, at, key) -> Column:
    """Time-stamped id: prefix, second of ``at``, and a number below 10,000 from the key's hash."""
    number = F.pmod(F.conv(F.substring(F.md5(_c(key).cast("string")), 1, 8), 16, 10).cast("long"), F.lit(10_000))
    return F.concat_ws("_", F.lit(prefix), F.date_format(_c(at), "yyyyMMdd_HHmmss"), number.cast("string"))


def random_id(prefix: str = "", length: int = 8) -> Column:
    h = F.substring(F.regexp_replace(F.uuid(), "-", ""), 1, length)
    return F.concat(F.lit(prefix + "_"), h) if prefix else h


# Tags kept by the HTML clean-up.
ALLOWED_TAGS = ["b", "i", "u", "em", "strong"]


def sanitize_html(c, allowed=None) -> Column:
    """Strip every tag except the allowed ones (text kept), then squeeze whitespace.

    Allowed tags are rebuilt without their attributes; comments and other tags go, also where
    they are never closed; angle brackets that are left over are escaped.
    """
    for pattern, by in sanitize_steps(allowed or ALLOWED_TAGS):
        c = F.regexp_replace(_c(c), pattern, by)
    return F.trim(c)


def sanitize_steps(allowed: list[str], group: str = "$") -> list[tuple[str, str]]:
    """The replacements of the clean-up in order, without look-ahead: allowed tags are set aside
    between two control characters (which the text itself loses first) while the rest goes.
    ``group`` is how the regex engine refers to a group."""
    keep = "|".join(allowed)
    return [("[\\x{01}\\x{02}]", ""), (r"(?s)<!--.*?(?:-->|$)", ""),
            (rf"(?is)<(/?(?:{keep}))(?:[\s/][^>]*)?>", f"\x01{group}1\x02"),
            (r"(?is)</?[a-z!?][^>]*(?:>|$)", ""), ("<", "&lt;"), (">", "&gt;"), ("\x01", "<"), ("\x02", ">"), (r"\s+", " ")]
