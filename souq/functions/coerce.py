"""PHP-style input coercion (X-11) and emptiness (T-11)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from souq.functions._col import as_col

# Leading whitespace PHP skips before a numeric prefix.
_WS = "[ \\t\\n\\r\\u000B\\f]*"
_INT_PREFIX = "^" + _WS + "([+-]?[0-9]+)"
_FLOAT_PREFIX = "^" + _WS + "([+-]?([0-9]+(\\.[0-9]*)?|\\.[0-9]+)([eE][+-]?[0-9]+)?)"


def php_empty(c: Column | str) -> Column:
    """PHP ``empty()`` for a string value: NULL, ``''`` and ``'0'`` are empty."""
    c = as_col(c)
    return c.isNull() | (c == "") | (c == "0")


# PHP trim()'s character set: space, tab, LF, CR, NUL, VT.
_TRIMMED = "[ \\t\\n\\r\\u0000\\u000B]*"


def php_blank(c: Column | str) -> Column:
    """``empty(trim(x))`` (and so ``empty(htmlspecialchars(trim(x)))``) without building
    the trimmed text: NULL, only trim characters, or a lone ``0`` between them.

    The anchored pattern fails at the first other character, so long texts
    cost almost nothing.
    """
    c = as_col(c)
    return c.isNull() | c.rlike("^" + _TRIMMED + "0?" + _TRIMMED + "\\z")


def to_int_prefix(c: Column | str) -> Column:
    """``intval``: the leading integer, 0 when there is none (never raises).

    A leading number with an exponent (``"1e3"``) converts through its float
    value, as PHP does; plain digits are parsed exactly as integers.
    """
    text = as_col(c).cast("string")
    digits = F.regexp_extract(text, _INT_PREFIX, 1)
    number = F.regexp_extract(text, _FLOAT_PREFIX, 1)
    via_float = F.when(number.rlike("[eE]"), number.try_cast("double").try_cast("bigint"))
    # beyond 64 bits PHP saturates
    limit = F.when(digits.contains("-"), F.lit(-2**63)).otherwise(F.lit(2**63 - 1))
    return F.coalesce(via_float, digits.try_cast("bigint"),
                      F.when(F.length(digits) > 18, limit), F.lit(0).cast("bigint"))


def to_float_prefix(c: Column | str) -> Column:
    """``floatval``: the leading decimal number, 0.0 when there is none."""
    num = F.regexp_extract(as_col(c).cast("string"), _FLOAT_PREFIX, 1)
    return F.coalesce(num.try_cast("double"), F.lit(0.0))
