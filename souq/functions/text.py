"""Text rules (X-06 .. X-10, X-12, X-15) as JVM-side expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from souq.functions._col import as_col

# Characters PHP trim() removes by default: space, tab, LF, CR, NUL, VT.
_PHP_TRIM_CLASS = "[ \\t\\n\\r\\u0000\\u000B]"


def php_trim(c: Column | str) -> Column:
    return F.regexp_replace(as_col(c), "^" + _PHP_TRIM_CLASS + "+|" + _PHP_TRIM_CLASS + "+$", "")


def html_escape(c: Column | str) -> Column:
    """X-08 ``htmlspecialchars(trim(s), ENT_QUOTES)``; ``&`` is replaced first."""
    s = php_trim(c)
    s = F.replace(s, F.lit("&"), F.lit("&amp;"))
    s = F.replace(s, F.lit("<"), F.lit("&lt;"))
    s = F.replace(s, F.lit(">"), F.lit("&gt;"))
    s = F.replace(s, F.lit('"'), F.lit("&quot;"))
    return F.replace(s, F.lit("'"), F.lit("&#039;"))


def slugify(c: Column | str) -> Column:
    """X-07 generate_slug: runs of ``[^a-zA-Z0-9-]`` become ``-``, trim ``-``, lower.

    Existing hyphens are not collapsed (``a - b`` gives ``a---b``).
    """
    return F.lower(F.btrim(F.regexp_replace(as_col(c), "[^a-zA-Z0-9-]+", "-"), F.lit("-")))


def truncate_text(c: Column | str, length: int = 100, append: str = "...") -> Column:
    """X-06 truncate_text with the source's byte semantics.

    Unchanged if the UTF-8 length fits; otherwise keep the first ``length``
    bytes, back up to the last space and append.  Cutting bytes may split a
    character, but the split character always lies after the last space, so
    repairing the tail (``make_valid_utf8``) never changes the result.
    """
    t = as_col(c)
    head = F.make_valid_utf8(F.substring(F.encode(t, "UTF-8"), 1, int(length)).cast("string"))
    cut = F.regexp_extract(head, "(?s)^(.*) ", 1)
    return F.when(t.isNull(), F.lit(None).cast("string")) \
            .when(F.octet_length(t) <= int(length), t) \
            .otherwise(F.concat(cut, F.lit(append)))


# Approximation of PHP's FILTER_VALIDATE_EMAIL (T-08): dot-atom local part
# without leading, trailing or doubled dots, and a dotted host name whose
# labels start and end with a letter or digit.
EMAIL_PATTERN = (
    "^(?!\\.)(?!.*\\.\\.)[A-Za-z0-9!#$%&'*+/=?^_`{|}~.-]{1,64}(?<!\\.)"
    "@[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?"
    "(?:\\.[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?)+\\z"
)


def is_valid_email(c: Column | str) -> Column:
    """X-09 email validity (NULL counts as invalid)."""
    return F.coalesce(as_col(c).rlike(EMAIL_PATTERN), F.lit(False))


def is_digits(c: Column | str) -> Column:
    """X-10 ``preg_match('/^[0-9]+$/')``: a final line feed is allowed (NULL counts as no match)."""
    return F.coalesce(as_col(c).rlike("^[0-9]+\\n?\\z"), F.lit(False))


def date_label(c: Column | str) -> Column:
    """X-12 PHP ``date('M j, Y')``, e.g. ``Jan 5, 2024``."""
    return F.date_format(as_col(c), "MMM d, yyyy")


def upload_name(file_name: Column | str, epoch: Column | None = None) -> Column:
    """X-15 ``time() . '_' . str_replace(' ', '_', name)`` (string only, no file I/O)."""
    epoch = F.unix_timestamp() if epoch is None else epoch
    return F.concat(epoch.cast("string"), F.lit("_"), F.replace(as_col(file_name), F.lit(" "), F.lit("_")))
