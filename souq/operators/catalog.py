"""Seller catalog: search, category filter, count and paging
(P-02, P-03, P-05, P-08, J-03, J-06, J-09, A-02, A-05, O-05).

One filtered DataFrame feeds both the count and the page, as in the source
(which sends the same WHERE clause twice).  The per-request form takes a
``business_id``; the batch form computes the same page or count for every
seller in one job, with a windowed top-k that Spark plans as a partial
``WindowGroupLimit`` before the shuffle (each task keeps at most
offset+page_size rows per seller), so a seller holding a third of all
products costs no more shuffle than any other.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from souq.operators.discovery import keys_of
from souq.operators.taxonomy import filter_by_category

PAGE_SIZE = 10          # the seller page shows 10 rows (a configured 12 is never used)

_PHP_TRIM = " \t\n\r\x00\x0b"


def clean_search(search: str | None) -> str:
    """P-08: the search text is trimmed; ``''`` and ``'0'`` mean no search (PHP empty)."""
    s = (search or "").strip(_PHP_TRIM)
    return "" if s in ("", "0") else s


def page_offset(page: int | None, page_size: int = PAGE_SIZE) -> int:
    """Page floor is 1: ``max(1, intval(page))``."""
    p = max(1, int(page or 1))
    return (p - 1) * page_size


def like_pattern(search: str) -> str:
    """``%search%`` with MySQL's default LIKE escaping made explicit.

    ``%`` and ``_`` stay wildcards; ``\\%``, ``\\_`` and ``\\\\`` stay escaped
    literals; a backslash before any other character (which Spark rejects)
    stands for that character, and a trailing backslash for itself.
    """
    out, i = [], 0
    while i < len(search):
        ch = search[i]
        if ch == "\\":
            nxt = search[i + 1] if i + 1 < len(search) else None
            if nxt is None:
                out.append("\\\\")
            elif nxt in "%_\\":
                out.append("\\" + nxt)
            else:
                out.append(nxt)
            i += 2
            continue
        out.append(ch)
        i += 1
    return "%" + "".join(out) + "%"


def _text_match(c: str, search: str, accent_insensitive: bool) -> Column:
    if accent_insensitive:
        return F.coalesce(F.contains(F.collate(F.col(c), "UNICODE_CI_AI"), F.lit(search)), F.lit(False))
    return F.col(c).ilike(like_pattern(search))


def search_predicate(search: str, accent_insensitive: bool = False) -> Column:
    """P-03: ``name LIKE %q% OR description LIKE %q%``.

    Default is ``ilike`` (case-insensitive; ``%`` and ``_`` in ``q`` stay
    wildcards, as the source does not escape them).  ``accent_insensitive``
    compares under the ``UNICODE_CI_AI`` collation with literal containment
    instead, closer to MySQL's general_ci (T-03).
    """
    return _text_match("name", search, accent_insensitive) | \
        _text_match("description", search, accent_insensitive)


def search_products(products: DataFrame, search: str, product_text: DataFrame | None = None,
                    accent_insensitive: bool = False) -> DataFrame:
    """P-03 over products whose description lives in a separate text table.

    The description predicate runs at the text scan and only the ids of
    matching texts are shuffled (deduplicated, map-side first); texts never
    move.  The OR with the name match is then evaluated on the product rows.
    """
    if "description" in products.columns or product_text is None:
        return products.where(search_predicate(search, accent_insensitive))
    hits = product_text.where(_text_match("description", search, accent_insensitive)) \
                       .select("product_id").distinct().withColumn("_text_hit", F.lit(True))
    return products.join(hits, "product_id", "left") \
                   .where(_text_match("name", search, accent_insensitive)
                          | F.coalesce(F.col("_text_hit"), F.lit(False))) \
                   .drop("_text_hit")


def with_text(products: DataFrame, product_text: DataFrame | None) -> DataFrame:
    """Add ``description`` (a left join on product_id) unless it is already there.

    Texts are first reduced to the wanted products (a semi-join, whose small
    side can be broadcast), so the other texts are never shuffled.
    """
    if product_text is None or "description" in products.columns:
        return products
    texts = product_text.select("product_id", "description").join(keys_of(products).distinct(), "product_id", "left_semi")
    return products.join(texts, "product_id", "left")


def catalog_filter(products: DataFrame, categories: DataFrame, *, business_id: int | None = None,
                   search: str | None = "", category: int | None = 0,
                   accent_insensitive: bool = False,
                   product_text: DataFrame | None = None) -> DataFrame:
    """P-02 + P-08 composition: seller, optional search, optional category (J-06).

    The cheap predicates (seller, category) run first; a search reads the
    description texts only to find matching ids (see ``search_products``).
    """
    p = products
    if business_id is not None:
        p = p.where(F.col("business_id") == business_id)
    p = filter_by_category(p, categories, int(category or 0))
    s = clean_search(search)
    if s:
        p = search_products(p, s, product_text, accent_insensitive)
    return p


def with_category_name(products: DataFrame, categories: DataFrame) -> DataFrame:
    """J-03: ``LEFT JOIN categories`` for the label; an unknown category gives NULL."""
    c = categories.select("category_id", "category_name")
    return products.join(c, "category_id", "left")


def _newest() -> list[Column]:
    return [F.desc("created_at"), F.asc("product_id")]


def catalog_page(products: DataFrame, categories: DataFrame, *, business_id: int,
                 search: str | None = "", category: int | None = 0, page: int | None = 1,
                 page_size: int = PAGE_SIZE, accent_insensitive: bool = False,
                 product_text: DataFrame | None = None) -> DataFrame:
    """O-05 for one seller: newest first, ``LIMIT page_size OFFSET (page-1)*page_size``.

    Planned as a single ``TakeOrderedAndProject(limit, offset)``; a page past
    the end is empty.
    """
    f = catalog_filter(products, categories, business_id=business_id, search=search,
                       category=category, accent_insensitive=accent_insensitive,
                       product_text=product_text)
    top = f.orderBy(*_newest()).offset(page_offset(page, page_size)).limit(page_size)
    return with_category_name(with_text(top, product_text), categories).orderBy(*_newest())


def catalog_count(products: DataFrame, categories: DataFrame, *, business_id: int,
                  search: str | None = "", category: int | None = 0, page_size: int = PAGE_SIZE,
                  accent_insensitive: bool = False, product_text: DataFrame | None = None) -> DataFrame:
    """A-02 + A-05 for one seller: (total_products, total_pages)."""
    f = catalog_filter(products, categories, business_id=business_id, search=search,
                       category=category, accent_insensitive=accent_insensitive,
                       product_text=product_text)
    return f.agg(F.count(F.lit(1)).alias("total_products")) \
            .withColumn("total_pages", F.ceil(F.col("total_products") / F.lit(page_size)).cast("bigint"))


def seller_catalog(products: DataFrame, categories: DataFrame, *, business_id: int,
                   search: str | None = "", category: int | None = 0, page: int | None = 1,
                   page_size: int = PAGE_SIZE, accent_insensitive: bool = False,
                   product_text: DataFrame | None = None) -> dict[str, DataFrame]:
    """The seller page request: one filtered plan feeding both the count and the page.

    Returns ``{"count": (total_products, total_pages), "page": rows}``.  The
    two are separate actions over the same lazy filter (the source also runs
    its WHERE clause twice); persist the filter only if measurements say so.
    """
    f = catalog_filter(products, categories, business_id=business_id, search=search,
                       category=category, accent_insensitive=accent_insensitive,
                       product_text=product_text)
    count = f.agg(F.count(F.lit(1)).alias("total_products")) \
             .withColumn("total_pages", F.ceil(F.col("total_products") / F.lit(page_size)).cast("bigint"))
    top = f.orderBy(*_newest()).offset(page_offset(page, page_size)).limit(page_size)
    page_rows = with_category_name(with_text(top, product_text), categories).orderBy(*_newest())
    return {"count": count, "page": page_rows}


def catalog_pages_all(products: DataFrame, categories: DataFrame, *, search: str | None = "",
                      category: int | None = 0, page: int | None = 1, page_size: int = PAGE_SIZE,
                      accent_insensitive: bool = False,
                      product_text: DataFrame | None = None) -> DataFrame:
    """O-05 for every seller at once: the rows each seller sees on ``page``.

    ``page_position`` is the 1-based row on the page.  Without a search the
    description text is joined only to the paged rows.
    """
    f = catalog_filter(products, categories, search=search, category=category,
                       accent_insensitive=accent_insensitive, product_text=product_text)
    off = page_offset(page, page_size)
    w = Window.partitionBy("business_id").orderBy(*_newest())
    ranked = f.withColumn("_rn", F.row_number().over(w))
    paged = ranked.where((F.col("_rn") > off) & (F.col("_rn") <= off + page_size)) \
                  .withColumn("page_position", (F.col("_rn") - off).cast("bigint")).drop("_rn")
    return with_category_name(with_text(paged, product_text), categories)


def catalog_counts_all(businesses: DataFrame, products: DataFrame, categories: DataFrame, *,
                       search: str | None = "", category: int | None = 0, page_size: int = PAGE_SIZE,
                       accent_insensitive: bool = False,
                       product_text: DataFrame | None = None) -> DataFrame:
    """A-02 + A-05 for every seller (sellers without matches get 0 and 0 pages)."""
    f = catalog_filter(products, categories, search=search, category=category,
                       accent_insensitive=accent_insensitive, product_text=product_text)
    counts = f.groupBy("business_id").agg(F.count(F.lit(1)).alias("total_products"))
    out = businesses.select("business_id").join(counts, "business_id", "left") \
        .withColumn("total_products", F.coalesce("total_products", F.lit(0).cast("bigint")))
    return out.withColumn("total_pages",
                          F.ceil(F.col("total_products") / F.lit(page_size)).cast("bigint"))


def total_pages(total: int, page_size: int = PAGE_SIZE) -> int:
    return math.ceil(total / page_size)


def seller_business(users: DataFrame, businesses: DataFrame) -> DataFrame:
    """J-09: every business owner with their business id (NULL: must complete the profile)."""
    owners = users.where(F.col("role") == "business_owner").select("user_id")
    b = businesses.select("user_id", "business_id")
    return owners.join(b, "user_id", "left") \
                 .withColumn("needs_profile", F.col("business_id").isNull())


def sellers_without_business(users: DataFrame, businesses: DataFrame) -> DataFrame:
    """J-09 negative side: business owners that have no business row."""
    owners = users.where(F.col("role") == "business_owner")
    return owners.join(businesses.select("user_id"), "user_id", "left_anti") \
                 .select("user_id", "username", "email")
