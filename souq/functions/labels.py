"""Display defaults (X-13) and the business-category label map (J-10)."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from souq.functions._col import as_col

# Fixed values of the reference: business category codes and their labels,
# in the source's order, with "Unknown" for any other code.
BUSINESS_CATEGORIES = {
    "retail": "Retail",
    "food": "Food & Beverages",
    "electronics": "Electronics",
    "fashion": "Fashion & Apparel",
    "health": "Health & Beauty",
    "home": "Home & Furniture",
    "art": "Art & Crafts",
    "books": "Books & Stationery",
    "toys": "Toys & Games",
    "sports": "Sports & Outdoors",
    "automotive": "Automotive",
    "services": "Services",
    "other": "Other",
}
UNKNOWN_LABEL = "Unknown"
# Fixed values of the reference: card placeholders and the missing-location text.
PRODUCT_PLACEHOLDER = "assets/images/product-placeholder.jpg"
BUSINESS_PLACEHOLDER = "assets/images/business-placeholder.jpg"
NO_LOCATION = "Location not specified"


def business_category_label(code: Column | str, badge: bool = False) -> Column:
    """J-10 lookup as a literal map (no join, no shuffle).

    ``badge=True`` follows the home page: a NULL or empty code shows no badge
    (NULL) instead of ``Unknown``.
    """
    code = as_col(code)
    m = F.create_map(*[F.lit(x) for x in chain.from_iterable(BUSINESS_CATEGORIES.items())])
    label = F.coalesce(F.try_element_at(m, code), F.lit(UNKNOWN_LABEL))
    if badge:
        return F.when(code.isNull() | (code == ""), F.lit(None).cast("string")).otherwise(label)
    return label


def image_or_placeholder(path: Column | str, placeholder: str = PRODUCT_PLACEHOLDER) -> Column:
    """X-13: ``$image ?? placeholder`` (only NULL is replaced, like PHP ``??``)."""
    return F.coalesce(as_col(path), F.lit(placeholder))


def location_label(city: Column | str, state: Column | str, location: Column | str | None = None) -> Column:
    """X-13: ``city, state`` when both are set, else ``location`` if set, else the fixed text."""
    city, state = as_col(city), as_col(state)
    rest = F.lit(NO_LOCATION) if location is None else F.coalesce(as_col(location), F.lit(NO_LOCATION))
    return F.when(city.isNotNull() & state.isNotNull(), F.concat_ws(", ", city, state)).otherwise(rest)
