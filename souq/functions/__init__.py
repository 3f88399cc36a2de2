"""Scalar rules of the marketplace as built-in Column expressions (no UDFs)."""

from souq.functions.coerce import php_empty, to_float_prefix, to_int_prefix
from souq.functions.labels import business_category_label, image_or_placeholder, location_label
from souq.functions.pricing import (discount_badge, discount_label, discounted_price,
                                    discounted_price_exact, home_price_label, seller_deal_label,
                                    seller_price_label)
from souq.functions.text import (html_escape, is_digits, is_valid_email, php_trim, slugify,
                                 truncate_text, upload_name, date_label)

__all__ = [
    "php_empty", "to_float_prefix", "to_int_prefix",
    "business_category_label", "image_or_placeholder", "location_label",
    "discount_badge", "discount_label", "discounted_price", "discounted_price_exact",
    "home_price_label", "seller_deal_label", "seller_price_label",
    "html_escape", "is_digits", "is_valid_email", "php_trim", "slugify", "truncate_text",
    "upload_name", "date_label",
]
