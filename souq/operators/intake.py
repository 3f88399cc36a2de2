"""Batch intake and validation (V-01, V-02, V-03, J-07, P-09, S-04, S-05, X-14, X-15).

The source validates one form submission per request.  Here a batch of
candidate rows (each with a unique ``arrival_no``) is validated in one
projection; the only shuffles are the email-uniqueness checks of the user
intake, which are grouped aggregates and joins, never a global sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from souq.functions.coerce import php_blank, php_empty, to_float_prefix, to_int_prefix
from souq.functions.text import html_escape, is_digits, is_valid_email, php_trim, slugify, upload_name
from souq.operators.numbering import free_numbers
from souq.sources.sinks import assign_keys

# Fixed values of the reference: accepted upload types and the size limit.
ALLOWED_IMAGE_TYPES = ["image/jpeg", "image/png", "image/jpg"]
MAX_IMAGE_BYTES = 5000000
MIN_PASSWORD_BYTES = 8
UPLOAD_DIR = "uploads/products/"
FIRST_USERNAME = 100
# Characters of a username before its number, and of a slug before "-number" (columns of 50 and 255).
USERNAME_BASE = 38
NUMBERED_SLUG = 235

# Collation for email identity: case-, accent- and trailing-space-insensitive,
# the closest Spark collation to MySQL's utf8mb4_general_ci for '=' (T-03).
EMAIL_COLLATION = "UNICODE_CI_AI_RTRIM"


def _rule(cond: Column, code: str) -> Column:
    return F.when(cond, F.lit(code))


# -- V-01 product intake ----------------------------------------------------------
def clean_product_candidates(c: DataFrame) -> DataFrame:
    """X-08 + X-11: escape text fields, coerce numbers the way PHP does."""
    return c.withColumns({
        "name": html_escape(F.coalesce("name", F.lit(""))),
        "description": html_escape(F.coalesce("description", F.lit(""))),
        "category_id": to_int_prefix("category"),
        "price_value": to_float_prefix("price"),
        # an absent discount field means 0; a present one is floatval'd
        "discount_value": F.when(F.col("discount").isNull(), F.lit(0.0))
                           .otherwise(to_float_prefix("discount")),
    })


def product_errors() -> Column:
    """Every failing rule of the product form, in the source's order.

    The emptiness rules read the raw ``raw_name``/``_description`` (escaping
    cannot change whether the trimmed text is empty), so the escaped text is
    only computed when it is actually output.
    """
    no_image = F.col("image_name").isNull()
    return F.array_compact(F.array(
        _rule(php_blank("raw_name"), "name_required"),
        _rule(php_blank("_description"), "description_required"),
        _rule(F.col("category_id") <= 0, "category_invalid"),
        _rule(F.col("price_value") <= 0, "price_invalid"),
        _rule((F.col("discount_value") < 0) | (F.col("discount_value") > 100), "discount_out_of_range"),
        _rule(no_image, "image_required"),
        _rule(~no_image & ~F.coalesce(F.col("image_type").isin(ALLOWED_IMAGE_TYPES), F.lit(False)),
              "image_type_invalid"),
        _rule(~no_image & (F.coalesce(F.col("image_size"), F.lit(0)) > MAX_IMAGE_BYTES), "image_too_large"),
    ))


def validate_products(candidates: DataFrame) -> DataFrame:
    """V-01: the cleaned candidates with ``errors`` (empty array = valid).

    ``raw_name`` keeps the submitted name (for the slug); the stored ``name``
    and ``description`` are escaped.
    """
    raw = candidates.withColumns({"raw_name": F.col("name"), "_description": F.col("description")})
    return clean_product_candidates(raw).withColumn("errors", product_errors()).drop("_description")


def _storable() -> Column:
    """The price and discount fit their decimal columns (the source's INSERT fails otherwise)."""
    fits = lambda c, p: F.col(c).isNull() | F.col(c).try_cast(DecimalType(p, 2)).isNotNull()
    return fits("price_value", 10) & fits("discount_value", 5)


def unstorable_products(validated: DataFrame) -> DataFrame:
    """(arrival_no, error_codes) of valid candidates whose numbers are too large for their columns."""
    return validated.where((F.size("errors") == 0) & ~_storable()).select(
        "arrival_no", F.lit("value_out_of_range").alias("error_codes"))


def accepted_products(validated: DataFrame, existing_products: DataFrame, *,
                      truncate_discount: bool = True, epoch: Column | None = None) -> DataFrame:
    """S-04: rows to append for the valid candidates.

    ``truncate_discount`` reproduces the integer bind of the insert (T-09):
    a 12.5 discount is stored as 12.
    """
    ok = validated.where((F.size("errors") == 0) & _storable())
    disc = F.col("discount_value")
    disc = (disc.try_cast("int") if truncate_discount else disc).try_cast(DecimalType(5, 2))
    rows = ok.select(
        "arrival_no", F.col("business_id").cast("bigint").alias("business_id"),
        "category_id", "name", slugify(php_trim("raw_name")).alias("slug"), "description",
        F.col("price_value").try_cast(DecimalType(10, 2)).alias("price"),
        disc.alias("discount_percent"),
        F.concat(F.lit(UPLOAD_DIR), upload_name("image_name", epoch)).alias("image_path"),
        F.localtimestamp().alias("created_at"))           # NOW(): session-local, no zone
    return assign_keys(rows, existing_products, "product_id")


# -- V-02 user intake ---------------------------------------------------------------
def email_key(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.collate(c, EMAIL_COLLATION)


def user_rule_code() -> Column:
    """The first failing registration rule (an else-if chain), NULL when all pass."""
    required = ["first_name", "last_name", "email", "phone", "password", "confirm_password"]
    missing = F.lit(False)
    for c in required:
        missing = missing | php_empty(c)
    return (F.when(missing, "fields_required")
             .when(~is_valid_email("email"), "email_invalid")
             .when(~is_digits("phone"), "phone_invalid")
             .when(F.octet_length("password") < MIN_PASSWORD_BYTES, "password_too_short")
             .when(F.col("password") != F.col("confirm_password"), "password_mismatch"))


def username_for(first: Column, last: Column, salt: Column) -> Column:
    """X-14: ``lower(first . '.' . last . n)`` with n in 100..999.

    The source draws n at random; here it is derived from ``salt`` (md5) so
    a batch is repeatable.
    """
    n = F.lit(100) + F.conv(F.substring(F.md5(salt.cast("string")), 1, 8), 16, 10).cast("bigint") % 900
    return F.lower(F.concat(first, F.lit("."), last, n.cast("string")))


def user_role() -> Column:
    return F.when(F.col("registration_type") == "business", "business_owner").otherwise("customer")


def escaped_users(candidates: DataFrame) -> DataFrame:
    """The candidates with their text fields escaped, as the source does before it validates."""
    return candidates.withColumns({k: html_escape(F.col(k)) for k in ("first_name", "last_name", "email", "phone")})


def checked_users(candidates: DataFrame) -> DataFrame:
    """V-02 without the check for taken emails: escaped fields, ``role`` and ``error``; passwords are dropped."""
    return escaped_users(candidates).select("arrival_no", "first_name", "last_name", "email", "phone",
                                            user_role().alias("role"), user_rule_code().alias("error"))


def validate_users(candidates: DataFrame, users: DataFrame) -> DataFrame:
    """V-02 + J-07: one ``error`` code per candidate (NULL = accepted).

    Text fields are escaped first (the source escapes before validating).
    Email uniqueness is checked against the table and within the batch: of
    candidates passing the other rules, the earliest arrival per email wins,
    because sequential requests would reject the later ones.  Passwords are
    only checked, then dropped.
    """
    c = escaped_users(candidates).withColumn("error", user_rule_code()).withColumn("_ek", email_key("email"))
    passing = c.where(F.col("error").isNull()).select("_ek", "arrival_no")
    # earliest arrival per email first: a grouped min combines on the map
    # side, so one email repeated in a third of the batch is one row per task
    # before the anti-join against the table (which only looks at the key)
    first = passing.groupBy("_ek").agg(F.min("arrival_no").alias("arrival_no"))
    taken = users.select(email_key("email").alias("_ek"))
    winners = first.join(taken, "_ek", "left_anti").select("arrival_no", F.lit(True).alias("_win"))
    out = c.join(winners, "arrival_no", "left")
    err = F.when(F.col("error").isNotNull(), F.col("error")) \
           .when(F.col("_win").isNull(), F.lit("email_in_use"))
    return out.select(
        "arrival_no", "first_name", "last_name", "email", "phone",
        user_role().alias("role"),
        F.when(err.isNull(), username_for(F.col("first_name"), F.col("last_name"), F.col("email")))
         .alias("username"),
        err.alias("error"))


def username_base(first: Column, last: Column) -> Column:
    """``first.last`` in lower case, at most ``USERNAME_BASE`` characters.

    A name that ends in a digit gets a dot after it, so that a username falls
    into base and number in one way only.
    """
    b = F.substring(F.lower(F.concat(first, F.lit("."), last)), 1, USERNAME_BASE)
    return F.concat(b, F.when(b.rlike("[0-9]\\z"), ".").otherwise(""))


def allocate_usernames(accepted: DataFrame, users: DataFrame) -> DataFrame:
    """X-14 under the unique key users.username: every accepted row gets the next free number of its name.

    The source draws a number from 100 to 999 and lets the insert fail where
    it is taken.  Here the n-th accepted row of a name, by arrival, gets its
    n-th free number from 100 on, numbers that the table uses left out; names
    with more than 900 rows grow a digit.  Names meet under the key's
    collation.  One name may hold a third of all rows (see ``numbering``).
    """
    named = accepted.withColumn("_base", username_base(F.col("first_name"), F.col("last_name")))
    wanted = named.select(F.collate("_base", EMAIL_COLLATION).alias("_key"), "arrival_no")
    name = F.rtrim("username")
    digits = F.regexp_extract(name, "([1-9][0-9]{2,17})\\z", 1)
    stem = F.regexp_replace(name, "[0-9]+\\z", "")
    used = users.select(F.collate(stem, EMAIL_COLLATION).alias("_key"), digits.try_cast("bigint").alias("number"),
                        (F.length(stem) + F.length(digits) == F.length(name)).alias("_whole"))
    numbers = free_numbers(wanted, used.where("_whole AND number IS NOT NULL"), ["_key"], FIRST_USERNAME)
    return named.join(numbers.select("arrival_no", "number"), "arrival_no") \
                .withColumn("username", F.concat("_base", F.col("number").cast("string"))).drop("_base", "number")


def accepted_users(validated: DataFrame, existing_users: DataFrame) -> DataFrame:
    """S-05: rows to append for accepted registrations (``created_at = NOW()``), usernames unique in table and batch."""
    ok = allocate_usernames(validated.where(F.col("error").isNull()).drop("error"), existing_users)
    ok = ok.withColumns({"is_verified": F.lit(False), "created_at": F.localtimestamp()})
    return assign_keys(ok, existing_users, "user_id")


# -- V-03 slugs ------------------------------------------------------------------------
def slug_report(df: DataFrame, source_col: str, key: str) -> DataFrame:
    """V-03: slug per row plus collision facts against the unique slug key.

    Returns (slug, rows, is_empty) for every slug used by more than one row
    or reduced to the empty string (T-16).
    """
    s = df.select(F.col(key), slugify(source_col).alias("slug"))
    g = s.groupBy("slug").agg(F.count(F.lit(1)).alias("rows"))
    return g.where((F.col("rows") > 1) | (F.col("slug") == "")) \
            .withColumn("is_empty", F.col("slug") == "")


def assign_slugs(rows: DataFrame, existing: DataFrame, source_col: str, arrival: str = "arrival_no",
                 default: str = "product") -> DataFrame:
    """V-03: (arrival, slug) unique in the batch and against ``existing.slug`` (T-16).

    The first row of a slug that the table lacks keeps it; every other row
    gets the slug and the next free number from 2 on ("-2", "-3", ...), by
    arrival, numbers taken in the table or kept by this batch left out.  A
    slug that reduces to the empty string (or a null source) starts from
    ``default``.  Numbered slugs are cut so that the number fits the column.
    """
    s = F.coalesce(slugify(source_col), F.lit(""))
    b = rows.select(F.col(arrival).alias("arrival_no"), F.when(s == "", default).otherwise(s).alias("slug"))
    key = lambda c: F.collate(c, EMAIL_COLLATION).alias("_key")
    taken = existing.where("slug IS NOT NULL").select("slug")
    kept = (b.groupBy(key("slug")).agg(F.min("arrival_no").alias("arrival_no"))
            .join(taken.select(key("slug")), "_key", "left_anti").select("arrival_no"))
    kept = b.join(kept, "arrival_no", "left_semi")
    rest = b.join(kept.select("arrival_no"), "arrival_no", "left_anti") \
            .withColumn("_base", F.substring("slug", 1, NUMBERED_SLUG))
    parts = "(?s)^(.*)-([1-9][0-9]{0,17})\\z"
    used = taken.union(kept.select("slug")).select(
        key(F.regexp_extract("slug", parts, 1)),
        F.regexp_extract("slug", parts, 2).try_cast("bigint").alias("number")).where("number IS NOT NULL")
    numbers = free_numbers(rest.select(key("_base"), "arrival_no"), used, ["_key"], 2)
    numbered = rest.join(numbers.select("arrival_no", "number"), "arrival_no") \
                   .select("arrival_no", F.concat("_base", F.lit("-"), F.col("number").cast("string")).alias("slug"))
    return kept.select("arrival_no", "slug").unionByName(numbered).withColumnRenamed("arrival_no", arrival)


# -- P-09 role presence -----------------------------------------------------------------
def role_counts(users: DataFrame) -> DataFrame:
    """P-09 for all roles in one aggregate: (role, users)."""
    return users.groupBy("role").agg(F.count(F.lit(1)).alias("users"))


def has_role(users: DataFrame, role: str) -> DataFrame:
    """P-09 as written: ``role = x LIMIT 1`` (an empty frame means none)."""
    return users.where(F.col("role") == role).limit(1)
