"""Integrity audits and delete planning (I-01 .. I-06, J-08, S-07, S-09).

Parquet enforces no constraints, so every constraint of the schema becomes
an audit job.  All audits pre-aggregate the referencing side (one row per
distinct key per task) before the anti-join or count, so a hot key is
combined on the map side instead of being shuffled row by row.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from souq.session import ensure_checkpoint_dir
from souq.sources.dialect import migrate_discount
from souq.sources.versions import VersionedTable


@dataclass(frozen=True)
class ForeignKey:
    child: str
    column: str
    parent: str
    parent_key: str
    on_delete: str          # cascade | set_null | restrict


# Fixed values of the schema: the 26 foreign keys and their delete actions
# (no action given means restrict).
FOREIGN_KEYS = [
    ForeignKey("user_addresses", "user_id", "users", "user_id", "cascade"),
    ForeignKey("categories", "parent_id", "categories", "category_id", "set_null"),
    ForeignKey("businesses", "user_id", "users", "user_id", "cascade"),
    ForeignKey("products", "business_id", "businesses", "business_id", "cascade"),
    ForeignKey("products", "category_id", "categories", "category_id", "restrict"),
    ForeignKey("product_images", "product_id", "products", "product_id", "cascade"),
    ForeignKey("product_reviews", "product_id", "products", "product_id", "cascade"),
    ForeignKey("product_reviews", "user_id", "users", "user_id", "cascade"),
    ForeignKey("product_attributes", "product_id", "products", "product_id", "cascade"),
    ForeignKey("product_tags", "product_id", "products", "product_id", "cascade"),
    ForeignKey("cart_items", "user_id", "users", "user_id", "cascade"),
    ForeignKey("cart_items", "product_id", "products", "product_id", "cascade"),
    ForeignKey("orders", "user_id", "users", "user_id", "cascade"),
    ForeignKey("orders", "shipping_address_id", "user_addresses", "address_id", "restrict"),
    ForeignKey("orders", "billing_address_id", "user_addresses", "address_id", "restrict"),
    ForeignKey("order_items", "order_id", "orders", "order_id", "cascade"),
    ForeignKey("order_items", "product_id", "products", "product_id", "restrict"),
    ForeignKey("order_items", "business_id", "businesses", "business_id", "restrict"),
    ForeignKey("wishlist_items", "user_id", "users", "user_id", "cascade"),
    ForeignKey("wishlist_items", "product_id", "products", "product_id", "cascade"),
    ForeignKey("forum_topics", "created_by", "users", "user_id", "cascade"),
    ForeignKey("forum_posts", "topic_id", "forum_topics", "topic_id", "cascade"),
    ForeignKey("forum_posts", "user_id", "users", "user_id", "cascade"),
    ForeignKey("messages", "sender_id", "users", "user_id", "cascade"),
    ForeignKey("messages", "receiver_id", "users", "user_id", "cascade"),
    ForeignKey("notifications", "user_id", "users", "user_id", "cascade"),
]

# Fixed values of the schema: primary keys.
PRIMARY_KEYS = {
    "users": "user_id", "user_addresses": "address_id", "categories": "category_id",
    "businesses": "business_id", "products": "product_id", "product_images": "image_id",
    "product_reviews": "review_id", "product_attributes": "attribute_id", "product_tags": "tag_id",
    "cart_items": "cart_item_id", "orders": "order_id", "order_items": "order_item_id",
    "wishlist_items": "wishlist_id", "forum_topics": "topic_id", "forum_posts": "post_id",
    "messages": "message_id", "notifications": "notification_id",
}

# Fixed values of the schema: unique keys besides the primary keys.
UNIQUE_KEYS = [
    ("users", ("username",)), ("users", ("email",)), ("categories", ("category_slug",)),
    ("businesses", ("business_slug",)), ("products", ("slug",)),
    ("cart_items", ("user_id", "product_id")), ("wishlist_items", ("user_id", "product_id")),
    ("forum_topics", ("slug",)),
]

# Fixed values of the schema: enum domains.
ENUMS = {
    ("users", "role"): ["customer", "business_owner", "admin"],
    ("user_addresses", "address_type"): ["billing", "shipping", "both"],
    ("businesses", "status"): ["pending", "active", "suspended"],
    ("orders", "order_status"): ["pending", "processing", "shipped", "delivered", "cancelled"],
    ("orders", "payment_status"): ["pending", "paid", "failed", "refunded"],
    ("order_items", "status"): ["pending", "processing", "shipped", "delivered", "cancelled", "returned"],
}

# Fixed values of the schema: NOT NULL columns of all 17 tables.
NOT_NULL = {
    "users": ["user_id", "username", "first_name", "last_name", "email", "password_hash", "role", "is_verified",
              "created_at", "updated_at"],
    "user_addresses": ["address_id", "user_id", "address_line1", "city", "state", "postal_code", "country",
                       "is_default", "address_type", "created_at", "updated_at"],
    "categories": ["category_id", "category_name", "category_slug", "is_active", "created_at", "updated_at"],
    "businesses": ["business_id", "user_id", "business_name", "business_slug", "address_line1", "city", "state",
                   "postal_code", "country", "business_phone", "business_email", "is_verified", "status",
                   "created_at", "updated_at"],
    "products": ["product_id", "business_id", "category_id", "name", "slug", "price", "stock_quantity",
                 "created_at", "updated_at"],
    "product_images": ["image_id", "product_id", "image_path", "created_at"],
    "product_reviews": ["review_id", "product_id", "user_id", "rating", "created_at", "updated_at"],
    "product_attributes": ["attribute_id", "product_id", "attribute_name", "attribute_value"],
    "product_tags": ["tag_id", "product_id", "tag_name"],
    "cart_items": ["cart_item_id", "user_id", "product_id", "quantity", "created_at", "updated_at"],
    "orders": ["order_id", "user_id", "order_status", "shipping_address_id", "billing_address_id",
               "payment_method", "payment_status", "subtotal", "shipping_cost", "tax_amount", "discount_amount",
               "total_amount", "created_at", "updated_at"],
    "order_items": ["order_item_id", "order_id", "product_id", "business_id", "quantity", "price",
                    "discount_amount", "total_amount", "status", "created_at"],
    "wishlist_items": ["wishlist_id", "user_id", "product_id", "created_at"],
    "forum_topics": ["topic_id", "title", "slug", "created_by", "is_locked", "is_sticky", "views", "created_at",
                     "updated_at"],
    "forum_posts": ["post_id", "topic_id", "user_id", "content", "is_solution", "created_at"],
    "messages": ["message_id", "sender_id", "receiver_id", "message_text", "is_read", "created_at"],
    "notifications": ["notification_id", "user_id", "type", "title", "message", "is_read", "created_at"],
}

# Fixed values of the schema: varchar limits (characters) and decimal shapes.
VARCHAR_LIMITS = {
    "users": {"username": 50, "first_name": 50, "last_name": 50, "email": 100, "phone": 20,
              "password_hash": 255, "verification_token": 255, "reset_token": 255},
    "user_addresses": {"address_line1": 255, "address_line2": 255, "city": 100, "state": 100, "postal_code": 20,
                       "country": 100},
    "categories": {"category_name": 100, "category_slug": 100, "category_icon": 50},
    "businesses": {"business_name": 100, "business_slug": 100, "logo_path": 255, "banner_path": 255,
                   "address_line1": 255, "address_line2": 255, "city": 100, "state": 100, "postal_code": 20,
                   "country": 100, "business_phone": 20, "business_email": 100, "website": 255, "tax_id": 50},
    "products": {"name": 255, "slug": 255, "sku": 50, "dimensions": 50},
    "product_images": {"image_path": 255},
    "product_attributes": {"attribute_name": 100, "attribute_value": 255},
    "product_tags": {"tag_name": 50},
    "orders": {"payment_method": 50, "tracking_number": 100},
    "forum_topics": {"title": 255, "slug": 255},
    "notifications": {"type": 50, "title": 255, "link": 255},
}
DECIMAL_SHAPES = {
    "products": {"price": (10, 2), "discount_percent": (5, 2), "weight": (8, 2)},
    "orders": {"subtotal": (10, 2), "shipping_cost": (10, 2), "tax_amount": (10, 2),
               "discount_amount": (10, 2), "total_amount": (10, 2)},
    "order_items": {"price": (10, 2), "discount_amount": (10, 2), "total_amount": (10, 2)},
}

# Text keys compared under the case/accent-insensitive collation (T-03).
COLLATED_KEYS = {"username", "email", "category_slug", "business_slug", "slug"}
KEY_COLLATION = "UNICODE_CI_AI_RTRIM"


def _union(parts: list[DataFrame], spark: SparkSession, schema: str) -> DataFrame:
    if not parts:
        return spark.createDataFrame([], schema)
    return reduce(lambda a, b: a.unionByName(b), parts)


def _spark(tables: dict[str, DataFrame]) -> SparkSession:
    return next(iter(tables.values())).sparkSession


# -- I-01 ---------------------------------------------------------------------------------
def orphan_audit(tables: dict[str, DataFrame], fks: list[ForeignKey] = FOREIGN_KEYS) -> DataFrame:
    """(child_table, child_column, parent_table, orphan_keys, orphan_rows) for each key whose
    tables are both present.  NULL references are legal and not counted.

    Every table is read once: a row gives its references and, where it is a
    parent, its own key, each tagged with the parent table it belongs to.  One
    grouped count by (parent table, key), combined on the map side, then tells
    how often a key is referenced and whether it exists; no join is needed.
    """
    spark = _spark(tables)
    present = [fk for fk in fks if fk.child in tables and fk.parent in tables]
    tags = {p: i for i, p in enumerate(dict.fromkeys(fk.parent for fk in present))}
    slots = {fk: [x for x in present if x.parent == fk.parent].index(fk) for fk in present}
    meta = spark.createDataFrame([(tags[fk.parent], slots[fk], fk.child, fk.column, fk.parent) for fk in present],
                                 "tag int, slot int, child_table string, child_column string, parent_table string")
    zero = F.lit(0).cast("bigint")
    if not present:
        return meta.drop("tag", "slot").withColumns({"orphan_keys": zero, "orphan_rows": zero})

    def entry(tag: int, column: str, slot: int) -> str:
        return f"named_struct('tag', {tag}, 'k', CAST({_q(column)} AS BIGINT), 'slot', {slot})"

    parts = []
    for name, df in tables.items():
        entries = [entry(tags[fk.parent], fk.column, slots[fk]) for fk in present if fk.child == name]
        entries += [entry(tags[name], fk.parent_key, -1) for fk in present if fk.parent == name and slots[fk] == 0]
        if entries:
            parts.append(df.selectExpr(f"explode(array({', '.join(entries)})) AS e").select("e.*"))
    most = 1 + max(slots.values())
    found = reduce(lambda a, b: a.unionByName(b), parts).where("k IS NOT NULL").groupBy("tag", "k").agg(
        F.max(F.col("slot") == -1).alias("held"), *(F.expr(f"count_if(slot = {i})").alias(f"n{i}") for i in range(most)))
    columns = ", ".join(f"{i}, n{i}" for i in range(most))
    per_fk = (found.where("NOT held").selectExpr("tag", f"stack({most}, {columns}) AS (slot, n)").where("n > 0")
              .groupBy("tag", "slot").agg(F.count(F.lit(1)).alias("orphan_keys"), F.sum("n").alias("orphan_rows")))
    return meta.join(per_fk, ["tag", "slot"], "left").select(
        "child_table", "child_column", "parent_table", F.coalesce("orphan_keys", zero).alias("orphan_keys"),
        F.coalesce("orphan_rows", zero).alias("orphan_rows"))


# -- I-02 ---------------------------------------------------------------------------------
def key_audit(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, key_name, key_kind, duplicate_keys, excess_rows) for every primary and unique key.

    Keys are emitted as tagged rows (key_name and two numeric or two collated
    text parts) and counted in one grouped aggregation for numeric keys and
    one for text keys, with map-side combining of repeated values.  A table
    with keys of both kinds is read for each.
    """
    spark = _spark(tables)
    keys = [(t, (k,), "primary") for t, k in PRIMARY_KEYS.items()] + \
           [(t, cols, "unique") for t, cols in UNIQUE_KEYS]
    keys = [k for k in keys if k[0] in tables and set(k[1]) <= set(tables[k[0]].columns)]
    if not keys:
        return spark.createDataFrame([], "table_name string, key_name string, key_kind string, "
                                         "duplicate_keys bigint, excess_rows bigint")
    numeric, textual = [], []
    for table in dict.fromkeys(k[0] for k in keys):
        df = tables[table]
        types = dict(df.dtypes)
        num_e, txt_e = [], []
        for _, cols, _ in [k for k in keys if k[0] == table]:
            name = _lit(",".join(cols))
            if any(c in COLLATED_KEYS or types[c] == "string" for c in cols):
                second = f"CAST({_q(cols[1])} AS STRING)" if len(cols) > 1 else "CAST(NULL AS STRING)"
                txt_e.append(f"named_struct('key_name', {name}, 't1', CAST({_q(cols[0])} AS STRING), "
                             f"'t2', {second})")
            else:
                wide = "DECIMAL(38,0)"      # composite surrogate keys do not fit a long
                second = f"CAST({_q(cols[1])} AS {wide})" if len(cols) > 1 else f"CAST(NULL AS {wide})"
                num_e.append(f"named_struct('key_name', {name}, 'n1', CAST({_q(cols[0])} AS {wide}), "
                             f"'n2', {second})")
        for entries, sink in ((num_e, numeric), (txt_e, textual)):
            if entries:
                sink.append(df.selectExpr(f"{_lit(table)} AS table_name",
                                          f"explode(array({', '.join(entries)})) AS e")
                              .selectExpr("table_name", "e.*"))

    def dup_counts(parts, cols):
        if not parts:
            return None
        u = reduce(lambda a, b: a.unionByName(b), parts)
        return u.groupBy("table_name", "key_name", *cols).agg(F.count(F.lit(1)).alias("_n")) \
                .where("_n > 1").groupBy("table_name", "key_name") \
                .agg(F.count(F.lit(1)).alias("duplicate_keys"), F.sum(F.col("_n") - 1).alias("excess_rows"))

    # numeric keys: a plain hash aggregate; text keys: grouped under the collation
    found = [d for d in (dup_counts(numeric, ["n1", "n2"]),
                         dup_counts([t.withColumns({c: F.collate(F.col(c), KEY_COLLATION) for c in ("t1", "t2")})
                                     for t in textual], ["t1", "t2"])) if d is not None]
    dups = reduce(lambda a, b: a.unionByName(b), found)
    meta = spark.createDataFrame([(t, ",".join(c), kind) for t, c, kind in keys],
                                 "table_name string, key_name string, key_kind string")
    return meta.join(dups, ["table_name", "key_name"], "left").select(
        "table_name", "key_name", "key_kind",
        F.coalesce("duplicate_keys", F.lit(0)).cast("bigint").alias("duplicate_keys"),
        F.coalesce("excess_rows", F.lit(0)).cast("bigint").alias("excess_rows"))


# -- I-03, I-04, I-05 -----------------------------------------------------------------------
# The column checks are generated as SQL expression strings: one parse per
# table on the JVM instead of several Python-to-JVM calls per Column object.

def _q(c: str) -> str:
    return "`" + c.replace("`", "``") + "`"


def _lit(v: str) -> str:
    return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _checks(table: str, cols: set[str], kinds: tuple[str, ...]) -> list[tuple[str, str, str]]:
    """(column, check, SQL condition that marks a bad row) for one table."""
    out = []
    if "not_null" in kinds:
        out += [(c, "not_null", f"{_q(c)} IS NULL") for c in NOT_NULL.get(table, []) if c in cols]
    if "length" in kinds:
        out += [(c, "length", f"char_length({_q(c)}) > {n}")
                for c, n in VARCHAR_LIMITS.get(table, {}).items() if c in cols]
        out += [(c, "length", f"{_q(c)} IS NOT NULL AND try_cast({_q(c)} AS decimal({p},{sc})) IS NULL")
                for c, (p, sc) in DECIMAL_SHAPES.get(table, {}).items() if c in cols]
    if "enum" in kinds:
        out += [(c, "enum", f"{_q(c)} IS NOT NULL AND {_q(c)} NOT IN ({', '.join(_lit(x) for x in dom)})")
                for (t, c), dom in ENUMS.items() if t == table and c in cols]
    return out


def _audit(tables: dict[str, DataFrame], kinds: tuple[str, ...]) -> DataFrame:
    """One aggregate per table over its checks, unpivoted to
    (table_name, column_name, check, bad_rows)."""
    parts = []
    for table, df in tables.items():
        checks = _checks(table, set(df.columns), kinds)
        if not checks:
            continue
        wide = df.selectExpr(*[f"count_if({cond}) AS _{i}" for i, (_, _, cond) in enumerate(checks)])
        rows = ", ".join(f"{_lit(c)}, {_lit(k)}, CAST(_{i} AS BIGINT)" for i, (c, k, _) in enumerate(checks))
        parts.append(wide.selectExpr(
            f"{_lit(table)} AS table_name",
            f"stack({len(checks)}, {rows}) AS (column_name, check, bad_rows)"))
    return _union(parts, _spark(tables), "table_name string, column_name string, check string, bad_rows bigint")


def enum_audit(tables: dict[str, DataFrame]) -> DataFrame:
    """I-03: (table_name, column_name, bad_rows): values outside the declared domain (NULL aside)."""
    return _audit(tables, ("enum",)).drop("check")


def null_audit(tables: dict[str, DataFrame]) -> DataFrame:
    """I-04: (table_name, column_name, null_rows) for NOT NULL columns, one pass per table."""
    return _audit(tables, ("not_null",)).drop("check").withColumnRenamed("bad_rows", "null_rows")


def length_audit(tables: dict[str, DataFrame]) -> DataFrame:
    """I-05: (table_name, column_name, bad_rows): too-long text or decimals that do not fit."""
    return _audit(tables, ("length",)).drop("check")


def column_audit(tables: dict[str, DataFrame]) -> DataFrame:
    """I-03 + I-04 + I-05 in one pass per table: (table_name, column_name, check, bad_rows).

    ``check`` is ``not_null``, ``length`` or ``enum``.  Every count of a
    table is one aggregate over a single scan, instead of three scans when
    the audits run separately.
    """
    return _audit(tables, ("not_null", "length", "enum"))


# -- I-06 delete planning -------------------------------------------------------------------
_ACTION = {"cascade": "delete", "set_null": "set_null", "restrict": "restrict"}

def _dependency_order(tables: dict[str, DataFrame], fks: list[ForeignKey]) -> list[str]:
    """Tables ordered so every referenced table comes before its referencing tables.

    Self references (only SET NULL in the schema) impose no order.  The order
    is computed from metadata only.
    """
    names = list(tables)
    deps = {t: {fk.parent for fk in fks if fk.child == t and fk.parent in tables and fk.parent != t}
            for t in names}
    order: list[str] = []
    while deps:
        ready = [t for t, d in deps.items() if not d - set(order)]
        if not ready:
            raise ValueError("cycle in foreign-key metadata")
        for t in ready:
            order.append(t)
            del deps[t]
    return order


def plan_delete(tables: dict[str, DataFrame], table: str, victims: DataFrame,
                fks: list[ForeignKey] = FOREIGN_KEYS) -> DataFrame:
    """I-06: what deleting each victim row would do.

    ``victims`` has the primary key of ``table``.  Output rows
    (root_key, table_name, key, action, via, blocked): ``delete`` for the
    victim and every row reached through CASCADE, ``set_null`` for SET NULL
    references, ``restrict`` for referencing rows under RESTRICT.  A root is
    ``blocked`` when one of its restrict rows is not itself deleted by the
    same root (a row that goes away with the cascade does not block, T-15).

    Tables are visited in dependency order, with one narrow join (key,
    reference) per foreign key whose parent has deleted rows; the size of the
    deleted-row frontier decides its strategy at run time.  A frontier that
    later tables depend on (the victims' closure in that table, not the
    table) is checkpointed into the shared checkpoint folder.  Rows are
    named by primary key, which has to be unique (``key_audit`` tells).
    """
    ensure_checkpoint_dir(victims.sparkSession)
    live = [fk for fk in fks if fk.child in tables and fk.parent in tables]
    pk = PRIMARY_KEYS[table]
    roots = victims.select(F.col(pk).alias("root_key"), F.col(pk).alias("key")).distinct() \
                   .checkpoint(eager=True)
    frontiers = {table: roots}
    out = [roots.select("root_key", F.lit(table).alias("table_name"), "key",
                        F.lit("delete").alias("action"), F.lit(None).cast("string").alias("via"))]
    for child in _dependency_order(tables, live):
        edges = [fk for fk in live if fk.child == child and fk.parent in frontiers]
        if not edges:
            continue
        rows = reduce(lambda a, b: a.unionByName(b), [
            tables[child].select(F.col(PRIMARY_KEYS[child]).alias("key"), F.col(fk.column).cast("bigint").alias("_ref"))
            .join(frontiers[fk.parent].select(F.col("key").alias("_ref"), "root_key"), "_ref")
            .select("root_key", F.lit(child).alias("table_name"), "key",
                    F.lit(_ACTION[fk.on_delete]).alias("action"), F.lit(f"{fk.child}.{fk.column}").alias("via"))
            for fk in edges])
        feeds_later = any(fk.parent == child and fk.child != child for fk in live)
        if feeds_later and any(fk.on_delete == "cascade" for fk in edges):
            rows = rows.checkpoint(eager=True)
            frontiers[child] = rows.where("action = 'delete'").select("root_key", "key").distinct()
        out.append(rows)
    plan = reduce(lambda a, b: a.unionByName(b), out).distinct().checkpoint(eager=False)
    deleted = plan.where("action = 'delete'").select("root_key", "table_name", "key")
    blockers = plan.where("action = 'restrict'").select("root_key", "table_name", "key") \
                   .join(deleted, ["root_key", "table_name", "key"], "left_anti") \
                   .select("root_key").distinct().withColumn("blocked", F.lit(True))
    return plan.join(blockers, "root_key", "left") \
               .withColumn("blocked", F.coalesce("blocked", F.lit(False)))


def surviving_rows(tables: dict[str, DataFrame], plan: DataFrame) -> dict[str, DataFrame]:
    """Apply the unblocked part of a delete plan: deleted rows go, SET NULL references become NULL."""
    done = plan.where("NOT blocked")
    gone_all = done.where("action = 'delete'").select("table_name", "key").distinct()
    null_all = done.where("action = 'set_null'").select("via", "key").distinct()
    out = {}
    for t, df in tables.items():
        pk = PRIMARY_KEYS[t]
        kind = df.schema[pk].dataType
        gone = gone_all.where(F.col("table_name") == t).select(F.col("key").cast(kind).alias(pk))
        left = df.join(gone, pk, "left_anti")
        for fk in FOREIGN_KEYS:
            if fk.child == t and fk.on_delete == "set_null" and fk.column in df.columns:
                cleared = null_all.where(F.col("via") == f"{t}.{fk.column}").select(
                    F.col("key").cast(kind).alias(pk), F.lit(True).alias("_cleared"))
                left = left.join(cleared, pk, "left").withColumn(
                    fk.column, F.when(F.col("_cleared").isNull(), F.col(fk.column))).drop("_cleared")
        out[t] = left.select(*df.columns)
    return out


def key_sum(key: str) -> Column:
    """Aggregate: the exact sum of a whole-number key as text, whatever its size (null without keys).

    Packed keys have up to 38 digits, so their sum may not fit a decimal: thirds
    of 13 digits are summed apart and put together at the end.
    """
    k = F.col(key).cast("decimal(38,0)")
    # not abs(): Spark rounds decimals of more than 34 digits there
    digits, sign = F.lpad(F.ltrim(k.cast("string"), F.lit("-")), 39, "0"), F.when(k < 0, -1).otherwise(1)
    third = [F.sum((F.substring(digits, i, 13).cast("bigint") * sign).cast("decimal(20,0)")) for i in (1, 14, 27)]
    base = F.lit(10 ** 13)

    def carried(high, mid, low):
        mid = mid + F.call_function("div", low - F.pmod(low, base), base)
        return (high + F.call_function("div", mid - F.pmod(mid, base), base),
                *(F.pmod(x, base).cast("bigint").cast("string") for x in (mid, low)))
    up, down = carried(*third), carried(*(-x for x in third))
    minus = up[0] < 0
    high, mid, low = (F.when(minus, y).otherwise(x) for x, y in zip((up[0].cast("string"), *up[1:]),
                                                                   (down[0].cast("string"), *down[1:])))
    text = F.ltrim(F.concat(high, F.lpad(mid, 13, "0"), F.lpad(low, 13, "0")), F.lit("0"))
    return F.concat(F.when(minus, "-").otherwise(""), F.when(text == "", "0").otherwise(text))


# -- J-08 + S-09 ----------------------------------------------------------------------------
def owned_delete(products: DataFrame, order_items: DataFrame, requests: DataFrame) -> DataFrame:
    """Classify (product_id, business_id) delete requests.

    ``not_owned``: no product with that pair (J-08, the permission check);
    ``blocked``: owned but referenced by an order item (RESTRICT makes the
    DELETE fail); ``deleted`` otherwise.
    """
    owned = products.select("product_id", "business_id").withColumn("_owned", F.lit(True))
    sold = order_items.where(F.col("product_id").isNotNull()).select("product_id").distinct() \
                      .withColumn("_sold", F.lit(True))
    r = requests.join(owned, ["product_id", "business_id"], "left").join(sold, "product_id", "left")
    status = F.when(F.col("_owned").isNull(), "not_owned").when(F.col("_sold"), "blocked") \
              .otherwise("deleted")
    return r.select("product_id", "business_id", status.alias("status"))


def products_after_delete(products: DataFrame, classified: DataFrame) -> DataFrame:
    """S-09 survivors: the product snapshot without the deleted ones."""
    gone = classified.where(F.col("status") == "deleted").select("product_id")
    return products.join(gone, "product_id", "left_anti")


def delete_owned(products: VersionedTable, order_items: DataFrame, requests: DataFrame, batch: str) -> DataFrame:
    """J-08 + S-09 on a stored table: the requests' statuses, after the deleted products are gone.

    Statuses are judged on the version that the delete started from, also when
    the batch runs again; a commit between is a ``ConcurrentChange``.
    """
    done = products.committed(batch)
    base = products.version() if done is None else done - 1
    before = products.read(base)
    status = owned_delete(before, order_items, requests)
    if done is None:
        products.replace(products_after_delete(before, status), batch, base)
    return status


def discount_migration(products: DataFrame) -> DataFrame:
    """S-07 (re-exported for the registry)."""
    return migrate_discount(products)
