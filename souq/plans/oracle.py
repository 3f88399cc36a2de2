"""DuckDB statements that independently compute each registered query.

Each statement is written against the ``m_*`` views of ``oracle_views`` the
way the reference writes its SQL (joins, GROUP BY, ORDER BY ... LIMIT,
correlated lookups as ROW_NUMBER), with the tie-breakers and NULL ordering
made explicit (DuckDB sorts NULLs last by default, Spark and MySQL first).
"""

from __future__ import annotations

from typing import NamedTuple

from souq.functions.labels import BUSINESS_CATEGORIES, UNKNOWN_LABEL
from souq.plans.oracle_views import with_views

_FIRST_IMAGE = """
    SELECT product_id, image_path AS image FROM (
        SELECT product_id, image_path,
               ROW_NUMBER() OVER (PARTITION BY product_id
                                  ORDER BY display_order ASC NULLS FIRST, image_id ASC NULLS FIRST) AS rn
        FROM m_product_images WHERE is_primary) x
    WHERE rn = 1"""

_P_COLS = ("p.product_id, p.business_id, p.category_id, p.name, p.slug, p.price, p.stock_quantity, "
           "p.discount_percent, p.is_featured, p.is_active, p.total_sales, p.created_at")


def _card(top_sql: str, order_by: str) -> str:
    return f"""
    WITH top AS ({top_sql}),
         img AS ({_FIRST_IMAGE})
    SELECT top.*, t.description, img.image
    FROM top LEFT JOIN m_product_text t ON t.product_id = top.product_id
             LEFT JOIN img ON img.product_id = top.product_id
    ORDER BY {order_by}"""


_SELF_OR_CHILDREN = "SELECT category_id FROM m_categories WHERE parent_id = 2 OR category_id = 2"

_SEARCHED = f"""
    SELECT p.*, t.description
    FROM m_products p LEFT JOIN m_product_text t ON t.product_id = p.product_id
    WHERE (p.name ILIKE '%red%' OR t.description ILIKE '%red%')
      AND p.category_id IN ({_SELF_OR_CHILDREN})"""

_FMT = "format('{{:,.2f}}', {x})"


def _money(x: str) -> str:
    return "'₹' || " + _FMT.format(x=f"round({x}, 2)")


# X-06 with byte semantics: keep the longest character prefix of at most 100
# UTF-8 bytes, back up to its last space, append '...'.
_TEASER = """CASE WHEN t.description IS NULL THEN NULL
     WHEN strlen(t.description) <= 100 THEN t.description
     ELSE regexp_extract(substr(t.description, 1,
              list_max(list_filter(range(0, 101), lambda i: strlen(substr(t.description, 1, i)) <= 100))),
              '(?s)^(.*) ', 1) || '...' END"""

_TRIM_RE = r"'^[ \t\n\r\x00\x0B]+|[ \t\n\r\x00\x0B]+$'"


def _esc(x: str) -> str:
    """htmlspecialchars(trim(x), ENT_QUOTES)"""
    t = f"regexp_replace({x}, {_TRIM_RE}, '', 'g')"
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&#039;")):
        t = f"replace({t}, '{a}', '{b}')"
    return t


def _empty(x: str) -> str:
    return f"({x} IS NULL OR {x} = '' OR {x} = '0')"


_FLOATVAL = (r"coalesce(TRY_CAST(regexp_extract({x}, '^[ \t\n\r\x0B\f]*([+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)"
             r"([eE][+-]?[0-9]+)?)', 1) AS DOUBLE), 0.0)")
_INTVAL = r"coalesce(TRY_CAST(regexp_extract({x}, '^[ \t\n\r\x0B\f]*([+-]?[0-9]+)', 1) AS BIGINT), 0)"

_PRODUCT_CANDIDATES = """
    SELECT p_partkey AS arrival_no, p_partkey % 100 AS business_id,
           CASE WHEN p_partkey % 11 = 0 THEN '  ' ELSE p_name END AS name,
           d.text AS description,
           CASE WHEN p_partkey % 13 = 0 THEN 'x' || p_brand ELSE substr(p_brand, 7, 10) END AS category,
           CASE WHEN p_partkey % 17 = 0 THEN '-' ELSE '' END || CAST(p_size AS VARCHAR) || '.'
             || CAST(p_partkey % 100 AS VARCHAR) || CASE WHEN p_partkey % 4 = 0 THEN 'usd' ELSE '' END AS price,
           CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE CAST(p_size * 3 AS VARCHAR) END AS discount,
           CASE WHEN p_partkey % 19 = 0 THEN NULL
                ELSE lower(p_type) || ' ' || CAST(p_partkey AS VARCHAR) || '.jpg' END AS image_name,
           CASE WHEN p_partkey % 7 = 0 THEN 'image/gif' ELSE 'image/jpeg' END AS image_type,
           CAST(p_size * 120000 AS BIGINT) AS image_size
    FROM part LEFT JOIN documents d ON d.doc_id = p_partkey"""

_USER_CANDIDATES = """
    SELECT c_custkey AS arrival_no,
           CASE WHEN c_custkey % 23 = 0 THEN '' ELSE c_name END AS first_name,
           c_mktsegment AS last_name,
           CASE WHEN c_custkey % 3 = 0 THEN upper('u' || CAST(c_custkey AS VARCHAR) || '@example.com ')
                WHEN c_custkey % 3 = 1 THEN 'new' || CAST(c_custkey % 500 AS VARCHAR) || '@Example.com'
                ELSE 'bad-email-' || CAST(c_custkey AS VARCHAR) END AS email,
           CASE WHEN c_custkey % 7 = 0 THEN '555-' || CAST(c_custkey AS VARCHAR)
                ELSE CAST(5550000 + c_custkey AS VARCHAR) END AS phone,
           CASE WHEN c_custkey % 11 = 0 THEN 'short' ELSE 'pw' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') END
             AS password,
           CASE WHEN c_custkey % 13 = 0 THEN 'mismatch!'
                WHEN c_custkey % 11 = 0 THEN 'short' ELSE 'pw' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') END
             AS confirm_password,
           CASE WHEN c_mktsegment = 'MACHINERY' THEN 'business' ELSE 'customer' END AS registration_type
    FROM customer"""

_EMAIL_RE = ("'^[A-Za-z0-9!#$%&''*+/=?^_`{|}~.-]{1,64}@[A-Za-z0-9]([A-Za-z0-9-]{0,61}[A-Za-z0-9])?"
             "(\\.[A-Za-z0-9]([A-Za-z0-9-]{0,61}[A-Za-z0-9])?)+$'")


def _ekey(x: str) -> str:
    return f"lower(strip_accents(rtrim({x})))"


class Reference(NamedTuple):
    child: str
    column: str
    parent: str
    parent_key: str
    on_delete: str


# Fixed values of the schema: the references between the tables that the views carry, with their delete actions.
_REFERENCES = """
    categories.parent_id         categories.category_id   set_null
    businesses.user_id           users.user_id            cascade
    products.business_id         businesses.business_id   cascade
    products.category_id         categories.category_id   restrict
    product_images.product_id    products.product_id      cascade
    product_reviews.product_id   products.product_id      cascade
    product_reviews.user_id      users.user_id            cascade
    cart_items.user_id           users.user_id            cascade
    cart_items.product_id        products.product_id      cascade
    orders.user_id               users.user_id            cascade
    order_items.order_id         orders.order_id          cascade
    order_items.product_id       products.product_id      restrict
    order_items.business_id      businesses.business_id   restrict
    wishlist_items.user_id       users.user_id            cascade
    wishlist_items.product_id    products.product_id      cascade
    forum_topics.created_by      users.user_id            cascade
    forum_posts.topic_id         forum_topics.topic_id    cascade
    forum_posts.user_id          users.user_id            cascade"""
_FKS = [Reference(*child.split("."), *parent.split("."), action)
        for child, parent, action in (line.split() for line in _REFERENCES.split("\n") if line.strip())]
# Fixed values of the schema: primary keys, and the other unique keys.
PRIMARY_KEYS = dict(users="user_id", businesses="business_id", categories="category_id", products="product_id",
                    product_images="image_id", product_reviews="review_id", orders="order_id",
                    order_items="order_item_id", cart_items="cart_item_id", wishlist_items="wishlist_id",
                    forum_topics="topic_id", forum_posts="post_id")
UNIQUE_KEYS = [("users", ("username",)), ("users", ("email",)), ("businesses", ("business_slug",)),
               ("categories", ("category_slug",)), ("products", ("slug",)), ("forum_topics", ("slug",)),
               ("cart_items", ("user_id", "product_id")), ("wishlist_items", ("user_id", "product_id"))]

# Fixed values of the schema, written down here apart from the operators' lists, for the columns that the
# views carry: a constraint that is wrong or absent there shows as a difference.
NOT_NULL = {
    "users": "user_id username first_name last_name email role is_verified created_at".split(),
    "businesses": "business_id user_id business_name business_slug city state status created_at".split(),
    "categories": "category_id category_name category_slug is_active".split(),
    "products": "product_id business_id category_id name slug price stock_quantity created_at".split(),
    "product_images": "image_id product_id image_path".split(),
    "product_reviews": "review_id product_id user_id rating created_at".split(),
    "orders": ("order_id user_id order_status payment_status subtotal shipping_cost tax_amount discount_amount "
               "total_amount created_at").split(),
    "order_items": ("order_item_id order_id product_id business_id quantity price discount_amount total_amount "
                    "status created_at").split(),
    "cart_items": "cart_item_id user_id product_id quantity created_at".split(),
    "wishlist_items": "wishlist_id user_id product_id created_at".split(),
    "forum_topics": "topic_id title slug created_by is_sticky created_at".split(),
    "forum_posts": "post_id topic_id user_id content is_solution created_at".split(),
}
VARCHAR_LIMITS = {
    "users": dict(username=50, first_name=50, last_name=50, email=100, phone=20),
    "businesses": dict(business_name=100, business_slug=100, city=100, state=100),
    "categories": dict(category_name=100, category_slug=100),
    "products": dict(name=255, slug=255),
    "product_images": dict(image_path=255),
    "forum_topics": dict(title=255, slug=255),
}
_MONEY = (10, 2)
DECIMAL_SHAPES = {
    "products": dict(price=_MONEY, discount_percent=(5, 2)),
    "orders": dict(subtotal=_MONEY, shipping_cost=_MONEY, tax_amount=_MONEY, discount_amount=_MONEY,
                   total_amount=_MONEY),
    "order_items": dict(price=_MONEY, discount_amount=_MONEY, total_amount=_MONEY),
}
ENUMS = {
    ("users", "role"): ("customer", "business_owner", "admin"),
    ("businesses", "status"): ("pending", "active", "suspended"),
    ("orders", "order_status"): ("pending", "processing", "shipped", "delivered", "cancelled"),
    ("orders", "payment_status"): ("pending", "paid", "failed", "refunded"),
    ("order_items", "status"): ("pending", "processing", "shipped", "delivered", "cancelled", "returned"),
}

MAPPED = {"users", "businesses", "categories", "products", "product_images", "product_reviews",
          "orders", "order_items", "cart_items", "wishlist_items", "forum_topics", "forum_posts"}
_COLLATED = {"username", "email", "category_slug", "business_slug", "slug"}


def _orphans() -> str:
    parts = [f"""SELECT '{fk.child}' AS child_table, '{fk.column}' AS child_column,
                        '{fk.parent}' AS parent_table, count(DISTINCT c.{fk.column}) AS orphan_keys,
                        count(*) AS orphan_rows
                 FROM d_{fk.child} c
                 WHERE c.{fk.column} IS NOT NULL
                   AND c.{fk.column} NOT IN (SELECT {fk.parent_key} FROM d_{fk.parent}
                                             WHERE {fk.parent_key} IS NOT NULL)""" for fk in _FKS]
    return "\nUNION ALL\n".join(parts)


def _dup_keys() -> str:
    keys = [(t, (k,), "primary") for t, k in PRIMARY_KEYS.items()] + [(t, c, "unique") for t, c in UNIQUE_KEYS]
    parts = []
    for t, cols, kind in keys:
        if t not in MAPPED:
            continue
        exprs = ", ".join(_ekey(c) if c in _COLLATED else c for c in cols)
        parts.append(f"""SELECT '{t}' AS table_name, '{",".join(cols)}' AS key_name, '{kind}' AS key_kind,
                            count(*) AS duplicate_keys, CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS excess_rows
                         FROM (SELECT count(*) AS n FROM d_{t} GROUP BY {exprs} HAVING count(*) > 1) g""")
    return "\nUNION ALL\n".join(parts)


def _enums() -> str:
    parts = []
    for (t, c), dom in ENUMS.items():
        if t not in MAPPED:
            continue
        vals = ", ".join(f"'{x}'" for x in dom)
        parts.append(f"""SELECT '{t}' AS table_name, '{c}' AS column_name,
                            count(*) FILTER (WHERE {c} IS NOT NULL AND {c} NOT IN ({vals})) AS bad_rows
                         FROM d_{t}""")
    return "\nUNION ALL\n".join(parts)


def _per_column(spec: dict, cond) -> str:
    parts = []
    for t, cols in spec.items():
        if t not in MAPPED:
            continue
        for c in cols:
            parts.append(f"""SELECT '{t}' AS table_name, '{c}' AS column_name,
                                count(*) FILTER (WHERE {cond(t, c)}) AS {{name}} FROM d_{t}""")
    return "\nUNION ALL\n".join(parts)


def _len_cond(t, c):
    if c in VARCHAR_LIMITS.get(t, {}):
        return f"length({c}) > {VARCHAR_LIMITS[t][c]}"
    p, s = DECIMAL_SHAPES[t][c]
    return f"{c} IS NOT NULL AND TRY_CAST({c} AS DECIMAL({p},{s})) IS NULL"


_LEN_SPEC: dict = {}
for _t, _c in VARCHAR_LIMITS.items():
    _LEN_SPEC.setdefault(_t, []).extend(_c)
for _t, _c in DECIMAL_SHAPES.items():
    _LEN_SPEC.setdefault(_t, []).extend(_c)


def _column_violations() -> str:
    parts = []
    for t in MAPPED:
        for c in NOT_NULL.get(t, []):
            parts.append(f"SELECT '{t}' AS table_name, '{c}' AS column_name, 'not_null' AS \"check\", "
                         f"count(*) FILTER (WHERE {c} IS NULL) AS bad_rows FROM d_{t}")
        for c in _LEN_SPEC.get(t, []):
            parts.append(f"SELECT '{t}', '{c}', 'length', count(*) FILTER (WHERE {_len_cond(t, c)}) FROM d_{t}")
        for (et, c), dom in ENUMS.items():
            if et == t:
                vals = ", ".join(f"'{x}'" for x in dom)
                parts.append(f"SELECT '{t}', '{c}', 'enum', "
                             f"count(*) FILTER (WHERE {c} IS NOT NULL AND {c} NOT IN ({vals})) FROM d_{t}")
    return "\nUNION ALL\n".join(parts)


def _delete_plan() -> str:
    act = {"cascade": "delete", "set_null": "set_null", "restrict": "restrict"}
    edges = "\nUNION ALL\n".join(
        f"SELECT '{fk.child}' AS ct, CAST({PRIMARY_KEYS[fk.child]} AS DECIMAL(38,0)) AS ck, '{fk.parent}' AS pt, {fk.column} AS pk, "
        f"'{act[fk.on_delete]}' AS action, '{fk.child}.{fk.column}' AS via FROM m_{fk.child}" for fk in _FKS)
    return f"""
        WITH RECURSIVE edges AS ({edges}),
        closure(root_key, table_name, key, via) AS (
            SELECT user_id, 'users', CAST(user_id AS DECIMAL(38,0)), CAST(NULL AS VARCHAR) FROM m_users WHERE NOT is_verified
            UNION
            SELECT c.root_key, e.ct, e.ck, e.via
            FROM closure c JOIN edges e ON e.pt = c.table_name AND e.pk = c.key AND e.action = 'delete'),
        plan AS (
            SELECT DISTINCT root_key, table_name, key, 'delete' AS action, via FROM closure
            UNION
            SELECT DISTINCT c.root_key, e.ct, e.ck, e.action, e.via
            FROM closure c JOIN edges e ON e.pt = c.table_name AND e.pk = c.key
            WHERE e.action IN ('set_null', 'restrict')),
        blocked AS (
            SELECT DISTINCT r.root_key FROM plan r
            WHERE r.action = 'restrict'
              AND NOT EXISTS (SELECT 1 FROM plan d WHERE d.action = 'delete' AND d.root_key = r.root_key
                                AND d.table_name = r.table_name AND d.key = r.key))
        SELECT p.*, b.root_key IS NOT NULL AS blocked
        FROM plan p LEFT JOIN blocked b ON b.root_key = p.root_key"""


def _delete_survivors() -> str:
    """Counts and key sums of what is left; no SET NULL edge is reached from users."""
    parts = "\nUNION ALL\n".join(
        f"SELECT '{t}' AS table_name, count(*) AS rows, CAST(CAST(sum(CAST({PRIMARY_KEYS[t]} AS HUGEINT)) AS HUGEINT) "
        f"AS VARCHAR) AS key_sum FROM m_{t} WHERE {PRIMARY_KEYS[t]} NOT IN (SELECT key FROM del WHERE table_name = '{t}')"
        for t in sorted(MAPPED))
    plan = _delete_plan().strip()
    cut = plan.rindex("SELECT p.*")
    return f"""{plan[:cut].rstrip()},
        del AS (SELECT p.table_name, p.key FROM plan p WHERE p.action = 'delete'
                AND p.root_key NOT IN (SELECT root_key FROM blocked))
        {parts}"""


# The badge of every business category code, in the schema's order, then an unknown and an empty code.
_BADGES = list(BUSINESS_CATEGORIES.values()) + [UNKNOWN_LABEL, None]
_CARD_BADGES = " ".join(f"WHEN business_id % {len(_BADGES)} = {i} THEN " + ("NULL" if x is None else "'" + x.replace("'", "''") + "'")
                        for i, x in enumerate(_BADGES))

SQL: dict[str, str] = {
    "top_deals": _card(f"""
        SELECT {_P_COLS}, b.business_name,
               CAST(ROUND(p.price * (1 - p.discount_percent * 0.01), 2) AS DECIMAL(18,2)) AS discounted_price
        FROM m_products p INNER JOIN m_businesses b ON p.business_id = b.business_id
        WHERE p.discount_percent > 0
        ORDER BY p.discount_percent DESC, p.product_id
        LIMIT 4""", "top.discount_percent DESC, top.product_id"),
    "newest_products": _card(f"""
        SELECT {_P_COLS}, b.business_name
        FROM m_products p INNER JOIN m_businesses b ON p.business_id = b.business_id
        ORDER BY p.created_at DESC, p.product_id
        LIMIT 8""", "top.created_at DESC, top.product_id"),
    "trending_sample": _card(f"""
        SELECT {_P_COLS}, b.business_name
        FROM m_products p INNER JOIN m_businesses b ON p.business_id = b.business_id
        ORDER BY md5(CAST(p.product_id AS VARCHAR) || '-' || '42'), p.product_id
        LIMIT 8""", "md5(CAST(top.product_id AS VARCHAR) || '-' || '42')"),
    "newest_businesses": """
        SELECT b.*, COUNT(p.product_id) AS product_count
        FROM m_businesses b LEFT JOIN m_products p ON b.business_id = p.business_id
        GROUP BY ALL
        ORDER BY b.created_at DESC, b.business_id
        LIMIT 4""",
    "business_product_counts": """
        SELECT b.*, COUNT(p.product_id) AS product_count
        FROM m_businesses b LEFT JOIN m_products p ON b.business_id = p.business_id
        GROUP BY ALL""",
    "first_images": _FIRST_IMAGE,
    "category_tree": """
        SELECT r.category_id AS root_id, r.category_name AS root_name,
               c.category_id AS child_id, c.category_name AS child_name,
               CASE WHEN c.category_id IS NULL THEN NULL
                    ELSE ROW_NUMBER() OVER (PARTITION BY r.category_id
                                            ORDER BY lower(c.category_name), c.category_id) END
                 AS child_position
        FROM m_categories r LEFT JOIN m_categories c ON c.parent_id = r.category_id
        WHERE r.parent_id IS NULL OR r.parent_id = 0""",
    "category_names": """
        SELECT category_id, category_name, parent_id FROM m_categories
        ORDER BY lower(category_name), category_id""",
    "category_products": f"""
        SELECT p.product_id, p.business_id, p.category_id, p.name, p.price, p.created_at
        FROM m_products p WHERE p.category_id IN ({_SELF_OR_CHILDREN})""",
    "category_product_counts": """
        SELECT c.category_id, c.category_name, COUNT(p.product_id) AS product_count
        FROM m_categories c
        LEFT JOIN m_categories k ON k.parent_id = c.category_id OR k.category_id = c.category_id
        LEFT JOIN m_products p ON p.category_id = k.category_id
        GROUP BY ALL""",
    "catalog_page": """
        SELECT x.*, c.category_name FROM (
            SELECT p.*, t.description,
                   ROW_NUMBER() OVER (PARTITION BY p.business_id
                                      ORDER BY p.created_at DESC, p.product_id) - 10 AS page_position
            FROM m_products p LEFT JOIN m_product_text t ON t.product_id = p.product_id) x
        LEFT JOIN m_categories c ON c.category_id = x.category_id
        WHERE x.page_position BETWEEN 1 AND 10""",
    "catalog_search": f"""
        SELECT x.*, c.category_name FROM (
            SELECT s.*, ROW_NUMBER() OVER (PARTITION BY s.business_id
                                           ORDER BY s.created_at DESC, s.product_id) AS page_position
            FROM ({_SEARCHED}) s) x
        LEFT JOIN m_categories c ON c.category_id = x.category_id
        WHERE x.page_position <= 10""",
    "catalog_count": f"""
        SELECT b.business_id, COUNT(f.product_id) AS total_products,
               CAST(ceil(COUNT(f.product_id) / 10.0) AS BIGINT) AS total_pages
        FROM m_businesses b LEFT JOIN ({_SEARCHED}) f ON f.business_id = b.business_id
        GROUP BY b.business_id""",
    "listing_labels": f"""
        SELECT p.product_id,
               {_money('p.price * 75')} AS price_label,
               {_money('CAST(ROUND(p.price * (1 - coalesce(p.discount_percent, 0) * 0.01), 2) AS DECIMAL(18,2)) * 75')}
                 AS deal_price_label,
               {_money('p.price')} AS seller_price_label,
               CASE WHEN coalesce(p.discount_percent, 0) > 0
                    THEN {_money('p.price - p.price * (coalesce(p.discount_percent, 0) * 0.01)')} END
                 AS seller_deal_label,
               CAST(CAST(round(coalesce(p.discount_percent, 0), 0) AS INTEGER) AS VARCHAR) || '% OFF'
                 AS discount_label,
               CASE WHEN coalesce(p.discount_percent, 0) > 0
                    THEN CAST(coalesce(p.discount_percent, 0) AS VARCHAR) || '% OFF' ELSE '-' END
                 AS discount_badge,
               strftime(p.created_at, '%b %-d, %Y') AS date_label,
               {_TEASER} AS teaser,
               lower(trim(regexp_replace(p.name, '[^a-zA-Z0-9-]+', '-', 'g'), '-')) AS name_slug
        FROM m_products p LEFT JOIN m_product_text t ON t.product_id = p.product_id""",
    "product_ratings": """
        SELECT p.product_id,
               CAST(coalesce(((r.s * 20000 + r.n) // (r.n * 2) + 500) // 1000, 0) * 0.1 AS DECIMAL(4,1))
                 AS avg_rating,
               coalesce(r.c, 0) AS review_count
        FROM m_products p LEFT JOIN (
            SELECT product_id, CAST(sum(rating) AS BIGINT) AS s, count(rating) AS n, count(*) AS c
            FROM m_product_reviews GROUP BY product_id) r ON r.product_id = p.product_id""",
    "product_intake": f"""
        WITH c AS (
            SELECT arrival_no, {_esc("coalesce(name, '')")} AS name,
                   {_esc("coalesce(description, '')")} AS description,
                   {_INTVAL.format(x="category")} AS category_id,
                   {_FLOATVAL.format(x="price")} AS price,
                   CASE WHEN discount IS NULL THEN 0.0 ELSE {_FLOATVAL.format(x="discount")} END AS discount,
                   image_name, image_type, image_size
            FROM ({_PRODUCT_CANDIDATES}) x),
        e AS (
            SELECT *, list_filter([
                CASE WHEN {_empty("name")} THEN 'name_required' END,
                CASE WHEN {_empty("description")} THEN 'description_required' END,
                CASE WHEN category_id <= 0 THEN 'category_invalid' END,
                CASE WHEN price <= 0 THEN 'price_invalid' END,
                CASE WHEN discount < 0 OR discount > 100 THEN 'discount_out_of_range' END,
                CASE WHEN image_name IS NULL THEN 'image_required' END,
                CASE WHEN image_name IS NOT NULL
                      AND coalesce(image_type NOT IN ('image/jpeg', 'image/png', 'image/jpg'), TRUE)
                     THEN 'image_type_invalid' END,
                CASE WHEN image_name IS NOT NULL AND coalesce(image_size, 0) > 5000000
                     THEN 'image_too_large' END], lambda x: x IS NOT NULL) AS errs
            FROM c)
        SELECT arrival_no, name, category_id, price, discount,
               array_to_string(errs, ',') AS error_codes, len(errs) = 0 AS is_valid
        FROM e""",
    "user_intake": f"""
        WITH c AS (
            SELECT arrival_no, {_esc("first_name")} AS first_name, {_esc("last_name")} AS last_name,
                   {_esc("email")} AS email, {_esc("phone")} AS phone, password, confirm_password,
                   registration_type
            FROM ({_USER_CANDIDATES}) x),
        r AS (
            SELECT *, CASE
                WHEN {_empty("first_name")} OR {_empty("last_name")} OR {_empty("email")} OR {_empty("phone")}
                  OR {_empty("password")} OR {_empty("confirm_password")} THEN 'fields_required'
                WHEN NOT coalesce(regexp_full_match(email, {_EMAIL_RE}) AND NOT starts_with(email, '.')
                          AND position('..' IN email) = 0 AND NOT contains(email, '.@'), FALSE)
                  THEN 'email_invalid'
                WHEN NOT coalesce(regexp_full_match(phone, '[0-9]+'), FALSE) THEN 'phone_invalid'
                WHEN strlen(password) < 8 THEN 'password_too_short'
                WHEN password <> confirm_password THEN 'password_mismatch' END AS rule_error
            FROM c),
        w AS (
            SELECT min(arrival_no) AS arrival_no FROM r
            WHERE rule_error IS NULL
              AND {_ekey("email")} NOT IN (SELECT {_ekey("email")} FROM m_users)
            GROUP BY {_ekey("email")})
        SELECT r.arrival_no, first_name, last_name, email, phone,
               CASE WHEN registration_type = 'business' THEN 'business_owner' ELSE 'customer' END AS role,
               CASE WHEN rule_error IS NULL AND w.arrival_no IS NOT NULL THEN
                 lower(first_name || '.' || last_name
                       || CAST(100 + ('0x' || substr(md5(email), 1, 8))::BIGINT % 900 AS VARCHAR)) END AS username,
               CASE WHEN rule_error IS NOT NULL THEN rule_error
                    WHEN w.arrival_no IS NULL THEN 'email_in_use' END AS error
        FROM r LEFT JOIN w ON w.arrival_no = r.arrival_no""",
    "slug_collisions": """
        SELECT slug, count(*) AS rows, slug = '' AS is_empty
        FROM (SELECT lower(trim(regexp_replace(name, '[^a-zA-Z0-9-]+', '-', 'g'), '-')) AS slug
              FROM m_products) s
        GROUP BY slug HAVING count(*) > 1 OR slug = ''""",
    "role_counts": """
        SELECT role, count(*) AS users FROM m_users GROUP BY role""",
    "orphans": _orphans(),
    "duplicate_keys": _dup_keys(),
    "enum_violations": _enums(),
    "null_violations": _per_column(NOT_NULL, lambda t, c: f"{c} IS NULL").replace("{name}", "null_rows"),
    "length_violations": _per_column(_LEN_SPEC, _len_cond).replace("{name}", "bad_rows"),
    "column_violations": _column_violations(),
    "delete_plan": _delete_plan(),
    "owned_delete": """
        SELECT r.product_id, r.business_id,
               CASE WHEN p.product_id IS NULL THEN 'not_owned'
                    WHEN EXISTS (SELECT 1 FROM m_order_items oi WHERE oi.product_id = r.product_id) THEN 'blocked'
                    ELSE 'deleted' END AS status
        FROM (SELECT DISTINCT product_id, business_id FROM m_order_items WHERE status = 'returned') r
        LEFT JOIN m_products p ON p.product_id = r.product_id AND p.business_id = r.business_id""",
    "discount_migration": """
        SELECT product_id,
               CASE WHEN d = 0 AND discount_percent > 0 THEN discount_percent ELSE d END AS discount
        FROM (SELECT product_id, discount_percent,
                     CAST(CASE WHEN product_id % 3 = 0 THEN 0 WHEN product_id % 3 = 1 THEN NULL
                               ELSE stock_quantity END AS DECIMAL(5,2)) AS d
              FROM m_products) x""",
    "browse_facets": """
        SELECT count(*) FILTER (WHERE discount_percent > 0) AS deal_products,
               count(*) FILTER (WHERE is_featured) AS featured_products,
               count(*) FILTER (WHERE is_active) AS active_products,
               count(*) AS all_products
        FROM m_products""",
    "trending_by_sales": """
        SELECT product_id, name, total_sales FROM m_products
        ORDER BY total_sales DESC, product_id LIMIT 8""",
    "category_page": """
        SELECT p.product_id, p.name, p.price, p.category_id, c.category_name
        FROM m_products p LEFT JOIN m_categories c ON c.category_id = p.category_id
        WHERE p.category_id IN (
            SELECT k.category_id FROM m_categories k JOIN m_categories s
              ON (k.parent_id = s.category_id OR k.category_id = s.category_id)
            WHERE s.category_slug = 'america')""",
    "product_detail": f"""
        SELECT p.product_id, p.name,
               (SELECT count(*) FROM m_product_images i WHERE i.product_id = p.product_id) AS image_count,
               img.image AS primary_image,
               CAST(coalesce(((r.s * 20000 + r.n) // (r.n * 2) + 500) // 1000, 0) * 0.1 AS DECIMAL(4,1))
                 AS avg_rating,
               coalesce(r.c, 0) AS review_count
        FROM m_products p
        LEFT JOIN ({_FIRST_IMAGE}) img ON img.product_id = p.product_id
        LEFT JOIN (SELECT product_id, CAST(sum(rating) AS BIGINT) AS s, count(rating) AS n, count(*) AS c
                   FROM m_product_reviews GROUP BY product_id) r ON r.product_id = p.product_id""",
    "cart_totals": """
        SELECT c.user_id, count(*) AS cart_lines, CAST(sum(c.quantity) AS BIGINT) AS cart_units,
               CAST(sum(c.quantity * p.price) AS DECIMAL(18,2)) AS cart_value
        FROM m_cart_items c LEFT JOIN m_products p ON p.product_id = c.product_id
        GROUP BY c.user_id""",
    "order_history": """
        SELECT o.user_id, count(*) AS orders, min(o.created_at) AS first_order_at,
               max(o.created_at) AS last_order_at, CAST(sum(o.total_amount) AS DECIMAL(18,2)) AS total_spent,
               CAST(coalesce(sum((SELECT count(*) FROM m_order_items i WHERE i.order_id = o.order_id)), 0)
                    AS BIGINT) AS order_lines
        FROM m_orders o GROUP BY o.user_id""",
    "order_funnel": """
        SELECT order_status, payment_status, count(*) AS orders,
               CAST(sum(total_amount) AS DECIMAL(18,2)) AS amount
        FROM m_orders GROUP BY order_status, payment_status""",
    "order_reconciliation": """
        SELECT order_id, subtotal, items_total, CAST(subtotal - items_total AS DECIMAL(18,2)) AS items_gap,
               CAST(total_amount - (subtotal + shipping_cost + tax_amount - discount_amount) AS DECIMAL(18,2))
                 AS total_gap
        FROM (SELECT o.*, CAST(coalesce((SELECT sum(i.total_amount) FROM m_order_items i
                                         WHERE i.order_id = o.order_id), 0) AS DECIMAL(18,2)) AS items_total
              FROM m_orders o) x
        WHERE subtotal - items_total <> 0
           OR total_amount - (subtotal + shipping_cost + tax_amount - discount_amount) <> 0""",
    "seller_sales": """
        SELECT business_id, CAST(sum(total_amount) AS DECIMAL(18,2)) AS revenue,
               CAST(sum(quantity) AS BIGINT) AS units, count(DISTINCT order_id) AS orders
        FROM m_order_items WHERE status NOT IN ('cancelled', 'returned')
        GROUP BY business_id""",
    "total_sales_refresh": """
        SELECT p.product_id, CAST(coalesce(sum(i.quantity), 0) AS BIGINT) AS total_sales
        FROM m_products p LEFT JOIN m_order_items i
          ON i.product_id = p.product_id AND i.status NOT IN ('cancelled', 'returned')
        GROUP BY p.product_id""",
    "platform_stats": """
        SELECT 'users_by_role' AS metric_group, role AS metric_key, count(*) AS value FROM m_users GROUP BY role
        UNION ALL
        SELECT 'businesses_by_status', status, count(*) FROM m_businesses GROUP BY status
        UNION ALL
        SELECT 'orders_by_status', order_status, count(*) FROM m_orders GROUP BY order_status""",
    "verified_reviews": """
        SELECT r.review_id,
               EXISTS (SELECT 1 FROM m_orders o JOIN m_order_items i ON i.order_id = o.order_id
                       WHERE o.user_id = r.user_id AND i.product_id = r.product_id) AS verified_purchase
        FROM m_product_reviews r""",
    "topic_activity": """
        SELECT t.topic_id, t.title, t.is_sticky, count(p.post_id) AS posts, max(p.created_at) AS last_post_at
        FROM m_forum_topics t LEFT JOIN m_forum_posts p ON p.topic_id = t.topic_id
        GROUP BY t.topic_id, t.title, t.is_sticky""",
    "wishlist_top": """
        SELECT w.product_id, p.name, w.wishes
        FROM (SELECT product_id, count(*) AS wishes FROM m_wishlist_items GROUP BY product_id
              ORDER BY wishes DESC, product_id LIMIT 10) w
        LEFT JOIN m_products p ON p.product_id = w.product_id""",
    "seller_business": """
        SELECT u.user_id, b.business_id, b.business_id IS NULL AS needs_profile
        FROM m_users u LEFT JOIN m_businesses b ON b.user_id = u.user_id
        WHERE u.role = 'business_owner'""",
    "business_cards": f"""
        SELECT business_id, business_name,
               CASE WHEN business_id % 3 = 0 THEN 'logos/' || business_id
                    ELSE 'assets/images/business-placeholder.jpg' END AS logo,
               CASE WHEN business_id % 4 <> 0 AND city IS NOT NULL AND state IS NOT NULL
                    THEN city || ', ' || state WHEN business_id % 8 = 0 AND state IS NOT NULL THEN 'near ' || state
                    ELSE 'Location not specified' END AS location,
               CASE {_CARD_BADGES} END AS category_badge
        FROM m_businesses""",
    "delete_survivors": _delete_survivors(),
    "seller_page": """
        SELECT p.*, t.description, c.category_name
        FROM m_products p LEFT JOIN m_product_text t ON t.product_id = p.product_id
             LEFT JOIN m_categories c ON c.category_id = p.category_id
        WHERE p.business_id = 3
        ORDER BY p.created_at DESC, p.product_id LIMIT 10 OFFSET 10""",
    "seller_count": """
        SELECT count(*) AS total_products, CAST(ceil(count(*) / 10.0) AS BIGINT) AS total_pages
        FROM m_products WHERE business_id = 3""",
    "category_seed": """
        WITH b AS (SELECT DISTINCT CAST(regexp_extract(p_brand, '[0-9]+') AS BIGINT) AS category_id, p_brand FROM part)
        SELECT category_id, p_brand AS category_name,
               lower(trim(regexp_replace(p_brand, '[^a-zA-Z0-9-]+', '-', 'g'), '-')) AS category_slug,
               CAST(NULL AS BIGINT) AS parent_id FROM b
        UNION ALL
        SELECT (SELECT max(category_id) FROM b) + p_partkey + 1, p_type || ' ' || p_partkey,
               lower(trim(regexp_replace(p_type || ' ' || p_partkey, '[^a-zA-Z0-9-]+', '-', 'g'), '-')), b.category_id
        FROM part JOIN b USING (p_brand) WHERE p_partkey % 6 <> 5""",
    "dialect2_catalog": """
        SELECT c.category_id, c.category_name, count(p.product_id) AS product_count
        FROM m_categories c
        LEFT JOIN m_categories k ON k.category_id = c.category_id OR k.parent_id = c.category_id
        LEFT JOIN m_products p ON p.category_id = k.category_id
        GROUP BY ALL""",
    "unread_counts": """
        WITH m AS (SELECT conv_id AS user_id, count(*) AS n FROM conversations WHERE turn % 2 <> 0 GROUP BY 1),
             e AS (SELECT user_id, count(*) AS n FROM events
                   WHERE event_type = 'error' AND event_id % 3 <> 0 GROUP BY 1)
        SELECT coalesce(m.user_id, e.user_id) AS user_id, coalesce(m.n, 0) AS unread_messages,
               coalesce(e.n, 0) AS unread_notifications
        FROM m FULL JOIN e ON e.user_id = m.user_id""",
    "sellers_without_business": """
        SELECT u.user_id, u.username, u.email FROM m_users u
        WHERE u.role = 'business_owner'
          AND NOT EXISTS (SELECT 1 FROM m_businesses b WHERE b.user_id = u.user_id)""",
}

_SLUG = "lower(trim(regexp_replace({x}, '[^a-zA-Z0-9-]+', '-', 'g'), '-'))"
SQL["accepted_products"] = f"""
    WITH ok AS ({SQL["product_intake"]}),
    raw AS (SELECT arrival_no, business_id, name AS raw_name, description, image_name FROM ({_PRODUCT_CANDIDATES}) x)
    SELECT (SELECT max(product_id) FROM m_products) + ok.arrival_no AS product_id, raw.business_id, ok.category_id,
           ok.name, {_SLUG.format(x=f"regexp_replace(raw.raw_name, {_TRIM_RE}, '', 'g')")} AS slug,
           CAST(ok.price AS DECIMAL(10,2)) AS price,
           CAST(trunc(ok.discount) AS DECIMAL(5,2)) AS discount_percent,
           'uploads/products/1700000000_' || replace(raw.image_name, ' ', '_') AS image_path,
           md5({_esc("coalesce(raw.description, '')")}) AS description_md5
    FROM ok JOIN raw ON raw.arrival_no = ok.arrival_no WHERE ok.is_valid"""

SQL["product_detail_lists"] = """
    WITH every AS (
        SELECT product_id, 'image' AS kind, display_order AS o, image_id AS item_id, NULL AS name, image_path AS value
        FROM m_product_images
        UNION ALL SELECT p_partkey, 'attribute', 2, p_partkey * 4, 'brand', p_brand FROM part
        UNION ALL SELECT p_partkey, 'attribute', 1, p_partkey * 4 + 1, 'type', p_type FROM part
        UNION ALL SELECT p_partkey, 'attribute', 0, p_partkey * 4 + 2, 'size', CAST(p_size AS VARCHAR) FROM part
        UNION ALL SELECT p_partkey, 'tag', 0, p_partkey * 100 + i - 1, NULL, words[i]
        FROM (SELECT p_partkey, string_split(p_name, ' ') AS words, unnest(range(1, len(string_split(p_name, ' ')) + 1)) AS i
              FROM part) t)
    SELECT product_id, kind, position, item_id, name, value, total
    FROM (SELECT *, row_number() OVER (PARTITION BY product_id, kind ORDER BY o, item_id) AS position,
                 count(*) OVER (PARTITION BY product_id, kind) AS total FROM every) x
    WHERE position <= 4"""
SQL["refreshed_ratings"] = """
    WITH now AS (
        SELECT product_id, CASE WHEN review_id % 7 = 0 THEN 6 - rating ELSE rating END AS rating
        FROM m_product_reviews WHERE NOT is_hidden AND review_id % 11 <> 0
        UNION ALL SELECT product_id, 5 FROM m_product_reviews WHERE review_id % 5 = 0)
    SELECT p.product_id,
           CAST(coalesce(((r.s * 20000 + r.n) // (r.n * 2) + 500) // 1000, 0) * 0.1 AS DECIMAL(4,1)) AS avg_rating,
           coalesce(r.n, 0) AS review_count
    FROM m_products p LEFT JOIN (SELECT product_id, CAST(sum(rating) AS BIGINT) AS s, count(*) AS n FROM now
                                 GROUP BY product_id) r ON r.product_id = p.product_id"""
SQL["refreshed_sales"] = """
    SELECT p.product_id, CAST(coalesce(sum(i.quantity), 0) AS BIGINT) AS total_sales
    FROM m_products p LEFT JOIN m_order_items i ON i.product_id = p.product_id
         AND i.status NOT IN ('cancelled', 'returned') AND i.order_id % 6 <> 0
    GROUP BY p.product_id"""
SQL["order_history_rows"] = """
    SELECT o.user_id, o.order_id, o.created_at, o.order_status, o.payment_status, o.total_amount,
           coalesce(i.n, 0) AS order_lines, coalesce(i.units, 0) AS units,
           row_number() OVER (PARTITION BY o.user_id ORDER BY o.created_at DESC, o.order_id) AS position
    FROM m_orders o LEFT JOIN (SELECT order_id, count(*) AS n, CAST(sum(quantity) AS BIGINT) AS units
                               FROM m_order_items GROUP BY order_id) i ON i.order_id = o.order_id"""
SQL["indexed_search"] = """
    SELECT DISTINCT search, product_id AS id
    FROM m_product_text JOIN (VALUES (' red ', '%red%'), ('ATION', '%ation%'), ('th_s', '%th_s%'), ('o%ation', '%o%ation%'),
                                     ('und der', '%und der%'), ('zz', '%zz%'), ('_e_r', '%_e_r%'), ('100\\%', '%100\\%%'))
         q(search, pattern) ON lower(description) LIKE pattern ESCAPE '\\'"""
SQL["seller_last_page"] = """
    WITH most AS (SELECT business_id, count(*) AS n FROM m_products GROUP BY business_id
                  ORDER BY n DESC, business_id LIMIT 1),
    ranked AS (SELECT p.*, row_number() OVER (ORDER BY p.created_at DESC, p.product_id) AS rn, n
               FROM m_products p JOIN most USING (business_id))
    SELECT r.* EXCLUDE (rn, n), t.description, c.category_name
    FROM ranked r LEFT JOIN m_product_text t ON t.product_id = r.product_id
         LEFT JOIN m_categories c ON c.category_id = r.category_id
    WHERE (rn - 1) // 10 = (n - 1) // 10"""
SQL["catalog_after_delete"] = f"""
    WITH added AS (SELECT product_id, business_id FROM ({SQL["accepted_products"]}) a),
    req AS (SELECT product_id, business_id FROM m_order_items WHERE status = 'returned'
            UNION SELECT product_id, business_id + product_id % 3 FROM added WHERE product_id % 3 <> 2),
    stock AS (SELECT product_id, business_id FROM m_products UNION ALL SELECT product_id, business_id FROM added),
    judged AS (SELECT r.*, CASE WHEN s.product_id IS NULL THEN 'not_owned'
                                WHEN r.product_id IN (SELECT product_id FROM m_order_items) THEN 'blocked'
                                ELSE 'deleted' END AS status
               FROM req r LEFT JOIN stock s ON s.product_id = r.product_id AND s.business_id = r.business_id)
    SELECT * FROM judged
    UNION ALL SELECT product_id, business_id, 'left' FROM stock
    WHERE product_id NOT IN (SELECT product_id FROM judged WHERE status = 'deleted')"""


def _free_numbers(wanted: str, used: str, first: int) -> str:
    """Every row of ``wanted`` (k, arrival_no, base) with the n-th number from ``first`` that ``used`` (k, number) lacks."""
    return f"""
    wanted AS ({wanted}), used AS (SELECT DISTINCT k, number FROM ({used}) u0 WHERE number >= {first}),
    turn AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY arrival_no) AS n FROM wanted),
    span AS (SELECT t.k, count(*) + (SELECT count(*) FROM used u WHERE u.k = t.k) AS c FROM turn t GROUP BY t.k),
    free AS (SELECT k, s, row_number() OVER (PARTITION BY k ORDER BY s) AS n
             FROM (SELECT k, unnest(range({first}, {first} + c)) AS s FROM span) x
             WHERE NOT EXISTS (SELECT 1 FROM used u WHERE u.k = x.k AND u.number = x.s)),
    numbered AS (SELECT t.*, f.s AS number FROM turn t JOIN free f ON f.k = t.k AND f.n = t.n)"""


_BASE = "substr(lower(first_name || '.' || last_name), 1, 38)"
_BASE = f"{_BASE} || CASE WHEN regexp_matches({_BASE}, '[0-9]$') THEN '.' ELSE '' END"


def _usernames(batch: str, users: str) -> str:
    return _free_numbers(
        f"SELECT arrival_no, {_BASE} AS base, {_ekey(_BASE)} AS k FROM {batch}",
        f"""SELECT {_ekey("regexp_replace(rtrim(username), '[0-9]+$', '')")} AS k,
                   TRY_CAST(regexp_extract(rtrim(username), '[0-9]+$') AS BIGINT) AS number
            FROM {users} WHERE regexp_matches(rtrim(username), '[^0-9][1-9][0-9]+$')""", 100)


SQL["accepted_users"] = f"""
    WITH ok AS (SELECT * FROM ({SQL["user_intake"]}) i WHERE error IS NULL), {_usernames("ok", "m_users")}
    SELECT (SELECT max(user_id) FROM m_users) + ok.arrival_no AS user_id, first_name, last_name, email, phone, role,
           n.base || n.number AS username, FALSE AS is_verified
    FROM ok JOIN numbered n ON n.arrival_no = ok.arrival_no"""
SQL["allocated_usernames"] = f"""
    WITH batch AS (
        SELECT user_id AS arrival_no,
               CASE WHEN user_id % 6 = 0 THEN 'Ann' WHEN user_id % 3 = 0 THEN 'ANN' ELSE last_name END AS first_name,
               CASE WHEN user_id % 3 = 0 THEN 'Lee' WHEN user_id % 5 = 0 THEN 'Route 66' ELSE last_name END AS last_name
        FROM m_users),
    u AS (SELECT CASE WHEN user_id % 2 = 0 THEN 'ann.lee' || (100 + user_id % 1300)
                      WHEN user_id % 7 = 0 THEN upper(last_name) || '.' || last_name || (100 + user_id % 50)
                      WHEN user_id % 11 = 0 THEN 'automobile.route 66.' || (90 + user_id % 30)
                      ELSE username END AS username FROM m_users),
    {_usernames("batch", "u")}
    SELECT arrival_no, base || number AS username FROM numbered"""
_NAMESAKES = """SELECT product_id, CASE WHEN product_id % 17 = 0 THEN ' !!! ' WHEN product_id % 3 = 0 THEN 'Hot Item'
                                        ELSE name END AS name FROM m_products"""
SQL["assigned_slugs"] = f"""
    WITH s AS (SELECT product_id, {_SLUG.format(x="name")} AS slug FROM ({_NAMESAKES}) p),
    t AS (SELECT slug || CASE WHEN product_id % 8 = 0 THEN '' ELSE '-' || (2 + product_id % 40) END AS slug
          FROM s WHERE product_id % 4 = 0),
    b AS (SELECT product_id AS arrival_no, CASE WHEN slug = '' THEN 'product' ELSE slug END AS slug
          FROM s WHERE product_id % 4 <> 0),
    kept AS (SELECT min(arrival_no) AS arrival_no, slug FROM b WHERE slug NOT IN (SELECT slug FROM t) GROUP BY slug),
    {_free_numbers(
        "SELECT arrival_no, slug AS base, slug AS k FROM b WHERE arrival_no NOT IN (SELECT arrival_no FROM kept)",
        """SELECT regexp_extract(slug, '^(.*)-([1-9][0-9]*)$', 1) AS k,
                  TRY_CAST(regexp_extract(slug, '^(.*)-([1-9][0-9]*)$', 2) AS BIGINT) AS number
           FROM (SELECT slug FROM t UNION ALL SELECT slug FROM kept) a""", 2)}
    SELECT arrival_no, slug FROM kept UNION ALL SELECT arrival_no, base || '-' || number FROM numbered"""


def oracle_sql() -> dict[str, str]:
    return {k: with_views(v) for k, v in SQL.items()}
