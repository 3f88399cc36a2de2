"""The marketplace view mapping written as DuckDB SQL (CTE bodies).

These mirror ``souq.sources.views.MarketViews`` column for column, so an
oracle statement can be written against ``m_products``, ``m_businesses`` ...
exactly like the Spark query is written against the views.  Money is kept in
DECIMAL (``* 0.01`` rather than ``/ 100``, which DuckDB turns into DOUBLE).
"""

from __future__ import annotations

import re

SLUG = "lower(trim(regexp_replace({x}, '[^a-zA-Z0-9-]+', '-', 'g'), '-'))"


def _slug(x: str) -> str:
    return SLUG.format(x=x)


VIEWS: dict[str, str] = {
    "m_users": f"""
        SELECT c_custkey AS user_id, 'user' || CAST(c_custkey AS VARCHAR) AS username,
               c_name AS first_name, c_mktsegment AS last_name,
               'u' || CAST(c_custkey AS VARCHAR) || '@example.com' AS email,
               CAST(9000000000 + c_custkey AS VARCHAR) AS phone,
               CASE WHEN c_mktsegment = 'MACHINERY' THEN 'business_owner' ELSE 'customer' END AS role,
               c_acctbal > 0 AS is_verified,
               CAST(DATE '2019-01-01' + CAST(c_custkey % 1000 AS INTEGER) AS TIMESTAMP) AS created_at
        FROM customer""",
    "m_businesses": f"""
        SELECT s_suppkey AS business_id, s_suppkey AS user_id, s_name AS business_name,
               {_slug('s_name')} AS business_slug, n_name AS city, r_name AS state,
               CASE WHEN s_suppkey % 10 = 0 THEN 'pending' ELSE 'active' END AS status,
               CAST(DATE '2020-01-01' - CAST(s_suppkey % 365 AS INTEGER) AS TIMESTAMP) AS created_at
        FROM supplier JOIN nation ON s_nationkey = n_nationkey
                      JOIN region ON n_regionkey = r_regionkey""",
    "m_categories": f"""
        SELECT category_id, category_name, {_slug('category_name')} AS category_slug,
               parent_id, TRUE AS is_active, display_order
        FROM (SELECT CAST(r_regionkey + 1 AS BIGINT) AS category_id, r_name AS category_name,
                     CAST(NULL AS BIGINT) AS parent_id, CAST(r_regionkey AS INTEGER) AS display_order
              FROM region
              UNION ALL
              SELECT CAST(n_nationkey + 100 AS BIGINT), n_name, CAST(n_regionkey + 1 AS BIGINT),
                     CAST(n_nationkey AS INTEGER)
              FROM nation) c""",
    "m_products": f"""
        SELECT p_partkey AS product_id, r.business_id,
               CAST(99 + CAST(regexp_extract(p_brand, '[0-9]+') AS BIGINT) AS BIGINT) AS category_id,
               p_name AS name, {_slug('p_name')} || '-' || CAST(p_partkey AS VARCHAR) AS slug,
               CAST(p_retailprice AS DECIMAL(10,2)) AS price, CAST(p_size AS INTEGER) AS stock_quantity,
               CAST(r.disc_sum % 31 AS DECIMAL(5,2)) AS discount_percent,
               p_partkey % 7 = 0 AS is_featured, TRUE AS is_active,
               r.total_sales, r.created_at
        FROM part JOIN (
            SELECT l_partkey, min(l_suppkey) AS business_id,
                   sum(CAST(round(l_discount * 100) AS INTEGER)) AS disc_sum,
                   CAST(count(*) AS INTEGER) AS total_sales, min(l_shipdate) AS created_at
            FROM lineitem GROUP BY l_partkey) r ON p_partkey = r.l_partkey""",
    "m_product_text": """
        SELECT doc_id AS product_id, text AS description FROM documents""",
    "m_product_images": """
        SELECT page_id AS image_id, page_id // 2 AS product_id, url AS image_path,
               page_id % 2 = 1 AS is_primary, CAST(page_id % 2 AS INTEGER) AS display_order
        FROM pages""",
    "m_product_reviews": """
        SELECT event_id AS review_id, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS product_id,
               user_id, CAST(1 + CAST(floor(value) AS INTEGER) % 5 AS INTEGER) AS rating,
               event_type AS review_text, event_type = 'purchase' AS is_verified_purchase,
               event_type = 'error' AS is_hidden, ts AS created_at
        FROM events""",
    "m_orders": """
        SELECT o_orderkey AS order_id, o_custkey AS user_id,
               CASE o_orderstatus WHEN 'P' THEN 'pending' WHEN 'O' THEN 'processing'
                                  WHEN 'F' THEN 'delivered' END AS order_status,
               CASE WHEN o_orderstatus = 'F' THEN 'paid' ELSE 'pending' END AS payment_status,
               CAST(o_totalprice AS DECIMAL(12,2)) AS subtotal,
               CAST(0 AS DECIMAL(12,2)) AS shipping_cost, CAST(0 AS DECIMAL(12,2)) AS tax_amount,
               CAST(0 AS DECIMAL(12,2)) AS discount_amount,
               CAST(o_totalprice AS DECIMAL(12,2)) AS total_amount, o_orderdate AS created_at
        FROM orders""",
    "m_order_items": """
        SELECT order_item_id, order_id, product_id, business_id, quantity, price, discount_amount,
               CAST(price - discount_amount AS DECIMAL(12,2)) AS total_amount, status, created_at
        FROM (SELECT CAST((CAST(l_orderkey AS HUGEINT) * 10 + l_linenumber) * 1000000000000000000000000
                          + CAST(l_partkey AS HUGEINT) * 1000000000000 + l_suppkey AS DECIMAL(38,0)) AS order_item_id, l_orderkey AS order_id,
                     l_partkey AS product_id, l_suppkey AS business_id,
                     CAST(floor(l_quantity) AS INTEGER) AS quantity,
                     CAST(l_extendedprice AS DECIMAL(12,2)) AS price,
                     CAST(round(CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_discount AS DECIMAL(4,2)), 2)
                          AS DECIMAL(12,2)) AS discount_amount,
                     CASE WHEN l_returnflag = 'R' THEN 'returned' WHEN l_linestatus = 'F' THEN 'delivered'
                          ELSE 'shipped' END AS status,
                     l_shipdate AS created_at
              FROM lineitem) li""",
    "m_cart_items": """
        SELECT CAST(CAST(user_id AS HUGEINT) * 1000000000000 + product_id AS DECIMAL(38,0)) AS cart_item_id, user_id, product_id,
               CAST(count(*) AS INTEGER) AS quantity, min(ts) AS created_at
        FROM (SELECT user_id, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS product_id, ts
              FROM events WHERE event_type = 'click') e
        GROUP BY user_id, product_id""",
    "m_wishlist_items": """
        SELECT CAST(CAST(user_id AS HUGEINT) * 1000000000000 + product_id AS DECIMAL(38,0)) AS wishlist_id, user_id, product_id, min(ts) AS created_at
        FROM (SELECT user_id, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS product_id, ts
              FROM events WHERE event_type = 'view') e
        GROUP BY user_id, product_id""",
    "m_forum_posts": """
        SELECT CAST(CAST(conv_id AS VARCHAR) || lpad(CAST(turn AS VARCHAR), 12, '0') AS DECIMAL(38,0)) AS post_id, conv_id AS topic_id, conv_id AS user_id,
               text AS content, role = 'assistant' AS is_solution,
               CAST(DATE '2024-01-01' + CAST(conv_id % 365 AS INTEGER) AS TIMESTAMP)
                 + to_hours(CAST(turn AS INTEGER)) AS created_at
        FROM conversations""",
    "m_forum_topics": """
        SELECT conv_id AS topic_id, 'Topic ' || CAST(conv_id AS VARCHAR) AS title,
               'topic-' || CAST(conv_id AS VARCHAR) AS slug, conv_id AS created_by,
               conv_id % 10 = 0 AS is_sticky,
               CAST(DATE '2024-01-01' + CAST(conv_id % 365 AS INTEGER) AS TIMESTAMP) AS created_at
        FROM conversations WHERE turn = 0""",
}

# Defective copies for the audits: the same rows with values broken by key residue
# (the Spark side derives them in ``souq.plans.candidates``).
DEFECTIVE: dict[str, str] = {
    "users": """(CASE WHEN user_id % 41 = 0 THEN NULL ELSE first_name END) AS first_name,
        (CASE WHEN user_id % 50 = 0 THEN 'guest' ELSE role END) AS role,
        (CASE WHEN user_id % 47 = 0 THEN repeat('x', 60) ELSE last_name END) AS last_name,
        (CASE WHEN user_id % 53 = 0 THEN 'SHARED' || (user_id % 3) || '@Example.com ' ELSE email END) AS email""",
    "businesses": """(CASE WHEN business_id % 3 = 0 THEN NULL ELSE city END) AS city,
        (CASE WHEN business_id % 4 = 0 THEN 'closed' ELSE status END) AS status,
        (CASE WHEN business_id % 5 = 0 THEN repeat('b', 101) ELSE business_name END) AS business_name,
        (CASE WHEN business_id % 7 = 0 THEN -business_id ELSE user_id END) AS user_id""",
    "products": """(CASE WHEN product_id % 37 = 0 THEN NULL ELSE name END) AS name,
        (CASE WHEN product_id % 31 = 0 THEN CAST(123456789012 AS DECIMAL(14,2)) ELSE price END) AS price,
        (CASE WHEN product_id % 29 = 0 THEN 9000 + product_id % 4 ELSE category_id END) AS category_id,
        (CASE WHEN product_id % 23 = 0 THEN 'same' ELSE slug END) AS slug""",
    "categories": """(CASE WHEN category_id = 101 THEN 77 ELSE parent_id END) AS parent_id,
        (CASE WHEN category_id = 102 THEN NULL ELSE category_slug END) AS category_slug""",
    "product_images": """(CASE WHEN image_id % 11 = 0 THEN repeat('p', 300) ELSE image_path END) AS image_path""",
    "product_reviews": """(CASE WHEN review_id % 59 = 0 THEN NULL ELSE rating END) AS rating,
        (CASE WHEN review_id % 61 = 0 THEN -1 - review_id % 5 ELSE product_id END) AS product_id""",
    "orders": """(CASE WHEN order_id % 67 = 0 THEN 'lost' ELSE order_status END) AS order_status,
        (CASE WHEN order_id % 71 = 0 THEN 'void' ELSE payment_status END) AS payment_status,
        (CASE WHEN order_id % 73 = 0 THEN NULL ELSE total_amount END) AS total_amount,
        (CASE WHEN order_id % 79 = 0 THEN -user_id ELSE user_id END) AS user_id""",
    "order_items": """(CASE WHEN order_id % 83 = 0 THEN 'gone' ELSE status END) AS status,
        (CASE WHEN order_id % 89 = 0 THEN CAST(9999999999 AS DECIMAL(12,2)) ELSE price END) AS price,
        (CASE WHEN order_id % 97 = 0 THEN -order_id ELSE order_id END) AS order_id""",
    "forum_topics": """(CASE WHEN topic_id % 6 = 0 THEN repeat('t', 256) ELSE title END) AS title,
        (CASE WHEN topic_id % 7 = 0 THEN 'topic' ELSE slug END) AS slug""",
    "forum_posts": """(CASE WHEN topic_id % 8 = 0 THEN NULL ELSE content END) AS content,
        (CASE WHEN topic_id % 9 = 0 THEN -topic_id ELSE topic_id END) AS topic_id""",
}
for _t in ("users", "businesses", "categories", "products", "product_images", "product_reviews", "orders",
           "order_items", "cart_items", "wishlist_items", "forum_topics", "forum_posts"):
    VIEWS[f"d_{_t}"] = f"SELECT *{' REPLACE (' + DEFECTIVE[_t] + ')' if _t in DEFECTIVE else ''} FROM m_{_t}"


def with_views(sql: str) -> str:
    """Prefix ``sql`` with the CTEs of every ``m_*`` view it mentions."""
    text = "\n".join([sql] + [VIEWS[n] for n in VIEWS if n.startswith("d_") and re.search(r"\b" + n + r"\b", sql)])
    used = [n for n in VIEWS if re.search(r"\b" + n + r"\b", text)]
    if not used:
        return sql
    ctes = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in used)
    body = sql.strip()
    m = re.match(r"(?is)^WITH(\s+RECURSIVE)?\s+", body)
    if m:
        head = "WITH RECURSIVE" if m.group(1) else "WITH"
        return f"{head} {ctes},\n{body[m.end():]}"
    return f"WITH {ctes}\n{body}"
