"""Augmentation and rule queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import augment
from ..operators.dedupe import dedupe_first
from ..operators.rules import map_by_rule
from ..taxonomy import AMAZON_CATEGORY_RULES, RETAILER_SUB_RULES
from ..sources.tables import table
from .catalog import register
from .sqltext import rule_values

SEED = 42


@register("shuffle_words", f"""
SELECT p_partkey, p_name AS Description, false AS is_augmented FROM part
UNION ALL
SELECT p_partkey,
       array_to_string(list_transform(list_sort(list_transform(
           list_filter(regexp_split_to_array(p_name, '\\s+'), lambda w: w <> ''),
           lambda w, i: {{'h': md5('{SEED}|' || CAST(p_partkey AS VARCHAR) || '|' || CAST(i - 1 AS VARCHAR)),
                          'i': i - 1, 'w': w}})), lambda s: s.w), ' ') AS Description,
       true AS is_augmented
FROM part""")
def q_shuffle_words(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("Description"))
    return augment.shuffle_words(part, "p_partkey", "Description", seed=SEED)


CITY_SQL = f"""
WITH m AS (SELECT p_name, p_type, p_brand,
                  CAST(row_number() OVER (ORDER BY p_partkey) - 1 AS BIGINT) AS m_ord
           FROM (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS nth
                 FROM part) x WHERE nth = 1),
nm AS (SELECT COUNT(*) AS n FROM m),
c AS (SELECT DISTINCT cu.c_name || ' ' || na.n_name AS city_state
      FROM customer cu JOIN nation na ON cu.c_nationkey = na.n_nationkey),
cr AS (SELECT city_state, CAST(row_number() OVER (ORDER BY md5('{SEED}|' || city_state), city_state)
                               AS BIGINT) AS city_rank FROM c)
SELECT cr.city_rank, m.p_name AS merchant, cr.city_state,
       m.p_name || ' ' || cr.city_state AS Description,
       m.p_type AS Category, m.p_brand AS Sub_Category
FROM cr JOIN m ON m.m_ord = (cr.city_rank - 1) % (SELECT n FROM nm)"""


@register("augment_city", CITY_SQL)
def q_augment_city(spark, sf_dir):
    """Distinct part names as merchants (first position = smallest key),
    customers' name + nation as cities; labels go with the merchants."""
    part = table(spark, sf_dir, "part").select(
        "p_partkey", F.col("p_name").alias("Description"), F.col("p_type").alias("Category"),
        F.col("p_brand").alias("Sub_Category"))
    merchants = dedupe_first(part, ["Description"], "p_partkey")
    cust = table(spark, sf_dir, "customer").select("c_name", "c_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    cities = (cust.join(nation, cust.c_nationkey == nation.n_nationkey)
              .select(F.concat("c_name", F.lit(" "), "n_name").alias("city_state")))
    return augment.augment_city(merchants, cities, order_col="p_partkey", seed=SEED)


@register("compose_description", """
SELECT c.c_custkey,
       c.c_name || ' ' || c.c_mktsegment || ' ' || c.c_name || ' ' || c.c_mktsegment || ' ' ||
       c.c_name || ' ' || n.n_name || ' ' || r.r_name || ' ' || n.n_name || ' ' || r.r_name
         AS description
FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey
JOIN region r ON n.n_regionkey = r.r_regionkey""")
def q_compose_description(spark, sf_dir):
    """Restaurant-style description from customer (name, segment as address
    and categories), nation (city, province) and region (country)."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_nationkey")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    r = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    rows = (c.join(n, c.c_nationkey == n.n_nationkey)
            .join(r, n.n_regionkey == r.r_regionkey))
    return rows.select("c_custkey", augment.compose_description(
        "c_name", "c_mktsegment", "c_mktsegment", "n_name", "r_name", "n_name"
    ).alias("description"))


def part_rules() -> dict[str, list[str]]:
    """Fragment rules for part names (parameters of this query): multi-word
    fragments first, then nouns, then adjectives."""
    return {
        "Jewelry": ["red ring", "ring"],
        "Tools": ["anvil", "bolt", "rod"],
        "Kitchen": ["hot plate", "plate"],
        "Electronics_misc": ["gizmo", "widget"],
        "Maintenance": ["gear"],
        "Groceries": ["cold"],
        "Home_Essentials": ["new", "old"],
    }


@register("map_by_rule", f"""
WITH r(target, rule_ord, pattern) AS (VALUES {rule_values(part_rules())})
SELECT p.p_partkey, p.p_name, arg_min(r.target, r.rule_ord) AS target
FROM part p LEFT JOIN r ON contains(p.p_name, r.pattern)
GROUP BY p.p_partkey, p.p_name""")
def q_map_by_rule(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    return map_by_rule(part, "p_name", part_rules())


RETAIL_PATH_SQL = """CASE c_custkey % 4
         WHEN 0 THEN 'Home|' || c_mktsegment || '|' || c_name
         WHEN 1 THEN 'Baby Products | ' || c_name
         WHEN 2 THEN 'Grocery & Gourmet Food | ' || c_mktsegment
         ELSE 'Electronics|Computers|' || c_name END"""


@register("map_retailer_rules", f"""
WITH a(target, rule_ord, pattern) AS (VALUES {rule_values(AMAZON_CATEGORY_RULES)}),
s(target, rule_ord, pattern) AS (VALUES {rule_values(RETAILER_SUB_RULES)}),
p AS (SELECT c_custkey, {RETAIL_PATH_SQL} AS path FROM customer)
SELECT p.c_custkey, p.path,
       (SELECT arg_min(a.target, a.rule_ord) FROM a WHERE contains(p.path, a.pattern)) AS category,
       (SELECT arg_min(s.target, s.rule_ord) FROM s WHERE contains(p.path, s.pattern)) AS sub
FROM p""")
def q_map_retailer_rules(spark, sf_dir):
    """The retailers' category-path rules on paths built from customers."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    path = F.expr(RETAIL_PATH_SQL)
    both = map_by_rule(c.select("c_custkey", path.alias("path")), "path",
                       AMAZON_CATEGORY_RULES, "category")
    return map_by_rule(both, "path", RETAILER_SUB_RULES, "sub")
