"""Merchant x city round robin against a brute-force restatement."""

import hashlib

import pytest

from ledgerlens.operators.augment import augment_city


def brute(merchants, cities, cap, seed=42):
    order = [name for _, name in sorted(merchants)]
    ranked = sorted(set(cities), key=lambda c: (hashlib.md5(f"{seed}|{c}".encode()).hexdigest(), c))
    out = []
    for r, city in enumerate(ranked[:cap], start=1):
        m = order[(r - 1) % len(order)]
        out.append((r, m, city, f"{m} {city}"))
    return out


@pytest.mark.parametrize("n_merchants, n_cities, cap", [(7, 50, 20), (30, 25, 10), (5, 8, 100)])
def test_round_robin_matches_brute_force(spark, n_merchants, n_cities, cap):
    merchants = [(1000 - 3 * i, f"shop {i}") for i in range(n_merchants)]
    # repeated cities count once
    cities = [f"town{i % n_cities} st" for i in range(2 * n_cities)]
    m = spark.createDataFrame(merchants, "k long, Description string")
    c = spark.createDataFrame([(x,) for x in cities], "city_state string")
    got = sorted(tuple(r) for r in augment_city(m, c, order_col="k", cap=cap).collect())
    assert got == brute(merchants, cities, cap)


def test_no_merchants_is_an_error(spark):
    m = spark.createDataFrame([], "k long, Description string")
    c = spark.createDataFrame([("a",)], "city_state string")
    with pytest.raises(ValueError):
        augment_city(m, c, order_col="k")


def test_every_city_is_used_and_columns_are_kept(spark):
    m = spark.createDataFrame([(i, f"shop {i}", f"cat{i % 3}") for i in range(4)],
                              "k long, Description string, Category string")
    c = spark.range(2500).selectExpr("concat('c', id) as city_state")
    rows = augment_city(m, c, order_col="k").collect()
    assert sorted(r.city_rank for r in rows) == list(range(1, 2501))
    assert all(r.Category == f"cat{int(r.merchant.split()[1]) % 3}" for r in rows)
