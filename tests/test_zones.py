"""Keywords inside addresses, looked up by their rarest piece."""

import random

from pyspark.sql import functions as F

from depotflow.operators import dispatch

ORDERS = "route_day int, order_id long, address string"
ZONES = "vehicle_id int, keyword string"


def text(rng, letters, low, high):
    return "".join(rng.choice(letters) for _ in range(rng.randint(low, high)))


def test_same_as_looking_for_every_keyword(spark):
    """Short, empty, blank and NULL keywords; repeated ids on two days; NULL and blank addresses."""
    rng = random.Random(5)
    addresses = [None, "", "  ", "a"] + [text(rng, "ab c", 0, 30) for _ in range(150)]
    keywords = [None, "", " ", "ab"] + [text(rng, "ab c", 1, 9) for _ in range(120)]
    orders = [(i % 2, i // 2, rng.choice(addresses)) for i in range(500)]
    for words in (keywords, [k for k in keywords if k and len(k) > 2]):
        zones = [(i % 50, k) for i, k in enumerate(words)]
        found = dispatch.zone_candidates(
            spark.createDataFrame(orders, ORDERS), spark.createDataFrame(zones, ZONES), max_inline=0).collect()
        expected = []
        for day, order, address in orders:
            hits = {v for v, k in zones if address is not None and k is not None and k in address}
            expected += [(day, order, v) for v in hits or [None]]
        assert sorted(map(tuple, found), key=str) == sorted(expected, key=str)


def test_a_hundred_thousand_keywords_of_any_length(spark):
    rng = random.Random(6)
    letters = "abcdefghijklmnopqrst"
    keywords = list({text(rng, letters, 4, 60) for _ in range(100_000)})
    addresses = [text(rng, letters, 20, 80) + k + text(rng, letters, 0, 20) for k in rng.sample(keywords, 400)]
    orders = spark.createDataFrame([(0, i, a) for i, a in enumerate(addresses)], ORDERS)
    zones = spark.createDataFrame([(i, k) for i, k in enumerate(keywords)], ZONES)
    known = {k: i for i, k in enumerate(keywords)}
    expected = {(i, known[a[s:e]]) for i, a in enumerate(addresses)
                for s in range(len(a)) for e in range(s + 4, min(len(a), s + 60) + 1) if a[s:e] in known}
    found = dispatch.zone_candidates(orders, zones, max_inline=0).where(F.col("vehicle_id").isNotNull())
    assert {(r.order_id, r.vehicle_id) for r in found.collect()} == expected


def test_pieces_grow_with_the_length_alone(spark):
    rng = random.Random(7)
    for length in (1_000, 10_000):
        one = spark.createDataFrame([(text(rng, "abcdefghijklmnopqrstuvwxyz0123456789", length, length),)], "address string")
        pieces = dispatch._pieces(one, "address", F.array(F.lit(dispatch.ANCHOR)))
        assert 0.7 * length < pieces.count() <= length - 2


def test_blank_addresses_are_spread(spark):
    orders = spark.range(4_000).select(F.lit(0).alias("route_day"), F.col("id").alias("order_id"), F.lit(" ").alias("address"))
    spread = dispatch.scattered(orders).groupBy("scatter").count()
    assert spread.count() > 900 and spread.agg(F.max("count")).first()[0] < 40
