"""Tables of guardrails as step functions of confidence."""

import random

from pyspark.sql import functions as F

from guardlake import catalog as C
from guardlake.operators import policy

NAN = float("nan")


def _same(spark, found, rules, channel=None):
    df = spark.createDataFrame(found, "id int, category string, confidence double")
    got = policy.guardrail_actions(df, policy.guardrail_table(spark, rules), channel).collect()
    want = {}
    for i, category, confidence in found:
        met = [r for r in rules if r.enabled and (not channel or not r.channels
                                                  or channel in r.channels)
               and (not r.categories or category in r.categories) and confidence is not None
               and (confidence != confidence or confidence >= r.confidence)]
        rank = max([C.ACTIONS.index(r.action) for r in met], default=0)
        want[i] = (C.ACTIONS[rank], len(met))
    assert {r.id: (r.action, r.n_guardrails) for r in got} == want and len(got) == len(found)


def test_equal_a_plain_match(spark):
    draw = random.Random(3)
    kinds = ["jailbreak", "obfuscation", "other"]
    rules = [C.Guardrail(f"r{i}", draw.choice(C.ACTIONS), draw.choice(
        [draw.random(), 0.5, 0.0, 1.0, -1.0, 3.0]),
        tuple(draw.sample(kinds, draw.randrange(3))),
        tuple(draw.sample(["chat", "upload"], draw.randrange(2))), None, draw.random() < 0.9)
        for i in range(80)]
    found = [(i, draw.choice([*kinds, "unlisted", None]), draw.choice(
        [draw.random(), 0.5, 0.0, -0.0, 1.0, -2.0, 7.0, NAN, None])) for i in range(300)]
    for channel in (None, "chat"):
        _same(spark, found, rules, channel)
    _same(spark, found, [])
    _same(spark, [], rules)


def test_equal_steps_and_repeated_categories(spark):
    rules = [C.Guardrail("a", "log", 0.5, ("x", "x")), C.Guardrail("b", "block", 0.5, ("x",)),
             C.Guardrail("c", "log", 0.5)]
    _same(spark, [(0, "x", 0.5), (1, "x", 0.4999999), (2, "y", 0.5), (3, "x", 0.5000001)], rules)


def test_rules_and_confidences_do_not_meet_in_pairs(spark):
    rules = spark.range(100_000).select(
        F.col("id").cast("string").alias("name"), F.lit("log").alias("action"),
        (F.col("id") / 100_000).alias("confidence"),
        F.array().cast("array<string>").alias("categories"),
        F.array().cast("array<string>").alias("channels"), F.lit(True).alias("enabled"))
    found = spark.range(100_000).select("id", F.lit("c").alias("category"),
                                        (F.col("id") / 100_000).alias("confidence"))
    got = policy.guardrail_actions(found, rules)
    assert got.filter(F.col("n_guardrails") != F.col("id") + 1).count() == 0
    assert got.count() == 100_000
