import random

from pyspark.sql import functions as F

from glossaflow.llm import mixing as M


def test_thresholds_equal_sorting(spark):
    rng = random.Random(6)
    rows = [(k, s, rng.randrange(1, 50), rng.getrandbits(M.BITS * M.LEVELS)) for k in range(3000) for s in ["hot" if k % 3 else rng.choice("ab")]]
    df = spark.createDataFrame(rows, "doc_id long, source string, tokens long, hash long")
    wanted = {"hot": 20_000, "a": 1, "b": 10**9}
    under = M.thresholds(df, wanted)
    for s, budget in wanted.items():
        total, chosen = 0, set()
        for h, t, k in sorted((h, t, k) for k, x, t, h in rows if x == s):
            if total + t > budget:
                if total + t - budget < budget - total:
                    chosen |= {k}
                break
            total, chosen = total + t, chosen | {k}
        assert {k for k, x, _, h in rows if x == s and h < under[s]} == chosen


def test_mix(spark):
    docs = [(k, "big", "word " * 20) for k in range(300)] + [(1000 + k, "small", "word " * 10) for k in range(20)] + [(2000, "other", "x"), (2001, None, "x"), (2002, "big", None), (2003, "big", "  "), (2004, "big", "y " * 9000)]
    df = spark.createDataFrame([(*d, "t") for d in docs], "doc_id long, source string, text string, tokens string")
    targets = spark.createDataFrame([("big", 0.8, 1), ("small", 0.19, 3), ("none", 0.01, 4)], "source_name string, target_share double, max_repeats int")
    chosen, shares = M.mixed(df, targets, size=3000)
    reached = {r.source_name: r for r in shares.collect()}
    assert reached["none"].tokens == 0 and 2380 < reached["big"].tokens < 2420 and 560 < reached["small"].tokens < 580
    uses = {r.doc_id: r.repeats for r in chosen.collect()}
    assert max(v for k, v in uses.items() if k >= 1000) <= 3 and max(v for k, v in uses.items() if k < 1000) == 1 and not {2000, 2001, 2002, 2003} & set(uses)
    again = M.mixed(df, targets, size=3000)[0]
    assert {r.doc_id: r.repeats for r in again.collect()} == uses
    largest = {r.source_name: r for r in M.mixed(df, targets)[1].collect()}
    assert abs(largest["small"].actual_share - 0.19) < 0.02 and largest["small"].documents == 60
    assert M.mixed(df, targets.where(F.lit(False)))[0].count() == 0 and M.mixed(df.where(F.lit(False)), targets)[0].count() == 0


def test_shares_come_near_their_targets(spark):
    """With documents of very uneven sizes each source misses its share by at most half of its largest document."""
    rng = random.Random(3)
    docs = [(k, f"s{k % 4}", "word " * int(10 * 1.01 ** rng.randrange(500))) for k in range(4000)]
    df = spark.createDataFrame(docs, "doc_id long, source string, text string")
    targets = spark.createDataFrame([("s0", 0.4, 1), ("s1", 0.3, 1), ("s2", 0.2, 1), ("s3", 0.1, 2)], "source_name string, target_share double, max_repeats int")
    shares = {r.source_name: r for r in M.mixed(df, targets)[1].collect()}
    total = sum(r.tokens for r in shares.values())
    assert all(abs(r.tokens - r.target_share * total) <= 0.5 * 1450 + 0.001 * total for r in shares.values())
    assert all(abs(r.actual_share - r.target_share) < 0.003 for r in shares.values())
