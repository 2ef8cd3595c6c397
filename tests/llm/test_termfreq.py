import random
import re
from collections import Counter, defaultdict

import pytest

from glossaflow.llm import termfreq


def brute(values, max_n):
    occ, rec = Counter(), defaultdict(set)
    for r, v, w in values:
        if v is None:
            continue
        toks = re.findall(r"\d+|[^\W\d_]+|[^\s\w]", v)
        grams = [v] if max_n is None else [" ".join(toks[i : i + n]) for n in range(1, max_n + 1) for i in range(len(toks) - n + 1)]
        for g in grams:
            occ[g] += w
            if r is not None:
                rec[g].add(r)
    return {g: (occ[g], len(rec[g])) for g in occ}


@pytest.mark.parametrize(("max_n", "parts"), [(None, 1), (None, 5), (3, 1), (3, 6), (5, 3)])
def test_equals_brute_force(spark, max_n, parts):
    rng = random.Random(1)
    values = [(rng.choice(["a", "b", "c", "d", None]), " ".join(rng.choice("x y zz 1 - β".split()) for _ in range(rng.randrange(6))), rng.randrange(1, 3)) for _ in range(150)]
    values += [("a", None, 1), ("a", "", 1), ("hot", "x y", 5), ("a", "w " * 900, 1), ("b", "  two  blanks \t", 2), ("b", "two blanks", 1), ("c", " ", 1)] + ([("s", "\x01a\x02\x04d", 1)] if max_n is None else []) + [(f"r{k}", "hot value", 1) for k in range(40)]
    got = termfreq.gram_counts(spark.createDataFrame(values, "record string, value string, weight long"), max_n or termfreq.ALL, max_n is None, parts).collect()
    assert {r.gram: (r.occurrences, r.records) for r in got} == brute(values, max_n)
    assert len(got) == len({r.gram for r in got})


def test_marks(spark):
    from datetime import datetime

    t = datetime(2022, 1, 1)
    rows = [(k, f"a{k % 40}", "common", t) for k in range(80)] + [(k, f"a{k % 40}", "common", t) for k in range(80)] + [(100, "a1", "rare", t), (101, "a1", "rare", t), (102, "a2", None, t), (None, "a3", "free", t), (None, "a4", "free", t), (None, "a5", "free", t)]
    got = {r.term: (r.occurrences, r.articles, r.mark) for r in termfreq.term_frequencies(spark.createDataFrame(rows, "anno_key long, article_id string, text string, received_at timestamp"), most=0.1).collect()}
    assert got == {"common": (80, 40, "common"), "rare": (2, 1, "rare"), "free": (3, 3, "useful")}
    assert termfreq.term_frequencies(spark.createDataFrame([], "anno_key long, article_id string, text string")).count() == 0
