import random
import re

import pytest
from pyspark.sql import functions as F

from glossaflow.functions import text as T
from glossaflow.operators import abbreviations, postfilters, recognize, termlist

SCHEMA = "term string, type string, preferred_form string, original_resource string, native_id string, umls_cui string"


def entries(*terms):
    return [(t, "X", t, "db", f"id{k}", "c") for k, t in enumerate(terms)]


def brute(text, terms, stop=()):
    """Every match, from reading the definition."""
    find = lambda t: [(m.group(), m.start(), m.end()) for m in re.finditer(r"\d+|[^\W\d_]+", t)]
    key = lambda ts: tuple(ts) if " ".join(x.lower() for x in ts) in stop else tuple(x.lower() for x in ts)
    toks = find(text)
    out = set()
    for term, *info in terms:
        want = [t[0] for t in find(term or "")]
        for i in range(len(toks) - len(want) + 1 if want else 0):
            if key([t[0] for t in toks[i : i + len(want)]]) == key(want):
                out.add((toks[i][1], toks[i + len(want) - 1][2], *info))
    return out


@pytest.mark.parametrize("stop", [(), ("was", "il 2")])
def test_matches_equal_brute_force(spark, stop):
    terms = [*entries("IL-2", "IL 2", "il2 receptor", "was", "WAS", "a b", "b", "b c", "a b c", "", "--"), (None, "X", "n", "db", "n", "c"), ("b", "Y", "b", "db", "other", "c")]
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["IL-2", "il", "2", "receptor", "a", "B", "c", "(", "was", "WAS", "Was", "x_y", "β"]) for _ in range(30)) for _ in range(12)] + ["", None, "a b c" * 300]
    index = termlist.build_index(spark.createDataFrame(terms + terms[:3], SCHEMA), stopwords=[s.replace(" ", T.GAP) for s in stop])
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = recognize.recognise(df, index, ["doc_id"]).collect()
    rows = {(r.doc_id, r.start, r.end, r.type, r.preferred_form, r.original_resource, r.native_id, r.umls_cui) for r in got}
    assert len(rows) == len(got)
    assert rows == {(k, *m) for k, t in enumerate(texts) if t for m in brute(t, terms, stop)}
    assert all(r.text == texts[r.doc_id][r.start : r.end] for r in got)


def test_large_dictionary_needs_no_broadcast(spark):
    df = spark.createDataFrame([(1, "x")], "k int, text string")
    assert "ResolvedHint" not in recognize.checked(df, 0)._jdf.queryExecution().toString()


def test_ids_go_on(spark):
    e = spark.createDataFrame([("d", 5, 6), ("d", 1, 2), ("e", 1, 2)], "doc_id string, start int, end int")
    old = spark.createDataFrame([("d", "7"), ("d", "T9"), ("d", None)], "doc_id string, id string")
    got = {(r.doc_id, r.start): r.id for r in recognize.with_ids(e, ["doc_id"], ["start"], old).collect()}
    assert got == {("d", 1): "8", ("d", 5): "9", ("e", 1): "1"}


def test_termlist_layouts(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("h1\th2\nc1\tdb\tn1\tterm\\\tone\tpref\tGene\nc2\tdb\tn2\t\t\tGene\n")
    t = termlist.read_termlist(spark, str(tmp_path / "t.tsv"), "bth", header=True).orderBy("native_id").collect()
    assert [(r.term, r.type, r.umls_cui) for r in t] == [("term\tone", "Gene", "c1"), ("", "Gene", "c2")]
    with pytest.raises(Exception, match="expected 4 fields"):
        termlist.read_termlist(spark, str(tmp_path / "t.tsv"), "4").collect()


def test_abbreviations(spark):
    terms = entries("wiskott aldrich syndrome", "was", "interleukin two")
    index = termlist.build_index(spark.createDataFrame(terms, SCHEMA), pattern=T.TOKEN_PARENS)
    rows = [("d", 1, "WAS first. Wiskott Aldrich syndrome (WAS) was Was."), ("d", 2, "WAS again (IL) interleukin two (IL) IL il"), ("e", 1, "WAS here"), ("f", 1, None)]
    got = abbreviations.recognise_abbreviations(spark.createDataFrame(rows, "doc_id string, sent_id int, text string"), index).collect()
    found = sorted((r.doc_id, r.sent_id, r.start, r.native_id) for r in got)
    text = rows[0][2]
    # before the definition WAS is the word; from it on, exact tokens only: WAS has the syndrome's entry, was the word's
    assert [f for f in found if f[:2] == ("d", 1)] == [("d", 1, 0, "id1"), ("d", 1, 11, "id0"), ("d", 1, text.index("(WAS") + 1, "id0"), ("d", 1, text.index(" was") + 1, "id1")]
    two = rows[1][2]
    assert [f for f in found if f[:2] == ("d", 2)] == [("d", 2, 0, "id0"), ("d", 2, two.index("inter"), "id2"), ("d", 2, two.rindex("(IL") + 1, "id2"), ("d", 2, two.index(" IL il") + 1, "id2")]
    assert [f for f in found if f[0] == "e"] == [("e", 1, 0, "id1")]
    tail = spark.createDataFrame([(" (ABC) x",), ("(A) x",)], "t string").select(abbreviations.regex_definition(F.col("t")).alias("d")).collect()
    assert [r.d for r in tail] == ["ABC", None]


def spans(rng, n):
    return [(f"s{rng.randrange(3)}", a := rng.randrange(12), a + rng.randrange(1, 5), rng.choice("XY")) for _ in range(n)]


@pytest.mark.parametrize("same", [False, True])
def test_overlap_filters_equal_sequential_ones(spark, same):
    rows = spans(random.Random(5), 90)
    df = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "s string, start int, end int, type string, k int")
    group = lambda r: (r[0], r[3] if same else "")
    keep_sub = {k for k, r in enumerate(rows) if not any(group(o) == group(r) and o[1] <= r[1] and r[2] <= o[2] and o[1:3] != r[1:3] for o in rows)}
    assert {r.k for r in postfilters.remove_submatches(df, ["s"], same).collect()} == keep_sub
    keep = set()
    for g in {group(r) for r in rows}:
        chain, reach = [], -1
        for k in [*sorted((k for k, r in enumerate(rows) if group(r) == g), key=lambda k: rows[k][1:3]), None]:
            if k is None or rows[k][1] >= reach:
                most = max((rows[c][2] - rows[c][1] for c in chain), default=0)
                keep |= {c for c in chain if rows[c][2] - rows[c][1] == most}
                chain, reach = [], -1
            if k is not None:
                chain.append(k)
                reach = max(reach, rows[k][2])
    assert {r.k for r in postfilters.remove_overlaps(df, ["s"], same).collect()} == keep


def test_frequent_false(spark):
    surfaces = ["was 2", "P < .001", "Was 12", "IL 2", "μg", "μM 3", "to a", "To A", "", "a=b", "gene", "Ph 7", "ph. 7"]
    df = spark.createDataFrame([(s,) for s in surfaces], "text string")
    assert {r.text for r in postfilters.frequent_fp(df).collect()} == {"IL 2", "gene"}
