"""Scores of annotations against a gold standard."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def selected(lines: DataFrame, selectors: list[str], line: str = "line") -> DataFrame:
    """Rows of the fields of tab-separated lines that each selector names ('1,3-5,7-', from 1, order kept), as columns f0, f1, ... and ``line``."""
    out = None
    for selector in selectors:
        picked, tail = [], None
        for part in selector.split(","):
            a, dash, b = part.partition("-")
            if dash and not b:
                tail = int(a)
            else:
                picked += range(int(a), int(b or a) + 1)
        fields = F.split(F.col(line), "\t")
        row = F.transform(F.array(*[F.lit(i) for i in picked]), lambda i: F.get(fields, i - 1))
        if tail:
            row = F.concat(row, F.slice(fields, F.lit(tail), F.greatest(F.size(fields) - tail + 1, F.lit(0))))
        part_rows = lines.select(F.col(line).alias("line"), row.alias("record"))
        out = part_rows if out is None else out.unionByName(part_rows)
    return out


def judged(gold: DataFrame, found: DataFrame, record: list[str]) -> DataFrame:
    """(record fields, verdict): each distinct record once, as 'TP', 'FP' or 'FN'. Null fields equal null."""
    both = gold.select(*record).withColumn("g", F.lit(1)).withColumn("f", F.lit(0)).unionByName(found.select(*record).withColumn("g", F.lit(0)).withColumn("f", F.lit(1)))
    return both.groupBy(*record).agg(F.max("g").alias("g"), F.max("f").alias("f")).select(*record, F.when(F.col("g") + F.col("f") == 2, "TP").when(F.col("f") == 1, "FP").otherwise("FN").alias("verdict"))


def partial_positives(verdicts: DataFrame, group: list[str]) -> DataFrame:
    """``verdicts`` (group, start, end, verdict) in which false positives that overlap a false negative of their group are 'PP', and those are gone.

    ``group`` are all fields but the offsets. Pairs are made greedily, shortest records first, then by position, each
    record once. Groups without both sorts are untouched and skip Python.
    """
    def pair(rows: pd.DataFrame) -> pd.DataFrame:
        size = rows["end"] - rows["start"]
        ordered = rows.assign(size=size).sort_values(["size", "start", "end"])
        gold = [tuple(x) for x in ordered[ordered["verdict"] == "FN"][["start", "end"]].to_numpy()]
        fate = {}
        for s, e in ordered[ordered["verdict"] == "FP"][["start", "end"]].to_numpy():
            for k, (a, b) in enumerate(gold):
                if max(a, s) < min(b, e):
                    fate[s, e], fate[a, b, "gone"] = "PP", True
                    del gold[k]
                    break
        keep = [not (v == "FN" and (s, e, "gone") in fate) for s, e, v in zip(rows["start"], rows["end"], rows["verdict"])]
        rows = rows.assign(verdict=[fate.get((s, e), v) if v == "FP" else v for s, e, v in zip(rows["start"], rows["end"], rows["verdict"])])
        return rows[keep]

    wrong = verdicts.where("verdict <> 'TP'")
    mixed = wrong.groupBy(*group).agg(F.countDistinct("verdict").alias("__n")).where("__n = 2").drop("__n")
    open_, rest = wrong.join(mixed, group, "left_semi"), wrong.join(mixed, group, "left_anti")
    schema = verdicts.select(*group, "start", "end", "verdict").schema
    paired = open_.select(*group, "start", "end", "verdict").groupBy(*group).applyInPandas(pair, schema)
    return verdicts.where("verdict = 'TP'").select(*group, "start", "end", "verdict").unionByName(rest.select(*group, "start", "end", "verdict")).unionByName(paired)


def counts(verdicts: DataFrame, by: list[str] = (), measure: str = "strict") -> DataFrame:
    """(by, tp, fp, fn) of verdicts. Partial positives are TP for 'lenient', and half TP, half FP and FN for 'average'; 'strict' verdicts have none."""
    n = lambda v: F.count_if(F.col("verdict") == v).cast("double")
    pp = n("PP")
    add = {"strict": (0.0, 1.0, 1.0), "lenient": (1.0, 0.0, 0.0), "average": (0.5, 0.5, 0.5)}[measure]
    return verdicts.groupBy(*by).agg(*[(n(v) + pp * a).alias(v.lower()) for v, a in zip(("TP", "FP", "FN"), add, strict=True)])


def _ratio(a: Column, b: Column, empty: float) -> Column:
    return F.round(F.when(b == 0, F.lit(empty)).otherwise(a / b), 6)


def scores(counted: DataFrame) -> DataFrame:
    """``counted`` with p, r and f1; empty denominators count as 1, 1 and 0."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    p, r = F.when(tp + fp == 0, 1.0).otherwise(tp / (tp + fp)), F.when(tp + fn == 0, 1.0).otherwise(tp / (tp + fn))
    f1 = F.when(p + r == 0, 0.0).otherwise(2 * p * r / (p + r))
    return counted.withColumn("p", F.round(p, 6)).withColumn("r", F.round(r, 6)).withColumn("f1", F.round(f1, 6))


def macro(counted: DataFrame, phantom_doc: bool = False) -> DataFrame:
    """Means of the documents' scores, one row (p, r, f1, documents); with ``phantom_doc`` a perfect empty document counts too."""
    per = scores(counted)
    more = 1 if phantom_doc else 0
    n = F.count("*") + more
    return per.agg(*[F.round((F.coalesce(F.sum(c), F.lit(0.0)) + more) / n, 6).alias(c) for c in ("p", "r", "f1")], n.cast("long").alias("documents"))


def write(verdicts: DataFrame, micro: DataFrame, macro_: DataFrame, folder: str) -> None:
    """Writes each record with its verdict, parted by verdict (TP, FP, FN, PP), and the scores, as tab-separated lines below ``folder``."""
    order = [c for c in verdicts.columns if c != "verdict"]
    verdicts.repartitionByRange("verdict", *order).sortWithinPartitions("verdict", *order).write.mode("overwrite").partitionBy("verdict").csv(f"{folder}/records", sep="\t", quote="", emptyValue="")
    for name, scored in (("micro", micro), ("macro", macro_)):
        scored.coalesce(1).write.mode("overwrite").csv(f"{folder}/{name}", sep="\t", header=True)


def spans_overlap(starts: Column, ends: Column, other_starts: Column, other_ends: Column) -> Column:
    """Whether any span of two multi-span records overlaps; offsets are lists parted by blanks, commas or semicolons."""
    numbers = lambda c: F.array_sort(F.transform(F.filter(F.split(c, "[ ,;]+"), lambda x: x != ""), lambda x: x.cast("int")))
    mine = F.arrays_zip(numbers(starts).alias("a"), numbers(ends).alias("b"))
    other = F.arrays_zip(numbers(other_starts).alias("a"), numbers(other_ends).alias("b"))
    return F.exists(mine, lambda x: F.exists(other, lambda y: F.greatest(x["a"], y["a"]) < F.least(x["b"], y["b"])))
