"""Frequencies of all values and n-grams: a range-partitioned suffix array, read off by common-prefix intervals."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Signs for the begin and the end of a value and between the pieces of a key; as text they are doubled by escape().
BEGIN, END, GAP = "\x02", "\x03", "\x01"
#: As ``max_n``: grams of any number of pieces.
ALL = 0
#: Pieces of the inner suffixes where only whole values are asked for.
INNER = 64
_ROWS = "gram string, size int, occurrences bigint, records bigint, record string"


def escape(c: Column) -> Column:
    """``c`` without the three signs: \\x04 leads a code for each of them and for itself."""
    for sign, code in (("\x04", "\x04d"), (BEGIN, "\x04b"), (END, "\x04c"), (GAP, "\x04a")):
        c = F.replace(c, F.lit(sign), F.lit(code))
    return c


def unescape(c: Column) -> Column:
    for sign, code in ((GAP, "\x04a"), (END, "\x04c"), (BEGIN, "\x04b"), ("\x04", "\x04d")):
        c = F.replace(c, F.lit(code), F.lit(sign))
    return c


def suffixes(values: DataFrame, max_n: int = ALL, whole: bool = False) -> DataFrame:
    """(suffix, record, weight) of values (record, value, weight), equal ones summed before any shuffle.

    A value is cut into words, numbers and single other signs, and has one suffix for each of them, cut after ``max_n``
    pieces, or to the end of the value if that is ALL. With ``whole`` pieces keep the blanks before them, the first one
    carries BEGIN and the last one END, so that a value is the gram from one to the other; the suffix at BEGIN is never
    cut, the others are cut after INNER pieces, as only grams of whole values are asked for.
    """
    word = r"\p{Nd}+|[\p{L}\p{M}\p{Nl}\p{No}]+|[^\s\p{L}\p{M}\p{N}]"
    if whole:
        cut = values.select("record", "weight", F.regexp_extract_all(escape(F.col("value")), F.lit(rf"(\s*+(?:{word})|\s+)"), 1).alias("bare"))
        last = F.size("bare") - 1
        signed = F.transform("bare", lambda w, i: F.concat(F.when(i == 0, BEGIN).otherwise(""), w, F.when(i == last, END).otherwise("")))
        cut = cut.select("record", "weight", F.when(last < 0, F.array(F.lit(BEGIN + END))).otherwise(signed).alias("words"))
        length = lambda i: F.when(i == 0, F.size("words")).otherwise(INNER)
    else:
        cut = values.select("record", "weight", F.regexp_extract_all(F.translate("value", GAP + BEGIN + END + "\x04", "    "), F.lit(f"({word})"), 1).alias("words"))
        length = lambda i: F.size("words") if max_n == ALL else F.lit(max_n)
    ends = F.transform("words", lambda _, i: F.array_join(F.slice("words", i + 1, length(i)), GAP))
    pieces = cut.select("record", "weight", F.explode(ends).alias("suffix"))
    return pieces.groupBy("suffix", "record").agg(F.sum("weight").alias("weight"))


def _intervals(batches: Iterator[pa.RecordBatch], whole: bool = False) -> Iterator[pa.RecordBatch]:
    """Closed common-prefix intervals of one stretch of the suffix array; those that may go on in the next or come from the last stretch give their records as rows.

    The stack holds one open interval per length. The records of the interval that began at place s are those seen last
    at or after s; its number of records is its number of (suffix, record) rows less the rows whose record was seen at
    or after s before (the duplicate adjacencies). With ``whole`` only the intervals of whole values are given out.
    """
    out: list[tuple] = []
    stack: list[list] = []  # of [begin, occurrences, rows, duplicates], at index size - 1
    pieces: list[str] = []
    last: dict[str | None, int] = {}
    place = 0

    def close(keep: int, final: bool = False) -> None:
        while len(stack) > keep:
            begin, occurrences, rows, duplicates = stack.pop()
            size = len(stack) + 1
            gram = GAP.join(pieces[:size]) if not whole or (pieces[0][0] == BEGIN and pieces[size - 1][-1] == END) else None
            if gram is None:
                pass
            elif begin == 0 or final:
                out.append((gram, size, occurrences, None, None))
                out.extend((gram, size, None, None, r) for r, p in last.items() if p >= begin and r is not None)
            else:
                out.append((gram, size, occurrences, rows - duplicates, None))
            if stack:
                stack[-1][1] += occurrences
                stack[-1][2] += rows
                stack[-1][3] += duplicates
        if not stack:
            last.clear()

    def flush() -> pa.RecordBatch:
        columns = zip(*out, strict=True)
        batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["gram", "size", "occurrences", "records", "record"])
        out.clear()
        return batch

    for batch in batches:
        for suffix, record, weight in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            new = suffix.split(GAP)
            common = 0
            for a, b in zip(pieces, new):
                if a != b:
                    break
                common += 1
            close(common)
            pieces = new
            while len(stack) < len(new):
                stack.append([place, 0, 0, 0])
            stack[-1][1] += weight
            if record is not None:
                stack[-1][2] += 1
                if (seen := last.get(record)) is not None:
                    # duplicate in every open interval that began at or before the last sight; it is carried to the shorter ones when intervals close
                    depth = len(stack)
                    while depth and stack[depth - 1][0] > seen:
                        depth -= 1
                    if depth:
                        stack[depth - 1][3] += 1
                last[record] = place
            place += 1
            if len(out) >= 20_000:
                yield flush()
    close(0, True)
    if out:
        yield flush()


def gram_counts(values: DataFrame, max_n: int = ALL, whole: bool = False, partitions: int | None = None) -> DataFrame:
    """(gram, size, occurrences, records): how often each n-gram occurs in ``values`` (record, value, weight) and in how many records.

    Null values are left out; null records count as occurrences only; an empty value has no gram but is a whole value. Grams
    of 1 to ``max_n`` pieces, or of any number if it is ALL, are counted (pieces joined by a blank), with ``whole`` those
    that are a whole value, exactly as it is. The suffix array is sorted over all partitions by (suffix, record); an n-gram
    that a border of partitions may cut is put together from its parts by its distinct records, every other comes out of
    one interval.
    """
    spark = values.sparkSession
    rows = suffixes(values.where(F.col("value").isNotNull()), max_n, whole)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = rows.select("suffix", "record", "weight").repartitionByRange(n, "suffix", "record").sortWithinPartitions("suffix", "record").mapInArrow(lambda batches: _intervals(batches, whole), _ROWS)
    inner = parts.where("records is not null").select("gram", "size", "occurrences", "records")
    cut = (
        parts.where("records is null")
        .groupBy("gram", "size", "record")
        .agg(F.sum("occurrences").alias("occurrences"))
        .groupBy("gram", "size")
        .agg(F.sum("occurrences").alias("occurrences"), F.count("record").alias("records"))
    )
    counted = inner.unionByName(cut)
    if whole:
        text = F.replace("gram", F.lit(GAP), F.lit(""))
        return counted.select(unescape(text.substr(F.lit(2), F.length(text) - 2)).alias("gram"), "size", "occurrences", "records")
    return counted.select(F.replace("gram", F.lit(GAP), F.lit(" ")).alias("gram"), "size", "occurrences", "records")


def annotation_values(annotations: DataFrame) -> DataFrame:
    """(record, value, weight) of the annotations: one occurrence per anno_key, in its article. Rows without a key count each; of one key's texts the least counts."""
    keyed = annotations.where("anno_key is not null and text is not null").groupBy("anno_key").agg(F.min(F.struct("text", "article_id")).alias("x"))
    free = annotations.where("anno_key is null and text is not null").select(F.struct("text", "article_id").alias("x"))
    once = keyed.select("x").unionByName(free)
    return once.groupBy(F.col("x.article_id").alias("record"), F.col("x.text").alias("value")).agg(F.count("*").alias("weight"))


def term_frequencies(annotations: DataFrame, least: int = 3, most: float = 0.05) -> DataFrame:
    """(term, occurrences, articles, mark) of every distinct text as stored, the grams from begin to end of a text in the suffix array; mark 'rare' under ``least`` articles, else 'common' over ``most`` of the articles that have a text, else 'useful'."""
    total = annotations.where("text is not null").agg(F.countDistinct("article_id").alias("total"))
    counts = gram_counts(annotation_values(annotations), whole=True)
    return counts.select(
        F.col("gram").alias("term"),
        "occurrences",
        F.col("records").alias("articles"),
        F.when(F.col("records") < least, "rare").when(F.col("records") > most * total.scalar(), "common").otherwise("useful").alias("mark"),
    )
