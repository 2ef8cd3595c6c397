"""Dictionary look-up: all matches of all terms, overlapping ones too, as a join on token n-grams."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from glossaflow.functions import text as T
from glossaflow.operators.termlist import first_index
from glossaflow.schema import INFO

#: Rows up to which a dictionary is sent to all executors; beyond, both sides are shuffled by key.
BROADCAST_ROWS = 500_000

_PYTHON = {T.TOKEN: r"\d+|[^\W\d_]+", T.TOKEN_PARENS: r"\d+|[^\W\d_]+|[()]"}


def checked(small: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``small`` marked for broadcast if it has no more than ``rows`` rows, else as it is."""
    return F.broadcast(small) if small.limit(rows + 1).count() <= rows else small


def token_spans(texts: DataFrame, text: str = "text", start: str | None = None, pattern: str = T.TOKEN) -> DataFrame:
    """``texts`` with a column tokens, array of (token, gap, start, end): tokens with what lies before the next one, and code-point offsets, counted from ``start`` of the row if given.

    No shuffle: each text is cut where it lies, an Arrow batch at a time. Null and empty texts have no tokens.
    """
    regex = _PYTHON.get(pattern, pattern)
    keys = [f for f in texts.schema.fields]
    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keys)
    at, offset = texts.columns.index(text), texts.columns.index(start) if start else None

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = re.compile(regex).finditer
        for b in batches:
            bounds, toks, gaps, starts, ends = [0], [], [], [], []
            shifts = b.column(offset).to_pylist() if offset is not None else None
            for i, t in enumerate(b.column(at).to_pylist()):
                if t:
                    shift = (shifts[i] or 0) if shifts else 0
                    last = None
                    for m in find(t):
                        if last is not None:
                            gaps.append(t[last : m.start()])
                        last = m.end()
                        toks.append(m.group())
                        starts.append(m.start() + shift)
                        ends.append(last + shift)
                    if last is not None:
                        gaps.append("")
                bounds.append(len(toks))
            rows = pa.StructArray.from_arrays([pa.array(toks, pa.string()), pa.array(gaps, pa.string()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], ["token", "gap", "start", "end"])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), rows)], names=[*b.schema.names, "tokens"])

    return texts.mapInArrow(cut, f"{names}, tokens array<struct<token:string,gap:string,start:int,end:int>>")


def match(tokenised: DataFrame, index: DataFrame, keys: list[str], normalisers: str = "lowercase") -> DataFrame:
    """(keys, start, end, text, n_toks, recognizer, info fields): every match of the ``index`` in the rows of ``tokenised`` (keys, tokens).

    Matches may overlap and nest, and never leave a row. A position carries no more tokens than the longest term has;
    it is first looked up by its first token, and only the lengths of terms that begin so make n-grams. An entry that the
    index marks as stopped is compared exactly. The surface is put together from tokens and gaps, so texts are not joined again, and
    with a dictionary that is broadcast nothing is shuffled.
    """
    longest = index.agg(F.max("n_toks")).first()[0] or 1
    spots = F.transform(F.sequence(F.lit(1), F.size("tokens")), lambda i: F.slice("tokens", i, longest))
    rows = tokenised.where(F.size("tokens") > 0).select(*keys, F.explode(spots).alias("spot"))
    begun = rows.withColumn("first", T.normalise(F.col("spot")[0]["token"], normalisers)).join(checked(first_index(index)), "first")
    normed = begun.select(*keys, "spot", F.transform("spot", lambda t: T.normalise(t["token"], normalisers)).alias("norms"), "lengths")
    grams = normed.select(*keys, "spot", "norms", F.explode("lengths").alias("n")).where("n <= size(spot)")
    part = F.slice("spot", F.lit(1), F.col("n"))
    norm = F.array_join(F.slice("norms", F.lit(1), F.col("n")), T.GAP)
    exact = F.array_join(F.transform(part, lambda t: t["token"]), T.GAP)
    by_stop = "stopped" in index.columns
    last = F.col("spot")[F.col("n") - 1]
    surface = F.concat(F.array_join(F.transform(F.slice("spot", F.lit(1), F.col("n") - 1), lambda t: F.concat(t["token"], t["gap"])), ""), last["token"])
    found = grams.select(*keys, F.col("spot")[0]["start"].alias("start"), last["end"].alias("end"), surface.alias("text"), norm.alias("norm" if by_stop else "key"), *([exact.alias("__exact")] if by_stop else []))
    if not by_stop:
        return found.join(checked(index), "key").drop("key", "first")
    return found.join(checked(index), "norm").where(~F.col("stopped") | (F.col("key") == F.col("__exact"))).drop("key", "first", "norm", "stopped", "__exact")


def recognise(texts: DataFrame, index: DataFrame, keys: list[str], text: str = "text", start: str | None = None, normalisers: str = "lowercase", pattern: str = T.TOKEN) -> DataFrame:
    """(keys, start, end, text, recognizer, info fields): all entities of the rows of ``texts``. Rows without text have none."""
    plain = texts.select(*keys, F.col(text).alias("__text"), *([F.col(start).alias("__start")] if start else []))
    tokenised = token_spans(plain, "__text", "__start" if start else None, pattern)
    return match(tokenised, index, keys, normalisers).drop("n_toks")


def entity_order(extra: list[str] = ()) -> list[str]:
    """What orders entities within a text: place, then recognizer and all information."""
    return ["start", "end", "recognizer", *INFO, *extra]


def with_ids(entities: DataFrame, content: list[str], order: list[str], existing: DataFrame | None = None) -> DataFrame:
    """``entities`` with ascending ids per content, from one more than the greatest numeric id of ``existing`` (content, id)."""
    number = F.row_number().over(Window.partitionBy(*content).orderBy(*order))
    if existing is None:
        return entities.withColumn("id", number.cast("string"))
    last = existing.groupBy(*content).agg(F.max(F.expr("try_cast(id as bigint)")).alias("__last"))
    return entities.join(last, content, "left").withColumn("id", (number + F.coalesce("__last", F.lit(0))).cast("string")).drop("__last")


def recognise_all(texts: DataFrame, indices: list[DataFrame], keys: list[str], **options) -> DataFrame:
    """The entities of several dictionaries, in their order."""
    parts = [recognise(texts, i.withColumn("recognizer", F.lit(k)), keys, **options) for k, i in enumerate(indices)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out
