"""Mixing sources to target weights: nested hash thresholds from histograms of tokens, without sorting."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossaflow.session import checkpointed

#: Where the vocabulary of the public tokenizer lies, on every executor.
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Bits of the hash that one histogram resolves, and histograms until single documents are told apart.
BITS, LEVELS = 8, 6
#: Fixed value. The pre-tokenization of byte-level BPE of 50k tokens, as published with it.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@cache
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(documents: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, tokens) of the documents with a text that isn't blank."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = _encoding(path).encode_ordinary
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "source": b["source"], "tokens": [len(encode(t)) for t in b["text"]]})

    texts = documents.where(F.col("doc_id").isNotNull() & F.col("source").isNotNull() & F.col("text").rlike(r"\S")).select("doc_id", "source", "text")
    return texts.mapInPandas(count, "doc_id bigint, source string, tokens bigint")


def budgets(totals: dict[str, int], targets: list[tuple[str, float, int]], size: int | None = None) -> dict[str, int]:
    """Tokens that each source is to give: its share of ``size``, or of the largest total that no source's repeats fall short of. Sources without tokens give none."""
    live = [(s, share, most) for s, share, most in targets if totals.get(s) and share and share > 0 and (most or 0) > 0]
    if size is None:
        size = min((totals[s] * most / share for s, share, most in live), default=0)
    return {s: min(int(size * share), totals[s] * most) for s, share, most in live}


def thresholds(counted: DataFrame, wanted: dict[str, int]) -> dict[str, int]:
    """Per source the threshold under which the hashes of its documents sum to ``wanted`` tokens as nearly as the order of the hashes allows: the document that goes over it is taken if that is nearer.

    A histogram by the first BITS bits of the hash gives the bucket that holds the threshold; only that bucket is
    refined by the next bits. Documents that agree in all bits stay or go together.
    """
    base = dict.fromkeys(wanted, 0)
    left = dict(wanted)
    for level in range(LEVELS):
        shift = BITS * (LEVELS - 1 - level)
        at = F.create_map(*[F.lit(x) for s, b in base.items() for x in (s, b)])[F.col("source")]
        inside = counted if level == 0 else counted.where(F.shiftright("hash", shift + BITS) == F.shiftright(at, shift + BITS))
        sums = inside.groupBy("source", F.shiftright("hash", shift).alias("bucket")).agg(F.sum("tokens").alias("tokens")).collect()
        by: dict[str, list[tuple[int, int]]] = {}
        for r in sums:
            by.setdefault(r.source, []).append((r.bucket, r.tokens))
        for s in wanted:
            # the place after the bucket's last sub-bucket stands for all of it
            edge = (base[s] >> shift) + (1 << BITS) - 1 if level else (1 << BITS) - 1
            for bucket, tokens in sorted(by.get(s, [])):
                if tokens > left[s]:
                    # at the last level the bucket is one document, or documents that agree in all bits
                    edge = bucket + 1 if level == LEVELS - 1 and tokens - left[s] < left[s] else bucket
                    break
                left[s] -= tokens
            else:
                edge += 1
            base[s] = edge << shift
            if edge << shift >= 1 << (BITS * LEVELS):
                base[s] = 1 << (BITS * LEVELS)
    return base


def mixed(documents: DataFrame, targets: DataFrame, size: int | None = None, seed: int = 7, path: str = TOKENIZER) -> tuple[DataFrame, DataFrame]:
    """(chosen, shares): the documents of the mix, with how often each is used, and what each source reaches.

    chosen (doc_id, source, tokens, repeats), repeats of 1 and more. shares (source_name, target_share, documents,
    tokens, actual_share). A source is used whole as often as its budget allows, then once more the documents with
    hashes under its threshold; no document is used more than max_repeats times. Without ``size`` the mix is as large as
    the scarcest source permits. Documents without a source or text are in no mix; a target without documents reaches
    0, and the other sources keep their proportions. The targets are a specification, held by the driver. The same text under several doc_ids counts each time.
    """
    rows = targets.where("source_name is not null").groupBy("source_name").agg(F.max("target_share").alias("share"), F.max("max_repeats").alias("most")).collect()
    names = [r.source_name for r in rows]
    spark = documents.sparkSession
    if not names:
        return spark.createDataFrame([], "doc_id bigint, source string, tokens bigint, repeats int"), spark.createDataFrame([], "source_name string, target_share double, documents bigint, tokens bigint, actual_share double")
    of_targets = documents.where(F.col("source").isin(names))
    counted = checkpointed(token_counts(of_targets, path).withColumn("hash", F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id"), 64 - BITS * LEVELS)))
    totals = {r.source: r.tokens for r in counted.groupBy("source").agg(F.sum("tokens").alias("tokens")).collect()}
    wanted = budgets(totals, [(r.source_name, r.share, r.most) for r in rows], size)
    whole = {s: b // totals[s] for s, b in wanted.items()}
    under = thresholds(counted, {s: b - whole[s] * totals[s] for s, b in wanted.items()}) if wanted else {}
    plan = spark.createDataFrame([(s, int(whole[s]), int(under[s])) for s in wanted], "plan_source string, whole int, threshold long")
    repeats = F.col("whole") + F.when(F.col("hash") < F.col("threshold"), 1).otherwise(0)
    chosen = counted.join(F.broadcast(plan), F.col("source") == F.col("plan_source")).select("doc_id", "source", "tokens", repeats.cast("int").alias("repeats")).where("repeats > 0")
    reached = chosen.groupBy("source").agg(F.sum("repeats").cast("long").alias("documents"), F.sum(F.col("tokens") * F.col("repeats")).alias("tokens"))
    total = reached.agg(F.sum("tokens").alias("total"))
    shares = (
        targets.where("source_name is not null")
        .groupBy("source_name")
        .agg(F.max("target_share").alias("target_share"))
        .join(reached, F.col("source_name") == F.col("source"), "left")
        .select("source_name", "target_share", F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce(F.col("tokens") / total.scalar(), F.lit(0.0)).alias("actual_share"))
    )
    return chosen, shares
