"""Exact length histogram.

Documents are counted by their encoded length, and everything asked about a
context limit is answered from that histogram: suffix sums over the lengths give
documents and tokens at or above any length, truncated totals and quantiles.
Suffix sums run up a tree of ranges: within ranges of lengths, over the totals of
those ranges within wider ones, and so on, so no step sees more rows in one task
than a range has parts. At the top stands one row per RANGE ** LEVELS lengths.

Defined results: a null text counts as empty, of length 0; rows are counted as
they are, repeated ones included; extra columns are ignored; an empty table gives
an empty histogram.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from .bpe import default_path, json_bpe
from .shared import Workspace

#: Parts of a range, and how often ranges are put into wider ranges: the top has one row per 65,536 lengths.
RANGE = 256
LEVELS = 2
#: What the report asks: context limits, and shares of the documents.
LIMITS = tuple(1 << b for b in range(7, 21))
SHARES = (0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99, 1.0)


def token_lengths(docs: DataFrame, text_col: str = "text", tokenizer_path: str | None = None) -> DataFrame:
    """The encoded length of every document, one row each: n_tokens."""
    path = tokenizer_path or default_path()

    def run(batches):
        encoder = json_bpe(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(encoder.encode(t.as_py() or "")) for t in b.column(0)], pa.int64())], names=["n_tokens"])

    return docs.select(F.col(f"`{text_col}`").cast("string")).mapInArrow(run, T.StructType([T.StructField("n_tokens", T.LongType())]))


def histogram(lengths: DataFrame) -> DataFrame:
    """Documents per length, written once: whatever is asked of it later reads a row per length and no text."""
    counted = lengths.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs"))
    return Workspace(lengths.sparkSession, "token_counts").stage(counted, "histogram")


def _at_or_above(rows: DataFrame, width: int, levels: int) -> DataFrame:
    """(at, d_ge, m_ge, d_all, m_all): sums of d and m over rows at or above ``at``, and over all rows."""
    down = Window.orderBy(F.desc("at")).rowsBetween(Window.unboundedPreceding, 0)
    if not levels:
        whole = Window.orderBy(F.desc("at")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        return rows.select("at", F.sum("d").over(down).alias("d_ge"), F.sum("m").over(down).alias("m_ge"), F.sum("d").over(whole).alias("d_all"), F.sum("m").over(whole).alias("m_all"))
    part = F.floor(F.col("at") / width)
    above = _at_or_above(rows.groupBy(part.alias("at")).agg(F.sum("d").alias("d"), F.sum("m").alias("m")), width, levels - 1)
    own = Window.partitionBy("part").orderBy(F.desc("at")).rowsBetween(Window.unboundedPreceding, 0)
    within = rows.withColumn("part", part).select("part", "at", F.sum("d").over(own).alias("d_own"), F.sum("m").over(own).alias("m_own"), F.sum("d").over(Window.partitionBy("part")).alias("d_part"), F.sum("m").over(Window.partitionBy("part")).alias("m_part"))
    both = within.join(above.withColumnRenamed("at", "part"), "part")
    ge = lambda x: (F.col(f"{x}_own") + F.col(f"{x}_ge") - F.col(f"{x}_part")).alias(f"{x}_ge")
    return both.select("at", ge("d"), ge("m"), "d_all", "m_all")


def suffix_sums(hist: DataFrame, width: int = RANGE, levels: int = LEVELS) -> DataFrame:
    """Per length L that occurs: sums over documents of at least L tokens, and the totals when texts are cut at L.

    docs_ge, tokens_ge: documents of length >= L and their tokens. docs_lt, tokens_lt: the rest.
    truncated_total: tokens kept under the limit L. tokens_lost: tokens cut off.
    rank_lo, rank_hi: the ranks (from 1, ascending) that have length L, for quantiles.
    """
    rows = hist.select(F.col("n_tokens").alias("at"), F.col("n_docs").alias("d"), (F.col("n_tokens") * F.col("n_docs")).alias("m"))
    s = hist.select("n_tokens", "n_docs").join(_at_or_above(rows, width, levels).withColumnRenamed("at", "n_tokens"), "n_tokens")
    docs, tokens, length = F.col("d_ge"), F.col("m_ge"), F.col("n_tokens")
    lower = F.col("d_all") - docs
    return s.select(
        length, "n_docs", docs.alias("docs_ge"), tokens.alias("tokens_ge"), lower.alias("docs_lt"), (F.col("m_all") - tokens).alias("tokens_lt"),
        (F.col("m_all") - tokens + length * docs).alias("truncated_total"), (tokens - length * docs).alias("tokens_lost"),
        (lower + 1).alias("rank_lo"), (lower + F.col("n_docs")).alias("rank_hi"))


def truncated_totals(sums: DataFrame, limits=LIMITS) -> DataFrame:
    """Per limit, whatever lengths occur: tokens_kept and tokens_lost when texts are cut there, and docs_cut. No rows for no documents.

    All comes from the first length above the limit: tokens_lost = tokens there and above less the limit for each document.
    """
    asked = sums.select("n_tokens", "docs_ge", "tokens_ge", (F.col("tokens_ge") + F.col("tokens_lt")).alias("total"), F.explode(F.array(*[F.lit(x).cast("long") for x in limits])).alias("limit"))
    over = F.col("n_tokens") > F.col("limit")
    # The suffix sums fall as the length grows, so the first length above the limit has the greatest of them.
    most = lambda c: F.coalesce(F.max(F.when(over, F.col(c))), F.lit(0))
    one = asked.groupBy("limit").agg(F.max("total").alias("total"), most("docs_ge").alias("docs_cut"), most("tokens_ge").alias("mass"))
    lost = F.col("mass") - F.col("limit") * F.col("docs_cut")
    return one.select("limit", (F.col("total") - lost).alias("tokens_kept"), lost.alias("tokens_lost"), "docs_cut")


def quantiles(sums: DataFrame, shares=SHARES) -> DataFrame:
    """Per share: the least length that at least that share of the documents don't exceed. No rows for no documents."""
    asked = sums.select("n_tokens", "rank_hi", (F.col("docs_ge") + F.col("docs_lt")).alias("n"), F.explode(F.array(*[F.lit(float(x)) for x in shares])).alias("share"))
    return asked.where(F.col("rank_hi") >= F.greatest(F.lit(1), F.ceil(F.col("share") * F.col("n")))).groupBy("share").agg(F.min("n_tokens").alias("n_tokens"))


def report(sums: DataFrame, limits=LIMITS, shares=SHARES) -> DataFrame:
    """The suffix sums (asked ``length``), the totals under each limit (``limit``: n_tokens is the limit) and the
    quantiles (``quantile``: share says which) in one table; a column that a row's kind doesn't have is null."""
    sums = Workspace(sums.sparkSession, "token_counts").stage(sums, "sums")
    by_length = sums.withColumn("asked", F.lit("length"))
    by_limit = truncated_totals(sums, limits).select(F.lit("limit").alias("asked"), F.col("limit").alias("n_tokens"), F.col("tokens_kept").alias("truncated_total"), "tokens_lost", "docs_cut")
    by_share = quantiles(sums, shares).withColumn("asked", F.lit("quantile"))
    return by_length.unionByName(by_limit, allowMissingColumns=True).unionByName(by_share, allowMissingColumns=True)
