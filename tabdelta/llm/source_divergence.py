"""How far sources of a language differ in the words they use, as exact integers.

Wide term vectors: occurrences are counted per (language, source, term) in one
pre-aggregated shuffle, each kept term is pivoted into an array indexed by the sources
of its language, and JVM higher-order functions emit from it the contribution of every
pair of sources, which partial aggregation sums before they are shuffled.

A term is a match of ``[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+``, of which only A-Z are
lower-cased. A language keeps the terms that ``MIN_DOCS`` of its documents hold. With V
kept terms and N their occurrences in a group, a term that occurs c times there has
p = 1 + floor(10^9 * (c + 5) / (N + 5 * V)); quotients are taken in decimals of 38
digits, so nothing is rounded.

Part ``pair``: the sum over all kept terms of |p - q| for every other source of the
language. Part ``term``: the ``TOP`` kept terms that occur in a source and are more
likely there than in the whole language, by p - q. Ranks go by value, then by item in
UTF-8 order.

Hot groups: a language or source of any size is summed before the shuffle, by term and
by pair. The arrays are as wide as a language has sources, and the result has a row for
each ordered pair of them, so sources are hosts or collections here and not documents.

Defined results: null text, language and source are empty; a group without terms takes
part with c = 0 for every term. Where a language keeps no term (V = 0), every pair has
value 0 and there are no terms. A language with one source has no pairs. Rows that
repeat count each. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .shared import Workspace

MIN_DOCS, TOP = 30, 50
#: Fixed values of the measure.
_SCALE, _PRIOR = 1_000_000_000, 5
_BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def terms(text: Column) -> Column:
    """All terms of a text, in order."""
    return F.array_remove(F.split(F.translate(text, _UPPER, _LOWER), _BETWEEN), "")


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, term, n, n_docs): occurrences and documents; a group's documents without terms have the term null."""
    plain = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    found = docs.select(plain(lang_col).alias("lang"), plain(source_col).alias("source"), terms(plain(text_col)).alias("terms"))
    # Every occurrence comes first, then every distinct term of the document once.
    both = found.select("lang", "source", F.size("terms").alias("size"), F.posexplode_outer(F.concat("terms", F.array_distinct("terms"))).alias("at", "term"))
    is_occurrence = (F.col("at") < F.col("size")).cast("long")
    return both.select("lang", "source", "term", is_occurrence.alias("o")).groupBy("lang", "source", "term").agg(F.sum("o").alias("n"), F.sum(1 - F.col("o")).alias("n_docs"))


def probability(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(_SCALE * (n + _PRIOR) / (total + _PRIOR * kept)), exactly."""
    whole = lambda c: c.cast("decimal(18,0)")
    share = F.call_function("div", whole(n + _PRIOR) * F.lit(_SCALE).cast("decimal(10,0)"), whole(total + kept * _PRIOR))
    return share + 1



def divergence(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank)."""
    work = Workspace(docs.sparkSession, "divergence")
    counts = work.stage(term_counts(docs, text_col, lang_col, source_col), "counts")
    entry = F.struct("source", "n")
    kept = counts.where("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("n_docs").alias("n_docs"), F.sum("n").alias("n"), F.collect_list(entry).alias("by_source"))
    kept = work.stage(kept.where(F.col("n_docs") >= min_docs).select("lang", "term", "n", F.map_from_entries("by_source").alias("by_source")), "kept")

    # Per language: its number of kept terms, their occurrences, and its sources in order, with the occurrences in each.
    in_group = kept.select("lang", F.explode("by_source").alias("source", "n")).groupBy("lang", "source").agg(F.sum("n").alias("n"))
    groups = counts.select("lang", "source").distinct().join(in_group, ["lang", "source"], "left").select("lang", "source", F.coalesce("n", F.lit(0)).alias("n"))
    sources = groups.groupBy("lang").agg(F.array_sort(F.collect_list(entry)).alias("sources"))
    sizes = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("n").alias("total"))
    langs = work.stage(sources.join(sizes, "lang", "left").select("lang", "sources", F.coalesce("v", F.lit(0)).alias("v"), F.coalesce("total", F.lit(0)).alias("total")), "langs")

    # A term's vector: its probability in each source of the language, and in the language.
    p = F.transform("sources", lambda s: probability(F.coalesce(F.try_element_at("by_source", s["source"]), F.lit(0)), s["n"], F.col("v")))
    vectors = work.stage(kept.join(langs, "lang").select("lang", "term", p.alias("p"), probability(F.col("n"), F.col("total"), F.col("v")).alias("q"), F.transform("sources", lambda s: F.map_contains_key("by_source", s["source"])).alias("occurs")), "vectors")

    # Contributions of pairs i < j; one of 0 for each pair, so that it is there when no term is.
    last = F.size("p") - 1
    ahead = lambda i, n, f: F.transform(F.sequence(i + 1, n), lambda j: F.struct(i.alias("i"), j.alias("j"), f(j).alias("f")))
    of_term = F.flatten(F.transform(F.sequence(F.lit(0), last - 1), lambda i: ahead(i, last, lambda j: F.abs(F.get("p", i) - F.get("p", j)))))
    some = vectors.where(F.size("p") > 1).select("lang", F.explode(of_term).alias("x")).select("lang", "x.*")
    n_sources = F.size("sources") - 1
    none = langs.where(F.size("sources") > 1).select("lang", n_sources.alias("m"), F.explode(F.sequence(F.lit(0), n_sources - 1)).alias("i"))
    none = none.select("lang", "i", F.explode(F.sequence(F.col("i") + 1, F.col("m"))).alias("j"), F.lit(0).cast("long").alias("f"))
    sums = some.unionByName(none).groupBy("lang", "i", "j").agg(F.sum("f").alias("value"))
    name = lambda k: F.get("sources", F.col(k))["source"]
    named = sums.join(langs.select("lang", "sources"), "lang").select("lang", name("i").alias("a"), name("j").alias("b"), "value")
    sides = F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))
    pairs = named.select("lang", F.explode(sides).alias("s"), "value").select("lang", "s.source", F.lit("pair").alias("part"), "s.item", "value")

    each = vectors.select("lang", "term", "q", F.explode(F.arrays_zip("p", "occurs", F.sequence(F.lit(0), last).alias("k"))).alias("x")).where("x.occurs AND x.p > q")
    over = each.select("lang", "term", F.col("x.k").alias("k"), (F.col("x.p") - F.col("q")).alias("value"))
    place = lambda *group: Window.partitionBy(*group).orderBy(F.desc("value"), "item")
    best = over.withColumnRenamed("term", "item").withColumn("rank", F.row_number().over(place("lang", "k"))).where(F.col("rank") <= top)
    best = best.join(langs.select("lang", "sources"), "lang").select("lang", name("k").alias("source"), F.lit("term").alias("part"), "item", "value", "rank")
    return pairs.withColumn("rank", F.row_number().over(place("lang", "source"))).unionByName(best)
