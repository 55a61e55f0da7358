"""How five quality filters interact: what each removes in every order, and what only it would remove.

A relational word pipeline. Words are exploded and aggregated by (document, word),
then by document for totals and distinct words; the other flags are joined to them, and
one aggregate of conditional counts per part - a count for each of the 32 sets of
filters a document can fail, for all documents, good ones and toxic ones - holds all
that any order needs. Orders and steps are then read off these counters, so documents
are counted once and not once for each of the 120 orders.

The filters, on words ``[^\\x20\\x09-\\x0D]+`` (case matters) of whole texts:
A under 200 words; B 100 * distinct words < 50 * words; C 100 * ``[A-Z]`` characters >
2 * code points; D any of ``#$%&*|``; E the text is that of a row with a smaller id.

Data flow: texts are dealt once by (id, text hash), with which both word aggregates and
the joins of flags are partitioned. Rows equal in id and text are one key and counted
by their number. The first row of each text is told by a grouped minimum and met by
that key, not by the text, so a text that a third of the rows share is no hot key.

Defined results: a null text is empty, a null part is the empty string; an empty text
has no words and fails A alone, or A and E. A null id is smaller than no id and has
none below it, so such a row never fails E, and no label is its own. Of several labels
of an id, quality and toxic are the greatest. Rows that repeat an id and a text all
count and don't fail E because of each other. An empty table gives no rows.
"""

from __future__ import annotations

import json
from functools import reduce
from itertools import permutations

from pyspark.sql import Column, DataFrame, functions as F

FILTERS = "ABCDE"
#: Fixed values of the filters.
MIN_WORDS, MIN_DISTINCT_PERCENT, MAX_CAPITAL_PERCENT = 200, 50, 2
_BLANKS, _CAPITALS, _MARKS = r"[\x20\x09-\x0D]+", "[^A-Z]+", "[#$%&*|]"
_SETS = range(1 << len(FILTERS))
_ORDERS = ["".join(p) for p in permutations(FILTERS)]
_COUNTED = ("all", "good", "toxic")


def _keyed(docs: DataFrame, id_col: str, text_col: str, part_col: str) -> DataFrame:
    """One row per document row: its id, part and text, and a key (id0, h) that is never null."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    return rows.select("*", F.coalesce("id", F.lit(0)).alias("id0"), F.xxhash64("text", F.col("id").isNull()).alias("h"))


def word_totals(rows: DataFrame) -> DataFrame:
    """(id0, h, n_words, n_distinct) of every key whose text has a word."""
    texts = rows.select("id0", "h", "text").dropDuplicates(["id0", "h"])
    words = texts.select("id0", "h", F.explode(F.split("text", _BLANKS)).alias("word")).where("word != ''")
    per_word = words.groupBy("id0", "h", "word").agg(F.count(F.lit(1)).alias("n"))
    return per_word.groupBy("id0", "h").agg(F.sum("n").alias("n_words"), F.count(F.lit(1)).alias("n_distinct"))


def flagged(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(part, fails, n, good, toxic) for every document key: ``fails`` has bit k where filter k of FILTERS fails."""
    rows = _keyed(docs, id_col, text_col, part_col)
    capitals = F.length(F.regexp_replace("text", _CAPITALS, "")) * 100 > F.length("text") * MAX_CAPITAL_PERCENT
    facts = rows.select("id0", "h", "id", "part", capitals.alias("c"), F.col("text").rlike(_MARKS).alias("d"), F.unhex(F.sha2("text", 256)).alias("digest"))
    facts = facts.groupBy("id0", "h", "id", "part", "c", "d", "digest").agg(F.count(F.lit(1)).alias("n"))
    first = facts.where("id IS NOT NULL").groupBy("digest", "h").agg(F.min("id0").alias("id0")).select("id0", "h", F.lit(True).alias("is_first"))
    known = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("quality").cast("int").alias("q"), F.col("toxic").cast("int").alias("t")).where("id IS NOT NULL")
    known = known.groupBy("id").agg((F.max("q") == 1).alias("good"), (F.max("t") == 1).alias("toxic"))
    met = facts.join(word_totals(rows), ["id0", "h"], "left").join(first, ["id0", "h"], "left").join(known, "id", "left")
    words, distinct = F.coalesce("n_words", F.lit(0)), F.coalesce("n_distinct", F.lit(0))
    repeat = F.col("id").isNotNull() & F.col("is_first").isNull()
    tests = (words < MIN_WORDS, distinct * 100 < words * MIN_DISTINCT_PERCENT, F.col("c"), F.col("d"), repeat)
    bits = reduce(lambda a, b: a + b, (F.when(test, 1 << k).otherwise(0) for k, test in enumerate(tests)))
    yes = lambda c: F.coalesce(c, F.lit(False))
    return met.select("part", bits.alias("fails"), "n", yes("good").alias("good"), yes("toxic").alias("toxic"))


def counters(rows: DataFrame) -> DataFrame:
    """Per part three arrays of 32 counts, by the set of failed filters: all documents, good and toxic ones."""
    sums = []
    for name in _COUNTED:
        counted = F.lit(True) if name == "all" else F.col(name)
        sums += [F.coalesce(F.sum(F.when((F.col("fails") == s) & counted, F.col("n"))), F.lit(0)).alias(f"{name}_{s}") for s in _SETS]
    wide = rows.groupBy("part").agg(*sums)
    return wide.select("part", *[F.array(*[f"{name}_{s}" for s in _SETS]).alias(name) for name in _COUNTED])


def _total(counts: str, holds) -> Column:
    """The sum of a counter array over the sets (as bits) for which ``holds`` is true."""
    picked = F.transform(counts, lambda n, s: F.when(holds(s), n).otherwise(F.lit(0)))
    return F.aggregate(picked, F.lit(0).cast("long"), lambda a, n: a + n)


def audit(counts: DataFrame) -> DataFrame:
    """One row per part, order and step from the counters."""
    steps = [{"filter_order": order, "step": k + 1, "before": sum(1 << FILTERS.index(f) for f in order[:k]), "own": 1 << FILTERS.index(order[k])} for order in _ORDERS for k in range(len(order))]
    plan = F.from_json(F.lit(json.dumps(steps)), "array<struct<filter_order string, step int, before int, own int>>")  # one literal
    rows = counts.select("*", F.explode(plan).alias("s")).select("part", *_COUNTED, "s.*")
    before, own = F.col("before"), F.col("own")
    here = lambda s: (s.bitwiseAND(own) != 0) & (s.bitwiseAND(before) == 0)
    # Of the orders of the filters that a document fails, a filter comes first in an equal share, and then it removes.
    share = F.transform("all", lambda n, s: F.when(s.bitwiseAND(own) != 0, n * (F.lit(len(_ORDERS)) / F.bit_count(s)).cast("long")).otherwise(F.lit(0)))
    return rows.select(
        "part", "filter_order", "step",
        _total("all", lambda s: s.bitwiseAND(own.bitwiseOR(before)) == 0).alias("kept"),
        _total("all", here).alias("removed"),
        _total("all", lambda s: (s.bitwiseAND(own) != 0) & (s.bitwiseAND(before) != 0)).alias("redundant"),
        _total("all", lambda s: s == own).alias("unique_fails"),
        _total("good", here).alias("good_lost"),
        _total("toxic", here).alias("toxic_lost"),
        F.aggregate(share, F.lit(0).cast("long"), lambda a, n: a + n).alias("shapley"),
    )


def filter_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley)."""
    return audit(counters(flagged(docs, labels, id_col, text_col, part_col)))
