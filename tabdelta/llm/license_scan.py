"""Licence detection by canonical digests, in DataFrame functions only.

A text is normalised (lower case; copyright lines dropped; equivalent spellings
made one; punctuation and blanks collapsed) and its SHA-256 is looked up among the
digests of known licence texts normalised the same way. Entire units are compared:
the whole document, each paragraph (blank lines between) and each line. A licence
buried inside a longer line is outside this operator's meaning.

Defined results: one row per distinct id (a null id is a value of its own), with an
empty list where nothing matches; null texts count as empty; rows with equal ids
are one document, so repeated rows change nothing; extra columns are ignored; an
empty table gives an empty result. Known texts that normalise to nothing never
match. The known table is broadcast where counting it finds at most MAX_KNOWN rows of
digests; a longer one is joined by shuffle.

Normalising is the dear part, so units that can't match are left out before it:
every known text has a word that a unit of the same normal form must hold as it
stands (see ``needles``), and a unit with none of these words matches nothing.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import license_texts

MAX_KNOWN = 10_000

#: Equivalent spellings, each pattern with the form that stands for it.
SPELLINGS = (
    ("licence", "license"),
    ("organisation", "organization"),
    ("merchantibility", "merchantability"),
    ("non-commercial", "noncommercial"),
    ("sub-license", "sublicense"),
    ("per cent", "percent"),
    ("http://", "https://"),
    ("&", " and "),
    ("(c)", "©"),
)

#: Short notices by which works declare their licence, standard headers and complete texts.
#: BSD is the paragraph that opens every BSD licence; which of them it is, the whole text says, or the clause on names.
KNOWN = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    *license_texts.headers(),
    *license_texts.complete_texts(),
)

BLANK_LINE = r"\n[ \t\r]*\n"
_PUNCTUATION = "!\"#$%'()*+,-./:;<=>?@[\\]^_`{|}~–—‘’“”•"


def canonical(text: Column) -> Column:
    """The normal form of a unit."""
    x = F.lower(text)
    x = F.when(F.locate("copyright", x) + F.locate("©", x) + F.locate("(c)", x) > 0, F.regexp_replace(x, r"(?m)^[ \t*#/;-]*(copyright|©|\(c\))[^\n]*$", " ")).otherwise(x)
    for pattern, form in SPELLINGS:
        x = F.replace(x, F.lit(pattern), F.lit(form))
    x = F.translate(x, _PUNCTUATION, " " * len(_PUNCTUATION))
    return F.trim(F.regexp_replace(x, r"[ \t\n\x0B\f\r]+", " "))


def needles(known=KNOWN) -> tuple[str, ...]:
    """Letter sequences of which the lower case of every text that matches a known one holds at least one.

    A word of a normal form stands in the text itself if no equivalent spelling can have made a part of it: the
    letters of a word follow each other in the text, too, since all else only puts blanks in or takes them out.
    Words with "license" are the exception, and stand there with it or with its other spelling.
    """
    spelled = {w for _, form in SPELLINGS for w in re.findall("[a-z]+", form)} - {"license"}
    texts = []
    for _, text in known:
        words = set()
        for w in set(re.findall(r"(?<![^ ])[a-z]{5,}(?![^ ])", plain_canonical(text))):
            if not any(x in w for x in spelled):
                words.add(w)
        if words:
            texts.append(words)
        elif plain_canonical(text):
            return ()  # a text without such a word: nothing can be left out
    found: list[str] = []
    while texts:
        counts = Counter(w for words in texts for w in words)
        best = min(counts, key=lambda w: (-counts[w], -len(w), w))
        found.append(best)
        texts = [words for words in texts if best not in words]
    return tuple(sorted({x for w in found for x in ((w, w.replace("license", "licence")) if "license" in w else (w,))}))


def plain_canonical(text: str) -> str:
    """The normal form of one known text, on the driver."""
    x = text.lower()
    if "copyright" in x or "©" in x or "(c)" in x:
        x = re.sub(r"(?m)^[ \t*#/;-]*(copyright|©|\(c\))[^\n]*$", " ", x)
    for pattern, form in SPELLINGS:
        x = x.replace(pattern, form)
    return " ".join(x.translate({ord(c): " " for c in _PUNCTUATION}).split())


def known_table(spark: SparkSession, known=KNOWN) -> DataFrame:
    """Distinct (digest, license_id) of known texts."""
    t = spark.createDataFrame(list(known), "license_id string, text string")
    return t.select(canonical(F.col("text")).alias("c"), "license_id").where(F.length("c") > 0).select(F.sha2("c", 256).alias("digest"), "license_id").distinct()


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", known: DataFrame | None = None) -> DataFrame:
    """Per id: license_ids (sorted), n_units (matching units) and whole_text (whether an entire document matched).

    ``known``: (digest, license_id) in place of the table of KNOWN.
    """
    words = needles() if known is None else ()
    bounded = known is None or known.limit(MAX_KNOWN + 1).count() <= MAX_KNOWN
    known = known_table(docs.sparkSession) if known is None else known
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    unit = lambda x, kind: F.struct(x.alias("unit"), F.lit(kind).alias("kind"))
    none = F.array().cast("array<string>")

    def may_match(x: Column) -> Column:
        low = F.lower(x)
        return reduce(lambda a, b: a | b, (F.contains(low, F.lit(w)) for w in words)) if words else F.lit(True)

    paragraphs = F.when(F.rlike(text, F.lit(BLANK_LINE)), F.split(text, BLANK_LINE)).otherwise(none)
    lines = F.when(F.locate("\n", text) > 0, F.split(text, "\n")).otherwise(none)
    units = lambda parts, kind: F.transform(F.filter(parts, may_match), lambda x: unit(x, kind))
    found = F.when(may_match(text), F.concat(F.array(unit(text, "whole")), units(paragraphs, "paragraph"), units(lines, "line")))
    exploded = docs.select(F.col(f"`{id_col}`").alias("id"), F.explode_outer(found).alias("u"))
    digest = F.when(F.col("u.unit").isNotNull(), F.sha2(canonical(F.col("u.unit")), 256))
    exploded = exploded.select("id", F.col("u.kind").alias("kind"), digest.alias("digest"))
    joined = exploded.join(F.broadcast(known) if bounded else known, "digest", "left")
    matched = F.col("license_id").isNotNull()
    return joined.groupBy("id").agg(F.sort_array(F.collect_set("license_id")).alias("license_ids"), F.count(F.when(matched, 1)).alias("n_units"), F.max(F.coalesce(matched & (F.col("kind") == "whole"), F.lit(False))).alias("whole_text")).withColumnRenamed("id", id_col)
