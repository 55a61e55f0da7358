"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document; the ledger keeps the measurements and
one bit per failed rule. Policies are versioned masks over the bits, so a new
policy, or an ablation of an old one, is bit arithmetic on the ledger and never
another pass over the texts.

Defined results: a null text counts as empty (no words, so rule ``few_words``
fails). Repeated rows, equal ids and null ids give one ledger row each. Input
columns named like a ledger column are replaced. An empty table gives an empty
ledger. Texts are read whole; memory is that of one batch plus one text.
"""

from __future__ import annotations

from itertools import count
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .shared import fresh, without

#: Bit number of each rule. Numbers are never reused; new rules are appended.
RULES = ("few_words", "repeated_windows", "symbols", "repeated_lines", "word_length", "shouting")

#: Versioned policies: the rules whose failure rejects a document.
POLICIES = {
    "base-1": ("few_words", "repeated_windows"),
    "full-1": RULES,
}

#: Thresholds of the rules, in per cent where they are ratios.
SYMBOLS_PER_100_WORDS = 10
REPEATED_LINES_PERCENT = 30
WORD_LENGTH = (2, 20)
UPPER_PERCENT = 50

SYMBOLS = b"#*$%&|<>"
_BLANK = b" \t\n\x0b\x0c\r"

MEASURES = T.StructType(
    [T.StructField(n, T.LongType(), False) for n in ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_letters", "n_upper")]
)


def repeat_words(words: list[bytes], width: int = 3) -> int:
    """Words inside windows of ``width`` words that occur at least twice, first occurrences included."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    number = defaultdict(count().__next__)
    ids = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
    code = ids[:n]
    for k in range(1, width):
        code = code * len(number) + ids[k : n + k]
        if len(number) > 2_000_000:  # else three ids fit 63 bits
            code = np.unique(code, return_inverse=True)[1].astype(np.int64)
    order = np.argsort(code, kind="stable")
    same = code[order[1:]] == code[order[:-1]]
    twice = np.zeros(n, bool)
    twice[order[1:]] = same
    twice[order[:-1]] |= same
    covered = np.zeros(len(words), bool)
    for k in range(width):
        covered[k : n + k] |= twice
    return int(covered.sum())


def measure(data: bytes) -> tuple[int, ...]:
    """The measurements of one text in UTF-8, in the order of MEASURES."""
    words = data.split()  # bytes.split(): exactly the six ASCII blanks
    raw = np.frombuffer(data, np.uint8)
    chars = int(((raw & 0xC0) != 0x80).sum())
    blanks = sum(data.count(b) for b in _BLANK)
    upper = int(((raw - 65) < 26).sum())
    letters = upper + int(((raw - 97) < 26).sum())
    lines = [x for x in data.split(b"\n") if x.strip()]
    symbols = sum(data.count(b) for b in SYMBOLS)
    return len(words), chars - blanks, symbols, len(lines), len(lines) - len(set(lines)), repeat_words(words), letters, upper


def failures() -> dict[str, Column]:
    """A condition per rule, true where the document fails; integer arithmetic only."""
    c = F.col
    return {
        "few_words": c("n_words") < 50,
        "repeated_windows": 100 * c("n_repeat_words") > 50 * c("n_words"),
        "symbols": 100 * c("n_symbols") > SYMBOLS_PER_100_WORDS * c("n_words"),
        "repeated_lines": (c("n_dup_lines") > 1) & (100 * c("n_dup_lines") > REPEATED_LINES_PERCENT * c("n_lines")),
        "word_length": (c("word_chars") < WORD_LENGTH[0] * c("n_words")) | (c("word_chars") > WORD_LENGTH[1] * c("n_words")),
        "shouting": (c("n_letters") > 0) & (100 * c("n_upper") > UPPER_PERCENT * c("n_letters")),
    }


def mask(rules) -> int:
    return sum(1 << RULES.index(r) for r in rules)


def ledger(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """One row per document: the columns ``keep`` (all by default), measurements and ``fail_bits``."""
    kept = without(docs, *[f.name for f in MEASURES], "fail_bits")
    names = kept.columns if keep is None else [k for k in keep if k in kept.columns]
    (own_text,) = fresh(names, "text")
    source = docs.select(F.col(f"`{text_col}`").cast("string").alias(own_text), *[F.col(f"`{c}`") for c in names])
    schema = T.StructType([f for f in kept.select([F.col(f"`{c}`") for c in names]).schema] + list(MEASURES))

    def run(batches):
        for b in batches:
            texts = b.column(0).cast(pa.large_binary())
            got = np.array([measure(x.as_py() or b"") for x in texts], np.int64).reshape(-1, len(MEASURES))
            yield pa.RecordBatch.from_arrays(b.columns[1:] + [pa.array(got[:, k]) for k in range(len(MEASURES))], names=b.schema.names[1:] + [f.name for f in MEASURES])

    bits = sum((F.when(cond, F.lit(1 << RULES.index(rule))).otherwise(0).cast("long") for rule, cond in failures().items()), F.lit(0).cast("long"))
    return source.mapInArrow(run, schema).withColumn("fail_bits", bits)


def passes(policy: str) -> Column:
    """True where no rule of the policy failed."""
    return F.col("fail_bits").bitwiseAND(F.lit(mask(POLICIES[policy])).cast("long")) == 0


def ablations(rows: DataFrame, policy: str) -> DataFrame:
    """Per rule of a policy: documents it fails, documents only it rejects, and what is kept without it.

    The ledger is first summed to one row per bit pattern (at most 2^rules rows),
    so this costs one small aggregation however large the ledger is.
    """
    whole = mask(POLICIES[policy])
    patterns = rows.groupBy(F.col("fail_bits").bitwiseAND(F.lit(whole).cast("long")).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    rules = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << RULES.index(r)).cast("long").alias("bit")) for r in POLICIES[policy]])).alias("r")
    hit = F.col("bits").bitwiseAND(F.col("r.bit")) != 0
    total = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(0))
    return patterns.select("bits", "n", rules).groupBy(F.col("r.rule").alias("rule")).agg(
        total(hit).alias("n_failed"),
        total(F.col("bits") == F.col("r.bit")).alias("n_failed_only"),
        total((F.col("bits") == 0) | (F.col("bits") == F.col("r.bit"))).alias("n_kept_without"),
    )


def keep_good(docs: DataFrame, policy: str = "full-1", text_col: str = "text") -> DataFrame:
    """The documents that pass a policy, with their own columns."""
    names = docs.columns
    tmp = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("doc"), F.col(f"`{text_col}`").alias("text"))
    return ledger(tmp, "text", keep=["doc"]).where(passes(policy)).select([F.col(f"doc.`{c}`").alias(c) for c in names])
