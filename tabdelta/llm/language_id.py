"""Language identification by Bayesian evidence fusion.

Four kinds of evidence are combined as log odds:
* text: byte-trigram likelihoods of a multinomial model fitted on whole texts of a
  bounded sample of labelled rows, tempered so that a long text counts as at most TEXT_EVIDENCE grams;
* the language a page declares in its markup (``<html lang=..>``);
* the address suffix: the top-level domain, or a language code that starts the path;
* the host: a prior smoothed up the hierarchy host -> registered domain -> suffix
  -> all rows, each level shrunk towards its parent with HOST_STRENGTH pseudo-rows.

Likelihoods of declarations and suffixes, and the priors of every level, are
grouped sums over all rows of the text model's posteriors. Sums are pre-aggregated
before the shuffle; the joins back are on keys whose hot values Spark can split.

Defined results: a null text gives no text evidence; a null or unparsable address no
suffix or host evidence; unknown declared codes count as undeclared; rows without
any evidence get the overall prior. Of languages that are equally likely the first
in alphabetical order is named. Every row gives one row, repeated ones included;
columns named like a result column are replaced. An empty table gives an empty
result; an empty training sample is an error. Texts are read whole; memory is that
of one text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .shared import Workspace, fresh, without

#: Bound on the labelled rows the text model is fitted on; their texts are read whole.
TRAIN_ROWS = 2000
TABLE_BITS = 16
#: Tasks that count the sample's trigrams.
COUNT_TASKS = 4
#: Trigrams looked up at a time.
_PIECE = 1 << 20
TEXT_EVIDENCE = 60
HOST_STRENGTH = 20.0
CODE_STRENGTH = 5.0

_TAGS = re.compile(rb"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>|&[a-z#0-9]+;")
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def grams(data: bytes) -> Iterator[np.ndarray]:
    """Slots of the byte trigrams of a text, letters lowered and blanks collapsed, in pieces; none for a blank text."""
    words = b" ".join(data.translate(_LOWER).split())
    if words:
        raw = np.frombuffer(b" " + words + b" ", np.uint8)
        for lo in range(0, len(raw) - 2, _PIECE):
            part = raw[lo : lo + _PIECE + 2].astype(np.uint32)
            code = part[:-2] << np.uint32(16) | part[1:-1] << np.uint32(8) | part[2:]
            yield (code * np.uint32(2654435761)) >> np.uint32(32 - TABLE_BITS)


def gram_counts(data: bytes) -> np.ndarray:
    counts = np.zeros(1 << TABLE_BITS, np.int64)
    for g in grams(data):
        counts += np.bincount(g, minlength=1 << TABLE_BITS)
    return counts


class TextModel:
    """Log likelihoods per trigram slot and language."""

    def __init__(self, languages: tuple[str, ...], table: np.ndarray):
        self.languages, self.table = languages, table

    @classmethod
    def fit(cls, counts: dict[str, np.ndarray]) -> TextModel:
        """From the trigrams counted in the texts of each language."""
        if not counts:
            raise ValueError("no labelled rows to fit on")
        languages = tuple(sorted(counts))
        seen = np.array([counts[lang] for lang in languages], np.float64) + 0.1
        table = np.log(seen / seen.sum(1, keepdims=True)).T
        return cls(languages, np.ascontiguousarray(table - table.mean(1, keepdims=True), np.float32))

    def scores(self, data: bytes) -> tuple[np.ndarray, int]:
        """Tempered log likelihoods, and the number of trigrams. Long texts are summed in pieces."""
        total, n = np.zeros(len(self.languages)), 0
        for g in grams(data):
            total += self.table[g].sum(0, dtype=np.float64)
            n += len(g)
        return total * (TEXT_EVIDENCE / max(n, TEXT_EVIDENCE)), n


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = TRAIN_ROWS) -> TextModel:
    """Fit on a bounded sample that doesn't depend on file order: the ``rows`` labelled rows whose hashed ids are least,
    and of each language that has under half an equal share of them, its own least up to that. Every language is known.

    Only hashes of the sampled rows and counts per trigram slot reach the driver; the texts are counted where they are.
    """
    lang, text = F.col(f"`{lang_col}`").cast("string"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    labelled = labelled.where(lang.isNotNull() & (lang != "")).select(F.xxhash64(F.col(f"`{id_col}`"), text).alias("h"), lang.alias("lang"), text.alias("text"))
    sizes = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a language
    n, share = sum(sizes.values()), max(1, rows // max(1, 2 * len(sizes)))
    # Hashes below these bounds number about twice the rows wanted, so tasks send few rows on, however many there are.
    below = lambda n, wanted: (1 << 63) - 1 if n <= 4 * wanted else -(1 << 63) + int(2 * wanted / n * (1 << 64))

    def least(df: DataFrame, n: int, wanted: int) -> list:
        for some in (df.where(F.col("h") <= below(n, wanted)), df):
            got = some.select("h", "lang").orderBy("h", "lang").limit(wanted).collect()
            if len(got) >= min(wanted, n):
                break
        return got

    got = least(labelled, n, rows)
    have = Counter(r.lang for r in got)
    few = [lang for lang in sorted(sizes) if have[lang] < min(share, sizes[lang])]
    extra = [r for lang in few for r in least(labelled.where(F.col("lang") == lang), sizes[lang], share)]
    chosen = Counter((r.h, r.lang) for r in [r for r in got if r.lang not in set(few)] + extra)  # repeated rows count as often as they were drawn
    if not chosen:
        raise ValueError("no labelled rows to fit on")
    spark = labelled.sparkSession
    drawn = F.broadcast(spark.createDataFrame([(h, lang, m) for (h, lang), m in chosen.items()], "h long, lang string, times long"))  # at most twice ``rows`` rows
    sample = labelled.where(F.col("h") <= max(h for h, _ in chosen)).join(drawn, ["h", "lang"]).groupBy("h", "lang", "times").agg(F.first("text").alias("text"))

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, times, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.large_binary())):
                sums[lang] = sums.get(lang, 0) + times * gram_counts(t.as_py())
        for lang, c in sums.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at, pa.int32()), pa.array(c[at], pa.int64())], names=["lang", "slot", "n"])

    few = sample.select("lang", "times", "text").coalesce(COUNT_TASKS)  # a bounded sample; each task sends a row per slot and language
    counted = few.mapInArrow(count, "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n"))
    counts = {lang: np.zeros(1 << TABLE_BITS, np.int64) for _, lang in chosen}
    found = counted.toArrow()  # at most 2^TABLE_BITS rows a language
    for lang in counts:
        own = found.filter(pc.equal(found["lang"], lang))
        counts[lang][own["slot"].to_numpy()] = own["n"].to_numpy()
    return TextModel.fit(counts)


def address_parts(url: Column) -> dict[str, Column]:
    """Host, registered domain (the last two labels) and suffix of an address; null where there is none."""
    host = F.nullif(F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/@?#]*@)?([^/:?#]+)", 1)), F.lit(""))
    top = F.substring_index(host, ".", -1)
    code = F.nullif(F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]+/([A-Za-z]{2})(?:[-_][A-Za-z]{2})?(?:/|$)", 1)), F.lit(""))
    return {"host": host, "domain": F.substring_index(host, ".", -2), "top": top, "suffix": F.concat_ws("/", top, code)}


def identify(rows: DataFrame, model: TextModel, text_col: str = "text", url_col: str | None = None, host_col: str | None = None, markup: bool = False, keep: list[str] | None = None) -> DataFrame:
    """rows' ``keep`` columns (all but the text by default) with language, posterior, text_language and n_grams.

    ``markup``: the text is HTML, whose declared language is evidence and whose tags are not text.
    ``host_col`` names a column that stands for the host where there is no address.
    """
    spark = rows.sparkSession
    added = ("language", "posterior", "text_language", "n_grams")
    kept = without(rows, *added, *([] if keep is not None else [text_col]))
    names = kept.columns if keep is None else keep
    languages = model.languages
    ids = list(range(len(languages)))
    c_text, c_host, c_domain, c_top, c_suffix, c_said, c_ll, c_n, c_share, c_by_said, c_by_suffix, c_fused = fresh([*names, *added], "text", "host", "domain", "top", "suffix", "said", "ll", "n", "share", "by_said", "by_suffix", "fused")
    none = F.lit(None).cast("string")
    parts = address_parts(F.col(f"`{url_col}`")) if url_col else {k: none for k in ("host", "domain", "top", "suffix")}
    if host_col:
        parts["host"] = F.coalesce(parts["host"], F.col(f"`{host_col}`").cast("string"))
    text = F.col(f"`{text_col}`").cast("string")
    said = F.lower(F.regexp_extract(text, r"(?i)<html[^>]*?\slang\s*=\s*[\"']?([A-Za-z]{2})", 1)) if markup else F.lit("")
    source = rows.select(text.alias(c_text), F.when(said.isin(*languages), said).alias(c_said), *[parts[k].alias(c) for k, c in (("host", c_host), ("domain", c_domain), ("top", c_top), ("suffix", c_suffix))], *[F.col(f"`{c}`") for c in names])
    schema = T.StructType(list(source.schema)[1:] + [T.StructField(c_ll, T.ArrayType(T.DoubleType())), T.StructField(c_n, T.LongType())])
    broadcast = spark.sparkContext.broadcast((model.languages, model.table))  # 2^TABLE_BITS floats a language, whatever the input

    def run(batches):
        own = TextModel(*broadcast.value)
        for b in batches:
            got = []
            for t in b.column(0).cast(pa.large_binary()):
                data = t.as_py() or b""
                got.append(own.scores(_TAGS.sub(b" ", data) if markup else data))
            yield pa.RecordBatch.from_arrays(b.columns[1:] + [pa.array([x.tolist() for x, _ in got], pa.list_(pa.float64())), pa.array([n for _, n in got], pa.int64())], names=b.schema.names[1:] + [c_ll, c_n])

    scored = Workspace(spark, "language_id").stage(source.mapInArrow(run, schema), "scored")
    soft = softmax(F.col(c_ll), ids)
    evidence = scored.where(F.col(c_n) > 0).select(c_host, c_domain, c_top, c_suffix, c_said, *[soft[k].alias(f"p{k}") for k in ids])
    sums = [F.sum(f"p{k}").alias(f"s{k}") for k in ids]
    vector = lambda prefix: F.array(*[F.col(f"{prefix}{k}") for k in ids])

    total = evidence.agg(*sums).first()  # one row: a sum per language
    mass = [1.0 + (total[f"s{k}"] or 0.0) for k in ids]
    base = [float(m / sum(mass)) for m in mass]
    prior = F.array(*[F.lit(x) for x in base])

    def shrunk(own: DataFrame, up: Column, share: str) -> DataFrame:
        """Shares per group, drawn towards the parent's share ``up`` by HOST_STRENGTH pseudo-rows."""
        n = sum(F.col(f"s{k}") for k in ids)
        return own.withColumn(share, F.array(*[(F.col(f"s{k}") + HOST_STRENGTH * up[k]) / (n + HOST_STRENGTH) for k in ids]))

    parent = F.coalesce("up", prior)
    tops = shrunk(evidence.where(F.col(c_top).isNotNull()).groupBy(c_top).agg(*sums), prior, "up").select(c_top, "up")
    domains = evidence.where(F.col(c_domain).isNotNull()).groupBy(c_domain, c_top).agg(*sums)
    domains = shrunk(domains.join(tops, c_top, "left"), parent, "share").select(c_domain, F.col("share").alias("up"))
    hosts = evidence.where(F.col(c_host).isNotNull()).groupBy(c_host, c_domain).agg(*sums)
    hosts = shrunk(hosts.join(domains, c_domain, "left"), parent, c_share).select(c_host, c_share)

    def likelihood(col: str, name: str) -> DataFrame:
        """P(value | language) up to a factor of the value: its share of each language's mass, smoothed."""
        own = evidence.where(F.col(col).isNotNull()).groupBy(col).agg(*sums)
        n = sum(F.col(f"s{k}") for k in ids)
        return own.select(col, F.array(*[F.log((F.col(f"s{k}") + CODE_STRENGTH * F.lit(base[k])) / (n + CODE_STRENGTH) / F.lit(base[k])) for k in ids]).alias(name))

    fused = scored.join(hosts, c_host, "left").join(likelihood(c_said, c_by_said), c_said, "left").join(likelihood(c_suffix, c_by_suffix), c_suffix, "left")
    total = F.array(*[F.col(c_ll)[k] + F.log(F.coalesce(F.col(c_share), prior)[k]) + F.coalesce(F.col(c_by_said)[k], F.lit(0.0)) + F.coalesce(F.col(c_by_suffix)[k], F.lit(0.0)) for k in ids])
    codes = F.array(*[F.lit(x) for x in languages])
    best = lambda v: codes[F.array_position(v, F.array_max(v)).cast("int") - 1]
    fused = fused.withColumn(c_fused, total)
    weights = softmax(F.col(c_fused), ids)
    return fused.select(*[F.col(f"`{c}`") for c in names], best(F.col(c_fused)).alias("language"), F.round(F.greatest(*weights), 6).alias("posterior"), F.when(F.col(c_n) > 0, best(F.col(c_ll))).alias("text_language"), F.col(c_n).alias("n_grams"))


def softmax(v: Column, ids: list[int]) -> list[Column]:
    top = F.array_max(v)
    total = sum(F.exp(v[k] - top) for k in ids)
    return [F.exp(v[k] - top) / total for k in ids]
