"""Value equality: the canonical form of a cell, as a native Column expression.

Two cells are equal exactly when their canonical texts are. The text itself is
never shown, so any rendering that keeps unequal numbers apart will do.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .names import fresh

# The vocabulary of logical cells, of missing cells in files, and of blanks.
TRUE_WORDS = ("TRUE", "T", "YES", "Y", "1", "1.0", "CHECK", "CHECKED", "CHECKMARK", "✓", "✔", "ON", "ENABLED", "ACTIVE")
FALSE_WORDS = ("FALSE", "F", "NO", "N", "0", "0.0", "CROSS", "UNCHECKED", "✗", "✘", "X", "OFF", "DISABLED", "INACTIVE")
NA_WORDS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
_ASCII_BLANKS = ("\t", "\n", "\x0b", "\x0c", "\r", "\x1c", "\x1d", "\x1e", "\x1f")
BLANKS = r"[\s\u001c-\u001f\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
#: Python's grammar of finite float literals, after comma became point.
NUMBER = r"^[+-]?([0-9](_?[0-9])*(\.([0-9](_?[0-9])*)?)?|\.[0-9](_?[0-9])*)([eE][+-]?[0-9](_?[0-9])*)?$"
#: The same without backtracking, which Java's matcher takes less time for.
_NUMBER = r"^[+-]?(?:[0-9]++(?:_[0-9]++)*+(?:\.(?:[0-9]++(?:_[0-9]++)*+)?+)?+|\.[0-9]++(?:_[0-9]++)*+)(?:[eE][+-]?[0-9]++(?:_[0-9]++)*+)?+$"

_EXACT = float(1 << 53)


def strip_blanks(c: Column) -> Column:
    return F.regexp_replace(c, f"^{BLANKS}+|{BLANKS}+$", "")


def _odd(text: Column) -> Column:
    """Whether a text may hold blanks other than single spaces; byte searches tell, and spare most cells the regular expression."""
    return reduce(lambda a, b: a | b, (F.contains(text, F.lit(m)) for m in (*_ASCII_BLANKS, "  ")), F.octet_length(text) != F.length(text))


def _word(c: Column, semantics: str, odd: Column | None = None) -> Column:
    """The cell in capitals, blanks in order; v2 collapses inner blanks and takes the text ``nan`` as missing."""
    if semantics == "v2":
        odd = _odd(c) if odd is None else odd
        return F.coalesce(F.when(~c.isin("", "nan"), F.upper(F.trim(F.when(odd, F.regexp_replace(c, f"{BLANKS}+", " ")).otherwise(c)))), F.lit(""))
    if semantics == "v1":
        return F.coalesce(F.upper(strip_blanks(c)), F.lit("NAN"))
    raise ValueError(f"unknown semantics {semantics!r}")


def _number(word: Column) -> Column:
    """The word as a number in Python's grammar, commas being points; null for other text."""
    point, start = F.replace(word, F.lit(","), F.lit(".")), F.substring(word, 1, 1)
    may_be = (start >= "+") & (start <= "9") & ~F.contains(word, F.lit(" "))  # signs, point, comma and digits lie there
    return F.when(may_be & point.rlike(_NUMBER), F.replace(point, F.lit("_"), F.lit("")).try_cast("double"))


def _form(word: Column, number: Column) -> Column:
    whole = number.try_cast("bigint")
    as_whole = (F.abs(number) < _EXACT) & (F.abs(number - whole.cast("double")) < 1e-9)
    rendered = F.when(as_whole, whole.cast("string")).otherwise(number.cast("string"))
    finite = number.isNotNull() & (F.abs(number) < float("inf"))
    # Never null, and known to be: else every join on a canonical key would filter by the whole expression.
    return F.coalesce(F.when(word.isin(*TRUE_WORDS), "TRUE").when(word.isin(*FALSE_WORDS), "FALSE").when(finite, rendered), word, F.lit(""))


def with_canonical(df: DataFrame, cells: dict[str, Column], semantics: str = "v2") -> DataFrame:
    """df with columns of canonical cells, by name.

    Words, numbers and forms are three projections, so each is evaluated once a row
    and all stay inside generated code; one nested expression would repeat them.
    Odd blanks are searched for in the whole row at once, by a lambda and so in a
    projection of its own: the JVM doesn't compile generated methods of over 8,000 bytes.
    """
    taken = [*df.columns, *cells]
    w, x = fresh(taken, *(f"__w_{k}" for k in range(len(cells)))), fresh(taken, *(f"__x_{k}" for k in range(len(cells))))
    odd = fresh([*taken, *w, *x], "__odd")[0] if semantics == "v2" and len(cells) > 1 else None
    if odd:
        df = df.withColumn(odd, F.exists(F.array(F.concat_ws("|", *(c.cast("string") for c in cells.values()))), _odd))
    words = {n: _word(c.cast("string"), semantics, F.col(f"`{odd}`") if odd else None) for n, c in zip(w, cells.values())}
    numbers = {n: _number(F.col(f"`{own}`")) for n, own in zip(x, w)}
    forms = {name: _form(F.col(f"`{a}`"), F.col(f"`{b}`")) for name, a, b in zip(cells, w, x)}
    return df.withColumns(words).withColumns(numbers).withColumns(forms).drop(*words, *numbers, *([odd] if odd else [])) if cells else df


def canonical(c: Column, semantics: str = "v2") -> Column:
    """The canonical text of one cell as an expression, for use by hand; tables go through with_canonical."""
    word = lambda x: F.transform(F.array(_number(x)), lambda n: _form(x, n))[0]
    return F.transform(F.array(_word(c.cast("string"), semantics)), word)[0]


def canonical_frame(df: DataFrame, columns: list[str] | None = None, semantics: str = "v2") -> DataFrame:
    """df with the named columns (all by default) in canonical form; an empty table keeps its columns."""
    chosen = [c for c in df.columns if columns is None or c in columns]
    own = dict(zip(chosen, fresh(df.columns, *(f"__c_{k}" for k in range(len(chosen))))))
    done = with_canonical(df, {own[c]: F.col(f"`{c}`") for c in chosen}, semantics)
    return done.select([F.col(f"`{own[c]}`").alias(c) if c in chosen else F.col(f"`{c}`") for c in df.columns])


def missing_words(c: Column) -> Column:
    """A cell as read from a file: the vocabulary of missing values becomes NULL."""
    return F.when(~c.isin(*NA_WORDS), c)
