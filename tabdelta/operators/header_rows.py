"""Header rows of all sheets at once, from the long grid of their cells.

One plan for any number of files: cells are summed up per row, the rows that a decision
looks at (at most ROWS_NEEDED a sheet) are completed with blank ones, a window frame over
the next rows tells how steady they are, and the best row of each sheet is an aggregate.
The score is that of ``plans.headers.score_row``, which takes one sheet at a time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.names import looks_like_name, looks_numeric
from ..functions.normalize import strip_blanks
from ..plans import headers as h


def row_facts(grid: DataFrame, sheet: list[str]) -> DataFrame:
    """Per row of a sheet: filled cells, distinct values, texts, bold cells, cells like names and like numbers, and the sheet's width."""
    value = F.when(F.col("is_string"), F.col("value")).otherwise(F.coalesce(F.col("value").try_cast("double").cast("string"), F.col("value")))
    cells = grid.where("value IS NOT NULL").select(*sheet, "row_idx", "col_idx", "is_string", "bold", value.alias("value"))
    wide = Window.partitionBy(*sheet)
    near = cells.withColumn("width", F.max("col_idx").over(wide) + 1).withColumn("last", F.max("row_idx").over(wide)).where(F.col("row_idx") < h.ROWS_NEEDED)
    full = ~strip_blanks(F.col("value")).isin("", "nan")
    count = lambda c: F.count(F.when(full & F.coalesce(c, F.lit(False)), 1))
    return near.groupBy(*sheet, "row_idx").agg(
        F.max("width").alias("width"), F.max("last").alias("last"), count(F.lit(True)).alias("n"), F.count_distinct(F.when(full, F.col("value"))).alias("distinct"), count(F.col("is_string")).alias("texts"),
        count(F.col("bold")).alias("bold"), count(F.col("is_string") & looks_like_name("value")).alias("named"), count(looks_numeric("value")).alias("numbers"),
    )


def scores(grid: DataFrame, sheet: list[str], merges: DataFrame | None = None) -> DataFrame:
    """(sheet, row_idx, score) of every row that can be a header. ``merges``: sheet, first_row, last_row of merged cells."""
    facts = row_facts(grid, sheet)
    ends = facts.groupBy(*sheet).agg(F.max("width").alias("width"), F.max("last").alias("last"))
    rows = ends.select(*sheet, "width", F.explode(F.sequence(F.lit(0), F.least("last", F.lit(h.ROWS_NEEDED - 1)))).alias("row_idx"))
    rows = rows.join(facts.drop("width", "last"), [*sheet, "row_idx"], "left").fillna(0, ["n"])
    ahead = Window.partitionBy(*sheet).orderBy("row_idx").rowsBetween(1, h.LOOK_AHEAD)
    rows = rows.withColumn("below", F.count("n").over(ahead)).withColumn("sd", F.stddev_samp("n").over(ahead))
    share = lambda c: F.col(c) / F.col("n")
    score = h.BOLD * share("bold") + h.FILL * F.col("n") / F.col("width") + h.ALL_TEXT * (F.col("texts") == F.col("n")).cast("int") + h.UNIQUE * share("distinct") + h.NAME_LIKE * share("named")
    score += h.STEADY * F.when(F.col("below") > 1, 1 / (1 + F.col("sd"))).otherwise(0.0) + h.NOT_NUMERIC * (1 - share("numbers")) - h.PER_ROW * F.col("row_idx")
    scored = rows.where((F.col("n") >= 2) & (F.col("row_idx") < h.SCAN_ROWS))
    if merges is not None:
        inner = merges.where((F.col("last_row") > F.col("first_row")) & (F.col("first_row") < h.SCAN_ROWS)).select(*sheet, F.explode(F.sequence(F.col("first_row") + 1, F.least("last_row", F.lit(h.SCAN_ROWS)))).alias("row_idx"))
        label = merges.where("last_row = first_row").select(*sheet, F.col("first_row").alias("row_idx"), F.lit(h.GROUP_LABEL).alias("off")).distinct()
        scored = scored.join(inner, [*sheet, "row_idx"], "left_anti").join(label, [*sheet, "row_idx"], "left")
        score -= F.coalesce("off", F.lit(0.0))
    return scored.select(*sheet, "row_idx", score.alias("score"))


def header_rows(grid: DataFrame, sheet: list[str], merges: DataFrame | None = None) -> DataFrame:
    """(sheet, header_row): the best-scoring row of every sheet, the earliest of equals, row 0 where none scores above -1."""
    best = scores(grid, sheet, merges).where("score > -1").groupBy(*sheet).agg(F.max(F.struct(F.round("score", 9).alias("score"), (-F.col("row_idx")).alias("up"))).alias("x"))
    return grid.select(*sheet).distinct().join(best, sheet, "left").select(*sheet, F.coalesce(-F.col("x.up"), F.lit(0)).cast("int").alias("header_row"))
