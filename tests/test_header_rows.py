"""Header rows of many sheets in one plan against the score of one sheet at a time."""

import random

from tabdelta.operators.header_rows import header_rows
from tabdelta.plans.headers import Styles, by_score

CELLS = [None, None, "Name", "ID", "Total amount", "x" * 50, "12", "3.5", "-7", " ", "nan", "Name", 4.0, 17.5, "2024-01-01", "ünï"]


def test_rows_of_many_sheets_equal_those_found_one_by_one(spark):
    rnd, long, merges, want = random.Random(11), [], [], {}
    for sheet in range(60):
        height, width = rnd.randint(1, 30), rnd.randint(1, 6)
        grid = [[rnd.choice(CELLS) for _ in range(width)] for _ in range(height)]
        grid[-1][-1] = "end"  # the sheet is as large as its cells
        styles = Styles({(r, c) for r in range(height) for c in range(width) if grid[r][c] is not None and rnd.random() < 0.1})
        for _ in range(rnd.randint(0, 2)):
            first = rnd.randint(0, 20)
            styles.merges.append((first, first + rnd.randint(0, 2), 0, 1))
        want["s", sheet] = by_score(grid, styles)
        long += [("s", sheet, r, c, str(v), isinstance(v, str), (r, c) in styles.bold) for r, row in enumerate(grid) for c, v in enumerate(row) if v is not None]
        merges += [("s", sheet, lo, hi) for lo, hi, _, _ in styles.merges]
    grid = spark.createDataFrame(long, "path string, sheet int, row_idx int, col_idx int, value string, is_string boolean, bold boolean").repartition(3)
    table = spark.createDataFrame(merges, "path string, sheet int, first_row int, last_row int")
    found = header_rows(grid, ["path", "sheet"], table)
    assert {(r.path, r.sheet): r.header_row for r in found.collect()} == want
    assert "Pandas" not in found._jdf.queryExecution().toString()
    assert header_rows(grid.limit(0), ["path", "sheet"]).count() == 0
