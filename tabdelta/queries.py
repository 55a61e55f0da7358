"""Registered queries of the comparison engine, each with the SQL that says the same where SQL can."""

from __future__ import annotations

from collections.abc import Callable
from hashlib import md5

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .fixtures import LINEITEM_SQL, ORDERS_SQL, SHIFT, lineitem_pair, orders_pair, table
from .functions import names
from .functions.normalize import FALSE_WORDS, NA_WORDS, NUMBER, TRUE_WORDS, with_canonical
from .operators import report
from .operators.blocks import match_rows
from .operators.catalogue import pair_catalogues
from .operators.header_rows import header_rows
from .operators.keyed import KEY, ORDER, KeyedDiff
from .operators.keyless import KeylessDiff
from .operators.keys import choose_key, uniqueness_frame
from .operators.reconcile import candidate_pairs
from .operators.staging import scratch
from .plans.pairing import pair_files, unmatched, with_manual
from .sinks.books import write_books
from .sources.delimited import read_delimited
from .sources.worksheets import by_column, pieces, rows

COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
REST = COLUMNS[1:]
REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        REGISTRY[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def canonical_sql(c: str) -> str:
    """The canonical form in DuckDB SQL, for plain blanks."""
    words = lambda ws: ", ".join(f"'{w}'" for w in ws)
    w = f"upper(trim(regexp_replace({c}, '\\s+', ' ', 'g')))"
    point = f"replace({w}, ',', '.')"
    x = f"try_cast(replace({point}, '_', '') AS DOUBLE)"
    number = NUMBER.replace("'", "''")
    return f"""CASE WHEN {c} IS NULL OR {c} IN ('', 'nan') THEN '' WHEN {w} IN ({words(TRUE_WORDS)}) THEN 'TRUE' WHEN {w} IN ({words(FALSE_WORDS)}) THEN 'FALSE'
 WHEN regexp_matches({point}, '{number}') AND isfinite({x}) THEN CASE WHEN abs({x}) < 9007199254740992 AND abs({x} - trunc({x})) < 1e-9 THEN CAST(CAST(trunc({x}) AS BIGINT) AS VARCHAR) ELSE CAST({x} AS VARCHAR) END ELSE {w} END"""


def _canonical_columns(cols, alias: str = "") -> str:
    return ", ".join(f"{canonical_sql(alias + c)} AS n_{c}" for c in cols)


def _changed_sql(cols) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN a.n_{c} <> b.n_{c} THEN '{c}' END" for c in cols) + "], lambda v: v IS NOT NULL)"


ORDERS_KEYED = f"""WITH {ORDERS_SQL},
o AS (SELECT *, {canonical_sql('o_orderkey')} AS k, {_canonical_columns(REST)} FROM old_rows),
n AS (SELECT *, {canonical_sql('o_orderkey')} AS k, {_canonical_columns(REST)} FROM new_rows),
a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY rid) AS r, count(*) OVER (PARTITION BY k) AS copies FROM o) WHERE r = 1),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY rid) AS r, count(*) OVER (PARTITION BY k) AS copies FROM n) WHERE r = 1),
c AS (SELECT a.k AS key, {_changed_sql(REST)} AS changed, a.*, """ + ", ".join(f"b.{c} AS b_{c}" for c in COLUMNS) + " FROM a JOIN b ON a.k = b.k)"


def _orders(spark: SparkSession, sf_dir: str) -> KeyedDiff:
    old, new = orders_pair(spark, sf_dir)
    return KeyedDiff(old, new, ["o_orderkey"])


# -- files ------------------------------------------------------------------------------------------------------
_NULLS = ", ".join(f"'{w}'" for w in NA_WORDS)


@query(f"SELECT doc_id, source, length(text) AS n_chars, md5(text) AS digest FROM (SELECT CAST(doc_id AS VARCHAR) AS doc_id, source, CASE WHEN text NOT IN ({_NULLS}) THEN text END AS text FROM documents)")
def csv_line_breaks(spark, sf_dir):
    """All documents exported as delimited text, whose cells hold quotes and line breaks, and read back in parallel."""
    path = scratch(spark, "documents.csv")
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    docs.write.csv(path, sep=";", quoteAll=True, escape='"', escapeQuotes=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, emptyValue="", nullValue="")
    _, back, _ = read_delimited(spark, path, columns=["doc_id", "source", "text"], sep=";")
    return back.select("doc_id", "source", F.length("text").cast("long").alias("n_chars"), F.md5(F.col("text").cast("binary")).alias("digest"))


@query(r"SELECT CAST(doc_id AS VARCHAR) AS doc_id, source, length(t) AS n_chars, md5(t) AS digest FROM (SELECT doc_id, source, regexp_replace(text, '[\x01-\x08\x0b\x0c\x0e-\x1f]', '', 'g') AS t FROM documents)")
def workbook_round_trip(spark, sf_dir):
    """All documents exported as workbooks of added rows, which tasks write, and read back from their worksheets in pieces."""
    columns = ["doc_id", "source", "text"]
    row = F.struct(*[F.col(c).cast("string").alias(c) for c in columns])
    docs = table(spark, sf_dir, "documents").select(row.alias("new"), F.col("doc_id").alias("rid"))
    none = F.lit(None).cast(docs.schema["new"].dataType)
    folder = scratch(spark, "workbooks")
    write_books(docs.select(F.lit("added").alias("status"), "rid", none.alias("old"), "new", F.array().cast("array<string>").alias("changed_cols")), columns, folder)
    back = rows(pieces(spark, f"{folder}/*.xlsx")).where("sheet = 'Added' AND row_idx > 0").select(by_column().alias("row"))
    text = F.col("row")[2]
    return back.select(F.col("row")[0].alias("doc_id"), F.col("row")[1].alias("source"), F.length(text).cast("long").alias("n_chars"), F.md5(text.cast("binary")).alias("digest"))


_PLAIN_LIST = """SELECT 'r' || CAST(o_orderkey AS VARCHAR) AS name, replace(CAST(o_totalprice AS VARCHAR), '.', ',') AS price, 'one, two; ' || o_orderstatus AS note FROM orders"""


@query(_PLAIN_LIST)
def csv_decimal_commas(spark, sf_dir):
    """Orders exported with semicolons, decimal commas and commas in notes: the first row tells the separator."""
    o = table(spark, sf_dir, "orders")
    rows = o.select(F.concat(F.lit("r"), F.col("o_orderkey").cast("string")).alias("name"), F.replace(F.col("o_totalprice").cast("string"), F.lit("."), F.lit(",")).alias("price"), F.concat(F.lit("one, two; "), F.col("o_orderstatus")).alias("note"))
    path = scratch(spark, "orders.csv")
    rows.write.csv(path, sep=";", escape='"')
    _, back, _ = read_delimited(spark, path, columns=rows.columns)
    return back.drop(ORDER)


# -- value equality ---------------------------------------------------------------------------------------------
_MIXED = """SELECT o_orderkey, 1 AS form, '  ' || lower(o_orderstatus) || ' ' AS v FROM orders
 UNION ALL SELECT o_orderkey, 2, CAST(o_totalprice AS VARCHAR) || '0' FROM orders
 UNION ALL SELECT o_orderkey, 3, replace(CAST(o_totalprice AS VARCHAR), '.', ',') FROM orders
 UNION ALL SELECT o_orderkey, 4, CASE o_orderkey % 12 WHEN 0 THEN 'yes' WHEN 1 THEN 'X' WHEN 2 THEN '1.0' WHEN 3 THEN '1.00' WHEN 4 THEN '0' WHEN 5 THEN 'nan' WHEN 6 THEN '' WHEN 7 THEN '1_000' WHEN 8 THEN '1D' WHEN 9 THEN 'inf' WHEN 10 THEN '007' END FROM orders
 UNION ALL SELECT o_orderkey, 5, replace(o_orderpriority, '-', '  ' || chr(9) || ' ') FROM orders
 UNION ALL SELECT o_orderkey, 6, CAST(o_custkey AS VARCHAR) || '.0' FROM orders"""


@query(f"SELECT o_orderkey, form, {canonical_sql('v')} AS canonical FROM ({_MIXED})")
def norm_cells(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    price = F.col("o_totalprice").cast("string")
    odd = F.lit(None).cast("string")
    for k, v in enumerate(["yes", "X", "1.0", "1.00", "0", "nan", "", "1_000", "1D", "inf", "007"]):
        odd = F.when(F.col("o_orderkey") % 12 == k, v).otherwise(odd)
    forms = [F.concat(F.lit("  "), F.lower("o_orderstatus"), F.lit(" ")), F.concat(price, F.lit("0")), F.replace(price, F.lit("."), F.lit(",")), odd, F.replace("o_orderpriority", F.lit("-"), F.lit("  \t ")), F.concat(F.col("o_custkey").cast("string"), F.lit(".0"))]
    long = o.select("o_orderkey", F.posexplode(F.array(*forms)).alias("p", "v"))
    return with_canonical(long, {"canonical": F.col("v")}).select("o_orderkey", (F.col("p") + 1).alias("form"), "canonical")


_LABELS = "SELECT doc_id, CASE WHEN quality = 1 THEN CASE doc_id % 3 WHEN 0 THEN 'Y' WHEN 1 THEN '✓' ELSE 'Checked' END ELSE CASE doc_id % 3 WHEN 0 THEN 'n' WHEN 1 THEN '✗' ELSE 'off' END END AS q, CASE WHEN toxic = 1 THEN 'active' ELSE ' No ' END AS t FROM labels"


@query(f"SELECT doc_id, {canonical_sql('q')} AS quality, {canonical_sql('t')} AS toxic FROM ({_LABELS})")
def norm_bool_labels(spark, sf_dir):
    d = F.col("doc_id") % 3
    good, bad = F.when(d == 0, "Y").when(d == 1, "✓").otherwise("Checked"), F.when(d == 0, "n").when(d == 1, "✗").otherwise("off")
    q, t = F.when(F.col("quality") == 1, good).otherwise(bad), F.when(F.col("toxic") == 1, "active").otherwise(" No ")
    return with_canonical(table(spark, sf_dir, "labels").select("doc_id", q.alias("q"), t.alias("t")), {"quality": F.col("q"), "toxic": F.col("t")}).select("doc_id", "quality", "toxic")


_NAMES = "SELECT p_partkey, ' ' || upper(p_name) || '_' || CAST(p_size AS VARCHAR) || CASE WHEN p_partkey % 2 = 0 THEN '.1' ELSE '' END AS name FROM part"


@query(f"""SELECT p_partkey, regexp_replace(lower(trim(name)), '[^a-z0-9]', '', 'g') AS plain, regexp_replace(regexp_replace(lower(trim(name)), '([_.][0-9]+)+$', ''), '[^a-z0-9]', '', 'g') AS matched,
 lower(regexp_replace(trim(name) || '.xlsx', '\\.[^.]*$', '')) AS comparable, lower(regexp_replace(regexp_replace(trim(name) || '.xlsx', '\\.[^.]*$', ''), '_[^_]*$', '')) AS comparable_short, 'xlsx' AS ext FROM ({_NAMES})""")
def norm_colnames(spark, sf_dir):
    name = F.concat(F.lit(" "), F.upper("p_name"), F.lit("_"), F.col("p_size").cast("string"), F.when(F.col("p_partkey") % 2 == 0, ".1").otherwise(""))
    file = F.concat(F.trim(name), F.lit(".xlsx"))
    return table(spark, sf_dir, "part").select("p_partkey", names.plain_name_column(name).alias("plain"), names.match_name_column(name).alias("matched"), names.comparable_column(file).alias("comparable"), names.comparable_column(file, True).alias("comparable_short"), names.extension_column(file).alias("ext"))


# -- keyed ------------------------------------------------------------------------------------------------------
def _raw(df: DataFrame, *more) -> DataFrame:
    return df.select(*more, *[F.col(f"row.{c}").alias(c) for c in COLUMNS])


@query(ORDERS_KEYED + " SELECT n.k AS key, " + ", ".join(f"n.{c}" for c in COLUMNS) + " FROM n WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.k = n.k)")
def keyed_added(spark, sf_dir):
    return _raw(_orders(spark, sf_dir).added(), F.col(KEY).alias("key"))


@query(ORDERS_KEYED + " SELECT o.k AS key, " + ", ".join(f"o.{c}" for c in COLUMNS) + " FROM o WHERE NOT EXISTS (SELECT 1 FROM n WHERE o.k = n.k)")
def keyed_removed(spark, sf_dir):
    return _raw(_orders(spark, sf_dir).removed(), F.col(KEY).alias("key"))


@query(ORDERS_KEYED + " SELECT key, array_to_string(changed, ',') AS changed_cols, o_totalprice AS old_price, b_o_totalprice AS new_price, o_orderpriority AS old_priority, b_o_orderpriority AS new_priority FROM c WHERE len(changed) > 0")
def keyed_changed(spark, sf_dir):
    c = _orders(spark, sf_dir).changed()
    return c.select(F.col(KEY).alias("key"), F.array_join("changed_cols", ",").alias("changed_cols"), F.col("old.o_totalprice").alias("old_price"), F.col("new.o_totalprice").alias("new_price"), F.col("old.o_orderpriority").alias("old_priority"), F.col("new.o_orderpriority").alias("new_priority"))


@query(ORDERS_KEYED + f" SELECT coalesce(a.k, b.k) AS key, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' WHEN len({_changed_sql(REST)}) > 0 THEN 'changed' ELSE 'same' END AS status, coalesce(a.copies, 0) AS n_old, coalesce(b.copies, 0) AS n_new FROM a FULL JOIN b ON a.k = b.k")
def keyed_status_full(spark, sf_dir):
    return _orders(spark, sf_dir).status()


_LI = ["l_partkey", "l_quantity", "l_returnflag"]


@query(f"""WITH {LINEITEM_SQL}, o AS (SELECT *, {canonical_sql('l_orderkey')} AS k, {_canonical_columns(_LI)} FROM old_rows), n AS (SELECT *, {canonical_sql('l_orderkey')} AS k, {_canonical_columns(_LI)} FROM new_rows),
a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY rid) AS r FROM o) WHERE r = 1), b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY rid) AS r FROM n) WHERE r = 1)
SELECT 'changed' AS status, a.k AS key, a.rid AS rid, array_to_string({_changed_sql(_LI)}, ',') AS changed_cols FROM a JOIN b ON a.k = b.k WHERE len({_changed_sql(_LI)}) > 0
UNION ALL SELECT 'added', n.k, n.rid, '' FROM n WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.k = n.k)
UNION ALL SELECT 'removed', o.k, o.rid, '' FROM o WHERE NOT EXISTS (SELECT 1 FROM n WHERE o.k = n.k)""")
def keyed_dupkeys(spark, sf_dir):
    old, new = lineitem_pair(spark, sf_dir)
    return KeyedDiff(old, new, ["l_orderkey"]).result().select("status", "key", "rid", F.array_join("changed_cols", ",").alias("changed_cols"))


@query(f"""WITH {LINEITEM_SQL}, o AS (SELECT {canonical_sql('l_orderkey')} AS k FROM old_rows), n AS (SELECT {canonical_sql('l_orderkey')} AS k FROM new_rows),
a AS (SELECT k, count(*) AS c FROM o GROUP BY k), b AS (SELECT k, count(*) AS c FROM n GROUP BY k)
SELECT coalesce(a.k, b.k) AS key, coalesce(a.c, 0) AS n_old, coalesce(b.c, 0) AS n_new FROM a FULL JOIN b ON a.k = b.k WHERE a.c > 1 OR b.c > 1""")
def duplicate_keys(spark, sf_dir):
    old, new = lineitem_pair(spark, sf_dir)
    return KeyedDiff(old, new, ["l_orderkey"]).duplicate_keys()


# -- views ------------------------------------------------------------------------------------------------------
@query(ORDERS_KEYED + " " + " UNION ALL ".join(f"SELECT key, '{c}' AS \"column\", {c} AS old_value, b_{c} AS new_value FROM c WHERE list_contains(changed, '{c}')" for c in REST))
def cell_diff(spark, sf_dir):
    d = _orders(spark, sf_dir)
    return report.cell_diff(d.changed().withColumnRenamed(KEY, "key"), COLUMNS)


@query(ORDERS_KEYED + ' SELECT u AS "column", count(*) AS n_changed FROM (SELECT unnest(changed) AS u FROM c) GROUP BY u')
def changed_by_column(spark, sf_dir):
    return report.changed_by_column(_orders(spark, sf_dir).changed())


@query(ORDERS_KEYED + " SELECT key, " + ", ".join(f'{c} AS "{c} (Old)", b_{c} AS "{c} (New)"' for c in COLUMNS) + ", array_to_string(changed, ',') AS changed_cols FROM c WHERE len(changed) > 0")
def side_by_side(spark, sf_dir):
    d = _orders(spark, sf_dir)
    return report.side_by_side(d.changed().withColumnRenamed(KEY, "key"), COLUMNS).withColumn("changed_cols", F.array_join("changed_cols", ","))


@query(ORDERS_KEYED + " SELECT rid, o_totalprice AS old_price, b_o_totalprice AS new_price FROM c WHERE len(changed) > 0")
def side_join_positional(spark, sf_dir):
    return report.paired_by_position(_orders(spark, sf_dir).result().where("status = 'changed'")).select("rid", F.col("old.o_totalprice").alias("old_price"), F.col("new.o_totalprice").alias("new_price"))


@query(ORDERS_KEYED + " SELECT (SELECT count(*) FROM c WHERE len(changed) > 0) AS n_changed, (SELECT count(*) FROM n WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.k = n.k)) AS n_added, (SELECT count(*) FROM o WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.k = o.k)) AS n_removed")
def summary_counts(spark, sf_dir):
    return report.summary(_orders(spark, sf_dir).result())


_PER_STATUS = "SELECT o_orderpriority AS pair_id, count(*) FILTER (o_orderkey % 31 = 0 AND o_orderkey % 97 <> 0 AND o_orderpriority <> '5-LOW') AS n_changed, 0 AS n_added, count(*) FILTER (o_orderkey % 97 = 0 AND o_orderpriority <> '5-LOW') AS n_removed FROM orders GROUP BY o_orderpriority"


@query(f"SELECT count(*) AS n_pairs, count(*) FILTER (n_changed + n_added + n_removed > 0) AS n_pairs_differ, coalesce(bool_and(n_changed + n_added + n_removed = 0), true) AS identical FROM ({_PER_STATUS})")
def run_summary(spark, sf_dir):
    """A pair of tables for each priority, compared by key; every pair counts, also one without differences."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority")
    k, own = F.col("o_orderkey"), F.col("o_orderpriority") != "5-LOW"
    new = o.where(~own | (k % 97 != 0)).withColumn("o_totalprice", F.when(own & (k % 31 == 0), F.round(F.col("o_totalprice") + 1, 2)).otherwise(F.col("o_totalprice")))
    found = KeyedDiff(o, new, ["o_orderpriority", "o_orderkey"], order="o_orderkey").result()
    found = found.select(F.coalesce("old.o_orderpriority", "new.o_orderpriority").alias("pair_id"), "status")
    pairs = o.select(F.col("o_orderpriority").alias("pair_id"), F.lit(None).cast("string").alias("status"))
    count = lambda s: F.count(F.when(F.col("status") == s, 1)).alias(f"n_{s}")
    per = found.unionByName(pairs).groupBy("pair_id").agg(count("changed"), count("added"), count("removed"))
    return report.run_summary(per)


@query(f"WITH {ORDERS_SQL}, x AS (SELECT (SELECT count(*) FROM old_rows) AS n_old, (SELECT count(*) FROM new_rows WHERE CAST(o_custkey AS BIGINT) % 5 <> 0) AS n_new) SELECT (n_old - n_new) >= greatest(5.0, 0.1 * n_old) AS truncated, n_old, n_new FROM x")
def truncation(spark, sf_dir):
    old, new = orders_pair(spark, sf_dir)
    return report.truncation(old.drop(ORDER), new.where(F.col("o_custkey").cast("long") % 5 != 0).drop(ORDER))


@query("SELECT o_orderkey FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderstatus END AS a, CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE o_orderpriority END AS b FROM orders) WHERE a IS NOT NULL OR (b IS NOT NULL AND b <> '')")
def first_nonblank_rows(spark, sf_dir):
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.when(k % 3 != 0, F.col("o_orderstatus")).alias("a"), F.when(k % 4 == 0, "").otherwise(F.col("o_orderpriority")).alias("b"))
    return rows.where(report.nonempty(["a", "b"], blanks=False)).select("o_orderkey")


@query("""WITH o AS (SELECT DISTINCT n_nationkey AS pair_id, n_name AS sheet FROM nation WHERE n_regionkey <> 1), n AS (SELECT DISTINCT n_nationkey AS pair_id, n_name AS sheet FROM nation WHERE n_regionkey <> 3)
SELECT pair_id, sheet, 'old' AS only_in FROM o WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.pair_id = o.pair_id AND n.sheet = o.sheet) UNION ALL SELECT pair_id, sheet, 'new' FROM n WHERE NOT EXISTS (SELECT 1 FROM o WHERE n.pair_id = o.pair_id AND n.sheet = o.sheet)""")
def sheet_missing(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("pair_id"), F.col("n_name").alias("sheet"), "n_regionkey")
    return report.missing_sheets(n.where("n_regionkey <> 1").drop("n_regionkey"), n.where("n_regionkey <> 3").drop("n_regionkey"))


@query(ORDERS_KEYED + " SELECT 'changed' AS status, key, o_totalprice AS old_o_totalprice, b_o_totalprice AS new_o_totalprice FROM c WHERE len(changed) > 0 UNION ALL SELECT 'added', n.k, NULL, n.o_totalprice FROM n WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.k = n.k) UNION ALL SELECT 'removed', o.k, o.o_totalprice, NULL FROM o WHERE NOT EXISTS (SELECT 1 FROM n WHERE o.k = n.k)")
def full_export(spark, sf_dir):
    return report.full_export(_orders(spark, sf_dir).result()).select("status", "key", "old_o_totalprice", "new_o_totalprice")


# -- keyless ----------------------------------------------------------------------------------------------------
_VALUES = f"""WITH {ORDERS_SQL}, o AS (SELECT *, {_canonical_columns(COLUMNS)} FROM old_rows), n AS (SELECT *, {_canonical_columns(COLUMNS)} FROM new_rows)"""
_V = ", ".join(f"n_{c}" for c in COLUMNS)
_SAME = " AND ".join(f"o.n_{c} = n.n_{c}" for c in COLUMNS)


def _keyless(spark, sf_dir, mode):
    old, new = orders_pair(spark, sf_dir)
    return KeylessDiff(old, new, mode, semantics="v2")


def _rows(df: DataFrame) -> DataFrame:
    return df.select(F.col(ORDER).alias("rid"), *[F.col(f"row.{c}").alias(c) for c in COLUMNS])


@query(f"{_VALUES} SELECT rid, {', '.join(COLUMNS)} FROM n WHERE NOT EXISTS (SELECT 1 FROM o WHERE {_SAME})")
def keyless_set_added(spark, sf_dir):
    return _rows(_keyless(spark, sf_dir, "set").added())


@query(f"{_VALUES} SELECT rid, {', '.join(COLUMNS)} FROM o WHERE NOT EXISTS (SELECT 1 FROM n WHERE {_SAME})")
def keyless_set_removed(spark, sf_dir):
    return _rows(_keyless(spark, sf_dir, "set").removed())


_COUNTS = f", co AS (SELECT {_V}, count(*) AS k FROM o GROUP BY {_V}), cn AS (SELECT {_V}, count(*) AS k FROM n GROUP BY {_V})"


@query(f"{_VALUES}{_COUNTS} SELECT n.rid, {', '.join('n.' + c for c in COLUMNS)} FROM n JOIN cn USING ({_V}) LEFT JOIN co USING ({_V}) WHERE cn.k > coalesce(co.k, 0)")
def keyless_count_added(spark, sf_dir):
    return _rows(_keyless(spark, sf_dir, "count").added())


@query(f"{_VALUES}{_COUNTS} SELECT o.rid, {', '.join('o.' + c for c in COLUMNS)} FROM o JOIN co USING ({_V}) LEFT JOIN cn USING ({_V}) WHERE co.k > coalesce(cn.k, 0)")
def keyless_count_removed(spark, sf_dir):
    return _rows(_keyless(spark, sf_dir, "count").removed())


@query(f"{_VALUES} SELECT 'added' AS status, n_o_orderkey AS o_orderkey, n_o_orderstatus AS o_orderstatus, n_o_orderpriority AS o_orderpriority FROM (SELECT {_V} FROM n EXCEPT ALL SELECT {_V} FROM o) UNION ALL SELECT 'removed', n_o_orderkey, n_o_orderstatus, n_o_orderpriority FROM (SELECT {_V} FROM o EXCEPT ALL SELECT {_V} FROM n)")
def keyless_exact(spark, sf_dir):
    d = _keyless(spark, sf_dir, "exact")
    pick = lambda df, s: df.select(F.lit(s).alias("status"), *[F.col(f"row.{c}").alias(c) for c in ("o_orderkey", "o_orderstatus", "o_orderpriority")])
    return pick(d.added(), "added").unionAll(pick(d.removed(), "removed"))


# -- keys -------------------------------------------------------------------------------------------------------
_UNIQUE = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", ((SELECT count(DISTINCT coalesce({c}, '')) / greatest(1, count(*)) FROM old_rows) + (SELECT count(DISTINCT coalesce({c}, '')) / greatest(1, count(*)) FROM new_rows)) / 2 AS uniqueness" for c in COLUMNS)


@query(f"WITH {ORDERS_SQL} SELECT \"column\", CAST(round(uniqueness * 1000000) AS BIGINT) AS millionths FROM ({_UNIQUE})")
def key_uniqueness(spark, sf_dir):
    old, new = orders_pair(spark, sf_dir)
    return uniqueness_frame(old, new, COLUMNS).select("column", F.round(F.col("uniqueness") * 1_000_000).cast("long").alias("millionths"))


@query(f"WITH {ORDERS_SQL} SELECT \"column\" AS key_column FROM ({_UNIQUE}) WHERE \"column\" IN ('o_orderkey', 'o_custkey', 'o_orderstatus') ORDER BY uniqueness DESC LIMIT 1")
def key_choice(spark, sf_dir):
    old, new = orders_pair(spark, sf_dir)
    chosen, _ = choose_key(old.drop(ORDER), new.drop(ORDER), ["O_OrderStatus", "o_custkey_1", "o_order_key", "unknown"])
    return spark.createDataFrame([(c,) for c in chosen], "key_column string")


# -- reconciliation ---------------------------------------------------------------------------------------------
_CELLS = ["c_nationkey", "c_mktsegment", "bucket", "initial"]
_RECONCILE = """r AS (SELECT c_custkey AS ri, CAST(c_nationkey AS VARCHAR) AS c_nationkey, c_mktsegment, CAST(CAST(floor(c_acctbal / 50) AS BIGINT) AS VARCHAR) AS bucket, CAST(c_custkey % 40 AS VARCHAR) AS initial FROM customer WHERE c_custkey % 2 = 0),
a AS (SELECT c_custkey AS ai, CAST(c_nationkey AS VARCHAR) AS c_nationkey, c_mktsegment, CAST(CAST(floor(c_acctbal / 50) AS BIGINT) AS VARCHAR) AS bucket, CAST(c_custkey % 39 AS VARCHAR) AS initial FROM customer WHERE c_custkey % 2 = 1)"""


def _reconcile_sides(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    side = lambda rest, rid, m: c.where(F.col("c_custkey") % 2 == rest).select(F.col("c_custkey").alias(rid), F.col("c_nationkey").cast("string").alias("c_nationkey"), "c_mktsegment", F.floor(F.col("c_acctbal") / 50).cast("string").alias("bucket"), (F.col("c_custkey") % m).cast("string").alias("initial"))
    return side(0, "ri", 40), side(1, "ai", 39)


@query(f"WITH {_RECONCILE} SELECT ri, ai, n_equal FROM (SELECT r.ri, a.ai, " + " + ".join(f"CASE WHEN {canonical_sql('r.' + c)} = {canonical_sql('a.' + c)} THEN 1 ELSE 0 END" for c in _CELLS) + " AS n_equal FROM r CROSS JOIN a) WHERE n_equal >= 2")
def reconcile_edges(spark, sf_dir):
    removed, added = _reconcile_sides(spark, sf_dir)
    return candidate_pairs(removed, added, _CELLS).select("ri", "ai", "n_equal")


@query()
def reconcile_match(spark, sf_dir):
    removed, added = _reconcile_sides(spark, sf_dir)
    return match_rows(removed, added, _CELLS)


# -- metadata ---------------------------------------------------------------------------------------------------
@query("""WITH f AS (SELECT DISTINCT source, doc_id % 4 AS y FROM documents)
SELECT source || '_' || CAST(y AS VARCHAR) || '.XLSX' AS name, lower(source) AS short, lower(source) || '_' || CAST(y AS VARCHAR) AS long FROM f""")
def comparable_names(spark, sf_dir):
    f = table(spark, sf_dir, "documents").select("source", (F.col("doc_id") % 4).cast("string").alias("y")).distinct()
    name = F.concat("source", F.lit("_"), "y", F.lit(".XLSX"))
    return f.select(name.alias("name"), names.comparable_column(name, True).alias("short"), names.comparable_column(name).alias("long"))


@query("""SELECT upper(md5(n_name)) || '_2023.xlsx' AS old, md5(n_name) || CASE WHEN n_nationkey % 5 = 0 THEN '.ods' ELSE '_2024.csv' END AS new, CASE WHEN n_nationkey % 5 = 0 THEN 'manual' ELSE 'auto' END AS origin FROM nation""")
def pair_matching(spark, sf_dir):
    """Files of all nations (digests, so that no two are alike), every fifth of them paired by hand."""
    rows = [(md5(r.n_name.encode()).hexdigest().upper(), r.n_nationkey % 5 == 0) for r in table(spark, sf_dir, "nation").orderBy("n_nationkey").collect()]  # a file list
    old = [f"{n}_2023.xlsx" for n, _ in rows]
    new = {n: f"{n.lower()}.ods" if by_hand else f"{n.lower()}_2024.csv" for n, by_hand in rows}
    pairs = with_manual(pair_files(old, list(new.values())), [(f"{n}_2023.xlsx", new[n]) for n, by_hand in rows if by_hand])
    return spark.createDataFrame([(p.old, p.new, p.origin) for p in pairs], "old string, new string, origin string")


@query()
def catalogue_pairs(spark, sf_dir):
    """All page addresses as file names of two years, a word of them altered, paired by similarity."""
    p = table(spark, sf_dir, "pages")
    flat = F.regexp_replace("url", "[./]", "-")
    old = p.select(F.col("page_id").alias("id"), F.concat(flat, F.lit("_2023.xlsx")).alias("name"))
    new = p.select((-F.col("page_id")).alias("id"), F.concat(F.regexp_replace(flat, "example", "sample"), F.lit("_2024.csv")).alias("name"))
    return pair_catalogues(old, new, ignore_suffix=True)


@query("""SELECT n_name || '.xlsx' AS name, CASE WHEN n_regionkey = 3 THEN 'old' ELSE 'new' END AS side FROM nation WHERE n_regionkey IN (1, 3)""")
def unmatched_files(spark, sf_dir):
    """Files of which the nations of a region each are missing on one side."""
    rows = table(spark, sf_dir, "nation").orderBy("n_nationkey").collect()  # a file list
    old, new = ([f"{r.n_name}.xlsx" for r in rows if r.n_regionkey != missing] for missing in (1, 3))
    left, right = unmatched(old, new, pair_files(old, new, 0.99))
    return spark.createDataFrame([(n, "old") for n in left] + [(n, "new") for n in right], "name string, side string")


@query("""SELECT n_nationkey, CASE WHEN r = 0 THEN r_name ELSE r_name || '_' || CAST(r AS VARCHAR) END AS name
FROM (SELECT n_nationkey, r_name, row_number() OVER (PARTITION BY r_name ORDER BY n_nationkey) - 1 AS r FROM nation JOIN region ON n_regionkey = r_regionkey)""")
def dedup_names(spark, sf_dir):
    """Regions as the header cells of a sheet with a column for each nation."""
    nations, regions = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    rows = nations.join(regions, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name").orderBy("n_nationkey").collect()  # a header row
    return spark.createDataFrame(list(zip([r.n_nationkey for r in rows], names.unique_names([f" {r.r_name} " for r in rows]))), "n_nationkey int, name string")


_GRIDS = """c AS (SELECT *, c_custkey % 40 AS g, row_number() OVER (PARTITION BY c_custkey % 40 ORDER BY c_custkey) AS r FROM customer),
cells AS (
  SELECT g, r + g % 4 AS i, unnest([0, 1, 2, 3]) AS c, unnest([CAST(c_custkey AS VARCHAR), c_name, CAST(c_nationkey AS VARCHAR), CASE WHEN c_custkey % 7 <> 0 THEN c_mktsegment END]) AS v FROM c WHERE r <= 20
  UNION ALL SELECT DISTINCT g, g % 4, unnest([0, 1, 2, 3]), unnest(['ID', 'Customer Name', CASE WHEN g % 3 = 0 THEN 'ID' ELSE 'Nation' END, 'Segment']) FROM c
  UNION ALL SELECT DISTINCT g, unnest(range(g % 4)), 0, 'List ' || CAST(g AS VARCHAR) FROM c
  UNION ALL SELECT DISTINCT g, unnest(range(g % 4)), 1, CASE WHEN g % 2 = 0 THEN '2024' END FROM c)"""


@query(f"""WITH {_GRIDS},
rows AS (SELECT g, i, count(v) AS n, count(DISTINCT v) AS d, count(*) FILTER (WHERE v IS NOT NULL AND length(v) < 40 AND regexp_matches(trim(v), '^[A-Za-z]')) AS named,
  count(*) FILTER (WHERE regexp_matches(regexp_replace(regexp_replace(v, '[.]', ''), '-', ''), '^[0-9]+$')) AS numbers FROM cells GROUP BY g, i),
ahead AS (SELECT a.g, a.i, count(b.n) AS k, stddev_samp(b.n) AS sd FROM rows a LEFT JOIN rows b ON a.g = b.g AND b.i BETWEEN a.i + 1 AND a.i + 8 GROUP BY a.g, a.i),
scored AS (SELECT r.g, r.i, round(1.5 * n / 4 + 1 + d / n + named / n + CASE WHEN k > 1 THEN 1 / (1 + sd) ELSE 0 END + 0.5 * (1 - numbers / n) - 0.1 * r.i, 9) AS score FROM rows r JOIN ahead a ON r.g = a.g AND r.i = a.i WHERE n >= 2 AND r.i < 15)
SELECT g AS grid, CAST(header_row AS INTEGER) AS header_row FROM (SELECT g, i AS header_row, row_number() OVER (PARTITION BY g ORDER BY score DESC, i) AS place FROM scored) WHERE place = 1""")
def header_score(spark, sf_dir):
    """The header row of forty sheets of customers, with up to three rows above the header; some headers repeat a name."""
    c = table(spark, sf_dir, "customer").withColumn("grid", F.col("c_custkey") % 40)
    c = c.withColumn("r", F.row_number().over(Window.partitionBy("grid").orderBy("c_custkey"))).where("r <= 20")
    at, g = F.col("grid") % 4, F.col("grid")
    line = lambda df, row, *cells: df.select("grid", row.cast("int").alias("row_idx"), F.posexplode(F.array(*cells)).alias("col_idx", "value"))
    body = line(c, F.col("r") + at, F.col("c_custkey").cast("string"), F.col("c_name"), F.col("c_nationkey").cast("string"), F.when(F.col("c_custkey") % 7 != 0, F.col("c_mktsegment")))
    grids = c.select("grid").distinct()
    head = line(grids, at, F.lit("ID"), F.lit("Customer Name"), F.when(g % 3 == 0, "ID").otherwise("Nation"), F.lit("Segment"))
    above = grids.where(at > 0).select("grid", F.explode(F.sequence(F.lit(0), at - 1)).alias("above"))
    above = line(above, F.col("above"), F.concat(F.lit("List "), g.cast("string")), F.when(g % 2 == 0, "2024"))
    cells = body.unionByName(head).unionByName(above).withColumns({"is_string": F.lit(True), "bold": F.lit(False)})
    return header_rows(cells, ["grid"])


_SHAPES = "SELECT doc_id, 1 AS form, source AS v FROM documents UNION ALL SELECT doc_id, 2, CAST(n_chars AS VARCHAR) || CASE doc_id % 4 WHEN 0 THEN '.5' WHEN 1 THEN '-' WHEN 2 THEN '.' ELSE 'x' END FROM documents UNION ALL SELECT doc_id, 3, text FROM documents"


@query(f"SELECT doc_id, form, coalesce(regexp_matches(regexp_replace(regexp_replace(v, '[.]', ''), '-', ''), '^[0-9]+$'), false) AS numeric, coalesce(length(v) < 40 AND regexp_matches(ltrim(v, ' '), '^[A-Za-z]'), false) AS name_like FROM ({_SHAPES})")
def cell_shapes(spark, sf_dir):
    """Which cells look like numbers and which like column names: the signs that header rows are told by."""
    d, k = table(spark, sf_dir, "documents"), F.col("doc_id") % 4
    tail = F.when(k == 0, ".5").when(k == 1, "-").when(k == 2, ".").otherwise("x")
    long = d.select("doc_id", F.posexplode(F.array("source", F.concat(F.col("n_chars").cast("string"), tail), "text")).alias("p", "v"))
    sure = lambda c: F.coalesce(c, F.lit(False))
    return long.select("doc_id", (F.col("p") + 1).alias("form"), sure(names.looks_numeric("v")).alias("numeric"), sure(names.looks_like_name("v")).alias("name_like"))


@query("""SELECT * FROM (VALUES ('o_clerk', 'old'), ('o_note', 'new')) t("column", side)""")
def column_report(spark, sf_dir):
    """Columns that one side lacks: the answer depends on the schemas alone."""
    old, new = orders_pair(spark, sf_dir)
    return KeyedDiff(old.withColumn("o_clerk", F.lit("x")), new.withColumn("o_note", F.lit("y")), ["o_orderkey"]).column_report()


@query()
def seq_similarity(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type")
    return p.select("p_partkey", names.similarity_column(F.lower("p_name"), F.lower("p_type")).alias("ratio"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(REGISTRY)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
