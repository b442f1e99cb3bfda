"""Registered queries of table rows and chunkers. Orders stand for tables and their lines for rows; cells follow from the part."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import tables as R
from tessera.plans.registry import over, query, stored, table
from tessera.plans.sql import fold

CELLS = {
    0: ["'المنفذ'", "concat('actor ', l_returnflag)"], 1: ["'الجهة المنفذة:'", "concat('unit ', l_linestatus)"], 2: ["concat('-', {n})", "concat('do ', {n})"],
    3: ["'من ح /'", "concat('account ', {n})"], 4: ["l_returnflag", "l_linestatus", "concat('cell ', {n})"], 5: ["concat('2. title ', {n})"],
    6: ["concat('أولا: part ', {n})"], 7: ["concat('more ', {n})"], 8: ["'', 'إلى ح / x'"], 9: ["l_returnflag", "concat('rest ', {n})"], 10: ["'ح _ direct'"],
}
CELLS[8] = ["'إلى'", "concat('tail ', {n})"]
BUCKET = "CASE WHEN l_orderkey % 4 = 0 THEN 4 WHEN l_orderkey % 4 = 1 THEN CASE l_partkey % 3 WHEN 0 THEN 3 WHEN 1 THEN 7 ELSE 10 END WHEN l_partkey % 11 = 3 THEN 2 WHEN l_partkey % 11 = 4 THEN 7 ELSE l_partkey % 11 END"
HEADS = {"approval": R.APPROVAL, "revision": R.REVISION}


def _cells(open_: str, close: str, text: str) -> str:
    make = lambda parts: open_ + ", ".join(p.format(n=f"CAST(l_suppkey % 20 AS {text})") for p in parts) + close
    head = lambda names: open_ + ", ".join(f"'{n}'" for n in names) + close
    first = f"WHEN idx = 0 AND l_orderkey % 40 = 0 THEN {head(R.REVISION)} WHEN idx = 0 AND l_orderkey % 40 = 4 THEN {head(R.APPROVAL)}"
    return f"CASE {first} " + " ".join(f"WHEN b = {k} THEN {make(v)}" for k, v in CELLS.items()) + " END"


LINES = f"""SELECT *, {BUCKET} b FROM (SELECT l_orderkey, l_partkey, l_suppkey, l_returnflag, l_linestatus, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate) - 1 AS INT) idx FROM lineitem)"""
ROWS = f"""r AS (SELECT concat('m', CAST(l_orderkey // 8 AS VARCHAR)) source, (l_orderkey % 8 + 1)::INT page, l_orderkey table_id, idx, {_cells("[", "]", "VARCHAR")} cells FROM ({LINES}))"""
KEYED = fold("cells[1]")
LABEL = f"trim(trim({{c}}, '{R.T.EDGES}'))"
ORDINAL = "|".join(map(R.folded, R.ORDINALS))
KINDS = f"""k AS (SELECT *, CASE WHEN len(cells) = 0 THEN 'continuation' WHEN len(cells) >= 3 THEN 'grid' WHEN len(cells) = 2 THEN CASE WHEN {LABEL.format(c=KEYED)} IN ('{R.folded(R.UNIT)}', '{R.folded(R.ACTOR)}') THEN 'actor'
WHEN regexp_matches(cells[1], '{R.STEP}') THEN 'step' WHEN regexp_matches({KEYED}, '{R.ENTRY}') THEN 'entry_line' ELSE 'continuation' END
WHEN regexp_matches(cells[1], '{R.HEADING}') THEN 'heading' WHEN regexp_matches(ltrim({KEYED}, '{R.T.EDGES}'), '^(?:{ORDINAL})') THEN 'sub_heading' ELSE 'continuation' END kind FROM r)"""
HEAD_KEY = "list_transform(header, lambda c: " + LABEL.format(c=fold("c")) + ")"
NAMES = {k: "[" + ", ".join(f"'{R.folded(n)}'" for n in v) + "]" for k, v in HEADS.items()}
TABLES = f"""t AS (SELECT table_id, n_rows, header, header_idx, CASE WHEN {HEAD_KEY} = {NAMES["approval"]} THEN 'approval' WHEN {HEAD_KEY} = {NAMES["revision"]} THEN 'revision' WHEN e > 0 THEN 'accounting' WHEN g * 2 > n_rows THEN 'grid' ELSE 'procedure' END kind
FROM (SELECT table_id, count(*) n_rows, count(*) FILTER (kind = 'entry_line') e, count(*) FILTER (kind = 'grid') g, arg_min(cells, idx) FILTER (len(cells) >= 3) header, min(idx) FILTER (len(cells) >= 3) header_idx FROM k GROUP BY 1))"""


def rows(spark: SparkSession, d: str) -> DataFrame:
    lines = over(spark, d, LINES, "lineitem", key="l_orderkey")
    return lines.select(
        F.concat(F.lit("m"), F.expr("l_orderkey div 8").cast("string")).alias("source"), (F.col("l_orderkey") % 8 + 1).cast("int").alias("page"),
        F.col("l_orderkey").alias("table_id"), "idx", F.expr(_cells("array(", ")", "STRING")).alias("cells"),
    )


@query(f"WITH {ROWS}, {KINDS} SELECT table_id, idx, kind FROM k")
def classify_row(spark: SparkSession, d: str) -> DataFrame:
    return rows(spark, d).select("table_id", "idx", R.row_kind(F.col("cells")).alias("kind"))


@query(f"WITH {ROWS}, {KINDS}, {TABLES} SELECT table_id, kind, n_rows::BIGINT n_rows, header_idx FROM t")
def table_kind(spark: SparkSession, d: str) -> DataFrame:
    return R.table_kinds(rows(spark, d)).select("table_id", "kind", "n_rows", "header_idx")


@query(f"""WITH {ROWS}, {KINDS}, {TABLES}, g AS (SELECT r.*, t.* EXCLUDE (table_id), count(*) OVER (PARTITION BY r.table_id) n, CASE WHEN t.kind = 'revision' THEN 'revision' WHEN n_rows - 1 > 6 THEN 'grid_row' ELSE 'grid_table' END chunk_type
FROM r JOIN t ON r.table_id = t.table_id WHERE t.kind IN ('grid', 'revision') AND idx != header_idx)
SELECT table_id, idx "first", idx "last", array_to_string(header, ' | ') || chr(10) || array_to_string(cells, ' | ') "text", chunk_type FROM g WHERE n > 6
UNION ALL SELECT table_id, 0, (any_value(n_rows) - 1)::INT, array_to_string(any_value(header), ' | ') || chr(10) || string_agg(array_to_string(cells, ' | '), chr(10) ORDER BY idx), any_value(chunk_type) FROM g WHERE n <= 6 GROUP BY 1""")
def grid_chunks(spark: SparkSession, d: str) -> DataFrame:
    return R.grid_chunks(rows(spark, d))


@query(f"""WITH {ROWS}, {KINDS}, {TABLES} SELECT table_id, 0 "first", max(idx) "last", string_agg(array_to_string(cells, ' | '), chr(10) ORDER BY idx) "text" FROM r WHERE table_id IN (SELECT table_id FROM t WHERE kind = 'approval') GROUP BY 1""")
def approval_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Signature pages whole: a table's rows, which one page bounds."""
    all_ = rows(spark, d)
    own = all_.join(R.table_kinds(all_).filter("kind = 'approval'").select("table_id"), "table_id")
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("idx", R.line(F.col("cells")).alias("t")))), lambda x: x["t"]), "\n")
    return own.groupBy("table_id").agg(F.lit(0).alias("first"), F.max("idx").alias("last"), text.alias("text"))


@query(f"""WITH {ROWS}, {KINDS}, {TABLES}, a AS (SELECT r.*, len(cells) > 1 OR regexp_matches({KEYED}, '{R.ACCOUNT}') acct FROM r WHERE table_id IN (SELECT table_id FROM t WHERE kind = 'accounting')),
b AS (SELECT *, CASE WHEN NOT acct AND coalesce(lag(acct) OVER (PARTITION BY table_id ORDER BY idx), false) THEN 1 ELSE 0 END o FROM a), c AS (SELECT *, sum(o) OVER (PARTITION BY table_id ORDER BY idx) e FROM b)
SELECT table_id, min(idx) "first", max(idx) "last", string_agg(array_to_string(cells, ' '), chr(10) ORDER BY idx) "text" FROM c GROUP BY table_id, e""")
def accounting_entries(spark: SparkSession, d: str) -> DataFrame:
    return R.accounting_entries(rows(spark, d))


PLACE = "PARTITION BY source{more} ORDER BY page, table_id, idx ROWS UNBOUNDED PRECEDING"


@query(f"""WITH {ROWS}, {KINDS}, s AS (SELECT *, kind = 'actor' AND {LABEL.format(c=KEYED)} = '{R.folded(R.UNIT)}' is_unit, sum((kind = 'heading')::INT) OVER ({PLACE.format(more="")}) h FROM k),
u AS (SELECT *, sum(is_unit::INT) OVER ({PLACE.format(more=", h")}) u FROM s),
v AS (SELECT *, last_value(CASE WHEN kind = 'heading' THEN trim(cells[1]) END IGNORE NULLS) OVER ({PLACE.format(more=", h")}) heading, last_value(CASE WHEN kind = 'sub_heading' THEN trim(cells[1]) END IGNORE NULLS) OVER ({PLACE.format(more=", h")}) sub,
last_value(CASE WHEN is_unit THEN cells[2] END IGNORE NULLS) OVER ({PLACE.format(more=", h")}) unit, last_value(CASE WHEN kind = 'actor' AND NOT is_unit THEN cells[2] END IGNORE NULLS) OVER ({PLACE.format(more=", h, u")}) actor FROM u)
SELECT table_id, idx, coalesce(nullif(concat_ws(' > ', heading, sub), ''), '{R.UNCLASSIFIED}') section_path, unit, actor FROM v""")
def section_path(spark: SparkSession, d: str) -> DataFrame:
    told = R.with_sections(rows(spark, d)).select("table_id", "idx", "section_path", "unit", "actor")
    return stored(told, "sections", table(spark, d, "lineitem").count())


@query()
def procedure_chunks(spark: SparkSession, d: str) -> DataFrame:
    """No SQL: pytest holds it against a plain walk down the rows."""
    n = table(spark, d, "lineitem").count()
    return stored(R.procedure_chunks(stored(rows(spark, d), "rows", n)), "procedures", n)


@query(f"""WITH {ROWS}, {KINDS}, c AS (SELECT table_id, idx, count(*) times FROM (SELECT table_id, unnest(range("first", "last" + 1)) idx FROM (SELECT table_id, min(idx) "first", max(idx) "last" FROM r WHERE idx % 5 != 4 GROUP BY 1 UNION ALL SELECT table_id, 1, 1 FROM r WHERE idx = 1 AND table_id % 2 = 0)) GROUP BY 1, 2)
SELECT table_id, idx, kind, coalesce(times, 0)::BIGINT times FROM k LEFT JOIN c USING (table_id, idx) WHERE coalesce(times, 0) > 1 OR (coalesce(times, 0) = 0 AND kind NOT IN ('heading', 'sub_heading', 'actor', 'grid'))""")
def row_coverage(spark: SparkSession, d: str) -> DataFrame:
    own = rows(spark, d)
    spans = own.filter("idx % 5 != 4").groupBy("table_id").agg(F.min("idx").alias("first"), F.max("idx").alias("last"))
    return R.row_coverage(own, spans.unionByName(own.filter("idx = 1 and table_id % 2 = 0").select("table_id", F.lit(1).alias("first"), F.lit(1).alias("last"))))


LINE = "CASE doc_id % 4 WHEN 0 THEN 'القواعد والاحكام العامة :' WHEN 1 THEN 'المو افقات' WHEN 2 THEN 'الاجراءات' ELSE lang END"


@query("""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'القواعد والأحكام العامة' WHEN 1 THEN 'الموافقات' WHEN 2 THEN 'الإجراءات' END anchor FROM documents""")
def anchor_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Damaged and respelled section names, which the table of names must bring back."""
    return table(spark, d, "documents").select("doc_id", R.anchor_for(F.expr(LINE)).alias("anchor"))
