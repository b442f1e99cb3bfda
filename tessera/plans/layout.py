"""Registered queries of pages rebuilt from geometry. Orders stand for pages and the tables on them, lineitems for fragments; places
follow from their keys by rules that both engines share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import layout as L
from tessera.plans.registry import query, stored, table
from tessera.plans.sql import CLEAN

HEIGHT, WIDTH, SCALE = 800.0, 600.0, 2.0
PLACE = "concat('m', CAST(CAST(floor(o_orderkey / 8) AS BIGINT) AS STRING)) AS source, CAST(o_orderkey % 8 + 1 AS INT) AS page"
TALL = "o_orderkey % 3 != 0"
TOP = "CASE o_custkey % 4 WHEN 0 THEN 20.0 WHEN 1 THEN 60.0 WHEN 2 THEN 100.0 ELSE 150.0 END"
#: One table a page, and one at the foot of every third customer's pages.
TABLES_OF = f"""SELECT source, page, table_no, CAST(x0 AS DOUBLE) AS x0, CAST(y0 AS DOUBLE) AS y0, CAST(550.0 AS DOUBLE) AS x1, CAST(y1 AS DOUBLE) AS y1, row_count, col_count FROM (
SELECT {PLACE}, CAST(0 AS BIGINT) AS table_no, 50.0 + o_custkey % 4 * 6 AS x0, {TOP} AS y0, CASE WHEN {TALL} THEN 660.0 ELSE {TOP} + CASE WHEN o_custkey % 4 = 0 THEN 60.0 ELSE 90.0 END END AS y1,
CAST(CASE WHEN o_custkey % 4 = 0 THEN 3 ELSE 3 + o_custkey % 3 END AS INT) AS row_count, CAST(2 + floor(o_orderkey / 8) % 3 AS INT) AS col_count FROM {{orders}}
UNION ALL SELECT {PLACE}, CAST(1 AS BIGINT), 50.0 + o_custkey % 5 * 6, 680.0, 755.0, CAST(3 AS INT), CAST(2 + floor(o_orderkey / 8) % 3 AS INT) FROM {{orders}} WHERE o_custkey % 3 = 0) AS t"""
CELLS_OF = """SELECT source, page, table_no, r AS "row", c AS col, CASE WHEN merged THEN NULL ELSE x0 + c * (x1 - x0) / col_count END AS x0, CASE WHEN merged THEN NULL ELSE y0 + r * (y1 - y0) / row_count END AS y0,
CASE WHEN merged THEN NULL ELSE x0 + (c + 1) * (x1 - x0) / col_count END AS x1, CASE WHEN merged THEN NULL ELSE y0 + (r + 1) * (y1 - y0) / row_count END AS y1
FROM (SELECT *, (r + c * 2 + page) % 7 = 3 AS merged FROM {tables} CROSS JOIN (VALUES (0), (1), (2), (3), (4), (5)) AS nr(r) CROSS JOIN (VALUES (0), (1), (2), (3)) AS nc(c) WHERE r < row_count AND c < col_count) AS t"""
SAID = "CASE (l_partkey + k) % 7 WHEN 0 THEN 'الإجداءات' WHEN 1 THEN concat('word', CAST(l_suppkey % 9 AS STRING)) WHEN 2 THEN '' WHEN 3 THEN 'For Internal Use' WHEN 4 THEN 'a   b' WHEN 5 THEN 'رقم النسخة' ELSE 'نص' END"
FRAGMENTS_OF = f"""SELECT source, page, fragment_id, CAST(x - 20 AS DOUBLE) AS x0, CAST(y - 8 AS DOUBLE) AS y0, CAST(x + 20 AS DOUBLE) AS x1, CAST(y + 8 AS DOUBLE) AS y1, said AS "text" FROM (
SELECT {PLACE.replace("o_orderkey", "l_orderkey")}, idx * 8 + k AS fragment_id, (l_partkey * k * 37 + l_suppkey * 11) % 1200 AS x, (l_partkey * 13 + l_suppkey * k * 29 + idx * 97) % 1600 AS y, {SAID} AS said
FROM (SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate) AS INT) AS idx FROM {{lineitem}}) AS l CROSS JOIN (VALUES (1), (2), (3), (4), (5), (6)) AS n(k)) AS t"""


def by_page(spark: SparkSession, d: str, name: str, key: str, *columns: str) -> DataFrame:
    """A table's columns with source and page of its key, dealt by page once: what pages are made of lies together from here on."""
    own = f"SELECT {PLACE.replace('o_orderkey', key)}, {', '.join((key, *columns))} FROM {{own}}"
    return spark.sql(own, own=table(spark, d, name)).repartition("source", "page")


def tables(spark: SparkSession, d: str) -> DataFrame:
    return L.classified(spark.sql(TABLES_OF, orders=table(spark, d, "orders")).repartition("source", "page"), HEIGHT)


def parts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Fragments, cells and tables, all dealt by page: fragments are made of lines where these lie."""
    own = tables(spark, d)
    cells = spark.sql(CELLS_OF.replace('"row"', "row"), tables=own)
    lines = by_page(spark, d, "lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate")
    said = FRAGMENTS_OF.replace('"text"', "text").replace(PLACE.replace("o_orderkey", "l_orderkey"), "source, page").replace("PARTITION BY l_orderkey", "PARTITION BY source, page, l_orderkey")
    return spark.sql(said, lineitem=lines), cells, own


TABLES = f"""ta AS ({TABLES_OF.format(orders="orders")}), tk AS (SELECT *, CASE WHEN row_count = 3 AND y1 < 0.12::DOUBLE * {HEIGHT}::DOUBLE THEN 'header' WHEN col_count <= 2 AND y1 - y0 > 0.6::DOUBLE * {HEIGHT}::DOUBLE THEN 'container' ELSE 'data' END kind FROM ta)"""
TOLERANCE = f"({15 * 72 / 300}::DOUBLE * {SCALE}::DOUBLE)"
MISREAD = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in T.MISREADS.items())
FIXED = f"""regexp_replace(regexp_replace(array_to_string(list_transform(regexp_extract_all(x, '[؀-ۿ]+|[^؀-ۿ]+'), lambda p: CASE p {MISREAD} ELSE p END), ''), '(\\s)_([\\s؀-ۿ])', '\\1 \\2', 'g'), '[ \\t]+', ' ', 'g')"""


def read_sql(source: str, keys: str, out: str) -> str:
    """Texts of groups of fragments, in two named steps."""
    return f"""{out}1 AS (SELECT *, sum(n) OVER (PARTITION BY {keys} ORDER BY cy, fragment_id) line FROM (SELECT *, CASE WHEN cy - lag(cy) OVER (PARTITION BY {keys} ORDER BY cy, fragment_id) > {TOLERANCE} THEN 1 ELSE 0 END n FROM {source})),
{out}2 AS (SELECT {keys}, string_agg(t, chr(10) ORDER BY line) "text" FROM (SELECT {keys}, line, string_agg(said, ' ' ORDER BY cx DESC, cy, fragment_id) t FROM {out}1 GROUP BY ALL) GROUP BY ALL),
{out} AS (SELECT {keys}, {FIXED} "text" FROM (SELECT *, {CLEAN} x FROM {out}2))"""


CLAIMS = f"""ce AS ({CELLS_OF.replace("{tables}", "ta")}), fr AS (SELECT source, page, fragment_id, (x0 + x1) / 2 cx, (y0 + y1) / 2 cy, "text" said FROM ({FRAGMENTS_OF.format(lineitem="lineitem")})),
re AS (SELECT ce.source, ce.page, ce.table_no, "row", col, tk.y0 top, ce.x0 * {SCALE} rx0, ce.y0 * {SCALE} ry0, ce.x1 * {SCALE} rx1, ce.y1 * {SCALE} ry1 FROM ce JOIN tk USING (source, page, table_no) WHERE kind != 'container' AND ce.x0 IS NOT NULL),
cl AS (SELECT fr.*, table_no, "row", col FROM fr JOIN re USING (source, page) WHERE cx BETWEEN rx0 AND rx1 AND cy BETWEEN ry0 AND ry1 QUALIFY row_number() OVER (PARTITION BY source, page, fragment_id ORDER BY top, table_no, "row", col) = 1)"""
ROWS = f"""{CLAIMS}, {read_sql("cl", 'source, page, table_no, "row", col', "ct")},
rw AS (SELECT source, page, table_no, (row_number() OVER (PARTITION BY source, page, table_no ORDER BY "row") - 1)::INT idx, cells FROM (SELECT source, page, table_no, "row", list("text" ORDER BY col DESC) cells FROM ct WHERE "text" != '' GROUP BY ALL))"""


@query(f"WITH {TABLES}, {CLAIMS} SELECT source, page, fragment_id, table_no, \"row\", col FROM cl")
def claim_cells(spark: SparkSession, d: str) -> DataFrame:
    """Each fragment's cell: the first, tables from the top, that holds its centre."""
    fragments, cells, own = parts(spark, d)
    all_ = L.seated(fragments, L.pixel_rects(cells, own, SCALE), "_top", "table_no", "row", "col")
    return all_.where("_first is not null").select("source", "page", "fragment_id", *[F.col("_first")[c].alias(c) for c in ("table_no", "row", "col")])


@query(f"WITH {TABLES}, {ROWS} SELECT * FROM rw")
def build_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows of every header and data table from the fragments in their cells."""
    return L.build_rows(*parts(spark, d), SCALE)[0]


@query(f"""WITH {TABLES}, {CLAIMS}, fe AS (SELECT fr.*, cy >= {L.FOOTER}::DOUBLE * {HEIGHT}::DOUBLE * {SCALE} footer FROM fr ANTI JOIN cl USING (source, page, fragment_id)), fb AS (SELECT * FROM fe WHERE NOT footer), {read_sql("fb", "source, page", "pt")}
SELECT source, page, restricted, coalesce("text", '') prose_text FROM (SELECT source, page, bool_or(footer AND contains(said, '{L.MARKER}')) restricted FROM fe GROUP BY ALL) LEFT JOIN pt USING (source, page)""")
def page_prose(spark: SparkSession, d: str) -> DataFrame:
    """What no table claims: the footer's mark and the prose."""
    fragments, cells, own = parts(spark, d)
    _, all_ = L.build_rows(fragments, cells, own, SCALE)
    return L.page_texts(L.left_over(all_, HEIGHT, SCALE), SCALE)


#: Page by page in order; the tables that a page's boundary compares with are carried along.
SPANS = f"""kt AS (SELECT tk.* FROM tk JOIN (SELECT DISTINCT source, page, table_no FROM rw) USING (source, page, table_no) WHERE kind = 'data'),
pg AS (SELECT source, page, row_number() OVER (PARTITION BY source ORDER BY page) i FROM (SELECT {PLACE} FROM orders)),
en AS (SELECT source, page, arg_min({{'n': table_no, 'x0': x0, 'x1': x1, 'y0': y0, 'y1': y1, 'c': col_count}}, (y0, table_no)) f, arg_max({{'n': table_no, 'x0': x0, 'x1': x1, 'y0': y0, 'y1': y1, 'c': col_count, 'p': page}}, (y0, table_no)) l FROM kt GROUP BY ALL),
pe AS (SELECT pg.*, f, l FROM pg LEFT JOIN en USING (source, page)),
sc AS (WITH RECURSIVE w AS (SELECT source, i, page, l tgt, NULL::BIGINT table_no, NULL::INT rp, NULL::BIGINT rn FROM pe WHERE i = 1 UNION ALL
SELECT source, i, page, CASE WHEN ok THEN {{'n': tgt.n, 'x0': tgt.x0, 'x1': tgt.x1, 'y0': tgt.y0, 'y1': f.y1, 'c': tgt.c, 'p': tgt.p}} ELSE l END, CASE WHEN ok THEN f.n END, CASE WHEN ok THEN tgt.p END, CASE WHEN ok THEN tgt.n END
FROM (SELECT pe.source, pe.i, pe.page, f, l, tgt, coalesce(tgt.c = f.c AND abs(tgt.x0 - f.x0) <= {WIDTH}::DOUBLE * 0.02::DOUBLE AND abs(tgt.x1 - f.x1) <= {WIDTH}::DOUBLE * 0.02::DOUBLE AND tgt.y1 / {HEIGHT}::DOUBLE >= 0.8::DOUBLE AND f.y0 / {HEIGHT}::DOUBLE <= 0.15::DOUBLE, false) ok
FROM w JOIN pe ON pe.source = w.source AND pe.i = w.i + 1)) SELECT source, page, table_no, rp root_page, rn root_table_no FROM w WHERE table_no IS NOT NULL)"""
MERGED = """mr AS (SELECT rw.*, root_page, root_table_no, coalesce(root_page, rw.page) pp, coalesce(root_table_no, rw.table_no) tt FROM rw JOIN kt USING (source, page, table_no) LEFT JOIN sc USING (source, page, table_no)),
mh AS (SELECT mr.* FROM mr LEFT JOIN rw h ON h.source = mr.source AND h.page = mr.root_page AND h.table_no = mr.root_table_no AND h.idx = 0 WHERE NOT coalesce(mr.idx = 0 AND mr.cells = h.cells, false)),
mm AS (SELECT source, pp page, tt table_no, (row_number() OVER (PARTITION BY source, pp, tt ORDER BY page, idx) - 1)::INT idx, cells, CASE WHEN root_page IS NOT NULL AND row_number() OVER (PARTITION BY source, pp, tt, page ORDER BY idx) = 1 THEN page END::INT break_page FROM mh)"""


def kept(rows: DataFrame, own: DataFrame) -> DataFrame:
    """Data tables that have rows."""
    keys = ["source", "page", "table_no"]
    return own.where("kind = 'data'").join(rows.select(*keys).distinct(), keys, "left_semi")


def lines(spark: SparkSession, d: str) -> int:
    """Rows of tables and pages."""
    return table(spark, d, "lineitem").count() + table(spark, d, "orders").count()


def spanned(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Rows of data tables, and where tables go on; rows are stored, as several branches read them and fragments are dear."""
    fragments, cells, own = parts(spark, d)
    rows = stored(L.build_rows(fragments, cells, own, SCALE)[0], "built", lines(spark, d))
    data = kept(rows, own)
    pages = spark.sql(f"SELECT {PLACE} FROM {{orders}}", orders=table(spark, d, "orders"))
    return rows.join(data.select("source", "page", "table_no"), ["source", "page", "table_no"], "left_semi"), L.spans(pages, data, HEIGHT, WIDTH)


@query(f"WITH {TABLES}, {ROWS}, {SPANS} SELECT * FROM sc")
def span_merge(spark: SparkSession, d: str) -> DataFrame:
    """Tables that go on from the page before, and where they began."""
    return stored(spanned(spark, d)[1], "spans", lines(spark, d))


@query(f"WITH {TABLES}, {ROWS}, {SPANS}, {MERGED} SELECT * FROM mm")
def merged_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows of tables over their pages, with the breaks."""
    return stored(L.merged_rows(*spanned(spark, d)), "merged", lines(spark, d))


#: Rows of header tables: labels, one of them misread, beside one value or two.
HEAD_OF = f"""SELECT {PLACE}, CAST(o_custkey % 2 AS BIGINT) AS table_no, k AS idx, CASE k WHEN 0 THEN {{o}}'رقم النسخة', CAST(o_custkey % 3 AS STRING){{c}} WHEN 1 THEN {{o}}o_orderpriority, 'تارىخ الإصدار'{{c}}
WHEN 2 THEN CASE WHEN o_custkey % 5 = 0 THEN {{o}}'تاريخ آخر مراجعة', 'x', 'y'{{c}} ELSE {{o}}'تاريخ آخر مراجعة', CASE WHEN o_custkey % 7 = 0 THEN '' ELSE o_orderstatus END{{c}} END ELSE {{o}}'رقم النسخة', 'رقم النسخة'{{c}} END AS cells
FROM {{orders}} CROSS JOIN (VALUES (0), (1), (2), (3)) AS n(k) WHERE k < 3 OR o_custkey % 11 = 0"""


def header_rows(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders")
    one = HEAD_OF.replace("{o}", "array(").replace("{c}", ")")
    return spark.sql(one, orders=orders).unionByName(spark.sql(one.replace("o_custkey % 2", "0"), orders=orders.where("o_orderkey % 6 = 0")).withColumn("table_no", F.lit(5).cast("long")))


_HEAD = HEAD_OF.replace("{o}", "[").replace("{c}", "]").replace("{orders}", "orders")
HEADS = f"""hr AS ({_HEAD} UNION ALL SELECT * REPLACE (5::BIGINT AS table_no) FROM ({_HEAD.replace("FROM orders", "FROM (SELECT * FROM orders WHERE o_orderkey % 6 = 0)")})),
hl AS (SELECT * FROM hr QUALIFY table_no = max(table_no) OVER (PARTITION BY source, page)),
hp AS (SELECT source, page, idx, i, CASE translate(cells[i], 'ى', 'ي') {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in L.LABELS.items())} END n, cells[3 - i] v FROM hl, (VALUES (1), (2)) AS n(i) WHERE len(cells) = 2),
hf AS (SELECT p.source, p.page, {", ".join(f"arg_max(v, (idx, i)) FILTER (n = '{f}') {f}" for f in L.FIELDS)} FROM (SELECT DISTINCT source, page FROM hl) p LEFT JOIN hp USING (source, page) GROUP BY ALL),
hv AS (SELECT source, n, arg_max(v, (c, -seen)) v, max(c) c FROM (SELECT source, n, v, count(*) c, min(page) seen FROM (UNPIVOT hf ON doc_version, issue_date, review_date INTO NAME n VALUE v) WHERE v != '' GROUP BY ALL) GROUP BY ALL),
hs AS (SELECT s.source, {", ".join(f"any_value(v) FILTER (n = '{f}') {f}, coalesce(max(c) FILTER (n = '{f}'), 0)::BIGINT {f}_page_count" for f in L.FIELDS)} FROM (SELECT DISTINCT source FROM hf) s LEFT JOIN hv USING (source) GROUP BY ALL)"""


@query(f"WITH {HEADS} SELECT * FROM hf")
def header_fields(spark: SparkSession, d: str) -> DataFrame:
    """What the labels of a page's last header table stand beside."""
    return L.header_fields(header_rows(spark, d))


@query(f"WITH {HEADS} SELECT * FROM hs")
def structural_vote(spark: SparkSession, d: str) -> DataFrame:
    """A document's fields by the votes of its pages."""
    return L.structural_vote(L.header_fields(header_rows(spark, d)))


TEXT_VOTE = f"SELECT concat('m', CAST(CAST(floor(o_orderkey / 16) AS BIGINT) AS STRING)) AS source, max(o_orderstatus) AS doc_version, max(CASE WHEN o_custkey % 2 = 0 THEN o_orderpriority END) AS issue_date, CAST(NULL AS STRING) AS review_date FROM {{orders}} GROUP BY 1"
BOTH = ", ".join(f"coalesce(s.{f}, t.{f}) {f}, CASE WHEN s.{f} IS NOT NULL THEN 'structural' WHEN t.{f} IS NOT NULL THEN 'text' END {f}_from" for f in L.FIELDS)
GIVEN = f"tv AS ({TEXT_VOTE.format(orders='orders')}), bf AS (SELECT source, {BOTH} FROM tv t FULL JOIN hs s USING (source))"


def both_votes(spark: SparkSession, d: str) -> DataFrame:
    return L.coalesce_fields(spark.sql(TEXT_VOTE, orders=table(spark, d, "orders")), L.structural_vote(L.header_fields(header_rows(spark, d))))


@query(f"WITH {HEADS}, {GIVEN} SELECT * FROM bf")
def coalesce_provenance(spark: SparkSession, d: str) -> DataFrame:
    """Fields by structure, else by the text, and which it was."""
    return both_votes(spark, d)


@query(f"WITH {HEADS}, {GIVEN}, pp AS (SELECT {PLACE}, o_custkey FROM orders UNION ALL SELECT 'unknown', 1, 0) SELECT page, o_custkey, bf.* REPLACE (pp.source AS source) FROM pp LEFT JOIN bf USING (source)")
def stamp_fields(spark: SparkSession, d: str) -> DataFrame:
    """Pages with their document's fields; a document without any keeps nulls."""
    pages = spark.sql(f"SELECT {PLACE}, o_custkey FROM {{orders}} UNION ALL SELECT 'unknown', 1, 0", orders=table(spark, d, "orders"))
    return L.stamp(pages, both_votes(spark, d))


#: Chunks of tables and of prose; every fifth names a table that its page lacks, and every ninth is asked for by an id that none has.
CHUNKS_OF = f"""SELECT concat('c', CAST(o_orderkey AS STRING)) AS chunk_id, {PLACE}, CASE WHEN o_custkey % 6 = 0 THEN 'prose' ELSE 'grid' END AS chunk_type, CASE WHEN o_custkey % 6 != 0 THEN CAST(CASE WHEN o_custkey % 5 = 0 THEN 7 ELSE 0 END AS BIGINT) END AS table_no,
CAST(o_custkey % 4 - 1 AS INT) AS "first", CAST(o_custkey % 4 + o_custkey % 3 * 2 AS INT) AS "last" FROM {{orders}}"""
LIVE_ROWS = "y0 + (y1 - y0) * 0.25"


@query(f"""WITH {TABLES}, ck AS ({CHUNKS_OF.format(orders="orders")}), ask AS (SELECT CASE WHEN o_orderkey % 9 = 0 THEN 'none' ELSE 'c' END || o_orderkey chunk_id FROM orders), st AS (SELECT *, CASE WHEN row_count % 5 = 4 THEN 1 ELSE row_count END n FROM tk),
lv AS (SELECT source, page, x0 + 1.5 x0, y0, x1, y1 - CASE WHEN row_count = 5 THEN 3 ELSE 0 END y1, {LIVE_ROWS} m FROM tk WHERE page % 2 = 0 AND table_no = 0),
j AS (SELECT ask.chunk_id, ck.source, ck.page, chunk_type, ck.table_no, "first" a, "last" b, st.x0, st.y0, st.x1, st.y1, st.n, lv.m, lv.x0 lx0, lv.y0 ly0, lv.x1 lx1, lv.y1 ly1 FROM ask LEFT JOIN ck USING (chunk_id) LEFT JOIN st USING (source, page, table_no)
LEFT JOIN lv ON lv.source = ck.source AND lv.page = ck.page AND abs(lv.x0 - st.x0) <= 2 AND abs(lv.y0 - st.y0) <= 2 AND abs(lv.y1 - st.y1) <= 2),
k AS (SELECT *, CASE WHEN m IS NOT NULL THEN 2 ELSE n END rows, CASE WHEN chunk_type IS NULL THEN 'unknown chunk id ''' || chunk_id || '''' WHEN table_no IS NULL THEN '{L.PROSE}' WHEN x0 IS NULL THEN 'table ' || table_no || ' is not on the stored page' ELSE '' END reason FROM j),
e AS (SELECT *, greatest(a, 0) lo, least(rows, b + 1) hi FROM k), b AS (SELECT *, CASE WHEN hi <= lo THEN x0 WHEN m IS NOT NULL THEN lx0 ELSE x0 END bx0, CASE WHEN hi <= lo THEN x1 WHEN m IS NOT NULL THEN lx1 ELSE x1 END bx1,
CASE WHEN hi <= lo THEN y0 WHEN m IS NOT NULL THEN CASE WHEN lo = 0 THEN ly0 ELSE m END ELSE y0 + lo * ((y1 - y0) / n) END by0, CASE WHEN hi <= lo THEN y1 WHEN m IS NOT NULL THEN CASE WHEN hi = 1 THEN m ELSE ly1 END ELSE y0 + hi * ((y1 - y0) / n) END by1 FROM e)
SELECT chunk_id, source, page, chunk_type, CASE WHEN reason = '' THEN round_even(bx0 * 2, 0)::INT END x, CASE WHEN reason = '' THEN round_even(by0 * 2, 0)::INT END y, CASE WHEN reason = '' THEN round_even((bx1 - bx0) * 2, 0)::INT END w, CASE WHEN reason = '' THEN round_even((by1 - by0) * 2, 0)::INT END h,
reason = '' covered, CASE WHEN reason != '' THEN 'none' WHEN hi <= lo THEN 'table' WHEN m IS NOT NULL OR n > 1 THEN 'row' ELSE 'table' END \"precision\", reason FROM b""")
def highlight(spark: SparkSession, d: str) -> DataFrame:
    """Where asked chunks stand: rows found anew, bands of the stored box, the box, or a reason for none."""
    orders, own = table(spark, d, "orders"), tables(spark, d)
    asked = orders.select(F.concat(F.when(F.col("o_orderkey") % 9 == 0, "none").otherwise("c"), F.col("o_orderkey").cast("string")).alias("chunk_id"))
    box = F.array("x0", "y0", "x1", "y1").alias("box")
    stored = own.select("source", "page", "table_no", box, F.when(F.col("row_count") % 5 == 4, 1).otherwise(F.col("row_count")).alias("n_rows"))
    seen = own.where("page % 2 = 0 and table_no = 0").withColumn("m", F.expr(LIVE_ROWS)).withColumn("x0", F.col("x0") + 1.5).withColumn("y1", F.col("y1") - F.when(F.col("row_count") == 5, 3).otherwise(0))
    live = seen.select("source", "page", F.lit(0).alias("found_no"), box, F.array(F.array("x0", "y0", "x1", "m"), F.array("x0", "m", "x1", "y1")).alias("rows"))
    return L.highlight(asked, spark.sql(CHUNKS_OF.replace('"', "`"), orders=orders), stored, live, 144)
