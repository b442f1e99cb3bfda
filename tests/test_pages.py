"""The corpus chunker and the layout by hand."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import corpus as C
from tessera.operators import layout as L
from tessera.operators import tables as B

UNIT, ACTOR = B.UNIT, B.ACTOR
LONG = "نص الصفحة الذي يكفي طوله كي يصير قطعة من النثر"
PAGES = [
    ("a", 1, "الاجراءات\n2. عنوان أول"), ("a", 3, None), ("a", 4, f"02/2026\n\nأولا: لا يسمع\n{LONG}"), ("a", 5, f"المو افقات\n{LONG}\n- 2 {LONG}"), ("a", 6, ""),
    ("b", 3, "أولا: فرع\n1) عنوان ب"), ("b", 4, "5. عنوان تال\nنص"), ("c", 9, "x"),
]
ROWS = [
    # furniture pages set headings by prose alone
    ("a", 1, 0, [["7. ليس عنوانا"]]), ("a", 3, 0, [["3. عنوان في جدول"], [UNIT, "U"], ["1", "one"]]), ("a", 4, 0, [["2", "two"], [ACTOR, "A"], ["3", "three"]]),
    ("a", 6, 0, [list(B.APPROVAL), ["x"]]), ("a", 6, 1, [["من ح /", "cash"], ["إلى ح / x"], ["next"]]),
    ("b", 3, 0, [[ACTOR, "B"], ["1", "first"], ["2", "second"]]), ("c", 9, 0, [["6. جدول"], ["1", "only"]]), ("c", 9, 1, [["k", "l", "m"], ["1", "2", "3"], []]),
]


@pytest.fixture(scope="module")
def corpus(spark):
    pages = spark.createDataFrame(PAGES, "source string, page int, text string")
    flat = [(s, p, t, i, c, 4 if (s, i) == ("b", 2) else None) for s, p, t, rows in ROWS for i, c in enumerate(rows)]
    return pages, spark.createDataFrame(flat, "source string, page int, table_no long, idx int, cells array<string>, break_page int")


def test_titles_come_off_the_top(spark):
    texts = {"": ([], ""), "x\ny": ([], ""), "02/2026\n مقدمة \n3. عنوان\nثانيا: ب\nنص\nمقدمة": (["anchor:مقدمة", "heading:3. عنوان", "sub_heading:ثانيا: ب"], "نص\nمقدمة"), "\nمقدمة": ([], "مقدمة"), None: ([], "")}
    df = spark.createDataFrame([(t,) for t in texts], "text string").withColumn("o", C.observed(F.col("text")))
    for r in df.collect():
        assert ([f"{e.level}:{e.text}" for e in r.o.events], r.o.body) == texts[r.text]


def test_titles_below_many_lines_passed_over(spark):
    lines = ["02/2026"] * 12 + ["3. عنوان", "نص", "4. none"]
    df = spark.createDataFrame([("\n".join(lines),), ("\n".join(lines[:12]),)], "text string").withColumn("o", C.observed(F.col("text")))
    assert [([tuple(e) for e in r.o.events], r.o.body) for r in df.collect()] == [([(12, "heading", "3. عنوان")], "نص\n4. none"), ([], "")]


def test_pages_are_dealt_over_all_cores(spark):
    from tessera.plans import corpus as plans

    pages = plans.pages(spark, "/root/testdata/sf0.001")
    assert pages.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_chunks_by_hand(corpus):
    pages, rows = corpus
    chunks = C.chunk_corpus(pages, rows).collect()
    top = "الإجراءات > 2. عنوان أول"
    assert {r.chunk_id for r in chunks} >= {"a_p03_procedure_block_00", "a_p04_procedure_block_01", "a_p05_prose_01", "b_p03_procedure_block_01", "c_p09_grid_table_00"}
    by = {(r.source, r.page, r.chunk_type, r.first): r for r in chunks}
    # prose named a heading on page 1, so the numbered row of page 3 is content
    one = by["a", 3, "procedure_block", 0]
    assert (one.text, one.section_path, one["last"]) == (f"{UNIT}: U\n3. عنوان في جدول\n1. one", top, 2)
    # the unit outlives the page; the actor's row closes what stood before it
    assert by["a", 4, "procedure_block", 0].text == f"{UNIT}: U\n2. two" and by["a", 4, "procedure_block", 2].text == f"{UNIT}: U\n{ACTOR}: A\n3. three"
    # a blank line ends the titles before the ordinal
    assert by["a", 4, "prose", None].section_path == top
    # an anchor frees unit and actor and the titles below it
    assert [(r.text, r.section_path) for r in sorted((r for r in chunks if (r.source, r.page) == ("a", 5)), key=lambda r: r.chunk_id)][0] == (LONG, "الموافقات")
    assert sum(r.page == 5 for r in chunks) == 2
    assert (by["a", 6, "approval", 0].section_path, by["a", 6, "approval", 0].table_no) == ("الموافقات", 0)
    assert [by["a", 6, "accounting_entry", i].text for i in (0, 2)] == ["من ح / cash\nإلى ح / x", "next"]
    # the break closes the run before the page's title is heard
    assert by["b", 3, "procedure_block", 1].section_path == "1) عنوان ب" and by["b", 3, "procedure_block", 1].end_page == 4
    assert by["b", 3, "procedure_block", 2].text == "2. second"
    assert by["b", 3, "procedure_block", 2].section_path == "5. عنوان تال"
    # without a heading in prose a numbered row is a title; it binds nobody
    assert (by["c", 9, "reference", 1].section_path, by["c", 9, "grid_table", 0].text) == ("6. جدول", "k | l | m\n1 | 2 | 3")
    assert all(r.page > 2 for r in chunks) and {r.extraction_quality for r in chunks} == {"ok"}
    assert C.chunk_corpus(pages.limit(0), rows.limit(0)).count() == 0


def test_gates_find_what_is_wrong(corpus):
    pages, rows = corpus
    chunks = C.chunk_corpus(pages, rows)
    # the row after the break stands under a title that binds nobody
    assert [tuple(r) for r in C.chunk_gates(rows, chunks).collect()] == [("unbound", 1)]
    bad = chunks.where("chunk_type != 'accounting_entry'").unionByName(chunks.where("chunk_type = 'approval'")).withColumn("section_path", F.when(F.col("page") != 4, F.col("section_path")))
    assert {r.gate: r.n for r in C.chunk_gates(rows, bad).collect()} == {"repeated_ids": 1, "no_path": 3, "unbound": 1, "overlapping": 2, "dropped": 3}


def test_claims_go_to_the_first_rectangle(spark):
    rects = spark.createDataFrame([("a", 1, 0.0, 0.0, 600.0, 100.0, 2), ("a", 1, 500.0, 0.0, 2000.0, 2000.0, 1), ("a", 2, 0.0, 0.0, 9.0, 9.0, 3), ("a", 1, None, 0.0, 1.0, 1.0, 0)], "source string, page int, rx0 double, ry0 double, rx1 double, ry1 double, nth int")
    at = [(1, 10, 10), (2, 550, 50), (3, 600, 100), (4, 601, 101), (5, 2000, 2000), (6, 2001, 1), (7, None, 5), (8, 300, 100)]
    fragments = spark.createDataFrame([("a", 1, i, x, y, x, y, "t") for i, x, y in [(i, None if x is None else float(x), float(y)) for i, x, y in at]], "source string, page int, fragment_id int, x0 double, y0 double, x1 double, y1 double, text string")
    for size in (64.0, 5000.0):
        got = {r.fragment_id: r.nth for r in L.claim(fragments, rects, "nth", bin_size=size).collect()}
        assert got == {1: 2, 2: 1, 3: 1, 4: 1, 5: 1, 8: 2}


def test_claims_deal_nothing_anew(spark):
    from tessera.plans import layout as plans

    fragments, cells, own = plans.parts(spark, "/root/testdata/sf0.001")
    df = L.seated(fragments, L.pixel_rects(cells, own, plans.SCALE), "_top", "table_no", "row", "col")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ENSURE_REQUIREMENTS" not in plan and plan.count("Exchange hashpartitioning") <= 3


def test_reading_from_the_right(spark):
    rows = [(1, 10.0, 10.0, "left"), (2, 90.0, 12.0, "right"), (3, 50.0, 40.0, None), (4, 60.0, 40.0, "ﬁrst"), (5, None, 1.0, "lost"), (6, 10.0, 14.5, "chained")]
    df = spark.createDataFrame(rows, "fragment_id int, cx double, cy double, text string").withColumn("page", F.lit(1))
    assert L.reading(df, 3.0, "page").first().text == "right left chained\nfirst "


def tables_of(spark, rows):
    return spark.createDataFrame(rows, "source string, page int, table_no long, x0 double, y0 double, x1 double, y1 double, row_count int, col_count int")


def test_spans_chain_over_pages(spark):
    box = lambda p, n, y0, y1, x0=50.0, c=3, s="a": (s, p, n, x0, y0, 550.0, y1, 4, c)
    rows = [
        box(1, 0, 300.0, 700.0), box(2, 0, 50.0, 760.0, 58.0), box(3, 0, 60.0, 700.0, 61.0), box(3, 1, 710.0, 780.0, 90.0), box(4, 0, 40.0, 300.0, 90.0),
        # the open table is compared by its first page's sides: 66 lies too far from 50, though near 58
        box(1, 0, 300.0, 700.0, s="b"), box(2, 0, 50.0, 760.0, 58.0, s="b"), box(3, 0, 60.0, 700.0, 66.0, s="b"), box(4, 0, 60.0, 300.0, 66.0, s="b"),
        box(1, 0, 300.0, 700.0, s="c"), box(3, 0, 50.0, 700.0, s="c"), box(1, 0, 300.0, 700.0, s="d"), box(2, 0, 50.0, 700.0, c=4, s="d"),
    ]
    pages = spark.createDataFrame([(s, p) for s in "abcd" for p in (1, 2, 3, 4)], "source string, page int")
    got = sorted(map(tuple, L.spans(pages, tables_of(spark, rows), 800.0, 600.0).collect()))
    # page 3's second table isn't asked while the first is still open
    assert got == [("a", 2, 0, 1, 0), ("a", 3, 0, 1, 0), ("b", 2, 0, 1, 0), ("b", 4, 0, 3, 0)]
    cells = {("a", 1): ["h", "1"], ("a", 2): ["h", "2"], ("a", 3): ["h"], ("a", 4): ["4"]}
    flat = [("a", p, 0, i, [c]) for (_, p), cs in cells.items() for i, c in enumerate(cs)]
    merged = L.merged_rows(spark.createDataFrame(flat, "source string, page int, table_no long, idx int, cells array<string>"), L.spans(pages, tables_of(spark, rows), 800.0, 600.0).where("source = 'a'"))
    assert sorted((r.page, r.idx, r.cells[0], r.break_page) for r in merged.collect()) == [(1, 0, "h", None), (1, 1, "1", None), (1, 2, "2", 2), (4, 0, "4", None)]
    assert L.spans(pages.limit(0), tables_of(spark, []), 800.0, 600.0).count() == 0


def test_header_fields_and_votes(spark):
    rows = [("a", 1, 0, 0, ["رقم النسخة", "9"]), ("a", 1, 1, 0, ["تارىخ الإصدار", "02/2026"]), ("a", 2, 0, 0, ["3", "رقم النسخة"]), ("a", 2, 0, 1, ["تاريخ آخر مراجعة", "x", "y"]), ("a", 3, 0, 0, ["رقم النسخة", "3"]), ("a", 4, 0, 0, ["رقم النسخة", "4"]), ("b", 1, 0, 0, ["none"])]
    fields = L.header_fields(spark.createDataFrame(rows, "source string, page int, table_no long, idx int, cells array<string>"))
    assert sorted(map(tuple, fields.collect()), key=str) == [("a", 1, None, "02/2026", None), ("a", 2, "3", None, None), ("a", 3, "3", None, None), ("a", 4, "4", None, None), ("b", 1, None, None, None)]
    votes = {r.source: (r.doc_version, r.doc_version_page_count, r.issue_date, r.review_date_page_count) for r in L.structural_vote(fields).collect()}
    assert votes == {"a": ("3", 2, "02/2026", 0), "b": (None, 0, None, 0)}
