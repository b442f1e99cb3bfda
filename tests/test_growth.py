"""Steps whose cost must follow the size of their input: results by hand where cuts, levels and dealing meet."""

import random
from types import SimpleNamespace

from tessera.operators import corpus as C
from tessera.operators import evaluation as E
from tessera.operators import retrieval as R
from tessera.operators import tables as B
from tessera.plans import registry


def test_many_and_wide_rectangles_of_a_page(spark):
    """Sides on cuts, shared, without end; each fragment goes to the first rectangle around it. Bins of a fixed size could not hold a side
    without end, and met every pair of a page."""
    draw, far = random.Random(4), float("inf")
    side = lambda step: draw.choice([draw.random() * 100, float(draw.randrange(0, 100, step))])
    rects = [(0, 9000, -far, far, 20.0, 20.0), (1, 9001, 0.0, 1e15, 3.0, 4.0), (2, 9002, 1.0, 0.0, 0.0, 9.0), (2, 9003, None, 1.0, 0.0, 1.0)]
    for i in range(1500):
        (a, b), (c, d) = sorted((side(1), side(1))), sorted((side(10), side(10)))
        rects.append((i % 2, i * 7 % 1501, a, min(b, a + 5) if i % 3 else b, c, min(d, c + 5) if i % 3 else d))
    spots = [(i % 4 if i % 40 else None, i, draw.choice([side(1), draw.choice(rects[4:])[2]]), draw.choice([side(10), draw.choice(rects[4:])[5]])) for i in range(2000)] + [(0, 5000, None, 1.0), (1, 5001, 1e14, 3.5)]
    want = {}
    for page, i, x, y in spots:
        around = [r for p, r, a, b, c, d in rects if page == p and None not in (x, a) and a <= x <= b and c <= y <= d]
        want |= {i: min(around)} if around else {}
    fragments = spark.createDataFrame([(p, i, x, x, y, y) for p, i, x, y in spots], "page int, fragment_id int, x0 double, x1 double, y0 double, y1 double")
    got = E.claimed(fragments, spark.createDataFrame(rects, "page int, rect_id int, rx0 double, rx1 double, ry0 double, ry1 double"))
    assert {r.fragment_id: r.rect_id for r in got.collect()} == want and want[5001] == 9001
    nothing = spark.createDataFrame([], "page int, rect_id int, rx0 double, rx1 double, ry0 double, ry1 double")
    assert E.claimed(fragments, nothing).isEmpty()


def planned(df) -> list[str]:
    return df._jdf.queryExecution().executedPlan().toString().splitlines()


def test_state_of_pages_needs_one_order(spark):
    """All windows over the lines of a page share one sort; a task held its lines three times."""
    events = spark.createDataFrame([], "source string, page int, part int, table_no long, idx int, sub int, line int, level string, set_text string, prose boolean, kind string, cells array<string>, break_page int")
    assert not any("Sort [" in x and "_h#" in x for x in planned(C.carried(events)))


def test_state_of_rows_needs_one_order(spark):
    rows = spark.createDataFrame([], "source string, page int, table_id long, idx int, cells array<string>")
    assert sum("Sort [" in x for x in planned(B.with_sections(rows))) == 1


def test_shuffles_of_stored_plans_follow_the_tables(spark):
    """A stored plan has a partition for each share of its tables' rows; the session's number stays."""
    key, was = "spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions")
    seen = []

    def write(path):
        seen.append(int(spark.conf.get(key)))
        spark.range(3).write.parquet(path)

    Spy = SimpleNamespace(schema=spark.range(1).schema, sparkSession=spark, write=SimpleNamespace(parquet=write))
    assert registry.stored(Spy, "spy", 45 * registry.SHARE - 1).count() == 3
    assert registry.stored(Spy, "spy", 1).count() == 3
    assert seen == [45, int(was)] and spark.conf.get(key) == was


def test_shuffle_files_of_stored_plans_go(spark):
    """The disk held the shuffles of all stored steps of a query at once."""
    files = lambda: spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    held = lambda: sum(f.apply(i).length() for f in [files()] for i in range(f.size()))
    was = held()
    assert registry.stored(spark.range(200_000).selectExpr("id", "xxhash64(id) h").repartition(4, "id"), "gone").count() == 200_000
    assert held() - was < 100_000


def test_texts_of_chunks_are_not_dealt(spark):
    """Chunks are numbered where the rows of their page lie; their texts were dealt again by page, by table and by type."""
    pages = spark.createDataFrame([], "source string, page int, text string")
    rows = spark.createDataFrame([], "source string, page int, table_no long, idx int, cells array<string>, break_page int")
    assert not any("Exchange hashpartitioning" in x and "chunk_type#" in x for x in planned(C.chunk_corpus(pages, rows)))


def test_gates_of_coverage_need_one_pass(spark):
    """Rows were held against the spans of the chunks once for each of two gates."""
    rows = spark.createDataFrame([], "source string, page int, table_no long, idx int, cells array<string>, break_page int")
    chunks = spark.createDataFrame([], "chunk_id string, source string, page int, chunk_type string, table_no long, first int, last int, section_path string, unit string, actor string")
    gates = C.chunk_gates(rows, chunks)
    assert sum("Generate explode(sequence(" in x for x in planned(gates)) == 1
    assert gates.collect() == []


def test_rows_of_pages_are_built_once(spark, monkeypatch):
    """Four branches of merged_rows each worked out the fragments; texts of cells were dealt again to be mended once."""
    from tessera.plans import layout

    seen, keep = [], layout.stored
    monkeypatch.setattr(layout, "stored", lambda df, label, rows=0: seen.append((label, "\n".join(planned(df)))) or keep(df, label, rows))
    assert layout.merged_rows(spark, "/root/testdata/sf0.001").count() > 0
    plans = dict(seen)
    assert "lineitem.parquet" not in plans["merged"] and plans["built"].count("Exchange hashpartitioning") <= 5


def test_letters_that_need_no_composing(spark):
    """Only texts with other characters go to Python; a group of fragments is composed as each of them is."""
    import unicodedata

    from pyspark.sql import functions as F

    from tessera.operators import layout as L

    texts = ["abc نص ١٢", "ﬁrst", "e\u0301", "\u0301x", "ا\u0653", "\u0653", "ﻻ", "نـص", None, "", "q\u0307\u0323", "\u0323\u0307"]
    own = spark.createDataFrame([(i // 4, i, float(i % 2), float(i // 2), t) for i, t in enumerate(texts)], "page int, fragment_id int, cx double, cy double, text string")
    got = {r.page: r.text for r in L.reading(own, 0.5, "page").collect()}
    nf = lambda t: unicodedata.normalize("NFKC", t or "")
    assert got == {p: "\n".join(f"{nf(texts[i + 1])} {nf(texts[i])}" for i in (4 * p, 4 * p + 2)) for p in range(3)}
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.col("t").rlike(R.T.COMPOSED).alias("wide"))
    assert {r.t: r.wide for r in df.collect()} == {t: None if t is None else t in texts[1:7] + texts[10:] or t == "نـص" for t in texts}


def test_rows_without_a_table_and_tables_without_events(spark):
    """Rows that name no table are no table's; a page on which nothing is set hands on what it was given."""
    pages = spark.createDataFrame([("a", 3, "3. عنوان\nx"), ("a", 4, None), ("a", 5, "")], "source string, page int, text string")
    cells = [(3, None, 0, ["k", "l", "m"]), (5, 0, 0, ["k", "l", "m"]), (5, 0, 1, ["1", "2", "3"]), (5, None, 0, ["1", "one"]), (4, 7, 0, ["1", "one"])]
    rows = spark.createDataFrame([("a", p, t, i, c, None) for p, t, i, c in cells], "source string, page int, table_no long, idx int, cells array<string>, break_page int")
    got = sorted((r.chunk_id, r.table_no, r.section_path, r.text) for r in C.chunk_corpus(pages, rows).collect())
    assert got == [("a_p04_reference_00", 7, "3. عنوان", "1. one"), ("a_p05_grid_table_00", 0, "3. عنوان", "k | l | m\n1 | 2 | 3")]


def test_levels_of_an_index_from_its_plain_one(spark):
    """Counted terms give the other levels: no text is tokenised again."""
    texts = ["من الكتاب وكتاب كتاب the book book", "الكتاب والكتاب بالكتاب الي 12", "", None, "من في", "abc ABC abc"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    told = lambda x: {r.doc_id: (r.len, dict(zip(r.terms, r.tfs)), len(r.terms), dict(zip(r.terms, r.ids))) for r in x.docs.collect()}
    for level in (R.T.STOPPED, R.T.STRIPPED):
        assert told(R.LexicalIndex.of(docs).at(level)) == told(R.LexicalIndex.of(docs, level))
