"""Rows of tables: their kinds, kinds of tables, chunks of grids, entries and procedures, and the section that a row stands in.

A row is (source, page, table_id, idx, cells). State of headings and actors runs down one document: its windows are partitioned by source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T

# Labels, ordinals, headers and patterns of the manuals.
UNIT, ACTOR = "الجهة المنفذة", "المنفذ"
ORDINALS = ("أولا", "ثانيا", "ثالثا", "رابعا", "خامسا", "سادسا")
APPROVAL = ("الدائرة", "الاسم", "التاريخ", "التوقيع")
REVISION = ("النسخة", "الجهة طالبة التعديل", "التاريخ", "أسباب التعديل")
ANCHORS = (
    "المحتويات", "الموافقات", "مقدمة", "القواعد والأحكام العامة", "الإجراءات", "التقارير", "النماذج", "جدول التعديلات", "الملاحق", "مرفق القيود المحاسبية",
)
STEP = r"^\s*[.\-_]?\s*([0-9]{1,2})\s*[.\-_)]?\s*$"
HEADING = r"^\s*[.]?\s*([0-9]{1,2})\s*[.)]?\s+\S"
ENTRY = r"^\s*(?:(?:من|الي|ال)\s+)?ح\s*[/_]\s*$"
ACCOUNT = r"^\s*(?:(?:من|الي|ال)\s+)?(?:مذكورين|ح\s*[/_])"
UNCLASSIFIED = "غير مصنف"
WHOLE = 6


def folded(word: str) -> str:
    return word.translate(str.maketrans(T.SEATS, T.SEATS_AS))


def number(cell: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(cell, pattern, 1), F.lit("")).cast("int")


def is_actor(cell: Column) -> Column:
    return T.label_key(cell).isin(folded(UNIT), folded(ACTOR))


def is_sub_heading(cell: Column) -> Column:
    return F.ltrim(T.fold_letters(cell), F.lit(T.EDGES)).rlike("^(?:" + "|".join(map(folded, ORDINALS)) + ")")


def anchor_for(line: Column) -> Column:
    """The section that a line names, whatever blanks it holds; null for none."""
    keys = {"".join(folded(a).split()): a for a in ANCHORS}
    return F.try_element_at(F.create_map(*[F.lit(x) for p in keys.items() for x in p]), T.anchor_key(line))


def row_kind(cells: Column) -> Column:
    n, first = F.size(cells), F.get(cells, F.lit(0))
    two = F.when(is_actor(first), "actor").when(first.rlike(STEP), "step").when(T.fold_letters(first).rlike(ENTRY), "entry_line").otherwise("continuation")
    one = F.when(first.rlike(HEADING), "heading").when(is_sub_heading(first), "sub_heading").otherwise("continuation")
    return F.when(n <= 0, "continuation").when(n >= 3, "grid").when(n == 2, two).otherwise(one)


def _facts() -> dict[str, Column]:
    """Aggregates over the rows of a table and their _kind, of which _told makes the table's."""
    wide = F.when(F.size("cells") >= 3, F.col("idx"))
    return {
        "n_rows": F.count("*"), "_entries": F.count_if(F.col("_kind") == "entry_line"), "_grids": F.count_if(F.col("_kind") == "grid"),
        "header": F.min_by("cells", wide), "header_idx": F.min(wide),
    }


def _told() -> Column:
    key = F.transform("header", T.label_key)
    is_ = lambda names: F.coalesce(key == F.array(*[F.lit(folded(n)) for n in names]), F.lit(False))
    return F.when(is_(APPROVAL), "approval").when(is_(REVISION), "revision").when(F.col("_entries") > 0, "accounting").when(F.col("_grids") * 2 > F.col("n_rows"), "grid").otherwise("procedure")


def table_kinds(rows: DataFrame) -> DataFrame:
    """table_id, kind, n_rows, header (the first row of three cells or more) and header_idx."""
    facts = rows.withColumn("_kind", row_kind(F.col("cells"))).groupBy("table_id").agg(*[c.alias(name) for name, c in _facts().items()])
    return facts.select("table_id", _told().alias("kind"), "n_rows", "header", "header_idx")


def with_kinds(rows: DataFrame, *keys: str) -> DataFrame:
    """rows with what table_kinds() says of their table, as table_kind, n_rows, header and header_idx: rows that lie by keys already are not dealt anew."""
    table = Window.partitionBy(*keys)
    own = rows.withColumn("_kind", row_kind(F.col("cells"))).withColumns({name: c.over(table) for name, c in _facts().items()})
    return own.withColumn("table_kind", _told()).drop("_kind", "_entries", "_grids")


def line(cells: Column) -> Column:
    return F.array_join(cells, " | ")


def grid_chunks(rows: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """table_id, first, last, text, chunk_type: grids of few rows whole, larger ones a chunk a row, the header with each; known are table_kinds()."""
    kinds = (table_kinds(rows) if known is None else known).filter("kind in ('grid', 'revision') and header_idx is not null")
    return grids(rows.join(kinds, "table_id"), "table_id")


def grids(rows: DataFrame, *keys: str) -> DataFrame:
    """grid_chunks() of rows that have kind, n_rows, header and header_idx of their table, which keys tell."""
    data = rows.filter("kind in ('grid', 'revision') and header_idx is not null").filter((F.size("cells") > 0) & (F.col("idx") != F.col("header_idx")))
    type_ = F.when(F.col("kind") == "revision", "revision").when(F.col("n_rows") - 1 > WHOLE, "grid_row").otherwise("grid_table")
    counted = data.withColumn("_n", F.count("*").over(Window.partitionBy(*keys))).withColumn("chunk_type", type_)
    each = counted.filter(F.col("_n") > WHOLE).select(*keys, F.col("idx").alias("first"), F.col("idx").alias("last"), F.concat(line(F.col("header")), F.lit("\n"), line(F.col("cells"))).alias("text"), "chunk_type")
    # at most WHOLE rows come together
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("idx", line(F.col("cells")).alias("t")))), lambda x: x["t"]), "\n")
    whole = counted.filter(F.col("_n") <= WHOLE).groupBy(*keys, "header", "n_rows", "chunk_type").agg(body.alias("_b"))
    return each.unionByName(whole.select(*keys, F.lit(0).alias("first"), (F.col("n_rows") - 1).cast("int").alias("last"), F.concat(line(F.col("header")), F.lit("\n"), "_b").alias("text"), "chunk_type"))


def accounting_entries(rows: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """table_id, first, last, text: a new entry begins at a row that is no account line and follows one; known are table_kinds()."""
    kinds = (table_kinds(rows) if known is None else known).filter("kind = 'accounting'").select("table_id")
    return entries(rows.join(kinds, "table_id"), "table_id")


def entries(rows: DataFrame, *keys: str) -> DataFrame:
    """accounting_entries() of the rows of accounting tables, which keys tell."""
    account = (F.size("cells") > 1) | T.fold_letters(F.get("cells", F.lit(0))).rlike(ACCOUNT)
    w = Window.partitionBy(*keys).orderBy("idx")
    own = rows.withColumn("_a", account)
    opens = (~F.col("_a") & F.coalesce(F.lag("_a").over(w), F.lit(False))).cast("int")
    parts = own.withColumn("_o", opens).withColumn("_e", F.sum("_o").over(w))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("idx", F.array_join("cells", " ").alias("t")))), lambda x: x["t"]), "\n")
    return parts.groupBy(*keys, "_e").agg(F.min("idx").alias("first"), F.max("idx").alias("last"), text.alias("text")).drop("_e")


def with_sections(rows: DataFrame) -> DataFrame:
    """Adds kind, heading, sub, section_path, unit and actor as they stand after each row of its document.

    A heading clears sub-heading, unit and actor; a sub-heading only replaces its own; a unit clears the actor."""
    w = Window.partitionBy("source").orderBy("page", "table_id", "idx").rowsBetween(Window.unboundedPreceding, 0)
    first, second = F.get("cells", F.lit(0)), F.get("cells", F.lit(1))
    kind = row_kind(F.col("cells"))
    own = rows.withColumn("kind", kind).withColumn("_h", F.sum((F.col("kind") == "heading").cast("int")).over(w))
    # one order of a document's rows for all windows: what a heading or a unit cleared is told by the numbers it was set under
    is_unit = (F.col("kind") == "actor") & (T.label_key(first) == folded(UNIT))
    own = own.withColumn("_u", F.sum(is_unit.cast("int")).over(w))
    strip = lambda c: F.btrim(c, F.lit(" \t\r\n"))
    set_ = lambda when, c: F.last(F.when(when & c.isNotNull(), F.struct("_h", "_u", c.alias("v"))), ignorenulls=True).over(w)
    own = own.withColumns({
        "_heading": set_(F.col("kind") == "heading", strip(first)), "_sub": set_(F.col("kind") == "sub_heading", strip(first)),
        "_unit": set_(is_unit, second), "_actor": set_((F.col("kind") == "actor") & ~is_unit, second),
    })
    still = lambda c: F.when(F.col(f"_{c}._h") == F.col("_h"), F.col(f"_{c}.v"))
    state = own.withColumns({**{c: still(c) for c in ("heading", "sub", "unit")}, "actor": F.when(F.col("_actor._u").eqNullSafe(F.col("_u")), still("actor"))})
    path = F.concat_ws(" > ", "heading", "sub")
    return state.withColumn("section_path", F.coalesce(F.nullif(path, F.lit("")), F.lit(UNCLASSIFIED))).drop("_h", "_u", "_heading", "_sub", "_unit", "_actor")


def procedure_chunks(rows: DataFrame) -> DataFrame:
    """table_id, first, last, text, chunk_type, unit, actor, section_path: runs of steps under one actor.

    A heading or sub-heading closes a run, which takes the state after that row; an actor's row closes one only if an actor
    or unit was bound before it; so does the table's end. Tables whose runs bind nobody are references."""
    kinds = table_kinds(rows).filter("kind = 'procedure'").select("table_id")
    own = with_sections(rows.join(kinds, "table_id"))
    doc = Window.partitionBy("source").orderBy("page", "table_id", "idx")
    bound = F.coalesce(F.lag(F.coalesce("actor", "unit")).over(doc).isNotNull(), F.lit(False))
    title = F.col("kind").isin("heading", "sub_heading")
    w = Window.partitionBy("table_id").orderBy("idx")
    own = own.withColumn("_opens", ((F.col("kind") == "actor") & bound).cast("int")).withColumn("_title", title.cast("int"))
    own = own.withColumn("_run", F.sum(F.col("_opens") + F.coalesce(F.lag("_title").over(w), F.lit(0))).over(w))
    content = ~title & (F.col("kind") != "actor")
    step = F.concat(number(F.get("cells", F.lit(0)), STEP).cast("string"), F.lit(". "), F.get("cells", F.lit(1)))
    said = F.when(F.col("kind") == "step", step).when(F.col("kind") == "grid", line(F.col("cells"))).otherwise(F.element_at("cells", -1))
    lines = F.filter(F.transform(F.sort_array(F.collect_list(F.struct("idx", F.when(content, said).alias("t")))), lambda x: x["t"]), lambda t: t.isNotNull() & (t != ""))
    runs = own.groupBy("source", "table_id", "_run").agg(
        F.min(F.when(content, F.col("idx"))).alias("first"), F.max(F.when(content, F.col("idx"))).alias("last"), lines.alias("_lines"),
        *[F.max_by(F.struct(F.col(c).alias("v")), "idx")["v"].alias(c) for c in ("unit", "actor", "section_path")],
    ).filter("first is not null")
    head = lambda label, c: F.when(F.col(c).isNotNull() & (F.col(c) != ""), F.concat(F.lit(f"{label}: "), F.col(c)))
    text = F.array_join(F.concat(F.array_compact(F.array(head(UNIT, "unit"), head(ACTOR, "actor"))), "_lines"), "\n")
    named = F.max(F.coalesce("unit", "actor").isNotNull()).over(Window.partitionBy("table_id"))
    return runs.withColumn("_named", named).select("table_id", "first", "last", text.alias("text"), F.when(F.col("_named"), "procedure_block").otherwise("reference").alias("chunk_type"), "unit", "actor", "section_path")


def row_coverage(rows: DataFrame, chunks: DataFrame) -> DataFrame:
    """table_id, idx, kind, times of the rows that more than one chunk covers, or none though their kind should be."""
    spans = chunks.select("table_id", F.explode(F.sequence("first", "last")).alias("idx")).groupBy("table_id", "idx").agg(F.count("*").alias("times"))
    every = rows.select("table_id", "idx", row_kind(F.col("cells")).alias("kind")).join(spans, ["table_id", "idx"], "left").withColumn("times", F.coalesce("times", F.lit(0)))
    return every.filter((F.col("times") > 1) | ((F.col("times") == 0) & ~F.col("kind").isin("heading", "sub_heading", "actor", "grid")))
