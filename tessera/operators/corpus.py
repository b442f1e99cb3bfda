"""Chunks of a whole corpus: headings taken off the prose of pages, and section, unit and actor carried through prose and
table rows of a document in reading order.

State is found in two steps. Lines that set any give what a page leaves behind, a row for each page, and a window over those
rows alone gives what earlier pages left; then all lines meet that row, and windows inside their page give what its own lines
set so far. No task holds all of a document's lines, and only those that set state are dealt twice.

Pages are (source, page, text); rows of tables (source, page, table_no, idx, cells, break_page), where break_page names the
page on which a table that began earlier goes on with this row, null elsewhere. The prose of that page is then heard before
the row. Null texts are empty; an empty corpus gives no chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import passages as P
from tessera.operators import tables as B

#: Pages of titles and contents, and kinds of tables that name their own section.
FURNITURE = (1, 2)
SELF_NAMED = {"approval": "الموافقات", "revision": "جدول التعديلات"}
BLANK = " \t\r\n\f\v"
LAST = 2**31 - 1
#: Lines of a page that are judged before it is known whether more must be.
HEAD = 4
KEY = ("page", "part", "table_no", "idx", "sub", "line")
STATE = ("anchor", "heading", "sub_heading", "unit", "actor")
PAGE = ("source", "page")
TABLE = (*PAGE, "table_no")


def stripped(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANK))


def titled(text: Column) -> Column:
    """struct<events, above>: what the lines at the top of a page's prose set (pos, level, text), and how many lines stand above the prose that is left.

    Lines without a letter of the script are passed over; the first blank line, and the first that names nothing, end it. The
    first HEAD lines are judged; the others only on a page where none of these ends it."""

    def judged(lines: Column) -> Column:
        def one(s: Column, i: Column) -> Column:
            return T.let(F.struct(s.alias("s"), s.rlike("[؀-ۿ]").alias("own")), lambda x: T.let(F.when(x["own"], B.anchor_for(x["s"])), lambda anchor: F.struct(
                i.alias("pos"),
                F.when(x["s"] == "", "stop").when(~x["own"], "skip").when(anchor.isNotNull(), "anchor")
                .when(B.number(x["s"], B.HEADING).isNotNull(), "heading").when(B.is_sub_heading(x["s"]), "sub_heading").otherwise("stop").alias("level"),
                F.coalesce(anchor, x["s"]).alias("text"),
            )))

        return F.transform(lines, lambda s, i: one(stripped(s), i))

    def split(lines: Column, told: Column) -> Column:
        return T.let(F.coalesce(F.get(F.filter(told, lambda x: x["level"] == "stop"), F.lit(0))["pos"], F.size(lines)), lambda end: F.struct(
            F.filter(F.slice(told, F.lit(1), end), lambda x: x["level"] != "skip").alias("events"), end.alias("above"),
        ))

    def whole(lines: Column, head: Column) -> Column:
        return T.let(F.when(F.exists(head, lambda x: x["level"] == "stop"), head).otherwise(judged(lines)), lambda told: split(lines, told))

    return T.let(F.split(F.coalesce(text, F.lit("")), "\n"), lambda lines: T.let(judged(F.slice(lines, 1, HEAD)), lambda head: whole(lines, head)))


def left(text: Column, above: Column) -> Column:
    """The prose below the first lines of a page; null texts are empty."""
    whole = F.coalesce(text, F.lit(""))
    head = F.call_function("substring_index", whole, F.lit("\n"), above)
    return stripped(F.when(above == 0, whole).otherwise(F.substring(whole, F.char_length(head) + 2, F.lit(2**31 - 1))))


def observed(text: Column) -> Column:
    """struct<events, body>: what the lines at the top of a page's prose set, and the prose that is left."""
    return T.let(titled(text), lambda x: F.struct(x["events"].alias("events"), left(text, x["above"]).alias("body")))


def observe(pages: DataFrame) -> DataFrame:
    """source, page, events, above and body of titled() and left(); callers that store the first give bodies that they make where pages lie."""
    seen = pages.withColumn("_seen", titled(F.col("text")))
    return seen.select(*PAGE, F.col("_seen")["events"].alias("events"), F.col("_seen")["above"].alias("above"), left(F.col("text"), F.col("_seen")["above"]).alias("body"))


def placed(df: DataFrame, part: int, table_no, idx, sub: int, line, level, text, prose: bool, *more) -> DataFrame:
    at = (F.lit(part).alias("part"), table_no.cast("long").alias("table_no"), idx.cast("int").alias("idx"), F.lit(sub).alias("sub"), line.cast("int").alias("line"))
    return df.select("source", "page", *at, level.alias("level"), text.alias("set_text"), F.lit(prose).alias("prose"), *more)


def stream(seen: DataFrame, rows: DataFrame) -> DataFrame:
    """Everything that sets or asks for state, with its place: prose events, a mark after each page's prose, a mark before
    each table that sets nothing, rows of procedures and the prose heard at their breaks. Of seen only the events are read; rows
    are tabled()."""
    none = F.lit(None).cast("string")
    lost = (none.alias("kind"), F.lit(None).cast("array<string>").alias("cells"), F.lit(None).cast("int").alias("break_page"))
    event = F.explode("events").alias("e")
    said = seen.select("source", "page", event)
    said = placed(said, 0, F.lit(-1), F.col("e")["pos"], 0, F.lit(0), F.col("e")["level"], F.col("e")["text"], True, *lost)
    marks = placed(seen, 0, F.lit(-1), F.lit(LAST), 0, F.lit(0), none, none, False, *lost)
    content = rows.where(~F.col("page").isin(*FURNITURE) & F.col("table_no").isNotNull())
    asks = placed(content.where("table_kind != 'procedure' and idx = 0"), 1, F.col("table_no"), F.lit(-1), 0, F.lit(0), none, none, False, *lost)
    own = content.where("table_kind = 'procedure'").withColumn("kind", B.row_kind(F.col("cells")))
    first, second = F.get("cells", F.lit(0)), F.get("cells", F.lit(1))
    unit = (F.col("kind") == "actor") & (T.label_key(first) == B.folded(B.UNIT))
    level = F.when(unit, "unit").when(F.col("kind").isin("heading", "sub_heading", "actor"), F.col("kind"))
    body = placed(own, 1, F.col("table_no"), F.col("idx"), 1, F.lit(0), level, F.when(F.col("kind") == "actor", second).otherwise(stripped(first)), False, "kind", "cells", "break_page")
    heard = own.where("break_page is not null").select("source", "page", "table_no", "idx", F.col("break_page").alias("_to"))
    heard = heard.join(seen.select("source", F.col("page").alias("_to"), event), ["source", "_to"])
    heard = placed(heard, 1, F.col("table_no"), F.col("idx"), 0, F.col("e")["pos"], F.col("e")["level"], F.col("e")["text"], True, *lost)
    return said.unionByName(marks).unionByName(asks).unionByName(body).unionByName(heard)


def latched(events: DataFrame) -> DataFrame:
    """Once prose has named a heading (_latch is the first place), numbered rows of that document are no headings."""
    place = F.struct(*KEY)
    return events.withColumn("level", F.when((F.col("level") == "heading") & ~F.col("prose") & (F.col("_latch") < place), F.lit(None)).otherwise(F.col("level")))


def inside(events: DataFrame) -> DataFrame:
    """Adds what the lines of a page set up to each: _h titles and _u units so far, and the state as _anchor, _heading and so on.

    An anchor clears all below it, a heading the sub-heading; both clear unit and actor; a unit clears the actor."""
    page = Window.partitionBy(*PAGE).orderBy(*KEY).rowsBetween(Window.unboundedPreceding, 0)
    # one order of a page's lines for all windows: what a title or a unit cleared is told by the number of titles and units it was set under
    own = events.withColumn("_h", F.sum(F.col("level").isin("anchor", "heading").cast("int")).over(page)).na.fill(0, ["_h"])
    units = F.sum((F.col("level") == "unit").cast("int")).over(page)
    own = own.withColumn("_n", units).na.fill(0, ["_n"])
    set_ = lambda level: F.last(F.when((F.col("level") == level) & F.col("set_text").isNotNull(), F.struct("_h", "_n", "set_text")), ignorenulls=True).over(page)
    # units before the last title
    cleared = F.max(F.when(F.col("level").isin("anchor", "heading"), F.col("_n"))).over(page)
    own = own.withColumns({"_cleared": cleared, **{f"_{s}": set_(s) for s in STATE}})
    still = lambda s: F.when(F.col(f"_{s}._h") == F.col("_h"), F.col(f"_{s}.set_text"))
    return own.withColumns({
        "_u": F.col("_n") - F.coalesce("_cleared", F.lit(0)), "_anchor": F.col("_anchor.set_text"), **{f"_{s}": still(s) for s in STATE[1:4]},
        "_actor": F.when(F.col("_actor._n") == F.col("_n"), still("actor")),
    }).drop("_n", "_cleared")


def handed(events: DataFrame) -> DataFrame:
    """source, page, _latch and the state that earlier pages of the document left (c_anchor, c_heading and so on), a row for each page of a stream."""
    place = F.struct(*KEY)
    setting = events.where("level is not null").select("source", *KEY, "level", "set_text", "prose")
    # pages on which nothing is set stand in the order too
    types = {f.name: f.dataType for f in setting.schema}
    every = events.select(*PAGE).distinct().select(*[c if c in PAGE else F.lit(None).cast(types[c]).alias(c) for c in setting.columns])
    whole = Window.partitionBy("source").orderBy(*KEY).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    latch = F.min(F.when(F.col("prose") & (F.col("level") == "heading"), place)).over(whole)
    own = inside(latched(setting.unionByName(every).withColumn("_latch", latch)))
    # what a page leaves behind, a row a page
    left = own.groupBy(*PAGE).agg(F.first("_latch").alias("_latch"), *[F.max_by(c, place).alias(c) for c in ("_h", "_u", *[f"_{s}" for s in STATE])])
    pages = lambda *keys: Window.partitionBy("source", *keys).orderBy("page")
    upto = lambda *keys: pages(*keys).rowsBetween(Window.unboundedPreceding, 0)
    left = left.withColumn("_hs", F.sum((F.col("_h") > 0).cast("int")).over(upto()))
    left = left.withColumn("_us", F.sum((F.col("_u") > 0).cast("int")).over(upto("_hs")))
    after = left.select(
        *PAGE, "_latch", F.last("_anchor", ignorenulls=True).over(upto()).alias("anchor"), F.first("_heading").over(upto("_hs")).alias("heading"),
        F.last("_sub_heading", ignorenulls=True).over(upto("_hs")).alias("sub_heading"), F.last("_unit", ignorenulls=True).over(upto("_hs")).alias("unit"),
        F.last("_actor", ignorenulls=True).over(upto("_hs", "_us")).alias("actor"),
    )
    return after.select(*PAGE, "_latch", *[F.lag(s).over(pages()).alias(f"c_{s}") for s in STATE])


def carried(events: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """Adds to each row of a stream the state after it, whether something was bound just before it, and section_path; consumed
    tells which rows became titles. before is handed(events), for callers that stored it."""
    before = handed(events) if before is None else before
    own = latched(events.join(before, list(PAGE))).drop("_latch")
    own = inside(own.withColumn("consumed", ~F.col("prose") & F.col("level").isin("heading", "sub_heading")))
    fresh, open_ = F.col("_h") == 0, (F.col("_h") == 0) & (F.col("_u") == 0)
    or_ = lambda s, when: F.when(when, F.coalesce(f"_{s}", f"c_{s}")).otherwise(F.col(f"_{s}"))
    own = own.withColumns({
        "anchor": F.coalesce("_anchor", "c_anchor"), "heading": F.when(fresh, F.col("c_heading")).otherwise(F.col("_heading")),
        "sub_heading": or_("sub_heading", fresh), "unit": or_("unit", fresh), "actor": or_("actor", open_),
    })
    full = lambda c: F.nullif(F.col(c), F.lit(""))
    order = Window.partitionBy(*PAGE).orderBy(*KEY)
    own = own.withColumn("_who", F.coalesce(full("actor"), full("unit")))
    first = F.coalesce(full("c_actor"), full("c_unit"))
    own = own.withColumn("bound", F.when(F.row_number().over(order) == 1, first).otherwise(F.lag("_who").over(order)).isNotNull())
    path = F.array_join(F.array_compact(F.array(full("anchor"), full("heading"), full("sub_heading"))), " > ")
    return own.withColumn("section_path", F.coalesce(F.nullif(path, F.lit("")), F.lit(B.UNCLASSIFIED))).select(
        "source", *KEY, "prose", "level", "kind", "cells", "break_page", "consumed", "bound", *STATE, "section_path"
    )


def joined(key: str, text: Column) -> Column:
    """Texts of a group that a table's rows bound, in order, empty ones left out."""
    lines = F.transform(F.sort_array(F.collect_list(F.struct(key, text.alias("t")))), lambda x: x["t"])
    return F.filter(lines, lambda t: t.isNotNull() & (t != ""))


def procedures(state: DataFrame) -> DataFrame:
    """Runs of steps under one actor; a title closes a run with the state after it, a break, a bound actor's row and the
    table's end with the state before."""
    own = state.where("part = 1 and sub = 1").select(*TABLE, "idx", "kind", "cells", "break_page", "consumed", "bound", "unit", "actor", "section_path").repartition(*PAGE)
    opens = F.col("break_page").isNotNull() | ((F.col("kind") == "actor") & F.col("bound"))
    w = Window.partitionBy(*TABLE).orderBy("idx")
    own = own.withColumn("_o", opens.cast("int")).withColumn("_c", F.coalesce(F.lag(F.col("consumed").cast("int")).over(w), F.lit(0)))
    own = own.withColumn("run", F.sum(F.col("_o") + F.col("_c")).over(w))
    content = ~F.coalesce(F.col("consumed"), F.lit(False)) & (F.col("kind") != "actor")
    step = F.concat(B.number(F.get("cells", F.lit(0)), B.STEP).cast("string"), F.lit(". "), F.get("cells", F.lit(1)))
    said = F.when(F.col("kind") == "step", step).when(F.col("kind") == "grid", B.line(F.col("cells"))).otherwise(F.try_element_at("cells", F.lit(-1)))
    runs = own.groupBy(*TABLE, "run").agg(
        F.min(F.when(content, F.col("idx"))).alias("first"), F.max(F.when(content, F.col("idx"))).alias("last"), joined("idx", F.when(content, said)).alias("_lines"),
        F.max("break_page").alias("_end"), *[F.max_by(F.struct(F.col(c).alias("v")), "idx")["v"].alias(c) for c in ("unit", "actor", "section_path")],
    ).withColumn("_end", F.max("_end").over(Window.partitionBy(*TABLE))).where("first is not null")
    head = lambda label, c: F.when(F.col(c) != "", F.concat(F.lit(f"{label}: "), F.col(c)))
    text = F.array_join(F.concat(F.array_compact(F.array(head(B.UNIT, "unit"), head(B.ACTOR, "actor"))), "_lines"), "\n")
    named = F.max((F.coalesce("unit", F.lit("")) != "") | (F.coalesce("actor", F.lit("")) != "")).over(Window.partitionBy(*TABLE))
    return runs.withColumn("_named", named).select(
        *TABLE, "_end", F.when(F.col("_named"), "procedure_block").otherwise("reference").alias("chunk_type"), "first", "last", text.alias("text"), "section_path", "unit", "actor"
    )


def plain(rows: DataFrame, state: DataFrame) -> DataFrame:
    """Chunks of grids, entries and approvals under the path asked for before each table; pages of titles and empty tables give none.

    A kind's rows are dealt by page once, and so do the paths come, as a map of a page's tables."""
    keys = (*TABLE, "_end")
    content = rows.where(~F.col("page").isin(*FURNITURE) & F.col("table_no").isNotNull()).select(*keys, "idx", "cells", F.col("table_kind").alias("kind"), "n_rows", "header", "header_idx")
    of = lambda *kinds: content.where(F.col("kind").isin(*kinds)).repartition(*PAGE)
    approvals = of("approval").groupBy(*keys).agg(
        F.lit(0).alias("first"), F.max("idx").alias("last"), F.array_join(joined("idx", F.when(F.size("cells") > 0, B.line(F.col("cells")))), "\n").alias("text")
    ).where("text != ''")
    typed = lambda df, t: df.withColumn("chunk_type", F.lit(t))
    asked = state.where("part = 1 and idx = -1").groupBy(*TABLE).agg(F.first("section_path").alias("_path"))
    paths = asked.groupBy(*PAGE).agg(F.map_from_entries(F.collect_list(F.struct("table_no", "_path"))).alias("_paths"))
    names = F.create_map(*[F.lit(x) for p in SELF_NAMED.items() for x in p])
    path = F.coalesce(F.try_element_at(names, F.col("chunk_type")), F.try_element_at("_paths", F.col("table_no")))
    lost = F.lit(None).cast("string")
    parts = B.grids(of("grid", "revision"), *keys).unionByName(typed(B.entries(of("accounting"), *keys), "accounting_entry")).unionByName(typed(approvals, "approval"))
    own = parts.join(paths, list(PAGE)).where(F.map_contains_key("_paths", F.col("table_no")))
    return own.select(*keys, "chunk_type", "first", "last", "text", path.alias("section_path"), lost.alias("unit"), lost.alias("actor"))


def tabled(rows: DataFrame) -> DataFrame:
    """rows with what is known of their table: table_kind, n_rows, header, header_idx, and _end, the last page on which it goes on."""
    if "table_kind" in rows.columns:
        return rows
    return B.with_kinds(rows, *TABLE).withColumn("_end", F.max("break_page").over(Window.partitionBy(*TABLE)))


def states(pages: DataFrame, rows: DataFrame, seen: DataFrame | None = None, before: DataFrame | None = None) -> DataFrame:
    """The state after every line that sets or asks for it; seen is observe(pages), before what handed() makes of the stream, for callers that stored them."""
    return carried(stream(observe(pages) if seen is None else seen, tabled(rows)), before)


def chunk_parts(rows: DataFrame, state: DataFrame, seen: DataFrame) -> dict[str, DataFrame]:
    """The chunks of chunk_corpus() in three parts, no type of which is in two: prose, plain tables and procedures. rows are tabled(), of seen only the bodies are read."""
    after = state.where(F.col("idx") == LAST).select(*PAGE, "section_path")
    bodies = seen.where(~F.col("page").isin(*FURNITURE)).select(*PAGE, F.posexplode(P.prose(F.col("body"))).alias("first", "text")).join(after, list(PAGE))
    lost, no = F.lit(None).cast("string"), F.lit(None).cast("int")
    prose = bodies.select(*PAGE, F.lit(-1).cast("long").alias("table_no"), no.alias("_end"), F.lit("prose").alias("chunk_type"), "first", no.alias("last"), "text", "section_path", lost.alias("unit"), lost.alias("actor"))
    return {"prose": numbered(prose), "plain": numbered(plain(rows, state)), "procedures": numbered(procedures(state))}


def numbered(chunks: DataFrame) -> DataFrame:
    """Chunks of some types, all of each, with their ids; chunks that lie by page are not dealt anew."""
    number = F.row_number().over(Window.partitionBy(*PAGE, "chunk_type").orderBy("table_no", "first")) - 1
    is_prose = F.col("table_no") < 0
    return chunks.select(
        F.format_string("%s_p%02d_%s_%02d", T.slug(F.col("source")), "page", "chunk_type", number).alias("chunk_id"), "source", "page", F.coalesce("_end", "page").cast("int").alias("end_page"),
        "chunk_type", F.when(~is_prose, F.col("table_no")).alias("table_no"), F.when(~is_prose, F.col("first")).alias("first"), "last", "section_path", "unit", "actor", "text",
        F.char_length("text").cast("int").alias("char_count"), T.assessed(F.col("text"))["verdict"].alias("extraction_quality"),
    )


def chunk_corpus(pages: DataFrame, rows: DataFrame, state: DataFrame | None = None, seen: DataFrame | None = None) -> DataFrame:
    """chunk_id, source, page, end_page, chunk_type, table_no, first, last, section_path, unit, actor, text, char_count,
    extraction_quality of every chunk: prose of a page before its tables, ids numbered by page and type in reading order.
    Several branches read observe(pages), states(pages, rows) and tabled(rows); callers that stored them give them."""
    seen, rows = observe(pages) if seen is None else seen, tabled(rows)
    prose, tables, runs = chunk_parts(rows, states(pages, rows, seen) if state is None else state, seen).values()
    return prose.unionByName(tables).unionByName(runs)


def chunk_gates(rows: DataFrame, chunks: DataFrame) -> DataFrame:
    """gate, n of what the build got wrong: repeated ids, chunks without a path, blocks that bind nobody, rows in two chunks
    and content rows in none; no rows of a gate that found nothing."""
    one = lambda gate, df: df.agg(F.count("*").alias("n")).select(F.lit(gate).alias("gate"), "n")
    empty = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    spans = chunks.where("first is not null and table_no is not null").select(F.struct(*TABLE).alias("table_id"), "first", "last")
    content = rows.where(~F.col("page").isin(*FURNITURE)).select(F.struct(*TABLE).alias("table_id"), "idx", "cells")
    # both gates in one pass
    covered = B.row_coverage(content, spans).agg(*[F.count_if(w).alias(g) for g, w in (("overlapping", F.col("times") > 1), ("dropped", F.col("times") == 0))])
    covered = covered.select(F.inline(F.array(*[F.struct(F.lit(g).alias("gate"), F.col(g).alias("n")) for g in ("overlapping", "dropped")])))
    found = (
        one("repeated_ids", chunks.groupBy("chunk_id").count().where("count > 1")).unionByName(one("no_path", chunks.where(empty("section_path"))))
        .unionByName(one("unbound", chunks.where((F.col("chunk_type") == "procedure_block") & empty("unit") & empty("actor"))))
        .unionByName(covered)
    )
    return found.where("n > 0")
