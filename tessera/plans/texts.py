"""Registered queries of text functions: folds, tokens, names of pages and chunks, prefixes, sets of words and markers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import passages as P
from tessera.plans.registry import query, table
from tessera.plans.sql import DIGITS, clitics_sql, fold, tokens_sql

#: Turns with words of the other script, digits and markers, the same in both dialects.
TURN = "concat(CASE WHEN turn % 3 = 0 THEN 'والمنفذ إلى أن ٣٤ الجهة، ' WHEN turn % 3 = 1 THEN '-) أولا: ' ELSE '' END, text, ' [', CAST(turn % 7 AS STRING), '] [1] [9] [1].')"
VARCHAR = TURN.replace("STRING", "VARCHAR")
MISREAD = "concat('الإجداءات، البديد لجداول _ ', text, ' الوادمن _الجرد')"
GENERIC = ", ".join(f"'{w}'" for w in T.GENERIC)
SLUG = rf"coalesce(nullif(array_to_string(list_filter(string_split_regex(lower(regexp_replace(source, '\.[^.]*$', '')), '[^a-z0-9]+'), lambda w: w != '' AND w NOT IN ({GENERIC}))[1:2], '_'), ''), 'doc')"
NAMED = "concat('The Manual of ', source, ' Unit v', CAST(doc_id % 3 AS STRING), '.pdf')"
FIRSTS = "list_filter({x}, lambda v, i: list_position({x}, v) = i)"


def turns(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").withColumn("x", F.expr(TURN))


def _turns_sql(select: str) -> str:
    return f"SELECT conv_id, turn, {select} FROM (SELECT *, {VARCHAR} x FROM conversations)"


@query(_turns_sql(f"""{fold('x')} letters, translate(x, {DIGITS}) digits, trim(trim({fold('x')}, '{T.EDGES}'), ' ' || chr(9) || chr(13) || chr(10)) label,
regexp_replace(trim({fold('x')}, '{T.EDGES}'), '\\s+', '', 'g') anchor, lower(trim({fold('x')}, '{T.GATE_EDGES}')) gate, translate(x, 'ى', 'ي') maksura"""))
def fold_letters(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("x")
    return turns(spark, d).select("conv_id", "turn", T.fold_letters(x).alias("letters"), T.fold_digits(x).alias("digits"), T.label_key(x).alias("label"),
                                  T.anchor_key(x).alias("anchor"), T.gate_key(x).alias("gate"), F.translate(x, "ى", "ي").alias("maksura"))


@query(_turns_sql(", ".join(f"array_to_string({tokens_sql('x', level)}, ' ') {level}" for level in (T.PLAIN, T.STOPPED, T.STRIPPED))))
def tokenize_clitics(spark: SparkSession, d: str) -> DataFrame:
    """The three levels of the tokeniser side by side."""
    return turns(spark, d).select("conv_id", "turn", *[F.array_join(T.tokens(F.col("x"), level), " ").alias(level) for level in (T.PLAIN, T.STOPPED, T.STRIPPED)])


@query(f"SELECT DISTINCT w token, {clitics_sql('w')} stem, w >= 'ء' arabic FROM (SELECT unnest({tokens_sql('x')}) w FROM (SELECT {VARCHAR} x FROM conversations))")
def strip_clitics(spark: SparkSession, d: str) -> DataFrame:
    words = turns(spark, d).select(F.explode(T.tokens(F.col("x"))).alias("token")).distinct()
    return words.select("token", T.strip_clitics(F.col("token")).alias("stem"), F.col("token").rlike("^[ء-ي]").alias("arabic"))


@query(f"""SELECT conv_id, turn, regexp_replace(regexp_replace(array_to_string(list_transform(regexp_extract_all(x, '[؀-ۿ]+|[^؀-ۿ]+'), lambda p: CASE p {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in T.MISREADS.items())} ELSE p END), ''),
'(\\s)_([\\s؀-ۿ])', '\\1 \\2', 'g'), '[ \\t]+', ' ', 'g') fixed FROM (SELECT *, {MISREAD} x FROM conversations)""")
def dict_correct(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", T.correct_misreads(F.expr(MISREAD)).alias("fixed"))


@query(f"""SELECT doc_id, slug, printf('%s:p%02d', slug, page) page_ref, printf('%s_p%02d_%s_%02d', slug, page, lang, doc_id // 50 % 100) chunk_id,
CASE WHEN doc_id % 2 = 0 THEN printf('pages %d-%d', page, page + 1) ELSE printf('page %d', page) END label FROM (SELECT doc_id, doc_id % 50 page, lang, {SLUG} slug FROM (SELECT doc_id, lang, {NAMED.replace("STRING", "VARCHAR")} source FROM documents))""")
def source_slug(spark: SparkSession, d: str) -> DataFrame:
    """Names made from a source: slug, page reference, chunk id and page label."""
    docs = table(spark, d, "documents").select("doc_id", (F.col("doc_id") % 50).alias("page"), "lang", T.slug(F.expr(NAMED)).alias("slug"))
    end = F.when(F.col("doc_id") % 2 == 0, F.col("page") + 1).otherwise(F.col("page"))
    return docs.select("doc_id", "slug", P.page_ref(F.col("slug"), F.col("page")).alias("page_ref"),
                       F.format_string("%s_p%02d_%s_%02d", "slug", "page", "lang", F.expr("doc_id div 50 % 100")).alias("chunk_id"), P.page_label(F.col("page"), end).alias("label"))


@query("""SELECT doc_id, concat(source, printf(':p%02d', p)) page_ref, source slug, p::INT page FROM (SELECT doc_id, source, unnest(range(doc_id % 40, doc_id % 40 + CASE WHEN doc_id % 4 = 0 THEN 0 ELSE doc_id % 4 END + 1)) p FROM documents)""")
def page_range_expand(spark: SparkSession, d: str) -> DataFrame:
    """slug:a-b or slug:a as references of pages, and these read back."""
    low, more = F.col("doc_id") % 40, F.col("doc_id") % 4
    arg = F.when(more == 0, F.concat_ws(":", "source", low.cast("string"))).otherwise(F.concat("source", F.lit(":"), low.cast("string"), F.lit("-"), (low + more).cast("string")))
    refs = table(spark, d, "documents").select("doc_id", F.explode(P.page_range(arg)).alias("page_ref"))
    return refs.select("doc_id", "page_ref", *P.parse_page_ref(F.col("page_ref")))


@query("""SELECT doc_id, length(composed)::BIGINT n, substr(composed, length(p) + CASE WHEN p = '' THEN 1 ELSE 3 END) = text same, p FROM (SELECT doc_id, text, p, CASE WHEN p = '' THEN text ELSE concat(p, chr(10), chr(10), text) END composed FROM (
SELECT doc_id, text, CASE WHEN doc_id % 3 = 0 THEN '' ELSE concat_ws('، ', 'title ' || source, CASE WHEN doc_id % 2 = 0 THEN lang END, printf('page %d', doc_id % 50), CASE WHEN NOT contains(text, 'the') THEN 'the' END) END p FROM documents))""")
def context_compose(spark: SparkSession, d: str) -> DataFrame:
    """Prefixes of a template put before texts and taken off again; parts that are null are left out, labels that the text has too."""
    docs = table(spark, d, "documents")
    made = P.template(F.concat(F.lit("title "), "source"), F.when(F.col("doc_id") % 2 == 0, F.col("lang")), P.page_label(F.col("doc_id") % 50, F.col("doc_id") % 50),
                      F.when(~F.contains("text", F.lit("the")), F.lit("the")))
    rows = docs.withColumn("p", F.when(F.col("doc_id") % 3 == 0, "").otherwise(made)).withColumn("_c", P.compose(F.col("p"), F.col("text")))
    return rows.select("doc_id", F.char_length("_c").cast("bigint").alias("n"), (P.decompose(F.col("p"), F.col("_c")) == F.col("text")).alias("same"), "p")


RULES = "concat(CASE WHEN doc_id % 2 = 0 THEN concat('- 1 ', text, chr(10), '_2 ') ELSE '' END, text)"


@query(rf"""SELECT doc_id, n::INT nth, seg FROM (SELECT doc_id, seg, row_number() OVER (PARTITION BY doc_id ORDER BY g) - 1 n FROM (SELECT doc_id, g, regexp_replace(string_agg(line, chr(10) ORDER BY pos), '^\s+|\s+$', '', 'g') seg FROM (
SELECT *, sum(CASE WHEN pos > 1 AND regexp_matches(line, '^\s*[-_]\s*[0-9]{{1,2}}\s') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) g FROM (
SELECT doc_id, unnest(string_split(b, chr(10))) line, generate_subscripts(string_split(b, chr(10)), 1) pos FROM (SELECT doc_id, {RULES} b FROM documents))) GROUP BY 1, 2) WHERE seg != '')""")
def split_segments(spark: SparkSession, d: str) -> DataFrame:
    segments = P.segments(F.expr(RULES))
    return table(spark, d, "documents").select("doc_id", F.posexplode(segments).alias("nth", "seg"))


def prose_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Pieces of each text's segments, packed by whole lines; pytest holds them against a plain version."""
    return table(spark, d, "documents").select("doc_id", F.posexplode(P.prose(F.expr(RULES))).alias("nth", "piece"))


query()(prose_chunks)


@query(_turns_sql(f"""list_sort(list_distinct(regexp_extract_all(translate(x, {DIGITS}), '[A-Za-z0-9]+'))) alnum, list_sort(list_distinct(regexp_extract_all(x, '\\[([0-9]+)\\]', 1))) citations,
list_sort(list_distinct(regexp_extract_all(x, '[ء-ي]+'))) arabic, len(regexp_extract_all(regexp_replace(x, '\\[[0-9]+\\]', ' ', 'g'), '[^\\s]+'))::INT n_words,
round(len(regexp_extract_all(x, '[ء-ي]'))::DOUBLE / greatest(len(regexp_extract_all(x, '\\p{{L}}')), 1), 6) arabic_fraction,
regexp_replace(translate(x, {DIGITS}), '[0-9]+', (CAST(regexp_extract(translate(x, {DIGITS}), '[0-9]+') AS HUGEINT) + 37)::VARCHAR) mutated, contains(x, 'c3') OR contains(x, 'nd') leaks"""))
def alnum_set(spark: SparkSession, d: str) -> DataFrame:
    """Sets of tokens, markers and words of a turn, and what is counted of it."""
    x = F.col("x")
    return turns(spark, d).select(
        "conv_id", "turn", F.sort_array(T.alnum_set(x)).alias("alnum"), F.sort_array(T.citation_set(x)).alias("citations"),
        F.sort_array(F.array_distinct(F.regexp_extract_all(x, F.lit("[ء-ي]+"), F.lit(0)))).alias("arabic"), P.content_words(x).alias("n_words"),
        F.round(P.arabic_fraction(x), 6).alias("arabic_fraction"), P.mutate_number(x).alias("mutated"), P.leaks(x, F.array(F.lit("c3"), F.lit("nd"))).alias("leaks"),
    )


SENT = "[" + ", ".join(f"'c{i}'" for i in range(1, 6)) + "]"
CITED = f"list_transform(list_filter(m, lambda i: i BETWEEN 1 AND 5), lambda i: {SENT}[i])"


@query(f"""SELECT conv_id, turn, array_to_string(l, ',') cited, array_to_string(list_transform(list_filter(m, lambda i: i < 1 OR i > 5), lambda i: i::VARCHAR), ',') invalid,
list_reduce(list_prepend(x, list_transform(range(1, len(l) + 1), lambda i: i::VARCHAR)), lambda a, i: replace(a, '[' || substr(l[i::INT], 2) || ']', '{{' || i || '}}')) renumbered
FROM (SELECT *, {FIRSTS.format(x="c")} l FROM (SELECT *, {CITED} c FROM (SELECT conv_id, turn, x, list_transform(regexp_extract_all(x, '\\[([0-9]+)\\]', 1), lambda v: v::INT) m FROM (SELECT *, {VARCHAR} x FROM conversations))))""")
def resolve_citations(spark: SparkSession, d: str) -> DataFrame:
    """Markers resolved to the ids that were sent, and shown by their place among the distinct ones (here in braces)."""
    sent = F.array(*[F.lit(f"c{i}") for i in range(1, 6)])
    got = turns(spark, d).withColumn("r", P.citations(F.col("x"), sent))
    return got.select("conv_id", "turn", F.array_join("r.cited", ",").alias("cited"), F.array_join("r.invalid", ",").alias("invalid"),
                      P.renumbered(F.col("x"), sent, F.col("r.cited"), "{", "}").alias("renumbered"))


@query("""SELECT conv_id, string_agg(concat('[', i, '] (c', turn, ')', chr(10), text), chr(10) || chr(10) ORDER BY turn) context, string_agg(concat('[', i, '] ', text), chr(10) || chr(10) ORDER BY turn) judged
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) i FROM conversations) GROUP BY 1""")
def render_context(spark: SparkSession, d: str) -> DataFrame:
    """What a model is shown: numbered blocks of a question's chunks (here a conversation's turns), with and without ids."""
    return P.rendered(table(spark, d, "conversations").select("conv_id", "turn", F.concat(F.lit("c"), "turn").alias("chunk_id"), "text"), "conv_id", "turn")


@query("""SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'N/A' ELSE printf('%.3f', n_chars / 7.0::DOUBLE) END shown, concat_ws(chr(10), nullif(lang, 'de'), nullif(source, ''), 'x') joined,
CASE doc_id % 4 WHEN 0 THEN 'Direct' WHEN 1 THEN 'Basic RAG' WHEN 2 THEN 'Advanced RAG' ELSE 'other' END route FROM documents""")
def shown_values(spark: SparkSession, d: str) -> DataFrame:
    """Scores, routes and joined parts as reports show them."""
    route = F.element_at(F.array(*map(F.lit, ("simple", "basic_rag", "advanced_rag", "other"))), (F.col("doc_id") % 4 + 1).cast("int"))
    score = F.when(F.col("doc_id") % 5 != 0, F.col("n_chars") / 7.0)
    return table(spark, d, "documents").select("doc_id", P.score_text(score).alias("shown"), P.join_lines(F.nullif("lang", F.lit("de")), F.col("source"), F.lit("x")).alias("joined"), P.route_shown(route).alias("route"))
