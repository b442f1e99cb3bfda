"""Text functions as Column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The token class, letters that count as one in comparisons, digits, and code points that cleaning removes.
TOKEN = r"[ء-ي]+|[A-Za-z0-9]+"
SEATS, SEATS_AS = "أإآٱى", "ااااي"
ARABIC = r"[؀-ۿ]"
DIGITS, DIGITS_AS = "٠١٢٣٤٥٦٧٨٩", "0123456789"
MARKS = r"[\x{64B}-\x{65F}\x{670}\x{640}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2066}-\x{2069}\x{E000}-\x{F8FF}]"
EDGES = " \t:.،-_)("
GATE_EDGES = " \t.!,;:،؛-_)(\n"
LETTER = r"[\p{L}\p{N}_]"
# Function words, folded, and prefixes in the order in which they are tried.
STOPWORDS = (
    "من", "الي", "علي", "في", "مع", "عن", "قبل", "بعد", "خلال", "حسب", "لدي", "دون", "وفق", "بين", "عند",
    "ان", "التي", "الذي", "او", "اذا", "كما", "حيث", "الا", "انه", "هذا", "هذه", "ذلك", "لا", "لم", "لن", "ليس", "غير",
    "يتم", "بشكل", "ما", "هل",
)
CLITICS, STEM = ("وال", "بال", "كال", "فال", "ال", "و", "ب", "ك", "ف", "ل"), 3
# Greetings and closers, in both scripts.
GREETINGS = (
    "مرحبا", "مرحبا بك", "اهلا", "اهلا وسهلا", "اهلا وسهلا بك", "السلام عليكم", "السلام عليكم ورحمة الله وبركاته",
    "صباح الخير", "مساء الخير", "كيف حالك", "كيفك", "شلونك", "شكرا", "شكرا لك", "شكرا جزيلا", "تسلم", "تسلم ايدك",
    "يعطيك العافية", "الى اللقاء", "مع السلامة", "وداعا",
    "hi", "hello", "hey", "good morning", "good evening", "good afternoon", "how are you", "thanks", "thank you", "thanks a lot",
    "bye", "goodbye", "ok", "okay", "cool", "nice",
)
# Words that recognition misread, and what they are.
MISREADS = {
    "الإجداءات": "الإجراءات", "البديد": "البريد", "للبديد": "للبريد", "الصاددة": "الصادرة", "الخادجية": "الخارجية", "وادساله": "وارساله",
    "الدسمية": "الرسمية", "والدسائل": "والرسائل", "الصغيدة": "الصغيرة", "السديع": "السريع", "الديد": "البريد", "البيد": "البريد",
    "الواد": "الوارد", "الصغدرة": "الصغيرة", "امنفذ": "المنفذ", "املفات": "الملفات", "للفات": "لملفات", "الستلم": "المستلم",
    "لحتوبات": "المحتويات", "لجد": "الجرد", "لتعامل": "التعامل", "لللحلية": "المحلية", "ايوميا": "يوميا", "شعدبا": "شهريا",
    "متابعتا": "متابعة", "علميات": "عمليات", "الجعات": "الجهات", "النماذ": "النماذج", "البيدمن": "البريد من", "الوادمن": "الوارد من",
    "إجدءات": "إجراءات", "لوجودات": "الموجودات", "الستودعات": "المستودعات",
}
GENERIC = ("and", "the", "of", "for", "unit", "tasks", "procedures", "manual", "operation", "operations")
PLAIN, STOPPED, STRIPPED = "plain", "stopwords", "clitics"

# Fixed values of the quality gate: Arabic with its supplement and what lies between, and all that is on script: ASCII, Arabic, white space, usual marks.
ARABIC_ALL = r"[\x{600}-\x{6FF}\x{750}-\x{77F}]"
ARABIC_WORD = r"[\x{600}-\x{77F}]+"
SPACES = r"\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
FOREIGN = rf"[^\x{{0}}-\x{{7F}}\x{{600}}-\x{{6FF}}\x{{750}}-\x{{77F}}{SPACES}\x{{2013}}\x{{2014}}\x{{2022}}\x{{2026}}\x{{AB}}\x{{BB}}\x{{201C}}\x{{201D}}\x{{2018}}\x{{2019}}\x{{B0}}\x{{B1}}\x{{D7}}\x{{F7}}\x{{A7}}\x{{B6}}]"


def let(value: Column, body) -> Column:
    """body(value), with value worked out once however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fold_letters(text: Column) -> Column:
    """Letters that comparisons don't tell apart; never for what is stored."""
    return F.translate(text, SEATS, SEATS_AS)


def fold_digits(text: Column) -> Column:
    return F.translate(text, DIGITS, DIGITS_AS)


def trimmed(text: Column, edges: str) -> Column:
    return F.btrim(text, F.lit(edges))


def label_key(cell: Column) -> Column:
    return F.btrim(trimmed(fold_letters(cell), EDGES), F.lit(" \t\r\n"))


def anchor_key(text: Column) -> Column:
    return F.regexp_replace(trimmed(fold_letters(text), EDGES), r"\s+", "")


def gate_key(text: Column) -> Column:
    return F.lower(trimmed(fold_letters(text), GATE_EDGES))


def strip_clitics(token: Column) -> Column:
    """The token without the first prefix that leaves STEM letters."""
    out = F.lit(None).cast("string")
    for p in reversed(CLITICS):
        out = F.when(token.startswith(p) & (F.char_length(token) - len(p) >= STEM), F.substring(token, len(p) + 1, 2**31 - 1)).otherwise(out)
    return F.coalesce(out, token)


def tokens(text: Column, level: str = PLAIN) -> Column:
    """Runs of Arabic letters and of Latin letters and digits, folded; without function words; without prefixes."""
    plain = F.regexp_extract_all(fold_digits(fold_letters(text)), F.lit(TOKEN), F.lit(0))
    if level == PLAIN:
        return plain
    stop = F.array(*map(F.lit, STOPWORDS))
    # tokens of other scripts are told by their first letter, before any list is searched
    arabic = lambda t: t >= "ء"
    kept = F.filter(plain, lambda t: ~arabic(t) | ~F.array_contains(stop, t))
    return kept if level == STOPPED else F.transform(kept, lambda t: F.when(arabic(t), strip_clitics(t)).otherwise(t))


def strip_marks(text: Column) -> Column:
    return F.regexp_replace(text, MARKS, "")


#: Beyond characters that composition neither changes nor joins, whatever stands beside them: ASCII, Arabic letters, digits and three marks.
COMPOSED = r"[^\x00-\x7F\x{60C}\x{61B}\x{61F}\x{621}-\x{63A}\x{641}-\x{64A}\x{660}-\x{669}]"


@F.pandas_udf(StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def nfkc(text: Column) -> Column:
    """Compatibility composition; only texts beyond COMPOSED's characters are sent to Python, as no built-in function has it."""
    wide = text.rlike(COMPOSED)
    return F.when(wide, _nfkc(F.when(wide, text))).otherwise(text)


def clean(text: Column) -> Column:
    """Line ends made one, code points deleted, dot leaders and runs of blanks shrunk, words joined that a line end parted, ends trimmed; after nfkc()."""
    out = strip_marks(F.regexp_replace(text, r"\r\n?", "\n"))
    out = F.regexp_replace(out, r"[.…]{4,}", " ")
    out = F.regexp_replace(out, rf"({LETTER})-\n({LETTER})", "$1$2")
    out = F.regexp_replace(out, r"[ \t]+", " ")
    out = F.regexp_replace(out, r" *\n *", "\n")
    return F.regexp_replace(F.regexp_replace(out, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def correct_misreads(text: Column) -> Column:
    """Whole words of MISREADS replaced, in one pass; a mark that stands for a blank becomes one; blanks shrink.

    Pieces between Arabic runs stay; each run is looked up whole, so no key is found inside a longer word."""
    table = F.create_map(*[F.lit(x) for pair in MISREADS.items() for x in pair])
    parts = F.regexp_extract_all(text, F.lit(f"{ARABIC}+|[^؀-ۿ]+"), F.lit(0))
    out = F.array_join(F.transform(parts, lambda p: F.coalesce(F.try_element_at(table, p), p)), "")
    return F.regexp_replace(F.regexp_replace(out, r"(?<=\s)_(?=[\s؀-ۿ])", " "), r"[ \t]+", " ")


def slug(source: Column, words: int = 2) -> Column:
    parts = F.filter(F.split(F.lower(F.regexp_replace(source, r"\.[^.]*$", "")), "[^a-z0-9]+"), lambda w: (w != "") & ~w.isin(*GENERIC))
    return F.coalesce(F.nullif(F.array_join(F.slice(parts, 1, words), "_"), F.lit("")), F.lit("doc"))


def share(text: Column, pattern: str) -> Column:
    """The part of the characters that match pattern; 0 for an empty text."""
    n = F.char_length(text)
    return F.when(n == 0, 0.0).otherwise((n - F.char_length(F.regexp_replace(text, pattern, ""))) / n)


def assessed(text: Column) -> Column:
    """struct<arabic_ratio, off_script_ratio, fragment_ratio, replacement_chars, verdict> over the whole text, to six places.

    degraded: a U+FFFD or over 1 % off script; suspicious: over 200 characters, under 10 % of them Arabic. Fragments are reported only."""
    t = F.coalesce(text, F.lit(""))
    words = F.regexp_extract_all(t, F.lit(ARABIC_WORD), F.lit(0))
    short = F.size(F.filter(words, lambda w: F.char_length(w) <= 2))
    arabic, off, bad = share(t, ARABIC_ALL), share(t, FOREIGN), (F.char_length(t) - F.char_length(F.regexp_replace(t, r"\x{FFFD}", ""))).cast("bigint")
    told = (
        F.when(t == "", "empty").when((bad > 0) | (off > 0.01), "degraded")
        .when((arabic < 0.1) & (F.char_length(t) > 200), "suspicious").otherwise("ok")
    )
    return F.struct(
        F.round(arabic, 6).alias("arabic_ratio"), F.round(off, 6).alias("off_script_ratio"),
        F.round(F.when(F.size(words) >= 20, short / F.size(words)).otherwise(0.0), 6).alias("fragment_ratio"),
        bad.alias("replacement_chars"), told.alias("verdict"),
    )


def squeezed(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"\s+", " "), "^ | $", "")


def sentences(text: Column) -> Column:
    """Pieces between marks with three words or more."""
    pieces = F.transform(F.split(text, "[.!؟]+"), squeezed)
    return F.filter(pieces, lambda s: F.size(F.split(s, " ")) >= 3)


def alnum_set(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(fold_digits(text), F.lit("[A-Za-z0-9]+"), F.lit(0)))


def citation_set(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"\[([0-9]+)\]"), F.lit(1)))


def median(sorted_values: Column) -> Column:
    """Of a sorted array: the middle, or the mean of the middle two."""
    n = F.size(sorted_values)
    at = lambda i: F.get(sorted_values, i.cast("int"))
    return (at(F.floor((n - 1) / 2)) + at(F.floor(n / 2))) / 2
