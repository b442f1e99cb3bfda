"""Personal data: labelers vote on candidate spans, EM weighs them, a span classifier decides.

Candidates of every kind come from patterns. Matches of the four base kinds (email, ip, card, phone) that
pass their test always stay. Wider patterns propose further spans: bracketed e-mail addresses, phone
numbers without a plus, social security and account numbers, names, hardware and long network addresses, dates of birth and
street addresses. Five labelers vote yes, no or nothing on each candidate: strict format, gazetteer, structure, context
before, and context against. Counts of vote patterns (at most 3^5 for each kind, whatever the data) go to the driver, where
expectation-maximisation estimates how reliable each labeler is, and how often each kind is real, without any label and
over all candidates, base ones among them. The posteriors then train a
logistic classifier on the span's own form and surroundings, also from counts, and it decides on each wider span.

Everything that touches rows is a built-in function. Null and empty texts have no spans; repeated rows are
treated alike; other columns stay, and clashing ones named `spans` are replaced.
"""

from __future__ import annotations

import math
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, text_of
from .spans import digits, found, luhn, told

BASE = ("email", "ip", "card", "phone")
# The base patterns. Possessive quantifiers change no match (no backtracking could succeed);
# the look-behinds only skip starts inside a run that a longer match would have begun earlier.
LOCAL = "A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
GATES = {"email": "@", "phone": "+"}
# The gazetteers, of four languages.
TITLES = "Mr|Mrs|Ms|Miss|Dr|Prof|Herr|Frau|Señora|Señor|Sra|Sr|Monsieur|Madame|Mme"
NAMES = (
    "James|Mary|John|Patricia|Robert|Jennifer|Michael|Linda|William|Elizabeth|David|Barbara|Richard|Susan|Joseph|Jessica|Thomas|Sarah|"
    "Charles|Karen|Christopher|Nancy|Daniel|Lisa|Matthew|Margaret|Anthony|Sandra|Steven|Ashley|Andrew|Emily|Paul|Donna|Joshua|Michelle|"
    "Hans|Klaus|Jürgen|Wolfgang|Dieter|Uwe|Stefan|Andreas|Matthias|Anna|Ursula|Monika|Petra|Sabine|Renate|Heike|Katrin|Birgit|"
    "Jean|Pierre|Michel|André|Philippe|René|Louis|Alain|Jacques|Marie|Jeanne|Françoise|Monique|Catherine|Nathalie|Isabelle|Sylvie|Camille|"
    "José|Jose|Antonio|Juan|Manuel|Francisco|Luis|Javier|Carlos|Miguel|Alejandro|María|Maria|Carmen|Josefa|Isabel|Dolores|Pilar|Teresa|Lucía"
)
NOT_NAMES = "Monday|Tuesday|Wednesday|Thursday|Friday|Saturday|Sunday|January|February|March|April|June|July|August|September|October|November|December|Street|Road|Avenue|Tower|Bridge|Airport|Station|Hospital|University|College|School|Museum|Stadium|Park|Prize|Award|Company|Inc|Ltd|Corp|GmbH|Hotel"
BORN = "born|birth|birthday|birthdate|dob|geboren|geburtsdatum|nacid[oa]|nacimiento|né|née|naissance"
ROADS_AFTER = "straße|strasse|weg|platz|allee|gasse|ring"
ROADS_LAST = "Street|Avenue|Road|Lane|Drive|Boulevard|Court|Square|St|Ave|Rd|Ln|Blvd"
ROADS_FIRST = "Calle|Avenida|Plaza|Paseo|Rue|rue|Boulevard|Place"
# Wider patterns, cheap tests that every text with a match passes, word lists of the labelers.
WIDER = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?[\[(](?:at|AT)[\])] ?[A-Za-z0-9-]++(?: ?(?:\.|[\[(](?:dot|DOT)[\])]) ?[A-Za-z0-9-]++)++",
    "phone": r"(?<![0-9A-Za-z+./-])(?<![A-Z]{2}[0-9]{2} )(?![0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])|[0-9]{1,2}[.-][0-9]{1,2}[.-][0-9]{4}(?![0-9]))(?:\([0-9]{2,4}\) ?|[0-9]{2,4}[ .-])(?:[0-9]{2,4}[ .-]){1,3}[0-9]{2,4}(?![0-9A-Za-z.-])",
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "person": rf"(?<![A-Za-z])(?=[A-ZÀ-Þ][a-zà-ÿ]*+\.? [A-Z])(?:(?:{TITLES})\.? [A-Z][a-zà-ÿ]++(?: [A-Z][a-zà-ÿ]++)?|(?:{NAMES}) [A-Z][a-zà-ÿ]++)",
    "ipv6": r"(?<![0-9A-Za-z:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![0-9A-Za-z:])",
    "mac": r"(?<![0-9A-Za-z:-])[0-9A-Fa-f]{2}([:-])(?:[0-9A-Fa-f]{2}\1){4}[0-9A-Fa-f]{2}(?![0-9A-Za-z:-])",
    "birth": rf"(?<=(?i:{BORN})[^\n0-9A-Z]{{1,16}})[0-9]{{1,2}}[./-][0-9]{{1,2}}[./-][0-9]{{4}}(?![0-9])",
    "street": rf"(?<![A-Za-z0-9])(?:[A-ZÄÖÜ][a-zäöüß]++(?<=(?:{ROADS_AFTER})) [0-9]{{1,4}}[a-z]?|[0-9]{{1,5}} (?:[A-Z][a-z]++ ){{1,2}}(?:{ROADS_LAST})(?![a-z])|(?=[A-Zr])(?:{ROADS_FIRST}) (?:de (?:la |los )?)?[A-Z][a-zà-ÿ]++,? [0-9]{{1,4}})(?![A-Za-z0-9])",
}
WIDER_GATES = {
    "email": r"[\[(](?:at|AT)[\])]",
    "phone": r"[0-9][ .)-]",
    "ssn": r"[0-9]-[0-9]{2}-[0-9]",
    "iban": r"[A-Z]{2}[0-9]{2}",
    "person": r"[A-ZÀ-Þ][a-zà-ÿ]*+\.? [A-Z]",
    "ipv6": r"[0-9A-Fa-f]:(?:[0-9A-Fa-f]{0,4}:)",
    "mac": r"[0-9A-Fa-f]{2}[:-][0-9A-Fa-f]{2}[:-]",
    "birth": r"[./-][0-9]{1,2}[./-][0-9]{4}",
    "street": r"[a-zà-ÿ],? [0-9]|[0-9] [A-Z]",
}
KINDS = (*BASE, *[k for k in WIDER if k not in BASE])
FOR = r"(?i)(?:call|phone|write|schreib|tel|telefon|mobile|fax|e-?mail|mail|contact|reach|ssn|social|iban|account|konto|card|visa|name|dear|signed|from|ip|host|address|server|mac|router|device|born|birth|dob|geboren|nacid[oa]|née?|lives|live|at|residence|wohnt|vive|habite)[^\n]{0,24}$"
AGAINST = r"(?i)(?:version|v|isbn|issn|doi|order|invoice|ticket|part|page|pp?\.|section|§|no\.|nr\.|#|\$|€|=)\s*$"
DOMAINS = r"(?i)(?:com|org|net|edu|gov|io|info|biz|app|dev|de|fr|es|uk|eu|ch|at|it|nl|be|pl|pt|se|dk|no|fi|ie|us|ca|mx|ar|br|au|nz|in|jp|cn|za)$"
COUNTRIES = r"^(?:AD|AE|AT|BE|BG|CH|CY|CZ|DE|DK|EE|ES|FI|FR|GB|GR|HR|HU|IE|IS|IT|LI|LT|LU|LV|MC|MT|NL|NO|PL|PT|RO|SE|SI|SK|SM|TR)"
CONTEXT = 40


def _ip(hit: Column) -> Column:
    ok = lambda part: F.regexp_replace(part, "^0+(?=[0-9])", "")
    fits = lambda p: (F.char_length(p) < 3) | ((F.char_length(p) == 3) & (p <= "255"))
    return F.forall(F.split(hit, r"\."), lambda p: fits(ok(p)))


def _fits(kind: str, hit: Column) -> Column:
    n = F.char_length(digits(hit))
    if kind == "ip":
        return _ip(hit)
    if kind == "card":
        # the lengths first: luhn() then sees 19 digits at most
        return F.when(n.between(13, 19), luhn(digits(hit))).otherwise(F.lit(False))
    return n.between(9, 15) if kind == "phone" else F.lit(True)


def base_spans(text: Column, kind: str) -> Column:
    """The base matches of a kind that pass its test, in order of their start."""
    gate = F.contains(text, F.lit(GATES[kind])) if kind in GATES else text.rlike(r"[0-9][0-9 .-][0-9]")
    if kind == "ip":
        gate = text.rlike(r"[0-9]\.[0-9]++\.[0-9]")
    return F.filter(found(text, PATTERNS[kind], gate), lambda s: _fits(kind, s["hit"]))


def _checked(hit: Column) -> Column:
    """Whether an account number's digits leave 1 when divided by 97, its first four characters moved to the end."""
    flat = F.regexp_replace(hit, " ", "")
    turned = F.split(F.concat(F.substring(flat, 5, 40), F.substring(flat, 1, 4)), "")
    step = lambda left, c: (left * F.when(c >= "A", 100).otherwise(10) + F.when(c >= "A", F.ascii(c) - 55).otherwise(F.ascii(c) - 48)) % 97
    return F.aggregate(F.filter(turned, lambda c: c != ""), F.lit(0), lambda left, c: step(left, c).cast("int")) == 1


def _votes(kind: str, hit: Column, before: Column) -> list[Column]:
    """1, -1 or 0 of each labeler."""
    vote = lambda yes, no: F.when(yes, 1).when(no, -1).otherwise(0)
    nothing, d = F.lit(False), digits(hit)
    same = d.rlike(r"^([0-9])\1*$")
    strict = {
        "email": vote(hit.rlike(r"^[A-Za-z0-9._%+-]{2,64}(?:@| ?[\[(])"), hit.rlike(r"^[._%+-]")),
        "ip": vote(hit.rlike(r"^[1-9][0-9]{0,2}\."), hit.rlike(r"^0")),
        "card": vote(hit.rlike(r"^[3-6]"), hit.rlike(r"^0")),
        "phone": vote(hit.rlike(r"^\+[1-9]|^\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}$"), hit.rlike(r"\. ?[0-9]+\.")),
        "ssn": vote(hit.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), nothing),
        "iban": vote(hit.rlike(r"^[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}"), nothing),
        "person": vote(hit.rlike(r"[A-Z][a-zà-ÿ]+ [A-Z][a-zà-ÿ]+$"), hit.rlike(r" [A-Z][a-z]?$")),
        "ipv6": vote(hit.rlike(r"^(?:[0-9A-Fa-f]+:){3}|::[0-9A-Fa-f]"), ~hit.rlike(r"[0-9A-Fa-f]{3}")),
        "mac": vote(hit.rlike(r"^(?:[0-9a-f:-]+|[0-9A-F:-]+)$"), nothing),
        "birth": vote(hit.rlike(r"^(?:0?[1-9]|[12][0-9]|3[01])[./-](?:0?[1-9]|[12][0-9]|3[01])[./-](?:19|20)"), hit.rlike(r"^0{1,2}[./-]|^[4-9][0-9]|^3[2-9]")),
        "street": vote(hit.rlike(r"[0-9]{1,4}[a-z]?$|^[0-9]{1,4} "), hit.rlike(r"^0|(?<![0-9])0[a-z]?$")),
    }[kind]
    gazetteer = {
        "email": vote(hit.rlike(DOMAINS), hit.rlike(r"(?i)(?:png|jpe?g|gif|js|css)$")),
        "iban": vote(hit.rlike(COUNTRIES), ~hit.rlike(COUNTRIES)),
        "person": vote(hit.rlike(rf"(?:^| )(?:{NAMES})(?: |$)") & ~hit.rlike(rf" (?:{NOT_NAMES})$"), hit.rlike(rf" (?:{NOT_NAMES})$")),
        "street": vote(~hit.rlike(rf"(?:{NOT_NAMES}) (?:{ROADS_LAST})$") | hit.rlike(rf"^[0-9]+ [A-Z][a-z]+ (?:{ROADS_LAST})$"), nothing),
        "phone": vote(hit.rlike(r"^\+(?:1|33|34|39|41|43|44|49)(?![0-9]{14})"), nothing),
    }.get(kind, F.lit(0))
    structure = {
        "email": vote(hit.rlike(r"^[A-Za-z0-9][^@]* ?[\[(@]") & ~hit.rlike(r"\.\."), hit.rlike(r"^[._%+-]|\.\.")),
        "card": vote(~same, same),
        "phone": vote(F.char_length(d).between(9, 15) & ~same, ~F.char_length(d).between(9, 15) | same),
        "ssn": vote(~hit.rlike(r"^(?:000|666|9)|-00-|-0000$"), hit.rlike(r"^(?:000|666|9)|-00-|-0000$")),
        "iban": vote(_checked(hit), ~_checked(hit)),
        "ipv6": vote(hit.rlike(r"[1-9a-fA-F]"), ~hit.rlike(r"[1-9a-fA-F]")),
        "mac": vote(~hit.rlike(r"^(..)(?:[:-]\1){5}$"), hit.rlike(r"^(..)(?:[:-]\1){5}$")),
        "birth": vote(hit.rlike(r"(?:19[0-9]{2}|200[0-9]|201[0-9])$"), ~hit.rlike(r"(?:19|20)[0-9]{2}$")),
        "street": vote(hit.rlike(r"[1-9]"), ~hit.rlike(r"[1-9]")),
    }.get(kind, F.lit(0))
    return [strict, gazetteer, structure, vote(before.rlike(FOR), nothing), vote(nothing, before.rlike(AGAINST))]


def _described(text: Column, kind: str, spans: Column, base: bool) -> Column:
    def one(s: Column) -> Column:
        before = F.substring(text, F.greatest(s["start"] - CONTEXT, F.lit(0)).cast("int") + 1,
                             F.least(s["start"], F.lit(CONTEXT)).cast("int"))
        size = F.least(F.lit(3), F.floor(F.char_length(s["hit"]) / 8)).cast("int")
        return let(
            before,
            lambda b: F.struct(
                F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.lit(base).alias("base"),
                *[v.cast("int").alias(f"v{i}") for i, v in enumerate(_votes(kind, s["hit"], b))],
                size.alias("size"), b.rlike(r"[:=] ?$").cast("int").alias("led"),
                s["hit"].rlike("[a-z]").cast("int").alias("lower"),
            ),
        )

    return F.transform(spans, one)


FEATURES = ("size", "led", "lower", *[f"v{i}" for i in range(5)])


def candidates(text: Column) -> Column:
    """All candidates with their votes: base kinds as listed, then the wider ones, each by start."""
    base = [_described(text, k, base_spans(text, k), True) for k in BASE]
    more = [_described(text, k, found(text, p, text.rlike(WIDER_GATES[k])), False) for k, p in WIDER.items()]
    return F.concat(*base, *more)


#: The expression has thousands of parts, each a call to the JVM: it is made once for an application and column.
_EXPRESSIONS: dict[tuple[str, str], Column] = {}


def _candidates_of(df: DataFrame, text: str) -> Column:
    key = (df.sparkSession.sparkContext.applicationId, text)
    if key not in _EXPRESSIONS:
        _EXPRESSIONS.clear()
        _EXPRESSIONS[key] = candidates(text_of(text))
    return _EXPRESSIONS[key]


def fit(df: DataFrame, text: str = "text", rounds: int = 30) -> dict[tuple, float]:
    """Weights of the final classifier, learnt without labels from every candidate of df.

    What is collected are counts by kind, votes and features: at most 11 * 3^5 * 4 * 2 * 2 rows at any size."""
    keys = ["kind", "base", *[f"v{i}" for i in range(5)], "size", "led", "lower"]
    seen = df.select(F.inline(_candidates_of(df, text))).groupBy(*keys).agg(F.count("*").alias("n")).collect()
    return learn([r.asDict() for r in sorted(seen, key=lambda r: tuple(map(str, r)))], rounds)


def learn(rows: list[dict], rounds: int) -> dict[tuple, float]:
    votes = [[r[f"v{i}"] for i in range(5)] for r in rows]
    # reliability starts above chance; base candidates passed their test, so they begin as real
    post = [0.95 if r["base"] else 1 / (1 + math.exp(-1.2 * sum(v))) for r, v in zip(rows, votes)]
    clip = lambda p: min(max(p, 1e-4), 1 - 1e-4)
    for _ in range(rounds):
        total = {k: [4.0, 2.0] for k in KINDS}
        right = [[[2.0, 1.0, 2.0], [2.0, 1.0, 2.0]] for _ in range(5)]  # of each labeler and class: no, nothing, yes
        for i in range(5):
            right[i][1][2] += 6.0
            right[i][0][0] += 6.0
        for r, v, p in zip(rows, votes, post):
            total[r["kind"]][0] += r["n"]
            total[r["kind"]][1] += r["n"] * p
            for i in range(5):
                right[i][1][v[i] + 1] += r["n"] * p
                right[i][0][v[i] + 1] += r["n"] * (1 - p)
        chance = [[[x / sum(c) for x in c] for c in lab] for lab in right]
        fresh = []
        for r, v in zip(rows, votes):
            prior = clip(total[r["kind"]][1] / total[r["kind"]][0])
            log = math.log(prior / (1 - prior)) + sum(
                math.log(chance[i][1][x + 1] / chance[i][0][x + 1]) for i, x in enumerate(v)
            )
            fresh.append(1 / (1 + math.exp(-max(-30.0, min(30.0, log)))))
        post = fresh
    weights = {("kind", k): 0.0 for k in KINDS}
    weighed = [([("kind", r["kind"]), *[(f, f"{r['kind']}:{r[f]}") for f in FEATURES]], r["n"], p) for r, p in zip(rows, post)]
    whole = sum(n for _, n, _ in weighed) or 1
    for _ in range(200):
        step: dict[tuple, float] = {}
        for names, n, p in weighed:
            score = sum(weights.get(x, 0.0) for x in names)
            miss = (p - 1 / (1 + math.exp(-max(-30.0, min(30.0, score))))) * n / whole
            for x in names:
                step[x] = step.get(x, 0.0) + miss
        for x, g in step.items():
            weights[x] = weights.get(x, 0.0) + 4.0 * (g - 1e-4 * weights.get(x, 0.0))
    return weights


def _score(weights: dict[tuple, float], c: Column) -> Column:
    total = F.lit(0.0)
    for f in ("kind", *FEATURES):
        own = {k[1]: w for k, w in sorted(weights.items(), key=str) if k[0] == f}
        if own:
            table = F.create_map(*chain.from_iterable((F.lit(k), F.lit(round(w, 9))) for k, w in own.items()))
            key = c["kind"] if f == "kind" else F.concat(c["kind"], F.lit(":"), c[f].cast("string"))
            total = total + F.coalesce(F.try_element_at(table, key), F.lit(0.0))
    return total


def annotate(df: DataFrame, weights: dict[tuple, float], text: str = "text") -> DataFrame:
    """Adds spans: array<struct<kind, start, end, base>>, by kind as listed in KINDS and then start.

    A wider span is kept if the classifier gives it at least one half and no base span touches it."""
    made = df.drop("spans").withColumn("spans", _candidates_of(df, text))
    base = F.filter("spans", lambda s: s["base"])
    more = F.filter("spans", lambda s: ~s["base"] & (_score(weights, s) >= 0))
    touches = lambda s, b: (s["start"] < b["end"]) & (b["start"] < s["end"])
    free = let(F.struct(base.alias("b"), more.alias("m")),
               lambda p: F.concat(p["b"], F.filter(p["m"], lambda s: ~F.exists(p["b"], lambda b: touches(s, b)))))
    order = F.array(*map(F.lit, KINDS))
    slim = F.transform(
        free,
        lambda s: F.struct(F.array_position(order, s["kind"]).alias("place"), s["start"].alias("start"),
                           s["end"].alias("end"), s["kind"].alias("kind"), s["base"].alias("base")),
    )
    return made.withColumn(
        "spans",
        F.transform(F.array_sort(slim), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"),
                                                           s["end"].alias("end"), s["base"].alias("base"))),
    )


def redact(df: DataFrame, text: str = "text") -> DataFrame:
    """The text with each span of annotate()'s replaced by its kind in brackets; touching spans make one."""
    by_place = F.array_sort(
        F.transform("spans", lambda s: F.struct(s["start"].alias("a"), s["end"].alias("b"), s["kind"].alias("k")))
    )
    # a span inside or across an earlier one widens nothing: only what is beyond the furthest end so far stays text
    none = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))
    body = F.aggregate(
        by_place,
        none,
        lambda acc, s: F.struct(
            F.greatest(acc["at"], s["b"]).alias("at"),
            F.when(s["a"] < acc["at"], acc["out"])
            .otherwise(F.concat(acc["out"],
                                F.substring(F.col(text), acc["at"].cast("int") + 1, (s["a"] - acc["at"]).cast("int")),
                                F.concat(F.lit("["), F.upper(s["k"]), F.lit("]"))))
            .alias("out"),
        ),
        lambda acc: F.concat(acc["out"], F.substring(F.col(text), acc["at"].cast("int") + 1, F.lit(2**31 - 1))),
    )
    return df.withColumn(text, F.when(F.size("spans") > 0, body).otherwise(F.col(text)))


def digests(found_: DataFrame) -> DataFrame:
    """The counts and span lists of annotate()'s rows."""
    of = lambda k: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == k))).cast("bigint")
    return found_.select(
        "doc_id",
        *[of(k).alias(f"n_{k}") for k in BASE],
        F.sha2(told(F.filter("spans", lambda s: s["base"])), 256).alias("base_sha256"),
        told(F.col("spans")).alias("spans"),
    )
