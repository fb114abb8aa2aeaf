"""Personal data: regular expressions propose, checksums confirm, context scores.

Everything is DataFrame functions, row by row and without a shuffle. A pattern's
matches and the text between them (``regexp_extract_all`` and ``split``) are folded
into code-point offsets. Patterns that could backtrack over long runs are written with
possessive loops and look-behinds, which leaves their matches as they are and their
cost linear in the text.

The base kinds (email, ip, card, phone) are kept when their check passes: octets, the
Luhn sum, digit counts. The method adds card numbers that stand as whole digit groups
inside longer runs of digits, and IBANs by mod-97, in one run or in printed groups of four. Every span starts at its kind's
prior, gains by a checksum and by a context word shortly before it; added spans under
``min_score`` are dropped, base spans always stay. One in ten digit groups passes the Luhn sum by chance, so an added card
is kept only where a context word stands before it; mod-97 is enough for an IBAN.

Defined results: null and empty texts have no spans; kinds may overlap each other; equal texts have equal spans, and repeated rows
each have theirs; whole texts are read, however long; an empty table has an empty result. Columns added on the way take names
that are free; an input column with the name asked for the spans is replaced, all others pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.llm.common import text_of

KINDS = ("email", "ip", "card", "phone", "iban")

#: Fixed patterns, in the form of Java's engine.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?+[0-9]){12,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "group": r"(?<![0-9])[0-9]{13,19}+(?![0-9])",
    "iban": r"(?<![A-Za-z0-9_])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9_])",
}
#: What a text must have for a pattern to be tried.
NEEDS = {"email": "@", "ip": ".", "phone": "+"}

#: Fixed words that raise a kind's score when they stand before it.
CONTEXT = {
    "email": "mail|contact|write to",
    "ip": "ip|host|server|address",
    "card": "card|visa|mastercard|amex|payment|credit",
    "phone": "phone|tel|call|mobile|fax",
    "iban": "iban|account|bank|transfer",
}
PRIOR = {"email": 0.7, "ip": 0.6, "card": 0.5, "phone": 0.6, "iban": 0.5}
#: Of an added card number.
WEAK, CHECKED, NEAR, WINDOW = 0.35, 0.3, 0.1, 40


def matches(text: Column, pattern: str) -> Column:
    """array<struct<start, end, value>> of all matches, in code points, end exclusive."""
    steps = F.zip_with(
        F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda gap, m: F.struct(F.length(gap).cast("long").alias("gap"), m.alias("value"))
    )
    none = F.expr("cast(array() as array<struct<start: bigint, end: bigint, value: string>>)")

    def add(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + F.length(x["value"])
        span = F.struct(start.alias("start"), end.alias("end"), x["value"].alias("value"))
        return F.when(x["value"].isNull(), acc).otherwise(F.struct(end.alias("at"), F.concat(acc["out"], F.array(span)).alias("out")))

    found = F.aggregate(steps, F.struct(F.lit(0).cast("long").alias("at"), none.alias("out")), add)["out"]
    # Most texts have no match at all; one scan tells.
    return F.when(F.length(text) == 0, none).when(text.rlike(pattern), found).otherwise(none)


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """Whether the digits pass the Luhn sum; value has at least one digit."""
    digits = F.reverse(digits_of(value))

    def add(acc: Column, i: Column) -> Column:
        d = F.substr(digits, i, F.lit(1)).cast("int")
        return acc + F.when(i % 2 == 1, d).when(d < 5, d * 2).otherwise(d * 2 - 9)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def mod97(value: Column) -> Column:
    """Whether an IBAN's check digits hold: moved to the end, letters as 10 to 35, the remainder by 97 is 1; spaces do not count."""
    value = F.replace(value, F.lit(" "), F.lit(""))
    moved = F.concat(F.substr(value, F.lit(5)), F.substr(value, F.lit(1), F.lit(4)))

    def add(acc: Column, i: Column) -> Column:
        c = F.ascii(F.substr(moved, i, F.lit(1)))
        return F.when(c >= 65, (acc * 100 + c - 55) % 97).otherwise((acc * 10 + c - 48) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(moved)), F.lit(0), add) == 1


def octets(value: Column) -> Column:
    def small(part: Column) -> Column:
        bare = F.regexp_replace(part, "^0+", "")
        return (F.length(bare) < 3) | ((F.length(bare) == 3) & (bare <= "255"))

    return F.forall(F.split(value, r"\."), small)


def find_pii(df: DataFrame, text: str = "text", min_score: float = 0.7, spans: str = "pii_spans") -> DataFrame:
    """Add the spans: array<struct<kind, start, end, base, score>>, by kind as listed, then by start."""
    t = text_of(F.col(text))
    found = {k: F.when(F.contains(t, F.lit(NEEDS[k])), matches(t, p)).otherwise(F.expr("cast(array() as array<struct<start: bigint, end: bigint, value: string>>)")) if k in NEEDS else matches(t, p) for k, p in PATTERNS.items()}
    n_digits = lambda x: F.length(digits_of(x["value"]))
    kept = {
        "email": found["email"],
        "ip": F.filter(found["ip"], lambda x: octets(x["value"])),
        "card": F.filter(found["card"], lambda x: luhn(x["value"])),
        "phone": F.filter(found["phone"], lambda x: n_digits(x).between(9, 15)),
        "group": F.filter(found["group"], lambda x: luhn(x["value"])),
        "iban": F.filter(found["iban"], lambda x: mod97(x["value"])),
    }
    names = {k: f"_{spans}_{k}" for k in kept}
    while set(names.values()) & set(df.columns):
        names = {k: f"_{n}" for k, n in names.items()}
    staged = df.withColumns({names[k]: c for k, c in kept.items()})

    def scored(kind: str, source: str, base: bool) -> Column:
        def one(x: Column) -> Column:
            before = F.substr(t, F.greatest(x["start"] - WINDOW, F.lit(0)).cast("int") + 1, F.least(x["start"], F.lit(WINDOW)).cast("int"))
            near = F.lower(before).rlike(rf"(?<![A-Za-z0-9_])(?:{CONTEXT[kind]})(?![A-Za-z0-9_])")
            score = F.lit((PRIOR[kind] if base or kind != "card" else WEAK) + (CHECKED if kind in ("card", "iban") else 0.0)) + F.when(near, F.lit(NEAR)).otherwise(F.lit(0.0))
            return F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), F.lit(base).alias("base"), F.round(score, 2).alias("score"))

        out = F.transform(F.col(names[source]), one)
        return out if base else F.filter(out, lambda s: s["score"] >= min_score)

    added = F.filter(scored("card", "group", False), lambda s: ~F.exists(F.col(names["card"]), lambda c: (c["start"] < s["end"]) & (s["start"] < c["end"])))
    cards = F.array_sort(F.concat(scored("card", "card", True), added), lambda a, b: (a["start"] - b["start"]).cast("int"))
    all_spans = F.concat(scored("email", "email", True), scored("ip", "ip", True), cards, scored("phone", "phone", True), scored("iban", "iban", False))
    return staged.withColumn(spans, all_spans).drop(*names.values())


def redact(df: DataFrame, text: str = "text", spans: str = "pii_spans") -> DataFrame:
    """Put ``[KIND]`` in place of every span; of overlapping spans, the earlier (then longer) names the whole run."""
    t = F.col(text)
    order = F.array_sort(F.col(spans), lambda a, b: F.when(a["start"] != b["start"], (a["start"] - b["start"]).cast("int")).otherwise((b["end"] - a["end"]).cast("int")))

    def add(acc: Column, s: Column) -> Column:
        gap = F.substr(t, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        joined = F.struct(s["end"].alias("at"), F.concat(acc["out"], F.array(gap, F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))).alias("out"))
        longer = F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out"))
        return F.when((s["start"] < acc["at"]) & (F.size(acc["out"]) > 0), longer).otherwise(joined)

    start = F.struct(F.lit(0).cast("long").alias("at"), F.expr("cast(array() as array<string>)").alias("out"))
    done = F.aggregate(order, start, add, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substr(t, (acc["at"] + 1).cast("int"))))
    return df.withColumn(text, F.when(F.size(F.col(spans)) > 0, done).otherwise(t))


def joined(spans: Column) -> Column:
    """kind:start:end of all spans, by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
