"""Personal data in texts, in DataFrame functions only.

Regular expressions propose spans; their places are running sums of the lengths of matches and of the text between them. Checksums and ranges
confirm them: Luhn for card numbers, mod 97 for account numbers. Context words near a span raise its score.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds in their order of rank; patterns find the same spans as plain ones, without backtracking over long runs.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?=(?:[0-9][ -]?){14})[0-9]++(?:[ -][0-9]++)*+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}+(?![A-Za-z0-9])",
}
BASE = ("email", "ip", "card", "phone")
#: A text without this can't hold the kind.
NEEDS = {"email": "@", "ip": ".", "phone": "+"}
#: Score of a confirmed span, and what a context word within WINDOW code points adds.
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9}
BOOST, WINDOW = 0.2, 40
CONTEXT = {
    "email": r"\b(?:e-?mail|mail|contact|write|courriel|correo)\b",
    "ip": r"\b(?:ip|address|host|server|client|login)\b",
    "card": r"\b(?:card|credit|debit|visa|payment|karte|carte|tarjeta)\b",
    "phone": r"\b(?:phone|tel|call|mobile|fax|telefon|t[eé]l[eé]phone|tel[eé]fono)\b",
    "iban": r"\b(?:iban|account|bank|konto|compte|cuenta)\b",
}


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """Whether the digits of a value pass Luhn's check."""

    def part(x: Column, i: Column) -> Column:
        d = F.coalesce(x.try_cast("int"), F.lit(0))
        double = d * 2
        return F.when(i % 2 == 0, d).otherwise(F.when(double > 9, double - 9).otherwise(double))

    return F.aggregate(F.transform(F.split(F.reverse(digits(value)), ""), part), F.lit(0), lambda a, b: a + b) % 10 == 0


def mod97(value: Column) -> Column:
    """Whether an account number leaves 1 by 97, its first four characters last and letters as 10 to 35."""
    bare = F.regexp_replace(value, " ", "")
    turned = F.concat(F.substring(bare, 5, 64), F.substring(bare, 1, 4))

    def step(rest: Column, c: Column) -> Column:
        n = c.try_cast("int")
        return F.when(c == "", rest).when(n.isNotNull(), (rest * 10 + n) % 97).otherwise((rest * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(F.split(turned, ""), F.lit(0), step) == 1


def confirmed(kind: str, value: Column) -> Column:
    n = F.length(digits(value))
    if kind == "ip":
        bare = lambda p: F.regexp_replace(p, "^0+", "")
        return F.forall(F.split(value, r"\."), lambda p: (F.length(bare(p)) <= 3) & (F.coalesce(bare(p).try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return n.between(14, 19) & luhn(value)
    if kind == "phone":
        return n.between(10, 15)
    return mod97(value) if kind == "iban" else F.lit(True)


def let(value: Column, then) -> Column:
    """``then`` of a value that is computed once, however often it is used there."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda a, b: a + b)


def running_totals(values: Column, then) -> Column:
    """``then`` of a function that gives the sum of the first i + 1 of n values: sums of blocks of about the root of n come
    first, so that all n sums take n to the power of 1.5."""

    def blocks(v: Column) -> Column:
        size = F.greatest(F.ceil(F.sqrt(F.size(v))).cast("int"), F.lit(1))
        n = F.ceil(F.size(v) / size).cast("int")
        return F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda k: total(F.slice(v, k * size + 1, size)))

    def offsets(sums: Column) -> Column:
        return F.transform(sums, lambda _, k: total(F.slice(sums, F.lit(1), k)))

    def ready(s: Column) -> Column:
        v, before = s["v"], s["before"]
        size = F.greatest(F.ceil(F.sqrt(F.size(v))).cast("int"), F.lit(1))

        def at(i: Column) -> Column:
            block = F.floor(i / size).cast("int")
            return F.get(before, block) + total(F.slice(v, block * size + 1, i - block * size + 1))

        return then(at)

    return let(values, lambda v: let(F.struct(v.alias("v"), let(blocks(v), offsets).alias("before")), ready))


def spans(kind: str, rank: int) -> Column:
    """Confirmed spans of a kind in column ``text``: start, rank, kind, end, value, score; code points, end exclusive.

    The context of a span is what lies within WINDOW code points, up to the neighbouring matches of its kind.
    """
    pattern = PATTERNS[kind]
    values, gaps = F.regexp_extract_all("text", F.lit(pattern), F.lit(0)), F.split("text", pattern, -1)

    def near(x: Column) -> Column:
        before, after = x["before"], x["after"]
        return F.lower(F.concat(F.right(before, F.lit(WINDOW)), F.lit(" "), F.left(after, F.lit(WINDOW))))

    def scored(x: Column, i: Column, start_of) -> Column:
        score = F.least(F.lit(1.0), F.lit(SCORES[kind]) + F.when(near(x).rlike(CONTEXT[kind]), BOOST).otherwise(0.0))
        return let(
            start_of(i),
            lambda start: F.struct(start.alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), (start + F.length(x["value"])).alias("end"), x["value"].alias("value"), score.alias("score")),
        )

    def located(pairs: Column) -> Column:
        # From one match's begin to the next one's: its own length and the gap behind it.
        steps = F.transform(pairs, lambda x: F.length(x["before"]) + x["last"])
        numbered = F.transform(pairs, lambda x, i: F.struct(x.alias("x"), i.alias("i")))
        sure = F.filter(numbered, lambda p: confirmed(kind, p["x"]["value"]))
        return running_totals(steps, lambda start_of: F.transform(sure, lambda p: scored(p["x"], p["i"], start_of)))

    def paired(v: Column, g: Column) -> Column:
        n = F.size(v)
        lasts = F.concat(F.array(F.lit(0)), F.transform(v, F.length))
        return F.arrays_zip(v.alias("value"), F.slice(g, F.lit(1), n).alias("before"), F.slice(g, F.lit(2), n).alias("after"), F.slice(lasts, F.lit(1), n).alias("last"))

    there = F.col("text").rlike(pattern)
    if kind in NEEDS:
        there = F.contains("text", F.lit(NEEDS[kind])) & there
    empty = F.array().cast("array<struct<start:int,rank:int,kind:string,end:int,value:string,score:double>>")
    found = let(F.struct(values.alias("v"), gaps.alias("g")), lambda s: let(paired(s["v"], s["g"]), located))
    return F.when(there, found).otherwise(empty)


def personal_data(docs: DataFrame, min_score: float = 0.0) -> DataFrame:
    """(doc_id, spans) of each row: all confirmed spans with a score of ``min_score`` or more, by start, then kind.

    Matches of a kind are leftmost and don't overlap; those of different kinds may. A match that isn't confirmed is
    dropped, and the search goes on behind it. A null or empty text has no spans; a very long one is searched whole, in time
    that grows with its length and the power 1.5 of its matches. Null ids and repeated rows are handled as they come; other
    columns are not read; an empty table gives an empty result.
    """
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = found.select("doc_id", *(spans(kind, k).alias(kind) for k, kind in enumerate(PATTERNS)))
    every = F.array_sort(F.concat(*PATTERNS))
    return found.select("doc_id", F.filter(every, lambda s: s.score >= min_score).alias("spans"))


def digest(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, the hash of their spans, and all spans as text."""

    def joined(chosen: Column) -> Column:
        return F.array_join(F.transform(chosen, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")

    base = F.filter("spans", lambda s: s.kind.isin(*BASE))

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in PATTERNS]
    highest = F.array_max(F.transform("spans", lambda s: s.score))
    return found.select("doc_id", *counts, F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), highest.alias("highest_score"))
