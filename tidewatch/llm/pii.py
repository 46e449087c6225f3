"""Personal data: expressions propose spans, checksums confirm them, words nearby adjust a score.

Only built-in SQL functions. A text is split at the matches of a kind; the pieces between them give the matches' positions and the words
nearby, so that no text is searched twice for a place. Possessive expressions keep the search linear in the text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import text_or_empty

#: Characters on either side in which context words count.
NEARBY = 48
#: A span of an added kind stays if its score reaches this.
THRESHOLD = 0.6


@dataclass(frozen=True)
class Kind:
    """base: the spans stay whatever their score. prior: score of a match; a passed check and each kind of context word add to it."""

    name: str
    pattern: str
    base: bool
    prior: float
    context: str
    against: str = ""


#: The base expressions are the contract's, written without backtracking (a run is taken whole, and entered at its start only).
KINDS = [
    Kind("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", True, 0.8, r"e-?mail|mail|contact|write"),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", True, 0.6, r"\bip\b|address|host|server|login", r"version|release"),
    Kind("card", r"[0-9](?:[ -]?[0-9])++", True, 0.6, r"card|visa|credit|payment|debit", r"isbn|order|tracking"),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", True, 0.7, r"phone|call|tel|mobile|fax"),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}+(?![A-Za-z0-9])", False, 0.2, r"iban|bank|account|konto|transfer"),
    Kind("national_id", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", False, 0.3, r"\bssn\b|social security|tax id|national id"),
]


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """The last digit makes the sum of digits a multiple of 10, every second digit from the right doubled with its digits added."""
    values = F.transform(F.split(F.reverse(number), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((c.cast("int") * 2) % 10 + F.floor(c.cast("int") / 5).cast("int")))
    return F.aggregate(values, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def mod97(code: Column) -> Column:
    """The first four characters moved to the end, letters as 10 to 35: the number leaves 1 when divided by 97."""
    plain = F.regexp_replace(code, " ", "")
    turned = F.split(F.concat(F.substring(plain, 5, 40), F.substring(plain, 1, 4)), "")

    def step(rest, c):
        value = F.when(c.rlike("^[0-9]$"), c.cast("int")).otherwise(F.ascii(c) - 55)
        return F.when(c == "", rest).otherwise((rest * F.when(value < 10, 10).otherwise(100) + value) % 97)

    return F.aggregate(turned, F.lit(0), step) == 1


def valid(kind: Kind, x: Column) -> Column:
    if kind.name == "ip":
        return x.rlike(r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$")
    if kind.name == "card":
        number = digits(x)
        return F.length(number).between(13, 19) & luhn(number)
    if kind.name == "phone":
        return F.length(digits(x)).between(9, 15)
    if kind.name == "iban":
        return mod97(x)
    if kind.name == "national_id":
        return ~x.rlike("^(?:000|666|9)|-00-|-0000$")
    return F.lit(True)


def score(kind: Kind, found: Column, before: Column, after: Column) -> Column:
    """Between 0 and 1: prior, 0.5 for a checksum that holds, 0.3 for a word that speaks for the kind, less 0.3 for one that speaks against."""
    near = F.lower(F.concat(F.right(before, F.lit(NEARBY)), F.lit(" "), F.left(after, F.lit(NEARBY))))
    total = F.lit(kind.prior) + (F.lit(0.5) if kind.name in ("card", "iban") else F.lit(0.0)) + F.when(near.rlike(kind.context), 0.3).otherwise(0.0)
    if kind.against:
        total = total - F.when(near.rlike(kind.against), 0.3).otherwise(0.0)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), total))


def kind_spans(kind: Kind, found: Column, pieces: Column) -> Column:
    """array<struct<kind, start, end, score>> of the matches that pass, positions in code points; pieces are the texts between the matches."""
    empty = F.array().cast("array<struct<kind:string,start:int,end:int,score:double>>")
    start_at = F.struct(F.lit(0).alias("at"), F.lit(0).alias("i"), empty.alias("out"))

    def step(state, x):
        before = F.element_at(pieces, state["i"] + 1)
        start = state["at"] + F.length(before)
        end = start + F.length(x)
        worth = score(kind, x, before, F.element_at(pieces, state["i"] + 2))
        keep = valid(kind, x) if kind.base else valid(kind, x) & (worth >= THRESHOLD)
        span = F.struct(F.lit(kind.name).alias("kind"), start.alias("start"), end.alias("end"), worth.alias("score"))
        return F.struct(end.alias("at"), (state["i"] + 1).alias("i"), F.when(keep, F.concat(state["out"], F.array(span))).otherwise(state["out"]).alias("out"))

    return F.when(F.size(found) == 0, empty).otherwise(F.aggregate(found, start_at, step, lambda s: s["out"]))


def find(docs: DataFrame, column: str = "text", to: str = "pii") -> DataFrame:
    """The rows with an array `to` of struct<kind, start, end, score>: by kind in KINDS' order, then start; end exclusive; code points.

    A null text counts as empty and has no spans. Repeated rows are judged alike; other columns stay, except one named like `to`, which is replaced.
    """
    text = text_or_empty(column)
    found = docs.drop(to).select("*", *[F.regexp_extract_all(text, F.lit(k.pattern), F.lit(0)).alias(f"_found_{k.name}") for k in KINDS])
    pieces = found.select("*", *[F.when(F.size(f"_found_{k.name}") > 0, F.split(text, k.pattern, -1)).alias(f"_pieces_{k.name}") for k in KINDS])
    spans = F.concat(*[kind_spans(k, F.col(f"_found_{k.name}"), F.col(f"_pieces_{k.name}")) for k in KINDS])
    return pieces.withColumn(to, spans).drop(*[f"_{part}_{k.name}" for part in ("found", "pieces") for k in KINDS])


def redact(docs: DataFrame, column: str = "text") -> DataFrame:
    """The rows with each span of find() replaced by <KIND>; of overlapping spans the first, or the longer from the same start, names the whole."""
    spans = F.array_sort(F.col("_pii"), lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(b["end"] - a["end"]))
    text = F.col(column).cast("string")
    start_at = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(state, x):
        inside = x["start"] < state["at"]
        out = F.concat(state["out"], F.substring(text, state["at"] + 1, x["start"] - state["at"]), F.lit("<"), F.upper(x["kind"]), F.lit(">"))
        return F.struct(F.greatest(state["at"], x["end"]).alias("at"), F.when(inside, state["out"]).otherwise(out).alias("out"))

    clean = F.aggregate(spans, start_at, step, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))))
    found = find(docs, column, "_pii")
    return found.withColumn(column, F.when(F.size("_pii") > 0, clean).otherwise(text)).drop("_pii")


def digest(docs: DataFrame) -> DataFrame:
    """Counts of the base kinds, and the spans as text and as a hash."""
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = [k.name for k in KINDS if k.base]
    count = lambda k: F.size(F.filter("pii", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    counts = [count(k) for k in base]
    return find(docs).select("doc_id", *counts, F.sha2(listed(F.filter("pii", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"), listed(F.col("pii")).alias("spans"))
