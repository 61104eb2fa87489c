"""Personal data by patterns, checksums and context, in DataFrame functions only.

A regular expression proposes spans, a validator confirms them (number ranges, digit counts, Luhn, mod-97) and words near
by adjust a score. Spark gives a pattern's matches but not where they lie: the pieces between the matches come from
split(), and the lengths of pieces and matches add up to the positions. The patterns use possessive loops and begin where
a run begins (or the last match ended), which matches just what the plain ones do, without backtracking, recursion or
trying each place of a long run.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NEAR = 40  # characters before a span in which a context word counts


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""

    def add(total: Column, i: Column) -> Column:
        d = digits.substr(-i, F.lit(1)).cast("int")
        twice = d * 2 - F.when(d > 4, 9).otherwise(0)
        return total + F.when(i % 2 == 0, twice).otherwise(d)

    places = F.sequence(F.lit(1), F.greatest(F.length(digits), F.lit(1)))
    return (F.length(digits) > 0) & (F.aggregate(places, F.lit(0), add) % 10 == 0)


def mod97(account: Column) -> Column:
    """Whether an account number without blanks passes the mod-97 check: 1 after moving its first four characters to the end."""
    turned = F.concat(account.substr(F.lit(5), F.length(account)), account.substr(1, 4))

    def step(rest: Column, c: Column) -> Column:
        letter = F.ascii(c) - 55
        return F.when(c.between("0", "9"), rest * 10 + F.ascii(c) - 48).otherwise(rest * 100 + letter) % 97

    return F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), step) == 1


@dataclass(frozen=True)
class Kind:
    """Pattern, a quick test that texts with valid spans pass, validator, score, and words that raise it."""

    name: str
    pattern: str
    quick: Callable[[Column], Column]
    valid: Callable[[Column], Column]
    score: float
    context: str
    base: bool = True


def _card(match: Column) -> Column:
    digits = _digits(match)
    return F.when(F.length(digits).between(12, 19), luhn(digits)).otherwise(False)


def _iban(match: Column) -> Column:
    account = F.regexp_replace(match, " ", "")
    return F.when(F.length(account).between(15, 34), mod97(account)).otherwise(False)


# Fixed patterns of the four base kinds, in their order; the added kind follows.
KINDS: tuple[Kind, ...] = (
    Kind(
        "email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        lambda t: F.contains(t, F.lit("@")), lambda m: F.lit(True), 0.9, "mail|e-mail|email|contact|courriel|correo",
    ),
    Kind(
        "ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
        lambda t: t.rlike(r"[0-9]\.[0-9]++\.[0-9]"),
        lambda m: m.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(?:\.|$)){4}$"), 0.6, "ip|host|server|address|adresse",
    ),
    Kind(
        "card", r"[0-9](?:[\x20-]?[0-9])++",
        lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){11}"), _card, 0.8, "card|visa|credit|carte|karte|tarjeta",
    ),
    Kind(
        "phone", r"\+[0-9][\x20().0-9-]+[0-9]",
        lambda t: t.rlike(r"\+[0-9]"), lambda m: F.length(_digits(m)).between(9, 15), 0.6, "tel|phone|call|fax|mobile|telefon",
    ),
    Kind(
        "iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
        lambda t: t.rlike(r"[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}"), _iban, 0.7, "iban|account|konto|compte|cuenta", False,
    ),
)

_SPANS = "array<struct<start:int,rank:int,stop:int,kind:string,score:double>>"


def spans_of(text: Column, kind: Kind, rank: int) -> Column:
    """Valid spans of a kind, leftmost first, none overlapping: start and stop in code points, stop exclusive."""
    found = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    gaps = F.slice(F.split(text, kind.pattern, -1), F.lit(1), F.size(found))
    parts = F.zip_with(gaps, found, lambda g, m: F.struct(F.length(g).alias("gap"), m.alias("match")))
    near = lambda start: F.lower(text.substr(F.greatest(start - NEAR + 1, F.lit(1)), F.least(start, F.lit(NEAR))))

    def step(acc: Column, part: Column) -> Column:
        start = acc["at"] + part["gap"]
        stop = start + F.length(part["match"])
        told = near(start).rlike(rf"(?<![a-z])(?:{kind.context})(?![a-z])")
        one = F.struct(
            start.alias("start"), F.lit(rank).alias("rank"), stop.alias("stop"), F.lit(kind.name).alias("kind"),
            (F.lit(kind.score) + F.when(told, F.lit(0.1)).otherwise(F.lit(0.0))).alias("score"),
        )
        out = F.when(kind.valid(part["match"]), F.concat(acc["out"], F.array(one))).otherwise(acc["out"])
        return F.struct(stop.alias("at"), out.alias("out"))

    begin = F.struct(F.lit(0).alias("at"), F.array().cast(_SPANS).alias("out"))
    spans = F.aggregate(parts, begin, step, lambda acc: acc["out"])
    return F.when(kind.quick(text), spans).otherwise(F.array().cast(_SPANS))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def find(docs: DataFrame, *, id_col="doc_id", text_col="text", least: float = 0.5) -> DataFrame:
    """One row per input row: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, scores, found.

    The counts and base_sha256 are of the base kinds, whose valid spans stay whatever their score; added kinds need a
    score of `least`. spans joins kind:start:end by start, then in the order of KINDS; scores are theirs in that order;
    found holds them as structs. Null and empty texts have none; repeated rows are alike; further columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    each = [spans_of(F.col("_text"), kind, rank).alias(f"_{kind.name}") for rank, kind in enumerate(KINDS)]
    rows = rows.select("doc_id", *each)
    base = F.array_sort(F.concat(*[F.col(f"_{k.name}") for k in KINDS if k.base]))
    added = [F.filter(F.col(f"_{k.name}"), lambda s: s["score"] >= least) for k in KINDS if not k.base]
    rows = rows.withColumn("_base", base).withColumn("found", F.array_sort(F.concat(F.col("_base"), *added)))
    counts = [F.size(f"_{k.name}").cast("long").alias(f"n_{k.name}") for k in KINDS if k.base]
    return rows.select(
        "doc_id",
        *counts,
        F.sha2(_joined(F.col("_base")), 256).alias("base_sha256"),
        _joined(F.col("found")).alias("spans"),
        F.array_join(F.transform("found", lambda s: F.format_string("%.1f", s["score"])), ",").alias("scores"),
        "found",
    )


def redact(text: Column, found: Column) -> Column:
    """The text with each span replaced by its kind in angle brackets; of overlapping spans the first counts."""

    def step(acc: Column, s: Column) -> Column:
        piece = F.concat(text.substr(acc["at"] + 1, s["start"] - acc["at"]), F.lit("<"), s["kind"], F.lit(">"))
        new = F.struct(s["stop"].alias("at"), F.concat(acc["out"], piece).alias("out"))
        return F.when(s["start"] >= acc["at"], new).otherwise(acc)

    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    rest = lambda acc: F.concat(acc["out"], text.substr(acc["at"] + 1, F.length(text)))
    return F.aggregate(found, begin, step, rest)
