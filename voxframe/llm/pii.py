"""Personal data: patterns propose, checksums confirm, context words adjust the score. Built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .spans import count_kind, digest, kept_spans, locate, merged

BASE = ("email", "ip", "card", "phone")
# Each pattern tries every run of its characters once: at the end of the last match or where the run begins.
# The possessive repeats can't change a match, for what follows a run never belongs to the run.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "local_phone": r"(?<![0-9+.(-])\(?0[0-9]{2,4}\)?[\x20/-][0-9][0-9\x20-]{4,12}[0-9](?![0-9])",
}
# A character that every match of a kind has; matches of the others have a digit. Texts without it are not searched.
NEEDED = {"email": "@", "phone": "+", "local_phone": "0"}
RANK = {kind: rank for rank, kind in enumerate(PATTERNS)}
OCTET = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9]|(?<=0))"
IP = rf"^{OCTET}(?:\.{OCTET}){{3}}$"
# What a pattern alone is worth, what its checksum or length check adds, and the words that raise it.
PRIOR = {"email": 0.8, "ip": 0.5, "card": 0.3, "phone": 0.5, "iban": 0.3, "local_phone": 0.2}
CHECKED = {"email": 0.0, "ip": 0.2, "card": 0.5, "phone": 0.2, "iban": 0.6, "local_phone": 0.1}
CONTEXT_BONUS = 0.3
WORDS = {
    "email": "mail|contact|write|kontakt|correo|courriel",
    "ip": "ip|host|server|address|adresse",
    "card": "card|visa|credit|payment|karte|carte|tarjeta",
    "phone": "phone|tel|call|mobile|fax|anruf",
    "iban": "iban|account|bank|konto|compte|cuenta",
    "local_phone": "phone|tel|call|mobile|fax|anruf",
}
THRESHOLD = 0.55


def digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def mod97(match: Column) -> Column:
    """ISO 13616: the first four characters go last, letters count from 10, the remainder has to be 1."""
    plain = F.replace(match, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(plain, 5, 64), F.left(plain, F.lit(4)))

    def add(acc: Column, char: Column) -> Column:
        code = F.ascii(char)
        number = code < 58
        return (acc * F.when(number, 10).otherwise(100) + F.when(number, code - 48).otherwise(code - 55)) % 97

    return F.aggregate(F.split(turned, ""), F.lit(0), lambda acc, c: F.when(c == "", acc).otherwise(add(acc, c))) == 1


def confirmed(kind: str, match: Column) -> Column:
    if kind == "ip":
        return match.rlike(IP)
    if kind == "card":
        return F.length(digits(match)).between(12, 19) & F.call_function("luhn_check", digits(match))
    if kind == "phone":
        return F.length(digits(match)).between(9, 15)
    if kind == "iban":
        return mod97(match)
    if kind == "local_phone":
        return F.length(digits(match)).between(8, 12)
    return F.lit(True)


def score(kind: Column, span: Column) -> Column:
    """Of a confirmed span: prior and checksum, and the bonus where a context word stands shortly before or after it."""
    out = F.lit(0.0)
    for name in PATTERNS:
        near = F.lower(span["before"]).rlike(f"(?:{WORDS[name]})") | F.lower(span["after"]).rlike(f"(?:{WORDS[name]})")
        value = F.lit(PRIOR[name] + CHECKED[name]) + F.when(near, CONTEXT_BONUS).otherwise(0.0)
        out = F.when(kind == name, F.least(F.lit(1.0), value)).otherwise(out)
    return out


def find_pii(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows with ``base`` and ``pii`` spans and ``pii_scores``.

    Base spans are every match of the four base kinds that its check confirms. Spans of the further kinds
    join them when their score passes the threshold; context is the text around a span, whatever else was
    found in it. Null and empty texts have empty arrays; row order,
    repeated rows and other columns don't matter, an empty table gives no rows. The columns added replace
    columns of the same names, in letters of either case.
    """
    body = docs.withColumn("__pii_text", F.coalesce(F.col(text), F.lit("")))
    body = body.withColumn("__pii_digits", F.col("__pii_text").rlike("[0-9]"))  # a column of its own, so it is looked for once
    needs = lambda kind: F.contains("__pii_text", F.lit(NEEDED[kind])) if kind in NEEDED else F.col("__pii_digits")
    found = locate(body, "__pii_text", PATTERNS, needs)
    spans = {kind: kept_spans(kind, RANK[kind], lambda m, kind=kind: confirmed(kind, m)) for kind in PATTERNS}
    for kind in set(PATTERNS) - set(BASE):
        spans[kind] = F.filter(spans[kind], lambda s: score(s["kind"], s) >= THRESHOLD)
    held = [f"`{c}`" for c in docs.columns if c.lower() not in ("base", "pii", "pii_scores")]
    return (found.select(*held, merged(*[spans[k] for k in BASE]).alias("base"), merged(*spans.values()).alias("pii"))
            .withColumn("pii_scores", F.transform("pii", lambda s: F.round(score(s["kind"], s), 3))))


def redact(text: Column, spans: Column) -> Column:
    """``text`` with every span replaced by [KIND]; overlapping spans become one, named after the first."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        piece = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        mark = F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))
        out = F.when(s["start"] >= acc["at"], F.concat(acc["out"], F.array(piece, mark))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), out.alias("out"))

    whole = F.aggregate(spans, start, step, lambda acc: F.concat(
        F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, whole).otherwise(text)


def pii_digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", *[count_kind(F.col("base"), kind).alias(f"n_{kind}") for kind in BASE],
                        F.sha2(digest(F.col("base")), 256).alias("base_sha256"), digest(F.col("pii")).alias("spans"),
                        F.coalesce(F.array_max("pii_scores"), F.lit(0.0)).alias("max_score"))
