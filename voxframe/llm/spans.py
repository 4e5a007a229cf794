"""Places of pattern matches in a text column, with built-in functions only.

Spark returns matches as strings without positions. The pieces between the matches (``split``) and
the matches (``regexp_extract_all``) alternate, so the running sum of their lengths gives code point
offsets. Both run the same pattern left to right without overlaps. Running sums are taken in chunks, and
nothing is looked up or built again per match, so the work grows with the text and its matches.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

SPAN = "array<struct<start:int,rank:int,end:int,kind:string,value:string,before:string,after:string>>"
CONTEXT = 48  # code points before and after a match that are kept for context rules, whatever matches lie in them
CHUNK = 256   # values whose running sum is appended to one array
MATCHES, PIECES = "__span_matches_", "__span_pieces_"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def locate(df: DataFrame, text: str, patterns: dict[str, str], needs: Callable[[str], Column] | None = None) -> DataFrame:
    """Add the matches of every pattern and the pieces around them, in columns named after MATCHES and PIECES.

    A null text has no matches. Texts are only cut where something was found, and only searched where they pass
    ``needs`` of the kind, a cheap test that every text with a match passes.
    """
    def matches(kind: str, pattern: str) -> Column:
        every = F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))
        return every if needs is None else F.when(needs(kind), every).otherwise(F.array().cast("array<string>"))

    found = df.withColumns({f"{MATCHES}{kind}": matches(kind, p) for kind, p in patterns.items()})
    return found.withColumns({
        f"{PIECES}{kind}": F.when(F.size(f"{MATCHES}{kind}") > 0, F.split(F.col(text), p, -1)) for kind, p in patterns.items()})


def running(values: Column) -> Column:
    """The sum of the values before each one of a filled array."""
    empty = F.struct(F.lit(0).alias("sum"), F.array().cast("array<int>").alias("before"))
    append = lambda acc, x: F.struct((acc["sum"] + x).alias("sum"), F.concat(acc["before"], F.array(acc["sum"])).alias("before"))
    chunks = lambda v: F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / CHUNK).cast("int")), lambda c: F.aggregate(F.slice(v, c * CHUNK + 1, F.lit(CHUNK)), empty, append))
    joined = lambda parts: F.flatten(F.zip_with(parts, F.aggregate(F.transform(parts, lambda p: p["sum"]), empty, append)["before"],
                                                lambda part, offset: F.transform(part["before"], lambda b: b + offset)))
    return bound(bound(values, chunks), joined)


def kept_spans(kind: str, rank: int, keep: Callable[[Column], Column]) -> Column:
    """Spans of ``kind`` whose match passes ``keep``, with the text around them; null where nothing was found."""

    def spans(m: Column, g: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(m) - 1)
        lengths = F.transform(places, lambda i: F.length(F.get(g, i)) + F.length(F.get(m, i)))
        # A match has one code point at least, so CONTEXT of these parts fill the context.
        parts_before = F.transform(places, lambda i: F.right(F.concat(F.coalesce(F.get(m, i - 1), F.lit("")), F.get(g, i)), F.lit(CONTEXT)))
        parts_after = F.transform(places, lambda i: F.left(F.concat_ws("", F.get(g, i + 1), F.get(m, i + 1)), F.lit(CONTEXT)))

        def span(i: Column, at: Column, before: Column, after: Column) -> Column:
            begin = F.get(at, i) + F.length(F.get(g, i))
            first = F.greatest(i - CONTEXT + 1, F.lit(0))
            return F.struct(begin.alias("start"), F.lit(rank).alias("rank"), (begin + F.length(F.get(m, i))).alias("end"), F.lit(kind).alias("kind"), F.get(m, i).alias("value"),
                            F.right(F.array_join(F.slice(before, first + 1, i - first + 1), ""), F.lit(CONTEXT)).alias("before"),
                            F.left(F.array_join(F.slice(after, i + 1, F.lit(CONTEXT)), ""), F.lit(CONTEXT)).alias("after"))

        kept = F.filter(places, lambda i: keep(F.get(m, i)))
        return bound(running(lengths), lambda at: bound(parts_before, lambda before: bound(parts_after, lambda after: F.transform(kept, lambda i: span(i, at, before, after)))))

    matches, pieces = F.col(f"{MATCHES}{kind}"), F.col(f"{PIECES}{kind}")
    return F.when(F.size(matches) > 0, bound(matches, lambda m: bound(pieces, lambda g: spans(m, g).cast(SPAN))))


def merged(*spans: Column) -> Column:
    """One array of all spans by start, then rank."""
    empty = F.array().cast(SPAN)
    return F.sort_array(F.concat(*[F.coalesce(s, empty) for s in spans]))


def digest(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
