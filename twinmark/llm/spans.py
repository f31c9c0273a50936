"""Where patterns match in a text, with built-in functions only.

Spark has no function for positions of matches. The matches and the pieces between them (the same
pattern, used to split) have lengths, and a match starts where the lengths before it end. The sums
are taken in blocks of about sqrt(n) matches, so that n matches cost n * sqrt(n), not n * n.

Patterns must not match the empty string. Positions count code points, ends are exclusive.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST_BLOCK = 16


@dataclass(frozen=True)
class Kind:
    """name; pattern in Java's syntax; needs: a cheap condition that any text with a match meets."""

    name: str
    pattern: str
    needs: str | None = None


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0), lambda x, y: x + y)


def block_of(a: Column) -> Column:
    """How many elements of the array a block has: about the square root of their number."""
    return F.greatest(F.lit(LEAST_BLOCK), F.ceil(F.sqrt(F.size(a))).cast("int"))


def locate(df: DataFrame, text: str, kinds: list[Kind], only=None) -> DataFrame:
    """df with, for each kind, a column s_<name>: array of struct(start, end, value). only(value) says whose
    places are asked for; the others are left out."""
    body = F.col(text)
    none = F.array().cast("array<string>")
    guard = lambda k, c: F.when(F.expr(k.needs.format(text=f"`{text}`")), c).otherwise(none) if k.needs else c
    names = df.columns
    # each step refers to the last one's columns more than once, so the optimiser keeps them apart
    df = df.select(*names, *(guard(k, F.regexp_extract_all(body, F.lit(k.pattern), F.lit(0))).alias(f"m_{k.name}") for k in kinds))
    df = df.select("*", *(F.when(F.size(f"m_{k.name}") > 0, F.split(body, k.pattern, -1)).otherwise(none).alias(f"p_{k.name}") for k in kinds))
    df = df.select("*", *(F.zip_with(F.slice(f"p_{k.name}", 1, F.size(f"m_{k.name}")), f"m_{k.name}", lambda a, b: F.length(a) + F.length(b)).alias(f"u_{k.name}") for k in kinds))

    df = df.select("*", *(block_of(F.col(f"u_{k.name}")).alias(f"n_{k.name}") for k in kinds))

    def blocks(k: Kind) -> Column:
        u, n = F.col(f"u_{k.name}"), F.col(f"n_{k.name}")
        last = F.floor((F.size(u) - 1) / n).cast("int")
        return F.when(F.size(u) > n, F.transform(F.sequence(F.lit(0), last), lambda b: _sum(F.slice(u, b * n + 1, n)))).otherwise(F.array().cast("array<int>"))

    df = df.select("*", *(blocks(k).alias(f"b_{k.name}") for k in kinds))

    def spans(k: Kind) -> Column:
        m, p, u, b, n = (F.col(f"{x}_{k.name}") for x in "mpubn")

        def at(value: Column, i: Column) -> Column:
            block = F.floor(i / n).cast("int")
            start = _sum(F.slice(b, F.lit(1), block)) + _sum(F.slice(u, block * n + 1, i % n)) + F.length(F.get(p, i))
            return F.struct(start.alias("start"), (start + F.length(value)).alias("end"), value.alias("value"))

        if only is None:
            return F.transform(m, at)
        asked = F.filter(F.transform(m, lambda v, i: F.struct(v.alias("value"), i.alias("i"))), lambda x: only(x["value"]))
        return F.transform(asked, lambda x: at(x["value"], x["i"]))

    return df.select(*names, *(spans(k).alias(f"s_{k.name}") for k in kinds))


def tagged(column: str, order: int, name: str) -> Column:
    """The column's spans as struct(start, order, end, kind), which sort by start, then kind."""
    return F.transform(column, lambda s: F.struct(s["start"].alias("start"), F.lit(order).alias("order"), s["end"].alias("end"), F.lit(name).alias("kind")))


def listed(sorted_spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(sorted_spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def replaced(text: Column, pattern: str, by, needs: Column | None = None) -> Column:
    """The text with each match m of the pattern replaced by the column by(m); linear in the text."""
    out = F.concat(
        F.array_join(F.zip_with(F.slice(F.split(text, pattern, -1), 1, F.size(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda a, m: F.concat(a, by(m))), ""),
        F.element_at(F.split(text, pattern, -1), -1),
    )
    return F.when(needs & text.rlike(pattern) if needs is not None else text.rlike(pattern), out).otherwise(text)
