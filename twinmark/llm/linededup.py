"""Line dedup over overlapping three-line windows, with built-in functions only.

A document's lines (text between newlines) that hold more than white space are hashed; each three
in a row make a window, a pair of 64-bit hashes. Windows found more than once anywhere have a first
occurrence: the smallest (document id, place). Every other occurrence covers its three lines, and
covered lines go; overlapping windows so merge to whole passages. Each removed line stands in an
earlier window, so the first copy of every line remains somewhere.

Blank lines stay where they are. Documents of fewer than three such lines are left alone. Null texts
stay null. Rows that repeat both id and text count as one document and are treated alike; null ids
come first. Nothing is collected: windows are counted with map-side sums, occurrences meet them in a
join that Spark can split where one window fills a third of the table, and the list of places per
document is bounded by the document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinmark.llm.common import cut, free_name

SPAN = 3


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _told(lines: Column) -> Column:
    """Places of the lines that hold more than white space, from 0."""
    return F.filter(F.transform(lines, lambda x, i: F.when(x.rlike("\\S"), i)), lambda i: i.isNotNull())


def _keys(docs: DataFrame) -> list[Column]:
    """What tells rows apart: the id, and a hash of the text that also says whether the id is null."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("k_id"), F.xxhash64(F.col("doc_id").isNull(), "text").alias("k_text")]


def later_windows(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """k_id, k_text, found: places (among lines that aren't blank) where a repeated window starts that
    isn't its first occurrence."""
    df = docs.where("text is not null").select(*_keys(docs), _lines(F.col("text")).alias("lines"))
    df = df.select("k_id", "k_text", F.transform(F.filter("lines", lambda x: x.rlike("\\S")), lambda x: F.xxhash64(x)).alias("h")).where(F.size("h") >= span)
    part = lambda i: [F.element_at("h", i + k) for k in range(span)]
    each = F.transform(F.sequence(F.lit(1), F.size("h") - (span - 1)), lambda i: F.struct(F.xxhash64(*part(i)).alias("a"), F.xxhash64(F.lit(1), *part(i)[::-1]).alias("b"), (i - 1).alias("at")))
    windows = df.select("k_id", "k_text", F.explode(each).alias("w")).select("k_id", "k_text", "w.*")
    place = F.struct("k_id", "k_text", "at")
    repeated = cut(windows.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first")).where("n > 1").drop("n"))
    again = windows.join(repeated, ["a", "b"]).where(place != F.col("first"))
    return again.groupBy("k_id", "k_text").agg(F.collect_set("at").alias("found"))


def dedup(docs: DataFrame, span: int = SPAN, with_counts: bool = False) -> DataFrame:
    """The documents without the lines of later occurrences; with_counts adds n_lines and n_removed."""
    names = list(docs.columns)
    a, b, found, lines, covered, told = (free_name(names, x) for x in ("k_id", "k_text", "found", "lines", "covered", "told"))
    gone = later_windows(docs, span).select(F.col("k_id").alias(a), F.col("k_text").alias(b), F.col("found").alias(found))
    df = docs.select("*", *(c.alias(n) for c, n in zip(_keys(docs), (a, b), strict=True))).join(gone, [a, b], "left").drop(a, b)
    hit, text = F.col(found).isNotNull(), F.col("text")
    df = df.select("*", F.when(hit, _lines(text)).alias(lines))
    df = df.select("*", F.when(hit, F.array_distinct(F.flatten(F.transform(found, lambda j: F.sequence(j, j + (span - 1)))))).alias(covered), F.when(hit, _told(F.col(lines))).alias(told))
    out = F.transform(covered, lambda j: F.element_at(told, (j + 1).cast("int")))
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), out)
    cleaned = F.when(hit, F.array_join(F.transform(stay, lambda i: F.element_at(lines, (i + 1).cast("int"))), "\n")).otherwise(text)
    n_lines = F.coalesce(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1, F.lit(0))
    more = [n_lines.cast("long").alias(free_name(names, "n_lines")), F.when(hit, F.size(covered)).otherwise(0).cast("long").alias(free_name(names, "n_removed"))] if with_counts else []
    return df.select(*(cleaned.alias("text") if c == "text" else F.col(f"`{c}`") for c in names), *more)


def filter(docs: DataFrame, span: int = SPAN) -> DataFrame:  # noqa: A001
    """dedup, without the documents that it leaves no text, n_chars set to the new length where the
    text changed."""
    removed = free_name(docs, "n_removed")
    df = dedup(docs, span, with_counts=True).where(f"`{removed}` = 0 or text rlike '\\\\S'")
    out = [F.when(F.col(removed) > 0, F.length("text").cast(docs.schema[c].dataType)).otherwise(F.col(c)).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns]
    return df.select(*out)


SQL = """
    with l as (
        select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as pos
        from documents where text is not null
    ), t as (
        select *, row_number() over (partition by doc_id order by pos) - 1 as wpos from l where regexp_matches(line, '\\S')
    ), w as (
        select doc_id, wpos, line as a, lead(line) over d as b, lead(line, 2) over d as c from t
        window d as (partition by doc_id order by wpos)
    ), n as (
        select *, row_number() over (partition by a, b, c order by doc_id, wpos) as nth from w where c is not null
    ), gone as (
        select distinct doc_id, wpos + k as wpos from n, (values (0), (1), (2)) as v(k) where nth > 1
    ), kept as (
        select l.doc_id, l.pos, l.line, g.wpos is not null as removed
        from l left join t on l.doc_id = t.doc_id and l.pos = t.pos left join gone g on t.doc_id = g.doc_id and t.wpos = g.wpos
    ), o as (
        select doc_id, count(*) as n_lines, count(*) filter (where removed) as n_removed,
               string_agg(line, chr(10) order by pos) filter (where not removed) as text
        from kept group by doc_id
    )
    select d.doc_id, coalesce(o.n_lines, 0) as n_lines, coalesce(o.n_removed, 0) as n_removed,
           case when d.text is null then null else coalesce(o.text, '') end as text
    from documents d left join o on d.doc_id = o.doc_id
"""
