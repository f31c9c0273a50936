"""Personal data, with built-in functions only: fixed patterns, and terms that give entities away.

Base kinds are e-mail and internet addresses, card and phone numbers. The method then measures, over
the whole corpus, how strongly a word reveals an entity that stands in the same document. With n(c),
n(t) and n(c, t) the distinct texts that hold the entity, the term, and both, and N all distinct texts,

    information of the entity     IC(c)     = ln(N / n(c))
    what the term tells about it  PMI(c, t) = ln(n(c, t) * N / (n(c) * n(t)))

a term discloses the entity if PMI >= disclosure * IC and at least `support` distinct texts have both
(1 in scan(): PMI alone judges; copies of a text count once). All its occurrences in texts with the
entity become spans of kind `term`; sanitise() generalises them (names and numbers to their sort) or
removes other words, and masks the base kinds. sanitise() asks for 3 texts unless told otherwise.

Terms are words of three letters or more, anywhere in the document, once base kinds are blanked. All
words of all texts are counted (by 64-bit hash, summed on the map side). As n(c, t) <= n(c), a term
with n(t) > n(c) ** disclosure * N ** (1 - disclosure) can't disclose c: only rarer ones are paired,
and nothing is lost. Entities that stand in exactly the same texts are judged as one class, so a list
of many entities and many names costs their sum, not their product. The joins by class are ones that
Spark can split where one entity fills a third of the table. Null texts are empty; rows with equal
ids are judged one by one, rows that also repeat the text alike. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinmark.llm.common import cut, free_name
from twinmark.llm.spans import Kind, block_of, listed, locate, replaced, tagged

# The base patterns. Lookbehinds and possessive quantifiers only save time: a match can
# start where a run starts, or where the last match ended.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[ -]?[0-9]){13,}+"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
IP_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
KINDS = [
    Kind("email", EMAIL, "instr({text}, '@') > 0"),
    Kind("ip", IP, "instr({text}, '.') > 0"),
    Kind("card", CARD),
    Kind("phone", PHONE, "instr({text}, '+') > 0"),
]
WORD = r"\p{L}[\p{L}\p{N}'’-]{2,}"
SUPPORT, DISCLOSURE = 3, 0.9


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    d = F.transform(F.split(F.reverse(digits), ""), lambda c: c.cast("int"))
    part = F.transform(d, lambda x, i: F.when(i % 2 == 1, F.when(x > 4, x * 2 - 9).otherwise(x * 2)).otherwise(x))
    return F.aggregate(part, F.lit(0), lambda a, b: a + b) % 10 == 0


def holds(kind: str, value: Column) -> Column:
    """Whether a match of the kind's pattern counts."""
    n = F.length(_digits(value))
    if kind == "ip":
        return value.rlike(rf"^{IP_PART}(?:\.{IP_PART}){{3}}$")
    if kind == "card":
        return F.when((n >= 14) & (n <= 19), luhn(_digits(value))).otherwise(False)
    if kind == "phone":
        return (n >= 10) & (n <= 15)
    return F.lit(True)


def _holder(kind: str):
    return lambda s: holds(kind, s["value"])


def _entity(kind: str, span: Column) -> Column:
    """What stands for an entity: a hash of its kind and its value in lower case."""
    return F.xxhash64(F.lit(kind), F.lower(span["value"]))


def _entity_of(kind: str):
    return lambda s: _entity(kind, s)


def _blanked(df: DataFrame) -> DataFrame:
    """df with the entities in its column text blanked; nothing else moves."""
    for k in KINDS:  # each step refers to the last one's column more than once, so the optimiser keeps them apart
        blank = lambda m, k=k: F.when(holds(k.name, m), F.repeat(F.lit(" "), F.length(m))).otherwise(m)
        df = df.withColumn("text", replaced(F.col("text"), k.pattern, blank, F.expr(k.needs.format(text="text")) if k.needs else None))
    return df


def _hash(text: str = "text") -> Column:
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def base_spans(docs: DataFrame) -> DataFrame:
    """doc_id, h (a hash of id and text), th (of the text) and s_<kind> arrays; text is kept only where there are any."""
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    df = df.withColumn("h", F.xxhash64(F.col("doc_id").isNull(), "text")).withColumn("th", _hash())
    df = locate(df, "text", KINDS)
    df = df.select("doc_id", "h", "th", "text", *(F.filter(f"s_{k.name}", _holder(k.name)).alias(f"s_{k.name}") for k in KINDS))
    some = sum((F.size(f"s_{k.name}") for k in KINDS), F.lit(0)) > 0
    return df.withColumn("text", F.when(some, F.col("text")))


def _words(text: Column) -> Column:
    """Hashes of the text's different words."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda w: F.xxhash64(F.lower(w))))


def disclosing(docs: DataFrame, base: DataFrame, support: int = SUPPORT, disclosure: float = DISCLOSURE) -> DataFrame:
    """Distinct pairs th, term: text and word that discloses an entity of this text, judged over the whole corpus."""
    # explode_outer: explode would push a condition on its array down through all steps of blanking
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text")).withColumn("th", _hash()).dropDuplicates(["th"])
    n_t = cut(_blanked(texts).select(F.explode_outer(_words(F.col("text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n_t")))
    total = float(max(base.select("th").distinct().count(), 1))
    every = F.array_distinct(F.concat(*(F.transform(f"s_{k.name}", _entity_of(k.name)) for k in KINDS)))
    held = base.where("text is not null").select("th", F.explode(every).alias("entity")).distinct()
    # entities with the same texts: their number and two sums over the texts without carry
    same = F.xxhash64(F.count(F.lit(1)), F.bit_xor(F.xxhash64("th")), F.bit_xor(F.xxhash64("th", F.lit(1))))
    classes = held.groupBy("entity").agg(F.count(F.lit(1)).alias("n_c"), same.alias("class"))
    inside = cut(held.join(classes, "entity").select("th", "class", "n_c").distinct())
    rarest = F.pow(F.col("n_c"), F.lit(disclosure)) * total ** (1 - disclosure) * (1 + 1e-9)
    bound = inside.groupBy("th").agg(F.max(rarest).alias("bound"))
    # words of texts with entities, without those too common for any entity of the text
    words = base.where("text is not null").select("th", "text").groupBy("th").agg(F.any_value("text").alias("text"))
    words = _blanked(words).select("th", F.explode_outer(_words(F.col("text"))).alias("term")).join(bound, "th")
    words = words.join(n_t, "term").where(F.col("n_t") <= F.col("bound")).select("th", "term", "n_t")
    met = cut(words.join(inside, "th").where(F.col("n_t") <= rarest))
    pairs = met.groupBy("class", "term").agg(F.count(F.lit(1)).alias("n_ct"), F.first("n_c").alias("n_c"), F.first("n_t").alias("n_t"))
    ic = F.log(total / F.col("n_c"))
    pmi = F.log(F.col("n_ct") * total / (F.col("n_c") * F.col("n_t")))
    pairs = pairs.where(F.col("n_ct") >= support).where(pmi >= ic * disclosure - 1e-12).where(ic > 0).select("class", "term")
    return met.join(pairs, ["class", "term"]).select("th", "term").distinct()


def spans(docs: DataFrame, support: int = SUPPORT, disclosure: float = DISCLOSURE) -> DataFrame:
    """doc_id, h, the text where it has spans, and the sorted arrays base and every of struct(start, order, end, kind)."""
    base = cut(base_spans(docs))
    found = disclosing(docs, base, support, disclosure).groupBy("th").agg(F.collect_set("term").alias("marked"))
    # the words' places, once for each text
    texts = base.where("text is not null").select("th", "text").groupBy("th").agg(F.any_value("text").alias("text")).join(found, "th")
    texts = locate(_blanked(texts), "text", [Kind("w", WORD)], only=lambda w: F.array_contains("marked", F.xxhash64(F.lower(w))))
    terms = texts.select("th", tagged("s_w", len(KINDS), "term").alias("terms"))
    sorted_base = F.array_sort(F.concat(*(tagged(f"s_{k.name}", i, k.name) for i, k in enumerate(KINDS))))
    df = base.select("doc_id", "h", "th", "text", sorted_base.alias("base")).join(terms, "th", "left")
    none = F.filter("base", lambda s: F.lit(False))
    return df.select("doc_id", "h", "text", "base", F.array_sort(F.concat("base", F.coalesce("terms", none))).alias("every"))


def masked(df: DataFrame, text: str, every: str, name: str) -> DataFrame:
    """df with column name: the text with what the sorted spans of column every hold masked or generalised; null where
    there are none. Of spans that overlap, the first is shown. What is taken stands before the place reached, the
    largest end so far: the largest of the blocks before, each of about sqrt(n) of the n spans, and of the spans before it
    in its own block. So n spans cost n * sqrt(n) comparisons, and each character is copied once."""
    ends, tops, before, chars, block = (free_name(df, x) for x in ("ends", "tops", "before", "chars", "block"))
    some = F.coalesce(F.size(every), F.lit(0)) > 0
    n, size = F.col(block), F.size(ends)
    # each step refers to the last one's columns more than once, so the optimiser keeps them apart: within a
    # function over elements it would work them out for every element
    df = df.withColumn(ends, F.when(some, F.transform(every, lambda s: s["end"])))
    df = df.withColumn(block, F.when(some, block_of(F.col(ends))))
    df = df.withColumn(tops, F.when(size > 0, F.transform(F.sequence(F.lit(0), F.floor((size - 1) / n).cast("int")), lambda b: F.array_max(F.slice(ends, b * n + 1, n)))))
    df = df.withColumn(before, F.when(F.size(tops) > 0, F.transform(tops, lambda _, b: F.coalesce(F.array_max(F.slice(tops, F.lit(1), b)), F.lit(0)))))

    def reached(i: Column) -> Column:
        at = F.floor(i / n).cast("int")
        return F.greatest(F.get(before, at), F.coalesce(F.array_max(F.slice(ends, at * n + 1, i % n)), F.lit(0)))

    placed, part_of = free_name(df, "placed"), lambda start, end: F.array_join(F.slice(chars, start + 1, end - start), "")
    taken = F.transform(every, lambda s, i: F.struct(reached(i).alias("at"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    df = df.withColumn(placed, F.when(F.size(before) > 0, taken)).withColumn(chars, F.when(some, F.split(F.col(text), "")))

    def shown(s: Column) -> Column:
        value = part_of(s["start"], s["end"])
        general = F.when(value.rlike(r"\p{N}"), "[CODE]").when(value.rlike(r"^\p{Lu}"), "[NAME]").otherwise("")
        return F.when(s["kind"] == "term", general).otherwise(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))

    pieces = F.transform(F.filter(placed, lambda s: s["start"] >= s["at"]), lambda s: F.concat(part_of(s["at"], s["start"]), shown(s)))
    out = F.concat(F.array_join(pieces, ""), part_of(F.array_max(ends), F.size(chars)))
    return df.withColumn(name, F.when(F.size(placed) > 0, out)).drop(ends, block, tops, before, placed, chars)


def scan(docs: DataFrame, support: int = 1, disclosure: float = DISCLOSURE) -> DataFrame:
    """doc_id, counts of each kind, base_sha256, spans, and the sha256 of the text that is left once base kinds are masked
    and terms generalised or removed: null where the text stays as it is."""
    count = lambda kind: F.size(F.filter("every", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    df = masked(spans(docs, support, disclosure), "text", "every", "clean")
    return df.select("doc_id", *(count(k.name) for k in KINDS), count("term"), F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("every")).alias("spans"), F.sha2(F.encode("clean", "UTF-8"), 256).alias("sanitised_sha256"))


def sanitise(docs: DataFrame, support: int = SUPPORT, disclosure: float = DISCLOSURE) -> DataFrame:
    """The documents with entities masked by kind and disclosing terms generalised: words with a
    capital to [NAME], words with a digit to [CODE], others removed. Other columns stay."""
    # a condition on the masked text itself would be worked out from the start again at each of its steps
    found = masked(spans(docs, support, disclosure).where(F.size("every") > 0), "text", "every", "clean")
    marks = found.select(F.coalesce("doc_id", F.lit(-(2**63))).alias("k_id"), F.col("h").alias("k_h"), "clean").dropDuplicates(["k_id", "k_h"])
    row = free_name(docs, "whole_row")
    df = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias(row), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("k_id"), F.xxhash64(F.col("doc_id").isNull(), F.coalesce("text", F.lit(""))).alias("k_h"))
    df = df.join(marks, ["k_id", "k_h"], "left")
    return df.select(*(F.coalesce("clean", F.col(f"{row}.text")).alias("text") if c == "text" else F.col(f"{row}.`{c}`").alias(c) for c in docs.columns))
