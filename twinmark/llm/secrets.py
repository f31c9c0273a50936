"""Secret scans with built-in functions only.

Base kinds are fixed patterns: assignments to telling names, access keys, long hexadecimal runs.
The method adds `markov` spans: two first-order character models, one of random strings and one of
ordinary identifiers, give each long token a log-likelihood ratio; tokens above a threshold that
aren't in a base span are secrets too. The models are bigram counts over an alphabet of 66
symbols, so they are bounded at any size and travel as a constant.

Training samples carry labels: random are what the base patterns catch in the sampled documents and
strings drawn by a hash from the usual alphabets; ordinary are the sampled documents' other words
and identifiers. The sample of documents is bounded by train_rows, by hash of id and text.

Null texts are empty. Rows with equal ids are scanned one by one. An empty table trains on the drawn
strings alone and gives no rows. Columns of any other names pass through redact() unchanged.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinmark.llm.common import free_name
from twinmark.llm.spans import Kind, listed, locate, replaced, tagged

# The base patterns. Where a pattern says {n,}, shorter matches fail as a whole.
ASSIGN = r"""(?=[pPsStTaA])(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
VALUE = r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)$"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
TOKEN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
WORD = r"(?<![A-Za-z0-9+/_=-])[A-Za-z_][A-Za-z0-9_-]{5,}"

BASE = [
    Kind("assign", ASSIGN, "instr({text}, '=') > 0 or instr({text}, ':') > 0"),
    Kind("access", ACCESS, "instr({text}, 'AKIA') > 0"),
    Kind("hex", HEX),
]
TRAIN_ROWS, DRAWN = 20_000, 2_000
THRESHOLD, DISTINCT, SMOOTH = 20.0, 10, 8.0
MASK = "[SECRET]"


def _bigrams(tokens: DataFrame) -> dict[str, int]:
    """Counts of the pairs of characters in column t: at most the alphabet squared."""
    pair = F.explode(F.transform(F.sequence(F.lit(2), F.size("c")), lambda i: F.concat(F.element_at("c", i - 1), F.element_at("c", i))))
    words = tokens.where(F.length("t") > 1).groupBy("t").agg(F.count(F.lit(1)).alias("n"))  # words repeat: their pairs are counted once and weighted
    rows = words.select(F.split("t", "").alias("c"), "n").select(pair.alias("pair"), "n").groupBy("pair").agg(F.sum("n").alias("count")).collect()
    return {r.pair: r["count"] for r in rows}


def train(docs: DataFrame, train_rows: int = TRAIN_ROWS, drawn: int = DRAWN) -> str:
    """The table of log-likelihood ratios, as text: row and column 0 stand for any other character."""
    spark = docs.sparkSession
    total = max(docs.count(), 1)
    sample = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(total)) < train_rows).select(F.coalesce("text", F.lit("")).alias("t"))
    caught = F.concat(*(F.regexp_extract_all("t", F.lit(p), F.lit(0)) for p in (ACCESS, HEX)), F.transform(F.regexp_extract_all("t", F.lit(ASSIGN), F.lit(0)), lambda m: F.regexp_extract(m, VALUE, 1)))
    sha = F.sha2(F.col("id").cast("string"), 256)
    raw = F.base64(F.unhex(sha))
    own = spark.range(drawn).select(F.explode(F.array(raw, F.upper(F.regexp_replace(raw, "[^A-Za-z0-9]", "")), F.translate(raw, "+/", "-_"), F.regexp_replace(raw, "[^A-Za-z0-9]", ""), F.substring(sha, 1, 40))).alias("t"))
    random = _bigrams(sample.select(F.explode(caught).alias("t")).where(F.length("t") >= 16).unionByName(own))
    cleared = F.regexp_replace(F.regexp_replace("t", ASSIGN, " "), HEX, " ")
    plain = _bigrams(sample.select(F.explode(F.regexp_extract_all(cleared, F.lit(WORD), F.lit(0))).alias("t")).where(~F.col("t").rlike("^AKIA|[0-9].*[A-Za-z].*[0-9]")))

    def logs(counts: dict[str, int]) -> dict[str, float]:
        """Log P(b | a), smoothed by how often b stands anywhere: a context never seen tells that much."""
        after: dict[str, int] = {}
        any_: dict[str, int] = {}
        for p, n in counts.items():
            after[p[0]] = after.get(p[0], 0) + n
            any_[p[1]] = any_.get(p[1], 0) + n
        total, k = sum(any_.values()), len(ALPHABET)
        p1 = {b: (any_.get(b, 0) + 0.5) / (total + 0.5 * k) for b in ALPHABET}
        return {a + b: math.log((counts.get(a + b, 0) + SMOOTH * p1[b]) / (after.get(a, 0) + SMOOTH)) for a in ALPHABET for b in ALPHABET}

    r, q = logs(random), logs(plain)
    symbols = [None, *ALPHABET]
    return ",".join("0" if a is None or b is None else f"{r[a + b] - q[a + b]:.4f}" for a in symbols for b in symbols)


def ratio(token: Column, table: str) -> Column:
    """The token's log-likelihood ratio of random over ordinary."""
    llr, side = F.split(F.lit(table), ",").cast("array<double>"), len(ALPHABET) + 1
    at = F.transform(F.split(token, ""), lambda c: F.instr(F.lit(ALPHABET), c))
    step = lambda acc, x: F.struct((acc["sum"] + F.when(acc["last"] < 0, 0.0).otherwise(F.element_at(llr, acc["last"] * side + x + 1))).alias("sum"), x.alias("last"))
    return F.aggregate(at, F.struct(F.lit(0.0).alias("sum"), F.lit(-1).alias("last")), step, lambda acc: acc["sum"])


def is_random(token: Column, table: str, threshold: float) -> Column:
    """Above the threshold, and of enough different characters to be no ruler or filler."""
    return (F.size(F.array_distinct(F.split(token, ""))) >= DISTINCT) & (ratio(token, table) >= threshold)


def masking(assigned, whole) -> list:
    """Functions of a text that put assigned(match) and whole(match) in the place of its base matches."""
    fits = lambda m: F.length(F.regexp_extract(m, VALUE, 1)) >= 6
    return [
        lambda t: replaced(t, ASSIGN, lambda m: F.when(fits(m), assigned(m)).otherwise(m), (F.instr(t, "=") > 0) | (F.instr(t, ":") > 0)),
        lambda t: replaced(t, ACCESS, whole, F.instr(t, "AKIA") > 0),
        lambda t: replaced(t, HEX, whole),
    ]


def scan(docs: DataFrame, table: str | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_markov, base_sha256, spans; reads doc_id and text only."""
    table = table or train(docs)
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    df = locate(df, "text", BASE)
    value = lambda s: F.regexp_extract(s["value"], VALUE, 1)
    df = df.withColumn("s_assign", F.filter("s_assign", lambda s: F.length(value(s)) >= 6))
    df = df.select("*", F.array_sort(F.concat(*(tagged(f"s_{k.name}", i, k.name) for i, k in enumerate(BASE)))).alias("base"))
    # tokens are looked for where no base span is: those are blanked, places stay
    for step in masking(lambda m: F.repeat(F.lit(" "), F.length(m)), lambda m: F.repeat(F.lit(" "), F.length(m))):
        df = df.withColumn("text", step(F.col("text")))
    df = locate(df, "text", [Kind("token", TOKEN)]).drop("text")
    df = df.withColumn("s_token", F.filter("s_token", lambda t: is_random(t["value"], table, threshold)))
    everything = F.array_sort(F.concat("base", tagged("s_token", len(BASE), "markov")))
    n = lambda k: F.size(f"s_{k}").cast("long")
    return df.select("doc_id", *(n(k.name).alias(f"n_{k.name}") for k in BASE), n("token").alias("n_markov"), F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(everything).alias("spans"))


def redact(docs: DataFrame, table: str | None = None, threshold: float = THRESHOLD, mask: str = MASK) -> DataFrame:
    """The documents with secrets masked; of an assignment the name stays. n_chars, if there, is set
    to the new length where the text changed."""
    table = table or train(docs)
    new = free_name(docs, "masked")
    t = F.col("text")
    name = lambda m: F.regexp_extract(m, VALUE, 1)
    steps = masking(lambda m: F.concat(F.left(m, F.length(m) - F.length(name(m))), F.lit(mask)), lambda m: F.lit(mask))
    steps.append(lambda t: replaced(t, TOKEN, lambda m: F.when(is_random(m, table, threshold), F.lit(mask)).otherwise(m)))
    df = docs.withColumn(new, t)
    for f in steps:
        df = df.withColumn(new, f(F.col(new)))
    out = [F.when(F.col(new) == t, F.col(c)).when(t.isNull(), F.col(c)).otherwise(F.length(new).cast(docs.schema[c].dataType)).alias(c) if c == "n_chars" else F.col(new).alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns]
    return df.select(*out)
