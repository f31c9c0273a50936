"""Language of web pages by fusing evidence in Bayes' way.

For each language L the log posterior of a page is the sum of
  - its text: log likelihood under L's model of characters of any script (see ngrams.py), tempered,
    since neighbouring n-grams are no independent witnesses;
  - the language that the markup declares: log P(declared | L);
  - the address suffix: log P(suffix | L);
  - its host: log prior of L on the host, smoothed by its domain, which is smoothed by the whole web.
The last three come from sums of the pages' text posteriors, grouped by declared language, suffix,
domain and host. A page's own posterior is taken out of its host's and domain's sums, so no page is its
own witness.

The text models are fitted on a bounded sample of labelled documents (train_rows, by hash of id and text).
Everything else covers all pages. Declared languages are those listed or "other"; suffixes are
two-letter ones or "generic": both tables are bounded and travel as constants. Hosts and domains are
joined, where Spark can split one that holds a third of the pages. Null or empty html has no text;
null addresses have no host; such a page still gets what the other evidence says. Rows that repeat
are pages each. Equal posteriors go to the language listed first. Very long pages take time in proportion to
their length. An empty table gives no rows. Needs page_id, url, html; other columns are not read, whatever
their names.
"""

from __future__ import annotations

import html as markup
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinmark.llm import ngrams, quality
from twinmark.llm.common import cut, ship, slices

TRAIN_ROWS, TEMPER, STRENGTH = 20_000, 0.1, 4.0
_HIDDEN = ("script", "style", "nav", "template", "noscript")
_OPEN = re.compile(rf"(?i)<(?:!--|({'|'.join(_HIDDEN)})\b)")
_CLOSE = re.compile(rf"(?i)</({'|'.join(_HIDDEN)})\s*>")
_SAYS = re.compile(r"(?i)<(html|meta)\b[^>]*")
_LANG = re.compile(r"""(?i)\blang\s*=\s*["']?\s*([a-z]{2,3})\b""")
_EQUIV = re.compile(r"""(?i)http-equiv\s*=\s*["']?content-language""")
_CONTENT = re.compile(r"""(?i)content\s*=\s*["']?\s*([a-z]{2,3})\b""")
_HOST = re.compile(r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)")


def visible(html: str) -> str:
    """The page's text without scripts, styles, navigation, comments and tags, in time linear in the page:
    what is opened and never closed is looked for once, and stays."""
    ends = {name: [] for name in _HIDDEN}
    for m in _CLOSE.finditer(html):
        ends[m[1].lower()].append(m.end())
    out, at, look, used = [], 0, 0, dict.fromkeys(_HIDDEN, 0)
    comments = html.rfind("-->")
    while m := _OPEN.search(html, look):
        if m[1] is None:
            end = html.find("-->", m.end()) + 3 if m.end() <= comments else 0
        else:
            name = m[1].lower()
            own, k = ends[name], used[name]
            while k < len(own) and own[k] <= m.end():
                k += 1
            used[name] = k
            end = own[k] if k < len(own) else 0
        look = end or m.end()
        if end:
            out.append(html[at : m.start()])
            at = end
    text = " ".join([*out, html[at:]])
    last = text.rfind(">")
    parts, at = [], 0
    while 0 <= (start := text.find("<", at)) < last:
        parts.append(text[at:start])
        at = text.find(">", start) + 1
    return markup.unescape(" ".join([*parts, text[at:]]))


def declared(html: str, languages: tuple[str, ...]) -> str | None:
    """The language that the markup declares, "other" if it isn't listed, None if it declares none."""
    m = meta = None
    for tag in _SAYS.finditer(html):
        if tag[1].lower() == "html":
            if m := _LANG.search(html, tag.end(1), tag.end()):
                break
        elif meta is None and (equiv := _EQUIV.search(html, tag.end(1), tag.end())):
            meta = _CONTENT.search(html, equiv.end(), tag.end())
    m = m or meta
    return None if m is None else m[1].lower() if m[1].lower() in languages else "other"


def address(url: str) -> tuple[str | None, str | None, str | None]:
    """(host, domain, suffix) of an address."""
    m = _HOST.match(url)
    if m is None:
        return None, None, None
    labels = m[1].lower().strip(".").split(".")
    last = labels[-1]
    return ".".join(labels), ".".join(labels[-2:]), last if len(last) == 2 and last.isascii() and last.isalpha() else "generic"


def train(docs: DataFrame, languages: tuple[str, ...] = quality.LANGUAGES, train_rows: int = TRAIN_ROWS) -> ngrams.Model:
    """Text models of the languages from at most about train_rows labelled documents."""
    ship(docs.sparkSession)
    total = max(docs.count(), 1)
    sample = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(total)) < train_rows).where(F.col("lang").isin(*languages))
    return ngrams.train(sample.select("text", "lang"), languages)


def evidence(pages: DataFrame, model: ngrams.Model, languages: tuple[str, ...] = quality.LANGUAGES, temper: float = TEMPER) -> DataFrame:
    """page_id, host, domain, suffix, declared, and text: the tempered log likelihood of each language,
    the highest set to 0."""
    ship(pages.sparkSession)
    held = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = held.value.store()
        for whole in batches:
            for b in slices(whole, "html"):
                raw = [h or "" for h in b.column("html").to_pylist()]
                g = ngrams.grams([visible(h) for h in raw])
                keys, rows, n, end = g.keys(), np.arange(len(g.at)), g.n, np.cumsum(g.n)
                each = []
                for s in range(len(languages)):
                    total = np.concatenate([[0], np.cumsum(store.log_p(s, g, keys, rows))])
                    each.append((total[end] - total[end - n]) * temper)
                text = np.stack(each, 1)
                text -= text.max(1, keepdims=True)
                host, domain, suffix = zip(*(address(u or "") for u in b.column("url").to_pylist()), strict=True)
                yield pa.record_batch([b.column("page_id"), *(pa.array(x, pa.string()) for x in (host, domain, suffix, [declared(h, languages) for h in raw])), pa.array(text.tolist(), pa.list_(pa.float64()))], ["page_id", "host", "domain", "suffix", "declared", "text"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, "page_id long, host string, domain string, suffix string, declared string, text array<double>")


def _softmax(logs: Column, n: int) -> Column:
    top = F.array_max(logs)
    e = F.transform(logs, lambda x: F.exp(x - top))
    total = F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
    return F.transform(e, lambda x: x / total)


def _sums(df: DataFrame, by: list[str], n: int) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.array(*(F.sum(F.col("post")[i]) for i in range(n))).alias("sums"))


def identify(pages: DataFrame, model: ngrams.Model, languages: tuple[str, ...] = quality.LANGUAGES, temper: float = TEMPER, strength: float = STRENGTH) -> DataFrame:
    """page_id, lang, confidence, and what went into it: text_lang (null without text), declared, suffix, host.

    strength: pages' worth of smoothing that each level of the host hierarchy gets from the next."""
    k = len(languages)
    seen = cut(evidence(pages, model, languages, temper))
    df = seen.withColumn("post", _softmax(F.col("text"), k))

    def table(column: str) -> tuple[Column, list[float]]:
        """Log P(value | language) of a bounded column as a constant map, and the column's total sums."""
        rows = _sums(df.where(F.col(column).isNotNull()), [column], k).collect()  # bounded: see the module's text
        total = np.array([r["sums"] for r in rows]).sum(0) if rows else np.zeros(k)
        logs = {r[column]: np.log((np.array(r["sums"]) + 0.5) / (total + 0.5 * (len(rows) + 1))) for r in rows}
        if not rows:
            return F.array(*[F.lit(0.0)] * k), total.tolist()
        entries = [x for v, p in logs.items() for x in (F.lit(v), F.array(*(F.lit(float(y)) for y in p)))]
        return F.coalesce(F.create_map(*entries)[F.col(column)], F.array(*[F.lit(0.0)] * k)), total.tolist()

    said, _ = table("declared")
    ends, _ = table("suffix")
    everyone = _sums(df, [], k).first()
    n_all = everyone["n"] or 0
    base = [((everyone["sums"][i] or 0.0) + 1.0) / (n_all + k) for i in range(k)]
    domains = cut(_sums(df.where("domain is not null"), ["domain"], k).select("domain", F.col("n").alias("d_n"), F.col("sums").alias("d_sums")))
    hosts = cut(_sums(df.where("host is not null"), ["host", "domain"], k).select("host", F.col("n").alias("h_n"), F.col("sums").alias("h_sums")))
    df = df.join(hosts, "host", "left").join(domains, "domain", "left")

    def smoothed(i: int, base_i: float) -> Column:
        own = F.col("post")[i]
        dom = (F.greatest(F.col("d_sums")[i] - own, F.lit(0.0)) + strength * base_i) / (F.col("d_n") - 1 + strength)
        dom = F.coalesce(dom, F.lit(base_i))
        return F.coalesce((F.greatest(F.col("h_sums")[i] - own, F.lit(0.0)) + strength * dom) / (F.col("h_n") - 1 + strength), F.lit(base_i))

    df = df.withColumn("prior", F.array(*(smoothed(i, base[i]) for i in range(k))))
    logs = F.array(*(F.col("text")[i] + said[i] + ends[i] + F.log(F.col("prior")[i]) for i in range(k)))
    df = df.withColumn("fused", _softmax(logs, k))
    names = F.array(*map(F.lit, languages))
    best = lambda c: F.get(names, (F.array_position(c, F.array_max(c)) - 1).cast("int"))
    return df.select("page_id", best(F.col("fused")).alias("lang"), F.round(F.array_max("fused"), 6).alias("confidence"), F.when(F.array_min("text") < 0, best(F.col("text"))).alias("text_lang"), "declared", "suffix", "host")
