"""Language identification of web pages by fusing evidence (operator 10)."""

from __future__ import annotations

import html as entities
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import cut
from .textops import LOWER, runs

#: Buckets that byte trigrams are hashed into; the text model has this many numbers for each language.
BUCKETS = 1 << 13
#: Languages a model may have, at most.
MAX_LANGUAGES = 256
#: Overlapping trigrams tell the same thing about three times.
TRIGRAM_WEIGHT = 1 / 3
#: Posterior shares are added up as whole parts of this, so that sums don't depend on their order.
UNIT = 1_000_000

_DROP = re.compile(r"(?is)<!--.*?-->|<(script|style|nav|header|footer|aside|noscript|template)\b[^>]*>.*?</\1\s*>|<(?:title|head)\b[^>]*>.*?</(?:title|head)\s*>")
_TAG = re.compile(r"(?s)<[^>]*>")
_DECLARED = re.compile(r"""(?is)<html\b[^>]*?\slang\s*=\s*["']?\s*([a-z]{2,8})""")


def page_text(page: str | None) -> str:
    """The text of a page without its head, scripts, navigation and tags."""
    return " ".join(entities.unescape(_TAG.sub(" ", _DROP.sub(" ", page or ""))).split())


def declared_language(page: str | None) -> str:
    """The first subtag of the html element's lang attribute, in lower case; empty without one."""
    found = _DECLARED.search(page or "")
    return found[1].lower() if found else ""


def trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all byte trigrams inside a text, and the text's number for each."""
    if len(data) < 3:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    b = LOWER[data].astype(np.uint32)
    code = (b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * np.uint32(2654435761)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    inside = owner[:-2] == owner[2:]
    return (code[inside] >> np.uint32(32 - 13)).astype(np.int64), owner[:-2][inside]


def fit_text_model(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages, and log probabilities of trigram buckets for each: counted over all labelled texts.

    Each task adds up its own texts, and the sums are grouped by language and bucket. Rows without language or text don't count.
    """

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column(1).to_pylist(), dtype=object)
            for a, b, data, offsets in runs(batch.column(0)):
                names, which = np.unique(langs[a:b].astype(str), return_inverse=True)
                bucket, owner = trigrams(data, offsets)
                for i, name in enumerate(names):
                    own = sums.setdefault(name, np.zeros(BUCKETS, np.int64))
                    own += np.bincount(bucket[which[owner] == i], minlength=BUCKETS)
        for name, own in sums.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(own[at], pa.int64())], names=["lang", "bucket", "n"])

    known = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    counted = cut(known.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")))
    languages = sorted(r["lang"] for r in counted.select("lang").distinct().limit(MAX_LANGUAGES + 1).collect())
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    table = np.full((len(languages), BUCKETS), 0.5)
    for r in counted.collect():  # at most BUCKETS numbers for each language
        table[languages.index(r["lang"]), r["bucket"]] += r["n"]
    return languages, np.log(table / table.sum(axis=1, keepdims=True))


def identify(
    pages: DataFrame, languages: list[str], model: np.ndarray, smoothing: float = 2.0,
    id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
) -> DataFrame:
    """(page_id, lang, confidence, text_lang, declared, host) of each page.

    The posterior over ``languages`` is the product of: the likelihood of the page's text; that of its declared
    language, from how often pages of each language (by their text) declare which; and the prior of its
    host. A host's prior is its pages' summed text posteriors, the page itself left
    out, smoothed by that of its domain, in turn by that of its address suffix, and that by all pages': each level adds
    ``smoothing`` pages of the level above. All counts are grouped sums over all pages.

    Null or empty html: no text and nothing declared, so the host decides. Null or bad url: the host is
    empty, a host like any other. Languages declared but not known count as one, and so do missing
    declarations. Repeated rows count each. Ties go to the language first in
    order. Without languages, lang is null and confidence 0. Columns other than the three are not read.
    """
    n = len(languages)
    if not n:
        return pages.select(F.col(id_col).alias("page_id"), F.lit(None).cast("string").alias("lang"), F.lit(0.0).alias("confidence"),
                            F.lit(None).cast("string").alias("text_lang"), F.lit("").alias("declared"), F.lit("").alias("host"))

    def read(batches):
        weights = np.ascontiguousarray(model.T)
        for batch in batches:
            texts, tags = [], []
            for x in batch.column(1):
                page = x.as_py()
                texts.append(page_text(page))
                tags.append(declared_language(page))
            out = np.zeros((len(texts), n))
            for a, b, data, offsets in runs(pa.array(texts, pa.large_string()), 1 << 20):
                bucket, owner = trigrams(data, offsets)
                for i in range(n):
                    out[a:b, i] = np.bincount(owner, weights[bucket, i], b - a) * TRIGRAM_WEIGHT
            likely = np.exp(out - out.max(axis=1, keepdims=True))
            parts = np.rint(likely / likely.sum(axis=1, keepdims=True) * UNIT).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(tags, pa.string()), batch.column(2),
                 pa.array(list(out - out.max(axis=1, keepdims=True)), pa.list_(pa.float64())), pa.array(list(parts), pa.list_(pa.int64()))],
                names=["page_id", "declared", "host", "text_log", "parts"],
            )

    host = F.coalesce(F.lower(F.regexp_extract(F.col(url_col), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(html_col).alias("html"), host.alias("host"))
    rows = cut(rows.mapInArrow(read, "page_id long, declared string, host string, text_log array<double>, parts array<long>"))

    def total(df: DataFrame, *keys: str) -> DataFrame:
        sums = [F.sum(F.col("parts")[i]).alias(f"p{i}") for i in range(n)]
        return df.groupBy(*keys).agg(*sums).select(*keys, F.array(*[F.col(f"p{i}") for i in range(n)]).alias("parts"))

    # declared languages: a table of n + 2 columns, for the known ones, others and none
    code = F.when(F.col("declared") == "", n + 1).otherwise(F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, languages)), F.col("declared")), F.lit(0)) - 1, F.lit(n))).cast("int")
    rows = rows.withColumn("code", code)
    told = np.full((n, n + 2), 0.5)
    told[np.arange(n), np.arange(n)] += 1
    for r in total(rows, "code").collect():  # n + 2 rows
        told[:, r["code"]] += np.array(r["parts"]) / UNIT
    told = np.log(told / told.sum(axis=1, keepdims=True))

    by_host = cut(total(rows, "host")).withColumn("domain", F.regexp_extract("host", r"([^.]*\.)?[^.]*$", 0)).withColumn("suffix", F.regexp_extract("host", r"[^.]*$", 0))
    by_domain = cut(total(by_host, "suffix", "domain"))
    by_suffix = cut(total(by_domain, "suffix"))
    everything = by_suffix.agg(*[F.coalesce(F.sum(F.col("parts")[i]), F.lit(0)).alias(f"p{i}") for i in range(n)]).first()
    whole = np.array([everything[i] for i in range(n)], float) / UNIT
    top = (whole + smoothing / n) / (whole.sum() + smoothing)

    def smoothed(parts, above):
        count = F.aggregate(parts, F.lit(0).cast("bigint"), lambda s, x: s + x) / UNIT
        return F.zip_with(parts, above, lambda x, y: (x / UNIT + smoothing * y) / (count + smoothing))

    suffix = by_suffix.select(F.col("suffix").alias("s"), smoothed(F.col("parts"), F.array(*[F.lit(float(x)) for x in top])).alias("above"))
    domain = by_domain.join(suffix, F.col("suffix") == F.col("s")).select(F.col("domain").alias("d"), smoothed(F.col("parts"), F.col("above")).alias("above"))
    hosts = by_host.join(domain, F.col("domain") == F.col("d")).select(F.col("host").alias("h"), F.col("parts").alias("host_parts"), "above")

    joined = rows.join(hosts, F.col("host") == F.col("h"))
    others = F.zip_with("host_parts", "parts", lambda x, y: x - y)
    names = np.array(languages, dtype=object)

    def fuse(frames):
        for f in frames:
            if not len(f):
                continue
            text = np.stack(f["text_log"].to_numpy())
            z = text + told[:, f["code"].to_numpy()].T + np.log(np.stack(f["prior"].to_numpy()))
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            yield f[["page_id"]].assign(
                lang=names[p.argmax(axis=1)], confidence=np.round(p.max(axis=1), 6), text_lang=names[text.argmax(axis=1)], declared=f["declared"], host=f["host"]
            )

    return joined.select("page_id", "code", "declared", "host", "text_log", smoothed(others, F.col("above")).alias("prior")).mapInPandas(
        fuse, "page_id long, lang string, confidence double, text_lang string, declared string, host string"
    )


def op10_language_id(spark, sf_dir: str) -> DataFrame:
    languages, model = fit_text_model(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return identify(spark.read.parquet(f"{sf_dir}/pages.parquet"), languages, model)
