"""Language identification by Bayesian evidence fusion.

Four kinds of evidence are multiplied: the likelihood of the text (hashed character trigrams), the
language that the markup declares, the suffix of the address, and a prior of the host that is
smoothed towards its domain and the whole collection. The text model is trained on a bounded
labelled sample; all other tables are grouped sums of the texts' posteriors over all rows.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tunesmith.llm.features import mix, segments, text_groups
from tunesmith.session import materialize

BUCKETS_LOG2 = 16
#: The text model is fit on about so many labelled rows of each language (a sample by the hash of the id).
SAMPLE_PER_LANGUAGE = 1_500
#: Trigrams of one text depend on each other: they weigh together as at most so many independent ones.
FULL_WEIGHT = 60
HOST_ROWS, DOMAIN_ROWS = 10.0, 10.0  # weight of the smoothing prior, in rows
ACCEPT = 0.7

_BLOCK = re.compile(r"<(script|style|noscript|template)\b", re.IGNORECASE)
_CLOSED = {tag: re.compile(rf"</{tag}\s*>", re.IGNORECASE) for tag in ("script", "style", "noscript", "template")}
_CLOSED["!--"] = re.compile("-->")
_WORD = np.array([chr(c).isalpha() for c in range(0x10000)])


def visible_text(markup: str) -> str:
    """The text of a page without comments, scripts, styles and tags, in one pass.

    What opens a comment or block that nothing closes is a plain tag; what opens a tag that nothing closes is text. A
    closing mark that was once not found is not looked for again.
    """
    out, at, missing = [], 0, set()
    while (start := markup.find("<", at)) >= 0:
        block = _BLOCK.match(markup, start)
        kind = "!--" if markup.startswith("<!--", start) else block.group(1).lower() if block else None
        end = -1
        if kind and kind not in missing:
            close = _CLOSED[kind].search(markup, start + (4 if kind == "!--" else len(kind) + 1))
            if close is None:
                missing.add(kind)
            else:
                end = close.end()
        if end < 0:
            end = markup.find(">", start) + 1
            if not end:
                break
        out.append(markup[at:start])
        at = end
    out.append(markup[at:])
    return html.unescape(" ".join(out))


class Trigrams:
    """Buckets of the character trigrams around every letter of many texts."""

    def __init__(self, buckets_log2: int = BUCKETS_LOG2) -> None:
        self.shift = np.uint64(64 - buckets_log2)

    def __call__(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(bucket, part number) of every trigram; what is not a letter is a space."""
        joined = "\n\n".join(p.lower() for p in parts) if len(parts) > 1 else parts[0].lower()
        points = np.frombuffer(f"\n{joined}\n".encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = np.where(points < 0x10000, _WORD[np.minimum(points, 0xFFFF)], True)
        c = np.where(letter, points, 32).astype(np.uint64)
        at = np.flatnonzero(letter)
        h = mix((c[at - 1] * np.uint64(0x1FFFFF) + c[at]) * np.uint64(0x1FFFFF) + c[at + 1])
        ends = np.cumsum([len(p.lower()) + 2 for p in parts])
        return (h >> self.shift).astype(np.int64), np.searchsorted(ends, at, side="right")


@dataclass
class TextModel:
    """Log probability of every trigram bucket in every language."""

    languages: list[str]
    log_p: np.ndarray  # languages x buckets

    def log_likelihoods(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(trigrams, tempered log likelihood by language) of each text, however long."""
        n, total = np.zeros(len(texts), np.int64), np.zeros((len(texts), len(self.languages)))
        trigrams = Trigrams()
        for owner, parts in segments(texts):
            bucket, part = trigrams(parts)
            row = np.array(owner)[part]
            n += np.bincount(row, minlength=len(texts))
            for k in range(len(self.languages)):
                total[:, k] += np.bincount(row, self.log_p[k][bucket], minlength=len(texts))
        return n, total * np.minimum(1, FULL_WEIGHT / n.clip(1))[:, None]


def fit(docs: DataFrame, language_col: str = "lang", id_col: str = "doc_id", text_col: str = "text",
        per_language: int = SAMPLE_PER_LANGUAGE) -> TextModel:
    """Count trigrams by label over a bounded sample. Rows without id, label or text are not used.

    Every label that has rows is a language, however rare; the model holds 2**16 numbers for each.
    """
    known = docs.select(F.col(id_col).alias("id"), F.lower(F.col(language_col)).alias("lang"), F.col(text_col).alias("text")) \
        .where("id is not null and lang is not null and text is not null")
    counts = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    kept = {r.lang: r.n for r in counts.collect()}
    languages = sorted(kept)
    if not languages:
        return TextModel([], np.zeros((0, 1 << BUCKETS_LOG2), np.float32))
    # a row is in the sample if its hash falls into its language's share; no language is gathered to be ranked
    share = F.create_map(*[x for k, n in kept.items() for x in (F.lit(k), F.lit(min(1.0, per_language / n)))])
    position = F.pmod(F.xxhash64("id"), F.lit(1_000_000)) / 1_000_000
    sample = known.where(F.col("lang").isin(languages)).where(position < F.element_at(share, F.col("lang")))

    def count(batches):
        trigrams, tables = Trigrams(), {}
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for at, texts in text_groups(batch.column(1)):
                for owner, parts in segments(texts):
                    bucket, part = trigrams(parts)
                    row = np.array(owner)[part]
                    for lang in set(langs[at:at + len(texts)]):
                        of = np.array([x == lang for x in langs[at:at + len(texts)]])
                        table = tables.setdefault(lang, np.zeros(1 << BUCKETS_LOG2, np.int64))
                        table += np.bincount(bucket[of[row]], minlength=len(table))
        for lang, table in tables.items():
            at = np.flatnonzero(table)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at)), pa.array(at.astype(np.int32)), pa.array(table[at])], names=["lang", "bucket", "n"])

    sums = sample.select("lang", "text").mapInArrow(count, "lang string, bucket int, n long") \
        .groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    found = np.full((len(languages), 1 << BUCKETS_LOG2), 0.5)
    for r in sums.toLocalIterator():  # at most languages x buckets rows
        found[languages.index(r.lang), r.bucket] += r.n
    return TextModel(languages, np.log(found / found.sum(axis=1, keepdims=True)).astype(np.float32))


def text_evidence(rows: DataFrame, model: TextModel, markup: bool) -> DataFrame:
    """(id, host, domain, suffix, declared, n, ll): ``rows`` (id, text, host, declared) with the text's evidence."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for batch in batches:
            for at, texts in text_groups(batch.column(1)):
                n, ll = m.log_likelihoods([visible_text(t) for t in texts] if markup else texts)
                offsets = pa.array(np.arange(len(texts) + 1, dtype=np.int32) * len(m.languages))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(texts)), batch.column(2).slice(at, len(texts)), batch.column(3).slice(at, len(texts)),
                     pa.array(n), pa.ListArray.from_arrays(offsets, pa.array(ll.ravel()))], names=["id", "host", "declared", "n", "ll"])

    kind = rows.schema["id"].dataType
    schema = T.StructType([T.StructField("id", kind), T.StructField("host", T.StringType()), T.StructField("declared", T.StringType()),
                           T.StructField("n", T.LongType()), T.StructField("ll", T.ArrayType(T.DoubleType()))])
    seen = rows.select("id", "text", "host", "declared").mapInArrow(run, schema)
    return seen.select("id", "host", F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1).alias("domain"),
                       F.regexp_extract("host", r"\.([^.0-9][^.]*)$", 1).alias("suffix"), "declared", "n", "ll")


def _softmax(df: DataFrame, scores: list[str], out: list[str]) -> DataFrame:
    """Columns ``out``: the scores' share of probability. Each step is a projection of its own, so none is computed twice."""
    df = df.withColumn("_top", F.greatest(*scores) if len(scores) > 1 else F.col(scores[0]))
    df = df.withColumns({c: F.exp(F.col(s) - F.col("_top")) for s, c in zip(scores, out)})
    df = df.withColumn("_sum", sum((F.col(c) for c in out[1:]), F.col(out[0])))
    return df.withColumns({c: F.col(c) / F.col("_sum") for c in out}).drop("_top", "_sum")


def identify(rows: DataFrame, model: TextModel, markup: bool = False, accept: float = ACCEPT) -> DataFrame:
    """One row per row of ``rows`` (id, text, host, declared): id, language, confidence, accepted, text_language, declared, n_trigrams.

    ``markup`` strips pages to their visible text. A missing (null or empty) host, suffix or declared
    language is no evidence. A row is accepted if its text has a letter and the posterior of its best
    language reaches ``accept``; a text without letters (null and empty too) has language 'und', and
    what remains of the evidence as confidence. Ties go to the first language in alphabetical order. Rows that
    repeat stay rows; other columns are not read; an empty table gives no rows. Without a trained
    language all rows are 'und'.

    The tables of hosts, domains, suffixes and declared languages are partial aggregates of all rows
    and are joined back on their keys, stored first, so that a hot host's rows are split.
    """
    langs = model.languages
    base = text_evidence(rows, model, markup)
    if not langs:
        return base.select("id", F.lit("und").alias("language"), F.lit(0.0).alias("confidence"), F.lit(False).alias("accepted"),
                           F.lit("und").alias("text_language"), "declared", F.col("n").alias("n_trigrams"))
    # without trigrams all log likelihoods are zero, and the posterior of the text is even
    p, ll = [f"p{k}" for k in range(len(langs))], [f"ll{k}" for k in range(len(langs))]
    base = base.select("id", "host", "domain", "suffix", "declared", "n", *[F.col("ll")[k].alias(c) for k, c in enumerate(ll)])
    ev = materialize(_softmax(base, ll, p), "evidence")
    sums = [F.sum(c).alias(c) for c in p]
    whole = ev.agg(F.count(F.lit(1)).alias("n"), *sums).first()
    glob = [((whole[c] or 0) + 1) / (whole["n"] + len(langs)) for c in p]

    def grouped(key: str) -> DataFrame:
        return ev.where(F.col(key).isNotNull() & (F.col(key) != "")).groupBy(key).agg(F.count(F.lit(1)).alias(f"{key}_n"), *[F.sum(c).alias(f"{key}_{c}") for c in p])

    # hierarchical host prior: whole collection -> domain -> host
    domains = grouped("domain").select("domain", *[
        ((F.col(f"domain_{c}") + DOMAIN_ROWS * g) / (F.col("domain_n") + DOMAIN_ROWS)).alias(f"d_{c}") for c, g in zip(p, glob)])
    hosts = grouped("host").withColumn("domain", F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1)).join(domains, "domain", "left") \
        .select("host", "host_n", *[F.col(f"host_{c}") for c in p], *[F.coalesce(f"d_{c}", F.lit(g)).alias(f"d_{c}") for c, g in zip(p, glob)])
    hosts = materialize(hosts, "hosts")

    def likelihood(key: str) -> DataFrame:
        """P(value | language), smoothed by one row spread over the values."""
        table = materialize(grouped(key), f"of-{key}")
        values = table.count()
        got = table.agg(*[F.sum(f"{key}_{c}").alias(c) for c in p]).first()
        return materialize(table.select(key, *[
            F.log((F.col(f"{key}_{c}") + 1.0 / (values + 1)) / ((got[c] or 0) + 1)).alias(f"{key}_l{k}") for k, c in enumerate(p)]), f"log-{key}")

    out = ev.join(hosts, "host", "left").join(likelihood("declared"), "declared", "left").join(likelihood("suffix"), "suffix", "left")
    scores = {}
    for k, (c, g) in enumerate(zip(p, glob)):
        # the row's own text counts once, so it is taken out of its host's sums
        prior = (F.col(f"host_{c}") - F.col(c) + HOST_ROWS * F.col(f"d_{c}")) / (F.col("host_n") - 1 + HOST_ROWS)
        scores[f"s{k}"] = F.col(f"ll{k}") + F.log(F.coalesce(F.greatest(prior, F.lit(1e-9)), F.lit(g))) \
            + F.coalesce(f"declared_l{k}", F.lit(0.0)) + F.coalesce(f"suffix_l{k}", F.lit(0.0))
    fused = [f"f{k}" for k in range(len(langs))]
    out = _softmax(out.select("id", "declared", "n", *p, *[x.alias(s) for s, x in scores.items()]), list(scores), fused)

    def best(columns: list[str]) -> Column:
        ranked = [F.struct(F.col(x).alias("p"), F.lit(-k).alias("first"), F.lit(lang).alias("lang")) for k, (x, lang) in enumerate(zip(columns, langs))]
        return F.greatest(*ranked) if len(ranked) > 1 else ranked[0]

    out = out.select("id", "declared", "n", best(fused).alias("best"), best(p).alias("text"))
    has_text = F.col("n") > 0
    return out.select(
        "id", F.when(has_text, F.col("best.lang")).otherwise("und").alias("language"), F.col("best.p").alias("confidence"),
        (has_text & (F.col("best.p") >= accept)).alias("accepted"),
        F.when(has_text, F.col("text.lang")).otherwise("und").alias("text_language"), "declared", F.col("n").alias("n_trigrams"))


def host_of(url: Column) -> Column:
    """The lower-case host of an address; null where there is none."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))
    return F.when(host != "", host)


def declared_language(markup: Column) -> Column:
    """The primary language of the root element's lang attribute; null where there is none."""
    lang = F.lower(F.regexp_extract(markup, r"""(?is)<html\b[^>]*?\s(?:xml:)?lang\s*=\s*["']?([a-z]{2,3})\b""", 1))
    return F.when(lang != "", lang)


def pages(table: DataFrame, id_col: str = "page_id", url_col: str = "url", markup_col: str = "html") -> DataFrame:
    """Rows for ``identify`` from web pages."""
    return table.select(F.col(id_col).alias("id"), F.col(markup_col).alias("text"), host_of(F.col(url_col)).alias("host"),
                        declared_language(F.col(markup_col)).alias("declared"))


def labelled_documents(table: DataFrame, id_col: str = "doc_id", text_col: str = "text", language_col: str = "lang",
                       source_col: str = "source") -> DataFrame:
    """Rows for ``identify`` from plain documents: the language column is what is declared, the source is the host."""
    return table.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.lower(F.col(source_col)).alias("host"),
                        F.lower(F.col(language_col)).alias("declared"))
