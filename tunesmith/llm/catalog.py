"""Registered queries of the training-data operators, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tunesmith.llm import bpe, exact_dedup, language, licenses, line_dedup, merkle, packing, periodic, quality, rules, simhash, topk, toxicity
from tunesmith.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Production parameters.
TOKENIZER = "word_bpe_49k.json"
SEQUENCE_TOKENS = 2048
SIMHASH_SHINGLE, SIMHASH_BITS = 3, 2
QUALITY_BAR, TOXICITY_BAR = 0.7, 0.5


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def vocabulary() -> bpe.Vocabulary:
    return bpe.vocabulary_from(public_tokenizers.path(TOKENIZER))


@query("op4_simhash_near_dedup")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document (no SQL: DuckDB has no XXH64)."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=SIMHASH_SHINGLE, max_bits=SIMHASH_BITS)


@query("op6_exact_dedup", r"""
with t as (
  select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as norm from documents
)
select doc_id, min(doc_id) over w as keep_id, count(*) over w as group_size,
  doc_id is not distinct from min(doc_id) over w and row_number() over (partition by norm, doc_id) = 1 as kept,
  sha256(norm) as text_sha256
from t window w as (partition by norm)
""")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact duplicates of every document's normalised text."""
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


@query("op9_bpe_round_trip")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count and digests of the ids and of the decoded text of every document."""
    return bpe.round_trip_digests(table(spark, sf_dir, "documents"), vocabulary())


@query("op10_best_fit_packing")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's token pieces with their sequence and offset."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary(), SEQUENCE_TOKENS)


@query("op1_exact_topk", r"""
with e as (
  select vec_id, [floor(64 * cast(x as double)) for x in embedding] as w from embeddings
  where vec_id is not null and embedding is not null
    and len([x for x in embedding if x is null or not isfinite(x)]) = 0
), s as (
  select q.vec_id as query_id, e.vec_id, cast(list_inner_product(q.w, e.w) as bigint) as score
  from e q join e on e.vec_id <> q.vec_id where q.vec_id % 20 = 0
), r as (
  select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank from s
)
select query_id, rank, vec_id, score from r where rank <= 20
""")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best other vectors of every vector whose id is divisible by 20."""
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def not_held_out(parts: int, held: int):
    """Rows whose crc32 of the id as text leaves another remainder than ``held``."""
    return lambda c: F.crc32(c.cast("string").cast("binary")) % parts != held


def _scored(found: DataFrame, parts: int, held: int, bar: float) -> DataFrame:
    out = F.coalesce(~not_held_out(parts, held)(F.col("doc_id")), F.lit(False))
    more = [c for c in found.columns if c not in ("doc_id", "score")]
    return found.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= bar).cast("int").alias("predicted"), *more)


@query("op2_quality_classifier")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document; labels with crc32(doc_id) mod 4 = 2 are held out (no SQL: a trained model)."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.fit(docs, labels, "quality", not_held_out(4, 2))
    return _scored(quality.score(docs, model), 4, 2, QUALITY_BAR)


@query("op3_toxicity")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document; labels with crc32(doc_id) mod 5 = 0 are held out (no SQL: a trained model)."""
    docs = table(spark, sf_dir, "documents")
    return _scored(toxicity.score(docs, toxicity_model(spark, docs, sf_dir)), 5, 0, TOXICITY_BAR)


def toxicity_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> toxicity.ToxicityModel:
    return toxicity.fit(docs, table(spark, sf_dir, "labels"), "toxic", not_held_out(5, 0))


@query("op7_line_dedup")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dropped lines of every document (no SQL: MinHash candidates and union-find)."""
    return line_dedup.line_report(table(spark, sf_dir, "documents"))


@query("op5_language_id")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every web page; the text model learns from the labelled documents (no SQL: a trained model)."""
    model = language.fit(table(spark, sf_dir, "documents"))
    found = language.identify(language.pages(table(spark, sf_dir, "pages")), model, markup=True)
    return found.withColumnRenamed("id", "page_id")


@query("op8_license_scan")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence of every document, stored under source/lang/id.txt (no SQL: windows of lines and TF-IDF vectors)."""
    docs = table(spark, sf_dir, "documents")
    path = F.concat_ws("/", F.coalesce("source", F.lit("unknown")), F.coalesce("lang", F.lit("unknown")),
                       F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(".txt")))
    found = licenses.scan(docs.select(F.col("doc_id").alias("id"), path.alias("path"), "text"))
    return found.withColumnRenamed("id", "doc_id")


def _merkle_sql(levels: int = 24, group_levels: int = 12) -> str:
    """The manifest level by level, for up to 2**levels rows a language and 2**group_levels languages.

    DuckDB has no crc32: it is folded over the digits of the id, one bit at a time.
    """
    leaf = "sha256(" + " || ".join(
        f"coalesce(strlen(cast({c} as varchar)) || ':' || cast({c} as varchar), '-')"
        for c in ("doc_id", "source", "lang", "n_chars", "text")) + ")"
    bit = "lambda x, k: xor(x >> 1, 3988292384 * (x & 1))"
    crc = f"""xor(4294967295, list_reduce([cast(4294967295 as bigint)] || [cast(ascii(c) as bigint) for c in string_split(cast(doc_id as varchar), '')],
      lambda a, b: list_reduce([xor(a, b)] || [cast(k as bigint) for k in range(8)], {bit})))"""
    sql = [f"""with t as (
  select row_number() over () as r, *, {leaf} as leaf,
    doc_id is not null and {crc} % 7 = 0 as hit from documents
), u as (
  select r, doc_id, leaf, case when hit then {leaf.replace("cast(n_chars as varchar)", "cast(n_chars + 1 as varchar)")} else leaf end as shown,
    dense_rank() over (order by lang nulls first) - 1 as g,
    row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as i, count(*) over (partition by lang) as n from t
), l0 as (select g, i, n, leaf as h from u)"""]
    step = "case when any_value(n) = 1 then any_value(h) else sha256(string_agg(h, '' order by i)) end"
    for k in range(levels):
        sql.append(f"l{k + 1} as (select g, i // 2 as i, (any_value(n) + 1) // 2 as n, {step} as h from l{k} group by g, i // 2)")
    sql.append(f"m0 as (select 0 as g, g as i, count(*) over () as n, h from l{levels})")
    for k in range(group_levels):
        sql.append(f"m{k + 1} as (select g, i // 2 as i, (any_value(n) + 1) // 2 as n, {step} as h from m{k} group by g, i // 2)")
    nodes = [f"select {k} as lev, g, i, n, h from l{k}" for k in range(levels)]
    nodes += [f"select {levels + k} as lev, g, i, n, h from m{k}" for k in range(group_levels)]
    sql.append("nodes as (" + " union all ".join(nodes) + ")")
    sql.append(f"""spots as (
  select r, lev, case when lev < {levels} then g else 0 end as g, case when lev < {levels} then i >> lev else g >> (lev - {levels}) end as i
  from u, (select unnest(range({levels + group_levels})) as lev)
), steps as (
  select s.r, s.lev, s.i, b.h as sib, b.i < s.i as is_left from spots s join nodes a on a.lev = s.lev and a.g = s.g and a.i = s.i and a.n > 1
  left join nodes b on b.lev = s.lev and b.g = s.g and b.i = xor(s.i, 1)
), lists as (
  select r, list(coalesce(sib, '') order by lev) as sibs, list(coalesce(is_left, false) order by lev) as lefts from steps group by r
)""")
    fold = "list_reduce([shown] || [(case when lefts[k] then 'l' else 'r' end) || sibs[k] for k in range(1, len(sibs) + 1)],"            " lambda a, b: sha256(case when b[1] = 'l' then b[2:] || a else a || b[2:] end))"
    sql.append(f"""v as (
  select doc_id, leaf, (select h from l{levels} x where x.g = u.g) as subroot, (select h from m{group_levels}) as root,
    sha256(coalesce(array_to_string(sibs, ''), '')) as proof_sha256, coalesce({fold}, shown) as folded_root
  from u left join lists using (r)
)
select *, folded_root = root as verified from v""")
    return ",\n".join(sql)


@query("op13_merkle_manifest", _merkle_sql())
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, subroot, root and proof of every document; where 7 divides the crc32 of the id, one n_chars is tampered with."""
    docs = table(spark, sf_dir, "documents")
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.lit(False))
    shown = merkle.digest_of(*[(F.col(c) + hit.cast("long")) if c == "n_chars" else F.col(c) for c in columns])
    found = merkle.manifest(docs, columns, keep={"shown": shown}).withColumn("folded_root", merkle.fold(F.col("shown"), F.col("path")))
    return found.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("path")).alias("proof_sha256"), "folded_root",
                        (F.col("folded_root") == F.col("root")).alias("verified"))


def with_planted_period(text, key):
    """Texts whose id has a crc32 divisible by ten, with the words from one place on made periodic (null text: as it is).

    Each value that is used twice is bound by a lambda, so that no word list is made more than once a row.
    """
    def bind(value, body):
        return F.transform(F.array(value), body)[0]

    def periodic_words(words):
        n = F.size(words).cast("long")
        a = F.pmod(F.floor(key / 10).cast("long"), n)
        p = F.lit(1).cast("long") + F.floor((n - a) / (F.lit(3) + F.pmod(F.floor(key / 10).cast("long"), F.lit(8)))).cast("long")
        return bind(F.struct(a.alias("a"), p.alias("p")), lambda x: F.array_join(F.transform(
            F.sequence(F.lit(0).cast("long"), n - 1),
            lambda i: F.get(words, F.when(i < x["a"], i).otherwise(x["a"] + F.pmod(i - x["a"], x["p"])).cast("int"))), " "))

    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    changed = bind(words, lambda w: F.when(F.size(w) > 0, periodic_words(w)).otherwise(F.lit("")))
    return F.when((key % 10 == 0) & text.isNotNull(), changed).otherwise(text)


@query("op11_periodic_runs")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of every document, a tenth of them made periodic first (no SQL: suffix order)."""
    docs = table(spark, sf_dir, "documents")
    key = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    found = periodic.find_runs(docs.select("doc_id", with_planted_period(F.col("text"), key).alias("text")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    found = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"),
                         F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    length, period = F.col("best.length"), -F.col("best.period")
    return found.select("doc_id", "n_runs", (-F.col("best.start")).alias("start"), length.alias("length"), period.alias("period"),
                        F.expr("1000 * best.length div -best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


#: Fewer words, or a larger share of repeated ones, fail before any vote; above the bar a document stays.
LEAST_WORDS, MOST_REPEATED, RULES_BAR = 50, 50, 0.5


@query("op12_quality_rules")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every document and whether its rules' votes keep it (no SQL: expectation-maximisation)."""
    found = rules.judge(table(spark, sf_dir, "documents"))
    failed = (F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MOST_REPEATED)
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
                        (~failed & (F.col("quality") >= RULES_BAR)).alias("kept"), "quality", "votes")
