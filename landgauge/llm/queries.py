"""The subpackage's queries over the given tables, one per operator, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landgauge.llm import fingerprint, htmltext, langid, linededup, mixing, ngram_join, packing, repair, runs, substring, topk, toxicity, warc
from landgauge.llm.scratch import prepare


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


# Domains that the labels table tells apart, and the weights that op6 mixes them to.
DOMAIN_WEIGHTS = {"good": 0.85, "low": 0.10, "toxic": 0.05}


def labelled_domains(labels: DataFrame) -> DataFrame:
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "low")
    return labels.select("doc_id", domain.alias("domain"))


def op1_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every stretch of 20 words and more that repeats, with the occurrence that stays."""
    return substring.repeats(table(spark, folder, "documents"))


def op2_warc_index(spark: SparkSession, folder: str) -> DataFrame:
    """Every page archived, found through the capture index and read back."""
    read = warc.archive_and_read(table(spark, folder, "pages"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document."""
    return langid.identify(table(spark, folder, "documents"))


def op4_html_text(spark: SparkSession, folder: str) -> DataFrame:
    """page_id, url, text, n_lines: the visible text of every page."""
    pages = htmltext.extract(table(spark, folder, "pages").select("page_id", "url", "html"))
    return pages.withColumn("n_lines", F.when(F.col("text") == "", 0).otherwise(F.size(F.split("text", "\n"))))


def op5_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    return toxicity.score(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op6_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, tokens, posterior, rate, copies of every document; domains in the order of DOMAIN_WEIGHTS."""
    docs = table(spark, folder, "documents")
    rated = mixing.mix(docs, labelled_domains(table(spark, folder, "labels")), DOMAIN_WEIGHTS)
    return mixing.per_document(docs, rated)


def op7_exact_topk(spark: SparkSession, folder: str) -> DataFrame:
    """query_id, rank, vec_id, score: the 5 best inner products of every 50th vector."""
    return topk.top_k(table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0)


OP7_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as e from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
pairs as (
  select q.vec_id as query_id, c.vec_id, list_dot_product(q.e, c.e)::bigint as score
  from v q join v c on q.vec_id <> c.vec_id and q.vec_id % 50 = 0),
ranked as (
  select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from pairs)
select query_id, rank, vec_id, score from ranked where rank <= 5
"""


def op8_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's token pieces with their places in the packed sequences."""
    return packing.pack(table(spark, folder, "documents"))


def op9_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprints of every text and its edited text, with their likeness."""
    return fingerprint.compare_edited(table(spark, folder, "documents"))


def op10_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, class_id, class_size, n_links of every document at 5-word Jaccard 0.8."""
    return ngram_join.jaccard_join(table(spark, folder, "documents")).select("doc_id", "class_id", "class_size", "n_links")


def op11_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Number of runs, the run of most periods and digests of every damaged document."""
    return runs.run_digests(table(spark, folder, "documents"))


def op12_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    """Faults, cheapest audit and digest of the repaired rows of every damaged conversation."""
    return repair.repair(table(spark, folder, "conversations"), damaged=True)


def op13_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Number of lines, lines dropped and digest of the others for every document."""
    return linededup.line_digests(table(spark, folder, "documents"))


OP13_SQL = r"""
with docs as (select row_number() over () as r, doc_id, coalesce(text, '') as text from documents),
lines as (
  select r, generate_subscripts(string_split(text, chr(10)), 1) as pos, unnest(string_split(text, chr(10))) as line from docs),
keyed as (
  select *, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from lines),
common as (select key from keyed where key <> '' group by key having count(distinct r) >= 10),
told as (select r, pos, line, (key in (select key from common)) as gone from keyed),
kept as (
  select r, count(*)::bigint as n_lines, count_if(gone)::bigint as n_dropped,
    coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '') as text from told group by r)
select doc_id, n_lines, n_dropped, sha256(kept.text) as kept_sha256 from docs join kept using (r)
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_warc_index": op2_warc_index,
    "op3_language_id": op3_language_id,
    "op4_html_text": op4_html_text,
    "op5_toxicity": op5_toxicity,
    "op6_mix_sources": op6_mix_sources,
    "op7_exact_topk": op7_exact_topk,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_fingerprints": op9_fingerprints,
    "op10_ngram_jaccard_join": op10_ngram_jaccard_join,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_line_dedup": op13_line_dedup,
}

ORACLES: dict[str, str] = {"op7_exact_topk": OP7_SQL, "op13_line_dedup": OP13_SQL}
