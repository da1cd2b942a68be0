"""The registered query of each operator, its DuckDB statement where SQL can say it, and the pipeline."""
from __future__ import annotations

import os

import corpus_pipeline
from pyspark.sql import functions as F

from . import (decontaminate, divergence, language, lattice, mixing, packing, passages, quality, simhash, suffixes, toxicity, urls,
               whitening)
from .common import table

VOCABULARY = os.environ.get("LATTICE_VOCABULARY", "/opt/tokenizers/piece_bpe_32k.model")
PACKING_VOCABULARY = os.environ.get("PACKING_VOCABULARY", "/opt/tokenizers/word_bpe_49k.json")
LLM_QUERIES: dict = {}
LLM_ORACLES: dict[str, str] = {}


def registered(fn):
    LLM_QUERIES[fn.__name__] = fn
    return fn


@registered
def op10_mix_sources(spark, folder):
    """Words of each document that the mix takes."""
    mixed = mixing.mix_sources(table(spark, folder, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


LLM_ORACLES["op10_mix_sources"] = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('mix' || coalesce(doc_id::VARCHAR, '')) AS k
  FROM documents),
sources AS (SELECT source, sum(size)::HUGEINT AS s FROM sized GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM sources),
weighed AS (SELECT *, [5, 2, 1][(place % 3 + 1)::INT]::HUGEINT AS w, 3 * s AS cap FROM ranked),
summed AS (
  SELECT *, sum(s) OVER () - coalesce(sum(cap) OVER before, 0) AS num, sum(w) OVER () - coalesce(sum(w) OVER before, 0) AS den
  FROM weighed
  WINDOW before AS (ORDER BY s::DOUBLE / w::DOUBLE, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
judged AS (SELECT *, cap * den <= num * w AS capped FROM summed),
shared AS (SELECT max(den) AS fd, arg_max(num, den) AS fn FROM judged WHERE NOT capped),
targets AS (
  SELECT source, s, CASE WHEN capped THEN cap::DOUBLE ELSE fn::DOUBLE * w::DOUBLE / fd::DOUBLE END AS target
  FROM judged, shared),
placed AS (
  SELECT doc_id, size, k, t.s, t.target,
         coalesce(sum(size) OVER (PARTITION BY z.source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sized z JOIN targets t ON z.source IS NOT DISTINCT FROM t.source),
budgeted AS (SELECT *, least(floor(target + 0.5)::HUGEINT, 3 * s) AS budget FROM placed),
timed AS (SELECT *, CASE WHEN s > 0 THEN budget // s ELSE 0 END AS epochs FROM budgeted)
SELECT doc_id, size, s::BIGINT AS source_size, target,
       (epochs * size + greatest(0, least(size, budget - epochs * s - before)))::BIGINT AS taken
FROM timed
"""


@registered
def op1_url_filter(spark, folder):
    """Rule and verdict for every page url."""
    return urls.filter_urls(table(spark, folder, "pages"), urls.labelled_urls(spark), urls.RULES)


@registered
def op5_quality_rules(spark, folder):
    """Counts, base rules and the trees' verdict for every document."""
    return quality.judge_quality(table(spark, folder, "documents"), table(spark, folder, "labels"))


@registered
def op6_toxicity(spark, folder):
    """Toxicity score of every document."""
    return toxicity.score_toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))


@registered
def op4_language_id(spark, folder):
    """Predicted language of every document."""
    return language.identify_language(table(spark, folder, "documents"))


@registered
def op2_simhash(spark, folder):
    """Fingerprint and near-duplicate component of every document."""
    return simhash.simhash_components(table(spark, folder, "documents"))


@registered
def op9_decontaminate(spark, folder):
    """Documents that leak a benchmark item, also with new numbers, names or units."""
    return decontaminate.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@registered
def op3_substring_dedup(spark, folder):
    """Every sentence or line that repeats, exactly or nearly, every repeated run of 50 words or more, and which copy stays."""
    return passages.repeats(table(spark, folder, "documents"))


@registered
def op7_lm_score(spark, folder):
    """Count-model and lattice log-probabilities of every document."""
    return lattice.score_documents(table(spark, folder, "documents"), VOCABULARY)


@registered
def pipeline(spark, folder):
    """All stages of the pipeline over the documents."""
    return corpus_pipeline.run(spark, folder)


@registered
def op8_suffix_dedup(spark, folder):
    """Bytes of every document that an earlier document has already."""
    return suffixes.repeated_bytes(table(spark, folder, "documents")).drop("spans")


@registered
def op11_whitening(spark, folder):
    """Whitened components of every usable embedding, from exact cross-products."""
    return whitening.components_of(table(spark, folder, "embeddings"))


@registered
def op12_packing(spark, folder):
    """Pieces of every document in full sequences, with the checksum of their ids."""
    packed = packing.pack_documents(table(spark, folder, "documents"), PACKING_VOCABULARY)
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@registered
def op13_divergence(spark, folder):
    """Distances of the sources of a language, and the terms each source has most too many of."""
    return divergence.divergence(table(spark, folder, "documents"))


LLM_ORACLES["op13_divergence"] = r"""
WITH plain AS (
  SELECT row_number() OVER () AS row_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents),
found AS (SELECT row_id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM plain),
kept AS (SELECT lang, term FROM found GROUP BY lang, term HAVING count(DISTINCT row_id) >= 3),
sizes AS (SELECT lang, count(*)::HUGEINT AS v FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM plain),
counted AS (SELECT f.lang, f.source, f.term, count(*) AS n FROM found f JOIN kept k ON f.lang = k.lang AND f.term = k.term GROUP BY ALL),
dense AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0)::HUGEINT AS n, s.v
  FROM groups g JOIN kept k ON g.lang = k.lang JOIN sizes s ON g.lang = s.lang
  LEFT JOIN counted c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
shares AS (SELECT lang, source, term, n, (1 + (1000000000 * (n + 1)) // (sum(n) OVER (PARTITION BY lang, source)::HUGEINT + v))::HUGEINT AS p FROM dense),
whole AS (
  SELECT lang, term, (1 + (1000000000 * (n + 1)) // (sum(n) OVER (PARTITION BY lang)::HUGEINT + v))::HUGEINT AS q
  FROM (SELECT lang, term, sum(n)::HUGEINT AS n, max(v) AS v FROM dense GROUP BY lang, term)),
pairs AS (
  SELECT g.lang, g.source, o.source AS item, coalesce(d.value, 0) AS value
  FROM groups g JOIN groups o ON g.lang = o.lang AND g.source <> o.source
  LEFT JOIN (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
             FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL) d
    ON d.lang = g.lang AND d.source = g.source AND d.item = o.source),
terms AS (
  SELECT a.lang, a.source, a.term AS item, ((a.p - w.q) * (a.p - w.q)) // w.q AS value
  FROM shares a JOIN whole w ON a.lang = w.lang AND a.term = w.term WHERE a.n > 0 AND a.p > w.q),
ranked AS (
  SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
  UNION ALL
  SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) FROM terms)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""
