"""Queries of the training-data operators over the given tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import divergence, fingerprints, idfiles, langid, licenses, mixing, neardup, negatives, neighbours, packing, pii, tokencount, urls
from tessella.llm.common import new_folder, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


@query(
    "op1_mix_sources",
    r"""WITH sized AS (
      SELECT doc_id, source, coalesce('0' || source, '1') AS sk,
        coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint AS size, md5(coalesce(doc_id::varchar, '')) AS key
      FROM documents),
    per AS (SELECT sk, sum(size)::bigint AS source_size FROM sized GROUP BY sk),
    weighed AS (SELECT *, ((row_number() OVER (ORDER BY sk) - 1) % 3 + 1)::bigint AS weight, source_size * 3 AS top FROM per),
    levels AS (
      SELECT *, ((sum(source_size) OVER ())::bigint - coalesce(sum(top) OVER before, 0)::bigint)::double
              / ((sum(weight) OVER ())::bigint - coalesce(sum(weight) OVER before, 0)::bigint)::double AS level
      FROM weighed WINDOW before AS (ORDER BY top / weight, sk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    aims AS (SELECT sk, source_size, least(top::double, max(level) OVER () * weight) AS target FROM levels),
    placed AS (
      SELECT s.*, a.source_size, a.target, round(a.target)::bigint AS due,
        coalesce(sum(s.size) OVER (PARTITION BY s.sk ORDER BY s.key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::bigint AS begin
      FROM sized s JOIN aims a USING (sk))
    SELECT doc_id, source, size, source_size, target,
      CASE WHEN source_size = 0 THEN 0 ELSE due // source_size * size + greatest(0, least(size, due % source_size - begin)) END::bigint AS taken
    FROM placed""",
)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents"))


@query(
    "op2_near_duplicates",
    r"""WITH words AS (
      SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
    shingles AS (
      SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
        WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM words),
    sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
    common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
    link AS (
      SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
    ends AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
    reach AS (
      WITH RECURSIVE r(d, o) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.d, ends.b FROM r JOIN ends ON ends.a = r.o) SELECT d, min(o) AS component_id FROM r GROUP BY d)
    SELECT d.doc_id, coalesce(n, 0)::bigint AS n_shingles, component_id, d.doc_id = component_id AS kept
    FROM documents d LEFT JOIN sizes USING (doc_id) JOIN reach ON reach.d = d.doc_id""",
)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=85).drop("cls", "h", "g")


RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


@query(
    "op3_url_filter",
    r"""WITH cut AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
    parts AS (
      SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
    hit AS (
      SELECT *, CASE WHEN '.' || host LIKE '%.example.net' AND path LIKE '/en/%' THEN 'example.net/en/'
        WHEN '.' || host LIKE '%.example.com' AND path LIKE '/de/%' THEN 'example.com/de/'
        WHEN '.' || host LIKE '%.org' AND path LIKE '/fr/%' THEN 'org/fr/'
        WHEN '.' || host LIKE '%.net' AND path LIKE '/%' THEN 'net/' END AS rule FROM parts)
    SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM hit""",
)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages").select("page_id", "url"), RULES).drop("url")


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file; the operators take it as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op4_token_files")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = idfiles.write_token_files(table(spark, sf_dir, "documents"), new_folder(spark, "token-ids"), vocabulary("byte_bpe_50k.json"))
    return idfiles.read_token_files(shards)


@query("op7_license_scan")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).drop("spans")


@query("op8_personal_data")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


@query("op10_language_id")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.fit(docs))


@query("op9_pack_sequences")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


@query("op6_fingerprints")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(table(spark, sf_dir, "documents"))


@query("op5_nearest_vectors")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


@query("op11_count_tokens")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


@query(
    "op12_source_divergence",
    r"""WITH words AS (
      SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term
      FROM documents),
    kept AS (SELECT lang, term, count(*)::bigint AS n FROM words GROUP BY lang, term HAVING count(DISTINCT d) >= 10),
    counts AS (SELECT lang, source, term, count(*)::bigint AS n FROM words SEMI JOIN kept USING (lang, term) GROUP BY ALL),
    size AS (SELECT lang, count(*)::bigint AS v, sum(n)::bigint AS n FROM kept GROUP BY lang),
    groups AS (
      SELECT g.lang, g.source, coalesce(sum(c.n), 0)::bigint AS n
      FROM (SELECT DISTINCT coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents) g LEFT JOIN counts c USING (lang, source) GROUP BY ALL),
    shares AS (
      SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000 * (coalesce(c.n, 0) + 2)) // (g.n + 2 * s.v) AS p, 1 + (1000000000 * (k.n + 2)) // (s.n + 2 * s.v) AS whole
      FROM groups g JOIN kept k USING (lang) JOIN size s USING (lang) LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
    prices AS (
      SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p))::bigint AS value
      FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
    pairs AS (
      SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::bigint AS value
      FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN prices p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source),
    terms AS (SELECT lang, source, 'term' AS part, term AS item, (((p - whole) * (p - whole)) // (p + whole))::bigint AS value FROM shares WHERE n > 0 AND p > whole),
    ranked AS (
      SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::int AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
    SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 10""",
)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


@query(
    "op13_hard_negatives",
    r"""WITH r AS (
      SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::double)) AS v
      FROM embeddings
      WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (
      SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::bigint AS score
      FROM r a JOIN r b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
    p AS (
      SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
    SELECT p.anchor_id, positive_id, (row_number() OVER w)::int AS rank, s.vec_id AS negative_id, positive_score, s.score AS negative_score
    FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT same AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score
    WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) QUALIFY row_number() OVER w <= 10""",
)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    relabel = F.expr("CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END")
    return negatives.mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, relabel=relabel)
