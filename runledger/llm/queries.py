"""One query per operator over its whole table, with SQL counterparts where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import alignment, ann, collocations, decontaminate, fingerprints, kd_shards, langid, licenses, mixing, near_dups, quality_nbsvm, token_files, url_rules
from .common import fold, scratch_path, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


LOWER_SQL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_RULE_ROWS = ", ".join(f"('{verdict}', '{rule}', '{rule.partition('/')[0]}', '/{rule.partition('/')[2]}')" for verdict, rule in URL_RULES)

# Association rules by counting every subset of the frequent tokens of a URL, one token of those in the same examples.
ORACLES["op1_url_rules"] = f"""
WITH rules(verdict, rule, site, start) AS (VALUES {_RULE_ROWS}),
p AS (SELECT row_number() OVER () AS row, page_id, coalesce(url, '') AS url,
             CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT *, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
v AS (SELECT *, string_split(host, '.') AS labels, regexp_extract(path, '([^/]*)/?$', 1) AS last FROM h),
t AS (SELECT row, page_id, host, path, list_distinct(list_filter([
        'scheme=' || lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]{{0,15}})://', 1)), 'top=' || labels[-1],
        'site=' || array_to_string(labels[greatest(len(labels) - 1, 1):], '.'),
        'form=' || CASE WHEN path = '' THEN 'none' WHEN ends_with(path, '/') THEN 'folder' WHEN regexp_matches(last, '^[0-9]+$') THEN 'number'
          WHEN regexp_matches(last, '\\.[A-Za-z0-9]{{1,5}}$') THEN '.' || regexp_extract(last, '\\.([A-Za-z0-9]{{1,5}})$', 1) ELSE 'name' END,
        'mark=' || CASE WHEN contains(url, '#') THEN 'yes' ELSE '' END]
        || list_transform(labels[:greatest(len(labels) - 2, 0)], lambda x: 'label=' || x)
        || list_transform(regexp_extract_all(path, '([^/]+)/', 1), lambda x: 'folder=' || x)
        || list_transform(regexp_extract_all(last, '[A-Za-z0-9]+'), lambda x: 'word=' || x)
        || list_transform(list_filter(string_split(regexp_extract(url, '^[^?#]*\\?([^#]*)', 1), '&'), lambda x: x <> '' AND NOT starts_with(x, '=')), lambda x: 'key=' || string_split(x, '=')[1]),
        lambda x: NOT ends_with(x, '='))) AS tokens FROM v),
found AS (SELECT row, arg_max(rule, (length(rule), rule)) AS rule, arg_max(verdict, (length(rule), rule)) AS verdict
          FROM t JOIN rules ON (host = site OR ends_with(host, '.' || site)) AND starts_with(path, start) GROUP BY row),
labelled AS (SELECT row, tokens, verdict FROM t JOIN found USING (row)),
size AS (SELECT count(*) AS n, greatest(ceil(0.002 * count(*)), 5) AS least FROM labelled),
single AS (SELECT token, list_sort(list(row)) AS rows FROM (SELECT row, unnest(tokens) AS token FROM labelled) GROUP BY token HAVING count(*) >= (SELECT least FROM size)),
telling AS (SELECT list(token) AS tokens FROM (SELECT min(token) AS token FROM single GROUP BY rows)),
baskets AS (SELECT list_sort(list_filter(labelled.tokens, lambda x: list_contains(telling.tokens, x))) AS tokens, verdict FROM labelled, telling),
subsets AS (SELECT list_filter(tokens, lambda x, i: (m >> (i - 1)) & 1 = 1) AS items, verdict
            FROM (SELECT *, unnest(range(1, CAST(pow(2, len(tokens)) AS BIGINT))) AS m FROM baskets)),
alone AS (SELECT items, count(*) AS n FROM subsets GROUP BY items),
shares AS (SELECT verdict, count(*) AS n FROM labelled GROUP BY verdict),
mined AS (SELECT s.items, s.verdict, s.n / a.n AS confidence, s.n / size.n AS support
          FROM (SELECT items, verdict, count(*) AS n FROM subsets GROUP BY items, verdict) s JOIN alone a USING (items) JOIN shares g USING (verdict), size
          WHERE s.n >= size.least AND s.n / a.n >= 0.8 AND s.n / a.n / (g.n / size.n) >= 1.05),
known AS (SELECT list(DISTINCT item) AS items FROM (SELECT unnest(items) AS item FROM mined)),
sets AS (SELECT DISTINCT list_sort(list_filter(tokens, lambda x: list_contains(known.items, x))) AS own FROM t, known WHERE row NOT IN (SELECT row FROM found)),
best AS (SELECT own, verdict, confidence, items FROM sets JOIN mined ON list_has_all(own, items)
         QUALIFY row_number() OVER (PARTITION BY own ORDER BY confidence DESC, support DESC, len(items) DESC, verdict DESC, items DESC) = 1)
SELECT page_id, host, path, found.rule, coalesce(found.verdict, best.verdict, 'allow') AS verdict,
       CASE WHEN found.row IS NULL THEN best.confidence END AS confidence, CASE WHEN found.row IS NULL THEN array_to_string(best.items, ' ') END AS because
FROM t LEFT JOIN found USING (row) LEFT JOIN known ON true
LEFT JOIN best ON best.own = list_sort(list_filter(t.tokens, lambda x: list_contains(known.items, x)))
"""

ORACLES["op5_decontaminate"] = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS row, regexp_extract_all({LOWER_SQL}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM documents),
i AS (SELECT item_id, regexp_extract_all({LOWER_SQL}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM benchmark),
wins AS (SELECT DISTINCT item_id, least(10, len(words)) AS n, array_to_string(words[k:k + 9], ' ') AS win
         FROM (SELECT *, unnest(range(1, greatest(len(words) - 9, 1) + 1)) AS k FROM i WHERE len(words) > 0)),
sizes AS (SELECT DISTINCT n FROM wins),
runs AS (SELECT row, n, p, array_to_string(words[p:p + n - 1], ' ') AS win
         FROM (SELECT row, words, n, unnest(range(1, len(words) - n + 2)) AS p FROM d, sizes WHERE len(words) >= n)),
hits AS (SELECT row, p, n, item_id FROM runs JOIN wins USING (n, win)),
covered AS (SELECT row, count(DISTINCT q) AS n_hit FROM (SELECT row, unnest(range(p, p + n)) AS q FROM hits) GROUP BY row),
named AS (SELECT row, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT CAST(item_id AS VARCHAR))), ',') AS items
          FROM hits GROUP BY row)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (row) LEFT JOIN named USING (row)
"""

ORACLES["op6_near_dups"] = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({LOWER_SQL}, '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(words[k:k + 3], ' ') || CASE WHEN len(words) < 4 THEN ' ' || len(words) ELSE '' END AS shingle
      FROM (SELECT *, unnest(range(1, greatest(len(words) - 3, 1) + 1)) AS k FROM d WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT doc_id, doc_id AS other FROM d UNION SELECT doc_id, b FROM reach JOIN edges ON other = a),
named AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM named LEFT JOIN n USING (doc_id)
"""


_TREE_SQL = """list_transform(string_split({0}, chr(10) || chr(10)), lambda s: sha256(array_to_string(list_transform(string_split(s, chr(10)), lambda p: sha256(p)), '')))"""
_ROOT_SQL = f"sha256(array_to_string({_TREE_SQL}, ''))"
_PHRASES_SQL = f"regexp_extract_all({{0}}, '{fingerprints.PHRASE}')"
_LIKE_SQL = """CASE WHEN r{0} = r{1} THEN 1.0::DOUBLE ELSE greatest(
  2 * len(list_intersect(p{0}, p{1})) / greatest(len(list_distinct(p{0})) + len(list_distinct(p{1})), 1),
  len(list_filter(range(1, least(len(p{0}), len(p{1})) + 1), lambda i: p{0}[i] = p{1}[i])) / greatest(len(p{0}), len(p{1}), 1)) END"""

# Phrases are compared as texts here.
ORACLES["op11_fingerprints"] = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(lead(coalesce(text, '')) OVER w, first(coalesce(text, '')) OVER (ORDER BY doc_id)) AS next_text
           FROM documents WINDOW w AS (ORDER BY doc_id)),
e AS (SELECT *, length(text) AS n, left(text, length(text) - length(text) // 4) || left(next_text, length(text) // 4) AS edited FROM d),
t AS (SELECT doc_id, n, sha256(edited) AS edited_sha256, {_ROOT_SQL.format('text')} AS r0, {_ROOT_SQL.format('edited')} AS r1, {_ROOT_SQL.format('next_text')} AS r2,
             {_PHRASES_SQL.replace('{0}', 'text', 1)} AS p0, {_PHRASES_SQL.replace('{0}', 'edited', 1)} AS p1, {_PHRASES_SQL.replace('{0}', 'next_text', 1)} AS p2 FROM e)
SELECT doc_id, n AS n_chars, edited_sha256, r0 AS fingerprint, r1 AS edited_fingerprint, {_LIKE_SQL.format(0, 1)} AS near_edited, {_LIKE_SQL.format(0, 2)} AS near_next FROM t
"""

ORACLES["op12_collocations"] = """
WITH p AS (SELECT coalesce(lang, 'und') AS lang,
                  unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
           FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS words FROM p),
n AS (SELECT lang, sum(len(words)) AS n FROM w GROUP BY lang),
g AS (SELECT lang, size, words[k:k + size - 1] AS words, count(*) AS a
      FROM (SELECT lang, words, size, unnest(range(1, len(words) - size + 2)) AS k FROM w, (VALUES (1), (2), (3)) s(size)) GROUP BY ALL),
f AS (SELECT * FROM g WHERE a >= 10),
cuts AS (SELECT f.lang, f.words, f.a, k, x.a AS l, y.a AS r, (1000000 * f.a::HUGEINT * f.a) // (x.a::HUGEINT * y.a) AS score
         FROM (SELECT *, unnest(range(1, size)) AS k FROM f WHERE size > 1) f JOIN f x ON x.lang = f.lang AND x.words = f.words[:k]
         JOIN f y ON y.lang = f.lang AND y.words = f.words[k + 1:]),
lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, words ORDER BY score, k) = 1),
longer AS (SELECT lang, part AS words, max(a) AS longer FROM (SELECT lang, a, unnest([words[:2], words[2:]]) AS part FROM f WHERE size = 3) GROUP BY ALL),
kept AS (SELECT lang, array_to_string(words, ' ') AS phrase, a, l, r, score FROM lowest LEFT JOIN longer USING (lang, words) WHERE coalesce(100 * longer < 50 * a, true)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[function.__name__] = function
    return function


@query
def op1_url_rules(spark: SparkSession, folder: str) -> DataFrame:
    return url_rules.judge(table(spark, folder, "pages"), URL_RULES)


@query
def op2_quality_nbsvm(spark: SparkSession, folder: str) -> DataFrame:
    return quality_nbsvm.quality(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query
def op3_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query
def op4_token_files(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    path = scratch_path(spark, "tokens")
    token_files.write_tokens(table(spark, folder, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return token_files.manifest(token_files.read_tokens(spark, path))


@query
def op5_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"), size=10).drop("hits", "items")


@query
def op6_near_dups(spark: SparkSession, folder: str) -> DataFrame:
    return near_dups.near_duplicates(table(spark, folder, "documents"), width=4, percent=80)


@query
def op7_kd_shards(spark: SparkSession, folder: str) -> DataFrame:
    return (kd_shards.shard(table(spark, folder, "documents"), shards=8)
            .withColumn("law", F.lit("bytes")).withColumn("grown_shard", F.lit(None).cast("int")))


@query
def op8_licenses(spark: SparkSession, folder: str) -> DataFrame:
    """Per document: its licenses, how many places, the least similar place, and whether every place has a template's exact words."""
    found = licenses.scan(table(spark, folder, "documents"))
    return found.select("doc_id", F.size("found").cast("bigint").alias("n_found"),
                        F.array_join(F.array_sort(F.array_distinct(F.col("found.license"))), ",").alias("licenses"),
                        F.array_min("found.similarity").alias("least_similarity"),
                        F.forall("found", lambda x: x["similarity"] == 1.0).alias("exact"))


@query
def op9_ann(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    return ann.search(vectors, vectors.filter("vec_id % 100 = 0"))


@query
def op10_langid(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    model = langid.fit(documents.filter(fold("doc_id", 3) != 1))
    held_out = F.coalesce(fold("doc_id", 3) == 1, F.lit(False)).alias("held_out")
    return langid.predict(documents, model, [F.col("doc_id"), held_out]).select("doc_id", "held_out", "lang_pred", "score", "ambiguous")


@query
def op11_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.edited(table(spark, folder, "documents"))


@query
def op12_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(table(spark, folder, "documents"))


@query
def op13_alignment(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    aligned = alignment.align(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    return aligned.documents().drop("groups")
