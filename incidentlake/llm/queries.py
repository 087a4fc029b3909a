"""Named queries of the corpus operators, and their SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, codes, contamination, extraction, language, lines, packing, phrases, quality, shards, simhash, urls, vectors
from .common import crc_of, table


def vocabulary() -> str:
    """Path of the public vocabulary that packing counts tokens with."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.train(docs.where(crc_of("doc_id") % 4 != 2))
    return language.predict(docs, model).select(
        F.col("id").alias("doc_id"), (crc_of("id") % 4 == 2).alias("held_out"), "lang_pred", "score", "shares")


def op2_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality").where(crc_of("doc_id") % 5 != 0)
    model = quality.train(docs, labels)
    return quality.score(docs, model).select(
        F.col("id").alias("doc_id"), (crc_of("id") % 5 == 0).alias("held_out"), "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"), "difference")


def op3_dynamic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary()).withColumnRenamed("id", "doc_id")


def op4_line_neighbourhoods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_decisions(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "line_no", "kept", F.col("of_id").alias("of_doc"), "of_line", "distance")


def md5_number(*parts: Column | str) -> Column:
    return F.conv(F.substring(F.md5(F.concat(*parts)), 1, 6), 16, 10).cast("int")


def dated_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with a day of fetching derived from their id; the table has none."""
    number = md5_number(F.col("page_id").cast("string"))
    return table(spark, sf_dir, "pages").select("page_id", "url", F.date_add(F.lit("2023-01-01").cast("date"), number % 730).alias("day"))


def dated_entries(captures: DataFrame) -> DataFrame:
    """List entries derived from the hosts of the pages: added, partly removed, partly added again."""
    host, path = urls.host_of(F.col("url")), urls.path_of(F.col("url"))
    hosts = captures.select(host.alias("host"), F.split(path, "/")[1].alias("part")).where("host <> ''")
    names = hosts.select(F.lit("hosts").alias("list"), F.lit("domain").alias("kind"), F.col("host").alias("pattern")).distinct() \
        .union(hosts.where("host rlike '[.].*[.]'").select(F.lit("domains"), F.lit("domain"), F.regexp_replace("host", r"^[^.]*\.", "")).distinct()) \
        .union(hosts.where("part <> ''").select(F.lit("paths"), F.lit("prefix"), F.concat("host", F.lit("/"), F.lower("part"))).distinct())
    n = md5_number("list", F.lit(":"), "pattern")
    start = F.date_add(F.lit("2023-01-01").cast("date"), n % 400)
    events = F.array(F.struct(start.alias("day"), F.lit("add").alias("action")),
                     F.when(n % 2 == 0, F.struct(F.date_add(start, 1 + n % 200).alias("day"), F.lit("remove").alias("action"))),
                     F.when(n % 4 == 0, F.struct(F.date_add(start, 250 + n % 100).alias("day"), F.lit("add").alias("action"))))
    return names.where(n % 3 == 0).select("list", "kind", "pattern", F.inline(F.filter(events, lambda e: e.isNotNull())))


def op5_temporal_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures = dated_captures(spark, sf_dir)
    verdicts = urls.temporal_url_filter(captures, dated_entries(captures))
    found = verdicts.withColumnsRenamed({"url": "hit_url", "day": "hit_day"})
    return captures.join(found, F.col("url").eqNullSafe(F.col("hit_url")) & F.col("day").eqNullSafe(F.col("hit_day")), "left") \
        .select("page_id", "url", "day", "blocked", "lists", "patterns", "since")


def op6_simhash_gray_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(table(spark, sf_dir, "documents"), words=4, bits=4).withColumnRenamed("id", "doc_id")


def op7_pruned_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"), threshold=0.9).withColumnRenamed("id", "vec_id")


def op8_template_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.main_text(table(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")


def op9_minhash_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).withColumnRenamed("id", "doc_id")


def op10_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.kd_shards(table(spark, sf_dir, "documents"), 40).select(
        F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"), least=30, order=4, covered=80, top=2000)


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = codes.vector_codes(table(spark, sf_dir, "embeddings"), parts=16, entries=64, rounds=2, scale=256)
    return found.drop("label").withColumnRenamed("id", "vec_id")


def op13_streaming_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    encoded = bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), spelled=True)
    return encoded.select(F.col("id").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"),
                          F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
                          F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


QUERIES = {f.__name__: f for f in (
    op1_language_mixture, op2_compression_quality, op3_dynamic_packing, op4_line_neighbourhoods, op5_temporal_url_filter,
    op6_simhash_gray_index, op7_pruned_graph, op8_template_removal, op9_minhash_containment, op10_kd_shards,
    op11_phrase_collocations, op12_vector_codes, op13_streaming_bpe)}

URL_HOST = r"regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+?)\.?(?::[0-9]*)?(?:[/?#]|$)', 1)"
URL_PATH = "regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"



def codes_sql(parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> str:
    """Product codes in SQL: every part is compared with every entry, in each round and once more."""
    def assigned(k: int) -> str:
        return f"""a{k} AS MATERIALIZED (SELECT x.row, x.p, any_value(x.v) AS v, min((x.sq - 2 * list_dot_product(x.v, c.v) + c.sq) * {entries} + c.e) AS best
  FROM x JOIN c{k} c USING (p) GROUP BY x.row, x.p)"""

    def moved(k: int) -> str:
        return f"""s{k} AS (SELECT p, CAST(best AS BIGINT) % {entries} AS e, i, CAST(floor(sum(v[i]) / count(*)) AS DOUBLE) AS m
  FROM (SELECT p, best, v, unnest(generate_series(1, len(v))) AS i FROM a{k - 1}) GROUP BY ALL),
t{k} AS (SELECT p, e, list(m ORDER BY i) AS v FROM s{k} GROUP BY ALL),
c{k} AS MATERIALIZED (SELECT p, e, v, list_dot_product(v, v) AS sq FROM (SELECT c.p, c.e, coalesce(t.v, c.v) AS v FROM c{k - 1} c LEFT JOIN t{k} t USING (p, e)))"""

    steps = ",\n".join([assigned(0), *(f"{moved(k)},\n{assigned(k)}" for k in range(1, rounds + 1))])
    return f"""
WITH k AS (SELECT vec_id, label, list_transform(embedding, lambda y: floor({scale} * CAST(y AS DOUBLE))) AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0),
r AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY vec_id, w) - 1 AS row FROM k),
x AS MATERIALIZED (SELECT row, p, v, list_dot_product(v, v) AS sq FROM
  (SELECT row, p, w[p * (len(w) // {parts}) + 1:(p + 1) * (len(w) // {parts})] AS v FROM r, generate_series(0, {parts - 1}) AS g(p))),
c0 AS (SELECT p, row AS e, v, sq FROM x WHERE row < {entries}),
{steps},
d AS (SELECT row, string_agg(printf('%02x', CAST(best AS BIGINT) % {entries}), '' ORDER BY p) AS code, CAST(sum(CAST(best AS BIGINT) // {entries}) AS BIGINT) AS error
  FROM a{rounds} GROUP BY row),
b AS (SELECT sha256(string_agg(array_to_string(list_transform(v, lambda y: CAST(y AS BIGINT)), ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM c{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM r JOIN d USING (row), b
"""


SQL = {
    "op4_line_neighbourhoods": """
WITH raw AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents),
l AS (SELECT doc_id, CAST(line_no AS INT) AS line_no, trim(regexp_replace(lower(l), '\\s+', ' ', 'g')) AS line FROM raw),
o AS (SELECT *, CAST(doc_id AS HUGEINT) * 4294967296 + line_no AS ord FROM l WHERE line <> ''),
k AS (SELECT line, min(ord) AS first FROM o GROUP BY line),
n AS (SELECT line, first, length(line) AS n FROM k WHERE length(line) >= 20),
h AS (SELECT line, first, n, n AS size FROM n UNION ALL SELECT line, first, n, n - 1 FROM n),
g AS (SELECT line, first, size, 0 AS side, substr(line, 1, CAST(floor(size / 2) AS INT)) AS part FROM h
      UNION ALL SELECT line, first, size, 1, right(line, size - CAST(floor(size / 2) AS INT)) FROM h),
p AS (SELECT DISTINCT a.line, a.first, b.first AS earlier, b.line AS other FROM g a JOIN g b ON a.size = b.size AND a.side = b.side AND a.part = b.part AND b.first < a.first),
e AS (SELECT line, min(earlier) AS earlier FROM p WHERE levenshtein(line, other) <= 1 GROUP BY line),
f AS (SELECT o.doc_id, o.line_no, CASE WHEN o.ord > k.first THEN k.first ELSE e.earlier END AS by_ord, o.ord > k.first AS copy
      FROM o JOIN k USING (line) LEFT JOIN e USING (line))
SELECT doc_id, line_no, by_ord IS NULL AS kept, CAST(by_ord // 4294967296 AS BIGINT) AS of_doc, CAST(by_ord % 4294967296 AS INT) AS of_line,
  CASE WHEN by_ord IS NOT NULL THEN CASE WHEN copy THEN 0 ELSE 1 END END AS distance FROM f
""",
    "op5_temporal_url_filter": f"""
WITH c AS (SELECT page_id, url, DATE '2023-01-01' + CAST(('0x' || substr(md5(CAST(page_id AS VARCHAR)), 1, 6))::INT % 730 AS INT) AS day FROM pages),
s AS (SELECT page_id, url, day, lower({URL_HOST}) AS host, CASE WHEN {URL_PATH} = '' THEN '/' ELSE {URL_PATH} END AS path FROM c),
names AS (
  SELECT DISTINCT 'hosts' AS list, 'domain' AS kind, host AS pattern FROM s WHERE host <> ''
  UNION ALL SELECT DISTINCT 'domains', 'domain', regexp_replace(host, '^[^.]*\\.', '') FROM s WHERE regexp_matches(host, '[.].*[.]')
  UNION ALL SELECT DISTINCT 'paths', 'prefix', host || '/' || lower(split_part(path, '/', 2)) FROM s WHERE host <> '' AND split_part(path, '/', 2) <> ''),
numbered AS (SELECT *, ('0x' || substr(md5(list || ':' || pattern), 1, 6))::INT AS n FROM names),
known AS (SELECT *, DATE '2023-01-01' + CAST(n % 400 AS INT) AS first_day FROM numbered WHERE n % 3 = 0),
events AS (
  SELECT list, kind || ':' || pattern AS pattern, first_day AS day, 'add' AS action FROM known
  UNION ALL SELECT list, kind || ':' || pattern, first_day + CAST(1 + n % 200 AS INT), 'remove' FROM known WHERE n % 2 = 0
  UNION ALL SELECT list, kind || ':' || pattern, first_day + CAST(250 + n % 100 AS INT), 'add' FROM known WHERE n % 4 = 0),
parts AS (SELECT page_id, url, day, host, string_split(host, '.') AS labels, [x FOR x IN string_split(path, '/') IF x <> ''] AS segs FROM s WHERE host <> ''),
pats AS (
  SELECT page_id, url, day, 'domain:' || array_to_string(labels[i:], '.') AS pattern FROM parts, generate_series(1, 64) AS t(i) WHERE i <= len(labels)
  UNION ALL SELECT page_id, url, day, 'prefix:' || host || '/' || lower(array_to_string(segs[1:i], '/')) FROM parts, generate_series(0, 64) AS t(i) WHERE i <= len(segs)),
seen AS (SELECT p.page_id, e.list, e.pattern, max(e.day) AS since, arg_max(e.action, e.day) AS action
         FROM (SELECT DISTINCT * FROM pats) p JOIN events e ON p.pattern = e.pattern AND e.day <= p.day GROUP BY ALL),
hits AS (SELECT page_id, array_to_string(list_sort(list(DISTINCT list)), ',') AS lists, array_to_string(list_sort(list(DISTINCT pattern)), ',') AS patterns,
         min(since) AS since FROM seen WHERE action = 'add' GROUP BY page_id)
SELECT page_id, url, day, lists IS NOT NULL AS blocked, lists, patterns, since FROM c LEFT JOIN hits USING (page_id)
""",
    "op9_minhash_containment": """
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM benchmark),
bs AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 4))) AS i FROM b WHERE len(w) > 0)),
ds AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 4)) AS i FROM d WHERE len(w) > 4)),
n AS (SELECT item_id, count(*) AS item_shingles FROM bs GROUP BY item_id),
m AS (SELECT doc_id, item_id, count(*) AS shared FROM ds JOIN bs USING (s) GROUP BY ALL)
SELECT doc_id, item_id, CAST(shared AS INT) AS shared, CAST(item_shingles AS INT) AS item_shingles, shared / CAST(item_shingles AS DOUBLE) AS containment
FROM m JOIN n USING (item_id) WHERE shared >= 0.8 * item_shingles - 1e-9
""",    "op11_phrase_collocations": """
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM d),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[ \\t]+'), lambda x: x <> '') AS words FROM p),
g AS (SELECT lang, k, array_to_string(words[i:i + k - 1], ' ') AS phrase
      FROM (SELECT lang, words, k, unnest(generate_series(1, len(words) - k + 1)) AS i FROM w, (VALUES (1), (2), (3), (4)) AS sizes(k) WHERE len(words) >= k)),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS words FROM f WHERE k > 1 AND f >= 30),
x AS (SELECT lang, phrase, k, a, cut, array_to_string(words[1:cut], ' ') AS head, array_to_string(words[cut + 1:k], ' ') AS rest
      FROM (SELECT *, unnest(generate_series(1, k - 1)) AS cut FROM c)),
y AS (SELECT x.lang, x.phrase, x.a, x.cut, h.f AS l, t.f AS r, CAST((2000000::HUGEINT * x.a) // (h.f::HUGEINT + t.f) AS BIGINT) AS score
      FROM x JOIN f h ON h.lang = x.lang AND h.phrase = x.head JOIN f t ON t.lang = x.lang AND t.phrase = x.rest),
z AS (SELECT * FROM y QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
s AS (SELECT lang, a, array_to_string(words[i:i + size - 1], ' ') AS phrase
      FROM (SELECT lang, a, words, size, unnest(generate_series(1, k - size + 1)) AS i FROM c, (VALUES (2), (3)) AS sizes(size) WHERE k > size)),
m AS (SELECT lang, phrase, max(a) AS longer FROM s GROUP BY ALL),
o AS (SELECT z.* FROM z LEFT JOIN m USING (lang, phrase) WHERE longer IS NULL OR 100::HUGEINT * longer < 80::HUGEINT * a),
q AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM o)
SELECT lang, rank, phrase, a, l, r, n, score FROM q JOIN n USING (lang) WHERE rank <= 2000
""",
    "op12_vector_codes": codes_sql(),
}
