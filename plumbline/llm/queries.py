"""One thin query for each operator: production parameters, whole tables, full results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, html_text, line_dedup, near_vectors, ngram_join, packed_ids, packing, resampling, sharding, spelling, token_counts, toxicity, url_rules
from .shared import table


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


def op3_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    deduped = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return deduped.select("doc_id", "text", F.col("__n_removed").cast("long").alias("n_removed_lines"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.clusters(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "n_toxic", "spans")


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(table(spark, sf_dir, "pages"))


def op9_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = packed_ids.write_ids(table(spark, sf_dir, "documents"))
    return packed_ids.read_ids(spark, files)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket", "batch_id", "batch_row")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_html_text, op2_token_counts, op3_near_vectors, op4_line_dedup, op5_decontamination, op6_ngram_join, op7_toxicity, op8_url_filters, op9_token_ids, op10_packing, op11_spelling_variants, op12_importance_resampling, op13_virtual_slots)}

#: crc32 in SQL: the look-up table from its polynomial, and the fold over the bytes of a string.
CRC_TABLE = """bits(i, k, c) AS (
    SELECT range, 0, range FROM range(256) UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8
), crc AS MATERIALIZED (SELECT list(c ORDER BY i) AS tab FROM bits WHERE k = 8)"""


def crc32_sql(string: str) -> str:
    """The unsigned crc32 of a string's bytes, where ``crc`` of CRC_TABLE is joined."""
    steps = f"list_transform(regexp_extract_all(hex(encode({string})), '..'), lambda x: CAST('0x' || x AS BIGINT))"
    return f"xor(list_reduce({steps}, lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1]), 4294967295), 4294967295)"


def lower_sql(string: str) -> str:
    return f"translate({string}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


ORACLES = {
    "op3_near_vectors": """
WITH RECURSIVE v AS (
    SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
    SELECT a.vec_id AS u, b.vec_id AS w FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
    WHERE list_cosine_similarity(a.e, b.e) >= 0.98
), reach(vec_id, root) AS (
    SELECT vec_id, vec_id FROM embeddings UNION SELECT links.w, reach.root FROM reach JOIN links ON links.u = reach.vec_id
), component AS (SELECT vec_id, min(root) AS component_id FROM reach GROUP BY 1),
counted AS (SELECT u AS vec_id, count(*) AS n FROM links GROUP BY 1)
SELECT e.vec_id, coalesce(n, 0) AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e JOIN component USING (vec_id) LEFT JOIN counted USING (vec_id)""",
    "op4_line_dedup": r"""
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
e AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM l),
inked AS (SELECT doc_id, i, line, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS j FROM e WHERE regexp_matches(line, '[^\t\n\x0B\f\r \p{Z}\x{85}]')),
chunks AS (
    SELECT doc_id, i AS a, j AS b FROM inked WHERE j IS NOT NULL
    UNION ALL SELECT doc_id, i, i FROM inked WHERE regexp_matches(line, '^[\t\n\x0B\f\r \p{Z}\x{85}]*(?:[^\t\n\x0B\f\r \p{Z}\x{85}]+[\t\n\x0B\f\r \p{Z}\x{85}]+){49}[^\t\n\x0B\f\r \p{Z}\x{85}]')
), placed AS (
    SELECT doc_id, a, b, row_number() OVER (PARTITION BY ls[a:b] ORDER BY doc_id, a) AS place FROM chunks JOIN l USING (doc_id)
), gone AS (SELECT DISTINCT doc_id, unnest(range(a, b + 1)) AS i FROM placed WHERE place > 1),
lost AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY 1),
kept AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS text FROM e ANTI JOIN gone USING (doc_id, i) GROUP BY 1)
SELECT d.doc_id, CASE WHEN n IS NULL THEN d.text ELSE coalesce(kept.text, '') END AS text, coalesce(n, 0) AS n_removed_lines
FROM documents d LEFT JOIN lost USING (doc_id) LEFT JOIN kept USING (doc_id)""",
    "op5_decontamination": r"""
WITH own AS (
    SELECT doc_id, list_filter(list_transform(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: trim(x, '!"#$%&''()*+,-./:;<=>?@[\]^_`{|}~')), lambda x: x <> '') AS w FROM documents
), items AS (
    SELECT item_id, list_filter(list_transform(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: trim(x, '!"#$%&''()*+,-./:;<=>?@[\]^_`{|}~')), lambda x: x <> '') AS w FROM benchmark
), theirs AS (SELECT item_id, len(w) AS m, least(13, len(w)) AS k, unnest(w) AS x, generate_subscripts(w, 1) - 1 AS q FROM items WHERE len(w) >= 8),
mine AS (SELECT doc_id, len(w) AS n, unnest(w) AS x, generate_subscripts(w, 1) - 1 AS p FROM own),
diagonals AS (
    SELECT doc_id, item_id, n, m, k, p - q AS shift, list(q) AS qs FROM mine JOIN theirs USING (x) GROUP BY ALL HAVING 100 * count(*) >= 80 * k
), windows AS (SELECT *, unnest(range(greatest(0, -shift), least(m, n - shift) - k + 1)) AS s FROM diagonals),
good AS (SELECT * FROM windows WHERE 100 * len(list_filter(qs, lambda y: y >= s AND y < s + k)) >= 80 * k),
spans AS (SELECT doc_id, item_id, shift, any_value(qs) AS qs, min(s) AS lo, max(s) + any_value(k) AS hi FROM good GROUP BY 1, 2, 3)
SELECT doc_id, item_id, lo + shift AS doc_start, lo AS item_start, hi - lo AS n_words, len(list_filter(qs, lambda y: y >= lo AND y < hi)) AS n_equal FROM spans""",
    "op6_ngram_join": r"""
WITH RECURSIVE words AS (
    SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), sets AS (
    SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
      ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) END AS s FROM words
), elements AS (SELECT doc_id, unnest(s) AS x, len(s) AS n FROM sets),
pairs AS (
    SELECT a.doc_id AS u, b.doc_id AS v FROM elements a JOIN elements b ON a.x = b.x AND a.doc_id < b.doc_id
    GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))
), links AS (SELECT u, v FROM pairs UNION ALL SELECT v, u FROM pairs),
reach(doc_id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT links.v, reach.root FROM reach JOIN links ON links.u = reach.doc_id),
component AS (SELECT doc_id, min(root) AS component_id FROM reach GROUP BY 1)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id FROM sets JOIN component USING (doc_id)""",
    "op8_url_filters": r"""
WITH rules(rule_host, rule_path, rule_verdict) AS (
    VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')
), cut AS (
    SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
    SELECT page_id,
           coalesce(translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
           coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
    FROM cut
), ranked AS (
    SELECT page_id, host, path, rule_host || rule_path AS rule, rule_verdict,
           row_number() OVER (PARTITION BY page_id ORDER BY length(rule_host || rule_path) DESC) AS place
    FROM parts LEFT JOIN rules
      ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
)
SELECT page_id, host, path, rule, coalesce(rule_verdict, 'allow') AS verdict FROM ranked WHERE place = 1
""",
    "op11_spelling_variants": f"""
WITH RECURSIVE {CRC_TABLE}, runs AS (
    SELECT doc_id, unnest(regexp_extract_all({lower_sql('text')}, '[a-zÀ-ÿ]+')) AS run FROM documents
), hashed AS (
    SELECT run, times, {crc32_sql("doc_id || ':' || run")} AS h FROM (SELECT doc_id, run, count(*) AS times FROM runs WHERE length(run) >= 5 GROUP BY ALL), crc
), written AS (
    SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, times FROM hashed
), words AS (
    SELECT word, CAST(sum(times) AS BIGINT) AS n FROM written WHERE length(word) >= 5 GROUP BY word HAVING sum(times) >= 3
), places AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words),
holes AS (SELECT word, n, i, substr(word, 1, i - 1) AS head, substr(word, i + 1) AS tail FROM places),
shorter AS (SELECT DISTINCT h.word, h.n, w.word AS other, w.n AS other_n FROM holes h JOIN words w ON w.word = h.head || h.tail),
near AS (
    SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM holes a JOIN holes b USING (i, head, tail) WHERE a.word <> b.word
    UNION ALL SELECT * FROM shorter UNION ALL SELECT other, other_n, word, n FROM shorter
), best AS (
    SELECT word, count(*) AS n_near, max(other_n) AS most, arg_min(other, (-other_n, other)) AS form FROM near GROUP BY word
), formed AS (
    SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= 2 * n THEN form END AS form, CASE WHEN most >= 2 * n THEN most END AS form_n FROM words LEFT JOIN best USING (word)
), way(word, root) AS (SELECT word, word FROM formed UNION ALL SELECT way.word, f.form FROM way JOIN formed f ON f.word = way.root WHERE f.form IS NOT NULL)
SELECT f.word, f.form, way.root, f.n, f.n_near, f.form_n FROM formed f JOIN way ON way.word = f.word JOIN formed last ON last.word = way.root AND last.form IS NULL""",
    "op12_importance_resampling": rf"""
WITH RECURSIVE {CRC_TABLE}, texts AS (
    SELECT 'd' AS side, doc_id, text FROM documents UNION ALL SELECT 'b', row_number() OVER (), text FROM benchmark
), cut AS (
    SELECT side, doc_id, coalesce(regexp_extract_all({lower_sql('text')}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM texts
), runs AS (
    SELECT side, doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM cut
), named AS (SELECT f, {crc32_sql('f')} % 10000 AS bucket FROM (SELECT DISTINCT f FROM runs), crc),
found AS (SELECT side, doc_id, bucket FROM runs JOIN named USING (f)),
tallies AS (
    SELECT range AS bucket, count(*) FILTER (side = 'd') AS s, count(*) FILTER (side = 'b') AS t FROM range(10000) LEFT JOIN found ON bucket = range GROUP BY range
), gains AS (
    SELECT bucket, CAST(floor(1000 * ln((t + 1) * CAST(sum(s) OVER () + 10000 AS DOUBLE) / ((s + 1) * CAST(sum(t) OVER () + 10000 AS DOUBLE)))) AS BIGINT) AS gain FROM tallies
), weights AS (
    SELECT doc_id, count(*) AS n_features, CAST(floor(sum(gain) / count(*)) AS BIGINT) AS weight FROM found JOIN gains USING (bucket) WHERE side = 'd' GROUP BY doc_id
), scored AS (
    SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, len(w) >= 20 AS fit,
           coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('7:' || doc_id), 1, 8) AS BIGINT) + 0.5) / 4294967296.0::DOUBLE))) AS BIGINT) AS score
    FROM cut LEFT JOIN weights USING (doc_id) WHERE side = 'd'
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY fit ORDER BY score DESC, doc_id) AS place, count(*) FILTER (fit) OVER () * 25 // 100 AS drawn FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN fit AND place <= drawn THEN place END AS rank FROM ranked""",
    "op13_virtual_slots": f"""
WITH RECURSIVE {CRC_TABLE}, rows AS (
    SELECT doc_id, CAST(strlen(coalesce(text, '')) + 8 AS BIGINT) AS size, {crc32_sql("coalesce(text, '')")} AS text_crc32 FROM documents, crc
), hashed AS (SELECT *, CAST(CAST('0x' || substr(md5(doc_id || ':' || text_crc32), 1, 8) AS BIGINT) % 8192 AS INTEGER) AS virtual_slot FROM rows),
slots AS (
    SELECT virtual_slot, CAST(sum(size) AS BIGINT) AS bytes, row_number() OVER (ORDER BY sum(size) DESC, virtual_slot) AS k FROM hashed GROUP BY virtual_slot
), dealt(k, virtual_slot, shard, loads) AS (
    SELECT CAST(0 AS BIGINT), -1, CAST(0 AS BIGINT), list_transform(range(24), lambda x: CAST(0 AS BIGINT))
    UNION ALL
    SELECT k, virtual_slot, shard, list_transform(loads, lambda x, i: CASE WHEN i = shard THEN x + bytes ELSE x END)
    FROM (SELECT s.k, s.virtual_slot, s.bytes, d.loads, list_position(d.loads, list_min(d.loads)) AS shard FROM dealt d JOIN slots s ON s.k = d.k + 1)
)
SELECT doc_id, size, text_crc32, 'bytes' AS law, CAST(shard - 1 AS INTEGER) AS shard,
       row_number() OVER (PARTITION BY shard ORDER BY virtual_slot, doc_id, text_crc32, size) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard, virtual_slot, 1 AS map_version
FROM hashed JOIN dealt USING (virtual_slot)""",
}
