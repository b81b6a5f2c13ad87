"""Every operator over the parquet tables, with the SQL that DuckDB checks it with.

documents stand for converted texts, benchmark for quotes, labels for a ledger
of verdicts, conversations and events for append-ordered rows, and the order
tables for references between artifacts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import functions as R
from ..commit import parts
from ..core.quotes import KEYWORD
from ..operators import counts, diff, ids, ledgers, lookup, quotes, references, registers, sections
from ..sources import fresh_path, lines, shared_dir, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None):
    """Registers a function as the query of its name, and the SQL of the same result."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


#: White space that is normalised, as DuckDB's regular expressions spell it.
WS_SQL = r"trim(regexp_replace({0}, '[ \t\r\n]+', ' ', 'g'), ' ')"
LABEL_WORDS = ["verified", "failed"]


# joins


@query(f"""
SELECT d.doc_id, b.item_id FROM documents d JOIN benchmark b
  ON contains({WS_SQL.format('d.text')}, {WS_SQL.format('b.text')})""")
def verbatim_seal(spark, d):
    return references.contained(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "benchmark"), "item_id", "text")


@query(f"""
WITH hits AS (SELECT b.item_id, count(*) AS n FROM documents d JOIN benchmark b
  ON contains({WS_SQL.format('d.text')}, {WS_SQL.format('b.text')}) GROUP BY 1)
SELECT count(*) AS population, count(*) FILTER (WHERE n > 0) AS sealed, count(*) FILTER (WHERE n IS NULL) AS failed
FROM benchmark LEFT JOIN hits USING (item_id)""")
def examined(spark, d):
    quotes = table(spark, d, "benchmark")
    hits = verbatim_seal(spark, d).groupBy("item_id").agg(F.count("*").alias("n"))
    return counts.tallies(quotes.join(hits, "item_id", "left"), sealed=F.col("n") > 0, failed=F.col("n").isNull())


@query(r"""
WITH q AS (SELECT doc_id, text, doc_id % 10 AS kind, regexp_extract(text, '[a-z]+ [a-z]+ [a-z]+ [a-z]+') AS quote, regexp_matches(text, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]') AS odd FROM documents),
p AS (SELECT *, replace(quote, ' ', '[ \t\r\n]+') AS pattern, CASE WHEN kind = 3 THEN 'unmarked' WHEN kind = 4 THEN 'malformed-marker' WHEN kind = 5 THEN 'unsupported-structure' WHEN kind = 2 OR quote = '' THEN 'empty'
  WHEN kind = 9 THEN 'source-unavailable' WHEN kind = 6 THEN 'unresolved' WHEN kind = 8 THEN 'binary-cold-debt' WHEN kind = 1 OR odd THEN 'mismatch' ELSE 'sealed' END AS state FROM q)
SELECT doc_id, state, CASE WHEN state = 'sealed' THEN strlen(regexp_extract(text, '(?s)^(.*?)' || pattern, 1)) END AS first_byte, CASE WHEN state = 'sealed' THEN strlen(regexp_extract(text, pattern)) END AS n_bytes FROM p""")
def quote_marker_seal(spark, d):
    """A marked quotation for each document, of each of the nine states, with the bytes of the source that it stands at."""
    docs = table(spark, d, "documents")
    kind, quote = F.col("doc_id") % 10, F.regexp_extract("text", "[a-z]+ [a-z]+ [a-z]+ [a-z]+", 0)
    unit = F.concat(F.lit("m"), F.col("doc_id").cast("string"))
    marker = lambda more: F.lit(f"<!-- {KEYWORD} {more} -->\n")
    two = F.concat(F.lit("> "), F.regexp_replace(quote, "^([a-z]+ [a-z]+) ", "$1\n>   "))
    one = F.concat(F.lit("> "), quote)
    body = (
        F.when(kind == 1, F.concat(marker("source=self"), F.when(quote == "", F.lit(">")).otherwise(F.lit("> 0 of its words"))))
        .when(kind == 2, F.concat(marker("source=self"), F.lit(">")))
        .when(kind == 3, one)
        .when(kind == 4, F.concat(marker("source=t001"), one))
        .when(kind == 5, F.concat(F.lit("- > "), quote))
        .when(kind == 6, F.concat(marker("source=self file=source.b"), one))
        .when(kind == 7, F.concat(marker("source=self file=source.md"), two))
        .when(kind == 8, F.concat(marker('source=self mode=not-checkable file=source.md location="line 1"'), one))
        .otherwise(F.concat(marker("source=self"), one))
    )
    content = F.encode(F.concat(F.when(kind == 8, F.lit("\x01")).otherwise(""), F.col("text")), "UTF-8")
    files = docs.where(kind != 9).select(F.concat(F.lit("materials/"), unit, F.lit("/source.md")).alias("path"), content.alias("content"), F.length(content).cast("long").alias("length"))
    spans = quotes.quote_spans(docs.select(unit.alias("id"), F.concat(F.lit("# a copy\n\n"), body, F.lit("\n")).alias("body")))
    found = quotes.judged(spans, quotes.raw_sources(files, "materials"))
    return found.select(F.substring("unit", 2, 30).cast("long").alias("doc_id"), "state", F.col("at").alias("first_byte"), F.col("size").alias("n_bytes"))


CARDS_SQL = """
cards AS (SELECT doc_id, CASE WHEN doc_id % 7 = 6 THEN -1 ELSE doc_id END AS source, CASE doc_id % 7 WHEN 0 THEN l[1] || chr(10) || l[2] WHEN 1 THEN l[1] || chr(10) || l[3] WHEN 2 THEN l[3] || chr(10) || l[1] WHEN 3 THEN 'not in it at all'
  WHEN 4 THEN '' WHEN 5 THEN 'word' ELSE l[1] END AS body FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents) WHERE len(l) >= 3)"""


@query(f"""
WITH {CARDS_SQL}, n AS (SELECT c.doc_id, {WS_SQL.format('c.body')} AS q, {WS_SQL.format('d.text')} AS t, c.body FROM cards c LEFT JOIN documents d ON d.doc_id = c.source)
SELECT doc_id, CASE WHEN q = '' THEN 'empty' WHEN t IS NULL THEN 'unavailable' WHEN NOT contains(q, ' ') THEN 'fragment' WHEN contains(t, q) THEN 'sealed'
  WHEN len(list_filter(string_split(body, chr(10)), lambda x: NOT contains(t, {WS_SQL.format('x')}))) = 0 THEN 'split-block' ELSE 'mismatch' END AS seal FROM n""")
def seal_split_block(spark, d):
    """Cards that quote two lines of their text, together or apart, and cards that fail otherwise."""
    docs = table(spark, d, "documents")
    line, kind = F.split("text", "\n"), F.col("doc_id") % 7
    two = lambda i, j: F.concat_ws("\n", F.get(line, F.lit(i)), F.get(line, F.lit(j)))
    body = F.when(kind == 0, two(0, 1)).when(kind == 1, two(0, 2)).when(kind == 2, two(2, 0)).when(kind == 3, "not in it at all").when(kind == 4, "").when(kind == 5, "word").otherwise(F.get(line, F.lit(0)))
    cards = docs.where(F.size(line) >= 3).select("doc_id", F.when(kind == 6, -1).otherwise(F.col("doc_id")).alias("source"), body.alias("body"))
    return references.seal_states(cards, "source", "body", docs, "doc_id", "text").select("doc_id", "seal")


@query("SELECT doc_id, quality, toxic FROM labels WHERE quality = 1 AND doc_id NOT IN (SELECT doc_id FROM documents WHERE lang <> 'en')")
def truth_source_resolves(spark, d):
    labels, docs = table(spark, d, "labels").where("quality = 1"), table(spark, d, "documents").where("lang <> 'en'")
    return references.unresolved(labels, "doc_id", docs, "doc_id")


@query("SELECT o_orderkey, o_custkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal < 0")
def truth_source_retracted(spark, d):
    retracted = table(spark, d, "customer").where("c_acctbal < 0")
    return references.resolved(table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey", retracted, "c_custkey")


@query("""
SELECT coalesce(a.doc_id, b.doc_id) AS id, CASE WHEN b.doc_id IS NULL THEN 'left' ELSE 'right' END AS side
FROM (SELECT DISTINCT doc_id FROM documents WHERE lang <> 'de') a FULL JOIN (SELECT DISTINCT doc_id FROM labels) b ON a.doc_id = b.doc_id
WHERE a.doc_id IS NULL OR b.doc_id IS NULL""")
def catalog_orphans(spark, d):
    """Two-way orphans between catalogued texts (German ones are not) and labels."""
    return references.orphans(table(spark, d, "documents").where("lang <> 'de'"), "doc_id", table(spark, d, "labels"), "doc_id")


@query("""
WITH idx AS (SELECT l_orderkey AS id, count(*) AS n FROM lineitem GROUP BY 1)
SELECT coalesce(idx.id, o.o_orderkey) AS id,
  CASE WHEN o.o_orderkey IS NULL THEN 'not-on-disk' WHEN idx.id IS NULL THEN 'not-indexed' ELSE 'duplicate' END AS problem, coalesce(n, 0) AS n
FROM idx FULL JOIN orders o ON idx.id = o.o_orderkey WHERE o.o_orderkey IS NULL OR idx.id IS NULL OR n > 1""")
def index_sync(spark, d):
    """Index lines against files: duplicates are told apart from the set difference."""
    return lookup.index_sync(table(spark, d, "lineitem"), "l_orderkey", table(spark, d, "orders"), "o_orderkey")


@query("""
SELECT DISTINCT l_orderkey, l_partkey FROM lineitem l WHERE l_returnflag = 'R'
  AND NOT EXISTS (SELECT 1 FROM part p WHERE p.p_partkey = l.l_partkey AND p.p_size <= 25)""")
def coverage_crosscheck(spark, d):
    mentions = table(spark, d, "lineitem").where("l_returnflag = 'R'").select("l_orderkey", "l_partkey").distinct()
    return references.unresolved(mentions, "l_partkey", table(spark, d, "part").where("p_size <= 25"), "p_partkey")


@query("""
WITH cited AS (SELECT doc_id, unnest(list_transform(regexp_extract_all(text, '(?:^|[^0-9])([0-9]{1,4})(?:$|[^0-9])', 1), lambda x: lpad(x, CAST(greatest(3, length(x)) AS INTEGER), '0'))) AS ref FROM documents)
SELECT doc_id, ref FROM cited WHERE ref NOT IN (SELECT lpad(CAST(s_suppkey AS VARCHAR), CAST(greatest(3, length(CAST(s_suppkey AS VARCHAR))) AS INTEGER), '0') FROM supplier)""")
def cited_resolves(spark, d):
    """Numbers cited in texts, padded to their canonical length, that name no supplier."""
    pad = lambda c: F.lpad(c, F.greatest(F.lit(3), F.length(c)), F.lit("0"))
    found = table(spark, d, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("(?:^|[^0-9])([0-9]{1,4})(?:$|[^0-9])"), 1)).alias("x"))
    return references.unresolved(found.select("doc_id", pad(F.col("x")).alias("ref")), "ref", table(spark, d, "supplier").select(pad(F.col("s_suppkey").cast("string")).alias("id")), "id")


@query("""
SELECT w.tag FROM (VALUES ('red'), ('blue'), ('green'), ('purple'), ('golden'), ('widget'), ('gear'), ('absent')) w(tag)
WHERE NOT EXISTS (SELECT 1 FROM part WHERE list_contains(string_split(p_name, ' '), w.tag))""")
def required_tag_cover(spark, d):
    words = spark.createDataFrame([(w,) for w in "red blue green purple golden widget gear absent".split()], "tag string")
    return references.uncovered(words, "tag", table(spark, d, "part").select(F.split("p_name", " ").alias("tags")), "tags")


@query("""
SELECT DISTINCT l_suppkey AS card, l_partkey AS ref FROM lineitem WHERE l_partkey NOT IN (SELECT s_suppkey FROM supplier)""")
def derived_refs(spark, d):
    refs = references.list_refs(table(spark, d, "lineitem").select(F.col("l_suppkey").alias("card"), F.array("l_partkey").alias("derived_from")), "card", "derived_from").distinct()
    return references.unresolved(refs, "ref", table(spark, d, "supplier"), "s_suppkey")


@query("SELECT DISTINCT l_suppkey AS card FROM lineitem WHERE l_suppkey = l_partkey")
def corrects_self_refs(spark, d):
    cards = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("card"), F.array("l_partkey").alias("corrects"))
    return references.self_refs(cards, "card", "corrects").select("card").distinct()


@query("SELECT DISTINCT conv_id, role FROM conversations WHERE role NOT IN ('user', 'assistant')")
def role_in_project(spark, d):
    roles = spark.createDataFrame([("user",), ("assistant",)], "role string")
    return references.unresolved(table(spark, d, "conversations").select("conv_id", "role").distinct(), "role", roles, "role")


@query("""
WITH e AS (SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS target FROM events)
SELECT event_id, target, 'CONF-TARGET-DANGLING' AS code FROM e WHERE target NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)""")
def conflict_refs(spark, d):
    entries = table(spark, d, "events").select("event_id", F.from_json("props", "k BIGINT")["k"].alias("target")).where("target IS NOT NULL")
    dangling = references.unresolved(entries, "target", table(spark, d, "supplier").where("s_acctbal > 0"), "s_suppkey")
    return dangling.withColumn("code", F.lit("CONF-TARGET-DANGLING"))


@query("SELECT DISTINCT doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE source <> 'src0')")
def ledger_ghosts(spark, d):
    return ledgers.ghosts(table(spark, d, "labels"), "doc_id", table(spark, d, "documents").where("source <> 'src0'"), "doc_id")


@query("SELECT doc_id FROM documents WHERE lang <> 'es' AND doc_id NOT IN (SELECT doc_id FROM labels)")
def undeclared_materials(spark, d):
    live = table(spark, d, "documents").where("lang <> 'es'").select("doc_id")
    return references.unresolved(live, "doc_id", table(spark, d, "labels"), "doc_id")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def missing_conversion(spark, d):
    return references.unresolved(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", table(spark, d, "lineitem"), "l_orderkey")


# aggregates


@query("""
SELECT count(*) FILTER (WHERE lang <> 'es' AND l.doc_id IS NOT NULL) AS covered, count(*) FILTER (WHERE lang <> 'es') AS denominator, count(*) FILTER (WHERE lang = 'es') AS exempt
FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id""")
def census(spark, d):
    return counts.coverage(table(spark, d, "documents"), "doc_id", table(spark, d, "labels"), "doc_id", F.col("lang") == "es")


@query("""
SELECT b.bucket, count(e.event_id) AS n FROM (VALUES ('click'), ('error'), ('purchase'), ('anchored'), ('undeclared')) b(bucket)
LEFT JOIN (SELECT event_id, CASE WHEN event_type IN ('click', 'error', 'purchase', 'anchored') THEN event_type ELSE 'undeclared' END AS w FROM events) e ON e.w = b.bucket GROUP BY 1""")
def intake_split(spark, d):
    return counts.buckets(table(spark, d, "events"), "event_type", ["click", "error", "purchase", "anchored"], "undeclared")


QUEUE_SQL = """
l AS (SELECT doc_id, quality, CASE doc_id % 4 WHEN 0 THEN 'user-only' WHEN 1 THEN 'recommended' WHEN 2 THEN 'machine' ELSE '' END AS owner FROM labels)"""


def _queues(spark, d):
    """A register for each label, with a human queue of one entry and what must not count: comments, fences and other sections."""
    tag = F.when(F.col("doc_id") % 4 == 0, " [user-only]").when(F.col("doc_id") % 4 == 1, " [recommended]").when(F.col("doc_id") % 4 == 2, " [machine]").when(F.col("doc_id") % 8 == 3, " [nobody]").otherwise("")
    line = F.concat(F.lit("- ["), F.when(F.col("quality") == 1, "open").otherwise("ruled"), F.lit("]"), tag, F.lit(" entry of "), F.col("doc_id").cast("string"))
    text = F.concat(F.lit("## Adjudications\n\n- [open] elsewhere\n\n## Human queue\n\n<!-- - [open] hidden -->\n```\n- [open] in a fence\n```\n"), line, F.lit("\n  more of it\n"))
    return table(spark, d, "labels").select("doc_id", text.alias("text"))


@query(f"WITH {QUEUE_SQL} SELECT owner AS ownership, count(*) AS n FROM l WHERE quality = 1 GROUP BY GROUPING SETS ((owner), ())")
def hq_split(spark, d):
    """Open entries by ownership, with the total as the row without one."""
    return registers.queue_split(registers.queue_entries(_queues(spark, d), "doc_id", "text"))


@query("SELECT count(*) AS population, count(*) FILTER (WHERE quality = 1 AND toxic = 0) AS digest_bound, count(*) FILTER (WHERE quality = 0) AS legacy_unbound FROM labels")
def review_seal_tally(spark, d):
    return counts.tallies(table(spark, d, "labels"), digest_bound=(F.col("quality") == 1) & (F.col("toxic") == 0), legacy_unbound=F.col("quality") == 0)


@query(r"""
SELECT doc_id, count(*) FILTER (WHERE regexp_matches(line, '^[-*] ')) AS bullets, count(*) FILTER (WHERE regexp_matches(line, '(Licensed|[!]{2}|###)')) AS markers, count(*) AS lines
FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY 1""")
def gaps_tally(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    return lookup.line_tally(docs, R.eol_lines(F.col("text")), bullets="^[-*] ", markers="(Licensed|[!]{2}|###)").drop("text")


@query("SELECT sha256(text) AS digest, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def dup_detect(spark, d):
    return counts.duplicates(table(spark, d, "documents").select(R.content_digest(F.col("text")).alias("digest")), "digest")


@query("SELECT DISTINCT source, lang FROM documents")
def distinct_ids(spark, d):
    return table(spark, d, "documents").select("source", "lang").distinct()


@query("""
SELECT conv_id, sha256(string_agg(name || chr(0) || digest || chr(10), '' ORDER BY name)) AS tree_digest
FROM (SELECT conv_id, lpad(CAST(turn AS VARCHAR), 6, '0') AS name, sha256(text) AS digest FROM conversations) GROUP BY 1""")
def tree_digest(spark, d):
    files = table(spark, d, "conversations").select("conv_id", F.lpad(F.col("turn").cast("string"), 6, "0").alias("name"), R.content_digest(F.col("text")).alias("digest"))
    return counts.tree_digest(files, "conv_id", "name", "digest")


# ledgers and windows


@query(r"""
WITH e AS (SELECT *, CASE WHEN event_id % 50 = 0 THEN 2 ELSE 1 END AS n_lines FROM events),
placed AS (SELECT *, sum(n_lines) OVER (ORDER BY event_id) AS row_ord FROM e)
SELECT CAST(row_ord AS BIGINT) AS row_ord, 't' || lpad(CAST(user_id AS VARCHAR), CAST(greatest(3, length(CAST(user_id AS VARCHAR))) AS INTEGER), '0') AS id,
       event_id % 11 <> 0 AND event_id % 13 <> 0 AND event_id % 17 <> 0 AS fit,
       event_id % 11 <> 0 AND event_id % 13 <> 0 AND event_id % 17 <> 0 AND event_type IN ('click', 'view') AS known,
       CASE WHEN event_id % 11 <> 0 AND event_id % 13 <> 0 AND event_id % 17 <> 0 AND event_type IN ('click', 'view') THEN CASE event_type WHEN 'click' THEN 'verified' ELSE 'failed' END END AS word
FROM placed""")
def read_tsv_ledger(spark, d):
    """A ledger that events wrote, with comments, CRLF ends, extra fields, control characters and days that are none."""
    e = table(spark, d, "events")
    odd = lambda n: F.col("event_id") % n == 0
    word = F.when(F.col("event_type") == "click", "verified").when(F.col("event_type") == "view", "failed").otherwise("verifed")
    note = F.when(odd(13), F.lit("a\x01b")).otherwise(F.lit("standard"))
    day = F.when(odd(17), "2024-02-30").otherwise(F.date_format("ts", "yyyy-MM-dd"))
    row = F.concat(F.concat_ws("\t", F.concat(F.lit("t"), F.col("user_id")), F.lit("-"), word, F.lit("1"), note, day), F.when(odd(11), "\t").otherwise(""), F.when(odd(2), "\r").otherwise(""))
    text = F.concat(F.when(odd(50), "# more\tof\tit\n").otherwise(""), row)
    place = fresh_path(spark, "ledger")
    e.repartitionByRange("event_id").sortWithinPartitions("event_id").select(text.alias("value")).write.text(place)
    rows, state = lines.read_ledger(spark, place, lines.VERDICTS)
    if state != "ok":
        raise ValueError(state)
    return rows.select("row_ord", "id", "fit", "known", "word")


@query(r"""
WITH e AS (SELECT *, row_number() OVER (ORDER BY event_id % 3, event_id) AS row_ord FROM events)
SELECT row_ord, 't' || lpad(CAST(user_id AS VARCHAR), CAST(greatest(3, length(CAST(user_id AS VARCHAR))) AS INTEGER), '0') AS id,
       CASE event_type WHEN 'click' THEN 'verified' ELSE 'failed' END AS word, CAST(event_id AS VARCHAR) AS round FROM e""")
def append_ledger(spark, d):
    """A ledger that three appends of many rows wrote, read in append order."""
    e, place = table(spark, d, "events"), fresh_path(spark, "ledger")
    word = F.when(F.col("event_type") == "click", "verified").otherwise("failed")
    rows = e.select("event_id", F.concat(F.lit("t"), F.col("user_id")).alias("id"), F.lit("-").alias("digest"), word.alias("word"), F.col("event_id").alias("round"), F.lit("standard").alias("standard"), F.date_format("ts", "yyyy-MM-dd").alias("day"))
    for part in range(3):
        parts.append_rows(rows.where(F.col("event_id") % 3 == part), place, list(lines.VERDICTS.names), ["event_id"])
    found, state = lines.read_ledger(spark, f"{place}/{parts.PARTS}", lines.VERDICTS)
    if state != "ok":
        raise ValueError(state)
    return found.select("row_ord", "id", "word", "round")


@query("SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def last_row_wins(spark, d):
    return ledgers.last_row_wins(table(spark, d, "events").select("user_id", "ts", "event_id", "event_type", "value"), "user_id", "ts", "event_id").drop("ts")


@query("""
SELECT user_id, event_type AS last_word, event_type IN ('click', 'view', 'purchase') AS evidence
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1""")
def quarantine(spark, d):
    return ledgers.quarantine(table(spark, d, "events"), "user_id", ["ts", "event_id"], "event_type", ["click", "view", "purchase"])


@query("""
SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events)
WHERE r > 1 AND event_type NOT IN ('click', 'view', 'purchase', 'signup')""")
def superseded_odd_words(spark, d):
    odd = ledgers.superseded_odd(table(spark, d, "events"), "user_id", ["ts", "event_id"], "event_type", ["click", "view", "purchase", "signup"])
    return odd.select("user_id", "event_id", "event_type")


@query("""
SELECT source, count(*) FILTER (WHERE id = '') AS headless, count(*) FILTER (WHERE id = '') > 0 AS void
FROM (SELECT source, CASE WHEN doc_id % 97 = 0 THEN '' ELSE CAST(doc_id AS VARCHAR) END AS id FROM documents) GROUP BY 1""")
def headless_void(spark, d):
    rows = table(spark, d, "documents").select("source", F.when(F.col("doc_id") % 97 == 0, "").otherwise(F.col("doc_id").cast("string")).alias("id"))
    return ledgers.voided(rows, "source", "id")


LEDGER_SQL = """
ledger AS (SELECT doc_id AS id, CASE WHEN toxic = 1 THEN 'failed' WHEN quality = 0 THEN 'legacy-unbound' ELSE 'verified' END AS word,
  CASE WHEN doc_id % 3 = 0 THEN sha256(text || 'x') ELSE sha256(text) END AS bound FROM labels JOIN documents USING (doc_id)),
judged AS (SELECT d.doc_id, CASE WHEN word = 'failed' THEN 'failed' WHEN word = 'legacy-unbound' THEN 'legacy-unbound'
  WHEN word = 'verified' AND bound = sha256(d.text) THEN 'verified' WHEN word = 'verified' THEN 'stale' ELSE 'unverified' END AS evidence
  FROM documents d LEFT JOIN ledger l ON l.id = d.doc_id)"""


def _scope(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    word = F.when(F.col("toxic") == 1, "failed").when(F.col("quality") == 0, "legacy-unbound").otherwise("verified")
    bound = F.when(F.col("doc_id") % 3 == 0, F.sha2(F.concat("text", F.lit("x")), 256)).otherwise(F.sha2("text", 256))
    ledger = table(spark, d, "labels").join(docs, "doc_id").select(F.col("doc_id").alias("id"), F.lit(1).alias("row_ord"), word.alias("word"), bound.alias("bound"))
    return ledgers.scope(docs.select("doc_id", F.sha2("text", 256).alias("digest")), "doc_id", "digest", ledger, "id", ["row_ord"], "word", "bound").select("doc_id", "evidence")


@query(f"WITH {LEDGER_SQL} SELECT doc_id, evidence FROM judged")
def scope(spark, d):
    return _scope(spark, d)


@query(f"""WITH {LEDGER_SQL} SELECT b.bucket, count(doc_id) AS n FROM (VALUES ('verified'), ('stale'), ('failed'), ('legacy-unbound'), ('unverified')) b(bucket)
LEFT JOIN judged ON evidence = bucket GROUP BY 1""")
def scope_buckets(spark, d):
    return counts.buckets(_scope(spark, d), "evidence", ["verified", "stale", "failed", "legacy-unbound", "unverified"])


@query(f"WITH {LEDGER_SQL} SELECT doc_id FROM judged WHERE evidence IN ('unverified', 'stale', 'failed')")
def scope_owed(spark, d):
    return _scope(spark, d).where(F.col("evidence").isin("unverified", "stale", "failed")).select("doc_id")


@query(r"""
WITH lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents),
h AS (SELECT *, last_value(CASE WHEN length(line) < 25 THEN line END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no) AS section FROM lines)
SELECT doc_id, CAST(line_no AS BIGINT) AS line_no, section FROM h""")
def read_sections(spark, d):
    """Short lines stand for headings; each line carries the last one."""
    found = sections.runs(table(spark, d, "documents"), "doc_id", "text", lambda line: F.length(line) < 25)
    return found.select("doc_id", F.explode(F.sequence("first", "last")).alias("line_no"), F.col("head").alias("section"))


@query(r"""
WITH lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents),
e AS (SELECT doc_id, line_no, sum(CASE WHEN ends_with(line, '.') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS entry FROM lines)
SELECT doc_id, CAST(entry AS BIGINT) AS entry, count(*) AS lines FROM e GROUP BY 1, 2""")
def continuation(spark, d):
    """Entries start at lines that end a sentence and own the lines up to the next."""
    found = sections.runs(table(spark, d, "documents"), "doc_id", "text", lambda line: F.endswith(line, F.lit(".")))
    return found.select("doc_id", "entry", (F.col("last") - F.col("first") + 1).alias("lines"))


# order, sets, ranges


@query("""
SELECT id, row_number() OVER (ORDER BY length(id), id) AS numeric_place, row_number() OVER (ORDER BY id) AS byte_place FROM (SELECT 't' || CAST(s_suppkey AS VARCHAR) AS id FROM supplier)""")
def ordered_output(spark, d):
    """Ids in the order of their numbers and in the order of their bytes."""
    rows = table(spark, d, "supplier").select(F.concat(F.lit("t"), F.col("s_suppkey").cast("string")).alias("id"))
    numeric = ids.places(rows, "numeric_place", [F.length("id"), F.col("id")], shared_dir(spark))
    return ids.places(numeric, "byte_place", [F.col("id")], shared_dir(spark))


@query("""
SELECT 'conflict' AS lane, CAST(event_id AS VARCHAR) AS subject FROM events WHERE event_type = 'error' AND value > 20
UNION ALL SELECT 'question', CAST(conv_id AS VARCHAR) || '/' || CAST(turn AS VARCHAR) FROM conversations WHERE role = 'system'
UNION ALL SELECT 'violation', CAST(doc_id AS VARCHAR) FROM labels WHERE toxic = 1
UNION ALL SELECT 'gap', CAST(doc_id AS VARCHAR) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def status_open(spark, d):
    turns = table(spark, d, "conversations").where("role = 'system'")
    registers_ = {
        "conflict": (table(spark, d, "events").where("event_type = 'error' AND value > 20"), F.col("event_id")),
        "question": (turns, F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string"))),
        "violation": (table(spark, d, "labels").where("toxic = 1"), F.col("doc_id")),
        "gap": (references.unresolved(table(spark, d, "documents").select("doc_id"), "doc_id", table(spark, d, "labels"), "doc_id"), F.col("doc_id")),
    }
    return lookup.lanes(registers_)


@query("SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def set_difference(spark, d):
    return table(spark, d, "documents").select("doc_id").subtract(table(spark, d, "labels").select("doc_id"))


#: A range for each supplier: some are reversed, some too long.
RANGES_SQL = "(SELECT s_suppkey, CAST(s_suppkey AS BIGINT) AS lo, CAST(s_suppkey + CASE WHEN s_suppkey % 10 = 0 THEN 1000 WHEN s_suppkey % 10 = 1 THEN 999 ELSE s_suppkey % 7 - 2 END AS BIGINT) AS hi FROM supplier) r"


def _ranges(spark, d):
    key = F.col("s_suppkey").cast("long")
    width = F.when(key % 10 == 0, 1000).when(key % 10 == 1, 999).otherwise(key % 7 - 2)
    return table(spark, d, "supplier").select("s_suppkey", key.alias("lo"), (key + width).alias("hi"))


@query(f"SELECT s_suppkey, unnest(CASE WHEN hi >= lo AND hi - lo < 1000 THEN range(lo, hi + 1) ELSE [] END) AS n FROM {RANGES_SQL}")
def range_expand(spark, d):
    return ids.expand_ranges(_ranges(spark, d), "lo", "hi").select("s_suppkey", "n")


@query(f"SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE EXISTS (SELECT 1 FROM {RANGES_SQL} WHERE hi >= lo AND hi - lo < 1000 AND l_partkey BETWEEN lo AND hi)")
def range_members(spark, d):
    """Rows whose number lies in a range, with no range expanded."""
    return ids.in_ranges(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), "l_partkey", _ranges(spark, d), "lo", "hi")


@query(f"SELECT s_suppkey, CASE WHEN hi < lo THEN 'reversed' ELSE 'over-cap' END AS why FROM {RANGES_SQL} WHERE hi < lo OR hi - lo >= 1000")
def range_named(spark, d):
    return ids.bad_ranges(_ranges(spark, d), "lo", "hi").select("s_suppkey", "why")


@query("""
WITH a AS (SELECT p_type || '/' || p_brand AS line, count(*) AS n FROM part WHERE p_size < 40 GROUP BY 1), b AS (SELECT p_type || '/' || p_brand AS line, count(*) AS n FROM part WHERE p_size > 3 GROUP BY 1)
SELECT coalesce(a.line, b.line) AS line, CASE WHEN coalesce(a.n, 0) > coalesce(b.n, 0) THEN 'removed' ELSE 'added' END AS change, abs(coalesce(a.n, 0) - coalesce(b.n, 0)) AS n
FROM a FULL JOIN b ON a.line = b.line WHERE coalesce(a.n, 0) <> coalesce(b.n, 0)""")
def reindex_check(spark, d):
    """The lines by which a stored view and a generated one differ."""
    part, line = table(spark, d, "part"), F.concat_ws("/", "p_type", "p_brand").alias("line")
    return sections.line_diff(part.where("p_size < 40").select(line), part.where("p_size > 3").select(line), "line")


EVENT_VIEWS_SQL = """
WITH old AS (SELECT event_id, row_number() OVER (ORDER BY event_id) AS place, event_id || ' ' || event_type AS line FROM events WHERE event_id % 7 <> 0),
new AS (SELECT event_id, row_number() OVER (ORDER BY event_id) AS place, event_id || ' ' || event_type AS line FROM events WHERE event_id % 5 <> 0)"""


@query(f"""{EVENT_VIEWS_SQL}, kept AS (SELECT event_id FROM old JOIN new USING (event_id)),
changes AS (
    SELECT 'removed' AS change, event_id, place, line FROM old WHERE event_id NOT IN (FROM kept)
    UNION ALL SELECT 'added', event_id, place, line FROM new WHERE event_id NOT IN (FROM kept))
SELECT change, place, (SELECT count(*) FROM kept WHERE kept.event_id < changes.event_id) AS kept_before, line FROM changes""")
def line_diff(spark, d):
    """The edit script between two views of events; lines stand once, so there is one shortest script."""
    e, shared = table(spark, d, "events"), shared_dir(spark)
    line = F.concat(F.col("event_id").cast("string"), F.lit(" "), F.col("event_type")).alias("line")
    view = lambda n: ids.places(e.where(F.col("event_id") % n != 0).select("event_id", line), "place", ["event_id"], shared)
    return diff.edit_script(view(7), view(5), "place", "line", shared)


@query("""
WITH keyed AS (SELECT *, l_orderkey % 10 = 3 AS moved, concat_ws('/', l_returnflag, l_linestatus, l_linenumber, l_suppkey % 5) AS line FROM lineitem WHERE l_partkey % 6 <> 0)
SELECT row_number() OVER (ORDER BY moved, l_orderkey, l_linenumber, l_partkey, l_suppkey, line) AS place, line FROM keyed""")
def line_diff_replayed(spark, d):
    """The view that the script makes of another: lines that stand thousands of times, an order with stretches moved, rows gone and new."""
    rows, shared = table(spark, d, "lineitem"), shared_dir(spark)
    line = F.concat_ws("/", "l_returnflag", "l_linestatus", "l_linenumber", F.col("l_suppkey") % 5).alias("line")
    keyed = rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.col("l_orderkey") % 10 == 3).alias("moved"), line)
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "line"]
    old = ids.places(keyed.where("l_partkey % 7 <> 0"), "place", order, shared).select("place", "line")
    new = ids.places(keyed.where("l_partkey % 6 <> 0"), "place", ["moved", *order], shared).select("place", "line")
    return diff.replayed(old, diff.edit_script(old, new, "place", "line", shared), "place", "line", shared)


# scalars


@query("SELECT doc_id, sha256(text) AS digest, octet_length(encode(text)) AS size FROM documents")
def truth_digest(spark, d):
    return table(spark, d, "documents").select("doc_id", R.content_digest(F.col("text")).alias("digest"), F.octet_length("text").cast("long").alias("size"))


@query(r"""
SELECT doc_id, sha256('---' || chr(10) || 'id: ' || CAST(doc_id AS VARCHAR) || chr(10) || 'lang: ' || lang || chr(10) || '---' || chr(10) || 'status: body' || chr(10) || text) AS digest FROM documents""")
def mat_digest(spark, d):
    """Digest of a converted copy with CRLF ends and a status line in its frontmatter, both of no effect."""
    text = F.concat(F.lit("---\r\nid: "), F.col("doc_id").cast("string"), F.lit("\r\nstatus: "), F.col("source"), F.lit("\r\nlang: "), F.col("lang"), F.lit("\r\n---\r\nstatus: body\r\n"), F.replace(F.col("text"), F.lit("\n"), F.lit("\r\n")))
    return table(spark, d, "documents").select("doc_id", F.sha2(R.material_body(text), 256).alias("digest"))


@query(f"""
WITH files AS (SELECT CASE WHEN doc_id % 8 = 0 THEN 'file ' || CAST(doc_id AS VARCHAR) ELSE 'tree ' || CAST(doc_id // 8 AS VARCHAR) END AS tree, CAST(doc_id AS VARCHAR) AS name, sha256(text) AS digest FROM documents)
SELECT tree, CASE WHEN count(*) = 1 THEN any_value(digest) ELSE sha256(string_agg(name || chr(0) || digest || chr(10), '' ORDER BY name)) END AS digest FROM files GROUP BY 1""")
def artifact_digest(spark, d):
    """A single file's own digest, a tree's manifest digest."""
    key = F.col("doc_id")
    tree = F.when(key % 8 == 0, F.concat(F.lit("file "), key.cast("string"))).otherwise(F.concat(F.lit("tree "), F.floor(key / 8).cast("string")))
    files = table(spark, d, "documents").select(tree.alias("tree"), F.col("doc_id").cast("string").alias("name"), R.content_digest(F.col("text")).alias("digest"))
    one = files.groupBy("tree").agg(F.count("*").alias("n"), F.min("digest").alias("only"))
    return counts.tree_digest(files, "tree", "name", "digest").join(one, "tree").select("tree", F.when(F.col("n") == 1, F.col("only")).otherwise(F.col("tree_digest")).alias("digest"))


@query("""
WITH parts AS (SELECT o_custkey AS doc, 'truth ' || CAST(o_orderkey AS VARCHAR) AS name, sha256(o_orderstatus || o_orderpriority) AS digest FROM orders WHERE o_orderstatus = 'F'
  UNION ALL SELECT c_custkey, 'source', sha256(c_name) FROM customer UNION ALL SELECT c_custkey, 'config', sha256(c_mktsegment) FROM customer)
SELECT doc, sha256(string_agg(name || chr(0) || digest || chr(10), '' ORDER BY name)) AS context_digest FROM parts GROUP BY 1""")
def context_digest(spark, d):
    """A sorted manifest of what a document rests on: cited cards, their source, the configuration."""
    orders, customer = table(spark, d, "orders").where("o_orderstatus = 'F'"), table(spark, d, "customer")
    parts = orders.select(F.col("o_custkey").alias("doc"), F.concat(F.lit("truth "), F.col("o_orderkey").cast("string")).alias("name"), F.sha2(F.concat("o_orderstatus", "o_orderpriority"), 256).alias("digest"))
    parts = parts.unionByName(customer.select(F.col("c_custkey").alias("doc"), F.lit("source").alias("name"), F.sha2("c_name", 256).alias("digest")))
    parts = parts.unionByName(customer.select(F.col("c_custkey").alias("doc"), F.lit("config").alias("name"), F.sha2("c_mktsegment", 256).alias("digest")))
    return counts.tree_digest(parts, "doc", "name", "digest").withColumnRenamed("tree_digest", "context_digest")


@query(f"SELECT doc_id, sha256({WS_SQL.format('text')}) AS digest FROM documents")
def ws_normalize(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(R.ws_normalize(F.col("text")), 256).alias("digest"))


@query(r"SELECT doc_id, regexp_matches(CASE WHEN doc_id % 11 = 0 THEN text || chr(1) ELSE text END, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]') AS is_binary FROM documents")
def is_binary(spark, d):
    text = F.when(F.col("doc_id") % 11 == 0, F.concat("text", F.char(F.lit(1)))).otherwise(F.col("text"))
    return table(spark, d, "documents").select("doc_id", R.is_binary(text).alias("is_binary"))


SLOTS = ["[open] a", "[ ] b", "[{kind}] c", "[open d", "e", "[closed] f", "[] g", "[proposed][open] h", "[Open] i", "{x}", "[{a} b] j", " [open] k"]
#: A slot for each event, followed by the event's type.
SLOTS_SQL = "(SELECT event_id, ([" + ", ".join(f"'{s}'" for s in SLOTS) + f"])[event_id % {len(SLOTS)} + 1] || ' ' || event_type AS slot FROM events) s"


@query(rf"""
SELECT event_id, CASE WHEN NOT starts_with(slot, '[') THEN 'missing' WHEN NOT contains(slot, ']') THEN 'unclosed' WHEN trim(i) = '' THEN 'blank'
  WHEN regexp_matches(i, '^\{{[^{{}}]*\}}$') THEN 'placeholder' WHEN i IN ('open', 'proposed', 'answered') THEN 'known' ELSE 'unknown' END AS state
FROM (SELECT event_id, slot, regexp_extract(slot, '^\[([^\]]*)\]', 1) AS i FROM {SLOTS_SQL})""")
def slot_parse(spark, d):
    slot = F.concat(F.get(F.array(*map(F.lit, SLOTS)), (F.col("event_id") % len(SLOTS)).cast("int")), F.lit(" "), F.col("event_type"))
    return table(spark, d, "events").select("event_id", R.slot_state(slot, ["open", "proposed", "answered"]).alias("state"))


@query(r"""
SELECT c_custkey, regexp_matches(CASE c_custkey % 5 WHEN 0 THEN '{' || c_mktsegment || '}' WHEN 1 THEN '{' || c_mktsegment || '} b' WHEN 2 THEN '{}' WHEN 3 THEN '{a}{b}' ELSE c_mktsegment END, '^\{[^{}]*\}$') AS placeholder FROM customer""")
def is_placeholder(spark, d):
    own, kind = F.col("c_mktsegment"), F.col("c_custkey") % 5
    value = F.when(kind == 0, F.concat(F.lit("{"), own, F.lit("}"))).when(kind == 1, F.concat(F.lit("{"), own, F.lit("} b"))).when(kind == 2, "{}").when(kind == 3, "{a}{b}").otherwise(own)
    return table(spark, d, "customer").select("c_custkey", R.is_placeholder(value).alias("placeholder"))


DATES = ["2023-02-29", "2026-02-31", "2026-7-3", "20261231", "", "1900-02-29", "{date}"]


@query(f"""
WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN ([{", ".join(f"'{x}'" for x in DATES)}])[o_orderkey % {len(DATES)} + 1] WHEN o_orderkey % 3 = 1 THEN strftime(o_orderdate, '%Y-%m-31') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders)
SELECT o_orderkey, regexp_matches(day, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$') AND try_strptime(day, '%Y-%m-%d') IS NOT NULL AS valid FROM o""")
def date_valid(spark, d):
    """Days of orders, the 31st of their months, and other forms."""
    key = F.col("o_orderkey")
    day = F.when(key % 3 == 0, F.get(F.array(*map(F.lit, DATES)), (key % len(DATES)).cast("int"))).when(key % 3 == 1, F.date_format("o_orderdate", "yyyy-MM-31")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return table(spark, d, "orders").select("o_orderkey", R.date_valid(day).alias("valid"))


@query("""
SELECT l_orderkey, l_linenumber, 't' || lpad(CAST(l_partkey AS VARCHAR), CAST(greatest(3, length(CAST(l_partkey AS VARCHAR))) AS INTEGER), '0') AS id, l_partkey < 1000 AND l_linenumber % 2 = 0 AS respelt FROM lineitem""")
def canon_id(spark, d):
    """Ids with more and fewer zeros than they should have, in their one spelling."""
    lenient = F.concat(F.lit("t"), F.repeat(F.lit("0"), F.col("l_linenumber") % 2 * 4), F.col("l_partkey").cast("string"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", R.canon_id(lenient).alias("id"), ((F.col("l_partkey") < 1000) & (F.col("l_linenumber") % 2 == 0)).alias("respelt"))


@query("""
SELECT o_orderkey, concat_ws('; ', CASE WHEN o_orderstatus = 'P' THEN 'PLAN-STAGE' END, 'as of ' || strftime(o_orderdate, '%Y-%m-%d'),
  CASE WHEN o_orderpriority = '1-URGENT' THEN 'derived: ' || o_orderpriority WHEN o_orderpriority = '5-LOW' THEN 'adopted' END, CASE WHEN o_totalprice < 5000 THEN 'retracted source' END) AS label FROM orders""")
def label_builder(spark, d):
    provenance = F.when(F.col("o_orderpriority") == "1-URGENT", "derived").when(F.col("o_orderpriority") == "5-LOW", "adopted").otherwise("stated")
    label = R.label_text(F.when(F.col("o_orderstatus") == "P", "plan"), F.date_format("o_orderdate", "yyyy-MM-dd"), provenance, F.array("o_orderpriority"), F.col("o_totalprice") < 5000)
    return table(spark, d, "orders").select("o_orderkey", label.alias("label"))


@query(r"""
SELECT p_partkey, list_transform(regexp_extract_all('t' || CAST(p_size AS VARCHAR) || ' ' || p_name || ' t00' || CAST(p_partkey AS VARCHAR) || ' at7', '\bt0*([0-9]+)\b', 1), lambda x: 't' || lpad(x, CAST(greatest(3, length(x)) AS INTEGER), '0')) AS tokens FROM part""")
def id_tokens(spark, d):
    text = F.concat(F.lit("t"), F.col("p_size").cast("string"), F.lit(" "), F.col("p_name"), F.lit(" t00"), F.col("p_partkey").cast("string"), F.lit(" at7"))
    return table(spark, d, "part").select("p_partkey", R.id_tokens(text).alias("tokens"))


@query(r"SELECT doc_id, len(string_split(text, chr(10))) AS lines, len(list_filter(string_split(text, chr(10)), lambda x: x = '')) AS blank FROM documents")
def eol_split(spark, d):
    """Lines of texts with CRLF ends; the CR is no content."""
    lines = R.eol_lines(F.replace(F.col("text"), F.lit("\n"), F.lit("\r\n")))
    return table(spark, d, "documents").select("doc_id", F.size(lines).cast("long").alias("lines"), F.size(F.filter(lines, lambda x: x == "")).cast("long").alias("blank"))


# predicates


@query("SELECT event_id, event_type FROM events WHERE event_type NOT IN ('click', 'view', 'purchase', 'signup')")
def enum_check(spark, d):
    words = spark.createDataFrame([("click",), ("view",), ("purchase",), ("signup",)], "word string")
    return references.unresolved(table(spark, d, "events").select("event_id", "event_type"), "event_type", words, "word")


REQUIRED = ["c_name", "c_mktsegment", "c_note"]


@query("""
WITH cards AS (SELECT c_custkey, c_name, CASE WHEN c_custkey % 5 = 0 THEN '{segment}' WHEN c_custkey % 5 = 1 THEN '' ELSE c_mktsegment END AS c_mktsegment FROM customer)
SELECT c_custkey, 'c_mktsegment' AS field, CASE WHEN c_mktsegment = '' THEN 'empty' ELSE 'placeholder' END AS problem FROM cards WHERE c_mktsegment IN ('', '{segment}')
UNION ALL SELECT c_custkey, 'c_note', 'missing' FROM cards""")
def required_fields(spark, d):
    segment = F.when(F.col("c_custkey") % 5 == 0, "{segment}").when(F.col("c_custkey") % 5 == 1, "").otherwise(F.col("c_mktsegment"))
    cards = table(spark, d, "customer").select("c_custkey", F.create_map(F.lit("c_name"), F.col("c_name"), F.lit("c_mktsegment"), segment).alias("fields"))
    return lookup.required(cards, "c_custkey", "fields", REQUIRED)


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'N')")
def conditional_requirement(spark, d):
    """An open order needs a line that was not returned, as an external audience needs labels."""
    have = table(spark, d, "lineitem").where("l_returnflag = 'N'").select("l_orderkey").distinct()
    return references.unresolved(table(spark, d, "orders").where("o_orderstatus = 'O'").select("o_orderkey"), "o_orderkey", have, "l_orderkey")


@query("SELECT event_id FROM events WHERE json_exists(props, '$.k') AND event_type = 'error'")
def forbidden_fields(spark, d):
    return table(spark, d, "events").where("event_type = 'error'").where(R.has_field(F.from_json("props", "map<string,string>"), ["k", "resolution"])).select("event_id")


@query("""
SELECT c_custkey, 'tags' AS field FROM customer WHERE c_custkey % 4 IN (0, 3)""")
def unclosed_list(spark, d):
    """Cards whose list of tags is not closed in its line, or only within a comment."""
    kind, own = F.col("c_custkey") % 4, F.col("c_mktsegment")
    value = F.when(kind == 0, F.concat(F.lit("[a, "), own)).when(kind == 1, F.concat(F.lit("[a, "), own, F.lit("]"))).when(kind == 2, F.concat(own, F.lit("]"))).otherwise(F.concat(F.lit("["), own, F.lit(" # ]")))
    text = F.concat(F.lit("---\nid: "), F.col("c_custkey").cast("string"), F.lit("\ntags: "), value, F.lit("\n---\nbody [open\n"))
    found = registers.card_states(table(spark, d, "customer").select("c_custkey", text.alias("text")), "c_custkey", "text")
    return found.select("c_custkey", F.explode("open_lists").alias("field"))


@query("""
WITH l AS (SELECT event_id, CASE WHEN event_id % 50 = 0 THEN '' ELSE 't' || CAST(user_id AS VARCHAR) END AS id, CASE WHEN event_id % 7 = 0 THEN 'zz' WHEN event_id % 3 = 0 THEN '-' ELSE sha256(props) END AS digest,
  event_type AS word, CASE WHEN event_id % 13 = 0 THEN '2024-02-30' ELSE strftime(ts, '%Y-%m-%d') END AS day FROM events)
SELECT event_id, CASE WHEN id = '' THEN 'headless' WHEN digest = 'zz' THEN 'bad-digest' WHEN day = '2024-02-30' THEN 'bad-date' WHEN word NOT IN ('click', 'view') THEN 'unknown-word' ELSE 'ok' END AS row_state FROM l""")
def row_wellformed(spark, d):
    id_ = F.when(F.col("event_id") % 50 == 0, "").otherwise(F.concat(F.lit("t"), F.col("user_id").cast("string")))
    digest = F.when(F.col("event_id") % 7 == 0, "zz").when(F.col("event_id") % 3 == 0, "-").otherwise(F.sha2("props", 256))
    day = F.when(F.col("event_id") % 13 == 0, "2024-02-30").otherwise(F.date_format("ts", "yyyy-MM-dd"))
    return table(spark, d, "events").select("event_id", R.row_state(id_, digest, F.col("event_type"), day, ["click", "view"]).alias("row_state"))


# commands


@query("""
WITH first AS (SELECT doc_id, 'claim' AS lane FROM documents WHERE contains(source || ' ' || lang, 'src1'))
SELECT doc_id, lane FROM first UNION ALL SELECT doc_id, 'body' FROM documents WHERE contains(text, 'src1') AND NOT EXISTS (SELECT 1 FROM first)""")
def pull(spark, d):
    """Cards whose claim or tags hold the term; only if there are none, those whose body does."""
    term = F.lit("src1")
    found = lookup.pull(table(spark, d, "documents"), F.contains(F.concat_ws(" ", "source", "lang"), term), F.contains("text", term))
    return found.select("doc_id", "lane")


@query("SELECT DISTINCT l_suppkey AS material, l_orderkey AS truth, o_custkey AS document FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_suppkey = 7")
def impact(spark, d):
    """What rests on one material, in two hops."""
    return lookup.impact(table(spark, d, "lineitem"), "l_suppkey", "l_orderkey", table(spark, d, "orders"), "o_orderkey", "o_custkey", 7)


@query(rf"""
WITH t AS MATERIALIZED (SELECT doc_id, {WS_SQL.format('text')} AS flat, 'm' || lpad(CAST(doc_id AS VARCHAR), CAST(greatest(3, length(CAST(doc_id AS VARCHAR))) AS INTEGER), '0') AS material, regexp_extract(text, '[a-z]+ [a-z]+ [a-z]+') AS title FROM documents),
truths AS (SELECT doc_id, material, 't' || CAST(doc_id AS VARCHAR) AS truth FROM t WHERE doc_id % 3 = 0)
SELECT material, 'truth' AS way, truth AS unit FROM truths
UNION SELECT material, 'by_truths', CAST(turn AS VARCHAR) || '/' || CAST(conv_id AS VARCHAR) FROM truths JOIN conversations ON truths.doc_id = conv_id
UNION SELECT a.material, 'by_id', CAST(b.doc_id AS VARCHAR) FROM t a JOIN t b ON b.doc_id = a.doc_id + 1
UNION SELECT a.material, 'by_title', CAST(b.doc_id AS VARCHAR) FROM t a JOIN t b ON a.title <> '' AND contains(b.flat, a.title)""")
def impact_all(spark, d):
    """What rests on every document, each with words of its own as title and named by the next one's id token: all ways at once."""
    docs = table(spark, d, "documents")
    key = F.col("doc_id").cast("string")
    materials = docs.select(R.canon_id(F.concat(F.lit("m"), key)).alias("material"), F.regexp_extract("text", "[a-z]+ [a-z]+ [a-z]+", 0).alias("title"))
    truths = docs.where("doc_id % 3 = 0").select(R.canon_id(F.concat(F.lit("m"), key)).alias("source"), F.concat(F.lit("t"), key).alias("truth"))
    citing = table(spark, d, "conversations").select(F.concat(F.lit("t"), F.col("conv_id").cast("string")).alias("cited"), F.concat_ws("/", "turn", "conv_id").alias("document"))
    before = F.when(F.col("doc_id") > 0, F.concat(F.lit("\n(m0"), (F.col("doc_id") - 1).cast("string"), F.lit(")"))).otherwise("")
    texts = docs.select("doc_id", F.concat("text", before).alias("text"))
    return lookup.impact_all(materials, "material", "title", truths, "source", "truth", citing, "cited", "document", texts, "doc_id", "text")


@query(r"""
SELECT doc_id, CAST(line_no AS BIGINT) AS line_no, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents)
WHERE regexp_matches(line, '(Licensed under|password|token = )')""")
def gaps(spark, d):
    return lookup.marked_lines(table(spark, d, "documents"), "doc_id", "text", "(Licensed under|password|token = )")


@query("""
SELECT o_custkey AS doc, CASE WHEN bool_or(o_orderstatus = 'O') THEN 'O' WHEN bool_or(o_orderstatus = 'P') THEN 'P' ELSE 'F' END AS stage, count(*) AS parts FROM orders GROUP BY 1""")
def status(spark, d):
    return lookup.stages(table(spark, d, "orders").select(F.col("o_custkey").alias("doc"), "o_orderstatus"), "doc", "o_orderstatus", ["O", "P", "F"])


@query("SELECT DISTINCT tag, p_partkey AS member FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS tag FROM part)")
def tag_tree(spark, d):
    return ids.tag_tree(table(spark, d, "part").select("p_partkey", F.split("p_name", " ").alias("tags")), "p_partkey", "tags")


@query("""
WITH t AS (SELECT p_partkey, list_transform(string_split(p_name || ' blue', ' '), lambda t: CASE WHEN t = 'red' THEN 'blue' ELSE t END) AS tags FROM part)
SELECT p_partkey, array_to_string(list_filter(tags, lambda t, i: list_position(tags, t) = i), ' ') AS tags FROM t""")
def retag(spark, d):
    tags = table(spark, d, "part").select("p_partkey", F.split(F.concat("p_name", F.lit(" blue")), " ").alias("tags"))
    return ids.retag(tags, "tags", "red", "blue").select("p_partkey", F.array_join("tags", " ").alias("tags"))


@query("""
WITH o AS (SELECT 'customer' AS namespace, max(c_custkey) AS observed FROM customer UNION ALL SELECT 'part', max(p_partkey) FROM part UNION ALL SELECT 'nation', max(n_nationkey) FROM nation)
SELECT namespace, observed, nxt AS next FROM o JOIN (VALUES ('customer', CAST(100 AS BIGINT)), ('part', 100000000), ('nation', 25)) c(namespace, nxt) USING (namespace) WHERE observed >= nxt""")
def idseq_behind(spark, d):
    seen = [("customer", "c_custkey"), ("part", "p_partkey"), ("nation", "n_nationkey")]
    observed = None
    for name, key in seen:
        one = table(spark, d, name).select(F.lit(name).alias("namespace"), F.col(key).cast("long").alias("number"))
        observed = one if observed is None else observed.unionByName(one)
    counters = spark.createDataFrame([("customer", 100), ("part", 100_000_000), ("nation", 25)], "namespace string, next long")
    return ids.counters_behind(observed, "namespace", "number", counters)


@query("""
SELECT 'customer' AS namespace, max(c_custkey) + 1 AS granted FROM customer UNION ALL SELECT 'part', max(p_partkey) + 1 FROM part""")
def alloc(spark, d):
    """The number that each namespace grants next: one above all that were ever seen."""
    seen = [table(spark, d, n).select(F.lit(n).alias("namespace"), F.col(k).alias("number")) for n, k in (("customer", "c_custkey"), ("part", "p_partkey"))]
    return ids.next_numbers(seen[0].unionByName(seen[1]), "namespace", "number")


@query("""
WITH e AS (SELECT event_id, 'c' || lpad(CAST(event_id AS VARCHAR), CAST(greatest(3, length(CAST(event_id AS VARCHAR))) AS INTEGER), '0') AS id, 't' || lpad(CAST(user_id AS VARCHAR), CAST(CAST(greatest(3, length(CAST(user_id AS VARCHAR))) AS INTEGER) AS INTEGER), '0') AS t, strftime(ts, '%Y-%m-%d') AS day, event_type FROM events)
SELECT event_id, '{' || chr(10) || '  "version": 1,' || chr(10) || '  "open": [' || chr(10) || '    {' || chr(10) || '      "id": "' || id || '",' || chr(10) || '      "targets": [' || chr(10) || '        "' || t || '"' || chr(10) || '      ],' || chr(10)
  || '      "candidates": [' || chr(10) || '        {' || chr(10) || '          "claim": "' || event_type || '",' || chr(10) || '          "source": "m001"' || chr(10) || '        }' || chr(10) || '      ],' || chr(10)
  || '      "created": "' || day || '"' || CASE WHEN event_type = 'error' THEN ',' || chr(10) || '      "note": "error"' ELSE '' END || chr(10) || '    }' || chr(10) || '  ]' || chr(10) || '}' || chr(10) AS store FROM e""")
def canonical_serialization(spark, d):
    """Stores written with other spaces and another order of keys, in their one spelling; an absent note is left out."""
    return registers.canonical_stores(_stores(spark, d), "event_id", "text")


@query("""
SELECT event_id, CASE WHEN event_id % 9 = 0 THEN 'CONF-CREATED' ELSE '' END AS refused, CASE WHEN event_id % 9 = 0 THEN NULL ELSE 't' || lpad(CAST(user_id AS VARCHAR), CAST(CAST(greatest(3, length(CAST(user_id AS VARCHAR))) AS INTEGER) AS INTEGER), '0') END AS target,
  CASE WHEN event_id % 9 = 0 THEN NULL ELSE event_type END AS claim FROM events""")
def conflict_list(spark, d):
    """The open entries of stores, and why a store is refused as a whole."""
    found = registers.conflict_entries(_stores(spark, d, refused=True), "event_id", "text")
    return found.select("event_id", "refused", F.get("targets", F.lit(0)).alias("target"), F.get("claims", F.lit(0)).alias("claim"))


def _stores(spark, d, refused: bool = False):
    """A conflict store of one entry for each event."""
    pad = lambda letter, c: R.canon_id(F.concat(F.lit(letter), F.col(c).cast("string")))
    day = F.date_format("ts", "yyyy-MM-dd")
    day = F.when(F.col("event_id") % 9 == 0, "today").otherwise(day) if refused else day
    candidate = F.struct(F.lit("m001").alias("source"), F.col("event_type").alias("claim"))
    entry = F.struct(F.when(F.col("event_type") == "error", "error").alias("note"), day.alias("created"), F.array(candidate).alias("candidates"), F.array(pad("t", "user_id")).alias("targets"), pad("c", "event_id").alias("id"))
    return table(spark, d, "events").select("event_id", F.to_json(F.struct(F.array(entry).alias("open"), F.lit(1).alias("version"))).alias("text"))


@query("""
SELECT doc_id AS node, min(doc_id) OVER (PARTITION BY text) AS root FROM documents
WHERE text IN (SELECT text FROM documents GROUP BY text HAVING count(*) > 1)""")
def upgrade_components(spark, d):
    """Groups of cards that are in conflict with one another: here texts with equal digests, each naming the first."""
    digest = table(spark, d, "documents").select("doc_id", R.content_digest(F.col("text")).alias("digest"))
    first = digest.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first <> last")
    return ids.groups(digest.join(first, "digest"), "doc_id", "first", shared_dir(spark))


@query("""
SELECT count(*) AS before, count(*) FILTER (WHERE quality = 1 AND toxic = 0) AS kept, count(*) FILTER (WHERE toxic = 1) AS deleted, count(*) FILTER (WHERE quality = 0 AND toxic = 0) AS moved, TRUE AS conserved FROM labels""")
def conservation(spark, d):
    word = F.when(F.col("toxic") == 1, "deleted").when(F.col("quality") == 0, "moved").otherwise("kept")
    return counts.conservation(table(spark, d, "labels").select(word.alias("disposition")), "disposition", ["kept", "deleted", "moved"])


@query("SELECT doc_id, 'legacy-unbound' AS word FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def upgrade_backfill(spark, d):
    return references.unresolved(table(spark, d, "documents").select("doc_id"), "doc_id", table(spark, d, "labels"), "doc_id").withColumn("word", F.lit("legacy-unbound"))


@query("""
SELECT doc_id, 't' || CAST(doc_id AS VARCHAR) || CASE WHEN doc_id % 3 = 0 THEN '-t' || CAST(doc_id + 2 AS VARCHAR) ELSE '' END AS unit FROM labels WHERE quality = 1""")
def verified_units(spark, d):
    """Lines that count only if their last token is the marker, and only in their own section."""
    own = F.concat(F.lit("t"), F.col("doc_id").cast("string"))
    unit = F.when(F.col("doc_id") % 3 == 0, F.concat(own, F.lit("-t"), (F.col("doc_id") + 2).cast("string"))).otherwise(own)
    text = F.concat(F.lit("# Verified units\n\n- "), unit, F.when(F.col("quality") == 1, " by hand verified").otherwise(" was verified once"), F.lit("\n\n## Human queue\n\n- [open] is t1 verified\n"))
    return registers.verified_ids(table(spark, d, "labels").select("doc_id", text.alias("text")), "doc_id", "text")


@query(f"WITH {QUEUE_SQL} SELECT doc_id, 'HQ-UNTAGGED' AS code FROM l WHERE quality = 1 AND owner = ''")
def human_queue(spark, d):
    """Open entries without a valid ownership tag."""
    return registers.untagged(registers.queue_entries(_queues(spark, d), "doc_id", "text")).select("doc_id", F.lit("HQ-UNTAGGED").alias("code"))


@query("""
SELECT event_id, '{"code":"' || event_type || '","message":"e' || CAST(event_id AS VARCHAR) || '"}' AS diagnostic FROM events WHERE value > 30""")
def json_output(spark, d):
    """Each diagnostic as a JSON object; a report of all is their lines."""
    return table(spark, d, "events").where("value > 30").select("event_id", R.diagnostic_json(F.col("event_type"), F.concat(F.lit("e"), F.col("event_id").cast("string"))).alias("diagnostic"))


GATE_SQL = """
g AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'GATE-OPEN' WHEN 1 THEN 'REVIEW-KIND-UNKNOWN' WHEN 2 THEN 'GATE-ZONE' WHEN 3 THEN 'GATE-MISSING' WHEN 4 THEN 'REVIEW-UNTERMINATED-FENCE' END AS code FROM labels)"""


@query(f"WITH {GATE_SQL} SELECT doc_id, code FROM g WHERE code IS NOT NULL")
def review_gate(spark, d):
    """What keeps the gate of each review from passing."""
    kind = F.col("doc_id") % 6
    entry = F.when(kind == 0, "- [unsupported] line 3").when(kind == 1, "- [typo] line 4").otherwise("- [{kind}] {what}")
    text = F.concat(F.when(kind == 3, "## Violations").otherwise("## Fidelity violations"), F.lit("\n\n"), F.when(kind == 3, "").otherwise(entry), F.lit("\n\n## Findings\n\n"), F.when(kind == 2, "[Missing Required] here").when(kind == 4, "```\nnever ended").otherwise("A contradiction in prose."), F.lit("\n"))
    return registers.gate(table(spark, d, "labels").select("doc_id", text.alias("text")), "doc_id", "text").select("doc_id", "code")


@query("""
SELECT doc_id, CASE WHEN quality = 1 THEN 'Open' ELSE 'Accepted' END AS section, CASE WHEN doc_id % 3 = 0 THEN 'malformed' WHEN doc_id % 3 = 1 THEN 'declared' ELSE 'symmetry' END AS kind FROM labels""")
def gap_register(spark, d):
    """The entries of gap registers with their section and kind."""
    entry = F.concat(F.when(F.col("doc_id") % 3 == 0, "- no kind").when(F.col("doc_id") % 3 == 1, "- [declared] a gap").otherwise("- [symmetry] a gap"), F.lit("\n"))
    open_ = F.col("quality") == 1
    text = F.concat(F.lit("## Open\n\n"), F.when(open_, entry).otherwise(""), F.lit("\n## Accepted\n\n"), F.when(open_, "").otherwise(entry))
    return registers.gap_entries(table(spark, d, "labels").select("doc_id", text.alias("text")), "doc_id", "text").select("doc_id", "section", "kind")


@query("""
SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'open' WHEN 1 THEN 'proposed' WHEN 2 THEN 'answered' ELSE 'unrecognised' END AS state FROM labels""")
def question_register(spark, d):
    """Questions with their state; comments and noise are none."""
    slot = F.get(F.array(*map(F.lit, ["[open]", "[proposed]", "[answered]", "[closed]"])), (F.col("doc_id") % 4).cast("int"))
    text = F.concat(F.lit("# Questions\n\n<!-- - [open] hidden -->\n- [{state}] {question}\n- "), slot, F.lit(" what now\n  more of it\n"))
    return registers.questions(table(spark, d, "labels").select("doc_id", text.alias("text")), "doc_id", "text").select("doc_id", "state")