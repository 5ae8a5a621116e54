"""Registered queries over the given tables, with the SQL that they are held against.

Tables stand in for those of a knowledge base: documents for documents, events for tool calls, orders and customers for
decisions and raw documents, lineitem for results and triples, embeddings for vectors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as P
from ..operators import aggregates as A
from ..operators import chunking as C
from ..operators import dedup as D
from ..operators import evaluation as E
from ..operators import filters as L
from ..operators import graph as G
from ..operators import joins as J
from ..operators import privacy as R
from ..operators import ranking as W
from ..operators import search as V
from ..operators.lineage import cut
from ..operators.ranking import global_rank
from ..sources import tables as S
from .registry import query

#: The documents table in the document model, as SQL.
M = """m AS (SELECT doc_id AS id, 'doc-' || doc_id AS doc_id, source AS source_id, lang AS parser_id,
  CASE WHEN n_chars < 200 THEN 'table' WHEN n_chars < 800 THEN 'section' ELSE 'text' END AS doc_type, text, n_chars FROM documents)"""
CALLS = """calls AS (SELECT event_id, ts AS created_time, user_id AS session_id, event_type AS tool, value AS duration_ms,
  CASE WHEN event_type = 'error' THEN 'error' ELSE 'ok' END AS status FROM events)"""
#: Line items as evaluation results: a run for each line status and flag, hits by discount, ranks by line number.
RESULTS = """results AS (SELECT l_returnflag || l_linestatus AS run_id, l_orderkey AS question_id, l_discount >= 0.05 AS is_hit,
  CASE WHEN l_discount >= 0.05 THEN l_linenumber END AS hit_rank, CASE WHEN l_quantity > 10 THEN l_tax > 0.02 END AS is_judge_hit FROM lineitem)"""


def docs(spark, d) -> DataFrame:
    return S.as_documents(S.read_table(spark, d, "documents"))


def calls(spark, d) -> DataFrame:
    status = F.when(F.col("event_type") == "error", "error").otherwise("ok")
    return S.read_table(spark, d, "events").select("event_id", F.col("ts").alias("created_time"), F.col("user_id").alias("session_id"), F.col("event_type").alias("tool"), F.col("value").alias("duration_ms"), status.alias("status"))


def results(spark, d) -> DataFrame:
    hit = F.col("l_discount") >= 0.05
    return S.read_table(spark, d, "lineitem").select(
        F.concat("l_returnflag", "l_linestatus").alias("run_id"), F.col("l_orderkey").alias("question_id"), hit.alias("is_hit"),
        F.when(hit, F.col("l_linenumber")).alias("hit_rank"), F.when(F.col("l_quantity") > 10, F.col("l_tax") > 0.02).alias("is_judge_hit"),
    )


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    for c in columns:
        df = df.withColumn(c, F.round(c, digits))
    return df


# -- sources and syncs


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 10 = 0)")
def s08_sync_missing(spark, d):
    src, dst = S.read_table(spark, d, "customer"), S.read_table(spark, d, "orders").where("o_orderkey % 10 = 0").select(F.col("o_custkey").alias("c_custkey"))
    return S.sync_missing(src, dst, ["c_custkey"]).select("c_custkey", "c_name")


@query("""WITH newest AS (SELECT o_custkey AS entry, max(o_orderdate) AS newest FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)
SELECT o_orderkey FROM orders LEFT JOIN newest ON entry = o_custkey WHERE o_orderstatus <> 'F' AND (newest IS NULL OR o_orderdate > newest)""")
def s05_changed_items(spark, d):
    o = S.read_table(spark, d, "orders").select("o_orderkey", "o_orderstatus", F.col("o_custkey").alias("entry"), F.col("o_orderdate").alias("listed"))
    done = o.where("o_orderstatus = 'F'").select("entry", F.col("listed").alias("revised"))
    return S.changed_items(o.where("o_orderstatus <> 'F'"), done).select("o_orderkey")


@query("""SELECT user_id AS run, count(*) AS found, count(*) FILTER (event_type = 'click') AS processed, count(*) FILTER (event_type = 'view') AS skipped,
  count(*) FILTER (event_type = 'error') AS failed FROM events GROUP BY 1""")
def s06_import_runs(spark, d):
    status = F.when(F.col("event_type") == "click", "processed").when(F.col("event_type") == "view", "skipped").when(F.col("event_type") == "error", "failed")
    items = S.read_table(spark, d, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("item"), status.alias("status"))
    return S.import_run_summary(items).drop("first_failures")


@query("""SELECT 'orders' AS name, (SELECT count(*) FROM orders) AS src_rows, (SELECT count(*) FROM orders WHERE o_orderkey % 3 = 0) AS dst_rows, NULL::BIGINT AS orphans
UNION ALL SELECT 'order_customer', NULL, NULL, (SELECT count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0))""")
def s09_verify_sync(spark, d):
    o, c = S.read_table(spark, d, "orders"), S.read_table(spark, d, "customer")
    return S.verify_sync({"orders": (o, o.where("o_orderkey % 3 = 0"))}, {"order_customer": (o, "o_custkey", c.where("c_custkey % 2 = 0"), "c_custkey")})


@query("SELECT o_orderkey, date_trunc('month', o_orderdate) AS month_time, CASE WHEN o_orderkey % 2 = 0 THEN o_orderdate END AS day_time FROM orders")
def s12_source_times(spark, d):
    o = S.read_table(spark, d, "orders")
    month, day = F.date_format("o_orderdate", "yyyy-MM"), F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise("junk")
    at = lambda c: S.parse_source_time(c).cast("timestamp_ntz")
    return o.select("o_orderkey", at(month).alias("month_time"), at(day).alias("day_time"))


# -- filters


def _filter(name, tree, where):
    @query(f"WITH {M} SELECT id FROM m WHERE {where}")
    def run(spark, d):
        return docs(spark, d).where(L.predicate(tree)).select("id")

    from . import registry

    registry.QUERIES[name] = registry.QUERIES.pop("run")


_filter("f01_term", {"term": {"source_id": "src3"}}, "source_id = 'src3'")
_filter("f01_term_metadata", {"term": {"lang": "fr"}}, "parser_id = 'fr'")
_filter("f02_terms", {"terms": {"parser_id": ["de", "es"]}}, "parser_id IN ('de', 'es')")
_filter("f03_range", {"range": {"n_chars": {"gte": 500, "lt": 2000}}}, "n_chars >= 500 AND n_chars < 2000")
_filter("f04_match", {"match": {"doc_id": "-9"}}, "doc_id LIKE '%-9%'")
_filter("f05_wildcard", {"wildcard": {"doc_id": {"value": "doc-?5*"}}}, "doc_id LIKE 'doc-_5%'")
_filter(
    "f06_bool",
    {"bool": {"must": [{"term": {"parser_id": "en"}}], "should": [{"term": {"doc_type": "text"}}, {"range": {"n_chars": {"lt": 100}}}], "must_not": [{"term": {"source_id": "src0"}}]}},
    "parser_id = 'en' AND (doc_type = 'text' OR n_chars < 100) AND source_id <> 'src0'",
)


@query(f"WITH {M} SELECT id FROM m WHERE source_id = 'src1' AND doc_type = 'text' AND parser_id = 'en' AND n_chars > 1000")
def f08_build_predicate(spark, d):
    return docs(spark, d).where(L.build_predicate(source="src1", doc_type="text", query={"range": {"n_chars": {"gt": 1000}}}, lang="en")).select("id")


@query(f"WITH {M} SELECT id FROM m LEFT JOIN labels l ON l.doc_id = m.id WHERE coalesce(toxic = 0, true)")
def f09_visible(spark, d):
    state = S.read_table(spark, d, "labels").select(F.col("doc_id").alias("raw_id"), (F.col("toxic") == 0).alias("visible_search"))
    return L.visible(docs(spark, d).withColumn("raw_id", F.col("id")), state).select("id")


@query(f"WITH {M} SELECT count(*) AS n FROM m WHERE source_id IN ('src1', 'src2') AND doc_type = 'text'")
def f10_coarse_count(spark, d):
    allowed = L.coarse_constraints({"bool": {"must": [{"terms": {"source_id": ["src1", "src2", "src3"]}}, {"terms": {"source_id": ["src1", "src2"]}}, {"term": {"doc_type": "text"}}]}})
    return L.coarse_count(docs(spark, d).groupBy("source_id", "doc_type").agg(F.count(F.lit(1)).alias("n")), allowed)


@query(f"WITH {M} SELECT id, n_chars FROM m WHERE parser_id = 'de' ORDER BY n_chars DESC, id LIMIT 50")
def f11_list_filtered(spark, d):
    return L.list_filtered(docs(spark, d), F.col("parser_id") == "de", 50, "n_chars").select("id", "n_chars")


@query(f"WITH {M} SELECT id FROM m WHERE contains(text, 'License') ORDER BY id LIMIT 20 OFFSET 5")
def f12_get_documents(spark, d):
    return L.get_documents(docs(spark, d), text_contains="License", limit=20, offset=5).select("id")


@query(f"WITH {M} SELECT id FROM m WHERE parser_id = 'fr' AND NOT doc_type = 'image'")
def f13_exclude_images(spark, d):
    return docs(spark, d).where(L.predicate(L.exclude_images({"term": {"parser_id": "fr"}}))).select("id")


@query("""SELECT event_id AS id, ts AS created_time, event_type AS kind FROM events WHERE event_type IN ('click', 'error') ORDER BY ts DESC, event_id LIMIT 100""")
def f14_list_logs(spark, d):
    e = S.read_table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("created_time"), "event_type")
    return L.list_logs({k: e.where(F.col("event_type") == k).drop("event_type") for k in ("click", "error")})


@query("SELECT a.l_linenumber + a.l_orderkey * 10 AS id, b.l_linenumber + b.l_orderkey * 10 AS sibling_id FROM lineitem a JOIN lineitem b USING (l_orderkey) WHERE id <> sibling_id")
def f15_siblings(spark, d):
    return L.siblings(S.read_table(spark, d, "lineitem").select(F.col("l_orderkey").alias("raw_id"), (F.col("l_linenumber") + F.col("l_orderkey") * 10).alias("id")))


# -- text and metadata expressions


@query("SELECT doc_id, sha256(text) AS content_hash FROM documents")
def p02_content_hash(spark, d):
    return S.read_table(spark, d, "documents").select("doc_id", P.content_hash(F.col("text")).alias("content_hash"))


@query(r"SELECT doc_id, round(CASE WHEN length(text) > 0 THEN 1000.0 * len(regexp_extract_all(text, '\p{L}{4,}')) / length(text) ELSE 0 END, 6) AS prose FROM documents")
def p07_prose_density(spark, d):
    return S.read_table(spark, d, "documents").select("doc_id", F.round(P.prose_words_per_kchar(F.col("text")), 6).alias("prose"))


@query(r"""SELECT doc_id, round(CASE WHEN length(text) > 0 THEN length(regexp_replace(text,
  '[^\x{1D400}-\x{1D7FF}\x{370}-\x{3FF}\x{2200}-\x{22FF}\x{2190}-\x{21FF}\x{300}-\x{36F}\x{2070}-\x{209F}\x{2100}-\x{214F}\x{B0}-\x{BF}]', '', 'g')) / length(text)::DOUBLE ELSE 0 END, 8) AS density FROM documents""")
def p06_math_density(spark, d):
    return S.read_table(spark, d, "documents").select("doc_id", F.round(P.math_density(F.col("text")), 8).alias("density"))


@query(r"""SELECT doc_id, source || ':' || CASE WHEN regexp_extract(k, '^(\d+)(?:[-/_]|$)', 1) <> '' THEN regexp_extract(k, '^(\d+)(?:[-/_]|$)', 1) ELSE k END AS entry
FROM (SELECT doc_id, source, CASE WHEN doc_id % 3 = 0 THEN 'x' || doc_id ELSE doc_id || '-' || n_chars END AS k FROM documents)""")
def p08_entry_key(spark, d):
    x = S.read_table(spark, d, "documents")
    k = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("x"), F.col("doc_id").cast("string"))).otherwise(F.concat_ws("-", F.col("doc_id").cast("string"), F.col("n_chars").cast("string")))
    return x.select("doc_id", P.entry_key(F.col("source"), k).alias("entry"))


@query(r"SELECT doc_id, trim(regexp_replace(strip_accents(lower(coalesce(text, ''))), '\s+', ' ', 'g')) AS name FROM documents")
def p13_canonical_name(spark, d):
    return S.read_table(spark, d, "documents").select("doc_id", P.canonical_name(F.col("text")).alias("name"))


@query(r"SELECT doc_id, coalesce(len(regexp_extract_all(text, '[^ \t\n\x0B\f\r]+')), 0)::INT AS tokens FROM documents")
def p28_token_count(spark, d):
    return S.read_table(spark, d, "documents").select("doc_id", P.count_tokens(F.col("text")).alias("tokens"))


@query("SELECT doc_id, substring(text, 1001, 500) AS page, CASE WHEN length(text) > 1500 THEN 1500 END AS next_offset FROM documents")
def p31_page_text(spark, d):
    x = S.read_table(spark, d, "documents").select("doc_id", P.page_text(F.col("text"), 1000, 500).alias("p"))
    return x.select("doc_id", "p.page", "p.next_offset")


@query("""SELECT doc_id, CASE WHEN lang = 'de' OR starts_with(text, 'Section:') OR starts_with(text, 'Context:') THEN coalesce(text, '')
  ELSE CASE WHEN lang = 'en' THEN 'Section: ' || source || chr(10) || chr(10) ELSE '' END || 'Context: ' || lang || chr(10) || chr(10) || coalesce(text, '') END AS embed_text FROM documents""")
def p10_embed_text(spark, d):
    section = F.when(F.col("lang") == "en", F.col("source"))
    strategy = F.when(F.col("lang") == "de", "summary_256").otherwise("tokens")
    return S.read_table(spark, d, "documents").select("doc_id", P.embed_text(F.col("text"), section, F.col("lang"), strategy).alias("embed_text"))


@query("""SELECT event_id, event_type AS doc_type, json_extract_string(props, '$.k')::INT AS page, CASE WHEN event_type <> 'view' THEN event_type END AS caption, user_id::INT AS num_rows FROM events""")
def p11_provenance(spark, d):
    meta = F.to_json(F.struct(F.get_json_object("props", "$.k").alias("page"), F.when(F.col("event_type") == "view", "").otherwise(F.col("event_type")).alias("caption"), F.col("user_id").alias("num_rows")))
    rows = S.read_table(spark, d, "events").select("event_id", P.provenance(F.col("event_type"), meta).alias("p"))
    return rows.select("event_id", "p.doc_type", "p.page", "p.caption", "p.num_rows")


@query("SELECT doc_id, regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]{2,}', '[redacted: e-mail]', 'g') AS text FROM documents WHERE contains(text, '@')")
def p21_redact_mail(spark, d):
    x = S.read_table(spark, d, "documents").where(F.contains("text", F.lit("@")))
    return x.select("doc_id", R.redact(F.col("text"), patterns=[("e-mail", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]{2,}", False)]).alias("text"))


@query(r"""WITH f AS (SELECT doc_id AS id, unnest(list_distinct(list_transform(regexp_extract_all(text, '(?i)licen[cs]ed?\s+under\s+[a-z]+|released\s+under\s+[a-z]+'), lambda x: lower(regexp_replace(x, '\s+', ' ', 'g'))))) AS wording FROM documents)
SELECT id, 'licence' AS family, 'low' AS severity, wording FROM f""")
def p18_find_markers(spark, d):
    families = {"licence": ("low", r"(?i)licen[cs]ed?\s+under\s+[a-z]+|released\s+under\s+[a-z]+")}
    return R.find_markers(docs(spark, d), families, 1000).select("id", "family", "severity", "wording")


@query("""WITH s AS (SELECT l_orderkey AS id, l_linenumber * 10 AS b, l_linenumber * 10 + l_quantity::BIGINT AS e, l_returnflag || l_linestatus AS label, 9 - l_linenumber AS p FROM lineitem),
w AS (SELECT *, max(e) OVER (PARTITION BY id ORDER BY b, e DESC, p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM s),
i AS (SELECT *, sum(CASE WHEN before IS NULL OR b >= before THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY b, e DESC, p ROWS UNBOUNDED PRECEDING) AS island FROM w)
SELECT id, min(b) AS "begin", max(e) AS "end", arg_min(label, (b, -e, p, label)) AS label FROM i GROUP BY id, island""")
def p22_merge_spans(spark, d):
    x = S.read_table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), (F.col("l_linenumber") * 10).cast("long").alias("begin"), (F.col("l_linenumber") * 10 + F.col("l_quantity").cast("long")).alias("end"), F.concat("l_returnflag", "l_linestatus").alias("label"), (9 - F.col("l_linenumber")).alias("priority"))
    return R.merge_spans(x)


@query("""WITH f AS (SELECT l_orderkey AS id, l_orderkey * 10 + l_linenumber AS finding_id, l_linenumber * 10 AS b, l_linenumber * 10 + 5 AS e FROM lineitem),
s AS (SELECT o_orderkey AS id, 20 AS b, 45 AS e FROM orders WHERE o_orderstatus = 'O')
SELECT finding_id, EXISTS (SELECT 1 FROM s WHERE s.id = f.id AND s.b <= f.b AND s.e >= f.e) AS covered FROM f""")
def p24_finding_covered(spark, d):
    n = F.col("l_linenumber")
    f = S.read_table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), (F.col("l_orderkey") * 10 + n).alias("finding_id"), (n * 10).alias("begin"), (n * 10 + 5).alias("end"))
    s = S.read_table(spark, d, "orders").where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("id"), F.lit(20).alias("begin"), F.lit(45).alias("end"))
    return R.finding_covered(f, s).select("finding_id", "covered")


# -- joins and backlogs


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def j03_backlog(spark, d):
    done = S.read_table(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return J.backlog(S.read_table(spark, d, "customer"), done, "c_custkey", F.col("o_orderstatus") == "F").select("c_custkey")


@query("""SELECT count(*) FILTER (l.doc_id IS NULL AND length(text) <= 5000) AS to_scan, count(*) FILTER (l.doc_id IS NOT NULL) AS skipped,
count(*) FILTER (l.doc_id IS NULL AND length(text) > 5000) AS too_large FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels WHERE quality = 1) l ON l.doc_id = d.doc_id""")
def j07_scan_candidates(spark, d):
    scans = S.read_table(spark, d, "labels").select(F.col("doc_id").alias("id"), F.col("quality").cast("string").alias("version"))
    return J.scan_candidates(docs(spark, d), scans, "1", 5000)


AUDITS = """audits AS (SELECT l_orderkey AS question_id, CASE WHEN l_returnflag = 'A' THEN 'human' ELSE 'overlap' END AS audit_type, l_discount > 0.02 AS is_valid,
  l_linenumber AS created_time FROM lineitem)"""


def audits(spark, d):
    kind = F.when(F.col("l_returnflag") == "A", "human").otherwise("overlap")
    return S.read_table(spark, d, "lineitem").select(F.col("l_orderkey").alias("question_id"), kind.alias("audit_type"), (F.col("l_discount") > 0.02).alias("is_valid"), (F.col("l_linenumber") * 1000 + F.col("l_partkey") % 1000 + F.col("l_suppkey") / 1000).alias("created_time"))


@query(f"""WITH {AUDITS.replace("l_linenumber AS created_time", "l_linenumber * 1000 + l_partkey % 1000 + l_suppkey / 1000 AS created_time")}, v AS (SELECT question_id, arg_max(is_valid, created_time) FILTER (audit_type = 'human') AS human, bool_or(is_valid) AS any_, bool_and(is_valid) AS all_ FROM audits GROUP BY 1)
SELECT o_orderkey AS question_id FROM orders WHERE o_orderkey IN (SELECT question_id FROM v WHERE coalesce(human, any_ AND all_))""")
def j11_usable_questions(spark, d):
    return J.usable_questions(S.read_table(spark, d, "orders").select(F.col("o_orderkey").alias("question_id")), audits(spark, d))


@query(f"WITH {RESULTS}, {AUDITS} SELECT run_id, count(*) AS n FROM results WHERE question_id IN (SELECT question_id FROM audits WHERE audit_type = 'human' AND is_valid) GROUP BY 1")
def j10_audited_results(spark, d):
    return J.audited_results(results(spark, d), audits(spark, d), "human").groupBy("run_id").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH i AS (SELECT conv_id AS document_id, turn AS pos, role || turn AS cref FROM conversations)
SELECT a.document_id, a.pos, (b.pos - a.pos)::INT AS distance, b.cref AS near_cref FROM i a JOIN i b USING (document_id) WHERE abs(a.pos - b.pos) BETWEEN 1 AND 2""")
def j13_neighbours(spark, d):
    items = S.read_table(spark, d, "conversations").select(F.col("conv_id").alias("document_id"), F.col("turn").alias("pos"), F.concat("role", F.col("turn").cast("string")).alias("cref"))
    return J.neighbours(items, 2)


@query("""WITH d AS (SELECT DISTINCT regexp_extract(doc_id || (['', '-v1', '/x', '_b', '.c'])[doc_id % 5 + 1], '^(\\d+)([-/_]|$)', 1) AS entry FROM documents)
SELECT l_orderkey * 10 + l_linenumber AS cite_id, l_partkey AS number, entry IS NOT NULL AS exists,
  CASE WHEN l_suppkey % 9 = 0 THEN NULL WHEN l_partkey > l_suppkey * 10 THEN 'newer' WHEN l_partkey < l_suppkey * 10 THEN 'older' ELSE 'same' END AS age
FROM lineitem LEFT JOIN d ON entry = l_partkey::VARCHAR""")
def j15_verify_citations(spark, d):
    reference = F.when(F.col("l_suppkey") % 9 == 0, "none").otherwise(F.concat((F.col("l_suppkey") * 10).cast("string"), F.lit("-v2")))
    cites = S.read_table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("cite_id"), F.col("l_partkey").alias("number"), reference.alias("reference"))
    tail = F.get(F.array(*map(F.lit, ("", "-v1", "/x", "_b", ".c"))), (F.col("doc_id") % 5).cast("int"))
    return J.verify_citations(cites, S.read_table(spark, d, "documents").select(F.concat(F.col("doc_id").cast("string"), tail).alias("doc_id")))


@query("""SELECT user_id AS log_path, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'error') AS error FROM events GROUP BY 1""")
def j16_runs_with_privacy(spark, d):
    e = S.read_table(spark, d, "events").select(F.col("user_id").alias("log_path"), F.col("event_type").alias("kind"), F.lit(1).cast("long").alias("n"))
    return J.runs_with_privacy(e.select("log_path").distinct(), e, ["click", "error"])


@query(f"""WITH {RESULTS}, r AS (SELECT * FROM results WHERE run_id IN ('AF', 'RF')), c AS (SELECT question_id FROM r GROUP BY 1 HAVING count(DISTINCT run_id) = (SELECT count(DISTINCT run_id) FROM r))
SELECT run_id, count(*) AS n FROM r WHERE question_id IN (SELECT question_id FROM c) GROUP BY 1""")
def j17_paired_results(spark, d):
    return J.paired_results(results(spark, d), ["AF", "RF"]).groupBy("run_id").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT a.l_orderkey AS raw_id, a.l_quantity AS tokens_a, b.l_quantity AS tokens_b FROM lineitem a JOIN lineitem b USING (l_orderkey) WHERE a.l_returnflag = 'A' AND b.l_returnflag = 'R'""")
def j18_parser_pairs(spark, d):
    return J.parser_pairs(S.read_table(spark, d, "lineitem").select(F.col("l_orderkey").alias("raw_id"), F.col("l_returnflag").alias("parser_id"), F.col("l_quantity").alias("tokens")), "A", "R")


@query("SELECT hash, min(image_id) AS image_id, count(*) AS copies FROM (SELECT md5(text) AS hash, doc_id AS image_id FROM documents) WHERE hash NOT IN (SELECT md5(text) FROM documents WHERE doc_id % 2 = 0) GROUP BY 1")
def j21_new_images(spark, d):
    x = S.read_table(spark, d, "documents").select(F.md5("text").alias("hash"), F.col("doc_id").alias("image_id"))
    registry = x.where("image_id % 2 = 0").select("hash", F.lit("seen").alias("description")).dropDuplicates(["hash"])
    return J.split_known_images(x, registry)[1]


@query("""SELECT 'orders' AS name, count(*) AS removed FROM orders WHERE o_orderkey % 7 = 0 UNION ALL SELECT 'lineitem', count(*) FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 7 = 0)""")
def j22_drop_cascade(spark, d):
    o = S.read_table(spark, d, "orders").withColumnRenamed("o_orderkey", "key")
    li = S.read_table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "key")
    return J.drop_cascade({"orders": o, "lineitem": li}, o.where("key % 7 = 0"), "key")[1]


# -- aggregations


@query(f"WITH {M} SELECT source_id, parser_id, doc_type, grouping(source_id, parser_id, doc_type)::INT AS level, count(*) AS n FROM m GROUP BY GROUPING SETS ((), (source_id), (source_id, parser_id, doc_type))")
def a01_corpus_stats(spark, d):
    return A.corpus_stats(docs(spark, d))


@query("SELECT c_custkey AS source_id, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def a02_filter_options(spark, d):
    return A.filter_options(S.read_table(spark, d, "orders").select(F.col("o_custkey").alias("source_id")), S.read_table(spark, d, "customer").select(F.col("c_custkey").alias("source_id")))


@query("""WITH c AS (SELECT l_orderkey AS id, l_orderkey * 10 + l_linenumber AS chunk_id, l_returnflag AS strategy FROM lineitem), s AS (SELECT DISTINCT l_returnflag AS strategy FROM lineitem),
e AS (SELECT l_orderkey * 10 + l_linenumber AS chunk_id, l_linestatus AS embedding FROM lineitem), n AS (SELECT DISTINCT l_linestatus AS embedding FROM lineitem),
g AS (SELECT s.strategy, n.embedding, (SELECT count(DISTINCT id) FROM c WHERE c.strategy = s.strategy) AS documents, (SELECT count(*) FROM c WHERE c.strategy = s.strategy) AS chunks,
  (SELECT count(*) FROM c JOIN e USING (chunk_id) WHERE c.strategy = s.strategy AND e.embedding = n.embedding) AS embeddings FROM s, n)
SELECT *, chunks - embeddings AS missing FROM g""")
def a03_coverage_grid(spark, d):
    x = S.read_table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("chunk_id"), F.col("l_returnflag").alias("strategy"), F.col("l_linestatus").alias("embedding"))
    return A.coverage_grid(x.drop("embedding"), x.select("chunk_id", "embedding"), x.select("strategy").distinct(), x.select("embedding").distinct())


@query("SELECT k AS key, count(*) AS n FROM (SELECT unnest(json_keys(props)) AS k FROM events) GROUP BY 1")
def a05_metadata_keys(spark, d):
    return A.metadata_keys(S.read_table(spark, d, "events").select(F.col("props").alias("meta")))


@query("""SELECT lang, count(*) AS n, sum(length(text))::DOUBLE AS total, round(avg(length(text)), 6) AS mean, round(stddev_pop(length(text)), 4) AS stdev, median(length(text)) AS median,
min(length(text))::DOUBLE AS least, max(length(text))::DOUBLE AS most FROM documents GROUP BY 1""")
def a07_length_stats(spark, d):
    return rounded(rounded(A.length_stats(S.read_table(spark, d, "documents"), F.length("text"), ["lang"]), "mean"), "stdev", digits=4)


@query("""SELECT l_returnflag AS stage, l_linestatus AS model, grouping(l_returnflag, l_linestatus)::INT AS level, count(*) AS calls, sum(l_quantity::BIGINT)::BIGINT AS input, sum(l_linenumber)::BIGINT AS output,
sum(l_quantity::BIGINT + l_linenumber)::BIGINT AS total, sum(least(l_partkey, l_quantity::BIGINT))::BIGINT AS cached FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)""")
def a09_token_usage(spark, d):
    u = S.read_table(spark, d, "lineitem").select(F.col("l_returnflag").alias("stage"), F.col("l_linestatus").alias("model"), F.col("l_quantity").cast("long").alias("input"), F.col("l_linenumber").alias("output"), F.lit(None).cast("long").alias("total"), F.col("l_partkey").alias("cached"))
    return A.token_usage(A.normalise_usage(u))


@query(f"""WITH {CALLS}, r AS (SELECT tool, duration_ms, row_number() OVER (PARTITION BY tool ORDER BY duration_ms) - 1 AS i, count(*) OVER (PARTITION BY tool) AS n FROM calls),
p AS (SELECT tool, min(duration_ms) FILTER (i = least(n - 1, floor(0.5 * n))) AS median_ms, min(duration_ms) FILTER (i = least(n - 1, floor(0.95 * n))) AS p95_ms FROM r GROUP BY 1)
SELECT tool, count(*) AS calls, count(DISTINCT session_id) AS sessions, count(*) FILTER (status = 'error') AS errors, max(created_time) AS last_used, any_value(median_ms) AS median_ms, any_value(p95_ms) AS p95_ms
FROM calls JOIN p USING (tool) GROUP BY 1""")
def a11_tool_usage(spark, d):
    return A.tool_usage(calls(spark, d))


@query(f"WITH {CALLS} SELECT session_id, min(created_time) AS first_call, max(created_time) AS last_call, count(*) AS calls, count(DISTINCT tool)::INT AS tools FROM calls GROUP BY 1")
def a12_session_usage(spark, d):
    return A.session_usage(calls(spark, d)).withColumn("per_tool", F.size("per_tool")).withColumnRenamed("per_tool", "tools")


@query(f"""WITH {CALLS}, u AS (SELECT (created_time - INTERVAL 6 HOURS)::DATE AS day, count(*) AS calls, count(DISTINCT session_id) AS sessions, count(*) FILTER (status = 'error') AS errors FROM calls GROUP BY 1)
SELECT strftime(t.day, '%Y-%m-%d') AS day, coalesce(calls, 0) AS calls, coalesce(sessions, 0) AS sessions, coalesce(errors, 0) AS errors FROM (SELECT unnest(generate_series(DATE '2023-12-25', DATE '2024-02-05', INTERVAL 1 DAY))::DATE AS day) t LEFT JOIN u USING (day)""")
def a13_daily_usage(spark, d):
    return A.tool_usage_daily(calls(spark, d), "2023-12-25", "2024-02-05", "America/Chicago").withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query("""WITH s AS (SELECT event_type AS stage, count(value) AS n, sum(value) AS total, avg(value) AS mean, quantile_cont(value, 0.5) AS median, stddev_samp(value) AS stdev, min(value) AS least,
quantile_cont(value, 0.1) AS p10, quantile_cont(value, 0.9) AS p90, max(value) AS most FROM events GROUP BY 1)
SELECT stage, n, round(total, 4) AS total, round(mean, 4) AS mean, round(median, 4) AS median, round(stdev, 4) AS stdev, least, round(p10, 4) AS p10, round(p90, 4) AS p90, most, round(total / (SELECT sum(total) FROM s), 6) AS share FROM s""")
def a14_stage_stats(spark, d):
    out = A.stage_stats(S.read_table(spark, d, "events").withColumnRenamed("event_type", "stage"), ["stage"], "value")
    return rounded(rounded(out, "total", "mean", "median", "stdev", "p10", "p90", digits=4), "share")


@query("""SELECT md5(text) AS hash, count(*) AS copies, count(DISTINCT source) AS documents, count(DISTINCT doc_id // 7) AS entries, arg_min(n_chars, doc_id) AS bytes, arg_min(lang, doc_id) AS description FROM documents GROUP BY 1""")
def a15_image_registry(spark, d):
    name = F.concat(F.floor(F.col("doc_id") / 7).cast("string"), F.lit("-p1"))
    return A.image_registry(S.read_table(spark, d, "documents").select(F.md5("text").alias("hash"), name.alias("doc_id"), F.col("source").alias("document_id"), F.col("n_chars").alias("bytes"), F.col("lang").alias("description"), F.col("doc_id").alias("image_id")))


@query("SELECT quality::VARCHAR AS label, count(*) AS n, round(count(*) / (SELECT count(*) FROM labels)::DOUBLE, 6) AS share FROM labels GROUP BY 1")
def a17_label_stats(spark, d):
    return rounded(A.label_stats(S.read_table(spark, d, "labels").select(F.col("quality").cast("string").alias("label"))), "share")


@query("SELECT lang AS raw_id, max(length(text)) AS longest FROM documents WHERE source IN ('src1', 'src2') GROUP BY 1 HAVING max(length(text)) > 1000")
def a18_oversized(spark, d):
    return A.oversized(S.read_table(spark, d, "documents").select(F.col("lang").alias("raw_id"), F.col("source").alias("source_type"), "text"), 1000, ["src1", "src2"])


@query("""SELECT node, document_id, count(*) AS mentions FROM (SELECT l_orderkey AS document_id, l_partkey AS node FROM lineitem UNION ALL SELECT l_orderkey, l_suppkey FROM lineitem) GROUP BY ALL""")
def a19_node_mentions(spark, d):
    return A.node_mentions(S.read_table(spark, d, "lineitem").select(F.col("l_orderkey").alias("document_id"), F.col("l_partkey").alias("source_node"), F.col("l_suppkey").alias("target_node")))


@query("""SELECT doc_id AS id, 'spam_marks' AS issue, len(regexp_extract_all(text, '[*#$%&!]{2,}'))::BIGINT AS n FROM documents WHERE n > 0 UNION ALL SELECT doc_id, 'short', 1 FROM documents WHERE length(trim(text)) < 40""")
def a20_run_checks(spark, d):
    return A.run_checks(docs(spark, d), {"spam_marks": F.regexp_count("text", F.lit("[*#$%&!]{2,}")), "short": F.length(F.trim("text")) < 40})


@query("""WITH a AS (SELECT l_orderkey AS question_id, l_partkey AS document_id, count(DISTINCT l_suppkey) AS models FROM lineitem WHERE l_returnflag = 'N' GROUP BY ALL)
SELECT question_id, count(*) AS newer_documents, max(models) AS models FROM a GROUP BY 1""")
def a21_conflicts(spark, d):
    return A.conflict_findings(S.read_table(spark, d, "lineitem").select(F.col("l_orderkey").alias("question_id"), F.col("l_suppkey").alias("model"), F.col("l_partkey").alias("document_id"), (F.col("l_returnflag") == "N").alias("newer")))


@query("""SELECT count(*) FILTER (o_orderstatus = 'P') AS held, count(*) FILTER (o_orderstatus = 'P' AND o_orderdate < TIMESTAMP '1998-01-01' - INTERVAL 24 HOURS) AS stuck FROM orders""")
def a22_hold_summary(spark, d):
    cur = S.read_table(spark, d, "orders").select(F.when(F.col("o_orderstatus") == "P", "held").otherwise("visible").alias("state"), F.col("o_orderdate").alias("updated"))
    return A.hold_summary(cur, F.lit("1998-01-01").cast("timestamp_ntz"), 24)


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def a24_oversize_chunks(spark, d):
    ch = S.read_table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_quantity").alias("tokens"))
    return A.oversize_chunk_docs(S.read_table(spark, d, "orders").select(F.col("o_orderkey").alias("id")), ch, 45)


# -- evaluation


@query(f"WITH {RESULTS} SELECT run_id, count(is_hit) AS n, round(avg(is_hit::INT), 6) AS hit_rate FROM results GROUP BY 1")
def e01_hit_rate(spark, d):
    return rounded(E.hit_rate(results(spark, d)), "hit_rate")


@query(f"WITH {RESULTS} SELECT hit_rank, count(*) AS n FROM results GROUP BY 1")
def e02_rank_distribution(spark, d):
    return E.rank_distribution(results(spark, d))


@query(f"WITH {RESULTS} SELECT k::INT AS k, round(avg(CASE WHEN hit_rank <= k THEN 1.0 ELSE 0.0 END), 6) AS recall FROM results, (SELECT unnest([1, 3, 5]) AS k) GROUP BY 1")
def e03_recall_at_k(spark, d):
    return rounded(E.recall_at_k(results(spark, d), [1, 3, 5]), "recall")


@query(f"""WITH {RESULTS} SELECT run_id, count(*) AS questions, count(*) FILTER (is_hit) AS hits, count(*) FILTER (NOT is_hit) AS misses, count(is_judge_hit) AS judged, count(*) FILTER (is_judge_hit) AS judge_hits FROM results GROUP BY 1""")
def e04_run_summary(spark, d):
    return E.run_summary(results(spark, d))


@query("""SELECT o_orderkey AS question_id, min(l_linenumber) FILTER (l_partkey % 50 = o_custkey % 50) AS hit_rank, min(l_linenumber) FILTER (l_partkey % 10 = o_custkey % 10) AS entry_rank, max(l_discount) AS best_score,
hit_rank IS NOT NULL AS is_hit FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""")
def e05_score_retrieval(spark, d):
    q = S.read_table(spark, d, "orders").select(F.col("o_orderkey").alias("question_id"), (F.col("o_custkey") % 50).alias("source_document_id"), (F.col("o_custkey") % 10).alias("source_entry"))
    r = S.read_table(spark, d, "lineitem").select(F.col("l_orderkey").alias("question_id"), (F.col("l_partkey") % 50).alias("document_id"), (F.col("l_partkey") % 10).alias("entry"), F.col("l_linenumber").alias("rank"), F.col("l_discount").alias("score"))
    return E.score_retrieval(q, r)


@query(f"WITH {RESULTS} SELECT run_id AS variant, round(avg(CASE WHEN hit_rank <= 3 THEN 1.0 ELSE 0.0 END), 6) AS hit_at_k, round(avg(coalesce(1.0 / hit_rank, 0)), 6) AS mrr FROM results GROUP BY 1")
def e06_retrieval_ablation(spark, d):
    return rounded(E.retrieval_ablation(results(spark, d).withColumnRenamed("run_id", "variant"), 3), "hit_at_k", "mrr")


@query(f"""WITH {RESULTS}, p AS (SELECT question_id, max(is_hit::INT) FILTER (run_id = 'AF') AS "AF", max(is_hit::INT) FILTER (run_id = 'NO') AS "NO", max(is_hit::INT) FILTER (run_id = 'RF') AS "RF" FROM results GROUP BY 1)
SELECT *, coalesce("AF", 0) + coalesce("NO", 0) + coalesce("RF", 0) AS solved FROM p""")
def e08_question_matrix(spark, d):
    return E.question_matrix(results(spark, d), ["AF", "NO", "RF"])


@query("""SELECT p_brand AS prefix, count(*) AS runs, max(p_partkey) AS newest FROM part WHERE p_size % 3 <> 0 GROUP BY 1""")
def e09_run_groups(spark, d):
    kind = F.when(F.col("p_size") % 3 == 1, "rag").otherwise("agent")
    shown = F.when(F.col("p_size") % 3 == 0, "other").otherwise(kind)
    name = F.concat("p_brand", F.lit("-"), shown, F.lit("-"), F.col("p_size").cast("string"))
    return E.run_groups(S.read_table(spark, d, "part").select(name.alias("name"), kind.alias("search_type"), F.col("p_partkey").alias("created_time")))


@query("""SELECT l_returnflag AS mode, l_linestatus AS model, grouping(l_returnflag, l_linestatus)::INT AS level, count(*) AS n, round(avg((l_discount > 0.03)::INT), 6) AS accuracy FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)""")
def e11_accuracy(spark, d):
    return rounded(E.accuracy_breakdown(S.read_table(spark, d, "lineitem").select(F.col("l_returnflag").alias("mode"), F.col("l_linestatus").alias("model"), (F.col("l_discount") > 0.03).alias("correct"))), "accuracy")


@query("""WITH p AS (SELECT l_orderkey, count(*) AS n, count(*) FILTER (l_tax > 0.04) AS y FROM lineitem GROUP BY 1)
SELECT sum(y * (n - y))::BIGINT AS flips, sum(n * (n - 1) // 2)::BIGINT AS pairs, round(sum(y * (n - y)) / sum(n * (n - 1) / 2), 6) AS flip_rate FROM p""")
def e12_flip_rate(spark, d):
    return rounded(E.flip_rate(S.read_table(spark, d, "lineitem").select(F.col("l_orderkey").alias("question_id"), (F.col("l_tax") > 0.04).alias("verdict"))), "flip_rate")


@query("""WITH p AS (SELECT conv_id, count(*) AS turns, count(*) FILTER (role = 'assistant') AS answers, sum(length(text)) AS chars FROM conversations GROUP BY 1)
SELECT count(*) AS conversations, round(avg(turns), 6) AS turns, round(avg(answers), 6) AS answers, round(avg(chars), 4) AS chars FROM p""")
def e13_agent_behaviour(spark, d):
    return rounded(rounded(E.agent_behaviour(S.read_table(spark, d, "conversations")), "turns", "answers"), "chars", digits=4)


@query("""WITH h AS (SELECT conv_id AS question_id, turn AS rank, role, text, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations WHERE text <> '')
SELECT question_id, string_agg('[' || role || turn_ || ']' || chr(10) || substring(text, 1, (600 // n)::INT), chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS context FROM (SELECT *, rank::VARCHAR AS turn_ FROM h) GROUP BY 1""")
def e18_build_context(spark, d):
    return E.build_context(S.read_table(spark, d, "conversations").select(F.col("conv_id").alias("question_id"), F.col("turn").alias("rank"), F.concat("role", F.col("turn").cast("string")).alias("doc_id"), "text"), 600)


# -- ranking and deduplication


HITS = "hits AS (SELECT o_custkey % 20 AS query_id, o_custkey AS id, o_orderkey AS chunk_id, o_totalprice AS score FROM orders)"


def hits(spark, d):
    return S.read_table(spark, d, "orders").select((F.col("o_custkey") % 20).alias("query_id"), F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("chunk_id"), F.col("o_totalprice").alias("score"))


@query(f"WITH {HITS} SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, id ORDER BY score DESC, chunk_id)::INT AS rank_in_doc FROM hits) WHERE rank_in_doc <= 3")
def w01_cap_per_document(spark, d):
    return W.cap_per_document(hits(spark, d), 3)


@query(f"""WITH {HITS}, b AS (SELECT query_id, id, max(score) AS best FROM hits GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY best DESC, id)::INT AS doc_rank FROM b)
SELECT query_id, id, chunk_id, score, best, doc_rank FROM hits JOIN r USING (query_id, id) WHERE doc_rank <= 5""")
def w02_top_documents(spark, d):
    return W.top_documents(hits(spark, d), 5)


@query("SELECT o_custkey AS raw_id, arg_max(o_orderstatus, o_orderkey) AS state, max(o_orderkey) AS seq FROM orders GROUP BY 1")
def w04_latest_by(spark, d):
    return W.latest_by(S.read_table(spark, d, "orders").select(F.col("o_custkey").alias("raw_id"), F.col("o_orderstatus").alias("state"), F.col("o_orderkey").alias("seq")), ["raw_id"], ["seq"])


@query("SELECT doc_id AS id FROM documents ORDER BY md5(doc_id || ':7'), doc_id LIMIT 100")
def w07_sample(spark, d):
    return W.sample_candidates(docs(spark, d), 100, 7).select("id")


@query("""WITH g AS (SELECT doc_id AS id, count(*) OVER w AS group_size, row_number() OVER (PARTITION BY md5(text), lang ORDER BY doc_id)::INT AS rank FROM documents WINDOW w AS (PARTITION BY md5(text), lang))
SELECT * FROM g WHERE group_size > 1""")
def a06_duplicate_groups(spark, d):
    return D.duplicate_groups(docs(spark, d).withColumn("h", F.md5("text")), ["h", "parser_id"]).select("id", "group_size", "rank")


@query("SELECT arg_min(doc_id, (doc_id % 100, doc_id)) AS id FROM documents GROUP BY md5(text)")
def d05_deduplicate(spark, d):
    rows = docs(spark, d).withColumn("h", F.md5("text")).withColumn("insert_time", F.timestamp_seconds(F.col("id") % 100))
    return D.deduplicate(rows, [["h"]]).select("id")


@query("""WITH n AS (SELECT * FROM documents WHERE doc_id % 2 = 1), e AS (SELECT * FROM documents WHERE doc_id % 2 = 0),
h AS (SELECT sha256(text) AS h, min(doc_id) AS same FROM e GROUP BY 1), i AS (SELECT source, n_chars, lang, min(doc_id) AS same FROM e GROUP BY ALL)
SELECT n.doc_id AS id, coalesce(i.same, h.same) AS target_id, CASE WHEN target_id IS NULL THEN 'insert' ELSE 'update' END AS action
FROM n LEFT JOIN h ON h.h = sha256(n.text) LEFT JOIN i ON i.source = n.source AND i.n_chars = n.n_chars AND i.lang = n.lang""")
def d03_dedup_merge(spark, d):
    x = docs(spark, d).withColumn("content_hash", P.content_hash(F.col("text"))).withColumn("doc_id", F.col("n_chars").cast("string"))
    return D.dedup_merge(x.where("id % 2 = 1"), x.where("id % 2 = 0"), 3)


@query("SELECT min(doc_id) AS id FROM documents WHERE doc_id % 2 = 1 AND sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 2 = 0) GROUP BY sha256(text)")
def d04_register_raw(spark, d):
    x = docs(spark, d).withColumn("content_hash", P.content_hash(F.col("text")))
    return D.register_raw(x.where("id % 2 = 1"), x.where("id % 2 = 0")).select("id")


@query("SELECT DISTINCT o_custkey AS c_custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def d07_common_keys(spark, d):
    o = S.read_table(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return D.common_keys([o.where("o_orderstatus = 'F'"), o.where("o_orderstatus = 'P'")], "c_custkey")


# -- search and chunks


@query("""WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 100 = 0), e AS (SELECT vec_id AS chunk_id, embedding::DOUBLE[] AS e FROM embeddings WHERE label <> 3),
s AS (SELECT query_id, chunk_id, round(coalesce(list_cosine_similarity(e, q), 0), 6) AS score FROM q, e), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INT AS rank FROM s)
SELECT * FROM r WHERE rank <= 10""")
def v02_knn_exact(spark, d):
    e = S.read_table(spark, d, "embeddings").withColumnRenamed("vec_id", "chunk_id")
    return V.knn_exact(e, e.where("chunk_id % 100 = 0").select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("query")), 10, F.col("label") != 3)


CHUNKS = "chunks AS (SELECT doc_id * 1000000 + i - 1 AS chunk_id, doc_id AS id, line AS text FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) WHERE length(line) > 0)"
POSTS = CHUNKS + r", words AS (SELECT chunk_id, id, list_transform(regexp_extract_all(text, '[\p{L}\p{N}]+'), lambda x: lower(x)) AS w FROM chunks), posts AS (SELECT chunk_id, id, unnest(w) AS term, generate_subscripts(w, 1) - 1 AS pos FROM words)"
SEARCH = POSTS + """, t AS (SELECT * FROM posts WHERE term IN ('this', 'er')), full_ AS (SELECT chunk_id FROM t GROUP BY 1 HAVING count(DISTINCT term) = 2),
p AS (SELECT t.*, last_value(CASE WHEN term = 'this' THEN pos END IGNORE NULLS) OVER w AS p0, last_value(CASE WHEN term = 'er' THEN pos END IGNORE NULLS) OVER w AS p1 FROM t JOIN full_ USING (chunk_id)
  WINDOW w AS (PARTITION BY chunk_id ORDER BY pos ROWS UNBOUNDED PRECEDING)),
b AS (SELECT *, CASE WHEN p0 IS NOT NULL AND p1 IS NOT NULL THEN least(p0, p1) END AS b FROM p), c AS (SELECT *, lag(b) OVER (PARTITION BY chunk_id ORDER BY pos) AS was FROM b),
found AS (SELECT chunk_id, id, round(sum(least(1.0, 8.0 / (pos - b + 1))), 6) AS score FROM c WHERE b IS NOT NULL AND (was IS NULL OR b > was) GROUP BY ALL)"""


@query(f"WITH {SEARCH} SELECT chunk_id, id, score FROM found")
def v06_fulltext_search(spark, d):
    return V.search_web(S.as_chunks(S.spread(docs(spark, d))), "this er")


@query("""WITH a AS (SELECT o_custkey % 5 AS query_id, o_orderkey AS chunk_id, row_number() OVER (PARTITION BY o_custkey % 5 ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders QUALIFY rank <= 50),
b AS (SELECT o_custkey % 5 AS query_id, o_orderkey AS chunk_id, row_number() OVER (PARTITION BY o_custkey % 5 ORDER BY epoch(o_orderdate) DESC, o_orderkey) AS rank FROM orders QUALIFY rank <= 50)
SELECT query_id, chunk_id, round(coalesce(1.0 / (60 + a.rank), 0) + coalesce(1.0 / (60 + b.rank), 0), 8) AS score FROM a FULL JOIN b USING (query_id, chunk_id)""")
def v07_rrf_fuse(spark, d):
    o = S.read_table(spark, d, "orders")
    side = lambda score: W.global_rank(o.select((F.col("o_custkey") % 5).alias("query_id"), F.col("o_orderkey").alias("chunk_id"), score.alias("score")), 50)
    return V.rrf_fuse(side(F.col("o_totalprice")), side(F.col("o_orderdate")))


@query(f"""WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 100 = 0), e AS (SELECT vec_id AS chunk_id, embedding::DOUBLE[] AS e FROM embeddings),
near AS (SELECT query_id, chunk_id, round(coalesce(list_cosine_similarity(e, q), 0), 6) AS score FROM q, e),
a AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM near QUALIFY rank <= 10),
{POSTS}, own AS (SELECT doc_id AS query_id, list_transform(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}]+'), lambda x: lower(x)) AS w FROM documents WHERE doc_id IN (SELECT query_id FROM q)),
ow AS (SELECT query_id, unnest(w) AS term, generate_subscripts(w, 1) AS place FROM own),
t AS (SELECT query_id, term, min(place) AS place FROM ow WHERE term NOT IN {V.STOPWORDS} GROUP BY query_id, term QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY min(place)) <= 2),
u AS (SELECT query_id, term, row_number() OVER (PARTITION BY query_id ORDER BY term) AS i, count(*) OVER (PARTITION BY query_id) AS n FROM t),
h AS (SELECT query_id, chunk_id, id, pos, i, n FROM posts JOIN u USING (term)), full_ AS (SELECT query_id, chunk_id FROM h GROUP BY ALL HAVING count(DISTINCT i) = max(n)),
p AS (SELECT h.*, last_value(CASE WHEN i = 1 THEN pos END IGNORE NULLS) OVER w AS p0, last_value(CASE WHEN i = 2 THEN pos END IGNORE NULLS) OVER w AS p1 FROM h JOIN full_ USING (query_id, chunk_id)
  WINDOW w AS (PARTITION BY query_id, chunk_id ORDER BY pos ROWS UNBOUNDED PRECEDING)),
g AS (SELECT *, CASE WHEN n = 1 THEN p0 WHEN p0 IS NOT NULL AND p1 IS NOT NULL THEN least(p0, p1) END AS b FROM p), c AS (SELECT *, lag(b) OVER (PARTITION BY query_id, chunk_id ORDER BY pos) AS was FROM g),
found AS (SELECT query_id, chunk_id, id, round(sum(least(1.0, 8.0 / (pos - b + 1))), 6) AS score FROM c WHERE b IS NOT NULL AND (was IS NULL OR b > was) GROUP BY ALL),
best AS (SELECT query_id, id AS chunk_id, max(score) AS score FROM found GROUP BY ALL),
b AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM best QUALIFY rank <= 10),
f AS (SELECT query_id, chunk_id, round(coalesce(1.0::DOUBLE / (60 + a.rank), 0) + coalesce(1.0::DOUBLE / (60 + b.rank), 0), 8) AS score FROM a FULL JOIN b USING (query_id, chunk_id) WHERE chunk_id IN (SELECT doc_id FROM documents))
SELECT query_id, chunk_id AS id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INT AS doc_rank FROM f QUALIFY doc_rank <= 5""")
def v09_hybrid_search(spark, d):
    """A vector is that of the document with its id; documents without one are found by their words alone."""
    e = S.read_table(spark, d, "embeddings").withColumnRenamed("vec_id", "chunk_id")
    asked = e.where("chunk_id % 100 = 0").select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("query"))
    near = V.knn_exact(e, asked, 40).drop("rank")
    # the words of a query: the first two different ones of the document with its id
    own = F.filter(F.transform(F.regexp_extract_all("text", F.lit(f"({V.TOKEN})"), 1), F.lower), lambda x: ~x.isin(*V.STOPWORDS))
    terms = docs(spark, d).join(asked.select(F.col("query_id").alias("id")), "id").select(F.col("id").alias("query_id"), F.slice(F.array_distinct(own), 1, 2).alias("terms"))
    # queries with the same words have the same hits: each set of words is sought, and its best documents kept, once
    sets = cut(terms.select("query_id", F.array_sort("terms").alias("terms")))
    once = cut(sets.groupBy("terms").agg(F.min("query_id").alias("set_id")))
    words = V.search_chunks_batch(S.as_chunks(S.spread(docs(spark, d))), once.select(F.col("set_id").alias("query_id"), "terms")).select("query_id", F.col("id").alias("chunk_id"), "score")
    best = global_rank(words.groupBy("query_id", "chunk_id").agg(F.max("score").alias("score")), 10).withColumnRenamed("query_id", "set_id")
    words = sets.join(once, "terms").join(best, "set_id").select("query_id", "chunk_id", "score")
    found = V.search_hybrid(near, words, docs(spark, d).select(F.col("id").alias("chunk_id"), "id"), 5)
    return found.select("query_id", "id", "chunk_id", "score", "doc_rank")


@query("""WITH q AS (SELECT conv_id, turn, list_distinct(list_transform(regexp_extract_all(text, '[\\p{L}\\p{N}]+'), lambda x: lower(x))) AS q, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS answer FROM conversations)
SELECT conv_id, turn, round(CASE WHEN len(q) > 0 THEN len(list_intersect(q, list_transform(regexp_extract_all(answer, '[\\p{L}\\p{N}]+'), lambda x: lower(x)))) / len(q)::DOUBLE END, 6) AS score FROM q WHERE answer IS NOT NULL""")
def u02_token_overlap(spark, d):
    from pyspark.sql import Window

    c = S.read_table(spark, d, "conversations").withColumn("answer", F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn")))
    return c.where("answer is not null").select("conv_id", "turn", F.round(V.token_overlap(F.col("text"), F.col("answer")), 6).alias("score"))


@query(r"""WITH t AS (SELECT doc_id AS id, text, regexp_extract_all(text, '\s*\S+') AS t FROM documents), n AS (SELECT *, len(t) AS n FROM t WHERE len(t) > 0),
w AS (SELECT id, t, unnest(range(0, greatest(0, ceil((n - 100) / 90.0)::BIGINT) + 1)) AS i FROM n)
SELECT id, i::INT AS chunk_index, array_to_string(t[i * 90 + 1:i * 90 + 100], '') AS text, len(t[i * 90 + 1:i * 90 + 100])::INT AS token_length FROM w""")
def c01_chunk_tokens(spark, d):
    return C.chunk_tokens(S.spread(docs(spark, d)), 100).drop("char_start", "char_end")


@query(r"""WITH c AS (SELECT doc_id AS id, i - 1 AS chunk_index, line AS text, n_chars, CASE WHEN i % 4 = 0 THEN 'summary_256' ELSE 'lines' END AS strategy
  FROM (SELECT doc_id, n_chars, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) WHERE length(line) > 0),
p AS (SELECT *, 1000.0 * len(regexp_extract_all(text, '\p{L}{4,}')) / length(text) AS prose, strategy = 'lines' AS body FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY id, body ORDER BY prose DESC, chunk_index) AS best FROM p)
SELECT id, chunk_index FROM r WHERE n_chars <= 2000 OR NOT body OR prose >= 100 OR best = 1""")
def c06_drop_number_chunks(spark, d):
    strategy = F.when(F.col("chunk_index") % 4 == 3, "summary_256").otherwise("lines")
    chunks = S.as_chunks(docs(spark, d)).withColumn("strategy", strategy)
    return C.drop_number_chunks(chunks, docs(spark, d).withColumn("doc_type", F.lit("text")), 100.0, 2000).select("id", F.col("chunk_index").cast("long"))


def first_piece(cap: int) -> str:
    """SQL: what is cut from rest first, of at most cap characters: up to the last paragraph in it, else line, else sentence."""
    ends = [rf"nullif(regexp_extract(substr(rest, 1, {cap - len(mark) + 1}), '(?s)^.+{pattern}'), '')" for mark, pattern in (("\n\n", r"\n\n"), ("\n", r"\n"), (". ", r"\. "))]
    return f"CASE WHEN length(rest) <= {cap} THEN rest ELSE coalesce({', '.join(ends)}, substr(rest, 1, {cap})) END"


@query(f"""WITH RECURSIVE cut AS (SELECT doc_id AS id, -1 AS chunk_index, '' AS text, coalesce(text, '') AS rest FROM documents
UNION ALL SELECT id, chunk_index + 1, p, substr(rest, length(p) + 1) FROM (SELECT *, {first_piece(800)} AS p FROM cut WHERE rest <> ''))
SELECT id, chunk_index, text FROM cut WHERE chunk_index >= 0""")
def c03_chunk_budget(spark, d):
    return C.chunk_budget(docs(spark, d), 800)


@query()
def c09_embed_chunks(spark, d):
    return C.embed_chunks(S.as_chunks(docs(spark, d)), C.hashing_embedder())


# -- visibility and graph


@query("""WITH f AS (SELECT o_custkey AS id, (['restricted', 'credentials', 'personal_data', 'personnel', 'security'])[o_orderkey % 5 + 1] AS category,
  (['low', 'medium', 'high'])[o_orderkey % 3 + 1] AS severity, o_orderkey % 7 < 3 AS covered, o_orderkey % 2 = 0 AS exact, o_orderkey % 11 = 0 AS marker FROM orders),
g AS (SELECT *, category IN ('personal_data', 'personnel') AND severity = 'high' AS people FROM f WHERE severity <> 'low'),
h AS (SELECT *, (category = 'restricted' AND marker) OR (category = 'credentials' AND severity = 'high' AND NOT exact) AS hide, exact AND (category IN ('credentials', 'personal_data') OR people) AS redact
  FROM g WHERE category = 'restricted' OR people OR NOT covered)
SELECT id, bool_or(hide OR people) AS hide_search, bool_or(hide) AS hide_get, count(DISTINCT CASE WHEN redact THEN category END) AS redacted,
  bool_or(NOT (hide OR people OR (redact AND NOT (category = 'credentials' AND severity = 'high')))) AS flag FROM h GROUP BY id""")
def r04_policy_actions(spark, d):
    key = F.col("o_orderkey")
    pick = lambda values, n: F.get(F.array(*map(F.lit, values)), (key % n).cast("int"))
    f = S.read_table(spark, d, "orders").select(
        F.col("o_custkey").alias("id"), pick(("restricted", "credentials", "personal_data", "personnel", "security"), 5).alias("category"), pick(("low", "medium", "high"), 3).alias("severity"),
        F.when(key % 2 == 0, "secret  WORD").otherwise("not there").alias("span"), F.lit("").alias("evidence"), F.when(key % 11 == 0, "marker").alias("source"), (key % 7 < 3).alias("covered"),
    )
    texts = S.read_table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.lit("a Secret\nword here").alias("text"))
    out = R.policy_actions(f, texts)
    return out.select("id", "hide_search", "hide_get", F.size(F.array_distinct(F.transform("redact", lambda x: x["label"]))).cast("long").alias("redacted"), "flag")


@query("""SELECT count(*) AS matched, count(*) FILTER (h) AS decided, count(*) FILTER (NOT h) AS pending FROM (SELECT p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49) AS h FROM part WHERE p_name ILIKE '%RING%' AND NOT p_name ILIKE 'small%')""")
def r03_visibility_sweep(spark, d):
    raw = S.read_table(spark, d, "part").select(F.col("p_partkey").alias("raw_id"), F.col("p_name").alias("doc_id"), F.col("p_type").alias("title"))
    decided = S.read_table(spark, d, "lineitem").where("l_quantity > 49").select(F.col("l_partkey").alias("raw_id"), F.lit("human").alias("origin"))
    return R.visibility_sweep(raw, R.name_rule(patterns=["%RING%"], exclude=["small%"]), decided)


@query("SELECT c_custkey AS raw_id, 'held' AS state FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P' AND o_orderkey % 10 = 0)")
def r08_hold_new(spark, d):
    return R.hold_new(S.read_table(spark, d, "customer").select(F.col("c_custkey").alias("raw_id")), S.read_table(spark, d, "orders").where("o_orderstatus = 'P' and o_orderkey % 10 = 0").select(F.col("o_custkey").alias("raw_id")))


TRIPLES = "triples AS (SELECT l_orderkey AS document_id, l_partkey AS source_node, l_returnflag AS verb, l_suppkey AS target_node, l_discount AS confidence FROM lineitem)"


def triples(spark, d):
    return S.read_table(spark, d, "lineitem").select(F.col("l_orderkey").alias("document_id"), F.col("l_partkey").alias("source_node"), F.col("l_returnflag").alias("verb"), F.col("l_suppkey").alias("target_node"), F.col("l_discount").alias("confidence"))


@query(f"""WITH {TRIPLES}, n AS (SELECT source_node, verb, target_node, count(*) AS evidence, max(confidence) AS confidence FROM triples GROUP BY ALL)
SELECT n.*, CASE WHEN (source_node, verb, target_node) IN (SELECT (source_node, verb, target_node) FROM triples WHERE document_id % 2 = 0) THEN 'update' ELSE 'create' END AS action FROM n""")
def g01_merge_relations(spark, d):
    t = triples(spark, d)
    return G.merge_relations(t, t.where("document_id % 2 = 0"))


@query("""WITH n AS (SELECT p_partkey AS node_id, p_name AS canonical_name, p_brand AS alias, p_size % 3 AS type_id FROM part), q AS (SELECT DISTINCT CASE WHEN p_partkey % 3 = 0 THEN p_name WHEN p_partkey % 3 = 1 THEN p_brand ELSE p_type END AS name, p_size % 3 AS type_id FROM part),
a AS (SELECT canonical_name AS name, type_id, min(node_id) AS a FROM n GROUP BY ALL), b AS (SELECT alias AS name, type_id, min(node_id) AS b FROM n GROUP BY ALL)
SELECT name, type_id, coalesce(a, b) AS node_id, CASE WHEN a IS NOT NULL THEN 'name' WHEN b IS NOT NULL THEN 'alias' ELSE 'new' END AS how FROM q LEFT JOIN a USING (name, type_id) LEFT JOIN b USING (name, type_id)""")
def g02_resolve_nodes(spark, d):
    p = S.read_table(spark, d, "part").withColumn("type_id", F.col("p_size") % 3)
    nodes = p.select(F.col("p_partkey").alias("node_id"), F.col("p_name").alias("canonical_name"), F.array("p_brand").alias("aliases"), "type_id")
    name = F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).when(F.col("p_partkey") % 3 == 1, F.col("p_brand")).otherwise(F.col("p_type"))
    return G.resolve_nodes(p.select(name.alias("name"), "type_id").distinct(), nodes)


@query(f"""WITH {TRIPLES} SELECT source_node AS node, 'out' AS direction, verb, count(*) AS n, round(max(confidence), 6) AS confidence FROM triples GROUP BY ALL
UNION ALL SELECT target_node, 'in', verb, count(*), round(avg(confidence), 6) FROM triples GROUP BY ALL""")
def g05_node_profile(spark, d):
    return rounded(G.node_profile(triples(spark, d)), "confidence")


@query("""WITH RECURSIVE e AS (SELECT DISTINCT 'n' || n_nationkey AS a, 'r' || n_regionkey AS b FROM nation UNION SELECT DISTINCT 'c' || c_custkey % 40, 'n' || c_nationkey FROM customer),
b AS (SELECT a, b FROM e UNION SELECT b, a FROM e), p AS (SELECT ['n0'] AS path, 'n0' AS cur UNION ALL SELECT list_append(path, b.b), b.b FROM p JOIN b ON b.a = p.cur WHERE cur <> 'n7' AND NOT list_contains(path, b.b) AND len(path) <= 4)
SELECT array_to_string(path, '>') AS path, (len(path) - 1)::INT AS steps FROM p WHERE cur = 'n7' ORDER BY len(path), p.path LIMIT 20""")
def g06_find_paths(spark, d):
    n = S.read_table(spark, d, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey")).alias("a"), F.concat(F.lit("r"), F.col("n_regionkey")).alias("b"))
    c = S.read_table(spark, d, "customer").select(F.concat(F.lit("c"), F.col("c_custkey") % 40).alias("a"), F.concat(F.lit("n"), F.col("c_nationkey")).alias("b"))
    return G.find_paths(n.union(c).distinct(), "n0", "n7", 4, 20).withColumn("path", F.array_join("path", ">"))


@query(f"WITH {TRIPLES} SELECT document_id, source_node, verb, target_node, confidence FROM triples WHERE verb IN ('A', 'R')")
def g09_validate_triples(spark, d):
    t = triples(spark, d).withColumn("source_type", F.lit("part")).withColumn("target_type", F.lit("supplier"))
    return G.validate_triples(t, ["part", "supplier"], ["A", "R"]).select("document_id", "source_node", "verb", "target_node", "confidence")
