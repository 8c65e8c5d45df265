"""Every query of the engine by name, bound to the driver's tables, with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from riskloom.functions import paths
from riskloom.operators import delivery, enrich, retrieval, rules, scoring
from riskloom.plans.registry import QUERIES, SQL, query, values
from riskloom.plans.registry import table as _t

FLAGSHIP = "flagship"


@query("""SELECT o_custkey, o_orderkey, o_totalprice FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders WHERE upper(o_orderstatus) = 'F') WHERE rn = 1""")
def latest_run(spark, sf_dir):
    done = _t(spark, sf_dir, "orders").filter(F.upper("o_orderstatus") == "F")
    return scoring.latest_per_key(done, "o_custkey", F.desc("o_orderdate"), F.desc("o_orderkey")).select("o_custkey", "o_orderkey", "o_totalprice")


_JUNK = r"###|&&&|%%%|\*\*\*"


@query(rf"""WITH p AS (SELECT d.lang, CASE WHEN l.quality = 0 THEN 1 ELSE 0 END AS s, CASE WHEN regexp_matches(d.text, '{_JUNK}') THEN 1 ELSE 0 END AS f
  FROM documents d JOIN labels l USING (doc_id) WHERE l.quality IS NOT NULL),
m AS (SELECT lang, count(*) AS labeled, count(*) FILTER (s = 1 AND f = 1) AS tp, count(*) FILTER (s = 0 AND f = 1) AS fp, count(*) FILTER (s = 1 AND f = 0) AS fn, count(*) FILTER (s = 0 AND f = 0) AS tn FROM p GROUP BY lang)
SELECT *, round_even(CASE WHEN tp + fp = 0 THEN NULL ELSE tp / (tp + fp) END, 3) AS precision, round_even(CASE WHEN tp + fn = 0 THEN NULL ELSE tp / (tp + fn) END, 3) AS recall FROM m""")
def confusion_matrix(spark, sf_dir):
    fired = F.coalesce(F.col("text").rlike(_JUNK), F.lit(False)).cast("int")
    pairs = _t(spark, sf_dir, "documents").select("doc_id", "lang", fired.alias("did_trigger")).join(_t(spark, sf_dir, "labels").filter("quality is not null").select("doc_id", (F.col("quality") == 0).cast("int").alias("should_trigger")), "doc_id")
    return scoring.confusion_matrix(pairs, "lang")


@query(rf"""WITH a AS (SELECT doc_id AS id, 'junk' AS rule_id FROM documents WHERE regexp_matches(text, '{_JUNK}') UNION ALL SELECT doc_id, 'short' FROM documents WHERE n_chars < 200),
e AS (SELECT doc_id AS id, 'junk' AS rule_id, CASE WHEN quality = 0 THEN 1 ELSE 0 END AS s FROM labels UNION ALL SELECT doc_id, 'short', toxic FROM labels)
SELECT coalesce(e.id, a.id) AS fixture_id, coalesce(e.rule_id, a.rule_id) AS rule_id,
  CASE WHEN e.s IS NULL THEN 'Unknown' WHEN e.s = 1 AND a.id IS NOT NULL THEN 'TP' WHEN e.s = 1 THEN 'FN' WHEN a.id IS NOT NULL THEN 'FP' ELSE 'TN' END AS status
FROM e FULL JOIN a ON e.id = a.id AND e.rule_id = a.rule_id""")
def outcome_classes(spark, sf_dir):
    return scoring.classify_outcomes(*_labels_and_fired(spark, sf_dir))


def _labels_and_fired(spark, sf_dir):
    docs, labels = _t(spark, sf_dir, "documents"), _t(spark, sf_dir, "labels")
    one = lambda rule, s: labels.select(F.col("doc_id").alias("fixture_id"), F.lit(rule).alias("rule_id"), s.alias("should_trigger"), F.lit(0).alias("is_inconclusive"))
    expected = one("junk", (F.col("quality") == 0).cast("int")).unionByName(one("short", F.col("toxic").cast("int")))
    fired = docs.filter(F.col("text").rlike(_JUNK)).select(F.col("doc_id").alias("fixture_id"), F.lit("junk").alias("rule_id")).unionByName(docs.filter("n_chars < 200").select(F.col("doc_id").alias("fixture_id"), F.lit("short").alias("rule_id")))
    return expected, fired


@query(rf"""WITH a AS (SELECT doc_id AS id, 'junk' AS rule_id FROM documents WHERE regexp_matches(text, '{_JUNK}') UNION ALL SELECT doc_id, 'short' FROM documents WHERE n_chars < 200),
e AS (SELECT doc_id AS id, 'junk' AS rule_id, CASE WHEN quality = 0 THEN 1 ELSE 0 END AS s FROM labels UNION ALL SELECT doc_id, 'short', toxic FROM labels),
o AS (SELECT coalesce(e.id, a.id) AS id, coalesce(e.rule_id, a.rule_id) AS rule_id, CASE WHEN e.s IS NULL THEN 'U' WHEN e.s = 1 AND a.id IS NOT NULL THEN 'TP' WHEN e.s = 1 THEN 'FN' WHEN a.id IS NOT NULL THEN 'FP' ELSE 'TN' END AS st
  FROM e FULL JOIN a ON e.id = a.id AND e.rule_id = a.rule_id),
t AS (SELECT lang AS tier, count(DISTINCT doc_id) AS n FROM documents GROUP BY lang),
g AS (SELECT o.rule_id, d.lang AS tier, count(*) FILTER (st = 'TP') AS tp, count(*) FILTER (st = 'FP') AS fp, count(*) FILTER (st = 'FN') AS fn, count(*) FILTER (st = 'TN') AS tn, count(*) FILTER (st = 'U') AS unknown,
  count(DISTINCT CASE WHEN st IN ('TP', 'FP', 'U') THEN o.id END) AS f FROM o JOIN documents d ON d.doc_id = o.id GROUP BY 1, 2)
SELECT rule_id, g.tier, tp, fp, fn, tn, unknown, tp + fp + fn + tn AS labeled, round(f / t.n, 6) AS trigger_rate, round(CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END, 6) AS precision,
  round(CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END, 6) AS recall, CAST(CASE WHEN rule_id = 'junk' THEN 2.5 ELSE 0 END AS DOUBLE) AS avg_usefulness FROM g JOIN t ON t.tier = g.tier""")
def scorecard_by_tier(spark, sf_dir):
    outcomes = scoring.classify_outcomes(*_labels_and_fired(spark, sf_dir))
    fixtures = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("fixture_id"), F.col("lang").alias("tier"))
    useful = spark.range(2, 4, 1, 1).select(F.lit("junk").alias("rule_id"), F.col("id").alias("usefulness"))
    rounded = {c: F.round(c, 6) for c in ("trigger_rate", "precision", "recall")}
    return scoring.scorecard(outcomes, fixtures, useful).withColumns(rounded)


@query("""SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n_orders,
  (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AS n_done, (SELECT count(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_custkey = c_custkey) AS n_items FROM customer""")
def alert_subqueries(spark, sf_dir):
    orders, items = _t(spark, sf_dir, "orders"), _t(spark, sf_dir, "lineitem")
    per_order = items.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    per = orders.join(per_order, F.col("o_orderkey") == F.col("l_orderkey"), "left").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n_orders"), F.count_if(F.col("o_orderstatus") == "F").alias("n_done"), F.sum(F.coalesce("n", F.lit(0))).alias("n_items"))
    return _t(spark, sf_dir, "customer").select("c_custkey").join(per, "c_custkey", "left").na.fill(0)


@query("""SELECT l_suppkey, l_returnflag, count(*) AS pairs, count(*) FILTER (l_linestatus = 'F') AS done FROM lineitem GROUP BY 1, 2 HAVING count(*) >= 3""")
def having_pairs(spark, sf_dir):
    return _t(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.count(F.lit(1)).alias("pairs"), F.count_if(F.col("l_linestatus") == "F").alias("done")).filter("pairs >= 3")


@query("""WITH w AS (SELECT user_id, event_type, count(*) AS w FROM events GROUP BY 1, 2), p AS (SELECT *, w / sum(w) OVER (PARTITION BY user_id) AS p FROM w)
SELECT user_id, count(*) AS n_items, CASE WHEN count(*) <= 1 THEN 0 ELSE round(-sum(p * log2(p)), 6) END AS entropy, CASE WHEN count(*) <= 1 THEN 0 ELSE round(-sum(p * log2(p)) / log2(count(*)), 6) END AS normalised FROM p GROUP BY user_id""")
def shannon_entropy(spark, sf_dir):
    return scoring.entropy(_t(spark, sf_dir, "events"), "user_id", "event_type", F.lit(1))


@query("""WITH r AS (SELECT l_suppkey, l_extendedprice AS v, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice) AS rn, count(*) OVER (PARTITION BY l_suppkey) AS n FROM lineitem)
SELECT l_suppkey, max(n) AS n, max(CASE WHEN rn = ceil(n * 95 / 100) THEN v END) AS p95, max(CASE WHEN rn = n // 2 + 1 THEN v END) AS upper_median FROM r GROUP BY 1""")
def p95_and_upper_median(spark, sf_dir):
    return scoring.spread(_t(spark, sf_dir, "lineitem"), "l_suppkey", "l_extendedprice")


def _item_findings(spark, sf_dir):
    c = F.col
    return _t(spark, sf_dir, "lineitem").select(
        c("l_suppkey").alias("diff_id"), F.concat(F.lit("R"), c("l_returnflag")).alias("rule_id"), F.when(c("l_linestatus") == "F", F.when(c("l_quantity") > 45, 3).otherwise(2)).otherwise(F.when(c("l_quantity") > 25, 4).otherwise(1)).alias("severity"),
        F.pmod(c("l_partkey"), F.lit(3)).cast("int").alias("confidence"), F.concat(F.lit("F"), F.pmod(c("l_partkey"), F.lit(10)).cast("string")).alias("file_path"),
        F.when(c("l_linenumber") > 2, c("l_linenumber")).alias("line"), c("l_orderkey"), c("l_linenumber"),
    )


_FINDINGS_SQL = """WITH f AS (SELECT l_suppkey AS diff_id, 'R' || l_returnflag AS rule_id, CASE WHEN l_linestatus = 'F' THEN CASE WHEN l_quantity > 45 THEN 3 ELSE 2 END ELSE CASE WHEN l_quantity > 25 THEN 4 ELSE 1 END END AS severity,
  CAST(l_partkey % 3 AS INT) AS confidence, 'F' || (l_partkey % 10) AS file_path, CASE WHEN l_linenumber > 2 THEN l_linenumber END AS line, l_orderkey, l_linenumber FROM lineitem),
s AS (SELECT *, CASE severity WHEN 3 THEN 1000 WHEN 2 THEN 100 WHEN 4 THEN 50 ELSE 10 END + CASE WHEN line IS NULL THEN 0 ELSE 50 END + 10 + CASE confidence WHEN 2 THEN 30 WHEN 1 THEN 20 ELSE 0 END AS score FROM f),
k AS (SELECT *, count(*) FILTER (severity = 3) OVER (PARTITION BY diff_id, rule_id, lower(file_path)) AS blocks,
  row_number() OVER (PARTITION BY diff_id, rule_id, lower(file_path), severity = 3 ORDER BY score DESC, rule_id, lower(file_path), coalesce(line, 2147483647), l_orderkey, l_linenumber) AS r FROM s),
capped AS (SELECT * FROM k WHERE severity = 3 OR r <= 5 - blocks)"""


@query(_FINDINGS_SQL + " SELECT diff_id, rule_id, severity, confidence, file_path, coalesce(line, 0) AS line, l_orderkey, l_linenumber FROM capped")
def per_file_cap(spark, sf_dir):
    return delivery.cap_per_file(_item_findings(spark, sf_dir), "diff_id", 5, {}, "l_orderkey", "l_linenumber").na.fill(0, ["line"])


@query(_FINDINGS_SQL + """, g AS (SELECT *, row_number() OVER (PARTITION BY diff_id ORDER BY CASE WHEN n > 25 THEN CAST(severity = 3 AS INT) ELSE 0 END DESC, score DESC, rule_id, lower(file_path), coalesce(line, 2147483647), l_orderkey, l_linenumber) AS delivery_rank
  FROM (SELECT *, count(*) OVER (PARTITION BY diff_id) AS n FROM capped))
SELECT diff_id, rule_id, severity, confidence, file_path, coalesce(line, 0) AS line, l_orderkey, l_linenumber, delivery_rank FROM g WHERE delivery_rank <= 25""")
def ranked_delivery(spark, sf_dir):
    capped = delivery.cap_per_file(_item_findings(spark, sf_dir), "diff_id", 5, {}, "l_orderkey", "l_linenumber")
    return delivery.rank(capped, "diff_id", 25, "l_orderkey", "l_linenumber").na.fill(0, ["line"])


@query("""SELECT diff_id, rule_id, file_path, count(*) AS n, max(severity) AS severity, list_sort(list_distinct(list(line) FILTER (line IS NOT NULL)))::VARCHAR AS lines FROM (
SELECT l_suppkey AS diff_id, 'R' || l_returnflag AS rule_id, CASE WHEN l_linestatus = 'F' THEN CASE WHEN l_quantity > 45 THEN 3 ELSE 2 END ELSE CASE WHEN l_quantity > 25 THEN 4 ELSE 1 END END AS severity, 'F' || (l_partkey % 10) AS file_path, CASE WHEN l_linenumber > 2 THEN l_linenumber END AS line FROM lineitem) GROUP BY 1, 2, 3""".replace("list_sort(list_distinct(list(line) FILTER (line IS NOT NULL)))::VARCHAR", "coalesce(array_to_string(list_sort(list_distinct(list(line) FILTER (line IS NOT NULL))), ','), '')"))
def grouped_findings(spark, sf_dir):
    out = delivery.group_findings(_item_findings(spark, sf_dir).withColumn("evidence", F.lit("")))
    return out.select("diff_id", "rule_id", "file_path", "n", "severity", F.array_join(F.transform("lines", lambda x: x.cast("string")), ",").alias("lines"))


@query("""SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn <= 2 ORDER BY o_totalprice DESC, o_orderkey LIMIT 50""")
def diversified_pick(spark, sf_dir):
    return scoring.diversified(_t(spark, sf_dir, "orders"), "o_custkey", 2, 50, F.desc("o_totalprice"), F.asc("o_orderkey")).select("o_custkey", "o_orderkey", "o_totalprice")


_NORM = r"regexp_replace(rtrim(string_split(trim(l, ' '), '//')[1], ' '), '\s+', ' ', 'g')"


@query(rf"""WITH lines AS (SELECT doc_id, doc_id // 2 AS pair, CASE WHEN doc_id % 2 = 0 THEN 'removed' ELSE 'added' END AS kind, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
n AS (SELECT *, {_NORM} AS norm FROM lines), r AS (SELECT pair, norm, count(*) AS copies FROM n WHERE kind = 'removed' AND norm <> '' GROUP BY 1, 2),
a AS (SELECT *, row_number() OVER (PARTITION BY pair, norm ORDER BY doc_id, pos) AS k FROM n WHERE kind = 'added' AND norm <> '')
SELECT a.doc_id, CAST(a.pos - 1 AS INT) AS line_ord, md5(a.norm) AS norm_md5 FROM a JOIN r USING (pair, norm) WHERE k <= copies""")
def relocated_lines(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").select("doc_id", F.expr("doc_id div 2").alias("pair"), F.when(F.col("doc_id") % 2 == 0, "removed").otherwise("added").alias("kind"), F.posexplode(F.split("text", "\n")).alias("line_ord", "content"))
    out = delivery.relocated_lines(docs.withColumn("file_ord", F.col("doc_id")), ["pair"])
    return out.select("doc_id", "line_ord", F.md5("norm").alias("norm_md5"))


@query("""SELECT page_id, url FROM pages WHERE NOT (regexp_matches(lower(url), '^https://[^/]*/[^/]*$') OR regexp_matches(lower(url), '.*1$'))""")
def ignore_glob(spark, sf_dir):
    pages = _t(spark, sf_dir, "pages").select("page_id", "url", F.lit("GCI0001").alias("rule_id"), F.col("url").alias("file_path"))
    return delivery.suppress(pages, ["GCI0001:https://*/*", "gci0001:**1", "GCI0002"]).select("page_id", "url")


@query("""WITH m AS (SELECT user_id, event_type, ts, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn, count(*) OVER (PARTITION BY user_id) AS n,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS i FROM events)
SELECT user_id, event_type, count(*) AS run_length, min(ts) AS run_start FROM m GROUP BY user_id, event_type, i HAVING count(*) >= 3 AND max(rn) < max(n)""")
def closed_runs(spark, sf_dir):
    return scoring.islands(_t(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type", 3)


@query("""SELECT event_id, user_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_purchase FROM events""")
def carry_forward(spark, sf_dir):
    own = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return _t(spark, sf_dir, "events").select("event_id", "user_id", F.last(F.when(F.col("event_type") == "purchase", F.col("value")), True).over(own).alias("last_purchase"))


_COSINE = "round(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])) / (sqrt(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))) * sqrt(list_dot_product(CAST(v.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])))), 6)"


@query(f"""SELECT query_id, vec_id, score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM (
SELECT q.vec_id AS query_id, v.vec_id, {_COSINE} AS score FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0 AND q.vec_id <> v.vec_id)) WHERE rank <= 5""")
def vector_topk(spark, sf_dir):
    v = _t(spark, sf_dir, "embeddings")
    return retrieval.top_k(v.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query")), v.select("vec_id", "embedding"), 5)


@query(f"""SELECT query_id, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM (
SELECT q.vec_id AS query_id, v.vec_id, {_COSINE} AS score FROM embeddings q, embeddings v WHERE q.vec_id <> v.vec_id)) WHERE rank = 1 AND score >= 0.4""")
def adjudicate_top1(spark, sf_dir):
    v = _t(spark, sf_dir, "embeddings")
    return retrieval.top_k(v.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query")), v.select("vec_id", "embedding"), 1, 0.4).drop("rank")


_WORDS = [("A1", ["the", "und"], 0.7), ("A2", ["ment", "que"], 0.6), ("A1", ["ing"], 0.5)]


@query("""WITH h AS (SELECT conv_id * 1000 + turn AS id, lower(text) AS t FROM conversations),
g AS (SELECT id, 0 AS o, 'A1' AS rule_id, CASE WHEN contains(t, 'the') THEN 'the' WHEN contains(t, 'und') THEN 'und' END AS keyword, 0.7::DOUBLE AS confidence FROM h
UNION ALL SELECT id, 1, 'A2', CASE WHEN contains(t, 'ment') THEN 'ment' WHEN contains(t, 'que') THEN 'que' END, 0.6::DOUBLE FROM h UNION ALL SELECT id, 2, 'A1', CASE WHEN contains(t, 'ing') THEN 'ing' END, 0.5::DOUBLE FROM h)
SELECT id, rule_id, keyword, confidence FROM (SELECT *, row_number() OVER (PARTITION BY id, rule_id ORDER BY o) AS rn FROM g WHERE keyword IS NOT NULL) WHERE rn = 1""")
def nlp_taxonomy(spark, sf_dir):
    c = _t(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    return enrich.taxonomy_hits(c, "id", F.col("text"), _WORDS)


def _two_label_sets(spark, sf_dir):
    labels = _t(spark, sf_dir, "labels")
    old = labels.select("doc_id", F.col("quality").alias("should_trigger"), F.when(F.col("doc_id") % 3 == 0, "Human").otherwise("Heuristic").alias("label_source"), F.lit(0.5).alias("confidence"))
    new = labels.filter("doc_id % 2 = 0").select("doc_id", F.col("toxic").alias("should_trigger"), F.lit("LlmReview").alias("label_source"), F.lit(0.8).alias("confidence"))
    return old, new


@query("""SELECT doc_id, CASE WHEN doc_id % 2 = 0 AND doc_id % 3 <> 0 THEN toxic ELSE quality END AS should_trigger, CASE WHEN doc_id % 3 = 0 THEN 'Human' WHEN doc_id % 2 = 0 THEN 'LlmReview' ELSE 'Heuristic' END AS label_source,
  CASE WHEN doc_id % 2 = 0 AND doc_id % 3 <> 0 THEN 0.8::DOUBLE ELSE 0.5::DOUBLE END AS confidence FROM labels""")
def label_merge(spark, sf_dir):
    return scoring.merge_labels(*_two_label_sets(spark, sf_dir), ["doc_id"], ["Human", "Manual", "Seed"])


@query("""SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN toxic ELSE quality END AS should_trigger, CASE WHEN doc_id % 2 = 0 THEN 'LlmReview' WHEN doc_id % 3 = 0 THEN 'Human' ELSE 'Heuristic' END AS label_source,
  CASE WHEN doc_id % 2 = 0 THEN 0.8::DOUBLE ELSE 0.5::DOUBLE END AS confidence FROM labels""")
def upsert_labels(spark, sf_dir):
    return scoring.upsert(*_two_label_sets(spark, sf_dir), ["doc_id"])


@query("""SELECT doc_id, quality AS should_trigger, 'Heuristic' AS label_source, 0.5::DOUBLE AS confidence FROM labels
UNION ALL SELECT doc_id, CAST(n_chars > 2000 AS INT), 'Length', 0.3::DOUBLE FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def insert_ignore(spark, sf_dir):
    """Labels stand; a label by length is new only where a document has none."""
    c = F.col
    old = _t(spark, sf_dir, "labels").select("doc_id", c("quality").alias("should_trigger"), F.lit("Heuristic").alias("label_source"), F.lit(0.5).alias("confidence"))
    new = _t(spark, sf_dir, "documents").select("doc_id", (c("n_chars") > 2000).cast("int").alias("should_trigger"), F.lit("Length").alias("label_source"), F.lit(0.3).alias("confidence"))
    return scoring.insert_ignore(old, new, ["doc_id"])


@query("""WITH h AS (SELECT event_type, count(*) FILTER (event_id % 2 = 0) AS n0, count(*) FILTER (event_id % 2 = 1) AS n1, count(DISTINCT CASE WHEN event_id % 2 = 0 THEN user_id END) AS u0, count(DISTINCT CASE WHEN event_id % 2 = 1 THEN user_id END) AS u1 FROM events GROUP BY 1)
SELECT event_type, 'n' AS field, n0::DOUBLE AS before, n1::DOUBLE AS after FROM h WHERE n0 <> n1 AND n0 > 0 AND n1 > 0 UNION ALL SELECT event_type, 'users', u0::DOUBLE, u1::DOUBLE FROM h WHERE u0 <> u1 AND n0 > 0 AND n1 > 0""")
def metric_drift(spark, sf_dir):
    e = _t(spark, sf_dir, "events")
    half = lambda k: e.filter(F.col("event_id") % 2 == k).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users"))
    return scoring.drift(half(0), half(1), "event_type", ["n", "users"])


@query("""SELECT doc_id, sha256(lang || '|' || source || '|' || substr(text, 1, 100)) AS fingerprint, CASE WHEN trim(source, ' ') = '' THEN '00000000' ELSE substr(sha256(lower(trim(source, ' '))), 1, 8) END AS source_hash FROM documents""")
def finding_fingerprints(spark, sf_dir):
    d = _t(spark, sf_dir, "documents")
    return d.select("doc_id", paths.fingerprint(F.col("lang"), F.col("source"), F.col("text")).alias("fingerprint"), paths.hash8(F.col("source")).alias("source_hash"))


@query("""SELECT date_trunc('hour', ts) AS slot, event_type, count(*) AS n, count(DISTINCT user_id) AS users, round(sum(value), 2) AS total FROM events GROUP BY 1, 2""")
def archive_slots(spark, sf_dir):
    return _t(spark, sf_dir, "events").groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("slot"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users"), F.round(F.sum("value"), 2).alias("total"))


@query("""SELECT p_partkey, CASE WHEN p_size <= 2 THEN 'Tiny' WHEN p_size <= 7 THEN 'Small' WHEN p_size <= 20 THEN 'Medium' WHEN p_size <= 75 THEN 'Large' ELSE 'Huge' END AS bucket,
  CASE WHEN p_size = 0 THEN 'none' WHEN p_size <= 5 THEN 'low' WHEN p_size <= 50 THEN 'medium' ELSE 'high' END AS tier, round(least(p_size / 30.0, 1.0), 6)::DOUBLE AS hotspot FROM part""")
def size_buckets(spark, sf_dir):
    n = F.col("p_size")
    return _t(spark, sf_dir, "part").select("p_partkey", paths.size_bucket(n).alias("bucket"), enrich.experience_tier(n).alias("tier"), F.round(enrich.hotspot(n), 6).alias("hotspot"))


@query("""SELECT o_orderkey, CASE WHEN s = 0 THEN false WHEN s = 4 THEN true ELSE s = 3 AND c >= 1 END AS strict, CASE WHEN s = 0 THEN false WHEN s = 4 THEN true ELSE s = 3 OR (s = 2 AND c >= 1) END AS balanced, s > 0 AS permissive
FROM (SELECT o_orderkey, o_orderkey % 5 AS s, o_custkey % 3 AS c FROM orders)""")
def sensitivity_filter(spark, sf_dir):
    s, c = F.col("o_orderkey") % 5, F.col("o_custkey") % 3
    return _t(spark, sf_dir, "orders").select("o_orderkey", *[paths.passes_sensitivity(s, c, t).alias(t) for t in ("strict", "balanced", "permissive")])


@query("""SELECT word, candidate, distance FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY distance, candidate) AS rn FROM (
SELECT w.word, n.n_name AS candidate, CAST(levenshtein(lower(w.word), lower(n.n_name)) AS INT) AS distance FROM (SELECT DISTINCT substr(n_name, 2) AS word FROM nation) w, (SELECT DISTINCT n_name FROM nation) n) WHERE distance <= 2) WHERE rn = 1""")
def closest_match(spark, sf_dir):
    n = _t(spark, sf_dir, "nation")
    return enrich.closest(n.select(F.expr("substring(n_name, 2)").alias("word")).distinct(), n.select(F.col("n_name").alias("candidate")))


@query(r"""SELECT doc_id, pos - 1 AS line_ord, regexp_matches(l, '(?i)TODO|FIXME|HACK') AS stub, regexp_matches(l, '(^|[^0-9.])([0-9]{1,3}\.){3}[0-9]{1,3}([^0-9.]|$)') AS ip, regexp_matches(l, '(?i)(password|secret|apikey|api_key|token|pwd)') AS secret_word
FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)
WHERE regexp_matches(l, '(?i)TODO|FIXME|HACK') OR regexp_matches(l, '(^|[^0-9.])([0-9]{1,3}\.){3}[0-9]{1,3}([^0-9.]|$)') OR regexp_matches(l, '(?i)(password|secret|apikey|api_key|token|pwd)')""")
def line_predicates(spark, sf_dir):
    lines = _t(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_ord", "l"))
    flags = {"stub": rules.has(F.col("l"), rules.STUBS, True), "ip": F.col("l").rlike(r"(^|[^0-9.])([0-9]{1,3}\.){3}[0-9]{1,3}([^0-9.]|$)"), "secret_word": rules.has(F.col("l"), rules.SECRET_NAMES, True)}
    return lines.select("doc_id", F.col("line_ord").cast("long").alias("line_ord"), *[v.alias(k) for k, v in flags.items()]).filter("stub or ip or secret_word")


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)
SELECT doc_id, pos - 1 AS line_ord FROM (SELECT *, max(CAST(contains(l, '|') AS INT)) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS before, max(CAST(contains(l, '|') AS INT)) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) AS after FROM l)
WHERE contains(l, '.') AND coalesce(before, 0) = 0 AND coalesce(after, 0) = 1""")
def frame_guard(spark, sf_dir):
    own = Window.partitionBy("doc_id").orderBy("line_ord")
    lines = _t(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_ord", "l"))
    near = lambda a, b: F.coalesce(F.max(F.contains("l", F.lit("|"))).over(own.rowsBetween(a, b)), F.lit(False))
    return lines.select("doc_id", F.col("line_ord").cast("long").alias("line_ord"), "l", near(-5, -1).alias("b"), near(1, 5).alias("a")).filter(F.contains("l", F.lit(".")) & ~F.col("b") & F.col("a")).select("doc_id", "line_ord")


def _document_diffs(spark, sf_dir):
    """Each document as the diff that adds it as a source file."""
    head = F.concat(F.lit("diff --git a/src/D"), F.col("doc_id"), F.lit(".cs b/src/D"), F.col("doc_id"), F.lit(".cs\nnew file mode 100644\nindex 0..1\n--- /dev/null\n+++ b/src/D"), F.col("doc_id"), F.lit(".cs\n@@ -0,0 +1,1 @@\n+"))
    return _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("diff_id"), F.concat(head, F.replace("text", F.lit("\n"), F.lit("\n+"))).alias("raw_diff"))


@query("""SELECT doc_id AS diff_id, 'src/D' || doc_id || '.cs' AS file_path, len(string_split(text, chr(10))) AS n_lines, len(string_split(text, chr(10))) AS last_line, md5(text) AS content_md5 FROM documents""")
def diff_parse(spark, sf_dir):
    lines = rules.context(_document_diffs(spark, sf_dir), lexed=False)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_ord", "content"))), lambda x: x["content"]), "\n")
    return lines.groupBy("diff_id", "file_path").agg(F.count(F.lit(1)).alias("n_lines"), F.max("new_line").cast("long").alias("last_line"), F.md5(text.cast("binary")).alias("content_md5"))


#: Lines of code that follow a document's comment, one kind for each document: the line, and the findings on each.
_CODE = [
    ("var h = MD5.Create();", [("GCI0012", "weak hash", 3, 2)]), ("lock(this) { }", [("GCI0016", "lock on this", 3, 1)]), ("Thread.Sleep(5);", [("GCI0016", "thread sleep", 3, 1), ("GCI0044", "thread sleep", 1, 1)]),
    ('var u = "10.1.2.3";', [("GCI0010", "ip literal", 3, 1)]), ("var a = b;", []), ("public async void Run() { }", [("GCI0016", "async void", 3, 2)]), ("var s = sp.GetService<IFoo>();", [("GCI0038", "service locator", 2, 2), ("GCI0046", "service locator outside set-up", 1, 0)]),
    ("/* lock(this) */", []),
]
_COPIES = 7


#: Documents that a task cuts into lines, however many there are: its sorts then fit in memory. Few still part into some tasks.
DOCS_AT_ONCE, LEAST_DOCS = 2_000, 250


def _coded_diffs(spark, sf_dir):
    """Each document as a diff that adds a source file: its lines as comments, then one to seven copies of a line of code."""
    k = F.col("doc_id").cast("string")
    head = F.concat(F.lit("diff --git a/src/D"), k, F.lit(".cs b/src/D"), k, F.lit(".cs\nnew file mode 100644\nindex 0..1\n--- /dev/null\n+++ b/src/D"), k, F.lit(".cs\n@@ -0,0 +1,1 @@\n+// "))
    code = F.concat(F.lit("\n+"), F.element_at(F.lit([x for x, _ in _CODE]), (F.col("doc_id") % len(_CODE) + 1).cast("int")))
    body = F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit("\n+// "))
    docs = _t(spark, sf_dir, "documents").select("doc_id", "text")
    n = docs.count()
    docs = docs.repartition(max(1, -(-n // DOCS_AT_ONCE), min(spark.sparkContext.defaultParallelism, -(-n // LEAST_DOCS))), "doc_id")
    return docs.select(F.col("doc_id").alias("diff_id"), F.concat(head, body, F.repeat(code, (F.col("doc_id") % _COPIES + 1).cast("int"))).alias("raw_diff"))


_FOUND_SQL = f"""WITH d AS (SELECT doc_id, len(string_split(coalesce(text, ''), chr(10))) AS n, doc_id % {len(_CODE)} AS code, CAST(doc_id % {_COPIES} + 1 AS INT) AS copies FROM documents),
c AS (SELECT * FROM {values([(k, line, *f) for k, (line, fs) in enumerate(_CODE) for f in fs], 'code, evidence, rule_id, "check", severity, confidence')}),
l AS (SELECT doc_id AS diff_id, rule_id, "check", CAST(severity AS INT) AS severity, CAST(confidence AS INT) AS confidence, 'src/D' || doc_id || '.cs' AS file_path, CAST(n + i AS INT) AS line, evidence FROM d, range(1, copies + 1) r(i), c WHERE c.code = d.code),
f AS (SELECT * FROM l UNION ALL SELECT doc_id, 'GCI0019', 'large quiet diff', 1, 0, NULL, NULL, (n + copies) || ' lines' FROM d WHERE n + copies > 200 AND (SELECT count(*) FROM l WHERE diff_id = doc_id) <= 1)"""


@query(_FOUND_SQL + " SELECT * FROM f")
def rule_findings(spark, sf_dir):
    return rules.evaluate(_coded_diffs(spark, sf_dir))


@query(_FOUND_SQL + """, s AS (SELECT *, CASE severity WHEN 3 THEN 1000 WHEN 2 THEN 100 ELSE 10 END + CASE confidence WHEN 2 THEN 30 WHEN 1 THEN 20 ELSE 0 END + CASE WHEN line IS NULL THEN 0 ELSE 60 END AS score FROM f),
k AS (SELECT *, row_number() OVER (PARTITION BY diff_id, rule_id, "check" ORDER BY line) AS r FROM s)
SELECT diff_id, rule_id, "check", severity, confidence, file_path, line, evidence, CAST(row_number() OVER (PARTITION BY diff_id ORDER BY score DESC, rule_id, line) AS INT) AS delivery_rank FROM k WHERE severity = 3 OR r <= CASE WHEN rule_id IN ('GCI0038', 'GCI0044') THEN 3 ELSE 5 END""")
def flagship(spark, sf_dir):
    """Diff text to lines, findings, and the ranked delivery."""
    return delivery.deliver(rules.evaluate(_coded_diffs(spark, sf_dir)))


from riskloom.plans import corpus_queries, label_queries, patch_queries, text_queries  # noqa: E402, F401  (they register their queries)
