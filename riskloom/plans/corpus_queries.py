"""Queries of corpus joins, enrichers, labels and text functions, bound to the driver's tables and to stated lists of cases."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.functions import paths, text
from riskloom.operators import corpus, enrich
from riskloom.plans.registry import literal, query, values
from riskloom.plans.registry import table as _t

c = F.col

# joins -------------------------------------------------------------------------------------------------------------


@query("""WITH l AS (SELECT o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1)
SELECT l_returnflag AS rule_id, count(DISTINCT l_partkey) AS fixtures FROM lineitem JOIN l ON l_orderkey = o_orderkey WHERE l_linestatus = 'F' GROUP BY 1""")
def triggered_fixtures(spark, sf_dir):
    latest = corpus.first_by(_t(spark, sf_dir, "orders"), ["o_custkey"], F.desc("o_orderdate"), F.desc("o_orderkey")).select(c("o_orderkey").alias("run_id"))
    actual = _t(spark, sf_dir, "lineitem").select(c("l_partkey").alias("fixture_id"), c("l_orderkey").alias("run_id"), c("l_returnflag").alias("rule_id"), (c("l_linestatus") == "F").cast("int").alias("did_trigger"))
    return corpus.triggered_fixtures(actual, latest)


@query("""WITH a AS (SELECT user_id AS f, event_type AS r, CASE WHEN value > 10 THEN 1 ELSE 0 END AS d FROM events), e AS (SELECT c_custkey AS f, 'error' AS r, CASE WHEN c_acctbal > 2000 THEN 1 ELSE 0 END AS s FROM customer UNION ALL SELECT c_custkey, 'click', CASE WHEN c_nationkey > 9 THEN 1 ELSE 0 END FROM customer)
SELECT r AS rule_id, count(*) FILTER (d = 1 AND s = 1) AS tp, count(*) FILTER (d = 1 AND s = 0) AS fp, count(*) FILTER (d = 0 AND s = 1) AS fn FROM a JOIN e USING (f, r) GROUP BY 1""")
def all_run_outcomes(spark, sf_dir):
    actual = _t(spark, sf_dir, "events").select(c("user_id").alias("fixture_id"), c("event_type").alias("rule_id"), (c("value") > 10).cast("int").alias("did_trigger"))
    people = _t(spark, sf_dir, "customer")
    one = lambda rule, due: people.select(c("c_custkey").alias("fixture_id"), F.lit(rule).alias("rule_id"), due.cast("int").alias("should_trigger"))
    return corpus.all_run_outcomes(actual, one("error", c("c_acctbal") > 2000).unionByName(one("click", c("c_nationkey") > 9)))


@query("SELECT DISTINCT user_id, event_type FROM events WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)")
def alerts_on_changed_files(spark, sf_dir):
    changed = _t(spark, sf_dir, "customer").filter("c_acctbal > 5000").select(c("c_custkey").alias("user_id"))
    return corpus.alerts_on_changed_files(_t(spark, sf_dir, "events").select("user_id", "event_type"), changed, ["user_id"], ["user_id", "event_type"])


_FILES = [("src/Ouon.cs",), ("docs/the",), ("a/b/EN",), ("lib/tion",), ("x/unlikely-name.cs",)]


@query(f"""SELECT conv_id * 1000 + turn AS id, file_path FROM conversations, {values(_FILES, "file_path")} WHERE contains(lower(role || ' ' || text), lower(regexp_replace(file_path, '^.*/', ''))) OR contains(lower(role || ' ' || text), lower(file_path))""")
def incident_files(spark, sf_dir):
    incidents = _t(spark, sf_dir, "conversations").select((c("conv_id") * 1000 + c("turn")).alias("id"), c("role").alias("title"), c("text").alias("description"))
    return corpus.incidents_of_files(incidents, spark.createDataFrame(_FILES, "file_path string"))


_OPERATIONS_SQL = """f AS (SELECT l_orderkey * 10 + l_linenumber AS id, 'R' || l_returnflag AS rule_id, CAST(l_partkey % 3 AS INT) AS confidence, 'F' || (l_partkey % 100) AS file_path, l_linenumber AS line FROM lineitem),
o AS (SELECT p_partkey AS op_id, 'F' || (p_partkey % 100) AS file_path, CAST(p_size % 9 AS INT) AS line FROM part WHERE p_retailprice / 1000 >= 0.98),
x AS (SELECT file_path, line, min(op_id) AS e FROM o GROUP BY 1, 2), y AS (SELECT file_path, min(op_id) AS a FROM o GROUP BY 1)"""


def _operations(spark, sf_dir):
    findings = _t(spark, sf_dir, "lineitem").select((c("l_orderkey") * 10 + c("l_linenumber")).alias("id"), F.concat(F.lit("R"), "l_returnflag").alias("rule_id"), (c("l_partkey") % 3).cast("int").alias("confidence"), F.concat(F.lit("F"), (c("l_partkey") % 100).cast("string")).alias("file_path"), c("l_linenumber").alias("line"))
    ops = _t(spark, sf_dir, "part").select(c("p_partkey").alias("op_id"), F.concat(F.lit("F"), (c("p_partkey") % 100).cast("string")).alias("file_path"), (c("p_size") % 9).cast("int").alias("line"), (c("p_retailprice") / 1000).alias("risk"))
    return findings, ops


@query(f"WITH {_OPERATIONS_SQL} SELECT id, coalesce(e, a) AS op_id FROM f LEFT JOIN x USING (file_path, line) LEFT JOIN y USING (file_path)")
def operation_lookup(spark, sf_dir):
    return corpus.operation_lookup(*_operations(spark, sf_dir), 0.98).select("id", "op_id")


@query("""WITH f AS (SELECT l_orderkey * 10 + l_linenumber AS id, CASE l_returnflag WHEN 'A' THEN 'GCI0003' WHEN 'N' THEN 'GCI0058' ELSE 'GCI0042' END AS rule_id, CAST(l_partkey % 3 AS INT) AS confidence, 'F' || (l_partkey % 300) AS file_path, l_linenumber AS line FROM lineitem),
o AS (SELECT DISTINCT 'F' || (p_partkey % 300) AS file_path, CAST(p_size % 9 AS INT) AS line, 1 AS hit FROM part WHERE p_retailprice / 1000 >= 0.85 AND p_partkey % 2 = 0)
SELECT id, rule_id, CASE WHEN rule_id <> 'GCI0042' AND hit = 1 THEN 2 ELSE confidence END AS confidence, file_path, line FROM f LEFT JOIN o USING (file_path, line)""")
def semantic_boost(spark, sf_dir):
    rule = F.when(c("l_returnflag") == "A", "GCI0003").when(c("l_returnflag") == "N", "GCI0058").otherwise("GCI0042")
    findings = _t(spark, sf_dir, "lineitem").select((c("l_orderkey") * 10 + c("l_linenumber")).alias("id"), rule.alias("rule_id"), (c("l_partkey") % 3).cast("int").alias("confidence"), F.concat(F.lit("F"), (c("l_partkey") % 300).cast("string")).alias("file_path"), c("l_linenumber").alias("line"))
    kind, path = F.when(c("p_partkey") % 2 == 0, "ConditionalModified").otherwise("LineAdded"), F.concat(F.lit("/f"), (c("p_partkey") % 300).cast("string"))
    ops = _t(spark, sf_dir, "part").select(path.alias("file_path"), (c("p_size") % 9).cast("int").alias("line"), kind.alias("kind"), (c("p_retailprice") / 1000).alias("risk"))
    return corpus.semantic_boost(findings, ops)


@query("SELECT l_orderkey * 10 + l_linenumber AS id, 'S' || l_suppkey AS file_path FROM lineitem WHERE l_linestatus = 'F' AND l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0)")
def uncovered_blocks(spark, sf_dir):
    findings = _t(spark, sf_dir, "lineitem").select((c("l_orderkey") * 10 + c("l_linenumber")).alias("id"), F.when(c("l_linestatus") == "F", 3).otherwise(2).alias("severity"), F.concat(F.lit("S"), c("l_suppkey").cast("string")).alias("file_path"))
    coverage = _t(spark, sf_dir, "supplier").select(F.concat(F.lit("S"), c("s_suppkey").cast("string")).alias("file_path"), F.when(c("s_acctbal") < 0, 0.0).otherwise(0.5).alias("coverage"))
    return corpus.uncovered_blocks(findings, coverage)


def _fingerprints(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", paths.fingerprint(c("lang"), c("source"), c("text")).alias("fingerprint"))


_PRINT = "sha256(d.lang || '|' || d.source || '|' || substr(d.text, 1, 100))"


@query(f"SELECT doc_id, {_PRINT} AS fingerprint FROM documents d WHERE {_PRINT} NOT IN (SELECT {_PRINT} FROM documents d JOIN labels USING (doc_id))")
def baseline_filter(spark, sf_dir):
    prints = _fingerprints(spark, sf_dir)
    return corpus.baseline_filter(prints, prints.join(_t(spark, sf_dir, "labels"), "doc_id", "left_semi")).select("doc_id", "fingerprint")


@query(f"SELECT DISTINCT {_PRINT} AS fingerprint FROM documents d")
def baseline_create(spark, sf_dir):
    return corpus.baseline(_fingerprints(spark, sf_dir))


# filters and predicates ------------------------------------------------------------------------------------------------


@query("SELECT o_custkey, bool_or(o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus = 'F') AS blocks FROM orders GROUP BY 1")
def should_block(spark, sf_dir):
    findings = _t(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority", F.when(c("o_orderstatus") == "F", 3).otherwise(1).alias("severity"))
    return corpus.should_block(findings, "o_custkey", c("o_orderpriority").isin("1-URGENT", "2-HIGH"))


@query("SELECT p_partkey FROM part WHERE lower(p_name) LIKE '%red%' AND lower(p_type) = 'promo'")
def with_all_tags(spark, sf_dir):
    parts = _t(spark, sf_dir, "part").select("p_partkey", F.concat(F.split("p_name", " "), F.array("p_type")).alias("tags"))
    return corpus.with_all_tags(parts, ["RED", "promo"]).select("p_partkey")


@query("SELECT doc_id FROM documents WHERE NOT (lang IS NULL OR lower(lang) <> 'en' OR n_chars < 500 OR source IN ('src1', 'src2'))")
def purge_fixtures(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").select("doc_id", c("lang").alias("language"), (c("n_chars") >= 500).alias("has_comments"), c("source").alias("repo"))
    return corpus.purge(docs, "en", True, ["SRC1", "src2"]).select("doc_id")


@query("SELECT event_id FROM events WHERE event_type = 'error' AND props LIKE '%7%'")
def error_log(spark, sf_dir):
    return _t(spark, sf_dir, "events").filter((c("event_type") == "error") & c("props").like("%7%")).select("event_id")


@query("SELECT p_partkey FROM part WHERE p_type IS NULL OR p_type = '' OR lower(p_type) NOT IN ('economy', 'small', 'promo')")
def invalid_tiers(spark, sf_dir):
    tier = c("p_type")
    return _t(spark, sf_dir, "part").filter(tier.isNull() | (tier == "") | ~F.lower(tier).isin("economy", "small", "promo")).select("p_partkey")


@query("SELECT event_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY")
def audit_since(spark, sf_dir):
    events = _t(spark, sf_dir, "events")
    last = events.agg(F.max("ts").alias("last"))
    return events.join(F.broadcast(last), c("ts") >= c("last") - F.expr("INTERVAL 7 DAY")).select("event_id")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity >= 25 AND EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus = 'F')")
def diagnostics_on_changed_lines(spark, sf_dir):
    changed = _t(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(c("o_orderkey").alias("l_orderkey"))
    return _t(spark, sf_dir, "lineitem").filter("l_quantity >= 25").join(changed, "l_orderkey", "left_semi").select("l_orderkey", "l_linenumber")


# aggregates --------------------------------------------------------------------------------------------------------


@query("""WITH m AS (SELECT l_shipdate::DATE::VARCHAR[1:4] AS rule_id, l_returnflag = 'R' AS e, l_quantity > 25 AS f FROM lineitem), g AS (SELECT rule_id, count(*) FILTER (e AND f) AS tp, count(*) FILTER (NOT e AND f) AS fp, count(*) FILTER (e AND NOT f) AS fn, count(*) FILTER (NOT e AND NOT f) AS tn FROM m GROUP BY 1)
SELECT *, round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2.0 * tp / (2 * tp + fp + fn) END, 9) AS f1 FROM g""".replace("l_shipdate::DATE::VARCHAR[1:4]", "CAST(year(l_shipdate) AS VARCHAR)"))
def curated_scores(spark, sf_dir):
    outcomes = _t(spark, sf_dir, "lineitem").select(F.year("l_shipdate").cast("string").alias("rule_id"), (c("l_returnflag") == "R").alias("fire"), (c("l_quantity") > 25).alias("fired"))
    return corpus.curated_scores(outcomes).withColumn("f1", F.round("f1", 9))


@query("SELECT lower(p_brand) AS file_path, max(p_size) AS severity, count(*) AS findings, count(DISTINCT p_type) AS rules FROM part GROUP BY 1")
def heatmap(spark, sf_dir):
    return corpus.heatmap(_t(spark, sf_dir, "part").select(c("p_brand").alias("file_path"), c("p_size").alias("severity"), c("p_type").alias("rule_id")))


@query("SELECT count(*) AS scans, count(*) FILTER (n > 0) AS with_findings, CAST(sum(n) AS BIGINT) AS findings FROM (SELECT o_orderkey, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') AS n FROM orders)")
def audit_stats(spark, sf_dir):
    n = _t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count_if(c("l_returnflag") == "R").alias("n_findings"))
    log = _t(spark, sf_dir, "orders").join(n, c("o_orderkey") == c("l_orderkey"), "left").select(c("o_orderkey").alias("scan_id"), F.coalesce("n_findings", F.lit(0)).alias("n_findings"))
    return corpus.audit_stats(log)


@query("SELECT p_brand, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, p_brand LIMIT 5")
def top_rules(spark, sf_dir):
    return corpus.top(_t(spark, sf_dir, "part"), "p_brand", 5)


@query("SELECT lang, source, count(*) AS n, count(*) FILTER (n_chars > 1000) AS long FROM documents GROUP BY 1, 2")
def corpus_status(spark, sf_dir):
    return _t(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"), F.count_if(c("n_chars") > 1000).alias("long"))


@query("SELECT user_id, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1")
def rejected_repos(spark, sf_dir):
    return _t(spark, sf_dir, "events").filter("event_type = 'error'").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH d AS (SELECT doc_id, substr(string_split(coalesce(text, ''), chr(10))[1], 1, 12) AS k, row_number() OVER (PARTITION BY substr(string_split(coalesce(text, ''), chr(10))[1], 1, 12) ORDER BY doc_id) AS rn FROM documents)
SELECT md5(k) AS cluster, count(*) AS n, array_to_string(list(doc_id ORDER BY doc_id) FILTER (rn <= 3), ',') AS examples FROM d GROUP BY k""")
def evidence_clusters(spark, sf_dir):
    out = corpus.clusters(_t(spark, sf_dir, "documents").select(c("doc_id").alias("id"), c("text").alias("evidence")), 12)
    return out.select(F.md5("cluster").alias("cluster"), "n", F.array_join(c("examples").cast("array<string>"), ",").alias("examples"))


@query("""WITH f AS (SELECT DISTINCT user_id AS k, event_type AS r FROM events WHERE value > 60), q AS (SELECT DISTINCT user_id AS k, event_type AS r FROM events WHERE event_type IN ('error', 'click'))
SELECT k AS fixture_id, count(*) FILTER (a AND b) AS hits, count(*) FILTER (NOT a) AS missed, count(*) FILTER (NOT b) AS noise FROM (SELECT coalesce(f.k, q.k) AS k, f.k IS NOT NULL AS a, q.k IS NOT NULL AS b FROM f FULL JOIN q ON f.k = q.k AND f.r = q.r) GROUP BY 1""")
def noise_audit(spark, sf_dir):
    pairs = _t(spark, sf_dir, "events").select(c("user_id").alias("fixture_id"), c("event_type").alias("rule_id"), "value")
    return corpus.noise(pairs.filter("value > 60").select("fixture_id", "rule_id").distinct(), pairs.filter("rule_id in ('error', 'click')").select("fixture_id", "rule_id").distinct())


@query("SELECT c_mktsegment AS class, CAST(c_nationkey AS VARCHAR) AS tool, count(*) FILTER (c_acctbal > 3000) AS caught, count(*) AS total, count(*) FILTER (c_acctbal > 3000) / count(*) AS rate FROM customer WHERE c_custkey % 2 = 0 GROUP BY 1, 2")
def competitive_rollup(spark, sf_dir):
    catches = _t(spark, sf_dir, "customer").select(c("c_mktsegment").alias("class"), c("c_nationkey").cast("string").alias("tool"), (c("c_acctbal") > 3000).alias("caught"), (c("c_custkey") % 2 == 0).alias("ci_required"))
    return corpus.rollup_by_tool(catches, ["class", "tool"])


@query("SELECT lang AS rule_id, CAST(coalesce(sum(toxic), 0) AS BIGINT) AS positive, count(*) AS total FROM labels JOIN documents USING (doc_id) GROUP BY 1")
def label_totals(spark, sf_dir):
    return corpus.label_totals(_t(spark, sf_dir, "labels").join(_t(spark, sf_dir, "documents"), "doc_id").select(c("lang").alias("rule_id"), c("toxic").alias("should_trigger")))


@query("""SELECT o_custkey, language FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, f) AS rn FROM (SELECT o_custkey, o_orderpriority AS language, count(*) AS n, min(o_orderkey) AS f FROM orders WHERE trim(o_orderpriority, ' ') <> '' GROUP BY 1, 2)) WHERE rn = 1""")
def inferred_language(spark, sf_dir):
    return corpus.inferred_language(_t(spark, sf_dir, "orders").select("o_custkey", c("o_orderkey").alias("pos"), c("o_orderpriority").alias("hint")), "o_custkey")


@query("SELECT s_name AS login, s_acctbal AS contributions FROM supplier ORDER BY s_acctbal DESC, s_name LIMIT (SELECT greatest(10, CAST(ceil(count(*) * 5 / 100) AS BIGINT)) FROM supplier)")
def top_contributors(spark, sf_dir):
    return corpus.top_share(_t(spark, sf_dir, "supplier").select(c("s_name").alias("login"), c("s_acctbal").alias("contributions")))


@query("SELECT event_type, count(*) AS added, round(sum(value), 2) AS total FROM events GROUP BY 1 ORDER BY added DESC, event_type LIMIT 3")
def telemetry_rollup(spark, sf_dir):
    return _t(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("added"), F.round(F.sum("value"), 2).alias("total")).orderBy(F.desc("added"), "event_type").limit(3)


@query("SELECT conv_id, turn FROM conversations ORDER BY length(text) DESC, conv_id, turn LIMIT 50")
def annotations_top(spark, sf_dir):
    return _t(spark, sf_dir, "conversations").orderBy(F.desc(F.length("text")), "conv_id", "turn").limit(50).select("conv_id", "turn")


@query("SELECT event_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 20")
def last_scans(spark, sf_dir):
    return _t(spark, sf_dir, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(20).select("event_id", "ts")


@query("SELECT l_suppkey, round(count(*) FILTER (l_returnflag = 'R') / count(*), 9) AS precision, count(*) AS triggers FROM lineitem GROUP BY 1 ORDER BY precision, triggers DESC, l_suppkey LIMIT 12")
def lowest_precision(spark, sf_dir):
    by = _t(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.round(F.count_if(c("l_returnflag") == "R") / F.count(F.lit(1)), 9).alias("precision"), F.count(F.lit(1)).alias("triggers"))
    return by.orderBy("precision", F.desc("triggers"), "l_suppkey").limit(12)


@query("SELECT lang, count(DISTINCT lower(source)) AS sources FROM documents GROUP BY 1")
def case_insensitive_distinct(spark, sf_dir):
    return _t(spark, sf_dir, "documents").groupBy("lang").agg(F.countDistinct(F.lower("source")).alias("sources"))


# enrichers ---------------------------------------------------------------------------------------------------------


@query("""WITH g AS (SELECT l_orderkey AS diff_id, count(*) FILTER (l_returnflag <> 'R') AS production, count(*) FILTER (l_returnflag = 'R') AS tests FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1)
SELECT *, production > 0 AND tests = 0 AS gap, CASE WHEN production = 0 THEN 1.0::DOUBLE ELSE round(tests / production, 9) END AS ratio FROM g""")
def test_coverage(spark, sf_dir):
    files = _t(spark, sf_dir, "lineitem").select(c("l_orderkey").alias("diff_id"), (c("l_linestatus") == "F").alias("is_source"), (c("l_returnflag") == "R").alias("is_test"))
    return corpus.test_coverage(files).withColumn("ratio", F.round("ratio", 9))


@query("SELECT p_partkey, round(CASE WHEN p_brand LIKE '%1%' THEN 0.4 ELSE 0 END + CASE WHEN p_size >= 10 THEN 0.3 WHEN p_size >= 5 THEN 0.2 ELSE 0 END + CASE WHEN p_partkey % 10 >= 5 THEN 0.1 ELSE 0 END, 6)::DOUBLE AS score FROM part")
def structural_score(spark, sf_dir):
    return _t(spark, sf_dir, "part").select("p_partkey", F.round(corpus.structural_score(c("p_brand").like("%1%"), c("p_size"), c("p_partkey") % 10), 6).alias("score"))


@query("""SELECT p_partkey, round(greatest(0, least(1, 0.5 + CASE WHEN m < 0 THEN 0 WHEN m < 10 THEN -0.3 WHEN m >= 60 THEN 0.15 ELSE 0 END + CASE WHEN r = 0 THEN -0.25 WHEN r = 1 THEN 0.1 ELSE 0.2 END
  + CASE WHEN n = 0 THEN -0.1 WHEN n >= 3 THEN 0.1 ELSE 0 END - CASE WHEN b THEN 0.15 ELSE 0 END)), 6)::DOUBLE AS score FROM (SELECT p_partkey, p_size * 2 - 5 AS m, p_partkey % 4 AS r, p_partkey % 5 AS n, p_partkey % 4 = 0 AND p_size > 20 AS b FROM part)""")
def social_score(spark, sf_dir):
    p = c("p_partkey")
    return _t(spark, sf_dir, "part").select("p_partkey", F.round(enrich.social_score(c("p_size") * 2 - 5, p % 4, p % 5, (p % 4 == 0) & (c("p_size") > 20)), 6).alias("score"))


#: What is said beside a turn's own text, by its place, so that the words of review occur.
_SAID = ["", "A race condition, and a deadlock", "NullReferenceException here? memory leak", "please add a test, regression risk", "db schema changed; uses .Result", "hard-coded value, linq in loop", "PII in logs; SQL injection; semver", "use epsilon for float equality", "uncaught error"]


def _turns(spark, sf_dir):
    said = F.element_at(F.lit(_SAID), ((c("conv_id") + c("turn")) % len(_SAID) + 1).cast("int"))
    return _t(spark, sf_dir, "conversations").select((c("conv_id") * 1000 + c("turn")).alias("id"), F.concat("text", F.lit(" "), said).alias("t"))


_TURNS_SQL = f"h AS (SELECT conv_id * 1000 + turn AS id, lower(text || ' ' || [{', '.join(literal(x) for x in _SAID)}][CAST((conv_id + turn) % {len(_SAID)} + 1 AS INT)]) AS t FROM conversations)"


def _first_keyword(words: list[str]) -> str:
    return "CASE " + " ".join(f"WHEN contains(t, {literal(w)}) THEN {literal(w)}" for w in words) + " END"


_TAXONOMY_SQL = " UNION ALL ".join(f"SELECT id, {k} AS o, '{rule}' AS rule_id, {_first_keyword(words)} AS keyword, {sure}::DOUBLE AS confidence FROM h" for k, (rule, words, sure) in enumerate(enrich.TAXONOMY))


@query(f"""WITH {_TURNS_SQL}, g AS ({_TAXONOMY_SQL})
SELECT id, rule_id, keyword, confidence FROM (SELECT *, row_number() OVER (PARTITION BY id, rule_id ORDER BY o) AS rn FROM g WHERE keyword IS NOT NULL) WHERE rn = 1""")
def review_comments(spark, sf_dir):
    return enrich.taxonomy_hits(_turns(spark, sf_dir), "id", c("t"))


_TITLES = ["Fix login", "WIP: thing", "Draft", "Bump a from 1 to 2", "Good title"]
_BODIES = ["Fixes #12 and some more words to be long enough", "", "closes https://github.com/a/b/issues/4 with text", "A body that is long enough, with no link at all", "short todo"]


@query(f"""WITH d AS (SELECT o_orderkey AS id, [{", ".join(map(literal, _TITLES))}][CAST(o_orderkey % 5 + 1 AS INT)] || ' ' || o_orderstatus AS t, CASE WHEN o_custkey % 6 < 5 THEN [{", ".join(map(literal, _BODIES))}][CAST(o_custkey % 6 + 1 AS INT)] END AS b FROM orders)
SELECT id, length(trim(coalesce(b, ''), ' ')) < 30 AS "empty", regexp_matches(coalesce(b, ''), '(?i)(fixes|closes|resolves)\\s+(#\\d+|https://github\\.com/[^/]+/[^/]+/issues/\\d+)') AS linked,
  regexp_matches(lower(t || ' ' || coalesce(b, '')), 'wip|work in progress|draft|do not merge|dnm|temp|hack|fixme|todo') AS unfinished, regexp_matches(t, '(?i)^(build\\(deps|chore\\(deps|bump\\s+\\S+\\s+from\\s+\\S+\\s+to\\s)') AS dependabot FROM d""")
def description_signals(spark, sf_dir):
    """Each order as a change with a title and, mostly, a body."""
    title = F.concat(F.element_at(F.lit(_TITLES), (c("o_orderkey") % 5 + 1).cast("int")), F.lit(" "), "o_orderstatus")
    body = F.when(c("o_custkey") % 6 < 5, F.get(F.lit(_BODIES), (c("o_custkey") % 6).cast("int")))
    df = _t(spark, sf_dir, "orders").select(c("o_orderkey").alias("id"), title.alias("t"), body.alias("b"))
    return df.select("id", corpus.description_signals(c("t"), c("b")).alias("s"), corpus.is_dependabot(F.lit("x"), c("t")).alias("dependabot")).select("id", "s.*", "dependabot")


@query("SELECT DISTINCT user_id AS login FROM events WHERE user_id NOT IN (SELECT o_custkey FROM orders)")
def first_contributors(spark, sf_dir):
    return corpus.first_contributors(_t(spark, sf_dir, "events").select(c("user_id").alias("login")).distinct(), _t(spark, sf_dir, "orders").select(c("o_custkey").alias("login")))


@query("SELECT o_custkey, count(*) AS n, count(DISTINCT o_orderstatus) AS rules, ['INFO', 'LOW', 'MEDIUM', 'HIGH', 'CRITICAL'][max(CASE o_orderpriority WHEN '5-LOW' THEN 1 WHEN '3-MEDIUM' THEN 2 WHEN '2-HIGH' THEN 3 ELSE 0 END) + 1] AS highest FROM orders GROUP BY 1")
def worst_findings(spark, sf_dir):
    return corpus.worst_findings(_t(spark, sf_dir, "orders").select("o_custkey", c("o_orderstatus").alias("rule_id"), F.regexp_extract("o_orderpriority", r"-(.*)$", 1).alias("severity")), "o_custkey")


_ADVISED = [("Red", "LOW"), ("widget", "CRITICAL"), ("SMALL", "MEDIUM")]


@query(f"""WITH p AS (SELECT DISTINCT p_brand, lower(unnest(string_split(p_name, ' '))) AS w FROM part), k AS (SELECT lower(n) AS w, s FROM {values(_ADVISED, "n, s")})
SELECT p_brand, count(*) AS n, count(DISTINCT w) AS rules, ['INFO', 'LOW', 'MEDIUM', 'HIGH', 'CRITICAL'][max(CASE s WHEN 'LOW' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'HIGH' THEN 3 WHEN 'CRITICAL' THEN 4 ELSE 0 END) + 1] AS highest FROM p JOIN k USING (w) GROUP BY 1""")
def advisories(spark, sf_dir):
    packages = _t(spark, sf_dir, "part").select("p_brand", F.explode(F.split("p_name", " ")).alias("package"))
    return corpus.advisories(packages, spark.createDataFrame(_ADVISED, "package string, severity string"), "p_brand")


# labels ------------------------------------------------------------------------------------------------------------


@query("SELECT c_custkey AS fixture_id, r AS rule_id, 0 AS should_trigger, 0.4::DOUBLE AS confidence FROM customer, (VALUES ('F'), ('O'), ('P')) v(r) WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = r)")
def negative_labels(spark, sf_dir):
    rules = spark.createDataFrame([("F",), ("O",), ("P",)], "rule_id string")
    return corpus.negative_labels(_t(spark, sf_dir, "customer").select(c("c_custkey").alias("fixture_id")), rules, _t(spark, sf_dir, "orders").select(c("o_custkey").alias("fixture_id"), c("o_orderstatus").alias("rule_id")))


@query("""SELECT DISTINCT l_orderkey AS fixture_id, l_returnflag AS rule_id, 0.55::DOUBLE AS confidence FROM lineitem l WHERE EXISTS (SELECT 1 FROM part WHERE p_partkey = l.l_partkey AND p_size < 5)
  AND NOT EXISTS (SELECT 1 FROM lineitem m WHERE m.l_orderkey = l.l_orderkey AND m.l_returnflag = l.l_returnflag AND m.l_quantity > 45)""")
def path_correlation(spark, sf_dir):
    items = _t(spark, sf_dir, "lineitem")
    fired = items.select(c("l_orderkey").alias("fixture_id"), c("l_returnflag").alias("rule_id"), c("l_partkey").alias("file_path"))
    small = _t(spark, sf_dir, "part").filter("p_size < 5").select(c("p_partkey").alias("file_path"))
    commented = fired.join(small, "file_path", "left_semi").select("fixture_id", "file_path")
    positive = items.filter("l_quantity > 45").select(c("l_orderkey").alias("fixture_id"), c("l_returnflag").alias("rule_id"))
    return corpus.path_correlation(fired, commented, positive)


def _customer_signals(spark, sf_dir):
    """Signals of the enrichers by the digits of a customer's key; null where an enricher has not run."""
    k = c("c_custkey")
    some = lambda n, value: F.when(k % n == 0, value)
    return _t(spark, sf_dir, "customer").select(
        k.alias("fixture_id"), some(3, k % 30 == 0).alias("dependabot"), some(13, k % 26 == 0).alias("migration"), some(17, (k % 2).cast("int")).alias("advisories"), (F.when(k % 19 == 0, 1).otherwise(0)).alias("sonar"), F.lit(0).alias("codeql"),
        some(23, (k % 2).cast("int")).alias("semgrep"), F.when(k % 4 < 3, (k % 10) / 10).alias("social_score"), (k % 3).cast("int").alias("reviewers"), (k % 2 == 0).alias("sensitive_path"), some(5, F.lit(0.7)).alias("structural_score"), some(7, F.lit(0.8)).alias("hotspot"),
        some(11, F.lit(0.9)).alias("entropy"), some(2, k % 4 == 0).alias("test_gap"), (k % 5 == 1).alias("empty_body"), (k % 2 == 1).alias("unfinished"), (k % 8 == 3).alias("first_contributor"), (k % 6 == 1).alias("linked_issue"), some(29, F.lit(True)).alias("nlp"),
    )


_LABELLED = """s AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 4 < 3 THEN c_custkey % 10 / 10.0 END AS score, c_custkey % 3 AS reviewers, c_custkey % 19 = 0 OR (c_custkey % 23 = 0 AND c_custkey % 2 = 1) AS scanned FROM customer),
l AS (SELECT k, reviewers, CASE
  WHEN score IS NULL AND k % 3 <> 0 AND k % 13 <> 0 AND k % 17 <> 0 AND k % 19 <> 0 AND k % 23 <> 0 AND k % 5 <> 0 AND k % 7 <> 0 AND k % 11 <> 0 AND k % 2 <> 0 AND k % 29 <> 0 THEN 'INSUFFICIENT_DATA'
  WHEN k % 30 = 0 THEN 'DEPENDABOT_FIX' WHEN k % 26 = 0 OR (k % 17 = 0 AND k % 2 = 1) OR scanned THEN 'HIGH_RISK_GHOST' WHEN k % 2 = 0 AND k % 5 = 0 AND score < 0.5 THEN 'HOT_PATH_UNREVIEWED' WHEN k % 7 = 0 AND score < 0.5 THEN 'HOT_PATH_UNREVIEWED'
  WHEN k % 11 = 0 AND score < 0.4 THEN 'HOT_PATH_UNREVIEWED' WHEN score < 0.7 AND reviewers <= 1 THEN 'SILENT_LOGIC_CHANGE' WHEN k % 4 = 0 AND score < 0.5 THEN 'UNVALIDATED_BEHAVIORAL_RISK' WHEN k % 5 = 1 AND k % 2 = 1 AND score < 0.3 THEN 'UNVALIDATED_BEHAVIORAL_RISK'
  WHEN k % 8 = 3 AND k % 5 = 1 THEN 'UNVALIDATED_BEHAVIORAL_RISK' WHEN score < 0.3 THEN 'UNVALIDATED_BEHAVIORAL_RISK' WHEN score >= 0.7 THEN 'STANDARD_CHANGE' ELSE 'INSUFFICIENT_DATA' END AS label FROM s),
labelled AS (SELECT k AS fixture_id, label, CASE label WHEN 'DEPENDABOT_FIX' THEN 0.95 WHEN 'HIGH_RISK_GHOST' THEN CASE WHEN k % 19 = 0 THEN 0.8 WHEN k % 17 = 0 AND k % 2 = 1 THEN 0.85 ELSE 0.6 END WHEN 'SILENT_LOGIC_CHANGE' THEN 0.55
  WHEN 'UNVALIDATED_BEHAVIORAL_RISK' THEN CASE WHEN k % 6 = 1 THEN 0.4 ELSE 0.5 END WHEN 'HOT_PATH_UNREVIEWED' THEN 0.65 WHEN 'STANDARD_CHANGE' THEN CASE WHEN reviewers >= 2 THEN 0.75 ELSE 0.6 END ELSE 0 END::DOUBLE AS confidence FROM l)"""


@query(f"WITH {_LABELLED} SELECT * FROM labelled")
def composite_label(spark, sf_dir):
    return corpus.composite_label(_customer_signals(spark, sf_dir))


@query(f"""WITH {_LABELLED}, n AS (SELECT fixture_id, rule_id, confidence FROM labelled JOIN {values(corpus.LABEL_RULES, 'label, rule_id').replace(') v(', ') w(')} USING (label) UNION ALL SELECT c_custkey, 'GCI0021', 0.95::DOUBLE FROM customer WHERE c_custkey % 26 = 0)
SELECT * FROM n WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = fixture_id AND rule_id = CASE o_orderstatus WHEN 'F' THEN 'GCI0003' WHEN 'O' THEN 'GCI0036' ELSE 'GCI0012' END)""")
def expected_of_labels(spark, sf_dir):
    status = F.when(c("o_orderstatus") == "F", "GCI0003").when(c("o_orderstatus") == "O", "GCI0036").otherwise("GCI0012")
    known = _t(spark, sf_dir, "orders").select(c("o_custkey").alias("fixture_id"), status.alias("rule_id"))
    migrated = _customer_signals(spark, sf_dir).filter("migration").select("fixture_id", F.lit(0.95).alias("confidence"))
    return corpus.expected_of_labels(composite_label(spark, sf_dir), known, migrated)


@query("""SELECT l_returnflag AS rule_id, l_orderkey * 10 + l_linenumber AS fixture_id, l_discount AS confidence, rn AS rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY l_returnflag ORDER BY l_discount DESC, l_orderkey * 10 + l_linenumber) AS INT) AS rn FROM lineitem WHERE l_linestatus = 'F' AND l_partkey % 3 <> 0) WHERE rn <= 3""")
def promotions(spark, sf_dir):
    source = F.when(c("l_partkey") % 3 == 0, "LlmReview").otherwise("Heuristic")
    return corpus.promotions(_t(spark, sf_dir, "lineitem").select(c("l_returnflag").alias("rule_id"), (c("l_orderkey") * 10 + c("l_linenumber")).alias("fixture_id"), (c("l_linestatus") == "F").cast("int").alias("should_trigger"), c("l_discount").alias("confidence"), source.alias("label_source")))


# scoring reports -----------------------------------------------------------------------------------------------------

@query("""WITH m AS (SELECT p_partkey AS rule_id, CASE WHEN p_size % 7 > 0 THEN p_size / 50 END AS p, CASE WHEN p_size % 7 > 0 THEN (p_partkey % 10) / 10 END AS r, p_partkey % 3 AS tp, p_size % 3 AS fp FROM part)
SELECT rule_id, CASE WHEN tp = 0 AND fp = 0 THEN 'CRITICAL' WHEN p < 0.8 OR r < 0.6 THEN 'HIGH' ELSE 'NONE' END AS priority,
  array_to_string(list_filter([CASE WHEN p < 0.8 THEN 'HighFalsePositiveRate' END, CASE WHEN r < 0.6 THEN 'LowRecall' END, CASE WHEN tp = 0 AND fp = 0 THEN 'NoSignal' END], lambda x: x IS NOT NULL), ',') AS issues FROM m""")
def refinement(spark, sf_dir):
    share = lambda x: F.when(c("p_size") % 7 > 0, x)
    metrics = _t(spark, sf_dir, "part").select(c("p_partkey").alias("rule_id"), share(c("p_size") / 50).alias("precision"), share((c("p_partkey") % 10) / 10).alias("recall"), (c("p_partkey") % 3).alias("tp"), (c("p_size") % 3).alias("fp"))
    return corpus.refinement(metrics)


@query("""SELECT c_mktsegment AS rule_id, status, c_custkey AS fixture_id, CAST(rn AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment, status ORDER BY c_custkey) AS rn FROM (SELECT *, CASE WHEN c_acctbal > 5000 THEN 'FP' WHEN c_acctbal > 1000 THEN 'FN' ELSE 'TP' END AS status FROM customer) WHERE status <> 'TP') WHERE rn <= 3""")
def generated_cases(spark, sf_dir):
    status = F.when(c("c_acctbal") > 5000, "FP").when(c("c_acctbal") > 1000, "FN").otherwise("TP")
    return corpus.generated_cases(_t(spark, sf_dir, "customer").select(c("c_mktsegment").alias("rule_id"), c("c_custkey").alias("fixture_id"), status.alias("status")))


@query("""WITH l AS (SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1)
SELECT c_custkey AS fixture_id, 'R' AS rule_id FROM customer JOIN l ON o_custkey = c_custkey WHERE c_acctbal > 0 AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')""")
def missed_labels(spark, sf_dir):
    orders = _t(spark, sf_dir, "orders")
    latest = corpus.first_by(orders, ["o_custkey"], F.desc("o_orderdate"), F.desc("o_orderkey")).select(c("o_custkey").alias("fixture_id"), c("o_orderkey").alias("run_id"))
    actual = _t(spark, sf_dir, "lineitem").join(orders, c("l_orderkey") == c("o_orderkey")).select(c("o_custkey").alias("fixture_id"), c("o_orderkey").alias("run_id"), c("l_returnflag").alias("rule_id"), F.lit(1).alias("did_trigger"))
    return corpus.missed(_t(spark, sf_dir, "customer").select(c("c_custkey").alias("fixture_id"), F.lit("R").alias("rule_id"), (c("c_acctbal") > 0).cast("int").alias("should_trigger")), latest, actual)


@query("SELECT l.doc_id, CASE WHEN d.doc_id IS NULL THEN 0 ELSE 1 END AS is_inconclusive, coalesce(d.source, 'old') AS reason FROM labels l LEFT JOIN (SELECT * FROM documents WHERE lang = 'de') d USING (doc_id)")
def label_overrides(spark, sf_dir):
    labels = _t(spark, sf_dir, "labels").select("doc_id", F.lit(0).alias("is_inconclusive"), F.lit("old").alias("reason"))
    return corpus.overridden(labels, _t(spark, sf_dir, "documents").filter("lang = 'de'").select("doc_id", F.lit(1).alias("is_inconclusive"), c("source").alias("reason")), ["doc_id"])


@query("SELECT doc_id FROM documents WHERE lang = 'de' AND doc_id NOT IN (SELECT doc_id FROM labels)")
def overrides_without_label(spark, sf_dir):
    return corpus.missing_keys(_t(spark, sf_dir, "labels"), _t(spark, sf_dir, "documents").filter("lang = 'de'"), ["doc_id"])


@query("SELECT event_id FROM (SELECT *, row_number() OVER (ORDER BY (event_type = 'click') DESC, ts, event_id) AS rn, count(*) OVER () AS n FROM events) WHERE n <= 500 OR rn > 50")
def bounded_queue(spark, sf_dir):
    return corpus.retained_events(_t(spark, sf_dir, "events").withColumn("sent", c("event_type") == "click"), 500, 50).select("event_id")


@query("SELECT event_id, event_type FROM events WHERE NOT (event_type = 'click' AND value < 10)")
def conditional_delete(spark, sf_dir):
    return corpus.delete_where(_t(spark, sf_dir, "events"), (c("event_type") == "click") & (c("value") < 10)).select("event_id", "event_type")


@query("SELECT o_orderkey, CASE WHEN o_orderdate < TIMESTAMP '1995-01-01' THEN 'sent' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def flag_update(spark, sf_dir):
    return corpus.update_where(_t(spark, sf_dir, "orders"), c("o_orderdate") < F.lit("1995-01-01").cast("timestamp_ntz"), "o_orderstatus", F.lit("sent")).select("o_orderkey", "o_orderstatus")


@query("SELECT token, count(*) AS n FROM (SELECT unnest(string_split(replace(p_name, ' ', ';') || ';' || p_type, ';')) AS token FROM part) WHERE starts_with(token, 's') GROUP BY 1")
def token_frequency(spark, sf_dir):
    return corpus.token_frequency(_t(spark, sf_dir, "part").select(F.concat(F.replace("p_name", F.lit(" "), F.lit(";")), F.lit(";"), "p_type").alias("rules")), "rules", "s")


@query("SELECT p_partkey, CASE WHEN s >= 5 THEN 'critical' WHEN s >= 3 THEN 'high' WHEN s >= 1 THEN 'medium' ELSE 'low' END AS band FROM (SELECT p_partkey, CASE WHEN p_size > 30 THEN 2 ELSE 0 END + CASE WHEN p_type = 'PROMO' THEN 2 ELSE 0 END + CASE WHEN p_retailprice > 1000 THEN 1 ELSE 0 END AS s FROM part)")
def risk_band(spark, sf_dir):
    points = [F.when(c("p_size") > 30, 2).otherwise(0), F.when(c("p_type") == "PROMO", 2).otherwise(0), F.when(c("p_retailprice") > 1000, 1).otherwise(0)]
    return _t(spark, sf_dir, "part").select("p_partkey", corpus.risk_band(points).alias("band"))


@query("SELECT item_id, array_to_string(list_slice(w, 1, 8), ' ') AS keywords FROM (SELECT item_id, list_filter(w, lambda x, i: list_position(w, x) = i) AS w FROM (SELECT item_id, regexp_extract_all(lower(text), '([a-z]{4,})') AS w FROM benchmark))")
def finding_keywords(spark, sf_dir):
    return _t(spark, sf_dir, "benchmark").select("item_id", F.array_join(corpus.keywords(c("text")), " ").alias("keywords"))


_LIBRARY = ", ".join(literal(r) for r in corpus.LIBRARY_SILENT)


@query(f"""WITH f AS (SELECT o_custkey AS diff_id, o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'GCI0022' WHEN 'O' THEN 'GCI0038' ELSE 'GCI0001' END AS rule_id FROM orders), d AS (SELECT c_custkey, CASE WHEN c_nationkey = 1 THEN 'library' WHEN c_nationkey = 2 THEN 'web' WHEN c_acctbal > 5000 THEN 'web' WHEN c_nationkey > 12 AND NOT c_mktsegment = 'BUILDING' THEN 'library' WHEN c_mktsegment = 'BUILDING' THEN 'web' ELSE 'unknown' END AS domain FROM customer)
SELECT diff_id, o_orderkey, rule_id FROM f JOIN d ON diff_id = c_custkey WHERE NOT (domain = 'library' AND rule_id IN ({_LIBRARY}))""")
def domain_filter(spark, sf_dir):
    findings = _t(spark, sf_dir, "orders").select(c("o_custkey").alias("diff_id"), "o_orderkey", F.when(c("o_orderstatus") == "F", "GCI0022").when(c("o_orderstatus") == "O", "GCI0038").otherwise("GCI0001").alias("rule_id"))
    n = c("c_nationkey")
    domain = corpus.repo_domain(F.when(n == 1, "Library").when(n == 2, "web"), (c("c_acctbal") > 5000).cast("int"), (n > 12).cast("int"), c("c_mktsegment") == "BUILDING")
    return corpus.domain_filter(findings, _t(spark, sf_dir, "customer").select(c("c_custkey").alias("diff_id"), domain.alias("domain")))


@query("SELECT 0 AS step, 'all' AS stage, count(*) AS n FROM orders UNION ALL SELECT 1, 'done', count(*) FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 2, 'urgent', count(*) FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'")
def delivery_summary(spark, sf_dir):
    orders = _t(spark, sf_dir, "orders")
    done = orders.filter("o_orderstatus = 'F'")
    return corpus.stage_summary([("all", orders), ("done", done), ("urgent", done.filter("o_orderpriority = '1-URGENT'"))])


# text functions --------------------------------------------------------------------------------------------------------


# labelling -------------------------------------------------------------------------------------------------------------

_COMMENT_SQL = " UNION ALL ".join(f"SELECT id, {k} AS o, '{rule}' AS rule_id, {_first_keyword(words)} AS keyword, {sure}::DOUBLE AS confidence FROM h" for k, (rule, words, sure) in enumerate(corpus.COMMENT_RULES))


@query(f"""WITH {_TURNS_SQL}, g AS ({_COMMENT_SQL})
SELECT id, rule_id, keyword, confidence FROM (SELECT *, row_number() OVER (PARTITION BY id, rule_id ORDER BY o) AS rn FROM g WHERE keyword IS NOT NULL) WHERE rn = 1""")
def comment_labels(spark, sf_dir):
    return enrich.taxonomy_hits(_turns(spark, sf_dir), "id", c("t"), corpus.COMMENT_RULES)


_ADDED = [("var x = LoadAsync().Result;", "GCI0016", 0.65), ("var y = m.Value;", "GCI0006", 0.55), ("var h = MD5.Create();", "GCI0012", 0.7), ("throw new ArgumentNullException();", None, None), ("throw new WidgetException();", "GCI0032", 0.6), ("INSERT IGNORE INTO t", "GCI0015", 0.6), ("plain", None, None), ("a!.b();", "GCI0043", 0.55)]


@query(f"SELECT DISTINCT l_orderkey AS id, rule_id, confidence::DOUBLE AS confidence FROM lineitem JOIN {values([(k, r, x) for k, (_, r, x) in enumerate(_ADDED) if r], 'k, rule_id, confidence')} ON k = l_partkey % {len(_ADDED)}")
def strategy_labels(spark, sf_dir):
    """Each order as a change whose items are added lines."""
    line = F.element_at(F.lit([x for x, _, _ in _ADDED]), (c("l_partkey") % len(_ADDED) + 1).cast("int"))
    return corpus.strategy_labels(_t(spark, sf_dir, "lineitem").select(c("l_orderkey").alias("id"), line.alias("text")), "id")


@query("""WITH l AS (SELECT o_custkey, o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'GCI0016' WHEN 'O' THEN 'GCI0039' ELSE 'GCI0044' END AS rule_id, CASE WHEN o_totalprice > 250000 THEN 1 ELSE 0 END AS s FROM orders),
p AS (SELECT *, max(CASE WHEN rule_id = 'GCI0016' AND s = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey) AS o FROM l)
SELECT o_custkey, rule_id, CASE WHEN o = 1 AND s = 0 AND rule_id <> 'GCI0016' THEN 1 ELSE s END AS should_trigger, CASE WHEN o = 1 AND s = 1 THEN CASE rule_id WHEN 'GCI0039' THEN 0.8 WHEN 'GCI0044' THEN 0.75 ELSE 0.6 END
  WHEN o = 1 AND rule_id = 'GCI0039' THEN 0.7 WHEN o = 1 AND rule_id = 'GCI0044' THEN 0.65 ELSE 0.6 END::DOUBLE AS confidence FROM p""")
def coordinated_labels(spark, sf_dir):
    rule = F.when(c("o_orderstatus") == "F", "GCI0016").when(c("o_orderstatus") == "O", "GCI0039").otherwise("GCI0044")
    labels = _t(spark, sf_dir, "orders").select("o_custkey", rule.alias("rule_id"), (c("o_totalprice") > 250000).cast("int").alias("should_trigger"), F.lit(0.6).alias("confidence"))
    return corpus.coordinated_labels(labels, "o_custkey", {"GCI0039": 0.8, "GCI0044": 0.75}, {"GCI0039": 0.7, "GCI0044": 0.65})


@query("""WITH a AS (SELECT l_orderkey AS id, l_partkey % 9 AS p, l_suppkey % 7 AS t FROM lineitem), s AS (SELECT id, bool_or(p = 0) AS f, bool_or(p = 2) AS snap, bool_or(p = 1 OR t = 1) AS sq, bool_or(t IN (0, 2, 3)) AS code FROM a GROUP BY 1)
SELECT id, CASE WHEN f THEN 0.95 WHEN sq THEN 0.85 WHEN code THEN 0.75 ELSE 0 END::DOUBLE AS confidence, f OR snap OR sq OR code AS detected FROM s""")
def migration_signals(spark, sf_dir):
    """Each order as a change whose items name a file and a line."""
    pick = lambda n, values, rest: F.coalesce(*[F.when(n == k, F.lit(v)) for k, v in enumerate(values)], F.lit(rest))
    path = pick(c("l_partkey") % 9, ["src/Migrations/20240101000000_Add.cs", "db/a.SQL", "src/FooContextModelSnapshot.cs", "src/Migrations/Add.cs", "Migrations/20240101000000_Add.cs"], "src/A.cs")
    text = pick(c("l_suppkey") % 7, ["migrationBuilder.AddColumn(", "alter table t", '[Column("x")]', "public partial class M : Migration", "partial class Migration"], "int x;")
    return corpus.migration_signals(_t(spark, sf_dir, "lineitem").select(c("l_orderkey").alias("id"), path.alias("path"), text.alias("text")), "id").select("id", "confidence", "detected")


@query("SELECT n_nationkey, candidate, distance, CAST(rn AS INT) AS rank FROM (SELECT a.n_nationkey, b.n_name AS candidate, CAST(levenshtein(lower(a.n_name), lower(b.n_name)) AS INT) AS distance, row_number() OVER (PARTITION BY a.n_name ORDER BY levenshtein(lower(a.n_name), lower(b.n_name)), b.n_name) AS rn FROM nation a, nation b WHERE levenshtein(lower(a.n_name), lower(b.n_name)) BETWEEN 1 AND 2) WHERE rn <= 3")
def closest_three(spark, sf_dir):
    n = _t(spark, sf_dir, "nation")
    return enrich.closest_n(n.select("n_nationkey", c("n_name").alias("word")), n.select(c("n_name").alias("candidate")), 3).select("n_nationkey", "candidate", "distance", "rank")
