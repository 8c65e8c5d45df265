"""Queries of text functions: texts made of the given tables' values in stated forms, the answers by SQL from the same values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskloom.functions import paths, text
from riskloom.plans.registry import query
from riskloom.plans.registry import table as _t

c = F.col


def _text(*parts) -> Column:
    """Strings stand for themselves, columns for their values."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _by(number: Column, *values: Column) -> Column:
    """The value in the place number mod their count."""
    return F.coalesce(*[F.when(number % len(values) == k, v) for k, v in enumerate(values)])


def _lit(x: str) -> Column:
    return F.lit(x)


@query("""SELECT event_id, CASE WHEN user_id % 50 = 0 THEN 1440 ELSE CASE event_id % 6 WHEN 0 THEN user_id % 50 * 60 WHEN 1 THEN user_id % 50 * 1440 WHEN 2 THEN user_id % 50 WHEN 3 THEN user_id % 50 * 10080 ELSE 1440 END END::BIGINT AS minutes FROM events""")
def duration_minutes(spark, sf_dir):
    x = _text(c("user_id") % 50, _by(c("event_id"), *map(_lit, ("h", "d", "m", "W", "y", ""))))
    return _t(spark, sf_dir, "events").select("event_id", text.duration_minutes(x).alias("minutes"))


@query("SELECT l_orderkey, l_linenumber, CAST(round_even(l_quantity / 200 * 100, 0) AS INT) || '%' AS share FROM lineitem")
def percent_text(spark, sf_dir):
    return _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", text.percent(c("l_quantity") / 200).alias("share"))


@query("SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'ABC-' || o_custkey || ' Jira' WHEN 1 THEN 'eng-' || o_custkey || ' Linear' WHEN 2 THEN o_custkey || ' GitHub' WHEN 3 THEN 'GH-' || o_custkey || ' Jira' ELSE '' END AS issue FROM orders")
def issue_keys(spark, sf_dir):
    k = c("o_custkey")
    x = text.issue_key(_by(c("o_orderkey"), _text("feature/ABC-", k, " eng-3 #4"), _text("eng-", k, " and #4"), _text("fixes #", k), _text("GH-", k), F.lit("nothing")))
    return _t(spark, sf_dir, "orders").select("o_orderkey", F.concat_ws(" ", x["key"], x["provider"]).alias("issue"))


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN 'no colons ' || p_name ELSE 'one: ' || p_name END AS snippet FROM part")
def evidence_snippet(spark, sf_dir):
    name = c("p_name")
    return _t(spark, sf_dir, "part").select("p_partkey", text.evidence_snippet(_by(c("p_partkey"), _text("Line 3: a.cs: ", name), _text("no colons ", name), _text("one: ", name))).alias("snippet"))


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_brand WHEN 1 THEN 'P.' || p_partkey END AS package FROM part")
def package_names(spark, sf_dir):
    k = c("p_partkey")
    return _t(spark, sf_dir, "part").select(k, text.package_name(_by(k, _text('<PackageReference Include="', c("p_brand"), '" Version="1" />'), _text('      "P.', k, '": {'), c("p_name"))).alias("package"))


@query("SELECT p_partkey, 'GCI' || lpad(CAST(p_partkey % 10000 AS VARCHAR), 4, '0') AS rule_id FROM part")
def rule_ids(spark, sf_dir):
    k = c("p_partkey") % 10000
    return _t(spark, sf_dir, "part").select("p_partkey", text.rule_id(_by(c("p_partkey"), _text("gci", k), k.cast("string"), _text("rule ", F.lpad(k.cast("string"), 4, "0")))).alias("rule_id"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'key = \"***\"; x(\"***\", ' || p_size || ')' ELSE p_name END AS masked FROM part")
def evidence_masks(spark, sf_dir):
    return _t(spark, sf_dir, "part").select("p_partkey", text.masked(_by(c("p_partkey"), _text('key = "', c("p_name"), '"; x("', c("p_type"), '", ', c("p_size"), ")"), c("p_name"))).alias("masked"))


@query("SELECT l_orderkey, l_linenumber, CASE l_partkey % 5 WHEN 0 THEN 'GCI0012' WHEN 1 THEN 'GCI0006' WHEN 2 THEN 'GCI0008' WHEN 3 THEN 'GCI0024' END AS rule_id FROM lineitem")
def diagnostic_rules(spark, sf_dir):
    return _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", text.diagnostic_rule(_by(c("l_partkey"), *map(_lit, ("CA2100", "CA1062", "CA1822", "CA2000", "CA9999")))).alias("rule_id"))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'net' || p_size || '.0 ' || (p_size >= 8)::VARCHAR WHEN 1 THEN 'net6.0 false' WHEN 2 THEN 'netstandard2.0 false' ELSE 'false' END AS target FROM part")
def target_frameworks(spark, sf_dir):
    project = _by(c("p_partkey"), _text("<TargetFramework>net", c("p_size"), ".0</TargetFramework>"), _text("<TargetFrameworks>net6.0;net", c("p_size"), ".0</TargetFrameworks>"), F.lit("<TargetFramework>netstandard2.0</TargetFramework>"), _text("<Project>", c("p_name"), "</Project>"))
    x = text.target_framework(project)
    return _t(spark, sf_dir, "part").select("p_partkey", F.concat_ws(" ", x["framework"], x["modern"].cast("string")).alias("target"))


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_brand || ' 1' WHEN 1 THEN p_brand || ';' || p_type || ' 2' ELSE ' 0' END AS left_over FROM part")
def token_lists(spark, sf_dir):
    x = text.without_token(_by(c("p_partkey"), _text("GCI_SYN_AGG;", c("p_brand")), _text(c("p_brand"), ";", c("p_type")), F.lit("GCI_SYN_AGG")), "GCI_SYN_AGG")
    return _t(spark, sf_dir, "part").select("p_partkey", _text(x["items"], " ", x["n"]).alias("left_over"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 < 2 THEN c_custkey % 2 = 0 END AS should_trigger, CASE WHEN c_custkey % 4 < 2 THEN c_custkey % 10 / 10 END::DOUBLE AS confidence, CASE WHEN c_custkey % 4 < 2 THEN c_custkey % 10 < 4 END AS is_inconclusive FROM customer")
def label_replies(spark, sf_dir):
    k = c("c_custkey")
    whole = _text('{"should_trigger": ', k % 2 == 0, ', "confidence": ', (k % 10) / 10, ', "reason": "r"}')
    x = text.label_of_reply(_by(k, whole, _text("```json\n", whole, "\n```"), F.lit('{"should_trigger": true}'), c("c_name")))
    return _t(spark, sf_dir, "customer").select("c_custkey", *(x[f].alias(f) for f in ("should_trigger", "confidence", "is_inconclusive")))


@query("SELECT p_partkey, array_to_string(list_filter([CASE WHEN p_partkey % 2 = 0 THEN 'async' END, CASE WHEN p_partkey % 3 = 0 THEN 'contract-change' END, CASE WHEN p_partkey % 5 = 0 THEN 'early-return' END, CASE WHEN p_partkey % 7 = 0 THEN 'logging' END, CASE WHEN p_partkey % 11 = 0 THEN 'null-safety' END], lambda x: x IS NOT NULL), ',') AS tags FROM part")
def diff_tags(spark, sf_dir):
    k = c("p_partkey")
    some = lambda n, line: F.when(k % n == 0, line).otherwise("")
    x = _text("+", c("p_brand"), some(2, "+await X;"), some(3, "+public int A"), some(5, "+return 1;"), some(7, "+Log.Info(x)"), some(11, "+x ?? y"))
    return _t(spark, sf_dir, "part").select("p_partkey", F.array_join(text.tags(x), ",").alias("tags"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, (l_returnflag = 'A') <> (l_linestatus = 'F') AS flipped FROM lineitem")
def polarity_flips(spark, sf_dir):
    before = _text(F.when(c("l_returnflag") == "A", "!").otherwise(""), "IsA(", c("l_partkey"), ")")
    after = _text("IsA(", c("l_suppkey"), ")", F.when(c("l_linestatus") == "F", " == false").otherwise(""))
    return _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", text.is_polarity_flip(before, after).alias("flipped"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'IsReady' || p_partkey || ',Load' || p_size || '(' ELSE '' END AS symbols FROM part")
def predicate_symbols(spark, sf_dir):
    x = _by(c("p_partkey"), _text("IsReady", c("p_partkey"), " && Load", c("p_size"), "(x)"), _text("a > ", c("p_size")))
    return _t(spark, sf_dir, "part").select("p_partkey", F.array_join(text.predicate_symbols(x), ",").alias("symbols"))


@query("SELECT o_orderkey, o_custkey, CASE o_orderkey % 5 WHEN 0 THEN 3 WHEN 2 THEN 0 WHEN 4 THEN 4 ELSE CASE o_custkey % 4 WHEN 0 THEN 3 WHEN 1 THEN 2 ELSE 1 END END AS severity FROM orders")
def severity_settings(spark, sf_dir):
    x = text.severity_setting(_by(c("o_orderkey"), *map(_lit, ("block", "", "none", "bad", "ADVISORY"))), _by(c("o_custkey"), *map(_lit, ("error", "warning", "suggestion", ""))), F.lit(1))
    return _t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", x.alias("severity"))


@query("SELECT p_partkey FROM part WHERE p_partkey % 4 IN (0, 3)")
def real_rule_ids(spark, sf_dir):
    """Ids of rules, but not of made-up ones, where `_` stands for any character."""
    k = c("p_partkey")
    rule = _by(k, _text("GCI", k), _text("GCI_SYN_", k), _text("X", c("p_brand")), _text("GCISYN", k))
    return _t(spark, sf_dir, "part").withColumn("rule_id", rule).filter(c("rule_id").like("GCI%") & ~c("rule_id").like("GCI_SYN%")).select("p_partkey")


_FOLDERS = ["src", "tests", "Generated", "src/Generated", "latest", "src/Kestrel", "spec"]
_ENDS = [".cs", "Tests.cs", ".g.cs", ".Designer.cs", "Extensions.cs", ".txt"]


@query(f"""WITH d AS (SELECT doc_id, doc_id % {len(_FOLDERS)} AS f, doc_id % {len(_ENDS)} AS e FROM documents)
SELECT doc_id, f IN (1, 6) OR e = 1 AS test, f = 3 OR e IN (2, 3) AS generated, e = 4 AS infrastructure, f = 5 AS security FROM d""")
def path_predicates(spark, sf_dir):
    k = c("doc_id")
    path = _text(F.element_at(F.lit(_FOLDERS), (k % len(_FOLDERS) + 1).cast("int")), "/D", k, F.element_at(F.lit(_ENDS), (k % len(_ENDS) + 1).cast("int")))
    return _t(spark, sf_dir, "documents").select("doc_id", *(f(path).alias(n) for n, f in (("test", paths.is_test_file), ("generated", paths.is_generated_file), ("infrastructure", paths.is_infrastructure_file), ("security", paths.is_security_critical))))
