"""What the lines of a change say for a rule: removed and added lines, those of production sources, and the paths.

A diff is cut once and dealt by its id once; where a line belongs is a running value over its lines, and what a diff says is one
aggregate of flags over the same layout. No row leaves it but one a diff and rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions.paths import file_name
from riskloom.operators.diff import raw_lines
from riskloom.operators.rules import has

#: Parts of lines that name a secret, and calls of weak hashes (fixed values).
SECRET_WORDS = ["password", "passwd", "secret", "apikey", "api_key", "token", "credential", "private_key", "privatekey", "access_key", "auth_key"]
WEAK_HASH_CALLS = ["MD5.Create()", "SHA1.Create()", "new MD5CryptoServiceProvider(", "new SHA1Managed(", "new SHA1CryptoServiceProvider("]
#: Confidence of each rule that a change can bear out (fixed values). GCI0032 is asked about, but no line speaks for it.
CONFIDENCE = {
    "GCI0003": 0.60, "GCI0006": 0.60, "GCI0012": 0.70, "GCI0016": 0.65, "GCI0021": 0.65, "GCI0022": 0.65,
    "GCI0024": 0.65, "GCI0035": 0.55, "GCI0041": 0.60, "GCI0042": 0.60, "GCI0043": 0.60, "GCI0044": 0.60,
}


def is_production_source(path: Column) -> Column:
    """A source file that is no test, generated file, benchmark or sample, by its path in any case."""
    low = F.lower(path)
    test = low.rlike(r"[/\\]tests?[/\\]|tests?\.cs$|(^|[/\\])tests?([/\\]|$)|\.tests?([/\\]|$)|(^|[/\\])tests?\.")
    generated = low.rlike(r"\.g\.cs$|\.g\.i\.cs$|\.designer\.cs$|assemblyinfo\.cs$|/obj/|/generated/")
    sample = low.rlike(r"(^|[/\\])(benchmarks?|samples?|examples?)[/\\]|\.(benchmarks?|samples?)[/\\]")
    return low.endswith(".cs") & ~test & ~generated & ~sample


def is_migration_source(path: Column) -> Column:
    """A source in a folder of migrations whose name begins with a date or a time."""
    p = F.translate(path, "\\", "/")
    return F.lower(p).endswith(".cs") & F.contains(F.lower(p), F.lit("/migrations/")) & file_name(p).rlike(r"^(\d{8}|\d{14})_")


def placed_lines(diffs: DataFrame) -> DataFrame:
    """diffs: diff_id, raw_diff. Lines that are added, removed or name a path: diff_id, pos, side, text (without its mark; paths
    whole), production. An added line belongs to the last new path. A removed one belongs to the last old path once a new path
    followed it; files that are deleted whole have no production lines. Null and empty diffs have no lines."""
    line, c = F.col("line"), F.col
    until = Window.partitionBy("diff_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("diff_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    old, new, gone = line.startswith("--- a/"), line.startswith("+++ b/"), line.startswith("+++ /dev/null")
    path = F.substring("line", 7, 1 << 30)
    side = F.when(line.startswith("--- ") | line.startswith("+++ ") | line.startswith("diff --git"), "path").when(line.startswith("+") & ~line.startswith("+++"), "added").when(line.startswith("-") & ~line.startswith("---"), "removed")
    rows = raw_lines(diffs).withColumn("side", side).filter("side is not null")
    rows = rows.withColumn("_pending", F.coalesce(F.last(F.when(old, path).when(new | gone, F.lit("")), True).over(before), F.lit("")))
    rows = rows.withColumn("_from", F.last(F.when(old | gone, F.lit(False)).when(new, is_production_source(c("_pending"))), True).over(until))
    rows = rows.withColumn("_to", F.last(F.when(new, is_production_source(path)), True).over(until))
    production = F.coalesce(F.when(c("side") == "added", c("_to")).when(c("side") == "removed", c("_from")), F.lit(False))
    return rows.select("diff_id", "pos", "side", F.when(c("side") == "path", line).otherwise(F.substring("line", 2, 1 << 30)).alias("text"), production.alias("production"))


def _flags() -> dict[str, Column]:
    """What a line shows, by name."""
    t, side, made = F.col("text"), F.col("side"), F.col("production")
    added, removed, path = side == "added", side == "removed", side == "path"
    own_added, own_removed = added & made, removed & made
    code = ~t.rlike(r"^\s*//")
    low = F.lower(t)
    signature = t.rlike(r"^\s*(public|protected|internal) ") & has(t, ["("])
    forgiving = code & has(t, [")!", "!;", "!,", "!."])
    blocking = has(t, [".GetAwaiter().GetResult()", ".Wait()"]) | (has(t, [".Result"]) & has(t, ["Task", "Async"])) | (has(t, [".Wait("]) & has(t, ["Task", "CancellationToken"]))
    return {
        "blocks": added & (blocking | has(t, ["lock(this)", "lock (this)"]) | (has(t, ["async void "]) & ~has(t, ["EventArgs", "object sender"]))),
        "sleeps": added & code & has(t, ["Thread.Sleep("]), "test_path": path & has(low, ["test", "spec"]),
        "signature_gone": own_removed & signature, "signature_new": own_added & signature,
        "attribute_gone": own_removed & t.rlike(r"(?i)^\s*\[(JsonProperty|JsonIgnore|XmlElement|DataMember|ProtoMember|Column)"),
        "migration": path & t.startswith("--- a/") & is_migration_source(F.substring(t, 7, 1 << 30)), "schema_gone": removed & low.rlike(r"migrationbuilder\.(drop|alter|rename|create)"),
        "cleanup_gone": own_removed & (has(t, ["using (", "using var", ".Dispose()"]) | (t.rlike(r"^\s*~") & has(t, ["()"]))),
        "repeat_guard_gone": own_removed & (has(low, ["idempotency", "upsert"]) | has(t, ["DuplicateRequestHandler", "INSERT OR IGNORE"])),
        "layers": added & code & ((has(low, ["ui"]) & has(t, ["Repository"])) | (has(t, ["View"]) & has(t, ["Service"])) | (has(low, ["database"]) & has(t, ["Controller"]))),
        "test_gone": removed & (t.rlike(r"^\s*(\[Fact\]|\[Theory\]|public void Test|public async Task Test)") | has(t, ["Assert.", "Should.", ".ShouldBe"])),
        "query": added & has(t, [".Where(", ".Select(", ".FirstOrDefault("]), "loop": added & has(t, ["for ", "foreach"]),
        "allocates": added & has(t, ["new List<", "new Dictionary<", "new string"]), "hot_path": path & has(low, ["loop", "process", "handler"]),
        "stub": added & (has(t, ["NotImplementedException"]) | (has(t, ["throw new"]) & has(t, ["NotImplemented"])) | (has(t, ["TODO"]) & has(low, ["implement"]))),
        "null_set": own_added & code & has(t, [" = null"]) & ~has(t, ["?"]), "null_guard_gone": own_removed & has(t, ["??", "?.", "!= null", "== null"]),
        "forgives": (added | own_removed) & forgiving, "unchecked": added & (has(low, ["#pragma warning disable nullable"]) | has(t, ["CS8600", "CS8602"])),
        "secret": own_added & code & has(low, SECRET_WORDS) & t.rlike(r'^[^=]*=\s*[@$]?"'), "weak_hash": own_added & code & has(t, WEAK_HASH_CALLS),
        "sql": own_added & code & t.rlike(r"(?i)\b(SELECT|INSERT|UPDATE|DELETE|FROM)\b") & (has(t, [" + ", "string.Format("]) | (has(t, ["{"]) & has(t, ['$"']))),
    }


def diff_strategies(diffs: DataFrame) -> DataFrame:
    """diffs: diff_id, raw_diff. diff_id, rule_id, confidence: a positive label for each rule that the change bears out. Rows that
    share a diff_id are one change, also where it is null."""
    flags = _flags()
    by = placed_lines(diffs).groupBy("diff_id").agg(*[F.bool_or(f).alias(n) for n, f in flags.items()])
    c = F.col
    borne = {
        "GCI0003": c("signature_gone") & c("signature_new"), "GCI0006": c("null_set") | c("null_guard_gone"), "GCI0012": c("secret") | c("weak_hash") | c("sql"),
        "GCI0016": c("blocks") | (c("sleeps") & ~c("test_path")), "GCI0021": c("attribute_gone") | (c("migration") & c("schema_gone")), "GCI0022": c("repeat_guard_gone"),
        "GCI0024": c("cleanup_gone"), "GCI0035": c("layers"), "GCI0041": c("test_gone"), "GCI0042": c("stub"), "GCI0043": c("forgives") | c("unchecked"),
        "GCI0044": (c("query") & c("loop")) | (c("allocates") & c("hot_path")),
    }
    found = F.array_compact(F.array(*[F.when(test, F.struct(F.lit(r).alias("rule_id"), F.lit(CONFIDENCE[r]).alias("confidence"))) for r, test in borne.items()]))
    return by.select("diff_id", F.explode(found).alias("f")).select("diff_id", "f.*")
