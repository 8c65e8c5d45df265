"""Secret scans over a trigram inverted index, in DataFrame functions only.

Each rule's regex gives a Boolean query, an OR of ANDs of trigrams that any match must hold (A-Z lower-cased). The index holds,
for each block of BLOCK rows and each trigram that some rule asks for, the sorted rows of the block that have it. A block's
posting lists are intersected clause by clause; the rows that come out are candidates of the rule and are verified by its
regex over the whole text. Rules without a mandatory trigram scan all texts. Verified matches are found from the left, not
overlapping within a rule, and those whose counted group is too short are dropped.

Places are code points, ends exclusive. Null counts as empty; an empty text has no spans. Rows are told apart by a number
of their own, so repeated rows and doc_ids each have their result; a null doc_id stays null. Empty table: empty result.
Columns other than doc_id and text are not read. A text's matches are rows, not an array, until its spans are joined.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from re import _constants as kinds
from re import _parser as parser

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskloom.llm.common import ascii_lower, doc_texts, new_folder, table, written

BLOCK_BITS = 12
#: Candidate rows that may be broadcast: about 40 bytes each.
BROADCAST_ROWS = 200_000
#: A class of more characters (A-Z lower-cased), or a set of more strings, counts as anything.
MOST_CHARS, MOST_STRINGS, MOST_CLAUSES = 8, 64, 256


def either(word: str) -> str:
    """word with letters in either case."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


@dataclass(frozen=True)
class Rule:
    """group: the part of a match that must have `least` characters; test: what any text with such a match has (the pattern, if empty)."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    test: str = ""


#: The patterns that the base results count (fixed values), in order.
BASE = (
    Rule("assign", "(" + "|".join(map(either, ("password", "passwd", "secret", "token"))) + "|" + either("api") + "_?" + either("key") + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", "AKIA[A-Z0-9]+", 0, 16, "AKIA[A-Z0-9]{12}"),
    Rule("hex", "[0-9a-f]+", 0, 32, "[0-9a-f]{32}"),
)
MORE = (
    Rule("github", "gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", "xox[abprs]-[0-9A-Za-z-]{10,}"),
    Rule("private_key", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("google", "AIza[0-9A-Za-z_-]{35}"),
    Rule("payment", "[sr]k_live_[0-9A-Za-z]{16,}"),
    Rule("url", r"[a-z]{2,12}://[^\x00-\x22/:<>@]{1,64}:[^\x00-\x22/:<>@]{1,64}@"),
)
RULES = BASE + MORE

Clauses = frozenset[frozenset[str]]
ALWAYS: Clauses = frozenset({frozenset()})


def _absorbed(clauses: set[frozenset[str]]) -> Clauses:
    """Without the clauses that another one implies."""
    return frozenset(c for c in clauses if not any(d < c for d in clauses))


def _all(a: Clauses, b: Clauses) -> Clauses:
    """Both hold; where that takes too many clauses, the stricter of the two alone."""
    if len(a) * len(b) > MOST_CLAUSES:
        return max(a, b, key=lambda x: min(map(len, x)))
    return _absorbed({x | y for x in a for y in b})


def _clauses(strings: frozenset[str]) -> Clauses:
    return _absorbed({frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings})


def _lowered(code: int) -> str:
    return chr(code + 32) if 65 <= code <= 90 else chr(code)


def _chars(members: list) -> frozenset[str] | None:
    """What a class matches, or None if too much."""
    out: set[str] = set()
    for op, value in members:
        if op is kinds.LITERAL:
            out.add(_lowered(value))
        elif op is kinds.RANGE and value[1] - value[0] < 64:
            out |= {_lowered(c) for c in range(value[0], value[1] + 1)}
        else:
            return None
    return frozenset(out) if len(out) <= MOST_CHARS else None


def _parts(tree) -> list[frozenset[str] | Clauses | None]:
    """A concatenation's parts: sets of strings, or what else must hold in a gap: ("gap", clauses)."""
    out: list = []
    for op, value in tree:
        if op is kinds.LITERAL:
            out.append(frozenset({_lowered(value)}))
        elif op is kinds.IN:
            out.append(_chars(value) or ("gap", ALWAYS))
        elif op is kinds.SUBPATTERN:
            out += _parts(value[3])
        elif op is kinds.BRANCH:
            sides = [_merged(_parts(x)) for x in value[1]]
            if all(len(x) <= 1 and not (x and isinstance(x[0], tuple)) for x in sides):
                out.append(frozenset().union(*(x[0] if x else {""} for x in sides)))
            else:
                out.append(("gap", _absorbed(set().union(*(_query(x) for x in sides)))))
        elif op in (kinds.MAX_REPEAT, kinds.MIN_REPEAT):
            least, most, body = value
            inner = _merged(_parts(body))
            exact = len(inner) == 1 and not isinstance(inner[0], tuple)
            if least == 0 and most == 1 and exact:
                out.append(inner[0] | {""})
            else:
                out += inner * (least if exact and len(inner[0]) == 1 else min(least, 1))
                out.append(("gap", ALWAYS))
        elif op is not kinds.AT:
            out.append(("gap", ALWAYS))
    return out


def _merged(parts: list) -> list:
    """Sets that follow one another as one, as long as it stays small."""
    out: list = []
    for part in parts:
        if out and not isinstance(part, tuple) and not isinstance(out[-1], tuple) and len(out[-1]) * len(part) <= MOST_STRINGS:
            out[-1] = frozenset(a + b for a in out[-1] for b in part)
        else:
            out.append(part)
    return out


def _query(parts: list) -> Clauses:
    found = ALWAYS
    for part in parts:
        found = _all(found, part[1] if isinstance(part, tuple) else _clauses(part))
    return found


def trigram_query(pattern: str) -> list[list[str]]:
    """Clauses of which one must hold, each the trigrams it needs; none if the regex has no mandatory trigram."""
    found = _query(_merged(_parts(parser.parse(pattern))))
    return [] if frozenset() in found else sorted(sorted(c) for c in found)


def _any_of(trigrams: list[str]) -> str:
    """A look-ahead that takes any of the trigrams at each place, by first character."""
    by: dict[str, list[str]] = {}
    for t in trigrams:
        by.setdefault(t[0], []).append(re.escape(t[1:]))
    return "(?=(" + "|".join(f"{re.escape(c)}(?:{'|'.join(rest)})" for c, rest in by.items()) + "))"


@dataclass
class Index:
    """texts: (row, doc_id, text); postings: (block, trigram, rows)."""

    texts: DataFrame
    postings: DataFrame


def index(docs: DataFrame, rules: tuple[Rule, ...] = RULES, folder: str | None = None) -> Index:
    """The postings of all texts for the trigrams that the rules ask for; both tables are written."""
    folder = folder or new_folder(docs.sparkSession, "secrets")
    texts = doc_texts(docs).select(F.monotonically_increasing_id().alias("row"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    texts = written(texts, "texts", folder, compression="zstd")
    trigrams = sorted({t for r in rules for clause in trigram_query(r.pattern) for t in clause})
    held = F.array_distinct(F.regexp_extract_all(ascii_lower(F.col("text")), F.lit(_any_of(trigrams)), F.lit(1))) if trigrams else F.array().cast("array<string>")
    rows = texts.select(F.shiftright("row", BLOCK_BITS).alias("block"), "row", F.explode(held).alias("trigram"))
    lists = rows.groupBy("block", "trigram").agg(F.sort_array(F.collect_list("row")).alias("rows"))
    return Index(texts, written(lists, "postings", folder, compression="zstd"))


def candidates(postings: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(row, kinds): the rows whose trigrams satisfy a rule's query. Posting lists meet within their block."""
    lists = postings.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("trigram", "rows"))).alias("lists"))
    none = F.array().cast("array<bigint>")

    def meet(clause: list[str]) -> Column:
        rows = F.coalesce(F.element_at("lists", F.lit(clause[0])), none)
        for t in clause[1:]:
            rows = F.array_intersect(rows, F.coalesce(F.element_at("lists", F.lit(t)), none))
        return rows

    found = [F.struct(F.lit(r.kind).alias("kind"), F.array_distinct(F.flatten(F.array(*map(meet, trigram_query(r.pattern))))).alias("rows")) for r in rules if trigram_query(r.pattern)]
    if not found:
        return lists.select(F.lit(0).cast("long").alias("row"), F.array(F.lit("")).alias("kinds")).filter("false")
    each = lists.select(F.explode(F.array(*found)).alias("x")).select(F.col("x.kind").alias("kind"), F.explode("x.rows").alias("row"))
    return each.groupBy("row").agg(F.collect_set("kind").alias("kinds"))


def _matches(texts: DataFrame, rules: list[Rule], asked: Column | None) -> DataFrame:
    """(row, doc_id, kind, number, k, gap, match, counted): the matches of each text in turn, with the text's stretch before each."""
    none = F.array().cast("array<struct<kind:string,number:int,k:int,gap:int,match:string,counted:int>>")

    def of(number: int, r: Rule) -> Column:
        all_of = lambda g: F.regexp_extract_all("text", F.lit(r.pattern), F.lit(g))
        joined = F.arrays_zip(F.split("text", r.pattern, -1).alias("gap"), all_of(0).alias("match"), all_of(r.group).alias("counted"))
        row = lambda x, k: F.struct(F.lit(r.kind).alias("kind"), F.lit(number).alias("number"), k.alias("k"), F.length(x["gap"]).alias("gap"), x["match"].alias("match"), F.length(x["counted"]).alias("counted"))
        wanted = F.rlike("text", F.lit(r.test or r.pattern))  # most texts stop here
        wanted = wanted if asked is None else F.array_contains(asked, r.kind) & wanted
        return F.when(wanted, F.filter(F.transform(joined, row), lambda x: x["match"].isNotNull())).otherwise(none)

    numbers = {r.kind: k for k, r in enumerate(RULES)}
    found = F.flatten(F.array(*(of(numbers.get(r.kind, len(RULES)), r) for r in rules)))
    return texts.select("row", "doc_id", F.explode(found).alias("x")).select("row", "doc_id", "x.*")


def findings(found: Index, rules: tuple[Rule, ...] = RULES, folder: str | None = None) -> DataFrame:
    """(row, doc_id, kind, number, start, end, match) of every span of every rule."""
    folder = folder or new_folder(found.texts.sparkSession, "secrets")
    whole = [r for r in rules if not trigram_query(r.pattern)]
    asked = [r for r in rules if trigram_query(r.pattern)]
    parts = []
    if asked:
        rows = written(candidates(found.postings, rules), "candidates", folder)
        met = found.texts.join(F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows, "row")
        parts.append(_matches(met, asked, F.col("kinds")))
    if whole:
        parts.append(_matches(found.texts, whole, None))
    matches = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    so_far = Window.partitionBy("row", "kind").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    ends = matches.repartition("row").withColumn("end", F.sum(F.col("gap") + F.length("match")).over(so_far))
    least = F.element_at(F.create_map(*(F.lit(v) for r in rules for v in (r.kind, r.least))), F.col("kind"))
    return ends.filter(F.col("counted") >= least).select("row", "doc_id", "kind", "number", (F.col("end") - F.length("match")).alias("start"), "end", "match")


def op12_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = index(table(spark, sf_dir, "documents"))
    spans = findings(found).select("row", "kind", F.struct("start", "number", F.concat_ws(":", "kind", "start", "end").alias("span")).alias("x"), (F.col("number") < len(BASE)).alias("base"))
    line = lambda rows: F.array_join(F.transform(F.array_sort(rows), lambda x: x["span"]), ",")
    by_row = spans.groupBy("row").agg(
        *(F.count(F.when(F.col("kind") == r.kind, 1)).alias(f"n_{r.kind}") for r in BASE),
        line(F.collect_list(F.when(F.col("base"), F.col("x")))).alias("base_spans"), line(F.collect_list("x")).alias("spans"),
    )
    rows = found.texts.select("row", "doc_id").join(by_row, "row", "left")
    return rows.select("doc_id", *(F.coalesce(f"n_{r.kind}", F.lit(0)).cast("long").alias(f"n_{r.kind}") for r in BASE), F.sha2(F.coalesce("base_spans", F.lit("")).cast("binary"), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"))


def _rule_sql(number: int, r: Rule) -> str:
    p = "'" + r.pattern.replace("'", "''") + "'"
    return f"""SELECT rid, '{r.kind}' AS kind, {number} AS number, {r.least} AS least, unnest(range(len(ms))) AS k, unnest(gaps[:len(ms)]) AS gap, unnest(ms) AS m, unnest(gs) AS g
  FROM (SELECT rid, string_split_regex(t, {p}) AS gaps, regexp_extract_all(t, {p}) AS ms, regexp_extract_all(t, {p}, {r.group}) AS gs FROM d)"""


OP12_SQL = f"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents
), matches AS ({" UNION ALL ".join(_rule_sql(k, r) for k, r in enumerate(RULES))}
), ends AS (SELECT *, sum(length(gap) + length(m)) OVER (PARTITION BY rid, kind ORDER BY k) AS e FROM matches
), spans AS (SELECT rid, kind, number, e - length(m) AS s, kind || ':' || CAST(e - length(m) AS BIGINT) || ':' || CAST(e AS BIGINT) AS span FROM ends WHERE length(g) >= least
), by_row AS (SELECT rid, {", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in BASE)},
  string_agg(span, ',' ORDER BY s, number) FILTER (number < {len(BASE)}) AS base_spans, string_agg(span, ',' ORDER BY s, number) AS spans FROM spans GROUP BY rid)
SELECT doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in BASE)}, sha256(coalesce(base_spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN by_row USING (rid)"""
