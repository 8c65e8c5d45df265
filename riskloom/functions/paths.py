"""Predicates on file paths and small scalar functions, as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def normal_path(path: Column) -> Column:
    return F.regexp_replace(F.translate(path, "\\", "/"), "^/+", "")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1))


def normal_line(content: Column) -> Column:
    """Trimmed, cut at the first //, inner white space as one space."""
    return F.regexp_replace(F.rtrim(F.substring_index(F.trim(content), "//", 1)), r"\s+", " ")


def glob_pattern(glob: str) -> str:
    """** is any text, * any text without /, ? one character but /."""
    out, i = [], 0
    while i < len(glob):
        if glob.startswith("**", i):
            out.append(".*")
            i += 2
            continue
        out.append({"*": "[^/]*", "?": "[^/]"}.get(glob[i], re.escape(glob[i])))
        i += 1
    return "^" + "".join(out) + "$"


#: Parts of paths of security-critical code (fixed values).
SECURITY_PATHS = ["Http2", "Kestrel", "TLS", "SSL", "Crypto", "Auth", "Uri", "Parsing", "Validation", "Security", "Hmac", "Hash", "Decrypt", "Encrypt", "Certificate", "Token", "Key"]


def file_name(path: Column) -> Column:
    return F.substring_index(F.translate(path, "\\", "/"), "/", -1)


def is_test_file(path: Column) -> Column:
    """By the folders' and the file's names, in their own case where a capital marks a word."""
    p = F.translate(path, "\\", "/")
    folder = r"(?:(?i:specs?|test[^/]*|[^/]*[^/\p{L}]tests?|[^/]*benchmarks?|samples?|examples?|mocks?|fakes?)|[^/]*Tests?)"
    stem = F.when(F.contains(file_name(path), F.lit(".")), F.regexp_replace(file_name(path), r"\.[^.]*$", "")).otherwise(file_name(path))
    return p.rlike(rf"(?:^|/){folder}/") | stem.rlike(r"^(?i:test)|Tests?$|(?i:spec|benchmarks?)$")


def is_generated_file(path: Column) -> Column:
    p = F.translate(path, "\\", "/")
    return p.rlike(r"(?i)/(generated|obj)/|(\.g|\.g\.i|\.designer|\.net\d+\.\d+|\.netstandard\d+\.\d+)\.cs$") | (F.lower(file_name(path)) == "assemblyinfo.cs")


def is_infrastructure_file(path: Column) -> Column:
    """Where services are set up: by file name, or by a collection of services in the path."""
    name = F.lower(file_name(path))
    return name.isin("program.cs", "startup.cs") | name.endswith("extensions.cs") | F.contains(F.lower(path), F.lit("servicecollection"))


def is_composition_file(path: Column) -> Column:
    """The wider test for dependency injection: folders count too."""
    return F.lower(F.translate(path, "\\", "/")).rlike(r"startup|servicecollection|dependencyinjection|dicontainer|extensions\.cs|/infrastructure/|/configuration/|program\.cs|composition")


def is_security_critical(path: Column) -> Column:
    return F.coalesce(path, F.lit("")).rlike("(?i)" + "|".join(SECURITY_PATHS))


def passes_sensitivity(severity: Column, confidence: Column, threshold: str) -> Column:
    """severity: 0 none, 1 info, 2 warn, 3 block, 4 advisory; confidence: 0 low to 2 high."""
    rest = {
        "strict": (severity == 3) & (confidence >= 1),
        "balanced": (severity == 3) | ((severity == 2) & (confidence >= 1)),
        "permissive": severity >= 1,
    }[threshold]
    return F.when(severity == 0, False).when(severity == 4, True).otherwise(rest)


def size_bucket(files: Column) -> Column:
    return F.when(files <= 2, "Tiny").when(files <= 7, "Small").when(files <= 20, "Medium").when(files <= 75, "Large").otherwise("Huge")


def fingerprint(rule: Column, path: Column, evidence: Column) -> Column:
    """Stable id of a finding: its line number does not take part."""
    text = F.substring(F.regexp_replace(F.coalesce(evidence, F.lit("")), r"^Line \d+: ", ""), 1, 100)
    return F.sha2(F.concat(rule, F.lit("|"), F.coalesce(path, F.lit("")), F.lit("|"), text), 256)


def hash8(text: Column) -> Column:
    clean = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    return F.when(clean == "", "00000000").otherwise(F.substring(F.sha2(clean, 256), 1, 8))
