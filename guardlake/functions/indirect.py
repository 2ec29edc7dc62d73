"""Signs of injection in content the user did not write."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from guardlake import catalog as C
from guardlake.functions import patterns as P
from guardlake.functions.common import ICASE, any_of, let
from guardlake.functions.verdict import layered, no_threats, threat, when_threat

CATEGORY = "indirect_injection"


def external_threats(deob: Column, source: Column, catalog: P.Catalog = P.DEFAULT) -> Column:
    """Threats in external content, given its decoded form: being obfuscated at all, and
    attack patterns, which weigh more here than in user text."""
    hidden = when_threat(deob["layers"] > 0, threat(
        CATEGORY, "obfuscated_tool_output", "high", layered(0.4, deob["layers"], 0.95),
        F.concat(F.lit("Obfuscated content in "), source, F.lit(": "),
                 F.array_join(deob["encodings"], ", "))))

    def found(hits: Column) -> Column:
        names = F.array_join(F.transform(F.slice(hits, 1, 3), lambda h: h["name"]), ", ")
        return when_threat(F.size(hits) > 0, threat(
            CATEGORY, "injection_in_external_content",
            F.when(P.max_level(hits) == "critical", "critical").otherwise("high"),
            F.least(P.max_confidence(hits) + F.lit(0.15), F.lit(1.0)),
            F.concat(F.lit("Injection pattern found in "), source, F.lit(": "), names)))

    return F.concat(hidden, let(P.scan(deob["decoded"], catalog), found))


def comments(content: Column) -> Column:
    """Trimmed HTML comments long enough to carry an instruction."""
    bodies = F.regexp_extract_all(content, F.lit("(?s)" + C.HTML_COMMENT), 1)
    trimmed = F.transform(bodies, lambda b: F.regexp_replace(b, r"(?U)^\s+|\s+$", ""))
    return F.filter(trimmed, lambda b: F.length(b) > C.MIN_COMMENT_CHARS)


def comment_threats(content: Column, source: Column, catalog: P.Catalog = P.DEFAULT) -> Column:
    def each(hits: Column) -> Column:
        return when_threat(F.size(hits) > 0, threat(
            CATEGORY, "hidden_html_comment", "high",
            F.least(P.max_confidence(hits) + F.lit(0.1), F.lit(1.0)),
            F.concat(F.lit("Malicious instructions hidden in HTML comment in "), source)))

    all_of_them = F.flatten(F.transform(
        comments(content), lambda b: let(P.scan(b, catalog), each)))
    return F.when(content.contains("<!--"), all_of_them).otherwise(no_threats())


def invisible_count(content: Column) -> Column:
    return F.when(F.octet_length(content) > F.length(content),
                  F.regexp_count(content, F.lit(C.INVISIBLE))).otherwise(0)


def invisible_threats(content: Column, source: Column) -> Column:
    return let(invisible_count(content), lambda n: when_threat(n > C.MIN_INVISIBLE, threat(
        CATEGORY, "invisible_unicode_chars", "medium", layered(0.2, n, 0.85),
        F.concat(n.cast("string"), F.lit(" invisible Unicode characters found in "), source))))


def has_instruction_prefix(content: Column) -> Column:
    return content.rlike(ICASE + C.INSTRUCTION_PREFIX)


def prefix_threats(content: Column, source: Column) -> Column:
    """Only content whose source label names a tool or function."""
    external = any_of(source.contains(role) for role in C.TOOL_ROLES)
    return when_threat(external & has_instruction_prefix(content), threat(
        CATEGORY, "instruction_prefix_in_tool_output", "high", 0.8,
        F.concat(F.lit("Instruction prefix pattern found in "), source,
                 F.lit(" — possible attempt to override system instructions"))))


def has_markdown_injection(content: Column) -> Column:
    return content.contains("![") & content.rlike(ICASE + C.MARKDOWN_INJECTION)


def markdown_threats(content: Column, source: Column) -> Column:
    return when_threat(has_markdown_injection(content), threat(
        CATEGORY, "markdown_injection", "medium", 0.7,
        F.concat(F.lit("Markdown injection pattern found in "), source)))


def marker_threats(content: Column, source: Column, catalog: P.Catalog = P.DEFAULT) -> Column:
    return F.concat(comment_threats(content, source, catalog),
                    invisible_threats(content, source), prefix_threats(content, source),
                    markdown_threats(content, source))
