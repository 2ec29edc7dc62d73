"""Threat structs, advice and the final decision."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from guardlake import catalog as C
from guardlake.functions.common import level_rank, let, max_or, rank_level, sql_text

THREAT = ("struct<category:string,name:string,threat_level:string,confidence:double,"
          "details:string>")
NO_THREATS = f"array<{THREAT}>"


def no_threats() -> Column:
    return F.array().cast(NO_THREATS)


def threat(category, name, level, confidence, details) -> Column:
    def col(v):
        return v if isinstance(v, Column) else F.lit(v)

    return F.struct(col(category).alias("category"), col(name).alias("name"),
                    col(level).alias("threat_level"),
                    col(confidence).cast("double").alias("confidence"),
                    col(details).alias("details"))


def when_threat(condition: Column, item: Column) -> Column:
    """One-element threat array if the condition holds, else an empty one."""
    return F.when(condition, F.array(item)).otherwise(no_threats())


def pattern_threats(hits: Column) -> Column:
    return F.transform(hits, lambda h: threat(
        h["category"], h["name"], h["threat_level"], h["confidence"],
        F.format_string("Matched %dx in category '%s'", h["n_matches"], h["category"])))


def layered(step: float, layers: Column, cap: float) -> Column:
    return F.least(F.lit(step) * layers, F.lit(cap))


def obfuscation_threat(deob: Column, name: str, with_names: bool = True) -> Column:
    said = F.format_string("Decoded %d encoding layer(s)", deob["layers"])
    if with_names:
        said = F.concat(said, F.lit(": "), F.array_join(deob["encodings"], ", "))
    return when_threat(deob["layers"] > 0, threat(
        "obfuscation", name, "medium", layered(0.3, deob["layers"], 0.9), said))


def top_confidence(threats: Column) -> Column:
    return max_or(threats, lambda t: t["confidence"], 0.0)


def top_rank(threats: Column) -> Column:
    return max_or(threats, lambda t: level_rank(t["threat_level"]), 0)


def top_level(threats: Column) -> Column:
    return rank_level(top_rank(threats))


def primary(threats: Column) -> Column:
    """First threat of the highest level (null if there is none)."""
    return let(top_rank(threats), lambda r: F.get(
        F.filter(threats, lambda t: level_rank(t["threat_level"]) == r), F.lit(0)))


def _lookup(pairs: dict[str, str], key: Column) -> Column:
    table = ", ".join(sql_text(x) for x in chain.from_iterable(pairs.items()))
    return F.try_element_at(F.expr(f"map({table})"), key)


def suggestion(category: Column, name: Column, level: Column) -> Column:
    """Advice for the exact pattern, else the first of its category, else by level."""
    exact = {f"{c}/{n}": s for c, group in C.SUGGESTIONS.items() for n, s in group.items()}
    first = {c: next(iter(group.values())) for c, group in C.SUGGESTIONS.items()}
    return F.coalesce(_lookup(exact, F.concat_ws("/", category, name)), _lookup(first, category),
                      _lookup(C.LEVEL_SUGGESTIONS, level), F.lit(C.FALLBACK_SUGGESTION))


def with_suggestions(threats: Column) -> Column:
    return F.transform(threats, lambda t: F.struct(
        t["category"].alias("category"), t["name"].alias("name"),
        t["threat_level"].alias("threat_level"), t["confidence"].alias("confidence"),
        t["details"].alias("details"),
        suggestion(t["category"], t["name"], t["threat_level"]).alias("suggestion")))


def decide(confidence: Column, rank: Column, n_threats: Column, *,
           threshold: float = C.MEDIUM_THRESHOLD, block: bool = True) -> Column:
    return (F.when(n_threats == 0, "allowed")
            .when((rank >= 3) & (confidence > C.BLOCK_CONFIDENCE), "blocked")
            .when((rank == 2) & (confidence >= threshold) & F.lit(block), "blocked")
            .when(rank == 2, "sanitized").otherwise("allowed"))


def boosted(base: Column, any_pattern: Column, context_confidence: Column,
            has_issues: Column) -> Column:
    """Confidence after context: added to when patterns hit, else the larger of both."""
    together = F.when(any_pattern, F.least(F.lit(1.0), base + context_confidence * F.lit(0.2))
                      ).otherwise(F.greatest(base, context_confidence))
    return F.when(has_issues, together).otherwise(base)
