"""Redaction: ordered rules, each seeing what the earlier ones left."""

from __future__ import annotations

import dataclasses
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from guardlake import catalog as C
from guardlake.functions.common import ICASE, UNICODE, any_of, let
from guardlake.functions.patterns import check_regex, folded

REDACTION = ("struct<rule:string,category:string,description:string,n:int,"
             "samples:array<string>>")


@dataclasses.dataclass(frozen=True)
class Rules:
    """Ordered redaction rules; custom ones go last and ignore case."""

    rules: tuple[C.Rule, ...] = C.RULES

    def without_pii(self) -> Rules:
        return Rules(tuple(r for r in self.rules if r.category != "pii"))

    def with_rule(self, name: str, regex: str, replacement: str = C.CUSTOM_RULE_REPLACEMENT,
                  category: str = "custom") -> Rules:
        check_regex(regex)
        rule = C.Rule(name, regex, replacement, f"Custom rule: {name}", category, True)
        return Rules((*self.rules, rule))


DEFAULT = Rules()


def _lit(word: str):
    return lambda text, low: text.contains(word)


# rule name -> substring or digit run without which neither the text nor anything an
# earlier rule leaves behind can match
_GATES = {
    "email": _lit("@"),
    "phone_us": lambda text, low: text.rlike("[0-9]{4}"),
    "ssn": lambda text, low: text.rlike("[0-9]{4}"),
    "credit_card": lambda text, low: text.rlike("[0-9]{13}"),
    "openai_key": _lit("sk-"),
    "anthropic_key": _lit("sk-ant-"),
    "github_pat": _lit("ghp_"),
    "aws_access_key": _lit("AKIA"),
    "generic_api_key": lambda text, low: any_of([text.contains("api"), text.contains("API")]),
    "bearer_token": _lit("Bearer"),
    "private_key": _lit("-----BEGIN"),
    "password": lambda text, low: any_of(low.contains(w) for w in ("passw", "pwd")),
    "system_prompt_leak": lambda text, low: (
        (low.contains("you") & low.contains("are")) | low.contains("instruction")
        | (low.contains("system") & low.contains("prompt:"))),
}


def java_regex(rule: C.Rule) -> str:
    return (ICASE if rule.ignore_case else UNICODE) + rule.regex


def _java_replacement(rule: C.Rule) -> str:
    return rule.replacement.replace("\\", "\\\\").replace("$", "\\$")


def _gated(rule: C.Rule, text: Column, low: Column, then: Column, otherwise: Column) -> Column:
    gate = _GATES.get(rule.name) if rule in C.RULES else None
    return then if gate is None else F.when(gate(text, low), then).otherwise(otherwise)


def redacted(text: Column, rules: Rules = DEFAULT) -> Column:
    """Text after all rules."""
    def run(original: Column, low: Column) -> Column:
        def apply(rule: C.Rule, before: Column) -> Column:
            return let(before, lambda t: _gated(rule, original, low, F.regexp_replace(
                t, java_regex(rule), _java_replacement(rule)), t))

        return reduce(lambda out, rule: apply(rule, out), rules.rules, original)

    return let(text, lambda t: let(folded(t), lambda low: run(t, low)))


def filtered(text: Column, rules: Rules = DEFAULT) -> Column:
    """struct<text, detections>: redacted text and, per rule that fired, the number of
    distinct matches with up to three samples."""
    none = F.array().cast(f"array<{REDACTION}>")

    def step(rule: C.Rule, state: Column) -> Column:
        found = F.array_sort(F.array_distinct(
            F.regexp_extract_all(state["text"], F.lit(java_regex(rule)), F.lit(0))))

        def record(matches: Column) -> Column:
            samples = F.transform(F.slice(matches, 1, C.SAMPLES_KEPT), lambda s: F.when(
                F.length(s) > C.SAMPLE_CHARS,
                F.concat(F.substring(s, 1, C.SAMPLE_CHARS), F.lit("..."))).otherwise(s))
            hit = F.struct(F.lit(rule.name).alias("rule"), F.lit(rule.category).alias("category"),
                           F.lit(rule.description).alias("description"),
                           F.size(matches).alias("n"), samples.alias("samples"))
            after = F.struct(
                F.regexp_replace(state["text"], java_regex(rule), _java_replacement(rule))
                .alias("text"),
                F.concat(state["detections"], F.array(hit)).alias("detections"))
            return F.when(F.size(matches) > 0, after).otherwise(state)

        return let(found, record)

    def run(original: Column, low: Column) -> Column:
        def apply(rule: C.Rule, state: Column) -> Column:
            return let(state, lambda s: _gated(rule, original, low, step(rule, s), s))

        start = F.struct(original.alias("text"), none.alias("detections"))
        return reduce(lambda state, rule: apply(rule, state), rules.rules, start)

    return let(text, lambda t: let(folded(t), lambda low: run(t, low)))
