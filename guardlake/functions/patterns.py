"""Attack-pattern matching as one projection.

Each pattern is counted with `regexp_count`, but only on rows whose folded text
contains the words the pattern cannot match without.  Those gates are substring
searches, an order of magnitude cheaper than the regex they guard, and they never
change a result: every alternative of the pattern needs the words in its gate.
"""

from __future__ import annotations

import dataclasses
import functools

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from guardlake import catalog as C
from guardlake.functions.common import (ICASE_DOTALL, UNICODE, level_rank, max_or,
                                        rank_level, sql_text)
from guardlake.functions.regex import ambiguous_repeat

DETECTION = ("struct<category:string,name:string,threat_level:string,confidence:double,"
             "n_matches:int,matched_text:string>")
MATCHED_TEXT_CHARS = 200

# The four non-ASCII letters that case-insensitive matching equates with ASCII ones.
_FOLD_FROM, _FOLD_TO = "\u0130\u0131\u017f\u212a", "iisk"


# `translate` looks every character up; four searches tell that it has nothing to do.
_TO_FOLD = " OR ".join(f"contains(t, '{c}')" for c in _FOLD_FROM)
_LOW = (f"lower(CASE WHEN octet_length(t) > length(t) AND ({_TO_FOLD}) "
        f"THEN translate(t, '{_FOLD_FROM}', '{_FOLD_TO}') ELSE t END)")


def folded(text: Column) -> Column:
    """Lower-case text in which ASCII words can be searched as plain substrings."""
    return F.call_function("transform", F.array(text), F.expr(f"t -> {_LOW}"))[0]


def _has(*words: str) -> str:
    return "(" + " OR ".join(f"contains(low, {sql_text(w)})" for w in words) + ")"


def _both(*parts: str) -> str:
    return "(" + " AND ".join(parts) + ")"


def _either(*parts: str) -> str:
    return "(" + " OR ".join(parts) + ")"


_NON_ASCII = "octet_length(low) > length(low)"
# The n-th letters of 'ignore', 'system' and 'prompt' as sets: one attempt per place, not three.
_SPLIT_WORDS = UNICODE + r"[isp]\s*[gyr]\s*[nso]\s*[otm]\s*[rep]\s*[emt]"

# pattern name -> words without which the pattern cannot match, as a condition on `low`
GATES: dict[str, str] = {
    "ignore_instructions": _both(
        _has("ignore", "disregard", "forget", "override"),
        _has("instruction", "command", "prompt", "rule", "guideline", "directive")),
    "new_instructions": _has("instruction", "system", "directive"),
    "act_as": _either(_both(_has("you"), _has("are"), _has("now")), _both(_has("act"), _has("as")),
                      _has("pretend", "roleplay", "behave"), _both(_has("assume"), _has("role"))),
    "system_prompt_extract": _either(_has("pre-prompt"), _both(_has("system"), _has("prompt")),
                                     _both(_has("instruction"),
                                           _has("initial", "hidden", "secret"))),
    "developer_mode": _has("mode"),
    "dan_attack": _has("dan", "stan", "dude", "aim", "kevin", "ucar", "maximum", "jailbreak",
                       "anything"),
    "no_restrictions": _has("without", "unrestricted", "unfiltered", "uncensored"),
    "hypothetical_bypass": _has("hypothetical", "fictional", "imaginary", "theoretical"),
    "opposite_day": _either(_both(_has("mode"), _has("bizarro", "evil", "villain", "chaos")),
                            _both(_has("opposite"), _has("day"))),
    "credential_request": _has("password", "credential", "secret", "token", "key"),
    "training_data_extract": _has("training", "memorized", "remember", "learned", "exact"),
    "pii_request": _either(_has("ssn", "birth"), _both(_has("social"), _has("security")),
                           _both(_has("credit"), _has("card")), _both(_has("bank"), _has("account")),
                           _both(_has("home"), _has("address")),
                           _both(_has("phone"), _has("number"))),
    "exec_call": _both(_has("("), _has("exec", "eval", "compile", "__import__", "subprocess",
                                       "os.", "shutil.")),
    "template_injection": _either(_both(_has("{{"), _has("}}")), _both(_has("${"), _has("}")),
                                  _both(_has("<%"), _has("%>"))),
    "sql_injection": _either(
        _both(_has("select", "insert", "update", "delete", "drop", "alter", "create", "truncate"),
              _has("from", "into", "table", "set")),
        _both(_has("union"), _has("select")),
        _both(_has(";"), _has("drop", "delete", "insert", "update"))),
    "base64_payload": _has("base64", "b64", "decode", "encode"),
    "unicode_tricks": _NON_ASCII,
    "leetspeak_bypass": _has("1gn0r3", "pr0mpt", "1nstruct", "syst3m", "byp4ss", "h4ck", "3xpl01t"),
    "char_split_evasion": f"low RLIKE {sql_text(_SPLIT_WORDS)}",
    "safety_disable": _both(
        _has("disable", "turn", "remove", "bypass", "skip", "ignore"),
        _has("safety", "security", "moderation", "filter", "guard", "restriction", "check")),
    "boundary_test": _either(
        _both(_has("what"), _has("limits", "boundaries", "restrictions", "rules")),
        _both(_has("can"), _has("you"), _has("anything", "evil", "malicious"))),
    "infinite_loop_prompt": _either(
        _both(_has("repeat"), _has("forever", "infinitely", "endlessly")),
        _both(_has("infinite"), _has("loop")), _both(_has("keep"), _has("going", "generating"))),
    "token_waste": _either(_both(_has("write"), _has("10000", "million")),
                           _both(_has("fill"), _has("context", "max"))),
    "path_traversal": _has("../", "..\\", "/etc/", "c:\\"),
}

# The statement branch of sql_injection ends in one of these words.  Past the last of
# them no start can succeed, so counting stops there instead of scanning to the end of
# the text once per verb; only the branches that need no such word look at the rest.
_SQL_HEAD = ICASE_DOTALL + r"^.*\s(?:FROM|INTO|TABLE|SET)"
_SQL_TAIL = (ICASE_DOTALL
             + r"(?:UNION\s+(?:ALL\s+)?SELECT|;\s*(?:DROP|DELETE|INSERT|UPDATE)\b)")


def _count(pattern: C.Pattern) -> str:
    regex = sql_text(ICASE_DOTALL + pattern.regex)
    if pattern.name != "sql_injection" or pattern not in C.PATTERNS:
        return f"regexp_count(t, {regex})"
    return (f"transform(array(regexp_extract(t, {sql_text(_SQL_HEAD)}, 0)), head -> "
            f"regexp_count(head, {regex}) + regexp_count("
            f"substring(t, length(head) + 1), {sql_text(_SQL_TAIL)}))[0]")


@dataclasses.dataclass(frozen=True)
class Catalog:
    """An ordered set of patterns; custom ones join their category or open a new one."""

    patterns: tuple[C.Pattern, ...] = C.PATTERNS

    def with_pattern(self, category: str, name: str, regex: str, level: str = "medium") -> Catalog:
        """Add a custom pattern after checking that the regex engine accepts it."""
        check_regex(regex)
        if level not in C.LEVELS:
            raise ValueError(f"Unknown threat level: {level}")
        groups: dict[str, list[C.Pattern]] = {}
        for p in (*self.patterns, C.Pattern(category, name, regex, level)):
            groups.setdefault(p.category, []).append(p)
        return Catalog(tuple(p for group in groups.values() for p in group))

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(i, p.category, p.name, p.regex, p.level) for i, p in enumerate(self.patterns)]
        return spark.createDataFrame(
            rows, "ord int, category string, name string, regex string, threat_level string")


DEFAULT = Catalog()


def check_regex(regex: str) -> None:
    """Raise ValueError unless Spark's regex engine can compile `regex` and its repeats are
    unambiguous.  Looks at the expression only, without running a job."""
    try:
        SparkSession.active()._jvm.java.util.regex.Pattern.compile(ICASE_DOTALL + regex)
    except (Py4JError, PySparkException) as exc:
        raise ValueError(f"Invalid regex: {regex}") from exc
    if ambiguous_repeat(regex):
        raise ValueError(f"Regex with an ambiguous endless repeat: {regex}")


def confidence(n: str, length: str) -> str:
    """0.75, plus .05 per further match up to .15, plus up to .10 for length; in exact milli."""
    return (f"cast(750 + 50 * least(3, {n} - 1) + (least({length}, 5000) + 25) div 50 as double)"
            " / 1000D")


@functools.cache
def _scan_sql(catalog: Catalog) -> str:
    """Lambda from a text to its detections.

    The expression is written as SQL because it has hundreds of parts: parsing it once is
    far cheaper than assembling it call by call.
    """
    counts, hits = [], []
    for i, p in enumerate(catalog.patterns):
        gate = GATES.get(p.name) if p in C.PATTERNS else None
        n = _count(p)
        counts.append(n if gate is None else f"CASE WHEN {gate} THEN {n} ELSE 0 END")
        first = f"regexp_extract(t, {sql_text(ICASE_DOTALL + '(' + p.regex + ')')}, 1)"
        hits.append(
            f"CASE WHEN n[{i}] > 0 THEN named_struct('category', {sql_text(p.category)}, "
            f"'name', {sql_text(p.name)}, 'threat_level', {sql_text(p.level)}, "
            f"'confidence', {confidence(f'n[{i}]', 'length(t)')}, 'n_matches', n[{i}], "
            f"'matched_text', substring({first}, 1, {MATCHED_TEXT_CHARS})) END")
    none = f"cast(array() as array<{DETECTION}>)"
    return (f"t -> transform(array({_LOW}), low -> transform(array(array({', '.join(counts)})), "
            f"n -> CASE WHEN exists(n, c -> c > 0) THEN array_compact(array({', '.join(hits)})) "
            f"ELSE {none} END)[0])[0]")


def scan(text: Column, catalog: Catalog = DEFAULT) -> Column:
    """Detections of a text, in catalog order."""
    return F.call_function("transform", F.array(text), F.expr(_scan_sql(catalog)))[0]


def max_confidence(hits: Column) -> Column:
    return max_or(hits, lambda h: h["confidence"], 0.0)


def max_level(hits: Column) -> Column:
    return rank_level(max_or(hits, lambda h: level_rank(h["threat_level"]), 0))
