"""Multi-turn signals of one message against the messages before it.

Every message is reduced to a small struct of features (who spoke, probing flag, bit mask of
escalation markers, words).  The signals are expressions over the current features and the
array of earlier ones, so texts themselves never travel through a window.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from guardlake import catalog as C
from guardlake.functions.common import ICASE, any_of, compact, let

FEATURES = "struct<is_user:boolean,probe:boolean,mask:int,words:array<string>>"
_WORD = r"[\p{L}\p{N}_]{3,}"


def features(role: Column, text: Column) -> Column:
    """Features of one message; all-neutral unless it is user text."""
    is_user = F.coalesce((role == "user") & text.isNotNull(), F.lit(False))
    text = F.coalesce(text, F.lit(""))

    def build(low: Column) -> Column:
        mask = sum((F.when(low.contains(w), 1 << i).otherwise(0)
                    for i, w in enumerate(C.ESCALATION_MARKERS)), F.lit(0))
        words = F.transform(F.regexp_extract_all(text, F.lit(_WORD), 0), F.lower)
        probe = any_of(text.rlike(ICASE + p) for p in C.PROBES)
        return F.struct(F.lit(True).alias("is_user"), probe.alias("probe"), mask.alias("mask"),
                        words.alias("words"))

    other = F.struct(F.lit(False).alias("is_user"), F.lit(False).alias("probe"),
                     F.lit(0).alias("mask"), F.array().cast("array<string>").alias("words"))
    return F.when(is_user, let(F.lower(text), build)).otherwise(other)


def _last(items: Column, n: int) -> Column:
    return F.slice(items, F.greatest(F.size(items) - n + 1, F.lit(1)), n)


def topic_change(now: Column, users: Column) -> Column:
    """`users`: features of the earlier user messages."""
    seen = F.array_distinct(F.flatten(F.transform(_last(users, 3), lambda u: u["words"])))
    markers = F.array(*[F.lit(w) for w in C.ESCALATION_MARKERS])

    def score(words: Column, seen: Column) -> Column:
        overlap = F.size(F.array_intersect(words, seen)) / F.size(words)
        marked = F.arrays_overlap(words, markers)
        return (F.when((F.size(words) == 0) | (F.size(seen) == 0), 0.0)
                .when((overlap < 0.15) & marked, 0.85).when(overlap < 0.1, 0.6).otherwise(0.0))

    return let(F.array_distinct(now["words"]), lambda w: let(seen, lambda s: score(w, s)))


def probing(now: Column, users: Column) -> Column:
    probes = F.size(F.filter(users, lambda u: u["probe"])) + F.when(now["probe"], 1).otherwise(0)
    share = probes / (F.size(users) + 1)
    return F.when(share >= 0.6, 0.8).when(share >= 0.3, 0.5).otherwise(0.0)


def escalation(now: Column, users: Column) -> Column:
    masks = F.concat(F.transform(users, lambda u: u["mask"]), F.array(now["mask"]))

    def marks(some: Column) -> Column:
        return F.bit_count(F.aggregate(some, F.lit(0), lambda a, m: a.bitwiseOR(m)))

    def score(masks: Column) -> Column:
        n = F.size(masks)
        half = F.floor(n / 2).cast("int")
        first = marks(F.slice(masks, 1, half))
        second = marks(F.slice(masks, half + 1, n))
        return let(F.struct(first.alias("a"), second.alias("b")), lambda c: (
            F.when(n < 3, 0.0).when((c["a"] == 0) & (c["b"] >= 3), 0.85)
            .when((c["b"] > c["a"] * 2) & (c["b"] >= 2), 0.7).otherwise(0.0)))

    return let(masks, score)


def _occurrences(words: Column) -> Column:
    """Multiset as a set: each word tagged with its running number.

    Sorted and joined, equal words form runs, which one back-reference regex cuts out.
    """
    lines = F.concat(F.array_join(F.array_sort(words), "\n"), F.lit("\n"))
    runs = F.regexp_extract_all(lines, F.lit(r"([^\n]+\n)\1*"), F.lit(0))

    def numbered(run: Column) -> Column:
        word = F.substring_index(run, "\n", 1)
        times = (F.length(run) / (F.length(word) + 1)).cast("int")
        return F.transform(F.sequence(F.lit(1), times),
                           lambda k: F.concat(word, F.lit("\n"), k.cast("string")))

    return F.flatten(F.transform(runs, numbered))


def similar(a: Column, b: Column) -> Column:
    """Multiset Jaccard of two word arrays above .7."""
    small, large = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    common = F.size(F.array_intersect(_occurrences(a), _occurrences(b)))
    exact = let(common, lambda c: c / (F.size(a) + F.size(b) - c) > 0.7)
    # sizes alone bound the similarity, and decide most pairs
    return (F.when(small == 0, False).when(a == b, True)
            .when(small / large > 0.7, exact).otherwise(False))


def retries(now: Column, users: Column) -> Column:
    alike = F.size(F.filter(_last(users, 5), lambda u: similar(now["words"], u["words"])))
    return let(alike, lambda n: F.when(n >= 3, 0.9).when(n >= 2, 0.6).otherwise(0.0))


_SIGNALS = (
    ("topic", topic_change, 0.5, "Sudden topic change detected"),
    ("probe", probing, 0.4, "Probing behaviour detected"),
    ("escalation", escalation, 0.4, "Escalation pattern detected"),
    ("retry", retries, 0.5, "Repetitive retry pattern detected"),
)


def context(now: Column, history: Column, max_history: int = C.MAX_HISTORY) -> Column:
    """struct<topic, probe, escalation, retry, confidence, issues> of the current message's
    features against the features of the messages before it (any role, oldest first)."""
    def judge(scores: Column) -> Column:
        issues = compact([
            F.when(scores[name] > floor, F.concat(
                F.lit(f"{label} (score="), F.format_string("%.2f", scores[name]), F.lit(")")))
            for name, _, floor, label in _SIGNALS])
        top = F.coalesce(F.greatest(*[
            F.when(scores[name] > floor, scores[name]).otherwise(0.0)
            for name, _, floor, _ in _SIGNALS]), F.lit(0.0))
        return F.struct(*[scores[name].alias(name) for name, *_ in _SIGNALS],
                        top.alias("confidence"), issues.alias("issues"))

    def run(recent: Column) -> Column:
        users = F.filter(recent, lambda h: h["is_user"])
        heard = F.size(recent) > 0
        return let(users, lambda u: let(F.struct(*[
            F.when(heard, fn(now, u) if name in ("probe", "escalation") else
                   F.when(F.size(u) > 0, fn(now, u)).otherwise(0.0))
            .otherwise(0.0).alias(name) for name, fn, _, _ in _SIGNALS]), judge))

    return let(_last(F.coalesce(history, F.array().cast(f"array<{FEATURES}>")), max_history), run)
