"""Expressions over a request: an ordered array of messages.

A message is `struct<role, text, parts array<struct<type, text>>, name, tool_call_id>`;
exactly one of `text` and `parts` is set.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from guardlake import catalog as C
from guardlake.functions.common import ICASE, UNICODE, compact, let, pct

STRINGS = "array<string>"


def pieces(m: Column) -> Column:
    """Text pieces of one message: its string, or its text parts."""
    texts = F.transform(F.filter(m["parts"], lambda p: p["type"] == "text"),
                        lambda p: F.coalesce(p["text"], F.lit("")))
    none = F.array().cast(STRINGS)
    return F.when(m["text"].isNotNull(), F.array(m["text"])).otherwise(F.coalesce(texts, none))


def content(m: Column) -> Column:
    return F.array_join(pieces(m), "")


def is_blank(text: Column) -> Column:
    return ~text.rlike(UNICODE + r"\S")


def flat_text(messages: Column) -> Column:
    """All text pieces in message order, one per line."""
    return F.array_join(F.flatten(F.transform(messages, pieces)), "\n")


def contents(messages: Column, first: Column | None = None) -> Column:
    """array<struct<source, content>> of the non-blank messages, as 'msg[i]:role'.

    `first` is the position of the first message, 0 by default.
    """
    first = F.lit(0) if first is None else first
    labelled = F.transform(messages, lambda m, i: F.struct(
        F.format_string("msg[%d]:%s", i + first, m["role"]).alias("source"),
        content(m).alias("content")))
    return F.filter(labelled, lambda x: ~is_blank(x["content"]))


def tool_contents(messages: Column, first: Column | None = None) -> Column:
    """array<struct<source, content>> of non-blank tool output, as 'tool:name' or
    'tool_msg[i]'."""
    first = F.lit(0) if first is None else first
    labelled = F.transform(messages, lambda m, i: F.struct(
        F.when(F.coalesce(m["name"], F.lit("")) != "", F.concat(F.lit("tool:"), m["name"]))
        .otherwise(F.format_string("tool_msg[%d]", i + first)).alias("source"),
        F.when(m["role"].isin(*C.TOOL_ROLES), content(m)).alias("content")))
    return F.filter(labelled, lambda x: x["content"].isNotNull() & ~is_blank(x["content"]))


def urls_in(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(ICASE + C.URL), 0)


def urls(messages: Column) -> Column:
    """Distinct URLs of all messages."""
    return F.array_distinct(F.flatten(F.transform(messages, lambda m: urls_in(content(m)))))


# ---------------------------------------------------------------- validation
# What validation needs to know about a request is a handful of sums, so it can be taken
# from the nested messages or added up from single message rows.

_SPECIAL = r"(?U)[^\p{L}\p{N}\s\x1c-\x1f]"
_CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f]"


def message_stats(m: Column) -> dict[str, Column]:
    """Additive facts about one message."""
    text = F.array_join(pieces(m), "\n")
    speaks = m["role"].isin("user", "system")
    filled = F.when(m["text"].isNotNull(), m["text"] != "").otherwise(
        F.coalesce(F.size(m["parts"]) > 0, F.lit(False)))
    return {
        "n_pieces": F.size(pieces(m)).cast("long"),
        "n_chars": F.length(text).cast("long") - F.greatest(F.size(pieces(m)) - 1, F.lit(0)),
        "n_special": F.regexp_count(text, F.lit(_SPECIAL)).cast("long"),
        "n_control": F.regexp_count(text, F.lit(_CONTROL)).cast("long"),
        "n_spoken": F.when(speaks & filled, 1).otherwise(0).cast("long"),
        "n_nul": F.when(text.contains("\0"), 1).otherwise(0).cast("long"),
    }


STAT_NAMES = ("n_pieces", "n_chars", "n_special", "n_control", "n_spoken", "n_nul")


def request_stats(messages: Column) -> Column:
    """struct of n_messages and the sums of `message_stats` over the messages."""
    per = F.transform(messages, lambda m: F.struct(
        *[v.alias(k) for k, v in message_stats(m).items()]))

    def total(stats: Column) -> Column:
        def added(name: str) -> Column:
            return F.aggregate(stats, F.lit(0).cast("long"), lambda a, s: a + s[name])

        sums = [added(k).alias(k) for k in STAT_NAMES]
        return F.struct(F.size(stats).cast("long").alias("n_messages"), *sums)

    return let(per, total)


def validation(stats: Column, model: Column, *, max_messages: int = C.MAX_MESSAGES,
               max_chars: int = C.MAX_CHARS, max_special: float = C.MAX_SPECIAL_RATIO) -> Column:
    """struct<is_valid, errors, warnings> from the stats of a request."""
    chars = stats["n_chars"] + F.greatest(stats["n_pieces"] - 1, F.lit(0))
    share = stats["n_special"] / chars
    bad_model = F.coalesce((F.length(model) == 0) | (F.length(model) > C.MAX_MODEL_CHARS),
                           F.lit(True))
    errors = compact([
        F.when(stats["n_messages"] > max_messages, F.format_string(
            f"Too many messages: %d (max {max_messages})", stats["n_messages"])),
        F.when(chars > max_chars, F.format_string(
            f"Total text length %d exceeds max {max_chars}", chars)),
        F.when(stats["n_spoken"] == 0, F.lit("Request contains no user/system content")),
        F.when(stats["n_nul"] > 0, F.lit("Input contains null bytes")),
        F.when(bad_model, F.lit("Invalid or missing model field")),
    ])
    warnings = compact([
        F.when((chars > 0) & (share > max_special), F.concat(
            F.lit("High special character ratio: "), pct(share, 2),
            F.lit(f" (threshold {max_special:.0%})"))),
        F.when(stats["n_control"] > 0, F.format_string(
            "Input contains %d control characters", stats["n_control"])),
    ])
    return let(errors, lambda e: F.struct((F.size(e) == 0).alias("is_valid"), e.alias("errors"),
                                          warnings.alias("warnings")))


def provider(model: Column, override: Column | None = None,
             default: str = C.DEFAULT_PROVIDER) -> Column:
    """Explicit override, else the first model-name prefix that fits, else the default."""
    low = F.lower(model)
    by_prefix = F.coalesce(*[F.when(low.startswith(p), F.lit(name))
                             for p, name in C.PROVIDER_PREFIXES], F.lit(default))
    if override is None:
        return by_prefix
    return F.when(F.coalesce(override, F.lit("")) != "", F.lower(override)).otherwise(by_prefix)
