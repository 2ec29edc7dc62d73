"""Policy documents and guardrail rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType

from guardlake import catalog as C
from guardlake.functions.common import let, max_or
from guardlake.operators.skew import lookup

RULE = ("struct<rule_id:string,regulation:string,category:string,description:string,"
        "trigger_condition:string,severity:string>")
GUARDRAIL_SCHEMA = ("name string, action string, confidence double, categories array<string>, "
                    "channels array<string>, mode string, enabled boolean")


# ---------------------------------------------------------------- policy documents


def paragraph_chunks(text: Column, max_chars: int = C.POLICY_CHUNK_CHARS) -> Column:
    """Array of chunks: paragraphs packed in order up to `max_chars` (separators not
    counted); a longer paragraph stands alone.

    One fold over paragraph lengths finds where chunks start; only those positions are
    accumulated, so the cost is linear in the text.
    """
    def starts(sizes: Column) -> Column:
        zero = F.struct(F.lit(0).cast("long").alias("used"), F.lit(0).alias("i"),
                        F.array(F.lit(0)).alias("at"))

        def step(s: Column, n: Column) -> Column:
            full = (s["used"] + n > max_chars) & (s["i"] > 0)
            return F.struct(
                F.when(full, n.cast("long")).otherwise(s["used"] + n).alias("used"),
                (s["i"] + 1).alias("i"),
                F.when(full, F.array_append(s["at"], s["i"])).otherwise(s["at"]).alias("at"))

        return F.aggregate(sizes, zero, step, lambda s: s["at"])

    def cut(paras: Column) -> Column:
        return let(starts(F.transform(paras, F.length)), lambda at: F.transform(
            at, lambda a, k: F.array_join(F.slice(paras, a + 1, F.coalesce(
                F.get(at, k + 1), F.size(paras)) - a), "\n\n")))

    return let(F.split(text, "\n\n"), cut)


def chunk_documents(docs: DataFrame, key: str, text: str = "text",
                    max_chars: int = C.POLICY_CHUNK_CHARS) -> DataFrame:
    """(key, chunk, content), chunks numbered from 0."""
    return docs.select(key, F.posexplode(paragraph_chunks(F.col(text), max_chars))
                       .alias("chunk", "content"))


def parse_rules(outputs: DataFrame) -> DataFrame:
    """Rules from extraction outputs (source_document, chunk, content).

    The JSON array is what lies between the first '[' and the last ']'; outputs without one
    give no rows.
    """
    body = F.regexp_extract("content", r"(?s)\[.*\]", 0)
    rules = F.from_json(F.when(body != "", body), f"array<{RULE}>")
    return outputs.select("source_document", "chunk", F.posexplode(rules).alias("pos", "r")
                          ).select("source_document", "chunk", "pos", "r.*")


def first_rules(rules: DataFrame) -> DataFrame:
    """One rule per source and rule_id, the first in (chunk, pos) order.

    A minimum combines map-side, so an id that is repeated everywhere is no hot spot.
    """
    cols = [c for c in rules.columns if c != "source_document"]
    pick = F.min_by(F.struct(*cols), F.struct("chunk", "pos"))
    return (rules.withColumn("__id", F.coalesce("rule_id", F.lit("")))
            .groupBy("source_document", "__id").agg(pick.alias("r"))
            .select("source_document", "r.*"))


def rule_guardrails(rules: DataFrame) -> DataFrame:
    """Guardrail rows (with a YAML text column) from policy rules."""
    severity = F.lower(F.coalesce("severity", F.lit("MEDIUM")))
    confidence = reduce(lambda rest, kv: F.when(severity == kv[0], kv[1]).otherwise(rest),
                        C.SEVERITY_CONFIDENCE.items(), F.lit(C.SEVERITY_DEFAULT_CONFIDENCE))
    df = rules.select(
        F.col("rule_id").alias("name"), "description",
        F.coalesce("regulation", F.lit("UNKNOWN")).alias("regulation"),
        F.coalesce("category", F.lit("General")).alias("category"),
        F.when(severity.isin(*C.BLOCKING_SEVERITIES), "block").otherwise("log").alias("action"),
        confidence.alias("confidence"), severity.alias("severity"))
    yaml = F.concat_ws(
        "\n", F.concat(F.lit("  - name: "), F.col("name")),
        F.concat(F.lit('    description: "'), F.col("description"), F.lit('"')),
        F.concat(F.lit("    regulation: "), F.col("regulation")),
        F.concat(F.lit('    category: "'), F.col("category"), F.lit('"')),
        F.concat(F.lit("    action: "), F.col("action")),
        F.concat(F.lit("    confidence: "), F.col("confidence").cast("string")),
        F.concat(F.lit("    severity: "), F.col("severity")))
    return df.withColumn("yaml", yaml)


# ---------------------------------------------------------------- guardrails


def guardrail_table(spark: SparkSession, rules=C.GUARDRAILS) -> DataFrame:
    return spark.createDataFrame(
        [(r.name, r.action, r.confidence, list(r.categories), list(r.channels), r.mode,
          r.enabled) for r in rules], GUARDRAIL_SCHEMA)


def applicable(rules: DataFrame, channel: str | None = None) -> DataFrame:
    fits = F.lit(True) if not channel else (
        (F.size("channels") == 0) | F.array_contains("channels", channel))
    return rules.filter(F.col("enabled") & fits)


def rule_named(rules: DataFrame, name: str) -> DataFrame:
    return rules.filter(F.col("name") == name)


def _apply_rule_table(detections: DataFrame, rules: DataFrame) -> DataFrame:
    """Rules are matched with the distinct (category, confidence) of the detections, of which
    there are few, and the outcome is looked up by each detection."""
    rank = F.array_position(F.array(*[F.lit(a) for a in C.ACTIONS]), F.col("action"))
    none = F.size("categories") == 0
    listed = rules.select(
        rank.alias("__rank"), F.col("name").alias("__name"), F.col("confidence").alias("__least"),
        F.explode(F.when(none, F.array(F.lit(None).cast("string")))
                  .otherwise(F.array_distinct("categories"))).alias("__of"))
    kinds = detections.select("category", "confidence").distinct()
    asked = kinds.select("category", "confidence", F.explode(F.array_distinct(F.array(
        F.col("category"), F.lit(None).cast("string")))).alias("__as"))
    found = (asked.join(listed, F.col("__as").eqNullSafe(F.col("__of")))
             .filter(F.col("confidence") >= F.col("__least"))
             .groupBy("category", "confidence")
             .agg(F.max("__rank").alias("__rank"),
                  F.array_sort(F.collect_list("__name")).alias("__names"))
             .select(F.col("category").alias("__c"), F.col("confidence").alias("__k"), "__rank",
                     "__names"))
    actions = F.array(*[F.lit(a) for a in C.ACTIONS])
    same = F.col("category").eqNullSafe(F.col("__c")) & (F.col("confidence") == F.col("__k"))
    return (detections.join(found, same, "left")
            .withColumn("action", F.element_at(actions, F.coalesce("__rank", F.lit(1)).cast("int")))
            .withColumn("guardrails", F.coalesce("__names", F.array().cast("array<string>")))
            .drop("__c", "__k", "__rank", "__names"))


CONFIDENCE_SLOTS = 1024


def _slot(confidence: Column) -> Column:
    """A number that does not decrease with the confidence; NaN is above all."""
    within = F.greatest(F.lit(0.0), F.least(F.lit(1.0), confidence)) * CONFIDENCE_SLOTS
    return F.when(F.isnan(confidence), CONFIDENCE_SLOTS + 1).otherwise(F.floor(within).cast("int"))


def guardrail_steps(rules: DataFrame, asked: DataFrame) -> DataFrame:
    """(kind, confidence, rank, n): strongest action and number of the `rules` (kind, least,
    rank, n) whose least confidence is at or below each asked (kind, confidence).

    A kind's rules are a step function of confidence, looked up by one union and running
    windows, so rules and confidences never meet in pairs.  Windows run within 1/1024 of the
    confidences of a kind; what lies below comes as one row for each, so a kind that owns all
    rules is worked on by many tasks.
    """
    steps = (rules.filter("least is not null").groupBy("kind", F.col("least").alias("confidence"))
             .agg(F.max("rank").alias("rank"), F.sum("n").alias("n"))
             .withColumn("slot", _slot(F.col("confidence"))))
    below = Window.partitionBy("kind").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    heads = (asked.select("kind", _slot(F.col("confidence")).alias("slot")).distinct()
             .withColumn("n", F.lit(0).cast("long")).withColumn("rank", F.lit(None).cast("int"))
             .unionByName(steps.select("kind", "slot", "n", "rank"))
             .groupBy("kind", "slot").agg(F.max("rank").alias("rank"), F.sum("n").alias("n"))
             .select("kind", "slot", F.max("rank").over(below).alias("rank"),
                     F.sum("n").over(below).alias("n")))
    rows = (steps.withColumn("place", F.lit(1))
            .unionByName(heads.withColumn("place", F.lit(0)), allowMissingColumns=True)
            .unionByName(asked.withColumn("slot", _slot(F.col("confidence")))
                         .withColumn("place", F.lit(2)), allowMissingColumns=True))
    along = (Window.partitionBy("kind", "slot")
             .orderBy(F.col("place") > 0, "confidence", "place")
             .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (rows.select("kind", "confidence", "place", F.max("rank").over(along).alias("rank"),
                        F.sum("n").over(along).alias("n"))
            .filter("place = 2").drop("place"))


def guardrail_actions(detections: DataFrame, rules: DataFrame,
                      channel: str | None = None) -> DataFrame:
    """Add `action` (strongest of the matching rules of a table) and `n_guardrails` (how many
    match).

    For large tables of rules: names, which would be as many as the pairs of detections and
    rules, are not listed (`apply_guardrails` does).  Detections without a confidence match
    nothing; those without a category match the rules for any.
    """
    def kind(category: Column) -> Column:
        return F.coalesce(F.concat(F.lit("="), category), F.lit("*"))

    rank = F.array_position(F.array(*[F.lit(a) for a in C.ACTIONS]), F.col("action"))
    named = F.transform(F.array_distinct("categories"), kind)
    active = applicable(rules, channel).select(
        F.explode(F.when(F.size("categories") == 0, F.array(F.lit("*"))).otherwise(named))
        .alias("kind"), F.col("confidence").cast("double").alias("least"),
        rank.cast("int").alias("rank"), F.lit(1).cast("long").alias("n"))
    # -0.0 and 0.0 are one confidence.
    of, at = "__of", "__at"
    found = detections.withColumn(of, kind(F.col("category"))).withColumn(
        at, F.col("confidence").cast("double") + F.lit(0.0))
    pairs = found.filter(F.col(at).isNotNull()).select(of, at).distinct()
    asked = pairs.select(of, F.explode(F.array_distinct(F.array(F.col(of), F.lit("*"))))
                         .alias("kind"), F.col(at).alias("confidence"))
    met = guardrail_steps(active, asked.select("kind", "confidence").distinct())
    totals = (asked.join(met, ["kind", "confidence"]).groupBy(of, F.col("confidence").alias(at))
              .agg(F.max("rank").alias("__rank"), F.sum("n").alias("__n")))
    rows = [f.name for f in detections.schema.fields if isinstance(f.dataType, AtomicType)]
    actions = F.array(*[F.lit(a) for a in C.ACTIONS])
    return (lookup(found, totals, [of, at], rows, "left")
            .withColumn("action", F.element_at(actions, F.coalesce("__rank", F.lit(1))))
            .withColumn("n_guardrails", F.coalesce("__n", F.lit(0)).cast("long"))
            .drop(of, at, "__rank", "__n"))


def apply_guardrails(detections: DataFrame, rules=C.GUARDRAILS,
                     channel: str | None = None) -> DataFrame:
    """Add `action` (strongest of the matching rules) and `guardrails` (their names).

    A rule matches on category (none listed: any) and minimum confidence.  Rules given as values
    are configuration: they become an array literal and matching is a projection.  Rules given as
    a table (`read_guardrails`) are joined, whatever their number; names come sorted then.
    """
    if isinstance(rules, DataFrame):
        return _apply_rule_table(detections, applicable(rules, channel))
    active = [r for r in rules if r.enabled
              and (not channel or not r.channels or channel in r.channels)]
    checks = []
    for r in active:
        fits = F.lit(True) if not r.categories else F.col("category").isin(*r.categories)
        checks.append(F.when(fits & (F.col("confidence") >= r.confidence), F.struct(
            F.lit(C.ACTIONS.index(r.action)).alias("rank"), F.lit(r.name).alias("name"))))
    empty = F.array().cast("array<struct<rank:int,name:string>>")
    found = F.array_compact(F.array(*checks)) if checks else empty
    actions = F.array(*[F.lit(a) for a in C.ACTIONS])
    return (detections.withColumn("__m", found)
            .withColumn("action", F.element_at(actions, max_or(
                F.col("__m"), lambda m: m["rank"], 0) + 1))
            .withColumn("guardrails", F.transform("__m", lambda m: m["name"])).drop("__m"))
