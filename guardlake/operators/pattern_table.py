"""Scans for patterns that are a table: a theta join without comparing every text with every pattern.

Each pattern's syntax tree gives what every match holds: two words that follow each other, or else one
of some strings, known by a gram of each.  That is the index: texts meet patterns by an equi-join on
the pairs of words and grams they hold, which carries keys only.  What has met is confirmed on the
text, first by all strings it needs, then by the regex.  The work follows the words of the texts and
the candidates, not the number of patterns.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from guardlake.functions.common import ICASE_DOTALL, let, sql_text
from guardlake.functions.patterns import MATCHED_TEXT_CHARS, confidence, folded
from guardlake.functions.regex import joints, required_sets
from guardlake.operators.skew import lookup
from guardlake.session import stored

GRAM_CHARS, JOINT_LETTERS = 4, 5
PATTERN = ("category", "name", "regex", "threat_level")


def with_literals(patterns: DataFrame) -> DataFrame:
    """(category, name, regex, threat_level, needs, literals, joints).

    `needs` are sets of strings of which a match holds one each.  `joints` are pairs of words of which
    a match holds one; patterns without have the first of the sets as literals.  An empty literal
    stands for patterns for which nothing is known: these meet every text.
    """
    @F.pandas_udf("array<array<string>>")
    def needs(regexes: pd.Series) -> pd.Series:
        return regexes.map(required_sets)

    @F.pandas_udf("array<struct<before:string,skipped:int,after:string>>")
    def pairs(regexes: pd.Series) -> pd.Series:
        return regexes.map(lambda x: [dict(zip(("before", "skipped", "after"), j))
                                      for j in joints(x, GRAM_CHARS, JOINT_LETTERS)])

    each = patterns.where("regex is not null").select(*PATTERN).distinct()
    return each.withColumn("needs", needs("regex")).withColumn("joints", pairs("regex")).withColumn(
        "literals", F.when(F.size("joints") > 0, F.array().cast("array<string>")).otherwise(
            F.coalesce(F.get("needs", F.lit(0)), F.array(F.lit("")))))


def _joined(skipped: Column, before: Column, after: Column) -> Column:
    """The gram of two words, or what is known of them."""
    return F.concat(before, F.when(skipped == 0, " ").otherwise(" * "), after)


def pattern_index(known: DataFrame) -> DataFrame:
    """(skipped, left, right, gram, before, after, ids): how texts meet patterns.

    A gram of two words is the last `left` letters of one and the first `right` of the next; the
    words end with `before` and start with `after`.  Grams of literals have `skipped` -1 and the
    length `left`.
    """
    words = known.select("id", F.inline("joints")).withColumn(
        "left", F.least(F.length("before"), F.lit(GRAM_CHARS))).withColumn(
        "right", F.least(F.length("after"), F.lit(GRAM_CHARS))).withColumn("gram", _joined(
            F.col("skipped"), F.expr("right(before, left)"), F.expr("left(after, right)")))
    grams = known.select("id", F.explode("literals").alias("literal")).select(
        "id", F.lit("").alias("before"), F.lit(-1).alias("skipped"), F.lit("").alias("after"),
        F.left("literal", F.lit(GRAM_CHARS)).alias("gram")).withColumn(
        "left", F.length("gram")).withColumn("right", F.lit(0))
    return words.unionByName(grams).groupBy("skipped", "left", "right", "gram", "before", "after").agg(
        F.collect_set("id").alias("ids"))


def text_grams(rows: DataFrame, keys: list[str], shapes: list[tuple[int, int, int]]) -> DataFrame:
    """(keys, __gram, __a, __b) of folded texts `__low`: grams of the shapes (skipped, left, right), with
    the two words if it is one of words."""
    kind = "array<struct<s:int,a:string,b:string>>"

    def found(skipped: int, a: Column, b: Column) -> Column:
        return F.struct(F.lit(skipped).alias("s"), a.alias("a"), b.alias("b"))

    def words(w: Column, skipped: int) -> Column:
        n = F.greatest(F.size(w) - 1 - skipped, F.lit(0))
        return F.zip_with(F.slice(w, 1, n), F.slice(w, 2 + skipped, n), lambda a, b: found(skipped, a, b))

    def grams(n: int) -> Column:
        all_ = (F.regexp_extract_all("__low", F.lit(f"(?s)(?=(.{{{n}}}))"), 1) if n
                else F.array(F.lit("")))
        return F.transform(F.array_distinct(all_), lambda g: found(-1, g, F.lit("")))

    parts = [grams(left) for skipped, left, _ in shapes if skipped < 0]
    apart = sorted({skipped for skipped, _, _ in shapes if skipped >= 0})
    if apart:
        parts.append(let(F.split("__low", "[^a-z]+"), lambda w: F.concat(*(words(w, s) for s in apart))))
    each = rows.select(*keys, F.inline(F.concat(F.array().cast(kind), *parts)).alias("__s", "__a", "__b"))
    is_word = F.col("__s") >= 0
    # Mostly one shape of each kind: its grams need no further row.
    of = [F.when(F.col("__s") == s, _joined(F.lit(s), F.right("__a", F.lit(left)),
                                            F.left("__b", F.lit(right))))
          for s, left, right in shapes if s >= 0]
    alone = len({s for s, _, _ in shapes if s >= 0}) == len(of)
    gram = F.coalesce(*of, "__a") if alone else F.explode(
        F.when(is_word, F.array_compact(F.array(*of))).otherwise(F.array("__a")))
    return each.select(*keys, gram.alias("__gram"), F.when(is_word, F.col("__a")).otherwise("").alias("__a"),
                       F.when(is_word, F.col("__b")).otherwise("").alias("__b"))


def candidates(rows: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, __id) of texts, folded in `__low`, and patterns that may match: all that do, and some."""
    index = pattern_index(known.withColumnRenamed("__id", "id"))
    # At most GRAM_CHARS + 1 lengths of literals and twice GRAM_CHARS squared shapes of two words.
    shapes = sorted(tuple(r) for r in index.select("skipped", "left", "right").distinct().collect())
    index = index.select(*(F.col(c).alias(f"__{c}") for c in ("gram", "before", "after", "ids")))
    met = lookup(text_grams(rows, keys, shapes), index, ["__gram"], keys).where(
        F.endswith("__a", "__before") & F.startswith("__b", "__after"))
    return met.select(*keys, F.explode("__ids").alias("__id")).distinct()


def pattern_table_hits(texts: DataFrame, patterns: DataFrame, keys: list[str],
                       text: str = "text") -> DataFrame:
    """(keys, category, name, threat_level, confidence, n_matches, matched_text) per hit.

    `keys` name a row of `texts`; `patterns` has (category, name, regex, threat_level).  Rows give
    what `scan.pattern_hits` gives with these patterns as its catalog.  Patterns that repeat count
    once.  Null texts and null regexes match nothing; empty tables give no rows.  Rows whose keys
    are null are left out.
    """
    spark = texts.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")),
                spark.sparkContext.defaultParallelism)
    # Read three times, and parsing is slow: a table, made by all cores.
    known = stored(with_literals(patterns.repartition(parts, *PATTERN)).withColumn(
        "__id", F.xxhash64(*PATTERN)), "pattern-literals")
    rows = texts.select(*keys, F.col(text).alias("__t")).where("__t is not null").dropna(subset=keys)
    rows = rows.withColumn("__low", folded(F.col("__t")))
    pairs = candidates(rows, known, keys)
    found = lookup(pairs, known.select("__id", F.struct(*PATTERN, "needs").alias("__p")), ["__id"],
                   keys).groupBy(*keys).agg(F.collect_list("__p").alias("__p"))
    # A given number of partitions: regexes cost much more than the bytes they are dealt by tell.
    sure = rows.repartition(parts, *keys).join(found, keys).withColumn("__p", F.filter("__p", lambda p: F.forall(
        p["needs"], lambda one: F.exists(one, lambda x: F.col("__low").contains(x)))))
    prefix = sql_text(ICASE_DOTALL)
    counted = (f"filter(transform(__p, p -> named_struct('p', p, 'n', "
               f"regexp_count(__t, concat({prefix}, p.regex)))), c -> c.n > 0)")
    hit = ("named_struct('category', c.p.category, 'name', c.p.name, 'threat_level', "
           f"c.p.threat_level, 'confidence', {confidence('c.n', 'length(__t)')}, 'n_matches', c.n, "
           f"'matched_text', substring(regexp_extract(__t, concat({prefix}, '(', c.p.regex, ')'), "
           f"1), 1, {MATCHED_TEXT_CHARS}))")
    return sure.select(*keys, F.inline(F.expr(f"transform({counted}, c -> {hit})")))
