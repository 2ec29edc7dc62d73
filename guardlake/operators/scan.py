"""Attack-pattern and sensitive-data scans over tables of texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from guardlake.functions import context as X
from guardlake.functions import patterns as P
from guardlake.functions import redact as R
from guardlake.functions.common import fenced


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def with_detections(df: DataFrame, text: Column | str = "text", out: str = "detections",
                    catalog: P.Catalog = P.DEFAULT) -> DataFrame:
    """Add the array of detections of a text column."""
    return fenced(df.withColumn(out, P.scan(_col(text), catalog)), out)


def pattern_hits(df: DataFrame, keys: list[str], text: Column | str = "text",
                 catalog: P.Catalog = P.DEFAULT) -> DataFrame:
    """One row per (text, pattern that matches it)."""
    return df.select(*keys, F.inline(P.scan(_col(text), catalog)))


def pattern_summary(df: DataFrame, keys: list[str], text: Column | str = "text",
                    catalog: P.Catalog = P.DEFAULT) -> DataFrame:
    """Per text: whether anything matched, highest confidence and highest level."""
    hits = F.col("__hits")
    return (df.select(*keys, P.scan(_col(text), catalog).alias("__hits"))
            .select(*keys, (F.size(hits) > 0).alias("is_malicious"),
                    P.max_confidence(hits).alias("confidence"),
                    P.max_level(hits).alias("threat_level"), F.size(hits).alias("n_patterns")))


def catalog_counts(spark: SparkSession, catalog: P.Catalog = P.DEFAULT) -> DataFrame:
    """Patterns per category, with the size of the whole catalog on every row."""
    per = catalog.table(spark).groupBy("category").agg(F.count(F.lit(1)).alias("n_patterns"))
    return per.withColumn("n_catalog", F.lit(len(catalog.patterns)).cast("long"))


def scan_report(df: DataFrame, keys: list[str], text: Column | str = "text",
                catalog: P.Catalog = P.DEFAULT, rules: R.Rules = R.DEFAULT) -> DataFrame:
    """Everything a text triggers, one row per finding: patterns, context, sensitive data.

    A text is its own history here, which is what makes a lone probe a context finding.
    """
    text = _col(text)
    kind = "struct<kind:string,category:string,name:string,level:string,confidence:double,n:int>"

    def finding(what, category, name, level, confidence, n) -> Column:
        return F.struct(F.lit(what).alias("kind"), category.alias("category"),
                        name.alias("name"), level.alias("level"),
                        confidence.cast("double").alias("confidence"), n.cast("int").alias("n"))

    me = X.features(F.lit("user"), text)
    scans = df.select(*keys, P.scan(text, catalog).alias("__p"), me.alias("__me"),
                      R.filtered(text, rules)["detections"].alias("__r"))
    scans = scans.withColumn("__c", X.context(F.col("__me"), F.array(F.col("__me"))))
    found = F.concat(
        F.transform("__p", lambda h: finding("pattern", h["category"], h["name"],
                                             h["threat_level"], h["confidence"], h["n_matches"])),
        F.transform(F.col("__c")["issues"], lambda i: finding(
            "context", F.lit("context"), i, F.lit("medium"), F.col("__c")["confidence"],
            F.lit(1))),
        F.transform("__r", lambda d: finding("sensitive", d["category"], d["rule"],
                                             F.lit(None).cast("string"), F.lit(None), d["n"])))
    return scans.select(*keys, F.inline(found.cast(f"array<{kind}>")))
