"""Readers for requests, chunks, response streams, SSE transcripts and provider responses."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PART = "struct<type:string,text:string>"
MESSAGE = (f"struct<role:string,text:string,parts:array<{PART}>,name:string,"
           "tool_call_id:string>")
REQUEST = f"request_id string, model string, messages array<{MESSAGE}>"
CHUNK = ("batch_id string, pos int, chunk_id string, content string, "
         "metadata map<string,string>, source string, score double")
RESPONSE_CHUNK = "stream_id string, seq long, delta string, done boolean, ts timestamp"
GUARDRAIL = ("name string, action string, confidence double, categories array<string>, "
             "channels array<string>, mode string, enabled boolean")
# Requests as they come over the wire: `content` is a string or an array of parts.
_WIRE = ("request_id string, model string, "
         "messages array<struct<role:string,content:variant,name:string,tool_call_id:string>>")
_PROVIDER = ("struct<choices:array<struct<index:int,message:struct<content:string>>>,"
             "usage:struct<prompt_tokens:int,completion_tokens:int>>")


def read_requests(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Requests with nested messages; the schema is given, never inferred."""
    return spark.read.format(fmt).schema(REQUEST).load(path)


def read_wire_requests(spark: SparkSession, path: str) -> DataFrame:
    """JSON-lines requests whose `content` is a string or a list of typed parts."""
    return parse_wire(wire_lines(spark.read.text(path), "value"))


def wire_lines(lines: DataFrame, line: str = "line") -> DataFrame:
    """Requests of JSON lines, each `content` as the JSON value that it is."""
    return lines.select(F.from_json(line, _WIRE).alias("r")).select("r.*")


def parse_wire(raw: DataFrame) -> DataFrame:
    """Split wire `content` into text or parts by its JSON type: a string stays text whatever it
    holds."""
    def message(m):
        value = m["content"]
        listed = F.schema_of_variant(value).startswith("ARRAY")
        text = F.try_variant_get(value, "$", "string")
        parts = F.try_variant_get(value, "$", f"array<{PART}>")
        return F.struct(m["role"].alias("role"), F.when(~listed, text).alias("text"),
                        F.when(listed, parts).alias("parts"), m["name"].alias("name"),
                        m["tool_call_id"].alias("tool_call_id"))

    return raw.withColumn("messages", F.transform("messages", message))


def read_chunks(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.format(fmt).schema(CHUNK).load(path)


def stream_responses(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """Response chunks as a stream of parquet files."""
    return (spark.readStream.schema(RESPONSE_CHUNK)
            .option("maxFilesPerTrigger", files_per_trigger).parquet(path))


def read_guardrails(spark: SparkSession, path: str | None = None) -> DataFrame:
    """Guardrail rules from JSON lines; the defaults if there are none."""
    from guardlake.operators.policy import guardrail_table

    default = guardrail_table(spark)
    if path is None:
        return default
    rules = spark.read.schema(GUARDRAIL).json(path)
    rules = rules.select("name", F.coalesce("action", F.lit("block")).alias("action"),
                         F.coalesce("confidence", F.lit(0.7)).alias("confidence"),
                         *[F.coalesce(c, F.array().cast("array<string>")).alias(c)
                           for c in ("categories", "channels")],
                         "mode", F.coalesce("enabled", F.lit(True)).alias("enabled"))
    # Rules are configuration: whether there are any is known before the plan is built.
    return default if rules.isEmpty() else rules


def parse_sse(lines: DataFrame) -> DataFrame:
    """Add `kind` (data, done or pass), `payload` and `content` to SSE lines.

    Lines without the data prefix, and payloads that are not JSON, pass through.
    """
    line = F.col("line")
    # Before some line ends `$` matches, too; elsewhere the ends can be cut without a regex.
    ends = reduce(lambda a, b: a | b, (line.endswith(c) for c in "\u0085\u2028\u2029"))
    rest = F.when(ends, F.regexp_replace("line", r"^data: |\s+$", "")).otherwise(
        F.rtrim(F.expr("substring(line, 7)"), F.lit(" \t\n\x0b\f\r")))
    # Each step is a column, so that a payload is cut and parsed once for all that asks for it.
    names = list(lines.columns)
    df = lines.withColumn("payload", F.when(line.startswith("data: "), F.trim(rest)))
    df = df.withColumn("__json", F.try_parse_json("payload"))
    path = "$.choices[0].delta.content"
    df = df.withColumn("__value", F.try_variant_get("__json", path, "variant"))
    # Strings are taken from what is parsed already, unless halves of characters may stand alone.
    half = F.col("payload").contains("\\ud") | F.col("payload").contains("\\uD")
    plain = (F.schema_of_variant("__value") == "STRING") & ~half
    content = F.when(plain, F.try_variant_get("__value", "$", "string")).otherwise(
        F.get_json_object("payload", path))
    df = (df.withColumn("kind", F.when(F.col("payload").isNull(), "pass")
                        .when(F.col("payload") == "[DONE]", "done")
                        .when(F.col("__json").isNull(), "pass").otherwise("data"))
          .withColumn("content", F.when(F.col("kind") == "data",
                                        F.coalesce(content, F.lit("")))))
    return df.select(*[c for c in names if c not in ("payload", "kind", "content")],
                     "payload", "kind", "content")


def parse_responses(raw: DataFrame, body: str = "body") -> DataFrame:
    """Add `choices` (array<struct<index, content>>) and token counts of provider bodies."""
    df = raw.withColumn("__r", F.from_json(body, _PROVIDER))
    r = F.col("__r")
    return (df.withColumn("choices", F.transform(
                F.coalesce(r["choices"], F.array().cast(
                    "array<struct<index:int,message:struct<content:string>>>")),
                lambda c, i: F.struct(F.coalesce(c["index"], i).alias("index"),
                                      c["message"]["content"].alias("content"))))
            .withColumn("prompt_tokens", F.coalesce(r["usage"]["prompt_tokens"], F.lit(0)))
            .withColumn("completion_tokens",
                        F.coalesce(r["usage"]["completion_tokens"], F.lit(0))).drop("__r"))

