"""Screening of retrieved chunks: (batch_id, pos, chunk_id, content, metadata, source, score)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from guardlake import catalog as C
from guardlake.functions import messages as M
from guardlake.functions import patterns as P
from guardlake.functions import redact as R
from guardlake.functions import verdict as V
from guardlake.functions.common import fenced
from guardlake.functions.decode import with_decoded
from guardlake.operators.skew import lookup
from guardlake.operators.verdict import conclude
from guardlake.session import stored

FIRST_ROUND = 8
CHUNK_COLUMNS = ("batch_id", "pos", "chunk_id", "content", "metadata", "source", "score")


def accepted_batches(chunks: DataFrame, max_chunks: int = C.MAX_BATCH_CHUNKS) -> DataFrame:
    """(batch_id, n_chunks, accepted): batches of 1 to `max_chunks` chunks are accepted."""
    return (chunks.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n_chunks"))
            .withColumn("accepted", F.col("n_chunks") <= max_chunks))


def truncate_chunks(chunks: DataFrame, max_chars: int = C.MAX_CHUNK_CHARS) -> DataFrame:
    """Contents cut to `max_chars`, with a flag where that removed something."""
    return (chunks.withColumn("truncated", F.length("content") > max_chars)
            .withColumn("content", F.substring("content", 1, max_chars)))


def scan_chunks(chunks: DataFrame, *, detailed: bool = False, max_chars: int | None = None,
                redact_blocked: bool = True, redact_sanitized: bool = False,
                semantic: bool = False, decode: bool = True, leet: str = "parity", catalog: P.Catalog = P.DEFAULT,
                rules: R.Rules = R.DEFAULT) -> DataFrame:
    """Add status, confidence, threats and sanitized_content to every chunk.

    Patterns are matched on the raw content.  With `detailed`, and always where patterns
    hit, the decoded content also passes the request analysis, which contributes threats of
    categories not seen yet.  The decoder runs a second time only on content that did not
    converge the first time; without `decode` it does not run at all.
    """
    df = chunks.withColumn("__raw", F.col("content") if max_chars is None else
                           F.substring("content", 1, max_chars))
    plain = F.struct(F.col("__raw").alias("decoded"), F.lit(0).alias("layers"),
                     F.array().cast("array<string>").alias("encodings"))
    df = (with_decoded(df, "__raw", "__first", leet=leet) if decode
          else df.withColumn("__first", plain))
    df = df.withColumn("__scan", P.scan(F.col("__raw"), catalog))
    first = F.col("__first")
    df = df.withColumn("__body", F.when(first["layers"] > 0, first["decoded"])
                       .otherwise(F.col("__raw")))
    own = F.concat(V.pattern_threats(F.col("__scan")),
                   V.obfuscation_threat(first, "encoded_content_in_chunk", with_names=False))
    df = fenced(df.withColumn("__own", own), "__own", "__scan")
    deep = F.lit(True) if detailed else F.size("__scan") > 0
    df = df.withColumn("__deep", deep)
    # The decoded chunk as a request of one user message.
    stuck = first["layers"] >= C.MAX_DECODE_DEPTH
    df = (with_decoded(df, F.when(F.col("__deep") & stuck, F.col("__body")), "__again",
                       leet=leet) if decode else df.withColumn("__again", plain))
    message = F.struct(F.lit("user").alias("role"), F.col("__body").alias("text"),
                       F.lit(None).cast("array<struct<type:string,text:string>>").alias("parts"),
                       F.lit(None).cast("string").alias("name"))
    df = df.withColumn("__valid", F.when(F.col("__deep"), M.validation(
        M.request_stats(F.array(message)), F.lit("rag-scan"))))
    pair = "array<struct<source:string,content:string>>"
    df = (df.withColumn("__deob", F.when(F.col("__deep"), F.when(stuck, F.col("__again")).otherwise(
            F.struct(F.col("__body").alias("decoded"), F.lit(0).alias("layers"),
                     F.array().cast("array<string>").alias("encodings")))))
          .withColumn("__contents", F.when(
              F.col("__deep") & ~M.is_blank(F.col("__body")), F.array(F.struct(
                  F.lit("msg[0]:user").alias("source"), F.col("__body").alias("content"))))
              .otherwise(F.array().cast(pair))))
    df = conclude(df, valid=F.coalesce(F.col("__valid")["is_valid"], F.lit(True)),
                  errors=F.col("__valid")["errors"], catalog=catalog,
                  semantic="keywords" if semantic else None)
    known = F.transform("__own", lambda t: t["category"])
    extra = F.filter("threats", lambda t: ~F.array_contains(known, t["category"]))
    df = df.withColumn("__all", F.concat(F.col("__own"), F.when(
        F.col("__deep"), F.transform(extra, lambda t: V.threat(
            t["category"], t["name"], t["threat_level"], t["confidence"], t["details"])))
        .otherwise(V.no_threats())))
    serious = V.top_rank(F.col("__all")) >= 3
    df = (df.withColumn("status", F.when(serious, "blocked")
                        .when(F.size("__all") > 0, "sanitized").otherwise("allowed"))
          .withColumn("confidence", F.greatest(P.max_confidence(F.col("__scan")), F.when(
              F.col("__deep"), F.col("confidence")).otherwise(0.0))))
    wanted = F.lit(False)
    if redact_blocked:
        wanted = wanted | (F.col("status") == "blocked")
    if redact_sanitized:
        wanted = wanted | (F.col("status") == "sanitized")
    df = df.withColumn("__clean", F.when(wanted, R.redacted(F.col("__body"), rules)))
    keep = [c for c in CHUNK_COLUMNS if c in chunks.columns]
    done = df.select(*keep, "status", "confidence", F.col("__all").alias("threats"),
                     F.when(F.col("__clean") != F.col("__body"), F.col("__clean"))
                     .alias("sanitized_content"))
    return fenced(done, "status", "confidence", "threats", "sanitized_content")


def quick_scan(texts: DataFrame, key: str, text: str = "text", **options) -> DataFrame:
    """Scan single texts without batch data."""
    chunks = texts.select(F.col(key).alias("chunk_id"), F.col(text).alias("content"))
    return scan_chunks(chunks, detailed=False, **options).withColumn(
        "safe", F.col("status") == "allowed").drop("content")


def _stops(scanned: DataFrame) -> DataFrame:
    return (scanned.filter("status = 'blocked'").groupBy("batch_id")
            .agg(F.min("pos").alias("__stop")))


def scan_until_blocked(chunks: DataFrame, *, first: int = FIRST_ROUND,
                       scanned: list[int] | None = None, **options) -> DataFrame:
    """Scan each batch up to and including its first blocked chunk, and little beyond it.

    Rounds take positions below `first`, then below twice as many, and so on; batches that are
    blocked leave before a round, so no batch has more than about twice as many positions
    scanned as it needed.  Chunks without a position are in the last round.  Rounds are stored, with the
    number of chunks of each added to `scanned`; `chunks` is read once per round, and rounds
    grow with the logarithm of the largest position.  `options` are those of `scan_chunks`.
    """
    pos, last, high = F.col("pos"), chunks.agg(F.max("pos")).head()[0], first
    rounds = [pos < first]
    while last is not None and high <= last:
        rounds.append((pos >= high) & (pos < 2 * high))
        high *= 2
    rounds[-1] = rounds[-1] | pos.isNull()
    done = None
    for span in rounds:
        open_chunks = chunks.filter(span)
        if done is not None:
            open_chunks = lookup(open_chunks, _stops(done), ["batch_id"], ["pos", "chunk_id"],
                                 "left_anti")
        part = stored(scan_chunks(open_chunks, **options), "scanned")
        if scanned is not None:
            scanned.append(part.count())
        done = part if done is None else done.unionByName(part)
    return fail_fast(done)


def fail_fast(scanned: DataFrame) -> DataFrame:
    """Keep each batch up to and including its first blocked chunk.

    The position comes from a map-side combined minimum, so a large batch is not gathered.
    `scanned` is read twice: pass a stored table (`session.stored`), not a pending scan.
    """
    stops = _stops(scanned)
    joined = lookup(scanned, stops, ["batch_id"], ["pos"], "left")
    return joined.filter(F.col("__stop").isNull() | (F.col("pos") <= F.col("__stop"))
                         ).drop("__stop")


def batch_summary(scanned: DataFrame) -> DataFrame:
    blocked = F.count_if(F.col("status") == "blocked")
    return scanned.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("chunks_scanned"),
        F.count_if(F.col("status") == "allowed").alias("chunks_safe"),
        blocked.alias("chunks_blocked"),
        F.count_if(F.col("status") == "sanitized").alias("chunks_sanitized"),
        (blocked == 0).alias("safe_to_proceed"))


def safe_chunks(scanned: DataFrame) -> DataFrame:
    """Chunks that may be used: allowed ones as they are, sanitized ones with their replacement
    text if they have one.  Scanned chunks carry their content, so nothing is joined."""
    usable = (F.col("status") == "allowed") | (
        (F.col("status") == "sanitized") & (F.coalesce("sanitized_content", F.lit("")) != ""))
    keep = [c for c in CHUNK_COLUMNS if c in scanned.columns]
    return (scanned.filter(usable)
            .withColumn("content", F.when(F.col("status") == "sanitized",
                                          F.col("sanitized_content"))
                        .otherwise(F.col("content")))
            .select(*keep))
