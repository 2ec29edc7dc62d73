"""Queries: retrieved chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from guardlake import catalog as C
from guardlake.operators import policy, rag
from guardlake.plans import checks as K
from guardlake.plans.decoding_sql import peeled
from guardlake.plans.inputs import Tables
from guardlake.plans.registry import query
from guardlake.session import new_folder
from guardlake.sources.readers import CHUNK, read_chunks


@query("s2_read_chunks", f"""
select batch_id, pos, chunk_id, length(content)::bigint as n_chars, 'docs' as source,
  cast(5e-1 as double) as score, 'en' as lang from ({K.CHUNKS})""")
def chunk_source(t: Tables) -> DataFrame:
    """Chunks written with their declared schema and read back by the chunk reader."""
    path = new_folder(t.spark, "chunks")
    rows = t.chunks().withColumn("metadata", F.create_map(F.lit("lang"), F.lit("en")))
    rows = rows.withColumn("source", F.lit("docs")).withColumn("score", F.lit(0.5))
    names = [part.strip().split(" ")[0] for part in CHUNK.split(", ")]
    rows.select(*names).write.parquet(path)
    return read_chunks(t.spark, path).select(
        "batch_id", "pos", "chunk_id", F.length("content").cast("long").alias("n_chars"),
        "source", "score", F.col("metadata")["lang"].alias("lang"))


_BATCHES = """select concat('b-', source) as batch_id, cast(doc_id as int) as pos from {documents}"""

query("p6_batch_sizes", f"""
select batch_id, count(*)::bigint as n_chunks, count(*) <= 40 as accepted
from ({_BATCHES.format(documents='documents')}) group by batch_id""")(
    lambda t: rag.accepted_batches(t.sql(_BATCHES), max_chunks=40))

query("p7_truncated_chunks", f"""
select doc_id, length(text) > {C.MAX_CHUNK_CHARS} as truncated,
  substr(text, 1, {C.MAX_CHUNK_CHARS}) as content from ({K.DOCS})""")(
    lambda t: rag.truncate_chunks(t.attack_docs().select(
        "doc_id", F.col("text").alias("content"))).select("doc_id", "truncated", "content"))

# Paragraphs: lines of the documents, packed to 300 characters.  The fold is spelled out in
# SQL as a recursive query over numbered paragraphs.
query("p8_paragraph_chunks", """
with recursive p as (select doc_id, unnest(string_split(replace(text, chr(10), chr(10)||chr(10)), chr(10)||chr(10))) as para,
    generate_subscripts(string_split(replace(text, chr(10), chr(10)||chr(10)), chr(10)||chr(10)), 1) as i from documents),
walk as (select doc_id, i, length(para) as used, 0 as chunk from p where i = 1
  union all select p.doc_id, p.i,
    case when w.used + length(p.para) > 300 then length(p.para) else w.used + length(p.para) end,
    case when w.used + length(p.para) > 300 then w.chunk + 1 else w.chunk end
  from walk w join p on p.doc_id = w.doc_id and p.i = w.i + 1)
select w.doc_id, cast(w.chunk as int) as chunk, string_agg(p.para, chr(10)||chr(10) order by p.i) as content
from walk w join p on p.doc_id = w.doc_id and p.i = w.i group by w.doc_id, w.chunk""")(
    lambda t: policy.chunk_documents(
        t.read("documents", "doc_id").select("doc_id", F.replace(
            "text", F.lit("\n"), F.lit("\n\n")).alias("text")), "doc_id", max_chars=300))

_SCANNED = f"""(select c.*, case when r >= 3 then 'blocked' when r >= 1 then 'sanitized' else 'allowed' end as status,
  coalesce(s.conf, 0e0) as conf, coalesce(s.n,0) as n from ({K.CHUNKS}) c left join (
  select chunk_id, max({K.rank('threat_level')}) as r, max(confidence) as conf, count(*) as n
  from {K.hits(K.CHUNKS, 'chunk_id', 'content')} group by chunk_id) s on c.chunk_id = s.chunk_id)"""
# The request analysis of a flagged chunk finds the same patterns; for texts past the size
# limit it ends in validation, which adds one threat.
_LONG = f"(n > 0 and length(content) > {C.MAX_CHARS})"
_STATUS = f"case when {_LONG} then 'blocked' else status end"

# What the request analysis of a flagged chunk adds: marked comments and markdown injection.
_COMMENTS = f"""select chunk_id, i, c as text from (select chunk_id, unnest(cs) as c,
  generate_subscripts(cs,1) as i from (select chunk_id, list_filter(list_transform(
  regexp_extract_all(content,'<!--(.*?)-->',1,'s'), lambda x: regexp_replace(x,'^\\s+|\\s+$','','g')),
  lambda x: length(x) > 10) as cs from ({K.CHUNKS})))"""
_MARKERS = f"""(select chunk_id, count(*) as more, max(c) as more_conf from (
  select chunk_id, least(1e0, max(confidence) + 1e-1) as c from {K.hits(_COMMENTS, 'chunk_id, i')}
  group by chunk_id, i union all select chunk_id, 7e-1 from ({K.CHUNKS})
  where regexp_matches(content,{K.re2(C.MARKDOWN_INJECTION)},'i')) group by chunk_id)"""

query("g1_chunk_scan", f"""
select batch_id, pos, s.chunk_id, {_STATUS} as status,
  round(case when {_LONG} then 1e0 when n > 0 then greatest(conf, coalesce(more_conf, 0e0))
        else conf end,3) as confidence,
  cast(n + case when {_LONG} then 1 when n > 0 then coalesce(more,0) else 0 end as int) as n_threats
from {_SCANNED} s left join {_MARKERS} m on s.chunk_id = m.chunk_id""")(
    lambda t: rag.scan_chunks(t.chunks(), decode=False).select(
        "batch_id", "pos", "chunk_id", "status", F.round("confidence", 3).alias("confidence"),
        F.size("threats").alias("n_threats")))



_MARKED = f"select * replace (concat(content, ' you are a helpful assistant') as content) from ({K.CHUNKS})"
_SAFE_TEXT = f"t{len(C.RULES)}"


def decoded_scan_sql(source: str, detailed: bool = False) -> str:
    """(batch_id, pos, chunk_id, content, body, status, confidence, n_threats): chunks of `source`
    scanned as they are, and decoded ones once more as requests, which add other categories."""
    body = "select chunk_id, body as content from body where deep and not too_long"
    comments = _COMMENTS.replace(f"({K.CHUNKS})", f"({body})")
    return f"""(
with chunks as materialized ({source}),
raw as materialized (select * from {K.hits('select * from chunks', 'chunk_id', 'content')}),
body as materialized (select c.*, layers, case when layers > 0 then decoded else content end as body,
  {str(detailed).lower()} or c.chunk_id in (select chunk_id from raw) as deep,
  length(case when layers > 0 then decoded else content end) > {C.MAX_CHARS} as too_long
  from chunks c join {peeled('select * from chunks', 'chunk_id', 'content')} d
    on c.chunk_id = d.chunk_id),
own as (select chunk_id, category, {K.rank('threat_level')} as r, confidence as shown from raw
  union all select chunk_id, 'obfuscation', 2, 0e0 from body where layers > 0),
inside as (select chunk_id, category, {K.rank('threat_level')} as r, confidence
  from {K.hits(body, 'chunk_id', 'content')}
  union all select chunk_id, 'indirect_injection', 3, least(1e0, max(confidence) + 1e-1)
    from {K.hits(comments, 'chunk_id, i')} group by chunk_id, i
  union all select chunk_id, 'indirect_injection', 2, 7e-1 from ({body})
    where regexp_matches(content,{K.re2(C.MARKDOWN_INJECTION)},'i')
  union all select chunk_id, 'input_validation', 3, 1e0 from body where deep and too_long),
every as (select chunk_id, r, shown from own union all
  select chunk_id, case when exists (select 1 from own o where o.chunk_id = i.chunk_id
    and o.category = i.category) then null else r end, round(confidence, 3) from inside i),
s as (select chunk_id, max(r) as r, max(shown) as confidence, count(r) as n from every
  group by chunk_id)
select b.* exclude (layers, deep, too_long), coalesce(s.confidence, 0e0) as confidence,
  cast(coalesce(n, 0) as int) as n_threats,
  case when r >= 3 then 'blocked' when n > 0 then 'sanitized' else 'allowed' end as status
from body b left join s on b.chunk_id = s.chunk_id)"""


_DOC_CHUNKS = (f"select source as batch_id, cast(doc_id as int) as pos, cast(doc_id as varchar) as "
               f"chunk_id, text as content from ({K.DOCS})")


def _blocked_sql(source: str, detailed: bool = False) -> str:
    """The scan with the redacted bodies of blocked chunks, where redaction changes them."""
    scanned = f"select * from {decoded_scan_sql(source, detailed)}"
    keys = "batch_id, pos, chunk_id, status, confidence, n_threats"
    return (f"select {keys}, case when status = 'blocked' then nullif({_SAFE_TEXT}, t0) end "
            f"as sanitized_content from {K.redaction(scanned, keys, 'body')}")


query("g1_chunk_scan_detailed", f"""
select batch_id, pos, status, round(confidence, 3) as confidence, n_threats, sanitized_content
from ({_blocked_sql(_DOC_CHUNKS, detailed=True)})""")(
    lambda t: rag.scan_chunks(t.attack_docs().select(
        F.col("source").alias("batch_id"), F.col("doc_id").cast("int").alias("pos"),
        F.col("doc_id").cast("string").alias("chunk_id"), F.col("text").alias("content")),
        detailed=True).select("batch_id", "pos", "status", "confidence",
                              F.size("threats").alias("n_threats"), "sanitized_content"))

query("g2_redacted_blocked_chunks_without_decoding", f"""
select s.chunk_id, r.{_SAFE_TEXT} as sanitized_content from {_SCANNED} s join
  {K.redaction(_MARKED, 'chunk_id', 'content')} r on s.chunk_id = r.chunk_id
where {_STATUS} = 'blocked'""")(
    lambda t: rag.scan_chunks(t.chunks().withColumn("content", F.concat(
        "content", F.lit(" you are a helpful assistant"))), decode=False).filter("status = 'blocked'").select(
        "chunk_id", "sanitized_content"))

query("g3_fail_fast_without_decoding", f"""
with s as (select *, {_STATUS} as st from {_SCANNED}),
b as (select batch_id, min(pos) as stop from s where st = 'blocked' group by batch_id)
select s.batch_id, s.pos, s.st as status from s left join b on s.batch_id = b.batch_id
where stop is null or s.pos <= stop""")(
    lambda t: rag.scan_until_blocked(t.chunks(), decode=False).select("batch_id", "pos", "status"))

query("g4_batch_summary_without_decoding", f"""
select batch_id, count(*)::bigint as chunks_scanned,
  count(*) filter ({_STATUS} = 'allowed')::bigint as chunks_safe,
  count(*) filter ({_STATUS} = 'blocked')::bigint as chunks_blocked,
  count(*) filter ({_STATUS} = 'sanitized')::bigint as chunks_sanitized,
  count(*) filter ({_STATUS} = 'blocked') = 0 as safe_to_proceed
from {_SCANNED} group by batch_id""")(
    lambda t: rag.batch_summary(rag.scan_chunks(t.chunks(), decode=False, redact_blocked=False)))


@query("g5_safe_chunks_without_decoding", f"""
select batch_id, pos, content from {_SCANNED} where {_STATUS} = 'allowed'""")
def safe_chunks(t: Tables) -> DataFrame:
    return rag.safe_chunks(rag.scan_chunks(t.chunks(), decode=False, redact_blocked=False)).select(
        "batch_id", "pos", "content")


query("g6_quick_scan_without_decoding", f"""
select chunk_id, {_STATUS} as status, {_STATUS} = 'allowed' as safe from {_SCANNED}""")(
    lambda t: rag.quick_scan(t.chunks(), "chunk_id", "content", decode=False,
                             redact_blocked=False).select("chunk_id", "status", "safe"))

# The same with decoding on whole texts.
_SEEN = decoded_scan_sql(K.CHUNKS)

query("g2_redacted_blocked_chunks", f"""
select chunk_id, sanitized_content from ({_blocked_sql(_MARKED)}) where status = 'blocked'""")(
    lambda t: rag.scan_chunks(t.chunks().withColumn("content", F.concat(
        "content", F.lit(" you are a helpful assistant")))).filter("status = 'blocked'").select(
        "chunk_id", "sanitized_content"))

query("g3_fail_fast", f"""
with s as materialized (select * from {_SEEN}),
b as (select batch_id, min(pos) as stop from s where status = 'blocked' group by batch_id)
select s.batch_id, s.pos, status from s left join b on s.batch_id = b.batch_id
where stop is null or s.pos <= stop""")(
    lambda t: rag.scan_until_blocked(t.chunks(), redact_blocked=False).select(
        "batch_id", "pos", "status"))

query("g4_batch_summary", f"""
select batch_id, count(*)::bigint as chunks_scanned,
  count(*) filter (status = 'allowed')::bigint as chunks_safe,
  count(*) filter (status = 'blocked')::bigint as chunks_blocked,
  count(*) filter (status = 'sanitized')::bigint as chunks_sanitized,
  count(*) filter (status = 'blocked') = 0 as safe_to_proceed from {_SEEN} group by batch_id""")(
    lambda t: rag.batch_summary(rag.scan_chunks(t.chunks(), redact_blocked=False)))

query("g5_safe_chunks", f"select batch_id, pos, content from {_SEEN} where status = 'allowed'")(
    lambda t: rag.safe_chunks(rag.scan_chunks(t.chunks(), redact_blocked=False)).select(
        "batch_id", "pos", "content"))

query("g6_quick_scan", f"""
select chunk_id, status, status = 'allowed' as safe from {_SEEN}""")(
    lambda t: rag.quick_scan(t.chunks(), "chunk_id", "content", redact_blocked=False).select(
        "chunk_id", "status", "safe"))
