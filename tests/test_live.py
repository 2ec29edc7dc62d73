"""Live operators over several micro-batches."""

from datetime import datetime, timedelta

from guardlake import catalog as C
from guardlake.operators import policy
from guardlake.plans.inputs import Tables
from guardlake.plans.streams import _finish, _read_stream, _source
from guardlake.sources import sinks
from guardlake.streaming import live

START = datetime(2024, 1, 1)


def test_decisions_follow_time_across_arrow_batches(spark, tmp_path):
    rows = [(i, "hot", START + timedelta(seconds=(i * 37) % 500)) for i in range(500)]
    t = Tables(spark, str(tmp_path))
    df = spark.createDataFrame(rows, "event_id long, api_key_id string, ts timestamp")
    path = _source(t, df, "events", 1)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        out = _finish(t, live.limit_events(_read_stream(t, path, 1), "api_key_id", window=86400,
                                           limit=90, burst=10), "decisions").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    order = [i for i, _, ts in sorted(rows, key=lambda r: (r[2], r[0]))]
    assert {r.event_id for r in out if r.allowed} == set(order[:100]) and len(out) == 500


def test_a_batch_that_runs_again_replaces_its_rows(spark, tmp_path):
    path = str(tmp_path / "logs")
    df = spark.createDataFrame([("a", START), ("b", START + timedelta(days=1))],
                               "id string, created_at timestamp")
    for batch in ("s-0", "s-1", "s-0"):
        sinks.replace_batch(df, path, "created_at", batch)
    assert sinks.read_table(spark, path).count() == 4


def test_tokens_have_their_own_times_to_live(spark, tmp_path):
    head, tail = C.CANARY_PRIMARY.split("{h}")
    token = "0123456789abcdef"
    said = spark.createDataFrame(
        [(i, START + timedelta(seconds=s), f"x {head}{token}{tail} y")
         for i, s in enumerate((0, 60, 61, 299))], "id long, ts timestamp, text string")
    tokens = spark.createDataFrame([(token, "r60", START, 60), (token, "r300", START, 300)],
                                   "token string, request_id string, injected_at timestamp, "
                                   "ttl_seconds int")
    t = Tables(spark, str(tmp_path))
    rows = live.match_canaries(_read_stream(t, _source(t, said, "said", 2), 1),
                               _read_stream(t, _source(t, tokens, "tokens", 1), 1), ["id"],
                               lateness="1 day")
    got = sorted((r.id, r.request_id) for r in _finish(t, rows, "leaks").collect())
    assert got == [(0, "r300"), (0, "r60"), (1, "r300"), (1, "r60"), (2, "r300"), (3, "r300")]


def test_rule_tables_give_what_rules_as_values_give(spark):
    found = spark.createDataFrame(
        [(i, c, k) for i, (c, k) in enumerate((c, k) for c in (
            "jailbreak", "direct_injection", "data_exfiltration", "obfuscation", "other", None)
            for k in (0.5, 0.65, 0.75, 0.9))], "id int, category string, confidence double")
    rules = (*C.GUARDRAILS, C.Guardrail("any", "log", 0.7, (), ("chat",)),
             C.Guardrail("off", "block", 0.0, (), (), None, False))
    for channel in (None, "chat", "upload"):
        by_value = policy.apply_guardrails(found, rules, channel).collect()
        by_table = policy.apply_guardrails(
            found, policy.guardrail_table(spark, rules), channel).collect()
        assert sorted((r.id, r.action, sorted(r.guardrails)) for r in by_table) == sorted(
            (r.id, r.action, sorted(r.guardrails)) for r in by_value)
