"""Intent scoring: the keyword classifier, and the arithmetic around a supplied model."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from guardlake import catalog as C
from guardlake.functions.common import let, pct, sql_text



def _level(label: Column) -> Column:
    out = F.lit("safe")
    for name, level in C.LABEL_LEVELS.items():
        out = F.when(label == name, F.lit(level)).otherwise(out)
    return out


def _classify_sql() -> str:
    groups = []
    for label, base, words in C.SIGNALS:
        n = " + ".join(f"int(contains(low, {sql_text(w)}))" for w in words)
        groups.append(
            f"transform(array({n}), n -> named_struct('label', '{label}', 'score', "
            f"CASE WHEN n > 0 THEN {base}D * least(1D, 0.5D + n * 0.15D) ELSE 0D END))[0]")
    return (f"t -> transform(array(lower(t)), low -> transform(array(array({', '.join(groups)})), "
            "g -> CASE WHEN exists(g, x -> x.score > 0) "
            "THEN filter(g, x -> x.score = array_max(transform(g, y -> y.score)))[0] "
            "ELSE named_struct('label', 'safe', 'score', 0D) END)[0])[0]")


def classify(text: Column) -> Column:
    """struct<label, score>: strongest keyword group, the first one on ties."""
    return F.call_function("transform", F.array(text), F.expr(_classify_sql()))[0]


def _verdict(label: Column, conf: Column, threshold: float, source: str, floor) -> Column:
    bad = (label != "safe") & (conf >= threshold)
    hint = (label != "safe") & (conf > floor) if floor is not None else F.lit(False)
    said = F.concat(F.lit(f"{source} classifier: "), label, F.lit(" ("), pct(conf, 1), F.lit(")"))
    quiet = said if floor is None else F.lit(f"{source} classifier: safe")
    return F.struct(
        bad.alias("is_malicious"),
        F.when(bad, _level(label)).when(hint, "low").otherwise("safe").alias("threat_level"),
        conf.alias("confidence"),
        (label if floor is None else F.when(bad | hint, label).otherwise("safe")).alias("label"),
        F.when(bad, said).when(hint, F.concat(said, F.lit(" — below threshold")))
        .otherwise(quiet).alias("reasoning"))


def keyword_verdict(text: Column, threshold: float = C.SEMANTIC_THRESHOLD) -> Column:
    """struct<is_malicious, threat_level, confidence, label, reasoning>."""
    return let(classify(text), lambda c: _verdict(
        c["label"], c["score"], threshold, "Heuristic", C.SEMANTIC_REPORT_FLOOR))


def softmax(logits: Column) -> Column:
    def shares(exps: Column) -> Column:
        total = F.aggregate(exps, F.lit(0.0), lambda a, x: a + x)
        return let(total, lambda t: F.transform(exps, lambda x: x / t))

    top = F.array_max(logits)
    return let(F.transform(logits, lambda x: F.exp(x.cast("double") - top)), shares)


def logits_verdict(logits: Column, threshold: float = C.SEMANTIC_THRESHOLD) -> Column:
    """Verdict from the five label logits of a model."""
    def pick(probs: Column) -> Column:
        top = F.array_max(probs)
        label = F.coalesce(F.get(F.array(*[F.lit(x) for x in C.LABELS]),
                                 (F.array_position(probs, top) - 1).cast("int")), F.lit("safe"))
        return let(F.struct(label.alias("l"), top.alias("c")),
                   lambda s: _verdict(s["l"], s["c"], threshold, "ONNX", None))

    return let(softmax(logits), pick)
