"""SQL fragments for the checking database, written out from the catalog."""

from __future__ import annotations

from guardlake import catalog as C
from guardlake.plans import inputs as I

DOCS = I.for_check(I.ATTACK_DOCS)
MESSAGES = I.for_check(I.MESSAGES)
TALKS = I.for_check(I.TALKS)
LOGS = I.for_check(I.LOGS)
FEEDBACK = I.for_check(I.FEEDBACK)
ADJUSTMENTS = I.for_check(I.ADJUSTMENTS)
CHUNKS = (f"select cast(doc_id // 5 as varchar) as batch_id, cast(doc_id % 5 as int) as pos, "
          f"concat('doc-',cast(doc_id as varchar)) as chunk_id, text as content from ({DOCS})")


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def re2(regex: str) -> str:
    r"""The regex as a quoted literal; \uXXXX is written \x{XXXX} there."""
    out, rest = "", regex
    while "\\u" in rest:
        at = rest.index("\\u")
        out += rest[:at] + "\\x{" + rest[at + 2:at + 6] + "}"
        rest = rest[at + 6:]
    return lit(out + rest)


def rank(level: str) -> str:
    return (f"case {level} when 'critical' then 4 when 'high' then 3 when 'medium' then 2 "
            "when 'low' then 1 else 0 end")


def level_name(rank_expr: str) -> str:
    return (f"case {rank_expr} when 4 then 'critical' when 3 then 'high' when 2 then 'medium' "
            "when 1 then 'low' else 'safe' end")


def hits(source: str, keys: str, text: str = "text", patterns=C.PATTERNS) -> str:
    """One row per (row of source, pattern that matches), with confidence."""
    each = " union all ".join(
        f"select {keys}, {i} as ord, {lit(p.category)} as category, {lit(p.name)} as name, "
        f"{lit(p.level)} as threat_level, "
        f"len(regexp_extract_all({text},{re2(p.regex)},0,'is')) as n, length({text}) as chars, "
        f"substr(regexp_extract({text},{re2(p.regex)},0,'is'),1,200) as matched_text "
        f"from src where regexp_matches({text},{re2(p.regex)},'is')"
        for i, p in enumerate(patterns))
    conf = ("cast(750 + 50*least(3,n-1) + (least(chars,5000)+25)//50 as double)/1000e0")
    return (f"(with src as materialized (select * from ({source})), each_hit as ({each}) "
            f"select *, {conf} as confidence from each_hit)")


def redaction(source: str, keys: str, text: str = "text", rules=C.RULES) -> str:
    """Text after 0..n rules as t0..tn, one column per rule."""
    cols = [f"{text} as t0"]
    for i, r in enumerate(rules):
        flags = "gi" if r.ignore_case else "g"
        cols.append(f"regexp_replace(t{i},{re2(r.regex)},{lit(r.replacement)},'{flags}') as t{i+1}")
    return f"(select {keys}, {', '.join(cols)} from ({source}))"


def redaction_hits(source: str, keys: str, text: str = "text", rules=C.RULES) -> str:
    """One row per (row, rule that fires): distinct matches and samples."""
    each = " union all ".join(
        f"select {keys}, {lit(r.name)} as rule, {lit(r.category)} as category, "
        f"list_sort(list_distinct(regexp_extract_all(t{i},{re2(r.regex)},0,"
        f"'{'i' if r.ignore_case else 'c'}'))) as m from steps"
        for i, r in enumerate(rules))
    cut = "lambda s: case when length(s) > 50 then concat(substr(s,1,50),'...') else s end"
    return (f"(with steps as materialized {redaction(source, keys, text, rules)}, "
            f"each_rule as ({each}) select {keys}, rule, category, cast(len(m) as int) as n, "
            f"array_to_string(list_transform(m[1:3], {cut}), '|') as samples "
            "from each_rule where len(m) > 0)")


def suggestion(category: str, name: str, level: str) -> str:
    exact = " ".join(f"when {category} = {lit(c)} and {name} = {lit(n)} then {lit(s)}"
                     for c, group in C.SUGGESTIONS.items() for n, s in group.items())
    first = " ".join(f"when {category} = {lit(c)} then {lit(next(iter(group.values())))}"
                     for c, group in C.SUGGESTIONS.items())
    by_level = " ".join(f"when {level} = {lit(k)} then {lit(v)}"
                        for k, v in C.LEVEL_SUGGESTIONS.items())
    return f"case {exact} {first} {by_level} else {lit(C.FALLBACK_SUGGESTION)} end"


def keyword_scores(text: str) -> dict[str, str]:
    """label -> score expression of the keyword classifier."""
    out = {}
    for label, base, words in C.SIGNALS:
        n = "+".join(f"cast(contains(lower({text}),{lit(w)}) as int)" for w in words)
        out[label] = (f"case when {n} > 0 then cast({base} as double)*least(1e0,5e-1+"
                      f"({n})*15e-2) else 0e0 end")
    return out


def semantic(source: str, keys: str, text: str = "text") -> str:
    """label and score of the keyword classifier per row."""
    scores = keyword_scores(text)
    cols = ", ".join(f"{v} as s_{k}" for k, v in scores.items())
    names = [f"s_{k}" for k in scores]
    pick = " ".join(f"when s_{k} = top then '{k}'" for k in scores)
    return (f"(select {keys}, case when top = 0 then 'safe' {pick} end as label, top as score "
            f"from (select *, greatest({', '.join(names)}) as top from "
            f"(select {keys}, {cols} from ({source}))))")
