"""Decoding to the fixed point in the checking database: a recursive query over the eight layers.

Each pass is one step of the recursion and carries on only texts that the pass before has changed.
Normalisation is exact for texts whose code points lie in the ranges named here (a rule gives their
forms); the given texts and their encodings hold no others.
"""

from __future__ import annotations

import unicodedata

from guardlake import catalog as C
from guardlake.functions import decode as D
from guardlake.plans import checks as K

# Latin, punctuation, circled and full-width letters, ligatures.
RANGES = ((0xA0, 0x17F), (0x2010, 0x2038), (0x24B6, 0x24E9), (0x3000, 0x3000), (0xFB00, 0xFB06),
          (0xFF01, 0xFF5E))
# Named character references; all but the last are also read without the semicolon.
ENTITIES = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "nbsp": "\u00a0", "copy": "\u00a9",
            "middot": "\u00b7", "apos": "'"}


def _normalised(text: str) -> str:
    forms = {chr(c): unicodedata.normalize("NFKC", chr(c))
             for first, last in RANGES for c in range(first, last + 1)}
    single = {c: to for c, to in forms.items() if len(to) == 1 and to != c}
    out = f"translate({text},{K.lit(''.join(single))},{K.lit(''.join(single.values()))})"
    for c, to in forms.items():
        if len(to) > 1:
            out = f"replace({out},{K.lit(c)},{K.lit(to)})"
    return f"case when strlen({text}) = length({text}) then {text} else {out} end"


def _each_part(text: str, encoded: str, plain: str, decoded: str) -> str:
    """`decoded`, an expression of m, in place of every encoded part of a text."""
    return (f"array_to_string(list_transform(regexp_extract_all({text},"
            f"{K.lit(f'(?:{encoded})|{plain}')},0,'s'), lambda m: case when regexp_full_match(m,"
            f"{K.lit(encoded)}) then coalesce({decoded},m) else m end),'')")


def _entities(text: str) -> str:
    names = " ".join(f"when '&{name}' then {K.lit(to)}" for name, to in ENTITIES.items())
    char = (f"case rtrim(m, ';') {names} else chr(case when m[3] in ('x','X') then "
            "cast(concat('0x',m[4:-2]) as int) else try_cast(m[3:-2] as int) end) end")
    legacy = "|".join(list(ENTITIES)[:-1])
    return _each_part(text, f"&(?:(?:#[0-9]{{1,5}}|#[xX][0-9a-fA-F]{{1,4}}|apos);|(?:{legacy});?)",
                      "[^&]+|&", char)


def _base64(text: str) -> str:
    raw = "try(decode(from_base64(m)))"
    # Of letters, marks, numbers, signs and ordinary spaces: what is shown.
    hidden = r"[^\pL\pM\pN\pP\pS \n\r\t]"
    good = (f"length(m) % 4 = 0 and length({raw}) >= {C.MIN_DECODED_CHARS} and length({raw}) - "
            f"len(regexp_extract_all({raw},{K.lit(hidden)})) > {C.PRINTABLE_SHARE} * length({raw})")
    return _each_part(text, C.BASE64_RUN, "[A-Za-z0-9+/]{1,15}|[^A-Za-z0-9+/]+",
                      f"case when {good} then {raw} end")


def _rotated(text: str) -> str:
    turned = f"translate({text},'{D.ALPHABET}','{D.TURNED}')"
    fresh = "+".join(f"cast(contains(lower({turned}),'{w}') and not contains(lower({text}),'{w}') "
                     "as int)" for w in C.ROT13_WORDS)
    return f"case when {fresh} >= {C.ROT13_MIN_WORDS} then {turned} else {text} end"


def _leet(text: str) -> str:
    return (f"translate(replace({text},'{C.LEET_PAIR[0]}','{C.LEET_PAIR[1]}'),"
            f"{K.lit(C.LEET_FROM)},{K.lit(C.LEET_TO)})")


def _rejoined(text: str) -> str:
    delimiters = K.lit(C.SPLIT_DELIMITERS)
    out = (f"array_to_string(list_transform(regexp_extract_all({text},"
           f"{K.lit(f'(?:{C.SPLIT_LETTERS})|' + chr(92) + 'w+' + chr(92) + 'W*|' + chr(92) + 'W+')}),"
           f" lambda m: case when regexp_full_match(m,{K.lit(C.SPLIT_LETTERS)}) then "
           f"regexp_replace(m,{delimiters},'','g') else m end),'')")
    return f"case when regexp_matches({text},{K.lit(C.SPLIT_LETTERS)}) then {out} else {text} end"


_LAYERS = (
    ("unicode_normalisation", _normalised),
    ("html_entity", _entities),
    ("url_encoding", lambda t: _each_part(t, "(?:%[0-9a-fA-F]{2})+", "[^%]+|%",
                                          "try(decode(unhex(replace(m,'%',''))))")),
    ("base64", _base64),
    ("hex_escape", lambda t: _each_part(t, C.HEX_ESCAPE, r"[^\\]+|\\",
                                        "chr(cast(concat('0x',m[3:4]) as int))")),
    ("rot13", _rotated), ("leetspeak", _leet), ("char_split", _rejoined))


def peeled(source: str, keys: str, text: str = "text") -> str:
    """(keys, decoded, layers, encodings) of every row of `source`; `keys` name a row."""
    inner = f"select *, coalesce(t, '') as t0 from walk where going and pass < {C.MAX_DECODE_DEPTH}"
    for i, (_, layer) in enumerate(_LAYERS):
        inner = f"select *, {layer(f't{i}')} as t{i + 1} from ({inner})"
    names = "list_filter([" + ",".join(
        f"case when t{i + 1} <> t{i} then '{name}' end" for i, (name, _) in enumerate(_LAYERS)
    ) + "], lambda x: x is not null)"
    steps = f"select *, {names} as found from ({inner})"
    return (f"(with recursive walk as (select {keys}, {text} as t, 0 as pass, 0 as layers, "
            f"[]::varchar[] as encodings, true as going from ({source}) union all select {keys}, "
            f"t{len(_LAYERS)}, pass + 1, layers + cast(len(found) > 0 as int), "
            f"list_concat(encodings, found), t{len(_LAYERS)} <> t0 from ({steps})) "
            f"select {keys}, coalesce(t, '') as decoded, layers, encodings from walk "
            f"qualify row_number() over (partition by {keys} order by pass desc) = 1)")
