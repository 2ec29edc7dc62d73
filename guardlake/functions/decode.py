"""De-obfuscation: single-layer decoders as SQL expressions, and the fixed point.

The fixed point peels layers until the text stops changing.  Every text goes to Python for that,
in Arrow batches, and unchanged ones come back as nulls; the single-layer expressions are for
columns that are known to hold one encoding.
"""

from __future__ import annotations

import base64
import codecs
import functools
import html
import re
import unicodedata
import urllib.parse
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from guardlake import catalog as C
from guardlake.functions.common import UNICODE, any_of, fenced

DECODED = "struct<decoded:string,layers:int,encodings:array<string>>"

# ---------------------------------------------------------------- single layers


def fullwidth_to_ascii(text: Column) -> Column:
    """Full-width ASCII forms to ASCII: the part of NFKC that attacks use most."""
    wide = "".join(chr(0xFEE0 + c) for c in range(0x21, 0x7F)) + "　"
    return F.translate(text, wide, "".join(map(chr, range(0x21, 0x7F))) + " ")


def _each_part(text: Column, encoded: str, plain: str, decoded) -> Column:
    """Cut a text into encoded and plain parts in one pass and decode each encoded part once.

    `plain` matches whatever is not `encoded`; no output is read again.
    """
    parts = F.regexp_extract_all(text, F.lit(f"(?s)(?:{encoded})|{plain}"), 0)
    return F.array_join(F.transform(parts, lambda m: F.when(
        m.rlike(f"\\A(?:{encoded})\\z"), decoded(m)).otherwise(m)), "")


def _bytes_to_text(hex_digits: Column) -> Column:
    return F.make_valid_utf8(F.unhex(hex_digits).cast("string"))


def percent_decode(text: Column) -> Column:
    """%XX runs decoded as UTF-8; invalid escapes and '+' are kept."""
    return _each_part(text, "(?:%[0-9a-fA-F]{2})+", "[^%]+|%",
                      lambda m: _bytes_to_text(F.replace(m, F.lit("%"))))


def numeric_entities(text: Column) -> Column:
    """Decimal character references of the Basic Multilingual Plane."""
    def char(m: Column) -> Column:
        code = F.regexp_extract(m, "[0-9]+", 0).cast("int")
        utf16 = F.decode(F.unhex(F.lpad(F.hex(code), 4, "0")), "UTF-16BE")
        ordinary = code.between(32, 126) | code.between(160, 0xD7FF)
        return F.when(ordinary, utf16).otherwise(m)

    return _each_part(text, "&#[0-9]{1,5};", "[^&]+|&", char)


def hex_decode(text: Column) -> Column:
    r"""\xHH escapes to the character with that code."""
    return _each_part(text, C.HEX_ESCAPE, r"[^\\]+|\\", lambda m: F.decode(
        F.unhex(F.concat(F.lit("00"), F.substring(m, 3, 2))), "UTF-16BE"))


def base64_decode(text: Column) -> Column:
    """Base64 runs of 16 or more characters that hold printable UTF-8."""
    def plain(m: Column) -> Column:
        raw = F.try_to_binary(F.when(F.length(m) % 4 == 0, m), F.lit("base64")).cast("string")
        odd = F.regexp_count(raw, F.lit(r"(?U)[\p{C}\p{Z}&&[^ \n\r\t]]"))
        good = (F.is_valid_utf8(raw) & (F.length(raw) >= C.MIN_DECODED_CHARS)
                & (F.length(raw) - odd > C.PRINTABLE_SHARE * F.length(raw)))
        return F.when(good, raw).otherwise(m)

    return _each_part(text, C.BASE64_RUN, "[A-Za-z0-9+/]{1,15}|[^A-Za-z0-9+/]+", plain)


ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
TURNED = codecs.encode(ALPHABET, "rot13")


def rotate13(text: Column) -> Column:
    return F.translate(text, ALPHABET, TURNED)


def rot13_decode(text: Column) -> Column:
    """Rotated text when two or more danger words appear that were not there before."""
    low, turned = F.lower(text), F.lower(rotate13(text))
    fresh = sum((F.when(turned.contains(w) & ~low.contains(w), 1).otherwise(0)
                 for w in C.ROT13_WORDS), F.lit(0))
    return F.when(fresh >= C.ROT13_MIN_WORDS, rotate13(text)).otherwise(text)


def leet_decode(text: Column) -> Column:
    """Digits and symbols read as the letters they stand for."""
    return F.replace(F.translate(text, C.LEET_FROM, C.LEET_TO),
                     F.lit(C.LEET_PAIR[0]), F.lit(C.LEET_PAIR[1]))


def rejoin_letters(text: Column) -> Column:
    """'i g n o r e' to 'ignore'."""
    # Split letters start at a word of one letter: longer words pass many at a time.
    longer = r"(?U:(?:\w{2,}+\W*+){1,200}+|\w+\W*|\W+)"
    return _each_part(text, UNICODE + C.SPLIT_LETTERS, longer, lambda m: F.regexp_replace(
        m, UNICODE + C.SPLIT_DELIMITERS, ""))


# ---------------------------------------------------------------- fixed point
# Layer by layer in Python: NFKC and HTML entities have no SQL counterpart, and every layer
# must see the output of the one before.  Texts travel in Arrow batches; a text that no
# layer changes (most of them) comes back as a null instead of a copy.

_RUN = re.compile(C.BASE64_RUN)
_HEX = re.compile(C.HEX_ESCAPE)
_LEET = str.maketrans(C.LEET_FROM, C.LEET_TO)
_LEET_SIGN = re.compile("[" + re.escape(C.LEET_FROM) + "]|" + re.escape(C.LEET_PAIR[0]))
_SPLIT = re.compile(C.SPLIT_LETTERS)
_DELIMITERS = re.compile(C.SPLIT_DELIMITERS)
_TURNED_WORDS = tuple(codecs.encode(w, "rot13") for w in C.ROT13_WORDS)


def _plain_base64(run: str) -> str | None:
    try:
        out = base64.b64decode(run, validate=True).decode("utf-8")
    except ValueError:
        return None
    shown = sum(ch.isprintable() or ch in "\n\r\t" for ch in out)
    enough = len(out) >= C.MIN_DECODED_CHARS and shown > C.PRINTABLE_SHARE * len(out)
    return out if enough else None


def _unbase64(text: str) -> str:
    for run in _RUN.findall(text):
        plain = _plain_base64(run)
        if plain is not None:
            text = text.replace(run, plain, 1)
    return text


def _unrotate(text: str) -> str:
    before = text.lower()
    if text.isascii() and sum(w in before for w in _TURNED_WORDS) < C.ROT13_MIN_WORDS:
        return text
    turned = codecs.decode(text, "rot13")
    after = turned.lower()
    fresh = [w for w in C.ROT13_WORDS if w in after and w not in before]
    return turned if len(fresh) >= C.ROT13_MIN_WORDS else text


def _unleet(text: str) -> str:
    if not _LEET_SIGN.search(text):
        return text
    # The pair is one symbol and is read before the single characters are.
    return text.replace(*C.LEET_PAIR).translate(_LEET)


_LAYERS = (
    ("unicode_normalisation", functools.partial(unicodedata.normalize, "NFKC")),
    ("html_entity", html.unescape),
    ("url_encoding", urllib.parse.unquote),
    ("base64", _unbase64),
    ("hex_escape", lambda t: _HEX.sub(lambda m: chr(int(m[1], 16)), t)),
    ("rot13", _unrotate),
    ("leetspeak", _unleet),
    ("char_split", lambda t: _SPLIT.sub(lambda m: _DELIMITERS.sub("", m[0]), t)),
)


def peel(text: str, max_depth: int = C.MAX_DECODE_DEPTH) -> dict:
    """Decode one text to its fixed point (at most `max_depth` passes); `decoded` is None
    if nothing changed."""
    current, layers, trail = text, 0, []
    for _ in range(max_depth):
        start, seen = current, len(trail)
        for name, undo in _LAYERS:
            before, current = current, undo(current)
            if current != before:
                trail.append(name)
        layers += len(trail) > seen
        if current == start:
            break
    # Character references can spell lone surrogates; Arrow strings must be UTF-8.
    decoded = None if not layers else current.encode("utf-8", "replace").decode("utf-8")
    return {"decoded": decoded, "layers": layers, "encodings": trail}


_DECODED_ARROW = pa.struct([("decoded", pa.string()), ("layers", pa.int32()),
                            ("encodings", pa.list_(pa.string()))])


SLICE_BYTES, SLICE_ROWS = 1 << 20, 256


def in_slices(batches: Iterator[pa.Array], work, shape: pa.DataType) -> Iterator[pa.Array]:
    """`work` on few rows at a time: an Arrow batch has thousands, and every text of it as a Python
    string, as an object and as a result would be in memory at once.

    A slice ends at SLICE_ROWS rows or where an average row would take it past SLICE_BYTES, and is
    halved while it holds more than that.
    """
    for batch in batches:
        rows = max(1, min(SLICE_ROWS, SLICE_BYTES * len(batch) // max(1, batch.nbytes)))
        todo = [batch.slice(at, rows) for at in range(0, len(batch), rows)][::-1]
        while todo:
            part = todo.pop()
            if len(part) > 1 and part.nbytes > SLICE_BYTES:
                half = len(part) // 2
                todo += [part.slice(half), part.slice(0, half)]
            else:
                yield pa.array(work(part.to_pylist()), shape)


@functools.cache
def _peel_udf(max_depth: int, many: bool):
    def one(texts: list) -> list:
        return [peel(t or "", max_depth) for t in texts]

    def each(rows: list) -> list:
        return [None if row is None else one(row) for row in rows]

    work, shape = (each, pa.list_(_DECODED_ARROW)) if many else (one, _DECODED_ARROW)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return in_slices(batches, work, shape)

    return F.arrow_udf(run, f"array<{DECODED}>" if many else DECODED)


def _whole(peeled: Column, text: Column, leet: str) -> Column:
    text = F.coalesce(text, F.lit(""))
    found = F.struct(F.coalesce(peeled["decoded"], text).alias("decoded"),
                     peeled["layers"].alias("layers"), peeled["encodings"].alias("encodings"))
    if leet == "parity":
        return found
    # Option 'strict': the character map alone counts only if it reveals a danger word.
    low, before = F.lower(found["decoded"]), F.lower(text)
    revealed = any_of(low.contains(w) & ~before.contains(w) for w in C.ROT13_WORDS)
    only_leet = peeled["encodings"] == F.array(F.lit("leetspeak"))
    none = F.struct(text.alias("decoded"), F.lit(0).alias("layers"),
                    F.array().cast("array<string>").alias("encodings"))
    return F.when(only_leet & ~revealed, none).otherwise(found)


def with_decoded(df: DataFrame, text: Column | str, out: str = "deob",
                 max_depth: int = C.MAX_DECODE_DEPTH, leet: str = "parity") -> DataFrame:
    """Add `out`: struct<decoded, layers, encodings> of one text column.

    The result is fenced, so the UDF runs once per row whatever is done with it later.
    """
    text = F.col(text) if isinstance(text, str) else text
    peeled = f"__peeled_{out}"
    df = df.withColumn(peeled, _peel_udf(max_depth, False)(text))
    return fenced(df.withColumn(out, _whole(F.col(peeled), text, leet)).drop(peeled), out)


def with_decoded_all(df: DataFrame, texts: Column | str, out: str,
                     max_depth: int = C.MAX_DECODE_DEPTH, leet: str = "parity") -> DataFrame:
    """Add `out`: array<struct<decoded, layers, encodings>>, one per text of the array.

    A row costs one Python call, whatever the number of its texts; empty arrays cost none.
    """
    texts = F.col(texts) if isinstance(texts, str) else texts
    peeled = f"__peeled_{out}"
    sent = F.when(F.size(texts) > 0, texts)
    none = F.array().cast(f"array<{DECODED}>")
    both = F.zip_with(texts, F.col(peeled), lambda t, p: _whole(p, t, leet))
    df = df.withColumn(peeled, _peel_udf(max_depth, True)(sent))
    return fenced(df.withColumn(out, F.when(F.col(peeled).isNull(), none).otherwise(both))
                  .drop(peeled), out)
