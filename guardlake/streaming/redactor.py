"""Redaction of text that arrives in pieces.

The buffer is only cut at the start of a word, far enough from its end that no rule can
reach across: every rule matches at most four whitespace-separated words, and the words
held back leave room for matches on what earlier rules put in.  So the released pieces,
joined, equal the redaction of the whole text.  For rules of one's own the bound is derived.
"""

from __future__ import annotations

import heapq
import json
import re
from itertools import accumulate

import numpy as np

from guardlake.catalog import RULES
from guardlake.functions.regex import words_spanned

RULE_WORDS, HELD_WORDS = 4, 16

_FOUR_DIGITS = re.compile("[0-9]{4}")
# Characters beyond ASCII that the rules' letters match when case is ignored.
_FOLDED = (("ſ", "s"), ("İ", "i"), ("ı", "i"))


def _needs(*words: str):
    return lambda text, low: any(w in text for w in words)


def _digits(text: str, low: str) -> bool:
    # Looking for single characters is far cheaper than the regex.
    return any(d in text for d in "0123456789") and _FOUR_DIGITS.search(text) is not None


# rule name -> what neither the text nor anything an earlier rule leaves behind can match without
_GATES = {
    "email": _needs("@"), "phone_us": _digits, "ssn": _digits, "credit_card": _digits,
    "openai_key": _needs("sk-"), "anthropic_key": _needs("sk-ant-"), "github_pat": _needs("ghp_"),
    "aws_access_key": _needs("AKIA"), "generic_api_key": _needs("api", "API"),
    "bearer_token": _needs("Bearer"), "private_key": _needs("-----BEGIN"),
    "password": lambda text, low: "passw" in low or "pwd" in low,
    "system_prompt_leak": lambda text, low: (
        "you" in low and "are" in low or "instruction" in low
        or "system" in low and "prompt:" in low),
}
_WORD = re.compile(r"\S+")
# rule name -> regex of a part that each of its matches has
_SIGNS = {
    "email": "@", "phone_us": "[0-9]{4,}", "ssn": "[0-9]{4,}", "credit_card": "[0-9]{4,}",
    "openai_key": r"\bsk-", "anthropic_key": r"\bsk-", "github_pat": r"\bghp_",
    "aws_access_key": r"\bAKIA", "generic_api_key": r"\b(?:api[_\-]?key|API[_\-]?KEY)",
    "bearer_token": r"\bBearer\s", "private_key": "-----BEGIN",
    "password": r"(?:password|passwd|pwd)\s*[:=]",
    "system_prompt_leak": r"You\s+are\s|System\s+prompt:|My\s+(?:initial|original|system)",
}


def _low(regex: str) -> str:
    """The regex in lower case, but for its escapes."""
    return re.sub(r"\\.|[A-Z]", lambda m: m[0] if m[0][0] == "\\" else m[0].lower(), regex)


_SPACE = np.array([chr(c).isspace() for c in range(0x3001)] + [False])
_ASCII_SPACE = _SPACE[:256].tobytes()


def word_starts(text: str) -> np.ndarray:
    """Where the words begin, as `_WORD` finds them."""
    text = " " + text
    if text.isascii():
        space = np.frombuffer(text.encode().translate(_ASCII_SPACE), dtype=bool)
    else:
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
        space = _SPACE[np.minimum(codes, len(_SPACE) - 1)]
    return np.flatnonzero(space[:-1] > space[1:])


class Redactor:
    """The rules, compiled."""

    def __init__(self, rules: tuple, held_words: int = HELD_WORDS):
        self.held_words = held_words
        self.rules = [(_GATES.get(r.name) if r in RULES else None, r,
                       re.compile(r.regex, re.IGNORECASE if r.ignore_case else 0)) for r in rules]
        known = all(r in RULES for r in rules)
        self.signs = {r.name: re.compile(_SIGNS[r.name], re.IGNORECASE if r.ignore_case else 0)
                      for r in rules} if known else None
        # In lower case, where that has the same places, regexes need not ignore case.
        self.low_signs = {r.name: re.compile(_low(_SIGNS[r.name]))
                          for r in rules if r.ignore_case} if known else None

    def possible(self, text: str) -> list:
        """The (rule, regex) that can match."""
        low = text
        if not text.isascii():
            for letter, plain in _FOLDED:
                low = low.replace(letter, plain)
        low, opened = low.lower(), {None: True}
        for gate, *_ in self.rules:
            if gate not in opened:
                opened[gate] = gate(text, low)
        return [(rule, regex) for gate, rule, regex in self.rules if opened[gate]]

    def redact(self, text: str) -> str:
        for rule, regex in self.possible(text):
            text = regex.sub(lambda m, to=rule.replacement: to, text)
        return text

    def found(self, text: str) -> list[str]:
        """Category of every match, counted before anything is replaced."""
        return [rule.category for rule, regex in self.possible(text)
                for _ in regex.finditer(text)]

    def clean(self, text: str) -> bool:
        """No rule matches anywhere in the text."""
        return not any(regex.search(text) for _, regex in self.possible(text))

    def clean_cut(self, text: str) -> tuple[int | None, int]:
        """(start of a word that no match can reach across, None if there is none; up to where
        the text has been tried).

        As many words as are held back have to be free of matches on either side; then what
        stands further away decides nothing, wherever the scan of the rules began.  The first
        and the last word may be parts of words and are left out.
        """
        words, held = list(_WORD.finditer(text))[1:-1], self.held_words
        at = held
        while at + held <= len(words):
            low, cut, high = words[at - held].start(), words[at].start(), words[at + held - 1].end()
            if all(self.clean(text[a:b]) for a, b in ((low, high), (low, cut), (cut, high))):
                return cut, cut
            at += held
        return None, words[at - held].start() if at > held else 0

    def release(self, buffer: str, window: int) -> tuple[str, str, str]:
        """(text that can go out, the same redacted, text to hold back as it is)."""
        if len(buffer) <= window:
            return "", "", buffer
        starts = [m.start() for m in _WORD.finditer(buffer)][:-self.held_words]
        cuts = [at for at in reversed(starts) if 0 < at <= len(buffer) - window]
        if not cuts:
            return "", "", buffer
        if not self.possible(buffer):
            return buffer[:cuts[0]], buffer[:cuts[0]], buffer[cuts[0]:]
        whole = self.redact(buffer)
        for at in cuts:
            head = self.redact(buffer[:at])
            if head + self.redact(buffer[at:]) == whole:
                return buffer[:at], head, buffer[at:]
        return "", "", buffer

    def suspects(self, text: str, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last words of the stretches, in order and apart, that have parts of matches.

        `starts` are those of the words; no match stands in any other word alone, whatever piece
        of the text is looked at.
        """
        plain, asked = text.lower() if text.isascii() else None, set()
        for rule, _ in self.possible(text):
            low = plain is not None and rule.ignore_case
            asked.add(((self.low_signs if low else self.signs)[rule.name], low))
        found = {m.span() for regex, low in asked for m in regex.finditer(plain if low else text)}
        if not found:
            return starts[:0], starts[:0]
        spans = np.array(sorted(found))
        first = starts.searchsorted(spans[:, 0], "right") - 1
        last = np.maximum.accumulate(starts.searchsorted(spans[:, 1], "left") - 1)
        apart = np.flatnonzero(first[1:] > last[:-1] + 1)
        return first[np.r_[0, apart + 1]], last[np.r_[apart, len(last) - 1]]

    def release_each(self, buffer: str, pieces: list[str], window: int) -> tuple[list[str], str]:
        """(what `release` gives out, redacted, after each piece in turn; text to hold back).

        The words are found once, not once per piece.  Where none of the words around a cut has a
        part of a match, the cut holds: no match, nor one on what rules put in, comes near it.
        Elsewhere, and with rules of one's own, `release` decides.
        """
        out = []
        if self.signs is None or not pieces:
            for piece in pieces:
                _, safe, buffer = self.release(buffer + piece, window)
                out.append(safe)
            return out, buffer
        text = buffer + "".join(pieces)
        starts = word_starts(text)
        if not len(starts):
            return [""] * len(pieces), text
        # Up to each end, all words but the last ones, and those in the window, may be cut at.
        ends = np.array(list(accumulate(map(len, pieces), initial=len(buffer)))[1:])
        cuts = np.minimum(starts.searchsorted(ends, "left") - self.held_words,
                          starts.searchsorted(ends - window, "right")) - 1
        places = np.append(starts, 0)[np.maximum(cuts, -1)]
        low, high = self.suspects(text, starts)
        if not len(low):
            places = places.tolist()
            return [text[a:b] for a, b in zip([0, *places], places)], text[places[-1]:]
        near = self.held_words + RULE_WORDS
        i = high.searchsorted(cuts - near).clip(0, len(high) - 1)
        close = (high[i] >= cuts - near) & (low[i] <= cuts + near)
        froms, tos = starts[low].tolist(), starts[high].tolist()
        # `text[base:end]` is the buffer; stretches before the one numbered `at` end before it.
        base, at = 0, 0
        for end, place, doubtful in zip(ends.tolist(), places.tolist(), close.tolist()):
            if place <= base:
                out.append("")
                continue
            if doubtful:
                raw, safe, _ = self.release(text[base:end], window)
                base += len(raw)
                out.append(safe)
                continue
            while at < len(tos) and tos[at] < base:
                at += 1
            raw = text[base:place]
            out.append(self.redact(raw) if at < len(tos) and froms[at] <= place else raw)
            base = place
        return out, text[base:]


def for_streams(rules: tuple, match_words: int | None = None) -> Redactor:
    """A redactor that holds back enough words for every match of the rules.

    How many words a match of a rule that isn't in the catalog spans follows from its regex; where that
    has no bound, `match_words` has to give one.
    """
    most = [match_words or 0]
    for rule in rules:
        if rule not in RULES and match_words is None:
            words = words_spanned(rule.regex)
            if words is None:
                raise ValueError(f"give match_words, the most words that a match of {rule.name} spans")
            most.append(words)
    return Redactor(rules, HELD_WORDS // RULE_WORDS * max(RULE_WORDS, *most))


def redact(text: str, rules: tuple) -> str:
    return Redactor(rules).redact(text)


class Pieces:
    """One stream: puts pieces in order, cuts, redacts.  `state` is what survives batches."""

    def __init__(self, redactor: Redactor, window: int, state: tuple | None = None):
        self.redactor, self.window = redactor, window
        self.buffer, self.next_seq, waiting = state or ("", 0, "[]")
        self.waiting = [tuple(x) for x in json.loads(waiting)]
        heapq.heapify(self.waiting)

    def state(self) -> tuple:
        return self.buffer, self.next_seq, json.dumps(self.waiting)

    def add(self, seq: int, item) -> list:
        """Queue an item; return the items whose turn it now is, as (seq, item)."""
        if seq >= self.next_seq:
            heapq.heappush(self.waiting, (seq, item))
        ready = []
        while self.waiting and self.waiting[0][0] <= self.next_seq:
            seq, item = heapq.heappop(self.waiting)
            if seq == self.next_seq:
                ready.append((seq, item))
                self.next_seq += 1
        return ready

    def add_each(self, items: list) -> list:
        """Queue (seq, item) in order; return those whose turn it now is, as `add` does."""
        upto = self.next_seq + len(items)
        if not self.waiting and [seq for seq, _ in items] == list(range(self.next_seq, upto)):
            self.next_seq = upto
            return items
        return [ready for seq, item in items for ready in self.add(seq, item)]

    def drain(self) -> list:
        """The items that still wait for a missing one, in order, as (seq, item)."""
        rest, self.waiting = sorted(self.waiting), []
        if rest:
            self.next_seq = rest[-1][0] + 1
        return rest

    def push(self, text: str) -> tuple[str, list[str]]:
        """Add text; return (redacted text to emit, categories found in it)."""
        raw, safe, self.buffer = self.redactor.release(self.buffer + text, self.window)
        return safe, self.redactor.found(raw) if raw else []

    def push_each(self, texts: list[str]) -> list[str]:
        """Add texts; return what `push` would emit after each."""
        safe, self.buffer = self.redactor.release_each(self.buffer, texts, self.window)
        return safe

    def rest(self) -> str:
        """What is held back, redacted; it is held no longer."""
        rest, self.buffer = self.buffer, ""
        return self.redactor.redact(rest)

    def flush(self) -> tuple[str, list[str]]:
        found = self.redactor.found(self.buffer)
        return self.rest(), found


HEAD, BODY, TAIL = 0, 1, 2


class Block:
    """A stretch of a stream, redacted without what stands before and after it.

    Gives (kind, text): HEAD is raw text up to the first clean cut, BODY redacted text from there
    on, TAIL the raw rest that was held back.  A block without a clean cut is all HEAD.  Tails and
    the heads that follow them, up to the next cut, are redacted as one text of their own.
    """

    def __init__(self, redactor: Redactor, window: int, starts: bool):
        self.redactor, self.window, self.head = redactor, window, ""
        self.body = Pieces(redactor, window) if starts else None

    def push(self, text: str) -> list[tuple[int, str]]:
        out = []
        if self.body is None:
            text = self.head + text
            cut, tried = self.redactor.clean_cut(text)
            if cut is not None:
                self.body = Pieces(self.redactor, self.window)
            at = tried if cut is None else cut
            out.append((HEAD, text[:at]))
            text = text[at:]
            if cut is None:
                self.head, text = text, ""
        if self.body is not None:
            out.append((BODY, self.body.push(text)[0]))
        return [(kind, said) for kind, said in out if said]

    def end(self) -> list[tuple[int, str]]:
        return [(HEAD, self.head)] if self.body is None else [(TAIL, self.body.buffer)]
