"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors in one pass over the text: at-signs, ``://`` schemes, plus signs before a digit,
digits, and cue words of account numbers. A deterministic local parser grows each anchor to the whole item and validates it.
Texts without an anchor cost one scan.

Kinds: ``email``, ``ip``, ``card``, ``phone`` (the base rules, leftmost and non-overlapping per kind), and what the method
adds: ``account`` (an IBAN with right check digits, or 6 to 17 digits right behind an account cue) and ``login`` (user and
password in a URL). Spans count code points, end exclusive.

Defined results: a null text counts as empty and has no span; an empty table gives no rows; texts of any length are taken whole; repeated rows each get
their row. Where items of several kinds share characters each is reported, and redaction makes one mark of them, named by
the item that begins first, or the longer or earlier listed one where two begin together. Extra columns may have any name;
``find`` returns only those asked for, which must not be named like its results.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_pass, schema_with, slices

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "account", "login")
#: Words that announce an account number (lower case, as fixed values).
CUES = ("iban", "account", "acct", "a/c", "konto", "compte", "cuenta")

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_CUED = re.compile(r"(?:[\x20]?(?:no|nr|number|n°|num)\b\.?)?[\x20:#.]{1,3}([0-9](?:[\x20-]?[0-9]){5,16})(?![0-9A-Za-z])", re.IGNORECASE)
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}")
_LOGIN = re.compile(r"://([^\s/@:]+:[^\s/@]+)@[A-Za-z0-9.-]+")
_WORD = re.compile(r"[A-Za-z0-9]")


@lru_cache(1)
def automaton() -> ahocorasick.Automaton:
    """Anchors: single characters, and cue words in lower, upper and title case."""
    found = ahocorasick.Automaton()
    found.add_word("@", ("at", 1))
    found.add_word("://", ("scheme", 3))
    for d in "0123456789":
        found.add_word(d, ("digit", 1))
        found.add_word("+" + d, ("plus", 2))
    for cue in CUES:
        for word in {cue, cue.upper(), cue.title()}:
            found.add_word(word, ("cue", len(word)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for at, d in enumerate(reversed(digits)):
        n = int(d) * (1 + at % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def iban_end(text: str, start: int) -> int:
    """End of the longest span at ``start`` that is an IBAN with right check digits, else -1."""
    if not (m := _IBAN.match(text, start)):
        return -1
    for end in range(m.end(), start + 14, -1):
        if text[end - 1] == " " or end < len(text) and _WORD.match(text[end]):
            continue
        compact = text[start:end].replace(" ", "")
        if len(compact) >= 15 and int("".join(str(int(c, 36)) for c in compact[4:] + compact[:4])) % 97 == 1:
            return end
    return -1


def _email(text: str, at: int, floor: int) -> tuple[int, int] | None:
    """Grow an at-sign to an address; the local part reaches back to ``floor`` at most."""
    start = at
    while start > floor and _LOCAL.match(text, start - 1):
        start -= 1
    if start == at or not (m := _DOMAIN.match(text, at)):
        return None
    return start, m.end()


def spans(text: str) -> list[tuple[int, int, int]]:
    """``(kind, start, end)`` of every item, by kind, then start; kinds are positions in ``KINDS``."""
    found: list[tuple[int, int, int]] = []
    done = [0] * len(KINDS)  # where the last match of each kind ended, valid or not
    runs = 0  # end of the digit run whose address has been tried
    for last, (anchor, size) in automaton().iter(text):
        at = last - size + 1
        if anchor == "at":
            if at >= done[0] and (hit := _email(text, at, done[0])):
                found.append((0, *hit))
                done[0] = hit[1]
        elif anchor == "digit":
            if at >= runs:  # first digit of a run
                m = _IP.match(text, at) if at >= done[1] else None
                if m:
                    done[1] = m.end()
                    if all(len(q := p.lstrip("0")) <= 3 and int(q or "0") <= 255 for p in m[0].split(".")):
                        found.append((1, at, m.end()))
                runs = at + 1
                while runs < len(text) and "0" <= text[runs] <= "9":
                    runs += 1
                if at >= done[2] and (m := _CARD.match(text, at)):
                    done[2] = m.end()
                    digits = m[0].replace(" ", "").replace("-", "")
                    if 16 <= len(digits) <= 19 and luhn(digits):
                        found.append((2, at, m.end()))
            # an IBAN's check digits follow two capitals
            if at >= max(done[4], 2) and "A" <= text[at - 1] <= "Z" and "A" <= text[at - 2] <= "Z" and (at == 2 or not _WORD.match(text[at - 3])):
                end = iban_end(text, at - 2)
                if end > 0:
                    found.append((4, at - 2, end))
                    done[4] = end
        elif anchor == "plus":
            if at >= done[3] and (m := _PHONE.match(text, at)):
                done[3] = m.end()
                if 8 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                    found.append((3, at, m.end()))
        elif anchor == "scheme":
            if at >= done[5] and (m := _LOGIN.match(text, at)):
                found.append((5, m.start(1), m.end(1)))
                done[5] = m.end(1)
        elif at >= done[4] and (at == 0 or not text[at - 1].isalnum()) and (m := _CUED.match(text, last + 1)):
            found.append((4, m.start(1), m.end(1)))
            done[4] = m.end(1)
    return sorted(found)


def join_spans(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in found)


def redact(text: str, found: list[tuple[int, int, int]]) -> str:
    """The text with each item replaced by its kind in brackets; overlapping items become one, named by the first."""
    out, last = [], 0
    for start, end, kind in sorted(((s, e, k) for k, s, e in found), key=lambda x: (x[0], -x[1], x[2])):
        if start < last:
            last = max(last, end)
            continue
        out += [text[last:start], f"[{KINDS[kind].upper()}]"]
        last = end
    return "".join([*out, text[last:]])


def find(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` of the documents, base counts ``n_email, n_ip, n_card, n_phone``, ``base_sha256`` and ``spans``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            counts, hashes, texts = [[] for _ in BASE], [], []
            for text in part.column("_text").to_pylist():
                found = spans(text)
                base = [x for x in found if x[0] < len(BASE)]
                for k in range(len(BASE)):
                    counts[k].append(sum(x[0] == k for x in base))
                hashes.append(hashlib.sha256(join_spans(base).encode()).hexdigest())
                texts.append(join_spans(found))
            arrays = [*part.columns[:-1], *(pa.array(c, pa.int64()) for c in counts), pa.array(hashes, pa.string()), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*part.schema.names[:-1], *(f"n_{k}" for k in BASE), "base_sha256", "spans"])

    kept = docs.select(*columns, F.coalesce("text", F.lit("")).alias("_text"))
    added = ", ".join([f"n_{k} bigint" for k in BASE] + ["base_sha256 string", "spans string"])
    return arrow_pass(kept, run, schema_with(kept, added, "_text"))


def redacted(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents with every item in ``text`` replaced by its kind; other columns as they are, a null text stays null."""

    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            clean = [x if x is None or not (found := spans(x)) else redact(x, found) for x in part.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(clean, pa.string()) if i == at else c for i, c in enumerate(part.columns)], names=part.schema.names)

    inner = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])  # names of any kind stay outside
    return arrow_pass(inner, run, inner.schema).toDF(*docs.columns)
