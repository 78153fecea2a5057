"""Personal data: an Aho-Corasick pass finds anchors, local parsers expand and check them.

One automaton holds at-signs, plus signs, `://` and cues of identifiers, secrets and street
addresses; runs of digits are anchors too. Only around them do the parsers look at the
text, and what a parser has read as one value it doesn't read again from an anchor
within, so the time is linear in the text, whatever it repeats. Each text is handled on
its own, in code points.

Base kinds (`email`, `ip`, `card`, `phone`) equal leftmost, non-overlapping matches of
their patterns; a match that fails its check is dropped without a retry. Added kinds:

* `phone` again, when digits behind a number made the greedy match too long: the longest
  run of whole digit groups with 10 to 15 digits;
* `url`, `secret` (access keys and values after a cue), `iban` (whole groups that pass
  modulus 97, of the country's length or else the longest), `account` (digits after a cue), `address` (house number and street word).

A url or secret that begins within another one's characters is part of that. `n_private`
counts the spans of all kinds but urls.

Null and empty texts have no spans. Rows, repeated or with a null id, stay as they are.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from kinweave.llm.common import arrow_map, id_and_text

KINDS = ["email", "ip", "card", "phone", "url", "secret", "iban", "account", "address"]
_RANK = {kind: rank for rank, kind in enumerate(KINDS)}

_DIGITS = frozenset("0123456789")
_LETTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
_UPPER = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")
_LOCAL = _LETTERS | _DIGITS | frozenset("._%+-")
_LABEL = _LETTERS | _DIGITS | frozenset("-")
_PHONE = _DIGITS | frozenset(" ().-")
_VALUE = _LETTERS | _DIGITS | frozenset("_-/+.=~")
_URL = frozenset(chr(c) for c in range(0x21, 0x7F)) - frozenset("\"<>`{}|\\^")

SECRET_CUES = ["password", "passwd", "token", "secret", "api_key", "api-key", "apikey"]
ACCOUNT_CUES = ["account", "acct", "konto", "cuenta", "compte"]
STREET_CUES = [" street", " avenue", " road", " boulevard", " lane"]
ACCESS_KEY = "AKIA"
#: Characters of an IBAN by country.
_LENGTHS = (
    "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DK18 DO28 EE20 EG29 ES24 FI18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 "
    "KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 MC27 MD24 ME22 MK19 MR27 MT31 MU30 NL18 NO15 PK24 PL28 PS29 PT25 QA29 RO24 RS22 SA24 SC31 SE24 SI19 SK24 SM27 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20"
)
IBAN_LENGTHS = {entry[:2]: int(entry[2:]) for entry in _LENGTHS.split()}


_DIGIT_RUN = re.compile("[0-9]+")


@lru_cache(maxsize=1)
def _automaton() -> ahocorasick.Automaton:
    machine = ahocorasick.Automaton()
    for sign in "@+":
        machine.add_word(sign, (sign, 1))
    machine.add_word("://", ("url", 3))
    machine.add_word(ACCESS_KEY, ("access", len(ACCESS_KEY)))
    for kind, cues in (("secret", SECRET_CUES), ("account", ACCOUNT_CUES), ("address", STREET_CUES)):
        for cue in cues:
            for form in {cue, cue.upper(), cue.capitalize(), cue.title()}:
                machine.add_word(form, (kind, len(cue)))
    machine.make_automaton()
    return machine


def spans(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Base and added spans as (start, end, kind), each sorted by start and kind."""
    hits: dict[str, list[tuple[int, int]]] = {}
    for last, (kind, length) in _automaton().iter(text):
        hits.setdefault(kind, []).append((last - length + 1, last + 1))
    runs = [run.span() for run in _DIGIT_RUN.finditer(text)]
    if not hits and not runs:
        return [], []
    base = [(s, e, "email") for s, e in _emails(text, hits.get("@", []))]
    base += [(s, e, "ip") for s, e in _addresses(text, runs)]
    chains = _chains(text, runs)
    base += [(s, e, "card") for s, e in chains if _is_card(text[s:e])]
    added = []
    for s, e in _phones(text, hits.get("+", [])):
        if 10 <= _count_digits(text, s, e) <= 15:
            base.append((s, e, "phone"))
        elif cut := _shorter_phone(text, s, e):
            added.append((s, cut, "phone"))
    added += [(s, e, "url") for s, e in _urls(text, hits.get("url", []))]
    added += [(s, e, "secret") for s, e in _secrets(text, hits.get("access", []), hits.get("secret", []))]
    added += [(s, e, "iban") for s, e in _ibans(text, runs)]
    added += [(s, e, "account") for s, e in _accounts(text, hits.get("account", []))]
    added += [(s, e, "address") for s, e in _streets(text, hits.get("address", []))]

    def key(span: tuple[int, int, str]) -> tuple[int, int, int]:
        return span[0], _RANK[span[2]], span[1]

    return sorted(base, key=key), sorted(set(added), key=key)


def _right(text: str, at: int, allowed: frozenset) -> int:
    while at < len(text) and text[at] in allowed:
        at += 1
    return at


def _left(text: str, at: int, allowed: frozenset, floor: int = 0) -> int:
    while at > floor and text[at - 1] in allowed:
        at -= 1
    return at


def _count_digits(text: str, start: int, end: int) -> int:
    return sum(c in _DIGITS for c in text[start:end])


def _emails(text: str, ats: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    free = 0
    for at, after in ats:
        start = _left(text, at, _LOCAL, free)
        end = _right(text, after, _LABEL)
        if start == at or end == after:
            continue
        dots = 0
        while end < len(text) and text[end] == "." and (further := _right(text, end + 1, _LABEL)) > end + 1:
            end, dots = further, dots + 1
        if dots:
            yield start, end
            free = end


def _addresses(text: str, runs: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    at = 0
    while at + 3 < len(runs):
        four = runs[at : at + 4]
        if all(text[a[1]] == "." and b[0] == a[1] + 1 for a, b in zip(four, four[1:])):
            parts = [text[s:e].lstrip("0") for s, e in four]
            if all(len(p) <= 3 and int(p or "0") <= 255 for p in parts):
                yield four[0][0], four[3][1]
            at += 4
        else:
            at += 1


def _chains(text: str, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Digits with at most one blank or hyphen between neighbours."""
    chains: list[tuple[int, int]] = []
    for start, end in runs:
        if chains and chains[-1][1] + 1 == start and text[start - 1] in " -":
            chains[-1] = chains[-1][0], end
        else:
            chains.append((start, end))
    return chains


def _is_card(value: str) -> bool:
    digits = [int(c) for c in value if c in _DIGITS]
    if not 14 <= len(digits) <= 19:
        return False
    doubled = (d * 2 - 9 if d > 4 else d * 2 for d in digits[-2::-2])
    return (sum(digits[-1::-2]) + sum(doubled)) % 10 == 0


def _phones(text: str, pluses: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    for start, after in pluses:
        if after >= len(text) or text[after] not in _DIGITS:
            continue
        end = _right(text, after + 1, _PHONE)
        while end > after and text[end - 1] not in _DIGITS:
            end -= 1
        if end - start >= 4:
            yield start, end


def _shorter_phone(text: str, start: int, end: int) -> int | None:
    best, seen = None, 0
    for at in range(start, end):
        if text[at] in _DIGITS:
            seen += 1
            if seen > 15:
                break
            if seen >= 10 and text[at + 1 : at + 2] not in _DIGITS:
                best = at + 1
    return best


def _urls(text: str, hits: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    read = 0
    for at, after in hits:
        if at < read:
            continue
        start, end = _left(text, at, _LETTERS, read), _right(text, after, _URL)
        read = end
        while end > after and text[end - 1] in ".,;:!?)'":
            end -= 1
        if start < at and end > after:
            yield start, end


def _secrets(text: str, access: list[tuple[int, int]], cues: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    for start, after in access:
        if start and text[start - 1] in _UPPER:
            continue
        end = _right(text, after, _UPPER)
        if end - after == 16:
            yield start, end
    read = 0
    for start, after in cues:
        if start < read:
            continue
        at = _right(text, after, frozenset(" "))
        if at >= len(text) or text[at] not in "=:":
            continue
        at = _right(text, at + 1, frozenset(" \"'"))
        read = end = _right(text, at, _VALUE)
        if end - at >= 8:
            yield at, end


def _ibans(text: str, runs: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Two capitals and two check digits, then 11 to 30 capitals or digits, blanks allowed."""
    for start, end in runs:
        if end - start < 2 or start < 2 or not (text[start - 2].isascii() and text[start - 1].isascii()):
            continue
        head = start - 2
        if not (text[head:start].isalpha() and text[head:start].isupper()) or (head and text[head - 1] in _UPPER):
            continue
        stop, value, best = head, "", None
        while stop < len(text) and len(value) < 34 and (text[stop] in _UPPER or (text[stop] == " " and text[stop + 1 : stop + 2] in _UPPER)):
            value += text[stop].strip()
            stop += 1
            # Behind each group may stand another word or number: the country's length, or else the longest.
            if len(value) >= 15 and text[stop : stop + 1] not in _UPPER and _is_iban(value):
                best = stop
                if len(value) == IBAN_LENGTHS.get(value[:2]):
                    break
        if best:
            yield head, best


def _is_iban(value: str) -> bool:
    return int("".join(str(int(c, 36)) for c in value[4:] + value[:4])) % 97 == 1


def _accounts(text: str, cues: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    for _, after in cues:
        at = after
        while at < len(text) and at - after < 12 and text[at] not in _DIGITS and text[at] != "\n":
            at += 1
        end = _right(text, at, _DIGITS)
        if 8 <= end - at <= 17:
            yield at, end


def _streets(text: str, cues: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """A house number, one to three capitalised words and a street word."""
    for at, after in cues:
        start, words = at, 0
        while words < 3:
            begin = _left(text, start, _LETTERS)
            if begin == start or not text[begin].isupper() or begin == 0 or text[begin - 1] != " ":
                break
            words, start = words + 1, begin - 1
            number = _left(text, start, _DIGITS)
            if number < start:
                if start - number <= 5:
                    yield number, after
                break


def _joined(found: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in found)


SCHEMA = (
    "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, "
    "spans string, n_added long, n_private long"
)


def find_pii(docs: DataFrame) -> DataFrame:
    """One row per row of `docs`: base counts and their digest, all spans, added spans."""

    def work(batch: pa.RecordBatch) -> Iterator[dict]:
        rows: dict[str, list] = {name: [] for name in ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added", "n_private")}
        for text in batch.column("text"):
            base, added = spans(text.as_py() or "")
            for kind in KINDS[:4]:
                rows[f"n_{kind}"].append(sum(found[2] == kind for found in base))
            rows["base_sha256"].append(hashlib.sha256(_joined(base).encode()).hexdigest())
            both = sorted({*base, *added}, key=lambda x: (x[0], _RANK[x[2]], x[1]))
            rows["spans"].append(_joined(both))
            rows["n_added"].append(len(both) - len(base))
            rows["n_private"].append(sum(found[2] != "url" for found in both))
        yield {"doc_id": batch.column("doc_id"), **rows}

    return arrow_map(id_and_text(docs), work, SCHEMA)
