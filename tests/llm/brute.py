"""Plain definitions of the contracts, one text at a time, to hold the operators against."""

import hashlib
import re
from collections import Counter

SPACE_WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def luhn(digits):
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + place % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def fits(kind, found):
    digits = re.sub("[^0-9]", "", found)
    if kind == "ip":
        return all(int(p[-4:]) <= 255 and not p[:-4].strip("0") for p in found.split("."))
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 10 <= len(digits) <= 15


def pii(text):
    """Counts by kind, the digest and the base spans."""
    found = [(m.start(), rank, m.end(), kind) for rank, (kind, p) in enumerate(BASE.items()) for m in p.finditer(text or "") if fits(kind, m[0])]
    spans = [f"{kind}:{start}:{end}" for start, _, end, kind in sorted(found)]
    counts = Counter(f[3] for f in found)
    return [counts[k] for k in BASE], hashlib.sha256(",".join(spans).encode()).hexdigest(), spans


PHRASES = {("mit", "license"): "mit", ("apache", "license"): "apache", ("general", "public", "license"): "gpl"}


def licences(text):
    words = ALNUM_WORD.findall(lower(text))
    hits = [(i, label) for phrase, label in PHRASES.items() for i in range(len(words)) if tuple(words[i : i + len(phrase)]) == phrase]
    places = [i for i, _ in hits]
    return len(words), len(hits), min(places, default=None), max(places, default=None), ",".join(sorted({label for _, label in hits}))


def quality(text):
    text = text or ""
    words = SPACE_WORD.findall(text)
    lines = [line for line in text.split("\n") if SPACE_WORD.search(line)]
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(3)}
    symbols = sum(c in "#*$%&|<>" for c in text)
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered), failed


def greedy(word, pieces, longest):
    """(pieces, unknown bytes) by longest match from the left."""
    at = count = unknown = 0
    while at < len(word):
        size = next((n for n in range(min(longest, len(word) - at), 0, -1) if word[at : at + n] in pieces), 0)
        unknown += size == 0
        at += size or 1
        count += 1
    return count, unknown


def shingles(text, size):
    words = SPACE_WORD.findall(lower(text))
    if len(words) < size:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def components(ids, links):
    """The smallest id reachable from each; links are pairs of places."""
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        root[find(a)] = find(b)
    best = {}
    for place, value in enumerate(ids):
        if value is not None:
            best[find(place)] = min(best.get(find(place), value), value)
    return [best.get(find(place)) for place in range(len(ids))]


def linked(texts, size, percent):
    sets = [shingles(t, size) for t in texts]
    return [
        (a, b)
        for a in range(len(sets))
        for b in range(a)
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])
    ]


def removed_lines(docs, min_words):
    """docs: (id, text) with different ids. Numbers of removed lines by id, from all pairs of runs."""
    place = sorted(docs, key=lambda d: (d[0] is None, d[0] or 0))
    lines = []
    for doc_id, text in place:
        kept = [(n, line) for n, line in enumerate((text or "").split("\n")) if SPACE_WORD.search(line)] if text is not None else []
        lines.append((doc_id, kept))
    seen, gone = {}, {doc_id: set() for doc_id, _ in docs}
    for order, (doc_id, kept) in enumerate(lines):
        for start in range(len(kept)):
            for end in range(start + 1, len(kept) + 1):
                run = tuple(line for _, line in kept[start:end])
                if sum(len(SPACE_WORD.findall(line)) for line in run) < min_words:
                    continue
                if seen.setdefault(run, (order, start)) != (order, start):
                    gone[doc_id].update(n for n, _ in kept[start:end])
    return gone


def poisson(u, rate):
    import math

    k, total, log_p = 0, math.exp(-rate), -rate
    while total <= u:
        k += 1
        log_p += math.log(rate) - math.log(k)
        total += math.exp(log_p)
    return k
