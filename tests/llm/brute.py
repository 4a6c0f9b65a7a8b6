"""Plain versions of the operators, by definition and without regard to speed."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import regex


def lower(text):
    return "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in text)


def components(nodes, links):
    label = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            least = min(label[a], label[b])
            changed |= label[a] != label[b]
            label[a] = label[b] = least
    return label


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def encoded(texts, name, end_id=2):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path(name))
    library.encode_special_tokens = True
    return [library.encode(t or "", add_special_tokens=False).ids + [end_id] for t in texts]


def url(address):
    rules = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
    host = path = ""
    if address and "://" in address:
        rest = address.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = lower(host)
    best = None
    for verdict, text in rules:
        rule_host, rule_path = text[: text.index("/")], text[text.index("/") :]
        if (host == rule_host or host.endswith("." + rule_host)) and path.startswith(rule_path):
            if best is None or len(text) > len(best[1]):
                best = (verdict, text)
    return host, path, best


def cosine_links(vectors, threshold=0.93):
    """``vectors``: list of ``(id, vector, label)``, sound ones only; pairs of ids."""
    out = []
    for (a, x, la), (b, y, lb) in combinations(vectors, 2):
        x, y = np.array(x, float), np.array(y, float)
        if la == lb and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= threshold:
            out.append((a, b))
    return out


def contamination(texts, items, window=10):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = defaultdict(set)
    for item, text in items:
        w = word.findall(lower(text or ""))
        n = min(window, len(w))
        for s in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[s : s + n])].add(item)
    out = []
    for text in texts:
        w, hit, found = word.findall(lower(text or "")), set(), set()
        for n in {len(k) for k in windows}:
            for s in range(len(w) - n + 1):
                if tuple(w[s : s + n]) in windows:
                    hit.update(range(s, s + n))
                    found |= windows[tuple(w[s : s + n])]
        listed = ",".join(sorted(map(str, found)))
        out.append((len(w), len(hit), len(found), hashlib.sha256(listed.encode()).hexdigest(), bool(hit)))
    return out


def _luhn(digits):
    if not 16 <= len(digits) <= 19:
        return False
    doubled = [int(x) * (1 + k % 2) for k, x in enumerate(reversed(digits))]
    return sum(v - 9 if v > 9 else v for v in doubled) % 10 == 0


PERSONAL = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda v: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda v: all(int(x) <= 255 for x in v.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda v: _luhn(re.sub("[^0-9]", "", v))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: 8 <= len(re.sub("[^0-9]", "", v)) <= 15),
)


def personal(text):
    return [(k, m.start(), m.end()) for k, p, ok in PERSONAL for m in re.finditer(p, text or "") if ok(m[0])]


def disclosed(texts, disclosure=0.8, least=3):
    """Per text the spans of terms that give away one of its entities, by counts over whole texts."""
    entities = [{f"{k}:{(t or '')[a:b]}" for k, a, b in personal(t)} for t in texts]
    words = [set(regex.findall(r"\p{L}{4,}", (t or "").lower())) for t in texts]
    n = len(texts)
    n_entity = Counter(e for own in entities for e in own)
    n_term = Counter(w for own in words for w in own)
    both = Counter((e, w) for own, held in zip(entities, words) for e in own for w in held)
    telling = defaultdict(set)
    for (e, w), k in both.items():
        information = math.log2(n / n_entity[e])
        if k >= least and information > 0 and math.log2(k * n / (n_term[w] * n_entity[e])) >= disclosure * information:
            telling[e].add(w)
    out = []
    for t, own in zip(texts, entities):
        wanted = set().union(*[telling[e] for e in own])
        out.append([("term", m.start(), m.end()) for m in regex.finditer(r"(?<!\p{L})\p{L}{4,}(?!\p{L})", t or "") if m[0].lower() in wanted])
    return out


def repeats(docs, length=50):
    """``docs``: ``(id, text)``; per document bytes, removed bytes, spans and what is kept."""
    data = [(np.inf if i is None else i, (t or "").encode()) for i, t in docs]
    first = {}
    for i, b in data:
        for k in range(len(b) - length + 1):
            first[b[k : k + length]] = min(i, first.get(b[k : k + length], np.inf))
    out = []
    for i, b in data:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            if first[b[k : k + length]] < i:
                gone[k : k + length] = True
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        out.append((len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def shingles(text, size=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text or ""))
    if len(w) < size:
        return frozenset([tuple(w)] if w else [])
    return frozenset(tuple(w[k : k + size]) for k in range(len(w) - size + 1))


def near_copies(docs, percent=80, size=4):
    """``docs``: ``(id, text)`` with different ids; sizes of the sets and components."""
    sets = {i: shingles(t, size) for i, t in docs}
    links = [
        (a, b) for (a, x), (b, y) in combinations(sets.items(), 2) if x & y and 100 * len(x & y) >= percent * len(x | y)
    ]
    label = components(sets, links)
    return {i: (len(s), label[i]) for i, s in sets.items()}
