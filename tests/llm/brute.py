"""Plain Python versions of what the operators return, for small tables."""
from __future__ import annotations

import collections
import hashlib
import re
import zlib

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ITEM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}
ASSIGN = re.compile(
    r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]"
    r"|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
PII = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
       "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
       "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def sha(spans) -> str:
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()


def secrets(text):
    t = text or ""
    found = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    found.sort()
    n = collections.Counter(k for _, _, k, _ in found)
    return n["assign"], n["access"], n["hex"], sha([(k, a, b) for a, _, k, b in found])


def leaks(docs, items):
    windows = collections.defaultdict(set)
    for item, text in items:
        w = ITEM_WORD.findall((text or "").translate(LOWER))
        for j in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[j:j + 10])].add(item)
    out = []
    for doc, text in docs:
        w = ITEM_WORD.findall((text or "").translate(LOWER))
        hit, found = set(), set()
        for n in {len(k) for k in windows}:
            for j in range(len(w) - n + 1):
                if tuple(w[j:j + n]) in windows:
                    hit.update(range(j, j + n))
                    found |= windows[tuple(w[j:j + n])]
        ids = sorted(str(i) for i in found if i is not None)
        out.append((doc, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return out


def quality(text):
    t = text or ""
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    places = collections.defaultdict(list)
    for j in range(len(w) - 7):
        places[tuple(w[j:j + 8])].append(j)
    hit = {j + k for p in places.values() if len(p) > 1 for j in p for k in range(8)}
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)),
            len(hit), len(w) < 20 or 100 * len(hit) > 30 * len(w))


def pii_spans(text):
    def good(kind, s):
        digits = [int(c) for c in s if c in "0123456789"]
        if kind == "ip":
            parts = [x.lstrip("0") or "0" for x in s.split(".")]  # of any length
            return all(len(x) <= 3 and int(x) <= 255 for x in parts)
        if kind == "card":
            total = sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(reversed(digits)))
            return 16 <= len(digits) <= 19 and total % 10 == 0
        return kind == "email" or 8 <= len(digits) <= 15
    return [(k, m.start(), m.end()) for k, p in PII.items() for m in re.finditer(p, text or "") if good(k, m[0])]


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[j:j + 5]) for j in range(max(1, len(w) - 4))) if w else frozenset()


def near_duplicates(docs, percent=85):
    """docs of distinct ids: {doc_id: (n_shingles, component_id, kept)} by all pairs."""
    sets = {d: shingles(t) for d, t in docs}
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), root(d), root(d) == d) for d in ids}


def lines(text):
    """(words, start, end) of each physical line, wrapped at ends of sentences."""
    out, last = [], None
    for m in WORD.finditer(text or ""):
        if last is None or "\n" in text[last.end():m.start()] or last[0][-1] in ".!?":
            out.append([[], m.start(), m.end()])
        out[-1][0].append(m[0])
        out[-1][2] = m.end()
        last = m
    return [(tuple(w), a, b) for w, a, b in out]


def manifest(rows):
    """rows (doc_id, text, lang, source, n_chars): (doc_id, leaf, subroot, root, proof_sha256,
    folded_root, verified) of each, by growing whole trees."""
    def sha256(text):
        return hashlib.sha256(text.encode()).hexdigest()

    def leaf(doc, text, lang, source, chars):
        return sha256("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc, source, lang, chars, text)))

    def tree(level):
        """Levels from the leaves to the root."""
        out = [level]
        while len(out[-1]) > 1:
            out.append([sha256("".join(out[-1][j:j + 3])) for j in range(0, len(out[-1]), 3)])
        return out

    def way(levels, at):
        """(left, right) siblings from a leaf to the root."""
        for level in levels[:-1]:
            first = at // 3 * 3
            yield level[first:at], level[at + 1:first + 3]
            at //= 3
    groups = collections.defaultdict(list)
    for r in rows:
        groups[r[3]].append((r[0] is not None, r[0] or 0, leaf(*r), r))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x[2] for x in sorted(groups[s])]) for s in order}
    top = tree([trees[s][-1][0] for s in order]) if order else []
    out = []
    for place, s in enumerate(order):
        for at, (_, _, digest, r) in enumerate(sorted(groups[s])):
            steps = [*way(trees[s], at), *way(top, place)]
            h = digest
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[1] is not None:
                h = leaf(r[0], r[1].replace("\n", ""), *r[2:])
            for left, right in steps:
                h = sha256("".join([*left, h, *right]))
            proof = sha256("".join(x for left, right in steps for x in left + right))
            out.append((r[0], digest, trees[s][-1][0], top[-1][0], proof, h, h == top[-1][0]))
    return out
