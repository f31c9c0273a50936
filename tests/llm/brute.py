"""Plain versions of the operators, for small tables."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rules(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    seen = Counter(windows)
    inside = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(5)}
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside)


def digest(spans, kinds):
    spans = sorted(spans)
    return hashlib.sha256(",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in spans).encode()).hexdigest()


ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)


def secrets(text):
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if m.end() - m.start() >= 24]
    return [sum(k == i for _, k, _ in found) for i in range(3)], digest(found, ["assign", "access", "hex"])


PII = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def personal(text):
    text, found = text or "", []
    for k, p in enumerate(PII):
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            ok = [True, k != 1 or all(int(x) <= 255 for x in m[0].split(".")), k != 2 or 14 <= len(d) <= 19 and luhn(d), k != 3 or 10 <= len(d) <= 15]
            if all(ok):
                found.append((m.start(), k, m.end()))
    return [sum(k == i for _, k, _ in found) for i in range(4)], digest(found, ["email", "ip", "card", "phone"])


def line_dedup(rows):
    """[(doc_id, text)] -> [(doc_id, text, removed)]; rows of one id and text are one document."""
    first, gone = {}, defaultdict(set)
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    docs = sorted({key(r) for r in rows if r[1] is not None})
    told = {d: [i for i, x in enumerate(d[2].split("\n")) if x.strip()] for d in docs}
    for d in docs:
        lines, t = d[2].split("\n"), told[d]
        for j in range(len(t) - 2):
            w = tuple(lines[i] for i in t[j : j + 3])
            if first.setdefault(w, (d, j)) != (d, j):
                gone[d] |= set(t[j : j + 3])
    out = []
    for r in rows:
        if r[1] is None:
            out.append((r[0], None, 0))
        else:
            g = gone[key(r)]
            out.append((r[0], "\n".join(x for i, x in enumerate(r[1].split("\n")) if i not in g), len(g)))
    return out


def shingles(text):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else None


def jaccard(rows):
    """[(doc_id, text)] -> {place: (class as a frozenset of places, links)}."""
    sets = [shingles(t) for _, t in rows]
    link = defaultdict(set)
    for i, a in enumerate(sets):
        for j in range(i + 1, len(sets)):
            b = sets[j]
            if a and b and 10 * len(a & b) >= 8 * len(a | b):
                link[i].add(j)
                link[j].add(i)
    out, seen = {}, set()
    for i in range(len(rows)):
        if i in seen:
            continue
        group, todo = {i}, [i]
        while todo:
            for j in link[todo.pop()] - group:
                group.add(j)
                todo.append(j)
        seen |= group
        for j in group:
            out[j] = (frozenset(group), len(link[j]))
    return out


def windows(rows, span=20):
    """[(doc_id, text)] -> [(words, removed, kept words)]; rows of one id and text are one document; null ids come first."""
    docs = sorted({(r[0] is not None, r[0] or 0, r[1] or "") for r in rows})
    first, later = {}, defaultdict(set)
    for d in docs:
        w = WORD.findall(d[2])
        for i in range(len(w) - span + 1):
            first.setdefault(tuple(w[i : i + span]), (d, i))
    for d in docs:
        w = WORD.findall(d[2])
        for i in range(len(w) - span + 1):
            if first[tuple(w[i : i + span])] != (d, i):
                later[d] |= set(range(i, i + span))
    out = []
    for r in rows:
        d = (r[0] is not None, r[0] or 0, r[1] or "")
        w = WORD.findall(d[2])
        out.append((len(w), len(later[d]), [x for i, x in enumerate(w) if i not in later[d]]))
    return out


def kmeans(rows, k=16, rounds=3, size=64, scale=64, seed=1):
    """[(vec_id, vector)] -> ([(vec_id, cluster, distance)], centroids), all distances measured."""
    sound = [(i, [math.floor(Fraction(x) * scale) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    packed = lambda v: b"".join(x.to_bytes(4, "little", signed=True) for x in v) if all(abs(x) < 2**22 for x in v) else ",".join(map(str, v)).encode()
    order = sorted(sound, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), packed(r[1])))
    cents = [v for _, v in order[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for n in range(rounds + 1):
        at = [min(range(len(cents)), key=lambda c: (far(v, cents[c]), c)) for _, v in sound]
        if n < rounds:
            for c in range(len(cents)):
                mine = [v for (_, v), a in zip(sound, at, strict=True) if a == c]
                if mine:
                    cents[c] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    return [(i, a, far(v, cents[a])) for (i, v), a in zip(sound, at, strict=True)], cents


def importance(rows, target, order=1, buckets=10_000, share=10, least=20, seed=2024):
    """[(doc_id, text)], [text] -> [(doc_id, features, weight, score)] in the rows' order, and the ids drawn, best first."""

    def features(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return w, [" ".join(w[i : i + n]) for n in range(1, order + 1) for i in range(len(w) - n + 1)]

    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (Counter(bucket(f) for x in side for f in features(x)[1]) for side in ([r[1] for r in rows], target))
    all_s, all_t = sum(s.values()) + buckets, sum(t.values()) + buckets
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * all_s / ((s[b] + 1) * all_t)))
    out, able = [], []
    for i, text in rows:
        w, f = features(text)
        weight = math.floor(sum(gain(bucket(x)) for x in f) / len(f)) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
        if len(w) >= least:
            able.append((-out[-1][3], i is not None, i or 0))
    return out, [i if there else None for _, there, i in sorted(able)[: share * len(able) // 100]]
