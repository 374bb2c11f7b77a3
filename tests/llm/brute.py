"""Plain Python forms of the corpus operators' contracts."""

import collections
import hashlib
import re

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BENCH_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
KINDS = ["email", "ip", "card", "phone"]


def lower_ascii(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def fingerprint(text, shingle=3, seed=42):
    w = WORD.findall(lower_ascii(text))
    if not w:
        return 0
    parts = [" ".join(w[i : i + shingle]) for i in range(max(1, len(w) - shingle + 1))]
    hashes = [xxhash.xxh64_intdigest(p.encode(), seed) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(parts))


def classes(nodes, linked):
    """Least member of each node's component."""
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in linked:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    return {n: find(n) for n in nodes}


def repeated(texts, length):
    """(n_bytes, n_removed, n_spans, kept_sha256) per text."""
    data = [(t or "").encode() for t in texts]
    seen = collections.Counter(hash(d[p : p + length]) for d in data for p in range(len(d) - length + 1))
    out = []
    for d in data:
        hit = bytearray(len(d))
        for p in range(len(d) - length + 1):
            if seen[hash(d[p : p + length])] > 1:
                hit[p : p + length] = b"\1" * length
        spans = sum(1 for i, h in enumerate(hit) if h and (i == 0 or not hit[i - 1]))
        out.append((len(d), sum(hit), spans, hashlib.sha256(bytes(b for b, h in zip(d, hit, strict=True) if not h)).hexdigest()))
    return out


def leaks(text, items):
    windows = collections.defaultdict(set)
    for i, t in items:
        w = BENCH_WORD.findall(lower_ascii(t))
        for k in range(max(1, len(w) - 12) if w and i is not None else 0):
            windows[tuple(w[k : k + 13])].add(str(i))
    w, hit, got = BENCH_WORD.findall(lower_ascii(text)), set(), set()
    for n in {len(k) for k in windows}:
        for k in range(len(w) - n + 1):
            if found := windows.get(tuple(w[k : k + n])):
                hit |= set(range(k, k + n))
                got |= found
    return len(w), len(hit), len(got), hashlib.sha256(",".join(sorted(got)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def personal(text):
    x, out = text or "", []
    digits = lambda s: re.sub("[^0-9]", "", s)
    out += [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", x)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", x) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", x) if 12 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", x) if 9 <= len(digits(m[0])) <= 15]
    shown = ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(out))
    return *(sum(o[1] == k for o in out) for k in range(4)), hashlib.sha256(shown.encode()).hexdigest()


def rules(text):
    t = text or ""
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    windows = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = {i + k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)}
    failed = len(w) < 50 or 100 * len(hit) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit), failed
