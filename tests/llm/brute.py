"""Plain-Python versions of the contracts, for comparison with the operators."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

WS = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WS.findall(text or "")


def lowered(text):
    return re.sub("[A-Z]+", lambda m: m.group().lower(), text or "")


def secrets(text):
    text = text or ""
    assign = r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    found = [(m.start(), 0, m.end()) for m in re.finditer(assign, text) if len(m.group(1)) >= 12]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m.group()) >= 18]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m.group()) >= 16]
    counts = Counter(k for _, k, _ in found)
    joined = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(found))
    return counts[0], counts[1], counts[2], hashlib.sha256(joined.encode()).hexdigest(), joined


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def personal(text):
    text = text or ""
    digits = lambda s: re.sub("[^0-9]", "", s)
    found = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m.group().split("."))]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 14 <= len(digits(m.group())) <= 19 and luhn(digits(m.group()))]
    found += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(digits(m.group())) <= 15]
    counts = Counter(k for _, k, _ in found)
    joined = ",".join(f"{('email', 'ip', 'card', 'phone')[k]}:{a}:{b}" for a, k, b in sorted(found))
    return counts[0], counts[1], counts[2], counts[3], hashlib.sha256(joined.encode()).hexdigest(), joined


def quality(text):
    text = text or ""
    w = words(text)
    lines = [x for x in text.split("\n") if WS.search(x)]
    windows = defaultdict(list)
    for i in range(len(w) - 4):
        windows[tuple(w[i : i + 5])].append(i)
    covered = {j for at in windows.values() if len(at) > 1 for i in at for j in range(i, i + 5)}
    failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed


def shingles(text):
    w = lowered(text)
    w = words(w)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)])


def components(docs):
    """{doc_id: (n_shingles, component_id)}"""
    sets = {d: shingles(t) for d, t in docs}
    up = {d: d for d in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    having = defaultdict(set)
    for d, s in sets.items():
        for x in s:
            having[x].add(d)
    seen = set()
    for members in having.values():
        for a in members:
            for b in members:
                if a < b and (a, b) not in seen:
                    seen.add((a, b))
                    both = len(sets[a] & sets[b])
                    if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                        a2, b2 = root(a), root(b)
                        up[max(a2, b2)] = min(a2, b2)
    return {d: (len(s), root(d)) for d, s in sets.items()}


def dedup(docs, width=20):
    """{doc_id: (n_words, n_removed, kept_sha256)}"""
    first = {}
    rows = sorted(docs)
    for d, t in rows:
        w = words(t)
        for i in range(len(w) - width + 1):
            first.setdefault(tuple(w[i : i + width]), (d, i))
    out = {}
    for d, t in rows:
        w = words(t)
        gone = set()
        for i in range(len(w) - width + 1):
            if first[tuple(w[i : i + width])] < (d, i):
                gone.update(range(i, i + width))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out[d] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def base_scores(docs):
    """{doc_id: (held_out, n_tokens, n_known, N, base_score)}"""
    tokens = {d: [*words(lowered(t)), None] for d, t in docs}
    held = {d: zlib.crc32(str(d).encode()) % 5 == 1 for d, _ in docs}
    counts = Counter(x for d, ts in tokens.items() if not held[d] for x in ts)
    n, v = sum(counts.values()), len(counts)
    return {
        d: (held[d], len(ts), sum(counts[x] > 0 for x in ts), n, sum(math.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in ts))
        for d, ts in tokens.items()
    }


def targets(sizes):
    """{source: target} by sharing again and again."""
    order = sorted(sizes, key=lambda s: (s is None, s.encode() if s is not None else b""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, open_, out = 1.5 * sum(sizes.values()), set(order), {}
    while open_:
        total = sum(weight[s] for s in open_)
        full = [s for s in open_ if left * weight[s] / total > 2 * sizes[s]]
        if not full:
            out |= {s: left * weight[s] / total for s in open_}
            break
        for s in full:
            out[s] = 2.0 * sizes[s]
            open_.discard(s)
        left = 1.5 * sum(sizes.values()) - sum(out.values())
    return out
