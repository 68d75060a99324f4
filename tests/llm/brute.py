"""Plain-Python versions of the operators' results, for small inputs."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from hashlib import sha256

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def ascii_lower(text: str) -> str:
    return text.encode().lower().decode()


def fold(doc_id, n: int) -> int:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % n


def conversations(rows):
    """conv_id -> (n_turns, turns_sha256, loss_chars, loss_sha256) from (conv_id, turn, role, text)."""
    low = lambda x: (x is not None, x or "")
    out = {}
    for c in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == c), key=lambda r: (r[1] is not None, r[1] or 0, low(r[2]), low(r[3])))
        said = [(r[2] or "", r[3] or "") for r in own]
        loss = "".join(t for role, t in said if role == "assistant")
        out[c] = (len(said), sha256("".join(f"{r}\n{t}\n" for r, t in said).encode()).hexdigest(), len(loss), sha256(loss.encode()).hexdigest())
    return out


def neighbours(rows, k: int = 20, every: int = 20):
    """query -> [(vec_id, score)] from (vec_id, vector), all valid."""
    ids = np.array([r[0] for r in rows])
    x = np.stack([r[1] for r in rows]).astype(np.float64)
    out = {}
    for q in np.flatnonzero(ids % every == 0):
        s = (x * x[q]).sum(1)
        order = [i for i in np.lexsort((ids, -s)) if i != q][:k]
        out[int(ids[q])] = [(int(ids[i]), float(s[i])) for i in order]
    return out


def secrets(text: str | None):
    """(n_assign, n_access, n_hex, base_sha256, base spans)."""
    text = text or ""
    found = []
    for m in re.finditer(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""".replace("(?i:", "(?ai:"), text):
        if len(m[1]) >= 8:
            found.append((m.start(), 0, m.end()))
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    spans = [f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in sorted(found)]
    n = Counter(k for _, k, _ in found)
    return n[0], n[1], n[2], sha256(",".join(spans).encode()).hexdigest(), spans


def unigram(docs):
    """Per (doc_id, text): (held_out, n_tokens, n_known, N, base score)."""
    words = lambda t: WORD.findall(ascii_lower(t or ""))
    counts: Counter = Counter()
    for i, t in docs:
        if fold(i, 10):
            counts.update([*words(t), None])
    n, v = sum(counts.values()), len(counts)
    out = []
    for i, t in docs:
        own = [*words(t), None]
        out.append((i, fold(i, 10) == 0, len(own), sum(w in counts for w in own), n, sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own)))
    return out


def ppm_logs(train: list[bytes], texts: list[bytes], order: int = 4) -> list[float]:
    """PPM, method C with exclusion, symbol by symbol over dictionaries."""
    tries: list[dict] = [{} for _ in range(order + 1)]

    def symbols(t):
        return [256] * order + list(t.lower()) + [256]

    for t in train:
        s = symbols(t)
        for i in range(order, len(s)):
            for k in range(order + 1):
                tries[k].setdefault(tuple(s[i - k : i]), Counter())[s[i]] += 1
    out = []
    for t in texts:
        s, total = symbols(t), 0.0
        for i in range(order, len(s)):
            excluded: set = set()
            for k in range(order, -1, -1):
                node = tries[k].get(tuple(s[i - k : i]))
                if not node:
                    continue
                left = {x: c for x, c in node.items() if x not in excluded}
                if not left:
                    continue
                n = sum(left.values()) + len(left)
                if s[i] in left:
                    total += math.log10(left[s[i]] / n)
                    break
                total += math.log10(len(left) / n)
                excluded |= set(left)
            else:
                total -= math.log10(257 - len(excluded))
        out.append(total)
    return out


def shingle_set(text: str | None) -> frozenset:
    w = WORD.findall(ascii_lower(text or ""))
    n = min(5, len(w))
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if n else frozenset()


def components(docs, percent: int = 85):
    """doc_id -> component_id, by comparing all pairs; (doc_id, text)."""
    sets = [(i, shingle_set(t)) for i, t in docs if i is not None]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    holders: dict = {}
    for k, (_, s) in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(k)
    for k, (i, s) in enumerate(sets):
        shared = Counter(o for x in s for o in holders[x] if o > k)
        for o, both in shared.items():
            if 100 * both >= percent * (len(s) + len(sets[o][1]) - both):
                a, b = sorted((find(i), find(sets[o][0])))
                root[b] = a
    return {i: find(i) for i in root}


def contaminated(text: str | None, items: list, similarity: float = 0.8) -> dict:
    """item -> largest weighted similarity of a window of its length, over all starts; items: (id, shingle Counter, shingles)."""
    w = re.findall(r"[^\W_]+", (text or "").lower())
    sh = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    out: dict = {}
    for item_id, counts, order in items:
        if len({s for s in sh if s in counts}) < similarity * len(counts) * 0.5:
            continue
        for start in range(1 - len(order), len(sh)):
            part = Counter(sh[max(0, start) : max(0, start + len(order))])
            both = sum((part & counts).values())
            if both and both >= similarity * sum((part | counts).values()):
                out[item_id] = max(out.get(item_id, 0), both / sum((part | counts).values()))
    return out


def item_shingles(items):
    out = []
    for i, t in items:
        w = re.findall(r"[^\W_]+", (t or "").lower())
        order = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        if order:
            out.append((i, Counter(order), order))
    return out


def chat_windows(tokens: list[int], system: bool, budget: int, history: int) -> list[tuple[list[int], list[int]]]:
    """(repeated, own) turn numbers of each window, by trying sums of whole lists anew."""
    out, own, repeated, cost = [], [], [], lambda turns: sum(tokens[t] for t in turns)
    first = [0] if system else []
    for t in range(len(tokens)):
        if own and cost(repeated + own) + tokens[t] > budget:
            out.append((repeated, own))
            before = [p for p in range(len(first), t)]
            fits = [n for n in range(len(before) + 1) if cost(before[len(before) - n :]) <= min(history, max(0, budget - tokens[t] - cost(first)))]
            n = max(fits)
            repeated, own = first + before[len(before) - n :], []
        own = [*own, t]
    return [*out, (repeated, own)] if own else out


def mixture_targets(docs) -> dict:
    """source -> (size, target) of (text, source), by fractions and one cap at a time."""
    from fractions import Fraction

    size: dict = {}
    for text, source in docs:
        size[source] = size.get(source, 0) + len(WORD.findall(text or ""))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, free, out = Fraction(3 * sum(size.values()), 2), set(order), {}
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        worst = max(free, key=lambda s: share[s] - 2 * size[s])
        if share[worst] <= 2 * size[worst]:
            return {s: (size[s], float(out.get(s, share.get(s)))) for s in order}
        out[worst] = 2 * size[worst]
        left -= out[worst]
        free.remove(worst)
    return {s: (size[s], float(out[s])) for s in order}


def kernel(a: str, b: str) -> float:
    """Normalised number of distinct 1- to 3-grams that two texts share; what is no letter is a blank."""

    def grams(t):
        t = "".join(c if c.isalpha() else " " for c in t.lower())
        return {t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)}

    x, y = grams(a), grams(b)
    return len(x & y) / math.sqrt(len(x) * len(y))
