"""Plain restatements of what the corpus operators must return."""

import hashlib
import math
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    if len(w) >= 5:
        return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    return frozenset([tuple(w)]) if w else frozenset()


def components(texts: dict):
    """doc_id -> smallest doc_id that it reaches by links of 75 percent."""
    sets, parent = {d: shingles(t) for d, t in texts.items()}, {d: d for d in texts}

    def root(d):
        while parent[d] != d:
            parent[d] = parent[parent[d]]
            d = parent[d]
        return d

    holding = defaultdict(list)
    for d in sorted(texts):
        shared = Counter(o for s in sets[d] for o in holding[s])
        for o, n in shared.items():
            if 100 * n >= 75 * (len(sets[d]) + len(sets[o]) - n):
                a, b = sorted((root(o), root(d)))
                parent[b] = a
        for s in sets[d]:
            holding[s].append(d)
    return {d: root(d) for d in texts}, {d: len(s) for d, s in sets.items()}


def cuts(texts: dict, length=50):
    """doc_id -> (n_bytes, n_removed, n_spans, sha256 of what is left, what is left)."""
    seen, out = set(), {}
    for d in sorted(texts):
        t = (texts[d] or "").encode()
        own = [t[i : i + length] for i in range(len(t) - length + 1)]
        covered = bytearray(len(t))
        for i, x in enumerate(own):
            if x in seen:
                covered[i : i + length] = b"\1" * length
        seen.update(own)
        left = bytes(b for b, c in zip(t, covered) if not c)
        spans = sum(1 for i, c in enumerate(covered) if c and (not i or not covered[i - 1]))
        out[d] = (len(t), sum(covered), spans, hashlib.sha256(left).hexdigest(), left)
    return out


def quality(text):
    t = text or ""
    w = WORD.findall(t)
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
    return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), failed


def targets(sizes: dict, weights=(5, 2, 1), most=3):
    """Source -> target: shares by weight, stopped at ``most`` times the source, the rest shared again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    free, out, left = set(order), {}, float(sum(sizes.values()))
    while free:
        total = sum(weight[s] for s in free)
        stopped = [s for s in free if left * weight[s] / total >= most * sizes[s]]
        if not stopped:
            return out | {s: left * weight[s] / total for s in free}
        for s in stopped:
            out[s] = float(most * sizes[s])
        left -= sum(out[s] for s in stopped)
        free -= set(stopped)
    return out


def density(node, body):
    """Composite text density of a node, from counts made anew by recursion."""

    def counts(x, in_link=False):
        chars = tags = link_chars = link_tags = 0
        link = in_link or x.tag == "a"
        for y in x.parts:
            if isinstance(y, str):
                chars += len(y.strip())
                link_chars += link * len(y.strip())
            else:
                c, t, lc, lt = counts(y, link)
                chars, tags, link_chars, link_tags = chars + c, tags + t + 1, link_chars + lc, link_tags + lt + (y.tag == "a")
        return chars, tags, link_chars, link_tags

    c, t, lc, lt = counts(node)
    if not c:
        return 0.0
    whole, _, linked, _ = counts(body)
    base = math.log(c / max(c - lc, 1) * lc + linked / max(whole, 1) * c + math.e)
    return c / max(t, 1) * math.log(max(c / max(lc, 1) * max(t, 1) / max(lt, 1), 1.0), max(base, 1.0001))
