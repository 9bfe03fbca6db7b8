"""Plain versions of the text operators: sets, dictionaries and loops over all pairs."""

import math
import re
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import xxhash

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def classes(n, links):
    """Smallest member of the class of each of n nodes."""
    up = list(range(n))

    def root(x):
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    return [root(x) for x in range(n)]


def space_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def letter_words(text):
    return re.findall(r"[0-9a-z\u0080-\U0010ffff]+", (text or "").translate(LOWER))


def in_fold(key, n, fold):
    return crc32(str(key).encode()) % n == fold


# Near copies


def near_copies(texts, width=5, least=0.8):
    """Classes of texts that share at least `least` of their shingles."""
    sets = [(lambda w: frozenset(tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))))(space_words(t)) for t in texts]
    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].append(i)
    links, seen = [], set()
    for group in holders.values():
        for j in group[1:]:
            for i in group[: group.index(j)]:
                if (i, j) not in seen:
                    seen.add((i, j))
                    if len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]) - 1e-12:
                        links.append((i, j))
    return classes(len(texts), links)


# Toxicity: the non-negative risk on dense tables, features counted in dictionaries


def features(text):
    words = {w.encode("utf-8", "surrogatepass") for w in letter_words(text)}
    return words | {b"^" + w[:n] for w in words for n in (4, 5, 6) if len(w) > n}


def toxic_scores(docs, labels, folds=5):
    """docs: (id, text); labels: id -> 0 or 1. Scores by id; for tables within the sample's bounds."""
    learnt = [k for k, _ in docs if not in_fold(k, folds, 0)]
    known = {k: v for k, v in labels.items() if v is not None and not in_fold(k, folds, 0)}
    prior = min(0.5, max(0.01, sum(known.values()) / len(known)))
    has = {k: features(t) for k, t in docs}
    positive = [k for k in learnt if known.get(k) == 1]
    p, u = (Counter(f for k in ks for f in has[k]) for ks in (positive, learnt))
    n_p, n_u = len(positive), len(learnt)

    def z(f):
        share, base = (p[f] + 0.5) / (n_p + 1), (u[f] + 0.5) / (n_u + 1)
        return (share - base) / math.sqrt(base * (1 - base) * (1 / n_p + 1 / n_u) + 1e-12)

    used = sorted(f for f in p if p[f] >= 3 and z(f) >= 4.0)
    table = lambda ks: np.array([[f in has[k] for f in used] + [True] for k in ks], float)
    x_p, x_u = table(positive), table(learnt)
    w = np.zeros(len(used) + 1)
    w[-1] = math.log(prior / (1 - prior))
    m, v = np.zeros_like(w), np.zeros_like(w)
    s = lambda a: 1 / (1 + np.exp(-np.clip(a, -30, 30)))
    for t in range(1, 601):
        f_p, f_u = x_p @ w, x_u @ w
        risk = np.logaddexp(0, f_u).mean() - prior * np.logaddexp(0, f_p).mean()
        fall = x_u.T @ s(f_u) / n_u - prior * x_p.T @ s(f_p) / n_p
        g = fall - prior * x_p.T @ s(-f_p) / n_p if risk >= 0 else -fall
        g[:-1] += 1e-4 * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    weight = dict(zip(used, w, strict=False))
    return {k: 1 / (1 + math.exp(-(w[-1] + sum(weight.get(f, 0.0) for f in has[k])))) for k, _ in docs}


# Class-based n-grams


def shape(word):
    raw = word.encode()
    return min(len(raw) // 3, 3) * 16 + raw[-1] % 16


def brown_scores(texts, held, exchange, words, n_classes, least):
    """(base, score) of each text; exchange is the clustering of the core, tested by itself."""
    lines = [[*space_words(t), "\n"] for t in texts]
    learnt = [x for x, h in zip(lines, held, strict=True) if not h]
    count = Counter(w for x in learnt for w in x)
    total, distinct = sum(count.values()), len(count)
    number = lambda w: xxhash.xxh3_64_intdigest(w.encode())
    signed = lambda n: n - 2**64 if n >= 2**63 else n
    core = sorted(sorted(count, key=lambda w: (-count[w], signed(number(w))))[:words], key=number)
    unit = lambda w: core.index(w) if w in core else len(core) + shape(w)
    size = len(core) + 64
    table = np.zeros((size, size))
    for x in learnt:
        for a, b in zip(["\n", *x], x, strict=False):
            table[unit(a), unit(b)] += 1
    of = exchange(table, n_classes)
    between = np.zeros((n_classes, n_classes))
    for a in range(size):
        for b in range(size):
            between[of[a], of[b]] += table[a, b]
    first = lambda w: int(of[unit(w)])
    soft = between + 0.1
    left, right = defaultdict(Counter), defaultdict(Counter)
    for x in learnt:
        ends = ["\n", *x, "\n"]
        for k, w in enumerate(x):
            left[w][first(ends[k])] += 1
            right[w][first(ends[k + 2])] += 1

    def fit(w, c):
        return sum(n * math.log(soft[k, c] / soft[:, c].sum()) for k, n in left[w].items()) + sum(n * math.log(soft[c, k] / soft[c].sum()) for k, n in right[w].items())

    cls = {w: first(w) if w in core or count[w] < least else max(range(n_classes), key=lambda c: fit(w, c)) for w in {w for x in lines for w in x}}
    moves = np.zeros((n_classes, n_classes))
    for x in learnt:
        for a, b in zip(["\n", *x], x, strict=False):
            moves[cls[a], cls[b]] += 1
    kinds = Counter(cls[w] for w in count)
    out = []
    for x in lines:
        base = score = 0.0
        for a, b in zip(["\n", *x], x, strict=False):
            one = (count[b] + 1) / (total + distinct + 1)
            inside = moves[:, cls[b]].sum()
            share = (count[b] + 1) / (inside + kinds[cls[b]]) if inside else one
            emit = (max(count[b] - 0.75, 0) + 0.75 * kinds[cls[b]] * share) / inside if inside else one
            step = (moves[cls[a], cls[b]] + 0.1) / (moves[cls[a]].sum() + 0.1 * n_classes)
            base += math.log10(one)
            score += math.log10(0.85 * step * emit + 0.15 * one)
        out.append((base, score))
    return out


# Secrets

KINDS = (
    (r"""(?:(?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, "secret"), (r"AKIA([A-Z0-9]+)", 16, "id"), (r"([0-9a-f]+)", 24, "secret"),
    (r"""(?:(?ai:access_?key_?id|client_?id|user_?name|login))["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]{3,})""", 0, "id"), (r"([A-Za-z0-9+/]{40,})", 0, "secret"), (r"(https?://[A-Za-z0-9._:/-]+)", 0, "endpoint"),
)
WANTS = {"id": {"secret"}, "secret": {"id", "endpoint"}, "endpoint": {"id", "secret"}}


def spans(text, scope=256):
    """All spans, weak ones included, each pair looked at."""
    found = [(m.start(), k, m.end()) for k, (pattern, least, _) in enumerate(KINDS) for m in re.finditer(pattern, text or "") if len(m[1]) >= least]
    base = [s for s in found if s[1] < 3]
    some = base + [s for s in found if s[1] >= 3 and not any(b[0] < s[2] and s[0] < b[2] for b in base)]
    near = lambda a, b: a != b and b[0] < a[2] + scope and b[2] > a[0] - scope and KINDS[b[1]][2] in WANTS[KINDS[a[1]][2]]
    return sorted(s for s in some if s[1] < 3 or any(near(s, x) for x in some))


def redacted(text):
    out, at = "", 0
    for start, _, end in spans(text):
        if start >= at:
            out += (text or "")[at:start] + "[REDACTED]"
        at = max(at, end)
    return out + (text or "")[at:]
