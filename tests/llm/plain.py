"""Plain versions of the contracts, text by text."""

import hashlib
import math
import re
import zlib
from collections import Counter

import xxhash

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(text or "")


def base_rules(text):
    text = text or ""
    w = words(text)
    seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = set()
    for i in range(len(w) - 7):
        if seen[tuple(w[i : i + 8])] > 1:
            covered |= set(range(i, i + 8))
    lines = [x for x in text.split("\n") if words(x)]
    failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed


def log_ratios(docs, trusted, buckets=1 << 16, prior=65536.0, below=0.02):
    """Mean log ratio of each document, with its own n-grams left out of the target, and the threshold."""

    def grams(text):
        h = [xxhash.xxh64_intdigest(w.encode(), 42) for w in words(text)]
        two = [xxhash.xxh64_intdigest(b.to_bytes(8, "little"), xxhash.xxh64_intdigest(a.to_bytes(8, "little"), 42)) for a, b in zip(h, h[1:])]
        return Counter(((x ^ 1 << 63) - (1 << 63)) % buckets for x in h + two)

    own = {d: grams(t) for d, t in docs}
    raw, target = Counter(), Counter()
    for d, c in own.items():
        raw.update(c)
        if d in trusted:
            target.update(c)
    r, t, score = sum(raw.values()), sum(target.values()), {}
    for d, c in own.items():
        n, good = sum(c.values()), d in trusted
        total, out = 0.0, t - good * n
        for b, k in c.items():
            p = (raw[b] + 1) / (r + buckets)
            total += k * math.log((target[b] - good * k + prior * p) / ((out + prior) * p))
        score[d] = total / n if n else None
    known = sorted(score[d] for d in trusted if score.get(d) is not None)
    at = below * (len(known) - 1)
    low, high = known[int(at)], known[min(int(at) + 1, len(known) - 1)]
    return score, low + (high - low) * (at - int(at))


def fingerprint(text, k=3):
    w = words((text or "").translate(LOWER))
    s = [" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)) if h else 0


def components(pairs, nodes):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def simhash_components(docs):
    fp = {d: fingerprint(t) for d, t in docs}
    ids = sorted(fp)
    pairs = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if (fp[a] ^ fp[b]).bit_count() <= 2]
    return fp, components(pairs, ids)


def repeated_bytes(texts, length=400):
    data = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in data for i in range(len(b) - length + 1))
    out = []
    for b in data:
        mask = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                mask[i : i + length] = b"\1" * length
        kept = bytes(x for x, m in zip(b, mask) if not m)
        spans = sum(1 for i in range(len(b)) if mask[i] and (i == 0 or not mask[i - 1]))
        out.append((len(b), sum(mask), spans, hashlib.sha256(kept).hexdigest()))
    return out


def passages(texts, length=240, words=50):
    """Maximal runs of bytes covered by repeated strings of length bytes that hold over so many whole words, per text."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in data for i in range(len(b) - length + 1))
    out = []
    for b in data:
        mask = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                mask[i : i + length] = b"\1" * length
        own = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", b)]
        runs = [m.span() for m in re.finditer(b"\1+", bytes(mask))]
        out.append(sum(sum(s <= a and z <= e for a, z in own) > words for s, e in runs))
    return out


def contamination(text, items):
    w = ALNUM.findall((text or "").translate(LOWER))
    hit, found = set(), []
    for item, t in items:
        own = ALNUM.findall((t or "").translate(LOWER))
        windows = {tuple(own[i : i + 10]) for i in range(max(1, len(own) - 9))} if own else set()
        here = False
        for g in windows:
            for p in range(len(w) - len(g) + 1):
                if tuple(w[p : p + len(g)]) == g:
                    hit |= set(range(p, p + len(g)))
                    here = True
        if here:
            found.append("" if item is None else str(item))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()


def base_secrets(text):
    text, spans = text or "", []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m[2]) >= 6:
            spans.append((m.start(), 0, m.end()))
    spans += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    said = ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in sorted(spans))
    n = Counter(k for _, k, _ in spans)
    return n[0], n[1], n[2], hashlib.sha256(said.encode()).hexdigest()


def language_model(docs, discount=0.75):
    """(n_tokens, n_known, N, base, score) by id, of a model of runs of one, two and three tokens."""
    tokens = [(d, words((t or "").translate(LOWER)) + ["\n"]) for d, t in docs]
    count, pairs, triples = Counter(), Counter(), Counter()
    for d, t in tokens:
        if zlib.crc32(str(d).encode()) % 5 != 1:
            count.update(t)
            pairs.update(zip([None, *t], t))
            triples.update(zip([None, *t], t, [*t[1:], None]))
            count[None] += 1
    texts = count.pop(None, 0)
    total, size = sum(count.values()), len(count)
    after_word, after_pair = Counter(a for a, _ in pairs), Counter((a, b) for a, b, _ in triples)

    def own(w):
        return (count[w] + 0.5) / (total + 0.5 * (size + 1))

    def two(a, w):
        n = texts if a is None else count[a]
        return max(pairs[a, w] - discount, 0) / n + discount * after_word[a] / n * own(w) if n else own(w)

    def three(z, a, w):
        n = pairs[z, a]
        return max(triples[z, a, w] - discount, 0) / n + discount * after_pair[z, a] / n * two(a, w) if n else two(a, w)

    def log_of(t):
        return sum(math.log10(two(None, w) if i == 0 else three(t[i - 2] if i > 1 else None, t[i - 1], w)) for i, w in enumerate(t))

    return {d: (len(t), sum(count[w] > 0 for w in t), total, sum(math.log10(own(w)) for w in t), log_of(t)) for d, t in tokens}


def nearest_language(text, model):
    """(language, cosine) by the nearest centroid, from trigrams of letters one by one."""
    clean = [32] + [b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in (text or "").encode()] + [32]
    tf = Counter(((a | b << 8 | c << 16) * 2654435761 & 0xFFFFFFFF) >> 20 for a, b, c in zip(clean, clean[1:], clean[2:]))
    v = {d: math.log1p(n) * float(model.idf[d]) for d, n in tf.items()}
    norm = math.sqrt(sum(x * x for x in v.values())) or 1.0
    cos = [sum(x * float(c[d]) for d, x in v.items()) / norm for c in model.centroids]
    best = max(range(len(cos)), key=lambda i: cos[i])
    return (model.langs[model.owner[best]], min(1.0, max(0.0, cos[best]))) if any(ch.isalpha() for ch in text or "") else ("und", 0.0)


def near_groups(docs, k=5, least=0.8):
    sets = {}
    for d, t in docs:
        w = words((t or "").translate(LOWER))
        sets[d] = frozenset(" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1)))
    ids = sorted(sets)
    pairs = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b])]
    return components(pairs, ids)
