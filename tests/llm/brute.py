"""Plain versions of the operators' contracts, for small inputs."""

import hashlib
import math
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BIG = 1 << 63


def removed(rows):
    docs = [(BIG if d is None else d, WORD.findall(t or "")) for d, t in rows]
    first = {}
    for d, w in docs:
        for i in range(len(w) - 12):
            k = tuple(w[i : i + 13])
            first[k] = min(first.get(k, BIG + 1), d)
    out = []
    for (own, _), (d, w) in zip(rows, docs, strict=True):
        gone = [False] * len(w)
        for i in range(len(w) - 12):
            if first[tuple(w[i : i + 13])] < d:
                gone[i : i + 13] = [True] * 13
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((own, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def shingles(text):
    w = WORD.findall((text or "").translate(LOW))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def components(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    held, own = defaultdict(list), {}
    for i, s in enumerate(sets):
        if rows[i][0] is None:
            continue
        if s:  # rows of one id are one node
            parent[find(i)] = find(own.setdefault(rows[i][0], i))
        for j, n in Counter(j for x in s for j in held[x]).items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                parent[find(i)] = find(j)
        for x in s:
            held[x].append(i)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [(d, len(sets[i]), None if d is None else least[find(i)], d is None or least[find(i)] == d) for i, (d, _) in enumerate(rows)]


PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    doubled = [int(c) * (1 + k % 2) for k, c in enumerate(reversed(digits))]
    return sum(v - 9 if v > 9 else v for v in doubled) % 10 == 0


def pii_spans(text):
    out = []
    for kind, pattern in PII.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": True,
                "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")),
                "card": 13 <= len(digits) <= 19 and luhn(digits),
                "phone": 9 <= len(digits) <= 15,
            }
            if good[kind]:
                out.append((kind, m.start(), m.end()))
    return out


def quality(text):
    text = text or ""
    w = WORD.findall(text)
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    counts, repeated = Counter(windows), set()
    for i, x in enumerate(windows):
        if counts[x] > 1:
            repeated |= set(range(i, i + 5))
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(w) < 10 or 100 * len(repeated) > 20 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated), failed


def leaks(docs, items):
    low = [(i, WORD.findall((t or "").lower())) for i, t in items]
    grams = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    union = defaultdict(set)
    for d, t in docs:
        if d is not None:
            union[d] |= grams(WORD.findall((t or "").lower()))
    return {(d, i) for d, s in union.items() for i, w in low if i is not None and (g := grams(w)) and len(g & s) >= 0.75 * len(g) - 1e-9}


def hashed(seed, *words):
    """xxhash64 of strings in a row, as a signed number."""
    import xxhash

    for w in words:
        seed = xxhash.xxh64(w.encode(), seed & (1 << 64) - 1).intdigest()
    return seed - (1 << 64) if seed >> 63 else seed


def llr(rows, good_ids, buckets, threshold):
    """(score to 5 digits, kept) of every row."""
    grams = []
    for d, t in rows:
        w = WORD.findall(t or "")
        grams.append((d in good_ids and d is not None, [hashed(42, x) % buckets for x in w] + [hashed(42, a, b) % buckets for a, b in zip(w, w[1:], strict=False)]))
    raw, good = Counter(b for _, g in grams for b in g), Counter(b for mine, g in grams for b in g if mine)
    tr, tg = sum(raw.values()), sum(good.values())
    ratio = lambda b: math.log((good[b] + 1) / (max(raw[b] - 1, 0) * tg / tr + 1)) if tg else 0.0
    out = []
    for (_, t), (_, g) in zip(rows, grams, strict=True):
        score = sum(map(ratio, g)) / len(g) if g else 0.0
        out.append((score, not quality(t)[-1] and score >= threshold))
    return out


def disclosed(rows, disclosure=0.9, evidence=2):
    """Terms that tell enough of an entity, from counts over documents."""
    holds, terms = [], []
    for _, t in rows:
        t = t or ""
        holds.append({f"{k}:{t[a:b]}" for k, a, b in pii_spans(t)})
        bare = re.sub(PII["email"], " ", t)
        terms.append({x.lower() for x in re.findall(r"[^\W_]+", bare)})
    n, n_e, n_t = len(rows), Counter(e for h in holds for e in h), Counter(x for ts in terms for x in ts)
    both = Counter((e, x) for h, ts in zip(holds, terms, strict=True) for e in h for x in ts)
    found = set()
    for (e, x), k in both.items():
        content = -math.log2(n_e[e] / n)
        if k >= evidence and content > 0 and math.log2(n * k / (n_t[x] * n_e[e])) / content >= disclosure:
            found.add(x)
    return found


def term_spans(text, told, secrets=()):
    """Places of told terms outside direct identifiers."""
    text = text or ""
    direct = [(a, b) for _, a, b in pii_spans(text)] + list(secrets)
    return [(m.start(), m.end()) for m in re.finditer(r"[^\W_]+", text) if m[0].lower() in told and not any(m.start() < b and m.end() > a for a, b in direct)]


def spelled(rows):
    """(word, form, root, n, n_near, form_n) of every word."""
    import zlib

    n = Counter()
    for d, t in rows:
        for r in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            r = r.translate(LOW)
            h = zlib.crc32(f"{'' if d is None else d}:{r}".encode())
            n[r if h % 31 else r[: h % len(r)] + r[h % len(r) + 1 :]] += 1
    n = {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    links = {w: [v for v in n if abs(len(v) - len(w)) < 2 and near(w, v)] for w in n}
    form = {}
    for w, found in links.items():
        best = min(found, key=lambda v: (-n[v], v), default=None)
        if best is not None and n[best] >= 10 * n[w]:
            form[w] = best
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(links[w]), n[form[w]] if w in form else None))
    return out


def bytes_removed(rows, length=400):
    texts = [(t or "").encode() for _, t in rows]
    starts = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for (d, _), t in zip(rows, texts, strict=True):
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if starts[t[i : i + length]] > 1:
                gone[i : i + length] = b"\x01" * length
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        out.append((d, len(t), sum(gone), len(re.findall(b"\x01+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return out


def audited(rows, labels):
    """rows: (doc_id, text, source); labels: (doc_id, quality, toxic)."""
    from itertools import permutations

    first, docs = {}, defaultdict(list)
    for d, t, _ in rows:
        if d is not None:
            first[t or ""] = min(d, first.get(t or "", d))
    good, toxic = {d for d, q, _ in labels if q == 1 and d is not None}, {d for d, _, x in labels if x == 1 and d is not None}
    for d, t, s in rows:
        t = t or ""
        w = WORD.findall(t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": d is not None and d > first[t]}
        docs[s or ""].append(({k for k, v in fails.items() if v}, d in good, d in toxic))
    out = []
    for part, held in docs.items():
        sums = Counter()
        done = []
        for order in map("".join, permutations("ABCDE")):
            left = held
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[0]]
                left = [x for x in left if f not in x[0]]
                sums[f] += len(gone)
                all_failing = sum(f in x[0] for x in held)
                done.append((order, step, f, len(left), len(gone), all_failing - len(gone), sum(x[0] == {f} for x in held), sum(x[1] for x in gone), sum(x[2] for x in gone)))
        out += [(part, o, s, *rest, sums[f]) for o, s, f, *rest in done]
    return out
