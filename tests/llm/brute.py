"""Plain versions of the operators for small tables: one row, pair or layer at a time."""

import base64
import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

BLANK = re.compile(r"[\x20\x09-\x0D]")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingles(text, width):
    found = words(text)
    if not found:
        return frozenset()
    if len(found) < width:
        return frozenset([tuple(found)])
    return frozenset(tuple(found[i : i + width]) for i in range(len(found) - width + 1))


def reach(nodes, links):
    """Smallest node reachable from each."""
    root = {n: n for n in nodes}

    def top(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def near(docs, width, per_cent=80):
    """{id: (set size, component)} for {id: text}."""
    sets = {i: shingles(t, width) for i, t in docs.items()}
    holders = defaultdict(list)
    for i, one in sets.items():
        for s in one:
            holders[s].append(i)
    both = Counter()
    for ids in holders.values():
        for k, a in enumerate(ids):
            for b in ids[:k]:
                both[b, a] += 1
    links = [
        (a, b) for (a, b), n in both.items() if 100 * n >= per_cent * (len(sets[a]) + len(sets[b]) - n)
    ]
    found = reach(docs, links)
    return {i: (len(sets[i]), found[i]) for i in docs}


def exact(docs):
    """{id: (keep id, group size, digest)}."""
    groups = defaultdict(list)
    for i, t in docs.items():
        groups[BLANK.sub("", t or "")].append((-len(t or ""), i))
    found = {}
    for text, rows in groups.items():
        keep = min(rows)[1]
        for _, i in rows:
            found[i] = (keep, len(rows), hashlib.sha256(text.encode()).hexdigest())
    return found


def cosine_links(rows, least=0.98):
    """{id: (links, component)} for [(id, vector, label)]."""
    fit = {
        i: (label, v)
        for i, v, label in rows
        if label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)
    }
    ids, links = sorted(fit), []
    for k, a in enumerate(ids):
        for b in ids[:k]:
            (la, va), (lb, vb) = fit[a], fit[b]
            if la == lb and len(va) == len(vb):
                dot = sum(x * y for x, y in zip(va, vb))
                if dot / math.sqrt(sum(x * x for x in va) * sum(y * y for y in vb)) >= least:
                    links.append((b, a))
    count = Counter(i for link in links for i in link)
    found = reach([i for i, _, _ in rows], links)
    return {i: (count[i], found[i]) for i, _, _ in rows}


def targets(sizes, weights=(5, 2, 1), passes=3):
    """{source: target}: excess over the cap is shared again until there is none."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in capped]
        left = total - sum(passes * sizes[s] for s in capped)
        found = {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        over = {s for s in free if found[s] > passes * sizes[s]}
        if not over:
            return {s: found.get(s, passes * sizes[s]) for s in order}
        capped |= over


KINDS = {
    "assign": re.compile(
        r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    ),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "hex": re.compile(r"[0-9a-f]+"),
}


def base_secrets(text):
    """[(start, place of the kind, end)] of the text itself."""
    found = []
    for place, (kind, pattern) in enumerate(KINDS.items()):
        for m in pattern.finditer(text or ""):
            size = len(m[2]) if kind == "assign" else len(m[0])
            if size >= {"assign": 8, "access": 16, "hex": 32}[kind]:
                found.append((m.start(), place, m.end()))
    return sorted(found)


def spans(found):
    return ",".join(f"{list(KINDS)[k]}:{a}:{b}" for a, k, b in found)


def crc(data):
    return zlib.crc32(data) & 0xFFFFFFFF


def sha1_base32(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def vector_codes(rows, parts=8, entries=16, rounds=6, scale=4096):
    """({id: (code, error)}, codebooks) for [(id, vector)] of one length."""
    kept = sorted(
        ((i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)),
        key=lambda r: (r[0] is None, r[0] or 0, r[1]),
    )
    size = len(kept[0][1])
    cuts = [p * size // parts for p in range(parts + 1)]
    cut = lambda q, p: q[cuts[p] : cuts[p + 1]]
    books = [[cut(q, p) for _, q in kept[:entries]] for p in range(parts)]

    def pick(part, book):
        far = [sum((a - b) ** 2 for a, b in zip(part, entry)) for entry in book]
        return far.index(min(far)), min(far)

    for _ in range(rounds):
        for p, book in enumerate(books):
            groups = defaultdict(list)
            for _, q in kept:
                groups[pick(cut(q, p), book)[0]].append(cut(q, p))
            for e, own in groups.items():
                book[e] = [sum(c) // len(own) for c in zip(*own)]
    coded = []
    for i, q in kept:
        found = [pick(cut(q, p), book) for p, book in enumerate(books)]
        coded.append((i, "".join(f"{e:02x}" for e, _ in found), sum(d for _, d in found)))
    return coded, books


def phrases(rows, least=10, limit=2000, drop_share=50):
    """{(lang, rank): (phrase, a, l, r, n, score)} for [(text, lang)]."""
    counts, total = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            found = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(found)
            for size in (1, 2, 3):
                counts[lang].update(tuple(found[i : i + size]) for i in range(len(found) - size + 1))
    best = {}
    for lang, f in counts.items():
        known = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        gone = set()
        for p, a in known.items():
            if len(p) == 3:
                gone |= {q for q in (p[:2], p[1:]) if q in known and 100 * a >= drop_share * known[q]}
        ranked = []
        for p, a in known.items():
            if p not in gone:
                score, k = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                ranked.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(ranked)[:limit], 1):
            best[lang, rank] = (p.decode(), -a, left, right, total[lang], -score)
    return best


LICENSES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


def base_licenses(text):
    """(words, [(place, label)]) of the phrases themselves."""
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    found = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    places = []
    for phrase, label in LICENSES.items():
        size = len(phrase.split())
        places += [(i, label) for i in range(len(found)) if found[i : i + size] == phrase.split()]
    return found, places
