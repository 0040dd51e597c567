"""Plain, slow versions of the operators' contracts, row by row."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

import xxhash

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SOLID = re.compile(r"[^\x20\x09-\x0D]+")


def alnum_words(text):
    return ALNUM.findall((text or "").translate(LOWER))


def solid_words(text):
    return SOLID.findall(text or "")


def licence_base(text):
    w = alnum_words(text)
    places = []
    for phrase, label in (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")):
        p = phrase.split()
        places += [(i, label) for i in range(len(w) - len(p) + 1) if w[i:i + len(p)] == p]
    starts = [i for i, _ in places]
    return (len(w), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places})))


def simhash(text, n=4):
    w = solid_words((text or "").translate(LOWER))
    if not w:
        return 0
    sh = [" ".join(w[i:i + n]) for i in range(len(w) - n + 1)] or [" ".join(w)]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def components(ids, fps, bits=4):
    """Smallest id reachable, per position."""
    label = list(range(len(ids)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i
    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                a, b = root(i), root(j)
                label[max(a, b)] = min(a, b)
    best = {}
    for i, d in enumerate(ids):
        if d is not None:
            best[root(i)] = min(best.get(root(i), d), d)
    return [best.get(root(i)) for i in range(len(ids))]


def contamination(text, items, n=10):
    """items: [(item_id, text)]."""
    w, hit, found = alnum_words(text), set(), set()
    for item, t in items:
        iw = alnum_words(t)
        grams = {tuple(iw[i:i + n]) for i in range(len(iw) - n + 1)} if len(iw) >= n else {tuple(iw)} if iw else set()
        for g in grams:
            for i in range(len(w) - len(g) + 1):
                if tuple(w[i:i + len(g)]) == g:
                    hit |= set(range(i, i + len(g)))
                    if item is not None:
                        found.add(str(item))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def statistics(text):
    w = solid_words(text)
    text = text or ""
    lines = [x for x in text.split("\n") if SOLID.search(x)]
    win = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
    n = Counter(win)
    rep = {j for i, x in enumerate(win) if n[x] > 1 for j in range(i, i + 5)}
    base = (len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(rep))
    return (*base, len(w) < 10 or 100 * len(rep) > 20 * len(w))


def targets(sizes, weights=(5, 2, 1), most=3):
    """sizes: {source: words}; reshare the excess until no target is above."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in capped]
        rest = total - sum(most * sizes[s] for s in capped)
        t = {s: most * sizes[s] if s in capped else rest * w[s] / sum(w[x] for x in free) for s in order}
        above = {s for s in free if t[s] > most * sizes[s]}
        if not above:
            return t
        capped |= above


def token_rows(docs, tok):
    out, start = [], 0
    for d, text in sorted(docs, key=lambda x: (x[0] is None, x[0] or 0, xxhash64_signed(x[1] or ""))):
        ids = tok.encode(text or "", add_special_tokens=False).ids + [0]
        out.append((d, start, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))))
        start += len(ids)
    return out


def xxhash64_signed(s):
    h = xxhash.xxh64_intdigest(s.encode(), 42)
    return h - (1 << 64) if h >> 63 else h


def url_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    return host.translate(LOWER), re.split(r"[?#]", rest[len(host):], maxsplit=1)[0]


def url_rule(host, path):
    best = None
    for verdict, rule in (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")):
        name, _, rest = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + rest) and (best is None or len(rule) > len(best[0])):
            best = (rule, verdict)
    return best or (None, None)


def warc_rows(pages):
    """pages: [(page_id, html)], ids distinct."""
    first = {}
    for p, h in pages:
        b = (h or "").encode()
        if len(b) >= 100:
            first[b] = min(first.get(b, p), p)
    out = []
    for p, h in pages:
        b = (h or "").encode()
        r = first.get(b, p)
        out.append((p, len(b), hashlib.sha256(b).hexdigest(), "response" if r == p else "revisit", None if r == p else r))
    return out


def segment(word, pieces, unknown):
    """(score, -tokens) of the best segmentation, by plain forward scores."""
    best = [(0.0, 0)]
    for end in range(1, len(word) + 1):
        s, t = best[end - 1]
        opts = [(s + unknown, t - len(word[end - 1].encode()))]
        for a in range(end):
            if word[a:end] in pieces:
                opts.append((best[a][0] + pieces[word[a:end]], best[a][1] - 1))
        best.append(max(opts))
    return -best[-1][1]
