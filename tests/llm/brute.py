"""Plain versions of the operators, straight from their definitions."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import xxhash


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def contamination(docs, items):
    """docs, items: lists of (id, text)."""
    word = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = {}
    for i, t in items:
        w = word.findall(low(t))
        for k in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[k:k + 10]), set()).add(i)
    out = []
    for d, t in docs:
        w = word.findall(low(t))
        hit, found = np.zeros(len(w), bool), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                items_here = windows.get(tuple(w[i:i + n]))
                if items_here:
                    hit[i:i + n] = True
                    found |= items_here
        names = ",".join(sorted(str(x) for x in found if x is not None))
        out.append((d, len(w), int(hit.sum()), len([x for x in found if x is not None]), sha(names), bool(hit.any())))
    return out


def secrets(text):
    text = text or ""
    assign = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    found = [(m.start(), 0, m.end(), "assign") for m in assign.finditer(text) if len(m[1]) >= 6]
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [(k, a, b) for a, _, b, k in sorted(found)]


def quality(text):
    words = re.findall("[^\x20\x09-\x0D]+", text or "")
    windows = Counter(zip(words, words[1:], words[2:]))
    hit = [False] * len(words)
    for i in range(len(words) - 2):
        if windows[tuple(words[i:i + 3])] > 1:
            hit[i] = hit[i + 1] = hit[i + 2] = True
    lines = [x for x in (text or "").split("\n") if re.search("[^\x20\x09-\x0D]", x)]
    failed = len(words) < 50 or 100 * sum(hit) > 50 * len(words)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)),
            sum(hit), failed)


def repeats(docs, length=100):
    seen, out = set(), {}
    for d, t in sorted(docs, key=lambda x: x[0]):
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - length + 1):
            s = raw[i:i + length]
            if s in seen:
                gone[i:i + length] = True
            seen.add(s)
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out[d] = (len(raw), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest())
    return out


def fingerprint(text):
    words = re.findall("[^\x20\x09-\x0D]+", low(text))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def near(docs):
    """docs: list of (id, text) without null ids; (fingerprint, component) per row."""
    prints = [fingerprint(t) for _, t in docs]
    parent = list(range(len(docs)))

    def top(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                parent[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        least[top(i)] = min(least.get(top(i), d), d)
    return [(f"{prints[i]:016x}", least[top(i)]) for i in range(len(docs))]


def crc(ids):
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


def terms(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall("[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]


def divergence(docs, least=30, top=50):
    """docs: (lang, source, text); rows (lang, source, part, item, value, rank)."""
    docs = [(a or "", b or "", terms(t)) for a, b, t in docs]
    out = []
    for lang in {d[0] for d in docs}:
        df, count = Counter(), {}
        for a, b, ws in docs:
            if a == lang:
                df.update(set(ws))
                count.setdefault(b, Counter()).update(ws)
        kept = [t for t in df if df[t] >= least]
        whole = sum(count.values(), Counter())

        def share(c):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10 ** 9 * (c[t] + 5) // (n + 5 * len(kept)) for t in kept}
        p, q = {s: share(c) for s, c in count.items()}, share(whole)
        for s in count:
            pairs = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in count if o != s]
            own = [(q[t] - p[s][t], t.encode()) for t in kept if count[s][t] and p[s][t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(own)[:top])):
                out += [(lang, s, part, i.decode(), -v, r) for r, (v, i) in enumerate(found, 1)]
    return sorted(out)


def nearest(rows, k=20, every=20):
    """rows: (id, vector); rows (query, rank, id, score)."""
    rows = [(i, [int(np.floor(64 * float(x))) for x in v]) for i, v in rows
            if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for n, (i, v) in enumerate(rows):
        if i % every == 0:
            found = sorted((-sum(a * b for a, b in zip(v, w)), j) for m, (j, w) in enumerate(rows) if m != n)
            out += [(i, r, j, -s) for r, (s, j) in enumerate(found[:k], 1)]
    return sorted(out)


def damaged(rows):
    """rows: (conv, turn, role, text); the rows after damage, by conversation."""
    out = {}
    for conv, turn, role, text in rows:
        mine = out.setdefault(conv, [])
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        way = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if way == 0:
            continue
        text = "" if way == 1 else re.sub("[.!?]", "", text) if way == 2 else text
        mine += [(turn, "user" if way == 4 else role, text)] * (2 if way == 3 else 1)
    return out


def repaired(rows):
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, lines) of the rows (turn, role, text) of one conversation."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, faults = set(), []
    for _, role, text in rows:
        words = re.sub("[ \t-\r]", "", text)
        faults.append("blank" if not words else "duplicate" if (role, text) in seen else
                      "truncated" if words[-1] not in ".!?" else "")
        seen.add((role, text))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    initials = [r[:1] for _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    after = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    names = {"u": "user", "a": "assistant"}
    # Best (cost, edits, lines) to the end from each state, with up to two insertions anywhere.
    best = {"": (0, "", ()), "a": (0, "", ())}

    def inserted(best):
        for _ in range(2):
            new = dict(best)
            for s in ("", "s", "u", "a"):
                to = "a" if s == "u" else "u"
                if to in best:
                    c, e, x = best[to]
                    new[s] = min(new.get(s, (10 ** 9, "", ())), (c + 5, "I" + e, (names[to] + ":", *x)))
            best = new
        return best
    best = inserted(best)
    for (_, role, text), fault in zip(reversed(rows), reversed(faults)):
        front = {}
        for s in ("", "s", "u", "a"):
            options = []
            if s in best:
                c, e, x = best[s]
                options.append((c + 2, "D" + e, x))
            if fault in ("", "truncated"):
                extra = 5 if fault else 0
                to = after.get((s, role[:1]))
                if to in best:
                    c, e, x = best[to]
                    options.append((c + extra, "K" + e, (f"{role}:{text}", *x)))
                to = "a" if s == "u" else "u"
                c, e, x = best[to]
                options.append((c + 1 + extra, "R" + e, (f"{names[to]}:{text}", *x)))
            front[s] = min(options)
        best = inserted(front)
    cost, audit, lines = best[""]
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, "\n".join(lines))


class _Article(HTMLParser):
    """Text of the one article of a well-formed page, blocks parted by spaces."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.text = False, ""

    def handle_starttag(self, tag, attrs):
        self.inside |= tag == "article"
        self.text += " " * (tag in ("p", "h1", "br", "li"))

    def handle_endtag(self, tag):
        self.inside &= tag != "article"
        self.text += " " * (tag in ("p", "h1", "li"))

    def handle_data(self, data):
        self.text += data if self.inside else ""


def article(page):
    parser = _Article()
    parser.feed(page or "")
    parser.close()
    return " ".join(parser.text.split())
