"""Plain Python versions of the contracts, for small tables."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import xxhash

WS = re.compile(r"[\x20\x09-\x0D]")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def low(x):
    """Sort key: null last."""
    return (x is None, x or 0)


def exact_dedup(docs):
    """Rows ``(doc_id, keep_id, group_size, kept, sha)`` as a multiset; ``docs``: dicts."""
    groups = defaultdict(list)
    for d in docs:
        groups[WS.sub("", d["text"] or "")].append(d)
    out = Counter()
    for norm, rows in groups.items():
        order = sorted(rows, key=lambda d: (-len(d["text"] or ""), low(d["doc_id"])))
        for i, d in enumerate(order):
            out[d["doc_id"], order[0]["doc_id"], len(rows), i == 0, hashlib.sha256(norm.encode()).hexdigest()] += 1
    return out


def sizes_and_targets(docs, share=1.5, cap=2.0, weights=(3, 1, 2)):
    size = defaultdict(int)
    for d in docs:
        size[d["source"]] += len(WORD.findall(d["text"] or ""))
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full = share * sum(size.values()), set()
    while True:
        open_ = [s for s in names if s not in full]
        rest = total - sum(cap * size[s] for s in full)
        target = {s: cap * size[s] if s in full else rest * weight[s] / sum(weight[x] for x in open_) for s in names}
        over = {s for s in open_ if target[s] > cap * size[s]}
        if not over:
            return dict(size), target
        full |= over


def fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(words)
    if not words:
        return 0
    grams = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


class Union:
    def __init__(self):
        self.up = {}

    def find(self, x):
        while self.up.setdefault(x, x) != x:
            x = self.up[x]
        return x

    def tie(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def linked_fingerprints(fps, k):
    """fp -> smallest fp reachable, and all pairs at 1 to k bits."""
    fps, u, pairs = sorted(set(fps)), Union(), set()
    array = np.array(fps, np.uint64)
    for i, f in enumerate(fps):
        u.find(f)
        for j in np.flatnonzero(np.bitwise_count(array ^ np.uint64(f)) <= k):
            if j != i:
                u.tie(f, fps[j])
                pairs.add((f, fps[j]))
    return {f: u.find(f) for f in fps}, pairs


def near_dedup(docs, k=2):
    """Multiset of ``(doc_id, fingerprint, component_id)``."""
    marks = [(d["doc_id"], fingerprint(d["text"])) for d in docs]
    roots, _ = linked_fingerprints([f for _, f in marks], k)
    best = {}
    for i, f in marks:
        if i is not None:
            best[roots[f]] = min(best.get(roots[f], i), i)
    return Counter((i, f"{f:016x}", best.get(roots[f])) for i, f in marks)


RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"),
         ("allow", "org", "/fr/")]


def judge(url, rules=RULES, default="allow"):
    host = path = ""
    if url and "://" in url:
        m = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1], re.S)
        host, path = "".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]), m[2]
    fit = [(len(h + p), len(h), h + p, a) for a, h, p in rules
           if (host == h or host.endswith("." + h)) and path.startswith(p)]
    _, _, rule, verdict = max(fit) if fit else (0, 0, None, default)
    return host, path, rule, verdict


KINDS = [
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                          re.I | re.A), lambda m: len(m[2]) >= 12),
    ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 18),
    ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 16)]


def secrets(text):
    found = sorted((m.start(), k, m.end()) for k, (_, p, ok) in enumerate(KINDS) for m in p.finditer(text or "") if ok(m))
    joined = ",".join(f"{KINDS[k][0]}:{s}:{e}" for s, k, e in found)
    return [sum(k == i for _, k, _ in found) for i in range(3)], joined, hashlib.sha256(joined.encode()).hexdigest()


def near_vectors(rows, least=0.93):
    """Multiset of ``(vec_id, n_links, component_id, kept)``; ``rows``: dicts."""
    def good(r):
        v = r["embedding"]
        return (r["label"] is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
                and any(v))
    u, links = Union(), Counter()
    ok = [i for i, r in enumerate(rows) if good(r)]
    unit = {i: np.array(rows[i]["embedding"], float) for i in ok}
    unit = {i: v / np.linalg.norm(v) for i, v in unit.items()}
    for i in range(len(rows)):
        u.find(i)
    for a in ok:
        for b in ok:
            if a < b and rows[a]["label"] == rows[b]["label"] and len(unit[a]) == len(unit[b]) \
                    and unit[a] @ unit[b] >= least:
                links[a] += 1
                links[b] += 1
                u.tie(a, b)
    lowest = {}
    for i, r in enumerate(rows):
        lowest[u.find(i)] = min(lowest.get(u.find(i), r["vec_id"]), r["vec_id"])
    return Counter((r["vec_id"], links[i], lowest[u.find(i)], r["vec_id"] == lowest[u.find(i)])
                   for i, r in enumerate(rows))


def fold(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


def aligned(docs, tok_a, sp):
    """Rows of the alignment contract, token by token."""
    alphabet = {}
    other = 256
    for b in range(256):
        if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF:
            alphabet[chr(b)] = b
        else:
            alphabet[chr(other)] = b
            other += 1
    spelled = {i: bytes(alphabet[c] for c in t) for t, i in tok_a.get_vocab().items() if all(c in alphabet for c in t)}

    def piece(i):
        p = sp.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode()

    found, count = [], Counter()
    for d in docs:
        text = d["text"] or ""
        a = tok_a.encode(" " + text, add_special_tokens=False).ids if text else []
        b = sp.encode(text) if text else []
        whole = (" " + text).encode()
        if b"".join(spelled[i] for i in a) != whole or b"".join(map(piece, b)) != whole:
            a, b = [], []
        ends = []
        for ids, of in ((a, spelled.get), (b, piece)):
            at, own = 0, []
            for i in ids:
                at += len(of(i))
                own.append(at)
            ends.append(own)
        common = sorted(set(ends[0]) & set(ends[1]))  # no token is empty, so each end is one token's
        at_a, at_b = dict(zip(ends[0], a)), dict(zip(ends[1], b))
        links = [(at_a[e], at_b[e]) for e in common]
        groups, i, j = [], 0, 0
        for e in common:
            x, y = [], []
            while i < len(a) and ends[0][i] <= e:
                x.append(str(a[i]))
                i += 1
            while j < len(b) and ends[1][j] <= e:
                y.append(str(b[j]))
                j += 1
            groups.append(",".join(x) + "|" + ",".join(y))
        found.append((d["doc_id"], len(a), len(b), len(common), links, ";".join(groups)))
        count.update(links)
    best = {}
    for (_, y), n in count.items():
        best[y] = max(best.get(y, 0), n)
    return Counter((i, na, nb, ng, len(links), sum(count[p] == best[p[1]] for p in links), sum(count[p] for p in links),
                    hashlib.sha256(g.encode()).hexdigest() if na else "") for i, na, nb, ng, links, g in found)
