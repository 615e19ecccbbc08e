"""Plain versions of the corpus operators, to compare with."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

LOW = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
ALNUM = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def sha(b: bytes) -> str:
    return hashlib.sha256(b).hexdigest()


def substring_dedup(docs: list[tuple[int, str | None]], window: int) -> dict:
    seen, out = set(), {}
    for d, t in sorted(docs, key=lambda r: r[0]):
        w = WORDS.findall((t or "").encode())
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            if k in seen:
                gone[i : i + window] = [True] * window
            seen.add(k)
        out[d] = (len(w), sum(gone), sha(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return out


def byte_dedup(docs: list[tuple[int, str | None]], window: int) -> dict:
    texts = {d: (t or "").encode() for d, t in docs}
    n = Counter(b[i : i + window] for b in texts.values() for i in range(len(b) - window + 1))
    out = {}
    for d, b in texts.items():
        gone = [False] * len(b)
        for i in range(len(b) - window + 1):
            if n[b[i : i + window]] > 1:
                gone[i : i + window] = [True] * window
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out[d] = (len(b), sum(gone), spans, sha(bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    return out


def decontaminate(docs: list, tests: list, window: int) -> dict:
    cut = lambda t: ALNUM.findall((t or "").encode().translate(LOW))
    wins: dict[tuple, set[str]] = {}
    for i, t in tests:
        w = cut(t)
        size = min(window, len(w))
        for j in range(len(w) - size + 1) if size else ():
            wins.setdefault(tuple(w[j : j + size]), set()).add(str(i))
    out = {}
    for d, t in docs:
        w, items = cut(t), set()
        hit = [False] * len(w)
        for size in {len(k) for k in wins}:
            for j in range(len(w) - size + 1):
                if got := wins.get(tuple(w[j : j + size])):
                    items |= got
                    hit[j : j + size] = [True] * size
        out[d] = (len(w), sum(hit), sorted(items))
    return out


def components(nodes, links) -> dict:
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in root}


def shingles(t: str | None, size: int = 5) -> set:
    w = WORDS.findall((t or "").encode().translate(LOW))
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def near_duplicates(docs: list, percent: int = 75) -> dict:
    sets = {d: shingles(t) for d, t in docs}
    ids = sorted(sets)
    links = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    root = components(ids, links)
    return {d: (len(sets[d]), root[d], root[d] == d) for d in ids}


def class_model_scores(docs: list, held, lm) -> dict:
    """log10 probabilities of the class model: exchange over frequent words and endings is `lm.exchange_classes`."""
    import numpy as np

    def named(w: bytes) -> tuple[int, int]:
        h, ending, _ = lm.words_of(np.frombuffer(w, np.uint8), np.array([0, len(w)]))
        return int(h.view(np.int64)[0]), int(ending[0])

    end = lm.UNITS - 1
    cut = {d: WORDS.findall((t or "").encode().translate(LOW)) for d, t in docs}
    train = [ws for d, ws in cut.items() if not held(d)]
    n = Counter(w for ws in train for w in ws)
    names = {w: named(w) for ws in cut.values() for w in ws}
    frequent = {w: u for u, w in enumerate(sorted(n, key=lambda w: (-n[w], names[w][0]))[: lm.FREQUENT])}
    unit = {w: frequent.get(w, lm.FREQUENT + names[w][1]) for w in names}
    counts = np.zeros((lm.UNITS, lm.UNITS), np.int64)
    for ws in train:
        us = [end, *(unit[w] for w in ws), end]
        for x, y in zip(us, us[1:], strict=False):
            counts[x, y] += 1
    owner = lm.exchange_classes(counts)
    grid = np.zeros((lm.CLASSES, lm.CLASSES))
    for x, y in zip(*np.nonzero(counts), strict=True):
        grid[owner[x], owner[y]] += counts[x, y]
    k = lm.CLASSES
    shared = np.log((grid + 0.5) * (grid.sum() + 0.5 * k * k) / ((grid.sum(1, keepdims=True) + 0.5 * k) * (grid.sum(0, keepdims=True) + 0.5 * k)))
    value = {}
    for ws in train:
        us = [end, *(unit[w] for w in ws), end]
        for i, w in enumerate(ws):
            if w not in frequent:
                value[w] = value.get(w, 0) + shared[owner[us[i]]] + shared[:, owner[us[i + 2]]]
    kind = {w: int(owner[unit[w]]) for w in names} | {w: int(np.argmax(v[:-1])) for w, v in value.items()}
    moves, size = np.zeros((k, k)), np.zeros(k)
    for ws in train:
        ks = [k - 1, *(kind[w] for w in ws), k - 1]
        for x, y in zip(ks, ks[1:], strict=False):
            moves[x, y] += 1
    for w in n:
        size[kind[w]] += 1
    size[k - 1] += bool(train)
    tokens, out = moves.sum(0), {}
    for d, ws in cut.items():
        ks, total = [k - 1, *(kind[w] for w in ws), k - 1], 0.0
        for i, y in enumerate(ks[1:]):
            c = n[ws[i]] if i < len(ws) else len(train)
            total += np.log10((moves[ks[i], y] + 0.5) / (moves[ks[i]].sum() + 0.5 * k)) + np.log10((c + 1) / (tokens[y] + size[y] + 1))
        out[d] = total
    return out


def licenses(text: str | None, license) -> tuple[int, list[str], list[str]]:
    """Segments, known sentences (the longest at each place, one after another) and licences, by trying all of them."""
    fold = lambda x: " ".join("".join(c if c.isalnum() or ord(c) > 127 else " " for c in x.translate(license.LOWER)).split())
    parts = [p for p in (fold(x) for x in re.split(r"\n+|(?<=[.!?:])[ \t\r]+", text or "")) if p]
    known = {fold(s): k for k, s in license.SENTENCES.items()}
    longest = max(len(s.split()) for s in known)
    found, i = [], 0
    while i < len(parts):
        ends = [j for j in range(i, min(len(parts), i + longest)) if " ".join(parts[i : j + 1]) in known]
        if ends:
            found.append((i, ends[-1], known[" ".join(parts[i : ends[-1] + 1])]))
        i = ends[-1] + 1 if ends else i + 1

    def met(order: tuple[str, ...], after: int | None) -> bool:
        if not order:
            return True
        return any(s == order[0] and (after is None or 0 < a - after <= 4) and met(order[1:], b) for a, b, s in found if after is None or a - after <= 4)

    return len(parts), [s for _, _, s in found], sorted({name for name, order in license.RULES if met(order, None)})


def hard_negatives(rows: list[tuple], k: int = 5, low: int = 80) -> list[tuple]:
    """Rows (id, vector, label): every anchor's whole list, by its definition."""
    q = [(i, [math.floor(256 * x) for x in v], y) for i, v, y in rows if y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    late = lambda i: (i is None, i or 0)
    out = []
    for n, (a, v, y) in enumerate(q):
        if a is None or a % 100:
            continue
        met = sorted(((-sum(p * r for p, r in zip(v, w, strict=True)), late(i), z) for m, (i, w, z) in enumerate(q) if m != n and len(w) == len(v)), key=lambda r: r[:2])
        for s, p, _ in [r for r in met if r[2] == y][:k]:
            found = [r for r in met if r[2] != y and low * -s <= 100 * -r[0] <= 100 * -s][:k]
            out += [(a, None if p[0] else p[1], m, None if i[0] else i[1], -s, -t) for m, (t, i, _) in enumerate(found, 1)]
    return out


def trie(rows: list[tuple]) -> dict:
    """Rows (conv_id, turn, role, text): nodes by (smallest member, depth)."""
    own: dict[int, list] = {}
    for c, *turn in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        own.setdefault(c, []).append((turn[1] or "", turn[2] or ""))
    nodes: dict[tuple, list[int]] = {}
    whole = {}
    for c, turns in sorted(own.items()):
        h = zlib.crc32(str(c).encode()) % 9
        whole[c] = tuple(own.get(c - int(math.fmod(c, 5)), [])[:h] + turns[h:])
        for d in range(len(whole[c]) + 1):
            nodes.setdefault(whole[c][:d], []).append(c)
    kids: dict[tuple, list[tuple]] = {}
    for k in nodes:
        if k:
            kids.setdefault(k[:-1], []).append(k)
    leaves, saved = {}, {}
    for k in sorted(nodes, key=len, reverse=True):
        below = kids.get(k, [])
        leaves[k] = sum(leaves[x] for x in below) or 1
        saved[k] = sum(saved[x] for x in below) + (len(nodes[k]) - 1) * (len(k[-1][1].encode()) if k else 0)
    out = {}
    for k, members in nodes.items():
        ends = ",".join(str(c) for c in members if len(whole[c]) == len(k))
        out[members[0], len(k)] = (nodes[k[:-1]][0] if k else None, len(members), len(kids.get(k, [])), leaves[k], saved[k], sha(ends.encode()))
    return out
