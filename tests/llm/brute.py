"""The operators' results worked out the plain way, for small inputs."""

from __future__ import annotations

import collections
import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def substrings(rows, length=100):
    seen, out = set(), {}
    for i, text, *_ in sorted(rows):
        data = text.encode()
        gone = bytearray(len(data))
        for s in range(len(data) - length + 1):
            w = data[s : s + length]
            if w in seen:
                gone[s : s + length] = b"\1" * length
            seen.add(w)
        kept = bytes(c for c, g in zip(data, gone, strict=True) if not g)
        out[i] = (len(data), sum(gone), len(re.findall(b"\1+", bytes(gone))), sha(kept))
    return out


def lines(rows):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    holders = collections.defaultdict(set)
    for i, text, *_ in rows:
        for x in text.split("\n"):
            if len(key(x)) >= 10:
                holders[key(x)].add(i)
    out = {}
    for i, text, *_ in rows:
        all_ = text.split("\n")
        kept = [x for x in all_ if len(holders.get(key(x), ())) < 2 or min(holders[key(x)]) == i]
        out[i] = (len(all_), len(all_) - len(kept), sha("\n".join(kept).encode()))
    return out


def word_statistics(rows):
    out = {}
    for i, text, *_ in rows:
        words = WORD.findall(text)
        n = len(words)
        windows = collections.Counter(tuple(words[k : k + 5]) for k in range(n - 4))
        covered = {j for k in range(n - 4) if windows[tuple(words[k : k + 5])] > 1 for j in range(k, k + 5)}
        seen, twice = set(), 0
        for x in text.split("\n"):
            if WORD.search(x):
                twice += x in seen
                seen.add(x)
        out[i] = (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), twice, len(covered), n < 10 or 100 * len(covered) > 20 * n)
    return out


def luhn(text):
    total = 0
    for k, c in enumerate(reversed([int(c) for c in text if c.isdigit()])):
        c = 2 * c if k % 2 else c
        total += c - 9 if c > 9 else c
    return total % 10 == 0


def personal(rows):
    out = {}
    for i, text, *_ in rows:
        spans = [(m.start(), 0, "email", m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
        for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
            if all(int(x) <= 255 for x in m[0].split(".")):
                spans.append((m.start(), 1, "ip", m.end()))
        for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
            if 14 <= sum(c.isdigit() for c in m[0]) <= 19 and luhn(m[0]):
                spans.append((m.start(), 2, "card", m.end()))
        for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
            if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                spans.append((m.start(), 3, "phone", m.end()))
        spans.sort()
        n = collections.Counter(k for _, _, k, _ in spans)
        out[i] = (n["email"], n["ip"], n["card"], n["phone"], sha(",".join(f"{k}:{a}:{b}" for a, _, k, b in spans).encode()))
    return out


def near_pairs(rows, threshold=(4, 5), n=5):
    sets = {}
    for i, text, *_ in rows:
        w = WORD.findall(text)
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
    links = collections.defaultdict(set)
    for i, a in sets.items():
        for j, b in sets.items():
            if i != j and a & b and len(a & b) * threshold[1] >= len(a | b) * threshold[0]:
                links[i].add(j)
    return reach(sets, links)


def reach(nodes, links):
    root = {}
    for i in sorted(nodes):
        stack = [] if i in root else [i]
        root.setdefault(i, i)
        while stack:
            for j in links[stack.pop()]:
                if j not in root:
                    root[j] = i
                    stack.append(j)
    return {i: (len(links[i]), root[i], root[i] == i) for i in nodes}
