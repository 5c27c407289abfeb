"""Plain-Python versions of the operators, straight from their definitions."""

import hashlib
import re
from collections import Counter, defaultdict
from itertools import combinations

import xxhash

WS = " \t\n\x0b\x0c\r"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
NO_ID = 2**63 - 1


def lower(s):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in s)


def sha(s):
    return hashlib.sha256(s.encode() if isinstance(s, str) else s).hexdigest()


def line_dedup(rows):
    key = lambda line: lower(line.strip(WS))
    holders = defaultdict(set)
    for d, t in rows:
        for line in (t or "").split("\n"):
            holders[key(line)].add(NO_ID if d is None else d)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(k := key(x)) < 10 or len(holders[k]) < 2 or min(holders[k]) == (NO_ID if d is None else d)]
        out.append((d, len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    return out


def stats(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def fingerprint(text):
    words = WORD.findall(lower(text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(fps):
    """Index of the first member of each one's component, linking at three bits or fewer."""
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in combinations(range(len(fps)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= 3:
            a, b = sorted((root(i), root(j)))
            parent[b] = a
    return [root(i) for i in range(len(fps))]


def shingles(text, size=5):
    words = WORD.findall(lower(text or ""))
    n = min(size, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if words else set()


def linked(sets, threshold=0.8):
    """Pairs of at least that similarity, found by shared shingles; sets without shingles are alike."""
    holders = {}
    for i, s in enumerate(sets):
        for x in s or [None]:
            holders.setdefault(x, []).append(i)
    shared = Counter((i, j) for own in holders.values() for k, j in enumerate(own) for i in own[:k])
    return [(i, j) for (i, j), n in shared.items() if not sets[i] and not sets[j] or n >= threshold * (len(sets[i]) + len(sets[j]) - n)]


def roots(pairs, n):
    """Index of the first member of each one's component."""
    root = list(range(n))
    for i, j in sorted(pairs) * 2:
        a, b = sorted((root[i], root[j]))
        root = [a if r == b else r for r in root]
    return root


def groups(texts):
    """Index of the first member of each one's component, linking by fingerprints and by five-word shingles."""
    fps = [fingerprint(t) for t in texts]
    near = [(i, j) for i, j in combinations(range(len(texts)), 2) if (fps[i] ^ fps[j]).bit_count() <= 3]
    return roots(near + linked([shingles(t) for t in texts]), len(texts))


def contained(rows, items, threshold=0.8):
    out = []
    for d, t in rows:
        words = WORD.findall(lower(t or ""))
        for i, x in items:
            want = shingles(x)
            if not want:
                continue
            n = len(next(iter(want)))
            have = {tuple(words[j : j + n]) for j in range(len(words) - n + 1)}
            if len(want & have) >= threshold * len(want):
                out.append((d, i, len(want), len(want & have)))
    return out


def secrets(text, rules):
    text = text or ""
    found = []
    for order, r in enumerate(rules):
        for m in re.finditer(r.pattern, text, re.ASCII | (re.IGNORECASE if r.fold_case else 0)):
            if len(m.group(r.group)) >= r.least:
                found.append((m.start(), order, m.end()))
    return sorted(found)


def repeats(rows, length=400):
    """(doc, bytes, removed, runs, sha256) by counting every string of that length."""
    data = [(d, (t or "").encode()) for d, t in rows]
    seen = Counter(b[i : i + length] for _, b in data for i in range(len(b) - length + 1))
    out = []
    for d, b in data:
        hit = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                hit[i : i + length] = b"\x01" * length
        runs = sum(1 for i, x in enumerate(hit) if x and (not i or not hit[i - 1]))
        out.append((d, len(b), sum(hit), runs, sha(bytes(c for c, x in zip(b, hit) if not x))))
    return out


def passages(rows, n):
    """(doc, words) of every row that shares n words in a row with another row."""
    own = [{tuple(w[i : i + n]) for i in range(len(w) - n + 1)} for w in (WORD.findall(t or "") for _, t in rows)]
    holders = Counter(p for s in own for p in s)
    return [r for r, s in zip(rows, own) if any(holders[p] > 1 for p in s)]


def host_path(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return lower(host), re.match(r"[^?#]*", rest[len(host) :])[0]


def mix(rows, seed="mix"):
    """[(doc_id, size, source_size, target, copies)] for (doc_id, text, source) rows: targets by sharing again and again, documents in the order of their draws."""
    size = [len(WORD.findall(t or "")) for _, t, _ in rows]
    total = defaultdict(int)
    for (_, _, s), n in zip(rows, size):
        total[s] += n
    order = sorted(s for s in total if s is not None) + [None] * (None in total)
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    target, free, left = {}, set(order), sum(size)
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * total[s]}
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 3 * total[s]
            left -= 3 * total[s]
        free -= over
    copies = [0] * len(rows)
    for s in order:
        own = [i for i, r in enumerate(rows) if r[2] == s]
        draw = lambda i: int(hashlib.md5(f"{seed}:{NO_ID if rows[i][0] is None else rows[i][0]}".encode()).hexdigest()[:13], 16)
        sure = int(target[s] / total[s]) if total[s] else 0
        want, ahead = target[s] - sure * total[s], 0
        for i in sorted(own, key=lambda i: (draw(i), NO_ID if rows[i][0] is None else rows[i][0], size[i])):
            copies[i] = sure + (want > 0 and ahead + size[i] / 2 <= want)
            ahead += size[i]
    return [(r[0], n, total[r[2]], target[r[2]], c) for r, n, c in zip(rows, size, copies)]
