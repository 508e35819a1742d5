"""Plain-Python versions of the operators' contracts, for small inputs."""

from __future__ import annotations

import hashlib
import re

SPACES = re.compile("[^\x20\x09-\x0d]+")
KINDS = ("email", "ip", "card", "phone")
BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def lower(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(start, kind, end), sorted."""
    out = []
    for k, kind in enumerate(KINDS):
        for m in BASE[kind].finditer(text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in m[0].split(".")),
                  "card": lambda: 12 <= len(digits) <= 19 and luhn(digits), "phone": lambda: 9 <= len(digits) <= 15}[kind]()
            if ok:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def written(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def shingle_set(text: str | None, k: int) -> set:
    words = SPACES.findall(lower(text or ""))
    if not words:
        return set()
    return {tuple(words[i:i + k]) for i in range(max(1, len(words) - k + 1))}


def near_duplicates(docs, k: int, percent: int) -> dict:
    """id -> (set size, smallest reachable id), all pairs compared through shared shingles."""
    sets = {i: shingle_set(t, k) for i, t in docs}
    holders: dict = {}
    for i, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(i)
    shared: dict = {}
    for ids in holders.values():
        for a in range(len(ids)):
            for b in range(a):
                shared[(ids[b], ids[a])] = shared.get((ids[b], ids[a]), 0) + 1
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for (a, b), n in shared.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    return {i: (len(s), find(i)) for i, s in sets.items()}


def host_path(url: str | None) -> tuple[str, str]:
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return lower(host), re.match(r"[^?#]*", rest[len(host):])[0]


def rule_of(host: str, path: str, rules):
    fits = [(len(h) + len(p), a, h + p) for a, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def top_k(vectors, asked, k):
    """[(query, rank, id, score)] from (id, components) with plain integers."""
    import math

    rows = [(i, [math.floor(1024 * x) for x in v]) for i, v in vectors
            if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, v in sorted({(q, tuple(v)) for q, v in rows if asked(q)}):
        scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in rows if i != q)[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)]
    return out
