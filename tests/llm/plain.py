"""Plain Python versions of the operators, for comparison."""

import hashlib
import heapq
import re
import zlib
from collections import Counter

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _holds(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(x) <= 255 for x in match.split("."))
    if kind == "phone":
        return 9 <= len(digits) <= 15
    if kind == "card":
        total = sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(int(c) for c in digits[::-1]))
        return 12 <= len(digits) <= 19 and total % 10 == 0
    return True


def base_spans(text):
    found = [
        (m.start(), list(KINDS).index(kind), m.end(), kind)
        for kind, pattern in KINDS.items() for m in re.finditer(pattern, text or "") if _holds(kind, m.group())
    ]
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(found))


def shingles(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def components(texts, percent=85):
    sets = {d: shingles(t) for d, t in texts.items()}
    root = {d: d for d in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(texts)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in ids}


def repeats(texts, length=50):
    low = {}
    raw = {d: (t or "").encode() for d, t in texts.items()}
    for d in sorted(raw):
        for i in range(len(raw[d]) - length + 1):
            low.setdefault(raw[d][i : i + length], d)
    out = {}
    for d, b in raw.items():
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if low[b[i : i + length]] < d:
                gone[i : i + length] = b"\1" * length
        kept = bytes(x for x, y in zip(b, gone) if not y)
        spans = sum(1 for i in range(len(gone)) if gone[i] and (i == 0 or not gone[i - 1]))
        out[d] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def host_figures(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    inside = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside))


def contaminated(text, items, least=3):
    """Whether some 13 aligned words of an item (all of a shorter one) agree in 75 percent, all of them in items of fewer than 8."""
    cut = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    words = cut(text)
    places = {}
    for i, w in enumerate(words):
        places.setdefault(w, []).append(i)
    for item in map(cut, items):
        of = min(13, len(item))
        if len(item) < least:
            continue
        share = (100 if of < 8 else 75) * of
        shifts = Counter(i - k for k, w in enumerate(item) for i in places.get(w, ()))
        for shift, n in shifts.items():
            if 100 * n < share:
                continue
            equal = [0 <= k + shift < len(words) and words[k + shift] == w for k, w in enumerate(item)]
            if any(100 * sum(equal[i : i + of]) >= share for i in range(len(item) - of + 1)):
                return True
    return False


def simhash(text):
    """64-bit SimHash of neighbouring words; xxhash chains its seeds over the words of a term."""
    words = [w for w in re.split("[\x20\x09-\x0D]+", (text or "").lower()) if w]
    total, votes = 0, [0] * 64
    for i, w in enumerate(words):
        h = 42
        for x in words[i : i + 2]:
            h = xxhash.xxh64(x.encode(), seed=h).intdigest()
        weight = min(len(w), 15)
        total += weight
        for bit in range(64):
            votes[bit] += weight * (h >> bit & 1)
    return sum(1 << bit for bit in range(64) if 2 * votes[bit] > total)


def damaged(rows):
    """(conv_id, turn, role, text) rows as the repair query damages them."""
    blank = lambda v: " " if v is None else str(v)
    out = []
    for conv, turn, role, text in rows:
        k = zlib.crc32(f"{blank(conv)}:{blank(turn)}".encode()) % 20
        role, text = blank(role), blank(text)
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        role = "user" if k == 4 else role
        out += [(conv, turn, role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    return out


def repaired(rows):
    """gaps, blank, duplicate, truncated, illegal, cost, audit and digest of one conversation's damaged rows, by a search over scripts."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).digest()))
    turns = [r[1] for r in rows if r[1] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    seen, faults = set(), []
    for _, _, role, text in rows:
        marks = WORD.findall(text)
        faults.append("blank" if not marks else "duplicate" if (role, text) in seen else "" if marks[-1][-1] in ".!?" else "truncated")
        seen.add((role, text))
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    # Cheapest (cost, audit) of each (row, roles so far); the roles so far matter by their last initial and by being none.
    heap = [(0, "", 0, "", ())]
    done = set()
    legal = {"": "su", "s": "u", "u": "a", "a": "u"}
    while heap:
        cost, audit, at, last, kept = heapq.heappop(heap)
        if (at, last) in done:
            continue
        done.add((at, last))
        if at == len(rows) and last in ("", "a"):
            break
        for initial in legal[last].replace("s", ""):
            name = {"u": "user", "a": "assistant"}[initial]
            heapq.heappush(heap, (cost + 3, audit + "I", at, initial, kept + ((name, ""),)))
            if at < len(rows) and faults[at] not in ("blank", "duplicate"):
                more = 3 if faults[at] else 0
                heapq.heappush(heap, (cost + 3 + more, audit + "R", at + 1, initial, kept + ((name, rows[at][3]),)))
        if at < len(rows):
            heapq.heappush(heap, (cost + 4, audit + "D", at + 1, last, kept))
            if faults[at] not in ("blank", "duplicate") and rows[at][2][:1] and rows[at][2][:1] in legal[last]:
                heapq.heappush(heap, (cost + (3 if faults[at] else 0), audit + "K", at + 1, rows[at][2][:1], kept + (rows[at][2:],)))
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest()
    return (gaps, *[faults.count(x) for x in ("blank", "duplicate", "truncated")], illegal, cost, audit, digest)


def collocations(docs, least, top):
    """(lang, rank, phrase, a, l, r, n, score) of (lang, text) rows."""
    f, n = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            f.update((lang, *words[i : i + m]) for m in range(1, 6) for i in range(len(words) - m + 1))
    found = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    covered = Counter()
    for p, a in found.items():
        for m in range(2, len(p) - 1):
            for i in range(1, len(p) - m + 1):
                covered[p[:1] + p[i : i + m]] = max(covered[p[:1] + p[i : i + m]], a)
    rows = {}
    for p, a in found.items():
        if covered[p] < a:
            cuts = [(1000 * a * n[p[0]] // (f[p[: k + 1]] * f[p[:1] + p[k + 1 :]]), k) for k in range(1, len(p) - 1)]
            score, k = min(cuts)
            rows.setdefault(p[0], []).append((-score, -a, " ".join(p[1:]).encode(), f[p[: k + 1]], f[p[:1] + p[k + 1 :]]))
    return sorted(
        (lang, i, phrase.decode(), -a, l, r, n[lang], -score)
        for lang, of in rows.items() for i, (score, a, phrase, l, r) in enumerate(sorted(of)[:top], 1)
    )
