"""Plain single-process versions of the operators' results, for comparison."""

from __future__ import annotations

import base64
import hashlib
import itertools
import re
import zlib
from collections import Counter


def fold(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def warc(pages):
    least = {}
    for page_id, _, html in pages:
        body = (html or "").encode()
        if page_id is not None:
            least[body] = min(page_id, least.get(body, page_id))
    out = []
    for page_id, _, html in pages:
        body = (html or "").encode()
        first = least.get(body)
        response = first is None or page_id == first
        out.append((page_id, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(),
                    "response" if response else "revisit", None if response else first))
    return out


def contamination(docs, items):
    word = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = {}
    for item_id, text in items:
        w = word.findall(fold(text))
        n = min(13, len(w))
        for b in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[b:b + n]), set()).add(item_id)
    out = []
    for doc_id, text in docs:
        w, hit, found = word.findall(fold(text)), set(), set()
        for n in {len(x) for x in windows}:
            for b in range(len(w) - n + 1):
                ids = windows.get(tuple(w[b:b + n]))
                if ids:
                    hit.update(range(b, b + n))
                    found |= ids
        names = sorted(str(i) for i in found if i is not None)
        out.append((doc_id, len(w), len(hit), len(names),
                    hashlib.sha256(",".join(names).encode()).hexdigest(),
                    bool(hit) and 20 * len(hit) >= len(w)))
    return out


def base_rules(docs):
    out = []
    for doc_id, text in docs:
        text = text or ""
        words = re.findall("[^\x20\x09-\x0D]+", text)
        three = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
        n = Counter(three)
        covered = {i + j for i, t in enumerate(three) if n[t] > 1 for j in range(3)}
        seen, dup = set(), 0
        for line in text.split("\n"):
            if re.search("[^\x20\x09-\x0D]", line):
                dup += line in seen
                seen.add(line)
        out.append((doc_id, len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)),
                    dup, len(covered), len(words) < 50 or 100 * len(covered) > 50 * len(words)))
    return out


def components(docs):
    sets = []
    for _, text in docs:
        w = re.findall("[^\x20\x09-\x0D]+", fold(text))
        sets.append({tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5
                    else {tuple(w)} if w else set())
    parent = list(range(len(docs)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 4 * min(len(a), len(b)) >= 3 * max(len(a), len(b)):
                both = len(a & b)
                if 100 * both >= 75 * (len(a) + len(b) - both):
                    parent[root(i)] = root(j)
    least = {}
    for i, (doc_id, _) in enumerate(docs):
        if doc_id is not None:
            r = root(i)
            least[r] = min(doc_id, least.get(r, doc_id))
    return [(d, len(s), least.get(root(i)) if s else d)
            for i, ((d, _), s) in enumerate(zip(docs, sets))]


def spans(docs):
    def luhn(s):
        total = 0
        for i, c in enumerate(reversed(re.sub("[^0-9]", "", s))):
            d = int(c) * (2 if i % 2 else 1)
            total += d - 9 if d > 9 else d
        return total % 10 == 0

    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         lambda s: all(int(p) <= 255 for p in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+",
         lambda s: 16 <= len(re.sub("[^0-9]", "", s)) <= 19 and luhn(s)),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]",
         lambda s: 8 <= len(re.sub("[^0-9]", "", s)) <= 15)]
    out = []
    for doc_id, text in docs:
        found, counts = [], []
        for kind, pattern, ok in kinds:
            own = [f"{kind}:{m.start()}:{m.end()}" for m in re.finditer(pattern, text or "")
                   if ok(m[0])]
            counts.append(len(own))
            found += own
        out.append((doc_id, *counts, hashlib.sha256(",".join(found).encode()).hexdigest(), found))
    return out


def lines(docs, min_words=25):
    """Runs of lines (those without words left out) that stand in a lesser document or earlier in
    the text, taken out from ``min_words`` words on."""
    def known(line):
        return re.findall("[^\x20\x09-\x0D]+", fold(line))

    def rank(doc_id):
        return (doc_id is None, doc_id or 0)

    least = {}
    for doc_id, text in docs:
        for line in (text or "").split("\n"):
            key = " ".join(known(line))
            least[key] = min(rank(doc_id), least.get(key, rank(doc_id)))
    out = []
    for doc_id, text in docs:
        parts = text.split("\n") if text else []
        seen, flags = set(), []
        for i, line in enumerate(parts):
            key = " ".join(known(line))
            if key:
                flags.append((i, len(known(line)), key in seen or least[key] < rank(doc_id)))
                seen.add(key)
        gone = set()
        for _, run in itertools.groupby(flags, key=lambda f: f[2]):
            run = list(run)
            if run[0][2] and sum(n for _, n, _ in run) >= min_words:
                gone |= {i for i, _, _ in run}
        ends = list(itertools.accumulate(len(p) + 1 for p in parts))
        out.append((doc_id, len(parts), len(gone),
                    ",".join(f"{ends[i] - len(parts[i]) - 1}:{ends[i] - 1}" for i in sorted(gone)),
                    "\n".join(p for i, p in enumerate(parts) if i not in gone)))
    return out


def token_rows(docs, tokenizer, end_id):
    """(doc_id, start, n, crc) in ascending id order; documents have distinct ids."""
    out, start = [], 0
    for doc_id, text in sorted(docs, key=lambda d: (d[0] is not None, d[0])):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [end_id]
        data = b"".join(i.to_bytes(4, "little") for i in ids)
        out.append((doc_id, start, len(ids), zlib.crc32(data)))
        start += len(ids)
    return out


def bpe_rows(docs, encoding):
    out = []
    for doc_id, text in docs:
        ids = encoding.encode_ordinary(text or "")
        out.append((doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                    hashlib.sha256((text or "").encode()).hexdigest()))
    return out
