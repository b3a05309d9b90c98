"""Plain restatements of the contracts, to hold the operators against."""
import collections
import hashlib
import re
import zlib

import numpy as np


def table(spark, name, sf="/root/testdata/sf0.001"):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (2 if i % 2 else 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def digits(m):
    return re.sub("[^0-9]", "", m.group())


def any_case(word):
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


PII = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
     lambda m: all(int(p) <= 255 for p in m.group().split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(digits(m)) <= 19 and luhn(digits(m))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(digits(m)) <= 15)]
NAMES = "|".join(any_case(w) for w in ("password", "passwd", "secret", "token", "api_?key"))
SECRETS = [
    ("assign", rf"""({NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
     lambda m: len(m.group(2)) >= 12),
    ("access", r"AKIA[A-Z0-9]+", lambda m: len(m.group()) >= 18),
    ("hex", r"[0-9a-f]+", lambda m: len(m.group()) >= 16)]


def spans(patterns, text):
    """Counts per kind and the digest of all base spans."""
    found = sorted((m.start(), k, m.end()) for k, (_, p, ok) in enumerate(patterns)
                   for m in re.finditer(p, text or "") if ok(m))
    line = ",".join(f"{patterns[k][0]}:{s}:{e}" for s, k, e in found)
    return [sum(f[1] == k for f in found) for k in range(len(patterns))], \
        hashlib.sha256(line.encode()).hexdigest(), line


def components(n, links):
    """Smallest reachable index of every node."""
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def fingerprint(text, k=3):
    from xxhash import xxh64_intdigest
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    grams = [" ".join(words[i:i + k]) for i in range(max(1, len(words) - k + 1))]
    hs = [xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def rule_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    grams = collections.Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
    cover = {j for i in range(len(words) - 4) if grams[tuple(words[i:i + 5])] > 1 for j in range(i, i + 5)}
    n, r = len(words), len(cover)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, r, n < 10 or 100 * r > 20 * n


def linked_vectors(rows, cosine=0.95):
    """(n_links, component index) per row; None and bad vectors link with nothing."""
    def good(v):
        return (v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v)
                and any(v))
    ok = [i for i, v in enumerate(rows) if good(v)]
    u = {i: np.asarray(rows[i], float) / np.linalg.norm(np.asarray(rows[i], float)) for i in ok}
    links = [(a, b) for x, a in enumerate(ok) for b in ok[x + 1:]
             if len(u[a]) == len(u[b]) and u[a] @ u[b] >= cosine]
    n = collections.Counter(i for pair in links for i in pair)
    return [n[i] for i in range(len(rows))], components(len(rows), links)
