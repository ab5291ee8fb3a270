"""Plain single-machine versions of the operators, and texts that reach their odd cases."""

import re
from collections import Counter

import numpy as np
import xxhash

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def smallest_reachable(nodes, links):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    return {n: root(n) for n in nodes}


def simhash(text):
    words = SPACED.findall((text or "").translate(LOWER))
    runs = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def without_word_windows(texts, width=20):
    seen, out = set(), {}
    for key in sorted(texts):
        words = SPACED.findall(texts[key] or "")
        gone = [False] * len(words)
        for i in range(len(words) - width + 1):
            window = tuple(words[i : i + width])
            if window in seen:
                gone[i : i + width] = [True] * width
            seen.add(window)
        out[key] = (len(words), sum(gone), " ".join(w for w, g in zip(words, gone, strict=True) if not g))
    return out


def without_byte_windows(texts, width=200):
    data = {k: (t or "").encode() for k, t in texts.items()}
    count = Counter(b[i : i + width] for b in data.values() for i in range(len(b) - width + 1))
    out = {}
    for k, b in data.items():
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - width + 1):
            if count[b[i : i + width]] > 1:
                gone[i : i + width] = True
        runs = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        out[k] = (len(b), int(gone.sum()), runs, np.frombuffer(b, np.uint8)[~gone].tobytes())
    return out


def luhn(digits):
    worth = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return sum(w - 9 * (w > 9) for w in worth) % 10 == 0


def base_spans(text):
    out = []
    for no, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            fine = {
                "email": lambda: True,
                "ip": lambda: all(int(p) <= 255 for p in m[0].split(".")),  # noqa: B023
                "card": lambda: 12 <= len(digits) <= 19 and luhn(digits),  # noqa: B023
                "phone": lambda: 9 <= len(digits) <= 15,  # noqa: B023
            }[kind]()
            if fine:
                out.append((m.start(), no, m.end(), kind))
    return sorted(out)


def contamination(text, items, width=10):
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))

    own, hit, found = words(text), set(), set()
    for item, t in items:
        w = words(t)
        for i in range(max(1, len(w) - width + 1) if w else 0):
            window = w[i : i + width]
            for j in range(len(own) - len(window) + 1):
                if own[j : j + len(window)] == window:
                    hit.update(range(j, j + len(window)))
                    found.add(str(item))
    return len(own), len(hit), sorted(found)


def odd_texts(seed=5, n=120):
    """Shared and cut passages, runs of one word, several kinds of space, empty and null and long texts, repeats."""
    import random

    rng = random.Random(seed)
    words = ["a", "B", "the", "é", "x.y@z.io", "10.0.0.255", "+1 (743) 555-3824", "4785380592391139", "😀", "256.1.1.1"]
    passages = [[rng.choice(words) for _ in range(rng.randint(12, 60))] for _ in range(8)]
    texts = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randint(0, 5)):
            p = rng.choice(passages)
            parts += rng.choice([p, p[rng.randint(0, 9) :], ["z"] * rng.randint(1, 60), [rng.choice(words) for _ in range(rng.randint(1, 30))]])
        texts.append(rng.choice([" ", "\n", " \t "]).join(parts))
    return [*texts, None, "", " ", texts[3], texts[3], " ".join(f"w{i % 9}" for i in range(4000)), "9" * 30_000, "y" * 3000]
