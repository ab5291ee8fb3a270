"""Short texts with planted values of which it is known whether they are personal data: what the candidate trees learn from."""

from __future__ import annotations

import string

import numpy as np

#: Used where the corpus has no words.
SYLLABLES = ["ba", "den", "kor", "li", "mun", "os", "per", "ta"]
#: (kind, is personal, sentence); {} is the value, {w} a word of the corpus. Of each kind and answer every second sentence is held out.
SENTENCES = [
    ("password", True, "{w} password = {} {w}"),
    ("password", True, '{w} "passwd": "{}", {w}'),
    ("password", True, "{w} {w} password: {}\n{w}"),
    ("password", True, "{w} secret: {} {w} {w}"),
    ("phrase", True, "{w} password = {} {w}"),
    ("phrase", True, "{w} secret='{}' {w}"),
    ("phrase", True, "{w} passwd={}\n{w} {w}"),
    ("phrase", True, '{w} password: "{}" {w}'),
    ("key", True, "{w} api_key = {} {w}"),
    ("key", True, "{w} access-key: {}, {w} {w}"),
    ("key", True, '{w} token = "{}" {w}'),
    ("key", True, "{w} TOKEN={}; {w}"),
    ("word", False, "{w} the secret: {} {w} {w}"),
    ("word", False, "{w} token: {} {w} {w} {w}"),
    ("word", False, "{w} {w} password: {}, {w} {w}"),
    ("word", False, "{w} the password: {}. {w} {w}"),
    ("word", False, "{w} secret: {}\n{w} {w}"),
    ("word", False, "{w} an access key: {} {w} {w}"),
    ("hex", True, "{w} {w} {} {w}"),
    ("hex", True, "{w}: {}, {w} {w}"),
    ("digits", False, "{w} {w} {} {w}"),
    ("digits", False, "{w}: {}, {w} {w}"),
    ("local", True, "{w} call {} {w}"),
    ("local", True, "{w} {w}, {} {w}"),
    ("local", True, "{w} {w} {} {w}"),
    ("local", True, "{w} tel {}. {w}"),
    ("part", False, "{w} {w} {} {w}"),
    ("part", False, "{w} part {}. {w}"),
    ("part", False, "{w} call {} {w}"),
    ("part", False, "{w}, {} {w}"),
    ("national", True, "{w} {w} {} {w}"),
    ("national", True, "{w}: {}, {w}"),
    ("unassigned", False, "{w} {w} {} {w}"),
    ("unassigned", False, "{w}: {}, {w}"),
    ("iban", True, "{w} account {} {w}"),
    ("iban", True, "{w} {w}: {}. {w}"),
    ("code", False, "{w} {w} {} {w}"),
    ("code", False, "{w} form {}, {w}"),
]


def _from(draw: np.random.Generator, letters: str, n: int) -> str:
    return "".join(letters[i] for i in draw.integers(0, len(letters), n))


def value(draw: np.random.Generator, kind: str, words: list[str]) -> str:
    """A value of its kind; the kinds of words come from the corpus."""

    def word() -> str:
        return words[int(draw.integers(0, len(words)))]

    both = string.ascii_letters + string.digits
    if kind == "password":
        marks = _from(draw, "!@#$%^&*_-+?", int(draw.integers(1, 4)))
        rest = _from(draw, both, int(draw.integers(7, 16)))
        return "".join(np.array(list(marks + rest))[draw.permutation(len(marks + rest))]) + _from(draw, both, 1)
    if kind == "phrase":
        return [_from(draw, string.ascii_lowercase, 12), word() + word(), word() + _from(draw, string.digits, 3), word() + "-" + word(), word().capitalize() + word().capitalize()][int(draw.integers(0, 5))].ljust(8, "x")
    if kind == "key":
        return ["", "sk_live_", "ghp_"][int(draw.integers(0, 3))] + _from(draw, both, int(draw.integers(16, 40)))
    if kind == "word":  # of the corpus, or of letters that its words may never hold together
        return word().ljust(6, "e") if draw.random() < 0.5 else _from(draw, string.ascii_lowercase, int(draw.integers(6, 22)))
    if kind == "hex":
        return _from(draw, "0123456789abcdef", int(draw.choice([24, 32, 40, 64])))
    if kind == "digits":
        return _from(draw, string.digits, int(draw.integers(24, 40)))
    if kind in ("local", "part"):
        first = _from(draw, "23456789" if kind == "local" else "01", 1)
        return first + _from(draw, string.digits, 2) + str(draw.choice(["-", ".", " "])) + _from(draw, string.digits, 3) + "-" + _from(draw, string.digits, 4)
    if kind == "national":
        return f"{int(draw.integers(1, 666)):03d}-{int(draw.integers(1, 100)):02d}-{int(draw.integers(1, 10000)):04d}"
    if kind == "unassigned":
        return f"{draw.choice(['000', '666', '9' + _from(draw, string.digits, 2)])}-{_from(draw, string.digits, 2)}-{_from(draw, string.digits, 4)}"
    if kind == "iban":
        return _from(draw, string.ascii_uppercase, 2) + _from(draw, string.digits, int(draw.choice([16, 18, 20, 22])) + 2)
    return _from(draw, string.ascii_uppercase, 2) + _from(draw, string.digits, 2) + "".join(" " + _from(draw, string.ascii_uppercase, 4) for _ in range(4))


def texts(words: list[str], each: int = 60, seed: int = 17) -> list[tuple[int, str, int, int, bool, bool]]:
    """``(id, text, start, end, personal, held_out)``: ``each`` texts of every sentence, with the place of the planted value."""
    draw = np.random.default_rng(seed)
    words = words or [a + b for a in SYLLABLES for b in SYLLABLES]
    seen: dict[tuple[str, bool], int] = {}
    rows = []
    for kind, personal, sentence in SENTENCES:
        turn = seen[kind, personal] = seen.get((kind, personal), 0) + 1
        for _ in range(each):
            filled = sentence
            while "{w}" in filled:
                filled = filled.replace("{w}", words[int(draw.integers(0, len(words)))], 1)
            before, _, after = filled.partition("{}")
            own = value(draw, kind, words)
            rows.append((len(rows), before + own + after, len(before), len(before) + len(own), personal, turn % 2 == 0))
    return rows
