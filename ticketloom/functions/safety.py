"""Scan of draft texts for claims that must not be made, as SQL expression text."""

from __future__ import annotations

from ticketloom.functions.sql import any_of, kept, q

# --- Fixed values: reason codes and patterns ---------------------------------------
COMPLETED = "(?:processed|issued|approved|completed|applied|sent|given|credited|refunded|finalized|granted)"
ACTED = "(?:processed|issued|approved|completed|applied|resolved|fixed|corrected|finalized|granted)"
FORBIDDEN = [
    ("refund_claimed_or_promised",
     r"\brefund(?:s|ed|ing)?\b.{0,30}\b(?:has been|have been|will be|is being|was)\s+" + COMPLETED + r"\b"),
    ("refund_claimed_or_promised",
     r"\b(we have|we've|i have|i've)\b.{0,15}\bissued\s+(?:a|the|your)\s+refund"),
    ("payment_reversal_claimed",
     r"\b(payment|charge|transaction)\b.{0,25}\b(has been|have been|was|is being)\s+(?:reversed|refunded|cancelled|voided)\b"),
    ("compensation_promised",
     r"\b(compensation|store credit|discount)\b.{0,25}\b(will be (?:applied|given|issued|provided)|has been (?:applied|given|issued|provided))\b"),
    ("account_change_claimed",
     r"\byour account\b.{0,25}\b(?:has been|have been|was)\b.{0,15}\b(?:updated|changed|fixed|corrected|reset)\b"),
    ("shipment_or_order_change_claimed",
     r"\b(your order|your shipment|your shipping address)\b.{0,25}\b(?:has been|have been|was)\b.{0,15}\b(?:updated|changed|cancelled|expedited|resent)\b"),
    ("action_performed_claimed",
     r"\b(i have|i've|we have|we've)\b.{0,10}\b" + ACTED + r"\b.{0,15}\b(?:your|the)\b"),
    ("internal_architecture_mentioned",
     r"\b(ai model|language model|large language model|\bllm\b|classification model|machine learning|artificial intelligence|confidence score)\b"),
    ("internal_architecture_mentioned",
     r"\b(as an ai|i am an ai|i'm an ai)\b"),
]

# Ignore case by Unicode rules, "." stops at \n only, word and space classes by Unicode.
FLAGS = "(?idU)"
STRIPPED = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"


# Literal openings of each pattern, in pattern order: a text without any of
# them cannot match, and a search for a literal costs far less than the pattern.
OPENINGS = [
    ["refund"],
    ["we have", "we've", "i have", "i've"],
    ["payment", "charge", "transaction"],
    ["compensation", "store credit", "discount"],
    ["your account"],
    ["your order", "your shipment", "your shipping address"],
    ["i have", "i've", "we have", "we've"],
    ["ai model", "language model", "llm", "classification model", "machine learning", "artificial intelligence",
     "confidence score"],
    ["as an ai", "i am an ai", "i'm an ai"],
]
# Letters outside ASCII that count as s, i or k when case is ignored.
FOLDING = ["ſ", "ı", "İ", "\u212a"]


def lowered(text: str) -> str:
    """The text in lower case for the search of openings; NULL where lower case does not show all matches.

    Keep it in a column of its own: it is read once per opening.
    """
    odd = any_of(f"contains({text}, {q(c)})" for c in FOLDING)
    return f"CASE WHEN NOT {odd} THEN lower({text}) END"


def _matches(i: int, text: str, low: str) -> str:
    """Whether pattern ``i`` occurs."""
    possible = any_of(f"contains({low}, {q(o)})" for o in OPENINGS[i])
    return f"({text} IS NOT NULL AND coalesce({possible}, true) AND rlike({text}, {q(FLAGS + FORBIDDEN[i][1])}))"


def violation_codes(text: str, low: str) -> str:
    """Sorted distinct reason codes found in the text; empty for NULL or ''. ``low`` is its ``lowered`` column."""
    by_code: dict[str, list[str]] = {}
    for i, (code, _) in enumerate(FORBIDDEN):
        by_code.setdefault(code, []).append(_matches(i, text, low))
    return kept(f"CASE WHEN {any_of(by_code[code])} THEN {q(code)} END" for code in sorted(by_code))


def violations(text: str, low: str) -> str:
    """``array<struct<pattern_no, code, matched>>`` in pattern order, with the first match of each."""
    hits = ", ".join(
        f"CASE WHEN {_matches(i, text, low)} THEN named_struct('pattern_no', {i + 1}, 'code', {q(code)}, "
        f"'matched', regexp_extract({text}, {q(FLAGS + pattern)}, 0)) END"
        for i, (code, pattern) in enumerate(FORBIDDEN)
    )
    return f"filter(array({hits}), h -> h IS NOT NULL)"


def strip(text: str) -> str:
    """Trim every Unicode space at both ends, not only blanks."""
    return f"regexp_replace({text}, {q(STRIPPED)}, '')"
