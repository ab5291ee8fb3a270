"""Exact rounding, durations and number text, as SQL expression text."""

from __future__ import annotations

MICROS_PER_MINUTE = 60 * 10**6
MICROS_PER_HOUR = 3600 * 10**6


def half_up_units(num: str, den: str, places: int) -> str:
    """``round(num / den, places)`` times ``10**places``, as bigint, half away from zero.

    Integer arithmetic only: a decimal quotient would already be rounded once
    before the final rounding, and a double one may miss an exact half. NULL
    where ``den`` is 0 or NULL. ``num`` may be bigint or decimal(p,0).
    """
    safe = f"nullif(CAST({den} AS DECIMAL(30,0)), 0)"
    units = f"((CAST(abs({num}) AS DECIMAL(30,0)) * {2 * 10**places} + {safe}) div (2 * {safe}))"
    return f"(CASE WHEN {num} < 0 THEN -1 ELSE 1 END * {units})"


def units_to_decimal(units: str, places: int) -> str:
    step = f"CAST(0.{'0' * (places - 1)}1 AS DECIMAL({places},{places}))"
    return f"CAST(CAST({units} AS DECIMAL(18,0)) * {step} AS DECIMAL(20,{places}))"


def half_up_ratio(num: str, den: str, places: int) -> str:
    return units_to_decimal(half_up_units(num, den, places), places)


def pct(num: str, den: str) -> str:
    """Percentage with 2 decimals over counts; NULL on an empty population."""
    return half_up_ratio(f"({num}) * 100", den, 2)


def fraction(num: str, den: str) -> str:
    """Unrounded fraction over counts, as double; NULL on an empty population."""
    return f"CAST({num} AS DOUBLE) / CAST(nullif({den}, 0) AS DOUBLE)"


def exact_sum(value: str) -> str:
    """Sum of a bigint expression that cannot overflow."""
    return f"sum(CAST({value} AS DECIMAL(18,0)))"


def micros_between(start: str, end: str) -> str:
    """Microseconds from start to end, as bigint.

    By the interval between the two: ``timestampdiff`` would read timestamps
    without zone in the session's zone and shift them where its clock changes.
    """
    seconds = f"CAST(CAST({end} - {start} AS INTERVAL SECOND) AS DECIMAL(18,6))"
    return f"CAST({seconds} * 1000000 AS BIGINT)"


def duration_hundredths(micros: str, unit_micros: int) -> str:
    """Duration in hundredths of a unit, rounded half away from zero."""
    return (
        f"(CASE WHEN {micros} < 0 THEN -1 ELSE 1 END * "
        f"((abs({micros}) * 200 + {unit_micros}) div {2 * unit_micros}))"
    )


def duration(micros: str, unit_micros: int) -> str:
    return units_to_decimal(duration_hundredths(micros, unit_micros), 2)


def money(value: str) -> str:
    """Money to the cent, half away from zero; ``value`` must be a decimal."""
    return f"round({value}, 2)"


def number_text(value: str) -> str:
    """A number as Python prints a float: ``0.9``, ``450.0``, ``12345678.0``, ``1e-05``."""
    d = f"CAST({value} AS DOUBLE)"
    text = f"CAST({d} AS STRING)"
    digits = f"trim(TRAILING '0' FROM CAST(CAST({text} AS DECIMAL(38,21)) AS STRING))"
    exponent = f"regexp_replace(regexp_replace(replace({text}, '.0E', 'E'), 'E(\\\\d)', 'E+$1'), 'E([+-])(\\\\d)$', 'E$10$2')"
    return (
        f"CASE WHEN NOT contains({text}, 'E') THEN {text} "
        f"WHEN abs({d}) >= 1e-4 AND abs({d}) < 1e16 THEN regexp_replace({digits}, '[.]$', '.0') "
        f"ELSE replace({exponent}, 'E', 'e') END"
    )
