"""Reading of model output: lenient typing over a variant column, as SQL expression text."""

from __future__ import annotations

from ticketloom.functions.sql import q

NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
WHOLE = r"^[+-]?\d+$"
OPENS_OBJECT = r"^\s*\{"


def json_object(text: str) -> str:
    """The parsed JSON object; NULL for NULL, blank, broken JSON or any other JSON kind.

    Of a key that is there more than once in the object the last one counts. The
    parser refuses such objects; they are read entry by entry and written again
    without the earlier ones. No session setting is touched. Repeated keys inside a field's own value are refused.
    """
    entries = f"map_entries(from_json({text}, 'MAP<STRING, VARIANT>'))"
    last = "filter(es, (e, i) -> NOT exists(slice(es, i + 2, size(es)), later -> later.key = e.key))"
    again = f"to_json(transform(array({entries}), es -> map_from_entries({last}))[0])"
    whole = f"json_array_length(concat('[', {text}, ']')) = 1"  # the parsers stop at the end of the object and let text behind it pass
    return f"CASE WHEN rlike({text}, {q(OPENS_OBJECT)}) AND {whole} THEN coalesce(try_parse_json({text}), try_parse_json({again})) END"


def get(document: str, field: str, kind: str) -> str:
    return f"try_variant_get({document}, '$.{field}', '{kind}')"


def kind(document: str, field: str) -> str:
    """Type name of a field: STRING, BOOLEAN, BIGINT, DECIMAL..., VOID (JSON null); NULL if absent."""
    return f"schema_of_variant({get(document, field, 'variant')})"


def field(document: str, name: str) -> str:
    """``struct<kind, text>`` of a field: all the lenient readers need, read once."""
    return f"named_struct('kind', {kind(document, name)}, 'text', {get(document, name, 'string')})"


def is_number(f: str) -> str:
    return f"({f}.kind IN ('BIGINT', 'DOUBLE', 'FLOAT') OR {f}.kind LIKE 'DECIMAL%')"


def lenient_double(f: str) -> str:
    """Number, number in quotes, or true/false as 1/0; NULL for anything else."""
    return (
        f"CASE WHEN {is_number(f)} THEN try_cast({f}.text AS DOUBLE) "
        f"WHEN {f}.kind = 'BOOLEAN' THEN CASE WHEN {f}.text = 'true' THEN 1D ELSE 0D END "
        f"WHEN {f}.kind = 'STRING' AND rlike({f}.text, {q(NUMBER)}) THEN try_cast(trim({f}.text) AS DOUBLE) END"
    )


def lenient_long(f: str) -> str:
    """Whole number, whole number in quotes, ``3.0``, or true/false; NULL for anything else."""
    cut = rf"regexp_replace(trim({f}.text), '\\.0+$', '')"
    return (
        f"CASE WHEN {is_number(f)} THEN coalesce(try_cast(CASE WHEN rlike({cut}, {q(WHOLE)}) THEN {cut} END AS BIGINT), "
        f"CASE WHEN try_cast({f}.text AS DOUBLE) = floor(try_cast({f}.text AS DOUBLE)) "
        f"THEN try_cast(try_cast({f}.text AS DOUBLE) AS BIGINT) END) "
        f"WHEN {f}.kind = 'BOOLEAN' THEN CASE WHEN {f}.text = 'true' THEN 1L ELSE 0L END "
        f"WHEN {f}.kind = 'STRING' AND rlike({cut}, {q(WHOLE)}) THEN try_cast({cut} AS BIGINT) END"
    )


def lenient_boolean(f: str) -> str:
    """true/false, 1/0, or the usual words; NULL for anything else."""
    number = f"try_cast({f}.text AS DOUBLE)"
    return (
        f"CASE WHEN {f}.kind = 'BOOLEAN' THEN {f}.text = 'true' "
        f"WHEN {is_number(f)} THEN CASE WHEN {number} = 1 THEN true WHEN {number} = 0 THEN false END "
        f"WHEN {f}.kind = 'STRING' THEN CASE WHEN lower({f}.text) IN ('1', 't', 'true', 'on', 'y', 'yes') THEN true "
        f"WHEN lower({f}.text) IN ('0', 'f', 'false', 'off', 'n', 'no') THEN false END END"
    )


def truthy(f: str) -> str:
    """Whether the value counts as true: not absent, null, false, 0, '' or an empty array/object."""
    return (
        f"coalesce(CASE WHEN {f}.kind = 'VOID' THEN false WHEN {f}.kind = 'BOOLEAN' THEN {f}.text = 'true' "
        f"WHEN {is_number(f)} THEN try_cast({f}.text AS DOUBLE) <> 0 WHEN {f}.kind = 'STRING' THEN {f}.text <> '' "
        f"ELSE {f}.text NOT IN ('[]', '{{}}') END, false)"
    )
