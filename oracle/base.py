"""Common table expressions of the checking SQL: the ticket model, routing, responses, fact."""

from __future__ import annotations

from ticketloom import vocab as V
from ticketloom.functions.safety import FORBIDDEN
from ticketloom.plans import testmodel as M


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def one_of(values) -> str:
    return "(" + ", ".join(lit(v) for v in values) + ")"


def num(column: str) -> str:
    """Number text as in the rule details."""
    return f"CAST(CAST({column} AS DOUBLE) AS VARCHAR)"


def cat(*parts: str) -> str:
    """String concatenation where NULL makes NULL."""
    return "(" + " || ".join(parts) + ")"


def ratio(n: str, d: str, places: int) -> str:
    """round(n/d, places) half away from zero in whole numbers, then as DOUBLE."""
    n, d = f"CAST({n} AS HUGEINT)", f"nullif(CAST({d} AS HUGEINT), 0)"
    units = f"(CASE WHEN {n} < 0 THEN -1 ELSE 1 END * ((abs({n}) * {2 * 10**places} + {d}) // (2 * {d})))"
    return f"(CAST({units} AS DOUBLE) / {float(10**places)})"


def pct(n: str, d: str) -> str:
    return ratio(f"({n}) * 100", d, 2)


def frac(n: str, d: str) -> str:
    return f"(CAST({n} AS DOUBLE) / nullif(CAST({d} AS DOUBLE), 0))"


def count_if(condition: str) -> str:
    return f"count(*) FILTER (WHERE {condition})"


def derived(columns: dict[str, str], source: str) -> str:
    return "SELECT " + ", ".join(f"{e} AS {n}" for n, e in columns.items()) + " FROM " + source


def replaced(columns: dict[str, str], source: str) -> str:
    return "SELECT * REPLACE (" + ", ".join(f"{e} AS {n}" for n, e in columns.items()) + f") FROM {source}"


def listing(*items: str) -> str:
    """Joined text of the items that are not NULL."""
    return "concat_ws(' | ', " + ", ".join(items) + ")"


CAT, CONF, SENT = "ai_predicted_category", "classification_confidence", "sentiment_score"
UPSET = f"coalesce({SENT} <= -0.7, false)"
VIP = "coalesce(order_value >= 450 AND customer_segment = 'VIP', false)"
UNSURE = f"({CAT} IS NOT NULL AND ({CONF} IS NULL OR {CONF} < 0.75))"
SENSITIVE = f"coalesce({CAT} IN {one_of(V.SENSITIVE)}, false)"
NO_ORDER = f"(coalesce({CAT} IN {one_of(V.ORDER_DEPENDENT)}, false) AND order_id IS NULL)"
CLASH = f"coalesce({CAT} = 'Complaint' AND {SENT} > 0.3, false)"
LEVEL = (
    f"CASE WHEN {CAT} = 'Complaint' THEN 3 WHEN {CAT} IN ('Damaged Product', 'Missing Item', 'Payment Problem') THEN 2 "
    f"WHEN {CAT} IN ('Order Status Inquiry', 'Product Question', 'Other') THEN 0 ELSE 1 END"
)
NAMED = "list_extract(['Low', 'Medium', 'High', 'Urgent'], {} + 1)"
# (rule, fired, fired text, quiet text, floor, review, conflict)
def _rules():
    c = lambda *p: cat(*p)
    quote = lit("'")
    return [
        ("base_category_priority", "true",
         f"CASE WHEN {CAT} IS NULL THEN {lit('No AI-predicted category available; defaulting to Medium pending classification.')} "
         f"ELSE {c(lit('Category '), quote, CAT, quote, lit(' maps to base priority '), quote, NAMED.format('(' + LEVEL + ')'), quote, lit('.'))} END",
         lit(""), LEVEL, False, False),
        ("strong_negative_sentiment_priority", UPSET,
         c(lit("sentiment_score="), num(SENT), lit(" <= -0.7: raising priority floor to High.")),
         lit("Sentiment not strongly negative (or not available)."), "2", False, False),
        ("high_value_vip_order_priority", VIP,
         c(lit("VIP customer with order_value="), num("order_value"), lit(" >= 450.0: raising priority floor to High.")),
         lit("Not a high-value VIP order (or order/segment data unavailable)."), "2", False, False),
        ("missing_classification", f"({CAT} IS NULL)", lit("No AI classification available for this ticket yet."),
         lit("AI classification is present."), None, True, False),
        ("low_confidence", UNSURE,
         f"CASE WHEN {CONF} IS NULL THEN {lit('Classification present but no confidence score was recorded.')} "
         f"ELSE {c(lit('classification_confidence='), num(CONF), lit(' < 0.75.'))} END",
         f"CASE WHEN {CAT} IS NULL THEN {lit('No classification to assess confidence for.')} ELSE {lit('Confidence meets the threshold.')} END",
         None, True, False),
        ("sensitive_category", SENSITIVE, c(lit("Category "), quote, CAT, quote, lit(" is flagged as sensitive/high-risk.")),
         lit("Category is not on the sensitive list."), None, True, False),
        ("strong_negative_sentiment_review", UPSET, c(lit("sentiment_score="), num(SENT), lit(" <= -0.7.")),
         lit("Sentiment not strongly negative (or not available)."), None, True, False),
        ("missing_order_context", NO_ORDER,
         c(lit("Category "), quote, CAT, quote, lit(" is order-specific but no order_id is linked to this ticket.")),
         lit("Order context is consistent with the category (or not applicable)."), None, True, True),
        ("sentiment_category_conflict", CLASH,
         c(lit("Category is 'Complaint' but sentiment_score="), num(SENT), lit(" > 0.3 reads positive — signals conflict.")),
         lit("No category/sentiment conflict detected."), None, True, True),
    ]


RULES = _rules()


def outside(column: str, low: float, high: float | None = None) -> str:
    above = "" if high is None else f" OR {column} > {high}"
    return f"coalesce(isnan(CAST({column} AS DOUBLE)) OR {column} < {low}{above}, false)"


ROUTE_BAD = [
    "ticket_id IS NULL",
    outside(CONF, 0, 1),
    outside(SENT, -1, 1),
    outside("order_value", 0),
    f"coalesce({CAT} NOT IN {one_of(V.CATEGORIES)}, false)",
    f"coalesce(customer_segment NOT IN {one_of(V.SEGMENTS)}, false)",
]


def routed(source: str) -> str:
    """Decisions over a context relation."""
    floor = "greatest(" + ", ".join(f"CASE WHEN {r[1]} THEN {r[4]} ELSE -1 END" for r in RULES if r[4]) + ")"
    review = " OR ".join(r[1] for r in RULES if r[5])
    conflict = " OR ".join(r[1] for r in RULES if r[6])
    fired = listing(*[f"CASE WHEN {r[1]} THEN {lit(r[0])} END" for r in RULES])
    reasons = listing(*[f"CASE WHEN {r[1]} THEN {r[2]} END" for r in RULES])
    n_fired = " + ".join(f"CAST({r[1]} AS INT)" for r in RULES)
    errors = " + ".join(f"CAST({b} AS INT)" for b in ROUTE_BAD)
    return (
        f"SELECT *, CASE WHEN decision_path = 'Automated' THEN 'AUTO_RESOLVE' WHEN final_priority IN ('High', 'Urgent') "
        f"THEN 'HUMAN_REVIEW_URGENT' ELSE 'HUMAN_REVIEW_STANDARD' END AS recommended_action FROM ("
        f"SELECT *, n_errors > 0 AS is_fallback, "
        f"CASE WHEN n_errors > 0 THEN 'Medium' ELSE {NAMED.format(floor)} END AS final_priority, "
        f"CASE WHEN n_errors > 0 OR {review} THEN 'Human Review' ELSE 'Automated' END AS decision_path, "
        f"CASE WHEN n_errors > 0 THEN 'fallback_invalid_input' ELSE {fired} END AS triggered_rules, "
        f"CASE WHEN n_errors > 0 THEN 1 ELSE {n_fired} END AS n_fired, {reasons} AS reasons, "
        f"n_errors = 0 AND ({conflict}) AS conflicting_signals "
        f"FROM (SELECT *, {errors} AS n_errors FROM {source}))"
    )


CODES = {}
for _code, _pattern in FORBIDDEN:
    CODES.setdefault(_code, []).append(_pattern)


def unsafe_codes(text: str) -> str:
    found = [
        "CASE WHEN " + " OR ".join(f"regexp_matches({text}, {lit('(?i)' + p)})" for p in CODES[code]) + f" THEN {lit(code)} END"
        for code in sorted(CODES)
    ]
    return "concat_ws(', ', " + ", ".join(found) + ")"


PROBLEMS = [
    (f"({CAT} IS NULL)", lit("classification is missing (unexpected: decision_path is Automated).")),
    (f"({CONF} IS NULL)", lit("classification_confidence is missing.")),
    (f"coalesce({CONF} < 0.75, false)", cat(lit("classification_confidence "), num(CONF), lit(" is below the 0.75 threshold."))),
    (SENSITIVE, cat(lit("category '"), CAT, lit("' is sensitive."))),
    (UPSET, cat(lit("sentiment_score "), num(SENT), lit(" is strongly negative."))),
    (NO_ORDER, cat(lit("category '"), CAT, lit("' requires order context, but no order is linked."))),
]
TYPES = "CASE " + CAT + " " + " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in V.RESPONSE_TYPE_OF.items()) + " END"


def eligible(source: str, internal: bool = True) -> str:
    unsafe = " OR ".join(c for c, _ in PROBLEMS)
    found = listing(lit(V.RECHECK_FAILED), *[f"CASE WHEN {c} THEN {t} END" for c, t in PROBLEMS])
    sound = listing(
        cat(lit("classification present ("), CAT, lit(").")),
        cat(lit("confidence "), num(CONF), lit(" meets threshold.")),
        f"CASE WHEN order_id IS NOT NULL THEN {lit('required order context is present.')} END",
    )
    need = "('automated_eligible', 'human_review')" if internal else "('automated_eligible')"
    return (
        f"SELECT *, eligibility IN {need} AS needs_generation FROM (SELECT * , {TYPES} AS r_type, "
        f"CASE WHEN decision_path IS NULL THEN 'no_phase4_decision' WHEN decision_path = 'Human Review' OR {unsafe} "
        f"THEN 'human_review' ELSE 'automated_eligible' END AS eligibility, "
        f"CASE WHEN decision_path IS NULL THEN {lit(V.NO_DECISION_YET)} WHEN decision_path = 'Human Review' "
        f"THEN {lit(V.RESPECT_HUMAN_REVIEW)} WHEN {unsafe} THEN {found} ELSE {sound} END AS eligibility_reasons FROM {source})"
    )


def responded(source: str, generator: bool = True, internal: bool = True) -> str:
    """Response decisions; ``source`` must carry the generation columns where there is a generator."""
    if generator:
        inner = (
            "SELECT *, CASE WHEN error_type IS NULL AND json_valid(tool_input_json) AND json_type(tool_input_json) = 'OBJECT' "
            f"THEN CAST(tool_input_json AS JSON) END AS doc FROM ({eligible(source, internal)})"
        )
        inner = (
            "SELECT *, json_extract_string(doc, '$.can_generate') AS flag, "
            f"nullif(trim(json_extract_string(doc, '$.draft_text')), '') AS txt FROM ({inner})"
        )
        inner = f"SELECT *, {unsafe_codes('txt')} AS codes FROM ({inner})"
        inner = (
            "SELECT *, CASE WHEN NOT needs_generation THEN NULL WHEN error_type IS NOT NULL THEN error_type "
            "WHEN flag IS NULL THEN 'malformed_response' WHEN flag <> 'true' THEN 'model_declined' "
            f"WHEN txt IS NULL THEN 'empty_draft' WHEN codes <> '' THEN 'safety_violation' END AS failure FROM ({inner})"
        )
        missing = "coalesce(nullif(array_to_string(CAST(json_extract_string(doc, '$.missing_information[*]') AS VARCHAR[]), ', '), ''), 'unspecified')"
        note = (
            "CASE WHEN NOT needs_generation THEN NULL "
            f"WHEN eligibility = 'human_review' AND failure IS NULL THEN {lit(V.INTERNAL_DRAFT_OK)} "
            f"WHEN eligibility = 'human_review' THEN {cat(lit('Internal draft not produced ('), 'failure', lit('); ticket still awaits human review regardless.'))} "
            f"WHEN failure IS NULL THEN {lit(V.AUTOMATED_OK)} "
            f"WHEN failure = 'safety_violation' THEN {cat(lit('Draft was generated but BLOCKED by the safety scan: '), 'codes', lit('. The offending text is deliberately not retained.'))} "
            f"WHEN failure = 'model_declined' THEN {cat(lit('No draft produced — insufficient grounded context (missing: '), missing, lit(').'))} "
            f"ELSE {cat(lit('No draft produced — generation failed ('), 'failure', lit(').'))} END"
        )
        ok, draft = "failure IS NULL", "CASE WHEN needs_generation AND failure IS NULL THEN txt END"
    else:
        inner = eligible(source, internal)
        note = (
            f"CASE eligibility WHEN 'human_review' THEN {lit(V.INTERNAL_DRAFT_SKIPPED)} "
            f"WHEN 'automated_eligible' THEN {lit(V.AUTOMATED_SKIPPED)} END"
        )
        ok, draft = "false", "CAST(NULL AS VARCHAR)"
    return (
        "SELECT *, d_status = 'DRAFT_GENERATED' AS customer_facing, d_status IN ('HUMAN_REVIEW_DRAFT', 'BLOCKED') AS requires_human_review, "
        "false AS is_fallback FROM ("
        "SELECT *, CASE eligibility WHEN 'no_phase4_decision' THEN 'NOT_ELIGIBLE' WHEN 'human_review' THEN 'HUMAN_REVIEW_DRAFT' "
        f"ELSE CASE WHEN {ok} THEN 'DRAFT_GENERATED' ELSE 'BLOCKED' END END AS d_status, {draft} AS d_draft, "
        f"concat_ws(' | ', eligibility_reasons, {note}) AS rationale FROM ({inner}))"
    )


US = {
    "first": "epoch_us(first_response_at) - epoch_us(created_at)",
    "resolution": "epoch_us(resolved_at) - epoch_us(created_at)",
    "rule": "epoch_us(rule_decision_at) - epoch_us(created_at)",
    "response": "epoch_us(response_generated_at) - epoch_us(created_at)",
}
MINUTE, HOUR = 60_000_000, 3_600_000_000
SCORE = "CASE final_priority WHEN 'Low' THEN 0 WHEN 'Medium' THEN 1 WHEN 'High' THEN 2 WHEN 'Urgent' THEN 3 END"


def fact_sql(tickets: str) -> str:
    return (
        "SELECT t.ticket_id, t.created_at, t.first_response_at, t.resolved_at, t.channel, t.category AS ground_truth_category, "
        "t.ai_predicted_category, t.classification_confidence, t.priority AS original_priority, t.final_priority, t.status, "
        "t.decision_path, t.resolution_type, t.sentiment_score, t.decision_at, t.rule_decision_at, t.response_status, "
        "t.response_type, t.response_generated_at, c.customer_segment, c.country, c.is_active AS customer_is_active, t.order_id, "
        "o.order_status, o.total_amount AS order_total_amount, o.payment_method, o.order_date, o.expected_delivery_date, "
        "o.actual_delivery_date, CAST(o.actual_delivery_date - o.expected_delivery_date AS BIGINT) AS delivery_delay_days, "
        f"{ratio(US['first'], str(MINUTE), 2)} AS first_response_minutes, {ratio(US['resolution'], str(HOUR), 2)} AS resolution_hours, "
        f"{ratio(US['rule'], str(HOUR), 2)} AS rule_decision_hours, {ratio(US['response'], str(HOUR), 2)} AS response_generation_hours, "
        f"CAST({SCORE} AS BIGINT) AS final_priority_score, "
        "CASE WHEN t.decision_path IS NULL THEN NULL WHEN t.decision_path = 'Automated' THEN 'AUTO_RESOLVE' "
        "WHEN t.final_priority IN ('High', 'Urgent') THEN 'HUMAN_REVIEW_URGENT' ELSE 'HUMAN_REVIEW_STANDARD' END AS recommended_action "
        f"FROM {tickets} t JOIN fx_customers c ON t.customer_id = c.customer_id LEFT JOIN fx_orders o ON t.order_id = o.order_id"
    )


EMPTY_LATER = (
    "CAST(NULL AS VARCHAR) AS final_priority, CAST(NULL AS TIMESTAMP) AS rule_decision_at, CAST(NULL AS VARCHAR) AS response_status, "
    "CAST(NULL AS VARCHAR) AS response_type, CAST(NULL AS VARCHAR) AS response_draft, CAST(NULL AS TIMESTAMP) AS response_generated_at"
)
_TICKET_COLUMNS = ", ".join(M.TICKETS)
CTES: dict[str, str] = {
    "fx_customers": derived(M.CUSTOMERS, "customer JOIN nation ON c_nationkey = n_nationkey"),
    "fx_products": derived(M.PRODUCTS, "part"),
    "fx_orders": derived(M.ORDERS, "orders"),
    "fx_order_items": derived(M.ORDER_ITEMS, "lineitem"),
    "fx_tickets": derived(M.TICKETS, f"events LEFT JOIN orders ON o_orderkey = event_id AND {M.TICKET_ORDER_LINK}"),
    "contexts": (
        f"SELECT t.ticket_id, {CAT}, {CONF}, {SENT}, t.order_id, CAST(o.total_amount AS DOUBLE) AS order_value, c.customer_segment "
        "FROM fx_tickets t JOIN fx_customers c ON t.customer_id = c.customer_id LEFT JOIN fx_orders o ON t.order_id = o.order_id"
    ),
    "broken_contexts": derived(M.BROKEN_CONTEXTS, "contexts"),
    "routed": routed("contexts"),
    "broken_routed": routed("broken_contexts"),
    "decided": (
        f"SELECT {', '.join('t.' + c for c in M.TICKETS if c != 'decision_path')}, "
        f"CASE WHEN {M.DECIDED.replace('ticket_id', 't.ticket_id')} THEN r.final_priority END AS final_priority, "
        f"CASE WHEN {M.DECIDED.replace('ticket_id', 't.ticket_id')} THEN r.decision_path END AS decision_path, "
        f"CASE WHEN {M.DECIDED.replace('ticket_id', 't.ticket_id')} THEN "
        f"{M.RULE_DECISION_AT.replace('ticket_id', 't.ticket_id')} END AS rule_decision_at "
        "FROM fx_tickets t JOIN routed r ON t.ticket_id = r.ticket_id"
    ),
    "broken_answers": replaced(M.BROKEN_ANSWERS, "decided"),
    "adding_up": (
        f"SELECT * EXCLUDE (line_sum) REPLACE ({M.ADDED_UP} AS total_amount) FROM (SELECT o.*, s.line_sum FROM fx_orders o LEFT JOIN "
        "(SELECT order_id, sum(line_total) AS line_sum FROM fx_order_items GROUP BY order_id) s ON o.order_id = s.order_id)"
    ),
    "generations": derived(M.GENERATIONS, "fx_tickets"),
    "decided_generated": "SELECT d.*, g.error_type, g.tool_input_json FROM decided d JOIN generations g ON d.ticket_id = g.ticket_id",
    "responded": responded("decided_generated"),
    "stored": (
        f"SELECT {_TICKET_COLUMNS}, final_priority, rule_decision_at, "
        f"CASE WHEN {M.PROCESSED} THEN d_status END AS response_status, CASE WHEN {M.PROCESSED} THEN r_type END AS response_type, "
        f"CASE WHEN {M.PROCESSED} THEN d_draft END AS response_draft, "
        f"CASE WHEN {M.PROCESSED} THEN {M.RESPONSE_AT} END AS response_generated_at FROM responded"
    ),
    "broken_stored": replaced(M.BROKEN_STORED, "stored"),
    "fact": fact_sql("stored"),
    "early": f"SELECT *, {EMPTY_LATER} FROM fx_tickets",
    "early_fact": fact_sql("early"),
    **{f"broken_{t}": replaced(M.BROKEN[t], f"fx_{t}") for t in M.BROKEN},
    "names": (
        "SELECT order_id, string_agg(product_name, ', ' ORDER BY product_name) AS product_names FROM "
        "(SELECT DISTINCT order_id, product_name FROM fx_order_items JOIN fx_products USING (product_id)) GROUP BY order_id"
    ),
    "outputs": derived(M.CLASSIFIER_OUTPUTS, "fx_tickets"),
    "gated": replaced(M.GATED, "fx_tickets"),
    "gated_contexts": (
        f"SELECT t.ticket_id, {CAT}, {CONF}, {SENT}, t.order_id, CAST(o.total_amount AS DOUBLE) AS order_value, c.customer_segment "
        "FROM gated t JOIN fx_customers c ON t.customer_id = c.customer_id LEFT JOIN fx_orders o ON t.order_id = o.order_id"
    ),
    "gated_routed": routed("gated_contexts"),
    "updates": (
        derived(M.UPDATES, f"fx_tickets WHERE {M.UPDATED}") + " UNION ALL " + derived(M.REPEATS, f"fx_tickets WHERE {M.REPEATED}")
    ),
    "settled": (
        "SELECT ticket_id, count(DISTINCT concat_ws('|', final_priority, decision_path, coalesce(CAST(rule_decision_at AS VARCHAR), '-'))) AS variants, "
        "min(final_priority) AS final_priority, min(decision_path) AS decision_path, min(rule_decision_at) AS rule_decision_at "
        "FROM updates WHERE ticket_id IS NOT NULL GROUP BY ticket_id"
    ),
    "judged": (
        "SELECT s.*, CASE WHEN variants > 1 THEN 'clashing_updates' WHEN g.ticket_id IS NULL THEN 'no_such_ticket' "
        "WHEN g.order_id IS NULL OR EXISTS (SELECT 1 FROM fx_orders o WHERE o.order_id = g.order_id AND o.customer_id = g.customer_id) THEN NULL "
        "WHEN EXISTS (SELECT 1 FROM fx_orders o WHERE o.order_id = g.order_id) THEN 'order_of_other_customer' ELSE 'no_such_order' END AS reason "
        "FROM settled s LEFT JOIN gated g ON s.ticket_id = g.ticket_id"
    ),
    "rewritten": (
        "SELECT t.ticket_id, t.category, t.created_at, t.first_response_at, t.resolved_at, "
        + ", ".join(
            f"CASE WHEN {p.replace('ticket_id', 't.ticket_id')} THEN {columns[c].replace('ticket_id', 't.ticket_id').replace('created_at', 't.created_at')} "
            f"ELSE {'t.' + c if c in M.TICKETS else 'NULL'} END AS {c}"
            for p, columns, names in ((M.PREDICTED, M.PREDICTIONS, V.CLASSIFIER_COLUMNS), (M.ANSWERED, M.ANSWERS, V.RESPONSE_COLUMNS))
            for c in names
        )
        + ", j.final_priority, j.decision_path, j.rule_decision_at FROM gated t LEFT JOIN judged j ON t.ticket_id = j.ticket_id AND j.reason IS NULL"
    ),
}
_ORDER = list(CTES)


def used(text: str) -> list[str]:
    """Names of the expressions a statement needs, in definition order."""
    import re

    need: set[str] = set()
    todo = [text]
    while todo:
        words = set(re.findall(r"\w+", todo.pop()))
        for name in _ORDER:
            if name in words and name not in need:
                need.add(name)
                todo.append(CTES[name])
    return [n for n in _ORDER if n in need]


def statement(text: str) -> str:
    names = used(text)
    if not names:
        return text
    head = ",\n".join(f"{n} AS ({CTES[n]})" for n in names)
    return f"WITH {head}\n" + (", " + text[5:] if text.startswith("WITH ") else text)
