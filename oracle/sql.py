"""One DuckDB statement per registered query."""

from __future__ import annotations

from oracle.base import (
    CAT, CONF, HOUR, MINUTE, RULES, SCORE, SENT, US, count_if, eligible, fact_sql, frac, lit, num, one_of, pct,
    ratio, responded, statement,
)
from ticketloom import vocab as V
from ticketloom.functions.safety import FORBIDDEN
from ticketloom.operators.selfcheck import all_errors
from ticketloom.plans import testmodel as M

SQL: dict[str, str] = {}
DECISION = (
    "ticket_id, final_priority, decision_path, recommended_action, triggered_rules, reasons, conflicting_signals, is_fallback"
)
SQL["route_summary"] = "SELECT decision_path, final_priority, count(*) AS tickets FROM routed GROUP BY ALL"
SQL["route_decisions"] = f"SELECT {DECISION} FROM routed"
SQL["route_rule_outcomes"] = " UNION ALL ".join(
    f"SELECT ticket_id, CAST({i} AS BIGINT) AS rule_no, {lit(name)} AS rule_name, {fired} AS triggered, "
    f"CASE WHEN {fired} THEN {hot} ELSE {quiet} END AS detail, "
    + (
        f"CASE WHEN {fired} THEN list_extract(['Low', 'Medium', 'High', 'Urgent'], ({floor}) + 1) END"
        if floor
        else "CAST(NULL AS VARCHAR)"
    )
    + f" AS priority_floor, {fired} AND {review} AS forces_human_review, {fired} AND {conflict} AS is_conflict_signal FROM contexts"
    for i, (name, fired, hot, quiet, floor, review, conflict) in enumerate(RULES, 1)
)
FIRED = "SELECT unnest(string_split(triggered_rules, ' | ')) AS rule_name FROM {}"
SQL["route_rule_frequency"] = f"SELECT rule_name, count(*) AS n FROM ({FIRED.format('routed')}) GROUP BY 1"
SENTIMENT_BAND = (
    f"CASE WHEN {SENT} IS NULL THEN 'missing' WHEN {SENT} <= -0.7 THEN 'very_negative (<= -0.7)' "
    f"WHEN {SENT} <= -0.3 THEN 'negative (-0.7 to -0.3)' WHEN {SENT} < 0.3 THEN 'neutral (-0.3 to 0.3)' "
    f"WHEN {SENT} < 0.7 THEN 'positive (0.3 to 0.7)' ELSE 'very_positive (>= 0.7)' END"
)
CONFIDENCE_BAND = (
    f"CASE WHEN {CONF} IS NULL THEN 'missing' WHEN {CONF} < 0.75 THEN 'below_threshold (< 0.75)' "
    "ELSE 'at_or_above_threshold (>= 0.75)' END"
)


def breakdown(source: str, context: str) -> str:
    parts = [f"SELECT 'priority' AS dimension, final_priority AS key FROM {source}"]
    for name, band in (
        ("category", f"coalesce({CAT}, '(unclassified)')"), ("sentiment", SENTIMENT_BAND), ("confidence", CONFIDENCE_BAND)
    ):
        parts.append(f"SELECT '{name}', {band} FROM {source} WHERE {context}")
    return " UNION ALL ".join(parts)


SQL["route_breakdown"] = (
    "SELECT dimension, key, count(*) AS n FROM (" + breakdown("broken_routed", "NOT is_fallback")
    + f" UNION ALL SELECT 'rule', rule_name FROM ({FIRED.format('broken_routed')})) GROUP BY 1, 2"
)
SQL["route_fallback"] = (
    "SELECT coalesce(ticket_id, -1) AS ticket_id, final_priority, decision_path, recommended_action, triggered_rules, "
    "conflicting_signals, is_fallback, CAST(n_errors AS BIGINT) AS n_errors FROM broken_routed"
)
URGENT = "decision_path = 'Human Review' AND final_priority IN ('High', 'Urgent')"
RATES = (
    f"count(*) AS n_processed, {frac(count_if("decision_path = 'Automated'"), 'count(*)')} AS automated_rate, "
    f"{frac('count(*) - ' + count_if("decision_path = 'Automated'"), 'count(*)')} AS human_review_rate, "
    f"{frac(count_if(URGENT), 'count(*)')} AS urgent_human_review_rate"
)
SQL["rules_eval"] = (
    f"SELECT {RATES}, {frac(count_if('n_fired > 1'), 'count(*)')} AS multi_rule_frequency, "
    f"{frac(count_if('conflicting_signals'), 'count(*)')} AS conflict_frequency, "
    f"{frac(count_if('is_fallback'), 'count(*)')} AS fallback_frequency, 'REAL (in-memory batch run)' AS metric_provenance FROM broken_routed"
)
NULLS = ", ".join(f"CAST(NULL AS DOUBLE) AS {n}" for n in ("multi_rule_frequency", "conflict_frequency", "fallback_frequency"))
SQL["rules_eval_stored"] = (
    f"SELECT {RATES}, {NULLS}, 'REAL (derived from database)' AS metric_provenance FROM decided WHERE decision_path IS NOT NULL"
)
SQL["rules_breakdown_stored"] = (
    "WITH rows_ AS (SELECT * FROM decided WHERE decision_path IS NOT NULL) "
    f"SELECT dimension, key, count(*) AS n FROM ({breakdown('rows_', 'true')}) GROUP BY 1, 2"
)
SQL["rules_batch_summary"] = (
    f"SELECT count(*) AS tickets_processed, {count_if("decision_path = 'Automated'")} AS n_automated, "
    f"{count_if("decision_path = 'Human Review'")} AS n_human_review, {count_if('is_fallback')} AS n_fallback FROM broken_routed"
)

# --- picks ---
PICK = f"SELECT ticket_id, message_text, category AS ground_truth_category FROM fx_tickets WHERE {CAT} IS NULL"
SQL["pick_unclassified"] = PICK
SQL["pick_unclassified_first"] = PICK + " ORDER BY ticket_id LIMIT 10"
CTX = f"ticket_id, {CAT}, CAST({CONF} AS DOUBLE) AS {CONF}, CAST({SENT} AS DOUBLE) AS {SENT}, order_id, order_value, customer_segment"
SQL["context_for_rules"] = f"SELECT {CTX} FROM contexts"
SQL["context_for_rules_first"] = (
    f"SELECT {CTX} FROM contexts WHERE ticket_id IN (SELECT ticket_id FROM decided WHERE decision_path IS NULL) ORDER BY ticket_id LIMIT 10"
)


def response_context(tickets: str) -> str:
    return (
        f"SELECT t.ticket_id, t.message_text, t.{CAT}, CAST(t.{CONF} AS DOUBLE) AS {CONF}, CAST(t.{SENT} AS DOUBLE) AS {SENT}, "
        "t.decision_path, t.final_priority, t.order_id, o.order_status, CAST(o.expected_delivery_date AS VARCHAR) AS expected_delivery_date, "
        "CAST(o.actual_delivery_date AS VARCHAR) AS actual_delivery_date, c.customer_segment, n.product_names "
        f"FROM {tickets} t JOIN fx_customers c ON t.customer_id = c.customer_id LEFT JOIN fx_orders o ON t.order_id = o.order_id "
        "LEFT JOIN names n ON t.order_id = n.order_id"
    )


SQL["context_for_response"] = response_context("stored") + " WHERE t.response_status IS NULL"
SQL["context_for_response_first"] = SQL["context_for_response"] + " ORDER BY t.ticket_id LIMIT 10"
SQL["evaluation_scan"] = (
    f"SELECT ticket_id, category AS ground_truth_category, {CAT}, CAST({CONF} AS DOUBLE) AS {CONF} FROM fx_tickets WHERE {CAT} IS NOT NULL"
)
SQL["routing_results_scan"] = (
    f"SELECT ticket_id, {CAT}, CAST({CONF} AS DOUBLE) AS {CONF}, CAST({SENT} AS DOUBLE) AS {SENT}, final_priority, decision_path "
    "FROM decided WHERE decision_path IS NOT NULL"
)
SQL["response_results_scan"] = (
    f"SELECT ticket_id, {CAT}, decision_path, final_priority, response_status, response_type, response_draft IS NOT NULL AS has_draft "
    "FROM stored WHERE response_status IS NOT NULL"
)
SQL["order_product_names"] = "SELECT order_id, product_names FROM names"

# --- safety and responses ---
PLANTED = (
    f"SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN text || chr(10) || {M.DRAFT_TEXT.replace('ticket_id', 'doc_id')} "
    f"ELSE {M.DRAFT_TEXT.replace('ticket_id', 'doc_id')} || chr(10) || text END AS text FROM documents"
)
HITS = " UNION ALL ".join(
    f"SELECT doc_id, CAST({i} AS BIGINT) AS pattern_no, {lit(code)} AS code, regexp_extract(text, {lit('(?i)' + p)}, 0) AS matched FROM planted"
    for i, (code, p) in enumerate(FORBIDDEN, 1)
)
SQL["safety_scan"] = f"WITH planted AS ({PLANTED}) SELECT * FROM ({HITS}) WHERE matched <> ''"
SQL["safety_by_code"] = (
    f"WITH planted AS ({PLANTED}) SELECT code, count(DISTINCT doc_id) AS documents FROM ({HITS}) WHERE matched <> '' GROUP BY code"
)
SQL["response_eligibility"] = (
    f"SELECT ticket_id, r_type AS response_type, eligibility, eligibility_reasons, needs_generation FROM ({eligible('decided')})"
)
SQL["response_recheck"] = (
    "WITH claimed AS (SELECT * REPLACE ('Automated' AS decision_path) FROM decided) "
    f"SELECT ticket_id, eligibility, eligibility_reasons FROM ({eligible('claimed')})"
)
ANSWER = (
    "SELECT ticket_id, d_status AS response_status, r_type AS response_type, d_draft AS response_draft, customer_facing, "
    "requires_human_review, rationale, is_fallback FROM "
)
SQL["response_decisions"] = ANSWER + "responded"
SQL["response_decisions_no_generator"] = ANSWER + f"({responded('decided', generator=False)})"
ANSWER_ERRORS = [
    ("ticket_id IS NULL", lit("ticket_id: missing or not an integer")), ("message_text IS NULL", lit("message_text: required")),
    (f"{CONF} NOT BETWEEN 0 AND 1", lit("classification_confidence: not in [0, 1]")),
    (f"{SENT} NOT BETWEEN -1 AND 1", lit("sentiment_score: not in [-1, 1]")),
    (f"{CAT} NOT IN {one_of(V.CATEGORIES)}", lit("ai_predicted_category: '") + f" || {CAT} || " + lit("' is not an approved category")),
    (f"decision_path NOT IN {one_of(V.DECISION_PATHS)}", lit("decision_path: '") + " || decision_path || " + lit("' is not a valid decision_path")),
]
SQL["response_fallback"] = (
    "SELECT coalesce(ticket_id, -1) AS ticket_id, CASE WHEN n_errors > 0 THEN 'NOT_ELIGIBLE' ELSE d_status END AS response_status, "
    "n_errors > 0 AS is_fallback, n_errors = 0 AND customer_facing AS customer_facing, n_errors = 0 AND requires_human_review AS requires_human_review, "
    "n_errors, CASE WHEN n_errors > 0 THEN " + lit("Input validation failed, defaulted to safe NOT_ELIGIBLE fallback: ") + " || problems END AS reason FROM ("
    "SELECT *, CAST(" + " + ".join(f"CASE WHEN {c} THEN 1 ELSE 0 END" for c, _ in ANSWER_ERRORS) + " AS BIGINT) AS n_errors, concat_ws('; ', "
    + ", ".join(f"CASE WHEN {c} THEN {t} END" for c, t in ANSWER_ERRORS) + f") AS problems FROM ({responded('broken_answers', generator=False)}))"
)
SQL["response_decisions_no_internal"] = ANSWER + f"({responded('decided_generated', internal=False)})"
KNOWN = f"response_status IN {one_of(V.RESPONSE_STATUSES)}"
FLAGS_OFF = (
    f"{KNOWN} AND NOT ((ticket_id % 5 = 0) = (response_status = 'DRAFT_GENERATED') "
    "AND (ticket_id % 5 <> 0) = (response_status IN ('HUMAN_REVIEW_DRAFT', 'BLOCKED')))"
)
HAS_TEXT = "coalesce(response_draft, '') <> ''"
SQL["response_invariants"] = " UNION ALL ".join(
    f"SELECT ticket_id, {lit(name)} AS violation FROM broken_stored WHERE response_status IS NOT NULL AND {bad}"
    for name, bad in (
        ("response_status not approved", f"NOT ({KNOWN})"),
        ("response_type not approved", f"response_type NOT IN {one_of(V.RESPONSE_TYPES)}"),
        ("flags do not match response_status", FLAGS_OFF),
        ("DRAFT_GENERATED without response_draft", f"response_status = 'DRAFT_GENERATED' AND NOT {HAS_TEXT}"),
        ("response_draft on a status without draft", f"response_status IN ('BLOCKED', 'NOT_ELIGIBLE') AND {HAS_TEXT}"),
    )
)


def response_rates(status: str, attempted: str, draft: str) -> str:
    internal = f"{status} = 'HUMAN_REVIEW_DRAFT'"
    tries, wins = count_if(attempted), count_if(f"{attempted} AND {draft}")
    shares = {
        "automated_response_eligible_rate": "DRAFT_GENERATED", "human_review_response_rate": "HUMAN_REVIEW_DRAFT",
        "blocked_response_rate": "BLOCKED", "not_eligible_rate": "NOT_ELIGIBLE",
    }
    rates = ", ".join(f"{frac(count_if(status + ' = ' + lit(v)), 'count(*)')} AS {n}" for n, v in shares.items())
    return (
        f"count(*) AS n_processed, {rates}, {tries} AS draft_generation_attempted, {wins} AS draft_generation_succeeded, "
        f"{frac(wins, tries)} AS draft_generation_success_rate, "
        f"{frac(count_if(f'{internal} AND {draft}'), count_if(internal))} AS internal_draft_rate"
    )


SKIPPED = " OR ".join(f"contains(lower(rationale), {lit(m)})" for m in V.SKIPPED_MARKERS)
MISSING = " OR ".join(f"contains(lower(rationale), {lit(m)})" for m in V.MISSING_CONTEXT_MARKERS)


def response_eval(source: str) -> str:
    attempted = f"(d_status <> 'NOT_ELIGIBLE' AND NOT ({SKIPPED}))"
    return (
        f"SELECT {response_rates('d_status', attempted, 'd_draft IS NOT NULL')}, "
        f"{frac(count_if(MISSING), 'count(*)')} AS missing_context_rate, {frac(count_if('is_fallback'), 'count(*)')} AS fallback_rate, "
        f"'REAL (in-memory batch run)' AS metric_provenance FROM {source}"
    )


SQL["response_eval"] = response_eval("responded")
SQL["response_eval_no_generator"] = response_eval(f"({responded('decided', generator=False)})")
SQL["response_eval_stored"] = (
    f"SELECT {response_rates('response_status', 'response_status <> ' + lit('NOT_ELIGIBLE'), 'response_draft IS NOT NULL')}, "
    "CAST(NULL AS DOUBLE) AS missing_context_rate, CAST(NULL AS DOUBLE) AS fallback_rate, "
    "'REAL (derived from database)' AS metric_provenance FROM stored WHERE response_status IS NOT NULL"
)
SQL["response_breakdown"] = (
    "SELECT dimension, key, count(*) AS n FROM (SELECT 'response_status' AS dimension, response_status AS key FROM stored "
    "WHERE response_status IS NOT NULL UNION ALL SELECT 'response_type', coalesce(response_type, '(unknown/unclassified)') "
    "FROM stored WHERE response_status IS NOT NULL) GROUP BY 1, 2"
)
SQL["response_batch_summary"] = (
    "SELECT count(*) AS tickets_processed, "
    + ", ".join(
        f"{count_if('d_status = ' + lit(v))} AS {n}"
        for n, v in (
            ("n_draft_generated", "DRAFT_GENERATED"), ("n_human_review_draft", "HUMAN_REVIEW_DRAFT"), ("n_blocked", "BLOCKED"),
            ("n_not_eligible", "NOT_ELIGIBLE"),
        )
    )
    + f", {count_if('is_fallback')} AS n_fallback FROM responded"
)
SQL["response_flags"] = (
    "SELECT ticket_id, response_status, response_status = 'DRAFT_GENERATED' AS customer_facing, "
    "response_status IN ('HUMAN_REVIEW_DRAFT', 'BLOCKED') AS requires_human_review FROM stored"
)
NL = "chr(10)"
SQL["response_prompts"] = (
    f"WITH ctx AS ({response_context('stored')} WHERE t.response_status IS NULL) SELECT ticket_id, concat_ws({NL}, "
    f"concat('Customer message:', {NL}, '\"\"\"', {NL}, message_text, {NL}, '\"\"\"'), '', "
    f"concat('Predicted category: ', coalesce({CAT}, 'unknown')), concat('Sentiment score (-1 to 1): ', coalesce({num(SENT)}, 'None')), "
    "concat('Priority: ', coalesce(final_priority, 'unknown')), concat('Customer segment: ', coalesce(customer_segment, 'unknown')), "
    "concat('Response purpose type: ', coalesce(r_type, 'unknown')), "
    "CASE WHEN order_id IS NULL THEN 'No order is linked to this ticket.' ELSE concat('Linked order: order_status=', "
    "coalesce(order_status, 'None'), ', expected_delivery_date=', coalesce(expected_delivery_date, 'None'), "
    "', actual_delivery_date=', coalesce(actual_delivery_date, 'None')) END, "
    "CASE WHEN order_id IS NOT NULL AND product_names <> '' THEN concat('Products in this order: ', product_names) END) AS prompt "
    f"FROM ({eligible('ctx')}) WHERE needs_generation"
)

# --- classification ---
SQL["classification_prompts"] = (
    f"SELECT conv_id, turn, concat('Customer support message:', {NL}, '\"\"\"', {NL}, text, {NL}, '\"\"\"') AS prompt "
    "FROM conversations"
)
SQL["ticket_prompts"] = (
    f"SELECT ticket_id, concat('Customer support message:', {NL}, '\"\"\"', {NL}, message_text, {NL}, '\"\"\"') AS prompt FROM ({PICK})"
)
SQL["model_calls"] = (
    "SELECT ticket_id, CASE WHEN length(prompt) % 5 = 0 THEN 'rate_limit' END AS error_type, length(prompt) AS input_tokens, "
    f"'length' AS model FROM ({SQL['ticket_prompts']})"
)
J = lambda f: f"json_extract_string(doc, '$.{f}')"
JT = lambda f: f"json_type(doc, '$.{f}')"
NUMERIC = "('BIGINT', 'UBIGINT', 'DOUBLE')"


def lenient(f: str) -> str:
    return (
        f"CASE WHEN {JT(f)} IN {NUMERIC} OR {JT(f)} = 'VARCHAR' THEN try_cast({J(f)} AS DOUBLE) "
        f"WHEN {JT(f)} = 'BOOLEAN' THEN CASE WHEN {J(f)} = 'true' THEN 1 ELSE 0 END END"
    )


CLASSIFIED = (
    "SELECT *, CASE WHEN error_type IS NULL AND json_valid(tool_input_json) AND json_type(tool_input_json) = 'OBJECT' "
    "THEN CAST(tool_input_json AS JSON) END AS doc FROM outputs"
)
CLASSIFIED = (
    f"SELECT ticket_id, error_type AS call_error, doc, input_tokens, output_tokens, {J('category')} AS cat_, {J('priority')} AS pri, "
    f"{lenient('sentiment_score')} AS sent, {lenient('confidence')} AS conf, {JT('order_id')} AS ord_type, "
    f"CASE WHEN {JT('order_id')} IN {NUMERIC} THEN CASE WHEN try_cast({J('order_id')} AS DOUBLE) % 1 = 0 THEN CAST(try_cast({J('order_id')} AS DOUBLE) AS BIGINT) END END AS ord, "
    f"{JT('mentions_customer_info')} AS men_type, {J('mentions_customer_info')} AS men FROM ({CLASSIFIED})"
)
CLASSIFIED = (
    "SELECT *, CASE WHEN call_error IS NOT NULL THEN call_error WHEN doc IS NULL THEN 'malformed_response' "
    f"WHEN coalesce(cat_ NOT IN {one_of(V.CATEGORIES)}, true) THEN 'invalid_category' "
    f"WHEN coalesce(pri NOT IN {one_of(V.PRIORITIES)}, true) THEN 'invalid_priority' "
    "WHEN NOT (coalesce(sent BETWEEN -1 AND 1, false) AND coalesce(conf BETWEEN 0 AND 1, false) "
    "AND (ord_type IS NULL OR ord_type = 'NULL' OR ord IS NOT NULL) AND (men_type IS NULL OR men_type = 'BOOLEAN')) "
    f"THEN 'invalid_response_schema' END AS error FROM ({CLASSIFIED})"
)
CLASSIFIED = f"WITH checked AS (SELECT *, error IS NULL AS ok FROM ({CLASSIFIED})) "
SQL["classification_validation"] = (
    CLASSIFIED + "SELECT ticket_id, ok AS success, error AS error_type, CASE WHEN ok THEN cat_ END AS category, "
    "CASE WHEN ok THEN pri END AS priority, CASE WHEN ok THEN CAST(sent AS DOUBLE) END AS sentiment_score, "
    "CASE WHEN ok THEN CAST(conf AS DOUBLE) END AS confidence, CASE WHEN ok THEN ord END AS order_id, "
    "CASE WHEN ok THEN coalesce(men = 'true', false) END AS mentions_customer_info FROM checked"
)
# Of a key that is there twice the last one counts; this engine takes the first, so the answers stand here.
SQL["classification_repeated_keys"] = (
    "SELECT ticket_id, k IN (0, 1, 4, 5) AS success, CASE WHEN k = 2 THEN 'invalid_category' WHEN k = 3 THEN 'invalid_response_schema' "
    "WHEN k IN (6, 7) THEN 'malformed_response' END AS error_type, CASE WHEN k IN (0, 1, 4) THEN 'Other' WHEN k = 5 THEN 'Complaint' END AS category, "
    "CASE WHEN k IN (0, 4) THEN 'Low' WHEN k = 1 THEN 'High' WHEN k = 5 THEN 'Urgent' END AS priority, "
    "CAST(CASE WHEN k IN (0, 4) THEN 0.1 WHEN k = 1 THEN -0.5 WHEN k = 5 THEN 0 END AS DOUBLE) AS sentiment_score, "
    "CAST(CASE WHEN k IN (0, 4) THEN 0.5 WHEN k = 1 THEN 0.25 WHEN k = 5 THEN 1 END AS DOUBLE) AS confidence, "
    "CAST(CASE WHEN k = 4 THEN 12 END AS BIGINT) AS order_id, CASE WHEN k IN (0, 1, 4, 5) THEN false END AS mentions_customer_info "
    "FROM (SELECT ticket_id, ticket_id % 8 AS k FROM fx_tickets)"
)
SUMS = (
    f"count(*) AS tickets_attempted, {count_if('ok')} AS n_success, {count_if('NOT ok')} AS n_failed, "
    "CAST(coalesce(sum(input_tokens) FILTER (WHERE ok), 0) AS BIGINT) AS total_input_tokens, "
    "CAST(coalesce(sum(output_tokens) FILTER (WHERE ok), 0) AS BIGINT) AS total_output_tokens"
)
SQL["classify_batch_summary"] = CLASSIFIED + f"SELECT {SUMS} FROM checked"
SQL["failures_by_type"] = CLASSIFIED + "SELECT error AS error_type, count(*) AS n FROM checked WHERE NOT ok GROUP BY 1"
SQL["token_cost"] = (
    CLASSIFIED + f"SELECT *, {ratio('total_input_tokens * 15 + total_output_tokens * 60', '100000000', 4)} AS estimated_cost_usd "
    f"FROM (SELECT {SUMS} FROM checked)"
)
LABELS = "SELECT unnest([" + ", ".join(lit(c) for c in V.CATEGORIES) + "]) AS label"
SCORED = (
    f"WITH labels_ AS ({LABELS}), ev AS (SELECT category AS truth, {CAT} AS predicted FROM fx_tickets WHERE {CAT} IS NOT NULL), "
    "scored AS (SELECT label, (SELECT count(*) FROM ev WHERE truth = label) AS support, "
    "(SELECT count(*) FROM ev WHERE predicted = label) AS called, "
    "(SELECT count(*) FROM ev WHERE truth = label AND predicted = label) AS hits FROM labels_), "
    f"per AS (SELECT label AS category, coalesce({frac('hits', 'called')}, 0) AS precision, coalesce({frac('hits', 'support')}, 0) AS recall, "
    f"coalesce({frac('2 * hits', '(called + support)')}, 0) AS f1, support FROM scored) "
)
SQL["classifier_eval"] = (
    SCORED + f"SELECT count(*) AS n_evaluated, round({frac(count_if('truth = predicted'), 'count(*)')}, 9) AS accuracy, "
    "round((SELECT avg(f1) FROM per), 9) AS macro_f1 FROM ev"
)
SQL["classifier_per_category"] = (
    SCORED + "SELECT category, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, support FROM per"
)


def matrix(pairs: str, values: list[str]) -> str:
    names = "SELECT unnest(range(" + str(len(values)) + ")) AS no, unnest([" + ", ".join(lit(v) for v in values) + "]) AS label"
    return (
        f"WITH l AS ({names}), ev AS ({pairs}) SELECT CAST(a.no AS BIGINT) AS truth_no, a.label AS truth, CAST(b.no AS BIGINT) AS predicted_no, "
        "b.label AS predicted, (SELECT count(*) FROM ev WHERE truth = a.label AND predicted = b.label) AS n FROM l a, l b"
    )


SQL["confusion_matrix"] = matrix(f"SELECT category AS truth, {CAT} AS predicted FROM fx_tickets WHERE {CAT} IS NOT NULL", V.CATEGORIES)
SQL["confusion_labels"] = matrix("SELECT CAST(quality AS VARCHAR) AS truth, CAST(toxic AS VARCHAR) AS predicted FROM labels", ["0", "1"])

# --- views ---
FACT_DOUBLES = (
    f"* REPLACE (CAST({CONF} AS DOUBLE) AS {CONF}, CAST({SENT} AS DOUBLE) AS {SENT}, CAST(order_total_amount AS DOUBLE) AS order_total_amount)"
)
SQL["ticket_fact"] = f"SELECT {FACT_DOUBLES} FROM fact"


def classification_block(t: str) -> str:
    low = count_if(f"{CONF} < 0.75")
    hits = count_if(f"{CAT} = category")
    return (
        f"SELECT count(*) AS total_tickets, count({CAT}) AS classified_tickets, count(*) - count({CAT}) AS unclassified_tickets, "
        f"{pct(f'count({CAT})', 'count(*)')} AS classification_coverage_pct, count({CONF}) AS confidence_available, "
        f"{low} AS low_confidence_tickets, {pct(low, f'count({CONF})')} AS low_confidence_rate_pct, "
        f"{ratio(f'sum(CAST({CONF} * 1000 AS BIGINT))', f'count({CONF}) * 1000', 4)} AS average_confidence, "
        f"CAST(min({CONF}) AS DOUBLE) AS minimum_confidence, CAST(max({CONF}) AS DOUBLE) AS maximum_confidence, "
        f"{hits} AS exact_category_matches, {pct(hits, f'count({CAT})')} AS exact_category_match_rate_pct FROM {t}"
    )


def rules_block(t: str) -> str:
    auto, human, urgent = (
        count_if("decision_path = 'Automated'"), count_if("decision_path = 'Human Review'"), count_if(URGENT)
    )
    return (
        f"SELECT count(*) AS total_tickets, count(decision_path) AS tickets_with_rule_decision, {auto} AS automated_decisions, "
        f"{human} AS human_review_decisions, {pct(auto, 'count(decision_path)')} AS automated_rate_pct, "
        f"{pct(human, 'count(decision_path)')} AS human_review_rate_pct, {urgent} AS urgent_human_review, "
        f"{pct(urgent, 'count(decision_path)')} AS urgent_human_review_rate_pct, count(final_priority) AS final_priority_set, "
        f"{ratio(f'sum({SCORE})', f'count({SCORE})', 3)} AS average_priority_score FROM {t}"
    )


STATUS = {
    "DRAFT_GENERATED": ("drafts_generated", "draft_generation_rate_pct"),
    "HUMAN_REVIEW_DRAFT": ("human_review_drafts", "human_review_response_rate_pct"),
    "BLOCKED": ("blocked_responses", "blocked_rate_pct"),
    "NOT_ELIGIBLE": ("not_eligible_responses", "not_eligible_rate_pct"),
}


def responses_block(t: str) -> str:
    counts = ", ".join(f"{count_if('response_status = ' + lit(s))} AS {n}" for s, (n, _) in STATUS.items())
    rates = ", ".join(f"{pct(count_if('response_status = ' + lit(s)), 'count(response_status)')} AS {r}" for s, (_, r) in STATUS.items())
    return (
        f"SELECT count(*) AS total_tickets, count(response_status) AS response_processed, count(*) - count(response_status) "
        f"AS response_not_processed, {counts}, {pct('count(response_status)', 'count(*)')} AS response_processed_rate_pct, {rates} FROM {t}"
    )


def middle(value: str, source: str, by: str = "") -> str:
    """Sum of the two middle values (per group), found by numbering the sorted rows."""
    part = f"PARTITION BY {by} " if by else ""
    total = f"PARTITION BY {by}" if by else ""
    return (
        f"SELECT {by + ', ' if by else ''}CASE WHEN max(c) % 2 = 1 THEN 2 * max(v) FILTER (WHERE rn = (c + 1) // 2) "
        f"ELSE sum(v) FILTER (WHERE rn IN (c // 2, c // 2 + 1)) END AS twice FROM (SELECT {by + ', ' if by else ''}v, "
        f"row_number() OVER ({part}ORDER BY v) AS rn, count(*) OVER ({total}) AS c FROM "
        f"(SELECT {by + ', ' if by else ''}{value} AS v FROM {source}) WHERE v IS NOT NULL)" + (f" GROUP BY {by}" if by else "")
    )


def operational_block(t: str) -> str:
    mean = lambda us, end, unit: ratio(f"sum({us})", f"CAST(count({end}) AS HUGEINT) * {unit}", 2)
    first = ratio(f"({middle(US['first'], t)})", str(2 * MINUTE), 2)
    resolution = ratio(f"({middle(US['resolution'], t)})", str(2 * HOUR), 2)
    return (
        f"SELECT count(*) AS total_tickets, count(first_response_at) AS tickets_with_first_response, "
        f"{mean(US['first'], 'first_response_at', MINUTE)} AS avg_first_response_minutes, {first} AS median_first_response_minutes, "
        f"count(resolved_at) AS resolved_tickets, {mean(US['resolution'], 'resolved_at', HOUR)} AS avg_resolution_hours, "
        f"{resolution} AS median_resolution_hours, count(rule_decision_at) AS tickets_with_rule_decision, "
        f"{mean(US['rule'], 'rule_decision_at', HOUR)} AS avg_rule_decision_hours, count(response_generated_at) AS responses_generated, "
        f"{mean(US['response'], 'response_generated_at', HOUR)} AS avg_response_generation_hours FROM {t}"
    )


SQL["classification_metrics"] = classification_block("fx_tickets")
SQL["rule_decision_metrics"] = rules_block("decided")
SQL["response_metrics"] = responses_block("stored")
SQL["operational_metrics"] = operational_block("stored")
SHOWN = {
    "classification": ["classified_tickets", "classification_coverage_pct", "average_confidence", "low_confidence_rate_pct",
                       "exact_category_match_rate_pct"],
    "rule_decisions": ["tickets_with_rule_decision", "automated_rate_pct", "human_review_rate_pct", "urgent_human_review_rate_pct",
                       "average_priority_score"],
    "responses": ["response_processed", "response_processed_rate_pct", "draft_generation_rate_pct", "blocked_rate_pct"],
    "operational": ["tickets_with_first_response", "avg_first_response_minutes", "median_first_response_minutes", "resolved_tickets",
                    "avg_resolution_hours", "median_resolution_hours"],
}
BLOCKS = lambda t: (
    f"c AS ({classification_block(t)}), r AS ({rules_block(t)}), p AS ({responses_block(t)}), o AS ({operational_block(t)})"
)
SUMMARY = " UNION ALL ".join(
    f"SELECT '{block}' AS block, '{m}' AS metric, CAST({m} AS DOUBLE) AS value, coalesce(CAST(CAST({m} AS DOUBLE) AS VARCHAR), 'NOT AVAILABLE') AS shown "
    f"FROM {alias}"
    for (block, names), alias in zip(SHOWN.items(), "crpo")
    for m in names
)
SQL["all_metrics_summary"] = f"WITH {BLOCKS('stored')} {SUMMARY}"
SQL["metrics_of_undecided"] = f"WITH undecided AS (SELECT * FROM stored WHERE decision_path IS NULL), {BLOCKS('undecided')} {SUMMARY}"
SQL["maintained_metrics"] = f"WITH {BLOCKS('rewritten')} {SUMMARY}"
SQL["backlog"] = (
    f"SELECT count(*) AS total_tickets, count({CAT}) AS classified_tickets, count(*) - count({CAT}) AS unclassified_tickets FROM fx_tickets"
)
SQL["stage_counters"] = (
    f"SELECT count({CAT}) AS classified, count(decision_path) AS decided, count(response_status) AS processed FROM stored"
)
SQL["delivery_delay"] = (
    "SELECT CAST(actual_delivery_date - expected_delivery_date AS BIGINT) AS delivery_delay_days, count(*) AS orders FROM fx_orders GROUP BY 1"
)
SQL["duration_columns"] = (
    f"SELECT ticket_id, {ratio(US['first'], str(MINUTE), 2)} AS first_response_minutes, {ratio(US['resolution'], str(HOUR), 2)} "
    f"AS resolution_hours, {ratio('epoch_us(decision_at) - epoch_us(created_at)', str(HOUR), 2)} AS decision_hours, "
    f"{ratio(US['rule'], str(HOUR), 2)} AS rule_decision_hours, {ratio(US['response'], str(HOUR), 2)} AS response_generation_hours FROM stored"
)

# --- measures ---
COUNTS = {
    "total_tickets": "count(*)",
    "classified_tickets": f"count({CAT})",
    "confidence_available_tickets": f"count({CONF})",
    "low_confidence_tickets": count_if(f"{CONF} < 0.75"),
    "exact_category_matches": count_if(f"{CAT} = ground_truth_category"),
    "tickets_with_first_response": "count(first_response_at)",
    "tickets_with_resolution_timestamp": "count(resolved_at)",
    "tickets_with_rule_decision": "count(decision_path)",
    "automated_decisions": count_if("decision_path = 'Automated'"),
    "human_review_decisions": count_if("decision_path = 'Human Review'"),
    "high_urgent_human_review_tickets": count_if(URGENT),
    "urgent_only_human_review_count": count_if("decision_path = 'Human Review' AND final_priority = 'Urgent'"),
    "response_processed": "count(response_status)",
    "drafts_generated": count_if("response_status = 'DRAFT_GENERATED'"),
    "human_review_drafts": count_if("response_status = 'HUMAN_REVIEW_DRAFT'"),
    "blocked_responses": count_if("response_status = 'BLOCKED'"),
    "not_eligible_responses": count_if("response_status = 'NOT_ELIGIBLE'"),
}
SHARES = [
    ("classification_coverage", "classified_tickets", "total_tickets"),
    ("human_review_rate", "human_review_decisions", "tickets_with_rule_decision"),
    ("automated_rate", "automated_decisions", "tickets_with_rule_decision"),
    ("high_urgent_human_review_rate", "high_urgent_human_review_tickets", "tickets_with_rule_decision"),
    ("resolution_timestamp_rate", "tickets_with_resolution_timestamp", "total_tickets"),
    ("low_confidence_rate", "low_confidence_tickets", "confidence_available_tickets"),
    ("exact_category_match_rate", "exact_category_matches", "classified_tickets"),
    ("response_processed_rate", "response_processed", "total_tickets"),
    ("draft_generation_rate", "drafts_generated", "response_processed"),
    ("human_review_response_rate", "human_review_drafts", "response_processed"),
    ("blocked_rate", "blocked_responses", "response_processed"),
    ("not_eligible_rate", "not_eligible_responses", "response_processed"),
]
# Exact sums: (measure, expression in whole units, units per one)
MEANS = [
    ("avg_classification_confidence", f"CAST({CONF} * 1000 AS BIGINT)", 1000),
    ("average_priority_score", "final_priority_score", 1),
    ("avg_first_response_minutes", "CAST(round(first_response_minutes * 100) AS BIGINT)", 100),
    ("avg_resolution_hours", "CAST(round(resolution_hours * 100) AS BIGINT)", 100),
    ("avg_rule_decision_hours", "CAST(round(rule_decision_hours * 100) AS BIGINT)", 100),
    ("avg_response_generation_hours", "CAST(round(response_generation_hours * 100) AS BIGINT)", 100),
]
BASE = ", ".join(f"{e} AS {n}" for n, e in COUNTS.items()) + ", " + ", ".join(
    f"CAST(sum({e}) AS DOUBLE) / {float(u)} / nullif(count({e}), 0) AS {n}" for n, e, u in MEANS
)


def measured(grouped: str, extra: str = "", zero: tuple[str, ...] = (), keys: str = "") -> str:
    shares = ", ".join(
        (f"coalesce({frac(a, b)}, 0)" if n in zero else frac(a, b)) + f" AS {n}" for n, a, b in SHARES
    )
    means = ", ".join(n for n, _, _ in MEANS)
    return (
        f"SELECT {keys}{', '.join(COUNTS)}, total_tickets - classified_tickets AS unclassified_tickets, "
        f"total_tickets - response_processed AS response_not_processed, {shares}, {means}{extra} FROM ({grouped})"
    )


def whole(column: str) -> str:
    return f"format('{{:,}}', {column})"


TEXTS = (
    f", CASE WHEN classified_tickets = 0 THEN 'Not available' ELSE concat(format('{{:.2f}}', {ratio('exact_category_matches * 100', 'classified_tickets', 2)}), "
    f"'% on ', {whole('classified_tickets')}, ' classified sample(s)') END AS exact_category_match_label, "
    f"CASE WHEN classified_tickets < 30 THEN concat('AI sample size is very small: ', {whole('classified_tickets')}, ' of ', {whole('total_tickets')}, "
    "' tickets. Not enough to claim validated accuracy.') END AS ai_coverage_warning, "
    "concat('Human-review routing is a rule-engine outcome: a ticket with no AI classification is always routed to human review. ', "
    f"{whole('total_tickets - classified_tickets')}, ' of ', {whole('total_tickets')}, ' tickets have no AI classification.') AS routing_context_note"
)
SQL["measures_small_slices"] = (
    "SELECT created_date, channel, customer_segment, total_tickets, classified_tickets, exact_category_match_label, ai_coverage_warning FROM ("
    + measured(
        f"SELECT CAST(created_at AS DATE) AS created_date, channel, customer_segment, {BASE} FROM fact GROUP BY ALL", TEXTS,
        keys="created_date, channel, customer_segment, ",
    )
    + ")"
)
SQL["measures_overall"] = measured(f"SELECT {BASE} FROM fact", TEXTS)
SQL["measures_by_channel"] = measured(f"SELECT channel, {BASE} FROM fact GROUP BY channel", TEXTS, keys="channel, ")
PATH_PINNED = ["tickets_with_rule_decision", "automated_decisions", "human_review_decisions"]
BOTH_PINNED = ["high_urgent_human_review_tickets", "urgent_only_human_review_count"]
FREE = [n for n in COUNTS if n not in PATH_PINNED + BOTH_PINNED]
PINNED = (
    "SELECT s.channel, s.decision_path, s.final_priority, " + ", ".join(f"s.{n}" for n in FREE) + ", "
    + ", ".join(f"a.{n}" for n in PATH_PINNED) + ", " + ", ".join(f"b.{n}" for n in BOTH_PINNED) + ", "
    + ", ".join(f"s.{n}" for n, _, _ in MEANS)
    + f" FROM (SELECT channel, decision_path, final_priority, {BASE} FROM fact GROUP BY ALL) s "
    + "JOIN (SELECT channel, final_priority, " + ", ".join(f"{COUNTS[n]} AS {n}" for n in PATH_PINNED)
    + " FROM fact GROUP BY ALL) a ON a.channel = s.channel AND a.final_priority IS NOT DISTINCT FROM s.final_priority "
    + "JOIN (SELECT channel, " + ", ".join(f"{COUNTS[n]} AS {n}" for n in BOTH_PINNED) + " FROM fact GROUP BY ALL) b ON b.channel = s.channel"
)
ZERO = ("classification_coverage", "human_review_rate", "automated_rate", "high_urgent_human_review_rate")
SQL["measures_path_override"] = measured(PINNED, zero=ZERO, keys="channel, decision_path, final_priority, ")
SQL["measures_grouping_sets"] = measured(
    f"SELECT created_date, channel, CAST(grouping_id(created_date, channel) AS BIGINT) AS grouping_id, {BASE} "
    "FROM (SELECT *, CAST(created_at AS DATE) AS created_date FROM fact) "
    "GROUP BY GROUPING SETS ((created_date, channel), (created_date), (channel), ())",
    keys="created_date, channel, grouping_id, ",
)
SQL["measures_sliced"] = measured(
    f"SELECT channel, {BASE} FROM fact WHERE CAST(created_at AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-20' "
    "AND channel IN ('Email', 'Chat', 'Phone') GROUP BY channel",
    keys="channel, ",
)
H_FIRST, H_RES = "CAST(round(first_response_minutes * 100) AS BIGINT)", "CAST(round(resolution_hours * 100) AS BIGINT)"


def median_slices(source: str, by: str) -> str:
    keys = [k.strip() for k in by.split(",")]
    on = lambda a: " AND ".join(f"s.{k} IS NOT DISTINCT FROM {a}.{k}" for k in keys)
    return (
        f"SELECT {', '.join('s.' + k for k in keys)}, total_tickets, f.twice / 200.0 AS median_first_response_minutes, "
        f"r.twice / 200.0 AS median_resolution_hours FROM (SELECT {by}, count(*) AS total_tickets FROM {source} GROUP BY {by}) s "
        f"LEFT JOIN ({middle(H_FIRST, source, by)}) f ON {on('f')} LEFT JOIN ({middle(H_RES, source, by)}) r ON {on('r')}"
    )


SQL["medians_by_channel"] = median_slices("early_fact", "channel")
SQL["medians_by_customer_segment_and_country"] = median_slices("early_fact", "customer_segment, country")
SQL["medians_from_sketches"] = (
    "SELECT channel, count(*) AS total_tickets, true AS median_first_response_minutes_within, true AS median_resolution_hours_within "
    "FROM early_fact WHERE CAST(created_at AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-18' GROUP BY channel"
)
MIDDLES = "total_tickets, median_first_response_minutes, median_resolution_hours FROM"
DATED = "(SELECT *, CAST(created_at AS DATE) AS created_date FROM early_fact)"
SQL["medians_grouping_sets"] = (
    f"SELECT created_date, channel, CAST(0 AS BIGINT) AS grouping_id, {MIDDLES} ({median_slices(DATED, 'created_date, channel')}) "
    f"UNION ALL SELECT CAST(NULL AS DATE), channel, CAST(2 AS BIGINT), {MIDDLES} ({median_slices('early_fact', 'channel')}) "
    "UNION ALL SELECT CAST(NULL AS DATE), CAST(NULL AS VARCHAR), CAST(3 AS BIGINT), (SELECT count(*) FROM early_fact), "
    f"({middle(H_FIRST, 'early_fact')}) / 200.0, ({middle(H_RES, 'early_fact')}) / 200.0"
)
for _name, _column, _blank in (
    ("chart_decision_path", "decision_path", True), ("chart_original_priority", "original_priority", True),
    ("chart_predicted_category", CAT, False), ("chart_final_priority", "final_priority", True),
    ("chart_response_status", "response_status", False), ("chart_resolution_type", "resolution_type", True),
):
    SQL[_name] = f"SELECT {_column}, count(*) AS tickets FROM fact " + ("" if _blank else f"WHERE {_column} IS NOT NULL ") + "GROUP BY 1"
DAYS = (
    "SELECT CAST(unnest(generate_series((SELECT CAST(min(created_at) AS DATE) FROM fx_tickets), "
    "(SELECT CAST(max(created_at) AS DATE) FROM fx_tickets), INTERVAL 1 DAY)) AS DATE) AS date"
)
SQL["date_dimension"] = (
    "SELECT date, year(date) AS year, quarter(date) AS quarter, month(date) AS month, strftime(date, '%b') AS month_name, "
    f"day(date) AS day, dayofweek(date) AS day_of_week, strftime(date, '%a') AS day_name, dayofweek(date) IN (0, 6) AS is_weekend FROM ({DAYS})"
)
SQL["date_range"] = (
    "SELECT CAST(min(created_at) AS DATE) AS first_date, CAST(max(created_at) AS DATE) AS last_date FROM fx_tickets"
)
SQL["daily_volume"] = (
    "SELECT date, year(date) AS year, quarter(date) AS quarter, month(date) AS month, strftime(date, '%b') AS month_name, "
    "day(date) AS day, dayofweek(date) AS day_of_week, strftime(date, '%a') AS day_name, dayofweek(date) IN (0, 6) AS is_weekend, "
    f"(SELECT count(*) FROM fx_tickets WHERE CAST(created_at AS DATE) = date) AS tickets FROM ({DAYS})"
)

# --- quality ---
KEYS = {
    "customers": "customer_id", "products": "product_id", "orders": "order_id", "order_items": "order_item_id", "tickets": "ticket_id",
}
SQL["dq_row_counts"] = " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS row_count FROM fx_{t}" for t in KEYS)


def finding(name: str, key: str, detail: str, source: str) -> str:
    return f"SELECT {lit(name)} AS check_name, CAST({key} AS VARCHAR) AS key, CAST({detail} AS VARCHAR) AS detail FROM {source}"


def union(*parts: str) -> str:
    return " UNION ALL ".join(parts)


def repeats(name: str, table: str, *keys: str) -> str:
    key = " || '|' || ".join(f"coalesce(CAST({k} AS VARCHAR), 'NULL')" for k in keys)
    return f"SELECT {lit(name)} AS check_name, {key} AS key, CAST(count(*) AS VARCHAR) AS detail FROM {table} GROUP BY {', '.join(keys)} HAVING count(*) > 1"


DQ_PK = union(*[repeats(f"{t}_pk_dupes", f"broken_{t}", k) for t, k in KEYS.items()])
SQL["dq_pk"] = DQ_PK
DQ_FK = union(*[
    f"SELECT '{name}' AS check_name, CAST(x.{KEYS[child]} AS VARCHAR) AS key, CAST(x.{key} AS VARCHAR) AS detail "
    f"FROM broken_{child} x WHERE NOT EXISTS (SELECT 1 FROM broken_{parent} y WHERE y.{key} = x.{key})"
    + (" AND x.order_id IS NOT NULL" if name == "orphan_tickets_order" else "")
    for name, child, parent, key in (
        ("orphan_orders_customer", "orders", "customers", "customer_id"),
        ("orphan_order_items_order", "order_items", "orders", "order_id"),
        ("orphan_order_items_product", "order_items", "products", "product_id"),
        ("orphan_tickets_customer", "tickets", "customers", "customer_id"),
        ("orphan_tickets_order", "tickets", "orders", "order_id"),
    )
])
SQL["dq_fk_orphans"] = DQ_FK
REQUIRED = {
    "customers": ["first_name", "last_name", "email", "signup_date", "customer_segment", "country"],
    "orders": ["customer_id", "order_date", "order_status", "total_amount", "payment_method", "expected_delivery_date"],
    "tickets": ["customer_id", "channel", "message_text", "category", "priority", "status", "created_at"],
}
DQ_NULLS = union(*[
    f"SELECT 'null_required_{t}' AS check_name, '{t}' AS key, CAST(count(*) AS VARCHAR) AS detail FROM broken_{t} WHERE "
    + " OR ".join(f"{c} IS NULL" for c in columns) + " HAVING count(*) > 0"
    for t, columns in REQUIRED.items()
])
SQL["dq_required_nulls"] = DQ_NULLS
DQ_DUPES = union(
    repeats("duplicate_customer_emails", "broken_customers", "email"),
    repeats("duplicate_product_skus", "broken_products", "sku"),
    repeats("duplicate_order_item_product_within_order", "broken_order_items", "order_id", "product_id"),
)
SQL["dq_duplicates"] = DQ_DUPES


def totals(prefix: str) -> str:
    return (
        "SELECT 'order_total_mismatch' AS check_name, CAST(o.order_id AS VARCHAR) AS key, CAST(o.total_amount AS VARCHAR) || ' <> ' "
        f"|| CAST(CAST(s.t AS DECIMAL(18,2)) AS VARCHAR) AS detail FROM {prefix}orders o JOIN (SELECT order_id, sum(line_total) AS t FROM {prefix}order_items "
        "GROUP BY order_id) s ON o.order_id = s.order_id WHERE o.total_amount <> s.t"
    )


def no_items(prefix: str) -> str:
    return (
        f"SELECT 'orders_with_no_items' AS check_name, CAST(order_id AS VARCHAR) AS key, CAST(NULL AS VARCHAR) AS detail FROM {prefix}orders o "
        f"WHERE NOT EXISTS (SELECT 1 FROM {prefix}order_items i WHERE i.order_id = o.order_id)"
    )


def line_totals(prefix: str, name: str = "line_total_mismatch") -> str:
    return finding(name, "order_item_id", "line_total", f"{prefix}order_items WHERE line_total <> round(quantity * unit_price, 2)")


def owners(prefix: str) -> str:
    return (
        "SELECT 'ticket_order_customer_mismatch' AS check_name, CAST(t.ticket_id AS VARCHAR) AS key, "
        "CAST(t.customer_id AS VARCHAR) || ' <> ' || CAST(o.customer_id AS VARCHAR) AS detail "
        f"FROM {prefix}tickets t JOIN {prefix}orders o ON t.order_id = o.order_id WHERE t.customer_id <> o.customer_id"
    )


SQL["dq_order_totals"] = totals("fx_")
SQL["dq_order_totals_mostly_sound"] = totals("fx_").replace("fx_orders", "adding_up")
SQL["dq_orders_without_items"] = no_items("fx_")
SQL["dq_line_totals"] = line_totals("fx_")
SQL["dq_owner_mismatch"] = owners("broken_")


def ts(column: str) -> str:
    """Timestamp text as Spark prints it: no trailing zeros in the fraction."""
    return f"regexp_replace(CAST({column} AS VARCHAR), '(\\.\\d*?)0+$', '\\1')"


def late(name: str, later: str, earlier: str, table: str = "broken_tickets", key: str = "ticket_id") -> str:
    shown = later if later.endswith("_date") else ts(later)
    return finding(name, key, shown, f"{table} WHERE {later} < {earlier}")


DQ_TIME = union(
    late("resolved_before_created", "resolved_at", "created_at"),
    late("decision_before_created", "decision_at", "created_at"),
    late("first_response_before_created", "first_response_at", "created_at"),
    late("resolved_before_first_response", "resolved_at", "first_response_at"),
    late("delivery_before_order_date", "actual_delivery_date", "CAST(order_date AS DATE)", "broken_orders", "order_id"),
)
SQL["dq_timestamps"] = DQ_TIME


def foreign(name: str, table: str, key: str, column: str, allowed) -> str:
    return finding(name, key, column, f"{table} WHERE {column} NOT IN {one_of(allowed)}")


DQ_VOCAB = union(
    foreign("invalid_customer_segment", "broken_customers", "customer_id", "customer_segment", V.SEGMENTS),
    foreign("invalid_product_category", "broken_products", "product_id", "category", V.PRODUCT_CATEGORIES),
    foreign("invalid_order_status", "broken_orders", "order_id", "order_status", V.ORDER_STATUSES),
    foreign("invalid_ticket_category", "broken_tickets", "ticket_id", "category", V.CATEGORIES),
    foreign("invalid_ticket_priority", "broken_tickets", "ticket_id", "priority", V.PRIORITIES),
    foreign("invalid_ticket_status", "broken_tickets", "ticket_id", "status", V.TICKET_STATUSES),
)
SQL["dq_vocabulary"] = DQ_VOCAB
SQL["dq_tickets_without_order"] = f"SELECT {count_if('order_id IS NULL')} AS ticket_count FROM fx_tickets"
SQL["dq_routing"] = union(
    foreign("invalid_final_priority", "broken_stored", "ticket_id", "final_priority", V.PRIORITIES),
    foreign("invalid_decision_path", "broken_stored", "ticket_id", "decision_path", V.DECISION_PATHS),
    late("rule_decision_before_created", "rule_decision_at", "created_at", "broken_stored"),
    finding("partial_phase4_write", "ticket_id", "coalesce(decision_path, final_priority)",
            "broken_stored WHERE (decision_path IS NOT NULL) <> (final_priority IS NOT NULL)"),
)
SQL["dq_response"] = union(
    foreign("invalid_response_status", "broken_stored", "ticket_id", "response_status", V.RESPONSE_STATUSES),
    foreign("invalid_response_type", "broken_stored", "ticket_id", "response_type", V.RESPONSE_TYPES),
    late("response_generated_before_created", "response_generated_at", "created_at", "broken_stored"),
    finding("draft_generated_missing_text", "ticket_id", "NULL",
            "broken_stored WHERE response_status = 'DRAFT_GENERATED' AND response_draft IS NULL"),
    finding("blocked_or_not_eligible_has_draft", "ticket_id", "response_status",
            "broken_stored WHERE response_status IN ('BLOCKED', 'NOT_ELIGIBLE') AND response_draft IS NOT NULL"),
    finding("response_without_phase4_decision", "ticket_id", "response_status",
            "broken_stored WHERE response_status IS NOT NULL AND decision_path IS NULL"),
    finding("human_review_draft_without_phase4_human_review", "ticket_id", "decision_path",
            "broken_stored WHERE response_status = 'HUMAN_REVIEW_DRAFT' AND decision_path <> 'Human Review'"),
    finding("draft_generated_without_phase4_automated", "ticket_id", "decision_path",
            "broken_stored WHERE response_status = 'DRAFT_GENERATED' AND decision_path <> 'Automated'"),
)
SQL["dq_stored_distributions"] = union(*[
    f"SELECT '{c}' AS dimension, coalesce({c}, {lit(label)}) AS value, count(*) AS n FROM stored GROUP BY 2"
    for c, label in (
        ("decision_path", V.NOT_DECIDED), ("final_priority", V.NOT_DECIDED), ("response_status", V.NOT_PROCESSED),
        ("response_type", V.UNKNOWN_TYPE), ("category", "(none)"),
    )
])
SQL["dq_view_grain"] = (
    "WITH seen AS (SELECT t.* FROM broken_tickets t JOIN fx_customers c ON t.customer_id = c.customer_id) "
    + repeats("ticket_grain_duplicates", "seen", "ticket_id")
    + " UNION ALL SELECT 'ticket_grain_row_count_mismatch', 'vw_ticket_analytics', CAST(a AS VARCHAR) || ' <> ' || CAST(b AS VARCHAR) "
    "FROM (SELECT (SELECT count(*) FROM seen) AS a, (SELECT count(*) FROM broken_tickets) AS b) WHERE a <> b"
)
SQL["dq_fact_grain"] = SQL["dq_view_grain"]
SQL["distinct_customers_from_bitmaps"] = (
    "SELECT channel, count(*) AS tickets, count(DISTINCT customer_id) AS customers FROM fx_tickets "
    "WHERE CAST(created_at AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-18' GROUP BY channel"
)
TWO = "printf('%.2f', {0})"
FACT_ROWS = union(
    *[
        finding(f"negative_{d}", "ticket_id", TWO.format(d), f"bf WHERE {d} < 0")
        for d in ("first_response_minutes", "resolution_hours", "rule_decision_hours", "response_generation_hours")
    ],
    foreign("invalid_decision_path_in_view", "bf", "ticket_id", "decision_path", V.DECISION_PATHS),
    foreign("invalid_response_status_in_view", "bf", "ticket_id", "response_status", V.RESPONSE_STATUSES),
)
SQL["dq_fact_rows"] = f"WITH bf AS ({fact_sql('broken_stored')}) {FACT_ROWS}"
PCTS = {
    "classification": ["classification_coverage_pct", "low_confidence_rate_pct", "exact_category_match_rate_pct"],
    "rule": ["automated_rate_pct", "human_review_rate_pct", "urgent_human_review_rate_pct"],
    "response": ["response_processed_rate_pct", "draft_generation_rate_pct", "blocked_rate_pct"],
}
METRIC_CONDITIONS = [
    ("classification_counts_do_not_partition", "c", "classified_tickets + unclassified_tickets <> total_tickets"),
    ("rule_decisions_do_not_partition", "r", "automated_decisions + human_review_decisions <> tickets_with_rule_decision"),
    ("response_statuses_do_not_partition", "p",
     "drafts_generated + human_review_drafts + blocked_responses + not_eligible_responses <> response_processed"),
    ("response_processed_partition_broken", "p", "response_processed + response_not_processed <> total_tickets"),
    ("urgent_exceeds_human_review", "r", "urgent_human_review > human_review_decisions"),
    ("matches_exceed_classified", "c", "exact_category_matches > classified_tickets"),
    *[
        (f"{name}_pct_out_of_range", t, " OR ".join(f"{p} NOT BETWEEN 0 AND 100" for p in PCTS[name]))
        for name, t in (("classification", "c"), ("rule", "r"), ("response", "p"))
    ],
]
METRIC_ROWS = union(*[finding(name, "'metrics'", "NULL", f"{t} WHERE {bad}") for name, t, bad in METRIC_CONDITIONS])
SQL["dq_metric_consistency"] = f"WITH {BLOCKS('broken_stored')} {METRIC_ROWS}"


def selfcheck_parts() -> tuple[str, list[tuple[str, str, str]]]:
    """The summary of the fact rows, and all checks of the metrics against it."""
    near = lambda a, b, tol: f"NOT coalesce(abs({a} - {b}) <= {tol} + 1e-9, {a} IS NULL AND {b} IS NULL)"
    summary = (
        f"s AS (SELECT count(*) AS n, count(DISTINCT ticket_id) AS d, count(first_response_minutes) AS nf, count(resolution_hours) AS nr, "
        f"({middle(H_FIRST, 'f')}) / 200.0 AS mf, ({middle(H_RES, 'f')}) / 200.0 AS mr FROM f)"
    )
    rate = lambda name, t, stated, a, b: (name, near(f"{t}.{stated}", pct(a, b), 0.01), lit(f"{name} disagrees with its counts"))
    total = "(p.drafts_generated + p.human_review_drafts + p.blocked_responses + p.not_eligible_responses)"
    checks = [
        ("ticket_grain", "s.n <> s.d", "concat(s.n, ' fact rows, ', s.d, ' distinct tickets')"),
        ("ticket_grain_vs_total", "s.n <> c.total_tickets", "concat(s.n, ' fact rows, total_tickets ', c.total_tickets)"),
        ("classification_counts", "c.classified_tickets + c.unclassified_tickets <> c.total_tickets", lit("classified + unclassified <> total_tickets")),
        rate("classification_coverage_pct", "c", "classification_coverage_pct", "c.classified_tickets", "c.total_tickets"),
        rate("low_confidence_rate_pct", "c", "low_confidence_rate_pct", "c.low_confidence_tickets", "c.confidence_available"),
        rate("exact_category_match_rate_pct", "c", "exact_category_match_rate_pct", "c.exact_category_matches", "c.classified_tickets"),
        ("exact_category_matches", "c.exact_category_matches > c.classified_tickets", lit("more matches than classified tickets")),
        ("rule_decision_counts", "r.automated_decisions + r.human_review_decisions <> r.tickets_with_rule_decision",
         lit("automated + human review <> decided")),
        rate("automated_rate_pct", "r", "automated_rate_pct", "r.automated_decisions", "r.tickets_with_rule_decision"),
        rate("human_review_rate_pct", "r", "human_review_rate_pct", "r.human_review_decisions", "r.tickets_with_rule_decision"),
        rate("urgent_human_review_rate_pct", "r", "urgent_human_review_rate_pct", "r.urgent_human_review", "r.tickets_with_rule_decision"),
        ("urgent_human_review", "r.urgent_human_review > r.human_review_decisions", lit("more urgent reviews than reviews")),
        ("decision_rates_sum", "abs(r.automated_rate_pct + r.human_review_rate_pct - 100) > 0.05 + 1e-9",
         lit("automated_rate_pct + human_review_rate_pct <> 100")),
        ("response_status_counts", f"{total} <> p.response_processed",
         f"concat('statuses sum to ', {total}, ', processed is ', p.response_processed)"),
        ("response_processed_partition", "p.response_processed + p.response_not_processed <> p.total_tickets",
         lit("processed + not processed <> total_tickets")),
        rate("response_processed_rate_pct", "p", "response_processed_rate_pct", "p.response_processed", "p.total_tickets"),
        *[rate(share, "p", share, f"p.{n}", "p.response_processed") for n, share in STATUS.values()],
        ("median_first_response_minutes", near("o.median_first_response_minutes", "s.mf", 0.02),
         lit("median_first_response_minutes disagrees with the fact rows")),
        ("median_resolution_hours", near("o.median_resolution_hours", "s.mr", 0.02), lit("median_resolution_hours disagrees with the fact rows")),
        ("first_response_count", "o.tickets_with_first_response <> s.nf", lit("tickets_with_first_response disagrees with the fact rows")),
        ("resolved_count", "o.resolved_tickets <> s.nr", lit("resolved_tickets disagrees with the fact rows")),
    ]
    return summary, checks


def selfcheck(tickets: str, fact: str) -> str:
    """All checks of the metrics against the fact rows."""
    summary, checks = selfcheck_parts()
    return f"WITH f AS ({fact}), {BLOCKS(tickets)}, {summary} " + union(*[
        f"SELECT 'ERROR' AS severity, {lit(name)} AS \"check\", {detail} AS detail FROM c, r, p, o, s WHERE {bad}" for name, bad, detail in checks
    ])


def planted_errors(tickets: str, fact: str) -> str:
    """Every check over the sound metrics and over metrics moved by each planted error."""
    summary, checks = selfcheck_parts()
    shares = [f"{block}.{c}" for block, rows in SHARES.items() for c in rows]
    short = {"classification": "c", "rule_decisions": "r", "responses": "p"}
    checks = [(name, bad) for name, bad, _ in checks]
    checks += [(share, "{0} < 0 OR {0} > 100".format(f"{short[share.split('.')[0]]}.{share.split('.')[1]}")) for share in shares]
    checks += [
        (f"operational.{c}", f"o.{c} < 0")
        for c in ("avg_first_response_minutes", "median_first_response_minutes", "avg_resolution_hours", "median_resolution_hours")
    ]
    errors = all_errors(shares)
    moved = []
    for block in "crpos":
        by_field: dict[str, dict[str, float]] = {}
        for name, paths in errors.items():
            for path, delta in paths.items():
                if path[0] == block:
                    by_field.setdefault(path[2:], {})[name] = delta
        changed = ", ".join(
            f"{field} + CASE planted " + " ".join(f"WHEN {lit(n)} THEN {d:.1f}" for n, d in own.items()) + f" ELSE 0 END AS {field}"
            for field, own in by_field.items()
        )
        moved.append(f"m{block} AS (SELECT planted, {block}.* REPLACE ({changed}) FROM {block}, planted)")
    names = ", ".join(lit(n) for n in ["none", *errors])
    together = "mc c JOIN mr r USING (planted) JOIN mp p USING (planted) JOIN mo o USING (planted) JOIN ms s USING (planted)"
    fired = ", ".join(f"CASE WHEN {bad} THEN {lit(name)} END" for name, bad in checks)
    return (
        f"WITH f AS ({fact}), {BLOCKS(tickets)}, {summary}, planted AS (SELECT unnest([{names}]) AS planted), {', '.join(moved)} "
        f"SELECT planted, fired FROM (SELECT planted, unnest([{fired}]) AS fired FROM {together}) WHERE fired IS NOT NULL UNION ALL "
        + union(*[f"SELECT planted, {lit(name)} FROM m{t} WHERE {bad}" for name, t, bad in METRIC_CONDITIONS])
    )


SHARES = {
    "classification": ["classification_coverage_pct", "low_confidence_rate_pct", "exact_category_match_rate_pct"],
    "rule_decisions": ["automated_rate_pct", "human_review_rate_pct", "urgent_human_review_rate_pct"],
    "responses": ["response_processed_rate_pct", *[share for _, share in STATUS.values()]],
}
SQL["dq_analytics"] = (
    f"WITH bf AS ({fact_sql('broken_stored')}), {BLOCKS('broken_stored')} {FACT_ROWS} UNION ALL {METRIC_ROWS} UNION ALL "
    + repeats("ticket_grain_duplicates", "bf", "ticket_id")
    + " UNION ALL SELECT 'ticket_grain_row_count_mismatch', 'vw_ticket_analytics', CAST(a AS VARCHAR) || ' <> ' || CAST(b AS VARCHAR) "
    "FROM (SELECT (SELECT count(*) FROM bf) AS a, (SELECT count(*) FROM broken_stored) AS b) WHERE a <> b"
)
SQL["dq_checks_fire"] = planted_errors("stored", "SELECT * FROM fact")
SQL["dq_metric_selfcheck"] = selfcheck("stored", "SELECT * FROM fact")
SQL["dq_metric_selfcheck_broken"] = selfcheck("broken_stored", "SELECT * FROM early_fact WHERE channel <> 'Phone'")


def nulls(table: str, columns: list[str], source: str, key: str) -> list[str]:
    return [finding(f"{table}.{c}_not_null", key, "NULL", f"{source} WHERE {c} IS NULL") for c in columns]


def lengths(table: str, sizes: dict[str, int], source: str, key: str) -> list[str]:
    return [finding(f"{table}.{c}_length", key, f"length({c})", f"{source} WHERE length({c}) > {n}") for c, n in sizes.items()]


def declared(table: str, source: str, later: bool = False) -> str:
    from ticketloom import schemas

    key = KEYS[table]
    bad = lambda name, condition, column: finding(f"{table}.{name}", key, column, f"{source} WHERE {condition}")
    member = lambda name, column, allowed: foreign(f"{table}.{name}", source, key, column, allowed)
    sizes = {c: n for c, n in schemas.TEXT_LENGTHS[table].items() if later or c not in ("final_priority", "response_status", "response_type")}
    parts = nulls(table, schemas.required(table), source, key) + lengths(table, sizes, source, key)
    parts += {
        "customers": [member("segment", "customer_segment", V.SEGMENTS)],
        "products": [
            member("category", "category", V.PRODUCT_CATEGORIES), bad("price_nonneg", "price < 0", "price"),
            bad("stock_nonneg", "stock_quantity < 0", "stock_quantity"),
        ],
        "orders": [
            member("status", "order_status", V.ORDER_STATUSES), member("payment_method", "payment_method", V.PAYMENT_METHODS),
            bad("total_nonneg", "total_amount < 0", "total_amount"),
            late("orders.delivery_dates", "actual_delivery_date", "CAST(order_date AS DATE)", source, key),
        ],
        "order_items": [
            bad("qty_pos", "quantity <= 0", "quantity"), bad("price_nonneg", "unit_price < 0", "unit_price"),
            bad("line_total", "line_total <> round(quantity * unit_price, 2)", "line_total"),
        ],
        "tickets": [
            member("channel", "channel", V.CHANNELS), member("category", "category", V.CATEGORIES), member(CAT, CAT, V.CATEGORIES),
            member("priority", "priority", V.PRIORITIES), member("status", "status", V.TICKET_STATUSES),
            member("decision_path", "decision_path", V.DECISION_PATHS), member("resolution_type", "resolution_type", V.RESOLUTION_TYPES),
            bad("confidence_range", f"{CONF} NOT BETWEEN 0 AND 1", CONF), bad("sentiment_range", f"{SENT} NOT BETWEEN -1 AND 1", SENT),
            late("tickets.ts_decision", "decision_at", "created_at", source),
            late("tickets.ts_first_response", "first_response_at", "created_at", source),
            late("tickets.ts_resolved", "resolved_at", "created_at", source),
        ],
    }[table]
    if later:
        draft = (
            "(response_status = 'DRAFT_GENERATED' AND response_draft IS NOT NULL) OR response_status = 'HUMAN_REVIEW_DRAFT' OR "
            "(response_status IN ('BLOCKED', 'NOT_ELIGIBLE') AND response_draft IS NULL) OR (response_status IS NULL AND response_draft IS NULL)"
        )
        parts += [
            member("final_priority", "final_priority", V.PRIORITIES), late("tickets.rule_decision_ts", "rule_decision_at", "created_at", source),
            member("response_status", "response_status", V.RESPONSE_STATUSES), member("response_type", "response_type", V.RESPONSE_TYPES),
            late("tickets.response_generated_ts", "response_generated_at", "created_at", source),
            bad("response_draft_status_consistency", f"NOT ({draft})", "response_status"),
        ]
    return union(*parts)


SQL["dq_constraints"] = union(*[declared(t, f"broken_{t}") for t in KEYS])
SQL["load_counts"] = union(
    *[f"SELECT '{t}' AS table_name, 'rows' AS counted, count(*) AS n FROM broken_{t}" for t in KEYS],
    f"SELECT split_part(check_name, '.', 1), check_name, count(*) FROM ({SQL['dq_constraints']}) GROUP BY ALL",
)
SQL["dq_stored_constraints"] = declared("tickets", "broken_stored", later=True)
SQL["dq_key_constraints"] = union(
    *[repeats(f"{t}.pk", f"broken_{t} WHERE {k} IS NOT NULL", k) for t, k in KEYS.items()],
    repeats("customers.email_unique", "broken_customers WHERE email IS NOT NULL", "email"),
    repeats("products.sku_unique", "broken_products WHERE sku IS NOT NULL", "sku"),
    *[
        f"SELECT '{child}.{key}_fk', CAST(x.{KEYS[child]} AS VARCHAR), CAST(x.{key} AS VARCHAR) FROM broken_{child} x "
        f"WHERE x.{key} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM broken_{parent} y WHERE y.{key} = x.{key})"
        for child, parent, key in (
            ("orders", "customers", "customer_id"), ("order_items", "orders", "order_id"), ("order_items", "products", "product_id"),
            ("tickets", "customers", "customer_id"), ("tickets", "orders", "order_id"),
        )
    ],
    f"SELECT 'tickets.order_owner', key, detail FROM ({owners('broken_')})",
)
SQL["dq_suite_rows"] = union(
    DQ_PK, DQ_FK, DQ_NULLS, DQ_DUPES, totals("broken_"), no_items("broken_"), line_totals("broken_"), owners("broken_"), DQ_TIME, DQ_VOCAB
)
SQL["dq_suite"] = "SELECT check_name, count(*) AS violations FROM (" + SQL["dq_suite_rows"] + ") GROUP BY 1"
SQL["orders_per_customer"] = (
    "SELECT order_count, count(*) AS num_customers FROM (SELECT c.customer_id, count(o.order_id) AS order_count FROM fx_customers c "
    "LEFT JOIN fx_orders o ON c.customer_id = o.customer_id GROUP BY c.customer_id) GROUP BY 1"
)
SQL["top_products"] = (
    "SELECT product_name, CAST(sum(quantity) AS BIGINT) AS units_sold FROM fx_order_items JOIN fx_products USING (product_id) "
    "GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5"
)
SQL["category_ranking"] = (
    "WITH d AS (SELECT coalesce(category, '(none)') AS category, count(*) AS n FROM fx_tickets GROUP BY 1) "
    "SELECT 'count' AS ordered_by, category, n, row_number() OVER (ORDER BY n DESC, category) AS place FROM d "
    "UNION ALL SELECT 'label', category, n, row_number() OVER (ORDER BY category) FROM d"
)
SQL["category_distribution"] = "SELECT coalesce(category, '(none)') AS category, count(*) AS n FROM fx_tickets GROUP BY 1"

# --- write-back, gate, audit, stream ---
RUN_AT = "TIMESTAMP '2024-06-01 12:00:00'"
SQL["overlay_predictions"] = (
    CLASSIFIED + f"SELECT t.ticket_id, t.category, CASE WHEN k.ok THEN k.cat_ ELSE t.{CAT} END AS {CAT}, "
    f"CASE WHEN k.ok THEN CAST(k.conf AS DOUBLE) ELSE CAST(t.{CONF} AS DOUBLE) END AS {CONF}, "
    f"CASE WHEN k.ok THEN CAST(k.sent AS DOUBLE) ELSE CAST(t.{SENT} AS DOUBLE) END AS {SENT}, "
    f"CASE WHEN k.ok THEN {RUN_AT} ELSE t.decision_at END AS decision_at, CASE WHEN k.ok THEN {RUN_AT} ELSE t.updated_at END AS updated_at "
    "FROM fx_tickets t JOIN checked k ON t.ticket_id = k.ticket_id"
)
SQL["overlay_decisions"] = (
    f"SELECT t.ticket_id, t.priority, r.final_priority, r.decision_path, CASE WHEN r.ticket_id IS NOT NULL THEN {RUN_AT} END AS rule_decision_at, "
    f"CASE WHEN r.ticket_id IS NOT NULL THEN {RUN_AT} ELSE t.updated_at END AS updated_at FROM fx_tickets t LEFT JOIN broken_routed r ON t.ticket_id = r.ticket_id"
)
SQL["responses_run_updates"] = (
    f"SELECT ticket_id, d_status AS response_status, r_type AS response_type, d_draft AS response_draft, {RUN_AT} AS response_generated_at "
    f"FROM ({responded('decided', generator=False)})"
)
CALLED = (
    "SELECT ticket_id, n, CASE n % 3 WHEN 0 THEN 'Complaint' WHEN 1 THEN 'Other' ELSE 'Spam' END AS cat_ "
    f"FROM (SELECT ticket_id, length(prompt) AS n FROM ({SQL['ticket_prompts']}))"
)
SQL["classify_run"] = (
    f"WITH called AS ({CALLED}) SELECT ticket_id, cat_ AS result, (n % 5 - 2) / 4.0 AS number FROM called WHERE n % 7 <> 0 AND cat_ <> 'Spam' "
    "UNION ALL SELECT NULL, 'timeout', CAST(count(*) AS DOUBLE) FROM called WHERE n % 7 = 0 HAVING count(*) > 0 "
    "UNION ALL SELECT NULL, 'invalid_category', CAST(count(*) AS DOUBLE) FROM called WHERE n % 7 <> 0 AND cat_ = 'Spam' HAVING count(*) > 0"
)
SQL["run_summary_json"] = SQL["rules_batch_summary"]
SQL["view_export"] = (
    "SELECT ticket_id, channel, decision_path, CAST(resolution_hours AS DOUBLE) AS resolution_hours, "
    "CAST(order_total_amount AS DOUBLE) AS order_total_amount, resolved_at, delivery_delay_days, recommended_action FROM fact"
)
SQL["rules_run_updates"] = f"SELECT ticket_id, final_priority, decision_path, {RUN_AT} AS rule_decision_at FROM routed"
SQL["redacted_turns"] = "SELECT conv_id, turn, 'key [REDACTED] ' || text || ' [REDACTED]' AS text FROM conversations"
SQL["overlay_responses"] = (
    "SELECT ticket_id, decision_path, d_status AS response_status, r_type AS response_type, d_draft AS response_draft, "
    f"{RUN_AT} AS response_generated_at, {RUN_AT} AS updated_at FROM responded"
)
GATE = (
    "SELECT t.ticket_id, t.order_id, t.customer_id, t.channel, t.order_id IS NULL OR EXISTS (SELECT 1 FROM fx_orders o "
    "WHERE o.order_id = t.order_id AND o.customer_id = t.customer_id) AS accepted FROM broken_tickets t"
)
SQL["write_gate"] = f"SELECT ticket_id, order_id, customer_id, accepted FROM ({GATE})"
SQL["write_gate_rejects"] = f"SELECT channel, count(*) AS rejected FROM ({GATE}) WHERE NOT accepted GROUP BY 1"
SQL["load_gated"] = (
    "SELECT channel, reason, count(*) AS n FROM (SELECT channel, CASE WHEN accepted THEN 'accepted' WHEN EXISTS (SELECT 1 FROM fx_orders o "
    f"WHERE o.order_id = g.order_id) THEN 'order_of_other_customer' ELSE 'no_such_order' END AS reason FROM ({GATE}) g) GROUP BY ALL"
)
SQL["write_gate_reasons"] = (
    "SELECT t.ticket_id, t.order_id, t.customer_id, CASE WHEN EXISTS (SELECT 1 FROM broken_orders o WHERE o.order_id = t.order_id) "
    "THEN 'order_of_other_customer' ELSE 'no_such_order' END AS reason FROM broken_tickets t WHERE t.order_id IS NOT NULL AND NOT EXISTS "
    "(SELECT 1 FROM broken_orders o WHERE o.order_id = t.order_id AND o.customer_id = t.customer_id)"
)
SQL["write_back_tickets"] = (
    "SELECT g.ticket_id, g.customer_id, g.priority, j.final_priority, j.decision_path, j.rule_decision_at, "
    f"CASE WHEN j.ticket_id IS NULL THEN g.updated_at ELSE {RUN_AT} END AS updated_at "
    "FROM gated g LEFT JOIN judged j ON g.ticket_id = j.ticket_id AND j.reason IS NULL"
)
SQL["write_back_rejects"] = (
    "SELECT ticket_id, reason FROM judged WHERE reason IS NOT NULL "
    "UNION ALL SELECT ticket_id, 'no_ticket_id' FROM updates WHERE ticket_id IS NULL"
)
SQL["audit_routing"] = (
    "SELECT coalesce(ticket_id, -1) AS ticket_id, CASE WHEN is_fallback THEN 'rules_fallback' ELSE 'rules_decision' END AS event, "
    "NOT is_fallback AS success, true AS dry_run, final_priority, decision_path, triggered_rules, conflicting_signals, is_fallback FROM broken_routed"
)
SQL["audit_responses"] = (
    "SELECT ticket_id, 'response_decision' AS event, true AS success, true AS dry_run, false AS is_fallback, d_status AS response_status, "
    "r_type AS response_type, customer_facing, requires_human_review, d_draft IS NOT NULL AS has_draft FROM responded"
)
SQL["audit_classification"] = (
    CLASSIFIED + "SELECT ticket_id, CASE WHEN ok THEN 'classification_success' ELSE 'classification_failure' END AS event, ok AS success, "
    "CASE WHEN ok THEN cat_ END AS predicted_category, CASE WHEN ok THEN pri END AS predicted_priority, error AS error_type, "
    "CASE WHEN ok THEN coalesce(input_tokens, 0) END AS input_tokens, CASE WHEN ok THEN output_tokens END AS output_tokens, true AS dry_run FROM checked"
)
SQL["stream_route"] = f"SELECT {DECISION} FROM routed"
WEEK = "least((day(created_at) - 1) // 8, 3)"
IS_LATE = f"({WEEK} = 0 AND ticket_id % 70 = 1)"
SQL["stream_intake"] = (
    f"WITH sent AS (SELECT ticket_id, created_at, CASE WHEN {IS_LATE} THEN 3 ELSE {WEEK} END AS batch FROM gated UNION ALL "
    f"SELECT ticket_id, created_at, {WEEK} + 1 FROM gated WHERE NOT {IS_LATE} AND {WEEK} < 3 AND ticket_id % 50 = 0), "
    "marks AS (SELECT b.batch, (SELECT max(created_at) - INTERVAL 2 DAY FROM sent s WHERE s.batch < b.batch) AS mark FROM (SELECT DISTINCT batch FROM sent) b), "
    "judged_ AS (SELECT s.*, mark IS NOT NULL AND created_at < mark AS late FROM sent s JOIN marks USING (batch)), "
    "first_ AS (SELECT ticket_id, min(batch) AS batch FROM judged_ WHERE NOT late GROUP BY 1), "
    "known AS (SELECT f.ticket_id, f.batch, r.decision_path, g.order_id IS NULL OR EXISTS (SELECT 1 FROM fx_orders o "
    "WHERE o.order_id = g.order_id AND o.customer_id = g.customer_id) AS passes FROM first_ f JOIN gated g ON f.ticket_id = g.ticket_id "
    "JOIN gated_routed r ON f.ticket_id = r.ticket_id) "
    "SELECT ticket_id, 'late' AS outcome, CAST(NULL AS VARCHAR) AS decision_path FROM judged_ WHERE late "
    "UNION ALL SELECT ticket_id, 'written', decision_path FROM known WHERE passes "
    "UNION ALL SELECT batch, concat_ws(' ', 'batch', count(*), count(*) FILTER (WHERE late), count(*) FILTER (WHERE NOT late) "
    "- (SELECT count(*) FROM first_ f WHERE f.batch = j.batch), (SELECT count(*) FROM known k WHERE k.batch = j.batch)), NULL "
    "FROM judged_ j GROUP BY batch"
)

# --- KPIs ---
SQL["kpi_volume"] = (
    "SELECT CAST(date_trunc('month', created_at) AS DATE) AS period, ground_truth_category, original_priority, channel, count(*) AS tickets "
    "FROM early_fact GROUP BY ALL"
)
HIT = f"{CAT} = ground_truth_category"
SQL["kpi_accuracy"] = (
    f"SELECT count({CAT}) AS labelled, {count_if(HIT)} AS correct, {pct(count_if(HIT), f'count({CAT})')} AS accuracy_pct FROM early_fact"
)
AUTO = count_if("decision_path = 'Automated'")
SQL["kpi_path_rates"] = (
    f"SELECT channel, count(decision_path) AS decided, {pct(AUTO, 'count(decision_path)')} AS automation_rate_pct, "
    f"{pct(count_if("decision_path = 'Human Review'"), 'count(decision_path)')} AS human_review_rate_pct FROM fact GROUP BY 1"
)
DECIDE_US = "epoch_us(decision_at) - epoch_us(created_at)"
SQL["kpi_processing_time"] = (
    f"SELECT count(decision_at) AS n, {ratio(f'sum({DECIDE_US})', f'CAST(count(decision_at) AS HUGEINT) * {HOUR}', 2)} AS avg_processing_hours FROM early_fact"
)
SQL["kpi_resolution_by_type"] = (
    f"SELECT resolution_type, count(*) AS n, {ratio('sum(' + US['resolution'] + ')', f'CAST(count(*) AS HUGEINT) * {HOUR}', 2)} AS avg_resolution_hours "
    "FROM early_fact WHERE resolved_at IS NOT NULL GROUP BY 1"
)
SQL["kpi_sentiment"] = (
    f"SELECT dimension, key, count(*) AS n, {ratio('sum(CAST(' + SENT + ' * 100 AS BIGINT))', 'count(*) * 100', 4)} AS avg_sentiment FROM ("
    + union(*[
        f"SELECT '{d}' AS dimension, {k} AS key, {SENT} FROM early_fact WHERE {SENT} IS NOT NULL"
        for d, k in (("overall", "'all'"), ("category", f"coalesce({CAT}, '(unclassified)')"), ("month", "strftime(created_at, '%Y-%m')"))
    ])
    + ") GROUP BY 1, 2"
)
SQL["kpi_cost_savings"] = f"SELECT {AUTO} AS automated_tickets, {ratio(f'{AUTO} * 425', '100', 2)} AS estimated_savings FROM fact"
AUTO_DONE = "resolved_at IS NOT NULL AND decision_path = 'Automated'"
SQL["kpi_service_quality"] = (
    f"SELECT count(resolved_at) AS resolved, {pct(count_if("resolved_at IS NOT NULL AND status = 'Reopened'"), 'count(resolved_at)')} AS reopened_rate_pct, "
    f"{pct(count_if(US['resolution'] + f' <= 24 * {HOUR}'), 'count(resolved_at)')} AS sla_compliance_pct, "
    f"{pct(count_if(AUTO_DONE + " AND resolution_type IN ('Human', 'Hybrid')"), count_if(AUTO_DONE))} AS false_automation_rate_pct FROM fact"
)


def quantile(num_: int, den: int) -> str:
    low, rest = f"(({num_} * (c - 1)) // {den})", f"(({num_} * (c - 1)) % {den})"
    return (
        f"(max(v) FILTER (WHERE rn = {low}) + (max(v) FILTER (WHERE rn = least({low} + 1, c - 1)) - max(v) FILTER (WHERE rn = {low})) "
        f"* (CAST(max({rest}) AS DOUBLE) / {den}.0)) / 100"
    )


SQL["kpi_order_value_percentiles"] = (
    f"SELECT max(c) AS orders, {quantile(1, 2)} AS p50, {quantile(3, 4)} AS p75, {quantile(9, 10)} AS p90, {quantile(19, 20)} AS p95, "
    "max(v) / 100.0 AS max_value FROM (SELECT v, row_number() OVER (ORDER BY v) - 1 AS rn, count(*) OVER () AS c FROM "
    "(SELECT CAST(total_amount * 100 AS BIGINT) AS v FROM fx_orders))"
)
SQL["kpi_confidence_calibration"] = (
    f"SELECT CAST(least(floor({CONF} * 10), 9) AS BIGINT) AS decile, {CONFIDENCE_BAND} AS side, count(*) AS n, {count_if(HIT)} AS correct, "
    f"{pct(count_if(HIT), 'count(*)')} AS accuracy_pct FROM early_fact WHERE {CAT} IS NOT NULL AND {CONF} IS NOT NULL GROUP BY 1, 2"
)
for _name, _columns in (
    ("kpi_path_by_priority", "decision_path, final_priority"), ("kpi_action_counts", "recommended_action"),
    ("kpi_category_by_path", "ground_truth_category, decision_path"), ("kpi_type_distribution", "response_type"),
    ("kpi_status_by_path", "response_status, decision_path"),
):
    SQL[_name] = f"SELECT {_columns}, count(*) AS tickets FROM fact GROUP BY ALL"
SQL["kpi_urgent_tickets"] = (
    f"SELECT ticket_id, created_at, channel, {CAT}, final_priority, CAST({SENT} AS DOUBLE) AS {SENT} FROM fact WHERE recommended_action = 'HUMAN_REVIEW_URGENT'"
)
SQL["kpi_monthly_medians"] = (
    "WITH mf AS (SELECT *, CAST(date_trunc('month', created_at) AS DATE) AS month FROM early_fact) "
    "SELECT month, total_tickets AS tickets, median_first_response_minutes, median_resolution_hours FROM (" + median_slices("mf", "month") + ")"
)
SQL["kpi_first_response_by_channel"] = (
    f"SELECT channel, count(*) AS n, {ratio(f'sum({H_FIRST})', 'count(*) * 100', 2)} AS avg_first_response_minutes "
    "FROM early_fact WHERE first_response_minutes IS NOT NULL GROUP BY 1"
)
SQL["kpi_resolution_by_category"] = (
    f"SELECT ground_truth_category, count(*) AS n, {ratio(f'sum({H_RES})', 'count(*) * 100', 2)} AS avg_resolution_hours "
    "FROM early_fact WHERE resolution_hours IS NOT NULL GROUP BY 1"
)
SQL["kpi_value_against_resolution"] = (
    f"SELECT CAST(floor(order_total_amount / 50) * 50 AS BIGINT) AS value_band, count(*) AS n, {ratio(f'sum({H_RES})', 'count(*) * 100', 2)} AS avg_resolution_hours "
    "FROM early_fact WHERE order_total_amount IS NOT NULL AND resolution_hours IS NOT NULL GROUP BY 1"
)

STATEMENTS = {name: statement(text) for name, text in SQL.items()}
