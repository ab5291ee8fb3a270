"""Vocabularies, thresholds and contract wording."""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

# --- Fixed values: vocabularies -------------------------------------------------
CATEGORIES = [
    "Refund Request",
    "Missing Item",
    "Damaged Product",
    "Delivery Delay",
    "Order Status Inquiry",
    "Product Question",
    "Payment Problem",
    "Account Problem",
    "Complaint",
    "Other",
]
PRIORITIES = ["Low", "Medium", "High", "Urgent"]
BASE_PRIORITY = {
    "Order Status Inquiry": "Low",
    "Product Question": "Low",
    "Other": "Low",
    "Delivery Delay": "Medium",
    "Refund Request": "Medium",
    "Account Problem": "Medium",
    "Damaged Product": "High",
    "Missing Item": "High",
    "Payment Problem": "High",
    "Complaint": "Urgent",
}
ORDER_DEPENDENT = ["Refund Request", "Missing Item", "Damaged Product", "Delivery Delay"]
SENSITIVE = ["Payment Problem", "Account Problem", "Complaint"]
SEGMENTS = ["New", "Returning", "VIP"]
PRODUCT_CATEGORIES = [
    "Electronics Accessories",
    "Home & Kitchen",
    "Sports & Outdoors",
    "Beauty & Personal Care",
    "Office & Stationery",
    "Toys & Games",
]
ORDER_STATUSES = [
    "Placed",
    "Processing",
    "Shipped",
    "Out for Delivery",
    "Delivered",
    "Delayed",
    "Cancelled",
    "Returned",
    "Refunded",
]
PAYMENT_METHODS = [
    "Credit Card",
    "Debit Card",
    "PayPal",
    "Apple Pay",
    "Google Pay",
    "Gift Card",
    "Bank Transfer",
]
CHANNELS = ["Email", "Chat", "Phone", "Social Media", "Contact Form"]
TICKET_STATUSES = [
    "New",
    "Classified",
    "Auto-Resolved",
    "Escalated",
    "In Progress",
    "Pending Customer",
    "Resolved",
    "Closed",
    "Reopened",
]
AUTOMATED = "Automated"
HUMAN_REVIEW = "Human Review"
DECISION_PATHS = [AUTOMATED, HUMAN_REVIEW]
RESOLUTION_TYPES = ["Automated", "Human", "Hybrid"]
RESPONSE_STATUSES = ["NOT_ELIGIBLE", "DRAFT_GENERATED", "HUMAN_REVIEW_DRAFT", "BLOCKED"]
RESPONSE_TYPES = [
    "ORDER_STATUS",
    "PRODUCT_QUESTION",
    "PAYMENT_SUPPORT",
    "ACCOUNT_SUPPORT",
    "REFUND_SUPPORT",
    "ORDER_ISSUE",
    "COMPLAINT",
    "GENERAL_SUPPORT",
]
RESPONSE_TYPE_OF = {
    "Order Status Inquiry": "ORDER_STATUS",
    "Delivery Delay": "ORDER_STATUS",
    "Product Question": "PRODUCT_QUESTION",
    "Payment Problem": "PAYMENT_SUPPORT",
    "Account Problem": "ACCOUNT_SUPPORT",
    "Refund Request": "REFUND_SUPPORT",
    "Missing Item": "ORDER_ISSUE",
    "Damaged Product": "ORDER_ISSUE",
    "Complaint": "COMPLAINT",
    "Other": "GENERAL_SUPPORT",
}

# --- Fixed values: labels shown for NULL ----------------------------------------
NOT_DECIDED = "(not yet decided)"
NOT_PROCESSED = "(not yet processed)"
UNKNOWN_TYPE = "(unknown/unclassified)"
UNCLASSIFIED = "(unclassified)"
NOT_AVAILABLE = "NOT AVAILABLE"

# --- Fixed values: rule names and their wording (fired, quiet) -------------------
RULE_TEXT = {
    "base_category_priority": (
        "Category '{category}' maps to base priority '{base}'.",
        "No AI-predicted category available; defaulting to Medium pending classification.",
    ),
    "strong_negative_sentiment_priority": (
        "sentiment_score={sentiment} <= {limit}: raising priority floor to High.",
        "Sentiment not strongly negative (or not available).",
    ),
    "high_value_vip_order_priority": (
        "VIP customer with order_value={value} >= {limit}: raising priority floor to High.",
        "Not a high-value VIP order (or order/segment data unavailable).",
    ),
    "missing_classification": (
        "No AI classification available for this ticket yet.",
        "AI classification is present.",
    ),
    "low_confidence": (
        "classification_confidence={confidence} < {limit}.",
        "Confidence meets the threshold.",
    ),
    "sensitive_category": (
        "Category '{category}' is flagged as sensitive/high-risk.",
        "Category is not on the sensitive list.",
    ),
    "strong_negative_sentiment_review": (
        "sentiment_score={sentiment} <= {limit}.",
        "Sentiment not strongly negative (or not available).",
    ),
    "missing_order_context": (
        "Category '{category}' is order-specific but no order_id is linked to this ticket.",
        "Order context is consistent with the category (or not applicable).",
    ),
    "sentiment_category_conflict": (
        "Category is 'Complaint' but sentiment_score={sentiment} > {limit} reads positive — signals conflict.",
        "No category/sentiment conflict detected.",
    ),
}
NO_CATEGORY_TO_ASSESS = "No classification to assess confidence for."
NO_CONFIDENCE_RECORDED = "Classification present but no confidence score was recorded."
FALLBACK_RULE = "fallback_invalid_input"
RULE_FALLBACK_REASON = "Input validation failed, defaulted to safe human-review fallback: "

# --- Fixed values: response rationale wording -------------------------------------
NO_DECISION_YET = "No Phase 4 decision exists yet for this ticket."
RESPECT_HUMAN_REVIEW = (
    "Phase 4 decision_path is 'Human Review' — Phase 5 respects this decision "
    "and will not produce a customer-facing response."
)
RECHECK_FAILED = (
    "Phase 4 says Automated, but Phase 5's re-verification found a "
    "safety concern — failing safe to human review:"
)
PROBLEM_NO_CLASS = "classification is missing (unexpected: decision_path is Automated)."
PROBLEM_NO_CONFIDENCE = "classification_confidence is missing."
PROBLEM_LOW_CONFIDENCE = "classification_confidence {confidence} is below the {limit} threshold."
PROBLEM_SENSITIVE = "category '{category}' is sensitive."
PROBLEM_SENTIMENT = "sentiment_score {sentiment} is strongly negative."
PROBLEM_NO_ORDER = "category '{category}' requires order context, but no order is linked."
OK_CLASS = "classification present ({category})."
OK_CONFIDENCE = "confidence {confidence} meets threshold."
OK_ORDER = "required order context is present."
INTERNAL_DRAFT_OK = "Internal draft generated for agent reference (not customer-facing)."
INTERNAL_DRAFT_FAILED = "Internal draft not produced ({failure}); ticket still awaits human review regardless."
INTERNAL_DRAFT_SKIPPED = "Draft generation skipped (no generator configured)."
AUTOMATED_SKIPPED = (
    "Eligible for an automated response, but no generator was configured, "
    "so no customer-facing draft was produced."
)
AUTOMATED_OK = "Draft generated and passed the response safety scan."
AUTOMATED_UNSAFE = (
    "Draft was generated but BLOCKED by the safety scan: {codes}. "
    "The offending text is deliberately not retained."
)
AUTOMATED_DECLINED = "No draft produced — insufficient grounded context (missing: {missing})."
AUTOMATED_FAILED = "No draft produced — generation failed ({failure})."
RESPONSE_FALLBACK_REASON = "Input validation failed, defaulted to safe NOT_ELIGIBLE fallback: "
MISSING_CONTEXT_MARKERS = [
    "insufficient grounded context",
    "requires order context",
    "classification is missing",
    "no order is linked",
]
SKIPPED_MARKERS = [
    "no generator was configured",
    "generation skipped (no generator configured)",
]

# --- Fixed values: owned columns of the three write-backs ---------------------------
CLASSIFIER_COLUMNS = ["ai_predicted_category", "classification_confidence", "sentiment_score", "decision_at"]
ROUTING_COLUMNS = ["final_priority", "decision_path", "rule_decision_at"]
RESPONSE_COLUMNS = ["response_status", "response_type", "response_draft", "response_generated_at"]


@dataclass(frozen=True)
class Thresholds:
    """Business thresholds; Decimals, so that edge values compare exactly."""

    # --- Fixed values: defaults ---
    high_value_order: Decimal = Decimal("450.0")
    low_confidence: Decimal = Decimal("0.75")
    strong_negative_sentiment: Decimal = Decimal("-0.7")
    conflict_positive_sentiment: Decimal = Decimal("0.3")


DEFAULTS = Thresholds()
