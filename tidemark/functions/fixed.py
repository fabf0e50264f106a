"""Vocabularies, tables and patterns that results depend on."""

# fixed values: label vocabularies
DIRECTIONS = ("positive", "negative", "mixed", "neutral")
NOVELTIES = ("new", "follow_up", "duplicate", "unknown")
RELEVANCES = ("direct", "industry_linked", "incidental", "unknown")
SURPRISES = ("unexpected", "partly_expected", "expected", "unknown")
AMBIGUITIES = ("low", "medium", "high")
ENTITY_MATCHES = ("matched", "not_matched", "uncertain")
CATEGORIES = (
    "earnings",
    "guidance",
    "analyst",
    "regulatory_legal",
    "product",
    "financing_ma",
    "management",
    "macro_industry",
    "other",
)
LABEL_VOCABULARIES = {
    "entity_match": ENTITY_MATCHES,
    "direction": DIRECTIONS,
    "category": CATEGORIES,
    "novelty": NOVELTIES,
    "relevance": RELEVANCES,
    "surprise": SURPRISES,
    "ambiguity": AMBIGUITIES,
}

# fixed values: label scores
DIRECTION_SCORE = {"positive": 1.0, "negative": -1.0, "mixed": 0.0, "neutral": 0.0}
SURPRISE_SCORE = {"unexpected": 1.0, "partly_expected": 0.5, "expected": 0.0}
AMBIGUITY_SCORE = {"low": 0.0, "medium": 0.5, "high": 1.0}

# fixed values: the static fallback universe
STATIC_FALLBACK_SYMBOLS = (
    "AAPL", "ABBV", "AMD", "AMZN", "AVGO", "BAC", "COST", "CRM", "CVX", "DIS",
    "GOOGL", "HD", "INTC", "JNJ", "JPM", "KO", "LLY", "MA", "META", "MRK",
    "MSFT", "NFLX", "NVDA", "PEP", "PFE", "PG", "QCOM", "TSLA", "UNH", "XOM",
)

# fixed values: order lifecycle, state -> states an event may enter
ORDER_STATES = (
    "proposed", "rejected", "submitted", "working", "partial", "filled",
    "cancel_pending", "canceled", "expired", "closing", "reconciled",
)
ORDER_EDGES = {
    "proposed": ("submitted", "rejected"),
    "submitted": ("working", "partial", "filled", "rejected", "canceled", "expired"),
    "working": ("partial", "filled", "cancel_pending", "canceled", "expired"),
    "partial": ("filled", "cancel_pending", "canceled", "expired"),
    "cancel_pending": ("canceled", "partial", "filled"),
    "filled": ("closing", "reconciled"),
    "rejected": ("reconciled",),
    "canceled": ("reconciled",),
    "expired": ("reconciled",),
    "closing": ("reconciled",),
}

# fixed values: session lifecycle
SESSION_STATES = ("disarmed", "ready", "working", "open", "exiting", "closed", "halted")
SESSION_EDGES = {
    "disarmed": ("ready",),
    "ready": ("working", "halted", "disarmed"),
    "working": ("open", "ready", "halted", "disarmed"),
    "open": ("exiting", "halted", "disarmed"),
    "exiting": ("closed", "halted", "disarmed"),
    "closed": ("ready", "disarmed"),
    "halted": ("disarmed",),
}

# fixed values: broker order statuses and the order state each one means
BROKER_STATUSES = (
    "new", "partially_filled", "filled", "done_for_day", "canceled", "expired", "replaced",
    "pending_cancel", "pending_replace", "pending_review", "accepted", "pending_new",
    "accepted_for_bidding", "stopped", "rejected", "suspended", "calculated", "held", "unknown",
)
BROKER_STATE = {
    "accepted": "submitted",
    "pending_new": "submitted",
    "accepted_for_bidding": "submitted",
    "pending_review": "submitted",
    "new": "working",
    "partially_filled": "partial",
    "filled": "filled",
    "pending_cancel": "cancel_pending",
    "canceled": "canceled",
    "expired": "expired",
    "rejected": "rejected",
}
ACTIVITY_TYPES = ("fill", "partial_fill", "unknown")
POSITION_SIDES = ("long", "short", "unknown")

# fixed values: the text forms numbers and times must have
INTEGER_PATTERN = r"^-?(?:0|[1-9][0-9]*)$"
DECIMAL_PATTERN = r"^-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?$"
NONNEGATIVE_DECIMAL_PATTERN = r"^(?:0|[1-9][0-9]*)(?:\.[0-9]+)?$"
RFC3339_PATTERN = (
    r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}"
    r"(?:\.[0-9]+)?(?:Z|[+-][0-9]{2}:[0-9]{2})$"
)
