"""Text cues of a business note as SQL expressions over ``raw_text`` and ``authored_at``.

``low`` is the lower-cased text.  Patterns carry ``(?U)`` so that word boundaries and
digits follow Unicode, and ``(?d)`` where a dot must stop at a newline only.
"""

from __future__ import annotations

# The cue vocabulary of the rules-v0.2.0 extractor.
NEGATION_PHRASES = (
    "is not increasing", "no increase planned", "will not be going up",
    "reversed their previous decision", "cancelled", "no longer happening",
)
REVERSAL_PHRASES = ("cancelled", "canceled", "no longer happening", "reversed their previous decision")
CERTAINTY_PHRASES = (
    ("confirmed they will", "ASSERTED"),
    ("mentioned they may possibly", "UNKNOWN"),
    ("indicated they might", "POSSIBLE"),
    ("will likely", "LIKELY"),
    ("expects to", "EXPECTED"),
    ("expected to", "EXPECTED"),
)
CERTAINTY_WORDS = (
    ("might", "POSSIBLE"), ("may", "POSSIBLE"), ("confirmed", "ASSERTED"),
    ("expect", "EXPECTED"), ("will", "LIKELY"),
)
SUBJECT_PHRASES = (
    ("volume tied to the upcoming promotion", "COMMERCIAL_EVENT"),
    ("our ability to fulfill on time", "SUPPLY_FULFILLMENT"),
    ("the order quantity", "QUANTITY_REVISION"),
    ("the delivery schedule", "TIMING_REVISION"),
    ("purchase volume", "PURCHASE_INTENT"),
    ("market demand", "MARKET_CONTEXT"),
    ("inventory", "INVENTORY_POSITION"),
    ("the order", "ORDER_LIFECYCLE"),
    ("orders", "DEMAND_EXPECTATION"),
    ("volume", "DEMAND_EXPECTATION"),
    ("demand", "DEMAND_EXPECTATION"),
)
CONDITION_PATTERN = r"(?iuU)\b(if [^.]+|pending [^.]+|unless [^.]+)"
MAGNITUDE_PATTERN = r"(?iuU)roughly\s+(\d+(?:\.\d+)?)\s*%"
# End of fixed values.


# A plain substring test comes before each pattern: most texts lack the word altogether and
# never reach the regular expression.


def _any(words) -> str:
    return "(" + " or ".join(f"contains(low, '{w}')" for w in words) + ")"


def _phrases(phrases) -> str:
    """Any of the phrases as whole words."""
    return rf"({_any(phrases)} and low rlike r'(?U)\b(?:{'|'.join(phrases)})\b')"


def _word(word: str) -> str:
    return _phrases([word])


def negated() -> str:
    return _phrases(NEGATION_PHRASES)


def is_reversal() -> str:
    return _phrases(REVERSAL_PHRASES)


def rising() -> str:
    return (rf"({_word('increase')} and not contains(low, 'no increase') "
            r"or contains(low, 'need') and low rlike r'(?U)\bneeds?\s+(?:additional|more)\b')")


def falling() -> str:
    return _word("decrease")


def steady() -> str:
    return r"(contains(low, 'keep') and contains(low, 'steady') and low rlike r'(?dU)\bkeep\b.*\bsteady\b')"


def direction() -> str:
    """Direction over the flags ``negated``, ``rising``, ``falling``, ``steady``; null without a cue."""
    return (
        "case when negated then 'STABLE' when rising and falling then 'MIXED' when steady then 'STABLE' "
        "when rising then 'INCREASE' when falling then 'DECREASE' end")


def certainty() -> str:
    phrases = " ".join(f"when contains(low, '{p}') then '{c}'" for p, c in CERTAINTY_PHRASES)
    words = " ".join(f"when {_word(w)} then '{c}'" for w, c in CERTAINTY_WORDS)
    return f"case {phrases} {words} else 'UNKNOWN' end"


def condition_text() -> str:
    clause = f"if({_any(('if ', 'pending ', 'unless '))}, regexp_extract(raw_text, r'{CONDITION_PATTERN}', 1), '')"
    return rf"nullif(regexp_replace({clause}, r'(?U)^\s+|\s+$', ''), '')"


def magnitude_value() -> str:
    number = f"if(contains(low, 'roughly'), regexp_extract(raw_text, r'{MAGNITUDE_PATTERN}', 1), '')"
    return f"try_cast(nullif({number}, '') as double)"


def subject() -> str:
    """Signal type of the longest subject phrase in the text; null when none occurs."""
    longest_first = sorted(SUBJECT_PHRASES, key=lambda pair: -len(pair[0]))
    return "case " + " ".join(f"when contains(low, '{p}') then '{t}'" for p, t in longest_first) + " end"


# Time expressions in order of priority: phrase, granularity, start, end (half-open).
_MONTH, _QUARTER, _YEAR = (f"date_trunc('{u}', authored_at)" for u in ("month", "quarter", "year"))
TIME_WINDOWS = (
    ("next month", "month", f"{_MONTH} + interval 1 month", f"{_MONTH} + interval 2 month"),
    ("next quarter", "quarter", f"{_QUARTER} + interval 3 month", f"{_QUARTER} + interval 6 month"),
    ("next year", "year", f"{_YEAR} + interval 1 year", f"{_YEAR} + interval 2 year"),
    ("later this year", "unknown", "authored_at", f"{_YEAR} + interval 1 year"),
    ("in the next couple of weeks", "week", "authored_at", "authored_at + interval 14 days"),
)


def time_expression() -> str:
    return "case " + " ".join(f"when contains(low, '{p}') then '{p}'" for p, *_ in TIME_WINDOWS) + " end"


def by_time_expression(part: int) -> str:
    """Granularity (1), start (2) or end (3) belonging to ``time_expression_raw``."""
    value = lambda w: f"'{w[1]}'" if part == 1 else w[part]
    return "case time_expression_raw " + " ".join(f"when '{w[0]}' then {value(w)}" for w in TIME_WINDOWS) + " end"
