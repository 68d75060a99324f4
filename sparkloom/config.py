"""Fixed values of the text-classification analytics and the checks on configuration."""

from __future__ import annotations

from dataclasses import dataclass, field

# fixed values: feature order, keyword lists, thresholds
FEATURES = (
    "url_count", "ip_address_url_count", "urgency_word_count", "credential_word_count", "action_word_count", "money_related_word_count", "uppercase_letter_ratio", "exclamation_mark_count",
)
RATIO_FEATURE = "uppercase_letter_ratio"
CATEGORIES = ("urgency", "credential", "action", "money_related")
SPLITS = ("train", "validation", "test")
RATIOS = {"train": 0.70, "validation": 0.15, "test": 0.15}
SEED = 42
VARIANTS = {
    "de-activated": "deactivated", "de-activation": "deactivation", "on-hold": "on hold", "sign-in": "sign in", "log-in": "log in", "user-id": "user id", "credit-card": "credit card", "debit-card": "debit card",
    "e-mail": "email", "re-validate": "validate", "revalidate": "validate", "re-confirm": "confirm", "reconfirm": "confirm", "re-verify": "verify", "reverify": "verify",
}
KEYWORDS = {
    "urgency": [
        "urgent", "urgently", "immediate", "immediately", "action required", "warning", "alert", "within 24 hours", "within 48 hours", "as soon as possible", "expire", "expires", "expired", "expiration", "suspended",
        "suspension", "deactivated", "deactivation", "blocked", "on hold", "pending", "locked", "disabled", "restricted", "unusual activity", "suspicious activity",
    ],
    "credential": [
        "account", "mailbox", "password", "passcode", "pin", "username", "user id", "login", "log in", "sign in", "credentials", "authentication", "identity", "verification", "security code", "access code",
        "personal information", "email address", "phone number",
    ],
    "action": [
        "verify", "validate", "confirm", "update", "click", "download", "submit", "provide", "enter", "review", "respond", "reply", "activate", "unlock", "restore", "renew", "upgrade", "complete", "follow", "visit", "view",
    ],
    "money_related": [
        "payment", "invoice", "bank", "banking", "transaction", "transfer", "deposit", "refund", "billing", "bill", "credit card", "debit card", "balance", "money", "funds", "fee", "charge", "purchase", "receipt", "tax",
        "loan", "mortgage", "dollar", "dollars", "usd", "pound", "pounds", "gbp", "euro", "euros", "eur",
    ],
}
DISPLAY_NAMES = {
    "url_count": "Number of links", "ip_address_url_count": "IP-address links", "urgency_word_count": "Urgency-related words", "credential_word_count": "Account and credential words",
    "action_word_count": "Action-request words", "money_related_word_count": "Money-related words", "uppercase_letter_ratio": "Uppercase-letter proportion", "exclamation_mark_count": "Exclamation marks",
}
TOWARDS = {1: "pushed the prediction towards phishing", -1: "pushed the prediction towards legitimate"}
CLASS_NAMES = {0: "legitimate", 1: "phishing"}
FROZEN_MODEL = {"max_depth": 4, "learning_rate": 0.05, "n_estimators": 200, "min_child_weight": 5}
FROZEN_THRESHOLD, RELOAD_TOLERANCE = 0.35, 1e-12
NA_WORDS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
SIMILAR, VERY_SIMILAR, SEVERE_COVERAGE = 0.90, 0.95, 0.05
KS_THRESHOLD, NEAR_CONSTANT = 0.20, 0.995
PROBABILITY_TOLERANCE, ADDITIVITY_TOLERANCE, TIE = 1e-7, 1e-5, 1e-12
DISTANCE_PERCENTILE, SHARED_DIFFERENCE, MEDOID_KS = 0.95, 0.5, (2, 3, 4, 5, 6)
GRID = {"max_depth": (2, 3, 4), "learning_rate": (0.05, 0.1), "n_estimators": (100, 200), "min_child_weight": (1, 5)}


class KeywordConfigError(ValueError):
    """A keyword definition that is missing or not frozen."""


class ContractError(ValueError):
    """Data that break a contract."""


@dataclass(frozen=True)
class Keywords:
    status: str = "frozen"
    version: str = "1.0"
    variants: dict = field(default_factory=lambda: VARIANTS)
    lists: dict = field(default_factory=lambda: KEYWORDS)

    def __post_init__(self) -> None:
        if (self.status, self.version) != ("frozen", "1.0"):
            raise KeywordConfigError("only frozen keywords of version 1.0 can be used")
        empty = [c for c in CATEGORIES if not self.lists.get(c) or any(not isinstance(w, str) or not w for w in self.lists[c])]
        if empty:
            raise KeywordConfigError(f"no usable terms in {', '.join(empty)}")


def check_frozen_model(config: dict, threshold: float | None = None) -> dict:
    """A frozen model's configuration, if it keeps its contract: features in order, both labels, a threshold from 0 to 1
    (or exactly `threshold`) and the seed."""
    faults = []
    if list(config.get("features", [])) != list(FEATURES) or list(DISPLAY_NAMES) != list(FEATURES):
        faults.append("features")
    if {int(k): v for k, v in config.get("labels", {}).items()} != CLASS_NAMES:
        faults.append("labels")
    t = config.get("threshold")
    if not isinstance(t, (int, float)) or isinstance(t, bool) or not 0 <= t <= 1 or threshold is not None and t != threshold:
        faults.append("threshold")
    if config.get("seed") != SEED:
        faults.append("seed")
    if faults:
        raise ContractError(f"the frozen model's configuration is wrong in: {', '.join(faults)}")
    return config
