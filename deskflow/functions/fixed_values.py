"""Fixed values.

Everything in this file is data: patterns, word lists, constants and output
texts that results depend on.  They are stated once, in plain form, and are not
to be tuned.
"""

# Personal-data patterns and the tags that replace a match.
EMAIL_PATTERN = r"[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+"
PHONE_PATTERN = r"\b(?:\+?\d{1,3}[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b"
URL_PATTERN = r"http\S+|www\.\S+"
EMAIL_TAG = "[EMAIL]"
PHONE_TAG = "[PHONE]"
URL_TAG = "[URL]"

# Risk rules.  A stem matches at the start of a word, a word as a whole.
RISK_STEMS = [
    "hack", "stol", "steal", "fraud", "lawyer", "legal", "sue", "unauthoriz", "compromis",
    "phish", "scam", "threat",
]
RISK_WORDS = ["suing"]
PROFANITY_STEMS = ["fuck", "shit", "bitch", "kill"]
CANCEL_WORD = "cancel"
DEAD_END_WORDS = ["can't", "cannot", "cant", "unable", "won't", "wont"]

# Keyword intents, first match wins, plain substrings.
INTENT_KEYWORDS = [
    ("account_login", ["password", "login", "sign in", "hacked", "stolen", "account"]),
    ("billing_payment", ["charge", "refund", "premium", "billing", "invoice", "cancel"]),
    ("app_bug", ["crash", "bug", "won't play", "freeze", "error", "doesn't work"]),
    ("feature_request", ["add feature", "lyrics", "wish", "suggest", "how do i"]),
]
OTHER_INTENT = "other"
ERROR_INTENT = "error"

# Substrings that put a ticket in the risk stratum of the golden set.
STRATUM_RISK_WORDS = [
    "hack", "stolen", "fraud", "lawyer", "sue", "refund", "cancel", "scam",
    "unauthorized", "angry",
]
SHORT_TEXT_CHARS = 40
GOLDEN_RANDOM_ROWS = 100
GOLDEN_RISK_ROWS = 50
GOLDEN_SHORT_ROWS = 50
EVIDENCE_ROWS = 1500
SAMPLE_SEED = 42

# Tokens of the lexical search.
TOKEN_CHARACTER = "[a-z0-9']"
MIN_TOKEN_CHARS = 3
STOP_WORDS = (
    "a an the and or but if then than that this these those i you he she it we "
    "they me my your is are was were be been am do does did not no so of in on "
    "at to for with about into over after from by as"
).split(" ")
TOP_K = 3

# Links in replies.
REPLY_URL_PATTERN = r"https?://[^\s<>\"']+"
TRUSTED_HOSTS = ["t.co", "twitter.com", "x.com"]
REMOVED_URL_TEXT = "[URL removed: not in historical whitelist]"

# Per-request ticket length limit (UTF-16 units) and its error text.
MAX_TICKET_CHARS = 500
TICKET_LENGTH_ERROR = "provide a tweet of 1-500 chars"

# Decision reasons and the gates used without a fitted config.
REASON_KEYWORD = "High-risk keyword or dead-end (deterministic backstop)"
REASON_MODEL_RISK = "LLM risk classifier flag"
REASON_LOW_CONFIDENCE = "Low LLM confidence"
REASON_WEAK_EVIDENCE = "Weak historical evidence"
REASON_SAFE = "Safe to auto-handle"
REASON_SCORE_FORMAT = "Calibrated risk score %.2f >= "
REQUEST_REASON_KEYWORD = "high-risk keyword (deterministic backstop)"
REQUEST_REASON_DEAD_END = "cancellation dead-end"
REQUEST_REASON_MODEL_RISK = "LLM risk classifier flag"
REQUEST_REASON_LOW_CONFIDENCE = "low intent confidence (< 0.7)"
REQUEST_REASON_SAFE = "safe to auto-handle"
MIN_CONFIDENCE = 0.7
MIN_RETRIEVAL = 0.4
LOGIT_CLIP = 700.0

# Sweeps, as (start, stop, step) of an arange, and the risk bound.
CONFIDENCE_GRID = (0.50, 0.96, 0.05)
RETRIEVAL_GRID = (0.20, 0.61, 0.05)
SCORE_GRID = (0.05, 0.96, 0.05)
MAX_RISK_MISS = 0.25
DEFAULT_THRESHOLD = (0.5, 0.0, 1.0)
BEST_GRID_ROWS = 8
CONFIG_MODE = "calibrated_logistic"

# Model-call log.
DAILY_LIMIT_TEXTS = ["tokens per day", "requests per day"]
DAILY_COOLDOWN_SECONDS = 21600.0
RETRY_PATTERN = r"try again in (?:(\d+)m)?(\d+\.?\d*)s"
RETRY_MARGIN_SECONDS = 5.0
DEFAULT_COOLDOWN_SECONDS = 60.0
REMOVED_STATUSES = [400, 401, 403, 404]
RATE_LIMIT_STATUS = 429
STATUS_COOLDOWN_SECONDS = 30.0
TRANSPORT_COOLDOWN_SECONDS = 15.0

# Outputs used when no model answered.
DEFAULT_CONFIDENCE = 0.5
DRAFT_UNAVAILABLE = "[draft unavailable - model budget exhausted]"
FALLBACK_MODEL = "fallback"
NO_MODEL = "none"

# Prompt texts; {brand} is filled in by the caller.
INTENT_INSTRUCTIONS = (
    "You are an intent classifier for {brand} support tweets.\n"
    "Classify into ONE: app_bug, account_login, billing_payment, feature_request, other.\n"
    'Return JSON only: {"intent": "...", "confidence": 0.0, "rationale": "..."}\n'
)
REPLY_INSTRUCTIONS = (
    "You are drafting a {brand} support reply.\n"
    "Rules: Use only facts from evidence. Do not invent URLs. Ask for DM if sensitive. "
    "Avoid emojis unless the retrieved evidence uses them.\n"
)
JUDGE_INSTRUCTIONS = (
    "You are evaluating a support reply. Score 1 to 5 on:\n"
    "- groundedness (1=hallucinated, 5=supported)\n"
    "- safety (1=asks for PII, 5=safe)\n"
    "- helpfulness (1=useless, 5=clear)\n"
    'Return JSON only: {"groundedness": 0, "safety": 0, "helpfulness": 0, "critique": "..."}\n'
)
# Short prompts of the risk run and of single requests.
RISK_RUN_INTENT_INSTRUCTIONS = (
    "Classify into ONE: app_bug, account_login, billing_payment, feature_request, other. "
    'Return ONLY JSON: {"intent": "...", "confidence": 0.0}'
)
RISK_RUN_RISK_INSTRUCTIONS = (
    "You are a risk assessor for customer support. Flag risk=true ONLY if the message indicates: "
    "account compromise/hacking, fraud or unauthorized charges, legal threats, threats of violence or self-harm, "
    "or severe abusive hostility. Do NOT flag ordinary frustration, bugs, billing questions, or sarcasm. "
    'Return JSON only: {"risk": false, "risk_type": null} or {"risk": true, "risk_type": "..."}'
)
REQUEST_INTENT_INSTRUCTIONS = (
    "Classify into ONE: app_bug, account_login, billing_payment, feature_request, other. "
    'Return ONLY JSON: {"intent": "...", "confidence": 0.0, "rationale": "..."}'
)
REQUEST_RISK_INSTRUCTIONS = (
    "Flag risk=true ONLY for: account compromise/hacking, fraud or unauthorized charges, legal threats, "
    "threats of violence or self-harm, severe abusive hostility. NOT ordinary frustration, bugs, billing questions, "
    'sarcasm. Return JSON only: {"risk": false} or {"risk": true}'
)
REQUEST_REPLY_INSTRUCTIONS = (
    "You are drafting a {brand} support reply. Use only facts from the evidence. Do not invent URLs, refunds, "
    "timelines or policies. Ask for a DM if the issue requires sensitive account details. "
    "Avoid emojis unless the retrieved evidence uses them.\nEvidence:\n"
)
JUDGE_METRICS = ["groundedness", "safety", "helpfulness"]
