"""Domain constants.

Fixed values: these must equal the reference application's settings for
results to match, and are stated here plainly in their natural order.
"""

# Ticket domains.
CATEGORIES = [
    "Billing",
    "Technical Issue",
    "Feature Request",
    "Account Management",
    "Product Information",
    "Refund & Return",
    "General Inquiry",
]
PRIORITY_LEVELS = ["Low", "Medium", "High", "Critical"]
CHANNELS = ["Email", "Chat", "Phone", "Social Media", "Web Form"]

# Confidence bands.
CONFIDENCE_HIGH = 0.8
CONFIDENCE_MEDIUM = 0.5
CONFIDENCE_LOW = 0.3

# Performance-monitor thresholds.
MONITOR_THRESHOLDS = {
    "accuracy_drop": 0.05,
    "confidence_drop": 0.1,
    "latency_increase": 2.0,
    "error_rate_increase": 0.02,
    "drift_score": 0.3,
}
ALERT_COOLDOWN_MINUTES = 60

# Text cleaning patterns (Java regex syntax).
URL_PATTERN = r"http\S+|www\S+|https\S+"
EMAIL_PATTERN = r"\S+@\S+"
PHONE_PATTERN = r"\b\d{3}[-.]?\d{3}[-.]?\d{4}\b"
NON_LETTER_PATTERN = r"[^a-zA-Z\s]"

# Drift thresholds and bin counts.
DRIFT_THRESHOLD = 0.05
PSI_EDGES = 10
JS_EDGES = 20
PSI_EPS = 1e-10

# Streaming defaults.
STREAM_BATCH_SIZE = 10
STREAM_BATCH_TIMEOUT_S = 5
EMA_ALPHA = 0.1
