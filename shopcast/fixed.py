"""Fixed values.

Word lists, phrases, defaults and patterns that results must contain exactly.
They are stated here as plain text, in natural order, and used everywhere else
by name.
"""

# Stock codes that stand for charges and adjustments, not for products.
NON_PRODUCT_CODES = ("BANK CHARGES", "C2", "DOT", "M", "PADS", "POST")
UNKNOWN_DESCRIPTION = "UNKNOWN"

# Recency features: prefix, cap and fill value in days.
RECENCY_PREFIX = "days_since_last_"
RECENCY_CAP = 360
RECENCY_MARK = "days_since_"

# Rendering of values.
MISSING = "N/A"
YES = "Yes"
NO = "No"

# Distribution text.
DISTRIBUTION_HEAD = "Distribution of "
VALUE_COUNTS_LINE = "- Value counts:"
MEAN_LINE = "- Mean: "
RANGE_LINE = "- Range: "
NON_ZERO_LINE = "- Percent of non-zero values: "
UNDER_CAP_LINE = "- Percent of values under 360 days: "
PERCENTILES_LINE = "- Percentiles:"
DECILES = (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)

# Predictions.
PREDICTION_PREFIX = "pred_"
CONFIDENCE_FIELD = "pred_confidence"
REASONING_FIELD = "pred_reasoning"
DEFAULT_CONFIDENCE = 0.5
DEFAULT_REASONING = "No reasoning provided"
FALLBACK_CONFIDENCE = 0.0
FALLBACK_REASONING = "Fallback prediction due to processing error"

# Patterns for free-text replies.
JSON_ARRAY_PATTERN = r"(?s)\[.*\]"
NUMBER_COMMA_PATTERN = r"(?<=\d),(?=\d{3})"

# Class labels as text, and the marks a text reply is cut at.
ACCEPT = "accept"
REFUSE = "refuse"
ANSWER_MARK = "answer"
RESPONSE_MARK = "response"
CONFIDENCE_MARK = "confidence"
REASON_MARK = "reason"
END_OF_TURN = "<|eot_id|>"
PROFILE_MARK = "profile:"

# Confidence by rank of a similar text; later ranks get the last value.
RANK_CONFIDENCE = (85, 80, 75, 70, 65)
LATER_CONFIDENCE = 80

# Item columns that are counted apart from the numeric features.
ITEM_PREFIXES = ("Previous view of", "Previous order of")

# Sentence about the quartiles of a column, with its figures by name.
QUARTILE_SENTENCE = (
    "has a mean value of {mean} with a standard deviation of {std}. "
    "The minimum observed value is {min}, while the maximum is {max}. "
    "Approximately 25% of the values are below {q25}, the median (50th percentile) is {q50}, "
    "and 75% of the values fall below {q75}. "
)

# Lines of the prompts.
CUSTOMER_LINE = "Customer "
PROFILE_LINE = "Profile: "
TREATMENT_LINE = "Treatment: "
EXAMPLES_HEAD = "Similar Examples for Customer "
EXAMPLE_LINE = "Example "
SIMILARITY_LINE = " (similarity: "
OUTCOMES_LINE = "Actual Outcomes: "

# What the model is asked to return.
REPLY_FORMAT = "JSON format with fields: "
PREDICTED_FIELD = "Predicted "
CONFIDENCE_TEXT = "Confidence level in the prediction (float, 0-1)"
REASONING_TEXT = "Detailed explanation for the prediction (string)"

# Cases and similar texts.
CASE_LINE = "Customer Profile: "
CASE_ANSWER = "Answer: "
CASE_CATEGORIES = "Preferred Categories: "
TEXT_ANSWER = ". Answer: "
TEXT_CONFIDENCE = ". Confidence: "
TEXT_CATEGORIES = ". Preferred categories: "
