"""Word lists and patterns that results depend on.

Patterns keep to what Java and RE2 read alike, but for the one named
LOOKAROUND, and for word boundaries: :func:`java` gives Spark the ASCII ones.
"""

import re


def java(pattern: str) -> str:
    r"""The pattern with ``\b`` as a boundary of ``\w``, which Java otherwise takes from all of Unicode."""
    return pattern.replace(r"\b", r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))")


def bounded(pattern: str) -> str:
    r"""As :func:`java`, for patterns in which every ``\b`` stands before a word character (before a group, a letter) or else after one: one look each."""
    return re.sub(r"\\b(?=\(\?:|[a-z])", lambda _: r"(?<!\w)", pattern).replace(r"\b", r"(?!\w)")


# Units of text.
TERM = r"!?[A-Za-z0-9](?:[A-Za-z0-9*%+!./-]*[A-Za-z0-9*%-])?"
TOKEN_UNIT = r"[A-Za-z0-9_]+|[^A-Za-z0-9_ \t\n\x0B\f\r]"
SENTENCE = r"[^.!?]+[.!?]*"
WORD = r"[A-Za-z0-9'`-]+"
BREATH = r"(?i)[,;:—–]| \b(?:and|but|or|so|because|while|which|that)\b "
NOMINAL = r"(?i)^\w*(?:tion|sion|ment|ance|ence|ity|ness|ing|ization|isation)$"
PASSIVE = r"(?i)\b(?:is|are|was|were|be|been|being)\s+\w+(?:ed|en)\b"
FILLERS = (
    "in order to", "it should be noted", "it is important to note", "as previously",
    "at this point in time", "due to the fact that", "for the purpose of",
)
# Words per minute, low and high.
PACES = {
    "commercial": (140, 165),
    "professional_introduction": (135, 160),
    "technical_explainer": (90, 135),
    "reflective_narration": (90, 120),
    "compliance": (85, 125),
}

# What a rewrite must keep.
MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December|Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sep|Sept|Oct|Nov|Dec"
DATE = (
    r"(?i)\b(?:\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{2,4}|(?:" + MONTHS + r")\.?\s+\d{1,2}(?:st|nd|rd|th)?,?\s*\d{0,4}|\d{1,2}\s+(?:" + MONTHS + r")\.?\s*\d{0,4})\b"
)
NUMBER_LOOKAROUND = r"(?<![\w.])[$€£]?\d[\d,]*(?:\.\d+)?%?(?!\w)"
BACKTICKED = r"`([^`\n]{1,80})`"
NAME = r"\b[A-Z][a-zA-Z]+\b"
SENTENCE_INITIAL = r"(^|[.!?]\s+|\n)\s*[A-Z][a-zA-Z]+\b"
OBLIGATION_STRONG = ("must", "shall", "required", "requires", "mandatory", "have to", "has to")
OBLIGATION_WEAK = ("should", "may", "might", "can", "could", "optional", "consider", "recommended")
HEDGES = (
    "may", "might", "could", "can", "possibly", "potentially", "not been proven",
    "unproven", "appears", "suggests", "likely", "unlikely", "in some cases",
)
ABSOLUTES = (
    "will always", "guarantees", "guaranteed", "prevents", "ensures", "eliminates",
    "proven to", "never fails", "always works", "certainly",
)

# Queries that ask for a contrast.
CONTRAST = (
    "avoid", "robotic", "mechanical", "what not to", "should not", "reject", "rejected", "contrast",
    "negative", "wrong with", "sounds bad", "too flat", "monotone", "over-enunciat",
)

# Families of injected instructions.
INJECTIONS = {
    "instruction_override": r"(?i)\b(?:ignore|disregard|forget|override)\b[^.\n]{0,40}\b(?:previous|prior|above|earlier|system|all)\b[^.\n]{0,20}\b(?:instruction|prompt|rule|direction)",
    "role_reassignment": r"(?i)\b(?:you are now|from now on,? you|act as|pretend to be|new persona)\b",
    "tool_invocation": r"(?i)(?:<\s*(?:tool_use|function_call|invoke)\b|```(?:tool|function)\b|\bcall the \w+ tool\b)",
    "shell_execution": r"(?i)\b(?:rm\s+-rf|sudo\s+\w|curl\s+[^\s]+\s*\|\s*(?:ba)?sh|wget\s+[^\s]+\s*\|)",
    "exfiltration": r"(?i)\b(?:send|post|upload|exfiltrat\w+)\b[^.\n]{0,30}\b(?:to\s+https?://|api[_ ]key|token|credential|password)",
    "path_traversal": r"(?:\.\./){2,}|/etc/(?:passwd|shadow)\b",
}
# Words in lower case of which a match of each family has one at least: texts without them need no pattern.
INJECTION_WORDS = {
    "instruction_override": ("ignore", "disregard", "forget", "override"),
    "role_reassignment": ("you are now", "from now on", "act as", "pretend to be", "new persona"),
    "tool_invocation": ("tool_use", "function_call", "invoke", "```tool", "```function", "call the "),
    "shell_execution": ("-rf", "sudo", "curl", "wget"),
    "exfiltration": ("send", "post", "upload", "exfiltrat"),
    "path_traversal": ("../../", "/etc/passwd", "/etc/shadow"),
}

# The query for guidance on prose.
GUIDANCE = "sentence rhythm breath group pace emphasis noun stacking"

# The words of a query for a rewrite's context, and how many characters of the text it takes.
REWRITE, REWRITE_CHARS = "rhythm cadence flow", 500

# How the corpus says that evidence is weak, and the mark of a definition that names its ground.
WEAK_EVIDENCE = ("no universal words-per-minute target", "not universal facts", "there is no universal")
GROUNDED = "**Grounded in:**"
LEAST_DEFINITION = 600

# Corpus lint.
STATUSES = ("approved", "quarantined", "refused", "deferred")
PRIMARY_TYPES = ("approved_example", "style_rule")
AUXILIARY_CAP = 0.40
NEGATIVE_TYPE = "negative_pattern"
BINARY_SUFFIXES = (".mp3", ".m4a", ".mp4", ".wav", ".zip", ".pdf", ".sqlite3", ".bin")
TEXT_SUFFIXES = (".txt", ".md", ".markdown", ".rst", ".dict", ".pdf")
SECRETS = (
    r"gh[pousr]_[A-Za-z0-9]{20,}",
    r"sk-[A-Za-z0-9]{20,}",
    r"AKIA[0-9A-Z]{16}",
    r"BEGIN [A-Z ]*PRIVATE KEY",
    r"""(?i)\b(?:api[_-]?key|secret|password)\b\s*[:=]\s*['"][^'"]{8,}""",
)
CLAIMS = r"(?i)\b(?:production[- ]ready|fully operational|guaranteed results|100% accurate)\b"
POSITIVE = r"(?i)`?positive_target`?|approved (?:target|exemplar)"

# Speaker turns, sections and separators for chunking.
TURN = r"^\s*(?:[A-Z][A-Za-z0-9_. -]{0,30}:|\[[^\]]{1,40}\])\s"
SEPARATORS = ("\n## ", "\n# ", "\n\n", "\n", ". ", "? ", "! ", "; ", ", ", " ")
