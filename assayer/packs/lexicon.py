"""A small data lexicon for prose without financial wording."""

from __future__ import annotations

COLUMNS = "rule_id, family, severity, is_action, pattern"
# (rule, family, severity, action, pattern)
LEXICON = [
    ("licence-line", "licence", "context", False, "(?i)licen[sc]e"),
    ("key-material", "secret", "attention", True, "(?i)token|secret|api[_ ]?key"),
    ("shouting", "noise", "attention", False, "!!|###"),
    ("contact", "contact", "attention", True, "@[a-z]"),
    ("long-number", "number", "attention", False, "[0-9]{12}"),
    ("symbol-run", "noise", "attention", False, "%%%"),
]
WORDS = [("licensed", "legal"), ("token", "secret"), ("secret", "secret"), ("key", "secret"), ("and", "plain"), ("the", "plain")]
