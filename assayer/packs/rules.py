"""The rule pack: atoms, rules, cautions, continuations and exemptions as data.

An atom is one named wording test. A rule names the atoms that must all be
present for its cue, and those that make the cue a live request (``ask``).
Patterns stay in the regex syntax shared by Spark and the SQL oracle.
"""

from __future__ import annotations

from typing import NamedTuple
from unicodedata import normalize

from assayer.core.regex import anyof, words
from assayer.packs import scopes, turns


def _n(pattern: str) -> str:
    return normalize("NFKC", pattern)


ATOMS: dict[str, str] = {
    name: _n(pattern)
    for name, pattern in {
        "pay": anyof(words("pay", "pays", "send", "transfer", "deposit", "remit", "bhejo", "bhejiye", "pathan", "jama"),
                     "भुगतान|भेजें|जमा करें|পাঠান|জমা দিন"),
        "fee": anyof(words("fee", "fees", "charge", "charges", "duty"), "शुल्क|फीस|চার্জ|ফি "),
        "release": anyof("(?i)releas|unlock|withdraw|recover|refund|nikasi", "निकासी|छुड़ा|তুলতে|রিলিজ"),
        "earn": anyof("(?i)earn|commission|salary|paid task|kamai|rojgar", "कमाई|রোজগার"),
        "secret": anyof(words("otp", "pin", "password", "cvv", "passcode"), "ओटीपी|पासवर्ड|ওটিপি|পিন|পাসওয়ার্ড"),
        "disclose": anyof(words("share", "send", "tell", "give", "enter", "submit", "batao", "bolun"), scopes.PASSIVE,
                          "बताएं|बताओ|भेजें|জানান|বলুন|পাঠান"),
        "remote": "(?i)anydesk|teamviewer|remote access|screen shar",
        "account": anyof(words("account", "kyc", "card"), "खाता|অ্যাকাউন্ট"),
        "restrict": anyof("(?i)block|suspend|freez|deactivat", "बंद|ব্লক|বন্ধ"),
        "reach": anyof("(?i)https?://", words("link", "click", "call"), "लिंक|লিঙ্ক"),
        "official": anyof("(?i)police|customs|court|officer|inspector|tax department", "पुलिस|পুলিশ"),
        "legal": anyof("(?i)arrest|warrant|jail|legal action|court case", "गिरफ्तार|গ্রেফতার"),
        "security": anyof("(?i)stock|token|coin|crypto|shares", "शेयर|শেয়ার"),
        "collective": anyof("(?i)everyone|together|all of us|whole group|milkar|sobai", "मिलकर|সবাই"),
        "raise": anyof("(?i)(?:push|pump|drive|take) (?:the )?price|price up", "भाव बढ़|দাম বাড়"),
        "certain": anyof("(?i)guarantee|assured|risk.?free|no loss|pakka|nischit|sure shot", "गारंटी|পাক্কা|নিশ্চিত"),
        "gain": anyof("(?i)profit|return|gain|income|munafa|labh", "रिटर्न|मुनाफ|লাভ"),
        "deadline": anyof("(?i)ends today|today only|last chance|hurry|before midnight|expires|closes", "आज ही|আজই"),
        "registered": anyof("(?i)sebi registered|licen[sc]ed by|registered adviser", "पंजीकृत|নিবন্ধিত"),
        "bonus": anyof(words("bonus", "cashback", "offer", "referral"), "इनाम|অফার"),
        "unit": anyof(words("nav"), "(?i)low unit price"),
        "call": "(?i)buy call|sell call|target price|sure shot|multibagger",
        "inside": "(?i)insider|unpublished|inside information|leaked result",
        "endorse": anyof("(?i)(?:endorsed|backed|recommended|approved) by (?:the )?(?:minister|prime minister|rbi|sebi|famous)",
                         "मंत्री|মন্ত্রী"),
        "every": anyof(words("daily", "weekly", "monthly", "protidin", "per day", "per month"), "मासिक|প্রতিদিন|মাসিক"),
        "channel": "(?i)telegram|whatsapp group|apk|special allotment|allotment quota",
        "venue": "(?i)dabba|off.?market trade|without demat|private exchange",
        "crowd": "(?i)screenshot|members joined|happy members|testimonial",
        "hush": anyof("(?i)keep it secret|do not tell|tell no one|confidential", "किसी को मत|কাউকে বলবেন না"),
        "debt": anyof("(?i)borrow|take a loan|credit card", "उधार|कर्ज|ঋণ"),
        "invest": anyof("(?i)invest", "निवेश|বিনিয়োগ"),
        "shame": anyof("(?i)shame|humiliat|expose you|your photos|defame", "बदनाम|বদনাম"),
        "otherwise": anyof(words("or", "otherwise", "unless", "warna", "nahole"), "वरना|নইলে"),
        "ordinary_cost": anyof("(?i)college|school|course|instalment|tuition|bill", "स्कूल|স্কুল"),
        "offer": anyof(words("our", "we", "join", "amader", "hamari"), "हमारी|हमारे|আমাদের"),
        "own_money": anyof("(?i)paisa|money|rs [0-9]", "पैसा|টাকা"),
    }.items()
}


class Rule(NamedTuple):
    rule_id: str
    severity: str
    family: str
    is_action: bool
    is_scoped: bool
    concept_id: str
    source_ids: tuple[str, ...]
    cue: tuple[str, ...]
    cue_not: tuple[str, ...]
    ask: tuple[str, ...]


# The identifiers, severities, families, action and scope flags.
RULES: list[Rule] = [
    Rule("abusive-pressure", "attention", "abusive-pressure", True, True, "risk", ("lender-conduct",), ("shame", "otherwise"), (), ("pay",)),
    Rule("credentials", "attention", "credentials", True, True, "risk", ("bank-safety",), ("secret",), (), ("disclose",)),
    Rule("account-threat", "attention", "account-threat", False, True, "risk", ("bank-safety",), ("account", "restrict"), (), ("reach",)),
    Rule("authority-threat", "attention", "authority-threat", True, True, "risk", ("police-notice",), ("official", "legal"), (), ("pay",)),
    Rule("release-fee", "attention", "fee-demand", True, True, "fees", ("bank-safety", "prize-notice"), ("pay", "release"), ("ordinary_cost",), ("pay",)),
    Rule("off-exchange", "attention", "off-exchange", False, False, "risk", ("market-notice",), ("venue",), (), ()),
    Rule("coordinated-pump", "attention", "coordinated-pump", True, True, "volatility", ("market-notice",), ("collective", "raise"), (), ("security",)),
    Rule("guarantee", "attention", "return-promise", False, True, "risk", ("investor-basics",), ("certain", "gain"), (), ("certain",)),
    Rule("urgency", "attention", "urgency", False, False, "risk", ("investor-basics",), ("deadline",), (), ()),
    Rule("registration", "context", "registration", False, False, "risk", ("adviser-register",), ("registered",), (), ()),
    Rule("outsized", "attention", "return-promise", False, False, "compounding", ("investor-basics",), (), (), ()),
    Rule("promotion", "context", "promotion", False, False, "fees", ("investor-basics",), ("bonus",), (), ()),
    Rule("nav", "context", "nav", False, False, "nav", ("fund-basics",), ("unit",), (), ()),
    Rule("tip", "attention", "tip", False, False, "risk", ("market-notice", "adviser-register"), ("call",), (), ()),
    Rule("insider", "attention", "insider", False, False, "risk", ("market-notice",), ("inside",), (), ()),
    Rule("impersonation", "attention", "impersonation", True, False, "risk", ("police-notice",), ("endorse",), (), ()),
    Rule("periodic", "attention", "return-promise", False, False, "compounding", ("investor-basics",), ("every", "gain"), (), ()),
    Rule("pay-to-earn", "attention", "fee-demand", True, True, "fees", ("job-notice",), ("fee", "earn"), ("ordinary_cost",), ("pay",)),
    Rule("off-platform", "attention", "off-platform", False, False, "risk", ("market-notice",), ("channel",), (), ()),
    Rule("social-proof", "context", "social-proof", False, False, "risk", ("investor-basics",), ("crowd",), (), ()),
    Rule("secrecy", "attention", "secrecy", False, False, "risk", ("market-notice",), ("hush",), (), ()),
    Rule("borrow", "attention", "borrow", False, True, "volatility", ("lender-conduct",), ("debt", "invest"), (), ("invest",)),
]
RULE_COLUMNS = "rule_id, severity, family, is_action, is_scoped, concept_id, source_ids"
RULE_SOURCE_COLUMNS = "rule_id, source_ids"

# Whole-message context gates; only the two unscoped families use one.
CONTEXT_GATES: dict[str, str] = {
    "impersonation": ATOMS["invest"] + "|" + ATOMS["gain"] + "|" + ATOMS["pay"],
    "secrecy": ATOMS["gain"] + "|" + ATOMS["security"] + "|" + ATOMS["invest"],
}

# A caution cancels a cue in its own clause unless a switch back to a live offer or an exception for the asker follows.
CAUTION_COLUMNS = "rule_id, caution_no, kind, pattern, unless_pattern"
CAUTIONS = [
    (rule, number, kind, _n(pattern), scopes.ENDS)
    for number, (rule, kind, pattern) in enumerate(
        [
            ("*", "negated", scopes.NEGATED),
            ("*", "reported", scopes.REPORTED),
            ("*", "conditional", scopes.CONDITIONAL),
            ("*", "past", scopes.PAST),
            ("*", "taught", scopes.TAUGHT),
            ("guarantee", "unsure", scopes.UNSURE),
            ("outsized", "unsure", scopes.UNSURE),
            ("periodic", "unsure", scopes.UNSURE),
            ("tip", "not proof", "(?i)not proof of"),
            ("credentials", "warning", "(?i)^ ?(?:warning|caution|beware)"),
            ("urgency", "warning", "(?i)^ ?(?:warning|caution|beware)"),
        ]
    )
]

# Adjacent clauses joined when the first and the next carry these atoms.
CONTINUATION_COLUMNS = "name, first, then, looks_back"
CONTINUATIONS: list[tuple[str, tuple[str, ...], tuple[str, ...], bool]] = [
    ("release-payment", ("release",), ("pay", "fee"), False),
    ("payment-earning", ("fee", "pay"), ("earn",), False),
    ("offer-payment", ("earn",), ("fee", "pay"), False),
    ("account-restriction", ("account", "restrict"), ("reach",), True),
    ("coordinated-trading", ("collective", "security"), ("raise",), False),
    ("coercive-payment", ("official",), ("legal", "pay"), False),
]
NEIGHBOUR_LIMIT = 300

# Ordinary contexts: exempt when the positive wording occurs without the override.
EXEMPTIONS = [
    (name, _n("(?i)" + turns.either(usual)), _n("(?i)" + turns.either(override))) for name, (usual, override) in turns.EVERYDAY.items()
]

# Purpose wording and the rules that make a message promotional.
PROMOTIONAL_RULES = ("promotion", "urgency", "tip", "pay-to-earn", "social-proof")
EXPLANATORY = _n(anyof("(?i)means|refers to|understand|for example|is an example|lesson|explains", "समझें|मतलब|বুঝুন|মানে"))

# Concept matchers in their fixed order; `risk` is the default.
CONCEPTS = list(turns.CONCEPTS.items())
DEFAULT_CONCEPT = "risk"
CONCEPT_LIMIT = 3

# Wording that addresses a reviewer or tries to change instructions: eight kinds.
INSTRUCTION_LIKE = [_n(pattern) for pattern in turns.INSTRUCTION_LIKE.values()]

# Verbs that ask the reader to act.
READER_ASK = _n(anyof(words(turns.either(*turns.ASKED.values())), turns.either(turns.ASKED_OTHER)))

# Scripts outside the supported set.
OTHER_SCRIPTS = ("Tamil", "Telugu", "Kannada", "Malayalam", "Gujarati", "Gurmukhi", "Oriya")
