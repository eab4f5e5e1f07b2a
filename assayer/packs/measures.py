"""Words of time, money and growth as tables, and the patterns built from them.

A table row is (meaning, language, words). A word ending in ``*`` is the
beginning of a word; other Latin words are whole; words of other scripts match
wherever they stand, as their endings are written on.
"""

from __future__ import annotations

import re
from unicodedata import normalize

from assayer.core.regex import anyof

Table = list[tuple[str, str, str]]


def _longest_first(lists: tuple[str, ...]) -> list[str]:
    return sorted({normalize("NFKC", w.strip()) for words in lists for w in words.split(",") if w.strip()}, key=lambda w: (-len(w), w))


def alternatives(*lists: str) -> str:
    """One pattern for the words of several comma-separated lists, longest first."""
    found = _longest_first(lists)
    latin = [w for w in found if w.isascii()]
    stems = "|".join(re.escape(w[:-1]).replace("\\ ", r"\s+") for w in latin if w.endswith("*"))
    whole = "|".join(re.escape(w).replace("\\ ", r"\s+") for w in latin if not w.endswith("*"))
    other = "|".join(w.replace(" ", r"\s+") for w in found if not w.isascii())
    parts = [rf"\b(?:{stems})" * bool(stems), rf"\b(?:{whole})\b" * bool(whole), other]
    return "|".join(p for p in parts if p)


def attached(*lists: str, closed: bool = False) -> str:
    """The same for words that may be written on to a number, "30days"; ``closed`` words also end there."""
    found = _longest_first(lists)
    return "|".join(w.replace(" ", r"\s+") + r"\b" * (w.isascii() and (closed or len(w) == 1)) for w in found)


def rows(table: Table, *meanings: str) -> list[str]:
    return [words for meaning, _, words in table if not meanings or meaning in meanings]


def of(table: Table, *meanings: str) -> str:
    """``alternatives`` of the rows with these meanings, all rows without any."""
    return alternatives(*rows(table, *meanings))


# Days per unit.
DAYS = {"hour": 1 / 24, "day": 1.0, "week": 7.0, "month": 365 / 12, "year": 365.0}

# What is counted: "30 days".
COUNTED: Table = [
    ("hour", "en", "hour, hours, hrs"), ("hour", "hi", "घंटा, घंटे, घंटों"), ("hour", "bn", "ঘণ্টা, ঘন্টা"), ("hour", "hi-Latn", "ghanta, ghante"),
    ("hour", "bn-Latn", "ghonta"),
    ("day", "en", "day, days"), ("day", "hi", "दिन, दिनों"), ("day", "bn", "দিন, দিনে"), ("day", "hi-Latn", "din, dino"), ("day", "bn-Latn", "dine"),
    ("week", "en", "week, weeks, wks"), ("week", "hi", "सप्ताह, हफ्ते, हफ्तों"), ("week", "bn", "সপ্তাহ"), ("week", "hi-Latn", "hafte, saptah"),
    ("week", "bn-Latn", "soptaho"),
    ("month", "en", "month, months"), ("month", "hi", "माह, महीने, महीनों"), ("month", "bn", "মাস, মাসে"), ("month", "hi-Latn", "mahine, mahino"),
    ("month", "bn-Latn", "mase, mash"),
    ("year", "en", "year, years, yrs"), ("year", "hi", "साल, सालों, वर्ष"), ("year", "bn", "বছর, বছরে"), ("year", "hi-Latn", "saal"),
    ("year", "bn-Latn", "bochor, bochore"),
]
# What comes back by itself, or comes soon: "weekly", "overnight".
REPEATED: Table = [
    ("day", "en", "daily, overnight, tomorrow"), ("day", "hi", "रोज, रोज़, दैनिक, प्रतिदिन"), ("day", "bn", "রোজ, দৈনিক, প্রতিদিন"),
    ("day", "hi-Latn", "roz, rozana, pratidin"), ("day", "bn-Latn", "roj, protidin"),
    ("week", "en", "weekly"), ("week", "hi", "साप्ताहिक"), ("week", "bn", "সাপ্তাহিক"),
    ("month", "en", "monthly"), ("month", "hi", "मासिक"), ("month", "bn", "মাসিক"), ("month", "bn-Latn", "masik"),
    ("year", "en", "annual, annually, yearly, per annum"), ("year", "hi", "वार्षिक, सालाना"), ("year", "bn", "বার্ষিক"),
]
# What makes a counted unit come back: "per week".
EACH: Table = [("each", "en", "per, each, every, a"), ("each", "hi", "हर, प्रति"), ("each", "bn", "প্রতি"), ("each", "hi-Latn", "har, prati")]

# Factors of number words.
FACTORS = {"hundred": 1e2, "thousand": 1e3, "lakh": 1e5, "million": 1e6, "crore": 1e7}
SCALE: Table = [
    ("hundred", "en", "hundred"), ("hundred", "hi", "सौ"), ("hundred", "bn", "শত"),
    ("thousand", "en", "k, thousand"), ("thousand", "hi", "हजार, हज़ार"), ("thousand", "bn", "হাজার"), ("thousand", "hi-Latn", "hazaar, hazar"),
    ("thousand", "bn-Latn", "hajar"),
    ("lakh", "en", "lac, lakh"), ("lakh", "hi", "लाख"), ("lakh", "bn", "লক্ষ, লাখ"),
    ("million", "en", "million"),
    ("crore", "en", "crore"), ("crore", "hi", "करोड़"), ("crore", "bn", "কোটি"), ("crore", "bn-Latn", "koti"),
]
# How an amount of money is marked, before or after the number.
DOLLAR_BEFORE = r"\$"
RUPEE_AFTER: Table = [("INR", "en", "inr, rupee, rupees"), ("INR", "hi", "रुपए, रुपया, रुपये"), ("INR", "hi-Latn", "rupaye")]
NAMED_AFTER: Table = [("named", "en", "btc, eth, usdc, usdt"), ("named", "bn", "টাকা"), ("named", "bn-Latn", "taka")]

# How much a growth word multiplies by; "5x" says it itself.
GROWTH: Table = [
    ("2", "en", "doubl*, twofold"), ("2", "hi", "दुगना, दुगुना, दोगुना"), ("2", "bn", "দ্বিগুণ, দুইগুণ"),
    ("3", "en", "threefold, trebl*, tripl*"), ("3", "hi", "तिगुना"), ("3", "bn", "তিনগুণ"),
]
TIMES: Table = [("times", "hi", "गुना, गुने"), ("times", "bn", "গুণ"), ("times", "hi-Latn", "guna, gune")]

# What a sentence speaks about.
TOPIC: Table = [
    ("invest", "en", "money, capital, savings, portfolio*, plan, plans, scheme*, deposit*, invest*, stock*, trading, trader*, coin*, crypto*, token*"),
    ("invest", "hi", "पैसा, पैसे, पूंजी, योजना, निवेश"), ("invest", "bn", "টাকা, পুঁজি, স্কিম, বিনিয়োগ"),
    ("invest", "hi-Latn", "paisa, paise, nivesh"), ("invest", "bn-Latn", "taka, biniyog"),
    ("gain", "en", "profit*, income*, earn*, yield*, dividend*, payout*, return*, gain*, grow, grows, grew, interest"),
    ("gain", "hi", "मुनाफ, कमाई, आमदनी, रिटर्न, लाभ"), ("gain", "bn", "মুনাফা, লাভ, রিটার্ন"),
    ("gain", "hi-Latn", "munafa, fayda, kamai"), ("gain", "bn-Latn", "munafa, labh"),
    ("promised", "en", "certain, sure, assured, fixed, promise*, guarantee*, pays, we pay, will pay, earn*, receive*"),
    ("promised", "hi", "गारंटी, पक्का, निश्चित, मिलेगा, मिलेंगे"), ("promised", "bn", "গ্যারান্টি, নিশ্চিত, পাবেন"),
    ("promised", "hi-Latn", "guarantee, pakka, kamao, milega"), ("promised", "bn-Latn", "nischit, paben"),
    ("wage", "en", "salary, salaries, wage, wages, stipend*, payroll, pension*, rent"), ("wage", "hi", "तनख्वाह, वेतन, पेंशन, किराया"),
    ("wage", "bn", "বেতন, পেনশন, ভাড়া"),
    ("spending", "en", "spend*, expense*, cost*, budget*, bill, bills, fee, fees, premium*, tax*"), ("spending", "hi", "खर्च, फीस, बिल"),
    ("spending", "bn", "খরচ, বিল"),
    ("made", "en", "made, earned, grown, turned into"), ("made", "hi", "कमाया, कमाए, बना"),
]
# Percentages that are no return.
OTHER_SHARE: Table = [
    ("price", "en", "discount*, off, cashback, rebate*"), ("price", "hi", "छूट, रियायत"), ("price", "bn", "ছাড়"),
    ("levy", "en", "tax*, vat, gst, cess, duty, exit load"), ("levy", "hi", "टैक्स, शुल्क"), ("levy", "bn", "ট্যাক্স, শুল্ক, চার্জ"),
    ("spending", "en", "expense*, brokerage, fee, fees"), ("spending", "hi", "खर्च"), ("spending", "bn", "খরচ"),
    ("measure", "en", "accura*, attendance, battery, capacity, humidity, marks, score*, turnout, vote*"),
]
# What a bare number word may count instead of money, and what says that it is money.
COUNT_OF = (
    "people, person*, member*, customer*, follower*, student*, item*, piece*, order*, seat*, vote*, view*, "
    "kg, km, litre*, hour*, day*, week*, month*, year*"
)
GIVES_BEFORE = "put in, invest, deposit, transfer, send, pay, pays, collect, receive, get, win, earn, withdraw"
GIVES_AFTER = (
    "per, each, every, profit*, return*, assured, guarantee*, invest*, deposit*, bhejo, jama, lagao, milega, paben, "
    "जमा, भेजें, मिले, लगाओ, জমা, পাঠান, পাবেন, নিশ্চিত"
)
# Debts and their price; a firm and its figures.
DEBT = "loan*, borrow*, mortgage*, overdraft*, credit card*, debt*, उधार, कर्ज, लोन, ঋণ"
PRICE_OF_DEBT = "rate*, interest, charg*, penalt*, cost*, ब्याज, सूद, সুদ"
FIRM = "company, companies, corporation, startup, factory, business"
FIRM_FIGURE, FIRM_MOVE = "sales, revenue*, turnover, net profit, quarterly profit, exports", "climbed, fell, grew, rose, dropped, increase*"
RETURN_OWN = "payout*, return, returns, yield*, roi, मुनाफ, रिटर्न, মুনাফা, রিটার্ন"
PUTS_IN, GETS_OUT = "put in, invest*, deposit*", "withdraw*, receive*, get, gets, earn*, profit*"
MONTHLY = "every month, each month, per month, monthly, har mahine, प्रति माह, हर महीने, প্রতি মাসে"
PAYS_IN = "save, saves, deposit*, pay, pays, contribut*, jama, जमा, জমা"
TURN = "and, but, then, while, whereas, although, lekin, jabki, kintu, और, लेकिन, जबकि, আর, কিন্তু, যদিও"
EXPLAINS = "meaning, which means, in other words, the same as, equal to, matlab, यानी, मतलब, অর্থাৎ, মানে"
# Characters over which two words still belong together.
REACH = 40


def near(first: str, second: str) -> str:
    """A word of the first list and one of the second, at most ``REACH`` characters later."""
    return rf"(?:{alternatives(first)}).{{0,{REACH}}}(?:{alternatives(second)})"


NUMBER = r"[0-9][0-9,]*(?:\.[0-9]+)?"
DECIMAL = r"[0-9]+(?:\.[0-9]+)?"


def unit_pattern(unit: str) -> str:
    """Any word of a unit inside a matched period."""
    return "(?i)" + attached(*rows(COUNTED, unit), *rows(REPEATED, unit))


QUANTIFIED = rf"(?i){DECIMAL}\s*(?:{attached(*rows(COUNTED))})"
RECURRING = rf"(?i)(?:{of(REPEATED)})|(?:{of(EACH)})\s*(?:{attached(*rows(COUNTED))})"
PERCENT = rf"{DECIMAL}\s*%"
NOT_A_RETURN = "(?i)" + of(OTHER_SHARE)
UNIT = rf"(?:{attached(*rows(SCALE))})"
_BEFORE = rf"(?:₹|{DOLLAR_BEFORE}|\b(?:rs\.?|inr))"
_AFTER = attached(*rows(RUPEE_AFTER), *rows(NAMED_AFTER), closed=True)
AMOUNT = rf"(?i){_BEFORE}\s*{NUMBER}(?:\s*{UNIT})?|{NUMBER}(?:\s*{UNIT})?\s*(?:{_AFTER})|\b{NUMBER}\s*{UNIT}"
UNIT_OF_AMOUNT = rf"(?i)[0-9]\s*({UNIT})"
SCALES = [("(?i)" + attached(*rows(SCALE, name)), factor) for name, factor in FACTORS.items()]
RUPEES = rf"(?i)^(?:₹|rs|inr)|(?:{attached(*rows(RUPEE_AFTER))})$"
NAMED = rf"(?i)({attached(*rows(NAMED_AFTER))})$"
OTHER_COUNT = rf"(?i)^\s*(?:{alternatives(COUNT_OF)})"
CUE_BEFORE = rf"(?i)(?:{alternatives(GIVES_BEFORE)})[^.!?;]{{0,{REACH}}}$"
CUE_AFTER = rf"(?i)^\s*(?:{alternatives(GIVES_AFTER)})"
MULTIPLIER = rf"(?i)\b{DECIMAL}\s*[x×]\b|\b{DECIMAL}\s*(?:{attached(*rows(TIMES))})|{of(GROWTH)}"
THREEFOLD = "(?i)" + of(GROWTH, "3")
INVESTMENT = "(?i)" + of(TOPIC, "invest", "gain")
PAYOUT = "(?i)" + of(TOPIC, "promised")
WAGES = "(?i)" + of(TOPIC, "wage", "spending")
MADE = "(?i)" + of(TOPIC, "made")
CONTRIBUTION = "(?i)" + near(MONTHLY, PAYS_IN)
PART = rf"(?i)([;—]|,\s+|{alternatives(TURN)})"
OWN_RETURN = "(?i)" + anyof(alternatives(RETURN_OWN), near(PUTS_IN, GETS_OUT))
COST = "(?i)" + anyof(near(DEBT, PRICE_OF_DEBT), near(PRICE_OF_DEBT, DEBT))
BUSINESS = "(?i)" + anyof(near(FIRM, FIRM_FIGURE), near(FIRM_FIGURE, FIRM_MOVE))
CARRIES_ON = rf"(?i)^\s*(?:{alternatives(EXPLAINS)})"
# A unit is read from the most telling word; a day where no other unit is named.
UNIT_DAYS = [(unit_pattern(unit), DAYS[unit]) for unit in ("hour", "year", "month", "week")]
