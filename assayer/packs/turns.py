"""Words that turn a sentence, start a request, frame a quote or address a reviewer, as lists by language."""

from __future__ import annotations


def either(*lists: str) -> str:
    return "|".join(w.strip() for words in lists for w in words.split(",") if w.strip())


def phrase(*steps: str) -> str:
    """One word of each list, in this order, the last one whole."""
    return "(?i)" + " ".join(f"(?:{either(step)})" for step in steps) + "(?:$|[^a-z])"


def within(first: str, second: str, between: int) -> str:
    """A word of the first list and, at most ``between`` words later in its sentence, one of the second."""
    return (
        rf"(?i)(?:^|[^a-z])(?:{either(first)})(?:[^a-z.!?]+[a-z]+){{0,{between}}}[^a-z.!?]+(?:{either(second)})(?:$|[^a-z])"
    )


# What opens a new thought after a comma or on its own.
CONTRAST = {"en": "but, instead", "hi": "लेकिन, बल्कि", "bn": "কিন্তু, বরং", "hi-Latn": "lekin, balki", "bn-Latn": "kintu, borong"}
SEQUEL = {"en": "and, then, so", "hi": "और, इसलिए", "bn": "আর, তাই", "hi-Latn": "aur, isliye", "bn-Latn": "tai"}
# Who offers or asks: the speaker. Words of other scripts carry their endings.
SPEAKER = {
    "en": "we, our, i, my",
    "hi": "हम, मैं, मेर",
    "bn": "আমরা, আমাদের, আমি, আমার",
    "hi-Latn": "hum, humko, hamari, hamare, mere",
    "bn-Latn": "amra, amader, ami",
}
# What the reader is told to do.
TOLD = "pay, send, share, deposit, buy, open, install, click, call, reply, put"
POLITE = "please, kindly, just, now"

CONJUNCTION = rf"(?:,\s*|\s+(?:{either(*CONTRAST.values(), *SEQUEL.values())})\s+)"
NEW_REQUEST = (
    rf"(?:(?:(?:{either(POLITE)}) )?(?:{either(SPEAKER['en'], TOLD)}) "
    rf"|(?:{either(SPEAKER['hi'], SPEAKER['bn'])})|(?:{either(SPEAKER['hi-Latn'], SPEAKER['bn-Latn'])}) )"
)
# A caution ends where the text turns back to a live offer.
SWITCH = phrase(either(*CONTRAST.values()).replace("|", ","), ",".join([POLITE, SPEAKER["en"], TOLD]))

# Quotes run to the closing mark of their kind, on one line.
QUOTE_MARKS = [('"', '"'), ("“", "”"), ("‘", "’")]
QUOTE = "|".join(f"{begin}[^{end}\n]+{end}" for begin, end in QUOTE_MARKS)
# Teaching, which an introduction or a statement about the quote speaks of.
LESSON = "(?i)" + "|".join([
    "(?:safety|security|awareness|literacy|fraud) (?:class|course|drill|guide|lesson|poster|session|talk|week)",
    "(?:fake|invented|mock|sample|scam) (?:letter|mail|message|post|sms|text)",
    either("article, handout, leaflet, teacher, textbook, workshop, worksheet, नमूना, उदाहरण, নমুনা, উদাহরণ"),
])
_ONLY = "(?: only| just| merely)?"
_SPECIMEN = "(?:quote|quotation|example|illustration|sample|specimen)"
ABOUT_QUOTE = rf"(?i)^\s*(?:is|was|serves as){_ONLY} an? (?:made.up |typical )?{_SPECIMEN}"
# What tells the reader not to act on the quote, or that it is only looked at.
TURNED_DOWN = "(?i)" + "|".join([
    "(?:never|do not|don't|must not|should not) (?:ever )?(?:act on|answer|believe|copy|follow|obey|pay|reply|send|share|treat|trust)",
    f"(?:is|was){_ONLY} an? (?:made.up |typical )?{_SPECIMEN}",
    "being (?:analysed|discussed|examined|studied)",
    "(?:quote|quoted|printed|shown) (?:at|for|in) (?:a|an|our|the) (?:safety|security|awareness|fraud)",
    "(?:विश्वास|भरोसा|पालन) (?:न|मत)|(?:বিশ্বাস|ভরসা|অনুসরণ) কর(?:বেন|ো|বে) না",
])

# Text that speaks to a reviewer instead of the reader, by what it tries.
_REVIEWER = "ai, assistant, bot, checker, classifier, language model, moderator, reviewer"
INSTRUCTION_LIKE = {
    # Set the rules aside.
    "override": within("bypass, disregard, forget, ignore, overrule", "guardrails, guideline, guidelines, instruction, instructions, policy, rule, rules", 4),
    # Name the machine's own set-up.
    "prompt": "(?i)" + either("(?:hidden|initial|system|your) prompt, system message, developer mode, developer message"),
    # Give it another part to play.
    "role": within("act as, behave like, pretend to be, pretend you are, respond as, you are now", _REVIEWER, 3),
    # Call it by name.
    "address": rf"(?i)(?:^|[^a-z])(?:attention|dear|hello|hey|note to the|to the) (?:{either(_REVIEWER)})(?:$|[^a-z])"
    rf"|(?:^|[.!?\n] ?)(?:{either(_REVIEWER)}) ?[,:]",
    # Dictate the result.
    "verdict": within("classify, declare, grade, label, mark, rank, rate, score, tag", "clean, fine, genuine, harmless, low risk, ok, safe, trusted", 4),
    # Make a result vanish.
    "removal": within("clear, delete, discard, erase, hide, omit, remove, silence, suppress", "alert, alerts, finding, findings, flag, flags, warning, warnings", 4),
    # Forge the form of a dialogue or of an answer.
    "markup": r"(?i)</? ?(?:assistant|developer|instructions|system|user) ?>|\[/?(?:inst|sys)\]|(?:only|valid) json|json (?:object|schema)",
    "hi-bn": "(?:निर्देश|नियम)[^।!?]{0,24}(?:अनदेखा|नजरअंदाज|भूल)|सुरक्षित (?:बताओ|मानो|मानें)"
    "|(?:নির্দেশ|নিয়ম)[^।!?]{0,24}(?:অমান্য|উপেক্ষা|ভুলে)|নিরাপদ (?:ধরো|ধরুন|বলুন)",
}

# Verbs that ask the reader to act, by what they are after.
ASKED = {
    "money": "pay, send, deposit, invest, buy, wire, remit, recharge, lend",
    "secret": "share, tell us, give us, enter, submit, confirm",
    "contact": "call, reply, join, ring, write to",
    "device": "click, open, install, scan, visit, log in",
    "hi-Latn": "bhejo, bhejiye, batao, daalo, kholo",
    "bn-Latn": "pathan, pathao, bolun, khulun, korun",
}
ASKED_OTHER = "भेजें, भेजो, बताएं, बताओ, जमा करें, खोलें, পাঠান, পাঠাও, জানান, বলুন, জমা দিন, খুলুন"

# Concepts of the lesson library in their fixed order, by stems that name them.
CONCEPTS = {
    "nav": "(?i)(?:^|[^a-z0-9])nav(?:$|[^a-z0-9])|net asset|unit (?:price|value)|एनएवी|এনএভি",
    "diversification": "(?i)" + either("diversif, basket, spread your money, different funds, टोकरी, विविध, বৈচিত্র"),
    "volatility": "(?i)" + either("volatil, fluctuat, ups and downs, price swing, price up, उतार, ওঠানামা"),
    "compounding": "(?i)" + either("compound, doubl, tripl, yearly rate, interest on interest, चक्रवृद्धि, दोगुन, চক্রবৃদ্ধি, দ্বিগুণ"),
    "fees": "(?i)(?:^|[^a-z])fees?(?:$|[^a-z])|" + either("commission, charges, a cost, शुल्क, फीस, চার্জ, খরচ"),
    "nomination": "(?i)" + either("nominee, nominat, legal heir, नामांकन, वारिस, নমিনি, মনোনীত"),
    "risk": "(?i)" + either("risk, guarantee, promise, a loss, lose, जोखिम, गारंटी, नुकसान, ঝুঁকি, ক্ষতি"),
}

# Everyday dealings: exempt when their words occur without those of the other list.
EVERYDAY = {
    "retail-promotion": (
        "shopping, shirt, grocery, furniture, supermarket, festive sale, खरीदारी, दुकान, কেনাকাটা, দোকান",
        "invest, deposit, crypto, token, otp, password, lottery, prize, profit, loan, निवेश, ओटीपी, বিনিয়োগ, ওটিপি",
    ),
    "bill-deadline": (
        "electricity, water bill, phone bill, premium, instalment, house rent, due date, due on, statement, बिल, किराया, किस्त, বিল, ভাড়া, কিস্তি",
        "invest, crypto, lottery, prize, profit, otp, password, warrant, निवेश, इनाम, বিনিয়োগ, পুরস্কার",
    ),
    "ordinary-fee": (
        "college, school, course, exam, hostel, library, bank loan, स्कूल, कॉलेज, কোর্স, পরীক্ষা",
        "lottery, prize, parcel, task, unlock, withdraw, इनाम, निकासी, পুরস্কার, তুলতে",
    ),
}
