"""Sources, guidance cards, lessons and contrast pairs (authored reference data)."""

from __future__ import annotations

SOURCE_COLUMNS = "source_id, publisher, title, url, reviewed_at"
SOURCES = [
    ("bank-safety", "Central bank", "Safe digital banking", "https://bank.example.org/safety", "2026-03-01"),
    ("lender-conduct", "Central bank", "Conduct of recovery agents", "https://bank.example.org/conduct", "2026-03-01"),
    ("police-notice", "Police", "Calls that claim to be official", "https://police.example.org/calls", "2026-02-10"),
    ("market-notice", "Market regulator", "Unofficial trading venues", "https://market.example.org/venues", "2026-01-15"),
    ("investor-basics", "Market regulator", "Returns and risk", "https://market.example.org/basics", "2026-01-15"),
    ("adviser-register", "Market regulator", "Register of advisers", "https://market.example.org/register", "2026-01-15"),
    ("fund-basics", "Market regulator", "Fund units", "https://market.example.org/funds", "2026-01-15"),
    ("job-notice", "Labour office", "Paying to get work", "https://work.example.org/notice", "2026-02-20"),
    ("prize-notice", "Consumer office", "Prizes and parcels", "https://consumer.example.org/prizes", "2026-02-20"),
    ("archive", "Consumer office", "Older notices", "https://consumer.example.org/archive", "2024-02-20"),
]

CARD_COLUMNS = "card_id, source_id, category_ids, title, passage, aliases"
CARDS = [
    ("card-advance-fee", "prize-notice", ("release-fee", "pay-to-earn"), "Fees before a payout",
     "A request to pay a release fee before money or a prize is paid out deserves a pause. Genuine payouts deduct costs.",
     "withdrawal unlock balance prize registration शुल्क निकासी इनाम"),
    ("card-otp", "bank-safety", ("credentials",), "Codes are yours alone",
     "A one time password, PIN or card number authorises payments. Bank staff do not ask customers to share an OTP.",
     "otp pin password kyc agent ओटीपी ওটিপি"),
    ("card-account", "bank-safety", ("account-threat", "credentials"), "Links about blocked accounts",
     "Messages that an account will be blocked unless a link is opened should be checked inside the official app.",
     "blocked link verify account खाता অ্যাকাউন্ট"),
    ("card-recovery", "lender-conduct", ("abusive-pressure", "borrow"), "Pressure during loan recovery",
     "Recovery agents may not threaten, shame or contact family members to collect a loan payment.",
     "shame photos family threaten loan"),
    ("card-borrow", "lender-conduct", ("borrow",), "Borrowing to invest",
     "A loan taken to invest multiplies a loss because interest is owed whatever the market does.",
     "loan borrow invest interest cost"),
    ("card-official", "police-notice", ("authority-threat", "impersonation"), "Calls that claim an arrest",
     "No police officer settles a warrant by a transfer over the phone. End the call and ring the station.",
     "police warrant arrest transfer officer"),
    ("card-endorse", "police-notice", ("impersonation",), "Borrowed names",
     "Pictures of a minister or a famous person are often used without consent to sell schemes.",
     "minister famous endorsed"),
    ("card-venue", "market-notice", ("off-exchange", "off-platform"), "Trading outside an exchange",
     "Trades through a Telegram group or private app leave no protection. A special allotment quota is a common lure.",
     "telegram app allotment quota dabba"),
    ("card-pump", "market-notice", ("coordinated-pump", "tip"), "Buying together",
     "When a group buys a token together to push the price, late buyers carry the loss when others sell.",
     "group token price push sell buyers together"),
    ("card-tip", "market-notice", ("tip", "insider", "secrecy"), "Calls, targets and secrets",
     "A buy call with a target price or insider news to keep secret is not advice from a registered adviser.",
     "buy call target price sure shot insider secret stock"),
    ("card-guarantee", "investor-basics", ("guarantee", "periodic", "outsized"), "Promised returns",
     "No plan can promise a guaranteed profit every month. Higher returns carry higher risk of loss.",
     "guaranteed profit monthly return गारंटी रिटर्न নিশ্চিত লাভ pakka munafa labh nischit"),
    ("card-compound", "investor-basics", ("outsized",), "How growth compounds",
     "Doubling money within days implies a yearly rate no deposit pays. Work out the yearly rate before you invest.",
     "double days triple scheme deposit compounding"),
    ("card-urgency", "investor-basics", ("urgency", "promotion"), "Deadlines that rush you",
     "An offer that ends today rushes a decision. A sound plan is still there tomorrow.",
     "offer ends today midnight closes hurry"),
    ("card-crowd", "investor-basics", ("social-proof",), "Screenshots prove little",
     "Screenshots of happy members can be made up. Ask for audited figures.",
     "screenshots members happy"),
    ("card-register", "adviser-register", ("registration", "tip"), "Check the register",
     "Anyone who says they are registered can be looked up by name and number in the public register.",
     "sebi registered adviser number"),
    ("card-unit", "fund-basics", ("nav",), "Unit price is not cheapness",
     "A low unit value of a fund says nothing about future growth.",
     "nav unit low cheap fund"),
    ("card-task", "job-notice", ("pay-to-earn",), "Paid tasks that ask for money",
     "A job that asks you to pay a registration fee to earn per task usually pays only the organiser.",
     "earn task home registration fee unlock paid"),
    ("card-class", "job-notice", ("promotion",), "Lessons and safety classes",
     "Quoted examples in a safety class or lesson explain a risk; they do not ask you to act.",
     "quote lesson class example never follow"),
]

LESSON_COLUMNS = "ord, lesson_id, lesson_group, title, body"
LESSONS = [
    (1, "risk", "money", "Risk and return", "Every return carries risk. Understand how much you could lose."),
    (2, "diversification", "money", "Many baskets", "Spread money over a basket of holdings."),
    (3, "volatility", "money", "Ups and downs", "Prices fluctuate; a crash can follow a rise."),
    (4, "compounding", "money", "Growth on growth", "Compound growth is slow at first."),
    (5, "fees", "money", "What it costs", "A small yearly charge or fee adds up."),
    (6, "nav", "money", "Unit value", "What NAV tells you and what it does not."),
    (7, "nomination", "money", "Naming a nominee", "Who receives the money."),
    (8, "digital-arrest", "scams", "Arrest over the phone", "No officer arrests by video call."),
    (9, "kyc-update", "scams", "Update your details", "Links that ask for account details."),
    (10, "upi-pin", "scams", "Your PIN", "A PIN sends money; it never receives it."),
    (11, "task-jobs", "scams", "Paid tasks", "Jobs that ask you to pay first."),
    (12, "trading-apps", "scams", "Unofficial apps", "Apps outside the exchange."),
    (13, "advance-fees", "scams", "Fees first", "Pay now, receive later."),
    (14, "online-friend", "scams", "A new friend", "Friendship that turns to money."),
    (15, "after-fraud", "scams", "After a fraud", "Report soon and keep records."),
]

TRANSLATION_COLUMNS = "lesson_id, step, lang"
TRANSLATIONS = [
    (lesson[1], step, lang)
    for lesson in LESSONS
    for step in (1, 2)
    for lang in ("en", "hi", "bn")
    # One known gap, so that the completeness audit has something to report.
    if not (lesson[1] == "after-fraud" and step == 2 and lang == "bn")
]

PAIR_COLUMNS = "pair_id, language, category_ids, source_ids, terms, positive, caution, provenance"
CONTRAST_PAIRS = [
    ("pair-advance-en", "en", ("release-fee",), ("prize-notice",), ("pay", "release", "fee", "unlock", "prize"),
     "Pay the fee to release your prize.", "Never pay a fee to release a prize.", "authored"),
    ("pair-otp-en", "en", ("credentials",), ("bank-safety",), ("otp", "share", "agent", "pin"),
     "Share the OTP with our agent.", "Do not share your OTP.", "authored"),
    ("pair-otp-hi", "hi", ("credentials",), ("bank-safety",), ("ओटीपी", "खाता"),
     "ओटीपी बताएं।", "ओटीपी न बताएं।", "authored"),
    ("pair-otp-bn", "bn", ("credentials",), ("bank-safety",), ("ওটিপি", "অ্যাকাউন্ট"),
     "ওটিপি জানান।", "ওটিপি জানাবেন না।", "authored"),
    ("pair-account-en", "en", ("account-threat",), ("bank-safety",), ("account", "blocked", "link", "click"),
     "Click the link or the account is blocked.", "The bank blocked fake links.", "authored"),
    ("pair-guarantee-en", "en", ("guarantee",), ("investor-basics",), ("guaranteed", "profit", "monthly", "plan"),
     "Guaranteed profit monthly.", "No plan is guaranteed.", "authored"),
    ("pair-guarantee-hi", "hi", ("guarantee",), ("investor-basics",), ("गारंटी", "रिटर्न", "योजना"),
     "रिटर्न की गारंटी है।", "गारंटी नहीं है।", "authored"),
    ("pair-guarantee-bn", "bn", ("guarantee",), ("investor-basics",), ("লাভ", "নিশ্চিত"),
     "লাভ নিশ্চিত।", "লাভ নিশ্চিত নয়।", "authored"),
    ("pair-guarantee-hi-latn", "hi-Latn", ("guarantee",), ("investor-basics",), ("pakka", "munafa", "double"),
     "Pakka munafa.", "Pakka munafa nahi.", "authored"),
    ("pair-guarantee-bn-latn", "bn-Latn", ("guarantee",), ("investor-basics",), ("nischit", "labh"),
     "Nischit labh.", "Labh nischit noy.", "authored"),
    ("pair-police-en", "en", ("authority-threat",), ("police-notice",), ("police", "warrant", "arrest", "transfer"),
     "Transfer money or be arrested.", "Police do not take transfers.", "authored"),
    ("pair-pump-en", "en", ("coordinated-pump", "tip"), ("market-notice",), ("group", "token", "price", "sell"),
     "Buy together and push the price.", "Group buying of rice is ordinary.", "authored"),
    ("pair-task-en", "en", ("pay-to-earn",), ("job-notice", "prize-notice"), ("earn", "task", "registration", "fee"),
     "Pay to earn per task.", "A course charges a fee.", "authored"),
    ("pair-borrow-en", "en", ("borrow",), ("lender-conduct",), ("loan", "invest", "interest"),
     "Take a loan and invest.", "Do not borrow to invest.", "authored"),
    ("pair-shame-en", "en", ("abusive-pressure",), ("lender-conduct",), ("shame", "photos", "family", "pay"),
     "Pay or we shame you.", "The payment is due on Monday.", "authored"),
]

# Only these host families may be cited.
ALLOWED_HOST = r"^(?:[a-z0-9-]+\.)*example\.(?:org|net)$"
