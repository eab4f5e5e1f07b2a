"""What a wording of doubt governs: negation, report, condition, past and lesson bound to the words they stand with.

A negation counts where a verb of asking or acting follows it, with nothing but
adverbs and auxiliaries between: "never share" does, "never fails: pay now" does not.
A report needs who says it and that they say it, a condition a third party who asks,
the past a deed in a past form. Punctuation ends a scope. Patterns keep to the
syntax that Spark and the SQL oracle share.
"""

from __future__ import annotations

from assayer.core.regex import anyof
from assayer.packs.turns import SWITCH, TOLD, either


def chain(*steps: str) -> str:
    """Words of the lists one after the other, only spaces and quotes between; a list with ``*`` may be skipped or repeat up to three times."""
    out = ""
    for step in steps:
        if step.startswith("*"):
            out += rf"(?:(?:{either(step[1:])})[ '\"]+){{0,3}}"
        else:
            out += rf"(?:{either(step)})[ '\"]+"
    # The last word ends at whatever is no letter.
    return "(?i)(?:^|[^a-z])" + out.removesuffix(r"[ '\"]+") + "(?:$|[^a-z])"


_FILLER = "*all, also, any, at, again, agree to, be asked to, blindly, circumstances, click and, even, ever, first, have to, immediately, just, need to, please, simply, so, to, try to, under, you"
_NOT = (
    "avoid, cannot, can not, can't, decline to, did not, didn't, do not, does not, doesn't, don't, must not, mustn't, "
    "need not, never, no need to, refuse to, should not, shouldn't, will not, won't"
)
_NOBODY = "nobody, no one, no bank, no adviser, no broker, no court, no employer, no fund, no genuine [a-z]+, no officer, no real [a-z]+, no honest [a-z]+"
_MAY = "can, could, may, should, will, would"
_DEED = TOLD + (
    ", act, ask, believe, borrow, demand, disclose, enter, follow, forward, give, invest, join, need, promise, request, require, "
    "reveal, submit, tell, transfer, trust, type"
)
_DOING = ("asking, borrowing, calling, clicking, depositing, disclosing, giving, installing, investing, opening, paying, putting, "
          "replying, revealing, sending, sharing, telling, trusting")
_FORMS = _DEED + ", " + ", ".join(f"{verb.strip()}s" for verb in _DEED.split(",")) + ", " + _DOING
_DONE = "confirmed, disclosed, entered, forwarded, given, provided, sent, shared, submitted, told, typed"
_SURE = "assure, assured, certain, ensure, guarantee, guaranteed, guarantees, promise, promised"
_WHO = "advisers, bank, banks, bulletin, court, magazine, media, minister, news, newspaper, officials, police, regulator, report, reports, reporter, reporters"
_SAID = "blocked, explained, explains, quoted, reported, reports, said, say, says, told, warn, warned, warns, writes, wrote"
_THIRD = "a caller, a stranger, an agent, any caller, anybody, anyone, somebody, someone, strangers, a message, any message, they"
_WANTS = "ask, asks, claims, claim, demand, demands, insist, insists, offer, offers, promises, says, tells, threatens, want, wants"
_THEY = "he, i, she, they, the caller, the fraudster, the gang, the man, the woman, victims"
_DID = ("asked, cheated, collected, declined, deleted, demanded, had asked, had demanded, had paid, had promised, had sent, ignored, lost, "
        "promised, refused, reported, was asked, was cheated, was told, were asked, were cheated")
_TIME = "last month, last week, last year, yesterday, years ago, months ago"

NEGATED = anyof(
    chain(_NOT, _FILLER, _FORMS), chain(_NOBODY, "*" + _MAY, _FILLER, _FORMS),
    chain("cannot, can not, may not, must not, never, not to, should not", "*also, be, ever, to", _DONE),
    # Told in Hindi and Bengali the negation stands beside its verb.
    "(?:न|मत|नहीं) ?(?:बता|भेज|दें|दो|कर|मांग|माँग|ले|लें)|(?:बताएं|भेजें|करें|मांगते|मांगता|देता|देते|दे सकत[ाीे]|होती|होता) ?(?:नहीं|मत)",
    "(?:বল|পাঠা|দে|দি|কর|নে|নি|শেয়ার|চা)[ঀ-৿]* ?(?:বেন না|না |নি |না$)|বেন না|চায় না|পারে না",
    chain("mat, nahi, nahin", "*kabhi, bilkul", "bhejo, bhejna, bhejiye, batana, batao, bataiye, dena, dijiye, karo, kare, mangta, mangte, lo"),
    chain("bhejo, batao, dena, karo, mangta, mangte, deta, dete", "mat, nahi, nahin"),
    r"(?i)(?:pathaben|diben|bolben|korben|jabe|pare|chay|neben) na(?:$|[^a-z])",
)
REPORTED = anyof(
    "(?i)^ ?news ?:", chain("*the", _WHO, "*also, has, have, have now, now, today", _SAID), chain("according to", "*a, an, the, city, local", _WHO),
)
CONDITIONAL = chain("even if, if, should, when, whenever", _THIRD, "*ever, then, on the phone, on call, suddenly", _WANTS)
PAST = anyof(
    chain(_THEY, "*already, also, both, never, once, then, wisely", _DID),
    chain("we", "*already, also, both, once, then, wisely", "declined, deleted, ignored, lost, refused, reported, were asked, were cheated, were told"),
    chain("was, were", "*already, later, then", "arrested, caught, convicted, jailed, sentenced"),
    chain(_TIME, "*a, an, my, the", _THEY + ", aunt, bank, boss, brother, family, father, friend, mother, neighbour, sister, uncle"),
)
TAUGHT = "(?i)the lesson|safety class|article explains|for example|is an example"
# A certainty that is denied.
UNSURE = anyof(
    chain(_NOT + ", no, not, nothing is, without", "*a, an, any, be, is, the", _SURE),
    chain("no fund, no plan, no scheme, nobody, no one", "*can, could, will", _SURE + ", double, triple, pay, give"),
    "(?i)is not proof of|कोई भी योजना|কোনও স্কিম",
)
# Whom a refusal leaves out: it asks the reader to act after all.
EXCEPT = chain("apart from, besides, but only to, except, except to, except with, except for, other than, unless to", "*our, the, my", "agent, company, desk, helpline, manager, me, office, officer, staff, support, team, us")
#: What ends a doubt: a turn back to the offer, or an exception for the asker.
ENDS = anyof(SWITCH, EXCEPT)
# A disclosure that is asked for without naming who is to act.
PASSIVE = chain("has to, have to, is to, must, needs to, shall, should", "*also, first, now", "be", "*immediately, now", _DONE)
