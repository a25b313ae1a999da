"""Problem 8: personal information inside free text.

E-mail addresses, phone and identity numbers and street addresses have shapes of their own. Names don't, nor
have numbers in a form met nowhere else; they are found by what the corpus discloses. Of every capitalised term
it is counted over all documents how often it stands at all and how often inside a protected entity (after a
title, a label or a phrase that introduces a person), and of the words before numbers how often a phone or
identity number of a known shape follows. The information that a term gives about such an entity,
log2 P(entity | term) / P(entity), is its disclosure; terms over the threshold are name terms, wherever they
stand, and their runs are replaced, and numbers of any form are replaced behind words that disclose one. Terms
that the corpus is silent about are taken as names only directly behind an introducing phrase.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.session import cut_lineage

#: Bits of disclosure, share of a term's uses inside entities, and uses inside, that make a name term.
MIN_BITS, MIN_SHARE, MIN_USES = 1.0, 0.1, 2
#: Name terms up to which they are broadcast (some 30 MB); more are joined to the documents instead.
BROADCAST_TERMS = 300_000
_FLUSH = 200_000
POSSIBLE = 3
#: Share of uses inside entities that makes a name term whatever its bits.
SURE_SHARE = 0.5

KINDS = ("email", "phone", "identity_number", "street_address", "person_name")

_GAP = r"[ \t]*\r?\n?[ \t]*"
_UP = "A-ZÀ-ÖØ-Þ"
_LOW = "a-zß-öø-ÿ"
_TOK = rf"[{_UP}][{_LOW}’']+(?:-[{_UP}][{_LOW}]+)?"
_CITY = rf"{_TOK}(?:[ -]{_TOK})?"

# Ways to write an e-mail address.
_AT = r"(?:[@＠]|[ \t]+[@＠][ \t]+|[ \t]*[\[({<][ \t]*(?:at|AT|At)[ \t]*[\])}>][ \t]*|[ \t]+(?:at|AT)[ \t]+(?=[\w-]+[ \t]+(?:dot|DOT)[ \t]+[\w-]))"
_DOT = r"(?:\.|[ \t]*[\[({<][ \t]*(?:dot|DOT|Dot)[ \t]*[\])}>][ \t]*|[ \t]+(?:dot|DOT)[ \t]+)"
_EMAIL = re.compile(rf"(?<![\w.+-])[A-Za-z0-9][\w.+%-]*{_AT}[A-Za-z0-9][A-Za-z0-9-]*(?:{_DOT}[A-Za-z0-9][A-Za-z0-9-]*)*{_DOT}[A-Za-z]{{2,}}(?![\w-])")

# Shapes of phone numbers, by country habit, each with an optional extension.
_EXT = r"(?:[ \t]*(?:ext\.?|extn\.?|extension|x|#)[ \t]*\d{1,5})?"
_PHONE = re.compile(
    r"(?<![\w.,/-])(?<!\d[ ])(?:"
    r"\+\d{1,3}(?:[ .-]?\(\d{1,5}\))?(?:[ .-]?\d{1,6}){2,6}"
    r"|\+\d{10,14}"
    r"|00\d{2}[ -]\d{2,5}[ -]\d{4,8}(?:[ -]\d{2,4})?"
    r"|\(\d{2,5}\)[ -]?\d{3,5}[ -]?\d{3,4}"
    r"|(?:1[ .-])?\d{3}[.-]\d{3}[.-]\d{4}"
    r"|\d{3} \d{3} \d{4}"
    r"|0\d{1,2} \d{4} \d{4}"
    r"|0\d{3,4} \d{5,6}"
    r"|0\d(?: \d{2}){4}"
    r"|0\d\.\d{2}\.\d{6}|0\d(?:\.\d{2}){4}"
    r"|\d{5} \d{5}"
    r"|\d{3}-\d{4}(?=[ \t]*(?:ext|x)|[^\d-]|$)"
    rf"){_EXT}(?![\w/]|[-.]\d)"
)

# Shapes of identity numbers.
_IDENTITY = re.compile(
    r"(?<![\w./-])(?:"
    r"\d{3}-\d{2}-\d{4}|9\d{2} \d{2} \d{4}|\d{3} \d{2} \d{4}"
    r"|\d{4}-\d{4}-\d{4}|\d{4} \d{4} \d{4}|\d{12}"
    r"|\d{4}-\d{2}-\d{3}-\d{3}"
    r"|[A-Z]{1,2}\d{7}|[A-Z]{5}\d{4}[A-Z]"
    r"|EN\d{2}-[A-Z]{2,4}-\d{3,6}"
    r")(?![\w/]|[-.]\d| \d{3})"
)
_NOT_PERSONAL = re.compile(r"(?:ISBN|ISSN|DOI|host|code|Code|Course|course|DOWNLOADED FROM .*|version|release)[ \t:]*$")

# Words of street addresses.
_STREET = r"(?:Street|Road|Lane|Avenue|Crescent|Drive|Square|Close|Terrace|Way|Court|Place|Row|Nagar|Colony|Layout|Enclave|Marg|Vihar|St\.?|Rd\.?|Ln\.?|Ave\.?|Dr\.|Blvd\.?|Sq\.?)"
_TOWN = rf",{_GAP}(?:\d{{4,6}}{_GAP}{_CITY}|{_CITY}(?:{_GAP}[-–]?{_GAP}\d{{4,6}}(?!\d))?)"
_SP = rf"(?:[ \t]+|[ \t]*\r?\n[ \t]*)"
_ADDRESS = re.compile(
    r"(?<![\w])(?:"
    rf"(?:(?:Flat|Apt\.?|Apartment|Unit|Room|House|Door|Plot)(?:[ \t]+No\.?)?{_SP}\d+[A-Za-z]?,{_GAP})?\d+[A-Za-z]?{_SP}{_TOK}{_SP}{_STREET}{_TOWN}"
    rf"|P\.?[ \t]?O\.?{_SP}Box{_SP}\d+,{_GAP}(?:{_TOK}{_SP}{_STREET},{_GAP})?(?:\d{{4,6}}{_GAP}{_CITY}|{_CITY}(?:{_GAP}[-–]?{_GAP}\d{{4,6}}(?!\d))?)"
    rf"|H\.?[ \t]?No\.?{_GAP}\d+(?:[-/]\d+)*(?:/[A-Z0-9]+)?,{_GAP}{_TOK}{_SP}{_STREET}{_TOWN}"
    rf"|[{_UP}][{_LOW}]+(?:straße|strasse|str\.|weg|gasse|platz|allee|ring|damm|ufer){_SP}\d+[a-z]?{_TOWN}"
    rf"|\d+(?:[ \t]?(?:bis|ter))?,?{_SP}(?:rue|avenue|boulevard|place|allée|chemin|quai|impasse|cours){_SP}(?:(?:de|du|des|la|le){_SP}|d’|d')*{_TOK}{_TOWN}"
    rf"|(?:Calle|Avenida|Avda\.|Plaza|Paseo|C/){_SP}(?:(?:de|del|la|los){_SP})*{_TOK}{_SP}\d+,{_GAP}(?:\d+[ºª°](?:[ \t]?[A-Z])?,{_GAP})?(?:\d{{4,6}}{_GAP}{_CITY})"
    r")"
)

# Titles and phrases that introduce a person; a phrase of two words is given by both.
_TITLES = frozenset("Mr Mrs Ms Miss Mx Dr Prof Professor Sir Mme Mlle Madame Monsieur Frau Herr Sra Sr Srta Shri Smt".split())
_SHORT_TITLES = frozenset(title for title in _TITLES if len(title) < 3)
_LABELS = frozenset(("Name:", "contact:", "Contact:", "Thanks,", "I,", "Ask", "Signed,", "Regards,", "Student:", "Author:"))
_PHRASES = frozenset(("ask for", "submitted by", "lent by", "according to", "signed by", "written by", "regards to"))
_ENDS = _LABELS | {form for title in _TITLES for form in (title, title + ".")} | {phrase.split()[1] for phrase in _PHRASES}
_WEAK = frozenset(("see", "by", "to", "and", "for", "In", "from", "with", "or", "et", "y", "und"))
# What rules and works are called, so that a name before it doesn't stand for the person.
_WORKS = frozenset(
    "rule rules theorem law lemma principle graph tree effect equation method model test limit college university institute school press prize series studies hall archive reader library".split()
)
# Capital letters of every script that has them, as ranges of the basic plane.
_CAPITALS = "".join(c for c in map(chr, range(0x10000)) if unicodedata.category(c) in ("Lu", "Lt"))
#: A capital and more letters, inner capitals too; an apostrophe within stands before a capital and another letter (not 's).
_CAPITAL = re.compile(rf"(?<![\w’'@.+])[{_CAPITALS}](?:[^\W\d_]|[\u0300-\u036f]|['’](?=[{_CAPITALS}][^\W\d_]))+(?![\w@])")
#: The same for the JVM; it may find more.
_CAPITAL_JVM = r"[\p{Lu}\p{Lt}](?:[\p{L}\u0300-\u036f]|['’](?=[\p{Lu}\p{Lt}]\p{L}))+"
_JOIN_SPACE = re.compile(r"(?:[ \t]+|[ \t]*\r?\n[ \t]*)(?:[A-Z]\.(?:[ \t]+|[ \t]*\r?\n[ \t]*)?)*")
_JOIN_COMMA = re.compile(r",(?:[ \t]+|[ \t]*\r?\n[ \t]*)")
_INITIALS = re.compile(r"(?:(?<=[\s(/\"'“«-])|^)(?:[A-Z]\.(?:[ \t]*|[ \t]*\r?\n[ \t]*))+$")
_INITIALS_AFTER = re.compile(r"[ \t]+[A-Z]\.(?=[ \t]*[,/)(]|[ \t]+[-–][ \t])(?:[ \t]?[A-Z]\.)*")


#: Where digits stand that may be a phone or identity number; the patterns are tried only there.
_DIGITS = re.compile(r"\d[\d ().\-]{3,}\d")
_LETTER_NUMBER = re.compile(r"[A-Z]{1,5}\d{2}(?:\d{2}|-[A-Z])")
#: How far from the sign or number that shows it a piece is looked for, at first; the bound grows where it may have cut one.
_REACH = 90
#: A number of any form: seven to fifteen digits, with the signs that stand in phone and identity numbers, and letters of a series before it.
_ANY_NUMBER = re.compile(r"(?<![\w.,/-])(?:(?!ISBN|ISSN|DOI)[A-Z]{1,5}[ -]?)?\+?\(?\d(?:[ ./()-]{0,2}\d){6,14}(?![\w/%]|[ ./()-]{0,2}\d|,\d)")
#: The word before a number on its line, with its colon or stop.
_WORD_BEFORE = re.compile(r"([^\W\d_]{2,})[.:)]{0,2}[ \t]*(?:no\.?|number|nr\.?|#)?[.:]?[ \t(]*\Z", re.I)
#: Uses of a word before numbers, the share of them that are of one kind, and the disclosure, that make it a sign of that kind.
NUMBER_USES, NUMBER_SHARE, NUMBER_BITS = 5, 0.5, 1.0
_AT_SIGN = re.compile("[@＠]")
_WRITTEN = re.compile(r"[\[({ \t](?:[ \t]?(?:at|AT|At)[ \t]?[\])}]|[ \t]?(?:dot|DOT|Dot)[ \t\])}])")
_WRITTEN_OUT = ("dot", "DOT", "at)", "at]", "AT)", "AT]", "at }", "at )", "at ]", "At)", "At]")
#: A number as it stands in an address, and the words one of which stands near it.
_NUMBERED = re.compile(rf"\d+[A-Za-z]?(?:,|[-/]\d|[ºª°]|[ \t\r\n]+(?:[{_UP}]|rue|avenue|boulevard|place|allée|chemin|quai|impasse|cours)|[ \t]?(?:bis|ter))")
_ADDRESS_WORDS = (
    "Street", "Road", "Lane", "Avenue", "Crescent", "Drive", "Square", "Close", "Terrace", " Way", "Court", "Place", " Row", "Nagar", "Colony", "Layout", "Enclave",
    "Marg", "Vihar", " St", " Rd", " Ln", " Ave", "Blvd", " Box", "straße", "strasse", "str.", "weg", "gasse", "platz", "allee", "ring ", "damm", "ufer", "rue",
    "avenue", "boulevard", "place", "chemin", "quai", "impasse", "cours", "Calle", "Avenida", "Avda", "Plaza", "Paseo", "C/",
)


def _free(start: int, end: int, taken: list[tuple[int, int, str]]) -> bool:
    return not any(s < end and start < e for s, e, _ in taken)


def _near(pattern: re.Pattern, text: str, at: int, until: int, kind: str, taken: list[tuple[int, int, str]]) -> None:
    """Adds the matches of ``pattern`` that meet at..until and don't overlap what's taken."""
    reach = _REACH
    if kind == "email":  # a local part may be of any length
        reach = max(reach, at - _local_begin(text, at) + 2)
    while True:
        low, high = max(0, at - reach), min(len(text), until + 2 * reach)
        cut = False
        for m in pattern.finditer(text, low, high):
            if m.start() >= until:
                break
            if m.end() > at:
                cut = cut or (m.end() == high < len(text))
                if not cut and _free(*m.span(), taken) and not (kind != "street_address" and _NOT_PERSONAL.search(text, max(0, m.start() - 40), m.start())):
                    taken.append((*m.span(), kind))
        if not cut:
            return
        reach *= 4


def _local_begin(text: str, at: int) -> int:
    while at > 0 and (text[at - 1].isalnum() or text[at - 1] in "_.+%-"):
        at -= 1
    return at


def number_places(text: str, taken: list[tuple[int, int, str]]) -> Iterator[tuple[str, int, int]]:
    """(word before, start, end) of the numbers of any form outside ``taken``."""
    for m in _ANY_NUMBER.finditer(text):
        if _free(*m.span(), taken):
            before = _WORD_BEFORE.search(text, max(0, m.start() - 40), m.start())
            if before and not _NOT_PERSONAL.search(text, max(0, m.start() - 40), m.start()):
                yield before.group(1).lower(), *m.span()


#: Before the words that stand before numbers in the counts, which hold capitalised terms as well.
_NUMBER = "# "
_COUNTED = ("phone", "identity_number")


def number_counts(text: str, counts: dict[str, list[int]]) -> None:
    """Adds to '# ' + word -> [numbers behind it, of these phones, identity numbers, 0]."""
    taken: list[tuple[int, int, str]] = []
    _shaped_numbers(text, taken)
    places = [(word, 0) for word, _, _ in number_places(text, taken)]
    for start, _, kind in taken:
        before = _WORD_BEFORE.search(text, max(0, start - 40), start)
        if before:
            places.append((before.group(1).lower(), 1 + _COUNTED.index(kind)))
    for word, kind in places:
        own = counts.setdefault(_NUMBER + word, [0, 0, 0, 0])
        own[0] += 1
        if kind:
            own[kind] += 1


def number_spans(text: str, signs: dict[str, int], taken: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """The numbers of any form behind words that disclose one. signs: '# ' + word -> 1 phone, 2 identity number."""
    return [(start, end, _COUNTED[signs[_NUMBER + word] - 1]) for word, start, end in number_places(text, taken) if _NUMBER + word in signs]


def _shaped_numbers(text: str, taken: list[tuple[int, int, str]]) -> None:
    """Adds the identity and phone numbers of known shapes that don't overlap what's taken."""
    for m in _LETTER_NUMBER.finditer(text):
        _near(_IDENTITY, text, *m.span(), "identity_number", taken)
    for m in _DIGITS.finditer(text):
        if sum(map(str.isdigit, m.group())) >= 7 and _free(*m.span(), taken):
            _near(_IDENTITY, text, *m.span(), "identity_number", taken)
            _near(_PHONE, text, *m.span(), "phone", taken)


def shaped(text: str) -> list[tuple[int, int, str]]:
    """E-mail addresses, street addresses, identity and phone numbers, sorted."""
    taken: list[tuple[int, int, str]] = []
    done = 0
    signs = [m.start() for m in _AT_SIGN.finditer(text)]
    if any(sign in text for sign in _WRITTEN_OUT):
        signs = sorted(signs + [m.start() for m in _WRITTEN.finditer(text)])
    for at in signs:
        if at >= done:
            before = len(taken)
            _near(_EMAIL, text, at, at + 2, "email", taken)
            if len(taken) > before:
                done = taken[-1][1]
    done = 0
    for m in _NUMBERED.finditer(text):
        start, end = m.span()
        if start >= done:
            window = text[max(0, start - _REACH) : end + _REACH]
            if any(word in window for word in _ADDRESS_WORDS):
                before = len(taken)
                _near(_ADDRESS, text, start, end, "street_address", taken)
                if len(taken) > before:
                    done = taken[-1][1]
    _shaped_numbers(text, taken)
    return sorted(taken)


def _lead(text: str, start: int, width: int) -> str:
    """What stands before ``start``, of ``width`` characters and the blanks behind them."""
    lead = text[max(0, start - width) : start]
    if lead.isspace():
        stripped = len(text[:start].rstrip())
        lead = text[max(0, stripped - width) : start]
    return lead


def _before(text: str, start: int) -> tuple[str, str]:
    """The two words that stand before ``start``, in order, with their punctuation."""
    words = _lead(text, start, 30).split()
    return (words[-2] if len(words) > 1 else "", words[-1] if words else "")


def _cue(text: str, start: int) -> str:
    """"strong" behind a title, label or phrase of persons, "weak" behind words that often precede one."""
    if start == 0 or not text[start - 1].isspace():
        return ""
    last = _lead(text, start, 15).split()
    one = last[-1] if last else ""
    if one in _ENDS:
        if one in _LABELS or one.rstrip(".") in _TITLES:
            return "strong"
        if " ".join(_before(text, start)).lower() in _PHRASES:
            return "strong"
    return "weak" if one in _WEAK else ""


def _may_have_cue(text: str, start: int) -> bool:
    """A cheap look: false only where ``_cue`` would not be strong."""
    lead = _lead(text, start, 15)
    return "\n" in lead or lead[-2:-1] == "." or lead[:-1].rpartition(" ")[2] in _ENDS


def _initials(text: str, start: int) -> int:
    """Where the initials that stand directly before ``start`` begin; ``start`` when there are none."""
    i = start - 1
    while i >= 0 and text[i] in " \t\r\n":
        i -= 1
    if i < 1 or text[i] != "." or not text[i - 1].isupper():
        return start
    lead = _INITIALS.search(text, max(0, start - 14), start)
    return lead.start() if lead else start


def _terms(text: str, taken: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """(start, end, lower-cased) of the capitalised terms outside ``taken``."""
    terms = [(*m.span(), m.group().lower()) for m in _CAPITAL.finditer(text) if m.group() not in _SHORT_TITLES]
    if not taken:
        return terms
    out, i = [], 0
    for term in terms:
        while i < len(taken) and taken[i][1] <= term[0]:
            i += 1
        if i == len(taken) or taken[i][0] >= term[1]:
            out.append(term)
    return out


def term_counts(text: str, counts: dict[str, list[int]]) -> None:
    """Adds to term -> [uses, uses inside an entity, as the first of two, as the second of two]."""
    terms = _terms(text, [])
    inside_until, previous, plain = -1, None, False
    for start, end, term in terms:
        own = counts.get(term)
        if own is None:
            own = counts[term] = [0, 0, 0, 0]
        own[0] += 1
        entity = False
        lead = _initials(text, start)
        if _cue(text, lead) == "strong":
            entity, inside_until, plain = True, end, lead == start
        elif inside_until >= 0 and previous and previous[1] == inside_until:
            gap = text[inside_until:start]
            entity = gap == "-" or _JOIN_SPACE.fullmatch(gap) is not None or (plain and _JOIN_COMMA.fullmatch(gap) is not None)
            if entity and _JOIN_SPACE.fullmatch(gap):
                counts[previous[2]][2] += 1
                own[3] += 1
            inside_until = end if entity and gap == "-" else -1
        else:
            inside_until = -1
        own[1] += entity
        previous = (start, end, term)


def name_spans(text: str, lexicon: dict[str, int], taken: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """The runs of name terms. lexicon: term -> role: 1 mostly given, 2 mostly family name, 0 either, 3 possible."""
    terms = _terms(text, taken)
    out: list[tuple[int, int, str]] = []
    i = 0
    while i < len(terms):
        start, end, term = terms[i]
        role = lexicon.get(term)
        if role is None and not _may_have_cue(text, start):
            i += 1
            continue
        begin = _initials(text, start)
        cue = _cue(text, begin)
        lead = begin < start
        known = role is not None and (role != POSSIBLE or lead)
        if not known and cue != "strong":
            i += 1
            continue
        j, count, roles, comma = i, 1, [role or 0], False
        while j + 1 < len(terms):
            s, e, t = terms[j + 1]
            gap = text[end:s]
            other = t in lexicon
            if gap == "-" and (other or known):
                pass
            elif other and _JOIN_SPACE.fullmatch(gap) and (count < 2 or "\n" not in gap or lexicon[t] != 1):  # on a new line a given name begins the next person
                count += 1
            elif lexicon.get(t) == 1 and not comma and count > 1 and not lead and _JOIN_COMMA.fullmatch(gap) and set(roles) == {2}:
                count, comma = count + 1, True
            elif other and not comma and count == 1 and not lead and _JOIN_COMMA.fullmatch(gap) and roles[0] != 1 and lexicon[t] not in (2, POSSIBLE):
                count, comma = count + 1, True
            else:
                break
            roles.append(lexicon.get(t, 0))
            j, end = j + 1, e
        after = text[end : end + 24]
        if comma or count == 1:
            trail = _INITIALS_AFTER.match(text, end)
            if trail and (comma or roles[-1] != 1):
                end = trail.end()
        if _is_person(text, begin, end, after, count, lead, cue, known, roles):
            out.append((begin, end, "person_name"))
        i = j + 1
    return out


def _is_person(text: str, begin: int, end: int, after: str, count: int, lead: bool, cue: str, known: bool, roles: list[int]) -> bool:
    _, one = _before(text, begin)
    follows = re.match(r"(?:['’]s)?[ \t]+([\w-]+)", after)
    if follows and follows.group(1).lower() in _WORKS and (count == 1 or one.lower() == "the"):
        return False
    if count > 1:
        return known
    if one.lower() in ("the", "of", "-", "/", ":") and cue != "strong":
        return one == "-" and re.match(r"[ \t]+-[ \t]+\d", after) is not None
    if cue == "strong":
        return known or re.match(r"[ \t]*(?:\(|[,.;]|$|\r?\n)", after) is not None
    if lead:
        return True
    return cue == "weak" and known and roles[0] == 1


def find(text: str, lexicon: dict[str, int]) -> list[tuple[int, int, str]]:
    """(start, end, kind) in code points, sorted, without overlaps."""
    taken = shaped(text)
    taken = sorted(taken + number_spans(text, lexicon, taken))
    return sorted(taken + name_spans(text, lexicon, taken))


def disclosures(documents: DataFrame, text_col: str = "text") -> DataFrame:
    """(term, uses, inside, disclosure, role) of every capitalised term of the corpus, counted over all
    documents; disclosure is null for a term never inside an entity. Words before numbers come with a '# ' before
    them, inside and disclosure being those of the kind of role (1 phone, 2 identity number) that is more
    frequent behind them. The texts are read once; counts are summed per task first."""
    source = documents.where(F.col(text_col).isNotNull()).select(F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, list[int]] = {}
        for batch in batches:
            for text in batch.column(0).to_pylist():
                term_counts(text, counts)
                number_counts(text, counts)
            if len(counts) > _FLUSH:
                yield _count_rows(counts)
                counts = {}
        yield _count_rows(counts)

    names = ("uses", "inside", "first", "second")
    counted = source.mapInArrow(run, "term string, " + ", ".join(f"{n} long" for n in names)).groupBy("term").agg(*(F.sum(n).alias(n) for n in names))
    counted = cut_lineage(counted)
    number = F.startswith("term", F.lit(_NUMBER))
    totals = {r["number"]: r for r in counted.groupBy(number.alias("number")).agg(*(F.sum(n).alias(n) for n in names)).collect()}
    share = lambda group, column: (totals[group][column] or 0) / max(1, totals[group]["uses"] or 0) if group in totals else 0.0
    bits = lambda inside, base: F.log2(F.col(inside) / F.col("uses") / F.lit(base)) if base else F.lit(None).cast("double")
    role = F.when(F.col("first") >= 3 * F.col("second") + 1, 1).when(F.col("second") >= 3 * F.col("first") + 1, 2).otherwise(0)
    phones = F.col("inside") >= F.col("first")
    inside = F.when(number, F.greatest("inside", "first")).otherwise(F.col("inside"))
    disclosure = F.when(number, F.when(phones, bits("inside", share(True, "inside"))).otherwise(bits("first", share(True, "first")))).otherwise(bits("inside", share(False, "inside")))
    role = F.when(number, F.when(phones, 1).otherwise(2)).otherwise(role)
    return counted.select("term", "uses", inside.alias("inside"), F.when(inside > 0, disclosure).alias("disclosure"), role.alias("role"))


def _count_rows(counts: dict[str, list[int]]) -> pa.RecordBatch:
    columns = list(zip(*counts.values())) or [(), (), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), *(pa.array(c, pa.int64()) for c in columns)], names=["term", "uses", "inside", "first", "second"])


def name_terms(counted: DataFrame, min_bits: float = MIN_BITS, min_share: float = MIN_SHARE, min_uses: int = MIN_USES) -> DataFrame:
    """(term, role) of the terms that disclose a person; role 3 for terms used inside an entity too
    seldom to be name terms by themselves, which only lengthen a name that begins with one or an initial.
    Of the words before numbers those come that disclose a phone (role 1) or an identity number (role 2).
    """
    number = F.startswith("term", F.lit(_NUMBER))
    share = F.col("inside") / F.col("uses")
    discloses = (F.col("disclosure") >= min_bits) | (share >= SURE_SHARE)  # the latter where most terms of a corpus are names
    sure = discloses & (share >= min_share) & (F.col("inside") >= min_uses)
    signs = counted.where(number & (F.col("uses") >= NUMBER_USES) & (share >= NUMBER_SHARE) & ((F.col("disclosure") >= NUMBER_BITS) | (share >= 2 * NUMBER_SHARE))).select("term", "role")
    return counted.where(~number & discloses).select("term", F.when(sure, F.col("role")).otherwise(POSSIBLE).alias("role")).unionByName(signs)


def scan(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", clean: bool = False, broadcast_terms: int = BROADCAST_TERMS, **rule) -> DataFrame:
    """Each document's personal information: (id_col, spans array<struct<start_pos, end_pos, kind>>), with
    ``clean`` also its text in which every piece is replaced by its kind in brackets.

    Positions count code points, end_pos is exclusive. Null and empty texts have no pieces; a null text
    stays null; a repeated row comes out again; other columns aren't read. The name terms are broadcast
    where they are few, else each document gets its own terms by a join on the term.
    """
    terms = cut_lineage(name_terms(disclosures(documents, text_col), **rule))
    source = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    schema = f"id {kind}, spans array<struct<start_pos: int, end_pos: int, kind: string>>" + (", text string" if clean else "")
    shared = None
    if terms.count() <= broadcast_terms:
        shared = source.sparkSession.sparkContext.broadcast({r["term"]: r["role"] for r in terms.toLocalIterator()})
    else:
        row = source.withColumn("row", F.monotonically_increasing_id())
        row = cut_lineage(row)  # row numbers must not change between the two uses
        words = F.regexp_extract_all("text", F.lit(r"\p{L}{2,}"), F.lit(0))
        before = F.transform(words, lambda w: F.concat(F.lit(_NUMBER), F.lower(w)))
        own = row.select("row", F.explode(F.array_distinct(F.concat(F.transform(F.regexp_extract_all("text", F.lit(_CAPITAL_JVM), F.lit(0)), F.lower), before))).alias("term"))
        own = own.join(terms, "term").groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("term", "role"))).alias("terms"))
        source = row.join(own, "row", "left").select("id", "text", "terms")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            lexicons = [shared.value] * len(texts) if shared is not None else [dict(m or ()) for m in batch.column(2).to_pylist()]
            found = [find(t, lexicon) if t else [] for t, lexicon in zip(texts, lexicons)]
            columns = [batch.column(0), pa.array([[dict(zip(("start_pos", "end_pos", "kind"), s)) for s in f] for f in found], _SPANS)]
            if clean:
                columns.append(pa.array([t and redact(t, f) for t, f in zip(texts, found)], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=["id", "spans", *(["text"] if clean else [])])

    return source.mapInArrow(run, schema).withColumnRenamed("id", id_col)


_SPANS = pa.list_(pa.struct([("start_pos", pa.int32()), ("end_pos", pa.int32()), ("kind", pa.string())]))


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    """``text`` with each span replaced by [KIND]; every other character is kept."""
    out, at = [], 0
    for start, end, kind in spans:
        out += [text[at:start], f"[{kind.upper()}]"]
        at = end
    return "".join([*out, text[at:]])


def found(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", **rule) -> DataFrame:
    """(id_col, start_pos, end_pos, kind): one row per piece of personal information."""
    rows = scan(documents, id_col, text_col, **rule).select(id_col, F.explode("spans").alias("s"))
    return rows.select(id_col, "s.start_pos", "s.end_pos", "s.kind")
