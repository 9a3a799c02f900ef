"""Surrogates for personal data, with DataFrame functions only.

Entities are found by one regular expression; numbers that look like cards or
IBANs count only if their check digits are right. Each distinct entity, in a
canonical form that its spellings share, gets a surrogate drawn by a keyed hash:
of its type and format (digit for digit, letter for letter, valid check digits,
octets in range), names of the same gender and script. A name is replaced word
by word, given names and surnames each by their own surrogates, so "Mr John
Smith" and "Mr Smith" stay one family. Surrogates that meet another entity's, or
an entity of the corpus, are drawn again until all are distinct, so that equal
entities stay equal and different ones different. Dates of birth are permuted.

The texts are searched once: the matches of the distinct texts that have any are
kept, exploded, replaced, and joined to the texts again.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.components import checkpointed

#: Rounds of drawing again; each leaves a small share of the last one's, unless a format has about as many entities as values.
ROUNDS = 200
#: Rows, and characters in them, up to which a table is broadcast.
BROADCAST_ROWS, BROADCAST_CHARS = 200_000, 30_000_000
#: Occurrences of an entity from which it is joined apart from the others.
HOT = 100_000

_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
#: Forms of address with the gender they tell, and those that tell none.
MALE = ("Mr", "MR", "Mister", "Sir", "Herr", "Monsieur", "Señor", "Signor", "Senhor", "господин", "Κύριος", "κύριος", "السيد", "श्री")
FEMALE = ("Mrs", "MRS", "Ms", "Miss", "Madam", "Frau", "Madame", "Mme", "Mlle", "Señora", "Señorita", "Signora", "Senhora", "госпожа", "Κυρία", "κυρία", "السيدة", "श्रीमती", "גברת")
NEUTRAL = ("Dr", "Prof", "Doctor", "Professor", "Mx", "доктор", "профессор", "Δρ", "דוקטור", "الدكتور", "डॉ")
#: Common given names that need no form of address before them.
KNOWN = {
    "M": "James John Robert Michael William David Richard Joseph Thomas Charles Daniel Matthew Anthony Steven Andrew Paul Joshua Kevin Brian George Peter Hans Klaus Jürgen Stefan Wolfgang Pierre Jean Michel Philippe Nicolas Carlos José Juan Luis Miguel Javier Antonio Giovanni Marco Ahmed Mohammed Ivan Dmitri Sergei".split(),
    "F": "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Nancy Margaret Sandra Emily Michelle Laura Rebecca Catherine Maria Anna Julia Sabine Monika Petra Claudia Marie Françoise Isabelle Sophie Nathalie Carmen Lucía Elena Isabel Pilar Rosa Giulia Chiara Fatima Aisha Olga Natalia Svetlana".split(),
}
PARTICLES = ("van", "von", "de", "der", "den", "del", "della", "di", "da", "dos", "la", "le", "du", "zu", "bin", "ibn", "al", "ter", "ten", "y")
GIVEN = {
    "ML": ("Adam", "Boris", "Carl", "Denis", "Edgar", "Felix", "Georg", "Hugo", "Igor", "Jonas", "Karim", "Lukas", "Martin", "Nils", "Oscar", "Pablo"),
    "FL": ("Alice", "Berta", "Clara", "Diana", "Erika", "Fiona", "Greta", "Helen", "Irene", "Judith", "Karla", "Lena", "Mona", "Nadia", "Oda", "Paula"),
    "NL": ("Alex", "Ari", "Bo", "Chris", "Dana", "Eden", "Jamie", "Kim", "Lee", "Luca", "Noel", "Quinn", "Robin", "Sam", "Toni", "Uli"),
    "MC": ("Антон", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Игорь", "Кирилл"),
    "FC": ("Алина", "Вера", "Галина", "Дарья", "Ева", "Ирина", "Лидия", "Нина"),
    "MG": ("Γιώργος", "Νίκος", "Κώστας", "Δημήτρης", "Γιάννης", "Πέτρος", "Μιχάλης", "Ανδρέας"),
    "FG": ("Ελένη", "Κατερίνα", "Σοφία", "Άννα", "Ειρήνη", "Δήμητρα", "Ζωή", "Φωτεινή"),
}
#: Scripts (as regular expressions know them) with sixteen syllables for names, and endings of given names for men, women and others.
SCRIPTS = {
    "L": ("Latin", "ba den fer gor hal kin lor man nes per ros sel tar van wil zor", ("o", "a", "e")),
    "C": ("Cyrillic", "ба вел гор дан жин кор лев мир нов пет рос сав тер фед чер шин", ("ой", "а", "ко")),
    "G": ("Greek", "βα δεν φερ γορ χαλ κιν λορ μαν νες περ ροσ σελ ταρ βαν ζορ θιν", ("ος", "α", "ι")),
    "A": ("Arabic", "با دن فر جور حال كين لور مان نس بر روس سل تار وان زور شين", ("ي", "ة", "و")),
    "H": ("Hebrew", "בא דן פר גור חל קין לור מן נס פל רוס סל תר ון זור שין", ("ו", "ה", "י")),
    "D": ("Devanagari", "बा देन फर गोर हल किन लोर मन नेस पर रोस सेल तर वन जोर शिन", ("ो", "ा", "े")),
}
_TITLES = (*MALE, *FEMALE, *NEUTRAL)
_IP = rf"(?:{_OCTET}\.){{3}}{_OCTET}(?!\d|\.\d)"
_KEYWORDS = "password|passwd|token|secret|api_key"
#: A further number that follows a phone number: SSN, phone, card.
_NEXT = r"\d{3}-\d{2}-\d{4}(?![\d-])|\(?\d{3}\)?[ .-]\d{3}[ .-]\d{4}(?!\d)|\d{4}(?:[ -]?\d{4}){3}(?![ -]?\d)"
_CARD = r"\d{4} \d{4} \d{4} \d{4}|\d{4}-\d{4}-\d{4}-\d{4}|\d{4}[ -]\d{6}[ -]\d{4,5}|\d{13,19}"


def either(words: tuple[str, ...] | list[str]) -> str:
    """A pattern of the words, the longer first, told apart by their first letters."""
    firsts: dict[str, list[str]] = {}
    for w in sorted(words, key=len, reverse=True):
        firsts.setdefault(w[0], []).append(w[1:])
    return "(?:" + "|".join(f"{c}(?:{'|'.join(rest)})" for c, rest in firsts.items()) + ")"


_WORD = r"(?:(?:[OD]['’])?\p{Lu}[\p{L}\p{M}]+|\p{Lo}[\p{Lo}\p{M}]+)(?:-\p{L}[\p{L}\p{M}]*)*"
_LAST = rf"(?:(?:{'|'.join(PARTICLES)}) ){{0,3}}{_WORD}"


def _names(titles: list[str], given: list[str]) -> str:
    after = rf"\.? (?:{_WORD} (?:\p{{Lu}}\. )?(?={_LAST}))?{_LAST}"
    return either(titles) + after + (rf"|{either(given)} (?:\p{{Lu}}\. )?{_LAST}" if given else "")


MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
_MONTH = "|".join(MONTHS)
_BORN = r"(?<=(?i:born|born on|date of birth|birth date|dob|geboren|geboren am|geb\.|né le|née le|nacido el|nacida el)[: ]{1,3})"
_DAY = rf"\d{{4}}-\d{{2}}-\d{{2}}|\d{{1,2}}[./-]\d{{1,2}}[./-]\d{{4}}|\d{{1,2}}(?:st|nd|rd|th|\.)? (?:{_MONTH}) \d{{4}}"
_MONTH_FIRST = rf"(?:{_MONTH}) \d{{1,2}}(?:st|nd|rd|th)?,? \d{{4}}"
_DATE = f"{_DAY}|{_MONTH_FIRST}"
STREETS = ("Street", "St", "Avenue", "Ave", "Road", "Rd", "Lane", "Ln", "Drive", "Boulevard", "Blvd", "Court", "Way", "Square", "Terrace", "Crescent")
_COMPOUND = "straße|strasse|weg|platz|gasse|allee"
_ROADS = ("rue", "avenue", "boulevard", "place", "chemin", "calle", "avenida", "plaza", "via", "piazza")
_MAIL = r"[A-Za-z0-9][A-Za-z0-9._%+-]*+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
_SECRET = rf"(?<=[=:\"]|[=:]\s|[=:]\s\s)(?<=(?i:{_KEYWORDS})\s{{0,2}}[=:]\s{{0,2}}\"?)[A-Za-z0-9_+/.-]{{8,}}"
_PLACE = rf"(?=[\p{{L}}\p{{M}}]+ \d)\p{{Lu}}[\p{{L}}\p{{M}}]+(?:{_COMPOUND}) \d{{1,4}}[a-z]?(?![\p{{L}}\d])"
#: Alternatives by what they begin with, each behind a test of one character, so that most places of a text fail at once.
_FROM_DIGITS = [
    _MAIL,
    _SECRET,
    rf"(?<!\.){_IP}",
    r"(?<!-)\d{3}-\d{2}-\d{4}(?![\d-])",
    rf"{_BORN}(?:{_DAY})(?!\d)",
    r"(?<![.-])\d{3}[ .-]\d{3}[ .-]\d{4}(?!\d)",
    rf"(?<![A-Za-z])(?:{_CARD})(?![\dA-Za-z])",
    rf"(?<![\p{{L}}\p{{M}}])\d{{1,5}} (?:\p{{Lu}}[\p{{L}}\p{{M}}]+ ){{1,3}}{either(STREETS)}(?![\p{{L}}\d])",
    rf"(?<![\p{{L}}\p{{M}}])\d{{1,4}},? (?i:{'|'.join(_ROADS)}) (?:(?:de|du|des|la|le|les|del|della) )*\p{{Lu}}[\p{{L}}\p{{M}}]+",
]
_FROM_CAPITALS = [
    r"AKIA[0-9A-Z]{16}\b",
    r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b",
    rf"(?<![\p{{L}}\p{{M}}])(?:{_BORN}{_MONTH_FIRST}(?!\d)|{_names([t for t in _TITLES if 'A' <= t[0] <= 'Z'], KNOWN['M'] + KNOWN['F'])}|{_PLACE})",
]
_CAPITALS = rf"(?=[A-Z])(?<![A-Za-z0-9_])(?:{'|'.join(_FROM_CAPITALS)})"
_OTHERS = rf"(?=[^\x00-\x7F])(?<![\p{{L}}\p{{M}}\d])(?:{_names([t for t in _TITLES if t[0] > 'z'], [])}|{_PLACE})"
PATTERN = "|".join(
    [
        rf"(?=\d)(?<!\d)(?:{'|'.join(_FROM_DIGITS)})",
        rf"(?=[A-Za-z])(?<![A-Za-z0-9])(?:{_MAIL}|{_SECRET}|{_CAPITALS})",
        rf"\+\d{{1,3}}(?:(?! {_IP})[ .-]?\(?\d{{1,4}}\)?){{2}}(?:(?! (?:{_IP}|{_NEXT}))[ .-]?\(?\d{{1,4}}\)?){{0,3}}(?!\d)",
        r"\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)",
        rf"(?=[_+/.-]){_SECRET}",
        _OTHERS,
    ]
)

#: A text without any of these has no match. Apart they are tried several times as fast as PATTERN.
GATES = [rf"(?=\d)(?<!\d)(?:{'|'.join(_FROM_DIGITS)})", _CAPITALS, _OTHERS, r"\+\d|\(\d{3}\)", rf"[=:](?<=(?i:{_KEYWORDS})\s{{0,2}}[=:])"]


def let(value: Column, fn: Callable[[Column], Column]) -> Column:
    """fn of a value that is computed once per row."""
    return F.element_at(F.transform(F.array(value), lambda x: fn(x)), 1)


def _digits(e: Column) -> Column:
    return F.regexp_replace(e, r"[^0-9]", "")


def _byte(h: Column, i: Column | int) -> Column:
    """Byte i (from 0, around) of a hash of 64 bytes in hex."""
    at = (F.pmod(i, F.lit(64)) if isinstance(i, Column) else F.lit(i % 64)) * 2 + 1
    return F.conv(F.substring(h, at, F.lit(2)), 16, 10).cast("int")


# --- check digits


def _luhn(d: Column) -> Column:
    """Luhn sum of a string of digits."""

    def add(total: Column, i: Column) -> Column:
        x = F.substring(d, F.length(d) - i + 1, F.lit(1)).cast("int")
        twice = F.when(i % 2 == 0, F.when(x > 4, x * 2 - 9).otherwise(x * 2)).otherwise(x)
        return total + twice

    return F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), add)


def _is_card(d: Column) -> Column:
    """Whether digits are a card's: an issuer's first digits and length, and a right check digit."""
    issuer = r"^(?:4(?:\d{12}|\d{15}|\d{18})|(?:5[1-5]|2[2-7])\d{14}|3[47]\d{13}|3(?:0[0-5]|[689]\d)\d{11}|(?:6(?:011|5\d\d|4[4-9]\d|2\d\d)|35\d\d)\d{12,15})$"
    return d.rlike(issuer) & (_luhn(d) % 10 == 0)


def _mod97(s: Column) -> Column:
    """Digits and capitals as one number (A = 10 .. Z = 35), modulo 97."""

    def add(total: Column, i: Column) -> Column:
        c = F.substring(s, i, F.lit(1))
        return F.when(c.between("0", "9"), (total * 10 + F.ascii(c) - 48) % 97).otherwise((total * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(s)), F.lit(0), add)


def _is_iban(c: Column) -> Column:
    return _mod97(F.concat(F.substring(c, F.lit(5), F.length(c)), F.left(c, F.lit(4)))) == 1


# --- what an entity is


def _date_parts(e: Column) -> Column:
    """The date as yyyy-mm-dd; days before months, unless only months before days make a date. Null if it is none."""
    n = r"^(\d{1,2})[./-](\d{1,2})[./-](\d{4})$"
    a, b, year = (F.regexp_extract(e, n, i) for i in (1, 2, 3))
    swap = (F.lpad(b, 2, "0") > "12") & (F.lpad(a, 2, "0") <= "12")
    numeric = F.concat_ws("-", year, F.lpad(F.when(swap, a).otherwise(b), 2, "0"), F.lpad(F.when(swap, b).otherwise(a), 2, "0"))
    month = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.regexp_extract(e, rf"({_MONTH})", 1)).cast("string")
    day = F.when(e.rlike(r"^\d"), F.regexp_extract(e, r"^(\d{1,2})", 1)).otherwise(F.regexp_extract(e, r" (\d{1,2})\D", 1))
    written = F.concat_ws("-", F.right(e, F.lit(4)), F.lpad(month, 2, "0"), F.lpad(day, 2, "0"))
    iso = F.when(e.rlike(r"^\d{4}-"), e).when(e.rlike(n), numeric).otherwise(written)
    return let(iso, lambda d: F.when(F.try_to_timestamp(d, F.lit("yyyy-MM-dd")).isNotNull(), d))


def entity_type(e: Column) -> Column:
    """The kind of a match; NONE for what only looks like an entity."""
    space, digit = e.contains(" "), e.rlike(r"\d")
    return (
        F.when(e.contains("@"), "EMAIL")
        .when(space & ~digit, "NAME")
        .when(e.rlike(r"^\d{1,3}(?:\.\d{1,3}){3}$"), "IP")
        .when(e.rlike(r"^\d{3}-\d{2}-\d{4}$"), "SSN")
        .when(e.rlike(rf"^(?:{_DATE})$"), F.when(_date_parts(e).isNotNull(), "DOB").otherwise("NONE"))
        .when(e.rlike(r"^(?:\+|\(|\d{3}[ .-]\d{3}[ .-]\d{4}$)"), "PHONE")
        .when(e.rlike(rf"^(?:{_CARD})$"), F.when(let(_digits(e), _is_card), "CARD").otherwise("NONE"))
        .when(e.rlike(r"^AKIA[0-9A-Z]{16}$"), "KEY")
        .when(e.rlike(r"^[A-Z]{2}\d{2}(?: ?[A-Z0-9]{1,4}){3,8}$"), F.when(let(F.replace(e, F.lit(" "), F.lit("")), _is_iban), "IBAN").otherwise(F.when(space, "NONE").otherwise("CODE")))
        .when(space, "ADDRESS")
        .otherwise("SECRET")
    )


def canonical(e: Column, kind: Column) -> Column:
    """The form that the spellings of an entity share."""
    return (
        F.when(kind == "EMAIL", F.lower(e))
        .when(kind == "ADDRESS", F.lower(e))
        .when(kind == "PHONE", F.right(_digits(e), F.lit(10)))
        .when(kind.isin("CARD", "SSN"), _digits(e))
        .when(kind == "IBAN", F.replace(e, F.lit(" "), F.lit("")))
        .when(kind == "DOB", _date_parts(e))
        .otherwise(e)
    )


def _one_of(w: Column, words: tuple[str, ...] | list[str]) -> Column:
    return w.isin(*words)


def _name_atoms(e: Column) -> Column:
    """The words of a name: array<struct<e, kind, c>>; forms of address and particles are kept."""
    words = F.split(e, " ")
    first = F.regexp_replace(F.element_at(words, 1), r"\.$", "")
    title = F.when(_one_of(first, MALE), "M").when(_one_of(first, FEMALE), "F").otherwise("N")

    def atom(w: Column, i: Column) -> Column:
        script = F.lit("L")
        for tag, (name, _, _) in SCRIPTS.items():
            if tag != "L":
                script = F.when(w.rlike(rf"^\p{{Is{name}}}"), tag).otherwise(script)
        kind = (
            F.when((i == 0) & _one_of(F.regexp_replace(w, r"\.$", ""), _TITLES), "KEEP")
            .when(_one_of(w, PARTICLES), "KEEP")
            .when(w.rlike(r"^\p{Lu}\.$"), "INITIAL")
            .when(i == F.size(words) - 1, "SURNAME")
            .otherwise("GIVEN")
        )
        gender = F.when(_one_of(w, KNOWN["M"]), "M").when(_one_of(w, KNOWN["F"]), "F").otherwise(title)
        c = F.when(kind == "SURNAME", F.concat(script, F.lit("|"), F.lower(w))).when(kind == "GIVEN", F.concat(gender, script, F.lit("|"), F.lower(w))).otherwise(w)
        return F.struct(w.alias("e"), kind.alias("kind"), c.alias("c"))

    return F.transform(words, atom)


def _atoms(e: Column, kind: Column) -> Column:
    whole = F.struct(e.alias("e"), F.when(kind.isin("NONE", "CODE"), "KEEP").otherwise(kind).alias("kind"), canonical(e, kind).alias("c"))
    return F.when(kind == "NAME", _name_atoms(e)).otherwise(F.array(whole))


# --- surrogates


def _chars(s: Column, h: Column, alphabet: str = "abcdefghijklmnopqrstuvwxyz") -> Column:
    """s with digits for digits and letters of the alphabet for letters."""

    def one(i: Column) -> Column:
        c, b = F.substring(s, i, F.lit(1)), _byte(h, i)
        letter = F.substring(F.lit(alphabet), F.pmod(b, F.lit(len(alphabet))) + 1, F.lit(1))
        return F.when(c.between("0", "9"), F.pmod(b, F.lit(10)).cast("string")).when(c.rlike("^[a-z]$"), letter).when(c.rlike("^[A-Z]$"), F.upper(letter)).otherwise(c)

    return F.when(F.length(s) > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.length(s)), one), "")).otherwise(s)


def _card(c: Column, h: Column) -> Column:
    # the issuer's first digits stay, up to four
    head = F.concat(F.left(c, F.lit(4)), _chars(F.substring(c, F.lit(5), F.length(c) - 5), h))
    return let(head, lambda x: F.concat(x, F.pmod(10 - _luhn(F.concat(x, F.lit("0"))) % 10, F.lit(10)).cast("string")))


def _iban(c: Column, h: Column) -> Column:
    inner = _chars(F.substring(c, F.lit(5), F.length(c)), h)
    return let(inner, lambda x: F.concat(F.left(c, F.lit(2)), F.lpad((98 - _mod97(F.concat(x, F.left(c, F.lit(2)), F.lit("00")))).cast("string"), 2, "0"), x))


def _pick(words: tuple[str, ...] | list[str], b: Column) -> Column:
    return F.element_at(F.array(*[F.lit(w) for w in words]), F.pmod(b, F.lit(len(words))) + 1)


def _syllables(tag: str, h: Column, n: Column, start: int) -> Column:
    """n syllables by the hash's bytes from `start` on."""
    words = F.array(*[F.lit(w) for w in SCRIPTS[tag][1].split()])
    return F.array_join(F.transform(F.sequence(F.lit(1), n), lambda j: F.element_at(words, F.pmod(_byte(h, j + start), F.lit(16)) + 1)), "")


def _surname(c: Column, h: Column, attempt: Column) -> Column:
    """As many parts as the name has, of four syllables at first and more with each attempt."""
    out = F.lit(None).cast("string")
    body = F.substring_index(c, "|", -1)
    n = F.least(F.lit(4) + attempt, F.lit(12))
    for tag in SCRIPTS:
        one, two = _syllables(tag, h, n, 10), _syllables(tag, h, n, 30)
        out = F.when(c.startswith(tag), F.concat(F.lit(f"{tag}|"), one, F.when(body.contains("-"), F.concat(F.lit("-"), two)).otherwise(F.lit("")))).otherwise(out)
    return out


def _given(c: Column, h: Column, attempt: Column) -> Column:
    """A known given name of the gender and script at first, then syllables with an ending of the gender."""
    out = F.lit(None).cast("string")
    n = F.least(F.lit(2) + attempt, F.lit(12))
    for tag, (_, _, endings) in SCRIPTS.items():
        for gender, ending in zip("MFN", endings, strict=True):
            made = F.concat(_syllables(tag, h, n, 10), F.lit(ending))
            if known := GIVEN.get(gender + tag):
                made = F.when(attempt == 0, F.lower(_pick(known, _byte(h, 3)))).otherwise(made)
            out = F.when(c.startswith(gender + tag), F.concat(F.lit(f"{gender}{tag}|"), made)).otherwise(out)
    return out


def _address(c: Column, h: Column, attempt: Column) -> Column:
    """House number for house number, other names for names; kinds of street stay."""
    kept = [*(s.lower() for s in STREETS), *_ROADS, *PARTICLES, "des", "les"]

    def word(w: Column, i: Column) -> Column:
        name = _syllables("L", h, F.least(F.lit(3) + attempt, F.lit(12)), 5)
        # words of one address differ by where their syllables start
        name = F.concat(name, _pick(SCRIPTS["L"][1].split(), _byte(h, i + 40)))
        compound = F.regexp_extract(w, rf"({_COMPOUND})$", 1)
        number = F.concat((F.pmod(_byte(h, i + 50), F.lit(9)) + 1).cast("string"), _chars(F.substring(w, F.lit(2), F.length(w)), h))
        return F.when(w.rlike(r"^\d"), number).when(_one_of(w, kept), w).when(compound != "", F.concat(name, compound)).otherwise(name)

    return F.array_join(F.transform(F.split(c, " "), word), " ")


#: Days of birth that are permuted: from 1900-01-01 on.
DAYS = 45_000


def _dob(c: Column, key: str) -> Column:
    """Another date, by a keyed permutation of the days; no two dates of the span get the same."""
    h = int.from_bytes(hashlib.sha256(f"{key}|DOB".encode()).digest()[:16], "big")
    a = h % DAYS | 1
    while math.gcd(a, DAYS) != 1:
        a += 2
    days = F.datediff(F.try_to_timestamp(c, F.lit("yyyy-MM-dd")).cast("date"), F.lit("1900-01-01").cast("date")).cast("long")
    new = F.pmod(days * a + (h >> 64) % DAYS, F.lit(DAYS))
    # dates outside of the span keep their distance from it
    return F.date_add(F.lit("1900-01-01").cast("date"), (new + F.floor(days / DAYS) * DAYS).cast("int")).cast("string")


def surrogate(kind: Column, c: Column, attempt: Column, key: str) -> Column:
    """The surrogate of a canonical form, itself canonical."""
    seed = F.sha2(F.concat_ws("|", F.lit(key), kind, c, attempt.cast("string")), 512)
    domain = F.substring_index(c, "@", -1)
    named = F.regexp_extract(domain, r"^(.*)(\.[a-z]+)$", 1)

    def draw(h: Column) -> Column:
        where = let(F.sha2(F.concat_ws("|", F.lit(key), F.lit("DOMAIN"), domain), 512), lambda d: _chars(named, d))
        # a narrow mailbox or secret gets longer when it is drawn again and again
        more = F.when(attempt > 3, F.substring(h, F.lit(1), attempt - 3)).otherwise(F.lit(""))
        return (
            F.when(kind == "EMAIL", F.concat(_chars(F.substring_index(c, "@", 1), h), more, F.lit("@"), where, F.regexp_extract(domain, r"(\.[a-z]+)$", 1)))
            .when(kind == "SURNAME", _surname(c, h, attempt))
            .when(kind == "GIVEN", _given(c, h, attempt))
            .when(kind == "INITIAL", _chars(c, h))
            .when(kind == "DOB", _dob(c, key))
            .when(kind == "ADDRESS", _address(c, h, attempt))
            .when(kind == "IP", F.concat_ws(".", F.pmod(_byte(h, 1), F.lit(223)) + 1, _byte(h, 2), _byte(h, 3), F.pmod(_byte(h, 4), F.lit(254)) + 1))
            .when(kind == "PHONE", F.concat((F.pmod(_byte(h, 60), F.lit(8)) + 2).cast("string"), _chars(F.substring(c, F.lit(2), F.length(c)), h)))
            .when(kind == "CARD", _card(c, h))
            .when(kind == "KEY", F.concat(F.lit("AKIA"), _chars(F.substring(c, F.lit(5), F.length(c)), h)))
            .when(kind == "IBAN", _iban(c, h))
            .when(c.rlike("^[0-9a-f]{8,}$"), F.concat(_chars(c, h, "abcdef"), more))
            .when(kind == "SECRET", F.concat(_chars(c, h), more))
            .otherwise(_chars(c, h))
        )

    return let(seed, draw)


def _capitals(s: Column) -> Column:
    """Every word and part of a word with a capital."""
    return F.array_join(F.transform(F.split(s, "-"), F.initcap), "-")


def project(e: Column, kind: Column, s: Column) -> Column:
    """The surrogate in the entity's own spelling: its separators, further digits, capitals and form of date."""

    def digit(i: Column) -> Column:
        c = F.substring(e, i, F.lit(1))
        back = F.length(F.regexp_replace(F.substring(e, i, F.length(e)), r"[^0-9]", ""))
        return F.when(c.between("0", "9") & (back <= F.length(s)), F.substring(s, F.length(s) - back + 1, F.lit(1))).otherwise(c)

    def capital(i: Column) -> Column:
        c, d = F.substring(e, i, F.lit(1)), F.substring(s, i, F.lit(1))
        return F.when(c.rlike("^[A-Z]$"), F.upper(d)).otherwise(d)

    def spaced(i: Column) -> Column:
        c = F.substring(e, i, F.lit(1))
        back = F.length(F.replace(F.substring(e, i, F.length(e)), F.lit(" "), F.lit("")))
        return F.when(c == " ", c).otherwise(F.substring(s, F.length(s) - back + 1, F.lit(1)))

    def date() -> Column:
        year, month, day = F.left(s, F.lit(4)), F.substring(s, F.lit(6), F.lit(2)), F.right(s, F.lit(2))
        sign = F.regexp_extract(e, r"^\d{1,2}([./-])", 1)
        name = F.element_at(F.array(*[F.lit(m) for m in MONTHS]), month.cast("int"))
        plain = day.cast("int").cast("string")
        first = F.lpad(F.regexp_extract(e, r"^(\d{1,2})", 1), 2, "0") <= "12"
        swapped = first & (F.lpad(F.regexp_extract(e, r"^\d{1,2}[./-](\d{1,2})", 1), 2, "0") > "12")
        return (
            F.when(e.rlike(r"^\d{4}-"), s)
            .when(sign != "", F.when(swapped, F.concat(month, sign, day, sign, year)).otherwise(F.concat(day, sign, month, sign, year)))
            .when(e.rlike(r"^\d{1,2}\."), F.concat(plain, F.lit(". "), name, F.lit(" "), year))
            .when(e.rlike(r"^\d"), F.concat(plain, F.lit(" "), name, F.lit(" "), year))
            .otherwise(F.concat(name, F.lit(" "), plain, F.when(e.contains(","), F.lit(", ")).otherwise(F.lit(" ")), year))
        )

    each = F.sequence(F.lit(1), F.length(e))
    shown = F.substring_index(s, "|", -1)
    return (
        F.when(kind == "KEEP", e)
        .when(kind.isin("PHONE", "CARD", "SSN"), F.array_join(F.transform(each, digit), ""))
        .when(kind == "EMAIL", F.when(e == F.lower(e), s).when(F.length(e) == F.length(s), F.array_join(F.transform(each, capital), "")).otherwise(s))
        .when(kind == "IBAN", F.array_join(F.transform(each, spaced), ""))
        .when(kind.isin("GIVEN", "SURNAME"), F.when((e == F.upper(e)) & (e != F.lower(e)), F.upper(shown)).otherwise(_capitals(shown)))
        .when(kind == "DOB", date())
        .when(kind == "ADDRESS", F.array_join(F.zip_with(F.split(e, " "), F.split(s, " "), lambda a, b: F.when(F.lower(a) == b, a).when(a.rlike(r"^\p{Lu}"), F.initcap(b)).otherwise(b)), " "))
        .otherwise(s)
    )


# --- the corpus


def _marks(text: Column) -> list[Column]:
    """128 bits that name a text."""
    return [F.xxhash64(text).alias("_k1"), F.xxhash64(F.lit("pii"), text).alias("_k2")]


def _small(df: DataFrame, chars: Column) -> bool:
    n, size = df.agg(F.count("*"), F.sum(chars)).first()
    return n <= BROADCAST_ROWS and (size or 0) <= BROADCAST_CHARS


def matches(documents: DataFrame) -> DataFrame:
    """(_k1, _k2, pos, _e) of the matches in the distinct texts, in text order, written once."""
    text = F.col("text").cast("string")
    gate = text.contains("@")
    for g in GATES:
        gate = gate | text.rlike(g)
    found = documents.filter(gate).select(*_marks(text), F.posexplode(F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))).alias("pos", "_e"))
    return checkpointed(found.dropDuplicates(["_k1", "_k2", "pos"]))


def occurrences(found: DataFrame) -> DataFrame:
    """(_k1, _k2, pos, match, at, e, kind, c): the words of names and the other entities, in the order of the texts."""
    one = found.withColumn("match", entity_type(F.col("_e")))
    return one.select("_k1", "_k2", "pos", "match", F.posexplode(_atoms(F.col("_e"), F.col("match"))).alias("at", "_a")).select("_k1", "_k2", "pos", "match", "at", "_a.e", "_a.kind", "_a.c")


def redraws(entities: DataFrame, key: str) -> DataFrame:
    """(kind, c, attempt) of entities whose first surrogates would collide. entities: distinct (kind, c).

    The first round looks at all entities, a further one only at those drawn
    again; these avoid whatever was ever drawn or stands in the corpus. Given
    names may be drawn as others in the corpus are called: with a surname that
    nobody has, they name nobody.
    """
    drawn = checkpointed(entities.select("kind", "c", surrogate(F.col("kind"), F.col("c"), F.lit(0), key).alias("s")))
    real = entities.filter("kind <> 'GIVEN'").select("kind", F.col("c").alias("s"))
    held = drawn.groupBy("kind", "s").agg(F.min("c").alias("holder"), F.count("*").alias("n")).filter("n > 1").select("kind", "s", "holder")
    double = drawn.join(held, ["kind", "s"]).filter("c <> holder").select("kind", "c")
    taken = drawn.join(real, ["kind", "s"], "left_semi").select("kind", "c")
    pending = checkpointed(double.unionAll(taken).distinct())
    used, settled, attempt = drawn.select("kind", "s").unionAll(real), None, 0
    while pending.head(1):
        attempt += 1
        if attempt > ROUNDS:
            raise RuntimeError("a format has too few values for its distinct entities")
        drawn = checkpointed(pending.withColumn("s", surrogate(F.col("kind"), F.col("c"), F.lit(attempt), key)))
        asked = drawn.select("kind", "s").distinct()
        bad = used.join(F.broadcast(asked) if _small(asked, F.length("s")) else asked, ["kind", "s"]).distinct()
        first = drawn.groupBy("kind", "s").agg(F.min("c").alias("c"))
        good = checkpointed(first.join(bad, ["kind", "s"], "left_anti").select("kind", "c", F.lit(attempt).alias("attempt"), "s"))
        settled = good if settled is None else checkpointed(settled.unionByName(good))
        pending = checkpointed(pending.join(good, ["kind", "c"], "left_anti"))
        used = used.unionAll(good.select("kind", "s"))
    return settled.select("kind", "c", "attempt") if settled is not None else entities.select("kind", "c", F.lit(0).alias("attempt")).limit(0)


def _with_attempts(seen: DataFrame, redrawn: DataFrame, counts: DataFrame) -> DataFrame:
    """seen with `attempt`. Redrawn entities are broadcast if they are few, else those of many occurrences are."""
    at = ["kind", "c"]
    if not redrawn.head(1):
        return seen.withColumn("attempt", F.lit(0))
    if _small(redrawn, F.length("c")):
        return seen.join(F.broadcast(redrawn), at, "left").withColumn("attempt", F.coalesce("attempt", F.lit(0)))
    sized = checkpointed(redrawn.join(counts, at))
    marked = seen.join(F.broadcast(sized.filter(F.col("n") >= HOT).drop("n")), at, "left")
    cold = marked.filter("attempt is null").drop("attempt").join(sized.filter(F.col("n") < HOT).drop("n"), at, "left").withColumn("attempt", F.coalesce("attempt", F.lit(0)))
    return marked.filter("attempt is not null").unionByName(cold)


def replacements(documents: DataFrame, key: str) -> DataFrame:
    """(_k1, _k2, made): for each match of a text in order struct(kind, surrogate); what is no entity keeps its spelling."""
    seen = occurrences(matches(documents))
    counts = checkpointed(seen.filter("kind not in ('KEEP', 'INITIAL', 'DOB')").groupBy("kind", "c").agg(F.count("*").alias("n")))
    drawn = _with_attempts(seen, redraws(counts.select("kind", "c"), key), counts)
    s = let(surrogate(F.col("kind"), F.col("c"), F.col("attempt"), key), lambda v: project(F.col("e"), F.col("kind"), v))
    words = drawn.select("_k1", "_k2", "pos", "match", "at", F.when(F.col("kind") == "KEEP", F.col("e")).otherwise(s).alias("s"))
    whole = words.groupBy("_k1", "_k2", "pos", "match").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "s"))), lambda x: x["s"]), " ").alias("s"))
    made = whole.groupBy("_k1", "_k2").agg(F.array_sort(F.collect_list(F.struct("pos", F.col("match").alias("kind"), F.col("s").alias("surrogate")))).alias("made"))
    return checkpointed(made.select("_k1", "_k2", F.transform("made", lambda x: F.struct(x["kind"].alias("kind"), x["surrogate"].alias("surrogate"))).alias("made")))


def pseudonymise(documents: DataFrame, key: str = "tessera") -> DataFrame:
    """(doc_id, text, n_entities, entities) of every document; entities: array<struct<kind, surrogate>> in text order.

    Null texts stay null with no entities; null ids and repeated rows are kept;
    texts without entities stay as they are; an empty table gives no rows; other
    columns are not read. The same key gives the same surrogates for the same
    table.
    """
    made = replacements(documents, key)
    chars = F.aggregate("made", F.lit(0), lambda n, x: n + F.length(x["surrogate"]) + 8)
    made = F.broadcast(made) if _small(made, chars) else made
    text = F.col("text").cast("string")
    rows = documents.select("doc_id", text.alias("text"), *_marks(text)).join(made, ["_k1", "_k2"], "left")
    pieces = F.split(F.col("text"), PATTERN, -1)
    joined = let(pieces, lambda p: F.concat(F.array_join(F.flatten(F.zip_with(F.slice(p, 1, F.size("made")), F.col("made"), lambda a, x: F.array(a, x["surrogate"]))), ""), F.element_at(p, -1)))
    entities = F.filter("made", lambda x: ~x["kind"].isin("NONE", "CODE"))
    entities = F.coalesce(entities, F.array().cast("array<struct<kind:string,surrogate:string>>"))
    return rows.select("doc_id", F.when(F.col("made").isNotNull(), joined).otherwise(F.col("text")).alias("text"), F.size(entities).alias("n_entities"), entities.alias("entities"))
