"""Personal information in free text: find and replace by typed placeholders (problem 8).

Regular expressions propose spans; each proposal has a base score, validators (PESEL, NIP, identity
card, Luhn, ISO 7064 mod 97-10) and context words near it raise or lower the score, and proposals of
at least ``threshold`` stand. Where proposals overlap, the higher score wins, then the longer, then
the earlier.

A name is a surname with given names or an initial, found by its shape (capitalised words) and by what
speaks for a person: a common given name or surname ending, an initial, a signature or the like before it, a
title, kinship, profession or verb of speech beside it. Whoever bears it doesn't matter: the name of a
historical person in running text is replaced too. What names a thing is none: streets, schools, prizes and
monuments called after a person, numbered parts and groups.

The words of a text decide which rules are tried on it at all. One pass over Arrow batches, no shuffle.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("name", "email", "phone", "id_number", "address")

#: Common given names (Polish, English, German).
GIVEN_NAMES = """
Adam Agata Agnieszka Aleksander Aleksandra Alicja Andrzej Aneta Anna Antoni Barbara Bartosz Beata Bogdan Bożena Celina
Cezary Czesław Damian Daniel Danuta Dariusz Dawid Dorota Edward Elżbieta Emilia Ewa Ewelina Filip Franciszek Gabriela
Genowefa Grażyna Grzegorz Halina Hanna Helena Henryk Irena Iwona Jacek Jadwiga Jakub Jan Janina Janusz Jarosław Jerzy Joanna
Jolanta Józef Julia Justyna Kamil Karol Karolina Katarzyna Kazimierz Kinga Krystyna Krzysztof Leszek Lucyna Łukasz Maciej
Magdalena Małgorzata Marcin Marek Maria Mariusz Marta Marzena Mateusz Michał Mieczysław Mirosław Monika Natalia Paulina
Paweł Piotr Przemysław Rafał Renata Robert Roman Ryszard Sławomir Stanisław Stefan Sylwia Szymon Tadeusz Teresa Tomasz
Urszula Wanda Wiesław Wiesława Wiktor Witold Władysław Włodzimierz Wojciech Zbigniew Zdzisław Zofia Zuzanna Zygmunt Żaneta
Alice Andrew Arthur Charles David Elizabeth Emily Emma George Grace Harold Helen Henry Jack James Jane John Laura Margaret
Martin Mary Michael Oliver Patricia Paul Peter Richard Ruth Sarah Simon Susan Thomas Victor William
Andreas Anke Bernd Birgit Christian Claudia Dieter Frank Günter Hans Heike Heinrich Helga Ingrid Jürgen Karin Karl Klaus
Matthias Monika Petra Sabine Ursula Ute Uwe Wolfgang
""".split()

#: Usual ends of surnames.
SURNAME_ENDS = re.compile(
    r"(?i)(ski|ska|cki|cka|dzki|dzka|wicz|czyk|czak|szuk|czuk|nek|lak|niak|worth|field|well|son|by|ley|ford|ton|mann|hofer|berg|müller|bauer|stein)$"
)

UP = "A-ZÀ-ÖØ-ÞĀĂĄĆČĎĐĒĘĚĞİŁŃŇŐŘŚŞŠŤŪŮŰŹŻŽ"
LOW = "a-zß-öø-ÿāăąćčďđēęěğıłńňőřśşšťūůűźżž"
#: A capitalised or upper-case word of two letters or more.
CAP = rf"[{UP}](?:[{LOW}]+|[{UP}]+)"
SURNAME = rf"{CAP}(?:-{CAP})?"
NOT_IN_WORD = r"(?<![\w@])"


def _digits(s: str) -> list[int]:
    return [int(c) for c in s if c.isdigit()]


def pesel_ok(s: str) -> bool:
    d = _digits(s)
    return len(d) == 11 and (sum(a * b for a, b in zip(d, (1, 3, 7, 9, 1, 3, 7, 9, 1, 3))) + d[10]) % 10 == 0


def nip_ok(s: str) -> bool:
    d = _digits(s)
    return len(d) == 10 and sum(a * b for a, b in zip(d, (6, 5, 7, 2, 3, 4, 5, 6, 7))) % 11 == d[9]


def identity_card_ok(s: str) -> bool:
    v = [int(c, 36) for c in s if c.isalnum()]
    return len(v) == 9 and sum(a * b for a, b in zip(v, (7, 3, 1, 9, 7, 3, 1, 7, 3))) % 10 == 0


def luhn_ok(s: str) -> bool:
    d = _digits(s)[::-1]
    return len(d) > 1 and (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def mod97_ok(s: str) -> bool:
    c = re.sub(r"\W", "", s).upper()
    return len(c) > 4 and int("".join(str(int(x, 36)) for x in c[4:] + c[:4])) % 97 == 1


def _date_ok(s: str) -> bool:
    d = "".join(c for c in s if c.isdigit())
    return 1 <= int(d[2:4]) % 20 <= 12 and 1 <= int(d[4:6]) <= 31


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: re.Pattern
    score: float
    check: Callable[[str], float] = lambda s: 0.0
    anchor: str = "number"


#: What any match of a rule with this anchor must hold, found by one cheap pass, and how far the match may
#: reach before and after it. Rules are tried only there.
ANCHORS = {
    "at": (re.compile(r"@|[\[(](?:at|małpa)[\])]"), 80, 200),
    "number": (re.compile(r"\d(?:[ .()/-]{0,3}\d){6,}"), 16, 16),
    "code": (re.compile(r"[A-Z]{2,3} ?\d"), 2, 48),
    "postcode": (re.compile(r"\d, (?:\d{2}-\d{3}|\d{5}) [" + UP + r"]"), 80, 80),
    "ulica": (re.compile(r"(?i)(?:ul\.|al\.|pl\.|os\.|ulica|aleja|aleje|plac|osiedle) "), 2, 160),
    "street": (re.compile(r"(?i) (?:Street|Road|Lane|Avenue|Close|Drive|Way|Square|Court|Terrace|Place|Crescent|St\.|Rd\.|Ave\.)"), 120, 80),
    "straße": (re.compile(r"(?i)(?:straße|strasse|str\.|weg|gasse|allee|platz|ring|damm) \d"), 40, 80),
}


#: Anchors that are worth a pass only if the text, in lower case, has one of these words, or holds one of these.
HINT_WORDS = {
    "ulica": frozenset("ul al pl os ulica aleja aleje plac osiedle".split()),
    "street": frozenset("street road lane avenue close drive way square court terrace place crescent st rd ave".split()),
}
HINTS = {
    "at": ("@", "at]", "at)", "małpa"),
    "straße": ("straße ", "strasse ", "str. ", "weg ", "gasse ", "allee ", "platz ", "ring ", "damm "),
}


def _spans(anchor: str, text: str, low: str, words: set[str]) -> list[tuple[int, int]]:
    """Where rules with the anchor may match; overlapping places are one."""
    out: list[tuple[int, int]] = []
    if anchor in HINT_WORDS and words.isdisjoint(HINT_WORDS[anchor]):
        return out
    if anchor in HINTS:
        for h in HINTS[anchor]:
            if h in low:
                break
        else:
            return out
    pattern, before, after = ANCHORS[anchor]
    for m in pattern.finditer(text):
        a, b = max(0, m.start() - before), min(len(text), m.end() + after)
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def _rules() -> list[Rule]:
    c = lambda p: re.compile(p)
    dot = r"(?:\.|\[dot\]|\[kropka\]|\(dot\)|\(kropka\)| \(dot\) | \(kropka\) | \[dot\] )"
    at = r"(?:@| @ |\[at\]|\(at\)| \(at\) | \[at\] |\(małpa\)| \(małpa\) )"
    word = rf"{CAP}(?:-{CAP})*"
    # the further words of a town must not begin the next sentence: neither one of these nor a word with a verb or the like after it
    following = r"(?!(?:Tel|Fax|Kom|Nr|Str|PESEL|NIP|ISBN|ID|Pisz|Dzwoni|Kontakt|Mail|Adres|Odbi|Prosz|Przesy|Mieszka|Zdj|Call|Write|Contact|Phone|Lives|Anruf|Wohnt|Hinweise|Ausweis|Unterschrift|Signed|Autor|Hasło)\w*)"
    inside = rf"(?![\w-])(?! (?!(?:oraz|i|a|lub|albo|tel|kom|fax|nr|w|we|do|od|z|jest|and|or|und|oder|am|an|in|im|bei|upon|on|nad)\b)[{LOW}])"
    town = rf"{word}(?: (?:(?:am|an der|in der|im|bei|upon|on|nad|i) )?{following}{word}{inside}){{0,3}}"
    # a town without postcode must not begin the next sentence
    lone = rf"(?:, (?!(?:Tel|Fax|Kom|Nr|Str|PESEL|NIP|ISBN|ID)\b){town}(?= *(?:[.,;<\[\n()]|[–-](?:[\s<]|$)|$)| [{UP}\d]| (?:tel|kom|nr|wersja|dowód)\b))?"
    title = r"(?:(?i:ks|bp|abp|kard|gen|płk|ppłk|mjr|kpt|por|rtm|marsz|hetm|adm|św|bł|dr|prof|inż|o)\. ?)"
    street = rf"(?:\d{{1,2}} )?{title}{{0,3}}(?:[{UP}]\. ?){{0,2}}{word}(?: (?:i |{title})?{word}){{0,4}}"
    return [
        Rule("email", c(rf"(?<![\w.+@=/-])[\w][\w.+-]*{at}[\w-]+(?:{dot}[\w-]+)*{dot}[A-Za-z]{{2,}}(?![\w@])"), 0.9, anchor="at"),
        Rule("phone", c(r"(?<![\w+.])(?:\+48|0048|\(\+48\)|\(0048\))[ .-]?(?:\d{3}[ .-]?\d{3}[ .-]?\d{3}|\d{2}[ .-]?\d{3}[ .-]?\d{2}[ .-]?\d{2})(?![\w-]*\d)"), 0.8),
        Rule("phone", c(r"(?<![\w.-])\d{3}-\d{3}-\d{3}(?![.-]?\d)(?!\w)"), 0.5),
        Rule("phone", c(r"(?<![\w.-])\d{3} \d{3} \d{3}(?! \d{3}(?![\d-]))(?![.-]?\d)(?!\w)"), 0.5),
        Rule("phone", c(r"(?<![\w.)-])(?:\(0?\d{2}\)|0\d{2}) ?\d{3}[ -]\d{2}[ -]\d{2}(?! \d{2}(?![\d-]))(?![.-]?\d)(?!\w)"), 0.6),
        Rule("phone", c(r"(?<![\w.-])\d{9}(?!\w)"), 0.3),
        Rule("phone", c(r"(?<![\w+.])(?:\+44|0044) ?(?:\(0\) ?)?\d{2,4} ?\d{3,4} ?\d{3,4}(?!\w)"), 0.8),
        Rule("phone", c(r"(?<![\w+.])(?:\(0\d{3,4}\) ?|0\d{4} )\d{3} ?\d{3}(?!\w)"), 0.6),
        Rule("phone", c(r"(?<![\w+.-])(?:\+1[ .-]?|1-)?(?:\(\d{3}\) ?|\d{3}[.-])\d{3}[.-]\d{4}(?![\w-])"), 0.6),
        Rule("phone", c(r"(?<![\w+.])(?:\+49|0049) ?(?:\(0\) ?)?\d{2,5}[ /-]?\d{3,8}(?:[ -]\d{2,6})?(?!\w)"), 0.8),
        Rule("phone", c(r"(?<![\w+.])0\d{2,4}/\d{5,9}(?:-\d{1,4})?(?!\w)"), 0.6),
        Rule("phone", c(r"(?<![\w+.])\+\d{1,3}(?:[ .-]?\d{2,4}){3,4}(?!\w)"), 0.6),
        Rule("phone", c(r"(?<![\w+.])\+\d{1,3}[ .-]\d(?:[ .-]?\d{2,4}){3,4}(?!\w)"), 0.6, lambda s: 0.0 if 9 <= len(_digits(s)) <= 15 else -0.6),
        Rule("id_number", c(r"(?<![\w.+/=-])\d{6} ?\d{5}(?![\w-])"), 0.4, lambda s: (0.2 if pesel_ok(s) else 0) - (0 if _date_ok(s) else 0.2)),
        Rule("id_number", c(r"(?<![\w.+/=-])\d{3}-\d{3}-\d{2}-\d{2}(?![\w-])"), 0.5, lambda s: 0.3 if nip_ok(s) else -0.1),
        Rule("id_number", c(r"(?<![\w.+/=-])\d{3}-\d{2}-\d{2}-\d{3}(?![\w-])"), 0.4, lambda s: 0.3 if nip_ok(s) else -0.1),
        Rule("id_number", c(r"(?<![\w.+/=-])\d{10}(?![\w-])"), 0.3, lambda s: 0.15 if nip_ok(s) else 0),
        Rule("id_number", c(r"(?<![\w.+/=-])[A-Z]{3} ?\d{6}(?![\w-])"), 0.5, lambda s: 0.3 if identity_card_ok(s) else 0, anchor="code"),
        Rule("id_number", c(r"(?<![\w.+/=-])\d{3}([ -])\d{2}\1\d{4}(?![\w-])"), 0.5),
        Rule("id_number", c(r"(?<![\w.+/=-])[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D Z](?![\w-])"), 0.6, anchor="code"),
        Rule("id_number", c(r"(?<![\w.+/=-])[A-Z]{2} ?\d{3} ?\d{4}(?![\w-])"), 0.4, anchor="code"),
        Rule("id_number", c(r"(?<![\w.+/=-])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\w-])"), 0.3, lambda s: 0.5 if mod97_ok(s) else 0, anchor="code"),
        Rule("id_number", c(r"(?<![\w.+/=-])\d{4}([ -]?)\d{4}\1\d{4}\1\d{1,7}(?![\w-])"), 0.3, lambda s: 0.3 if luhn_ok(s) else 0),
        Rule("address", c(rf"{NOT_IN_WORD}(?i:ul\.|al\.|pl\.|os\.|ulica|aleja|aleje|plac|osiedle) {street} \d+[a-zA-Z]?\b(?:/\d+[a-z]?)?(?: (?:m\.|lok\.|/) ?\d+[a-z]?)?(?:, \d{{2}}-\d{{3}} {town}|{lone})"), 0.9, anchor="ulica"),
        Rule("address", c(rf"{NOT_IN_WORD}(?:(?i:Apt|Flat|Suite|Unit)\.? \w+, )?\d{{1,4}}[a-zA-Z]? {CAP}(?: {CAP}){{0,2}} (?i:Street|Road|Lane|Avenue|Close|Drive|Way|Square|Court|Terrace|Place|Crescent|St\.|Rd\.|Ave\.)(?:, {town}, [A-Z]{{1,2}}\d[\dA-Z]? \d[A-Z]{{2}}|, {town},? [A-Z]{{2}} \d{{5}}|{lone})"), 0.65, lambda s: -0.2 if s.isupper() else 0, anchor="street"),
        Rule("address", c(rf"{NOT_IN_WORD}{CAP}(?i:straße|strasse|str\.|weg|gasse|allee|platz|ring|damm) \d+[a-z]?\b(?:, \d{{5}} {town}|{lone})"), 0.8, anchor="straße"),
        Rule("address", c(rf"{NOT_IN_WORD}{CAP}(?: {CAP}){{0,3}} \d+[a-zA-Z]?(?:/\d+[a-z]?)?, (?:\d{{2}}-\d{{3}}|\d{{5}}) {town}"), 0.7, anchor="postcode"),
    ]


#: Words that raise or lower the score of a proposal that follows (or precedes) them.
NEAR = {
    "phone": (re.compile(r"(?i)(tel|kom|fax|phone|mobile|call|dzwoni|odbiera|telefon|answers|anruf|ruf|numer)\b[^\n]{0,22}$"), 0.3),
    "id_number": (re.compile(r"(?i)(pesel|nip|dow[oó]d|ewidencyjn|osoby|podani|wpisano|numer|identity|document|id no|number|ausweis|nummer|passport|paszport|ssn|kont[oa]|iban|card|kart[aąyę])[^\n]{0,24}$"), 0.3),
    "address": (re.compile(r"(?i)(adres|mieszka|zam\.|przesyłki|odbiór|address|lives|collected|wohnt|anschrift|abholung)[^\n]{0,30}$"), 0.2),
    "email": (re.compile(r"(?i)(mail|kontakt|pisz|adres|write|remarks|contact|hinweise)[^\n]{0,24}$"), 0.1),
}
AGAINST = re.compile(r"(?i)(\binw\.?|\binv\.?(?: no\.?)?|inv\.-nr\.|isbn|issn|wersja|version|\bdoi|oclc|\bid=|sygn\.|nr kat\.|katalog\w*)[ :]*[\w.-]{0,4} ?$")
ID_ONLY = re.compile(r"(?i)(pesel|nip|dow[oó]d|ewidencyjn|wpisano|identity|id no|ausweis|passport|paszport)[^\n\d]{0,18}$")
UNIT = re.compile(r" ?(?:m³|m²|km|kg|zł|°|%|mm|cm|ha\b)")
URL = re.compile(r"(?i)\b(?:https?://|www\.)[^\s\]<>|]+")
#: What stands before a signature or the like. All in lower case.
SIGNATURES = (
    "przez:", "nadesłał", "nadesłał(a)", "podpisano:", "podpisał", "podpisał(a)", "podpisał(a):", "podpisał:", "udzielił", "udzielił(a)", "autor:", "autorka:", "signed:", "sent in by", "checked by",
    "written by", "unterschrift:", "eingesandt von", "geprüft von", "verfasst von", "~~~~",
)
#: Words after which a person is named, and words that may stand between; and words that follow a person's name.
PERSON_BEFORE = (
    "napisał", "napisała", "pisał", "pisała", "spotkał", "spotkała", "poznał", "poznała", "rozmowa", "rozmowy", "rozmawiał", "rozmawiała", "wywiad", "zdaniem", "pan", "pani", "pana", "panią", "panu", "panem",
    "dr", "prof.", "mgr", "inż.", "mec.", "ks.", "pisarz", "pisarka", "poeta", "poetka", "malarz", "malarka", "aktor", "aktorka", "lekarz", "lekarka", "żona", "żoną", "żonę", "mąż", "mężem", "syn", "syna", "synem", "córka",
    "córką", "córki", "brat", "bratem", "siostra", "siostrą", "mr", "mr.", "mrs", "mrs.", "ms", "ms.", "miss", "met", "married", "husband", "wife", "writer", "poet", "painter", "herr", "herrn", "frau", "autorin",
    "schriftsteller", "schriftstellerin", "traf", "ehefrau", "ehemann",
)
BETWEEN = ("to", "go", "ją", "się", "z", "ze", "niejaki", "niejaka", "him", "her", "with")
PERSON_AFTER = (
    "urodził", "urodziła", "urodzony", "urodzona", "zmarł", "zmarła", "napisał", "napisała", "powiedział", "powiedziała", "mówi", "pisze", "mieszka", "said", "says", "wrote", "writes", "lives", "was born", "died",
    "schrieb", "sagte", "wohnt", "wurde geboren", "(ur.", "(born", "(geb.",
)


def _any(words: tuple[str, ...]) -> str:
    """A pattern of the words, longest first, that Python and the JVM read alike."""
    return "(?:" + "|".join(re.sub(r"([().+*?])", r"\\\1", w) for w in sorted(words, key=lambda w: (-len(w), w))) + ")"


BEFORE_NAME = re.compile(rf"(?i)(?:{_any(SIGNATURES)}|(?P<star>^\*|\n\*))[ '\[*]*$")
AFTER_NAME = re.compile(r"(?i)['\]]* *(\(dyskusja\)|\(talk\)|\(diskussion\)|[–-] opiekun|\(maintainer|betreut diese)")
#: A person is named after this, or before this.
TO_PERSON = re.compile(rf"(?i:{_any(PERSON_BEFORE)})(?: {_any(BETWEEN)})? (?=[{UP}][{LOW}{UP}.])")
FROM_PERSON = re.compile(rf"{CAP} (?={_any(PERSON_AFTER)}(?![{LOW}]))")
LED = re.compile(rf"(?<!\w)(?i:{_any(PERSON_BEFORE)})(?: {_any(BETWEEN)})? $")
LEADING = re.compile(rf" (?={_any(PERSON_AFTER)}(?![{LOW}]))")
PAIR = re.compile(
    rf"(?<![\w.@-])(?:{SURNAME}, (?:{CAP}(?: {CAP})?|[{UP}]\.)(?![\w@-])"
    rf"|(?:[{UP}]\. ?){{1,2}}{SURNAME}(?![\w@-])|{CAP}(?: {CAP})?(?: [{UP}]\.)? {SURNAME}(?![\w@-])|{SURNAME} [{UP}]\.(?! [{UP}]))"
)
GIVEN = frozenset(x.lower() for x in GIVEN_NAMES)
#: Capitalised words in names of places, institutions and periods.
NOT_FAMILY = frozenset(
    """street road lane avenue close drive way square court terrace place crescent platz park hall island church college school
    university prize cup airport station bridge county city brytania zamek rynek uniwersytet szkoła kościół pałac muzeum ulica plac aleja most dworzec dolina góra góry jezioro rzeka
    instytut akademia teatr urząd wydawnictwo nagroda puchar liga wojna powstanie bitwa dynastia republika królestwo castle museum institute academy theatre river lake mount war battle
    republic kingdom schloss museum universität brücke kirche see fluss berg krieg""".split()
)
#: What stands before letters and names that are no person's: streets, patrons, numbering.
NOT_PERSON = re.compile(
    r"(?i)(?:\b(?:ul|al|pl|os|św|im|pkt|st)\.|\b(?:ulica|ulicy|aleja|aleje|plac|placu|osiedle|imienia|witamin\w*|grup\w*|klas\w*|typ\w*|punkt\w*|tom|część|rozdział|liga|wariant|plan|pomnik\w*|nagrod\w*|szkoł\w*|uniwersytet\w*|muzeum|"
    r"monument of|statue of|university of|vitamin|group|class|type|part|volume|chapter|section|gruppe|klasse|teil|band|abschnitt|saint|sankt))[ \n]*$"
)


def _name_score(text: str, start: int, end: int) -> float:
    s = text[start:end]
    words = re.findall(r"[^\s,]+", s)
    initials = [w for w in words if w.endswith(".")]
    given = [w for w in words if w.lower() in GIVEN]
    plain = [w for w in words if not w.endswith(".") and w.lower() not in GIVEN]
    family = words[0] if "," in s else plain[-1] if plain else ""
    if not family or not given and not initials and ("," in s or len(plain) < 2):
        return 0.0
    left = text[max(0, start - 40) : start]
    signed = BEFORE_NAME.search(left if start >= 40 else "\n" + left)
    signed = bool(signed and not signed["star"] or AFTER_NAME.match(text, end))
    led = bool(LED.search(left) or LEADING.match(text, end))
    if any(w.lower() in NOT_FAMILY for w in plain) and not given:
        return 0.0
    first = words[0].lower() in GIVEN or words[0].endswith(".")  # a capitalised word before a given name may only begin the sentence
    if given:
        score = 0.6 if first else 0.5
    elif initials:
        score = 0.6 if first else 0.35
    else:  # by shape: two or three capitalised words that are neither given names of the list nor initials
        score = 0.25 if signed or not s.isupper() else 0.0  # in a shouted sentence every word has the shape
    if first and (family.lower() in NOT_FAMILY or NOT_PERSON.search(left) or not given and text[:start].endswith("\n") and re.fullmatch("[IVX]+", words[0][:-1])):
        score -= 0.4
    elif not first and NOT_PERSON.search(left):
        score -= 0.4
    # words beyond one given name and the surname
    score -= 0.4 * max(0, len(plain) - 1) if given or initials else 0.2 * max(0, len(plain) - 2)
    return score + (0.25 if SURNAME_ENDS.search(family) else 0.0) + (0.5 if signed else 0.0) + (0.35 if led else 0.0)


#: A name has a given name or an initial, or stands at a label; how far it may reach from there.
CAPITALISED = re.compile(rf"(?<!\w)[{UP}]\w+")
WORDS = re.compile(r"\w+")
INITIAL = re.compile(rf"(?<!\w)[{UP}]\.")
LABELS = ("przez:", "nadesłał", "podpisał", "podpisano", "udzielił", "autor:", "autorka:", "signed:", "sent in by", "checked by", "written by", "unterschrift:", "eingesandt von", "geprüft von", "verfasst von", "~~~~",
          "(dyskusja", "(talk", "(diskussion", "(maintainer", "– opiekun", "- opiekun", "betreut diese")
#: The first words of the labels, and of what speaks for a person: without one of them the text isn't searched for the whole.
LABEL_WORDS = frozenset(WORDS.match(w.lstrip("(–- "))[0] for w in LABELS if w[0] != "~")
LEAD_WORDS = frozenset(WORDS.match(w.lstrip("("))[0] for w in (*PERSON_BEFORE, *PERSON_AFTER))
REACH = 90


def _names(text: str, low: str, words: set[str]) -> Iterator[tuple[int, int, float]]:
    places = []
    if not words.isdisjoint(GIVEN):
        places = [m.start() for m in CAPITALISED.finditer(text) if m[0].lower() in GIVEN]
    places += [m.start() for m in INITIAL.finditer(text)]
    if not words.isdisjoint(LABEL_WORDS) or "~~~~" in low:
        for w in LABELS:
            at = low.find(w)
            while at >= 0:
                places.append(at)
                at = low.find(w, at + 1)
    for w in words & LEAD_WORDS:
        at = low.find(w)
        while at >= 0:
            # to the person who follows, or from the one before
            if TO_PERSON.match(text, at) or text[max(0, at - 2) : at].endswith((" ", " (")) and FROM_PERSON.search(text, max(0, at - 30), at + 20):
                places.append(at)
            at = low.find(w, at + 1)
    spans: list[list[int]] = []
    for p in sorted(places):
        if spans and p - REACH <= spans[-1][1]:
            spans[-1][1] = p + REACH
        else:
            spans.append([max(0, p - REACH), p + REACH])
    for a, b in spans:
        yield from _names_in(text, a, b)


def _names_in(text: str, at: int, stop: int) -> Iterator[tuple[int, int, float]]:
    while m := PAIR.search(text, at, stop):
        start, end, best = m.start(), m.end(), None
        # a match may carry a capitalised word too many at either end
        bounds = {(start, end)}
        cuts = [x.start() + start for x in re.finditer(r"(?<= )\S", m[0])]
        ends = [x.start() + start for x in re.finditer(r",? ", m[0])]
        bounds |= {(c, end) for c in cuts} | {(start, e) for e in ends}
        for a, b in sorted(bounds, key=lambda x: (x[0] - x[1], x[0])):
            if PAIR.fullmatch(text, a, b) and (s := _name_score(text, a, b)) > 0 and (best is None or s > best[2]):
                best = (a, b, s)
        if best:
            yield best
        at = best[1] if best and best[2] >= 0.6 else m.start() + max(1, len(re.match(r"\S*\s?", m[0])[0]))


def _score(r: Rule, text: str, m: re.Match) -> float:
    score, before = r.score + r.check(m[0]), text[max(0, m.start() - 48) : m.start()]
    near, gain = NEAR[r.kind]
    if near.search(before):
        score += gain
    if r.kind in ("phone", "id_number") and (AGAINST.search(before) or UNIT.match(text, m.end())):
        score -= 0.8
    if r.kind == "phone" and ID_ONLY.search(before):
        score -= 0.3
    return score


def find(text: str, threshold: float = 0.6, rules: list[Rule] | None = None) -> list[tuple[int, int, str, float]]:
    """(start, end, kind, score) of the personal information in a text, in order, without overlaps."""
    low = text.lower()
    if len(low) != len(text):  # a few letters become two
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    words = set(WORDS.findall(low))
    found = [(a, b, "name", s) for a, b, s in _names(text, low, words)]
    urls = [m.span() for m in URL.finditer(text)] if "://" in low or "www." in low else []
    for anchor, group in BY_ANCHOR.items() if rules is None else ((r.anchor, [r]) for r in rules):
        if spans := _spans(anchor, text, low, words):
            for r in group:
                for x, y in spans:
                    for m in r.pattern.finditer(text, x, y):
                        if r.kind == "email" or not any(c <= m.start() < d for c, d in urls):
                            found.append((*m.span(), r.kind, _score(r, text, m)))
    if not found:
        return []
    taken: list[tuple[int, int, str, float]] = []  # in order of start
    for x in sorted((x for x in found if x[3] >= threshold), key=lambda x: (-round(x[3], 6), x[0] - x[1], x[0])):
        i = bisect.bisect_left(taken, x[:2])
        if (i == 0 or taken[i - 1][1] <= x[0]) and (i == len(taken) or taken[i][0] >= x[1]):
            taken.insert(i, x)
    return taken


RULES = _rules()
BY_ANCHOR = {k: [r for r in RULES if r.anchor == k] for k in ANCHORS}


def personal_information(docs: DataFrame, doc_id: str, text: str, threshold: float = 0.6) -> DataFrame:
    """(doc_id, found array<struct<kind, passage, start, score>>, redacted): one row per row of docs.

    redacted is the text with each passage replaced by its kind in brackets, such as ``[EMAIL]``; all
    else stays letter by letter. kind is name, email, phone, id_number or address. Null text gives null
    redacted and no passages, an empty text itself; repeated rows are kept; other columns are ignored.
    Whole texts are searched.
    """
    schema = f"`{doc_id}` {docs.schema[doc_id].dataType.simpleString()}, found array<struct<kind:string,passage:string,start:int,score:double>>, redacted string"
    struct = pa.struct([("kind", pa.string()), ("passage", pa.string()), ("start", pa.int32()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists, texts = [], []
            for t in b.column(1).to_pylist():
                spans = find(t, threshold) if t else []
                lists.append([{"kind": k, "passage": t[x:y], "start": x, "score": round(s, 6)} for x, y, k, s in spans])
                if spans:
                    parts, at = [], 0
                    for x, y, k, _ in spans:
                        parts += [t[at:x], f"[{k.upper()}]"]
                        at = y
                    t = "".join([*parts, t[at:]])
                texts.append(t)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lists, pa.list_(struct)), pa.array(texts, pa.string())], [doc_id, "found", "redacted"])

    return docs.select(F.col(doc_id), F.col(text)).mapInArrow(run, schema)


def passages(docs: DataFrame, doc_id: str, text: str, threshold: float = 0.6) -> DataFrame:
    """(doc_id, kind, passage, start, score): one row per passage of personal_information()."""
    schema = f"`{doc_id}` {docs.schema[doc_id].dataType.simpleString()}, kind string, passage string, start int, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, k, t[x:y], x, round(s, 6)) for i, t in enumerate(b.column(1).to_pylist()) if t for x, y, k, s in find(t, threshold)]
            if rows:
                at, *rest = zip(*rows)
                cols = [b.column(0).take(pa.array(at)), *(pa.array(c, t) for c, t in zip(rest, (pa.string(), pa.string(), pa.int32(), pa.float64())))]
                yield pa.RecordBatch.from_arrays(cols, [doc_id, "kind", "passage", "start", "score"])

    return docs.filter(F.col(text) != "").select(F.col(doc_id), F.col(text)).mapInArrow(run, schema)
