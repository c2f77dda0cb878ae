"""PII replacement by surrogates.

Detected entities are replaced by values of the same type and form that a key determines: letters stay letters of their
script and case, digits stay digits, separators stay; addresses keep valid octets, card numbers keep a valid or invalid
check digit, names keep gender, script and, where lists exist, are names again. Equal entities get equal surrogates
everywhere (also in other case), so coreference holds. Parts that several entities share are entities of their own: an
e-mail's domain, so that colleagues stay colleagues, and a surname, so that "Mr. Smith" stays the John Smith of the same
text. In a text with a titled name, its later mentions without a title (whole, given name or surname) are replaced too.

Distinctness is checked on the distinct entities of the whole corpus, first of the shared parts, then of what is built on
them: a surrogate that two entities share, or that is itself an entity of the corpus, is drawn again for all but the
smallest of them until none is left. From draw ``WIDE_DRAW`` on the form widens with each draw (more letters or digits,
octets of any width), so a crowded form ends too. Only entities drawn more than once must be carried to the documents; all
others are recomputed where they stand, so texts are not shuffled.

The key comes from the caller or from ``spark.quillfund.surrogates.key``; there is no default that others could know. If
neither is set, a random key is drawn, so that surrogates of one call agree with each other and with nothing else.
"""

from __future__ import annotations

import hashlib
import re
import secrets
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillfund.llm.common import attach, keyed, table, written

#: From this draw on an IPv4 address, which has no wider form, gets an IPv6 one.
LONG_DRAW = 64
#: The first draw that may leave the form: one symbol more than the entity has, and another one with each further draw.
WIDE_DRAW = 8
KEY_SETTING = "spark.quillfund.surrogates.key"

# Given names by script and gender, honorifics by gender.
NAMES = {
    ("latin", "f"): ["Alice", "Anna", "Beatrice", "Clara", "Diana", "Elena", "Emma", "Flora", "Greta", "Helena", "Ines", "Julia", "Laura", "Lucia", "Maria", "Marta", "Nora", "Olivia", "Paula", "Rosa", "Sarah", "Sofia", "Teresa", "Vera"],
    ("latin", "m"): ["Adam", "Albert", "Bruno", "Carlos", "Daniel", "David", "Erik", "Felix", "George", "Hugo", "Ivan", "James", "Jonas", "Lukas", "Marco", "Martin", "Oscar", "Pablo", "Paul", "Peter", "Robert", "Simon", "Thomas", "Victor"],
    ("cyrillic", "f"): ["Анна", "Вера", "Дарья", "Елена", "Ирина", "Мария", "Нина", "Ольга"],
    ("cyrillic", "m"): ["Алексей", "Борис", "Виктор", "Дмитрий", "Иван", "Николай", "Олег", "Пётр"],
    ("greek", "f"): ["Άννα", "Ελένη", "Ιωάννα", "Μαρία", "Σοφία"],
    ("greek", "m"): ["Γιώργος", "Δημήτρης", "Κώστας", "Νίκος", "Πέτρος"],
}
HONORIFICS = {
    "f": ["Mrs", "Ms", "Miss", "Frau", "Mme", "Madame", "Mlle", "Sra", "Señora", "Srta", "Signora", "Г-жа", "Κυρία"],
    "m": ["Mr", "Herr", "Monsieur", "Sr", "Señor", "Signor", "Г-н", "Κύριος"],
    "n": ["Dr", "Prof", "Dra", "Doctor", "Professor"],
}
# What a name follows; after the second kind only one that begins with a given name of the list above.
CUES = ["my name is", "mein Name ist", "ich heiße", "je m'appelle", "je m’appelle", "mon nom est", "me llamo", "mi nombre es"]
WEAK_CUES = ["I am", "I'm", "I’m", "ich bin", "je suis", "soy"]
# What a date of birth follows, what ends a street's name, and what begins one.
BIRTH = ["born", "born on", "date of birth", "DOB", "geboren am", "geb.", "né le", "née le", "nacido el", "nacida el"]
STREETS = ["Street", "St", "Road", "Rd", "Avenue", "Ave", "Lane", "Ln", "Drive", "Boulevard", "Blvd", "Square", "Court"]
STREETS_FIRST = ["rue", "avenue", "calle", "avenida"]
# Capitalised words that are no name after a title, and names that are ordinary words too.
NO_NAMES = ["A", "An", "And", "Are", "As", "At", "But", "By", "For", "From", "Have", "He", "Her", "His", "How", "I", "If", "In", "Is", "It", "My", "No", "Not", "Of", "On", "Or", "Our", "She", "So", "That", "The", "Their", "There", "They", "This", "To", "Was", "We", "What", "When", "Who", "With", "You", "Your", "Und", "Ist", "Der", "Die", "Das", "Ich", "Sie", "Wir", "Et", "Les", "Une", "Est", "Los", "Las", "Una", "Es"]
ORDINARY = ["April", "Art", "August", "Bill", "Case", "Church", "Day", "Grant", "Hope", "House", "Joy", "June", "Lane", "Mark", "May", "Street", "Summer", "Sunday", "Will", "Winter"]
# Letters that alternate in invented surnames.
SYLLABLES = {"latin": ("bcdfghklmnprstvw", "aeiou"), "cyrillic": ("бвгдзклмнпрст", "аеиоу"), "greek": ("βγδζκλμνπρστ", "αειου")}
# End of fixed values.

_COMMON = {*NO_NAMES, *ORDINARY}
_GIVEN = {name: (script, gender) for (script, gender), names in NAMES.items() for name in names}
_GENDER = {title: gender for gender, titles in HONORIFICS.items() for title in titles}
_TITLES = "|".join(sorted((re.escape(h) for hs in HONORIFICS.values() for h in hs), key=len, reverse=True))
_FIRST = f"[A-ZÀ-ÖØ-ÞΆ-ΏΑ-ΫЀ-Я{''.join(c for c in map(chr, range(0x100, 0x250)) if c.isupper())}]"
_WORD = rf"{_FIRST}[\w'’-]*[^\W\d_]"
_CAPITAL = rf"(?!(?:{'|'.join(NO_NAMES)})\b){_WORD}"
#: A surname, or given names or initials and a surname; behind a title of one gender any capitalised word can be one.
_INITIALS = rf"(?:{_FIRST}\. ?){{0,2}}{_FIRST}\. "
_NAME, _TITLED = (rf"(?:{word} (?:{_FIRST}\. )?{_CAPITAL}|{_INITIALS}{word}|{word})" for word in (_CAPITAL, _WORD))
_SOME = lambda words: "|".join(sorted(map(re.escape, words), key=len, reverse=True))
_DATE = r"\d{1,2}[./-]\d{1,2}[./-](?:19|20)\d{2}|(?:19|20)\d{2}-\d{2}-\d{2}"
#: Type and pattern of what is detected; earlier ones win.
PATTERNS = [
    ("email", r"[\w.%+-]*[^\W_]@[^\W_](?:[\w-]*[^\W_])?(?:\.[^\W_](?:[\w-]*[^\W_])?)*\.[^\W\d_]{2,}"),
    ("secret", r"(?i:\b(?:token|secret|api[_-]?key|password|passwd)\b[\"']?\s*[=:]\s*)[\"'](?P<secret>[^\s\"']{6,})[\"']"),
    ("secret", r"(?i:\b(?:token|secret|api[_-]?key|password|passwd)\b\s*[=:]\s*)(?P<bare>(?=[\w.+/~-]*\d)[A-Za-z][\w.+/~-]{4,}[A-Za-z0-9])"),
    ("secret", r"\b(?P<known>AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{20,}|sk_(?:live|test)_[A-Za-z0-9]{10,}|xox[abpr]-[A-Za-z0-9-]{9,}[A-Za-z0-9])\b"),
    ("secret", r"-----BEGIN (?:[A-Z]+ ){0,2}PRIVATE KEY-----(?P<pem>[A-Za-z0-9+/=\s]+)-----END"),
    ("phone", r"(?<![\w.+-])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}(?![\w-])|(?<![\w.+-])\(\d{3}\) ?\d{3}-\d{4}(?![\w-])|(?<![\w.+-])\d{3}-\d{3}-\d{4}(?![\w-])|(?<![\w.,+/-])0\d{1,4}[ /-]\d{3,4}[ -]\d{3,4}(?![\w-]|[.,]\d)|(?<![\w.,+/-])[2-9]\d{2}-\d{4}(?![\w/-]|[.,]\d)"),
    ("ssn", r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"),
    ("ip", r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\w)"),
    ("ipv6", r"(?<![\w:])(?=[0-9A-Fa-f:]*\d)(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![\w:])"),
    ("iban", r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b"),
    ("card", r"(?<![\w.-])(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3})(?![\w-])"),
    ("name", rf"\b(?P<title>{_SOME(HONORIFICS['f'] + HONORIFICS['m'])})\b\.? (?P<name>{_TITLED})|\b(?P<rank>{_SOME(HONORIFICS['n'])})\b\.? (?P<ranked>{_NAME})"),
    ("name", rf"(?i:(?<!\w)(?:{_SOME(CUES)})) (?P<called>{_NAME})|(?i:(?<!\w)(?:{_SOME(WEAK_CUES)})) (?P<known_name>(?:{_SOME(_GIVEN)}) {_CAPITAL})"),
    ("date", rf"(?i:\b(?:{_SOME(BIRTH)}))[ :]{{1,2}}(?P<date>{_DATE})(?!\d)"),
    ("street", rf"(?<![\w.,-])\d{{1,4}} (?P<street>{_CAPITAL}(?: {_CAPITAL})?) (?:{_SOME(STREETS)})\b|(?<![\w.,-])\d{{1,4}},? (?:{_SOME(STREETS_FIRST)}) (?P<street_after>{_CAPITAL})"),
]
_FIND = re.compile("|".join(f"(?P<t{k}>{pattern})" for k, (_, pattern) in enumerate(PATTERNS)))
#: Without the patterns that begin with cues or end in a street's kind, for texts that have none of these words.
_CUED = len(PATTERNS) - 3
_FIND_PLAIN = re.compile("|".join(f"(?P<t{k}>{pattern})" for k, (_, pattern) in enumerate(PATTERNS[:_CUED])))
_CUE_WORDS = [w.lower() for w in [*CUES, *WEAK_CUES, *BIRTH]]
_STREET = re.compile(rf"\d,? (?:{_FIRST}|{_SOME(STREETS_FIRST)})")
_MAY_TITLE = re.compile(rf"\b(?:{_TITLES})\b")
_DIGITS = re.compile("[0-9@]")
_HINTS = ("token", "secret", "key", "passw")
#: Groups that hold the entity, where it isn't all that the pattern matches.
_INNER = {"secret": ("secret", "bare", "known", "pem"), "name": ("name", "ranked", "called", "known_name"), "date": ("date",), "street": ("street", "street_after")}


def detect(text: str) -> list[tuple[int, int, str, str]]:
    """(begin, end, type, entity) of the entities of a text, left to right, none overlapping. A whole name has the gender of
    its title: type ``name-f``, ``name-m`` or ``name-n``; a lone one is a ``surname``. The entity is what stands there, but
    for a given name that stands alone the whole name that it belongs to."""
    low = text.lower()
    cued = any(w in low and re.search(rf"(?<!\w){re.escape(w)}(?!\w)", low) for w in _CUE_WORDS) or _STREET.search(text)
    if not (cued or _DIGITS.search(text) or any(w in low for w in _HINTS) or any(w in text for w in _GENDER) and _MAY_TITLE.search(text)):
        return []
    found, names = [], {}
    for m in (_FIND if cued else _FIND_PLAIN).finditer(text):
        k = next(k for k in range(len(PATTERNS) if cued else _CUED) if m[f"t{k}"] is not None)
        kind, span = PATTERNS[k][0], m.span()
        if kind in _INNER:
            span = m.span(next(g for g in _INNER[kind] if m[g]))
        value = text[slice(*span)]
        if kind == "name":
            given, _, last = value.rpartition(" ")
            title = m["title"] or m["rank"]
            gender = _GENDER[title] if title else _GIVEN.get(given, ("", "n"))[1]
            whole = re.search(rf"(?<!\w){re.escape(value)} (?P<more>{_CAPITAL})(?![\w@])", text) if not given and value not in _GENDER else None
            if whole:  # a given name alone behind a title, whose surname stands elsewhere
                given, last, kind = value, whole["more"], f"name-{gender}"
                value = f"{given} {last}"
            else:
                kind = f"name-{gender}" if given else "surname"
            names.setdefault(last, ("surname", last))
            if given:
                names.setdefault(given.partition(" ")[0], (kind, value))
                names[value] = (kind, value)
        found.append((*span, kind, value))
    names = {name: entity for name, entity in names.items() if " " in name or _means_a_name(name, text)}
    if names:
        taken = [*found, (len(text), len(text), "", "")]
        again = re.compile(rf"(?<!\w)(?:{'|'.join(sorted(map(re.escape, names), key=len, reverse=True))})(?![\w@])")
        k = 0
        for m in again.finditer(text):
            while taken[k][1] <= m.start():
                k += 1
            if m.end() <= taken[k][0]:
                found.append((*m.span(), *names[m[0]]))
        found.sort()
    return found


def _means_a_name(word: str, text: str) -> bool:
    """Whether a later mention of a lone ``word`` means the name: it is no title and no initial, not a common word by the
    lists above, and the text doesn't have it in lower case."""
    return word not in _GENDER and word not in _COMMON and not word.endswith(".") and not re.search(rf"(?<!\w){re.escape(folded(word))}(?!\w)", text)


def base(kind: str, value: str) -> tuple[str, str] | None:
    """The shared part of an entity, an entity itself: the domain of an e-mail, the surname of a whole name."""
    if kind == "email":
        return "domain", value.rpartition("@")[2]
    return ("surname", value.rpartition(" ")[2]) if kind.startswith("name-") else None


def normal(kind: str, value: str) -> str:
    """What equal entities share: case is ignored, and separators of numbers."""
    value = folded(value)
    return re.sub(r"[ ()./-]", "", value) if kind in ("phone", "card", "iban", "ssn") else value


def folded(value: str) -> str:
    """``value`` in lower case, letter by letter and no longer than it is: letters whose lower case is longer stay."""
    return "".join(low if len(low := c.lower()) == 1 else c for c in value)


class Draw:
    """A stream of numbers that the key, the type, the entity and the number of the draw determine."""

    def __init__(self, key: bytes, kind: str, value: str, draw: int):
        self.seed, self.turn = f"{kind}\0{value}\0{draw}".encode(), 0
        self.key, self.pool = hashlib.blake2b(key, digest_size=32).digest(), 0
        self.left = 0

    def below(self, n: int) -> int:
        if self.left < 1 << 16 or self.left < n * 1024:
            block = hashlib.blake2b(self.seed + self.turn.to_bytes(4, "big"), key=self.key).digest()
            self.turn, self.pool, self.left = self.turn + 1, int.from_bytes(block, "big"), 1 << 512
        self.pool, got = divmod(self.pool, n)
        self.left //= n
        return got


def _letters(c: str) -> tuple[int, int] | None:
    """The range of letters that stand for ``c``: same script, same case."""
    for low, high in (("a", "z"), ("A", "Z"), ("а", "я"), ("А", "Я"), ("α", "ρ"), ("Α", "Ρ"), ("א", "ת"), ("ぁ", "ん"), ("ァ", "ヶ"), ("一", "龥"), ("가", "힣")):
        if low <= c <= high:
            return ord(low), ord(high)
    base = unicodedata.normalize("NFD", c)[0]
    if base != c:
        return _letters(base)
    name = unicodedata.name(c, "").split(" ")
    alphabet = {"LATIN": "az", "CYRILLIC": "ая", "GREEK": "αρ"}.get(name[0]) if c.isalpha() else None
    return alphabet and tuple(ord(x.upper() if "CAPITAL" in name else x) for x in alphabet)


def _masked(value: str, draw: Draw, hexadecimal: bool = False) -> str:
    """The same form: digits for digits, letters of the same script and case for letters, all else unchanged."""
    out = []
    for c in value:
        if c.isdecimal() and c.isascii():
            out.append(str(draw.below(10)))
        elif hexadecimal and c in "abcdefABCDEF":
            out.append("abcdef"[draw.below(6)] if c.islower() else "ABCDEF"[draw.below(6)])
        elif letters := _letters(c):
            out.append(chr(letters[0] + draw.below(letters[1] - letters[0] + 1)))
        else:
            out.append(c)
    return "".join(out)


def _more(count: int, first: str, last: str, draw: Draw) -> str:
    """``count`` further symbols from ``first`` to ``last``."""
    return "".join(chr(ord(first) + draw.below(ord(last) - ord(first) + 1)) for _ in range(count))


def _checked(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def surrogate(key: bytes, kind: str, value: str, draw: int = 0, base_draw: int = 0) -> str:
    """The replacement of ``value``, an entity of type ``kind``, at draw number ``draw``, with its ``base`` at draw number
    ``base_draw``. Case and separators follow the value; everything else follows ``normal(kind, value)`` only."""
    same = normal(kind, value)
    wide = max(0, draw + 1 - WIDE_DRAW)
    stream = Draw(key, kind, same, draw)
    if kind == "domain":
        first, *labels, top = value.split(".")
        first, *rest = _masked(folded(".".join([first, *labels])), stream).split(".")
        host = ".".join([first + _more(wide, "a", "z", stream), *rest])
        return f"{host.upper() if value.isupper() else host}.{top}"
    if kind == "email":
        local, _, domain = value.rpartition("@")
        name = _masked(folded(local), stream) + _more(wide, "a", "z", stream)
        return f"{name.upper() if local.isupper() else name}@{surrogate(key, 'domain', domain, base_draw)}"
    if kind == "ipv6":
        return ":".join(_masked(part if not wide or not part else "0000", stream, True) for part in value.split(":"))
    if kind == "ip" and draw >= LONG_DRAW:
        return "2001:db8:" + ":".join(f"{stream.below(1 << 16):04x}" for _ in range(6))
    if kind == "ip" and wide:
        return ".".join(str(stream.below(256)) for _ in range(4))
    if kind == "ip":
        return ".".join(str(_octet(len(part), stream)) for part in value.split("."))
    if kind in ("phone", "card", "ssn", "iban"):
        fresh = _masked(same, stream) if kind != "phone" or "+" not in same else "+" + _phone(value, same, stream)
        if kind == "phone" and same.startswith("0"):
            fresh = "0" + fresh[1:]
        # Two at least, a group of a phone number.
        fresh += _more(wide + 1 if wide else 0, "0", "9", stream)
        if kind == "card":
            valid = _checked(same)
            last = next(d for d in "0123456789"[int(fresh[-1]) :] + "0123456789" if _checked(fresh[:-1] + d) == valid)
            fresh = fresh[:-1] + last
        if kind == "iban":
            fresh = _account(same, fresh)
        fill = iter(fresh)
        out = [next(fill) if normal(kind, c) else c for c in value]
        return "".join(c.upper() if v.isupper() else c for c, v in zip(out, value, strict=True)) + "".join(fill)
    if kind == "surname":
        tries = iter(lambda: _spelled(value, stream) + _more(wide, *_ends(value), stream), None)
        spelled = next(x for x in tries if x.capitalize() not in _COMMON)
        return spelled.upper() if value.isupper() and len(value) > 1 else spelled
    if kind.startswith("name-"):
        given, _, last = value.rpartition(" ")
        # By the given name alone, so that it is the same for all who bear it, unless whole names collide.
        stream = Draw(key, kind, normal(kind, given) if not draw else same, draw)
        return f"{_given(given, kind[-1], stream, wide)} {surrogate(key, 'surname', last, base_draw)}"
    if kind == "date" and not wide:
        return _day(value, stream)
    if kind == "street":
        return " ".join(_spelled(word, stream) for word in value.split(" ")) + _more(wide, *_ends(value), stream)
    shape = _masked(folded(value), stream, bool(re.fullmatch(r"[0-9a-fA-F]+", value)))
    more = _more(wide, *("09" if same.isdecimal() else "af" if re.fullmatch(r"[0-9a-f]+", same) else "az"), stream)
    return (shape + more).upper() if value.isupper() else shape + more if value.islower() else "".join(c.upper() if v.isupper() else c for c, v in zip(shape, value, strict=True)) + more


def _account(same: str, fresh: str) -> str:
    """An account number with the country of ``same`` and the rest of ``fresh``; its check digits are right if those of
    ``same`` are, and wrong if not."""

    def rest(number: str) -> int:
        return int("".join(str(int(c, 36)) for c in number[4:] + number[:4])) % 97

    right = 98 - rest(same[:2] + "00" + fresh[4:])
    if rest(same) == 1:
        check = right
    else:
        check = int(fresh[2:4])
        check = (check + 1) % 100 if (check - right) % 97 == 0 else check
    return f"{same[:2]}{check:02d}{fresh[4:]}"


def _day(value: str, draw: Draw) -> str:
    """A date written in the same way: another day of the same century, at most the 28th."""
    parts = re.split(r"([./-])", value)
    order = (0, 2, 4) if len(parts[0]) == 4 else (4, 2, 0)
    for k, low, count in zip(order, (40, 1, 1), (60, 12, 28), strict=True):
        n = low + draw.below(count)
        parts[k] = f"{parts[k][:2]}{n % 100:02d}" if len(parts[k]) == 4 else f"{n:0{len(parts[k])}d}"
    return "".join(parts)


def _octet(size: int, draw: Draw) -> int:
    return draw.below(10) if size == 1 else 10 + draw.below(90) if size == 2 else 100 + draw.below(156)


def _phone(value: str, same: str, draw: Draw) -> str:
    """The digits of an international number: the country code stays."""
    country = len(re.match(r"\+(\d{1,3})", value)[1])
    if not re.match(r"\+\d{1,3}[ .(-]", value):
        country = 1
    return same[1 : 1 + country] + _masked(same[1 + country :], draw)


def _script(word: str) -> str | None:
    letter = next((c for c in word if c.isalpha()), "A")
    return next((s for s in ("latin", "cyrillic", "greek") if unicodedata.name(letter, "").startswith(s.upper())), None)


def _ends(word: str) -> tuple[str, str]:
    """The letters that a widened name of this script ends with."""
    return {"cyrillic": ("а", "я"), "greek": ("α", "ρ")}.get(_script(word), ("a", "z"))


def _given(given: str, gender: str, draw: Draw, wide: int = 0) -> str:
    """A given name of the same script and gender; for a title of either, of the gender of the name if it is known."""
    if " " in given or re.fullmatch(r"\w\.(?:\w\.)*", given):
        first, *rest = given.split(" ")
        first = _masked(first, draw) if first.endswith(".") else _given(first, gender, draw, wide)
        return " ".join([first, *(_masked(part, draw) for part in rest)])
    script = _script(given)
    if script is None:
        return _masked(given, draw) + _more(wide, *_ends(given), draw)
    if gender == "n":
        gender = _GIVEN.get(given, (script, "n"))[1]
    choices = NAMES[script, gender] if gender != "n" else NAMES[script, "f"] + NAMES[script, "m"]
    name = choices[draw.below(len(choices))] + _more(wide, *_ends(given), draw)
    return name.upper() if given.isupper() and len(given) > 1 else name


def _spelled(word: str, draw: Draw) -> str:
    """A word that can be spoken, of the same length: consonants and vowels in turn, signs where they stand."""
    kinds = SYLLABLES.get(_script(word))
    if kinds is None:
        shape = _masked(folded(word), draw)
        return shape[:1].upper() + shape[1:]
    turn, out = draw.below(4) == 0, []
    for c in word:
        if c.isalpha():
            fresh = kinds[turn][draw.below(len(kinds[turn]))]
            out.append(fresh.upper() if c.isupper() else fresh)
            turn = not turn
        else:
            out.append(_masked(c, draw))
    return "".join(out)


def _entities(docs: DataFrame) -> DataFrame:
    """The distinct entities of each document: doc_id, t, kind, value (normal form), sample (as written)."""

    def find(batches):
        for batch in batches:
            rows: list[tuple[int, str, str, str]] = []
            for row, text in enumerate(batch.column(2).to_pylist()):
                seen = {}
                for _, _, kind, entity in detect(text):
                    for part in filter(None, ((kind, entity), base(kind, entity))):
                        seen.setdefault((part[0], normal(*part)), part[1])
                rows += [(row, kind, value, sample) for (kind, value), sample in seen.items()]
            take = pa.array([r[0] for r in rows], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), *(pa.array([r[k] for r in rows], pa.string()) for k in (1, 2, 3))], ["doc_id", "t", "kind", "value", "sample"])

    return docs.mapInArrow(find, "doc_id long, t long, kind string, value string, sample string")


def redraws(entities: DataFrame, key: bytes) -> DataFrame:
    """Entities whose surrogates must be drawn again, with their draw number: kind, value, draw. Empty as a rule."""
    shared = F.col("kind").isin("domain", "surname")
    first = written(_settled(entities.where(shared).withColumn("base_draw", F.lit(0)), key), "shared-redraws")
    rest = entities.where(~shared)
    if first.isEmpty():
        return _settled(rest.withColumn("base_draw", F.lit(0)), key)
    kind = F.when(F.col("kind") == "email", "domain").when(F.col("kind").startswith("name-"), "surname")
    part = F.when(F.col("kind") == "email", F.substring_index("value", "@", -1)).otherwise(F.substring_index("value", " ", -1))
    rest = rest.withColumn("_kind", kind).withColumn("_value", part).join(first.toDF("_kind", "_value", "base_draw"), ["_kind", "_value"], "left")
    return first.unionByName(_settled(rest.withColumn("base_draw", F.coalesce("base_draw", F.lit(0))), key))


def _settled(entities: DataFrame, key: bytes) -> DataFrame:
    """``redraws`` of entities that don't build on each other, with the draw of what they build on (``base_draw``)."""
    originals = entities.groupBy("kind", "value").agg(F.min("sample").alias("sample"), F.min("base_draw").alias("base_draw"))
    rows = written(originals.withColumn("draw", F.lit(0)), "entities")

    def draw_all(batches):
        for batch in batches:
            fresh = [normal(kind, surrogate(key, kind, sample, draw, at)) for kind, sample, at, draw in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3, 4)), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fresh, pa.string())], ["kind", "value", "sample", "base_draw", "draw", "fresh"])

    turn = 0
    while True:  # ends: forms widen with every further draw
        drawn = rows.select("kind", "value", "sample", "base_draw", "draw").mapInArrow(draw_all, "kind string, value string, sample string, base_draw int, draw int, fresh string")
        drawn = written(drawn.select("*", F.regexp_replace("kind", "-.*", "").alias("family")), "drawn")
        stays = drawn.groupBy("family", "fresh").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("draw", "kind", "value")).alias("first"))
        taken = stays.join(drawn.select("family", F.col("value").alias("fresh")).distinct().withColumn("known", F.lit(True)), ["family", "fresh"], "left").where("c > 1 or known")
        taken = written(taken, "taken")
        if taken.isEmpty():
            return rows.where("draw > 0").select("kind", "value", "draw")
        mine = (F.col("kind") == F.col("first.kind")) & (F.col("value") == F.col("first.value")) & F.col("known").isNull()
        again = drawn.join(taken, ["family", "fresh"], "left")
        rows = written(again.select("kind", "value", "sample", "base_draw", F.when(F.col("c").isNull() | mine, F.col("draw")).otherwise(turn + 1).alias("draw")), "entities")
        turn += 1


def session_key(spark: SparkSession) -> bytes:
    """The session's key, or a fresh random one."""
    return (spark.conf.get(KEY_SETTING, None) or secrets.token_hex(32)).encode()


def replace_pii(docs: DataFrame, key: bytes | None = None) -> DataFrame:
    """``docs`` with all their columns; entities in ``text`` are replaced by surrogates under ``key``, by default that of
    the session (``session_key``). An ``n_chars`` column of whole
    numbers follows the new text.

    A null text stays null; texts without entities are unchanged; repeated rows change alike; an empty table stays empty.
    """
    key = session_key(docs.sparkSession) if key is None else key
    stable = keyed(docs)
    entities = written(_entities(stable), "document-entities")
    again = written(redraws(entities, key), "redraws")
    row = next(name for k in range(len(docs.columns) + 1) if (name := f"_row{k}") not in docs.columns)
    whole = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(F.coalesce(docs["text"], F.lit(""))).alias("t"), docs["text"].alias("text"), F.struct(*[docs[c] for c in docs.columns]).alias(row))
    if again.isEmpty():
        whole = whole.withColumn("items", F.lit(None).cast("array<struct<kind:string,value:string,draw:int>>"))
    else:
        carried = entities.join(again, ["kind", "value"]).groupBy("doc_id", "t").agg(F.collect_list(F.struct("kind", "value", "draw")).alias("items"))
        whole = attach(whole, written(carried, "document-redraws"), "items", 96)

    @F.pandas_udf("string")
    def rewrite(text, items):
        import pandas as pd

        return pd.Series([_rewritten(t, i, key) for t, i in zip(text, items, strict=True)], dtype=object)

    fresh = whole.withColumn("text", rewrite("text", F.to_json("items")))
    numbers = dict(docs.dtypes)
    out = [F.col("text") if c == "text" else F.when(F.col("text").isNotNull(), F.length("text").cast(numbers[c])).otherwise(F.col(row)[c]).alias(c) if c == "n_chars" and numbers[c] in ("int", "bigint") else F.col(row)[c].alias(c) for c in docs.columns]
    return fresh.select(*out)


def _rewritten(text: str | None, items: str | None, key: bytes) -> str | None:
    import json

    if text is None:
        return None
    draws = {(i["kind"], i["value"]): i["draw"] for i in json.loads(items)} if items else {}
    parts, done = [], 0
    for begin, end, kind, entity in detect(text):
        part = base(kind, entity)
        fresh = surrogate(key, kind, entity, draws.get((kind, normal(kind, entity)), 0), draws.get((part[0], normal(*part)), 0) if part else 0)
        if end - begin < len(entity):  # a given name that stands alone
            fresh = fresh.partition(" ")[0]
        parts += [text[done:begin], fresh]
        done = end
    return "".join([*parts, text[done:]]) if parts else text


def op1_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace_pii(table(spark, sf_dir, "documents")).select("doc_id", "text")
