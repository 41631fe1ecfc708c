"""PII surrogates: keyed replacements that keep type, gender, script and format.

Entities are found by pattern. Each has a canonical form that its spellings share (lower case; digits alone for numbers;
a phone's national number; a name's parts), so one entity gets one surrogate, written in each spelling's own punctuation
and case. ``Mr John Smith`` and ``Mr Smith`` share the surrogate of ``Smith``; ``+1 (415) 555-2671`` and ``415-555-2671``
share their number.

- Names: given names of the lists below go to another one of the same script and gender, by a keyed cycle; other given
  names to a pair of them, of the gender that the title tells; surnames to invented ones of the same script. Names are
  found after a title, or where a listed given name begins them.
- Numbers, mail names, addresses and tokens: a keyed Feistel network of three rounds moves every character within its
  own class (digit, vowel, consonant, accented, Greek, Cyrillic, hex). Country codes, mail providers and a card's first
  digit stay; an IBAN's and a card's check digits are worked out anew, so valid ones stay valid.

``assign`` checks the corpus: where two entities would share a surrogate, or a surrogate is itself an entity of the
corpus (given names aside), all but one are tried anew with the next tweak, until none is left. So distinct entities
stay distinct, nothing maps to itself, and no surrogate points at somebody else of the corpus. The assignment follows
from the key and the corpus's set of entities.

The key is the caller's secret: without it the surrogates can't be undone or linked.

- Addresses keep their range: private, local and reserved ones stay in theirs, public ones stay public.

Not found: names with neither a title nor a listed given name, a given name alone, ten-digit phones without separators,
plus sign or a word that tells (tel, phone, call ..). A listed given name before a word such as County, Street or Valley
is no person's, and four numbers after "version" no address. Letters outside the classes (such as ł) stay where they are in mail names.

Nulls: a null text stays null with no entities; so does an empty one. Texts without entities are returned unchanged.
Entities that touch or repeat are each replaced. Whole texts are searched, whatever their length. Empty tables stay
empty. Other columns are carried through; ones named n_entities or kinds are replaced.
"""

from __future__ import annotations

import hashlib
import hmac
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayspan.llm.common import Scratch, bounded

# Titles by gender, given names by script and gender, and parts of invented surnames by script.
TITLES = {
    "m": "Mr Mister Sir Herr Monsieur Señor Sr Господин Κύριος".split(),
    "f": "Mrs Ms Miss Madam Frau Madame Mme Mlle Señora Señorita Sra Srta Госпожа Κυρία".split(),
    "n": "Dr Prof Professor".split(),
}
GIVEN = {
    "latin:f": "Adelheid Andrea Anna Barbara Camille Carmen Catherine Charlotte Clara Claudia Elena Elisabeth Emily Emma Hannah Helena Isabel Johanna Julia Katharina Laura Lucía Margaret María Nicole Paula Rebecca Sophie Susanne Teresa Amanda Angela Barbra Beatrice Caroline Christine Deborah Dorothy Eleanor Francesca Gabriele Ingrid Jennifer Jessica Karen Linda Mary Nancy Patricia Rachel Sandra Sarah Stephanie Sylvie Ursula Victoria Virginia".split(),
    "latin:m": "Albert Alexander Andreas Antoine Antonio Bernhard Carlos Charles Christian Daniel Edward Emilio Fernando Friedrich George Heinrich Henri Jacques Javier Johannes John Laurent Michael Miguel Philippe Richard Sebastian Thomas Wilhelm William Andrew Anthony Benjamin Brian Christopher David Dennis Donald Eduardo Francisco Gregory Harold James Jonathan Joseph Joshua Kenneth Manuel Matthew Nicolas Patrick Peter Rafael Robert Ronald Stephen Steven Vincent Walter".split(),
    "cyrillic:f": "Анна Валентина Дарья Екатерина Елена Ирина Людмила Мария Наталья Ольга Светлана Татьяна".split(),
    "cyrillic:m": "Александр Алексей Борис Виктор Дмитрий Иван Михаил Николай Олег Павел Сергей Юрий".split(),
    "greek:f": "Άννα Αικατερίνη Βασιλική Ελένη Ευαγγελία Ιωάννα Κωνσταντίνα Μαρία Παναγιώτα Σοφία".split(),
    "greek:m": "Αθανάσιος Βασίλειος Γεώργιος Δημήτριος Εμμανουήλ Ιωάννης Κωνσταντίνος Νικόλαος Παναγιώτης Χρήστος".split(),
}
SURNAME_PARTS = {
    "latin": (
        "Ald And Arn Bal Bar Ben Ber Bol Bran Brem Cal Car Dal Dan Del Dor Ein Eld Fal Far Fel Gal Gar Gold Gran Hal Har Hol Ker Lan Lin Mar Mel Mor Nor Ol Pel Ran Ros San Sel Stan Tal Tor Val Ver Wal Wes".split(),
        ["", "en", "er", "el", "in", "ing", "man", "is"],
        "bach beck berg bury by dale den feld field ford gard grove ham hart hill holm holt hurst land ley low lund marsh mark mont more nell ridge ros sen shaw sted ston strand thal ton vale ville wall wick wood worth".split(),
    ),
    "cyrillic": ("Бар Бел Вер Гор Дуб Ель Жар Зим Кал Кар Лап Лес Мал Мор Нов Ор Пал Рад Сав Сол Тар Том Фад Чер".split(), ["", "ан", "ен", "ич", "ник", "ош", "ул", "ыш"], "ов ев ин".split()),
    "greek": ("Αλεξ Ανδρ Βασ Γεωρ Δημ Ζαχ Θεοδ Καρ Λαμπ Μαρκ Νικ Ξεν Παπ Πετρ Σταμ Στεφ Τριαντ Φωτ Χατζ Χρυσ".split(), ["", "αν", "ατ", "ερ", "ιν", "ογ", "ολ", "ουλ"], "όπουλος ίδης άκης άτος έας ώνης".split()),
}
#: Words that make a place, a street or a title of what a given name begins.
NO_SURNAME = "Airport Avenue Bay Beach Bridge Castle Church City College County Court Creek East Falls Fund Gardens Gate Heights Hills Hospital Hotel House Island Lake Lane Museum North Park Place Prize River Road School South Springs Square Station Street The Theatre Tower University Valley West".split()
#: First octets all of whose addresses are public.
PUBLIC = tuple(n for n in range(1, 224) if n not in (10, 100, 127, 169, 172, 192, 198, 203))
#: Second octets that are public behind the others.
BEHIND = {
    f: tuple(n for n in range(256) if n not in shut)
    for f, shut in ((100, range(64, 128)), (169, (254,)), (172, range(16, 32)), (192, (0, 88, 168)), (198, (18, 19, 51)), (203, (0,)))
}
#: Titles of languages in which two surnames follow.
TWO_SURNAMES = "Señor Señora Señorita Sr Sra Srta".split()
PARTICLES = "af av bin da de del della den der di dos du el la le ten ter van von zu zum zur".split()
#: International dialling codes: one digit, two digits of these, else three.
DIAL = r"^(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"

_every = lambda words: "|".join(sorted(words, key=lambda w: (-len(w), w)))
_TITLE = rf"(?<!\p{{L}})(?:{_every(sum(TITLES.values(), []))})\.?"
_CAP = r"[\p{Lu}&&[\p{IsLatin}\p{IsGreek}\p{IsCyrillic}]](?:[\p{L}-]|['’](?!s\b))*"
_MORE = rf"(?: (?:(?:{'|'.join(PARTICLES)}) ){{0,3}}{_CAP})"
_NEXT = rf"(?! (?:{'|'.join(NO_SURNAME)})(?!\p{{L}})){_MORE}"
_LISTED = rf"(?<![\p{{L}}'’-])(?=\p{{Lu}})(?:{_every(sum(GIVEN.values(), []))})"
#: One pattern per type, tried in this order at each place.
PATTERNS = {
    "email": r"(?<![\p{L}0-9._%+-])[\p{L}0-9._%+-]++@[\p{L}0-9-]+(?:\.[\p{L}0-9-]+)+",
    "secret": r"(?<![0-9A-Za-z])[0-9A-Fa-f]{32,64}(?![0-9A-Za-z])",
    "ipv6": r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])|(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6}(?![0-9A-Za-z:])",
    "ip": r"(?=[0-9])(?<![0-9.])(?<![vV])(?<!(?i:version|ver|release|build|firmware|section|chapter)[ .:]{1,2})(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})(?![0-9]|\.[0-9])",
    "phone": r"(?:\+[0-9]{1,3}[ .-]?)?\([0-9]{2,4}\)[ .-]?[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9])|\+[0-9]{1,3}(?:[ .-][0-9]{2,8}){2,4}(?![0-9])|\+[0-9]{8,15}(?![0-9])|(?<![0-9.-])[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])|(?=[0-9]{10})(?<=(?i:tel|phone|telephone|call|mobile|cell|fax|dial)[.: ]{1,3})[0-9]{10}(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])",
    "card": r"(?<![0-9A-Za-z.-])[0-9]{4}(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{1,7}(?![0-9A-Za-z])",
    "name": rf"{_TITLE} {_CAP}{_MORE}{{0,2}}|{_LISTED}(?:{_NEXT}){{1,2}}",
}
PATTERN = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: No entity without one of these; spares most texts the full search.
GATE = rf"[0-9@]|\b[A-Fa-f]{{32}}|(?=[A-ZÀ-ÞΆ-ΏΑ-ΩА-Я])(?:{_TITLE} \p{{Lu}}|{_LISTED} )"
CLASSES = (
    "23456789",
    "01",
    "aeiou",
    "bcdfghjklmnpqrstvwxyz",
    "áéíóúàèìòùâêîôûäëïöüãõåæøœý",
    "çñßšžčř",
    "αβγδεζηθικλμνξοπρστυφχψω",
    "абвгдежзийклмнопрстуфхцчшщъыьэюя",
)
DIGITS, HEX = "0123456789", "0123456789abcdef"
_DIGIT, _HEX, _OCTET, _FIRST, _SIXTEEN = range(len(CLASSES), len(CLASSES) + 5)
_SECOND = {f: _SIXTEEN + 1 + i for i, f in enumerate(BEHIND)}
SIZES = (*map(len, CLASSES), len(DIGITS), len(HEX), 256, len(PUBLIC), 16, *map(len, BEHIND.values()))
#: Exceptions up to which their tweaks stand in the plan; more are joined by text.
INLINE = 200
ROUNDS = 60
SALTS = 8


def entities(text: Column) -> Column:
    return F.when(F.regexp_like(text, F.lit(GATE)), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))).otherwise(F.array().cast("array<string>"))


def kind(entity: Column) -> Column:
    """Type of an entity: the first pattern that it matches as a whole."""
    alone = F.when(F.regexp_like(entity, F.lit("^[0-9]{10}$")), "phone")  # what was before it told so
    return F.coalesce(*[F.when(F.regexp_like(entity, F.lit(f"^(?:{p})$")), k) for k, p in PATTERNS.items()], alone)


def canonical(entity: Column, k: Column) -> Column:
    """What spellings of one entity have in common; names are taken apart before."""
    plain = F.lower(F.regexp_replace(entity, "[^0-9A-Za-z]", ""))
    national = F.when(entity.startswith("+"), F.regexp_replace(plain, DIAL, "")).otherwise(plain)
    return F.when(k.isin("email", "ip", "ipv6"), F.lower(entity)).when(k == "phone", national).otherwise(plain)


def _script(token: Column) -> Column:
    return F.when(F.regexp_like(token, F.lit(r"^\p{IsCyrillic}")), "cyrillic").when(F.regexp_like(token, F.lit(r"^\p{IsGreek}")), "greek").otherwise(F.lit("latin"))


_genders = {n.lower(): g.split(":")[1] for g, names in GIVEN.items() for n in names}


def pieces(text: Column, found: Column) -> Column:
    """The text's entities as (pre, t, k, c): the text before, as written, kind and canonical form. A name has a piece
    for each part: ``given:script:gender``, ``surname:script`` or ``particle``."""
    gender = F.create_map(*[F.lit(v) for kv in _genders.items() for v in kv])

    def parts(gap: Column, e: Column, k: Column) -> Column:
        title = F.regexp_extract(e, f"^({_TITLE} )?", 1)
        said = F.coalesce(*[F.when(F.regexp_like(title, F.lit(rf"^(?:{'|'.join(t)})\.? $")), g) for g, t in TITLES.items()], F.lit("n"))
        tokens = F.split(F.substring(e, F.length(title) + 1, F.length(e)), " ")

        def part(w: Column, i: Column) -> Column:
            low = F.lower(w)
            given = F.concat_ws(":", F.lit("given"), _script(w), F.coalesce(F.element_at(gender, low), said))
            second = (i == 0) & (F.size(tokens) == 2) & F.element_at(gender, low).isNull() & F.regexp_like(title, F.lit(rf"^(?:{'|'.join(TWO_SURNAMES)})\.? $"))
            role = F.when((i == F.size(tokens) - 1) | second, F.concat(F.lit("surname:"), _script(w))).when(low == w, "particle").otherwise(given)
            # A Russian surname's feminine ending isn't part of what identifies it.
            own = F.when(role == "surname:cyrillic", F.regexp_replace(low, "(?<=ов|ев|ёв|ин|ын)а$", "")).otherwise(low)
            return F.struct(F.when(i == 0, F.concat(gap, title)).otherwise(F.lit(" ")).alias("pre"), w.alias("t"), role.alias("k"), own.alias("c"))

        whole = F.array(F.struct(gap.alias("pre"), e.alias("t"), k.alias("k"), canonical(e, k).alias("c")))
        return F.when(k == "name", F.transform(tokens, part)).otherwise(whole)

    gaps = F.slice(F.split(text, PATTERN, -1), F.lit(1), F.size(found))
    return F.flatten(F.zip_with(gaps, F.transform(found, lambda e: F.struct(e.alias("e"), kind(e).alias("k"))), lambda g, e: parts(g, e["e"], e["k"])))


def _steps(d: DataFrame, **new: Callable[[Column], Column]) -> DataFrame:
    """``d`` with fields added to the structs of array ``__x``.

    One select a step: each step's array is built before the next reads it, so nothing is worked out per character
    that holds for the whole entity.
    """
    names = [f for f in d.schema["__x"].dataType.elementType.names if f not in new]
    return d.withColumn("__x", F.transform("__x", lambda x: F.struct(*[x[n].alias(n) for n in names], *[f(x).alias(n) for n, f in new.items()])))


def _units(k: Column, body: Column) -> Column:
    """The characters (octets of an ip) that move: class, place in it, and the character itself where it has no class."""

    def unit(c: Column, i: Column) -> Column:
        cls, at = F.lit(-1), F.lit(0)
        for n, chars in enumerate(CLASSES):
            here = F.instr(F.lit(chars), c)
            cls, at = F.when(here > 0, n).otherwise(cls), F.when(here > 0, here - 1).otherwise(at)
        hexed, digit = k.isin("secret", "ipv6"), F.instr(F.lit(DIGITS), c)
        # A phone's first digit stays a possible one; other digits are all alike.
        any_digit = (digit > 0) & ~((k == "phone") & (i == 0))
        cls = F.when(hexed, F.when(F.instr(F.lit(HEX), c) > 0, _HEX).otherwise(-1)).when(any_digit, _DIGIT).otherwise(cls)
        return F.struct(cls.alias("s"), F.when(hexed, F.instr(F.lit(HEX), c) - 1).when(any_digit, digit - 1).otherwise(at).alias("v"), c.alias("f"))

    chars = F.transform(F.filter(F.split(body, ""), lambda c: c != ""), unit)
    four = F.transform(F.split(body, r"\."), lambda o: F.coalesce(o.try_cast("int"), F.lit(0)))
    first, second = F.get(four, F.lit(0)), F.get(four, F.lit(1))
    place = F.array_position(F.lit(list(PUBLIC)), first).cast("int")

    def octet(v: Column, i: Column) -> Column:
        """Private, local and reserved ranges stay what they are, and public addresses public."""
        cls, at, own = F.lit(_OCTET), v, F.lit("")
        sixteen = (first == 172) & second.between(16, 31)
        cls = F.when((i == 0) & (place > 0), _FIRST).when(i == 0, -1).when((i == 1) & sixteen, _SIXTEEN).when((i == 1) & (place == 0) & ~first.isin(10, 127), -1).otherwise(cls)
        documents = ((first == 192) & (second == 0)) | ((first == 198) & (second == 51)) | ((first == 203) & (second == 0))
        cls = F.when((i == 2) & documents, -1).otherwise(cls)
        at = F.when(cls == _FIRST, place - 1).when(cls == _SIXTEEN, v - 16).otherwise(at)
        for f, seconds in BEHIND.items():
            there = F.array_position(F.lit(list(seconds)), v).cast("int")
            here = (i == 1) & (first == f) & (there > 0)
            cls, at = F.when(here, _SECOND[f]).otherwise(cls), F.when(here, there - 1).otherwise(at)
        return F.struct(cls.alias("s"), at.alias("v"), F.when(cls == -1, v.cast("string")).otherwise(own).alias("f"))

    octets = F.transform(four, octet)
    return F.when(k == "ip", octets).otherwise(chars)


def _shape(units: Column) -> Column:
    return F.array_join(F.transform(units, lambda u: F.when(u["s"] < 0, u["f"]).otherwise(u["s"].cast("string"))), ",")


def _char(u: Column) -> Column:
    out = F.when(u["s"] == _OCTET, u["v"].cast("string")).when(u["s"] == _FIRST, F.element_at(F.lit(list(PUBLIC)), u["v"] + 1).cast("string")).when(u["s"] == _SIXTEEN, (u["v"] + 16).cast("string"))
    for f, seconds in BEHIND.items():
        out = out.when(u["s"] == _SECOND[f], F.element_at(F.lit(list(seconds)), u["v"] + 1).cast("string"))
    for i, chars in enumerate((*CLASSES, DIGITS, HEX)):
        out = out.when(u["s"] == i, F.substring(F.lit(chars), u["v"] + 1, F.lit(1)))
    return out.otherwise(u["f"])


def _hex(h: Column, at: Column, n: int) -> Column:
    return F.conv(F.substring(h, at, F.lit(n)), 16, 10).cast("int")


def _moved(u: Column, i: Column, h: Column) -> Column:
    base = F.element_at(F.lit(list(SIZES)), F.greatest(u["s"], F.lit(0)) + 1)
    return F.struct(u["s"].alias("s"), F.when(u["s"] < 0, u["v"]).otherwise(F.pmod(u["v"] + _hex(h, F.pmod(i * 3, F.lit(123)) + 1, 4), base)).alias("v"), u["f"].alias("f"))


def _numbers(text: Column) -> Column:
    """Digits as numbers, letters from a = 10 on."""
    return F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.instr(F.lit(DIGITS + "abcdefghijklmnopqrstuvwxyz"), c) - 1)


def luhn(payload: Column) -> Column:
    """The check digit of a card number without it."""
    d = F.reverse(_numbers(payload))
    each = F.transform(d, lambda v, j: F.when(j % 2 == 1, v).when(v > 4, 2 * v - 9).otherwise(2 * v))
    return F.pmod(-F.aggregate(each, F.lit(0), lambda a, v: a + v), F.lit(10))


def iban_check(country: Column, account: Column) -> Column:
    """The check number, 2 to 98."""
    rest = F.aggregate(_numbers(F.concat(account, country, F.lit("00"))), F.lit(0), lambda a, v: F.when(v > 9, a * 100 + v).otherwise(a * 10 + v) % 97)
    return 98 - rest


def _digit_at(c: Column, at: Column | int, n: int = 1) -> Column:
    return F.coalesce(F.substring(c, at if isinstance(at, Column) else F.lit(at), F.lit(n)).try_cast("int"), F.lit(0))


def _listed(key: str) -> Column:
    """Each listed given name's surrogate: the next of its list in an order that the key gives, so none keeps its own."""
    out = {}
    for names in GIVEN.values():
        order = sorted(names, key=lambda n: hmac.new(key.encode(), n.encode(), hashlib.sha256).digest())
        out |= {a.lower(): b for a, b in zip(order, order[1:] + order[:1])}
    return F.create_map(*[F.lit(v) for kv in out.items() for v in kv])


def _invented(k: Column, h: Column, n: Column) -> Column:
    """A chain of n given names or surnames of a kind, from the hex digits of a hash."""

    def pick(j: Column) -> Column:
        v = _hex(h, F.pmod(j * 7, F.lit(119)) + 1, 7)
        of = lambda names, i: F.element_at(F.lit(names), F.pmod(i, F.lit(len(names))).cast("int") + 1)
        out = F.lit(None).cast("string")
        for group, names in GIVEN.items():
            out = F.when(k == f"given:{group}", of(names, v)).otherwise(out)
        for script, (roots, links, ends) in SURNAME_PARTS.items():
            both = sum((names for g, names in GIVEN.items() if g.startswith(script)), [])
            i = F.floor(v / len(roots))
            surname = F.concat(of(roots, v), of(links, i), of(ends, F.floor(i / len(links))))
            out = F.when(k == f"given:{script}:n", of(both, v)).when(k == f"surname:{script}", surname).otherwise(out)
        return out

    return F.array_join(F.transform(F.sequence(F.lit(0), n - 1), pick), "-")


def surrogate_forms(d: DataFrame, key: str) -> DataFrame:
    """``d`` with fields ``s`` (surrogate of the canonical form) and ``ext`` in the structs (k, c, a, ...) of ``__x``;
    a is the tweak."""
    listed, named = _listed(key), lambda x: x["k"].startswith("given") | x["k"].startswith("surname")
    coded = lambda x: ~named(x) & (x["k"] != "particle")
    n = lambda x: F.length(x["c"])
    head = lambda x: F.when(x["k"] == "card", 1).when(x["k"] == "iban", 4).otherwise(0)
    tail = lambda x: F.when(x["k"] == "email", F.length(F.regexp_extract(x["c"], r"((?:@|\.)[^.@]+\.[^.@]+)$", 1))).when(x["k"] == "card", 1).otherwise(0)
    d = _steps(d, head=head, tail=tail)
    cut = lambda x: F.substring(x["c"], x["head"] + 1, n(x) - x["head"] - x["tail"])
    d = _steps(d, u=lambda x: F.when(coded(x), _units(x["k"], cut(x))))
    half = lambda x: F.floor(F.size(x["u"]) / 2).cast("int")
    d = _steps(d, p=lambda x: F.when(coded(x), _shape(x["u"])), l=lambda x: F.when(coded(x), F.slice(x["u"], F.lit(1), half(x))), r=lambda x: F.when(coded(x), F.slice(x["u"], half(x) + 1, F.size(x["u"]))))
    for i in range(3):
        values = lambda x: F.array_join(F.transform(x["r"], lambda u: u["v"].cast("string")), ",")
        stays = lambda x: F.concat(F.substring(x["c"], F.lit(1), F.when(x["k"] == "iban", 2).otherwise(x["head"])), F.when(x["k"] == "email", F.substring(x["c"], n(x) - x["tail"] + 1, x["tail"])).otherwise(F.lit("")))
        d = _steps(d, h=lambda x, i=i: F.when(coded(x), F.sha2(F.concat_ws("|", F.lit(f"{key}|{i}"), x["k"], x["a"].cast("string"), stays(x), x["p"], values(x)), 512)))
        d = _steps(d, l=lambda x: x["r"], r=lambda x: F.when(coded(x), F.transform(x["l"], lambda u, j: _moved(u, j, x["h"]))))
    # Three rounds leave the halves exchanged.
    chars = lambda x: F.transform(F.concat(x["r"], x["l"]), _char)
    d = _steps(d, body=lambda x: F.when(x["k"] == "ip", F.array_join(chars(x), ".")).when(coded(x), F.array_join(chars(x), "")), h=lambda x: F.sha2(F.concat_ws("|", F.lit(f"{key}|name"), x["k"], x["a"].cast("string"), x["c"]), 512))

    def whole(x: Column) -> Column:
        first = F.substring(x["c"], F.lit(1), F.lit(1))
        off = _digit_at(x["c"], n(x)) - luhn(F.substring(x["c"], F.lit(1), n(x) - 1))  # 0 for a valid number
        card = F.concat(first, x["body"], F.pmod(luhn(F.concat(first, x["body"])) + off, F.lit(10)).cast("string"))
        country = F.substring(x["c"], F.lit(1), F.lit(2))
        off = _digit_at(x["c"], 3, 2) - iban_check(country, F.substring(x["c"], F.lit(5), n(x)))
        iban = F.concat(country, F.lpad((F.pmod(iban_check(country, x["body"]) - 2 + off, F.lit(97)) + 2).cast("string"), 2, "0"), x["body"])
        given = F.lower(F.coalesce(F.when(x["a"] == 0, F.element_at(listed, x["c"])), _invented(x["k"], x["h"], x["a"] + 2)))
        surname = F.lower(_invented(x["k"], x["h"], x["a"] + 1))
        mail = F.concat(x["body"], F.substring(x["c"], n(x) - x["tail"] + 1, x["tail"]))
        return F.when(x["k"].startswith("given"), given).when(x["k"].startswith("surname"), surname).when(x["k"] == "card", card).when(x["k"] == "iban", iban).when(x["k"] == "email", mail).when(x["k"] == "particle", x["c"]).otherwise(x["body"])

    # A mail name so short that its class has no free one left is made longer.
    ext = lambda x: F.when((x["k"] == "email") & (x["a"] > 2), F.translate(F.substring(x["h"], F.lit(1), F.lit(5)), DIGITS, "ghijklmnop")).otherwise(F.lit(""))
    d = _steps(d, s=whole, ext=ext)
    d = _steps(d, s=lambda x: F.concat(x["ext"], x["s"]))
    return d.withColumn("__x", F.transform("__x", lambda x: x.dropFields("head", "tail", "u", "p", "l", "r", "h", "body")))


def written(x: Column) -> Column:
    """The surrogate in the entity's own punctuation and case."""
    t, k, core = x["t"], x["k"], F.substring(x["s"], F.length(x["ext"]) + 1, F.length(x["s"]))
    # Digits of a phone before its national number are its country code.
    before = F.when(k == "phone", F.length(F.regexp_replace(t, "[^0-9]", "")) - F.length(x["c"])).otherwise(0)
    whole = k.isin("email", "ipv6")

    def place(c: Column, i: Column) -> Column:
        nth = F.length(F.regexp_replace(F.substring(t, F.lit(1), i + 1), "[^0-9A-Za-z]", "")) - before
        own = F.substring(core, F.when(whole, i + 1).otherwise(nth), F.lit(1))
        mark = ~whole & (~F.regexp_like(c, F.lit("[0-9A-Za-z]")) | (nth < 1))
        return F.when(mark, c).when(c != F.lower(c), F.upper(own)).otherwise(own)

    shout = (t == F.upper(t)) & (t != F.lower(t)) & (F.length(t) > 1)
    chars = F.concat(x["ext"], F.array_join(F.transform(F.filter(F.split(t, ""), lambda c: c != ""), place), ""))
    feminine = (k == "surname:cyrillic") & F.regexp_like(F.lower(t), F.lit("(?:ов|ев|ёв|ин|ын)а$"))
    name = F.concat(F.array_join(F.transform(F.split(x["s"], "-"), F.initcap), "-"), F.when(feminine, "а").otherwise(F.lit("")))
    out = F.when(k == "ip", x["s"]).when(k == "particle", t).when(k.startswith("given") | k.startswith("surname"), name).otherwise(chars)
    return F.when(shout, F.upper(out)).otherwise(out)


def _one(found: DataFrame, key: str) -> DataFrame:
    """(k, c, a, s) for rows (k, c, a)."""
    d = surrogate_forms(found.select(F.array(F.struct("k", "c", "a")).alias("__x")), key)
    return d.select(F.col("__x")[0].alias("x")).select("x.k", "x.c", "x.a", "x.s")


def clashes(m: DataFrame, key: str) -> DataFrame:
    """Rows (k, c, a) of an assignment (k, c, a, s) that must be tried anew: all but one of those that share a
    surrogate (the one of least tweak stays), and those whose surrogate is an entity of the corpus."""
    rank = F.struct("a", F.sha2(F.concat_ws("|", F.lit(key), "c"), 256))
    owner = m.groupBy("k", "s").agg(F.min_by("c", rank).alias("owner"), F.count("*").alias("n")).filter("n > 1")
    shared = m.join(owner, ["k", "s"]).filter("c <> owner").select("k", "c", "a")
    real = m.filter(~F.col("k").startswith("given")).join(m.select("k", F.col("c").alias("s")), ["k", "s"], "left_semi").select("k", "c", "a")
    return shared.union(real).distinct()


def assign(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(k, c, a, s) of every distinct entity of the corpus: kind, canonical form, tweak and surrogate, free of clashes."""
    if not key:
        raise ValueError("surrogates need a secret key")
    scratch = Scratch(docs.sparkSession, "surrogates")
    d = docs.select(F.col(text).alias("t"), entities(F.col(text)).alias("e")).filter(F.size("e") > 0)
    d = d.select(F.explode(pieces(F.col("t"), F.col("e"))).alias("x")).select("x.k", "x.c").filter("k <> 'particle'").distinct()
    m = scratch.write(_one(d.withColumn("a", F.lit(0)), key), "assigned0")
    for i in range(1, ROUNDS + 1):
        bad = scratch.write(clashes(m, key), f"bad{i}")
        if not bad.limit(1).count():
            return m
        m = scratch.write(m.join(bad, ["k", "c"], "left_anti").unionByName(_one(bad.withColumn("a", F.col("a") + 1), key)), f"assigned{i}")
        scratch.drop(f"assigned{i - 1}")
    raise ValueError(f"no free surrogates after {ROUNDS} rounds")


def replace_entities(docs: DataFrame, key: str, text: str = "text", assigned: DataFrame | None = None) -> DataFrame:
    """``docs`` with surrogates in ``text``, and n_entities and kinds (sorted, comma-separated) added.

    Surrogates follow from key and entity, but for the few that ``assign`` tried anew: up to INLINE of those stand in
    the plan, more are joined by text.
    """
    assigned = assigned if assigned is not None else assign(docs, key, text)
    anew = assigned.filter("a > 0").select("k", "c", "a")
    keep = [c for c in docs.columns if c not in ("n_entities", "kinds")]
    d = docs.select(*keep, entities(F.col(text)).alias("__e"))
    d = d.withColumn("__x", F.when(F.size("__e") > 0, pieces(F.col(text), F.col("__e"))).otherwise(F.array().cast("array<struct<pre:string,t:string,k:string,c:string>>")))
    if anew.limit(INLINE + 1).count() <= INLINE:
        tweak = {f"{r.k}|{r.c}": r.a for r in bounded(anew, INLINE, "tweaks")}
        tried = F.create_map(*[F.lit(v) for kv in tweak.items() for v in kv]) if tweak else None
        d = _steps(d, a=lambda x: F.coalesce(F.element_at(tried, F.concat(x["k"], F.lit("|"), x["c"])), F.lit(0)) if tweak else F.lit(0))
    else:
        hashed = F.xxhash64(text)
        each = d.select(hashed.alias("__th"), F.posexplode("__x").alias("at", "x")).select("__th", "at", "x.k", "x.c").distinct()
        tweaks = each.join(anew, ["k", "c"], "left").groupBy("__th").agg(F.sort_array(F.collect_list(F.struct("at", F.coalesce("a", F.lit(0)).alias("a")))).alias("__a"), F.max("a").alias("most"))
        tweaks = tweaks.filter("most > 0").drop("most").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        d = d.withColumns({"__th": hashed, "__salt": F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")}).join(tweaks, ["__th", "__salt"], "left").drop("__th", "__salt")
        fields = d.schema["__x"].dataType.elementType.names
        d = d.withColumn("__x", F.transform("__x", lambda x, i: F.struct(*[x[n].alias(n) for n in fields], F.coalesce(F.get("__a", i)["a"], F.lit(0)).alias("a")))).drop("__a")
    d = surrogate_forms(d, key)
    rest = F.element_at(F.split(text, PATTERN, -1), -1)
    new = F.when(F.size("__x") > 0, F.concat(F.array_join(F.flatten(F.transform("__x", lambda x: F.array(x["pre"], written(x)))), ""), rest)).otherwise(F.col(text))
    kinds = F.transform("__x", lambda x: F.when(x["k"].startswith("given") | x["k"].startswith("surname") | (x["k"] == "particle"), "name").otherwise(x["k"]))
    return d.select(*[new.alias(c) if c == text else F.col(c) for c in keep], F.greatest(F.coalesce(F.size("__e"), F.lit(0)), F.lit(0)).alias("n_entities"), F.coalesce(F.array_join(F.array_sort(F.array_distinct(kinds)), ","), F.lit("")).alias("kinds"))
