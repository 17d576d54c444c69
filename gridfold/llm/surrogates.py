"""Keyed surrogates for personal data, in DataFrame functions.

Entities (e-mail, IP and hardware addresses, phone, card, social-security and
account numbers, access keys, tokens, private keys and other secrets, names
after a title) are found by one regular expression.  Each is replaced by a surrogate drawn from a keyed hash of
its type and canonical form, so the same entity gets the same surrogate
everywhere, in whatever format it is written; the format is kept (punctuation,
upper and lower case, script, number of digits), check digits are valid, and
names keep their title and so their gender.  Within a document, a name found
behind a title is also replaced where it stands without one, so that all
mentions stay one person.

Collision checks run over the distinct entities of all documents: of several
entities with one surrogate all but the first, and any whose surrogate is a
real entity of the corpus, are drawn again with the next attempt number, until
none is left.  Family names and domains are settled first, as entities of
their own, so that a redrawn one changes for all its bearers alike; later
attempts draw from longer names.  Only the redrawn ones are joined to the documents that
hold them; texts stay where they are.

Defined results: a null text stays null, an empty one empty; digits that fail
the card check sum are left alone, unless they stand behind a secret's keyword; repeated rows get equal results; an empty
table gives an empty result; other columns are kept by ``anonymized``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridfold.llm.common import col, held, whole_row, written

MAX_ATTEMPTS = 64
FREE_FROM = 4       # from this attempt on, addresses and names may change their length

_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
_HEX4 = r"[0-9A-Fa-f]{1,4}"
# titles as fixed values: of men, of women, of either; the second row of each
# only as written, since its other writings are common words
_ANY_M, _AS_M = "mr|herr|monsieur|señor|господин|κύριος", "Sr"
_ANY_F, _AS_F = "mrs|frau|madame|mme|mlle|señora|señorita|госпожа|κυρία", "Ms|MS|Miss|MISS|Sra|Doña"
_ANY_N = "dr|prof|professor|доктор"
_TITLES_F = rf"(?:(?iu:{_ANY_F})|{_AS_F})"
_TITLES_M = rf"(?:(?iu:{_ANY_M})|{_AS_M})"
_TITLE = rf"(?:(?iu:{_ANY_M}|{_ANY_F}|{_ANY_N})|{_AS_M}|{_AS_F})"
_NAME = rf"(?!{_TITLE}(?!\p{{L}}))\p{{Lu}}['’]?\p{{L}}+(?:['’\-]\p{{L}}+){{0,2}}"
# what a secret stands behind (ASCII letters of either case), and its characters
_KEYWORD = r"(?i:token|secret|password|passwd|pwd|api_key|apikey)[ ]{0,2}[=:][ ]{0,2}[\"']{0,1}"
_SECRET = r"[A-Za-z0-9+/_\-]{8,}"
# entity types with the pattern that finds them; the first that fits wins.
# Groups repeat a bounded number of times and open-ended repeats are of single
# characters only, so no text, however long, makes the search recurse deeply.
PATTERNS = {
    "private_key": (r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----[A-Za-z0-9+/=\s]++"
                    r"-----END [A-Z ]{0,20}PRIVATE KEY-----"),
    "access_key": r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![0-9A-Za-z])",
    "token": (r"(?<![A-Za-z0-9_])(?:gh[pousr]_[A-Za-z0-9]{20,}|xox[abprs]-[A-Za-z0-9\-]{10,}"
              r"|eyJ[A-Za-z0-9_\-]{8,}\.eyJ[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,})"),
    # the cheap looks back come first: few places stand behind a sign or quote
    "secret": rf"(?:(?<=[=:\"'])|(?<=[=:] )|(?<=[=:]  ))(?<={_KEYWORD}){_SECRET}",
    "email": (r"(?<![\p{L}\p{N}._%+\-])[\p{L}\p{N}._%+\-]+@[\p{L}\p{N}\-]+"
              r"(?:\.[\p{L}\p{N}\-]+){0,20}\.\p{L}{2,}"),
    "account": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "hardware": r"(?<![0-9A-Za-z:\-])[0-9A-Fa-f]{2}(?::[0-9A-Fa-f]{2}|-[0-9A-Fa-f]{2}){5}(?![0-9A-Za-z:\-])",
    "address6": (rf"(?<![\p{{L}}\d:.])(?:{_HEX4}:){{7}}{_HEX4}(?![\p{{L}}\d:])"
                 rf"|(?<![\p{{L}}\d:.])(?=[A-Fa-f:]{{0,30}}\d)(?:{_HEX4}:){{1,6}}(?::{_HEX4}){{1,6}}(?![\p{{L}}\d:])"),
    "card": r"(?<![\p{L}\d+\-])\d(?:[ \-]?\d){12,18}(?![\p{L}\d])",
    "social": r"(?<![\p{L}\d\-])\d{3}-\d{2}-\d{4}(?![\p{L}\d\-])",
    "phone": (r"(?<![\p{L}\d+])(?:\+\d{1,3}[ .\-]?)?(?:\(\d{2,4}\)[ .\-]?|\d{3}[ .\-])\d{3}[ .\-]\d{4}(?![\p{L}\d])"
              r"|(?<![\p{L}\d])\+\d{1,3}(?:[ .\-]\d{2,5}){2,5}(?![\p{L}\d])|(?<![\p{L}\d])\+\d{9,14}(?![\p{L}\d])"
              r"|(?=\d{7})(?<=(?i:phone|tel|call|mobile|fax)[ .:]{1,3})\d{7,12}(?![\p{L}\d.])"),
    "address": rf"(?<![\p{{L}}\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?![\p{{L}}\d]|\.\d)",
    "person": rf"(?<!\p{{L}})(?:{_TITLE}\.? ){{1,3}}{_NAME}(?: {_NAME})?",
}
# but for private keys, no entity begins within a word: most places are passed
# over by one look back
ENTITY_RE = (PATTERNS["private_key"] + r"|(?<!\p{L})(?:"
             + "|".join(f"(?:{p})" for k, p in PATTERNS.items() if k != "private_key") + ")")
# every entity holds a digit, an at sign, two colons or hyphens, the start of a
# key or token, a title or a keyword of a secret
_HINT_RE = (rf"[\d@]|::|[:\-][0-9A-Fa-f]{{1,4}}[:\-]|PRIVATE KEY|(?<!\p{{L}})(?:AKIA|xox|eyJ|gh[pousr]_|{_TITLE}\.? \p{{Lu}})"
            rf"|{_KEYWORD}")

# Given names and name parts by gender and script (fixed values)
GIVEN = {
    ("m", "latin"): "Adam Bruno Carl David Emil Felix Georg Hugo Ivan Jonas Karl Leon Marc Noel Oscar Paul",
    ("f", "latin"): "Anna Berta Clara Diana Elena Flora Greta Helena Irma Julia Karla Laura Maria Nora Olivia Paula",
    ("m", "cyrillic"): "Алексей Борис Виктор Глеб Денис Егор Иван Кирилл Лев Максим Никита Олег Павел Роман Степан Юрий",
    ("f", "cyrillic"): "Алла Вера Галина Дарья Елена Жанна Зоя Ирина Ксения Лариса Мария Нина Ольга Полина Софья Юлия",
    ("m", "greek"): "Αλέξανδρος Γιώργος Δημήτρης Ηλίας Θεόδωρος Ιωάννης Κώστας Λουκάς Μάρκος Νίκος Πέτρος Σπύρος",
    ("f", "greek"): "Αγγελική Βασιλική Γεωργία Δήμητρα Ελένη Ζωή Ιωάννα Κατερίνα Μαρία Νίκη Σοφία Χρυσή",
}
SYLLABLES = {
    "latin": "bel dor fan gar hol kim lan mor nev ost per ros sal tor vin wes",
    "cyrillic": "бел вол гор дар ков лад мир нов ост пет род сав тих фом чер шел",
    "greek": "βαλ γερ δαν ζαρ καλ λαμ μαν νικ παν ρουσ σαρ ταν φαν χαρ ψαρ κορ",
}
ENDINGS = {("m", "latin"): "er", ("f", "latin"): "er", ("m", "cyrillic"): "ов", ("f", "cyrillic"): "ова",
           ("m", "greek"): "ης", ("f", "greek"): "η"}
ALPHABETS = {"lower": "abcdefghijklmnopqrstuvwxyz", "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
             "digit": "0123456789", "hex": "abcdef",
             "cyrillic": "абвгдежзиклмнопрстуфхцчшщэюя", "CYRILLIC": "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЩЭЮЯ",
             "greek": "αβγδεζηθικλμνξοπρστυφχψω", "GREEK": "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ"}


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _stream(key: Column, kind: str | Column, canon: Column, attempt: Column) -> Column:
    """256 hex digits of a keyed hash."""
    kind = kind if isinstance(kind, Column) else F.lit(kind)
    return _let(F.concat_ws("|", key, kind, canon, attempt.cast("string")), lambda seed: F.concat(
        *[F.sha2(F.concat(F.lit(f"{n}|"), seed).cast("binary"), 512) for n in (0, 1)]))


def _number(stream: Column, at: Column, below: int | Column) -> Column:
    """A number under ``below`` from place ``at`` of the stream (64 places)."""
    return F.pmod(F.conv(F.substring(stream, 1 + 4 * F.pmod(at, F.lit(64)), F.lit(4)), 16, 10).cast("int"),
                  below if isinstance(below, Column) else F.lit(below))


def _pick(stream: Column, at: Column, alphabet: str) -> Column:
    return F.substring(F.lit(alphabet), 1 + _number(stream, at, len(alphabet)), F.lit(1))


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, r"[^0-9]", "")


# classes of characters with the alphabet that replaces them; the first that fits
CLASSES = (("[0-9]", "digit"), ("[A-Z]", "upper"), (r"(?=\p{IsCyrillic})\p{Lu}", "CYRILLIC"),
           (r"\p{IsCyrillic}", "cyrillic"), (r"(?=\p{IsGreek})\p{Lu}", "GREEK"), (r"\p{IsGreek}", "greek"),
           (r"\p{L}", "lower"))


def _charwise(v: Column, stream: Column, hex_only: Column) -> Column:
    """Each character replaced by one of its class; others stay."""
    def one(c, i):
        alphabet = F.when(hex_only & c.rlike("[a-f]"), ALPHABETS["hex"])
        for pattern, name in CLASSES:
            alphabet = alphabet.when(c.rlike(pattern), ALPHABETS[name])
        return _let(alphabet, lambda a: F.coalesce(
            F.substring(a, 1 + _number(stream, i, F.length(a)), F.lit(1)), c))
    return F.array_join(F.transform(F.split(v, ""), one), "")


def _fill(v: Column, digits: Column) -> Column:
    """The digits of ``v`` replaced from the right by those of ``digits``;
    digits beyond them (a country code) stay."""
    def one(c, i):
        right = F.length(_digits(F.substring(v, i + 2, F.length(v))))
        return F.when(c.rlike("[0-9]") & (right < F.length(digits)),
                      F.substring(digits, F.length(digits) - right, F.lit(1))).otherwise(c)
    return F.array_join(F.transform(F.split(v, ""), one), "")


def _draw_digits(stream: Column, n: Column, lead: Column | None = None) -> Column:
    """n digits; groups never begin with 0 or 1 where phones do not."""
    d = F.transform(F.sequence(F.lit(0), n - 1), lambda i: _number(stream, i, 10).cast("string"))
    return F.array_join(d, "") if lead is None else F.concat(lead, F.substring(F.array_join(d, ""), F.lit(1), n - 1))


def _luhn(body: Column) -> Column:
    """Sum of a card's digits without the check digit, by the Luhn rule."""
    def one(c, i):
        d = c.cast("int") * F.when(F.pmod(i, F.lit(2)) == 0, 2).otherwise(1)
        return F.when(d > 9, d - 9).otherwise(d)
    return F.aggregate(F.transform(F.split(F.reverse(body), ""), one), F.lit(0), lambda a, x: a + x)


def _check_digit(body: Column) -> Column:
    return F.pmod(10 - F.pmod(_luhn(body), F.lit(10)), F.lit(10)).cast("string")


def is_card(v: Column) -> Column:
    d = _digits(v)
    return _check_digit(F.substring(d, F.lit(1), F.length(d) - 1)) == F.substring(d, F.length(d), F.lit(1))


def _script(v: Column) -> Column:
    return (F.when(v.rlike(r"\p{IsCyrillic}"), "cyrillic").when(v.rlike(r"\p{IsGreek}"), "greek")
            .otherwise("latin"))


def kind_of(v: Column, led: Column) -> Column:
    """Type of a found entity; null for digits that are no card.  ``led``:
    whether it stands behind a keyword of a secret."""
    rules = [(k, (led & v.rlike(f"^{_SECRET}$")) if k == "secret" else v.rlike(f"^(?:{p})$"))
             for k, p in PATTERNS.items()]
    rules = [(k, (r & is_card(v)) if k == "card" else r) for k, r in rules]
    # bare digits are found behind a phone's keyword only
    rules = [(k, (r | v.rlike(r"^\d{7,12}$")) if k == "phone" else r) for k, r in rules]
    out = reduce(lambda acc, kr: F.when(kr[1], F.lit(kr[0])).otherwise(acc), reversed(rules), F.lit(None).cast("string"))
    return out


def canonical(kind: Column, v: Column) -> Column:
    """The form in which writings of one entity agree."""
    return (F.when(kind == "phone", F.substring(_digits(v), F.greatest(F.length(_digits(v)) - 9, F.lit(1)), F.lit(10)))
            .when(kind.isin("card", "social"), _digits(v))
            .when(kind == "account", F.replace(v, F.lit(" "), F.lit("")))
            .when(kind == "email", F.lower(v))
            .when(kind == "person", F.lower(F.regexp_replace(v, r"\.? +", " ")))
            .when(kind.isin("family", "domain", "hardware", "address6"), F.lower(v))
            .otherwise(v))


def domain_of(email: Column) -> Column:
    """The domain of an address, without its top level."""
    domain = F.lower(F.substring_index(email, "@", -1))
    return F.substring(domain, F.lit(1), F.length(domain) - F.length(F.substring_index(domain, ".", -1)) - 1)


def _domain(host: Column, t: Column, attempt: Column) -> Column:
    """A domain, drawn by itself so that all addresses in it agree."""
    return F.concat(F.when(attempt >= FREE_FROM, F.concat(F.substring(t, 200, 6), F.lit("-"))).otherwise(F.lit("")),
                    _charwise(host, t, F.lit(False)))


def _email(v: Column, s: Column, key: Column, attempt: Column, domain_attempt: Column) -> Column:
    local, top = F.substring_index(v, "@", 1), F.lower(F.substring_index(v, ".", -1))
    return F.concat(
        _charwise(local, s, F.lit(False)),
        F.when(attempt >= FREE_FROM, F.concat(F.lit("."), F.substring(s, 200, 8))).otherwise(F.lit("")),
        F.lit("@"), _let(domain_of(v), lambda h: _let(
            _stream(key, "domain", h, domain_attempt), lambda t: _domain(h, t, domain_attempt))), F.lit("."), top)


def _hexwise(v: Column, s: Column) -> Column:
    """Each hex digit replaced by one, letters in the case they have."""
    def one(c, i):
        drawn = _pick(s, i, "0123456789abcdef")
        return (F.when(c.rlike("[0-9a-f]"), drawn).when(c.rlike("[A-F]"), F.upper(drawn)).otherwise(c))
    return F.array_join(F.transform(F.split(v, ""), one), "")


# the part of an entity that is replaced character by character, between what
# stays: the mark of a key or token, the lines around a private key
_SPAN_RE = (r"(?s)^(AKIA(?=[0-9A-Z]{16}$)|gh[pousr]_|xox[abprs]-|eyJ(?=[^.]*\.eyJ)|-----BEGIN [A-Z ]*-----)?(.*?)"
            r"(-----END [A-Z ]*-----)?$")


def _spanned(v: Column, kind: Column, s: Column) -> Column:
    """A key, token or secret; a signed token keeps the mark of its second part."""
    marked = kind.isin("access_key", "token", "private_key")
    part = [F.regexp_extract(v, _SPAN_RE, i) for i in (1, 2, 3)]
    body = F.when(marked, part[1]).otherwise(v)
    drawn = _charwise(body, s, (kind == "secret") & v.rlike("^[0-9a-f]+$"))
    out = F.when(marked, F.concat(part[0], drawn, part[2])).otherwise(drawn)
    return F.when((kind == "token") & (part[0] == "eyJ"), F.regexp_replace(out, r"^([^.]*\.).{3}", "$1eyJ")).otherwise(out)


def _ip(v: Column, s: Column, attempt: Column) -> Column:
    def octet(o, i):
        n = F.length(o)
        return (F.when(attempt >= FREE_FROM, 1 + _number(s, i, 254)).when(n == 1, 1 + _number(s, i, 9))
                .when(n == 2, 10 + _number(s, i, 90)).otherwise(100 + _number(s, i, 155))).cast("string")
    return F.array_join(F.transform(F.split(v, r"\."), octet), ".")


def _account(v: Column, s: Column) -> Column:
    plain = F.replace(v, F.lit(" "), F.lit(""))
    body = _charwise(F.substring(plain, F.lit(5), F.length(plain)), s, F.lit(False))
    country = F.substring(plain, 1, 2)

    def step(a, c):
        return F.when(c.rlike("[0-9]"), F.pmod(a * 10 + c.cast("int"), F.lit(97))).otherwise(
            F.pmod(a * 100 + F.ascii(c) - 55, F.lit(97)))
    def form(b):
        rest = F.aggregate(F.split(F.concat(b, country, F.lit("00")), ""), F.lit(0), step)
        flat = F.concat(country, F.lpad((98 - rest).cast("string"), 2, "0"), b)
        # the blanks stand where they stood
        return F.array_join(F.transform(F.split(v, ""), lambda ch, i: F.when(ch == " ", ch).otherwise(
            F.substring(flat, i + 1 - F.length(F.regexp_replace(F.substring(v, F.lit(1), i), "[^ ]", "")),
                        F.lit(1)))), "")
    return _let(body, form)


_TITLES_RE = rf"^((?:{_TITLE}\.? )+)"


def names_of(person: Column) -> Column:
    """A person without the titles."""
    return F.regexp_replace(person, _TITLES_RE, "")


def family_of(person: Column) -> Column:
    return F.substring_index(person, " ", -1)


def _names(values: dict, script: Column, female: Column | None = None) -> Column:
    """The names of a script (and gender) as an array."""
    table = F.create_map(*[F.lit(x) for k, names in values.items()
                           for x in (k if female is None else f"{k[0]} {k[1]}", names)])
    key = script if female is None else F.concat(F.when(female, "f ").otherwise("m "), script)
    return F.split(F.coalesce(F.try_element_at(table, key), F.lit("")), " ")


def _drawn(names: Column, stream: Column, n: Column, between: str) -> Column:
    """``n`` names from an array, drawn from the first places of the stream."""
    return _let(names, lambda a: F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(
        a, _number(stream, i, F.size(a)))), between))


def _family(family: Column, female: Column, key: Column, attempt: Column) -> Column:
    """A family name, drawn by itself so that all its bearers agree."""
    syllables = F.when(attempt >= FREE_FROM, 7).otherwise(3)

    def drawn(script):
        return _let(_stream(key, "family", F.lower(family), attempt), lambda s: F.concat(
            _drawn(_names(SYLLABLES, script), s, syllables, ""), F.get(_names(ENDINGS, script, female), F.lit(0))))
    return _cased(family, F.initcap(_let(_script(family), drawn)))


def _cased(name: Column, drawn: Column) -> Column:
    return F.when(name.rlike(r"^[\p{Lu}'’\-]{2,}$"), F.upper(drawn)).otherwise(drawn)


def _female(titles: Column, given: Column) -> Column:
    """By the title; behind one of either gender by the given name."""
    listed = "|".join(n for (g, _), names in GIVEN.items() if g == "f" for n in names.split())
    return (F.when(titles.rlike(rf"(?:^| ){_TITLES_F}\.? "), F.lit(True))
            .when(titles.rlike(rf"(?:^| ){_TITLES_M}\.? "), F.lit(False))
            .otherwise(F.coalesce(given.rlike(rf"(?iu)^(?:{listed})$|[aаяαη]$"), F.lit(False))))


def _person(v: Column, key: Column, attempt: Column, family_attempt: Column) -> Column:
    def parts(names):
        several = F.size(names) > 1
        return F.struct(F.regexp_extract(v, _TITLES_RE, 1).alias("titles"), F.element_at(names, -1).alias("family"),
                        F.when(several, F.get(names, F.lit(0))).alias("given"))

    def given(q, female):
        more = F.least(F.floor(attempt / FREE_FROM), F.lit(3)).cast("int")
        drawn = _let(_stream(key, "given", F.lower(q["given"]), attempt), lambda s: _drawn(
            _names(GIVEN, _script(q["given"]), female), s, 1 + more, "-"))
        return F.when(q["given"].isNotNull(), _cased(q["given"], drawn))

    # concat_ws leaves out a null: a person without a given name
    return _let(_let(F.split(names_of(v), " "), parts), lambda q: _let(
        _female(q["titles"], q["given"]), lambda female: F.concat(q["titles"], F.concat_ws(
            " ", given(q, female), _family(q["family"], female, key, family_attempt)))))


def surrogate(kind: Column, v: Column, attempt: Column, key: Column, part_attempt: Column | None = None) -> Column:
    """The replacement of entity ``v``; ``part_attempt``: that of a person's
    family name or an address's domain."""
    part_attempt = F.lit(0) if part_attempt is None else part_attempt

    def drawn(c, s):
        n = F.length(c)
        card = _let(_draw_digits(s, n - 1, F.substring(c, 1, 1)), lambda d: F.concat(d, _check_digit(d)))
        lead = F.when(kind == "phone", 2 + _number(s, F.lit(60), 8)).otherwise(1 + _number(s, F.lit(60), 8)).cast("string")
        digits = F.when(kind == "card", card).otherwise(F.concat(
            lead, _draw_digits(s, F.greatest(F.when(kind == "phone", n - 1).otherwise(F.lit(8)), F.lit(1)))))
        return (F.when(kind == "email", _email(v, s, key, attempt, part_attempt))
                .when(kind == "domain", _domain(v, s, attempt))
                .when(kind.isin("hardware", "address6"), _hexwise(v, s))
                .when(kind == "address", _ip(v, s, attempt))
                .when(kind.isin("card", "phone", "social"), _let(digits, lambda d: _fill(v, d)))
                .when(kind == "account", _account(v, s))
                .when(kind == "person", _person(v, key, attempt, part_attempt))
                .when(kind == "family", _family(v, F.lit(False), key, attempt))
                .when(kind.isin("access_key", "token", "private_key", "secret"), _spanned(v, kind, s))
                .otherwise(v))
    return _let(canonical(kind, v), lambda c: _let(_stream(key, kind, c, attempt), lambda s: drawn(c, s)))


def found(text: Column) -> Column:
    """Array of a text's entity candidates, in order: v and led (whether it
    stands behind a keyword of a secret)."""
    none = F.array().cast("array<struct<v:string,led:boolean>>")
    values = F.regexp_extract_all(text, F.lit(ENTITY_RE), F.lit(0))

    def entity(v, led):
        return F.struct(v.alias("v"), led.alias("led"))
    plain = F.transform(values, lambda v: entity(v, F.lit(False)))
    # a keyword may reach into the entity before it
    marked = _let(F.struct(values.alias("v"), F.split(text, ENTITY_RE).alias("p")), lambda x: F.transform(
        x["v"], lambda v, i: entity(v, F.concat(F.coalesce(F.get(x["v"], i - 1), F.lit("")), F.get(x["p"], i))
                                    .rlike(f"{_KEYWORD}$"))))
    return F.when(text.rlike(_KEYWORD), marked).when(text.rlike(_HINT_RE), plain).otherwise(none)


def redrawn(entities: DataFrame, key: Column, max_attempts: int = MAX_ATTEMPTS) -> DataFrame | None:
    """(kind, canon, attempt) of the entities that need a later attempt; None
    if no surrogate collides.  ``entities``: distinct kind, canon with one
    writing v, and the attempt of its part (family name or domain)."""
    state = entities.withColumn("attempt", F.lit(0))
    # family names are compared in the form that men bear
    borne = F.regexp_replace(F.regexp_replace("canon", "ова$", "ов"), "η$", "ης")
    real = entities.select(F.col("kind").alias("_rk"), F.when(F.col("kind") == "family", borne).otherwise(
        F.col("canon")).alias("_rc"), F.lit(True).alias("_real")).distinct()
    moved = False
    for _ in range(max_attempts):
        drawn = state.withColumn("s", canonical(F.col("kind"), surrogate(
            F.col("kind"), F.col("v"), F.col("attempt"), key, F.col("part_attempt"))))
        # settled entities keep their surrogate: lower attempts come first
        order = Window.partitionBy("kind", "s").orderBy("attempt", "canon")
        judged = (drawn.withColumn("_n", F.row_number().over(order))
                  .join(real, (F.col("kind") == F.col("_rk")) & (F.col("s") == F.col("_rc")), "left")
                  .withColumn("bad", (F.col("_n") > 1) | F.coalesce("_real", F.lit(False))))
        judged = written(judged.select("kind", "canon", "v", "part_attempt", "attempt", "bad"), "surrogate-round")
        if judged.where("bad").isEmpty():
            return state.where("attempt > 0").select("kind", "canon", "attempt") if moved else None
        moved = True
        state = judged.select("kind", "canon", "v", "part_attempt", (F.col("attempt") + F.col("bad").cast("int")).alias("attempt"))
    raise RuntimeError(f"surrogates still collide after {max_attempts} attempts")


def part_of(kind: Column, v: Column) -> Column:
    """What an entity shares with others: a person's family name, an address's
    domain."""
    return F.when(kind == "person", family_of(v)).when(kind == "email", domain_of(v))


PARTS = {"person": "family", "email": "domain"}


def _part_kind(kind: Column) -> Column:
    return F.when(kind == "person", F.lit("family")).when(kind == "email", F.lit("domain"))


_WORD_RE = r"\p{L}['’]?\p{L}+(?:['’\-]\p{L}+){0,2}"


def _mentions(pairs: Column) -> Column:
    """Old and new family names and full names of a text's persons, as arrays
    side by side."""
    persons = F.array_distinct(F.filter(pairs, lambda p: p["kind"] == "person"))
    part = {"family": family_of, "full": names_of}

    def each(q, f, side):
        return F.transform(q, lambda p: f(p[side]))
    return _let(persons, lambda q: F.struct(*[
        each(q, f, side).alias(f"{side}_{name}") for name, f in part.items() for side in ("old", "new")]))


def _referred(text: Column, m: Column) -> Column:
    """``text`` with the family names of replaced persons replaced where they
    stand without a title, and the given names before them.  One pass over the
    words, each looked up among the names of this text."""
    def new(found):
        words, gaps = found["w"], found["g"]

        def one(w, i):
            full = F.when(F.get(gaps, i + 1) == " ", F.concat(w, F.lit(" "), F.get(words, i + 1)))
            at = F.array_position(m["old_full"], full)
            given = F.when(at > 0, F.substring_index(F.get(m["new_full"], (at - 1).cast("int")), " ", 1))
            place = F.array_position(m["old_family"], w)
            family = F.when(place > 0, F.get(m["new_family"], (place - 1).cast("int")))
            return F.coalesce(given, family, w)
        return F.array_join(F.zip_with(gaps, F.transform(words, one), lambda g, w: F.concat(g, F.coalesce(w, F.lit("")))), "")
    return _let(F.struct(F.regexp_extract_all(text, F.lit(_WORD_RE), F.lit(0)).alias("w"),
                         F.split(text, _WORD_RE).alias("g")), new)


def _replaced(docs: DataFrame, keep: Column, key_text: str) -> DataFrame:
    """_keep, _text, _new (the text with surrogates) and _kinds of the entities
    replaced.  Entities are searched once; the table of texts and entities is
    written, and all later steps read it."""
    key = F.lit(key_text)
    d = docs.select(keep.alias("_keep"), col("text").cast("string").alias("_text"))
    d = written(d.withColumn("_e", found(F.coalesce("_text", F.lit("")))), "surrogate-found")
    one = (d.where(F.size("_e") > 0).select(F.explode("_e").alias("e"))
           .groupBy(F.col("e.v").alias("v"), F.col("e.led").alias("led")).agg(F.count(F.lit(1)).alias("n")))
    one = one.withColumn("kind", kind_of(F.col("v"), F.col("led"))).where("kind is not null")
    one = one.withColumn("canon", canonical(F.col("kind"), F.col("v")))
    entities = written(one.groupBy("kind", "canon").agg(F.min("v").alias("v")), "surrogate-entities")
    entities = entities.withColumns({"_k": _part_kind(F.col("kind")), "_p": F.lower(part_of(F.col("kind"), F.col("v")))})
    parts = (entities.where("_k is not null").select(F.col("_k").alias("kind"), part_of(F.col("kind"), F.col("v")).alias("v"))
             .groupBy("kind", F.lower("v").alias("canon")).agg(F.min("v").alias("v")))
    first = redrawn(parts.withColumn("part_attempt", F.lit(0)), key)
    if first is None:
        entities = entities.drop("_k", "_p").withColumn("part_attempt", F.lit(0))
    else:
        borne = first.select(F.col("kind").alias("_k"), F.col("canon").alias("_p"),
                             F.col("attempt").alias("part_attempt"))
        entities = (entities.join(borne, ["_k", "_p"], "left").drop("_k", "_p")
                    .withColumn("part_attempt", F.coalesce("part_attempt", F.lit(0))))
    late = redrawn(entities, key)
    if first is not None:
        late = first if late is None else late.unionByName(first)
    attempts = F.lit(None).cast("map<string,int>")
    if late is not None:
        # per text with a redrawn entity, which attempt each takes
        hashed = F.md5(F.col("_text").cast("binary"))
        some = (d.where(F.size("_e") > 0).select(hashed.alias("_h"), F.explode("_e").alias("e")).distinct())
        some = (some.select("_h", F.col("e.v").alias("v"), kind_of(F.col("e.v"), F.col("e.led")).alias("kind"))
                .where("kind is not null"))
        bearers = some.where(F.col("kind").isin(*PARTS)).select(
            "_h", part_of(F.col("kind"), F.col("v")).alias("v"), _part_kind(F.col("kind")).alias("kind"))
        some = some.unionByName(bearers)
        some = some.withColumn("canon", canonical(F.col("kind"), F.col("v"))).select("_h", "kind", "canon").distinct()
        per = (some.join(late, ["kind", "canon"]).groupBy("_h").agg(F.map_from_entries(F.collect_list(
            F.struct(F.concat_ws("|", "kind", "canon"), "attempt"))).alias("_late")))
        d = d.withColumn("_h0", F.when(F.size("_e") > 0, hashed))
        d = d.join(per, F.col("_h0") == F.col("_h"), "left").drop("_h", "_h0")
        attempts = F.col("_late")

    def new(e):
        v = e["v"]

        def attempt_of(k, canon):
            return F.lit(0) if late is None else F.coalesce(F.try_element_at(
                attempts, F.concat_ws("|", k, canon)), F.lit(0))

        def typed(k):
            drawn = _let(attempt_of(k, canonical(k, v)), lambda n: _let(
                attempt_of(_part_kind(k), F.lower(part_of(k, v))), lambda m: surrogate(k, v, n, key, m)))
            return F.struct(k.alias("kind"), v.alias("old"), F.coalesce(drawn, v).alias("new"))
        return _let(kind_of(v, e["led"]), typed)

    d = held(d, "_pairs", F.transform("_e", new))
    d = held(d, "_pieces", F.when(F.size("_e") > 0, F.split("_text", ENTITY_RE)))
    named = F.exists("_pairs", lambda p: F.coalesce(p["kind"] == "person", F.lit(False)))
    d = held(d, "_m", F.when(named, _mentions(F.col("_pairs"))))
    pieces = F.when(F.col("_m").isNotNull(), F.transform("_pieces", lambda p: _referred(p, F.col("_m")))).otherwise(F.col("_pieces"))
    whole = F.concat(F.array_join(F.zip_with(pieces, F.transform("_pairs", lambda p: p["new"]), lambda p, e: F.concat(
        p, F.coalesce(e, F.lit("")))), ""))
    d = d.withColumn("_kinds", F.filter(F.transform("_pairs", lambda p: p["kind"]), lambda k: k.isNotNull()))
    d = held(d, "_new", F.when(F.size("_e") > 0, whole).otherwise(F.col("_text")))
    return d.select("_keep", "_text", "_new", "_kinds")


def anonymized(docs: DataFrame, key: str) -> DataFrame:
    """The documents with all their columns, personal data replaced (and
    n_chars, where it is a column, brought up to date)."""
    d = _replaced(docs, whole_row(docs), key)
    out = [F.col("_new").alias(c) if c == "text"
           else F.when(F.size("_kinds") > 0, F.length("_new")).otherwise(F.col("_keep").getField(c))
           .cast(docs.schema[c].dataType).alias(c) if c == "n_chars"
           else F.col("_keep").getField(c).alias(c) for c in docs.columns]
    return d.select(*out)


def surrogate_report(docs: DataFrame, key: str) -> DataFrame:
    """doc_id, text with surrogates, n_entities and the sorted kinds."""
    d = _replaced(docs, col("doc_id"), key)
    return d.select(F.col("_keep").alias("doc_id"), F.col("_new").alias("text"), F.size("_kinds").cast("long").alias("n_entities"),
                    F.array_join(F.array_sort(F.array_distinct("_kinds")), ",").alias("kinds"))
