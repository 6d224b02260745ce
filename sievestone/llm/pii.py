"""Surrogates for personal data: keyed, of the same kind and form, distinct where the originals are; built-in expressions only.

Found are e-mail addresses, IPv4 addresses, payment cards (by Luhn sum), telephone numbers, US social security numbers,
IBANs and names of persons: after a title, after words that introduce a name, or with a known given name
(GIVEN_F, GIVEN_M, and those that the caller adds).  Names in scripts without capitals are not found.  Every
distinct entity of the corpus gets one surrogate for its normal form, so whatever refers to it stays together:
case of addresses and spacing of numbers don't matter, domains and surnames are mapped on their own.

Numbers and addresses are permuted within their own format (a Feistel network over their characters, keyed by
SHA-512; between its way there and back every character is shifted by a keyed step that isn't zero).  A permutation
can't run out and can't give two originals one surrogate, and the shift leaves none as it was.  A letter
stays a letter and a digit a digit; numbers keep length, spacing, country code, issuer digit, Luhn
remainder and IBAN check; addresses keep the range that they are from and a reserved domain's name holds mapped ones.

Names are coined from syllables that a keyed hash picks, in the script and for the gender of the original; those that collide
are ranked within their hash and tell their rank by further syllables, which no other name can spell.  Names
keep title and case, and a middle initial becomes that of the new surname.

Documents get their own entities' surrogates by joins on keys; an entity that many documents name is joined by
broadcast (at most a thousand of them can be that frequent).  Only documents with entities are joined.
"""

from __future__ import annotations

import re
import secrets
from itertools import groupby

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievestone.llm import spans as S
from sievestone.llm.common import free_name
from sievestone.session import cut, join_keyed, table, written

#: The session's setting that holds the key.
KEY_SETTING = "sievestone.surrogates.key"
KINDS = ("email", "ip", "card", "phone", "ssn", "iban", "name")
ROUNDS = 8

#: Titles by gender, and given names by gender.
TITLES_F = ("Mrs", "Ms", "Miss", "Frau", "Mme", "Madame", "Mlle", "Sra", "Señora", "Госпожа", "Κυρία")
TITLES_M = ("Mr", "Herr", "Monsieur", "Sr", "Señor", "Господин", "Κύριος")
TITLES_N = ("Dr", "Prof")
GIVEN_F = tuple(
    "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Nancy Lisa Margaret Emily Michelle Amanda Melissa Deborah Stephanie Rebecca Laura Emma Olivia Sophia "
    "Anna Maria Julia Sophie Marie Camille Claire Chloé Léa Katharina Ursula Heike Sabine Lucía Carmen Isabel Pilar Giulia Chiara Francesca Ingrid Astrid Agnieszka Katarzyna "
    "Fatima Aisha Khadija Leila Noor Yasmin Priya Ananya Lakshmi Deepika Sunita Mei Xiu Ling Yuki Sakura Keiko Thanh Siti Amina Ngozi Ayşe Zeynep "
    "Мария Анна Елена Ольга Наталья Татьяна Ελένη Κατερίνα Δήμητρα".split()
)
GIVEN_M = tuple(
    "James John Robert Michael William David Richard Joseph Thomas Charles Daniel Matthew Anthony Steven Andrew Kenneth Kevin Brian Edward Ronald Timothy Jason Jeffrey Peter "
    "Hans Karl Jürgen Klaus Wolfgang Stefan Pierre Jean Louis François Antoine Antonio Carlos Javier Miguel Pedro Giovanni Giuseppe Marco Lars Olaf Piotr Krzysztof "
    "Ahmed Mohammed Muhammad Omar Ali Hassan Ibrahim Yusuf Raj Arjun Rahul Sanjay Vikram Amit Wei Jian Hiroshi Takashi Kenji Nguyen Budi Kwame Chukwu Mehmet Mustafa "
    "Иван Алексей Дмитрий Сергей Николай Владимир Γιώργος Νίκος Δημήτρης".split()
)
#: Words that introduce a name.
CUES = ("my name is", "My name is", "Name:", "name:", "Contact:", "Attn:", "Signed,", "signed by", "mein Name ist", "Mein Name ist", "je m'appelle", "Je m'appelle", "me llamo", "Me llamo", "меня зовут", "Меня зовут", "με λένε", "Με λένε")


#: Words before a given name that make it a place, and words that no name begins with, or that show that what is introduced is no person.
PLACES = ("San", "Santa", "Saint", "São", "Port", "Fort", "Mount", "Lake")
NO_NAMES = ("The", "This", "Our", "Your", "All", "New", "Annual", "Quarterly", "Monthly", "Weekly", "Daily")
NO_PERSONS = (
    "Ltd Inc LLC GmbH AG Corp Company Group Bank University College School Hospital Institute Department Office Team Support Service Services Centre Center Desk "
    "Report Form List Notes Summary Project Plan Street Road Avenue Committee Council Ministry Association"
).split()


def _any(*groups: tuple) -> str:
    """One of the words, sorted out by their first letter."""
    words = sorted({w for g in groups for w in g})
    return "(?:" + "|".join(f"{first}(?:{'|'.join(re.escape(w[1:]) for w in sorted(own, key=len, reverse=True))})" for first, own in groupby(words, key=lambda w: w[0])) + ")"


_NAME = r"\p{Lu}[\p{L}'’-]+"
_REST = rf"(?:(?: \p{{Lu}}\.)? {_NAME})"


def name_pattern(given: tuple = ()) -> str:
    titled = rf"{_any(TITLES_F, TITLES_M, TITLES_N)}\.? (?:\p{{Lu}}\. )?{_NAME}{_REST}?"
    person = rf"(?!{_any(NO_NAMES)} )(?!(?:{_NAME} ){{1,3}}{_any(tuple(NO_PERSONS))}(?!\p{{L}}))"
    introduced = rf"(?<=(?:{'|'.join(CUES)}) ){person}{_NAME}{_REST}{{1,2}}"
    known = rf"(?<!(?:{'|'.join(PLACES)}) ){_any(GIVEN_F, GIVEN_M, given)}{_REST}"
    capital = rf"{_any(tuple(x.upper() for x in (*GIVEN_F, *GIVEN_M, *given)))}(?: \p{{Lu}}\.)? \p{{Lu}}[\p{{Lu}}'’-]+(?!\p{{Ll}})"
    return rf"(?=\p{{Lu}})(?<!\p{{L}})(?:{titled}|{known}|{capital}|{introduced})(?!\p{{L}})"


#: Each begins with a look at the next character, which most places fail at once.
PATTERNS = (
    r"(?=[A-Za-z0-9._%+-])(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63})*\.[A-Za-z]{2,24}(?![A-Za-z0-9])",
    r"(?=[0-9])(?<![A-Za-z0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![A-Za-z0-9]|\.[0-9])",
    r"(?=[2-6])(?<![A-Za-z0-9+.-])[2-6][0-9]{3}(?:[0-9]{9,15}|(?:[ -][0-9]{4}){2}[ -][0-9]{4}(?:[ -][0-9]{3})?|[ -][0-9]{6}[ -][0-9]{5})(?![A-Za-z0-9])",
    r"(?=[0-9+(])(?<![A-Za-z0-9+.-])(?:\+1[ .-]?(?:\([0-9]{3}\)|[0-9]{3})[ .-]?[0-9]{3}[ .-]?[0-9]{4}|\+(?!1[ .(-])[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}|\([0-9]{3}\)[ .-]?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}([.-])[0-9]{3}\1[0-9]{4}|[2-9][0-9]{2} [2-9][0-9]{2} [0-9]{4}"
    r"|0[1-9][0-9]{1,3}[ /-](?:[0-9]{5,8}|[0-9]{3,4} [0-9]{3,4})|0[1-9](?:[ .][0-9]{2}){4})(?![A-Za-z0-9])",
    r"(?=[0-9])(?<![A-Za-z0-9.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9-])",
    r"(?=[A-Z])(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9])",
    name_pattern(),
)


def guards(text: Column) -> tuple:
    """What a text must have for each kind: an at sign, or digits as the kind has them; names need no more than their pattern."""
    pair = text.rlike("[0-9]{2}")
    return F.contains(text, F.lit("@")), text.rlike("[0-9][.][0-9]"), text.rlike("[0-9]{4}"), pair, text.rlike("[0-9]-[0-9]"), text.rlike("[A-Z][A-Z][0-9]"), None


#: Syllables of made names, by script.  None begins another, so a name tells its syllables.
SYLLABLES = {
    "latin": ("ba", "be", "bri", "ca", "co", "da", "del", "do", "fa", "fe", "ga", "gil", "ha", "ho", "ja", "ka", "ki", "la", "lo", "ma", "mo", "na", "no", "pa", "ra", "ri", "sa", "so", "ta", "to", "va", "wi"),
    "cyrillic": ("ба", "бе", "ва", "ве", "га", "го", "да", "де", "жа", "за", "зо", "ка", "ко", "ла", "ле", "ма", "ми", "на", "но", "па", "по", "ра", "ре", "са", "со", "та", "то", "фа", "фе", "ха", "ча", "ша"),
    "greek": ("βα", "βε", "γα", "γο", "δα", "δε", "ζα", "θα", "θε", "κα", "κο", "λα", "λε", "μα", "με", "μι", "να", "νο", "ξα", "πα", "πε", "ρα", "ρε", "σα", "σο", "τα", "τε", "φα", "φι", "χα", "χο", "ψα"),
}
#: A syllable that only a name has which would else be as it was.
OTHER = {"latin": "zu", "cyrillic": "зу", "greek": "ζυ"}
#: Endings of made given names and surnames: female, male, neither.
ENDINGS = {"latin": (("na", "lia"), ("us", "rd"), ("n", "l")), "cyrillic": (("на", "лия"), ("н", "р"), ("ль", "ко")), "greek": (("να", "λια"), ("ς", "νος"), ("κη", "λη"))}
SURNAMES = {"latin": ("son", "ner", "ville", "dez"), "cyrillic": ("ко", "ных", "ян", "ер"), "greek": ("δη", "κου", "λη", "τσα")}


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _hash(key: str, *parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), *parts).cast("binary"), 512)


def _number(h: Column, i) -> Column:
    """The i-th 16-bit number (from 0, again from the start after 32) of a hash in hex."""
    i = F.lit(i) if isinstance(i, int) else i
    return F.conv(F.substring(h, 4 * (i % 32) + 1, F.lit(4)), 16, 10).cast("int")


def _pick(choices, n: Column) -> Column:
    return F.get(F.array(*map(F.lit, choices)), n % len(choices))


def _script(c: Column) -> Column:
    return F.when(c.rlike(r"\p{IsCyrillic}"), "cyrillic").when(c.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")


def permuted(key: str, label: Column, symbols: Column) -> Column:
    """A permutation of all arrays of symbols (v, r: a value below r) with the same r, keyed by `key` and `label`.

    Halves take turns: each is moved by a hash of the other, ROUNDS times.  Then every v with room is moved by a keyed
    step that isn't zero, and the rounds are undone: no array but one without room stays as it was.
    """
    v, r = (lambda x: F.transform(x, lambda s: s["v"])), (lambda x: F.transform(x, lambda s: s["r"]))

    def run(own: Column) -> Column:
        all_, half, form = own["all"], own["half"], own["form"]
        start = F.struct(F.slice(v(all_), F.lit(1), half).alias("a"), F.slice(v(all_), half + 1, F.size(all_) - half).alias("b"))
        moved = lambda part, room, by: F.transform(part, lambda x, i: F.pmod(x + by(i), F.get(room, i)))
        first, second = F.slice(r(all_), F.lit(1), half), F.slice(r(all_), half + 1, F.size(all_) - half)

        def step(state: Column, j: Column) -> Column:
            turn = F.when(j <= ROUNDS, j).otherwise(2 * ROUNDS + 2 - j)
            sign = F.when(j <= ROUNDS, 1).otherwise(-1)
            seen = lambda other: _hash(key, label, form, turn.cast("string"), F.array_join(other.cast("array<string>"), "."))
            a, b = state["a"], state["b"]
            by_b = S.let(seen(b), lambda h: moved(a, first, lambda i: sign * _number(h, i)))
            by_a = S.let(seen(a), lambda h: moved(b, second, lambda i: sign * _number(h, i)))
            fixed = _hash(key, label, form, F.lit("step"))
            away = lambda part, room, off: S.let(fixed, lambda h: moved(part, room, lambda i: F.when(F.get(room, i) > 1, 1 + _number(h, i + off) % F.greatest(F.get(room, i) - 1, F.lit(1))).otherwise(0)))
            middle, odd = j == ROUNDS + 1, turn % 2 == 1
            return F.struct(F.when(middle, away(a, first, 0)).when(odd, by_b).otherwise(a).alias("a"), F.when(middle, away(b, second, 16)).when(odd, b).otherwise(by_a).alias("b"))

        return F.aggregate(F.sequence(F.lit(1), F.lit(2 * ROUNDS + 1)), start, step, lambda s: F.concat(s["a"], s["b"]))

    given = F.struct(symbols.alias("all"), F.floor(F.size(symbols) / 2).cast("int").alias("half"), F.array_join(r(symbols).cast("array<string>"), ".").alias("form"))
    return S.let(given, run)


def _characters(text: Column, marks: bool | Column = False) -> Column:
    """The characters of an ASCII text as symbols (v, r, base): digits and letters have room; marks of addresses only if asked."""
    marks = F.lit(marks) if isinstance(marks, bool) else marks

    def one(c: Column) -> Column:
        code, mark = F.ascii(c), F.instr(F.lit("._%+-"), c)
        symbol = lambda v, r, base: F.struct(v.alias("v"), F.lit(r).alias("r"), F.lit(base).alias("base") if isinstance(base, int) else base.alias("base"))
        return F.when(c.rlike("[0-9]"), symbol(code - 48, 10, 48)).when(c.rlike("[a-z]"), symbol(code - 97, 26, 97)).when(c.rlike("[A-Z]"), symbol(code - 65, 26, 65)).when(marks & (mark > 0), symbol(mark - 1, 5, -1)).otherwise(symbol(F.lit(0), 1, code))

    return F.transform(F.filter(F.split(text, ""), lambda c: c != ""), one)


def _permuted_text(key: str, label, text: Column, marks: bool | Column = False) -> Column:
    """The text with its digits and letters permuted among the texts of the same form."""
    label = F.lit(label) if isinstance(label, str) else label

    def write(symbols: Column) -> Column:
        char = lambda x, s: F.when(s["base"] < 0, F.substring(F.lit("._%+-"), x + 1, F.lit(1))).otherwise(F.char(x + s["base"]))
        return F.array_join(F.zip_with(permuted(key, label, symbols), symbols, char), "")

    return F.when(text == "", "").otherwise(S.let(_characters(text, marks), write))


def _luhn(digits: Column) -> Column:
    """The Luhn sum modulo 10 of a string of digits."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = F.when((n - i) % 2 == 1, 2 * d).otherwise(d)
        return total + F.when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10


#: Ranges of IPv4 addresses that a surrogate stays in: a pattern, and for the first two octets the numbers in the range.
_FREE = tuple(i for i in range(1, 224) if i not in (10, 127, 172, 192))
RANGES = (
    (r"^10\.", (10,), range(256)), (r"^127\.", (127,), range(256)), (r"^192\.168\.", (192,), (168,)), (r"^172\.(1[6-9]|2[0-9]|3[01])\.", (172,), range(16, 32)),
    (r"^192\.", (192,), tuple(i for i in range(256) if i != 168)), (r"^172\.", (172,), tuple(i for i in range(256) if not 16 <= i < 32)),
    (r"^(0|22[4-9]|2[3-5][0-9])\.", (0, *range(224, 256)), range(256)), (r"^", _FREE, range(256)),
)


def _address(key: str, norm: Column) -> Column:
    """An IPv4 address of the same range.  norm: four numbers without leading zeros."""
    octet = F.transform(F.split(norm, "[.]"), lambda x: x.cast("int"))

    numbers = lambda x: F.sequence(F.lit(x[0]), F.lit(x[-1])) if isinstance(x, range) else F.array(*map(F.lit, x))
    ranges = [F.struct(F.lit(f"ip{pattern}").alias("label"), numbers(first).alias("first"), numbers(second).alias("second")) for pattern, first, second in RANGES]
    own = ranges[-1]
    for (pattern, _, _), one in reversed(list(zip(RANGES[:-1], ranges[:-1], strict=True))):
        own = F.when(norm.rlike(pattern), one).otherwise(own)

    def moved(given: Column) -> Column:
        o, r = given["octets"], given["range"]
        within = lambda i, name: F.struct((F.array_position(r[name], F.get(o, F.lit(i))) - 1).cast("int").alias("v"), F.size(r[name]).alias("r"))
        plain = lambda i: F.struct(F.get(o, F.lit(i)).alias("v"), F.lit(256).alias("r"))
        made = permuted(key, r["label"], F.array(within(0, "first"), within(1, "second"), plain(2), plain(3)))
        text = lambda m: F.concat_ws(".", *[F.get(r[n], F.get(m, F.lit(i))).cast("string") for i, n in enumerate(("first", "second"))], *[F.get(m, F.lit(i)).cast("string") for i in (2, 3)])
        return S.let(made, text)

    return S.let(F.struct(octet.alias("octets"), own.alias("range")), moved)


def _rest97(text: Column) -> Column:
    """The number that digits and letters (A is 10) of a text make, modulo 97."""

    def add(total: Column, c: Column) -> Column:
        n = F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), c) - 1
        return ((total * F.when(n < 10, 10).otherwise(100) + n) % 97).cast("int")

    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(0), add)


def _iban(key: str, norm: Column) -> Column:
    """Country as it was, account permuted, and check digits as right, or as far off, as they were."""
    right = lambda body: 98 - _rest97(F.concat(body, F.substring(norm, 1, 2), F.lit("00")))
    body = F.substring(norm, F.lit(5), F.length(norm))
    made = _permuted_text(key, F.concat(F.lit("iban"), F.substring(norm, 1, 2)), body)
    check = lambda b: F.lpad(F.pmod(right(b) + F.substring(norm, 3, 2).cast("int") - right(body), F.lit(100)).cast("string"), 2, "0")
    return S.let(made, lambda b: F.concat(F.substring(norm, 1, 2), check(b), b))


def _card(key: str, norm: Column) -> Column:
    """Issuer digit as it was, the others permuted, the last one by the Luhn sum."""
    body = F.substring(norm, F.lit(2), F.length(norm) - 2)
    made = F.concat(F.substring(norm, 1, 1), _permuted_text(key, F.concat(F.lit("card"), F.substring(norm, 1, 1)), body))
    return S.let(made, lambda b: F.concat(b, ((_luhn(norm) - _luhn(F.concat(b, F.lit("0"))) + 10) % 10).cast("string")))


def _phone(key: str, norm: Column) -> Column:
    """norm: country code, bar, digits.  A leading 0 or 1 stays, and no other number gets one."""
    code, number = F.substring_index(norm, "|", 1), F.substring_index(norm, "|", -1)
    lead = F.regexp_extract(number, "^[01]", 0)
    rest = F.substring(number, F.length(lead) + 1, F.length(number))
    bounded = lambda s, i: F.when((i == 0) & (lead == ""), F.struct((s["v"] - 2).alias("v"), F.lit(8).alias("r"), F.lit(50).alias("base"))).otherwise(s)
    label = F.concat(F.lit("phone"), code, F.lit("|"), lead)
    write = lambda own: F.array_join(F.zip_with(permuted(key, label, own), own, lambda x, s: F.char(x + s["base"])), "")
    return F.concat(code, F.lit("|"), lead, S.let(F.transform(_characters(rest), bounded), write))


def _surrogate(key: str) -> Column:
    """The surrogate of a row (kind, norm), names apart, in normal form."""
    kind, norm = F.col("kind"), F.col("norm")
    local = _permuted_text(key, "local", norm, ~norm.rlike("[a-z0-9]"))
    domain = F.concat(_permuted_text(key, "domain", F.regexp_replace(norm, r"\.[^.]*$", "")), F.lit(".example."), F.substring_index(norm, ".", -1))
    return (
        F.when(kind == "local", local).when(kind == "domain", domain).when(kind == "ip", _address(key, norm)).when(kind == "card", _card(key, norm))
        .when(kind == "phone", _phone(key, norm)).when(kind == "iban", _iban(key, norm)).otherwise(_permuted_text(key, kind, norm))
    )


def _coined(rows: DataFrame, key: str) -> DataFrame:
    """(kind, norm, surrogate) of the parts of names; norm: gender (f, m, n) or s for a surname, colon, the part in lower case.

    Three syllables come from a hash.  Parts with the same three are ranked, a hash's worth of them at a time, and the
    rank, where it isn't the first, follows as syllables.
    """
    norm = F.col("norm")
    role, part = F.substring(norm, 1, 1), F.substring(norm, F.lit(3), F.length(norm))
    hashed = rows.select("kind", "norm", role.alias("role"), part.alias("part"), _script(part).alias("script"), _hash(key, F.lit("name"), norm).alias("h")).withColumn("three", _number(F.col("h"), 0) % 32768)
    rank = F.row_number().over(Window.partitionBy("role", "script", "three").orderBy("norm")) - 1
    three, script, h = F.col("three"), F.col("script"), F.col("h")
    by_script = lambda table_, n: F.when(script == "cyrillic", _pick(table_["cyrillic"], n)).when(script == "greek", _pick(table_["greek"], n)).otherwise(_pick(table_["latin"], n))
    digits = F.when(F.col("rank") > 0, F.split(F.conv(F.col("rank"), 10, 32), "")).otherwise(F.array().cast("array<string>"))
    further = F.array_join(F.transform(F.filter(digits, lambda c: c != ""), lambda c: by_script(SYLLABLES, F.conv(c, 32, 10).cast("int"))), "")
    body = F.concat(by_script(SYLLABLES, three % 32), by_script(SYLLABLES, F.floor(three / 32).cast("int") % 32), by_script(SYLLABLES, F.floor(three / 1024).cast("int")), further)
    ends = lambda i: by_script({k: x[i] for k, x in ENDINGS.items()}, _number(h, 1))
    ending = F.when(F.col("role") == "f", ends(0)).when(F.col("role") == "m", ends(1)).when(F.col("role") == "s", by_script(SURNAMES, _number(h, 1))).otherwise(ends(2))
    other = F.when(script == "cyrillic", OTHER["cyrillic"]).when(script == "greek", OTHER["greek"]).otherwise(OTHER["latin"])
    spelt = F.when(F.concat(body, ending) == F.col("part"), F.concat(body, other, ending)).otherwise(F.concat(body, ending))
    return hashed.withColumn("rank", rank).select("kind", "norm", F.concat("role", F.lit(":"), F.initcap(spelt)).alias("surrogate"))


def _gender(value: Column) -> Column:
    """f, m or n, by the title or given name that a name begins with, whatever its case."""
    word = lambda i: F.initcap(F.regexp_replace(F.get(F.split(value, " "), F.lit(i)), "[.]", ""))
    given = F.initcap(_given(value))
    second = F.when(given.isin(*GIVEN_F), "f").when(given.isin(*GIVEN_M), "m").otherwise("n")
    return F.when(word(0).isin(*TITLES_F, *GIVEN_F), "f").when(word(0).isin(*TITLES_M, *GIVEN_M), "m").otherwise(second)


def _titled(value: Column) -> Column:
    return F.regexp_replace(F.substring_index(value, " ", 1), "[.]", "").isin(*TITLES_F, *TITLES_M, *TITLES_N)


def _phone_norm(value: Column) -> Column:
    """Country code, bar, the other digits.  A number of three, three and four digits without a code is the one that has it with code 1."""
    national = ~F.startswith(value, F.lit("+")) & value.rlike(r"^\(?[2-9][0-9]{2}\)?[ .-]?[0-9]{3}[ .-][0-9]{4}$")
    code = F.when(national | F.startswith(value, F.lit("+1")) & (F.length(_digits(value)) == 11), "1").otherwise(F.regexp_extract(value, r"^\+([0-9]{1,3}?)(?:[ .(-])", 1))
    return F.concat(code, F.lit("|"), F.when(national, _digits(value)).otherwise(F.substring(_digits(value), F.length(code) + 1, F.length(value))))


def _entity(kind, norm: Column) -> Column:
    return F.struct((F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), norm.alias("norm"))


def _given(value: Column) -> Column:
    """The given name: the first word but a title, an initial or the last word; null if there is none."""
    words = F.split(value, " ")
    own = F.when(_titled(value), F.slice(words, F.lit(2), F.greatest(F.size(words) - 2, F.lit(0)))).otherwise(F.slice(words, F.lit(1), F.size(words) - 1))
    return F.get(F.filter(own, lambda w: ~F.endswith(w, F.lit("."))), F.lit(0))


def entities(span: Column) -> Column:
    """The entities (kind, normal form) that a span names; a lone given name is a surname's place taken."""
    v, k = span["value"], span["kind"]
    mail = F.array(_entity("local", F.lower(F.substring_index(v, "@", 1))), _entity("domain", F.lower(F.substring_index(v, "@", -1))))
    surname = _entity("name", F.concat(F.lit("s:"), F.lower(F.substring_index(v, " ", -1))))
    given = _entity("name", F.concat(_gender(v), F.lit(":"), F.lower(_given(v))))
    names = F.when(_given(v).isNull(), F.array(surname)).otherwise(F.array(given, surname))
    address = F.array_join(F.transform(F.split(v, "[.]"), lambda x: x.cast("int").cast("string")), ".")
    plain = _entity(F.get(F.array(*map(F.lit, KINDS)), k), F.when(k == 1, address).when(k == 3, _phone_norm(v)).when(k == 5, F.regexp_replace(v, " ", "")).otherwise(_digits(v)))
    return F.when(k == 0, mail).when(k == 6, names).otherwise(F.array(plain))


def entity_spans(text: Column, given: tuple = ()) -> Column:
    """Spans of all kinds, ordered.  A card's number has to have a Luhn sum of 0; `given` names further given names."""
    patterns = (*PATTERNS[:-1], name_pattern(given)) if given else PATTERNS
    every = [S.found(text, p, k, g) for k, (p, g) in enumerate(zip(patterns, guards(text), strict=True))]
    every[2] = F.filter(every[2], lambda s: _luhn(_digits(s["value"])) == 0)
    return S.ordered(F.concat(*every))


def surrogates(found: DataFrame, key: str) -> DataFrame:
    """(kind, norm, surrogate) of the distinct entities of `found`: no two alike, none as it was."""
    # Few bytes, but much work each: dealt out by number, which adaptive execution leaves as it is.
    tasks = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = cut(found.select("kind", "norm").distinct())
    plain = rows.filter("kind <> 'name'").repartition(tasks, "kind", "norm").select("kind", "norm", _surrogate(key).alias("surrogate"))
    return cut(plain.union(_coined(rows.filter("kind = 'name'"), key)))


def _spread(value: Column, digits: Column) -> Column:
    """The value with its digits (and, for IBANs, capitals) taken one after the other from `digits`."""
    start = F.struct(F.lit(1).alias("k"), F.lit("").alias("out"))

    def step(s: Column, i: Column) -> Column:
        c = F.substring(value, i, F.lit(1))
        own = c.rlike("[A-Z0-9]")
        return F.struct((s["k"] + F.when(own, 1).otherwise(0)).alias("k"), F.concat(s["out"], F.when(own, F.substring(digits, s["k"], F.lit(1))).otherwise(c)).alias("out"))

    return F.aggregate(F.sequence(F.lit(1), F.length(value)), start, step, lambda s: s["out"])


def _cased(made: Column, like: Column) -> Column:
    return F.when(like == F.upper(like), F.upper(made)).otherwise(made)


def _put(known: Column):
    """The text that stands in for a span, by the document's map from entity to surrogate."""
    def put(span: Column) -> Column:
        v = span["value"]
        title = F.when(_titled(v), F.concat(F.substring_index(v, " ", 1), F.lit(" "))).otherwise("")

        def named(own: Column) -> Column:
            surname = _cased(F.substring(own["last"], 3, 1000), F.substring_index(v, " ", -1))
            given = F.when(own["many"], F.concat(_cased(F.substring(own["first"], 3, 1000), _given(v)), F.lit(" "))).otherwise("")
            initial = lambda s: F.when(v.rlike(r" \p{Lu}\. "), F.concat(F.substring(s, 1, 1), F.lit(". "))).otherwise("")
            return S.let(surname, lambda s: F.concat(title, given, initial(s), s))

        def written_as(own: Column) -> Column:
            k, first = span["kind"], own["first"]
            # A number that is written without its country code stays so.
            digits = F.when((k == 3) & ~F.startswith(v, F.lit("+")), F.substring_index(first, "|", -1)).otherwise(F.regexp_replace(first, "[|]", ""))
            return F.when(k == 0, F.concat(first, F.lit("@"), own["last"])).when(k == 6, named(own)).when(k == 1, first).otherwise(_spread(v, digits))

        # Each is bound once: an expression that is looked at several times stands in the plan as often.
        ends = lambda keys: F.struct(F.try_element_at(known, F.get(keys, F.lit(0))).alias("first"), F.try_element_at(known, F.element_at(keys, -1)).alias("last"), (F.size(keys) > 1).alias("many"))
        names = F.transform(entities(span), lambda e: F.concat(e["kind"], F.lit("/"), e["norm"]))
        return S.let(S.let(names, ends), written_as)

    return put


def replace_entities(docs: DataFrame, key: str, text: str = "text", spans: str | None = None, given: tuple = ()) -> DataFrame:
    """`docs` with surrogates in its texts, and, if named, the array of the spans that they replaced.

    The key is what keeps surrogates from being undone, so there is none by default; an empty one is refused.  The same key
    gives the same numbers and addresses in any corpus; names also depend on those that the corpus has.  Further
    given names may be added, a few thousand at most, as they go into a pattern.
    Null texts stay null; rows without entities stay as they are, repeated rows stay, an empty table gives no rows, and
    extra columns may have any name.
    """
    if not key:
        raise ValueError("surrogates need a key")
    row, found = free_name(docs, "__row"), spans or free_name(docs, "__spans")
    own = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    # In two steps, so that spans that are looked at several times are found once.
    marked = written(docs.withColumn(row, F.monotonically_increasing_id()).withColumn(found, entity_spans(own, given)).withColumn(found, S.apart(F.col(found))))
    with_any = F.size(found) > 0
    each = F.explode(F.array_distinct(F.flatten(F.transform(found, entities)))).alias("e")
    occurs = cut(marked.filter(with_any).select(F.col(row).alias("row"), each).select("row", "e.kind", "e.norm"))
    names = surrogates(occurs, key)
    counts = occurs.groupBy("kind", "norm").agg(F.count("*").alias("n"))
    total = occurs.count()
    known = cut(names.join(counts, ["kind", "norm"]))
    given = join_keyed(occurs, known, ["kind", "norm"], "n", total)
    maps = given.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct(F.concat("kind", F.lit("/"), "norm"), "surrogate"))).alias("__known"))
    columns = [F.col(f"`{c}`") for c in docs.columns] + ([F.col(found)] if spans else [])
    changed = marked.filter(with_any).join(maps.withColumnRenamed("row", row), row).withColumn(text, S.replaced(F.col(f"`{text}`"), F.col(found), _put(F.col("__known"))))
    return marked.filter(~with_any).select(*columns).union(changed.select(*columns))


def session_key(spark: SparkSession) -> str:
    """The key of KEY_SETTING; where that is unset, a random one for this session, which nobody else can use to go back."""
    found = spark.conf.get(KEY_SETTING, None)
    if not found:
        found = secrets.token_hex(32)
        spark.conf.set(KEY_SETTING, found)
    return found


def op8_surrogates(spark, sf_dir: str) -> DataFrame:
    """doc_id, text with surrogates, n_<kind> for each kind, and spans (kind:start:end in the original text)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = replace_entities(docs, session_key(spark), spans="found")
    number = lambda k: F.size(F.filter("found", lambda s: s["kind"] == k)).cast("bigint")
    return rows.select("doc_id", "text", *[number(k).alias(f"n_{name}") for k, name in enumerate(KINDS)], S.joined(F.col("found"), KINDS).alias("spans"))
