"""Personal data replaced by surrogates, in DataFrame operations only.

Detection. One pattern with a branch for each type finds e-mail addresses, phone numbers, payment cards, IP addresses (4 and 6),
national ids, account numbers (IBAN), secrets (access keys, tokens, passwords) and persons (a title and a name). Card numbers
must begin as cards do and have a valid check digit. Names without a title are found only where the same text has them with
one. What is found is an entity: its type and its canonical value (case and separators aside), so spellings of one thing are
one entity.

Surrogates. Each entity has a key of SHA-256 over a secret, its type, its canonical value and a round number; from it the
surrogate is written in the entity's own format: digits for digits, letters for letters of the same case and script,
separators as they are. Cards keep their first digit and a valid check digit, IBANs their country, spacing and valid check
digits, phones their country code, addresses valid octets, access keys their prefix, e-mails get a reserved domain. A person's
family name and given name are entities of their own, so "Dr. Ada Byron", "Ms. Byron" and a later "Byron" stay one family; given
names come from lists for the gender that a title of this name tells and its script. The secret is the caller's: who knows it
can draw the surrogate of a guessed value again.

Collisions. Surrogates of one type that are the same, or that are a value found in the corpus, are drawn again with the next
round number, until none is left: different entities have different surrogates, one entity has one everywhere. Names get more
parts with the rounds; values of up to six characters grow by one every two rounds, others every eight, so no format can run out.

Scale. Whole texts are searched once, and written with what was found. Only rows with entities take part in shuffles;
entities are made distinct before the shuffle, and what is in very many texts, or a text of very many rows, is joined by
broadcast (a bounded number of hot keys), so no key is one task.
"""

from __future__ import annotations

import warnings
from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from zenithal.llm.skew import join_counted
from zenithal.session import materialize

#: The setting that has the secret of the registered query and the pipeline, and what they take without it: a secret for test
#: tables only, as it is public.
SETTING, TEST_SECRET = "spark.zenithal.pii.secret", "for test tables only"

#: Titles by gender.
TITLES = {"m": ["Mr.", "Mr", "Sir", "Herr", "Monsieur", "Señor", "Sr.", "Господин", "Κύριος", "κ."], "f": ["Mrs.", "Mrs", "Ms.", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra.", "Госпожа", "Κυρία", "κα"], "n": ["Dr.", "Dr", "Prof.", "Prof"]}
#: Given names by script and gender.
GIVEN = {
    ("latin", "m"): ["Adam", "Bruno", "Carl", "David", "Emil", "Felix", "Georg", "Hugo", "Ivan", "Jonas", "Karl", "Leon", "Mark", "Nils", "Oscar", "Paul"],
    ("latin", "f"): ["Anna", "Berta", "Clara", "Dora", "Emma", "Frida", "Greta", "Hanna", "Irene", "Julia", "Karin", "Laura", "Maria", "Nora", "Olga", "Paula"],
    ("latin", "n"): ["Alex", "Robin", "Kim", "Sasha", "Charlie", "Jamie", "Dominique", "Andrea", "Noel", "Rene", "Toni", "Jo", "Sam", "Chris", "Pat", "Lou"],
    ("greek", "m"): ["Αλέξης", "Βασίλης", "Γιάννης", "Δημήτρης", "Ηλίας", "Θωμάς", "Κώστας", "Λευτέρης", "Μάνος", "Νίκος", "Παύλος", "Πέτρος", "Σπύρος", "Στέφανος", "Τάσος", "Φίλιππος"],
    ("greek", "f"): ["Άννα", "Βάσω", "Γεωργία", "Δήμητρα", "Ελένη", "Ζωή", "Ηρώ", "Θάλεια", "Ιωάννα", "Κατερίνα", "Λένα", "Μαρία", "Νίκη", "Όλγα", "Σοφία", "Χρύσα"],
    ("greek", "n"): ["Άγγελος", "Αλεξία", "Βίκυ", "Γιούλη", "Ευτυχία", "Ζήνων", "Κλειώ", "Λίνος", "Μίλτος", "Νεφέλη", "Ορέστης", "Ρήγας", "Σταύρος", "Τίτος", "Φώτης", "Χάρις"],
    ("cyrillic", "m"): ["Антон", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Иван", "Кирилл", "Лев", "Максим", "Никита", "Олег", "Павел", "Роман", "Семён", "Юрий"],
    ("cyrillic", "f"): ["Анна", "Вера", "Галина", "Дарья", "Елена", "Зоя", "Ирина", "Клара", "Лидия", "Мария", "Нина", "Ольга", "Полина", "Раиса", "Софья", "Юлия"],
    ("cyrillic", "n"): ["Саша", "Женя", "Валя", "Слава", "Паша", "Миша", "Лера", "Вася", "Шура", "Тоня", "Лёля", "Гена", "Кира", "Муся", "Рина", "Сима"],
}
#: Syllables of invented family names by script.
SYLLABLES = {
    "latin": ["bar", "ben", "cor", "dal", "del", "far", "fen", "gar", "hol", "jor", "kel", "lan", "mar", "nor", "pel", "ros"],
    "greek": ["βαρ", "βελ", "γαλ", "δαν", "δελ", "ζαρ", "κορ", "καλ", "λαν", "μαρ", "νικ", "παλ", "πελ", "σαρ", "ταρ", "φελ"],
    "cyrillic": ["бар", "бел", "вор", "гал", "дан", "жар", "зол", "кор", "лан", "мар", "нов", "пол", "рож", "сер", "тар", "чер"],
}
_NAME = r"\p{Lu}[\p{L}'’-]+"
_TITLE = "|".join(sorted((t.replace(".", r"\.") for ts in TITLES.values() for t in ts), key=len, reverse=True))
_TITLES = rf"(?:{_TITLE})(?: (?:{_TITLE}))*"
_CARD = r"(?:4[0-9]{3}|5[1-5][0-9]{2}|2[2-7][0-9]{2}|35[0-9]{2}|6(?:011|[245][0-9]{2}))(?:[ -]?[0-9]{4}){3}(?![\w-])|3[47][0-9]{2}[ -]?[0-9]{6}[ -]?[0-9]{5}(?![\w-])"
_IP = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?:\.(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])){3}(?![\w]|\.[0-9])"
_IPV6 = r"(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![\w:])|(?:[0-9A-Fa-f]{1,4}:){2,6}(?::[0-9A-Fa-f]{1,4}){1,5}(?![\w:])"
_SSN = r"[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])"
_CALL = r"[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![\w-])"
_SECRET = r"(?i:password|passwd|pwd|token|secret|api[_-]?key)(?:=|: ?| = )"
#: Characters of an account number by country.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "PT", 26: "IS TR", 27: "FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HU LB PL", 29: "BR PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC",
}
_IBANS = "|".join(rf"(?:{c.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{{(n - 4) // 4}}}" + (rf" ?[A-Z0-9]{{{n % 4}}}" if n % 4 else "") + r"\b" for n, c in IBAN_LENGTHS.items())
#: What a phone number or an account number must not run on into: whatever else of digits begins there.
_OTHER = rf"(?! (?:{_CARD}|{_IP}|{_IPV6}|{_SSN}|{_CALL}|[0-9A-Za-z._%+-]+@))"
#: What is no second name: a title, a word with a digit behind it, a key, a mailbox, the name of a secret.
_NO_NAME = rf"(?!(?:{_TITLE})(?![\p{{L}}\p{{N}}])|(?:AKIA|ASIA)[0-9A-Z]{{16}}|[A-Za-z0-9._%+-]+@|{_SECRET})"
#: Type and pattern; earlier ones win where two begin at one place.
PATTERNS = [
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,8}\.[A-Za-z]{2,24}(?![A-Za-z0-9-])"),
    ("access_key", r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b"),
    ("password", r"\b(?i:password|passwd|pwd)(?:=|: ?| = )[^\s\"',;]{4,}"),
    ("token", r"\b(?i:token|secret|api[_-]?key)(?:=|: ?| = )\"?[A-Za-z0-9_\-]{16,}\"?"),
    ("phone", r"(?<![\w+])(?:\+[0-9]{1,3}[ .-]?)?\([0-9]{3}\)[ .-]?[0-9]{3}[ .-][0-9]{4}(?![0-9])|(?<![\w.+-])(?:\+[0-9]{1,3}[ .-])?[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![\w-])|(?<![\w+])\+[0-9]{1,3}(?:" + _OTHER + r"[ .-]?[0-9]{2,4}){3,4}(?![0-9])"),
    ("ssn", r"(?<![\w-])" + _SSN),
    ("card", rf"(?<![\w-])(?:{_CARD})"),
    ("ipv6", rf"(?<![\w:.])(?:{_IPV6})"),
    ("ip", r"(?<![\w.])" + _IP),
    ("iban", r"\b(?:" + _IBANS + r")|\b[A-Z]{2}[0-9]{2}(?:" + _OTHER + r" ?[A-Z0-9]{4}(?![a-z])){3,7}(?:" + _OTHER + r" ?[A-Z0-9]{1,3}(?![.:-]?[0-9]|[@+\w]))?\b"),
    ("hex_key", r"\b[0-9a-f]{40}\b"),
    ("person", rf"(?<![\p{{L}}\p{{N}}]){_TITLES} {_NO_NAME}{_NAME}(?![\p{{L}}\p{{N}}])(?: {_NO_NAME}{_NAME}(?![\p{{L}}\p{{N}}]))?"),
]
PATTERN = "|".join(f"(?:{p})" for _, p in PATTERNS)
#: A cheap test that every text with an entity passes.
MAYBE = r"[0-9@]|(?:" + _TITLE + r") \p{Lu}|(?i:password|passwd|pwd|token|secret|api[_-]?key)(?:=|: ?| = )|(?:AKIA|ASIA)[A-Z]{16}|[a-f]{40}|[A-Fa-f]:[:A-Fa-f]"
LOWER, HEX = "abcdefghijklmnopqrstuvwxyz", "0123456789abcdef"
#: Letters that stand for those of each other script: a range of each, without case or in lower case.
ALPHABETS = {
    name: "".join(map(chr, range(a, b + 1)))
    for name, (a, b) in {
        "Cyrillic": (0x430, 0x44F), "Greek": (0x3B3, 0x3C1), "Armenian": (0x561, 0x57F), "Georgian": (0x10D0, 0x10F0), "Hebrew": (0x5D0, 0x5EA), "Arabic": (0x628, 0x63A),
        "Devanagari": (0x915, 0x939), "Thai": (0xE01, 0xE2E), "Hiragana": (0x3042, 0x3092), "Katakana": (0x30A2, 0x30F2), "Hangul": (0xAC00, 0xACFF), "Han": (0x4E00, 0x4EFF),
    }.items()
}


def kind_of(match: Column) -> Column:
    """The type of a match: of the first pattern that it fits as a whole."""
    out = F.lit("person")
    for name, pattern in reversed(PATTERNS):
        # Look-arounds speak of the neighbours, which a match alone doesn't have; they hold there.
        out = F.when(match.rlike(f"^(?:{pattern})$"), name).otherwise(out)
    return out


def canonical(kind: Column, match: Column) -> Column:
    """The value that spellings of one entity have in common."""
    digits = F.regexp_replace(match, r"[^0-9]", "")
    secret = F.regexp_replace(match, r"^[A-Za-z_-]+(?:=|: ?| = )\"?|\"$", "")
    national = F.when(F.length(digits) == 11, F.regexp_replace(digits, "^1", "")).otherwise(digits)  # +1 is often left out
    out = F.when(kind == "phone", national).when(kind.isin("card", "ssn"), digits).when(kind == "email", F.lower(match)).when(kind == "iban", F.replace(match, F.lit(" "), F.lit("")))
    return out.when(kind.isin("password", "token"), secret).when(kind == "person", F.regexp_replace(match, rf"^{_TITLES} ", "")).otherwise(match)


def _stream(seed: Column, i: Column) -> Column:
    """A pseudo-random number of 0..2^31-1 for place ``i`` of the surrogate with this seed."""
    return F.pmod(F.xxhash64(seed, i), F.lit(1 << 31))


def reshape(value: Column, seed: Column, hexed: Column | None = None) -> Column:
    """``value`` with every digit and letter replaced by a keyed one of its class and script; long hexadecimal words (or what
    ``hexed`` says) stay hexadecimal.

    Letters of scripts without an alphabet here become Latin ones. In a value without letters and digits all become letters."""
    bare = ~value.rlike(r"[\p{L}\p{Nd}]")
    hexed = F.coalesce(hexed, F.lit(False)) if hexed is not None else value.rlike(r"^[0-9a-f]{16,}$") & value.rlike("[0-9]") & value.rlike("[a-f]")

    def swap(c: Column, i: Column) -> Column:
        letters = F.when(c.rlike("[0-9]"), F.when(hexed, HEX).otherwise("0123456789")).when(c.rlike("[A-Za-z]"), F.when(hexed, HEX).otherwise(LOWER))
        for name, own in ALPHABETS.items():
            letters = letters.when(c.rlike(rf"[\p{{L}}&&\p{{Is{name}}}]"), own)
        letters = letters.when(c.rlike(r"\p{Nd}"), "0123456789").when(c.rlike(r"\p{L}") | bare, LOWER)
        own = F.substring(letters, (_stream(seed, i) % F.length(letters) + 1).cast("int"), F.lit(1))
        return F.when(letters.isNull(), c).when(c.rlike(r"\p{Lu}"), F.upper(own)).otherwise(own)

    return F.array_join(F.transform(F.filter(F.split(value, ""), lambda c: c != ""), swap), "")


def _digits(value: Column, seed: Column, keep: Column) -> Column:
    """The digits of ``value`` anew, but for the first ``keep``; the first after those and the fourth are never 0 or 1."""
    chars = F.filter(F.split(value, ""), lambda c: c != "")
    put = lambda c, i: F.when(i < keep, c).when((i == keep) | (i == keep + 3), (_stream(seed, i) % 8 + 2).cast("string")).otherwise((_stream(seed, i) % 10).cast("string"))
    return F.array_join(F.transform(chars, put), "")


def with_check_digit(number: Column) -> Column:
    """``number`` (digits) with its last digit replaced by the Luhn check digit."""
    body = F.filter(F.split(F.reverse(number), ""), lambda c: c != "")
    weigh = lambda c, i: F.when(i == 0, 0).when(i % 2 == 1, F.when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)).otherwise(c.cast("int"))
    total = F.aggregate(F.transform(body, weigh), F.lit(0), lambda a, x: a + x)
    return F.concat(F.regexp_replace(number, ".$", ""), F.pmod(-total, F.lit(10)).cast("string"))


def with_iban_check(iban: Column) -> Column:
    """``iban`` (without spaces) with its check digits (places 3 and 4) as its other characters ask."""
    moved = F.concat(F.substring(iban, F.lit(5), F.length(iban)), F.substring(iban, 1, 2), F.lit("00"))
    number = F.array_join(F.transform(F.filter(F.split(moved, ""), lambda c: c != ""), lambda c: F.when(c.rlike("[A-Z]"), (F.ascii(c) - 55).cast("string")).otherwise(c)), "")
    left = F.aggregate(F.filter(F.split(number, ""), lambda c: c != ""), F.lit(0), lambda a, c: F.pmod(a * 10 + c.cast("int"), F.lit(97)))
    return F.concat(F.substring(iban, 1, 2), F.lpad((98 - left).cast("string"), 2, "0"), F.substring(iban, F.lit(5), F.length(iban)))


def _tail(seed: Column, n: Column, letters: str) -> Column:
    """``n`` keyed characters of ``letters``."""
    put = lambda i: F.substring(F.lit(letters), (_stream(seed, -i - 2) % len(letters) + 1).cast("int"), F.lit(1))
    return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), put), "")).otherwise("")


def _picker(names: list[str], seed: Column):
    table = F.array(*[F.lit(n) for n in names])
    return lambda i: F.element_at(table, (_stream(seed, i) % len(names) + 1).cast("int"))


def _family(script: Column, shaped: Column, seed: Column, round_no: Column) -> Column:
    """An invented family name of three syllables, five from the third round on, one more every eight rounds; in scripts
    without syllables here ``shaped``, the name in other letters."""
    out = shaped
    for name, syllables in SYLLABLES.items():
        table = F.array(*[F.lit(x) for x in syllables])
        parts = F.when(round_no < 2, 3).otherwise(F.floor(round_no / 8).cast("int") + 5)
        name_of = F.array_join(F.transform(F.sequence(F.lit(0), parts - 1), _part(table, seed)), "")
        out = F.when(script == name, F.initcap(name_of)).otherwise(out)
    return out


def _part(table: Column, seed: Column):
    return lambda i: F.element_at(table, (_stream(seed, i) % 16 + 1).cast("int"))


def draw(entities: DataFrame, round_no: int, secret: str) -> DataFrame:
    """``entities`` (kind, value, script) plus ``surrogate``: that of this round for each entity in its canonical form."""
    kind, value, seed, no = F.col("kind"), F.col("value"), F.col("_seed"), F.lit(round_no)
    rows = entities.withColumn("_seed", F.sha2(F.concat_ws("\x1f", F.lit(secret), kind, value, no.cast("string")), 256))
    rows = rows.withColumn("_grown", F.floor(no / F.when(F.length(value) <= 6, 2).otherwise(8)).cast("int"))
    rows = rows.withColumn("_more", _tail(seed, F.col("_grown"), LOWER)).withColumn("_digits", _tail(seed, F.col("_grown"), "0123456789"))
    # What is reshaped: the name of a mailbox, what follows a prefix, else all.
    base = F.when(kind == "email", F.regexp_extract(value, "^([^@]+)", 1)).when(kind.isin("access_key", "iban"), F.substring(value, 5, 100)).otherwise(value)
    hexed = (kind == "ipv6") | (base.rlike(r"^[0-9a-f]{16,}$") & base.rlike("[0-9]") & base.rlike("[a-f]"))
    rows = rows.withColumn("_base", base).withColumn("_hexed", hexed)
    rows = rows.withColumn("_shaped", reshape(F.col("_base"), seed, F.col("_hexed")))
    domain = reshape(F.regexp_extract(value, r"@([^.]+)", 1), F.sha2(F.concat(F.lit(secret), F.regexp_extract(value, "@(.*)$", 1)), 256), F.lit(False))
    rows = rows.withColumn("_domain", F.when(kind == "email", domain))
    shaped, letters, numbers, grown = F.col("_shaped"), F.col("_more"), F.col("_digits"), F.col("_grown")
    end = F.element_at(F.array(F.lit("com"), F.lit("net"), F.lit("org")), (_stream(seed, F.lit(-1)) % 3 + 1).cast("int"))
    octets = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (_stream(seed, i) % 254 + 1).cast("string")), ".")
    octets = F.concat(octets, F.when(grown > 0, F.concat(F.lit("."), numbers)).otherwise(""))
    # Capitals by their own alphabet: upper() of what is constant in the first rounds is computed by the driver, where its first
    # call loads tables for all languages.
    key = F.concat(F.substring(value, 1, 4), shaped, _tail(seed, grown, LOWER.upper()))
    # Digits that stay: a country code, the first of a card.
    keep = F.when(kind == "phone", F.greatest(F.length(value) - 10, F.when(F.length(value) < 10, 2).otherwise(0))).when(kind == "card", 1).otherwise(0)
    number = F.concat(_digits(value, seed, keep), numbers)
    out = F.when(kind == "email", F.concat(shaped, letters, F.lit("@"), F.col("_domain"), F.lit(".example."), end)).when(kind == "ip", octets).when(kind == "access_key", key).when(kind == "iban", with_iban_check(key))
    out = out.when(kind == "ipv6", F.concat(shaped, F.when(grown > 0, F.concat(F.lit(":"), numbers)).otherwise(""))).when(kind.isin("phone", "ssn"), number).when(kind == "card", with_check_digit(number))
    out = out.when(kind == "family", _family(F.col("script"), F.concat(shaped, letters), seed, no))
    # One part of a given name, two from the third round on, and one more every four rounds.
    parts = 0 if round_no < 2 else (round_no - 2) // 4 + 1
    for (s, g), names in GIVEN.items():
        out = out.when(kind == f"given-{s}-{g}", F.array_join(F.transform(F.sequence(F.lit(0), F.lit(parts)), _picker(names, seed)), "-"))
    rest = F.concat(shaped, F.when(F.col("_hexed"), _tail(seed, grown, HEX)).otherwise(letters))
    return rows.withColumn("surrogate", out.otherwise(rest)).select(*entities.columns, "surrogate")


def _space(kind: Column) -> Column:
    """Where surrogates must differ: all given names are one space, whatever their list."""
    return F.when(kind.startswith("given-"), "given").otherwise(kind)


def surrogates(entities: DataFrame, secret: str) -> DataFrame:
    """(kind, value, surrogate) for the distinct (kind, value) with their script: none is drawn twice for a kind (given names
    of all lists count as one kind), none is a value found.

    Who keeps a surrogate that several drew is the one with the least value; the others draw again. The least value is an
    aggregate that each task begins, so very many that draw from a short list are no one task's."""
    todo = materialize(entities.groupBy("kind", "value").agg(F.min("script").alias("script")), "pii-entities")
    taken = todo.select(_space(F.col("kind")).alias("space"), F.col("value").alias("surrogate")).distinct()
    done: list[DataFrame] = []
    for i in count():
        drawn = materialize(draw(todo, i, secret).withColumn("space", _space(F.col("kind"))), "pii-round")
        first = drawn.groupBy("space", "surrogate").agg(F.min(F.struct("value", "kind")).alias("k")).join(taken, ["space", "surrogate"], "left_anti")
        ok = materialize(first.select(F.col("k.kind").alias("kind"), F.col("k.value").alias("value"), "surrogate"), "pii-drawn")
        done.append(ok)
        todo = drawn.join(ok.select("kind", "value"), ["kind", "value"], "left_anti").select("kind", "value", "script")
        if todo.isEmpty():
            break
        taken = taken.unionByName(ok.select(_space(F.col("kind")).alias("space"), "surrogate"))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def _script(value: Column) -> Column:
    return F.when(value.rlike(r"\p{IsCyrillic}"), "cyrillic").when(value.rlike(r"\p{IsGreek}"), "greek").when(value.rlike(r"[\p{L}&&\P{IsLatin}]"), "other").otherwise("latin")


def _write_like(match: Column, canon: Column, surrogate: Column) -> Column:
    """The canonical surrogate of digits in the separators of the match; digits before the canonical ones stay."""
    own = F.regexp_replace(match, "[^0-9]", "")
    surrogate = F.concat(F.substring(own, F.lit(1), F.length(own) - F.length(canon)), surrogate)
    chars = F.filter(F.split(match, ""), lambda c: c != "")
    place = F.transform(chars, lambda c, i: F.when(c.rlike("[0-9]"), F.substring(surrogate, F.length(F.regexp_replace(F.substring(match, F.lit(1), i + 1), "[^0-9]", "")), F.lit(1))).otherwise(c))
    return F.concat(F.array_join(place, ""), F.substring(surrogate, F.length(own) + 1, F.length(surrogate)))


def _spaced_like(match: Column, surrogate: Column) -> Column:
    """The surrogate with the blanks of the match where they stand in it."""
    chars = F.filter(F.split(match, ""), lambda c: c != "")
    bare = lambda x: F.length(F.replace(x, F.lit(" "), F.lit("")))
    place = F.transform(chars, lambda c, i: F.when(c == " ", c).otherwise(F.substring(surrogate, bare(F.substring(match, F.lit(1), i + 1)), F.lit(1))))
    return F.concat(F.array_join(place, ""), F.substring(surrogate, bare(match) + 1, F.length(surrogate)))


def _between(text: Column, pattern: Column, new: Column) -> Column:
    """``text`` with each match of ``pattern`` replaced by what the map ``new`` has for it."""
    pieces, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, pattern, F.lit(0))
    swapped = F.concat(F.transform(hits, lambda h: F.element_at(new, h)), F.array(F.lit("")))
    return F.array_join(F.flatten(F.zip_with(pieces, swapped, lambda p, s: F.array(p, s))), "")


def replace(docs: DataFrame, text: str = "text", *, secret: str, count_column: str | None = "pii_entities", length_column: str | None = None) -> DataFrame:
    """``docs`` with personal data in ``text`` replaced; columns, rows and all other text stay as they are.

    A column ``count_column`` with the number of replacements is added (None: it isn't; a column of that name is replaced).
    A column ``length_column``, if there is one, becomes the length of each text that has changed. Other columns may have any
    names. Null and empty texts stay, long ones are searched whole. Equal texts get equal results,
    repeated rows stay repeated. An empty table gives an empty result. ``secret`` must not be empty.
    """
    if not secret:
        raise ValueError("surrogates need a secret of the caller's")
    # One column with all of docs: no name can clash. Whole texts are searched here, once.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d"))
    t = F.col(f"d.`{text}`")
    hits = F.when(F.coalesce(t.rlike(MAYBE), F.lit(False)), F.regexp_extract_all(t, F.lit(PATTERN), F.lit(0))).otherwise(F.array().cast("array<string>"))
    rows = rows.select("d", hits.alias("hits")).select("d", "hits", F.when(F.size("hits") > 0, F.sha2(t, 256)).alias("key"))
    rows = materialize(rows, "pii-rows")
    # Distinct texts with entities, and in them the distinct matches.
    per_text = rows.where("key is not null").groupBy("key").agg(F.first("hits").alias("hits"), F.count(F.lit(1)).alias("rows"))
    per_text = materialize(per_text, "pii-texts")
    matches = per_text.select("key", "rows", F.explode(F.array_distinct("hits")).alias("match"))
    # Numbers of a card's length without a valid check digit are no cards: they stay.
    digits = F.regexp_replace("match", "[^0-9]", "")
    kind = kind_of(F.col("match"))
    distinct = matches.groupBy("match").agg(F.count(F.lit(1)).alias("copies"))
    distinct = distinct.withColumn("kind", F.when((kind == "card") & (with_check_digit(digits) != digits), "number").otherwise(kind)).withColumn("value", canonical(F.col("kind"), F.col("match")))
    distinct = materialize(distinct, "pii-matches")
    title = F.regexp_extract("match", rf"^({_TITLES}) ", 1)
    told_by = lambda g: title.rlike("(?:^| )(?:" + "|".join(x.replace(".", r"\.") for x in TITLES[g]) + ")(?: |$)")
    gender = F.when(told_by("m"), "m").when(told_by("f"), "f").otherwise("n")
    named = distinct.where("kind = 'person'").withColumn("family", F.regexp_extract("value", rf"({_NAME})$", 1)).withColumn("given", F.when(F.col("value").contains(" "), F.regexp_extract("value", rf"^({_NAME}) ", 1)))
    # Each part has its own script; so an entity, a kind and a value, has one.
    named = named.withColumn("title", title).withColumn("gender", gender).withColumn("script", _script(F.col("family"))).withColumn("given_script", _script(F.col("given")))
    told = named.groupBy("value").agg(F.min(F.when(F.col("gender") != "n", F.col("gender"))).alias("told"))
    named = named.join(told, "value").withColumn("list", F.concat_ws("-", F.lit("given"), "given_script", F.coalesce("told", F.lit("n"))))
    named = materialize(named.select("match", "copies", "value", "title", "family", "given", "script", "given_script", "list"), "pii-people")
    entities = distinct.where("kind not in ('person', 'number')").select("kind", "value", F.lit("latin").alias("script"))
    entities = entities.unionByName(named.select(F.lit("family").alias("kind"), F.col("family").alias("value"), "script"))
    entities = entities.unionByName(named.where("given is not null").select(F.col("list").alias("kind"), F.col("given").alias("value"), F.col("given_script").alias("script")))
    drawn = materialize(surrogates(entities, secret), "pii-surrogates")
    plain = distinct.where("kind not in ('person', 'number')").join(drawn, ["kind", "value"])
    new = F.when(F.col("kind").isin("phone", "card", "ssn"), _write_like(F.col("match"), F.col("value"), F.col("surrogate")))
    new = new.when(F.col("kind") == "iban", _spaced_like(F.col("match"), F.col("surrogate")))
    new = new.when(F.col("kind").isin("password", "token"), F.concat(F.regexp_extract("match", r"^([A-Za-z_-]+(?:=|: ?| = )\"?)", 1), F.col("surrogate"), F.when(F.endswith("match", F.lit('"')), '"').otherwise("")))
    mentions = "array<struct<old:string,new:string>>"
    plain = plain.select("match", "copies", new.otherwise(F.col("surrogate")).alias("new"), F.array().cast(mentions).alias("names"))
    families = drawn.where("kind = 'family'").select(F.col("value").alias("family"), F.col("surrogate").alias("new_family"))
    givens = drawn.where("kind like 'given%'").select(F.col("kind").alias("list"), F.col("value").alias("given"), F.col("surrogate").alias("new_given"))
    people = named.join(families, "family").join(givens, ["list", "given"], "left")
    pair = lambda a, b: F.struct(a.alias("old"), b.alias("new"))
    names = F.array(pair(F.col("value"), F.concat_ws(" ", "new_given", "new_family")), pair(F.col("family"), F.col("new_family")))
    people = people.select("match", "copies", F.concat_ws(" ", "title", "new_given", "new_family").alias("new"), names.cast(mentions).alias("names"))
    same = distinct.where("kind = 'number'").select("match", "copies", F.col("match").alias("new"), F.array().cast(mentions).alias("names"))
    table = materialize(plain.unionByName(people).unionByName(same), "pii-new")
    # For each text what its matches become, and the names in it that may stand there without a title, too.
    own = join_counted(matches, table, "match", "copies").groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("match", "new"))).alias("new"), F.array_distinct(F.flatten(F.collect_list("names"))).alias("names"), F.first("rows").alias("rows"))
    longest = F.array_sort(F.transform("names", lambda x: x["old"]), lambda a, b: F.length(b) - F.length(a))
    pattern = F.concat(F.lit(r"(?<![\p{L}\p{N}])(?:"), F.array_join(longest, "|"), F.lit(r")(?![\p{L}\p{N}])"))
    own = own.select("key", "new", "rows", F.when(F.size("names") > 0, pattern).alias("pattern"), F.map_from_entries("names").alias("names"))
    found = join_counted(rows.where("key is not null"), materialize(own, "pii-own"), "key", "rows")
    pieces = F.transform(F.split(t, PATTERN, -1), lambda p: F.when(F.col("pattern").isNull(), p).otherwise(_between(p, F.col("pattern"), F.col("names"))))
    swapped = F.concat(F.transform("hits", lambda h: F.element_at("new", h)), F.array(F.lit("")))
    whole = F.array_join(F.flatten(F.zip_with(pieces, swapped, lambda p, s: F.array(p, s))), "")
    keep = [c for c in docs.columns if c != count_column]
    column = lambda c: F.col(f"d.`{c}`").alias(c)
    extra = lambda n: [] if count_column is None else [n.alias(count_column)]
    found = found.select("d", "hits", "new", whole.alias("whole"))
    size = F.when(F.col("whole") != t, F.length("whole")).otherwise(F.col(f"d.`{length_column}`")) if length_column in docs.columns else None
    put = lambda c: F.col("whole").alias(c) if c == text else size.cast(docs.schema[c].dataType).alias(c) if c == length_column else column(c)
    done = found.select(*map(put, keep), *extra(F.size(F.filter("hits", lambda h: F.element_at("new", h) != h))))
    rest = rows.where("key is null").select(*map(column, keep), *extra(F.lit(0)))
    return done.unionByName(rest)


def secret_of(spark: SparkSession) -> str:
    """The secret of the session's settings, or, with a warning, that for test tables."""
    own = spark.conf.get(SETTING, None)
    if not own:
        warnings.warn(f"{SETTING} is not set: surrogates are drawn with a public secret, for test tables only", stacklevel=2)
    return own or TEST_SECRET


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``documents`` with its text after replacement."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return replace(docs, secret=secret_of(spark)).select("doc_id", "text", "pii_entities")
