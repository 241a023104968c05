"""Personal data: keyed surrogates of the same type and format; distinct entities stay distinct, equal ones equal."""

from __future__ import annotations

import hashlib
import ipaddress
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storyloom.llm.common import cut, map_values, row_key

ATTEMPTS = 8
KINDS = ["email", "ip", "iban", "ssn", "card", "phone", "name"]
#: Titles, given names by gender and script, surnames by script, and given names that are also words.
TITLES = "Mrs Ms Miss Madam Mr Sir Dr Prof Frau Herr Madame Mme Mlle Monsieur Señora Señorita Sra Señor Sr Doña Don Г-жа Г-н Κυρία Κύριος".split()
CJK_TITLES = "先生 女士 小姐 老师".split()
GIVEN = {
    "f": "Alice Amelia Anna Carla Carmen Clara Diana Elena Emily Emma Eva Grace Hannah Helen Irene Isabel Jane Julia Karin Laura Lena Linda Lucia Maria Marie María Martha Mary Nina Nora Olivia Paula Rosa Ruth Sarah Sofia Susan Teresa Ursula Vera".split(),
    "m": "Adam Albert Andrew Anton Arthur Bruno Carl Charles Daniel David Diego Edward Eric Felix Frank George Hans Henry Hugo Ivan James Jean John Jorge José Joseph Jürgen Karl Louis Lucas Mark Martin Max Michael Oscar Paul Peter Pierre Robert Thomas Victor".split(),
    "f Cyrillic": "Анна Елена Ирина Мария Наталья Ольга Светлана Татьяна".split(),
    "m Cyrillic": "Александр Алексей Андрей Владимир Дмитрий Иван Михаил Сергей".split(),
    "f Greek": "Αικατερίνη Ελένη Μαρία Σοφία".split(),
    "m Greek": "Γιώργος Δημήτρης Κώστας Νίκος".split(),
}
SURNAMES = {
    "Latin": "Bauer Becker Bernard Brown Davis Dubois Fischer García Garcia Gómez González Hernández Hoffmann Johnson Jones Klein Koch Laurent Leroy López Martínez Meyer Miller Moreau Müller Petit Richter Rodríguez Roux Ruiz Sánchez Schmidt Schneider Schröder Schulz Simon Smith Taylor Wagner Weber Williams Wilson Wolf".split(),
    "Cyrillic": "Иванов Кузнецов Петров Попов Смирнов Соколов".split(),
    "Cyrillic f": "Иванова Кузнецова Петрова Попова Смирнова Соколова".split(),
    "CJK": "王 李 张 刘 陈 杨 赵 黄 周 吴 徐 孙 胡 朱 高 林".split(),
}
WORDS_TOO = frozenset("Carmen Clara Diana Don Eva Frank Grace Hugo Jean Lucia Mark Martin Max Rosa Ruth Victor".split())
PARTICLES = "von van de del der den la le zu di da".split()
_LOW = "".join(c for c in map(chr, [*range(0x61, 0x250), *range(0x3AC, 0x3CF), *range(0x430, 0x460)]) if c.islower() and c not in "ªº")
_UP = "".join(c for c in map(chr, [*range(0x41, 0x250), *range(0x386, 0x3AC), *range(0x400, 0x430)]) if c.isupper() and c.lower() in _LOW)
_PIECE = rf"[{_UP}][{_LOW}]+"
_CAPITAL = rf"(?:[{_UP}]['’])?{_PIECE}(?:-?{_PIECE})*"
_TITLE = "|".join(sorted(TITLES, key=len, reverse=True))
_FIRST = "|".join(sorted({n for names in GIVEN.values() for n in names}, key=lambda n: (-len(n), n)))
_REST = rf"(?:\x20(?:(?:{'|'.join(PARTICLES)})\x20){{0,2}}{_CAPITAL}){{1,2}}(?!\w)"
_NAME = re.compile(rf"(?<!\w)(?:(?:{_TITLE})\.?{_REST}|(?:{_FIRST}){_REST}|(?:{_FIRST})(?!\w)|[{''.join(SURNAMES['CJK'])}][\u4e00-\u9fff]{{1,2}}(?={'|'.join(CJK_TITLES)}))")
_PARTS = re.compile(_PIECE)
_HEX4 = r"[0-9A-Fa-f]{1,4}"
_ENTITY = re.compile(
    r"(?P<email>(?<![\w.+%-])[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}(?![\w-]))"
    r"|(?P<ip>(?<![\w.])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(?![\w]|\.[0-9])"
    rf"|(?<![\w:.])(?:{_HEX4}:){{1,7}}(?:(?::{_HEX4}){{1,6}}|{_HEX4}|:)(?![\w:]))"
    r"|(?P<iban>(?<!\w)[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){3,7}(?:\x20[A-Z0-9]{1,3})?)(?!\w))"
    r"|(?P<ssn>(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-]))"
    r"|(?P<card>(?<![\w-])(?:[0-9]{4}[\x20-]){3}[0-9]{1,7}(?![\w-])|(?<![\w+-])[0-9]{4}[\x20-][0-9]{6}[\x20-][0-9]{5}(?![\w-])|(?<![\w+])[0-9]{13,19}(?!\w))"
    r"|(?P<phone>(?<![\w])(?:\+[0-9]{1,3}[\x20.-]?)?(?:\([0-9]{2,4}\)[\x20.-]?|[0-9]{2,4}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?!\w)"
    r"|(?<![\w+])\+[0-9]{1,3}(?:[\x20./-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})){2,7}(?!\w)|(?<!\w)\+[0-9]{8,14}(?!\w)|(?<!\w)[0-9]{10,12}(?!\w)"
    r"|(?<![\w.,/-])0[1-9](?:[\x20.-][0-9]{2}){4}(?![\w/-]|[.,][0-9])|(?<![\w.,/-])0[1-9][0-9]{1,3}[\x20/-][0-9]{3,8}(?:[\x20-][0-9]{2,5})?(?![\w/-]|[.,][0-9]))"
)
_HINT = re.compile(r"[0-9@]|[0-9A-Fa-f]:")
_LETTERS, _VOWELS, _CONSONANTS = "abcdefghijklmnopqrstuvwxyz", "aeiou", "bcdfghjklmnpqrstvwxyz"
_ALPHABETS = ["0123456789", _VOWELS, _CONSONANTS]
_CLASS = {c: a for a in _ALPHABETS for c in a}
#: By script: the letters that names may hold, and the consonants, vowels and endings of made-up names.
_SCRIPTS = {
    "plain": (_LETTERS, "bdfgklmnprstvz", "aeiou", ["", "n", "r"]),
    "accented": (list(_LOW), "bdfgklmnprstvz", "áéíóú", ["", "n", "r"]),
    "Greek": ([c for c in _LOW if "\u0370" <= c < "\u0400"], "βγδκλμνπρστφχ", "αεηιο", ["", "ν", "ς"]),
    "Cyrillic": ([c for c in _LOW if c >= "\u0400"], "бвгдзклмнпрст", "аеиоу", ["", "в", "к"]),
}


def _round(key: bytes, tweak: bytes, half: int, i: int, bits: int) -> int:
    size = (bits + 7) // 8
    out, block = b"", 0
    while len(out) < size:
        out += hashlib.blake2b(tweak + b"|%d|%d|%d" % (i, half, block), key=key, digest_size=64).digest()
        block += 1
    return int.from_bytes(out[:size], "big") & ((1 << bits) - 1)


def permuted(x: int, size: int, key: bytes, tweak: bytes, back: bool = False) -> int:
    """A keyed permutation of 0..size-1: a Feistel network on the next even number of bits, walked until it is in range."""
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    while True:
        left, right = x >> half, x & mask
        for i in range(7, -1, -1) if back else range(8):
            if back:
                left, right = right ^ _round(key, tweak, left, i, half), left
            else:
                left, right = right, left ^ _round(key, tweak, right, i, half)
        x = left << half | right
        if x < size:
            return x


def moved(x: int, size: int, key: bytes, tweak: bytes) -> int:
    """A keyed permutation without a fixed point: the step to the next number, seen through ``permuted``."""
    return permuted((permuted(x, size, key, tweak) + 1) % size, size, key, tweak, back=True) if size > 1 else x


def reworded(text: str, key: bytes, kind: str) -> str:
    """Each digit, vowel or consonant of lower-case ``text`` changed within its kind, all else kept: one-to-one among the texts of a pattern."""
    alphabets = [_CLASS.get(c) for c in text]
    size, number = 1, 0
    for c, a in zip(text, alphabets, strict=True):
        if a:
            size, number = size * len(a), number * len(a) + a.index(c)
    pattern = "".join(a[0] if a else c for c, a in zip(text, alphabets, strict=True))
    number = moved(number, size, key, f"{kind}|{pattern}".encode())
    out = []
    for c, a in zip(reversed(text), reversed(alphabets), strict=True):
        if a:
            number, k = divmod(number, len(a))
            c = a[k]
        out.append(c)
    return "".join(reversed(out))


def _luhn(digits: str) -> int:
    """The check digit that would follow ``digits``."""
    return -sum(sum(divmod(int(d) * (2 - i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10


def _in_format(value: str, fresh: str, of: str = "0123456789") -> str:
    """``fresh`` written into the places of ``value`` that hold characters of ``of``."""
    new = iter(fresh)
    return "".join(next(new) if c in of else c for c in value)


def canonical(kind: str, value: str) -> str:
    """What makes two mentions the same entity: case and separators don't."""
    if kind in ("card", "phone", "ssn"):
        digits = re.sub(r"[^0-9]", "", value)
        if kind == "phone" and value.startswith("+"):
            return digits[1:] if digits.startswith("1") and len(digits) == 11 else "+" + digits
        return digits
    return value.replace(" ", "") if kind == "iban" else value.lower() if kind == "email" else str(ipaddress.ip_address(value)) if kind == "ip" else value


def made_up(name: str, key: bytes) -> str:
    """A pronounceable name for a lower-case one, in its script. One-to-one: all names of a length are numbered, the number is permuted and spelled in
    syllables, and names of lengths that take as many syllables end differently."""
    script = "plain" if name.isascii() else next((k for k in ("Greek", "Cyrillic") if all(c in _SCRIPTS[k][0] for c in name)), "accented")
    letters, consonants, vowels, ends = _SCRIPTS[script]
    base, number = len(letters), 0
    for c in name:
        number = number * base + letters.index(c)
    size = base ** len(name)
    number = moved(number, size, key, f"name|{script}|{len(name)}".encode())
    out, left = [], size
    while left > 1:
        left = -(-left // (len(consonants) * len(vowels)))
        number, v = divmod(number, len(vowels))
        number, c = divmod(number, len(consonants))
        out.append(consonants[c] + vowels[v])
    return "".join(out) + ends[len(name) % 3]


def name_part(part: str, key: bytes) -> str:
    """A name of the same table (gender and script) if it is in one, else a made-up one; the same wherever the part stands, so that later mentions agree."""
    for kind, table in (*GIVEN.items(), *SURNAMES.items()):
        if part in table:
            return table[moved(table.index(part), len(table), key, f"table|{kind}".encode())]
    return made_up(part.lower(), key).capitalize()


def name_pieces(value: str) -> list[tuple[int, int]]:
    """Places of the parts of a mention that are replaced: not its title, particles and initials."""
    start = next((len(t) for t in TITLES if value.startswith((t + " ", t + ". "))), 0)
    return [m.span() for m in _PARTS.finditer(value, start)]


def _chinese(value: str) -> bool:
    return "\u4e00" <= value[0] <= "\u9fff"


def surrogate(kind: str, value: str, key: bytes) -> str:
    """The replacement of a mention; mentions of one entity get one replacement, each in its own format."""
    if kind == "email":
        local, _, rest = value.lower().rpartition("@")
        domain, _, last = rest.rpartition(".")
        fresh = reworded(f"{local}@{domain}", key, kind) + "." + last
        return "".join(f.upper() if c.isupper() else f for c, f in zip(value, fresh, strict=True))
    if kind == "ip":
        address = ipaddress.ip_address(value)
        return str(type(address)(moved(int(address), 1 << address.max_prefixlen, key, b"ip%d" % address.version)))
    if kind == "card":
        digits = canonical(kind, value)
        body = reworded(digits[:-1], key, kind)
        return _in_format(value, body + str((_luhn(body) + int(digits[-1]) - _luhn(digits[:-1])) % 10))
    if kind in ("phone", "ssn"):
        plain = canonical(kind, value)
        digits = plain.lstrip("+")
        lead = "1" * (len(re.sub(r"[^0-9]", "", value)) - len(digits))
        keep = 2 if plain[0] == "+" else int(kind == "phone" and digits[0] == "0")  # country code, or the sign of a number within a country
        return _in_format(value, lead + digits[:keep] + reworded(digits[keep:], key, f"{kind}{plain[: keep + (plain[0] == '+')]}"))
    if kind == "iban":
        plain = canonical(kind, value)
        body = reworded(plain[4:].lower(), key, kind).upper()
        check = (_iban_check(plain[:2], body) + int(plain[2:4]) - _iban_check(plain[:2], plain[4:])) % 100
        new = iter(f"{plain[:2]}{check:02d}{body}")
        return "".join(c if c == " " else next(new) for c in value)
    if _chinese(value):
        table = SURNAMES["CJK"]
        signs, n = 0x9FFF - 0x4E00 + 1, len(value) - 1
        number = 0
        for c in value[1:]:
            number = number * signs + ord(c) - 0x4E00
        number = moved(number, signs**n, key, b"CJK%d" % n)
        return table[moved(table.index(value[0]), len(table), key, b"table|CJK")] + "".join(chr(0x4E00 + number // signs**i % signs) for i in range(n - 1, -1, -1))
    out, at = [], 0
    for a, b in name_pieces(value):
        out += [value[at:a], name_part(value[a:b], key)]
        at = b
    return "".join([*out, value[at:]])


def _iban_check(country: str, body: str) -> int:
    return 98 - int("".join(str(int(c, 36)) for c in body + country + "00")) % 97


def _valid(kind: str, value: str) -> bool:
    if kind == "ip":
        try:
            ipaddress.ip_address(value)
        except ValueError:
            return False
        return ":" not in value or value.count(":") > 1 and len(value) > 6
    return kind != "phone" or 8 <= len(re.sub(r"[^0-9]", "", value)) <= 15


def entities(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of each mention in order, without overlap.

    A name is a title with one or two names, a known given name with one or two names, or alone if it isn't also a word; a Chinese name stands before a title. The names of
    one mention count as names in all of the text: later mentions by surname or given name alone are found too.
    """
    if not text:
        return []
    found = [(m.lastgroup, m.start(), m.end()) for lo, hi in _hinted_lines(text) for m in _ENTITY.finditer(text, lo, hi) if _valid(m.lastgroup, m[0])]
    names = [m.span() for m in _NAME.finditer(text) if m[0] not in WORDS_TOO]
    if names:
        known = {text[a + i : a + j] for a, b in names if not _chinese(text[a]) for i, j in name_pieces(text[a:b])}
        known = {k for k in known if len(k) > 2}
        if known:
            again = re.compile(rf"(?<!\w)(?:{'|'.join(sorted(known, key=lambda k: (-len(k), k)))})(?!\w)")
            names += [m.span() for m in again.finditer(text)]
    out, at = [], 0
    for kind, a, b in sorted([*found, *(("name", a, b) for a, b in names)], key=lambda x: (x[1], -x[2], x[0] == "name")):
        if a >= at:
            out.append((kind, a, b))
            at = b
    return out


def _hinted_lines(text: str) -> list[tuple[int, int]]:
    """The lines that can hold a mention with digits or signs; no such mention goes over a line's end."""
    found, at = [], 0
    while m := _HINT.search(text, at):
        end = text.find("\n", m.start())
        end = len(text) if end < 0 else end
        found.append((text.rfind("\n", 0, m.start()) + 1, end))
        at = end
    return found


def replaced(text: str | None, key: bytes) -> tuple[str | None, list[str]]:
    """The text with all mentions replaced, and the kinds of the mentions."""
    out, kinds, at = [], [], 0
    for kind, a, b in entities(text):
        out += [text[at:a], surrogate(kind, text[a:b], key)]
        kinds.append(kind)
        at = b
    return ("".join([*out, text[at:]]) if kinds else text), kinds


def pairs(kind: str, value: str, key: bytes) -> list[tuple[str, str]]:
    """(entity, surrogate) of a mention: of a name each part, else the value in its canonical form."""
    if kind == "name" and not _chinese(value):
        return [(value[a:b], name_part(value[a:b], key)) for a, b in name_pieces(value)]
    return [(canonical(kind, value), canonical(kind, surrogate(kind, value, key)))]


def inventory(docs: DataFrame, key: str) -> DataFrame:
    """(kind, original, surrogate) once for each entity; values are hashed, so the table holds no personal data."""
    def hashed(kind: str, value: str) -> str:
        return hashlib.blake2b(f"{kind}|{value}".encode("utf-8", "surrogatepass"), digest_size=12).hexdigest()

    def found(text: str | None) -> tuple:
        rows = {(kind, old, new) for kind, a, b in entities(text) for old, new in pairs(kind, text[a:b], key.encode())}
        return ([f"{kind} {hashed(kind, old)} {hashed(kind, new)}" for kind, old, new in sorted(rows)],)

    listed = map_values(docs, [], F.col("text"), found, T.StructType([T.StructField("found", T.ArrayType(T.StringType()))]))
    parts = F.split(F.col("entity"), " ")
    distinct = listed.select(F.explode("found").alias("entity")).distinct()
    return distinct.select(parts[0].alias("kind"), parts[1].alias("original"), parts[2].alias("surrogate"))


def collisions(found: DataFrame) -> DataFrame:
    """Surrogates that two entities share, and entities with two surrogates or their own value as surrogate. Empty for a good key."""
    shared = found.groupBy("kind", "surrogate").agg(F.min("original").alias("a"), F.max("original").alias("b")).where("a <> b")
    split = found.groupBy("kind", "original").agg(F.min("surrogate").alias("a"), F.max("surrogate").alias("b")).where("a <> b")
    return shared.select("kind", "a", "b").unionAll(split.select("kind", "a", "b")).unionAll(found.where("original = surrogate").select("kind", F.col("original").alias("a"), F.col("surrogate").alias("b")))


def collision_free_key(docs: DataFrame, key: str, attempts: int = ATTEMPTS) -> str:
    """The first key derived from ``key`` under which all entities of ``docs`` keep apart; that is checked over the whole table."""
    for k in range(attempts):
        if collisions(cut(inventory(docs, f"{key}/{k}"))).isEmpty():
            return f"{key}/{k}"
    raise ValueError(f"no collision-free key in {attempts} attempts")


def surrogates(docs: DataFrame, key: str) -> DataFrame:
    """(doc_id, text_hash, n_email, ..., n_name, text) for each row: the whole text with every entity replaced.

    Surrogates come from keyed permutations of all values of the entity's format, so distinct entities get distinct ones without a shared table, and an
    entity gets the same one in every document. Kept are: the kind, separators, lengths, vowels and consonants, capitals, top-level domain, country code, the
    validity of check digits, title, script and (of known given names) gender of a name. Names are replaced part by part, so that a person's full name, surname and given
    name agree. ``key`` is the secret: who has it can undo the replacement. Which key derived from it is used is decided by a collision check over all documents.

    Null text: stays null, no entities. Empty text: stays empty. Null doc_id: kept. Repeated rows: rows of their own. Empty table: empty result.
    """
    chosen = collision_free_key(docs, key).encode()

    def masked(text: str | None) -> tuple:
        fresh, kinds = replaced(text, chosen)
        return (*(kinds.count(k) for k in KINDS), fresh)

    fields = [T.StructField(f"n_{k}", T.LongType()) for k in KINDS] + [T.StructField("text", T.StringType())]
    return map_values(docs, row_key(), F.col("text"), masked, T.StructType(fields))
