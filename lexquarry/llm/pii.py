"""Surrogates for personal data, in native expressions only.

Detected entities (e-mail addresses, telephone, payment-card, account, network and social-security numbers, names after a form of
address, and further mentions of their words in the same document) are replaced by keyed ones of the same type and format: each character by one of its class, drawn from a
keyed digest; cards keep their issuer digit and a valid check digit, account numbers their country and valid check digits,
addresses stay valid, names keep gender and script. Given and family names are entities of their own, so "Mr John Smith" and
"Mr. Smith" stay one person. A given name after a title of no gender ("Dr") has the gender that the document's other titles give it. Equal entities get equal surrogates everywhere (coreference). A surrogate that two entities
share, or that is itself an entity of the corpus, is drawn anew for all but the first, until all are distinct; only those that
collide are drawn again. From some attempt on, more is drawn than the format holds (WIDE), so that distinct surrogates exist
however many entities of a kind there are. Detection goes by form: a number that fails its check sum is replaced as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._base import let, salted_join, settle

# Forms of address by gender and script, and given and family names for surrogates.
TITLES = {
    "f_latin": ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Signora", "Lady", "Dame"],
    "m_latin": ["Mr", "Herr", "Monsieur", "Señor", "Sr", "Signor", "Sir"],
    "n_latin": ["Dr", "Doctor", "Prof", "Professor", "Rev", "Mx"],
    "f_cyrillic": ["Госпожа", "госпожа"],
    "m_cyrillic": ["Господин", "господин"],
    "n_cyrillic": ["Доктор", "доктор", "Профессор", "профессор"],
    "f_greek": ["Κυρία", "κυρία"],
    "m_greek": ["Κύριος", "κύριος", "Κύριε", "κύριε"],
    "n_greek": ["Καθηγητής", "καθηγητής"],
}
NAMES = {
    "f_latin": ["Anna", "Clara", "Diana", "Elena", "Flora", "Greta", "Helena", "Irene", "Julia", "Karla", "Laura", "Maria", "Nora", "Olivia", "Paula", "Rosa", "Sara", "Teresa", "Vera", "Yvonne"],
    "m_latin": ["Adam", "Bruno", "Carl", "Daniel", "Emil", "Felix", "Georg", "Hugo", "Ivan", "Jonas", "Karl", "Leon", "Martin", "Noel", "Oscar", "Paul", "Robert", "Simon", "Thomas", "Victor"],
    "n_latin": ["Alexis", "Andrea", "Camille", "Dana", "Jamie", "Kim", "Luca", "Morgan", "Nikola", "Robin", "Sascha", "Toni"],
    "f_cyrillic": ["Анна", "Вера", "Дарья", "Елена", "Ирина", "Мария", "Нина", "Ольга", "Софья", "Юлия"],
    "m_cyrillic": ["Антон", "Борис", "Виктор", "Егор", "Иван", "Кирилл", "Максим", "Олег", "Павел", "Юрий"],
    "n_cyrillic": ["Валя", "Женя", "Саша", "Слава"],
    "f_greek": ["Άννα", "Ελένη", "Ειρήνη", "Μαρία", "Σοφία"],
    "m_greek": ["Γιώργος", "Νίκος", "Πέτρος", "Σπύρος", "Κώστας"],
    "n_greek": ["Σταύρη", "Χρύση"],
}
FAMILY = {
    "latin": ["Alder", "Birch", "Cedar", "Dorn", "Elm", "Fisk", "Garten", "Holm", "Iversen", "Jansen", "Keller", "Linden", "Moller", "Norden", "Olsen", "Perrin", "Quist", "Roth", "Sander", "Thorn"],
    "cyrillic": ["Белый", "Волк", "Гром", "Дуб", "Камень", "Лес", "Мороз", "Орёл", "Рудь", "Шум"],
    "greek": ["Βράχου", "Δάσου", "Κήπου", "Λίμνου", "Πεύκου"],
}
#: Syllables that family names get from attempt WIDE["name"] on.
SYLLABLES = {"latin": [c + v for c in "bcdfghjklmnpqrstvwxz" for v in "aeiou"], "cyrillic": [c + v for c in "бвгджзклмнпрстфхцчшщ" for v in "аеиоу"], "greek": [c + v for c in "βγδκλμνπρστφ" for v in "αειου"]}
#: Attempts from which surrogates grow: names by syllables, e-mail addresses by characters, numbers by digits, each one more
#: an attempt; network addresses take octets of any length, and at last the IPv6 form under its prefix for documentation.
WIDE = {"name": 5, "email": 5, "ip": 5, "ipv6": 20, "number": 12}
#: Pieces that a surrogate grows by at most.
MOST = 16

# Words of names: apostrophes and hyphens inside only, and no possessive 's.
_WORD = r"[A-ZÀ-ÖØ-Þ](?:[A-Za-zÀ-ÖØ-öø-ÿ]|['-](?!s(?!\p{L}))(?=[A-Za-zÀ-ÖØ-öø-ÿ]))+"
_CYR = r"[А-ЯЁ](?:[а-яё]|-(?=[А-ЯЁа-яё])[А-ЯЁ]?)+"
_GREEK = r"[Α-ΩΆΈ-Ώ](?:[α-ωάέ-ώϊϋΐΰ]|-(?=[Α-Ωα-ω])[Α-Ω]?)+"


def _titles(*kinds: str) -> str:
    return "|".join(t for k in kinds for t in TITLES[k])


#: Titles before a name, one or more.
_LEAD = rf"(?:(?:{_titles(*TITLES)})\.? )+"


def _named(script: str, word: str) -> str:
    return rf"(?:(?:{_titles(f'f_{script}', f'm_{script}', f'n_{script}')})\.? )+{word}(?: {word})?"


#: Types, in the order in which they are tried at a place.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63})+",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?![\d]|\.\d)",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "card": r"(?<![\d.-])(?:[2-6]\d{3}(?:\d{12}|(?: \d{4}){3}|(?:-\d{4}){3})|3[47]\d{13})(?![\d]|[.-]\d)",
    "phone": r"(?<![\d.-])(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}(?![\d])|(?<![\d.-])\+\d{1,3}(?:[ .-]?\d{2,4}){2,4}(?![\d])|(?<![\d.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d]|[.-]\d)|(?<![\d.,-])0\d{1,4}[ -]\d{3,4}[ -]\d{3,4}(?![\d]|[ .-]\d)|(?<![\d.,-]|\d )\d{3}-\d{4}(?![\d]|[.-]\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "name": rf"(?<!\p{{L}})(?:{_named('latin', _WORD)}|{_named('cyrillic', _CYR)}|{_named('greek', _GREEK)})",
}
#: All types, sorted by what they can start with, so that a place in prose is given up after one character.
ENTITY = "|".join(
    [PATTERNS["email"], *(f"(?={start})(?:{'|'.join(f'(?:{PATTERNS[k]})' for k in kinds)})" for start, kinds in ((r"[\d+(]", ["ip", "card", "phone", "ssn"]), (r"[\p{Lu}гдпκ]", ["iban", "name"])))]
)
#: Types of the words of names.
_NAMED = ["name", "given_f", "given_m", "given_n"]
#: No entity is in a text without one of these characters or words.
_HINT_WORDS = sorted({w for v in TITLES.values() for w in v if not any(x != w and x in w for y in TITLES.values() for x in y)})


def _may_hold(text: Column) -> Column:
    """A cheap test that only texts without entities fail."""
    out = text.rlike("[0-9@]")
    for w in _HINT_WORDS:
        out = out | F.contains(text, F.lit(w))
    return out


def _type(v: Column) -> Column:
    out = None
    for k, p in PATTERNS.items():
        out = F.when(v.rlike(f"^(?:{p})$"), k) if out is None else out.when(v.rlike(f"^(?:{p})$"), k)
    return out.otherwise("mention")


def _canonical(v: Column, kind: Column) -> Column:
    """What an entity is known by: letter case of addresses, and separators and titles don't tell entities apart."""
    return F.when(kind == "email", F.lower(v)).when(kind == "name", F.regexp_replace(v, f"^{_LEAD}", "")).when(kind.isin("ip", "mention"), v).otherwise(F.regexp_replace(v, r"[^A-Za-z0-9]", ""))


def _kept(v: Column, kind: Column) -> Column:
    """Leading characters of the canonical form that stay: a card's issuer digit, an account's or telephone's country."""
    return F.when(kind == "card", 1).when(kind == "iban", 2).when(kind == "phone", F.length(F.regexp_extract(v, r"^\+(\d{1,3})[ .(-]", 1))).otherwise(0)


def _number(h: Column, i: Column | int, n: int) -> Column:
    """A number below n from the i-th pair of places of the digest, 0 to 63 (conv of 6 hex digits)."""
    at = (i % 60) * 2 + 1 if not isinstance(i, int) else F.lit((i % 60) * 2 + 1)
    return F.conv(F.substring(h, at, F.lit(6)), 16, 10).cast("long") % n


def _pick(values: list[str], h: Column, i: int) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), _number(h, i, len(values)).cast("int"))


def _tail(h: Column, n: Column, pieces: list[str]) -> Column:
    """n keyed pieces in a row, MOST at most; none where n is below 1."""
    at = F.slice(F.sequence(F.lit(0), F.lit(MOST - 1)), F.lit(1), F.greatest(n, F.lit(0)))
    return F.array_join(F.transform(at, lambda i: F.get(F.array(*[F.lit(x) for x in pieces]), _number(h, i * 3, len(pieces)).cast("int"))), "")


def _mapped(v: Column, h: Column) -> Column:
    """Each letter and digit by one of its class; other characters stay."""
    letters = "abcdefghijklmnopqrstuvwxyz"

    def one(c: Column, i: Column) -> Column:
        n = _number(h, i, 26 * 10)
        small = F.substring(F.lit(letters), (n % 26 + 1).cast("int"), F.lit(1))
        return F.when(c.rlike("^[0-9]$"), (n % 10).cast("string")).when(c.rlike("^[a-z]$"), small).when(c.rlike("^[A-Z]$"), F.upper(small)).otherwise(c)

    return F.array_join(F.transform(F.split(v, ""), one), "")


def _check_digit(v: Column) -> Column:
    """v with its last digit set to satisfy the check sum of payment cards."""
    digits = F.split(F.regexp_replace(v, r"\D", ""), "")
    n = F.size(digits)
    total = F.aggregate(
        F.transform(F.slice(digits, F.lit(1), n - 1), lambda d, i: F.when((n - 2 - i) % 2 == 0, (d.cast("int") * 2) % 10 + F.floor(d.cast("int") * 2 / 10).cast("int")).otherwise(d.cast("int"))), F.lit(0), lambda a, x: a + x
    )
    return F.concat(F.expr("left(drawn, length(drawn) - 1)"), ((10 - total % 10) % 10).cast("string"))


def _account(v: Column) -> Column:
    """v with its third and fourth characters set to satisfy the check sum of account numbers (mod 97)."""
    rest = F.concat(F.substring(v, F.lit(5), F.length(v)), F.left(v, F.lit(2)), F.lit("00"))
    step = lambda a, c: F.when(c.rlike("^[0-9]$"), a * 10 + c.try_cast("int")).otherwise(a * 100 + F.ascii(c) - 55) % 97
    total = F.aggregate(F.split(rest, ""), F.lit(0), step)
    return F.concat(F.left(v, F.lit(2)), F.lpad((98 - total).cast("string"), 2, "0"), F.substring(v, F.lit(5), F.length(v)))


def _draw(e: DataFrame, key: str) -> DataFrame:
    """Adds `surrogate` (in canonical form) for type, canonical and attempt; types of names are name (family), given_f, given_m and given_n."""
    seed = F.concat_ws("|", F.lit(key), "type", "canonical", F.col("attempt").cast("string"))
    e = e.withColumn("h", F.concat(F.sha2(seed.cast("binary"), 256), F.sha2(F.concat(seed, F.lit("+")).cast("binary"), 256)))
    e = e.withColumn("more", F.concat(F.sha2(F.concat(seed, F.lit("-")).cast("binary"), 256), F.sha2(F.concat(seed, F.lit("=")).cast("binary"), 256)))
    h, v, more, attempt = F.col("h"), F.col("canonical"), F.col("more"), F.col("attempt")
    grown = lambda kind: F.least(attempt - (WIDE[kind] - 1), F.lit(MOST))
    local, domain = F.substring_index(v, "@", 1), F.substring_index(v, "@", -1)
    reserved = domain.rlike(r"(?:^|\.)(?:example\.(?:com|org|net)|[a-z0-9-]+\.(?:test|example|invalid))$")
    host = F.when(reserved, domain).otherwise(F.concat(_mapped(F.regexp_replace(domain, r"\.[^.]*$", ""), F.reverse(h)), F.lit(".example")))
    octet = lambda x, i: F.when(F.length(x) == 3, 100 + _number(h, i * 3, 156)).when(F.length(x) == 2, 10 + _number(h, i * 3, 90)).otherwise(1 + _number(h, i * 3, 9)).cast("string")
    address = F.array_join(F.transform(F.split(v, r"\."), lambda x, i: F.when(attempt >= WIDE["ip"], (1 + _number(h, i * 3, 255)).cast("string")).otherwise(octet(x, i))), ".")
    address = F.when(attempt >= WIDE["ipv6"], F.concat(F.lit("2001:db8"), *[F.concat(F.lit(":"), F.substring(more, F.lit(4 * i + 1), F.lit(4))) for i in range(6)])).otherwise(address)
    local = F.when(attempt >= WIDE["email"], F.concat(F.substring(_mapped(local, h), F.lit(1), 64 - grown("email")), _tail(more, grown("email"), list("abcdefghijklmnopqrstuvwxyz0123456789")))).otherwise(_mapped(local, h))
    drawn = F.concat(F.substring(v, F.lit(1), F.col("keep")), _mapped(F.substring(v, F.col("keep") + 1, F.length(v)), h))
    drawn = F.when(F.col("type").isin("phone", "ssn") & (attempt >= WIDE["number"]), F.concat(drawn, _tail(more, grown("number"), list("0123456789")))).otherwise(drawn)
    script = F.when(v.rlike("^[А-ЯЁ]"), "cyrillic").when(v.rlike("^[Α-ΩΆΈ-Ώ]"), "greek").otherwise("latin")
    full = F.lit(None).cast("string")
    for kind, pools in (("name", {f"name_{k}": v for k, v in FAMILY.items()}), ("given", {f"given_{k}": v for k, v in NAMES.items()})):
        for g, names in pools.items():
            rest = F.when(attempt >= WIDE["name"], _tail(more, F.least(grown("name") + 1, F.lit(MOST)), SYLLABLES[g.split("_")[-1]])).when(attempt > 2, F.concat(F.lit("-"), _pick(names, h, 9))).otherwise("")
            full = F.when(F.concat_ws("_", "type", script) == g, F.concat(_pick(names, h, 0 if kind == "given" else 4), rest)).otherwise(full)
    e = e.withColumn("drawn", drawn)
    return e.withColumn(
        "surrogate",
        F.when(F.col("type") == "email", F.concat(local, F.lit("@"), host))
        .when(F.col("type") == "ip", address)
        .when(F.col("type") == "card", _check_digit(F.col("drawn")))
        .when(F.col("type") == "iban", _account(F.col("drawn")))
        .when(F.col("type").isin(*_NAMED), F.coalesce(full, F.col("drawn")))
        .otherwise(F.col("drawn")),
    ).drop("h", "more", "drawn")


def surrogates(entities: DataFrame, key: str, max_attempts: int = 40) -> DataFrame:
    """(type, canonical, surrogate) for the distinct entities (type, canonical, gender, keep): distinct, and no entity's own value."""
    every = settle(entities.groupBy("type", "canonical").agg(F.min("gender").alias("gender"), F.min("keep").alias("keep")))
    taken, done = every.select("type", F.col("canonical").alias("surrogate")), None
    todo = every.withColumn("attempt", F.lit(0))
    for _ in range(max_attempts):
        drawn = settle(_draw(todo, key))
        first = drawn.groupBy("type", "surrogate").agg(F.min("canonical").alias("canonical"))
        kept = settle(first.join(taken, ["type", "surrogate"], "left_anti").select("type", "canonical", "surrogate"))
        done = kept if done is None else done.unionByName(kept)
        todo = settle(drawn.join(kept, ["type", "canonical"], "left_anti").drop("surrogate").withColumn("attempt", F.col("attempt") + 1))
        if not todo.limit(1).count():
            return done
        taken = taken.unionByName(kept.select("type", "surrogate"))
    raise RuntimeError(f"surrogates collide after {max_attempts} attempts")


def _formatted(value: Column, kind: Column, surrogate: Column) -> Column:
    """The surrogate in the format of this occurrence, with its separators; what a number has grown by follows."""
    spread = F.aggregate(
        F.split(value, ""),
        F.struct(F.lit(0).alias("i"), F.lit("").alias("out")),
        lambda a, c: F.when(c.rlike("^[A-Za-z0-9]$"), F.struct((a["i"] + 1).alias("i"), F.concat(a["out"], F.substring(surrogate, a["i"] + 1, F.lit(1))).alias("out"))).otherwise(F.struct(a["i"].alias("i"), F.concat(a["out"], c).alias("out"))),
        lambda a: F.concat(a["out"], F.substring(surrogate, a["i"] + 1, F.length(surrogate))),
    )
    return F.when(kind.isin("email", "ip", *_NAMED), surrogate).otherwise(spread)


def _entities(value: Column, kind: Column) -> Column:
    """What an occurrence consists of: (before, type, canonical, gender, keep), where `before` stays as it is. A name's words are
    entities, the last one the family's; all else is one entity."""
    title, words, none = F.regexp_extract(value, f"^{_LEAD}", 0), F.split(_canonical(value, kind), " "), F.lit(0)
    has = lambda g: title.rlike(rf"(?<!\p{{L}})(?:{_titles(*(k for k in TITLES if k[0] == g))})(?!\p{{L}})")
    gender = F.when(has("f"), "f").when(has("m"), "m").otherwise("n")
    row = lambda before, type_, canonical, keep: F.struct(before.alias("before"), type_.alias("type"), canonical.alias("canonical"), gender.alias("gender"), keep.alias("keep"))
    named = F.transform(words, lambda w, i: row(F.when(i == 0, title).otherwise(" "), F.when(i == F.size(words) - 1, "name").otherwise(F.concat(F.lit("given_"), gender)), w, none))
    return F.when(kind == "name", named).otherwise(F.array(row(F.lit(""), kind, _canonical(value, kind), _kept(value, kind))))


def _with_mentions(values: Column) -> Column:
    """The entity pattern of a document with `values`, and the words of its names wherever they stand alone, the longer first."""
    named = F.filter(values, lambda v: v.rlike(f"^(?:{PATTERNS['name']})$"))
    words = F.array_distinct(F.flatten(F.transform(named, lambda v: F.split(F.regexp_replace(v, f"^{_LEAD}", ""), " "))))
    return let(F.sort_array(words, asc=False), lambda w: F.when(F.size(w) > 0, F.concat(F.lit(rf"{ENTITY}|(?<!\p{{L}})(?=\p{{Lu}})(?:"), F.array_join(w, "|"), F.lit(r")(?!\p{L})"))).otherwise(ENTITY))


def _people(each: DataFrame) -> DataFrame:
    """The parts of names with the type that their document gives them: a mention is the family's name if any title says so, else a
    given one; a given name of no known gender takes one that another title in the document tells."""
    named = each.where(F.col("type").isin(*_NAMED)).groupBy("row", "canonical")
    known = named.agg(F.max(F.col("type") == "name").alias("family"), F.min(F.when(F.col("type").isin("given_f", "given_m"), F.col("type"))).alias("told"), F.min(F.when(F.col("type") == "given_n", F.col("type"))).alias("untold"))
    given = F.coalesce("told", "untold")
    kind = F.when(F.col("type") == "given_n", given).when(F.col("type") == "mention", F.when(F.col("family"), F.lit("name")).otherwise(given)).otherwise(F.col("type"))
    asked = each.where(F.col("type").isin("mention", "given_n"))
    told = salted_join(asked, known, ["row", "canonical"], ["at", "part"]).withColumn("type", kind)
    return each.where(~F.col("type").isin("mention", "given_n")).unionByName(told.select(*each.columns))


def pseudonymise(docs: DataFrame, key: str = "surrogate-key") -> DataFrame:
    """(doc_id, text, n_entities) for every row of docs, with surrogates in place of entities.

    A null text stays null, an empty one empty; texts without entities are untouched; repeated rows give equal rows. Equal
    entities have equal surrogates in the whole corpus, whatever their separators or letter case. A word of a titled name is replaced
    wherever else it stands as a word of the same document, in the same letters.
    """
    docs = docs.select("doc_id", "text")
    values = F.when(_may_hold(F.col("text")), F.regexp_extract_all("text", F.lit(ENTITY), F.lit(0)))
    found = docs.withColumn("values", F.coalesce(values, F.array().cast("array<string>")))
    plain = found.where(F.size("values") == 0).select("doc_id", "text", F.lit(0).cast("long").alias("n_entities"))
    held = found.where(F.size("values") > 0).withColumn("pattern", _with_mentions(F.col("values")))
    held = held.withColumn("values", F.when(F.col("pattern") == ENTITY, F.col("values")).otherwise(F.regexp_extract_all("text", F.col("pattern"), F.lit(0))))
    held = settle(held.select("*", F.struct(F.coalesce("doc_id", F.lit(-(2**63))).alias("id"), F.xxhash64("text").alias("hash")).alias("row"), F.monotonically_increasing_id().alias("nth")))
    each = held.select("row", F.posexplode("values").alias("at", "value")).distinct().withColumn("parts", _entities(F.col("value"), _type(F.col("value"))))
    each = settle(each.select("row", "at", "value", F.size("parts").alias("n"), F.posexplode("parts").alias("part", "p")).select("row", "at", "value", "part", (F.col("part") == F.col("n") - 1).alias("last"), "p.*"))
    each = settle(_people(each))
    new = surrogates(each.select("type", "canonical", "gender", "keep"), key)
    swapped = salted_join(each, new, ["type", "canonical"], ["row", "at"])
    piece = F.struct("at", "part", F.concat("before", _formatted(F.col("value"), F.col("type"), F.col("surrogate"))).alias("new"), "last")
    lists = settle(swapped.groupBy("row").agg(F.array_sort(F.collect_list(piece)).alias("pieces")))
    put = lambda gaps: F.concat(F.get(gaps, F.lit(0)), F.array_join(F.transform("pieces", lambda p: F.concat(p["new"], F.when(p["last"], F.get(gaps, p["at"] + 1)).otherwise(""))), ""))
    gaps = F.when(F.col("pattern") == ENTITY, F.split("text", ENTITY, -1)).otherwise(F.split("text", F.col("pattern"), F.lit(-1)))
    rebuilt = let(gaps, put)
    return plain.unionByName(salted_join(held, lists, ["row"], ["nth"]).select("doc_id", rebuilt.alias("text"), F.size("values").cast("long").alias("n_entities")))
