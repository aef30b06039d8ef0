"""Surrogates for personal data.

Method: entities are found by patterns and replaced by keyed surrogates of the same
type. Digits stay digits in the mention's own layout, letters keep their case, cards
and bank accounts keep valid checks, addresses of one domain stay together. A name is
two entities, given and family name, so that 'Mrs Smith' and 'Mary Smith' keep their
common family name, and a given name keeps gender and script. One table maps every
distinct entity of the corpus to its surrogate, so all mentions agree; surrogates that
meet one another or a value of the corpus are drawn again, so different entities stay
different. What can be drawn grows with every turn.

Main path: DataFrame functions only. Documents without entities are passed through;
only the others meet the table.

Limits: a name is found by its title, by one of the given names below, or after a word
such as 'Name:' or 'Dear'; other names are not. Numbers of 13 to 19 digits are cards
only if their check digit holds.
"""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholia.llm.frames import named, positional
from scholia.plans.durable import durable

#: Turns after which an entity whose layout has hardly any free value left gets a tag; names never do.
DRAWS = 8

#: Given names and family names by script, and titles by gender.
MALE = "James John Robert Michael William David Richard Thomas Charles Daniel Matthew Anthony Steven Andrew Kenneth Joshua Kevin Brian George Edward Pierre Jacques Philippe Hans Jürgen Wolfgang Klaus Javier Fernando Alejandro Miguel Bob Bill Tom Mike Paul Peter Mark Henry Frank Jack Carlos Luis Jorge Pablo Antonio Stefan Andreas Dieter Louis Henri Marcel Ahmed Omar Ali Raj Wei Hiroshi".split()
FEMALE = "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Nancy Margaret Sandra Ashley Kimberly Emily Donna Michelle Carol Amanda Françoise Brigitte Sylvie Ursula Gisela Heike Sabine Guadalupe Carmen Beatriz Pilar Alice Emma Laura Julia Anna Maria Helen Kate Lucy Rosa Elena Isabel Claudia Petra Monika Claire Camille Sophie Fatima Aisha Priya Mei Yuki".split()
FAMILY = "Smith Johnson Williams Brown Jones Miller Davis Wilson Anderson Taylor Moore Jackson Martin Thompson White Harris Clark Lewis Robinson Walker Young Allen King Wright Scott Hill Green Adams Baker Nelson Campbell Mitchell Roberts Carter Phillips Evans Turner Parker Collins Edwards".split()
MALE_CYRILLIC = "Иван Пётр Сергей Алексей Дмитрий Николай Михаил Андрей Павел Виктор".split()
FEMALE_CYRILLIC = "Анна Мария Елена Ольга Наталья Татьяна Ирина Светлана Екатерина Юлия".split()
FAMILY_CYRILLIC = "Иваненко Петренко Шевченко Коваленко Бондаренко Ткаченко Кравченко Олейник Мельник Бойко Лысенко Марченко Савченко Руденко Левченко Гончар".split()
#: Syllables of two letters, of which further names are made; given names end by gender.
SYLLABLES = "".join(c + v for c in "bdfgklmnprstvz" for v in "aeiou")[:128]
SYLLABLES_CYRILLIC = "".join(c + v for c in "бвгдзклмнпрст" for v in "аеиоу")[:128]
ENDINGS = {"f": ("na", "на"), "m": ("ro", "р")}
MALE_TITLES = "Mr Herr Monsieur Señor Sir".split()
FEMALE_TITLES = "Mrs Ms Miss Frau Madame Mademoiselle Señora Señorita".split()
#: Words before a full name.
CUES = ["[Nn]ame(?: is|:)", "[Cc]ontact:?", "[Ss]igned:?", "[Rr]egards,", "[Ss]incerely,", "[Dd]ear"]

_NAME = r"\p{Lu}[\p{L}'’-]+"
_TITLE = "|".join([*MALE_TITLES, *FEMALE_TITLES, "Dr", "Prof"])
_GIVEN = "|".join(form for g in [*MALE, *FEMALE, *MALE_CYRILLIC, *FEMALE_CYRILLIC] for form in (g, g.upper()))
#: Type and pattern, in the order in which they are tried at a place.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*+@[A-Za-z0-9][A-Za-z0-9-]*+(?:\.[A-Za-z0-9-]++)+(?<=\.[A-Za-z]{2,24})(?![A-Za-z0-9@])",
    "secret": r"\b(?i:(?:api[_-]?key|access[_-]?key|token|secret|password|passwd)\b[\x20\t]*[=:][\x20\t]*[\"']?)[A-Za-z0-9_+/=.~-]{8,}+|(?<![A-Za-z0-9])(?:[0-9a-f]{32,}+|[0-9A-F]{32,}+|AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36})(?![A-Za-z0-9])",
    "ipv6": r"(?=[0-9A-Fa-f]{1,4}:)(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){2,6}(?::[0-9A-Fa-f]{1,4}){1,5})(?![0-9A-Za-z:])",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?\b(?<=[0-9].{0,40})",
    "phone": r"(?<![0-9+])\+[0-9]{1,3}[\x20.-]?\([0-9]{1,4}\)[\x20.-]?[0-9]{2,4}[\x20.-]?[0-9]{3,4}(?![0-9])|(?<![0-9+])\+[0-9]{1,3}[\x20.-]?[0-9]{2,4}(?:[\x20.-]?[0-9]{2,4}){1,4}(?![0-9])|(?<![0-9(])\([0-9]{3}\)\x20?[0-9]{3}-[0-9]{4}(?![0-9])|(?<![0-9.-])[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![0-9.-]*[0-9])|(?<![0-9.-])(?<![0-9]\x20)(?:[0-9]{3}\x20[0-9]{3}\x20[0-9]{4}|0[0-9]{2,4}\x20[0-9]{3,4}\x20[0-9]{3,4})(?![\x20.-]?[0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "ip": r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?!\.?[0-9])",
    "card": r"(?<![0-9])[0-9]{4}[\x20-]?[0-9]{6}[\x20-]?[0-9]{5}(?![0-9])|(?<![0-9])[0-9]{4}(?:[\x20-]?[0-9]{4}){2}[\x20-]?[0-9]{1,7}(?![0-9])|(?<![0-9])[0-9]{13,19}(?![0-9])",
    "name": rf"\b(?=\p{{Lu}})(?:(?:{_TITLE})\.?\x20{_NAME}(?:\x20{_NAME})?|(?:{_GIVEN})\x20{_NAME}|(?<=\b(?:{'|'.join(CUES)})\x20){_NAME}\x20{_NAME})",
}
_WORDLIKE, _NUMERIC = ("email", "secret", "ipv6", "iban", "name"), ("phone", "ssn", "ip", "card")
#: One pattern for all; within words and away from digits it fails after a look at one character.
ANY = (
    r"(?<![\p{L}\p{N}_])(?:" + "|".join(f"(?:{PATTERNS[t]})" for t in _WORDLIKE) + ")"
    r"|(?=[0-9+(])(?:" + "|".join(f"(?:{PATTERNS[t]})" for t in _NUMERIC) + ")"
)
_HASHES = 4


def _bound(value: Column, use) -> Column:
    """``use`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), use), 0)


def _chars(s: Column) -> Column:
    return F.filter(F.split(s, ""), lambda c: c != "")


def _drawn(key: str, *parts: Column) -> Column:
    """256 hexadecimal digits that follow from the key and the parts."""
    one = lambda n: F.sha2(F.concat_ws("\x1f", F.lit(key), F.lit(str(n)), *parts), 256)
    return F.concat(*map(one, range(_HASHES)))


def _number(hexes: Column, at: Column | int, size: int) -> Column:
    return F.conv(F.substr(hexes, F.lit(at) if isinstance(at, int) else at, F.lit(size)), 16, 10).cast("long")


def _digits(hexes: Column) -> Column:
    """Decimal digits from hexadecimal ones."""
    return F.translate(hexes, "abcdef", "123456")


def _pick(values: list[str], hexes: Column, start: int) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(_number(hexes, start, 7), F.lit(len(values))) + 1).cast("int"))


def _syllables(letters: str, hexes: Column, n: int) -> Column:
    """``n`` syllables."""
    at = lambda i: F.pmod(_number(hexes, 17 + 2 * (i % 96), 2), F.lit(len(letters) // 2)).cast("int")
    return F.concat(*[F.substr(F.lit(letters), 2 * at(i) + 1, F.lit(2)) for i in range(n)])


def _mapped(value: Column, hexes: Column) -> Column:
    """The value with digits, small and capital letters replaced in kind; other characters stay."""
    byte = lambda i: _number(hexes, i % (32 * _HASHES - 1) * 2 + 1, 2) + F.floor(i / (32 * _HASHES - 1)) * 7
    letter = lambda i, first: F.char((F.pmod(byte(i), F.lit(26)) + F.lit(first)).cast("int"))
    return F.array_join(
        F.transform(
            _chars(value),
            lambda c, i: F.when(c.between("0", "9"), F.pmod(byte(i), F.lit(10)).cast("string"))
            .when(c.between("a", "z"), letter(i, 97))
            .when(c.between("A", "Z"), letter(i, 65))
            .otherwise(c),
        ),
        "",
    )


def _luhn_sum(digits: Column, double_last: bool) -> Column:
    """Sum of the digits, every second one doubled, from the right."""
    each = F.transform(
        _chars(F.reverse(digits)),
        lambda c, i: F.when(F.pmod(i, F.lit(2)) == (0 if double_last else 1), c.cast("int") * 2).otherwise(c.cast("int")),
    )
    return F.aggregate(each, F.lit(0), lambda s, d: s + F.when(d > 9, d - 9).otherwise(d))


def _remainder_97(account: Column) -> Column:
    """A bank account's number modulo 97, its first four characters last, letters as 10 to 35; valid ones give 1."""
    moved = F.concat(F.substr(account, F.lit(5)), F.substr(account, F.lit(1), F.lit(4)))
    value = lambda c: F.when(c.between("0", "9"), c.cast("int")).otherwise(F.ascii(c) - 55)
    return F.aggregate(_chars(moved), F.lit(0), lambda s, c: F.pmod(s * F.when(value(c) > 9, 100).otherwise(10) + value(c), F.lit(97)).cast("int"))


def _plain_digits(s: Column) -> Column:
    return F.regexp_replace(s, r"[^0-9]", "")


def kind_of(mention: Column) -> Column:
    """Type of a mention: the first pattern that it fits whole; null for a number that is no card."""
    found = reduce(lambda c, t: c.when(mention.rlike(f"^(?:{PATTERNS[t]})$"), t), PATTERNS, F.when(F.lit(False), ""))
    named_by_cue = mention.rlike(rf"^{_NAME}\x20{_NAME}$")
    kind = found.otherwise(F.when(mention.contains("@"), "email").when(named_by_cue, "name").otherwise("secret"))
    no_card = (kind == "card") & (F.pmod(_luhn_sum(_plain_digits(mention), False), F.lit(10)) != 0)
    return F.when(~no_card, kind)


def _secret_value(mention: Column) -> Column:
    return F.regexp_extract(mention, r"([A-Za-z0-9_+/=.~-]+)$", 1)


def name_parts(mention: Column) -> Column:
    """Struct of ``title``, ``given`` (empty without one) and ``family``."""
    title = F.regexp_extract(mention, rf"^((?:{_TITLE})\.?\x20)", 1)
    words = F.split(F.substr(mention, F.length(title) + 1), r"\x20")
    return F.struct(
        title.alias("title"), F.when(F.size(words) > 1, F.get(words, 0)).otherwise("").alias("given"), F.element_at(words, -1).alias("family")
    )


def gender_of(parts: Column) -> Column:
    """``m``, ``f`` or ``u``, by title, else by given name."""
    title, given = F.regexp_replace(parts["title"], r"\.?\x20$", ""), F.initcap(F.lower(parts["given"]))
    male, female = [*MALE, *MALE_CYRILLIC], [*FEMALE, *FEMALE_CYRILLIC]
    return F.when(title.isin(MALE_TITLES), "m").when(title.isin(FEMALE_TITLES), "f").when(given.isin(male), "m").when(given.isin(female), "f").otherwise("u")


def entities_of(kind: Column, mention: Column) -> Column:
    """The entities of a mention as structs ``kind, value``: what all mentions of an entity have in common."""
    secret, parts = _secret_value(mention), name_parts(mention)
    value = (
        F.when(kind.isin("phone", "card", "ssn"), _plain_digits(mention))
        .when(kind.isin("email", "ipv6"), F.lower(mention))
        .when(kind == "iban", F.regexp_replace(mention, r"\x20", ""))
        .when(kind == "secret", F.when(secret.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"), F.lower(secret)).otherwise(secret))
        .otherwise(mention)
    )
    entity = lambda k, v: F.struct(k.alias("kind"), v.alias("value"))
    given = entity(F.concat(F.lit("given_"), gender_of(parts)), F.lower(parts["given"]))
    family = entity(F.lit("family"), F.lower(parts["family"]))
    both = F.when(parts["given"] != "", F.array(given, family)).otherwise(F.array(family))
    return F.when(kind == "name", both).otherwise(F.array(entity(kind, value)))


def _surrogate(kind: Column, value: Column, turn: int, key: str) -> Column:
    """A draw for an entity; the choice grows with the turn wherever the layout does not bound it."""

    def drawn(h: Column) -> Column:
        size, digits = F.length(value), _digits(h)
        card = F.concat(F.substring(value, 1, 1), F.substr(digits, F.lit(1), size - 2))
        check = F.pmod(F.lit(10) - F.pmod(_luhn_sum(card, True), F.lit(10)), F.lit(10)).cast("string")
        octet = lambda k: (F.pmod(_number(h, 8 * k + 1, 6), F.lit(254)) + 1).cast("string")
        local, domain = F.regexp_extract(value, r"^([^@]*)@", 1), F.regexp_extract(value, r"@(.*)$", 1)
        site = _drawn(key, F.lit("domain"), domain)
        site = F.concat(F.lit("mail"), F.substring(_digits(site), 1, 10), F.lit("."), _pick(["example.com", "example.net", "example.org"], site, 20))
        address = F.concat(_mapped(local, h), F.substr(digits, F.lit(200), F.lit(max(0, turn - 1))), F.lit("@"), site)
        account = F.concat(F.substring(value, 1, 2), F.lit("00"), F.substr(_mapped(value, h), F.lit(5), size))
        checked = F.concat(F.substring(value, 1, 2), F.lpad((98 - _remainder_97(account)).cast("string"), 2, "0"), F.substr(account, F.lit(5), size))
        account = F.when(_remainder_97(value) == 1, checked).otherwise(F.concat(F.substring(value, 1, 2), F.substr(_mapped(value, h), F.lit(3), size)))
        hexadecimal = lambda s: F.array_join(F.transform(_chars(s), lambda c, i: F.when(c.rlike("[0-9a-f]"), F.substr(h, i % 255 + 1, F.lit(1))).otherwise(c)), "")
        cyrillic = value.rlike(r"\p{IsCyrillic}")
        woman = (kind == "given_f") | ((kind == "given_u") & (F.pmod(_number(h, 9, 2), F.lit(2)) == 0))
        if turn:
            made = F.when(cyrillic, _syllables(SYLLABLES_CYRILLIC, h, turn + 2)).otherwise(_syllables(SYLLABLES, h, turn + 2))
            ending = lambda g: F.when(cyrillic, ENDINGS[g][1]).otherwise(ENDINGS[g][0])
            given = F.concat(made, F.when(woman, ending("f")).otherwise(ending("m")))
            family = made
        else:
            given = (
                F.when(cyrillic & woman, _pick(FEMALE_CYRILLIC, h, 1)).when(cyrillic, _pick(MALE_CYRILLIC, h, 1))
                .when(woman, _pick(FEMALE, h, 1)).otherwise(_pick(MALE, h, 1))
            )
            family = F.when(cyrillic, _pick(FAMILY_CYRILLIC, h, 1)).otherwise(_pick(FAMILY, h, 1))
        return (
            F.when(kind == "card", F.concat(card, check))
            .when(kind == "phone", F.concat(F.substring(value, 1, 1), F.substr(digits, F.lit(1), size - 1)))
            .when(kind == "ssn", F.concat(F.lit("9"), F.substr(digits, F.lit(1), size - 1)))
            .when(kind == "ip", F.concat_ws(".", *[octet(k) for k in range(4)]))
            .when(kind == "email", address)
            .when(kind == "iban", account)
            .when(kind == "family", F.lower(family))
            .when(kind.startswith("given_"), F.lower(given))
            .when(kind == "ipv6", hexadecimal(value))
            .when(value.rlike("^[0-9a-f]+$"), hexadecimal(value))
            .otherwise(F.concat(F.substring(value, 1, 2), F.substr(_mapped(value, h), F.lit(3), size)))
        )

    return _bound(_drawn(key, F.lit(str(turn)), kind, value), drawn)


def surrogate_table(entities: DataFrame, key: str) -> DataFrame:
    """``kind, value, surrogate`` of distinct entities ``kind, value``, one surrogate each.

    No two entities share a surrogate, of whatever kind, and no surrogate is a value of
    the corpus. Of the entities that draw the same the smallest wins, by an aggregate
    that combines early; the others draw again from a larger choice. Names are drawn
    until each has one; entities whose layout bounds the choice get a tag once, after
    ``DRAWS`` turns, a turn places under one in twenty.
    """
    entities = durable(entities, "entities")
    done, rest = [], entities
    taken = [entities.select(F.col("value").alias("surrogate"))]
    tag = F.concat(F.lit("["), F.upper("kind"), F.lit("-"), F.sha2(F.concat_ws("\x1f", F.lit(key), "kind", "value"), 256), F.lit("]"))
    waiting = None
    for turn in count():
        drawn = durable(rest.withColumn("surrogate", _surrogate(F.col("kind"), F.col("value"), turn, key)), "drawn")
        best = drawn.groupBy("surrogate").agg(F.min(F.struct("kind", "value")).alias("w"))
        free = reduce(lambda d, t: d.join(t, "surrogate", "left_anti"), taken, best)
        won = durable(free.select("w.kind", "w.value", "surrogate"), "won")
        done.append(won)
        taken.append(won.select("surrogate"))
        rest = durable(drawn.select("kind", "value").join(won.select("kind", "value"), ["kind", "value"], "left_anti"), "rest")
        left = rest.agg(F.count("*"), F.count_if(~F.col("kind").startswith("given_") & (F.col("kind") != "family"))).first()
        bounded = left[1]
        if bounded and turn >= DRAWS and waiting is not None and (waiting - bounded) * 20 < waiting:
            bounded_kind = ~F.col("kind").startswith("given_") & (F.col("kind") != "family")
            done.append(rest.where(bounded_kind).select("kind", "value", tag.alias("surrogate")))
            rest = rest.where(~bounded_kind)
            left = (left[0] - bounded, 0)
        waiting = bounded
        if not left[0]:
            return reduce(DataFrame.unionByName, done)


def _rendered(kind: Column, mention: Column, found: Column) -> Column:
    """The surrogates, by kind of entity, in the layout of a mention."""
    parts = name_parts(mention)
    surrogate = F.get(F.map_values(found), 0)
    nth = lambda i: F.length(_plain_digits(F.substr(mention, F.lit(1), i + 1)))
    laid_out = F.array_join(F.transform(_chars(mention), lambda c, i: F.when(c.between("0", "9"), F.substr(surrogate, nth(i), F.lit(1))).otherwise(c)), "")
    cased = F.when(mention == F.upper(mention), F.upper(surrogate)).otherwise(surrogate)
    lead = F.regexp_extract(mention, r"^(.*?)[A-Za-z0-9_+/=.~-]+$", 1)
    tail = F.substr(mention, F.length(lead) + 1, F.length(mention))
    # A bank account's blanks stay where they are.
    letters = lambda i: F.length(F.regexp_replace(F.substr(mention, F.lit(1), i + 1), r"\x20", ""))
    spaced = F.array_join(F.transform(_chars(mention), lambda c, i: F.when(c == " ", c).otherwise(F.substr(surrogate, letters(i), F.lit(1)))), "")
    like = lambda part, value: F.when(part == F.upper(part), F.upper(value)).otherwise(F.initcap(value))
    given = F.element_at(F.map_values(F.map_filter(found, lambda k, _: k.startswith("given_"))), 1)
    family = F.element_at(found, "family")
    name = F.concat(parts["title"], F.when(parts["given"] != "", F.concat(like(parts["given"], given), F.lit(" "))).otherwise(""), like(parts["family"], family))
    return (
        F.when(kind == "name", name)
        .when(surrogate.startswith("["), surrogate)
        .when(kind.isin("phone", "card", "ssn"), laid_out)
        .when(kind.isin("email", "ipv6"), cased)
        .when(kind == "iban", spaced)
        .when(kind == "secret", F.concat(lead, F.when((tail == F.upper(tail)) & tail.rlike("^[0-9A-F]+$"), F.upper(surrogate)).otherwise(surrogate)))
        .otherwise(surrogate)
    )


def pseudonymised(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """``docs`` with surrogates in the text, and ``pii_count`` and ``pii_kinds`` beside.

    ``key`` decides all surrogates and is to be kept secret. Null texts stay null and
    texts without entities stay as they are; other columns, whatever their names, are
    untouched, but for input columns ``pii_count`` and ``pii_kinds``, which are replaced.
    Repeated rows are treated alike; an empty table gives none.
    """
    rows, names, (place,) = positional(docs.drop("pii_count", "pii_kinds"), text_col)
    text = F.col(place).cast("string")
    found = rows.withColumn("_found", F.transform(F.regexp_extract_all(text, F.lit(ANY), F.lit(0)), lambda m: F.struct(kind_of(m).alias("kind"), m.alias("m"))))
    real = F.filter("_found", lambda e: e["kind"].isNotNull())
    some = F.coalesce(F.size(real), F.lit(0)) > 0
    untouched = named(found.where(~some), names, pii_count=F.lit(0), pii_kinds=F.lit(""))
    touched = durable(found.where(some).withColumn("_parts", F.split(text, ANY, -1)).withColumn("_row", F.monotonically_increasing_id()), "touched")
    mentions = durable(
        touched.select("_row", F.posexplode("_found").alias("at", "e")).where("e.kind is not null")
        .select("_row", "at", F.col("e.kind").alias("kind"), F.col("e.m").alias("mention"), entities_of(F.col("e.kind"), F.col("e.m")).alias("entities")),
        "mentions",
    )
    # One row for each way to write an entity or a name: what is rendered is rendered once.
    written = durable(mentions.select("kind", "mention", "entities").distinct(), "written")
    cells = written.select("kind", "mention", F.inline("entities").alias("part", "value"))
    table = surrogate_table(cells.select(F.col("part").alias("kind"), "value").distinct(), key)
    table = durable(table.withColumnRenamed("kind", "part"), "surrogates")
    new = (
        cells.join(table, ["part", "value"])
        .groupBy("kind", "mention").agg(F.map_from_entries(F.collect_list(F.struct("part", "surrogate"))).alias("by_part"))
        .select("kind", "mention", _rendered(F.col("kind"), F.col("mention"), F.col("by_part")).alias("new"))
    )
    by_row = (
        mentions.select("_row", "at", "kind", "mention").join(durable(new, "rendered"), ["kind", "mention"])
        .groupBy("_row").agg(
            F.map_from_entries(F.collect_list(F.struct("at", "new"))).alias("_new"),
            F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("_kinds"),
        )
    )
    whole = F.concat(
        F.element_at("_parts", 1),
        F.array_join(F.transform("_found", lambda e, i: F.concat(F.coalesce(F.try_element_at("_new", i), e["m"]), F.element_at("_parts", i + 2))), ""),
    )
    changed = touched.join(by_row, "_row").withColumn(place, whole)
    return untouched.unionByName(named(changed, names, pii_count=F.size(real), pii_kinds=F.col("_kinds")))
