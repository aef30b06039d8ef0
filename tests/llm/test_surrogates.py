"""Surrogates against plain Python: the same spans, a one-to-one table, valid checks, and nothing else changed."""

import random

import pytest
import regex

from scholia.llm import pii

SF = "/root/testdata/sf0.01"
KEY = "test"
PRIVATE = [
    (1, "mail ana.b@mail1.example.com, ANA.B@MAIL1.EXAMPLE.COM or bob.c@mail1.example.com"),
    (2, "call +1 (136) 555-7479 or +1-136-555-7479 from 59.36.80.30"),
    (3, "card 4111111111111111 and 4111 1111 1111 1111, not 4111111111111112"),
    (4, 'token = "2abc3ff2ca8fb1e4c565a0eb63815530a948bdde" TOKEN = "2ABC3FF2CA8FB1E4C565A0EB63815530A948BDDE"'),
    (5, "Mrs Smith met Mr Jones; Mary Smith and Иван Петренко. Version 1.2.3, page 12, year 1999"),
    (6, "ssn 123-45-6789 iban DE89 3704 0044 0532 0130 00 ana.b@mail1.example.com"),
    (7, None), (8, ""), (9, "nothing here: a@b, 12.5%, 3-4, 10.000, v1.2.3.4.5"), (10, "+1 (136) 555-7479"), (10, "+1 (136) 555-7479"),
    (11, "Mrs Smith met Mr Smith. Mary Smith, MARY SMITH and Dr Mary Jones. Name: Xochitl Quintero, Dear Bo Stone"),
    (12, "amex 3782 822463 10005, phones 555 123 4567 and 020 7946 0958, 2001:db8::ff00:42:8329 and FE80:0:0:0:1:2:3:4"),
    (13, "+1 (826) 555-4081 190.137.223.9 GB33BUKB20201555555555 password: hunter2hunter2"),
]


def luhn(s):
    return sum(sum(divmod(2 * int(c), 10)) if k % 2 else int(c) for k, c in enumerate(reversed(s))) % 10


def mod97(s):
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97


def digits(s):
    return regex.sub(r"\D", "", s)


def spans(text):
    """Mentions by a plain search: (start, end, kind)."""
    for m in regex.finditer(pii.ANY, text or ""):
        kind = next((t for t, p in pii.PATTERNS.items() if regex.fullmatch(p, text, pos=m.start(), endpos=m.end())), None)
        kind = kind or next(t for t, p in pii.PATTERNS.items() if (h := regex.compile(p).match(text, m.start())) and h.end() == m.end())
        if kind != "card" or luhn(digits(m[0])) == 0:
            yield m.start(), m.end(), kind


def entities(kind, mention):
    if kind in ("phone", "card", "ssn"):
        return [(kind, digits(mention))]
    if kind == "name":
        title = regex.match(rf"(?:({'|'.join([*pii.MALE_TITLES, *pii.FEMALE_TITLES, 'Dr', 'Prof'])})\.?\x20)?", mention)
        words = mention[title.end() :].lower().split(" ")
        given = words[0].capitalize() if len(words) > 1 else ""
        gender = "m" if title[1] in pii.MALE_TITLES else "f" if title[1] in pii.FEMALE_TITLES else None
        gender = gender or ("m" if given in [*pii.MALE, *pii.MALE_CYRILLIC] else "f" if given in [*pii.FEMALE, *pii.FEMALE_CYRILLIC] else "u")
        return [(f"given_{gender}", words[0])] * (len(words) > 1) + [("family", words[-1])]
    if kind == "secret":
        return [(kind, regex.search(r"[A-Za-z0-9_+/=.~-]+$", mention)[0].lower())]
    return [(kind, mention.replace(" ", "").lower() if kind == "iban" else mention.lower())]


def verify(rows, made):
    """Walk every old and new text side by side; the table that they imply must be one to one."""
    table, back, seen = {}, {}, set()
    olds = {}
    for d, t in rows:
        olds.setdefault(d, []).append(t)
    for d, new, n in made:
        old = olds[d].pop()
        found = list(spans(old))
        assert n == len(found), (d, old, found)
        at, last = 0, 0
        for k, (a, b, kind) in enumerate(found):
            gap = old[last:a]
            assert new[at : at + len(gap)] == gap, (d, old, new)
            at += len(gap)
            rest = old[b : found[k + 1][0] if k + 1 < len(found) else len(old)]
            end = len(new) if k + 1 == len(found) and not rest else next(e for e in range(at + 1, len(new) + 1) if new.startswith(rest, e) and fits(kind, old[a:b], new[at:e], rest, new[e:]))
            if k + 1 == len(found):
                end = len(new) - len(rest)
            mention, surrogate = old[a:b], new[at:end]
            for own, other in zip(entities(kind, mention), renamed(kind, mention, surrogate), strict=True):
                assert table.setdefault(own, other) == other, (own, table[own], other)
                assert back.setdefault(other, own) == own, (other, back[other], own)
                seen.add(own[1])
            at, last = end, b
        assert new is old is None or new[at:] == old[last:]
    assert not {v for _, v in back} & seen
    return table


def fits(kind, mention, surrogate, rest, tail):
    return surrogate.count(" ") == mention.count(" ") if kind in ("name", "email", "ip") else len(surrogate) == len(mention)


def renamed(kind, mention, surrogate):
    """Entities of a surrogate, whose layout must be the mention's."""
    if kind == "name":
        own = entities(kind, mention)
        words = surrogate.lower().split(" ")[-len(own) :]
        assert (surrogate.isupper() or len(surrogate) < 2) == (mention.isupper() or len(surrogate) < 2)
        return [(k, w) for (k, _), w in zip(own, words, strict=True)]
    shape = lambda s: regex.sub(r"[0-9]", "0", s)
    if kind in ("phone", "card", "ssn"):
        assert shape(surrogate) == shape(mention)
    if kind == "card":
        assert luhn(digits(surrogate)) == 0
    if kind == "iban" and mod97(mention.replace(" ", "")) == 1:
        assert mod97(surrogate.replace(" ", "")) == 1 and [c == " " for c in surrogate] == [c == " " for c in mention]
    if kind == "ip":
        assert len(surrogate.split(".")) == 4 and all(0 < int(p) < 255 for p in surrogate.split("."))
    if kind == "email":
        assert mention.isupper() == surrogate.isupper()
    return entities(kind, surrogate)


def run(spark, rows):
    made = pii.pseudonymised(spark.createDataFrame(rows, "doc_id long, text string"), KEY).collect()
    return [(r["doc_id"], r["text"], r["pii_count"]) for r in made]


def test_texts_equal_a_plain_walk(spark):
    table = verify(PRIVATE, run(spark, PRIVATE))
    of = lambda kind, value: table[kind, value][1]
    assert of("email", "ana.b@mail1.example.com").split("@")[1] == of("email", "bob.c@mail1.example.com").split("@")[1]
    assert of("email", "ana.b@mail1.example.com").split("@")[0] != of("email", "bob.c@mail1.example.com").split("@")[0]
    assert of("given_f", "mary").capitalize() in pii.FEMALE or regex.fullmatch("([a-z]{2})+na", of("given_f", "mary"))
    assert of("given_m", "иван").capitalize() in pii.MALE_CYRILLIC or regex.fullmatch("[а-я]+р", of("given_m", "иван"))
    assert {("family", "quintero"), ("given_u", "xochitl"), ("family", "stone"), ("card", "378282246310005"), ("phone", "5551234567"), ("phone", "02079460958")} <= set(table)
    assert {("ipv6", "2001:db8::ff00:42:8329"), ("ip", "190.137.223.9"), ("secret", "hunter2hunter2")} <= set(table)
    assert not any(v == "4111111111111112" for _, v in table)


def test_a_whole_table_equals_a_plain_walk(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    made = run(spark, rows)
    assert len(made) == len(rows) and len(verify(rows, made)) > 50
    assert run(spark, rows[:50]) != [] and sum(n > 0 for _, _, n in made) < 0.1 * len(rows)


def test_people_keep_their_family_and_gender(spark):
    new = dict((d, t) for d, t, _ in run(spark, PRIVATE))[11]
    m = regex.match(r"Mrs (\S+) met Mr (\S+)\. (\S+) (\S+), (\S+) (\S+) and Dr (\S+) (\S+)\. Name: (\S+) (\S+), Dear (\S+) (\S+)$", new)
    mrs, mr, mary, smith, loud_mary, loud_smith, dr_mary, jones = m.groups()[:8]
    assert mrs == mr == smith == loud_smith.capitalize() != jones and mary == loud_mary.capitalize() == dr_mary
    assert not {"Smith", "Mary", "Jones", "Xochitl", "Quintero", "Stone"} & set(m.groups())


def test_every_entity_gets_a_surrogate_of_its_own(spark):
    draw = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyz"
    family = {"".join(draw.choices(letters, k=7)) for _ in range(100_000)}
    rows = [("family", v) for v in family] + [("given_f", "".join(draw.choices("абвгде", k=9))) for _ in range(500)]
    rows += [("ip", f"10.0.{k // 256}.{k % 256}") for k in range(3000)] + [("email", f"{c}@a.com") for c in letters]
    rows = list(set(rows))
    found = pii.surrogate_table(spark.createDataFrame(rows, "kind string, value string"), KEY).collect()
    assert len(found) == len(rows) == len({r["surrogate"] for r in found}) and not {r["surrogate"] for r in found} & {v for _, v in rows}
    assert not any(r["surrogate"].startswith("[") for r in found)
    assert all(regex.fullmatch(r"\p{IsCyrillic}+", r["surrogate"]) for r in found if r["kind"] == "given_f")


def test_a_full_layout_ends_in_tags(spark):
    rows = [("phone", f"1{k:02d}") for k in range(100)]
    found = pii.surrogate_table(spark.createDataFrame(rows, "kind string, value string"), KEY).collect()
    assert len({r["surrogate"] for r in found}) == 100 and all(r["surrogate"].startswith("[PHONE-") for r in found)


@pytest.mark.parametrize("name", ["_row", "_found", "_parts", "_new", "_kinds", "c0", "c1", "mention", "kind", "score", "a.b"])
def test_columns_of_any_name_stay(spark, name):
    docs = spark.createDataFrame([(2**60 + 1, PRIVATE[0][1], 7), (None, "x", 8), (2**60 + 3, None, None)], ["doc_id", "text", name])
    made = pii.pseudonymised(docs, KEY)
    assert made.columns == ["doc_id", "text", name, "pii_count", "pii_kinds"]
    assert {(r[0], r[2], r[3]) for r in made.collect()} == {(2**60 + 1, 7, 3), (None, 8, 0), (2**60 + 3, None, 0)}


def test_long_texts_and_empty_tables(spark):
    text = ("ana@mail1.example.com " + "word " * 2000) * 300
    assert run(spark, [(1, text)])[0][2] == 300
    assert run(spark, [(1, "a" * 2_000_000), (2, "A1 " * 300_000)]) and pii.pseudonymised(spark.createDataFrame([], "doc_id long, text string"), KEY).count() == 0
