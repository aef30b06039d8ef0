"""Tolerant parsing of literals, JSON and yes-or-no answers (JSN-*, BOO-*, NUM-01)."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_json(c: str | Column) -> Column:
    """A Python literal as JSON text: ``None``, ``True`` and ``False`` outside quotes are renamed."""
    text = _c(c)
    for name, other in (("None", "null"), ("True", "true"), ("False", "false")):
        text = F.regexp_replace(text, rf"(?<=[\[{{:,(]|^)(\s*){name}(?=\s*[\]}},)]|\s*$)", f"$1{other}")
    return text


def literal(c: str | Column, schema: str) -> Column:
    """JSN-01: a list or record kept as Python or JSON text, null where it cannot be read."""
    return F.from_json(as_json(c), schema)


def literal_list(c: str | Column, schema: str) -> Column:
    """JSN-01: like ``literal``, but an empty list where it cannot be read."""
    return F.coalesce(literal(c, schema), F.array().cast(schema))


def string_list(c: str | Column) -> Column:
    return literal(c, "array<string>")


def preferred_text(c: str | Column) -> Column:
    """JSN-02: ``{'preferred': x}`` as x, another record as its first non-blank value, other text as it is."""
    c = _c(c)
    record = literal(c, "map<string,string>")
    values = F.filter(F.map_values(record), lambda v: F.trim(v) != "")
    named = F.nullif(F.trim(F.try_element_at(record, F.lit("preferred"))), F.lit(""))
    return F.when(F.trim(c).startswith("{"), F.coalesce(named, F.get(values, 0), c)).otherwise(c)


def first_object(c: str | Column) -> Column:
    """JSN-03: the first ``{...}`` in a text that may be fenced, null without one."""
    bare = F.regexp_replace(F.regexp_replace(_c(c), r"(?i)^\s*```(?:json)?\s*", ""), r"\s*```\s*$", "")
    return F.nullif(F.regexp_extract(bare, r"(?s)\{.*?\}", 0), F.lit(""))


def outer_object(c: str | Column, schema: str) -> Column:
    """JSN-06: from the first ``{`` to the last ``}``, read with a schema."""
    return F.from_json(as_json(F.nullif(F.regexp_extract(_c(c), r"(?s)\{.*\}", 0), F.lit(""))), schema)


#: Keys under which a label may stand, and the words for yes and no.
LABEL_KEYS = ["implies_UKB_use", "implies_ukb_use", "ukb_use", "uses_uk_biobank", "uses_UKB", "used_UKB", "label", "prediction", "answer"]
YES = ["true", "yes", "y", "1", "positive", "likely", "likely true"]
NO = ["false", "no", "n", "0", "negative", "unlikely", "likely false"]
#: Words that are an answer alone, and the phrase that holds one.
PLAIN_WORDS = ["true", "yes", "1", "false", "no", "0"]
PHRASE = r"(?i)implies[_\s-]*UKB[_\s-]*use\s*[:=]\s*(true|false|yes|no|1|0)"


def tolerant_bool(c: str | Column) -> Column:
    """BOO-01: a word for yes or no, else null."""
    word = F.regexp_replace(F.lower(F.trim(_c(c).cast("string"))), r"^[\"'`.,;: ]+|[\"'`.,;: ]+$", "")
    word = F.regexp_replace(word, r"^([01])\.0$", "$1")
    return F.when(word.isin(YES), True).when(word.isin(NO), False)


def strict_bool(c: str | Column) -> Column:
    """BOO-02: unknown text is false."""
    return F.coalesce(tolerant_bool(c), F.lit(False))


def label_01(c: str | Column) -> Column:
    """BOO-03: 1, 0 or null; words come before numbers."""
    c = _c(c).cast("string")
    number = c.try_cast("double")
    return F.coalesce(tolerant_bool(c).cast("int"), F.when(number.isin(0.0, 1.0), number.cast("int")))


def margin_bucket(c: str | Column) -> Column:
    """BOO-04: ``high`` from .06, ``medium`` from .03, else ``low``."""
    return F.when(_c(c) >= 0.06, "high").when(_c(c) >= 0.03, "medium").otherwise("low")


def one_of(c: str | Column, allowed: list[str], default: str) -> Column:
    """BOO-05: the value in lower case with underscores if it is allowed, else the default."""
    value = F.regexp_replace(F.lower(F.trim(_c(c))), r"[\s-]+", "_")
    return F.when(value.isin(allowed), value).otherwise(default)


def patch_of(c: str | Column) -> Column:
    """JSN-08: a patch's fields and values as JSON text; what is no JSON object is an empty patch."""
    return F.coalesce(F.from_json(_c(c), "map<string,string>"), F.from_json(F.lit("{}"), "map<string,string>"))


def number_or_zero(c: str | Column) -> Column:
    """NUM-01: a number, 0 where there is none."""
    return F.coalesce(_c(c).cast("string").try_cast("double"), F.lit(0.0))


#: A quoted text, a mark of structure, or a bare word of a JSON or Python literal.
_TOKEN = re.compile(r"""\s*(?:("(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|([{}\[\]:,])|([^\s{}\[\]:,"']+))""", re.DOTALL)
_CONSTANTS = {"true": True, "false": False, "null": None, "none": None}
_CLOSING = {"{": "}", "[": "]"}
#: How deep lists and records may nest.
_DEEPEST = 64


class _Literals:
    """A cursor over the tokens of a text that reads JSON and Python literals alike."""

    def __init__(self, text: str, start: int):
        self.tokens, self.ahead = _TOKEN.finditer(text, start), None
        self.advance()

    def advance(self) -> re.Match | None:
        token, self.ahead = self.ahead, next(self.tokens, None)
        return token

    def at(self, mark: str) -> bool:
        return self.ahead is not None and self.ahead[2] == mark

    def take(self, mark: str) -> None:
        if not self.at(mark):
            raise ValueError(mark)
        self.advance()

    def value(self, depth: int = 0) -> object:
        token = self.advance()
        if token is None or depth > _DEEPEST:
            raise ValueError("no value")
        if token[1]:
            return re.sub(r"\\(.)", r"\1", token[1][1:-1], flags=re.DOTALL)
        if token[3]:
            word = token[3]
            return _CONSTANTS[word.lower()] if word.lower() in _CONSTANTS else float(word)
        if token[2] not in _CLOSING:
            raise ValueError(token[2])
        return self.items(_CLOSING[token[2]], depth + 1)

    def items(self, closing: str, depth: int) -> dict | list:
        """Members up to the closing mark; a comma may trail."""
        record, values = {}, []
        while not self.at(closing):
            item = self.value(depth)
            if closing == "}":
                if not isinstance(item, str):
                    raise ValueError("key")
                self.take(":")
                record[item] = self.value(depth)
            else:
                values.append(item)
            if not self.at(closing):
                self.take(",")
        self.take(closing)
        return record if closing == "}" else values


def records_in(text: str) -> Iterator[dict]:
    """Every record that can be read from a ``{`` of the text on, from the left."""
    for brace in re.finditer(r"\{", text):
        try:
            yield _Literals(text, brace.start()).value()
        except ValueError:
            continue


def _said(value: object) -> bool | None:
    """BOO-01 for one value."""
    if isinstance(value, str):
        word = value.strip().strip("\"'`.,;: ").lower()
        return True if word in YES else False if word in NO else None
    return {True: True, False: False}.get(value) if isinstance(value, (bool, float)) else None


def parse_answer(text: str | None) -> bool | None:
    """The yes-or-no label in a model's answer: a record's label field, a bare word, or ``implies UKB use: x``."""
    text = text or ""
    for record in records_in(text):
        labels = (_said(record[key]) for key in LABEL_KEYS if key in record)
        if (label := next((x for x in labels if x is not None), None)) is not None:
            return label
    # Without a record the answer is one word, whatever stands around it, or a phrase that names it.
    words = re.findall(r"[a-z0-9_-]+", re.sub(r"(?i)```(?:json)?", " ", text).lower())
    if len(words) == 1 and words[0] in PLAIN_WORDS:
        return _said(words[0])
    phrase = re.search(PHRASE, text)
    return _said(phrase[1]) if phrase else None


def balanced_fragment(text: str | None) -> str | None:
    """The first balanced ``{...}`` or ``[...]``, aware of strings and escapes."""
    for start in (m.start() for m in re.finditer(r"[\[{]", text or "")):
        depth, quoted, escaped = 0, False, False
        for k in range(start, len(text)):
            char = text[k]
            if quoted:
                quoted, escaped = escaped or char != '"', char == "\\" and not escaped
            elif char == '"':
                quoted = True
            elif char in "[{":
                depth += 1
            elif char in "]}":
                depth -= 1
                if not depth:
                    return text[start : k + 1]
    return None


@F.pandas_udf(T.BooleanType())
def robust_label(texts: pd.Series) -> pd.Series:
    """JSN-04 as a column function."""
    return texts.map(parse_answer, na_action="ignore").astype(object).where(lambda s: s.notna(), None)


@F.pandas_udf(T.StringType())
def json_fragment(texts: pd.Series) -> pd.Series:
    """JSN-05 as a column function."""
    return texts.map(balanced_fragment, na_action="ignore").astype(object).where(lambda s: s.notna(), None)
