"""Column builders for text: Python-compatible spelling of values, Unicode strip and title, words, and pattern checks."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A character that Python counts as a word character; Java's own \w is ASCII, and (?U)\w differs on marks and fractions.
WORD_RUN = r"[\p{L}\p{N}_]+"

# The patterns that count as personal data or secrets.
PII = {
    "email": r"(?U)(?iu)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b",
    "phone": r"(?U)(?<!\d)(?:\+?\d[\s().-]*){10,15}(?!\d)",
}
SECRETS = {
    "private_key": r"-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----",
    "huggingface_token": r"(?U)\bhf_[A-Za-z0-9]{30,}\b",
    "github_token": r"(?U)\bgh[opusr]_[A-Za-z0-9_]{30,}\b",
    "aws_access_key": r"(?U)\bAKIA[0-9A-Z]{16}\b",
    "assigned_secret": r"(?U)(?iu)\b(?:api[_-]?key|secret|access[_-]?token)\s*[:=]\s*['\"]?[A-Za-z0-9_./+=-]{20,}",
}


def strip(c: Column) -> Column:
    """Without white space, as Python's str.strip() knows it, at both ends: Unicode's, and the four separators 1C to 1F."""
    return F.regexp_replace(c, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


@F.arrow_udf(T.StringType())
def _titled(a: pa.Array) -> pa.Array:
    return pa.array([None if x is None else x.title() for x in a.to_pylist()], pa.string())


def title(c: Column) -> Column:
    """Python's str.title(): each run of cased characters with its first in title case. In Python, as the JVM's title case maps to one character and no function finds runs of cased ones."""
    return _titled(c)


@F.arrow_udf(T.StringType())
def _spelled(a: pa.Array) -> pa.Array:
    return pa.array([None if x is None else str(x) for x in a.to_pylist()], pa.string())


@F.arrow_udf(T.ArrayType(T.StringType()))
def _items_spelled(a: pa.Array) -> pa.Array:
    return pa.array([None if x is None else [str(y) for y in x] for x in a.to_pylist()], pa.list_(pa.string()))


def _plain(kind: T.DataType) -> bool:
    """Whether a cast spells values of the type as Python does."""
    return isinstance(kind, (T.StringType, T.IntegralType, T.NullType, T.DateType))


def spelled(c: Column, kind: T.DataType) -> Column:
    """A value as Python's str() spells it: None, True, 1e-05, ['a']. Only types that a cast spells otherwise go through Python."""
    if isinstance(kind, T.BooleanType):
        out = F.when(c, "True").when(~c, "False")
    else:
        out = c.cast("string") if _plain(kind) else _spelled(c)
    return F.coalesce(out, F.lit("None"))


def items_spelled(c: Column, item: T.DataType) -> Column:
    """A list's items, spelled."""
    if _plain(item) or isinstance(item, T.BooleanType):
        return F.transform(c, lambda x: spelled(x, item))
    return _items_spelled(c)


def joined(c: Column, item: T.DataType) -> Column:
    """A list's items, spelled and stripped, with commas between."""
    return F.array_join(F.transform(items_spelled(c, item), strip), ", ")


def words(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(WORD_RUN), 0)


def normalized(c: Column) -> Column:
    return F.array_join(words(c), " ")


def _ordered(c: Column, kind: T.DataType | None) -> Column:
    """A value with the fields of its objects, at any depth, in the order of their names."""
    if isinstance(kind, T.StructType):
        fields = sorted(kind.fields, key=lambda f: f.name)
        return F.when(c.isNotNull(), F.struct(*(_ordered(c[f.name], f.dataType).alias(f.name) for f in fields)))
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.StructType, T.ArrayType, T.MapType)):
        return F.transform(c, lambda x: _ordered(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.map_from_entries(F.array_sort(F.map_entries(c)))
    return c


def json_text(c: Column, kind: T.DataType | None = None) -> Column:
    """A value as JSON, in the brackets of a list of one, which no word can hold. With its type, object keys are sorted."""
    return F.to_json(F.array(_ordered(c, kind)), {"ignoreNullFields": "false"})


def source_text(inputs: dict[str, Column], kinds: dict[str, T.DataType] | None = None) -> Column:
    """The words of all inputs by field name; each value is JSON text first, so a newline becomes a backslash and an n."""
    return normalized(F.concat_ws(" ", *(json_text(inputs[k], (kinds or {}).get(k)) for k in sorted(inputs))))


#: What every match of a pattern holds; a text without it is not searched further.
HOLDS = {
    "email": "@",
    "phone": r"\p{Nd}",
    "private_key": "-----BEGIN ",
    "huggingface_token": "hf_",
    "github_token": "gh[opusr]_",
    "aws_access_key": "AKIA",
    "assigned_secret": "[:=]",
}


def matches(c: Column, patterns: dict[str, str]) -> dict[str, Column]:
    return {name: F.regexp_like(c, F.lit(HOLDS[name])) & F.regexp_like(c, F.lit(p)) for name, p in patterns.items()}


def literal_word(c: Column, word: Column) -> Column:
    """Whether the literal text of word stands in c between word boundaries, in either case."""
    return F.regexp_like(c, F.concat(F.lit(r"(?U)(?iu)\b\Q"), F.replace(word, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E\b")))


def partition(c: Column, marker: str) -> tuple[Column, Column, Column]:
    """(text before the first marker, whether it is there, text after it)."""
    at = F.locate(marker, c)
    before = F.when(at > 0, F.substring(c, F.lit(1), at - 1)).otherwise(c)
    after = F.when(at > 0, F.substring(c, at + len(marker), F.lit(2**31 - 1))).otherwise("")
    return before, at > 0, after


def draw_key(seed: int, *key: Column) -> Column:
    """A sort key for seeded orders that no partitioning or input order changes."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *(k.cast("string") for k in key)).cast("binary"))


def draw_number(key: Column) -> Column:
    """The first 32 bits of a draw key."""
    return F.conv(F.substring(key, 1, 8), 16, 10).cast("long")
