"""Reading schemaless JSON through VARIANT columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from faultline.functions.arrays import let

INTEGER_TEXT = r"^\s*[+-]?\d+\s*$"
_STRING = r'"(?:[^"\\]++|\\.)*+"'
# Texts that a string and a value counting as false share, none longer than the bytes below.
_UNCLEAR = r"^(?:false|\[\]|\{\}|-?0(?:\.0*)?(?:E[+-]?\d+)?)$"
_UNCLEAR_BYTES = 64


def parse_strict(text: Column) -> Column:
    """The text as one JSON value; null when it is not JSON or something follows the value.

    The lenient parser stops after the first value. Wrapping the text as a member of an object with a
    closing member makes leftovers visible: the object must come out whole, with just these two members.
    """
    wrapped = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit(',"end":0}')))
    members = F.try_variant_get(wrapped, "$", "map<string,variant>")
    # The one-element array binds the members to a name, so the text is parsed once.
    complete = F.filter(F.array(members), lambda m: (F.size(m) == 2) & m["end"].isNotNull())
    return F.get(complete, 0)["v"]


def may_be_json(text: Column) -> Column:
    """False only for texts that begin as no JSON value does; parsing those would end in a costly exception."""
    return text.rlike(r'^[ \t\r\n]*+(?:[\[{"\-0-9]|true|false|null)')


def child(value: Column, path: str) -> Column:
    """The member at ``path``; SQL null only where the key is absent."""
    return F.try_variant_get(value, path, "variant")


def has_key(value: Column, key: str) -> Column:
    """The key is present, whatever its value (a JSON null counts)."""
    return child(value, f"$.{key}").isNotNull()


def kind(value: Column) -> Column:
    """JSON type name: STRING, BIGINT, BOOLEAN, VOID, or one starting with OBJECT or ARRAY. It describes
    the whole value, so it is meant for small ones."""
    return F.schema_of_variant(value)


def is_string(value: Column) -> Column:
    return F.coalesce(kind(value) == "STRING", F.lit(False))


def is_object(value: Column) -> Column:
    return F.try_variant_get(value, "$", "map<string,variant>").isNotNull()


def is_array(value: Column) -> Column:
    return F.try_variant_get(value, "$", "array<variant>").isNotNull()


def text_of(value: Column, path: str = "$") -> Column:
    """The member as text (JSON for objects and arrays); null where absent or null."""
    return F.try_variant_get(value, path, "string")


def string_at(value: Column, path: str) -> Column:
    """The member if it is a JSON string, else null."""
    return let(child(value, path), lambda member: F.when(is_string(member), text_of(member)))


def array_at(value: Column, path: str) -> Column:
    """The member as an array of values; empty where it is absent or not an array."""
    return F.coalesce(
        F.try_variant_get(value, path, "array<variant>"), F.array().cast("array<variant>")
    )


def integer_of(value: Column) -> Column:
    """The value as an integer where it is a number, a boolean or integer text, else null."""
    shape = kind(value)
    number = F.try_variant_get(value, "$", "double")
    from_text = F.when(text_of(value).rlike(INTEGER_TEXT), F.trim(text_of(value)).try_cast("int"))
    return (
        F.when(shape == "STRING", from_text)
        .when(shape.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.when(number >= 0, F.floor(number)).otherwise(F.ceil(number)).try_cast("int"))
        .when(shape == "BOOLEAN", F.try_variant_get(value, "$", "boolean").cast("int"))
    )


def truthy(value: Column) -> Column:
    """The value counts as true: not absent, null, false, zero, or empty."""
    return let(value, lambda x: let(text_of(x), lambda text: _text_truthy(x, text)))


def unclear(text: Column) -> Column:
    """The text alone does not tell whether its value counts as true; null and the empty text do (as false)."""
    return (F.octet_length(text) <= _UNCLEAR_BYTES) & text.rlike(_UNCLEAR)


def _text_truthy(value: Column, text: Column) -> Column:
    """``_truthy`` by the value's text (a bound variable), which spares most values their type."""
    return F.when(text.isNull(), F.lit(False)).when(unclear(text), _truthy(value)).otherwise(F.length(text) > 0)


def truthy_at(record: Column, path: str) -> Column:
    """``truthy`` of the member at ``path``, which is taken out as a value only where its text does not tell."""
    return let(text_of(record, path), lambda text: _text_truthy(child(record, path), text))


def _truthy(value: Column) -> Column:
    shape, text = kind(value), text_of(value)
    return F.coalesce(
        F.when(shape == "BOOLEAN", F.try_variant_get(value, "$", "boolean"))
        .when(shape == "VOID", F.lit(False))
        .when(shape == "STRING", F.length(text) > 0)
        .when(shape.startswith("ARRAY"), child(value, "$[0]").isNotNull())
        .when(shape.startswith("OBJECT"), text != "{}")
        .otherwise(F.try_variant_get(value, "$", "double") != 0),
        F.lit(False),
    )


def first_truthy_text(*values: Column) -> Column:
    """Text of the first value that counts as true, else null."""
    return F.coalesce(*[
        let(v, lambda x: let(text_of(x), lambda text: F.when(_text_truthy(x, text), text))) for v in values
    ])


def spaced_json(text: Column) -> Column:
    """JSON text with one blank after every comma and colon and no other white space between tokens."""
    bare = F.regexp_replace(text, rf'(?s)({_STRING}|[^"\s]++)|\s++', "$1")
    return F.regexp_replace(bare, rf'(?s)\G((?:{_STRING}|[^",:]++)*+[,:])', "$1 ")
