"""Text functions: JSON fields, URL encoding, path parts, trimming, label codes, and the expression lexer."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The lexer's keywords.
KEYWORDS = ("exp", "log", "sqrt", "abs", "max", "min", "sigmoid")
NUMBER = r"(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"
IDENTIFIER = r"[A-Za-z_][A-Za-z0-9_]*"
_token = re.compile(rf"\s*(?:(?P<number>{NUMBER})|(?P<identifier>{IDENTIFIER})|(?P<symbol>[-+*/^(),]))")


@dataclass(frozen=True)
class Token:
    kind: str
    text: str
    value: float | None = None


def tokenize(text: str) -> list[Token]:
    """Tokens of an expression, an END last. Unknown characters and numbers with an empty exponent raise ValueError."""
    found, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = _token.match(text, at)
        if not m:
            raise ValueError(f"unexpected character at {at}: {text[at : at + 8]!r}")
        at = m.end()
        if m["number"]:
            if re.match(r"[eE.]", text[at : at + 1]) and not re.match(rf"[eE]{IDENTIFIER[:0]}[A-Za-z_]", text[at : at + 2]):
                raise ValueError(f"malformed number near {text[m.start('number') : at + 2]!r}")
            found.append(Token("number", m["number"], float(m["number"])))
        elif m["identifier"]:
            found.append(Token("keyword" if m["identifier"] in KEYWORDS else "identifier", m["identifier"]))
        else:
            found.append(Token("symbol", m["symbol"]))
    return [*found, Token("end", "")]


def lexemes(text: Column) -> Column:
    """All token texts of an expression column, in order, by one regular expression in the JVM; no validation."""
    return F.regexp_extract_all(text, F.lit(rf"({NUMBER}|{IDENTIFIER}|[-+*/^(),])"), F.lit(1))


def json_field(text: Column, path: str) -> Column:
    return F.get_json_object(text, path if path.startswith("$") else f"$.{path}")


def episode_number(path: Column) -> Column:
    """The number in a checkpoint's file name; -2 for the best one, -1 for the final one, NULL for others."""
    name = F.element_at(F.split(path, "/"), -1)
    digits = F.regexp_extract(name, r"([0-9]+)", 1)
    return F.when(name.contains("best"), F.lit(-2)).when(name.contains("final"), F.lit(-1)).when(digits != "", F.try_to_number(digits, F.lit("9999999999")).cast("int"))


def trim_blanks(text: Column) -> Column:
    """Without spaces and tabs at both ends, and without a carriage return at the end."""
    return F.regexp_replace(text, r"^[ \t]+|[ \t\r]+$", "")


def number_with_comma(text: Column) -> Column:
    """A float whose decimal point may be a comma; NULL if malformed."""
    return F.regexp_replace(text, ",", ".").try_cast("float")


def label_code(text: Column, names: list[str]) -> Column:
    """The index of a class name; NULL for a name that isn't listed."""
    return F.coalesce(*[F.when(text == name, F.lit(k)) for k, name in enumerate(names)])


def enum_code(text: Column, names: list[str]) -> Column:
    """As label_code, case-insensitive."""
    return label_code(F.lower(text), [n.lower() for n in names])


def regression_code(y: Column) -> Column:
    """round(y * 10000) as an integer."""
    return F.round(y * 10000).cast("int")
