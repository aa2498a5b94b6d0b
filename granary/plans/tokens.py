"""The tokenizer of the dialect."""

from __future__ import annotations

import re
from dataclasses import dataclass

from granary.errors import ScanError

#: Words that no table or column may be called.
RESERVED = frozenset(
    "CREATE TABLE SELECT FROM JOIN ON WHERE GROUP BY INSERT INTO VALUES DELETE INDEX AND OR BETWEEN IN".split()
)
COMPARISONS = ("=", "==", "!=", "<", "<=", ">", ">=")
_TOKEN = re.compile(
    r"""(?P<space>\s+)
      | (?P<float>[0-9]+\.[0-9]+)
      | (?P<int>[0-9]+)
      | (?P<word>[^\W\d]\w*)
      | (?P<string>'(?:[^']|'')*'|"(?:[^"]|"")*")
      | (?P<op>==|!=|<=|>=|[=<>-])
      | (?P<mark>[(),.*;])""",
    re.X,
)


@dataclass(frozen=True)
class Token:
    """kind: int, float, word, string, op, mark or end. value: what a literal stands for."""

    kind: str
    text: str
    at: int
    value: object = None

    @property
    def upper(self) -> str:
        return self.text.upper() if self.kind == "word" else ""


def tokenize(text: str) -> list[Token]:
    """The tokens of a program; the last one is of kind ``end``."""
    out, at = [], 0
    while at < len(text):
        found = _TOKEN.match(text, at)
        if not found:
            raise ScanError(f"unexpected character {text[at]!r} at position {at}")
        kind, piece = found.lastgroup, found[0]
        value: object = None
        if kind == "int":
            value = int(piece)
        elif kind == "float":
            value = float(piece)
        elif kind == "string":
            value = piece[1:-1].replace(piece[0] * 2, piece[0])
        if kind != "space":
            out.append(Token(kind, piece, at, value))
        at = found.end()
    return [*out, Token("end", "", len(text))]
