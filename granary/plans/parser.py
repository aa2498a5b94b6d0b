"""The recursive-descent parser: a program's text becomes statement nodes.

AND and OR have equal precedence and group to the left; there are no parentheses around conditions
and no NOT. The right side of a comparison is a literal or a name.
"""

from __future__ import annotations

from granary.errors import ParseError
from granary.plans import nodes as n
from granary.plans.tokens import COMPARISONS, RESERVED, Token, tokenize

FUNCTIONS = ("COUNT", "SUM", "AVG", "MIN", "MAX")
LAYOUTS = ("BTREE", "HASH", "SEQUENTIAL", "RTREE")
OTHER_JOINS = ("LEFT", "RIGHT", "FULL", "OUTER", "CROSS", "NATURAL", "SEMI", "ANTI")


def parse(text: str) -> list[n.Statement]:
    """All statements of a program; semicolons between them may be left out."""
    return _Parser(tokenize(text)).program()


class _Parser:
    def __init__(self, tokens: list[Token]):
        self.tokens, self.at = tokens, 0

    # The stream of tokens.

    @property
    def now(self) -> Token:
        return self.tokens[self.at]

    def after(self, steps: int = 1) -> Token:
        return self.tokens[min(self.at + steps, len(self.tokens) - 1)]

    def take(self) -> Token:
        token = self.now
        self.at = min(self.at + 1, len(self.tokens) - 1)
        return token

    def fail(self, wanted: str) -> ParseError:
        return ParseError(f"expected {wanted}, got {self.now.text or 'the end'!r} at position {self.now.at}")

    def is_mark(self, text: str) -> bool:
        return self.now.kind == "mark" and self.now.text == text

    def skip_mark(self, text: str) -> bool:
        found = self.is_mark(text)
        if found:
            self.take()
        return found

    def need_mark(self, text: str) -> None:
        if not self.skip_mark(text):
            raise self.fail(repr(text))

    def skip_word(self, word: str) -> bool:
        found = self.now.upper == word
        if found:
            self.take()
        return found

    def need_word(self, *words: str) -> None:
        for word in words:
            if not self.skip_word(word):
                raise self.fail(word)

    def name(self) -> str:
        if self.now.kind != "word" or self.now.upper in RESERVED:
            raise self.fail("a name")
        return self.take().text

    def listed(self, one) -> list:
        out = [one()]
        while self.skip_mark(","):
            out.append(one())
        return out

    # Statements.

    def program(self) -> list[n.Statement]:
        out = []
        while True:
            while self.skip_mark(";"):
                pass
            if self.now.kind == "end":
                return out
            out.append(self.statement())

    def statement(self) -> n.Statement:
        begins = {"CREATE": self.create, "SELECT": self.select, "INSERT": self.insert, "DELETE": self.delete}
        if self.now.upper not in begins:
            raise self.fail("CREATE, SELECT, INSERT or DELETE")
        return begins[self.take().upper]()

    def create(self) -> n.Create:
        self.need_word("TABLE")
        table = self.name()
        self.need_mark("(")
        columns = self.listed(self.column_def)
        self.need_mark(")")
        layouts: list[n.LayoutDef] = []
        if self.skip_word("INDEX"):
            self.need_mark("(")
            layouts = self.listed(self.layout_def)
            self.need_mark(")")
        path = None
        if self.skip_word("FROM"):
            self.need_word("FILE")
            if self.now.kind != "string":
                raise self.fail("a path in quotes")
            path = str(self.take().value)
        return n.Create(table, tuple(columns), tuple(layouts), path)

    def column_def(self) -> n.ColumnDef:
        name, kind, size = self.name(), self.name(), None
        if self.skip_mark("("):
            if self.now.kind != "int":
                raise self.fail("a size")
            size = int(self.take().value)
            self.need_mark(")")
        return n.ColumnDef(name, kind, size)

    def layout_def(self) -> n.LayoutDef:
        if self.now.upper not in LAYOUTS:
            raise self.fail("BTREE, HASH, SEQUENTIAL or RTREE")
        kind = self.take().upper
        column = self.name()
        second = self.name() if kind == "RTREE" and self.now.kind == "word" else None
        return n.LayoutDef(kind, column, second)

    def select(self) -> n.Select:
        targets = self.listed(self.target)
        self.need_word("FROM")
        table, alias = self.table_and_alias()
        join = None
        if self.now.upper in OTHER_JOINS:
            raise ParseError(f"only inner joins are supported, not {self.now.upper} (position {self.now.at})")
        if self.now.upper == "INNER" or self.now.upper == "JOIN":
            self.skip_word("INNER")
            self.need_word("JOIN")
            join = self.join()
        where = self.conditions() if self.skip_word("WHERE") else None
        group_by: list[n.Name] = []
        if self.skip_word("GROUP"):
            self.need_word("BY")
            group_by = self.listed(self.qualified)
        order_by: list[n.Name] = []
        if self.skip_word("ORDER"):
            self.need_word("BY")
            order_by = self.listed(self.qualified)
        return n.Select(tuple(targets), table, alias, join, where, tuple(group_by), tuple(order_by))

    def table_and_alias(self) -> tuple[str, str | None]:
        table = self.name()
        token = self.now
        joins = token.upper in (*OTHER_JOINS, "INNER") and self.after().upper in ("JOIN", "OUTER")
        orders = token.upper == "ORDER" and self.after().upper == "BY"
        if token.kind == "word" and token.upper not in RESERVED and not joins and not orders:
            return table, self.take().text
        return table, None

    def target(self) -> n.Star | n.Name | n.Aggregate:
        if self.skip_mark("*"):
            return n.Star()
        if self.now.upper in FUNCTIONS and self.after().text == "(":
            function = self.take().upper
            self.need_mark("(")
            if function == "COUNT" and self.skip_mark("*"):
                argument = None
            else:
                argument = self.qualified()
            self.need_mark(")")
            return n.Aggregate(function, argument)
        return self.qualified()

    def qualified(self) -> n.Name:
        first = self.name()
        return n.Name(self.name(), first) if self.skip_mark(".") else n.Name(first)

    def join(self) -> n.Join:
        table, alias = self.table_and_alias()
        self.need_word("ON")
        left = self.qualified()
        op = self.take().text
        if op not in ("=", "=="):
            raise ParseError(f"a join condition compares with =, not {op!r}")
        return n.Join(table, alias, left, self.qualified())

    def insert(self) -> n.Insert:
        self.need_word("INTO")
        table = self.name()
        self.need_word("VALUES")
        self.need_mark("(")
        values = self.listed(self.literal)
        self.need_mark(")")
        return n.Insert(table, tuple(values))

    def delete(self) -> n.Delete:
        self.need_word("FROM")
        table = self.name()
        return n.Delete(table, self.conditions() if self.skip_word("WHERE") else None)

    # Conditions and literals.

    def conditions(self) -> object:
        out = self.condition()
        while self.now.upper in ("AND", "OR"):
            op = self.take().upper
            out = n.Both(op, out, self.condition())
        return out

    def condition(self) -> object:
        if self.is_mark("("):
            self.take()
            x = self.qualified()
            self.need_mark(",")
            y = self.qualified()
            self.need_mark(")")
            self.need_word("IN")
            return self.near((x, y))
        column = self.qualified()
        if self.skip_word("IN"):
            return self.near((column,))
        if self.skip_word("BETWEEN"):
            low = self.operand()
            self.need_word("AND")
            return n.Between(column, low, self.operand())
        if self.now.kind != "op" or self.now.text not in COMPARISONS:
            raise self.fail("a comparison")
        op = self.take().text
        return n.Compare(column, "=" if op == "==" else op, self.operand())

    def near(self, columns: tuple[n.Name, ...]) -> n.Near:
        self.need_mark("(")
        self.need_word("POINT")
        self.need_mark("(")
        x = self.number()
        self.need_mark(",")
        y = self.number()
        self.need_mark(")")
        self.need_mark(",")
        if self.skip_word("RADIUS"):
            found = n.Near(columns, float(x), float(y), radius=float(self.number()))
        elif self.skip_word("K"):
            found = n.Near(columns, float(x), float(y), k=int(self.number()))
        else:
            raise self.fail("RADIUS or K")
        self.need_mark(")")
        return found

    def number(self) -> int | float:
        negative = self.now.text == "-" and self.now.kind == "op"
        if negative:
            self.take()
        if self.now.kind not in ("int", "float"):
            raise self.fail("a number")
        value = self.take().value
        return -value if negative else value

    def literal(self) -> object:
        return self.take().value if self.now.kind == "string" else self.number()

    def operand(self) -> object:
        return self.qualified() if self.now.kind == "word" else self.literal()
