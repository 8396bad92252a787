"""A token stream for curly-brace languages: comments and string contents never look like code."""

from __future__ import annotations

import re
from typing import NamedTuple


class Token(NamedTuple):
    kind: str  # word, number, string, newline or mark
    text: str
    line: int


_KOTLIN_MARKS = r"->|=>|\?\.|\?:|::|\.\.<?|&&|\|\||==?=?|!=?=?|<=|>=|\+[+=]?|-[-=]?|[*/%]=?|@|[^\s\w]"
_PIECE = re.compile(
    rf"(?P<newline>\r\n?|\n)|(?P<blank>[ \t\f\v ]+)|(?P<comment>//[^\r\n]*|\#!\S[^\r\n]*)|(?P<block>/\*)|(?P<raw>\"\"\")|(?P<quote>\")|(?P<char>'(?:\\u[0-9a-fA-F]{{4}}|\\.|[^'\\\r\n])')"
    rf"|(?P<tick>`[^`\r\n]*`)|(?P<number>\d[\w.]*)|(?P<word>[^\W\d]\w*)|(?P<mark>{_KOTLIN_MARKS})|(?P<other>.)",
    re.S,
)


def tokens(text: str, interpolation: str = "${") -> list[Token]:
    """interpolation: how an expression starts inside a string ("${" or "\\\\(")."""
    out: list[Token] = []
    line, at = 0, 0
    while at < len(text):
        m = _PIECE.match(text, at)
        kind, found = m.lastgroup, m[0]
        at = m.end()
        if kind == "newline":
            out.append(Token("newline", "\n", line))
            line += 1
        elif kind == "block":
            end = _block_end(text, at)
            line += text.count("\n", at, end)
            at = end
        elif kind in ("raw", "quote"):
            end = _string_end(text, at, found, interpolation)
            out.append(Token("string", text[m.start() : end], line))
            line += text.count("\n", at, end)
            at = end
        elif kind == "tick":
            out.append(Token("word", found[1:-1], line))
        elif kind in ("word", "number", "mark"):
            out.append(Token(kind, found, line))
        elif kind == "char":
            out.append(Token("string", found, line))
    return out


_BRACE = re.compile(r"//[^\r\n]*|\#!\S[^\r\n]*|(?P<block>/\*)|(?P<raw>\"\"\")|(?P<quote>\")|'(?:\\u[0-9a-fA-F]{4}|\\.|[^'\\\r\n])'|`[^`\r\n]*`|(?P<mark>[{}])", re.S)


def braces(text: str, interpolation: str = "${") -> list[tuple[str, int]]:
    """(brace, line) of the tokens that are braces, in a text whose lines end at \\n; the others are not looked at."""
    out: list[tuple[str, int]] = []
    line, seen, at = 0, 0, 0
    while m := _BRACE.search(text, at):
        kind, at = m.lastgroup, m.end()
        if kind == "mark":
            line += text.count("\n", seen, at)
            seen = at
            out.append((m[0], line))
        elif kind == "block":
            at = _block_end(text, at)
        elif kind:
            at = _string_end(text, at, m[0], interpolation)
    return out


def _block_end(text: str, at: int) -> int:
    """After the end of a block comment; they nest."""
    depth = 1
    for m in re.compile(r"/\*|\*/").finditer(text, at):
        depth += 1 if m[0] == "/*" else -1
        if not depth:
            return m.end()
    return len(text)


def _string_end(text: str, at: int, quote: str, interpolation: str) -> int:
    depth = 0
    while at < len(text):
        if depth == 0 and text.startswith(quote, at):
            at += len(quote)
            while quote == '"""' and text.startswith('"', at):
                at += 1
            return at
        if text.startswith(interpolation, at):
            depth, at = depth + 1, at + len(interpolation)
            continue
        c = text[at]
        if c == "\\" and quote == '"':
            at += 2
            continue
        if depth:
            if c in "{(" and c == interpolation[-1]:
                depth += 1
            elif c in "})" and c == {"{": "}", "(": ")"}[interpolation[-1]]:
                depth -= 1
            elif c == '"':
                inner = '"""' if text.startswith('"""', at) else '"'
                at = _string_end(text, at + len(inner), inner, interpolation)
                continue
        elif c == "\n" and quote == '"':
            return at  # an open string ends with its line
        at += 1
    return len(text)


class Cursor:
    """A position in the tokens."""

    def __init__(self, found: list[Token]):
        self.tokens, self.at = found, 0

    def peek(self, ahead: int = 0) -> Token | None:
        k = self.at + ahead
        return self.tokens[k] if k < len(self.tokens) else None

    def text(self, ahead: int = 0) -> str:
        t = self.peek(ahead)
        return t.text if t and t.kind != "string" else ""

    def skip_newlines(self) -> None:
        while (t := self.peek()) and t.kind == "newline":
            self.at += 1

    def next_code(self, start: int) -> Token | None:
        """The first token from start on that is no newline."""
        while start < len(self.tokens) and self.tokens[start].kind == "newline":
            start += 1
        return self.tokens[start] if start < len(self.tokens) else None

    def last_line(self) -> int:
        """Line of the last code token passed."""
        k = self.at - 1
        while k > 0 and self.tokens[k].kind == "newline":
            k -= 1
        if k < 0:
            return 0
        return self.tokens[k].line + self.tokens[k].text.count("\n") * (self.tokens[k].kind == "string")

    def balanced(self, opener: str, closer: str) -> None:
        """From an opener to after its closer; strings are single tokens, so braces within do not count."""
        depth = 0
        while (t := self.peek()) is not None:
            self.at += 1
            if t.kind == "mark":
                if t.text == opener:
                    depth += 1
                elif t.text == closer:
                    depth -= 1
                    if not depth:
                        return

    def generic(self) -> None:
        """Past a type argument list, if it is one."""
        depth, start = 0, self.at
        while (t := self.peek()) is not None:
            if t.text == "<":
                depth += 1
            elif t.text == ">":
                depth -= 1
            elif t.text in ("{", "}", ";", "=") and t.kind == "mark":
                self.at = start + 1
                return
            self.at += 1
            if not depth:
                return
