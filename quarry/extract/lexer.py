"""Tokens of Rust and C# text with byte positions; comments are dropped, strings and characters are one token each."""

from __future__ import annotations

import re
from dataclasses import dataclass


@dataclass(slots=True)
class Token:
    kind: str  # ident, number, string, char, life, op
    text: str
    start: int  # in characters
    end: int


_IDENT = r"[A-Za-z_\u0080-\U0010ffff][A-Za-z0-9_\u0080-\U0010ffff]*"
_COMMON = [
    ("number", r"\d[A-Za-z0-9_]*(?:\.\d[A-Za-z0-9_]*)?"),
    ("op", r"::|->|=>|==|!=|<=|>=|&&|\|\||\.\.=|\.\.\.|\.\.|[-+*/%^&|]=|<<=|[^\sA-Za-z0-9_]"),
]
_RUST = [
    ("skip", r"//[^\n]*"),
    ("raw", r"(?:br|cr|r)(#*)\""),
    ("string", r"[bc]?\"(?:\\.|[^\"\\])*\""),
    ("char", r"b?'(?:\\(?:x[0-9a-fA-F]{2}|u\{[0-9a-fA-F_]*\}|.)|[^'\\\n])'"),
    ("life", rf"'{_IDENT}"),
    ("ident", rf"r#{_IDENT}|{_IDENT}"),
    *_COMMON,
]
_CSHARP = [
    ("skip", r"//[^\n]*|#[^\n]*"),
    ("block", r"/\*.*?\*/"),
    ("string", r'\$*""".*?"""|(?:\$@|@\$|@)"(?:""|[^"])*"|\$?"(?:\\.|[^"\\\n])*"'),
    ("char", r"'(?:\\.[0-9a-fA-F]*|[^'\\\n])'"),
    ("ident", rf"@?{_IDENT}"),
    *_COMMON,
]


def _compile(rules: list[tuple[str, str]]) -> re.Pattern:
    return re.compile("|".join(f"(?P<{name}>{rule})" for name, rule in rules), re.S)


_PATTERNS = {"rust": _compile(_RUST), "csharp": _compile(_CSHARP)}


def tokens(text: str, language: str) -> list[Token]:
    out: list[Token] = []
    pattern, at, size = _PATTERNS[language], 0, len(text)
    while at < size:
        if text[at].isspace():
            at += 1
            continue
        if language == "rust" and text.startswith("/*", at):  # block comments nest
            depth, at = 1, at + 2
            while depth and at < size:
                if text.startswith("/*", at):
                    depth, at = depth + 1, at + 2
                elif text.startswith("*/", at):
                    depth, at = depth - 1, at + 2
                else:
                    at += 1
            continue
        m = pattern.match(text, at)
        if m is None:
            at += 1
            continue
        kind, end = m.lastgroup, m.end()
        if m.group("raw") if language == "rust" else None:
            kind = "string"
            close = '"' + "#" * m.group("raw").count("#")
            found = text.find(close, end)
            end = size if found < 0 else found + len(close)
        elif kind not in ("skip", "block", "string", "char", "life", "ident", "number", "op"):
            kind = "string"
        if kind not in ("skip", "block"):
            out.append(Token(kind, text[at:end], at, end))
        at = end
    return out


class Places:
    """Lines and byte columns, from 1, of character positions."""

    def __init__(self, text: str):
        self.text = text
        self.starts = [0] + [m.end() for m in re.finditer("\n", text)]

    def of(self, at: int) -> tuple[int, int]:
        from bisect import bisect_right

        line = bisect_right(self.starts, at)
        return line, len(self.text[self.starts[line - 1] : at].encode()) + 1


def matching(toks: list[Token]) -> dict[int, int]:
    """The place of the closing token of each opening bracket (parentheses, brackets, braces)."""
    out, stack = {}, []
    pairs = {")": "(", "]": "[", "}": "{"}
    for i, t in enumerate(toks):
        if t.kind != "op":
            continue
        if t.text in "([{":
            stack.append(i)
        elif t.text in pairs:
            while stack:
                j = stack.pop()
                if toks[j].text == pairs[t.text]:
                    out[j] = i
                    break
    return out
