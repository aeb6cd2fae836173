"""C# declarations, references and usings from tokens: a scanner for their shapes, not a full parser."""

from __future__ import annotations

import re

from quarry.extract.lexer import Places, matching, tokens
from quarry.extract.rust import Found

# Attributes that mark a test, modifiers, keywords.
TESTS = {"Test", "TestMethod", "Fact", "Theory", "TestCase"}
MODIFIERS = {"public", "private", "protected", "internal", "static", "sealed", "abstract", "virtual", "override", "readonly", "const", "async", "partial", "new", "extern", "unsafe", "volatile", "required", "ref", "file"}
TYPES = {"class": "class", "record": "class", "struct": "struct", "interface": "interface", "enum": "enum"}
KEYWORDS = {"if", "else", "for", "foreach", "while", "do", "switch", "case", "return", "new", "this", "base", "using", "var", "typeof", "nameof", "sizeof", "default", "throw", "try", "catch", "finally", "lock", "is", "as", "in", "out", "ref", "await", "null", "true", "false", "break", "continue", "when", "where", "get", "set", "yield", "checked", "unchecked", "fixed", "stackalloc"}


def visibility(words: set[str]) -> str:
    if "public" in words:
        return "public"
    if "protected" in words and "internal" in words:
        return "crate"
    if "protected" in words:
        return "module"
    return "crate" if "internal" in words else "private"


def is_test(names: list[str]) -> bool:
    return any(n.split(".")[-1].removesuffix("Attribute") in TESTS for n in names)


class Scanner:
    def __init__(self, text: str):
        self.text, self.places = text, Places(text)
        self.toks = tokens(text, "csharp")
        self.close = matching(self.toks)
        self.opened: dict[int, int] | None = None
        self.found = Found()

    def run(self) -> Found:
        self.members(0, len(self.toks), None)
        return self.found

    def at(self, i: int) -> str:
        return self.toks[i].text if 0 <= i < len(self.toks) else ""

    def kind(self, i: int) -> str:
        return self.toks[i].kind if 0 <= i < len(self.toks) else ""

    def symbol(self, name, kind, first, last, words, parent, attrs, signature=None, public=False) -> dict:
        line, column = self.places.of(self.toks[first].start)
        end_line, end_column = self.places.of(self.toks[last].end)
        out = {"name": name, "kind": kind, "visibility": "public" if public else visibility(words), "parent_name": parent, "signature": signature, "line": line, "column": column, "end_line": end_line, "end_column": end_column}
        out["attributes"] = [{"name": n, "args": a, "line": at} for n, a, at in attrs]
        out["is_test"] = kind in ("function", "method") and is_test([n for n, _, _ in attrs])
        self.found.symbols.append(out)
        return out

    def ref(self, i, name, kind, path, owner) -> None:
        line, column = self.places.of(self.toks[i].start)
        self.found.refs.append({"name": name, "kind": kind, "path": path or None, "line": line, "column": column, "owner": (owner["line"], owner["column"], owner["end_line"], owner["end_column"]) if owner else None})

    def skip_generics(self, i: int) -> int:
        if self.at(i) != "<":
            return i
        depth, j = 0, i
        while j < len(self.toks):
            t = self.at(j)
            depth += (t == "<") - (t == ">")
            if t in (";", "{", "}") or (t == "(" and j not in self.close):
                return i
            j = self.close[j] + 1 if t in "([" and j in self.close else j + 1
            if not depth:
                return j
        return i

    def attributes(self, i: int, end: int) -> tuple[list, int]:
        out = []
        while i < end and self.at(i) == "[" and i in self.close:
            a, b = i + 1, self.close[i]
            if self.at(a + 1) == ":" and self.kind(a) == "ident":
                a += 2
            while a < b:
                stop = a
                while stop < b and self.at(stop) != ",":
                    stop = self.close[stop] + 1 if stop in self.close else stop + 1
                k = a
                while k + 1 < stop and self.at(k + 1) in (".", "::"):
                    k += 2
                args = self.text[self.toks[k + 1].end : self.toks[self.close[k + 1]].start] if self.at(k + 1) == "(" and k + 1 in self.close else None
                if self.kind(a) == "ident":
                    out.append(("".join(self.at(x) for x in range(a, k + 1)), args, self.places.of(self.toks[a].start)[0]))
                a = stop + 1
            i = b + 1
        return out, i

    def members(self, i: int, end: int, parent: str | None, container: dict | None = None) -> None:
        while i < end:
            attrs, i = self.attributes(i, end)
            first, words = i, set()
            while self.at(i) in MODIFIERS and i < end:
                words.add(self.at(i))
                i += 1
            if i >= end:
                return
            t = self.at(i)
            if t == "global" and self.at(i + 1) == "using":
                i += 1
                t = "using"
            if t == "using" and parent is None:
                i = self.using(i, end)
            elif t == "namespace":
                i = self.namespace(first, i, end)
            elif t in TYPES and (self.kind(i + 1) == "ident"):
                i = self.type(first, i, end, words, parent, attrs)
            elif t == "delegate":
                stop = self.until(i, end, ";")
                name = next((k for k in range(stop, i, -1) if self.at(k) == "(" and k in self.close), None)
                if name:
                    j = name - 1
                    self.symbol(self.at(j), "delegate", first, stop, words, parent, attrs)
                i = stop + 1
            elif t == "event":
                i = self.event(first, i, end, words, parent, attrs)
            elif parent is None and container is None:
                i = self.close[i] + 1 if i in self.close else i + 1
            else:
                i = self.member(first, i, end, words, parent, attrs)

    def until(self, i: int, end: int, mark: str) -> int:
        while i < end and self.at(i) != mark:
            i = self.close[i] + 1 if i in self.close else i + 1
        return min(i, end - 1)

    def using(self, i: int, end: int) -> int:
        stop = self.until(i, end, ";")
        parts = [self.at(k) for k in range(i + 1, stop)]
        alias = None
        if "=" in parts:
            alias, parts = parts[0] if parts[0] != "static" else parts[1], parts[parts.index("=") + 1 :]
        name = "".join(p for p in parts if p not in ("static", "unsafe"))
        self.found.imports.append({"module": name, "name": "*", "alias": alias, "line": self.places.of(self.toks[i].start)[0], "public": False})
        return stop + 1

    def namespace(self, first: int, i: int, end: int) -> int:
        k = i + 1
        while self.kind(k) == "ident" or self.at(k) == ".":
            k += 1
        name = "".join(self.at(x) for x in range(i + 1, k))
        if self.at(k) == "{":
            stop = self.close.get(k, end - 1)
            self.symbol(name, "module", first, stop, set(), None, [], public=True)
            self.members(k + 1, stop, None)
            return stop + 1
        self.symbol(name, "module", first, min(k, end - 1), set(), None, [], public=True)
        return k + 1

    def type(self, first: int, i: int, end: int, words, parent, attrs) -> int:
        kind = TYPES[self.at(i)]
        if self.at(i) == "record" and self.at(i + 1) in ("class", "struct"):
            kind, i = TYPES[self.at(i + 1)], i + 1
        name = self.at(i + 1)
        k = self.skip_generics(i + 2)
        if self.at(k) == "(" and k in self.close:
            k = self.close[k] + 1
        brace = k
        while brace < end and self.at(brace) not in ("{", ";"):
            brace = self.close[brace] + 1 if brace in self.close else brace + 1
        stop = self.close.get(brace, min(brace, end - 1))
        own = self.symbol(name, kind, first, stop, words, parent, attrs)
        if self.at(k) == ":" and kind != "enum":
            j = k + 1
            while j < brace and self.at(j) != "where":
                if self.kind(j) == "ident":
                    a = j
                    while self.at(j + 1) == "." and self.kind(j + 2) == "ident":
                        j += 2
                    self.ref(j, self.at(j), "inherit", [self.at(x) for x in range(a, j, 2)], None)
                    self.found.refs[-1]["anchor"] = name
                    self.found.refs[-1]["owner"] = (own["line"], own["column"], own["end_line"], own["end_column"])
                    j = self.skip_generics(j + 1)
                else:
                    j = self.close[j] + 1 if j in self.close else j + 1
        if self.at(brace) == "{" and kind != "enum":
            self.members(brace + 1, stop, name, own)
        return stop + 1

    def event(self, first, i, end, words, parent, attrs) -> int:
        k = i + 1
        while k < end and self.at(k) not in (";", "{", "="):
            k = self.skip_generics(k) if self.at(k) == "<" and self.skip_generics(k) > k else k + 1
        if self.at(k) == "{":
            stop = self.close.get(k, end - 1)
            own = self.symbol(self.at(k - 1), "event", first, stop, words, parent, attrs)
            self.uses(k + 1, stop, own)
            return stop + 1
        stop = self.until(i, end, ";")
        self.declarators(i + 1, stop, "event", words, parent, attrs)
        return stop + 1

    def declarators(self, a, b, kind, words, parent, attrs) -> None:
        """One symbol for each name of a list of fields."""
        k, depth = a, 0
        while k < b:
            t = self.at(k)
            depth += (t == "<") - (t == ">")
            if self.kind(k) == "ident" and depth <= 0 and self.at(k + 1) in (",", ";", "=") and k > a:
                stop = k
                if self.at(k + 1) == "=":
                    while stop < b and self.at(stop) != ",":
                        stop = self.close[stop] + 1 if stop in self.close else stop + 1
                    stop = min(stop, b) - 1
                    self.uses(k + 2, stop + 1, None)
                self.symbol(self.at(k), kind, k, max(stop, k), words, parent, attrs)
                k = stop
            k = self.close[k] + 1 if k in self.close else k + 1

    def member(self, first, i, end, words, parent, attrs) -> int:
        """A method, constructor, property or field, told by what follows its name."""
        k = i
        while k < end:
            t = self.at(k)
            if t == "(" and k in self.close and self.kind(k - 1) == "ident" or (t == "(" and self.at(k - 1) == ">" and k in self.close):
                return self.method(first, i, k, end, words, parent, attrs)
            if t in ("{", "=>") and self.kind(k - 1) == "ident" and k > i:
                stop = self.close.get(k, end - 1) if t == "{" else self.until(k, end, ";")
                if t == "{" and self.at(stop + 1) == "=":
                    stop = self.until(stop + 1, end, ";")
                own = self.symbol(self.at(k - 1), "property", first, stop, words, parent, attrs)
                self.uses(k + 1, stop, own)
                return stop + 1
            if t in ("=", ";", ",") and self.kind(k - 1) == "ident" and k - 1 > i:
                stop = self.until(k, end, ";")
                self.declarators(i, stop, "struct_field", words, parent, attrs)
                return stop + 1
            if t == "<" and (skip := self.skip_generics(k)) > k:
                k = skip
                continue
            if t in ("}", ";"):
                return k + 1
            k = self.close[k] + 1 if k in self.close else k + 1
        return end

    def method(self, first, i, k, end, words, parent, attrs) -> int:
        name_at = k - 1
        if self.at(name_at) == ">":
            depth, name_at = 1, name_at - 1
            while depth and name_at > i:
                depth += (self.at(name_at) == ">") - (self.at(name_at) == "<")
                name_at -= 1
        name = self.at(name_at)
        stop = self.close[k]
        j = stop + 1
        while j < end and self.at(j) not in ("{", ";", "=>"):
            j = self.close[j] + 1 if j in self.close else j + 1
        last = self.close.get(j, end - 1) if self.at(j) == "{" else self.until(j, end, ";")
        params = self.text[self.toks[k].start : self.toks[stop].end]
        returns = self.text[self.toks[i].start : self.toks[name_at - 1].end] if name_at > i else ""
        constructor = name_at == i and name == parent
        kind = "method" if constructor or "static" not in words else "function"
        own = self.symbol(name, kind, first, last, words, parent, attrs, f"{name}{params}" if constructor else f"{returns or 'void'} {name}{params}")
        self.uses(stop + 1, last, own)
        return last + 1

    def begin(self, i: int) -> int:
        """Where the expression begins whose last token is at i: the parts before a bracket's opening, and new."""
        if self.opened is None:
            self.opened = {b: a for a, b in self.close.items()}
        while self.at(i) in (")", "]") and i in self.opened:
            i = self.opened[i] - 1
            while self.kind(i) == "ident" and self.at(i - 1) == "." and self.kind(i - 2) == "ident":
                i -= 2
            if self.at(i - 1) == "new":
                return i - 1
            if self.at(i - 1) != ".":
                return i
            i -= 3 if self.at(i - 2) == "?" else 2
        return i

    def uses(self, a: int, b: int, owner: dict | None) -> None:
        i = a
        while i < b:
            t = self.at(i)
            if t == "new" and self.kind(i + 1) == "ident":
                j = i + 1
                while self.at(j + 1) == "." and self.kind(j + 2) == "ident":
                    j += 2
                self.ref(j, self.at(j), "construct", [self.at(x) for x in range(i + 1, j, 2)], owner)
                i = j + 1
                continue
            member = self.at(i - 1) == "."  # of what a call, a creation or an index gives, which names no path
            if self.kind(i) != "ident" or (t in KEYWORDS and t not in ("this", "base")) or (member and self.at(i - 3 if self.at(i - 2) == "?" else i - 2) not in (")", "]")):
                i += 1
                continue
            chain, j = [i], i
            place = self.begin(i - 3 if self.at(i - 2) == "?" else i - 2) if member else i  # a path stands where its first part does
            while self.at(j + 1) in (".", "?") and (self.at(j + 1) == "." or self.at(j + 2) == "."):
                j += 2 if self.at(j + 1) == "." else 3
                if self.kind(j) != "ident":
                    break
                chain.append(j)
            names = [self.at(x) for x in chain]
            after = self.skip_generics(chain[-1] + 1)
            if self.at(after) == "(":
                path = [n for n in names[:-1] if n not in ("this", "base")]
                if names[-1] not in KEYWORDS:
                    self.ref(place, names[-1], "call", path, owner)
            else:
                for n in range(0 if member else 1, len(names)):
                    self.ref(place, names[n], "field_access", names[:n], owner)
            i = chain[-1] + 1


def extract(text: str) -> Found:
    return Scanner(re.sub("^﻿", "", text)).run()
