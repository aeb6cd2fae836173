"""Rust items, references and imports from tokens: a scanner for the shapes of declarations and uses, not a full parser."""

from __future__ import annotations

from dataclasses import dataclass, field

from quarry.extract.lexer import Places, Token, matching, tokens

# Attributes that mark a test, keywords, and what may precede an item.
TESTS = {"test", "tokio::test", "async_std::test", "rstest", "quickcheck", "proptest"}
KEYWORDS = {"as", "async", "await", "break", "const", "continue", "crate", "dyn", "else", "enum", "extern", "false", "fn", "for", "if", "impl", "in", "let", "loop", "match", "mod", "move", "mut", "pub", "ref", "return", "self", "Self", "static", "struct", "super", "trait", "true", "type", "unsafe", "use", "where", "while", "yield"}
PRIMITIVES = {"bool", "char", "str", "u8", "u16", "u32", "u64", "u128", "usize", "i8", "i16", "i32", "i64", "i128", "isize", "f32", "f64"}


@dataclass
class Found:
    symbols: list[dict] = field(default_factory=list)
    refs: list[dict] = field(default_factory=list)
    imports: list[dict] = field(default_factory=list)


class Scanner:
    """One file. Declarations are walked by recursion over brackets; bodies of functions are read for uses."""

    def __init__(self, text: str):
        self.text, self.places = text, Places(text)
        self.toks = tokens(text, "rust")
        self.close = matching(self.toks)
        self.found = Found()

    def run(self) -> Found:
        self.items(0, len(self.toks), None, None)
        return self.found

    # ------------------------------------------------------------------ helpers

    def at(self, i: int) -> str:
        return self.toks[i].text if 0 <= i < len(self.toks) else ""

    def kind(self, i: int) -> str:
        return self.toks[i].kind if 0 <= i < len(self.toks) else ""

    def skip_generics(self, i: int) -> int:
        if self.at(i) != "<":
            return i
        depth = 0
        while i < len(self.toks):
            t = self.at(i)
            if t in "([{" and i in self.close:
                i = self.close[i]
            elif t == "<":
                depth += 1
            elif t == ">":
                depth -= 1
            elif t in (";", "{"):
                return i
            i += 1
            if not depth:
                return i
        return i

    def span(self, i: int, j: int) -> dict:
        line, column = self.places.of(self.toks[i].start)
        end_line, end_column = self.places.of(self.toks[j].end)
        return {"line": line, "column": column, "end_line": end_line, "end_column": end_column}

    def symbol(self, name: str, kind: str, first: int, last: int, visibility: str, parent: str | None, attrs: list, signature: str | None = None) -> dict:
        out = {"name": name.removeprefix("r#"), "kind": kind, "visibility": visibility, "parent_name": parent, "signature": signature, **self.span(first, last)}
        out["attributes"] = [{"name": n, "args": a, "line": line} for n, a, line in attrs]
        out["is_test"] = kind in ("function", "method") and any(n in TESTS for n, _, _ in attrs)
        self.found.symbols.append(out)
        return out

    def ref(self, i: int, name: str, kind: str, path: list[str] | None, owner: dict | None) -> None:
        line, column = self.places.of(self.toks[i].start)
        self.found.refs.append({"name": name.removeprefix("r#"), "kind": kind, "path": path or None, "line": line, "column": column, "owner": (owner["line"], owner["column"], owner["end_line"], owner["end_column"]) if owner else None})

    # ------------------------------------------------------------------ items

    def attributes(self, i: int, end: int) -> tuple[list, int]:
        out = []
        while i < end and self.at(i) == "#" and (self.at(i + 1) == "[" or (self.at(i + 1) == "!" and self.at(i + 2) == "[")):
            inner = self.at(i + 1) == "!"
            a = i + 2 + inner
            b = self.close.get(a - 1, end)
            if not inner:
                out += self.attribute(a, b)
            i = b + 1
        return out, i

    def attribute(self, a: int, b: int) -> list:
        """(name, args, line) rows; what cfg_attr wraps are rows of their own."""
        if a >= b:
            return []
        i, name = a, self.at(a)
        while self.at(i + 1) == "::" and i + 2 < b:
            name += "::" + self.at(i + 2)
            i += 2
        args = None
        if self.at(i + 1) == "(" and i + 1 in self.close:
            args = self.text[self.toks[i + 1].end : self.toks[self.close[i + 1]].start]
        elif self.at(i + 1) == "=":
            args = self.text[self.toks[i + 1].end : self.toks[b].start].strip() if b < len(self.toks) else None
        rows = [(name, args, self.places.of(self.toks[a].start)[0])]
        if name == "cfg_attr" and i + 1 in self.close:
            start, j, stop = None, i + 2, self.close[i + 1]
            while j < stop:
                if self.at(j) == ",":
                    if start is not None:
                        rows += self.attribute(start, j)
                    start = j + 1
                j = self.close[j] + 1 if j in self.close else j + 1
            if start is not None:
                rows += self.attribute(start, stop)
        return rows

    def visibility(self, i: int) -> tuple[str, int]:
        if self.at(i) != "pub":
            return "private", i
        if self.at(i + 1) == "(" and i + 1 in self.close:
            word = self.at(i + 2)
            return ("crate" if word == "crate" else "module" if word in ("super", "in") else "private"), self.close[i + 1] + 1
        return "public", i + 1

    def body_end(self, i: int, end: int) -> tuple[int, int | None]:
        """From a signature on: the last token of the item and its opening brace, if it has one."""
        while i < end:
            t = self.at(i)
            if t == ";":
                return i, None
            if t == "{":
                return self.close.get(i, end - 1), i
            i = self.close[i] + 1 if t in "([" and i in self.close else i + 1
        return end - 1, None

    def items(self, i: int, end: int, parent: str | None, owner_type: str | None, method: bool = False, trait_impl: tuple | None = None) -> None:
        while i < end:
            attrs, i = self.attributes(i, end)
            if i >= end:
                return
            first = i
            visibility, i = self.visibility(i)
            while self.at(i) in ("default", "async", "unsafe", "extern") or (self.at(i) == "const" and self.at(i + 1) in ("fn", "unsafe", "async", "extern")) or (self.kind(i) == "string" and self.at(i - 1) == "extern"):
                if self.at(i) == "unsafe" and self.at(i + 1) == "{":
                    break
                i += 1
            word, name = self.at(i), self.at(i + 1)
            if word == "fn" and self.kind(i + 1) == "ident":
                i = self.function(first, i, end, visibility, attrs, parent, method, trait_impl)
            elif word == "struct" and self.kind(i + 1) == "ident":
                i = self.struct(first, i, end, visibility, attrs)
            elif word == "enum" and self.kind(i + 1) == "ident":
                i = self.enum(first, i, end, visibility, attrs)
            elif word == "trait" and self.kind(i + 1) == "ident":
                i = self.trait(first, i, end, visibility, attrs)
            elif word == "impl":
                i = self.impl(i, end)
            elif word == "mod" and self.kind(i + 1) == "ident":
                last, brace = self.body_end(i + 2, end)
                self.symbol(name, "module", first, last, visibility, None, attrs)
                if brace is not None:
                    self.items(brace + 1, last, None, None)
                i = last + 1
            elif word in ("const", "static", "type") and (self.kind(i + 1) == "ident"):
                shift = 1 if name == "mut" else 0
                last = i
                while last < end and self.at(last) != ";":
                    last = self.close[last] + 1 if last in self.close else last + 1
                last = min(last, end - 1)
                kind = "type_alias" if word == "type" else word
                if self.at(i + 1 + shift) != "_" and not (method and word == "type"):
                    self.symbol(self.at(i + 1 + shift), kind, first, last, visibility, parent if method else None, attrs)
                if word == "type":
                    self.types(self.skip_generics(i + 2), last, None)
                else:
                    self.uses(i + 2 + shift, last, None, None, set())
                i = last + 1
            elif word == "use":
                i = self.use(i + 1, end, visibility != "private", first)
            elif word == "macro_rules" and self.at(i + 1) == "!":
                last = self.close.get(i + 3, i + 3)
                self.symbol(self.at(i + 2), "macro", first, last, "public", None, attrs)
                i = last + 1
            elif self.kind(i) == "ident" and name == "!":
                self.macro(i, None, set())
                i = self.close.get(i + 2, i + 2) + 1
            else:
                i = self.close[i] + 1 if i in self.close else i + 1

    def function(self, first, i, end, visibility, attrs, parent, method, trait_impl) -> int:
        name = self.at(i + 1)
        params = self.skip_generics(i + 2)
        stop = self.close.get(params, params)
        last, brace = self.body_end(stop + 1, end)
        tail = brace if brace is not None else last
        returns = ""
        if self.at(stop + 1) == "->":
            k = stop + 2
            while k < tail and self.at(k) != "where":
                k += 1
            returns = " " + self.text[self.toks[stop + 2].start : self.toks[k - 1].end] if k > stop + 2 else ""
        signature = f"fn {name}{self.text[self.toks[params].start : self.toks[stop].end]}{returns}" if params in self.close else None
        own = self.symbol(name, "method" if method else "function", first, last, visibility, parent, attrs, signature)
        if trait_impl:
            self.ref(trait_impl[0], trait_impl[1], "inherit", [trait_impl[2]], own)
        self.types(params, tail, own)
        if brace is not None:
            bound = self.bindings(params + 1, stop) | self.bindings(brace + 1, last)
            self.uses(brace + 1, last, own, parent, bound, self.local_types(params + 1, last))
        return last + 1

    def fields(self, a: int, b: int, parent: str) -> None:
        i = a
        while i < b:
            attrs, i = self.attributes(i, b)
            first = i
            visibility, i = self.visibility(i)
            stop = i
            while stop < b and self.at(stop) != ",":
                stop = self.close[stop] + 1 if stop in self.close else self.skip_generics(stop) if self.at(stop) == "<" else stop + 1
            if i + 1 < b and self.at(i + 1) == ":" and self.kind(i) == "ident":
                text = self.text[self.toks[i + 2].start : self.toks[stop - 1].end] if stop > i + 2 else None
                self.symbol(self.at(i), "struct_field", first, stop - 1, visibility, parent, attrs, text)
                self.types(i + 2, stop, None)
            i = stop + 1

    def tuple_fields(self, a: int, b: int, parent: str) -> None:
        i, n = a, 0
        while i < b:
            attrs, i = self.attributes(i, b)
            first = i
            visibility, i = self.visibility(i)
            stop = i
            while stop < b and self.at(stop) != ",":
                stop = self.close[stop] + 1 if stop in self.close else self.skip_generics(stop) if self.at(stop) == "<" else stop + 1
            if stop > i:
                self.symbol(str(n), "struct_field", first, stop - 1, visibility, parent, attrs, self.text[self.toks[i].start : self.toks[stop - 1].end])
                self.types(i, stop, None)
                n += 1
            i = stop + 1

    def struct(self, first, i, end, visibility, attrs) -> int:
        name = self.at(i + 1)
        k = self.skip_generics(i + 2)
        last, brace = self.body_end(k, end)
        self.symbol(name, "struct", first, last, visibility, None, attrs)
        if brace is not None:
            self.fields(brace + 1, last, name)
        elif self.at(k) == "(" and k in self.close:
            self.tuple_fields(k + 1, self.close[k], name)
        return last + 1

    def enum(self, first, i, end, visibility, attrs) -> int:
        name = self.at(i + 1)
        last, brace = self.body_end(self.skip_generics(i + 2), end)
        self.symbol(name, "enum", first, last, visibility, None, attrs)
        k = brace + 1 if brace is not None else last
        while k < last:
            own, k = self.attributes(k, last)
            if self.kind(k) != "ident":
                k += 1
                continue
            body = k + 1 if self.at(k + 1) in ("{", "(") and k + 1 in self.close else None
            stop = self.close[body] if body else k
            text = self.text[self.toks[body].start : self.toks[stop].end] if body else None
            tail = stop
            while tail + 1 < last and self.at(tail + 1) != ",":
                tail = self.close[tail + 1] if tail + 1 in self.close else tail + 1
            self.symbol(self.at(k), "enum_variant", k, tail, "public", name, own, text)
            if body and self.at(body) == "{":
                self.fields(body + 1, stop, f"{name}::{self.at(k)}")
            elif body:
                self.tuple_fields(body + 1, stop, f"{name}::{self.at(k)}")
            k = tail + 2
        return last + 1

    def trait(self, first, i, end, visibility, attrs) -> int:
        name = self.at(i + 1)
        k = self.skip_generics(i + 2)
        last, brace = self.body_end(k, end)
        own = self.symbol(name, "trait", first, last, visibility, None, attrs)
        if self.at(k) == ":":
            stop = brace if brace is not None else last
            j = k + 1
            while j < stop and self.at(j) != "where":
                if self.kind(j) == "ident" and self.at(j) not in KEYWORDS and self.at(j + 1) != "::":
                    path = self.path_before(j)
                    self.ref(j, self.at(j), "inherit", path, own)
                    j = self.skip_generics(j + 1)
                else:
                    j += 1
        if brace is not None:
            j = brace + 1
            while j < last:
                if self.at(j) == "fn":
                    p = self.skip_generics(j + 2)
                    stop, body = self.body_end(self.close.get(p, p) + 1, last)
                    self.types(p, body if body is not None else stop, None)
                    if body is not None:
                        self.uses(body + 1, stop, None, None, self.bindings(p, stop))
                    j = stop + 1
                else:
                    j += 1
        return last + 1

    def impl(self, i: int, end: int) -> int:
        k = self.skip_generics(i + 1)
        last, brace = self.body_end(k, end)
        stop = brace if brace is not None else last
        where = next((j for j in range(k, stop) if self.at(j) == "where"), stop)
        split = next((j for j in range(k, where) if self.at(j) == "for" and self.at(j + 1) != "<"), None)
        target = self.type_name(split + 1 if split is not None else k, where)
        trait = None
        if split is not None and target:
            j = self.type_at(k, split)
            if j is not None:
                trait = (j, self.at(j), target[1])
                self.ref(j, self.at(j), "inherit", [target[1]], None)
                self.found.refs[-1]["anchor"] = target[1]
        if target:
            self.types(split + 1 if split is not None else k, where, None)
        if brace is not None:
            self.items(brace + 1, last, target[1] if target else None, None, method=True, trait_impl=trait)
        return last + 1

    def type_at(self, a: int, b: int) -> int | None:
        """The last path segment of the first type in a range."""
        j = a
        while j < b:
            if self.kind(j) == "ident" and (self.at(j) not in KEYWORDS or self.at(j) == "crate"):
                while self.at(j + 1) == "::" and self.kind(j + 2) == "ident":
                    j += 2
                return j
            j += 1
        return None

    def type_name(self, a: int, b: int) -> tuple[int, str] | None:
        j = self.type_at(a, b)
        return None if j is None else (j, self.at(j))

    def path_before(self, j: int) -> list[str]:
        out: list[str] = []
        while self.at(j - 1) == "::" and (self.kind(j - 2) == "ident" or self.at(j - 2) == ">"):
            if self.at(j - 2) == ">":
                break
            out.insert(0, self.at(j - 2))
            j -= 2
        return out

    # ------------------------------------------------------------------ imports

    def use(self, i: int, end: int, public: bool, first: int) -> int:
        stop = i
        while stop < end and self.at(stop) != ";":
            stop += 1
        leaves: list[tuple[list[str], str, str | None, int]] = []
        self.use_tree(i, stop, [], leaves, grouped=False)
        line, _ = self.places.of(self.toks[first].start)
        for module, name, alias, at in leaves:
            self.found.imports.append({"module": "::".join(module), "name": name, "alias": alias, "line": line, "public": public})
            if public and name != "*":
                self.ref(first, name, "reexport", None, None)  # stands where the declaration begins, by its bare name
        return stop + 1

    def use_tree(self, i: int, end: int, prefix: list[str], out: list, grouped: bool) -> None:
        path, k = list(prefix), i
        while k < end:
            t = self.at(k)
            if t == "{":
                stop, a = self.close.get(k, end), k + 1
                while a < stop:
                    b = a
                    while b < stop and self.at(b) != ",":
                        b = self.close[b] + 1 if b in self.close else b + 1
                    self.use_tree(a, b, path, out, grouped=True)
                    a = b + 1
                return
            if t == "*":
                out.append((path, "*", None, k))
                return
            if self.kind(k) == "ident":
                if self.at(k + 1) == "::":
                    path.append(t)
                    k += 2
                    continue
                alias = self.at(k + 2) if self.at(k + 1) == "as" and not grouped else None  # aliases in groups are dropped
                if t == "self" and path:
                    out.append((path[:-1], path[-1], alias, k))
                elif path:
                    out.append((path, t, alias, k))
                else:
                    out.append(([t], "*", alias, k))
                return
            k += 1

    # ------------------------------------------------------------------ uses

    def bindings(self, a: int, b: int) -> set[str]:
        """Names that a body binds anywhere: let patterns, parameters, closures, loops and match arms."""
        out: set[str] = set()
        for j in range(a, b):
            if self.kind(j) == "ident" and self.at(j) not in KEYWORDS:
                before, after = self.at(j - 1), self.at(j + 1)
                if before in ("let", "mut", "ref", "|") or (after == ":" and self.at(j + 2) != ":" and before in ("(", ",", "|")) or (before == "for" and after == "in"):
                    out.add(self.at(j))
        j = a
        while j < b:
            if self.at(j) == "let":
                k = j + 1
                while k < b and self.at(k) not in ("=", ";", ":"):
                    if self.kind(k) == "ident" and self.at(k) not in KEYWORDS and self.at(k)[0].islower():
                        out.add(self.at(k))
                    k += 1
                j = k
            j += 1
        return out

    def local_types(self, a: int, b: int) -> dict[str, str]:
        """Types of names that are bound once, with an annotation."""
        seen: dict[str, list[str]] = {}
        for j in range(a, b - 2):
            if self.kind(j) == "ident" and self.at(j + 1) == ":" and self.at(j - 1) in ("let", "mut", "(", ",", "|"):
                t = j + 2
                while self.at(t) in ("&", "mut") or self.kind(t) == "life":
                    t += 1
                k = self.type_at(t, min(b, t + 8))
                seen.setdefault(self.at(j), []).append(self.at(k) if k is not None else "")
            elif self.at(j) == "let" or (self.at(j) == "mut" and self.at(j - 1) == "let"):
                k = j + 1 + (self.at(j + 1) == "mut")
                if self.kind(k) == "ident" and self.at(k + 1) != ":":
                    seen.setdefault(self.at(k), []).append("")
        return {n: t[0] for n, t in seen.items() if len(t) == 1 and t[0]}

    def types(self, a: int, b: int, owner: dict | None) -> None:
        """Type identifiers of a signature or a field."""
        for j in range(a, b):
            t = self.at(j)
            if self.kind(j) == "ident" and t not in KEYWORDS and t not in PRIMITIVES and self.at(j + 1) not in ("::", ":") and t[0].isupper():
                self.ref(j, t, "type", None, owner)

    def macro(self, i: int, owner: dict | None, bound: set[str]) -> int:
        """A macro's name, and bare calls among its tokens."""
        self.ref(i, self.at(i), "macro", self.path_before(i), owner)
        stop = self.close.get(i + 2, i + 2)
        for j in range(i + 3, stop):
            if self.kind(j) == "ident" and self.at(j + 1) == "(" and self.at(j - 1) not in (".", "::", "fn") and self.at(j) not in KEYWORDS and self.at(j) not in bound:
                self.ref(j, self.at(j), "macro_call", None, owner)
        return stop + 1

    def uses(self, a: int, b: int, owner: dict | None, self_type: str | None, bound: set[str], known: dict[str, str] | None = None) -> None:
        known = known or {}
        i = a
        while i < b:
            t, kind = self.at(i), self.kind(i)
            if t == "fn" and self.kind(i + 1) == "ident":  # a nested function is no symbol; its uses have no owner
                p = self.skip_generics(i + 2)
                last, brace = self.body_end(self.close.get(p, p) + 1, b)
                self.types(p, brace if brace is not None else last, None)
                if brace is not None:
                    self.uses(brace + 1, last, None, None, self.bindings(p, last), self.local_types(p, last))
                i = last + 1
                continue
            if t == "use":
                i = self.use(i + 1, b, False, i)
                continue
            if kind != "ident" or (t in KEYWORDS and t not in ("Self", "self", "crate", "super")):
                i += 1
                continue
            if self.at(i + 1) == "::" and (self.kind(i + 2) == "ident"):
                i += 2
                continue
            if self.at(i + 1) == "!" and self.at(i + 2) in ("(", "[", "{") and t not in KEYWORDS:
                i = self.macro(i, owner, bound)
                continue
            after = i + 1
            if self.at(after) == "::" and self.at(after + 1) == "<":
                after = self.skip_generics(after + 1)
            path = self.path_before(i)
            start = i - 2 * len(path)
            if self.at(start - 1) == ".":
                if self.at(after) == "(":
                    receiver = self.at(start - 2)
                    lone = self.kind(start - 2) == "ident" and self.at(start - 3) not in (".", "::")
                    of = self_type if receiver == "self" and lone else known.get(receiver) if lone else None
                    self.ref(i, t, "method", [of] if of else None, owner)
            elif self.at(after) == "(" and t not in KEYWORDS:
                self.ref(start, t, "call", path, owner)  # a path's place is that of its first part
            elif self.at(after) == "{" and t[0].isupper() and self.literal(i, start):
                self.ref(start, t, "construct", path, owner)
            elif t[0].isupper() and t not in KEYWORDS and not path and (self.at(i - 1) in (":", "<", "as", "&", "->", ",", "mut", "dyn", "impl", "for") or self.at(after) in (">",)) and len(t) > 1:
                self.ref(i, t, "type", None, owner)
            elif path and path[-1][0].isupper() and t[0].islower() is False:
                pass
            elif t not in KEYWORDS and t not in bound and not path and self.value_place(i):
                self.ref(i, t, "value", None, owner)
            i += 1

    def literal(self, i: int, start: int) -> bool:
        before = self.at(start - 1)
        return before not in ("match", "if", "while", "in", "for", "impl", "struct", "enum", "trait", "->", "union")

    def value_place(self, i: int) -> bool:
        """An argument, what a let binds, or what is returned."""
        before, after = self.at(i - 1), self.at(i + 1)
        return (before in ("(", ",") and after in (",", ")")) or (before == "=" and after == ";") or (before == "return" and after == ";")


def extract(text: str) -> Found:
    return Scanner(text).run()


__all__ = ["Found", "Scanner", "Token", "extract"]
