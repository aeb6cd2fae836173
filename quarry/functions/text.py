"""Scalar functions on names, paths and attribute arguments."""

from __future__ import annotations

import posixpath
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def last_segment(name: Column) -> Column:
    return F.element_at(F.split(name, "::"), -1)


def first_segment(name: Column) -> Column:
    """Up to the first :: or dot."""
    return F.get(F.split(name, r"::|\."), 0)


def is_qualified(name: Column) -> Column:
    return name.contains("::")


def full_path(module_path: Column, qualified_name: Column) -> Column:
    return F.when(module_path == "", qualified_name).otherwise(F.concat_ws("::", module_path, qualified_name))


def strip_parens(args: Column) -> Column:
    """Without one pair of outer parentheses."""
    return F.regexp_replace(args, r"(?s)^\((.*)\)$", "$1")


def word_count(text: Column, word: str) -> Column:
    """Occurrences of an identifier as a whole word."""
    return F.size(F.regexp_extract_all(text, F.lit(rf"(?<![A-Za-z0-9_]){word}(?![A-Za-z0-9_])"), 0))


def utf16_column(line: Column, column: Column) -> Column:
    """A column in bytes of UTF-8, from 1, as one in UTF-16 units, from 0."""
    before = F.substring(F.encode(line, "utf-8"), F.lit(1), column - 1).cast("string")
    return F.length(before) + F.length(F.regexp_replace(before, r"[^\x{10000}-\x{10FFFF}]", ""))


def utf16_of(line: str, column: int) -> int:
    return len(line.encode()[: column - 1].decode("utf-8", "ignore").encode("utf-16-le")) // 2


def from_utf16(line: str, units: int) -> int:
    """A column in UTF-16 units, from 0, as one in bytes of UTF-8, from 1."""
    return len(line.encode("utf-16-le")[: 2 * units].decode("utf-16-le", "ignore").encode()) + 1


def name_column(line: str, name: str, column: int) -> int:
    """The byte column of a declared name in its first line: its first whole occurrence at or after the declaration's own column."""
    data, word = line.encode(), re.escape(name.encode())
    found = re.compile(rb"(?<![A-Za-z0-9_])" + word + rb"(?![A-Za-z0-9_])").search(data, max(0, column - 1))
    return found.start() + 1 if found else column


def rounded(value: Column, digits: int = 2) -> Column:
    """Half away from zero, as a decimal text of so many digits."""
    return F.format_string(f"%.{digits}f", F.round(value, digits).cast("double"))


def bar(share: Column, width: int = 10) -> Column:
    """A share from 0 to 1 as a bar of full and light blocks."""
    full = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)) * width).cast("int")
    return F.concat(F.repeat(F.lit("█"), full), F.repeat(F.lit("░"), F.lit(width) - full))


#: What stands between the brackets of a signature's parameters, brackets within them balanced two deep.
PARAMETERS = r"^[^(]*\(((?:[^()]|\((?:[^()]|\([^()]*\))*\))*)\)"


def parameter_count(signature: Column) -> Column:
    """Parameters of a signature, self not counted: top-level commas part them."""
    inner = F.regexp_extract(signature, PARAMETERS, 1)
    for _ in range(4):  # nested brackets go from the inside out
        inner = F.regexp_replace(inner, r"\([^()]*\)|\[[^\[\]]*\]|<[^<>]*>|\{[^{}]*\}", "")
    parts = F.filter(F.transform(F.split(inner, ","), F.trim), lambda p: (p != "") & ~p.rlike(r"^(&\s*('[A-Za-z_]+\s+)?)?(mut\s+)?self(\s*:.*)?$"))
    return F.when(signature.contains("("), F.size(parts))


def returns_result(signature: Column) -> Column:
    """Whether a signature's return type, which follows the parameters with or without an arrow, is a Result."""
    return F.regexp_replace(signature, PARAMETERS + r"\s*(?:->)?\s*", "").rlike(r"^(?:[A-Za-z_][A-Za-z0-9_]*::)*[A-Za-z_]*Result\b")


def ancestors(path: Column) -> Column:
    """The folders above a path, the nearest last; the root is the empty string."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def normalise_path(path: str, root: str | None = None) -> str:
    """Relative to the root, without ./ and a/../; a path that leaves the root is given back as it is."""
    if root and path.startswith(root.rstrip("/") + "/"):
        path = path[len(root.rstrip("/")) + 1 :]
    out = posixpath.normpath(path) if path else path
    return path if out.startswith("../") or out == ".." else "" if out == "." else out


def split_arguments(args: str) -> list[str]:
    """Top-level commas part arguments; those in strings or brackets do not."""
    out, depth, quote, held, skip = [], 0, False, "", False
    for c in args:
        if quote:
            skip, quote = (not skip and c == "\\"), quote and (skip or c != '"')
        elif c == '"':
            quote = True
        elif c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
        elif c == "," and not depth:
            out.append(held.strip())
            held = ""
            continue
        held += c
    return out + [held.strip()] if held.strip() else out


def unquote(value: str) -> str | None:
    value = value.strip().removeprefix("@")
    if len(value) < 2 or value[0] != '"' or value[-1] != '"':
        return None
    out, skip = "", False
    for c in value[1:-1]:
        if c == "\\" and not skip:
            skip = True
            continue
        out += {"n": "\n", "t": "\t", "r": "\r"}.get(c, c) if skip else c
        skip = False
    return out


def deprecation(name: str, args: str | None) -> tuple[str | None, str | None]:
    """(since, note) of an attribute: key = "value" pairs, or a message as the first argument."""
    if not args:
        return None, None
    parts = split_arguments(args)
    if name == "deprecated":
        if len(parts) == 1 and "=" not in parts[0].split('"')[0]:
            return None, unquote(parts[0])
        if args.lstrip().startswith("="):
            return None, unquote(args.lstrip()[1:])
        pairs = {k.strip(): unquote(v) for k, _, v in (p.partition("=") for p in parts)}
        return pairs.get("since"), pairs.get("note")
    first = parts[0] if parts else ""
    return None, unquote(first.partition(":")[2] if first.startswith("message:") else first)


def deprecation_columns(name: Column | str, args: Column | str) -> Column:
    """A struct of since and note, in Arrow batches."""

    def parse(name: pd.Series, args: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([deprecation(n, a) for n, a in zip(name, args, strict=True)], columns=["since", "note"])

    return F.pandas_udf(parse, "struct<since:string,note:string>")(name, args)
