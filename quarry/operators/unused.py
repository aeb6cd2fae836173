"""Imports that a file does not use, from its own text."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unused_imports(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """(path, line, symbol_name, source_module, confidence) of (path, content).

    Globs, re-exports and `_` are left out. A name counts as used if a reference or a path says it, or if it stands
    more often in the text, as a word, than imports and definitions account for. A trait may be used through its methods only.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import re

        from quarry.extract.rust import extract

        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                found = extract(content)
                said = {r["name"] for r in found.refs if r["kind"] != "reexport"} | {p for r in found.refs for p in (r["path"] or [])[:1] if r["kind"] != "reexport"}
                declared: dict[str, int] = {}
                for s in found.symbols:
                    declared[s["name"]] = declared.get(s["name"], 0) + 1
                for i in found.imports:
                    name = i["alias"] or i["name"]
                    if i["public"] or i["name"] == "*" or name == "_" or name in said:
                        continue
                    own = sum(1 for x in found.imports for n in (x["name"], x["alias"]) if n == name) + sum(x["module"].split("::").count(name) for x in found.imports)
                    if len(re.findall(rf"(?<![A-Za-z0-9_]){re.escape(name)}(?![A-Za-z0-9_])", content)) <= own + declared.get(name, 0):
                        rows.append((path, i["line"], i["name"], i["module"]))
            yield pd.DataFrame(rows, columns=["path", "line", "symbol_name", "source_module"])

    found = files.select("path", "content").mapInPandas(run, "path string, line int, symbol_name string, source_module string")
    kinds = symbols.groupBy(F.col("name").alias("symbol_name")).agg(F.bool_or(F.col("kind") == "trait").alias("trait"))
    doubt = F.coalesce("trait", F.lit(True))  # a name from outside may be a trait
    return found.join(kinds, "symbol_name", "left").select("path", "line", "symbol_name", "source_module", F.when(doubt, "maybe_trait").otherwise("definite").alias("confidence"))
