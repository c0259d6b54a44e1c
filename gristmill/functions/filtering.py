"""The row-wise work of the filter chain for whole Arrow batches: each text is read once, whatever the chain asks of it.

The same rules as the Column expressions of gristmill.functions.text; tests compare the two.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from gristmill.functions import text as T

STEPS = "array<struct<ok:boolean,digest:string>>"


class Rules:
    """Compiled once per task."""

    def __init__(self) -> None:
        self.line_end = re.compile(T.LINE_END)
        self.line = re.compile("|".join(f"(?:{p})" for p in T.BOILERPLATE).replace(r"[\p{L}\p{N}_]", r"\w"), re.I)
        self.blank_lines = re.compile("\n{3,}")
        self.personal = [re.compile(p) for p in T.PERSONAL]
        self.word = re.compile("[a-z']+")
        self.english = frozenset(T.ENGLISH)

    def digest(self, text: str) -> str:
        return hashlib.sha1(" ".join(text.lower().split()).encode("utf-8", "surrogatepass")).hexdigest()

    def is_english(self, text: str) -> bool:
        words = self.word.findall(text.lower())
        return len(words) < T.ENGLISH_TOKENS or sum(map(self.english.__contains__, words)) / len(words) >= T.ENGLISH_RATIO

    def clean(self, text: str) -> str:
        folded = text.casefold()
        if any(w in folded for w in T.BOILERPLATE_MARKS):
            whole = "\n".join(x for x in self.line_end.split(text) if not self.line.search(x))
        else:
            whole = self.line_end.sub("\n", text)
        return self.blank_lines.sub("\n\n", whole).strip()

    def redacted(self, text: str) -> str:
        for pattern in self.personal:
            text = pattern.sub(T.REDACTED, text)
        return text

    def steps(self, text: str, chain: list[str]) -> list[dict]:
        """Of each filter of a chain: whether the text passes it by itself, or the digest under which dedup looks for copies."""
        out = []
        for name in chain:
            ok, digest = True, None
            if name == "dedup":
                ok, digest = None, self.digest(text)
            elif name == "language":
                ok = self.is_english(text)
            elif name == "boilerplate":
                text = self.clean(text)
                ok = len(text) >= T.LEAST_CHARS
            elif name == "pii":
                text = self.redacted(text)
            out.append({"ok": ok, "digest": digest})
        return out


def with_steps(rows: DataFrame, keep: list[str], chain: str, text: str = "text") -> DataFrame:
    """The columns to keep and steps: what each filter named in the array column chain makes of the text. Null texts count as empty."""
    import pyspark.sql.types as S

    schema = S.StructType([rows.schema[c] for c in keep] + [S.StructField("steps", S._parse_datatype_string(STEPS))])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules, kind = Rules(), pa.list_(pa.struct([("ok", pa.bool_()), ("digest", pa.string())]))
        for part in parts:
            found = [rules.steps(t or "", c or []) for t, c in zip(part.column(text).to_pylist(), part.column(chain).to_pylist())]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(found, kind)], [*keep, "steps"])

    return rows.select(*keep, text, chain).mapInArrow(run, schema)
