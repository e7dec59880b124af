"""The few places where Spark's SQL and DuckDB's differ."""

from __future__ import annotations

import re

#: White space of the patterns below, without what only some engines call so.
S = r"[ \t\n\f\r\x0B]"
#: Ends of ASCII words, as groups: what stands before or after, or the text's edge.
EDGE_A, EDGE_B = r"(^|[^A-Za-z0-9_])", r"($|[^A-Za-z0-9_])"


class Dialect:
    def __init__(self, spark: bool) -> None:
        self.spark = spark

    def lit(self, text: str) -> str:
        """A literal without escapes; patterns name a quote as \\x27."""
        return f"r'{text}'" if self.spark else f"'{text}'"

    def match(self, x: str, pattern: str) -> str:
        return f"coalesce(({x}) RLIKE {self.lit(pattern)}, false)" if self.spark else f"coalesce(regexp_matches({x}, {self.lit(pattern)}), false)"

    def sub(self, x: str, pattern: str, by: str = "") -> str:
        """Replaces all matches; $1 names a group."""
        return f"regexp_replace({x}, {self.lit(pattern)}, {self.lit(by)})" if self.spark else f"regexp_replace({x}, {self.lit(pattern)}, {self.lit(re.sub(r'[$](\d)', r'\\\1', by))}, 'g')"

    def subs(self, x: str, *pairs: tuple[str, str]) -> str:
        for pattern, by in pairs:
            x = self.sub(x, pattern, by)
        return x

    def count(self, x: str, pattern: str) -> str:
        return f"CAST(regexp_count({x}, {self.lit(pattern)}) AS BIGINT)" if self.spark else f"CAST(len(regexp_extract_all({x}, {self.lit(pattern)})) AS BIGINT)"

    def extract(self, x: str, pattern: str, group: int = 0) -> str:
        return f"regexp_extract({x}, {self.lit(pattern)}, {group})"

    def extract_all(self, x: str, pattern: str) -> str:
        return f"regexp_extract_all({x}, {self.lit(pattern)}, 0)" if self.spark else f"regexp_extract_all({x}, {self.lit(pattern)})"

    def split(self, x: str, by: str) -> str:
        return f"split({x}, {self.lit(by)}, -1)" if self.spark else f"string_split_regex({x}, {self.lit(by)})"

    def map(self, a: str, v: str, e: str) -> str:
        return f"transform({a}, {v} -> {e})" if self.spark else f"list_transform({a}, lambda {v}: {e})"

    def keep(self, a: str, v: str, e: str) -> str:
        return f"filter({a}, {v} -> {e})" if self.spark else f"list_filter({a}, lambda {v}: {e})"

    def size(self, a: str) -> str:
        return f"CAST(size({a}) AS BIGINT)" if self.spark else f"CAST(len({a}) AS BIGINT)"

    def join(self, a: str, by: str) -> str:
        return f"array_join({a}, '{by}')" if self.spark else f"array_to_string({a}, '{by}')"

    def div(self, a: str, b: str) -> str:
        return f"(({a}) div ({b}))" if self.spark else f"(({a}) // ({b}))"

    def trim(self, x: str) -> str:
        return self.sub(x, f"^{S}+|{S}+$")

    def listed(self, x: str, order: str, by: str = "\\n") -> str:
        """Texts of a group, in order, joined."""
        sep = f"'{by}'" if self.spark else f"chr(10)" if by == "\\n" else f"'{by}'"
        return f"listagg({x}, {sep}) WITHIN GROUP (ORDER BY {order})" if self.spark else f"string_agg({x}, {sep} ORDER BY {order})"

    def sha(self, x: str) -> str:
        return f"sha2({x}, 256)" if self.spark else f"sha256({x})"

    def newline(self) -> str:
        return "'\\n'" if self.spark else "chr(10)"

    def day(self, x: str) -> str:
        return f"CAST({x} AS DATE)"

    def date_text(self, x: str) -> str:
        return f"CAST(CAST({x} AS DATE) AS {'STRING' if self.spark else 'VARCHAR'})"

    def words(self, x: str) -> str:
        return self.keep(self.split(x, f"{S}+"), "w", "w <> ''")

    def lines(self, x: str) -> str:
        return f"split({x}, '\\n', -1)" if self.spark else f"string_split({x}, chr(10))"

    def exploded(self, source: str, columns: str, array: str, item: str, place: str) -> str:
        """A row an item, places from 0."""
        if self.spark:
            return f"SELECT {columns}, {place}, {item} FROM {source} LATERAL VIEW posexplode({array}) _x AS {place}, {item}"
        return f"SELECT {columns}, {place}, _a[{place} + 1] AS {item} FROM (SELECT *, unnest(range(len(_a))) AS {place} FROM (SELECT *, {array} AS _a FROM {source}))"


SPARK, DUCK = Dialect(True), Dialect(False)
