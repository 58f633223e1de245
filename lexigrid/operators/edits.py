"""Column edits: rows stay as they are, new columns stand right of their source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigrid.functions.text import gaps_and_matches, literal, trim, unicode_pattern

# What the cleaners remove or decode.
URL = r"(?i)\b(?:https?://|www\.)\S+"
HTML_TAG = r"<[^>]+>"
XML_MARKUP = (
    r"<\?[\s\S]*?\?>",
    r"<!--[\s\S]*?-->",
    r"<!DOCTYPE[^>\[]*(?:\[[\s\S]*?\])?\s*>",
    r"<!\[CDATA\[|\]\]>",
    r"</?[A-Za-z_][\w.:-]*(?:\s+(?:\"[^\"]*\"|'[^']*'|[^'\"<>])*)?/?>",
)
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&"))


def _title(text: Column) -> Column:
    """Each word's first letter in upper case, the rest in lower: ``it's`` gives ``It's``."""
    words = F.regexp_extract_all(text, F.lit(r"(?U)\s+|\S+"), F.lit(0))
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(w.substr(F.lit(2), F.length(w))))), "")


def _without_xml(text: Column) -> Column:
    out = F.regexp_replace(text, "|".join(XML_MARKUP), "")
    for entity, char in ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(char))
    return out


CLEANERS = {
    "trim": trim,
    "collapse_whitespace": lambda t: trim(F.regexp_replace(t, r"(?U)\s+", " ")),
    "lowercase": F.lower,
    "uppercase": F.upper,
    "title_case": _title,
    "remove_punctuation": lambda t: F.regexp_replace(t, r"[\p{P}\p{S}]", ""),
    "remove_digits": lambda t: F.regexp_replace(t, r"(?U)\d", ""),
    "remove_urls": lambda t: F.regexp_replace(t, URL, ""),
    "remove_html_tags": lambda t: F.regexp_replace(t, HTML_TAG, ""),
    "remove_xml_tags": _without_xml,
}


def _known(df: DataFrame, *names: str) -> None:
    for name in names:
        if name not in df.columns:
            raise ValueError(f"unknown column {name!r}")


def _free(df: DataFrame, *names: str) -> None:
    for name in names:
        if name in df.columns:
            raise ValueError(f"column {name!r} exists")


def place_right(df: DataFrame, source: str, new: dict[str, Column]) -> DataFrame:
    """New columns right of their source; taken names are refused."""
    _known(df, source)
    _free(df, *new)
    out = []
    for name in df.columns:
        out.append(df[f"`{name}`"])
        if name == source:
            out += [c.alias(n) for n, c in new.items()]
    return df.select(*out)


def _store(df: DataFrame, source: str, value: Column, into: str | None) -> DataFrame:
    return df.withColumn(source, value) if into is None else place_right(df, source, {into: value})


def rename(df: DataFrame, old: str, new: str) -> DataFrame:
    _known(df, old)
    _free(df, new)
    return df.withColumnRenamed(old, new)


def delete(df: DataFrame, *names: str) -> DataFrame:
    _known(df, *names)
    if len(set(names)) >= len(df.columns):
        raise ValueError("one column at least must stay")
    return df.drop(*names)


def duplicate(df: DataFrame, name: str) -> DataFrame:
    """A copy named ``x copy``, or ``x copy 2`` and so on."""
    _known(df, name)
    copy, n = f"{name} copy", 1
    while copy in df.columns:
        n += 1
        copy = f"{name} copy {n}"
    return place_right(df, name, {copy: df[f"`{name}`"]})


def clean(df: DataFrame, name: str, cleaner: str, into: str | None = None) -> DataFrame:
    _known(df, name)
    return _store(df, name, CLEANERS[cleaner](df[f"`{name}`"]), into)


def split(df: DataFrame, name: str, delimiters: list[str], names: list[str], from_right: bool = False) -> DataFrame:
    """2 to 50 parts at any of up to 20 literal delimiters, the longest first.

    From the left the last part holds the rest, from the right the first does;
    missing parts are null.
    """
    if not 2 <= len(names) <= 50 or not 1 <= len(delimiters) <= 20:
        raise ValueError("2 to 50 parts, 1 to 20 delimiters")
    any_of = "|".join(literal(d) for d in sorted(delimiters, key=lambda d: -len(d)))
    # pieces and delimiters in turn, so that the rest keeps its own delimiters
    parts = gaps_and_matches(df[f"`{name}`"], any_of)
    n = len(names)
    size = F.size(parts)
    if from_right:
        at = [size - 2 * (n - 1 - i) for i in range(n)]
        rest = F.array_join(F.slice(parts, F.lit(1), F.greatest(at[0], F.lit(0))), "")
        found = [F.when(at[0] >= 1, rest)] + [F.when(p >= 1, F.try_element_at(parts, F.greatest(p, F.lit(1)))) for p in at[1:]]
    else:
        found = [F.try_element_at(parts, F.lit(2 * i + 1)) for i in range(n - 1)]
        last = 2 * (n - 1) + 1
        found.append(F.when(size >= last, F.array_join(F.slice(parts, F.lit(last), size), "")))
    return place_right(df, name, dict(zip(names, found, strict=True)))


def count_column(df: DataFrame, name: str, what: str, into: str, pattern: str = "", regex: bool = False) -> DataFrame:
    """what: words, characters, characters_no_spaces or matches."""
    text = df[f"`{name}`"]
    counted = {
        "words": lambda: F.regexp_count(text, F.lit(r"(?U)\S+")),
        "characters": lambda: F.length(text),
        "characters_no_spaces": lambda: F.length(F.regexp_replace(text, r"(?U)\s", "")),
        "matches": lambda: F.regexp_count(text, F.lit(unicode_pattern(pattern) if regex else literal(pattern))),
    }[what]()
    return place_right(df, name, {into: counted.cast("bigint")})


def map_values(df: DataFrame, name: str, mapping: dict[str, str], keep_unlisted: bool = False, for_empty: str | None = None, into: str | None = None) -> DataFrame:
    """Label to new value, up to 500; a blank target is null, empties get ``for_empty``."""
    if not 1 <= len(mapping) <= 500:
        raise ValueError("1 to 500 values")
    text = df[f"`{name}`"].cast("string")
    listed = F.create_map(*(F.lit(x) for pair in mapping.items() for x in pair))
    target = F.try_element_at(listed, text)
    other = text if keep_unlisted else F.lit(None).cast("string")
    value = F.when(text.isNull() | (trim(text) == ""), F.lit(for_empty)).when(text.isin(list(mapping)), F.nullif(trim(target), F.lit(""))).otherwise(other)
    return _store(df, name, value, into)


def combine(df: DataFrame, template: list[tuple[str, str]], into: str, missing_blank: bool = True) -> DataFrame:
    """template: ("column", name) and ("text", words) in turn; the result stands right of the last column named."""
    part = lambda kind, x: F.lit(x) if kind == "text" else (F.coalesce(df[f"`{x}`"].cast("string"), F.lit("")) if missing_blank else df[f"`{x}`"].cast("string"))
    last = [x for kind, x in template if kind == "column"][-1]
    return place_right(df, last, {into: F.concat(*(part(*t) for t in template))})


def _pattern(pattern: str, regex: bool) -> str:
    return unicode_pattern(pattern) if regex else literal(pattern)


def replace(df: DataFrame, name: str, pattern: str, new: str, regex: bool = False, limit: int | None = None, into: str | None = None) -> DataFrame:
    """All matches, or the first ``limit``; ``${1}`` names a group in regex mode."""
    text = df[f"`{name}`"]
    target = new.replace("\\", "\\\\")
    target = target.replace("${", "$").replace("}", "") if regex else target.replace("$", "\\$")
    whole = _pattern(pattern, regex)
    if limit is None:
        value = F.regexp_replace(text, whole, target) if regex else F.replace(text, F.lit(pattern), F.lit(new))
    else:  # pieces and matches in turn; the first matches are replaced one by one
        parts = gaps_and_matches(text, whole)
        value = F.array_join(F.transform(parts, lambda p, i: F.when((i % 2 == 1) & (i < 2 * limit), F.regexp_replace(p, f"^(?:{whole})$", target)).otherwise(p)), "")
    return _store(df, name, value, into)


def extract(df: DataFrame, name: str, pattern: str, into: str, connector: str = " ", limit: int | None = None) -> DataFrame:
    """All or the first matches, joined; none gives null."""
    found = F.regexp_extract_all(df[f"`{name}`"], F.lit(unicode_pattern(pattern)), F.lit(0))
    found = F.slice(found, 1, limit) if limit else found
    return place_right(df, name, {into: F.when(F.size(found) > 0, F.array_join(found, connector))})


def set_cell(df: DataFrame, name: str, ordinal: str, row: int, value: str | None) -> DataFrame:
    """One cell, by the value of the block's ordinal column."""
    return df.withColumn(name, F.when(df[f"`{ordinal}`"] == row, F.lit(value)).otherwise(df[f"`{name}`"]))


class History:
    """Undo and redo over immutable plans, up to 50 steps."""

    def __init__(self, df: DataFrame, most: int = 50):
        self.now, self._back, self._ahead, self._most = df, [], [], most

    def apply(self, df: DataFrame) -> DataFrame:
        self._back = [*self._back, self.now][-self._most :]
        self._ahead, self.now = [], df
        return df

    def undo(self) -> DataFrame:
        if self._back:
            self._ahead.append(self.now)
            self.now = self._back.pop()
        return self.now

    def redo(self) -> DataFrame:
        if self._ahead:
            self._back.append(self.now)
            self.now = self._ahead.pop()
        return self.now
