"""Column functions for text: keys, coalescing, clean-up, templates, parsing.

Patterns carry ``(?U)`` so that white space and word classes are Unicode's.  Only canonical decomposition,
character references and the similarity ratio have no built-in and are Arrow functions.
"""

from __future__ import annotations

import html
import unicodedata
from collections.abc import Iterator, Mapping
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: fixed values: words that say yes, the resolver's prefix, and white space as Python strips it
TRUTHY = ("d", "y", "yes", "x", "1", "true", "disagree", "disagreed")
DOI_PREFIX = "https://doi.org/"
BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


@F.pandas_udf(T.StringType())
def nfkd_ascii(text: pd.Series) -> pd.Series:
    """Compatibility decomposition without what is not ASCII; null stays null."""
    return text.map(lambda x: None if x is None else x if x.isascii() else unicodedata.normalize("NFKD", x).encode("ascii", "ignore").decode())


@F.pandas_udf(T.StringType())
def html_unescape(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else html.unescape(x) if "&" in x else x)


@F.pandas_udf(T.DoubleType())
def similarity_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Share of matching blocks, 2 M / T; null with a null side."""
    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def strip(c: Column) -> Column:
    """Only the ends are looked at, so a long text costs no more than a short one."""
    return F.btrim(c.cast("string"), F.lit(BLANKS))


def collapse(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)[\s\x1c-\x1f]+", " ")


def words(lower: Column) -> Column:
    """ASCII letters and digits, single blanks; a run of anything else is one match."""
    return F.trim(F.regexp_replace(lower, "[^a-z0-9]+", " "))


def key_screen(c: Column) -> Column:
    """ASCII letters and digits of the decomposed text, single blanks."""
    return words(F.lower(nfkd_ascii(c)))


def key_title(c: Column) -> Column:
    return key_screen(html_unescape(c))


def key_pack(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")


def key_filter(c: Column) -> Column:
    """Stripped, single blanks, one closing period dropped, lower case."""
    return F.lower(F.regexp_replace(collapse(strip(c)), r"\.$", ""))


def key_exclude(c: Column) -> Column:
    return collapse(F.lower(strip(c)))


def key_join(c: Column) -> Column:
    return F.lower(strip(c))


def key_cache(c: Column) -> Column:
    return F.concat(F.lit("title:"), words(F.lower(c)))


#: bytes that aren't ASCII letters in lower case or digits as blanks, ASCII white space as blanks, and other white space in UTF-8 by all but its last byte
WORD_BYTES = np.array([i if chr(i).isdigit() or "a" <= chr(i) <= "z" else 32 for i in range(128)] + [32] * 128, np.uint8)
SPACE_BYTES = np.array([32 if chr(i) in BLANKS else i for i in range(128)] + list(range(128, 256)), np.uint8)
WIDE_BLANKS = {lead: [x.encode() for x in BLANKS if x.encode()[:-1] == lead] for lead in sorted({x.encode()[:-1] for x in BLANKS if not x.isascii()})}


def squeezed(data: np.ndarray, starts: np.ndarray, single: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Texts (bytes one after the other, and where each starts, with the end) with single blanks and none at their ends, or with no blanks."""
    kept = data != 32
    if single:
        after = np.zeros(len(data), bool)
        after[1:] = kept[:-1]
        after[starts[:-1][starts[:-1] < len(data)]] = False
        kept |= after
    places = np.flatnonzero(kept)
    at = np.searchsorted(places, starts)
    if single:
        last = at[1:][at[1:] > at[:-1]] - 1
        places = np.delete(places, last[data[places[last]] == 32])
        at = np.searchsorted(places, starts)
    return data[places], at


def long_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys of texts in lower case, a few hundred at a time: their bytes stay in the processor's cache, and no batch that goes back is large."""
    for batch in batches:
        for i in range(0, len(batch), 256):
            part = batch.slice(i, 256)
            found = keys_of(part.column("lower"))
            yield pa.RecordBatch.from_arrays([*part.columns, *found.flatten()], [*part.schema.names, *(f.name for f in found.type)])
        pa.default_memory_pool().release_unused()


def keys_of(lower: pa.Array) -> pa.Array:
    """Keys made from the bytes of all texts at once."""
    texts = lower.cast(pa.large_string())
    null, n = np.asarray(texts.is_null()), len(texts)
    _, at, held = texts.buffers()
    starts = np.frombuffer(at, np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
    data = held.slice(starts[0], starts[-1] - starts[0]).to_pybytes() if held else b""
    starts = starts - starts[0]

    def strings(data: np.ndarray, starts: np.ndarray) -> pa.Array:
        valid = pa.py_buffer(np.packbits(~null, bitorder="little"))
        return pa.Array.from_buffers(pa.large_string(), n, [valid, pa.py_buffer(starts.astype(np.int64)), pa.py_buffer(data)]).cast(pa.string())

    plain = np.frombuffer(data, np.uint8)
    coded = WORD_BYTES[plain]
    words, pack = strings(*squeezed(coded, starts)), strings(*squeezed(coded, starts, single=False))
    wide = np.flatnonzero(np.diff(np.searchsorted(np.flatnonzero(plain > 127), starts)))
    spaced = data
    for lead, blanks in WIDE_BLANKS.items() if len(wide) else ():
        if lead in data:
            for x in blanks:
                spaced = spaced.replace(x, b" " * len(x))
    exclude = strings(*squeezed(SPACE_BYTES[np.frombuffer(spaced, np.uint8)], starts))
    screen = words
    if len(wide):
        # the rows that aren't ASCII are decomposed and written over the words of the others
        plainer = [unicodedata.normalize("NFKD", data[starts[i] : starts[i + 1]].decode()).encode("ascii", "ignore").lower() for i in wide]
        ends = np.concatenate([[0], np.cumsum([len(x) for x in plainer])])
        some, at = squeezed(WORD_BYTES[np.frombuffer(b"".join(plainer), np.uint8)], ends)
        some = some.tobytes()
        chosen = np.full(n, -1)
        chosen[wide] = np.arange(len(wide))
        own = pa.array([some[a:b].decode() for a, b in zip(at[:-1], at[1:], strict=True)], pa.string()).take(pa.array(chosen, mask=chosen < 0))
        screen = pc.coalesce(own, words)
    return pa.StructArray.from_arrays([screen, pack, exclude, words], ["screen", "pack", "exclude", "words"])


def keys(df: DataFrame, c: Column, *columns: str) -> DataFrame:
    """``columns`` and all keys of long texts: screen, pack, filter, exclude, joined, cache, as the functions above make them.

    Texts go through Python once, in lower case: what is decomposed, packed or collapsed is the same before and after it.
    """
    df = df.select(*columns, F.lower(c.cast("string")).alias("lower"))
    df = df.mapInArrow(long_keys, T.StructType([*df.schema.fields, *(T.StructField(x, T.StringType()) for x in ("screen", "pack", "exclude", "words"))]))
    exclude = F.col("exclude")
    unended = F.when(exclude.endswith("."), F.substring(exclude, F.lit(1), F.length(exclude) - 1)).otherwise(exclude)
    return df.select(*columns, "screen", "pack", unended.alias("filter"), "exclude", strip(F.col("lower")).alias("joined"), F.concat(F.lit("title:"), "words").alias("cache"))


def pick(*columns: Column) -> Column:
    """The first that isn't blank, stripped; else ''."""
    return F.coalesce(*(F.nullif(strip(c.cast("string")), F.lit("")) for c in columns), F.lit(""))


def join_kept(*columns: Column, sep: str = " ") -> Column:
    """Blank parts keep their separators."""
    return F.concat_ws(sep, *(F.coalesce(c.cast("string"), F.lit("")) for c in columns))


def join_distinct(*columns: Column, sep: str = "; ", limit: int = 600) -> Column:
    parts = F.filter(F.array(*(strip(F.coalesce(c.cast("string"), F.lit(""))) for c in columns)), lambda x: x != "")
    return F.substring(F.array_join(F.array_distinct(parts), sep), 1, limit)


def strip_tags(c: Column) -> Column:
    return strip(collapse(F.regexp_replace(c, "<[^>]+>", " ")))


def doi_key(c: Column) -> Column:
    return F.replace(F.lower(strip(c)), F.lit(DOI_PREFIX), F.lit(""))


def index_to_text(index: Column) -> Column:
    """Text of a map word -> positions."""
    places = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda i: F.struct(i.alias("i"), e["key"].alias("w")))))
    return F.array_join(F.transform(F.array_sort(places), lambda x: x["w"]), " ")


#: fixed values: the ten characters that LaTeX reads as commands
LATEX = {"\\": r"\textbackslash{}", "&": r"\&", "%": r"\%", "$": r"\$", "#": r"\#", "_": r"\_", "{": r"\{", "}": r"\}", "~": r"\textasciitilde{}", "^": r"\textasciicircum{}"}
#: fixed values: typographic characters and their plain forms
TYPOGRAPHIC = {"\u2013": "--", "\u2014": "---", "\u2212": "-", "\u2018": "`", "\u2019": "'", "\u201c": "``", "\u201d": "''", "\u00a0": " ", "\u2026": "...", "\u00d7": "x"}


def latex(c: Column) -> Column:
    """Escaped for LaTeX; control and format characters go, new lines too, those from U+0180 become blanks; a null is ''."""
    c = F.coalesce(c.cast("string"), F.lit(""))
    for a, b in TYPOGRAPHIC.items():
        c = F.replace(c, F.lit(a), F.lit(b))
    c = F.regexp_replace(F.regexp_replace(c, r"[\p{Cf}\p{Cc}\p{Co}\p{Cs}]", ""), "[\\x{0180}-\\x{10FFFF}]", " ")
    # the backslash waits behind a control character, as its own escape has braces
    c = F.replace(c, F.lit("\\"), F.lit("\x00"))
    for a, b in LATEX.items():
        c = c if a == "\\" else F.replace(c, F.lit(a), F.lit(b))
    return strip(collapse(F.replace(c, F.lit("\x00"), F.lit(LATEX["\\"]))))


def fill(template: str, values: Mapping[str, tuple[Column, str]]) -> Column:
    """{name} by name, in turn; a blank value becomes its default."""
    out = F.lit(template)
    for name, (value, default) in values.items():
        text = F.coalesce(value.cast("string"), F.lit(""))
        out = F.replace(out, F.lit("{" + name + "}"), F.when(strip(text) == "", F.lit(default)).otherwise(text))
    return out


def prompt_sections(text: str) -> tuple[str, str]:
    """What stands under the first system and user headings."""
    _, _, rest = text.partition("## SYSTEM")
    system, _, user = rest.partition("## USER")
    return system.strip(), user.strip()


#: fixed values: the fields of a judgement and its decisions
JUDGEMENT = T.StructType([T.StructField(n, T.StringType()) for n in ("decision", "criterion", "relevance", "evidence", "reason")])
DECISIONS = ("include", "exclude", "uncertain")


def judgement(response: Column) -> Column:
    """The JSON object in a response as a struct, null unless it has all five fields and a known decision."""
    parsed = F.from_json(F.regexp_extract(response, r"(?s)\{.*\}", 0), JUDGEMENT)
    relevance = parsed["relevance"].try_cast("int")
    valid = parsed["decision"].isin(*DECISIONS) & relevance.isNotNull()
    for name in ("criterion", "evidence", "reason"):
        valid &= parsed[name].isNotNull()
    return F.when(valid, F.struct(*(parsed[n].alias(n) for n in ("decision", "criterion")), relevance.alias("relevance"), *(parsed[n].alias(n) for n in ("evidence", "reason"))))


def consistent(decision: Column, relevance: Column) -> Column:
    """4 and 5 go with include, 0 and 1 don't."""
    return F.when(relevance >= 4, decision == "include").when(relevance.between(0, 1), decision != "include").otherwise(F.lit(True))


def truthy(c: Column) -> Column:
    return F.lower(strip(F.coalesce(c, F.lit("")))).isin(*TRUTHY)


def pattern_label(pattern: str) -> str:
    return pattern.replace(r"\b", "").replace("\\", "")


def sum_expression(c: Column) -> Column:
    """'48 + 4' -> 52; parts that aren't numbers count nothing."""
    parts = F.transform(F.split(c, r"\+"), lambda x: F.coalesce(F.trim(x).try_cast("int"), F.lit(0)))
    return F.aggregate(parts, F.lit(0), lambda a, b: a + b)


def utc_iso(c: Column) -> Column:
    """A time as ISO-8601 with a zero offset; the session's zone is UTC."""
    return F.concat(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+00:00"))


def number(c: Column, digits: int) -> Column:
    return F.format_string(f"%.{digits}f", c.cast("double"))


def percent(c: Column) -> Column:
    return F.concat(F.format_string("%.0f", c.cast("double") * 100), F.lit("%"))


def grouped_number(c: Column) -> Column:
    """1234567 -> 1,234,567"""
    return F.format_number(c.cast("long"), 0)


def exponent(c: Column) -> Column:
    """1000000 -> 1E+06"""
    return F.format_string("%.0E", c.cast("double"))


def url_quoted(c: Column, safe: str = "/") -> Column:
    """Percent-encoded UTF-8; letters, digits, '_.-~' and ``safe`` characters stay."""
    out = F.url_encode(c)
    for a, b in (("+", "%20"), ("*", "%2A"), ("%7E", "~"), *((f"%{ord(x):02X}", x) for x in safe)):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out
