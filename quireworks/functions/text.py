"""Plain text functions on Columns."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
_WIDE = lambda s: "".join(chr(ord(c) + 0xFEE0) for c in s)
_VISIBLE = "".join(chr(c) for c in range(0x21, 0x7F))


#: All characters that count as white space.
WHITE = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def once(c: Column, f: Callable[[Column], Column]) -> Column:
    """f of c, with c computed once however often f uses it."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def where_it(c: Column, holds: Callable[[Column], Column]) -> Column:
    """For select: c in the rows where that holds of it; the others go. A filter behind a projection would compute c
    in the filter and once more for its result."""
    return F.explode(F.filter(F.array(c), holds))


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.btrim(c, F.lit(WHITE))


def half_width(c: Column, marks: bool = False) -> Column:
    """Full-width letters and digits as ASCII; with marks, punctuation too."""
    plain = _VISIBLE if marks else _LETTERS
    return F.translate(c, _WIDE(plain), plain)


def ends_in_hyphen(c: Column) -> Column:
    return c.rlike(r"[A-Za-z]+-(?U:\s)*\z")


def fold_title(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"(?U)\n\s*", " "))


def title_level(level: Column) -> Column:
    return F.greatest(F.least(F.coalesce(level, F.lit(1)), F.lit(4)), F.lit(0))


def bytes_md5(c: Column) -> Column:
    return F.upper(F.md5(c))


def code_language(c: Column) -> Column:
    """The language of a leading <_lang_> mark, in lower case; txt without one."""
    mark = r"(?s)^<_(.*?)_>"
    return F.when(c.rlike(mark), F.lower(F.regexp_extract(c, mark, 1))).otherwise(F.lit("txt"))


def without_language(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)^<_.*?_>", "")


def without_fence(c: Column) -> Column:
    """Without an opening line that begins with ``` and a closing ``` line; all line ends as \\n."""
    lines = F.regexp_replace(c, "\r\n|[\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]", "\n")
    opened = F.regexp_replace(lines, r"^```[^\n]*(\n|\z)", "")
    return strip(F.regexp_replace(opened, r"(?U)(^|\n)[^\S\n]*```[^\S\n]*\n?\z", ""))


def cjk(c: Column) -> Column:
    """Whether a text is mainly of scripts that are written without spaces: a stand-in for a
    language model, of which only this bit matters in rendering."""
    n = F.regexp_count(c, F.lit(r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}]"))
    return n * 3 > F.length(F.regexp_replace(c, r"(?U)\s", ""))


def joined_piece(c: Column) -> Column:
    """A span as it is joined to a paragraph: followed by a space unless CJK or hyphenated."""
    return once(strip(c), _joined)


def _joined(s: Column) -> Column:
    return F.when(s == "", F.lit("")).when(cjk(s) | ends_in_hyphen(s), s).otherwise(F.concat(s, F.lit(" ")))


def image_format(content: Column) -> Column:
    """Type of a picture or document by its first bytes; null if unknown."""
    h = F.hex(F.substring(content, 1, 12))
    return (
        F.when(h.startswith("FFD8FF"), "jpeg").when(h.startswith("89504E470D0A1A0A"), "png")
        .when(h.startswith("474946383761") | h.startswith("474946383961"), "gif").when(h.startswith("424D"), "bmp")
        .when(h.startswith("52494646") & (F.substring(h, 17, 8) == "57454250"), "webp")
        .when(h.startswith("49492A00") | h.startswith("4D4D002A"), "tiff").when(h.startswith("25504446"), "pdf")
    )


def data_url(content: Column) -> Column:
    return F.concat(F.lit("data:image/"), image_format(content), F.lit(";base64,"), F.base64(content))


def bucket_and_key(path: Column) -> Column:
    part = lambda k: F.regexp_extract(path, r"^(?:s3://)?/?([^/]+)/(.*)$", k)
    return F.struct(part(1).alias("bucket"), part(2).alias("key"))


def positive_or(value: Column | str, default: int) -> Column:
    """The value as a whole number where it is one above 0, else the default; a str names a column."""
    n = (F.col(value) if isinstance(value, str) else value).try_cast("int")
    return F.when(n > 0, n).otherwise(F.lit(default))


def merged_lines(lines: Column) -> Column:
    """The text of a paragraph from its lines, an array of arrays of spans (type, content) of the types
    text, inline_equation and interline_equation; other spans and empty ones count for nothing.

    Spans are followed by a space, but for display formulas, for the last text of a line among scripts
    written without spaces, and for one that ends in a hyphen; the hyphen goes if the next line begins
    with a small letter."""
    text = lambda x: x["type"] == "text"
    wide = F.transform(lines, lambda line: F.transform(line, lambda x: F.struct(x["type"].alias("type"), F.when(text(x), half_width(x["content"])).otherwise(x["content"]).alias("content"))))

    def spans(all_: Column, line: Column, i: Column, dense: Column) -> Column:
        following = F.get(F.coalesce(F.get(all_, i + 1), F.array().cast("array<struct<type:string,content:string>>")), F.lit(0))
        goes_on = F.coalesce(text(following) & following["content"].rlike(r"^\p{IsLowercase}"), F.lit(False))

        def piece(x: Column, j: Column) -> Column:
            last = j == F.size(line) - 1

            def shown(c: Column) -> Column:
                spaced = F.concat(c, F.lit(" "))
                hyphen = F.when(goes_on, F.regexp_replace(c, r"-\z", "")).otherwise(c)
                return (
                    F.when((c == "") | ~x["type"].isin("text", "inline_equation", "interline_equation"), F.lit("")).when(x["type"] == "interline_equation", c)
                    .when(dense, F.when(last & text(x), c).otherwise(spaced)).when(last & text(x) & ends_in_hyphen(c), hyphen).otherwise(spaced)
                )

            return once(strip(F.coalesce(x["content"], F.lit(""))), shown)

        return F.array_join(F.transform(line, piece), "")

    def joined(all_: Column) -> Column:
        whole = F.array_join(F.transform(F.filter(F.flatten(all_), text), lambda x: F.coalesce(x["content"], F.lit(""))), "")
        return once(cjk(whole), lambda dense: F.array_join(F.transform(all_, lambda line, i: spans(all_, line, i, dense)), ""))

    return once(wide, joined)


def repeated_grams(df: DataFrame, words: str, size: int) -> DataFrame:
    """The other columns with (gram, n): runs of `size` words that come twice or more in a row's list of
    words. Counted in the row: its sorted runs change where a new one begins, so nothing is shuffled."""
    rest = [c for c in df.columns if c != words]
    starts = F.sequence(F.lit(1), F.size(words) - (size - 1))
    grams = F.array_sort(F.transform(starts, lambda i: F.array_join(F.slice(words, i, size), " ")))
    some = df.where(F.size(words) >= size).select(*rest, grams.alias("g"))
    first = F.filter(F.sequence(F.lit(0), F.size("g") - 1), lambda i: (i == 0) | (F.get("g", i) != F.get("g", i - 1)))
    runs = some.select(*rest, "g", F.concat(first, F.array(F.size("g"))).alias("at"))
    many = F.filter(F.transform(F.sequence(F.lit(0), F.size("at") - 2), lambda k: F.struct(F.get("g", F.get("at", k)).alias("gram"), (F.get("at", k + 1) - F.get("at", k)).cast("long").alias("n"))), lambda x: x["n"] > 1)
    return runs.select(*rest, F.inline(many))


def dict_md5(c: Column) -> Column:
    """MD5 of a JSON object's text with sorted keys and a space behind commas and colons."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else hashlib.md5(json.dumps(json.loads(x), sort_keys=True, ensure_ascii=False).encode()).hexdigest())

    return run(c)


def values_under(c: Column, key: str) -> Column:
    """All values under a key anywhere in a JSON text, as JSON texts, outer ones and earlier ones first."""

    def walk(x) -> list:
        if isinstance(x, dict):
            return ([x[key]] if key in x else []) + [v for y in x.values() for v in walk(y)]
        return [v for y in x for v in walk(y)] if isinstance(x, list) else []

    @F.pandas_udf("array<string>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else [json.dumps(v, ensure_ascii=False) for v in walk(json.loads(x))])

    return run(c)


def without_surrogates(s: str) -> str:
    """Without code points that only occur in pairs; columns can't hold them, texts from outside can."""
    return "".join(x for x in s if not "\ud800" <= x <= "\udfff")
