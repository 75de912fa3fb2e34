"""Scalar text functions as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from siltstone.session import ship

#: White space as ECMAScript has it; Java's own classes differ at the edges.
SPACE = "\\t\\n\\x0B\\f\\r \\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF"
NEWLINE = "\r\n|\r|\n"
SNAPSHOT_HEAD = 0.8
#: The hash's fixed values.
FNV_BASIS, FNV_PRIME = 2166136261, 16777619
_U32 = np.uint64(0xFFFFFFFF)
#: Places that are held as columns at once, and the least texts that go on together.
FNV_STRIDE, FNV_ALONE = 4096, 24


def split_lines(text: Column) -> Column:
    """Lines of a text at CRLF, CR or LF; blanks stay, an empty text is one empty line."""
    return F.split(F.coalesce(text, F.lit("")), NEWLINE, -1)


def length16(text: Column) -> Column:
    """Length in UTF-16 code units; where every character is one byte, that is the number of bytes."""
    size = F.octet_length(text)
    return F.when(size == F.length(text), size.cast("long")).otherwise((F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("long"))


def left16(text: Column, units: int) -> Column:
    """The first ``units`` UTF-16 code units; half of a surrogate pair at the cut becomes U+FFFD."""
    return _half(text, F.substring(F.encode(text, "UTF-16BE"), 1, 2 * units), -2, ("D8", "D9", "DA", "DB"), units)


def right16(text: Column, units: int) -> Column:
    """The last ``units`` UTF-16 code units; half of a surrogate pair at the cut becomes U+FFFD."""
    if units == 0:
        return F.lit("")
    return _half(text, F.substring(F.encode(text, "UTF-16BE"), -2 * units, 2 * units), 1, ("DC", "DD", "DE", "DF"), units)


def _half(text: Column, raw: Column, at: int, halves: tuple[str, ...], units: int) -> Column:
    split = F.hex(F.substring(raw, at, 1)).isin(*halves) & (length16(text) > units)
    size = F.octet_length(raw)
    sound = F.substring(raw, F.lit(1), size - 2) if at < 0 else F.substring(raw, F.lit(3), size)
    cut = F.decode(F.when(split, sound).otherwise(raw), "UTF-16BE")
    return F.when(split, F.concat(cut, F.lit("\ufffd")) if at < 0 else F.concat(F.lit("\ufffd"), cut)).otherwise(cut)


#: What a text costs, as a function of columns: chars4, or functions.tokens.counter() for a vocabulary.
TokenCost = Callable[[Column], Column]


def chars4(text: Column) -> Column:
    """Token estimate: a quarter of the UTF-16 length, rounded up."""
    return F.ceil(length16(text) / 4).cast("long")


def line_cost(line: Column, cost: TokenCost = chars4) -> Column:
    """A line's tokens and its newline."""
    return cost(line) + 1


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, f"\\A[{SPACE}]+|[{SPACE}]+\\z", "")


def begins_blank(line: Column) -> Column:
    """Whether a line is empty or may begin with white space: told by its first character alone, before a pattern is tried."""
    return (line < "!") | (line >= "\x80")


def blank(line: Column) -> Column:
    return F.when(begins_blank(line), line.rlike(f"\\A[{SPACE}]*\\z")).otherwise(F.when(line.isNotNull(), F.lit(False)))


def boundary(line: Column) -> Column:
    """A good place to cut after: a blank line or one that ends in closing punctuation."""
    last = F.substring(line, -1, 1)
    plain = (last > " ") & (last < "\x7f")
    closed = F.when(plain, last.isin(*".?!:;,}])\"'`")).otherwise(trimmed(line).rlike("[.?!:;,}\\])\"'`]\\z"))
    return blank(line) | closed


def fingerprint(text: Column) -> Column:
    """The first twelve hex digits of the SHA-256."""
    return F.substring(F.sha2(text, 256), 1, 12)


def route_key(provider: Column, model: Column) -> Column:
    return F.concat(provider, F.lit("/"), model)


def cut(text: Column, limit: int) -> Column:
    """At most limit UTF-16 code units, the last one an ellipsis if something went."""
    return F.when(length16(text) > limit, F.concat(left16(text, limit - 1), F.lit("…"))).otherwise(text)


def preview(text: Column, limit: int = 80) -> Column:
    return cut(trimmed(F.regexp_replace(text, f"[{SPACE}]+", " ")), limit)


def cap_snapshot(text: Column, chars: int) -> Column:
    """Head (80 %) and tail with a note of what was elided, in UTF-16 code units; all of it for chars <= 0."""
    if chars <= 0:
        return text
    head = int(chars * SNAPSHOT_HEAD)
    capped = F.concat(left16(text, head), F.lit("\n…[elided "), (length16(text) - chars).cast("string"), F.lit(" chars]…\n"), right16(text, chars - head))
    return F.when(length16(text) > chars, capped).otherwise(text)


def describe_error(messages: Column, limit: int = 600) -> Column:
    """One line from a cause chain: at most four messages, without those that an earlier one contains or that contain one."""
    known = F.filter(F.slice(messages, 1, 4), lambda m: m.isNotNull())
    start = F.array().cast("array<string>")
    kept = F.aggregate(known, start, lambda acc, m: F.when(F.exists(acc, lambda p: p.contains(m) | m.contains(p)), acc).otherwise(F.concat(acc, F.array(m))))
    return cut(trimmed(F.regexp_replace(F.array_join(kept, ": "), f"[{SPACE}]+", " ")), limit)


def fnv_hashes(texts: list[str | None]) -> list[int]:
    """32-bit FNV-1a over UTF-16 code units of each text, null counting as empty.

    Texts are held as columns of code units, longest first: one step for each place takes all texts that reach it. Where few are left, each goes on alone.
    """
    units = [np.frombuffer((t or "").encode("utf-16-le", "surrogatepass"), dtype="<u2") for t in texts]
    order = sorted(range(len(units)), key=lambda k: -len(units[k]))
    sizes = np.array([len(units[k]) for k in order], dtype=np.int64)
    state = np.full(len(units), FNV_BASIS, dtype=np.uint64)
    at = 0
    while (live := int((sizes > at).sum())) >= FNV_ALONE:
        end = min(int(sizes[live - 1]), at + FNV_STRIDE)
        block = np.stack([units[k][at:end] for k in order[:live]], axis=1).astype(np.uint64)
        for row in block:
            state[:live] = (state[:live] ^ row) * FNV_PRIME & _U32
        at = end
    out = [0] * len(units)
    for k, h in zip(order, state.tolist(), strict=True):
        for u in units[k][at:].tolist():
            h = (h ^ u) * FNV_PRIME & 0xFFFFFFFF
        out[k] = h
    return out


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a over UTF-16 code units, unsigned; an Arrow-batched function whose time grows with the text's length. A null text counts as an empty one."""
    if session := SparkSession.getActiveSession():
        ship(session)
    return F.pandas_udf(_fnv1a, "long")(text)


def _fnv1a(texts: pd.Series) -> pd.Series:
    return pd.Series(fnv_hashes(texts.tolist()), dtype="int64")


def base36(number: Column, upper: bool = True) -> Column:
    out = F.conv(number.cast("string"), 10, 36)
    return out if upper else F.lower(out)
