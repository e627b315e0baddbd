"""Column expressions over text: lines, whitespace, tokens, entropy, shared edges."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN_PATTERN = r"([\p{L}\p{N}_]+|\s+|.)"


def lines_of(content: Column) -> Column:
    """Lines of a text; a final newline does not open another line, '' has none."""
    body = F.when(
        content.endswith("\n"), F.substring(content, F.lit(1), F.length(content) - 1)
    ).otherwise(content)
    return F.when(content == "", F.array().cast("array<string>")).otherwise(F.split(body, "\n", -1))


def line_hashes(content: Column) -> list[Column]:
    """Two arrays, ``h`` and ``h2``: 64 and 32 hash bits of each line."""
    lines = lines_of(content)
    return [F.transform(lines, lambda line: F.xxhash64(line)).alias("h"), F.transform(lines, lambda line: F.hash(line)).alias("h2")]


def line_count(content: Column) -> Column:
    """Newlines, plus one for an unfinished last line."""
    newlines = F.length(content) - F.length(F.replace(content, F.lit("\n"), F.lit("")))
    open_tail = (content != "") & ~content.endswith("\n")
    return (newlines + open_tail.cast("int")).cast("bigint")


def mean_line_length(content: Column) -> Column:
    """Average characters per line without the newline; 0 for an empty text."""
    newlines = F.length(content) - F.length(F.replace(content, F.lit("\n"), F.lit("")))
    count = line_count(content)
    return F.when(count > 0, (F.length(content) - newlines).cast("double") / count).otherwise(F.lit(0.0))


def whitespace_key(content: Column) -> Column:
    """What a text says once spacing stops counting: collapsed, trimmed, no blank lines."""
    collapsed = F.transform(
        F.split(content, "\n", -1),
        lambda line: F.trim(F.regexp_replace(line, r"[\s]+", " ")),
    )
    return F.array_join(F.filter(collapsed, lambda line: line != ""), "\n")


def tokens_of(content: Column) -> Column:
    """Words, whitespace runs and single punctuation marks, in order."""
    return F.regexp_extract_all(content, F.lit(TOKEN_PATTERN), F.lit(1))


def shannon_entropy(token: Column) -> Column:
    """Bits per character, from the character counts of the token itself.

    The characters are bound once, as a lambda variable, and reused for every count.
    """

    def bits(chars: Column) -> Column:
        def add(total: Column, ch: Column) -> Column:
            share = F.size(F.filter(chars, lambda other: other == ch)) / F.size(chars)
            return total - share * F.log2(share)

        return F.aggregate(F.array_distinct(chars), F.lit(0.0), add)

    return F.element_at(F.transform(F.array(F.split(token, "")), bits), 1)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, as a lambda variable, however often ``use`` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def shared_prefix(a: Column, b: Column) -> Column:
    """Characters two texts share from the start, by bisection over equal prefixes."""

    def search(pair: Column) -> Column:
        shorter = F.least(F.length(pair["a"]), F.length(pair["b"]))

        def halve(acc: Column, _: Column) -> Column:
            mid = F.floor((acc["lo"] + acc["hi"] + 1) / 2).cast("int")
            same = F.substring(pair["a"], F.lit(1), mid) == F.substring(pair["b"], F.lit(1), mid)
            return F.struct(F.when(same, mid).otherwise(acc["lo"]).alias("lo"), F.when(same, acc["hi"]).otherwise(mid - 1).alias("hi"))

        rounds = F.sequence(F.lit(1), F.greatest(F.lit(1), F.ceil(F.log2(shorter + 1.0)).cast("int") + 1))
        return F.aggregate(rounds, F.struct(F.lit(0).alias("lo"), shorter.alias("hi")), halve, lambda acc: acc["lo"])

    return bound(F.struct(a.alias("a"), b.alias("b")), search)


def printable_share(payload: Column) -> Column:
    """Share of bytes that are printable ASCII, tab, LF or CR."""
    latin = F.decode(payload, "ISO-8859-1")
    kept = F.length(F.regexp_replace(latin, r"[^\x20-\x7E\t\n\r]", ""))
    return kept / F.length(payload)


def is_probably_text(payload: Column, sniff_bytes: int | None = None) -> Column:
    """Binary column sniff: empty is text, NUL is not, UTF-8 is, else mostly printable."""
    head = payload if sniff_bytes is None else F.substring(payload, 1, sniff_bytes)
    has_nul = F.contains(F.decode(head, "ISO-8859-1"), F.lit("\x00"))
    return (
        F.when(F.length(head) == 0, F.lit(True))
        .when(has_nul, F.lit(False))
        .when(F.is_valid_utf8(head.cast("string")), F.lit(True))
        .otherwise(printable_share(head) > 0.85)
    )
