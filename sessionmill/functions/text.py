"""Text expressions (SF05, SF06, SF14, SF20, SF21, SF22, SF28, SF29). Lengths count code points."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

# white space as the log writers understand it
SPACES = (" \t\n\r\f\v\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f"
          "\u205f\u3000\ufeff")


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def blanks(c: Column) -> Column:
    """Every white space character as a plain blank."""
    return F.translate(c, SPACES, " " * len(SPACES))


def shorten(c: Column, limit: int) -> Column:
    return F.when(F.length(c) <= limit, c).otherwise(F.concat(F.substring(c, 1, max(0, limit - 1)), F.lit("…")))


def preview(c: Column, limit: int = 140) -> Column:
    """First line of the trimmed text, shortened."""
    return shorten(F.rtrim(F.substring_index(strip(c), "\n", 1), F.lit("\r")), limit)


def inline(c: Column) -> Column:
    return F.trim(F.regexp_replace(blanks(c), " {2,}", " "))


def compact(c: Column, limit: int = 220) -> Column:
    """White space runs become one blank; missing text is ''."""
    return shorten(inline(F.coalesce(c, F.lit(""))), limit)


def truncated(c: Column, limit: int) -> Column:
    """Text cut to ``limit`` and whether anything was cut."""
    cut = F.length(c) > limit
    return F.struct(F.when(cut, F.substring(c, 1, limit)).otherwise(c).alias("text"), cut.alias("truncated"))


def word_count(c: Column) -> Column:
    return F.when(c == "", F.lit(0)).otherwise(F.size(F.split(blanks(c), " +")))


def token_estimate(c: Column) -> Column:
    """Rough token count of a text without usage data: the larger of characters/4 and 3/4 of the words."""
    t = strip(c)
    return (F.when(t == "", F.lit(0))
            .otherwise(F.greatest(F.lit(1), F.ceil(F.length(t) / 4), F.ceil(word_count(t) * 0.75)))
            .cast("bigint"))


def token_estimate_blocks(blocks: Column) -> Column:
    return F.aggregate(blocks, F.lit(0).cast("bigint"), lambda acc, b: acc + token_estimate(b))


def path_tail(c: Column) -> Column:
    return F.regexp_extract(c, r"([^/\\]*)[/\\]*$", 1)


def basename_stem(path: Column) -> Column:
    """File name without directory and last extension."""
    base = F.regexp_extract(path, r"([^/]*)/*$", 1)
    return F.trim(F.regexp_replace(base, r"(?<=.)\.[^.]*$", ""))


def tagged(c: Column, tag: str) -> Column:
    return strip(F.regexp_extract(c, rf"(?is)<{tag}>\s*(.*?)\s*</{tag}>", 1))


def call_id_in(c: Column) -> Column:
    return F.regexp_extract(c, r"(?i)(?:call[_\s-]?id|id)\s*:\s*([A-Za-z0-9._:-]+)", 1)


def number_text(c: Column) -> Column:
    return F.regexp_replace(c.cast("string"), r"\.0$", "")


def token_summary(inp: Column, out: Column, reasoning: Column, read: Column, write: Column, total: Column) -> Column:
    """One-line description of a step's token counters; the total defaults to the sum of the parts."""
    tot = F.coalesce(total, inp + out + reasoning + read + write)
    return F.concat(F.lit("tokens: total="), number_text(tot), F.lit(" input="), number_text(inp),
                    F.lit(" output="), number_text(out), F.lit(" reasoning="), number_text(reasoning),
                    F.lit(" cache_read="), number_text(read), F.lit(" cache_write="), number_text(write))
