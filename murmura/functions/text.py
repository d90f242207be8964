"""String functions with Unicode semantics, as Spark column expressions.

White space is Unicode white space; lengths count code points. Every function gives null for null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space as a regex class (fixed values).
SPACE = r"[\t-\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Ranges of characters after which no space is written (fixed values).
CJK = r"[\x{3040}-\x{30ff}\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{ac00}-\x{d7af}\x{f900}-\x{faff}]"
ALNUM = r"[\p{IsAlphabetic}\p{N}]"


def utrim(c: Column) -> Column:
    """Trim of Unicode white space on both ends (``trim`` strips only U+0020)."""
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def is_blank(c: Column) -> Column:
    """True for null, empty or white-space-only text."""
    return c.isNull() | ~c.rlike(f"[^{SPACE[1:-1]}]")


def truncate_chars(c: Column, n: int) -> Column:
    """Trim first, then cut to ``n`` code points with an ellipsis if longer."""
    t = utrim(c)
    return F.when(F.char_length(t) > n, F.concat(F.substring(t, 1, n), F.lit("…"))).otherwise(t)


def source_label(c: Column) -> Column:
    """The stored label of a source; anything else is 'unknown'."""
    low = F.lower(c)
    return F.when(low.isin("mic", "microphone"), "mic").when(low == "system", "system").when(low == "file", "file").otherwise("unknown")


def like_escape(c: Column) -> Column:
    """Backslash before the characters that LIKE reads as wildcards."""
    return F.regexp_replace(c, r"([\\%_])", r"\\$1")


def ascii_lower(c: Column) -> Column:
    """ASCII letters in lower case, all others as they are (as LIKE folds in the note store)."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def join_text(a: Column, b: Column) -> Column:
    """Two pieces; a space between only where the second begins with an ASCII letter or digit and the first is not empty."""
    return F.when(F.length(a) == 0, b).when(b.rlike("^[A-Za-z0-9]"), F.concat(a, F.lit(" "), b)).otherwise(F.concat(a, b))


def word_marker(c: Column) -> Column:
    """A leading word mark of subword vocabularies becomes a space."""
    return F.regexp_replace(c, "^[▁Ġ]", " ")


def starts_cjk(c: Column) -> Column:
    """The first character that is no white space is CJK."""
    return c.rlike(f"^{SPACE}*{CJK}")


def ends_cjk(c: Column) -> Column:
    """The last character that is no white space is CJK."""
    return c.rlike(f"{CJK}{SPACE}*$")


def echo_key(c: Column) -> Column:
    """Letters and digits only, in lower case: the form in which echoes compare."""
    return F.lower(F.regexp_replace(c, r"[^\p{IsAlphabetic}\p{N}]", ""))


def similarity(a: Column, b: Column) -> Column:
    """1 less the edit distance over the longer length; two empty strings are equal."""
    longest = F.greatest(F.char_length(a), F.char_length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longest)


def has_content(c: Column) -> Column:
    """Holds a letter or digit."""
    return c.rlike(ALNUM)


def strip_annotation(c: Column) -> Column:
    """A text that begins with a bracket is an annotation and becomes empty."""
    return F.when(utrim(c).rlike(r"^[\[(]"), "").otherwise(utrim(c))


def combined_prompt(hints: Column, context: Column) -> Column:
    """Hints and context, each trimmed, joined by a space; empty ones are left out."""
    part = lambda c: F.nullif(utrim(c), F.lit(""))
    return F.coalesce(F.concat_ws(" ", part(hints), part(context)), F.lit(""))


def mask_key(c: Column) -> Column:
    """A secret with its middle hidden: up to 8 characters show the last 4, longer ones also the first 3; blank is null."""
    t = utrim(c)
    n = F.char_length(t)
    tail = F.substring(t, -4, 4)
    return F.when(n == 0, None).when(n <= 8, F.concat(F.lit("…"), tail)).otherwise(F.concat(F.substring(t, 1, 3), F.lit("…"), tail))


def yaml_scalar(c: Column) -> Column:
    """A double-quoted YAML scalar."""
    return F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def slug(c: Column, runs: bool = True) -> Column:
    """Lower-case letters and digits; each run of other characters (or each one) becomes a hyphen, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(utrim(c)), "[^a-z0-9]" + "+" * runs, "-"), "^-+|-+$", "")


def escape_html(c: Column) -> Column:
    """The three characters that HTML text must not hold."""
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def render_snippet(c: Column) -> Column:
    """A snippet as HTML, its marked matches as ``mark`` elements."""
    return F.replace(F.replace(escape_html(c), F.lit("«"), F.lit("<mark>")), F.lit("»"), F.lit("</mark>"))


def timestamp(ms: Column, sep: str = ".") -> Column:
    """HH:MM:SS and milliseconds; hours may have more than two digits."""
    t = ms.cast("bigint")
    return F.format_string(f"%02d:%02d:%02d{sep}%03d", F.floor(t / 3_600_000), F.floor(t / 60_000) % 60, F.floor(t / 1000) % 60, t % 1000)


def short_timestamp(ms: Column) -> Column:
    """M:SS, or H:MM:SS from an hour on."""
    s = F.floor(ms.cast("bigint") / 1000)
    return F.when(s >= 3600, F.format_string("%d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)).otherwise(F.format_string("%d:%02d", F.floor(s / 60), s % 60))


def meeting_label(source: Column, speaker: Column) -> Column:
    """Me, Them, Them (Speaker N), Speaker N or null; displayed numbers count from 1."""
    n = F.concat(F.lit("Speaker "), (speaker + 1).cast("string"))
    return F.when(source == "mic", "Me").when((source == "system") & speaker.isNotNull(), F.concat(F.lit("Them ("), n, F.lit(")"))).when(source == "system", "Them").otherwise(n)


def percent_badge(score: Column) -> Column:
    """A similarity as whole percent, at most 100; halves round up."""
    return F.least(F.lit(100), F.floor(score * 100 + 0.5)).cast("int")
