"""Text, paths, hashes and arrays as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .prices import col

#: Month names, printed dates and bar headers.
MONTH = "jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|jun(?:e)?|jul(?:y)?|aug(?:ust)?|sep(?:tember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?"
DATE = rf"(?i)\b({MONTH})\b[^\n]{{0,18}}\b(19|20)\d{{2}}\b"
NUMERIC_DATE = r"\b(19|20)\d{2}-\d{2}-\d{2}\b"
_NUMBER = r"([\d,]+(?:\.\d+)?)"
BAR_HEADER = rf"(?i)O\s?{_NUMBER}\s+H\s?{_NUMBER}\s+L\s?{_NUMBER}\s+C\s?{_NUMBER}"
#: Lines and tokens of a chart's axes.
AXIS_PRICE = r"^\$?\d{1,3}(?:,\d{3})*(?:\.\d+)?$|^\d+(?:\.\d+)?$"
AXIS_TIME = r"(?i)^\d{1,2}:\d{2}(?::\d{2})?(?:\s*[AP]M)?$"
AXIS_DATE = r"(?i)^(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Sept|Oct|Nov|Dec|Mon|Tue|Tues|Wed|Thu|Thur|Thurs|Fri|Sat|Sun|'\d{2})$"
AXIS_RUN, AXIS_INLINE = 4, 7
SPECIAL = set(r"\.^$|()[]{}*+?-&#~/ ")


def literal(text: str) -> str:
    """A pattern that matches exactly ``text``."""
    return "".join("\\" + c if c in SPECIAL and c != " " else c for c in text)


def alias_pattern(aliases: Sequence[str], any_case: bool = True) -> str:
    """One of the aliases where no letter or digit touches it, in any case."""
    return f"{'(?i)' if any_case else ''}(?<![a-z0-9])(?:{'|'.join(map(literal, aliases))})(?![a-z0-9])"


def token_pattern(token: str) -> str:
    """The token where no letter or digit touches it, in its own case."""
    return f"(?<![A-Za-z0-9]){literal(token)}(?![A-Za-z0-9])"


def slug(text: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.lower(col(text)), "[^a-z0-9]+", "_"), F.lit("_"))


#: Words of a file's name that say nothing of its content.
TITLE_NOISE = r"(?i)(\bconcepts\b|\b\d{3,4}p\b|\b(?:full ?hd|hd|4k)\b)"


def cleaned_title(stem: Column | str, noise: str = TITLE_NOISE) -> Column:
    """A file's stem as a title: separators to spaces, boilerplate out."""
    spaced = F.translate(col(stem), "_-", "  ")
    return F.trim(F.regexp_replace(F.regexp_replace(spaced, noise, " "), r"\s+", " "))


def path_parts(path: Column | str) -> Column:
    return F.split(F.lower(col(path)), "/")


def path_category(path: Column | str) -> Column:
    parts = path_parts(path)
    return F.when(F.array_contains(parts, "case_studies"), "case_study").when(F.array_contains(parts, "live_trading_sessions"), "live_session").otherwise("concept")


def path_volume(path: Column | str) -> Column:
    """vol<n> of a case study's path, else null."""
    found = F.try_element_at(F.filter(path_parts(path), lambda p: p.rlike(r"^vol\d+$")), F.lit(1))
    return F.when(path_category(path) == "case_study", found)


def media_id(path: Column | str) -> Column:
    stem = F.regexp_replace(F.element_at(F.split(col(path), "/"), -1), r"\.[^.]*$", "")
    name, volume, kind = slug(cleaned_title(stem)), path_volume(path), path_category(path)
    return (
        F.when(kind == "case_study", F.concat(F.lit("cs_"), F.coalesce(F.concat(volume, F.lit("_")), F.lit("")), name))
        .when(kind == "live_session", F.concat(F.lit("live_"), F.regexp_replace(name, "^live_trading_session_", "")))
        .otherwise(F.concat(F.lit("concept_"), name))
    )


def has_date(text: Column | str) -> Column:
    return col(text).rlike(DATE) | col(text).rlike(NUMERIC_DATE)


def has_bar_header(text: Column | str) -> Column:
    return col(text).rlike(BAR_HEADER)


def bar_header(text: Column | str, leg: int) -> Column:
    """Leg 1 to 4 (open, high, low, close) of the first bar header, as text; empty without one."""
    return F.regexp_extract(col(text), BAR_HEADER, leg)


def has_instrument(name: Column | str) -> Column:
    """Is an instrument named (anything but blanks)?"""
    return F.coalesce(F.trim(col(name)) != "", F.lit(False))


def first_line(text: Column | str) -> Column:
    """The first line that is not blank, trimmed; null without one."""
    return F.try_element_at(F.filter(F.transform(F.split(col(text), "\n", -1), lambda x: F.trim(x, F.lit(" \t\r\f\v"))), lambda x: x != ""), F.lit(1))


def title_shaped(line: Column | str) -> Column:
    """Looks like a heading: all cased letters are upper, or every word begins with an upper or title letter and goes on in lower ones."""
    x, cased = col(line), r"\p{Lu}\p{Lt}\p{Ll}"
    upper = x.rlike(r"\p{Lu}") & ~x.rlike(r"[\p{Ll}\p{Lt}]")
    title = x.rlike(r"[\p{Lu}\p{Lt}]") & ~x.rlike(rf"[{cased}][\p{{Lu}}\p{{Lt}}]") & ~x.rlike(rf"(^|[^{cased}])\p{{Ll}}")
    return upper | title


def unreadable_lines(text: Column | str, mark: str = "[unreadable]") -> Column:
    """How many lines hold the mark of what could not be read."""
    return F.size(F.filter(F.split(F.lower(col(text)), "\n", -1), lambda x: F.contains(x, F.lit(mark))))


def group_of(identity: Column | str) -> Column:
    """The leading component of an identity: its group."""
    return F.substring_index(col(identity), "_", 1)


def inline_axis(line: Column | str) -> Column:
    """Is a single line a whole axis run together: seven tokens or more, all of them furniture?"""
    tokens = F.filter(F.split(col(line), r"\s+"), lambda t: t != "")
    return (F.size(tokens) >= AXIS_INLINE) & F.forall(tokens, lambda t: t.rlike(AXIS_DATE) | t.rlike(AXIS_PRICE) | t.rlike(AXIS_TIME))


def joined_text(*parts: Column) -> Column:
    """Parts and arrays of parts in lines, empty ones skipped."""
    return F.array_join(F.filter(F.flatten(F.array(*parts)), lambda x: x.isNotNull() & (x != "")), "\n")


def reply_verdict(reply: Column | str) -> Column:
    """ok, bad or unclear, by how a reply begins."""
    s = F.upper(F.ltrim(col(reply)))
    return F.when(F.startswith(s, F.lit("OK")), "ok").when(F.startswith(s, F.lit("BAD")), "bad").otherwise("unclear")


def within_one_edit(a: Column | str, b: Column | str) -> Column:
    """At most one insertion, deletion, substitution or swap of neighbours."""
    a, b = col(a), col(b)
    left, right = F.split(a, ""), F.split(b, "")
    p = F.array_position(F.zip_with(left, right, lambda x, y: ~x.eqNullSafe(y)), True).cast("int")  # the first difference; 0 if there is none
    rest = lambda x, skip: F.substr(x, p + skip)
    swap = (F.get(left, p - 1) == F.get(right, p)) & (F.get(left, p) == F.get(right, p - 1)) & (rest(a, 2) == rest(b, 2))
    one = (rest(a, 1) == rest(b, 1)) | (rest(a, 1) == rest(b, 0)) | (rest(a, 0) == rest(b, 1)) | F.coalesce(swap, F.lit(False))
    return F.when(p == 0, True).otherwise(one)


def hamming(a: Column | str, b: Column | str) -> Column:
    """Differing bits of two 64-bit hashes."""
    return F.bit_count(col(a).bitwiseXOR(col(b)))


def gradient_hash(cells: Column | str, rows: int = 8, columns: int = 8) -> Column:
    """Bit i of a row-major grid: is the cell greater than its right neighbour? The first bit is the highest; the last column has none."""
    c, per_row = col(cells), columns - 1
    at = lambda j: (F.floor(j / per_row) * columns + j % per_row).cast("int")
    bit = lambda j: F.when(F.get(c, at(j)) > F.get(c, at(j) + 1), F.lit(1)).otherwise(F.lit(0)).cast("bigint")
    places = F.array(*[F.lit(j) for j in range(rows * per_row)])
    return F.aggregate(places, F.lit(0).cast("bigint"), lambda acc, j: acc * 2 + bit(j))


def changed_share(a: Column | str, b: Column | str, delta: float) -> Column:
    """Share of cells whose absolute difference exceeds ``delta``."""
    hits = F.filter(F.zip_with(col(a), col(b), lambda x, y: F.abs(x.cast("double") - y.cast("double"))), lambda d: d > delta)
    return F.size(hits) / F.nullif(F.size(col(a)), F.lit(0))


def changed_cells(a: Column | str, b: Column | str, delta: float) -> Column:
    return F.size(F.filter(F.zip_with(col(a), col(b), lambda x, y: F.abs(x.cast("double") - y.cast("double"))), lambda d: d > delta))


def mean_change(a: Column | str, b: Column | str) -> Column:
    """Mean absolute difference of two arrays."""
    total = F.aggregate(F.zip_with(col(a), col(b), lambda x, y: F.abs(x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)
    return total / F.nullif(F.size(col(a)), F.lit(0))


def digest(text: Column | str, length: int = 64) -> Column:
    return F.substr(F.sha2(col(text), 256), F.lit(1), F.lit(length))


def duration_class(seconds: Column | str, short: float = 2, long: float = 10) -> Column:
    return F.when(col(seconds) < short, "short").when(col(seconds) < long, "medium").otherwise("held")
