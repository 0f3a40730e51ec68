"""Scalar functions on columns, all native expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rx


def strip(c: Column) -> Column:
    """White space off both ends, line breaks and Unicode spaces included."""
    ends = F.concat(F.left(c, F.lit(1)), F.right(c, F.lit(1)))
    return F.when(ends.rlike(r"(?U)\s"), F.regexp_replace(c, r"(?U)^\s+|\s+$", "")).otherwise(c)


def rstrip(c: Column) -> Column:
    return F.when(F.right(c, F.lit(1)).rlike(r"(?U)\s"), F.regexp_replace(c, r"(?U)\s+$", "")).otherwise(c)


def unix_lines(c: Column) -> Column:
    return F.when(c.contains("\r"), F.regexp_replace(c, r"\r\n?", "\n")).otherwise(c)


def text_of(content: Column) -> Column:
    """Bytes as text; invalid UTF-8 is replaced, not an error."""
    return unix_lines(F.make_valid_utf8(content.cast("string")))


def lines(c: Column) -> Column:
    return F.split(c, rx.LINES, -1)


def or_null(c: Column) -> Column:
    """Null for the empty string."""
    return F.when(c != "", c)


def first_group(c: Column, pattern: str) -> Column:
    """Group 1 of the first match, null if there is none or it is empty."""
    return or_null(F.regexp_extract(c, pattern, 1))


def find_all(c: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def number_of(c: Column) -> Column:
    """The digits at the end of an id, 0 if there are none."""
    return F.coalesce(F.regexp_extract(c, r"(?U)(\d+)\s*$", 1).try_cast("bigint"), F.lit(0).cast("bigint"))


def strip_syntax(c: Column) -> Column:
    return F.when(_prefixed(c), F.regexp_replace(c, rx.SYNTAX_PREFIX, "")).otherwise(c)


def _prefixed(c: Column) -> Column:
    return c.startswith("self.") | c.startswith("cls.") | c.startswith("this.")


def span_token(c: Column) -> Column:
    """A code span's token: no space, call brackets or dots around it, no self, cls or this before it."""
    bare = F.regexp_replace(F.regexp_replace(strip(c), r"[()]+$", ""), r"^\.+", "")
    # Most spans are plain names already: one look instead of four replacements.
    plain = c.rlike(r"\A\w[\w.]*\z") & ~_prefixed(c)
    return F.when(plain, c).otherwise(strip_syntax(bare))


def tail(c: Column) -> Column:
    return F.substring_index(c, ".", -1)


def norm_ref(c: Column) -> Column:
    return F.regexp_replace(c, r"^(?:\./)+", "")


def basename(c: Column) -> Column:
    return F.substring_index(c, "/", -1)


def without_extension(c: Column) -> Column:
    """The last extension off; a name of dots and one part has none."""
    return F.regexp_replace(c, r"^((?:.*/)?\.*[^/.][^/]*)\.[^./]*$", "$1")


def extension(c: Column) -> Column:
    return F.regexp_extract(basename(c), r"^\.*[^.].*\.([^.]*)$", 1)


def is_filename(c: Column) -> Column:
    return F.lower(tail(c)).isin(*sorted(rx.FILE_EXTENSIONS))


def location(path: Column, line: Column) -> Column:
    return F.when(F.coalesce(line, F.lit(0)) != 0, F.concat(path, F.lit(":L"), line.cast("string"))).otherwise(path)


def norm_title(c: Column) -> Column:
    return F.array_join(find_all(F.lower(c), "[a-z0-9]+", 0), " ")


def sha(c: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(c, 256))


def severity_rank(c: Column) -> Column:
    ranks = F.create_map(*[F.lit(x) for i, s in enumerate(rx.SEVERITIES) for x in (s, i)])
    return F.coalesce(F.try_element_at(ranks, F.coalesce(c, F.lit(""))), F.lit(len(rx.SEVERITIES)))


def age(seconds: Column) -> Column:
    s = F.floor(seconds)
    parts = ((60, 1, "s"), (3600, 60, "m"), (86400, 3600, "h"))
    cases = reduce(
        lambda c, p: c.when(s < p[0], F.concat(F.floor(s / p[1]).cast("string"), F.lit(p[2]))), parts, F.when(s.isNull(), "unknown")
    )
    return cases.otherwise(F.concat(F.floor(s / 86400).cast("string"), F.lit("d")))


def line_number(value: Column) -> Column:
    """A variant's line: a positive whole number, or text such as 88, L88, 88-94 or L88..L94; else null."""
    kind = F.schema_of_variant(value)
    number = F.try_variant_get(value, "$", "double")
    text = F.try_variant_get(value, "$", "string")
    parsed = F.regexp_extract(strip(text), r"(?U)^[Ll]?\s*(\d+)(?:\s*(?:\.\.|[-–—])\s*[Ll]?\s*\d+)?$", 1).try_cast("bigint")
    whole = F.when((number > 0) & (number == F.floor(number)), number.cast("bigint"))
    out = F.when(kind == "STRING", parsed).when(kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$"), whole)
    return F.when(out > 0, out).cast("int")


def text_line_number(text: Column) -> Column:
    n = F.regexp_extract(text, r"^L*(\d+)$", 1).try_cast("int")
    return F.when(n > 0, n)


def escape_pipe(c: Column) -> Column:
    return F.replace(c, F.lit("|"), F.lit("\\|"))


def let(value: Column, f) -> Column:
    """``f`` of a value that is computed once, however often ``f`` uses it, in lambdas too.

    The optimizer puts a column that is used once into its place; if that place
    is a lambda, the column would be computed again for each element.
    """
    return F.get(F.transform(F.array(value), f), F.lit(0))
