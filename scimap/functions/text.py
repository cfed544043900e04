"""String operators as column expressions; nothing leaves the JVM."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from scimap.functions import lexicons as lex


def literal_map(pairs: dict[str, str]) -> Column:
    """A constant map; one entry at least, so that its type is known."""
    return F.create_map(*[F.lit(x) for kv in (pairs or {"": ""}).items() for x in kv])


def strip_space(c: Column) -> Column:
    """Without Unicode white space at both ends (trim() takes blanks only)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def collapse_space(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s+", " ")


def let(c: Column, f: Callable[[Column], Column]) -> Column:
    """f of c, with c evaluated once: an expression that f names several times would otherwise be copied to each place."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def plain_keyword(c: Column) -> Column:
    """Stripped and in lower case."""
    return F.lower(strip_space(c))


def singular(word: Column) -> Column:
    """A rule-based singular: -ies becomes -y, -es after a sibilant and -s go; short words and -ss stay."""
    n = F.length(word)
    return (
        F.when(word.endswith("ies") & (n > 4), F.concat(F.substring(word, F.lit(1), n - 3), F.lit("y")))
        .when(word.rlike("(?:s|x|z|ch|sh)es$"), F.substring(word, F.lit(1), n - 2))
        .when(word.endswith("s") & ~word.endswith("ss") & (n > 3), F.substring(word, F.lit(1), n - 1))
        .otherwise(word)
    )


def canonical_keyword(c: Column, synonyms: dict[str, str] | None = None, protected: list[str] | None = None) -> Column:
    """The canonical form of a keyword: cleaned, its synonym, or its last word in the singular and that one's synonym."""
    known = literal_map(lex.SYNONYMS if synonyms is None else synonyms)
    keep = lex.PROTECTED if protected is None else protected

    def of_last(s: Column, last: Column) -> Column:
        one = F.when(last.isin(*keep), last).otherwise(singular(last)) if keep else singular(last)
        head = F.concat(F.substring(s, F.lit(1), F.length(s) - F.length(last)), one)
        return F.when(s == "", s).otherwise(F.coalesce(F.try_element_at(known, s), let(head, lambda h: F.coalesce(F.try_element_at(known, h), h))))

    clean = F.btrim(collapse_space(plain_keyword(c)), F.lit(lex.KEYWORD_STRIP))
    return let(clean, lambda s: let(F.regexp_extract(s, "([^ ]*)$", 1), lambda last: of_last(s, last)))


def normalise_country(c: Column, aliases: dict[str, str] | None = None) -> Column:
    """A country's name: without full stops at the end, by its alias (case and full stops don't count) if it has one."""
    s = strip_space(F.regexp_replace(strip_space(c), r"\.+$", ""))
    known = literal_map(lex.COUNTRY_ALIASES if aliases is None else aliases)
    return F.coalesce(F.try_element_at(known, F.replace(F.lower(s), F.lit("."), F.lit(""))), s)


def split_field(c: Column, sep: str = ";") -> Column:
    """The non-empty stripped parts of a delimited field; null: none."""
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), re.escape(sep)), strip_space)
    return F.filter(parts, lambda x: x != "")


def reference_key(ref: Column) -> Column:
    """A cited work's key: its DOI, else first author's surname and year; null where there is neither.

    The year is the first in round brackets; the surname is the first word of what stands before the first comma.
    Names of fewer than 3 characters, and of digits alone, give no key.
    """

    def named(name: Column, year: Column) -> Column:
        good = (year != "") & (F.length(name) >= 3) & ~name.rlike("^[0-9]+$")
        return F.when(good, F.concat(F.regexp_extract(name, r"(?U)^\S*", 0), F.lit("_"), year))

    name = F.lower(strip_space(F.substring_index(ref, ",", 1)))
    of_name = let(name, lambda n: let(F.regexp_extract(ref, lex.YEAR_PATTERN, 1), lambda y: named(n, y)))
    # every DOI begins with "10."
    doi = F.when(ref.contains("10."), F.regexp_replace(F.lower(F.regexp_extract(ref, lex.DOI_PATTERN, 0)), "[.,]+$", ""))
    return let(doi, lambda d: F.when(d != "", d).otherwise(of_name))


def affiliations(c: Column) -> Column:
    """array<struct<author, institution, country>> of 'Surname, Given, Institution, ..., Country; ...'.

    Parts are separated by commas; entries of fewer than four are skipped.
    """
    parts = F.transform(split_field(c), lambda x: split_field(x, ","))
    parts = F.filter(parts, lambda p: F.size(p) >= 4)
    return F.transform(
        parts,
        lambda p: F.struct(
            F.concat(F.element_at(p, 1), F.lit(", "), F.element_at(p, 2)).alias("author"),
            F.element_at(p, 3).alias("institution"),
            normalise_country(F.element_at(p, -1)).alias("country"),
        ),
    )


def simple_countries(c: Column) -> Column:
    """What stands after the last comma of each part, if there is a comma and it has more than 2 characters."""
    parts = F.filter(split_field(c), lambda x: x.contains(","))
    return F.filter(F.transform(parts, lambda x: strip_space(F.element_at(F.split(x, ","), -1))), lambda x: F.length(x) > 2)


def joined_text(*cols: Column) -> Column:
    """The non-null columns, with blanks between them, in lower case."""
    return F.lower(F.concat_ws(" ", *cols))


def contains_any(text: Column, terms: list[str]) -> Column:
    """Whether a term is a substring of the text; null counts as empty."""
    return F.exists(F.array(*[F.lit(t) for t in terms]), lambda t: F.contains(F.coalesce(text, F.lit("")), t))


def n_contained(text: Column, terms: list[str]) -> Column:
    """How many of the terms are substrings of the text."""
    found = F.filter(F.array(*[F.lit(t) for t in terms]), lambda t: F.contains(F.coalesce(text, F.lit("")), t))
    return F.size(found)


def platform_pattern(name: str, patterns: dict[str, str] | None = None) -> str:
    """The pattern of a platform: its own, its phrase, or its word."""
    name = name.lower().strip()
    own = lex.PLATFORM_PATTERNS if patterns is None else patterns
    if name in own:
        return own[name]
    return re.escape(name) if " " in name else rf"\b{re.escape(name)}\b"


def shortened(c: Column, n: int = 200) -> Column:
    """The first n characters, and '...' if there are more."""
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def latex_escape(text: str) -> str:
    """A driver-side string for LaTeX; each special character is replaced once."""
    special = {"\\": r"\textbackslash{}", "&": r"\&", "%": r"\%", "$": r"\$", "#": r"\#", "_": r"\_", "{": r"\{", "}": r"\}", "~": r"\textasciitilde{}", "^": r"\textasciicircum{}"}
    return "".join(special.get(ch, ch) for ch in text)
