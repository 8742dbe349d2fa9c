"""Column builders for unevenly written text. All are built-in expressions and stay in whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space of every kind that Java's \s leaves out: no-break, figure, zero-width and ideographic spaces.
BLANK = r"[\s\u0085\u00A0\u1680\u2000-\u200B\u2028\u2029\u202F\u205F\u3000\uFEFF]+"


def squash(c: Column | str) -> Column:
    """Inner white space of any kind and amount becomes one blank, outer white space goes. Null stays null."""
    return F.trim(F.regexp_replace(c, BLANK, " "))


def strip_all(c: Column | str) -> Column:
    """Without any white space. Null stays null."""
    return F.regexp_replace(c, BLANK, "")


def blank_to_null(c: Column | str) -> Column:
    """Null for null, empty and all-blank values."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(squash(c) != "", c)


def falsy_default(c: Column | str, default: object) -> Column:
    """default where c is null or an empty string."""
    return F.coalesce(F.nullif(F.col(c) if isinstance(c, str) else c, F.lit("")), F.lit(default))


def number_key(c: Column | str) -> Column:
    """A whole number's digits, however it is written: with blanks, a leading mark, leading zeros, thousands separators,
    a decimal part of zeros or an exponent. Null where there is no number."""
    c = F.col(c) if isinstance(c, str) else c
    s = F.regexp_replace(strip_all(c), "[^0-9.,eE+]", "")
    s = (
        F.when(s.rlike(r"^[0-9]+(\.[0-9]+)?[eE]\+?[0-9]{1,2}$"), F.format_string("%.0f", s.try_cast("double")))
        .when(s.rlike(r"^[0-9]{1,3}(\.[0-9]{3})+$"), F.regexp_replace(s, r"\.", ""))
        .otherwise(F.regexp_replace(s, r"[.][0-9]*$", ""))
    )
    digits = F.regexp_replace(s, "[^0-9]", "")
    general = F.when(digits != "", F.coalesce(F.nullif(F.regexp_replace(digits, "^0+", ""), F.lit("")), F.lit("0")))
    return F.when(c.rlike("^[1-9][0-9]*$"), c).otherwise(general)  # most need no more


def source_key(c: Column | str) -> Column:
    """A source's name without differences of letter case, outer blanks and joining sign."""
    return F.regexp_replace(F.lower(squash(c)), "[-_ ]+", "_")


def settled(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """df with columns that are worked out once a row. Catalyst otherwise puts a projected expression into each of its uses,
    filters and join keys included; a generator stands in the way of that at no cost of a shuffle."""
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, F.explode(F.array(F.struct(*[v.alias(k) for k, v in columns.items()]))).alias("_settled")).select(*kept, "_settled.*")
