"""Literal normalizers and detectors as column expressions. Nulls stay null throughout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Spaces that group digits (space, no-break space, narrow no-break space).
SPACES = "[   ]"
PLAIN = r"^[+-]?[0-9]+([.,][0-9]+)?$"
SPACED = rf"^[+-]?[0-9]{{1,3}}({SPACES}[0-9]{{3}})+([.,][0-9]+)?$"
COMMA_GROUPED = r"^[+-]?[0-9]{1,3}(,[0-9]{3})+\.[0-9]+$"
DOT_GROUPED = r"^[+-]?[0-9]{1,3}(\.[0-9]{3})+,[0-9]+$"


def money(x: Column) -> Column:
    """Exact amount of two decimal places."""
    return x.cast("decimal(20,2)")


def money_text(x: Column) -> Column:
    """A fixed-point amount as text, without grouping."""
    return money(x).cast("string")


def decimal_literal(x: Column) -> Column:
    """A number with its sign, digits and a decimal dot; anything else as it is.

    Digits after the last dot or comma are the fraction. Before it stand plain digits, or groups of three
    (the first may be shorter) between spaces or between marks that aren't the fraction's.
    """
    body = F.regexp_replace(x, "^[+-]", "")
    mark, fraction = F.regexp_extract(body, "([.,])[0-9]+$", 1), F.regexp_extract(body, "[.,]([0-9]+)$", 1)
    whole = F.when(mark == "", body).otherwise(F.regexp_replace(body, "[.,][0-9]+$", ""))
    other = F.when(mark == ".", F.translate(whole, ",", " ")).when(mark == ",", F.translate(whole, ".", " ")).otherwise(whole)
    groups = F.split(F.when(whole.rlike(SPACES), F.regexp_replace(whole, SPACES, " ")).otherwise(other), " ")
    first, rest = F.element_at(groups, 1), F.slice(groups, 2, 1 << 20)
    sound = F.when(F.size(rest) == 0, first.rlike("^[0-9]+$")).otherwise(first.rlike("^[0-9]{1,3}$") & F.forall(rest, lambda g: g.rlike("^[0-9]{3}$")))
    number = F.concat(F.regexp_extract(x, "^[+-]?", 0), F.array_join(groups, ""), F.when(mark == "", "").otherwise(F.concat(F.lit("."), fraction)))
    return F.when(sound, number).otherwise(x)


def date_literal(x: Column) -> Column:
    """YYYY-MM-DD and DD.MM.YYYY as ISO text; literals that are no dates stay."""
    iso = F.when(x.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(x, "yyyy-MM-dd"))
    dotted = F.when(x.rlike(r"^\d{2}\.\d{2}\.\d{4}$"), F.try_to_date(x, "dd.MM.yyyy"))
    return F.coalesce(F.date_format(F.coalesce(iso, dotted), "yyyy-MM-dd"), x)


def numeric_convention(x: Column) -> Column:
    """Aggregate: comma_dot, dot_comma, ambiguous or none over the literals of a column."""
    comma, dot = F.coalesce(F.bool_or(x.rlike(COMMA_GROUPED)), F.lit(False)), F.coalesce(F.bool_or(x.rlike(DOT_GROUPED)), F.lit(False))
    return F.when(comma & dot, "ambiguous").when(comma, "comma_dot").when(dot, "dot_comma").otherwise("none")


def sign(x: Column) -> Column:
    return F.when(x < 0, "negative").when(x > 0, "positive").when(x == 0, "zero").otherwise("not_applicable")


def comparable(x: Column) -> Column:
    """Text for comparison: spaces collapsed and trimmed, upper case; decimals without trailing zeros."""
    folded = F.upper(F.trim(F.regexp_replace(x, r"\s+", " ")))
    digits = F.regexp_replace(F.regexp_replace(folded, r"^\+", ""), r"^(-?)0+(?=[0-9])", "$1")
    short = F.when(digits.contains("."), F.regexp_replace(digits, r"\.?0+$", "")).otherwise(digits)
    number = F.when(folded.rlike(r"^[+-]?[0-9]+(\.[0-9]+)?$"), F.when(short == "-0", "0").otherwise(short))
    return F.coalesce(number, folded)


def value_kinds(x: Column) -> Column:
    """The kinds that a literal may be."""
    return F.array_compact(
        F.array(
            F.when(x.rlike(PLAIN), F.lit("decimal")), F.when(x.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.lit("date")),
            F.when(x.rlike(r"^[A-Z]{3}$"), F.lit("currency")), F.when(x.rlike(r"^[A-Z]{2}[A-Z0-9]{9}[0-9]$"), F.lit("isin")),
        )
    )


def slug(x: Column) -> Column:
    """Lower case; runs of other than letters, digits and underscores become one underscore, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(x), r"(?U)\W+", "_"), "_+", "_"), "^_|_$", "")


def alnum_fold(x: Column) -> Column:
    """Lower case, Latin and Cyrillic letters and digits only."""
    return F.regexp_replace(F.lower(x), "[^0-9a-zа-яё]+", "")


def numeric_tokens(x: Column) -> Column:
    """Numbers in a text, grouped or not, as they stand."""
    return F.regexp_extract_all(x, F.lit(r"[0-9]+(?:[.,][0-9]+)*"), F.lit(0))


def spaced_digits_pattern(digits: Column) -> Column:
    """A pattern that finds the digits with optional separators between."""
    return F.concat_ws("[ .,]*", F.split(digits, ""))


def stable_digest(*parts: Column, length: int = 16) -> Column:
    """Leading digits of the SHA-256 of the parts joined by a bar; null counts as empty."""
    return F.substring(F.sha2(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), 256), 1, length)


def document_ref(ordinal: Column, content: Column) -> Column:
    return F.format_string("doc_%03d_%s", ordinal, F.substring(F.sha2(content, 256), 1, 12))


def canonical_json(**fields: Column) -> Column:
    """JSON of the fields in alphabetical order, nulls included."""
    return F.to_json(F.struct(*(v.alias(k) for k, v in sorted(fields.items()))), {"ignoreNullFields": "false"})


def token_estimate(x: Column) -> Column:
    """A quarter of the UTF-8 bytes, rounded up, and a margin of 64."""
    return F.ceil(F.octet_length(x) / 4) + 64


def residency(present_days: Column, covered_days: Column, window_days: Column, least: int = 183) -> Column:
    """Resident from ``least`` days on; otherwise only a completely covered window can say no."""
    return F.when(present_days >= least, "resident").when(covered_days == window_days, "not_resident").otherwise("insufficient")


def substitute(template: Column, **values: Column) -> Column:
    """``{{name}}`` markers replaced; a template without any marker gets the values appended, a line each."""
    out, marked = template, F.lit(False)
    for name, value in values.items():
        marker = "{{" + name + "}}"
        marked = marked | template.contains(marker)
        out = F.replace(out, F.lit(marker), value)
    return F.when(marked, out).otherwise(F.concat_ws("\n", template, *values.values()))


def xml_value(x: Column, kind: str, mapping: dict[str, str] | None = None) -> Column:
    """The value transforms of the XML sink, by name."""
    kinds = {
        "identity": lambda: x.cast("string"),
        "integer": lambda: x.cast("decimal(38,0)").cast("string"),
        "date": lambda: F.date_format(x, "dd.MM.yyyy"),
        "money": lambda: money_text(x),
        "money_whole": lambda: F.round(money(x), 0).cast("decimal(20,0)").cast("string"),
        "enum": lambda: F.element_at(F.create_map(*(F.lit(v) for kv in (mapping or {}).items() for v in kv)), x),
    }
    return kinds[kind]()
