"""Text, flag, band and date expressions."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, functions as F, types as T

# Inclusive age bands and the labels below and above them.
AGE_BANDS = [(18, 39, "18–39"), (40, 64, "40–64"), (65, 74, "65–74"), (75, 84, "75–84")]
BELOW_BANDS = "<18"
ABOVE_BANDS = "≥85"

# Words read as yes and as no.
YES_WORDS = ["yes", "y", "true", "1"]
NO_WORDS = ["no", "n", "false", "0"]

# Phrases that give an outcome away.
LEAK_PATTERN = r"(?i)(in-?hospital death|30[- ]?day mortality|death date|discharge date|expired|mortality)"

# An [Outcome] header and its body, up to the next line that opens with a [Header] or the end of the text.
OUTCOME_BLOCK = r"(?is)\n?\[Outcome\].*?(?=\n\[[A-Za-z][^\n]*?\]|\n?\z)"

# Every character sequence that ends a line.
LINE_ENDS = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"

# Characters trimmed and collapsed as white space.
SPACE_CLASS = r"[\s\x0b\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


# The same characters as one string, for trimming without a regular expression.
SPACES = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
          "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")


def strip(c: Column) -> Column:
    """Trim every kind of white space, not only the blank."""
    return F.btrim(c, F.lit(SPACES))


def rstrip(c: Column) -> Column:
    """Trim the end. The end is looked at first, because trimming goes over the whole text. Give it a plain column."""
    blank = reduce(or_, [c.endswith(x) for x in SPACES])
    return F.when(blank, F.rtrim(c, F.lit(SPACES))).otherwise(c)


def null_if_nan(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def double_text(c: Column) -> Column:
    """Shortest decimal text of a double: 5.0, 12345678.0, 0.0001, 1e-05, 1e+16."""
    raw = c.cast("string")
    # parts of d.dddE-dd, looked at only where there is an exponent
    number = F.translate(F.substring_index(raw, "E", 1), "-", "")
    mantissa, fraction = F.substring_index(number, ".", 1), F.substring_index(number, ".", -1)
    fraction = F.when(fraction == "0", "").otherwise(fraction)
    exponent = F.substring_index(raw, "E", -1).try_cast("int")
    sign = F.when(raw.startswith("-"), "-").otherwise("")
    digits = F.concat(mantissa, fraction)
    wide = F.rpad(digits, F.greatest(exponent + 2, F.length(digits)), "0")
    plain_large = F.concat(sign, F.substring(wide, F.lit(1), exponent + 1), F.lit("."),
                           F.substring(wide, exponent + 2, F.length(wide)))
    plain_small = F.concat(sign, F.lit("0."), F.repeat(F.lit("0"), -exponent - 1), digits)
    short = F.when(fraction == "", mantissa).otherwise(F.concat(mantissa, F.lit("."), fraction))
    power = F.lpad(F.abs(exponent).cast("string"), 2, "0")
    power = F.when(F.abs(exponent) >= 100, F.abs(exponent).cast("string")).otherwise(power)
    scientific = F.concat(sign, short, F.when(exponent < 0, "e-").otherwise("e+"), power)
    return (F.when(~raw.contains("E"), raw)
            .when((exponent >= 0) & (exponent < 16), plain_large)
            .when((exponent < 0) & (exponent >= -4), plain_small)
            .otherwise(scientific))


def value_or_na(c: Column, dtype: T.DataType) -> Column:
    """"NA" for null, NaN and blank text, else the value as text (not trimmed)."""
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return F.coalesce(double_text(null_if_nan(c.cast("double"))), F.lit("NA"))
    if isinstance(dtype, T.StringType):
        return F.when(c.isNull() | (strip(c) == ""), "NA").otherwise(c)
    return F.coalesce(c.cast("string"), F.lit("NA"))


def yes_no(c: Column, dtype: T.DataType) -> Column:
    """Numbers: 1 (after truncation) is yes, any other no. Text: whole numbers likewise, then word lists."""
    if isinstance(dtype, T.StringType):
        word = F.lower(strip(c))
        whole = word.rlike(r"^[+-]?\d+$")
        return (F.when(c.isNull(), "NA")
                .when(whole, F.when(word.rlike(r"^\+?0*1$"), "yes").otherwise("no"))
                .when(word.isin(YES_WORDS), "yes")
                .when(word.isin(NO_WORDS), "no")
                .otherwise("NA"))
    number = c.cast("double")
    return (F.when(number.isNull() | F.isnan(number) | (F.abs(number) == float("inf")), "NA")
            .when((number >= 1) & (number < 2), "yes")
            .otherwise("no"))


def band(c: Column, bands=AGE_BANDS, below=BELOW_BANDS, above=ABOVE_BANDS) -> Column:
    """Inclusive banding; a value in a gap between bands gets the last label, as does a large one."""
    number = null_if_nan(c.try_cast("double"))
    out = F.when(number.isNull(), "NA").when(number < bands[0][0], below)
    for low, high, label in bands:
        out = out.when(number.between(low, high), label)
    return out.otherwise(above)


def year_text(ts: Column) -> Column:
    return F.coalesce(F.year(ts).cast("string"), F.lit("NA"))


def day_offset_text(event_ts: Column, start_ts: Column) -> Column:
    """"hospital day N" from date-only difference, floored at 0."""
    days = F.datediff(event_ts, start_ts)
    return (F.when(days.isNull(), "NA")
            .otherwise(F.concat(F.lit("hospital day "), F.greatest(F.lit(0), days).cast("string"))))


def keep_informative(name: str, yes_no_value: Column) -> Column:
    """"name: yes" / "name: no", or null so that concat_ws leaves the line out."""
    return F.when(yes_no_value != "NA", F.concat(F.lit(f"{name}: "), yes_no_value))


def clean_text(c: Column) -> Column:
    """Runs of white space become one blank, ends trimmed, null becomes empty."""
    collapsed = F.regexp_replace(F.coalesce(c, F.lit("")), f"{SPACE_CLASS}+", " ")
    return F.trim(collapsed)


def truncate(c: Column, n_chars: int) -> Column:
    """First ``n_chars`` characters; 0 switches it off."""
    return F.substring(c, 1, n_chars) if n_chars > 0 else c


def ellipsis(c: Column, n_chars: int) -> Column:
    """Cleaned text, cut to ``n_chars`` with a closing "..." when it is longer."""
    cleaned = clean_text(c)
    short = F.concat(F.rtrim(F.substring(cleaned, 1, n_chars - 3)), F.lit("..."))
    return F.when(F.length(cleaned) <= n_chars, cleaned).otherwise(short)


def join_list(values: Column, sep: str = "|") -> Column:
    """Array of text joined with ``sep``; a null element prints as nothing."""
    return F.array_join(F.transform(values, lambda v: F.coalesce(v.cast("string"), F.lit(""))), sep)


def drop_leaky_lines(c: Column, pattern: str = LEAK_PATTERN) -> Column:
    lines = F.split(F.regexp_replace(c, LINE_ENDS, "\n"), "\n", -1)
    return F.array_join(F.filter(lines, lambda line: ~line.rlike(pattern)), "\n")


def sanitize(c: Column) -> Column:
    """Remove the outcome block, then every line with a leak phrase; end with one newline."""
    without_block = F.regexp_replace(c, OUTCOME_BLOCK, "")
    return F.concat(strip(drop_leaky_lines(without_block)), F.lit("\n"))


def contains_text(c: Column, needle: str, regex: bool = False) -> Column:
    """Case-insensitive match; null never matches."""
    found = c.rlike(f"(?i){needle}") if regex else F.lower(c).contains(needle.lower())
    return F.coalesce(found, F.lit(False))


def ids_from_name(name: Column, suffix: str = ".narrative.md") -> tuple[Column, Column]:
    """(patient, admission) from "<patient>_<digits><suffix>", "NA" when the name does not fit."""
    pattern = r"^(.+)_(\d+)" + suffix.replace(".", r"\.") + "$"
    parts = [F.regexp_extract(name, pattern, i) for i in (1, 2)]
    return tuple(F.when(p == "", "NA").otherwise(F.coalesce(p, F.lit("NA"))) for p in parts)
