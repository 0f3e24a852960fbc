"""Small column expressions: names, dates, units, bounds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that mark a diarrhoeal diagnosis, facility levels, seasons by month, lag days.
DIARRHEAL_WORDS = ("diarrhea", "diarrhoea", "gastroenteritis", "cholera", "dysentery", "shigella", "salmonella", "e. coli", "rotavirus", "norovirus", "amoebiasis", "giardia")
FACILITY_LEVELS = {"Primary Center": 1, "Comprehensive Center": 2, "Specialized Medical Center": 3, "Hospital": 4}
SEASONS = {"Winter": (12, 1, 2), "Spring": (3, 4, 5), "Summer": (6, 7, 8), "Fall": (9, 10, 11)}
LAG_DAYS = (1, 2, 3, 5, 7, 10, 14)


def normal_name(name: Column) -> Column:
    """Outer white space off, no-break blanks included; double blanks to single ones, once."""
    return F.replace(F.regexp_replace(name, "^[\\s\\u00A0]+|[\\s\\u00A0]+$", ""), F.lit("  "), F.lit(" "))


def has_keyword(text: Column, words: tuple[str, ...] = DIARRHEAL_WORDS) -> Column:
    """Any of the words in it, whatever the case; null has none."""
    pattern = "|".join(w.replace(".", "\\.") for w in words)
    return F.coalesce(F.lower(text).rlike(pattern), F.lit(False))


def facility_level(kind: Column, levels: dict[str, int] = FACILITY_LEVELS) -> Column:
    case = F.lit(None).cast("int")
    for name, level in levels.items():
        case = F.when(kind == name, level).otherwise(case)
    return F.coalesce(case, F.lit(1))


def monday(time: Column) -> Column:
    return F.to_date(F.date_trunc("week", time))


def season(date: Column, seasons: dict[str, tuple[int, ...]] = SEASONS) -> Column:
    case = F.lit(None).cast("string")
    for name, months in seasons.items():
        case = F.when(F.month(date).isin(*months), name).otherwise(case)
    return case


def elapsed_days(before: Column, after: Column) -> Column:
    """Whole days gone by, not calendar days."""
    return F.timestamp_diff("DAY", before, after)


def scaled(value: Column, over: Column) -> Column:
    """value / over, 0 where over is 0 or null."""
    return F.coalesce(F.try_divide(value.cast("double"), over.cast("double")), F.lit(0.0))


def clipped(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def celsius(kelvin: Column) -> Column:
    return kelvin - 273.15


def heat_index(t_c: Column, dew_c: Column) -> Column:
    return t_c + 0.4 * (dew_c - t_c)


def wind_speed(u: Column, v: Column) -> Column:
    return F.hypot(u, v)


def evaporation_mm(latent_flux: Column, seconds: float = 86400.0, joules_per_mm: float = 2.45e6) -> Column:
    """Millimetres a day of water for a latent heat flux taken as watts per square metre."""
    return latent_flux * seconds / joules_per_mm
