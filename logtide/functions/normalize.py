"""Row-level normalisation as Column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings of each level.
LEVELS = {
    "trace": ["trace", "tracing", "verbose"],
    "debug": ["debug", "debugging"],
    "info": ["info", "information", "notice"],
    "warn": ["warn", "warning"],
    "error": ["error", "err", "exception"],
    "fatal": ["fatal", "critical", "crit", "panic"],
}


def level(col: Column) -> Column:
    """Trimmed and lower-cased, then one name for each group of spellings; others stay as they are."""
    clean = F.lower(F.trim(col))
    out = clean
    for name, spellings in LEVELS.items():
        out = F.when(clean.isin(spellings), name).otherwise(out)
    return out


def severity(col: Column) -> Column:
    """Level of a telemetry severity number."""
    return F.when(col <= 5, "debug").when(col <= 9, "info").when(col <= 13, "warn").when(col <= 17, "error").otherwise("fatal")
