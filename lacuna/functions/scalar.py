"""Column helpers: normalisers, bands, rounding and text. All stay inside codegen."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from lacuna import params as P


def rounded(col: Column, digits: int) -> Column:
    """Round a double to ``digits`` places, ties to even on the scaled value."""
    scale = float(10 ** digits)
    return F.rint(col * F.lit(scale)) / F.lit(scale)


def one_decimal(col: Column) -> Column:
    """Text of a double with one decimal place."""
    return rounded(col, 1).cast("string")


def exact_mean(col: Column, digits: int) -> Column:
    """Mean of values that have at most ``digits`` decimals, summed as integers.

    Integer sums do not depend on the order in which partitions are merged, so the
    mean is the same bits for every partitioning and every retry.
    """
    scale = 10 ** digits
    units = F.rint(col * F.lit(float(scale))).cast("long")
    return F.sum(units) / F.count(col) / F.lit(float(scale))


def or_default(col: Column, default) -> Column:
    """``default`` where a number is null *or zero* (zero counts as missing here)."""
    return F.when(col.isNull() | (col == 0), F.lit(default)).otherwise(col)


def text_or_default(col: Column, default) -> Column:
    """``default`` where a text is null or empty."""
    return F.when(col.isNull() | (col == ""), F.lit(default)).otherwise(col)


def clamp(col: Column, low: float = 0.0, high: float = 100.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), col))


def alias_lookup(col: Column, aliases: dict[str, list[str]], default: str) -> Column:
    """Map a label to its canonical name through an alias table."""
    key = F.upper(F.trim(col))
    whens = [(key.isin(names), target) for target, names in aliases.items()]
    chain = reduce(lambda acc, w: acc.when(w[0], F.lit(w[1])), whens[1:], F.when(whens[0][0], F.lit(whens[0][1])))
    return chain.otherwise(F.lit(default))


def severity(col: Column) -> Column:
    return alias_lookup(col, P.SEVERITY_ALIASES, "MEDIUM")


def criticality(col: Column) -> Column:
    return alias_lookup(col, P.CRITICALITY_ALIASES, "MEDIUM")


def soc_log_severity(col: Column) -> Column:
    """Severity of external log rows; here ``1`` is the most severe and no trimming is done."""
    key = F.upper(F.coalesce(col, F.lit("LOW")))
    out = F.lit("LOW")
    for target, names in reversed(P.SOC_LOG_SEVERITIES.items()):
        out = F.when(key.isin(names), F.lit(target)).otherwise(out)
    return out


def disposition(col: Column, fixed: bool = False) -> Column:
    """Closure disposition. ``fixed`` tests the more specific words first."""
    key = F.upper(F.trim(col))
    words = [("TRUE", "TRUE_POSITIVE"), ("POSITIVE", "TRUE_POSITIVE"), ("FALSE", "FALSE_POSITIVE"),
             ("BENIGN", "BENIGN_POSITIVE"), ("DUP", "DUPLICATE")]
    if fixed:
        words = [words[2], words[3], words[0], words[1], words[4]]
    out = F.lit("INCONCLUSIVE")
    for word, target in reversed(words):
        out = F.when(key.contains(word), F.lit(target)).otherwise(out)
    return F.when(key.isNull() | (key == ""), F.lit("INCONCLUSIVE")).otherwise(out)


# --- fixed values: date formats accepted besides ISO 8601 -----------------------------
EXTRA_DATE_FORMATS = [
    "yyyy/MM/dd HH:mm:ss", "yyyy/MM/dd", "MM/dd/yyyy HH:mm:ss", "MM/dd/yyyy",
    "yyyyMMdd HHmmss", "yyyyMMdd", "dd MMM yyyy HH:mm:ss", "dd MMM yyyy", "MMM dd, yyyy",
]


def timestamp(col: Column) -> Column:
    """Permissive timestamp: ISO 8601 (zone optional, UTC assumed) or a listed format."""
    text = F.trim(col)
    tries = [F.try_to_timestamp(text)] + [F.try_to_timestamp(text, F.lit(f)) for f in EXTRA_DATE_FORMATS]
    return F.when(text != "", F.coalesce(*tries))


def _uuid_hex(col: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(col)), r"urn:|uuid:|[{}\-]", "")


def is_uuid(col: Column) -> Column:
    return _uuid_hex(col).rlike("^[0-9a-f]{32}$")


def uuid_text(col: Column) -> Column:
    """Canonical 8-4-4-4-12 text of an identifier."""
    return F.regexp_replace(_uuid_hex(col), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def digits_to_int(col: Column) -> Column:
    """Integer of an all-digit text; zero and anything else become null."""
    value = F.expr("cast(null as long)")
    ok = col.rlike("^[0-9]+$") & (col != "0")
    return F.when(ok, col.try_cast("long")).otherwise(value)


def risk_band(score: Column, middle: str = "MODERATE") -> Column:
    s = clamp(score)
    return (F.when(s <= 24.99, F.lit("LOW"))
            .when((s >= 25.0) & (s <= 49.99), F.lit(middle))
            .when((s >= 50.0) & (s <= 74.99), F.lit("HIGH"))
            .when(s >= 75.0, F.lit("CRITICAL"))
            .otherwise(F.lit("LOW")))


def priority_band(score: Column) -> Column:
    return risk_band(score, "MEDIUM")


def confidence_modifier(completeness: Column) -> Column:
    return (F.when(completeness >= 95.0, F.lit(1.0)).when(completeness >= 80.0, F.lit(0.85))
            .when(completeness >= 60.0, F.lit(0.65)).otherwise(F.lit(0.40)))


def confidence_modifier_value(completeness: float) -> float:
    """The same steps for a plain number, used where the score is a job parameter."""
    steps = [(95.0, 1.0), (80.0, 0.85), (60.0, 0.65)]
    return next((m for floor, m in steps if completeness >= floor), 0.40)


def rule_category(rule_id: Column) -> Column:
    return (F.when(rule_id.contains("-"), F.substring_index(rule_id, "-", 1))
            .otherwise(F.lit("GENERAL")))


def posture(score: Column, critical_findings: Column) -> Column:
    return (F.when((critical_findings >= 5) | (score >= 80.0), F.lit("CRITICAL"))
            .when((critical_findings >= 2) | (score >= 60.0), F.lit("HIGH"))
            .when((critical_findings >= 1) | (score >= 40.0), F.lit("ELEVATED"))
            .when(score >= 20.0, F.lit("MODERATE")).otherwise(F.lit("NOMINAL")))


def key_hash(*cols) -> Column:
    """Deterministic identifier from a natural key; nulls are written as empty text."""
    parts = [F.coalesce(c.cast("string"), F.lit("")) if isinstance(c, Column) else F.lit(str(c)) for c in cols]
    return F.sha2(F.concat_ws(":", *parts), 256)


def iso(col: Column) -> Column:
    return F.date_format(col, "yyyy-MM-dd'T'HH:mm:ss")


def canonical_json(col: Column) -> Column:
    """Compact JSON that keeps nulls. Callers list struct fields alphabetically."""
    return F.to_json(col, {"ignoreNullFields": "false"})


def seconds(col: Column) -> Column:
    return F.unix_micros(col) / F.lit(1e6)


def count_where(cond: Column) -> Column:
    return F.sum(F.when(cond, 1).otherwise(0)).cast("long")


def ratio(num: Column, den: Column, digits: int = 4, empty: float = 0.0) -> Column:
    """Rounded quotient; ``empty`` when the denominator is zero."""
    return F.when(den > 0, rounded(num / den, digits)).otherwise(F.lit(empty))
