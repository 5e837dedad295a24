"""Small column expressions shared by the operators. All of them stay JVM-side."""

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

LOCAL_TZ = "America/Los_Angeles"
DAY_SECS = 86_400
WINDOW_KEY = "all_day"


def blank_to_null(c) -> Column:
    return F.nullif(F.col(c) if isinstance(c, str) else c, F.lit(""))


def is_blank(c) -> Column:
    return F.coalesce(F.trim(c), F.lit("")) == ""


def text(c) -> Column:
    """Concatenation operand: NULL counts as empty text."""
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def clock_secs(c) -> Column:
    """Seconds of an `H:M:S` text; the hour may pass 24. Blank gives NULL."""
    parts = F.split(blank_to_null(c), ":")
    hours, minutes, seconds = (parts[i].cast("int") for i in range(3))
    return hours * 3600 + minutes * 60 + seconds


def _naive_seconds(service_date: Column, secs: Column) -> Column:
    return F.unix_date(service_date).cast("long") * DAY_SECS + secs


def wall_clock_instant(service_date: Column, secs: Column, tz: str = LOCAL_TZ) -> Column:
    """Instant at which the local wall clock shows `service_date` plus `secs`.

    The result does not depend on the session time zone.
    """
    return F.to_utc_timestamp(F.timestamp_seconds(_naive_seconds(service_date, secs)), tz)


def elapsed_instant(service_date: Column, secs: Column, tz: str = LOCAL_TZ) -> Column:
    """Instant of local midnight plus `secs` elapsed seconds.

    Differs from `wall_clock_instant` by an hour on clock-change days.
    """
    midnight = wall_clock_instant(service_date, F.lit(0), tz)
    return F.timestamp_seconds(F.unix_seconds(midnight) + secs)


def local_hour(ts, tz: str = LOCAL_TZ) -> Column:
    local = F.unix_seconds(F.from_utc_timestamp(ts, tz))
    return F.pmod(F.floor(local / 3600), F.lit(24)).cast("int")


def clock_hour(secs) -> Column:
    """Hour shown by a service-day clock, wrapping past midnight."""
    return F.pmod(F.floor(F.col(secs) / 3600), F.lit(24)).cast("int")


def shift_secs(ts: Column, secs: int) -> Column:
    return F.timestamp_micros(F.unix_micros(ts) + F.lit(secs * 1_000_000))


def secs_between(start: Column, end: Column) -> Column:
    return (F.unix_micros(end) - F.unix_micros(start)) / F.lit(1e6)


def round6(c: Column) -> Column:
    """Round half away from zero on the decimal value, free of binary noise."""
    return F.round(c.cast("decimal(30,12)"), 6).cast("double")


def loss_minutes(observed_secs: Column, scheduled_secs: Column) -> Column:
    return F.round(F.greatest(F.lit(0.0), (observed_secs - scheduled_secs) / 60.0), 6)


def effective_wait(sum_of_squares: str, total: str) -> Column:
    """Mean wait in minutes of a rider who arrives at a random moment."""
    return F.col(sum_of_squares) / (2 * F.col(total) * 60.0)


def desc_nl(c: str) -> Column:
    return F.col(c).desc_nulls_last()


def asc_nl(c: str) -> Column:
    return F.col(c).asc_nulls_last()


def same_key(left: DataFrame, right: DataFrame, plain=(), null_safe=()) -> Column:
    """Join condition over equally named columns; `null_safe` ones match NULL with NULL."""
    parts = [left[c] == right[c] for c in plain]
    parts += [left[c].eqNullSafe(right[c]) for c in null_safe]
    return reduce(lambda a, b: a & b, parts)


def join_on(left: DataFrame, right: DataFrame, plain=(), null_safe=(), how="inner") -> DataFrame:
    """Equi join that keeps the left copy of the key columns."""
    a, b = left.alias("_l"), right.alias("_r")
    condition = reduce(
        lambda x, y: x & y,
        [F.col(f"_l.{c}") == F.col(f"_r.{c}") for c in plain]
        + [F.col(f"_l.{c}").eqNullSafe(F.col(f"_r.{c}")) for c in null_safe],
    )
    joined = a.join(b, condition, how)
    if how in ("left_semi", "left_anti"):
        return joined.select("_l.*")
    keys = {*plain, *null_safe}
    return joined.select("_l.*", *[F.col(f"_r.{c}") for c in right.columns if c not in keys])


def require_rows(df: DataFrame, message: str) -> DataFrame:
    """Fail early on an empty relation; reads at most one row."""
    if df.isEmpty():
        raise ValueError(message)
    return df


def required(rows: DataFrame, ok: Column, message: str) -> DataFrame:
    """The rows, all of which must pass: a filter, so that no reader's choice of columns can
    take the check out of the plan."""
    return rows.filter(F.when(ok, True).otherwise(F.raise_error(F.lit(message)).cast("boolean")))
