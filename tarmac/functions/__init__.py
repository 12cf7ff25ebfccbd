"""Column expressions (cleaning rules, display names, rates)."""

from tarmac.functions.columns import (  # noqa: F401
    ROUND_DIGITS,
    delay_reason,
    dep_hour,
    display_name,
    event_label,
    fixed_airport,
    is_delayed,
    pct,
    ratio,
    route_key,
    schedule_date,
    weather_flag,
    weekday_name,
)
