"""Declared schemas and fixed lookup values."""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Flight table: one row per scheduled flight, 35 columns. Minutes and
# times are doubles (sums of minutes exceed float32 precision at scale).
# ---------------------------------------------------------------------------
_INT = T.IntegerType()
_DBL = T.DoubleType()
_STR = T.StringType()

FLIGHT_COLUMNS: list[tuple[str, T.DataType]] = [
    ("year", _INT),
    ("month", _INT),
    ("day_of_month", _INT),
    ("day_of_week", _INT),
    ("fl_date", T.DateType()),
    ("op_unique_carrier", _STR),
    ("op_carrier_fl_num", _DBL),
    ("origin", _STR),
    ("origin_city_name", _STR),
    ("origin_state_nm", _STR),
    ("dest", _STR),
    ("dest_city_name", _STR),
    ("dest_state_nm", _STR),
    ("crs_dep_time", _INT),
    ("dep_time", _DBL),
    ("dep_delay", _DBL),
    ("taxi_out", _DBL),
    ("wheels_off", _DBL),
    ("wheels_on", _DBL),
    ("taxi_in", _DBL),
    ("crs_arr_time", _INT),
    ("arr_time", _DBL),
    ("arr_delay", _DBL),
    ("cancelled", _INT),
    ("cancellation_code", _STR),
    ("diverted", _INT),
    ("crs_elapsed_time", _DBL),
    ("actual_elapsed_time", _DBL),
    ("air_time", _DBL),
    ("distance", _DBL),
    ("carrier_delay", _DBL),
    ("weather_delay", _DBL),
    ("nas_delay", _DBL),
    ("security_delay", _DBL),
    ("late_aircraft_delay", _DBL),
]

FLIGHT_SCHEMA = T.StructType([T.StructField(n, t, True) for n, t in FLIGHT_COLUMNS])

# Schedule file: every cell is read as text; only Date and Primary Airport
# are mandatory.
SCHEDULE_COLUMNS = [
    "League",
    "Team Name",
    "Stadium Name",
    "Stadium Lat",
    "Stadium Lon",
    "Primary Airport",
    "Airport Lat",
    "Airport Lon",
    "Primary Airport Distance",
    "Date",
    "Home Team",
    "Away Team",
]
SCHEDULE_REQUIRED = ("Date", "Primary Airport")

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference's for identical results).
# ---------------------------------------------------------------------------

# Arrival delay, in minutes, from which a flight counts as delayed.
DELAY_THRESHOLD = 15

# Cause columns in priority order: the first with positive minutes is the
# flight's reason, otherwise "unknown".
DELAY_REASON_COLUMNS = [
    "carrier_delay",
    "weather_delay",
    "nas_delay",
    "security_delay",
    "late_aircraft_delay",
]
UNKNOWN_REASON = "unknown"
NO_EVENT = "none"

# Schedule airport codes that are replaced.
AIRPORT_FIXES = {"PBG": "YUL", "IAG": "YYZ"}

# Display names: report tables.
CARRIER_NAMES = {
    "AA": "American Airlines",
    "AS": "Alaska Airlines",
    "B6": "JetBlue Airways",
    "DL": "Delta Air Lines",
    "F9": "Frontier Airlines",
    "G4": "Allegiant Air",
    "HA": "Hawaiian Airlines",
    "NK": "Spirit Airlines",
    "OO": "SkyWest Airlines",
    "UA": "United Airlines",
    "WN": "Southwest Airlines",
    "YX": "Republic Airways",
    "MQ": "Envoy Air",
    "9E": "Endeavor Air",
    "YV": "Mesa Airlines",
    "QX": "Horizon Air",
}

# Display names: chart tables.
CARRIER_SHORT_NAMES = {
    "AA": "American",
    "AS": "Alaska",
    "B6": "JetBlue",
    "DL": "Delta",
    "F9": "Frontier",
    "G4": "Allegiant",
    "HA": "Hawaiian",
    "NK": "Spirit",
    "OO": "SkyWest",
    "UA": "United",
    "WN": "Southwest",
    "YX": "Republic",
    "MQ": "Envoy",
    "9E": "Endeavor",
    "YV": "Mesa",
    "QX": "Horizon",
}

DELAY_REASON_NAMES = {
    "carrier_delay": "Carrier (Airline)",
    "weather_delay": "Weather",
    "nas_delay": "NAS (ATC/System)",
    "security_delay": "Security",
    "late_aircraft_delay": "Late Aircraft",
    "unknown": "Unknown/Other",
}

AIRPORT_NAMES = {
    "ATL": "Atlanta",
    "DFW": "Dallas/Fort Worth",
    "DEN": "Denver",
    "ORD": "Chicago O'Hare",
    "LAX": "Los Angeles",
    "CLT": "Charlotte",
    "MCO": "Orlando",
    "PHX": "Phoenix",
    "LAS": "Las Vegas",
    "SEA": "Seattle",
    "SFO": "San Francisco",
    "IAH": "Houston Intercontinental",
    "EWR": "Newark",
    "BOS": "Boston",
    "MSP": "Minneapolis",
    "FLL": "Fort Lauderdale",
    "MDW": "Chicago Midway",
    "DTW": "Detroit",
    "SLC": "Salt Lake City",
    "IAD": "Dulles",
    "BWI": "Baltimore",
    "LGA": "LaGuardia",
    "JFK": "JFK",
    "DCA": "Reagan National",
}

# ISO weekday numbers (1 = Monday).
WEEKDAY_NAMES = {1: "Mon", 2: "Tue", 3: "Wed", 4: "Thu", 5: "Fri", 6: "Sat", 7: "Sun"}

# Expected-value costs per outcome.
DEFAULT_COSTS = {"tp": 100.0, "fp": -10.0, "fn": -200.0, "tn": 0.0}

# Model feature lists.
MODEL_CATEGORICAL = ["op_unique_carrier", "origin", "origin_state_nm", "dest", "dest_state_nm"]
MODEL_RAW_NUMERIC = [
    "year",
    "month",
    "day_of_month",
    "day_of_week",
    "crs_dep_time",
    "crs_arr_time",
    "crs_elapsed_time",
    "distance",
]
MODEL_ENGINEERED = ["dep_hour", "day_of_year", "is_weekend", "dep_hour_sin", "dep_hour_cos"]
MODEL_NUMERIC = MODEL_RAW_NUMERIC + MODEL_ENGINEERED
CLUSTER_FEATURES = ["distance", "crs_elapsed_time", "crs_dep_time", "dep_hour"]

BASELINE_NUMERIC = ["month", "day_of_week", "dep_hour", "distance"]
BASELINE_CATEGORICAL = ["op_unique_carrier", "origin", "dest"]
ROUTE_NUMERIC = ["month", "day_of_week", "dep_hour", "distance", "event_flag"]
ROUTE_CATEGORICAL = ["origin", "dest", "op_unique_carrier", "event_name"]
