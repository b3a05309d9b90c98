"""Patterns that decide which inputs are valid.

They must accept exactly what the marketplace's API accepts, so they stand here
as they are, for the jobs and for the oracle texts alike. They match whole texts:
``anchored()`` makes them do so in a search.
"""

# Fixed values.
PERSIAN_NAME = r"[آ-ی\s]{2,25}"
PLACE_CHAR = r"[آ-ی۰-۹0-9\s\-_,،\.]"
PLACE_NAME = PLACE_CHAR + "{3,100}"
ADDRESS = PLACE_CHAR + "{10,150}"
HOUR_MINUTE = r"(2[0-3]|[01]?[0-9]):[0-5][0-9]"
YEAR_MONTH_DAY = r"\d{4}/(0[1-9]|1[0-2])/(0[1-9]|[12][0-9]|3[01])"
LATITUDE = r"(\+|-)?(?:90(?:\.0{1,6})?|(?:[0-9]|[1-8][0-9])(?:\.[0-9]{1,6})?)"

# Own: degrees of longitude go to 180.
LONGITUDE = r"(\+|-)?(?:180(?:\.0{1,6})?|(?:[0-9]|[1-9][0-9]|1[0-7][0-9])(?:\.[0-9]{1,6})?)"


def anchored(pattern: str) -> str:
    return f"^{pattern}$"
