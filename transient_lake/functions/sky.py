"""Sky-coordinate column functions.

All are compositions of Spark built-ins, so they stay inside whole-stage
codegen.  Arguments accept column names or Columns.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def angular_sep_deg(ra1, dec1, ra2, dec2) -> Column:
    """Great-circle distance in degrees (haversine form, C4).

    The haversine argument is clamped to 1 so coincident or antipodal points
    never become NaN (the arccos form loses coincident points to rounding)."""
    ra1, dec1, ra2, dec2 = map(_c, (ra1, dec1, ra2, dec2))
    s_dec = F.sin(F.radians(dec2 - dec1) / 2)
    s_ra = F.sin(F.radians(ra2 - ra1) / 2)
    h = s_dec * s_dec + F.cos(F.radians(dec1)) * F.cos(F.radians(dec2)) * s_ra * s_ra
    return F.degrees(F.asin(F.least(F.lit(1.0), F.sqrt(h))) * 2)


def angular_sep_arcsec(ra1, dec1, ra2, dec2) -> Column:
    return angular_sep_deg(ra1, dec1, ra2, dec2) * 3600.0


def acos_sep_arcsec(ra1, dec1, ra2, dec2) -> Column:
    """Spherical law of cosines, exactly as the legacy stream job wrote it.
    NaN for (near-)coincident points whose cosine rounds above 1."""
    ra1, dec1, ra2, dec2 = map(_c, (ra1, dec1, ra2, dec2))
    c = (F.sin(F.radians(dec1)) * F.sin(F.radians(dec2))
         + F.cos(F.radians(dec1)) * F.cos(F.radians(dec2)) * F.cos(F.radians(ra1 - ra2)))
    return F.degrees(F.acos(c)) * 3600


def dec_bucket(dec) -> Column:
    """Declination cast to DECIMAL(10,3), the legacy join bucket."""
    return _c(dec).cast("decimal(10,3)")


def deg_to_hms(ra) -> Column:
    """C5 (RA part): degrees -> ``HH:MM:SS.ssss``.

    Works on integer units of 1e-4 s of time, so carries (59.99995 s) roll
    into minutes/hours and 24 h wraps to 0."""
    ra = _c(ra)
    units = F.round(F.pmod(ra, F.lit(360.0)) / 15.0 * 36000000).cast("long") % 864000000
    h = F.floor(units / 36000000)
    m = F.floor((units % 36000000) / 600000)
    s = units % 600000
    return F.format_string("%02d:%02d:%02d.%04d", h, m, F.floor(s / 10000), s % 10000)


def deg_to_dms(dec) -> Column:
    """C5 (Dec part): degrees -> ``±DD:MM:SS.ssss`` on 1e-4 arcsec units."""
    dec = _c(dec)
    units = F.round(F.abs(dec) * 36000000).cast("long")
    d = F.floor(units / 36000000)
    m = F.floor((units % 36000000) / 600000)
    s = units % 600000
    sign = F.when(dec < 0, F.lit("-")).otherwise(F.lit("+"))
    return F.concat(sign, F.format_string("%02d:%02d:%02d.%04d", d, m, F.floor(s / 10000), s % 10000))


# A sexagesimal value is three numbers separated by spaces or
# colons, with an optional sign in front of the whole value.
SEXAGESIMAL = r"^\s*([+-]?)\s*(\d+(?:\.\d*)?)[\s:]+(\d+(?:\.\d*)?)[\s:]+(\d+(?:\.\d*)?)\s*$"


def sexagesimal_to_deg(text, hours: bool) -> Column:
    """``HH MM SS.s`` / ``HH:MM:SS.s`` (or a plain decimal) -> degrees.
    The sign applies to the whole value; unparseable text gives NULL."""
    t = _c(text)
    ok = t.rlike(SEXAGESIMAL)

    def part(i):
        return F.regexp_extract(t, SEXAGESIMAL, i).try_cast("double")

    mag = part(2) + part(3) / 60.0 + part(4) / 3600.0
    mag = mag * 15.0 if hours else mag
    signed = F.when(F.regexp_extract(t, SEXAGESIMAL, 1) == "-", -mag).otherwise(mag)
    plain = F.trim(t).try_cast("double")
    return F.when(ok, signed).otherwise(plain)


def split_coordinates(text) -> Column:
    """One ``RA Dec`` string -> array of exactly two tokens (or NULL).

    A comma separates the two parts when present; otherwise the tokens are
    whitespace separated and there must be either 2 (decimal) or 6
    (sexagesimal) of them."""
    t = F.trim(_c(text))
    by_comma = F.transform(F.split(t, ","), lambda x: F.trim(x))
    toks = F.split(F.regexp_replace(t, r"\s+", " "), " ")
    six = F.array(F.concat_ws(" ", F.slice(toks, 1, 3)), F.concat_ws(" ", F.slice(toks, 4, 3)))
    parts = (F.when(t.contains(","), by_comma)
             .when(F.size(toks) == 2, toks)
             .when(F.size(toks) == 6, six))
    good = (F.size(parts) == 2) & F.forall(parts, lambda x: F.length(x) > 0)
    return F.when(good, parts)
