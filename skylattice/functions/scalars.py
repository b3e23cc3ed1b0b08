"""Scalar expressions: time stamps, units, buckets, geometry, text and hashes.

All are column expressions without Python on the executors.  NaN and NULL stay apart; a
comparison with a threshold is never true for NaN.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


# ---- numbers


def is_finite(x: Column | str) -> Column:
    x = _col(x)
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def at_least(x: Column | str, threshold: float | Column) -> Column:
    """x >= threshold, false for NaN."""
    x = _col(x)
    return ~F.isnan(x) & (x >= threshold)


def ratio(num: Column, den: Column) -> Column:
    """num / den, NULL where den is 0."""
    return F.when(den != 0, num / den)


def calibrated(raw: Column | str, formula: Column | str, missing: tuple[int, ...] = (65534, 65535), factor: float = 12.0) -> Column:
    """Raw counts by a formula 'GEO=a*PV+b' (b may be negative), missing codes as NaN, times ``factor``."""
    raw, formula = _col(raw), F.regexp_replace(_col(formula), r"\s", "")
    number = r"([-+]?[0-9.]+(?:[eE][-+]?[0-9]+)?)"
    scale = F.regexp_extract(formula, f"GEO={number}\\*PV", 1).try_cast("double")
    offset = F.coalesce(F.regexp_extract(formula, rf"PV{number}$", 1).try_cast("double"), F.lit(0.0))
    return F.when(raw.isin(*missing), F.lit(float("nan"))).otherwise((raw * scale + offset) * factor)


def per_hour(amount: Column | str, minutes: int) -> Column:
    """An amount over ``minutes`` as a rate over an hour."""
    return _col(amount) * (60 // minutes if 60 % minutes == 0 else 60 / minutes)


def z_score(x: Column | str, centre: float, scale: float) -> Column:
    return (_col(x) - centre) / scale


def clipped(x: Column | str, low: float | Column, high: float | Column) -> Column:
    """x within bounds, NaN as the lower one."""
    low, high = (b if isinstance(b, Column) else F.lit(b) for b in (low, high))
    return F.least(F.greatest(F.nanvl(_col(x), low), low), high)


def lenient_double(x: Column | str, default: float = 0.0) -> Column:
    """A number from text, ``default`` where it is none."""
    return F.coalesce(_col(x).try_cast("double"), F.lit(default))


# ---- buckets


def rain_level(rate: Column | str) -> Column:
    """Left-closed intensity levels."""
    r = _col(rate)
    return F.when(~(r > 0) | F.isnan(r), "none").when(r < 2.5, "light").when(r < 7.5, "moderate").when(r < 50, "heavy").otherwise("violent")


def cut(x: Column | str, edges: list[float], labels: list[str], include_lowest: bool = False) -> Column:
    """Right-closed intervals (a, b]; NULL outside and for NaN."""
    x, out = _col(x), None
    for i, label in enumerate(labels):
        low, high = edges[i], edges[i + 1]
        inside = (x >= low) if include_lowest and i == 0 else (x > low)
        inside = ~F.isnan(x) & inside & ((x <= high) if math.isfinite(high) else F.lit(True))
        out = F.when(inside, label) if out is None else out.when(inside, label)
    return out


def spatial_bucket(degrees: Column | str, step: float = 0.1) -> Column:
    """Half-even rounding to a multiple of step, as the multiple's number."""
    return F.bround(_col(degrees) / step, 0).cast("long")


# Rates and colours of the ramp's stops.
RAMP = [(0.0, (220, 220, 220)), (0.001, (158, 202, 225)), (2.5, (49, 130, 189)), (7.5, (253, 141, 60)), (50.0, (227, 26, 28))]


def ramp_colour(rate: Column | str, stops: list[tuple[float, tuple[int, int, int]]] | None = None, max_alpha: int = 220, full_at: float = 0.3) -> Column:
    """struct<r,g,b,a:int>: linear between stops, constant beyond the last, transparent from 0 down."""
    stops = stops or RAMP
    r = F.nanvl(_col(rate), F.lit(0.0))

    def channel(k: int) -> Column:
        out = F.lit(float(stops[-1][1][k]))
        for (a, low), (b, high) in reversed(list(zip(stops, stops[1:], strict=False))):
            share = F.greatest(F.lit(0.0), (r - a) / (b - a))
            out = F.when(r < b, low[k] + (high[k] - low[k]) * share).otherwise(out)
        return F.when(r > 0, F.floor(out)).otherwise(0).cast("int")

    alpha = F.when(r > 0, F.floor(F.least(F.lit(1.0), r / full_at) * max_alpha)).otherwise(0).cast("int")
    return F.struct(channel(0).alias("r"), channel(1).alias("g"), channel(2).alias("b"), alpha.alias("a"))


# ---- grids


def cell_index(value: Column | str, low: float, high: float, n: int, descending: bool = False) -> Column:
    """Cell of a coordinate by truncation; row 0 is the north if descending."""
    v = _col(value)
    share = (high - v) / (high - low) if descending else (v - low) / (high - low)
    return (share * (n - 1)).cast("int")


def axis(i: Column | str, start: float, stop: float, n: int) -> Column:
    """The i-th of n evenly spaced points, both ends included."""
    return start + _col(i) * (stop - start) / (n - 1)


def square_distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return (ax - bx) * (ax - bx) + (ay - by) * (ay - by)


def idw_weight(d2: Column, power: float = 2.0) -> Column:
    d2 = d2 + 1e-9
    return 1 / d2 if power == 2 else 1 / F.pow(d2, F.lit(power / 2))


def polar_stereographic(lat: Column, lon: Column, *, true_lat: float, lon0: float, a: float, b: float) -> tuple[Column, Column]:
    """Forward north polar stereographic projection of an ellipsoid (a, b in the wanted unit): x, y."""
    e = math.sqrt(1 - (b / a) ** 2)
    phi, lam, phi1 = F.radians(lat), F.radians(lon - lon0), math.radians(true_lat)

    def t(p: Column) -> Column:
        s = F.sin(p) * e
        return F.tan(math.pi / 4 - p / 2) / F.pow((1 - s) / (1 + s), F.lit(e / 2))

    s1 = e * math.sin(phi1)
    t1 = math.tan(math.pi / 4 - phi1 / 2) / ((1 - s1) / (1 + s1)) ** (e / 2)
    m1 = math.cos(phi1) / math.sqrt(1 - s1 * s1)
    rho = t(phi) * (a * m1 / t1)
    return rho * F.sin(lam), -rho * F.cos(lam)


def polar_stereographic_inverse(x: Column, y: Column, *, true_lat: float, lon0: float, a: float, b: float) -> tuple[Column, Column]:
    """Latitude and longitude in degrees, by the series in the eccentricity."""
    e2 = 1 - (b / a) ** 2
    e, phi1 = math.sqrt(e2), math.radians(true_lat)
    s1 = e * math.sin(phi1)
    t1 = math.tan(math.pi / 4 - phi1 / 2) / ((1 - s1) / (1 + s1)) ** (e / 2)
    m1 = math.cos(phi1) / math.sqrt(1 - s1 * s1)
    chi = math.pi / 2 - 2 * F.atan(F.sqrt(x * x + y * y) * (t1 / (a * m1)))
    e4, e6, e8 = e2**2, e2**3, e2**4
    series = [(2, e2 / 2 + 5 * e4 / 24 + e6 / 12 + 13 * e8 / 360), (4, 7 * e4 / 48 + 29 * e6 / 240 + 811 * e8 / 11520), (6, 7 * e6 / 120 + 81 * e8 / 1120), (8, 4279 * e8 / 161280)]
    phi = chi
    for k, c in series:
        phi = phi + c * F.sin(chi * k)
    return F.degrees(phi), lon0 + F.degrees(F.atan2(x, -y))


#: Mean radius of the earth.
EARTH_KM = 6371.0


def km_pitch(degrees: Column, lat: Column | None = None, km_per_degree: float = math.pi / 180 * EARTH_KM) -> Column:
    """Degrees as kilometres, along a parallel if lat is given."""
    out = degrees * km_per_degree
    return out if lat is None else out * F.cos(F.radians(lat))


# ---- time


def stamp_time(text: Column | str) -> Column:
    """The 12-digit stamp in a name as a time; NULL without one."""
    stamp = F.regexp_extract(_col(text), r"(\d{12})", 1)
    return F.when(stamp != "", F.try_to_timestamp(stamp, F.lit("yyyyMMddHHmm"))).cast("timestamp_ntz")


def header_time(text: Column | str) -> Column:
    """'dd-MON-yyyy;HH:MM:SS' (with or without a fraction) as a time."""
    return F.try_to_timestamp(F.initcap(F.split_part(_col(text), F.lit("."), F.lit(1))), F.lit("dd-MMM-yyyy;HH:mm:ss")).cast("timestamp_ntz")


def snapshot_name(ts: Column | str) -> Column:
    return F.date_format(_col(ts), "yyyy-MM-dd'T'HH-mm-ss'Z'")


def snapshot_time(name: Column | str) -> Column:
    return F.try_to_timestamp(_col(name), F.lit("yyyy-MM-dd'T'HH-mm-ss'Z'")).cast("timestamp_ntz")


def plus_minutes(ts: Column | str, minutes: Column) -> Column:
    return _col(ts) + F.make_dt_interval(F.lit(0), F.lit(0), minutes.cast("int"), F.lit(0))


def epoch_seconds(ts: Column | str) -> Column:
    """Seconds since 1970 of a time, a time without zone taken as UTC."""
    return F.unix_seconds(_col(ts).cast("timestamp"))


def lead_minutes(frame: Column | str, issue: Column | str) -> Column:
    """Whole minutes from issue to frame, rounded down (also before the issue)."""
    micros = F.unix_micros(_col(frame).cast("timestamp")) - F.unix_micros(_col(issue).cast("timestamp"))
    return F.floor(micros / 60e6).cast("long")


def rounded_lead_minutes(valid: Column | str, issue: Column | str) -> Column:
    """Minutes from issue to valid, halves to even."""
    return F.bround((epoch_seconds(valid) - epoch_seconds(issue)) / 60.0, 0).cast("long")


def floor_time(ts: Column | str, seconds: int) -> Column:
    """The start of the bucket of ``seconds`` that holds ts."""
    return F.timestamp_seconds(F.floor(epoch_seconds(ts) / seconds) * seconds).cast("timestamp_ntz")


def duration_seconds(text: Column | str) -> Column:
    """Seconds of an ISO-8601 duration P..DT..H..M..S; NULL for anything else."""
    t = _col(text)
    part = lambda p: F.coalesce(F.regexp_extract(t, p, 1).try_cast("long"), F.lit(0).cast("long"))
    total = part(r"P(\d+)D") * 86400 + part(r"T(?:.*?)(\d+)H") * 3600 + part(r"T(?:.*?)(\d+)M") * 60 + part(r"T(?:.*?)(\d+)S")
    return F.when(t.rlike(r"^P(\d+D)?(T(\d+H)?(\d+M)?(\d+S)?)?$") & t.rlike(r"\d"), total)


def interval_label_minutes(label: Column | str) -> Column:
    """Minutes of a cadence label, 10 where unknown."""
    return F.when(_col(label) == "5min", 5).when(_col(label) == "15min", 15).otherwise(10)


def day_cycle(ts: Column | str) -> tuple[Column, Column]:
    """sin and cos of the time of day."""
    angle = 2 * math.pi * (F.hour(_col(ts)) + F.minute(_col(ts)) / 60.0) / 24.0
    return F.sin(angle), F.cos(angle)


def clock_label(ts: Column | str, zone: str) -> Column:
    """A UTC time as HH:mm in a zone."""
    return F.date_format(F.from_utc_timestamp(_col(ts).cast("timestamp"), zone), "HH:mm")


# ---- text and hashes


def csv_list(text: Column | str) -> Column:
    """Trimmed non-blank parts between commas."""
    return F.filter(F.transform(F.split(_col(text), ","), lambda x: F.trim(x)), lambda x: x != "")


def absolute_url(base: Column, url: Column) -> Column:
    """url if it is absolute, else base/url with one slash."""
    joined = F.concat(F.regexp_replace(base, "/+$", ""), F.lit("/"), F.regexp_replace(url, "^/+", ""))
    return F.when(url.startswith("http://") | url.startswith("https://"), url).otherwise(joined)


def overlay_url(band: Column, lead: Column, snapshot: Column) -> Column:
    return F.format_string("/v1/overlay/%s/%d.png?t=%s", band, lead, snapshot)


def signed_key(salt: str, method: Column, day: Column) -> Column:
    """md5 of 'salt;method;dd/MM/yyyy'; the salt comes from configuration."""
    return F.md5(F.concat_ws(";", F.lit(salt), method, F.date_format(day, "dd/MM/yyyy")).cast("binary"))


def digest(data: Column | str) -> Column:
    return F.sha2(_col(data).cast("binary"), 256)


def headline(minutes: Column) -> Column:
    return F.when(minutes.isNull(), "dry").when(minutes <= 0, "raining").otherwise(F.concat(F.lit("in "), minutes.cast("string"), F.lit(" min")))


def failure_kind(status: Column | str) -> Column:
    """Class of a transport status: a number, 'timeout', 'offline' or 'cancelled'."""
    s = _col(status)
    code = s.try_cast("int")
    return F.when(s == "timeout", "timeout").when(s == "offline", "network").when(s == "cancelled", "cancelled").when(code.between(400, 499), "client").when(code >= 500, "server").otherwise("unknown")


# ---- what clients show

# Colour and label of each level.
LEVEL_STYLES = {"light": ("#9ECAE1", "Light"), "moderate": ("#3182BD", "Moderate"), "heavy": ("#FD8D3C", "Heavy"), "violent": ("#E31A1C", "Violent")}


def level_style(level: Column | str) -> Column:
    """struct<colour, label> of an intensity level; a dash and no colour for none."""
    colour, label = F.lit(None).cast("string"), F.lit("\u2013")
    for name, (c, text) in LEVEL_STYLES.items():
        colour, label = F.when(_col(level) == name, c).otherwise(colour), F.when(_col(level) == name, text).otherwise(label)
    return F.struct(colour.alias("colour"), label.alias("label"))


def frame_at(frames: Column | str, index: Column | str) -> Column:
    """The frame at an index from 0; NULL beyond the ends and for no frames."""
    i = _col(index).cast("int")
    return F.when(i >= 0, F.get(_col(frames), i))


def next_frame(index: Column | str, n: Column | str) -> Column:
    """Playback in a loop: the index after this one; NULL without frames."""
    return F.when(_col(n) > 0, F.pmod(_col(index) + 1, _col(n)))


def bar_height(rate: Column | str, largest: Column | str, floor: float = 0.5) -> Column:
    """A rate's share of a chart whose scale ends at the largest rate, or at ``floor`` if that is less."""
    return F.greatest(F.nanvl(_col(rate), F.lit(0.0)), F.lit(0.0)) / F.greatest(_col(largest), F.lit(floor))


def rounded_coordinate(degrees: Column | str, digits: int = 6) -> Column:
    return F.round(_col(degrees).cast("double"), digits)


def or_default(value: Column | str, default) -> Column:
    """The value, or the default where there is none."""
    return F.coalesce(_col(value), default if isinstance(default, Column) else F.lit(default))


def suffix_stamp(name: Column | str) -> Column:
    """Time from a name's last part after an underscore, yyyyMMddTHHmm with or without seconds and a Z; NULL if it is none."""
    last = F.element_at(F.split(F.regexp_replace(_col(name), r"\.[A-Za-z0-9]+$", ""), "_"), -1)
    digits = F.rpad(F.translate(F.rtrim(last, F.lit("Z")), "T-:", ""), 14, "0")
    return F.when(digits.rlike("^[0-9]{14}$"), F.try_to_timestamp(digits, F.lit("yyyyMMddHHmmss")).cast("timestamp_ntz"))
