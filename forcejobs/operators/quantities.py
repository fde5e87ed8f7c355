"""Per-trial quantities from placed landmarks: times, heights, impulses, rates, power, work and their normalised forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import cols as c
from ..functions import traces as T
from ..functions.scans import motion, ramp
from .landmarks import GRAVITY

#: Published populations of peak power from jump height (watts): per unit of height, height unit in metres, per kilogram, constant.
POWER_REGRESSIONS = {
    "harman1991": (61.9, 0.01, 36.0, -1822.0),
    "sayers1999_squat_jump": (60.7, 0.01, 45.3, -2055.0),
    "sayers1999_countermovement": (51.9, 0.01, 48.9, -2007.0),
    "shetty2002": (1925.72, 1.0, 14.74, -666.3),
    "canavan2004": (65.1, 0.01, 25.8, -1413.1),
    "lara2006_male_sport_science": (62.5, 0.01, 50.3, -2184.7),
    "lara2006_female_elite_volleyball": (83.1, 0.01, 42.0, -2488.0),
    "lara2006_female_medium_volleyball": (53.6, 0.01, 67.5, -2624.1),
    "lara2006_female_sport_science": (56.7, 0.01, 47.2, -1772.6),
    "lara2006_female_university": (68.2, 0.01, 40.8, -1731.1),
}

def acceleration(g: float = GRAVITY) -> Column:
    return F.transform(c.force, lambda x: (x - c.weight) / (c.weight / g))


def with_motion(placed: DataFrame, g: float = GRAVITY, rule: str = "trapezoid") -> DataFrame:
    """Adds velocity and displacement arrays, zero up to onset, and net_power."""
    d = placed.withColumn("_m", motion(rule, g)(c.force, c.weight, c.onset, c.dt))
    return d.withColumns({x: F.col(f"_m.{x}") for x in ("velocity", "displacement", "net_power")}).drop("_m")


def impulse(force: Column, start: Column, end: Column, offset: Column | float = 0.0) -> Column:
    """Trapezoid area of force less offset over samples start..end, both inside."""
    return T.area(force, offset, start, end, c.dt)


def takeoff_velocity(g: float = GRAVITY) -> Column:
    """Velocity at the last sample in contact: the net impulse from onset over the mass."""
    return F.when(c.ordered, impulse(c.force, c.onset, c.last, c.weight) / (c.weight / g))


def default_quantities(placed: DataFrame, g: float = GRAVITY) -> DataFrame:
    """The eleven quantities that are always computed; net_impulse is that of place(pushed=True), where it is there."""
    d = placed
    if "net_impulse" not in d.columns:
        d = d.withColumn("net_impulse", F.when(c.ordered, impulse(c.force, c.onset, c.last, c.weight)))
    d = d.withColumns(
        {
            "system_mass": c.weight / g,
            "onset_time": c.onset * c.dt,
            "takeoff_time": c.takeoff * c.dt,
            "time_to_takeoff": F.when(c.ordered, (c.takeoff - c.onset) * c.dt),
            "flight_time": (c.touchdown - c.takeoff) * c.dt,
            "takeoff_velocity": F.col("net_impulse") / (c.weight / g),
        }
    )
    d = d.withColumns(
        {
            "height_takeoff": F.pow("takeoff_velocity", F.lit(2)) / (2 * g),
            "height_flight": g * F.pow("flight_time", F.lit(2)) / 8,
        }
    )
    return d.withColumn("rsi_modified", F.when(F.col("time_to_takeoff") > 0, F.col("height_takeoff") / F.col("time_to_takeoff")))


def level_crossing(values: Column, level: Column, start: Column, end: Column) -> Column:
    """Interpolated position of the first sample at or over level in start..end."""
    i = T.find(values, ">=", level, start, end + 1)
    before = A.at(values, i - 1)
    return F.when(i == start, i.cast("double")).otherwise((i - 1) + (level - before) / (A.at(values, i) - before))


def centred_derivative(values: Column, position: Column, dt: Column) -> Column:
    """Central difference at a position between samples."""
    low = F.floor(position).cast("int")
    slope = lambda i: (A.at(values, i + 1) - A.at(values, i - 1)) / (2 * dt)
    value = slope(low) + (F.coalesce(slope(low + 1), F.when(position == low, slope(low))) - slope(low)) * (position - low)
    return F.when(position >= 1, value)


def steepest_chord(values: Column, width: int, start: Column, end: Column, dt: Column) -> Column:
    """Greatest rise over `width` samples in start..end, per second."""
    return T.steepest(values, width, start, end)["rise"] / (width * dt)


def rise(values: Column, start: Column, end: Column, dt: Column) -> Column:
    return (A.at(values, end) - A.at(values, start)) / ((end - start) * dt)


def moving_average(values: Column, width: int) -> Column:
    """Boxcar mean, centred for an odd width; the ends hold the mean of the end window."""
    return T.moving_average(values, width)


def ramp_to_impulse(placed: DataFrame, rule: str = "trapezoid", g: float = GRAVITY) -> DataFrame:
    """Adds ramp_residual and ramped, a velocity put right by a line so that it is zero at onset and the impulse's at takeoff.

    velocity is integrated by a rule from onset; the residual is what the impulse over onset..takeoff (both samples
    inside), divided by mass once, has more at takeoff. It is spread evenly over the movement and stays after it. Null
    where onset does not lie before takeoff.
    """
    d = placed.withColumn("_r", ramp(rule, g)(c.force, c.weight, c.onset, c.takeoff, c.dt))
    return d.withColumns({"ramp_residual": F.col("_r.residual"), "ramped": F.col("_r.ramped")}).drop("_r")


#: Published shares of stature, of the ankle's height, the foot's length, and of the foot ahead of the ankle.
ANKLE_HEIGHT, FOOT_LENGTH, AHEAD_OF_ANKLE = 0.039, 0.152, 0.787


def ankle_shift(trials: DataFrame, markers: DataFrame, statures: DataFrame) -> DataFrame:
    """Adds ankle_shift, how far a jumper lands below takeoff, in metres, from markers of the foot.

    markers(trial_id, event, knee_x, knee_y, ankle_x, ankle_y, toe_x, toe_y) has a row for takeoff and one for landing, in
    the plane of the movement; statures(subject, stature). The foot's lean over the shank, less its lean in quiet
    standing (a right angle), is the ankle's angle; the body rides on the segment from toe to ankle, whose length and
    standing lean are shares of stature, and the shift is the difference of its two heights. Markers that are missing,
    repeated for an event or no numbers, and athletes without a stature, give null. Markers of a trial are put into one
    row before they join it.
    """
    angle = lambda x, y: F.degrees(F.atan2(F.col(y), F.col(x)))
    d = markers.withColumns({"sx": F.col("knee_x") - F.col("ankle_x"), "sy": F.col("knee_y") - F.col("ankle_y"), "fx": F.col("toe_x") - F.col("ankle_x"), "fy": F.col("toe_y") - F.col("ankle_y")})
    bend = angle("sx", "sy") - angle("fx", "fy") - 90.0
    d = d.select("trial_id", "event", F.when(~F.isnan(bend), bend).alias("bend"))
    one = lambda e: F.when(F.count(F.when(F.col("event") == e, 1)) == 1, F.max(F.when(F.col("event") == e, F.col("bend"))))
    d = d.groupBy("trial_id").agg(one("takeoff").alias("_off"), one("landing").alias("_on"))
    rise, reach = ANKLE_HEIGHT * F.col("stature"), FOOT_LENGTH * AHEAD_OF_ANKLE * F.col("stature")
    leant = F.degrees(F.atan2(F.lit(ANKLE_HEIGHT), F.lit(FOOT_LENGTH * AHEAD_OF_ANKLE)))
    height = lambda x: F.hypot(rise, reach) * F.sin(F.radians(F.col(x) + leant))
    out = trials.join(d, "trial_id", "left").join(statures.select("subject", "stature"), "subject", "left")
    return out.withColumn("ankle_shift", height("_off") - height("_on")).drop("_off", "_on", "stature")


def height_with_shift(flight_time: Column, shift: Column, g: float = GRAVITY) -> Column:
    """Height of a flight that ends `shift` below where it began."""
    flight = g * flight_time * flight_time
    return F.when(flight_time > 0, flight / 8 * F.pow(1 - 2 * shift / flight, F.lit(2)))
