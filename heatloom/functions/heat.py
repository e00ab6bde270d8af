"""Heat index, humidity and mortality expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from heatloom import constants as C
from heatloom.functions.basic import clamp

# Regression terms of the heat index in degrees Fahrenheit, as
# (coefficient, power of temperature, power of humidity).
ROTHFUSZ_TERMS = [
    (-42.379, 0, 0),
    (2.04901523, 1, 0),
    (10.14333127, 0, 1),
    (-0.22475541, 1, 1),
    (-0.00683783, 2, 0),
    (-0.05481717, 0, 2),
    (0.00122874, 2, 1),
    (0.00085282, 1, 2),
    (-0.00000199, 2, 2),
]
MAGNUS_A, MAGNUS_B = 17.625, 243.04


def heat_index(t_c: Column, rh: Column) -> Column:
    """Apparent temperature in degrees C; the air temperature itself up to 27 degrees."""
    f = t_c * 9.0 / 5.0 + 32.0

    def term(coef: float, pt: int, ph: int) -> Column:
        out = F.lit(coef)
        for base, power in ((f, pt), (rh, ph)):
            for _ in range(power):
                out = out * base
        return out

    total = term(*ROTHFUSZ_TERMS[0])
    for t in ROTHFUSZ_TERMS[1:]:
        total = total + term(*t)
    return F.when(t_c > C.HEAT_INDEX_FROM_C, (total - 32.0) * 5.0 / 9.0).otherwise(t_c)


def dewpoint_to_rh(t_c: Column, td_c: Column) -> Column:
    """Relative humidity in percent from temperature and dew point, within [0, 100]."""
    ratio = F.exp(MAGNUS_A * td_c / (MAGNUS_B + td_c)) / F.exp(MAGNUS_A * t_c / (MAGNUS_B + t_c))
    return clamp(100.0 * ratio, 0.0, 100.0)


def attributable_fraction(
    t: Column, mmt: Column, hvi: Column, beta: Column, lam: Column | float = C.LAMBDA_HVI
) -> Column:
    """Share of deaths due to heat: (RR - 1) / RR with RR = exp(beta * excess) * (1 + lambda * HVI)."""
    lam = lam if isinstance(lam, Column) else F.lit(float(lam))
    excess = F.when(t.isNotNull() & mmt.isNotNull(), F.greatest(F.lit(0.0), t - mmt))
    rr = F.exp(beta * excess) * (1.0 + lam * hvi)
    return clamp((rr - 1.0) / rr, 0.0, 1.0)


def attributable_deaths(population: Column, cdr: Column, af: Column, days: Column | float) -> Column:
    days = days if isinstance(days, Column) else F.lit(float(days))
    return clamp(population * cdr * af * days, 0.0, None)
