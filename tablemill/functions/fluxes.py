"""Fluxes, luminosities and magnitudes."""

import math

from pyspark.sql import Column, functions as F

from .blanks import as_column

# Approximate offsets from AB magnitudes, from Frei & Gunn 1994 (AJ 108, 1476), table 2.
JOHNSON_AB = {
    "V": 0.044,
    "B": 0.163,
    "Bj": 0.139,
    "R": -0.055,
    "I": -0.309,
    "g": 0.013,
    "r": 0.226,
    "i": 0.296,
    "Rc": -0.117,
    "Ic": -0.342,
    "uPrime": 0.0,
    "gPrime": 0.0,
    "rPrime": 0.0,
    "iPrime": 0.0,
    "zPrime": 0.0,
}

# Approximate offsets of Vega from AB magnitudes, from Blanton et al. 2005 (AJ 129, 2562),
# equations 5.
VEGA_AB = {"J": -0.91, "H": -1.39, "K": -1.85}


def ab_to_jansky(magnitude) -> Column:
    return F.pow(F.lit(10.0), 23.0 - (as_column(magnitude) + 48.6) / 2.5)


def jansky_to_ab(flux) -> Column:
    return 2.5 * (23.0 - F.log10(as_column(flux))) - 48.6


def luminosity_to_flux(luminosity, distance) -> Column:
    distance = as_column(distance)
    return as_column(luminosity) / (4 * math.pi * distance * distance)


def flux_to_luminosity(flux, distance) -> Column:
    distance = as_column(distance)
    return 4 * math.pi * distance * distance * as_column(flux)


def johnson_from_ab(magnitude, band: str) -> Column:
    return as_column(magnitude) + JOHNSON_AB[band]


def vega_from_ab(magnitude, band: str) -> Column:
    return as_column(magnitude) + VEGA_AB[band]


def distance_to_modulus(distance_pc) -> Column:
    return 5.0 * F.log10(as_column(distance_pc)) - 5.0


def modulus_to_distance(modulus) -> Column:
    return F.pow(F.lit(10.0), 1.0 + as_column(modulus) / 5.0)
