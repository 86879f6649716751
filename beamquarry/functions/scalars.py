"""Scalar expressions: int4 codes, steering phases, power, quantizer, dispersion, antenna gain."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from beamquarry.model import BLOCK_ANTENNAS, INVALID_CODE, LIGHT_M_S, LOCAL_CHANNELS, MAX_CODE, MIN_CODE

#: Dispersion constant in s MHz^2 cm^3 / pc; antenna anchors Hz -> (E width, H width in degrees, gain in dBi).
DISPERSION = 4148.808
ANTENNA_SPECS = {300e6: (92.0, 66.0, 8.7), 400e6: (108.0, 74.0, 7.75), 500e6: (120.0, 87.0, 7.0)}


def finite(x: Column) -> Column:
    """Neither null, NaN nor infinite; Spark orders NaN above infinity."""
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


# --- int4 codes: the low nibble is real, the high nibble imaginary


def nibble(bits: Column) -> Column:
    low = bits.bitwiseAND(F.lit(15))
    return F.when(low < 8, low).otherwise(low - 16)


def unpack_re(byte: Column) -> Column:
    return nibble(byte)


def unpack_im(byte: Column) -> Column:
    return nibble(F.shiftrightunsigned(byte, 4))


def pack(re: Column, im: Column) -> Column:
    """Exact packing: a component outside [-8, 7] is an error."""
    bad = (re < -8) | (re > 7) | (im < -8) | (im > 7)
    packed = re.cast("int").bitwiseAND(F.lit(15)).bitwiseOR(F.shiftleft(im.cast("int").bitwiseAND(F.lit(15)), 4))
    return F.when(bad, F.raise_error(F.lit("int4 component outside [-8, 7]")).cast("int")).otherwise(packed)


def pack_clipped(re: Column, im: Column) -> Column:
    """Packing of noisy samples: rounded half to even and clipped to [-7, 7]."""
    a, b = (F.greatest(F.lit(-7), F.least(F.lit(7), F.rint(x).cast("int"))) for x in (re, im))
    return a.bitwiseAND(F.lit(15)).bitwiseOR(F.shiftleft(b.bitwiseAND(F.lit(15)), 4))


# --- linear positions, for files only


def voltage_index(t: Column, f: Column, a: Column, n_freq: int, n_ant: int) -> Column:
    return (t * n_freq + f) * n_ant + a


def weight_index(b: Column, f: Column, a: Column, n_freq: int, n_ant: int) -> Column:
    return (b * n_freq + f) * n_ant + a


def tiled_weight_index(b: Column, f: Column, a: Column, n_beams: int, n_ant: int, tile: int = 32) -> Column:
    tiles = -(-n_beams // tile)
    return ((f * tiles + F.floor(b / tile)) * n_ant + a) * tile + b % tile


def intensity_index(t: Column, f: Column, b: Column, n_freq: int, n_beams: int) -> Column:
    return (t * n_freq + f) * n_beams + b


def digitizer_element(block: Column, element: Column, n_ant: int) -> Column:
    """Position of a block's element in the output order, in which blocks are reversed."""
    return (F.lit(n_ant // BLOCK_ANTENNAS) - 1 - block) * BLOCK_ANTENNAS + element


def absolute_channel(start: Column, f: Column) -> Column:
    return start + f


def full_band_channel(shard: Column, f: Column) -> Column:
    return shard * LOCAL_CHANNELS + f


# --- steering


def phase(hz: Column, x: Column, y: Column, z: Column, l: Column, m: Column, n: Column) -> Column:  # noqa: E741
    return F.lit(2 * math.pi / LIGHT_M_S) * hz * (x * l + y * m + z * n)


def unit_n(l: Column, m: Column) -> Column:  # noqa: E741
    inside = 1.0 - l * l - m * m
    return F.when(inside >= 0, F.sqrt(inside)).otherwise(F.raise_error(F.lit("direction outside the unit disk")).cast("double"))


def power(re: Column, im: Column) -> Column:
    return re * re + im * im


def lm_distance(l1: Column, m1: Column, l2: Column, m2: Column) -> Column:
    return F.hypot(l1 - l2, m1 - m2)


def pointing_error_arcmin(l1: Column, m1: Column, l2: Column, m2: Column) -> Column:
    return F.degrees(lm_distance(l1, m1, l2, m2)) * 60


def sinc2(x: Column) -> Column:
    """(sin pi x / pi x)^2, 1 at 0."""
    z = F.lit(math.pi) * x
    return F.when(x == 0, F.lit(1.0)).otherwise(F.pow(F.sin(z) / z, F.lit(2.0)))


# --- quantizer


def quantize(value: Column, offset: Column, scale: Column) -> Column:
    """int8 code: -128 for a value that is not finite, 0 for a flat tile, else the nearest step (half to even)."""
    step = F.rint((value - offset) / F.when(scale != 0, scale))
    code = F.greatest(F.lit(float(MIN_CODE)), F.least(F.lit(float(MAX_CODE)), step))
    return F.when(~finite(value), F.lit(INVALID_CODE)).when(scale == 0, F.lit(0)).otherwise(code.cast("int")).cast("tinyint")


def dequantize(code: Column, offset: Column, scale: Column) -> Column:
    return F.when(code == INVALID_CODE, F.lit(float("nan"))).otherwise(offset + scale * code)


# --- dispersion


def dispersion_delay(dm: Column, hz: Column, ref_hz: float = 800e6) -> Column:
    """Seconds by which a channel lags the reference frequency."""
    return F.lit(DISPERSION) * dm * (F.pow(hz / 1e6, F.lit(-2.0)) - (ref_hz / 1e6) ** -2.0)


def spectral_law(hz: Column, index: Column, running: Column, ref_hz: float = 800e6) -> Column:
    ratio = hz / ref_hz
    return F.pow(ratio, index + running * F.log(ratio))


# --- display and rates


def normalized_db(value: Column, reference: Column, floor_db: float = -80.0) -> Column:
    ratio = F.greatest(F.try_divide(value, reference), F.lit(10 ** (floor_db / 10)))
    return F.when(reference > 0, 10 * F.log10(ratio)).otherwise(F.lit(floor_db))


def antenna_spec(hz: Column, which: int) -> Column:
    """E width, H width or gain (0, 1, 2) between the anchors on straight lines, which go on beyond them."""
    at = sorted(ANTENNA_SPECS)
    lines = []
    for low, high in zip(at, at[1:], strict=False):
        a, b = ANTENNA_SPECS[low][which], ANTENNA_SPECS[high][which]
        lines.append(F.lit(a) + (hz - low) * ((b - a) / (high - low)))
    out = lines[-1]
    for edge, line in zip(reversed(at[1:-1]), reversed(lines[:-1]), strict=True):
        out = F.when(hz < edge, line).otherwise(out)
    return out


def element_gain(l: Column, m: Column, hz: Column) -> Column:  # noqa: E741
    """Gaussian gain of one antenna, with the gain at the centre from its specification."""
    per_width = 1 / (2 * math.sqrt(2 * math.log(2)))
    sigma_e, sigma_h = (F.radians(antenna_spec(hz, k)) * per_width for k in (0, 1))
    peak = F.pow(F.lit(10.0), antenna_spec(hz, 2) / 10)
    return peak * F.exp(-(l * l / (2 * sigma_h * sigma_h) + m * m / (2 * sigma_e * sigma_e)))


def visible(l: Column, m: Column, value: Column) -> Column:  # noqa: E741
    return F.when(l * l + m * m <= 1, value).otherwise(F.lit(float("nan")))


def rates(outputs: Column, n_ant: Column, seconds: Column) -> dict[str, Column]:
    """Outputs, complex multiplications and operations a second (8 for a multiplication and addition, 3 for a power)."""
    cmac = outputs * n_ant
    return {
        "outputs_per_s": F.try_divide(outputs, seconds),
        "gmac_per_s": F.try_divide(cmac, seconds * 1e9),
        "flop_per_s": F.try_divide(8 * cmac + 3 * outputs, seconds),
    }
