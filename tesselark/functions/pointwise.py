"""Scalar maps of planes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the psychovisual curves.
CLAMP_SLOPE = 0.724216145665
SUPPRESS, SUPPRESS_LEAST = 46.0, 0.653020556257
INTENSITY = 0.79079917404
MASK_Y = (17.83, 2.5485944793, 0.451936922203, 0.829591754942)
MASK_DC_Y = (17.83, 0.505054525019, 3.87449418804, 0.20025578522)
MASK_BASE, MASK_SCALE = -0.7647, 0.80061762862741759
MASK_TERMS = (9.4708735624378946, 17.35036561631863, 6.7943250517376494)
MASK_OFFSET_2, MASK_OFFSET_3 = 302.59587815579727, 3.7179635626140772
SQRT_OFFSET, SQRT_SCALE = 27.505837037000106, 211.66567973503678
TOWARDS_ZERO = 2.6


def affine(v: Column, scale: float, bias: float) -> Column:
    return v * F.lit(float(scale)) + F.lit(float(bias))


def pack_signed(v: Column) -> Column:
    """0, -1, 1, -2, 2 ... as 0, 1, 2, 3, 4 ..."""
    return F.when(v >= 0, 2 * v).otherwise(-2 * v - 1)


def unpack_signed(u: Column) -> Column:
    return F.when(u % 2 == 0, F.shiftright(u, 1)).otherwise(-F.shiftright(u + 1, 1))


def bit_width(v: Column) -> Column:
    """Bits of a non-negative integer; 0 for 0."""
    return F.when(v > 0, F.length(F.bin(v))).otherwise(0).cast("long")


def hybrid_uint(v: Column, split: int = 4, msb: int = 2, lsb: int = 0) -> Column:
    """struct(symbol, extra_count, extra) of a non-negative integer.

    Values under 2**split are symbols; above, the symbol holds the exponent and
    the highest ``msb`` and lowest ``lsb`` mantissa bits.
    """
    e = bit_width(v) - 1

    def shift(x: Column, n: Column) -> Column:
        return F.call_function("shiftright", x, n.cast("int"))

    mantissa = v - F.call_function("shiftleft", F.lit(1).cast("long"), e.cast("int"))
    symbol = (1 << split) + F.shiftleft(e - split, msb + lsb) + F.shiftleft(shift(mantissa, e - msb), lsb) + mantissa.bitwiseAND(F.lit((1 << lsb) - 1).cast("long"))
    count = e - msb - lsb
    extra = F.shiftright(v, lsb).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), count.cast("int")) - 1)
    small = v < (1 << split)
    zero = F.lit(0).cast("long")
    return F.struct(F.when(small, v).otherwise(symbol).alias("symbol"), F.when(small, zero).otherwise(count).alias("extra_count"), F.when(small, zero).otherwise(extra).alias("extra"))


def mirror(i: Column, n: int | Column) -> Column:
    """Reflects an index into [0, n), the edge sample repeated."""
    n = n if isinstance(n, Column) else F.lit(n)
    m = F.pmod(i, 2 * n)
    return F.when(m < n, m).otherwise(2 * n - 1 - m)


def adjust_quantization_bias(q: Column, unit: float, rest: float) -> Column:
    """0 stays, 1 and -1 become +-unit, others lose rest / q."""
    return F.when(q == 0, 0.0).when(F.abs(q) == 1, F.signum(q.cast("double")) * unit).otherwise(q - F.lit(rest) / q)


def maximum_clamp(v: Column, most: float) -> Column:
    return F.when(v >= most, (v - most) * CLAMP_SLOPE + most).when(v < -most, (v + most) * CLAMP_SLOPE - most).otherwise(v)


def remove_range(v: Column, width: float) -> Column:
    return F.when(v > width, v - width).when(v < -width, v + width).otherwise(0.0)


def amplify_range(v: Column, width: float) -> Column:
    return F.when(v > width, v + width).when(v < -width, v - width).otherwise(v + v)


def suppress_x_by_y(y: Column, x: Column) -> Column:
    return x * (F.lit(SUPPRESS) / (y * y + SUPPRESS) * (1 - SUPPRESS_LEAST) + SUPPRESS_LEAST)


def rational_mask(delta: Column, constants: tuple[float, float, float, float]) -> Column:
    """Squared rational masking curve; constants as in MASK_Y and MASK_DC_Y."""
    scale, multiplier, scaler, offset = constants
    v = F.lit(1.0 / (scale * INTENSITY)) * (1.0 + F.lit(multiplier) / (F.lit(scaler) * delta + offset))
    return v * v


def block_mask(v: Column) -> Column:
    """Sum of three rational terms of a block's activity."""
    v1 = F.greatest(v * MASK_SCALE, F.lit(1e-3))
    k4, k2, k3 = MASK_TERMS
    square = v1 * v1
    return MASK_BASE + F.lit(k4) / (square + 0.25 * MASK_OFFSET_3) + F.lit(k2) / (v1 + MASK_OFFSET_2) + F.lit(k3) / (square + MASK_OFFSET_3)


def masking_sqrt(v: Column) -> Column:
    return 0.25 * F.sqrt(v * (SQRT_SCALE * 1e8) ** 0.5 + SQRT_OFFSET)


def quantize_multiplier(x: Column) -> Column:
    """Shrinks towards zero by 2.6, rounds half away from zero, keeps 8 bits."""
    shrunk = F.when(x >= TOWARDS_ZERO, x - TOWARDS_ZERO).when(x <= -TOWARDS_ZERO, x + TOWARDS_ZERO).otherwise(0.0)
    return F.least(F.greatest(F.round(shrunk), F.lit(-128.0)), F.lit(127.0)).cast("int")


def error_multiplier(e: Column) -> Column:
    """Doubles errors under a half, keeps those above 1, else 1; null for what is no error."""
    bad = F.isnan(e) | (F.abs(e) == float("inf")) | (e < 0)
    return F.when(bad, F.lit(None).cast("double")).when(e < 0.5, e * 2).when(e > 1, e).otherwise(1.0)


def distance_from_quality(q: Column) -> Column:
    return F.when(q >= 100, 0.0).when(q >= 30, 0.1 + (100 - q) * 0.09).otherwise(53.0 / 3000 * q * q - 23.0 / 20 * q + 25.0)


def srgb_to_linear(byte: Column) -> Column:
    """Linear light of an 8-bit sRGB sample."""
    v = byte / F.lit(255.0)
    return F.when(v <= 0.04045, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, F.lit(2.4)))


def _half(v: Column) -> Column:
    return F.shiftright(v, 1)


#: The reversible transforms as lifting steps (channel, sign, what of the others is added), then the order of the channels that come out.
_SECOND = {0: [], 1: [(1, -1, lambda s: s[0])], 2: [(1, -1, lambda s: _half(s[0] + s[2]))]}
_THIRD = {0: [], 1: [(2, -1, lambda s: s[0])]}
_LIFTING = {2 * second + third: (_SECOND[second] + _THIRD[third], (0, 1, 2)) for second in _SECOND for third in _THIRD}
_LIFTING[6] = ([(0, -1, lambda s: s[2]), (2, 1, lambda s: _half(s[0])), (1, -1, lambda s: s[2]), (2, 1, lambda s: _half(s[1]))], (2, 0, 1))


def _permutation(p: int) -> tuple[int, int, int]:
    """Which channels come first, second and third: three rotations, then three with the last two swapped."""
    turn, swapped = p % 3, p // 3
    rest = [(turn + 1) % 3, (turn + 2) % 3]
    return (turn, *(rest[::-1] if swapped else rest))


def forward_rct(a: Column, b: Column, c: Column, kind: int) -> tuple[Column, Column, Column]:
    """Reversible integer colour transform: ``kind`` is 7 * permutation + transform (0 to 6)."""
    steps, order = _LIFTING[kind % 7]
    s = [(a, b, c)[i] for i in _permutation(kind // 7)]
    for at, sign, amount in steps:
        s[at] = s[at] + sign * amount(s)
    return tuple(s[i] for i in order)


def inverse_rct(a: Column, b: Column, c: Column, kind: int) -> tuple[Column, Column, Column]:
    """The same steps from the last to the first, each with the other sign."""
    steps, order = _LIFTING[kind % 7]
    s = [(a, b, c)[order.index(i)] for i in range(3)]
    for at, sign, amount in reversed(steps):
        s[at] = s[at] - sign * amount(s)
    places = _permutation(kind // 7)
    return tuple(s[places.index(i)] for i in range(3))


# Fixed values of the opponent colour space: mixing matrix, its inverse, bias.
OPSIN = ((0.30, 0.622, 0.078), (0.23, 0.692, 0.078), (0.24342268924547819, 0.20476744424496821, 0.55180986650955360))
OPSIN_INVERSE = ((11.031566901960783, -9.866943921568629, -0.16462299647058826), (-3.254147380392157, 4.418770392156863, -0.16462299647058826), (-3.6588512862745097, 2.7129230470588235, 1.9459282392156863))
OPSIN_BIAS = 0.0037930732552754493


def linear_to_opsin(r: Column, g: Column, b: Column, intensity: float = 255.0) -> tuple[Column, Column, Column]:
    """Opponent channels (x, y, b) of linear light: mix, add the bias, cube root, difference and mean."""
    scale, root = intensity / 255.0, OPSIN_BIAS ** (1 / 3)
    p, q, s = (F.cbrt(F.greatest(F.lit(0.0), r * (scale * m[0]) + g * (scale * m[1]) + b * (scale * m[2]) + OPSIN_BIAS)) - root for m in OPSIN)
    return 0.5 * (p - q), 0.5 * (p + q), s


def opsin_to_linear(x: Column, y: Column, b: Column, intensity: float = 255.0) -> tuple[Column, Column, Column]:
    scale, root = 255.0 / intensity, OPSIN_BIAS ** (1 / 3)
    p, q, s = (c * c * c - OPSIN_BIAS for c in (y + x + root, y - x + root, b + root))
    return tuple(p * (scale * m[0]) + q * (scale * m[1]) + s * (scale * m[2]) for m in OPSIN_INVERSE)
