"""Column functions for numbers, text, time stamps, configuration strings and nested documents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(x: Column) -> Column:
    """NaN and infinities become null; the form in which every metric is aggregated."""
    d = x.cast("double")
    return F.when(F.isnan(d) | (F.abs(d) == F.lit(float("inf"))), F.lit(None)).otherwise(d)


def clip(x: Column, low: float | Column, high: float | Column) -> Column:
    """Limited to [low, high]; null stays null."""
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.when(x.isNotNull(), F.least(F.greatest(x, as_col(low)), as_col(high)))


def round_even(x: Column, digits: int = 0) -> Column:
    """Half-even rounding of the decimal rendering."""
    return F.bround(x, digits)


def safe_ratio(num: Column, den: Column, least: float) -> Column:
    """num / max(den, least): a quotient that never divides by zero."""
    return num / F.greatest(den, F.lit(least))


def guarded(value: Column, count: Column, more_than: int) -> Column:
    """An aggregate that is null unless more than so many samples support it."""
    return F.when(count > more_than, value)


def timestamp_ms(text: Column) -> Column:
    """``YYYY-mm-dd.HH:MM:SS.ms`` where the last part counts milliseconds and is not padded: .22 is 22 ms."""
    base = F.try_to_timestamp(F.regexp_extract(text, r"^(\d{4}-\d\d-\d\d\.\d\d:\d\d:\d\d)", 1), F.lit("yyyy-MM-dd.HH:mm:ss"))
    ms = F.regexp_extract(text, r":\d\d\.(\d+)$", 1).try_cast("long")
    return F.timestamp_micros(F.unix_micros(base) + F.coalesce(ms, F.lit(0)) * 1000)


def split_name(name: Column, sep: str = "+") -> tuple[Column, Column]:
    """(before, after) the first separator; after is empty where there is none."""
    at = F.instr(name, F.lit(sep))
    return (F.when(at > 0, F.substring(name, F.lit(1), at - 1)).otherwise(name), F.when(at > 0, F.substring(name, at + 1, F.length(name))).otherwise(F.lit("")))


def variant_title(title: Column, variant: Column, titles: dict[str, str]) -> Column:
    """Title of a clip with its variant's name behind a middle dot; the title alone without a variant."""
    name = F.coalesce(*[F.when(variant == k, F.lit(v)) for k, v in titles.items()], variant)
    return F.when((variant == "") | variant.isNull(), title).otherwise(F.concat(title, F.lit(" \u00b7 "), name))


def parse_config(text: Column) -> Column:
    """``key=value,key=value`` to a map; text without ``=`` gives null values."""
    return F.str_to_map(text, F.lit(","), F.lit("="))


def config_slug(text: Column) -> Column:
    """A configuration as part of a file name."""
    return F.translate(text, ",", "_")


def number_or_text(text: Column) -> Column:
    """A parameter value: ``num`` where it reads as a number, else ``txt``."""
    num = text.try_cast("double")
    return F.struct(num.alias("num"), F.when(num.isNull(), text).alias("txt"))


def spec(text: Column, default: Column) -> Column:
    """``name:item,item`` to (name, items); no items means ``default``, an array."""
    name, rest = split_name(text, ":")
    return F.struct(name.alias("name"), F.when(rest == "", default).otherwise(F.split(rest, ",")).alias("items"))


def at_path(doc: Column, path: str, kind: str = "double") -> Column:
    """A nested value of a JSON text, null wherever the way there breaks off."""
    return F.try_variant_get(F.try_parse_json(doc), path, kind)


def json_number(x: Column, digits: int = 5) -> Column:
    """A number as documents store it: rounded, non-finite as null."""
    return F.bround(finite(x), digits)


def quantize16(x: Column, low: float, high: float) -> Column:
    """A number in [low, high] on the scale of signed 16-bit integers."""
    return F.bround((clip(x, low, high) - F.lit((low + high) / 2)) * F.lit(65534.0 / (high - low))).cast("short")


def dequantize16(q: Column, low: float, high: float) -> Column:
    return q.cast("double") * F.lit((high - low) / 65534.0) + F.lit((low + high) / 2)


def pack_bits(flags: Column) -> Column:
    """Array of booleans to bytes, most significant bit first, padded with zeros."""
    n = F.ceil(F.size(flags) / 8).cast("int")
    bit = lambda i, k: F.when(F.coalesce(F.get(flags, i * 8 + k), F.lit(False)), F.lit(1 << (7 - k))).otherwise(F.lit(0))
    byte = lambda i: sum((bit(i, k) for k in range(1, 8)), bit(i, 0))
    hexed = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.lpad(F.hex(byte(i)), 2, "0"))
    return F.when(n > 0, F.unhex(F.array_join(hexed, ""))).otherwise(F.lit(b""))


def unpack_bits(data: Column, width: int) -> Column:
    """The first ``width`` bits of bytes as booleans."""
    code = lambda i: F.conv(F.hex(F.substring(data, F.floor(i / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.shiftright(code(i), 0).bitwiseAND(F.pow(F.lit(2), 7 - i % 8).cast("int")) > 0)


def padded(a: Column, before: int, after: int) -> Column:
    """An array with its end values repeated."""
    return F.concat(F.array_repeat(F.element_at(a, 1), before), a, F.array_repeat(F.element_at(a, -1), after))


def overlay(base: Column, over: Column) -> Column:
    """Two maps, the second's entries winning."""
    return F.map_from_entries(F.concat(F.filter(F.map_entries(base), lambda e: ~F.map_contains_key(over, e["key"])), F.map_entries(over)))


def packed_id(low: Column, high: Column) -> Column:
    """Two 32-bit numbers as one 64-bit id."""
    return low + F.shiftleft(high.cast("long"), 32)


def low_id(x: Column) -> Column:
    return x.bitwiseAND(F.lit(0xFFFFFFFF))


def psnr(mse: Column) -> Column:
    return 10.0 * F.log10(F.lit(255.0 * 255.0) / F.greatest(mse, F.lit(1e-9)))


def robust_loss(r: Column, eps: float = 0.5) -> Column:
    """Smooth absolute value: sqrt(r^2 + eps^2) - eps."""
    return F.sqrt(r * r + F.lit(eps * eps)) - F.lit(eps)


def ramp(k: Column, start: Column | float, width: float) -> Column:
    """0 before ``start``, 1 after ``start + width``, straight between."""
    s = start if isinstance(start, Column) else F.lit(start)
    return clip((k - s) / F.lit(width), 0.0, 1.0)


def is_specular(r: Column, g: Column, b: Column, bright: int = 225, grey: int = 90) -> Column:
    """Bright and little saturated: value over ``bright`` and saturation (0-255) under ``grey``."""
    v, low = F.greatest(r, g, b), F.least(r, g, b)
    s = F.when(v > 0, (v - low) * 255.0 / v).otherwise(F.lit(0.0))
    return (v > bright) & (s < grey)
