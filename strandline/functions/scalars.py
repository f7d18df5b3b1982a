"""Scalar rules as Spark columns; none of them needs Python on the executors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Limits, and the patterns of ids, hashes, tokens and file names.
MAX_TIME, MAX_BYTES, MAX_SIDE, MAX_PIXELS = 9007199254740991, 16 * 1024 * 1024, 16384, 40_000_000
UUID = "^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
HEX64 = "^[0-9a-f]{64}$"
#: 43 characters of base64url hold 258 bits; the last two must be 0, which leaves these last characters.
TOKEN = "^[A-Za-z0-9_-]{42}[AEIMQUYcgkosw048]$"
OBJECT_NAME = "^([0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12})_([0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12})\\.jpg$"
STAGE_NAME = "^\\.stage-[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}$"
_MICROS = 1_000_000


def _all(*terms: Column) -> Column:
    return reduce(lambda a, b: a & b, terms)


def is_uuid(x: Column) -> Column:
    return x.rlike(UUID)


def is_token(x: Column) -> Column:
    return x.rlike(TOKEN)


def is_sha256(x: Column) -> Column:
    return x.rlike(HEX64)


def sha256(x: Column) -> Column:
    return F.sha2(x, 256)


def new_id(seed: Column) -> Column:
    """A version 4 id that follows from ``seed``, so that a repeated task makes the same one."""
    h = F.sha2(seed.cast("string"), 256)
    variant = F.substring(F.lit("89ab"), (F.pmod(F.conv(F.substring(h, 17, 1), 16, 10).cast("int"), F.lit(4)) + 1), F.lit(1))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("4"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def new_token(seed: Column) -> Column:
    """A token that follows from a secret ``seed``: 32 bytes as 43 characters of base64url."""
    return F.rtrim(F.translate(F.base64(F.unhex(F.sha2(seed.cast("string"), 256))), "+/", "-_"), F.lit("="))


def valid_text(x: Column, least: int, most: int) -> Column:
    """Code points within bounds, and no NUL."""
    return F.char_length(x).between(least, most) & ~F.contains(x, F.lit("\u0000"))


def valid_utf8(x: Column) -> Column:
    return F.is_valid_utf8(x)


def valid_time(x: Column) -> Column:
    return F.coalesce(x.between(0, MAX_TIME), F.lit(True))


def jpeg_marked(content: Column) -> Column:
    """Begins and ends as a JPEG does."""
    return (F.length(content) >= 4) & (F.hex(F.substring(content, 1, 2)) == "FFD8") & (F.hex(F.substring(content, -2, 2)) == "FFD9")


def jpeg_size_ok(width: Column, height: Column) -> Column:
    return width.between(1, MAX_SIDE) & height.between(1, MAX_SIDE) & (width.cast("long") * height.cast("long") <= MAX_PIXELS)


def object_name(archive: Column, frame: Column) -> Column:
    return F.concat(archive, F.lit("_"), frame, F.lit(".jpg"))


def object_archive(name: Column) -> Column:
    return F.nullif(F.regexp_extract(name, OBJECT_NAME, 1), F.lit(""))


def object_frame(name: Column) -> Column:
    return F.nullif(F.regexp_extract(name, OBJECT_NAME, 2), F.lit(""))


def utc_day(x: Column, unit: int = 1000) -> Column:
    """The day of a time since 1970, in parts of a second, in UTC whatever the session's zone is."""
    rest = F.pmod(x, F.lit(86_400 * unit))
    return F.date_add(F.lit("1970-01-01").cast("date"), ((x - rest) / F.lit(86_400 * unit)).cast("int"))


def _clock(x: Column, unit: int, form: str) -> Column:
    """Hours, minutes and seconds of a time since 1970, in UTC."""
    second = F.floor(F.pmod(x, F.lit(86_400 * unit)) / F.lit(unit))
    return F.format_string(form, F.floor(second / 3600), F.floor(second / 60) % 60, second % 60)


def rfc3339_micros(micros: Column) -> Column:
    """Microseconds since 1970 as RFC 3339 in UTC, with no more fraction digits than needed."""
    fraction = F.regexp_replace(F.format_string(".%06d", F.pmod(micros, F.lit(1_000_000))), "\\.?0+$", "")
    return F.concat(utc_day(micros, 1_000_000).cast("string"), F.lit("T"), _clock(micros, 1_000_000, "%02d:%02d:%02d"), fraction, F.lit("Z"))


def rfc3339(ts: Column) -> Column:
    """A timestamp as RFC 3339 in UTC, whatever the session's zone is; null for null."""
    return F.when(ts.isNotNull(), rfc3339_micros(F.unix_micros(ts)))


def expires(start: Column, seconds: int) -> Column:
    """Lifetimes are whole seconds, 1 to 600."""
    if not (isinstance(seconds, int) and 1 <= seconds <= 600):
        raise ValueError("lifetime must be 1 to 600 whole seconds")
    return F.date_trunc("microsecond", start) + F.make_dt_interval(secs=F.lit(seconds))


def path_stamp(wall_ms: Column) -> Column:
    """Date and time of milliseconds since 1970, in UTC; null for null."""
    wall_ms = wall_ms.cast("long")
    return F.when(wall_ms.isNotNull(), F.concat(F.replace(utc_day(wall_ms).cast("string"), F.lit("-"), F.lit("")), F.lit("-"), _clock(wall_ms, 1000, "%02d%02d%02d")))


def session_folder(profile: Column, wall_ms: Column, session: Column) -> Column:
    return F.concat(profile, F.lit("_"), path_stamp(wall_ms), F.lit("Z_"), session)


def battery(level: Column, scale: Column) -> Column:
    """struct(level, scale, percent); all three null if they are out of range."""
    ok = (scale > 0) & level.between(0, scale)
    return F.struct(F.when(ok, level).alias("level"), F.when(ok, scale).alias("scale"), F.when(ok, level * F.lit(100.0) / scale).alias("percent"))


def battery_consistent(level: Column, scale: Column, percent: Column) -> Column:
    return F.coalesce((scale > 0) & level.between(0, scale) & ~F.isnan(percent) & (F.abs(percent - level * F.lit(100.0) / scale) < 1e-6), F.lit(False))


def duration_text(ms: Column) -> Column:
    whole = F.floor(ms / 1000)
    return F.format_string("%d:%02d:%02d", F.floor(whole / 3600), F.floor(whole / 60) % 60, whole % 60)


def mib(x: Column) -> Column:
    return F.floor(x / (1 << 20))


def tenths_text(x: Column) -> Column:
    return F.format_string("%.1f", x / 10)


def signed_text(x: Column) -> Column:
    return F.format_string("%+.2f", x)


def settings_text(**values: Column) -> Column:
    return F.concat_ws(";", *[F.concat(F.lit(f"{k}="), v.cast("string")) for k, v in values.items()])


def settings_map(x: Column) -> Column:
    """Keys and values of ``k=v;k=v``; flags and the leading version have null values."""
    return F.str_to_map(x, F.lit(";"), F.lit("="))


def grid_sample(values: Column, row_stride: Column, pixel_stride: Column, left: Column, top: Column, width: Column, height: Column, columns: int = 32, rows: int = 24) -> Column:
    """Luma at the middle of each cell of a grid over the crop of a frame."""
    at = F.sequence(F.lit(0), F.lit(columns * rows - 1))

    def pick(i: Column) -> Column:
        x = left + F.floor((i % columns * 2 + 1) * width / (2 * columns))
        y = top + F.floor((F.floor(i / columns) * 2 + 1) * height / (2 * rows))
        return F.get(values, (y * row_stride + x * pixel_stride).cast("int"))

    return F.transform(at, pick)


def content_uri_ok(x: Column) -> Column:
    return F.coalesce(x.rlike("^content://[A-Za-z0-9_.-]+/.+$") & ~F.contains(x, F.lit("..")) & ~x.rlike("[?#]"), F.lit(False))


def sample_size(width: Column, height: Column, most: Column, largest: int | None = None) -> Column:
    """Least power of two by which both sides (up to MAX_SIDE) fit into ``most``, in whole numbers.

    Where none up to ``largest`` (a power of two) is enough, it is ``largest``; without a ``largest`` it is null.
    """
    steps = F.array(*[F.lit(1 << k) for k in range((largest or MAX_SIDE).bit_length())])
    least = F.get(F.filter(steps, lambda p: F.greatest(width, height).cast("long") <= most.cast("long") * p), 0)
    return least if largest is None else F.coalesce(least, F.lit(largest))


def seconds_since(now_ms: Column, then_ms: Column) -> Column:
    return F.floor(F.greatest(now_ms - then_ms, F.lit(0)) / 1000)


def offset(elapsed: Column, start: Column) -> Column:
    """Null stays null: a phase that was never reached has no offset."""
    return elapsed - start


def origin_ok(url: Column) -> Column:
    """https, a host of valid labels, a port of 1 to 65535 or none, and nothing else."""
    host = F.regexp_extract(url, "^https://([^/:?#@]+)(?::([0-9]{1,5}))?/?$", 1)
    port = F.regexp_extract(url, "^https://([^/:?#@]+)(?::([0-9]{1,5}))?/?$", 2)
    labels = host.rlike("^(?=.{1,253}$)[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?(?:\\.[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?)*$")
    return F.coalesce(labels & ((port == "") | F.try_to_number(port, F.lit("99999")).between(1, 65535)), F.lit(False))


def viewable(availability: Column, uri: Column) -> Column:
    return F.coalesce((availability == "AVAILABLE") & content_uri_ok(uri), F.lit(False))


def csv_field(x: Column) -> Column:
    """Quoted only if it holds a comma, quote or line end; null is empty."""
    s = x.cast("string")
    return F.when(s.rlike('[,"\n\r]'), F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.coalesce(s, F.lit("")))


def csv_line(*columns: Column) -> Column:
    return F.concat_ws(",", *[csv_field(c) for c in columns])


def same_metadata(a: Column, b: Column) -> Column:
    """Null-safe equality: a null and an absent optional field are the same."""
    return a.eqNullSafe(b)


def row_after(columns: list[str], values: list) -> Column:
    """(a, b, ...) > (x, y, ...) as ORs of ANDs, which reach the Parquet scan."""
    terms = [_all(*[F.col(c) == v for c, v in zip(columns[:k], values[:k], strict=True)], F.col(columns[k]) > values[k]) for k in range(len(columns))]
    return reduce(lambda a, b: a | b, terms)
