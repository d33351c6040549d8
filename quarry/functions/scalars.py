"""Versions, sizes, flags, times, numbers and bytes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PREFIX = r"(?:win)?(?:wrar|rar(?:linux|osx|macos)?)(?:[-_ ]?x(?:64|32|86))?[-_ ]*"
VERSION = "(?i)" + PREFIX + r"(\d+(?:\.\d+)*)"
#: Names of methods and host systems.
METHODS = ("Store", "Fastest", "Fast", "Normal", "Good", "Best")
HOSTS = ("MS-DOS", "OS/2", "Windows", "Unix", "Mac OS", "BeOS")
UNITS = ("B", "KiB", "MiB", "GiB", "TiB", "PiB", "EiB")
DICTIONARIES = (64, 128, 256, 512, 1024, 2048, 4096, 0)
RAR5_FROM, RAR7_FROM = 500, 700


def choose(value: Column, names, first: int = 0) -> Column:
    """The name at value - first; null outside."""
    return F.try_element_at(F.array(*map(F.lit, names)), F.when((value >= first) & (value < first + len(names)), value - first + 1).otherwise(len(names) + 1).cast("int"))


def version_digits(name: Column) -> Column:
    return F.regexp_extract(name, VERSION, 1)


def version(name: Column) -> Column:
    """Version number of a tool folder's name, two digits times ten; null without one."""
    n = F.replace(version_digits(name), F.lit("."), F.lit("")).try_cast("int")
    return F.when(n < 100, n * 10).otherwise(n)


def version_tag(name: Column) -> Column:
    """What follows the version's digits, without separators in front; null without a version."""
    head = F.regexp_extract(name, r"(?i)^.*?" + PREFIX + r"\d+(?:\.\d+)*", 0)
    return F.when(version(name).isNotNull(), F.regexp_replace(F.substring(name, F.length(head) + 1, F.length(name)), r"^[-_. ]+", ""))


def archive_format(number: Column, args: Column | None = None) -> Column:
    """RAR4, RAR5 or RAR7: by the first -ma4 or -ma5, else by version."""
    by_version = F.when(number < RAR5_FROM, "RAR4").when(number < RAR7_FROM, "RAR5").when(number >= RAR7_FROM, "RAR7")
    if args is None:
        return by_version
    forced = F.try_element_at(F.filter(args, lambda a: a.isin("-ma4", "-ma5")), F.lit(1))
    return F.when(forced == "-ma4", "RAR4").when(forced == "-ma5", "RAR5").otherwise(by_version)


def argument_applies(number: Column, form: Column, low: Column, high: Column, only: Column) -> Column:
    """Whether a switch fits a version and format; both limits belong to the range."""
    return (number >= low) & (high.isNull() | (number <= high)) & (only.isNull() | (only == form))


def known_bad(number: Column, form: Column, args: Column) -> Column:
    """Version 6 ignores time switches in the old format."""
    times = F.exists(args, lambda a: F.startswith(a, F.lit("-ts")))
    old = (form == "RAR4") | ((number >= 550) & (number < RAR7_FROM) & ~F.array_contains(args, "-ma5"))
    return (number >= 600) & (number < RAR7_FROM) & old & times


def final_arguments(args: Column, number: Column, old_naming: Column, comment: Column, ds: Column) -> Column:
    """-cfg- first, -ma4 from 550 to 699 for an old-format run, -vn from 300, the comment, then -ds."""
    none = F.array().cast("array<string>")
    only = lambda cond, *values: F.when(cond, F.array(*values)).otherwise(none)
    return F.concat(
        F.array(F.lit("-cfg-")),
        only((number >= 550) & (number < RAR7_FROM) & ~F.array_contains(args, "-ma5") & ~F.array_contains(args, "-ma4"), F.lit("-ma4")),
        args,
        only(old_naming & (number >= 300) & ~F.array_contains(args, "-vn"), F.lit("-vn")),
        only(comment.isNotNull(), F.concat(F.lit("-z"), comment)),
        only(ds, F.lit("-ds")),
    )


def joined_arguments(args: Column) -> Column:
    """Arguments on one line, those with a space in quotes."""
    return F.array_join(F.transform(args, lambda a: F.when(F.contains(a, F.lit(" ")), F.concat(F.lit('"'), a, F.lit('"'))).otherwise(a)), " ")


def human_size(size: Column) -> Column:
    """Bytes over 1024 in the next unit, and so on; the number isn't rounded."""
    steps = sum(F.when(size > 1024**k, 1).otherwise(0) for k in range(1, len(UNITS)))
    value = size.cast("double") / F.pow(F.lit(1024.0), steps)
    text = F.when(value == F.floor(value), F.floor(value).cast("string")).otherwise(value.cast("string"))
    return F.concat(text, F.lit(" "), choose(steps, UNITS))


def method_name(method: Column) -> Column:
    """0 to 5, and the same from 0x30."""
    known = F.coalesce(choose(method, METHODS), choose(method, METHODS, 0x30))
    return F.when(method.isNull(), "Unknown").otherwise(F.coalesce(known, F.concat(F.lit("Unknown (0x"), F.lpad(F.hex(method), 2, "0"), F.lit(")"))))


def host_name(host: Column) -> Column:
    return F.coalesce(choose(host, HOSTS), F.concat(F.lit("Unknown ("), host.cast("string"), F.lit(")")))


def version_name(number: Column) -> Column:
    return F.when(number.isNull(), "Unknown").when(number == 50, "RAR 5.0").otherwise(F.concat(F.lit("RAR "), F.floor(number / 10).cast("string"), F.lit("."), (number % 10).cast("string")))


def dictionary_name(size: Column) -> Column:
    return F.when(size.isNull(), "Unknown").otherwise(F.concat(size.cast("string"), F.lit(" KB")))


def flag_name(value: Column) -> Column:
    return F.when(value.isNull(), "Unknown").when(value, "Yes").otherwise("No")


def has_flag(flags: Column, mask: int) -> Column:
    return flags.bitwiseAND(mask) != 0


def is_directory(flags: Column) -> Column:
    return flags.bitwiseAND(0xE0) == 0xE0


def dictionary_size(flags: Column) -> Column:
    """Dictionary in KB, from bits 5 to 7; 0 for a directory."""
    return F.element_at(F.array(*map(F.lit, DICTIONARIES)), F.shiftright(flags.bitwiseAND(0xE0), 5).cast("int") + 1)


def dos_time(value: Column) -> Column:
    """Timestamp of a DOS date; null for 0 and for dates that don't exist."""
    bits = lambda at, n: F.shiftright(value, at).bitwiseAND((1 << n) - 1).cast("int")
    seconds = (bits(0, 5) * 2).cast("int")
    made = F.try_make_timestamp_ntz(bits(25, 7) + 1980, bits(21, 4), bits(16, 5), bits(11, 5), bits(5, 6), seconds.cast("decimal(16,6)"))
    return F.when((value != 0) & (seconds < 60), made)


def to_dos(at: Column) -> Column:
    """DOS date of a timestamp; years outside 1980 to 2107 become the nearest."""
    year = F.least(F.greatest(F.year(at), F.lit(1980)), F.lit(2107)) - 1980
    parts = [(year, 25), (F.month(at), 21), (F.dayofmonth(at), 16), (F.hour(at), 11), (F.minute(at), 5), (F.floor(F.second(at) / 2), 0)]
    return sum((F.shiftleft(v.cast("long"), s) for v, s in parts[1:]), F.shiftleft(parts[0][0].cast("long"), parts[0][1]))


def time_fraction(micros: Column) -> Column:
    """(round_up, ticks): what a DOS date of so many microseconds since the epoch leaves, in 100 ns."""
    above = F.pmod(micros, F.lit(2_000_000))
    up = above >= 1_000_000
    return F.struct(up.alias("round_up"), (F.when(up, above - 1_000_000).otherwise(above) * 10).alias("ticks"))


def precision(extra: Column) -> Column:
    """Precision that so many extra bytes of an extended time give."""
    return F.when(extra == 0, "second").when(extra == 1, "6.5536 ms").when(extra == 2, "25.6 us").when(extra == 3, "100 ns")


def vint(value: Column) -> Column:
    """EBML variable-length bytes, as upper-case hex: the shortest form whose bits aren't all ones."""
    out = F.lit(None).cast("string")
    for n in range(8, 0, -1):
        limit = (1 << (7 * n)) - 2
        out = F.when(value <= limit, F.lpad(F.hex(value + (1 << (7 * n))), 2 * n, "0")).otherwise(out)
    return F.when(value >= 0, out)


def unvint(code: Column) -> Column:
    """Value of EBML variable-length bytes, given as hex; longer input is cut to its own length."""
    first = F.conv(F.substring(code, 1, 2), 16, 10).cast("long")
    out = F.lit(None).cast("long")
    for n in range(8, 0, -1):
        whole = F.conv(F.substring(code, 1, 2 * n), 16, 10).cast("long")
        out = F.when(first >= (1 << (8 - n)), whole - (1 << (7 * n))).otherwise(out)
    return out


def signed_vint(code: Column) -> Column:
    """Value of a signed variable-length integer: the unsigned one less half its range."""
    n = F.floor(F.length(code) / 2)
    return unvint(code) - (F.pow(F.lit(2.0), 7 * n - 1).cast("long") - 1)


def sync_safe(value: Column) -> Column:
    """Four bytes of seven bits each, as one number."""
    part = lambda at: F.shiftleft(F.shiftright(value, 7 * at).bitwiseAND(0x7F), 8 * at)
    return part(3) + part(2) + part(1) + part(0)


def from_sync_safe(value: Column) -> Column:
    part = lambda at: F.shiftleft(F.shiftright(value, 8 * at).bitwiseAND(0x7F), 7 * at)
    return part(3) + part(2) + part(1) + part(0)


def filetime(value: Column) -> Column:
    """Timestamp of 100 ns since 1601."""
    return F.timestamp_micros(F.floor(value / 10).cast("long") - 11_644_473_600_000_000)


def ebml_date(nanos: Column) -> Column:
    """Timestamp of nanoseconds since 2001."""
    return F.timestamp_micros(F.floor(nanos / 1000).cast("long") + 978_307_200_000_000)


def crc_text(data: Column) -> Column:
    """CRC-32 as eight lower-case hex digits."""
    return F.lower(F.lpad(F.hex(F.crc32(data)), 8, "0"))


def digest(data: Column, algorithm: Column) -> Column:
    """CRC-32 or SHA-1 by name; null for other names."""
    name = F.upper(algorithm)
    return F.when(name.isin("CRC32", "CRC-32"), crc_text(data)).when(name.isin("SHA1", "SHA-1"), F.sha1(data))


def header_crc_valid(header: Column, stored: Column) -> Column:
    """Low 16 bits of the CRC-32 of a header from its third byte."""
    return F.crc32(F.substring(header, 3, 0x7FFFFFFF)).bitwiseAND(0xFFFF) == stored


def latin(data: Column) -> Column:
    """Bytes as text of one character each: positions in it are byte positions."""
    return F.decode(data, "ISO-8859-1")


def pattern(text: Column, as_hex: bool) -> Column:
    """Bytes to search for, as binary; null for blank, odd or wrong hex."""
    if not as_hex:
        return F.when(text.rlike(r"\S"), F.encode(text, "UTF-8"))
    stripped = F.regexp_replace(text, "[ -]", "")
    return F.when(stripped.rlike("^([0-9A-Fa-f]{2})+$"), F.unhex(stripped))


def find_forward(data: Column, wanted: Column, start: Column | None = None) -> Column:
    """First byte offset of wanted at or after start, else -1."""
    rest = latin(data) if start is None else F.substring(latin(data), start + 1, F.octet_length(data))
    at = F.position(latin(wanted), rest)
    return F.when(at > 0, at - 1 + (F.lit(0) if start is None else start)).otherwise(-1).cast("long")


def find_backward(data: Column, wanted: Column, bound: Column) -> Column:
    """Last byte offset of wanted that ends at or before bound, else -1."""
    head = F.reverse(F.substring(latin(data), F.lit(1), bound.cast("int")))
    at = F.position(F.reverse(latin(wanted)), head)
    return F.when(at > 0, F.length(head) - at + 1 - F.octet_length(wanted)).otherwise(-1).cast("long")


def count_all(data: Column, wanted: Column) -> Column:
    """Number of matches, none of which overlap."""
    text, sought = latin(data), latin(wanted)
    return F.floor((F.length(text) - F.length(F.replace(text, sought, F.lit("")))) / F.length(sought)).cast("long")


def find_all(data: Column, wanted: Column) -> Column:
    """Offsets of all matches, none of which overlap."""
    sizes = F.transform(F.split(latin(data), F.concat(F.lit("\\Q"), latin(wanted), F.lit("\\E")), -1), lambda p: F.length(p))
    ends = F.aggregate(
        F.slice(sizes, F.lit(1), F.size(sizes) - 1),
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<long>").alias("found")),
        lambda acc, n: F.struct((acc["at"] + n + F.octet_length(wanted)).cast("long").alias("at"), F.concat(acc["found"], F.array((acc["at"] + n).cast("long"))).alias("found")),
    )
    return ends["found"]


def matches_at(data: Column, wanted: Column, offset: Column) -> Column:
    return (offset >= 0) & (F.substring(data, (offset + 1).cast("int"), F.octet_length(wanted)) == wanted)


def locate(data: Column, wanted: Column, hint: Column, radius: int = 64 * 1024) -> Column:
    """(offset, tier): at the hint, within the radius around it, or anywhere; offset -1 if nowhere."""
    low = F.greatest(hint - radius, F.lit(0))
    window = F.substring(latin(data), (low + 1).cast("int"), (hint - low + radius + F.octet_length(wanted)).cast("int"))
    near, far = F.position(latin(wanted), window), find_forward(data, wanted)
    return (
        F.when(matches_at(data, wanted, hint), F.struct(hint.cast("long").alias("offset"), F.lit(1).alias("tier")))
        .when(near > 0, F.struct((low + near - 1).cast("long").alias("offset"), F.lit(2).alias("tier")))
        .otherwise(F.struct(far.alias("offset"), F.when(far >= 0, 3).otherwise(0).alias("tier")))
    )


def custom_packer(unpacked: Column, flags: Column, is_dir: Column) -> Column:
    """Which mark of a custom packer an entry's size is: all ones in 64 bits, or in 32 bits without the large flag; null for none."""
    size = unpacked.cast("decimal(20,0)")
    return F.when(is_dir, None).when(size == F.lit("18446744073709551615").cast("decimal(20,0)"), "all ones, large").when((size == 4294967295) & (flags.bitwiseAND(0x100) == 0), "all ones, 32 bits")


def known_hash(digest: Column, known: list[str]) -> Column:
    """Whether a digest is among known ones, whatever the case and blanks around them; false for null."""
    return F.coalesce(F.lower(F.trim(digest)).isin([k.strip().lower() for k in known]), F.lit(False))


def comment_text(data: Column) -> Column:
    """Text of a comment without zeros at its end: UTF-8, or code page 437 where it isn't valid UTF-8."""
    upper = bytes(range(128, 256))
    text, page = data.cast("string"), F.translate(F.decode(data, "ISO-8859-1"), upper.decode("latin-1"), upper.decode("cp437"))
    valid = F.is_valid_utf8(text) & ~F.contains(text, F.lit("\ufffd"))
    return F.rtrim(F.when(valid, F.decode(data, "UTF-8")).otherwise(page), F.lit("\0"))


def comment_arguments(number: Column, method: Column, dictionary: Column, comment: Column) -> Column:
    """Arguments that pack a comment alone: -ma4 from 550 to 699, no created and accessed times from 320."""
    none = F.array().cast("array<string>")
    only = lambda cond, *values: F.when(cond, F.array(*map(F.lit, values))).otherwise(none)
    first = F.array(F.lit("-cfg-"), F.lit("a"), F.lit("-r"), method, dictionary, F.concat(F.lit("-z"), comment))
    return F.concat(first, only((number >= 550) & (number < RAR7_FROM), "-ma4"), only(number >= 320, "-tsc-", "-tsa-"))


#: Fixed value: characters of a command line beyond which files are named in a list file.
COMMAND_LENGTH = 25_000


def input_operands(names: Column, used: Column, list_path: Column) -> Column:
    """struct(tail, list_text) that names a run's input files in order, beside used other characters; null: the packer's own order.

    tail is the files themselves, or @list_path with list_text to write there
    where they are too long; too long and not ASCII, or no files: null.
    """
    tail = F.transform(names, lambda n: F.concat(F.lit("./"), F.replace(n, F.lit("\\"), F.lit("/"))))
    fits = used + F.length(joined_arguments(tail)) <= COMMAND_LENGTH
    ascii_only = F.forall(names, lambda n: n.rlike(r"^\p{ASCII}*$"))
    no_text = F.lit(None).cast("string")
    listed = F.struct(F.array(F.concat(F.lit("@"), list_path)).alias("tail"), F.array_join(names, "\n").alias("list_text"))
    return F.when(F.size(names) == 0, None).when(fits, F.struct(tail.alias("tail"), no_text.alias("list_text"))).when(ascii_only, listed)
