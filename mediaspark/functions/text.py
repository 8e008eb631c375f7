"""Report formatting, numbers with prefixes, names and tag maps (column expressions)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

_DECIMAL = ["", "K", "M", "G", "T", "P"]
_BINARY = ["", "Ki", "Mi", "Gi", "Ti", "Pi"]


def sexagesimal(seconds: Column) -> Column:
    """``h:mm:ss.ffffff``; ``N/A`` for null."""
    whole = F.floor(seconds).cast("bigint")
    mins = F.call_function("div", whole, F.lit(60))
    secs = seconds - mins * 60
    text = F.format_string("%d:%02d:%09.6f", F.call_function("div", mins, F.lit(60)), mins % 60, secs)
    return F.when(seconds.isNull(), "N/A").otherwise(text)


def format_value(value: Column, unit: str = "", *, prefix: bool = False, binary: bool = False, show_unit: bool = True) -> Column:
    """A number with unit and, if asked, an SI or binary prefix."""
    v = value.cast("double")
    unit = unit if show_unit else ""
    if not prefix:
        text = F.format_string(f"%f {unit}", v)
    else:
        names = _BINARY if binary else _DECIMAL
        log = F.log2(v) if binary else F.log10(v)
        steps = F.call_function("div", log.cast("bigint"), F.lit(10 if binary else 3))
        i = F.when(v > 0, F.greatest(F.lit(0), F.least(steps, F.lit(len(names) - 1)))).otherwise(0).cast("int")
        base = F.lit(1024.0 if binary else 1000.0)
        names = F.array(*[F.lit(n) for n in names])
        text = F.format_string(f"%.3f %s{unit}", v / F.pow(base, i), F.get(names, i))
    return F.when(value.isNull(), "N/A").otherwise(text)


def format_bytecount(n: Column) -> Column:
    """A whole count divided by 1000 while it has six digits or more, with its suffix; decimals hold up to 38 digits."""
    digits = (n - n % 1).cast("decimal(38, 0)").cast("string")
    steps = F.greatest(F.lit(0), F.least(F.lit(5), F.call_function("div", F.length(digits) - 3, F.lit(3)).cast("int")))
    # Three digits go with each step; a negative count takes none.
    steps = F.when(n < 0, 0).otherwise(steps)
    return F.concat(F.substring(digits, F.lit(1), F.length(digits) - steps * 3), F.substring(F.lit(" kMGTP"), steps + 1, F.lit(1)))


def fourcc(tag: Column) -> Column:
    """A codec tag's four bytes, lowest first; unprintable ones in brackets."""
    parts = []
    for i in range(4):
        b = F.shiftright(tag.cast("bigint"), 8 * i).bitwiseAND(F.lit(255))
        parts.append(F.when((b >= 32) & (b < 127), F.chr(b)).otherwise(F.concat(F.lit("["), b.cast("string"), F.lit("]"))))
    return F.concat(*parts)


# Powers of ten by prefix letter (fixed values).
SI_PREFIXES = {
    "y": -24, "z": -21, "a": -18, "f": -15, "p": -12, "n": -9, "u": -6, "m": -3, "c": -2, "d": -1,
    "h": 2, "k": 3, "K": 3, "M": 6, "G": 9, "T": 12, "P": 15, "E": 18, "Z": 21, "Y": 24,
}


def parse_number(text: Column) -> Column:
    """A number with an SI prefix, ``i`` for its binary form and ``B`` for bytes (x8)."""
    pat = r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)([yzafpnumcdhkKMGTPEZY]?)(i?)(B?)"
    num = F.regexp_extract(text, pat, 1)
    letter = F.regexp_extract(text, pat, 2)
    table = F.create_map(*[F.lit(x) for kv in SI_PREFIXES.items() for x in kv])
    exp = F.coalesce(F.try_element_at(table, letter), F.lit(0)).cast("double")
    binary = (F.regexp_extract(text, pat, 3) == "i") & (letter != "")
    scale = F.when(binary, F.pow(F.lit(2.0), exp / 0.3)).otherwise(F.pow(F.lit(10.0), exp))
    times = F.when(F.regexp_extract(text, pat, 4) == "B", 8.0).otherwise(1.0)
    return F.when(num != "", F.expr("1D") * num.try_cast("double") * scale * times)


def squish(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(x * 4))


def gauss(x: Column) -> Column:
    return F.exp(-x * x / 2) / F.sqrt(F.lit(2.0) * F.pi())


def floored_mod(a: Column, b: Column) -> Column:
    return a - F.floor(a / b) * b


def match_extension(filename: Column, extensions: Sequence[str]) -> Column:
    ext = F.lower(F.regexp_extract(filename, r"\.([^.]*)$", 1))
    return filename.contains(".") & ext.isin([e.lower() for e in extensions])


def frame_filename(pattern: str, number: Column) -> Column:
    """A file name from a pattern with one ``%d`` or ``%0Nd`` and ``%%``."""
    import re

    marks = [m for m in re.findall(r"%%|%\d*d", pattern) if m != "%%"]
    if len(marks) != 1:
        raise ValueError("pattern needs exactly one %d")
    return F.format_string(pattern, number)


def split_url(url: Column) -> Column:
    """Struct of protocol, user info, host, port and path."""
    pat = r"^([A-Za-z][A-Za-z0-9+.-]*):(?://)?(?:([^@/]*)@)?([^:/?#]*)(?::(\d+))?(.*)$"
    part = lambda i: F.regexp_extract(url, pat, i)
    port = F.when(part(4) != "", part(4)).otherwise(F.lit("-1")).cast("int")
    return F.struct(
        part(1).alias("proto"), part(2).alias("auth"), part(3).alias("host"), port.alias("port"), part(5).alias("path")
    )


def join_url(proto: Column, host: Column, port: Column, path: Column) -> Column:
    at = F.when(port >= 0, F.concat(F.lit(":"), port.cast("string"))).otherwise("")
    return F.concat(proto, F.lit("://"), host, at, path)


# ---------------------------------------------------------------- tag maps


def tag_get(tags: Column, key: str) -> Column:
    """Value of a key, ignoring case."""
    hits = F.map_filter(tags, lambda k, v: F.lower(k) == key.lower())
    return F.get(F.map_values(hits), F.lit(0))


def tags_with_prefix(tags: Column, prefix: str) -> Column:
    """Tags whose key begins with a prefix, ignoring case."""
    return F.map_filter(tags, lambda k, v: F.lower(k).startswith(prefix.lower()))


def tag_set(tags: Column, key: str, value: Column | None) -> Column:
    """Replace a tag (exact key), or delete it with None."""
    rest = F.map_filter(tags, lambda k, v: k != key)
    return rest if value is None else F.map_concat(rest, F.create_map(F.lit(key), value))


def translate_keys(tags: Column, source: dict[str, str], target: dict[str, str]) -> Column:
    """Rename keys from one container's names over generic ones to another's.

    ``source`` maps native to generic names, ``target`` generic to native ones; both
    are matched ignoring case.  Of keys that become one the last wins.
    """
    def lookup(table: dict[str, str], key: Column) -> Column:
        out = key
        for a, b in reversed(list(table.items())):
            out = F.when(F.lower(key) == a.lower(), F.lit(b)).otherwise(out)
        return out

    entries = F.transform(F.map_entries(tags), lambda e: F.struct(lookup(target, lookup(source, e["key"])).alias("key"), e["value"].alias("value")))
    keys = F.transform(entries, lambda e: e["key"])
    kept = F.filter(entries, lambda e, i: ~F.array_contains(F.slice(keys, i + 2, F.lit(1 << 30)), e["key"]))
    return F.map_from_entries(kept)


def genre_name(number: Column, names: Sequence[str]) -> Column:
    """Genre of a numeric id from a list; null outside it."""
    return F.get(F.array(*[F.lit(n) for n in names]), number)
