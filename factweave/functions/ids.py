"""Identity keys, composed ids and the integer dialects of addresses, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def known(c: Column | str) -> Column:
    """The value, with '' and blanks as NULL: a missing key never joins."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.trim(c) != "", c)


def identity(*columns: Column | str) -> Column:
    """The first known id of several spellings, in the given order."""
    return F.coalesce(*(known(c) for c in columns))


def stable_id(prefix: str, *parts: Column | str, sep: str = "|", digits: int = 20) -> Column:
    """prefix and the first digits of the SHA-256 of the parts; a NULL part counts as ''."""
    texts = [F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("")) for p in parts]
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws(sep, *texts), 256), 1, digits))


def region_id(base: Column | str, offset: Column | str, extent: Column | str) -> Column:
    """A region's id, which names neither address nor symbol."""
    b, o, e = (F.col(x) if isinstance(x, str) else x for x in (base, offset, extent))
    return F.concat(F.lit("region:"), b, F.lit(":offset:"), o.cast("string"), F.lit(":extent:"), e.cast("string"))


def _hex_to_long(digits: Column) -> Column:
    """Up to 16 hex digits as the long of the same bits; conv gives an unsigned decimal."""
    return F.conv(digits, 16, -10).cast("bigint")


def hex_address(c: Column | str) -> Column:
    """Text as a hexadecimal number whether or not it begins with 0x; NULL for anything else."""
    t = F.lower(F.trim(F.col(c) if isinstance(c, str) else c))
    return F.when(t.rlike(r"^(0x)?[0-9a-f]{1,15}$"), _hex_to_long(F.regexp_replace(t, "^0x", "")))


def literal_integer(c: Column | str) -> Column:
    """Text as an integer literal: 0x.., 0o.., 0b.. or decimal with a sign; NULL for anything else."""
    t = F.lower(F.trim(F.col(c) if isinstance(c, str) else c))
    minus, bare = F.when(t.startswith("-"), -1).otherwise(1), F.regexp_replace(t, r"^[+-]", "")
    value = (
        F.when(bare.rlike(r"^0x[0-9a-f]{1,15}$"), F.conv(F.substring(bare, 3, 20), 16, -10))
        .when(bare.rlike(r"^0o[0-7]{1,20}$"), F.conv(F.substring(bare, 3, 30), 8, -10))
        .when(bare.rlike(r"^0b[01]{1,62}$"), F.conv(F.substring(bare, 3, 70), 2, -10))
        .when(bare.rlike(r"^(0+|[1-9][0-9]{0,17})$"), bare)
    )
    return (value.cast("bigint") * minus).cast("bigint")


def decimal_or_hex(c: Column | str) -> Column:
    """Text as decimal unless it begins with 0x; NULL for anything else."""
    t = F.lower(F.trim(F.col(c) if isinstance(c, str) else c))
    return F.when(t.rlike(r"^0x[0-9a-f]{1,15}$"), _hex_to_long(F.substring(t, 3, 20))).when(t.rlike(r"^-?[0-9]{1,18}$"), t.cast("bigint"))


def address_text(c: Column | str) -> Column:
    """A number as 0x.. in lower case."""
    return F.concat(F.lit("0x"), F.lower(F.hex(F.col(c) if isinstance(c, str) else c)))


def signed_constant(value: Column | str, size: Column | str) -> Column:
    """value as the two's-complement number of `size` bytes (1 to 8); NULL for other sizes."""
    v, s = (F.col(x) if isinstance(x, str) else x for x in (value, size))
    bits = (s * 8).cast("int")
    half = F.call_function("shiftleft", F.lit(1).cast("bigint"), bits - 1)
    mask = F.call_function("shiftleft", F.lit(1).cast("bigint"), bits) - F.lit(1).cast("bigint")
    low = v.cast("bigint").bitwiseAND(mask)
    # for 8 bytes the long itself is the two's-complement number
    return F.when(s == 8, v.cast("bigint")).when((s >= 1) & (s <= 7), F.when(low >= half, low - mask - 1).otherwise(low))


def code_address(c: Column | str) -> Column:
    """An instruction address without the mode bit."""
    return (F.col(c) if isinstance(c, str) else c).bitwiseAND(F.lit(-2).cast("bigint"))


def page(c: Column | str, bits: int = 12) -> Column:
    """The start of an address's page."""
    return (F.col(c) if isinstance(c, str) else c).bitwiseAND(F.lit(-(1 << bits)).cast("bigint"))


def alias_keys(object_id: Column | str) -> Column:
    """All spellings under which an object id may be meant, sorted; [] for NULL or ''.

    Ids with and without 'obj:' or 'source-object:' are the same, and any symbol, global or ram id is also
    its address. Two ids are aliases if they share a key, which is no equivalence relation.
    """
    raw = F.col(object_id) if isinstance(object_id, str) else object_id
    bare = F.when(raw.startswith("obj:"), F.substring(raw, 5, 1 << 20))
    plain = F.array_compact(
        F.array(
            raw, F.when(raw.startswith("obj:"), bare).otherwise(F.concat(F.lit("obj:"), raw)),
            F.when(raw.startswith("source-object:"), F.substring(raw, 15, 1 << 20)),
        )
    )
    digits = F.transform(plain, lambda x: F.regexp_extract(x, r"^(?:obj:)?(?:symbol|global|ram):([0-9a-fA-F]{1,15})(?::|$)", 1))
    at = F.transform(
        F.filter(digits, lambda x: x != ""),
        lambda x: F.concat(F.lit("address:"), F.coalesce(F.nullif(F.regexp_replace(F.lower(x), "^0+", ""), F.lit("")), F.lit("0"))),
    )
    return F.when(known(raw).isNull(), F.array().cast("array<string>")).otherwise(F.array_sort(F.array_distinct(F.concat(plain, at))))


def access_path_offset(path: Column | str) -> Column:
    """The byte offset of an access path: offsets after the last 'deref' summed; any other step gives NULL."""
    p = F.col(path) if isinstance(path, str) else path
    last = F.aggregate(F.sequence(F.lit(0), F.size(p)), F.lit(0), lambda a, i: F.when((i > 0) & (F.get(p, i - 1) == "deref"), i).otherwise(a))
    rest = F.slice(p, last + 1, F.greatest(F.size(p) - last, F.lit(0)))
    value = lambda x: F.when(x.rlike("^(byte|field)_offset:"), literal_integer(F.regexp_extract(x, r"^[a-z_]+:(.*)$", 1)))
    return F.when(p.isNotNull(), F.aggregate(rest, F.lit(0).cast("bigint"), lambda a, x: a + value(x)))


def body_fingerprint(*parts: Column | str) -> Column:
    """A content hash for classes of equal records."""
    texts = [F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("")) for p in parts]
    return F.sha2(reduce(lambda a, b: F.concat(a, F.lit("\x1f"), b), texts), 256)
