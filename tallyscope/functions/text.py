"""Text, instant, port and endpoint parsing as column expressions."""
from __future__ import annotations

import hashlib
import ipaddress
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Whitespace trimmed from every field, and the address alphabets.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0            "
    "    　"
)
BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
BECH32 = "qpzry9x8gf2tvdw0s3jn54khce6mua7l"
BECH32_GENERATOR = (0x3B6A57B2, 0x26508E6D, 0x1EA119FA, 0x3D4233DD, 0x2A1462B3)
BECH32_FINAL = (1, 0x2BC830A3)

INSTANT_PATTERN = (
    r"^(\d{4})(-?)(\d{2})\2(\d{2})(?:.(\d{2})(?:(:?)(\d{2})(?:\6(\d{2})(?:[.,](\d+))?)?)?)?"
    r"(?:([Zz])|([+-])(\d{2})(?::?(\d{2})(?::?(\d{2}))?)?)?$"
)
PLAIN_INSTANT_PATTERN = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(\.\d{1,6})?([Zz]|[+-]\d{2}:\d{2})?$"
IPV4_PATTERN = r"^((25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)$"


def strip(value: Column) -> Column:
    return F.btrim(value, F.lit(WHITESPACE))


def parse_instant(value: Column) -> Column:
    """ISO 8601 text to an instant; text without an offset is UTC, anything else is null.

    The usual spelling is one pattern test and Spark's own cast; only other spellings (basic
    form, reduced precision, comma fractions, offsets without colon) are taken apart.
    """
    text = strip(value)
    plain = F.when(
        text.rlike("([Zz]|[+-][0-9]{2}:[0-9]{2})$"), F.upper(text).try_cast("timestamp")
    ).otherwise(F.concat(text, F.lit("+00:00")).try_cast("timestamp"))
    return F.when(text.rlike(PLAIN_INSTANT_PATTERN), plain).otherwise(_assembled_instant(text))


def _assembled_instant(text: Column) -> Column:
    part = lambda i: F.regexp_extract(text, INSTANT_PATTERN, i)
    or_zero = lambda c: F.when(c == "", "00").otherwise(c)
    stamp = F.concat(
        part(1), F.lit("-"), part(3), F.lit("-"), part(4), F.lit(" "), or_zero(part(5)), F.lit(":"),
        or_zero(part(7)), F.lit(":"), or_zero(part(8)), F.lit("."), F.rpad(F.substring(part(9), 1, 6), 6, "0"),
        F.lit("+00:00"))
    offset = or_zero(part(12)).cast("int") * 3600 + or_zero(part(13)).cast("int") * 60 + or_zero(part(14)).cast("int")
    signed = F.when(part(11) == "-", -offset).otherwise(offset)
    sane = text.rlike(INSTANT_PATTERN) & ~text.rlike(r"[+-](2[4-9]|[3-9]\d)(:?\d{2}){0,2}$|[+-]\d{2}:?[6-9]\d(:?\d{2})?$")
    return F.when(sane, F.timestamp_micros(
        F.unix_micros(stamp.try_cast("timestamp")) - signed.cast("bigint") * 1_000_000))


def parse_port(value: Column) -> Column:
    """Integer text in 0-65535, or null."""
    number = F.regexp_replace(value, "_", "").try_cast("decimal(38,0)")
    return F.when(value.rlike(r"^[+-]?\d+(_\d+)*$") & number.between(0, 65535), number.cast("int"))


def _canonical_ip(text: str | None) -> str | None:
    if text is None:
        return None
    try:
        return str(ipaddress.ip_address(text))
    except ValueError:
        return None


@F.pandas_udf(T.StringType())
def _ipv6(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        seen = {t: _canonical_ip(t) for t in texts.dropna().unique()}
        yield pd.Series([None if t is None else seen.get(t) for t in texts.tolist()], dtype=object)


def canonical_ip(value: Column) -> Column:
    """Canonical IPv4 or IPv6 text, or null. IPv4 stays in the JVM; only text with a colon leaves it."""
    return F.when(value.rlike(IPV4_PATTERN), value).otherwise(_ipv6(F.when(value.contains(":"), value)))


def _base58_ok(address: str) -> bool:
    number = 0
    for letter in address:
        number = number * 58 + BASE58.index(letter)
    zeros = len(address) - len(address.lstrip("1"))
    raw = bytes(zeros) + number.to_bytes((number.bit_length() + 7) // 8, "big")
    if len(raw) < 5:
        return False
    once = hashlib.sha256(raw[:-4]).digest()
    return hashlib.sha256(once).digest()[:4] == raw[-4:]


def _bech32_ok(address: str) -> bool:
    if address not in (address.lower(), address.upper()):
        return False
    prefix, mark, data = address.lower().rpartition("1")
    if not mark or not prefix or len(data) < 6 or set(data) - set(BECH32):
        return False
    codes = [ord(c) for c in prefix]
    values = [c >> 5 for c in codes] + [0] + [c & 31 for c in codes] + [BECH32.index(c) for c in data]
    state = 1
    for value in values:
        high, state = state >> 25, ((state & 0x1FFFFFF) << 5) ^ value
        for bit, generator in enumerate(BECH32_GENERATOR):
            state ^= generator if (high >> bit) & 1 else 0
    return state in BECH32_FINAL


def _checks_out(address: str) -> bool:
    if address[0] in "13" and not set(address) - set(BASE58):
        return _base58_ok(address)
    return _bech32_ok(address)


@F.pandas_udf(T.IntegerType())
def _verified(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    known: dict[str, bool] = {}
    for lists in batches:
        counts = []
        for addresses in lists:
            good = 0
            for address in addresses:
                if address not in known:
                    if len(known) >= 200_000:
                        known.clear()
                    known[address] = _checks_out(address)
                good += known[address]
            counts.append(good)
        yield pd.Series(counts, dtype="int32")


def unverified_addresses(addresses: Column) -> Column:
    """How many addresses fail their Base58Check or Bech32(m) checksum.

    Text that has neither shape fails in the JVM; only possible addresses go to the Arrow
    function, once per distinct address and task.
    """
    possible = F.filter(addresses, lambda a: a.rlike(f"^[13][{BASE58}]*$|^(?is:(?:bc|tb).*1|bcrt)"))
    return F.size(addresses) - _verified(possible)


#: What follows the bytes of an identifier that is not packed, so that it is longer than any packed one.
_NOT_PACKED = bytes(33)


def packed(identifier: Column) -> Column:
    """An identifier as bytes for joins: 64 lower-case hex digits as 32 bytes, any other text as it is, marked."""
    return F.when(identifier.rlike("^[0-9a-f]{64}$") & (F.length(identifier) == 64), F.unhex(identifier)).otherwise(
        F.concat(identifier.cast("binary"), F.lit(_NOT_PACKED)))


def unpacked(data: Column) -> Column:
    """The identifier that :func:`packed` took."""
    plain = F.substring(data, F.lit(1), F.octet_length(data) - len(_NOT_PACKED)).cast("string")
    return F.when(F.octet_length(data) == 32, F.lower(F.hex(data))).otherwise(plain)
