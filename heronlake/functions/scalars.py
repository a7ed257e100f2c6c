"""Scalar functions on tags, ids, addresses and URLs, as column expressions."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

ZERO_ID = "0" * 64
_BECH32 = "qpzry9x8gf2tvdw0s3jn54khce6mua7l"


def is_hex32(c: Column) -> Column:
    """Starts with 64 lower-case hex digits; false for null."""
    return F.coalesce(c.rlike("^[0-9a-f]{64}"), F.lit(False))


def is_address(c: Column) -> Column:
    """``kind:pubkey:identifier`` with a non-empty identifier without colons."""
    return F.coalesce(c.rlike(r"^[0-9]+:[0-9a-f]{64}:[^:]+\z"), F.lit(False))


def present(c: Column) -> Column:
    """The value, or null where it is empty."""
    return F.nullif(c, F.lit(""))


def tag_value(tags: Column, name: str, at: int = 1) -> Column:
    """Element ``at`` of the first tag of that name; null without one."""
    return F.get(F.get(F.filter(tags, lambda t: F.get(t, F.lit(0)) == name), F.lit(0)), F.lit(at))


def tag_or(tags: Column, name: str, default: Column | str) -> Column:
    """The first tag's value; the default where it is missing or empty."""
    return F.coalesce(present(tag_value(tags, name)), default if isinstance(default, Column) else F.lit(default))


def address_part(c: Column, part: str) -> Column:
    """``kind``, ``pubkey`` or ``identifier`` of an address; the identifier may hold colons.  Null where it is no address."""
    k = {"kind": 1, "pubkey": 2, "identifier": 3}[part]
    return F.when(c.rlike("(?s)^[^:]*:[^:]*:.*$"), F.regexp_extract(c, "(?s)^([^:]*):([^:]*):(.*)$", k))


def url_without_scheme(c: Column) -> Column:
    """The URL without its first ``wss://`` and without trailing slashes."""
    at = F.instr(c, "wss://")
    cut = F.when(at > 0, F.concat(F.substring(c, F.lit(1), at - 1), F.substring(c, at + 6, F.length(c)))).otherwise(c)
    return F.regexp_replace(cut, "/+$", "")


def unique(*arrays: Column) -> Column:
    """All values of several arrays, each once, in the order of their first place."""
    return F.array_distinct(F.concat(*arrays))


def append_unique(target: Column, new: Column) -> Column:
    """An array with the values of another that it lacks."""
    return F.concat(target, F.array_except(new, target))


def without(array: Column, *others: Column) -> Column:
    """The values of an array that stand in none of the others; repeats stay."""
    return F.filter(array, lambda x: ~F.array_contains(F.concat(*others), x))


def normalize_url(c: Column) -> Column:
    """A relay URL in one form: ws scheme, lower-case host, no fragment or default port, ``/`` on a bare host, single slashes, no trailing one on a path, parameters in order of their names."""
    out = F.regexp_replace(F.regexp_replace(F.trim(c), "#.*$", ""), "^http", "ws")
    return _let(_let(out, _plain_host), _plain_path)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once: repeated in place, the expression would grow with every step."""
    return F.transform(F.array(value), use)[0]


def _plain_host(url: Column) -> Column:
    head = F.regexp_extract(url, "^(wss?://[^/?]*)", 1)
    out = F.when(head != "", F.concat(F.lower(head), F.substring(url, F.length(head) + 1, F.length(url)))).otherwise(url)
    out = F.regexp_replace(out, "^(ws://[^/?]*):80(/|\\?|$)", "$1$2")
    out = F.regexp_replace(out, "^(wss://[^/?]*):443(/|\\?|$)", "$1$2")
    return F.regexp_replace(out, "^(wss?://[^/?]+)$", "$1/")


def _plain_path(url: Column) -> Column:
    start = F.instr(url, "?")
    base = F.regexp_replace(F.substring_index(url, "?", 1), "(?<!:)/+", "/")
    base = F.regexp_replace(base, "^(wss?://[^/]+/.*[^/])/$", "$1")
    # A stable sort by name alone.
    named = F.transform(F.split(F.substring(url, start + 1, F.length(url)), "&"), lambda p, i: F.struct(F.substring_index(p, "=", 1).alias("name"), i.alias("i"), p.alias("p")))
    query = F.array_join(F.transform(F.array_sort(named), lambda x: x["p"]), "&")
    return F.when(start == 0, base).otherwise(F.concat(base, F.lit("?"), query))


def simple_url(c: Column) -> Column:
    """A relay URL for display: without scheme and last slash."""
    return F.regexp_replace(F.regexp_replace(c, "^(wss?|https?)://", ""), "/$", "")


def http_url(c: Column) -> Column:
    """The http(s) URL of a ws(s) one."""
    return F.regexp_replace(c, "^ws", "http")


def hash_prefix(c: Column) -> Column:
    """The first eight bytes of SHA-256, in hex."""
    return F.substring(F.sha2(c.cast("binary"), 256), 1, 16)


def id_suffix(c: Column) -> Column:
    """The last eight bytes of a 32-byte hex id, in hex."""
    return F.substring(c, 49, 16)


def backoff_seconds(failures: Column) -> Column:
    """How long a relay rests after failures: two minutes each, ten at most."""
    return F.least(failures * 120, F.lit(600))


def relays_per_user(users: Column) -> Column:
    """How many relays to read for each of so many users: fewer for more."""
    return F.when(users < 100, 4).when(users < 800, 3).when(users < 1200, 2).otherwise(1)


# Fixed values of BIP 173: the generator of its checksum.
_GENERATOR = (0x3B6A57B2, 0x26508E6D, 0x1EA119FA, 0x3D4233DD, 0x2A1462B3)


def _polymod(values: list[int]) -> int:
    check = 1
    for v in values:
        top = check >> 25
        check = (check & 0x1FFFFFF) << 5 ^ v
        for i, g in enumerate(_GENERATOR):
            check ^= g if top >> i & 1 else 0
    return check


def _polymod_of(values: Column, start: int) -> Column:
    """The checksum of a column of arrays of 5-bit numbers, after ``start``."""

    def step(check: Column, v: Column) -> Column:
        out = F.shiftleft(check.bitwiseAND(F.lit(0x1FFFFFF)), 5).bitwiseXOR(v)
        for i, g in enumerate(_GENERATOR):
            out = out.bitwiseXOR(F.shiftright(check, 25 + i).bitwiseAND(F.lit(1)) * F.lit(g))
        return out

    return F.aggregate(values, F.lit(start), step)


def _regroup(values: Iterator[int], a: int, b: int, pad: bool) -> list[int]:
    held = bits = 0
    out = []
    for v in values:
        held, bits = held << a | v, bits + a
        while bits >= b:
            bits -= b
            out.append(held >> bits & (1 << b) - 1)
    if pad and bits:
        out.append(held << b - bits & (1 << b) - 1)
    return out


def bech32_encode(prefix: str, raw: bytes) -> str:
    """Bytes in the bech32 form of BIP 173, of any length."""
    data = _regroup(iter(raw), 8, 5, True)
    head = [ord(c) >> 5 for c in prefix] + [0] + [ord(c) & 31 for c in prefix]
    check = _polymod(head + data + [0] * 6) ^ 1
    return prefix + "1" + "".join(_BECH32[x] for x in data + [check >> 5 * (5 - i) & 31 for i in range(6)])


def bech32_decode(code: str) -> tuple[str, bytes] | None:
    """(prefix, bytes) of a bech32 code; None where it is none."""
    prefix, _, rest = code.lower().rpartition("1")
    if not prefix or len(rest) < 6 or any(c not in _BECH32 for c in rest):
        return None
    data = [_BECH32.index(c) for c in rest]
    if _polymod([ord(c) >> 5 for c in prefix] + [0] + [ord(c) & 31 for c in prefix] + data) != 1:
        return None
    return prefix, bytes(_regroup(iter(data[:-6]), 5, 8, False))


def decode_pointer(code: str) -> dict | None:
    """What a code points to: id, or pubkey, or kind, pubkey and identifier, with relays.

    A 64-digit hex string is an id.  ``note`` and ``npub`` hold bare bytes; ``nevent``,
    ``nprofile`` and ``naddr`` hold type-length-value entries.  None for others.
    """
    if len(code) == 64 and all(c in "0123456789abcdef" for c in code):
        return {"id": code}
    found = bech32_decode(code)
    if found is None:
        return None
    prefix, raw = found
    if prefix in ("note", "npub"):
        return {"id" if prefix == "note" else "pubkey": raw.hex()}
    entries: dict[int, list[bytes]] = {}
    while len(raw) >= 2:
        entries.setdefault(raw[0], []).append(raw[2 : 2 + raw[1]])
        raw = raw[2 + raw[1] :]
    out: dict = {"relays": [x.decode("ascii", "replace") for x in entries.get(1, [])]}
    first = entries.get(0, [b""])[0]
    if prefix == "nevent":
        return out | {"id": first.hex()} | ({"author": entries[2][0].hex()} if 2 in entries else {})
    if prefix == "nprofile":
        return out | {"pubkey": first.hex()}
    if prefix == "naddr" and 2 in entries and 3 in entries:
        return out | {"identifier": first.decode("utf-8", "replace"), "pubkey": entries[2][0].hex(), "kind": int.from_bytes(entries[3][0], "big")}
    return None


def encode_pointer(kind: str, value: str | Mapping) -> str:
    """The code of a pointer: what :func:`decode_pointer` gives back.

    ``note`` and ``npub`` take a hex string; ``nevent``, ``nprofile`` and
    ``naddr`` a mapping with its fields and relays.
    """
    if kind in ("note", "npub"):
        return bech32_encode(kind, bytes.fromhex(str(value)))
    main = {"nevent": lambda: bytes.fromhex(value["id"]), "nprofile": lambda: bytes.fromhex(value["pubkey"]), "naddr": lambda: value["identifier"].encode()}[kind]()
    entries = [(0, main), *[(1, r.encode("ascii")) for r in value.get("relays", ())]]
    author = value.get("author") if kind == "nevent" else value.get("pubkey") if kind == "naddr" else None
    if author:
        entries.append((2, bytes.fromhex(author)))
    if kind == "naddr":
        entries.append((3, int(value["kind"]).to_bytes(4, "big")))
    return bech32_encode(kind, b"".join(bytes([t, len(x)]) + x for t, x in entries))


def npub(c: Column) -> Column:
    """The bech32 form of a hex public key; null where it is none."""
    prefix = "npub"
    start = _polymod([ord(x) >> 5 for x in prefix] + [0] + [ord(x) & 31 for x in prefix])
    # Five hex digits are four numbers of five bits; 64 digits and a zero are 52.
    padded = F.rpad(F.substring(c, 1, 64), 65, "0")
    number = lambda i: F.conv(F.substring(padded, i * 5 + 1, F.lit(5)), 16, 10).cast("int")
    fives = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(12)), lambda i: _let(number(i), lambda n: F.transform(F.array(*[F.lit(k) for k in (15, 10, 5, 0)]), lambda k: F.call_function("shiftright", n, k).bitwiseAND(F.lit(31))))))
    digits = lambda data, check: F.concat(data, F.transform(F.array(*[F.lit(25 - 5 * i) for i in range(6)]), lambda k: F.call_function("shiftright", check, k).bitwiseAND(F.lit(31))))
    code = _let(fives, lambda data: _let(_polymod_of(F.concat(data, F.array(*[F.lit(0)] * 6)), start).bitwiseXOR(F.lit(1)), lambda check: digits(data, check)))
    letters = F.transform(code, lambda v: F.substring(F.lit(_BECH32), v + 1, F.lit(1)))
    return F.when(is_hex32(c), F.concat(F.lit(prefix + "1"), F.array_join(letters, "")))


def short_npub(code: Column) -> Column:
    """The start and the end of an npub code."""
    return F.concat(F.substring(code, 1, 8), F.lit("…"), F.substring(code, 60, 100))
