"""IP addresses as columns: parsing, CIDR membership and the internal/external split."""

from __future__ import annotations

import ipaddress
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_V4 = rf"\A{_OCTET}(?:\.{_OCTET}){{3}}\z"


def v4_sql(value: str) -> str:
    """Dotted IPv4 text, given as a SQL expression, as a number; NULL for anything else."""
    octets = " + ".join(
        f"try_cast(substring_index(substring_index({value}, '.', {i + 1}), '.', -1) AS bigint) * {256 ** (3 - i)}"
        for i in range(4))
    pattern = _V4.replace("\\", "\\\\")
    return f"CASE WHEN rlike({value}, '{pattern}') THEN {octets} END"


def v4_number(column: str) -> Column:
    """``v4_sql`` as a column."""
    return F.expr(v4_sql(column))


def v6_hex(address: Column) -> Column:
    """IPv6 text as 32 hex digits; NULL for anything else."""
    return _v6_parser()(address)


def _v6_parser():
    """Expanding ``::`` and dotted tails takes many nested built-ins, which measured some ten times slower than handing
    Arrow batches to the address parser of the standard library. It runs only where a rule names an IPv6 block.
    """
    def hex32(address: str | None) -> str | None:
        from ipaddress import IPv6Address

        if not address or ":" not in address:
            return None
        try:
            return f"{int(IPv6Address(address.split('%')[0])):032x}"
        except ValueError:
            return None

    @F.pandas_udf("string")
    def parse(addresses: pd.Series) -> pd.Series:
        parsed = {a: hex32(a) for a in set(addresses)}
        return pd.Series([parsed[a] for a in addresses], dtype=object)

    return parse


def v6_sql(value: str) -> str:
    """``v6_hex`` over a SQL expression, registered with the session on first use."""
    spark = SparkSession.active()
    if not spark.catalog.functionExists("fleetsift_v6_hex"):
        spark.udf.register("fleetsift_v6_hex", _v6_parser())
    return f"fleetsift_v6_hex({value})"


def parse_cidr(cidr: str) -> tuple[int, int, int] | None:
    """(family, network number, prefix length) of a CIDR text, or None if it is malformed."""
    address, slash, prefix = cidr.partition("/")
    if not slash:
        return None
    try:
        parsed = ipaddress.ip_address(address.split("%")[0])
        bits = 32 if parsed.version == 4 else 128
        return parsed.version, int(parsed), max(0, min(int(prefix), bits))
    except ValueError:
        return None


def in_cidr(v4: Callable[[], str], v6: Callable[[], str], cidr: str) -> str:
    """Whether an address lies in a CIDR block, as SQL that is never NULL. ``v4`` and ``v6`` give its parsed forms."""
    block = parse_cidr(cidr)
    if block is None:
        return "false"
    family, network, prefix = block
    if family == 4:
        shift = 32 - prefix
        return f"coalesce(shiftright({v4()}, {shift}) = {network >> shift}L, false)"
    digits, rest = divmod(prefix, 4)
    text = f"{network:032x}"
    same = f"startswith({v6()}, '{text[:digits]}')"
    if rest:
        allowed = int(text[digits], 16) >> (4 - rest) << (4 - rest)
        nibbles = ", ".join(f"'{n:x}'" for n in range(allowed, allowed + (1 << (4 - rest))))
        same = f"({same} AND substring({v6()}, {digits + 1}, 1) IN ({nibbles}))"
    return f"coalesce({same}, false)"


def in_any_cidr(v4: Callable[[], str], v6: Callable[[], str], cidrs: list[str]) -> str:
    """Whether an address lies in one of the blocks, as SQL that is never NULL.

    IPv4 blocks are grouped by the length of their prefix, and the address's own prefix of that length is looked up among them: at most 33
    lookups, however many blocks there are.
    """
    by_shift: dict[int, dict[int, None]] = {}
    rest = []
    for cidr in cidrs:
        block = parse_cidr(cidr)
        if block and block[0] == 4:
            shift = 32 - block[2]
            by_shift.setdefault(shift, {})[block[1] >> shift] = None
        elif block:
            rest.append(in_cidr(v4, v6, cidr))
    tests = [f"coalesce(shiftright({v4()}, {shift}) IN ({', '.join(f'{n}L' for n in numbers)}), false)" for shift, numbers in sorted(by_shift.items())]
    return "(" + " OR ".join([*tests, *rest]) + ")" if tests or rest else "false"


def is_external(address: Column) -> Column:
    """The report's textual test for an address outside the local ranges; never NULL."""
    value = F.lower(F.trim(F.coalesce(address.cast("string"), F.lit(""))))
    local_names = value.isin("", "*", "::", "0.0.0.0", "::1", "localhost")
    local_prefixes = F.lit(False)
    for prefix in ("127.", "10.", "192.168.", "169.254.", "fe80:", "fc", "fd"):
        local_prefixes = local_prefixes | F.startswith(value, F.lit(prefix))
    return ~(local_names | local_prefixes | value.rlike(r"\A172\.(1[6-9]|2[0-9]|3[0-1])\."))
