"""Scalar functions of the telemetry engine as Column builders: JVM expressions only."""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the data contract: two-label suffixes and top labels that can't be registered.
MULTI_SUFFIXES = tuple("co.uk org.uk ac.uk gov.uk ltd.uk plc.uk com.au net.au org.au edu.au gov.au co.in net.in org.in gov.in ac.in edu.in res.in nic.in co.jp ne.jp or.jp com.br com.cn net.cn org.cn com.sg com.my co.nz co.za com.mx com.tr co.kr com.hk com.tw co.id com.ar com.sa com.eg co.th".split())
NON_REGISTRABLE = ("local", "localdomain", "lan", "internal", "home", "arpa", "corp", "intranet", "test", "invalid")
# Fixed values of the identifier contract: namespaces of name-based identifiers.
NAMESPACES = {
    "event": "5d0c1c52-8a4e-4f0e-9a51-3e3b8f6f2a01",
    "incident": "5d0c1c52-8a4e-4f0e-9a51-3e3b8f6f2a02",
    "update": "5d0c1c52-8a4e-4f0e-9a51-3e3b8f6f2a03",
    "alert": "5d0c1c52-8a4e-4f0e-9a51-3e3b8f6f2a04",
    "feature": "5d0c1c52-8a4e-4f0e-9a51-3e3b8f6f2a05",
    "invalid": "5d0c1c52-8a4e-4f0e-9a51-3e3b8f6f2a06",
}
SEVERITIES = ("info", "low", "medium", "high", "critical")


def micros(ts: str = "ts") -> Column:
    """Microseconds since 1970 of a timestamp without zone; independent of the session's zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', {ts})")


def normal_name(query: Column) -> Column:
    """Lower case, no outer white space, no trailing dots; null unless 1 to 253 characters are left."""
    name = F.regexp_replace(F.lower(F.trim(query)), r"\.+$", "")
    return F.when(F.length(name).between(1, 253), name)


def _labels(name: Column) -> tuple[Column, Column, Column]:
    """Labels of a name, how many its suffix has, and whether it has no registrable domain."""
    labels = F.split(name, r"\.")
    n = F.size(labels)
    suffix = F.when((n >= 3) & F.concat_ws(".", F.slice(labels, -2, 2)).isin(*MULTI_SUFFIXES), 2).otherwise(1)
    bad = (n < 2) | F.array_contains(labels, "") | F.element_at(labels, -1).isin(*NON_REGISTRABLE) | name.rlike(r"^[0-9.]+$") | name.contains(":")
    return labels, suffix, bad


def registrable(name: Column) -> Column:
    """The registrable domain: one label before a one- or two-label suffix; null where there is none."""
    labels, suffix, bad = _labels(name)
    return F.when(~bad, F.when(suffix == 2, F.concat_ws(".", F.slice(labels, -3, 3))).otherwise(F.concat_ws(".", F.slice(labels, -2, 2))))


def second_label(name: Column) -> Column:
    """The label right before the suffix; null where nothing is registrable."""
    labels, suffix, bad = _labels(name)
    return F.when(~bad, F.when(suffix == 2, F.element_at(labels, -3)).otherwise(F.element_at(labels, -2)))


def below_registrable(name: Column) -> Column:
    """The labels below the registrable domain, joined by dots; null where there are none."""
    labels, suffix, bad = _labels(name)
    n = F.size(labels) - suffix - 1
    return F.when(~bad & (n > 0), F.concat_ws(".", F.slice(labels, F.lit(1), F.greatest(n, F.lit(0)))))


def entropy(text: Column) -> Column:
    """Shannon entropy in bits a character."""
    length = F.length(text).cast("double")
    share = lambda c: (F.length(text) - F.length(F.replace(text, c, F.lit("")))) / length
    letters = F.array_distinct(F.split(text, ""))
    return F.when(F.length(text) > 0, -F.aggregate(letters, F.lit(0.0), lambda a, c: F.when(F.length(c) > 0, a + share(c) * F.log2(share(c))).otherwise(a))).otherwise(0.0)


def class_ratio(text: Column, characters: str) -> Column:
    """Share of characters that the class `characters` (as inside brackets of a pattern) has."""
    return F.length(F.regexp_replace(text, f"[^{characters}]", "")) / F.greatest(F.length(text), F.lit(1))


def longest_run(text: Column, characters: str) -> Column:
    return F.coalesce(F.array_max(F.transform(F.regexp_extract_all(text, F.lit(f"[{characters}]+"), 0), F.length)), F.lit(0))


def fnv1a32(text: Column) -> Column:
    codes = F.transform(F.filter(F.split(text, ""), lambda c: F.length(c) > 0), lambda c: F.ascii(c).cast("long"))
    return F.aggregate(codes, F.lit(2166136261), lambda h, b: (h.bitwiseXOR(b) * 16777619).bitwiseAND(F.lit(4294967295)))


def generated_looking(label: Column) -> Column:
    """The lexical rule for names that look generated."""
    run = longest_run(label, "bcdfghjklmnpqrstvwxyz")
    return (F.length(label) >= 10) & (entropy(label) >= 3.3) & ((class_ratio(label, "0-9") >= 0.2) | (run >= 4))


def uuid5(namespace: str, *parts: Column) -> Column:
    """A name-based identifier (version 5) over parts joined by '|'; null parts are empty."""
    name = F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    digest = F.sha1(F.concat(F.unhex(F.lit(NAMESPACES[namespace].replace("-", ""))), name.cast("binary")))
    variant = F.element_at(F.array(*map(F.lit, "89ab")), F.expr("1").cast("int") + F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4)
    return F.concat_ws("-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.concat(F.lit("5"), F.substring(digest, 14, 3)), F.concat(variant, F.substring(digest, 18, 3)), F.substring(digest, 21, 12))


def host_of(url: str) -> Column:
    return F.lower(F.regexp_extract(url, r"^[a-z]+://([^/:?#]+)", 1))


def in_network(address: Column, network: int, bits: int) -> Column:
    """Whether an IPv4 address, as a number, lies in network/bits."""
    mask = (0xFFFFFFFF << (32 - bits)) & 0xFFFFFFFF
    return address.bitwiseAND(F.lit(mask)) == F.lit(network & mask)


def ipv4_number(text: Column) -> Column:
    """A dotted IPv4 address as a number; null unless four parts without leading zeros are at most 255."""
    part = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
    parts = F.split(text, r"\.")
    number = sum((F.element_at(parts, i + 1).cast("long") * 256 ** (3 - i) for i in range(4)), F.lit(0).cast("long"))
    return F.when(text.rlike(rf"^{part}(\.{part}){{3}}$"), number)


def ipv6_digits(text: Column) -> Column:
    """The 32 hexadecimal digits of an IPv6 address in any of its text forms, without a zone; null for others."""
    part = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
    tail = F.regexp_extract(text, r":([0-9]+\.[0-9]+\.[0-9]+\.[0-9]+)$", 1)
    words = F.lpad(F.lower(F.hex(ipv4_number(tail))), 8, "0")
    plain = F.when(tail == "", F.lower(text)).otherwise(F.concat(F.lower(F.substring(text, F.lit(1), F.length(text) - F.length(tail))), F.substring(words, 1, 4), F.lit(":"), F.substring(words, 5, 4)))
    sides = F.split(plain, "::")
    groups = lambda side: F.filter(F.split(side, ":"), lambda g: g != "")
    left, right = groups(F.element_at(sides, 1)), F.when(F.size(sides) > 1, groups(F.element_at(sides, -1))).otherwise(F.array().cast("array<string>"))
    known = F.size(left) + F.size(right)
    gap = F.when(F.size(sides) > 1, F.array_repeat(F.lit("0"), F.greatest(8 - known, F.lit(0)))).otherwise(F.array().cast("array<string>"))
    digits = F.concat_ws("", F.transform(F.concat(left, gap, right), lambda g: F.lpad(g, 4, "0")))
    side = "([0-9a-f]{1,4}(:[0-9a-f]{1,4})*)"
    shaped = F.length(text).between(2, 45) & ((tail == "") | tail.rlike(rf"^{part}(\.{part}){{3}}$"))
    whole = plain.rlike(rf"^{side}$") & (known == 8) | plain.rlike(rf"^{side}?::{side}?$") & (known <= 7)
    return F.when(shaped & whole, digits)


def is_ip(text: Column) -> Column:
    """Whether a text is an IPv4 or IPv6 address."""
    return F.coalesce(ipv4_number(text).isNotNull() | ipv6_digits(text).isNotNull(), F.lit(False))


def in_networks(text: Column, networks: list[str]) -> Column:
    """Whether an address of either version lies in one of some networks ('10.0.0.0/8', 'fd00::/8')."""
    out = F.lit(False)
    for spec in networks:
        net = ipaddress.ip_network(spec, strict=False)
        if net.version == 4:
            inside = in_network(ipv4_number(text), int(net.network_address), net.prefixlen)
        else:
            whole, bits = divmod(net.prefixlen, 4)
            digits, wanted = ipv6_digits(text), f"{int(net.network_address):032x}"
            inside = F.substring(digits, 1, whole) == wanted[:whole]
            if bits:
                nibble = F.conv(F.substring(digits, whole + 1, 1), 16, 10).cast("int")
                inside = inside & (F.shiftright(nibble, 4 - bits) == int(wanted[whole], 16) >> (4 - bits))
        out = out | F.coalesce(inside, F.lit(False))
    return out


def under_domain(name: Column, domains: list[str]) -> Column:
    """Whether a name equals one of the domains or lies below it."""
    out = F.lit(False)
    for d in domains:
        out = out | (name == d) | name.endswith("." + d)
    return out


def severity_rank(severity: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, SEVERITIES)), severity).cast("int") - 1


def bucket_up(ts: Column, step: int) -> Column:
    """The next multiple of `step` strictly above ts."""
    return (F.floor(ts / step) + 1) * step


def strict_timestamp(text: Column) -> Column:
    """An ISO timestamp with at most six fractional digits and a final Z; anything else is null."""
    return F.when(text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]{1,6})?Z$"), F.try_to_timestamp(text))


def poisoned_sum(x: Column) -> Column:
    """The sum of a group, or null if the group has a null."""
    return F.when(F.count_if(x.isNull()) == 0, F.sum(x))


def ewma(ordered: Column, alpha: float) -> Column:
    """The exponentially weighted mean of an ordered array; the first value starts it."""
    first = F.element_at(ordered, 1).cast("double")
    return F.aggregate(F.slice(ordered, 2, F.greatest(F.size(ordered) - 1, F.lit(0))), first, lambda a, x: a + F.lit(alpha) * (x - a))


def ewma_moments(ordered: Column, alpha: float) -> Column:
    """n, mean and var (exponentially weighted) of an ordered array; the first value starts the mean."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("var"))

    def step(s: Column, x: Column) -> Column:
        apart = x.cast("double") - s["mean"]
        first = s["n"] == 0
        return F.struct((s["n"] + 1).alias("n"), F.when(first, x.cast("double")).otherwise(s["mean"] + alpha * apart).alias("mean"), F.when(first, 0.0).otherwise((1 - alpha) * (s["var"] + alpha * apart * apart)).alias("var"))

    return F.aggregate(ordered, start, step)
