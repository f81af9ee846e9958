"""Rule leaves: Boolean Columns that are never NULL.

Rule logic is two-valued: a leaf over a missing field is false, so its negation
is true.  Every leaf here is coalesced; combinators may then use plain ``& | ~``.
"""

from __future__ import annotations

import base64
import ipaddress
import itertools
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from detectframe.functions.scalar import as_num
from detectframe.scale import all_true, any_true

# Letters whose case folding differs between engines; folding them first makes
# lower() agree with case-insensitive regex matching for ASCII literals.
_FOLD_FROM, _FOLD_TO = "İıſK", "iisk"


def two_valued(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def fold(f: Column) -> Column:
    """Case-folded text; compute it once per field and share it between leaves."""
    return F.lower(F.translate(f.cast("string"), _FOLD_FROM, _FOLD_TO))


def split_wildcards(pattern: str) -> list[str | None]:
    """Pattern text to a list of literals and wildcards (``"*"`` / ``"?"`` as 1-tuples)."""
    parts: list = []
    lit: list[str] = []
    i = 0
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\" and i + 1 < len(pattern) and pattern[i + 1] in "*?\\":
            lit.append(pattern[i + 1])
            i += 2
            continue
        if ch in "*?":
            if lit:
                parts.append("".join(lit))
                lit = []
            parts.append((ch,))
        else:
            lit.append(ch)
        i += 1
    if lit:
        parts.append("".join(lit))
    return parts


def escape_value(text: str) -> str:
    """Escape a plain text so that it has no wildcard meaning."""
    return re.sub(r"([\\*?])", r"\\\1", text)


def java_quote(text: str) -> str:
    return re.sub(r"([.*+?^$\[\](){}\\|])", r"\\\1", text)


def wildcard_regex(parts: list, cased: bool) -> str:
    body = "".join(
        java_quote(p) if isinstance(p, str) else (".*" if p[0] == "*" else ".") for p in parts
    )
    # d: only \n ends a line for '.', u: Unicode case folding
    return f"(?{'d' if cased else 'iud'})^(?:{body})\\z"


def like_shape(parts: list, cased: bool) -> tuple[str, str]:
    """How a wildcard match is tested: ``("equals" | "contains" | "startswith" | "endswith", text)`` or ``("regex", pattern)``.

    Text is lower-cased unless ``cased``.  ``.`` does not match a newline, so a value with one cannot match a pattern
    with ``*`` at that place: whoever uses the string forms with a ``*`` must keep that rule.
    """
    lits = [p for p in parts if isinstance(p, str)]
    stars = [p for p in parts if not isinstance(p, str)]
    if not cased and not all(x.isascii() for x in lits):
        return "regex", wildcard_regex(parts, cased)
    if not stars:
        want = lits[0] if lits else ""
        return "equals", want if cased else want.lower()
    if len(lits) == 1 and all(p == ("*",) for p in stars) and "\n" not in lits[0]:
        want = lits[0] if cased else lits[0].lower()
        before, after = not isinstance(parts[0], str), not isinstance(parts[-1], str)
        return "contains" if before and after else "startswith" if after else "endswith", want
    return "regex", wildcard_regex(parts, cased)


def like_parts(f: Column, parts: list, cased: bool = False, folded: Column | None = None) -> Column:
    """Anchored wildcard match; simple shapes use string functions instead of regex."""
    text = f.cast("string")
    shape, want = like_shape(parts, cased)
    if shape == "regex":
        return two_valued(text.rlike(want))
    subject = text if cased else (fold(f) if folded is None else folded)
    if shape == "equals":
        return two_valued(subject == want)
    return two_valued(getattr(subject, shape)(want) & ~text.contains("\n"))


def like_ci(f: Column, pattern: str, folded: Column | None = None) -> Column:
    """B2: exact / ``*`` / ``?`` match, case-insensitive."""
    return like_parts(f, split_wildcards(pattern), False, folded)


def like_cs(f: Column, pattern: str) -> Column:
    """The same, case-sensitive."""
    return like_parts(f, split_wildcards(pattern), True)


def _around(value: str, before: bool, after: bool) -> str:
    return ("*" if before else "") + escape_value(value) + ("*" if after else "")


def contains(f: Column, values: list[str], cased: bool = False) -> Column:
    """Any of the values is a substring."""
    one = like_cs if cased else like_ci
    return any_true([one(f, _around(v, True, True)) for v in values])


def startswith(f: Column, values: list[str], cased: bool = False) -> Column:
    """B3."""
    one = like_cs if cased else like_ci
    return any_true([one(f, _around(v, False, True)) for v in values])


def endswith(f: Column, values: list[str], cased: bool = False) -> Column:
    """B3."""
    one = like_cs if cased else like_ci
    return any_true([one(f, _around(v, True, False)) for v in values])


def contains_all(f: Column, values: list[str], cased: bool = False) -> Column:
    """Every value is a substring."""
    one = like_cs if cased else like_ci
    return all_true([one(f, _around(v, True, True)) for v in values])


def to_java_regex(pattern: str, flags: str = "") -> str:
    """Regex text for the JVM.  Constructs the JVM lacks raise ``ValueError``.

    ``i`` is the only flag rules use besides ``m`` and ``s``; named groups change
    spelling, ``\\Z`` means the very end, ``.`` stops at ``\\n`` only.
    """
    if "(?P=" in pattern or "(?#" in pattern or re.search(r"\(\?\(", pattern):
        raise ValueError(f"regex needs syntax the JVM has not: {pattern}")
    text = pattern.replace("(?P<", "(?<")
    text = re.sub(r"(?<!\\)((?:\\\\)*)\\Z", r"\1\\z", text)
    re.compile(pattern)
    # U: word, digit, space and boundary classes know all letters and digits, as rule authors expect
    classes = "U" if re.search(r"\\[wWdDsSbB]", pattern) else ""
    inline = "d" + "".join(sorted(set(flags) & set("ims"))) + ("u" if "i" in flags else "") + classes
    return f"(?{inline}){text}"


def regex(f: Column, pattern: str, flags: str = "") -> Column:
    """Unanchored search, case-sensitive unless ``flags`` has ``i``."""
    return two_valued(f.cast("string").rlike(to_java_regex(pattern, flags)))


def ipv4_bits(f: Column) -> Column:
    """Dotted quad to bigint; anything else is NULL."""
    s = f.cast("string")
    octet = r"(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
    ok = s.rlike(rf"^{octet}(\.{octet}){{3}}\z")
    part = lambda i: F.split_part(s, F.lit("."), F.lit(i)).try_cast("bigint")
    return F.when(ok, part(1) * 16777216 + part(2) * 65536 + part(3) * 256 + part(4))


def ipv6_groups(f: Column) -> Column:
    """IPv6 text to eight 4-digit lower-case hex groups joined by ':'; else NULL."""
    s = F.lower(f.cast("string"))
    ok = s.rlike(r"^[0-9a-f:]+\z") & s.contains(":") & ~s.rlike(r":::|::.*::|[0-9a-f]{5}")
    halves = F.split(s, "::")
    pieces = lambda h: F.filter(F.split(h, ":"), lambda x: x != "")
    left = pieces(halves[0])
    right = F.when(F.size(halves) > 1, pieces(F.get(halves, F.lit(1)))).otherwise(
        F.array().cast("array<string>")
    )
    missing = F.lit(8) - F.size(left) - F.size(right)
    full = F.concat(left, F.array_repeat(F.lit("0"), F.greatest(missing, F.lit(0))), right)
    text = F.array_join(F.transform(full, lambda x: F.lpad(x, 4, "0")), ":")
    has_gap = F.size(halves) > 1
    return F.when(ok & (F.size(full) == 8) & (has_gap | (missing == 0)), text)


def cidr(f: Column, net: str) -> Column:
    """Address containment, IPv4 by bits and IPv6 by text prefix of its bits."""
    n = ipaddress.ip_network(net, strict=False)
    if n.version == 4:
        shift = 32 - n.prefixlen
        want = int(n.network_address) >> shift
        return two_valued(F.shiftright(ipv4_bits(f), shift) == F.lit(want).cast("bigint"))
    groups = n.network_address.exploded
    whole, rest = divmod(n.prefixlen, 16)
    addr = ipv6_groups(f)
    test = addr.startswith(groups[: whole * 5].rstrip(":")) if whole else addr.isNotNull()
    if rest:
        got = F.conv(F.substring(addr, whole * 5 + 1, 4), 16, 10).try_cast("bigint")
        want = int(groups.split(":")[whole], 16) >> (16 - rest)
        test = test & (F.shiftright(got, 16 - rest) == want)
    return two_valued(test)


def num_eq(f: Column, n: float) -> Column:
    """Equal as numbers; not a number -> false."""
    return two_valued(as_num(f) == F.lit(float(n)))


_COMPARE = {
    "lt": lambda a, b: a < b,
    "lte": lambda a, b: a <= b,
    "gt": lambda a, b: a > b,
    "gte": lambda a, b: a >= b,
    "neq": lambda a, b: a != b,
}


def compare(f: Column, op: str, n: float) -> Column:
    """Numeric comparison; missing or not a number -> false."""
    return two_valued(_COMPARE[op](as_num(f), F.lit(float(n))))


def is_null(f: Column) -> Column:
    """Missing or empty."""
    return f.isNull() | two_valued(f.cast("string") == "")


def exists(f: Column, present: bool = True) -> Column:
    """Presence test."""
    return f.isNotNull() if present else f.isNull()


def field_eq_field(a: Column, b: Column) -> Column:
    """Two fields of one event are the same text; a missing side -> false."""
    return two_valued(a.cast("string") == b.cast("string"))


def any_of(leaves: list[Column]) -> Column:
    """Value list, OR."""
    return any_true(leaves)


def windash(value: str) -> list[str]:
    """A value with ``-`` also in its slash and typographic-dash spellings.

    Only a dash or slash that starts a word is an option marker.
    """
    # fixed values: the five option characters
    marks = ["-", "/", "–", "—", "―"]
    spots = [m.start() for m in re.finditer(r"\B[-/]\b", value)]
    out = []
    for chosen in itertools.product(marks, repeat=len(spots)):
        text = list(value)
        for at, mark in zip(spots, chosen):
            text[at] = mark
        out.append("".join(text))
    return out


def base64offset(value: str, encoding: str = "utf-8") -> list[str]:
    """The parts of base64 text that are constant for each of three alignments."""
    raw = value.encode(encoding)
    out = []
    for shift in range(3):
        text = base64.b64encode(b" " * shift + raw).decode()
        head = (0, 2, 3)[shift]  # characters touched by the padding before
        tail = (None, -3, -2)[(len(raw) + shift) % 3]  # characters touched by what follows
        out.append(text[head:tail])
    return out


def keyword(values: Column, pattern: str) -> Column:
    """Any value of the event's field map matches."""
    rx = wildcard_regex(split_wildcards(pattern), False)
    return two_valued(F.exists(F.map_values(values), lambda x: two_valued(x.rlike(rx))))


def and_(*leaves: Column) -> Column:
    """B15."""
    return all_true([two_valued(x) for x in leaves])


def or_(*leaves: Column) -> Column:
    """B15."""
    return any_true([two_valued(x) for x in leaves])


def not_(leaf: Column) -> Column:
    """Negation after the leaf became two-valued."""
    return ~two_valued(leaf)


def one_of(named: dict[str, Column], pattern: str) -> Column:
    """``1 of sel_*``."""
    return or_(*_named(named, pattern))


def all_of(named: dict[str, Column], pattern: str) -> Column:
    """``all of sel_*``."""
    return and_(*_named(named, pattern))


def _named(named: dict[str, Column], pattern: str) -> list[Column]:
    if pattern == "them":
        return [c for n, c in named.items() if not n.startswith("_")]
    rx = re.compile(re.escape(pattern).replace(r"\*", ".*") + r"\Z")
    return [c for n, c in named.items() if rx.match(n)]


# fixed values: usual places of signed modules
STANDARD_LOAD_PREFIXES = [
    "c:\\windows\\system32",
    "c:\\windows\\syswow64",
    "c:\\windows\\winsxs",
    "c:\\program files",
    "c:\\programdata",
]


def matches_unusual_load(signed: Column, status: Column, path: Column) -> Column:
    """Not signed with a valid signature, or loaded from an unusual place."""
    clean = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    p = clean(path)
    usual = any_true([p.startswith(x) for x in STANDARD_LOAD_PREFIXES])
    return (clean(signed) != "true") | (clean(status) != "valid") | ((p != "") & ~usual)
