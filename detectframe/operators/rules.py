"""Rule engine: rule rows become Catalyst predicates, one pass over events.

A rule is a plain dict: ``id, title, level, status, tags, falsepositives,
logsource{category|service, product}, detection{<selection>..., condition}``;
a correlation rule has ``correlation{type, rules, group-by, timespan, condition}``.
"""

from __future__ import annotations

import ast
import ipaddress
import json
import math
import re
from collections import Counter
from dataclasses import dataclass, field
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from detectframe import fixed
from detectframe.functions import leaf as L
from detectframe.functions.scalar import as_num
from detectframe.operators.windows import running_counts, window_counts
from detectframe.scale import all_true, any_true, literal_table
from detectframe.schema import fld, opt

# --------------------------------------------------------------- detection -> tree
# A tree node is ("and", [nodes]) | ("or", [nodes]) | ("not", node)
#              | ("leaf", field or None, kind, value)


def value_nodes(name: str | None, mods: list[str], value) -> tuple:
    """Tree of one ``field|modifiers: value`` pair."""
    values = value if isinstance(value, list) else [value]
    known = {
        "contains", "startswith", "endswith", "all", "re", "i", "m", "s", "cidr", "windash",
        "base64", "base64offset", "wide", "utf16le", "cased", "fieldref", "exists", "expand",
        "lt", "lte", "gt", "gte", "neq",
    }
    unknown = set(mods) - known
    if unknown:
        raise ValueError(f"unsupported modifier: {sorted(unknown)}")
    nodes = [one_value(name, mods, v) for v in values]
    if len(nodes) == 1:
        return nodes[0]
    return ("and" if "all" in mods else "or", nodes)


def one_value(name, mods, v) -> tuple:
    if "exists" in mods:
        return ("leaf", name, "exists", bool(v))
    if v is None:
        return ("leaf", name, "null", None)
    if "fieldref" in mods:
        return ("leaf", name, "fieldref", str(v))
    if "re" in mods:
        flags = "".join(m for m in mods if m in "ims")
        L.to_java_regex(str(v), flags)  # reject now what the JVM cannot run
        return ("leaf", name, "re", (str(v), flags))
    if "cidr" in mods:
        return ("leaf", name, "cidr", str(v))
    for op in ("lte", "lt", "gte", "gt", "neq"):
        if op in mods:
            return ("leaf", name, op, float(v))
    if isinstance(v, bool):
        v = str(v).lower()
    if isinstance(v, (int, float)) and not set(mods) - {"all"}:
        return ("leaf", name, "num", float(v))
    texts = [str(v)]
    if "wide" in mods or "utf16le" in mods:
        encoding = "utf-16le"
    else:
        encoding = "utf-8"
    if "windash" in mods:
        texts = [x for t in texts for x in L.windash(t)]
    if "base64offset" in mods:
        texts = [x for t in texts for x in L.base64offset(t, encoding)]
    elif "base64" in mods:
        import base64

        texts = [base64.b64encode(t.encode(encoding)).decode() for t in texts]
    kind = "like_cs" if "cased" in mods else "like"
    before, after = "contains" in mods or "endswith" in mods, "contains" in mods or "startswith" in mods
    leaves = []
    for t in texts:
        parts = L.split_wildcards(t)
        if before and parts[:1] != [("*",)]:
            parts = [("*",)] + parts
        if after and parts[-1:] != [("*",)]:
            parts = parts + [("*",)]
        leaves.append(("leaf", name, kind, tuple(parts)))
    return leaves[0] if len(leaves) == 1 else ("or", leaves)


def selection_node(sel) -> tuple:
    """Tree of a selection: a map is AND, a list is OR, bare values are keywords."""
    if isinstance(sel, dict):
        parts = []
        for key, value in sel.items():
            name, *mods = key.split("|")
            parts.append(value_nodes(name or None, mods, value))
        return parts[0] if len(parts) == 1 else ("and", parts)
    if isinstance(sel, list):
        parts = [selection_node(x) if isinstance(x, dict) else one_value(None, [], x) for x in sel]
        return parts[0] if len(parts) == 1 else ("or", parts)
    return one_value(None, [], sel)


_QUANTIFIER = re.compile(r"\b(1|any|all)\s+of\s+(them|[A-Za-z0-9_]+\*?|\*)", re.IGNORECASE)


def condition_node(text: str, named: dict[str, tuple]) -> tuple:
    """Condition over selection names; the Boolean grammar is the one Python reads."""

    def quantifier(m: re.Match) -> str:
        names = _matching(m.group(2), named)
        if not names:
            raise ValueError(f"no selection matches {m.group(2)!r}")
        word = " and " if m.group(1).lower() == "all" else " or "
        return "(" + word.join(names) + ")"

    flat = _QUANTIFIER.sub(quantifier, text)
    flat = re.sub(r"\b(AND|OR|NOT)\b", lambda m: m.group(1).lower(), flat)
    return _from_ast(ast.parse(flat.strip(), mode="eval").body, named)


def _matching(pattern: str, named: dict) -> list[str]:
    if pattern.lower() == "them":
        return [n for n in named if not n.startswith("_")]
    rx = re.compile(re.escape(pattern).replace(r"\*", ".*") + r"\Z")
    return [n for n in named if rx.match(n)]


def _from_ast(node: ast.AST, named: dict[str, tuple]) -> tuple:
    if isinstance(node, ast.BoolOp):
        word = "and" if isinstance(node.op, ast.And) else "or"
        return (word, [_from_ast(v, named) for v in node.values])
    if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.Not):
        return ("not", _from_ast(node.operand, named))
    if isinstance(node, ast.Name) and node.id in named:
        return named[node.id]
    raise ValueError("condition uses something other than selections, and, or, not")


def rule_tree(rule: dict) -> tuple:
    """Tree of a whole rule; several conditions are alternatives."""
    detection = dict(rule["detection"])
    condition = detection.pop("condition")
    detection.pop("timeframe", None)
    named = {k: selection_node(v) for k, v in detection.items()}
    texts = condition if isinstance(condition, list) else [condition]
    nodes = [condition_node(t, named) for t in texts]
    return nodes[0] if len(nodes) == 1 else ("or", nodes)


# --------------------------------------------------------------- tree -> facts


def static_event_ids(node: tuple) -> set[int] | None:
    """C4: ids a rule can match at all; None = not known."""
    kind = node[0]
    if kind == "leaf":
        _, name, op, value = node
        return {int(value)} if name == "EventID" and op == "num" and value == int(value) else None
    if kind == "and":
        known = [s for s in map(static_event_ids, node[1]) if s is not None]
        return (set.intersection(*known) or None) if known else None
    if kind == "or":
        sets = [static_event_ids(n) for n in node[1]]
        return None if any(s is None for s in sets) else (set().union(*sets) or None)
    return None


def must_contain(node: tuple) -> set[tuple[str, str]]:
    """(field, literal) pairs every match must contain; literals of 4+ characters."""
    kind = node[0]
    if kind == "and":
        return set().union(*map(must_contain, node[1]))
    if kind == "or":
        sets = [must_contain(n) for n in node[1]]
        return set.intersection(*sets) if sets else set()
    if kind == "leaf" and node[1] and node[2] in ("like", "like_cs"):
        lits = [p for p in node[3] if isinstance(p, str)]
        longest = max(lits, key=len, default="")
        # only ASCII folds the same way in every comparison
        if len(longest) >= 4 and longest.isascii():
            return {(node[1], longest.lower())}
    return set()


def anchor_cover(node: tuple, cost=None) -> set[tuple[str, str]] | None:
    """(field, literal) pairs of which every match contains at least one; None = no such set is known.

    AND needs one part's cover only (the one whose shortest literal is longest), OR those of all its parts.  With a
    ``cost`` of covers the cheapest part is taken, and pairs may also be (field, (low, high)): a number in that range.
    """
    kind = node[0]
    if kind == "and":
        known = [c for c in (anchor_cover(n, cost) for n in (_flat(node) if cost else node[1])) if c]
        if cost:
            return min(known, key=cost, default=None)
        return max(known, key=lambda c: (min(len(t) for _, t in c), -len(c)), default=None)
    if kind == "or":
        covers = [anchor_cover(n, cost) for n in node[1]]
        return None if not covers or any(c is None for c in covers) else set().union(*covers)
    return (must_contain(node) | (_range(node) if cost else set()) or None) if kind == "leaf" else None


def _range(node: tuple) -> set[tuple[str, tuple[float, float]]]:
    """The (field, (low, high)) pair of a leaf that is one number or lies between two."""
    _, name, op, value = node
    low, high = (value, value) if op == "num" else value if op == "between" else (math.inf, -math.inf)
    return {(name, (low, high))} if name and math.isfinite(low) and math.isfinite(high) else set()


def _flat(node: tuple) -> list[tuple]:
    """Parts of an AND and of the ANDs in it; two bounds of one field also make a leaf ``between``."""
    parts = [x for n in node[1] for x in (_flat(n) if n[0] == "and" else [n])]
    low, high = {}, {}
    for _, name, op, value in (n for n in parts if n[0] == "leaf"):
        if op in ("gt", "gte"):
            low[name] = max(low.get(name, -math.inf), value if op == "gte" else math.nextafter(value, math.inf))
        elif op in ("lt", "lte"):
            high[name] = min(high.get(name, math.inf), value if op == "lte" else math.nextafter(value, -math.inf))
    return parts + [("leaf", name, "between", (low[name], high[name])) for name in low if name in high]


def anchors_of(node: tuple) -> set[tuple]:
    """Every pair a cover of the tree could take."""
    if node[0] in ("and", "or"):
        return set().union(*map(anchors_of, _flat(node) if node[0] == "and" else node[1]))
    return must_contain(node) | _range(node) if node[0] == "leaf" else set()


class FieldSource:
    """Columns of one event table; ``to_column`` reads them."""

    def __init__(self, df: DataFrame):
        self.df = df

    def raw(self, name: str) -> Column:
        return fld(self.df, name)

    def values(self) -> list[Column]:
        return [F.col(f"`{c}`") for c in value_columns(self.df)]


def value_columns(df: DataFrame) -> list[str]:
    """Promoted string fields a keyword is looked for in."""
    skip = {"run_id", "seq", "source", "provider_name", "event_id", "ts", "computer", "event_type", "data"}
    return [c for c, t in df.dtypes if c not in skip and t == "string" and not c.startswith("__")]


def to_column(node: tuple, src: FieldSource) -> Column:
    """Tree to a never-NULL predicate."""
    kind = node[0]
    if kind == "and":
        return all_true([to_column(n, src) for n in node[1]])
    if kind == "or":
        return any_true([to_column(n, src) for n in node[1]])
    if kind == "not":
        return ~to_column(node[1], src)
    _, name, op, value = node
    if name is None:
        rx = L.wildcard_regex(list(value), False) if op == "like" else None
        if rx is None:
            raise ValueError("only plain text can be a keyword")
        hits = [L.two_valued(c.rlike(rx)) for c in src.values()]
        if "data" in src.df.columns:
            hits.append(L.two_valued(F.exists(F.map_values(F.col("data")), lambda x: L.two_valued(x.rlike(rx)))))
        return any_true(hits)
    f = src.raw(name)
    if op == "like":
        return L.like_parts(f, list(value), False)
    if op == "like_cs":
        return L.like_parts(f, list(value), True)
    if op == "re":
        return L.regex(f, *value)
    if op == "cidr":
        return L.cidr(f, value)
    if op == "num":
        return L.num_eq(f, value)
    if op == "null":
        return L.is_null(f)
    if op == "exists":
        return L.exists(f, value)
    if op == "fieldref":
        return L.field_eq_field(f, src.raw(value))
    return L.compare(f, op, value)


def quoted(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


_COMPARE_SQL = {"num": "=", "lt": "<", "lte": "<=", "gt": ">", "gte": ">=", "neq": "<>"}


class FieldTexts:
    """What a rule set needs of an event's fields, each worked out once per row, and the SQL names of these columns.

    Kinds: ``t`` text, ``f`` case-folded text, ``o`` text without a line break, ``n`` number, ``b`` IPv4 bits,
    ``g`` IPv6 groups.
    """

    _MAKE = {
        "t": lambda f: f.cast("string"), "f": L.fold, "o": lambda f: ~f.cast("string").contains("\n"), "n": as_num,
        "b": L.ipv4_bits, "g": L.ipv6_groups,
    }

    def __init__(self, df: DataFrame):
        self.df, self.names = df, {}

    def __call__(self, kind: str, name: str) -> str:
        return self.names.setdefault((kind, name), f"__{kind}{len(self.names)}")

    def columns(self) -> list[Column]:
        return [self._MAKE[kind](fld(self.df, name)).alias(alias) for (kind, name), alias in self.names.items()]

    def keyword(self, rx: str) -> str:
        hits = [f"coalesce(`{c}` RLIKE {quoted(rx)}, false)" for c in value_columns(self.df)]
        if "data" in self.df.columns:
            hits.append(f"coalesce(exists(map_values(data), x -> coalesce(x RLIKE {quoted(rx)}, false)), false)")
        return "(" + " OR ".join(hits or ["false"]) + ")"


def to_sql(node: tuple, src: FieldTexts) -> str:
    """Tree to the text of a never-NULL predicate over the columns of ``src``; the JVM parses it in one call."""
    kind = node[0]
    if kind in ("and", "or"):
        return "(" + f" {kind.upper()} ".join(to_sql(n, src) for n in node[1]) + ")" if node[1] else ("true" if kind == "and" else "false")
    if kind == "not":
        return f"(NOT {to_sql(node[1], src)})"
    _, name, op, value = node
    if name is None:
        if op != "like":
            raise ValueError("only plain text can be a keyword")
        return src.keyword(L.wildcard_regex(list(value), False))
    if op in ("like", "like_cs"):
        shape, want = L.like_shape(list(value), op == "like_cs")
        if shape == "regex":
            return f"coalesce({src('t', name)} RLIKE {quoted(want)}, false)"
        subject = src("t" if op == "like_cs" else "f", name)
        if shape == "equals":
            return f"coalesce({subject} = {quoted(want)}, false)"
        return f"coalesce({shape}({subject}, {quoted(want)}) AND {src('o', name)}, false)"
    if op == "re":
        return f"coalesce({src('t', name)} RLIKE {quoted(L.to_java_regex(*value))}, false)"
    if op == "cidr":
        return cidr_sql(name, value, src)
    if op == "null":
        return f"coalesce({src('t', name)} = '', true)"
    if op == "exists":
        return f"({src('t', name)} IS {'NOT ' if value else ''}NULL)"
    if op == "fieldref":
        return f"coalesce({src('t', name)} = {src('t', value)}, false)"
    return f"coalesce({src('n', name)} {_COMPARE_SQL[op]} {float(value)!r}D, false)"


def cidr_sql(name: str, net: str, src: FieldTexts) -> str:
    n = ipaddress.ip_network(net, strict=False)
    if n.version == 4:
        shift = 32 - n.prefixlen
        return f"coalesce(shiftright({src('b', name)}, {shift}) = {int(n.network_address) >> shift}L, false)"
    groups, (whole, rest) = n.network_address.exploded, divmod(n.prefixlen, 16)
    addr = src("g", name)
    tests = [f"startswith({addr}, {quoted(groups[: whole * 5].rstrip(':'))})" if whole else f"{addr} IS NOT NULL"]
    if rest:
        want = int(groups.split(":")[whole], 16) >> (16 - rest)
        tests.append(f"shiftright(try_cast(conv(substring({addr}, {whole * 5 + 1}, 4), 16, 10) AS bigint), {16 - rest}) = {want}L")
    return f"coalesce({' AND '.join(tests)}, false)"


# --------------------------------------------------------------- rule sets


@dataclass
class Rule:
    rule_id: str
    meta: dict
    tree: tuple
    event_types: list[str]
    service: str | None
    event_ids: set[int] | None
    anchors: set[tuple[str, str]] = field(default_factory=set)


@dataclass
class RuleSet:
    rules: list[Rule]
    errors: list[tuple[str, str]]
    correlations: list[dict]
    skipped_correlations: int = 0


def level_rank(level: str | None) -> int:
    return fixed.LEVELS.index(level.lower()) if level and level.lower() in fixed.LEVELS else 0


def active_rules(rules: list[dict], min_level="medium", excluded=(), disabled=()) -> list[dict]:
    """Level floor, category/service and id exclusion; bases of correlations never fire alone."""
    bases = set(chain.from_iterable(r["correlation"].get("rules", []) for r in rules if "correlation" in r))
    floor = level_rank(min_level)
    out = []
    for r in rules:
        if "correlation" in r:
            continue
        src = r.get("logsource", {})
        if r.get("id") in bases or r.get("name") in bases:
            continue
        if r.get("level") is not None and level_rank(r["level"]) < floor:
            continue
        if r.get("id") in disabled:
            continue
        if src.get("category"):
            if src["category"] in excluded or src["category"] not in fixed.CATEGORY_EVENT_TYPES:
                continue
        elif not src.get("service") or src["service"] in excluded:
            continue
        out.append(r)
    return out


def compile_rules(rules: list[dict], min_level="medium", excluded=(), disabled=()) -> RuleSet:
    """Rule rows to trees; a bad rule is skipped and reported."""
    good, errors, correlations, skipped = [], [], [], 0
    for r in active_rules(rules, min_level, excluded, disabled):
        try:
            tree = rule_tree(r)
            category, service = r["logsource"].get("category"), r["logsource"].get("service")
            good.append(
                Rule(
                    r["id"], r, tree,
                    fixed.CATEGORY_EVENT_TYPES[category] if category else [],
                    None if category else service,
                    None if category else static_event_ids(tree),
                    must_contain(tree),
                )
            )
        except (ValueError, KeyError, SyntaxError, re.error) as exc:
            errors.append((str(r.get("id")), str(exc)))
    by_name = {k: r for r in rules for k in (r.get("id"), r.get("name")) if k and "detection" in r}
    for r in rules:
        if "correlation" not in r:
            continue
        c = r["correlation"]
        bases = [by_name[n] for n in c.get("rules", []) if n in by_name]
        if c.get("type") != "event_count" or not bases or not c.get("condition") or not c.get("timespan"):
            skipped += 1
            continue
        try:
            (op, count), = c["condition"].items()
            correlations.append(
                {"rule": r, "trees": [rule_tree(b) for b in bases], "op": op, "count": int(count),
                 "group_by": list(c.get("group-by") or []), "seconds": timespan_seconds(c["timespan"])}
            )
        except (ValueError, KeyError, SyntaxError, re.error) as exc:
            errors.append((str(r.get("id")), str(exc)))
    return RuleSet(good, errors, correlations, skipped)


def timespan_seconds(text: str) -> int:
    unit = {"s": 1, "m": 60, "h": 3600, "d": 86400}
    return int(text[:-1]) * unit[text[-1]]


def read_rules(paths: list[str]) -> tuple[list[dict], list[tuple[str, str]]]:
    """Rule documents from YAML files (driver-side configuration)."""
    import yaml

    rules, errors = [], []
    for path in paths:
        try:
            with open(path, encoding="utf-8") as fh:
                rules += [d for d in yaml.safe_load_all(fh) if isinstance(d, dict)]
        except (yaml.YAMLError, OSError) as exc:
            errors.append((path, str(exc)))
    return rules, errors


def dispatch(ruleset: RuleSet) -> dict[tuple, list[Rule]]:
    """Rules per bucket: ("type", event type), ("id", service, event id), ("service", service)."""
    out: dict[tuple, list[Rule]] = {}
    for r in ruleset.rules:
        if r.service is None:
            keys = [("type", t) for t in r.event_types]
        elif r.event_ids:
            keys = [("id", r.service, i) for i in sorted(r.event_ids)]
        else:
            keys = [("service", r.service)]
        for k in keys:
            out.setdefault(k, []).append(r)
    return out


_BUCKET = "map<string,struct<a:array<int>,t:array<array<struct<t:string,r:array<int>>>>,n:array<array<struct<lo:double,hi:double,r:array<int>>>>>>"


def anchor_index(ruleset: RuleSet, prefilter: bool = True) -> tuple[dict[str, dict], list[str], list[str]]:
    """Per bucket the literals and numbers and the rules each leads to, and the fields each kind is looked for in.

    ``a`` are places in the rule set of rules that are always met, ``t`` has per text field its literals ``t`` and per
    literal the places ``r`` of rules, ``n`` per number field its ranges ``lo`` to ``hi`` and theirs.  A rule is
    entered under the cover that the fewest rules of its bucket share, so that a row meets few rules besides those it
    matches, however many there are.
    """
    place = {id(r): i for i, r in enumerate(ruleset.rules)}
    fields: tuple[dict[str, int], dict[str, int]] = ({}, {})
    found = {}
    for key, rules in dispatch(ruleset).items():
        shared = Counter(a for r in rules for a in anchors_of(r.tree)) if prefilter else Counter()
        cost = lambda c: (sum(shared[a] for a in c), -min(len(t) if isinstance(t, str) else 9 for _, t in c), sorted(map(str, c)))  # noqa: B023, E731
        entries: dict[tuple, list[int]] = {}
        for r in rules:
            options = [c for c in ({max(r.anchors, key=lambda a: (-shared[a], len(a[1]), a))} if r.anchors else None, anchor_cover(r.tree, cost)) if c] if prefilter else []
            for at in sorted(min(options, key=cost), key=str) if options else [None]:
                entries.setdefault(at, []).append(place[id(r)])
                if at is not None:
                    kind = fields[not isinstance(at[1], str)]
                    kind.setdefault(at[0], len(kind))
        found["/".join(map(str, key))] = entries
    out = {}
    for key, entries in found.items():
        bucket = out[key] = {"a": entries.pop(None, []), "t": [[] for _ in fields[0]], "n": [[] for _ in fields[1]]}
        for (name, what), r in entries.items():
            if isinstance(what, str):
                bucket["t"][fields[0][name]].append({"t": what, "r": r})
            else:
                bucket["n"][fields[1][name]].append({"lo": what[0], "hi": what[1], "r": r})
    return out, list(fields[0]), list(fields[1])


def choose(texts: list[str], low: int, high: int) -> str:
    """Predicate of rule ``n`` out of ``texts[low:high]``, found by halving."""
    if high - low == 1:
        return texts[low]
    mid = (low + high) // 2
    return f"if(n < {mid}, {choose(texts, low, mid)}, {choose(texts, mid, high)})"


def apply_rules(events: DataFrame, ruleset: RuleSet, prefilter: bool = True, keep: list[str] | None = None) -> DataFrame:
    """One row per (event, matching rule).

    A single scan without a shuffle.  The row's bucket (event type, or source and id) has an index from literals and
    numbers to rules; only rules one of whose literals occurs in the row, or one of whose ranges holds its number, are
    candidates, and only a candidate's predicate is evaluated.  Rules are SQL text, parsed once, and the index is one
    literal, so building takes seconds for thousands of rules.  ``keep`` limits the event columns that are carried along.
    """
    cols = [F.col(f"`{c}`") for c in (keep or events.columns)]
    if not ruleset.rules:
        return events.where("false").select(*cols, F.lit(None).cast("string").alias("rule_id"))
    buckets = dispatch(ruleset)
    index, text_fields, number_fields = anchor_index(ruleset, prefilter)
    types = sorted({k[1] for k in buckets if k[0] == "type"})
    sources = sorted({k[1] for k in buckets if k[0] in ("id", "service")})
    wanted = events.filter(F.col("event_type").isin(types) | F.col("source").isin(sources))
    src = FieldTexts(events)
    texts = [to_sql(r.tree, src) for r in ruleset.rules]
    met = [f"filter(b.t[{i}], e -> contains({src('f', name)}, e.t))" for i, name in enumerate(text_fields)]
    met += [f"filter(b.n[{i}], e -> {src('n', name)} BETWEEN e.lo AND e.hi)" for i, name in enumerate(number_fields)]
    prepared = wanted.select("*", *src.columns())
    # literals where they are used: as columns they would be copied into every row
    folded = f"from_json({quoted(json.dumps(index))}, '{_BUCKET}')"
    ids = f"from_json({quoted(json.dumps([r.rule_id for r in ruleset.rules]))}, 'array<string>')"
    keys = ["concat('type/', event_type)", "concat('id/', source, '/', event_id)", "concat('service/', source)"]
    buckets_met = f"filter(transform(array({', '.join(keys)}), k -> {folded}[k]), b -> b IS NOT NULL)"
    places = ", ".join(["b.a", *(f"flatten(transform({m}, e -> e.r))" for m in met)])
    candidates = f"array_distinct(flatten(transform({buckets_met}, b -> concat({places}))))"
    # an expression inside a lambda is evaluated as it stands: thousands of predicates would not fit generated code
    fired_rules = f"transform(filter({candidates}, n -> {choose(texts, 0, len(texts))}), n -> {ids}[n])"
    # generated as one value first: the filter Spark derives from an explode would evaluate all of it again
    found = prepared.select(*cols, F.explode(F.array(F.expr(fired_rules))).alias("__hits"))
    return found.select(*cols, F.explode("__hits").alias("rule_id"))


def rule_table(spark, ruleset: RuleSet) -> DataFrame:
    """Metadata of the active rules, small enough to broadcast."""
    rows = [
        (r.rule_id, r.meta.get("title"), (r.meta.get("level") or "").lower() or None,
         (r.meta.get("status") or "").lower() or None, r.meta["logsource"].get("category"),
         r.service, r.meta["logsource"].get("product"), list(map(str, r.meta.get("tags", []))),
         list(map(str, r.meta.get("falsepositives", []))), None)
        for r in ruleset.rules
    ] + [
        (c["rule"]["id"], c["rule"].get("title"), (c["rule"].get("level") or "").lower() or None,
         (c["rule"].get("status") or "").lower() or None, None, None, None,
         list(map(str, c["rule"].get("tags", []))), [], "event_count")
        for c in ruleset.correlations
    ]
    return literal_table(
        spark, rows,
        "rule_id string, title string, level string, status string, category string, service string, "
        "product string, tags array<string>, falsepositives array<string>, correlation string",
    )


def build_alert(matches: DataFrame, rules: DataFrame) -> DataFrame:
    """Matches plus rule columns; the event's own columns stay as they are."""
    meta = rules.select("rule_id", "title", "level", "tags", "falsepositives", "category", "product")
    return (
        matches.join(meta, "rule_id", "left")
        .withColumn("family", F.lit("sigma"))
        .withColumn("event_source", opt(matches, "source"))
        .withColumn("source", F.lit("sigma"))
        .withColumn("rule_techniques", techniques_from_tags(F.col("tags")))
    )


def techniques_from_tags(tags: Column) -> Column:
    """Technique ids out of ``attack.t1059.001`` style tags."""
    return F.transform(
        F.filter(tags, lambda t: t.rlike(r"(?i)^attack\.t\d{4}(\.\d{3})?$")),
        lambda t: F.upper(F.regexp_extract(t, r"(?i)^attack\.(t\d{4}(\.\d{3})?)$", 1)),
    )


_OPS = {
    "gt": lambda a, b: a > b, "gte": lambda a, b: a >= b, "lt": lambda a, b: a < b,
    "lte": lambda a, b: a <= b, "eq": lambda a, b: a == b,
}


def event_count(events: DataFrame, trees: list[tuple] | Column, group_by: list[str], seconds: float, op: str, n: int) -> DataFrame:
    """Groups whose densest window of base matches meets the threshold.

    Base rules ignore their log source.  A group is (group-by values, process
    GUID); one row per firing group: ``group_<i>``, ``guid``, ``matched_events``,
    ``latest`` (time of the newest member).
    """
    if isinstance(trees, Column):
        hit = trees
    else:
        src = FieldSource(events)
        hit = any_true([to_column(t, src) for t in trees])
    keys = ["run_id"] + [f"group_{i}" for i in range(len(group_by))] + ["guid"]
    rows = events.filter(hit).select(
        "run_id", *[fld(events, g).alias(f"group_{i}") for i, g in enumerate(group_by)],
        fld(events, "ProcessGuid").alias("guid"), "ts",
    )
    best = window_counts(rows, keys, "ts", seconds).groupBy(*keys).agg(
        F.max("n").alias("matched_events"), F.max("ts").alias("latest")
    )
    return best.filter(_OPS[op](F.col("matched_events"), F.lit(n)))


def correlation_hits(events: DataFrame, ruleset: RuleSet) -> DataFrame:
    """C9 for every correlation of a rule set in one scan: ``corr, k, matched_events, latest_us``.

    ``corr`` is the correlation's place in the rule set, ``k`` the array of run, process GUID and group-by values.  A row is
    tested once for all base rules and goes on for each correlation it matches; spans may differ.
    """
    src = FieldTexts(events)
    parts = []
    for i, c in enumerate(ruleset.correlations):
        test = " OR ".join(to_sql(t, src) for t in c["trees"])
        group = ", ".join(["run_id", *[src("t", g) for g in ["ProcessGuid", *c["group_by"]]]])
        parts.append(f"if({test}, named_struct('corr', {i}, 'width', {int(round(c['seconds'] * 1_000_000))}L, 'k', array({group})), NULL)")
    # inside a lambda, so that many base rules need not fit generated code
    hits = F.expr(f"filter(transform(array(true), y -> array({', '.join(parts)}))[0], x -> x IS NOT NULL)")
    rows = events.select("run_id", "ts", *src.columns()).select(F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.explode(F.array(hits)).alias("xs"))
    points = rows.select("us", F.explode("xs").alias("x")).select("us", "x.*")
    keys = ["corr", "k"]
    # rows without a time are in no window; their groups have the count 0
    best = running_counts(points.filter("us IS NOT NULL"), keys).groupBy(*keys).agg(F.max("n").alias("matched_events"), F.max("us").alias("latest_us"))
    bare = points.filter("us IS NULL").select(*keys).distinct().select(*keys, F.lit(0).cast("bigint").alias("matched_events"), F.lit(None).cast("bigint").alias("latest_us"))
    best = best.unionByName(bare).groupBy(*keys).agg(F.max("matched_events").alias("matched_events"), F.max("latest_us").alias("latest_us"))
    met = any_true([(F.col("corr") == i) & _OPS[c["op"]](F.col("matched_events"), F.lit(c["count"])) for i, c in enumerate(ruleset.correlations)])
    return best.filter(met)


def correlation_alerts(events: DataFrame, ruleset: RuleSet) -> DataFrame | None:
    """C9 for every correlation of a rule set, as alert rows."""
    if not ruleset.correlations:
        return None
    facts = [(i, c["rule"]["id"], int(c["seconds"]), c["group_by"]) for i, c in enumerate(ruleset.correlations)]
    known = literal_table(events.sparkSession, facts, "corr int, rule_id string, timespan_seconds bigint, names array<string>")
    x = correlation_hits(events, ruleset).join(known, "corr")
    values = F.slice("k", 3, F.size("k"))
    out = x.select(
        F.col("k")[0].alias("run_id"), F.timestamp_micros("latest_us").alias("ts"), "rule_id", F.lit("SigmaCorrelation").alias("event_type"), "matched_events", "timespan_seconds",
        values.alias("group_values"), F.col("k")[1].alias("ProcessGuid"), F.col("k"), F.col("names"))
    # the process id is an alert's own field, so that scope can use it
    pid = F.when(F.array_contains("names", "ProcessId"), F.get("group_values", F.array_position("names", "ProcessId").cast("int") - 1))
    return out.withColumn("ProcessId", pid).drop("k", "names")


def rule_catalog(rules: DataFrame, others: DataFrame | None = None) -> DataFrame:
    """Catalog rows of all families."""
    mine = rules.select(
        "rule_id", F.lit("sigma").alias("family"), "title", "level", "status", "category", "service", "tags"
    )
    return mine if others is None else mine.unionByName(others, allowMissingColumns=True)


def catalog_counts(catalog: DataFrame) -> DataFrame:
    """Rules per family."""
    return catalog.groupBy("family").agg(F.count("*").alias("n_rules"))


def rule_usage(alerts: DataFrame, catalog: DataFrame) -> DataFrame:
    """C11: hits per rule and whether it ever fired; alerts are counted before the join."""
    hits = alerts.groupBy("rule_id").agg(F.count("*").alias("hits"))
    return catalog.join(hits, "rule_id", "left").select(
        "rule_id", F.coalesce("hits", F.lit(0)).alias("hits"), F.col("hits").isNull().alias("never_fired")
    )
