"""Rules that decide which paths are traced, and predicates on names."""

from __future__ import annotations

import re
import tomllib
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

VERSION = 1
#: Kinds of scopes, which are matched alike, and of values, which are parsed and warned of only.
SCOPES = ("pkg", "file", "obj")
VALUES = ("local", "global", "arg", "ret", "attr")


def glob_regex(pattern: str) -> str:
    """An anchored regular expression for a glob.

    `*` and `?` stay within one path segment, `**` crosses them, `**/` may also match nothing,
    and a bracketed class is kept, with a leading `!` as its negation.
    """

    def piece(m: re.Match) -> str:
        text = m[0]
        fixed = {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(text)
        if fixed is not None:
            return fixed
        if len(text) > 1:
            return "[^" + text[2:] if text[1] == "!" else text
        return re.escape(text)

    return "^" + re.sub(r"\*\*/|\*\*|\*|\?|\[[!^]?\]?[^\]]*\]|.", piece, pattern, flags=re.S) + "$"


@dataclass(frozen=True)
class Selector:
    kind: str
    match: str
    pattern: str

    def matches(self, path: Column) -> Column:
        if self.match == "literal":
            return path == self.pattern
        # A regex rule is anchored at its start only.
        return path.rlike(glob_regex(self.pattern) if self.match == "glob" else f"^(?:{self.pattern})")


def parse_selector(raw: str) -> Selector:
    """`kind:[glob|regex|literal:]pattern`; other colons belong to the pattern."""
    kind, colon, rest = raw.partition(":")
    if not colon or kind not in SCOPES + VALUES:
        raise ValueError(f"no selector kind: {raw!r}")
    match, second, pattern = rest.partition(":")
    if not second or match not in ("glob", "regex", "literal"):
        match, pattern = "glob", rest
    if not pattern:
        raise ValueError(f"empty selector pattern: {raw!r}")
    if match == "regex":
        re.compile(pattern)
    return Selector(kind, match, pattern)


@dataclass(frozen=True)
class Rule:
    selector: Selector
    execute: str
    reason: str = ""


@dataclass(frozen=True)
class Classifier:
    """Rules in order over all files; the last that matches a path decides, else the default."""

    rules: tuple[Rule, ...]
    default: str = "trace"
    warnings: tuple[str, ...] = ()

    @property
    def rule_count(self) -> int:
        return len(self.rules)

    def classify(self, path: Column) -> Column:
        """The decision as one CASE from the last rule to the first: no join and no shuffle."""
        out = None
        for rule in reversed(self.rules):
            cond, value = rule.selector.matches(path), F.lit(rule.execute)
            out = F.when(cond, value) if out is None else out.when(cond, value)
        return F.lit(self.default) if out is None else out.otherwise(F.lit(self.default))


def compile_filters(*sources: str) -> Classifier:
    """From the texts of filter files in order; a later default replaces an earlier one. Value rules are only warned of."""
    rules: list[Rule] = []
    warnings: list[str] = []
    default = "trace"
    for text in sources:
        data = tomllib.loads(text)
        if data.get("meta", {}).get("version") != VERSION:
            raise ValueError(f"filter version {data.get('meta', {}).get('version')!r}, not {VERSION}")
        scope = data.get("scope", {})
        default = scope.get("default_exec", default)
        for rule in scope.get("rules", []):
            if any(k.startswith("value_") for k in rule):
                warnings.append(f"value rules of {rule['selector']!r} are not applied")
            if rule.get("exec") not in (None, "trace", "skip"):
                raise ValueError(f"unknown exec {rule['exec']!r}")
            selector = parse_selector(rule["selector"])
            if selector.kind in VALUES:
                warnings.append(f"{rule['selector']!r} selects values and is skipped")
                continue
            rules.append(Rule(selector, rule.get("exec", "trace"), rule.get("reason", "")))
    return Classifier(tuple(rules), default, tuple(warnings))


def is_printable(text: Column) -> Column:
    return text.rlike(r"^[\x20-\x7E\t\n\r]*$")


def is_uuid7(text: Column) -> Column:
    return text.rlike("^[0-9a-f]{8}-[0-9a-f]{4}-7[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$")


def is_permanent(name: Column) -> Column:
    """Offsets, indices, metadata and namespaces stay in a cache."""
    return name.endswith(".off") | name.endswith(".idx") | (name == "meta.dat") | name.endswith(".tc") | name.endswith(".ns")


def is_evictable(name: Column) -> Column:
    return ~is_permanent(name)


def normalize_path(path: Column, workdir: str = "", strip: bool = True) -> Column:
    """<workdir>/ or <tmp>/ in place of the working directory or of a folder below /tmp; unchanged unless strip."""
    if not strip:
        return path
    out = F.when(path.rlike("^/tmp/[^/]*/"), F.regexp_replace(path, "^/tmp/[^/]*/", "<tmp>/")).otherwise(path)
    if workdir:
        rest = F.regexp_replace(F.substring(path, len(workdir) + 1, 1 << 30), "^/", "")
        out = F.when(path.startswith(workdir), F.concat(F.lit("<workdir>/"), rest)).otherwise(out)
    return out
