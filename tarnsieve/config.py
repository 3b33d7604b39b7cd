"""Configuration: a small part of YAML, strict fields, and the algebra that selects rules."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, field
from typing import Any

from tarnsieve.functions.paths import PatternError, validate
from tarnsieve.rules.base import CATALOGUE, PILLARS, SEVERITIES, Options

FILE = ".tarnsieve.yaml"
SCHEMA_ID = "tarnsieve.config.v1"
_GATES = {"analyse": "advisory", "summary": "advisory", "report": "none", "dashboard": "none"}


#: Lists that may stand at the top instead of in a section.
_FLAT = ("select", "excludeRules", "ignorePaths", "acceptedAbbreviations")


class ConfigError(ValueError):
    """A configuration that can't be used."""


def _scalar(text: str) -> Any:
    text = text.strip()
    if text[:1] in ("'", '"') and text[-1:] == text[:1] and len(text) > 1:
        return text[1:-1]
    if text.startswith("[") and text.endswith("]"):
        return [_scalar(x) for x in re.findall(r"\"[^\"]*\"|'[^']*'|[^,]+", text[1:-1]) if x.strip()]
    if text == "{}":
        return {}
    if text in ("true", "false"):
        return text == "true"
    if text in ("null", "~", ""):
        return None
    return float(text) if re.fullmatch(r"-?\d+(?:\.\d+)?", text) else text


def _uncommented(line: str) -> str:
    quote = ""
    for i, c in enumerate(line):
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c == "#" and (not i or line[i - 1].isspace()):
            return line[:i]
    return line


def parse_yaml(text: str) -> dict:
    """Maps, lists of scalars by dash or in brackets, quoted and plain scalars, comments. Anything else is an error."""
    rows = []
    for number, line in enumerate(text.split("\n"), 1):
        bare = _uncommented(line).rstrip()
        if bare.strip() and bare.strip() != "---":
            if "\t" in bare[: len(bare) - len(bare.lstrip())]:
                raise ConfigError(f"line {number}: tabs indent nothing here")
            rows.append((len(bare) - len(bare.lstrip()), bare.strip(), number))

    def block(i: int, indent: int) -> tuple[Any, int]:
        if rows[i][1].startswith("- ") or rows[i][1] == "-":
            out: Any = []
            while i < len(rows) and rows[i][0] == indent and rows[i][1].startswith("-"):
                out.append(_scalar(rows[i][1][1:]))
                i += 1
            return out, i
        out = {}
        while i < len(rows) and rows[i][0] == indent:
            m = re.match(r"""("[^"]*"|'[^']*'|[^\s:\[\]{}-][^:]*):(?:\s+(.*))?$""", rows[i][1])
            if not m:
                raise ConfigError(f"line {rows[i][2]}: expected a key and a colon")
            key = str(_scalar(m[1]))
            if key in out:
                raise ConfigError(f"line {rows[i][2]}: {key} is there twice")
            i += 1
            if m[2]:
                out[key] = _scalar(m[2])
            elif i < len(rows) and (rows[i][0] > indent or (rows[i][0] == indent and rows[i][1].startswith("-"))):
                out[key], i = block(i, rows[i][0])
            else:
                out[key] = None
        if i < len(rows) and rows[i][0] > indent:
            raise ConfigError(f"line {rows[i][2]}: unexpected indent")
        return out, i

    if not rows:
        return {}
    out, end = block(0, rows[0][0])
    if end < len(rows) or not isinstance(out, dict):
        raise ConfigError(f"line {rows[min(end, len(rows) - 1)][2]}: the document isn't one map")
    return out


def _only(where: str, found: dict | None, known: set[str]) -> dict:
    if found is None:
        return {}
    if not isinstance(found, dict):
        raise ConfigError(f"{where} must be a map")
    if more := set(found) - known:
        raise ConfigError(f"{where}: unknown {', '.join(sorted(more))}")
    return found


def _strings(where: str, x: Any) -> list[str]:
    if x is None:
        return []
    if not isinstance(x, list) or not all(isinstance(v, str) for v in x):
        raise ConfigError(f"{where} must be a list of strings")
    return list(dict.fromkeys(x))


def alias(rule: str) -> str:
    """A rule's id from one of its other spellings: documentation for docs, and hyphens for dots."""
    if rule in CATALOGUE:
        return rule
    docs = re.sub(r"^documentation[.-]", "docs.", rule)
    return docs if docs in CATALOGUE else next((r for r in CATALOGUE if r.replace(".", "-") == rule), rule)


@dataclass
class Config:
    ignore: list[str] = field(default_factory=list)
    enabled: dict[str, bool] = field(default_factory=dict)
    thresholds: dict[str, dict[str, float]] = field(default_factory=dict)
    severities: dict[str, str] = field(default_factory=dict)
    settings: dict[str, dict[str, Any]] = field(default_factory=dict)
    abbreviations: list[str] = field(default_factory=list)
    secret_previews: list[str] = field(default_factory=list)
    gates: dict[str, str] = field(default_factory=dict)
    #: The least Go version that the configuration is for; told, not enforced.
    go_version: str | None = None
    select: list[str] | None = None
    pillars: list[str] | None = None
    exclude_rules: list[str] = field(default_factory=list)
    exclude_pillars: list[str] = field(default_factory=list)

    def active(self) -> set[str]:
        """Selected rules and pillars (or all), then each rule's own switch, then exclusions; the last word wins."""
        out = {r for r in CATALOGUE if r in (self.select or ()) or CATALOGUE[r].pillar in (self.pillars or ())} if self.select or self.pillars else set(CATALOGUE)
        for r, on in self.enabled.items():
            out = out | {r} if on else out - {r}
        return {r for r in out if r not in self.exclude_rules and CATALOGUE[r].pillar not in self.exclude_pillars}

    def options(self, rule: str) -> Options:
        return Options(CATALOGUE[rule], self.thresholds.get(rule, {}), self.settings.get(rule, {}), tuple(self.abbreviations))

    def fail_on(self, command: str = "analyse") -> str:
        return self.gates.get(command, _GATES.get(command, "advisory"))


def from_dict(data: dict) -> Config:
    """Fails on whatever isn't known: fields, rules, thresholds, options, pillars, severities, commands."""
    data = _only("the configuration", data, {"schemaVersion", "paths", "rules", "allowlists", "selection", "minimumSeverity", *_FLAT, "sensitiveData", "minimumGoVersion"})
    if data.get("schemaVersion") not in (None, SCHEMA_ID):
        raise ConfigError(f"the schema is {data['schemaVersion']!r}, not {SCHEMA_ID!r}")
    c = Config()
    paths = _only("paths", data.get("paths"), {"ignore"})
    lists = _only("allowlists", data.get("allowlists"), {"acceptedAbbreviations", "secretPreviews"})
    secret = _only("sensitiveData", data.get("sensitiveData"), {"previewAllowlist"})
    selection = _only("selection", data.get("selection"), {"tiers", "rules", "pillars", "excludeRules", "excludePillars"})
    _strings("selection.tiers", selection.get("tiers"))  # names kept for later, without effect
    c.go_version = data.get("minimumGoVersion")
    if c.go_version is not None:
        c.go_version = f"{c.go_version:g}" if isinstance(c.go_version, float) else c.go_version
        if not isinstance(c.go_version, str) or not re.fullmatch(r"\d+(?:\.\d+){0,2}", c.go_version):
            raise ConfigError("minimumGoVersion must be a version")

    def merged(flat: str, where: str, inner: dict, key: str) -> list[str]:
        """A list that may be given at the top, in its section, or in parts in both."""
        top = secret.get("previewAllowlist") if flat == "previewAllowlist" else data.get(flat)
        return sorted({*_strings(flat, top), *_strings(f"{where}.{key}", inner.get(key))})

    c.ignore = merged("ignorePaths", "paths", paths, "ignore")
    c.abbreviations = merged("acceptedAbbreviations", "allowlists", lists, "acceptedAbbreviations")
    c.secret_previews = merged("previewAllowlist", "allowlists", lists, "secretPreviews")
    c.select = [alias(r) for r in merged("select", "selection", selection, "rules")]
    c.exclude_rules = [alias(r) for r in merged("excludeRules", "selection", selection, "excludeRules")]
    c.pillars, c.exclude_pillars = (_strings(f"selection.{k}", selection.get(k)) for k in ("pillars", "excludePillars"))
    for r in (*c.select, *c.exclude_rules):
        if r not in CATALOGUE:
            raise ConfigError(f"selection: no such rule: {r}")
    for p in (*c.pillars, *c.exclude_pillars):
        if p not in PILLARS:
            raise ConfigError(f"selection: no such pillar: {p}")
    for p in (*c.ignore, *c.secret_previews):
        try:
            validate(p)
        except PatternError as e:
            raise ConfigError(str(e)) from e
    gates = data.get("minimumSeverity")
    if isinstance(gates, str):
        gates = dict.fromkeys(_GATES, gates)
    for command, least in _only("minimumSeverity", gates, set(_GATES)).items():
        if least not in (*SEVERITIES, "none"):
            raise ConfigError(f"minimumSeverity.{command}: no such severity: {least}")
        c.gates[command] = least
    for name, body in _only("rules", data.get("rules"), set(data.get("rules") or ())).items():
        rule = CATALOGUE.get(alias(name))
        if rule is None:
            raise ConfigError(f"rules: no such rule: {name}")
        where = f"rules.{rule.id}"
        body = _only(where, body, {"enabled", "threshold", "thresholds", "severity", "options"})
        if body.get("enabled") is not None:
            if not isinstance(body["enabled"], bool):
                raise ConfigError(f"{where}.enabled must be true or false")
            c.enabled[rule.id] = body["enabled"]
        limits = dict(_only(f"{where}.thresholds", body.get("thresholds"), set(rule.thresholds)))
        if body.get("threshold") is not None:
            if len(rule.thresholds) != 1:
                raise ConfigError(f"{where}.threshold: the rule has {len(rule.thresholds)} thresholds")
            limits[next(iter(rule.thresholds))] = body["threshold"]
        for k, v in limits.items():
            if isinstance(v, bool) or not isinstance(v, (int, float)) or v <= 0:
                raise ConfigError(f"{where}: {k} must be above 0")
        c.thresholds[rule.id] = limits
        if body.get("severity") is not None:
            if body["severity"] not in SEVERITIES:
                raise ConfigError(f"{where}.severity: no such severity: {body['severity']}")
            c.severities[rule.id] = body["severity"]
        c.settings[rule.id] = dict(_only(f"{where}.options", body.get("options"), set(rule.options)))
    return c


def load(path: str) -> Config:
    if not path.endswith(".yaml"):
        raise ConfigError("a configuration is a .yaml file")
    with open(path, encoding="utf-8") as f:
        return from_dict(parse_yaml(f.read()))


def load_auto(root: str, path: str | None = None, none: bool = False) -> Config:
    """The named file, or FILE below root if it is there; none switches both off."""
    if none:
        return Config()
    if path:
        return load(os.path.join(root, path))
    there = os.path.join(root, FILE)
    return load(there) if os.path.exists(there) else Config()


def render(config: Config) -> str:
    """A configuration file with every rule, its defaults or what is configured."""
    show = lambda v: "true" if v is True else "false" if v is False else "[" + ", ".join(f'"{x}"' for x in v) + "]" if isinstance(v, list) else "{}" if v == {} else f'"{v}"' if isinstance(v, str) else f"{v:g}"
    out = [f"schemaVersion: {SCHEMA_ID}", "paths:", f"  ignore: {show(config.ignore)}", "rules:"]
    active = config.active()
    for r in sorted(CATALOGUE.values(), key=lambda r: r.id):
        o = config.options(r.id)
        out += [f"  {r.id}:  # {r.title}", f"    enabled: {show(r.id in active)}", f"    severity: {config.severities.get(r.id, r.severity)}"]
        if r.thresholds:
            out += ["    thresholds:", *(f"      {k}: {o.thresholds.get(k, v):g}" for k, v in r.thresholds.items())]
        if plain := {k: o.options.get(k, v) for k, v in r.options.items() if not isinstance(v, dict)}:
            out += ["    options:", *(f"      {k}: {show(v)}" for k, v in plain.items())]
    return "\n".join([*out, ""])
