"""Filter files: the XML format of a common text-analysis tool, and native JSON."""

from __future__ import annotations

import json
import re
import xml.etree.ElementTree as ET
from dataclasses import asdict, dataclass, field, fields, replace
from xml.sax.saxutils import escape

from loglens.functions.text import color, flag
from loglens.plans.filters import Filter

#: The root element, the attributes of a filter in order, and the ends of extension attributes.
ROOT = "TextAnalysisTool.NET"
PLAIN = {"enabled": flag, "excluding": flag, "description": str, "foreColor": color, "backColor": color, "type": str, "case_sensitive": flag, "regex": flag, "text": str}
NAMES = {"foreColor": "fore", "backColor": "back", "type": "kind"}
EXTENSIONS = ("mode", "bold", "italic", "font_size", "group", "scope")
VERSION = 1
_ESCAPES = {'"': "&quot;", "\n": "&#10;", "\r": "&#13;", "\t": "&#9;"}
_EXTENSION = re.compile(rf"([A-Za-z]+)_({'|'.join(EXTENSIONS)})")


class ConfigError(ValueError):
    """A file that is no filter configuration."""


@dataclass
class Config:
    """Filters, and what their file says besides. prefix: that of extension attributes in XML."""

    filters: list[Filter] = field(default_factory=list)
    show_only_filtered: bool = False
    version: str = ""
    extra: list[tuple[str, str]] = field(default_factory=list)
    prefix: str = "loglens"


def _extended(f: Filter, name: str, value: str) -> Filter:
    value = value.strip()
    if name in ("bold", "italic"):
        return replace(f, **{name: flag(value)})
    if name == "font_size":
        return replace(f, font_size=int(value) if re.fullmatch(r"\+?[0-9]+", value) and int(value) < 1 << 16 else None)
    if name == "mode":
        return replace(f, mode="field" if value.lower() == "field" else "line")
    if name == "scope":
        return replace(f, scope="currentfile" if value.lower() in ("current", "file") else "allfiles")
    return replace(f, group=value)


def read_xml(data: bytes) -> Config:
    """Filters without ``enabled`` are off; attributes that aren't known are kept."""
    try:
        root = ET.fromstring(data.removeprefix(b"\xef\xbb\xbf"))
    except ET.ParseError as e:
        raise ConfigError(f"no XML: {e}") from None
    if root.tag != ROOT:
        raise ConfigError(f"the root element is not {ROOT}")
    out = Config()
    for k, v in root.attrib.items():
        if k == "version":
            out.version = v
        elif k == "showOnlyFilteredLines":
            out.show_only_filtered = flag(v)
        else:
            out.extra.append((k, v))
    for e in root.iter("filter"):
        f, extra = Filter(enabled=False), []
        for k, v in e.attrib.items():
            if k in PLAIN:
                f = replace(f, **{NAMES.get(k, k): PLAIN[k](v)})
            elif m := _EXTENSION.fullmatch(k):
                out.prefix = m[1]
                f = _extended(f, m[2], v)
            else:
                extra.append((k, v))
        out.filters.append(replace(f, extra=tuple(extra)))
    return out


def write_xml(config: Config) -> bytes:
    """The file with its byte order mark and CR LF; extension attributes only where they say something."""
    written = lambda pairs: "".join(f' {k}="{escape(v, _ESCAPES)}"' for k, v in pairs)
    yes = lambda x: "y" if x else "n"
    lines = ['<?xml version="1.0" encoding="utf-8" standalone="yes"?>', f"<{ROOT}{written([('version', config.version), ('showOnlyFilteredLines', str(config.show_only_filtered)), *config.extra])}>", "  <filters>"]
    for f in config.filters:
        pairs = [("enabled", yes(f.enabled)), ("excluding", yes(f.excluding)), ("description", f.description)]
        pairs += [(k, f"{v:06x}") for k, v in (("foreColor", f.fore), ("backColor", f.back)) if v is not None]
        pairs += [("type", f.kind), ("case_sensitive", yes(f.case_sensitive)), ("regex", yes(f.regex)), ("text", f.text), *f.extra]
        more = {"mode": "" if f.mode == "line" else f.mode, "bold": "y" * f.bold, "italic": "y" * f.italic, "font_size": "" if f.font_size is None else str(f.font_size), "group": f.group, "scope": "current" if f.scope == "currentfile" else ""}
        pairs += [(f"{config.prefix}_{k}", v) for k, v in more.items() if v]
        lines.append(f"    <filter{written(pairs)} />")
    lines += ["  </filters>", f"</{ROOT}>", ""]
    return b"\xef\xbb\xbf" + "\r\n".join(lines).encode()


def read_json(data: bytes | str) -> Config:
    """Native JSON; every field has a default, and version 0 is 1."""
    try:
        found = json.loads(data)
    except ValueError as e:
        raise ConfigError(f"no JSON: {e}") from None
    if not isinstance(found, dict):
        raise ConfigError("no JSON object")
    known = {f.name for f in fields(Filter)}
    filters = []
    for x in found.get("filters", []):
        given = {k: v for k, v in x.items() if k in known}
        given["extra"] = tuple(tuple(p) for p in given.get("extra", ()))
        filters.append(Filter(**given))
    return Config(filters, bool(found.get("show_only_filtered", False)), str(found.get("version") or VERSION))


def write_json(config: Config) -> str:
    filters = [asdict(f) | {"extra": [list(p) for p in f.extra]} for f in config.filters]
    version = int(config.version) if config.version.isdigit() else VERSION
    return json.dumps({"version": version, "show_only_filtered": config.show_only_filtered, "filters": filters}, indent=2, ensure_ascii=False)


def read(path: str) -> Config:
    with open(path, "rb") as f:
        data = f.read()
    return read_xml(data) if path.lower().endswith(".tat") else read_json(data)
