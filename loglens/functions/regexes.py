"""Patterns of a linear-time regex dialect as Java patterns.

The dialect has no look-around and no back-references, names groups ``(?P<name>``, matches Unicode classes, and its
``$`` is the very end; ``.`` leaves out the line feed alone.
"""

from __future__ import annotations

import re


class PatternError(ValueError):
    """A pattern that the dialect does not have."""


def translated(pattern: str, ignore_case: bool = True) -> tuple[str, list[str | None]]:
    """The Java pattern, and the name (or None) of each capturing group in order."""
    out, names, i, in_class, multiline = [], [], 0, 0, bool(re.match(r"\(\?[a-zA-Z]*m", pattern))
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            if i + 1 == len(pattern):
                raise PatternError("a pattern ends in a backslash")
            n = pattern[i + 1]
            if n in "123456789" or n in "kGRXQEZ":
                raise PatternError(f"\\{n} is not supported")
            out.append("\\z" if n == "z" else c + n)
            i += 2
            continue
        if in_class:
            if c == "[" and not pattern.startswith("[:", i):
                in_class += 1
            elif c == "]":
                in_class -= 1
            if c == "[" and pattern.startswith("[:", i) and (end := pattern.find(":]", i)) > 0:
                name = pattern[i + 2 : end]
                kind = {"alpha": "Alpha", "digit": "Digit", "alnum": "Alnum", "upper": "Upper", "lower": "Lower", "space": "Space", "punct": "Punct", "xdigit": "XDigit"}.get(name.lstrip("^"))
                if not kind:
                    raise PatternError(f"unknown class {name}")
                out.append(("\\P" if name.startswith("^") else "\\p") + "{" + kind + "}")
                i = end + 2
                continue
            out.append("\\&" if c == "&" and pattern[i + 1 : i + 2] != "&" else c)
        elif c == "[":
            in_class = 1
            out.append(c)
            if pattern[i + 1 : i + 2] == "^":
                out.append("^")
                i += 1
            if pattern[i + 1 : i + 2] == "]":
                out.append("\\]")
                i += 1
        elif c == "$" and not multiline:
            out.append("\\z")
        elif c == "(" and pattern[i + 1 : i + 2] == "?":
            named = re.match(r"\(\?P?<([A-Za-z_][\w.\[\]]*)>", pattern[i:])
            if named:
                names.append(named[1])
                out.append("(")
                i += len(named[0])
                continue
            if re.match(r"\(\?(?:[=!>]|<[=!])", pattern[i:]):
                raise PatternError("look-around is not supported")
            flags = re.match(r"\(\?([a-zA-Z-]*)([:)])", pattern[i:])
            if not flags or set(flags[1]) - set("imsUux-"):
                raise PatternError("unknown group")
            out.append(f"(?{flags[1].replace('u', '').replace('U', '')}{flags[2]}")
            i += len(flags[0])
            continue
        else:
            if c == "(":
                names.append(None)
            if c == "+" and i and pattern[i - 1] in "*+?}" and (i < 2 or pattern[i - 2] != "\\"):
                raise PatternError("possessive quantifiers are not supported")
            out.append(c)
        i += 1
    if in_class:
        raise PatternError("a character class is not closed")
    body = "".join(out)
    try:
        re.compile(re.sub(r"\\[pP]\{[^}]*\}|\\[pP].", "a", body).replace("\\z", "\\Z").replace("(?-", "(?:(?#"))
    except re.error as e:
        if "flags" not in str(e):
            raise PatternError(str(e)) from None
    return f"(?d{'i' if ignore_case else ''}Uu)" + body, names


def java(pattern: str, ignore_case: bool = True) -> str:
    return translated(pattern, ignore_case)[0]
