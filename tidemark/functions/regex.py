"""One regex dialect for the rule catalogue.

Catalogue patterns are written with ECMAScript meaning: ``\\w`` and ``\\b`` are
ASCII, ``\\s`` covers the Unicode spaces and ``$`` is the very end of the text.
Java disagrees on ``\\b``, ``\\s`` and ``$``; Python on ``\\s`` and ``$``.
"""

from __future__ import annotations

import re

_SPACES = r"\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"
_ASCII_BOUNDARY = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"


_WORD = "[A-Za-z0-9_]"


def _word_atom(text: str) -> bool:
    """Does this piece of pattern begin with something that can only be a word character?"""
    return bool(re.match(r"[A-Za-z0-9_]|\\[wd]|\[[A-Za-z0-9_-]+\]", text))


def _opens_with_word(rest: str) -> bool:
    """True when whatever follows must start with a word character (flat groups included)."""
    group = re.match(r"\((?:\?:)?([^()\[\]]*)\)(?![?*{])", rest)
    if group:
        return all(_word_atom(part) for part in group.group(1).split("|"))
    atom = re.match(r"(?:[A-Za-z0-9_]|\\[wd]|\[[A-Za-z0-9_-]+\])([?*{]?)", rest)
    return bool(atom) and atom.group(1) not in ("?", "*")


def _closes_with_word(before: str) -> bool:
    """True when whatever precedes must end with a word character."""
    group = re.search(r"(?<!\\)\((?:\?:)?([^()\[\]]*)\)\Z", before)
    if group:
        return all(re.search(r"(?<!\\)[A-Za-z0-9_]\Z|\\[wd]\+?\Z", part) for part in group.group(1).split("|"))
    if re.search(r"\\[A-Za-z]\Z", before):
        return bool(re.search(r"\\[wd]\Z", before))
    return bool(re.search(r"[A-Za-z0-9_]\Z|\\[wd](?:\+|\{[1-9][0-9,]*\})\Z|\[[A-Za-z0-9_-]+\](?:\+|\{[1-9][0-9,]*\})?\Z", before))


def _boundary(before: str, rest: str) -> str:
    """The cheapest ASCII form of a word boundary at this place."""
    if _opens_with_word(rest):
        return f"(?<!{_WORD})"
    if _closes_with_word(before):
        return f"(?!{_WORD})"
    return _ASCII_BOUNDARY


def _translate(pattern: str, end: str, ascii_boundary: bool) -> str:
    out: list[str] = []
    in_class = False
    i = 0
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\" and i + 1 < len(pattern):
            nxt = pattern[i + 1]
            if nxt == "s":
                out.append(_SPACES if in_class else f"[{_SPACES}]")
            elif nxt == "S" and not in_class:
                out.append(f"[^{_SPACES}]")
            elif nxt == "b" and not in_class and ascii_boundary:
                out.append(_boundary(pattern[:i], pattern[i + 2 :]))
            else:
                out.append(pattern[i : i + 2])
            i += 2
            continue
        if ch == "[" and not in_class:
            in_class = True
            out.append(ch)
            if pattern[i + 1 : i + 2] == "^":
                out.append("^")
                i += 1
        elif ch == "[" and in_class:
            out.append("\\[")  # Java would open a nested class
        elif ch == "]" and in_class:
            in_class = False
            out.append(ch)
        elif ch == "&" and in_class and pattern[i + 1 : i + 2] == "&":
            out.append("\\&")  # Java reads && as an intersection
        elif ch == "$" and not in_class and end:
            out.append(end)
        else:
            out.append(ch)
        i += 1
    return "".join(out)


def java(pattern: str, flags: str = "") -> str:
    """Pattern text for ``rlike`` / ``regexp_*``. Flags: i, m, s."""
    body = _translate(pattern, "" if "m" in flags else r"\z", True)
    return (f"(?{flags})" if flags else "") + body


def python(pattern: str, flags: str = "") -> re.Pattern:
    """Compiled pattern with the same meaning, for the per-file helpers."""
    value = re.ASCII
    value |= re.IGNORECASE if "i" in flags else 0
    value |= re.MULTILINE if "m" in flags else 0
    value |= re.DOTALL if "s" in flags else 0
    return re.compile(_translate(pattern, "" if "m" in flags else r"\Z", False), value)
