"""Regex building blocks that make Java regexes behave like Python's ``re``.

Spark evaluates regexes with ``java.util.regex``. Python's ``re`` (what texts
are usually cleaned with) differs on Unicode: ``\\w``/``\\s``/``\\b`` are ASCII
in Java unless ``(?U)`` is on, ``(?U)`` makes U+200D a word char for ``\\b``,
and ``\\s`` never matches U+001C..U+001F. The classes below restate Python's
definitions explicitly so every pattern gives the same matches on both sides.
"""

from __future__ import annotations

import re

# Character classes equal to Python's Unicode ``\s`` and ``\w``.
WS_CLASS_BODY = r"\s\x{1c}-\x{1f}"
WS = r"[\s\x{1c}-\x{1f}]"
NOT_WS = r"[^\s\x{1c}-\x{1f}]"
# The characters of WS one by one: for patterns without flags and for trimming.
WS_CHARS = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
WORD_CLASS_BODY = r"\p{L}\p{N}_"
WORD = r"[\p{L}\p{N}_]"
NOT_WORD = r"[^\p{L}\p{N}_]"
BOUNDARY = r"(?:(?<=[\p{L}\p{N}_])(?![\p{L}\p{N}_])|(?<![\p{L}\p{N}_])(?=[\p{L}\p{N}_]))"
NOT_BOUNDARY = r"(?:(?<=[\p{L}\p{N}_])(?=[\p{L}\p{N}_])|(?<![\p{L}\p{N}_])(?![\p{L}\p{N}_]))"
# Python's str.splitlines() breaks on these (Java's \R lacks U+001C..U+001E).
LINE_BREAK = r"(?:\r\n|[\n\x{0b}\x{0c}\r\x{1c}\x{1d}\x{1e}\x{85}\x{2028}\x{2029}])"

# Flags: (?U) gives Unicode \p classes and case folding; we never rely on the
# bare \w/\s/\b after translation, so (?U) only matters for case folding.
IGNORE_CASE = "(?iU)"
UNICODE = "(?U)"


def escape_literal(term: str) -> str:
    """Escape a literal for a Java regex (ASCII punctuation only; escaping a
    letter is an error in Java)."""
    out = []
    for ch in term:
        if ch.isascii() and not ch.isalnum() and ch != "_":
            out.append("\\" + ch)
        else:
            out.append(ch)
    return "".join(out)


def quote_replacement(s: str) -> str:
    """Make a literal safe as a Java ``Matcher`` replacement string."""
    return s.replace("\\", "\\\\").replace("$", "\\$")


def python_repl_to_java(s: str) -> str:
    """Translate a Python ``re.sub`` replacement (``\\1``, ``\\g<1>``) to Java
    (``$1``); everything else literal."""
    out, i = [], 0
    while i < len(s):
        ch = s[i]
        if ch == "\\" and i + 1 < len(s):
            nxt = s[i + 1]
            if nxt.isdigit():
                out.append("$" + nxt)
                i += 2
                continue
            if nxt == "g" and s[i + 2:i + 3] == "<":
                end = s.index(">", i)
                out.append("${" + s[i + 3:end] + "}" if not s[i + 3:end].isdigit() else "$" + s[i + 3:end])
                i = end + 1
                continue
            out.append(quote_replacement({"n": "\n", "t": "\t", "\\": "\\"}.get(nxt, nxt)))
            i += 2
            continue
        out.append(quote_replacement(ch))
        i += 1
    return "".join(out)


_OUTSIDE = {
    "w": WORD, "W": NOT_WORD, "s": WS, "S": NOT_WS, "b": BOUNDARY, "B": NOT_BOUNDARY,
    "d": r"\p{Nd}", "D": r"\P{Nd}",
}
_INSIDE = {"w": WORD_CLASS_BODY, "s": WS_CLASS_BODY, "d": r"\p{Nd}"}


_ESCAPE_END = re.compile(r"\\(?:x[0-9A-Fa-f]{2}|u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|\d{1,3}|.)\Z", re.S)


def _edge(p: str, i: int) -> str:
    """The ``\\b`` at ``p[i]``: beside a literal word character one look-around tells."""
    after, then, before = p[i + 2:i + 3], p[i + 3:i + 4], p[i - 1:i] if i else ""
    if after.isascii() and after.isalnum() and (not then or then not in "?*{"):
        return f"(?={after})(?<!{WORD})"
    if before.isascii() and before.isalnum() and not _ESCAPE_END.search(p[:i]):
        return f"(?!{WORD})"
    return BOUNDARY


#: A pattern that begins with a greedy run of word characters.
_LEADING_RUN = re.compile(r"\(?\\w[*+](?![*+?{])")


def python_regex_to_java(p: str) -> str:
    """Rewrite the Unicode-sensitive escapes of a Python pattern into explicit
    Java classes. Handles escapes inside and outside character classes;
    everything else is shared syntax between the two dialects.

    A pattern that begins with a run of word characters matches inside a word
    only what it matches from the word's beginning, or from where the match
    before has ended: it is tried there alone."""
    out, i, in_class = [], 0, False
    if _LEADING_RUN.match(p) and not re.search(r"\||\\[1-9]|\(\?", p):
        out.append(rf"(?:(?<!{WORD})|\G)")
    while i < len(p):
        ch = p[i]
        if ch == "\\" and i + 1 < len(p):
            nxt = p[i + 1]
            if in_class and nxt in _INSIDE:
                out.append(_INSIDE[nxt])
            elif in_class and nxt in ("W", "S", "D"):
                raise ValueError(f"negated class escape \\{nxt} inside [...] is not supported: {p!r}")
            elif not in_class and nxt == "b":
                out.append(_edge(p, i))
            elif not in_class and nxt in _OUTSIDE:
                out.append(_OUTSIDE[nxt])
            else:
                out.append(ch + nxt)
            i += 2
            continue
        if ch == "[" and not in_class:
            in_class = True
            out.append(ch)
            # a leading ']' or '^]' is literal in both dialects
            if p[i + 1:i + 2] == "^":
                out.append("^")
                i += 1
            if p[i + 1:i + 2] == "]":
                out.append(r"\]")
                i += 1
            i += 1
            continue
        if ch == "[" and in_class:
            out.append(r"\[")  # Python treats a nested '[' literally
            i += 1
            continue
        if ch == "]" and in_class:
            in_class = False
        out.append(ch)
        i += 1
    return "".join(out)
