"""Glob and regex pattern translation, done once on the driver; matching then runs as native ``rlike``.

Two glob dialects are in use:
  * path globs (exclude patterns): ``*`` and ``?`` also cross ``/``, ``**`` only as a whole path
    component, ``[!a]`` negates, case-sensitive;
  * content globs (``kind="glob"``): whole-text match, ``*``, ``?``, ``[a-z]``, ``[^a]`` negates,
    a set escapes a special character (``[*]``), case-sensitive.
"""

from __future__ import annotations

import re


class PatternError(ValueError):
    pass


def _class_to_regex(body: str, negate: bool) -> str:
    out = []
    i = 0
    while i < len(body):
        ch = body[i]
        if i + 2 < len(body) and body[i + 1] == "-":
            lo, hi = ch, body[i + 2]
            out.append(_esc_class(lo) + "-" + _esc_class(hi))
            i += 3
            continue
        out.append(_esc_class(ch))
        i += 1
    return "[" + ("^" if negate else "") + "".join(out) + "]"


def _esc_class(ch: str) -> str:
    return "\\" + ch if ch in "\\^-[]&" else ch


def _parse_class(p: str, i: int, neg_chars: str) -> tuple[str, int]:
    """Parse a set starting after ``[``; returns (regex, index after ``]``). A first ``]`` is literal."""
    negate = False
    if i < len(p) and p[i] in neg_chars:
        negate = True
        i += 1
    start = i
    if i < len(p) and p[i] == "]":
        i += 1
    while i < len(p) and p[i] != "]":
        i += 1
    if i >= len(p):
        raise PatternError("unclosed character set")
    return _class_to_regex(p[start:i], negate), i + 1


def _lit(ch: str) -> str:
    return re.escape(ch) if ch not in "/" else ch


def path_glob_to_regex(pattern: str) -> str:
    """Path glob -> anchored Java regex."""
    out = []
    i = 0
    p = pattern
    while i < len(p):
        ch = p[i]
        if ch == "*":
            j = i
            while j < len(p) and p[j] == "*":
                j += 1
            run = j - i
            if run > 2:
                raise PatternError("more than two consecutive '*'")
            if run == 2:
                at_start = i == 0 or p[i - 1] == "/"
                at_end = j == len(p) or p[j] == "/"
                if not (at_start and at_end):
                    raise PatternError("'**' must form a whole path component")
                if j < len(p):  # '**/' : zero or more directories
                    out.append("(?:.*/)?")
                    j += 1
                else:
                    out.append(".*")
            else:
                out.append(".*")
            i = j
        elif ch == "?":
            out.append(".")
            i += 1
        elif ch == "[":
            rx, i = _parse_class(p, i + 1, "!")
            out.append(rx)
        else:
            out.append(_lit(ch))
            i += 1
    return "(?s)\\A" + "".join(out) + "\\z"


def content_glob_to_regex(pattern: str) -> str:
    """Whole-text content glob -> Java regex for ``rlike`` (find semantics, so anchors are explicit).

    Leading/trailing ``*`` drop the anchor instead of becoming ``.*``, which keeps the search linear.
    """
    body = pattern
    lead = len(body) - len(body.lstrip("*"))
    body = body[lead:]
    trail = len(body) - len(body.rstrip("*"))
    body = body[: len(body) - trail] if trail else body
    out = []
    i = 0
    while i < len(body):
        ch = body[i]
        if ch == "*":
            while i < len(body) and body[i] == "*":
                i += 1
            out.append(".*?")
        elif ch == "?":
            out.append(".")
            i += 1
        elif ch == "[":
            rx, i = _parse_class(body, i + 1, "^")
            out.append(rx)
        else:
            out.append(re.escape(ch))
            i += 1
    if not body and (lead or trail):
        return "(?s)\\A"  # only stars: everything matches
    return "(?s)" + ("" if lead else "\\A") + "".join(out) + ("" if trail else "\\z")


def content_glob_literals(pattern: str) -> list[str]:
    """Literal runs that every text matching a content glob must hold."""
    runs, run, i = [], "", 0
    while i < len(pattern):
        ch = pattern[i]
        if ch in "*?[":
            runs.append(run)
            run = ""
            i = _parse_class(pattern, i + 1, "^")[1] if ch == "[" else i + 1
        else:
            run += ch
            i += 1
    return [r for r in [*runs, run] if r]


def content_glob_for_duckdb(pattern: str) -> str:
    """The same content glob in DuckDB's GLOB dialect (negation is ``[!x]``)."""
    return re.sub(r"\[\^", "[!", pattern)


# POSIX class names of the reference's regex dialect and their members.
POSIX_CLASSES = {
    "alnum": "a-zA-Z0-9", "alpha": "a-zA-Z", "ascii": r"\x00-\x7F", "blank": r"\t ", "cntrl": r"\x00-\x1F\x7F", "digit": "0-9",
    "graph": "!-~", "lower": "a-z", "print": " -~", "punct": r"!-/:-@\[-`{-~", "space": r"\t\n\x0B\f\r ", "upper": "A-Z",
    "word": "0-9A-Za-z_", "xdigit": "0-9A-Fa-f",
}
_GROUP_HEAD = re.compile(r"\(\?(?:P?<(?P<name>[A-Za-z_][A-Za-z0-9_.\[\]]*)>|(?P<on>[a-zA-Z]*)(?:-(?P<off>[a-zA-Z]+))?(?P<end>[:)]))")
_CODE_POINT = re.compile(r"\\(?:x\{([0-9A-Fa-f]{1,8})\}|u\{([0-9A-Fa-f]{1,8})\}|x([0-9A-Fa-f]{2})|u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8}))")
_PLAIN_ESCAPES = set("dDwWsSbBAzntrfva")


def _escape_token(pattern: str, i: int, in_class: bool) -> tuple[str, int]:
    """One escape starting at the backslash ``i``: (Java form, index after it)."""
    if m := _CODE_POINT.match(pattern, i):
        point = int(next(g for g in m.groups() if g), 16)
        if point > 0x10FFFF:
            raise PatternError("code point out of range")
        return f"\\x{{{point:x}}}", m.end()
    if i + 1 >= len(pattern):
        raise PatternError("pattern ends in a backslash")
    ch = pattern[i + 1]
    if ch in "pP":
        m = re.compile(r"\\([pP])(?:\{(\^?)([A-Za-z_0-9=: -]+)\}|([A-Za-z]))").match(pattern, i)
        if not m:
            raise PatternError("malformed \\p class")
        name = (m[3] or m[4]).replace(" ", "")
        short = len(name) <= 2 or name.startswith("Is")
        negated = (m[1] == "P") != bool(m[2])
        return ("\\P" if negated else "\\p") + "{" + (name if short else "Is" + name) + "}", m.end()
    if ch == "v":
        return "\\x0B", i + 2
    if ch in _PLAIN_ESCAPES:
        if in_class and ch in "bBAz":
            raise PatternError(f"\\{ch} is not allowed in a class")
        return "\\" + ch, i + 2
    if ch.isascii() and ch.isalnum():
        raise PatternError(f"\\{ch} is not supported (no back-references, no look-around)")
    return "\\" + ch if ch.isascii() else ch, i + 2


def _class_token(pattern: str, i: int, verbose: bool = False) -> tuple[str, int]:
    """A bracketed class starting at ``i``: (Java form, index after it). Sets nest, ``&&`` intersects."""
    out, i = ["["], i + 1
    if pattern[i:i + 1] == "^":
        out.append("^")
        i += 1
    if pattern[i:i + 1] == "]":
        out.append("\\]")
        i += 1
    while i < len(pattern):
        ch = pattern[i]
        if ch == "]":
            return "".join(out) + "]", i + 1
        if m := re.compile(r"\[:(\^?)([a-z]+):\]").match(pattern, i):
            if m[2] not in POSIX_CLASSES:
                raise PatternError(f"unknown class [:{m[2]}:]")
            out.append("[" + m[1] + POSIX_CLASSES[m[2]] + "]")
            i = m.end()
        elif ch == "[":
            piece, i = _class_token(pattern, i, verbose)
            out.append(piece)
        elif verbose and (ch.isspace() or ch == "#"):
            i = _skipped(pattern, i)
        elif ch == "\\":
            piece, i = _escape_token(pattern, i, True)
            out.append(piece)
        elif pattern.startswith("&&", i):
            out.append("&&")
            i += 2
        elif pattern[i:i + 2] in ("--", "~~"):
            raise PatternError("set difference is not supported")
        else:
            out.append("\\" + ch if ch in "&~#" or ch.isspace() and ch.isascii() else ch)
            i += 1
    raise PatternError("unclosed character class")


def _skipped(pattern: str, i: int) -> int:
    """Index after the white-space character or the comment at ``i`` (verbose mode)."""
    if pattern[i] != "#":
        return i + 1
    end = pattern.find("\n", i)
    return len(pattern) if end < 0 else end + 1


_REPEAT = re.compile(r"(?:[*+?]|\{[0-9]+(?:,[0-9]*)?\})\??")


def regex_for_java(pattern: str) -> str:
    """Reference regex dialect -> Java regex with the same meaning, token by token.

    Unicode classes (``(?U)``), ``.`` excludes only ``\n`` (``(?d)``); ``$`` is the very end, or the end
    of a line while the ``m`` flag is on; POSIX classes, ``(?P<name>..)``, code-point escapes, repeated
    repetitions (``a**``) and verbose mode are translated. What the dialect does not have (look-around,
    back-references, a repetition of nothing, ``{,n}``) and what has no equal in Java (flags ``R`` and
    ``U``, set difference) is refused here, on the driver.
    """
    out, i, names = [], 0, 0
    multi, verbose = [False], [False]  # flags by open group
    opened: list[int] = []  # where open groups start in ``out``
    atom, repeated = -1, False  # where the last atom starts in ``out``; whether it has a repetition

    def add(piece: str) -> None:
        nonlocal atom, repeated
        atom, repeated = len(out), False
        out.append(piece)

    def plain(piece: str) -> None:
        """Something that cannot be repeated."""
        nonlocal atom
        atom = -1
        out.append(piece)

    def enter(piece: str, m: bool, x: bool) -> None:
        opened.append(len(out))
        multi.append(m)
        verbose.append(x)
        plain(piece)

    while i < len(pattern):
        ch = pattern[i]
        if verbose[-1] and (ch.isspace() or ch == "#"):
            i = _skipped(pattern, i)
        elif ch == "\\":
            piece, i = _escape_token(pattern, i, False)
            add(piece)
        elif ch == "[":
            piece, i = _class_token(pattern, i, verbose[-1])
            add(piece)
        elif ch == "(":
            if not pattern.startswith("(?", i):
                enter("(", multi[-1], verbose[-1])
                i += 1
                continue
            m = _GROUP_HEAD.match(pattern, i)
            if not m:
                raise PatternError("look-around and other special groups are not supported")
            if m["name"]:
                names += 1
                enter(f"(?<g{names}>", multi[-1], verbose[-1])  # names only label groups; Java's alphabet is smaller
            else:
                on, off = m["on"] or "", m["off"] or ""
                if set(on + off) - set("imsux") or "u" in off:
                    raise PatternError(f"flags {on}{off} are not supported")
                lines = ("m" in on or multi[-1]) and "m" not in off
                spaced = ("x" in on or verbose[-1]) and "x" not in off
                # u (Unicode) is always on, verbose mode is undone here
                on, off = (f.replace("u", "").replace("x", "") for f in (on, off))
                flags = on + ("-" + off if off else "")
                if m["end"] == ")":
                    plain(f"(?{flags})" if flags else "")
                    multi[-1], verbose[-1] = lines, spaced
                else:
                    enter(f"(?{flags}:", lines, spaced)
            i = m.end()
        elif ch == ")":
            if not opened:
                raise PatternError("unopened group")
            multi.pop()
            verbose.pop()
            out.append(")")
            atom, repeated = opened.pop(), False
            i += 1
        elif ch in "*+?{":
            m = _REPEAT.match(pattern, i)
            if not m:
                raise PatternError("malformed repetition")
            if atom < 0:
                raise PatternError("nothing to repeat")
            if repeated and ch == "+":
                raise PatternError("a possessive repetition is not supported")
            if repeated:  # a repetition of a repetition
                out[atom:] = ["(?:" + "".join(out[atom:]) + ")"]
            out.append(m[0])
            repeated = True
            i = m.end()
        elif ch == "|":
            plain("|")
            i += 1
        elif ch == "$":
            add("(?:(?=\\n|\\z))" if multi[-1] else "(?:\\z)")
            i += 1
        elif ch == "^":
            add("(?:(?<=\\A|\\n))" if multi[-1] else "(?:\\A)")
            i += 1
        else:
            add("\\" + ch if ch in "}]" else ch)
            i += 1
    if opened:
        raise PatternError("unclosed group")
    return "(?U)(?d)" + "".join(out)
