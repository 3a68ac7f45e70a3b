"""Globs as regular expressions for rlike: they hold for whole strings, and "*" and "?" cross "/"."""

from __future__ import annotations

from tessera.model import Fatal


def glob_regex(glob: str) -> str:
    """`?`, `*`, `**`, `[a-z]`, `[!a]` and `{a,b}`; a backslash takes the next character as it is."""
    out, i, depth = [], 0, 0
    quoted = lambda c: c if c.isalnum() else f"\\x{{{ord(c):X}}}"
    while i < len(glob):
        c = glob[i]
        i += 1
        if c == "*":
            if glob[i : i + 1] == "*":
                i += 1
                if glob[i : i + 1] == "/" and (i == 2 or glob[i - 3] == "/"):
                    i += 1
                    out.append("(?:.*/)?")
                    continue
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[":
            negated = glob[i : i + 1] in ("!", "^")
            i += negated
            end = glob.find("]", i + 1)
            if end < 0:
                raise Fatal(f"glob {glob!r}: unclosed class")
            body, k = "", i
            while k < end:
                if k + 2 < end and glob[k + 1] == "-":
                    body += f"{quoted(glob[k])}-{quoted(glob[k + 2])}"
                    k += 3
                else:
                    body += quoted(glob[k])
                    k += 1
            out.append(f"[{'^' if negated else ''}{body}]")
            i = end + 1
        elif c == "{":
            depth += 1
            out.append("(?:")
        elif c == "}":
            if not depth:
                raise Fatal(f"glob {glob!r}: unopened alternates")
            depth -= 1
            out.append(")")
        elif c == "," and depth:
            out.append("|")
        elif c == "\\" and i < len(glob):
            out.append(quoted(glob[i]))
            i += 1
        else:
            out.append(quoted(c))
    if depth:
        raise Fatal(f"glob {glob!r}: unclosed alternates")
    return r"(?s)\A(?:" + "".join(out) + r")\z"


def glob_python(glob: str) -> str:
    """The same for Python's re."""
    import re

    return re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: f"\\U{int(m[1], 16):08X}", glob_regex(glob)).replace(r"\z", r"\Z")
