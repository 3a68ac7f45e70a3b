"""Patterns in the dialect of linear-time regex engines, translated for java.util.regex and for Python's regex module.

The dialect: Unicode classes, "." without "\\n" only, "$" at the very end only, no look-around or
back-references. Groups don't capture, as only whole matches count. What can't be translated is rejected.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import SparkSession

from tessera.functions import linear
from tessera.model import Fatal

_META = set(r"\.+*?()|[]{}^$#&-~/ " + "\"'!%,:;<=>@`_")
#: Names of general categories.
_CATEGORIES = {
    "letter": "L", "casedletter": "LC", "lowercaseletter": "Ll", "uppercaseletter": "Lu", "titlecaseletter": "Lt", "modifierletter": "Lm", "otherletter": "Lo", "mark": "M", "nonspacingmark": "Mn", "spacingmark": "Mc", "enclosingmark": "Me",
    "number": "N", "decimalnumber": "Nd", "digit": "Nd", "letternumber": "Nl", "othernumber": "No", "punctuation": "P", "punct": "P", "connectorpunctuation": "Pc", "dashpunctuation": "Pd", "openpunctuation": "Ps", "closepunctuation": "Pe",
    "initialpunctuation": "Pi", "finalpunctuation": "Pf", "otherpunctuation": "Po", "symbol": "S", "mathsymbol": "Sm", "currencysymbol": "Sc", "modifiersymbol": "Sk", "othersymbol": "So", "separator": "Z", "spaceseparator": "Zs",
    "lineseparator": "Zl", "paragraphseparator": "Zp", "other": "C", "control": "Cc", "format": "Cf", "surrogate": "Cs", "privateuse": "Co", "unassigned": "Cn",
}
_SHORT = {v.lower(): v for v in _CATEGORIES.values()}
_BINARY = {"alphabetic": "Alphabetic", "alpha": "Alphabetic", "lowercase": "Lowercase", "lower": "Lowercase", "uppercase": "Uppercase", "upper": "Uppercase", "whitespace": "White_Space", "space": "White_Space", "ideographic": "Ideographic", "emoji": "Emoji"}
#: ASCII classes in brackets.
_POSIX = {
    "alnum": "0-9A-Za-z", "alpha": "A-Za-z", "ascii": r"\x{0}-\x{7F}", "blank": r"\x{9}\x{20}", "cntrl": r"\x{0}-\x{1F}\x{7F}", "digit": "0-9", "graph": r"\x{21}-\x{7E}", "lower": "a-z", "print": r"\x{20}-\x{7E}",
    "punct": r"\x{21}-\x{2F}\x{3A}-\x{40}\x{5B}-\x{60}\x{7B}-\x{7E}", "space": r"\x{9}-\x{D}\x{20}", "upper": "A-Z", "word": "0-9A-Za-z_", "xdigit": "0-9A-Fa-f",
}
_WORD_EDGES = {"start": r"(?:(?<!\w)(?=\w))", "end": r"(?:(?<=\w)(?!\w))", "start-half": r"(?<!\w)", "end-half": r"(?!\w)"}


def _code(c: str) -> str:
    return f"\\x{{{ord(c):X}}}"


def _literal(c: str) -> str:
    return c if c.isalnum() and c.isascii() else _code(c)


class _Translator:
    def __init__(self, pattern: str):
        self.p, self.i = pattern, 0

    def fail(self, why: str) -> Fatal:
        return Fatal(f"pattern {self.p!r} at {self.i}: {why}")

    def more(self) -> bool:
        return self.i < len(self.p)

    def take(self) -> str:
        if not self.more():
            raise self.fail("unexpected end")
        c = self.p[self.i]
        self.i += 1
        return c

    def peek(self, s: str) -> bool:
        return self.p.startswith(s, self.i)

    def eat(self, s: str) -> bool:
        if self.peek(s):
            self.i += len(s)
            return True
        return False

    def until(self, end: str) -> str:
        at = self.p.find(end, self.i)
        if at < 0:
            raise self.fail(f"no {end!r}")
        out = self.p[self.i : at]
        self.i = at + len(end)
        return out

    # groups and sequences

    def whole(self) -> str:
        out = self.sequence({"i": False, "m": False, "s": False, "x": False, "U": False})
        if self.more():
            raise self.fail("unopened group")
        return out

    def sequence(self, flags: dict[str, bool]) -> str:
        """Up to the group's end; flags set inside hold to its end."""
        flags, out, atom, quantified = dict(flags), [], None, False
        while self.more() and not self.peek(")"):
            c = self.take()
            if flags["x"] and (c.isspace() or c == "#"):
                if c == "#":
                    while self.more() and self.take() != "\n":
                        pass
                continue
            if c == "|":
                out.append("|")
                atom = None
                continue
            if c in "*+?{":
                if atom is None:
                    raise self.fail("nothing to repeat")
                body = "".join(out[atom:])
                del out[atom:]
                if quantified:
                    body = f"(?:{body})"
                lazy = self.quantifier(c)
                out.append(body + lazy[0] + ("?" if lazy[1] != flags["U"] else ""))
                atom, quantified = len(out) - 1, True
                continue
            start, quantified = len(out), False
            if c == "(":
                made = self.group(flags)
                if made is None:
                    continue
                out.append(made)
            elif c == "[":
                out.append(self.bracket(flags))
            elif c == "\\":
                out.append(self.escape(False))
            elif c == ".":
                out.append(".")
            elif c == "^":
                out.append(r"(?:^|(?<=\n))" if flags["m"] else "^")
            elif c == "$":
                out.append(r"(?=\n|\z)" if flags["m"] else r"\z")
            else:
                out.append(_literal(c))
            atom = start
        return "".join(out)

    def quantifier(self, c: str) -> tuple[str, bool]:
        if c == "{":
            parts = self.until("}").split(",")
            numbers = [x.strip() for x in parts]
            if len(parts) > 2 or not numbers[0].isdigit() or (len(parts) == 2 and numbers[1] and not numbers[1].isdigit()):
                raise self.fail("bad repetition")
            if len(parts) == 2 and numbers[1] and int(numbers[1]) < int(numbers[0]):
                raise self.fail("bad repetition range")
            c = "{" + ",".join(numbers) + "}"
        return c, self.eat("?")

    def group(self, flags: dict[str, bool]) -> str | None:
        prefix = "(?:"
        if self.eat("?"):
            if self.peek("P<") or (self.peek("<") and not self.peek("<=") and not self.peek("<!")):
                self.eat("P")
                self.eat("<")
                if not self.until(">").strip():
                    raise self.fail("empty group name")
            elif any(self.peek(x) for x in ("=", "!", "<=", "<!", ">", "|", "P", "#", "'", "&", "R", "(")):
                raise self.fail("look-around and other extended groups aren't part of the dialect")
            else:
                new, on, sent = dict(flags), True, {True: "", False: ""}
                while True:
                    c = self.take()
                    if c in ":)":
                        break
                    if c == "-" and on:
                        on = False
                    elif c in "imsxU":
                        new[c] = on
                        if c in "is":
                            sent[on] += "iu" if c == "i" else "s"
                    elif c == "u" and on:
                        pass
                    else:
                        raise self.fail(f"flag {c!r} isn't supported")
                java = sent[True] + ("-" + sent[False] if sent[False] else "")
                if c == ")":
                    flags.update(new)
                    if not java:
                        return None
                    return f"(?{java})"
                prefix, flags = f"(?{java}:", new
        body = self.sequence(flags)
        if not self.eat(")"):
            raise self.fail("unclosed group")
        return prefix + body + ")"

    # escapes

    def escape(self, inside: bool) -> str:
        c = self.take()
        if c in "dDwWsS":
            return "\\" + c
        if c in "pP":
            return self.property(c == "P")
        if c in "xuU":
            return self.number(c)
        if c in "aftnrv":
            return {"a": r"\x{7}", "f": r"\x{C}", "t": r"\x{9}", "n": r"\x{A}", "r": r"\x{D}", "v": r"\x{B}"}[c]
        if not inside:
            if c in "bB":
                if c == "b" and self.eat("{"):
                    kind = self.until("}")
                    if kind not in _WORD_EDGES:
                        raise self.fail(f"unknown boundary {kind!r}")
                    return _WORD_EDGES[kind]
                return "\\" + c
            if c in "Az":
                return "\\" + c
            if c in "<>":
                return _WORD_EDGES["start" if c == "<" else "end"]
        if c in _META:
            return _literal(c)
        raise self.fail(f"escape \\{c} isn't part of the dialect")

    def number(self, c: str) -> str:
        digits = self.until("}") if self.eat("{") else "".join(self.take() for _ in range({"x": 2, "u": 4, "U": 8}[c]))
        try:
            return _code(chr(int(digits, 16)))
        except (ValueError, OverflowError):
            raise self.fail("bad character number") from None

    def property(self, negated: bool) -> str:
        name = self.until("}") if self.eat("{") else self.take()
        if name.startswith("^"):
            negated, name = not negated, name[1:]
        for sign in ("!=", "=", ":"):
            if sign in name:
                kind, _, name = name.partition(sign)
                negated ^= sign == "!="
                kind = kind.strip().lower().replace("_", "")
                if kind not in ("sc", "script", "gc", "generalcategory"):
                    raise self.fail(f"property {kind!r} isn't supported")
                break
        plain = name.strip().lower().replace("_", "").replace(" ", "").replace("-", "")
        if plain in ("any", "assigned", "ascii"):
            body = {"any": r"[\x{0}-\x{10FFFF}]", "ascii": r"[\x{0}-\x{7F}]", "assigned": r"\P{Cn}"}[plain]
            return f"[^{body[1:-1]}]" if negated and body[0] == "[" else r"\p{Cn}" if negated else body
        letter = "P" if negated else "p"
        if plain in _SHORT or plain in _CATEGORIES:
            return f"\\{letter}{{{_SHORT.get(plain) or _CATEGORIES[plain]}}}"
        if plain in _BINARY:
            return f"\\{letter}{{Is{_BINARY[plain]}}}"
        if not plain.isalnum():
            raise self.fail("bad property name")
        return f"\\{letter}{{Is{plain}}}"

    # bracket classes

    def bracket(self, flags: dict[str, bool]) -> str:
        negated = self.eat("^")
        left = self.items(flags, True)
        while not self.eat("]"):
            op = self.p[self.i : self.i + 2]
            self.i += 2
            right = self.items(flags, False)
            if op == "&&":
                left = f"[{left}]&&[{right}]"
            elif op == "--":
                left = f"[{left}]&&[^{right}]"
            else:
                left = f"[[{left}]&&[^{right}]][[{right}]&&[^{left}]]"
        return f"[^{left}]" if negated else f"[{left}]"

    def items(self, flags: dict[str, bool], first: bool) -> str:
        out = []
        while True:
            if not self.more():
                raise self.fail("unclosed bracket")
            if self.peek("]") and not first:
                break
            if any(self.peek(x) for x in ("&&", "--", "~~")) and not (first and self.peek("--")):
                break
            first = False
            if self.peek("[:"):
                at = self.p.find(":]", self.i)
                name = self.p[self.i + 2 : at] if at > 0 else ""
                if name.lstrip("^") in _POSIX:
                    self.i = at + 2
                    out.append(f"[{'^' if name[0] == '^' else ''}{_POSIX[name.lstrip('^')]}]")
                    continue
            if self.eat("["):
                out.append(self.bracket(flags))
                continue
            if flags["x"] and self.p[self.i].isspace():
                self.i += 1
                continue
            low = self.one()
            if low is not None and self.peek("-") and not self.peek("-]") and not self.peek("--"):
                self.i += 1
                high = self.one()
                if high is None or high < low:
                    raise self.fail("bad range")
                out.append(f"{_literal(low)}-{_literal(high)}")
            else:
                out.append(_literal(low) if low is not None else self.set_)
        return "".join(out)

    def one(self) -> str | None:
        """A character; None if it was an escape for a set, which is in set_."""
        c = self.take()
        if c != "\\":
            return c
        made = self.escape(True)
        if made.startswith("\\x{"):
            return chr(int(made[3:-1], 16))
        if len(made) == 1:
            return made
        self.set_ = made
        return None


#: Texts on which a pattern that can match nothing shows it: edges of words, lines and texts.
_PROBES = ("", "a", " a ", "\n", "a\nb", "-a-")


def _finds_empty(compiled, text: str) -> bool:
    m = compiled.matcher(text)
    while m.find():
        if m.start() == m.end():
            return True
    return False


def escaped(literal: str) -> str:
    """A pattern of the dialect that matches the literal."""
    return "".join(c if c.isalnum() or not c.isascii() else f"\\x{{{ord(c):X}}}" for c in literal)


@dataclass(frozen=True)
class Pattern:
    """A compiled request: java is for Spark's functions; literal is set if contains() will do."""

    raw: str
    java: str
    insensitive: bool
    literal: str | None
    #: Whether it can match an empty string, or only an empty one somewhere.
    may_be_empty: bool
    #: What a backtracking engine makes of it (linear.trust()).
    trust: str = "linear"

    def for_regex_module(self) -> str:
        import re

        spelt = re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: f"\\U{int(m[1], 16):08X}", self.java)
        spelt = spelt.removeprefix("(?dUiu)").removeprefix("(?dU)").replace("(?iu", "(?i").replace(r"\z", r"\Z").replace("&&[", "&&[")
        return ("(?V1i)" if self.insensitive else "(?V1)") + re.sub(r"\\([pP])\{Is(\w+)\}", r"\\\1{\2}", spelt).replace("(?-iu", "(?-i")


def compile_pattern(spark: SparkSession, patterns: tuple[str, ...] | list[str], case: str = "smart", fixed: bool = False, word: bool = False) -> Pattern:
    """Several patterns match what any of them does. Smart case: insensitive unless there is an ASCII capital in the raw text."""
    if not patterns:
        raise Fatal("no pattern")
    raw = "|".join(patterns)
    insensitive = case == "insensitive" or (case == "smart" and not any("A" <= c <= "Z" for c in raw))
    bodies = [_Translator(escaped(p) if fixed else p).whole() for p in patterns]
    body = bodies[0] if len(bodies) == 1 else "|".join(f"(?:{b})" for b in bodies)
    if word:
        body = rf"\b(?:{body})\b"
    java = ("(?dUiu)" if insensitive else "(?dU)") + body
    from py4j.protocol import Py4JJavaError
    from pyspark.errors import PySparkException

    try:
        compiled = spark._jvm.java.util.regex.Pattern.compile(java)
    except (Py4JJavaError, PySparkException) as e:
        raise Fatal(f"pattern {raw!r}: {str(e).splitlines()[0]}") from None
    caseless = not any(c.lower() != c or c.upper() != c for c in raw)
    literal = patterns[0] if fixed and len(patterns) == 1 and not word and (not insensitive or caseless) and patterns[0] else None
    try:
        trust = "linear" if literal else linear.trust(java)
        if trust != "linear":
            linear.engine(java)
    except (linear.TooLarge, RecursionError) as e:
        raise Fatal(f"pattern {raw!r}: {e}") from None
    return Pattern(raw, java, insensitive, literal, any(_finds_empty(compiled, x) for x in _PROBES), trust)
