"""Written calculations: found in running text, worked out, and compared with what is stated.

A line is cut into numbers, signs and words once.  Around each equals sign the
longest stretch to the left and to the right that is an expression is read by
precedence climbing; an expression must be set off from the words around it.
"""

from __future__ import annotations

import math
import re

# Signs that are written for operators, binary operators by how tightly they bind, and named functions.
SIGNS = {"−": "-", "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "×": "*", "·": "*", "∗": "*", "⋅": "*", "÷": "/", "∕": "/"}
BINDING = {"+": 1, "-": 1, "*": 2, "/": 2, "//": 2, "%": 2, "^": 4, "**": 4}
FUNCTIONS = ("max", "min", "floor", "ceil")
#: Bounds of powers: greatest base and exponent.
POWER = (1e6, 64)
#: What may stand right before and right after an equation's sides.
BEFORE, AFTER = frozenset(",;:($→⇒="), frozenset(",;:.)$→⇒=")

_TOKEN = re.compile(r"(?P<number>\d+(?:\.\d+)?)|(?P<word>[^\W\d]\w*)|(?P<sign>//|\*\*|[<>!:]=|==+|=[<>]|[-+*/%^(),=])|(?P<other>\S)")


class NoValue(ValueError):
    """What is written is no calculation, or can't be worked out."""


def tokens(line: str) -> list[tuple[str, str]]:
    return [(m.lastgroup, m.group()) for m in _TOKEN.finditer(line.translate({ord(a): b for a, b in SIGNS.items()}))]


class _Reader:
    def __init__(self, found: list[tuple[str, str]], whole: bool):
        self.found, self.at, self.whole = found, 0, whole

    def take(self, *wanted: str) -> bool:
        if self.at < len(self.found) and self.found[self.at][1] in wanted and self.found[self.at][0] == "sign":
            self.at += 1
            return True
        return False

    def operand(self) -> float:
        if self.take("-"):
            return -self.climb(3)  # a sign binds tighter than times, looser than a power
        if self.take("+"):
            return self.climb(3)
        if self.at == len(self.found):
            raise NoValue
        kind, text = self.found[self.at]
        self.at += 1
        if kind == "number":
            return float(text)
        if (kind, text) == ("sign", "("):
            value = self.climb(1)
        elif kind == "word" and text in FUNCTIONS and self.take("("):
            args = [self.climb(1)]
            while self.take(","):
                args.append(self.climb(1))
            if text in ("floor", "ceil"):
                if len(args) > 1:
                    raise NoValue
                value = float(getattr(math, text)(args[0]))
            else:
                value = max(args) if text == "max" else min(args)
        else:
            raise NoValue
        if not self.take(")"):
            raise NoValue
        return value

    def climb(self, least: int) -> float:
        value = self.operand()
        while self.at < len(self.found) and BINDING.get(self.found[self.at][1], 0) >= least:
            sign = self.found[self.at][1]
            self.at += 1
            value = self.apply(sign, value, self.climb(BINDING[sign] + (BINDING[sign] < 4)))  # powers group to the right
        return value

    def apply(self, sign: str, a: float, b: float) -> float:
        if sign in ("^", "**"):
            if abs(a) > POWER[0] or abs(b) > POWER[1] or (a < 0 and b % 1):
                raise NoValue
            return a**b
        if sign in ("/", "//", "%"):
            if not b:
                raise NoValue
            return a % b if sign == "%" else a // b if sign == "//" or self.whole else a / b
        return a + b if sign == "+" else a - b if sign == "-" else a * b


def work_out(found: list[tuple[str, str]], whole: bool = False) -> float | None:
    """The value of tokens that are one expression and nothing else; with ``whole`` every division drops its remainder."""
    reader = _Reader(found, whole)
    try:
        value = reader.climb(1)
    except (NoValue, OverflowError, ZeroDivisionError, RecursionError):
        return None
    return value if reader.at == len(found) and math.isfinite(value) else None


def evaluate(expression: str | None) -> float | None:
    """The value of a written calculation of numbers, + - * / // % ^, max, min, floor and ceil; None for anything else."""
    return work_out(tokens(expression)) if expression else None


def _belongs(token: tuple[str, str]) -> bool:
    kind, text = token
    return kind == "number" or (kind == "word" and text in FUNCTIONS) or (kind == "sign" and (text in BINDING or text in "(),"))


def _set_off(side: list[tuple[str, str]], outside: tuple[str, str] | None, left: bool) -> list[tuple[str, str]]:
    """The longest end of ``side`` next to the equals sign that is an expression set off from what stands before (or after) it."""
    edges = BEFORE if left else AFTER
    for n in range(len(side), 0, -1):
        part, rest = (side[-n:], side[:-n]) if left else (side[:n], side[n:])
        beyond = (rest[-1] if left else rest[0]) if rest else outside
        if (beyond is None or beyond[1] in edges) and work_out(part) is not None:
            return part
    return []


def agrees(left: list[tuple[str, str]], value: float, stated: float, places: int) -> bool:
    """Whether a value is stated exactly, rounded to the places given, or for a division as a whole number."""
    if math.isclose(value, stated, rel_tol=1e-9, abs_tol=1e-9) or (places and abs(value - stated) <= 0.5 * 10**-places + 1e-9):
        return True
    return ("sign", "/") in left and stated == int(stated) and (work_out(left, whole=True) == stated or round(value) == stated)


def calculations(text: str | None) -> list[dict]:
    """``left, stated, value, ok`` of each ``a = b`` within a line whose left side works something out; none for null and empty texts."""
    out = []
    for line in (text or "").split("\n"):
        if "=" not in line:
            continue
        found = tokens(line)
        for i in (i for i, t in enumerate(found) if t == ("sign", "=")):
            a = i
            while a and _belongs(found[a - 1]):
                a -= 1
            b = i + 1
            while b < len(found) and _belongs(found[b]):
                b += 1
            left = _set_off(found[a:i], found[a - 1] if a else None, True)
            right = _set_off(found[i + 1 : b], found[b] if b < len(found) else None, False)
            if not right or sum(k == "number" for k, _ in left) + sum(k == "word" for k, _ in left) < 2:
                continue
            value, stated = work_out(left), work_out(right)
            places = len(right[-1][1].partition(".")[2]) if len(right) == 1 or (len(right) == 2 and right[0][1] in "+-") else 0
            spell = lambda side: re.sub(r"(?<=[(]) | (?=[,)])|(?<=max|min) (?=\()|(?<=floor) (?=\()|(?<=ceil) (?=\()", "", " ".join(t for _, t in side))
            out.append({"left": spell(left), "stated": spell(right), "value": value, "ok": agrees(left, value, stated, places)})
    return out
