"""Settings files: assignments of numbers, strings, flags, vectors and nested tables, read without running code.

A file is a sequence of ``name = value`` with ``--`` comments; tables are ``{a = 1, b = 2}`` or ``{1, 2}``, separated
by commas or semicolons. Values may do arithmetic, use names set before, and call the helpers in ``HELPERS``. Function
definitions are skipped: a call of any other function is an error. Later files override earlier ones.
"""

from __future__ import annotations

import dataclasses
import math
import os
import re

from ..schema import Config

_TOKEN = re.compile(r"""\s+|--\[\[.*?\]\]|--[^\n]*|(?P<num>0[xX][0-9a-fA-F]+|\d+\.?\d*(?:[eE][-+]?\d+)?|\.\d+(?:[eE][-+]?\d+)?)|(?P<str>"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*')|(?P<name>[A-Za-z_]\w*)|(?P<op>[-+*/^%={}()\[\],;.#<>~:]+?)""", re.S)
_OPENING, _ALSO_OPENING = ("function", "if", "do"), ("repeat",)
HELPERS = {
    "vec2": lambda x, y: {"x": x, "y": y}, "vec3": lambda x, y, z: {"x": x, "y": y, "z": z}, "deg2rad": math.radians, "rad2deg": math.degrees,
    "sq": lambda x: x * x, "abs": abs, "sin": math.sin, "cos": math.cos, "sqrt": math.sqrt, "iff": lambda f, a, b: a if f else b,
}
_START = {"pi": math.pi, "on": True, "off": False, "math": {"pi": math.pi, "huge": math.inf, "abs": abs, "sin": math.sin, "cos": math.cos, "sqrt": math.sqrt, "rad": math.radians, "deg": math.degrees}, **HELPERS}


class ConfigError(ValueError):
    """A file that can't be read, or a value that isn't what was asked for."""


def _tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ConfigError(f"line {text.count(chr(10), 0, at) + 1}: unexpected {text[at]!r}")
        if m.lastgroup:
            out.append((m.lastgroup, m[0]))
        at = m.end()
    return out + [("end", "")]


class _Reader:
    """A recursive descent over one file's tokens, into ``names``."""

    def __init__(self, text: str, names: dict):
        self.tokens, self.at, self.names = _tokens(text), 0, names

    def peek(self) -> str:
        return self.tokens[self.at][1] if self.tokens[self.at][0] != "str" else ""

    def take(self, what: str | None = None) -> tuple[str, str]:
        kind, text = self.tokens[self.at]
        if what is not None and (kind == "str" or text != what):
            raise ConfigError(f"expected {what!r}, found {text or 'the end'!r}")
        self.at += 1
        return kind, text

    def file(self) -> None:
        while self.tokens[self.at][0] != "end":
            if self.peek() == ";":
                self.take()
            elif self.peek() == "function":
                self.skip()
            else:
                self.assign()

    def skip(self) -> None:
        """A function definition, up to its end."""
        depth = 0
        while True:
            kind, text = self.take()
            if kind == "end":
                raise ConfigError("a function without end")
            if kind == "name":
                depth += (text in _OPENING) + (text in _ALSO_OPENING) - (text in ("end", "until"))
                if not depth:
                    return

    def name(self) -> str:
        kind, text = self.take()
        if kind != "name":
            raise ConfigError(f"expected a name, found {text or 'the end'!r}")
        return text

    def assign(self) -> None:
        path = [self.name()]
        while self.peek() == ".":
            self.take()
            path.append(self.name())
        self.take("=")
        into = self.names
        for part in path[:-1]:
            into = into.get(part)
            if not isinstance(into, dict):
                raise ConfigError(f"{part!r} is no table")
        into[path[-1]] = self.sum()

    def sum(self):
        x = self.product()
        while (op := self.peek()) in ("+", "-"):
            self.take()
            y = self.product()
            x = x + y if op == "+" else x - y
        return x

    def product(self):
        x = self.signed()
        while (op := self.peek()) in ("*", "/", "%"):
            self.take()
            y = self.signed()
            x = x * y if op == "*" else x / y if op == "/" else x % y
        return x

    def signed(self):
        if self.peek() == "-":
            self.take()
            return -self.signed()
        x = self.value()
        if self.peek() == "^":
            self.take()
            x = x ** self.signed()
        return x

    def value(self):
        kind, text = self.take()
        if kind == "num":
            return int(text, 0) if re.fullmatch(r"0[xX][0-9a-fA-F]+", text) else int(text) if text.isdigit() else float(text)
        if kind == "str":
            return re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), text[1:-1])
        if text == "(":
            x = self.sum()
            self.take(")")
            return x
        if text == "{":
            return self.table()
        if text in ("true", "false", "nil"):
            return {"true": True, "false": False, "nil": None}[text]
        if kind != "name":
            raise ConfigError(f"unexpected {text or 'end'!r}")
        if text not in self.names:
            raise ConfigError(f"{text!r} is not set")
        x = self.names[text]
        while self.peek() in (".", "("):
            if self.take()[1] == ".":
                key = self.name()
                if not isinstance(x, dict) or key not in x:
                    raise ConfigError(f"{key!r} is not set")
                x = x[key]
            else:
                if not callable(x):
                    raise ConfigError(f"{text!r} is no function")
                args = []
                while self.peek() != ")":
                    args.append(self.sum())
                    if self.peek() == ",":
                        self.take()
                self.take(")")
                x = x(*args)
        return x

    def table(self) -> dict:
        out, n = {}, 1
        while self.peek() != "}":
            if self.tokens[self.at][0] == "name" and self.tokens[self.at + 1] == ("op", "="):
                key = self.name()
                self.take("=")
                out[key] = self.sum()
            elif self.peek() == "[":
                self.take()
                key = self.sum()
                self.take("]")
                self.take("=")
                out[key] = self.sum()
            else:
                out[n] = self.sum()
                n += 1
            if self.peek() in (",", ";"):
                self.take()
        self.take("}")
        return out


class Settings:
    """Values by dotted name. ``sub`` gives those under a prefix; ``modified`` tells whether a file has changed since it was read."""

    def __init__(self, *paths: str, values: dict | None = None, prefix: str = ""):
        self.paths, self.prefix, self.values = paths, prefix, values if values is not None else {}
        if values is None:
            self.reload()

    def reload(self) -> None:
        names = dict(_START)
        self._stamps = {}
        for path in self.paths:
            self._stamps[path] = os.stat(path).st_mtime_ns
            with open(path, encoding="utf-8") as f:
                try:
                    _Reader(f.read(), names).file()
                except (ConfigError, TypeError, ZeroDivisionError) as e:
                    raise ConfigError(f"{path}: {e}") from e
        self.values = {k: v for k, v in names.items() if k not in _START or v is not _START[k]}

    def modified(self) -> bool:
        return any(not os.path.exists(p) or os.stat(p).st_mtime_ns != t for p, t in self._stamps.items())

    def sub(self, prefix: str) -> Settings:
        return Settings(values=self.values, prefix=f"{self.prefix}{prefix}.")

    def _find(self, name: str):
        x = self.values
        for part in f"{self.prefix}{name}".split("."):
            x = x.get(part, x.get(int(part)) if part.isdigit() else None) if isinstance(x, dict) else None
        return x

    def _typed(self, name, kinds, default, what, least=None, most=None):
        x = self._find(name)
        if x is None and default is not None:
            return default
        if not isinstance(x, kinds) or isinstance(x, bool) and bool not in kinds:
            raise ConfigError(f"{self.prefix}{name}: expected {what}, found {x!r}")
        if least is not None and x < least or most is not None and x > most:
            raise ConfigError(f"{self.prefix}{name}: {x} is not in [{least}, {most}]")
        return x

    def text(self, name: str, default: str | None = None) -> str:
        return self._typed(name, (str,), default, "a string")

    def flag(self, name: str, default: bool | None = None) -> bool:
        return self._typed(name, (bool,), default, "true or false")

    def integer(self, name: str, default: int | None = None, least: int | None = None, most: int | None = None) -> int:
        """A whole number; one without a fraction counts (``least=0`` for unsigned)."""
        x = self._typed(name, (int, float), default, "a whole number", least, most)
        if x != int(x):
            raise ConfigError(f"{self.prefix}{name}: {x} is no whole number")
        return int(x)

    def real(self, name: str, default: float | None = None, least: float | None = None, most: float | None = None) -> float:
        return float(self._typed(name, (int, float), default, "a number", least, most))

    def positive(self, name: str, default: float | None = None) -> float:
        x = self.real(name, default)
        if not x > 0:
            raise ConfigError(f"{self.prefix}{name}: {x} is not above 0")
        return x

    def table(self, name: str) -> dict:
        return self._typed(name, (dict,), None, "a table")

    def vector(self, name: str, axes: str = "xy") -> tuple[float, ...]:
        """Numbers by axis ("xy", "xyz" or "wxyz"), from a table with those names or in that order."""
        t = self.table(name)
        own = self.sub(name)
        return tuple(own.real(a if a in t else str(i)) for i, a in enumerate(axes, 1))

    def bounds(self, name: str) -> tuple[float, float]:
        """The ends of a range, named min and max or in that order."""
        t, own = self.table(name), self.sub(name)
        low, high = (own.real(k if k in t else str(i)) for i, k in ((1, "min"), (2, "max")))
        if low > high:
            raise ConfigError(f"{self.prefix}{name}: {low} is above {high}")
        return low, high


def config(settings: Settings) -> Config:
    """The engine's thresholds, with what ``settings`` names of them."""
    kinds = {int: settings.integer, float: settings.real, bool: settings.flag, str: settings.text}
    given = {f.name: kinds[type(f.default)](f.name) for f in dataclasses.fields(Config) if settings._find(f.name) is not None and type(f.default) in kinds}
    return dataclasses.replace(Config(), **given)
