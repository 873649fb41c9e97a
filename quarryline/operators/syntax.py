"""Syntax nodes of sources as a table, and what is found by joins of it: test fixtures, their metrics and tear-down code.

A small tolerant parser gives each source's nodes (kind, name, span, parent) once: Java, JavaScript and TypeScript by their
brackets, keywords and arrows, Python by ``ast``. What isn't understood is passed over, so a broken source gives the nodes of
its sound parts. All else works on the table of nodes, with joins on (file_id, node).
"""

from __future__ import annotations

import ast
import io
import itertools
import re
import tokenize
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.functions import scalars as S
from quarryline.operators import extract as X

SCHEMA = (
    "file_id long, language string, node int, parent int, kind string, name string, begin int, end int, start_line int, end_line int, marks array<string>,"
    " parameters array<string>, container int, extends string, depth int, decisions int, comments int, made int, text string"
)

#: Characters of rows that a task holds before they go on.
MOST = 2 << 20

# What marks test fixtures, with their types and scopes.
JAVA_MARKS = {
    "BeforeEach": ("junit5_before_each", "per_test", "junit"),
    "BeforeAll": ("junit5_before_all", "per_class", "junit"),
    "AfterEach": ("junit5_after_each", "per_test", "junit"),
    "AfterAll": ("junit5_after_all", "per_class", "junit"),
    "Before": ("junit4_before", "per_test", "junit"),
    "After": ("junit4_after", "per_test", "junit"),
    "BeforeMethod": ("testng_before_method", "per_test", "testng"),
    "AfterMethod": ("testng_after_method", "per_test", "testng"),
    "DataProvider": ("testng_data_provider", "per_test", "testng"),
    "BeforeClass": ("testng_before_class", "per_class", "testng"),
    "AfterClass": ("testng_after_class", "per_class", "testng"),
}
JAVA_FIELDS = {"Rule": ("junit_rule", "per_test", "junit"), "ClassRule": ("junit_class_rule", "per_class", "junit")}
JUNIT3 = {"setUp": "junit3_setup", "tearDown": "junit3_teardown"}
HOOKS = {
    "beforeEach": ("before_each", "per_test"),
    "beforeAll": ("before_all", "per_class"),
    "afterEach": ("after_each", "per_test"),
    "afterAll": ("after_all", "per_class"),
    "before": ("mocha_before", "per_test"),
    "after": ("mocha_after", "per_test"),
    "aroundEach": ("vitest_around_each", "per_test"),
    "aroundAll": ("vitest_around_all", "per_class"),
}
UNITTEST = {"setUp": "per_test", "tearDown": "per_test", "setUpClass": "per_class", "tearDownClass": "per_class", "setUpModule": "per_module", "tearDownModule": "per_module", "asyncSetUp": "per_test", "asyncTearDown": "per_test"}
METHODS = {"setup_method": "per_test", "teardown_method": "per_test", "setup_class": "per_class", "teardown_class": "per_class"}
PYTEST_SCOPES = {"function": "per_test", "class": "per_class", "module": "per_module", "package": "per_module", "session": "global"}
ALWAYS_PAIRED = ("junit_rule", "junit_class_rule", "vitest_around_each", "vitest_around_all")
NAME_PAIRS = {"setUp": "tearDown", "setUpClass": "tearDownClass", "setUpModule": "tearDownModule", "setup_method": "teardown_method", "setup_class": "teardown_class"}
TYPE_PAIRS = {
    "junit5_before_each": "junit5_after_each", "junit5_before_all": "junit5_after_all", "junit4_before": "junit4_after", "testng_before_method": "testng_after_method",
    "testng_before_class": "testng_after_class", "junit3_setup": "junit3_teardown", "before_each": "after_each", "before_all": "after_all", "mocha_before": "mocha_after",
}

_TOKEN = re.compile(r"\s*+([\w$#]+|=>|->|::|\.\.\.|&&|\|\||\?\?|\?\.|[=!]==?|[<>]=|[^\s\w])")
_OPENERS, _CLOSERS = {"(": ")", "[": "]", "{": "}"}, {")": "(", "]": "[", "}": "{"}
_CONTROLS = {"if", "for", "while", "with", "switch", "synchronized"}
_CLASSES = {"class", "interface", "enum", "record"}
#: A line that begins or a line before that ends with such a token goes on.
_GOES_ON = set(". ( [ , ? : => && || ?? ?. + - * / % = == === != !== < > <= >= & | ^ ` instanceof in of".split())
_ENDS_OPEN = _GOES_ON - {")", "]", "++", "--"} | {"{", "return", "new", "typeof", "await", "async", "else", "!"}
_DECISION = {"if", "for", "while", "case", "catch", "&&", "||", "?", "??"}
_NO_CALL = {"async", "await", "return", "typeof", "case", "in", "of", "delete", "void", "throw", "else", "yield", "instanceof", "catch", "extends"}
#: String tokens.
TEXT = '"'


class Parser:
    """The nodes of one source of the brace languages."""

    def __init__(self, source: str, language: str) -> None:
        self.source, self.java = source, language == "java"
        seen: list[tuple[bool, int, int]] = []
        code = X.blanked(source, seen)
        self.comments = [(b, e) for comment, b, e in seen if comment]
        # Blanks are skipped in one step each: behind the last token there are none.
        tokens = [(m.start(1), m.group(1)) for m in _TOKEN.finditer(code.rstrip())] + [(b, TEXT) for comment, b, _ in seen if not comment]
        tokens.sort()
        self.ends = {b: e for comment, b, e in seen if not comment}
        self.at, self.text = [b for b, _ in tokens], [t for _, t in tokens]
        self.match = self._matched()
        breaks = [0, *(m.end() for m in re.finditer("\n", source))]
        self.breaks = breaks
        self.nodes: list[dict] = []
        try:
            self._block(0, len(self.text), -1)
        except RecursionError:
            # Thousands of nested blocks: what was found until then stays.
            pass

    def _matched(self) -> list[int]:
        """For each bracket its partner; an opener without one ends where the bracket around it does."""
        match, opened = list(range(len(self.text))), []
        for i, t in enumerate(self.text):
            if t in _OPENERS:
                opened.append(i)
            elif t in _CLOSERS and any(self.text[k] == _CLOSERS[t] for k in opened[-8:]):
                while self.text[opened[-1]] != _CLOSERS[t]:
                    match[opened.pop()] = i - 1
                match[opened[-1]], match[i] = i, opened[-1]
                opened.pop()
        for i in opened:
            match[i] = max(i, len(self.text) - 1)
        return match

    def tok(self, i: int) -> str:
        return self.text[i] if 0 <= i < len(self.text) else ""

    def line(self, place: int) -> int:
        return bisect_right(self.breaks, place)

    def end_of(self, i: int) -> int:
        """The place behind token ``i``."""
        return self.ends.get(self.at[i], self.at[i] + 1) if self.text[i] == TEXT else self.at[i] + len(self.text[i])

    def node(self, kind: str, first: int, last: int, parent: int, name: str = "", **more) -> int:
        """A new node over the tokens ``first`` to ``last``; ``close`` may move its end later."""
        self.nodes.append({"kind": kind, "first": first, "last": last, "parent": parent, "name": name, **more})
        return len(self.nodes) - 1

    def _block(self, i: int, end: int, parent: int) -> None:
        while i < end:
            i = max(i + 1, self._statement(i, end, parent))

    def _statement(self, i: int, end: int, parent: int) -> int:
        t = self.tok(i)
        if t == "{":
            self._block(i + 1, min(self.match[i], end), parent)
            return self.match[i] + 1
        if t in _CONTROLS:
            k = i + 2 if self.tok(i + 1) == "await" else i + 1
            if self.tok(k) == "(":
                n = self.node(t, i, i, parent)
                self._expression(k + 1, self.match[k], n)
                after = self._statement(self.match[k] + 1, end, n) if self.match[k] + 1 < end else self.match[k] + 1
                if t == "if" and self.tok(after) == "else" and after < end:
                    after = self._statement(after + 1, end, n)
                self.nodes[n]["last"] = min(after, end) - 1
                return after
        if t in ("do", "try") and self.tok(i + 1) in ("{", "(") or t == "do":
            n = self.node(t, i, i, parent)
            k = i + 1
            if t == "do":
                k = self._statement(k, end, n)
                if self.tok(k) == "while" and self.tok(k + 1) == "(":
                    self._expression(k + 2, self.match[k + 1], n)
                    k = self.match[k + 1] + 1
            else:
                if self.tok(k) == "(":
                    self._expression(k + 1, self.match[k], n)
                    k = self.match[k] + 1
                while self.tok(k) == "{" and k < end:
                    self._block(k + 1, self.match[k], n)
                    k = self.match[k] + 1
                    if self.tok(k) in ("catch", "finally"):
                        k = self.match[k + 1] + 1 if self.tok(k + 1) == "(" else k + 1
            self.nodes[n]["last"] = min(k, end) - 1
            return k
        if t == "type" and not self.java and re.match(r"[A-Za-z_$]", self.tok(i + 1)) and self.tok(i + 2) in ("=", "<"):
            return self._statement_end(i, end)
        k, marks = self._marks(i)
        if (found := self._class(k, i, parent, marks, end)) is not None:
            return found
        last = self._statement_end(i, end)
        self._expression(i, last, parent)
        return last + 1 if self.tok(last) == ";" else last

    def _marks(self, i: int) -> tuple[int, list[str]]:
        """Behind annotations and modifiers, and the annotations' names."""
        marks = []
        while True:
            if self.tok(i) == "@" and self.tok(i + 1) != "interface":
                name, i = self.tok(i + 1), i + 2
                while self.tok(i) == ".":
                    name, i = f"{name}.{self.tok(i + 1)}", i + 2
                i = self.match[i] + 1 if self.tok(i) == "(" else i
                marks.append(name)
            elif self.tok(i) in ("public", "protected", "private", "static", "final", "abstract", "sealed", "strictfp", "export", "default", "declare", "synchronized", "native", "transient", "volatile", "readonly", "override", "accessor") and self.tok(i + 1) not in ("(", "=", ":"):
                i += 1
            else:
                return i, marks

    def _class(self, k: int, first: int, parent: int, marks: list[str], end: int) -> int | None:
        """A class and its like at token ``k``: the token behind it."""
        k += self.tok(k) == "@"
        word = self.tok(k)
        if word not in _CLASSES or self.tok(k - 1) in (".", "::") or word != "class" and not re.match(r"[A-Za-z_$]", self.tok(k + 1)) or self.tok(k + 1) in ("=", ":", ".", "(", ")", ",", ";"):
            return None
        if word == "record" and self.tok(k + 2) not in ("(", "<") or word in ("interface", "record") and not self.java and self.tok(k + 2) not in ("{", "<", "extends"):
            return None
        name = "" if self.tok(k + 1) in ("{", "extends") else self.tok(k + 1)
        body, inherits = k + 1, ""
        while body < end and self.tok(body) not in ("{", ";"):
            if self.tok(body) == "extends":
                stop = body + 1
                while stop < end and self.tok(stop) not in ("{", "implements", "permits"):
                    stop += 1
                inherits = "".join(self.text[body + 1 : stop])
            body = self.match[body] + 1 if self.tok(body) in ("(", "[") else body + 1
        if self.tok(body) != "{":
            return None
        n = self.node(word, first, self.match[body], parent, name, marks=marks, extends=inherits)
        self._members(body + 1, min(self.match[body], end), n, word == "enum" and self.java)
        return self.match[body] + 1

    def _members(self, i: int, end: int, parent: int, constants: bool = False) -> None:
        if constants:
            while i < end and self.tok(i) != ";":
                if self.tok(i) == "(":
                    self._expression(i + 1, self.match[i], parent)
                if self.tok(i) == "{":
                    n = self.node("anonymous", i, self.match[i], parent)
                    self._members(i + 1, self.match[i], n)
                i = self.match[i] + 1 if self.tok(i) in _OPENERS else i + 1
        while i < end:
            i = max(i + 1, self._member(i, end, parent))

    def _member(self, i: int, end: int, parent: int) -> int:
        first = i
        if self.tok(i) in (";", ","):
            return i + 1
        k, marks = self._marks(i)
        if (found := self._class(k, first, parent, marks, end)) is not None:
            return found
        if self.tok(k) == "{":
            self._block(k + 1, self.match[k], parent)
            return self.match[k] + 1
        angle, name = 0, ""
        while k < end:
            t = self.tok(k)
            if t == "@":
                k, more = self._marks(k)
                marks += more if not angle else []
                continue
            angle += (t == "<") - (t == ">")
            if t == "(" and angle <= 0:
                name = self.tok(k - 1) if self.tok(k - 1) not in (">", "]", TEXT) else name or self.tok(k - 1)
                return self._method(first, k, end, parent, name, marks)
            if t in ("=", ";") or t == "{" or not self.java and k > i and t not in ("?", "!", ":") and self._new_line(k):
                break
            if t not in ("?", "!", "<", ">", ",", ".", ":", "[", "]") and not angle:
                name = t
            k = self.match[k] + 1 if t == "[" else k + 1
        if self.tok(k) == "=" or self.tok(k) == ";" or not self.java:
            if self.java:
                last = k
                while last < end and self.tok(last) != ";":
                    last = self.match[last] + 1 if self.tok(last) in _OPENERS else last + 1
            else:
                last = self._statement_end(k, end) if self.tok(k) == "=" else k
            has_end = self.tok(last) == ";" and last < end
            n = self.node("field", first, last if has_end else max(first, last - 1), parent, name, marks=marks)
            self._expression(k + 1, min(last, end), n)
            return last + 1 if has_end else last
        return self.match[k] + 1 if self.tok(k) in _OPENERS else k + 1

    def _method(self, first: int, opener: int, end: int, parent: int, name: str, marks: list[str]) -> int:
        k = self.match[opener] + 1
        while k < end and self.tok(k) not in ("{", ";", "=", "}"):
            if not self.java and self._new_line(k) and self.tok(k) != ":":
                break
            k = self.match[k] + 1 if self.tok(k) in ("(", "[") else k + 1
        # A constructor has no type before its name.
        behind = self._marks(first)[0]
        behind = self._behind_angles(behind, opener) if self.tok(behind) == "<" else behind
        kind = "constructor" if self.java and behind == opener - 1 else "method"
        n = self.node(kind, first, k, parent, name, marks=marks, parameters=self._parameters(opener))
        self._expression(opener + 1, self.match[opener], n)
        if self.tok(k) == "{":
            self._block(k + 1, self.match[k], n)
            self.nodes[n]["last"] = self.match[k]
            return self.match[k] + 1
        while k < end and self.tok(k) not in (";", "}"):
            k = self.match[k] + 1 if self.tok(k) in _OPENERS else k + 1
        self.nodes[n]["last"] = min(k, end) if self.tok(k) == ";" else max(first, min(k, end) - 1)
        return k + 1

    def _parameters(self, opener: int) -> list[str]:
        """The parameters between brackets, each as its tokens."""
        parts, part, k, angle = [], [], opener + 1, 0
        while k < self.match[opener]:
            t = self.tok(k)
            angle += (t == "<") - (t == ">")
            if t == "," and angle <= 0:
                parts.append(part)
                part, k = [], k + 1
                continue
            stop = self.match[k] + 1 if t in _OPENERS else k + 1
            part += self.text[k:stop]
            k = stop
        return [" ".join(p) for p in [*parts, part] if p]

    def _new_line(self, k: int) -> bool:
        """Whether a statement of JavaScript ends before token ``k`` because a line does."""
        return self.line(self.at[k]) > self.line(self.end_of(k - 1) - 1) and self.tok(k) not in _GOES_ON and self.tok(k - 1) not in _ENDS_OPEN

    def _statement_end(self, i: int, end: int) -> int:
        """The token that ends a statement, or the first one behind it."""
        k = i
        while k < end:
            t = self.tok(k)
            if t == ";" or not self.java and k > i and self._new_line(k):
                return k
            if self.java and t in ("case", "default") and k > i and self.tok(k - 1) in (":", "->"):
                return k
            k = self.match[k] + 1 if t in _OPENERS else k + 1
        return end

    def _expression(self, i: int, end: int, parent: int) -> None:
        while i < end:
            i = max(i + 1, self._term(i, end, parent))

    def _term(self, i: int, end: int, parent: int) -> int:
        t = self.tok(i)
        if t == "{":
            before = self.tok(i - 1)
            if before in ("->", "=>", ")", "else", ":") and self.java or before == "=>":
                self._block(i + 1, self.match[i], parent)
            elif self.java:
                self._expression(i + 1, self.match[i], parent)
            else:
                self._object(i + 1, self.match[i], parent)
            return self.match[i] + 1
        if t == "function" and not self.java and self.tok(i - 1) != ".":
            return self._function(i, end, parent)
        if t == "=>" and not self.java:
            return self._arrow(i, end, parent)
        if t == "class" and (found := self._class(i, i, parent, [], end)) is not None:
            return found
        if t == "new" and self.tok(i - 1) not in (".", "::") and self.tok(i + 1) != ".":
            n = self.node("new", i, i, parent)
            k = i + 1
            while k < end and (re.match(r"[\w$]", self.tok(k)) or self.tok(k) in (".", "@")):
                k += 1
            self.nodes[n]["name"] = "".join(self.text[i + 1 : k])
            if self.tok(k) == "<":
                k = self._behind_angles(k, end)
            while self.tok(k) == "[" and k < end:
                self.nodes[n]["kind"] = "array"
                self._expression(k + 1, self.match[k], n)
                k = self.match[k] + 1
            if self.tok(k) == "(" and k < end:
                self._expression(k + 1, self.match[k], n)
                k = self.match[k] + 1
                if self.java and self.tok(k) == "{" and k < end:
                    inner = self.node("anonymous", k, self.match[k], n)
                    self._members(k + 1, self.match[k], inner)
                    k = self.match[k] + 1
            self.nodes[n]["last"] = max(i, k - 1)
            return k
        if t in ("switch", "if", "for", "while", "try", "do") and self.tok(i + 1) in ("(", "{") and self.tok(i - 1) not in (".", "?."):
            # A statement inside an expression: of a lambda without braces, or of a broken source.
            return self._statement(i, end, parent)
        if re.match(r"[A-Za-z_$#]", t) and t not in _NO_CALL:
            return self._call(i, end, parent)
        if t in ("(", "["):
            self._expression(i + 1, min(self.match[i], end), parent)
            return self.match[i] + 1
        return i + 1

    def _behind_angles(self, k: int, end: int) -> int:
        """The token behind type arguments that begin at ``k``; ``k`` itself if these are none."""
        depth, at = 0, k
        while at < min(end, k + 64):
            t = self.tok(at)
            depth += (t == "<") - (t == ">")
            if not depth:
                return at + 1
            if t in ("{", "}", ";", "&&", "||", "(", ")") and not (t in ("{", "(") and self.match[at] > at):
                return k
            at = self.match[at] + 1 if t in ("{", "(", "[") else at + 1
        return k

    def _call(self, i: int, end: int, parent: int) -> int:
        """A name with what is called on it: one node for each call of a chain, the outermost first."""
        k, name, last = i + 1, self.tok(i), i
        calls = []
        while k < end:
            t = self.tok(k)
            if t in (".", "?.", "::") and re.match(r"[\w$#]", self.tok(k + 1)):
                name, last, k = name + t + self.tok(k + 1), k + 1, k + 2
            elif t == "!" and self.tok(k + 1) == "." and not self.java:
                k += 1
            elif t == "(":
                calls.append((name, k))
                name, last, k = name + "()", self.match[k], self.match[k] + 1
            elif t == "[":
                calls.append((None, k))
                name, last, k = name + "[]", self.match[k], self.match[k] + 1
            elif t == "<" and not self.java and (after := self._behind_angles(k, end)) > k and self.tok(after) == "(":
                k = after
            elif t == TEXT and last == k - 1 and self.source[self.at[k]] == "`":
                k, last, name = k + 1, k, name + "``"
            else:
                break
        above = parent
        numbers = []
        for called, opener in reversed(calls):
            if called is not None:
                above = self.node("call", i, self.match[opener], above, called)
            numbers.append(above)
        for (_, opener), n in zip(calls, reversed(numbers), strict=True):
            self._expression(opener + 1, min(self.match[opener], end), n)
        return k

    def _function(self, i: int, end: int, parent: int) -> int:
        first = i - 1 if self.tok(i - 1) == "async" else i
        k = i + 1 + (self.tok(i + 1) == "*")
        name = "" if self.tok(k) in ("(", "<") else self.tok(k)
        while k < end and self.tok(k) not in ("(", "{", ";"):
            k += 1
        if self.tok(k) != "(":
            return k
        n = self.node("function", first, self.match[k], parent, name, parameters=self._parameters(k))
        self._expression(k + 1, self.match[k], n)
        k = self.match[k] + 1
        if self.tok(k) == ":":
            k += 1
            while k < end and not (self.tok(k) == "{" and self.tok(k - 1) not in (":", "|", "&", "<", ",")) and self.tok(k) != ";":
                k = self.match[k] + 1 if self.tok(k) in _OPENERS else k + 1
        if self.tok(k) == "{":
            self._block(k + 1, min(self.match[k], end), n)
            self.nodes[n]["last"] = self.match[k]
            return self.match[k] + 1
        return k

    def _arrow(self, i: int, end: int, parent: int) -> int:
        before = self.match[i - 1] if self.tok(i - 1) == ")" else i - 1
        if self.tok(before) not in ("(",) and self.tok(i - 1) != ")":
            # Types of results stand between the parameters and the arrow.
            back = i - 1
            while back > 0 and self.tok(back) not in (")", "(", ",", ";", "{", "}", "="):
                back = self.match[back] - 1 if self.tok(back) in _CLOSERS and self.match[back] < back else back - 1
            if self.tok(back) == ")" and self.tok(back + 1) == ":":
                before = self.match[back]
        parameters = self._parameters(before) if self.tok(before) == "(" else [self.tok(before)]
        first = before - 1 if self.tok(before - 1) == "async" else before
        n = self.node("function", first, i, parent, "", parameters=parameters)
        if self.tok(i + 1) == "{":
            self._block(i + 2, min(self.match[i + 1], end), n)
            self.nodes[n]["last"] = self.match[i + 1]
            return self.match[i + 1] + 1
        k = i + 1
        while k < end and self.tok(k) not in (",", ";", ")", "]", "}"):
            k = self.match[k] + 1 if self.tok(k) in _OPENERS else k + 1
        self._expression(i + 1, min(k, end), n)
        self.nodes[n]["last"] = max(i, min(k, end) - 1)
        return k

    def _object(self, i: int, end: int, parent: int) -> None:
        """An object's properties; methods are functions."""
        while i < end:
            k = i
            while self.tok(k) in ("async", "get", "set", "*") and self.tok(k + 1) not in ("(", ":", ",", "}"):
                k += 1
            opener = k + 1 if self.tok(k) != "[" else self.match[k] + 1
            if self.tok(opener) == "(" and opener < end and self.tok(self.match[opener] + 1) == "{" and self.match[opener] + 1 < end:
                i = self._method(i, opener, end, parent, self.tok(k), [])
                continue
            stop = i
            while stop < end and self.tok(stop) != ",":
                stop = self.match[stop] + 1 if self.tok(stop) in _OPENERS else stop + 1
            self._expression(i, min(stop, end), parent)
            i = stop + 1

    def rows(self, chosen) -> Iterator[dict]:
        """All nodes; of those that are ``chosen`` also the text, and the measures of what is in it."""
        n, nested, functions = len(self.nodes), ("if", "for", "while", "do", "try", "with"), ("function", "method", "constructor")
        spans = [(self.at[x["first"]], self.end_of(max(x["first"], x["last"]))) for x in self.nodes]
        depth, around = [1] * n, [-1] * n
        for k, x in enumerate(self.nodes):
            if (p := x["parent"]) >= 0:
                holds = self.nodes[p]["kind"] == "class" if self.java else self.nodes[p]["kind"] == "call" and self.nodes[p]["name"] == "describe"
                around[k] = p if holds else around[p]
        for k in range(n - 1, -1, -1):
            own = depth[k] + (self.nodes[k]["kind"] in nested)
            if (p := self.nodes[k]["parent"]) >= 0:
                depth[p] = max(depth[p], own)
            depth[k] = own
        made = sorted(b for x, (b, _) in zip(self.nodes, spans, strict=True) if x["kind"] == "new")
        remarks = sorted(self.comments)
        for k, x in enumerate(self.nodes):
            begin, end = spans[k]
            row = _row(k, x["parent"], x["kind"], x["name"], begin, end, self.line(begin), self.line(max(begin, end - 1)), depth[k])
            row["marks"], row["parameters"] = x.get("marks", []), x.get("parameters", [])
            if around[k] >= 0:
                row["container"], row["extends"] = spans[around[k]][0], self.nodes[around[k]].get("extends", "")
            if chosen(x):
                inside = [m for m in range(k, n) if self.nodes[m]["kind"] in functions and begin <= spans[m][0] and spans[m][1] <= end]
                row["decisions"], row["text"] = self._decisions(inside), self.source[begin:end]
                row["parameters"] = self.nodes[inside[0]].get("parameters", []) if inside else []
                row["made"] = bisect_left(made, end) - bisect_left(made, begin)
                row["comments"] = sum(self.line(max(b, e - 1)) - self.line(b) + 1 for b, e in remarks[bisect_left(remarks, (begin, 0)) : bisect_left(remarks, (end, 0))])
            yield row
        for k, (begin, end) in enumerate(self.comments, n):
            yield _row(k, -1, "comment", "", begin, end, self.line(begin), self.line(max(begin, end - 1)), 0)

    def _decisions(self, inside: list[int]) -> int:
        """The decisions of the first of some functions, without those of functions in it."""
        if not inside:
            return 0
        outer, *inner = (self.nodes[m] for m in inside)
        skip = {x["first"]: x["last"] for x in sorted(inner, key=lambda x: x["last"])}
        count, at = 0, outer["first"]
        while at <= outer["last"]:
            if at in skip and at > outer["first"]:
                at = skip[at] + 1
                continue
            t = self.tok(at)
            count += t in _DECISION and not (t == "?" and self.tok(at + 1) in (":", ")", ",", ".", "=", ";", ">", "extends", "super"))
            at += 1
        return count


def _row(node: int, parent: int, kind: str, name: str, begin: int, end: int, start_line: int, end_line: int, depth: int) -> dict:
    where = {"node": node, "parent": parent if parent >= 0 else None, "kind": kind, "name": name, "begin": begin, "end": end, "start_line": start_line, "end_line": end_line}
    return where | {"marks": [], "parameters": [], "container": None, "extends": "", "depth": depth, "decisions": None, "comments": None, "made": None, "text": None}


def _python_rows(source: str) -> Iterator[dict]:
    """Functions, classes, calls and comments of a Python source; nothing of one that can't be parsed."""
    try:
        tree = ast.parse(source)
        remarks = [t for t in tokenize.generate_tokens(io.StringIO(source).readline) if t.type == tokenize.COMMENT]
    except (SyntaxError, ValueError, RecursionError, MemoryError, tokenize.TokenError):
        return
    lines = source.split("\n")
    starts = [0, *itertools.accumulate(len(x) + 1 for x in lines)]
    remark_lines = [t.start[0] for t in remarks]

    def place(line: int, byte: int) -> int:
        return starts[line - 1] + len(lines[line - 1].encode()[:byte].decode("utf-8", "ignore"))

    number, rest = 0, [(tree, -1)]
    while rest:
        node, parent = rest.pop()
        own = parent
        is_function, is_call = isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef), isinstance(node, ast.Call)
        if is_function or is_call or isinstance(node, ast.ClassDef):
            own, number = number, number + 1
            begin, end = place(node.lineno, node.col_offset), place(node.end_lineno, node.end_col_offset)
            name = (X._dotted(node.func) or getattr(node.func, "attr", "")) if is_call else node.name
            row = _row(own, parent, "function" if is_function else "call" if is_call else "class", name, begin, end, node.lineno, node.end_lineno, 1)
            row["marks"] = [ast.get_source_segment(source, d) or "" for d in getattr(node, "decorator_list", [])]
            if is_function:
                below = list(ast.walk(node))
                a = node.args
                stars = ([f"*{a.vararg.arg}"] if a.vararg else [], [f"**{a.kwarg.arg}"] if a.kwarg else [])
                row["parameters"] = [x for x in [*(y.arg for y in [*a.posonlyargs, *a.args]), *stars[0], *(y.arg for y in a.kwonlyargs), *stars[1]] if x not in ("self", "cls")]
                row["depth"], row["decisions"], row["text"] = _python_depth(node), _python_decisions(node), source[begin:end]
                row["made"] = sum(isinstance(x, ast.Call) and (getattr(x.func, "id", "") or getattr(x.func, "attr", ""))[:1].isupper() for x in below)
                row["comments"] = bisect_right(remark_lines, node.end_lineno) - bisect_left(remark_lines, node.lineno)
            yield row
        # Decorators stand before what they decorate.
        before = getattr(node, "decorator_list", [])
        rest += [(c, parent if c in before else own) for c in reversed(list(ast.iter_child_nodes(node)))]
    for k, t in enumerate(remarks, number):
        yield _row(k, -1, "comment", "", starts[t.start[0] - 1] + t.start[1], starts[t.end[0] - 1] + t.end[1], t.start[0], t.end[0], 0)


def _python_decisions(node: ast.AST) -> int:
    """The decisions of a function, without those of functions in it."""
    branches, count, rest = (ast.If, ast.IfExp, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler), 0, list(ast.iter_child_nodes(node))
    while rest:
        at = rest.pop()
        if isinstance(at, ast.FunctionDef | ast.AsyncFunctionDef):
            continue
        count += isinstance(at, branches) + (isinstance(at, ast.Try) and bool(at.finalbody))
        count += len(at.values) - 1 if isinstance(at, ast.BoolOp) else 1 + len(at.ifs) if isinstance(at, ast.comprehension) else 0
        rest += ast.iter_child_nodes(at)
    return count


def _python_depth(node: ast.AST) -> int:
    nested = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.Try, ast.With, ast.AsyncWith, ast.ClassDef)
    deepest, rest = 1, [(node, 1)]
    while rest:
        at, level = rest.pop()
        level += isinstance(at, nested)
        deepest = max(deepest, level)
        # ``elif`` is a part of the statement that it goes on with.
        for c in ast.iter_child_nodes(at):
            follows = isinstance(at, ast.If) and isinstance(c, ast.If) and at.orelse == [c] and c.col_offset == at.col_offset
            rest.append((c, level - 1 if follows else level))
    return deepest


def _may_be_fixture(x: dict) -> bool:
    return x["kind"] == "call" and x["name"] in HOOKS or x["kind"] in ("method", "constructor", "field") and (bool(x.get("marks")) or x["name"] in JUNIT3)


def nodes(files: DataFrame) -> DataFrame:
    """The syntax nodes of sources (file_id, language, source), each parsed once.

    Kinds are class, interface, enum, record, anonymous, method, constructor, field, function, call, new, array, the statements if,
    for, while, do, try, switch, with, synchronized, and comment. ``container`` is the begin of the class, or of the describe call, around a node, ``extends`` what that
    class extends. Texts and measures are given where a fixture may be.
    Null and blank sources, other languages, and sources beyond X.MAX_BYTES have no nodes.
    """

    kinds = {"long": pa.int64(), "string": pa.string(), "int": pa.int32(), "array<string>": pa.list_(pa.string())}
    columns = [(name, kinds[kind]) for name, kind in re.findall(r"(\w+) (long|string|int|array<string>)", SCHEMA)]

    def batch_of(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[name] for r in rows], kind) for name, kind in columns], [name for name, _ in columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # Rows go on by some thousands, or by some megabytes of text.
            rows: list[dict] = []
            size = 0
            for file_id, language, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                source = text.as_py()
                if not source or not source.strip() or len(source.encode()) > X.MAX_BYTES:
                    continue
                if language == "python":
                    found = _python_rows(source)
                elif language in ("java", "javascript", "typescript"):
                    found = Parser(source, language).rows(_may_be_fixture)
                else:
                    continue
                for x in found:
                    rows.append({"file_id": file_id, "language": language, **x})
                    size += len(x["text"] or "") + 100
                    if size > MOST:
                        yield batch_of(rows)
                        rows, size = [], 0
            if rows:
                yield batch_of(rows)

    return files.select(F.col("file_id").cast("long"), "language", "source").mapInArrow(run, SCHEMA)


#: Words that a grammar has no node of its own for.
KEYWORDS = frozenset(
    "abstract as assert async await case catch class const continue def default del do elif else enum except export extends final finally for from function global if implements import in"
    " instanceof interface is let new nonlocal of or and not private protected public raise return static switch synchronized throw throws transient try typeof var void volatile while with yield lambda".split()
)


def leaf_lines(files: DataFrame) -> DataFrame:
    """(file_id, point): lines of sources (file_id, language, source) with a name, a literal or an empty block.

    Comments, and lines of keywords and brackets alone, aren't among them; a string has all its lines. A Python source that
    can't be tokenised has the lines before its fault.
    """

    def brace(source: str, language: str) -> set[int]:
        p = Parser(source, language)
        out: set[int] = set()
        for i, t in enumerate(p.text):
            if t == TEXT or re.match(r"[\w$]", t) and t not in KEYWORDS:
                out |= set(range(p.line(p.at[i]), p.line(p.end_of(i) - 1) + 1))
            elif t == "{" and p.match[i] == i + 1:
                out |= set(range(p.line(p.at[i]), p.line(p.at[i + 1]) + 1))
            elif t in ("return", "continue", "break") and p.tok(i + 1) in (";", "}"):
                out.add(p.line(p.at[i]))
        return out

    def python(source: str) -> set[int]:
        out: set[int] = set()
        kinds = {tokenize.NUMBER, tokenize.STRING, getattr(tokenize, "FSTRING_MIDDLE", -1)}
        try:
            for t in tokenize.generate_tokens(io.StringIO(source).readline):
                if t.type in kinds or t.type == tokenize.NAME and t.string not in KEYWORDS or t.string == "...":
                    out |= set(range(t.start[0], t.end[0] + 1))
        except (SyntaxError, tokenize.TokenError):
            pass
        return out

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for file_id, language, source in zip(frame["file_id"], frame["language"], frame["source"], strict=True):
                if source and len(source.encode()) <= X.MAX_BYTES:
                    rows += [(file_id, k) for k in sorted(python(source) if language == "python" else brace(source, language))]
            yield pd.DataFrame(rows, columns=["file_id", "point"])

    return files.select(F.col("file_id").cast("long"), "language", "source").mapInPandas(run, "file_id long, point int")


def _table(values: dict[str, tuple], column, place: int):
    return F.try_element_at(F.create_map(*[F.lit(x) for k, v in values.items() for x in (k, v[place])]), column)


def fixtures(found: DataFrame) -> DataFrame:
    """Test fixtures among the nodes of ``found``: file_id, language, name, fixture_type, scope, framework, lines, metrics,
    parameters, container, raw_source.

    Of a method's annotations the first known one counts; @BeforeClass and @AfterClass are TestNG's. setUp and tearDown without
    annotations count in classes that extend a TestCase, fields with @Rule and @ClassRule are fixtures themselves. Of
    JavaScript calls of a hook's plain name count; of Python pytest decorators, then names of unittest and pytest methods.
    """
    first = lambda values: F.get(F.filter("marks", lambda m: m.isin(*values)), 0)
    java, script = F.col("language") == "java", F.col("language").isin("javascript", "typescript")
    marked = first(JAVA_MARKS)
    method, field = java & (F.col("kind") == "method"), java & (F.col("kind") == "field")
    old = method & (F.size("marks") == 0) & F.col("name").isin(*JUNIT3) & F.col("extends").contains("TestCase")
    call = script & (F.col("kind") == "call") & F.col("name").isin(*HOOKS)
    function = (F.col("language") == "python") & (F.col("kind") == "function")
    decorator = F.get(F.filter("marks", lambda m: m.rlike(r"pytest\w*\.fixture\b")), 0)
    scope = F.regexp_extract(decorator, r"scope\s*=\s*[\"'](\w+)[\"']", 1)
    kinds = [
        (method & marked.isNotNull(), *(_table(JAVA_MARKS, marked, k) for k in range(3))),
        (field & first(JAVA_FIELDS).isNotNull(), *(_table(JAVA_FIELDS, first(JAVA_FIELDS), k) for k in range(3))),
        (old, _table({k: (v,) for k, v in JUNIT3.items()}, F.col("name"), 0), F.lit("per_test"), F.lit("junit")),
        (call, *(_table(HOOKS, F.col("name"), k) for k in range(2)), F.lit(None).cast("string")),
        (function & decorator.isNotNull(), F.lit("pytest_decorator"), F.coalesce(_table({k: (v,) for k, v in PYTEST_SCOPES.items()}, scope, 0), F.lit("per_test")), F.lit("pytest")),
        (function & F.col("name").isin(*UNITTEST), F.lit("unittest_setup"), _table({k: (v,) for k, v in UNITTEST.items()}, F.col("name"), 0), F.lit("unittest")),
        (function & F.col("name").isin(*METHODS), F.lit("pytest_class_method"), _table({k: (v,) for k, v in METHODS.items()}, F.col("name"), 0), F.lit("pytest")),
    ]
    kind = F.lit(None)
    for condition, fixture_type, scope_of, framework in reversed(kinds):
        kind = F.when(condition, F.struct(fixture_type.alias("fixture_type"), scope_of.alias("scope"), framework.alias("framework"))).otherwise(kind)
    rows = found.withColumn("found", kind).filter("found is not null")
    name = F.when(script, F.concat(F.lit("<anonymous>_"), F.col("start_line") - 1)).otherwise(F.col("name"))
    return rows.select(
        "file_id", "language", name.alias("name"), "found.fixture_type", "found.scope", "found.framework", "start_line", "end_line",
        S.nonblank_lines("text").cast("int").alias("loc"), (F.coalesce("decisions", F.lit(0)) + 1).alias("cyclomatic_complexity"), F.col("depth").alias("max_nesting_depth"),
        F.col("made").alias("num_objects_instantiated"), S.occurrences("text", X.EXTERNAL).cast("int").alias("num_external_calls"), F.col("comments").alias("num_comment_lines"),
        F.size("parameters").alias("num_parameters"), "parameters", "container", F.col("text").alias("raw_source"),
    )


def with_teardown(found: DataFrame) -> DataFrame:
    """``found`` with has_teardown_pair: whether set-up code is undone by its kind, by yielding, by the name or the type of other
    code of its file, scope and container, or by a clean-up that it registers."""
    names = F.try_element_at(F.create_map(*[F.lit(x) for pair in NAME_PAIRS.items() for x in pair]), F.col("name"))
    types = F.try_element_at(F.create_map(*[F.lit(x) for pair in TYPE_PAIRS.items() for x in pair]), F.col("fixture_type"))
    by_name = F.col("fixture_type").isin("unittest_setup", "pytest_class_method")
    none = F.lit("")
    wanted = found.withColumn("want", F.when(by_name & names.isNotNull(), F.struct("fixture_type", names.alias("name"), none.alias("scope"), F.lit(-1).alias("container"))).when(
        types.isNotNull(), F.struct(types.alias("fixture_type"), none.alias("name"), F.col("scope"), F.coalesce("container", F.lit(-1)).alias("container"))))
    there = found.select(F.col("file_id").alias("there_file"), F.explode(F.array(
        F.struct("fixture_type", "name", none.alias("scope"), F.lit(-1).alias("container")),
        F.struct("fixture_type", none.alias("name"), "scope", F.coalesce("container", F.lit(-1)).alias("container")))).alias("there")).distinct()
    registered = F.lit(False)
    for kind, calls in X.CLEANUPS.items():
        own = (F.col("fixture_type") == "unittest_setup") & (F.col("name") == kind.removeprefix("unittest_"))
        for text in calls:
            registered = registered | (own & F.col("raw_source").contains(text))
    paired = F.col("fixture_type").isin(*ALWAYS_PAIRED) | ((F.col("fixture_type") == "pytest_decorator") & F.col("raw_source").contains("yield")) | registered
    # What the text tells is told before the join: the text itself goes along only if it is asked for.
    wanted = wanted.withColumn("told", paired)
    met = wanted.join(there, (F.col("file_id") == F.col("there_file")) & (F.col("want") == F.col("there")), "left")
    return met.select(*found.columns, (F.col("told") | F.col("there").isNotNull()).alias("has_teardown_pair"))


def rechecked(found: DataFrame) -> DataFrame:
    """``found`` (language, raw_source, ...) with ``outer_complexity``: the decisions of each source's first function plus one,
    without those of functions inside it, whether these have braces or not; null without a function, and for Python."""

    def outer(source: str | None, language: str) -> int | None:
        if not source or language not in ("java", "javascript", "typescript"):
            return None
        # A method alone is a member of a class.
        p = Parser(f"class X {{{source}}}" if language == "java" else source, language)
        inside = [k for k, x in enumerate(p.nodes) if x["kind"] in ("function", "method", "constructor")]
        return p._decisions(inside) + 1 if inside else None

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            values = [outer(s, v) for s, v in zip(frame["raw_source"], frame["language"], strict=True)]
            yield frame.assign(outer_complexity=pd.array(values, "Int32"))

    return found.mapInPandas(run, f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in found.schema)}, outer_complexity int")


#: Annotations of test methods, and what tests are called.
TEST_MARKS = ("Test", "ParameterizedTest", "RepeatedTest", "TestFactory", "TestTemplate")
TEST_CALLS = tuple(f"{name}{more}" for name in ("it", "test") for more in ("", ".only", ".skip", ".concurrent", ".each()"))


def test_counts(found: DataFrame) -> DataFrame:
    """(file_id, n_tests) of files with tests among the nodes ``found``: Python functions that begin with test_, annotated Java
    methods and those of a TestCase that begin with test, and calls of it and test."""
    old = (F.col("kind") == "method") & F.col("name").startswith("test") & F.col("extends").endswith("TestCase")
    java = (F.col("language") == "java") & (((F.col("kind") == "method") & F.arrays_overlap("marks", F.array(*map(F.lit, TEST_MARKS)))) | old)
    script = F.col("language").isin("javascript", "typescript") & (F.col("kind") == "call") & F.col("name").isin(*TEST_CALLS)
    python = (F.col("language") == "python") & (F.col("kind") == "function") & F.col("name").startswith("test_")
    return found.filter(java | script | python).groupBy("file_id").agg(F.count("*").alias("n_tests"))
