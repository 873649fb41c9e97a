"""Set-up and tear-down code, test doubles and metrics from source texts.

Python is parsed with ``ast``; Java, JavaScript and TypeScript by a scanner that blanks comments and strings and pairs
braces. A text that can't be parsed gives no rows.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.functions.scalars import needed_text
from quarryline.operators.graph import least_over_closure

#: Texts longer than this aren't looked at.
MAX_BYTES = 5 << 20
#: Bytes of texts in rows that go on at once, and rows without texts.
SENT_BYTES, SENT_ROWS = 2 << 20, 20_000

# Names and annotations that mark set-up and tear-down code.
UNITTEST = {"setUp": "test", "tearDown": "test", "setUpClass": "class", "tearDownClass": "class", "setUpModule": "module", "tearDownModule": "module", "asyncSetUp": "test", "asyncTearDown": "test"}
XUNIT = {"setup_method": "test", "teardown_method": "test", "setup_class": "class", "teardown_class": "class", "setup_module": "module", "teardown_module": "module", "setup_function": "test", "teardown_function": "test"}
JAVA = {"Before": "test", "After": "test", "BeforeEach": "test", "AfterEach": "test", "BeforeClass": "class", "AfterClass": "class", "BeforeAll": "class", "AfterAll": "class", "BeforeMethod": "test", "AfterMethod": "test", "BeforeSuite": "global", "AfterSuite": "global", "BeforeTest": "global", "AfterTest": "global"}
HOOKS = {"beforeEach": "test", "afterEach": "test", "beforeAll": "class", "afterAll": "class", "before": "class", "after": "class"}
PYTEST_SCOPES = {"function": "test", "class": "class", "module": "module", "package": "module", "session": "global"}
SCOPE_LEVEL = {"test": 0, "class": 1, "module": 2, "global": 3}


@dataclass
class Fixture:
    name: str
    fixture_type: str
    scope: str
    start_line: int
    end_line: int
    loc: int
    cyclomatic_complexity: int = 1
    max_nesting_depth: int = 1
    num_objects_instantiated: int = 0
    num_external_calls: int = 0
    num_comment_lines: int = 0
    num_parameters: int = 0
    framework: str = ""
    container: str = ""
    parameters: list[str] = field(default_factory=list)
    raw_source: str = ""


SCHEMA = (
    "file_id long, language string, name string, fixture_type string, scope string, start_line int, end_line int, loc int, cyclomatic_complexity int, max_nesting_depth int, num_objects_instantiated int,"
    " num_external_calls int, num_comment_lines int, num_parameters int, framework string, container string, parameters array<string>, raw_source string"
)

#: What calls to the outside look like, in lower case.
EXTERNAL = (
    r"\bopen\s*\(",
    r"\bconnect\s*\(",
    r"\bcreate_engine\s*\(",
    r"\bsession\s*\.",
    r"\brequests?\.",
    r"\bhttpclient\b",
    r"\bos\.environ\b",
    r"\bsubprocess\.",
    r"\bsocket\s*\(",
    r"\btempfile\.",
    r"\bshutil\.",
)


def external_calls(source: str) -> int:
    return sum(len(re.findall(p, source.lower())) for p in EXTERNAL)


_BRANCHES = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.IfExp, ast.Assert, ast.comprehension)
_BLOCKS = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.Try, ast.With, ast.AsyncWith, ast.FunctionDef, ast.AsyncFunctionDef, ast.Match)


def _depth(node: ast.AST) -> int:
    """How deep blocks are nested, without recursion: chained operators may be thousands deep."""
    deepest, rest = 0, [(node, 0)]
    while rest:
        at, level = rest.pop()
        level += isinstance(at, _BLOCKS)
        deepest = max(deepest, level)
        rest += [(c, level) for c in ast.iter_child_nodes(at)]
    return deepest


def _dotted(node: ast.AST) -> str:
    """The name of an attribute chain, empty for anything else."""
    parts = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    return ".".join(reversed([*parts, node.id])) if isinstance(node, ast.Name) else ""


def python_fixtures(source: str) -> Iterator[Fixture]:
    """Decorated pytest functions, then unittest and xunit names; a decorator wins over a name."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return
    lines = source.split("\n")

    def visit() -> Iterator[Fixture]:
        rest: list[tuple[ast.AST, str]] = [(tree, "")]
        while rest:
            node, container = rest.pop()
            if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef) and (found := judge(node, container)):
                yield found
            inner = f"{container}.{node.name}".strip(".") if isinstance(node, ast.ClassDef) else container
            # In the order of the source.
            rest += [(c, inner) for c in reversed(list(ast.iter_child_nodes(node)))]

    def judge(f: ast.FunctionDef | ast.AsyncFunctionDef, container: str) -> Fixture | None:
        kind = scope = framework = ""
        for d in f.decorator_list:
            call = d.func if isinstance(d, ast.Call) else d
            if _dotted(call) in ("pytest.fixture", "fixture", "pytest_asyncio.fixture"):
                kind, framework, scope = "pytest_decorator", "pytest", "test"
                for k in d.keywords if isinstance(d, ast.Call) else []:
                    if k.arg == "scope" and isinstance(k.value, ast.Constant):
                        scope = PYTEST_SCOPES.get(k.value.value, "test")
        if not kind and f.name in UNITTEST:
            kind, scope, framework = f"unittest_{f.name}", UNITTEST[f.name], "unittest"
        if not kind and f.name in XUNIT:
            kind, scope, framework = f"pytest_{f.name}", XUNIT[f.name], "pytest"
        if not kind:
            return None
        first = min([f.lineno, *(d.lineno for d in f.decorator_list)])
        text = "\n".join(lines[first - 1 : f.end_lineno])
        body = list(ast.walk(f))
        names = [a.arg for a in [*f.args.posonlyargs, *f.args.args, *f.args.kwonlyargs] if a.arg not in ("self", "cls")]
        made = sum(isinstance(n, ast.Call) and (n.func.id if isinstance(n.func, ast.Name) else n.func.attr if isinstance(n.func, ast.Attribute) else "")[:1].isupper() for n in body)
        return Fixture(
            f.name, kind, scope, first, f.end_lineno or first, sum(bool(x.strip()) for x in text.split("\n")),
            1 + sum(isinstance(n, _BRANCHES) for n in body) + sum(len(n.values) - 1 for n in body if isinstance(n, ast.BoolOp)),
            max(1, _depth(f)), made, external_calls(text), sum(x.strip().startswith("#") for x in text.split("\n")), len(names), framework, container, names, text,
        )

    yield from visit()


#: What a slash may follow if it begins a regular expression.
_BEFORE_REGEX = re.compile(r"(?:^|[=(,:;!&|?{}\[+\-*%~^<>]|\b(?:return|typeof|case|in|of|delete|void|throw|new|do|else))\s*$")
_QUOTED = {'"': re.compile(r'"(?:\\.|[^"\\\n])*"?', re.S), "'": re.compile(r"'(?:\\.|[^'\\\n])*'?", re.S)}
_REGEX = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*")
_TEMPLATE = re.compile(r"(?:\\.|\$(?!\{)|[^`\\$])*", re.S)
_BLOCK_TEXT = re.compile(r'"""(?:\\.|[^\\])*?"""', re.S)
_MARK = re.compile(r"//|/\*|/|[\"'`{}]")


def blanked(source: str, seen: list[tuple[bool, int, int]] | None = None) -> str:
    """A source of the brace languages with comments, strings and regular expressions in spaces, of the same length and lines.

    Code inside a template string's ``${}`` stays, however deep template strings are nested in it. ``seen`` gets whether each
    blanked part is a comment, and its begin and end.
    """
    out: list[str] = []
    at, opened = 0, []  # opened: for each brace whether it's a template string's

    def blank(end: int) -> None:
        nonlocal at
        if seen is not None:
            seen.append((source.startswith(("//", "/*"), at), at, end))
        out.append("\n".join([" " * len(x) for x in source[at:end].split("\n")]))
        at = end

    def template() -> None:
        """From inside a template string to its end or its next code."""
        end = _TEMPLATE.match(source, at).end()
        if source.startswith("${", end):
            opened.append(True)
            blank(end + 2)
        else:
            blank(min(end + 1, len(source)))

    while at < len(source):
        m = _MARK.search(source, at)
        if not m:
            break
        out.append(source[at : m.start()])
        at, mark = m.start(), m.group()
        if mark == "//":
            end = source.find("\n", at)
            blank(len(source) if end < 0 else end)
        elif mark == "/*":
            end = source.find("*/", at + 2)
            blank(len(source) if end < 0 else end + 2)
        elif mark == "/":
            found = _REGEX.match(source, at) if _BEFORE_REGEX.search("".join(out[-3:])[-40:]) else None
            if found:
                blank(found.end())
            else:
                out.append("/")
                at += 1
        elif mark == '"' and (found := _BLOCK_TEXT.match(source, at)):
            blank(found.end())
        elif mark in _QUOTED:
            blank(_QUOTED[mark].match(source, at).end())
        elif mark == "`":
            blank(at + 1)
            template()
        elif mark == "{":
            opened.append(False)
            out.append("{")
            at += 1
        elif opened and opened.pop():
            blank(at + 1)
            template()
        else:
            out.append("}")
            at += 1
    out.append(source[at:])
    return "".join(out)


def blanked_comments(source: str) -> str:
    """A source of the brace languages without its comments; strings stay, also those that look like comments."""
    code, out, at = blanked(source), list(source), 0
    while at < len(source):
        end = -1
        if code[at] == " " and source.startswith("//", at) and source[at - 1 : at] != ":":
            end = source.find("\n", at)
            end = len(source) if end < 0 else end
        elif code[at] == " " and source.startswith("/*", at):
            end = source.find("*/", at + 2)
            end = len(source) if end < 0 else end + 2
        if end > 0 and not code[at:end].strip():
            for k in range(at, end):
                if source[k] != "\n":
                    out[k] = " "
            at = end
        elif code[at] == " " and source[at] in "\"'`":
            # Past the string: its blanks end where the code does again.
            quote, at = source[at], at + 1
            while at < len(source) and source[at] != quote and code[at] in " \n":
                at += 2 if source[at] == "\\" else 1
            at += 1
        else:
            at += 1
    return "".join(out)


def block_end(code: str, begin: int) -> int:
    """The place behind the block that opens at or after ``begin``, or the statement's end if none opens before it."""
    level = 0
    for m in re.compile(r"[{};]").finditer(code, begin):
        if m.group() == "{":
            level += 1
        elif m.group() == "}":
            level -= 1
            if level <= 0:
                return m.end()
        elif not level:
            return m.end()
    return len(code)


_DECISIONS = re.compile(r"\b(?:if|for|while|case|catch)\b|&&|\|\||\?(?![.?:])")


def brace_metrics(source: str, code: str, begin: int, end: int) -> dict:
    part, raw = code[begin:end], source[begin:end]
    level = deepest = 0
    for c in part:
        level += (c == "{") - (c == "}")
        deepest = max(deepest, level)
    return {
        "start_line": source.count("\n", 0, begin) + 1,
        "end_line": source.count("\n", 0, end) + 1,
        "loc": sum(bool(x.strip()) for x in raw.split("\n")),
        "cyclomatic_complexity": 1 + len(_DECISIONS.findall(part)),
        "max_nesting_depth": max(1, deepest),
        "num_objects_instantiated": len(re.findall(r"\bnew\s+[A-Za-z_]", part)),
        "num_external_calls": external_calls(raw),
        "num_comment_lines": sum(x.strip().startswith(("//", "/*", "*")) for x in raw.split("\n")),
        "raw_source": raw,
    }


def java_fixtures(source: str) -> Iterator[Fixture]:
    """Annotated methods, and setUp and tearDown of JUnit 3 classes."""
    code = blanked(source)
    classes = [(m.start(), block_end(code, m.end()), m.group(1), m.group(2) or "") for m in re.finditer(r"\bclass\s+(\w+)(?:\s+extends\s+(\w+))?", code)]
    framework = "testng" if re.search(r"import\s+org\.testng", source) else "junit"
    taken = set()
    methods = [(m, JAVA[m.group(1)], m.group(1), m.group(2), m.group(3)) for m in re.finditer(r"@(\w+)\b(?:\([^)]*\))?\s*(?:@\w+(?:\([^)]*\))?\s*)*(?:[\w<>\[\]]+\s+)+(\w+)\s*\(([^)]*)\)", code) if m.group(1) in JAVA]
    old = [(m, UNITTEST[m.group(1)], f"junit3_{m.group(1)}", m.group(1), m.group(2)) for m in re.finditer(r"(?:public|protected)\s+void\s+(setUp|tearDown)\s*\(([^)]*)\)", code)]
    for m, scope, kind, name, parameters in [*methods, *old]:
        around = [c for c in classes if c[0] <= m.start() < c[1]]
        if kind.startswith("junit3") and not (around and around[-1][3].endswith("TestCase")) or (name, around[-1][2] if around else "") in taken:
            continue
        taken.add((name, around[-1][2] if around else ""))
        end = block_end(code, m.end())
        yield Fixture(
            name=name, fixture_type=kind, scope=scope, framework=framework if not kind.startswith("junit3") else "junit", container=".".join(c[2] for c in around),
            num_parameters=len([p for p in parameters.split(",") if p.strip()]), **brace_metrics(source, code, m.start(), end),
        )


def javascript_fixtures(source: str) -> Iterator[Fixture]:
    """Hook calls with the describe blocks around them."""
    code = blanked(source)
    suites = []
    for m in re.finditer(r"\bdescribe(?:\.\w+)?\s*\(", code):
        label = re.match(r"\s*['\"`](.*?)['\"`]", source[m.end() :])
        suites.append((m.start(), block_end(code, m.end()), label.group(1) if label else ""))
    jest = re.search(r"\bjest\b|\bvitest\b", source)
    for m in re.finditer(r"(?<![\w.$])(beforeEach|afterEach|beforeAll|afterAll|before|after)\s*\(", code):
        around = [s for s in suites if s[0] <= m.start() < s[1]]
        end = block_end(code, m.end())
        parameters = re.match(r"\s*(?:async\s*)?(?:function\s*\w*\s*)?\(([^)]*)\)", code[m.end() :])
        names = [p.strip() for p in parameters.group(1).split(",") if p.strip()] if parameters else []
        framework = "jest" if jest else "mocha" if m.group(1) in ("before", "after") else "unknown"
        yield Fixture(
            name=m.group(1), fixture_type=f"hook_{m.group(1)}", scope=HOOKS[m.group(1)], framework=framework, container=" > ".join(s[2] for s in around), num_parameters=len(names), parameters=names,
            **brace_metrics(source, code, m.start(), end),
        )


_INNER = re.compile(r"\bfunction\b[^({]*\([^()]*\)\s*\{|=>\s*\{")


def outer_complexity(raw: str, language: str) -> int | None:
    """The decision points of a hook's own function plus one, without those of functions inside it; null without a function."""
    if language not in ("javascript", "typescript"):
        return None
    code = blanked(raw or "")
    first = _INNER.search(code)
    if not first:
        return None
    end = block_end(code, first.end() - 1)
    own, at = [], first.end()
    while m := _INNER.search(code, at, end):
        own.append(code[at : m.start()])
        at = block_end(code, m.end() - 1)
    own.append(code[at:end])
    return 1 + sum(len(_DECISIONS.findall(part)) for part in own)


def rechecked(found: DataFrame) -> DataFrame:
    """``found`` (language, raw_source, ...) with the complexity of each hook's own function as outer_complexity."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            values = [outer_complexity(s, v) for s, v in zip(frame["raw_source"], frame["language"], strict=True)]
            yield frame.assign(outer_complexity=pd.array(values, "Int32"))

    return found.mapInPandas(run, f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in found.schema)}, outer_complexity int")


def test_functions(source: str, language: str) -> int:
    """How many tests a source has: functions called test, annotated methods, or calls of it and test."""
    if language == "python":
        try:
            tree = ast.parse(source)
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            return 0
        return sum(isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef) and n.name.startswith("test_") for n in ast.walk(tree))
    code = blanked(source)
    if language == "java":
        annotated = re.findall(r"@(?:Test|ParameterizedTest|RepeatedTest|TestFactory|TestTemplate)\b[^;{}]*?\b(\w+)\s*\([^)]*\)\s*(?:throws[^{]*)?\{", code)
        old = re.findall(r"\bpublic\s+void\s+(test\w*)\s*\(\s*\)", code) if re.search(r"\bextends\s+\w*TestCase\b", code) else []
        return len(annotated) + len([n for n in old if n not in annotated])
    return len(re.findall(r"(?<![\w.$])(?:it|test)(?:\.(?:only|skip|each|concurrent))?\s*\(", code)) if language in ("javascript", "typescript") else 0


#: Detectors by language; others can be added.
DETECTORS = {"python": python_fixtures, "java": java_fixtures, "javascript": javascript_fixtures, "typescript": javascript_fixtures}


def fixtures(files: DataFrame, detectors: dict | None = None) -> DataFrame:
    """One row for each fixture in ``files`` (file_id, language, source)."""
    known = detectors or DETECTORS

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in re.split(r", (?=\w+ \w)", SCHEMA)]
        for frame in frames:
            rows, size = [], 0
            for file_id, language, source in zip(frame["file_id"], frame["language"], frame["source"], strict=True):
                if source and source.strip() and len(source.encode()) <= MAX_BYTES and language in known:
                    for x in known[language](source):
                        rows.append({"file_id": file_id, "language": language, **asdict(x)})
                        size += len(x.raw_source) + 100
                        if size >= SENT_BYTES:
                            yield pd.DataFrame(rows, columns=names)
                            rows, size = [], 0
            yield pd.DataFrame(rows, columns=names)

    return files.select(F.col("file_id").cast("long"), "language", "source").mapInPandas(run, SCHEMA)


def with_scopes(found: DataFrame) -> DataFrame:
    """pytest fixtures depend on those of the same file that their parameters name, and live no longer than these."""
    keyed = found.withColumn("__key", F.concat_ws("#", F.col("file_id").cast("string"), "name"))
    level = F.element_at(F.create_map(*[F.lit(x) for pair in SCOPE_LEVEL.items() for x in pair]), F.col("scope"))
    own = keyed.filter("fixture_type = 'pytest_decorator'").withColumn("__level", level)
    wanted = own.select("__key", "file_id", F.explode("parameters").alias("name"))
    edges = wanted.join(own.select("file_id", "name", F.col("__key").alias("__on")), ["file_id", "name"]).select("__key", "__on")
    effective = least_over_closure(own.groupBy("__key").agg(F.min("__level").alias("__level")), edges, "__key", "__level", "__key", "__on")
    names = F.element_at(F.create_map(*[F.lit(x) for k, v in SCOPE_LEVEL.items() for x in (v, k)]), F.col("effective"))
    return keyed.join(effective.select("__key", names.alias("__scope")), "__key", "left").withColumn("scope", F.coalesce("__scope", "scope")).drop("__key", "__scope")


#: Set-up types and the tear-down types that undo them.
PAIRS = {
    "unittest_setUp": "unittest_tearDown", "unittest_setUpClass": "unittest_tearDownClass", "unittest_setUpModule": "unittest_tearDownModule", "pytest_setup_method": "pytest_teardown_method",
    "pytest_setup_class": "pytest_teardown_class", "pytest_setup_module": "pytest_teardown_module", "pytest_setup_function": "pytest_teardown_function", "Before": "After", "BeforeEach": "AfterEach",
    "BeforeClass": "AfterClass", "BeforeAll": "AfterAll", "BeforeMethod": "AfterMethod", "BeforeSuite": "AfterSuite", "BeforeTest": "AfterTest", "junit3_setUp": "junit3_tearDown",
    "hook_beforeEach": "hook_afterEach", "hook_beforeAll": "hook_afterAll", "hook_before": "hook_after",
}


#: Calls by which set-up code registers its own tear-down.
CLEANUPS = {"unittest_setUp": ("addCleanup(", "enterContext("), "unittest_setUpClass": ("addClassCleanup(", "enterClassContext(")}


def with_teardown(found: DataFrame) -> DataFrame:
    """Whether set-up code has tear-down code of its type, scope and container in its file, yields to it, or registers it."""
    down = found.select("file_id", F.col("fixture_type").alias("__want"), F.col("scope").alias("__s"), F.col("container").alias("__c")).distinct().withColumn("__hit", F.lit(True))
    marked = found.withColumn("__want", F.try_element_at(F.create_map(*[F.lit(x) for pair in PAIRS.items() for x in pair]), F.col("fixture_type")))
    met = marked.join(down, [marked["file_id"] == down["file_id"], marked["__want"] == down["__want"], marked["scope"] == down["__s"], marked["container"] == down["__c"]], "left")
    yields = (F.col("fixture_type") == "pytest_decorator") & F.col("raw_source").rlike(r"(?m)^\s*yield\b|addfinalizer")
    for kind, calls in CLEANUPS.items():
        yields = yields | ((F.col("fixture_type") == kind) & F.col("raw_source").rlike("|".join(map(re.escape, calls))))
    return met.select(*(marked[c] for c in found.columns), (F.col("__hit").isNotNull() | yields).alias("has_teardown_pair"))


#: Frameworks and patterns of test doubles; the first group, if there is one, is the target.
MOCKS = (
    ("unittest_mock", r"mock\.patch\s*\(\s*['\"]([^'\"]+)['\"]"),
    ("unittest_mock", r"mock\.patch\.object\s*\(\s*(\w+)"),
    ("unittest_mock", r"create_autospec\s*\(\s*(\w+)"),
    ("pytest_mock", r"mocker\.patch\s*\(\s*['\"]([^'\"]+)['\"]"),
    ("pytest_mock", r"mocker\.patch\.object\s*\(\s*(\w+)"),
    ("unittest_mock", r"(?<!mock\.)(?<!mocker\.)\bpatch\s*\(\s*['\"]([^'\"]+)['\"]"),
    ("unittest_mock", r"(?<!mock\.)(?<!mocker\.)\bpatch\.object\s*\(\s*(\w+)"),
    ("unittest_mock", r"MagicMock\s*\(|\bMock\s*\(|AsyncMock\s*\("),
    ("pytest_monkeypatch", r"monkeypatch\.(setattr|delattr|setenv|delenv|setitem|delitem)\s*\("),
    ("mockito", r"Mockito\.mock\s*\(\s*(\w+)\.class"),
    ("mockito", r"@Mock\b"),
    ("mockito", r"Mockito\.spy\s*\(\s*(\w+)"),
    ("easymock", r"EasyMock\.createMock\s*\(\s*(\w+)\.class"),
    ("mockito", r"(?<!\.)\bmock\s*\(\s*(\w+)\.class"),
    ("jest", r"jest\.fn\s*\("),
    ("jest", r"jest\.spyOn\s*\("),
    ("jest", r"jest\.mock\s*\(\s*['\"]([^'\"]+)['\"]"),
    ("jest", r"jest\.mocked\s*\(\s*(\w+)"),
    ("jest", r"jest\.createMockFromModule\s*\(\s*['\"]([^'\"]+)['\"]"),
    ("sinon", r"sinon\.stub\s*\("),
    ("sinon", r"sinon\.spy\s*\("),
    ("sinon", r"sinon\.mock\s*\("),
    ("sinon", r"sinon\.fake\s*\("),
    ("sinon", r"sinon\.replace\s*\("),
    ("sinon", r"sinon\.createStubInstance\s*\(\s*(\w+)"),
    ("vitest", r"vi\.fn\s*\("),
    ("vitest", r"vi\.mock\s*\(\s*['\"]([^'\"]+)['\"]"),
)
#: Kinds of test doubles by keyword, in order; what is set up on one; characters around a use that are kept.
MOCK_CATEGORIES = (("dummy", ("dummy", "dummies")), ("stub", ("stub",)), ("spy", ("spy", "spies")), ("fake", ("fake",)), ("mock", ("mock",)))
INTERACTIONS = re.compile(r"return_value|side_effect|thenReturn|thenThrow|doReturn")
BEFORE, AFTER, REACH = 20, 60, 200
MOCK_SCHEMA = "file_id long, framework string, category string, target string, interactions int, snippet string, at int"


def mock_category(text: str) -> str:
    low = text.lower()
    return next((name for name, words in MOCK_CATEGORIES if any(w in low for w in words)), "mock")


class Rules:
    """Many patterns over one text: one pass of an automaton tells whose needed texts are there, and only these are run.

    The cost follows the text and what it has, not the number of rules; a rule without a needed text is always run.
    """

    def __init__(self, rules: Sequence[tuple[str, str]]) -> None:
        import ahocorasick

        self.rules = [(label, re.compile(pattern)) for label, pattern in rules]
        needs: dict[str, list[int]] = {}
        for k, (_, pattern) in enumerate(rules):
            needs.setdefault(needed_text(pattern), []).append(k)
        self.always = needs.pop("", [])
        self.automaton = ahocorasick.Automaton() if needs else None
        for text, numbers in needs.items():
            self.automaton.add_word(text, numbers)
        if needs:
            self.automaton.make_automaton()

    def matches(self, text: str) -> Iterator[tuple[str, re.Match]]:
        """(label, match) of all matches, by rule and then by place."""
        worth = set(self.always)
        if self.automaton is not None and text:
            for _, numbers in self.automaton.iter(text):
                worth.update(numbers)
        for k in sorted(worth):
            label, pattern = self.rules[k]
            for m in pattern.finditer(text):
                yield label, m


def mocks(files: DataFrame, rules: Sequence[tuple[str, str]] = MOCKS) -> DataFrame:
    """One row for each use of a test double in ``files`` (file_id, source), with what stands around it.

    ``rules`` are (framework, pattern); stores.load_rules reads others from a rule table. The category is that of the whole source.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        compiled, names = Rules(rules), [x.split()[0] for x in MOCK_SCHEMA.split(", ")]
        for frame in frames:
            rows = []
            for file_id, source in zip(frame["file_id"], frame["source"], strict=True):
                category = mock_category(source or "")
                for framework, m in compiled.matches(source or ""):
                    snippet = source[max(0, m.start() - BEFORE) : m.end() + AFTER].replace("\n", " ")
                    target = m.group(1) or "" if m.re.groups else ""
                    rows.append((file_id, framework, category, target, len(INTERACTIONS.findall(source, m.start(), m.end() + REACH)), snippet, m.start()))
                    if len(rows) >= SENT_ROWS:
                        yield pd.DataFrame(rows, columns=names)
                        rows = []
            yield pd.DataFrame(rows, columns=names)

    return files.select(F.col("file_id").cast("long"), "source").mapInPandas(run, MOCK_SCHEMA)


def mock_counts(column: str, rules: Sequence[tuple[str, str]] = MOCKS) -> Column:
    """How many uses of test doubles mocks() finds in each text, without a row for each."""

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        compiled = Rules(rules)
        for part in parts:
            yield pd.Series([sum(1 for _ in compiled.matches(source or "")) for source in part], dtype="int64")

    return F.pandas_udf(run, "long")(F.col(column))


def pure_additions(files: DataFrame) -> DataFrame:
    """Whether each changed file (commit, path, change_type, deleted_lines) only adds: it isn't renamed or removed, and loses no line."""
    change = F.lower(F.coalesce("change_type", F.lit("")))
    return files.withColumn("pure", ~change.isin("delete", "rename", "deleted", "renamed") & (F.coalesce("deleted_lines", F.lit(0)) == 0))


def pure_commits(files: DataFrame, is_test: Column) -> DataFrame:
    """Whether all test files of each commit only add; true if there is none."""
    pure = F.every(F.when(is_test, F.col("pure")))
    return pure_additions(files).groupBy("commit").agg(F.coalesce(pure, F.lit(True)).alias("pure"), F.count_if(is_test).alias("n_test_files"))


def added_lines(diffs: DataFrame) -> DataFrame:
    """(commit, path, line) of lines that unified diffs (commit, diff) add, by their new numbers."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for commit, diff in zip(frame["commit"], frame["diff"], strict=True):
                # A hunk says how many old and new lines it has; only outside of hunks a line names a file.
                path, line, old, new = None, 0, 0, 0
                for text in (diff or "").split("\n"):
                    if m := None if old > 0 or new > 0 else re.match(r"@@ -\d+(?:,(\d+))? \+(\d+)(?:,(\d+))?", text):
                        line, old, new = int(m.group(2)), int(m.group(1) or 1), int(m.group(3) or 1)
                    elif old <= 0 and new <= 0:
                        if text.startswith("+++ "):
                            path = text[4:].removeprefix("b/").strip()
                    elif text.startswith("+"):
                        if path:
                            rows.append((commit, path, line))
                            if len(rows) >= SENT_ROWS:
                                yield pd.DataFrame(rows, columns=["commit", "path", "line"])
                                rows = []
                        line, new = line + 1, new - 1
                    elif text.startswith("-"):
                        old -= 1
                    elif not text.startswith("\\"):
                        line, old, new = line + 1, old - 1, new - 1
            yield pd.DataFrame(rows, columns=["commit", "path", "line"])

    return diffs.select("commit", "diff").mapInPandas(run, "commit string, path string, line int")
