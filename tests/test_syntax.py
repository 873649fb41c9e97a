"""Fixtures of odd sources against rows made by hand."""

import pytest

from quarryline.operators import syntax

# language, source, [(fixture_type, first line, last line, complexity, depth, instantiations, comment lines, parameters, has tear-down)]
JAVA = [
    ("plain", "class A {\n  @Before\n  public void init() { x = new Foo(); }\n  @After public void done() {}\n}", [("junit4_before", 2, 3, 1, 1, 1, 0, 0, True), ("junit4_after", 4, 4, 1, 1, 0, 0, 0, False)]),
    ("arguments and generics", 'class A<T extends B> {\n  @BeforeMethod(alwaysRun = true, groups = {"a", "}"})\n  protected <K, V> Map<K, List<V>> make(@Named("x(") Map<K, V> m, int... n) throws E {\n    if (a && b) return null;\n    return m;\n  }\n}', [("testng_before_method", 2, 6, 3, 2, 0, 0, 2, False)]),
    ("annotations inside types", "class A {\n  @BeforeEach List<@NonNull String> up(final @Q Map<String, @After Foo> x) { return null; }\n}", [("junit5_before_each", 2, 2, 1, 1, 0, 0, 1, False)]),
    ("rule fields", "class A {\n  @Rule public TemporaryFolder f = new TemporaryFolder();\n  @ClassRule\n  public static Rule r = new Rule() { @Override public void before() { if (x) y(); } };\n  int z;\n}", [("junit_rule", 2, 2, 1, 1, 1, 0, 0, True), ("junit_class_rule", 3, 4, 2, 2, 1, 0, 0, True)]),
    ("anonymous class", "class A {\n  @Before void a() {\n    run(new Runnable() {\n      @Override public void run() { for (;;) { new B(); } }\n    });\n  }\n}", [("junit4_before", 2, 6, 1, 2, 2, 0, 0, False)]),
    ("before in anonymous class", "class A {\n  Object o = new Base() {\n    @Before void inner() {}\n    @After void outer() {}\n  };\n}", [("junit4_before", 3, 3, 1, 1, 0, 0, 0, True), ("junit4_after", 4, 4, 1, 1, 0, 0, 0, False)]),
    ("nested classes don't pair", "class A {\n  @Before void a() {}\n  @Nested class B { @After void b() {} }\n}", [("junit4_before", 2, 2, 1, 1, 0, 0, 0, False), ("junit4_after", 3, 3, 1, 1, 0, 0, 0, False)]),
    ("class hooks are TestNG's", "import org.junit.*;\nclass A {\n  @BeforeClass public static void a() {}\n  @AfterClass public static void b() {}\n}", [("testng_before_class", 3, 3, 1, 1, 0, 0, 0, True), ("testng_after_class", 4, 4, 1, 1, 0, 0, 0, False)]),
    ("test case", "public class A extends junit.framework.TestCase {\n  protected void setUp() throws Exception { super.setUp(); }\n  public void tearDown() {}\n  @Override protected void other() {}\n}", [("junit3_setup", 2, 2, 1, 1, 0, 0, 0, True), ("junit3_teardown", 3, 3, 1, 1, 0, 0, 0, False)]),
    ("no test case", "class A extends Base { void setUp() {} }\nclass B { void tearDown() {} }", []),
    ("annotated setUp is not JUnit 3's", "class A extends TestCase { @Override void setUp() {} }", []),
    ("qualified marks don't count", "class A { @org.junit.Before void a() {} @Before() void b() {} }", [("junit4_before", 1, 1, 1, 1, 0, 0, 0, False)]),
    ("first known mark", "class A { @Deprecated @Before @After void a() {} }", [("junit4_before", 1, 1, 1, 1, 0, 0, 0, False)]),
    ("in comments and strings", 'class A {\n  // @Before void no() {}\n  /* @After void no() {} */\n  String s = "@Before void no() {}";\n  String t = """\n    @Before void no() { "quoted" }\n    """;\n}', []),
    ("comment lines", "class A {\n  @Before\n  // one\n  void a() {\n    /* two\n       three */\n    x(\"// no\");\n  }\n}", [("junit4_before", 2, 8, 1, 1, 0, 3, 0, False)]),
    ("interface and enum", "interface I { @BeforeEach default void a() {} @AfterEach void b(); }\nenum E { X { @Before void c() {} }, Y(1); @Before void d() {} }", [("junit5_before_each", 1, 1, 1, 1, 0, 0, 0, True), ("junit5_after_each", 1, 1, 1, 1, 0, 0, 0, False), ("junit4_before", 2, 2, 1, 1, 0, 0, 0, False), ("junit4_before", 2, 2, 1, 1, 0, 0, 0, False)]),
    ("record", "record P(int x, int y) { @BeforeAll static void a() {} }", [("junit5_before_all", 1, 1, 1, 1, 0, 0, 0, False)]),
    ("lambda", "class A {\n  @Before void a() {\n    list.forEach(x -> { if (x > 0 || y) z(); });\n    f = () -> b ? c : d;\n  }\n}", [("junit4_before", 2, 5, 4, 2, 0, 0, 0, False)]),
    ("nested statements", "class A {\n  @Before void a() {\n    for (int i = 0; i < n; i++)\n      while (b)\n        if (c) d(); else if (e) f();\n    do { g(); } while (h);\n    try { i(); } catch (E | F x) { j(); } finally { k(); }\n  }\n}", [("junit4_before", 2, 8, 7, 5, 0, 0, 0, False)]),
    ("switch", "class A {\n  @Before void a() {\n    switch (x) { case 1: b(); break; case 2: c(); default: d(); }\n    int y = switch (z) { case A -> 1; default -> { yield 2; } };\n  }\n}", [("junit4_before", 2, 5, 4, 1, 0, 0, 0, False)]),
    ("characters", "class A {\n  char a = '{', b = '\\'', c = '\"';\n  @Before void x() { y('}'); }\n}", [("junit4_before", 3, 3, 1, 1, 0, 0, 0, False)]),
    ("constructor isn't a method", "class A { @Before A() {} @Before <T> A(T t) {} }", []),
    ("arrays", "class A { @Before int[] a(int[] x, String[]... y) { return new int[] {1, 2}; } @DataProvider(name = \"d\") Object[][] d() { return new Object[][] {{new A()}}; } }", [("junit4_before", 1, 1, 1, 1, 0, 0, 2, False), ("testng_data_provider", 1, 1, 1, 1, 1, 0, 0, False)]),
    ("local class", "class A { @Before void a() { class L { void m() { if (x) y(); } } new L().m(); } }", [("junit4_before", 1, 1, 1, 2, 1, 0, 0, False)]),
    ("unclosed", "class A {\n  @Before void a() { if (x) { y(); }\n  @After void b() {}\n", None),
    ("stray closer", "class A { } }\nclass B {\n  @Before void a() {}\n}", [("junit4_before", 3, 3, 1, 1, 0, 0, 0, False)]),
    ("annotation type", "@interface Q { int value() default 1; }\n@Q(2) class A { @Q @Before void a() {} }", [("junit4_before", 2, 2, 1, 1, 0, 0, 0, False)]),
    ("initialisers", "class A { static { x(); } { y(); } @Before void a() {} }", [("junit4_before", 1, 1, 1, 1, 0, 0, 0, False)]),
    ("wildcards are no decisions", "class A { @Before void a(List<? extends B> x, Map<?, ?> y) { Class<?> c = z ? p : q; } }", [("junit4_before", 1, 1, 2, 1, 0, 0, 2, False)]),
    ("abstract", "abstract class A { @Before abstract void a(int x); @After public void b() {} }", [("junit4_before", 1, 1, 1, 1, 0, 0, 1, True), ("junit4_after", 1, 1, 1, 1, 0, 0, 0, False)]),
]
SCRIPT = [
    ("block", "describe('a', () => {\n  beforeEach(async () => {\n    const r = /[{]/g;\n    await db.connect();\n  });\n  afterEach(() => {});\n});", [("before_each", 2, 5, 1, 1, 0, 0, 0, True), ("after_each", 6, 6, 1, 1, 0, 0, 0, False)]),
    ("arrow without braces", "beforeEach(() => setup(new A(), b ? c : d));\nafterAll(done => done())", [("before_each", 1, 1, 2, 1, 1, 0, 0, False), ("after_all", 2, 2, 1, 1, 0, 0, 1, False)]),
    ("function", "before(function (done) {\n  if (a && b) { done(); }\n});", [("mocha_before", 1, 3, 3, 2, 0, 0, 1, False)]),
    ("named function", "beforeAll(helper); beforeEach(async function up(a, { b, c } = {}, ...d) {})", [("before_all", 1, 1, 1, 1, 0, 0, 0, False), ("before_each", 1, 1, 1, 1, 0, 0, 3, False)]),
    ("siblings don't pair", "describe('a', () => { beforeEach(() => {}) })\ndescribe('b', () => { afterEach(() => {}) })", [("before_each", 1, 1, 1, 1, 0, 0, 0, False), ("after_each", 2, 2, 1, 1, 0, 0, 0, False)]),
    ("describe.only is no container", "describe('a', () => {\n  describe.only('b', () => { before(() => {}) })\n  after(() => {})\n})", [("mocha_before", 2, 2, 1, 1, 0, 0, 0, True), ("mocha_after", 3, 3, 1, 1, 0, 0, 0, False)]),
    ("described by table", "describe.each([1, 2])('n %d', n => {\n  beforeEach(() => use(n))\n})", [("before_each", 2, 2, 1, 1, 0, 0, 0, False)]),
    ("methods of others", "x.beforeEach(() => {}); this.after(() => {}); test.before(t => {}); cy?.before();", []),
    ("not called", "const beforeEach = 1; let o = { after: 2, before() { return 1 } }; beforeEach;", []),
    ("comments and strings", "// beforeEach(() => {})\n/* afterEach() */ const s = 'before()' + \"after()\" + `beforeAll() ${x ? `after(${y})` : ''}`;", []),
    ("code in a template", "`a ${beforeEach(() => { q })} b`", [("before_each", 1, 1, 1, 1, 0, 0, 0, False)]),
    ("inner functions", "beforeEach(() => {\n  items.map(x => x > 0 && x < 9 ? 1 : 2);\n  function f() { if (a) b(); }\n  for (const i of items) g();\n});", [("before_each", 1, 5, 2, 2, 0, 0, 0, False)]),
    ("no semicolons", "const a = 1\nbeforeEach(() => {\n  b()\n})\nlet c\nafterEach(d)", [("before_each", 2, 4, 1, 1, 0, 0, 0, True), ("after_each", 6, 6, 1, 1, 0, 0, 0, False)]),
    ("regular expressions", "const r = a / b; const q = /\\/beforeEach\\(/.test(x); beforeEach(() => x.match(/after(['\"]/))", [("before_each", 1, 1, 1, 1, 0, 0, 0, False)]),
    ("awaited and chained", "async () => { await beforeAll(() => {}); }\nbeforeEach(() => {}).timeout(5)", [("before_all", 1, 1, 1, 1, 0, 0, 0, False), ("before_each", 2, 2, 1, 1, 0, 0, 0, False)]),
    ("around", "aroundEach(async (runTest) => { await runTest() }); aroundAll(async (r) => r())", [("vitest_around_each", 1, 1, 1, 1, 0, 0, 1, True), ("vitest_around_all", 1, 1, 1, 1, 0, 0, 1, True)]),
    ("comment lines", "beforeEach(() => {\n  // one\n  a() /* two\n  three */\n})", [("before_each", 1, 5, 1, 1, 0, 3, 0, False)]),
    ("nested statements", "afterEach(async () => {\n  for await (const x of y) {\n    try { while (z) { do { q() } while (r) } } catch { s() }\n  }\n})", [("after_each", 1, 5, 5, 5, 0, 0, 0, False)]),
    ("if without braces", "after(() => {\n  if (a) b()\n  else if (c) d()\n  else e()\n})", [("mocha_after", 1, 5, 3, 3, 0, 0, 0, False)]),
    ("class bodies", "class A { constructor() { before(() => {}) } x = () => after(() => {}); static { beforeAll(y) } get z() { return 1 } #p = 1 }", [("mocha_before", 1, 1, 1, 1, 0, 0, 0, True), ("mocha_after", 1, 1, 1, 1, 0, 0, 0, False), ("before_all", 1, 1, 1, 1, 0, 0, 0, False)]),
    ("object methods", "const o = { async a() { beforeEach(() => {}) }, b: () => { afterEach(() => {}) }, [c]: 1, ...d }", [("before_each", 1, 1, 1, 1, 0, 0, 0, True), ("after_each", 1, 1, 1, 1, 0, 0, 0, False)]),
    ("unclosed", "describe('a', () => {\n  beforeEach(() => { x(\n", None),
    ("stray closer", "}) ;\nbeforeEach(() => {})", [("before_each", 2, 2, 1, 1, 0, 0, 0, False)]),
    ("optional operators", "beforeEach(() => { a?.b ?? c; d ? e : f; g?.(); })", [("before_each", 1, 1, 3, 1, 0, 0, 0, False)]),
]
TYPED = [
    ("types", "beforeEach(async (): Promise<void> => {\n  const x = <T,>(y: T): T => y;\n  const m: Map<string, Array<number>> = new Map<string, number[]>();\n});", [("before_each", 1, 4, 1, 1, 1, 0, 0, False)]),
    ("typed call and parameters", "let s: ReturnType<typeof setup>;\nbeforeAll<Ctx>((ctx: Ctx, n?: number) => { s = setup(ctx) as any; });\nafterAll(() => s!.stop());", [("before_all", 2, 2, 1, 1, 0, 0, 2, True), ("after_all", 3, 3, 1, 1, 0, 0, 0, False)]),
    ("interfaces", "interface A { beforeEach(): void; after?: string }\ntype B = { before(x: number): void };\nabstract class C<T> extends D<T> implements E { private readonly x: T; abstract after(): void; }", []),
    ("function types", "declare function before(x: () => void): void;\nfunction f(cb: (x: number) => void = () => {}): { a: number } { before(() => {}); return { a: 1 } }", [("mocha_before", 2, 2, 1, 1, 0, 0, 0, False)]),
]
PYTHON = [
    ("decorated", "import pytest\n@pytest.fixture(scope='module')\ndef f(a, b=list(), *c, d, **e):\n    # one\n    if a and b:\n        yield A(x.B())\n", [("pytest_decorator", 3, 6, 3, 2, 2, 1, 5, True)]),
    ("names", "class T(TestCase):\n    def setUp(self): self.addCleanup(x)\n    async def asyncTearDown(self): pass\n    def setUpClass(cls): pass\n    @classmethod\n    def tearDownClass(cls): pass\n    def setup_method(self, m): pass\n", [("unittest_setup", 2, 2, 1, 1, 0, 0, 0, True), ("unittest_setup", 3, 3, 1, 1, 0, 0, 0, False), ("unittest_setup", 4, 4, 1, 1, 0, 0, 0, True), ("unittest_setup", 6, 6, 1, 1, 0, 0, 0, False), ("pytest_class_method", 7, 7, 1, 1, 0, 0, 1, False)]),
    ("not decorators", "@pytest.mark.usefixtures('a')\ndef test_a(): pass\n@fixture\ndef b(): pass\n@pytest_asyncio.fixture\nasync def c(): return 1\n", [("pytest_decorator", 6, 6, 1, 1, 0, 0, 0, False)]),
    ("decorated by name too", "@pytest.fixture(autouse=True)\ndef setup_method(self):\n    for i in x:\n        if i: pass\n        elif j: pass\n    try: a()\n    finally: b()\n    return [k for k in l if m]\n", [("pytest_decorator", 2, 8, 7, 3, 0, 0, 0, False)]),
    ("inner functions", "@pytest.fixture\ndef make():\n    def inner(x):\n        if x: return 1\n    '# no comment'\n    return inner\n", [("pytest_decorator", 2, 6, 1, 2, 0, 0, 0, False)]),
    ("broken", "def setUp(:\n", []),
]
ALL = [(language, *x) for language, cases in (("java", JAVA), ("javascript", SCRIPT), ("typescript", TYPED), ("python", PYTHON)) for x in cases]


@pytest.fixture(scope="module")
def rows(spark):
    files = spark.createDataFrame([(i, language, source) for i, (language, _, source, _) in enumerate(ALL)] + [(900, "java", None), (901, "java", " "), (902, "go", "x"), (None, "java", "class A { @Before void a() {} }")], "file_id long, language string, source string")
    found = syntax.nodes(files).cache()
    out: dict = {}
    for r in syntax.with_teardown(syntax.fixtures(found)).collect():
        values = (r.fixture_type, r.start_line, r.end_line, r.cyclomatic_complexity, r.max_nesting_depth, r.num_objects_instantiated, r.num_comment_lines, r.num_parameters, r.has_teardown_pair)
        out.setdefault(r.file_id, []).append(values)
    return out


@pytest.mark.parametrize("number", range(len(ALL)), ids=[f"{x[0]}: {x[1]}" for x in ALL])
def test_fixtures_of_odd_sources(rows, number):
    want = ALL[number][3]
    if want is None:
        assert number not in rows or rows[number]
    else:
        assert sorted(rows.get(number, [])) == sorted(want)


def test_there_are_enough_odd_sources():
    assert len(ALL) >= 60


def test_sources_without_nodes(rows):
    assert rows.keys() & {900, 901, 902} == set()
    assert len(rows[None]) == 1


def test_nodes_lie_within_their_parents(spark):
    files = spark.createDataFrame([(i, language, source) for i, (language, _, source, _) in enumerate(ALL)], "file_id long, language string, source string")
    found = syntax.nodes(files).toPandas()
    both = found.merge(found, left_on=["file_id", "parent"], right_on=["file_id", "node"], suffixes=("", "_up"))
    assert len(both) > 100
    assert (both.begin_up <= both.begin).all() and (both.end_up >= both.end).all()
    assert not found.duplicated(["file_id", "node"]).any()


def test_deep_and_long_sources_end(spark):
    sources = ["{" * 5000 + "}" * 5000, "(" * 5000, "class A { " * 3000, "a.b(" * 3000 + ")" * 3000, "x = " + "[".join("a" for _ in range(4000)), "if (a) " * 4000, "@A " * 5000 + "class B {}"]
    files = spark.createDataFrame([(i, language, s) for i, s in enumerate(sources) for language in ("java", "typescript")], "file_id long, language string, source string")
    assert syntax.nodes(files).count() > 0


def test_leaf_lines_and_coverage(spark):
    from quarryline.operators.commits import covered_by_code

    sources = [
        (1, "java", 'class A {\n  // x\n  void a() {\n    try {\n      b();\n    } finally {\n    }\n    String s = """\n  # }\n  """;\n    return;\n  }\n}'),
        (2, "python", "@p.f(\n    a\n)\ndef b():\n    # c\n    try:\n        d = '#' + \\\n            \"\"\"x\n\ny\"\"\"\n    finally:\n        pass\n"),
        (3, "typescript", "before(() => {\n  /* a */\n  else {\n  }\n  `b\n  ${c}\n  d`\n})"),
        (4, "python", "def a(:\n  '''"),
        (5, "java", None),
    ]
    files = spark.createDataFrame(sources, "file_id long, language string, source string")
    lines: dict = {}
    for r in syntax.leaf_lines(files).collect():
        lines.setdefault(r.file_id, set()).add(r.point)
    assert lines[1] == {1, 3, 5, 6, 7, 8, 9, 10, 11}
    assert lines[2] == {1, 2, 4, 7, 8, 9, 10, 12}
    assert lines[3] == {1, 3, 4, 5, 6, 7}
    assert 5 not in lines
    added = spark.createDataFrame([(1, k) for k in (3, 5, 6, 7, 8, 9, 10, 11)] + [(2, k) for k in (4, 7, 8, 10, 12)], "file_id long, point int")
    spans = spark.createDataFrame([(1, 3, 12), (2, 4, 12), (1, 2, 2), (2, 5, 1)], "file_id long, start_line int, end_line int")
    got = {(r.file_id, r.start_line): r.is_covered for r in covered_by_code(spans, added, files, syntax.leaf_lines).collect()}
    assert got == {(1, 3): True, (2, 4): False, (1, 2): False, (2, 5): False}


def test_outer_complexity_and_test_counts(spark):
    sources = [
        (1, "javascript", "beforeEach(() => { a && run(() => b || c ? d : e); function f() { if (g) h() } })"),
        (2, "java", "@Before void a() { if (b || c) d(() -> e ? f : g); new R() { void m() { while (x) y(); } }; }"),
        (3, "typescript", "beforeAll(setup)"),
        (4, "python", "def a(): pass"),
        (5, "java", None),
    ]
    found = spark.createDataFrame(sources, "file_id long, language string, raw_source string")
    assert {r.file_id: r.outer_complexity for r in syntax.rechecked(found).collect()} == {1: 2, 2: 4, 3: None, 4: None, 5: None}
    tests = [(1, "python", "def test_a():\n  def test_b(): pass\nclass T:\n  async def test_c(self): pass\n  def atest(self): pass"), (2, "java", "class A extends TestCase { public void testA() {} void other() {} @Test void b() {} } class B { void testC() {} }"), (3, "typescript", "it('a', f); test.skip('b', g); test.each([1])('c', h); x.it('d'); describe('e', () => { it.only('f') })"), (4, "java", "class A {}")]
    nodes = syntax.nodes(spark.createDataFrame(tests, "file_id long, language string, source string"))
    assert {r.file_id: r.n_tests for r in syntax.test_counts(nodes).collect()} == {1: 3, 2: 2, 3: 4}


def test_texts_stay_out_of_the_search_for_partners(spark):
    """Without raw_source among what is asked for, the join of fixtures with their partners doesn't carry it."""
    import re

    from pyspark.sql import functions as F

    found = spark.range(3).select(
        F.col("id").alias("file_id"), F.lit("unittest_setup").alias("fixture_type"), F.concat(F.lit("setUp"), F.col("id").cast("string")).alias("name"), F.lit("per_test").alias("scope"), F.lit(1).alias("container"),
        F.concat(F.lit("x"), F.col("id").cast("string")).alias("raw_source"),
    )
    found = found.repartition(2)
    plan = syntax.with_teardown(found).drop("raw_source")._jdf.queryExecution().optimizedPlan().toString().splitlines()
    joined = plan[next(k for k, line in enumerate(plan) if "Join" in line) + 1]
    assert "Project" in joined and "told" in joined
    assert not re.search(r"(\[|, )raw_source#\d+(,|\])", joined)


def test_blanks_are_no_tokens_and_lines_stay(spark):
    import re

    from quarryline.functions import scalars as S
    from quarryline.operators import extract as X

    for source in ("", " \n\t", "f( /* a\n\n b */ g )  \n \n", "a\u2003b\x1c// x", "x = `a\n${ y }\n`  "):
        plain = [(m.start(), m.group()) for m in re.finditer(r"[\w$#]+|[^\s\w]", X.blanked(source))]
        p = syntax.Parser(source, "javascript")
        assert [(b, t) for b, t in zip(p.at, p.text, strict=True) if t != syntax.TEXT] == plain
        assert len(X.blanked(source)) == len(source) and X.blanked(source).count("\n") == source.count("\n")
    texts = spark.createDataFrame([(None,), ("",), ("OPEN (x) open(y) reopen(z) os.environ requests.",), ("aab",)], "t string")
    assert [r.n for r in texts.select(S.occurrences("t", X.EXTERNAL).alias("n")).collect()] == [None, 0, 4, 0]
    assert [r.n for r in texts.select(S.occurrences("t", ["a|b"]).alias("n")).collect()] == [None, 0, 0, 3]
    lines = spark.createDataFrame([(None,), ("a\r\n \t\n\x0b\rb\n",), ("\x01",)], "t string")
    assert [r.n for r in lines.select(S.nonblank_lines("t").alias("n")).collect()] == [0, 2, 1]
