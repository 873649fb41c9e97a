"""Rules behind an automaton give what running every pattern gives."""

import random
import re
import time

from quarryline.operators.extract import MOCKS, Rules, needed_text, mocks
from quarryline.sources.stores import load_rules


def plain(rules, text):
    return [(label, m.span()) for label, pattern in rules for m in re.finditer(pattern, text)]


def test_needed_texts():
    assert needed_text(r"mock\.patch\s*\(\s*['\"]([^'\"]+)['\"]") == "mock.patch"
    assert needed_text(r"(?<!\.)\bmock\s*\(\s*(\w+)\.class") == ".class"
    assert needed_text(r"MagicMock\s*\(|\bMock\s*\(") == ""
    assert needed_text(r"a?(?:bc)+d(?i:X)") in ("bc", "d")
    assert needed_text(r"[ab]|c") == "" and needed_text(r"x{0,3}") == ""


def test_rules_equal_all_passes_on_random_texts():
    r = random.Random(9)
    bits = ["mock.patch('a.b')", "mocker.patch.object(X", "Mock(", "AsyncMock (", "@Mock ", "jest.fn()", "vi.mock('x')", "sinon.stub (", "mock(Foo.class", "monkeypatch.setenv(", "Mockito.spy( a", " ", "\n", "class", ".", "patch('q')"]
    rules = Rules(MOCKS)
    for _ in range(400):
        text = "".join(r.choice(bits) for _ in range(r.randint(0, 12)))
        assert [(label, m.span()) for label, m in rules.matches(text)] == plain(MOCKS, text)


def test_the_cost_does_not_follow_the_number_of_rules():
    text = "some words without any of it; " * 4000
    many = Rules([(f"r{i}", rf"needle{i}\s*\(") for i in range(3000)])
    few = Rules([(f"r{i}", rf"needle{i}\s*\(") for i in range(30)])

    def seconds(rules):
        begin = time.perf_counter()
        for _ in range(3):
            assert list(rules.matches(text)) == []
        return time.perf_counter() - begin

    seconds(few)
    assert seconds(many) < 10 * seconds(few) + 0.1


def test_rules_from_a_table(spark, tmp_path):
    path = tmp_path / "rules.csv"
    path.write_text("# doubles\nframework,pattern\nown,\"double\\(\\s*(\\w+)\"\nany,zz+\n", encoding="utf-8")
    rules = [(x["framework"], x["pattern"]) for x in load_rules(str(path), ["framework", "pattern"])]
    files = spark.createDataFrame([(1, "double( Foo) zzz"), (2, None), (3, "")], "file_id long, source string")
    assert sorted((r.file_id, r.framework, r.target, r.at) for r in mocks(files, rules).collect()) == [(1, "any", "", 13), (1, "own", "Foo", 0)]
