"""Column functions: casts, text rules, dates, ids and small classifications."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_int(c: ColumnOrName) -> Column:
    """A whole number from number-like text; blanks and everything else are 0."""
    return F.coalesce(F.trim(col(c)).try_cast("double").try_cast("long"), F.lit(0).cast("long"))


def flag(c: ColumnOrName) -> Column:
    """Whether a text says 1 or true."""
    return F.coalesce(F.lower(F.trim(col(c).cast("string"))).isin("1", "true"), F.lit(False))


def blank_to_null(c: ColumnOrName) -> Column:
    return F.when(F.trim(col(c)) != "", col(c))


def first_filled(*columns: ColumnOrName) -> Column:
    return F.coalesce(*(blank_to_null(c) for c in columns))


def date_only(c: ColumnOrName) -> Column:
    return F.substring(col(c).cast("string"), 1, 10)


def in_window(c: ColumnOrName, low: str, high: str) -> Column:
    """Whether an ISO text lies in a window of days, both ends included."""
    return date_only(c).between(low, high)


def stable_id(c: ColumnOrName) -> Column:
    """A 48-bit number made from a name, the same everywhere."""
    return F.conv(F.substring(F.md5(col(c)), 1, 12), 16, 10).cast("long")


def age_years(begin: ColumnOrName, end: ColumnOrName) -> Column:
    """Years between two dates; null before the begin."""
    days = F.date_diff(col(end), col(begin))
    return F.when(days >= 0, days / 365.25)


def intensity(part: ColumnOrName, whole: ColumnOrName) -> Column:
    """A ratio's bucket; null without a whole. Below 1 %, below 5 %, up to 20 %, above, and their names."""
    ratio = F.try_divide(col(part), F.nullif(col(whole), F.lit(0)))
    return F.when(ratio < 0.01, "experimental").when(ratio < 0.05, "low").when(ratio <= 0.20, "moderate").when(ratio.isNotNull(), "high")


def source_url(name: ColumnOrName, sha: ColumnOrName, path: ColumnOrName, first: ColumnOrName | None = None, last: ColumnOrName | None = None) -> Column:
    """A link to a file at a revision, with lines if they are known."""
    base = F.concat(F.lit("https://github.com/"), col(name), F.lit("/blob/"), col(sha), F.lit("/"), col(path))
    if first is None:
        return base
    lines = F.concat(F.lit("#L"), col(first).cast("string"), F.lit("-L"), col(last if last is not None else first).cast("string"))
    return F.concat(base, F.coalesce(lines, F.lit("")))


def nonblank_lines(c: ColumnOrName) -> Column:
    return F.size(F.filter(F.split(F.coalesce(col(c), F.lit("")), r"\r\n|\n|\r", -1), lambda x: x.rlike(r"\S"))).cast("long")


def density(part: ColumnOrName, whole: ColumnOrName) -> Column:
    return F.when(col(whole) == 0, F.lit(0.0)).otherwise(col(part) / col(whole))


def needed_text(pattern: str) -> str:
    """The longest text that every match of a pattern has in it, as far as its parse tells without branches; empty if none."""
    from re import _constants, _parser

    best = now = ""

    def walk(parts) -> None:
        nonlocal best, now
        for op, value in parts:
            if op is _constants.LITERAL:
                now += chr(value)
            elif op is _constants.SUBPATTERN and not value[1] and not value[2]:
                walk(value[3])
            elif op is _constants.MAX_REPEAT and value[0] > 0:
                best, now = max(best, now, key=len), ""
                walk(value[2])
                best, now = max(best, now, key=len), ""
            elif op not in (_constants.AT, _constants.ASSERT, _constants.ASSERT_NOT):
                best, now = max(best, now, key=len), ""

    walk(_parser.parse(pattern))
    return max(best, now, key=len)


def occurrences(c: ColumnOrName, patterns: Sequence[str]) -> Column:
    """How often patterns occur in the lower-case text, all together; a pattern is run where the text that it needs is."""
    lower, total = F.lower(col(c)), F.lit(0)
    for p in patterns:
        found = F.regexp_count(lower, F.lit(p))
        need = needed_text(p)
        total = total + (F.when(lower.contains(need), found).when(lower.isNotNull(), 0) if need else found)
    return total.cast("long")


def bounded(word: str) -> str:
    """A pattern for a word or phrase that letters and digits of any script and underscores end."""
    left = r"(?<![\p{L}\p{N}_])" if re.match(r"\w", word) else ""
    right = r"(?![\p{L}\p{N}_])" if re.search(r"\w$", word) else ""
    return f"{left}{re.escape(word)}{right}"


def first_rule(c: ColumnOrName, rules: Sequence[tuple[str, str]], default: str | None = None) -> Column:
    """The name of the first (name, pattern) that a text matches."""
    out = F.lit(default) if default is not None else F.lit(None).cast("string")
    for name, pattern in reversed(rules):
        out = F.when(col(c).rlike(pattern), name).otherwise(out)
    return out


def first_keyword(c: ColumnOrName, rules: Sequence[tuple[str, Sequence[str]]], default: str | None = None) -> Column:
    """The name of the first rule of which the lower-case text has a keyword."""
    out = F.lit(default) if default is not None else F.lit(None).cast("string")
    for name, words in reversed(rules):
        has = F.lit(False)
        for w in words:
            has = has | F.contains(F.lower(col(c)), F.lit(w))
        out = F.when(has, name).otherwise(out)
    return out


def has_any_keyword(c: ColumnOrName, words: Sequence[str]) -> Column:
    has = F.lit(False)
    for w in words:
        has = has | F.contains(F.lower(F.coalesce(col(c), F.lit(""))), F.lit(w))
    return has


#: Commit types that are kept, and those that become "other".
COMMIT_TYPES = ("feat", "fix", "docs", "test", "refactor", "chore", "style")
OTHER_COMMIT_TYPES = ("perf", "ci", "build", "revert")


def commit_type(message: ColumnOrName) -> Column:
    """The conventional type in a message's first line, other, or null."""
    line = F.split_part(F.trim(col(message)), F.lit("\n"), F.lit(1))
    kind = F.lower(F.regexp_extract(line, r"^\s*([A-Za-z]+)(?:\([^)]*\))?!?:", 1))
    return F.when(kind.isin(*COMMIT_TYPES), kind).when(kind.isin(*OTHER_COMMIT_TYPES), "other")


TRAILER = r"(?im)^(?:co-authored-by|assisted-by|generated-by):\s*(.+)$"


def trailers(message: ColumnOrName) -> Column:
    """The values of all authorship trailers of a message."""
    return F.regexp_extract_all(col(message), F.lit(TRAILER), F.lit(1))


def agent_of(name: ColumnOrName, email: ColumnOrName, message: ColumnOrName, agents: Sequence[tuple[str, Sequence[str]]], bots: Sequence[str], humans: Sequence[str]) -> Column:
    """Who made a commit: null for bots; an agent named in a trailer; null for known people; an agent in name, then email."""

    def rules() -> list[tuple[str, str]]:
        return [(agent, "(?i)" + "|".join(bounded(w) for w in words)) for agent, words in agents]

    bot = F.coalesce(col(name).rlike("(?i)" + "|".join(map(re.escape, bots))), F.lit(False)) if bots else F.lit(False)
    human = F.coalesce(col(email).rlike("(?i)" + "|".join(map(re.escape, humans))), F.lit(False)) if humans else F.lit(False)
    signed = first_rule(F.array_join(trailers(message), "\n"), rules())
    return F.when(bot, F.lit(None)).otherwise(F.coalesce(signed, F.when(human, F.lit(None)).otherwise(F.coalesce(first_rule(name, rules()), first_rule(email, rules())))))


#: File endings and their languages.
LANGUAGES = {"py": "python", "java": "java", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "ts": "typescript", "tsx": "typescript", "mts": "typescript", "cts": "typescript"}


def language_of(path: ColumnOrName) -> Column:
    ending = F.lower(F.regexp_extract(col(path), r"\.([A-Za-z0-9]+)$", 1))
    out = F.lit(None).cast("string")
    for e, language in LANGUAGES.items():
        out = F.when(ending == e, language).otherwise(out)
    return out


#: How languages are shown.
DISPLAY = {"python": "Python", "java": "Java", "javascript": "JavaScript", "typescript": "TypeScript"}


def language_display(c: ColumnOrName) -> Column:
    """A language as it is shown; others with a capital letter."""
    out = F.initcap(col(c))
    for name, shown in DISPLAY.items():
        out = F.when(F.lower(col(c)) == name, shown).otherwise(out)
    return out


def language_names(names: Sequence[str]) -> list[str]:
    """A filter list in lower case, each name once, without blanks, in the given order."""
    return list(dict.fromkeys(n.strip().lower() for n in names if n and n.strip()))


def is_language(c: ColumnOrName, names: Sequence[str]) -> Column:
    """Whether a language is in the list; an empty list takes all."""
    return F.lower(F.trim(col(c))).isin(*names) if names else F.lit(True)


def until_or_blank(c: ColumnOrName, day: str) -> Column:
    """Whether an ISO text is blank or no later than a day."""
    text = F.trim(F.coalesce(col(c).cast("string"), F.lit("")))
    return (text == "") | (F.substring(text, 1, 10) <= day)


def json_list(c: ColumnOrName) -> Column:
    """The texts of a JSON array; null for anything else."""
    return F.from_json(col(c), "array<string>")


def is_test_path(path: ColumnOrName) -> Column:
    """Whether a path is a test's: a test folder, or a test's file name, and a code ending."""
    folder = col(path).rlike(r"(?i)(^|/)(tests?|__tests__|specs?)/")
    name = col(path).rlike(r"(^|/)(test_[^/]*|[^/]*_test|[^/]*[.-](test|spec)|[A-Za-z0-9]*Tests?)\.[A-Za-z]+$")
    return language_of(path).isNotNull() & (folder | name)


def path_matches(path: ColumnOrName, pattern: str, is_dir: bool) -> Column:
    """Whether a path has a folder's segments in sequence, or a file's name or whole path under a shell pattern."""
    text = re.sub(r"\\\*", "[^/]*", re.sub(r"\\\?", "[^/]", re.escape(pattern.strip("/"))))
    return col(path).rlike(f"(^|/){text}/" if is_dir else f"(^|/){text}$")


def kind_of(fixture_type: ColumnOrName, name: ColumnOrName) -> Column:
    """setup, teardown or other, by type and then by name."""
    t, n = F.lower(col(fixture_type)), F.lower(F.coalesce(col(name), F.lit("")))
    down = t.rlike("after|teardown|tear_down") | n.rlike("teardown|tear_down|cleanup")
    up = t.rlike("before|setup|set_up|fixture") | n.rlike("setup|set_up")
    return F.when(down, "teardown").when(up, "setup").otherwise("other")


def magnitude(value: ColumnOrName, limits: tuple[float, float, float]) -> Column:
    size = F.abs(col(value))
    return F.when(size < limits[0], "negligible").when(size < limits[1], "small").when(size < limits[2], "medium").when(size.isNotNull(), "large")


def cliffs_magnitude(value: ColumnOrName) -> Column:
    return magnitude(value, (0.147, 0.33, 0.474))


def cramers_magnitude(value: ColumnOrName) -> Column:
    return magnitude(value, (0.1, 0.3, 0.5))


def formatted_p(value: ColumnOrName) -> Column:
    return F.when(col(value).isNull(), "--").when(col(value) < 0.001, "<0.001").otherwise(F.format_string("%.3f", col(value)))


def percent(part: ColumnOrName, whole: ColumnOrName) -> Column:
    """A share in percent; null without a whole."""
    return F.try_divide(col(part) * 100.0, F.nullif(col(whole), F.lit(0)))
