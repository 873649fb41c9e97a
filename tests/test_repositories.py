"""Commits read from repositories on disk against what git says of them."""

import shutil
import subprocess

import pytest
from pyspark.sql import functions as F

from quarryline.sources import repositories as R

pytestmark = pytest.mark.skipif(shutil.which("git") is None, reason="git makes the repositories of these tests")


def git(path, *args, day=1, zone="+0200"):
    env = {"HOME": str(path), "PATH": "/usr/bin:/bin:/usr/local/bin", "GIT_CONFIG_NOSYSTEM": "1"}
    when = f"2025-01-{day:02d}T23:30:00 {zone}"
    env |= {"GIT_AUTHOR_NAME": "Ä b", "GIT_AUTHOR_EMAIL": "a@b", "GIT_COMMITTER_NAME": "c", "GIT_COMMITTER_EMAIL": "c@d", "GIT_AUTHOR_DATE": when, "GIT_COMMITTER_DATE": when}
    return subprocess.run(["git", "-C", str(path), *args], env=env, check=True, capture_output=True, text=True).stdout


@pytest.fixture(scope="module")
def repository(tmp_path_factory):
    path = tmp_path_factory.mktemp("repo")
    git(path, "init", "-q", "-b", "main")
    long = "a long message that many commits share, so that packs hold them as deltas\n" * 30
    for i in range(40):
        (path / "f").write_text(f"{i}\n" * 50)
        git(path, "add", "f")
        git(path, "commit", "-q", "-m", f"feat: number {i}\n\n{long}{i} é", day=1 + i // 2)
        if i == 20:
            git(path, "checkout", "-q", "-b", "side")
            git(path, "commit", "-q", "--allow-empty", "-m", "side", day=11)
            git(path, "checkout", "-q", "-b", "lost")
            git(path, "commit", "-q", "--allow-empty", "-m", "lost", day=25)
            git(path, "checkout", "-q", "main")
        if i == 30:
            git(path, "merge", "-q", "--no-ff", "-m", "merge side", "side", day=16)
    git(path, "branch", "-q", "-D", "side")
    return path


def compare(spark, path):
    fields = "%H%x1f%P%x1f%an%x1f%ae%x1f%aI%x1f%B%x1e"
    want = {}
    for row in git(path, "log", "--all", f"--format={fields}").split("\x1e"):
        if row.strip():
            sha, parents, name, address, date, body = row.lstrip("\n").split("\x1f")
            want[sha] = (parents.split(), name, address, date, body.rstrip("\n"))
    got = R.read_commits(spark, [str(path)], entries=17).collect()
    assert {r.sha: (r.parents, r.author_name, r.author_email, r.date, r.message.rstrip("\n")) for r in got} == want
    assert len(got) == len(want) == 43
    shas = lambda frame: sorted(r.sha for r in frame.collect())
    assert shas(R.log(spark, [str(path)])) == sorted(git(path, "log", "--no-merges", "--format=%H").split())
    assert shas(R.log(spark, [str(path)], merges=True, ref="refs/heads/lost")) == sorted(git(path, "log", "lost", "--format=%H").split())
    since = [x.split() for x in git(path, "log", "--no-merges", "--format=%H %ad", "--date=short").splitlines()]
    assert shas(R.log(spark, [str(path)], begin=F.lit("2025-01-15").cast("date"))) == sorted(s for s, d in since if d >= "2025-01-15")


def test_loose_objects(spark, repository):
    compare(spark, repository)


def test_packs_with_deltas(spark, repository, tmp_path):
    packed = tmp_path / "packed"
    shutil.copytree(repository, packed)
    git(packed, "repack", "-adfq", "--depth=50", "--window=60")
    git(packed, "pack-refs", "--all")
    assert "chain length" in git(packed, "verify-pack", "-v", *map(str, (packed / ".git/objects/pack").glob("*.idx")))
    compare(spark, packed)
    bare = tmp_path / "bare.git"
    shutil.copytree(packed / ".git", bare)
    both = R.read_commits(spark, [str(packed), str(bare)]).groupBy("repo").count().collect()
    assert sorted(r["count"] for r in both) == [43, 43]


def test_some_packed_and_some_loose(spark, repository, tmp_path):
    mixed = tmp_path / "mixed"
    shutil.copytree(repository, mixed)
    git(mixed, "repack", "-dq")
    git(mixed, "commit", "-q", "--allow-empty", "-m", "later", day=28, zone="-0330")
    got = R.log(spark, [str(mixed)], begin=F.lit("2025-01-28").cast("date")).collect()
    assert [(r.message, r.date) for r in got] == [("later\n", "2025-01-28T23:30:00-03:30")]
    assert R.read_commits(spark, [str(mixed)]).count() == 44


def test_empty_and_missing_repositories(spark, tmp_path):
    git(tmp_path, "init", "-q")
    assert R.read_commits(spark, [str(tmp_path)]).collect() == [] and R.log(spark, [str(tmp_path)]).collect() == []
    with pytest.raises(Exception, match="no repository"):
        R.read_commits(spark, [str(tmp_path / "none")]).collect()


def test_deltas_are_checked():
    assert R.patched(b"hello world", bytes([11, 8, 0x90, 5, 3]) + b"abc") == b"helloabc"
    with pytest.raises(ValueError):
        R.patched(b"hello", bytes([11, 8, 0x90, 5]))
