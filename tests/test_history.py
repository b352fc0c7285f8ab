"""The log and the trees of a repository against git's own answers, file by file."""

import os
import random
import subprocess

import pytest

from mergetide.operators import diffing
from mergetide.sources import history


def run(root, *words, **env):
    return subprocess.run(["git", "-C", str(root), *words], check=True, capture_output=True, text=True, env=os.environ | env).stdout


@pytest.fixture(scope="module")
def repository(tmp_path_factory):
    """Sixty commits on two branches that are merged now and then; one merge changes a file by itself."""
    root = tmp_path_factory.mktemp("history")
    run(root, "init", "-q", "-b", "main")
    for k, v in (("user.name", "A. Uthor"), ("user.email", "a@example.org")):
        run(root, "config", k, v)
    rng = random.Random(5)
    when = 1_700_000_000

    def commit(text, side):
        nonlocal when
        when += 60
        for _ in range(rng.randint(1, 3)):
            name = root / side / f"d{rng.randint(0, 3)}" / rng.choice(["a.ts", "b c.ts", "ü.html", "e.ts"])
            name.parent.mkdir(parents=True, exist_ok=True)
            name.write_text(f"{text} {rng.random()}\n")
        run(root, "add", "-A")
        run(root, "commit", "-q", "-m", text, GIT_AUTHOR_DATE=f"{when} +0000", GIT_COMMITTER_DATE=f"{when} +0000")

    (root / "both.ts").write_text("0\n")
    commit("first", "left")
    run(root, "branch", "side")
    for n in range(60):
        branch = "main" if n % 3 else "side"
        run(root, "checkout", "-q", branch)
        commit(f"c{n}", "left" if branch == "main" else "right")
        if n % 20 == 19:
            run(root, "checkout", "-q", "main")
            run(root, "merge", "-q", "--no-commit", "--no-ff", "side")
            (root / "both.ts").write_text(f"{n}\n")
            commit("merge", "left")
            run(root, "checkout", "-q", "side")
            run(root, "merge", "-q", "--ff-only", "main")
    run(root, "checkout", "-q", "main")
    return root


@pytest.mark.parametrize("each", [1, 7, 5_000])
def test_last_commits_are_those_of_git(spark, repository, each):
    commits = history.commits_at(spark, str(repository), each=each)
    got = {r["path"]: (r["hash"], r["author"]) for r in diffing.last_commits(commits).collect()}
    paths = run(repository, "ls-tree", "-r", "-z", "--name-only", "HEAD").split("\0")[:-1]
    assert sorted(got) == sorted(paths) and "both.ts" in got
    for path in paths:
        assert got[path][0] == run(repository, "log", "-1", "--format=%H", "--", path).strip()
    assert {a for _, a in got.values()} == {"A. Uthor"}


def test_numbers_come_from_the_log(spark, repository):
    order = run(repository, "log", "--format=%H", "HEAD").split()
    seqs = {r["hash"]: r["seq"] for r in history.commits_at(spark, str(repository), each=4).select("hash", "seq").distinct().collect()}
    assert all(order[len(order) - 1 - s] == h for h, s in seqs.items())
    assert history.commits_at(spark, str(repository), each=4).rdd.getNumPartitions() == -(-len(order) // 4)
    older = run(repository, "rev-parse", "HEAD~3").strip()
    assert order[0] not in {r["hash"] for r in history.commits_at(spark, str(repository), older).select("hash").collect()}


@pytest.mark.parametrize("folders", [1, 3, 64])
def test_tree_at_a_commit(spark, repository, folders):
    tree = history.tree_at(spark, str(repository), "HEAD~2", [".ts"], folders=folders)
    got = {r["path"]: r["content"] for r in tree.collect()}
    paths = [p for p in run(repository, "ls-tree", "-r", "-z", "--name-only", "HEAD~2").split("\0") if p.endswith(".ts")]
    assert got == {p: run(repository, "show", f"HEAD~2:{p}") for p in paths} and len(got) > 5
    assert tree.count() == len(paths)


def test_large_blobs_and_wrong_names(spark, repository, tmp_path):
    everything = history.tree_at(spark, str(repository)).count()
    assert history.tree_at(spark, str(repository), most=3).count() < everything  # both.ts alone
    with pytest.raises(Exception, match="rev-parse"):
        history.commits_at(spark, str(repository), "no-such-branch").count()
    with pytest.raises(Exception, match="rev-parse"):
        history.tree_at(spark, str(tmp_path)).count()
