"""Scans of several repositories: what is entered, what is read, and what fails."""

from __future__ import annotations

import os

import pytest

from tessera.config import ScanConfig
from tessera.sources import repository


def put(folder, files):
    for name, data in files.items():
        (folder / name).parent.mkdir(parents=True, exist_ok=True)
        (folder / name).write_bytes(data)


@pytest.fixture()
def roots(tmp_path):
    put(tmp_path / "one", {"pkg/__init__.py": b"", "src/a.py": b"x = 1\r\n", "src/.hidden.md": b"h", "src/b.bin": b"x", "node_modules/deep/c.py": b"never", "src/e.py": b"a\0b", "src/gen/g.py": b"y", "big.py": b"z" * 5000})
    put(tmp_path / "two", {"docs/d.md": "﻿é".encode(), "f.txt": b"\xe9t\xe9"})
    os.symlink(tmp_path / "two", tmp_path / "one" / "link")
    return {"one": str(tmp_path / "one"), "two": f"file://{tmp_path}/two", "lost": str(tmp_path / "nowhere")}


CONFIG = ScanConfig(ignored_patterns=("*/gen/*",))


def test_several_roots(spark, roots):
    found = repository.scan_all(spark, roots, CONFIG)
    assert {(r.repo, r.path): r.text for r in found.files.collect()} == {("one", "pkg/__init__.py"): "", ("one", "src/a.py"): "x = 1\n", ("one", "src/.hidden.md"): "h", ("one", "big.py"): "z" * 5000, ("two", "docs/d.md"): "é", ("two", "f.txt"): "été"}
    counts = {r.repo: r.asDict() for r in found.counts.collect()}
    assert counts["one"] == {"repo": "one", "seen": 7, "dirs_ignored": 1, "ignored_ext": 1, "ignored_pattern": 1, "ignored_binary": 1, "too_large": 0, "unreadable": 0, "kept": 4, "status": "ok"}
    assert counts["two"]["kept"] == 2 and counts["lost"]["status"] == "failed" and counts["lost"]["seen"] == 0
    assert [(r.repo, r.reason) for r in found.failures.collect()] == [("lost", "unlisted")]


def test_only_what_stays_is_read(spark, roots):
    listed = repository.listing(spark, roots, CONFIG)
    assert not [r for r in listed.collect() if "deep" in r.path]
    # a large file that is left out by name or by a filter is never opened, one that stays is a row of its own
    rows = {r.path: r.reason for r in repository.contents(listed, most_bytes=1000).where("repo = 'one'").collect()}
    assert rows == {"pkg/__init__.py": None, "src/a.py": None, "src/.hidden.md": None, "src/e.py": "binary", "big.py": "large"}
    assert [r.path for r in repository.contents(listed.where("path LIKE 'docs/%'")).collect()] == ["docs/d.md"]


def test_files_that_vanish_are_rows(spark, roots, tmp_path):
    listed = repository.listing(spark, {"one": roots["one"]}, CONFIG).where("path = 'src/a.py'").collect()
    frame = spark.createDataFrame(listed, repository._LISTED)
    (tmp_path / "one" / "src" / "a.py").unlink()
    (row,) = repository.contents(frame).collect()
    assert row.reason == "unreadable" and row.text is None and row.error


def test_one_root(spark, roots):
    assert [r.path for r in repository.scan(spark, roots["one"], ScanConfig(max_files=2)).collect()] == ["big.py", "pkg/__init__.py"]
    with pytest.raises(FileNotFoundError):
        repository.scan(spark, roots["lost"])
    assert repository.scan_all(spark, {}, CONFIG).files.count() == 0
