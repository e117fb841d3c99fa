"""Scans of made directories against os.walk, with filters, policies, skips and metadata."""

from __future__ import annotations

import os
import socket

import pytest

from sylva.errors import WalkError
from sylva.sources import filesystem as fs


#: A garden: bytes of a file, None for a directory, a text for a link's target.
GARDEN = {
    "beds": None, "beds/north": None, "beds/north/leek.seed": b"7 rows", "beds/south": None, "beds/to-shed": "../shed/rake",
    "gate": b"", "notes.md": b"water twice a day", "pond": None, "pond/reeds": None, "pond/reeds/heron.txt": b"grey", "shed": None, "shed/rake": b"=======",
}


@pytest.fixture
def garden(tmp_path):
    for path in sorted(GARDEN, key=len):
        at, what = tmp_path / path, GARDEN[path]
        if what is None:
            at.mkdir(parents=True)
        elif isinstance(what, str):
            at.symlink_to(what)
        else:
            at.write_bytes(what)
    os.utime(tmp_path / "notes.md", ns=(0, -2_250_000_000))
    return tmp_path


def rows(df):
    return {r.path: r for r in df.collect()}


def test_rows_and_values(spark, garden):
    for tasks in (1, 2, 100):
        entries, skips = fs.scan(spark, str(garden), tasks=tasks)
        got = rows(entries)
        assert set(got) == set(GARDEN) and entries.count() == len(GARDEN)
        assert {p: r["size"] for p, r in got.items()} == {p: len(x) if isinstance(x, bytes) else None for p, x in GARDEN.items()}
        assert got["beds/to-shed"].target == "../shed/rake" and got["beds/to-shed"].mode is None
        assert (got["notes.md"].mtime, got["notes.md"].mtime_nanos) == (-3, 750_000_000)
        assert skips.count() == 0


def test_kinds_then_metadata_is_full(spark, garden):
    full = rows(fs.scan(spark, str(garden))[0])
    kinds, _ = fs.scan(spark, str(garden), metadata="kinds")
    assert all(r.mtime is None and r["size"] in (0, None) for r in kinds.collect())
    (garden / "shed/rake").unlink()
    filled = rows(fs.with_file_metadata(kinds, str(garden)))
    for path, r in filled.items():
        if path == "shed/rake":
            assert r.missing and r.mtime is None and r["size"] == 0
        elif path != "shed":
            assert not r.missing and all(r[c] == full[path][c] for c in ("size", "mode", "mtime", "mtime_nanos"))


def test_filter_sees_siblings_and_prunes(spark, garden):
    def keep(c):
        return c.name != "beds" and "heron.txt" not in c.listing

    assert set(rows(fs.scan(spark, str(garden), keep=keep)[0])) == {"gate", "notes.md", "pond", "pond/reeds", "shed", "shed/rake"}


def test_special_and_bad_names(spark, garden):
    with socket.socket(socket.AF_UNIX) as s:
        s.bind(str(garden / "sock"))
        open(os.fsencode(garden) + b"/bad-\xff", "wb").close()
        os.symlink(b"to-\xff", os.fsencode(garden) + b"/badlink")
        entries, skips = fs.scan(spark, str(garden))
    assert "sock" not in rows(entries) and "badlink" not in rows(entries)
    assert sorted(r.reason for r in skips.collect()) == ["non_utf8", "non_utf8", "special"]


def unreadable(monkeypatch, *names):
    real = os.scandir

    def broken(path):
        if path.endswith(names):
            raise PermissionError(13, "Permission denied")
        return real(path)

    monkeypatch.setattr(os, "scandir", broken)


def test_errors_fail_or_are_counted(spark, garden, monkeypatch):
    unreadable(monkeypatch, b"reeds")
    # All directories are visited by the driver, whose functions are patched, and listed again by tasks.
    found = list(fs.walk_below(os.fsencode(garden), "", True, None))
    assert [r[:1] + r[8:] for r in found if r[8]] == [("pond/reeds", "unreadable", "listing pond/reeds: Permission denied")]
    assert {"pond/reeds", "shed/rake"} <= {r[0] for r in found if not r[8]} and not any(r[0] == "pond/reeds/heron.txt" for r in found)


def test_a_failing_walk_ends_at_its_first_error(garden, monkeypatch):
    unreadable(monkeypatch, b"north", b"reeds")
    found = list(fs.walk_below(os.fsencode(garden), "", True, None, fail=True))
    assert [r[0] for r in found if r[8]] == ["beds/north"] and found[-1][0] == "beds/north" and not any(r[0].startswith("pond/") for r in found)


def test_the_first_error_in_walk_order_is_raised(spark, garden):
    """A file where a directory was, between the driver's look and the task's."""
    os.symlink("nowhere", garden / "pond" / "gone")
    keep = remove_when_asked(str(garden))
    with pytest.raises(WalkError, match="listing beds/north"):
        fs.scan(spark, str(garden), keep=keep)
    (garden / "beds/north").mkdir()
    (garden / "pond/reeds").mkdir()
    entries, skips = fs.scan(spark, str(garden), keep=remove_when_asked(str(garden)), metadata="kinds", on_error="skip", tasks=1)
    assert sorted((r.path, r.reason) for r in skips.collect()) == [("beds/north", "unreadable"), ("pond/reeds", "unreadable")]
    assert {"beds/north", "pond/reeds"} <= set(rows(entries))


def remove_when_asked(root):
    """Directories vanish as soon as a filter has seen them."""

    def keep(c):
        if c.name in ("north", "reeds") and c.kind == "directory":
            import shutil

            shutil.rmtree(f"{root}/{c.parent}/{c.name}", ignore_errors=True)
        return True

    return keep


def test_root_errors_are_always_raised(spark, garden):
    with pytest.raises(WalkError):
        fs.scan(spark, str(garden / "none"), on_error="skip")


def test_the_driver_visits_few_directories(tmp_path, monkeypatch):
    tmp_path.joinpath("chain", *[f"c{i}" for i in range(60)]).mkdir(parents=True)
    for i in range(300):
        (tmp_path / f"flat/x{i}").mkdir(parents=True)
    seen = []
    real = fs.list_directory
    monkeypatch.setattr(fs, "list_directory", lambda root, directory, *a: seen.append(directory) or real(root, directory, *a))
    starts = fs._frontier(os.fsencode(tmp_path), None, 20)
    assert len(seen) <= 20 and {d for d, deep in starts if deep} == {f"flat/x{i}" for i in range(300)} | {"chain/c0"}


def test_a_long_tunnel_and_a_plain(spark, tmp_path):
    tmp_path.joinpath("tunnel", *[f"t{i}" for i in range(130)]).mkdir(parents=True)
    for i in range(170):
        (tmp_path / f"plain/{i * 37 % 1000}").mkdir(parents=True)
        (tmp_path / f"plain/{i * 37 % 1000}/stone").touch()
    want = sum(len(d) + len(f) for _, d, f in os.walk(tmp_path))
    assert fs.scan(spark, str(tmp_path), tasks=16)[0].count() == want


def test_source_by_name(spark, garden):
    spark.dataSource.register(fs.TreeSource)
    got = spark.read.format("sylva_tree").option("metadata", "kinds").load(str(garden))
    assert got.filter("reason is null").count() == len(GARDEN)


def test_open_file_metadata(garden):
    with open(garden / "shed/rake") as f:
        assert fs.open_file_metadata(f.fileno())["size"] == 7
    fd = os.open(garden, os.O_RDONLY)
    with pytest.raises(WalkError):
        fs.open_file_metadata(fd)
    os.close(fd)
