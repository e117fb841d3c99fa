"""Manifest files: round trips, random access, damage, and what other tools make of them."""

from __future__ import annotations

import json
import shutil
import subprocess
import threading
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_cut import made, museum

from sylva.__main__ import main
from sylva.errors import Cancelled, JsonError, PartFull, ReadError, WriteError
from sylva.frames import FORMATS, Lz4, Plain, TaggedFormat, Zstd, ZstdFormat
from sylva.operators.cut import with_parts
from sylva.operators.documents import entries_of_document, parsed_index
from sylva.operators.parts import checked, invalid_rows, nodes, with_node_ids
from sylva.sources.manifest import ManifestFile, read_manifest, write_lines, write_manifest
from sylva.streaming.delivery import deliver


@pytest.fixture(scope="module")
def parted(spark):
    return with_parts(made(spark, museum()), 300).cache()


@pytest.fixture(scope="module")
def file(spark, parted, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("m") / "tree.zst")
    return path, write_manifest(parted, path)


@pytest.mark.parametrize("name", sorted(FORMATS))
def test_round_trip(spark, parted, tmp_path, name):
    path = str(tmp_path / "tree")
    written = write_manifest(parted, path, name)
    f = ManifestFile(path, name)
    assert f.index == written.index and len(f.index["parts"]) == parted.select("part_no").distinct().count()
    got = [e["path"] for n in range(len(f.index["parts"])) for e in entries_of_document(f.part_json(n))]
    assert got == sorted(museum(), key=lambda p: p.encode().split(b"/"))
    columns = ["part_no", "path", "kind", "size", "mode", "mtime", "mtime_nanos", "target"]
    assert sorted(map(str, read_manifest(spark, path, name).select(columns).collect())) == sorted(map(str, parted.select(columns).collect()))


def test_bytes_depend_on_rows_alone(spark, parted, file, tmp_path):
    write_manifest(parted.repartition(5), str(tmp_path / "again"))
    assert (tmp_path / "again").read_bytes() == open(file[0], "rb").read()


def test_pruned_lookup(spark, file):
    got = read_manifest(spark, file[0]).filter("path like 'catalogue/%'")
    assert got.count() == 35
    assert len(ManifestFile(file[0]).parts_holding("catalogue")) < len(file[1].index["parts"])


def test_damage_is_refused(file, tmp_path):
    data = open(file[0], "rb").read()
    spans = ManifestFile(file[0]).spans

    def damaged(change):
        path = tmp_path / "bad"
        path.write_bytes(change(bytearray(data)))
        f = ManifestFile(str(path))
        for n in range(len(f.index["parts"])):
            f.part_json(n)

    def flip(at):
        def change(b):
            b[at] ^= 0x55
            return b

        return change

    for change in (lambda b: b[:-1], lambda b: b[:5], lambda b: b"", lambda b: b"x" + b, lambda b: b + b"x", flip(-1), flip(-5), flip(-12), flip(spans[0].offset + spans[0].length // 2), flip(spans[-1].offset + spans[-1].length // 2)):
        with pytest.raises((ReadError, JsonError)):
            damaged(change)


def test_frames_refuse_what_follows_them():
    z = Zstd()
    assert z.decode(z.encode(b"x" * 99)) == b"x" * 99
    for bad in (z.encode(b"a") + z.encode(b"b"), z.encode(b"a") + b"x", z.encode(b"abc")[:-1], b"", b"abc"):
        with pytest.raises(ReadError):
            z.decode(bad)


@pytest.mark.parametrize("bad", [b"", b"[]", b"{}", b'{"format_version":2}', b'{"format_version":1,"parts":{},"skips":{}}'])
def test_bad_indexes(bad):
    with pytest.raises(JsonError):
        parsed_index(bad)


def test_bad_index_values():
    good = {"format_version": 1, "parts": {"first": ["a"], "directories": [0], "files": [1], "symlinks": [0]}, "skips": dict.fromkeys(("special", "non_utf8", "unreadable", "failed"), 0)}
    parsed_index(json.dumps(good))
    for c, v in (("first", [1]), ("files", ["1"]), ("files", [-1]), ("files", [1.5]), ("files", [1, 2]), ("symlinks", None)):
        with pytest.raises(JsonError):
            parsed_index(json.dumps(good | {"parts": good["parts"] | {c: v}}))
    with pytest.raises(JsonError):
        parsed_index(json.dumps(good | {"skips": good["skips"] | {"failed": 1 << 32}}))


@pytest.mark.skipif(not shutil.which("zstd"), reason="no zstd")
def test_a_plain_decoder_reads_lines(file):
    text = subprocess.run(["zstd", "-dcq", file[0]], capture_output=True, check=True).stdout
    lines = [json.loads(x) for x in text.splitlines()]
    assert len(lines) == len(file[1].index["parts"]) + 1 and lines[-1]["format_version"] == 1 and len(text) == file[1].raw_length


def test_own_format(parted, tmp_path):
    path = str(tmp_path / "own")
    form = TaggedFormat(Plain(), b"OWN1")
    write_manifest(parted, path, form)
    assert ManifestFile(path, form).part_json(0).startswith(b'{"stem"')
    with pytest.raises(ReadError):
        ManifestFile(path, ZstdFormat())


def test_delivery_progress_and_cancel(parted):
    seen, cancel = [], threading.Event()

    class Told:
        entered_, recorded_, bytes_ = [], [], 0

        def entered(self, path):
            assert path == "" or path == self.recorded_[-1]
            self.entered_.append(path)

        def recorded(self, path, kind, size):
            self.recorded_.append(path)
            self.bytes_ += size

        def skipped(self, path, reason):
            pass

    told = Told()
    n = deliver(parted, seen.append, progress=told)
    assert n == len(seen) and [p.number for p in seen] == list(range(n))
    assert told.recorded_ == sorted(museum(), key=lambda p: p.encode().split(b"/"))

    assert told.entered_ == ["", *sorted((p for p, k in museum().items() if k == "directory"), key=lambda p: p.encode().split(b"/"))]
    assert told.bytes_ == parted.agg({"size": "sum"}).first()[0]

    def stop(part):
        cancel.set()

    with pytest.raises(Cancelled):
        deliver(parted, stop, cancel=cancel)
    with pytest.raises(ZeroDivisionError):
        deliver(parted, lambda part: 1 / 0)


def test_cancel_interrupts_the_jobs(spark, parted):
    """A flag that is up stops all at once; one that goes up later, a job that would take minutes."""
    up, later = threading.Event(), threading.Event()
    up.set()
    with pytest.raises(Cancelled):
        deliver(parted, lambda part: None, cancel=up)
    slow = parted.crossJoin(spark.range(1 << 37).selectExpr("max(hash(id)) as m")).filter("m <> size").drop("m")
    threading.Timer(1.0, later.set).start()
    began = time.time()
    with pytest.raises(Cancelled):
        deliver(slow, lambda part: None, cancel=later)
    assert time.time() - began < 30


def test_lz4_frames_by_their_published_form(spark, parted, tmp_path):
    """Arrow's own reader of LZ4 frames reads each frame; damage of any byte is refused."""
    path = str(tmp_path / "tree.lz4")
    write_manifest(parted, path, "lz4")
    f = ManifestFile(path, "lz4")
    text = b"".join(pa.Codec("lz4").decompress(f.frame(n), s.raw_length, asbytes=True) for n, s in enumerate(f.spans))
    assert text.count(b"\n") == len(f.spans) and json.loads(text.split(b"\n")[-2])["format_version"] == 1
    lz4 = Lz4()
    for raw in (b"", b"x", b"ab" * 5_000_000, bytes(range(256)) * 3):
        assert lz4.decode(lz4.encode(raw)) == raw
    frame = lz4.encode(b"some text, some text, some text" + bytes(range(200)))
    for i in range(len(frame)):
        with pytest.raises(ReadError):
            lz4.decode(frame[:i] + bytes([frame[i] ^ 0x55]) + frame[i + 1 :])
    for bad in (frame[:-1], frame + b"x", frame + frame, b""):
        with pytest.raises(ReadError):
            lz4.decode(bad)


def test_a_window_that_zstd_refuses(parted, tmp_path):
    with pytest.raises(WriteError):
        write_manifest(parted, str(tmp_path / "no"), ZstdFormat(Zstd(window_log=99)))
    assert list(tmp_path.iterdir()) == []


def test_files_by_uri(spark, parted, tmp_path):
    path = f"file://{tmp_path}/by-uri"
    write_manifest(parted, path)
    assert read_manifest(spark, path).count() == len(museum())


def test_parts_that_are_too_full(parted):
    assert checked(parted) is parted
    with pytest.raises(PartFull):
        checked(parted, most_text=20)
    with pytest.raises(PartFull):
        checked(parted, most_nodes=1)
    with pytest.raises(PartFull):
        checked(parted.withColumn("name", F.expr("repeat('x', 2000000)")), most_text=2_000_001)


def test_nodes_and_parts_made_by_hand(spark, parted):
    numbered = with_node_ids(parted).cache()
    known = {(r.part_no, r.node_id): r for r in nodes(numbered).collect()}
    for r in numbered.collect():
        names, at = [], r.parent_id
        while at:
            names.append(known[r.part_no, at].name)
            at = known[r.part_no, at].parent_id
        assert "/".join(names[::-1]) == r.parent
    assert invalid_rows(numbered).count() == 0
    columns = "part_no long, stem array<string>, kind string, name string, node_id int, parent_id int"
    good = [(0, ["s"], "directory", "a", 2, 1), (0, ["s"], "file", "f", None, 2), (0, ["s"], "directory", "b", 3, 2)]
    bad = {"kind": (0, ["s"], "socket", "x", None, 1), "name": (0, ["s"], "file", "x/y", None, 1), "node_id": (0, ["s"], "directory", "x", 9, 1), "parent_id": (0, ["s"], "file", "x", None, 4), "twice": (0, ["s"], "file", "a", None, 1)}
    assert invalid_rows(spark.createDataFrame(good, columns)).count() == 0
    for reason, row in bad.items():
        assert {r.reason for r in invalid_rows(spark.createDataFrame([*good, row], columns)).collect()} == {reason}
    assert {r.reason for r in invalid_rows(spark.createDataFrame([*good, (0, ["t"], "file", "x", None, 1)], columns)).collect()} == {"stem"}


def test_control_characters_are_escaped(spark, tmp_path):
    names = {'a"\\\n\t\x1f\x0b': "file", "\\u001Fx": "file", "é /": "file"}
    names = {k.rstrip("/"): v for k, v in names.items()}
    parted = with_parts(made(spark, names), 1000)
    write_lines(parted, str(tmp_path / "lines"))
    lines = [x for f in sorted((tmp_path / "lines").glob("part-*")) for x in f.read_text().split("\n") if x]
    assert [json.loads(x)["files"]["name"] for x in lines] == [sorted(names, key=str.encode)]
    assert "\\u001f" in lines[0] and "\\u000b" in lines[0] and "\\\\u001Fx" in lines[0]


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "t/d").mkdir(parents=True)
    (tmp_path / "t/d/f").write_bytes(b"abc")
    assert main([str(tmp_path / "t"), "--out", str(tmp_path / "out")]) == 0
    assert "1 directories, 1 files, 0 symlinks, 3 bytes, 1 parts" in capsys.readouterr().err
    assert main([str(tmp_path / "t"), "--metadata", "kinds"]) == 0
    assert json.loads(capsys.readouterr().out)["files"]["name"] == ["f"]
    assert main([str(tmp_path / "none")]) == 1
