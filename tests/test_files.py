"""Sources, sinks, the stream of arrivals, and array operations."""

import os
import time
import zipfile

import numpy as np
from pyspark.sql import functions as F

from tessera.images import kernels
from tessera.operators import ingest
from tessera.schemas import REPORT_COLUMNS
from tessera.sinks.files import as_png, write_archives, write_report
from tessera.sources.files import discover, images, member_contents, read_manifest, read_report, turn_of, upright, zip_members
from tessera.streaming.drops import KnownContents, arrivals, once


def test_discover_keeps_the_first_of_equal_contents(spark, tmp_path):
    for name, content in {"a/photo.jpg": b"1", "b/same.jpeg": b"1", "b/other.png": b"2", "c.txt": b"3", "d.zip": b"4"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(content)
    got = {r.path.rsplit("/", 1)[1]: (r.verdict, r.duplicate) for r in discover(spark, str(tmp_path)).collect()}
    assert got == {"photo.jpg": ("image", False), "same.jpeg": ("image", True), "other.png": ("image", False), "c.txt": ("unsupported", False), "d.zip": ("archive", False)}


def test_archives_are_listed_and_judged(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "x.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in {"one/photo.jpg": b"a", "../up_evil/escaped.txt": b"b", "bomb.bin": b"0" * (2 << 20)}.items():
            z.writestr(name, data)
    (tmp_path / "broken.zip").write_bytes(b"no zip")
    members = zip_members(spark, str(tmp_path))
    assert members.filter("pos = -1").count() == 1
    got = {r.name: r.verdict for r in ingest.archive_cascade(members.filter("pos >= 0")).collect()}
    assert got == {"one/photo.jpg": "taken", "../up_evil/escaped.txt": "unsafe path", "bomb.bin": "suspicious ratio"}


def test_reports_read_back(spark, tmp_path):
    notes = 'He said "no", then \\ left,\nand came back'
    df = spark.createDataFrame([("item_000001", "a.jpg", notes, "x"), ("item_000002", "NA", None, "y")], "item_id string, original_filename string, notes string, extra string")
    write_report(df, str(tmp_path / "report"))
    back = read_report(spark, str(tmp_path / "report"))
    assert tuple(back.columns) == REPORT_COLUMNS
    assert [(r.item_id, r.original_filename, r.notes) for r in back.orderBy("item_id").collect()] == [("item_000001", "a.jpg", notes), ("item_000002", "", "")]


def test_members_are_read_from_their_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "x y.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in (("a.jpg", b"1"), ("b/a.jpg", b"2" * 5000), ("../c.jpg", b"3")):
            z.writestr(name, data)
        z.writestr(zipfile.ZipInfo("a.jpg"), b"4")
    taken = ingest.archive_targets(zip_members(spark, str(tmp_path)))
    assert {r.final: bytes(r.content) for r in member_contents(taken).collect()} == {"a.jpg": b"1", "b/a.jpg": b"2" * 5000, "a_2.jpg": b"4"}


def test_archives_are_written_whole(spark, tmp_path):
    for name in "abc":
        (tmp_path / name).write_bytes(name.encode() * 3000)
    rows = [("z", "b.txt", "b"), ("z", "a.txt", "a"), ("y", "c.txt", "c"), ("z", "d/b.txt", "b")]
    df = spark.createDataFrame([(x, n, str(tmp_path / p)) for x, n, p in rows], "archive string, name string, path string")
    for _ in range(2):  # writing again changes nothing
        got = {r.archive: r for r in write_archives(df, str(tmp_path)).collect()}
    with zipfile.ZipFile(got["z"].file) as z:
        assert z.namelist() == ["a.txt", "b.txt", "d/b.txt"] and z.read("b.txt") == b"b" * 3000 and z.testzip() is None
        assert all(m.compress_type == zipfile.ZIP_STORED for m in z.infolist())
    assert got["y"].members == 1 and got["y"].bytes == (tmp_path / "y.zip").stat().st_size and not list(tmp_path.glob("*.part"))


def test_pictures_go_to_png_and_back(spark, tmp_path):
    rng = np.random.default_rng(1)
    for name, shape in {"grey": (5, 7, 1), "colour": (4, 3, 3), "clear": (3, 6, 4)}.items():
        pixels = rng.integers(0, 256, shape, dtype=np.uint8)
        df = as_png(spark.createDataFrame([(pixels.tobytes(), *shape)], "data binary, height int, width int, nChannels int"))
        (tmp_path / f"{name}.png").write_bytes(bytes(df.first().png))
        back = next(r for r in images(spark, str(tmp_path)).collect() if name in r.origin)
        got = np.frombuffer(bytes(back.data), np.uint8).reshape(back.height, back.width, back.nChannels)
        assert (got == pixels).all()
    (tmp_path / "broken.png").write_bytes(b"none")
    broken = next(r for r in images(spark, str(tmp_path)).collect() if "broken" in r.origin)
    assert broken.height == -1 and broken.error == "Could not read image: broken.png"


def test_pictures_are_turned_upright():
    def jpeg(turn, order):
        entry = (0x0112).to_bytes(2, order) + (3).to_bytes(2, order) + (1).to_bytes(4, order) + turn.to_bytes(2, order) + b"\0\0"
        tiff = (b"II" if order == "little" else b"MM") + (42).to_bytes(2, order) + (8).to_bytes(4, order) + (1).to_bytes(2, order) + entry
        part = b"Exif\0\0" + tiff
        return b"\xff\xd8\xff\xe0\0\x04ab\xff\xe1" + (len(part) + 2).to_bytes(2, "big") + part + b"\xff\xda\0\x02"

    x = np.arange(6, dtype=np.uint8).reshape(2, 3, 1)
    want = {1: x, 2: x[:, ::-1], 3: x[::-1, ::-1], 4: x[::-1], 5: x.swapaxes(0, 1), 6: np.rot90(x, -1), 7: x[::-1, ::-1].swapaxes(0, 1), 8: np.rot90(x)}
    for turn, seen in want.items():
        assert turn_of(jpeg(turn, "big")) == turn_of(jpeg(turn, "little")) == turn
        data, h, w = upright(x.tobytes(), 2, 3, 1, turn)
        assert (np.frombuffer(data, np.uint8).reshape(h, w, 1) == seen).all()
    assert turn_of(b"") == turn_of(b"\xff\xd8") == turn_of(b"\x89PNG") == turn_of(jpeg(3, "big")[:30]) == 1


def test_manifests_are_read(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"version": 1,\n "files": [{"path": "a.bin", "size": 3, "sha256": "ab", "note": "x"}, {"path": "b.bin", "size": 4, "sha256": "CD"}]}')
    assert sorted(map(tuple, read_manifest(spark, str(tmp_path / "m.json")).collect())) == [("a.bin", 3, "AB"), ("b.bin", 4, "CD")]


def test_arrivals_come_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, content in {"1.jpg": b"1", "2.jpg": b"1", "3.png": b"2", "4.txt": b"3"}.items():
        (tmp_path / "in" / name).write_bytes(content)
    run = once(arrivals(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("arrived").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert spark.table("arrived").select(F.countDistinct("sha"), F.count("*")).first() == (2, 2)


def test_contents_of_earlier_batches_are_known(spark, tmp_path):
    (tmp_path / "in").mkdir()
    known = KnownContents(spark, str(tmp_path / "known"))

    def run(where, **files):
        for name, content in files.items():
            (tmp_path / "in" / name.replace("_", ".")).write_bytes(content)
        source = arrivals(spark, str(tmp_path / "in"))
        source.writeStream.foreachBatch(known.writer()).option("checkpointLocation", str(tmp_path / where)).trigger(availableNow=True).start().awaitTermination()
        return sorted((r.batch, r.path.rsplit("/", 1)[1]) for r in known.read().collect())

    assert known.read() is None
    assert run("progress", b_jpg=b"1", a_jpg=b"1", c_txt=b"2", d_png=b"4") == [(0, "a.jpg"), (0, "d.png")]
    assert run("progress", e_jpg=b"1", f_jpg=b"3", g_webp=b"3") == [(0, "a.jpg"), (0, "d.png"), (1, "f.jpg")]  # goes on where it stopped
    assert run("progress", h_jpg=b"1") == [(0, "a.jpg"), (0, "d.png"), (1, "f.jpg")]
    own = spark.read.parquet(str(tmp_path / "known")).filter("batch = 1").withColumn("verdict", F.lit("image"))
    known.add_batch(own.select("path", "modified", "format", "verdict", "sha"), 3)  # nothing new, twice
    known.add_batch(own.select("path", "modified", "format", "verdict", "sha"), 3)
    assert known.read().count() == 3
    # a stream that has lost its progress brings all files again, as its first batch: which then has what no other batch has
    assert [n for _, n in run("lost")] == ["a.jpg", "d.png", "f.jpg"]


def test_large_files_are_judged_by_name_and_hashed_as_streams(spark, tmp_path):
    import hashlib

    with open(tmp_path / "all.zip", "wb") as f:
        f.truncate(3 << 30)  # more than an array of the JVM can hold; sparse
    with open(tmp_path / "large.jpg", "wb") as f:
        f.write(b"x" * 5_000_000)
    got = {r.path.rsplit("/", 1)[1]: (r.verdict, r.length, r.sha) for r in discover(spark, str(tmp_path)).collect()}
    assert got == {"all.zip": ("archive", 3 << 30, None), "large.jpg": ("image", 5_000_000, hashlib.sha256(b"x" * 5_000_000).hexdigest())}


def test_old_files_that_arrive_late_are_taken(spark, tmp_path):
    folder, day = tmp_path / "in", 86_400
    folder.mkdir()

    def arrive(files):
        for name, (content, age) in files.items():
            (folder / name).write_bytes(content)
            os.utime(folder / name, (time.time() - age * day,) * 2)
        run = once(arrivals(spark, str(folder))).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        run.awaitTermination(120)
        return sorted(r.path.rsplit("/", 1)[1] for r in spark.read.parquet(str(tmp_path / "out")).collect())

    assert arrive({"1.jpg": (b"1", 0)}) == ["1.jpg"]
    assert arrive({"2.jpg": (b"2", 8), "3.jpg": (b"3", 400), "again.jpg": (b"1", 30)}) == ["1.jpg", "2.jpg", "3.jpg"]
    assert arrive({"4.jpg": (b"4", 4000), "5.jpg": (b"3", 0)}) == ["1.jpg", "2.jpg", "3.jpg", "4.jpg"]


def test_parts_and_holes():
    rng = np.random.default_rng(3)
    for _ in range(20):
        mask = rng.random((9, 11)) < 0.45
        label, seen = kernels.components(mask), set()
        n = 0
        for y, x in zip(*np.nonzero(mask)):
            if (y, x) in seen:
                continue
            n, part = n + 1, [(y, x)]
            seen.add((y, x))
            while part:
                a, b = part.pop()
                assert label[a, b] == n
                for c, d in ((a + i, b + j) for i in (-1, 0, 1) for j in (-1, 0, 1)):
                    if 0 <= c < 9 and 0 <= d < 11 and mask[c, d] and (c, d) not in seen:
                        seen.add((c, d))
                        part.append((c, d))
        assert label.max() == n and kernels.areas(label).sum() == mask.sum()
    ring = np.zeros((7, 7), bool)
    ring[1:6, 1:6] = True
    ring[3, 3] = False
    assert kernels.fill_holes(ring).sum() == 25
