"""ZIP archives as a data source, read and written by ranges."""

import os
import zipfile

import pytest
from pyspark.sql import functions as F

from tessera.sources.archives import ArchiveReader, Archives, ArchiveWriter, layout


@pytest.fixture
def source(spark):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Archives)
    return spark


def contents(n):
    return {f"d{i % 3}/photo {i}.{'jpg' if i % 2 else 'txt'}": bytes([i % 251]) * (37 * i % 5000) for i in range(n)}


def test_members_are_read_by_ranges(source, tmp_path):
    want = contents(60)
    for name in ("one", "sub/two"):
        (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        with zipfile.ZipFile(tmp_path / "in" / f"{name}.zip", "w", zipfile.ZIP_STORED) as z:
            z.mkdir("empty")
            for n, c in want.items():
                z.writestr(n, c)
    (tmp_path / "in" / "broken.zip").write_bytes(b"PK no archive")
    (tmp_path / "in" / "other.txt").write_bytes(b"x")
    read = source.read.format("archives").option("split", 20_000)
    df = read.load(str(tmp_path / "in"))
    assert df.rdd.getNumPartitions() > 8  # one archive by many tasks
    rows = df.collect()
    assert len(rows) == 2 * 61 + 1 and [r.archive.rsplit("/", 1)[1] for r in rows if r.pos < 0] == ["broken.zip"]
    assert {(r.name, r.file_size) for r in rows if r.pos > 0} == {(n, len(c)) for n, c in want.items()}
    assert sorted(r.pos for r in rows if r.archive.endswith("one.zip")) == list(range(61))
    got = read.option("contents", "true").load(f"file:{tmp_path}/in/one.zip").filter("name like '%.jpg' and file_size < 3000")
    assert {r.name: bytes(r.content) for r in got.collect()} == {n: c for n, c in want.items() if n.endswith(".jpg") and len(c) < 3000}
    assert read.load(str(tmp_path / "in")).filter(F.col("name").contains("photo 1") & (F.length("name") < 14)).count() == 2 * sum("photo 1" in n and len(n) < 14 for n in want)


def test_filters_leave_out_archives_before_tasks_and_members_before_contents(tmp_path):
    from pyspark.sql import datasource as ds

    for name in "ab":
        with zipfile.ZipFile(tmp_path / f"{name}.zip", "w") as z:
            z.writestr("x.jpg", b"1" * 10)
            z.writestr("y.txt", b"2")
    reader = ArchiveReader(str(tmp_path), 1 << 20, True)
    left = list(reader.pushFilters([ds.StringEndsWith(("archive",), "b.zip"), ds.StringEndsWith(("name",), ".jpg"), ds.GreaterThan(("file_size",), 5), ds.Not(ds.IsNull(("name",)))]))
    assert [type(f).__name__ for f in left] == ["Not"]
    reader._content = lambda z, m: pytest.fail(m.filename) if m.filename != "x.jpg" else z.read(m)
    [part] = reader.partitions()
    assert [(r[2], r[-1]) for r in reader.read(part)] == [("x.jpg", b"1" * 10)]


def members(spark, folder, want, archive="all"):
    folder.mkdir(exist_ok=True)
    rows = []
    for i, (n, c) in enumerate(want.items()):
        (folder / str(i)).write_bytes(c)
        rows.append((archive, n, str(folder / str(i)), len(c)))
    return spark.createDataFrame(rows, "archive string, name string, path string, size long")


def test_an_archive_is_written_by_many_tasks(source, tmp_path):
    want = contents(80) | {"é/ü.jpg": b"accents"}
    df = members(source, tmp_path / "src", want).unionByName(members(source, tmp_path / "src2", {"single": b"one"}, "other"))
    df = df.unionByName(source.createDataFrame([(None, "x", "y", 1)], df.schema))
    for _ in range(2):  # a second job replaces the first's archives
        layout(df).repartition(7, "name").write.format("archives").mode("append").save(str(tmp_path / "out"))
        assert sorted(os.listdir(tmp_path / "out")) == ["all.zip", "other.zip"]
        with zipfile.ZipFile(tmp_path / "out" / "all.zip") as z:
            assert z.testzip() is None and z.namelist() == sorted(want, key=str.encode)
            assert {n: z.read(n) for n in z.namelist()} == want
            assert all(i.compress_type == zipfile.ZIP_STORED for i in z.infolist())
        with zipfile.ZipFile(tmp_path / "out" / "other.zip") as z:
            assert z.read("single") == b"one"
    back = source.read.format("archives").option("contents", "true").load(str(tmp_path / "out" / "all.zip"))
    assert {r.name: bytes(r.content) for r in back.collect()} == want


def test_a_job_that_fails_leaves_nothing(source, tmp_path):
    df = members(source, tmp_path / "src", contents(20))
    plan = layout(df)
    plan.write.format("archives").mode("append").save(str(tmp_path / "out"))
    before = (tmp_path / "out" / "all.zip").read_bytes()
    (tmp_path / "src" / "7").write_bytes(b"changed since")
    with pytest.raises(Exception, match="were listed|has grown"):
        plan.repartition(5).write.format("archives").mode("append").save(str(tmp_path / "out"))
    assert os.listdir(tmp_path / "out") == ["all.zip"] and (tmp_path / "out" / "all.zip").read_bytes() == before


def test_places_beyond_four_gigabytes(source, tmp_path):
    big = (5 << 30) + 3
    rows = [("a", f"m{i}", "p", big) for i in range(3)] + [("a", "n", str(tmp_path / "n"), 4)]
    got = {r.name: r for r in layout(source.createDataFrame(rows, "archive string, name string, path string, size long")).collect()}
    assert [got[n].offset for n in ("m0", "m1", "m2", "n")] == [k * (big + 52) for k in range(4)]
    assert got["n"].directory_at == 3 * (big + 52) + 55 and got["n"].members == 4
    # the last member and the directory of a sparse file of 15 GB
    (tmp_path / "n").write_bytes(b"last")
    writer, one = ArchiveWriter(str(tmp_path / "out")), got["n"].asDict() | {"members": 1, "directory_size": 75, "entry_at": got["n"].directory_at}
    writer.commit([writer.write(iter([one]))])
    with zipfile.ZipFile(tmp_path / "out" / "a.zip") as z:
        assert z.read("n") == b"last" and z.infolist()[0].header_offset == 3 * (big + 52)


def test_a_commit_without_all_members_is_none(tmp_path):
    (tmp_path / "n").write_bytes(b"last")
    writer = ArchiveWriter(str(tmp_path / "out"))
    told = writer.write(iter([{"archive": "a", "name": "n", "path": str(tmp_path / "n"), "size": 4, "offset": 0, "entry_at": 55, "members": 2, "directory_at": 55, "directory_size": 150}]))
    with pytest.raises(RuntimeError, match="lack members"):
        writer.commit([told])
    assert os.listdir(tmp_path / "out") == []
