"""The repository source: splits, filters that skip members, files that cannot be read."""

import gzip
import io
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from revspark.sources import repository as R

FILES = [(f"src/{'ab'[k % 2]}/f{k}{('.py', '.go', '.md', '')[k % 4]}", f"# file {k}\n" + "x = 1\n" * (k * 7 % 50) + "ü" * (k % 3)) for k in range(60)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("repo")
    df = spark.createDataFrame(FILES, "file_path string, code string").repartition(3)
    for kind in ("zip", "tar", "tar.gz"):
        assert R.write_archives(df, f"file:{root}/{kind}", kind, archive_bytes=2000) == len(FILES)
    for name, code in FILES:
        p = root / "plain" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(code)
    return root


@pytest.mark.parametrize("split", [300, 1 << 20])
@pytest.mark.parametrize("kind", ["zip", "tar", "tar.gz", "plain"])
def test_every_file_once_however_it_is_split(spark, folder, kind, split):
    got = R.read_archives(spark, str(folder / kind), split_bytes=split)
    rows = got.select("file_path", "code", "size", "extension", "error", F.col("archive").isNull()).collect()
    assert sorted(tuple(r) for r in rows) == sorted((n, c, len(c.encode()), R.extension_of(n), None, kind == "plain") for n, c in FILES)
    n_splits = len(R.RepositoryReader({"path": str(folder / kind), "split_bytes": split}).partitions())
    assert n_splits == (6 if kind == "tar.gz" else n_splits) and (n_splits > 12 or split > 300 or kind == "tar.gz")


def test_languages_and_paths(spark, folder):
    files = R.read_repository(spark, str(folder / "zip"), languages=["python"], prefix="src/a/")
    assert {r["file_path"] for r in files.collect()} == {n for n, _ in FILES if n.startswith("src/a/") and n.endswith(".py")}
    assert files.where("error is not null").count() == 0
    assert R.read_repository(spark, str(folder)).count() == 4 * len(FILES)


def test_filters_reach_the_reader(monkeypatch, folder):
    opened = []
    monkeypatch.setattr(zipfile.ZipFile, "read", lambda self, m, *a: opened.append(m.filename) or b"x")
    reader = R.RepositoryReader({"path": str(folder / "zip"), "split_bytes": 500})
    tests = [R.In(("extension",), (".py", ".go")), R.Not(R.EqualTo(("extension",), ".go")), R.StringStartsWith(("file_path",), "src/a"),
             R.StringEndsWith(("archive",), ".zip"), R.EqualTo(("code",), "y"), R.EqualTo(("file_path",), None)]
    assert list(reader.pushFilters(tests)) == tests[4:]
    rows = [r for s in reader.partitions() for b in reader.read(s) for r in b.to_pylist()]
    want = sorted(n for n, _ in FILES if n.startswith("src/a") and n.endswith(".py"))
    assert sorted(opened) == want == sorted(r["file_path"] for r in rows)
    assert not list(R.RepositoryReader.pushFilters(reader, [R.EqualTo(("archive",), "none.zip")]))
    assert [s.names for s in reader.partitions()] == [[]]


def test_what_cannot_be_read(spark, tmp_path):
    (tmp_path / "bad.zip").write_bytes(b"no zip" * 100)
    (tmp_path / "bad.tar").write_bytes(b"no tar" * 100)
    (tmp_path / "empty.py").write_bytes(b"")
    (tmp_path / "bytes.py").write_bytes(b"a\xffb")
    (tmp_path / "._tmp-1-part.zip").write_bytes(b"half")
    whole = io.BytesIO()
    with tarfile.open(fileobj=whole, mode="w") as t:
        for n in ("one.py", "two.py"):
            m = tarfile.TarInfo(n)
            m.size = 3000
            t.addfile(m, io.BytesIO(b"x" * 3000))
        t.addfile(tarfile.TarInfo("empty.py"))
    (tmp_path / "cut.tgz").write_bytes(gzip.compress(whole.getvalue()[:5000]))
    (tmp_path / "x.tar").write_bytes(whole.getvalue())
    with zipfile.ZipFile(tmp_path / "crc.zip", "w") as z:
        z.writestr("a.py", "hello")
    data = bytearray((tmp_path / "crc.zip").read_bytes())
    data[data.index(b"hello")] = 0x4A
    (tmp_path / "crc.zip").write_bytes(data)
    rows = R.read_repository(spark, str(tmp_path), split_bytes=64, max_bytes=2999)
    files, errors = rows.where("error is null"), rows.where("error is not null")
    assert {(r["archive"], r["file_path"], r["code"]) for r in files.collect()} == {
        (None, "empty.py", ""), (None, "bytes.py", "a�b"), ("x.tar", "empty.py", "")}
    got = {(r["archive"], r["file_path"]): r["error"] for r in errors.collect()}
    assert {("bad.zip", None), ("crc.zip", "a.py"), ("x.tar", "one.py"), ("x.tar", "two.py"), ("cut.tgz", "one.py")} <= set(got)
    assert "BadZipFile" in got["bad.zip", None] and "larger" in got["x.tar", "one.py"]
    assert any(a == "bad.tar" for a, _ in got) and errors.where("archive = 'bad.zip'").count() == 1
    some = R.read_repository(spark, str(tmp_path), languages=["python"], prefix="e", split_bytes=64)  # broken archives are told
    assert some.where("archive = 'bad.zip'").count() == 1
    assert {r["file_path"] for r in some.where("error is null").collect()} == {"empty.py"}


def test_empty_folder_and_empty_table(spark, tmp_path):
    none = spark.createDataFrame([], "file_path string, code string")
    assert R.write_archives(none, str(tmp_path / "z")) == 0
    (tmp_path / "y").mkdir()
    assert R.read_repository(spark, str(tmp_path / "y")).count() == 0
