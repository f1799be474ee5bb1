"""Files read by many splits: line numbers and quoted records as a sequential reader gives them."""

import csv
import io
import os
import random

import pytest

from linecraft.sources import splits as SP
from linecraft.sources import textfiles as TF


@pytest.fixture()
def small_splits(spark):
    conf = {"spark.sql.files.maxPartitionBytes": "2000", "spark.sql.files.openCostInBytes": "0"}
    old = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def _write(folder, files):
    os.makedirs(folder)
    for name, data in files.items():
        with open(os.path.join(folder, name), "wb") as f:
            f.write(data)
    return folder


def _lines(files):
    out = []
    for name in sorted(files):
        out += [x for x in files[name].decode("utf-8", "ignore").splitlines() if x]
    return out


def test_line_numbers_are_sequential(spark, tmpdir_path, small_splits):
    rnd = random.Random(3)
    breaks = ["\n", "\r\n", "\n\n", "\x0b", "\x0c", "\x1c", "\x1e", "\x85", " ", " ", "\r"]
    files = {}
    for name in ("b.txt", "a.txt", "c.txt"):
        files[name] = "".join("".join(rnd.choices("abé漢 ", k=rnd.randint(0, 60))) + rnd.choice(breaks)
                              for _ in range(600)).encode()
    files["b.txt"] = b"\xef\xbb\xbf" + files["b.txt"]        # a byte-order mark, kept as Python keeps it
    files["c.txt"] += b"x" * 9000 + b"\nlast\xff\xfe line"   # longer than a split; bytes that don't decode
    files["e.txt"] = b""
    root = _write(os.path.join(tmpdir_path, "t"), files)
    got = TF.read_file_lines(spark, root, max_chars=None)
    assert got.rdd.getNumPartitions() > 20
    rows = sorted((r.line_no, r.text) for r in got.collect())
    assert [n for n, _ in rows] == list(range(len(rows)))
    assert [t for _, t in rows] == _lines(files)
    cut = TF.read_file_lines(spark, root).collect()
    assert max(len(r.text) for r in cut) == 200 and len(cut) == len(rows)
    plain = SP.numbered_lines(spark, root, marks=False).collect()
    assert [r.text for r in sorted(plain, key=lambda r: r.line_no)] == [t.lstrip("﻿") for t in _lines(files) if t != "﻿"]


def test_lines_are_not_shuffled(spark, tmpdir_path, small_splits):
    root = _write(os.path.join(tmpdir_path, "t"), {"a.txt": b"one\ntwo\n" * 2000})
    plan = TF.read_file_lines(spark, root)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "rangepartitioning" not in plan and "BroadcastHashJoin" in plan


def test_many_splits_meet_by_a_plain_join(spark, tmpdir_path, small_splits, monkeypatch):
    monkeypatch.setattr(SP, "MAX_BROADCAST_SPLITS", 3)
    files = {"a.txt": b"\xef\xbb\xbf" + "".join(f"line {i}\n" for i in range(3000)).encode()}
    root = _write(os.path.join(tmpdir_path, "t"), files)
    rows = sorted((r.line_no, r.text) for r in TF.read_file_lines(spark, root).collect())
    assert [t for _, t in rows] == _lines(files) and [n for n, _ in rows] == list(range(3000))


def test_no_lines_is_an_error(spark, tmpdir_path):
    root = _write(os.path.join(tmpdir_path, "t"), {"a.txt": b"\n\n\r\n", "b.txt": b""})
    with pytest.raises(ValueError, match="No lines"):
        TF.read_file_lines(spark, root)


def test_dictionary_numbers_run_over_files(spark, tmpdir_path):
    root = _write(os.path.join(tmpdir_path, "t"), {"a.txt": b"x\n\ny\n", "b.txt": b"z\r\nw"})
    got = sorted((r.word_no, r.word) for r in TF.read_dict(spark, root, "en").collect())
    assert got == [(0, "x"), (1, "y"), (2, "z"), (3, "w")]


@pytest.mark.parametrize("seed", range(3))
def test_quoted_records_over_splits(spark, tmpdir_path, small_splits, seed):
    rnd = random.Random(seed)
    files, want = {}, []
    for name in ("a.csv", "b.csv"):
        rows = [(f"{name}{i}.jpg", "".join(rnd.choices(['a', 'é', '"', '\n', ',', ' ', '""', "\n\n", "z" * 30],
                                                       k=rnd.randint(1, 12)))) for i in range(400)]
        rows.append((f"{name}long.jpg", "line\n" * 2500 + '"end"'))  # one record over several splits
        rows.append((f"{name}after.jpg", "x"))
        out = io.StringIO()
        w = csv.writer(out, lineterminator="\r\n" if seed == 1 else "\n")
        w.writerow(["file_name", "text"])
        w.writerows(rows)
        files[name] = out.getvalue().encode()
        want += rows
    root = _write(os.path.join(tmpdir_path, "t"), files)
    got = TF.read_metadata(spark, root)
    assert sorted((r.file_name, r.text) for r in got.collect()) == sorted(want)


def test_metadata_empty_and_header_only(spark, tmpdir_path):
    root = _write(os.path.join(tmpdir_path, "t"), {"a.csv": b"file_name,text\n", "b.csv": b"", "c.csv": b"file_name,text\nx,\n"})
    assert [tuple(r) for r in TF.read_metadata(spark, root).collect()] == [("x", None)]
