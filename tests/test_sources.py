"""Splitting sequence files against plain Python, over one, a few and many splits, plain and compressed."""

import gzip
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.sources import volumes
from helixframe.sources.sequences import read_fasta, read_fastq, split_records


def block_gzip(data: bytes, size: int) -> bytes:
    """Members with their size in an extra field, and the empty one that ends such files."""
    out = b""
    for at in [*range(0, len(data), size), None]:
        part = b"" if at is None else data[at : at + size]
        c = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = c.compress(part) + c.flush()
        out += struct.pack("<4BI2BH2BHH", 31, 139, 8, 4, 0, 0, 255, 6, 66, 67, 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(part), len(part))
    return out


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    """Three files of each kind: records with blank ones between, empty sequences, qualities that begin with @ and +, both line ends."""
    folder, rng = tmp_path_factory.mktemp("sequences"), np.random.default_rng(4)
    want = {"fa": [], "fq": []}
    for n in range(3):
        fa, fq = [], []
        for i in range(40):
            s = "".join(rng.choice(list("ACGT"), int(rng.integers(0, 60))))
            end = "\r\n" if n == 1 else "\n"
            fa.append(f">r{n}_{i} x y{end}{s[:20]}{end}{s[20:]}{end}" + (">\n" if i % 7 == 3 else ""))
            q = "".join(rng.choice(list("@+!I"), len(s)))
            fq.append(f"@r{n}_{i} x y{end}{s}{end}+{end}{q}{end}" + ("\n" if i % 9 == 4 else ""))
            want["fa"].append((40 * n + i, f"r{n}_{i}", "x y", s, None))
            want["fq"].append((40 * n + i, f"r{n}_{i}", "x y", s, q))
        for end, text in (("fa", "".join(fa)), ("fq", "".join(fq))):
            (folder / f"plain{n}.{end}").write_bytes(text.encode())
            (folder / f"gz{n}.{end}.gz").write_bytes(gzip.compress(text.encode()))
            (folder / f"block{n}.{end}.gz").write_bytes(block_gzip(text.encode(), 137))
    return folder, want


@pytest.mark.parametrize("kind,ending", [("plain", ""), ("gz", ".gz"), ("block", ".gz")])
@pytest.mark.parametrize("size", [10**9, 1500, 40])
def test_rows_do_not_depend_on_splits(spark, files, kind, ending, size):
    folder, want = files
    for read, end in ((read_fasta, "fa"), (read_fastq, "fq")):
        got = read(spark, [f"{folder}/{kind}{n}.{end}{ending}" for n in range(3)], size)
        assert [tuple(r) for r in got.orderBy("read_id").collect()] == want[end]


def test_blank_records_take_no_id(spark, tmp_path):
    (tmp_path / "1.fa").write_text(">a\nAC\n>\n>b\nGT\n")
    (tmp_path / "2.fa").write_text(">c\nAC\n>d\nTT")
    assert [(r.name, r.read_id, r.seq) for r in read_fasta(spark, str(tmp_path)).orderBy("read_id").collect()] == [("a", 0, "AC"), ("b", 1, "GT"), ("c", 2, "AC"), ("d", 3, "TT")]


def test_tests_of_name_and_length_go_to_the_reader(spark, files):
    folder, want = files
    path = [f"{folder}/plain{n}.fq" for n in range(3)]
    tests = [F.col("length") >= 30, F.col("length") < 50, F.col("name").startswith("r1_")]
    got = read_fastq(spark, path, 700, *tests)
    assert [tuple(r) for r in got.orderBy("read_id").collect()] == [r for r in want["fq"] if 30 <= len(r[3]) < 50 and r[1].startswith("r1_")]
    plan = split_records(spark, path, "fastq").where(tests[0]).where(tests[1]).where(tests[2])._jdf.queryExecution().executedPlan().toString()
    assert "Filter (" not in plan and "StartsWith" not in plan
    some = split_records(spark, path, "fastq").where(F.col("name").isin("r0_1", "r2_5") & F.col("seq").contains("A"))
    assert {r.name for r in some.collect()} == {r[1] for r in want["fq"] if r[1] in ("r0_1", "r2_5") and "A" in r[3]}


def test_no_bases_are_shuffled(spark, files):
    plan = read_fastq(spark, f"{files[0]}/plain0.fq")._jdf.queryExecution().executedPlan().toString()
    shuffled = [line for line in plan.splitlines() if "Exchange" in line and "Broadcast" not in line]
    assert all("seq" not in line for line in shuffled) and "SortMergeJoin" not in plan


def test_an_empty_file_and_a_record_that_is_cut_short(spark, tmp_path):
    (tmp_path / "empty.fa").write_text("")
    assert read_fasta(spark, str(tmp_path / "empty.fa")).count() == 0
    (tmp_path / "cut.fq").write_text("@a\nACGT\n+\n")
    with pytest.raises(Exception, match="bad FASTQ record"):
        read_fastq(spark, str(tmp_path / "cut.fq")).collect()


def test_packing_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 3, 4, 5, 1000):
        data = np.frombuffer("".join(rng.choice(list("ACGTNn-"), n, p=[0.22, 0.22, 0.22, 0.22, 0.06, 0.03, 0.03])).encode(), np.uint8)
        packed, runs = volumes.pack(data)
        assert len(packed) == -(-n // 4) and (volumes.unpack(packed, n, runs) == data).all()


def test_volumes(spark, tmp_path, monkeypatch):
    """Volumes cut by bases, other letters, empty and null reads, runs of letters across pieces, appended and merged folders."""
    monkeypatch.setattr(volumes, "READS", 3)
    rng = np.random.default_rng(2)
    rows = [(i, "".join(rng.choice(list("ACGTN"), int(n), p=[0.2, 0.2, 0.2, 0.2, 0.2]))) for i, n in enumerate(rng.integers(0, 40, 60))] + [(60, None), (61, ""), (62, "N" * 50), (63, "N" * 10)]
    df = spark.createDataFrame(rows, "read_id long, seq string").repartitionByRange(2, "read_id")
    where = f"file://{tmp_path}/v"
    volumes.write_volumes(df, where, 200)
    files = volumes._manifest(where)["files"]
    assert all(f["bases"] >= 200 for f in files if f["part"] + 1 < sum(g["task"] == f["task"] for g in files)) and len(files) > 5
    want = [(i, s or "") for i, s in rows]
    assert [tuple(r) for r in volumes.read_volumes(spark, where).orderBy("read_id").select("read_id", "seq").collect()] == want
    other = f"file://{tmp_path}/one"
    volumes.write_volumes(spark.createDataFrame([(0, "ACG")], "read_id long, seq string"), other)
    volumes.write_volumes(spark.createDataFrame([(1, "T")], "read_id long, seq string"), other, mode="append")
    merged = volumes.read_volumes(spark, other, where, other)
    assert [tuple(r) for r in merged.orderBy("read_id").select("read_id", "seq").collect()] == [(0, "ACG"), (1, "T"), *[(i + 2, s) for i, s in want], (66, "ACG"), (67, "T")]
    assert volumes.read_volumes(spark, f"file://{tmp_path}/nothing").count() == 0


def test_reads_at_offsets(spark):
    reads = spark.createDataFrame([(5, "ACG"), (9, ""), (11, None), (20, "TTTT"), (21, "A")], "read_id long, seq string")
    offsets = spark.createDataFrame([(x,) for x in (-1, 0, 2, 3, 6, 7, 8, 100)], "offset long")
    got = {r.offset: (r.read_id, r.place) for r in volumes.reads_at(offsets, volumes.starts(reads)).collect()}
    assert got == {-1: (None, None), 0: (5, 0), 2: (5, 2), 3: (20, 0), 6: (20, 3), 7: (21, 0), 8: (None, None), 100: (None, None)}
