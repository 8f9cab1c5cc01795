"""Sequence files in byte ranges against the plain readers."""

import gzip
import random

import pytest

from palindra.sources import fasta, splits

FASTA = """junk before the first record
ACGT
>one some words
acgtNNacg
TTT  GG

>two\tx
>three
A
C
G
>  no id
ACGT ACGT\tACGT
>last"""


def rows(df):
    return sorted(tuple(r) for r in df.select("contig_no", "seqid", "seq").collect())


def plain(spark, text):
    return rows(fasta.parse_fasta(spark.createDataFrame([("f", text)], "file string, value string")))


@pytest.mark.parametrize("size", [5, 64, 1 << 20])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_every_cut_gives_the_same_contigs(spark, tmp_path, size, end):
    text = FASTA.replace("\n", end)
    (tmp_path / "a.fa").write_bytes(text.encode())
    want = plain(spark, text)
    assert [w[1] for w in want] == ["one", "two", "three", "", "last"]
    assert rows(splits.read_split(spark, str(tmp_path / "a.fa"), size)) == want


def test_contigs_longer_than_a_partition_and_than_a_row(spark, tmp_path, monkeypatch):
    rng = random.Random(4)
    seqs = ["".join(rng.choice("ACGTn") for _ in range(n)) for n in (40_000, 3, 0, 25_000)]
    text = "".join(f">c{k} x\n" + "\n".join(s[i : i + 60] for i in range(0, len(s), 60)) + "\n" for k, s in enumerate(seqs))
    (tmp_path / "a.fa").write_text(text)
    found = splits.read_split(spark, f"file://{tmp_path}/a.fa", 1024)
    assert rows(found) == [(k, f"c{k}", s.upper()) for k, s in enumerate(seqs)] == plain(spark, text)
    monkeypatch.setattr(splits, "PIECE", 500)
    monkeypatch.setattr(splits, "CHUNK", 37)
    spans = splits._spans(splits._listed([str(tmp_path / "a.fa")]), 4096)
    pieces = [r for s in spans for b in splits._pieces(s) for r in b.to_pylist()]
    assert max(len(r["piece"]) for r in pieces) < 600 and "".join(r["piece"] for r in pieces) == "".join(seqs).upper()


@pytest.mark.parametrize("size", [11, 50, 1 << 20])
def test_reads_whose_qualities_look_like_headers(spark, tmp_path, size):
    rng = random.Random(5)
    text = "".join(f"@r{k} x\n{''.join(rng.choice('acgt') for _ in range(k % 9 + 1))}\n+\n{'@' * (k % 3 and k % 9 + 1) or '+' * (k % 9 + 1)}\n" for k in range(40))
    (tmp_path / "a.fq").write_text(text)
    want = rows(fasta.parse_fastq(spark.createDataFrame([("f", text)], "file string, value string")))
    assert len(want) == 40 and rows(splits.read_split(spark, str(tmp_path / "a.fq"), size)) == want


def test_gzip_is_told_by_content_and_folders_are_listed(spark, tmp_path):
    (tmp_path / "packed").write_bytes(gzip.compress(FASTA.encode()) + gzip.compress(b"\n>more\nAC\n"))
    (tmp_path / "named.gz").write_text(">plain\nGG\n")
    (tmp_path / "_hidden").write_text(">no\nGG\n")
    (tmp_path / "empty").write_text("")
    found = splits.read_split(spark, str(tmp_path), 16)
    by = {}
    for r in found.collect():
        by.setdefault(r.file.rsplit("/", 1)[1], []).append((r.contig_no, r.seqid, r.seq))
    assert sorted(by["packed"]) == plain(spark, FASTA + "\n>more\nAC\n") and by["named.gz"] == [(0, "plain", "GG")] and set(by) == {"packed", "named.gz"}


def test_no_path_and_missing_files_are_errors(spark, tmp_path):
    with pytest.raises(ValueError):
        splits._Options({"paths": ""})
    with pytest.raises(FileNotFoundError):
        splits._listed([str(tmp_path / "none")])


def test_the_stream_takes_each_new_file_once(spark, tmp_path):
    spark.dataSource.register(splits.SequenceSource)
    folder, out = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()

    def run():
        pieces = spark.readStream.format("sequences").option("paths", str(folder)).option("partitionBytes", "9").load()
        save = lambda df, k: splits.whole_contigs(df).write.mode("overwrite").parquet(f"{out}/batch={k}")
        query = pieces.writeStream.foreachBatch(save).option("checkpointLocation", str(tmp_path / "log")).trigger(processingTime="0 seconds").start()
        query.processAllAvailable()
        query.stop()
        return sorted((r.seqid, r.seq) for r in spark.read.parquet(out).collect())

    (folder / "a").write_text(">a\nACG\nT\n")
    assert run() == [("a", "ACGT")]
    (folder / "b").write_bytes(gzip.compress(b">b\nAC\n>c\nGG"))
    assert run() == [("a", "ACGT"), ("b", "AC"), ("c", "GG")]
