import random

from palindra.plans.pipeline import find_elements
from palindra.sources.fasta import read_sequences
from palindra.streaming.ingest import watch_fragments


def test_fragments_that_arrive_are_searched_once(spark, tmp_path):
    arm = "".join(random.Random(9).choices("ACGT", k=30))
    back = arm[::-1].translate(str.maketrans("ACGT", "TGCA"))
    (tmp_path / "in").mkdir()
    for k in range(2):
        (tmp_path / f"in/{k}.fa").write_text(f">c{k}\nGGTAC{arm}{'ACCA' * 6}{back}GGTACC\n")
        watch_fragments(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).drop("batch").collect()))
    assert got == sorted(map(tuple, find_elements(read_sequences(spark, str(tmp_path / "in"))).collect())) and len(got) == 2
