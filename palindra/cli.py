"""python -m palindra.cli [options] FILE | --batch DIR FILE...: elements as tab-separated text.

Without --batch the first file's elements go to standard output. With it, paths come from the
arguments or, if there are none, from standard input, one a line, and each fragment gets a file
under DIR, named by its stem and --suffix (.elements.tsv). --stage NAME writes the rows of a stage of the first file instead of its elements:
seeds, arms (reaches), duplicated (pairs with a duplication that are not skipped), compared (pairs
that reach the similarity gate) or pairs (the strings that it compares), in contig coordinates.
--threads N sets the local threads. Counts go to standard error.
"""

from __future__ import annotations

import sys

from palindra.plans.params import FLAGS, Params


#: The stage of the search that each name shows, which of its rows, and their columns.
STAGES = {
    "seeds": ("seeds", "true", ["contig_no", "a", "b", "len"]),
    "arms": ("arms", "true", ["contig_no", "a", "b", "len", "li", "lj", "ri", "rj"]),
    "duplicated": ("duplicated", "NOT skip", ["contig_no", "a", "b", "len", "lts", "lte", "rts", "rte", "tsd"]),
    "compared": ("compared", "left_arm IS NOT NULL", ["contig_no", "a", "b", "len", "edit_distance", "sim"]),
    "pairs": ("compared", "left_arm IS NOT NULL", ["left_arm", "right_arm"]),
}


def parse(args: list[str]) -> tuple[Params, str | None, int, list[str], str | None, str]:
    """(options, batch folder, threads, paths, stage, suffix); ends with status 2 where a value is missing or wrong."""
    names, kinds = {flag: name for name, flag in FLAGS.items()}, {n: type(getattr(Params, n)) for n in Params.names()}
    chosen, batch, threads, paths, stage, suffix, at = {}, None, 0, [], None, ".elements.tsv", 0
    while at < len(args):
        word = args[at]
        if word in ("--batch", "--threads", "--stage", "--suffix") or word in names:
            if at + 1 >= len(args):
                raise SystemExit(2)
            value = args[at + 1]
            try:
                if word == "--batch":
                    batch = value
                elif word == "--threads":
                    threads = int(value)
                elif word == "--suffix":
                    suffix = value
                elif word == "--stage":
                    if value not in STAGES:
                        raise ValueError(value)
                    stage = value
                else:
                    chosen[names[word]] = kinds[names[word]](value)
            except ValueError:
                raise SystemExit(2) from None
            at += 2
        else:
            paths.append(word)
            at += 1
    return Params(**chosen), batch, threads, paths, stage, suffix


def main(args: list[str] | None = None) -> int:
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from palindra.functions.sequence import two_decimals
    from palindra.plans.pipeline import find_elements, stages
    from palindra.sources.fasta import read_sequences
    from palindra.sources.sinks import to_tsv, write_fragments

    params, batch, threads, paths, stage, suffix = parse(sys.argv[1:] if args is None else args)
    if batch and not paths:
        paths = [p for line in sys.stdin if (p := line.strip())]
    if not paths:
        print(__doc__, file=sys.stderr)
        return 2
    spark = SparkSession.builder.master(f"local[{threads or '*'}]").config("spark.ui.enabled", "false").getOrCreate()
    if batch:
        write_fragments(find_elements(read_sequences(spark, paths), params), batch, paths, suffix)
        print(f"{len(paths)} fragments", file=sys.stderr)
    elif stage:
        name, kept, columns = STAGES[stage]
        rows = stages(read_sequences(spark, paths[:1]), params)[name].where(kept).orderBy("contig_no", "a", "b", "len").select(*columns)
        rows = rows.withColumn("sim", two_decimals(F.col("sim"))) if "sim" in columns else rows
        found = rows.collect()
        sys.stdout.write("".join("\t".join(map(str, r)) + "\n" for r in [columns, *found]))
        print(f"{len(found)} {stage}", file=sys.stderr)
    else:
        text = to_tsv(find_elements(read_sequences(spark, paths[:1]), params))
        sys.stdout.write(text)
        print(f"{text.count(chr(10)) - 1} elements", file=sys.stderr)
    return 0


if __name__ == "__main__":
    sys.exit(main())
