"""Whole texts as sequences in which every stage of the search can be told in SQL.

A special base after every 19 letters leaves no seed in the texts themselves. In the middle stand
three elements made from the document's id: an outer one around two inner ones, with one or two
bases of some arms replaced. Eight special bases on either side of each arm stop every extension
there, and an extension across a replaced base always gains, so the arms are known however they
are found: the SQL reads them off, and needs no extension of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palindra.functions import sequence
from palindra.operators import distance, overlap, tsd
from palindra.plans import catalog, pipeline
from palindra.plans.params import Params
from palindra.sources.shared import new_folder
from palindra.streaming import sweep

WALL = "N" * 8
#: Longer duplications and closer arms: many rows are skipped, first rows of files among them.
STRICT = Params(min_tsd=5, similar=75.0)
#: Of each element: letters of its parts, length of its arms, and the bases replaced (each from 0, with a condition).
ELEMENTS = {
    "p": ("30 + doc_id % 20", [("20", "doc_id % 2 = 0")], "doc_id % 5 <> 0"),
    "x": ("26 + doc_id % 30", [("21", "doc_id % 4 < 2"), ("24", "doc_id % 30 >= 14 AND doc_id % 4 = 1")], "doc_id % 3 <> 0"),
    "y": ("26 + doc_id % 7", [("20", "doc_id % 3 = 0")], "doc_id % 7 <> 0"),
}


#: Elements whose arms differ by a base that only one of them has, always other than the one after it: (which
#: arm has it, before which base, condition). The only alignment of all bases of both arms is also the best.
GAPPED = {
    "p": ("30 + doc_id % 20", [("two", "20", "doc_id % 2 = 0")], "doc_id % 5 <> 0"),
    "x": ("26 + doc_id % 30", [("one", "21", "doc_id % 4 < 2"), ("two", "41", "doc_id % 30 >= 24 AND doc_id % 4 = 1")], "doc_id % 3 <> 0"),
    "y": ("26 + doc_id % 7", [("one", "20", "doc_id % 3 = 0"), ("two", "20", "doc_id % 3 = 1")], "doc_id % 7 <> 0"),
}
#: Scores under which a mismatch, an insertion and a deletion are 8, 4 and 5 units away: as near that the wrong gap never does as well.
UNEVEN = Params(mismatch=-6, insertion=-3, deletion=-4)


def _made(tag: str, n: str) -> str:
    """SQL for ``n`` bases that depend on the document's id, in either dialect."""
    return f"substr(translate(concat(md5(concat('{tag}1', CAST(doc_id AS VARCHAR(30)))), md5(concat('{tag}2', CAST(doc_id AS VARCHAR(30))))), '0123456789abcdef', 'ACGTACGTACGTACGT'), 1, {n})"


def _parts(elements: dict) -> dict[str, str]:
    """SQL for the arms, spacers and duplications of the elements, in either dialect."""
    out = {}
    for tag, (length, changes, duplicated) in elements.items():
        arm = _made(f"{tag}a", f"CAST({length} AS INT)")
        arms = {"one": arm, "two": arm}
        for change in changes:
            which, at, when = change if len(change) == 3 else ("two", *change)
            copy, other = arms[which], f"translate(substr({arm}, {at} + 1, 1), 'ACGT', 'CGTA')"
            rest = f"{at} + 1" if len(change) == 3 else f"{at} + 2"
            arms[which] = f"CASE WHEN {when} THEN concat(substr({copy}, 1, {at}), {other}, substr({copy}, {rest})) ELSE {copy} END"
        out[f"{tag}_one"], out[f"{tag}_two"] = arms["one"], f"reverse(translate({arms['two']}, 'ACGT', 'TGCA'))"
        out[f"{tag}_space"], out[f"{tag}_left"] = _made(f"{tag}s", "15"), _made(f"{tag}d", "5")
        out[f"{tag}_right"] = f"CASE WHEN {duplicated} THEN {_made(f'{tag}d', '5')} ELSE {_made(f'{tag}e', '5')} END"
    return out


#: The order of the parts between the halves of a text, walls between all of them.
_ORDER = ["p_left", "p_one", "x_left", "x_one", "x_space", "x_two", "x_right", "y_left", "y_one", "y_space", "y_two", "y_right", "p_two", "p_right"]


def walled(spark: SparkSession, sf_dir: str, elements: dict | None = None) -> DataFrame:
    """(doc_id, s, offset): the sequences, and the first base after the laced first half of the text."""
    lace = lambda s: F.regexp_replace(s, "(.{19})", "$1N")
    half = F.floor(F.length("s") / 2).cast("int")
    rows = catalog.dna(spark, sf_dir).withColumn("s", F.coalesce("s", F.lit(""))).select("doc_id", lace(F.substr("s", F.lit(1), half)).alias("h"), lace(F.substr("s", half + 1)).alias("t"), *[F.expr(v).alias(k) for k, v in _parts(elements or ELEMENTS).items()])
    middle = F.concat_ws(WALL, F.col("h"), *_ORDER, F.col("t"))
    return rows.select("doc_id", middle.alias("s"), F.length("h").cast("long").alias("offset"))


def _contigs(spark: SparkSession, sf_dir: str, elements: dict | None = None) -> DataFrame:
    file = F.concat(F.lit("f"), (F.col("contig_no") % 16).cast("string"))
    return catalog.contigs(walled(spark, sf_dir, elements)).withColumn("file", file)


def _arms_at() -> str:
    """SQL rows (tag, first and last base of both arms) of a document."""
    at, before = {}, []
    for name in _ORDER:
        before.append(str(len(WALL)))
        at[name] = " + ".join(["off", *before])
        before.append(f"length({name})")
    rows = [f"SELECT doc_id, s, {at[f'{t}_one']} AS lts, {at[f'{t}_one']} + length({t}_one) - 1 AS lte, {at[f'{t}_two']} AS rts, {at[f'{t}_two']} + length({t}_two) - 1 AS rte FROM made" for t in ELEMENTS]
    return " UNION ALL ".join(rows)


def _sql(p: Params, elements: dict | None = None) -> str:
    """All stages; k-mers are taken around the elements only, as any other holds a special base."""
    lace = lambda s: f"regexp_replace({s}, '(.{{19}})', '\\1N', 'g')"
    least, most, vic = p.min_tsd, p.max_tsd, p.vicinity
    parts = ", ".join(f"{v} AS {k}" for k, v in _parts(elements or ELEMENTS).items())
    return f"""WITH {catalog.DNA_SQL},
halves AS (SELECT doc_id, {lace("substr(s, 1, length(s) // 2)")} AS h, {lace("substr(s, length(s) // 2 + 1)")} AS t, {parts} FROM (SELECT doc_id, coalesce(s, '') AS s FROM dna)),
made AS (SELECT *, length(h) AS off, concat_ws('{WALL}', h, {", ".join(_ORDER)}, t) AS s FROM halves),
known AS ({_arms_at()}),
k AS (SELECT doc_id, a, kmer FROM (SELECT doc_id, a, substr(s, a + 1, {p.seed}) AS kmer FROM (SELECT doc_id, s, unnest(range(greatest(off - {p.seed}, 0), least(length(s) - length(t) + 1, length(s) - {p.seed - 1}))) AS a FROM made)) WHERE instr(kmer, 'N') = 0),
m AS (SELECT x.doc_id, x.a, y.a AS b, x.a + y.a AS d FROM k x JOIN k y ON x.doc_id = y.doc_id AND x.kmer = reverse(translate(y.kmer, 'ACGT', 'TGCA')) AND y.a - x.a BETWEEN {p.band[0]} AND {p.band[1]}),
r AS (SELECT *, a - row_number() OVER (PARTITION BY doc_id, d ORDER BY a) AS island FROM m),
runs AS (SELECT doc_id, min(a) AS a, d - max(a) AS b, max(a) - min(a) + {p.seed} AS len FROM r GROUP BY doc_id, d, island),
seeds AS (SELECT * FROM runs WHERE len BETWEEN {p.seed} AND {p.max_arm} AND b - a BETWEEN {p.min_distance} AND {p.max_distance}),
arms AS (SELECT z.doc_id, z.a, z.b, z.len, w.s, w.lts, w.lte, w.rts, w.rte, z.a - w.lts AS li, w.rte - (z.b + z.len - 1) AS lj, w.lte - (z.a + z.len - 1) AS ri, z.b - w.rts AS rj
  FROM seeds z JOIN known w ON z.doc_id = w.doc_id AND z.a BETWEEN w.lts AND w.lte),
passed AS (SELECT *, len - 2 + ri + lj AS arm_length, greatest(0, lts - {vic}) AS ls, greatest(rts, rte - {vic}) AS rs FROM arms WHERE len - 2 + ri + lj BETWEEN {p.min_arm} AND {p.max_arm}),
flanks AS (SELECT *, translate(substr(s, ls + 1, least(lte, lts + {vic}) - ls + 1), 'N', '[') AS lw, translate(substr(s, rs + 1, least(length(s) - 1, rte + {vic}) - rs + 1), 'N', ']') AS rw FROM passed),
c AS (SELECT *, len(list_filter(range(2, {most + 1}), lambda n: p + n <= length(lw) AND q + n <= length(rw) AND substr(lw, p + 1, n) = substr(rw, q + 1, n))) + 1 AS m
  FROM (SELECT *, unnest(range(0, length(rw) - 1)) AS q FROM (SELECT *, unnest(range(0, length(lw) - 1)) AS p FROM flanks))
  WHERE substr(lw, p + 1, 2) = substr(rw, q + 1, 2) AND (p = 0 OR q = 0 OR substr(lw, p, 1) <> substr(rw, q, 1))),
e AS (SELECT *, row_number() OVER (PARTITION BY doc_id, a, b, len ORDER BY abs(lts - (ls + p + m - 1)) + abs(rte - (rs + q)), q, substr(lw, p + 1) || '~') AS place FROM c WHERE m BETWEEN {least} AND {most - 1}),
tsd AS (SELECT f.doc_id, f.a, f.b, f.len, f.s, coalesce(f.ls + e.p + e.m, f.lts)::BIGINT AS lts, f.lte::BIGINT AS lte, f.rts::BIGINT AS rts, coalesce(f.rs + e.q - 1, f.rte)::BIGINT AS rte, f.rte AS rte0, coalesce(e.m, 0)::BIGINT AS tsd
  FROM flanks f LEFT JOIN e ON e.place = 1 AND f.doc_id = e.doc_id AND f.a = e.a AND f.b = e.b AND f.len = e.len),
duplicated AS (SELECT *, tsd = 0 OR rte <= rts OR lte <= lts OR rte0 <= rts AS skip FROM tsd),
strings AS (SELECT *, CASE WHEN NOT skip THEN substr(s, lts + 1, lte - lts) END AS left_arm, reverse(translate(substr(s, rts + 2, rte0 - rts), 'ACGT', 'TGCA')) AS right_arm FROM duplicated),
edits AS (SELECT * EXCLUDE (skip), skip AS before, CASE WHEN levenshtein(left_arm, right_arm) <= floor(greatest(length(left_arm), length(right_arm)) * {100.0 - p.similar} / 100.0) + 2 THEN levenshtein(left_arm, right_arm) END::INT AS edit_distance FROM strings),
compared AS (SELECT *, before OR coalesce(sim < {p.similar}, true) AS skip FROM (SELECT *, 100.0::DOUBLE * (1.0::DOUBLE - edit_distance::DOUBLE / greatest(length(left_arm), length(right_arm))) AS sim FROM edits)),
ranked AS (SELECT *, 'f' || doc_id % 16 AS file, row_number() OVER (PARTITION BY doc_id % 16 ORDER BY doc_id, lts, rts, a, b, len) AS place FROM compared),
swept AS (SELECT *, max(rte) OVER (PARTITION BY doc_id ORDER BY lts, rts, a, b, len ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM ranked WHERE NOT skip OR place = 1),
clustered AS (SELECT * FROM (SELECT *, sum(CASE WHEN reach IS NULL OR lts > reach THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY lts, rts, a, b, len)::BIGINT AS cluster FROM swept) WHERE NOT skip),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, cluster ORDER BY sim DESC, lts, rts, a, b, len) AS k FROM clustered) WHERE k = 1),
elements AS (SELECT 'doc' || doc_id AS seqid, lts - tsd + 1 AS full_start, rte + tsd + 1 AS full_stop, lts - tsd + 1 AS tsd1_start, lts AS tsd1_stop, lts + 1 AS body_start, rte + 1 AS body_stop,
  lts + 1 AS tir1_start, lte + 1 AS tir1_stop, rts + 1 AS tir2_start, rte + 1 AS tir2_stop, rte + 2 AS tsd2_start, rte + tsd + 1 AS tsd2_stop, sim FROM best)
"""


_SEED = "doc_id AS contig_no, a::BIGINT AS a, b::BIGINT AS b, len::BIGINT AS len"
_KEYS = ["contig_no", "a", "b", "len"]


def _stage(spark: SparkSession, sf_dir: str, name: str, p: Params | None = None, elements: dict | None = None) -> DataFrame:
    return pipeline.stages(_contigs(spark, sf_dir, elements), p)[name]


def _register() -> None:
    usual, strict, query = _sql(catalog.P), _sql(STRICT), catalog.query
    ends, strings = ["lts", "lte", "rts", "rte", "tsd", "skip"], ["left_arm", "right_arm", "edit_distance", "sim"]

    @query("xdrop_extend_walled", usual + f"SELECT {_SEED}, li::BIGINT AS li, lj::BIGINT AS lj, ri::BIGINT AS ri, rj::BIGINT AS rj FROM arms")
    def xdrop_extend_walled(spark, sf_dir):
        return _stage(spark, sf_dir, "arms").select(*_KEYS, "li", "lj", "ri", "rj")

    gaps = _sql(catalog.P, GAPPED)
    for name, p, sql in (("xdrop_extend_gaps_walled", None, gaps), ("xdrop_extend_scores_walled", UNEVEN, _sql(UNEVEN, GAPPED))):

        @query(name, sql + f"SELECT {_SEED}, li::BIGINT AS li, lj::BIGINT AS lj, ri::BIGINT AS ri, rj::BIGINT AS rj FROM arms")
        def xdrop_extend_gaps_walled(spark, sf_dir, p=p):
            """Arms with inserted and deleted bases, under the usual and under uneven scores."""
            return _stage(spark, sf_dir, "arms", p, GAPPED).select(*_KEYS, "li", "lj", "ri", "rj")

    @query("find_elements_gaps_walled", gaps + "SELECT * FROM elements")
    def find_elements_gaps_walled(spark, sf_dir):
        return pipeline.find_elements(_contigs(spark, sf_dir, GAPPED)).drop("file")

    @query("length_gate_walled", usual + f"SELECT {_SEED}, arm_length::BIGINT AS arm_length FROM passed")
    def length_gate_walled(spark, sf_dir):
        return _stage(spark, sf_dir, "passed").select(*_KEYS, "arm_length")

    for name, p, sql in (("tsd_search_walled", None, usual), ("tsd_search_strict_walled", STRICT, strict)):

        @query(name, sql + f"SELECT {_SEED}, {', '.join(ends)} FROM duplicated")
        def tsd_search_walled(spark, sf_dir, p=p):
            return _stage(spark, sf_dir, "duplicated", p).select(*_KEYS, *ends)

    for name, p, sql in (("arm_pairs_walled", None, usual), ("arm_pairs_strict_walled", STRICT, strict)):

        @query(name, sql + f"SELECT {_SEED}, {', '.join(strings)}, skip FROM compared WHERE left_arm IS NOT NULL")
        def arm_pairs_walled(spark, sf_dir, p=p):
            """The strings that the similarity gate compares, and which rows it skips."""
            return _stage(spark, sf_dir, "compared", p).where("left_arm IS NOT NULL").select(*_KEYS, *strings, "skip")

    @query("clusters_strict_walled", strict + f"SELECT {_SEED}, cluster FROM clustered")
    def clusters_strict_walled(spark, sf_dir):
        """Clusters where the first rows of some files are skipped and bridge live ones."""
        return _stage(spark, sf_dir, "clustered", STRICT).select(*_KEYS, "cluster")

    @query("first_rows_strict_walled", strict + f"SELECT file, {_SEED}, lts, rte, skip FROM ranked WHERE place = 1")
    def first_rows_strict_walled(spark, sf_dir):
        """The first row of each file, which takes part in the sweep even where it is skipped."""
        return overlap.first_of_file(_stage(spark, sf_dir, "compared", STRICT)).select("file", *_KEYS, "lts", "rte", "skip")

    for name, p, sql in (("find_elements_walled", None, usual), ("find_elements_strict_walled", STRICT, strict)):

        @query(name, sql + "SELECT * FROM elements")
        def find_elements_walled(spark, sf_dir, p=p):
            return pipeline.find_elements(_contigs(spark, sf_dir), p).drop("file")

    @query("sweep_stream", strict + f"SELECT file, {_SEED}, lts, lte, rts, rte, tsd, sim FROM best")
    def sweep_stream(spark, sf_dir):
        """The best of each cluster by the streaming sweep: candidates come in four files, cut within contigs, whose rows
        beyond the cut come late."""
        rows = sweep.with_ends(_stage(spark, sf_dir, "narrow", STRICT).select("file", *sweep.COLUMNS, "skip"))
        folder, slices = new_folder(spark, "candidates"), 4
        last = F.lit((rows.agg(F.max("contig_no")).first()[0] or 0) + 1)
        slice_ = F.when(F.col("ended"), slices - 1).otherwise(F.least(F.lit(slices - 1), F.floor((2 * F.col("contig_no") + F.col("a") % 2 + 1) * slices / (2 * last)).cast("int")))
        rows = rows.withColumn("slice", slice_).persist()
        for k in range(slices):  # one after another: a stream takes files by when they were written
            rows.where(F.col("slice") == k).drop("slice").coalesce(1).write.mode("append").parquet(folder)
        rows.unpersist()
        out = new_folder(spark, "swept")
        sweep.start_sweep(spark, folder, out, new_folder(spark, "log"), sweep.disorder(STRICT)).awaitTermination()
        return spark.read.schema(f"file string, {sweep._ROW}").parquet(out).select("file", *_KEYS, "lts", "lte", "rts", "rte", "tsd", "sim")

    @query("tsd_candidates", usual + f"SELECT {_SEED}, p::INT AS p, q::INT AS q, m::INT AS m FROM c")
    def tsd_candidates(spark, sf_dir):
        found = tsd.candidates(catalog.flanks(_stage(spark, sf_dir, "passed")), catalog.P.min_tsd, catalog.P.max_tsd, "lw", "rw")
        return found.select(*_KEYS, *[F.col(c).cast("int").alias(c) for c in "pqm"])

    @query("best_tsd", usual + f"SELECT {_SEED}, (abs(lts - (ls + p + m - 1)) + abs(rte - (rs + q)))::BIGINT AS cost, (ls + p)::BIGINT AS p, (rs + q)::BIGINT AS q, m::BIGINT AS m FROM e WHERE place = 1")
    def best_tsd(spark, sf_dir):
        found = tsd.candidates(catalog.flanks(_stage(spark, sf_dir, "passed")), catalog.P.min_tsd, catalog.P.max_tsd, "lw", "rw")
        return tsd.best_of_candidates(found, _KEYS, catalog.P, "lw")

    for name, p, sql in (("arm_similarity", None, usual), ("arm_similarity_gaps", None, gaps)):

        @query(name, sql + f"SELECT {_SEED}, edit_distance, sim FROM compared WHERE left_arm IS NOT NULL")
        def arm_similarity(spark, sf_dir, elements=GAPPED if name.endswith("gaps") else ELEMENTS):
            return _stage(spark, sf_dir, "compared", None, elements).where("left_arm IS NOT NULL").select(*_KEYS, "edit_distance", "sim")

    @query("arm_distances", gaps + f"SELECT {_SEED}, levenshtein(left_arm, right_arm)::BIGINT AS bits, least(levenshtein(left_arm, right_arm), 2)::BIGINT AS furthest FROM compared WHERE left_arm IS NOT NULL")
    def arm_distances(spark, sf_dir):
        """The distance of all arm pairs by bit-parallel columns, and by furthest-reaching diagonals in a band of 1."""
        rows = _stage(spark, sf_dir, "compared", None, GAPPED).where("left_arm IS NOT NULL")
        left, right = F.col("left_arm"), F.col("right_arm")
        return rows.select(*_KEYS, distance.bit_distance(left, right).alias("bits"), distance.furthest_distance(left, right, F.lit(1).cast("long")).alias("furthest"))

    @query("similarity_gate", usual + f"SELECT {_SEED}, edit_distance, sim FROM compared WHERE NOT skip")
    def similarity_gate(spark, sf_dir):
        return _stage(spark, sf_dir, "compared").where("NOT skip").select(*_KEYS, "edit_distance", "sim")

    @query("element_coords", usual + "SELECT * EXCLUDE (seqid, sim), seqid[4:]::BIGINT AS contig_no FROM elements")
    def element_coords(spark, sf_dir):
        return pipeline.element_columns(_stage(spark, sf_dir, "best")).drop("file", "sim")

    @query("elements_formatted_walled", usual + "SELECT * EXCLUDE (sim), printf('%.2f', sim) AS sim FROM elements")
    def elements_formatted_walled(spark, sf_dir):
        return pipeline.formatted(pipeline.find_elements(_contigs(spark, sf_dir))).drop("file")


_register()
