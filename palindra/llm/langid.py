"""Language identification by rank-order n-gram profiles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palindra.llm.common import pieces, read, small_batches

#: n-grams of a profile, and the penalty of one that a profile lacks.
PROFILE = 400
#: Bits of a code point in an n-gram's key; 0 stands for whatever is not a letter.
SHIFT = 21


def ngrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, n-gram key) of every 1- to 3-gram of lower-case letters, words padded.

    Grams don't reach across a break between words: the middle of a trigram is a letter.
    """
    texts = [t.lower() for t in texts]
    codes = np.frombuffer(("\x00".join(texts) + "\x00").encode("utf-32-le", "surrogatepass"), np.uint32)
    present = np.flatnonzero(np.bincount(codes)) if len(codes) else np.zeros(0, np.int64)
    table = np.zeros(int(present[-1]) + 1 if len(present) else 1, np.int64)
    table[present] = [c if chr(c).isalpha() else 0 for c in present.tolist()]
    owner = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in texts])
    c = np.concatenate([[0], table[codes]])
    keep = np.concatenate([[True], (c[1:] != 0) | (c[:-1] != 0)])
    c, owner = c[keep], np.concatenate([[0], owner])[keep]
    # the pad before a text's first letter is the end of the text before it
    at = np.flatnonzero(c)
    one, before, after = c[at], c[at - 1], c[at + 1]
    who, pairs = owner[at], at[after == 0]
    keys = np.concatenate([one, before << SHIFT | one, c[pairs] << SHIFT, before << 2 * SHIFT | one << SHIFT | after])
    return np.concatenate([who, who, owner[pairs], who]), keys


def counted(owner: np.ndarray, key: np.ndarray, owners: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (owner, key), in this order, with counts."""
    if not len(key):
        return owner, key, np.zeros(0, np.int64)
    names, dense = np.unique(key, return_inverse=True) if len(key) < 4096 else _dense(key)
    both = np.sort(owner * len(names) + dense)
    first = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]]))
    n = np.diff(np.concatenate([first, [len(both)]]))
    return both[first] // len(names), names[both[first] % len(names)], n


def _dense(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    names = np.sort(key)
    names = names[np.concatenate([[True], names[1:] != names[:-1]])]
    return names, np.searchsorted(names, key)


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, key, n) of the rows (text, lang) of a partition."""
    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

    def merge(parts):
        keys, n = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        names, at = np.unique(keys, return_inverse=True)
        return [(names, np.bincount(at, n, len(names)).astype(np.int64))]

    for whole in batches:
        for batch in pieces(whole, "text"):
            langs, texts = batch.column(1).to_pylist(), batch.column(0).to_pylist()
            names = sorted(set(langs))
            owner, key = ngrams(texts)
            code = np.array([names.index(x) for x in langs])
            owner, key, n = counted(code[owner], key, len(names))
            for k, lang in enumerate(names):
                held.setdefault(lang, []).append((key[owner == k], n[owner == k]))
                if len(held[lang]) > 32:
                    held[lang] = merge(held[lang])
    for lang, parts in held.items():
        for keys, n in merge(parts):
            yield pa.record_batch([pa.array([lang] * len(keys), pa.string()), pa.array(keys), pa.array(n)], ["lang", "key", "n"])


def learn_profiles(rows: DataFrame, size: int = PROFILE) -> list[tuple[str, list[int]]]:
    """Each language with its ``size`` most frequent n-grams by rank (ties: smaller key first).

    ``rows`` has text and lang, neither null. Each partition counts on its own; the counts are
    summed by n-gram and only the profiles, ``size`` rows a language, come to the driver.
    """
    small_batches(rows.sparkSession)
    counts = rows.select("text", "lang").mapInArrow(_train, "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "key"))
    found: dict[str, list[tuple[int, int]]] = {}
    for lang, key, k in counts.select("lang", "key", rank.alias("k")).where(F.col("k") <= size).collect():
        found.setdefault(lang, []).append((k, key))
    return [(lang, [key for _, key in sorted(found[lang])]) for lang in sorted(found)]


def _predict(profiles: list[tuple[str, list[int]]], size: int, names: list[str]):
    langs = [lang for lang, _ in profiles]
    keys = np.array(sorted({k for _, p in profiles for k in p}), np.int64)
    ranks = np.full((len(keys) + 1, max(1, len(langs))), -1, np.int64)
    for j, (_, profile) in enumerate(profiles):
        ranks[np.searchsorted(keys, profile), j] = np.arange(len(profile))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, 1):
                texts, n_docs = [t or "" for t in batch.column(1).to_pylist()], batch.num_rows
                lang, score = ["und"] * n_docs, np.zeros(n_docs)
                owner, key, n = counted(*ngrams(texts), n_docs)
                if len(owner) and langs:
                    most = int(n.max())
                    order = np.argsort(owner * (most + 1) + (most - n), kind="stable")  # ties stay by key
                    first = np.searchsorted(owner, np.arange(n_docs))
                    rank = np.arange(len(owner)) - first[owner]
                    top = rank < size
                    who, rank, key = owner[top], rank[top], key[order][top]
                    at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                    at = np.where(keys[at] == key, at, len(keys))
                    theirs = ranks[at]
                    away = np.where(theirs < 0, size, np.abs(theirs - rank[:, None]))
                    start = np.flatnonzero(np.concatenate([[True], who[1:] != who[:-1]]))
                    total = np.add.reduceat(away, start, axis=0)
                    held = np.diff(np.concatenate([start, [len(who)]]))
                    best = total.argmin(axis=1)
                    for doc, b in zip(who[start].tolist(), best.tolist(), strict=True):
                        lang[doc] = langs[b]
                    score[who[start]] = 1 - total.min(axis=1) / (held * size)
                held_columns = [batch.column(0), *(batch.column(k) for k in range(2, batch.num_columns))]
                yield pa.record_batch([*held_columns, pa.array(lang, pa.string()), pa.array(score)], names)

    return run


def identify(docs: DataFrame, profiles: list[tuple[str, list[int]]], size: int = PROFILE, carry: tuple[str, ...] = (), key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, carried columns, lang_pred, score) of every row by the least out-of-place distance.

    A document's ``size`` most frequent n-grams are ranked; an n-gram costs the difference of its
    ranks in the two profiles, or ``size`` where the language lacks it. The score is 1 less the
    distance over the largest possible one. Ties go to the first language by code point. Null
    texts and texts without a letter are ``und`` with score 0, as is every text if no profile was
    learned. Repeated rows return as often as they come; whole texts are read.
    """
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("_text"), *carry)
    small_batches(docs.sparkSession)
    fields = [f for f in rows.schema if f.name != "_text"]
    rows = rows.withColumnRenamed("_text", "text") if "text" not in carry else rows
    named = _predict(profiles, size, [*(f.name for f in fields), "lang_pred", "score"])
    return rows.mapInArrow(named, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", lang_pred string, score double")


def held_out(key: str = "doc_id") -> F.Column:
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    profiles = learn_profiles(docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()))
    return identify(docs, profiles).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


#: The same ranks and distances over lists of code points; the checksum is worked out bit by bit.
ORACLE = f"""
WITH steps AS (SELECT list_transform(range(256), lambda x: list_reduce(list_prepend(x, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
d AS (
  SELECT row_number() OVER () AS r, doc_id, lang, text, coalesce(xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: unicode(x)::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 4 = 2, false) AS held_out
  FROM documents, steps
), w AS (
  SELECT r, list_concat([0::BIGINT], list_transform(string_split(word, ''), lambda x: unicode(x)::BIGINT), [0::BIGINT]) AS p
  FROM (SELECT r, unnest(regexp_extract_all(lower(text), '\\p{{L}}+')) AS word FROM d)
), g AS (
  SELECT r, unnest(list_concat(p[2:-2], list_transform(range(1, len(p)), lambda k: (p[k] << {SHIFT}) | p[k + 1]), list_transform(range(1, len(p) - 1), lambda k: (p[k] << {2 * SHIFT}) | (p[k + 1] << {SHIFT}) | p[k + 2]))) AS key FROM w
), n AS (SELECT r, key, count(*) AS n FROM g GROUP BY ALL),
ranked AS (SELECT r, key, k FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY n DESC, key) - 1 AS k FROM n) WHERE k < {PROFILE}),
profiles AS (SELECT lang, key, k FROM (SELECT lang, key, row_number() OVER (PARTITION BY lang ORDER BY sum(n) DESC, key) - 1 AS k FROM n JOIN d USING (r) WHERE NOT held_out AND lang IS NOT NULL GROUP BY lang, key) WHERE k < {PROFILE}),
away AS (
  SELECT x.r, l.lang, sum(coalesce(abs(p.k - x.k), {PROFILE})) AS far, count(*) AS held
  FROM ranked x CROSS JOIN (SELECT DISTINCT lang FROM profiles) l LEFT JOIN profiles p ON p.lang = l.lang AND p.key = x.key GROUP BY ALL
), best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY far, lang) AS place FROM away) WHERE place = 1)
SELECT doc_id, held_out, coalesce(best.lang, 'und') AS lang_pred, CASE WHEN best.lang IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE - far::DOUBLE / (held * {PROFILE})::DOUBLE END AS score FROM d LEFT JOIN best USING (r)
"""
