"""Substring dedup by seed and extend: repeats of WINDOW words or more, found from winnowed anchors.

Seeds: of every WINDOW words the smallest hash of ANCHOR words is an anchor (winnowing), so two equal windows have the
same anchor at the same place. Anchors that occur once in the corpus cannot seed a repeat and are put aside by a bitmap
of fixed size, built from exact counts; a collision in it costs time, never a result. Extend: occurrences of an anchor
meet, in the order of (doc_id, start), and are extended to the left and right by comparing what lies around the anchor:
one hash for each of the up to WINDOW - ANCHOR + 1 windows that this anchor serves, which is how far an extension can
matter for a repeat of WINDOW words. Windows with an earlier equal are kept as runs, which join into maximal repeats.
Anchors with very many occurrences are dealt out by salts first, as many as the root of their count; the first of each
window in a salt meet once more, by window, so that neither step has a key of more than some root of the count.

Each occurrence is compared by hash with those before it in one sorted pass, so a passage that a third of the corpus
shares costs time in proportion to its occurrences: no pairs are made. Null and empty texts have no words and stay as
they are; very long texts are hashed in segments and cut whole. A null doc_id sorts first. Rows that repeat a doc_id are told apart by their text's hash; rows that repeat
both are one document, and are cut alike. Empty tables give an empty result; further columns stay out.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from siltstone.llm.common import PLAIN, bit_table, gram_hashes, has_bit, mix, partitions, row_groups, salted, table, text_bytes, word_hashes

WINDOW = 20
ANCHOR = 8
FILTER_BITS = 27
#: An anchor is hot from this count on, or from this share of all anchors on if that is more: at most HOT_SHARE are.
HOT_LEAST, HOT_SHARE = 1000, 1 << 17


def anchors(h: np.ndarray, woff: np.ndarray, window: int = WINDOW, k: int = ANCHOR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows that one anchor serves: the anchor's hash, the run's first window and its length."""
    g, width = gram_hashes(h, k), window - k + 1
    n = len(h) - window + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    best, at = g[:n].copy(), np.zeros(n, np.int8)
    for j in range(1, width):
        less = g[j : j + n] <= best
        np.copyto(best, g[j : j + n], where=less)
        at[less] = j
    inside = np.zeros(len(h) + 1, bool)  # windows that do not cross rows
    words = np.diff(woff)
    rows = np.flatnonzero(words >= window)
    mark = np.zeros(len(h) + 1, np.int32)
    np.add.at(mark, woff[:-1][rows], 1)
    np.add.at(mark, woff[1:][rows] - window + 1, -1)
    inside = np.cumsum(mark)[:n] > 0
    start = np.flatnonzero(inside)
    place = start + at[start]
    new = np.ones(len(start), bool)
    new[1:] = (place[1:] != place[:-1]) | (start[1:] != start[:-1] + 1)
    new[1:] |= np.isin(start[1:], woff)  # a row's first window
    first = np.flatnonzero(new)
    return best[start[first]], start[first], np.diff(np.append(first, len(start)))


def _groups(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, offs = text_bytes(batch.column("text"))
    for i, j in row_groups(offs):
        h, _, _, woff = word_hashes(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], PLAIN)
        yield i, j, h, woff


def _counter(window: int, k: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, h, woff in _groups(batch):
                a, n = np.unique(anchors(h, woff, window, k)[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(n)], ["anchor", "n"])

    return count


def _seeder(window: int, k: int, bitmap, hot, bits: int):
    def seed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, (often, salts) = bitmap.value, hot.value
        for batch in batches:
            doc, mark = (batch.column(c).to_numpy() for c in ("doc", "mark"))
            for i, _, h, woff in _groups(batch):
                a, start, n = anchors(h, woff, window, k)
                ok = has_bit(seen, a, bits)
                a, start, n = a[ok], start[ok], n[ok]
                row = np.searchsorted(woff, start, "right") - 1
                own_doc, own_mark = doc[i + row], mark[i + row]
                is_hot, key = np.zeros(len(a), bool), a
                if len(often):
                    at = np.minimum(np.searchsorted(often, a), len(often) - 1)
                    is_hot = often[at] == a
                    salt = mix(own_doc.view(np.uint64) ^ mix(own_mark.view(np.uint64))) % salts[at]
                    key = np.where(is_hot, salted(a, salt), a)
                full = gram_hashes(h, window)
                ends = np.cumsum(n)
                within = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - n, n)
                payload = full[np.repeat(start, n) + within]
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(payload.view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.view(np.int64)), pa.array(is_hot), pa.array(own_doc), pa.array(own_mark), pa.array(start - woff[row]), lists],
                    ["key", "hot", "doc", "mark", "start", "windows"],
                )

    return seed


def _repeats(survivors: bool):
    """Rows sorted by (key, doc, mark, start). Gives runs of windows with an earlier equal in their key, or of hot rows the windows without."""

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry = None
        for batch in batches:
            if not batch.num_rows:
                continue
            key, doc, mark, start = (batch.column(c).to_numpy() for c in ("key", "doc", "mark", "start"))
            lists = batch.column("windows")
            n = np.diff(lists.offsets.to_numpy())
            row = np.repeat(np.arange(len(n)), n)
            within = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            win = lists.flatten().to_numpy().view(np.uint64)
            place = start[row] + within
            cols = [key[row], win, doc[row], mark[row], place]
            skip = 0
            if carry is not None:
                skip = len(carry[0])
                cols = [np.concatenate([c, x]) for c, x in zip(carry, cols, strict=True)]
            both = cols[1] ^ (cols[0].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            _, first, inverse = np.unique(both, return_index=True, return_inverse=True)
            lead = first[inverse]
            same = (cols[2] == cols[2][lead]) & (cols[3] == cols[3][lead]) & (cols[4] == cols[4][lead])
            late = ~same[skip:]
            last = np.sort(first[cols[0][first] == key[-1]])
            carry = [c[last] for c in cols]
            if survivors:
                keep = np.flatnonzero(~late & batch.column("hot").to_numpy(zero_copy_only=False)[row])
                own = win[keep]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keep) + 1, dtype=np.int32)), pa.array(own.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (mix(own).view(np.int64), doc[row][keep], mark[row][keep], place[keep])] + [lists], ["key", "doc", "mark", "start", "windows"])
            else:
                at = np.flatnonzero(late)
                if len(at):
                    new = np.ones(len(at), bool)
                    new[1:] = (row[at][1:] != row[at][:-1]) | (place[at][1:] != place[at][:-1] + 1)
                    f = np.flatnonzero(new)
                    lens = np.diff(np.append(f, len(at)))
                    h = at[f]
                    yield pa.RecordBatch.from_arrays([pa.array(doc[row[h]]), pa.array(mark[row[h]]), pa.array(place[h]), pa.array(place[h] + lens)], ["doc", "mark", "start", "stop"])

    return extend


RUNS = "doc long, mark long, start long, stop long"
MEETINGS = "key long, doc long, mark long, start long, windows array<long>"
SEEDS = "key long, hot boolean, doc long, mark long, start long, windows array<long>"


def _key(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("long"), F.lit(-(1 << 63)))


def repeats(docs: DataFrame, window: int = WINDOW, k: int = ANCHOR, bits: int = FILTER_BITS) -> DataFrame:
    """Runs [start, stop) of windows of (doc, mark) that also start earlier: doc is the doc_id, mark the text's hash."""
    spark = docs.sparkSession
    n = partitions(spark)
    named = docs.select(_key(F.col("doc_id")).alias("doc"), F.xxhash64("text").alias("mark"), "text")
    counts = named.select("text").mapInArrow(_counter(window, k), "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n")).filter("n > 1").persist(StorageLevel.DISK_ONLY)
    # At most 2^(bits-6) words of bits, however large the corpus.
    bitmap = bit_table(counts, "anchor", bits)
    total = counts.agg(F.sum("n")).first()[0] or 0
    # At most HOT_SHARE anchors can hold this share of all.
    found = counts.filter(F.col("n") > max(HOT_LEAST, total // HOT_SHARE)).toArrow()
    counts.unpersist()
    often, times = found.column("anchor").to_numpy().view(np.uint64), found.column("n").to_numpy()
    order = np.argsort(often)
    salts = np.ceil(np.sqrt(times[order])).astype(np.uint64)
    shared, hot = spark.sparkContext.broadcast(bitmap), spark.sparkContext.broadcast((often[order], salts))

    def met(rows: DataFrame) -> DataFrame:
        return rows.repartition(n, "key").sortWithinPartitions("key", "doc", "mark", "start")

    dealt = met(named.mapInArrow(_seeder(window, k, shared, hot, bits), SEEDS))
    runs = dealt.mapInArrow(_repeats(False), RUNS)
    if len(often):
        runs = runs.unionByName(met(dealt.mapInArrow(_repeats(True), MEETINGS)).mapInArrow(_repeats(False), RUNS))
    return runs


def _cutter(window: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, offs = text_bytes(batch.column("text"))
            for i, j in row_groups(offs):
                yield piece(batch.slice(i, j - i))

    def piece(batch: pa.RecordBatch) -> pa.RecordBatch:
        n_words, n_removed, kept = [], [], []
        for text, runs in zip(batch.column("text"), batch.column("runs"), strict=True):
            words = (text.as_py() or "").encode().split()
            left = words
            if runs.is_valid:
                covered = np.zeros(len(words) + 1, np.int64)
                fields = runs.values
                np.add.at(covered, fields.field("start").to_numpy(), 1)
                np.add.at(covered, fields.field("stop").to_numpy() - 1 + window, -1)
                left = list(compress(words, np.cumsum(covered)[:-1] == 0))
            n_words.append(len(words))
            n_removed.append(len(words) - len(left))
            kept.append(b" ".join(left))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    return cut


def remove_repeats(docs: DataFrame, window: int = WINDOW, k: int = ANCHOR) -> DataFrame:
    """doc_id, n_words, n_removed and kept, the words left joined by one space, for every row of docs."""
    runs = repeats(docs, window, k).groupBy("doc", "mark").agg(F.collect_list(F.struct("start", "stop")).alias("runs"))
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", _key(F.col("doc_id")).alias("doc"), F.xxhash64("text").alias("mark"))
    return named.join(runs, ["doc", "mark"], "left").select("doc_id", "text", "runs").mapInArrow(_cutter(window), "doc_id long, n_words long, n_removed long, kept string")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = remove_repeats(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
w AS (SELECT doc_id, i, md5(array_to_string(list_slice(ws, i, i + 19), ' ')) AS k FROM d, unnest(range(1, len(ws) - 18)) AS r(i)),
late AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS rn FROM w) WHERE rn > 1),
gone AS (SELECT doc_id, list(DISTINCT i + j) AS g FROM late, unnest(range(0, 20)) AS o(j) GROUP BY doc_id),
x AS (SELECT d.doc_id, u.p, u.word, gone.g IS NOT NULL AND list_contains(gone.g, u.p) AS out FROM d LEFT JOIN gone USING (doc_id), LATERAL (SELECT unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p) AS u),
s AS (SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE out) AS r, string_agg(word, ' ' ORDER BY p) FILTER (WHERE NOT out) AS kept FROM x GROUP BY doc_id)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_words, coalesce(s.r, 0)::BIGINT AS n_removed, sha256(coalesce(s.kept, '')) AS kept_sha256 FROM d LEFT JOIN s USING (doc_id)"""

QUERIES = {"op8_substring_dedup": op8_substring_dedup}
ORACLES = {"op8_substring_dedup": _SQL}
