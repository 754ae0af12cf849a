"""Near-duplicate classes by BagMinHash over multisets of word shingles.

Each shingle of weight w owns w unit-rate Poisson processes, taken in dyadic blocks of the weight axis: the process of a
block has the rate of its length, and a point counts if its place in the block lies under the weight. Of every register
the earliest point is kept, so two texts agree in a register with the probability of their weighted Jaccard similarity.
Registers are banded. Texts that share a band's bucket are compared in three rounds. First each meets the likeliest hub
of its buckets, and verified links make classes, so that a large group of copies costs one comparison a text. Then of
every two classes that still share a bucket the likeliest pair is compared, and last every likely pair of texts of two
classes. Registers alone tell which pairs are likely: a bucket of many texts is dealt out in blocks that meet two by two,
and no pair leaves a block but the likely ones. Comparison is exact, on whole multisets, so no link between different
texts that share a bucket is lost.

Registers that put a pair far under the threshold spare it the exact comparison (DOUBT standard errors). Texts are
collapsed to distinct ones first, so exact copies are one node, named by 64 bits. Null texts and texts without a word are
classes of their own, one a row's doc_id. Texts of fewer words than a shingle form one shingle of all their words. Null
doc_ids are allowed; the class is named by the smallest doc_id of its rows that is not null. Repeated rows get equal
rows. An empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.common import PLAIN, Scratch, bit_table, gram_hashes, has_bit, mix, partitions, row_groups, salted, table, text_bytes, word_hashes

WORDS = 5
THRESHOLD = 0.8
BANDS, ROWS = 32, 7
#: A pair is passed over if its registers put it this many standard errors under the threshold.
DOUBT = 4.5
#: Bytes of pairs of texts that are compared at once.
PAIR_BYTES = 1 << 20
#: Registers of the second signature, of texts that still share a bucket with another class.
FINE = 1024
CHUNK, CHUNK_FROM = 64, 8
#: Points in memory at once: a text makes about m * (log m + 3) of them for m registers.
GROUP_POINTS = 400_000
#: Texts of a bucket compared at once, and the most of them in a block of a bucket that is dealt out to many.
BLOCK_TEXTS, BLOCK_MOST = 256, 1 << 14
#: Bits of the table that spares other texts the exchange; a fuller one lets more through, never fewer.
SIEVE_BITS = 27
#: A text is hot from this count of rows on, or from this share of all rows on if that is more.
HOT_LEAST, HOT_SHARE = 1000, 1 << 12


def shingles(data: np.ndarray, offs: np.ndarray, n: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of rows on end, and their offsets by row."""
    h, _, _, woff = word_hashes(data, offs, PLAIN)
    words = np.diff(woff)
    g = gram_hashes(h, n)
    count = np.where(words >= n, words - n + 1, 0)
    short = np.flatnonzero((words > 0) & (words < n))
    total = np.where(words >= n, count, np.minimum(words, 1))
    soff = np.concatenate([[0], np.cumsum(total)]).astype(np.int64)
    out = np.zeros(int(soff[-1]), np.uint64)
    long = np.flatnonzero(count)
    if len(long):
        within = np.arange(int(count[long].sum())) - np.repeat(np.cumsum(count[long]) - count[long], count[long])
        out[np.repeat(soff[long], count[long]) + within] = g[np.repeat(woff[long], count[long]) + within]
    for r in short:
        out[soff[r]] = salted(gram_hashes(h[woff[r] : woff[r + 1]], int(words[r])), int(words[r]))[0]
    return out, soff


def _uniform(x: np.ndarray, salt: int | np.ndarray) -> np.ndarray:
    return ((salted(x, salt) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def signatures(row: np.ndarray, item: np.ndarray, weight: np.ndarray, n_rows: int, m: int) -> np.ndarray:
    """BagMinHash registers (n_rows, m), as 64-bit marks of the earliest points, of rows of (item, integer weight > 0)."""
    total = np.bincount(row, weights=weight, minlength=n_rows)
    marks = np.zeros(n_rows * m, np.uint64)
    times = np.full(n_rows * m, np.inf)
    pending = total > 0
    # A row of n unit processes has filled its m registers by this time, or else is done again with twice the time.
    until = np.where(pending, m * (np.log(m) + 3.0) / np.maximum(total, 1), 0.0)
    while pending.any():
        sel = slice(None) if pending.all() else pending[row]
        block = 0
        rows_, items_, weights_ = row[sel], item[sel], weight[sel]
        found: list[tuple] = []
        while len(rows_):
            low = 0 if block == 0 else 1 << (block - 1)  # the block (low, low + length] of the weight axis
            length = 1 if block == 0 else 1 << (block - 1)
            if block:
                keep = weights_ > low
                rows_, items_, weights_ = rows_[keep], items_[keep], weights_[keep]
            many = until[rows_] * length >= CHUNK_FROM  # short texts, whose few shingles make many points each
            for chosen, chunk in ((~many, 1), (many, CHUNK)):
                r, w = rows_[chosen], weights_[chosen]
                base, limit, t, step = salted(items_[chosen], 1000 + block), until[r], 0.0, 0
                while len(r):
                    salts = np.arange(step, step + chunk, dtype=np.uint64) * np.uint64(3)
                    gaps = -np.log(_uniform(base[:, None], salts)) / length
                    times_ = (np.cumsum(gaps, axis=1) if chunk > 1 else gaps) + (t if step == 0 else t[:, None])
                    i, k = np.nonzero(times_ <= limit[:, None])
                    own, at = base[i], times_[i, k]
                    mark = salted(own, salts[k] + np.uint64(1))
                    slot = r[i] * m + ((mark >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
                    if block > 1:
                        counts = low + _uniform(own, salts[k] + np.uint64(2)) * length < w[i]
                        mark, slot, at = mark[counts], slot[counts], at[counts]
                    np.minimum.at(times, slot, at)
                    found.append((slot, at, mark))
                    live = np.flatnonzero(times_[:, -1] <= limit)
                    r, w, base, limit, t = r[live], w[live], base[live], limit[live], times_[live, -1]
                    step += chunk
            block += 1
        for slot, at, mark in found:
            first = at == times[slot]
            marks[slot[first]] = mark[first]
        pending = pending & np.isinf(times.reshape(n_rows, m)).any(axis=1)
        until = np.where(pending, until * 2, until)
    return marks.reshape(n_rows, m)


def bags(hashes: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, distinct items and their counts."""
    row, h = np.repeat(np.arange(len(offs) - 1), np.diff(offs)), hashes.copy()
    for i, j in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True):
        h[i:j].sort()
    first = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (h[1:] != h[:-1])])) if len(row) else np.zeros(0, np.int64)
    return row[first], h[first], np.diff(np.append(first, len(row)))


SIGNED = "doc_id long, node long, n long, keys array<long>, sketch binary"


def _signer(n: int, bands: int, rows: int):
    m = bands * rows
    at_once = max(1, int(GROUP_POINTS / (m * (np.log(m) + 3))))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = text_bytes(batch.column("text"))
            for i, j in row_groups(offs, rows=at_once):
                base = offs[i]
                hashes, soff = shingles(data[base : offs[j]], offs[i : j + 1] - base, n)
                r, item, weight = bags(hashes, soff)
                marks = signatures(r, item, weight, j - i, bands * rows)
                sketch = (marks & np.uint64(0xFF)).astype(np.uint8)
                marks = marks.reshape(j - i, bands, rows)
                key = np.zeros((j - i, bands), np.uint64)
                for c in range(rows):
                    key = mix(key * np.uint64(0x9E3779B97F4A7C15) + marks[:, :, c])
                key = mix(key + np.arange(bands, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(i, j - i),
                        batch.column("node").slice(i, j - i),
                        pa.array(np.diff(soff)),
                        pa.ListArray.from_arrays(pa.array(np.arange(0, (j - i + 1) * bands, bands, dtype=np.int32)), pa.array(key.reshape(-1).view(np.int64))),
                        pa.array([x.tobytes() for x in sketch], pa.binary()),
                    ],
                    ["doc_id", "node", "n", "keys", "sketch"],
                )

    return sign


def _similarity(a: np.ndarray, b: np.ndarray) -> float:
    ia, ca = np.unique(a, return_counts=True)
    ib, cb = np.unique(b, return_counts=True)
    _, x, y = np.intersect1d(ia, ib, assume_unique=True, return_indices=True)
    both = int(np.minimum(ca[x], cb[y]).sum())
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 0.0


def _verifier(n: int, threshold: float):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = [text_bytes(batch.column(c)) for c in ("text_a", "text_b")]
            good, done = [], 0
            for i, j in row_groups(sides[0][1] + sides[1][1], PAIR_BYTES):
                (ha, oa), (hb, ob) = (shingles(d[o[i] : o[j]], o[i : j + 1] - o[i], n) for d, o in sides)
                good += [done + k for k in range(j - i) if _similarity(ha[oa[k] : oa[k + 1]], hb[ob[k] : ob[k + 1]]) >= threshold]
                done += j - i
            pick = pa.array(good, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("a").take(pick), batch.column("b").take(pick)], ["a", "b"])

    return verify


def _agreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The share of registers in which each row of a agrees with each row of b."""
    step = max(1, (8 << 20) // max(1, len(b) * a.shape[1]))
    return np.concatenate([(a[i : i + step, None, :] == b[None, :, :]).mean(axis=2) for i in range(0, len(a), step)])


def _estimator(least: float):
    """Of sketched pairs those whose registers agree in a share of at least `least`, with that share."""

    def estimate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (text_bytes(batch.column(c))[0].reshape(batch.num_rows, -1) for c in ("sketch", "h_sketch"))
            share = (a == b).mean(axis=1) if batch.num_rows else np.zeros(0)
            pick = pa.array(np.flatnonzero(share >= least))
            yield pa.RecordBatch.from_arrays([batch.column("node").take(pick), batch.column("hub").take(pick), pa.array(share[share >= least])], ["node", "hub", "share"])

    return estimate


PAIRS = ["a", "b", "comp_a", "comp_b"]


def _matcher(least: float, threshold: float, best: bool):
    """Rows sorted by unit (bucket, i, j). Gives likely pairs of texts of two classes: the likeliest of each two classes, or all, each in its first bucket."""

    def of_unit(cross: bool, band: np.ndarray, block: np.ndarray, node: np.ndarray, n: np.ndarray, comp: np.ndarray, keys: np.ndarray, sketch: np.ndarray) -> Iterator[np.ndarray]:
        ours = np.flatnonzero(block == block.min()) if cross else np.arange(len(node))
        theirs = np.flatnonzero(block != block.min()) if cross else ours
        for c in np.unique(comp[ours]):
            a = ours[comp[ours] == c]
            b = theirs[comp[theirs] != c] if cross else theirs[comp[theirs] > c]
            if not len(b):
                continue
            share = _agreement(sketch[a], sketch[b])
            x, y = np.nonzero((share >= least) & (np.minimum(n[a][:, None], n[b]) >= threshold * np.maximum(n[a][:, None], n[b])))
            if best and len(x):
                order = np.lexsort((node[b[y]], node[a[x]], -share[x, y], comp[b[y]]))
                order = order[np.unique(comp[b[y]][order], return_index=True)[1]]
                x, y = x[order], y[order]
            elif len(x):
                again = (keys[a[x], : band[0]] == keys[b[y], : band[0]]).any(axis=1)  # they meet in an earlier band
                x, y = x[~again], y[~again]
            one, two = node[a[x]], node[b[y]]
            swap = one > two
            yield np.stack([np.where(swap, two, one), np.where(swap, one, two), np.where(swap, comp[b[y]], c), np.where(swap, c, comp[b[y]])])

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None

        def pairs(cols: list[np.ndarray], edges: np.ndarray) -> pa.RecordBatch:
            out = [np.zeros((4, 0), np.int64)]
            for s, t in zip(edges[:-1], edges[1:], strict=True):
                out += of_unit(cols[1][s] != cols[2][s], *(c[s:t] for c in cols[3:]))
            return pa.RecordBatch.from_arrays([pa.array(c) for c in np.concatenate(out, axis=1)], PAIRS)

        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(c).to_numpy() for c in ("bucket", "i", "j", "band", "block", "node", "n", "comp")]
            cols += [batch.column("keys").flatten().to_numpy().reshape(batch.num_rows, -1), text_bytes(batch.column("sketch"))[0].reshape(batch.num_rows, -1)]
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
            new = (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1]) | (cols[2][1:] != cols[2][:-1])
            edges = np.concatenate([[0], np.flatnonzero(new) + 1])
            yield pairs(cols, edges)
            held = [c[edges[-1] :].copy() for c in cols]  # the last unit may go on
        if held is not None:
            yield pairs(held, np.array([0, len(held[0])]))

    return match


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, comp) for the nodes of links (a, b): large-star and small-star steps until nothing changes; comp is the smallest node."""
    edges = scratch.put(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    mark = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        old, edges = edges, scratch.put(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        scratch.drop(old)
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == mark:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())
        mark = now


def text_node() -> Column:
    """64 bits that name a text; a text without a word is named by its row's doc_id."""
    blank = F.translate(F.coalesce("text", F.lit("")), " \t\n\x0b\x0c\r", "") == ""
    return F.when(blank, F.xxhash64(F.lit("blank"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).otherwise(F.xxhash64("text"))


def _sifted(rows: DataFrame, keys: DataFrame, outside: bool = False) -> DataFrame:
    """Rows whose node has its bit set in a bit table of the nodes of keys: all rows of those nodes and few others; with outside the rest."""
    bits = min(SIEVE_BITS, max(16, (16 * keys.count()).bit_length()))
    shared = rows.sparkSession.sparkContext.broadcast(bit_table(keys, "node", bits))

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = has_bit(shared.value, batch.column("node").to_numpy().view(np.uint64), bits)
            yield batch.filter(pa.array(hit != outside))

    return rows.mapInArrow(sift, rows.schema)


def near_duplicates(docs: DataFrame, n: int = WORDS, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, class_id, class_size and n_shingles for every row of docs, with `node`, the key of its text, and `comp`, that of its class."""
    scratch = Scratch(docs.sparkSession, "near-duplicates")
    found = _labelled(docs, n, threshold, bands, rows, scratch)
    # Written, so that the join's sides are plain exchanges, of which Spark can split that of a large class.
    least = scratch.put(found.groupBy("comp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("size")).filter("size > 1"))
    return found.join(least, "comp", "left").select("doc_id", F.when(F.col("size").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("class_id"), F.coalesce("size", F.lit(1)).cast("long").alias("class_size"), F.col("n").alias("n_shingles"), "node", "comp")


def _labelled(docs: DataFrame, n: int, threshold: float, bands: int, rows: int, scratch: Scratch) -> DataFrame:
    """(doc_id, node, n, comp) for every row of docs: the key of its text, its shingles and the key of its class."""
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("node", text_node())
    signed = scratch.put(named.mapInArrow(_signer(n, bands, rows), SIGNED))
    nodes = signed.filter("n > 0").groupBy("node").agg(F.max("n").alias("n"), F.min("keys").alias("keys"))
    buckets = nodes.select("node", "n", F.posexplode("keys").alias("band", "bucket"))
    shared = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    met = scratch.put(buckets.join(shared, "bucket"))
    found = signed.select("doc_id", "node", "n")
    if not met.limit(1).count():
        return found.withColumn("comp", F.col("node"))
    comp = _classes(named.select("node", "text"), signed.select("node", "keys", "sketch"), met, n, threshold, bands * rows, scratch)
    # Rows of a text that very many share stay where they are: HOT_SHARE texts at most can be such.
    hot = [r["node"] for r in found.groupBy("node").agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > max(HOT_LEAST, signed.count() // HOT_SHARE)).select("node").collect()]
    is_hot = F.col("node").isin(hot)
    parts = [found.filter(~is_hot).join(comp, "node", "left"), found.filter(is_hot).join(F.broadcast(comp.filter(is_hot)), "node", "left")] if hot else [found.join(comp, "node", "left")]
    return reduce(DataFrame.unionByName, parts).withColumn("comp", F.coalesce("comp", "node"))


def _classes(texts: DataFrame, sketches: DataFrame, met: DataFrame, n: int, threshold: float, m: int, scratch: Scratch) -> DataFrame:
    """(node, comp) of the nodes that meet another in met (bucket, band, node, n, members)."""

    def doubtful(m: int) -> float:
        return threshold - DOUBT * (threshold * (1 - threshold) / m) ** 0.5

    # A text that meets many others, as the original of many copies does, is the hub of its buckets.
    some = scratch.put(met.groupBy("node").agg(F.sum("members").alias("degree")))
    # The only exchange of texts and sketches: those that share a bucket with another, each once.
    # Copies of a text are one row of each task before they move.
    texts = scratch.put(_sifted(texts, some).groupBy("node").agg(F.first("text").alias("text")).join(some.select("node"), "node", "left_semi"))
    sketches = scratch.put(sketches.groupBy("node").agg(F.min("keys").alias("keys"), F.min("sketch").alias("sketch")).join(some, "node"))
    members = met.join(sketches, "node")

    def verified(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The pairs, each once, and those of them that are similar, with all columns."""
        pairs = scratch.put(pairs.distinct())
        with_a = pairs.select("a", "b").distinct().join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
        both = with_a.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
        good = scratch.put(both.select("a", "b", "text_a", "text_b").mapInArrow(_verifier(n, threshold), "a long, b long"))
        return pairs, pairs.join(good, ["a", "b"])

    # First each text with the likeliest of the hubs of its buckets.
    hubs = members.groupBy("bucket").agg(F.max_by(F.struct("node", "n", "sketch"), F.struct("degree", "node")).alias("hub"))
    similar = F.least("n", "hub.n") >= F.lit(threshold) * F.greatest("n", "hub.n")  # no overlap can be larger
    pairs = members.join(hubs, "bucket").filter("node <> hub.node").filter(similar)
    pairs = pairs.select("node", F.col("hub.node").alias("hub"), "sketch", F.col("hub.sketch").alias("h_sketch")).mapInArrow(_estimator(doubtful(m)), "node long, hub long, share double")
    best = pairs.groupBy("node").agg(F.max(F.struct("share", "hub")).alias("best"))
    links = verified(best.select(F.least("node", "best.hub").alias("a"), F.greatest("node", "best.hub").alias("b")))[1]
    comp = some.select("node").join(components(links, scratch), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    # Then, where a bucket holds several classes yet, the likeliest pair of every two of them, and at last all likely pairs.
    tried = None
    for last in (False, True):
        comp = scratch.put(comp)
        rest = met.join(comp, "node")
        split = rest.groupBy("bucket").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).filter("c0 <> c1").select("bucket")
        rest = scratch.put(rest.join(split, "bucket"))
        marks = sketches.select("node", "keys", "sketch")
        if last:  # more registers, so that fewer pairs are in doubt
            left = texts.join(rest.select("node").distinct(), "node", "left_semi").withColumn("doc_id", F.lit(None).cast("long"))
            fine = left.mapInArrow(_signer(n, FINE // 8, 8), SIGNED).select("node", "sketch")
            marks = scratch.put(sketches.select("node", "keys").join(fine, "node"))
        blocks = F.ceil(F.when(F.col("members") <= BLOCK_TEXTS**2, F.col("members") / BLOCK_TEXTS).otherwise(F.greatest(F.lit(BLOCK_TEXTS), F.col("members") / BLOCK_MOST))).cast("int")
        rest = rest.join(marks, "node").withColumn("block", F.pmod(F.xxhash64("node", "bucket"), blocks).cast("int"))
        units = rest.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1))).select("bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "band", "block", "node", "n", "comp", "keys", "sketch")
        units = units.repartition(partitions(scratch.spark), "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "node")
        pairs = units.mapInArrow(_matcher(doubtful(FINE if last else m), threshold, not last), ", ".join(f"{c} long" for c in PAIRS))
        pairs = pairs if tried is None else pairs.join(tried.select("a", "b"), ["a", "b"], "left_anti")
        tried, links = verified(pairs)
        joined = components(links.select(F.col("comp_a").alias("a"), F.col("comp_b").alias("b")), scratch).select(F.col("node").alias("comp"), F.col("comp").alias("to"))
        comp = comp.join(joined, "comp", "left").select("node", F.coalesce("to", "comp").alias("comp"))
    return scratch.put(comp)


def keep_one(docs: DataFrame, n: int = WORDS, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """docs with one row of each class left: that of the smallest doc_id, and one of rows with equal doc_id and text."""
    scratch = Scratch(docs.sparkSession, "keep-one")
    rank = F.struct(F.col("doc_id").isNull(), F.coalesce("doc_id", F.lit(0)), "node")
    named = scratch.put(_labelled(docs, n, threshold, bands, rows, scratch).select("doc_id", "node", "comp", rank.alias("rank")))
    chosen = scratch.put(named.groupBy("comp").agg(F.min("rank").alias("rank"), F.count(F.lit(1)).alias("rows")).filter("rows > 1"))
    # Only texts of classes of several rows are exchanged; all others stay.
    classes = scratch.put(named.join(chosen.select("comp", F.col("rank").alias("best")), "comp").select("node", "rank", "best").distinct())
    all_rows = docs.withColumn("node", text_node()) if "node" not in docs.columns else docs.withColumnRenamed("node", "__own").withColumn("node", text_node())
    sole = _sifted(all_rows, classes, outside=True)
    doubt = _sifted(all_rows, classes)
    key = F.struct(F.col("doc_id").isNull(), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), "node").alias("rank")
    kept = classes.filter("rank = best").select("rank").distinct()
    apart = doubt.join(classes.select("node").distinct(), "node", "left_anti")
    one = doubt.withColumn("__rank", key).join(kept.withColumnRenamed("rank", "__rank"), "__rank", "left_semi").groupBy("__rank").agg(F.first(F.struct(*all_rows.columns)).alias("row")).select("row.*")
    out = sole.unionByName(apart).unionByName(one).drop("node")
    return out.withColumnRenamed("__own", "node") if "node" in docs.columns else out


def op10_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size", "n_shingles")


QUERIES = {"op10_bagminhash": op10_bagminhash}
ORACLES: dict[str, str] = {}
