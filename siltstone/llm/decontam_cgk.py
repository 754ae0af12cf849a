"""Benchmark decontamination: CGK random-walk embedding, bit-sampling LSH over item-sized windows, exact edit check.

Texts are words (ASCII letters and digits and all other characters beyond ASCII, A-Z lower-cased). A document holds an
item if some window of as many words as the item has is within floor(EDITS * words) word edits of it. For each of WALKS
random walks, a window is embedded: at step t the walk writes the word it stands on and moves on if a random bit of
(t, word) says so; texts at a small edit distance take walks at a small Hamming distance. TABLES samples of SAMPLE
positions of each walk are the LSH keys; windows and items that share one are compared by a banded edit distance, which
is exact. The walks are embedded only where a match can be: if a window is within k edits of an item of n words, at
least n - q + 1 - q*k of the item's q-word grams stand in it unchanged within k places, and places without that many are
passed over. That filter loses nothing; what the walks may lose is measured in the tests.

Null and empty texts hold nothing; items without a word match nothing; repeated items and rows give repeated results;
items are read in blocks of at most ITEM_BLOCK rows, which bounds what is sent to the executors. Empty tables give an
empty result. Further columns are kept by decontaminate() and ignored by leaks().
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.common import ALNUM, gram_hashes, mix, row_groups, salted, table, text_bytes, word_hashes

EDITS = 0.2
WALKS, TABLES, SAMPLE = 8, 12, 3
ITEM_BLOCK = 20_000
MAX_GRAM = 3


class Items:
    """Items of one block, made ready: words, gram index and LSH tables by word count."""

    def __init__(self, ids: list[int | None], texts: list[str | None], edits: float = EDITS, walks: int = WALKS, tables: int = TABLES, sample: int = SAMPLE):
        data, offs = text_bytes(pa.array([t or "" for t in texts], pa.string()))
        h, _, _, woff = word_hashes(data, offs, ALNUM)
        self.walks, self.tables, self.sample = walks, tables, sample
        self.ids = ids
        self.words = [h[woff[i] : woff[i + 1]] for i in range(len(ids))]
        self.n = np.diff(woff)
        self.k = np.floor(self.n * edits + 1e-9).astype(np.int64)
        grams: dict[int, list] = {q: [] for q in range(1, MAX_GRAM + 1)}
        self.need = np.zeros(len(ids), np.int64)
        for i, (n, k) in enumerate(zip(self.n, self.k, strict=True)):
            for q in range(min(MAX_GRAM, int(n)), 0, -1):
                if n - q + 1 - q * k >= 1 or q == 1:
                    self.need[i] = max(1, n - q + 1 - q * k)
                    g = gram_hashes(self.words[i], q)
                    grams[q] += [(x, i, o) for o, x in enumerate(g)]
                    break
        self.grams = {}
        for q, found in grams.items():
            if found:
                x = np.array([f[0] for f in found], np.uint64)
                order = np.argsort(x, kind="stable")
                bits = np.zeros(1 << 20, bool)
                bits[(x & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
                self.grams[q] = (x[order], np.array([f[1] for f in found])[order], np.array([f[2] for f in found])[order], bits)
        self.lsh = {}
        for n in np.unique(self.n[self.n > 0]):
            members = np.flatnonzero(self.n == n)
            keys = self.keys(np.stack([self.words[i] for i in members]))
            self.lsh[int(n)] = (members, [(np.sort(keys[:, c]), members[np.argsort(keys[:, c], kind="stable")]) for c in range(keys.shape[1])])

    def keys(self, windows: np.ndarray) -> np.ndarray:
        """LSH keys (windows, walks * tables) of windows of equally many words."""
        m, n = windows.shape
        steps = 3 * n
        padded = np.concatenate([windows, np.zeros((m, 1), np.uint64)], axis=1)
        rng = np.random.Generator(np.random.PCG64(n))
        out, rows = [], np.arange(m)
        for walk in range(self.walks):
            picks = [np.sort(rng.choice(steps, self.sample, replace=False)) for _ in range(self.tables)]
            wanted = {int(t) for p in picks for t in p}
            at, seen = np.zeros(m, np.int64), {}
            for t in range(max(wanted) + 1):
                symbol = padded[rows, at]
                if t in wanted:
                    seen[t] = symbol
                at = np.minimum(n, at + (salted(symbol, walk * 100_003 + t) & np.uint64(1)).astype(np.int64))
            for p in picks:
                key = np.full(m, walk + 1, np.uint64)
                for t in p:
                    key = mix(key * np.uint64(0x9E3779B97F4A7C15) + seen[int(t)] + np.uint64(int(t)))
                out.append(key)
        return np.stack(out, axis=1)


def edit_distances(a: np.ndarray, b: np.ndarray, k: int) -> np.ndarray:
    """Word edit distances of rows of a and b (equally many words each), those over k as k + 1: a band of the usual table."""
    m, n = a.shape
    width, far = 2 * k + 1, k + 1
    band = np.full((m, width), far, np.int64)
    band[:, k : min(width, k + n + 1)] = np.arange(min(k + 1, n + 1))  # row 0: column j lies at j - 0 + k
    for i in range(1, n + 1):
        new = np.full((m, width), far, np.int64)
        for d in range(width):
            j = i + d - k
            if j < 0 or j > n:
                continue
            best = band[:, d + 1] + 1 if d + 1 < width else np.full(m, far)
            if j == 0:
                best = np.minimum(best, i)
            else:
                best = np.minimum(best, band[:, d] + (a[:, i - 1] != b[:, j - 1]))
                if d:
                    best = np.minimum(best, new[:, d - 1] + 1)
            new[:, d] = np.minimum(best, far)
        band = new
    return band[:, k]


def _windows(h: np.ndarray, woff: np.ndarray, items: Items) -> dict[int, np.ndarray]:
    """First words of the windows in which an item can be, by word count."""
    found_i, found_s = [], []
    for q, (grams, item, offset, bits) in items.grams.items():
        g = gram_hashes(h, q)
        at = np.flatnonzero(bits[(g & np.uint64((1 << 20) - 1)).astype(np.int64)])
        lo, hi = np.searchsorted(grams, g[at], "left"), np.searchsorted(grams, g[at], "right")
        at, lo, n = at[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
        if not len(at):
            continue
        each = np.repeat(lo, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        found_i.append(item[each])
        found_s.append(np.repeat(at, n) - offset[each])
    if not found_i:
        return {}
    i, s = np.concatenate(found_i), np.concatenate(found_s)
    span = len(h) + 4 * int(items.n.max()) + 4
    code = np.sort(i * span + s + 2 * int(items.n.max()))  # item and diagonal in one
    i = code // span
    k, need = items.k[i], items.need[i]
    near = np.searchsorted(code, code + 2 * k, "right") - np.arange(len(code))  # hits on diagonals up to 2k further
    ok = np.flatnonzero(near >= need)
    if not len(ok):
        return {}
    i, s, k = i[ok], code[ok] % span - 2 * int(items.n.max()), k[ok]
    # The hits of a match lie within k of its start: starts from s to s + 2k hold every match whose first diagonal is s.
    n = 2 * k + 1
    start = np.repeat(s, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    size = np.repeat(items.n[i], n)
    inside = (start >= 0) & (start + size <= len(h))
    start, size = start[inside], size[inside]
    row = np.searchsorted(woff, start, "right") - 1
    inside = start + size <= woff[row + 1]
    start, size = start[inside], size[inside]
    return {int(x): np.unique(start[size == x]) for x in np.unique(size)}


def matches(h: np.ndarray, woff: np.ndarray, items: Items) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows, item numbers, first words in the row and distances of all windows found."""
    out = [[], [], []]
    for n, starts in _windows(h, woff, items).items():
        _, tables = items.lsh[n]
        for part in range(0, len(starts), 50_000):
            some = starts[part : part + 50_000]
            windows = h[some[:, None] + np.arange(n)]
            keys = items.keys(windows)
            pairs = []
            for c, (sorted_keys, owner) in enumerate(tables):
                lo, hi = np.searchsorted(sorted_keys, keys[:, c], "left"), np.searchsorted(sorted_keys, keys[:, c], "right")
                hit = np.flatnonzero(hi > lo)
                m = (hi - lo)[hit]
                each = np.repeat(lo[hit], m) + np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m)
                pairs.append(np.repeat(hit, m) * len(items.ids) + owner[each])
            pair = np.unique(np.concatenate(pairs))
            w, i = pair // len(items.ids), pair % len(items.ids)
            if len(w):
                k = int(items.k[i[0]])
                good = edit_distances(windows[w], np.stack([items.words[x] for x in i]), k) <= k
                # Windows about a match are checked too, so that the best of them is found whatever the walks did.
                near = np.unique((some[w[good]][:, None] + np.arange(-2 * k, 2 * k + 1)) * len(items.ids) + i[good][:, None])
                at, i = near // len(items.ids), near % len(items.ids)
                inside = (at >= 0) & (at + n <= len(h))
                at, i = at[inside], i[inside]
                inside = at + n <= woff[np.searchsorted(woff, at, "right")]
                at, i = at[inside], i[inside]
                if len(at):
                    d = edit_distances(h[at[:, None] + np.arange(n)], np.stack([items.words[x] for x in i]), k)
                    for box, x in zip(out, (at[d <= k], i[d <= k], d[d <= k]), strict=True):
                        box.append(x)
    start, item, dist = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in out)
    _, one = np.unique(start * len(items.ids) + item, return_index=True)
    start, item, dist = start[one], item[one], dist[one]
    row = np.searchsorted(woff, start, "right") - 1
    return row, item, start - woff[row], dist


def _groups(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, offs = text_bytes(batch.column("text"))
    for i, j in row_groups(offs):
        h, _, _, woff = word_hashes(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], ALNUM)
        yield i, j, h, woff


def _finder(shared):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        for batch in batches:
            for i, _, h, woff in _groups(batch):
                row, item, start, dist = matches(h, woff, items)
                order = np.lexsort((start, dist, item, row))
                row, item, start, dist = row[order], item[order], start[order], dist[order]
                first = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (item[1:] != item[:-1])])) if len(row) else row
                windows = np.diff(np.append(first, len(row)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(row[first] + i)), pa.array([items.ids[x] for x in item[first]], pa.int64()), pa.array(start[first]), pa.array(items.n[item[first]]), pa.array(dist[first]), pa.array(windows)],
                    ["doc_id", "item_id", "first_word", "item_words", "edits", "n_windows"],
                )

    return find


def _dropper(shared):
    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        for batch in batches:
            clean = np.ones(batch.num_rows, bool)
            for i, _, h, woff in _groups(batch):
                clean[i + matches(h, woff, items)[0]] = False
            yield batch.filter(pa.array(clean))

    return drop


def _blocks(benchmark: DataFrame, **parameters) -> Iterator:
    """Broadcasts of items, at most about ITEM_BLOCK in each."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")
    n = max(1, -(-items.count() // ITEM_BLOCK))
    for b in range(n):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b).collect()
        rows = sorted(rows, key=lambda r: (r["item_id"] is None, r["item_id"] or 0, r["text"] or ""))
        yield benchmark.sparkSession.sparkContext.broadcast(Items([r["item_id"] for r in rows], [r["text"] for r in rows], **parameters))


def leaks(docs: DataFrame, benchmark: DataFrame, **parameters) -> DataFrame:
    """One row for each document row and item it holds: the window with the fewest edits, the first of equals."""
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, item_id long, first_word long, item_words long, edits long, n_windows long"
    out = None
    for shared in _blocks(benchmark, **parameters):
        found = named.mapInArrow(_finder(shared), schema)
        out = found if out is None else out.unionByName(found)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, **parameters) -> DataFrame:
    """The rows of docs that hold no item, with all their columns."""
    for shared in _blocks(benchmark, **parameters):
        docs = docs.mapInArrow(_dropper(shared), docs.schema)
    return docs


def op6_decontam_cgk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op6_decontam_cgk": op6_decontam_cgk}
ORACLES: dict[str, str] = {}
