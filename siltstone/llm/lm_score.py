"""LM scoring with a log-frequency Bloom filter over quantised n-gram counts.

Training texts are counted once: exact counts of tokens and of neighbouring pairs meet by hash bucket, as sorted blobs
and not as rows. A count c is quantised to the level 1 + floor(log2 c), and the n-gram is put into a Bloom filter once
for each level up to its own; a level is read back by probing 1, 2, ... until a probe misses. The filter is kept in one
segment a bucket, of BITS bits an entry whatever their number, so that it grows with the n-grams and reads as well in any
corpus. It stays in its buckets: n-grams travel there to be read. Probabilities are Dirichlet-smoothed:
(c(vw) + MU * p(w)) / (c(v) + MU), p(w) add-one smoothed, all counts as read from the filter, c(vw) at most c(w).

Only the most frequent tokens and pairs (TOP of each at most) are broadcast, with exact counts and with what the filter
reads for them, which changes no result. A pair that is not among them travels to its bucket with the level of its second
word; if that word is rare too, by way of the word's bucket, where its exact count for the base score is. What is read
returns to the group of rows it came from.

Null and empty texts are one end token. Rows without a doc_id count as remainder 0. Repeated rows are scored each; an
empty table gives an empty result; further columns stay out. Without training texts every probability is 1 / (V + 1) = 1.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.common import GROUP_BYTES, LOWERED, checkpoint, mix, partitions, row_groups, salted, table, text_bytes, word_hashes

SPLIT = (7, 2)
MU = 300.0
BITS, PROBES = 10, 4
TOP = 1 << 18
SLOTS = 1 << 20
FLUSH = 4_000_000
MAX_LEVEL = 48
END = np.uint64(0xD1B54A32D192ED03)
LOW40 = np.uint64((1 << 40) - 1)
#: Pairs are told apart by their bucket and these bits: buckets are of one size in any corpus, so a few in a million share both.
LOW32 = np.uint64((1 << 32) - 1)


def tokens(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of rows on end, an END after each row's words, and their offsets by row."""
    h, _, _, woff = word_hashes(data, offs, LOWERED)
    n = len(offs) - 1
    toff = woff + np.arange(n + 1)
    out = np.full(int(toff[-1]), END, np.uint64)
    out[np.arange(len(h)) + np.repeat(np.arange(n), np.diff(woff))] = h
    return out, toff


def pairs(t: np.ndarray) -> np.ndarray:
    """Hashes of each token with the one before; a row's first token follows the END of another, or of none."""
    before = np.concatenate([[END], t[:-1]])
    return mix(before * np.uint64(0x9E3779B97F4A7C15) + (t ^ np.uint64(0x2545F4914F6CDD1D)))


def bucket_of(h: np.ndarray, n: int) -> np.ndarray:
    return ((h >> np.uint64(40)) % np.uint64(n)).astype(np.int64)


def _total(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    return k[first], np.add.reduceat(counts[order], first)


def _pack32(x: np.ndarray) -> bytes:
    return (x & LOW32).astype("<u4").tobytes()


def _unpack32(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<u4").astype(np.uint64)


def _raw(x: np.ndarray) -> bytes:
    return x.tobytes()


def _planes(x: np.ndarray) -> bytes:
    """All lowest bytes, then all second ones, and so on, which exchanges compress better."""
    return x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes()


def _unplanes(raw: bytes, kind) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).reshape(-1)


def _steps(x: np.ndarray) -> bytes:
    """The differences of numbers that mostly rise; they wrap round."""
    return _planes(np.diff(x, prepend=x.dtype.type(0)))


def _unsteps(raw: bytes, kind) -> np.ndarray:
    return np.cumsum(_unplanes(raw, kind), dtype=kind)


def _squeeze(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unsqueeze(raw: bytes) -> bytes:
    return pa.decompress(raw[8:], int.from_bytes(raw[:8], "little"), codec="zstd", asbytes=True)


BLOBS = "bucket int, words binary, word_counts binary, pairs binary, pair_counts binary"


def _counter(n: int):
    def blobs(parts: list[np.ndarray], rows: int) -> pa.RecordBatch:
        t = np.concatenate(parts)
        w, wc = np.unique(t, return_counts=True)
        p = np.concatenate([pairs(x) for x in parts])
        p, pn = np.unique((bucket_of(p, n).astype(np.uint64) << np.uint64(32)) | (p & LOW32), return_counts=True)
        over = np.flatnonzero(pn > 255)  # counts are bytes; more take more entries
        reps = np.ones(len(p), np.int64)
        reps[over] = -(-pn[over] // 255)
        each = np.repeat(np.arange(len(p)), reps)
        left = np.minimum(255, pn[each] - 255 * (np.arange(len(each)) - np.repeat(np.cumsum(reps) - reps, reps)))
        p, pn = p[each], left.astype(np.uint8)
        wb = bucket_of(w, n)
        wo = np.argsort(wb, kind="stable")
        w, wc = w[wo], wc[wo].astype(np.uint32)
        we, pe = np.searchsorted(wb[wo], np.arange(n + 1)), np.searchsorted(p >> np.uint64(32), np.arange(n + 1).astype(np.uint64))
        cut = lambda i, e, x: x[e[i] : e[i + 1]]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(range(n), pa.int32()),
                pa.array([cut(i, we, w).tobytes() for i in range(n)], pa.binary()),
                pa.array([cut(i, we, wc).tobytes() for i in range(n)], pa.binary()),
                pa.array([_squeeze(_steps((cut(i, pe, p) & LOW32).astype(np.uint32))) for i in range(n)], pa.binary()),
                pa.array([_squeeze(cut(i, pe, pn).tobytes()) for i in range(n)], pa.binary()),
            ],
            ["bucket", "words", "word_counts", "pairs", "pair_counts"],
        )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for batch in batches:
            data, offs = text_bytes(batch.column("text"))
            for i, j in row_groups(offs):
                t, _ = tokens(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                parts.append(t)
                size += len(t)
                if size >= FLUSH:
                    yield blobs(parts, size)
                    parts, size = [], 0
        if parts:
            yield blobs(parts, size)

    return count


def probes(key: np.ndarray, level: int, low: np.ndarray, width: np.ndarray) -> Iterator[np.ndarray]:
    """Bits of a key's level in segments that start at bit low and are width bits long."""
    x = salted(key, 7919 * level)
    y = salted(x, 1) | np.uint64(1)
    for i in range(PROBES):
        yield low + ((x + np.uint64(i) * y) % width)


def level_of(c: np.ndarray) -> np.ndarray:
    return np.frexp(c.astype(np.float64))[1]


class Model:
    """Segments of the filter, those of the buckets in rows, of n."""

    def __init__(self, rows: list, n: int):
        self.low, self.width = np.zeros(n, np.uint64), np.full(n, 64, np.uint64)
        at, parts = 8, [np.zeros(8, np.uint8)]  # an empty segment first, for buckets that hold nothing
        for r in rows:
            piece = np.frombuffer(r["segment"], np.uint8)
            self.low[r["bucket"]], self.width[r["bucket"]] = at * 8, len(piece) * 8
            parts.append(piece)
            at += len(piece)
        self.filter = np.concatenate(parts)

    def levels(self, key: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        """The highest level whose probes all hit, and of all below it; 0 if there is none."""
        level = np.zeros(len(key), np.uint8)
        live, k = np.arange(len(key)), key
        low, width = self.low[bucket], self.width[bucket]
        for q in range(1, MAX_LEVEL):
            hit = np.ones(len(live), bool)
            for slot in probes(k, q, low, width):
                hit &= (self.filter[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1
            live = live[hit]
            if not len(live):
                break
            level[live] = q
            k, low, width = k[hit], low[hit], width[hit]
        return level

    def estimate(self, key: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        return middle(self.levels(key, bucket))


def middle(level: np.ndarray) -> np.ndarray:
    """The middle of the counts of a level."""
    return np.where(level > 0, (1.5 * 2.0 ** level.astype(np.float64) - 1) / 2, 0.0)


TABLES = "bucket int, types long, tokens long, words binary, counts binary, top binary, top_pairs binary, segment binary"


def _table(most: int, top: int):
    """Builds a bucket's counts (in as many bytes as the largest needs) and segment, and its `top` most frequent words and `most` most frequent pairs with what the segment reads for them."""

    def build(t: pa.Table) -> pa.Table:
        bucket = t.column("bucket")[0].as_py()
        join = lambda c, kind: np.concatenate([np.frombuffer(x.as_py(), kind) for x in t.column(c)])
        w, wc = _total(join("words", np.uint64), join("word_counts", np.uint32).astype(np.int64))
        p, pn = (np.concatenate([np.zeros(0, kind), *[read_(_unsqueeze(x.as_py())) for x in t.column(c)]]) for c, kind, read_ in (("pairs", np.uint32, lambda raw: _unsteps(raw, np.uint32)), ("pair_counts", np.uint8, lambda raw: np.frombuffer(raw, np.uint8))))
        p, pn = _total(p.astype(np.uint64), pn.astype(np.int64))
        keys = np.concatenate([salted(w & LOW40, 1), salted(p, 2)])
        levels = level_of(np.concatenate([wc, pn]))
        width = max(64, -(-BITS * int(levels.sum()) // 64) * 64)
        bits = np.zeros(width, bool)
        low, wide = np.zeros(1, np.uint64), np.full(1, width, np.uint64)
        for q in range(1, int(levels.max(initial=0)) + 1):
            for slot in probes(keys[levels >= q], q, low, wide):
                bits[slot.astype(np.int64)] = True
        segment = np.packbits(bits, bitorder="little").tobytes()
        model = Model([{"bucket": 0, "segment": segment}], 1)
        read = lambda key: model.levels(key, np.zeros(len(key), np.int64)).astype(np.uint64)
        often, often_pairs = np.argsort(-wc, kind="stable")[:top], np.argsort(-pn, kind="stable")[:most]
        head = np.stack([w[often], wc[often].astype(np.uint64), read(salted(w[often] & LOW40, 1))]).tobytes()
        pair = p[often_pairs]
        head_pairs = np.stack([pair | np.uint64(bucket << 40), pn[often_pairs].astype(np.uint64), read(salted(pair, 2))]).tobytes()
        return pa.table(
            {
                "bucket": pa.array([bucket], pa.int32()),
                "types": pa.array([len(w)], pa.int64()),
                "tokens": pa.array([int(wc.sum())], pa.int64()),
                "words": pa.array([w.tobytes()], pa.binary()),
                "counts": pa.array([wc.astype(np.min_scalar_type(int(wc.max(initial=0)))).tobytes()], pa.binary()),
                "top": pa.array([head], pa.binary()),
                "top_pairs": pa.array([head_pairs], pa.binary()),
                "segment": pa.array([segment], pa.binary()),
            }
        )

    return build


def _slots(heads: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, counts, levels) by the low bits of the key; of keys that share a slot the most frequent stays. A count of 0 is an empty slot."""
    key, c, level = (np.concatenate([h[i] for h in heads]) if heads else np.zeros(0, np.uint64) for i in range(3))
    order = np.argsort(c, kind="stable")
    slot = (key[order] & np.uint64(SLOTS - 1)).astype(np.int64)
    keys, counts, levels = np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, np.uint32), np.zeros(SLOTS, np.uint8)
    keys[slot], counts[slot], levels[slot] = key[order], np.minimum(c[order], np.uint64(0xFFFFFFFF)).astype(np.uint32), level[order].astype(np.uint8)
    return keys, counts, levels


class Frequent:
    """The broadcast part: counts and levels of frequent tokens and pairs, N and V. Its size is fixed by SLOTS."""

    def __init__(self, rows: list, n: int, mu: float = MU):
        self.n, self.mu = n, mu
        self.tokens, self.types = sum(r["tokens"] for r in rows), sum(r["types"] for r in rows)
        heads = lambda c: [np.frombuffer(r[c], np.uint64).reshape(3, -1) for r in rows]
        self.words, self.pairs = _slots(heads("top")), _slots(heads("top_pairs"))

    @staticmethod
    def find(slots: tuple, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(found, counts, levels) of keys."""
        slot = (key & np.uint64(SLOTS - 1)).astype(np.int64)
        keys, counts, levels = slots
        return (keys[slot] == key) & (counts[slot] > 0), counts[slot], levels[slot]

    def after(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """log10 of the numerator of a token's probability, from the levels of the token and of its pair."""
        c = middle(one)
        return np.log10(np.minimum(middle(two), c) + self.mu * (c + 1) / (self.tokens + self.types + 1))

    def before(self, one: np.ndarray) -> np.ndarray:
        """log10 of the denominator of the token that follows. Each token of a text comes before one other, the end before the first."""
        return np.log10(middle(one) + self.mu)


# What travels: a group's documents (docs); rare words, with the pairs that they end (words, pairs as buckets and then keys,
# rows); pairs (keys of 4 bytes, the levels of their words, rows); pairs from a rare word's bucket (also counts, and rows as uids, uid
# being null); what was read (ones, twos, rows and perhaps counts). A uid is a group's number times 2^16, plus the row.
MESSAGES = pa.schema([("bucket", pa.int32()), ("uid", pa.int64()), *[(c, pa.binary()) for c in ("docs", "words", "pairs", "rows", "counts", "ones", "twos", "segment")]])
MESSAGE = "bucket int, uid long, docs binary, words binary, pairs binary, rows binary, counts binary, ones binary, twos binary, segment binary"
GROUP_ROWS = 1 << 16
DOCS = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("score", pa.float64())])


def _messages(n: int, **given) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(given[f.name], f.type) if f.name in given else pa.nulls(n, f.type) for f in MESSAGES], schema=MESSAGES)


def home(uid: np.ndarray, n: int) -> np.ndarray:
    """The bucket by way of which what belongs to a group of rows returns."""
    return bucket_of(mix(uid.astype(np.uint64)), n)


def _split(by: np.ndarray, n: int, **columns: tuple[np.ndarray, object]) -> tuple[np.ndarray, dict[str, list[bytes]]]:
    """The values 0 to n - 1 of by that occur, and for each the columns' elements as bytes."""
    order = np.argsort(by, kind="stable")
    edges = np.searchsorted(by[order], np.arange(n + 1))
    full = np.flatnonzero(np.diff(edges))
    out = {}
    for name, (x, pack) in columns.items():
        x = x[order]
        out[name] = [pack(x[edges[k] : edges[k + 1]]) for k in full]
    return full, out


def _scorer(shared):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Frequent = shared.value
        n = model.n
        group = TaskContext.get().partitionId() << 24
        for batch in batches:
            data, offs = text_bytes(batch.column("text"))
            for i, j in row_groups(offs, GROUP_BYTES, GROUP_ROWS):
                t, toff = tokens(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                p = pairs(t)
                pb = bucket_of(p, n)
                uid = group * GROUP_ROWS
                row = np.repeat(np.arange(j - i, dtype=np.uint16), np.diff(toff))
                hit, c, one = Frequent.find(model.words, t)
                hit_pair, _, two = Frequent.find(model.pairs, (p & LOW32) | (pb.astype(np.uint64) << np.uint64(40)))
                hit_pair &= hit
                logs = np.where(hit_pair, model.after(one, two), 0.0) - np.where(hit, model.before(one), 0.0)
                docs = pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(i, j - i),
                        batch.column("held_out").slice(i, j - i),
                        pa.array(np.diff(toff)),
                        pa.array(np.add.reduceat(hit.astype(np.int64), toff[:-1])),
                        pa.array(np.add.reduceat(np.where(hit, np.log10(c.astype(np.float64) + 1), 0.0), toff[:-1])),
                        pa.array(np.add.reduceat(logs, toff[:-1])),
                    ],
                    schema=DOCS,
                )
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, DOCS) as writer:
                    writer.write_batch(docs)
                yield _messages(1, bucket=home(np.array([uid]), n), uid=[uid], docs=[sink.getvalue().to_pybytes()])
                rare = np.flatnonzero(~hit)
                b, made = _split(bucket_of(t[rare], n), n, words=(t[rare], _raw), pairs=(p[rare], _raw), buckets=(pb[rare].astype(np.int32), _raw), rows=(row[rare], _steps))
                made["pairs"] = [_planes(np.frombuffer(b_, np.int32)) + _pack32(np.frombuffer(p_, np.uint64)) for b_, p_ in zip(made.pop("buckets"), made["pairs"], strict=True)]
                yield _messages(len(b), bucket=b, uid=np.full(len(b), uid), **made)
                rest = np.flatnonzero(hit & ~hit_pair)
                b, made = _split(pb[rest], n, pairs=(p[rest], _pack32), ones=(one[rest], _raw), rows=(row[rest], _steps))
                yield _messages(len(b), bucket=b, uid=np.full(len(b), uid), **made)
                group += 1

    return score


def _reader(n: int):
    """Reads one bucket's n-grams: rare words give pairs for other buckets, pairs give what is read; all else passes."""

    def cells(t: pa.Table, column: str, kind) -> np.ndarray:
        return np.concatenate([np.frombuffer(x, kind) for x in t.column(column).to_pylist()] or [np.zeros(0, kind)])

    def uids(t: pa.Table) -> np.ndarray:
        """The uid of each element."""
        parts = [_unsteps(r, np.int64) if u is None else _unsteps(r, np.uint16).astype(np.int64) + u for u, r in zip(t.column("uid").to_pylist(), t.column("rows").to_pylist(), strict=True)]
        return np.concatenate(parts or [np.zeros(0, np.int64)])

    def read(t: pa.Table) -> pa.Table:
        bucket = t.column("bucket")[0].as_py()
        has = lambda c: pc.is_valid(t.column(c))
        tables = t.filter(has("segment"))
        model = Model(tables.select(["bucket", "segment"]).to_pylist(), n)
        here = lambda key: model.levels(key, np.full(len(key), bucket))
        passing = t.filter(pc.or_(has("docs"), has("twos")))
        if len(passing):
            passing = passing.set_column(0, MESSAGES.field(0), pa.array(home(passing.column("uid").to_numpy(), n), pa.int32()))
        out = [passing.cast(MESSAGES)]
        rare = t.filter(pc.and_not(has("words"), has("segment")))
        if len(rare):
            w = cells(tables, "words", np.uint64)
            c = cells(tables, "counts", np.uint8)
            c = c.view(f"u{len(c) // len(w)}").astype(np.int64) if len(w) else c
            h, u = cells(rare, "words", np.uint64), uids(rare)
            halves = [(x[: len(x) // 2], x[len(x) // 2 :]) for x in rare.column("pairs").to_pylist()]
            pb, p = np.concatenate([_unplanes(x, np.int32) for x, _ in halves]), np.concatenate([_unpack32(x) for _, x in halves])
            at = np.minimum(np.searchsorted(w, h), max(len(w) - 1, 0))
            count = np.where(w[at] == h, c[at], 0) if len(w) else np.zeros(len(h), np.int64)
            b, made = _split(pb, n, pairs=(p, _pack32), ones=(here(salted(h & LOW40, 1)), _raw), rows=(u, _steps), counts=(count, _planes))
            out.append(pa.Table.from_batches([_messages(len(b), bucket=b, **made)]))
        asked = t.filter(pc.and_not(has("pairs"), has("words")))
        for part in (asked.filter(pc.is_null(asked.column("counts"))), asked.filter(pc.is_valid(asked.column("counts")))):
            if not len(part):
                continue
            p, one, u = np.concatenate([_unpack32(x) for x in part.column("pairs").to_pylist()]), cells(part, "ones", np.uint8), uids(part)
            order = np.argsort(u, kind="stable")
            p, one, u = p[order], one[order], u[order]
            groups, by = np.unique(u >> 16, return_inverse=True)
            columns = {"rows": ((u & 0xFFFF).astype(np.uint16), _steps), "ones": (one, _raw), "twos": (here(salted(p, 2)), _raw)}
            if part.column("counts").null_count == 0:
                counts = np.concatenate([_unplanes(x, np.int64) for x in part.column("counts").to_pylist()])
                columns["counts"] = (counts[order], _planes)
            _, made = _split(by, len(groups), **columns)
            out.append(pa.Table.from_batches([_messages(len(groups), bucket=home(groups << 16, n), uid=groups << 16, **made)]))
        return pa.concat_tables(out)

    return read


def _adder(shared):
    def add(t: pa.Table) -> pa.Table:
        """The documents of a group of rows, with all that was read for them."""
        model: Frequent = shared.value
        docs = pa.ipc.open_stream(t.filter(pc.is_valid(t.column("docs"))).column("docs")[0].as_py()).read_all()
        known, base, score = (docs.column(c).to_numpy().copy() for c in ("n_known", "base", "score"))
        sent = t.filter(pc.is_valid(t.column("twos")))
        for r, one, two, c in zip(*(sent.column(c).to_pylist() for c in ("rows", "ones", "twos", "counts")), strict=True):
            r, one, two = _unsteps(r, np.uint16), np.frombuffer(one, np.uint8), np.frombuffer(two, np.uint8)
            logs = model.after(one, two)
            if c is not None:
                c = _unplanes(c, np.int64)
                logs -= model.before(one)
                np.add.at(base, r, np.log10(c + 1.0))
                np.add.at(known, r, c > 0)
            np.add.at(score, r, logs)
        for k, x in (("n_known", known), ("base", base), ("score", score)):
            docs = docs.set_column(docs.schema.get_field_index(k), k, pa.array(x))
        return docs

    return add


def remainder(doc_id: Column, n: int) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(n))


def score_texts(docs: DataFrame, split: tuple[int, int] = SPLIT, mu: float = MU, top: int = TOP) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score for every row of docs."""
    spark = docs.sparkSession
    n = partitions(spark)
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (remainder(F.col("doc_id"), split[0]) == split[1]).alias("held_out"), "text")
    blobs = named.filter("NOT held_out").select("text").mapInArrow(_counter(n), BLOBS)
    each = max(1, top // n)
    tables = checkpoint(blobs.groupBy("bucket").applyInArrow(_table(each, each), TABLES))
    model = Frequent(tables.select("types", "tokens", "top", "top_pairs").collect(), n, mu)  # 48 * top bytes at most
    shared = spark.sparkContext.broadcast(model)
    segments = tables.select("bucket", "segment")
    sent = named.mapInArrow(_scorer(shared), MESSAGE).unionByName(tables.select("bucket", "words", "counts", "segment"), allowMissingColumns=True)
    sent = sent.groupBy("bucket").applyInArrow(_reader(n), MESSAGE).unionByName(segments, allowMissingColumns=True)
    back = sent.groupBy("bucket").applyInArrow(_reader(n), MESSAGE)
    rows = back.select("uid", "docs", "rows", "counts", "ones", "twos").groupBy("uid").applyInArrow(_adder(shared), "doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double")
    log_all = float(np.log10(model.tokens + model.types + 1))
    return rows.select(
        "doc_id",
        "held_out",
        "n_tokens",
        "n_known",
        F.lit(int(model.tokens)).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * log_all).alias("base_score"),
        "score",
    )


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))


QUERIES = {"op2_lm_score": op2_lm_score}
ORACLES: dict[str, str] = {}
