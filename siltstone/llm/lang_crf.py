"""Language ID: a linear-chain conditional random field labels the words of a text, code-switched ones included.

Words are runs of letters, lower-cased. Their features are character bigrams and trigrams with word edges, affixes of
three letters and the word itself (a learned lexicon), hashed into one table of weights by language; transitions between
the languages of neighbouring words are learned too. Marginals come from exact forward-backward passes over whole texts,
done in blocks of words at once. A text's language is that with the largest mean marginal, its score that mean.

Training takes a bounded sample of labelled rows: about TRAIN_ROWS different texts a language, chosen by a hash of the
text, so that copies and rows with equal or null doc_ids take no others' places; of a longer text one window of
TRAIN_CHARS characters at a hashed place. Half of the training sequences are put together from
short pieces of several texts, so that switches are learned. Prediction reads whole texts only, no label, source or id.

Null texts and texts without a letter are `und` with score 0, and so is every text if nothing was learned (an empty
table, or no labels). A very long text is labelled whole, in one piece. Rows without a doc_id count as remainder 0. Repeated rows get equal rows; further columns are
kept out of the result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.common import row_groups, table, text_bytes

UNKNOWN = "und"
TABLE_BITS = 18
TRAIN_ROWS, TRAIN_CHARS, EPOCHS, SPLIT = 250, 4000, 3, (3, 1)
FITS = 0.75  # words of random letters have a mean largest marginal of about 0.63, texts of sf0.1 one of 0.95 or more in 99 of 100 cases
BLOCK = 128
GROUP = 1 << 18


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def _hash(x: np.ndarray, salt: int) -> np.ndarray:
    """1 to 2^TABLE_BITS - 1; 0 is the slot without weight."""
    x = (x + np.uint64(salt * 0x1F123BB5 + 1)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return np.maximum(x >> np.uint64(64 - TABLE_BITS), np.uint64(1)).astype(np.int32)


def words_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(x, first, offs): letters of all words on end with a 0 before each and one at the end, the places of those zeros, word offsets of the rows."""
    data, offs = text_bytes(pc.utf8_lower(column))
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    before = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    edges = before[offs]
    ok = _letters()[points]
    start = ok.copy()
    start[1:] &= ~ok[:-1]
    cut = edges[(edges > 0) & (edges < len(points))]
    start[cut] = ok[cut]
    first = np.flatnonzero(start)
    kept = np.flatnonzero(ok)
    number = np.cumsum(start[kept])
    x = np.zeros(len(kept) + len(first) + 1, np.uint64)
    x[np.arange(len(kept)) + number] = points[kept]
    zeros = np.searchsorted(kept, first) + np.arange(len(first))
    return x, zeros, np.searchsorted(first, edges)


def features(x: np.ndarray, zeros: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bigram and trigram slots at each letter place (len(x) - 1 of them), and (words, 3) slots of prefix, suffix and word."""
    n = len(x) - 1
    two = x[:-1] << np.uint64(21) | x[1:]
    bi = _hash(two, 1)
    tri = np.zeros(n, np.int32)
    if n > 1:
        tri[:-1] = _hash(two[:-1] << np.uint64(21) | x[2:], 2)
        tri[:-1][x[1:-1] == 0] = 0
    ends = np.append(zeros[1:], n)
    lens = ends - zeros - 1
    long = lens >= 3
    pad = np.concatenate([x, np.zeros(4, np.uint64)])
    affix = lambda at: pad[at] << np.uint64(42) | pad[at + 1] << np.uint64(21) | pad[at + 2]
    pre = np.where(long, _hash(affix(zeros + 1), 3), 0)
    suf = np.where(long, _hash(affix(np.maximum(ends - 3, 0)), 4), 0)
    power = np.cumprod(np.full(int(lens.max(initial=0)) + 1, 0x100000001B3, np.uint64))
    place = np.arange(n) - np.repeat(zeros, lens + 1)
    whole = _hash(np.add.reduceat(x[:-1] * power[place], zeros), 5) if len(zeros) else np.zeros(0, np.int32)
    return bi, tri, np.stack([pre, suf, whole], axis=1)


def emissions(feats: tuple, zeros: np.ndarray, weights: np.ndarray) -> np.ndarray:
    bi, tri, own = feats
    if not len(zeros):
        return np.zeros((0, weights.shape[1]))
    score = weights[bi]
    score += weights[tri]
    out = np.add.reduceat(score, zeros, axis=0).astype(np.float64)
    for c in range(own.shape[1]):
        out += weights[own[:, c]]
    return out


def forward_backward(score: np.ndarray, first: np.ndarray, trans: np.ndarray, start: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(marginals, alpha, beta, e) of chains on end; first marks the first word of each. Exact: blocks meet by their products."""
    n, s = score.shape
    nb = max(1, -(-n // block))
    e = np.ones((nb * block, s))
    e[:n] = np.exp(score - score.max(axis=1, keepdims=True))
    e = e.reshape(nb, block, s)
    head = np.zeros(nb * block, bool)
    head[:n] = first
    head[n:] = True
    head = head.reshape(nb, block)
    a, st = np.exp(trans), np.exp(start)
    prod = np.broadcast_to(np.eye(s), (nb, s, s)).copy()
    for t in range(block):
        new = prod @ a
        h = np.flatnonzero(head[:, t])
        if len(h):
            new[h] = prod[h].sum(axis=2, keepdims=True) * st
        new *= e[:, t, None, :]
        prod = new / new.max(axis=(1, 2), keepdims=True)
    into, out = np.empty((nb, s)), np.empty((nb, s))
    v = np.full(s, 1.0 / s)
    for b in range(nb):
        into[b] = v
        v = v @ prod[b]
        v /= v.sum()
    v = np.ones(s)
    for b in range(nb - 1, -1, -1):
        out[b] = v
        v = prod[b] @ v
        v /= v.sum()
    alpha, beta = np.empty_like(e), np.empty_like(e)
    v = into
    for t in range(block):
        new = v @ a
        h = np.flatnonzero(head[:, t])
        if len(h):
            new[h] = st
        new *= e[:, t]
        v = new / new.sum(axis=1, keepdims=True)
        alpha[:, t] = v
    v = out
    for t in range(block - 1, -1, -1):
        beta[:, t] = v
        new = (v * e[:, t]) @ a.T
        h = np.flatnonzero(head[:, t])
        if len(h):
            new[h] = 1.0
        v = new / new.sum(axis=1, keepdims=True)
    alpha, beta, e = (x.reshape(-1, s)[:n] for x in (alpha, beta, e))
    gamma = alpha * beta
    gamma /= gamma.sum(axis=1, keepdims=True)
    return gamma, alpha, beta, e


class Crf:
    """Weights of a trained field; langs are its labels."""

    def __init__(self, langs: list[str]):
        self.langs = langs
        n = len(langs)
        self.weights = np.zeros((1 << TABLE_BITS, n), np.float32)
        self.trans, self.start = np.zeros((n, n)), np.zeros(n)

    def fit(self, texts: list[str], labels: list[int], epochs: int = EPOCHS, seed: int = 5, rate: float = 0.3) -> Crf:
        """AdaGrad on the log-likelihood of word labels; sequences are pieces of texts, half of them mixed across texts."""
        rng, n = np.random.default_rng(seed), len(self.langs)
        x, zeros, offs = words_of(pa.array(texts, pa.string()))
        if not len(zeros):
            return self
        bi, tri, own = features(x, zeros)
        label = np.repeat(np.array(labels), np.diff(offs))
        ends = np.append(zeros[1:], len(x) - 1)
        pieces = []
        for r in range(len(texts)):
            at = int(offs[r])
            while at < offs[r + 1]:
                to = min(int(offs[r + 1]), at + int(rng.integers(4, 40)))
                pieces.append((at, to))
                at = to
        g2 = np.full(self.weights.shape, 1e-2, np.float32)
        t2, s2 = np.full((n, n), 1e-2), np.full(n, 1e-2)
        for _ in range(epochs):
            order = np.arange(len(pieces))
            mixed = rng.random(len(pieces)) < 0.5
            order[mixed] = rng.permutation(order[mixed])
            size = 400
            batches = [order[i : i + size] for i in range(0, len(order), size)]
            for b in rng.permutation(len(batches)):
                spans = [pieces[i] for i in batches[b]]
                w = np.concatenate([np.arange(p, q) for p, q in spans])
                head = np.zeros(len(w), bool)
                head[np.cumsum([0, *[q - p for p, q in spans[:-1]]])[:: int(rng.integers(3, 9))]] = True
                lens = ends[w] - zeros[w]
                zero = np.cumsum(lens) - lens
                place = np.repeat(zeros[w] - zero, lens) + np.arange(int(lens.sum()))
                f = (bi[place], tri[place], own[w])
                gamma, alpha, beta, e = forward_backward(emissions(f, zero, self.weights), head, self.trans, self.start, 32)
                diff = gamma.copy()
                diff[np.arange(len(w)), label[w]] -= 1
                inner = np.flatnonzero(~head)
                xi = alpha[inner - 1][:, :, None] * np.exp(self.trans) * (e[inner] * beta[inner])[:, None, :]
                xi /= xi.sum(axis=(1, 2), keepdims=True)
                dt = xi.sum(axis=0)
                np.add.at(dt, (label[w][inner - 1], label[w][inner]), -1)
                ds = diff[head].sum(axis=0)
                slots = np.concatenate([f[0], f[1], *f[2].T])
                each = np.concatenate([np.repeat(np.arange(len(w)), lens)] * 2 + [np.arange(len(w))] * 3)
                keep = slots > 0
                used, inverse = np.unique(slots[keep], return_inverse=True)
                grad = np.stack([np.bincount(inverse, diff[each[keep], c], len(used)) for c in range(n)], axis=1)
                g2[used] += grad**2
                self.weights[used] -= rate * grad / np.sqrt(g2[used])
                t2 += dt**2
                s2 += ds**2
                self.trans -= rate * dt / np.sqrt(t2)
                self.start -= rate * ds / np.sqrt(s2)
        return self

    def label_words(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Marginals of all words of a column of texts, and the word offsets of its rows."""
        x, zeros, offs = words_of(column)
        if not len(zeros):
            return np.zeros((0, len(self.langs))), offs
        head = np.zeros(len(zeros), bool)
        head[offs[:-1][np.diff(offs) > 0]] = True
        return forward_backward(emissions(features(x, zeros), zeros, self.weights), head, self.trans, self.start)[0], offs

    def read(self, column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Languages and scores of texts, and the means of their words' largest marginals, whatever languages those are of."""
        if not self.langs:
            return [UNKNOWN] * len(column), np.zeros(len(column)), np.zeros(len(column))
        gamma, offs = self.label_words(column)
        sums = np.concatenate([np.zeros((1, len(self.langs) + 1)), np.cumsum(np.column_stack([gamma, gamma.max(axis=1)]), axis=0)])
        n = np.diff(offs)
        mean = (sums[offs[1:]] - sums[offs[:-1]]) / np.maximum(n, 1)[:, None]
        mean, fit = mean[:, :-1], mean[:, -1]
        best = mean.argmax(axis=1)
        return [self.langs[b] if k else UNKNOWN for b, k in zip(best, n, strict=True)], np.clip(np.where(n > 0, mean.max(axis=1), 0.0), 0.0, 1.0), np.where(n > 0, fit, 0.0)

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray]:
        return self.read(column)[:2]


def remainder(doc_id: Column, n: int) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(n))


def train(docs: DataFrame, rows: int = TRAIN_ROWS, chars: int = TRAIN_CHARS, split: tuple[int, int] | None = SPLIT, epochs: int = EPOCHS) -> Crf:
    """A field for the labels of docs (text, lang); with split=(m, r) rows of crc32(doc_id) mod m = r are left out."""
    known = docs.filter("lang IS NOT NULL AND text IS NOT NULL")
    if split:
        known = known.filter(remainder(F.col("doc_id"), split[0]) != split[1])
    found = known.groupBy("lang").agg(F.approx_count_distinct(F.xxhash64("text"), 0.02).alias("n"))
    counts = {r["lang"]: r["n"] for r in found.collect()}  # one row a language: its different texts
    if not counts:
        return Crf([])
    place = F.pmod(F.xxhash64("text", F.lit(17)), F.lit(1 << 30))
    # The hash lets through twice the texts wanted on average, and the first of them in its order are taken. Copies are one text.
    limit = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1 << 30, int((1 << 30) * 2 * rows / n)) if n > 2 * rows else 1 << 30))])
    window = F.substring(F.col("text"), (F.pmod(F.xxhash64("text", F.lit(23)), F.greatest(F.length("text") - chars + 1, F.lit(1))) + 1).cast("int"), F.lit(chars))
    chosen = known.withColumn("place", place).filter(F.col("place") < limit[F.col("lang")]).select("lang", "place", window.alias("text")).groupBy("lang", "place").agg(F.min("text").alias("text")).collect()
    langs, texts, labels, taken = sorted(counts), [], [], {}
    for r in sorted(chosen, key=lambda r: (r["place"], r["lang"])):
        taken[r["lang"]] = taken.get(r["lang"], 0) + 1
        if taken[r["lang"]] <= rows:
            texts.append(r["text"])
            labels.append(langs.index(r["lang"]))
    return Crf(langs).fit(texts, labels, epochs)


def _predictor(shared):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            _, offs = text_bytes(batch.column("text"))
            for i, j in row_groups(offs, GROUP):
                part = batch.slice(i, j - i)
                lang, score = model.predict(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return predict


def identify(docs: DataFrame, model: Crf, split: tuple[int, int] = SPLIT) -> DataFrame:
    """doc_id, held_out, lang_pred and score for every row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (remainder(F.col("doc_id"), split[0]) == split[1]).alias("held_out"), "text")
    return rows.mapInArrow(_predictor(shared), "doc_id long, held_out boolean, lang_pred string, score double")


def _keeper(shared, least: float, fits: float):
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            _, offs = text_bytes(batch.column("text"))
            for i, j in row_groups(offs, GROUP):
                part = batch.slice(i, j - i)
                lang, score, fit = model.read(part.column("text"))
                yield part.filter(pa.array([k != UNKNOWN and (s >= least or f >= fits) for k, s, f in zip(lang, score, fit, strict=True)], pa.bool_()))

    return keep


def keep_known(docs: DataFrame, model: Crf, least: float = 0.5, fits: float = FITS) -> DataFrame:
    """The rows of docs, with all columns, whose text has a language with a score of at least `least`, or is of words that each fit some language.

    The second holds for texts that switch between languages: no language need have a large share of them.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(_keeper(shared, least, fits), docs.schema)


def op3_lang_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, train(docs))


QUERIES = {"op3_lang_crf": op3_lang_crf}
ORACLES: dict[str, str] = {}
