"""Duplicates: first-seen windows, the two-key sequential rule, and near-duplicate flags."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions import fuzzy
from siltstone.sources.tables import shared_base


def checkpoint(df: DataFrame) -> DataFrame:
    """df cut off from its lineage, in the cluster's shared folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_base(df.sparkSession))
    return df.checkpoint(eager=True)


def first_seen(df: DataFrame, key: Sequence[str], seq: str) -> DataFrame:
    """df with first_seq, the smallest seq of its key, and is_duplicate. An aggregate joined back, so a hot key is summed before it moves and Spark can split it."""
    first = df.groupBy(*key).agg(F.min(seq).alias("first_seq"))
    return df.join(first, list(key)).withColumn("is_duplicate", F.col(seq) != F.col("first_seq"))


def canonical_winner(df: DataFrame, canonical: str, url: str, seq: str) -> DataFrame:
    """df with winner_url, the first original URL of each canonical one; repeats of the winner are canonical too."""
    first = df.groupBy(canonical).agg(F.min_by(url, seq).alias("winner_url"))
    return df.join(first, canonical).withColumn("is_canonical", F.col(url) == F.col("winner_url"))


def sequential_two_key(df: DataFrame, seq: str, one: str, two: str) -> DataFrame:
    """(seq, status, reason): rows in order; a row is dropped if an earlier kept row has its first or second key.

    Three states in rounds: a row is kept if it is the first undecided of both its keys and no kept row has them, dropped
    if an earlier kept row shares a key. Each round decides at least the first undecided row, and in practice most.
    """
    state = checkpoint(df.select(F.col(seq).alias("seq"), F.col(one).alias("k1"), F.col(two).alias("k2"), F.lit(None).cast("string").alias("status"), F.lit(None).cast("string").alias("reason")))
    while True:
        def least(key: str) -> DataFrame:
            open_ = F.when(F.col("status").isNull(), F.col("seq"))
            kept = F.when(F.col("status") == "kept", F.col("seq"))
            return state.groupBy(key).agg(F.min(open_).alias(f"open_{key}"), F.min(kept).alias(f"kept_{key}"))

        both = state.join(least("k1"), "k1").join(least("k2"), "k2")
        dup1, dup2 = F.col("kept_k1") < F.col("seq"), F.col("kept_k2") < F.col("seq")
        head = (F.col("open_k1") == F.col("seq")) & (F.col("open_k2") == F.col("seq"))
        undecided = F.col("status").isNull()
        status = F.when(~undecided, F.col("status")).when(dup1 | dup2, "dropped").when(head, "kept")
        reason = F.when(~undecided, F.col("reason")).when(dup1, "url").when(dup2, "content_hash")
        state = checkpoint(both.select("seq", "k1", "k2", status.alias("status"), reason.alias("reason")))
        if not state.filter("status IS NULL").limit(1).count():
            return state.select(F.col("seq").alias(seq), "status", "reason")


BITS = 512
#: The most frequent words, whose order all tasks know, and numbers that are sent to all tasks at most.
FREQUENT, SENT = 200_000, 2_000_000


def _sent(ids: DataFrame) -> DataFrame:
    """ids, sent to all tasks if these are not too many, so that the rows that they choose need not move."""
    ids = checkpoint(ids)
    return F.broadcast(ids) if ids.count() <= SENT else ids


def _rare(shared, share: float):
    """Batches (seq, set) to (seq, w, total): each text's infrequent words, those of its frequent ones that may be among the rarest of twice the share of its letters, and all its letters."""

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = pa.array(shared.value, pa.string())
        for batch in batches:
            words, owner = batch.column("set").flatten(), pc.list_parent_indices(batch.column("set")).to_numpy(zero_copy_only=False)
            size = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64) + 1
            total = np.bincount(owner, weights=size, minlength=batch.num_rows)
            place = pc.fill_null(pc.index_in(words, value_set=frequent), -1).to_numpy(zero_copy_only=False)
            known = np.flatnonzero(place >= 0)
            known = known[np.lexsort((place[known], owner[known]))]
            before = np.cumsum(size[known]) - size[known]
            before -= before[np.searchsorted(owner[known], owner[known])]
            keep = np.r_[np.flatnonzero(place < 0), known[before <= 2 * (share * total[owner[known]] + 1)]]
            yield pa.RecordBatch.from_arrays([batch.column("seq").take(pa.array(owner[keep])), words.take(pa.array(keep)), pa.array(total[owner[keep]].astype(np.int64))], ["seq", "w", "total"])

    return choose


def _bit(word: Column | str) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(BITS)).cast("int")


def _bits(words: Column) -> Column:
    """A table of bits, in longs, of which those of the words are set."""
    places = F.transform(words, _bit)
    return F.transform(F.sequence(F.lit(0), F.lit(BITS // 64 - 1)), lambda i: F.aggregate(F.filter(places, lambda p: F.shiftright(p, 6) == i), F.lit(0).cast("long"), lambda x, p: x.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), p.bitwiseAND(F.lit(63))))))


def likely_pairs(posts: DataFrame, met: DataFrame, ok: Column) -> DataFrame:
    """Distinct (a, b) of posts (w, seq, posted, most) and rows that have w (w, seq, bits), where `ok`: of the posted tokens of a no more letters are missing in b than `most`.

    A bit that is not set is a token that b lacks, so no pair is lost; the join's rows are judged as they arise, and only pairs left are exchanged.
    """
    pairs = posts.withColumnRenamed("seq", "a").join(met.withColumnRenamed("seq", "b"), "w").filter(ok & (F.col("a") != F.col("b")))
    unset = lambda p: F.call_function("shiftright", F.get("bits", F.shiftright(p, 6)), p.bitwiseAND(F.lit(63))).bitwiseAND(F.lit(1).cast("long")) == 0
    lacking = F.aggregate("posted", F.lit(0), lambda n, t: n + F.when(unset(t["bit"]), t["size"]).otherwise(F.lit(0)))
    return pairs.filter(lacking <= F.col("most")).select("a", "b").distinct()


def near_duplicate_flags(df: DataFrame, seq: str, text: str, least: float = 95.0) -> DataFrame:
    """(seq, near_duplicate_of): the earliest earlier row whose token set is over `least` per cent alike.

    A pair is alike by its shared tokens if these hold over least / (200 - least) of the letters of one of its two texts, so
    that only a known share of that text's letters may be missing. Each text posts its rarest tokens, up to twice that share:
    a text alike has at least half of them by letters, and one at least of those that make up the share. All such pairs meet
    by these, however frequent they are, and where they meet, before they move, likely_pairs() drops those that lack letters
    for sure, by a table of bits of all tokens. Two rounds: each row with the two rows that most of its posted tokens name as their
    earliest, which settles large groups of copies with two comparisons a row; then, before the partner so found, with all
    others. Pairs alike in the letters of different tokens are found where they share as much of some text's rare tokens.
    Rows of one token set are one row, the earliest, which the later ones name unless it names another.
    """
    base = df.select(F.col(seq).alias("seq"), F.array_sort(F.array_distinct(F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"\s+"), lambda w: w != ""))).alias("set"))
    same = base.select("seq", F.md5(F.array_join("set", " ")).alias("k"))
    firsts = same.join(same.groupBy("k").agg(F.min("seq").alias("ref")), "k").select("seq", "ref")
    reps = checkpoint(base.join(_sent(firsts.filter("seq = ref").select("seq")), "seq", "left_semi").filter(F.size("set") > 0))
    words = reps.select("seq", F.explode("set").alias("w"))
    freq = checkpoint(words.groupBy("w").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first")).filter("n > 1"))
    row = Window.partitionBy("seq")
    top = [tuple(r) for r in freq.select("n", "w").orderBy(F.desc("n")).limit(FREQUENT + 1).collect()]
    frequent = [w for n, w in sorted(top) if len(top) <= FREQUENT or n > top[-1][0]]
    share = 1 - least / (200.0 - least)
    shared = df.sparkSession.sparkContext.broadcast(frequent)
    rare = reps.mapInArrow(_rare(shared, share), f"seq {reps.schema['seq'].dataType.simpleString()}, w string, total long")
    ranked = rare.join(freq, "w", "left").withColumn("n", F.coalesce("n", F.lit(1))).withColumn("first", F.coalesce("first", "seq")).withColumn("size", F.length("w") + 1)
    ranked = ranked.withColumn("rarer", F.coalesce(F.sum("size").over(row.orderBy("n", "w").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ranked = ranked.withColumn("missing", share * F.col("total") + 1).filter(F.col("rarer") <= 2 * F.col("missing"))
    ranked = checkpoint(ranked.select("w", "seq", "size", "missing", "first", "n", (F.col("rarer") <= F.col("missing")).alias("leads")))
    posted = ranked.filter("n > 1")
    posted_sets = ranked.groupBy("seq").agg(F.collect_list(F.struct(_bit("w").alias("bit"), F.col("size").cast("int").alias("size"))).alias("posted"), F.first("missing").alias("missing")).select("seq", "posted", F.col("missing").alias("most"))
    bits = reps.select("seq", _bits(F.col("set")).alias("bits"))
    sets = reps.select("seq", F.array_join("set", " ").alias("t"))

    def alike(pairs: DataFrame) -> DataFrame:
        """(x, near): the smallest partner of each later row x among pairs (a, b)."""
        pairs = pairs.select(F.greatest("a", "b").alias("x"), F.least("a", "b").alias("y")).filter("x <> y").distinct()
        both = pairs.join(sets.select(F.col("seq").alias("x"), F.col("t").alias("tx")), "x").join(sets.select(F.col("seq").alias("y"), F.col("t").alias("ty")), "y")
        return both.filter(fuzzy.token_set_ratio("tx", "ty") > least).groupBy("x").agg(F.min("y").alias("near"))

    named = posted.filter("first < seq").groupBy("seq", "first").agg(F.sum("size").alias("size"))
    hubs = named.withColumn("k", F.row_number().over(row.orderBy(F.desc("size"), "first"))).filter("k <= 2").select(F.col("seq").alias("a"), F.col("first").alias("b"))
    bound = checkpoint(reps.select("seq").join(alike(hubs), F.col("seq") == F.col("x"), "left").select("seq", F.coalesce("near", "seq").alias("bound"), "near"))
    # A pair's later row is the one that posts (mine) or the one that has what an earlier one posts (theirs).
    posts = posted.filter("leads").join(posted_sets, "seq").join(bound, "seq")
    leading = posted.filter("leads").select(F.xxhash64("w").alias("h")).distinct()
    met = words.withColumn("h", F.xxhash64("w")).join(_sent(leading), "h", "left_semi").drop("h").join(bits, "seq").join(bound, "seq")
    mine = likely_pairs(posts.filter(F.col("first") < F.col("bound")), met.drop("bound", "near"), F.col("b") < F.col("bound"))
    later = posted.filter("leads").groupBy("w").agg(F.min("seq").alias("first_post"))
    theirs = likely_pairs(posts.drop("bound", "near"), met.join(later, "w").filter(F.col("first_post") < F.col("bound")), F.col("a") < F.col("bound"))
    earlier = alike(mine.unionByName(theirs)).withColumnRenamed("near", "earlier")
    best = bound.join(earlier, F.col("seq") == F.col("x"), "left").select(F.col("seq").alias("x"), F.coalesce("earlier", "near").alias("near"))
    out = firsts.join(best, firsts["ref"] == best["x"], "left")
    return out.select("seq", F.coalesce("near", F.when(F.col("ref") != F.col("seq"), F.col("ref"))).alias("near_duplicate_of"))
