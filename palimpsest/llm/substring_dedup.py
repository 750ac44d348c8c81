"""Substring dedup by recompression of word sequences.

Recompression rounds rename each text's word sequence: a round first names the
maximal runs of a symbol, then the adjacent pairs whose left symbol falls into
one half of the alphabet and right symbol into the other, halves drawn anew each
round. A name is a hash of what it stands for, so the same run or pair has the
same name in every document of the corpus without a dictionary. Beside its name
a symbol keeps its context, the exact stretch of words that settled how it was
formed; equal stretches of text hold equal symbols wherever the context lies
inside.

1. Every window of ``size`` words chooses its anchor: of the symbols whose
   context lies inside it, and of those the highest-level ones, the one whose
   name hashes least. Equal windows choose the same anchor. Neighbouring windows
   mostly share one; such a run of windows is one row: anchor name, hash of all
   the words it spans, place.
2. A Spark round counts the anchor names of the whole corpus. A run whose name is
   met once ends there. Where all runs of one name span equal words, all of them
   are one long repeat: the words go, and nothing more need be compared.
3. A Spark round counts the windows of the other runs, those whose name is shared
   but whose surroundings differ, by 128-bit hashes of all their words; those
   found twice go.

Names are counted by grouped sums, which Spark combines before the shuffle, and
met again in joins whose hot keys Spark may split. Equal windows of a task are
counted before they are shuffled (the spare ones are known to repeat and travel by
keys of their own), so a window of a passage in a third of all documents sends a
row a task, not a row a document.

Words are runs of other than ASCII white space, unchanged. A word has two
independent 64-bit hashes; a window's 128 bits are one polynomial of each.

Rows: a null text has no words. Rows that repeat or share an id are separate
documents, so a repeated text of ``size`` words or more goes whole, both times.
Texts under ``size`` words keep all. An empty table gives no rows. A very long
text is worked on whole, in memory and time in proportion to its length. Only
``doc_id`` and ``text`` are read, so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Runs are named in every so many rounds; a repeated symbol never pairs with
#: itself, so other rounds leave runs as they are.
RUNS_EVERY = 5


def levels(w, barrier, rounds: int = 5):
    """Symbols by level: (name, start, context low, context high), in order.

    barrier marks slots between documents; they never merge.
    """
    import numpy as np

    n = len(w)
    name, start = w.copy(), np.arange(n)
    low, high, wall = start.copy(), start + 1, barrier.copy()
    found = [(name, start, low, high, wall)]

    def joined(first, last, new_name, left_dep, right_dep):
        """Units from symbol first to last; what they depend on beside them."""
        lo, hi = low[first].copy(), high[last].copy()
        lo[left_dep] = low[np.maximum(first[left_dep] - 1, 0)]
        hi[right_dep] = high[np.minimum(last[right_dep] + 1, len(low) - 1)]
        return new_name, start[first], lo, hi, wall[first]

    for r in range(rounds):
        if len(name) < 2:
            break
        if r % RUNS_EVERY == 0:
            same = (name[1:] == name[:-1]) & ~wall[1:] & ~wall[:-1]
            first = np.flatnonzero(np.concatenate([[True], ~same]))
            last = np.append(first[1:], len(name)) - 1
            count = (last - first + 1).astype(np.uint64)
            new = np.where(count > 1, common.mix(name[first] * np.uint64(3) + count + np.uint64(0x5BD1E995)), name[first])
            free = ~wall[first]  # a run's extent, and a lone symbol's, rests on both neighbours
            name, start, low, high, wall = joined(first, last, new, free, free)

        half = (common.mix(name + np.uint64(0x1000 + r)) >> np.uint64(63)).astype(bool)  # True: left half
        pair = half[:-1] & ~half[1:] & ~wall[1:] & ~wall[:-1]
        second = np.concatenate([[False], pair])
        first = np.flatnonzero(~second)
        merged = np.append(pair, False)[first]
        last = first + merged
        new = np.where(merged, common.mix(name[first] ^ (common.mix(name[last]) * np.uint64(5))), name[first])
        free = ~wall[first] & ~merged
        left_dep, right_dep = free & ~half[first], free & half[first]
        name, start, low, high, wall = joined(first, last, new, left_dep, right_dep)
        found.append((name, start, low, high, wall))
    return found


def _least(value, first, end):
    """Index of the least value in each [first, end), the leftmost of equals."""
    import numpy as np

    count = end - first
    depth = np.frexp(count.astype(np.float64))[1] - 1  # floor of log2
    out = np.empty(len(first), dtype=np.int64)
    table = np.arange(len(value))
    for k in range(int(depth.max(initial=0)) + 1):
        at = np.flatnonzero(depth == k)
        a, b = table[first[at]], table[end[at] - (1 << k)]
        out[at] = np.where(value[a] <= value[b], a, b)
        step = 1 << k
        if step >= len(table):
            break
        a, b = table[:-step], table[step:]
        table = np.where(value[a] <= value[b], a, b)
    return out


def anchors(w, barrier, valid, size: int, rounds: int = 5):
    """For each window start s in valid: (name, place) of its anchor."""
    import numpy as np

    n = len(w)
    name_of, place_of = np.zeros(n, dtype=np.uint64), np.full(n, -1, dtype=np.int64)
    todo = valid
    found = levels(w, barrier, rounds)
    for level in range(len(found) - 1, -1, -1):
        name, start, low, high, wall = found[level]
        if level:
            keep = ~wall & (high - low <= size) & (low >= 0)
            # contexts are in order, so those that fit any window still are
            name, start, low, high = name[keep], start[keep], low[keep], high[keep]
        if not len(name):
            continue
        one = np.cumsum(np.bincount(low, minlength=n + 1))[todo - 1]  # first with low >= s
        # those with high <= s + size; the barrier at the end keeps this in range
        end = np.cumsum(np.bincount(high, minlength=n + size + 2))[todo + size]
        good = end > one
        s, i = todo[good], _least(common.mix(name ^ np.uint64(0xA5A5)), one[good], end[good])
        name_of[s] = common.mix(name[i] + np.uint64(level))
        place_of[s] = start[i] * 16 + level
        todo = todo[~good]
        if not len(todo):
            break
    return name_of, place_of


def _batch(texts: list, size: int):
    """Concatenated word hashes of the texts with enough words, barriers around
    each: (w, second hashes, barrier, document index, offset of its first word)."""
    import numpy as np

    h, second, counts = common.hash_words(texts, twice=True)
    owners = np.flatnonzero(counts >= size)
    own = counts[owners]
    at = 1 + np.cumsum(own + 1) - (own + 1)
    w = np.zeros(int((own + 1).sum()) + 1, dtype=np.uint64)
    barrier = np.zeros(len(w), dtype=bool)
    barrier[0] = True
    barrier[at + own] = True
    other = np.zeros_like(w)
    here = np.repeat(counts >= size, counts)
    w[~barrier], other[~barrier] = h[here], second[here]
    return w, other, barrier, owners, at


def _once(keys):
    """(index of the first of each key, its count, indices of the spare ones)."""
    import numpy as np

    order = np.lexsort(keys[::-1])
    new = np.ones(len(order), dtype=bool)
    if len(order):
        new[1:] = False
        for k in keys:
            new[1:] |= k[order][1:] != k[order][:-1]
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(order)))
    return order[first], count, order[~new]


RUNS = "key bigint, words bigint, row bigint, s1 int, s2 int"


def _groups(texts: list, most: int = 400_000):
    """Slices of a batch's texts of at most about that many bytes x 8."""
    start = held = 0
    for i, t in enumerate(texts):
        held += len(t or b"")
        if held > most * 8:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def window_runs(base: DataFrame, size: int) -> DataFrame:
    """Step 1: RUNS, one row for each run of windows."""
    common.small_batches(base.sparkSession)

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            texts, rows = common.text_bytes(batch.column(1)), batch.column(0).to_numpy()
            for a, b in _groups(texts):
                w, second, barrier, owners, at = _batch(texts[a:b], size)
                if not len(owners):
                    continue
                ends = np.append(at[1:], len(w)) - 1  # the barrier after each
                counts = ends - at - size + 1
                s = np.repeat(at - np.append(0, np.cumsum(counts)[:-1]), counts) + np.arange(counts.sum())
                doc = np.repeat(np.arange(len(owners)), counts)
                name_of, place_of = anchors(w, barrier, s, size)
                place = place_of[s]
                new = np.concatenate([[True], (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])])
                first = np.flatnonzero(new)
                last = np.append(first[1:], len(s)) - 1
                s1, s2, own = s[first], s[last], doc[first]
                span = common.Stretches(second).of(0, s1, s2 + size) + (s2 - s1).astype(np.uint64)
                arrays = [name_of[s1].view(np.int64), span.view(np.int64), rows[a:b][owners[own]], (s1 - at[own]).astype(np.int32), (s2 - at[own]).astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], names=["key", "words", "row", "s1", "s2"])

    return base.select("_row", "text").mapInArrow(run, RUNS)


def judged_runs(runs: DataFrame) -> DataFrame:
    """Step 2: (row, s1, s2, whole) of the runs whose name is shared; whole: all
    runs of that name span the same words."""
    names = runs.groupBy("key").agg(F.count("*").alias("n"), F.min("words").alias("least"), F.max("words").alias("most")).where("n > 1")
    names = common.stage_table(names.select("key", (F.col("least") == F.col("most")).alias("whole")), "names")
    return runs.join(names.hint("merge"), "key").select("row", "s1", "s2", "whole")


def _squeezed(base: DataFrame) -> DataFrame:
    """(row, doc_id, zstd text): less to shuffle."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import zstandard

        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            data = [press.compress(t or b"") for t in common.text_bytes(batch.column(2))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(data, pa.binary())], names=["row", "doc_id", "packed"])

    return base.select("_row", "doc_id", "text").mapInArrow(run, "row bigint, doc_id bigint, packed binary")


def window_hashes(base: DataFrame, runs: DataFrame, size: int, hold: int = 1 << 20) -> DataFrame:
    """Step 3: (w1, w2, row, s) of the windows of runs; s is its complement where
    the window is one of several in its task. A task looks at about hold windows
    together."""
    wanted = runs.groupBy("row").agg(F.collect_list(F.struct("s1", "s2")).alias("runs"))
    texts = _squeezed(base).join(wanted.hint("merge"), "row").select("row", "packed", F.col("runs.s1").alias("s1"), F.col("runs.s2").alias("s2"))

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import zstandard

        def told(out):
            w1, w2, row, s = (np.concatenate(x) for x in out)
            one, count, spare = _once([w1, w2])
            s[one[count > 1]] = ~s[one[count > 1]]
            s[spare] = ~s[spare]
            # spare ones need no company: keys that differ from row to row
            w1[spare] = common.mix(row[spare].astype(np.uint64) * np.uint64(common.Stretches.BASES[0]) + w1[spare] + s[spare].astype(np.uint64))
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (w1.view(np.int64), w2.view(np.int64), row, s.astype(np.int32))], names=["w1", "w2", "row", "s"])

        press = zstandard.ZstdDecompressor()
        out: list[list] = [[], [], [], []]
        held = 0
        for batch in batches:
            for row, packed, s1, s2 in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                s1, s2 = np.array(s1, dtype=np.int64), np.array(s2, dtype=np.int64)
                n = s2 - s1 + 1
                s = np.repeat(s1 - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())
                stretch = common.Stretches(*common.hash_words([press.decompress(packed)], twice=True)[:2])
                for k, x in enumerate((stretch.of(0, s, s + size), stretch.of(1, s, s + size), np.full(len(s), row), s)):
                    out[k].append(x)
                held += len(s)
                if held > hold:
                    yield told(out)
                    out, held = [[], [], [], []], 0
        if held:
            yield told(out)

    return texts.mapInArrow(run, "w1 bigint, w2 bigint, row bigint, s int")


RESULT = "doc_id bigint, n_words bigint, n_removed bigint, kept string"


def dedup(docs: DataFrame, size: int = 35) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_removed, kept (the kept words, joined
    by one space)."""
    base = common.numbered(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")))
    found = common.stage_table(window_runs(base, size), "runs")
    shared = common.stage_table(judged_runs(found), "shared")
    common.drop_table(found)
    hashes = window_hashes(base, shared.where("not whole"), size)
    # a window has a row a task at most
    twice = hashes.withColumn("n", F.count("*").over(Window.partitionBy("w1", "w2"))).where("s < 0 or n > 1")
    place = F.when(F.col("s") < 0, F.bitwise_not("s")).otherwise(F.col("s"))
    twice = twice.select("row", place.alias("s1"), place.alias("s2"))
    gone = common.stage_table(shared.where("whole").select("row", "s1", "s2").unionByName(twice), "gone")
    common.drop_table(shared)
    spans = gone.groupBy("row").agg(F.collect_list(F.struct("s1", "s2")).alias("gone"))
    texts = _squeezed(base).join(spans.hint("merge"), "row", "left")
    texts = texts.select("doc_id", "packed", F.col("gone.s1").alias("s1"), F.col("gone.s2").alias("s2"))

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import zstandard

        press = zstandard.ZstdDecompressor()
        for batch in batches:
            n_words, n_removed, kept = [], [], []
            for packed, s1, s2 in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                found = press.decompress(packed).split()
                steps = np.zeros(len(found) + 1, dtype=np.int64)
                if s1:
                    np.add.at(steps, s1, 1)
                    np.add.at(steps, np.array(s2) + size, -1)
                stays = np.cumsum(steps[:-1]) == 0
                n_words.append(len(found))
                n_removed.append(int(len(found) - stays.sum()))
                kept.append(b" ".join(found if stays.all() else [x for x, keep in zip(found, stays, strict=True) if keep]))
            arrays = [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_words", "n_removed", "kept"])

    return texts.mapInArrow(run, RESULT)
