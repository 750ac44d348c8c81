"""Language-model scores of whole documents.

The model is a gated recurrent network over words with a class-factored output:
P(word | state) = P(class | state) P(word | class, state). Its vocabulary is the
``vocabulary`` most frequent words of all training documents, the end mark, and
one entry for all other words; a word of the rest has the probability of that
entry times its add-one share of the rest's counts, so every text's probability
is proper.

1. Counts of every token of all training documents (Spark, hashed words; equal
   words of a task are summed before the shuffle).
2. Training: truncated backpropagation through time in numpy over every window of
   every training document, once, with the state carried from window to window.
   Each document belongs to one round. In a round every task goes on from the
   common parameters over its documents of the round, and the tasks' parameters
   are averaged, weighted by tokens, in a tree. Output biases start at the corpus'
   class and word frequencies.
   Documents of several batches lie side by side, so that a long one seldom runs
   alone; how many tokens a task holds for that bounds memory, not what is read.
3. Scoring: the state is carried across windows from a document's first token to
   its end; every document is scored whole.

Counts of words: the ``hot_words`` most frequent (a bounded table of hash and
count) go to the tasks; all other words meet their counts in a join, each at most
as frequent as the table's last, so no key is hot.

Tokens: runs of other than ASCII white space with A-Z lower-cased, then an end.
Words are known by 64-bit hashes.

Rows: a null text is empty: one token, the end. A null id counts as empty text
for the split. Rows that repeat or share an id are scored, and learned from, each
by itself. An empty table gives no rows; without training rows all words are new.
Only ``doc_id`` and ``text`` are read, so other columns may have any name.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, gru

#: Keys that stand for the end mark and for the rest of the vocabulary.
END, REST = -1, -2

#: A task passes over documents of about this many tokens side by side, so that
#: long ones have company to their end.
GROUP = 1 << 22


def _tokens(texts: list):
    """(token hashes as int64 of all texts, the end mark after each text's words;
    tokens of each text)."""
    import numpy as np

    h, counts = common.hash_words(texts, lower=True)
    h = h.view(np.int64)
    sizes = counts + 1
    flat = np.empty(int(sizes.sum()), dtype=np.int64)
    ends = np.cumsum(sizes) - 1
    words = np.ones(len(flat), dtype=bool)
    words[ends] = False
    flat[words] = np.where((h == END) | (h == REST), np.int64(0), h)
    flat[ends] = END
    return flat, sizes


def summed(parts: list):
    """(hashes, sums of their counts) over parts of (hashes, counts)."""
    import numpy as np

    h, c = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(h)
    h = h[order]
    first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
    return h[first], np.add.reduceat(c[order], first)


def count_words(docs: DataFrame, bound: int = 400_000) -> DataFrame:
    """(h, c) over the documents with ``train``; a task holds bound words or so
    before it passes them on."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        def rows(h, c):
            return pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(c, pa.int64())], names=["h", "c"])

        held: list = []
        for batch in batches:
            texts = [t for t, train in zip(common.text_bytes(batch.column(1)), batch.column(2).to_pylist(), strict=True) if train]
            if not texts:
                continue
            held.append(np.unique(_tokens(texts)[0], return_counts=True))
            if sum(len(h) for h, _ in held) > bound:
                held = [summed(held)]
                if len(held[0][0]) > bound:
                    yield rows(*held.pop())
        if held:
            yield rows(*summed(held))

    partial = docs.select("row", "text", "train").mapInArrow(run, "h bigint, c bigint")
    return partial.groupBy("h").agg(F.sum("c").alias("c"))


class Places:
    """``numpy.searchsorted`` in sorted hashes: a table by the first bits says where
    to begin, a few steps upwards do the rest. Keys that crowd are searched by
    halving."""

    def __init__(self, keys, crowd: int = 64):
        import numpy as np

        bits = min(21, max(4, int(len(keys)).bit_length() + 3))
        self.keys = np.append(keys, np.iinfo(np.int64).max)
        self.shift, self.half = 64 - bits, 1 << (bits - 1)
        held = np.bincount((keys >> self.shift) + self.half, minlength=1 << bits)
        self.first = (np.cumsum(held) - held).astype(np.int32) if held.max() <= crowd else None

    def of(self, h):
        import numpy as np

        if self.first is None:
            return np.searchsorted(self.keys[:-1], h)
        at = self.first[(h >> self.shift) + self.half]
        left = np.flatnonzero(self.keys[at] < h)
        while len(left):
            at[left] += 1
            left = left[self.keys[at[left]] < h[left]]
        return at


class Vocabulary:
    """What tasks need to know of the corpus: hot counts and model entries."""

    def __init__(self, hot_h, hot_c, total: int, distinct: int, size: int, classes: int):
        import numpy as np

        order = np.argsort(hot_h)
        self.hot_h, self.hot_c = hot_h[order], hot_c[order]
        self.total, self.distinct = total, distinct
        by_count = np.lexsort((hot_h, -hot_c))
        by_count = by_count[hot_h[by_count] != END][: size - 2]
        h, c = hot_h[by_count], hot_c[by_count]
        ends = int(hot_c[hot_h == END].sum())
        self.rest_total = total - int(c.sum()) - ends
        self.rest_distinct = distinct - len(h) - (1 if ends else 0)
        h = np.append(h, [END, REST])
        c = np.append(c, [ends, self.rest_total])
        order = np.lexsort((h, -c))
        self.h, self.c = h[order], c[order]
        self.end, self.rest = int(np.flatnonzero(self.h == END)[0]), int(np.flatnonzero(self.h == REST)[0])
        # classes of about equal mass of square-rooted counts; entries in order
        weight = np.sqrt(self.c + 1.0)
        place = np.minimum((np.cumsum(weight) - weight) / weight.sum() * classes, classes - 1).astype(np.int64)
        self.bounds = np.append(np.flatnonzero(np.append(True, place[1:] != place[:-1])), len(self.h))
        self.class_of = np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))
        self.sorted = np.argsort(self.h)
        # counts of entries that the hot table holds too
        self.held = np.where((self.h == REST) | (self.c == 0), -1, self.c)

    def __getstate__(self):
        return {k: x for k, x in self.__dict__.items() if not isinstance(x, Places)}

    def _places(self, name: str, keys) -> Places:
        """Made where it is first used, not sent along."""
        if name not in self.__dict__:
            self.__dict__[name] = Places(keys)
        return self.__dict__[name]

    def entries(self, h):
        """Model entry of each token."""
        import numpy as np

        known = self.h[self.sorted]
        at = np.minimum(self._places("by_entry", known).of(h), len(known) - 1)
        return np.where(known[at] == h, self.sorted[at], self.rest)

    def counts(self, h, entry):
        """Count of each token, whose model entries are given, by the hot table; -1
        if it isn't there."""
        import numpy as np

        out = self.held[entry]
        if not len(self.hot_h):
            return out
        rest = np.flatnonzero(out < 0)
        h = h[rest]
        at = np.minimum(self._places("by_hot", self.hot_h).of(h), len(self.hot_h) - 1)
        out[rest] = np.where(self.hot_h[at] == h, self.hot_c[at], -1)
        return out


def vocabulary(counts: DataFrame, size: int, classes: int, hot_words: int) -> Vocabulary:
    """From the written counts; at most hot_words (and ties below them) and a
    histogram of counts come to the driver."""
    import numpy as np

    total = counts.agg(F.sum("c"), F.count("*")).first()
    # counts by size class, to find how far down the hot table may reach
    floor = F.when(F.col("c") < 64, F.col("c")).otherwise(F.pow(F.lit(2.0), F.floor(F.log2("c") * 8) / 8).cast("bigint"))
    steps = sorted(((r.f, r["count"]) for r in counts.groupBy(floor.alias("f")).count().collect()), reverse=True)
    least, held = None, 0
    for value, n in steps:
        if held + n > hot_words and held >= size:
            break
        least, held = value, held + n
    hot = counts.where((floor >= F.lit(least)) | (F.col("h") == END)) if least is not None else counts.limit(0)
    if held > hot_words:  # one step alone is larger than the table
        hot = counts.orderBy(F.desc("c"), "h").limit(hot_words)
    got = hot.select("h", "c").toArrow()
    h, c = (got.column(k).to_numpy().astype(np.int64) for k in ("h", "c"))
    return Vocabulary(h, c, total[0] or 0, total[1], size, classes)


def new_model(v: Vocabulary, size: int, seed: int = 9) -> dict:
    import numpy as np

    rng = np.random.default_rng(seed)
    n, classes = len(v.h), len(v.bounds) - 1
    mass = np.add.reduceat(v.c + 1.0, v.bounds[:-1])
    p = {
        "x": rng.normal(0, 0.2, (n, 2 * size)),
        "u": rng.normal(0, 0.5 / math.sqrt(size), (size, 2 * size)),
        "wc": np.zeros((size, classes)),
        "bc": np.log(mass / mass.sum()),
        "wo": np.zeros((n, size)),
        "bo": np.log((v.c + 1.0) / mass[v.class_of]),
    }
    return {k: x.astype(np.float32) for k, x in p.items()}


def _exp_sums(a, cut: int, small: bool):
    """exp of the columns of a, each part (rows before cut, rows from it on) less a
    shift, in place; sums of each column's parts, and the parts' shifts together.
    Small values need no shift, and one serves all unless a part vanishes by it."""
    import numpy as np

    parts, shift = (a[:cut], a[cut:]), 0.0
    if not small:
        most = a.max()
        if a.min() < most - 60:
            for x in parts:
                top = x.max(axis=0)
                x -= top
                shift = shift + top
        else:
            a -= most
            shift = 2 * most
    np.exp(a, out=a)
    return *(np.add.reduce(x, axis=0) for x in parts), shift


def _by_class(cls, bounds, block: int):
    """(order of the rows by class; (class, its first row, past its last) of blocks
    of at most block rows in that order)."""
    import numpy as np

    order = np.argsort(cls.astype(np.int16) if len(bounds) < 1 << 15 else cls, kind="stable")
    cuts = np.searchsorted(cls[order], np.arange(len(bounds))).tolist()
    spans = [(c, i, min(i + block, cuts[c + 1])) for c in range(len(bounds) - 1) for i in range(cuts[c], cuts[c + 1], block)]
    return order, spans


def log_probs(p: dict, v: Vocabulary, states, target, grads: bool = False, block: int = 4096):
    """ln P(target | state) of each row; with grads also the gradients of minus
    their mean.

    Rows are taken by the target's class, so that the classes and the class' own
    words are rows of one product, the biases being the weights of a last 1."""
    import numpy as np

    n, size = states.shape
    classes = len(v.bounds) - 1
    cls = v.class_of[target]
    order, spans = _by_class(cls, v.bounds, block)
    s = np.empty((n, size + 1), dtype=np.float32)
    s[:, :size] = np.take(states, order, axis=0)
    s[:, size] = 1
    # the row of each target's word in the product of its class
    own = (target - v.bounds[cls] + classes)[order]
    by_class = np.concatenate([p["wc"].T, p["bc"][:, None]], axis=1)
    by_word = np.concatenate([p["wo"], p["bo"][:, None]], axis=1)
    reach = max(float(np.abs(w).sum(axis=1).max()) for w in (by_class, by_word))
    small = n > 0 and reach * max(1.0, float(s.max()), -float(s.min())) < 60
    picked, sums, rows = np.empty(n, dtype=np.float32), np.empty((2, n), dtype=np.float32), np.arange(block)
    if grads:
        g_class, g_word = np.zeros_like(by_class), np.zeros_like(by_word)
        came = np.empty((n, size), dtype=np.float32)
    for c, i, j in spans:
        lo, hi = v.bounds[c], v.bounds[c + 1]
        weights = np.concatenate([by_class, by_word[lo:hi]])
        a = weights @ s[i:j].T
        at = own[i:j], rows[: j - i]
        np.add(a[c], a[at], out=picked[i:j])
        zc, zw, shift = _exp_sums(a, classes, small)
        sums[0, i:j], sums[1, i:j] = zc, zw
        if not small:
            picked[i:j] -= shift
        if grads:
            # to the targets' probabilities less 1, all divided by n
            a[c] -= zc
            a[at] -= zw
            a[:classes] *= (1 / n) / zc
            a[classes:] *= (1 / n) / zw
            np.matmul(a.T, weights[:, :size], out=came[i:j])
            g = a @ s[i:j]
            g_class += g[:classes]
            g_word[lo:hi] += g[classes:]
    np.log(sums, out=sums)
    out = np.empty_like(picked)
    out[order] = picked - sums[0] - sums[1]
    if not grads:
        return out
    back = np.empty_like(came)
    back[order] = came
    g = {"wc": g_class[:, :size].T, "bc": g_class[:, size], "wo": g_word[:, :size], "bo": g_word[:, size]}
    return out, {k: np.ascontiguousarray(x) for k, x in g.items()}, back


def input_gradient(v: Vocabulary, entry, dz, dc, block: int = 4096):
    """Sums of the rows of dz and dc, side by side, by entry: a product with each
    class' rows of 0 and 1."""
    import numpy as np

    size = dz.shape[1]
    order, spans = _by_class(v.class_of[entry], v.bounds, block)
    at, dz, dc = entry[order] - v.bounds[v.class_of[entry[order]]], np.take(dz, order, axis=0), np.take(dc, order, axis=0)
    rows = np.arange(block)
    out = np.zeros((len(v.h), 2 * size), dtype=np.float32)
    for c, i, j in spans:
        lo, hi = v.bounds[c], v.bounds[c + 1]
        ones = np.zeros((j - i, hi - lo), dtype=np.float32)
        ones[rows[: j - i], at[i:j]] = 1
        out[lo:hi, :size] += ones.T @ dz[i:j]
        out[lo:hi, size:] += ones.T @ dc[i:j]
    return out


def side_by_side(parts: Iterator, tokens: int = GROUP) -> Iterator:
    """Lists of parts of about tokens in all; a part begins with its documents."""
    held, size = [], 0
    for part in parts:
        held.append(part)
        size += sum(map(len, part[0]))
        if size >= tokens:
            yield held
            held, size = [], 0
    if held:
        yield held


def lanes_of(lengths, lanes: int):
    """Documents dealt to lanes, longest first to the lane that is shortest:
    lists of document indices, longest lane first."""
    import heapq

    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    heap = [(0, k) for k in range(min(lanes, len(order)))]
    held: list[list[int]] = [[] for _ in heap]
    total = [0] * len(heap)
    for i in order:
        n, k = heapq.heappop(heap)
        held[k].append(i)
        total[k] = n + lengths[i]
        heapq.heappush(heap, (total[k], k))
    return [held[k] for k in sorted(range(len(held)), key=lambda k: -total[k])]


class Lanes:
    """Documents of model entries in lanes, longest lane first, one after another
    in flat arrays, so a long document costs no padding."""

    def __init__(self, docs: list, lanes: int, end: int):
        import numpy as np

        dealt = lanes_of([len(d) for d in docs], lanes)
        order = [i for lane in dealt for i in lane]
        sizes = np.array([len(docs[i]) for i in order])
        starts = np.cumsum(sizes) - sizes
        self.end = end
        self.lengths = np.array([sum(len(docs[i]) for i in lane) for lane in dealt])
        self.first = np.cumsum(self.lengths) - self.lengths
        self.token = np.concatenate([docs[i] for i in order]).astype(np.int32)
        self.before = np.append(np.int32(end), self.token[:-1])
        self.before[starts] = end
        self.keep = np.ones(len(self.token), dtype=np.float32)
        self.keep[starts] = 0
        self.doc = np.repeat(np.array(order, dtype=np.int32), sizes)

    def live(self, k: int) -> int:
        """How many lanes have a token at time k."""
        return int((self.lengths > k).sum())

    def window(self, k: int, steps: int):
        """Time x lane arrays from time k on: token, token before (the end mark at
        a document's start), keep (0 there), document index (-1 pads)."""
        import numpy as np

        live = self.live(k)
        t = np.arange(k, min(k + steps, int(self.lengths[0])))[:, None]
        real = t < self.lengths[:live]
        at = np.where(real, self.first[:live] + t, 0)
        return np.where(real, self.token[at], self.end), np.where(real, self.before[at], self.end), np.where(real, self.keep[at], np.float32(1)), np.where(real, self.doc[at], -1)


def _inputs(p: dict):
    """The gates' half of the input rows, halved, and the candidates' half, as the
    recurrent layer wants them."""
    import numpy as np

    size = p["x"].shape[1] // 2
    return 0.5 * p["x"][:, :size], np.ascontiguousarray(p["x"][:, size:])


def train_on(p: dict, v: Vocabulary, docs: list, opt, steps: int = 48, lanes: int = 256) -> int:
    """Truncated BPTT over every window of docs, the state carried from each to
    the next. Windows grow longer as lanes end, so that each holds about as many
    tokens. Returns the tokens learned from: all of them."""
    import numpy as np

    held = Lanes(docs, lanes, v.end)
    h = np.zeros((len(held.lengths), p["u"].shape[0]), dtype=np.float32)
    seen, k = 0, 0
    while live := held.live(k):
        token, prev, kept, doc = held.window(k, min(steps * lanes // live, 20 * steps))
        real = doc.ravel() >= 0
        z, c = (np.take(x, prev, axis=0) for x in _inputs(p))
        states, h, saved = gru.forward_halves(z, c, p["u"], h[:live], kept, store=True)
        flat, size, whole = states.reshape(len(real), -1), states.shape[2], real.all()
        _, g, grad = log_probs(p, v, flat if whole else flat[real], token.ravel() if whole else token.ravel()[real], grads=True)
        if not whole:
            back, grad = grad, np.zeros_like(flat)
            grad[real] = back
        dz, dc, g["u"] = gru.backward_halves(grad.reshape(states.shape), p["u"], saved, kept)
        g["x"] = input_gradient(v, prev.ravel(), dz.reshape(-1, size), dc.reshape(-1, size))
        opt.step(g)
        seen += int(real.sum())
        k += len(token)
    return seen


def score_batch(p: dict, v: Vocabulary, docs: list, steps: int = 64, lanes: int = 256):
    """ln probability of each document of model entries."""
    import numpy as np

    total = np.zeros(len(docs))
    held = Lanes(docs, lanes, v.end)
    h = np.zeros((len(held.lengths), p["u"].shape[0]), dtype=np.float32)
    x = _inputs(p)
    k = 0
    while live := held.live(k):
        token, before, keep, doc = held.window(k, min(steps * lanes // live, 20 * steps))
        k += len(token)
        z, c = (np.take(half, before, axis=0) for half in x)
        states, h, _ = gru.forward_halves(z, c, p["u"], h[:live], keep)
        at = doc.ravel()
        real = at >= 0
        got = log_probs(p, v, states.reshape(-1, states.shape[2])[real], token.ravel()[real])
        total += np.bincount(at[real], weights=got.astype(np.float64), minlength=len(docs))
    return total


def _packed(p: dict):
    import numpy as np

    return np.concatenate([p[k].ravel() for k in sorted(p)])


def _unpacked(flat, like: dict) -> dict:
    import numpy as np

    out, pos = {}, 0
    for k in sorted(like):
        n = like[k].size
        out[k] = np.asarray(flat[pos : pos + n], dtype=np.float32).reshape(like[k].shape)
        pos += n
    return out


def train_round(docs: DataFrame, shared, fan_in: int = 32) -> DataFrame:
    """(part, weight, change): each task's change of the parameters times its
    tokens, summed in a tree down to at most fan_in rows a slice."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        v, start = shared.value
        p = {k: x.copy() for k, x in start.items()}
        opt = gru.Adam(p, 0.01)
        seen = 0

        def parts():
            for batch in batches:
                texts = [t for t, train in zip(common.text_bytes(batch.column(1)), batch.column(2).to_pylist(), strict=True) if train]
                if texts:
                    flat, sizes = _tokens(texts)
                    yield (np.split(v.entries(flat).astype(np.int32), np.cumsum(sizes)[:-1]),)

        for group in side_by_side(parts()):
            seen += train_on(p, v, [doc for (docs,) in group for doc in docs], opt)
        if not seen:
            return
        change = ((_packed(p) - _packed(start))).astype(np.float16)
        slices = np.array_split(change, 8)
        task = TaskContext.get().partitionId()
        arrays = [pa.array([task] * 8, pa.int64()), pa.array(range(8), pa.int32()), pa.array([float(seen)] * 8), pa.array([s.tobytes() for s in slices], pa.binary())]
        yield pa.RecordBatch.from_arrays(arrays, names=["task", "part", "weight", "change"])

    def add(table):
        import numpy as np
        import pyarrow as pa

        weight = table.column("weight").to_numpy()
        mean = sum(w * np.frombuffer(x, dtype=np.float16).astype(np.float64) for w, x in zip(weight, table.column("change").to_pylist(), strict=True)) / weight.sum()
        return pa.table({"task": table.column("task")[:1], "part": table.column("part")[:1], "weight": [weight.sum()], "change": pa.array([mean.astype(np.float16).tobytes()], pa.binary())})

    kinds = "task bigint, part int, weight double, change binary"
    rows = common.stage_table(docs.select("row", "text", "train").mapInArrow(run, kinds), "changes")
    tasks = rows.agg(F.count_distinct("task")).first()[0]
    while tasks > 1:
        tasks = -(-tasks // fan_in)
        rows = rows.withColumn("to", F.pmod(F.xxhash64("task"), F.lit(tasks))).groupBy("part", "to").applyInArrow(add, kinds)
        rows = common.stage_table(rows.withColumn("task", F.monotonically_increasing_id()) if tasks > 1 else rows, "changes")
    return rows


def fit(docs: DataFrame, v: Vocabulary, size: int, rounds: int) -> dict:
    """The model after every training document has been learned from in one of
    the rounds, whole."""
    import numpy as np

    p = new_model(v, size)
    for r in range(rounds):
        shared = docs.sparkSession.sparkContext.broadcast((v, p))
        part = docs.where(F.pmod(F.xxhash64("row"), F.lit(rounds)) == r)
        got = sorted(train_round(part, shared).collect(), key=lambda row: row["part"])
        if got:
            change = np.concatenate([np.frombuffer(row["change"], dtype=np.float16) for row in got]).astype(np.float32)
            p = _unpacked(_packed(p) + change, p)
        shared.unpersist()
    return p


def score(
    docs: DataFrame, folds: int = 7, held_fold: int = 2, vocabulary_size: int = 4096, classes: int = 32, size: int = 32,
    hot_words: int = 1 << 20, rounds: int = 2,
) -> DataFrame:
    """Per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score, score."""
    spark = docs.sparkSession
    common.small_batches(spark, 2000)
    base = common.numbered(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")), "row")
    base = base.withColumn("train", common.id_split("doc_id", folds) != held_fold)
    counts = common.stage_table(count_words(base), "counts")
    v = vocabulary(counts, vocabulary_size, classes, hot_words)
    params = fit(base, v, size, rounds)
    shared = spark.sparkContext.broadcast((v, params))

    def scored(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        v, p = shared.value
        names = ["row", "doc_id", "train", "n_tokens", "known", "logs", "n_rest", "rest_logs", "others", "model"]

        def parts():
            for batch in batches:
                if not batch.num_rows:
                    continue
                flat, sizes = _tokens(common.text_bytes(batch.column(2)))
                owner = np.repeat(np.arange(len(sizes)), sizes)
                entry = v.entries(flat)
                c = v.counts(flat, entry)
                here, rest = c >= 0, entry == v.rest
                logs = np.where(here, np.log10(np.maximum(c, 0) + 1.0), 0.0)
                each = lambda w: np.bincount(owner, weights=w, minlength=len(sizes))
                others = np.flatnonzero(~here)
                missing = pa.ListArray.from_arrays(np.append(0, np.cumsum(np.bincount(owner[others], minlength=len(sizes)))).astype(np.int32), pa.array(flat[others]))
                arrays = [batch.column(0), batch.column(1), batch.column(3), pa.array(sizes, pa.int64()), pa.array(each(c > 0).astype(np.int64)), pa.array(each(logs)), pa.array(each(rest).astype(np.int64)), pa.array(each(logs * rest)), missing]
                yield np.split(entry.astype(np.int32), np.cumsum(sizes)[:-1]), arrays

        for group in side_by_side(parts()):
            model = score_batch(p, v, [doc for docs, _ in group for doc in docs]) / math.log(10)
            for docs, arrays in group:
                here, model = np.split(model, [len(docs)])
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(here)], names=names)

    source = base.select("row", "doc_id", "text", "train")
    kinds = "row bigint, doc_id bigint, train boolean, n_tokens bigint, known bigint, logs double, n_rest bigint, rest_logs double, others array<bigint>, model double"
    whole = common.stage_table(source.mapInArrow(scored, kinds), "scores")
    rare = whole.select("row", F.explode("others").alias("h")).join(counts, "h", "left")
    rare = rare.groupBy("row").agg(
        F.count("c").alias("rare_known"),
        F.sum(F.log10(F.coalesce(F.col("c"), F.lit(0)) + 1.0)).alias("rare_logs"),
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    each = whole.drop("others").join(rare, "row", "left")
    base_unit = math.log10(v.total + v.distinct + 1)
    rest_unit = math.log10(v.rest_total + v.rest_distinct + 1)
    return each.select(
        "doc_id",
        (~F.col("train")).alias("held_out"),
        "n_tokens",
        (F.col("known") + zero("rare_known")).cast("bigint").alias("n_known"),
        F.lit(v.total).cast("bigint").alias("train_tokens"),
        (F.col("logs") + zero("rare_logs") - F.col("n_tokens") * base_unit).alias("base_score"),
        (F.col("model") + F.col("rest_logs") + zero("rare_logs") - F.col("n_rest") * rest_unit).alias("score"),
    )
