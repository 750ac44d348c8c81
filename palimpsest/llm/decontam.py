"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are windows of ``size`` consecutive words of a benchmark item; a shorter
item is one pattern. Patterns fall into classes by length (1, 2-3, 4-7, 8 and
more); each class has the tables of Wu and Manber for its shortest length m:

* SHIFT: how far the search may move when the two words that end at the current
  position are a given block, one byte for each value of the block's hash. Blocks
  that share a value have the least of their shifts. A block of no pattern's first
  m words allows m - 1 words at once, so most words of a clean text are never
  looked at.
* HASH: where the shift is 0, the bucket of patterns whose first m words end in a
  block of that hash, ordered by a hash of all their words.
* those of the bucket that have the text's hash are compared directly, word by
  word.

Words are numbers here (64-bit hashes from running sums over the text), tables are
flat arrays, and a worker process builds them once a block, so a block of
``block_bytes`` of benchmark text takes a bounded multiple of its size. A larger
benchmark takes several passes, each adding its hits to a written table.

Rows: a null text has no words; null item texts and items without words take no
part. A null item id is listed as empty text. Items that share an id count once.
Rows that repeat are judged each by itself. An empty table of documents gives no
rows; an empty benchmark hits nothing. A very long text is searched whole, in one
group of its own. Only ``doc_id``, ``text``, ``item_id`` are read, so other columns
may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

_CLASSES = (1, 2, 4, 8)
#: The worker's tables: of one block at a time.
_BUILT: dict = {}


class WuManber:
    """Search tables for patterns (start and length in words of the benchmark),
    all of m words or more."""

    def __init__(self, h, stretch, start, length):
        import numpy as np

        self.m = int(length.min())
        self.span = min(2, self.m)
        self.far = self.m - self.span + 1
        self.lengths = np.unique(length)
        bits = min(24, max(10, int(4 * len(start)).bit_length()))
        self.mask = np.uint64((1 << bits) - 1)
        self.shift = np.full(1 << bits, self.far, dtype=np.uint8)
        blocks = self.blocks(h).astype(np.uint32)
        for end in range(self.span, self.m + 1):  # smaller shifts overwrite
            self.shift[blocks[start + end - 1]] = self.m - end
        bucket = blocks[start + self.m - 1]
        whole = stretch.of(0, start, start + length)
        order = np.lexsort((whole, bucket))
        self.start, self.length, self.bucket, self.whole = start[order], length[order], bucket[order], whole[order]

    def blocks(self, h):
        """Hash of the block that ends at each word."""
        import numpy as np

        out = h & self.mask
        if self.span == 2:
            out[1:] = common.mix(h[:-1] * np.uint64(3) + h[1:]) & self.mask
        return out.astype(np.int64)

    def stops(self, shift: bytes, first: int, past: int) -> Iterator[int]:
        """Ends of first m words that the shift table can't rule out."""
        end = first + self.m - 1
        while end < past:
            move = shift[end]
            if move:
                end += move
            else:
                yield end
                end += 1

    def candidates(self, h, stretch, counts):
        """(start in the text, pattern) of the places whose bucket holds a pattern of
        the text's hash."""
        import numpy as np

        blocks = self.blocks(h) if len(h) else np.zeros(0, dtype=np.int64)
        shift = self.shift[blocks].tobytes()
        past = np.cumsum(counts)
        ends = [(e, p) for f, p in zip((past - counts).tolist(), past.tolist(), strict=True) for e in self.stops(shift, f, p)]
        if not ends:
            return
        end, limit = np.array(ends).T
        lo, hi = (np.searchsorted(self.bucket, blocks[end].astype(np.uint32), side) for side in ("left", "right"))
        full = hi > lo
        end, limit, lo, hi = end[full], limit[full], lo[full], hi[full]
        for n in self.lengths.tolist():
            start = end - self.m + 1
            fits = start + n <= limit
            s, a, b = start[fits], lo[fits], hi[fits]
            whole = stretch.of(0, s, s + n)
            for at, x, y, value in zip(s.tolist(), a.tolist(), b.tolist(), whole, strict=True):
                part = self.whole[x:y]
                k = int(np.searchsorted(part, value))
                while k < len(part) and part[k] == value:
                    if self.length[x + k] == n:
                        yield at, int(self.start[x + k]), n
                    k += 1


class Tables:
    """A block of the benchmark: its words and the search tables of its classes."""

    def __init__(self, items: list[tuple[str, bytes]], size: int):
        import numpy as np

        self.names = [name for name, _ in items]
        found, base = [], 0  # group by group, so that hashing takes little beside the tables
        for _, (data, first, past, h, _, counts) in common.word_groups([t for _, t in items], True, 1 << 20, "sign"):
            found.append((data.tobytes(), (first + base).astype(np.int32), (past + base).astype(np.int32), h, counts))
            base += len(data)
        parts = list(zip(*found, strict=True)) or [(), (), (), (), ()]
        self.data = b"".join(parts[0])
        none = np.zeros(0, dtype=np.int32)
        self.first, self.past = (np.concatenate([none, *x]) for x in parts[1:3])
        h = np.concatenate([np.zeros(0, dtype=np.uint64), *parts[3]])
        counts = np.concatenate([none, *parts[4]])
        del found, parts
        self.classes: list[WuManber] = []
        if not len(h):
            return
        self.item = np.repeat(np.arange(len(items), dtype=np.int32), counts)
        begin = np.cumsum(counts) - counts
        own = np.where(counts > 0, np.maximum(counts - size, 0) + 1, 0)  # patterns of each item
        start = (np.repeat(begin - (np.cumsum(own) - own), own) + np.arange(own.sum())).astype(np.int32)
        length = np.repeat(np.minimum(counts, size), own).astype(np.int32)
        stretch = common.Stretches(h)
        place = np.searchsorted(_CLASSES, length, side="right")
        for k in np.unique(place):
            at = place == k
            self.classes.append(WuManber(h, stretch, start[at], length[at]))

    def search(self, texts: list) -> Iterator[tuple[int, int, list, set]]:
        """(text index, its words, hit spans, items) of each text."""
        import numpy as np

        for base, (data, first, past, h, _, counts) in common.word_groups(texts, True, 1 << 20, "sign"):
            hits: dict[int, tuple[list, set]] = {}
            stretch = common.Stretches(h) if len(h) and self.classes else None
            begin = np.cumsum(counts) - counts
            word = lambda i: data[first[i] : past[i]].tobytes()  # noqa: E731, B023
            for tables in self.classes if stretch is not None else ():
                for at, pattern, n in tables.candidates(h, stretch, counts):
                    if all(word(at + i) == self.data[self.first[pattern + i] : self.past[pattern + i]] for i in range(n)):
                        doc = int(np.searchsorted(begin, at, side="right")) - 1
                        spans, items = hits.setdefault(doc, ([], set()))
                        spans.append((at - int(begin[doc]), at - int(begin[doc]) + n))
                        items.add(self.names[self.item[pattern]])
            for doc, n in enumerate(counts.tolist()):
                yield base + doc, n, *hits.get(doc, ((), ()))


_ADDED = {"n_words": "bigint", "spans": "array<struct<start:int,end:int>>", "items": "array<string>"}


def find_hits(docs: DataFrame, benchmark: DataFrame, size: int = 13, block_bytes: int = 16 << 20, carry: bool = False) -> DataFrame:
    """Per document: doc_id, n_words, merged hit ``spans`` in words, ``items``
    (sorted ids of items with occurring windows); with carry also ``doc``, a
    struct of all the document's columns."""
    common.small_batches(docs.sparkSession)
    kept = {"doc_id": F.col("doc_id").cast("bigint"), "text": F.col("text").cast("string")}
    if carry:
        kept["doc"] = F.struct("*")
    current = docs.select(*[c.alias(k) for k, c in kept.items()])
    current = current.withColumns({k: F.lit(None).cast(t) for k, t in _ADDED.items()})
    parts = _block_plan(benchmark, block_bytes)
    before = None
    for part in parts[:-1]:
        current = common.stage_table(_pass(current, [(r.item, bytes(r.text)) for r in part.collect()], size), "hits")
        if before is not None:
            common.drop_table(before)
        before = current
    return _pass(current, [(r.item, bytes(r.text)) for r in parts[-1].collect()], size).drop("text")


def _block_plan(benchmark: DataFrame, block_bytes: int) -> list[DataFrame]:
    """The benchmark as (item id as text, text bytes) in parts of about
    block_bytes, dealt by hash; a single item may be larger than that."""
    rows = benchmark.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.col("text").cast("string").cast("binary").alias("text")
    ).where("text is not null")
    total = rows.agg(F.sum(F.length("text").cast("bigint"))).first()[0] or 0
    count = max(1, -(-total // block_bytes))
    if count == 1:
        return [rows]
    return [rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(count)) == k) for k in range(count)]


def _built(shared, size: int) -> Tables:
    """The tables of a broadcast block, built once a worker process."""
    key = (shared._jbroadcast.id() if getattr(shared, "_jbroadcast", None) else shared._path, size)
    if _BUILT.get("key") != key:
        _BUILT.clear()
        _BUILT.update(key=key, tables=Tables(shared.value, size))
    return _BUILT["tables"]


def _pass(docs: DataFrame, block: list[tuple], size: int) -> DataFrame:
    """docs with the hits of one block of the benchmark added."""
    shared = docs.sparkSession.sparkContext.broadcast(block)
    names = docs.columns

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        spans_kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        tables = _built(shared, size)
        for batch in batches:
            column = dict(zip(names, batch.columns, strict=True))
            counts, spans, found = [], [], []
            searched = tables.search(common.text_bytes(column["text"]))
            for (_, n, new, who), old, had in zip(searched, column["spans"].to_pylist(), column["items"].to_pylist(), strict=True):
                merged: list[list[int]] = []
                for start, end in sorted([(x["start"], x["end"]) for x in old or ()] + list(new)):
                    if merged and start <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], end)
                    else:
                        merged.append([start, end])
                counts.append(n)
                spans.append([{"start": a, "end": b} for a, b in merged])
                found.append(sorted({*(had or ()), *who}))
            column |= {"n_words": pa.array(counts, pa.int64()), "spans": pa.array(spans, spans_kind), "items": pa.array(found, pa.list_(pa.string()))}
            yield pa.RecordBatch.from_arrays([column[c] for c in names], names=names)

    return docs.mapInArrow(run, docs.schema)


def judge(hits: DataFrame, least_share: int = 20) -> DataFrame:
    """hits with n_hit, n_items and contaminated: at least one word in
    least_share is hit."""
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, s: a + s["end"] - s["start"])
    out = hits.withColumn("n_hit", n_hit).withColumn("n_items", F.size("items").cast("bigint"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (F.lit(least_share) * F.col("n_hit") >= F.col("n_words")))
