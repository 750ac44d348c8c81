"""N-gram Jaccard join by MinHash banding.

Documents with the same set of n-grams (n = 5 words) form one node. Band and row
counts are chosen for a target recall at the threshold. Nodes shuffle on band
hashes; every node of a bucket links to the bucket's least node, which keeps
candidates linear in the bucket's size. The components of these links are what
is compared. Sets whose sizes differ by more than the threshold can't link, so a
component is first cut into size classes, each as wide as the threshold, and a
class into chunks of about ``chunk_rows`` nodes or ``chunk_grams`` n-grams. Each
pair of chunks of one class or of neighbouring classes is one group, and within a
group all full n-gram sets are intersected at once. A group returns, for each node,
the number of its links and the root of its own spanning forest, never the pairs. A
bucket or component of any size is thus compared whole, in groups of bounded size,
and no link between different texts is lost once a band has found its component.

Words are runs of other than ASCII white space, with A-Z lower-cased. A document
of 1 to n - 1 words has one n-gram: all its words. N-grams are compared by
64-bit hashes, n-gram sets as a whole by 128 bits.

Rows: a text without words, or null, links to nothing and is its own class. Rows
that repeat or share an id are different documents and count as copies. An empty
table gives no rows. A null id stays null; its class may be null where it has no
other. A very long text is hashed in blocks of its n-grams; its set is held whole by
the one worker that compares it. Only ``doc_id``, ``text`` and the row number that
the caller names are read, so other columns may have any name.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import connected_components


def choose_bands(threshold: float, recall: float = 0.999, max_hashes: int = 320) -> tuple[int, int]:
    """(bands, rows): the most selective split whose recall at the threshold is
    at least the target within max_hashes."""
    best = None
    for rows in range(1, 33):
        hit = threshold**rows
        bands = 1 if hit >= 1 else max(1, math.ceil(math.log(1 - recall) / math.log(1 - hit)))
        if bands * rows <= max_hashes:
            best = (bands, rows)
    return best or (max_hashes, 1)


def ngram_set(word_hashes, n: int):
    """Sorted distinct 64-bit hashes of the n-grams of a word sequence."""
    import numpy as np

    k = len(word_hashes)
    if not k:
        return word_hashes
    size = min(n, k)
    acc = np.zeros(k - size + 1, dtype=np.uint64)
    for i in range(size):
        acc = common.mix(acc ^ word_hashes[i : k - size + 1 + i]) + np.uint64(i + 1)
    return np.unique(acc)


def _word_hashes(texts: list) -> list:
    import numpy as np

    h, counts = common.hash_words(texts, lower=True)
    return np.split(h, np.cumsum(counts)[:-1]) if len(counts) else []


def signatures(docs: DataFrame, n: int, bands: int, rows: int, seed: int = 7) -> DataFrame:
    """Per numbered row: its n-gram set's 128-bit hash, size and band hashes."""
    common.small_batches(docs.sparkSession)

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import xxhash

        rng = np.random.default_rng(seed)
        mult = rng.integers(1, 2**63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        add = rng.integers(0, 2**63, bands * rows, dtype=np.uint64)
        fold = rng.integers(1, 2**63, rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        for batch in batches:
            whole, size, sig = [], [], []
            for words in _word_hashes(common.text_bytes(batch.column(2))):
                grams = ngram_set(words, n)
                size.append(len(grams))
                if not len(grams):
                    whole.append(None)
                    sig.append(None)
                    continue
                whole.append(xxhash.xxh3_128_digest(grams.tobytes()))
                low = np.full(bands * rows, np.iinfo(np.uint64).max, dtype=np.uint64)
                for k in range(0, len(grams), 256):
                    part = grams[k : k + 256, None] * mult + add
                    # high bits of a product are the well-mixed ones
                    part ^= part >> np.uint64(32)
                    np.minimum(low, part.min(axis=0), out=low)
                joined = common.mix((low.reshape(bands, rows) * fold).sum(axis=1, dtype=np.uint64) + np.arange(bands, dtype=np.uint64))
                sig.append(joined.view(np.int64))
            arrays = [batch.column(0), batch.column(1), pa.array(whole, pa.binary()), pa.array(size, pa.int64()), pa.array(sig, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["row", "doc_id", "whole", "n_grams", "bands"])

    return docs.select("_row", "doc_id", "text").mapInArrow(run, "row bigint, doc_id bigint, whole binary, n_grams bigint, bands array<bigint>")


def _sets(texts: DataFrame, n: int) -> DataFrame:
    """The n-gram set of (.., text) as bytes instead of the text."""
    kept = [c for c in texts.columns if c != "text"]
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in texts.schema if f.name != "text")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            at = batch.schema.get_field_index("text")
            grams = [ngram_set(w, n).tobytes() for w in _word_hashes(common.text_bytes(batch.column(at)))]
            arrays = [batch.column(batch.schema.get_field_index(c)) for c in kept] + [pa.array(grams, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*kept, "grams"])

    return texts.mapInArrow(run, f"{kinds}, grams binary")


def shared_counts(sets: list, columns: int = 8192):
    """Sizes of all pairwise intersections of sorted hash arrays."""
    import numpy as np

    m = len(sets)
    out = np.zeros((m, m), dtype=np.float64)
    flat, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    place = np.full(len(flat), -1)
    place[counts > 1] = np.arange((counts > 1).sum())
    col = place[inverse]
    keep = col >= 0
    col, owner = col[keep], owner[keep]
    order = np.argsort(col, kind="stable")
    col, owner = col[order], owner[order]
    for start in range(0, int(col[-1]) + 1 if len(col) else 0, columns):
        a, b = np.searchsorted(col, [start, start + columns])
        x = np.zeros((m, columns), dtype=np.float32)
        x[owner[a:b], col[a:b] - start] = 1
        out += x @ x.T
    return out


def _verify(threshold: float):
    def run(table):
        import numpy as np
        import pyarrow as pa

        between = table.column("ci")[0].as_py() != table.column("cj")[0].as_py()
        node, chunk, copies = (table.column(c).to_numpy() for c in ("node", "chunk", "copies"))
        order = np.argsort(node)
        node, chunk, copies = node[order], chunk[order], copies[order]
        raw = table.column("grams").to_pylist()
        sets = [np.frombuffer(raw[i], dtype=np.uint64) for i in order]
        size = np.array([len(s) for s in sets], dtype=np.float64)
        both = shared_counts(sets)
        linked = both >= threshold * (size[:, None] + size[None, :] - both) - 1e-9
        np.fill_diagonal(linked, False)
        if between:
            linked &= chunk[:, None] != chunk[None, :]
        links = linked @ copies
        root = np.arange(len(node))
        while True:  # least neighbour, then pointers, until nothing moves
            least = np.where(linked, root[None, :], len(node)).min(axis=1)
            new = np.minimum(root, least)
            new = np.minimum(new, new[new])
            if (new == root).all():
                break
            root = new
        has = links > 0
        return pa.table({"node": node[has], "links": links[has].astype(np.int64), "root": node[root[has]]})

    return run


def near_duplicates(
    docs: DataFrame, threshold: float = 0.8, n: int = 5, recall: float = 0.999, chunk_rows: int = 128, chunk_grams: int = 1 << 18, row: str | None = None,
) -> DataFrame:
    """One row per row of docs: row (its number: the column named so, if docs comes
    from ``common.numbered``),
    doc_id, class_id (least doc_id of its class), is_first (one row of each
    class: the one of least doc_id, then row), n_links (documents at the threshold
    or above), n_copies (documents with the same n-gram set), n_grams."""
    bands, rows = choose_bands(threshold, recall)
    if row is None:
        docs, row = common.numbered(docs.select("doc_id", "text")), "_row"
    docs = docs.select(F.col(row).alias("_row"), "doc_id", "text")
    base = docs.select("_row", F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sig = common.stage_table(signatures(base, n, bands, rows), "signatures")
    nodes = sig.where("whole is not null").groupBy("whole").agg(F.min("row").alias("node"), F.count("*").alias("copies"), F.first("n_grams").alias("grams"))
    nodes = common.stage_table(nodes, "nodes")
    firsts = sig.select(F.col("row").alias("node"), "bands").join(nodes.select("node"), "node")
    keys = firsts.select("node", F.explode("bands").alias("key"))
    # grouped results are written before they are joined back: both sides of the
    # join are then shuffled for it, and Spark may split a hot bucket or class
    buckets = keys.groupBy("key").agg(F.min("node").alias("hub"), F.count("*").alias("n")).where("n > 1")
    buckets = common.stage_table(buckets, "buckets")
    candidates = keys.join(buckets, "key").select(F.col("node").alias("a"), F.col("hub").alias("b"))
    groups = common.stage_table(connected_components(candidates), "groups")

    # sizes within the threshold of each other are of one class or of neighbouring ones
    step = F.floor(F.log(F.col("grams").cast("double")) / -math.log(threshold) + 1e-9).cast("int") if threshold < 1 else F.lit(0)
    members = groups.join(nodes.select("node", "copies", "grams"), "node").withColumn("step", step)
    wanted = F.greatest(F.ceil(F.count("*") / chunk_rows), F.least(F.count("*"), F.ceil(F.sum("grams") / chunk_grams)))
    sizes = common.stage_table(members.groupBy("root", "step").agg(wanted.cast("int").alias("chunks")), "sizes")
    for name, move in (("below", 1), ("above", -1)):
        beside = sizes.select("root", (F.col("step") + move).alias("step"), F.col("chunks").alias(name))
        sizes = beside.join(sizes, ["root", "step"], "right") if name == "below" else sizes.join(beside, ["root", "step"], "left")
    sizes = common.stage_table(sizes, "sizes")
    members = members.join(sizes, ["root", "step"])
    part = lambda k, c: F.col("step").cast("bigint") * F.lit(1 << 32) + k * F.lit(1 << 32) + c

    def parts(count: str, move: int):
        each = F.transform(F.sequence(F.lit(1), F.col(count)), lambda i: part(F.lit(move), i))
        return F.when(F.col(count) > 0, each).otherwise(F.array().cast("array<bigint>"))

    others = F.concat(parts("below", -1), parts("chunks", 0), parts("above", 1))
    members = members.withColumn("chunk", part(F.lit(0), F.pmod(F.xxhash64("node"), F.col("chunks")) + 1))
    texts = base.select(F.col("_row").alias("node"), "text").join(members.select("node", "root", "copies", "chunk", others.alias("others")).hint("merge"), "node")
    blocks = _sets(texts.select("root", "node", "copies", "chunk", "others", "text"), n)
    blocks = blocks.withColumn("other", F.explode("others"))
    blocks = blocks.withColumns({"ci": F.least("chunk", "other"), "cj": F.greatest("chunk", "other")})
    blocks = blocks.select("root", "ci", "cj", "node", "copies", "chunk", "grams")
    verified = blocks.groupBy("root", "ci", "cj").applyInArrow(_verify(threshold), "node bigint, links bigint, root bigint")
    verified = common.stage_table(verified, "links")

    links = verified.groupBy("node").agg(F.sum("links").alias("links"))
    classes = connected_components(verified.select(F.col("node").alias("a"), F.col("root").alias("b")))
    found = nodes.join(links, "node", "left").join(classes, "node", "left")
    found = found.select("whole", "node", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "node").alias("class"))
    placed = sig.select("row", "doc_id", "whole", "n_grams").join(found, "whole", "left").withColumn("class", F.coalesce("class", "row"))
    placed = common.stage_table(placed, "placed")
    first = placed.groupBy("class").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first"))
    first = common.stage_table(first, "first")
    return placed.join(first, "class").select(
        "row",
        "doc_id",
        F.col("first.doc_id").alias("class_id"),
        (F.col("row") == F.col("first.row")).alias("is_first"),
        F.coalesce(F.col("links") + F.col("copies") - 1, F.lit(0)).cast("bigint").alias("n_links"),
        F.coalesce("copies", F.lit(1)).cast("bigint").alias("n_copies"),
        "n_grams",
    )
