"""Language ID by a bidirectional gated recurrent network over UTF-8 bytes.

The network labels every byte: two recurrent layers, one from the left and one
from the right, over stretches of ``stretch`` bytes (a text is cut into as many as
it has, none is left out), and a softmax of both states. A document's
probabilities are the means over all its bytes.

Training is backpropagation through time in numpy on the driver, on a bounded
sample of labelled rows: every language has the same number at most, which is
``sample_rows`` or as many as ``sample_total`` leaves each, drawn by a hash of id
and text (rows alike in both count once), of each row ``sample_bytes`` bytes from a
place drawn by that hash. No language is left out. Prediction covers every byte of
every text.

Rows: a text that is null or without a letter (a character of Unicode's letter
categories) gives ``und`` with score 0. If no row can be learned from, every text
does. Rows that repeat or share an id are predicted each by itself; a null id
counts as empty text for the split. An empty table gives no rows. A long text is as
many stretches, run side by side with others'. Only ``doc_id``, ``text``, ``lang``
and the columns ``keep`` are read; lang only of rows that train.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common, gru

SIZE = 8


def has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


def training_sample(docs: DataFrame, trains: Column, sample_rows: int, sample_bytes: int, sample_total: int) -> list[tuple[bytes, str]]:
    """(bytes, language) of at most so many rows of each language."""
    rows = docs.where(trains & F.col("text").isNotNull() & F.col("lang").isNotNull() & (F.length("text") > 0)).select("doc_id", "text", "lang")
    sizes = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return []
    most = max(1, min(sample_rows, sample_total // len(sizes)))
    drawn = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30))
    # of what is drawn of a language, about twice as much as is kept, the least
    share = F.element_at(F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, (2 * most + 64) / n))]), F.col("lang"))
    at = F.pmod(F.xxhash64("text"), F.greatest(F.lit(1), F.length("text") - sample_bytes)).cast("int") + 1
    part = F.substring("text", at, F.lit(sample_bytes)).alias("part")
    found = rows.where(drawn < share * (1 << 30)).select(drawn.alias("drawn"), part, "lang").distinct()
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("drawn", "part"))
    found = sorted(found.withColumn("nth", nth).where(F.col("nth") <= most).collect(), key=lambda r: (r.drawn, r.lang, r.part))
    return [(r.part.encode()[:sample_bytes], r.lang) for r in found]


def _stretches(texts: list[bytes], stretch: int):
    """Byte stretches as columns: (codes T x B, lengths B, text index B)."""
    import numpy as np

    flat = np.frombuffer(b"".join(texts), dtype=np.uint8)
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    count = -(-sizes // stretch)
    owner = np.repeat(np.arange(len(texts)), count)
    nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    start = np.repeat(np.cumsum(sizes) - sizes, count) + nth * stretch
    length = np.minimum(stretch, np.repeat(sizes, count) - nth * stretch)
    return flat, start, length, owner


def _codes(flat, start, length, back: bool):
    """T x B byte codes of stretches, from the left or from the right; 256 pads."""
    import numpy as np

    steps = int(length.max())
    t = np.arange(steps)[:, None]
    at = start[None, :] + (length[None, :] - 1 - t if back else t)
    inside = t < length[None, :]
    return np.where(inside, flat[np.clip(at, 0, len(flat) - 1)].astype(np.intp), 256), inside


def new_model(languages: int, seed: int = 5) -> dict:
    import numpy as np

    rng = np.random.default_rng(seed)
    p = {}
    for d in ("l", "r"):
        p[f"x{d}"] = rng.normal(0, 0.3, (257, 2 * SIZE)).astype(np.float32)
        p[f"x{d}"][:, :SIZE] -= 1.5  # gates start mostly shut, so states remember
        p[f"u{d}"] = rng.normal(0, 0.3, (SIZE, 2 * SIZE)).astype(np.float32)
        p[f"o{d}"] = rng.normal(0, 0.3, (SIZE, languages)).astype(np.float32)
    p["b"] = np.zeros(languages, dtype=np.float32)
    return p


def train(sample: list[tuple[bytes, str]], stretch: int = 128, epochs: int = 8, lanes: int = 256, least_steps: int = 240) -> tuple[list[str], dict]:
    """(languages, parameters) by Adam on the mean cross entropy of all bytes, in
    epochs passes over the sample, or as many as make least_steps steps."""
    import numpy as np

    languages = sorted({lang for _, lang in sample})
    p = new_model(len(languages))
    if not languages:
        return languages, p
    flat, start, length, owner = _stretches([t for t, _ in sample], stretch)
    target = np.array([languages.index(lang) for _, lang in sample])[owner]
    opt, rng = gru.Adam(p, 0.02), np.random.default_rng(3)
    batches = -(-len(start) // lanes)
    epochs = max(epochs, -(-least_steps // max(1, batches)))
    for epoch in range(epochs):
        order = rng.permutation(len(start))
        for k in range(batches):
            pick = order[k * lanes : (k + 1) * lanes]
            if not len(pick):
                continue
            states, saved, codes = {}, {}, {}
            for d in "lr":
                codes[d], inside = _codes(flat, start[pick], length[pick], d == "r")
                states[d], _, saved[d] = gru.forward(p[f"x{d}"][codes[d]], p[f"u{d}"], np.zeros((len(pick), SIZE), dtype=np.float32), store=True)
            right = _turned(states["r"], length[pick])
            prob = gru.softmax(states["l"] @ p["ol"] + right @ p["or"] + p["b"])
            prob[:, np.arange(len(pick)), target[pick]] -= 1
            prob *= (inside / inside.sum())[:, :, None]
            prob = prob.astype(np.float32)
            grads = {"b": prob.sum(axis=(0, 1)), "ol": _outer(states["l"], prob), "or": _outer(right, prob)}
            for d, grad in (("l", prob @ p["ol"].T), ("r", _turned(prob @ p["or"].T, length[pick]))):
                dx, grads[f"u{d}"] = gru.backward(grad, p[f"u{d}"], saved[d])
                grads[f"x{d}"] = gru.scatter_rows(codes[d].ravel(), dx.reshape(-1, 2 * SIZE), 257)
                grads[f"x{d}"][256] = 0
            opt.step(grads, 0.02 * (1 - epoch / epochs) + 0.001)
    return languages, p


def _outer(states, grad):
    return states.reshape(-1, states.shape[2]).T @ grad.reshape(-1, grad.shape[2])


def _turned(states, length):
    """T x B x H with each lane's first length steps reversed."""
    import numpy as np

    t = np.arange(states.shape[0])[:, None]
    at = np.where(t < length[None, :], length[None, :] - 1 - t, t)
    return np.take_along_axis(states, at[:, :, None], axis=0)


def byte_probabilities(p: dict, texts: list[bytes], stretch: int, cells: int = 1 << 18):
    """Sums over all bytes of each text's language probabilities; cells is how many
    bytes are run at once."""
    import numpy as np

    total = np.zeros((len(texts), len(p["b"])))
    if not sum(map(len, texts)):
        return total
    flat, start, length, owner = _stretches(texts, stretch)
    order = np.argsort(-length, kind="stable")
    lanes = max(1, cells // stretch)
    inputs = [gru.columns_input(p[f"x{d}"], 256) for d in "lr"]
    for k in range(0, len(order), lanes):
        pick = order[k : k + lanes]
        codes, inside = _codes(flat, start[pick], length[pick], False)
        left, right = gru.both_ways(inputs, [p["ul"], p["ur"]], codes)
        score = np.matmul(p["ol"].T, left)
        score += np.matmul(p["or"].T, right)
        score += p["b"][:, None]
        score -= score.max(axis=1, keepdims=True)
        np.exp(score, out=score)
        score *= (inside / score.sum(axis=1))[:, None, :].astype(np.float32)
        np.add.at(total, owner[pick], score.sum(axis=0, dtype=np.float64).T)
    return total


def predict(docs: DataFrame, languages: list[str], params: dict, stretch: int = 512) -> DataFrame:
    """docs with ``lang_pred`` and ``score``, by their column text."""
    spark = docs.sparkSession
    common.small_batches(spark)
    shared = spark.sparkContext.broadcast((languages, params))
    at = docs.columns.index("text")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        names, p = shared.value
        for batch in batches:
            texts = batch.column(at).to_pylist()
            pred: list = ["und"] * len(texts)
            score = [0.0] * len(texts)
            wanted = [i for i, t in enumerate(texts) if names and has_letter(t)]
            seen: dict[str, int] = {}
            for i in wanted:
                seen.setdefault(texts[i], len(seen))
            data = [t.encode() for t in seen]
            held = 0
            groups: list[list[int]] = [[]]
            for i, d in enumerate(data):
                if held > 2_000_000:
                    groups.append([])
                    held = 0
                groups[-1].append(i)
                held += len(d)
            mean = np.zeros((len(data), len(names)))
            for g in groups:
                part = byte_probabilities(p, [data[i] for i in g], stretch)
                mean[g] = part / np.maximum(part.sum(axis=1, keepdims=True), 1e-12)
            for i in wanted:
                m = mean[seen[texts[i]]]
                pred[i], score[i] = names[int(m.argmax())], float(min(1.0, m.max()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pred), pa.array(score)], names=[*batch.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(run, f"{kinds}, lang_pred string, score double")


def identify(
    docs: DataFrame, folds: int = 5, held_fold: int = 0, sample_rows: int = 500, sample_bytes: int = 1024, sample_total: int = 32_000, keep: tuple[str, ...] = (),
) -> DataFrame:
    """Per row of docs: doc_id, held_out, lang_pred, score, chance (one in as many
    languages as were learned), and the columns keep."""
    split = common.id_split("doc_id", folds)
    sample = training_sample(docs.select("doc_id", "text", "lang"), split != held_fold, sample_rows, sample_bytes, sample_total)
    languages, params = train(sample)
    chance = 1 / max(1, len(languages))
    columns = list(dict.fromkeys(["doc_id", "text", *keep]))
    found = predict(docs.select(*columns), languages, params)
    return found.withColumns({"held_out": split == held_fold, "chance": F.lit(chance)})


def margin(share: float) -> Column:
    """The score that lies this share of the way from an even chance to certainty."""
    return F.col("chance") + share * (1 - F.col("chance"))
