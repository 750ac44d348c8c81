"""Secret scans in SQL expressions alone: fixed patterns, and character Markov
models of random strings and of ordinary identifiers.

Places of matches: Spark has no function for them, so a text is split by the
pattern and the matches extracted; running sums of both lengths are the places,
in code points. The sums are taken in blocks, so a text with very many matches
costs little more than its length.

Markov: for each class of labelled samples (1 random, 0 ordinary) a table of
smoothed transition probabilities between the characters of ``ALPHABET``. A
candidate is a run of ``least_length`` characters of it or more, with a letter, that
overlaps no fixed match; it is a secret when the mean log-likelihood ratio of its
transitions is at least ``least_ratio`` and their sum at least ``least_sum``, so
shorter runs must be the more unlike identifiers. The tables have as many cells as
the alphabet squared, whatever the samples.

Samples: a table of label and text. By default the ordinary ones are made of words
of the scanned documents themselves, put together as identifiers are, from a bounded
number of passages drawn by a hash (``sample_rows`` of ``sample_chars`` characters,
repeated ones once), and of a list of words of programs; the random ones are drawn
by a hash over the alphabets that keys use.

Rows: a null text is empty and has no spans. Rows that repeat or share an id are
scanned each by itself. An empty table gives no rows. Ties of place go by kind. A
very long text is scanned whole. Only ``doc_id`` and ``text`` are read, so other
columns may have any name.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed patterns, in the order in which kinds of one place are listed.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ("assign", "access", "hex", "random")
#: What a text must hold for a kind's patterns to be looked for at all.
_GATES = {"assign": r"(?i)(?:password|passwd|secret|token|api_?key)[\x22']?\x20*[:=]", "access": "AKIA", "hex": "[0-9a-f]{24}"}
#: Of these two a match too short can't hide a longer one, so shorter runs need not be matched.
_FOUND = {"assign": ASSIGN, "access": r"AKIA[A-Z0-9]{16,}", "hex": r"[0-9a-f]{24,}"}
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
CANDIDATE = r"[A-Za-z0-9+/_=-]{%d,}"
_BLOCK = 256
_NO_SPANS = "array<struct<start:bigint,end:bigint,value:string>>"


def running_sums(values: Column) -> Column:
    """Exclusive prefix sums of an array of longs, block by block."""
    zero = F.lit(0).cast("bigint")
    size = F.size(values)
    part = lambda b: F.slice(values, b * _BLOCK + 1, F.lit(_BLOCK))
    add = lambda a, x: a + x
    empty = F.array().cast("array<bigint>")

    def grow(acc: Column, x: Column) -> Column:
        return F.struct((acc["total"] + x).alias("total"), F.concat(acc["out"], F.array(acc["total"])).alias("out"))

    def sums(xs: Column, start: Column) -> Column:
        return F.aggregate(xs, F.struct(start.alias("total"), empty.alias("out")), grow, lambda acc: acc["out"])

    blocks = F.sequence(F.lit(0), F.floor((size - 1) / _BLOCK).cast("int"))
    totals = F.transform(blocks, lambda b: F.aggregate(part(b), zero, add))
    starts = sums(totals, zero)
    return F.when(size == 0, empty).otherwise(F.flatten(F.transform(F.arrays_zip(blocks.alias("b"), starts.alias("s")), lambda x: sums(part(x["b"]), x["s"]))))


def _places(df: DataFrame, name: str, pattern: str, gate: Column, group: int = 0, least: int = 0) -> DataFrame:
    """df with column name: the spans of pattern in ``_text`` whose group has at
    least so many characters."""
    none = F.array().cast("array<string>")
    p = F.lit(pattern)
    df = df.withColumns(
        {
            "_between": F.when(gate, F.split("_text", pattern, -1)).otherwise(none),
            "_found": F.when(gate, F.regexp_extract_all("_text", p, F.lit(0))).otherwise(none),
            "_value": F.when(gate, F.regexp_extract_all("_text", p, F.lit(group))).otherwise(none),
        }
    )
    lengths = F.transform("_found", lambda m, i: (F.length(F.get("_between", i)) + F.length(m)).cast("bigint"))
    df = df.withColumn("_lengths", lengths).withColumn("_sums", F.when(F.size("_found") > 0, running_sums(F.col("_lengths"))))
    spans = F.transform(
        "_found",
        lambda m, i: F.struct(
            (F.get("_sums", i) + F.length(F.get("_between", i))).cast("bigint").alias("start"),
            (F.get("_sums", i) + F.get("_lengths", i)).cast("bigint").alias("end"),
            F.get("_value", i).alias("value"),
        ),
    )
    kept = F.filter(spans, lambda s: F.length(s["value"]) >= least)
    return df.withColumn(name, F.when(F.size("_found") > 0, kept).otherwise(F.array().cast(_NO_SPANS))).drop("_between", "_found", "_value", "_lengths", "_sums")


def default_samples(spark: SparkSession, each: int = 600) -> DataFrame:
    """Labelled samples (label, text): keys of several spellings drawn by a hash
    (1), and names, paths, dates and rules of the kind that texts hold (0)."""
    digest = lambda salt: F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")), 256)
    words = (
        "user account name index count value first second table column record update delete create insert select config server client request "
        "response message session manager service handler factory builder reader writer stream buffer channel thread process number string "
        "object array list entry field header footer content language version release default internal public private static final method "
        "function module package import export path file folder document page report order customer region price total amount date time"
    ).split()
    pool = F.array(*[F.lit(w) for w in words])
    word = lambda salt: F.element_at(pool, (F.pmod(F.xxhash64(F.lit(salt), "id"), F.lit(len(words))) + 1).cast("int"))
    number = (F.pmod(F.xxhash64(F.lit("n"), "id"), F.lit(2100))).cast("string")
    b64 = F.base64(F.unhex(digest("b")))
    random = F.array(
        b64,
        F.regexp_replace(b64, "[+/=]", ""),
        F.upper(F.regexp_replace(b64, "[+/=]", "")),
        F.translate(F.base64(F.unhex(digest("u"))), "+/=", "-_"),
        F.lower(F.regexp_replace(F.base64(F.unhex(digest("l"))), "[+/=]", "")),
        F.regexp_replace(F.base64(F.unhex(digest("a"))), "[^A-Za-z]", ""),
    )
    names = [word(str(k)) for k in range(4)]
    ordinary = F.array(
        F.concat_ws("_", *names, number),
        F.concat(names[0], *[F.initcap(x) for x in names[1:]], number),
        F.concat_ws("-", *names[:3], number),
        F.concat_ws("/", *names, number),
        F.concat_ws("_", *[F.upper(x) for x in names]),
        F.concat_ws("-", number, F.lit("01-02"), *names[:2]),
        F.concat(F.repeat(F.lit("-"), 20), number),
        F.concat(F.repeat(F.lit("="), 20), number),
        F.concat(F.repeat(number, 4)),
        F.concat(names[0], F.lit("="), number, F.lit("/"), names[1], F.lit("="), names[2]),
    )
    rows = spark.range(each)
    return rows.select(F.lit(1).alias("label"), F.explode(random).alias("text")).unionByName(rows.select(F.lit(0).alias("label"), F.explode(ordinary).alias("text")))


def corpus_samples(docs: DataFrame, sample_rows: int = 512, sample_chars: int = 2048) -> DataFrame:
    """Ordinary samples (label 0, text): neighbouring words of documents joined as
    identifiers are. About sample_rows passages of sample_chars characters."""
    n = docs.count()
    texts = docs.select(F.col("text").cast("string").alias("text")).where("text is not null")
    drawn = F.pmod(F.xxhash64("text"), F.lit(max(1, n // sample_rows))) == 0
    at = F.pmod(F.xxhash64("text", F.lit(1)), F.greatest(F.lit(1), F.length("text") - sample_chars)).cast("int") + 1
    parts = texts.where(drawn).select(F.substring("text", at, F.lit(sample_chars)).alias("part")).distinct()
    words = parts.select(F.regexp_extract_all("part", F.lit("[A-Za-z]{2,}"), F.lit(0)).alias("w")).where(F.size("w") > 3)
    w = lambda i, k: F.get("w", i + k)

    def joined(i: Column) -> Column:
        shapes = [
            F.concat_ws("_", F.lower(w(i, 0)), F.lower(w(i, 1)), F.lower(w(i, 2)), (i * 37 % 1000).cast("string")),
            F.concat(F.lower(w(i, 0)), F.initcap(w(i, 1)), F.initcap(w(i, 2)), F.initcap(w(i, 3))),
            F.concat_ws("-", w(i, 0), w(i, 1), w(i, 2)),
            F.concat_ws("/", w(i, 0), w(i, 1), F.concat(w(i, 2), w(i, 3))),
            F.upper(F.concat_ws("_", w(i, 0), w(i, 1), w(i, 2))),
        ]
        return F.get(F.array(*shapes), (i % len(shapes)).cast("int"))

    every = F.sequence(F.lit(0), F.size("w") - 4, F.lit(3))
    return words.select(F.lit(0).alias("label"), F.explode(F.transform(every, joined)).alias("text"))


def train(samples: DataFrame, smoothing: float = 0.5) -> list[float]:
    """Log-likelihood ratio of every transition, row by row of the alphabet.

    Only counts of character pairs come to the driver: at most twice the
    alphabet squared."""
    n = len(ALPHABET)
    pairs = samples.where("text is not null and label in (0, 1) and length(text) > 1").select(
        "label", F.explode(F.transform(F.sequence(F.lit(1), F.length("text") - 1), lambda i: F.col("text").substr(i, F.lit(2)))).alias("pair")
    )
    a, b = (F.expr(f"instr('{ALPHABET}', substring(pair, {k}, 1))") for k in (1, 2))
    cells = pairs.select("label", a.alias("a"), b.alias("b")).where("a > 0 and b > 0").groupBy("label", "a", "b").count().collect()
    table = [[[smoothing] * n for _ in range(n)] for _ in range(2)]
    for r in cells:
        table[r["label"]][r["a"] - 1][r["b"] - 1] += r["count"]
    chance = [[[x / sum(row) for x in row] for row in t] for t in table]
    return [math.log(chance[1][i][j] / chance[0][i][j]) for i in range(n) for j in range(n)]


def mean_ratio(value: Column, ratios: list[float]) -> Column:
    """Mean log-likelihood ratio of a string's transitions."""
    n = len(ALPHABET)
    table = F.from_json(F.lit("[" + ",".join(f"{x:.6f}" for x in ratios) + "]"), "array<double>")
    alphabet = F.lit(ALPHABET)
    places = F.transform(F.split(value, ""), lambda c: F.call_function("instr", alphabet, c))
    steps = F.transform(F.sequence(F.lit(0), F.size(places) - 2), lambda i: F.get(table, (F.get(places, i) - 1) * n + F.get(places, i + 1) - 1))
    return F.aggregate(steps, F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0))) / (F.length(value) - 1)


def scan(
    docs: DataFrame, samples: DataFrame | None = None, least_ratio: float = 0.7, least_sum: float = 15.0, least_length: int = 16,
    sample_rows: int = 512, sample_chars: int = 2048,
) -> DataFrame:
    """Per row of docs: doc_id, and for each kind its spans (start, end, value)."""
    if samples is None:
        samples = default_samples(docs.sparkSession).unionByName(corpus_samples(docs, sample_rows, sample_chars))
    ratios = train(samples)
    candidate = CANDIDATE % least_length
    df = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"))
    df = _places(df, "assign", _FOUND["assign"], F.col("_text").rlike(_GATES["assign"]), 2, 6)
    df = _places(df, "access", _FOUND["access"], F.contains(F.col("_text"), F.lit(_GATES["access"])), 0, 20)
    df = _places(df, "hex", _FOUND["hex"], F.col("_text").rlike(_GATES["hex"]), 0, 24)
    df = _places(df, "random", candidate, F.col("_text").rlike(candidate), 0, least_length)
    free = lambda s: ~F.exists(F.concat("assign", "access", "hex"), lambda t: (t["start"] < s["end"]) & (s["start"] < t["end"]))
    least = lambda s: F.greatest(F.lit(least_ratio), F.lit(least_sum) / (F.length(s["value"]) - 1))
    likely = F.filter("random", lambda s: s["value"].rlike("[A-Za-z]") & free(s))
    likely = F.filter(likely, lambda s: mean_ratio(s["value"], ratios) >= least(s))
    return df.withColumn("random", F.when(F.size("random") > 0, likely).otherwise(F.col("random"))).drop("_text")


def listed(kinds: tuple[str, ...]) -> Column:
    """kind:start:end of the spans of these kinds, by start, then kind."""
    def tagged(kind: str) -> Column:
        number = F.lit(KINDS.index(kind))
        return F.transform(kind, lambda s: F.struct(s["start"].alias("start"), number.alias("kind"), s["end"].alias("end")))

    names = F.array(*[F.lit(k) for k in KINDS])
    text = F.transform(F.array_sort(F.concat(*[tagged(k) for k in kinds])), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(text, ",")
