"""The engine's operators applied to the harness tables.

Each query runs an operator on table columns that stand in for pages, operators,
boxes or objects, and has the same result in DuckDB SQL. ``engine`` builds content
streams, documents or page lists from rows and hands them to the functions that mask
documents; the other queries are column forms of the operators they are named for.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.functions import content, geometry, images, names, paging
from palimpsest.operators import blocks, boxes, cache
from palimpsest.sources import fonts, jobs, pdf_pages
from palimpsest.sources.pdf_syntax import Document, Name, Ref, encoded, escaped_name, operations

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return register


def t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def engine(df: DataFrame, kinds: str, each: Callable[..., Iterator[tuple]]) -> DataFrame:
    """The rows (kinds) that each gives for the values of every row of df."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = to_arrow_schema(_parse_datatype_string(kinds))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = [out for row in zip(*(c.to_pylist() for c in batch.columns), strict=True) for out in each(*row)]
            columns = list(zip(*rows, strict=True)) or [()] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return df.toDF(*[f"_c{i}" for i in range(len(df.columns))]).mapInArrow(run, kinds)


def in_order(df: DataFrame, keys: list[str], order: list[str], *values) -> DataFrame:
    """keys, and the values (columns) of each key's rows as arrays in order."""
    rows = df.select(*keys, F.struct(*order, *[v.alias(f"_v{i}") for i, v in enumerate(values)]).alias("o"))
    sorted_rows = rows.groupBy(*keys).agg(F.array_sort(F.collect_list("o")).alias("o"))
    return sorted_rows.select(*keys, *[F.col(f"o._v{i}").alias(f"_v{i}") for i in range(len(values))])


# configuration ---------------------------------------------------------------


@query("""
WITH s AS (SELECT p_partkey, concat(p_size, '-', p_size + 3, ', ', p_size + 10, ',', p_size) AS spec FROM part),
n AS (SELECT p_partkey, unnest(string_split(spec, ',')) AS part FROM s),
r AS (SELECT p_partkey, split_part(trim(part), '-', 1)::INT AS low,
             CASE WHEN contains(part, '-') THEN split_part(trim(part), '-', 2)::INT ELSE trim(part)::INT END AS high FROM n),
e AS (SELECT p_partkey, unnest(range(low, high + 1)) AS page FROM r)
SELECT DISTINCT p_partkey, page::INT AS page FROM e""")
def page_range_expand(spark, sf):
    size = F.col("p_size")
    spec = F.concat(size, F.lit("-"), size + 3, F.lit(", "), size + 10, F.lit(","), size)
    rows = t(spark, sf, "part").select("p_partkey", spec.alias("spec"))
    return engine(rows, "p_partkey bigint, page int", lambda key, spec: ((key, page) for page in jobs.parse_pages(spec)))


@query("""
SELECT c_custkey, coalesce(CASE WHEN c_custkey % 3 = 0 THEN c_nationkey * 10 END, CASE WHEN n_regionkey < 3 THEN 100 + n_regionkey END, 300) AS dpi,
       coalesce(CASE WHEN c_acctbal < 0 THEN 'bw' END, CASE WHEN n_regionkey = 1 THEN 'grayscale' END, 'rgb') AS color_mode
FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey""")
def settings_merge(spark, sf):
    both = t(spark, sf, "customer").join(t(spark, sf, "nation"), F.expr("c_nationkey = n_nationkey"), "left")
    dpi = paging.merged(F.when(F.col("c_custkey") % 3 == 0, F.col("c_nationkey") * 10), F.when(F.col("n_regionkey") < 3, F.col("n_regionkey") + 100), paging.DEFAULTS["dpi"])
    mode = paging.merged(F.when(F.col("c_acctbal") < 0, "bw"), F.when(F.col("n_regionkey") == 1, "grayscale"), paging.DEFAULTS["color_mode"])
    return both.select("c_custkey", dpi.alias("dpi"), mode.alias("color_mode"))


def _overrides(spark, sf):
    flag = F.min("l_returnflag")
    mode = F.when(flag == "A", "bw").when(flag == "N", "grayscale").otherwise("skip")
    return t(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(mode.alias("mode")).select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("page"), "mode")


def _pages(spark, sf):
    return t(spark, sf, "orders").select(F.col("o_orderkey").alias("doc"), "o_orderstatus", F.explode(F.sequence(F.lit(1), F.lit(7))).alias("page"))


_MODES_SQL = """
WITH o AS (SELECT l_orderkey AS doc, l_linenumber AS page, CASE min(l_returnflag) WHEN 'A' THEN 'bw' WHEN 'N' THEN 'grayscale' ELSE 'skip' END AS mode
           FROM lineitem GROUP BY 1, 2),
p AS (SELECT o_orderkey AS doc, o_orderstatus, unnest(range(1, 8))::INT AS page FROM orders),
m AS (SELECT p.doc, p.page, p.o_orderstatus, coalesce(o.mode, 'rgb') AS mode FROM p LEFT JOIN o ON p.doc = o.doc AND p.page = o.page)
"""


@query(_MODES_SQL + "SELECT doc, page, mode FROM m")
def mode_resolve(spark, sf):
    return paging.page_modes(_pages(spark, sf), _overrides(spark, sf), ["doc", "page"], F.lit("rgb")).select("doc", "page", "mode")


@query("""
SELECT l_orderkey AS doc, l_linenumber AS page,
       'page in two lists: ' || string_agg(DISTINCT mode, ', ' ORDER BY mode) AS error
FROM (SELECT *, CASE l_returnflag WHEN 'A' THEN 'bw' WHEN 'N' THEN 'grayscale' ELSE 'skip' END AS mode FROM lineitem)
GROUP BY 1, 2 HAVING count(DISTINCT mode) > 1""")
def mode_conflicts(spark, sf):
    mode = F.when(F.col("l_returnflag") == "A", "bw").when(F.col("l_returnflag") == "N", "grayscale").otherwise("skip")
    lists = t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("page"), mode.alias("mode"))
    return paging.resolve_modes(lists, ["doc"]).where("error is not null").select("doc", "page", "error")


@query(_MODES_SQL + "SELECT o_orderstatus, count(*) FILTER (WHERE mode <> 'skip') AS processed, count(*) FILTER (WHERE mode = 'skip') AS skipped FROM m GROUP BY 1")
def skip_filter_counts(spark, sf):
    pages = paging.page_modes(_pages(spark, sf), _overrides(spark, sf), ["doc", "page"], F.lit("rgb"))
    return pages.groupBy("o_orderstatus").agg(F.count_if(F.col("mode") != "skip").alias("processed"), F.count_if(F.col("mode") == "skip").alias("skipped"))


@query("""
SELECT DISTINCT l_orderkey AS doc, l_linenumber AS page FROM lineitem
WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND l_linenumber BETWEEN 1 AND o_orderkey % 7 + 1)""")
def override_out_of_range(spark, sf):
    overrides = _overrides(spark, sf).select("doc", "page")
    counts = t(spark, sf, "orders").select(F.col("o_orderkey").alias("d"), (F.col("o_orderkey") % 7 + 1).alias("pages"))
    return overrides.join(counts, (F.col("doc") == F.col("d")) & F.col("page").between(F.lit(1), F.col("pages")), "left_anti")


# cache -----------------------------------------------------------------------

_KEY_SQL = """
sha256(encode(source) || unhex(format('{:02X}{:02X}{:02X}{:02X}', doc_id & 255, (doc_id >> 8) & 255, (doc_id >> 16) & 255, (doc_id >> 24) & 255))
  || encode(text) || encode('{"bg_quality":50,"color_mode":"' || CASE lang WHEN 'en' THEN 'rgb' ELSE 'bw' END
  || '","dpi":300,"fg_dpi":' || (doc_id % 7)::VARCHAR || ',"fg_quality":30}'))"""


def _key():
    mode = F.when(F.col("lang") == "en", "rgb").otherwise("bw")
    settings = paging.canonical_settings(mode, F.lit(300), F.col("doc_id") % 7, F.lit(50), F.lit(30))
    return paging.cache_key(F.col("source"), F.col("doc_id"), F.col("text"), settings)


@query(f"SELECT doc_id, {_KEY_SQL} AS key FROM documents")
def cache_key(spark, sf):
    return t(spark, sf, "documents").select("doc_id", _key().alias("key"))


@query("""
WITH k AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN sha256(text) WHEN 1 THEN upper(sha256(text)) WHEN 2 THEN left(sha256(text), 63) ELSE sha256(text) || '0' END AS key FROM documents)
SELECT doc_id, regexp_full_match(key, '[0-9a-f]{64}') AS valid FROM k""")
def cache_key_valid(spark, sf):
    h = F.sha2("text", 256)
    key = F.when(F.col("doc_id") % 4 == 0, h).when(F.col("doc_id") % 4 == 1, F.upper(h)).when(F.col("doc_id") % 4 == 2, F.substring(h, 1, 63)).otherwise(F.concat(h, F.lit("0")))
    return t(spark, sf, "documents").select("doc_id", paging.valid_key(key).alias("valid"))


def _cached(spark, sf):
    """(hits, pages without one): labels are the table of held results."""
    text = lambda c: F.col(c).cast("string")
    mode = F.when(F.col("lang") == "en", "1").otherwise("0")
    wanted = t(spark, sf, "documents").select(F.col("doc_id").alias("job"), F.lit(0).alias("page"), F.lit(1.0).alias("width"), F.lit(1.0).alias("height"), text("doc_id").alias("key"), mode.alias("mode"))
    known = {"key": text("doc_id"), "mode": text("quality"), "width": F.lit(1.0), "height": F.lit(1.0)}
    held = [known.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in cache._held()]
    return cache.split_hits(wanted, t(spark, sf, "labels").select(*held, F.current_timestamp().alias("written")))


@query("SELECT doc_id, CASE lang WHEN 'en' THEN 1 ELSE 0 END AS mode FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = CASE d.lang WHEN 'en' THEN 1 ELSE 0 END)")
def cache_hits(spark, sf):
    return _cached(spark, sf)[0].select(F.col("job").alias("doc_id"), F.col("mode").cast("int").alias("mode"))


@query("SELECT doc_id, CASE lang WHEN 'en' THEN 1 ELSE 0 END AS mode FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = CASE d.lang WHEN 'en' THEN 1 ELSE 0 END)")
def cache_misses(spark, sf):
    return _cached(spark, sf)[1].select(F.col("job").alias("doc_id"), F.col("mode").cast("int").alias("mode"))


@query("SELECT doc_id, min(doc_id) OVER (PARTITION BY sha256(text)) AS copy_of FROM documents")
def dedup_object_copy(spark, sf):
    docs = t(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    first = docs.groupBy("h").agg(F.min("doc_id").alias("copy_of"))
    return docs.join(first, "h").select("doc_id", "copy_of")


# operator streams ------------------------------------------------------------


def _tags(spark, sf):
    tags = F.regexp_extract_all("html", F.lit("<(/?[a-zA-Z0-9]+)"), F.lit(1))
    return t(spark, sf, "pages").select("page_id", F.posexplode(tags).alias("seq", "tag"))


_TAGS_SQL = """
WITH a AS (SELECT page_id, regexp_extract_all(html, '<(/?[a-zA-Z0-9]+)', 1) AS tags FROM pages),
x AS (SELECT page_id, unnest(tags) AS tag, generate_subscripts(tags, 1) - 1 AS seq FROM a)
"""
_SHUT_TAGS = ["nav", "script", "style"]


@query(_TAGS_SQL + """,
s AS (SELECT *, CASE WHEN tag IN ('nav', 'script', 'style') THEN 1 WHEN tag IN ('/nav', '/script', '/style') THEN -1 ELSE 0 END AS step FROM x),
r AS (SELECT *, sum(step) OVER (PARTITION BY page_id ORDER BY seq) AS run FROM s),
d AS (SELECT *, run - least(0, min(run) OVER (PARTITION BY page_id ORDER BY seq)) AS depth FROM r)
SELECT page_id, seq::INT AS seq, tag FROM d WHERE depth = 0 AND step = 0""")
def strip_blocks(spark, sf):
    shows = {x: "BT" for x in _SHUT_TAGS} | {f"/{x}": "ET" for x in _SHUT_TAGS}

    def each(page, tags):
        stream = encoded([(shows[tag], []) if tag in shows else ("Do", [seq, Name(tag)]) for seq, tag in enumerate(tags)])
        return ((page, seq, str(tag)) for _, (seq, tag) in operations(content.strip_text(stream)))

    tags = F.regexp_extract_all("html", F.lit("<(/?[a-zA-Z0-9]+)"), F.lit(1))
    return engine(t(spark, sf, "pages").select("page_id", tags), "page_id bigint, seq int, tag string", each)


@query("""
WITH a AS (SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS names FROM pages)
SELECT page_id, generate_subscripts(names, 1)::INT - 1 AS seq, unnest(names) AS name FROM a""")
def placements(spark, sf):
    def each(page, found):
        drawn = content.placements(encoded([("Do", [Name(name)]) for name in found]))
        return ((page, seq, name) for seq, (name, _, _) in enumerate(drawn))

    found = F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))
    return engine(t(spark, sf, "pages").select("page_id", found), "page_id bigint, seq int, name string", each)


_DEPTH_SQL = _TAGS_SQL + """,
s AS (SELECT *, CASE WHEN tag IN ('ul', 'li', 'nav', 'article', 'p') THEN 1 WHEN tag IN ('/ul', '/li', '/nav', '/article', '/p') THEN -1 ELSE 0 END AS step FROM x),
r AS (SELECT *, sum(step) OVER (PARTITION BY page_id ORDER BY seq) AS run FROM s),
d AS (SELECT *, run - least(0, min(run) OVER (PARTITION BY page_id ORDER BY seq)) AS depth FROM r)
"""
_NEST = ["ul", "li", "nav", "article", "p"]


@query(_DEPTH_SQL + "SELECT page_id, max(depth)::BIGINT AS deepest, count(*) FILTER (WHERE depth = 0) AS outside FROM d GROUP BY 1")
def nesting_depth(spark, sf):
    step = F.when(F.col("tag").isin(_NEST), 1).when(F.col("tag").isin([f"/{x}" for x in _NEST]), -1).otherwise(0)
    rows = blocks.clamped_depth(_tags(spark, sf), ["page_id"], "seq", step)
    return rows.groupBy("page_id").agg(F.max("depth").alias("deepest"), F.count_if(F.col("depth") == 0).alias("outside"))


@query("""
WITH e AS (SELECT user_id, event_id, ts, event_type, value, CASE event_type WHEN 'signup' THEN 1 WHEN 'error' THEN -1 ELSE 0 END AS step FROM events),
r AS (SELECT *, sum(step) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM e),
d AS (SELECT *, run - least(0, min(run) OVER (PARTITION BY user_id ORDER BY seq)) AS depth FROM r),
s AS (SELECT user_id, seq AS at, depth AS level, value FROM d WHERE event_type = 'view'),
u AS (SELECT s.user_id, s.at, min(d.seq) AS until FROM s JOIN d ON d.user_id = s.user_id AND d.seq > s.at AND d.depth < s.level GROUP BY ALL)
SELECT d.event_id, d.depth::BIGINT AS depth,
       (SELECT arg_max(s.value, s.at) FROM s LEFT JOIN u ON u.user_id = s.user_id AND u.at = s.at
        WHERE s.user_id = d.user_id AND s.at <= d.seq AND (u.until IS NULL OR d.seq < u.until)) AS value
FROM d""")
def scope_state(spark, sf):
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = t(spark, sf, "events").withColumn("seq", F.row_number().over(order))
    kind = F.col("event_type")
    found = blocks.scope_values(rows, ["user_id"], "seq", kind == "signup", kind == "error", kind == "view", F.col("value"))
    return rows.drop("value").join(found, ["user_id", "seq"]).select("event_id", F.col("depth").cast("bigint").alias("depth"), "value")


@query("""
WITH m AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS n,
                  [(l_quantity % 3 - 1)::BIGINT, (l_linenumber % 2)::BIGINT, (l_partkey % 2)::BIGINT, 1::BIGINT, l_suppkey % 10, l_linenumber::BIGINT] AS m FROM lineitem),
a AS (SELECT l_orderkey, list(m ORDER BY n) AS ms FROM m GROUP BY 1),
p AS (SELECT l_orderkey, list_reduce(list_prepend([1, 0, 0, 1, 0, 0]::BIGINT[], ms), lambda x, y: [
  x[1] * y[1] + x[2] * y[3], x[1] * y[2] + x[2] * y[4], x[3] * y[1] + x[4] * y[3], x[3] * y[2] + x[4] * y[4],
  x[5] * y[1] + x[6] * y[3] + y[5], x[5] * y[2] + x[6] * y[4] + y[6]]) AS r FROM a)
SELECT l_orderkey, r[1] AS a, r[2] AS b, r[3] AS c, r[4] AS d, r[5] AS e, r[6] AS f FROM p""")
def ctm_compose(spark, sf):
    entries = F.array(*[F.expr(e).cast("bigint") for e in ("l_quantity % 3 - 1", "l_linenumber % 2", "l_partkey % 2", "1", "l_suppkey % 10", "l_linenumber")])
    rows = in_order(t(spark, sf, "lineitem"), ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"], entries)

    def each(order, matrices):
        ((_, matrix, _),) = content.placements(encoded([*(("cm", m) for m in matrices), ("Do", [Name("Im")])]))
        yield (order, *(int(x) for x in matrix))

    return engine(rows, "l_orderkey bigint, a bigint, b bigint, c bigint, d bigint, e bigint, f bigint", each)


@query("""
WITH m AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity - 25 AS a, l_linenumber - 3.0 AS b, (l_partkey % 5)::DOUBLE AS c, l_quantity AS d, (l_suppkey % 50)::DOUBLE AS e, 7.0::DOUBLE AS f FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, least(e, a + e, c + e, a + c + e)::DOUBLE AS x_min, least(f, b + f, d + f, b + d + f)::DOUBLE AS y_min,
       greatest(e, a + e, c + e, a + c + e)::DOUBLE AS x_max, greatest(f, b + f, d + f, b + d + f)::DOUBLE AS y_max FROM m""")
def bbox_from_ctm(spark, sf):
    entries = F.array(*[F.expr(e).cast("double") for e in ("l_quantity - 25", "l_linenumber - 3", "l_partkey % 5", "l_quantity", "l_suppkey % 50", "7")])
    rows = t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", entries)
    kinds = "l_orderkey bigint, l_linenumber int, l_partkey bigint, l_suppkey bigint, x_min double, y_min double, x_max double, y_max double"
    return engine(rows, kinds, lambda *row: ((*row[:4], *content.hull(tuple(row[4]))),))


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 'gray' AS space FROM lineitem WHERE l_returnflag = 'A' AND abs(l_tax * 12.5 - 1) < 1e-6
UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 'rgb' FROM lineitem WHERE l_returnflag = 'N' AND abs(l_discount * 10 - 1) < 1e-6 AND abs(l_tax * 12.5 - 1) < 1e-6
UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 'cmyk' FROM lineitem WHERE l_returnflag = 'R' AND abs(l_discount) < 1e-6 AND abs(l_tax) < 1e-6""")
def white_rects(spark, sf):
    space = F.when(F.col("l_returnflag") == "A", "gray").when(F.col("l_returnflag") == "N", "rgb").otherwise("cmyk")
    d, x = F.col("l_discount"), F.col("l_tax")
    c = F.when(space == "gray", F.array(x * 12.5)).when(space == "rgb", F.array(d * 10, d * 10, x * 12.5)).otherwise(F.array(d, d, x, x))
    fill = {"gray": "g", "rgb": "rg", "cmyk": "k"}

    def each(*row):
        *keys, space, color = row
        if content.white_rects(encoded([(fill[space], color), ("re", [0, 0, 1, 1]), ("f", [])])):
            yield (*keys, space)

    rows = t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", space, c)
    return engine(rows, "l_orderkey bigint, l_linenumber int, l_partkey bigint, l_suppkey bigint, space string", each)


@query("""
WITH g AS (SELECT *, count(*) FILTER (WHERE event_type IN ('error', 'purchase')) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM events)
SELECT user_id, session, count(*) FILTER (WHERE event_type = 'view') AS rects, min(event_id) AS first_id FROM g GROUP BY 1, 2""")
def path_rect_sessions(spark, sf):
    order = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    kind = F.col("event_type")
    rows = t(spark, sf, "events").withColumn("session", F.sum(F.when(kind.isin("error", "purchase"), 1).otherwise(0)).over(order))
    return rows.groupBy("user_id", "session").agg(F.count_if(kind == "view").alias("rects"), F.min("event_id").alias("first_id"))


@query("""
SELECT event_id, last_value(CASE WHEN event_type = 'click' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS fill FROM events""")
def fill_color_carry(spark, sf):
    # (gray, 0, 0) once a color is set; before that the single component it starts with
    color = F.when(F.col("event_type") == "click", F.col("value"))
    rows = in_order(t(spark, sf, "events"), ["user_id"], ["ts", "event_id"], F.col("event_id"), color)

    def each(_, events, colors):
        states = content.walk([("n", []) if c is None else ("rg", [c, 0.0, 0.0]) for c in colors])
        for event, (_, _, state) in zip(events, states, strict=True):
            yield event, state.fill.parts[0] if len(state.fill.parts) == 3 else None

    return engine(rows, "event_id bigint, fill double", each)


# boxes -----------------------------------------------------------------------

_BOX_SQL = """
WITH a AS (SELECT p_partkey AS id, p_partkey % 25 AS page, (p_partkey * 37 % 500)::DOUBLE AS x0, (p_partkey * 91 % 500)::DOUBLE AS y0, (p_partkey * 37 % 500 + p_size)::DOUBLE AS x1, (p_partkey * 91 % 500 + p_size)::DOUBLE AS y1 FROM part),
b AS (SELECT s_suppkey AS sid, s_suppkey % 25 AS page, (s_suppkey * 53 % 480)::DOUBLE AS x0, (s_suppkey * 29 % 480)::DOUBLE AS y0, (s_suppkey * 53 % 480 + 40)::DOUBLE AS x1, (s_suppkey * 29 % 480 + 60)::DOUBLE AS y1 FROM supplier)
"""
_MEET = "a.page = b.page AND a.x0 < b.x1 AND a.x1 > b.x0 AND a.y0 < b.y1 AND a.y1 > b.y0"


def _boxes(spark, sf):
    num = lambda e: F.expr(e).cast("double")
    a = t(spark, sf, "part").select(
        F.col("p_partkey").alias("_id"), F.expr("p_partkey % 25").alias("page"),
        geometry.box(num("p_partkey * 37 % 500"), num("p_partkey * 91 % 500"), num("p_partkey * 37 % 500 + p_size"), num("p_partkey * 91 % 500 + p_size")).alias("a"),
    )
    b = t(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("sid"), F.expr("s_suppkey % 25").alias("page"),
        geometry.box(num("s_suppkey * 53 % 480"), num("s_suppkey * 29 % 480"), num("s_suppkey * 53 % 480 + 40"), num("s_suppkey * 29 % 480 + 60")).alias("b"),
    )
    return a, b


@query(_BOX_SQL + f"SELECT a.id, b.sid FROM a JOIN b ON {_MEET}")
def bbox_overlap(spark, sf):
    a, b = _boxes(spark, sf)
    return boxes.overlap_join(a, b, ["page"], "a", "b", 64.0).select(F.col("_id").alias("id"), "sid")


@query(_BOX_SQL + f"SELECT a.id, a.page FROM a WHERE EXISTS (SELECT 1 FROM b WHERE {_MEET})")
def redact_semi(spark, sf):
    a, b = _boxes(spark, sf)
    return boxes.overlap_join(a, b, ["page"], "a", "b", 64.0, "left_semi").select(F.col("_id").alias("id"), "page")


@query(_BOX_SQL + f"SELECT a.id, a.page FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE {_MEET})")
def keep_anti(spark, sf):
    a, b = _boxes(spark, sf)
    return boxes.overlap_join(a, b, ["page"], "a", "b", 64.0, "left_anti").select(F.col("_id").alias("id"), "page")


@query("""
WITH q AS (SELECT p_partkey, 200 AS w, 100 AS h, (p_partkey % 130)::DOUBLE AS x0, (p_size * 2)::DOUBLE AS y0, (p_partkey % 130 + p_size)::DOUBLE AS x1, (p_size * 2 + 30)::DOUBLE AS y1 FROM part),
r AS (SELECT p_partkey, floor(least(greatest((x0 - 10) / 100 * w, 0), w))::BIGINT AS l, ceil(least(greatest((x1 - 10) / 100 * w, 0), w))::BIGINT AS r,
             floor(least(greatest((70 - y1) / 50 * h, 0), h))::BIGINT AS t, ceil(least(greatest((70 - y0) / 50 * h, 0), h))::BIGINT AS b FROM q)
SELECT p_partkey, CASE WHEN r > l AND b > t THEN l::DOUBLE END AS x, CASE WHEN r > l AND b > t THEN t::DOUBLE END AS y,
       CASE WHEN r > l AND b > t THEN (r - l)::DOUBLE END AS w, CASE WHEN r > l AND b > t THEN (b - t)::DOUBLE END AS h FROM r""")
def page_to_image(spark, sf):
    target = F.array(*[F.expr(e).cast("double") for e in ("p_partkey % 130", "p_size * 2", "p_partkey % 130 + p_size", "p_size * 2 + 30")])
    placed = (10.0, 20.0, 110.0, 70.0)
    each = lambda key, box: ((key, *(images.covered_pixels(tuple(box), placed, 200, 100) or (None,) * 4)),)
    found = engine(t(spark, sf, "part").select("p_partkey", target), "p_partkey bigint, x bigint, y bigint, w bigint, h bigint", each)
    return found.select("p_partkey", *[F.col(c).cast("double").alias(c) for c in "xywh"])


@query("""
SELECT p_partkey, (p_partkey % 900)::DOUBLE * (612.0::DOUBLE / 2550) AS x_min, 792.0::DOUBLE - (p_size * 50 + 120)::DOUBLE * (792.0::DOUBLE / 3300) AS y_min,
       (p_partkey % 900 + p_size)::DOUBLE * (612.0::DOUBLE / 2550) AS x_max, 792.0::DOUBLE - (p_size * 50)::DOUBLE * (792.0::DOUBLE / 3300) AS y_max FROM part""")
def pixel_to_page(spark, sf):
    num = lambda e: F.expr(e).cast("double")
    b = geometry.pixel_to_page(num("p_partkey % 900"), num("p_size * 50"), num("p_size"), F.lit(120.0), F.lit(612.0), F.lit(792.0), F.lit(2550), F.lit(3300))
    return t(spark, sf, "part").select("p_partkey", b.alias("b")).select("p_partkey", "b.*")


@query("""
WITH e AS (SELECT user_id, event_id, floor(value * 100)::BIGINT AS low, floor(value * 100)::BIGINT + 40 AS high FROM events),
g AS (SELECT *, CASE WHEN low - max(high) OVER (PARTITION BY user_id ORDER BY low, high ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= 5 THEN 0 ELSE 1 END AS starts FROM e),
i AS (SELECT *, sum(starts) OVER (PARTITION BY user_id ORDER BY low, high ROWS UNBOUNDED PRECEDING) AS island FROM g)
SELECT user_id, min(low) AS low, max(high) AS high, count(*) AS n FROM i GROUP BY user_id, island""")
def merge_nearby_1d(spark, sf):
    low = F.floor(F.col("value") * 100)
    rows = t(spark, sf, "events").select("user_id", low.alias("low"), (low + 40).alias("high"))
    return boxes.merge_intervals(rows, ["user_id"], "low", "high", 5)


@query()
def merge_nearby_2d(spark, sf):
    rows = t(spark, sf, "part").select(F.expr("p_partkey % 25").alias("page"), F.expr("p_partkey * 37 % 500").alias("x"), F.expr("p_partkey * 91 % 500").alias("y"), F.col("p_size").alias("w"), F.lit(6).alias("h"))
    return boxes.merge_boxes(rows, ["page"], 5)


@query("SELECT p_partkey, p_size % 9 AS w, p_size % 7 AS h FROM part WHERE p_size % 9 >= 4 AND p_size % 7 >= 4")
def noise_filter(spark, sf):
    return t(spark, sf, "part").select("p_partkey", F.expr("p_size % 9").alias("w"), F.expr("p_size % 7").alias("h")).where("w >= 4 and h >= 4")


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN 0.299 * (l_quantity / 50) + 0.587 * (l_discount * 10) + 0.114 * (l_tax * 12.5) >= 0.5 THEN 1 ELSE 0 END AS gray
FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_discount, l_tax FROM lineitem)""")
def luminance_bw(spark, sf):
    color = F.array(F.col("l_quantity") / 50, F.col("l_discount") * 10, F.col("l_tax") * 12.5)
    rows = t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", color)
    kinds = "l_orderkey bigint, l_linenumber int, l_partkey bigint, l_suppkey bigint, gray int"
    return engine(rows, kinds, lambda *row: ((*row[:4], int(content.Fill(tuple(row[4])).operator(True)[0])),))


# text ------------------------------------------------------------------------


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
       coalesce(sum(w) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS x
FROM (SELECT *, (l_quantity * 12 + CASE WHEN l_linenumber = 1 THEN 250 ELSE 0 END)::BIGINT AS w FROM lineitem)""")
def glyph_advance(spark, sf):
    w = F.col("l_quantity") * 12 + F.when(F.col("l_linenumber") == 1, 250).otherwise(0)
    keys = [F.col(c) for c in ("l_linenumber", "l_partkey", "l_suppkey")]
    rows = in_order(t(spark, sf, "lineitem"), ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"], w, *keys)

    def each(order, widths, *keys):
        text = content.Text(size=1000.0)
        for width, *key in zip(widths, *keys, strict=True):
            yield (order, *key, round(text.matrix[4]))
            text.advance(width)

    return engine(rows, "l_orderkey bigint, l_linenumber int, l_partkey bigint, l_suppkey bigint, x bigint", each)


@query("""
SELECT conv_id, turn, (700 - sum(CASE role WHEN 'user' THEN 14 ELSE 28 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING))::BIGINT AS y FROM
(SELECT conv_id, turn, min(role) AS role FROM conversations GROUP BY 1, 2)""")
def line_positions(spark, sf):
    lines = t(spark, sf, "conversations").groupBy("conv_id", "turn").agg(F.min("role").alias("role"))
    rows = in_order(lines, ["conv_id"], ["turn"], F.col("turn"), F.when(F.col("role") == "user", 14).otherwise(28))

    def each(conv, turns, leads):
        ops = [("BT", []), ("Td", [0, 700]), *(op for lead in leads for op in (("TL", [lead]), ("T*", []), ("Tj", [b"x"])))]
        for turn, shown in zip(turns, content.text_commands(encoded(ops)), strict=True):
            yield conv, turn, round(shown["text_matrix"][5])

    kinds = {f.name: f.dataType.simpleString() for f in lines.schema}
    return engine(rows, f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, y bigint", each)


@query("""
WITH faces AS (SELECT * FROM (VALUES ('red widget', 'Arial', 'LARGE', 0), ('x', 'Times New Roman', 'SMALL', 1), ('y', 'Liberation Sans', 'ECONOMY', 2), ('z', 'Liberation Sans', 'PROMO', 3)) f(ps, family, style, face)),
p AS (SELECT p_partkey, p_name, p_type, CASE p_partkey % 3 WHEN 0 THEN 'Arial' WHEN 1 THEN 'Times New Roman' ELSE 'Helvetica' END AS family FROM part),
c AS (SELECT p_partkey, 1 AS step, face FROM p JOIN faces ON ps = p_name
  UNION ALL SELECT p_partkey, 2, face FROM p JOIN faces f ON f.family = p.family AND f.style = p.p_type
  UNION ALL SELECT p_partkey, 3, face FROM p JOIN faces f ON f.family = CASE WHEN p.family = 'Times New Roman' THEN 'Liberation Serif' ELSE 'Liberation Sans' END AND f.style = p.p_type),
b AS (SELECT p_partkey, min(step * 100 + face) AS best FROM c GROUP BY 1)
SELECT p.p_partkey, coalesce(best % 100, -1)::INT AS face, CASE WHEN best IS NULL THEN 'system font not found' END AS error FROM p LEFT JOIN b USING (p_partkey)""")
def font_resolution(spark, sf):
    faces = spark.createDataFrame([("red widget", "Arial", "LARGE", 0), ("x", "Times New Roman", "SMALL", 1), ("y", "Liberation Sans", "ECONOMY", 2), ("z", "Liberation Sans", "PROMO", 3)], "ps string, face_family string, face_style string, face int")
    family = F.when(F.expr("p_partkey % 3 = 0"), "Arial").when(F.expr("p_partkey % 3 = 1"), "Times New Roman").otherwise("Helvetica")
    wanted = t(spark, sf, "part").select("p_partkey", "p_name", F.col("p_type").alias("style"), family.alias("family"))
    return resolve_fonts(wanted, faces).select("p_partkey", F.coalesce("face", F.lit(-1)).alias("face"), "error")


def resolve_fonts(wanted: DataFrame, faces: DataFrame) -> DataFrame:
    """wanted (p_name, family, style) with the first face that fits: by exact
    name, by family and style, by the family's substitute and style."""
    substitute = F.create_map(*[F.lit(x) for pair in names.SUBSTITUTES.items() for x in pair])
    small = F.broadcast(faces)  # one row an installed face
    steps = (
        (1, F.col("ps") == F.col("p_name")),
        (2, (F.col("face_family") == F.col("family")) & (F.col("face_style") == F.col("style"))),
        (3, (F.col("face_family") == substitute[F.col("family")]) & (F.col("face_style") == F.col("style"))),
    )
    found = None
    for step, fits in steps:
        part = wanted.join(small, fits).select("p_partkey", F.struct(F.lit(step).alias("step"), "face").alias("c"))
        found = part if found is None else found.unionByName(part)
    best = found.groupBy("p_partkey").agg(F.min("c").alias("c"))
    return wanted.join(best, "p_partkey", "left").withColumn("face", F.col("c.face")).withColumn("error", F.when(F.col("c").isNull(), "system font not found"))


@query("""
WITH n AS (SELECT p_partkey, concat(upper(left(p_type, 1)), lower(substr(p_type, 2)), CASE WHEN p_size % 2 = 0 THEN 'NewRoman' ELSE '' END, CASE p_size % 3 WHEN 0 THEN 'PS' ELSE '' END,
  CASE p_size % 5 WHEN 0 THEN '-BoldItalic' WHEN 1 THEN '-Bold' WHEN 2 THEN '-Italic' WHEN 3 THEN '-Oblique' ELSE '' END, CASE p_size % 7 WHEN 0 THEN 'MT' ELSE '' END) AS name FROM part),
c AS (SELECT p_partkey, regexp_replace(name, '(MT)+$', '') AS core FROM n),
f AS (SELECT p_partkey, core, regexp_replace(regexp_replace(core, '-(BoldItalic|Bold|Italic|Oblique)$', ''), '(PS)+$', '') AS family FROM c)
SELECT p_partkey, left(family, 1) || regexp_replace(substr(family, 2), '([A-Z])', ' \\1', 'g') AS family,
       regexp_matches(core, '-(BoldItalic|Bold)$') AS bold, regexp_matches(core, '-(BoldItalic|Italic|Oblique)$') AS italic FROM f""")
def ps_name_parse(spark, sf):
    size = F.col("p_size")
    name = F.concat(
        F.upper(F.substring("p_type", 1, 1)), F.lower(F.expr("substring(p_type, 2)")), F.when(size % 2 == 0, "NewRoman").otherwise(""), F.when(size % 3 == 0, "PS").otherwise(""),
        F.when(size % 5 == 0, "-BoldItalic").when(size % 5 == 1, "-Bold").when(size % 5 == 2, "-Italic").when(size % 5 == 3, "-Oblique").otherwise(""), F.when(size % 7 == 0, "MT").otherwise(""),
    )
    each = lambda key, name: ((key, *fonts.ps_name_parts(name)),)
    return engine(t(spark, sf, "part").select("p_partkey", name), "p_partkey bigint, family string, bold boolean, italic boolean", each)


@query("SELECT doc_id, CASE lang WHEN 'de' THEN 'Identity-H' WHEN 'fr' THEN 'WinAnsiEncoding' ELSE 'WinAnsiEncoding' END AS encoding FROM documents")
def encoding_default(spark, sf):
    named = {"de": {"Encoding": Ref(1, 0)}, "fr": {"Encoding": Name("WinAnsiEncoding")}}

    def each(doc_id, lang):
        two_byte = fonts._identity(Document({1: Name("Identity-H")}), named.get(lang, {}))
        yield doc_id, "Identity-H" if two_byte else "WinAnsiEncoding"

    return engine(t(spark, sf, "documents").select("doc_id", "lang"), "doc_id bigint, encoding string", each)


@query("""
SELECT n_nationkey, concat('/', array_to_string(list_transform(string_split(n_name || ' (' || n_regionkey || ')#é', ''), lambda c: CASE WHEN regexp_full_match(c, '[A-Za-z0-9_-]') THEN c WHEN c = 'é' THEN '#C3#A9' ELSE '#' || upper(to_hex(ascii(c))) END), '')) AS pdf,
       array_to_string(list_transform(string_split(n_name || ' (' || n_regionkey || ')#é', ''), lambda c: CASE WHEN regexp_full_match(c, '[A-Za-z0-9_-]') THEN c WHEN c = 'é' THEN '%C3%A9' ELSE '%' || upper(to_hex(ascii(c))) END), '') AS file FROM nation""")
def escape_names(spark, sf):
    name = F.concat("n_name", F.lit(" ("), "n_regionkey", F.lit(")#é"))
    rows = t(spark, sf, "nation").select("n_nationkey", name.alias("name"), names.file_name(name).alias("file"))
    return engine(rows, "n_nationkey int, pdf string, file string", lambda key, name, file: ((key, escaped_name(name).decode(), file),))


# routing, assembly, report ---------------------------------------------------

_ROUTES_SQL = """
WITH r AS (SELECT d.doc_id, CASE WHEN lang = 'es' THEN 'skip' WHEN quality IS NULL THEN 'mrc' WHEN quality = 1 THEN 'outlines' WHEN lang = 'de' THEN 'bw_mask' WHEN toxic = 0 THEN 'text_masked' ELSE 'mrc' END AS route
           FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)
"""


def _routes(spark, sf):
    rows = t(spark, sf, "documents").select("doc_id", "lang").join(t(spark, sf, "labels"), "doc_id", "left")
    route = (
        F.when(F.col("lang") == "es", "skip").when(F.col("quality").isNull(), "mrc").when(F.col("quality") == 1, "outlines")
        .when(F.col("lang") == "de", "bw_mask").when(F.col("toxic") == 0, "text_masked").otherwise("mrc")
    )
    return rows.select("doc_id", route.alias("route"))


@query(_ROUTES_SQL + "SELECT route, count(*) AS pages FROM r GROUP BY 1")
def fallback_routes(spark, sf):
    return _routes(spark, sf).groupBy("route").agg(F.count("*").alias("pages"))


@query(_ROUTES_SQL + "SELECT doc_id, route, row_number() OVER (ORDER BY doc_id) AS n FROM r WHERE doc_id < 0 UNION ALL SELECT doc_id, route, row_number() OVER (PARTITION BY doc_id % 16 ORDER BY doc_id) FROM r")
def outputs_union(spark, sf):
    routes = _routes(spark, sf)
    parts = [routes.where(F.col("route").isin(*r)) for r in (("outlines",), ("text_masked", "bw_mask", "mrc"), ("skip",))]
    union = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return union.withColumn("n", F.row_number().over(Window.partitionBy(F.expr("doc_id % 16")).orderBy("doc_id")))


@query("""
SELECT c_custkey, coalesce(CASE WHEN c_custkey % 4 = 0 THEN c_acctbal END, CASE WHEN n_nationkey % 3 = 0 THEN n_nationkey * 10.0 END, r_regionkey * 100.0)::DOUBLE AS width
FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey""")
def inherit_lookup(spark, sf):
    up = t(spark, sf, "nation").join(F.broadcast(t(spark, sf, "region")), F.expr("n_regionkey = r_regionkey"))  # 25 rows at any scale
    rows = t(spark, sf, "customer").join(F.broadcast(up), F.expr("c_nationkey = n_nationkey"))

    def each(key, balance, nation, region):
        """A page below its nation's node, below its region's."""
        nodes = {2: {"Parent": Ref(3, 0)} | ({"Wide": nation * 10.0} if nation % 3 == 0 else {}), 3: {"Wide": region * 100.0}}
        page = {"Parent": Ref(2, 0)} | ({"Wide": balance} if key % 4 == 0 else {})
        yield key, Document(nodes).inherited(page, "Wide")

    return engine(rows.select("c_custkey", "c_acctbal", "n_nationkey", "r_regionkey"), "c_custkey bigint, width double", each)


@query("SELECT o_orderkey, bool_or(o_orderstatus = 'P') OVER (PARTITION BY o_custkey) AS shared FROM orders WHERE o_orderstatus <> 'P' OR true")
def shared_resources(spark, sf):
    orders = t(spark, sf, "orders")
    used = orders.groupBy("o_custkey").agg(F.bool_or(F.col("o_orderstatus") == "P").alias("shared"))
    return orders.join(used, "o_custkey").select("o_orderkey", "shared")


@query("SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 48)")
def prune_orphans(spark, sf):
    used = t(spark, sf, "lineitem").where("l_quantity > 48").select(F.col("l_partkey").alias("p_partkey")).distinct().withColumn("used", F.lit(True))
    rows = t(spark, sf, "part").select("p_partkey").join(used, "p_partkey", "left").withColumn("file", F.floor(F.col("p_partkey") / 256))
    rows = in_order(rows, ["file"], ["p_partkey"], F.col("p_partkey"), F.col("used"))

    def each(_, parts, used):
        """A document of a file's parts, of which the trailer refers to the used ones."""
        doc = Document({p: {} for p in parts}, {"Kids": [Ref(p, 0) for p, u in zip(parts, used, strict=True) if u]})
        pdf_pages.prune(doc)
        return ((p,) for p in parts if p not in doc.objects)

    return engine(rows, "p_partkey bigint", each)


@query("SELECT l_orderkey, l_partkey % 5 AS name, arg_max(l_extendedprice, l_linenumber * 1000000000000 + l_partkey * 1000000 + l_suppkey * 100 + l_quantity) AS value FROM lineitem GROUP BY 1, 2")
def last_placement_wins(spark, sf):
    seq = F.expr("cast(l_linenumber as bigint) * 1000000000000 + l_partkey * 1000000 + l_suppkey * 100 + l_quantity")
    return t(spark, sf, "lineitem").groupBy("l_orderkey", F.expr("l_partkey % 5").alias("name")).agg(F.max_by("l_extendedprice", seq).alias("value"))


@query("""
WITH c AS (SELECT p_partkey, unnest([p_size * 7 % 50, p_size * 3 % 40 + 5, p_size * 11 % 60]) AS size, unnest(['jbig2', 'gray', 'rgb']) AS kind, unnest([1, 2, 3]) AS n, p_size + 10 AS original FROM part),
f AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY size, n) AS r FROM c WHERE size <= original)
SELECT p.p_partkey, f.kind, coalesce(f.size, -1)::INT AS size FROM part p LEFT JOIN f ON f.p_partkey = p.p_partkey AND f.r = 1""")
def smallest_candidate(spark, sf):
    made = lambda e, kind, n: F.struct(F.expr(e).alias("size"), F.lit(n).alias("n"), F.lit(kind).alias("kind"))
    all_of = F.array(made("p_size * 7 % 50", "jbig2", 1), made("p_size * 3 % 40 + 5", "gray", 2), made("p_size * 11 % 60", "rgb", 3))
    best = F.array_min(F.filter(all_of, lambda c: c["size"] <= F.col("p_size") + 10))
    return t(spark, sf, "part").select("p_partkey", best.alias("b")).select("p_partkey", "b.kind", F.coalesce(F.col("b.size"), F.lit(-1)).cast("int").alias("size"))


@query()
def compress_unfiltered(spark, sf):
    from palimpsest.functions import codecs

    docs = t(spark, sf, "documents").where("lang <> 'en' and text is not null")
    return codecs.compressed(docs.select("doc_id", F.col("text").cast("binary").alias("data")), "data").select("doc_id", F.octet_length("data").cast("bigint").alias("size"))


@query("SELECT l_orderkey, string_agg(l_linenumber::VARCHAR, ' ' ORDER BY l_linenumber, l_partkey, l_suppkey) AS kids, count(*) AS n FROM lineitem GROUP BY 1")
def assemble_order(spark, sf):
    kids = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))), lambda k: k["l_linenumber"].cast("string"))
    return t(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_join(kids, " ").alias("kids"), F.count("*").alias("n"))


@query("""
SELECT CASE o_orderstatus WHEN 'F' THEN 'succeeded' WHEN 'O' THEN 'failed' ELSE 'running' END AS status, count(*) AS jobs, sum(o_orderkey % 7 + 1)::BIGINT AS pages FROM orders GROUP BY 1""")
def job_report(spark, sf):
    status = F.when(F.col("o_orderstatus") == "F", "succeeded").when(F.col("o_orderstatus") == "O", "failed").otherwise("running")
    return t(spark, sf, "orders").groupBy(status.alias("status")).agg(F.count("*").alias("jobs"), F.sum(F.expr("o_orderkey % 7 + 1")).alias("pages"))
