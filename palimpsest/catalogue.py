"""The engine's own queries by name, and DuckDB SQL that gives the same rows.

The tables hold no images, so embeddings stand in: the signs of their 64 values
are a fingerprint, their values an 8 x 8 grey raster, and sixteen of them in the
order of ids a 32 x 32 one, the last one filled up by zeros, or a 16 x 16 one of
red, green, blue and alpha.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import planes, raster
from palimpsest.functions.columns import base_name, clamp_byte, extension, grey, hamming, is_image, popcount, sign_word
from palimpsest.operators import groups, join, nearest, pivots, selection
from palimpsest.plans.numbering import numbered
from palimpsest.plans.storage import kept
from palimpsest.sources import png, sinks
from palimpsest.sources.files import fingerprints, listed_paths
from palimpsest.spec import DHASH, SPECS, spec_named

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
T = 22
#: Places of an order, in hundredths of all.
PLACES = {"least": 0, "lower quarter": 25, "upper median": 50, "last hundredth": 99, "greatest": 100}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prints(spark: SparkSession, sf_dir: str, two: bool = False) -> DataFrame:
    """(id, w0[, w1]); the second word takes the signs of what is above 0.05."""
    e = table(spark, sf_dir, "embeddings")
    cols = [F.col("vec_id").alias("id"), sign_word(F.col("embedding")).alias("w0")]
    if two:
        cols.append(sign_word(F.transform("embedding", lambda x: x - F.lit(0.05).cast("float"))).alias("w1"))
    return e.select(*cols)


_FP = "CAST(CAST(array_to_string(list_transform(embedding, lambda x: CASE WHEN {0} > 0 THEN '1' ELSE '0' END), '') AS BIT) AS BIGINT)"
_PRINTS = f"p AS (SELECT vec_id AS id, {_FP.format('x')} AS w FROM embeddings)"
_EDGES = f"{_PRINTS}, e AS (SELECT a.id AS a, b.id AS b, CAST(bit_count(xor(a.w, b.w)) AS INTEGER) AS dist FROM p a JOIN p b ON a.id < b.id AND bit_count(xor(a.w, b.w)) < {T})"
_GROUPS = f"""{_EDGES}, both_ways AS (SELECT a, b, dist FROM e UNION ALL SELECT b, a, dist FROM e),
    nb AS (SELECT a AS id, list(b) AS bs FROM both_ways GROUP BY a), o AS (SELECT id, bs, row_number() OVER (ORDER BY id) AS rn FROM nb),
    walk AS (SELECT CAST(0 AS BIGINT) AS rn, CAST([] AS BIGINT[]) AS skip, CAST(NULL AS BIGINT) AS seed
        UNION ALL SELECT o.rn, CASE WHEN list_contains(w.skip, o.id) THEN w.skip ELSE list_concat(w.skip, list_append(o.bs, o.id)) END,
            CASE WHEN list_contains(w.skip, o.id) THEN NULL ELSE o.id END FROM walk w JOIN o ON o.rn = w.rn + 1),
    s AS (SELECT seed, row_number() OVER (ORDER BY seed) - 1 AS group_id FROM walk WHERE seed IS NOT NULL),
    m AS (SELECT group_id, seed, 0 AS ord, seed AS id, 0 AS dist FROM s
        UNION ALL SELECT group_id, seed, row_number() OVER (PARTITION BY seed ORDER BY dist DESC, b), b, dist FROM s JOIN both_ways ON a = seed)"""


@query(f"WITH {_PRINTS} SELECT id, w AS hash FROM p")
def fp64_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prints(spark, sf_dir).withColumnRenamed("w0", "hash")


def _linked_sql(p: str, dist: str, t: int) -> str:
    """Pairs of different fingerprints w, named by their least ids, and copies with those, of p (id, w)."""
    return f"""WITH {p}, k AS (SELECT w, min(id) AS id FROM p GROUP BY w)
        SELECT least(a.id, b.id) AS a, greatest(a.id, b.id) AS b, {dist} AS dist FROM k a JOIN k b ON a.id < b.id AND {dist} < {t}
        UNION ALL SELECT k.id, p.id, 0 FROM p JOIN k USING (w) WHERE p.id <> k.id"""


_DIST = "CAST(bit_count(xor(a.w, b.w)) AS INTEGER)"
_LINKS = _linked_sql(_PRINTS, _DIST, T)


@query(_LINKS)
def hamming_pairs_lt22(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join.linked_kinds(prints(spark, sf_dir), T)


@query(_LINKS)
def block_join_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join.linked_kinds(prints(spark, sf_dir), T, "block")


@query(_linked_sql(_PRINTS, _DIST, 19))
def band_join_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join.linked_kinds(prints(spark, sf_dir), 19, "band")


_P2 = f"p AS (SELECT vec_id AS id, {{'w': {_FP.format('x')}, 'v': {_FP.format('x - CAST(0.05 AS FLOAT)')}}} AS w FROM embeddings)"


@query(_linked_sql(_P2, "(CAST(bit_count(xor(a.w.w, b.w.w)) AS INTEGER) + CAST(bit_count(xor(a.w.v, b.w.v)) AS INTEGER))", 40))
def dist128_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join.linked_kinds(prints(spark, sf_dir, two=True), 40)


#: What the words of a wide fingerprint take from values before their signs, and the distance below which such ones match.
_LEVELS, WIDE = (0.0, 0.05, -0.05, 0.1), 88
_WORDS = "[" + ", ".join(_FP.format(f"x - CAST({v} AS FLOAT)") for v in _LEVELS) + "]"
_WIDE = f"given AS (SELECT vec_id AS id, CASE WHEN vec_id % 89 = 7 THEN ({_WORDS})[:3] ELSE {_WORDS} END AS w FROM embeddings), p AS (SELECT id, w FROM given WHERE len(w) = 4)"
_WIDE_DIST = "(" + " + ".join(f"CAST(bit_count(xor(a.w[{k}], b.w[{k}])) AS INTEGER)" for k in (1, 2, 3, 4)) + ")"


def wide_prints(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Fingerprints of four words, and errors: every 89th item lacks a word."""
    above = lambda level: sign_word(F.transform("embedding", lambda x: x - F.lit(level).cast("float")))
    words = [above(level) for level in _LEVELS]
    given = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.when(F.col("vec_id") % 89 == 7, F.array(*words[:3])).otherwise(F.array(*words)).alias("words"))
    return join.from_arrays(given, "words", 4)


@query(f"SELECT 'link' AS kind, a, b, dist FROM ({_linked_sql(_WIDE, _WIDE_DIST, WIDE)}) UNION ALL SELECT 'error', vec_id, vec_id, 3 FROM embeddings WHERE vec_id % 89 = 7")
def wide_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of fingerprints of four words; those of another length are rows of their own id, twice, and their number of words."""
    found, errors = wide_prints(spark, sf_dir)
    links = join.linked_kinds(found, WIDE).select(F.lit("link").alias("kind"), "a", "b", "dist")
    return links.unionAll(errors.select(F.lit("error"), "id", "id", "words"))


@query(f"WITH RECURSIVE {_GROUPS.replace(_EDGES, f'{_WIDE}, e AS (SELECT a.id AS a, b.id AS b, {_WIDE_DIST} AS dist FROM p a JOIN p b ON a.id < b.id AND {_WIDE_DIST} < {WIDE})')} SELECT group_id, seed, CAST(ord AS INTEGER) AS ord, id, dist FROM m")
def wide_group_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of fingerprints of four words."""
    return groups.members_of(wide_prints(spark, sf_dir)[0], WIDE)


@query(f"WITH {_EDGES} SELECT dist, count(*) AS pairs FROM e GROUP BY dist")
def hamming_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join.pair_counts(prints(spark, sf_dir), T)


@query(f"WITH {_EDGES} SELECT t AS threshold, CAST(count(*) AS BIGINT) AS pairs FROM e JOIN (VALUES (18), (20), (22)) x(t) ON dist < t GROUP BY t")
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = join.pair_counts(prints(spark, sf_dir), T)
    return pairs.withColumn("threshold", F.explode(F.array(F.lit(18), F.lit(20), F.lit(22)))).where("dist < threshold").groupBy("threshold").agg(F.sum("pairs").alias("pairs"))


def _search_sql(alone: str) -> str:
    return f"""WITH {_PRINTS}, q AS (SELECT w, min(id) AS id FROM p WHERE id % 20 = 0 GROUP BY w), k AS (SELECT w, min(id) AS id, count(*) AS copies FROM p GROUP BY w)
        SELECT 'match' AS kind, a.id AS a, b.id AS b, {_DIST} AS dist FROM q a JOIN k b ON {_DIST} < {T} AND (a.w <> b.w OR {alone})
        UNION ALL SELECT 'query', q.id, p.id, 0 FROM p JOIN q USING (w) WHERE p.id % 20 = 0 AND p.id <> q.id
        UNION ALL SELECT 'copy', k.id, p.id, 0 FROM p JOIN k USING (w) WHERE p.id <> k.id"""


@query(_search_sql("b.copies > 1"))
def compare_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every twentieth item as a target, against all others."""
    p = prints(spark, sf_dir)
    return join.search(p.where("id % 20 = 0"), p, T)


@query(_search_sql("true"))
def compare_relisted_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same where targets are listed among the files, which match themselves then."""
    p = prints(spark, sf_dir)
    return join.search(p.where("id % 20 = 0"), p, T, listed=True)


@query(f"WITH {_PRINTS} SELECT query, rank, id, dist FROM (SELECT a.id AS query, b.id AS id, {_DIST} AS dist, row_number() OVER (PARTITION BY a.id ORDER BY bit_count(xor(a.w, b.w)), b.id) AS rank FROM p a JOIN p b ON a.id % 20 = 0 AND a.id <> b.id) WHERE rank <= 10")
def knn_hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest items of every twentieth one."""
    p = prints(spark, sf_dir)
    return nearest.nearest(p.where("id % 20 = 0"), p, 10)


@query(_linked_sql(f"p AS (SELECT vec_id AS id, {_FP.format('x')} & 16777215 AS w FROM embeddings)", _DIST, 5))
def pivot_join_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of fingerprints of 24 bits, by visits to the rings of pivots."""
    return pivots.linked_by_pivots(prints(spark, sf_dir).withColumn("w0", F.col("w0").bitwiseAND(F.lit((1 << 24) - 1).cast("long"))), 5)


@query("SELECT place, x AS value FROM (SELECT list_sort(list(x)) AS s FROM (SELECT CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)) CROSS JOIN (SELECT unnest(['least', 'lower quarter', 'upper median', 'last hundredth', 'greatest']) AS place, unnest([0, 25, 50, 99, 100]) AS q) CROSS JOIN LATERAL (SELECT s[1 + least(len(s) - 1, len(s) * q // 100)] AS x)")
def order_statistics_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact places of the order of all elements of all vectors."""
    values = table(spark, sf_dir, "embeddings").select(F.explode("embedding").alias("x")).select(F.col("x").cast("double")).dropna()
    words = kept(values.select(selection.ordered_word(values, "x").alias("w")), "ordered-words")
    n = words.count()
    rows = [(name, selection.value_of_bits(selection.key_at(words, ["w"], min(n - 1, n * q // 100))[0])) for name, q in PLACES.items()] if n else []
    return spark.createDataFrame(rows, "place string, value double")


@query(f"WITH {_PRINTS}, d AS (SELECT p.id, CAST(bit_count(xor(p.w, v.w)) AS INTEGER) AS dist FROM p JOIN p v ON v.id = 0 AND p.id <> 0), m AS (SELECT list_sort(list(dist))[1 + count(*) // 2] AS middle FROM d) SELECT id, dist, dist < middle AS left FROM d, m")
def vantage_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items on either side of the middle distance to the first one, as a node of a metric tree parts them."""
    p = prints(spark, sf_dir)
    at = p.where("id = 0").agg(F.first("w0")).first()[0]
    d = kept(p.where("id <> 0").select("id", hamming(F.col("w0"), F.lit(at).cast("long")).alias("dist")), "vantage")
    middle = selection.value_at(d, "dist", d.count() // 2)
    return d.withColumn("left", F.col("dist") < F.lit(middle))


@query(f"WITH RECURSIVE {_GROUPS} SELECT group_id, seed, array_to_string(list(id ORDER BY ord), ',') AS members FROM m GROUP BY group_id, seed")
def dup_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = groups.groups(_members(spark, sf_dir))
    return g.select("group_id", "seed", F.array_join(F.col("members").cast("array<string>"), ",").alias("members"))


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.members_of(prints(spark, sf_dir), T)


@query(f"WITH RECURSIVE {_GROUPS} SELECT group_id, seed, CAST(ord AS INTEGER) AS ord, id, dist FROM m")
def dup_group_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _members(spark, sf_dir)


@query(f"WITH RECURSIVE {_GROUPS} SELECT count(*) AS total FROM m")
def dup_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.total(_members(spark, sf_dir))


@query(f"WITH {_EDGES} SELECT a AS id FROM e UNION SELECT b FROM e")
def dup_union_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _members(spark, sf_dir).select("id").distinct()


def _paths(members: DataFrame) -> DataFrame:
    """Stand-in paths of items, some of which need quoting."""
    folder = F.when(F.col("id") % 3 == 0, "a, b").when(F.col("id") % 3 == 1, 'the "best"').otherwise("plain")
    return members.withColumn("path", F.concat(F.lit("/img/"), folder, F.lit("/"), F.col("id").cast("string"), F.lit(".png")))


_PATH = "'/img/' || CASE id % 3 WHEN 0 THEN 'a, b' WHEN 1 THEN 'the \"best\"' ELSE 'plain' END || '/' || id || '.png'"


@query(f"WITH RECURSIVE {_GROUPS} SELECT DISTINCT {_PATH} AS path FROM m WHERE ord > 0 AND id NOT IN (SELECT seed FROM s)")
def delete_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.delete_plan(_paths(_members(spark, sf_dir)))


@query(f"WITH RECURSIVE {_GROUPS} SELECT group_id, {_PATH} AS source, '/dups/group' || group_id || '/' || id || '.png' AS target FROM m")
def move_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.move_plan(_paths(_members(spark, sf_dir)), "/dups")


@query(f"""WITH RECURSIVE {_GROUPS}, f AS (SELECT group_id, ord, {_PATH} AS path FROM m)
    SELECT group_id, string_agg(CASE WHEN path LIKE '%,%' OR path LIKE '%"%' THEN '"' || replace(path, '"', '""') || '"' ELSE path END, ',' ORDER BY ord) AS value FROM f GROUP BY group_id""")
def csv_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _paths(_members(spark, sf_dir)).groupBy("group_id").agg(F.sort_array(F.collect_list(F.struct("ord", "path"))).alias("m"))
    return sinks.csv_rows(g.select("group_id", F.transform("m", lambda x: x["path"]).alias("paths")))


@query("SELECT page_id, regexp_extract(u, '(\\.[^./]*)$', 1) AS ext, regexp_extract(u, '(\\.[^./]*)$', 1) IN ('.png', '.jpg', '.jpeg') AS image FROM (SELECT page_id, url || CASE page_id % 4 WHEN 0 THEN '.png' WHEN 1 THEN '.JPG' WHEN 2 THEN '.jpeg' ELSE '' END AS u FROM pages)")
def ext_filter_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id") % 4
    u = F.concat("url", F.when(k == 0, ".png").when(k == 1, ".JPG").when(k == 2, ".jpeg").otherwise(""))
    return table(spark, sf_dir, "pages").select("page_id", extension(u).alias("ext"), is_image(u).alias("image"))


@query("SELECT page_id, string_split(url, '/')[-1] AS base FROM pages")
def basename_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", base_name(F.col("url")).alias("base"))


@query("SELECT doc_id, count(*) AS parts, count(DISTINCT w) AS kinds FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS w FROM documents) WHERE w <> '' GROUP BY doc_id")
def stdin_split_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "documents").select("doc_id", F.explode(listed_paths(F.col("text"))).alias("w"))
    return words.groupBy("doc_id").agg(F.count("*").alias("parts"), F.countDistinct("w").alias("kinds"))


@query("SELECT url AS path, row_number() OVER (ORDER BY page_id) AS file_id FROM pages")
def file_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numbered(table(spark, sf_dir, "pages").select("page_id", "url"), "page_id", "file_id", 1).select(F.col("url").alias("path"), "file_id")


def _pixels():
    return F.transform("embedding", lambda e: clamp_byte(F.floor((e + F.lit(1.0).cast("float")).cast("double") * 127.5)))


_PX = "CAST(least(255, greatest(0, trunc(floor(CAST(x + CAST(1 AS FLOAT) AS DOUBLE) * 127.5) + 0.5))) AS BIGINT)"


@query(f"SELECT vec_id, i - 1 AS pixel, 0.299::DOUBLE * (257 * px) + 0.587::DOUBLE * (257 * px) + 0.114::DOUBLE * (257 * px) AS grey FROM (SELECT vec_id, unnest(list_transform(embedding, lambda x: {_PX})) AS px, unnest(range(1, 65)) AS i FROM embeddings)")
def grey_r8(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(_pixels()).alias("pixel", "px"))
    return p.select("vec_id", F.col("pixel").cast("long").alias("pixel"), grey(F.col("px"), F.col("px"), F.col("px"), F.lit(255)).alias("grey"))


def _rasters(px: pd.Series, side: int) -> np.ndarray:
    """Opaque grey rasters (n, side, side, 4) of a batch's pixels."""
    out = np.full((len(px), side, side, 4), 255, np.uint8)
    if len(px):
        out[..., :3] = np.stack(px.to_numpy()).reshape(-1, side, side)[..., None]
    return out


def _resized(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    f = raster.FILTERS[name]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                small = raster.resize(_rasters(frame["px"], 8), 9, 9, f)[..., 0].astype(np.int64)
                yield pd.DataFrame({"vec_id": np.repeat(frame["vec_id"].to_numpy(), 81), "pixel": np.tile(np.arange(81), len(frame)), "value": small.ravel()})

    return table(spark, sf_dir, "embeddings").select("vec_id", _pixels().alias("px")).mapInPandas(run, "vec_id long, pixel long, value long")


def _in_order(x: str) -> str:
    """A sum from the first source pixel to the last: halves round by the last bit."""
    return f"list_reduce(list({x} ORDER BY s), lambda p, q: p + q, 0.0::DOUBLE)"


_PX8 = f"SELECT vec_id AS id, (i - 1) // 8 AS y, (i - 1) % 8 AS x, v FROM (SELECT vec_id, unnest(list_transform(embedding, lambda x: {_PX})) AS v, unnest(range(1, 65)) AS i FROM embeddings)"


def _grey_sql(name: str, side: int, px: str) -> str:
    """Opaque grey pixels px (id, y, x, v) reduced or enlarged to 9 x 9: (id, y, x, v)."""
    rows = ", ".join(f"({v}, {u}, {w!r}::DOUBLE)" for v, r in enumerate(raster.taps(9, side, raster.FILTERS[name])) for u, w in r)
    round_ = f"CAST(least(255, greatest(0, trunc({_in_order('v * (255 * w)')} * (1 / {_in_order('255 * w')}) + 0.5))) AS BIGINT)"
    return f"""w(d, s, w) AS (VALUES {rows}), px AS ({px}), h AS (SELECT id, y, d AS x, {round_} AS v FROM px JOIN w ON s = x GROUP BY id, y, d),
        small AS (SELECT id, d AS y, x, {round_} AS v FROM h JOIN w ON s = y GROUP BY id, d, x)"""


def _gradients_sql(of: str) -> str:
    """Row and column words of 9 x 9 values (id, y, x, v): (id, w0, w1)."""
    return f"""u AS (SELECT l.id, 0 AS k, l.y, l.x, l.v < r.v AS darker FROM {of} l JOIN {of} r ON r.id = l.id AND r.y = l.y AND r.x = l.x + 1 WHERE l.y < 8
        UNION ALL SELECT l.id, 1, l.y, l.x, l.v < r.v FROM {of} l JOIN {of} r ON r.id = l.id AND r.y = l.y + 1 AND r.x = l.x WHERE l.x < 8),
        bits AS (SELECT id, k, CAST(CAST(string_agg(CASE WHEN darker THEN '1' ELSE '0' END, '' ORDER BY 8 * y + x DESC) AS BIT) AS BIGINT) AS word FROM u GROUP BY id, k),
        gradients AS (SELECT id, max(word) FILTER (WHERE k = 0) AS w0, max(word) FILTER (WHERE k = 1) AS w1 FROM bits GROUP BY id)"""


for _name in ("linear", "box"):
    _f = lambda spark, sf_dir, n=_name: _resized(spark, sf_dir, n)
    _f.__name__ = f"resize_r8_9x9_{_name}"
    query(f"WITH {_grey_sql(_name, 8, _PX8)} SELECT id AS vec_id, y * 9 + x AS pixel, v AS value FROM small")(_f)


@query(f"""WITH px AS (SELECT vec_id, (i - 1) // 8 AS y, (i - 1) % 8 AS x, v FROM (SELECT vec_id, unnest(list_transform(embedding, lambda x: {_PX})) AS v, unnest(range(1, 65)) AS i FROM embeddings)),
    n AS (SELECT d, CAST(floor((d + 0.5::DOUBLE) * (8.0::DOUBLE / 9)) AS BIGINT) AS s FROM range(9) t(d))
    SELECT vec_id, a.d * 9 + b.d AS pixel, v AS value FROM px JOIN n a ON a.s = y JOIN n b ON b.s = x""")
def resize_r8_9x9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resized(spark, sf_dir, "nearest")


def _hash_rows(name: str, side: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            words = raster.words_of_all(name, _rasters(frame["px"], side)) if len(frame) else []
            if words:
                yield pd.DataFrame({"id": frame["id"].to_numpy()} | {f"w{k}": w for k, w in enumerate(words)})

    return run


@query(f"WITH {_grey_sql('linear', 8, _PX8)}, {_gradients_sql('small')} SELECT * FROM gradients")
def dhash_r8(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), _pixels().alias("px"))
    return e.mapInPandas(_hash_rows("dhash", 8), "id long, w0 long, w1 long")


def _rgba16(spark: SparkSession, sf_dir: str) -> DataFrame:
    """16 x 16 pixels of four channels from the vectors of sixteen ids; what is missing is 0, so transparent."""
    return _r32(spark, sf_dir)


def _rgba(frame: pd.DataFrame) -> np.ndarray:
    return np.stack(frame["px"].to_numpy()).astype(np.uint8).reshape(-1, 16, 16, 4)


def _reduced(names: list[str]):
    """(filter, id, y, x, r, g, b, a) of all rasters of a batch reduced to 9 x 9 by each filter."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name in names if len(frame) else []:
                small = raster.resize(_rgba(frame), 9, 9, raster.FILTERS[name]).reshape(-1, 4).astype(np.int64)
                place = np.tile(np.arange(81), len(frame))
                yield pd.DataFrame({"filter": name, "id": np.repeat(frame["id"].to_numpy(), 81), "y": place // 9, "x": place % 9} | {c: small[:, k] for k, c in enumerate("rgba")})

    return run


def _reduced_sql(names: list[str]) -> str:
    """Both passes from 16 to 9, colours weighed by alpha, bytes between: (f, id, y, x, r, g, b, a)."""
    rows = ", ".join(f"('{n}', {v}, {u}, {w!r}::DOUBLE)" for n in names for v, r in enumerate(raster.taps(9, 16, raster.FILTERS[n])) for u, w in r)
    byte = lambda x: f"CAST(least(255, greatest(0, trunc({x} + 0.5))) AS BIGINT)"
    added = _in_order
    mixed = lambda c: f"CASE WHEN {added('a * w')} = 0 THEN 0 ELSE {byte(added(f'{c} * (a * w)') + ' * (1 / ' + added('a * w') + ')')} END AS {c}"
    sums = ", ".join(mixed(c) for c in "rgb") + f", CASE WHEN {added('a * w')} = 0 THEN 0 ELSE {byte(added('a * w'))} END AS a"
    channel = lambda k, c: f"max(v) FILTER (WHERE spot % 4 = {k}) AS {c}"
    return f"""taps(f, d, s, w) AS (VALUES {rows}), px AS (SELECT vec_id // 16 AS id, (vec_id % 16) * 64 + i - 1 AS spot, v FROM (SELECT vec_id, unnest(list_transform(embedding, lambda x: {_PX})) AS v, unnest(range(1, 65)) AS i FROM embeddings)),
        rgba AS (SELECT id, spot // 64 AS y, spot // 4 % 16 AS x, {", ".join(channel(k, c) for k, c in enumerate("rgba"))} FROM px GROUP BY id, spot // 64, spot // 4 % 16),
        h AS (SELECT f, id, y, d AS x, {sums} FROM rgba JOIN taps ON s = x GROUP BY f, id, y, d),
        v AS (SELECT h.f, id, d AS y, x, {sums} FROM h JOIN taps ON s = y AND taps.f = h.f GROUP BY h.f, id, d, x),
        spots AS (SELECT f, id, y, x FROM (SELECT DISTINCT id FROM px) CROSS JOIN (SELECT DISTINCT f FROM taps) CROSS JOIN range(9) a(y) CROSS JOIN range(9) b(x))"""


_REDUCED_ROWS = "SELECT {f} id, y, x, coalesce(r, 0) AS r, coalesce(g, 0) AS g, coalesce(b, 0) AS b, coalesce(a, 0) AS a FROM spots LEFT JOIN v USING (f, id, y, x)"
_REDUCED = "filter string, id long, y long, x long, r long, g long, b long, a long"
for _name in ("linear", "box", "lanczos"):
    _f = lambda spark, sf_dir, n=_name: _rgba16(spark, sf_dir).mapInPandas(_reduced([n]), _REDUCED).drop("filter")
    _f.__name__ = f"resize_rgba16_9x9_{_name}"
    query(f"WITH {_reduced_sql([_name])} {_REDUCED_ROWS.format(f='')}")(_f)
OTHER_FILTERS = [n for n, f in raster.FILTERS.items() if f.support > 0 and n not in ("linear", "box", "lanczos")]


@query(f"WITH {_reduced_sql(OTHER_FILTERS)} {_REDUCED_ROWS.format(f='f AS filter,')}")
def resize_rgba16_9x9_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by each of the other filters."""
    return _rgba16(spark, sf_dir).mapInPandas(_reduced(OTHER_FILTERS), _REDUCED)


_GREYS = "0.299::DOUBLE * (257 * r * a // 255) + 0.587::DOUBLE * (257 * g * a // 255) + 0.114::DOUBLE * (257 * b * a // 255)"


@query(f"""WITH {_reduced_sql(["linear"])}, every AS (SELECT id, y, x, coalesce({_GREYS}, 0) AS v FROM spots LEFT JOIN v USING (f, id, y, x)),
    {_gradients_sql("every")} SELECT * FROM gradients""")
def dhash_rgba16(spark: SparkSession, sf_dir: str) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                w0, w1 = raster.words_of_all("dhash", _rgba(frame))
                yield pd.DataFrame({"id": frame["id"].to_numpy(), "w0": w0, "w1": w1})

    return _rgba16(spark, sf_dir).mapInPandas(run, "id long, w0 long, w1 long")


def _r32(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 16).alias("id"), "vec_id", _pixels().alias("px"))
    g = e.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("vec_id", "px"))).alias("m"))
    px = F.flatten(F.transform("m", lambda x: x["px"]))
    return g.select("id", F.concat(px, F.array_repeat(F.lit(0), 1024 - F.size(px))).alias("px"))


_COEFFICIENTS = f"""px AS (SELECT vec_id // 16 AS id, (vec_id % 16) * 64 + i - 1 AS spot, v FROM (SELECT vec_id, unnest(list_transform(embedding, lambda x: {_PX})) AS v, unnest(range(1, 65)) AS i FROM embeddings)),
    g AS (SELECT i.id, n // 32 AS y, n % 32 AS x, 0.299::DOUBLE * (257 * coalesce(px.v, 0)) + 0.587::DOUBLE * (257 * coalesce(px.v, 0)) + 0.114::DOUBLE * (257 * coalesce(px.v, 0)) AS v
        FROM (SELECT DISTINCT id FROM px) i CROSS JOIN range(1024) r(n) LEFT JOIN px ON px.id = i.id AND px.spot = n),
    k AS (SELECT u, v, x, y, cos((2 * x + 1) * u / 64.0::DOUBLE * pi()) * cos((2 * y + 1) * v / 64.0::DOUBLE * pi()) AS c FROM range(1, 9) a(u), range(1, 9) b(v), range(32) d(x), range(32) f(y)),
    c AS (SELECT id, k.u, k.v, 0.25 * sum(k.c * g.v) AS f FROM g JOIN k USING (x, y) GROUP BY id, k.u, k.v)"""


@query(f"WITH {_COEFFICIENTS} SELECT id, (u - 1) * 8 + v - 1 AS n, round(f, 3) AS f FROM c")
def dct_coeffs_r32(spark: SparkSession, sf_dir: str) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                f = raster.cosine_coefficients(_rasters(frame["px"], 32))
                yield pd.DataFrame({"id": np.repeat(frame["id"].to_numpy(), 64), "n": np.tile(np.arange(64), len(frame)), "f": f.ravel()})

    return _r32(spark, sf_dir).mapInPandas(run, "id long, n long, f double").withColumn("f", F.round("f", 3))


@query(f"""WITH {_COEFFICIENTS}, m AS (SELECT id, list(f ORDER BY f)[33] AS median FROM c GROUP BY id)
    SELECT id, CAST(CAST(string_agg(CASE WHEN f > median THEN '1' ELSE '0' END, '' ORDER BY (u - 1) * 8 + v - 1 DESC) AS BIT) AS BIGINT) AS w0 FROM c JOIN m USING (id) GROUP BY id""")
def dct_hash_r32(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r32(spark, sf_dir).mapInPandas(_hash_rows("dct", 32), "id long, w0 long")


def _weight_rows() -> list[tuple[str, int, int, float]]:
    return [(f.name, v, u, w) for f in raster.FILTERS.values() if f.support > 0 for v, r in enumerate(raster.taps(9, 32, f)) for u, w in r]


_KERNELS = {
    "box": (0.5, "CASE WHEN x <= 0.5 THEN 1.0 ELSE 0 END"),
    "linear": (1, "1 - x"),
    "hermite": (1, "2 * x ** 3 - 3 * x ** 2 + 1"),
    "gaussian": (2, "exp(-2 * x * x)"),
    "bartlett": (3, "sinc * (3 - x) / 3"),
    "hann": (3, "sinc * (0.5 + 0.5 * cos(pi() * x / 3))"),
    "hamming": (3, "sinc * (0.54 + 0.46 * cos(pi() * x / 3))"),
    "welch": (3, "sinc * (1 - x * x / 9)"),
    "cosine": (3, "sinc * cos(pi() / 2 * (x / 3))"),
    "lanczos": (3, "sinc * CASE WHEN x = 0 THEN 1 ELSE sin(pi() * x / 3) / (pi() * x / 3) END"),
    "blackman": (3, "sinc * (0.42 - 0.5 * cos(pi() * x / 3 + pi()) + 0.08 * cos(2 * pi() * x / 3))"),
    "bspline": (2, "CASE WHEN x < 1 THEN (3 * x ** 3 - 6 * x ** 2 + 4) / 6 ELSE (-x ** 3 + 6 * x ** 2 - 12 * x + 8) / 6 END"),
    "catmullrom": (2, "CASE WHEN x < 1 THEN (9 * x ** 3 - 15 * x ** 2 + 6) / 6 ELSE (-3 * x ** 3 + 15 * x ** 2 - 24 * x + 12) / 6 END"),
    "mitchell": (2, "CASE WHEN x < 1 THEN (7 * x ** 3 - 12 * x ** 2 + 16.0 / 3) / 6 ELSE (-7.0 / 3 * x ** 3 + 12 * x ** 2 - 20 * x + 32.0 / 3) / 6 END"),
}


@query("WITH t AS (SELECT v, u, (v + 0.5::DOUBLE) * (32.0::DOUBLE / 9) - 0.5 AS c FROM range(9) a(v), range(32) b(u)), " + "r AS (" + " UNION ALL ".join(f"SELECT '{n}' AS filter, v, u, CASE WHEN x {'<=' if n == 'box' else '<'} {s} THEN {k} ELSE 0 END AS w FROM (SELECT v, u, x, CASE WHEN x = 0 THEN 1 ELSE sin(pi() * x) / (pi() * x) END AS sinc FROM (SELECT v, u, CAST(abs(u - c) / (32.0 / 9) AS DOUBLE) AS x FROM t))" for n, (s, k) in _KERNELS.items()) + "), seen AS (SELECT (i - 1) % 32 AS u, sum(v) AS pixels FROM (SELECT unnest(list_transform(embedding, lambda x: " + _PX + ")) AS v, unnest(range(1, 65)) AS i FROM embeddings) GROUP BY 1) SELECT filter, v AS dst, u AS src, round(w / sum(w) OVER (PARTITION BY filter, v), 9) AS weight, CAST(coalesce(pixels, 0) AS BIGINT) AS pixels FROM r LEFT JOIN seen USING (u) WHERE w <> 0")
def filter_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights by which each filter reduces 32 columns to 9, with the sum of what each weighs: its column's pixels in all rasters."""
    rows = spark.createDataFrame(_weight_rows(), "filter string, dst long, src long, weight double")
    spots = table(spark, sf_dir, "embeddings").select(F.posexplode(_pixels()).alias("spot", "v"))
    seen = spots.groupBy((F.col("spot") % 32).cast("long").alias("src")).agg(F.sum("v").cast("long").alias("pixels"))  # 32 rows at most
    return rows.join(F.broadcast(seen), "src", "left").select("filter", "dst", "src", F.round("weight", 9).alias("weight"), F.coalesce("pixels", F.lit(0).cast("long")).alias("pixels"))


@query(f"WITH {_PRINTS} SELECT id, CAST(bit_count(w) AS INTEGER) AS bits, CAST(bit_count(xor(w, CAST(0 AS BIGINT))) AS INTEGER) AS from_zero FROM p")
def popcounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prints(spark, sf_dir).select("id", popcount(F.col("w0")).alias("bits"), hamming(F.col("w0"), F.lit(0).cast("long")).alias("from_zero"))


def _by_name(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for name in ("dct", "dhash", "other") if len(frame) else ():
            words = raster.words_of_all(name, _rasters(frame["px"], 32))
            out = pd.DataFrame({"id": frame["id"].to_numpy(), "name": name, "words": len(words), "w0": 0, "w1": 0})
            for k, w in enumerate(words):
                out[f"w{k}"] = w
            yield out


_PX32 = "SELECT i.id, n // 32 AS y, n % 32 AS x, coalesce(p.v, 0) AS v FROM (SELECT DISTINCT vec_id // 16 AS id FROM embeddings) i CROSS JOIN range(1024) r(n) LEFT JOIN (SELECT vec_id // 16 AS id, (vec_id % 16) * 64 + i - 1 AS spot, v FROM (SELECT vec_id, unnest(list_transform(embedding, lambda x: " + _PX + ")) AS v, unnest(range(1, 65)) AS i FROM embeddings)) p ON p.id = i.id AND p.spot = n"


@query(f"""WITH dct AS ({ORACLE_SQL["dct_hash_r32"]}), {_grey_sql("linear", 32, _PX32)}, {_gradients_sql("small")}
    SELECT id, 'dct' AS name, 1 AS words, w0, 0 AS w1 FROM dct UNION ALL SELECT id, 'dhash', 2, w0, w1 FROM gradients UNION ALL SELECT id, 'other', 0, 0, 0 FROM dct""")
def hash_by_name_r32(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes by name of rasters that are reduced for one of them; words that a hash doesn't have are 0."""
    return _r32(spark, sf_dir).mapInPandas(_by_name, "id long, name string, words int, w0 long, w1 long")


@query(f"""WITH {_PRINTS}, {_P2.replace('p AS', 'p2 AS', 1)}, found AS (
        SELECT 1 AS words, count(*) AS pairs FROM p a JOIN p b ON a.id < b.id AND bit_count(xor(a.w, b.w)) < 22
        UNION ALL SELECT 2, count(*) FROM p2 a JOIN p2 b ON a.id < b.id AND bit_count(xor(a.w.w, b.w.w)) + bit_count(xor(a.w.v, b.w.v)) < 10)
    SELECT t.*, CAST(pairs AS BIGINT) AS pairs FROM (VALUES ('dct', 22.0::DOUBLE, 1, 30.0::DOUBLE, true), ('dhash', 10.0::DOUBLE, 2, 30.0::DOUBLE, true), ('other', 22.0::DOUBLE, 1, 30.0::DOUBLE, true)) t(name, threshold, words, given, same) JOIN found USING (words)""")
def hash_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of hashes by name, an unknown one too: thresholds, words, a threshold that is given, equality by name alone, and
    how many pairs of fingerprints of so many words match at the kind's threshold."""
    found = {name: spec_named(name) for name in [*sorted(SPECS), "other"]}
    rows = spark.createDataFrame([(n, s.threshold, s.words, s.with_threshold(30).threshold, s == s.with_threshold(30) and s.with_threshold(0) == s) for n, s in found.items()], "name string, threshold double, words int, given double, same boolean")
    dct, dhash = (join.pair_counts(prints(spark, sf_dir, two=s.words == 2), int(s.threshold)).select(F.lit(s.words).alias("words"), "pairs") for s in (SPECS["dct"], SPECS["dhash"]))
    counts = dct.unionAll(dhash).groupBy("words").agg(F.sum("pairs").alias("pairs"))  # two rows at most
    return rows.join(F.broadcast(counts), "words", "left").withColumn("pairs", F.coalesce("pairs", F.lit(0).cast("long")))


@query(f"WITH RECURSIVE {_GROUPS} SELECT CASE WHEN count(*) = 0 THEN 'No duplicate images found' ELSE 'These ' || count(*) || ' images are duplicates' END AS line FROM m")
def summary_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dup_total(spark, sf_dir).select(sinks.summary_line(F.col("total")).alias("line"))


@query(f"WITH RECURSIVE {_GROUPS} SELECT group_id, ord, p.url AS path FROM m JOIN (SELECT url, row_number() OVER (ORDER BY page_id) - 1 AS n FROM pages) p ON p.n = m.id")
def ids_to_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members' ids back to the paths that were numbered."""
    paths = numbered(table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("path")), "page_id", "id")
    return _members(spark, sf_dir).join(paths, "id").select("group_id", F.col("ord").cast("long").alias("ord"), "path")


_KINDS = ("grey", "grey16", "rgb", "rgba", "palette", "laced")


def _png_rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = []
        for i, px in zip(frame["vec_id"], frame["px"], strict=True):
            a = _rasters(pd.Series([px]), 8)[0]
            a[..., 3] = a[..., 0]
            for kind in _KINDS:
                back = png.decode(png.encode(a, kind)).astype(np.int64)
                rows.append((i, kind, *(int((back[..., k] * np.arange(64).reshape(8, 8)).sum()) for k in (0, 2, 3))))
        yield pd.DataFrame(rows, columns=["vec_id", "kind", "red", "blue", "alpha"])


@query(f"""WITH p AS (SELECT vec_id, sum(v * n) AS s FROM (SELECT vec_id, unnest(list_transform(embedding, lambda x: {_PX})) AS v, unnest(range(64)) AS n FROM embeddings) GROUP BY vec_id)
    SELECT vec_id, kind, CAST(s AS BIGINT) AS red, CAST(s AS BIGINT) AS blue, CAST(CASE WHEN kind IN ('rgba', 'laced') THEN s ELSE 255 * 2016 END AS BIGINT) AS alpha FROM p CROSS JOIN (VALUES {", ".join(f"('{k}')" for k in _KINDS)}) k(kind)""")
def png_kinds_r8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels through files of every kind, weighed by their place."""
    return table(spark, sf_dir, "embeddings").select("vec_id", _pixels().alias("px")).mapInPandas(_png_rows, "vec_id long, kind string, red long, blue long, alpha long")


def _png_files(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        files_ = [png.encode(a) for a in _rasters(frame["px"], 8)]
        yield pd.DataFrame({"id": frame["vec_id"], "path": [f"/img/{i}.png" for i in frame["vec_id"]], "content": [f[: len(f) // 2] if i % 5 == 0 else f for i, f in zip(frame["vec_id"], files_, strict=True)]})


@query("SELECT vec_id AS id, '/img/' || vec_id || '.png' AS path, vec_id % 5 = 0 AS failed FROM embeddings")
def load_errors_r8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of which every fifth is cut off: those are errors and stop nothing else."""
    made = table(spark, sf_dir, "embeddings").select("vec_id", _pixels().alias("px")).mapInPandas(_png_files, "id long, path string, content binary")
    prints_, errors = fingerprints(made, DHASH)
    return prints_.select("id", "path", F.lit(False).alias("failed")).unionAll(errors.where(F.col("error").startswith("unable to load")).select("id", "path", F.lit(True)))


_BYTES = f"SELECT vec_id, list_transform(embedding, lambda x: {_PX}) AS b FROM embeddings"


@query(f"""WITH e AS (SELECT vec_id, unnest(range(16)) AS pixel, b, CASE vec_id % 7 WHEN 0 THEN 0 WHEN 1 THEN 255 END AS fixed FROM ({_BYTES})),
    q AS (SELECT vec_id, pixel, coalesce(fixed, b[4 * pixel + 4]) AS a, b[4 * pixel + 1] AS r, b[4 * pixel + 2] AS g, b[4 * pixel + 3] AS bl FROM e),
    m AS (SELECT vec_id, pixel, a, r * a // 255 AS r, g * a // 255 AS g, bl * a // 255 AS b FROM q)
    SELECT vec_id, CAST(pixel AS BIGINT) AS pixel, a, {", ".join(f"CASE WHEN a = 0 THEN 0 ELSE {c} * 255 // a END AS {c}" for c in "rgb")} FROM m""")
def unpremultiplied_rgba8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen pixels a vector whose colours were multiplied by alpha, divided by it again."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", _pixels().alias("b")).select("vec_id", "b", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("pixel"))
    at = lambda k: F.element_at("b", 4 * F.col("pixel") + k)
    alpha = F.when(F.col("vec_id") % 7 == 0, 0).when(F.col("vec_id") % 7 == 1, 255).otherwise(at(4))
    q = e.select("vec_id", "pixel", alpha.alias("a"), *(at(k).alias(c) for k, c in enumerate("rgb", 1)))
    m = q.select("vec_id", "pixel", "a", *(F.expr(f"{c} * a div 255").alias(c) for c in "rgb"))
    return m.select("vec_id", F.col("pixel").cast("long").alias("pixel"), F.col("a").cast("long").alias("a"), *(planes.unpremultiplied(F.col(c), F.col("a")).cast("long").alias(c) for c in "rgb"))


@query(f"""WITH e AS (SELECT vec_id, unnest(range(8)) AS pixel, b, CASE vec_id % 7 WHEN 0 THEN 0 WHEN 1 THEN 255 END AS fixed FROM ({_BYTES})),
    q AS (SELECT vec_id, pixel, coalesce(fixed, b[8 * pixel + 7]) * 256 + b[8 * pixel + 8] AS a, b[8 * pixel + 1] * 256 + b[8 * pixel + 2] AS r, b[8 * pixel + 3] * 256 + b[8 * pixel + 4] AS g, b[8 * pixel + 5] * 256 + b[8 * pixel + 6] AS bl FROM e),
    m AS (SELECT vec_id, pixel, a, r * a // 65535 AS r, g * a // 65535 AS g, bl * a // 65535 AS b FROM q)
    SELECT vec_id, CAST(pixel AS BIGINT) AS pixel, a // 256 AS a, {", ".join(f"CASE a // 256 WHEN 0 THEN 0 WHEN 255 THEN {c} // 256 ELSE ({c} * 65535 // a) // 256 END AS {c}" for c in "rgb")} FROM m""")
def unpremultiplied_rgba16(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of eight pixels of 16-bit channels; alpha's high byte decides."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", _pixels().alias("b")).select("vec_id", "b", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("pixel"))
    at = lambda k: F.element_at("b", 8 * F.col("pixel") + k).cast("long")
    high = F.when(F.col("vec_id") % 7 == 0, 0).when(F.col("vec_id") % 7 == 1, 255).otherwise(at(7))
    q = e.select("vec_id", "pixel", (high * 256 + at(8)).alias("a"), *((at(2 * k + 1) * 256 + at(2 * k + 2)).alias(c) for k, c in enumerate("rgb")))
    m = q.select("vec_id", "pixel", "a", *(F.expr(f"{c} * a div 65535").alias(c) for c in "rgb"))
    return m.select("vec_id", F.col("pixel").cast("long").alias("pixel"), F.shiftright("a", 8).alias("a"), *(planes.unpremultiplied_wide(F.col(c), F.col("a")).cast("long").alias(c) for c in "rgb"))


_SCALED = {"r": "y * 65793 + 91881 * (cr - 128)", "g": "y * 65793 - 22554 * (cb - 128) - 46802 * (cr - 128)", "b": "y * 65793 + 116130 * (cb - 128)"}


@query(f"""WITH px AS (SELECT vec_id // 16 AS id, (vec_id % 16) * 64 + i AS spot, v FROM (SELECT vec_id, unnest(b) AS v, unnest(range(64)) AS i FROM ({_BYTES}))),
    every AS (SELECT id, list(coalesce(v, 0) ORDER BY spot) AS p FROM (SELECT i.id, s.spot, v FROM (SELECT DISTINCT id FROM px) i CROSS JOIN range(768) s(spot) LEFT JOIN px ON px.id = i.id AND px.spot = s.spot) GROUP BY id),
    ratios(ratio, wide, high) AS (VALUES {", ".join(f"('{r}', {w}, {h})" for r, (w, h) in planes.RATIOS.items())}),
    m AS (SELECT ratio, id, t.y AS py, u.x AS px, p[1 + 16 * t.y + u.x] AS y, p[257 + t.y // high * (16 // wide) + u.x // wide] AS cb, p[513 + t.y // high * (16 // wide) + u.x // wide] AS cr FROM every CROSS JOIN ratios CROSS JOIN range(16) t(y) CROSS JOIN range(16) u(x))
    SELECT ratio, id, py AS y, px AS x, {", ".join(f"CAST(least(255, greatest(0, ({x}) >> 16)) AS INTEGER) AS {c}" for c, x in _SCALED.items())} FROM m""")
def ycbcr_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen vectors as a luma plane of 16 x 16 and two chroma planes, which are smaller for most ratios."""
    spots = _r32(spark, sf_dir).select("id", F.posexplode("px").alias("spot", "v"))
    out = None
    for ratio, (wide, high) in planes.RATIOS.items():
        width, size = 16 // wide, 256 // (wide * high)
        place = lambda first, w: [((F.col("spot") - first) / w).cast("long").alias("y"), F.pmod(F.col("spot") - first, F.lit(w)).cast("long").alias("x")]
        luma = spots.where("spot < 256").select("id", *place(0, 16), "v")
        cb, cr = (spots.where(F.col("spot").between(k, k + size - 1)).select("id", *place(k, width), F.col("v").alias(c)) for k, c in ((256, "cb"), (512, "cr")))
        rows = planes.joined_planes(luma, cb.join(cr, ["id", "y", "x"]), ratio).select(F.lit(ratio).alias("ratio"), "*")
        out = rows if out is None else out.unionAll(rows)
    return out
