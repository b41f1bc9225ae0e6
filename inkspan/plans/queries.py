"""The registered queries over the harness tables, with their DuckDB SQL.

The tables hold no scans, so glyphs, boxes and pixels are derived from their
columns by integer arithmetic that both engines do alike: the queries hold the
operators' semantics, not recognition quality. Each reads whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkspan.functions import geometry as G
from inkspan.functions import text as T
from inkspan.operators import layout, metrics, raster, recognition, segment

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


WORDS = r"list_filter(string_split_regex({t}, '\s+'), lambda w: w <> '')"
NORMALISED = r"list_filter(list_transform(" + WORDS + r", lambda w: lower(regexp_replace(w, '^[^\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]+$', '', 'g'))), lambda w: w <> '')"


@query(f"""SELECT doc_id, len(w)::INT AS n_words, sha256(array_to_string(w, ' ')) AS words_sha
           FROM (SELECT doc_id, {NORMALISED.format(t="text")} AS w FROM documents)""")
def word_normalize(spark, sf_dir):
    w = T.normalised_words(F.col("text"))
    return read(spark, sf_dir, "documents").select("doc_id", F.size(w).alias("n_words"), F.sha2(F.array_join(w, " ").cast("binary"), 256).alias("words_sha"))


@query(r"""SELECT doc_id, length(t)::INT AS n_chars, len(w)::INT AS n_tokens, list_sum(list_transform(w, lambda x: length(x)))::BIGINT AS token_chars
           FROM (SELECT doc_id, trim(regexp_replace(lower(text), '[\p{Cc}\p{Z}]+', ' ', 'g')) AS t,
                        list_filter(list_transform(list_filter(string_split_regex(text, '\s+'), lambda w: w <> ''), lambda w: regexp_replace(w, '[^\p{L}\p{N}]+', '', 'g')), lambda w: w <> '') AS w
                 FROM documents)""")
def doc_tokenize_counts(spark, sf_dir):
    t, w = T.normalised_text(F.col("text")), T.tokens(F.col("text"))
    total = F.aggregate(F.transform(w, F.length), F.lit(0).cast("long"), lambda a, x: a + x)
    return read(spark, sf_dir, "documents").select("doc_id", F.length(t).alias("n_chars"), F.size(w).alias("n_tokens"), F.when(F.size(w) > 0, total).alias("token_chars"))


PAGED = r"""SELECT doc_id, line, (line // 43)::INT AS page, l AS text FROM (
    SELECT doc_id, unnest(k) AS l, unnest(range(len(k)))::INT AS line FROM (
        SELECT doc_id, list_filter(string_split(text, chr(10)), lambda t: NOT regexp_matches(t, '^\s*$') AND NOT regexp_matches(t, '[_=]{4,}') AND NOT regexp_matches(t, '^\[Illustration')) AS k FROM documents))"""


@query(f"SELECT doc_id, page, count(*) AS n_lines, sum(length(text))::BIGINT AS n_chars FROM ({PAGED}) GROUP BY ALL")
def paginate_lines(spark, sf_dir):
    lines = layout.page_lines(read(spark, sf_dir, "documents"))
    return lines.groupBy("doc_id", "page").agg(F.count("*").alias("n_lines"), F.sum(F.length("text")).alias("n_chars"))


@query(f"""SELECT doc_id, max(page) + 1 AS pages, sum(n) FILTER (page < 10)::BIGINT AS sampled,
                  CASE WHEN max(page) < 10 THEN sum(n)::BIGINT ELSE floor(sum(n) FILTER (page < 10) / 10::DOUBLE * (max(page) + 1))::BIGINT END AS estimate
           FROM (SELECT doc_id, page, len({WORDS.format(t="text")}) AS n FROM ({PAGED})) GROUP BY doc_id""")
def page_word_count_sampled(spark, sf_dir):
    lines = layout.page_lines(read(spark, sf_dir, "documents")).withColumn("n", F.size(T.words(F.col("text"))))
    pages, some = F.max("page") + 1, F.sum(F.when(F.col("page") < 10, F.col("n")))
    return lines.groupBy("doc_id").agg(pages.alias("pages"), some.alias("sampled")).withColumn("estimate", T.sampled_words(F.col("sampled"), F.col("pages")))


@query(f"""SELECT doc_id, page, length(t)::INT AS n_chars, sha256(t) AS page_sha FROM (
             SELECT doc_id, page, 'page ' || (page + 1) || chr(10) || '======' || chr(10) || string_agg(array_to_string({WORDS.format(t="text")}, ' ') || ' ', '' ORDER BY line) || chr(10) || chr(10) AS t
             FROM ({PAGED}) GROUP BY doc_id, page)""")
def text_sink_page(spark, sf_dir):
    from inkspan.sources.sinks import line_text

    lines = layout.page_lines(read(spark, sf_dir, "documents"))
    out = line_text(lines.select("doc_id", "page", "line", T.words(F.col("text")).alias("words")), ["doc_id", "page"])
    return out.select("doc_id", "page", F.length("text").alias("n_chars"), F.sha2(F.col("text").cast("binary"), 256).alias("page_sha"))


BOXES = f"""SELECT item_id, nth::INT AS nth, w AS word, (sum(length(w) + 1) OVER (PARTITION BY item_id ORDER BY nth) - length(w) - 1)::BIGINT * 7 AS x, (nth // 12)::BIGINT * 17 AS y, length(w)::BIGINT * 7 AS width, 11 AS height
            FROM (SELECT item_id, unnest(w) AS w, unnest(range(len(w))) AS nth FROM (SELECT item_id, {WORDS.format(t="text")} AS w FROM benchmark))"""


def _boxes(spark, sf_dir):
    """Monospaced word boxes of each benchmark text, twelve words a line."""
    words = read(spark, sf_dir, "benchmark").select("item_id", F.posexplode(T.words(F.col("text"))).alias("nth", "word"))
    wide = F.length("word").cast("long")
    run = F.sum(wide + 1).over(Window.partitionBy("item_id").orderBy("nth"))
    return words.select("item_id", "nth", "word", ((run - wide - 1) * 7).alias("x"), (F.floor(F.col("nth") / 12) * 17).alias("y"), (wide * 7).alias("width"), F.lit(11).alias("height"))


@query(f"SELECT item_id, nth, word, x AS x1, y AS y1, x + width AS x2, y + height AS y2 FROM ({BOXES})")
def bbox_json_rows(spark, sf_dir):
    from inkspan.sources.sinks import box_json

    rows = box_json(_boxes(spark, sf_dir), ["item_id"], order="nth")
    kind = "array<struct<word:string,x1:bigint,y1:bigint,x2:bigint,y2:bigint>>"
    return rows.select("item_id", F.posexplode(F.from_json("json", kind)).alias("nth", "b")).select("item_id", "nth", "b.*")


@query(f"""SELECT item_id, word, x, y, width, height, (50 + nth % 50)::DOUBLE AS confidence FROM ({BOXES}) WHERE nth % 7 <> 3 AND nth % 11 <> 5""")
def tsv_scan(spark, sf_dir):
    """Rows of recogniser output as text: every 7th of another level, every 11th with a number that isn't one."""
    from inkspan.sources.readers import parse_tsv

    b = _boxes(spark, sf_dir)
    level = F.when(F.col("nth") % 7 == 3, "4").otherwise("5")
    left = F.when(F.col("nth") % 11 == 5, "x").otherwise(F.col("x").cast("string"))
    line = F.concat_ws("\t", level, F.lit("1"), F.lit("1"), F.lit("1"), F.lit("1"), F.col("nth").cast("string"), left, "y", "width", "height", (50 + F.col("nth") % 50).cast("string"), "word")
    return parse_tsv(b.select("item_id", line.alias("value")), keep=["item_id"]).select("item_id", "word", "x", "y", "width", "height", "confidence")


def _turns(spark, sf_dir):
    """Each turn of a conversation beside the one before it; the roles of truth and recognition."""
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("hyp"), F.lag(F.coalesce("text", F.lit(""))).over(w).alias("ref")).where("ref is not null")


TURNS = "SELECT conv_id, turn, coalesce(text, '') AS hyp, lag(coalesce(text, '')) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS ref FROM conversations QUALIFY ref IS NOT NULL"


@query(f"""SELECT conv_id, turn, dist, round(CASE WHEN n > 0 THEN dist / n::DOUBLE WHEN m = 0 THEN 0.0 ELSE 1.0 END, 9) AS cer
           FROM (SELECT conv_id, turn, levenshtein(r, h)::INT AS dist, length(r) AS n, length(h) AS m
                 FROM (SELECT conv_id, turn, regexp_replace(ref, '[^\\x00-\\x7F]', '?', 'g') AS r, regexp_replace(hyp, '[^\\x00-\\x7F]', '?', 'g') AS h FROM ({TURNS})))""")
def cer_pairs(spark, sf_dir):
    """Characters beyond ASCII count as one sign, since the other engine's distance counts bytes."""
    plain = lambda c: F.regexp_replace(c, r"[^\x00-\x7F]", "?")
    rows = _turns(spark, sf_dir).select("conv_id", "turn", plain("ref").alias("r"), plain("hyp").alias("h"))
    return rows.select("conv_id", "turn", F.levenshtein("r", "h").alias("dist"), F.round(metrics.cer(F.col("r"), F.col("h")), 9).alias("cer"))


@query(f"""SELECT conv_id, turn, d AS word_distance, round(CASE WHEN n > 0 THEN d / n::DOUBLE WHEN m = 0 THEN 0.0 ELSE 1.0 END, 9) AS wer FROM (
             SELECT conv_id, turn, len(r) AS n, len(h) AS m,
                    levenshtein(array_to_string(list_transform(r, lambda w: CASE WHEN list_contains(k, w) THEN chr((2 + list_position(k, w))::INT) ELSE chr(1) END), ''),
                                array_to_string(list_transform(h, lambda w: CASE WHEN list_contains(k, w) THEN chr((2 + list_position(k, w))::INT) ELSE chr(2) END), ''))::INT AS d
             FROM (SELECT *, list_sort(list_intersect(r, h)) AS k FROM (SELECT conv_id, turn, {NORMALISED.format(t="ref")} AS r, {NORMALISED.format(t="hyp")} AS h FROM ({TURNS}))))""")
def wer_pairs(spark, sf_dir):
    """Word distance is worked out in Arrow batches; the SQL makes a sign of each word that both sides hold (125 at most here)."""
    rows = _turns(spark, sf_dir).select("conv_id", "turn", T.normalised_words(F.col("ref")).alias("ref"), T.normalised_words(F.col("hyp")).alias("hyp"))
    out = metrics.word_errors(rows, "ref", "hyp")
    return out.select("conv_id", "turn", "word_distance", F.round(T.ratio(F.col("word_distance"), F.size("ref"), F.size("hyp")), 9).alias("wer"))


@query(f"""SELECT conv_id, turn, round(CASE WHEN len(r) = 0 THEN 1.0 ELSE len(list_filter(r, lambda w: list_contains(h, w))) / len(r)::DOUBLE END, 9) AS recall,
                  round(CASE WHEN len(h) = 0 THEN 1.0 ELSE len(list_filter(h, lambda w: list_contains(r, w))) / len(h)::DOUBLE END, 9) AS precision
           FROM (SELECT conv_id, turn, {NORMALISED.format(t="ref")} AS r, {NORMALISED.format(t="hyp")} AS h FROM ({TURNS}))""")
def recall_precision(spark, sf_dir):
    rows = _turns(spark, sf_dir).select("conv_id", "turn", T.normalised_words(F.col("ref")).alias("r"), T.normalised_words(F.col("hyp")).alias("h"))
    share = lambda a, b: F.round(metrics.share_found(F.col(a), F.col(b)), 9)
    return rows.select("conv_id", "turn", share("r", "h").alias("recall"), share("h", "r").alias("precision"))


@query("""SELECT user_id, count(*) AS blocks, round(coalesce(avg(value), 0), 6) AS mean_confidence, count(*) FILTER (value > 0.05) AS flagged,
                 string_agg(event_type, ' ' ORDER BY event_id) AS joined FROM events GROUP BY user_id""")
def eval_document_rollup(spark, sf_dir):
    """Document metrics over the ordered concatenation of its pages: here a user's events."""
    ordered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))), lambda s: s["event_type"]), " ")
    return read(spark, sf_dir, "events").groupBy("user_id").agg(
        F.count("*").alias("blocks"), F.round(F.coalesce(F.avg("value"), F.lit(0.0)), 6).alias("mean_confidence"), F.count_if(F.col("value") > 0.05).alias("flagged"), ordered.alias("joined")
    )


GLYPHS = """SELECT l_orderkey AS page, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey))::INT AS glyph,
                   (l_partkey % 23)::INT * 9 AS x, (l_suppkey % 17 + l_partkey % 5)::INT AS y, (4 + l_linenumber % 5)::INT AS width, (6 + l_quantity::INT % 9)::INT AS height FROM lineitem"""


def _glyphs(spark, sf_dir):
    nth = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("page"), nth.alias("glyph"), ((F.col("l_partkey") % 23) * 9).cast("int").alias("x"), (F.col("l_suppkey") % 17 + F.col("l_partkey") % 5).cast("int").alias("y"),
        (4 + F.col("l_linenumber") % 5).cast("int").alias("width"), (6 + F.col("l_quantity").cast("int") % 9).cast("int").alias("height"),
    )


@query(f"""SELECT page, glyph, (sum(n) OVER (PARTITION BY page ORDER BY x, glyph))::BIGINT AS word FROM (
             SELECT *, coalesce((x - lag(x + width) OVER w > greatest(0.3 * lag(height) OVER w, 2.0))::INT, 0) AS n FROM ({GLYPHS}) WINDOW w AS (PARTITION BY page ORDER BY x, glyph))""")
def char_gap_words(spark, sf_dir):
    return layout.gap_words(_glyphs(spark, sf_dir), ["page"]).select("page", "glyph", "word")


@query(f"""WITH RECURSIVE g AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY page ORDER BY y, glyph) AS r FROM ({GLYPHS})),
           mid AS MATERIALIZED (SELECT page, list_sort(list(height))[len(list(height)) // 2 + 1] AS mid FROM g GROUP BY page),
           f AS (SELECT g.page, glyph, r, y AS at, 0 AS line FROM g WHERE r = 1
                 UNION ALL
                 SELECT g.page, g.glyph, g.r, CASE WHEN abs(g.y - f.at) > 0.5 * mid THEN g.y ELSE f.at END, f.line + (abs(g.y - f.at) > 0.5 * mid)::INT
                 FROM f JOIN g ON g.page = f.page AND g.r = f.r + 1 JOIN mid ON mid.page = f.page)
           SELECT page, glyph, line FROM f""")
def line_cluster_anchor(spark, sf_dir):
    return layout.anchored_lines(_glyphs(spark, sf_dir), ["page"]).select("page", "glyph", "line")


@query(f"""WITH RECURSIVE g AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY page ORDER BY cy, glyph) AS r FROM (SELECT page, glyph, height, x + width / 2.0::DOUBLE AS cx, y + height / 2.0::DOUBLE AS cy FROM ({GLYPHS}))),
           f AS (SELECT page, glyph, cx, r, cy AS mid, height AS tall, 0 AS line FROM g WHERE r = 1
                 UNION ALL
                 SELECT page, glyph, cx, r, CASE WHEN new THEN cy ELSE mid END, CASE WHEN new THEN height ELSE tall END, line + new::INT
                 FROM (SELECT g.*, f.mid, f.tall, f.line, abs(g.cy - f.mid) > (g.height + f.tall) / 2.0::DOUBLE / 2 AS new FROM f JOIN g ON g.page = f.page AND g.r = f.r + 1))
           SELECT page, glyph, row_number() OVER (PARTITION BY page ORDER BY line, cx, glyph)::INT AS place FROM f""")
def reading_order(spark, sf_dir):
    return layout.reading_order(_glyphs(spark, sf_dir), ["page"], order="glyph").select("page", "glyph", "place")


@query("""WITH RECURSIVE g AS MATERIALIZED (SELECT o_custkey AS page, o_orderkey AS crop, CASE WHEN o_orderkey % 13 <> 0 THEN o_totalprice END AS w,
                  row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey % 13 = 0, CASE WHEN o_orderkey % 13 <> 0 THEN o_totalprice END, o_orderkey) AS r FROM orders),
          f AS (SELECT page, crop, r, w AS low, 1 AS n, 0 AS batch FROM g WHERE r = 1
                UNION ALL
                SELECT page, crop, r, CASE WHEN new THEN w ELSE coalesce(low, w) END, CASE WHEN new THEN 1 ELSE n + 1 END, batch + new::INT
                FROM (SELECT g.page, g.crop, g.r, g.w, f.low, f.n, f.batch, coalesce(f.n = 6 OR f.low < 0.6 * g.w, false) AS new FROM f JOIN g ON g.page = f.page AND g.r = f.r + 1))
          SELECT page, crop, batch FROM f""")
def width_batches(spark, sf_dir):
    """A customer's orders as crops, their price as width; every 13th is missing."""
    crops = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("page"), F.col("o_orderkey").alias("crop"), F.when(F.col("o_orderkey") % 13 != 0, F.col("o_totalprice")).alias("width"))
    return layout.width_batches(crops, ["page"]).select("page", "crop", "batch")


@query("SELECT l_partkey, count(*) AS n, list_sort(list(l_quantity))[len(list(l_quantity)) // 2 + 1] AS height FROM lineitem GROUP BY l_partkey")
def upper_median_height(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n"), G.upper_median(F.collect_list("l_quantity")).alias("height"))


@query(f"""SELECT page, round(CASE WHEN len(b) > 0 THEN least(1.0, greatest(0.5, (list_sort(b)[len(b) // 2 + 1] - top) / h::DOUBLE)) WHEN page % 2 = 0 THEN 0.85 ELSE 0.75 END, 9) AS ratio
           FROM (SELECT page, coalesce(list(y + height) FILTER (glyph > 1), []) AS b, min(y) AS top, max(height) AS h FROM ({GLYPHS}) GROUP BY page)""")
def baseline_ratio(spark, sf_dir):
    """An order's lines as a word's glyphs, without the first; even orders stand for CJK words."""
    words = _glyphs(spark, sf_dir).groupBy("page").agg(F.collect_list(F.when(F.col("glyph") > 1, F.col("y") + F.col("height"))).alias("b"), F.min("y").alias("top"), F.max("height").alias("h"))
    word = F.when(F.col("page") % 2 == 0, "漢字").otherwise("word")
    return words.select("page", F.round(G.baseline_ratio(F.col("b"), F.col("top"), F.col("h"), T.is_cjk(word)), 9).alias("ratio"))


@query(f"""SELECT item_id, nth, round(s, 6) AS font_size, round(CASE WHEN n > 0 THEN width * 0.24::DOUBLE / n ELSE 1.0 END, 6) AS stretch, round(x * 0.24::DOUBLE, 6) AS tx, round(792 - (y + height * 0.75::DOUBLE) * 0.24::DOUBLE, 6) AS ty
           FROM (SELECT *, length(word) * s * 0.5 AS n FROM (SELECT *, greatest(height * 0.24::DOUBLE, 1.0::DOUBLE) AS s FROM ({BOXES})))""")
def pdf_text_matrix(spark, sf_dir):
    """Word boxes of 300 dots an inch on a page of 792 points."""
    c = F.col
    m = G.text_matrix(c("x"), c("y"), c("width"), c("height"), F.length("word"), F.lit(0.24), F.lit(0.24), F.lit(792.0), F.lit(0.75))
    return _boxes(spark, sf_dir).select("item_id", "nth", *(F.round(v, 6).alias(k) for k, v in m.items()))


@query("""SELECT o_orderkey, o_totalprice, n AS mask_rows FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_orderkey) ON o_orderkey = l_orderkey""")
def page_zip_optional_mask(spark, sf_dir):
    """Pages (orders) zipped with masks (their returned lines), which may be missing."""
    masks = read(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("mask_rows"))
    return read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").join(masks, "o_orderkey", "left")


@query("SELECT p_partkey, ((77 * (p_partkey % 256) + 150 * (p_partkey * 7 % 256) + 29 * (p_size * 5 % 256)) >> 8)::BIGINT AS gray FROM part")
def luma_gray(spark, sf_dir):
    k = F.col("p_partkey")
    return read(spark, sf_dir, "part").select("p_partkey", G.luma(k % 256, k * 7 % 256, F.col("p_size") * 5 % 256).cast("long").alias("gray"))


PIXELS = "SELECT s_suppkey AS page, i % 150 AS x, i // 150 AS y, ((s_suppkey * 31 + (i % 150) * 7 + (i // 150) * 13 + (i % 150) * (i // 150)) % 200 + (CASE WHEN (i + s_suppkey) % 9 = 0 THEN 0 ELSE 55 END))::BIGINT AS gray FROM supplier, range(15000) t(i)"


def _draw(key: int) -> np.ndarray:
    y, x = np.indices((100, 150))
    return (key * 31 + x * 7 + y * 13 + x * y) % 200 + np.where((x + 150 * y + key) % 9 == 0, 0, 55)


def _rasters(spark, sf_dir):
    """A picture of 150 x 100 pixels for each supplier; pages are dealt out while they are keys, and stay one row each."""
    pages = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("page")).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "page")
    return raster.draw_pages(pages, "page", _draw)


LEVELS = f"""SELECT page, tx, ty, CASE WHEN max(floor(a * 0.95)) = 0 THEN 0 ELSE min(gray) FILTER (upto >= floor(a * 0.95)) END::INT AS level FROM (
    SELECT *, sum(n) OVER (PARTITION BY page, tx, ty ORDER BY gray) AS upto, sum(n) OVER (PARTITION BY page, tx, ty) AS a FROM (
        SELECT page, (x // 64)::INT AS tx, (y // 64)::INT AS ty, gray, count(*) AS n FROM ({PIXELS}) GROUP BY ALL)) GROUP BY ALL"""


@query(LEVELS)
def tile_background_level(spark, sf_dir):
    return raster.tile_levels(_rasters(spark, sf_dir), "page")


FLAT = f"""SELECT page, x, y, gray, background, CASE WHEN background = 0 THEN gray ELSE least(255, gray * 255 // background) END::BIGINT AS flat FROM (
    SELECT p.*, (((b00.level * (64 - fx) + b10.level * fx) * (64 - fy) + (b01.level * (64 - fx) + b11.level * fx) * fy) // 4096)::BIGINT AS background
    FROM (SELECT *, least(x1_ + 1, 2) AS x1, least(y1_ + 1, 1) AS y1, least(x + 32 - x1_ * 64, 63) AS fx, least(y + 32 - y1_ * 64, 63) AS fy
          FROM (SELECT *, least((x + 32) // 64, 2) AS x1_, least((y + 32) // 64, 1) AS y1_ FROM ({PIXELS}))) p
    JOIN lv b00 ON b00.page = p.page AND b00.tx = x1_ AND b00.ty = y1_ JOIN lv b10 ON b10.page = p.page AND b10.tx = x1 AND b10.ty = y1_
    JOIN lv b01 ON b01.page = p.page AND b01.tx = x1_ AND b01.ty = y1 JOIN lv b11 ON b11.page = p.page AND b11.tx = x1 AND b11.ty = y1)"""


@query(f"WITH lv AS MATERIALIZED ({LEVELS}) SELECT page, sum(background)::BIGINT AS background, sum(flat)::BIGINT AS flat, sum(flat * (x + 3 * y))::BIGINT AS mix FROM ({FLAT}) GROUP BY page")
def normalize_pixels(spark, sf_dir):
    def kernel(gray):
        flat = raster.flatten_background(gray)
        y, x = np.indices(gray.shape)
        return {"background": np.array([raster.background_surface(gray).sum()]), "flat": np.array([flat.sum()]), "mix": np.array([(flat * (x + 3 * y)).sum()])}

    return raster.map_pages(_rasters(spark, sf_dir), "page", kernel, "background long, flat long, mix long")


def _otsu_sql(rows: str, value: str) -> str:
    return f"""SELECT page, CASE WHEN var > 0 THEN v ELSE 0 END::INT AS threshold FROM (
        SELECT page, v, CASE WHEN a > wb THEN wb::DOUBLE * (a - wb) * (sb / wb::DOUBLE - (t - sb) / (a - wb)::DOUBLE) * (sb / wb::DOUBLE - (t - sb) / (a - wb)::DOUBLE) ELSE 0 END AS var FROM (
            SELECT page, v, sum(n) OVER w AS wb, sum(n * v) OVER w AS sb, sum(n) OVER (PARTITION BY page) AS a, sum(n * v) OVER (PARTITION BY page) AS t
            FROM (SELECT page, {value} AS v, count(*) AS n FROM ({rows}) GROUP BY ALL) WINDOW w AS (PARTITION BY page ORDER BY v)))
        QUALIFY row_number() OVER (PARTITION BY page ORDER BY var DESC, v) = 1"""


@query(_otsu_sql("SELECT l_returnflag AS page, (l_quantity::INT * 5 % 256)::BIGINT AS g FROM lineitem", "g"))
def otsu_threshold(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("page"), (F.col("l_quantity").cast("int") * 5 % 256).cast("long").alias("gray"))
    return segment.otsu(rows, ["page"])


@query(f"WITH t AS ({_otsu_sql(PIXELS, 'gray')}) SELECT page, round(avg((gray <= threshold)::INT), 9) AS foreground FROM ({PIXELS}) JOIN t USING (page) GROUP BY page")
def binarize_fraction(spark, sf_dir):
    def kernel(gray):
        return {"foreground": np.array([round(float((gray <= raster.otsu(gray)).mean()), 9)])}

    return raster.map_pages(_rasters(spark, sf_dir), "page", kernel, "foreground double")


BLOBS = f"SELECT page, (x // 30 + 5 * (y // 25))::BIGINT AS label, x, y, gray / 255.0::DOUBLE AS p FROM ({PIXELS}) WHERE gray > 76 AND (x % 30) < 5 + page % 20 AND y % 25 > 3"


def _blobs(spark, sf_dir):
    """The pixels that components may be made of, and only these, as rows."""

    def kernel(gray):
        y, x = np.nonzero(gray > 76)
        return {"x": x, "y": y, "p": gray[y, x] / 255.0}

    x, y = F.col("x"), F.col("y")
    rows = raster.map_pages(_rasters(spark, sf_dir), "page", kernel, "x long, y long, p double").where((x % 30 < 5 + F.col("page") % 20) & (y % 25 > 3))
    return rows.select("page", (F.floor(x / 30) + 5 * F.floor(y / 25)).cast("long").alias("label"), "x", "y", "p")


@query(f"""SELECT *, floor(area * 1.5 / (2 * (w + h)) + 0.5)::BIGINT AS pad, mean_p >= 0.6 AND w >= 3 AND h >= 3 AS kept FROM (
             SELECT page, label, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, count(*) AS area, round(avg(p), 9) AS mean_p, max(x) - min(x) + 1 AS w, max(y) - min(y) + 1 AS h FROM ({BLOBS}) GROUP BY ALL)""")
def component_stats(spark, sf_dir):
    return recognition.component_boxes(_blobs(spark, sf_dir), ["page", "label"]).withColumn("mean_p", F.round("p", 9)).drop("p")


@query(f"""WITH b AS MATERIALIZED ({BLOBS}), a AS MATERIALIZED (SELECT page, label, avg(x) AS cx, avg(y) AS cy, 0.5 * atan2(2 * covar_pop(x, y), var_pop(x) - var_pop(y)) AS theta FROM b GROUP BY ALL)
           SELECT page, label, round(theta, 6) AS theta, round(max(u) - min(u), 5) AS along, round(max(v) - min(v), 5) AS across FROM (
             SELECT page, label, theta, (x - cx) * cos(theta) + (y - cy) * sin(theta) AS u, (y - cy) * cos(theta) - (x - cx) * sin(theta) AS v FROM b JOIN a USING (page, label)) GROUP BY page, label, theta""")
def component_axis(spark, sf_dir):
    rows = recognition.component_axes(_blobs(spark, sf_dir), ["page", "label"])
    return rows.select("page", "label", F.round("theta", 6).alias("theta"), F.round(F.col("max_u") - F.col("min_u"), 5).alias("along"), F.round(F.col("max_v") - F.col("min_v"), 5).alias("across"))


ALPHABET = ["", *"abcdefghijklmnopqrstuvwxyz0123456789", " "]


@query(f"""SELECT line, trim(coalesce(string_agg(c, '' ORDER BY step) FILTER (c IS NOT NULL), '')) AS text FROM (
             SELECT line, step, CASE WHEN class > 0 AND class < {len(ALPHABET)} AND (before IS NULL OR before <> class) THEN (' abcdefghijklmnopqrstuvwxyz0123456789 ')[class + 1] END AS c FROM (
               SELECT vec_id // 10 AS line, vec_id AS step, list_position(embedding, list_max(embedding)) - 1 AS class,
                      lag(list_position(embedding, list_max(embedding)) - 1) OVER (PARTITION BY vec_id // 10 ORDER BY vec_id) AS before FROM embeddings)) GROUP BY line""")
def ctc_decode(spark, sf_dir):
    """Vectors as scores of 64 classes, ten ids a line."""
    steps = read(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 10).alias("line"), F.col("vec_id").alias("step"), F.col("embedding").alias("scores"))
    return recognition.ctc_decode(steps, ["line"], ALPHABET)


@query("SELECT n_name AS key, coalesce(CASE WHEN n_nationkey % 3 = 0 THEN 'cli' END, CASE WHEN n_nationkey % 2 = 0 THEN 'file' END, 'default') AS value FROM nation")
def config_overlay(spark, sf_dir):
    from inkspan.plans.settings import overlay

    rows = read(spark, sf_dir, "nation").select(F.col("n_name").alias("key"), F.when(F.col("n_nationkey") % 3 == 0, "cli").alias("cli"), F.when(F.col("n_nationkey") % 2 == 0, "file").alias("file"), F.lit("default").alias("default"))
    return rows.select("key", overlay("cli", "file", "default").alias("value"))


@query("SELECT n_regionkey, arg_min(n_name, n_nationkey) AS first_name FROM nation WHERE n_nationkey % 4 <> 0 GROUP BY n_regionkey")
def tier_fallback(spark, sf_dir):
    """The first of several by priority that exists."""
    return read(spark, sf_dir, "nation").where("n_nationkey % 4 <> 0").groupBy("n_regionkey").agg(F.min_by("n_name", "n_nationkey").alias("first_name"))


@query("SELECT page_id, len(regexp_extract_all(html, '<a '))::INT AS links, len(regexp_extract_all(html, '<h[1-6]'))::INT AS headings, len(regexp_extract_all(html, '<img'))::INT AS pictures FROM pages")
def preserve_counts(spark, sf_dir):
    """Counts of what a conversion must keep; in web pages: links, headings and pictures."""
    n = lambda p: F.regexp_count("html", F.lit(p))
    return read(spark, sf_dir, "pages").select("page_id", n("<a ").alias("links"), n("<h[1-6]").alias("headings"), n("<img").alias("pictures"))


@query("SELECT o_custkey, sum(o_totalprice)::BIGINT AS source, CASE WHEN min(o_totalprice) > 0 THEN floor(max(o_totalprice) / min(o_totalprice) * 100) / 100 ELSE 0.0 END AS ratio FROM (SELECT o_custkey, CASE WHEN o_orderkey % 11 = 0 THEN 0 ELSE floor(o_totalprice)::BIGINT END AS o_totalprice FROM orders) GROUP BY o_custkey")
def compression_ratio(spark, sf_dir):
    """Larger by smaller size, cut to two decimals; 0 unless both are positive. A customer's orders stand for sizes, every 11th unknown."""
    rows = read(spark, sf_dir, "orders").select("o_custkey", F.when(F.col("o_orderkey") % 11 == 0, 0).otherwise(F.floor("o_totalprice")).alias("size"))
    low, high = F.min("size"), F.max("size")
    return rows.groupBy("o_custkey").agg(F.sum("size").alias("source"), F.when(low > 0, F.floor(high / low * 100) / 100).otherwise(0.0).alias("ratio"))


@query("""SELECT o_orderpriority, y, round(first_value(s) OVER (PARTITION BY o_orderpriority ORDER BY y) / s, 6) AS speedup, round(n / s, 9) AS per_second
          FROM (SELECT o_orderpriority, year(o_orderdate)::INT AS y, round(sum(o_totalprice), 2) AS s, count(*) AS n FROM orders GROUP BY ALL)""")
def speedup(spark, sf_dir):
    """Time of the first setting by each setting's, and items a second: years of orders stand for settings."""
    rows = read(spark, sf_dir, "orders").groupBy("o_orderpriority", F.year("o_orderdate").alias("y")).agg(F.round(F.sum("o_totalprice"), 2).alias("s"), F.count("*").alias("n"))
    first = F.first_value("s").over(Window.partitionBy("o_orderpriority").orderBy("y"))
    return rows.select("o_orderpriority", "y", F.round(first / F.col("s"), 6).alias("speedup"), F.round(F.col("n") / F.col("s"), 9).alias("per_second"))


@query(f"""SELECT page, sum(b)::BIGINT AS total, sum(b * (x + 3 * y))::BIGINT AS mix FROM (SELECT page, x, y, floor(sum(k * g))::BIGINT AS b FROM (
             SELECT p.page, p.x, p.y, d.k, q.gray AS g FROM ({PIXELS}) p, (VALUES (-2, 0.0625::DOUBLE), (-1, 0.25::DOUBLE), (0, 0.375::DOUBLE), (1, 0.25::DOUBLE), (2, 0.0625::DOUBLE)) d(o, k)
             JOIN ({PIXELS}) q ON q.page = p.page AND q.y = p.y AND q.x = least(149, greatest(0, p.x + d.o))) GROUP BY ALL) GROUP BY page""")
def gaussian_1d(spark, sf_dir):
    """Horizontal pass of a blur with edges clamped: a weighted frame of two pixels to either side."""
    def kernel(gray):
        wide = np.pad(gray, ((0, 0), (2, 2)), mode="edge")
        out = np.floor(sum(k * wide[:, i : i + gray.shape[1]] for i, k in enumerate((0.0625, 0.25, 0.375, 0.25, 0.0625)))).astype(np.int64)
        y, x = np.indices(gray.shape)
        return {"total": np.array([out.sum()]), "mix": np.array([(out * (x + 3 * y)).sum()])}

    return raster.map_pages(_rasters(spark, sf_dir), "page", kernel, "total long, mix long")


@query("SELECT p_partkey, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN printf('%.0f KB', floor(n / 1024.0 + 0.5)) ELSE printf('%.1f MB', floor(n / 1048576.0 * 10 + 0.5) / 10) END AS size, CASE WHEN trim(o) <> '' THEN o || ' -> ' || p_brand ELSE p_brand END AS producer FROM (SELECT *, p_partkey * p_partkey * 37 AS n, CASE WHEN p_size % 2 = 0 THEN p_type ELSE ' ' END AS o FROM part)")
def names_and_sizes(spark, sf_dir):
    k = F.col("p_partkey")
    old = F.when(F.col("p_size") % 2 == 0, F.col("p_type")).otherwise(" ")
    return read(spark, sf_dir, "part").select("p_partkey", T.human_size(k * k * 37).alias("size"), T.producer_chain(old, F.col("p_brand")).alias("producer"))


@query()
def connected_components(spark, sf_dir):
    """Components of dark pixels by page, numbered by first appearance; a test holds them against a flood fill."""
    return raster.label_pages(_rasters(spark, sf_dir), "page", 90)


@query()
def segment_raster(spark, sf_dir):
    """Whole-page kernel: normalise, threshold, mask and inpaint; a test holds it against the plain rules."""
    return raster.segment_pages(_rasters(spark, sf_dir), "page")


@query(f"""WITH p AS MATERIALIZED ({PIXELS}), near AS (
             SELECT a.page, a.x, a.y, coalesce(min(abs(o.dx) + abs(o.dy)) FILTER (b.gray > 90), 4) AS d
             FROM (SELECT * FROM p WHERE gray <= 90) a, (SELECT i::BIGINT AS dx, j::BIGINT AS dy FROM range(-3, 4) t(i), range(-3, 4) u(j) WHERE abs(i) + abs(j) <= 3) o
             LEFT JOIN p b ON b.page = a.page AND b.x = a.x + o.dx AND b.y = a.y + o.dy GROUP BY ALL)
           SELECT page, count(*) AS ink, count(*) FILTER (d = 1) AS one, count(*) FILTER (d = 2) AS two, count(*) FILTER (d = 3) AS three, count(*) FILTER (d > 3) AS farther FROM near GROUP BY page""")
def inpaint_distance(spark, sf_dir):
    """How far each page's ink is from the background that fills it; what is farther than the radius is filled white."""
    def kernel(gray):
        ink = gray <= 90
        d = raster.nearest_background(gray, ink)[0][ink]
        n = np.bincount(np.minimum(d, 4), minlength=5)
        return {k: np.array([v]) for k, v in zip(("ink", "one", "two", "three", "farther"), (len(d), *n[1:]))}

    return raster.map_pages(_rasters(spark, sf_dir), "page", kernel, "ink long, one long, two long, three long, farther long").where("ink > 0")


@query(f"""WITH lv AS MATERIALIZED ({LEVELS}) SELECT page, count(*) AS ink, round(avg((flat <> gray)::INT), 9) AS changed FROM ({FLAT}) WHERE gray <= 90 GROUP BY page""")
def changed_under_mask(spark, sf_dir):
    """Share of each page's ink that flattening changes."""
    def kernel(gray):
        ink = gray <= 90
        return {"ink": np.array([ink.sum()]), "changed": np.array([round(raster.changed_share(gray, raster.flatten_background(gray), ink), 9)])}

    return raster.map_pages(_rasters(spark, sf_dir), "page", kernel, "ink long, changed double").where("ink > 0")


@query(f"""SELECT item_id, 1::INT AS page, nth, word, round(x * 0.24::DOUBLE, 4) AS tx, round(792 - (y + 0.75::DOUBLE * height) * 0.24::DOUBLE, 4) AS ty, 2.64::DOUBLE AS font_size, round(width * 0.24::DOUBLE / (length(word) * 2.64::DOUBLE * 0.5), 4) AS stretch FROM ({BOXES})""")
def pdf_sink(spark, sf_dir):
    """A searchable document for each benchmark text, and the words that reading it back gives."""
    from inkspan.sources.pdf import pdf_documents, pdf_words

    docs = pdf_documents(_boxes(spark, sf_dir), "item_id")
    return pdf_words(docs, "item_id")


@query(f"""SELECT item_id, 1::INT AS page, (row_number() OVER (PARTITION BY item_id ORDER BY nth, i) - 1)::INT AS glyph, word[i] AS text, round(x * 0.24::DOUBLE + (i - 1) * 1.32::DOUBLE * 1.2727::DOUBLE, 3) AS x, round((y + 0.75::DOUBLE * height) * 0.24::DOUBLE, 3) AS y
           FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM ({BOXES}))""")
def pdf_text_layer(spark, sf_dir):
    """Positioned text of those documents by the reader of any writer's: a row a glyph, from the top left."""
    from inkspan.sources.pdf import pdf_documents
    from inkspan.sources.pdf_objects import document_glyphs

    docs = pdf_documents(_boxes(spark, sf_dir), "item_id")
    return document_glyphs(docs, "item_id").select("item_id", "page", "glyph", "text", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"))


@query("""SELECT p_partkey, w, h, (greatest(32, floor(w * s / 32 + 0.5) * 32))::INT AS det_w, (greatest(32, floor(h * s / 32 + 0.5) * 32))::INT AS det_h, least(3200, greatest(4, ceil(48 * w / h::DOUBLE)))::INT AS rec_w
          FROM (SELECT *, least(1.0::DOUBLE, 960 / greatest(w, h)::DOUBLE) AS s FROM (SELECT p_partkey, p_partkey * 37 % 3000 + 1 AS w, (p_size * 41 + 1)::BIGINT AS h FROM part))""")
def recogniser_input_sizes(spark, sf_dir):
    """Sizes that pictures have for detection and lines for recognition."""
    rows = read(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") * 37 % 3000 + 1).alias("w"), (F.col("p_size") * 41 + 1).cast("long").alias("h"))
    w, h = F.col("w"), F.col("h")
    longest = F.greatest(w, h)
    return rows.select("p_partkey", "w", "h", G.detection_side(w, longest).alias("det_w"), G.detection_side(h, longest).alias("det_h"), G.recognition_width(w, h).alias("rec_w"))


@query(f"""SELECT page, label, floor(l * 2.5 + 0.5)::BIGINT AS x, floor(t * 1.5 + 0.5)::BIGINT AS y, floor((r - l + 1) * 2.5 + 0.5)::BIGINT AS width, floor((b - t + 1) * 1.5 + 0.5)::BIGINT AS height, round(p * 100, 6) AS confidence
           FROM (SELECT page, label, p, greatest(0, x0 - pad) AS l, greatest(0, y0 - pad) AS t, least(149, x1 + pad) AS r, least(99, y1 + pad) AS b
                 FROM (SELECT *, floor(n * 1.5::DOUBLE / (2 * (x1 - x0 + 1 + y1 - y0 + 1)) + 0.5) AS pad
                       FROM (SELECT page, label, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, count(*) AS n, avg(p) AS p FROM ({BLOBS}) GROUP BY ALL)
                       WHERE p >= 0.6 AND x1 - x0 >= 2 AND y1 - y0 >= 2))""")
def box_unclip(spark, sf_dir):
    """Kept components as boxes of the picture that the map was made of."""
    c = F.col
    kept = recognition.component_boxes(_blobs(spark, sf_dir), ["page", "label"]).where("kept")
    box = G.unclipped(c("min_x"), c("min_y"), c("max_x"), c("max_y"), c("pad"), 150, 100, 2.5, 1.5)
    return kept.select("page", "label", *(v.alias(k) for k, v in box.items()), F.round(c("p") * 100, 6).alias("confidence"))


@query("""SELECT p_partkey, list_min(xs) AS x, list_min(ys) AS y, list_max(xs) - list_min(xs) + 1 AS width, list_max(ys) - list_min(ys) + 1 AS height, list_sum(xs) / 4.0::DOUBLE AS centre_x, list_sum(ys) / 4.0::DOUBLE AS centre_y
          FROM (SELECT p_partkey, [k % 97, k % 97 + p_size, k % 97 + p_size - 3, k % 97 - 3] AS xs, [k % 89, k % 89 + 2, k % 89 + 12, k % 89 + 10] AS ys FROM (SELECT *, p_partkey AS k FROM part))""")
def polygon_boxes(spark, sf_dir):
    """Bounds and centres of slanted boxes."""
    x, y, s = F.col("p_partkey") % 97, F.col("p_partkey") % 89, F.col("p_size")
    box = G.polygon_box(F.array(x, x + s, x + s - 3, x - 3), F.array(y, y + 2, y + 12, y + 10))
    return read(spark, sf_dir, "part").select("p_partkey", *(v.alias(k) for k, v in box.items()))


@query(f"""SELECT page, word, string_agg(chr((97 + glyph % 26)::INT), '' ORDER BY x, glyph) AS text, floor(min(x) * (300 / 72.0::DOUBLE) + 0.5)::BIGINT AS x, floor(min(y) * (300 / 72.0::DOUBLE) + 0.5)::BIGINT AS y,
                  greatest(1, floor((max(x + width) - min(x)) * (300 / 72.0::DOUBLE) + 0.5))::BIGINT AS width, greatest(1, floor((max(y + height) - min(y)) * (300 / 72.0::DOUBLE) + 0.5))::BIGINT AS height, 100.0::DOUBLE AS confidence
           FROM (SELECT page, glyph, x, y, width, height, (sum(n) OVER (PARTITION BY page ORDER BY x, glyph))::BIGINT AS word FROM (
             SELECT *, coalesce((x - lag(x + width) OVER w > greatest(0.3 * lag(height) OVER w, 2.0))::INT, 0) AS n FROM ({GLYPHS}) WINDOW w AS (PARTITION BY page ORDER BY x, glyph))) GROUP BY page, word""")
def char_blocks(spark, sf_dir):
    """Words of glyphs as blocks of pixels; an order's lines stand for the glyphs of a line."""
    glyphs = _glyphs(spark, sf_dir).withColumn("text", F.char(97 + F.col("glyph") % 26))
    return layout.char_blocks(layout.gap_words(glyphs, ["page"]), ["page", "word"])


@query(f"""WITH p AS MATERIALIZED ({PIXELS})
           SELECT a.page, sum(v)::BIGINT AS total, sum(v * (x + 3 * y))::BIGINT AS mix FROM (
             SELECT a.page, a.x, a.y, floor((a.gray * 0.75::DOUBLE + b.gray * 0.25::DOUBLE) * 0.5 + (c.gray * 0.75::DOUBLE + d.gray * 0.25::DOUBLE) * 0.5 + 0.5)::BIGINT AS v FROM p a
             JOIN p b ON b.page = a.page AND b.x = least(149, a.x + 1) AND b.y = a.y JOIN p c ON c.page = a.page AND c.x = a.x AND c.y = least(99, a.y + 1)
             JOIN p d ON d.page = a.page AND d.x = least(149, a.x + 1) AND d.y = least(99, a.y + 1)) a GROUP BY a.page""")
def bilinear_sample(spark, sf_dir):
    """Each page sampled a quarter of a pixel to the right and half a pixel down, edges clamped."""
    def kernel(gray):
        y, x = np.indices(gray.shape)
        out = raster.bilinear(gray, x + 0.25, y + 0.5)
        return {"total": np.array([out.sum()]), "mix": np.array([(out * (x + 3 * y)).sum()])}

    return raster.map_pages(_rasters(spark, sf_dir), "page", kernel, "total long, mix long")


@query(r"""SELECT page_id, length(t)::INT AS n_chars, sha256(t) AS body_sha FROM (
             SELECT page_id, trim(regexp_replace(CASE WHEN regexp_matches(html, '<article>') THEN regexp_replace(html, '(?s)^.*?(?:<article>)', '') ELSE html END, '(?s)(?:</article>).*$', ''), chr(32) || chr(9) || chr(10) || chr(13)) AS t FROM pages)""")
def text_between_markers(spark, sf_dir):
    """What is left of a text when its head and its foot are cut: here a web page's article."""
    t = T.between_markers(F.col("html"), "<article>", "</article>")
    return read(spark, sf_dir, "pages").select("page_id", F.length(t).alias("n_chars"), F.sha2(t.cast("binary"), 256).alias("body_sha"))


@query(f"""SELECT item_id, len(w)::INT AS blocks, len(list_filter(w, lambda x: length(x) > 2))::INT AS worded FROM (SELECT item_id, {WORDS.format(t="text")} AS w FROM benchmark)""")
def short_text_suppressed(spark, sf_dir):
    """Blocks of two characters or fewer stay without their text, and don't count as words."""
    w = T.words(F.col("text"))
    return read(spark, sf_dir, "benchmark").select("item_id", F.size(w).alias("blocks"), F.size(F.filter(w, lambda x: F.trim(T.suppress_short(x)) != "")).alias("worded"))


@query("""SELECT n_nationkey, CASE WHEN contains(a, '<pdfaid:conformance>') THEN a ELSE regexp_replace(a, '</rdf:Description>', '<pdfaid:conformance>B</pdfaid:conformance></rdf:Description>') END AS xmp FROM (
            SELECT n_nationkey, CASE WHEN contains(x, '<pdfaid:part>') THEN x ELSE regexp_replace(x, '</rdf:Description>', '<pdfaid:part>2</pdfaid:part></rdf:Description>') END AS a FROM (
              SELECT n_nationkey, '<rdf:Description>' || n_name || CASE WHEN n_nationkey % 2 = 0 THEN '<pdfaid:part>1</pdfaid:part>' ELSE '' END || CASE WHEN n_nationkey % 3 = 0 THEN '<pdfaid:conformance>U</pdfaid:conformance>' ELSE '' END || '</rdf:Description>' AS x FROM nation))""")
def xmp_conformance(spark, sf_dir):
    """Archival conformance merged into metadata that may hold a part of it."""
    k = F.col("n_nationkey")
    own = F.concat(F.lit("<rdf:Description>"), "n_name", F.when(k % 2 == 0, "<pdfaid:part>1</pdfaid:part>").otherwise(""), F.when(k % 3 == 0, "<pdfaid:conformance>U</pdfaid:conformance>").otherwise(""), F.lit("</rdf:Description>"))
    return read(spark, sf_dir, "nation").select("n_nationkey", T.conformance(own).alias("xmp"))


@query("""SELECT item_id, 'bench' || (item_id % 3) || ' -> inkspan' AS producer, (item_id % 4 + 1)::INT AS outlines, (item_id % 5)::INT AS notes, (item_id % 2)::INT AS files, TRUE AS archival FROM benchmark""")
def pdf_preserve(spark, sf_dir):
    """Documents of benchmark texts that take over outline, notes, attached files and metadata of others."""
    from inkspan.sources.pdf import pdf_documents, preserved, with_elements

    made = pdf_documents(_boxes(spark, sf_dir), "item_id").withColumnRenamed("content", "made")
    k = F.col("item_id").cast("int")
    docs = made.withColumns({"producer": F.concat(F.lit("bench"), k % 3), "outlines": k % 4 + 1, "notes": k % 5, "files": k % 2})
    return preserved(with_elements(docs, "item_id"), "item_id").drop("content")


@query("""SELECT k AS code, (k BETWEEN 19968 AND 40959 OR k BETWEEN 12352 AND 12447 OR k BETWEEN 12448 AND 12543 OR k BETWEEN 44032 AND 55215 OR k BETWEEN 13312 AND 19903) AS cjk
          FROM (SELECT CASE WHEN p_partkey % 5 = 0 THEN 63744 + p_partkey % 700 ELSE 12200 + p_partkey * 37 % 43000 END AS k FROM part)""")
def cjk_words(spark, sf_dir):
    """Words with one sign of many planes: which call for a CJK baseline; compatibility ideographs don't."""
    k = F.col("p_partkey")
    code = F.when(k % 5 == 0, 63744 + k % 700).otherwise(12200 + k * 37 % 43000)
    word = F.concat(F.lit("a"), F.decode(F.unhex(F.lpad(F.hex(code), 4, "0")), "UTF-16BE"))
    return read(spark, sf_dir, "part").select(code.alias("code"), T.is_cjk(word).alias("cjk"))


@query("""SELECT page_id, count(*) AS glyphs, count(*) FILTER (trim(g, chr(32) || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)) <> '') AS visible FROM (SELECT page_id, unnest(string_split(html, '')) AS g FROM pages) GROUP BY page_id""")
def blank_glyphs(spark, sf_dir):
    """Glyphs of a page with and without blank ones; each sign of a web page stands for a glyph."""
    glyphs = read(spark, sf_dir, "pages").select("page_id", F.explode(F.split("html", "")).alias("text"))
    seen = layout.visible_glyphs(glyphs).groupBy("page_id").agg(F.count("*").alias("visible"))
    return glyphs.groupBy("page_id").agg(F.count("*").alias("glyphs")).join(seen, "page_id", "left").select("page_id", "glyphs", F.coalesce("visible", F.lit(0)).alias("visible"))


@query(f"SELECT doc_id, page, count(*) AS n_lines FROM ({PAGED}) WHERE page BETWEEN 1 AND 2 GROUP BY ALL")
def requested_pages(spark, sf_dir):
    """Only the pages asked for: the second and the third."""
    return layout.of_pages(layout.page_lines(read(spark, sf_dir, "documents")), 1, 2).groupBy("doc_id", "page").agg(F.count("*").alias("n_lines"))


@query(f"SELECT doc_id, (max(page) + 1)::INT AS pages FROM ({PAGED}) GROUP BY doc_id HAVING max(page) + 1 <= 30")
def short_documents(spark, sf_dir):
    """Documents of 30 pages at most."""
    pages = layout.page_lines(read(spark, sf_dir, "documents")).groupBy("doc_id").agg((F.max("page") + 1).alias("pages"))
    return layout.short_documents(pages, ["doc_id"])


@query("""SELECT conv_id, turn, place, so_far FROM (SELECT conv_id, turn, row_number() OVER w::INT AS place, (sum(length(coalesce(text, ''))) OVER (w ROWS UNBOUNDED PRECEDING))::BIGINT AS so_far FROM (SELECT DISTINCT conv_id, turn, text FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY role, text) = 1) WINDOW w AS (PARTITION BY conv_id ORDER BY turn))""".replace("row_number() OVER w::INT", "(row_number() OVER w)::INT"))
def restored_page_order(spark, sf_dir):
    """Pages worked on in any order, put back; the time that each took adds up. A conversation's turns stand for pages, their length for time."""
    first = F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("role", "text"))
    rows = read(spark, sf_dir, "conversations").withColumn("n", first).where("n = 1").withColumn("took", F.length(F.coalesce("text", F.lit(""))).cast("long"))
    return layout.page_order(rows, ["conv_id"], page="turn").select("conv_id", "turn", "place", "so_far")


@query(f"""SELECT doc_id, count(*) FILTER (regexp_full_match(w, '[\\x{{{{20}}}}-\\x{{{{7E}}}}\\x{{{{A0}}}}-\\x{{{{FF}}}}]*')) AS shown, count(*) FILTER (NOT regexp_full_match(w, '[\\x{{{{20}}}}-\\x{{{{7E}}}}\\x{{{{A0}}}}-\\x{{{{FF}}}}]*')) AS skipped
           FROM (SELECT doc_id, unnest({WORDS.format(t="text")}) AS w FROM documents) GROUP BY doc_id""".replace("{{", "{").replace("}}", "}"))
def skipped_glyphs(spark, sf_dir):
    """Words that a font of Latin signs can show, and those that it must skip."""
    words = read(spark, sf_dir, "documents").select("doc_id", F.explode(T.words(F.col("text"))).alias("word"))
    return layout.shown_and_skipped(words, ["doc_id"])


@query("""SELECT n_nationkey, (starts_with(l, 'chi') OR starts_with(l, 'jpn') OR starts_with(l, 'kor') OR contains(l, 'cjk')) AS cjk,
                 CASE WHEN n_nationkey % 4 = 0 THEN 'no pages' WHEN n_nationkey % 2 = 0 AND n_nationkey % 3 = 0 THEN 'no text to keep; recognise it first' END AS stopped
          FROM (SELECT n_nationkey, lower(CASE n_nationkey % 4 WHEN 0 THEN 'chi_sim' WHEN 1 THEN 'Kor' WHEN 2 THEN 'x-CJK' ELSE n_name END) AS l FROM nation)""")
def guards_and_languages(spark, sf_dir):
    """What stops a document, and whether its language calls for a CJK font."""
    k = F.col("n_nationkey")
    language = F.when(k % 4 == 0, "chi_sim").when(k % 4 == 1, "Kor").when(k % 4 == 2, "x-CJK").otherwise(F.col("n_name"))
    return read(spark, sf_dir, "nation").select("n_nationkey", T.is_cjk_language(language).alias("cjk"), T.guard(k % 3, k % 4, k % 2 == 0).alias("stopped"))


@query("""SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN n_name ELSE 'default' END AS value, CASE WHEN n_nationkey % 2 = 0 THEN '-p|-s|' || n_name ELSE '-p|-s' END AS flags,
                 CASE WHEN n_nationkey % 5 = 0 THEN NULL ELSE '<rdf:Description rdf:about="">' || n_name || '</rdf:Description>' END AS first
          FROM nation""")
def settings_and_flags(spark, sf_dir):
    """A setting or its default, an outside program's flags, and the first of several descriptions."""
    from inkspan.plans.settings import setting

    k, name = F.col("n_nationkey"), F.col("n_name")
    settings = F.create_map(F.when(k % 3 == 0, "key").otherwise("other"), name)
    flags = F.concat(F.lit(" -p  -b out -s -b"), F.when(k % 2 == 0, F.concat(F.lit(" x "), F.regexp_replace(name, " ", ""))).otherwise(""))
    about = F.concat(F.lit('<rdf:Description rdf:about="">'), name, F.lit("</rdf:Description>"))
    xmp = F.when(k % 5 == 0, F.lit("<x/>")).otherwise(F.concat(F.lit("<rdf:RDF>"), about, F.lit('<rdf:Description rdf:about="b"/></rdf:RDF>')))
    return read(spark, sf_dir, "nation").select("n_nationkey", setting(settings, F.lit("key"), F.lit("default")).alias("value"), F.array_join(T.program_flags(flags), "|").alias("flags"), T.first_description(xmp).alias("first"))


@query(f"SELECT item_id, nth, word FROM (SELECT item_id, unnest(range(len(w)))::INT AS nth, unnest(w) AS word FROM (SELECT item_id, string_split(text || chr(10) || chr(34) || chr(92) || chr(9), ' ') AS w FROM benchmark))")
def truth_json(spark, sf_dir):
    """Ground truth as JSON, with signs that must be escaped, read back."""
    from inkspan.sources.readers import TRUTH
    from inkspan.sources.sinks import truth_json as written

    rows = read(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("source"), F.lit("t").alias("title"), F.lit(1).alias("page"), F.split(F.concat("text", F.lit('\n"\\\t')), " ").alias("words"))
    back = written(rows).select(F.from_json("json", TRUTH).alias("t"))
    return back.select(F.col("t.source").cast("long").alias("item_id"), F.posexplode(F.col("t.pages")[0]["words"]).alias("nth", "word"))


@query("SELECT p_partkey, floor(0.299::DOUBLE * (p_partkey % 256) + 0.587::DOUBLE * (p_partkey * 7 % 256) + 0.114::DOUBLE * (p_size * 5 % 256) + 0.5)::BIGINT AS gray FROM part")
def library_gray(spark, sf_dir):
    """Gray of recognition's input, by luminance; segmentation has its own integer luma."""
    k = F.col("p_partkey")
    return read(spark, sf_dir, "part").select("p_partkey", G.luminance(k % 256, k * 7 % 256, F.col("p_size") * 5 % 256).alias("gray"))


@query(f"""WITH b AS MATERIALIZED ({BLOBS}), a AS MATERIALIZED (SELECT page, label, avg(x) AS cx, avg(y) AS cy, 0.5 * atan2(2 * covar_pop(x, y), var_pop(x) - var_pop(y)) AS t FROM b GROUP BY ALL HAVING max(x) - min(x) + 1 > 2 * (max(y) - min(y) + 1)),
           e AS (SELECT page, label, cx, cy, t, min((x - cx) * cos(t) + (y - cy) * sin(t)) - 2 AS u0, max((x - cx) * cos(t) + (y - cy) * sin(t)) + 2 AS u1, min((y - cy) * cos(t) - (x - cx) * sin(t)) - 2 AS v0, max((y - cy) * cos(t) - (x - cx) * sin(t)) + 2 AS v1 FROM b JOIN a USING (page, label) GROUP BY ALL)
           SELECT page, label, floor((cx + u0 * cos(t) - v0 * sin(t)) * 2.3::DOUBLE + 0.5)::INT AS x0, floor((cy + u0 * sin(t) + v0 * cos(t)) * 1.7::DOUBLE + 0.5)::INT AS y0, floor((cx + u1 * cos(t) - v1 * sin(t)) * 2.3::DOUBLE + 0.5)::INT AS x2, floor((cy + u1 * sin(t) + v1 * cos(t)) * 1.7::DOUBLE + 0.5)::INT AS y2 FROM e""")
def oriented_polygons(spark, sf_dir):
    """Corners of components more than twice as wide as high, turned along their axis."""
    w, h = F.col("max_x") - F.col("min_x") + 1, F.col("max_y") - F.col("min_y") + 1
    box = recognition.oriented_polygon(F.lit(2), 2.3, 1.7)
    rows = recognition.component_axes(_blobs(spark, sf_dir), ["page", "label"]).where(recognition.elongated(w, h))
    return rows.select("page", "label", *(box["px" if c[0] == "x" else "py"][int(c[1])].alias(c) for c in ("x0", "y0", "x2", "y2")))


@query(f"""SELECT item_id, (nth // 60 + 1)::INT AS page, count(*)::INT AS words, (100 * (1 + nth // 60))::BIGINT AS background, CASE WHEN nth // 60 % 2 = 0 THEN 26::BIGINT END AS mask, NULL::VARCHAR AS error
           FROM ({BOXES}) GROUP BY item_id, nth // 60""")
def pdf_assembly(spark, sf_dir):
    """Documents of several pages with backgrounds and, on every other page, a mask, assembled from tables and read back; sixty words a page."""
    from inkspan.sources.pdf import assembled, pdf_pages

    boxes = _boxes(spark, sf_dir).withColumn("page", F.floor(F.col("nth") / 60).cast("int"))
    picture = lambda w, h, n: F.struct(F.lit(w).alias("width"), h.alias("height"), F.repeat(F.lit("x"), n).cast("binary").alias("data"))
    k = F.col("page") + 1
    pages = boxes.select("item_id", "page").distinct().withColumns({"width": F.lit(612.0), "height": F.lit(792.0), "background": picture(10, 10 * k, 100 * k), "mask": F.when(F.col("page") % 2 == 0, picture(16, F.lit(13), F.lit(26)))})
    return pdf_pages(assembled(boxes, pages, "item_id"), "item_id")


@query(f"SELECT item_id, (nth // 60 + 1)::INT AS page, 2550::INT AS width, 3300::INT AS height, sum(length(word))::BIGINT AS glyphs, (CASE WHEN nth // 60 % 2 = 0 THEN 2 ELSE 1 END)::INT AS pictures, NULL::VARCHAR AS error FROM ({BOXES}) GROUP BY item_id, nth // 60")
def pdf_open(spark, sf_dir):
    """Pages of documents with JPEG backgrounds and fax masks, by the reader of any writer's."""
    from inkspan.sources.pdf import assembled
    from inkspan.sources.pdf_objects import document_pages

    boxes = _boxes(spark, sf_dir).withColumn("page", F.floor(F.col("nth") / 60).cast("int"))
    picture = lambda w, h, n: F.struct(F.lit(w).alias("width"), F.lit(h).alias("height"), F.repeat(F.lit("x"), n).cast("binary").alias("data"))
    pages = boxes.select("item_id", "page").distinct().withColumns({"width": F.lit(612.0), "height": F.lit(792.0), "background": picture(10, 10, 100), "mask": F.when(F.col("page") % 2 == 0, picture(16, 13, 26))})
    return document_pages(assembled(boxes, pages, "item_id", coded=True), "item_id")


@query(f"SELECT page, count(*) AS ink, sum(x + 3 * y)::BIGINT AS mix FROM ({PIXELS}) WHERE gray <= 90 GROUP BY page")
def fax_masks(spark, sf_dir):
    """Ink of each page coded as a fax mask and decoded."""
    from inkspan.sources.codecs import fax_decode, fax_encode

    def kernel(gray):
        y, x = np.nonzero(fax_decode(fax_encode(gray <= 90), gray.shape[1]))
        return {"ink": np.array([len(x)]), "mix": np.array([(x + 3 * y).sum()])}

    return raster.map_pages(_rasters(spark, sf_dir), "page", kernel, "ink long, mix long")


@query("SELECT s_suppkey AS page, 150::INT AS width, 100::INT AS height, 1::INT AS components, TRUE AS whole, TRUE AS narrower FROM supplier")
def jpeg_backgrounds(spark, sf_dir):
    """Each page as JPEG at both qualities: what its frame header says, whether it ends as it must and the lower quality is shorter (its samples are tested with another decoder)."""
    from inkspan.sources.codecs import jpeg_encode
    from inkspan.sources.pdf import QUALITY

    def kernel(gray):
        high, low = (jpeg_encode(gray.astype(np.uint8), q) for q in QUALITY)
        at = high.index(b"\xff\xc0")
        side = lambda k: np.array([int.from_bytes(high[at + k : at + k + 2], "big")], np.int32)
        return {"width": side(7), "height": side(5), "components": np.array([high[at + 9]], np.int32), "whole": np.array([high.endswith(b"\xff\xd9")]), "narrower": np.array([len(low) < len(high)])}

    return raster.map_pages(_rasters(spark, sf_dir), "page", kernel, "width int, height int, components int, whole boolean, narrower boolean")
