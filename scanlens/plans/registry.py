"""Registered queries over the driver's tables, each with an equivalent DuckDB SQL (or none for
rows-only checks). Every query reads whole tables; limits appear only where top-k is the feature.

``QUERIES[name](spark, sf_dir) -> DataFrame`` and ``ORACLE[name] -> str``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import checks, paths, text
from ..functions import predicates as P
from ..operators import search as S
from ..operators import store
from ..session import checkpoint_dir
from ..sources import fixtures as fx
from ..sources.fixtures import with_views
from ..streaming.ingest import ingest_rows
from .index_run import search_index

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return deco


# ---------------------------------------------------------------- SQL helpers (DuckDB side)

def _sql_tf(p: str) -> str:
    # phrases used below cannot overlap themselves, so a replace-and-measure count is exact
    return f"((length(lower(content)) - length(replace(lower(content), '{p}', ''))) // {len(p)})"


def _sql_idf(i: int) -> str:
    x = f"ln((n_rows - df_{i} + 0.5) / (df_{i} + 0.5))"
    return f"(CASE WHEN {x} <= 0 THEN 1e-6 ELSE {x} END)"


def _sql_rank(phrases: list[str]) -> str:
    norm = "(1.2 * (0.25 + 0.75 * greatest(length(content) - 2, 0) / avg_dl))"
    terms = [f"{_sql_idf(i)} * ({_sql_tf(p)} * 2.2) / ({_sql_tf(p)} + {norm})" for i, p in enumerate(phrases)]
    return "-(" + " + ".join(terms) + ")"


def _sql_stats(phrases: list[str]) -> str:
    dfs = ", ".join(f"count(*) FILTER (WHERE contains(lower(content), '{p}')) AS df_{i}" for i, p in enumerate(phrases))
    return f"st AS (SELECT count(*) AS n_rows, avg(greatest(length(content) - 2, 0)) AS avg_dl, {dfs} FROM images)"


def _sql_ranked(phrases: list[str], where: str) -> str:
    return with_views(
        f""", {_sql_stats(phrases)}
SELECT path, modtime, round({_sql_rank(phrases)}, 9) AS rank FROM images, st WHERE {where}""",
        "images",
    ).replace("\n, st AS", ",\nst AS")


def _ranked(df: DataFrame) -> DataFrame:
    return df.select("path", "modtime", F.round("rank", 9).alias("rank"))


# ---------------------------------------------------------------- search

@register("search_simple", _sql_ranked(["tion"], "contains(lower(content), 'tion')"))
def search_simple(spark, sf):
    return _ranked(S.search(fx.images(spark, sf), "tion", limit=None, with_snippet=False))


@register("search_scoped", _sql_ranked(["ther"], "contains(lower(content), 'ther') AND (path = '/lib/en' OR starts_with(path, '/lib/en/'))"))
def search_scoped(spark, sf):
    return _ranked(S.search(fx.images(spark, sf), "ther", root="/lib/en", limit=None, with_snippet=False))


@register("search_excluded", _sql_ranked(["ment"], "contains(lower(content), 'ment') AND NOT regexp_matches(path, '^/lib/de/.*$')"))
def search_excluded(spark, sf):
    return _ranked(S.search(fx.images(spark, sf), "ment", exclude="/lib/de", limit=None, with_snippet=False))


@register("search_prefix_like", _sql_ranked(["ent"], "contains(lower(content), 'ent') AND path ILIKE '/lib/e%' ESCAPE '#'"))
def search_prefix_like(spark, sf):
    return _ranked(S.search(fx.images(spark, sf), "ent", root="/lib/e", prefix_like=True, limit=None, with_snippet=False))


@register("bm25_stats", with_views(
    "SELECT count(*) AS n_rows, round(avg(greatest(length(content) - 2, 0)), 6) AS avg_dl, "
    "count(*) FILTER (WHERE contains(lower(content), 'tion')) AS df_0, "
    "count(*) FILTER (WHERE contains(lower(content), 'ment')) AS df_1 FROM images", "images"))
def bm25_stats(spark, sf):
    st = S.corpus_stats(fx.images(spark, sf), ["tion", "ment"])
    return st.select("n_rows", F.round("avg_dl", 6).alias("avg_dl"), "df_0", "df_1")


@register("bm25_topk", _sql_ranked(["ción"], "contains(lower(content), 'ción')")
          + " ORDER BY rank, modtime DESC, path LIMIT 100")
def bm25_topk(spark, sf):
    return _ranked(S.search(fx.images(spark, sf), "ción", limit=100, with_snippet=False))


@register("match_and", _sql_ranked(["tion", "ment"], "contains(lower(content), 'tion') AND contains(lower(content), 'ment')"))
def match_and(spark, sf):
    return _ranked(S.search(fx.images(spark, sf), P.all_of("tion", "ment"), kind="match", limit=None, with_snippet=False))


@register("match_or", _sql_ranked(["ción", "ung"], "contains(lower(content), 'ción') OR contains(lower(content), 'ung')"))
def match_or(spark, sf):
    return _ranked(S.search(fx.images(spark, sf), P.any_of("ción", "ung"), kind="match", limit=None, with_snippet=False))


@register("match_not", _sql_ranked(["tion", "ment"], "contains(lower(content), 'tion') AND NOT contains(lower(content), 'ment')"))
def match_not(spark, sf):
    return _ranked(S.search(fx.images(spark, sf), P.but_not("tion", "ment"), kind="match", limit=None, with_snippet=False))


def _sql_occurrences(name: str, p: str) -> str:
    """Start positions (1-based) of the non-overlapping occurrences of ``p`` per id, from split pieces."""
    return f"""{name} AS (SELECT id, sum(length(piece)) OVER (PARTITION BY id ORDER BY k) + (k - 1) * {len(p)} + 1 AS pos, k, n
  FROM (SELECT id, unnest(parts) AS piece, unnest(range(1, len(parts) + 1)) AS k, len(parts) AS n
        FROM (SELECT id, string_split(lower(content), '{p}') AS parts FROM images)))"""


def _sql_near(a: str, b: str, n: int) -> str:
    ka, kb = n + len(a) - 2, n + len(b) - 2
    return (with_views(",\n" + _sql_stats([a, b]) + ",\n" + _sql_occurrences("oa", a) + ",\n" + _sql_occurrences("ob", b)
                       + f""",
near_ids AS (SELECT DISTINCT oa.id FROM oa JOIN ob ON oa.id = ob.id AND oa.k < oa.n AND ob.k < ob.n
  AND ob.pos - oa.pos BETWEEN -{kb} AND {ka})
SELECT path, modtime, round({_sql_rank([a, b])}, 9) AS rank FROM images, st WHERE id IN (SELECT id FROM near_ids)""", "images"))


@register("match_near", _sql_near("the", "and", 2))
def match_near(spark, sf):
    return _ranked(S.search(fx.images(spark, sf), P.near("the", "and", 2), kind="match", limit=None, with_snippet=False))


@register("match_starts", _sql_ranked(["die"], "starts_with(lower(content), 'die')"))
def match_starts(spark, sf):
    return _ranked(S.search(fx.images(spark, sf), P.starts_with("die"), kind="match", limit=None, with_snippet=False))


@register("search_glob", with_views(
    "SELECT path, modtime FROM images WHERE content GLOB '[!E]*ment?*'", "images"))
def search_glob(spark, sf):
    return S.search(fx.images(spark, sf), "[^E]*ment?*", kind="glob", limit=None, with_snippet=False).select("path", "modtime")


@register("search_glob_range", with_views("SELECT path, modtime FROM images WHERE content GLOB '[A-Z]*tion*'", "images"))
def search_glob_range(spark, sf):
    return S.search(fx.images(spark, sf), "[A-Z]*tion*", kind="glob", limit=None, with_snippet=False).select("path", "modtime")


@register("search_regex", with_views(
    "SELECT path, modtime FROM images WHERE regexp_matches(content, '(qu|ch)[a-zé]+ment|[a-z]{3}\\.$')", "images"))
def search_regex(spark, sf):
    return S.search(fx.images(spark, sf), r"(qu|ch)[a-zé]+ment|[a-z]{3}\.$", kind="regex", limit=None, with_snippet=False).select("path", "modtime")


def _sql_snippets(phrases: list[str], source: str = "images", tokens: int = 64) -> str:
    """CTEs ``hits`` .. ``snips`` (id, snippet), written from the rule: candidate windows as rows, the
    best by score then order, marks from a set of covered positions. ``source`` has id, content."""
    ph = " UNION ALL ".join(f"SELECT {k} AS k, '{p}' AS p" for k, p in enumerate(phrases))
    return rf"""src AS (SELECT id, content, lower(content) AS f, length(content) AS n FROM {source}),
ph AS ({ph}),
hits AS (SELECT id, n, k, length(p) AS len, unnest(list_filter(range(n), lambda i: substring(f, i + 1, length(p)) = p)) AS pos FROM src, ph WHERE contains(f, p)),
pieces AS (SELECT id, unnest(ps) AS piece, unnest(range(len(ps))) AS j FROM (SELECT id, regexp_extract_all(content, '(?s).*?[.:][ \t\n\r]+') AS ps FROM src)),
sent AS (SELECT id, 0 AS s FROM src UNION SELECT id, CAST(sum(length(piece)) OVER (PARTITION BY id ORDER BY j) AS BIGINT) FROM pieces),
ord AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY pos, k) AS o FROM hits),
bysent AS (SELECT o.id, o.n, o.o, max(s.s) AS start, o.pos FROM ord o JOIN sent s ON s.id = o.id AND s.s <= o.pos GROUP BY ALL),
cand AS (SELECT id, n, pos AS start, 0 AS bonus, true AS centre, 2 * o AS rnk FROM ord
  UNION ALL SELECT id, n, start, CASE WHEN start = 0 THEN 120 ELSE 100 END, false, 2 * o + 1 FROM bysent WHERE start < pos AND greatest(n - 2, 0) > {tokens}),
scored AS (SELECT c.id, c.n, c.start, c.centre, c.rnk, count(DISTINCT h.k) * 1000 + (count(*) - count(DISTINCT h.k)) + c.bonus AS score,
    min(h.pos) AS p0, max_by(h.pos + h.len - 2, h.pos * 100 + h.k) AS p1
  FROM cand c JOIN hits h ON h.id = c.id AND h.pos BETWEEN c.start AND c.start + {tokens - 1} GROUP BY c.id, c.n, c.start, c.centre, c.rnk, c.bonus),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, rnk) = 1),
adj AS (SELECT id, n, CASE WHEN NOT centre THEN start
  ELSE greatest(least(p0 - CAST(trunc(({tokens} - (p1 - p0)) / 2.0) AS BIGINT), greatest(n - 2, 0) - {tokens}), 0) END AS a FROM best),
covered AS (SELECT DISTINCT id, unnest(range(pos, pos + len)) AS i FROM hits),
spots AS (SELECT id, a, n, unnest(range(a, least(a + {tokens + 2}, n))) AS i FROM adj),
flags AS (SELECT p.id, p.a, p.n, p.i, substring(s.content, p.i + 1, 1) AS ch, v.i IS NOT NULL AS cov
  FROM spots p JOIN src s ON s.id = p.id LEFT JOIN covered v ON v.id = p.id AND v.i = p.i),
edges AS (SELECT *, coalesce(lag(cov) OVER (PARTITION BY id ORDER BY i), false) AS prev, coalesce(lead(cov) OVER (PARTITION BY id ORDER BY i), false) AS nxt FROM flags),
snips AS (SELECT id, concat(CASE WHEN any_value(a) > 0 THEN '..' ELSE '' END,
  string_agg(concat(CASE WHEN cov AND NOT prev THEN '[' ELSE '' END, ch, CASE WHEN cov AND NOT nxt THEN ']' ELSE '' END), '' ORDER BY i),
  CASE WHEN any_value(a) + {tokens} >= greatest(any_value(n) - 2, 0) THEN '' ELSE '..' END) AS snippet FROM edges GROUP BY id)"""


def _sql_search_snippets(phrases: list[str], where: str) -> str:
    return (with_views(f", {_sql_stats(phrases)},\n{_sql_snippets(phrases, f'(SELECT * FROM images WHERE {where})')}\n"
                       f"SELECT s.snippet, path, modtime, round({_sql_rank(phrases)}, 9) AS rank FROM images JOIN snips s USING (id), st WHERE {where}", "images")
            .replace("\n, st AS", ",\nst AS"))


@register("snippet", _sql_search_snippets(["tion"], "contains(lower(content), 'tion')"))
def snippet_q(spark, sf):
    r = S.search(fx.images(spark, sf), "tion", limit=None)
    return r.select("snippet", "path", "modtime", F.round("rank", 9).alias("rank"))


@register("snippet_two_phrases", _sql_search_snippets(["tion", "ions"], "(contains(lower(content), 'tion') OR contains(lower(content), 'ions'))"))
def snippet_two_phrases(spark, sf):
    """Two phrases that overlap each other in one word."""
    r = S.search(fx.images(spark, sf), P.any_of("tion", "ions"), kind="match", limit=None)
    return r.select("snippet", "path", "modtime", F.round("rank", 9).alias("rank"))


@register("snippet_self_overlap", with_views(",\n" + _sql_snippets(["ere"], "(SELECT id, replace(content, 'er', 'erer') AS content FROM images)")
                                             + "\nSELECT id, snippet FROM snips", "images").replace("\n,\nsrc AS", ",\nsrc AS"))
def snippet_self_overlap(spark, sf):
    """A phrase that overlaps itself, in texts where it does."""
    im = fx.images(spark, sf).withColumn("content", F.replace("content", F.lit("er"), F.lit("erer")))
    rows = im.where(P.phrase("ere").predicate(text.fold("content"))).select("id", "content")
    return S.with_snippet_column(rows, ["ere"]).select("id", "snippet")


# inputs on which an incomplete escaping shows: soft hyphens, zero-width and line separators, quotes, tabs
_SPECIAL = [("a", 0xAD), ("o", 0x200B), ("q", 0xFEFF), ("z", 0x2028), ("v", 9), ("k", 0x85), (",", 0x22), (";", 0xA0), ("x", 0x27), ("j", 0x5C)]


def _sql_special(expr: str) -> str:
    for raw, point in _SPECIAL:
        expr = f"replace({expr}, '{raw}', chr({point}))"
    return expr


def _special(c):
    c = F.col(c)
    for raw, point in _SPECIAL:
        c = F.replace(c, F.lit(raw), F.lit(chr(point)))
    return c


def _sql_escape(expr: str) -> str:
    """Escape by code point number and general category, one code point at a time."""
    return rf"""array_to_string(list_transform(regexp_extract_all({expr}, '(?s).'), lambda ch: CASE unicode(ch)
  WHEN 92 THEN '\\' WHEN 9 THEN '\t' WHEN 13 THEN '\r' WHEN 10 THEN '\n' WHEN 39 THEN concat('\', chr(39)) WHEN 34 THEN '\"' WHEN 0 THEN '\0'
  WHEN 32 THEN ' ' ELSE CASE WHEN regexp_matches(ch, '[\p{{Cc}}\p{{Cf}}\p{{Co}}\p{{Zs}}\p{{Zl}}\p{{Zp}}]')
  THEN concat('\u{{', format('{{:x}}', unicode(ch)), '}}') ELSE ch END END), '')"""


@register("escape_debug", with_views(f"SELECT id, {_sql_escape(_sql_special('content'))} AS escaped FROM images", "images"))
def escape_debug_q(spark, sf):
    return fx.images(spark, sf).select("id", text.escape_debug(_special("content")).alias("escaped"))


@register("result_lines", "SELECT concat(" + _sql_escape("snippet") + ", chr(9), path) AS line FROM ("
          + _sql_search_snippets(["ción"], "contains(lower(content), 'ción')") + " ORDER BY rank, modtime DESC, path LIMIT 100)")
def result_lines_q(spark, sf):
    return S.result_lines(S.search(fx.images(spark, sf), "ción", limit=100))


# texts whose folding depends on context or length in a plain lower-casing
_FOLD_TAILS = ["ΟΔΟΣΑ", "οδός ΟΔΟΣ", "İstanbul İ", "ΌΣΟΣ", "𐐀𐐁 ΟΔΟΣ", ""]


def _sql_fold(e: str) -> str:
    return f"lower(translate({e}, 'Σςİ', 'σσi'))"


@register("search_fold", with_views(f""",
t AS (SELECT id, concat(content, ' ', CASE CAST(id % 6 AS INT) {' '.join(f"WHEN {k} THEN '{v}'" for k, v in enumerate(_FOLD_TAILS))} END) AS c FROM images),
f AS (SELECT id, {_sql_fold('c')} AS f, length(c) AS n FROM t)
SELECT id, contains(f, 'οδοσ') AS odos, contains(f, 'istanbul') AS istanbul, contains(f, '𐐩 ο') AS deseret, length(f) = n AS same_length,
  CAST((length(f) - length(replace(f, 'οσ', ''))) // 2 AS INT) AS n_os FROM f""", "images").replace("\n,\nt AS", ",\nt AS"))
def search_fold(spark, sf):
    im = fx.images(spark, sf)
    tail = F.element_at(F.array(*[F.lit(v) for v in _FOLD_TAILS]), (F.col("id") % 6).cast("int") + 1)
    f = text.fold("c")
    t = im.select("id", F.concat("content", F.lit(" "), tail).alias("c"))
    return t.select("id", P.phrase("ΟΔΟΣ").predicate(f).alias("odos"), P.phrase("İSTANBUL").predicate(f).alias("istanbul"),
                    P.phrase("𐐁 ο").predicate(f).alias("deseret"), (F.length(f) == F.length("c")).alias("same_length"),
                    ((F.length(f) - F.length(F.replace(f, text.fold_literal("ΟΣ"), F.lit("")))) / 2).cast("int").alias("n_os"))


@register("search_words", _sql_ranked(["of the"], "contains(lower(content), 'of the')"))
def search_words(spark, sf):
    """Several words of the ``simple`` kind are one phrase."""
    return _ranked(S.search(fx.images(spark, sf), ["of", "the"], limit=None, with_snippet=False))


def _in_order(df: DataFrame) -> DataFrame:
    """Rows (a caller's limit of them) with their place in the result."""
    spark, rows = df.sparkSession, df.collect()
    return spark.createDataFrame([(k + 1, r.path, r.modtime) for k, r in enumerate(rows)], "place int, path string, modtime long")


@register("glob_order", with_views("SELECT CAST(row_number() OVER (ORDER BY modtime DESC, path) AS INT) AS place, path, modtime FROM images "
                                   "WHERE content GLOB '*ment?*' QUALIFY place <= 100", "images"))
def glob_order(spark, sf):
    """The first 100 glob hits, newest first, with their places."""
    return _in_order(S.search(fx.images(spark, sf), "*ment?*", kind="glob", limit=100, with_snippet=False))


# ---------------------------------------------------------------- paths and listing filters

_EXT_SQL = "regexp_extract(path, '\\.([^./]+)$', 1) IN ('png', 'jpeg', 'jpg', 'gif', 'webp')"


@register("ext_filter", with_views(f"SELECT id, path FROM images WHERE {_EXT_SQL}", "images"))
def ext_filter(spark, sf):
    im = fx.images(spark, sf)
    return im.where(paths.has_allowed_extension("path")).select("id", "path")


_EXCL_SQL = ("regexp_matches(path, '^/lib(/.*)?/\\.cache(/.*)?$') OR regexp_matches(path, '^/lib(/.*)?/\\.thumb[^/]*(/.*)?$') "
             "OR regexp_matches(path, '^/lib(/.*)?/a_b(/.*)?$')")


@register("exclude_prune", with_views(f"SELECT id, path FROM images WHERE NOT ({_EXCL_SQL})", "images"))
def exclude_prune(spark, sf):
    im = fx.images(spark, sf)
    return im.where(~paths.excluded("path", "/lib", paths.exclude_patterns(["a_b"]))).select("id", "path")


@register("scan_limit", with_views(
    f"SELECT path FROM scan WHERE {_EXT_SQL} AND NOT ({_EXCL_SQL.replace('OR regexp_matches(path, ' + chr(39) + '^/lib(/.*)?/a_b(/.*)?$' + chr(39) + ')', '')}) "
    "ORDER BY path LIMIT 100", "scan"))
def scan_limit(spark, sf):
    sc = fx.scan_from_images(fx.images(spark, sf))
    kept = sc.where(paths.has_allowed_extension("path") & ~paths.excluded("path", "/lib", paths.exclude_patterns()))
    return kept.select("path").orderBy("path").limit(100)


@register("depth_one", with_views(
    "SELECT id, path FROM images WHERE regexp_extract(path, '^(.*)/[^/]*$', 1) = '/lib/en/src1'", "images"))
def depth_one(spark, sf):
    im = fx.images(spark, sf)
    return im.where(paths.at_depth_one("path", "/lib/en/src1")).select("id", "path")


@register("dim_filter", with_views(
    "SELECT s.id, s.path, s.width, s.height FROM scan s ANTI JOIN indexed i ON s.path = i.path AND s.modtime = i.modtime "
    "WHERE s.width <= 2000 AND s.height <= 3000", "scan", "indexed"))
def dim_filter(spark, sf):
    im = fx.images(spark, sf)
    todo = store.changed_files(fx.scan_from_images(im), fx.indexed_from_images(im))
    return todo.where(checks.within_size("width", "height", "2000x3000")).select("id", "path", "width", "height")


_LANG_CODE_SQL = ("CASE CAST(doc_id % 5 AS INT) WHEN 0 THEN lang || 'g' WHEN 1 THEN upper(lang) || 'x' WHEN 2 THEN lang "
                  "WHEN 3 THEN lang || '/' ELSE 'é' || lang END")


@register("lang_check", f"""SELECT doc_id, code, octet_length(encode(code)) = 3 AND regexp_matches(code, '^[\\x00-\\x7F]*$')
  AND NOT regexp_matches(code, '[./\\\\]') AS ok,
  CASE WHEN octet_length(encode(code)) = 3 AND regexp_matches(code, '^[\\x00-\\x7F]*$') AND NOT regexp_matches(code, '[./\\\\]')
  THEN lower(code) END AS normalised FROM (SELECT doc_id, {_LANG_CODE_SQL} AS code FROM documents)""")
def lang_check(spark, sf):
    d = fx.load(spark, sf, "documents")
    m = (F.col("doc_id") % 5).cast("int")
    code = (F.when(m == 0, F.concat("lang", F.lit("g"))).when(m == 1, F.concat(F.upper("lang"), F.lit("x")))
            .when(m == 2, F.col("lang")).when(m == 3, F.concat("lang", F.lit("/"))).otherwise(F.concat(F.lit("é"), "lang")))
    c = d.select("doc_id", code.alias("code"))
    return c.select("doc_id", "code", checks.lang_ok("code").alias("ok"), checks.lang_normalised("code").alias("normalised"))


# ---------------------------------------------------------------- text clean-up

@register("blacklist", with_views("SELECT id, translate(content, 'aeiou', '') AS content FROM images", "images"))
def blacklist(spark, sf):
    return fx.images(spark, sf).select("id", text.strip_chars("content", "aeiou").alias("content"))


@register("whitelist", with_views("SELECT id, regexp_replace(content, '[^a-zA-Z\\s]', '', 'g') AS content FROM images", "images"))
def whitelist(spark, sf):
    return fx.images(spark, sf).select("id", text.keep_only("content", "a-zA-Z").alias("content"))


@register("blank_lines", with_views(
    "SELECT id, replace(replace(content, '.', chr(10) || chr(10)), chr(10) || chr(10), chr(10)) AS content FROM images", "images"))
def blank_lines(spark, sf):
    im = fx.images(spark, sf)
    # sentence ends become blank lines first, so the collapse has work to do
    return im.select("id", text.collapse_blank_lines(F.replace("content", F.lit("."), F.lit("\n\n"))).alias("content"))


# ---------------------------------------------------------------- checks

_BUF_SQL_INPUTS = ("greatest(CAST(width * (id % 4) AS BIGINT) * height - (id % 3), 0) AS len, width AS w, height AS h, "
                   "CAST(id % 4 AS INT) AS bpp, CAST(width * (id % 4) + (id % 5) - 2 AS INT) AS bpl")


@register("buffer_check", with_views(f"""SELECT id, CASE WHEN ((CAST(h AS BIGINT) * bpl + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648 < 0 THEN 'exceeds memory'
  WHEN CAST(h AS BIGINT) * bpl > len THEN 'exceeds image size'
  WHEN bpp = 0 AND w > CAST(bpl AS BIGINT) * 8 THEN 'exceeds line'
  WHEN bpp <> 0 AND CAST(w AS BIGINT) * bpp > bpl THEN 'exceeds line' ELSE 'ok' END AS status
  FROM (SELECT id, {_BUF_SQL_INPUTS} FROM images)""", "images"))
def buffer_check(spark, sf):
    im = fx.images(spark, sf)
    x = im.select(
        "id",
        F.greatest((F.col("width") * (F.col("id") % 4)).cast("long") * F.col("height") - F.col("id") % 3, F.lit(0)).alias("len"),
        F.col("width").alias("w"), F.col("height").alias("h"),
        (F.col("id") % 4).cast("int").alias("bpp"),
        (F.col("width") * (F.col("id") % 4) + F.col("id") % 5 - 2).cast("int").alias("bpl"),
    )
    return x.select("id", checks.buffer_check("len", "w", "h", "bpp", "bpl").alias("status"))


@register("dpi_fallback", with_views(
    "SELECT id, CASE WHEN d BETWEEN 70 AND 2400 THEN d ELSE 300 END AS dpi FROM (SELECT id, (id * 13) % 3000 - 100 AS d FROM images)", "images"))
def dpi_fallback(spark, sf):
    im = fx.images(spark, sf)
    return im.select("id", checks.dpi_or_fallback((F.col("id") * 13) % 3000 - 100, 300).alias("dpi"))


@register("box_valid", with_views(
    'SELECT image_id, block, line, word FROM words WHERE width - 24 >= 0 AND height - (word % 3) * 10 >= 0', "words"))
def box_valid(spark, sf):
    w = fx.words(spark, sf)
    return w.where(checks.box_is_valid(F.col("width") - 24, F.col("height") - (F.col("word") % 3) * 10)).select(
        "image_id", "block", "line", "word")


# ---------------------------------------------------------------- store

@register("changed_files", with_views(
    "SELECT s.id, s.path, s.modtime FROM scan s ANTI JOIN indexed i ON s.path = i.path AND s.modtime = i.modtime", "scan", "indexed"))
def changed_files(spark, sf):
    im = fx.images(spark, sf)
    return store.changed_files(fx.scan_from_images(im), fx.indexed_from_images(im)).select("id", "path", "modtime")


@register("unchanged_files", with_views(
    "SELECT s.id, s.path, s.modtime FROM scan s SEMI JOIN indexed i ON s.path = i.path AND s.modtime = i.modtime", "scan", "indexed"))
def unchanged_files(spark, sf):
    im = fx.images(spark, sf)
    return store.unchanged_files(fx.scan_from_images(im), fx.indexed_from_images(im)).select("id", "path", "modtime")


_UPSERT_SQL = """res AS (SELECT s.path, s.modtime, s.content FROM scan s ANTI JOIN indexed i ON s.path = i.path AND s.modtime = i.modtime),
merged AS (
  SELECT i.id, i.path, i.modtime, i.content FROM indexed i ANTI JOIN res r ON i.path = r.path
  UNION ALL SELECT i.id, r.path, r.modtime, r.content FROM res r JOIN indexed i ON i.path = r.path
  UNION ALL SELECT (SELECT max(id) FROM indexed) + row_number() OVER (ORDER BY r.path) AS id, r.path, r.modtime, r.content
    FROM res r ANTI JOIN indexed i ON i.path = r.path)"""


def _upserted(spark, sf):
    im = fx.images(spark, sf)
    sc, ix = fx.scan_from_images(im), fx.indexed_from_images(im)
    res = store.changed_files(sc, ix)
    return sc, ix, store.upsert(ix.select("id", "path", "modtime", "content"), res)


@register("upsert", with_views(", " + _UPSERT_SQL + "\nSELECT id, path, modtime, md5(content) AS content_md5 FROM merged", "scan", "indexed").replace("\n, res AS", ",\nres AS"))
def upsert(spark, sf):
    _, _, merged = _upserted(spark, sf)
    return merged.select("id", "path", "modtime", F.md5("content").alias("content_md5"))


_KEPT_SQL = f"kept AS (SELECT path FROM scan WHERE {_EXT_SQL} AND NOT ({_EXCL_SQL}))"


@register("cleanup", with_views(", " + _UPSERT_SQL + ",\n" + _KEPT_SQL + """
SELECT id, path, modtime FROM merged WHERE NOT (path = '/lib' OR starts_with(path, '/lib/'))
UNION ALL SELECT id, path, modtime FROM merged m SEMI JOIN kept k ON m.path = k.path
WHERE (m.path = '/lib' OR starts_with(m.path, '/lib/'))""", "scan", "indexed").replace("\n, res AS", ",\nres AS"))
def cleanup(spark, sf):
    sc, _, merged = _upserted(spark, sf)
    kept = _kept_paths(sc)
    return store.cleanup(merged, kept, "/lib").select("id", "path", "modtime")


def _kept_paths(scan_df: DataFrame) -> DataFrame:
    return scan_df.where(paths.has_allowed_extension("path") & ~paths.excluded("path", "/lib", paths.exclude_patterns(["a_b"])))


@register("change_counts", with_views(",\n" + _KEPT_SQL + """
SELECT count(*) FILTER (WHERE i.modtime IS NULL) AS n_new,
  count(*) FILTER (WHERE i.modtime IS NOT NULL AND i.modtime <> s.modtime) AS n_changed,
  count(*) FILTER (WHERE i.modtime = s.modtime) AS n_unchanged,
  (SELECT count(*) FROM indexed x WHERE (x.path = '/lib' OR starts_with(x.path, '/lib/')) AND x.path NOT IN (SELECT path FROM kept)) AS n_deleted,
  count(*) FILTER (WHERE i.modtime IS NULL) + count(*) FILTER (WHERE i.modtime IS NOT NULL AND i.modtime <> s.modtime) AS rows_written
FROM scan s LEFT JOIN indexed i ON s.path = i.path""", "scan", "indexed").replace("\n,\nkept AS", ",\nkept AS"))
def change_counts(spark, sf):
    im = fx.images(spark, sf)
    sc, ix = fx.scan_from_images(im), fx.indexed_from_images(im)
    return store.change_counts(sc, ix, _kept_paths(sc), "/lib")


# ---------------------------------------------------------------- grams and the postings plan

from ..operators import grams as G  # noqa: E402

_SQL_GRAMS = """g AS (SELECT id, unnest(list_transform(range(1, length(f) - 1), lambda i: substring(f, i, 3))) AS gram
  FROM (SELECT id, lower(content) AS f FROM images) WHERE length(f) >= 3)"""


@register("gram_postings", with_views(",\n" + _SQL_GRAMS + "\nSELECT gram, id, CAST(count(*) AS INT) AS tf FROM g GROUP BY gram, id", "images").replace("\n,\ng AS", ",\ng AS"))
def gram_postings(spark, sf):
    return G.postings(fx.images(spark, sf))


@register("gram_df", with_views(",\n" + _SQL_GRAMS + "\nSELECT gram, count(DISTINCT id) AS df FROM g GROUP BY gram", "images").replace("\n,\ng AS", ",\ng AS"))
def gram_df(spark, sf):
    return G.gram_document_frequency(G.postings(fx.images(spark, sf)))


@register("doc_lengths", with_views("SELECT id, CAST(greatest(length(content) - 2, 0) AS INT) AS dl FROM images", "images"))
def doc_lengths(spark, sf):
    return G.doc_stats(fx.images(spark, sf))


def _store(spark) -> store.IndexStore:
    return store.IndexStore(spark, f"{checkpoint_dir(spark)}/scanlens-store-{uuid.uuid4().hex}")


def _stored(spark, sf) -> store.IndexStore:
    """F1 committed to a new store: rows and postings as files."""
    st = _store(spark)
    st.commit(fx.images(spark, sf).select("id", "path", "modtime", "content"))
    return st


@register("postings_search", ORACLE["search_simple"])
def postings_search(spark, sf):
    return _ranked(search_index(_stored(spark, sf), "tion", limit=None, with_snippet=False))


@register("bm25_topk_bounds", ORACLE["bm25_topk"])
def bm25_topk_bounds(spark, sf):
    """Top 100 from stored postings: only blocks whose best rank reaches the 100th are read."""
    return _ranked(search_index(_stored(spark, sf), "ción", limit=100, with_snippet=False))


@register("bm25_topk_scoped", _sql_ranked(["ent"], "contains(lower(content), 'ent') AND (path = '/lib/de' OR starts_with(path, '/lib/de/'))")
          + " ORDER BY rank, modtime DESC, path LIMIT 20")
def bm25_topk_scoped(spark, sf):
    """Top 20 of a scope that few of the best hits are in: several waves of blocks."""
    return _ranked(search_index(_stored(spark, sf), "ent", root="/lib/de", limit=20, with_snippet=False))


@register("postings_match", ORACLE["match_and"])
def postings_match(spark, sf):
    return _ranked(search_index(_stored(spark, sf), P.all_of("tion", "ment"), kind="match", limit=None, with_snippet=False))


@register("postings_glob", with_views("SELECT path, modtime FROM images WHERE content GLOB '*ción*[a-m]ado*'", "images"))
def postings_glob(spark, sf):
    """A content glob whose literal runs are looked up in the stored postings."""
    return search_index(_stored(spark, sf), "*ción*[a-m]ado*", kind="glob", limit=None, with_snippet=False).select("path", "modtime")


@register("postings_phrase", with_views("SELECT id, CAST((length(f) - length(replace(f, 'the of', ''))) / 6 AS INT) AS hits, CAST(instr(f, 'the of') - 1 AS INT) AS first "
                                        "FROM (SELECT id, lower(content) AS f FROM images) WHERE contains(f, 'the of')", "images"))
def postings_phrase(spark, sf):
    """Places of a phrase from stored gram positions: number and first place, no text read."""
    found = G.phrase_places(_stored(spark, sf).positions(None, ["the of"]), ["the of"])
    return found.select("id", F.size("s_0").alias("hits"), F.element_at("s_0", 1).alias("first"))


@register("postings_near", ORACLE["match_near"])
def postings_near(spark, sf):
    return _ranked(search_index(_stored(spark, sf), P.near("the", "and", 2), kind="match", limit=None, with_snippet=False))


@register("postings_regex", with_views("SELECT path, modtime FROM images WHERE regexp_matches(content, '(qu|ch)[a-z]+ment|[Ll]icen[cs]ed under')", "images"))
def postings_regex(spark, sf):
    """A regex whose alternatives and classes are looked up in the stored postings."""
    return search_index(_stored(spark, sf), "(qu|ch)[a-z]+ment|[Ll]icen[cs]ed under", kind="regex", limit=None, with_snippet=False).select("path", "modtime")


def _delta_store(spark, sf) -> store.IndexStore:
    """F4 committed whole, then F3 over it as one incremental commit: changed and new rows, deletions."""
    im = fx.images(spark, sf)
    sc, ix = fx.scan_from_images(im), fx.indexed_from_images(im)
    st = _store(spark)
    st.commit(ix.select("id", "path", "modtime", "content"))
    before = st.current()
    st.commit_delta(store.changed_files(sc, before), store.deleted_paths(before, sc, "/lib"))
    return st


_DELTA_SQL = _UPSERT_SQL + """,
live AS (SELECT m.* FROM merged m SEMI JOIN scan s ON m.path = s.path)"""


@register("commit_delta", with_views(", " + _DELTA_SQL + "\nSELECT id, path, modtime, md5(content) AS content_md5 FROM live", "scan", "indexed").replace("\n, res AS", ",\nres AS"))
def commit_delta(spark, sf):
    return _delta_store(spark, sf).current().select("id", "path", "modtime", F.md5("content").alias("content_md5"))


@register("postings_upkeep", with_views(", " + _DELTA_SQL + """,
g AS (SELECT id, unnest(list_transform(range(1, length(f) - 1), lambda i: substring(f, i, 3))) AS gram
  FROM (SELECT id, lower(content) AS f FROM live) WHERE length(f) >= 3)
SELECT gram, id, CAST(count(*) AS INT) AS tf FROM g GROUP BY gram, id""", "scan", "indexed").replace("\n, res AS", ",\nres AS"))
def postings_upkeep(spark, sf):
    """Postings after an incremental commit: those of the merged rows."""
    return _delta_store(spark, sf).postings()


def _hit_ids(spark, sf, a: str, b: str, op: str) -> DataFrame:
    """E1 on id sets: candidates from stored postings, verified on the text, then a set operation."""
    st = _stored(spark, sf)
    im, post = st.current(), st.positions(None, [a, b], with_pos=False).select("gram", "id", "tf")
    f = text.fold("content")

    def hits(p):
        return im.join(G.candidates(post, p), "id", "left_semi").where(P.phrase(p).predicate(f)).select("id")

    ha, hb = hits(a), hits(b)
    return {"and": ha.intersect(hb), "or": ha.union(hb).distinct(), "not": ha.subtract(hb)}[op]


@register("hits_intersect", with_views("SELECT id FROM images WHERE contains(lower(content), 'tion') INTERSECT SELECT id FROM images WHERE contains(lower(content), 'ung')", "images"))
def hits_intersect(spark, sf):
    return _hit_ids(spark, sf, "tion", "ung", "and")


@register("hits_union", with_views("SELECT id FROM images WHERE contains(lower(content), 'ción') UNION SELECT id FROM images WHERE contains(lower(content), 'ung')", "images"))
def hits_union(spark, sf):
    return _hit_ids(spark, sf, "ción", "ung", "or")


@register("hits_except", with_views("SELECT id FROM images WHERE contains(lower(content), 'tion') EXCEPT SELECT id FROM images WHERE contains(lower(content), 'ment')", "images"))
def hits_except(spark, sf):
    return _hit_ids(spark, sf, "tion", "ment", "not")


# ---------------------------------------------------------------- layout

from ..operators import layout as L  # noqa: E402


def _pages(spark, sf) -> DataFrame:
    return fx.sizes(spark, sf).select("image_id", F.lit(1).alias("page"), F.col("width").alias("page_width"),
                                      F.col("height").alias("page_height"))


_PAGES_SQL = "pages AS (SELECT id AS image_id, 1 AS page, width AS page_width, height AS page_height FROM images)"
_LINES_SQL = """lines AS (SELECT image_id, page, block, par, line, string_agg(text, ' ' ORDER BY word) AS text,
  sum(conf) AS cs, count(*) AS n FROM words GROUP BY image_id, page, block, par, line)"""


def _layout_sql(sql: str, *ctes: str) -> str:
    base = with_views("", "images", "words").rstrip("\n")
    return base + "".join(",\n" + c for c in ctes) + "\n" + sql


@register("mean_conf", with_views("SELECT image_id, page, CAST(floor(avg(conf)) AS INT) AS mean_conf FROM words GROUP BY image_id, page", "words"))
def mean_conf(spark, sf):
    return L.mean_conf(fx.words(spark, sf))


@register("word_confs", with_views(
    "SELECT image_id, page, string_agg(CAST(conf AS VARCHAR), ',' ORDER BY block, par, line, word) AS confs FROM words GROUP BY image_id, page", "words"))
def word_confs(spark, sf):
    return L.word_confs(fx.words(spark, sf)).select("image_id", "page", F.array_join("confs", ",").alias("confs"))


def _boxes_sql(keys: str) -> str:
    return with_views(f"""SELECT image_id, page, {keys}, min("left") AS "left", min(top) AS top,
  max("left" + width) - min("left") AS width, max(top + height) - min(top) AS height, count(*) AS n_words
  FROM words GROUP BY image_id, page, {keys}""", "words")


@register("line_boxes", _boxes_sql("block, par, line"))
def line_boxes(spark, sf):
    return L.component_boxes(fx.words(spark, sf), "textline")


@register("block_boxes", _boxes_sql("block"))
def block_boxes(spark, sf):
    return L.regions(fx.words(spark, sf))


@register("para_boxes", _boxes_sql("block, par"))
def para_boxes(spark, sf):
    return L.component_boxes(fx.words(spark, sf), "para")


@register("word_boxes", _boxes_sql("block, par, line, word"))
def word_boxes(spark, sf):
    return L.component_boxes(fx.words(spark, sf), "word")


@register("symbol_boxes_level", with_views("""SELECT image_id, page, block, par, line, word, CAST(i AS INT) AS symbol,
  CAST("left" + floor(i * width / n) AS BIGINT) AS "left", top, CAST(floor((i + 1) * width / n) - floor(i * width / n) AS BIGINT) AS width, height,
  CAST(1 AS BIGINT) AS n_words FROM (SELECT *, length(text) AS n, unnest(range(length(text))) AS i FROM words)""", "words"))
def symbol_boxes_level(spark, sf):
    return L.component_boxes(fx.words(spark, sf), "symbol")


@register("page_text", _layout_sql(
    "SELECT image_id, page, string_agg(text || chr(10), '' ORDER BY block, par, line) AS text FROM lines GROUP BY image_id, page", _LINES_SQL))
def page_text(spark, sf):
    return L.page_text(fx.words(spark, sf))


@register("region_text", _layout_sql("""SELECT image_id, page, region, string_agg(lt, '' ORDER BY block, par, line) AS text,
  CAST(floor(sum(cs) / sum(n)) AS INT) AS mean_conf, sum(n) AS n_words FROM (
  SELECT w.image_id, w.page, r.region, w.block, w.par, w.line, string_agg(w.text, ' ' ORDER BY w.word) || chr(10) AS lt,
    sum(w.conf) AS cs, count(*) AS n
  FROM words w JOIN regions r ON w.image_id = r.image_id AND w.page = r.page
  WHERE w."left" >= r.x AND w.top >= r.y AND w."left" + w.width <= r.x + r.w AND w.top + w.height <= r.y + r.h
  GROUP BY w.image_id, w.page, r.region, w.block, w.par, w.line) GROUP BY image_id, page, region""",
    "regions AS (SELECT id AS image_id, 1 AS page, k AS region, 50 * (k - 1) AS x, 60 * (k - 1) AS y, width AS w, 100 * k AS h "
    "FROM images, (SELECT unnest([1, 2, 3]) AS k))"))
def region_text(spark, sf):
    """Three regions per page that overlap each other."""
    k = F.col("region")
    reg = fx.sizes(spark, sf).withColumn("region", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)))).select(
        "image_id", F.lit(1).alias("page"), "region", (50 * (k - 1)).alias("x"), (60 * (k - 1)).alias("y"),
        F.col("width").alias("w"), (100 * k).alias("h"))
    return L.text_in_boxes(fx.words(spark, sf), reg, ["region"])


@register("word_regions", _layout_sql(
    "SELECT image_id, page, block AS r_block, par AS r_par, line AS r_line, text || chr(10) AS text, "
    "CAST(floor(cs / n) AS INT) AS mean_conf, n AS n_words FROM lines", _LINES_SQL))
def word_regions(spark, sf):
    return L.level_text(fx.words(spark, sf), "textline")


_TSV_SQL = """SELECT image_id, 1 AS level, page, 0 AS block, 0 AS par, 0 AS line, 0 AS word,
  concat_ws(chr(9), '1', CAST(page AS VARCHAR), '0', '0', '0', '0', '0', '0', CAST(page_width AS VARCHAR), CAST(page_height AS VARCHAR), '-1', '') AS tsv FROM pages
UNION ALL SELECT image_id, 2, page, block, 0, 0, 0, concat_ws(chr(9), '2', page, block, 0, 0, 0, l, t, w, h, '-1', '') FROM
  (SELECT image_id, page, block, min("left") AS l, min(top) AS t, max("left" + width) - min("left") AS w, max(top + height) - min(top) AS h FROM words GROUP BY ALL)
UNION ALL SELECT image_id, 3, page, block, par, 0, 0, concat_ws(chr(9), '3', page, block, par, 0, 0, l, t, w, h, '-1', '') FROM
  (SELECT image_id, page, block, par, min("left") AS l, min(top) AS t, max("left" + width) - min("left") AS w, max(top + height) - min(top) AS h FROM words GROUP BY ALL)
UNION ALL SELECT image_id, 4, page, block, par, line, 0, concat_ws(chr(9), '4', page, block, par, line, 0, l, t, w, h, '-1', '') FROM
  (SELECT image_id, page, block, par, line, min("left") AS l, min(top) AS t, max("left" + width) - min("left") AS w, max(top + height) - min(top) AS h FROM words GROUP BY ALL)
UNION ALL SELECT image_id, 5, page, block, par, line, word, concat_ws(chr(9), '5', page, block, par, line, word, "left", top, width, height, conf, text) FROM words"""


@register("tsv_out", _layout_sql(_TSV_SQL, _PAGES_SQL))
def tsv_out(spark, sf):
    return L.tsv_rows(fx.words(spark, sf), _pages(spark, sf))


_WORDS_BACK_SQL = with_views("SELECT * FROM words", "words")


@register("tsv_in", _WORDS_BACK_SQL)
def tsv_in(spark, sf):
    return L.tsv_parse(L.tsv_rows(fx.words(spark, sf), _pages(spark, sf)))


from .layout_sql import alto_sql, hocr_sql  # noqa: E402


@register("hocr_out", hocr_sql())
def hocr_out(spark, sf):
    return L.hocr_pages(fx.words(spark, sf), _pages(spark, sf))


@register("hocr_in", _WORDS_BACK_SQL)
def hocr_in(spark, sf):
    return L.hocr_parse(L.hocr_pages(fx.words(spark, sf), _pages(spark, sf)))


@register("alto_out", alto_sql())
def alto_out(spark, sf):
    return L.alto_pages(fx.words(spark, sf), _pages(spark, sf))


@register("alto_in", _WORDS_BACK_SQL)
def alto_in(spark, sf):
    return L.alto_parse(L.alto_pages(fx.words(spark, sf), _pages(spark, sf)))


@register("symbol_box", _layout_sql("""SELECT image_id, page, block, par, line, word, CAST(i AS INT) AS symbol,
  concat_ws(' ', sym, CAST(CAST("left" + floor(i * width / n) AS BIGINT) AS VARCHAR), CAST(page_height - (top + height) AS VARCHAR),
    CAST(CAST("left" + floor((i + 1) * width / n) AS BIGINT) AS VARCHAR), CAST(page_height - top AS VARCHAR), CAST(page - 1 AS VARCHAR)) AS box
FROM (SELECT w.*, p.page_height, length(w.text) AS n, unnest(string_split(w.text, '')) AS sym, unnest(range(length(w.text))) AS i
      FROM words w JOIN pages p ON w.image_id = p.image_id AND w.page = p.page)""", _PAGES_SQL))
def symbol_box(spark, sf):
    return L.symbol_boxes(fx.words(spark, sf), _pages(spark, sf))


@register("wordstr", _layout_sql("""SELECT l.image_id, l.page, l.block, l.par, l.line,
  concat('WordStr ', b.l, ' ', p.page_height - (b.t + b.h), ' ', b.l + b.w, ' ', p.page_height - b.t, ' ', l.page - 1, ' #', l.text,
    chr(10), chr(9), ' ', b.l + b.w + 1, ' ', p.page_height - (b.t + b.h), ' ', b.l + b.w + 5, ' ', p.page_height - b.t, ' ', l.page - 1) AS wordstr
FROM lines l JOIN (SELECT image_id, page, block, par, line, min("left") AS l, min(top) AS t, max("left" + width) - min("left") AS w,
  max(top + height) - min(top) AS h FROM words GROUP BY ALL) b USING (image_id, page, block, par, line)
JOIN pages p ON l.image_id = p.image_id AND l.page = p.page""", _PAGES_SQL, _LINES_SQL))
def wordstr(spark, sf):
    return L.wordstr_lines(fx.words(spark, sf), _pages(spark, sf))


# ---------------------------------------------------------------- streams

@register("stream_ingest", with_views(
    "SELECT path, modtime, md5(content) AS content_md5 FROM images "
    "WHERE regexp_extract(path, '\\.([^./]+)$', 1) IN ('png', 'jpeg', 'jpg', 'gif', 'webp')", "images"))
def stream_ingest(spark, sf):
    """F1 as a stream of rows in four micro-batches, each one incremental commit."""
    base = f"{checkpoint_dir(spark)}/scanlens-stream-{uuid.uuid4().hex}"
    rows = fx.images(spark, sf).where(paths.has_allowed_extension("path")).select("path", "modtime", "content")
    files = spark.sparkContext.defaultParallelism  # of a batch, so that all cores write and read it
    rows.repartitionByRange(4 * files, "path").write.parquet(f"{base}/in")
    st = store.IndexStore(spark, f"{base}/store")
    source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(f"{base}/in")
    ingest_rows(source, st, f"{base}/checkpoint")
    return st.current().select("path", "modtime", F.md5("content").alias("content_md5"))


@register("path_list", "SELECT path FROM (" + ORACLE["bm25_topk"] + ")")
def path_list(spark, sf):
    """The viewer-script form — only the path column of the ranked hits."""
    return S.path_list(S.search(fx.images(spark, sf), "ción", limit=100, with_snippet=False))
