"""Search: predicate, BM25 rank, top-k, snippet, result lines.

A ranked search reads every text once. That pass verifies the predicate, counts the hits of every
phrase, and writes the narrow hit rows (id, path, modtime, length, counts) to the shared folder;
the document frequencies are observed in the same pass, and row count and mean length come from
the caller (``corpus_size``, kept with the store's commits) or are observed too. Ranking and top-k
(``TakeOrderedAndProject``: k rows per task, never a global sort) work on the hit rows; for snippets
the rows found are joined with the index again.

``plan="postings"`` reads candidate rows only: ids with the rarest grams of the phrases (J5), also for
content globs and regexes that secure three characters or more. ``search_stored`` searches an
``IndexStore``: there ranked searches need no text at all before the snippet.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.arrays import bound, floor_index, running_sums
from ..functions.globs import content_glob_literals, content_glob_to_regex, regex_for_java
from ..functions.paths import in_scope, search_excluded
from ..functions.predicates import (MIN_PHRASE, AllOf, AnyOf, ButNot, Near, StartsWith, Term, count_hits, hit_positions, shortest_shift,
                                    simple_phrase)
from ..functions.regex_grams import required
from ..functions.text import escape_debug, fold, fold_literal, fold_text, token_count
from ..session import checkpoint_dir
from . import grams

# BM25 parameters of the default rank and its idf floor.
K1 = 1.2
B = 0.75
IDF_FLOOR = 1e-6
#: growth of the number of hits from one wave of a top-k search to the next
WAVE = 8
# Snippet window in tokens and the scores of its choice.
SNIPPET_TOKENS = 64
FIRST_HIT, FURTHER_HIT, TEXT_START, SENTENCE_START = 1000, 1, 120, 100


def make_term(query, kind: str) -> Term | str | None:
    """``simple``: words joined into one phrase; ``match``: a Term; glob/regex: the pattern string."""
    if kind == "simple":
        words = [query] if isinstance(query, str) else list(query)
        return simple_phrase(*words)
    if kind == "match":
        return query if isinstance(query, Term) else simple_phrase(query)
    if kind in ("glob", "regex"):
        return query if isinstance(query, str) else " ".join(query)
    raise ValueError(f"unknown search kind {kind!r}")


def content_predicate(term, kind: str, content: Column, folded: Column) -> Column:
    if kind in ("simple", "match"):
        return term.predicate(folded)
    if kind == "glob":
        return content.rlike(content_glob_to_regex(term))
    return content.rlike(regex_for_java(term))


def corpus_stats(index: DataFrame, phrases: list[str], content_col: str = "content") -> DataFrame:
    """One row: ``n_rows``, ``avg_dl`` and ``df_i`` (rows containing phrase i) over the whole index."""
    f = fold(content_col)
    aggs = [F.count("*").alias("n_rows"), F.avg(token_count(content_col)).alias("avg_dl")]
    for i, p in enumerate(phrases):
        hit = F.contains(f, fold_literal(p)) if len(p) >= MIN_PHRASE else F.lit(False)
        aggs.append(F.count_if(hit).alias(f"df_{i}"))
    return index.agg(*aggs)


def idf(n_rows: Column, df: Column) -> Column:
    x = F.ln((n_rows - df + 0.5) / (df + 0.5))
    return F.when(x <= 0, F.lit(IDF_FLOOR)).otherwise(x)


def bm25(tfs: list[Column], dl: Column, n_rows: Column, avg_dl: Column, dfs: list[Column]) -> Column:
    """Default full-text rank: minus the BM25 sum over phrases (smaller is better)."""
    score = F.lit(0.0)
    norm = F.lit(K1) * (F.lit(1 - B) + F.lit(B) * dl / avg_dl)
    for tf, df in zip(tfs, dfs):
        score = score + idf(n_rows, df) * (tf * (K1 + 1)) / (tf + norm)
    return -score


# ------------------------------------------------------------------ snippet

def _sentence_starts(content: Column) -> Column:
    """0-based starts of sentences: 0 and every code point after ``.`` or ``:`` and white space."""
    ends = F.regexp_extract_all(content, F.lit(r"(?s)(.*?[.:][ \t\n\r]+|.+$)"), 1)
    return bound(running_sums(F.transform(ends, lambda x: F.length(x))),
                 lambda starts: F.slice(starts, 1, F.greatest(F.size(starts) - 1, F.lit(1))))


def _all_hits(content: Column, live: list[str]) -> Column:
    """Every hit (pos, k, len, sent) of the phrases in order of position, with the start of its sentence.
    Text is scanned once per phrase and once for sentences; both lists are bound before they meet."""
    def of_phrase(folded: Column, k: int, p: str) -> Column:
        return F.transform(hit_positions(folded, p), lambda x: F.struct(x.alias("pos"), F.lit(k).alias("k"), F.lit(len(p)).alias("len")))

    def in_order(folded: Column) -> Column:
        each = [of_phrase(folded, k, p) for k, p in enumerate(live)]
        return F.array_sort(F.concat(*each)) if len(each) > 1 else each[0]

    def placed(hits: Column, sentences: Column) -> Column:
        return F.transform(hits, lambda h: F.struct(h["pos"].alias("pos"), h["k"].alias("k"), h["len"].alias("len"),
                                                    F.get(sentences, floor_index(sentences, h["pos"])).alias("sent")))

    return bound(bound(fold(content), in_order), lambda hits: bound(_sentence_starts(content), lambda sent: placed(hits, sent)))


def _best_start(hits: Column, n_tok: Column, live: list[str], tokens: int) -> Column:
    """Start of the window with the highest score; 0 without hits."""
    # starts of hits that a window can hold at most
    most = sum(-(-tokens // shortest_shift(fold_text(p))) for p in live)

    def held(start: Column, first: Column, n: int) -> Column:
        """Hits that start inside the window, out of ``n`` sorted ones from position ``first`` on."""
        return F.filter(F.slice(hits, first, n), lambda h: (h["pos"] >= start) & (h["pos"] < start + tokens))

    def score(inside: Column, bonus: Column) -> Column:
        kinds = F.size(F.array_distinct(F.transform(inside, lambda h: h["k"]))) if len(live) > 1 else F.least(F.size(inside), F.lit(1))
        return kinds * (FIRST_HIT - FURTHER_HIT) + F.size(inside) * FURTHER_HIT + bonus

    def centred(inside: Column) -> Column:
        first, last = F.element_at(inside, 1)["pos"], F.element_at(inside, -1)
        spare = F.lit(tokens) - (last["pos"] + last["len"] - 2 - first)
        half = F.when(spare >= 0, F.floor(spare / 2)).otherwise(F.ceil(spare / 2)).cast("int")
        return F.greatest(F.least(first - half, n_tok - tokens), F.lit(0))

    def at_hit(h: Column, i: Column) -> Column:
        return bound(held(h["pos"], i + 1, most), lambda x: F.struct(
            score(x, F.lit(0)).alias("score"), (-(2 * i)).alias("order"), centred(x).alias("adj")))

    def at_sentence(h: Column, i: Column) -> Column:
        # the first hit after a sentence's start speaks for all of the sentence
        before = F.get(hits, i - 1)
        first = (i == 0) | (before["sent"] != h["sent"]) | (before["pos"] == h["sent"])
        ok = (n_tok > tokens) & (h["sent"] < h["pos"]) & first
        bonus = F.when(h["sent"] == 0, TEXT_START).otherwise(SENTENCE_START)
        inside = held(h["sent"], F.greatest(i + 1 - len(live), F.lit(1)), most + len(live))
        return F.struct(F.when(ok, bound(inside, lambda x: score(x, bonus))).otherwise(-1).alias("score"),
                        (-(2 * i + 1)).alias("order"), h["sent"].alias("adj"))

    options = F.concat(F.transform(hits, at_hit), F.transform(hits, at_sentence))
    return F.coalesce(F.array_max(options)["adj"], F.lit(0))


def snippet(content: Column, phrases: list[str], tokens: int = SNIPPET_TOKENS, open_mark: str = "[", close_mark: str = "]",
            ellipsis: str = "..") -> Column:
    """The best window of ``tokens`` trigram tokens of a text, with its hits in marks.

    Every hit proposes the window that starts at it, scored 1000 for the first hit of each phrase
    inside and 1 for each further hit, and then centred on those hits; in texts longer than the
    window also the window at the start of its sentence (+120 at the start of the text, +100
    elsewhere). The best score wins, the first on ties. Hits inside the window are put in marks,
    overlapping and adjacent ones in one pair, also where the window cuts them; ``..`` stands
    where text is cut. Without hits the first window is shown. Work grows with the text and the hits.
    """
    live = [p for p in phrases if len(p) >= MIN_PHRASE]

    def rendered(hits: Column, n_tok: Column, adj: Column) -> Column:
        near = F.filter(hits, lambda h: (h["pos"] + h["len"] > adj) & (h["pos"] < adj + tokens + 2))
        chars = F.regexp_extract_all(F.substring(content, adj + 1, F.lit(tokens + 2)), F.lit("(?s)."), 0)

        def marked(w: Column, on: Column) -> Column:
            # flags per code point of the window: overlapping and adjacent hits merge by themselves
            text = F.transform(w, lambda ch, i: F.concat(
                F.when(F.get(on, i) & ~F.coalesce(F.get(on, i - 1), F.lit(False)), F.lit(open_mark)).otherwise(F.lit("")), ch,
                F.when(F.get(on, i) & ~F.coalesce(F.get(on, i + 1), F.lit(False)), F.lit(close_mark)).otherwise(F.lit(""))))
            head = F.when(adj > 0, F.lit(ellipsis)).otherwise(F.lit(""))
            tail = F.when(adj + tokens >= n_tok, F.lit("")).otherwise(F.lit(ellipsis))
            return F.concat(head, F.array_join(text, ""), tail)

        def flags(w: Column, close: Column) -> Column:
            return F.transform(w, lambda _, i: F.exists(close, lambda h: (h["pos"] <= adj + i) & (h["pos"] + h["len"] > adj + i)))

        return bound(near, lambda close: bound(chars, lambda w: bound(flags(w, close), lambda on: marked(w, on))))

    def chosen(hits: Column, n_tok: Column) -> Column:
        start = _best_start(hits, n_tok, live, tokens) if live else F.lit(0)
        return bound(start, lambda adj: rendered(hits, n_tok, adj))

    hits = _all_hits(content, live) if live else F.expr("cast(array() as array<struct<pos:int,k:int,len:int>>)")
    return bound(token_count(content), lambda n_tok: bound(hits, lambda h: chosen(h, n_tok)))


def with_snippet_column(rows: DataFrame, phrases: list[str], tokens: int = SNIPPET_TOKENS, open_mark: str = "[",
                        close_mark: str = "]", ellipsis: str = "..") -> DataFrame:
    """Adds ``snippet`` to rows with ``content``."""
    return rows.withColumn("snippet", snippet(F.col("content"), phrases, tokens, open_mark, close_mark, ellipsis))


# ------------------------------------------------------------------ search

def search(index: DataFrame, query, kind: str = "simple", root: str | None = None,
           prefix_like: bool = False, exclude: str | list[str] | None = None, limit: int | None = 100,
           with_snippet: bool = True, plan: str = "scan", postings: DataFrame | None = None,
           corpus_size: tuple[int, float] | None = None) -> DataFrame:
    """Ranked search over an index ``(id, path, modtime, content)``.

    Returns ``(snippet, path, modtime, rank)``; ordered by rank, then newest first, then path.
    ``limit=None`` keeps every hit (no top-k). ``exclude`` takes one pattern or a list; each is
    tested as ``pattern + '/**'``. ``corpus_size`` is (rows, mean trigram length) of the whole
    index; the postings plan needs it for a ranked search, since it reads candidate rows only.
    """
    term = make_term(query, kind)
    content, folded = F.col("content"), F.col("_f")
    ranked = kind in ("simple", "match")
    phrases = term.phrases() if ranked else []
    live = term.positive_phrases() if ranked else []

    base = index
    if plan == "postings":
        if postings is None:
            raise ValueError("the postings plan needs a postings table")
        if ranked and corpus_size is None:
            raise ValueError("the postings plan needs corpus_size")
        ids = _ranked_ids(postings, phrases) if ranked else _pattern_ids(postings, term, kind)
        if ids is not None:
            base = index.join(ids, "id", "left_semi")
    elif plan != "scan":
        raise ValueError(f"unknown plan {plan!r}")

    wanted = content_predicate(term, kind, content, folded) & in_scope("path", root, prefix_like)
    for pat in [exclude] if isinstance(exclude, str) else (exclude or []):
        wanted = wanted & ~search_excluded("path", pat)
    texts = ["content"] if with_snippet and limit is None else []
    seen = base.withColumn("_f", fold("content"))
    if ranked:
        hits, sizes = _counted(seen, phrases, wanted, folded, texts, corpus_size)
        n_rows, avg_dl, dfs = sizes
        tfs = [F.col(f"tf_{i}") for i in range(len(phrases))]
        rank = bm25(tfs, F.col("dl"), F.lit(n_rows), F.lit(avg_dl), [F.lit(d) for d in dfs]) if n_rows else F.lit(0.0)
        rows = hits.withColumn("rank", rank)
    else:
        rows = seen.where(wanted).withColumn("rank", F.lit(None).cast("double"))
        texts = ["content"] if with_snippet else []

    order = [F.col("rank").asc_nulls_last(), F.col("modtime").desc(), F.col("path").asc()]
    cols = (["snippet"] if with_snippet else []) + ["path", "modtime", "rank"]
    if limit is None:
        rows = rows.select("path", "modtime", "rank", *texts)
        # cut the snippet first so only short strings travel through the sort
        return (with_snippet_column(rows, live) if with_snippet else rows).orderBy(*order).select(*cols)
    top = rows.select("id", "path", "modtime", "rank", *texts).orderBy(*order).limit(limit)
    if not with_snippet:
        return top.select(*cols)
    if texts:
        return with_snippet_column(top, live).select(*cols)
    # the texts of the k rows: the rows found, written, joined with the index by id
    found = _kept(top, "top")
    texts = found.join(index.select("id", "content"), "id")
    return with_snippet_column(texts, live).orderBy(*order).select(*cols)


def _kept(rows: DataFrame, name: str) -> DataFrame:
    """Narrow rows written to the shared folder, so that they are computed once."""
    spark = rows.sparkSession
    path = f"{checkpoint_dir(spark)}/scanlens-{name}-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def _counted(seen: DataFrame, phrases: list[str], wanted: Column, folded: Column, texts: list[str],
             corpus_size: tuple[int, float] | None) -> tuple[DataFrame, tuple[int, float, list[int]]]:
    """The one pass over the texts: hit rows written to the shared folder, and (rows, mean length,
    rows per phrase) observed on the way."""
    spark = seen.sparkSession
    obs = Observation()
    counted = seen.select("id", "path", "modtime", token_count("content").alias("dl"), "content",
                          *[count_hits(folded, p).alias(f"tf_{i}") for i, p in enumerate(phrases)],
                          F.coalesce(wanted, F.lit(False)).alias("_wanted"))
    watched = counted.observe(obs, F.count("*").alias("n"), F.coalesce(F.sum(F.col("dl").cast("long")), F.lit(0)).alias("dl"),
                              *[F.count_if(F.col(f"tf_{i}") > 0).alias(f"df_{i}") for i in range(len(phrases))])
    path = f"{checkpoint_dir(spark)}/scanlens-hits-{uuid.uuid4().hex}"
    watched.where("_wanted").drop("_wanted", *([] if texts else ["content"])).write.parquet(path)
    got = obs.get
    n, mean = corpus_size or (got["n"], got["dl"] / got["n"] if got["n"] else 0.0)
    return spark.read.parquet(path), (n, mean, [got[f"df_{i}"] for i in range(len(phrases))])


def _ranked_ids(post: DataFrame, phrases: list[str]) -> DataFrame:
    """Ids that may hold any phrase of the query: enough to count every phrase and to verify the term."""
    out = None
    for p in phrases:
        ids = grams.candidates(post, p)
        out = ids if out is None else out.union(ids)
    return out.distinct()


def _pattern_condition(pattern: str, kind: str):
    """What a match of a content glob or a regex must contain; None where that is no three characters."""
    if kind == "regex":
        return required(pattern)
    runs = [r for r in content_glob_literals(pattern) if len(r) >= MIN_PHRASE]
    return ("and", *runs) if runs else None


def _pattern_ids(post: DataFrame, pattern: str, kind: str) -> DataFrame | None:
    condition = _pattern_condition(pattern, kind)
    return None if condition is None else _condition_ids(post, condition)


def _strings(condition) -> list[str]:
    return [condition] if isinstance(condition, str) else [s for c in condition[1:] for s in _strings(c)]


def _condition_ids(post: DataFrame, condition) -> DataFrame:
    if isinstance(condition, str):
        return grams.candidates(post, condition)
    ids = [_condition_ids(post, c) for c in condition[1:]]
    out = ids[0]
    for more in ids[1:]:
        out = out.join(more, "id", "left_semi") if condition[0] == "and" else out.union(more)
    return out if condition[0] == "and" else out.distinct()


# ------------------------------------------------------------------ search of a store

def on_places(term: Term, places: Iterator[Column]) -> Column:
    """A term's condition over the places of its phrases, which come in the order of ``term.phrases()``."""
    if isinstance(term, (AllOf, AnyOf)):
        parts = [on_places(t, places) for t in term.terms]
        out = parts[0]
        for p in parts[1:]:
            out = out & p if isinstance(term, AllOf) else out | p
        return out
    if isinstance(term, ButNot):
        keep = on_places(term.keep, places)
        return keep & ~on_places(term.drop, places)
    if isinstance(term, Near):
        a, b = next(places), next(places)
        # -(distance + tokens of b) <= start of b - start of a <= distance + tokens of a
        low, high = term.distance + len(term.second) - 2, term.distance + len(term.first) - 2
        close = F.exists(a, lambda x: bound(F.get(b, floor_index(b, x + high)), lambda y: (y <= x + high) & (y >= x - low)))
        return (F.size(a) > 0) & (F.size(b) > 0) & F.coalesce(close, F.lit(False))
    if isinstance(term, StartsWith):
        return F.coalesce(F.get(next(places), F.lit(0)) == 0, F.lit(False))
    return F.size(next(places)) > 0


def search_stored(store, query, kind: str = "simple", root: str | None = None, prefix_like: bool = False,
                  exclude: str | list[str] | None = None, limit: int | None = 100, with_snippet: bool = True) -> DataFrame:
    """The same results as ``search`` over a store's current rows, through its postings.

    Phrases, proximity, counts, document frequencies, lengths and so the exact rank come from postings; paths and
    times from the id blocks that hold a hit, with a limit best blocks first until no other can hold a row
    of the top; texts are read for snippets only, from the blocks of the rows shown.
    Globs and regexes read the texts of rows that hold the grams their pattern secures (all texts where it
    secures none).
    """
    term = make_term(query, kind)
    version = store.current_version() or None
    wanted = in_scope("path", root, prefix_like)
    for pat in [exclude] if isinstance(exclude, str) else (exclude or []):
        wanted = wanted & ~search_excluded("path", pat)
    ranked = kind in ("simple", "match")
    live = [p for p in term.positive_phrases() if len(p) >= MIN_PHRASE] if ranked else []
    if ranked:
        phrases = term.phrases()
        usable = list(dict.fromkeys(p for p in phrases if len(p) >= MIN_PHRASE))
        hits, total, dfs = _stored_hits(store, term, phrases, usable, version)
        n_rows, avg_dl = store.corpus_size()
        tfs = [F.col(f"tf_{usable.index(p)}") if p in usable else F.lit(0) for p in phrases]
        df = [F.lit(dfs[usable.index(p)] if p in usable else 0) for p in phrases]
        rank = bm25(tfs, F.col("dl"), F.lit(n_rows), F.lit(avg_dl), df) if n_rows else F.lit(0.0)
        named = ["id", "path", "modtime", "rank"]
        if "dl" not in hits.columns or not store.has_lengths(version):
            rows = store.rows_of(hits.drop("dl"), ["id", "path", "modtime", "dl", *[c for c in hits.columns if c.startswith("tf_")]], version)
            rows = rows.withColumn("rank", rank)
        elif limit is None:
            rows = store.rows_of(hits.select("id", rank.alias("rank")), named, version)
        else:
            rows = _best_first(store, hits.select("id", rank.alias("rank")), total, wanted, bool(root or exclude), limit, version)
    else:
        condition = _pattern_condition(term, kind)
        ids = None if condition is None else _condition_ids(store.positions(version, _strings(condition), with_pos=False), condition)
        if ids is None:
            rows = store.current(version)
        else:
            rows = store.rows_of(_kept(ids, "candidates"), ["id", "path", "modtime", "content"], version)
        rows = rows.where(content_predicate(term, kind, F.col("content"), F.col("content"))).withColumn("rank", F.lit(None).cast("double"))
    order = [F.col("rank").asc_nulls_last(), F.col("modtime").desc(), F.col("path").asc()]
    top = rows.where(wanted).select("id", "path", "modtime", "rank").orderBy(*order)
    top = top if limit is None else top.limit(limit)
    if not with_snippet:
        return top.select("path", "modtime", "rank")
    shown = _kept(top, "top")
    texts = store.rows_of(shown, ["path", "modtime", "rank", "content"], version)
    return with_snippet_column(texts, live).drop("content").orderBy(*order).select("snippet", "path", "modtime", "rank")


def _best_first(store, scored: DataFrame, total: int, wanted: Column, scoped: bool, limit: int, version: int | None) -> DataFrame:
    """Rows (id, path, modtime, rank) among which are the best ``limit`` rows in scope and all ties of the last.

    ``scored`` has all ``total`` hits with their exact ranks, so the rank of a row bounds what its block can still
    give: a wave reads the blocks of the best hits only, and where the scope leaves too few of them, the
    next one goes on with eight times as many.
    """
    n = max(limit, 1)
    while n < total:
        worst = scored.orderBy("rank").limit(n).agg(F.max("rank")).first()[0]
        rows = store.rows_of(scored.where(F.col("rank") <= worst), ["id", "path", "modtime", "rank"], version)
        if not scoped or rows.where(wanted).limit(limit).count() >= limit:
            return rows
        n *= WAVE
    return store.rows_of(scored, ["id", "path", "modtime", "rank"], version)


def _stored_hits(store, term: Term, phrases: list[str], usable: list[str], version: int | None) -> tuple[DataFrame, int, list[int]]:
    """(id, dl, tf_0, ...) of the rows that satisfy a term, written once, their number, and the rows per usable phrase."""
    if not usable:
        return store.spark.createDataFrame([], "id long"), 0, []
    places = grams.phrase_places(store.positions(version, usable), usable)
    none = F.array().cast("array<int>")

    def judged(found: Column) -> Column:
        each = iter([found[f"s_{usable.index(p)}"] if p in usable else none for p in phrases])
        return F.struct(*[F.size(found[f"s_{i}"]).alias(f"tf_{i}") for i in range(len(usable))], on_places(term, each).alias("wanted"))

    counted = places.select("id", "dl", bound(F.struct(*places.columns[2:]), judged).alias("x")).select("id", "dl", "x.*")
    obs = Observation()
    watched = counted.observe(obs, F.count_if("wanted").alias("hits"), *[F.count_if(F.col(f"tf_{i}") > 0).alias(f"df_{i}") for i in range(len(usable))])
    hits = _kept(watched.where("wanted").drop("wanted"), "hits")
    got = obs.get
    return hits, got["hits"], [got[f"df_{i}"] for i in range(len(usable))]


def result_lines(results: DataFrame) -> DataFrame:
    """``escape_debug(snippet) TAB path`` per hit, ready for ``write.text``."""
    return results.select(F.concat(escape_debug("snippet"), F.lit("\t"), F.col("path")).alias("line"))


def path_list(results: DataFrame) -> DataFrame:
    return results.select("path")


__all__ = ["search", "corpus_stats", "bm25", "with_snippet_column", "result_lines", "path_list", "make_term"]
