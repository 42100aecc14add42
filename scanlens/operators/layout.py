"""Recognised-layout tables and their text forms.

Input: the words table ``(image_id, page, block, par, line, word, left, top, width, height,
conf, text)``; reading order is page, block, par, line, word. Page sizes, where a form needs
them, come from a ``pages`` table ``(image_id, page, page_width, page_height)``.

Box containment joins never pair every box with every word of an image: the boxes of a page are held by
the horizontal bands they span and a word meets those in the band of its top edge, so the join is
an equi-join on ``(image_id, page)``, a look-up of the band and the containment test.

Forms per page (TSV, hOCR, ALTO) are read and formatted word by word and collected once by ``(image_id, page)`` (no
shuffle where the table is dealt by image): page documents come from one tree per page (``page_trees``), TSV rows from
the words' rows and their boxes; boxes go up by min and max of the level below. One page is one value, so one page is one
task; a page's words are bounded by what the page can hold. Pages without words keep their row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import bound

PAGE = ["image_id", "page"]
LEVEL_KEYS = {
    "block": ["block"],
    "para": ["block", "par"],
    "textline": ["block", "par", "line"],
    "word": ["block", "par", "line", "word"],
    "symbol": ["block", "par", "line", "word", "symbol"],
}
BAND = 64  # band height (pixels) for containment joins


def _ordered_join(items: Column, value: str, sep: str) -> Column:
    """``array_join`` of ``value`` over a collected struct array in the order of its first fields."""
    return F.array_join(F.transform(F.array_sort(items), lambda s: s[value]), sep)


def _collect(order_fields: list[str], value: Column) -> Column:
    return F.collect_list(F.struct(*[F.col(c) for c in order_fields], value.alias("v")))


# ---------------------------------------------------------------- A3, A4, A5, A6

def mean_conf(words: DataFrame, keys: list[str] = PAGE) -> DataFrame:
    """Mean word confidence as an integer (floor of the mean), per page or any key set."""
    return words.groupBy(*keys).agg(F.floor(F.avg("conf")).cast("int").alias("mean_conf"))


def word_confs(words: DataFrame) -> DataFrame:
    """All word confidences of a page in reading order: ``(image_id, page, confs array<int>)``."""
    order = LEVEL_KEYS["word"]
    agg = words.groupBy(*PAGE).agg(F.array_sort(_collect(order, F.col("conf"))).alias("x"))
    return agg.select(*PAGE, F.transform("x", lambda s: s["v"]).alias("confs"))


def component_boxes(words: DataFrame, level: str = "textline", text_only: bool = True) -> DataFrame:
    """Bounding boxes of the components at ``level`` (block, para, textline, word, symbol) in reading
    order: ``(image_id, page, <level keys>, left, top, width, height, n_words)``. Boxes are
    built from the words, so every box holds text (``text_only`` is kept for the signature).
    Symbols split their word's box evenly and are numbered from 0."""
    if level == "symbol":
        x0, x1 = _symbol_edges()
        return _symbol_numbers(words).select(*PAGE, *LEVEL_KEYS["word"], F.col("i").alias("symbol"), x0.alias("left"), "top",
                                      (x1 - x0).alias("width"), "height", F.lit(1).cast("long").alias("n_words"))
    keys = PAGE + LEVEL_KEYS[level]
    right, bottom = F.col("left") + F.col("width"), F.col("top") + F.col("height")
    return words.groupBy(*keys).agg(
        F.min("left").alias("left"), F.min("top").alias("top"),
        (F.max(right) - F.min("left")).alias("width"), (F.max(bottom) - F.min("top")).alias("height"),
        F.count("*").alias("n_words"),
    )


def regions(words: DataFrame) -> DataFrame:
    """Block-level boxes."""
    return component_boxes(words, "block", text_only=False)


# ---------------------------------------------------------------- A8, L1

def line_texts(words: DataFrame) -> DataFrame:
    """``(image_id, page, block, par, line, text)``: words of a line joined by one space."""
    keys = PAGE + LEVEL_KEYS["textline"]
    agg = words.groupBy(*keys).agg(_collect(["word"], F.col("text")).alias("x"))
    return agg.select(*keys, _ordered_join(F.col("x"), "v", " ").alias("text"))


def page_text(words: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """Plain text of each page: every line followed by a newline, in reading order. With ``pages``
    every page has a row, one without words the empty text."""
    word = [*LEVEL_KEYS["word"], "text"]
    found = words.groupBy(*PAGE).agg(F.sort_array(F.collect_list(F.struct(*word))).alias("w"))
    lines = F.transform(_runs(F.col("w"), LEVEL_KEYS["textline"]), lambda run: F.concat(F.array_join(F.transform(run, lambda x: x["text"]), " "), F.lit("\n")))
    text = found.select(*PAGE, F.array_join(lines, "").alias("text"))
    if pages is None:
        return text
    return pages.select(*PAGE).join(text, PAGE, "left").select(*PAGE, F.coalesce("text", F.lit("")).alias("text"))


# ---------------------------------------------------------------- J6, J7

def _bands(top: Column, bottom: Column) -> Column:
    return F.sequence(F.floor(top / BAND), F.floor(F.greatest(bottom - 1, top) / BAND))


def words_in_boxes(words: DataFrame, boxes: DataFrame, box_keys: list[str]) -> DataFrame:
    """Words whose whole box lies inside a box of ``boxes`` (same image and page).

    ``boxes``: ``(image_id, page, <box_keys>, x, y, w, h)``. Result: the word columns plus the
    box keys. The boxes of a page are held by band (a box is repeated once per band it spans: its
    height / BAND + 1 copies), a word meets those in the band of its top edge. Words are joined by page
    only, so they stay where they are if they are dealt by image.
    """
    b = boxes.select(*PAGE, F.struct(*box_keys, "x", "y", "w", "h").alias("box"),
                     F.explode(_bands(F.col("y"), F.col("y") + F.col("h"))).alias("band"))
    b = b.groupBy(*PAGE, "band").agg(F.collect_list("box").alias("in_band"))
    b = b.groupBy(*PAGE).agg(F.map_from_entries(F.collect_list(F.struct("band", "in_band"))).alias("_bands"))
    # boxes are the narrow side
    near = words.join(b.hint("shuffle_hash"), PAGE).select(
        *words.columns, F.explode(F.element_at("_bands", F.floor(F.col("top") / BAND))).alias("_box"))
    box = F.col("_box")
    inside = (
        (F.col("left") >= box["x"]) & (F.col("top") >= box["y"])
        & (F.col("left") + F.col("width") <= box["x"] + box["w"]) & (F.col("top") + F.col("height") <= box["y"] + box["h"])
    )
    return near.where(inside).select(*words.columns, *[box[k].alias(k) for k in box_keys])


def text_in_boxes(words: DataFrame, boxes: DataFrame, box_keys: list[str]) -> DataFrame:
    """Per box: the text of the words inside (lines joined as in ``page_text``), mean confidence
    and word count: ``(image_id, page, <box_keys>, text, mean_conf, n_words)``."""
    hit = words_in_boxes(words, boxes, box_keys)
    keys = PAGE + box_keys
    line_keys = LEVEL_KEYS["textline"]
    lines = hit.groupBy(*keys, *line_keys).agg(
        _collect(["word"], F.col("text")).alias("x"), F.sum("conf").alias("cs"), F.count("*").alias("n"))
    lines = lines.select(*keys, *line_keys, "cs", "n",
                         F.concat(_ordered_join(F.col("x"), "v", " "), F.lit("\n")).alias("lt"))
    agg = lines.groupBy(*keys).agg(_collect(line_keys, F.col("lt")).alias("x"),
                                   F.sum("cs").alias("cs"), F.sum("n").alias("n_words"))
    return agg.select(*keys, _ordered_join(F.col("x"), "v", "").alias("text"),
                      F.floor(F.col("cs") / F.col("n_words")).cast("int").alias("mean_conf"), "n_words")


def level_text(words: DataFrame, level: str = "word") -> DataFrame:
    """Component boxes at ``level`` used as regions over the same words: text and confidence
    per box (the word-by-word loop of the bindings)."""
    keys = LEVEL_KEYS[level]
    boxes = component_boxes(words, level).select(
        *PAGE, *[F.col(k).alias(f"r_{k}") for k in keys],
        F.col("left").alias("x"), F.col("top").alias("y"), F.col("width").alias("w"), F.col("height").alias("h"))
    return text_in_boxes(words, boxes, [f"r_{k}" for k in keys])


def _once(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with further columns that what comes after reads but does not compute again."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


# ---------------------------------------------------------------- L2 TSV

TSV_COLUMNS = ["level", "page", "block", "par", "line", "word", "left", "top", "width", "height", "conf", "text"]


def _tsv(level: int, page, block, par, line, word, left, top, width, height, conf, text) -> Column:
    parts = [F.lit(level), page, block, par, line, word, left, top, width, height, conf]
    return F.concat_ws("\t", *[p.cast("string") for p in parts], text)


def _runs(items: Column, keys: list[str]) -> Column:
    """``items`` (a sorted array of structs, not empty) cut into arrays of neighbours that agree in ``keys``."""
    def cut(x: Column) -> Column:
        def starts_run(i: Column) -> Column:
            other = i == 0
            for k in keys:
                other = other | ~F.get(x, i)[k].eqNullSafe(F.get(x, i - 1)[k])
            return other

        starts = F.filter(F.sequence(F.lit(0), F.size(x) - 1), starts_run)
        return bound(starts, lambda at: F.transform(at, lambda s, k: F.slice(x, s + 1, F.coalesce(F.get(at, k + 1), F.size(x)) - s)))

    return bound(items, cut)


def _rolled(items: Column, keys: list[str], fields: list[str] = (), name: str | None = None) -> Column:
    """Parents of ``items``: the keys, the edges around the children, and with a ``name`` the children's ``fields`` under it."""
    def parent(run: Column) -> Column:
        edges = [use(run[e]).alias(e) for e, use in (("l", F.array_min), ("t", F.array_min), ("r", F.array_max), ("b", F.array_max))]
        children = [F.transform(run, lambda x: F.struct(*[x[f].alias(f) for f in fields])).alias(name)] if name else []
        return F.struct(*[F.get(run, F.lit(0))[k].alias(k) for k in keys], *edges, *children)

    return F.transform(_runs(items, keys), parent)


def page_trees(words: DataFrame, pages: DataFrame, form: Column | None = None) -> DataFrame:
    """``pages`` with column ``blocks``: array of (block, l, t, r, b, paras: array of (par, l, t, r, b, lines:
    array of (line, l, t, r, b, words: array of (word, left, top, width, height, conf, text)))), every
    array in reading order, empty for a page without words. With ``form``, a value of each row of ``words``, the
    words are these values, made before they are collected. The words of a page are collected once, in the
    place they are in if that is by image already; the levels are cut from that array."""
    word, line = ["word", "left", "top", "width", "height", "conf", "text"], LEVEL_KEYS["textline"]
    made = _once(words, r=F.col("left") + F.col("width"), b=F.col("top") + F.col("height"), **({} if form is None else {"form": form}))
    found = made.groupBy(*PAGE).agg(F.collect_list(F.struct(*line, *word, "r", "b", *([] if form is None else ["form"]))).alias("w"))

    def of_line(run: Column) -> Column:
        kept = F.transform(run, lambda w: F.struct(*[w[c].alias(c) for c in word])) if form is None else run["form"]
        return F.struct(*[F.get(run, F.lit(0))[k].alias(k) for k in line], F.array_min(run["left"]).alias("l"), F.array_min(run["top"]).alias("t"),
                        F.array_max(run["r"]).alias("r"), F.array_max(run["b"]).alias("b"), kept.alias("words"))

    box = ["l", "t", "r", "b"]
    lines = F.transform(_runs(F.sort_array("w"), line), of_line)
    paras = _rolled(lines, ["block", "par"], ["line", *box, "words"], "lines")
    tree = found.select(*PAGE, _rolled(paras, ["block"], ["par", *box, "lines"], "paras").alias("blocks"))
    none = F.array().cast(tree.schema["blocks"].dataType)
    # pages are the narrow side: they are held by key, and the trees stream past unsorted
    return pages.hint("shuffle_hash").join(tree, PAGE, "left").withColumn("blocks", F.coalesce("blocks", none))


def tsv_rows(words: DataFrame, pages: DataFrame) -> DataFrame:
    """TSV rows for every level (1 page .. 5 word), with their ordering keys:
    ``(image_id, level, page, block, par, line, word, tsv)``. Sort by the keys to print a page."""
    z, m1 = F.lit(0), F.lit(-1)
    pg = F.col("page")

    def row(level: int, block, par, line, word, left, top, width, height, conf=m1, text=F.lit("")) -> Column:
        return F.struct(F.lit(level).alias("level"), *[c.cast("int").alias(n) for n, c in (
            ("block", block), ("par", par), ("line", line), ("word", word))],
            _tsv(level, pg, block, par, line, word, left, top, width, height, conf, text).alias("tsv"))

    keys = LEVEL_KEYS["textline"]
    edges = {"l": F.col("left"), "t": F.col("top"), "r": F.col("left") + F.col("width"), "b": F.col("top") + F.col("height")}
    of_word = row(5, *[F.col(c) for c in (*LEVEL_KEYS["word"], "left", "top", "width", "height", "conf", "text")])
    found = _once(words, **edges, form=of_word).groupBy(*PAGE).agg(
        F.collect_list(F.struct(*keys, *edges)).alias("w"), F.collect_list("form").alias("rows"))

    def above(level: int):
        """The row of a box at ``level``."""
        b, p, n = (lambda x: x["block"]), (lambda x: x["par"] if level > 2 else z), (lambda x: x["line"] if level > 3 else z)
        return lambda x: row(level, b(x), p(x), n(x), z, x["l"], x["t"], x["r"] - x["l"], x["b"] - x["t"])

    def up(boxes: Column, level: int) -> Column:
        """The rows of the boxes around ``boxes`` at ``level`` and at the levels above it."""
        parents = _rolled(boxes, keys[:level - 1])
        return bound(parents, lambda x: F.concat(F.transform(x, above(level)), *([up(x, level - 1)] if level > 2 else [])))

    rows = found.select(*PAGE, F.concat("rows", up(F.sort_array("w"), 4)).alias("rows"))
    page = row(1, z, z, z, z, z, z, F.col("page_width"), F.col("page_height"))
    # pages are the narrow side
    rows = pages.hint("shuffle_hash").join(rows, PAGE, "left").withColumn("rows", F.concat(F.array(page), F.coalesce("rows", F.array().cast(rows.schema["rows"].dataType))))
    rows = rows.select("image_id", "page", F.explode("rows").alias("x"))
    return rows.select("image_id", "x.level", "page", "x.block", "x.par", "x.line", "x.word", "x.tsv")


def _tsv_lines(df: DataFrame, col: str, keys: list[str]) -> DataFrame:
    lines = df.select(*keys, F.explode(F.split(F.replace(F.col(col), F.lit("\r\n"), F.lit("\n")), "\n")).alias("tsv")).where(F.col("tsv") != "")
    rows = _once(lines, _f=F.split("tsv", "\t", 12))
    rows = _once(rows, **{n: F.get("_f", F.lit(i)).try_cast("double") for i, n in enumerate(TSV_COLUMNS[:11])})
    good = F.lit(True)
    for n in TSV_COLUMNS[:11]:
        good = good & F.col(n).isNotNull()
    return rows.select(*keys, "tsv", *TSV_COLUMNS[:11], F.get("_f", F.lit(11)).alias("text"), good.alias("_good"))


def tsv_parse(df: DataFrame, col: str = "tsv", keys: list[str] = ("image_id",)) -> DataFrame:
    """Read TSV text (one line per row or whole documents) back into the words table (level 5).
    A confidence may have a fraction (it is cut); header lines and lines without eleven numbers
    are left out, ``tsv_bad_lines`` returns them."""
    parsed = _tsv_lines(df, col, list(keys)).where(F.col("_good") & (F.col("level") == 5))
    return parsed.select(*keys, *[F.col(n).cast("int").alias(n) for n in TSV_COLUMNS[1:11]], F.coalesce("text", F.lit("")).alias("text"))


def tsv_bad_lines(df: DataFrame, col: str = "tsv", keys: list[str] = ("image_id",)) -> DataFrame:
    """``(<keys>, tsv)``: the lines that ``tsv_parse`` does not take, header lines aside."""
    return _tsv_lines(df, col, list(keys)).where(~F.col("_good") & ~F.col("tsv").startswith("level\t")).select(*keys, "tsv")


# ---------------------------------------------------------------- L3 hOCR, L4 ALTO

def _xml_escape(c: Column) -> Column:
    for raw, esc in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(raw), F.lit(esc))
    return c


def _xml_unescape(c: Column) -> Column:
    plain = c
    for raw, esc in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;"), ("&", "&amp;")):
        plain = F.replace(plain, F.lit(esc), F.lit(raw))
    return F.when(F.contains(c, F.lit("&")), plain).otherwise(c)


def _filled(form: str, *values: Column) -> Column:
    """``format_string`` for a form with ``%d`` only, which runs once per word: put together from its pieces."""
    pieces = form.split("%d")
    parts = [F.lit(pieces[0])]
    for value, after in zip(values, pieces[1:], strict=True):
        parts += [F.coalesce(value.cast("string"), F.lit("null")), F.lit(after)]
    return F.concat(*parts)


def _edges(x: Column) -> Column:
    return F.format_string("bbox %d %d %d %d", x["l"], x["t"], x["r"], x["b"])


def hocr_pages(words: DataFrame, pages: DataFrame) -> DataFrame:
    """One hOCR document fragment per page: ``(image_id, page, hocr)``."""
    pg, (block, par, line, word) = F.col("page"), (F.col(k) for k in LEVEL_KEYS["word"])
    left, top = F.col("left"), F.col("top")
    span = F.concat(
        _filled("<span class='ocrx_word' id='word_%d_%d_%d_%d_%d' title='bbox %d %d %d %d; x_wconf %d'>", pg, block, par, line, word,
                left, top, left + F.col("width"), top + F.col("height"), F.col("conf")),
        _xml_escape(F.col("text")), F.lit("</span>"))

    def of_line(b, p):
        return lambda ln: F.concat(
            F.format_string("<span class='ocr_line' id='line_%d_%d_%d_%d' title=\"", pg, b["block"], p["par"], ln["line"]), _edges(ln),
            F.lit('">'), F.array_join(ln["words"], " "), F.lit("</span>"))

    def of_par(b):
        return lambda p: F.concat(
            F.format_string("<p class='ocr_par' id='par_%d_%d_%d' title=\"", pg, b["block"], p["par"]), _edges(p),
            F.lit('">\n'), F.array_join(F.transform(p["lines"], of_line(b, p)), "\n"), F.lit("\n</p>"))

    def of_block(b):
        return F.concat(F.format_string("<div class='ocr_carea' id='block_%d_%d' title=\"", pg, b["block"]), _edges(b),
                        F.lit('">\n'), F.array_join(F.transform(b["paras"], of_par(b)), "\n"), F.lit("\n</div>"))

    return page_trees(words, pages, span).select(*PAGE, F.concat(
        F.format_string("<div class='ocr_page' id='page_%d' title='image \"%d\"; bbox 0 0 %d %d; ppageno %d'>\n",
                        pg, F.col("image_id"), F.col("page_width"), F.col("page_height"), pg - 1),
        F.array_join(F.transform("blocks", of_block), "\n"), F.lit("\n</div>\n")).alias("hocr"))


# hOCR classes of each level.
HOCR_LEVELS = {"page": ["ocr_page"], "block": ["ocr_carea"], "par": ["ocr_par"],
               "line": ["ocr_line", "ocr_header", "ocr_caption", "ocr_textfloat"], "word": ["ocrx_word"]}
_HOCR_TAG = (r"<(?:div|p|span)\b[^>]*?\bclass\s*=\s*['\"](?:" + "|".join(c for cs in reversed(HOCR_LEVELS.values()) for c in cs)
             + r")['\"][^>]*>[^<]*(?:<(?!/?(?:div|p|span)\b)[^<]*)*")


def _nested_words(docs: DataFrame, tags: Column, levels: list[str], keep: list[str], page_no) -> DataFrame:
    """Word tags of ``docs`` with, per level, ``_n_<level>``: the number of that element inside its parent in document
    order, 0 before the first. ``tags`` is a document's array of (level, tag); it is cut at the tags of one level
    after the other, so a document stays in its row and nothing is sorted or shuffled. Words are many, so they are
    looked at once: every other tag takes the words up to the next one along.
    ``_page`` is ``page_no`` of the page's tag, where it has one."""
    def with_words(x: Column) -> Column:
        at = F.filter(F.sequence(F.lit(0), F.size(x)), lambda i: (i < F.size(x)) & ~F.get(x, i)["level"].eqNullSafe(F.lit(levels[-1])))
        before = F.struct(F.lit(None).cast("string").alias("level"), F.lit(None).cast("string").alias("tag"),
                          F.slice(x, F.lit(1), F.coalesce(F.get(at, F.lit(0)), F.size(x)))["tag"].alias("words"))
        return bound(at, lambda at: F.concat(F.array(before), F.transform(at, lambda s, k: F.struct(
            F.get(x, s)["level"].alias("level"), F.get(x, s)["tag"].alias("tag"),
            F.slice(x, s + 2, F.coalesce(F.get(at, k + 1), F.size(x)) - s - 1)["tag"].alias("words")))))

    def pieces(level: str):
        return lambda x: cut(x, level)

    def cut(x: Column, level: str) -> Column:
        at = F.filter(F.sequence(F.lit(0), F.size(x)), lambda i: F.get(x, i)["level"] == level)
        return bound(F.concat(F.array(F.lit(0)), at), lambda starts: F.transform(
            starts, lambda s, k: F.slice(x, s + 1, F.coalesce(F.get(starts, k + 1), F.size(x)) - s)))

    out = docs.select(*keep, bound(tags, with_words).alias("_in"))
    done = list(keep)
    for level in levels[:-1]:
        out = out.select(*done, F.posexplode(bound(F.col("_in"), pieces(level))).alias(f"_n_{level}", "_in"))
        done.append(f"_n_{level}")
        if level == "page":
            head = F.get("_in", F.lit(0))
            out = out.withColumn("_page", F.coalesce(F.when(head["level"] == "page", page_no(head["tag"])), F.greatest(F.col("_n_page"), F.lit(1))))
            done.append("_page")
    return out.select(*done, F.posexplode(F.flatten(F.col("_in")["words"])).alias("_at", "_tag")).select(
        *done, (F.col("_at") + 1).alias(f"_n_{levels[-1]}"), "_tag")


def _found(tag: Column, patterns: list[str], last: str, sep: str, groups: int) -> Column:
    """The groups of ``patterns``, each searched from the start of ``tag`` ('' where it is not found), and of ``last``, which takes the
    whole tag, in one pass: an array of ``groups`` strings. No group but the last may hold ``sep``."""
    whole = r"(?s)\A" + "".join(f"(?:(?=.*?{p}))?" for p in patterns) + last + r"\z"
    return F.split(F.regexp_replace(tag, F.lit(whole), F.lit(sep.join(f"${k}" for k in range(1, groups + 1)))), sep, groups)


def hocr_parse(df: DataFrame, col: str = "hocr", keys: list[str] = ("image_id",)) -> DataFrame:
    """Words back from hOCR of any writer: the place of a word comes from the order in which pages,
    areas, paragraphs, lines and words nest, the page number from ``ppageno`` where it is given.
    Ids of the form this library writes (page, block, par, line and word number) take precedence, so
    numbers with gaps come back."""
    def level_of(tag: Column) -> Column:
        cls = F.lower(F.regexp_extract(tag, r"(?i)\bclass\s*=\s*['\"]([a-z_]+)['\"]", 1))
        level = F.lit(None).cast("string")
        for name, classes in HOCR_LEVELS.items():
            level = F.when(cls.isin(*classes), F.lit(name)).otherwise(level)
        return level

    found = F.regexp_extract_all(col, F.lit("(?is)" + _HOCR_TAG), 0)
    tags = _nested_words(df, F.transform(found, lambda t: F.struct(level_of(t).alias("level"), t.alias("tag"))), list(HOCR_LEVELS), list(keys),
                         lambda tag: F.regexp_extract(tag, r"ppageno\s+(\d+)", 1).try_cast("int") + 1)
    parts = _found(F.col("_tag"), [r"bbox\s+(-?\d+)\s+(-?\d+)\s+(-?\d+)\s+(-?\d+)", r"x_wconf\s+(-?\d+(?:\.\d+)?)",
                                   r"\bid\s*=\s*['\"]word_(\d+)_(\d+)_(\d+)_(\d+)_(\d+)['\"]"], r"<[^>]*>(.*)", "\t", 11)
    part = [F.get("_parts", F.lit(k)) for k in range(11)]
    number = lambda k, col: F.when(part[5] != "", part[5 + k].try_cast("int")).otherwise(F.greatest(F.col(col), F.lit(1)).cast("int"))
    x0, y0, x1, y1 = (F.col(c) for c in ("_x0", "_y0", "_x1", "_y1"))
    body = F.when(F.contains(part[10], F.lit("<")), F.regexp_replace(part[10], r"<[^>]*>", "")).otherwise(part[10])
    words = tags.withColumn("_parts", parts).select("*", *[part[k].try_cast("int").alias(n) for k, n in enumerate(("_x0", "_y0", "_x1", "_y1"))],
                                                    F.trim(body).alias("_body"))
    return words.select(
        *keys, number(0, "_page").alias("page"), number(1, "_n_block").alias("block"), number(2, "_n_par").alias("par"),
        number(3, "_n_line").alias("line"), number(4, "_n_word").alias("word"), x0.alias("left"), y0.alias("top"),
        (x1 - x0).alias("width"), (y1 - y0).alias("height"), part[4].try_cast("double").cast("int").alias("conf"),
        _xml_unescape(F.col("_body")).alias("text"))


ALTO_NS = "http://www.loc.gov/standards/alto/ns-v3#"


def _wc(conf: Column) -> Column:
    """Word confidence 0..100 as ALTO's 0..1 with two decimals, formatted from integers."""
    return F.when(conf >= 100, F.lit("1.00")).otherwise(F.concat(F.lit("0."), F.lpad(conf.cast("string"), 2, "0")))


def alto_pages(words: DataFrame, pages: DataFrame) -> DataFrame:
    """One ALTO document per page: ``(image_id, page, alto)``."""

    place = 'HPOS="%d" VPOS="%d" WIDTH="%d" HEIGHT="%d"'
    string = F.concat(
        _filled(f'<String ID="string_%d_%d_%d_%d" {place} WC="', *[F.col(k) for k in (*LEVEL_KEYS["word"], "left", "top", "width", "height")]),
        _wc(F.col("conf")), F.lit('" CONTENT="'), _xml_escape(F.col("text")), F.lit('"/>'))

    def box(x: Column) -> Column:
        return F.format_string(place, x["l"], x["t"], x["r"] - x["l"], x["b"] - x["t"])

    def of_line(b, p):
        return lambda ln: F.concat(F.format_string('<TextLine ID="line_%d_%d_%d" ', b["block"], p["par"], ln["line"]), box(ln), F.lit(">"),
                                   F.array_join(ln["words"], "<SP/>"), F.lit("</TextLine>"))

    def of_block(b):
        lines = F.flatten(F.transform(b["paras"], lambda p: F.transform(p["lines"], of_line(b, p))))
        return F.concat(F.format_string('<TextBlock ID="block_%d" ', b["block"]), box(b), F.lit(">\n"), F.array_join(lines, "\n"),
                        F.lit("\n</TextBlock>"))

    return page_trees(words, pages, string).select(*PAGE, F.concat(
        F.lit(f'<?xml version="1.0" encoding="UTF-8"?>\n<alto xmlns="{ALTO_NS}">\n<Layout>\n'),
        F.format_string('<Page WIDTH="%d" HEIGHT="%d" PHYSICAL_IMG_NR="%d" ID="page_%d">\n', F.col("page_width"),
                        F.col("page_height"), F.col("page"), F.col("page")),
        F.format_string('<PrintSpace HPOS="0" VPOS="0" WIDTH="%d" HEIGHT="%d">\n', F.col("page_width"), F.col("page_height")),
        F.array_join(F.transform("blocks", of_block), "\n"), F.lit("\n</PrintSpace>\n</Page>\n</Layout>\n</alto>\n")).alias("alto"))


_ALTO_TAG = r"<(?:\w+:)?(?:Page|TextBlock|TextLine|String)\b[^>]*>"


def alto_parse(df: DataFrame, col: str = "alto", keys: list[str] = ("image_id",)) -> DataFrame:
    """Words back from ALTO of any writer (attributes in any order, any namespace prefix): the place
    of a word comes from the order in which pages, blocks, lines and strings nest; ALTO has no
    paragraphs, so ``par`` is 1. Ids of the form this library writes take precedence."""
    elements = {"Page": "page", "TextBlock": "block", "TextLine": "line", "String": "word"}

    def level_of(tag: Column) -> Column:
        kind = F.regexp_extract(tag, r"\A<(?:\w+:)?(\w+)", 1)
        level = F.lit(None).cast("string")
        for element, name in elements.items():
            level = F.when(kind == element, F.lit(name)).otherwise(level)
        return level

    attr = lambda name: rf"""\s{name}\s*=\s*["']([^"']*)["']"""
    found = F.regexp_extract_all(col, F.lit(_ALTO_TAG), 0)
    tags = _nested_words(df, F.transform(found, lambda t: F.struct(level_of(t).alias("level"), t.alias("tag"))), list(elements.values()), list(keys),
                         lambda tag: F.regexp_extract(tag, attr("PHYSICAL_IMG_NR"), 1).try_cast("int"))
    # a tag cut at its double quotes has every value after a piece like ' HPOS='; where one lacks or other spacing or quotes occur, patterns find them
    names = ["ID", "HPOS", "VPOS", "WIDTH", "HEIGHT", "WC", "CONTENT"]
    tag, pieces = F.col("_tag"), F.col("_pieces")
    plain = F.lit(True)
    for other in ("'", "  ", " =", "= ", "\t", "\n", "\x0b", "\f", "\r"):
        plain = plain & ~F.contains(tag, F.lit(other))
    for a in names:
        plain = plain & F.col(f"_at_{a}").between(1, F.size(pieces) - 2)
    tags = tags.withColumn("_pieces", F.split(F.substr(tag, F.instr(tag, " ")), '"')).select(
        "*", *[F.array_position(pieces, F.lit(f" {a}=")).cast("int").alias(f"_at_{a}") for a in names])
    tags = tags.withColumn("_values", F.when(plain, F.array(*[F.get(pieces, F.col(f"_at_{a}")) for a in names])).otherwise(
        _found(tag, [attr(a) for a in names], ".*", '"', len(names))))
    value = {a: F.get("_values", F.lit(k)) for k, a in enumerate(names)}
    tags = tags.withColumn("_own", F.split(F.regexp_extract(value["ID"], r"\Astring_(\d+_\d+_\d+_\d+)\z", 1), "_"))
    number = lambda k, other: F.when(F.size("_own") > 1, F.get("_own", F.lit(k)).try_cast("int")).otherwise(other.cast("int"))
    first = lambda c: F.greatest(F.col(c), F.lit(1))
    return tags.select(
        *keys, F.col("_page").cast("int").alias("page"), number(0, first("_n_block")).alias("block"), number(1, F.lit(1)).alias("par"),
        number(2, first("_n_line")).alias("line"), number(3, first("_n_word")).alias("word"),
        *[value[a].try_cast("double").cast("int").alias(n) for n, a in (("left", "HPOS"), ("top", "VPOS"), ("width", "WIDTH"), ("height", "HEIGHT"))],
        F.round(value["WC"].try_cast("double") * 100).cast("int").alias("conf"), _xml_unescape(value["CONTENT"]).alias("text"))


# ---------------------------------------------------------------- L5 symbol boxes, L6 WordStr

def _symbols(words: DataFrame) -> DataFrame:
    """One row per symbol of a word: the word columns, ``i`` from 0, ``sym`` and the word's ``n`` symbols."""
    return words.withColumn("n", F.length("text")).select("*", F.posexplode(F.split("text", "")).alias("i", "sym"))


def _symbol_numbers(words: DataFrame) -> DataFrame:
    """``_symbols`` without ``sym``: nothing of the text is cut."""
    n = F.length("text")
    return words.withColumn("n", n).select("*", F.explode(F.sequence(F.lit(0), F.when(n > 0, n - 1).when(n == 0, 0))).alias("i"))


def _symbol_edges() -> tuple[Column, Column]:
    """Left and right edge of symbol ``i``: its share of the word's width."""
    edge = lambda k: (F.col("left") + F.floor(k * F.col("width") / F.col("n"))).cast("long")
    return edge(F.col("i")), edge(F.col("i") + 1)


def symbol_boxes(words: DataFrame, pages: DataFrame) -> DataFrame:
    """One box line per symbol: ``sym left bottom right top page`` with the y axis flipped
    (origin at the bottom) and a 0-based page. Symbols split the word box evenly."""
    # what is the same for all symbols of a word is formatted once; pages are the narrow side
    own = words.join(pages.hint("shuffle_hash"), PAGE).select(
        *PAGE, *LEVEL_KEYS["word"], "left", "width", "text", (F.col("page_height") - (F.col("top") + F.col("height"))).cast("string").alias("bottom_"),
        (F.col("page_height") - F.col("top")).cast("string").alias("top_"), (F.col("page") - 1).cast("string").alias("page_"))
    x0, x1 = _symbol_edges()
    return _symbols(own).select(*PAGE, *LEVEL_KEYS["word"], F.col("i").alias("symbol"), F.concat_ws(
        " ", F.col("sym"), x0.cast("string"), F.col("bottom_"), x1.cast("string"), F.col("top_"), F.col("page_")).alias("box"))


def wordstr_lines(words: DataFrame, pages: DataFrame) -> DataFrame:
    """One ``WordStr`` entry per text line: the line box (y flipped), the page (0-based), ``#`` and
    the line text, then the end-of-line marker box."""
    keys = PAGE + LEVEL_KEYS["textline"]
    boxes = component_boxes(words, "textline").join(line_texts(words), keys).join(pages, PAGE)
    l, r = F.col("left"), F.col("left") + F.col("width")
    b = F.col("page_height") - (F.col("top") + F.col("height"))
    t = F.col("page_height") - F.col("top")
    pg = F.col("page") - 1
    return boxes.select(*keys, F.concat(
        F.format_string("WordStr %d %d %d %d %d #", l, b, r, t, pg), F.col("text"),
        F.format_string("\n\t %d %d %d %d %d", r + 1, b, r + 5, t, pg)).alias("wordstr"))
