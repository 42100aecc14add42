"""DuckDB oracle SQL for the page documents (hOCR and ALTO), built level by level like the Spark side."""

from __future__ import annotations

from ..sources.fixtures import with_views

Q = "'"


def xml_escape(e: str) -> str:
    for raw, esc in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        e = "replace(" + e + ", " + Q + raw.replace(Q, Q + Q) + Q + ", " + Q + esc + Q + ")"
    return e


def box_cte(level_keys: str, name: str) -> str:
    return (name + " AS (SELECT image_id, page, " + level_keys + ', min("left") AS bl, min(top) AS bt, '
            'max("left" + width) - min("left") AS bw, max(top + height) - min(top) AS bh FROM words GROUP BY image_id, page, '
            + level_keys + ")")


PAGES = "pages AS (SELECT id AS image_id, 1 AS page, width AS page_width, height AS page_height FROM images)"
NL = "chr(10)"


def _bbox(a: str) -> str:
    return f"{a}.bl, ' ', {a}.bt, ' ', {a}.bl + {a}.bw, ' ', {a}.bt + {a}.bh"


def _with(sql: str, *ctes: str) -> str:
    return with_views("", "images", "words").rstrip("\n") + "".join(",\n" + c for c in ctes) + "\n" + sql


def hocr_sql() -> str:
    word = ("concat('<span class=''ocrx_word'' id=''word_', w.page, '_', w.block, '_', w.par, '_', w.line, '_', w.word, "
            "''' title=''bbox ', w.\"left\", ' ', w.top, ' ', w.\"left\" + w.width, ' ', w.top + w.height, "
            "'; x_wconf ', w.conf, '''>', " + xml_escape("w.text") + ", '</span>')")
    line = ("SELECT w.image_id, w.page, w.block, w.par, w.line, concat('<span class=''ocr_line'' id=''line_', w.page, '_', "
            "w.block, '_', w.par, '_', w.line, ''' title=\"bbox ', " + _bbox("z") + ", '\">', string_agg(" + word
            + ", ' ' ORDER BY w.word), '</span>') AS h FROM words w JOIN lb z USING (image_id, page, block, par, line) "
            "GROUP BY w.image_id, w.page, w.block, w.par, w.line, z.bl, z.bt, z.bw, z.bh")
    par = ("SELECT l.image_id, l.page, l.block, l.par, concat('<p class=''ocr_par'' id=''par_', l.page, '_', l.block, '_', "
           "l.par, ''' title=\"bbox ', " + _bbox("y") + ", '\">', " + NL + ", string_agg(l.h, " + NL
           + " ORDER BY l.line), " + NL + ", '</p>') AS h FROM (" + line + ") l JOIN pb y USING (image_id, page, block, par) "
           "GROUP BY l.image_id, l.page, l.block, l.par, y.bl, y.bt, y.bw, y.bh")
    block = ("SELECT r.image_id, r.page, r.block, concat('<div class=''ocr_carea'' id=''block_', r.page, '_', r.block, "
             "''' title=\"bbox ', " + _bbox("x") + ", '\">', " + NL + ", string_agg(r.h, " + NL + " ORDER BY r.par), "
             + NL + ", '</div>') AS h FROM (" + par + ") r JOIN bb x USING (image_id, page, block) "
             "GROUP BY r.image_id, r.page, r.block, x.bl, x.bt, x.bw, x.bh")
    page = ("SELECT b.image_id, b.page, concat('<div class=''ocr_page'' id=''page_', b.page, ''' title=''image \"', "
            "b.image_id, '\"; bbox 0 0 ', p.page_width, ' ', p.page_height, '; ppageno ', b.page - 1, '''>', " + NL
            + ", string_agg(b.h, " + NL + " ORDER BY b.block), " + NL + ", '</div>', " + NL + ") AS hocr FROM ("
            + block + ") b JOIN pages p USING (image_id, page) GROUP BY b.image_id, b.page, p.page_width, p.page_height")
    return _with(page, PAGES, box_cte("block, par, line", "lb"), box_cte("block, par", "pb"), box_cte("block", "bb"))


def _pos(a: str) -> str:
    return (f"'HPOS=\"', {a}.bl, '\" VPOS=\"', {a}.bt, '\" WIDTH=\"', {a}.bw, '\" HEIGHT=\"', {a}.bh, '\"'")


def alto_sql() -> str:
    wc = "CASE WHEN w.conf >= 100 THEN '1.00' ELSE '0.' || lpad(CAST(w.conf AS VARCHAR), 2, '0') END"
    string = ("concat('<String ID=\"string_', w.block, '_', w.par, '_', w.line, '_', w.word, '\" HPOS=\"', w.\"left\", "
              "'\" VPOS=\"', w.top, '\" WIDTH=\"', w.width, '\" HEIGHT=\"', w.height, '\" WC=\"', " + wc
              + ", '\" CONTENT=\"', " + xml_escape("w.text") + ", '\"/>')")
    line = ("SELECT w.image_id, w.page, w.block, w.par, w.line, concat('<TextLine ID=\"line_', w.block, '_', w.par, '_', "
            "w.line, '\" ', " + _pos("z") + ", '>', string_agg(" + string + ", '<SP/>' ORDER BY w.word), '</TextLine>') AS a "
            "FROM words w JOIN lb z USING (image_id, page, block, par, line) "
            "GROUP BY w.image_id, w.page, w.block, w.par, w.line, z.bl, z.bt, z.bw, z.bh")
    block = ("SELECT l.image_id, l.page, l.block, concat('<TextBlock ID=\"block_', l.block, '\" ', " + _pos("x") + ", '>', "
             + NL + ", string_agg(l.a, " + NL + " ORDER BY l.par, l.line), " + NL + ", '</TextBlock>') AS a FROM ("
             + line + ") l JOIN bb x USING (image_id, page, block) GROUP BY l.image_id, l.page, l.block, x.bl, x.bt, x.bw, x.bh")
    page = ("SELECT b.image_id, b.page, concat('<?xml version=\"1.0\" encoding=\"UTF-8\"?>', " + NL
            + ", '<alto xmlns=\"http://www.loc.gov/standards/alto/ns-v3#\">', " + NL + ", '<Layout>', " + NL
            + ", '<Page WIDTH=\"', p.page_width, '\" HEIGHT=\"', p.page_height, '\" PHYSICAL_IMG_NR=\"', b.page, "
            "'\" ID=\"page_', b.page, '\">', " + NL + ", '<PrintSpace HPOS=\"0\" VPOS=\"0\" WIDTH=\"', p.page_width, "
            "'\" HEIGHT=\"', p.page_height, '\">', " + NL + ", string_agg(b.a, " + NL + " ORDER BY b.block), " + NL
            + ", '</PrintSpace>', " + NL + ", '</Page>', " + NL + ", '</Layout>', " + NL + ", '</alto>', " + NL
            + ") AS alto FROM (" + block + ") b JOIN pages p USING (image_id, page) "
            "GROUP BY b.image_id, b.page, p.page_width, p.page_height")
    return _with(page, PAGES, box_cte("block, par, line", "lb"), box_cte("block", "bb"))
