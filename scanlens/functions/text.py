"""Text Column builders: folding, clean-up of recognised text, debug escaping, trigram arrays.

All of these are native Spark expressions, so they stay inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col_(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# Code points whose lower-case form depends on their neighbours or takes more than one
# code point, each with the one code point it folds to.
FOLD_EXCEPTIONS = {"Σ": "σ", "ς": "σ", "İ": "i"}


def fold(c: Column | str) -> Column:
    """Case fold used by the index and every case-insensitive predicate (compute once, as a column).

    One code point becomes one code point whatever stands beside it, so offsets in the folded text
    are offsets in the text.
    """
    return F.lower(F.translate(col_(c), "".join(FOLD_EXCEPTIONS), "".join(FOLD_EXCEPTIONS.values())))


def fold_text(text: str) -> str:
    """The same fold for a pattern on the driver."""
    return text.translate(str.maketrans(FOLD_EXCEPTIONS)).lower()


def fold_literal(text: str) -> Column:
    """Fold a constant with the same function as the column side; Catalyst folds it to a literal."""
    return fold(F.lit(text))


def quote_regex(text: str) -> str:
    """``text`` as a Java regex that matches it literally (every other ASCII sign is escaped, so no
    text can end the quotation)."""
    return "".join("\\" + c if c.isascii() and not c.isalnum() else c for c in text)


def collapse_blank_lines(c: Column | str) -> Column:
    """One left-to-right pass of "\\n\\n" -> "\\n" (four newlines become two, as in the reference)."""
    return F.replace(col_(c), F.lit("\n\n"), F.lit("\n"))


def strip_chars(c: Column | str, chars: str) -> Column:
    """Character blacklist: every listed character is deleted."""
    return F.translate(col_(c), chars, "")


# Fixed value: characters the recognition step refuses to emit.
DEFAULT_BLACKLIST = "|®»«®©"


def keep_only(c: Column | str, char_class: str) -> Column:
    """Character whitelist: keep characters of the regex class body ``char_class`` and whitespace."""
    return F.regexp_replace(col_(c), f"[^{char_class}\\s]", "")


# The named escapes of the debug form.
NAMED_ESCAPES = {"\\": "\\\\", "\t": "\\t", "\r": "\\r", "\n": "\\n", "'": "\\'", '"': '\\"', "\0": "\\0"}
# Code points that are not printed: control, format, surrogate, private, unassigned, and separators other than the space.
_UNPRINTABLE = r"[\p{C}\p{Z}&&[^ ]]"
_TO_ESCAPE = r"[\p{C}\p{Z}\\'\"&&[^ ]]|^[\p{Mn}\p{Me}]"


def escape_debug(c: Column | str) -> Column:
    """Debug form of a text: named escapes, ``\\u{hex}`` for code points that are not printed and for
    a combining mark at the very start. Texts without any are passed through untouched."""
    x = col_(c)

    def one(ch: Column, i: Column) -> Column:
        out = F.when(ch == "\\", NAMED_ESCAPES["\\"])
        for raw, esc in NAMED_ESCAPES.items():
            if raw != "\\":
                out = out.when(ch == raw, esc)
        hidden = ch.rlike(_UNPRINTABLE) | ((i == 0) & ch.rlike(r"[\p{Mn}\p{Me}]"))
        return out.when(hidden, F.concat(F.lit("\\u{"), F.lower(F.hex(F.ascii(ch).cast("long"))), F.lit("}"))).otherwise(ch)

    escaped = F.array_join(F.transform(F.split(x, ""), one), "")
    return F.when(x.rlike(_TO_ESCAPE), escaped).otherwise(x)


def gram_array(folded: Column | str) -> Column:
    """Every 3-code-point window of an already folded text; [] for texts under 3 characters.

    One regex scan cuts the text into code points (astral characters included); three shifted slices
    of that array are zipped. Linear per row, and the lambda reads only its own arguments, so the
    optimizer cannot inline an array expression into it.
    """
    chars = F.regexp_extract_all(col_(folded), F.lit("(?s)."), 0)
    n = F.greatest(F.size(chars) - 2, F.lit(0))
    pairs = F.zip_with(F.slice(chars, 1, n), F.slice(chars, 2, n), lambda a, b: F.concat(a, b))
    return F.zip_with(pairs, F.slice(chars, 3, n), lambda a, b: F.concat(a, b))


def token_count(c: Column | str) -> Column:
    """Trigram tokens in a text: greatest(length - 2, 0)."""
    return F.greatest(F.length(col_(c)) - 2, F.lit(0))
