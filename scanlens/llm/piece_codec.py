"""SentencePiece BPE encoding and decoding from a prefix table.

The library's BPE joins, again and again, the adjacent symbols whose concatenation is the piece of
best score (ties to the left). For every prefix of a string the last token of its encoding is
unique, so a table with one token per prefix holds the whole encoding: token t may end prefix i if
it matches there (an Aho-Corasick automaton over the pieces finds all matches) and fits the last
token p of prefix i - len(t), that is if p + t alone encode to exactly [p, t]. The ids are then
recovered backwards, from the last prefix. Tests of pairs are remembered; strings are taken in
sorted order, so the table of a common prefix is computed once. The cost grows linearly with a
string's length, however long.

White space: a space is the piece character U+2581 and one stands before every text. No piece has
that character after another one, so a text falls into words that are encoded independently; words
are remembered per process in two bounded generations.

Characters without a piece fall back to their UTF-8 bytes. Decoding joins the pieces, turns U+2581
back into spaces, drops the one before the text, and decodes byte pieces as UTF-8 (every malformed
byte becomes U+FFFD). Control ids decode to nothing.

Edge cases. Null or empty text: only the end id, decoded to the empty text. A literal U+2581 counts
as a space, as in the library, and is decoded as one. Repeated rows and null doc_id: a row each.
Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import codecs
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import clean_batches, held, with_text

SPACE = "▁"
#: remembered tests of token pairs; the memory starts anew beyond it
MOST_PAIRS = 300_000
# every byte that is not part of a character becomes one U+FFFD
codecs.register_error("piece_bytes", lambda e: ("\ufffd", e.start + 1))


@dataclass(frozen=True)
class PieceOptions:
    model: str
    #: words that a process remembers in each of two generations
    remembered: int = 150_000


class PieceModel:
    """Vocabulary of a model file and the prefix-table encoder over it."""

    def __init__(self, path: str):
        import ahocorasick
        from sentencepiece import SentencePieceProcessor
        from sentencepiece import sentencepiece_model_pb2 as pb

        spec = pb.ModelProto()
        with open(path, "rb") as f:
            spec.ParseFromString(f.read())
        norm = spec.normalizer_spec
        if spec.trainer_spec.model_type != 2 or norm.precompiled_charsmap or norm.remove_extra_whitespaces \
                or not norm.add_dummy_prefix or not norm.escape_whitespaces or not spec.trainer_spec.byte_fallback:
            raise ValueError("only BPE models with byte fallback and identity normalisation are supported")
        sp = SentencePieceProcessor(model_file=path)  # the vocabulary is all that is taken from it
        self.size, self.end = sp.get_piece_size(), sp.eos_id()
        self.text: list[str] = [sp.id_to_piece(i) for i in range(self.size)]
        self.byte: dict[int, int] = {}
        self.of: dict[str, int] = {}
        self.score: list[float] = [sp.get_score(i) for i in range(self.size)]
        for i, t in enumerate(self.text):
            if sp.is_byte(i):
                self.byte[int(t[3:5], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.of[t] = i
        if any(SPACE in t.lstrip(SPACE) for t in self.of):
            raise ValueError("a piece has white space after another character")
        self.value = {i: b for b, i in self.byte.items()}
        self.plain = [t.replace(SPACE, " ") if t in self.of and self.of[t] == i else "" for i, t in enumerate(self.text)]
        self.length = [len(t) for t in self.text]
        self.automaton = ahocorasick.Automaton()
        for t, i in self.of.items():
            self.automaton.add_word(t, i)
        self.automaton.make_automaton()
        self.whole = [self.of.get(t) == i and self._merged(t) == [t] for i, t in enumerate(self.text)]
        self.fits: dict[int, bool] = {}

    def _merged(self, text: str) -> list[str]:
        """The library's merges carried out on a short string, the definition that pairs are tested by."""
        parts, of, score = list(text), self.of, self.score
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                i = of.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or score[i] > best):
                    best, at = score[i], k
            if best is None:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def encode_sorted(self, words: list[str]) -> Iterator[list[int]]:
        """Ids of every string; sorted input shares the tables of common prefixes.

        ``last[i]`` is the last token of the prefix of i characters; ~code point for a character
        that no piece covers.
        """
        fits, length, whole, size, matches = self.fits, self.length, self.whole, self.size, self.automaton.iter
        text = self.text
        last: list[int] = [0]
        prev = ""
        for w in words:
            n = len(w)
            if len(last) <= n:
                last.extend([0] * (n + 1 - len(last)))
            done, stop = 0, min(n, len(prev))
            while done < stop and w[done] == prev[done]:
                done += 1
            for at, t in matches(w):
                i = at + 1
                if i <= done:
                    continue
                while i > done + 1:
                    last[done + 1] = ~ord(w[done])
                    done += 1
                j = i - length[t]
                p = last[j] if j else -1
                if p < 0:
                    ok = whole[t]
                else:
                    key = p * size + t
                    ok = fits.get(key)
                    if ok is None:
                        a, b = text[p], text[t]
                        ok = fits[key] = self._merged(a + b) == [a, b]
                if ok:
                    last[i] = t
                    done = i
            while done < n:
                last[done + 1] = ~ord(w[done])
                done += 1
            ids, i = [], n
            while i > 0:
                t = last[i]
                if t >= 0:
                    ids.append(t)
                    i -= length[t]
                else:
                    ids.extend(self.byte[b] for b in reversed(chr(~t).encode()))
                    i -= 1
            ids.reverse()
            prev = w
            yield ids

    def decode(self, ids: list[int], first: bool = True) -> str:
        """The text of ids; ``first``: drop the space before the text."""
        out, raw = [], bytearray()
        for i in ids:
            b = self.value.get(i)
            if b is not None:
                raw.append(b)
                continue
            if raw:
                out.append(raw.decode("utf-8", "piece_bytes"))
                raw = bytearray()
            out.append(self.plain[i])
        if raw:
            out.append(raw.decode("utf-8", "piece_bytes"))
        text = "".join(out)
        return text[1:] if first and text[:1] == " " and ids and self.plain[ids[0]][:1] == " " else text


class WordMemory:
    """Texts as lists of words, encoded through a bounded memory of words."""

    def __init__(self, model: PieceModel, remembered: int):
        self.model, self.remembered = model, remembered
        self.known: dict[str, str] = {}
        self.older: dict[str, str] = {}
        #: decoded text by ids, both of one word; it knows nothing of the words
        self.decoded: dict[str, str] = {}

    @staticmethod
    def words(text: str) -> list[str]:
        """Words without the space before them; further spaces stay with the word they stand before."""
        if not text:
            return []
        parts = text.replace(SPACE, " ").split(" ")
        if "" not in parts:
            return parts
        out, spaces = [], 0
        for k, p in enumerate(parts):
            if p or k == len(parts) - 1:
                out.append(" " * spaces + p)
                spaces = 0
            else:
                spaces += 1
        return out

    def _learn(self, new: list[str]) -> None:
        if len(self.model.fits) > MOST_PAIRS:
            self.model.fits.clear()
        spelled = sorted(SPACE + w.replace(" ", SPACE) for w in new)
        for s, ids in zip(spelled, self.model.encode_sorted(spelled)):
            w = s[1:].replace(SPACE, " ")
            self.known[w] = " ".join(map(str, ids))

    def _decode(self, spelled: list[str]) -> list[str]:
        """Decoded texts of ids (decimal text) of words."""
        if len(self.decoded) > self.remembered:
            self.decoded.clear()
        found = list(map(self.decoded.get, spelled))
        for k, text in enumerate(found):
            if text is None:
                ids = spelled[k]
                found[k] = self.decoded[ids] = self.model.decode(list(map(int, ids.split(" "))), first=False)
        return found

    def _find(self, words: list[str]) -> list[str]:
        """Ids (decimal text) of distinct words."""
        if len(self.known) > self.remembered:
            self.known, self.older = {}, self.known
        found = list(map(self.known.get, words))
        absent = [k for k, v in enumerate(found) if v is None]
        if absent:
            names = [words[k] for k in absent]
            older = list(map(self.older.get, names))
            self.known.update((w, v) for w, v in zip(names, older) if v is not None)
            self._learn([w for w, v in zip(names, older) if v is None])
            for k, v in zip(absent, map(self.known.__getitem__, names)):
                found[k] = v
        return found

    def encode(self, texts: pa.Array) -> list[tuple[str, str]]:
        """(ids as decimal text with single spaces, decoded text) per text (no nulls), end id included.

        Arrow cuts the texts at spaces and numbers the distinct words; only those go through the
        memory.
        """
        raw = texts.to_pylist()
        cut = [None if t and "  " not in t and SPACE not in t and t[0] != " " and t[-1] != " " else self.words(t) for t in raw]
        plain = pa.array([c is None for c in cut])
        lists = pc.split_pattern(texts.filter(plain), " ")
        rest = [c for c in cut if c is not None]
        if rest:
            lists = pa.concat_arrays([lists, pa.array(rest, lists.type)])
        offs = lists.offsets.to_pylist()
        coded = lists.flatten().dictionary_encode()
        names = coded.dictionary.to_pylist()
        ids = self._find(names)
        spelled, back = np.array(ids, dtype=object), np.array(self._decode(ids), dtype=object)
        at = coded.indices.to_numpy()
        order = [k for k, c in enumerate(cut) if c is None] + [k for k, c in enumerate(cut) if c is not None]
        out: list = [None] * len(raw)
        end = str(self.model.end)
        for k, i, j in zip(order, offs[:-1], offs[1:]):
            own = at[i:j]
            out[k] = (" ".join([*spelled[own].tolist(), end]), "".join(back[own].tolist())[1:])
        return out


def memory(opt: PieceOptions) -> WordMemory:
    return held(f"pieces {opt}", lambda: WordMemory(PieceModel(opt.model), opt.remembered))


def pieces(docs: DataFrame, opt: PieceOptions, keep: list[str], digest: bool = False) -> DataFrame:
    """``keep`` columns plus n_tokens and either ids (array of int) and decoded (text) or their sha256
    digests (of the decimal ids joined by one space, and of the decoded text)."""
    out = "n_tokens long, " + ("ids_sha256 string, decoded_sha256 string" if digest else "ids array<int>, decoded string")
    base, at, ddl = with_text(docs, keep, out)
    names = [*keep, *[f.split()[0] for f in out.split(", ")]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mem = memory(opt)
        for b in clean_batches(batches, 4 << 20, f"pieces {opt}"):
            rows = mem.encode(b.column(at).fill_null(""))
            many = pa.array([r[0].count(" ") + 1 for r in rows], pa.int64())
            if digest:
                sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
                more = [pa.array([sha(r[k]) for r in rows], pa.string()) for k in (0, 1)]
            else:
                more = [pa.array([np.array(r[0].split(" "), np.int32) for r in rows], pa.list_(pa.int32())),
                        pa.array([r[1] for r in rows], pa.string())]
            yield pa.RecordBatch.from_arrays([*b.columns[:len(keep)], many, *more], names=names)

    return base.mapInArrow(run, ddl)
