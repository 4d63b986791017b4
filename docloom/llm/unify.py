"""One consistent form for texts that look the same (problem 9).

Texts are copied from Arrow into numpy code-point arrays. A table gives, for each code point, how many code points it
expands to and where they stand, so decomposing, folding full-width forms, unifying spaces and deleting invisible
characters is one gather; marks are then ordered and composed over the whole batch. No string call is made per row.

The form: full-width letters and digits become ordinary ones, canonical decompositions are composed (NFC), every Unicode
space separator becomes U+0020, zero-width characters and soft hyphens vanish, and look-alike letters of Latin, Cyrillic,
Greek, Armenian, Cherokee and Lisu take the script that the word's unambiguous letters have (else that of the text, else
Latin). Letter case, accents, raised digits, line breaks, tabs and punctuation stay, and so do letters of another style
(mathematical bold and the like).
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm._graph import cut_lineage
from docloom.llm._text import N_CODEPOINTS, TABLE_END, codepoints, row_of, scan_rows, to_strings

# Letters of other scripts and the Latin letters they look like.
CYRILLIC = dict(zip("АВСЕНІЈКМОРЅТХУасеіјорѕхуһԁԛԝӏ", "ABCEHIJKMOPSTXYaceijopsxyhdqwl", strict=True))
GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧαικνορυχ", "ABEZHIKMNOPTYXaikvopux", strict=True))
ARMENIAN = dict(zip("հոսօցԼՍՏՕ", "hnuogLUSO", strict=True))
CHEROKEE = dict(zip("ᎪᏴᏟᎠᎬᏀᎻᎫᏦᏞᎷᏢᏒᏚᎢᏙᎳᏃ", "ABCDEGHJKLMPRSTVWZ", strict=True))
LISU = dict(zip("ꓮꓐꓚꓓꓰꓝꓖꓧꓲꓙꓗꓡꓟꓠꓳꓑꓣꓢꓔꓴꓦꓪꓫꓬꓜ", "ABCDEFGHIJKLMNOPRSTUVWXYZ", strict=True))
# Latin letters that look like others of their script.
LATIN = {"ɡ": "g", "ɑ": "a"}
# Code points without width, as ranges (soft hyphen, joiners, marks of direction, variation selectors, byte-order mark).
INVISIBLE = [(0xAD, 0xAD), (0x34F, 0x34F), (0x61C, 0x61C), (0x180B, 0x180E), (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xE0100, 0xE01EF)]
LATIN_S, CYRILLIC_S, GREEK_S, ARMENIAN_S, CHEROKEE_S, LISU_S = 1, 2, 3, 4, 5, 6
#: Of each other script: its letters, its code points, and whether its texts are so common beside Latin ones that a Latin letter it imitates tells nothing.
OTHERS = {CYRILLIC_S: (CYRILLIC, range(0x400, 0x530), True), GREEK_S: (GREEK, range(0x370, 0x400), True), ARMENIAN_S: (ARMENIAN, range(0x531, 0x590), False), CHEROKEE_S: (CHEROKEE, range(0x13A0, 0x13F6), False), LISU_S: (LISU, range(0xA4D0, 0xA4F8), False)}
L0, V0, T0, S0, LN, VN, TN = 0x1100, 0x1161, 0x11A7, 0xAC00, 19, 21, 28


class _Tables:
    def __init__(self) -> None:
        self.size = np.ones(N_CODEPOINTS, np.int8)
        self.at = np.arange(N_CODEPOINTS, dtype=np.int64)
        flat: list[int] = []
        self.ccc = np.zeros(N_CODEPOINTS, np.uint8)
        self.letter = np.zeros(N_CODEPOINTS, bool)
        self.changes = np.zeros(N_CODEPOINTS, bool)
        pairs: dict[tuple[int, int], int] = {}

        def expand(i: int, to: str) -> None:
            self.size[i], self.at[i] = len(to), N_CODEPOINTS + len(flat)
            flat.extend(map(ord, to))

        for i in [*range(0x80, TABLE_END), *range(0x2F800, 0x2FA20)]:
            c = chr(i)
            kind = unicodedata.category(c)
            self.ccc[i] = unicodedata.combining(c)
            self.letter[i] = kind[0] in "LM"
            if kind == "Zs":
                expand(i, " ")
            elif 0xFF10 <= i <= 0xFF19 or 0xFF21 <= i <= 0xFF3A or 0xFF41 <= i <= 0xFF5A:
                expand(i, chr(i - 0xFEE0))
            elif not S0 <= i < S0 + LN * VN * TN and not 0xD800 <= i < 0xE000:
                to = unicodedata.normalize("NFD", c)
                if to != c:
                    expand(i, to)
                    parts = unicodedata.decomposition(c).split()
                    if len(parts) == 2 and unicodedata.normalize("NFC", c) == c:
                        pairs[int(parts[0], 16), int(parts[1], 16)] = i
        for a, b in INVISIBLE:
            self.size[a : b + 1] = 0
        self.letter[ord("A") : ord("Z") + 1] = self.letter[ord("a") : ord("z") + 1] = True
        self.flat = np.array(flat, np.uint32)
        keys = np.array([a << 21 | b for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.pair_keys, self.pair_to = keys[order], np.array(list(pairs.values()), np.uint32)[order]

        self.script = np.zeros(N_CODEPOINTS, np.uint8)
        for i in range(0x41, 0x250):
            if chr(i).isalpha():
                self.script[i] = LATIN_S
        self.same = np.arange(N_CODEPOINTS, dtype=np.uint32)  # the Latin letter of each look-alike
        self.to_script = {}
        self.ambiguous = np.zeros(N_CODEPOINTS, bool)
        for code, (letters, span, common) in OTHERS.items():
            self.script[span.start : span.stop] = code
            self.to_script[code] = np.arange(N_CODEPOINTS, dtype=np.uint32)
            for other, latin in letters.items():
                self.same[ord(other)] = ord(latin)
                self.to_script[code][ord(latin)] = ord(other)
                self.ambiguous[[ord(other), ord(latin)] if common else ord(other)] = True
        for other, latin in LATIN.items():
            self.same[ord(other)] = ord(latin)


@lru_cache(1)
def tables() -> _Tables:
    return _Tables()


def _gather(cp: np.ndarray, row: np.ndarray, t: _Tables) -> tuple[np.ndarray, np.ndarray]:
    """Each code point replaced by its expansion."""
    size = t.size[cp].astype(np.int64)
    start = t.at[cp]
    if (start == cp).all() and (size == 1).all():
        return cp, row
    from_ = np.repeat(start - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(int(size.sum()))
    out = from_.astype(np.uint32)
    far = from_ >= N_CODEPOINTS
    out[far] = t.flat[from_[far] - N_CODEPOINTS]
    return out, np.repeat(row, size)


def _compose(cp: np.ndarray, row: np.ndarray, t: _Tables) -> tuple[np.ndarray, np.ndarray]:
    """Canonical ordering and composition of marks, and of Hangul letters."""
    mark = t.ccc[cp]
    is_mark = mark > 0
    jamo = ((cp >= L0) & (cp < T0 + TN)).any() or False
    if not is_mark.any() and not jamo:
        return cp, row
    cp = cp.copy()
    if is_mark.any():
        run = np.cumsum(~is_mark | np.concatenate([[True], row[1:] != row[:-1]]))  # a starter and its marks share a number
        where = np.flatnonzero(is_mark)
        if len(where) > 1 and ((np.diff(where) == 1) & (mark[where[1:]] < mark[where[:-1]])).any():
            order = np.lexsort((mark[where], run[where]))
            cp[where] = cp[where][order]
            mark = t.ccc[cp]
        keep = np.ones(len(cp), bool)
        first = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))  # index of each run's head
        head = first[run[where] - 1]
        rank = np.arange(len(where)) - np.searchsorted(head, head)
        last = np.zeros(len(cp), np.uint8)  # class of the last mark that stayed, by head
        for k in range(int(rank.max()) + 1 if len(rank) else 0):
            w, h = where[rank == k], head[rank == k]
            proper = (w != h) & (t.ccc[cp[h]] == 0)
            w, h = w[proper], h[proper]
            key = cp[h].astype(np.int64) << 21 | cp[w].astype(np.int64)
            at = np.minimum(np.searchsorted(t.pair_keys, key), len(t.pair_keys) - 1)
            hit = (t.pair_keys[at] == key) & (last[h] < t.ccc[cp[w]])
            cp[h[hit]] = t.pair_to[at[hit]]
            keep[w[hit]] = False
            last[h[~hit]] = t.ccc[cp[w[~hit]]]
        cp, row = cp[keep], row[keep]
    if jamo:
        for make in ("LV", "LVT"):
            a, b, together = cp[:-1].astype(np.int64), cp[1:].astype(np.int64), row[1:] == row[:-1]
            if make == "LV":
                hit = together & (a >= L0) & (a < L0 + LN) & (b >= V0) & (b < V0 + VN)
                to = S0 + ((a - L0) * VN + (b - V0)) * TN
            else:
                hit = together & (a >= S0) & (a < S0 + LN * VN * TN) & ((a - S0) % TN == 0) & (b > T0) & (b < T0 + TN)
                to = a + (b - T0)
            cp = cp.copy()
            cp[:-1][hit] = to[hit].astype(np.uint32)
            keep = np.concatenate([[True], ~hit])
            cp, row = cp[keep], row[keep]
    return cp, row


def _scripts(cp: np.ndarray, row: np.ndarray, t: _Tables) -> np.ndarray:
    """Look-alike letters in the script of their word."""
    maybe = t.ambiguous[cp]
    if not (t.script[cp] > LATIN_S).any():
        return t.same[cp]
    letter = t.letter[cp]
    starts = letter & ~np.concatenate([[False], letter[:-1] & (row[1:] == row[:-1])])
    word = np.cumsum(starts) * letter  # 0: outside words
    n_words, n_rows = int(word.max()) + 1, int(row[-1]) + 1
    sure = letter & ~maybe & (t.script[cp] > 0)
    by_word = np.zeros((len(OTHERS) + 2, n_words), np.int64)
    by_row = np.zeros((len(OTHERS) + 2, n_rows), np.int64)
    for s in (LATIN_S, *OTHERS):
        sel = sure & (t.script[cp] == s)
        by_word[s] = np.bincount(word[sel], minlength=n_words)
        by_row[s] = np.bincount(row[sel], minlength=n_rows)
    best_row = np.where(by_row.max(0) > 0, by_row.argmax(0), LATIN_S)
    best_word = np.where(by_word.max(0) > 0, by_word.argmax(0), 0)
    chosen = best_word[word]
    chosen = np.where(chosen == 0, best_row[row], chosen)
    out = t.same[cp]
    for s in OTHERS:
        sel = (chosen == s) & letter
        out[sel] = t.to_script[s][out[sel]]
    return out


def unify_arrow(arr: pa.Array) -> pa.Array:
    """The consistent form of each string; null stays null."""
    cp, off = codepoints(arr)
    t = tables()
    n = len(off) - 1
    row = row_of(off)
    plain = np.ones(n, bool)
    plain[row[cp >= 0x80]] = False
    odd = ~plain[row]  # only rows with anything beyond ASCII can change
    if not odd.any():
        return arr.combine_chunks() if isinstance(arr, pa.ChunkedArray) else arr
    c, r = _gather(cp[odd], row[odd], t)
    c, r = _compose(c, r, t)
    if len(c):
        # a look-alike with an accent is told apart by its base letter, so letters are compared decomposed
        d, dr = _gather(c, r, t)
        d = _scripts(d, dr, t)
        c, r = _compose(d, dr, t)
    size = np.where(plain, np.diff(off), np.bincount(r, minlength=n))
    out = np.empty(int(size.sum()), np.uint32)
    is_plain = np.repeat(plain, size)
    out[is_plain], out[~is_plain] = cp[~odd], c
    done = to_strings(out, np.concatenate([[0], np.cumsum(size)]))
    if arr.null_count:
        import pyarrow.compute as pc

        done = pc.if_else(arr.is_valid(), done, pa.scalar(None, pa.string()))
    return done


def unify_text(df: DataFrame, text: str = "text", out: str = "unified_text") -> DataFrame:
    """df with a further column, the consistent form of column text.

    Null gives null, an empty text an empty one; a column already called out is replaced; other columns pass unchanged.
    """
    df = df.drop(out) if out != text else df
    schema = df.schema.fieldNames()
    target = df.select(*[F.col(f"`{c}`") for c in schema], F.col(f"`{text}`").alias(out)) if out != text else df

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in scan_rows(batch, text):
                at = part.schema.get_field_index(out)
                yield part.set_column(at, part.schema.field(at), unify_arrow(part.column(text)))

    return target.mapInArrow(run, target.schema)


def look_alike_pairs(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id_1, doc_id_2): documents whose texts differ but have one consistent form.

    Distinct texts of one form are paired first, by representative; documents join to those, so copies of one text never
    meet one another. Null texts take part in no pair.
    """
    keyed = _keyed(df, doc_id, text)
    several = keyed.groupBy("form").agg(F.min("same").alias("low"), F.max("same").alias("high")).where("low <> high").select("form")
    members = keyed.join(several, "form", "left_semi")
    kinds = members.select("form", "same").distinct()
    pairs = kinds.alias("a").join(kinds.alias("b"), (F.col("a.form") == F.col("b.form")) & (F.col("a.same") < F.col("b.same"))).select(F.col("a.form").alias("form"), F.col("a.same").alias("same_1"), F.col("b.same").alias("same_2"))
    one = members.select("form", F.col("same").alias("same_1"), F.col("doc_id").alias("id_1"))
    two = members.select("form", F.col("same").alias("same_2"), F.col("doc_id").alias("id_2"))
    return pairs.join(one, ["form", "same_1"]).join(two, ["form", "same_2"]).select(F.least("id_1", "id_2").alias("doc_id_1"), F.greatest("id_1", "id_2").alias("doc_id_2")).distinct()


def _keyed(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, form, same): hashes of each text's consistent form and of the text itself, made once and written down."""
    forms = unify_text(df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")).where("doc_id is not null and text is not null"), "text", "form")
    return cut_lineage(forms.select("doc_id", F.unhex(F.md5("form")).alias("form"), F.unhex(F.md5("text")).alias("same")))


def look_alike_groups(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, form_id, n_texts, n_links): each document with its class of equal-looking texts, the different texts in it, and
    the documents that look the same but have another text.

    One row for each doc_id and text, however many documents look alike. Null texts and ids give no row.
    """
    keyed = _keyed(df, doc_id, text).distinct()
    texts = keyed.groupBy("form", "same").agg(F.count("*").alias("n_same"))
    of_form = texts.groupBy("form").agg(F.count("*").alias("n_texts"), F.sum("n_same").alias("n_form"))
    return keyed.join(of_form, "form").join(texts, ["form", "same"]).select("doc_id", F.lower(F.hex("form")).alias("form_id"), "n_texts", (F.col("n_form") - F.col("n_same")).alias("n_links"))
