"""Problem 10: one consistent form for texts that look the same.

A longest-match transducer over grapheme clusters (a base character with its combining marks and
invisible characters). Its mapping is computed once from the rules below and checked for conflicts
when the module is loaded; each text is rewritten in a single pass, and a text of ASCII alone is
returned as it is.

What changes: full- and half-width forms, ligatures, the kind of a space, invisible characters,
hyphens of the same look, decomposed accents, look-alike letters of other scripts.
What stays: accents, case, line breaks, the number of spaces, wording.
"""

from __future__ import annotations

import re
import unicodedata
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from policylake.session import cut

# Letters of other scripts that look like a Latin letter (a subset of the public
# Unicode confusables, letters whose usual shapes do not differ).
LOOKALIKES = (
    "аa еe оo рp сc уy хx іi ѕs јj һh ԁd ԛq ԝw ӏl ѵv "
    "АA ВB ЕE КK МM НH ОO РP СC ТT УY ХX ІI ЅS ЈJ ԌG ԚQ ԜW ӀI ѴV "
    "οo νv ρp ϲc ϳj "
    "ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX ϹC ϴΘ "
    "օo ɑa ɡg"
)
# Hyphens drawn like the ASCII one.
HYPHENS = "‐‑﹣"
# Half-width sound marks, which belong to the letter before them.
HALF_MARKS = "ﾞﾟ"
# Ranges of characters without a look of their own, beside the category Cf.
INVISIBLE = ((0x034F, 0x034F), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x2065, 0x2065), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFFA0, 0xFFA0), (0xE0100, 0xE01EF))


def _codepoints():
    """The blocks that hold letters with other widths, spaces, combining marks or invisible characters."""
    return chain(range(0x80, 0x12000), range(0x16100, 0x17000), range(0x1BCA0, 0x1BCA4), range(0x1D165, 0x1D245), range(0x1E000, 0x1E950), range(0xE0000, 0xE01F0))


def _build() -> tuple[dict[str, str], set[str]]:
    """The per-character mapping and the set of invisible characters."""
    table: dict[str, str] = {}
    invisible = {chr(c) for a, b in INVISIBLE for c in range(a, b + 1)}
    for c in _codepoints():
        ch = chr(c)
        cat = unicodedata.category(ch)
        if cat in ("Cn", "Co", "Cs"):
            continue
        if cat == "Cf" and not 0x0600 <= c <= 0x0605:
            invisible.add(ch)
        elif cat == "Zs" and c != 0x1680:
            table[ch] = " "
        else:
            kind = unicodedata.decomposition(ch).split(" ")[0]
            if kind in ("<wide>", "<narrow>") or 0xFB00 <= c <= 0xFB06:
                table[ch] = unicodedata.normalize("NFKC", ch)
    table.update({h: "-" for h in HYPHENS})
    table.update({p[0]: p[1] for p in LOOKALIKES.split(" ")})
    table = {k: v for k, v in table.items() if k not in invisible}
    # A full-width form may lead to a character that has a rule itself: follow it to its end.
    for k in list(table):
        for _ in range(4):
            v = "".join(table.get(x, x) for x in table[k] if x not in invisible)
            if v == table[k]:
                break
            table[k] = v
    for k, v in table.items():  # conflict check: what a rule yields must not be rewritten by another
        if any(x in table or x in invisible for x in v):
            raise AssertionError(f"conflicting rules for {k!r}")
    return table, invisible


_TABLE, _INVISIBLE = _build()


def _ranges(chars) -> str:
    """A regular-expression class for the characters."""
    out, run = [], []
    for c in sorted(map(ord, chars)) + [-9]:
        if run and c == run[-1] + 1:
            run.append(c)
            continue
        if run:
            out.append(f"{re.escape(chr(run[0]))}-{re.escape(chr(run[-1]))}" if len(run) > 1 else re.escape(chr(run[0])))
        run = [c]
    return "".join(out)


_MARK = "[" + _ranges({chr(c) for c in _codepoints() if unicodedata.category(chr(c))[0] == "M" or 0x1160 <= c <= 0x11FF} | set(HALF_MARKS) | _INVISIBLE) + "]"
#: A cluster that may need rewriting: any non-ASCII base or an ASCII base followed by a mark, with all its marks.
_CLUSTER = re.compile(f"(?:[^\\x00-\\x7f]|[\\x00-\\x7f](?={_MARK})){_MARK}*")


class _Clusters(dict):
    """Clusters rewritten so far; a cluster is computed when it is first met."""

    def __missing__(self, cluster: str) -> str:
        s = "".join(_TABLE.get(c, c) for c in cluster if c not in _INVISIBLE)
        s = "".join(_TABLE.get(c, c) for c in unicodedata.normalize("NFD", s))
        s = unicodedata.normalize("NFC", s)
        if len(self) > 200_000:
            self.clear()
        self[cluster] = s
        return s


_CLUSTERS = _Clusters()


def canonical(text: str) -> str:
    """The consistent form of one text; idempotent."""
    if text.isascii():
        return text
    return _CLUSTER.sub(lambda m: _CLUSTERS[m.group()], text)


def with_canonical(df: DataFrame, text_col: str = "text", out_col: str = "canonical_text") -> DataFrame:
    """``df`` with ``out_col``, the consistent form of ``text_col``; null stays null, empty stays empty.

    One Arrow pass without a shuffle. All other columns are kept, one of the name ``out_col`` is replaced.
    """

    def form(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else canonical(t) for t in texts.to_pylist()], pa.string())

    return df.withColumn(out_col, F.arrow_udf(form, "string")(F.col(f"`{text_col}`").cast("string")))


def _text_hash(col: Column) -> list[Column]:
    """128 bits of a text as two columns."""
    return [F.xxhash64(col), F.xxhash64(F.lit(7), col)]


def same_look_pairs(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Pairs (id_a < id_b) whose non-empty texts differ as stored and have one consistent form.

    Rows with a null id, a null or an empty text are in no pair. Rows of one stored text form a class;
    classes meet on the hash of their consistent form and only then are their members listed, so that a
    text copied millions of times never pairs with itself.
    """
    d = with_canonical(
        df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("t")).where("id is not null and t is not null and t <> ''"), "t", "c"
    )
    (c1, c2), (t1, t2) = _text_hash(F.col("c")), _text_hash(F.col("t"))
    d = d.select("id", c1.alias("c1"), c2.alias("c2"), t1.alias("t1"), t2.alias("t2"))
    d = cut(d, "textform")  # hashes only: a few bytes a text
    classes = d.groupBy("c1", "c2", "t1", "t2").agg(F.count(F.lit(1)).alias("n"))
    a = classes.select("c1", "c2", F.col("t1").alias("a1"), F.col("t2").alias("a2"))
    b = classes.select("c1", "c2", F.col("t1").alias("b1"), F.col("t2").alias("b2"))
    looks = a.join(b, ["c1", "c2"]).where("a1 < b1 or (a1 = b1 and a2 < b2)").select("a1", "a2", "b1", "b2")
    members = d.select("id", "t1", "t2")
    ia, ib = F.col("ia"), F.col("ib")
    return (
        looks.join(members.select(F.col("id").alias("ia"), F.col("t1").alias("a1"), F.col("t2").alias("a2")), ["a1", "a2"])
        .join(members.select(F.col("id").alias("ib"), F.col("t1").alias("b1"), F.col("t2").alias("b2")), ["b1", "b2"])
        .where(ia != ib)
        .select(F.least(ia, ib).alias(f"{id_col}_a"), F.greatest(ia, ib).alias(f"{id_col}_b"))
        .distinct()
    )
