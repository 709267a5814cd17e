"""The line cleaner of policy texts: windows over the lines of a document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from policylake.functions.common import SPACE, contains_any, strip
from policylake.functions.html import strip_links
from policylake.resources import fixed

_IMAGE = r"!\[[^\]]*\]\([^)]+\)"
_LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"
_PURE_LINK = rf"^{SPACE}*((?:#{{1,6}}{SPACE}+|[-*•]{SPACE}+|\d+\.{SPACE}+)?)\[([^\]]+)\]\([^)]+\){SPACE}*$"


def _norm(line: Column) -> Column:
    return F.regexp_replace(F.lower(strip(line)), f"{SPACE}+", " ")


def looks_like_heading(text: Column) -> Column:
    """A keep word, or at most 90 characters with three fifths of the words in capitals."""
    words = F.filter(F.split(strip(text), f"{SPACE}+"), lambda w: w != "")
    upper = F.size(F.filter(words, lambda w: w.rlike(r"^\p{Lu}")))
    return contains_any(F.lower(text), fixed.KEEP_KEYWORDS) | ((F.length(text) <= 90) & (F.size(words) > 0) & (upper / F.greatest(F.size(words), F.lit(1)) >= 0.6))


def _is_nav(line: Column, norm: Column, repeats: Column) -> Column:
    """Whether a line looks like navigation; the first rule that applies decides."""
    plain = F.trim(F.regexp_replace(norm, rf"^(?:[#*•\-\d.]|{SPACE})+", ""))
    return (
        F.when(contains_any(norm, fixed.FOOTER_TOKENS), True)
        .when(contains_any(norm, fixed.KEEP_KEYWORDS), False)
        .when(contains_any(norm, fixed.NAV_KEYWORDS), True)
        .when(line.startswith("#####") | line.startswith("* #####"), True)
        .when(line.contains("©") | norm.contains("copyright"), True)
        .when(norm.contains("yes") & norm.contains("no") & (F.length(norm) <= 12), True)
        .when(plain.isin(*fixed.SHORT_NAV_TOKENS), True)
        .when((repeats >= 3) & (F.length(norm) <= 80), True)
        .otherwise(False)
    )


def clean_lines(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id_col, line_no, line, blank_before``: the lines that stay, in order. One shuffle by id; documents are bounded, ids may be many.

    Rows of NULL or empty text have no lines. Ids are taken as unique: rows of one id are lines of one document.
    """
    d = df.select(F.col(f"`{id_col}`").alias("id"), F.posexplode(F.split(F.regexp_replace(text_col, _IMAGE, ""), _LINE_END)).alias("line_no", "raw")).where("raw is not null")
    d = d.withColumn("raw", strip(F.col("raw")))
    doc, before = Window.partitionBy("id"), Window.partitionBy("id").orderBy("line_no")
    # How often a line occurs is counted on the lines as they were, and looked up by what is left of them.
    d = d.withColumn("raw_norm", _norm(F.col("raw"))).withColumn("blanks", F.sum((F.col("raw") == "").cast("int")).over(before))
    d = d.withColumn("n_raw", F.count(F.lit(1)).over(Window.partitionBy("id", "raw_norm")))
    prefix, label = F.regexp_extract("raw", _PURE_LINK, 1), F.trim(F.regexp_extract("raw", _PURE_LINK, 2))
    pure = F.col("raw").rlike(_PURE_LINK)
    line = F.when(pure & (prefix != ""), F.concat(prefix, label)).when(pure & looks_like_heading(label), label).when(~pure, strip_links(F.col("raw")))
    d = d.withColumn("line", line)
    d = d.withColumn("norm", _norm(F.col("line")))
    web = F.col("line").contains("](http") | F.col("line").rlike(r"^(?:https?://|www\.)")
    c = F.coalesce((F.col("norm") != "") & ~web, F.lit(False))
    # A line whose links were taken out is counted under its own key only if that line occurs too.
    counts = d.where("raw_norm <> ''").select("id", F.col("raw_norm").alias("norm"), "n_raw").distinct()
    d = d.where(c).select("id", "line_no", "line", "norm", "blanks").join(counts, ["id", "norm"], "left")
    d = d.withColumn("idx", F.row_number().over(before) - 1).withColumn("n", F.count(F.lit(1)).over(doc))
    d = d.withColumn("blank_before", F.col("blanks") > F.coalesce(F.lag("blanks").over(before), F.lit(0)))
    norm = F.col("norm")
    d = d.withColumn("keep", contains_any(norm, fixed.KEEP_KEYWORDS)).withColumn("nav", _is_nav(F.col("line"), norm, F.coalesce("n_raw", F.lit(0))))
    starts = norm.contains("last updated") | (norm.contains("privacy") & (norm.contains("policy") | norm.contains("notice")))
    ends = contains_any(norm, fixed.FOOTER_TOKENS) | F.col("line").contains("©") | norm.contains("copyright")
    d = d.withColumn("start", F.min(F.when(starts, F.col("idx"))).over(doc))
    d = d.withColumn("end", F.min(F.when(ends & (F.col("idx") >= F.floor(F.col("n") * 0.6)), F.col("idx"))).over(doc))
    preamble = F.coalesce(F.col("idx") < F.col("start"), F.lit(False)) & (F.col("nav") | (F.length("norm") <= 30))
    footer = F.coalesce(F.col("idx") >= F.col("end"), F.lit(False))
    d = d.where((F.col("keep") | ~(preamble | footer | F.col("nav"))) & F.col("line").rlike(r"[\p{L}\p{N}]"))
    return d.select(F.col("id").alias(id_col), "line_no", "line", "blank_before")


def clean_policy_text(df: DataFrame, id_col: str, text_col: str, out_col: str = "cleaned") -> DataFrame:
    """``id_col, out_col`` for every distinct id: the cleaned text, empty where nothing stays."""
    lines = clean_lines(df, id_col, text_col)
    first = F.row_number().over(Window.partitionBy(id_col).orderBy("line_no")) == 1
    piece = F.when(F.col("blank_before") & ~F.col("first"), F.concat(F.lit("\n"), F.col("line"))).otherwise(F.col("line"))
    texts = lines.withColumn("first", first).groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("line_no", piece.alias("p")))).alias("ps"))
    texts = texts.select(id_col, strip(F.array_join(F.transform("ps", lambda p: p["p"]), "\n")).alias(out_col))
    return df.select(id_col).distinct().join(texts, id_col, "left").select(id_col, F.coalesce(out_col, F.lit("")).alias(out_col))


def line_frequency(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id_col, line, n``: how often each normalised, non-blank line occurs in its document."""
    d = df.select(id_col, F.explode(F.split(F.col(text_col), _LINE_END)).alias("raw")).select(id_col, _norm(F.col("raw")).alias("line"))
    return d.where("line <> ''").groupBy(id_col, "line").agg(F.count(F.lit(1)).alias("n"))
