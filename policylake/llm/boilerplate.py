"""Problem 5: the main body of each page, by site style trees.

Pages of one host are merged into a style tree (Yi, Liu and Li, "Eliminating noisy information in web pages for data
mining", 2003): an element node is a chain of block elements (tag, id and classes), its content nodes are the lines
found in it, the items of a menu each for itself. A content that is on most of the pages that have the node has an entropy near
the largest possible, one of its own on each page a low one; a node's importance is one less the mean of its contents'
shares, weighted by words, with a tenth for the entropy of its presentation (the leaf tags in it), as the paper adds it. Inline and text-level elements
(p, li, h1, a, b, span, ...) belong to the presentation of their block, so headings stay with the text around them.

Copies of one policy would make a main body look repeated. A page therefore counts with one over the number of its host's
pages that hold the same long lines, estimated by the sizes of its groups of equal minimum hashes.

A node that few different pages of its host have tells little. The same statistics are therefore also taken over all
hosts, for the chain with its numbers masked and lines reduced to their wording, and weigh as much as ``prior_pages`` further pages
of the host: with the default of 3, a node on 4 different pages goes by both trees alike, one on 10 by its own host for three
quarters, one on a single page by all hosts. A branch is removed when its importance is low.

Every page is parsed once, in one Arrow pass; the trees are aggregations with map-side sums over (host, chain,
content), so that a host with a third of all pages costs no long task. Verdicts come back per host as one small map, joined with
the page rows; hot hosts are salted in that join.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from policylake.session import cut

# Elements that make a branch of the tree; all others are presentation.
BLOCKS = frozenset("html body div main article section aside nav header footer form table tr center ul ol dl font fieldset figure dialog".split())
# Blocks that only group lines inside their parent.
LISTS = frozenset("ul ol dl tr font".split())
VOID = frozenset("br hr img meta link input wbr area base col embed source track".split())
SKIP = frozenset("script style noscript template head svg".split())

_TOKEN = re.compile(r"<!--.*?-->|<!\[CDATA\[.*?\]\]>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>|<[!?][^>]*>|([^<]+|<)", re.S)
_ATTR = re.compile(r"(?:^|\s)(id|class|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_DIGITS = re.compile(r"\d+")
#: Names and numbers are masked where lines are compared over all hosts.
_NAME = re.compile(r"(?<![^\W_])(?:[A-ZÀ-ÖØ-ÞΑ-ΩА-Я][^\W\d_]*|\d+)(?:[.-][^\W_]+)*")

#: What stands between the items of a menu.
_ITEMS = re.compile(r"\s*[|·•/,»>–—:]\s*|\s{2,}")
#: Words of a line that counts when copies of a policy are looked for, and minimum hashes of them.
LONG_LINE, COPY_HASHES = 8, 4

PAGE = "fetch_id bigint, host string, chains array<string>, line_no array<int>, chain_no array<int>, tag array<string>, wording array<bigint>, n_words array<int>, content_chain array<int>, content array<bigint>, content_words array<int>, copies array<bigint>"


def text_nodes(markup: str) -> list[tuple[tuple[str, ...], str, str]]:
    """(chain of blocks, innermost tag, text) of every non-blank piece of text, in order; a text with line breaks gives a piece for each line."""
    stack: list[tuple[str, str | None]] = []
    out, chain, skip = [], [], None
    for m in _TOKEN.finditer(markup):
        close, tag, attrs, text = m.group(1), m.group(2), m.group(3), m.group(4)
        if text is not None:
            if skip is None:
                for line in html.unescape(text).split("\n"):
                    line = line.strip()
                    if line:
                        out.append((tuple(chain), stack[-1][0] if stack else "", line))
        elif tag is not None:
            tag = tag.lower()
            if skip is not None:
                if close and tag == skip:
                    skip = None
                continue
            if close:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == tag:
                        for _, name in stack[k:]:
                            if name is not None:
                                chain.pop()
                        del stack[k:]
                        break
            elif tag in SKIP:
                skip = None if attrs.endswith("/") else tag
            elif tag not in VOID and not attrs.endswith("/"):
                name = None
                if tag in BLOCKS and tag not in LISTS:
                    a = {k.lower(): v1 or v2 or v3 for k, v1, v2, v3 in _ATTR.findall(attrs)} if attrs else {}
                    name = tag + "".join(f"{c}{' '.join(a[k].split())}" for k, c in (("id", "#"), ("class", "."), ("role", "@")) if a.get(k))
                    chain.append(name)
                stack.append((tag, name))
    return out


def align(lines: list[tuple[int, str]], nodes: list) -> list[tuple[int, str, int]]:
    """(line number, line, node index or -1): lines of the text laid over the pieces of the page, both in order."""
    if len(lines) == len(nodes) and all(a[1] == n[2] for a, n in zip(lines, nodes)):
        return [(no, s, k) for k, (no, s) in enumerate(lines)]
    where: dict[str, list[int]] = {}
    for k, n in enumerate(nodes):
        where.setdefault(" ".join(n[2].split()), []).append(k)
    out, at = [], 0
    for no, s in lines:
        ks = where.get(" ".join(s.split()), ())
        k = next((x for x in ks if x >= at), ks[0] if ks else -1)
        if k >= at:
            at = k + 1
        out.append((no, s, k))
    return out


def contents(line: str) -> list[str]:
    """The content nodes of a line: the items of a menu (three or more of at most four words on average), or the line."""
    items = [x for x in _ITEMS.split(line) if x]
    return items if len(items) > 2 and len(line.split()) <= 4 * len(items) else [line]


def _copies(lines: list[str], page: int) -> list[int]:
    """Minimum hashes of a page's long lines; those of a page without any are its own."""
    hs = [xxhash.xxh3_64_intdigest(s) for s in lines if len(s.split()) >= LONG_LINE] or [xxhash.xxh3_64_intdigest(str(page))]
    return [min((h * m + 0x632BE59BD9B4E019) & (2**64 - 1) for h in hs) - (1 << 63) for m in _ODD]


_ODD = [0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93][:COPY_HASHES]


def _parser(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(fetch_id, host, html, text) -> PAGE."""
    kinds = (pa.int64(), pa.string(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()))
    for b in batches:
        rows = []
        for i, host, markup, text in zip(*(b.column(k).to_pylist() for k in range(4))):
            lines = [(k + 1, s) for k, x in enumerate(text.split("\n")) if (s := x.strip())]
            nodes = text_nodes(markup) if markup else []
            chains: dict[str, int] = {}
            no, cn, tags, wording, nw = [], [], [], [], []
            held: dict[tuple[int, int], int] = {}
            for n, s, k in align(lines, nodes):
                chain, tag = (" > ".join(nodes[k][0]), nodes[k][1]) if k >= 0 else ("?", "?")
                no.append(n)
                cn.append(chains.setdefault(chain, len(chains)))
                tags.append(tag)
                wording.append(xxhash.xxh3_64_intdigest(_NAME.sub("#", s)) - (1 << 63))
                nw.append(len(s.split()))
                if k >= 0:
                    for x in contents(s):
                        at = cn[-1], xxhash.xxh3_64_intdigest(x) - (1 << 63)
                        held[at] = held.get(at, 0) + len(x.split())
            rows.append((i, host, list(chains), no, cn, tags, wording, nw, [c for c, _ in held], [x for _, x in held], list(held.values()), _copies([s for _, s in lines], i)))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[x.split(" ")[0] for x in PAGE.split(", ")])


#: See style_tree.
PRIOR_PAGES, THRESHOLD = 3.0, 0.78


def mask(chain):
    """A chain without its numbers, to be compared over hosts."""
    return F.regexp_replace(chain, r"\d+", "#")


def _presentation(lines: DataFrame, keys: list[str]) -> DataFrame:
    """``lines, presentation`` of each node: the entropy of the leaf tags in it, as a share of the largest possible."""
    n = F.count(F.lit(1)).cast("double")
    t = lines.groupBy(*keys, "tag").agg(n.alias("n")).groupBy(*keys).agg(F.sum("n").alias("lines"), F.sum(F.col("n") * F.log2("n")).alias("n_log_n"), F.count(F.lit(1)).alias("tags"))
    return t.select(*keys, "lines", F.when(F.col("tags") > 1, (F.log2("lines") - F.col("n_log_n") / F.col("lines")) / F.log2("tags")).otherwise(F.lit(0.0)).alias("presentation"))


def _combined(content):
    """Importance: content and, with a tenth of the weight, presentation."""
    return F.lit(0.9) * F.least(F.lit(1.0), F.greatest(F.lit(0.0), content)) + F.lit(0.1) * F.col("presentation")


def all_hosts_tree(lines: DataFrame) -> DataFrame:
    """``masked, h_all``: importance of masked chains over all hosts, by the entropy of the wordings of their lines.

    Content is weighted by words, so that one long paragraph counts more than a short label; it has 1 where no
    wording comes twice and 0 where all are the same.
    """
    n = F.count(F.lit(1)).cast("double")
    c = lines.groupBy("masked", "wording").agg(F.sum("words").cast("double").alias("w"), n.alias("n"))
    c = c.groupBy("masked").agg(F.sum("w").alias("words"), F.sum(F.col("w") * F.log2("n")).alias("w_log_n")).join(_presentation(lines, ["masked"]), "masked")
    content = F.when(F.col("lines") > 1, 1 - F.col("w_log_n") / (F.greatest("words", F.lit(1.0)) * F.log2("lines"))).otherwise(F.lit(1.0))
    return c.select("masked", _combined(content).alias("h_all"))


def page_weights(pages: DataFrame) -> DataFrame:
    """``fetch_id, weight``: one over the mean size of a page's groups of equal minimum hashes on its host."""
    at = pages.select("fetch_id", "host", F.posexplode("copies").alias("turn", "copy"))
    size = at.groupBy("host", "turn", "copy").agg(F.count(F.lit(1)).alias("n"))
    return at.join(size, ["host", "turn", "copy"]).groupBy("fetch_id").agg((1 / F.avg("n")).alias("weight"))


def site_tree(pages: DataFrame, lines: DataFrame) -> DataFrame:
    """``host, chain, masked, different_pages, h_own``: the nodes of each host's own tree."""
    z = F.arrays_zip("content_chain", "content", "content_words")
    d = pages.join(page_weights(pages), "fetch_id").select("host", "chains", "weight", z.alias("z"))
    nodes = d.select("host", F.explode(F.filter("chains", lambda c: c != "?")).alias("chain"), "weight").groupBy("host", "chain").agg(F.sum("weight").alias("different_pages"))
    d = d.select("host", "chains", "weight", F.explode("z").alias("z"))
    d = d.select("host", F.element_at("chains", F.col("z.content_chain") + 1).alias("chain"), F.col("z.content").alias("content"), F.col("z.content_words").alias("words"), "weight")
    c = d.groupBy("host", "chain", "content").agg(F.sum("weight").alias("on"), F.sum(F.col("words") * F.col("weight")).alias("w"))
    c = c.groupBy("host", "chain").agg(F.sum("w").alias("words"), F.sum(F.col("w") * F.log2(F.greatest("on", F.lit(1.0)))).alias("w_log_on"))
    c = c.join(nodes, ["host", "chain"]).join(_presentation(lines, ["host", "chain"]), ["host", "chain"])
    content = F.when(F.col("different_pages") > 1.01, 1 - F.col("w_log_on") / (F.col("words") * F.log2("different_pages"))).otherwise(F.lit(1.0))
    return c.select("host", "chain", mask(F.col("chain")).alias("masked"), "different_pages", _combined(content).alias("h_own"))


def style_tree(fetches: DataFrame, *, host_col: str = "site_etld1", prior_pages: float = PRIOR_PAGES, threshold: float = THRESHOLD) -> DataFrame:
    """``fetch_id, line_no, main``: for every non-blank line of ``text`` whether it is part of the page's main body.

    Lines are counted from 1 with blank ones. Rows with a null id or text have no lines. A line that is not in the page's
    markup, or a page without markup, takes the verdict of its wording elsewhere and counts as main where there is none.
    ``prior_pages`` is how many further pages of a host, different from the first, must have a node for its own tree to weigh as much as all hosts';
    ``threshold`` the importance below which a branch is removed.
    """
    src = fetches.select(F.col("fetch_id").cast("bigint").alias("fetch_id"), F.coalesce(F.lower(F.col(host_col)), F.lit("")).alias("host"), F.coalesce("cleaned_html", "raw_html").alias("h"), "text").where("fetch_id is not null and text is not null")
    return classify(cut(src.mapInArrow(_parser, PAGE), "pages"), prior_pages, threshold)


def lines_of(pages: DataFrame) -> DataFrame:
    """A row per line of a page."""
    z = F.arrays_zip("line_no", "chain_no", "tag", "wording", "n_words")
    d = pages.select("fetch_id", "host", "chains", F.explode(z).alias("z"))
    return d.select("fetch_id", "host", F.element_at("chains", F.col("z.chain_no") + 1).alias("chain"), F.col("z.line_no").alias("line_no"), F.col("z.tag").alias("tag"), F.col("z.wording").alias("wording"), F.col("z.n_words").alias("words"))


def classify(pages: DataFrame, prior_pages: float = PRIOR_PAGES, threshold: float = THRESHOLD) -> DataFrame:
    """``fetch_id, line_no, main`` of parsed pages (PAGE)."""
    lines = lines_of(pages).where("chain <> '?'").withColumn("masked", mask(F.col("chain")))
    # One page compares with none: it says nothing of what comes again.
    others = F.greatest(F.col("different_pages") - 1, F.lit(0.0))
    weight = others / (others + F.lit(prior_pages))
    verdict = site_tree(pages, lines).join(all_hosts_tree(lines), "masked").select("host", "chain", (weight * F.col("h_own") + (1 - weight) * F.col("h_all") >= threshold).alias("main"))
    # Verdicts to pages by (host, chain): the pages of a hot host are spread over SALTS slices, their verdicts copied to each.
    salt = F.pmod(F.xxhash64("fetch_id"), F.lit(SALTS)).cast("int")
    at = pages.select("fetch_id", "host", salt.alias("salt"), F.posexplode("chains").alias("chain_no", "chain"))
    salted = verdict.where("main").select("host", "chain", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    kept = at.join(salted, ["host", "chain", "salt"], "left_semi").groupBy("fetch_id").agg(F.collect_set("chain_no").alias("kept"))
    z = F.arrays_zip("line_no", "chain_no", "wording")
    d = pages.select("fetch_id", F.array_position("chains", "?").alias("nowhere"), z.alias("z")).join(kept, "fetch_id", "left")
    d = d.select("fetch_id", "nowhere", F.coalesce("kept", F.array().cast("array<int>")).alias("kept"), F.explode("z").alias("z"))
    d = d.select("fetch_id", F.col("z.line_no").alias("line_no"), F.col("z.wording").alias("wording"), (F.col("nowhere") == F.col("z.chain_no") + 1).alias("lost"), F.array_contains("kept", F.col("z.chain_no")).alias("main"))
    found = d.where("not lost").select("fetch_id", "line_no", "main")
    # Lines without a place in the markup: what their wording is elsewhere.
    lost = d.where("lost").select("fetch_id", "line_no", "wording")
    words = d.where("not lost").join(lost.select("wording").distinct(), "wording", "left_semi").groupBy("wording").agg((F.avg(F.col("main").cast("int")) >= 0.5).alias("main"))
    return found.unionByName(lost.join(words, "wording", "left").select("fetch_id", "line_no", F.coalesce("main", F.lit(True)).alias("main")))


SALTS = 16


def p5_found(fetches: DataFrame, excluded: DataFrame) -> DataFrame:
    """fetch_id, line_no: lines that are no part of the policy, of all fetches but the ``excluded`` ones (fetch_id)."""
    d = fetches.join(excluded.select("fetch_id"), "fetch_id", "left_anti")
    return style_tree(d).where("not main").select("fetch_id", "line_no")
