"""Problem 4: template residue, filler and error pages in place of content.

Messages (the sentences of a page's lines, or a whole error message) are mined for templates with a fixed-depth
prefix tree (He et al., "Drain", ICWS 2017): the number of tokens, then the first tokens, lead to a leaf; in the leaf the
most similar template takes the message, and positions that differ become wildcards. A message is classified on its own
words before it enters the tree and its verdict is a part of the leaf's path, so that no wildcard erases the words that
decide, and what is found in one text does not depend on the others. Each task grows a tree of its own part; the parts'
templates, whose number depends on the variety of messages and not on how many there are, are merged by the same tree,
leaf by leaf; the verdict of a template is that of all its messages. Unresolved slots inside ordinary texts are looked for separately, in the texts.

One Arrow pass reads every text whole; the only shuffles are those of the templates and of the few texts with a verdict.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from policylake.session import cut

WILD = "<*>"
# What is variable in a message, replaced before the tree.
MASKS = (
    (r"https?://\S+", WILD),
    (r"(?<!\w)(?:[a-z0-9-]+\.)+(?:example|test|invalid|com|net|org|io|co|de|fr)(?![\w-])", WILD),
    (r"(?<![\w<-])/[a-z0-9_/.-]{2,}", WILD),
    (r"(?<!\w)(?=[0-9a-f]*\d)[0-9a-f]{6,}(?!\w)", WILD),
    (r"\d+(?:[.,:]\d+)*", WILD),
)
_MASK = re.compile("|".join(f"(?:{p})" for p, _ in MASKS))
#: What every masked part holds; messages without it are left alone.
_VARIABLE = re.compile(r"\d|/[a-z0-9_]|\w\.\w")
_SENTENCE = re.compile(r"(?<=[.!?。])\s+|\n+")

# Names of template fields.
FIELDS = "company|name|brand|site|website|web|address|date|effective|entity|legal|e-?mail|contact|dpo|url|domain|phone|country|city|state|organi[sz]ation|owner|business|product|service|title|text|your|insert|here|officer|controller|author|client|firm|app"
_FIELD = rf"(?:{FIELDS})(?:[ _-]?(?:{FIELDS}))*"
# Forms of an unfilled slot. Names are those above where the form alone could be ordinary text.
SLOTS = (
    r"\{\{[^{}\n]{1,60}\}\}",
    r"\[\[[^\[\]\n]{1,60}\]\]",
    r"<%[^%\n]{1,80}%>",
    r"<\?(?:php|=)[^\n]{1,80}?\?>",
    r"[$#%]\{[A-Za-z_][\w. ]{0,60}\}",
    r"%\([A-Za-z_]\w*\)[sdrf]",
    r"(?<![\w%])%[sd](?!\w)",
    r"(?<![\w%])%[A-Za-z][A-Za-z_ ]{1,40}[A-Za-z]%(?!\w)",
    r"@@[A-Za-z][\w ]{0,60}@@",
    r"(?<!\w)__[A-Za-z][A-Za-z_ ]{1,60}?__(?!\w)",
    r"(?<![\w{$#%])\{(?:[A-Za-z_][\w.]*(?:![rsa])?|\d{1,2})\}(?!\})",
    r"(?i)[\[(](?:insert|enter|add|fill in|your) [^\[\]()\n]{1,60}[\])]",
    rf"(?i)(?<!\[)\[{_FIELD}\](?!\])",
    rf"(?i)<{_FIELD}>",
    r"<(?:error|reason|message|cause|exception)>",
)
#: Where a slot can begin.
_SLOT_START = re.compile(r"[\[{<%]|@@|__|[$#]\{|\((?=[A-Za-z])")
_SLOT = re.compile("|".join(f"(?:{p})" if not p.startswith("(?i)") else f"(?i:{p[4:]})" for p in SLOTS))
#: Source code quoted in a message: its braces are no slots.
_CODE = re.compile(r"\bf(\"[^\"\n]*\"|'[^'\n]*')")

# Words of the usual filler text.
LOREM = frozenset("lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum".split())
FILLED = "<filler>"
#: Four words of it in a row; they are one token of a message, as their order and number are chance.
_LOREM = re.compile(r"(?<!\w)(?:{0})(?:[,.]? (?:{0})(?!\w)){{3,}}".format("|".join(sorted(LOREM, key=lambda w: (-len(w), w)))), re.I)
# Filler sentences, in the languages of the crawl.
FILLER = (
    r"^(?:heading|sub-?heading|title|headline)$",
    r"\b(?:content|text|title|heading|headline|description|message text|message|name) goes here\b",
    r"\b(?:sample|dummy|placeholder|filler|example) (?:text|paragraph|content|copy)\b",
    r"\bplaceholder\b.*\breplace\b",
    r"\breplace (?:this|before launch|me)\b",
    r"^(?-i:TODO|TBD|FIXME|XXX)\b",
    r"\badd your own\b",
    r"\byour (?:content|text|policy|message) here\b",
    r"\bclick to edit\b",
    r"\bto be (?:filled in|completed|written|defined)\b",
    r"^(?:text )+text\b[ .]*$",
    r"_here\b",
    r"\b(?:beispieltext|platzhalter(?:text)?|mustertext|blindtext)\b",
    r"\btexte (?:de remplissage|d[’']exemple)\b",
    r"\btexto de (?:ejemplo|relleno)\b",
)
_FILLER = re.compile("|".join(FILLER), re.I)
#: One of these is in every text that a filler pattern fits.
FILLER_WORDS = ("heading", "title", "headline", " here", "_here", "text", "paragraph", "content", "copy", "placeholder", "replace", "todo", "tbd", "fixme", "xxx", "your own", "click to edit", "to be ", "platzhalter", "texte", "texto")

# Names of HTTP states as pages write them.
STATES = "bad request|unauthorized|forbidden|not found|method not allowed|not acceptable|request time-?out|gone|too many requests|unavailable for legal reasons|internal server error|not implemented|bad gateway|service unavailable|service temporarily unavailable|gateway time-?out|access denied"
# Sentences of error, challenge, parking and scripts-required pages; before each the words of which one is in every text it fits.
PAGES = (
    (tuple(STATES.replace("time-?out", "time").split("|")), rf"^(?:error |http status |http |status )?(?:\d{{3}}|<\*>)?[\s|:·–-]*(?:{STATES})[.!]?(?: \(?(?:\d{{3}}|<\*>)\)?)?$"),
    (("error", "status"), r"^(?:http )?(?:error|status) (?:code )?(?:\d{3}|<\*>)$"),
    (("found", "exist", "broken", "moved"), r"\b(?:page|document|file|link|url|resource)\b.{0,40}\b(?:not found|does not exist|no longer exists|could not be found|was not found|seems broken|is broken|has moved|never existed)\b"),
    (("find",), r"\bcan(?:['’]t|not) find (?:that|this|the) page\b"),
    (("page you",), r"\bpage you (?:are looking for|requested)\b"),
    (("nothing here",), r"^nothing here\b"),
    (("introuvable", "existe"), r"\bpage introuvable\b|\bn[’']existe (?:pas|plus)\b"),
    (("nicht gefunden", "existiert nicht"), r"\bseite (?:wurde )?nicht gefunden\b|\bdiese seite existiert nicht\b"),
    (("gina",), r"\bp[áa]gina\b.{0,40}\bno (?:existe|encontrada|se encontr)"),
    (("страниц",), r"страниц\w+ не (?:найден|существует)"),
    (("見つかりません",), r"ページは?見つかりません|見つかりませんでした"),
    (
        ("javascript", " js", "script"),
        r"\b(?:enable|turn on|activate|switch on) (?:javascript|js|scripts?)\b|\bjavascript is (?:disabled|required|off)\b|\brequires? (?:javascript|scripts)\b|\bscripts are required\b|\bblocks scripts\b|\bdoes not run scripts\b"
        r"|\bjavascript (?:aktivieren|einschalten)\b|\baktivieren sie javascript\b|\bactiver javascript\b|\bactive javascript\b|\bhabilite javascript\b|включите javascript|javascriptを有効",
    ),
    (
        ("moment", "one more", "checking", "human", "unusual", "security check", "press and", "solve"),
        r"^just a moment\b|\bone more step\b|\bchecking your browser\b|\b(?:verify|confirm)\b.{0,12}\b(?:you are|you're) (?:a )?human\b|\bunusual traffic\b|^security check\b|\bpress and hold\b|\bsolve the (?:puzzle|captcha)\b",
    ),
    (
        ("parked", "for sale", "offer", "construction", "suspended", "default", "it works", "index of", "be back", "maintenance", "hosting"),
        r"\bdomain\b.{0,60}\bis parked\b|\bmay be for sale\b|\bmake an offer\b|\bwebsite is under construction\b|\bsite is under construction\b|\baccount (?:has been )?suspended\b|\bdefault (?:web )?page\b|^it works!|^index of /|\bwe['’]ll be back soon\b|\bscheduled maintenance\b|\bhosting works\b",
    ),
    (
        ("blocked", "region", "unable", "upstream", "permission", "too many", "requested"),
        r"\brequest was blocked\b|\bnot available in your region\b|\bserver is temporarily unable\b|\bupstream server\b|\bdon['’]t have permission to (?:open|access)\b|\btoo many requests from your\b|\bthe requested (?:document|url|page)\b",
    ),
)
_PAGES = [(words, re.compile(p, re.I)) for words, p in PAGES]
_MARKUP = re.compile(r"<(?:!doctype|html|head|body|title|h[1-6]|p|div|span|noscript|center|table|pre)\b[^<>]*>", re.I)
# Marks of a crawler's own message.
OWN = (
    r"\bnet::[A-Z_]+",
    r"^[a-z]+(?:_[a-z]+)+(?:_\d+|_<\*>)?(?:$|[ :|])",
    r"^[A-Z]\w*(?:Error|Exception|Fault|Warning): ",
    r"^(?:navigation to|protocol error|unexpected failure in|page crashed|worker \S+|origin \S+ answered|ssl handshake|script evaluation|target page|browser|renderer|proxy|dns|socket|connection|timeout)\b",
)
_OWN = re.compile("|".join(OWN), re.I)

TEXT = "kind string, table_name string, row_id bigint, part int, tids array<int>, slot boolean, page_share double, template string, verdict string"


def masked(message: str) -> str:
    """A message with its variable parts masked."""
    if sum(w.strip(",.") in LOREM for w in message.lower().split()) >= 4:
        message = _LOREM.sub(FILLED, message)
    return _MASK.sub(WILD, message) if _VARIABLE.search(message) else message


#: A message of so many tokens, three fifths of them capitalised, and without a verdict of its own is a list of names: which ones makes
#: no template. Its verdict was taken before, so the number decides how many templates there are, not what is found.
NAMES = 12


def read_message(message: str) -> tuple[list[str], str]:
    """The tokens of a message, masked, and its verdict; names in a list of names are wildcards."""
    ts = masked(message).split()
    verdict = classify_template(" ".join(ts))
    if len(ts) >= NAMES and verdict == "other" and 5 * sum(t[:1].isupper() for t in ts) >= 3 * len(ts):
        ts = [WILD if t[:1].isupper() else t for t in ts]
    return ts, verdict


def tokens_of(message: str) -> list[str]:
    """The tokens of a message as they enter the tree."""
    return read_message(message)[0]


def _slot_in(text: str) -> bool:
    return any(_SLOT.match(text, m.start()) for m in _SLOT_START.finditer(text))


def has_slot(text: str) -> bool:
    """Whether a text has a template field that was never filled."""
    return _slot_in(text) and _slot_in(_CODE.sub(" ", text))


def classify_template(template: str) -> str:
    """What a template is: slot, filler, page (error, challenge, parking, scripts required), own or other."""
    low = template.lower()
    if has_slot(template.replace(WILD, " ").replace(FILLED, " ")):
        return "slot"
    if FILLED in template or (any(w in low for w in FILLER_WORDS) and _FILLER.search(template)):
        return "filler"
    ws = re.findall(r"[^\W\d_]+", low)
    if len(ws) >= 4 and sum(w in LOREM for w in ws) >= 0.75 * len(ws):
        return "filler"
    if _MARKUP.search(template):
        return "page"
    if _OWN.search(template):
        return "own"
    if any(any(w in low for w in words) and p.search(template) for words, p in _PAGES):
        return "page"
    return "other"


class PrefixTree:
    """Templates of messages in a tree of fixed depth.

    The path is the verdict, the number of tokens, the second and third token, and then the first one, which is often a name: from ``children``
    different first tokens on, further ones share a wildcard branch. In a leaf a message joins the most similar
    template if enough of its tokens agree: most of a short message's, three tenths of a long one's, of which the path has settled a part.
    """

    def __init__(self, children: int = 50, similar_short: float = 0.6, similar_long: float = 0.3, long: int = 8):
        self.children, self.similar_short, self.similar_long, self.long = children, similar_short, similar_long, long
        self.leaves: dict[tuple, list[int]] = {}
        self.fan: dict[tuple, set] = {}
        self.templates: list[list[str]] = []
        self.verdicts: list[str] = []

    def leaf(self, tokens: list[str], verdict: str = "other") -> tuple:
        """The path to a message's leaf."""
        inner = tuple(WILD if WILD in t or t[:1].isupper() else t for t in tokens[1:3])
        path, first = (verdict, len(tokens), *inner), tokens[0]
        seen = self.fan.setdefault(path, set())
        if first not in seen:
            if len(seen) >= self.children or WILD in first:
                first = WILD
            else:
                seen.add(first)
        return (*path, first)

    def add(self, tokens: list[str], verdict: str = "other") -> int:
        """The number of the template that takes the message; only messages of one verdict share a template."""
        group = self.leaves.setdefault(self.leaf(tokens, verdict), [])
        n = len(tokens)
        best, most = -1, n * (self.similar_long if n >= self.long else self.similar_short)
        for k in group:
            same = sum(map(str.__eq__, self.templates[k], tokens))
            if same >= most:
                best, most = k, same
                if same == n:
                    return k
        if best < 0:
            group.append(len(self.templates))
            self.templates.append(list(tokens))
            self.verdicts.append(verdict)
            return len(self.templates) - 1
        self.templates[best] = [a if a == b else WILD for a, b in zip(self.templates[best], tokens)]
        return best


_MENU_MARK = re.compile(r"[|·•/»>–—]")


def is_menu(message: str, tokens: list[str]) -> bool:
    """Whether a message is furniture rather than a sentence: without an end, and short, divided, or mostly capitalised."""
    if message.rstrip()[-1:] in (".", "!", "?", "。"):
        return False
    return len(tokens) <= 4 or _MENU_MARK.search(message) is not None or 5 * sum(t[:1].isupper() or t == WILD for t in tokens) >= 3 * len(tokens)


def _miner(whole: bool):
    """(table_name, row_id, text) -> TEXT: a row per text, then a row per template of this part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, part = PrefixTree(), TaskContext.get().partitionId()
        known: dict[str, tuple[int, int, int]] = {}  # template, words of a page's message, words of any message but a menu
        for b in batches:
            rows = []
            for name, i, t in zip(*(b.column(k).to_pylist() for k in range(3))):
                tids, page, content = set(), 0, 0
                for m in [t.replace("\n", " ")] if whole else _SENTENCE.split(t):
                    k = known.get(m)
                    if k is None:
                        tokens, verdict = read_message(m)
                        if not tokens:
                            continue
                        n = len(tokens)
                        k = tree.add(tokens, verdict), n if verdict == "page" else 0, 0 if verdict != "page" and is_menu(m, tokens) else n
                        if len(known) > 200_000:
                            known.clear()
                        known[m] = k
                    tids.add(k[0])
                    page += k[1]
                    content += k[2]
                rows.append(("text", name, i, part, sorted(tids), has_slot(t), page / max(1, content), None, None))
            if rows:
                yield _batch(rows)
        for s in range(0, len(tree.templates), 10_000):
            yield _batch([("template", None, k, part, None, None, None, " ".join(tree.templates[k]), tree.verdicts[k]) for k in range(s, min(s + 10_000, len(tree.templates)))])

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.bool_(), pa.float64(), pa.string(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[x.split(" ")[0] for x in TEXT.split(", ")])


def _merge(pdf: pd.DataFrame) -> pd.DataFrame:
    """Templates of all parts in some of the leaves, merged within their verdict."""
    tree = PrefixTree()
    to = [tree.add(t.split(" "), v) for t, v in zip(pdf["template"], pdf["verdict"])]
    return pd.DataFrame({"template": pdf["template"], "merged": [" ".join(tree.templates[k]) for k in to], "verdict": pdf["verdict"]})


#: Leaves are merged in so many groups; a leaf is never divided.
GROUPS = 256


def templates_of(texts: DataFrame, whole: bool) -> tuple[DataFrame, DataFrame]:
    """``texts`` (table_name, row_id, text) mined: ``rows`` with the template numbers of each text, and ``templates(part, tid, merged, verdict)``."""
    mined = cut(texts.mapInArrow(_miner(whole), TEXT), "templates")
    own = mined.where("kind = 'template'").select("part", F.col("row_id").cast("int").alias("tid"), "template", "verdict")
    key = F.pmod(F.xxhash64(F.size(F.split("template", " ")), F.when(F.split_part("template", F.lit(" "), F.lit(2)).rlike(r"^\p{Lu}|<\*>"), WILD).otherwise(F.split_part("template", F.lit(" "), F.lit(2)))), F.lit(GROUPS))
    merged = own.select("template", "verdict").distinct().select("template", "verdict", key.alias("leaves")).groupBy("leaves").applyInPandas(lambda pdf: _merge(pdf[["template", "verdict"]]), "template string, merged string, verdict string")
    return mined.where("kind = 'text'"), own.join(merged, ["template", "verdict"]).select("part", "tid", "merged", "verdict")


def _verdicts(rows: DataFrame, templates: DataFrame) -> DataFrame:
    """``table_name, row_id, page_share, slot, filler, page, own``: how many templates of each kind a text has.

    The templates with a verdict come as one row per part, so that a text finds them without being taken apart.
    """
    kinds = ("slot", "filler", "page", "own")
    marked = templates.where(F.col("verdict").isin(*kinds)).groupBy("part").agg(*[F.collect_set(F.when(F.col("verdict") == k, F.col("tid"))).alias(f"{k}_tids") for k in kinds])
    d = rows.join(marked, "part", "left")
    n = {k: F.coalesce(F.size(F.array_intersect("tids", f"{k}_tids")), F.lit(0)) for k in kinds}
    return d.select("table_name", "row_id", "page_share", (F.col("slot") | (n["slot"] > 0)).alias("slot"), *[n[k].alias(k) for k in kinds[1:]])


#: A text is an error page if such messages have at least this share of its words, menus left out; with less it is content that speaks of errors.
PAGE_SHARE = 1 / 8


def residue_pages(fetches: DataFrame) -> DataFrame:
    """``fetch_id, reason`` of fetches whose text has residue (slot, filler) or is an error page; null and empty texts are none."""
    t = fetches.select(F.lit("fetches").alias("table_name"), F.col("fetch_id").cast("bigint").alias("row_id"), "text").where("fetch_id is not null and text is not null and text <> ''")
    d = _verdicts(*templates_of(t, whole=False))
    reason = F.when(F.col("slot"), "slot").when(F.col("filler") > 0, "filler").when((F.col("page") > 0) & (F.col("page_share") >= PAGE_SHARE), "page")
    return d.select(F.col("row_id").alias("fetch_id"), reason.alias("reason")).where("reason is not null")


def residue_messages(results: DataFrame) -> DataFrame:
    """``result_id, reason`` of results whose error message is page text, filler or an unfilled template."""
    t = results.select(F.lit("results").alias("table_name"), F.col("result_id").cast("bigint").alias("row_id"), F.col("error_message").alias("text")).where("result_id is not null and text is not null and trim(text) <> ''")
    d = _verdicts(*templates_of(t, whole=True))
    reason = F.when(F.col("slot"), "slot").when(F.col("filler") > 0, "filler").when(F.col("page") > 0, "page")
    return d.select(F.col("row_id").alias("result_id"), reason.alias("reason")).where("reason is not null")


def p4_found(fetches: DataFrame, results: DataFrame) -> DataFrame:
    """table_name, row_id: the texts and error messages to exclude."""
    a = residue_pages(fetches).select(F.lit("fetches").alias("table_name"), F.col("fetch_id").alias("row_id"))
    b = residue_messages(results).select(F.lit("results").alias("table_name"), F.col("result_id").alias("row_id"))
    return a.unionByName(b).distinct()
