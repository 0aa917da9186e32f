"""HTML extraction: blocks are classified by stop words, length and links, then by their neighbours.

Mark-up is read in one pass into blocks of text. Blocks inside menus, headers, footers, sidebars, forms,
adverts, notices or reader comments, known by tag, role, class or id, are boilerplate; within a declared article only by
whole names, since parts of names there belong to the article's own layout. The first
pass rules on each other block by itself: link density and stop-word density for blocks that are long
enough, undecided for the rest. A long block counts by its words, and by its characters in writing without spaces between words. On a page
none of whose long blocks reaches the stop-word density, in a language without a list here, length and link density decide alone.
Where a page declares its article, blocks outside it are boilerplate, and those in it that the first pass does not find good are
undecided, since low density by itself is no reason to cut an article.
The second pass gives an undecided block the label of its nearest decided neighbours on either side: what both say,
else what the nearer one says, and for a heading what the one below says.

Defined results: a null or empty page has an empty text, as has one without main text; unclosed tags
and comments end with the page; repeated rows are worked on each; an empty table gives an empty one.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Frequent words without content in English, German, French and Spanish.
STOP_WORDS = frozenset(
    "a about after all also an and any are as at be been but by can could did do for from had has have he her his how i if in "
    "into is it its just like me more my no not now of on one only or other our out over she so some than that the their them "
    "then there these they this to up us was we were what when which who will with would you your "
    "aber alle als am an auch auf aus bei bin bis da das dass dem den der des die doch du durch ein eine einem einen einer er "
    "es für hat ich ihr im in ist ja mit nach nicht noch nur oder sein sich sie sind so über um und uns von vor war was wenn "
    "wie wir wird zu zum zur "
    "au aux avec ce ces cette dans de des du elle en est et eux il ils je la le les leur lui ma mais me même mes mon ne nos "
    "nous on ou où par pas plus pour qu que qui sa se ses son sont sur ta te tu un une vos vous y "
    "al como con cual cuando de del desde donde el ella ellos en entre era es esa ese esta este fue ha hasta hay la las le lo "
    "los más me mi muy no nos o para pero por porque que se sin sobre son su sus también un una uno unos y ya".split()
)
_BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 "
    "h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
_CONTAINERS = frozenset("article aside body center details dialog div dl fieldset figure footer form header main menu nav ol section table ul".split())
_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
_SKIPPED = frozenset("button canvas datalist head iframe noframes noscript object script select style svg template textarea title".split())
_OUTER_TAGS = frozenset(("aside", "dialog", "footer", "form", "menu", "nav"))
_OUTER_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
_OUTER_NAMES = frozenset(
    "ad ads advert advertisement advertising adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus "
    "footer hidden legal login masthead menu modal nav navbar navigation newsletter notice notification pager pagination popup promo "
    "promotion recommended related replies reply respond share sharing sidebar signup skip social sponsor sponsored subscribe "
    "subscription toolbar widget".split()
)
_TAG = re.compile(
    r"""<!--.*?(?:--!?>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)""",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_WORD = re.compile(r"[^\W\d_]+")
_NAME = re.compile(r"[a-z0-9]+")
#: Chinese and Japanese characters, Thai, Lao, Khmer and Burmese letters: written without spaces between words.
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")
#: So many of them count as a word.
UNSPACED_PER_WORD = 2

#: A block is judged by itself from this many words on.
LONG_WORDS = 12
STOP_SHARE = 0.2
LINK_SHARE = 0.4
GOOD, BAD, OPEN = "good", "bad", "open"


@dataclass
class Block:
    text: str
    tag: str
    outer: bool
    article: bool
    linked: float


def _attributes(source: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, *values in _ATTRIBUTE.findall(source):
        found.setdefault(name.lower(), next((v for v in values if v), ""))
    return found


def _is_outer(tag: str, attributes: dict[str, str], declared: bool, in_article: bool) -> bool:
    # An article within an article is a reader's comment; a header within one has its title.
    if tag in _OUTER_TAGS or (tag == "header" and not declared) or (tag == "article" and in_article):
        return True
    if "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or attributes.get("role", "").lower() in _OUTER_ROLES:
        return True
    if re.search(r"display\s*:\s*none", attributes.get("style", "")):
        return True
    names = f"{attributes.get('class', '')} {attributes.get('id', '')}".lower()
    if declared:
        # All parts of a name, as in social-share, or the whole of it.
        return any(_OUTER_NAMES.issuperset(_NAME.findall(name)) for name in names.split() if _NAME.search(name))
    names = _NAME.findall(names)
    return tag != "body" and not _OUTER_NAMES.isdisjoint(names)


def blocks(source: str) -> list[Block]:
    """Blocks of text in page order, with white space made single and character references decoded."""
    found: list[Block] = []
    pieces: list[str] = []
    linked = 0
    # Open containers: tag, whether the text in it is boilerplate, declared as main text, in an article tag.
    stack: list[tuple[str, bool, bool, bool]] = [("", False, False, False)]
    tag_of_block, in_link, at = "", False, 0
    # Tags without an end tag in the rest of the page, which is searched for each only once.
    unclosed: set[str] = set()

    def end_block() -> None:
        nonlocal linked, in_link
        if pieces:
            text = " ".join(html.unescape("".join(pieces)).split())
            if text:
                found.append(Block(text, tag_of_block, stack[-1][1], stack[-1][2], linked / len(text)))
        pieces.clear()
        linked, in_link = 0, False

    def add(text: str) -> None:
        nonlocal linked
        if text:
            pieces.append(text)
            if in_link:
                linked += len(" ".join(html.unescape(text).split()))

    while match := _TAG.search(source, at):
        add(source[at : match.start()])
        at = match.end()
        closing, name, rest = (match[1], match[2], match[3]) if match[2] else (match[4], match[5], match[6])
        if name is None:
            continue
        tag = name.lower()
        if tag in _SKIPPED:
            if not closing and not rest.rstrip().endswith("/"):
                end = None if tag in unclosed else re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(source, at)
                if end is None:
                    unclosed.add(tag)
                at = end.end() if end else len(source) if tag in ("script", "style", "textarea", "title") else at
        elif tag == "a":
            in_link = not closing
        elif tag == "br":
            pieces.append(" ")
        elif tag in _BLOCK_TAGS:
            end_block()
            tag_of_block = "" if closing else tag
            if tag in _CONTAINERS and tag != "body":
                if closing:
                    for i in range(len(stack) - 1, 0, -1):
                        if stack[i][0] == tag:
                            del stack[i:]
                            break
                else:
                    attributes = _attributes(rest) if rest else {}
                    declared = tag in ("article", "main") or attributes.get("role", "").lower() == "main" or attributes.get("itemprop") == "articleBody"
                    if declared and not stack[-1][2] and not _is_outer(tag, attributes, False, False):
                        # An article doesn't begin inside a menu or an advert: that one was never closed.
                        while stack[-1][1]:
                            stack.pop()
                    _, outer, inside, in_article = stack[-1]
                    outer = outer or _is_outer(tag, attributes, inside, in_article)
                    stack.append((tag, outer, inside or declared, in_article or tag == "article"))
    add(source[at:])
    end_block()
    return found


def _size(block: Block, words: list[str]) -> int:
    """Words of a block; characters of writing without spaces count by number."""
    unspaced = len(_UNSPACED.findall(block.text))
    return len(words) if not unspaced else sum(not _UNSPACED.search(w) for w in words) + unspaced // UNSPACED_PER_WORD


def _dense(words: list[str]) -> bool:
    """Whether stop words are as frequent as they are in running text."""
    return sum(w in STOP_WORDS for w in words) >= STOP_SHARE * len(words)


def _alone(block: Block, words: list[str], size: int, declared: bool, listed: bool) -> str:
    """First pass: the label that a block gets by itself; ``listed`` is whether the page's stop words are known."""
    if block.outer or (declared and not block.article):
        return BAD
    if block.linked > LINK_SHARE:
        return OPEN if declared and size >= LONG_WORDS else BAD
    if size < LONG_WORDS or block.tag in _HEADINGS:
        return OPEN
    if block.text.startswith("©") and not declared:
        return BAD
    if not listed or _dense(words):
        return GOOD
    return OPEN if declared or block.linked == 0 else BAD


def labels(found: list[Block]) -> list[str]:
    """GOOD or BAD for each block."""
    declared = any(b.article and not b.outer for b in found)
    words = [[w.lower() for w in _WORD.findall(b.text)] for b in found]
    sizes = [_size(b, w) for b, w in zip(found, words, strict=True)]
    listed = any(
        _dense(w) for b, w, n in zip(found, words, sizes, strict=True) if n >= LONG_WORDS and not b.outer and b.linked <= LINK_SHARE and (b.article or not declared)
    )
    alone = [_alone(b, w, n, declared, listed) for b, w, n in zip(found, words, sizes, strict=True)]
    # In a declared article only its own blocks are neighbours.
    decided = [label != OPEN and not (declared and (b.outer or not b.article)) for b, label in zip(found, alone, strict=True)]
    before, after = [-1] * len(found), [-1] * len(found)
    for i in range(1, len(found)):
        before[i] = i - 1 if decided[i - 1] else before[i - 1]
    for i in range(len(found) - 2, -1, -1):
        after[i] = i + 1 if decided[i + 1] else after[i + 1]

    def inherited(i: int) -> str:
        one, two = before[i], after[i]
        if one < 0 and two < 0:
            return GOOD if declared else BAD
        if one < 0 or two < 0:
            return alone[max(one, two)]
        if alone[one] == alone[two]:
            return alone[one]
        return alone[two] if found[i].tag in _HEADINGS or two - i < i - one else alone[one]

    return [inherited(i) if label == OPEN else label for i, label in enumerate(alone)]


def main_text(source: str | None) -> str:
    found = blocks(source or "")
    return "\n\n".join(b.text for b, label in zip(found, labels(found), strict=True) if label == GOOD)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row of ``pages`` (page_id, url, html; others ignored)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column("html")]
            yield pa.record_batch(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    given = pages.select("page_id", "url", F.col("html").cast("string"))
    kinds = dict(given.dtypes)
    return given.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
