"""Main text of web pages by tag-path ratios.

A page is read into text blocks, each under the path of tags from the root down to it. For each
path of the page the text's length and its punctuation are summed over the path's blocks; both
ratios are smoothed over neighbouring paths, fused by their product, and paths above a threshold
set by the page's own spread are content. The content node is the deepest element that holds
nearly all text of content paths, widened to the article that it is part of; all its blocks stay,
short ones too, with the headings right before it. Of a page whose body is that node, what lies between
the first and the last block of content paths stays. Paths whose text is links only never are content.

Scripts, styles, markup, form controls and hidden elements are never text. Menus, headers, footers,
sidebars, notices, adverts, forms and reader comments are known by their elements and by words in
class, id and role, but a first run of the ratios decides whether to believe that: not of an element
that holds most of the content, unless its name is plain and there is an article beside it.

Null, empty and textless pages give an empty text; a page may have any length. Unclosed elements,
comments and tags end with the page; repeated rows each give their text. Columns text and n_chars
of the pages are replaced; any other name does no harm.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*|[^>]*)(?:>|\Z)|([^<]+|<)""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
#: Elements that begin and end a block.
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that another of the same kind, or of the kinds given, ends.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Elements that are never text.
NOISE = frozenset("audio button canvas head iframe input label map math noembed noframes noscript object script select style svg template textarea title video xmp".split())
#: Elements that hold what is not the article, as plain names.
ASIDE = frozenset("aside dialog footer menu nav".split())
#: Words in class, id or role that mark what is not the article.
MARKS = frozenset("ad ads advert adverts advertisement advertising alert banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies dialog discussion disqus footer form gdpr hidden login menu modal nav navbar navigation newsletter notice notices notification overlay pager pagination paywall popup promo promotion recommended related reply replies respond search share sharing sidebar signup skip social sponsor sponsored subscribe teaser toolbar tracking widget".split())
COMMENTS = frozenset("comment comments discussion disqus replies respond".split())
#: Words that make a name speak of what else is on the page.
WITH = frozenset("with has no without layout page is open closed".split())
HEADERS = frozenset(("header", "masthead"))
CONTENT = frozenset(("article", "main"))
#: Elements that hold a single block of text and cannot be the content node.
LEAF = HEADING | frozenset("p li dt dd td th tr caption figcaption legend summary option pre address".split())
SHARE = 0.9
HARD, PLAIN, COMPOUND = 3, 2, 1


def _doubt(tag: str, attributes: str, inside: bool) -> int:
    """How surely an element is not the article: HARD, by a PLAIN or a COMPOUND name, or 0. inside: within an article, whose own header is part of it."""
    if tag in NOISE:
        return HARD
    out = PLAIN if tag in ASIDE else COMPOUND if tag == "form" or tag == "header" and not inside else 0
    if not attributes.strip() or tag in ("body", "html"):
        return out
    for name, *values in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), "".join(values)
        if name == "hidden" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return HARD
        if name in ("class", "id", "role"):
            for token in re.sub(r"(?<=[a-z])(?=[A-Z])", "-", value).lower().split():
                words = set(re.findall(r"[a-z]+", token))
                if words & WITH:
                    continue
                if words & COMMENTS or len(words) == 1 and (words & MARKS or words & HEADERS and not inside):
                    out = max(out, PLAIN)
                elif words & MARKS or words & HEADERS and not inside:
                    out = max(out, COMPOUND)
    return out


class Block:
    """A block of text: its tag path, its elements from the root down (number, tag), those of them that are in doubt, its text and how much of it is links."""

    __slots__ = ("path", "chain", "doubts", "text", "links")

    def __init__(self, chain: list[tuple[int, str]], doubts: tuple[int, ...], text: str, links: int):
        self.path, self.chain, self.doubts, self.text, self.links = "/".join(t for _, t in chain), chain, doubts, text, links


def blocks(page: str) -> tuple[list[Block], dict[int, int]]:
    """Text blocks in page order, and how doubtful elements are, by number."""
    out: list[Block] = []
    doubts: dict[int, int] = {}
    stack: list[tuple[str, int, bool, int]] = []  # tag, number, whether it is never text, links around
    held: list[str] = []
    number = at = links = 0

    def flush() -> None:
        nonlocal links
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            held.clear()
            if text:
                chain = [(n, t) for t, n, _, _ in stack if t in BLOCK]
                out.append(Block(chain, tuple(n for n, _ in chain if n in doubts), text, links))
        links = 0

    def close(upto: int) -> None:
        if any(t in BLOCK for t, *_ in stack[upto:]):
            flush()
        del stack[upto:]

    while at < len(page):
        m = TOKEN.match(page, at)
        at = m.end()
        end, tag, attributes, text = m.groups()
        if text is not None:
            if not (stack and stack[-1][2]):
                held.append(text)
                if stack and stack[-1][3]:
                    links += len(text.strip())
            continue
        if tag is None:
            continue
        tag = tag.lower()
        if end:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    close(k)
                    break
            continue
        if tag == "br":
            held.append(" ")
            continue
        if tag in BLOCK:
            for k in range(len(stack) - 1, -1, -1):  # a block ends an open paragraph; items end their like
                t = stack[k][0]
                if t == "p" or t in ENDS.get(tag, ()):
                    close(k)
                    break
                if t in BLOCK and t not in ENDS.get(tag, ()) and t not in HEADING:
                    break
            flush()
        if tag in VOID:
            continue
        number += 1
        doubt = _doubt(tag, attributes, any(t in CONTENT for t, *_ in stack))
        noise = bool(stack and stack[-1][2]) or doubt == HARD or doubt == PLAIN and tag not in BLOCK
        if noise and tag not in BLOCK:
            held.append(" ")
        elif doubt and tag in BLOCK:
            doubts[number] = doubt
        if tag in RAW:
            found = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(page, at)
            at = found.start() if found else len(page)
        stack.append((tag, number, noise, int(tag == "a" or tag not in BLOCK and bool(stack and stack[-1][3]))))
    flush()
    return out, doubts


def _smooth(x: np.ndarray) -> np.ndarray:
    """Weighted mean with the neighbours on either side."""
    weights = np.array([0.25, 0.5, 0.25])
    return np.convolve(np.pad(x, 1, mode="edge"), weights, "valid") if len(x) > 2 else x


def path_ratios(found: list[Block]) -> dict[str, float]:
    """Of each tag path, its fused ratio: text and punctuation for each block, smoothed over paths in page order, times its share of the text."""
    paths: dict[str, list[float]] = {}
    for x in found:
        sums = paths.setdefault(x.path, [0, 0, 0, 0])
        sums[0] += len(x.text)
        sums[1] += len(re.findall(r"[.,;:!?。、！？]", x.text))
        sums[2] += 1
        sums[3] += x.links
    if not paths:
        return {}
    sums = np.array(list(paths.values()), float)
    ratios = (sums[:, 0] / sums[:, 2], (1 + sums[:, 1]) / sums[:, 2])
    fused = np.prod([_smooth(r / r.max()) for r in ratios], axis=0) * sums[:, 0] / sums[:, 0].max()
    links = (sums[:, 3] >= 0.9 * sums[:, 0]) & (sums[:, 1] < sums[:, 2])
    if not links.all():
        fused[links] = 0
    return dict(zip(paths, fused.tolist(), strict=True))


def content_paths(ratios: dict[str, float], spread: float) -> set[str]:
    values = np.array(list(ratios.values()))
    return {p for p, f in ratios.items() if 0 < f >= min(spread * values.std(), values.max())}


def believed(found: list[Block], doubts: dict[int, int], spread: float) -> set[int]:
    """The doubtful elements that are not the article."""
    content = content_paths(path_ratios(found), spread)
    whole = sum(len(x.text) for x in found if x.path in content)
    inside: dict[int, list[Block]] = {}
    for x in found:
        for element in x.doubts:
            inside.setdefault(element, []).append(x)
    in_content = lambda x: any(t in CONTENT for _, t in x.chain)
    in_paragraph = lambda x: bool(x.chain) and x.chain[-1][1] == "p"
    articles, paragraphs, gone = sum(map(in_content, found)), sum(map(in_paragraph, found)), set()
    out: set[int] = set()
    for element, doubt in doubts.items():  # from the outside in
        own = [x for x in inside.get(element, ()) if id(x) not in gone]
        if not own:
            continue
        above = [t for n, t in own[0].chain if n < element]
        own_articles, own_paragraphs = sum(map(in_content, own)), sum(map(in_paragraph, own))
        beside = not CONTENT.intersection(above) and articles > own_articles
        most = sum(len(x.text) for x in own if x.path in content) >= 0.5 * max(1, whole)
        if beside or not most or doubt == PLAIN and paragraphs > own_paragraphs:
            out.add(element)
            gone.update(map(id, own))
            articles, paragraphs = articles - own_articles, paragraphs - own_paragraphs
    return out


def extract(page: str, spread: float = 0.5) -> str:
    """The page's main text; spread: standard deviations above zero that make a path content."""
    found, doubts = blocks(page)
    if doubts:
        gone = believed(found, doubts, spread)
        found = [x for x in found if not gone.intersection(x.doubts)]
    ratios = path_ratios(found)
    content = content_paths(ratios, spread)
    found = [x for x in found if ratios[x.path] > 0]
    weight: dict[tuple[int, str], int] = {}
    for x in found:
        for element in x.chain if x.path in content else ():
            weight[element] = weight.get(element, 0) + len(x.text)
    whole = max(weight.values(), default=0)
    node = max((e for e, w in weight.items() if w >= SHARE * whole and e[1] not in LEAF), default=None)
    if node and node[1] not in ("html", "body"):
        chain = next(x.chain for x in found if node in x.chain)
        article = [e for e in chain[: chain.index(node) + 1] if e[1] == "article"]
        node = article[-1] if article else node
        kept = [i for i, x in enumerate(found) if node in x.chain]
    else:
        kept = [i for i, x in enumerate(found) if x.path in content]
        kept = [*range(kept[0], kept[-1] + 1)] if kept else []
    first = kept[0] if kept else 0
    while first and found[first - 1].chain and found[first - 1].chain[-1][1] in HEADING:
        first -= 1
    return "\n".join(found[i].text for i in [*range(first, kept[0] if kept else 0), *kept])


def main_text(pages: DataFrame, page: str = "html") -> DataFrame:
    """Adds text and n_chars to pages (a column text of theirs is replaced)."""

    @F.pandas_udf("string")
    def text(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for found in parts:
            yield found.map(extract)

    return pages.withColumn("text", text(common.text_of(page))).withColumn("n_chars", F.length("text").cast("long"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(common.table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")


QUERIES = {"op8_html_extraction": op8_html_extraction}
