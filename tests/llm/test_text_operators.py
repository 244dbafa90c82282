"""Operators on single texts: token counts, packing, HTML extraction."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from keyloom.llm import html_extraction, packing, token_counts

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, n_bytes string"


def texts():
    r = random.Random(7)
    letters = "aab\n  \t'sé日 .　\x1c\x85\xa0Ab1!ll"
    fixed = [None, "", " ", "\n", "a" * 3000, "".join(r.choice("abcdefgh") for _ in range(5000)), "x  y", "x \n", "<|endoftext|>", "a <|endoftext|> b<|endoftext|>", "I'll we've", "same text", "same text"]
    return fixed + ["".join(r.choice(letters) for _ in range(r.randint(0, 80))) for _ in range(300)]


@pytest.fixture(scope="module")
def docs(spark):
    # an own column of a result's name, a null id and a repeated id
    rows = [(i, t, "own") for i, t in enumerate(texts())]
    return spark.createDataFrame([*rows, (None, "no id", None), (0, "id again", None)], SCHEMA)


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(VOCABULARY)


def test_token_counts(docs, tokenizer):
    for r in token_counts.token_counts(docs, VOCABULARY, limit=3).collect():
        t = r.text or ""
        n = len(tokenizer.encode(t, add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(t.encode()), n, n > 3)
    assert token_counts.token_counts(docs.limit(0), VOCABULARY).count() == 0


def test_packing_gives_back_all_ids(docs, tokenizer):
    rows = packing.pack(docs, VOCABULARY, window=64).collect()
    wanted = sorted((i if i is not None else -1, [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]) for i, t in [*enumerate(texts()), (None, "no id"), (0, "id again")])
    pieces = {}
    for doc, ids in wanted:
        for s in range(0, len(ids), 64):
            part = ids[s : s + 64]
            pieces.setdefault((doc, s, len(part), zlib.crc32(np.array(part, "<u4").tobytes()), len(ids)), []).append(1)
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows)
    assert got == sorted(k for k, n in pieces.items() for _ in n)
    filled = {}
    for r in rows:
        filled.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in filled.values():
        spans.sort()
        assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:])) and sum(n for _, n in spans) <= 64
    assert packing.pack(docs.limit(0), VOCABULARY).count() == 0


def test_packing_notices_other_ids():
    encoder = packing.Encoder(VOCABULARY)
    assert encoder.ids(["a b"]) == [np.array([64, 275], np.uint32).tobytes()]
    encoder.encode_single = lambda text: [1] * len(text.encode())
    with pytest.raises(ValueError):
        encoder.ids(["x y"])


def test_packing_takes_a_partition_together(spark):
    rows = spark.range(300_000).coalesce(1).selectExpr("id doc_id", "IF(id % 2 = 0, repeat(' word', 40), 'a b') text", "id sequence_id")
    packed = packing.pack(rows, VOCABULARY, window=64).toPandas()
    used = packed.groupby("sequence_id").length.sum()
    assert len(packed) == 300_000 and used.max() <= 64
    # 41 and 3 ids: seven short ones fit beside a long one, and the rest fill sequences of their own
    assert len(used) == 150_000 and (used == 62).sum() == 150_000 // 7


@pytest.mark.parametrize("seed", range(5))
def test_best_fit_decreasing(seed):
    r = random.Random(seed)
    lengths = np.array([r.randint(1, 100) for _ in range(r.randint(1, 300))])
    sequence, offset, made = packing.best_fit_decreasing(lengths, 100)
    room, at = [], {}
    for i in np.argsort(-lengths, kind="stable"):
        fits = [x for x in room if x >= lengths[i]]
        if fits:
            room[room.index(min(fits))] -= lengths[i]
        else:
            room.append(100 - lengths[i])
    assert made == len(room) == len(set(sequence)) and all((offset + lengths) <= 100)
    for i in range(len(lengths)):
        at.setdefault(sequence[i], set()).update(range(offset[i], offset[i] + lengths[i]))
    assert sum(map(len, at.values())) == lengths.sum()


ARTICLE = "<article><h1>A title</h1><p>First, some text.<p><b>Second &amp; more</b>\n  text. Third.<br>Fourth.</article>"
MAIN = "A title\nFirst, some text.\nSecond & more text. Third. Fourth."


@pytest.mark.parametrize(
    "page, text",
    [
        (None, ""), ("", ""), ("<p>a", "a"), ("plain text", "plain text"), ("<!-- open", ""), ("<script>a<b", ""), ("<style>p{}", ""), ("<a <b> c", "c"),
        (f"<html><head><title>No</title></head><body><nav><ul><li><a href=/x>x</a></ul></nav><header>h</header><div class=ad>Buy, now.</div>{ARTICLE}<aside>s</aside><div class='comments'><p>Nice, very nice.</p></div><form>f</form><footer>&copy; f</footer>", MAIN),
        (ARTICLE.replace("<article>", "<div id=content>").replace("</article>", "</div>") + "<footer>f</footer>", MAIN),
        ("<article><table><tr><td>a<td>b<tr><td>c</table><ul><li>one<li>two</ul></article>", "a\nb\nc\none\ntwo"),
        ("<article><p>a<script>var x='</p>';</script>b</p><!-- c --><p hidden>d</p><p>&#101;&notanentity;</p></article>", "a b\ne¬anentity;"),
    ],
)
def test_extraction(page, text):
    assert html_extraction.extract(page or "") == text


PARAGRAPHS = ["The first paragraph, which is long enough to count.", "A second one follows, with more to say about it.", "And the third one ends it, as it should."]
BODY = "<h1>On it</h1>" + "".join(f"<p>{x}</p>" for x in PARAGRAPHS)
WHOLE = "\n".join(["On it", *PARAGRAPHS])


@pytest.mark.parametrize("wrapper", ["div class='layout with-sidebar'", "div class='social-science'", "form", "div id=page-menu-open", "section class=main", "main", "div class='notice'", "header"])
def test_wrappers_keep_their_text(wrapper):
    page = f"<html><body><nav><a href=/>Home</a></nav><{wrapper}>{BODY}</{wrapper.split()[0]}><footer>c, 2020.</footer></body></html>"
    assert html_extraction.extract(page) == WHOLE


@pytest.mark.parametrize("noise", ["<div class=ad>Buy it, now, at once, and here.</div>", "<div class='ad-banner top'><p>Buy it, now.</p></div>", "<aside><h2>More</h2><p>A sidebar, with text.</p></aside>", "<form><p>Your name, please.</p><input><label>Name</label></form>", "<div id='cookie-notice'>We use cookies, as all do.</div>", "<section class=comments>" + "<p>I read it, and I say so at length, as I always do here.</p>" * 30 + "</section>", "<ol class='comment-list'>" + "<li>Nice, very nice, I say.</li>" * 9 + "</ol>", "<div class='related-posts'><ul><li><a href=/1>One, two</a><li><a href=/2>Three</a></ul></div>", "<ul><li><a href=/1>One</a><li><a href=/2>Two</a></ul>", "<div class=sidebar><p>A long text beside it, which says nothing, and says it twice.</p></div>"])
@pytest.mark.parametrize("inner", [BODY, f"<article>{BODY}</article>", f"<div id=content>{BODY}</div>", f"<main><div><h1>On it</h1></div><div>{BODY[14:]}</div></main>".replace("<div><h1>On it</h1></div>", "<h1>On it</h1>")])
def test_noise_beside_and_after(noise, inner):
    assert html_extraction.extract(f"<html><body><header><p>The site</p></header>{inner}{noise}<footer>c, 2020.</footer></body></html>") == WHOLE
    assert html_extraction.extract(f"<body>{noise}{inner}") == WHOLE


def test_short_articles_beside_long_adverts():
    page = "<body><div class=ad>Nicht aulich, für sch erüver enau sch der, und so fort.</div><article><h1>Of</h1><p>Of.</p></article><footer>A footer, longer than the article is, by far.</footer>"
    assert html_extraction.extract(page) == "Of\nOf."


def test_path_ratios_against_a_plain_computation():
    found, _ = html_extraction.blocks(f"<body><div>one, two.</div>{BODY}<ul><li><a>x</a><li><a>y</a></ul><div>three</div>")
    paths = list(dict.fromkeys(x.path for x in found))
    of = {p: [x.text for x in found if x.path == p] for p in paths}
    length = [sum(map(len, of[p])) / len(of[p]) for p in paths]
    marks = [(1 + sum(t.count(c) for t in of[p] for c in ".,;:!?")) / len(of[p]) for p in paths]

    def smooth(r):
        r = [x / max(r) for x in r]
        return [0.25 * r[max(0, i - 1)] + 0.5 * r[i] + 0.25 * r[min(len(r) - 1, i + 1)] for i in range(len(r))]

    most = max(sum(map(len, t)) for t in of.values())
    want = {p: a * b * sum(map(len, of[p])) / most for p, a, b in zip(paths, smooth(length), smooth(marks))}
    want["body/ul/li"] = 0
    got = html_extraction.path_ratios(found)
    assert got.keys() == want.keys() and all(abs(got[p] - want[p]) < 1e-12 for p in want)
    assert html_extraction.content_paths(got, 0.5) == {"body/p"}


def test_extraction_over_a_table(spark):
    rows = spark.createDataFrame([(1, "u", ARTICLE), (1, "u", ARTICLE), (None, None, None)], "page_id long, url string, html string").withColumn("text", F.lit("own"))
    assert [(r.text, r.n_chars) for r in html_extraction.main_text(rows).collect()] == [(MAIN, len(MAIN))] * 2 + [("", 0)]
    assert html_extraction.main_text(rows.limit(0)).count() == 0
    assert html_extraction.extract("<article>" + "<p>word, word.</p>" * 20000 + "</article>").count("\n") == 19999
