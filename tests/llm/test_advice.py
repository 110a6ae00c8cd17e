"""Whole jobs: what a review of the operators found cut short."""

import hashlib
import zlib

import numpy as np
import pyarrow as pa

from cairn.llm import htmltext, kneser_ney, pieces, secrets
from cairn.llm.common import flat, mix


def test_language_model_sees_two_words_back(spark):
    ids = {h: [i for i in range(200) if (zlib.crc32(str(i).encode()) % 7 == 2) == h] for h in (False, True)}
    rows = [(i, "a b c" if k % 2 else "x b d") for k, i in enumerate(ids[False][:80])]
    likely, unlikely = ids[True][:2]
    rows += [(likely, "a b c"), (unlikely, "a b d")]
    got = {r.doc_id: r for r in kneser_ney.perplexity(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[likely].held_out and got[unlikely].held_out
    assert got[likely].score > got[unlikely].score + 0.5


def test_dropout_varies_by_occurrence_and_document(spark):
    word = " internationalization"
    docs = spark.createDataFrame([(i, word * 50) for i in range(40)] + [(3, word * 50), (None, word), (None, word + word)], "doc_id long, text string")
    rows = pieces.encode(docs, "doc_id").collect()
    assert all(r.lossless for r in rows)
    assert len({tuple(r.ids) for r in rows if r.doc_id is not None}) == 40
    assert len({tuple(r.ids) for r in rows if r.doc_id == 3}) == 1
    table = pieces.Pieces()
    plain = table.encode(word[1:])
    cuts, now = set(), []
    for i in rows[0].ids:
        if table.raw[i].startswith(b" ") and now:
            cuts.add(tuple(now))
            now = []
        now.append(i)
    assert len(cuts) > 5 and tuple(plain) in cuts


def test_dropout_equals_the_agenda_of_each_occurrence():
    table, threshold = pieces.Pieces(), pieces.threshold_of(0.1)
    texts = ["the rain in Spain  falls\nmainly é on the 😀 plain", "", "a" * 60 + " the the the rain"]
    keys = np.array([5, 6, 7], np.uint64)
    b, o = flat(pa.array(texts))
    ids, bounds = table.encode_all(b, o, keys, threshold)
    for k, words in enumerate((["▁the", "▁rain", "▁in", "▁Spain", "▁▁falls", "\n", "mainly", "▁é", "▁on", "▁the", "▁😀", "▁plain"], [], ["▁" + "a" * 60, "▁the", "▁the", "▁the", "▁rain"])):
        want = []
        # a line end is a word, and so is what follows it
        for n, w in enumerate(words):
            h = mix(mix(keys[k : k + 1]) + np.array([n], np.uint64) * np.uint64(pieces._A))
            want += table.segment(w, threshold, int(h[0]))
        assert ids[bounds[k] : bounds[k + 1]].tolist() == want


SET = {
    'password = "%s"': "Summer2024xy",
    '{"password": "%s"}': "Summer2024xy",
    "db_password = %s": "hunter2Hunter",
    "secret_key=%s": "abcDEF123456",
    'auth_token = "%s"': "correcthorsebatterystaple",
    'AWS_SECRET = "%s"': "QwErTyUiOpAsDfGhJkLzXcVbNmQwErTyUiOpAsDf",
    "'api-key' => '%s'": "k8Jq2LmPz9Xv",
    "password := `%s`": "k8Jq2LmPz9Xv"[:8],
    "token=%s": "abcDEF123456",
    "x %s": "a" * 80 + "1" + "b" * 9,
}


def test_secrets_set_to_names_are_candidates(spark):
    forest = secrets.default_forest(spark)
    docs = spark.createDataFrame([(i, "see " + k % v + " end") for i, (k, v) in enumerate(SET.items())], "doc_id long, text string")
    found = {}
    for r in secrets.scan(docs, forest).collect():
        found.setdefault(r.doc_id, set()).add((r.sha256, r.is_secret))
    for i, (k, v) in enumerate(SET.items()):
        value = f"`{v}`" if "`" in k else v
        assert hashlib.sha256(value.encode()).hexdigest() in {x for x, _ in found.get(i, ())}, k
    clean = {r.doc_id: r.text for r in secrets.redact(docs, forest).collect()}
    for i, v in enumerate(SET.values()):
        assert (v in clean[i]) != any(s for _, s in found[i])
    assert sum("[SECRET]" in t for t in clean.values()) >= 6, clean
    plain = spark.createDataFrame([(1, "the token was lost; a password is asked for, see the author: Somebody Else. if token == null")], "doc_id long, text string")
    assert secrets.scan(plain, forest).where("is_secret").count() == 0


STORY = "<h1>A title</h1>" + "".join(f"<p>Paragraph {i} of the story says a good deal about its matter, and then some more.</p>" for i in range(6))


def test_html_keeps_the_article_in_hinted_wrappers():
    side = '<div class="sidebar"><ul><li><a href="/a">One link</a></li><li><a href="/b">Other link</a></li></ul></div>'
    want = htmltext.main_text(f"<body><article>{STORY}</article>{side}</body>")
    assert want.count("Paragraph") == 6 and "link" not in want
    for page in (
        f'<div class="layout has-sidebar"><article>{STORY}</article>{side}</div>',
        f'<article class="post has-comments">{STORY}</article>{side}',
        f'<div id="content-no-sidebar">{STORY}</div>{side}',
        f'<section class="related-work">{STORY}</section>{side}',
        f'<div class="sidebar layout"><main>{STORY}</main></div>',
        f'<div class="widget"><article>{STORY}</article></div>{side}',
        f'<div class="comment">{STORY}</div>',
    ):
        assert htmltext.main_text(f"<body>{page}</body>") == want, page
    part = f'<article>{STORY}<section class="related-work"><p>Others wrote of it before, at some length.</p></section></article>'
    assert htmltext.main_text(part).endswith("Others wrote of it before, at some length.")


def test_html_still_cuts_what_is_not_the_article():
    talk = "".join(f"<p>Reader {i} says a few words here, on and on.</p>" for i in range(4))
    links = "".join(f'<li><a href="/{i}">Some other story {i}</a></li>' for i in range(5))
    for beside in (f'<div class="comments">{talk}</div>', f'<div id="comment-list">{talk}</div>', f'<div class="related-posts"><ul>{links}</ul></div>', f'<div class="page-sidebar"><ul>{links}</ul></div>', '<div class="ad">Buy now</div>'):
        got = htmltext.main_text(f"<body><article>{STORY}{beside}</article></body>")
        assert got.count("Paragraph") == 6 and not any(x in got for x in ("Reader", "other story", "Buy")), beside


def test_html_keeps_the_articles_own_parts():
    page = "<body><header><h1>Site</h1><p>Slogan of the site</p></header><article><header><div><h1>Title</h1></div><p>Standfirst</p></header><p>Body</p></article></body>"
    assert htmltext.main_text(page) == "Title\n\nStandfirst\n\nBody"
    inner = '<p>So <math><mi>x</mi><mo>=</mo><mn>1</mn></math> <span aria-hidden="true">holds</span> <span hidden>true</span> <span style="display:none">here</span></p>'
    inner += '<label>A label</label><object data="x"><p>Instead of it</p></object><div class="search-engine history"><p>How search engines came to be</p></div>'
    got = htmltext.main_text(f"<body><article>{STORY}{inner}</article></body>")
    for part in ("So x=1 holds true here", "A label", "Instead of it", "How search engines came to be"):
        assert part in got, part


def test_html_null_rows_and_repeated_siblings(spark):
    import time

    df = spark.createDataFrame([(1, "u", None), (None, None, ""), (2, "v", f"<body>{STORY}</body>"), (2, "v", f"<body>{STORY}</body>")], "page_id long, url string, html string")
    got = sorted((r.page_id or 0, r.text, r.n_chars) for r in htmltext.extract(df).collect())
    assert got[:2] == [(0, "", 0), (1, "", 0)] and got[2] == got[3] and got[2][1].count("Paragraph") == 6
    wide = "<body><div>" + "<p>Some words of a long page that goes on.</p>" * 20_000 + "</div></body>"
    began = time.time()
    assert htmltext.main_text(wide).count("Some words") == 20_000
    htmltext.main_text("<body>" + "<svg>" * 20_000 + "text</body>")
    assert time.time() - began < 20


def test_html_density_by_hand():
    """Sum of densities, chosen node and threshold on a page small enough to reckon."""
    root = htmltext.parse('<body><div id="a"><a href="/">one two</a></div><div id="b"><p>aaaa aaaa</p><p>bbbb</p></div></body>')
    htmltext.measure(root)
    a, b = root.kids[0].kids
    assert (a.chars, a.links, a.tags, a.density) == (7, 7, 1, 0.0) and (b.chars, b.links, b.tags) == (13, 0, 2)
    assert b.sum == sum(p.density for p in b.kids) > 0 and htmltext._densest(root) is b
