"""Cases that the corpus operators once left out."""

import hashlib
import random

import corpus_pipeline
import pytest

from thicket.llm.html_extraction import best_region, main_text

FIRST, SECOND = "<p>Some text to be read by people.</p>", "<p>And some more of that text.</p>"
TEXT = "Some text to be read by people. And some more of that text."

#: What hides nothing behind it.
BOXES = [
    '<svg class="icon"/>',
    "<math/>",
    '<object data="x"/>',
    '<svg class="icon"/><svg><text>No</text></svg>',
    "<noscript>",
    '<div><noscript><img src="x"></div>',
    "<select><option>No<option>No",
    "<div><select><option>No</div>",
    "<select><option>No<div><select><option>No</select></div>",
    "<svg><path d='x'/><title/><g>",
    "<math>",
    "<object>",
    "<template>",
    "<svg><title/><style/><text>No</text></svg>",
    "<svg><foreignObject><p>No no.</p></foreignObject></svg>",
    "<template><div><p>No no.</p></div></template>",
    "<noscript><div>No no, turn it on</noscript>",
    "<object><p>No no.</p><object><p>No.</p></object></object>",
    "<svg><svg><text>No</text></svg><text>No</text></svg>",
    "<select><option>No</option><optgroup label='x'><option>No</optgroup></select>",
    "<svg>" + "<path d='x'/>" * 300 + "<text>No</text></svg>",
    '<script>"<svg>"</script><!-- <svg> --><style>p{}</style>',
]


STORY = "<p>This is a paragraph of a story that goes on for some words and then it ends here.</p><p>Another one, shorter.</p>"
STORY_TEXT = "This is a paragraph of a story that goes on for some words and then it ends here. Another one, shorter."


def test_pages_without_telling_names():
    menu, end = '<div class="q1"><a href="/">Home</a></div><div class="q1"><a href="/n">News</a></div>', '<div class="f00"><a href="/t">Terms</a> <a href="/p">Privacy</a></div>'
    assert main_text(f'<html><body><div class="x9f3">{menu}</div><div class="zz8"><div class="k2"><h1>The thing</h1>{STORY}</div></div>{end}') == f"The thing {STORY_TEXT}"
    assert main_text(f"<html><body><div>{menu}</div><div><h1>The thing</h1>{STORY}</div>{end}") == f"The thing {STORY_TEXT}"


def test_wrappers_and_headers():
    page = '<html><body><nav><a href="/">Home</a></nav>{}<footer>The end of it</footer></body></html>'
    assert main_text(page.format(f'<div class="page-header-wrap notice-board"><article><h1>A title</h1>{STORY}</article></div>')) == f"A title {STORY_TEXT}"
    assert main_text(page.format(f"<article><header><h1>A title</h1></header>{STORY}</article>")) == f"A title {STORY_TEXT}"
    assert main_text(page.format("<article><h1>A title</h1><p>Take <math><mi>x</mi><mo>+</mo><mn>1</mn></math> of them, and then go on as before.</p></article>")) == "A title Take x+1 of them, and then go on as before."
    assert main_text(page.format(f'<article>{STORY}<div class="ad">Buy one now.</div>{STORY}<p>All rights reserved.</p></article>')) == f"{STORY_TEXT} {STORY_TEXT} All rights reserved."


def test_deep_and_broken_pages():
    for opening in ("<div>", "<span>", "<b>", "<ul><li>", "<x-y class='a b'>"):
        assert main_text(opening * 50_000 + STORY) == STORY_TEXT
    assert main_text("<div>" * 20_000 + STORY + "</span>" * 20_000) == STORY_TEXT
    assert main_text("<p>" * 20_000 + STORY) == STORY_TEXT
    assert main_text("") == main_text("<div><p></p>") == main_text("<script>x") == ""
    equal = f"<article>{STORY}</article>" + '<div class="ad">No no no, and no more of it.</div>' * 30
    assert main_text(equal * 2).startswith(STORY_TEXT)


@pytest.mark.parametrize("box", BOXES)
def test_hidden_elements(box):
    assert main_text(f"<main>{FIRST}{box}{SECOND}</main>") == TEXT
    assert main_text(f"<html><body>{box}<article>{FIRST}{SECOND}</article></body></html>") == TEXT
    assert main_text(f"<article>{FIRST}{box}{SECOND}</article><footer>The end <svg><text>No</text></svg></footer>") == TEXT


def test_near_copies_by_row(spark):
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    near_a, near_b = a.replace("a30 ", ""), b.replace("b30 ", "")
    rows = [
        *[(1, a, "s")] * 5,  # one row many times
        (1, b, "s"),  # a text of its own with the same doc_id
        (2, near_a, "s"),
        (2, "short text of five words or more", "s"),  # its own component: must not keep near_a
        (3, near_b, "s"),
        (4, "one two", "t"),
        (4, "one two", "s"),  # the same text, other columns
        (5, "x y z", "s"),
        (5, "X y  z", "s"),  # an equal set of another text
        *[(6, "", "s"), (6, None, "s"), (None, a, "s"), (None, a, "s")],
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, text_hash string").repartition(3)
    got = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert got.columns == docs.columns
    five = min(("x y z", "X y  z"), key=lambda t: hashlib.sha256(t.encode()).hexdigest())
    want = [(1, a, "s"), (1, b, "s"), (2, rows[7][1], "s"), (4, "one two", "s"), (5, five, "s"), (6, "", "s"), (6, None, "s"), (None, a, "s"), (None, a, "s")]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_best_region_is_the_best():
    rng = random.Random(8)
    for _ in range(300):
        score = [rng.choice([-3, -2, -1, -0.5, 0, 0.5, 1, 2, 4]) for _ in range(rng.randint(0, 30))]
        sums = {(i, j): sum(score[i:j]) for i in range(len(score)) for j in range(i + 1, len(score) + 1)}
        first, last = best_region(score)
        assert sum(score[first:last]) == max([0, *sums.values()])
    assert best_region([-1, 2, -2, 2]) == (1, 2) and best_region([]) == (0, 0)


def test_blocks_of_an_article_stay():
    """Short blocks of links inside of the region are the article's; boxes that lose as a whole, and elements named so, aren't."""
    long = "This is a long paragraph of the article with enough words to be read as one, and it ends as sentences do. " * 3
    inner = '<p><a href="x">Read the full report here</a></p>', '<ul><li><a href="r">Roads</a></li><li>Rails</li></ul>', "<p>Yes</p>"
    for kind in ("article", "main", 'div class="content"'):
        body = "".join(f"<p>{long}</p>{x}" for x in inner) + f"<p>{long}</p>"
        page = f'<html><body><nav><a href="1">Home</a> <a href="2">News</a></nav><{kind}><h1>Title of it</h1>{body}<div class="ad">Buy two shoes now</div><p class="advert">Cheap hats here</p><p>{long}</p></{kind.split()[0]}><footer><p>Copyright</p></footer></body></html>'
        parts = [long, "Read the full report here", long, "Roads Rails", long, "Yes", long, long]
        assert main_text(page) == " ".join(["Title of it", *(" ".join(p.split()) for p in parts)]), kind
