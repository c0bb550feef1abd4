"""Labelled pages for ``html_extraction``: ``data-main`` marks what is main text (1) and what inside it is not (0)."""

_FILL = "some words that make a paragraph long enough to look like one that people read from its start to its end without a stop"

_BOILER = {
    "nav": '<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li><li><a href="/c">About us</a></li></ul></nav>',
    "header": '<header><a class="logo" href="/">The Paper</a><form action="/s"><input name="q"><button>Search</button></form></header>',
    "menu": '<div class="menu" id="topmenu"><ul><li><a href="/1">One</a></li><li><a href="/2">Two</a></li></ul></div>',
    "ad": '<div class="ad">Buy two pairs of shoes and get the third one for free until the end of this week.</div>',
    "banner": '<div class="banner advert ads sponsor promo">Everything must go in our large summer sale, be quick.</div>',
    "sidebar": '<aside class="sidebar"><h3>Most read</h3><ul><li><a href="/x">A cat on a roof</a></li><li><a href="/y">Rain at last</a></li></ul></aside>',
    "side": '<div id="sidebar" class="side widget related">Related stories you may like, picked for you by our editors today.</div>',
    "notice": '<div class="cookie notice consent">We use cookies. By going on you agree to that and to our terms of use.</div>',
    "warning": '<div class="alert notice subscribe newsletter">Sign up for our letter and never miss a story again.</div>',
    "comments": '<section class="comments" id="comments"><h2>Comments</h2><div class="comment"><p>I do not agree with a word of this text, my friend.</p></div><div class="comment reply"><p>Nor do I, but thank you for it anyway.</p></div></section>',
    "form": '<form class="contact"><label>Name</label><input><label>Your mail address</label><textarea>Tell us what you think of this</textarea><select><option>Yes</option></select><button>Send</button></form>',
    "share": '<div class="share social breadcrumb toolbar">Share on this site or that one</div>',
    "footer": '<footer><p>&copy; 2020 The Paper. All rights reserved. Terms of use and privacy.</p></footer>',
    "foot": '<div id="footer" class="footer copyright">Copyright by the makers of this page and their many friends.</div>',
}


_SHORT = "A few words that nobody came for, in a box of their own"
for _kind in ("aside", "footer", "nav", "header", "form"):
    _BOILER[f"{_kind}_p"] = f"<{_kind}><div><p>{_SHORT}.</p><p>{_SHORT}, again.</p><ul><li>{_SHORT}</li></ul></div></{_kind}>"
for _kind in ("sidebar", "notice", "advert", "ad", "comments", "menu", "footer", "cookie", "banner", "related", "promo", "share", "header", "nav", "newsletter", "widget"):
    _BOILER[f".{_kind}_p"] = f'<div class="{_kind}"><section><p>{_SHORT}.</p><div><span>{_SHORT}, again.</span></div></section></div>'


def _not_main(key: str) -> str:
    """A box inside main text, which is no part of it."""
    name, _, rest = _BOILER[key][1:].partition(" ") if " " in _BOILER[key].partition(">")[0] else _BOILER[key][1:].partition(">")
    return f'<{name} data-main="0"' + (f" {rest}" if " " in _BOILER[key].partition(">")[0] else f">{rest}")


def _page(before: list[str], main: str, after: list[str], title: str = "A title") -> str:
    head = f"<html><head><title>{title}</title><style>p{{margin:0}}</style><script>var x='</p>';</script></head><body>"
    return head + "".join(_BOILER[b] for b in before) + main + "".join(_BOILER[a] for a in after) + "</body></html>"


def _paragraphs(n: int, tag: str = "p") -> str:
    """Paragraphs of many lengths, the first one long."""
    words = _FILL.split()
    lengths = (len(words), 7, 3, 9, 2, 11, 5, 8, 4, 10)
    return "".join(f"<{tag}>{' '.join(words[: lengths[k % len(lengths)]])}{'.' * (k % 4 < 3)}</{tag}>" for k in range(3 * n))


LABELLED = [
    _page(["nav", "ad"], f'<article data-main="1"><h1>A title</h1>{_paragraphs(3)}</article>', ["footer"]),
    _page(["nav", "ad"], f'<article data-main="1"><h1>A title</h1><p><b>{_FILL}<br><p>{_FILL}</article>', ["footer"]),
    _page(["nav", "ad"], '<article data-main="1"><h1>A title</h1><p>Few words.</p></article>', ["footer"]),
    _page(["header", "nav", "notice"], f'<main><article data-main="1"><h1>A title</h1>{_paragraphs(4)}<blockquote>{_FILL}</blockquote></article></main>', ["comments", "sidebar", "footer"]),
    _page(["menu", "banner"], f'<div id="content" class="content" data-main="1"><h2>A title</h2>{_paragraphs(2)}<ul><li>{_FILL}</li><li>{_FILL}</li></ul></div>', ["side", "foot"]),
    _page(["nav", "share"], f'<div class="post entry" data-main="1"><h1>A title</h1><p>{_FILL}</p><div class="ad" data-main="0">Only today: a new phone at half the price for you.</div>{_paragraphs(2)}</div>', ["form", "comments", "footer"]),
    _page(["notice", "header"], f'<main data-main="1"><section><h1>A title</h1>{_paragraphs(2)}<table><tr><td>{_FILL}</td><td>12</td></tr></table><pre>{_FILL}</pre></section></main>', ["warning", "comments", "foot"]),
    _page(["nav"], f'<article class="story body text main" data-main="1"><header><h1>A title</h1></header>{_paragraphs(2)}<figure><figcaption>{_FILL}</figcaption></figure><p>See <a href="/z">this link</a> and <i>that</i>: {_FILL}</p></article>', ["sidebar", "form", "footer"]),
    _page([], f'<div data-main="1">{_paragraphs(3)}</div>', []),
    f'<html><body data-main="1">{_FILL} {_FILL}</body></html>',
    f'<html><body data-main="1"><div>{_FILL} {_FILL}<br>{_FILL}</div><section>{_FILL}</section></body></html>',
    f'<div data-main="1">{_FILL}<ul><li>{_FILL}</li></ul></div>',
    _page([k for k in _BOILER if k.endswith("_p")], f'<article data-main="1"><h1>A title</h1>{_paragraphs(6)}</article>', []),
    _page([], f'<article data-main="1"><h1>A title</h1><div>{_paragraphs(4)}</div></article>', [k for k in _BOILER if k.endswith("_p")]),
    _page([], f'<main data-main="1"><section>{_paragraphs(4)}</section></main>', [k for k in _BOILER if k.endswith("_p")]),
    *(_page([], f'<{kind} data-main="1"><h1>A title</h1>{_paragraphs(2)}{"".join(_not_main(k) for k in _BOILER if not k.startswith("header"))}{_paragraphs(2)}</{kind.split()[0]}>', []) for kind in ("article", "main", 'div class="content"', 'div class="post entry"')),
    _page(["banner", "warning"], f'<td data-main="1"><span>{_FILL}</span><div>{_FILL}</div></td>', ["share", "side"]),
]


def _nameless(page: str) -> str:
    """The same page with elements and classes that tell nothing."""
    import re

    page = re.sub(r' (class|id)="([^"]*)"', lambda m: f' {m[1]}="_{sum(map(ord, m[2]))}"', page)
    return re.sub(r"<(/?)(nav|header|footer|aside|article|main|section|form)\b", r"<\1div", page)


_MENUS = ["nav", "header", "menu", "sidebar", "form", "share", "footer", "foot"]
LABELLED += [
    _nameless(_page(["nav", "header"], f'<article data-main="1"><h1>A title</h1>{_paragraphs(3)}</article>', ["footer"])),
    _nameless(_page(["menu"], f'<article data-main="1"><h1>A title</h1>{_paragraphs(2)}<p>Few words.</p><h2>Another title</h2>{_paragraphs(2)}</article>', ["sidebar", "foot"])),
    _nameless(_page(["nav", "share"], f'<article data-main="1"><h1>A title of some more words</h1>{_paragraphs(2)}<ul><li>{_FILL}</li><li>Few words</li></ul>{_paragraphs(1)}</article>', _MENUS)),
    _nameless(_page(_MENUS, f'<article data-main="1"><h2>A title</h2><p>See <a href="/z">this link</a> and <i>that</i>: {_FILL}</p>{_paragraphs(3)}</article>', ["form", "footer"])),
    f'<html><body data-main="1"><p>Few words.</p><p>And a few more of them</p><p>{_FILL}.</p></body></html>',
    f'<html><body data-main="1">{_paragraphs(5)}</body></html>',
    _page(["header", "nav"], f'<article data-main="1"><header><h1>A title</h1><p>Few words.</p></header>{_paragraphs(3)}</article>', ["footer"]),
    _page(["header", "nav"], f'<main><article data-main="1"><header><h2>A title</h2></header>{_paragraphs(3)}</article></main>', ["sidebar", "footer"]),
]
