"""Layouts whose class words say little of what a container holds, and headings outside of the article."""

import pytest

from tessella.llm import html_extract

TITLE = "The town by the river"
TEXT = [
    "This paragraph tells the reader about the town and its river. It goes on for a while, with commas, and ends here.",
    "A second one follows, which is as long as the first and says other things about the place, its people and the bridge.",
    "The third closes the text with a remark. It has two sentences.",
] * 3
PARAGRAPHS = "".join(f"<p>{p}</p>" for p in TEXT)
DIVS = "".join(f"<div>{p}</div>" for p in TEXT)
MENU = '<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">About</a></li><li><a href="/c">Contact</a></li></ul></nav>'
FOOT = "<footer>&copy; 2024 Example. All rights reserved.</footer>"
COMMENTS = '<section class="comments"><h3>2 comments</h3><div class="comment"><p>I liked this very much, thank you for writing it.</p></div><div class="comment"><p>Me too, I have been there last year with my family and it was nice.</p></div></section>'
ASIDE = '<aside class="sidebar"><h3>Related</h3><ul><li><a href="x">Other story</a></li><li><a href="y">More to read</a></li></ul></aside>'
H1 = f"<h1>{TITLE}</h1>"

LAYOUTS = {
    **{f"article {c}": f'<body>{MENU}<article class="{c}">{H1}{PARAGRAPHS}</article>{FOOT}' for c in ("post", "post has-comments", "post no-comments", "post with-related-header")},
    **{f"div {c}": f'<body>{MENU}<div id="main-content" class="{c}">{H1}{PARAGRAPHS}</div>{FOOT}' for c in ("content", "content with-sidebar", "content sidebar-off", "main related")},
    **{f"body {c}": f'<body class="{c}">{MENU}<article>{H1}{PARAGRAPHS}</article>{FOOT}' for c in ("comments-closed", "no-sidebar", "has-ads nav-open")},
    "divs in a wrapper": f'<body><div class="wrapper">{H1}{DIVS}</div>',
    "divs in a div": f"<body><div>{H1}{DIVS}</div>",
    "divs in the body": f"<body>{H1}{DIVS}",
    "divs beside a menu": f'<body>{MENU}<div class="wrapper">{H1}{DIVS}</div>{FOOT}',
    "heading before the article": f"<body>{MENU}{H1}<article>{PARAGRAPHS}</article>{FOOT}",
    "heading before the content": f'<body>{MENU}<div class="container">{H1}<div class="content">{PARAGRAPHS}</div></div>{FOOT}',
    "heading in main": f"<body>{MENU}<main>{H1}<article>{PARAGRAPHS}</article></main>{FOOT}",
    "heading in a header": f"<body>{MENU}<article><header>{H1}</header>{PARAGRAPHS}</article>{FOOT}",
    "heading in a box": f'<body>{MENU}<main><div class="page-title">{H1}</div><div class="entry">{PARAGRAPHS}</div></main>{FOOT}',
    "no wrapper": f"<body>{MENU}{H1}{PARAGRAPHS}{FOOT}",
    "all around": f"<body><header><h1>Example site</h1>{MENU}</header><article>{H1}{PARAGRAPHS}</article>{COMMENTS}{ASIDE}{FOOT}",
}


@pytest.mark.parametrize("name", LAYOUTS)
def test_the_whole_article_and_nothing_else(name):
    page = f"<html><head><title>x</title></head>{LAYOUTS[name]}</body></html>"
    assert html_extract.main_texts([page], html_extract.trained()) == ["\n\n".join([TITLE, *TEXT])]


def test_names_of_states_and_containers():
    tree = html_extract.Tree('<body class="sidebar"><div class="post has-comments"><p class="comment-body">x</p></div><div id="mainContent">y</div></body>')
    found = {n.tag + "".join("." + "-".join(x) for x in n.names): html_extract._named(n) for n in tree.nodes}
    assert not any(found["body.sidebar"][0])
    assert found["div.post.has-comments"] == ([False] * 7, True, True)
    bad, good, state = found["p.comment-body"]
    assert bad[list(html_extract.BAD_WORDS).index("comment")] and not good and not state
    assert found["div.main-content"][1]
