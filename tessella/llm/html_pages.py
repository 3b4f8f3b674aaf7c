"""Generated web pages whose main text is known; the training data of ``html_extract``.

Every page is drawn at random (seeded) from layouts, tag names and attribute words; its sentences are made of syllables.
Each block of main text ends with a marker, one private character, and nothing else on the page holds it.
"""

from __future__ import annotations

import random

_SYLLABLES = "an be co da el fi go ha in jo ka le mi no or pa qui re sa ti um ve wo xa yo zu".split()
MARKER = "\ue000"


class _Page:
    def __init__(self, rng: random.Random):
        self.r = rng
        #: How its sentences look: most as prose, some as the noise that crawled pages hold.
        self.style = rng.choice(["prose"] * 7 + ["same word", "unpunctuated", "shouted"])
        #: Longest paragraphs in sentences; some pages hold only short or only long ones.
        self.lengths = rng.choice([[1, 1, 2, 6, 12]] * 3 + [[1], [1, 1, 1, 12], [1, 60], [6, 12, 60]])
        self.shortest = rng.choice([1, 3, 3])
        self.marker = MARKER

    def word(self) -> str:
        return "".join(self.r.choice(_SYLLABLES) for _ in range(self.r.randint(1, 3)))

    def sentence(self, low: int = 3, high: int = 18) -> str:
        words = [self.word() for _ in range(self.r.randint(low, high))]
        if self.style == "same word":
            words = words[:1] * self.r.randint(low, high * 3)
        if self.style == "shouted":
            return "!! ".join(words).upper() + "."
        if self.style in ("same word", "unpunctuated"):
            return " ".join(words).capitalize()
        return " ".join(words).capitalize() + self.r.choice([".", ".", ".", "!", "?"])

    def prose(self, low: int = 1, high: int = 8) -> str:
        return " ".join(self.sentence(self.shortest, max(3, self.shortest * 6)) for _ in range(self.r.randint(low, high)))

    def link(self, words: int = 3) -> str:
        return f'<a href="/{self.word()}">{" ".join(self.word() for _ in range(self.r.randint(1, words)))}</a>'

    #: Class names that say what state a page is in.
    STATES = "has-comments no-comments comments-closed comments-open with-sidebar no-sidebar sidebar-off is-open with-related-header nav-open has-ads no-footer menu-open share-enabled".split()
    #: Words of parts around the main text, as wrappers of all of it carry them now and then.
    STRAY = "related sidebar widget header banner comments share menu toc footer top promo bottom".split()

    def mixed(self, name: str) -> str:
        """Attributes of a container of the main text: its name among words that mean nothing here."""
        more = [self.r.choice(self.STATES) for _ in range(self.r.choice([0, 0, 1, 1, 2]))] + [self.r.choice(self.STRAY) for _ in range(self.r.random() < 0.3)]
        names = [name, *more]
        self.r.shuffle(names)
        return f' class="{" ".join(names)}"' if self.r.random() < 0.7 else f' id="{name}" class="{" ".join(more) or "x"}"'

    def box(self, tags: str, names: str, inner: str, bare: float = 0.15) -> str:
        tag = self.r.choice(tags.split())
        attr = ""
        if self.r.random() > bare:
            name = self.r.choice(names.split())
            attr = f' {self.r.choice(["class", "class", "id"])}="{self.r.choice(["", "", "site-", "page-", self.word() + " "])}{name}"'
        return f"<{tag}{attr}>{inner}</{tag}>"

    def pick(self, *makers) -> str:
        return self.r.choice(makers)()

    # -- around the main text
    def menu(self) -> str:
        items = "".join(f"<li>{self.link()}</li>" for _ in range(self.r.randint(3, 12)))
        return self.pick(lambda: self.box("nav", "menu nav main-nav", f"<ul>{items}</ul>", 0.6), lambda: self.box("div", "menu nav navigation breadcrumb toc", f"<ul>{items}</ul>", 0), lambda: self.box("ul", "menu nav tabs pagination", items, 0.3))

    def header(self) -> str:
        title = self.pick(lambda: f"<h1>{self.sentence(1, 4)}</h1>", lambda: f"<h1>{self.sentence(1, 2)}</h1>", lambda: f"<p>{self.sentence(2, 8)}</p>", lambda: f"<div>{self.link()}</div>", lambda: self.sentence(2, 6))
        inner = title + (self.menu() if self.r.random() < 0.4 else "")
        return self.pick(lambda: self.box("header", "header top masthead", inner, 0.6), lambda: self.box("div", "header top masthead banner", inner, 0))

    def advert(self) -> str:
        return self.box("div div div aside section p", "ad ads advert advertisement sponsored promo banner", self.pick(lambda: self.prose(1, 3), lambda: f"<p>{self.prose(1, 3)}</p>", lambda: self.link(6)), 0)

    def notice(self) -> str:
        return self.box("div div section aside p", "notice cookie cookie-notice consent alert newsletter subscribe popup", self.pick(lambda: self.prose(1, 3), lambda: f"<p>{self.prose(1, 4)}</p><button>{self.word()}</button>", lambda: f"<p>{self.prose(1, 2)}</p>{self.link()}"), 0)

    def sidebar(self) -> str:
        items = "".join(f"<li>{self.link(8)}</li>" for _ in range(self.r.randint(2, 8)))
        inner = f"<h3>{self.sentence(1, 4)}</h3>" + self.pick(lambda: f"<ul>{items}</ul>", lambda: "".join(f"<p>{self.prose(1, 5)}</p>" for _ in range(self.r.randint(1, 4))), lambda: self.prose(1, 4), lambda: f"<p>{self.prose(1, 3)}</p><ul>{items}</ul>")
        return self.pick(lambda: self.box("aside", "sidebar side related widget", inner, 0.5), lambda: self.box("div section", "sidebar related widget recommended popular trending share social tags", inner, 0))

    def comments(self) -> str:
        each = "".join(self.box(self.r.choice(["div", "li", "article", "p"]), "comment reply", self.pick(lambda: f"<p>{self.prose(1, 5)}</p>", lambda: f"<b>{self.word()}</b> <p>{self.prose(1, 6)}</p>", lambda: self.prose(1, 5)), 0.3) for _ in range(self.r.randint(1, 6)))
        return self.box("div section section ul", "comments comment-list replies discussion responses", f"<h3>{self.sentence(1, 3)}</h3>{each}", 0)

    def form(self) -> str:
        inner = f'<label>{self.sentence(1, 4)}</label><input name="{self.word()}"><p>{self.prose(1, 2)}</p><button>{self.word()}</button>'
        return self.pick(lambda: f"<form>{inner}</form>", lambda: self.box("form div", "form login search contact signup", inner, 0))

    def footer(self) -> str:
        inner = self.pick(lambda: f"&copy; {self.word()} &middot; {self.prose(1, 2)}", lambda: f"<p>{self.prose(1, 3)}</p>", lambda: f"<p>{self.sentence()}</p><ul>{''.join(f'<li>{self.link()}</li>' for _ in range(4))}</ul>", lambda: "".join(self.link() + " | " for _ in range(5)))
        return self.pick(lambda: self.box("footer", "footer", inner, 0.6), lambda: self.box("footer", "footer", inner, 1), lambda: self.box("div section", "footer copyright legal bottom", inner, 0))

    # -- main text
    def marked(self, text: str) -> str:
        return f"{text}{self.marker}"

    def paragraph(self) -> str:
        text = self.prose(1, self.r.choice(self.lengths))
        if self.r.random() < 0.2:
            text = f"{text} {self.link()} {self.sentence()}"
        if self.r.random() < 0.15:
            text = f"<em>{self.word()}</em> {text}"
        return self.marked(text)

    def main(self) -> str:
        out, before = [], ""
        blocks_in_divs = self.r.random() < 0.15
        heading = self.r.random()
        if heading < 0.25:  # the heading stands in front of what holds the text
            before = f"<h1>{self.marked(self.sentence(1, 10))}</h1>"
            before = self.pick(lambda: before, lambda: before, lambda: before, lambda: f"{before}<p>{self.marked(self.sentence(2, 14))}</p>", lambda: f"<div>{before}</div>")
        elif heading < 0.85:
            head = f"<h1>{self.marked(self.sentence(1, 10))}</h1>"
            out.append(f"<header>{head}</header>" if self.r.random() < 0.15 else head)
        loose = self.r.random() < 0.3
        if self.r.random() < 0.15:  # a stub
            out.append(f"<p>{self.marked(self.sentence(1, 3))}</p>")
        for _ in range(0 if out and self.r.random() < 0.1 else self.r.choice([1, 1, 2, 3, 5, 8, 14, 40])):
            kind = self.r.random()
            if kind < 0.72 and blocks_in_divs:
                out.append(f"<div>{self.paragraph()}</div>" if self.r.random() < 0.7 else self.box("div section", "text row paragraph block col", self.paragraph(), 0))
            elif kind < 0.72:
                text = self.paragraph()
                out.append(f"<p><b>{text}<br>" if loose and self.r.random() < 0.3 else f"<p>{text}" if loose and self.r.random() < 0.3 else f"<p>{text}</p>")
            elif kind < 0.8:
                out.append(f"<h{(n := self.r.randint(2, 4))}>{self.marked(self.sentence(1, 6))}</h{n}>")
            elif kind < 0.86:
                tag = self.r.choice(["ul", "ol"])
                out.append(f"<{tag}>{''.join(f'<li>{self.marked(self.sentence(2, 14))}</li>' for _ in range(self.r.randint(2, 6)))}</{tag}>")
            elif kind < 0.9:
                out.append(f"<blockquote>{self.marked(self.prose(1, 3))}</blockquote>")
            elif kind < 0.92:
                out.append(f"<pre>{self.marked(self.prose(1, 3))}</pre>")
            elif kind < 0.94:
                out.append(f"<table><tr><td>{self.marked(self.sentence(1, 6))}</td><td>{self.marked(self.sentence(1, 6))}</td></tr></table>")
            elif kind < 0.96:
                out.append(f"<div><p>{self.paragraph()}</p><p>{self.paragraph()}</p></div>")
            else:
                out.append(self.pick(self.advert, self.notice, self.sidebar, self.form))
        inner = "".join(out)
        body = self.pick(lambda: f"<article>{inner}</article>", lambda: self.box("article", "post entry article", inner, 0), lambda: self.box("div section main", "content post entry article story post-body article-text", inner, 0), lambda: f"<main>{inner}</main>", lambda: f"<div>{inner}</div>", lambda: self.around("article div section main", "content main post entry article story", inner), lambda: self.around("article div main", "content main post entry", inner))
        if self.r.random() < 0.15:
            body = before + body
            before = ""
        if self.r.random() < 0.4:
            more = body + (self.comments() if self.r.random() < 0.3 else "")
            if before and self.r.random() < 0.8:
                before, more = "", before + more
            body = self.pick(lambda: self.box("main div section", "content main wrapper page container", more, 0.3), lambda: self.around("main div section", "content main wrapper page container", more))
        return before + body

    def around(self, tags: str, names: str, inner: str) -> str:
        tag = self.r.choice(tags.split())
        return f"<{tag}{self.mixed(self.r.choice(names.split()))}>{inner}</{tag}>"

    def page(self) -> str:
        if self.r.random() < 0.08:  # nothing but the main text
            return f"<html><head><title>{self.sentence(1, 8)}</title></head><body{self.states()}>{self.main()}</body></html>"
        before = [m for m, p in ((self.header, 0.5), (self.menu, 0.7), (self.notice, 0.25), (self.advert, 0.45), (self.sidebar, 0.2), (self.form, 0.15)) if self.r.random() < p]
        after = [m for m, p in ((self.comments, 0.35), (self.sidebar, 0.35), (self.advert, 0.2), (self.notice, 0.15), (self.form, 0.2), (self.menu, 0.1), (self.footer, 0.85)) if self.r.random() < p]
        inner = "".join(m() for m in before) + self.main() + "".join(m() for m in after)
        if self.r.random() < 0.2:
            inner = self.box("div", "wrapper container page site", inner, 0.3)
        text = f'<!DOCTYPE html><html><head><title>{self.sentence(1, 8)}</title><script>var t="</p>";</script></head><body{self.states()}>{inner}</body></html>'
        return text[: self.r.randint(len(text) // 2, len(text))] if self.r.random() < 0.05 else text


    def states(self) -> str:
        return f' class="{" ".join(self.r.choice(self.STATES) for _ in range(self.r.randint(1, 3)))}"' if self.r.random() < 0.3 else ""


def labelled_pages(n: int, seed: int = 7) -> list[tuple[str, str]]:
    """(html, marker) of ``n`` pages."""
    made = [_Page(random.Random(f"{seed}:{i}")) for i in range(n)]
    return [(p.page(), p.marker) for p in made]
