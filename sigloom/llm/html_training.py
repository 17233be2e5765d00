"""Labelled pages for the extraction model: layouts drawn at random, with the blocks of the article marked.

The pages are made up here (words, names and layouts come from a seeded generator), so the labels are exact: each word
of an article carries the private character MARK, which is taken out before the blocks are learnt from.
"""

from __future__ import annotations

import html
import random
from collections.abc import Callable, Iterator

from sigloom.llm.html_blocks import Block, blocks

_SYLLABLES = "an ba co du el fi go ha in jo ka le mo na or pe qui ra su ti un ve wo xa ya zo thé grü ción straß ель ка 語 文".split()


MARK = "\ue000"


class Maker:
    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.mark = ""
        self.vocabulary = ["".join(self.r.choices(_SYLLABLES, k=self.r.randint(1, 4))) for _ in range(3000)]

    def word(self) -> str:
        return self.r.choice(self.vocabulary) + self.mark

    def words(self, lo: int, hi: int) -> str:
        some = self.r.choices(self.vocabulary, k=self.r.randint(lo, hi))
        return f"{self.mark} ".join(some) + self.mark

    def sentence(self) -> str:
        s = self.words(1, 18).capitalize()
        return s + (", " + self.words(2, 9) if self.r.random() < 0.4 else "") + self.r.choice("...!?")

    def prose(self) -> str:
        return " ".join(self.sentence() for _ in range(self.r.choice([1, 1, 2, 3, 4, 6, 9])))

    def attr(self, *names: str) -> str:
        name = self.r.choice(names)
        return self.r.choice(["", f' class="{name}"', f' id="{name}"', f' class="{self.word()} {name}"']) if name else ""

    def sure(self, *names: str) -> str:
        return self.r.choice([' class="%s"', ' id="%s"', ' class="box %s"']) % self.r.choice(names)

    def escape(self, text: str) -> str:
        text = html.escape(text, quote=False)
        return text.replace(" ", self.r.choice([" ", "\n ", "&nbsp;", "  "]), 1) if self.r.random() < 0.2 else text

    # parts of an article

    def inline(self, text: str) -> str:
        text = self.escape(text)
        p = self.r.random()
        if p < 0.1:
            return f"<b>{text}" + ("</b>" if self.r.random() < 0.5 else "<br>")
        if p < 0.25 and " " in text:
            head, _, tail = text.partition(" ")
            tag = self.r.choice(["a href='/x'", "em", "strong", "span", "code"])
            return f"{head} <{tag}>{self.word()}</{tag.split()[0]}> {tail}"
        return text

    def article(self) -> str:
        self.mark, out = MARK, []
        if self.r.random() < 0.85:
            out.append(f"<h1>{self.escape(self.words(1, 12))}</h1>")
        for _ in range(self.r.choice([1, 1, 2, 3, 5, 8, 14])):
            p = self.r.random()
            if p < 0.7:
                out.append(f"<p>{self.inline(self.prose())}" + ("</p>" if self.r.random() < 0.85 else ""))
            elif p < 0.78:
                level = self.r.randint(2, 4)
                out.append(f"<h{level}>{self.escape(self.words(1, 8))}</h{level}>")
            elif p < 0.86:
                tag = self.r.choice(["ul", "ol"])
                out.append(f"<{tag}>" + "".join(f"<li>{self.inline(self.sentence())}</li>" for _ in range(self.r.randint(2, 5))) + f"</{tag}>")
            elif p < 0.9:
                out.append(f"<blockquote>{'<p>' if self.r.random() < 0.5 else ''}{self.inline(self.prose())}</blockquote>")
            elif p < 0.94:
                out.append("<table>" + "".join(f"<tr><td>{self.word()}</td><td>{self.words(1, 4)}</td></tr>" for _ in range(self.r.randint(1, 4))) + "</table>")
            elif p < 0.97:
                out.append(f"<pre>{self.escape(self.words(4, 20))}</pre>")
            else:
                out.append(f"<figure><img src='a.png'><figcaption>{self.sentence()}</figcaption></figure>")
        if self.r.random() < 0.15:
            self.mark = ""
            out.insert(self.r.randint(1, len(out)), self.boilerplate(self.r.choice(["ad", "share", "side", "note"])))
        self.mark = ""
        return "".join(out)

    # parts that are not the article

    def items(self, lo: int, hi: int) -> str:
        each = ["<li><a href='/%s'>%s</a></li>", "<a href='/%s'>%s</a> ", "<a href='/%s'>%s</a> | "]
        form = self.r.choice(each)
        rows = "".join(form % (self.word(), self.words(1, 3)) for _ in range(self.r.randint(lo, hi)))
        return f"<ul>{rows}</ul>" if form.startswith("<li") else rows

    def line(self) -> str:
        return self.r.choice([self.sentence, self.prose, lambda: self.words(1, 6)])()

    def boilerplate(self, kind: str) -> str:
        r = self.r
        if kind == "menu":
            tag, a = r.choice([("nav", self.attr("nav", "menu", "")), ("div", self.sure("nav", "menu", "main-nav", "breadcrumb", "navbar")), ("ul", self.sure("menu", "nav"))])
            return f"<{tag}{a}>{self.items(2, 9)}</{tag}>"
        if kind == "head":
            tag, a = r.choice([("header", self.attr("header", "masthead", "")), ("div", self.sure("header", "masthead", "site-header", "topbar"))])
            return f"<{tag}{a}><div>{self.words(1, 4)}</div>{'<p>' + self.sentence() + '</p>' if r.random() < 0.4 else ''}{self.boilerplate('menu') if r.random() < 0.4 else ''}</{tag}>"
        if kind == "foot":
            tag, a = r.choice([("footer", self.attr("footer", "")), ("footer", ""), ("div", self.sure("footer", "site-footer", "copyright", "legal"))])
            inner = r.choice([f"&copy; {self.word()}.example.com &middot; {self.line()}", f"<p>{self.line()}</p><p>&copy; 2020</p>", self.items(2, 6), f"<p>{self.line()}</p>"])
            return f"<{tag}{a}>{inner}</{tag}>"
        if kind == "side":
            tag, a = r.choice([("aside", self.attr("sidebar", "related", "")), ("div", self.sure("sidebar", "related", "widget", "related-posts", "popular", "recommended")), ("section", self.sure("related", "sidebar"))])
            return f"<{tag}{a}>{'<h3>' + self.words(1, 4) + '</h3>' if r.random() < 0.6 else ''}{r.choice([self.items(2, 6), '<p>' + self.line() + '</p>', '<p>' + self.line() + '</p>' + self.items(1, 4)])}</{tag}>"
        if kind == "note":
            a = self.sure("cookie", "cookie-banner", "consent", "notice", "newsletter", "popup", "gdpr", "alert", "subscribe")
            tag = r.choice(["div", "section", "p", "dialog"])
            return f"<{tag}{a}>{self.line()}{' <button>' + self.word() + '</button>' if r.random() < 0.5 else ''}</{tag}>"
        if kind == "ad":
            tag = r.choice(["div", "div", "aside", "section", "p", "ins"])
            return f"<{tag}{self.sure('ad', 'ads', 'advert', 'sponsored', 'ad-slot', 'promo', 'advertisement')}>{self.line()}</{tag}>"
        if kind == "talk":
            tag, a = r.choice(["div", "section", "ol"]), self.sure("comments", "comment-list", "discussion", "replies", "respond")
            each = [f"<div{self.sure('comment', 'reply')}><p>{self.prose()}</p></div>", f"<li>{self.prose()}</li>", f"<article{self.sure('comment')}><b>{self.word()}</b><p>{self.prose()}</p></article>", f"<p>{self.prose()}</p>"]
            each += [f"<article><div>{self.words(1, 3)}</div><p>{self.prose()}</p></article>", f"<div><b>{self.word()}</b><div{self.sure('content', 'text', 'body')}>{self.prose()}</div></div>"]
            form = r.randrange(6)
            return f"<{tag}{a}>{'<h3>' + self.words(1, 3) + '</h3>' if r.random() < 0.6 else ''}{''.join(each[form] for _ in range(r.randint(1, 5)))}</{tag}>"
        if kind == "form":
            return f"<form{self.attr('search', 'login', 'contact', '')}><label>{self.words(1, 4)}</label><input name='q'>{'<p>' + self.line() + '</p>' if r.random() < 0.4 else ''}<button>{self.word()}</button></form>"
        return f"<div{self.sure('share', 'social', 'byline', 'tags', 'post-meta')}>{r.choice([self.items(1, 4), self.words(1, 5)])}</div>"

    def layout(self) -> str:
        """Attributes of an element around the article and more, whose names tell about the whole page."""
        r, names = self.r, "has-sidebar no-sidebar layout-with-sidebar with-comments content-sidebar-wrap page comments-open cookie-bar-on menu-open header-fixed sticky-footer single-post nav-open widget-area-on site wrapper container row l-main social-on modal-ready ad-layout blog-sidebar form-page comment-status-open".split()
        return r.choice(["", ' class="%s"', ' id="%s"', ' class="%s"']).replace("%s", " ".join(r.sample(names, r.choice([1, 1, 2, 3]))))

    def core(self, body: str) -> str:
        r, form = self.r, self.r.random()
        if r.random() < 0.12:  # a title of its own element
            head, cut, rest = body.partition("</h1>")
            body = f"<header{self.attr('entry-header', 'post-header', '')}>{head}{cut}</header>{rest}" if cut else body
        if r.random() < 0.15:
            body = f"<div{self.attr('inner', 'body', 'text', 'post-body')}>{body}</div>"
        if form < 0.4:
            return f"<article{self.attr('post', 'article', '')}>{body}</article>"
        if form < 0.55:
            return f"<main>{body}</main>"
        if form < 0.75:
            return f"<div{self.sure('content', 'post', 'article-body', 'entry-content', 'story', 'main')}>{body}</div>"
        if form < 0.82:
            beside = f"<td>{self.boilerplate(r.choice(['menu', 'side', 'ad']))}</td>" if r.random() < 0.7 else ""
            return f"<table><tr>{beside}<td>{body}</td></tr></table>"
        return body if form < 0.87 else f"<div>{body}</div>" if form < 0.96 else f"<section>{body}</section>"

    def page(self) -> str:
        r = self.r
        body = self.article()
        if r.random() < 0.1:  # comments inside the article's element
            body += self.boilerplate(r.choice(["talk", "share", "form", "side"]))
        core = self.core(body)
        inside = [self.boilerplate(k) for k in r.sample(["side", "share", "talk", "ad", "form"], r.choice([0, 0, 1, 2]))]
        if r.random() < 0.08:
            inside += [self.boilerplate("talk") for _ in range(4)]  # more is said by readers than by the article
        if inside and r.random() < 0.3:
            core = f"<main>{core}{''.join(inside)}</main>"
            inside = []
        if r.random() < 0.25:  # around the article alone
            core = f"<div{self.layout()}>{core}</div>"
        if r.random() < 0.06:
            core = f"<form{self.attr('aspnetForm', 'form1', 'main-form')} method='post'><input type='hidden' name='s'>{core}</form>"
        first = [self.boilerplate(k) for k in ("head", "menu", "note", "ad", "form", "side") if r.random() < 0.35]
        after = [self.boilerplate(k) for k in ("share", "ad", "side", "talk", "form", "note") if r.random() < 0.3]
        r.shuffle(after)
        foot = self.boilerplate("foot") if r.random() < 0.8 else ""
        if r.random() < 0.12:  # a page of little else
            first, after, foot = [], [], ""
        whole = "".join(first) + core + "".join(inside + after) + foot
        if r.random() < 0.15:
            whole = f"<form{self.attr('aspnetForm', 'form1', 'contact', '')} method='post' action='./'>{whole}</form>"
        for _ in range(r.choice([0, 0, 1, 2])):
            whole = f"<div{self.layout()}>{whole}</div>"
        return f"<!DOCTYPE html><html{self.layout() if r.random() < 0.2 else ''}><head><title>{self.words(1, 6)}</title><style>p{{margin:0}}</style></head><body{self.layout()}>{whole}" + ("</body></html>" if r.random() < 0.9 else "")


    # pages from before there were names for parts

    def bare(self) -> str:
        """Text and line breaks in a body, without an element that would hold a block."""
        r, cut = self.r, self.r.choice(["<br>", "<br><br>", "<br/>\n", "<hr>"])
        self.mark = MARK
        lines = [self.inline(self.prose()) for _ in range(r.choice([1, 1, 2, 3, 6]))]
        if r.random() < 0.4:
            lines.insert(0, r.choice(["<b>%s</b>", "<font size='5'>%s</font>", "%s"]) % self.words(2, 8))
        self.mark = ""
        if r.random() < 0.3:
            lines.insert(0, self.links(2, 6))
        if r.random() < 0.4:
            lines.append(r.choice([f"&copy; {self.word()} 2004", self.links(2, 5)]))
        head = f"<head><title>{self.words(1, 6)}</title></head>" if r.random() < 0.7 else ""
        return f"<html>{head}<body>{cut.join(lines)}</body></html>" if r.random() < 0.8 else cut.join(lines)

    def links(self, lo: int, hi: int) -> str:
        return self.r.choice([" | ", " ", " - ", "<br>"]).join(f"<a href='/{self.word()}'>{self.words(1, 2)}</a>" for _ in range(self.r.randint(lo, hi)))

    def table(self) -> str:
        """Rows and cells lay the page out: a name on top, links beside the text, who owns it below."""
        r, cell = self.r, lambda x: f"<td{self.r.choice(['', ' valign=top', ' width=20%'])}>{x}</td>"
        body = self.article()
        if r.random() < 0.5:
            self.mark = MARK
            body = r.choice(["<br>", "<br><br>", "<p>"]).join(self.inline(self.prose()) for _ in range(r.choice([1, 2, 3, 6])))
            self.mark = ""
        row = [cell(body)]
        if r.random() < 0.8:
            row.insert(r.choice([0, 0, 1]), cell(self.links(1, 9)))
        if r.random() < 0.2:
            row.append(cell(r.choice([self.line(), self.links(1, 4)])))
        rows = ["".join(row)]
        if r.random() < 0.5:
            rows.insert(0, cell(r.choice([self.words(1, 4), self.links(2, 6), f"<img src='logo.gif'>{self.words(1, 3)}"])))
        if r.random() < 0.7:
            rows.append(cell(r.choice([f"&copy; 2003 {self.words(1, 4)}", f"Copyright {self.words(1, 4)}", self.links(2, 5), f"<small>{self.line()}</small>"])))
        return f"<html><head><title>{self.words(1, 6)}</title></head><body><table width='100%'>" + "".join(f"<tr>{x}</tr>" for x in rows) + "</table></body></html>"


#: Of the pages, the share of more that are bare or laid out by tables.
OLD_SHARE = 0.15


def labelled_pages(pages: int, seed: int) -> list[tuple[list[Block], list[int]]]:
    """(blocks, 1 for each block of the article) of as many pages, and of OLD_SHARE more in old layouts."""
    out = [x for x in map(_labelled, _made(Maker(seed), Maker.page, pages)) if x]
    old = Maker(seed + 1)
    many = int(pages * OLD_SHARE / 2)
    return out + [x for make in (Maker.bare, Maker.table) for x in map(_labelled, _made(old, make, many)) if x]


def _made(maker: Maker, make: Callable[[Maker], str], n: int) -> Iterator[str]:
    """n pages that have a block to be seen."""
    while n:
        page = make(maker)
        if any(not b.hidden for b in blocks(page)):
            n -= 1
            yield page


def _labelled(page: str) -> tuple[list[Block], list[int]]:
    row = [b for b in blocks(page) if not b.hidden]
    labels = [int(MARK in b.text) for b in row]
    row = [b._replace(text=b.text.replace(MARK, "") or "-", linked=b.linked - b.text.count(MARK) * (b.linked > 0)) for b in row]
    return [b._replace(linked=max(0, min(b.linked, len(b.text)))) for b in row], labels
