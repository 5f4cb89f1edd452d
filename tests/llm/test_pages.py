"""Page extraction against a second implementation over a tree of the page, and on pages of doubled length."""

import random
import time
from html.parser import HTMLParser

import pytest

from voxloom.llm import html_extract

STORY = [f"{'long sentence of the story ' * 5}{k}." for k in range(12)]
TALK = [f"{'reader says a thing or two ' * 8}{k}." for k in range(12)]
LINKS = "<ul>" + "".join(f"<li><a href='/{k}'>item number {k}</a></li>" for k in range(6)) + "</ul>"


def paragraphs(texts):
    return "".join(f"<p>{t}</p>" for t in texts)


@pytest.mark.parametrize("page", [
    f"<div>{paragraphs(STORY[:3])}</div><div class=comments>{paragraphs(TALK)}</div>",
    f"<article>{paragraphs(STORY[:3])}</article><div class='comments'>{paragraphs(TALK)}</div>",
    f"<article>{paragraphs(STORY[:3])}<section id='comments'>{paragraphs(TALK)}</section></article>",
    f"<div>{paragraphs(STORY[:3])}</div><section>" + "".join(f"<article class='comment'><p>{t}</p></article>" for t in TALK)
    + "</section>",
    f"<main>{paragraphs(STORY[:3])}</main><section class='comments'>" + "".join(f"<article><p>{t}</p></article>" for t in TALK)
    + "</section>",
    f"<div>{paragraphs(STORY[:1])}</div><div id='disqus'>{paragraphs(TALK)}</div>",
])
def test_reader_comments_never_come_out(page):
    n = 1 if "disqus" in page else 3
    assert html_extract.main_text(page) == " ".join(STORY[:n])


@pytest.mark.parametrize("page", [
    f"<form id='aspnet'><header>Top</header><article>{paragraphs(STORY)}</article><input name=q></form>",
    f"<form><div>{paragraphs(STORY)}</div><button>Go</button></form>",
    f"<article>{paragraphs(STORY)}<form><label>Mail</label><p>{'we keep your data safe ' * 9}</p></form></article>",
    f"<div class='has-comments page--comments-open'><div>{paragraphs(STORY)}</div></div>",
])
def test_forms_and_states_around_the_article(page):
    assert html_extract.main_text(page) == " ".join(STORY)


def test_a_story_in_several_stretches():
    page = f"<div>{paragraphs(STORY[:6])}</div>{LINKS}<div>{paragraphs(STORY[6:])}</div>{LINKS}<p>&copy; {'all rights ' * 9}</p>"
    assert html_extract.main_text(page) == " ".join(STORY)


@pytest.mark.parametrize("unit", [
    "<a ", "<div class=sidebar>x", '<a "', "<a href=\"x>", "<!--", "<script>", "</", "<nav>x", "<title", "<![CDATA[",
    "<p class='menu-menu'", "<article><p>x", "<p x=''", "<p>one two three four five</p>", "<div class=ad><article>y",
])
def test_time_grows_with_the_length(unit):
    def seconds(n):
        page = unit * n + "</div>" * (n if "<div" in unit else 0)
        start = time.perf_counter()
        html_extract.main_text(page)
        return time.perf_counter() - start
    seconds(1000)
    assert min(seconds(32_000) for _ in range(2)) < 0.2 + 12 * min(seconds(8_000) for _ in range(2))


class Tree(HTMLParser):
    """Lines of a well-formed page with the nodes around them."""

    def __init__(self):
        super().__init__()
        self.path, self.lines, self.parts, self.nodes = [], [], [], []

    def end_line(self):
        text = " ".join("".join(t for t, _ in self.parts).split())
        if text:
            linked = sum(len(t) for t, link in self.parts if link)
            self.lines.append((text, max(0, len(text) - 2 * linked), list(self.path)))
        self.parts = []

    def handle_starttag(self, tag, attrs):
        names = {n for k, v in attrs for n in (v or "").split() if k in ("class", "id")}
        self.nodes.append((tag, names))
        if tag not in ("a", "b"):
            self.end_line()
        if tag != "br":
            self.path.append(len(self.nodes) - 1)

    def handle_endtag(self, tag):
        if tag not in ("a", "b"):
            self.end_line()
        self.path.pop()

    def handle_data(self, data):
        self.parts.append((data, any(self.nodes[n][0] == "a" for n in self.path)))


def by_tree(page):
    """The rules of the module, over every set of lines anew."""
    tree = Tree()
    tree.feed(page)
    tree.close()
    tree.end_line()
    nodes = tree.nodes
    lines = [x for x in tree.lines if not any(nodes[n][0] in ("nav", "footer", "aside", "header", "button") for n in x[2])]
    talk = {n for n, (_, names) in enumerate(nodes) if names & {"comments", "comment"}}
    other = {n for n, (tag, names) in enumerate(nodes) if tag == "form" or tag not in ("article", "main") and names & {
        "sidebar", "menu", "related"}} - talk
    real = {n for n, (tag, _) in enumerate(nodes) if tag in ("article", "main")} - talk
    quiet = [0 if talk & set(path) else w for _, w, path in lines]

    def surges(values):
        return sum(values) >= 80 if len(values) < 3 else any(sum(values[k:k + 3]) >= 80 for k in range(len(values) - 2))

    def inside(n):
        return [k for k, x in enumerate(lines) if n in x[2]]
    in_article = [bool(real & set(x[2])) for x in lines]
    free, run = 0, []
    for k, (_, w, path) in enumerate([*lines, ("", 0, list(talk | other) or [None])]):
        if (talk | other) & set(path) or path == [None]:
            free = max(free, sum(run) if surges(run) and run else 0)
            run = []
        else:
            run.append(w)
    gone = set()
    for n in talk | other:
        own = inside(n)
        if not own:
            continue
        rest = max(free, sum(w for k, w in enumerate(quiet) if in_article[k] and k not in own))
        wraps = any(n in path[:path.index(m)] and not (talk - {n}) & set(path[path.index(n):path.index(m)])
                    for _, _, path in lines for m in real if m in path and n in path and path.index(n) < path.index(m))
        size = sum(quiet[k] for k in own)
        layout = wraps and rest == 0 if n in talk else (
            wraps or surges([quiet[k] for k in own]) and 2 * size > sum(quiet) and size > 4 * rest)
        if not layout:
            gone.add(n)
    left = [html_extract.Line(x[0], 0 if x[1] else len(x[0]), a) for x, a in zip(lines, in_article) if not gone & set(x[2])]
    return " ".join(x.text for x in html_extract.main_lines(left))


def random_page(rng, depth=0):
    out = []
    for _ in range(rng.randint(1, 4)):
        kind = rng.random()
        if kind < 0.45 or depth > 3:
            words = " ".join(rng.choice(["river", "stone", "light", "of", "paper"]) for _ in range(rng.choice([2, 6, 25, 60])))
            out.append(f"<p>{words}</p>" if rng.random() < 0.7 else f"<p><a>{words}</a></p>")
        else:
            tag = rng.choice(["div", "section", "article", "main", "form", "nav", "aside", "div", "div"])
            name = rng.choice(["", "", "class='sidebar'", "class='comments'", "id='menu'", "class='x comment'", "class='related y'",
                               "class='has-sidebar'"])
            out.append(f"<{tag} {name}>{random_page(rng, depth + 1)}</{tag}>")
    return "".join(out)


@pytest.mark.parametrize("seed", range(400))
def test_pages_agree_with_the_tree(seed):
    page = random_page(random.Random(seed))
    assert html_extract.main_text(page) == by_tree(page)
