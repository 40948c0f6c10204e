"""Operators 2 and 4: brute-force checks of the inference, and held-out accuracy."""

import re
from itertools import product

import numpy as np
import pytest

from prefixlake.llm import html_text, transcripts


def test_marginals_against_all_labellings():
    model = html_text.trained_model()
    tree = html_text.Tree('<div class="nav">one</div><article><p>Some text here, long enough.</article><footer>&copy; us</footer>')
    n = len(tree.parent)
    total, by_node = 0.0, np.zeros((n, 3))
    for labels in product((0, 1, 2), repeat=n):
        p = 1.0
        for i, y in enumerate(labels):
            for f in tree.features[i]:
                p *= model.potential.get(f, (1, 1, 1))[y]
            if i:
                p *= model.edges[tree.text[i] is not None][labels[tree.parent[i]]][y]
        total += p
        by_node[np.arange(n), labels] += p
    assert np.array(model.marginals(tree)) == pytest.approx(by_node / total, abs=1e-9)


def test_held_out_pages():
    model = html_text.trained_model()
    right = wrong = missed = 0
    for page, content in html_text.labelled_pages(150, 77):
        got = set(filter(None, model.main_text(page).split("\n")))
        right, wrong, missed = right + len(got & content), wrong + len(got - content), missed + len(content - got)
    assert right / (right + wrong) > 0.8 and right / (right + missed) > 0.8


def test_main_text():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><p>no</p>";</script></head><body>
    <nav><ul><li><a href="/a">A</a></li><li><a href="/b">B</a></li></ul></nav><!-- <p>never</p> --><div class="cookie-notice">We use cookies.</div>
    <article><h1>Title &amp; more</h1><p><b>First   line,\n with <i>words</i> in it.<br>Still the first one.<p>Second &#233;t&eacute; 1 &lt; 2 paragraph of the text.</p>
    <div class="advert">Buy now, this is a good thing to have.</div><ul><li>Item one of the list.</li></ul></article>
    <section id="comments"><p>I think this is a fine article, really.</p></section><aside><p>Other things that you may like to read.</p></aside>
    <form>Your name <input></form><footer>&copy; all of us</footer></body></html>"""
    want = "Title & more\nFirst line, with words in it. Still the first one.\nSecond été 1 < 2 paragraph of the text.\nItem one of the list."
    assert html_text.trained_model().main_text(page) == want


def test_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    rows = [(1, None, "x"), (2, "", "y"), (3, "<<<>>> <p", None), (4, "plain words only", "z"), (5, "<p>" * 3000 + "deep", "t"), (6, "<a title='x><p>q", "u")]
    odd = spark.createDataFrame(rows, "page_id long, html string, text string")
    out = {r.page_id: r for r in html_text.main_texts(odd).collect()}
    assert out.keys() == {1, 2, 3, 4, 5, 6} and out[1].text == out[2].text == "" and out[1].n_chars == 0
    for r, p in zip(html_text.main_texts(pages).orderBy("page_id").collect(), pages.orderBy("page_id").collect(), strict=True):
        inside = re.search(r"<article>(.*?)</article>", p.html, re.S)[1]
        blocks = [" ".join(html_text.html.unescape(re.sub(r"</?(?:b|i|a|br)\b[^>]*>", " " if "br" in x else "", x)).split()) for x in re.split(r"</?(?:p|h1|h2|ul|li)>", inside)]
        assert r.url == p.url and r.n_chars == len(r.text)
        assert sum(b in r.text.split("\n") for b in filter(None, blocks)) >= 0.9 * len(list(filter(None, blocks)))
        assert r.text == "\n".join(filter(None, blocks))
    assert html_text.main_texts(pages.limit(0)).count() == 0


WORDS = "This is a long enough sentence with a good number of words in it."


@pytest.mark.parametrize("inside", [
    "<datalist><option>One<option>Two</datalist>", "<button>Go", "<select><option>A<option>B</select>", "<svg><text>no</text></svg>", "<object><p>gone</p></object>",
    "<option>stray", "<template><p>gone too</p></template>", "<noscript><p>no</p></noscript>", "<video>none", "</x></select></p>", "<iframe src=x></iframe>",
])
def test_unseen_elements(inside):
    """Nothing but the element itself is hidden, also where it has no end tag."""
    page = f"<html><body><nav><a href=1>Home</a></nav><article><h1>Title of it</h1><p>{WORDS}</p>{inside}<p>{WORDS} Again.</p><p>{WORDS} Third.</p></article><footer>&copy; us</footer></body></html>"
    assert html_text.trained_model().main_text(page) == f"Title of it\n{WORDS}\n{WORDS} Again.\n{WORDS} Third."


LAYOUTS = {
    "blog": f'<body><div id="top-menu"><a href=/>Home</a> <a href=/a>About</a></div><div class="wrapper"><div class="entry-content"><h2>On things</h2><p>{WORDS}</p><blockquote>{WORDS}</blockquote></div><div id="sidebar"><h3>Recent</h3><ul><li><a>One</a></li><li><a>Two</a></li></ul></div></div><div class="site-footer">&copy; 2020 Someone</div></body>',
    "news": f'<body><header><h1>The Paper</h1></header><nav><ul><li><a>World</a></li><li><a>Sport</a></li></ul></nav><main><article><h1>On things</h1><p>{WORDS}</p><aside class="ad">Buy a car today, cheap and good.</aside><p>{WORDS}</p></article></main><section class="comments"><h3>Comments</h3><p>I do not agree with this at all, sorry.</p></section><footer>&copy; The Paper</footer></body>',
    "cookies": f'<body><div class="cookie-banner">We use cookies to make it better.</div><main><h1>On things</h1><p>{WORDS}</p><p>{WORDS}</p></main><form class="newsletter">Get our letter <input></form></body>',
}


@pytest.mark.parametrize("name", sorted(LAYOUTS))
def test_other_layouts(name):
    """Pages written by hand, in other forms than the model was fitted to."""
    got = html_text.trained_model().main_text(LAYOUTS[name]).split("\n")
    assert got == ["On things", WORDS, WORDS]


def test_viterbi_against_all_paths():
    model = transcripts.RoleModel({("step", "user0", "assistant1"): 5, ("feature", "user1", "end:?"): 9, ("feature", "assistant1", "end:."): 9})
    lines = ["User: is it?", "It is.", "AI: more", "and so on?"]
    best = None
    for path in product(range(6), repeat=len(lines)):
        score, before = 0.0, ""
        for k, (state, line) in enumerate(zip(path, lines, strict=True)):
            hint, features, _ = transcripts.line_features(line, before)
            score += model.start[state] if not k else model.step[path[k - 1]][state]
            score += model.hint[state, hint] + sum(model.feature[f][state] for f in features if f in model.feature)
            before = line
        if best is None or score > best[0]:
            best = score, path
    turns = []
    for state, line in zip(best[1], lines, strict=True):
        role, starts = model.names[state]
        rest = transcripts.line_features(line, "")[2]
        if starts or not turns:
            turns.append([transcripts.ROLES[role], rest])
        else:
            turns[-1][1] += "\n" + rest
    assert [list(t) for t in model.roles("\n".join(lines))] == turns


def test_roles_held_out(spark):
    """Turns of conversations that the model has not seen. Marked ones are found with role and whole text; of those without a marker most
    words get the right role, and fewer are found whole, as nothing but length tells which line of two texts is whose."""
    turns = spark.read.parquet("/root/testdata/sf0.1/conversations.parquet")
    model = transcripts.fit(turns.filter("conv_id % 2 = 0"))
    held = turns.filter("conv_id % 2 = 1")
    made = transcripts._lined(held).collect()
    want = {(r.conv_id, r.part): [(t.role, t.text.strip(), t.line == t.text) for t in r.turns] for r in made}
    got = {(r.conv_id, r.part): list(zip(r.roles, r.turns, strict=True)) for r in transcripts.parse(transcripts.transcripts_of(held), model, conversation="conv_id").collect()}
    assert got.keys() == want.keys()
    found = {bare: [(role, text) in got[c] for c, ts in want.items() for role, text, b in ts if b == bare] for bare in (False, True)}
    right = []
    for c, ts in want.items():
        own = [(role, bare) for role, text, bare in ts for _ in text.split()]
        other = [role for role, text in got[c] for _ in text.split()]
        assert len(own) == len(other)
        right += [role == x for (role, bare), x in zip(own, other, strict=True) if bare]
    print({k: (sum(v), len(v)) for k, v in found.items()}, sum(right) / len(right))
    assert sum(found[False]) >= 0.95 * len(found[False]) and len(found[True]) > 100
    assert sum(found[True]) >= 0.4 * len(found[True]) and sum(right) >= 0.7 * len(right)


def test_parts_are_one_path(spark, monkeypatch):
    """A conversation in several rows has the roles that its whole best path has."""
    turns = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").filter("conv_id < 40")
    model = transcripts.fit(turns)
    monkeypatch.setattr(transcripts, "TURNS", 2)
    made = transcripts.transcripts_of(turns).unionByName(spark.createDataFrame([(None, 0, "User: a"), (None, 1, "b\nAI: c"), (None, 2, None)], "conv_id long, part long, text string"))
    texts: dict = {}
    for r in sorted(made.collect(), key=lambda r: r.part):
        texts.setdefault(r.conv_id, []).append(r)
    assert max(map(len, texts.values())) > 2
    want = {}
    for conv, rows in texts.items():
        scores = np.concatenate([model.scored(r.text or "")[0] for r in rows])
        best, came = model.start + scores[0], []
        for own in scores[1:]:
            paths = best[:, None] + model.step
            came.append(paths.argmax(axis=0))
            best = paths.max(axis=0) + own
        states = [int(best.argmax())]
        for back in came[::-1]:
            states.append(int(back[states[-1]]))
        states, k = states[::-1], 0
        for n, r in enumerate(rows):
            lines = len((r.text or "").split("\n"))
            own = [model.names[x] for x in states[k : k + lines]]
            want[conv, r.part] = ([transcripts.ROLES[a] for i, (a, starts) in enumerate(own) if starts or not i], bool(n) and not own[0][1])
            k += lines
    got = {(r.conv_id, r.part): (r.roles, r.continued) for r in transcripts.parse(made, model, conversation="conv_id").collect()}
    assert got == want


def test_odd_transcripts(spark):
    rows = [(1, 0, "user", "hi", 5), (1, 0, "user", "hi", 5), (1, 1, None, None, 5), (None, None, "assistant", "x", 5), (2, 300, "user", "later", 5), (2, 0, "robot", "", 5)]
    turns = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, n_turns int")
    made = transcripts.transcripts_of(turns)
    model = transcripts.fit(turns)
    out = transcripts.parse(made, model).collect()
    assert len(out) == 4 and all(r.rendered.count("<|end|>") == r.n_turns for r in out)
    assert transcripts.parse(transcripts.transcripts_of(turns.limit(0)), transcripts.fit(turns.limit(0))).count() == 0
    given = spark.createDataFrame([("k", None, 1), ("k", "  \n ", 2), ("z", "User: a\nBot: b", 3)], "roles string, text string, id int")
    out = {r.id: r for r in transcripts.parse(given, model).collect()}
    assert out[1].n_turns == out[2].n_turns == 0 and out[3].roles == ["user", "assistant"]
    assert out[3].rendered == "<|user|>\na\n<|end|>\n<|assistant|>\nb\n<|end|>"
