"""Periodic runs, main text of pages and the prefix trie against plain rules on small tables."""

from __future__ import annotations

import hashlib
import random
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

from tidewire.llm import html_text, periodic_runs, prefix_trie  # noqa: E402


# Periodic runs

def plain_runs(w):
    n, found = len(w), []
    for q in range(1, n // 3 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(24, 3 * q):
                found.append((i, j + q, q))
            i = max(j, i) + 1
    return sorted((s, e - s, q) for s, e, q in found
                  if not any(p < q and a <= s and e <= b for a, b, p in found))


def periodic_words(rng):
    k = rng.choice([1, 2, 2, 3, 5, 50])
    w = [rng.randrange(k) for _ in range(rng.randint(0, 150))]
    for _ in range(rng.randint(0, 3)):
        unit = [rng.randrange(k) for _ in range(rng.randint(1, 30))]
        if rng.random() < 0.3:
            unit = unit[:rng.randint(1, 3)] * rng.randint(5, 14) + unit
        turns = unit * rng.randint(1, 6)
        at = rng.randint(0, len(w))
        w[at:at] = turns[:rng.randint(1, len(turns))]
    return (w * rng.choice([1, 1, 1, 2, 4]))[:700]


def test_runs_of_random_words():
    rng = random.Random(5)
    for _ in range(500):
        w = periodic_words(rng)
        assert periodic_runs.find_runs(np.array(w, np.int64)) == plain_runs(w)


def test_grammar_derives_its_text():
    rng = random.Random(6)
    for _ in range(200):
        w = periodic_words(rng)
        first = max(w, default=0) + 1
        rules, rest = periodic_runs.re_pair(w, first)

        def derive(s):
            return [s] if s < first else derive(rules[s - first][0]) + derive(rules[s - first][1])

        assert sum(map(derive, rest), []) == w
        assert all(c < 3 for c in Counter(p for p in zip(rest, rest[1:]) if p[0] != p[1]).values())


def test_runs_of_fibonacci_words_and_long_repeats():
    a, b = [0], [0, 1]
    while len(b) < 1500:
        a, b = b, b + a
    assert periodic_runs.find_runs(np.array(b, np.int64)) == plain_runs(b)
    assert periodic_runs.find_runs(np.zeros(200_000, np.int64)) == [(0, 200_000, 1)]
    long = list(range(40_000)) * 3
    assert periodic_runs.find_runs(np.array(long, np.int64)) == [(0, 120_000, 40_000)]


def test_collapsed_documents(spark):
    rng = random.Random(7)
    texts = [" ".join(f"w{i}" for i in periodic_words(rng)) for _ in range(120)]
    rows = [(d, t, "a", "b") for d, t in enumerate(texts)]
    rows += [(3, texts[3], "a", "b"), (None, texts[4], "a", "b"), (500, None, "a", "b"), (501, "", "a", "b"),
             (502, " \t\n", "a", "b"), (503, "x\x0by z " * 30, "a", "b"), (None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string, `H` string").repartition(3)
    got = periodic_runs.collapse_runs(docs).collect()
    assert len(got) == len(rows)
    want = Counter()
    for d, t, *_ in rows:
        w = (t or "").encode().split()
        runs = plain_runs(w)
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        want[d, tuple(runs), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()] += 1
    assert Counter((r.doc_id, tuple(map(tuple, r.runs)), r.collapsed) for r in got) == want


def test_planted_periods_and_strongest_run(spark):
    rng = random.Random(8)
    rows = [(d, " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 90)))) for d in range(300)]
    rows += [(None, "a b"), (29, None), (47, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r.doc_id, tuple((r.text or "").split())) for r in periodic_runs.plant_periods(docs).collect())
    want = Counter()
    for d, t in rows:
        w = (t or "").split()
        h, n = zlib.crc32(str(d).encode()), len(w)
        if d is not None and h % 10 == 0 and n:
            a = (h // 10) % n
            p = 1 + (n - a) // (3 + (h // 10) % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        want[d, tuple(w)] += 1
    assert got == want
    runs = spark.createDataFrame([([(5, 30, 10), (2, 60, 20), (2, 9, 3)],), ([],), ([(0, 24, 1), (40, 100, 4)],)],
                                 f"runs {periodic_runs.RUNS}")
    best = [r.b for r in runs.select(periodic_runs.strongest(runs["runs"]).alias("b")).collect()]
    assert [b and tuple(b) for b in best] == [(5, 30, 10), None, (40, 100, 4)]
    assert periodic_runs.collapse_runs(docs.limit(0)).count() == 0


# Main text of pages

BOILERPLATE = {
    "menu": '<nav><ul><li><a href="/a">Alpha</a><li><a href="/b">Beta</a></ul></nav>',
    "header": "<header><h2>The name of the site</h2><p>and a slogan that is rather long for a slogan, is it not</p></header>",
    "sidebar": '<aside><h3>More</h3><p>Words in a sidebar that go on for a while and a while longer.</p></aside>',
    "notice": '<div class="cookie-notice"><p>We use cookies to make this page work, as all pages do these days.</p></div>',
    "advert": '<div class="ad">Buy this thing now, it is a good thing to have, and there is only one left of it.</div>',
    "form": '<form action="/s"><label>Search</label><input name="q"><button>Go</button></form>',
    "script": '<script>if (a < b) { document.write("<p>no</p>"); }</script><style>p > a { color: red }</style>',
    "comment": "<!-- <p>a comment of the markup</p> -->",
    "readers": '<section id="comments"><article class="comment"><p>A reader says that it is all wrong, as readers do.</p>'
               "</article></section>",
    "footer": "<footer>&copy; somebody, with all rights and a very long line of other things in the footer</footer>"}


def page(rng, holder):
    blocks, html = [], []
    for _ in range(rng.randint(1, 12)):
        words = [rng.choice(["word", "a", "of", "é", "&amp;", "&lt;p&gt;", "<i>in</i>", "<a href='x'>link</a>", "x<br>y"])
                 for _ in range(rng.choice([1, 2, 8, 40, 120]))]
        tag = rng.choice(["p", "p", "p", "h2", "blockquote", "li", "pre"])
        end = "" if tag in ("p", "li") and rng.random() < 0.5 else f"</{tag}>"
        html.append(f"<{tag}>{rng.choice([' ', chr(10), '  '])}{rng.choice([' ', chr(9)]).join(words)} {end}")
        blocks.append(" ".join(words).replace("<i>in</i>", "in").replace("<a href='x'>link</a>", "link")
                      .replace("x<br>y", "x y").replace("&lt;", "<").replace("&gt;", ">").replace("&amp;", "&"))
        if rng.random() < 0.2:
            html.append(BOILERPLATE[rng.choice(["script", "comment", "advert", "notice", "form"])])
    around = [BOILERPLATE[k] for k in rng.sample(sorted(BOILERPLATE), rng.randint(0, 6))]
    cut = rng.randint(0, len(around))
    open_, close = holder
    return ("<!DOCTYPE html><html><head><title>No text</title></head><body>" + "".join(around[:cut]) + open_
            + "".join(html) + close + "".join(around[cut:]) + rng.choice(["</body></html>", "", "<div cla"])), "\n".join(blocks)


@pytest.mark.parametrize("holder", [("<article>", "</article>"), ("<main>", "</main>"),
                                    ('<div id="wrap"><article class="post">', "</article></div>")])
def test_articles_come_out_whole(holder):
    rng = random.Random(holder[0])
    for _ in range(150):
        html, text = page(rng, holder)
        assert html_text.main_text(html) == text


def test_pages_without_an_article_element():
    rng = random.Random(3)
    long = " ".join(["some words of a long paragraph"] * 12)
    for _ in range(60):
        around = [BOILERPLATE[k] for k in rng.sample(sorted(BOILERPLATE), 6)]
        body = f"<h1>A heading</h1><p>{long}</p><p>Short.</p><p>{long} <span class='ad'>Buy.</span>again</p>"
        html = f"<html><body>{''.join(around[:3])}<div><div>{body}</div></div>{''.join(around[3:])}</body>"
        assert html_text.main_text(html) == f"A heading\n{long}\nShort.\n{long} again"


def test_odd_pages(spark):
    cases = {
        None: "", "": "", " \n ": "", "<p>": "", "<script>var a = '<p>x</p>'": "", "plain words": "plain words",
        "<article><p>a &amp;amp; b &nbsp; c &#233;&eacute; &unknown; 1 < 2</article>": "a &amp; b c éé &unknown; 1 < 2",
        "<article>one<p>two</p>three<!-- never ended <p>x": "one\ntwo\nthree",
        "<article><p>x</p><![endif]><p>y</p></article>": "x\ny",
        "<article><ul><li><a>a</a><li><a>b</a><li><a>c</a></ul><p>text</p></article>": "text",
        "</div></p><article></b><p>a</i> b</article>": "a b",
        "<article class='comment'><p>a reader</article><article><p>the article itself</article>": "the article itself",
        "<article>" + "<div>" * 3000 + "deep" + "</article>": "deep",
        "<article><p>" + "word " * 200_000 + "</article>": ("word " * 200_000).strip()}
    for html, text in cases.items():
        assert html_text.main_text(html) == text, html and html[:80]
    rows = [(i if i % 3 else None, None if i % 4 else "http://x", html, "t") for i, html in enumerate(cases)] * 2
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, `TEXT_` string").repartition(3)
    got = html_text.extract_text(pages).collect()
    assert Counter(map(tuple, got)) == Counter((i, u, cases[h]) for i, u, h, _ in rows)
    assert html_text.extract_text(pages.limit(0)).count() == 0


# Prefix trie

def plain_trie(rows, shared=True):
    conv = defaultdict(list)
    for c, t, r, x, *_ in rows:
        if c is not None:
            r, x = r or "", x or ""
            conv[c].append((t is not None, t or 0, hashlib.md5(f"{len(r)}:{r}{x}".encode()).hexdigest(), r, x))
    conv = {c: [(r, x) for *_, r, x in sorted(v)] for c, v in conv.items()}
    if shared:
        h = {c: zlib.crc32(str(c).encode()) % 6 for c in conv}
        conv = {c: conv.get(c - c % 100, [])[:h[c]] + v[h[c]:] for c, v in conv.items()}
    members = defaultdict(list)
    for c, v in conv.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
    children, leaves, saved = Counter(k[:-1] for k in members if k), Counter(), Counter()
    for k, m in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += not children[k]
            saved[k[:d]] += (len(m) - 1) * len(k[-1][1]) if k else 0
    return Counter(
        (min(m), len(k), min(members[k[:-1]]) if k else None, len(m), children[k], leaves[k], saved[k],
         hashlib.sha256(",".join(str(c) for c in sorted(m) if len(conv[c]) == len(k)).encode()).hexdigest())
        for k, m in members.items())


CONVERSATIONS = "conv_id long, turn long, role string, text string, a string, depth string"


def conversations(seed):
    rng, rows = random.Random(seed), []
    for c in rng.sample(range(400), 220):
        length = rng.choice([1, 2, 3, 5, 8])
        text = [rng.choice(["hi", "yes", "é" * 5, "", None, f"own {c}", f"turn {rng.randrange(9)}"]) for _ in range(length)]
        for t in range(length):
            turn = rng.choice([t, t, t, t, None, 2])
            rows.append((c, turn, rng.choice(["user", "user", "bot", None]), "hi" if t == 0 and c % 3 else text[t], "x", "y"))
    rows += rows[:20] + [(None, 0, "user", "nobody", "x", "y"), (100_000, 0, "user", "hi", "x", "y")]
    rows += [(7001, t, "user", f"long {t}", "x", "y") for t in range(60)]
    rows += [(7002, t, "user", f"long {t if t < 50 else -t}", "x", "y") for t in range(60)]
    return rows


@pytest.mark.parametrize("cells", [8, 0])
def test_trie(spark, monkeypatch, cells):
    """The second time the sketch is so narrow that it proves next to nothing: the result is the same."""
    if not cells:
        monkeypatch.setattr(prefix_trie, "MOST_CELLS", 64)
    monkeypatch.setattr(prefix_trie, "ID_SLICE", 16)
    monkeypatch.setattr(prefix_trie, "TURN_SLICE", 16)
    rows = conversations(2)
    turns = prefix_trie.ordered_turns(spark.createDataFrame(rows, CONVERSATIONS).repartition(4))
    assert Counter(map(tuple, prefix_trie.trie(prefix_trie.share_first_turns(turns)).collect())) == plain_trie(rows)


def test_trie_as_it_is_and_empty(spark):
    rows = [r for r in conversations(3) if r[0] is None or r[0] < 7000]
    frame = spark.createDataFrame(rows, CONVERSATIONS)
    assert Counter(map(tuple, prefix_trie.conversation_trie(frame).collect())) == plain_trie(rows, shared=False)
    assert prefix_trie.conversation_trie(frame.limit(0)).count() == 0


def test_sketch_proves_only_single_prefixes(spark):
    rng = np.random.default_rng(1)
    values = rng.integers(-2**62, 2**62, 400)
    keys = np.concatenate([values, values[:100], values[:20]])
    rows = spark.createDataFrame([(int(i), 1, int(k), int(k) ^ 5, 0, 0, 0) for i, k in enumerate(keys)],
                                 "conv_id long, depth long, a long, b long, up_a long, up_b long, chars long").repartition(5)
    alone = {r.a for r in prefix_trie.screen(rows).where("alone").collect()}
    assert alone <= set(values[100:].tolist()) and len(alone) > 200
