from __future__ import annotations

import random

import pytest
from kinvote.llm import stuffing

NOUNS = "river lamp window bridge farmer letter garden doctor market winter engine island teacher forest kitchen".split()
VERBS = "opened repaired watched painted carried visited measured described finished followed".split()
GOODS = "cheap watch band|garden hose|hair tonic|phone strap|loan broker|rubber boots".split("|")
WORDS = "buy best online discount price free order sale".split()
NAV = ["Home", "News", "Contact", "Search", "Help"]


def sentence(r):
    return f"The {r.choice(NOUNS)} near the {r.choice(NOUNS)} was {r.choice(VERBS)} before noon, and {r.randrange(99)} of the {r.choice(NOUNS)}s {r.choice(VERBS)} it again."


def prose(r, lines=8):
    return "\n".join(" ".join(sentence(r) for _ in range(r.randrange(1, 4))) for _ in range(lines))


def stuffing_text(r, kind):
    item = lambda: f"{r.choice(WORDS)} {r.choice(GOODS)}"
    if kind == 0:
        return ", ".join(item() for _ in range(90))
    if kind == 1:
        return "\n".join(f"http://www.{r.choice(NOUNS)}{r.randrange(999)}.example/{r.randrange(9999)}" for _ in range(30))
    if kind == 2:
        return "\n".join(f"#{item().replace(' ', '_')}" for _ in range(40))
    if kind == 3:
        return "\n".join(f"SKU-{r.randrange(99999)} {r.choice(GOODS)} XL" for _ in range(30))
    return ". ".join(" ".join(item() for _ in range(5)).capitalize() for _ in range(15)) + "."


def page(r, body):
    menu = " | ".join(r.sample(NAV, 4)) if r.random() < 0.5 else "\n".join(r.sample(NAV, 4))
    return f"{menu}\nWe use cookies on this site. Accept | Settings\n{' '.join(sentence(r).split()[:8])}\n{body}\n© 2020 Example"


@pytest.fixture(scope="module")
def corpus():
    r, out = random.Random(11), []
    for i in range(900):
        if i % 6 == 0:
            out.append((i, page(r, stuffing_text(r, i // 6 % 5)), True))
        elif i % 6 == 1:  # sentences in a list
            out.append((i, page(r, "\n".join(f"- {sentence(r).rstrip('.')}" for _ in range(10))), False))
        elif i % 24 == 2:
            out.append((i, page(r, prose(r, 6) + "\n" + stuffing_text(r, 0)[:200]), False))
        else:
            out.append((i, page(r, prose(r)), False))
    return out


def test_pages(spark, corpus):
    docs = spark.createDataFrame([(i, t) for i, t, _ in corpus], "doc_id long, text string")
    got = {x["doc_id"] for x in stuffing.stuffed(docs).collect()}
    want = {i for i, _, s in corpus if s}
    assert len(got & want) >= 0.97 * len(want)
    assert len(got - want) <= 0.01 * len(corpus)


def test_labels_and_dirty_rows(spark, corpus):
    model = stuffing.LineModel.fit([t for _, t, _ in corpus])
    r = random.Random(3)
    data = [(1, None, 1), (2, "", 1), (3, " \n\t\n", 1), (4, page(r, prose(r)), 1), (5, page(r, stuffing_text(r, 0)), 1), (5, page(r, stuffing_text(r, 1)), 1), (6, "a-" * 100_000, 1), (7, "a." * 100_000 + "\n" + "'" * 50_000, 1), (8, page(r, prose(r, 3000)), 1)]
    out = stuffing.judged(spark.createDataFrame(data, "doc_id long, text string, Menu_Chars int"), model=model)
    assert [c.lower() for c in out.columns].count("menu_chars") == 1
    rows = out.collect()
    share = {x["doc_id"]: x["stuffed_share"] for x in rows}
    assert len(rows) == len(data)
    assert share[1] == share[2] == share[3] == 0 and share[4] < 0.5 < share[5] and share[8] < 0.5
    assert next(x for x in rows if x["doc_id"] == 4)["menu_chars"] > 0


@pytest.mark.parametrize("line", ["Où est l’été?", "Это старый дом", "größer – ¿más?", "plain"])
def test_misread_lines_are_put_right(line):
    assert stuffing.readable(line) == line
    for charset in ("latin-1", "koi8-r"):
        assert stuffing.readable(line.encode().decode(charset)) == line


def test_empty_table(spark):
    assert stuffing.stuffed(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_likeliest_sequence():
    """Viterbi against all sequences."""
    import itertools

    import numpy as np

    model = stuffing.LineModel.fit(["Home | News\nThis is a sentence that ends well, my friend.\nbuy lamp, buy lamp, buy lamp, buy lamp"] * 5)
    p = stuffing.page("Home | News\nbuy lamp, buy lamp\nThis is a sentence.\nhttp://a.example/1")
    seen = model.scores(p)

    def weight(path):
        return model.start[path[0]] + sum(seen[k, s] for k, s in enumerate(path)) + sum(model.moves[a, b] for a, b in zip(path, path[1:]))

    best = max(weight(x) for x in itertools.product(range(stuffing.K), repeat=len(seen)))
    assert weight(model.label(p)) == pytest.approx(best)
    assert np.isfinite(seen).all()


def test_boilerplate_is_counted_over_all_pages(spark):
    r = random.Random(5)
    pages = [(i, f"Site menu\n{prose(r, 3)}\nThe end" if i % 100 == 0 else prose(r, 3)) for i in range(1000)]
    pages += [(5000, None), (5001, ""), (5002, " \n ")]
    docs = spark.createDataFrame(pages, "doc_id long, text string")
    seen = stuffing.Counter(s for _, t in pages if t for s in stuffing.ends(t))
    want = {s for s, n in seen.items() if n >= stuffing.frequent(1001)}
    assert stuffing.menus(docs) == set(map(stuffing.hashed, want)) and want >= {"site menu", "the end"}
    assert stuffing.menus(docs.limit(0)) == set()


def test_the_fitted_sample_is_bounded_in_characters(spark, monkeypatch):
    r, seen = random.Random(6), []
    docs = spark.createDataFrame([(i, prose(r, 200 if i % 10 == 0 else 2)) for i in range(300)], "doc_id long, text string")
    fit = stuffing.LineModel.fit
    monkeypatch.setattr(stuffing, "FIT_CHARS", 60_000)
    monkeypatch.setattr(stuffing.LineModel, "fit", lambda texts, **how: seen.append(list(texts)) or fit(seen[-1], **how))
    for _ in range(2):
        stuffing.fitted(docs, pages=100)
    assert 0 < sum(map(len, seen[0])) <= 60_000 and len(seen[0]) <= 100
    assert seen[0] == seen[1]


def test_a_page_of_one_line_and_of_many(spark):
    assert stuffing.ends("a b") == {"a b"} and stuffing.ends("") == set() and stuffing.ends("\n \n") == set()
    text = "\n".join(f"line {i}" for i in range(40))
    assert stuffing.ends(text) == {f"line {i}" for i in [*range(14), 39]}


@pytest.mark.parametrize("link", ["[url=http://www.a{0}.example/x{0}]lamp[/url]", "[lamp](https://a{0}.example/x{0})", '<a href="http://a{0}.example/long/way/{0}">lamp</a>', "www.a{0}.example"])
def test_link_markup_is_a_list_of_links(corpus, link):
    model = stuffing.LineModel.fit([t for _, t, _ in corpus])
    r = random.Random(9)
    body = " ".join(link.format(r.randrange(10**9)) for _ in range(60))
    assert model.judge(page(r, body))[1] > 0.5
    assert model.judge(page(r, prose(r, 6) + "\n" + link.format(1)))[1] < 0.5
