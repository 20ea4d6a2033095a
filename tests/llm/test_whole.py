"""What earlier versions left out of the text operators' job."""

import random

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.conftest import ODD
from tickloom.llm import html_wrap, langid, licenses, quality

LONG = "words of the article " * 20
CHROME = "<nav>menu <a>one</a></nav>", "<div class='comments'><p>first!</p></div><footer>foot</footer>"


def shown(body: str, attributes: str = "") -> str:
    html = f"<html><body{attributes}>{CHROME[0]}{body}{CHROME[1]}</body></html>"
    return html_wrap.page_text(html, html_wrap.article_paths(html_wrap.stream(html)))


@pytest.mark.parametrize("attributes", [' class="single no-sidebar"', ' class="sidebar"', ' id="search"', ' class="ad widget" role="alert"', ' style="display:none"'])
@pytest.mark.parametrize("body", [f"<article><p>{LONG}</p></article>", f"<div><p>{LONG}</p><p>{LONG}</p></div>"])
def test_the_page_is_not_its_sidebar(attributes, body):
    want = "\n".join([LONG.strip()] * body.count("<p>"))
    assert shown(body, attributes) == want


@pytest.mark.parametrize("mark", ['class="has-sidebar"', 'class="sidebar"', 'id="search"', 'class="social widget"', 'class="sidebar-right"', "hidden"])
def test_an_element_around_the_article_is_not_skipped(mark):
    assert shown(f'<div {mark}><article><p>{LONG}</p></article></div>') == LONG.strip()
    assert shown(f'<div {mark}><div class="related"><main><p>{LONG}</p></main></div></div>') == LONG.strip()
    assert shown(f'<div {mark}><p>{LONG}</p></div>') == LONG.strip()
    assert shown(f'<article><h1>Head</h1><div {mark}><p>{LONG}</p></div></article>') == "Head\n" + LONG.strip()
    assert shown(f'<form><main><p>{LONG}</p></main></form>') == LONG.strip()


def test_names_inside_the_article():
    parts = ['<h2 id="related-work">Related work</h2>', '<section id="search-methods"><p>methods</p></section>', '<h2 id="search">Search</h2>', '<section id="comments"><p>On comments</p></section>', '<p title="hidden costs">costs</p>', '<div aria-hidden="false"><p>seen</p></div>', '<div data-id="ad"><p>data</p></div>', '<div class="no-ad"><p>free</p></div>', '<div style="color:red"><p>red</p></div>']
    gone = ['<div class="comment-list"><p>no</p></div>', '<section class="related-posts"><p>no</p></section>', "<div hidden><p>no</p></div>", '<div class="x ad-300x250"><p>no</p></div>', '<div style="display: none"><p>no</p></div>', '<div role="navigation"><p>no</p></div>', '<div id="share-buttons"><p>no</p></div>']
    assert shown(f"<article><p>{LONG}</p>{''.join(parts)}{''.join(gone)}</article>") == "\n".join([LONG.strip(), "Related work", "methods", "Search", "On comments", "costs", "seen", "data", "free", "red"])


def test_teasers_and_comments_stay_out():
    teasers = f'<div class="related"><article>teaser</article><article>teaser</article></div><div class="comments"><article>{LONG * 9}</article></div>'
    assert shown(f"<article><p>{LONG}</p></article>{teasers}") == LONG.strip()
    assert shown(f"<article><p>{LONG}</p>{teasers.replace('article', 'p')}</article>") == LONG.strip()
    assert shown(f"<div><p>{LONG}</p></div><aside><article>teaser</article></aside>") == LONG.strip()


def test_marked_pages_of_a_host(spark):
    page = lambda i: f"<html><body class='single no-sidebar'>{CHROME[0]}<div id='content' class='search{i % 2}'><article><p>page {i} {LONG}</p></article></div>{CHROME[1]}</body></html>"
    rows = [(i, "http://a.example/x", page(i)) for i in range(50)]
    got = {r["id"]: r["text"] for r in html_wrap.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"page {i} {LONG}".strip() for i in range(50)}


MIT = """Copyright (c) 2020 Someone

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software."""
BSD = """# Redistribution and use in source and binary forms, with or without
# modification, are permitted provided that the following conditions
# are met:
#
# 1. Redistributions of source code must retain the above copyright notice."""
ISC = """ * Permission to use, copy, modify, and/or distribute this software for any
 * purpose with or without fee is hereby granted, provided that the above
 * copyright notice and this permission notice appear in all copies."""


def test_wrapped_licenses(spark, docs):
    mit = "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files".split()
    half = " ".join(mit[10:]) + "\n" + " ".join(mit[:10])  # all words, none of the text
    texts = [MIT, BSD, ISC, "words before\n" * 50 + MIT.replace("\n", "\r\n"), MIT.replace("copy\nof", "copy\n\nof"), half, "one\nword\n" * 500, "\n".join(mit), MIT + "\n\n" + ISC]
    got = {r["id"]: r for r in licenses.scan(docs(list(enumerate(texts)))).collect()}
    assert [got[i]["labels"] for i in range(len(texts))] == ["mit-text", "bsd", "isc", "mit-text", "", "", "", "mit-text", "isc,mit-text"]
    assert [got[i]["score"] for i in (0, 1, 2, 5)] == [1.0, 1.0, 1.0, 0.0]
    assert [b["line"] for b in got[8]["blocks"]] == [2, 8]


def test_windows_of_long_templates(docs):
    text = [f"w{i}" for i in range(3000)]
    long = {"long": " ".join(text)}
    join = licenses.Join(long, {}, 0.8)
    words = [w.encode() for w in ["x"] * 777 + text[:1200] + ["y"] * 100 + text[1300:] + ["z"] * 5000]
    assert abs(join.paragraph(words, set())["long"][0] - 2900 / 3000) < 1e-12
    assert join.paragraph(words[::-1], set()) == {}


def test_quality_of_a_text_does_not_depend_on_its_neighbours():
    rng = random.Random(5)
    texts = ["".join(rng.choice("abcdefgh $#") for _ in range(n)) for n in [0, 1, 89, 90, 91, 95, 96, 97, 191, 192, 193, *(rng.randint(0, 2000) for _ in range(60))]]
    net = quality.Net(4)
    alone = [net.run(quality.Chunks(pa.array([t])))[0][0] for t in texts]
    for order in (list(range(len(texts))), rng.sample(range(len(texts)), len(texts))):
        among = net.run(quality.Chunks(pa.array([texts[i] for i in order])))[0]
        assert np.allclose(among, [alone[i] for i in order], atol=1e-5)


def test_texts_with_letters_stay_where_no_language_was_learned(docs):
    kept = langid.known_language(docs(ODD), langid.learn(docs([(1, "text without a label")])))
    assert kept.columns == docs([]).columns and sorted(r["doc_id"] or -1 for r in kept.collect()) == [-1, 4, 5, 5, 6, 7, 9]
