"""Parsing of open heads and embedded elements, and features of whole blocks and paths."""

import numpy as np
from tallyloom.llm import htmltext


def texts(page):
    return [b[0] for b in htmltext.blocks(page)]


def test_a_head_without_an_end():
    assert texts("<html><head><title>t</title><meta charset=u><body><p>one</p></body>") == ["one"]
    assert texts("<head><title>t</title><style>p{}</style><p>one<p>two") == ["one", "two"]
    assert texts("<head><script>if(a<b){}</script></head><div>one</div>") == ["one"]


def test_embedded_elements():
    assert texts("<p>so <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math> holds</p>") == ["so x=2 holds"]
    assert texts("<p>see <object data=a>the chart</object> here <svg><text>no</text></svg></p>") == ["see the chart here"]


def test_features_read_whole_blocks_and_paths():
    path = [f"div.w{chr(97 + k % 26)}" for k in range(40)]
    words = [f"w{k}" for k in range(500)]
    a = htmltext.inputs([(" ".join(words), path, 0, 2000)])
    assert len(a[1][0]) == 500 and len(a[0][0]) == 41
    b = htmltext.inputs([(" ".join([*words[:-1], "other"]), ["nav", *path], 0, 2000)])
    assert a[1][0] != b[1][0] and a[0][0] != b[0][0]


def test_a_very_long_page_and_an_empty_one():
    page = "<article>" + "<p>Some words of a story, told at length.</p>" * 3000 + "</article>"
    model = htmltext.Labeller()
    model.p["bias"] = np.array([50.0])
    assert htmltext.extract([page, "", None], model) == ["\n\n".join(["Some words of a story, told at length."] * 3000), "", ""]


def test_an_empty_table(spark):
    out = htmltext.extract_text(spark.createDataFrame([], "page_id long, url string, html string"), model=htmltext.Labeller())
    assert out.count() == 0 and out.columns == ["page_id", "url", "text", "n_chars"]
