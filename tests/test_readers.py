"""Readable text of pages, and metadata that may be shown."""

import json

from pyspark.sql import functions as F

from siftline.operators import records
from siftline.sources import readers

PAGES = [
    ("<html><head><title> A &amp; B\n page </title></head><body><p>one</p>two<br>three</body></html>", "A & B page", "one\ntwo\nthree"),
    ("<svg>a<svg>b</svg>c</svg>d<noscript>e</noscript>f", "host.org", "d f"),
    ("x</svg></noscript>y<svg>z", "host.org", "x y"),
    ("&#8212;&#x2014;&eacute;&nope;&amp;lt;&#0;&#xD800;&#x110000; &apos;&copy;&nbsp;&Omega;&", "host.org", "——é&nope;&lt;��� '© Ω&"),
    ("<script>if (a<b) document.write('<p>no</p>')</script>yes<style>p>a{}</style><!-- <p>no -->!", "host.org", "yes !"),
    ("<div title='a > b'>shown</div>1 < 2<script>never closed <p>x</p>", "host.org", "shown\n1 < 2"),
    ("", "host.org", ""), (None, "host.org", ""), ("<p>\n\n</p>  <li> &nbsp; </li>", "host.org", ""),
    ("w " * 40_000 + "<b>end</b>", "host.org", ("w " * 40_000 + "end").strip()),
]


def test_page_text(spark):
    pages = spark.createDataFrame([(i, "https://host.org/x?y", html) for i, (html, *_) in enumerate(PAGES)], "page_id long, url string, html string")
    got = {r.page_id: (r.title, r.text, r.file_name) for r in readers.extract_page_text(pages).collect()}
    for i, (_, title, text) in enumerate(PAGES):
        assert got[i][:2] == (title, text), i
    assert got[0][2] == "A-B-page.url.txt" and got[1][2] == "host.org.url.txt" and readers.extract_page_text(pages.limit(0)).count() == 0


def test_private_keys_go_at_any_depth(spark):
    given = {"source_path": "/private/upload.pdf", "heading_path": ["Architecture"], "nested": {"object_key": "ab", "bbox": [1, 2, 3, 4]}, "l": [[{"Local_Path": 1, "ü": None}], "file_path"]}
    rows = spark.createDataFrame([(1, json.dumps(given)), (2, None), (3, "{broken"), (4, "[]"), (5, "[" * 100_000)], "id long, j string")
    got = {r.id: r.k for r in rows.select("id", records.public_json(F.col("j")).alias("k")).collect()}
    assert json.loads(got[1]) == {"heading_path": ["Architecture"], "nested": {"bbox": [1, 2, 3, 4]}, "l": [[{"ü": None}], "file_path"]}
    assert got[2] is None and got[3] is None and got[4] == "[]" and got[5] is None
