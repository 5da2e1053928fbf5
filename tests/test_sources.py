"""Character references against Python's own, the choice among extractions, failures kept to their rows."""

import html
import json
import random
from html.entities import html5

import pytest
from pyspark.sql import functions as F

from siltstone.functions.entities import unescape
from siltstone.operators import answer, chunk
from siltstone.sources import ingest


def test_references_as_python_reads_them(spark):
    rng = random.Random(1)
    bits = ["&", "#", "x", "X", ";", " ", "<", "amp", "lt", "gt;", "&#x1EC7;", "&eacute;", "&notit;", "&not", "&ampfoo", "1", "41", "&#150;", "&#x80;", "&#0;", "&#xD800;", "&#x110000;", "&#99999999999;", "&#xFFFE;", "&#x1F600;", "&#13;", "&#8;", "&#11;", "&#127;", "&#x00041;", "\n", "&&amp;;", "&quot", "é", "&amp;lt;"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 12))) for _ in range(1500)] + [f"&{n}" for n in html5] + [f"&{n}x;" for n in list(html5)[::9]] + ["", "&", "&;"]
    rows = spark.createDataFrame([(t,) for t in [*texts, None]], "t string").select("t", unescape(F.col("t")).alias("u")).collect()
    assert [r["u"] for r in rows] == [html.unescape(t) for t in texts] + [None]


def test_longest_extraction_wins(spark):
    rows = [(1, "a", 1, ["one", " two "]), (1, "b", 2, ["one two three four five six seven eight"]), (2, "a", 1, ["same"]), (2, "b", 2, ["same"]), (3, "a", 1, None), (3, "b", 2, []), (4, "b", 2, ["x", None, "", "y&amp;z"])]
    df = spark.createDataFrame(rows, "page_id long, method string, priority int, texts array<string>")
    got = {r["page_id"]: r for r in ingest.best_extraction(df).collect()}
    assert [(got[i]["method"], got[i]["text"]) for i in (1, 2, 3)] == [("b", "## Page 1\n\none two three four five six seven eight"), ("a", "## Page 1\n\nsame"), ("a", "")]
    assert got[4]["text"] == "## Page 1\n\nx\n\n## Page 4\n\ny&z" and [(p["page"], p["chars"]) for p in got[4]["page_stats"]] == [(1, 1), (2, 0), (3, 0), (4, 3)]
    assert [(a["method"], a["pages"], a["chars"]) for a in got[1]["attempts"]] == [("a", 2, 30), ("b", 1, 50)]
    assert ingest.best_extraction(df.limit(0)).collect() == []


def test_a_broken_file_is_one_row(spark, tmp_path):
    good = {"url": "u", "title": "t", "date_crawled": "2024-01-01", "content_markdown": "c"}
    for name, text in (("a", json.dumps(good)), ("b", '{"url": "u", "title": '), ("c", json.dumps({"title": "no url"})), ("d", "")):
        (tmp_path / f"{name}.json").write_text(text)
    rows = ingest.load_news_checked(spark, str(tmp_path))
    fine, broken = ingest.good_and_bad(rows)
    assert [r["title"] for r in fine.collect()] == ["t"] and "error" not in fine.columns
    causes = {r["path"][-6:]: r["error"] for r in broken.collect()}
    assert causes["b.json"].startswith("not JSON: {") and causes["c.json"] == "missing url" and set(causes) <= {"b.json", "c.json", "d.json"}


def test_a_failing_row_doesnt_stop_the_others(spark):
    def split(text, size, overlap):
        if "bad" in text:
            raise ValueError("can't be split")
        return [text]

    docs = spark.createDataFrame([(1, "fine"), (2, "bad"), (3, None), (4, "good")], "doc_id long, text string")
    out = chunk.chunk_large(docs, errors=True, split=split)
    fine, broken = ingest.good_and_bad(out)
    assert sorted((r["doc_id"], r["content"]) for r in fine.collect()) == [(1, "fine"), (3, ""), (4, "good")]
    assert [(r["doc_id"], r["error"], r["content"]) for r in broken.collect()] == [(2, "ValueError: can't be split", None)]
    with pytest.raises(Exception, match="can't be split"):
        chunk.chunk_large(docs, split=split).collect()
    pages = spark.createDataFrame([(1, "<body>hello</body>"), (2, None)], "page_id long, html string")
    assert [(r["page_id"], r["region"].strip(), r["error"]) for r in ingest.longest_region(pages, errors=True).orderBy("page_id").collect()] == [(1, "hello", None), (2, "", None)]


def test_deltas_of_configs(spark):
    rows = [("a", 1, 1.0), ("a", 2, 0.5), ("b", 1, 0.25), ("b", 2, 0.0), ("b", 3, 0.5), ("b", 4, 0.1), ("c", 1, 9.0)]
    names = ["faithfulness", "relevance", "recall", "precision", "average"]
    df = spark.createDataFrame(rows, "config string, query_id long, v double").select("config", "query_id", *(F.col("v").alias(n) for n in names))
    got = {r["metric"]: (r["a"], r["b"], r["delta"]) for r in answer.compare(df, "a", "b").collect()}
    assert got == dict.fromkeys(names, (0.75, 0.2125, 0.5375))
    assert {(r["a"], r["none"], r["delta"]) for r in answer.compare(df, "a", "none").collect()} == {(0.75, None, None)}
    assert [r["query_id"] for r in answer.worst_of(df, "b").collect()] == [2, 4, 1]
