"""Sinks with nulls, empty and repeated rows, characters to escape, fences and clashing names."""

import json
import xml.etree.ElementTree as ET

from seamfinder.sources import sinks


def rows(spark):
    found = [("a<&>\"'.rs", 1, 2, "if a < b && c[d[0]]> 1 {}\n]]>"), ("b.py", 3, 3, None), (None, None, None, "x"), ("c.zig", 1, 1, ""), ("b.py", 3, 3, None)]
    return spark.createDataFrame(found, "path string, start int, end int, code string").selectExpr("*", "'n' as count", "1 as json", "2 as xml", "3 as plain", "4 as part")


def test_rows(spark):
    df = rows(spark)
    xml = [ET.fromstring(x.xml) for x in sinks.xml_rows(df).collect()]
    assert [(x.find("file").text or "", x.find("lines").text, x.find("code").text or "") for x in xml] == [("a<&>\"'.rs", "1-2", "if a < b && c[d[0]]> 1 {}\n]]>"), ("b.py", "3-3", ""), ("", "-", "x"), ("c.zig", "1-1", ""), ("b.py", "3-3", "")]
    assert [x.markdown for x in sinks.markdown_rows(df).collect()][1:4] == ["## b.py:3-3\n```python\n\n```", "## :-\n```\nx\n```", "## c.zig:1-1\n```\n\n```"]
    assert [x.plain for x in sinks.plain_rows(df).collect()][1:3] == ["File: b.py\nLines: 3-3\n\n", "File: \nLines: -\nx\n"]
    got = [json.loads(x.json) for x in sinks.json_rows(df).collect()]
    assert got[1]["code"] is None and got[1]["count"] == "n" and got[0]["path"] == "a<&>\"'.rs" and len(got) == 5


def test_empty_tables_and_summaries(spark):
    df = rows(spark)
    for f in (sinks.xml_rows, sinks.markdown_rows, sinks.plain_rows, sinks.json_rows, sinks.dry_run):
        assert f(df.limit(0)).count() == 0 and f(df).count() == 5
    assert tuple(sinks.summary(df).first()) == (5, len("if a < b && c[d[0]]> 1 {}\n]]>") + 1, 7 + 4)  # null counts as an empty text does
    assert tuple(sinks.summary(df.limit(0)).first()) == (0, 0, 0)
    assert [json.loads(x.json) for x in sinks.json_document(df.limit(0), system_prompt="be brief").collect()] == [{"summary": {"count": 0, "total_bytes": 0, "total_tokens": 0}, "version": sinks.VERSION, "system_prompt": "be brief"}]
