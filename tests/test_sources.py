"""Readers on files of mixed shapes: nothing is lost, what cannot be read says so."""

import json

import pytest

from corpusloom.sources import readers as R


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "a.csv").write_text('id,owner,city\n1,Ann,"Bad ""Ems"""\n2,,Ulm\n')
    (tmp_path / "b.csv").write_text("name,price\npen,3\n")
    (tmp_path / "c.csv").write_text('id,owner,city\n3,"two\nlines",Bonn\n')
    (tmp_path / "lines.json").write_text("\n".join(json.dumps({"z": i, "a": "ü"}) for i in range(10)) + "\n")
    (tmp_path / "array.json").write_text('[\n {"b": 1},\n {"a": [1, 2]}\n]')
    (tmp_path / "bad.json").write_text('{"a": \n')
    (tmp_path / "x.xml").write_text("<rows><row><a>1</a></row><row><a>2</a></row></rows>")
    (tmp_path / "p.html").write_text("<nav>no</nav><script>if (a < b) '</nav>'</script><p>a &amp; b&#233;&#x2019;</p>")
    (tmp_path / "doc.pdf").write_bytes(b"%PDF-1.4")
    (tmp_path / "empty.txt").write_text(" ")
    return str(tmp_path)


def by_name(df, *cols):
    return sorted(tuple(r[c].rsplit("/", 1)[-1] if c == "path" else r[c] for c in cols) for r in df.collect())


def test_csv_keeps_every_header(spark, folder):
    assert by_name(R.scan_csv_as_text(spark, folder), "path", "row_no", "text") == [
        ("a.csv", 0, 'id: 1 | owner: Ann | city: Bad "Ems"'),
        ("a.csv", 1, "id: 2 | owner:  | city: Ulm"),
        ("b.csv", 0, "name: pen | price: 3"),
        ("c.csv", 0, "id: 3 | owner: two\nlines | city: Bonn"),
    ]


def test_json_lines_and_documents(spark, folder):
    got = [(r["path"].rsplit("/", 1)[-1], r["text"]) for r in R.scan_json_as_text(spark, folder).collect()]
    assert [t for p, t in got if p == "array.json"] == [json.dumps([{"b": 1}, {"a": [1, 2]}], indent=2)]
    assert sorted(t for p, t in got if p == "lines.json") == sorted(json.dumps({"z": i, "a": "ü"}, indent=2, ensure_ascii=False) for i in range(10))
    assert [t for p, t in got if p == "bad.json"] == [None]


def test_dispatch_loses_no_file(spark, folder):
    got = [(r["path"].rsplit("/", 1)[-1], r["text"], r["error"]) for r in R.loader_dispatch(spark, folder).collect()]
    assert {p for p, *_ in got} == {"a.csv", "b.csv", "c.csv", "lines.json", "array.json", "bad.json", "x.xml", "p.html", "doc.pdf", "empty.txt"}
    errors = {p: e for p, _, e in got if e}
    assert errors == {"doc.pdf": "no loader for pdf", "bad.json": "no text extracted", "empty.txt": "no text extracted"}
    assert [t for p, t, _ in got if p == "p.html"] == ["a & bé’"]
    assert sum(p == "lines.json" for p, *_ in got) == 10 and sum(p == "x.xml" for p, *_ in got) == 2
