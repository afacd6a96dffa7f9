"""File sources on small files."""

import io
import json
import zipfile

from pyspark.sql import functions as F

from folioscope.operators import search
from folioscope.sources import files, tables


def archive(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def test_text_files_fall_back_to_latin(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("  héé ".encode())
    (tmp_path / "b.txt").write_bytes("hé".encode("latin-1"))
    (tmp_path / "c.exe").write_bytes(b"x")
    assert sorted(r["text"] for r in files.text_files(spark, str(tmp_path)).collect()) == ["hé", "héé"]


def test_json_lines_skip_what_does_not_parse(spark, tmp_path):
    (tmp_path / "feedback_1.jsonl").write_text(json.dumps({"ts": "2024-01-02", "n": 1}) + "\nnot json\n" + json.dumps({"ts": "2023-01-01", "n": 2}) + "\n")
    got = files.json_lines(spark, f"{tmp_path}/feedback_*.jsonl", "ts string, n long", since="2024-01-01")
    assert [tuple(r) for r in got.collect()] == [("2024-01-02", 1)]
    files.append_json(got, f"{tmp_path}/out")
    files.append_json(got, f"{tmp_path}/out")
    assert files.json_lines(spark, f"{tmp_path}/out", "ts string, n long").count() == 2


def test_csv(spark, tmp_path):
    (tmp_path / "t.csv").write_text("Account Type,Premium\nlife,10\nauto,20\n")
    assert files.csv_table(spark, str(tmp_path / "t.csv")).agg(F.sum("Premium").alias("s")).first()["s"] == 30


def test_office_files(spark, tmp_path):
    w = 'xmlns:w="w"'
    doc = f'<w:d {w}><w:p><w:t>One</w:t></w:p><w:tbl><w:tr><w:tc><w:p><w:t>a</w:t></w:p></w:tc><w:tc><w:p><w:t>b</w:t></w:p></w:tc></w:tr></w:tbl></w:d>'
    (tmp_path / "a.docx").write_bytes(archive({"word/document.xml": doc}))
    (tmp_path / "b.pptx").write_bytes(archive({f"ppt/slides/slide{k}.xml": f'<s xmlns="x"><p><t>S{k}</t></p></s>' for k in (10, 2)}))
    sheet = '<s xmlns="x"><row><c t="s"><v>1</v></c><c><v>5</v></c></row></s>'
    (tmp_path / "c.xlsx").write_bytes(archive({"xl/worksheets/sheet1.xml": sheet, "xl/sharedStrings.xml": '<s xmlns="x"><si><t>x</t></si><si><t>y</t></si></s>'}))
    (tmp_path / "d.docx").write_bytes(b"broken")
    got = {r["path"][-6:]: r["text"] for r in files.office_texts(files.binary_files(spark, str(tmp_path))).collect()}
    assert got == {"a.docx": "One\na | b", "b.pptx": "S2\nS10", "c.xlsx": "y | 5", "d.docx": None}


def test_payload_filter_on_arrays(spark):
    df = tables.literal(spark, [(1, ["a", "b"], "x"), (2, ["c"], "y"), (3, None, None)], "id int, tags array<string>, kind string")
    pick = lambda **w: sorted(r["id"] for r in df.filter(search.payload_filter(dict(df.dtypes), w)).collect())
    assert pick(tags=["a", "c"]) == [1, 2] and pick(kind="x") == [1] and pick(tags_excluded="a") == [2, 3] and pick(kind_excluded=["x", "y"]) == [3]


def test_bm25_on_null_and_empty_texts(spark):
    df = tables.literal(spark, [(1, "a b a"), (2, None), (3, ""), (4, "c")], "doc_id long, text string")
    assert [r["doc_id"] for r in search.bm25(df, ["a", "b"]).collect()] == [1]
    assert search.bm25(df, ["zzz"]).count() == 0
