"""Files in pieces give the rows of files at once."""

import pytest

from symloom.sources import extract

TEXT = (
    "import a.b as ab\nfrom .base import Base as B\nX = '''\ndef no():\nclass No:\n'''\nif X:\n    import late as B\nelse:\n    pass\n"
    "@B\n@ab.c\nclass \u00c4(B):\n    def m(self):\n        self.m()\n        top(B)\n\n    class In:\n        def n(self): ab.x(top)\n"
    "y = (1,\n2)\r\nasync def top():\n    def inner(): top()\n    inner()\n@ab\ndef last(): return f\"{top()}\"\n# end"
)


@pytest.mark.parametrize("size", [1, 7, 40, 100])
def test_pieces(monkeypatch, size):
    whole = extract.extract("src/p.py", TEXT.encode())
    assert len(whole) > 20
    monkeypatch.setattr(extract, "PIECE", size)
    assert len(list(extract.python_rows("src/p.py", TEXT))) > 3
    assert extract.extract("src/p.py", TEXT.encode()) == whole


def test_errors_stand_alone(monkeypatch):
    bad = TEXT + "\ndef broken(:\n    pass\n"
    whole = extract.extract("src/p.py", bad.encode())
    deep = TEXT + "\nz = " + "+".join(["1"] * 900) + "\n"
    deep_whole = extract.extract("src/p.py", deep.encode())
    monkeypatch.setattr(extract, "PIECE", 10)
    assert [r[0] for r in whole] == ["error"] and extract.extract("src/p.py", bad.encode()) == whole
    assert extract.extract("src/p.py", deep.encode()) == deep_whole
    assert extract.extract("src/p.py", b"") == [("node", "src/p.py", "file", (1, 0, 1, 0, 0, 0), None, None)]


def test_rows_leave_by_and_by(spark, monkeypatch):
    """No frame holds a whole large file."""
    text = "".join(f"class C{i}:\n    def m(self): self.m()\n" for i in range(400))
    monkeypatch.setattr(extract, "PIECE", 500)
    parts = [len(rows) for rows in extract.extract_parts("p.py", text.encode())]
    assert max(parts) < 200 and sum(parts) == len(extract.extract("p.py", text.encode())) == 1 + 400 * 5
    assert extract.extracted(spark.createDataFrame([("p.py", bytearray(text.encode()))], "path string, content binary")).count() == 2001
