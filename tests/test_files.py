"""The scan of a folder tree."""

import hashlib

from loomline.sources import files


def test_scan(spark, tmp_path):
    for name, text in {"b10.txt": "x", "a2.md": "yy", "empty.txt": "", "~$t.txt": "z", "c.bin": "q", "deep/Vendor/v.txt": "v", "deep/e.TXT": "e", "noext": "n"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    rows = files.scan(spark, f"file:{tmp_path}", ["txt", ".md"], ["vendor"], with_digest=True).orderBy(*files.natural_order()).collect()
    assert [(r.path.rsplit("/", 1)[1], r["size"]) for r in rows] == [("e.TXT", 1), ("a2.md", 2), ("b10.txt", 1)]
    assert rows[1].sha256 == hashlib.sha256(b"yy").hexdigest()
    plan = files.scan(spark, f"file:{tmp_path}", ["txt"])._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema:")[1]
