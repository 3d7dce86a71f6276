"""Archives that are whole, changed, short of a part, or none."""

import io
import json
import zipfile

from draftlens.sources import archives


def test_sound_and_unsound_parts(spark):
    whole = archives.pack({"a.json": b"{}", "b.pdf": b"pdf"})
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(whole)) as book, zipfile.ZipFile(out, "w") as changed:
        changed.writestr("a.json", b"[]")
        changed.writestr("extra", b"")
        changed.writestr(archives.MANIFEST, book.read(archives.MANIFEST))
    rows = archives.read(spark.createDataFrame([("w", whole), ("c", out.getvalue()), ("n", b"none"), (None, None)], "archive string, content binary")).collect()
    got = sorted((r["archive"] or "", r["name"] or "", r["sound"], r["error"] is None) for r in rows)
    assert got == [("", "", False, False), ("c", "a.json", False, True), ("c", "b.pdf", False, True), ("c", "extra", False, True), ("n", "", False, False), ("w", "a.json", True, True), ("w", "b.pdf", True, True)]
    assert [e["bytes"] for e in json.loads(zipfile.ZipFile(io.BytesIO(whole)).read(archives.MANIFEST))["files"]] == [2, 3]
    assert archives.pack({"b.pdf": b"pdf", "a.json": b"{}"}) == whole
