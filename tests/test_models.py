"""Feature search, saved and named models, kinds of numbers that users add."""

import hashlib
import os
import threading
import zipfile

import pytest

from lineweave.functions import numbering as N
from lineweave.plans import model, registry

def test_search():
    worth = {"a": 0.1, "b": 0.5, "c": -0.2}
    score = lambda used: sum(worth[n] for n in used)
    told: list[int] = []
    grown = model.search(score, list(worth), "incr-important", 2, done=lambda h: told.append(len(h)))
    assert [h["feature"] for h in grown] == ["b", "a"] and told == [1, 2] and grown[1]["features"] == ["b", "a"]
    assert model.search(score, list(worth), "decr-unimportant")[0]["feature"] == "c"
    assert model.search(score, list(worth), "decr-important")[0]["feature"] == "b"


def test_named_models(spark, tmp_path):
    rows = spark.createDataFrame([(float(k), float(k % 3), k % 2) for k in range(40)], "a double, b double, label int")
    forest = model._forest(rows, ["a", "b"], model.Settings(trees=2, depth=2, bins=8))
    registry.publish(model.Models("text_contract", forest, None, ["a", "b"]), "small-1", str(tmp_path))
    again = registry.load("small-1", str(tmp_path))
    assert (again.extractor, again.pointer, again.used, again.transition.toDebugString) == ("text_contract", None, ["a", "b"], forest.toDebugString)
    for name in ("../x", "", "a/b"):
        with pytest.raises(ValueError, match="no name"):
            registry.publish(again, name, str(tmp_path))


def test_downloaded_once(tmp_path):
    archive = tmp_path / "m.zip"
    with zipfile.ZipFile(archive, "w") as z:
        z.writestr("metadata/part", "x")
    url, cache = archive.as_uri(), str(tmp_path / "cache")
    found = []
    threads = [threading.Thread(target=lambda: found.append(registry.fetched(url, cache))) for _ in range(4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert len(set(found)) == 1 and os.listdir(found[0]) == ["metadata"] and os.listdir(cache) == [os.path.basename(found[0])]
    archive.unlink()
    assert registry.fetched(url, cache) == found[0]
    with zipfile.ZipFile(archive, "w") as z:
        z.writestr("../out", "x")
    for kw, text in (({"sha256": "0"}, "digest"), ({"sha256": hashlib.sha256(archive.read_bytes()).hexdigest()}, "leave")):
        with pytest.raises(ValueError, match=text):
            registry.fetched(url, str(tmp_path / "other"), **kw)
    assert os.listdir(tmp_path / "other") == []


def test_added_kinds(spark):
    lines = spark.createDataFrame([("<7> text",), ("(<8>) text",), ("(a) text",)], "text string")
    N.register(N.Kind("angle", "<([0-9])>", "try_cast({0} AS INT)"))
    try:
        got = [[(c["kind"], c["num"]) for c in r["found"]] for r in lines.withColumn("found", N.candidates("text")).collect()]
        assert got[1] == [("angle", 8)] and ("alph_lower", 1) in got[2]
        with pytest.raises(ValueError, match="angle"):
            N.register(N.Kind("angle", "x", "1"))
    finally:
        N.unregister("angle")
    assert all(c["kind"] != "angle" for r in lines.withColumn("found", N.candidates("text")).collect() for c in r["found"])
