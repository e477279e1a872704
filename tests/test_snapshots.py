"""Index and registry in one snapshot: a failure between any two steps leaves the old state readable."""

import pytest
from quillspark.sources import sinks, snapshots
from quillspark.sources.snapshots import Conflict, Store
from quillspark.streaming import ingest

SCHEMA = "doc_id string, chunk_id string, text string"


def chunks(spark, docs, text):
    return spark.createDataFrame([(d, f"{d}-{k}", text) for d in docs for k in range(2)], SCHEMA)


def content(store, table="index", schema=SCHEMA):
    return sorted(map(tuple, store.read(table, schema).collect()))


def test_versions(spark, tmp_path):
    path = str(tmp_path / "s")
    store = Store(spark, path)
    assert store.version == 0 and content(store) == []
    with pytest.raises(ValueError, match="no index"):
        store.read("index")
    sinks.write_index(chunks(spark, ["a", "b"], "old"), path)
    reader = Store(spark, path)
    before = content(reader)
    sinks.write_index(chunks(spark, ["b", "c"], "new"), path, spark.createDataFrame([("a",)], "doc_id string"))
    assert content(reader) == before and len(before) == 4  # a reader stays on its version
    assert {(r[0], r[2]) for r in content(reader.moved())} == {("b", "new"), ("c", "new")} and reader.version == 2
    with pytest.raises(Conflict):
        stale = Store(spark, path)
        sinks.write_index(chunks(spark, ["d"], "other"), path)
        stale.commit({"index": {}})
    assert Store(spark, path).version == 3 and not [p for p in (tmp_path / "s" / "manifests").iterdir() if p.name.startswith("_")]


def test_vacuum(spark, tmp_path):
    path = str(tmp_path / "s")
    for k in range(4):
        sinks.write_index(chunks(spark, ["a", f"d{k}"], str(k)), path)
    store = Store(spark, path)
    left = store.written(chunks(spark, ["lost"], "by a failed writer"))
    now = content(store)
    assert store.vacuum(keep=2) and content(Store(spark, path)) == now
    assert (tmp_path / "s" / left["all"]).exists()  # it may be a writer at work
    assert left["all"] in store.vacuum(keep=1, abandoned=0) and content(Store(spark, path)) == now
    assert len(list((tmp_path / "s" / "manifests").glob("*.json"))) == 1


class Broken(RuntimeError):
    pass


@pytest.mark.parametrize("step", ["written", "registry", "count", "manifest", "rename"])
def test_a_failed_import_changes_nothing(spark, tmp_path, monkeypatch, step):
    root, path = tmp_path / "in", str(tmp_path / "home")
    root.mkdir()
    (root / "a.md").write_text("# One\n\nfirst text\n")
    (root / "b.md").write_text("# Two\n\nsecond text\n")
    ingest.import_folder(spark, str(root), path)
    state = lambda: (sorted(map(str, ingest.known_documents(spark, path).collect())), sorted(map(str, ingest.chunks_of(spark, path).collect())))
    before = state()
    (root / "a.md").write_text("# One\n\nanother text\n")
    if step in ("written", "registry"):
        written, calls = Store.written, []

        def failing(self, rows, part=None):
            calls.append(part)
            if step == "registry" and len(calls) == 1:
                return written(self, rows, part)
            if step == "written":
                written(self, rows, part)
            raise Broken

        monkeypatch.setattr(Store, "written", failing)
    elif step == "count":
        monkeypatch.setattr(Store, "written", lambda self, rows, part=None: {})
    elif step == "manifest":
        monkeypatch.setattr(snapshots.json, "dumps", lambda *a, **k: (_ for _ in ()).throw(Broken()))
    else:
        versions, manifests = Store._versions, tmp_path / "home" / "manifests"

        def unnamed(self):
            if any(p.name.startswith("_") for p in manifests.iterdir()):  # the manifest is written but not yet renamed
                raise Broken
            return versions(self)

        monkeypatch.setattr(Store, "_versions", unnamed)
    with pytest.raises((Broken, ValueError)):
        ingest.import_folder(spark, str(root), path)
    monkeypatch.undo()
    assert state() == before
    ingest.import_folder(spark, str(root), path)
    after = state()
    assert after != before and any("another" in r for r in after[1]) and len(after[0]) == 2
