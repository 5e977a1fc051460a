"""Refresh by content: what is profiled again, and what only reordered lines leave alone."""

import json

from tabquest.plans import refresh
from tabquest.sources.manifest import read_manifest
from tabquest.sources.metadata import read_written_metadata


def test_only_new_and_changed_datasets_are_profiled(spark, tmp_path, monkeypatch):
    files = {n: tmp_path / f"{n}.csv" for n in ("a", "b", "c")}
    for n, f in files.items():
        f.write_text(f"id,{n}\n1,x\n2,y\n")
    manifest_file = tmp_path / "manifest.json"

    def listed(names):
        manifest_file.write_text(json.dumps([{"file_path": str(files[n]), "metadata_path": f"{n}.json", "dataset_name": n} for n in names]))
        return read_manifest(spark, str(manifest_file))

    profiled = []
    known = refresh.refresh_metadata

    def noted(spark, manifest, *rest):
        profiled.append(sorted(r["metadata_path"] for r in manifest.collect()))
        return known(spark, manifest, *rest)

    monkeypatch.setattr(refresh, "refresh_metadata", noted)

    def run(names):
        plan = refresh.refresh_changed(spark, listed(names), str(tmp_path / "metadata"), str(tmp_path / "digests"))
        return {r["file_path"].split("/")[-1][0]: r["status"] for r in plan.collect()}

    assert run("ab") == {"a": "new", "b": "new"}
    assert run("ab") == {"a": "unchanged", "b": "unchanged"}
    files["a"].write_text("id,a\n1,x\n2,y\n2,y\n")  # a repeated line
    files["b"].write_text("id,b\n2,y\n1,x\n")  # another order
    assert run("abc") == {"a": "changed", "b": "unchanged", "c": "new"}
    assert run("ac") == {"a": "unchanged", "b": "removed", "c": "unchanged"}
    assert run("ac") == {"a": "unchanged", "c": "unchanged"}
    assert run("abc") == {"a": "unchanged", "b": "new", "c": "unchanged"}
    assert profiled == [["a.json", "b.json"], [], ["a.json", "c.json"], [], [], ["b.json"]]
    rows = {r["metadata_path"]: r["num_rows"] for r in read_written_metadata(spark, str(tmp_path / "metadata")).collect()}
    assert rows == {"a.json": 3, "b.json": 2, "c.json": 2}


def test_digests_of_odd_files(spark, tmp_path):
    texts = {"empty": "", "blank": "\n", "one": "x\n", "same": "x", "two": "x\nx\n", "other": "y\n"}
    paths = {n: str(tmp_path / n) for n in texts}
    for n, t in texts.items():
        (tmp_path / n).write_text(t)
    found = {r["file_path"]: (r["n_lines"], r["digest"]) for r in refresh.dataset_digests(spark, paths.values()).collect()}
    digest = {n: found[p] for n, p in paths.items()}
    assert digest["empty"] == (0, "") and digest["blank"][0] == 1 and digest["one"] == digest["same"]
    assert len(set(digest.values())) == 5
    assert refresh.dataset_digests(spark, []).count() == 0
