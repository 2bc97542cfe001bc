"""Manifests, hash trees and frozen packages over folders made here."""

import hashlib

import pytest

from parlance.sources import packages as P


def _write(root, files):
    for name, text in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)


BLOCK = "id: {id}\nname: n\ntier: core\nversion: 1.2.0\ndepends_on: [B]\ninfra: [{infra}]\ncontracts:\n  produces: [x]\nbilling:\n  capacity_unit: seats\n"


@pytest.fixture
def blocks(tmp_path):
    root = tmp_path / "blocks"
    _write(root, {
        "one/block.yaml": BLOCK.format(id="ONE", infra="redis, disk"), "one/src/a.py": "a", "one/src/deep/b.py": "b", "one/src/__pycache__/a.py": "no", "one/tests/t.py": "no", "one/pyproject.toml": "p",
        "two/block.yaml": BLOCK.format(id="TWO", infra="redis"), "two/contracts/c.yaml": "c", "bad/block.yaml": "id: [", "odd/block.yaml": "- x", "poor/block.yaml": "id: P\nname: n\n",
    })
    return root


def _hash(root, names):
    digest = hashlib.sha256()
    for n in names:
        digest.update(n.encode() + b"\0" + hashlib.sha256((root / n).read_bytes()).digest())
    return digest.hexdigest()[:16]


def test_manifests(spark, blocks):
    rows = {r["directory"]: r for r in P.manifests(spark, f"file://{blocks}").collect()}
    assert (rows["one"]["id"], rows["one"]["depends_on"], rows["one"]["produces"], rows["one"]["consumes"], rows["one"]["license_key"], rows["one"]["problem"]) == ("ONE", ["B"], ["x"], [], "ONE", None)
    assert rows["odd"]["problem"] == "no map" and rows["poor"]["problem"] == "lacks tier, version, billing.capacity_unit" and rows["bad"]["problem"].startswith("no YAML")


def test_freeze_from_files(spark, blocks, tmp_path):
    (tmp_path / "values.yaml").write_text("blocks:\n  one: {enabled: true}\n  two: {enabled: true}\n  bad: {enabled: false}\n  odd:\n")
    hashes = P.component_hashes(P.files(spark, f"file://{blocks}"))
    got = {r["component"]: r["hash"] for r in hashes.collect()}
    assert got["one"] == _hash(blocks / "one", ["block.yaml", "pyproject.toml", "src/a.py", "src/deep/b.py"]) and got["two"] == _hash(blocks / "two", ["block.yaml", "contracts/c.yaml"])
    wanted = P.enabled(spark, f"file://{tmp_path}/values.yaml")
    made = P.frozen("p", P.manifests(spark, f"file://{blocks}"), wanted, hashes)
    rows = [(r["id"], r["version"], r["hash"]) for r in sorted(made.collect(), key=lambda r: r["place"])]
    assert [i for i, *_ in rows] == ["ONE", "TWO", "infra:disk", "infra:redis"]
    package = P.package_hash(made).first()
    assert package["components"] == 4 and package["hash"] == hashlib.sha256("".join(f"{a}\0{b}\0{c}\0" for a, b, c in rows).encode()).hexdigest()
    with pytest.raises(Exception, match="no such block: bad"):
        P.frozen("p", P.manifests(spark, f"file://{blocks}"), spark.createDataFrame([("bad",)], "directory string"), hashes).collect()


def test_a_change_names_its_subtree(spark, blocks):
    old = P.hash_tree(P.files(spark, f"file://{blocks}")).collect()
    _write(blocks, {"one/src/deep/b.py": "changed", "one/src/new/c.py": "c", "one/src/new/d.py": "d"})
    (blocks / "two/contracts/c.yaml").unlink()
    schema = "component string, path string, digest string, is_file boolean"
    new, before = P.hash_tree(P.files(spark, f"file://{blocks}")), spark.createDataFrame(old, schema)
    assert {tuple(r) for r in P.tree_changes(before, new).collect()} == {("one", "src/deep/b.py", "changed"), ("one", "src/new", "added"), ("two", "contracts", "removed")}
    same = {(r["component"], r["path"]): r["digest"] for r in old}
    now = {(r["component"], r["path"]): r["digest"] for r in new.collect()}
    assert all(now[("one", p)] != same[("one", p)] for p in ("", "src", "src/deep")) and now[("one", "pyproject.toml")] == same[("one", "pyproject.toml")] and now[("bad", "")] == same[("bad", "")]
    assert P.tree_changes(before, before).count() == 0 and P.hash_tree(P.files(spark, f"file://{blocks}").limit(0)).count() == 0
