"""A repository from folder to index and back out through the tools."""

import pytest
from pyspark.sql import functions as F

from codelode.api import CodeIndex, UnknownRepository, register_sql, to_markdown
from codelode.operators.enrichment import Offline
from codelode.pipeline import StoredIndex, ingest, synthesize

FILES = {
    "src/core/queue.py": "import util\n\nclass Queue:\n    \"\"\"Holds rows.\"\"\"\n    def push(self, row):\n        return normalise(row)\n\n    def _drop(self):\n        pass\n",
    "src/core/util.py": "def normalise(row):\n    return Queue() if row else None\n",
    "src/app/main.ts": "import { normalise } from './util';\nexport function run(x: number): void {\n  normalise(x);\n}\n",
    "src/app/Shop.swift": "import UIKit\nclass ShopCoordinator {\n  let store: UserStore\n  func go() {\n    store.load()\n  }\n}\nclass UserStore {\n  func load() { }\n}\n",
    "src/app/other.go": "package app\n\nfunc Other() {\n}\n",
    "dist/skip.js": "x()\n", "readme.txt": "nothing\n",
}


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("pipeline")
    for p, t in FILES.items():
        (base / "shop" / p).parent.mkdir(parents=True, exist_ok=True)
        (base / "shop" / p).write_text(t)
    first = ingest(spark, str(base / "shop"), f"file://{base}/index")
    return base, first


def test_first_run(spark, built):
    base, first = built
    assert first["indexed"] == 5 and first["skipped"] == 0 and first["deleted"] == 0
    ix = StoredIndex(spark, f"file://{base}/index")
    files = {r.path: r for r in ix.files().collect()}
    assert set(files) == {p for p in FILES if p.startswith("src/")} and len({r.id for r in files.values()}) == 5
    assert all(len(r.embedding) == 64 for r in files.values())
    symbols = {r.name: r for r in ix.symbols().collect()}
    assert {"Queue", "push", "_drop", "normalise", "run", "ShopCoordinator", "UserStore", "Other"} <= set(symbols)
    assert symbols["push"].parent_id == symbols["Queue"].id and not symbols["push"].is_primary_declaration and symbols["_drop"].visibility == "protected"
    deps = {(r.kind, r.external_module, r.target_symbol_id) for r in ix.dependencies().collect()}
    assert ("import", "util", None) in deps and ("type_reference", None, symbols["UserStore"].id) in deps and ("service_usage", None, symbols["UserStore"].id) in deps
    refs = {(r.target_name, r.reference_kind) for r in ix.references().collect()}
    assert ("normalise", "call") in refs and ("load", "member_call") in refs
    assert [(r.status, r.files_processed) for r in ix.runs().collect()] == [("completed", 5)]


def test_tools(spark, built):
    base, _ = built
    tools = CodeIndex(spark, f"file://{base}/index", stored=True)
    assert [tuple(r)[:2] for r in tools.list_repositories().collect()] == [("shop", 5)]
    assert tools.find_symbol("shop", "queue").first().name == "Queue" and tools.exact_symbol_search("shop", "normalise").first().name == "normalise"
    assert {r.target_paths for r in tools.find_references("shop", "normalise").collect()} == {"src/core/util.py"}
    vector = Offline().embed(["normalise row"])[0]
    assert tools.semantic_search("shop", "normalise row", vector).first().repo == "shop"
    assert tools.semantic_search("shop", "normalise row").collect() == tools.semantic_search("shop", "normalise row", vector).collect()
    assert tools.trace_dependencies("shop", "queue.py").count() > 0 and tools.trace_dependencies("shop", "queue.py", summary=True).count() > 0
    assert tools.find_dependency_cycles("shop").first().cycle == "src/core/queue.py > src/core/util.py"
    metrics, pairs = tools.analyze_coupling("shop", "src/core")
    assert metrics.first().ca >= 1 and pairs.count() >= 1
    assert {r.name for r in tools.extract_module_interface("shop", "src/core").collect()} == {"normalise"}
    assert tools.find_modularization_seams("shop", "src/core")["plan"].first().difficulty == "LOW"
    assert tools.get_file_map("shop").count() == 5 and tools.get_intent("shop", "queue").count() >= 1 and tools.get_index_size("shop").first().file_count == 5
    assert set(tools.codebase_stats("shop")) == {"summary", "languages", "intents", "kinds"}
    nodes, edges = tools.repository_graph("shop")
    assert nodes.agg(F.sum("degree")).first()[0] == 2 * edges.agg(F.sum("weight")).first()[0]
    with pytest.raises(UnknownRepository):
        tools.find_symbol("nowhere", "x")
    assert "| repo |" in to_markdown(tools.list_repositories())


def test_table_functions(spark, built):
    base, _ = built
    register_sql(spark, f"file://{base}/index", stored=True)
    assert [r.name for r in spark.sql("SELECT * FROM find_symbol('queue')").collect()] == ["Queue"]
    vector = ", ".join(f"{x}D" for x in Offline().embed(["normalise row"])[0])
    assert spark.sql(f"SELECT * FROM search_code(array({vector}), similarity_threshold => 0.1D) ORDER BY similarity DESC LIMIT 3").count() == 3
    assert spark.sql("SELECT * FROM direct_dependencies('queue.py')").first().target_path_out == "util"


def test_second_run_touches_only_what_changed(spark, built):
    base, _ = built
    root = f"file://{base}/index"
    before = {r.path: r.id for r in StoredIndex(spark, root).files().collect()}
    (base / "shop/src/core/util.py").write_text("def normalise(row):\n    return None\n\ndef extra():\n    pass\n")
    (base / "shop/src/app/other.go").unlink()
    (base / "shop/src/app/new.rs").write_text("fn fresh() {}\n")
    out = ingest(spark, str(base / "shop"), root, classify=False)
    assert (out["indexed"], out["skipped"], out["deleted"]) == (2, 3, 1)
    ix = StoredIndex(spark, root)
    after = {r.path: r.id for r in ix.files().collect()}
    assert after["src/core/util.py"] == before["src/core/util.py"] and "src/app/other.go" not in after and after["src/app/new.rs"] not in before.values()
    names = [r.name for r in ix.symbols().collect()]
    assert "extra" in names and "fresh" in names and "Other" not in names and names.count("normalise") == 1 and "Queue" in names
    ids = [r.id for r in ix.raw("symbols").select("id").collect()]
    assert len(ids) == len(set(ids))
    again = ingest(spark, str(base / "shop"), root)
    assert (again["indexed"], again["skipped"]) == (0, 5)
    assert ingest(spark, str(base / "shop"), root, force=True, classify=False)["indexed"] == 5
    assert ix.runs().where("status = 'completed'").count() == 4


def test_edges_to_reindexed_symbols_are_resolved_again(spark, tmp_path):
    import subprocess

    for p, t in {"a.swift": "class ShopCoordinator {\n  let store: UserStore\n}\n", "b.swift": "class UserStore {\n  func load() { }\n}\n", "c.swift": "class Ignored { }\n", ".gitignore": "c.swift\n"}.items():
        (tmp_path / "repo").mkdir(exist_ok=True)
        (tmp_path / "repo" / p).write_text(t)
    subprocess.run(["git", "init", "-q", str(tmp_path / "repo")], check=True)
    root = f"file://{tmp_path}/index"
    assert ingest(spark, str(tmp_path / "repo"), root, classify=False)["indexed"] == 2  # git ignores one
    (tmp_path / "repo" / "b.swift").write_text("// moved down\nclass UserStore {\n  func load() { }\n}\n")
    assert ingest(spark, str(tmp_path / "repo"), root, classify=False)["indexed"] == 1
    ix = StoredIndex(spark, root)
    ids = {r.name: r.id for r in ix.symbols().collect()}
    edges = ix.dependencies().where("kind = 'type_reference'").collect()
    assert [e.target_symbol_id for e in edges] == [ids["UserStore"]] and edges[0].source_symbol_id in ids.values()


def test_edges_to_names_that_are_gone_become_external(spark):
    from codelode.pipeline import SCHEMAS, _relinked

    deps = spark.createDataFrame([(1, 1, 2, 10, 20, "injection", None, None), (2, 2, 2, 20, 20, "injection", None, None), (3, 1, 3, 10, 30, "injection", None, None), (4, 1, None, None, None, "import", "x", None)], SCHEMAS["dependencies"])
    old = spark.createDataFrame([(10, 1, "A", "class"), (20, 2, "B", "class"), (30, 3, "C", "class")], "id long, file_id long, name string, kind string")
    files = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    found = _relinked(deps, old, spark.createDataFrame([(2,)], "file_id long"), files, _symbol_rows(spark, [(10, 1, "A"), (30, 3, "C")])).collect()
    assert [(r.id, r.target_symbol_id, r.target_file_id, r.external_module) for r in found] == [(1, None, None, "B")]
    found = _relinked(deps, old, spark.createDataFrame([(2,)], "file_id long"), files, _symbol_rows(spark, [(10, 1, "A"), (99, 2, "b"), (30, 3, "C")])).collect()
    assert [(r.id, r.target_symbol_id, r.target_file_id, r.external_module) for r in found] == [(1, 99, 2, None)]


def _symbol_rows(spark, rows):
    from codelode.pipeline import SCHEMAS, _shaped

    return _shaped(spark.createDataFrame([(*r, "class", True) for r in rows], "id long, file_id long, name string, kind string, is_primary_declaration boolean"), "symbols")


def test_synthesis_and_deletion(spark, built):
    base, _ = built
    root = f"file://{base}/index"
    assert synthesize(spark, root, "directory", 2) == 2
    assert synthesize(spark, root, "all", 2) >= 2
    tools = CodeIndex(spark, root, stored=True)
    assert {r.module_path for r in tools.get_module_map("shop", kind="directory").collect()} == {"src/core", "src/app"}
    with pytest.raises(ValueError):
        tools.delete_index("shop")
    assert tools.delete_index("shop", confirm=True) == 5
    assert StoredIndex(spark, root).raw("symbols").count() == 0 and StoredIndex(spark, root).raw("module_intents").count() >= 2
