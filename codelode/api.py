"""The tools of the index as methods, each returning a DataFrame; and the same searches as SQL table functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelode.functions.columns import under
from codelode.operators import catalogue, edges, refactoring, search, tracing
from codelode.operators.enrichment import Offline, embed_query
from codelode.operators.maintenance import delete_repository
from codelode.pipeline import StoredIndex
from codelode.sources.tables import Index


class UnknownRepository(KeyError):
    """No file of that repository is stored."""


class CodeIndex:
    """The tools over an index: Parquet tables under ``root``, or a versioned index with ``stored=True``."""

    def __init__(self, spark: SparkSession, root: str, stored: bool = False):
        self.spark, self.ix = spark, StoredIndex(spark, root) if stored else Index(spark, root)

    def _known(self, repo: str) -> None:
        if not catalogue.repository_exists(self.ix, repo):
            raise UnknownRepository(repo)

    def _of(self, repo: str, df: DataFrame) -> DataFrame:
        self._known(repo)
        return df.where(F.col("repo") == repo)

    def list_repositories(self) -> DataFrame:
        return catalogue.list_repositories(self.ix).orderBy("repo")

    def semantic_search(self, repo: str, query: str, vector: list[float] | None = None, limit: int = 10, threshold: float = 0.3, provider: Callable[[], object] = Offline, **filters: str) -> DataFrame:
        """Chunks by meaning and words; without a ``vector`` the provider makes one of the question."""
        self._known(repo)
        vector = embed_query(query, provider) if vector is None else vector
        return search.semantic_search(self.ix, query, vector, limit, threshold, repo=repo, **filters).orderBy("place")

    def find_symbol(self, repo: str, name: str, kind: str | None = None, file: str | None = None) -> DataFrame:
        self._known(repo)
        return search.find_symbol(self.ix, name, kind, file, repo).orderBy("place")

    def exact_symbol_search(self, repo: str, name: str, kind: str | None = None, file: str | None = None) -> DataFrame:
        self._known(repo)
        return search.exact_symbol(self.ix, name, kind, file, repo).orderBy("place")

    def find_references(self, repo: str, name: str, file: str | None = None, limit: int = 25) -> DataFrame:
        self._known(repo)
        return search.find_references(self.ix, name, file, repo, limit).orderBy("source_path", "line_no")

    def trace_dependencies(self, repo: str, path: str, direction: str = "both", max_depth: int = 3, summary: bool = False) -> DataFrame:
        self._known(repo)
        rows = tracing.trace_dependencies(self.ix, path, direction, max_depth, repo=repo)
        return tracing.trace_summary(rows, path).orderBy(F.desc("edges")) if summary else rows.orderBy("depth", "source_path", "target_path_out")

    def get_file_map(self, repo: str, path_prefix: str = "") -> DataFrame:
        return self._of(repo, catalogue.file_map(self.ix, path_prefix)).orderBy("path")

    def get_intent(self, repo: str, path: str) -> DataFrame:
        self._known(repo)
        return catalogue.get_intent(self.ix, path, repo).orderBy("chunk_index")

    def codebase_stats(self, repo: str) -> dict[str, DataFrame]:
        self._known(repo)
        own = lambda df: df.where(F.col("repo") == repo)
        parts = {k: own(catalogue.histogram(self.ix, k)).orderBy(F.desc("n"), "label") for k in ("languages", "intents", "kinds")}
        return {"summary": own(catalogue.list_repositories(self.ix))} | parts

    def analyze_coupling(self, repo: str, path_prefix: str, top_n: int = 20) -> tuple[DataFrame, DataFrame]:
        """(metrics, the heaviest edges)."""
        self._known(repo)
        own = lambda df: df.where(F.col("repo") == repo)
        return own(refactoring.coupling_metrics(self.ix, path_prefix)), own(refactoring.analyze_coupling(self.ix, path_prefix)).orderBy(F.desc("edge_count"), "internal_path", "external_path", "kind").limit(top_n)

    def extract_module_interface(self, repo: str, path_prefix: str, include_unused: bool = False) -> DataFrame:
        return self._of(repo, refactoring.module_interface(self.ix, path_prefix, include_unused)).orderBy(F.desc_nulls_last("total_refs"), "kind", "name")

    def find_dependency_cycles(self, repo: str, path_prefix: str = "", max_cycle_length: int = 6) -> DataFrame:
        self._known(repo)
        own = tracing.cycle_edges(self.ix, path_prefix).where(F.col("repo") == repo)
        return tracing.find_cycles(own, max_cycle_length).orderBy("length", "cycle")

    def find_modularization_seams(self, repo: str, path_prefix: str) -> dict[str, DataFrame]:
        self._known(repo)
        parts = {"plan": refactoring.seam_plan, "interfaces": refactoring.seam_interfaces, "dependencies": refactoring.seam_dependencies, "seams": refactoring.seam_edges}
        return {k: f(self.ix, path_prefix).where(F.col("repo") == repo) for k, f in parts.items()}

    def get_index_size(self, repo: str, dimensions: int = 64) -> DataFrame:
        return self._of(repo, catalogue.index_size(self.ix, dimensions))

    def get_module_map(self, repo: str, path_prefix: str = "", kind: str = "all") -> DataFrame:
        if isinstance(self.ix, StoredIndex):
            rows = self.ix.raw("module_intents").where(under(F.col("module_path"), path_prefix))
        else:
            rows = catalogue.module_map(self.ix, path_prefix=path_prefix)
        return self._of(repo, rows if kind == "all" else rows.where(F.col("kind") == kind)).orderBy("kind", "module_path")

    def repository_graph(self, repo: str, limit: int = 300) -> tuple[DataFrame, DataFrame]:
        """(nodes, edges)."""
        own = self._of(repo, edges.repository_graph(self.ix, limit))
        return edges.graph_nodes(own).orderBy(F.desc("degree"), "node"), own.orderBy("place")

    def delete_index(self, repo: str, confirm: bool = False) -> int:
        """Remove a repository from a versioned index; how many files went."""
        if not isinstance(self.ix, StoredIndex):
            raise TypeError("only a versioned index can be changed")
        self._known(repo)
        from codelode.operators.maintenance import cascade

        kept, n = delete_repository(self.ix.files(), repo, confirm)
        names = ("code_chunks", "symbols", "symbol_references", "dependencies")
        self.ix.snapshots.commit({"files": kept} | cascade({t: self.ix.raw(t) for t in names}, kept))
        return n


FUNCTIONS = {
    "find_symbol": """
CREATE OR REPLACE TEMPORARY FUNCTION find_symbol(search_name STRING, search_kind STRING DEFAULT NULL, search_file STRING DEFAULT NULL)
RETURNS TABLE (symbol_id BIGINT, name STRING, qualified_name STRING, kind STRING, signature STRING, docstring STRING, file_path STRING, start_line INT, end_line INT, is_exported BOOLEAN)
RETURN SELECT s.id, s.name, s.qualified_name, s.kind, s.signature, s.docstring, f.path, s.start_line, s.end_line, s.is_exported FROM index_symbols s JOIN index_files f ON s.file_id = f.id
WHERE s.name ILIKE concat('%', find_symbol.search_name, '%') AND (find_symbol.search_kind IS NULL OR s.kind = find_symbol.search_kind) AND (find_symbol.search_file IS NULL OR f.path LIKE concat('%', find_symbol.search_file, '%'))""",
    "search_code": """
CREATE OR REPLACE TEMPORARY FUNCTION search_code(query_embedding ARRAY<DOUBLE>, filter_intent STRING DEFAULT NULL, filter_language STRING DEFAULT NULL, filter_path STRING DEFAULT NULL, filter_symbol STRING DEFAULT NULL, similarity_threshold DOUBLE DEFAULT 0.3D, filter_repo STRING DEFAULT NULL)
RETURNS TABLE (chunk_id BIGINT, file_path STRING, language STRING, content STRING, symbol_name STRING, symbol_type STRING, intent STRING, intent_detail STRING, start_line INT, end_line INT, similarity DOUBLE)
RETURN SELECT * FROM (SELECT c.id, f.path, f.language, c.content, c.symbol_name, c.symbol_type, c.intent, c.intent_detail, c.start_line, c.end_line,
  try_divide(aggregate(zip_with(cast(c.embedding AS ARRAY<DOUBLE>), search_code.query_embedding, (x, y) -> x * y), 0D, (a, x) -> a + x),
    nullif(sqrt(aggregate(c.embedding, 0D, (a, x) -> a + x * x)) * sqrt(aggregate(search_code.query_embedding, 0D, (a, x) -> a + x * x)), 0D)) AS similarity
  FROM index_chunks c JOIN index_files f ON c.file_id = f.id WHERE size(c.embedding) = size(search_code.query_embedding) AND (search_code.filter_intent IS NULL OR c.intent = search_code.filter_intent)
  AND (search_code.filter_language IS NULL OR f.language = search_code.filter_language) AND (search_code.filter_path IS NULL OR f.path LIKE concat(search_code.filter_path, '%'))
  AND (search_code.filter_symbol IS NULL OR c.symbol_type = search_code.filter_symbol) AND (search_code.filter_repo IS NULL OR f.repo = search_code.filter_repo)) WHERE similarity > search_code.similarity_threshold AND NOT isnan(similarity)""",
    "direct_dependencies": """
CREATE OR REPLACE TEMPORARY FUNCTION direct_dependencies(target_path STRING, direction STRING DEFAULT 'both')
RETURNS TABLE (source_path STRING, target_path_out STRING, dep_kind STRING, external_module STRING)
RETURN SELECT DISTINCT sf.path, coalesce(tf.path, d.external_module), d.kind, d.external_module FROM index_dependencies d JOIN index_files sf ON d.source_file_id = sf.id LEFT JOIN index_files tf ON d.target_file_id = tf.id
WHERE (direct_dependencies.direction IN ('outbound', 'both') AND sf.path LIKE concat('%', direct_dependencies.target_path, '%')) OR (direct_dependencies.direction IN ('inbound', 'both') AND tf.path LIKE concat('%', direct_dependencies.target_path, '%'))""",
}


def register_sql(spark: SparkSession, root: str, stored: bool = False) -> None:
    """Views ``index_files``, ``index_chunks``, ... and table functions over them, for SQL users. Rows come unordered: add ORDER BY and LIMIT."""
    ix = StoredIndex(spark, root) if stored else Index(spark, root)
    for name, df in {"files": ix.files(), "chunks": ix.chunks(), "symbols": ix.symbols(), "references": ix.references(), "dependencies": ix.dependencies(), "runs": ix.runs()}.items():
        df.createOrReplaceTempView(f"index_{name}")
    for text in FUNCTIONS.values():
        spark.sql(text)


def to_markdown(df: DataFrame, limit: int = 50) -> str:
    """A report's first rows as a Markdown table."""
    rows = df.limit(limit).collect()
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(map(cell, r)) + " |" for r in rows])
