"""Reading repositories: walk, exclusion, language, text and configuration."""

from __future__ import annotations

import subprocess
from dataclasses import dataclass, field, replace
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# File extensions and the languages they stand for.
EXTENSIONS = {
    "py": "python", "ts": "typescript", "tsx": "tsx", "js": "javascript", "jsx": "javascript", "rs": "rust", "go": "go", "java": "java", "c": "c", "h": "c", "cpp": "cpp", "hpp": "cpp",
    "cc": "cpp", "rb": "ruby", "php": "php", "swift": "swift", "kt": "kotlin", "scala": "scala", "zig": "zig", "ex": "elixir", "exs": "elixir", "cs": "csharp",
}
# What a walk leaves out by default; with a leading * ends of paths, else whole parts of paths.
EXCLUDED = (
    "node_modules .git dist build __pycache__ .venv venv .env *.lock *.min.js *.min.css *.map package-lock.json yarn.lock .next .nuxt coverage .pytest_cache .mypy_cache target"
).split()


@dataclass(frozen=True)
class Settings:
    """What an ingestion run takes from its configuration."""

    chunk_size: int = 512
    overlap: int = 64
    exclude: tuple[str, ...] = tuple(EXCLUDED)
    extensions: dict[str, str] = field(default_factory=lambda: dict(EXTENSIONS))
    embedding_dimensions: int = 64
    context_length: int = 8192


def merged(base: dict, over: dict) -> dict:
    """``over`` laid over ``base``, tables merged key by key."""
    out = dict(base)
    for k, v in over.items():
        out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def load_settings(*paths: str | Path) -> Settings:
    """Settings from TOML files, later ones over earlier ones; missing files count as empty."""
    import tomllib

    raw: dict = {}
    for p in map(Path, paths):
        if p.exists():
            raw = merged(raw, tomllib.loads(p.read_text()))
    ingestion, embedding = raw.get("ingestion", {}), raw.get("embedding", {})
    known = {k: ingestion[k] for k in ("chunk_size", "overlap") if k in ingestion}
    out = replace(Settings(), **known)
    if "exclude" in ingestion:
        out = replace(out, exclude=tuple(ingestion["exclude"]))
    if raw.get("languages", {}).get("extensions"):
        out = replace(out, extensions=raw["languages"]["extensions"])
    return replace(out, **{k: embedding[v] for k, v in (("embedding_dimensions", "dimensions"), ("context_length", "context_length")) if v in embedding})


def language_of(path: Column, extensions: dict[str, str] | None = None) -> Column:
    """The language by extension (case matters), null if unknown."""
    name = F.substring_index(path, "/", -1)
    extension = F.when(name.contains("."), F.substring_index(name, ".", -1))
    table = F.create_map(*[F.lit(x) for kv in (extensions or EXTENSIONS).items() for x in kv])
    return F.try_element_at(table, extension)


def excluded(path: Column, patterns: tuple[str, ...] | list[str] = tuple(EXCLUDED)) -> Column:
    """Whether a relative path is left out."""
    ends = [F.endswith(path, F.lit(p[1:])) for p in patterns if p.startswith("*")]
    parts = [F.lit(p) for p in patterns if not p.startswith("*")]
    out = F.arrays_overlap(F.split(path, "/"), F.array(*parts)) if parts else F.lit(False)
    for e in ends:
        out = out | e
    return out


def text_of(content: Column) -> Column:
    """Bytes as UTF-8 text; what is no UTF-8 becomes the replacement character."""
    return F.make_valid_utf8(content.cast("string"))


def line_count(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"))) + 1


def walk(spark: SparkSession, root: str, settings: Settings | None = None) -> DataFrame:
    """(path, language, size_bytes, line_count, hash, content) of the source files under a folder.

    The listing, the exclusion by path and the hashing all run in the cluster; nothing passes through the driver.
    """
    settings = settings or Settings()
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.rstrip("/").split("://")[-1] + "/"
    relative = F.expr(f"substring(path, instr(path, '{base}') + {len(base)})")
    rows = raw.select(relative.alias("path"), F.col("length").alias("size_bytes"), "content")
    rows = rows.withColumn("language", language_of(F.col("path"), settings.extensions)).where(F.col("language").isNotNull() & ~excluded(F.col("path"), settings.exclude))
    text = text_of(F.col("content"))
    return rows.select("path", "language", "size_bytes", line_count(text).cast("int").alias("line_count"), F.sha2("content", 256).alias("hash"), text.alias("content"))


def ignored_by_git(paths: list[str], root: str | None) -> set[str]:
    """The paths that git ignores; none without a repository or where git fails."""
    if not root or not paths:
        return set()
    try:
        run = subprocess.run(["git", "-C", root, "check-ignore", "--stdin", "-z"], input="\0".join(paths), capture_output=True, text=True, timeout=120)
    except (OSError, subprocess.SubprocessError):
        return set()
    return {p for p in run.stdout.split("\0") if p} if run.returncode in (0, 1) else set()


def git_ignored(files: DataFrame, root: str) -> set[str]:
    """Those of a walk's paths that git ignores, where ``root`` is a folder on the driver's disk; none elsewhere.

    Git runs on the driver, so the paths of the one repository, not its texts, pass through it.
    """
    local = root.removeprefix("file://")
    if not Path(local).is_dir():
        return set()
    return ignored_by_git([r["path"] for r in files.select("path").toLocalIterator()], local)


def without_ignored(files: DataFrame, ignored: DataFrame) -> DataFrame:
    """``files`` whose path is not among the ignored ones."""
    return files.join(ignored.select("path").distinct(), "path", "left_anti")
