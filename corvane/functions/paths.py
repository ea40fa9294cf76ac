"""Column functions on file paths and repository urls."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: suffix to language
LANGUAGES = {
    "py": "python", "js": "javascript", "mjs": "javascript", "ts": "typescript", "tsx": "typescript", "go": "go", "java": "java", "rs": "rust",
    "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "c": "c", "h": "c", "cs": "csharp", "rb": "ruby", "php": "php",
}
# fixed values: languages that a directory scan takes unless told otherwise, and directories it leaves out
SCANNED = ["python", "java", "cpp", "javascript", "typescript"]
EXCLUDED = [
    ".git", ".github", ".gitlab", "node_modules", "__pycache__", ".venv", "venv", "env", ".env", "vendor", "third_party", "build", "dist", "out", "target",
    ".gradle", ".idea", ".vscode", "coverage", ".nyc_output", ".pytest_cache",
]
# fixed values: directory names by role
TEST_DIRS = ["test", "tests", "spec", "fixture", "fixtures", "conftest", "mock", "fake", "stub", "__tests__", "unit_tests", "integration_tests", "testing"]
DOC_DIRS = ["doc", "docs", "documentation", "readme", "changelog", "contributing"]
EXAMPLE_DIRS = ["example", "examples", "sample", "samples", "demo", "tutorial", "tutorials", "cookbook"]
OTHER_DIRS = ["migrations", "benchmark", "benchmarks", "bench", "static"]
# fixed values: layer keywords; a path's rank is the smallest index whose keyword it contains
LAYERS = ["model", "entity", "domain", "repository", "repo", "dao", "service", "usecase", "manager", "controller", "handler", "view", "router", "api", "endpoint"]
REPOSITORY_URL = r"(?i)^(?:https?://(?:github|gitlab|bitbucket)[.](?:com|org)/[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+|git@[A-Za-z0-9_.-]+:[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+)$"


def _dir(names: list[str]) -> str:
    return f"(?i)(?:^|/)(?:{'|'.join(names)})/"


TEST_DIR, DOC_DIR, EXAMPLE_DIR, OTHER_DIR = map(_dir, (TEST_DIRS, DOC_DIRS, EXAMPLE_DIRS, OTHER_DIRS))
TEST_FILE = "(?i)(?:^|/)(?:test_[^/]*|[^/]*(?:test|_spec)[.]py)$"
CONFTEST = "(?:^|/)[^/]*conftest[^/]*$"


def slashes(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def base_name(path: Column) -> Column:
    return F.substring_index(slashes(path), "/", -1)


def suffix(path: Column) -> Column:
    """Lower-cased suffix without its dot; '' without one; a leading dot starts no suffix."""
    return F.lower(F.regexp_extract(base_name(path), "^.+[.]([^.]*)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(base_name(path), "(?<=.)[.][^.]*$", "")


def language(path: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.coalesce(F.element_at(table, suffix(path)), F.lit("unknown"))


def is_allowed(path: Column) -> Column:
    return suffix(path).isin(list(LANGUAGES))


def is_excluded(path: Column) -> Column:
    """Whether a parent directory is in the excluded list or starts with a dot."""
    parents = F.slice(F.split(slashes(path), "/"), 1, F.greatest(F.size(F.split(slashes(path), "/")) - 1, F.lit(0)))
    return F.exists(parents, lambda d: d.isin(EXCLUDED) | (d.startswith(".") & ~d.isin(".", "..")))


def file_role(path: Column) -> Column:
    """test, docs, example or production; tried in that order."""
    p = slashes(path)
    test = p.rlike(TEST_DIR) | p.rlike(TEST_FILE) | p.rlike(CONFTEST)
    return F.when(test, "test").when(p.rlike(DOC_DIR), "docs").when(p.rlike(EXAMPLE_DIR), "example").otherwise("production")


def is_production(path: Column) -> Column:
    return (file_role(path) == "production") & ~slashes(path).rlike(OTHER_DIR)


def layer_rank(path: Column) -> Column:
    """Smallest index of a layer keyword that the lower-cased path contains, or null."""
    low = F.lower(path)
    found = [F.when(F.contains(low, F.lit(k)), i) for i, k in enumerate(LAYERS)]
    return F.coalesce(*found)


def clean_url(url: Column) -> Column:
    return F.regexp_replace(F.trim(url), "/+$", "")


def is_repository_url(url: Column) -> Column:
    return clean_url(url).rlike(REPOSITORY_URL)


def repository_name(url: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(clean_url(url), "([^/:]+)$", 1), "[.]git$", "")
