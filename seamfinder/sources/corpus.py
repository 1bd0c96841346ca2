"""Files, documents and lines as tables; predicates on paths."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import listing

#: Larger files and longer lines aren't searched (bytes).
FILE_BYTES, LINE_BYTES, SHOWN_BYTES = 1 << 20, 2000, 500
# Names that are never searched, and those that are not when tests are left out.
IGNORED = (
    "node_modules", "vendor", "target", "dist", "build", ".git", ".svn", ".hg", ".idea", ".vscode", "__pycache__", "*.pyc", "*.pyo", "*.class", "*.o", "*.obj", "*.a", "*.lib", "*.so", "*.dylib", "*.dll", "*.exe", "*.out", "*.app",
    "*.jar", "*.war", "*.ear", "*.zip", "*.tar.gz", "*.rar", "*.log", "*.tmp", "*.temp", "*.swp", "*.swo", "*.bak", "*.orig", "*.DS_Store", "Thumbs.db", "*.yml", "*.yaml", "*.json", "*.tconf", "*.conf", "go.sum",
)
TEST_FILES = (
    "*_test.rs", "*_tests.rs", "test_*.rs", "tests.rs", "*.spec.js", "*.test.js", "*.spec.ts", "*.test.ts", "*.spec.jsx", "*.test.jsx", "*.spec.tsx", "*.test.tsx", "test_*.py", "*_test.go", "test_*.c", "*_test.c", "*_test.cpp",
    "*_test.cc", "*_test.cxx", "*Test.java", "*_test.rb", "test_*.rb", "*_spec.rb", "*Test.php", "test_*.php",
)
TEST_FOLDERS = ("tests", "test", "__tests__", "__test__", "spec", "specs")
#: Extensions of each language, and other names of it.
LANGUAGES = {"rust": ("rs",), "javascript": ("js", "jsx"), "typescript": ("ts", "tsx"), "python": ("py",), "go": ("go",), "c": ("c", "h"), "cpp": ("cc", "cpp", "cxx", "hpp", "hxx"), "java": ("java",), "ruby": ("rb",), "php": ("php",), "swift": ("swift",), "csharp": ("cs",)}
TEST_PATH = r"(?i)(^|/)(tests?|__tests__|specs?)/|(^|/)test_[^/]*$|_(test|spec)\.[^./]+$|\.(test|spec)\.[^./]+$"


def extensions(language: str) -> tuple[str, ...]:
    """By name or by one of its extensions (rs, py, ...)."""
    low = language.lower()
    return LANGUAGES.get(low) or next((x for x in LANGUAGES.values() if low in x), ())


def is_test(path: Column) -> Column:
    return path.rlike(TEST_PATH)


def _globs(globs) -> str:
    return "|".join("[^/]*".join(re.escape(p) for p in g.split("*")) for g in globs)


def ignored(path: Column, globs=IGNORED, more=(), tests: bool = True) -> Column:
    """A part of the path matches a glob; more are globs beside the usual ones. tests=False: names and folders of tests are ignored too."""
    out = path.rlike(f"(^|/)({_globs((*globs, *more))})(/|$)")
    return out if tests else out | path.rlike(f"(^|/)({_globs(TEST_FILES)})(/|$)|(^|/)({_globs(TEST_FOLDERS)})/")


def files(spark: SparkSession, root: str, globs=IGNORED, tests: bool = True, language: str | None = None, more=(), gitignore: bool = True, depth: int | None = None) -> DataFrame:
    """(path, ext, size, content) below a folder, of any file system that pyarrow opens.

    Folders are listed by Spark jobs, a level at a time (listing), and files are
    read by the tasks that hold them. Rules of .gitignore files hold unless
    switched off, more are globs beside the usual ones, and files over
    FILE_BYTES, hidden ones and those that aren't regular are left out. An
    empty folder gives an empty table.
    """
    globs = (*globs, *more, *(() if tests else (*TEST_FILES, *TEST_FOLDERS)))
    found = listing.listed(spark, root, globs, depth, gitignore).where(~F.col("is_dir") & (F.col("size") <= FILE_BYTES))
    found = found.select("path", F.regexp_extract("path", r"\.([^./]+)$", 1).alias("ext"), "size")
    if language:
        found = found.where(F.col("ext").isin(*extensions(language)))
    return listing.contents(found, root).where("content is not null")


def documents_as_files(docs: DataFrame) -> DataFrame:
    """(path, ext, size, content) of the table of documents; null texts are empty files, and a null source or language is a folder named ``-``."""
    part = lambda c: F.coalesce(F.col(c), F.lit("-"))
    path = F.concat(part("source"), F.lit("/"), part("lang"), F.lit("/doc_"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit(".txt"))
    text = F.coalesce("text", F.lit(""))
    return docs.select(path.alias("path"), F.lit("txt").alias("ext"), F.octet_length(text).alias("size"), text.alias("content"), "doc_id").where(F.col("size") <= FILE_BYTES)


def lines(files: DataFrame, *keep: str) -> DataFrame:
    """One row a line: path, line_no from 1, line."""
    return files.select(*(keep or ("path",)), F.posexplode(F.split("content", "\n")).alias("pos", "line")).withColumn("line_no", F.col("pos") + 1).drop("pos")


def shown(line: Column) -> Column:
    """Lines over 500 bytes are blanked in blocks."""
    return F.when(F.octet_length(line) > SHOWN_BYTES, "").otherwise(line)


def node_type(line: Column) -> Column:
    """What a line outside all blocks seems to be, by how it begins."""
    t = F.lower(F.trim(line))
    begins = lambda *xs: t.rlike("^(" + "|".join(xs) + ")")
    return F.when(begins("//", "/\\*", "\\*", "#", "--"), "comment").when(begins("(pub |async |static )*(fn|func|function|def) "), "function").when(begins("(pub )?(class|struct|enum|trait|interface|impl) "), "class") \
        .when(begins("(import|use|from|include|require) "), "import").when(begins("(let|const|var) "), "variable_declaration").when(begins("(if|for|while|switch|match|else|return)\\b"), "control_flow").otherwise("code")
