"""Places in files that free text names: paths with lines, ranges, columns or symbols, and globs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import corpus

# Names that stand before a point in code, those that stand after one, and extensions.
CODE_PREFIXES = "local locals var each self this super parent config data resource output input params args props state context".split()
PROPERTIES = "length size count value key name type id index push pop shift map filter reduce forEach toString valueOf nodes".split()
EXTENSIONS = "tf js ts rs go py rb php java cs cpp c h hpp".split()


def plausible(path: Column) -> Column:
    """Whether what looks like a path isn't rather a piece of code, as ``self.value`` is."""
    parts = F.split(path, r"\.", -1)
    last = F.element_at(parts, -1)
    code = last.isin(*PROPERTIES) & (F.element_at(parts, 1).isin(*CODE_PREFIXES) | ~last.isin(*EXTENSIONS))
    short = path.rlike(r"^[A-Za-z]\.[A-Za-z]$") & ~last.isin(*EXTENSIONS)  # as e.g is
    return path.contains("/") | path.contains("\\") | (F.size(parts) != 2) | ~(code | short)


#: What a text is cut into before it is looked through: places on the net, what is in quotes or code marks on a line, quotes alone, and the rest.
_CUT = r"((?i:\b[a-z][a-z0-9+.\-]*://[^\s<>\"'`)\]]*)|`[^`\n]*`|\"[^\"\n]*\"|[`\"]|(?:(?!(?i:\b[a-z][a-z0-9+.\-]*://))[^`\"])+)"
_WORDY = r"[A-Za-z0-9_\-./\\*{},?]"
#: A path with an extension, and what may follow it: a symbol, a range, a line (and a column).
_PATH = rf"(?:^|(?<=[\s()\[\]{{}}<>:;,!?|=]))((?:[A-Za-z]:[\\/])?{_WORDY}*[A-Za-z0-9_*}}]\.[A-Za-z0-9]{{1,10}}\b(?![\\/\w]|\.[A-Za-z0-9])(?:#[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)*|:\d+-\d+|:\d+(?::\d+)?)?)"


def plain_text(text: Column) -> Column:
    """A text without emphasis, strike-outs, quotes and code marks, each character of them a space, so that places stay as they are.

    Stars are emphasis unless they are in quotes or code marks, where they may
    be a glob's; an apostrophe in a word stays, and places on the net go.
    """
    cut = F.regexp_extract_all(text, F.lit(_CUT), F.lit(1))

    def one(x: Column) -> Column:
        inner = F.concat(F.lit(" "), F.substr(x, F.lit(2), F.length(x) - 2), F.lit(" "))
        bare = F.regexp_replace(F.translate(x, "*", " "), "~~", "  ")
        bare = F.regexp_replace(bare, r"(?<![\p{L}\p{N}])'|'(?![\p{L}\p{N}])", " ")
        quoted = x.rlike(r"(?s)^([`\"]).*\1$") & (F.length(x) > 1)
        return F.when(x.rlike(r"(?i)^[a-z][a-z0-9+.\-]*://"), F.repeat(F.lit(" "), F.length(x))).when(quoted, inner).when(x.isin("`", '"'), " ").otherwise(bare)

    return F.array_join(F.transform(cut, one), "")


def targets(texts: DataFrame, text: str = "text", *keep: str, tests: bool = True, ignored: bool = True) -> DataFrame:
    """(*keep, target, path, start, end, symbol): places named in free text, as path, path:line, path:line:column, path:from-to or path#symbol.

    Marks around a place, places on the net and what looks like code (plausible)
    aren't part of it. A place that is named again is there once, and a path
    alone isn't there if the text names a place in it. A line has itself as
    end; globs stay globs (expanded). tests, ignored: whether files of tests
    and names that are never searched (corpus) count. Null texts name nothing;
    columns that are read later are given by ``keep``.
    """
    found = F.array_distinct(F.regexp_extract_all(plain_text(F.col(text)), F.lit(_PATH), F.lit(1)))
    whole = F.filter(found, lambda t: ~F.exists(found, lambda o: o.startswith(F.concat(t, F.lit(":"))) | o.startswith(F.concat(t, F.lit("#")))))
    rows = texts.select(*keep, F.explode(whole).alias("target"))
    part = lambda p, i: F.nullif(F.regexp_extract("target", p, i), F.lit(""))
    path = F.regexp_extract("target", r"^((?:[A-Za-z]:(?=[\\/]))?[^:#]+)", 1)
    line = part(r"[^\\]:(\d+)(?::\d+)?$", 1)
    rows = rows.select(*keep, "target", path.alias("path"), F.coalesce(part(r":(\d+)-\d+$", 1), line).cast("int").alias("start"), F.coalesce(part(r":\d+-(\d+)$", 1), line).cast("int").alias("end"), part(r"#(.+)$", 1).alias("symbol"))
    rows = rows.where(plausible(F.col("path")))
    rows = rows if ignored else rows.where(~corpus.ignored(F.col("path")))
    return rows if tests else rows.where(~corpus.is_test(F.col("path")))


def is_glob(path: Column) -> Column:
    return path.rlike(r"[*?]|\{[^}]*,[^}]*\}")


def glob_pattern(glob: Column) -> Column:
    """A regular expression for a glob: ``*`` and ``?`` stay within a folder, ``**`` doesn't, ``{a,b}`` is one or the other."""
    out = F.regexp_replace(glob, r"([.+^$|()\[\]\\])", r"\\$1")
    out = F.regexp_replace(F.regexp_replace(out, r"\*\*/", "\u0001"), r"\*\*", "\u0002")
    out = F.regexp_replace(F.regexp_replace(out, r"\*", "[^/]*"), r"\?", "[^/]")
    out = F.regexp_replace(F.regexp_replace(out, r"\{", "(?:"), r"\}", ")")
    out = F.when(glob.contains("{"), F.regexp_replace(out, ",", "|")).otherwise(out)
    return F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace(out, "\u0001", "(?:.*/)?"), "\u0002", ".*"), F.lit("$"))


def expanded(found: DataFrame, paths: DataFrame) -> DataFrame:
    """found with each glob in ``path`` replaced by the paths (path) that it matches; others stay, whether they are there or not.

    A glob meets the paths below its folders without wildcards only: paths are
    joined by each of the folders they are in. A glob that matches nothing goes.
    """
    own = paths.select(F.regexp_replace("path", r"^(\./)+", "").alias("file")).distinct()
    names = F.slice(F.split("file", "/"), 1, F.size(F.split("file", "/")) - 1)
    folders = F.transform(F.sequence(F.lit(0), F.size(names)), lambda n: F.array_join(F.slice(names, 1, n), "/"))
    below = own.select("file", F.explode(folders).alias("below"))
    globs = found.where(is_glob(F.col("path"))).withColumn("glob", F.regexp_replace("path", r"^(\./)+", ""))
    globs = globs.withColumn("fixed", F.regexp_replace(F.regexp_extract("glob", r"^((?:[^*?{/]+/)*)", 1), "/$", ""))
    met = globs.join(below, F.col("fixed") == F.col("below")).where(F.rlike("file", glob_pattern(F.col("glob"))))
    return found.where(~F.coalesce(is_glob(F.col("path")), F.lit(False))).unionByName(met.withColumn("path", F.col("file")).select(found.columns))
