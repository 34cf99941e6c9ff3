"""The corpus: normalised tables of a source tree or of any table of texts, and the queries over them."""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions.text import etag, line_count
from lodestar.functions.tokens import estimate
from lodestar.operators import changes, lookup, occurrences, outline, rollup, search, trace, views
from lodestar.session import ship_code
from lodestar.sources import bigfile
from lodestar.sources.decode import MEMORY_LIMIT, decoded
from lodestar.sources.files import read_files
from lodestar.sources.languages import detect

HEAD = 8 << 10


class Corpus:
    """Lazy tables over texts.

    ``sources`` has one row a text: path, content, etag, bytes, n_lines, lang and flags.  ``lines``, ``symbols`` and
    ``occurrences`` follow from it.  ``materialize`` writes them once, so that queries start from tables.
    """

    def __init__(self, files: DataFrame, sources: DataFrame, symbols: DataFrame | None = None, occurrences: DataFrame | None = None, large: DataFrame | None = None):
        ship_code(sources.sparkSession)
        self.large = large
        self.files, self.sources = files, sources
        self._symbols, self._occurrences = symbols, occurrences

    @classmethod
    def from_path(cls, spark: SparkSession, *roots: str, globs: list[str] | None = None) -> Corpus:
        """A corpus of the files below some directories; a path that two roots share is taken from the first."""
        roots = tuple(dict.fromkeys(roots))
        names, read = (cls._first(read_files(spark, *roots, globs=globs, content=c, max_bytes=MEMORY_LIMIT), roots) for c in (False, True))
        texts = decoded(read.where(~F.col("is_symlink") & (F.col("size") <= MEMORY_LIMIT)))
        sources, large = cls._described(texts), None
        files = names.drop("raw")
        # the names of files too large for a row; their lines are read in blocks
        big = files.where(~F.col("is_symlink") & (F.col("size") > MEMORY_LIMIT)).select("root", "path", "size").collect()
        if big:
            urls = {Path(r.root, r.path).as_uri(): r for r in big}
            no, none = F.lit(False), F.lit(None)
            named = spark.createDataFrame([(u.replace("file:///", "file:/"), r.path, r["size"]) for u, r in urls.items()], "file string, path string, bytes long")
            rows = named.select("path", none.cast("string").alias("content"), "bytes", none.cast("int").alias("n_lines"), detect(F.col("path"), F.lit("")).alias("lang"), *[no.alias(c) for c in ("binary", "bom", "utf16", "crlf", "lossy")])
            sources = sources.unionByName(rows)
            plain = ["file:" + re.sub(r"([\[\]{}*?\\])", r"\\\1", str(Path(r.root, r.path))) for r in big]  # no globs
            lines = bigfile.numbered(spark, plain).withColumn("file", F.regexp_replace("file", "^file:/+", "file:/"))
            large = lines.join(F.broadcast(named), "file").select("path", F.col("line").cast("int").alias("line"), "text")
        return cls(files, sources, large=large)

    @staticmethod
    def _first(files: DataFrame, roots: tuple[str, ...]) -> DataFrame:
        """Each path once, from the first root that has it."""
        if len(roots) == 1:
            return files
        order = F.element_at(F.create_map(*[x for i, r in enumerate(roots) for x in (F.lit(r), F.lit(i))]), F.col("root"))
        return files.withColumn("_at", order).groupBy("path").agg(F.min_by(F.struct(*[c for c in files.columns if c != "path"]), "_at").alias("f")).select("path", "f.*")

    @classmethod
    def from_table(cls, df: DataFrame, path: str, text: str) -> Corpus:
        """A corpus of a table's texts under the paths of a column; null texts are left out."""
        t = df.where(F.col(text).isNotNull()).select(F.col(path).cast("string").alias("path"), F.col(text).alias("content"))
        no = F.lit(False)
        t = t.select("path", "content", no.alias("binary"), no.alias("bom"), no.alias("utf16"), F.contains("content", F.lit("\r\n")).alias("crlf"), no.alias("lossy"))
        sources = cls._described(t)
        files = sources.select("path", (F.size(F.split("path", "/")) - 1).alias("depth"), F.col("bytes").alias("size"), F.lit(False).alias("is_symlink"), F.lit(None).cast("string").alias("link_target"))
        return cls(files, sources)

    @staticmethod
    def _described(texts: DataFrame) -> DataFrame:
        c = F.col("content")
        return texts.select(
            "path",
            "content",
            F.octet_length(c).cast("long").alias("bytes"),
            line_count(c).alias("n_lines"),
            detect(F.col("path"), F.left(c, F.lit(HEAD))).alias("lang"),
            "binary",
            "bom",
            "utf16",
            "crlf",
            "lossy",
        )

    @property
    def symbols(self) -> DataFrame:
        if self._symbols is None:
            self._symbols = outline.extract(self.sources)
        return self._symbols

    @property
    def occurrences(self) -> DataFrame:
        if self._occurrences is None:
            self._occurrences = occurrences.extract(self.sources)
        return self._occurrences

    def lines(self) -> DataFrame:
        own = search.explode_lines(self.sources.where(F.col("content").isNotNull()))
        return own if self.large is None else own.unionByName(self.large)

    def etags(self) -> DataFrame:
        """(path, etag)."""
        return self.sources.where(F.col("content").isNotNull()).select("path", etag("content").alias("etag"))

    def estimates(self, scale: float = 1.0) -> DataFrame:
        """(path, est_tokens)."""
        return self.sources.where(F.col("content").isNotNull()).select("path", estimate(F.col("content"), scale).alias("est_tokens"))

    def materialize(self, path: str) -> Corpus:
        """Write files, sources, symbols and occurrences as Parquet and go on from there."""
        spark = self.sources.sparkSession
        for name, df in (("files", self.files), ("sources", self.sources), ("symbols", self.symbols), ("occurrences", self.occurrences)):
            df.write.mode("overwrite").parquet(f"{path}/{name}")
        if self.large is not None:
            self.large.write.mode("overwrite").parquet(f"{path}/large")
        large = None if self.large is None else spark.read.parquet(f"{path}/large")
        return Corpus(*[spark.read.parquet(f"{path}/{n}") for n in ("files", "sources", "symbols", "occurrences")], large=large)

    def refresh(self, path: str, now: Corpus) -> Corpus:
        """The tables written at ``path`` brought up to ``now``: unchanged texts keep their rows, others are read anew."""
        spark = self.sources.sparkSession
        old = spark.read.parquet(f"{path}/sources").select("path", "content")
        same = now.sources.select("path", "content").join(old, ["path", "content"], "left_semi").select("path")
        fresh = Corpus(now.files, now.sources.join(same, "path", "left_anti"))
        keep = lambda n: spark.read.parquet(f"{path}/{n}").join(same, "path", "left_semi")
        return Corpus(now.files, now.sources, keep("symbols").unionByName(fresh.symbols), keep("occurrences").unionByName(fresh.occurrences), now.large)

    def search(self, pattern: str, output: str = "matches", context: int = 0, **options) -> DataFrame:
        """Matching lines (``matches``), hits by enclosing symbol (``symbols``) or counts by file (``files``)."""
        found = search.hits(self.sources, pattern, large=self.large, **options)
        if output == "files":
            return search.files(found)
        if output == "symbols":
            return search.symbol_records(found, self.symbols)
        return search.context(found, self.lines(), context) if context else search.match_records(found, self.symbols)

    def find(self, name: str) -> DataFrame:
        """Definitions of a name, best first."""
        return lookup.ranked(lookup.named(self.symbols, name), (lookup.name_parts(name) or [name])[-1])

    def map(self, budget: int = rollup.MAP_BUDGET, depth: int | None = None) -> str:
        return rollup.render_map(rollup.directories(self.files), self.files, budget, depth)

    def trace(self, target: str, direction: str = "callers", depth: int = 1) -> DataFrame:
        return trace.Tracer(self.sources, self.symbols, self.occurrences).trace(target, direction, depth)

    def read(self, targets: list[str], **options) -> str:
        return views.read(self, targets, **options)

    def changes(self, before: Corpus) -> DataFrame:
        """What became of each symbol since an earlier version."""
        return changes.symbol_changes(before.symbols, self.symbols, before.sources, self.sources)
