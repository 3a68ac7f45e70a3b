"""The search plan: cells to hits, to events, counts, files and text."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.globs import glob_regex
from tessera.functions.matching import has_hit, with_submatches
from tessera.functions.patterns import Pattern, compile_pattern
from tessera.model import SUBMATCHES, ReadOptions, SearchOptions
from tessera.operators.context import gaps, neighbours, promoted
from tessera.sources.files import Screen, read_cells


def filter_cells(cells: DataFrame, options: ReadOptions) -> DataFrame:
    """Layers, sheets and hidden parts, for cells that were read with everything (rows of errors stay).

    Delimited files and tables without sheets (sheet "") aren't filtered by sheet; comments go with their sheet.
    """
    keep = F.col("layer").isin(*sorted(options.layers)) & (F.length("text") > 0)
    if options.sheet_glob:
        keep &= (F.col("sheet") == "") | F.col("sheet").rlike(glob_regex(options.sheet_glob))
    if not options.include_hidden:
        keep &= ~F.col("hidden_sheet") & ((F.col("layer") == "comment") | ~(F.col("hidden_row") | F.col("hidden_col")))
    return cells.where(F.col("error").isNotNull() | keep)


def filter_paths(df: DataFrame, glob: str, path: str = "path") -> DataFrame:
    return df.where(F.col(path).rlike(glob_regex(glob)))


@dataclass
class Search:
    """A search over CELLS. Every method gives a DataFrame and starts nothing; events() is ordered by file_seq, seq, sub_seq."""

    spark: SparkSession
    cells: DataFrame
    options: SearchOptions

    def __post_init__(self):
        o = self.options
        self.pattern: Pattern = compile_pattern(self.spark, o.patterns, o.case, o.fixed, o.word)

    @classmethod
    def over_files(cls, spark: SparkSession, files: list[str], options: SearchOptions) -> Search:
        """A search of files in which the reader passes over sheets without a hit, as far as what is asked for allows: with
        invert it reads all cells, with context all cells of sheets with a hit."""
        pattern = compile_pattern(spark, options.patterns, options.case, options.fixed, options.word)
        screen = None if options.invert else Screen(pattern, bool(options.before or options.after))
        return cls(spark, read_cells(spark, files, options.read, screen), options)

    def readable(self) -> DataFrame:
        return self.cells.where(F.col("error").isNull())

    def marked(self) -> DataFrame:
        """The cells with is_hit: has a match, or has none with invert. A row without a text stands for a sheet without a hit."""
        found = has_hit(F.col("text"), self.pattern)
        return self.readable().withColumn("is_hit", F.coalesce(~found if self.options.invert else found, F.lit(False)))

    def hits(self) -> DataFrame:
        """The cells of which is_hit is true; the filter reaches the scan."""
        found = has_hit(F.col("text"), self.pattern)
        return self.readable().where(~found if self.options.invert else found).withColumn("is_hit", F.lit(True))

    def _with_submatches(self, df: DataFrame) -> DataFrame:
        return df.withColumn("submatches", F.array().cast(SUBMATCHES)) if self.options.invert else with_submatches(df, self.pattern)

    def matches(self) -> DataFrame:
        """The cells with hits and their submatches."""
        return self._with_submatches(self.hits())

    def shown(self) -> DataFrame:
        """Cells that are shown, with row_hit, submatches and gap_before; without context those with hits.

        A cell without a row (an address that can't be read) counts but isn't shown with context.
        """
        o = self.options
        if not o.before and not o.after:
            return self.matches().withColumns({"row_hit": F.lit(True), "gap_before": F.lit(False)})
        marked = self.marked()
        hits = marked.where("is_hit and row is not null")
        near = gaps(promoted(neighbours(marked, hits, o.before, o.after), hits))
        if not o.row_promotion:
            near = near.withColumn("row_hit", F.col("is_hit"))
        none = F.array().cast(SUBMATCHES)
        found = self._with_submatches(near)
        return found.withColumn("submatches", F.when(F.col("is_hit"), F.col("submatches")).otherwise(none))

    def stats(self) -> DataFrame:
        """For every file that was read and has cells: matches (cells with hits) and sheets_scanned (sheets with cells)."""
        return self.marked().groupBy("path", "file_seq").agg(F.count_if("is_hit").alias("matches"), F.count_distinct("sheet").cast("int").alias("sheets_scanned"))

    def summary(self, cells: tuple[str, ...] = ()) -> DataFrame:
        """path, file_seq, sheet, error, is_hit and, for hits, the named columns, each combination once with the number n of its
        cells. Made by one look at the cells: tasks count cells without a hit before anything is sent.

        `once` is a variable that no rule moves a filter through: what filters on it and n shares one exchange, as the
        looks below it stay the same."""
        hit = F.coalesce(F.col("error").isNull() & ((~has_hit(F.col("text"), self.pattern)) if self.options.invert else has_hit(F.col("text"), self.pattern)), F.lit(False))
        marked = self.cells.withColumn("is_hit", hit)
        keys = [F.col(k) for k in ("path", "file_seq", "sheet", "error", "is_hit")]
        return marked.select(*keys, *(F.when(F.col("is_hit"), F.col(c)).alias(c) for c in cells)).groupBy(*keys, *cells).agg(F.count("*").alias("n")).withColumn("once", F.rand(0))

    def events(self, files: DataFrame | None = None) -> DataFrame:
        """One row for each event; files(path, file_seq) adds files without cells.

        Without context the cells are read once: hits, counts and errors come from one exchange. Context takes a second
        look, at the rows near hits."""
        blank = {"sheet": "string", "cell": "string", "layer": "string", "text": "string", "submatches": SUBMATCHES, "matches": "long", "sheets_scanned": "int", "message": "string"}
        empty = {k: F.lit(None).cast(t) for k, t in blank.items()}

        def event(df: DataFrame, kind, seq, sub, **given) -> DataFrame:
            cols = {**empty, **given}
            return df.select(F.lit(kind).alias("type") if isinstance(kind, str) else kind.alias("type"), "path", *(cols[k].alias(k) for k in blank), "file_seq", seq.cast("long").alias("seq"), F.lit(sub).alias("sub_seq"))

        context = self.options.before or self.options.after
        summary = self.summary(() if context else ("seq", "cell", "layer", "text")).where("once >= 0 and n > 0")
        files = summary.select("path", "file_seq").distinct() if files is None else files.select("path", F.col("file_seq").cast("long"))
        if context:
            shown = self.shown()
        else:
            shown = self._with_submatches(summary.where("is_hit").withColumn("again", F.explode(F.array_repeat(F.lit(0), F.col("n").cast("int"))))).withColumn("row_hit", F.lit(True))
        own = {k: F.col(k) for k in ("sheet", "cell", "layer", "text")}
        kind = F.when(F.col("row_hit"), "match").otherwise("context")
        out = event(files, "begin", F.lit(-1), 0)
        out = out.unionByName(event(shown, kind, F.col("seq"), 1, **own, submatches=F.when(F.col("row_hit"), F.col("submatches"))))
        if context:
            out = out.unionByName(event(shown.where("gap_before"), "separator", F.col("seq"), 0))
        out = out.unionByName(event(summary.where("error is not null"), "error", F.lit(1 << 60), 0, message=F.col("error")))
        counted = summary.groupBy("path", "file_seq").agg(F.sum(F.when(F.col("is_hit"), F.col("n")).otherwise(0)).alias("matches"), F.count_distinct("sheet").cast("int").alias("sheets_scanned"))
        ended = files.join(counted, ["path", "file_seq"], "left")
        return out.unionByName(event(ended, "end", F.lit((1 << 60) + 1), 0, matches=F.coalesce("matches", F.lit(0)), sheets_scanned=F.coalesce("sheets_scanned", F.lit(0))))

    def counts(self) -> DataFrame:
        """path, n of files with hits; strict counts match events, of which context makes more."""
        rows = self.shown().where("row_hit") if self.options.strict else self.hits()
        return rows.groupBy("path", "file_seq").agg(F.count("*").alias("n")).select("path", "n", "file_seq")

    def files(self) -> DataFrame:
        return self.hits().select("path", "file_seq").distinct()

    def exit_code(self) -> int:
        return 1 if self.hits().select("path").limit(1).isEmpty() else 0


def json_events(events: DataFrame) -> DataFrame:
    """The events as JSON objects {"type", "data"}, in column value; a separator has no data."""
    where = ["path", "sheet", "cell", "layer", "text"]
    data = (
        F.when(F.col("type") == "begin", F.to_json(F.struct("path")))
        .when(F.col("type") == "match", F.to_json(F.struct(*where, "submatches")))
        .when(F.col("type") == "context", F.to_json(F.struct(*where)))
        .when(F.col("type") == "end", F.to_json(F.struct("path", F.struct("matches", "sheets_scanned").alias("stats"))))
        .when(F.col("type") == "error", F.to_json(F.struct("path", "message")))
    )
    value = F.concat(F.lit('{"type":"'), F.col("type"), F.lit('"'), F.coalesce(F.concat(F.lit(',"data":'), data), F.lit("")), F.lit("}"))
    return events.select(value.alias("value"), "file_seq", "seq", "sub_seq")


def explode_submatches(matches: DataFrame) -> DataFrame:
    """One row for each hit: the cell's columns, hit (from 0), match, start, end."""
    return matches.select(*(c for c in matches.columns if c != "submatches"), F.posexplode("submatches").alias("hit", "m")).select("*", F.col("m.match.text").alias("match"), F.col("m.start").alias("start"), F.col("m.end").alias("end")).drop("m")


def pretty_lines(events: DataFrame, layers: bool = False, colour: bool = False) -> DataFrame:
    """Readable lines (column line) of files with a match: the path, then each event."""
    paint = (lambda x, code: F.concat(F.lit(f"\x1b[{code}m"), x, F.lit("\x1b[0m"))) if colour else (lambda x, _: x)
    files = events.where("type = 'match'").select("path", "file_seq").distinct()
    e = events.where("type in ('begin', 'match', 'context', 'separator', 'error')").join(files, ["path", "file_seq"], "left_semi")
    sheet = F.when(F.col("sheet") == "", F.lit("")).otherwise(F.concat(paint(F.col("sheet"), "34"), F.lit("!")))
    tag = F.when((F.col("layer") != "display") | F.lit(layers), F.concat(F.lit(" "), paint(F.concat(F.lit("["), F.col("layer"), F.lit("]")), "36"))).otherwise(F.lit(""))
    offset = F.coalesce(F.try_element_at("submatches", F.lit(1))["start"] + 1, F.lit(1))
    text = F.col("text")
    if colour:
        cut = F.aggregate(
            F.coalesce("submatches", F.array().cast(SUBMATCHES)), F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
            lambda s, m: F.struct(m["end"].alias("at"), F.concat(s["out"], F.substring(F.col("text"), s["at"] + 1, m["start"] - s["at"]), paint(m["match"]["text"], "1;33")).alias("out")),
        )
        text = F.concat(cut["out"], F.substring(F.col("text"), cut["at"] + 1, F.length("text")))
    head = F.concat(F.lit("  "), sheet, paint(F.col("cell"), "32"))
    line = (
        F.when(F.col("type") == "begin", paint(F.col("path"), "1;35"))
        .when(F.col("type") == "match", F.concat(head, F.lit(":"), offset.cast("string"), F.lit(": "), text, tag))
        .when(F.col("type") == "context", F.concat(head, F.lit(": "), F.col("text"), F.lit(" "), paint(F.lit("[context]"), "36"), tag))
        .when(F.col("type") == "separator", F.lit("  --"))
        .otherwise(F.concat(F.lit("  ERROR: "), F.col("message")))
    )
    return e.select(line.alias("line"), "file_seq", "seq", "sub_seq")


ORDER = ["file_seq", "seq", "sub_seq"]
