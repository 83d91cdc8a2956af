"""Structure of documents: sections of Markdown, definitions of Python, cells of notebooks. Lines end at line feeds."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.parts import parts
from ..functions.paths import language_of
from .chunk import UNITS

ARROW_UNITS = pa.list_(pa.struct([("start_line", pa.int32()), ("end_line", pa.int32()), ("name", pa.string()), ("depth", pa.int32())]))
HEADING = r"^(#{1,6})\s+(.+?)\s*#*\s*$"


def lines_of(documents: DataFrame, key: list[str]) -> DataFrame:
    """key, line (from 1), text: a row per line; a line feed at the end begins no line."""
    lines = F.split("text", "\n")
    kept = F.when(F.col("text").endswith("\n"), F.slice(lines, F.lit(1), F.size(lines) - 1)).otherwise(lines)
    return documents.filter("text <> ''").select(*key, F.posexplode(kept).alias("_i", "text")).select(*key, (F.col("_i") + 1).alias("line"), "text")


def markdown_units(lines: DataFrame, key: list[str]) -> DataFrame:
    """key, start_line, end_line, name, depth of the sections under headings of lines (key, line, text).

    A heading's ancestors are, for each smaller level, the last heading of that level, unless one of a level below it came later.
    """
    order = Window.partitionBy(*key).orderBy("line")
    upto, before, after = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing)
    bare = F.regexp_replace("text", r"^[\s\x1c-\x1f\x85\p{Z}]+", "")
    fence = bare.startswith("```") | bare.startswith("~~~")
    marked = lines.withColumns({"_fence": fence, "_level": F.length(F.regexp_extract("text", HEADING, 1)), "_title": F.regexp_extract("text", HEADING, 2)})
    marked = marked.withColumn("_open", F.sum(F.col("_fence").cast("int")).over(upto) % 2)
    last = F.max("line").over(Window.partitionBy(*key))
    heads = marked.withColumn("_last", last).filter("not _fence and _open = 0 and _level > 0").select(*key, "line", "_level", "_title", "_last")
    seen = {f"_h{n}": F.max(F.when(F.col("_level") == n, F.struct("line", "_title"))).over(before) for n in range(1, 7)}
    heads = heads.withColumns(seen)
    ancestors = []
    for n in range(1, 6):
        own = F.col(f"_h{n}")
        stronger = F.greatest(F.lit(0), F.lit(0), *[F.coalesce(F.col(f"_h{m}.line"), F.lit(0)) for m in range(1, n)])
        ancestors.append(F.when((F.col("_level") > n) & (own["line"] > stronger), own["_title"]))
    names = F.array_compact(F.array(*ancestors))
    ends = [F.min(F.when(F.col("_level") <= n, F.col("line"))).over(after) for n in range(1, 7)]
    heads = heads.withColumns({f"_e{n}": e for n, e in enumerate(ends, 1)})
    end = F.element_at(F.array(*[F.col(f"_e{n}") for n in range(1, 7)]), F.col("_level"))
    return heads.select(*key, F.col("line").alias("start_line"), F.coalesce(end - 1, F.col("_last")).cast("int").alias("end_line"), F.array_join(F.concat(names, F.array("_title")), " > ").alias("name"), F.size(names).cast("int").alias("depth"))


def collected(units: DataFrame, key: list[str]) -> DataFrame:
    """key, units: the units of a document in one array, in the order of lines."""
    return units.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("start_line", "end_line", "name", "depth"))).alias("units"))


def definitions(source: str) -> list[tuple[int, int, str, int]]:
    """Functions and classes directly in modules, classes and functions, outer ones first, with their decorators."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    found, todo = [], [(tree, "", 0)]
    while todo:
        node, prefix, depth = todo.pop()
        if depth:
            kind = "class" if isinstance(node, ast.ClassDef) else "def"
            first = min([node.lineno, *(d.lineno for d in node.decorator_list)])
            found.append((first, node.end_lineno, f"{prefix}{kind} {node.name}", depth - 1))
            prefix = f"{prefix}{kind} {node.name} > "
        inner = [n for n in node.body if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef))]
        todo += [(n, prefix, depth + 1) for n in reversed(inner)]
    return found


def units_in_parts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Units of sources, a part of a batch at a time, so that a worker holds the texts and trees of that part alone beside the batch."""
    for batch in batches:
        for (texts,) in parts(batch):
            yield pa.array([[dict(zip(("start_line", "end_line", "name", "depth"), u)) for u in definitions(t or "")] for t in texts.to_pylist()], ARROW_UNITS)


def python_units(text: Column) -> Column:
    """Units of Python sources; none for what doesn't parse."""

    @F.arrow_udf(UNITS)
    def units(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from units_in_parts(batches)

    return units(text)


def as_text(v: Column) -> Column:
    """A variant that is a string, or an array of strings to be joined, as one string."""
    parts = F.try_variant_get(v, "$", "array<string>")
    return F.coalesce(F.array_join(parts, ""), F.try_variant_get(v, "$", "string"), F.lit(""))


def outputs_text(outputs: Column) -> Column:
    """Rendered outputs of a cell: an array of variants. Printed text, results, names of images, errors; cleaned."""

    def rendered(o: Column) -> Column:
        at = lambda path, kind="string": F.try_variant_get(o, path, kind)
        kind = at("$.output_type")
        held = lambda name: F.coalesce(at(f"$.data['{name}']", "variant"), at(f"$['{name}']", "variant"))
        plain, html = held("text/plain"), held("text/html")
        image = F.regexp_extract(F.coalesce(F.to_json(F.coalesce(at("$.data", "variant"), o)), F.lit("")), r'"image/([^"/]+)"\s*:', 1)
        data = F.concat_ws("\n", F.when(plain.isNotNull(), as_text(plain)).when(html.isNotNull(), T.strip_html(as_text(html))), F.when(image != "", F.concat(F.lit("[image output: "), image, F.lit("]"))))
        error = F.concat(F.coalesce(at("$.ename"), F.lit("Error")), F.lit(": "), F.coalesce(at("$.evalue"), F.lit("")))
        shown = F.when((kind == "stream") & (at("$.name") == "stdout"), as_text(at("$.text", "variant"))).when(kind.isin("execute_result", "display_data", "pyout"), data).when(kind.isin("error", "pyerr"), error)
        return F.coalesce(shown, F.lit(""))

    parts = F.filter(F.transform(outputs, rendered), lambda p: p.rlike(r"(?U)\S"))
    return T.clean_output(F.array_join(parts, "\n"))


def notebook_cells(notebooks: DataFrame, key: list[str]) -> DataFrame:
    """key, cell (from 1), kind, source, output of notebooks (key, text: JSON) that parse."""
    nb = notebooks.withColumn("_nb", F.try_parse_json("text"))
    cells = F.coalesce(F.try_variant_get("_nb", "$.cells", "array<variant>"), F.try_variant_get("_nb", "$.worksheets[0].cells", "array<variant>"))
    each = nb.select(*key, F.posexplode(cells).alias("_i", "c"))
    at = lambda path, kind="string": F.try_variant_get("c", path, kind)
    kind = F.coalesce(at("$.cell_type"), F.lit("code"))
    source = F.regexp_replace(as_text(F.coalesce(at("$.source", "variant"), at("$.input", "variant"))), r"[\s\x1c-\x1f\x85\p{Z}]+$", "")
    output = F.when(kind == "code", outputs_text(F.coalesce(at("$.outputs", "array<variant>"), F.array().cast("array<variant>")))).otherwise("")
    return each.select(*key, (F.col("_i") + 1).alias("cell"), kind.alias("kind"), source.alias("source"), output.alias("output"))


def rendered_cells(cells: DataFrame, key: list[str]) -> DataFrame:
    """key, text, units: the notebook as text with a marker line per cell, and a unit per cell. Cells with no source and no output are left out."""
    size = lambda c: F.size(F.split(c, "\n"))
    n = F.col("cell").cast("string")
    head = F.concat(F.lit("# [cell "), n, F.lit(" · "), "kind", F.lit("]"))
    block = F.concat_ws("\n", head, F.when(F.col("source") != "", F.col("source")), F.when(F.col("output") != "", F.concat(F.lit("# [output of cell "), n, F.lit("]\n"), "output")))
    kept = cells.filter("source <> '' or output <> ''").withColumn("_block", block).withColumn("_n", size(F.col("_block")))
    upto = F.sum(F.col("_n") + 1).over(Window.partitionBy(*key).orderBy("cell"))
    placed = kept.withColumn("_end", (upto - 1).cast("int"))
    unit = F.struct((F.col("_end") - F.col("_n") + 1).cast("int").alias("start_line"), F.col("_end").alias("end_line"), F.concat(F.lit("cell "), n).alias("name"), F.lit(0).alias("depth"))
    whole = placed.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("cell", "_block", unit.alias("unit")))).alias("_c"))
    return whole.select(*key, F.concat(F.array_join(F.transform("_c", lambda c: c["_block"]), "\n\n"), F.lit("\n")).alias("text"), F.transform("_c", lambda c: c["unit"]).alias("units"))


def read_documents(files: DataFrame, keys: list[str] = ["repo", "path", "blob_sha"]) -> DataFrame:
    """keys, language, text, units of files (repo, path, blob_sha, text). Text and units depend on language and text alone, so equal blobs are read once."""
    named = files.withColumn("language", language_of(F.col("path")))
    once = ["blob_sha", "language"]
    distinct = named.select(*once, "text").dropDuplicates(once)
    python = distinct.filter("language = 'python'").withColumn("units", python_units(F.col("text")))
    markdown = distinct.filter("language = 'markdown'")
    markdown = markdown.join(collected(markdown_units(lines_of(markdown, once), once), once), once, "left")
    notebook = distinct.filter("language = 'notebook'")
    cells = rendered_cells(notebook_cells(notebook, once), once)
    parsed = F.try_parse_json("text").isNotNull()
    notebook = notebook.withColumn("_raw", F.when(~parsed, F.col("text"))).drop("text").join(cells, once, "left").withColumn("text", F.coalesce("text", "_raw", F.lit(""))).drop("_raw")
    plain = distinct.filter(~F.col("language").isin("python", "markdown", "notebook")).withColumn("units", F.lit(None).cast(UNITS))
    columns = [*once, "text", "units"]
    read = python.select(columns)
    for part in (markdown, notebook, plain):
        read = read.unionByName(part.select(columns))
    read = read.select(F.col("blob_sha").alias("_blob"), F.col("language").alias("_language"), F.col("text"), F.col("units"))
    same = F.col("blob_sha").eqNullSafe(F.col("_blob")) & (F.col("language") == F.col("_language"))
    return named.drop("text").join(read, same).select(*keys, "language", "text", F.coalesce("units", F.array().cast(UNITS)).alias("units"))
