"""Documents, exports and side tables back to files."""

from __future__ import annotations

import io
import os
import uuid
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def section_for_entry(entry: str, sections: list[str]) -> int | None:
    """The section that an archive entry holds: the same path, else the longest at a path boundary."""
    if entry in sections:
        return sections.index(entry)
    near = [s for s in sections if entry.endswith("/" + s) or s.endswith("/" + entry)]
    return sections.index(max(near, key=len)) if near else None


def rewrite_archive(content: bytes, sections: list[str], texts: list[str]) -> bytes:
    """The archive with its sections replaced, everything else copied, order and names kept."""
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(content)) as source, zipfile.ZipFile(out, "w") as target:
        for info in source.infolist():
            at = section_for_entry(info.filename, sections)
            data = source.read(info) if at is None else texts[at].encode("utf-8")
            target.writestr(info, data, compress_type=info.compress_type)
    return out.getvalue()


def epub_files(files: DataFrame, sections: DataFrame) -> DataFrame:
    """``doc_id, path, content`` of rewritten books. ``sections``: doc_id, section_idx, path, html (translated).

    Sections meet their book in one shuffle by document.
    """
    listed = sections.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("section_idx", F.col("path").alias("entry"), "html"))).alias("s"))
    joined = files.join(listed, "doc_id").select("doc_id", "path", "content", F.transform("s", lambda x: x["entry"]).alias("names"), F.transform("s", lambda x: x["html"]).alias("texts"))

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame({"doc_id": part["doc_id"], "path": part["path"], "content": [rewrite_archive(c, list(n), list(t)) for c, n, t in zip(part["content"], part["names"], part["texts"], strict=True)]})

    return joined.mapInPandas(work, "doc_id bigint, path string, content binary")


def output_paths(files: DataFrame, root: str, target) -> DataFrame:
    """``files`` with ``out``: each path below ``root`` with its name changed by ``target``, so that equal names in different folders stay apart."""
    inside = F.regexp_replace("path", r"^[a-zA-Z][a-zA-Z0-9+.-]*:/*", "/")
    base = F.lit("/" + root.split(":", 1)[-1].strip("/") + "/")
    relative = F.when(F.startswith(inside, base), F.substring(inside, F.length(base) + 1, F.length(inside))).otherwise(F.regexp_extract(inside, r"([^/]*)$", 1))
    return files.withColumn("out", target(relative))


def write_files(df: DataFrame, folder: str, name: Column, content: Column) -> None:
    """Write each row's bytes or text as a file below ``folder``, through the file system that the path names.

    ``name`` is a relative path; names that leave the folder or that two rows share are refused before anything is
    written. A file appears under its name only when complete, so that a repeated task replaces it by the same.
    """
    named = df.select(name.alias("name_"), content.alias("content"))
    clash = named.groupBy("name_").count().filter((F.col("count") > 1) | F.col("name_").isNull() | F.col("name_").rlike(r"(^|/)\.\.(/|$)|^/")).limit(1).collect()
    if clash:
        raise ValueError(f"the name {clash[0].name_!r} is no path of its own in the folder")
    from pyarrow import fs

    def work(rows) -> None:
        system, base = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), os.path.abspath(folder))
        for row in rows:
            data = bytes(row.content) if isinstance(row.content, (bytes, bytearray)) else row.content.encode("utf-8")
            path = f"{base.rstrip('/')}/{row.name_}"
            part = f"{path}.{uuid.uuid4().hex}.part"
            system.create_dir(path.rsplit("/", 1)[0], recursive=True)
            with system.open_output_stream(part) as f:
                f.write(data)
            system.move(part, path)

    named.foreachPartition(work)


def file_result_name(name: Column, seconds: Column) -> Column:
    """Name of a file's exported result: the file's own name marked as translated, or one with the time where it has none."""
    return F.when(F.coalesce(name, F.lit("")) == "", F.concat(F.lit("translated_"), seconds.cast("string"), F.lit(".txt"))).otherwise(F.concat(F.lit("translated_"), name))


def write_file_results(results: DataFrame, folder: str, seconds: int) -> None:
    """Write ``content`` of each row (``name``, ``content``) under its result's name."""
    write_files(results, folder, file_result_name(F.col("name"), F.lit(seconds)), F.col("content"))


def progress(attempts: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key, batch_idx, current, total, attempts, successes, percent`` after each batch, as running sums."""
    order = Window.partitionBy(key).orderBy("batch_idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = F.sum("n_segments").over(Window.partitionBy(key))
    done = F.sum("n_segments").over(order)
    return attempts.select(key, "batch_idx", done.alias("current"), total.alias("total"), F.sum("attempts").over(order).alias("attempts"), F.sum("successes").over(order).alias("successes"), F.round(done / total * 100, 2).alias("percent"))
