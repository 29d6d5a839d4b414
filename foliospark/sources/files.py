"""Files as rows: inventory, filter decisions, format readers, scanned-page triage, registries."""

from __future__ import annotations

import email
import email.policy
import io
import re
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliospark.functions import text as tx
from foliospark.sources import compound, pdf

CATEGORIES = {
    ".pdf": "PDF", ".doc": "Word", ".docx": "Word", ".xls": "Excel", ".xlsx": "Excel", ".ppt": "PowerPoint", ".pptx": "PowerPoint", ".msg": "Mail", ".eml": "Mail",
    ".txt": "Texte", ".csv": "Texte", ".jpg": "Image", ".jpeg": "Image", ".png": "Image", ".tif": "Image", ".tiff": "Image", ".zip": "Archive", ".dwg": "Plan",
}
SYSTEM_NAMES = ("thumbs.db", "desktop.ini", ".ds_store")
READABLE = (".pdf", ".doc", ".docx", ".xlsx", ".pptx", ".msg", ".eml", ".txt", ".csv", ".md", ".html")
EXCLUDED = (".zip", ".rar", ".exe", ".mp4", ".mov", ".mp3", ".tmp", ".lnk")
GOOGLE = (".gdoc", ".gsheet", ".gslides")
IMAGES = (".jpg", ".jpeg", ".png", ".tif", ".tiff")


def inventory(spark: SparkSession, root: str) -> DataFrame:
    """Files below root: path, relative, extension, category, property (first folder, RACINE for none), size, mb, modified."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    plain = F.regexp_replace("path", "^file:/*", "/")
    relative = F.regexp_replace(F.substring(plain, F.lit(len("/" + root.removeprefix("file:").strip("/")) + 1), F.length(plain)), "^/+", "")
    return described(raw.withColumn("relative", relative))


def described(files: DataFrame) -> DataFrame:
    """files (relative, size) with extension, category, property and mb; system files left out."""
    kinds = F.create_map(*[F.lit(x) for pair in CATEGORIES.items() for x in pair])
    named = files.where(~F.lower(tx.basename(F.col("relative"))).isin(list(SYSTEM_NAMES)) & ~tx.basename(F.col("relative")).startswith("~$"))
    top = F.when(F.instr("relative", "/") > 0, F.split_part("relative", F.lit("/"), F.lit(1))).otherwise("RACINE")
    return named.withColumn("extension", tx.extension(F.col("relative"))).withColumn("category", F.coalesce(F.try_element_at(kinds, "extension"), F.lit("Autre"))).withColumn("property", top).withColumn("mb", F.round(F.col("size") / 1048576.0, 2))


def report(files: DataFrame, by: str = "category") -> DataFrame:
    return files.groupBy(by).agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).orderBy(F.desc("n"), by)


def decision(path: Column, photos: tuple[str, ...] = ("photo", "photos"), plans: tuple[str, ...] = ("plan", "plans")) -> Column:
    """struct(keep, reason): ordered rules over name and extension; an unknown extension is kept."""
    ext, name, folded = tx.extension(path), F.lower(tx.basename(path)), tx.fold_latin(path)
    out = lambda keep, reason: F.struct(F.lit(keep).alias("keep"), F.lit(reason).alias("reason"))
    words = F.split(folded, "[^a-z0-9]+")
    return (
        F.when(name.isin(list(SYSTEM_NAMES)) | name.startswith("~$"), out(False, "SYSTEME"))
        .when(ext.isin(list(GOOGLE)), out(False, "GOOGLE_NATIF"))
        .when(ext.isin(list(READABLE)), out(True, "LISIBLE"))
        .when(ext.isin(list(IMAGES)) & F.arrays_overlap(words, F.array(*map(F.lit, plans))), out(True, "PLAN"))
        .when(ext.isin(list(IMAGES)) & F.arrays_overlap(words, F.array(*map(F.lit, photos))), out(False, "PHOTO"))
        .when(ext.isin(list(EXCLUDED)), out(False, "EXTENSION_EXCLUE"))
        .otherwise(out(True, "INCONNU"))
    )


def photo_folders(files: DataFrame, most: int = 100) -> DataFrame:
    """Images of folders that hold more than ``most`` of them are photos."""
    folder = Window.partitionBy("folder")
    return files.where(F.col("extension").isin(list(IMAGES))).withColumn("images", F.count("*").over(folder)).withColumn("is_photo", F.col("images") > most)


def changed(files: DataFrame, known: DataFrame) -> DataFrame:
    """Files to extract: their signature (size:time) is not the known one; a known file without signature is adopted."""
    k = known.select(F.col("path").alias("k_"), F.col("signature").alias("s_"))
    both = files.join(k, files.path == F.col("k_"), "left")
    return both.where(F.col("k_").isNull() | (F.col("s_").isNotNull() & (F.col("s_") != F.col("signature")))).drop("k_", "s_")


def native_pages(pages: DataFrame) -> DataFrame:
    """path and native: enough characters on average and on most pages to be no scan."""
    full = F.count_if(F.col("chars") >= 100) / F.count("*")
    return pages.groupBy("path").agg(F.count("*").alias("pages"), pdf.native(F.avg("chars"), full, F.count("*")).alias("native"))


def _text(raw: bytes) -> str:
    for kind in ("utf-8", "latin-1", "cp1252"):
        try:
            return raw.decode(kind)
        except UnicodeDecodeError:
            continue
    return raw.decode("utf-8", "replace")


def _xml_text(raw: bytes, part: str, paragraph: str) -> list[str]:
    tree = ElementTree.fromstring(raw)
    return ["".join(x.text or "" for x in p.iter() if x.tag.endswith("}" + part)) for p in tree.iter() if p.tag.endswith("}" + paragraph)]


def _sheets(z: zipfile.ZipFile) -> str:
    names = z.namelist()
    shared = _xml_text(z.read("xl/sharedStrings.xml"), "t", "si") if "xl/sharedStrings.xml" in names else []
    titles = [x.get("name", "") for x in ElementTree.fromstring(z.read("xl/workbook.xml")).iter() if x.tag.endswith("}sheet")] if "xl/workbook.xml" in names else []
    out = []
    for k, name in enumerate(sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.sub(r"\D", "", n)))):
        out.append(f"--- Feuille: {titles[k] if k < len(titles) else k + 1} ---")
        for row in (r for r in ElementTree.fromstring(z.read(name)).iter() if r.tag.endswith("}row")):
            cells = []
            for c in row:
                v = "".join(x.text or "" for x in c.iter() if x.tag.endswith("}v") or x.tag.endswith("}t"))
                cells.append(shared[int(v)] if c.get("t") == "s" and v.isdigit() and int(v) < len(shared) else v)
            if any(cells):
                out.append(" | ".join(cells))
    return "\n".join(out)


#: Formats without a reader; their text is null, never their bytes.
NO_READER = (".xls", ".ppt")


def extract(name: str, raw: bytes) -> str | None:
    """The text of a file by its extension; a broken office file is read as plain text, a format without reader is null.

    PDF, .msg and .doc files have readers of their own, see ``read_files``.
    """
    kind = _extension(name)
    if kind in (*NO_READER, ".pdf", ".msg", ".doc"):
        return None
    try:
        if kind in (".docx", ".xlsx", ".pptx"):
            with zipfile.ZipFile(io.BytesIO(raw)) as z:
                if kind == ".docx":
                    return "\n".join(p for p in _xml_text(z.read("word/document.xml"), "t", "p") if p.strip())
                if kind == ".xlsx":
                    return _sheets(z)
                slides = sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.sub(r"\D", "", n)))
                return "\n".join(line for k, n in enumerate(slides, 1) for line in [f"--- Slide {k} ---", *(p for p in _xml_text(z.read(n), "t", "p") if p.strip())])
        if kind == ".eml":
            m = email.message_from_bytes(raw, policy=email.policy.default)
            body = m.get_body(("plain", "html"))
            head = [f"{h}: {m[h]}" for h in ("From", "To", "Date", "Subject") if m[h]]
            return "\n".join([*head, "", body.get_content() if body else ""])
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, LookupError):
        return _text(raw)
    return _text(raw)


def _extension(name: str) -> str:
    found = re.search(r"\.[^./]+$", name.lower())
    return found.group() if found else ""


def read_files(files: DataFrame, key: str = "path", name: str = "path", content: str = "content") -> DataFrame:
    """key, page, text, chars, reason: the texts of files by the reader of their format, in one pass over their bytes.

    A PDF file has a row for each page (``pdf.pages``), any other file one row without a page. reason is
    null where text is not: ``NO_READER`` for a format without reader, ``ILLISIBLE`` or ``CHIFFRE`` for a
    file that its reader cannot open.
    """

    def rows(name: str, raw: bytes) -> list[tuple[int | None, str | None, str | None]]:
        kind = _extension(name)
        if kind == ".pdf":
            return list(pdf.page_texts(raw))
        if kind in NO_READER:
            return [(None, None, "NO_READER")]
        try:
            text = compound.mail_text(compound.mail(raw)) if kind == ".msg" else compound.word_text(raw) if kind == ".doc" else extract(name, raw)
        except compound.UNREADABLE:
            return [(None, None, pdf.BROKEN)]
        return [(None, text, None)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, label, raw in zip(*batch.columns, strict=True):
                page, text, reason = zip(*rows(label.as_py() or "", raw.as_py() or b""), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array([own.as_py()] * len(page), batch.schema.field(0).type), pa.array(page, pa.int32()), pa.array(text, pa.string()), pa.array(reason, pa.string())], names=[key, "page", "text", "reason"])

    read = files.select(F.col(key), F.col(name).alias("name_"), F.col(content)).mapInArrow(run, f"{key} {dict(files.dtypes)[key]}, page int, text string, reason string")
    return read.select(key, "page", "text", F.coalesce(F.length(F.trim("text")), F.lit(0)).alias("chars"), "reason")


def read_texts(spark: SparkSession, root: str, pages: DataFrame | None = None) -> DataFrame:
    """path, text, n_pages, reason of the files below root (``pages``: texts that another program has read, path and
    text, say of scanned files, stand in for what has none here).

    reason says why text is null: ``NO_READER``, ``ILLISIBLE``, ``CHIFFRE`` (encrypted), ``SCAN`` or ``VIDE``. Files
    of no bytes are not listed by Spark.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "content")
    read = pdf.texts(read_files(raw))
    if pages is not None:
        other = pages.select(F.col("path").alias("path_"), F.col("text").alias("text_"))
        read = read.join(other, F.col("path") == F.col("path_"), "left").select("path", F.coalesce("text", "text_").alias("text"), "n_pages", F.when(F.coalesce("text", "text_").isNull(), F.col("reason")).alias("reason"))
    return read


def _laid_out(boxes: pa.ListArray) -> pa.Array:
    """The text of each page from its boxes, all pages at once: a step of the loop is one word of every page."""
    lengths = pc.fill_null(pc.list_value_length(boxes), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    fields = dict(zip([f.name for f in boxes.type.value_type], boxes.flatten().flatten(), strict=True))
    left, top, height = (fields[c].to_numpy(zero_copy_only=False) for c in ("left", "top", "height"))
    page, starts = np.repeat(np.arange(len(lengths)), lengths), np.concatenate([[0], np.cumsum(lengths)])
    order = np.lexsort((left, top, page))
    left, top, height = left[order], top[order], height[order]
    fresh = np.zeros(len(order), bool)
    longest = np.argsort(-lengths, kind="stable")
    longest = longest[: np.count_nonzero(lengths)]
    at = starts[longest]
    fresh[at] = True
    running = np.where(height[at] == 0, 0.01, height[at].astype(float))
    alive = len(lengths) - np.searchsorted(np.sort(lengths), np.arange(1, lengths.max(initial=0)), side="right")
    for k, n in enumerate(alive, 1):
        here, running = at[:n] + k, running[:n]
        fresh[here] = np.abs(top[here] - top[here - 1]) > 0.4 * running
        running = np.where(height[here] > 0, 0.8 * running + 0.2 * height[here], running)
    line = np.cumsum(fresh)
    across = np.lexsort((left, line))
    top, height, order = top[across], height[across], order[across]
    first = np.flatnonzero(fresh)
    kind = np.ones(len(order), np.int8)
    if len(first):
        tall, head = np.maximum.reduceat(height, first), top[first]
        bottom = np.concatenate([[0.0], (head + tall)[:-1]])
        kind[first] = np.where((bottom > 0) & (head - bottom > 1.2 * tall), 3, 2)
        kind[at] = 0
    words = pc.binary_join_element_wise(pa.array(["", " ", "\n", "\n\n"]).take(pa.array(kind)), fields["word"].take(pa.array(order)), "")
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), words), "")


def page_lines(pages: DataFrame) -> DataFrame:
    """doc, page, text of scanned pages, a row each with its word boxes (array of left, top, height, word, in any order): a
    word stands on a new line if its top is more than 0.4 of the running height away from that of the word before; a
    blank line comes where a line begins more than 1.2 of its height below the one before.

    The running height (0.8 of itself, 0.2 of each word's) depends on every word before, so a page is one row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _laid_out(batch.column(2))], ["doc", "page", "text"])

    return pages.select(F.col("doc").cast("string"), F.col("page").cast("int"), "boxes").mapInArrow(run, "doc string, page int, text string")


def lines(boxes: DataFrame) -> DataFrame:
    """``page_lines`` of boxes that come as rows (doc, page, left, top, height, word), a page's anywhere in the table."""
    return page_lines(boxes.groupBy("doc", "page").agg(F.collect_list(F.struct("left", "top", "height", "word")).alias("boxes")))


def zip_entries(archives: DataFrame) -> DataFrame:
    """archive, name, crc, size of every entry of zip files (path, content)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for p, c in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    with zipfile.ZipFile(io.BytesIO(bytes(c))) as z:
                        rows += [(p, i.filename, i.CRC, i.file_size) for i in z.infolist() if not i.is_dir()]
                except zipfile.BadZipFile:
                    continue
            yield pd.DataFrame(rows, columns=["archive", "name", "crc", "size"])

    return archives.select("path", "content").mapInPandas(run, "archive string, name string, crc long, size long")


def zip_overlap(entries: DataFrame, loose: DataFrame) -> DataFrame:
    """Share of each archive's entries that also lie about as files (crc, size)."""
    known = loose.select("crc", "size").distinct().withColumn("loose", F.lit(True))
    return entries.join(known, ["crc", "size"], "left").groupBy("archive").agg(F.count("*").alias("entries"), F.count("loose").alias("loose")).withColumn("rate", F.round(F.col("loose") / F.col("entries"), 4))


def crc(raw: bytes) -> int:
    return zlib.crc32(raw)


def keyword_registry(spark: SparkSession, path: str) -> DataFrame:
    """key, url of ``KEY : URL`` lines; a bare URL is its own key, # starts a comment."""
    line = F.trim("value")
    pair = F.split(line, "\\s+:\\s+", 2)
    kept = spark.read.text(path).where((line != "") & ~line.startswith("#"))
    return kept.select(F.when(F.size(pair) == 2, pair[0]).otherwise(line).alias("key"), F.when(F.size(pair) == 2, pair[1]).otherwise(line).alias("url"))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def write_jsonl(df: DataFrame, path: str, by: str | None = None) -> None:
    (df.write.partitionBy(by) if by else df.write).mode("overwrite").json(path)


def read_shards(spark: SparkSession, root: str, schema: str, codes: list[str] | None = None) -> DataFrame:
    """JSON-lines shards of some or all properties (root/code=...)."""
    df = spark.read.schema(schema).option("basePath", root).json(root)
    return df.where(F.col("code").isin(codes)) if codes else df


def read_pages(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """Records of a paginated API stored as one JSON answer a page: {"records": [{"id", "fields"}], "offset"}."""
    raw = spark.read.schema(f"records array<struct<id: string, fields: struct<{schema}>>>, offset string").json(root, multiLine=True)
    return raw.select(F.explode("records").alias("r")).select("r.id", "r.fields.*")


def overwrite_partitions(df: DataFrame, path: str, by: str) -> None:
    """Replaces only the partitions that df holds."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def read_listing(spark: SparkSession, root: str, schema: str, page_size: int = 100, cap: int | None = None) -> DataFrame:
    """``read_pages`` with page and place of each record, of at most ``cap`` records in the order of the pages."""
    raw = spark.read.schema(f"records array<struct<id: string, fields: struct<{schema}>>>, offset string").json(root, multiLine=True)
    number = F.regexp_extract(F.input_file_name(), "(\\d+)[^/]*$", 1).cast("int")
    rows = raw.select(number.alias("page"), F.posexplode("records").alias("k", "r")).select("page", (F.col("page") * page_size + F.col("k")).alias("place"), "r.id", "r.fields.*")
    return rows if cap is None else rows.orderBy("place").limit(cap)


def manifest(decisions: DataFrame, path: str) -> None:
    """Writes what a stage decided (source_file, decision, reason, ref_source_file) beside its output, one line each."""
    decisions.select("source_file", "decision", "reason", "ref_source_file").write.mode("overwrite").json(path)


def checked_shards(shards: DataFrame, codes: list[str]) -> DataFrame:
    """code, n of the shards asked for; a code without rows has n = 0, so that a missing shard is seen before all are joined."""
    asked = shards.sparkSession.createDataFrame([(c,) for c in dict.fromkeys(codes)], "code string")
    return asked.join(shards.groupBy("code").agg(F.count("*").alias("n")), "code", "left").withColumn("n", F.coalesce("n", F.lit(0)))
