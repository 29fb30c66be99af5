"""Corpora of PDF files as tables; one document is one row and is parsed in one task."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.kernel.content import Interpreter, placed_words
from paperloom.kernel.document import Document
from paperloom.kernel.syntax import Ref, Stream
from paperloom.kernel.writer import assemble, decorate, synthesize, synthesize_protected, update


def read_pdf(spark: SparkSession, path: str, glob: str = "*.pdf") -> DataFrame:
    """(doc_id, path, bytes) of all files below a path of any file system that Spark reads."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return files.select(F.xxhash64("path").alias("doc_id"), "path", F.col("content").alias("bytes"))


#: Rows of a batch that are Python objects at once.
AT_ONCE = 64


class Making(NamedTuple):
    """How the documents of a table are made: ``make`` gives the bytes of a row of ``source``."""

    source: DataFrame
    make: Callable[[dict], bytes | None]


def rows_of(df: DataFrame, schema: str, kernel: Callable[[dict], Iterator[dict | tuple]], *columns: str, keep: int = 4_096) -> DataFrame:
    """``kernel`` gives a document's rows, as dictionaries or as tuples; batches of about ``keep`` rows leave as they fill.

    Documents that a query makes itself are made where they are read, and never leave that task.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))
    secret = ["password"] if "bytes" in columns and "password" in df.columns and "password" not in columns else []
    pending: Making | None = df.__dict__.get("_making") if "bytes" in columns else None
    make = pending and pending.make

    def batch_of(held: list) -> pa.RecordBatch:
        if isinstance(held[0], dict):
            return pa.RecordBatch.from_pylist(held, arrow)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), arrow, strict=True)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        for batch in batches:
            names = batch.schema.names
            for at in range(0, batch.num_rows, AT_ONCE):
                for values in zip(*(c.to_pylist() for c in batch.slice(at, AT_ONCE).columns), strict=True):
                    r = dict(zip(names, values, strict=True))
                    if make:
                        r["bytes"] = make(r)
                    for row in kernel(r):
                        held.append(row)
                        if len(held) >= keep:
                            yield batch_of(held)
                            held = []
        if held:
            yield batch_of(held)

    return (pending.source if pending else df.select(*columns, *secret)).mapInArrow(run, schema)


def making(source: DataFrame, make: Callable[[dict], bytes | None], *carried: str, key: str = "doc_id", keep: int = 64) -> DataFrame:
    """(doc_id, bytes) and the carried columns of ``source``; see ``Making``."""
    types = ", ".join(f"`{c}` {source.schema[c].dataType.simpleString()}" for c in carried)
    made = rows_of(source, f"`{key}` {source.schema[key].dataType.simpleString()}, bytes binary" + (f", {types}" if types else ""), lambda r: iter([(r[key], make(r), *(r[c] for c in carried))]), *source.columns, keep=keep)
    made._making = Making(source, make)
    return made


def opened(r: dict) -> Document:
    """The document of a row; a binary column ``password`` opens encrypted ones."""
    return Document(r["bytes"] or b"", r.get("password") or b"")


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores, if it comes in fewer partitions than there are; parsing costs far more than a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def _info(r: dict) -> dict[str, str]:
    return {"Title": f"doc-{r['doc_id']}", "Subject": r["lang"] or "", "Author": r["source"] or ""}


def _of_texts(docs: DataFrame, make: Callable[[dict], bytes], columns: tuple[str, ...], carried: tuple[str, ...]) -> DataFrame:
    return making(spread(docs).select("doc_id", "text", *columns, *carried), make, *carried)


def synthesized(docs: DataFrame, *carried: str) -> DataFrame:
    """(doc_id, bytes): a PDF for each row of ``documents``, with title, subject and author; and columns that are carried along."""
    return _of_texts(docs, lambda r: synthesize(r["text"], _info(r)), ("lang", "source"), carried)


def made(docs: DataFrame, kernel: Callable[[dict], bytes]) -> DataFrame:
    """(doc_id, bytes): the document that ``kernel`` makes of each row's doc_id and text."""
    return _of_texts(docs, kernel, (), ())


def decorated(docs: DataFrame, *carried: str) -> DataFrame:
    """(doc_id, bytes): the same with links, files, fields, layers, labels and structure; see ``decorate``."""
    return _of_texts(docs, lambda r: decorate(r["text"], _info(r), r["doc_id"] or 0), ("lang", "source"), carried)


def protected(docs: DataFrame, method: str, user: bytes, owner: bytes, *carried: str) -> DataFrame:
    """(doc_id, bytes): the plain pages, encrypted by RC4-40, RC4-128, AES-128 or AES-256."""
    return _of_texts(docs, lambda r: synthesize_protected(r["text"], {"Title": f"doc-{r['doc_id']}"}, method, user, owner), (), carried)


def word_table(pdfs: DataFrame) -> DataFrame:
    """A row for each word: page and line from 0, place in its page, text and box in points from the top left."""

    def kernel(r: dict) -> Iterator[tuple]:
        doc_id, doc = r["doc_id"], opened(r)
        run = Interpreter(doc)
        for page_num, (_, page) in enumerate(doc.pages()):
            for i, w in enumerate(placed_words(run.spans(page))):
                yield (doc_id, page_num, i, *w)

    return rows_of(pdfs, "doc_id long, page_num int, word_num int, line int, text string, x_min double, y_min double, x_max double, y_max double, base double, size double, font string, turn int", kernel, "doc_id", "bytes")


def count_table(pdfs: DataFrame) -> DataFrame:
    """(doc_id, n_pages, n_words, n_letters, encrypted, title): what a document holds, counted as it is read."""

    def kernel(r: dict) -> Iterator[tuple]:
        doc = opened(r)
        texts = [[w[1] for w in placed_words(run.spans(page))] for run in (Interpreter(doc),) for _, page in doc.pages()]
        yield r["doc_id"], len(texts), sum(map(len, texts)), sum(len(t) for page in texts for t in page), "Encrypt" in doc.trailer, doc.info().get("Title")

    return rows_of(pdfs, "doc_id long, n_pages long, n_words long, n_letters long, encrypted boolean, title string", kernel, "doc_id", "bytes")


def page_table(pdfs: DataFrame) -> DataFrame:
    def kernel(r: dict) -> Iterator[dict]:
        doc = opened(r)
        for i, (_, page) in enumerate(doc.pages()):
            box = [float(doc.get(v)) for v in doc.get(page.get("MediaBox")) or [0, 0, 612, 792]]
            crop = [float(doc.get(v)) for v in doc.get(page.get("CropBox")) or box]
            yield {"doc_id": r["doc_id"], "page_num": i, "media_box": box, "crop_box": crop, "rotate": int(doc.get(page.get("Rotate")) or 0) % 360}

    return rows_of(pdfs, "doc_id long, page_num int, media_box array<double>, crop_box array<double>, rotate int", kernel, "doc_id", "bytes")


def info_table(pdfs: DataFrame) -> DataFrame:
    def kernel(r: dict) -> Iterator[dict]:
        doc = opened(r)
        yield {"doc_id": r["doc_id"], "ok": doc.ok, "rebuilt": doc.rebuilt, "version_major": doc.version and doc.version[0], "version_minor": doc.version and doc.version[1], "n_pages": sum(1 for _ in doc.pages()), "encrypted": "Encrypt" in doc.trailer, "permissions": doc.crypt and doc.crypt.permissions, "info": list(doc.info().items())}

    return rows_of(pdfs, "doc_id long, ok boolean, rebuilt boolean, version_major int, version_minor int, n_pages int, encrypted boolean, permissions int, info map<string,string>", kernel, "doc_id", "bytes")


def outline_table(pdfs: DataFrame) -> DataFrame:
    def kernel(r: dict) -> Iterator[dict]:
        for node, parent, depth, position, title in opened(r).outline():
            yield {"doc_id": r["doc_id"], "node_id": node, "parent_id": parent, "depth": depth, "ord": position, "title": title}

    return rows_of(pdfs, "doc_id long, node_id int, parent_id int, depth int, ord int, title string", kernel, "doc_id", "bytes")


def object_table(pdfs: DataFrame) -> DataFrame:
    """(doc_id, num, kind, type): what every indirect object is."""

    def kernel(r: dict) -> Iterator[dict]:
        for num, x in opened(r).objects():
            d = x.dict if isinstance(x, Stream) else x
            yield {"doc_id": r["doc_id"], "num": num, "kind": "stream" if isinstance(x, Stream) else type(x).__name__, "type": str(d["Type"]) if isinstance(d, dict) and isinstance(d.get("Type"), str) else None}

    return rows_of(pdfs, "doc_id long, num int, kind string, type string", kernel, "doc_id", "bytes")


def split_pages(pdfs: DataFrame) -> DataFrame:
    """(doc_id, page_num, bytes): a document of its own for every page."""

    def kernel(r: dict) -> Iterator[dict]:
        doc = opened(r)
        for i, _ in enumerate(list(doc.pages())):
            yield {"doc_id": r["doc_id"], "page_num": i, "bytes": assemble([(doc, [i])])}

    return rows_of(pdfs, "doc_id long, page_num int, bytes binary", kernel, "doc_id", "bytes", keep=64)


def merge_docs(pdfs: DataFrame, key: str, order: str) -> DataFrame:
    """(key, bytes): the documents of each key as one, in the given order; a result is one row and has to fit in it."""
    parts = pdfs.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, "bytes"))).alias("parts"))

    def make(r: dict) -> bytes:
        docs = [opened(p) for p in r["parts"]]
        return assemble([(d, range(sum(1 for _ in d.pages()))) for d in docs])

    return making(parts, make, key=key, keep=16)


def set_info(pdfs: DataFrame, entries: DataFrame) -> DataFrame:
    """(doc_id, bytes): an incremental update that sets the info strings of ``entries`` (doc_id, info map<string,string>); null removes one.

    Damaged and encrypted documents stay as they are.
    """

    def kernel(r: dict) -> Iterator[dict]:
        doc, data = opened(r), r["bytes"]
        ref = doc.trailer.get("Info")
        if doc.ok and not doc.rebuilt and not doc.crypt and isinstance(ref, Ref) and r["info"] is not None:
            old = doc.get(ref)
            new = {**(old if isinstance(old, dict) else {}), **{k: v if v is None else b"\xfe\xff" + v.encode("utf-16-be") for k, v in dict(r["info"]).items()}}
            data = update(data, {ref.num: {k: v for k, v in new.items() if v is not None}})
        yield {"doc_id": r["doc_id"], "bytes": data}

    return rows_of(pdfs.join(entries, "doc_id", "left"), "doc_id long, bytes binary", kernel, "doc_id", "bytes", "info", keep=64)
