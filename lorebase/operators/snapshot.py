"""Sinks: versions of the corpus that share their books' files, behind a pointer; readiness; exports.

A book is a folder that is written once and checked: its row, chunks, links and
postings.  A version is a manifest that names one folder for each of its books, so
publishing a book writes that book and a manifest, whatever the size of the others.
Folders, manifests and the pointer are reached through Hadoop's file system, so they
may be on any store that the cluster shares.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from dataclasses import asdict, dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorebase import schemas
from lorebase.operators import corpus, textindex

POINTER, VERSIONS = "CURRENT", "versions"
PARTS = ("books", "chunks", "links", "postings")
OWNED_LINKS = f"{schemas.LINKS}, from_rulebook_id string, to_rulebook_id string"
POSTINGS = "term string, id string, title_end int, positions array<int>"
#: Seconds that a publisher waits for another that has claimed the next version, and that an unnamed folder is spared.
CLAIM_SECONDS, SPARED_SECONDS = 60.0, 24 * 3600


class IntegrityError(ValueError):
    """A version breaks a rule and is not activated."""


class ConflictError(RuntimeError):
    """Another publisher replaced the same book, or has claimed the next version and does not go on."""


@dataclass(frozen=True)
class Held:
    """A book of a version: its folder, and the count of publications that it was written at."""

    id: str
    path: str
    written: int


# --- files -------------------------------------------------------------------------


def _fs(spark: SparkSession, path: str):  # noqa: ANN202
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def _text(spark: SparkSession, path: str) -> str | None:
    fs, at = _fs(spark, path)
    if not fs.exists(at(path)):
        return None
    stream = fs.open(at(path))
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def _put(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file beside its place and rename it over in one step: readers see the old or the new one."""
    fs, at = _fs(spark, path)
    final, beside = at(path), at(f"{path.rpartition('/')[0]}/.{uuid.uuid4().hex}")
    out = fs.create(beside, True)
    out.write(bytearray(text.encode()))
    out.close()
    jvm = spark._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri() if final.toUri().getScheme() else fs.getUri(), spark._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(beside, final, options)


def _delete(spark: SparkSession, path: str) -> None:
    fs, at = _fs(spark, path)
    fs.delete(at(path), True)


# --- reading -----------------------------------------------------------------------


def read_pointer(spark: SparkSession, root: str) -> str | None:
    """Name of the active version; readers resolve it once and then stay with it."""
    said = _text(spark, f"{root}/{POINTER}")
    return None if said is None else json.loads(said)["version"]


def manifest(spark: SparkSession, root: str, version: str | None) -> dict[str, Held]:
    """The books of a version; none for no version."""
    if version is None:
        return {}
    said = _text(spark, f"{root}/{VERSIONS}/{version}.json")
    if said is None:
        raise FileNotFoundError(f"{root} has no version {version}")
    return {b["id"]: Held(**b) for b in json.loads(said)["books"]}


def _read(spark: SparkSession, root: str, held: dict[str, Held], part: str) -> DataFrame:
    kinds = {"books": schemas.BOOKS, "chunks": schemas.CHUNKS, "links": OWNED_LINKS, "postings": POSTINGS}
    if not held:
        return spark.createDataFrame([], kinds[part])
    return spark.read.schema(kinds[part]).parquet(*[f"{root}/{b.path}/{part}" for b in held.values()])


def _links(spark: SparkSession, root: str, held: dict[str, Held]) -> DataFrame:
    """Links whose target's book has not been replaced since they were written; replacing a book takes the links to it along."""
    links = _read(spark, root, held, "links")
    ages = corpus.small(spark.createDataFrame([(b.id, b.written) for b in held.values()], "book string, written long"))
    known = links.join(ages.withColumnsRenamed({"book": "from_rulebook_id", "written": "own"}), "from_rulebook_id").join(ages.withColumnsRenamed({"book": "to_rulebook_id", "written": "of_target"}), "to_rulebook_id")
    return known.where("of_target <= own").select(*[c.split(" ")[0] for c in schemas.LINKS.split(", ")])


def open_version(spark: SparkSession, root: str, version: str | None = None) -> dict[str, DataFrame]:
    """Books, chunks, links and postings of a version, the active one by default; empty tables for a store without one."""
    held = manifest(spark, root, version or read_pointer(spark, root))
    return {"links": _links(spark, root, held), **{p: _read(spark, root, held, p) for p in PARTS if p != "links"}}


def readiness(spark: SparkSession, root: str) -> DataFrame:
    """(part, ready): is there a version, are all its books' tables whole, are its chunks embedded?  Nothing is raised for a store that is not ready."""
    version = read_pointer(spark, root)
    try:
        held = manifest(spark, root, version)
    except FileNotFoundError:
        version, held = None, {}
    fs, at = _fs(spark, root)
    tables = {p: bool(held) and all(fs.exists(at(f"{root}/{b.path}/{p}/_SUCCESS")) for b in held.values()) for p in PARTS}
    chunks = _read(spark, root, held, "chunks") if tables["chunks"] else None
    embedded = chunks is not None and not chunks.isEmpty() and chunks.where("embedding IS NULL").isEmpty()
    return spark.createDataFrame([("version", version is not None), *tables.items(), ("embeddings", embedded)], "part string, ready boolean")


# --- publishing --------------------------------------------------------------------


def violations(books: DataFrame, chunks: DataFrame, links: DataFrame, others: DataFrame) -> dict[str, DataFrame]:
    """Every rule of a book and its tables as the rows that break it; ``others`` (id) are the chunks of the version's other books."""
    return {
        "book id repeats": corpus.duplicates(books, "id"),
        "section repeats": corpus.duplicates(chunks, "rulebook_id", "section_key"),
        "chunk id repeats": corpus.duplicates(chunks.select("id").unionByName(others.select("id").join(chunks.select("id"), "id", "left_semi")), "id"),
        "link repeats": corpus.duplicates(links, "from_chunk_id", "to_chunk_id", "relation"),
        "chunk without its book's edition": corpus.orphans(chunks, books.select(F.col("id"), F.col("edition").alias("e")), {"rulebook_id": "id", "edition": "e"}),
        "parent is missing": corpus.orphans(chunks, chunks.select("rulebook_id", "section_key"), {"rulebook_id": "rulebook_id", "parent_section_key": "section_key"}),
        "link from nowhere": links.where("from_rulebook_id IS NULL"),
        "link to nowhere": links.where("to_rulebook_id IS NULL"),
        "book rule": corpus.breaks(books, corpus.book_rules()),
        "chunk rule": corpus.breaks(chunks, corpus.chunk_rules()),
        "link rule": corpus.breaks(links, corpus.link_rules()),
    }


def _others(spark: SparkSession, root: str, held: dict[str, Held], book: str) -> DataFrame:
    """(id, rulebook_id) of the chunks of all other books; two columns of their files are read."""
    return _read(spark, root, {k: b for k, b in held.items() if k != book}, "chunks").select("id", "rulebook_id")


def _checked(spark: SparkSession, root: str, path: str, held: dict[str, Held], book: str) -> None:
    own = {book: Held(book, path, 0)}
    books, chunks, links = (_read(spark, root, own, p) for p in ("books", "chunks", "links"))
    for rule, rows in violations(books, chunks, links, _others(spark, root, held, book)).items():
        if not rows.isEmpty():
            raise IntegrityError(rule)


def _owners(spark: SparkSession, root: str, held: dict[str, Held], book: str, path: str, links: DataFrame) -> DataFrame:
    """``links`` with the books of both ends; a link leads from the book's own chunks to any chunk of the version."""
    own = _read(spark, root, {book: Held(book, path, 0)}, "chunks").select("id", "rulebook_id")
    every = own.unionByName(_others(spark, root, held, book))
    begun = links.join(own.select(F.col("id").alias("from_chunk_id"), F.col("rulebook_id").alias("from_rulebook_id")), "from_chunk_id", "left")
    return begun.join(every.select(F.col("id").alias("to_chunk_id"), F.col("rulebook_id").alias("to_rulebook_id")), "to_chunk_id", "left")


def replace_book(spark: SparkSession, root: str, book: DataFrame, chunks: DataFrame, links: DataFrame) -> str:
    """Publish a version in which one book, its chunks and links replace what the last version had of it.

    Publishers of different books do not wait for each other's files: the one that comes second puts its book on top of
    the first one's version.  Of two that replace the same book the second fails.
    """
    ids = [r.id for r in book.select("id").limit(2).collect()]
    if len(ids) != 1 or not ids[0]:
        raise IntegrityError("one book is published at a time")
    name = ids[0]
    read = read_pointer(spark, root)
    base = held = manifest(spark, root, read)
    path = f"books/{hashlib.sha256(name.encode()).hexdigest()[:16]}/{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    kept = lambda df, kind: df.select([F.col(f.name).cast(f.dataType) for f in spark.createDataFrame([], kind).schema])
    try:
        kept(book, schemas.BOOKS).write.parquet(f"{root}/{path}/books")
        kept(chunks, schemas.CHUNKS).write.parquet(f"{root}/{path}/chunks")
        written = _read(spark, root, {name: Held(name, path, 0)}, "chunks")
        textindex.store(written, f"{root}/{path}/postings")
        kept(_owners(spark, root, held, name, path, kept(links, schemas.LINKS)), OWNED_LINKS).write.parquet(f"{root}/{path}/links")
        _checked(spark, root, path, held, name)
        began = time.monotonic()
        while True:
            entry = Held(name, path, 1 + max((b.written for b in held.values()), default=0))
            if version := _activate(spark, root, read, {**held, name: entry}):
                return version
            now = read_pointer(spark, root)
            if now == read:  # claimed, but not moved yet
                if time.monotonic() - began > CLAIM_SECONDS:
                    raise ConflictError(f"another publisher has claimed what follows {read}")
                time.sleep(0.2)
                continue
            read, held, began = now, manifest(spark, root, now), time.monotonic()
            if held.get(name) != base.get(name):
                raise ConflictError(f"{name} has been replaced by another publisher")
            _checked(spark, root, path, held, name)  # against the other books as they are now
            lost = _read(spark, root, {name: Held(name, path, 0)}, "links").where(F.col("to_rulebook_id") != name).join(_others(spark, root, held, name).select(F.col("id").alias("to_chunk_id")), "to_chunk_id", "left_anti")
            if not lost.isEmpty():
                raise IntegrityError("link to nowhere")
    except BaseException:
        _delete(spark, f"{root}/{path}")
        raise


def _activate(spark: SparkSession, root: str, read: str | None, held: dict[str, Held]) -> str | None:
    """Write a manifest and move the pointer from ``read`` to it; None if another publisher did so first.

    A marker of the version that was ``read`` can be made once only.
    """
    fs, at = _fs(spark, root)
    if read_pointer(spark, root) != read:
        return None
    try:
        if not fs.createNewFile(at(f"{root}/.{POINTER}.after.{read or 'nothing'}")):
            return None
    except Py4JJavaError as e:
        if "FileAlreadyExists" in str(e.java_exception):
            return None
        raise
    version = f"v{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    fs.mkdirs(at(f"{root}/{VERSIONS}"))
    _put(spark, f"{root}/{VERSIONS}/{version}.json", json.dumps({"schema_version": 4, "books": [asdict(b) for b in held.values()]}))
    _put(spark, f"{root}/{POINTER}", json.dumps({"version": version, "schema_version": 4}))
    return version


def vacuum(spark: SparkSession, root: str, keep: int = 2, spared: float = SPARED_SECONDS) -> list[str]:
    """Delete all but the active and the ``keep`` latest versions, and the folders of books that none of them names.

    Folders younger than ``spared`` seconds stay: a publisher may be writing them.  Gives the folders that went.
    """
    fs, at = _fs(spark, root)
    if not fs.exists(at(f"{root}/{VERSIONS}")):
        return []
    versions = sorted(f.getPath().getName().removesuffix(".json") for f in fs.listStatus(at(f"{root}/{VERSIONS}")) if f.getPath().getName().startswith("v"))
    stay = {*(versions[-keep:] if keep else []), read_pointer(spark, root)} - {None}
    named = {b.path for v in stay for b in manifest(spark, root, v).values()}
    for v in set(versions) - stay:
        _delete(spark, f"{root}/{VERSIONS}/{v}.json")
    gone, before = [], (time.time() - spared) * 1000
    for shelf in fs.listStatus(at(f"{root}/books")):
        for folder in fs.listStatus(shelf.getPath()):
            path = f"books/{shelf.getPath().getName()}/{folder.getPath().getName()}"
            if path not in named and folder.getModificationTime() <= before:
                _delete(spark, f"{root}/{path}")
                gone.append(path)
    return gone


# --- exports -----------------------------------------------------------------------


def write_records(df: DataFrame, path: str) -> None:
    """Export as JSON lines."""
    df.write.mode("overwrite").json(path)
