"""Archives and container images, opened into rows.

unpack() is the only Python code of the engine: one task opens one archive at a time and streams
its entries out, so memory is bounded by the entry cap. Image blobs are found by equi-joins.
"""

from __future__ import annotations

import gzip
import io
import lzma
import tarfile
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import text
from ..schemas import MANIFEST
from .select import FileFilter, is_manifest, is_text, text_name

MOST_ENTRIES = 20_000
CONFIG_CAP = 4 << 20
DEFAULT_ENTRY = 16 << 20
_BATCH = 8 << 20
_CHUNK = 1 << 16
_DAMAGE = (zipfile.BadZipFile, tarfile.TarError, OSError, EOFError, zlib.error, lzma.LZMAError, RuntimeError, NotImplementedError, ValueError)


def budget(max_file: int) -> int:
    """Bytes that one archive may unfold to."""
    return min(max(64 * max_file, 256 << 20), 1 << 30) if max_file > 0 else 512 << 20


def kind_of(name: str) -> str:
    low = name.lower()
    if low.endswith((".tgz", ".tar.gz", ".crate")):
        return "tgz"
    if low.endswith((".tar", ".gem")):
        return "tar"
    return "gz" if low.endswith(".gz") else "zip"


class _Guard:
    """Bounds on one archive: every entry counts, bytes only where an entry is read."""

    def __init__(self, max_file: int, files: FileFilter):
        self.most, self.cap = max_file, max_file if max_file > 0 else DEFAULT_ENTRY
        self.left, self.entries, self.files = budget(max_file), 0, files

    def more(self) -> bool:
        self.entries += 1
        return self.entries <= MOST_ENTRIES and self.left > 0

    def looked(self, name: str, size: int) -> bool:
        return text_name(name, self.files) and (self.most <= 0 or size <= self.most)

    def read(self, stream) -> bytes:
        """An entry up to the cap; of a damaged one, what comes before the damage."""
        parts, n = [], 0
        try:
            while n < self.cap and (data := stream.read(min(_CHUNK, self.cap - n))):
                parts.append(data)
                n += len(data)
        except _DAMAGE:
            pass
        self.left -= n
        return b"".join(parts)


def _zip(data: bytes, guard: _Guard) -> Iterator[tuple[str, bytes]]:
    """Files; one that cannot be opened is passed over, and a wrong checksum does not count."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        for info in z.infolist():
            if info.is_dir():
                continue
            if not guard.more():
                return
            if not guard.looked(info.filename, info.file_size):
                continue
            try:
                f = z.open(info)
            except _DAMAGE:
                continue
            with f:
                f._expected_crc = None
                got = guard.read(f)
            yield info.filename, got


def _tar(stream, guard: _Guard) -> Iterator[tuple[str, bytes]]:
    """Regular files; a damaged rest ends the archive silently, as long as something was read."""
    with tarfile.open(fileobj=stream, mode="r|") as t:
        try:
            for info in t:
                if not info.isfile():
                    continue
                if not guard.more():
                    return
                if guard.looked(info.name, info.size):
                    yield info.name, guard.read(t.extractfile(info))
        except (tarfile.TarError, EOFError, OSError, zlib.error):
            return


def entries(data: bytes, name: str, max_file: int, files: FileFilter = FileFilter()) -> Iterator[tuple[str, bytes, bool]]:
    """(inner name, bytes, whether its name decides if it is looked at) of an archive's entries that are looked at."""
    guard, kind = _Guard(max_file, files), kind_of(name)
    if kind == "zip":
        yield from ((n, d, True) for n, d in _zip(data, guard))
    elif kind == "tar":
        yield from ((n, d, True) for n, d in _tar(io.BytesIO(data), guard))
    elif kind == "tgz":
        yield from ((n, d, True) for n, d in _tar(gzip.GzipFile(fileobj=io.BytesIO(data)), guard))
    else:
        base = name.rsplit("/", 1)[-1]
        yield base.removesuffix(".gz"), gzip.GzipFile(fileobj=io.BytesIO(data)).read(guard.cap), False


def layer_entries(data: bytes, max_file: int, files: FileFilter = FileFilter()) -> Iterator[tuple[str, bytes, bool]]:
    """Entries of an image layer, compressed or not, that are looked at."""
    stream = gzip.GzipFile(fileobj=io.BytesIO(data)) if data[:2] == b"\x1f\x8b" else io.BytesIO(data)
    yield from ((n, d, True) for n, d in _tar(stream, _Guard(max_file, files)))


def unpack(items: DataFrame, max_file: int = 5 << 20, layers: bool = False, files: FileFilter = FileFilter()) -> DataFrame:
    """A row for each entry of each archive (or image layer): the item's other columns, inner, content, and error.

    Entries are kept by their names, as listed files are; binary ones are dropped. An archive that cannot be
    opened gives one row with error and no content.
    """
    keep = [c for c in items.columns if c != "content"]
    out = T.StructType([*[items.schema[c] for c in keep], T.StructField("inner", T.StringType()), T.StructField("named", T.BooleanType()), T.StructField("content", T.BinaryType()), T.StructField("error", T.StringType())])
    arrow = to_arrow_schema(out)

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    def run(batches):
        rows, size = [], 0
        for b in batches:
            others = list(zip(*(b.column(c).to_pylist() for c in keep), strict=True))
            for other, name, data in zip(others, b.column("name").to_pylist(), b.column("content"), strict=True):
                raw = data.as_py() or b""
                try:
                    for inner, content, named in layer_entries(raw, max_file, files) if layers else entries(raw, name, max_file, files):
                        rows.append([*other, inner, named, content, None])
                        size += len(content)
                        if size > _BATCH:
                            yield batch(rows)
                            rows, size = [], 0
                except (zipfile.BadZipFile, tarfile.TarError, OSError, EOFError, zlib.error, RuntimeError, NotImplementedError) as e:
                    rows.append([*other, None, False, None, f"{type(e).__name__}: {e}"])
        if rows:
            yield batch(rows)

    opened = items.mapInArrow(run, out)
    looked = F.col("error").isNotNull() | ((~F.col("named") | is_text(F.col("inner"), files)) & ~text.is_binary(F.col("content")))
    return opened.where(looked).drop("named")


def archive_errors(unpacked: DataFrame) -> DataFrame:
    return unpacked.where("error is not null").select("repo", "path", "name", "sha256", "size", F.lit("archive").alias("kind"), "error")


# images


def blob_name(digest: Column) -> Column:
    """A digest as the name of its blob: the first colon becomes two underscores."""
    return F.regexp_replace(digest, "^([^:]*):", "$1__")


def short_digest(digest: Column) -> Column:
    return F.left(F.regexp_replace(digest, "^sha256:", ""), F.lit(12))


def image_blobs(items: DataFrame, configs: bool = True, layers: bool = False, max_layer: int = 100 << 20) -> DataFrame:
    """Blobs that the manifests among items name: repo, path and name of the manifest, digest, role (config or layer), blob.

    A digest has one row for each folder that names it, by the first manifest there; fetched() takes one of them. Manifest lists name none.
    """
    read = items.where(is_manifest(F.col("name"))).withColumn("_m", F.from_json(F.col("content").cast("string"), MANIFEST))
    config = read.select("repo", "path", "name", F.col("_m.config.digest").alias("digest"), F.lit("config").alias("role"), F.lit(0).cast("long").alias("layer_size"))
    layer = read.select("repo", "path", "name", F.explode("_m.layers").alias("_l")).select("repo", "path", "name", F.col("_l.digest").alias("digest"), F.lit("layer").alias("role"), F.col("_l.size").alias("layer_size"))
    layer = layer.where(F.coalesce("layer_size", F.lit(0)) <= max_layer)
    named = (config.unionByName(layer) if layers and configs else config if configs else layer).where(F.coalesce("digest", F.lit("")) != "")
    digest = F.trim("digest")
    first = named.groupBy("repo", "path", digest.alias("digest")).agg(F.min(F.struct("name", "role")).alias("_f"))
    return first.select("repo", "path", "_f.*", "digest", blob_name(F.col("digest")).alias("blob"))


def fetched(blobs: DataFrame, items: DataFrame) -> DataFrame:
    """Blobs with their bytes, joined by repository, folder and blob name: each digest once over all images, where it is found first.

    A digest that lies in no folder that names it has a row with error for each of them.
    """
    store = items.select(F.col("repo").alias("_r"), F.col("path").alias("_p"), F.col("name").alias("_n"))
    on = (F.col("repo") == F.col("_r")) & (F.col("path") == F.col("_p")) & (F.col("blob") == F.col("_n"))
    # places are decided without the bytes; these are joined to the places that count, inner, so that the few places can be sent to them
    named = blobs.join(store.distinct(), on, "left").withColumn("_there", F.col("_n").isNotNull()).drop("_r", "_p", "_n")
    place = F.struct("repo", "path")
    taken = named.where("_there").groupBy("digest").agg(F.min(place).alias("_first"))
    chosen = named.join(taken, "digest", "left").where(F.col("_first").isNull() | (F.col("_there") & (place == F.col("_first")))).drop("_first")
    held = items.select(F.col("repo").alias("_r"), F.col("path").alias("_p"), F.col("name").alias("_n"), "content", "size")
    found = chosen.where("_there").join(held, on).drop("_r", "_p", "_n", "_there").withColumn("error", F.lit(None).cast("string"))
    missing = chosen.where("not _there").drop("_there").withColumn("error", F.concat(F.lit("blob not found: "), "blob"))
    return found.unionByName(missing, allowMissingColumns=True)


def image_texts(items: DataFrame, configs: bool = True, layers: bool = False, max_layer: int = 100 << 20, max_file: int = 5 << 20, files: FileFilter = FileFilter()) -> DataFrame:
    """Rows to scan out of images: repo, path, name (the blob's), size, sha256 (empty), inner, content, error, shown.

    A layer's inner is the entry's name. A config is shown under its manifest, as !config:digest.
    """
    blobs = fetched(image_blobs(items, configs, layers, max_layer), items)
    shown = F.concat(text.full_path(F.col("path"), F.col("name")), F.lit("!config:"), short_digest(F.col("digest")))
    got = blobs.withColumns({"sha256": F.lit(""), "inner": F.lit(None).cast("string"), "shown": F.when(F.col("role") == "config", shown), "name": F.col("blob")})
    columns = ["repo", "path", "name", "size", "sha256", "inner", "content", "error", "shown"]
    missing = got.where("error is not null").select(*columns)
    config = got.where("role = 'config' and error is null").withColumn("content", F.substring("content", 1, CONFIG_CAP))
    out = missing.unionByName(config.where(~text.is_binary(F.col("content"))).select(*columns))
    if layers:
        opened = unpack(got.where("role = 'layer' and error is null").select("repo", "path", "name", "size", "sha256", "shown", F.substring("content", 1, max_layer).alias("content")), max_file, layers=True, files=files)
        out = out.unionByName(opened.select(*columns))
    return out
