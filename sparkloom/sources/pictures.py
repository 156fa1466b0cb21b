"""The pictures of presentations and PDF files: a table function that emits a row for each, many or none a file.

Only the listing: where a picture stands, what it is, its size and hash. Rasters are not decoded.
Spark deals the files out; a task reads one file at a time, and a picture of an archive in pieces.
"""

from __future__ import annotations

import hashlib
import io
import re
import xml.etree.ElementTree as ElementTree
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf, udtf

#: Media types by file ending, and why a picture cannot be shown as it is.
MEDIA_TYPES = {
    "jpg": "image/jpeg",
    "jpeg": "image/jpeg",
    "png": "image/png",
    "gif": "image/gif",
    "bmp": "image/bmp",
    "tif": "image/tiff",
    "tiff": "image/tiff",
    "svg": "image/svg+xml",
}
UNKNOWN_TYPE = "application/octet-stream"
COLORSPACE, ENCODING, RASTER = "unsupported_colorspace", "unsupported_encoding", "raster_not_rebuilt"

PICTURE = "page int, slide int, ref string, target string, media_type string, bytes bigint, sha256 string, reason string, problem string"
_PIECE = 1 << 20


def media_type(name: str) -> str:
    return MEDIA_TYPES.get(name.rpartition(".")[2].lower() if "." in name.rpartition("/")[2] else "", UNKNOWN_TYPE)


def _slide_pictures(content: bytes) -> Iterator[tuple]:
    """Follow each slide's relationships to the archive members they name; those that are not there are no pictures."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        members = set(archive.namelist())
        slides = sorted((int(m[1]), name) for name in members if (m := re.fullmatch(r"ppt/slides/_rels/(?:.*/)?\D*slide(\d+)\.xml\.rels", name)))
        for slide, name in slides:
            links = [(x.get("Id", ""), x.get("Target", "")) for x in ElementTree.fromstring(archive.read(name)) if x.get("Type", "").endswith("/image")]
            found = sorted((ref, "ppt/" + re.sub(r"^(\.\./)+", "", target.replace("\\", "/"))) for ref, target in links)
            for ref, target in found:
                if target in members:
                    digest, size = hashlib.sha256(), 0
                    with archive.open(target) as f:
                        while piece := f.read(_PIECE):
                            digest.update(piece)
                            size += len(piece)
                    yield None, slide, ref, target, media_type(target), size, digest.hexdigest(), None, None


def _pdf_media(objects: dict[int, bytes], body: bytes) -> tuple[str, str | None]:
    """Media type of a picture's stream, and why it cannot be shown."""
    space = re.search(rb"/ColorSpace\s*(\[[^\]]*\]|/\w+|\d+\s+\d+\s+R)", body)
    named = space[1] if space else b""
    if link := re.fullmatch(rb"(\d+)\s+\d+\s+R", named.strip()):
        named = objects.get(int(link[1]), named)
    if b"/DeviceCMYK" in named and b"/Indexed" not in named:
        return UNKNOWN_TYPE, COLORSPACE
    if b"/DCTDecode" in body:
        return "image/jpeg", None
    if b"/JPXDecode" in body:
        return "image/jp2", ENCODING
    sized = all(re.search(rb"/" + word + rb"\s+\d+", body) for word in (b"Width", b"Height", b"BitsPerComponent"))
    return UNKNOWN_TYPE, RASTER if b"/FlateDecode" in body and sized and named else ENCODING


def _pdf_pictures(content: bytes) -> Iterator[tuple]:
    """Picture objects with a stream: page by page as the pages refer to them, then those that no page names, on page 0.

    Pages are the objects with ``/Type /Page`` in them by number; the tree's own ``/Type /Pages`` counts as one, too.
    """
    objects = {int(m[1]): m[2] for m in re.finditer(rb"(\d+)\s+\d+\s+obj(.*?)endobj", content, re.DOTALL)}
    streams = {n: m[1] for n, body in objects.items() if b"/Subtype /Image" in body and (m := re.search(rb"stream\r?\n(.*?)\r?\nendstream", body, re.DOTALL)) and m[1]}
    pages = [objects[n] for n in sorted(objects) if b"/Type /Page" in objects[n]]
    linked = [(page, int(n)) for page, body in enumerate(pages, 1) for n in dict.fromkeys(re.findall(rb"/(?:Im|Img)\w*\s+(\d+)\s+0\s+R", body)) if int(n) in streams]
    seen = {n for _, n in linked}
    for page, n in [*linked, *((0, n) for n in sorted(streams) if n not in seen)]:
        kind, reason = _pdf_media(objects, objects[n])
        yield page, None, f"pdf-object-{n}", None, kind, len(streams[n]), hashlib.sha256(streams[n]).hexdigest(), reason, None


@udtf(returnType=PICTURE)
class Pictures:
    """Rows of one file; a file that is none of the two kinds, or broken, is one row with its problem."""

    def eval(self, file_name: str, content: bytes) -> Iterator[tuple]:
        suffix = re.search(r"\.[^./]*$", (file_name or "").lower())
        read = {".pdf": _pdf_pictures, ".pptx": _slide_pictures}.get(suffix[0] if suffix else "")
        if read is None:
            yield (*[None] * 8, f"unsupported visual source type: {suffix[0] if suffix else '<none>'}")
        elif content is None:
            yield (*[None] * 8, "no content")
        else:
            try:
                yield from list(read(bytes(content)))
            except (zipfile.BadZipFile, ElementTree.ParseError, NotImplementedError, RuntimeError, EOFError, KeyError, ValueError, zlib.error) as error:
                yield (*[None] * 8, f"{type(error).__name__}: {error}"[:200])


def pictures(files: DataFrame) -> DataFrame:
    """A row for each picture of files(document_id, file_name, content), or the file's problem.

    page is set for PDF, slide for presentations; ref names the object or relationship, target the
    archive member. artifact_id and storage_path are made of these, so the same picture at the same
    place has the same id always. A file without pictures has no row; a broken one has only its problem,
    whatever could be read before it broke. Repeated files give repeated rows.
    """
    rows = files.select("document_id", "file_name", "content").lateralJoin(Pictures(F.col("file_name").outer(), F.col("content").outer()))
    place = F.when(F.col("page").isNotNull(), F.concat(F.lit("p"), "page")).otherwise(F.concat(F.lit("s"), "slide"))
    doc = F.col("document_id").cast("string")
    seed = F.concat_ws("|", doc, place, F.coalesce(F.nullif("ref", F.lit("")), F.lit("none")), "sha256")
    ending = F.when(F.col("media_type") == "image/jpeg", "jpg").when(F.col("media_type") == "image/jp2", "jp2").otherwise("bin")
    pdf = F.concat(F.lit("artifacts/"), doc, F.lit("/pdf/page-"), "page", F.lit("/"), F.replace("ref", F.lit("pdf-"), F.lit("")), F.lit("."), ending)
    pptx = F.concat(F.lit("artifacts/"), doc, F.lit("/pptx/slide-"), "slide", F.lit("/"), F.element_at(F.split("target", "/"), -1))
    known = F.col("problem").isNull()
    return rows.drop("content", "file_name").withColumns(
        {
            "artifact_id": F.when(known, F.concat(F.lit("va_"), F.left(F.sha1(F.encode(seed, "UTF-8")), F.lit(16)))),
            "storage_path": F.when(known, F.coalesce(pdf, pptx)),
        }
    )


def archives(files: DataFrame) -> DataFrame:
    """(document_id, content): a ZIP archive of each of files(document_id, names, contents), its members stored as they are and dated alike, so equal members give equal bytes."""

    def packed(names: list, contents: list) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for name, content in zip(names, contents, strict=True):
                z.writestr(zipfile.ZipInfo(name), bytes(content))
        return out.getvalue()

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"document_id": batch["document_id"], "content": [packed(a, b) for a, b in zip(batch["names"], batch["contents"], strict=True)]})

    return files.select(F.col("document_id").cast("bigint"), "names", "contents").mapInPandas(pack, "document_id bigint, content binary")


def office_kind(content: Column) -> Column:
    """pptx, xlsx, docx or zip by the members of an archive; null for what is none."""

    @pandas_udf("string")
    def kind(contents: pd.Series) -> pd.Series:
        def of(data: bytes | None) -> str | None:
            try:
                with zipfile.ZipFile(io.BytesIO(data or b"")) as z:
                    tops = {n.partition("/")[0] for n in z.namelist() if "/" in n}
            except zipfile.BadZipFile:
                return None
            return next((name for name, top in (("pptx", "ppt"), ("xlsx", "xl"), ("docx", "word")) if top in tops), "zip")

        return contents.map(of)

    return kind(content)
