"""Image inventory of stored pages: facts, filters, file names."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pagegrid.functions.text import WS, decode_entities, to_text, trim_ws
from pagegrid.functions.urls import let, parts, resolve_on
from pagegrid.plans.ordered import running

c = F.col


def image_ext(url: Column) -> Column:
    """Lower-case extension of the URL path, letters and digits only; 'img' when there is none."""
    raw = trim_ws(to_text(url))
    path = F.coalesce(parts(raw)["path"], F.regexp_extract(raw, r"^([^?#]*)", 1))
    ext = F.regexp_replace(F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1)), "[^a-z0-9]", "")
    return F.when(ext == "", "img").otherwise(ext)


def size_class(width: Column, height: Column) -> Column:
    area = F.greatest(F.lit(0), width).cast("long") * F.greatest(F.lit(0), height).cast("long")
    return F.when(area < 50_000, "small").when(area < 250_000, "medium").otherwise("large")


def inventory(pages: DataFrame) -> DataFrame:
    """(page_id, pos, url, alt, width, height, ext, size_class): first of each http(s) image per page."""
    tags = F.regexp_extract_all(c("html"), F.lit(r"(?is)<img\b[^>]*>"), F.lit(0))

    def attr(tag: Column, name: str) -> Column:
        return decode_entities(F.regexp_extract(tag, rf"""(?is)[\s"']{name}\s*=\s*["']([^"']*)["']""", 1))

    def size(tag: Column, name: str) -> Column:
        return F.greatest(F.lit(0), F.coalesce(attr(tag, name).try_cast("int"), F.lit(0)))

    # addresses are made inside the row, the page's own once, and the other facts only for images that have one
    based = pages.select("page_id", parts(c("url")).alias("base"), tags.alias("tags"))
    linked = F.transform("tags", lambda tag, i: F.struct(i.alias("pos"), tag.alias("tag"), resolve_on(attr(tag, "src"), c("base")).alias("url")))
    found = based.select("page_id", F.explode(F.filter(linked, lambda x: x["url"] != "")).alias("x")).select("page_id", "x.*")
    rows = found.select("page_id", "pos", "url", trim_ws(attr(c("tag"), "alt")).alias("alt"), size(c("tag"), "width").alias("width"), size(c("tag"), "height").alias("height"))
    first = rows.groupBy("page_id", "url").agg(F.min(F.struct("pos", "alt", "width", "height")).alias("r")).select("page_id", "url", "r.*")
    return first.select("page_id", "pos", "url", "alt", "width", "height", image_ext(c("url")).alias("ext"), size_class(c("width"), c("height")).alias("size_class"))


def filter_images(images: DataFrame, search: str = "", min_width: int = 0, min_height: int = 0, ext: str = "", size: str = "", alt: str = "") -> DataFrame:
    q = search.strip().lower()
    keep = (c("width") >= min_width) & (c("height") >= min_height)
    if q:
        keep = keep & (F.lower("url").contains(q) | F.lower("alt").contains(q))
    if ext.strip():
        keep = keep & (F.lower("ext") == ext.strip().lower())
    if size.strip():
        keep = keep & (c("size_class") == size.strip().lower())
    if alt == "has":
        keep = keep & (trim_ws(c("alt")) != "")
    elif alt == "none":
        keep = keep & (trim_ws(c("alt")) == "")
    return images.filter(keep)


def safe_segment(value: Column, fallback: Column | str) -> Column:
    v = F.regexp_replace(trim_ws(to_text(value)), r"""[<>:"/\\|?*\x00-\x1f]+""", "_")
    v = F.regexp_replace(F.regexp_replace(v, f"{WS}+", "_"), "^_+|_+$", "")
    return F.coalesce(F.nullif(v, F.lit("")), F.lit(fallback) if isinstance(fallback, str) else fallback)


def file_name(index: Column, pattern: str = "image_{index}_{width}x{height}.{ext}", most: int | None = None) -> Column:
    """File name of an image row from a pattern of six tokens; unsafe characters replaced; cut to ``most`` characters if given."""
    host = let(parts(c("url")), lambda p: F.concat(p["host"], F.when(p["port"] == "", F.lit("")).otherwise(F.concat(F.lit(":"), p["port"]))))
    ext = safe_segment(c("ext"), "img")
    out = F.lit(pattern)
    for token, value in {
        "{index}": index.cast("string"), "{width}": c("width").cast("string"), "{height}": c("height").cast("string"), "{ext}": ext,
        "{host}": safe_segment(F.coalesce(host, F.lit("site")), "site"), "{alt}": safe_segment(c("alt"), "image"),
    }.items():
        out = F.replace(out, F.lit(token), value)
    out = safe_segment(out, F.concat(F.lit("image_"), index.cast("string")))
    named = F.when(out.rlike(r"(?i)\.[a-z0-9]{2,5}$"), out).otherwise(F.concat(out, F.lit("."), ext))
    return F.left(named, F.lit(most)) if most else named


def name_files(images: DataFrame, pattern: str = "image_{index}_{width}x{height}.{ext}") -> DataFrame:
    """Number the images of each page in order and name them; a page's numbering may span tasks."""
    return running(images, ["page_id"], ["pos", "url"], number="index").withColumn("file_name", file_name(c("index"), pattern))
