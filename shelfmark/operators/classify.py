"""What kind of file something is, by its first bytes and its name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.paths import basename, extension, initial

# Extensions of each category.
OFFICE_DOCUMENTS = ("docx", "docm", "dotx", "dotm", "pptx", "pptm", "ppsx", "potx", "odt", "odp", "epub")
OFFICE_DATA = ("xlsx", "xlsm", "xltx", "ods")
BY_EXTENSION = {
    "document": ("md", "txt", "rtf", "pdf", "doc", "docx", "docm", "dotx", "ppt", "pptx", "pptm", "ppsx", "potx", "pages", "odt", "odp", "epub"),
    "image": ("png", "jpg", "jpeg", "gif", "webp", "heic"),
    "audio": ("mp3", "wav", "flac", "m4a", "aac"),
    "video": ("mp4", "mov", "mkv", "avi", "webm"),
    "archive": ("zip", "gz", "7z", "rar", "tar"),
    "code": ("rs", "py", "js", "ts", "go", "java", "c", "cpp", "swift"),
    "data": ("csv", "tsv", "json", "xml", "yaml", "yml", "toml", "xls", "xlsx", "xlsm", "xltx", "numbers", "ods"),
}
# The older grouping, with its labels.
GROUPS = {
    "图片": ("jpg", "jpeg", "png", "gif", "webp", "svg", "heic", "avif", "bmp", "tiff"),
    "文档": ("pdf", "doc", "docx", "xls", "xlsx", "ppt", "pptx", "txt", "md", "rtf", "pages", "numbers"),
    "音视频": ("mp3", "wav", "m4a", "flac", "aac", "mp4", "mov", "avi", "mkv", "webm"),
    "压缩包": ("zip", "rar", "7z", "tar", "gz", "bz2", "xz"),
    "代码": ("js", "ts", "html", "css", "json", "py", "java", "c", "cpp", "h", "go", "rs", "jsx", "tsx"),
}
OTHER_GROUP = "其他文件"
# Further extensions whose media type is image, audio or video.
MEDIA_TYPES = {"图片": ("ico", "tif", "jpe", "ief", "pbm", "pgm", "ppm", "pnm", "ras", "rgb", "xbm", "xpm", "xwd", "heif"), "音视频": ("mpeg", "mpg", "mpe", "m1v", "mpa", "qt", "3gp", "3g2", "opus", "ogg", "aif", "aiff", "aifc", "au", "snd", "mp2", "ra", "movie", "adts", "ass", "rst")}
# First bytes of known formats, and the extensions they go with.
MAGIC = (
    ("255044462D", ("pdf",)),
    ("89504E470D0A1A0A", ("png",)),
    ("FFD8FF", ("jpg", "jpeg")),
    ("504B0304", ("zip", "docx", "xlsx", "pptx", "jar")),
    ("526172211A07", ("rar",)),
    ("377ABCAF271C", ("7z",)),
)
LABELS = {"document": "文档", "image": "图片", "audio": "音频", "video": "视频", "archive": "压缩包", "code": "代码", "data": "数据", "other": "其他"}


def starts(header: Column, digits: str) -> Column:
    return F.coalesce(F.hex(header).startswith(digits), F.lit(False))


def first_case(cases: list[tuple[Column, Column]], otherwise: Column) -> Column:
    out = F
    for condition, value in cases:
        out = out.when(condition, value)
    return out.otherwise(otherwise)


def classify(path: Column, header: Column) -> Column:
    """Struct of ``category``, ``confidence`` and ``reason``: container, then first bytes, then extension."""
    ext = extension(path)

    def told(category: str, confidence: float, reason: str) -> Column:
        return F.struct(F.lit(category).alias("category"), F.lit(confidence).alias("confidence"), F.lit(reason).alias("reason"))

    zipped = starts(header, "504B0304")
    cases = [
        (zipped & ext.isin(*OFFICE_DOCUMENTS), told("document", 0.96, "container_format")),
        (zipped & ext.isin(*OFFICE_DATA), told("data", 0.96, "container_format")),
        (starts(header, "255044462D"), told("document", 0.99, "magic_bytes")),
        (starts(header, "89504E470D0A1A0A") | starts(header, "FFD8FF"), told("image", 0.99, "magic_bytes")),
        (zipped | starts(header, "1F8B"), told("archive", 0.99, "magic_bytes")),
        *[(ext.isin(*known), told(category, 0.82, "extension")) for category, known in BY_EXTENSION.items()],
    ]
    return first_case(cases, told("other", 0.2, "extension"))


def group(path: Column) -> Column:
    """The older grouping by extension, then by media type."""
    ext = extension(path)
    cases = [(ext.isin(*known), F.lit(label)) for table in (GROUPS, MEDIA_TYPES) for label, known in table.items()]
    return first_case(cases, F.lit(OTHER_GROUP))


def group_by_rule(path: Column, modified_ns: Column, rule: str) -> Column:
    """By ``date`` (year and month, UTC sessions), ``name`` (initial) or type."""
    if rule == "date":
        return F.date_format(F.timestamp_seconds(F.floor(modified_ns / 1_000_000_000)), "yyyy-MM")
    return initial(basename(path)) if rule == "name" else group(path)


def allowed_extensions(header: Column) -> Column:
    """The extensions that go with the first bytes; an empty array if they are unknown."""
    cases = [(starts(header, digits), F.array(*map(F.lit, known))) for digits, known in MAGIC]
    return first_case(cases, F.array().cast("array<string>"))


def suspicious(path: Column, header: Column) -> Column:
    """Whether the format is known and the extension is not one of its own."""
    allowed = allowed_extensions(header)
    return (F.size(allowed) > 0) & ~F.array_contains(allowed, extension(path))


def label(category: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair]), category), F.lit(LABELS["other"]))
