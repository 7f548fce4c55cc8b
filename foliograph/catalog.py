"""Formats, conversion edges, rule lists. Everything here is a constant
that decides results, so it is stated plainly and turned into small tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# --- fixed values: extension aliases ---
EXT_ALIASES = {
    "jpeg": "jpg",
    "yml": "yaml",
    "tif": "tiff",
    "markdown": "md",
    "latex": "tex",
    "heif": "heic",
}

# --- fixed values: format families ---
RASTER = ["png", "jpg", "webp", "bmp", "tiff", "gif"]
VIDEO = ["mp4", "mov", "mkv", "webm", "avi"]
AUDIO = ["mp3", "aac", "flac", "ogg", "wav", "opus", "m4a"]
MEDIA = VIDEO + AUDIO

ALWAYS = "always"
MACOS = "macos"

# --- fixed values: which formats convert into which, and under which capability ---
# (sources, targets, capability, price list); a format never converts into itself
CONVERSIONS = [
    (RASTER + ["avif"], RASTER + ["avif"], ALWAYS, "image"),
    (RASTER + ["avif"], ["heic"], MACOS, "image"),
    (RASTER + ["avif"], ["pdf"], ALWAYS, "image"),
    (["heic"], ["jpg", "png", "tiff", "gif", "bmp", "pdf"], MACOS, "image"),
    (VIDEO, VIDEO + ["gif"], ALWAYS, "media"),
    (AUDIO, AUDIO, ALWAYS, "media"),
    (["json", "yaml", "toml"], ["json", "yaml", "toml", "csv"], ALWAYS, "data"),
    (["csv"], ["json", "yaml"], ALWAYS, "data"),
    (["md"], ["txt", "html", "pdf", "tex", "typst"], ALWAYS, "document"),
    (["txt"], ["md", "html", "pdf", "tex", "typst"], ALWAYS, "document"),
    (["tex"], ["md", "html", "pdf", "typst"], ALWAYS, "document"),
    (["typst"], ["md", "html", "pdf", "tex"], ALWAYS, "document"),
    (["epub"], ["pdf", "mobi", "md", "html"], ALWAYS, "document"),
    (["mobi"], ["epub", "pdf", "html", "md"], ALWAYS, "document"),
    (["pdf"], ["epub", "mobi", "html", "md"], ALWAYS, "extraction"),
]

# --- fixed values: price lists; "*" is the price of every target not named ---
PRICES = {
    "image": {"*": 2, "jpg": 4, "avif": 4, "heic": 4, "pdf": 6},
    "media": {"*": 4},
    "data": {"*": 1},
    "document": {"*": 4, "pdf": 6},
    "extraction": {"*": 8},
}

# --- fixed values: pairs that are never offered although a route exists ---
BLOCKED_PAIRS = [("csv", "toml")]
MAX_HOPS = 6

# --- fixed values: which handler performs a hop; None means any target ---
HANDLERS = [
    (RASTER + ["avif", "heic"], ["pdf"], "image_to_pdf"),
    (RASTER, ["avif"], "image_to_avif"),
    (RASTER + ["avif"], ["heic"], "image_to_heic"),
    (RASTER + ["avif"], ["gif"], "image_to_gif"),
    (RASTER + ["avif"], ["png", "jpg", "webp", "bmp", "tiff"], "image_generic"),
    (["heic"], ["jpg", "png", "tiff", "gif", "bmp"], "heic_input"),
    (MEDIA, None, "media"),
    (["json", "yaml", "toml", "csv"], None, "data"),
    (["mobi"], None, "mobi_input"),
    (["epub"], ["mobi"], "epub_to_mobi"),
    (["epub"], ["md", "html", "pdf"], "document"),
    (["pdf"], ["mobi"], "pdf_to_mobi"),
    (["pdf"], ["html"], "pdf_to_html"),
    (["pdf"], ["md"], "pdf_to_md"),
    (["pdf"], ["epub"], "pdf_to_epub"),
    (["md", "txt", "tex", "typst"], None, "document"),
]

# --- fixed values: reader and writer names of a document format ---
FORMAT_NAMES = [
    # ext, reader, writer
    ("md", "markdown", "markdown"),
    ("markdown", "markdown", "markdown"),
    ("txt", "markdown", "plain"),
    ("tex", "latex", "latex"),
    ("latex", "latex", "latex"),
    ("typst", "typst", "typst"),
    ("epub", "epub", "epub"),
    ("pdf", "pdf", "pdf"),
]

# --- fixed values: encoder arguments per media target, and the encoder they need if it is not always there ---
ENCODER_ARGS = [
    ("mp3", "-codec:a libmp3lame -q:a 2"),
    ("aac", "-codec:a aac -b:a 192k"),
    ("flac", "-codec:a flac"),
    ("opus", "-codec:a libopus -b:a 128k"),
    ("wav", "-codec:a pcm_s16le"),
    ("m4a", "-vn -codec:a aac -b:a 192k"),
    (
        "gif",
        "-vf fps=15,scale=480:-1:flags=lanczos,split[s0][s1];[s0]palettegen[p];[s1][p]paletteuse",
    ),
    ("webm", "-codec:v libvpx-vp9 -codec:a libopus"),
    ("ogg", "-codec:a vorbis -strict -2 -ac 2 -q:a 4"),
]
SPECIAL_ENCODER_ARGS = [("ogg", "libvorbis", "-codec:a libvorbis -q:a 4")]

# --- fixed values: content type to extension, best first within a class ---
IMAGE_TYPES = [
    ("image/jpeg", "jpg"),
    ("image/png", "png"),
    ("image/gif", "gif"),
    ("image/webp", "webp"),
    ("image/tiff", "tif"),
    ("image/bmp", "bmp"),
]
IMAGE_TYPE_IDS = [
    ("public.jpeg", "jpg"),
    ("public.png", "png"),
    ("com.compuserve.gif", "gif"),
    ("org.webmproject.webp", "webp"),
    ("public.heic", "heic"),
    ("public.avif", "avif"),
]
DOCUMENT_TYPE_IDS = [
    ("com.adobe.pdf", "pdf"),
    ("org.openxmlformats.wordprocessingml.document", "docx"),
    ("com.microsoft.word.doc", "doc"),
    ("org.openxmlformats.presentationml.presentation", "pptx"),
    ("com.microsoft.powerpoint.ppt", "ppt"),
    ("org.openxmlformats.spreadsheetml.sheet", "xlsx"),
    ("com.microsoft.excel.xls", "xls"),
    ("org.idpf.epub-container", "epub"),
    ("public.mpeg-4", "mp4"),
    ("com.apple.quicktime-movie", "mov"),
    ("public.avi", "avi"),
    ("public.mpeg-2-video", "mpg"),
    ("public.3gpp", "3gp"),
    ("public.mp3", "mp3"),
    ("public.mpeg-4-audio", "m4a"),
    ("public.aiff-audio", "aiff"),
    ("com.microsoft.waveform-audio", "wav"),
    ("com.apple.coreaudio-format", "caf"),
    ("org.xiph.flac", "flac"),
    ("org.xiph.ogg", "ogg"),
]
MARKUP_TYPE_IDS = [("public.rtf", "rtf"), ("public.html", "html")]

# --- fixed values: type id an image extension is offered under ---
NATIVE_TYPE_IDS = {
    "png": "public.png",
    "jpg": "public.jpeg",
    "jpeg": "public.jpeg",
    "gif": "com.compuserve.gif",
    "tiff": "public.tiff",
    "tif": "public.tiff",
    "bmp": "com.microsoft.bmp",
    "webp": "org.webmproject.webp",
    "heic": "public.heic",
    "heif": "public.heic",
    "avif": "public.avif",
}

# --- fixed values: which representation of an item wins, with and without rich types ---
REPRESENTATION_ORDER = ["file", "raw_image", "document", "text", "image", "markup"]
PLAIN_REPRESENTATION_ORDER = ["file", "raw_image", "image"]

# --- fixed values: PDF engines in order of preference ---
ENGINE_ORDER = ["tectonic", "xelatex", "pdflatex", "lualatex", "wkhtmltopdf", "typst"]

# --- fixed values: log keyword to percent done ---
STAGES = [
    ("load model", 5.0),
    ("detection model", 8.0),
    ("texify", 12.0),
    ("recognition model", 12.0),
    ("surya", 14.0),
    ("reading pdf", 18.0),
    ("pdf loaded", 20.0),
    ("running layout", 28.0),
    ("layout detection", 28.0),
    ("running ocr", 38.0),
    ("text extraction", 40.0),
    ("running line", 44.0),
    ("post-processing", 60.0),
    ("ordering blocks", 65.0),
    ("merging lines", 68.0),
    ("cleaning text", 72.0),
    ("formatting", 75.0),
    ("saving output", 88.0),
    ("writing markdown", 88.0),
    ("saved to", 90.0),
]
STAGE_START = 2.0

# --- fixed values: error fragment to missing dependency, first match wins ---
ERROR_RULES = [
    ("pandoc not found", "pandoc"),
    ("pymupdf4llm not found", "pymupdf"),
    ("ebook-convert not found", "ebook-convert"),
    ("ffmpeg not found", "ffmpeg"),
]

# --- fixed values: attributes a page takes from its ancestors ---
INHERITED_KEYS = ["MediaBox", "Resources", "Rotate", "CropBox"]

# --- fixed values: the nodes a merged document gets ---
PAGES_NODE, CATALOG_NODE = "Pages", "Catalog"

# --- fixed values: settings defaults ---
SETTING_DEFAULTS = {"jpeg_quality": 75, "avif_quality": 65, "max_concurrent": 4, "output_mode": "clipboard"}

# --- fixed values: texts of errors and refusals; {} stands for what they are about ---
ERRORS = {
    "unsupported_type": "Unsupported file type: .{}",
    "no_path": "No conversion path from .{} to {}",
    "no_handler": "No converter handles .{} → {}",
    "not_pdf": "Only PDF files can be merged",
    "not_media": "Only audio/video files can be trimmed",
    "too_few": "Need at least 2 PDFs to merge",
    "bad_url": "Invalid local LLM URL '{}': must start with http:// or https://",
    "bad_time": "Invalid time: {}",
    "end_before_start": "End time must be after start time",
    "job_status": "ffmpeg exited with status {}",
    "job_failed": "ffmpeg failed: {}",
    "toml_array": "TOML has no top-level array — only object/map data can convert to TOML",
    "csv_shape": "CSV output requires an array of objects",
    "unsupported_target": "Unsupported target format: {}",
    "unsupported_data": "Unsupported data format: .{}",
}

CHUNK_CHARS = 3000
ERROR_TAIL_LINES = 15
LOG_TAIL_LINES = 300


def error(name: str, *parts: Column) -> Column:
    """An error text with its gaps filled; a missing part is empty, so the text never is NULL."""
    pieces = ERRORS[name].split("{}")
    filled = [x for text, part in zip(pieces[1:], parts) for x in (F.coalesce(part.cast("string"), F.lit("")), F.lit(text))]
    return F.concat(F.lit(pieces[0]), *filled)


def edge_rows() -> list[tuple[int, str, str, int, str]]:
    """(ord, src_fmt, dst_fmt, cost, cond) for every conversion, in listing order."""
    pairs = [
        (src, dst, PRICES[prices].get(dst, PRICES[prices]["*"]), cond)
        for sources, targets, cond, prices in CONVERSIONS
        for src in sources
        for dst in targets
        if src != dst
    ]
    return [(n, *pair) for n, pair in enumerate(pairs)]


def handler_rows() -> list[tuple[str, str, str]]:
    """(src_fmt, dst_fmt, hop_kind) for every edge some handler takes."""
    return [
        (src, dst, kind)
        for _, src, dst, _, _ in edge_rows()
        for sources, targets, kind in HANDLERS
        if src in sources and (targets is None or dst in targets)
    ]


def type_rule_rows() -> list[tuple[str, str, str, int]]:
    """(mime, kind, mapped_ext, priority); a lower priority wins within a kind."""
    classes = [
        ("raw_image", IMAGE_TYPES),
        ("raw_image", IMAGE_TYPE_IDS),
        ("document", DOCUMENT_TYPE_IDS),
        ("markup", MARKUP_TYPE_IDS),
    ]
    rules = [(mime, kind, ext) for kind, rows in classes for mime, ext in rows]
    return [(*rule, n) for n, rule in enumerate(rules)]


def format_rows() -> list[tuple[str, str, str]]:
    return list(FORMAT_NAMES)


def values_sql(rows: list[tuple], columns: str) -> str:
    """An inline table, the same text for Spark and for a checking engine."""

    def literal(value: object) -> str:
        return "'" + value.replace("'", "''") + "'" if isinstance(value, str) else str(value)

    body = ", ".join("(" + ", ".join(literal(v) for v in row) + ")" for row in rows)
    return f"SELECT * FROM (VALUES {body}) AS t({columns})"


def edges(spark: SparkSession) -> DataFrame:
    return spark.sql(values_sql(edge_rows(), "ord, src_fmt, dst_fmt, cost, cond"))


def handlers(spark: SparkSession) -> DataFrame:
    return spark.sql(values_sql(handler_rows(), "src_fmt, dst_fmt, hop_kind"))


def blocked(spark: SparkSession) -> DataFrame:
    return spark.sql(values_sql(BLOCKED_PAIRS, "src_fmt, dst_fmt"))


def type_rules(spark: SparkSession) -> DataFrame:
    return spark.sql(values_sql(type_rule_rows(), "mime, kind, mapped_ext, priority"))


def format_params(spark: SparkSession) -> DataFrame:
    return spark.sql(values_sql(format_rows(), "fmt, reader, writer"))


def encoder_params(spark: SparkSession) -> DataFrame:
    rows = [(fmt, ALWAYS, args) for fmt, args in ENCODER_ARGS] + SPECIAL_ENCODER_ARGS
    return spark.sql(values_sql(rows, "fmt, cond, encoder_args"))
