"""Paths, file names and file types by their first bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RESERVED = ("CON", "PRN", "AUX", "NUL", *(f"COM{i}" for i in range(1, 10)), *(f"LPT{i}" for i in range(1, 10)))
# Fixed values: (type, offset, hexadecimal bytes); the first that holds counts.
MAGIC = (
    ("png", 0, "89504E470D0A1A0A"), ("jpeg", 0, "FFD8FF"), ("gif", 0, "47494638"), ("webp", 8, "57454250"), ("bmp", 0, "424D"), ("tiff", 0, "49492A00"), ("tiff", 0, "4D4D002A"),
    ("ico", 0, "00000100"), ("psd", 0, "38425053"), ("pdf", 0, "255044462D"), ("rtf", 0, "7B5C727466"), ("ole", 0, "D0CF11E0A1B11AE1"), ("zip", 0, "504B0304"), ("zip", 0, "504B0506"),
    ("gzip", 0, "1F8B"), ("bzip2", 0, "425A68"), ("xz", 0, "FD377A585A00"), ("zstd", 0, "28B52FFD"), ("lz4", 0, "04224D18"), ("7z", 0, "377ABCAF271C"), ("rar", 0, "526172211A07"),
    ("tar", 257, "7573746172"), ("elf", 0, "7F454C46"), ("pe", 0, "4D5A"), ("macho", 0, "CFFAEDFE"), ("macho", 0, "CEFAEDFE"), ("class", 0, "CAFEBABE"), ("wasm", 0, "0061736D"),
    ("sqlite", 0, "53514C69746520666F726D6174203300"), ("parquet", 0, "50415231"), ("avro", 0, "4F626A01"), ("orc", 0, "4F5243"), ("mp3", 0, "494433"), ("flac", 0, "664C6143"), ("ogg", 0, "4F676753"),
    ("wav", 8, "57415645"), ("avi", 8, "41564920"), ("mp4", 4, "66747970"), ("mkv", 0, "1A45DFA3"), ("flv", 0, "464C56"), ("woff", 0, "774F4646"), ("woff2", 0, "774F4632"),
    ("pem", 0, "2D2D2D2D2D424547494E"), ("xml", 0, "3C3F786D6C"), ("html", 0, "3C21444F43545950452068746D6C"), ("shebang", 0, "2321"),
)


def file_type(content: Column) -> Column:
    """Type of a binary value by its first bytes; null if none fits."""
    out = F.lit(None).cast("string")
    for name, offset, code in reversed(MAGIC):
        out = F.when(F.hex(F.substring(content, offset + 1, len(code) // 2)) == code, name).otherwise(out)
    return out


def name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def parent(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)[/\\][^/\\]*$", 1)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(name(path), r"[^.]\.([A-Za-z0-9]+)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(name(path), r"(?<=[^.])\.[A-Za-z0-9]+$", "")


def normalize(path: Column) -> Column:
    """Forward slashes, no doubled ones, no `.` parts, and `..` resolved where a part stands before it."""
    out = F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), "/+", "/")
    absolute = out.startswith("/")
    parts = F.filter(F.split(out, "/"), lambda p: (p != "") & (p != "."))
    step = lambda acc, p: F.when((p == "..") & (F.size(acc) > 0) & (F.coalesce(F.element_at(acc, -1), F.lit("..")) != ".."), F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).when((p == "..") & absolute, acc).otherwise(F.concat(acc, F.array(p)))
    kept = F.aggregate(parts, F.array().cast("array<string>"), step)
    return F.concat(F.when(absolute, "/").otherwise(""), F.array_join(kept, "/"))


def is_within(path: Column, base: str) -> Column:
    """Whether a path, taken under `base`, stays under it."""
    root = base.rstrip("/")
    full = normalize(F.when(path.startswith("/"), path).otherwise(F.concat(F.lit(root + "/"), path)))
    return (full == root) | full.startswith(root + "/")


def safe_name(value: Column, max_length: int = 255, by: str = "_") -> Column:
    """A file name without separators, control characters and reserved names."""
    out = F.regexp_replace(F.trim(value), r'[\x00-\x1F<>:"/\\|?*]', by)
    out = F.regexp_replace(out, r"^\.+|[. ]+$", "")
    out = F.when(F.upper(F.regexp_extract(out, r"^[^.]*", 0)).isin(*RESERVED), F.concat(F.lit(by), out)).otherwise(out)
    return F.when(F.length(out) == 0, "unnamed").otherwise(F.substring(out, 1, max_length))


def is_hidden(path: Column) -> Column:
    return name(path).startswith(".")


def is_absolute(path: Column) -> Column:
    return path.rlike(r"^(?:/|[A-Za-z]:[/\\]|\\\\)")


def category(path: Column) -> Column:
    e = extension(path)
    return (
        F.when(e.isin("jpg", "jpeg", "png", "gif", "bmp", "svg", "webp", "tiff", "ico"), "image").when(e.isin("mp4", "avi", "mov", "mkv", "webm"), "video")
        .when(e.isin("mp3", "wav", "flac", "ogg", "aac"), "audio").when(e.isin("pdf", "doc", "docx", "odt", "rtf", "txt", "md"), "document")
        .when(e.isin("zip", "tar", "gz", "bz2", "xz", "7z", "rar", "zst"), "archive").when(e.isin("exe", "dll", "so", "dylib", "bat", "cmd", "ps1", "sh", "msi"), "executable")
        .when(e.isin("rs", "py", "js", "ts", "go", "java", "c", "cpp", "h", "rb", "sql"), "code").when(e.isin("json", "xml", "yaml", "yml", "toml", "csv", "parquet", "avro", "orc"), "data")
        .when(e.isin("pem", "key", "crt", "cer", "p12", "pfx", "jks"), "credential").when(e == "", "none").otherwise("other")
    )
