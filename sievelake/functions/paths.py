"""Predicates and parts of paths, as columns."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extensions and folder names that the selection of files goes by.
# fmt: off
KNOWN_TEXT = [
    ".env", ".ini", ".conf", ".cfg", ".config", ".yaml", ".yml", ".toml", ".json", ".xml", ".properties", ".plist", ".htaccess", ".go", ".py", ".js",
    ".ts", ".java", ".rb", ".php", ".pl", ".sh", ".bash", ".zsh", ".rs", ".c", ".cpp", ".h", ".cs", ".swift", ".kt", ".scala", ".lua", ".groovy",
    ".r", ".html", ".htm", ".jsx", ".tsx", ".vue", ".css", ".scss", ".less", ".sql", ".csv", ".md", ".txt", ".log", ".rst", ".tex", ".tf", ".hcl",
    ".pem", ".key", ".crt", ".cer", ".pub", ".asc", ".der", ".npmrc", ".pypirc", ".gemrc", ".pyi", ".pyx", ".pxd", ".mod", ".sum", ".work", ".proto",
    ".thrift", ".avdl", ".graphql", ".gql", ".svelte", ".astro", ".zig", ".nim", ".v", ".d", ".cmake", ".mk", ".makefile", ".dockerfile",
    ".containerfile", ".tfvars", ".gradle", ".sbt", ".maven", ".bat", ".cmd", ".ps1", ".psm1", ".fish", ".elvish", ".lock", ".golden", ".snap",
    ".wat", ".wast", ".s", ".asm",
]
MEDIA = [
    ".png", ".jpg", ".jpeg", ".gif", ".gifv", ".bmp", ".ico", ".tif", ".tiff", ".psd", ".xcf", ".svg", ".webp", ".mp4", ".avi", ".mkv", ".mov",
    ".flv", ".wmv", ".webm", ".mpeg", ".mpg", ".3gp", ".3g2", ".h264", ".m4v", ".ogv", ".ogm", ".vob", ".swf", ".mp3", ".wav", ".ogg", ".m4a", ".rm",
    ".ttf", ".otf", ".woff", ".woff2", ".eot",
]
EXECUTABLE = [
    ".exe", ".dll", ".so", ".dylib", ".sys", ".drv", ".msi", ".deb", ".rpm", ".pkg", ".class", ".pyc", ".o", ".a",
]
ARCHIVE = [
    ".zip", ".tar", ".gz", ".7z", ".rar", ".apk", ".jar", ".iso",
]
DOCUMENT = [
    ".pdf", ".doc", ".ppt", ".xls", ".xlsx",
]
OTHER = [
    ".lock", ".map", ".axd", ".csv",
]
SKIPPED_FOLDERS = [
    "node_modules", "bower_components", "__pycache__", ".tox", ".eggs", ".svn", ".hg", ".idea", ".vscode", ".gradle", ".cache", ".local", ".npm",
    ".yarn", ".cargo", ".rustup", ".goenv", ".rbenv", ".pyenv", ".nvm", "site-packages",
]
# fmt: on
# First bytes (hexadecimal) of kinds of files.
MAGIC = {
    "image/png": "89504E470D0A1A0A", "image/jpeg": "FFD8FF", "image/gif": "47494638", "application/pdf": "25504446", "application/zip": "504B0304",
    "application/gzip": "1F8B08", "application/x-bzip2": "425A68", "application/x-7z-compressed": "377ABCAF271C", "application/x-executable": "7F454C46",
}


@dataclass(frozen=True)
class Filters:
    """The lists that select files; replace any of them to override the defaults."""

    media: tuple[str, ...] = tuple(MEDIA)
    executable: tuple[str, ...] = tuple(EXECUTABLE)
    archive: tuple[str, ...] = tuple(ARCHIVE)
    document: tuple[str, ...] = tuple(DOCUMENT)
    other: tuple[str, ...] = tuple(OTHER)
    skipped_folders: tuple[str, ...] = tuple(SKIPPED_FOLDERS)
    known_text: tuple[str, ...] = field(default=tuple(KNOWN_TEXT))

    def denied(self, archive: bool = False) -> list[str]:
        """The extensions denied by default, archives among them unless they are asked for."""
        return [*self.media, *self.executable, *self.document, *self.other, *(() if archive else self.archive)]


DEFAULTS = Filters()


def base(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/\\]*$", 0)


def folder(path: Column) -> Column:
    """Everything before the last step, with its separator."""
    return F.regexp_extract(path, r"^.*[/\\]", 0)


def extension(path: Column) -> Column:
    """From the last dot of the last step, as it is spelled: ``.env`` of ``.env``, ``.gz`` of ``a.tar.gz``."""
    return F.regexp_extract(base(path), r"\.[^.]*$", 0)


def in_skipped_folder(path: Column, filters: Filters = DEFAULTS) -> Column:
    steps = F.split(folder(path), r"[/\\]")
    return F.arrays_overlap(steps, F.array(*[F.lit(x) for x in filters.skipped_folders]))


def always_denied(path: Column, filters: Filters = DEFAULTS) -> Column:
    return extension(path).isin(list(filters.media))


def known_text(path: Column, filters: Filters = DEFAULTS) -> Column:
    return F.lower(extension(path)).isin(list(filters.known_text))


def clean(item: str) -> str:
    """A denied path without doubled separators, ``.`` steps and a trailing separator."""
    steps = [s for s in item.split("/") if s not in ("", ".")]
    return ("/" if item.startswith("/") else "") + "/".join(steps) or "."


def denied(path: Column, items: list[str], root: str = "") -> Column:
    """Whether the path's extension, itself, its name, its folder or any leading part of it is listed."""
    listed = sorted({*items, *map(clean, items)})
    relative = F.when(path.startswith(root), F.substr(path, F.lit(len(root) + 1))).otherwise(path) if root else path
    steps = F.filter(F.split(folder(relative), r"[/\\]"), lambda s: s != "")
    leading = F.transform(F.sequence(F.lit(1), F.greatest(F.size(steps), F.lit(1))), lambda n: F.array_join(F.slice(steps, 1, n), "/"))
    own = F.array(extension(path), path, base(path), relative, folder(path), folder(relative), F.regexp_replace(folder(relative), r"/$", ""))
    slashed = F.transform(leading, lambda p: F.concat(p, F.lit("/")))
    wanted = F.array(*[F.lit(x) for x in listed]) if listed else F.array().cast("array<string>")
    return F.arrays_overlap(F.filter(F.concat(own, leading, slashed), lambda x: x != ""), wanted)


def selected(path: Column, extensions: list[str], denylist: list[str], archive: bool = False, text: Column | None = None, in_archive: bool = False, filters: Filters = DEFAULTS, root: str = "") -> Column:
    """Whether a request takes the file at ``path``.

    An extension listed explicitly is taken, whatever is denied; without
    ``all`` nothing else is. Then the denylist and the default denials hold.
    With ``text``, a column that says whether the content looks like text,
    files of unknown extension are taken only if they do.
    """
    named = [e if e.startswith(".") else "." + e for e in extensions if e != "all"]
    every = "all" in extensions or not extensions
    ok = ~F.coalesce(denied(path, [*filters.denied(archive), *denylist], root), F.lit(False))
    if text is not None and not in_archive:
        ok = ok & (known_text(path, filters) | (extension(path) == "") | text)
    out = F.when(extension(path).isin(named), True) if named else F.when(F.lit(False), True)
    return out.otherwise(ok if every else F.lit(False))


def human_size(text: str | int | None) -> int | None:
    """Bytes of a size such as ``5Mb``; None for ``no`` or nothing."""
    if text is None or text == "" or str(text).strip().lower() == "no":
        return None
    s = str(text).strip().lower().rstrip("b") or "0"
    unit = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30, "t": 1 << 40}.get(s[-1], 1)
    return int(float(s.rstrip("kmgt")) * unit)


def size_text(n: Column) -> Column:
    """A number of bytes for readers."""
    unit = F.when(n >= 1 << 30, F.struct(F.lit("GB").alias("u"), F.lit(float(1 << 30)).alias("d"))).when(n >= 1 << 20, F.struct(F.lit("MB").alias("u"), F.lit(float(1 << 20)).alias("d"))).when(n >= 1 << 10, F.struct(F.lit("KB").alias("u"), F.lit(1024.0).alias("d"))).otherwise(F.struct(F.lit("B").alias("u"), F.lit(1.0).alias("d")))
    return F.concat(F.format_number(n / unit["d"], 1), F.lit(" "), unit["u"])
