"""Functions of paths: kinds, types, junk, prefixes and scopes."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extensions by kind, types by extension, and what marks generated files and folders.
TEXT_EXTENSIONS = [".md", ".txt", ".rst", ".org", ".py", ".js", ".ts", ".json", ".html", ".css", ".sh", ".toml", ".yaml", ".yml", ".csv", ".srt", ".vtt"]
IMAGE_EXTENSIONS = [".jpg", ".jpeg", ".png", ".webp", ".bmp", ".gif", ".tif", ".tiff"]
DOCUMENT_EXTENSIONS = [".pdf", ".docx"]
MIME_TYPES = {
    ".md": "text/markdown", ".txt": "text/plain", ".py": "text/x-python", ".js": "text/javascript", ".json": "application/json", ".html": "text/html",
    ".css": "text/css", ".csv": "text/csv", ".pdf": "application/pdf", ".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".png": "image/png",
    ".webp": "image/webp", ".bmp": "image/bmp", ".gif": "image/gif", ".tif": "image/tiff", ".tiff": "image/tiff", ".gz": "application/gzip",
}
SKIPPED_NAMES = [".git", ".cache", ".vault_rag", ".smart-env", ".obsidian", "node_modules", "__pycache__", ".venv", "site-packages", ".npm", ".cargo", ".rustup", ".pyenv", ".Trash-1000"]
JUNK_FOLDERS = ["node_modules", "dist", "build", ".cache", ".venv", "site-packages", "__pycache__", ".git", ".npm", ".cargo", ".rustup", ".pyenv", "appdata"]
JUNK_SUFFIXES = [".min.js", ".min.css", ".js.map", ".css.map", ".lock", ".sum"]
JUNK_NAMES = ["package-lock.json", "pnpm-lock.yaml"]


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """The extension of the last path part in lower case, with its dot; empty without one or for a leading dot only."""
    return F.lower(F.regexp_extract(basename(path), r"[^.](\.[^.]+)$", 1))


def kind_of(path: Column) -> Column:
    """image, text or file, by the extension."""
    ext = extension(path)
    return F.when(path.isNull(), None).when(ext.isin(IMAGE_EXTENSIONS), "image").when(ext.isin([*TEXT_EXTENSIONS, *DOCUMENT_EXTENSIONS]), "text").otherwise("file")


def mime_of(path: Column) -> Column:
    """The type that goes with the extension, or null."""
    pairs = [F.lit(x) for kv in MIME_TYPES.items() for x in kv]
    return F.create_map(*pairs)[extension(path)]


def is_junk(path: Column) -> Column:
    """Whether any folder of the path, its name or the name's ending marks a generated file, in any letter case."""
    parts = F.split(F.lower(path), "/")
    folders = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    name = F.element_at(parts, -1)
    ends = F.lit(False)
    for s in JUNK_SUFFIXES:
        ends = ends | name.endswith(s)
    return F.arrays_overlap(folders, F.array(*map(F.lit, JUNK_FOLDERS))) | name.isin(JUNK_NAMES) | ends


def relative(path: Column, root: Column) -> Column:
    """The path below its root, or the path itself where it isn't below it."""
    base = F.rtrim(root, F.lit("/"))
    return F.when(path.startswith(F.concat(base, F.lit("/"))), F.substring(path, F.length(base) + 2, F.length(path))).otherwise(path)


def under(path: Column, root: Column, prefix: str) -> Column:
    """Whether the stored or the relative path lies below ``prefix``, which is taken literally and in any letter case."""
    wanted = prefix.strip("/").lower() + "/"
    return F.lower(path).startswith("/" + wanted) | F.lower(path).startswith(wanted) | F.lower(relative(path, root)).startswith(wanted)


def in_root(path: Column, root: str) -> Column:
    """Whether the path is the root or lies below it; letter case counts."""
    base = root.rstrip("/")
    return (path == (base or "/")) | path.startswith(base + "/")


def in_scope(path: Column, device: Column, scope: dict) -> Column:
    """Whether a file belongs to a scope: below its root and, if the scope stays on one device, on one of its devices."""
    inside = in_root(path, scope["root"])
    return inside & F.coalesce(device.isin(scope["devices"]), F.lit(False)) if scope.get("one_filesystem") else inside


def in_any_scope(path: Column, device: Column, scopes: Iterable[dict]) -> Column:
    out = F.lit(False)
    for s in scopes:
        out = out | in_scope(path, device, s)
    return out


def scope_names(path: Column, device: Column, scopes: Iterable[dict]) -> Column:
    """The names of all scopes that a file belongs to, in the order of the scopes."""
    return F.array_compact(F.array(*(F.when(in_scope(path, device, s), s["name"]) for s in scopes)))


def scope_priority(path: Column, device: Column, scopes: Iterable[dict], default: int = 100) -> Column:
    """The least priority of the scopes that a file belongs to."""
    values = [F.when(in_scope(path, device, s), s.get("priority", default)) for s in scopes]
    return F.coalesce(F.least(*values, F.lit(None).cast("int")), F.lit(default)) if values else F.lit(default)
