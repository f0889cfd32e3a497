"""Column functions over paths and URIs; none of them touches a file system."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# File extensions with their language and flavor.
LANGUAGES = {
    "css": ("css", None), "go": ("go", None), "js": ("javascript", None), "cjs": ("javascript", None), "mjs": ("javascript", None), "jsx": ("javascript", None),
    "odin": ("odin", None), "py": ("python", None), "pyi": ("python", "stub"), "rs": ("rust", None), "ts": ("typescript", None), "cts": ("typescript", None),
    "mts": ("typescript", None), "tsx": ("typescript", "tsx"), "zig": ("zig", None),
}


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def dir_of(path: Column) -> Column:
    """Everything before the last ``/``; empty for a bare name, ``/`` for a name under the root."""
    cut = F.regexp_extract(path, r"^(.*)/[^/]*$", 1)
    return F.when((cut == "") & F.startswith(path, F.lit("/")), "/").otherwise(cut)


def extension(path: Column) -> Column:
    """After the last dot of the file name; null where it has none."""
    found = F.regexp_extract(file_name(path), r"\.([^.]*)$", 1)
    return F.when(found == "", None).otherwise(found)


def language(path: Column) -> Column:
    table = F.create_map(*[F.lit(x) for ext, (lang, _) in LANGUAGES.items() for x in (ext, lang)])
    return F.try_element_at(table, extension(path))


def flavor(path: Column) -> Column:
    table = F.create_map(*[F.lit(x) for ext, (_, kind) in LANGUAGES.items() if kind for x in (ext, kind)])
    return F.try_element_at(table, extension(path))


def normalise(path: Column) -> Column:
    """Without empty and ``.`` segments, ``..`` resolved by name; a leading ``..`` stays in a relative path."""
    rooted = F.startswith(path, F.lit("/"))

    def step(out: Column, part: Column) -> Column:
        last = F.when(F.size(out) > 0, F.try_element_at(out, F.lit(-1)))
        up = F.when((F.size(out) == 0) | (last == ".."), F.when(rooted, out).otherwise(F.array_append(out, part)))
        up = up.otherwise(F.slice(out, F.lit(1), F.greatest(F.size(out) - 1, F.lit(0))))
        return F.when((part == "") | (part == "."), out).when(part == "..", up).otherwise(F.array_append(out, part))

    joined = F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")
    return F.when(rooted, F.concat(F.lit("/"), joined)).otherwise(F.when(joined == "", ".").otherwise(joined))


def join_path(base: Column, path: Column) -> Column:
    """path seen from base; a rooted path stands for itself."""
    return normalise(F.when(F.startswith(path, F.lit("/")), path).otherwise(F.concat(base, F.lit("/"), path)))


def contains_path(base: Column, path: Column) -> Column:
    """Whether path is base or below it."""
    whole = F.when(F.endswith(base, F.lit("/")), base).otherwise(F.concat(base, F.lit("/")))
    return (base == "") | (path == base) | F.startswith(path, whole)


def relative_to(base: Column, path: Column) -> Column:
    """The part of path below base; path itself where it is not below."""
    whole = F.when((base == "") | F.endswith(base, F.lit("/")), base).otherwise(F.concat(base, F.lit("/")))
    return F.when(F.startswith(path, whole), F.substring(path, F.length(whole) + 1, F.lit(1 << 30))).otherwise(path)


def ancestors(path: Column, most: int = 64) -> Column:
    """The directories above path, the nearest first, ending with the empty path."""
    parts = F.split(path, "/")
    n = F.size(parts) - 1
    return F.transform(F.sequence(F.lit(0), F.least(n, F.lit(most - 1))), lambda k: F.array_join(F.slice(parts, F.lit(1), n - k), "/"))


def order_key(path: Column) -> Column:
    """A text whose byte order puts ``/`` before every other character."""
    return F.replace(path, F.lit("/"), F.lit("\x00"))


def file_uri(path: Column) -> Column:
    """``file://`` and the path with percent coding; unreserved characters and ``/`` stay."""
    coded = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.url_encode(path), r"\+", "%20"), "%2F", "/"), "%7E", "~")
    return F.concat(F.lit("file://"), F.regexp_replace(coded, r"\*", "%2A"))


def path_of_uri(uri: Column) -> Column:
    """The path of a ``file://`` URI; null for other schemes."""
    body = F.regexp_replace(F.substring(uri, 8, 1 << 30), r"\+", "%2B")
    return F.when(F.startswith(uri, F.lit("file://")), F.try_url_decode(body))
