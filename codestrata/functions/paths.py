"""Column functions over slash-separated paths."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import constants as C


def _lookup(table: dict[str, str], key: Column) -> Column:
    pairs = [F.lit(x) for item in table.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), key)


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dir_name(path: Column) -> Column:
    """POSIX dirname; '.' for a bare file name."""
    cut = F.length(path) - F.length(base_name(path)) - 1
    return F.when(cut < 0, F.lit(".")).otherwise(F.substring(path, F.lit(1), cut))


def directories(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.slice(parts, F.lit(1), F.size(parts) - 1)


def extension(path: Column) -> Column:
    """Lower-case extension with its dot; '' for none and for dot-files."""
    return F.lower(F.regexp_extract(base_name(path), r"^.+(\.[^.]*)$", 1))


def is_ignored_folder(path: Column) -> Column:
    """True for files below build output and hidden directories."""
    return F.exists(directories(path), lambda d: d.isin(*C.IGNORED_DIRS) | d.startswith("."))


def is_ignored(path: Column) -> Column:
    """True for build output, hidden directories, lockfiles, minified files, source maps and declaration files."""
    name = base_name(path)
    return is_ignored_folder(path) | name.isin(*C.IGNORED_FILES) | name.rlike(C.IGNORED_NAME_PATTERN)


def language_of(path: Column) -> Column:
    """Language by whole file name, then by extension; null where neither is known."""
    return F.coalesce(_lookup(C.LANGUAGE_BY_NAME, base_name(path)), _lookup(C.LANGUAGE_BY_EXT, extension(path)))


def is_source_language(language: Column) -> Column:
    return ~language.isin(*C.NON_SOURCE_LANGUAGES)


def module_of(path: Column) -> Column:
    """Logical module: the first meaningful directory behind source, package and container directories."""
    dirs = directories(path)
    count = F.size(dirs)
    first_other = F.array_position(F.transform(dirs, lambda d: ~d.isin(*C.SOURCE_ROOTS)), F.lit(True)).cast("int")
    after_roots = F.when(first_other == 0, count).otherwise(first_other - 1)
    in_package = F.coalesce(F.get(dirs, after_roots).isin(*C.PACKAGE_ROOTS), F.lit(False))
    after_package = after_roots + F.when(in_package, F.least(F.lit(2), count - after_roots - 1)).otherwise(0)
    in_container = F.coalesce(F.get(dirs, after_package).isin(*C.CONTAINER_DIRS), F.lit(False))
    has_child = F.coalesce(F.get(dirs, after_package + 1) != "", F.lit(False))
    index = after_package + F.when(in_container & has_child, 1).otherwise(0)
    is_mono = (count >= 2) & F.get(dirs, F.lit(0)).isin(*C.MONO_ROOTS) & (F.get(dirs, F.lit(1)) != "")
    return F.when(is_mono, F.concat_ws("/", F.get(dirs, F.lit(0)), F.get(dirs, F.lit(1)))).otherwise(
        F.coalesce(F.get(dirs, index), F.get(dirs, count - 1), F.lit("root"))
    )


def is_test_file(path: Column) -> Column:
    return path.rlike(C.TEST_FILE_PATTERN)


def is_generated_file(path: Column) -> Column:
    return path.rlike(C.GENERATED_FILE_PATTERN)


def is_entry_point(path: Column) -> Column:
    return path.rlike(C.ENTRY_POINT_PATTERN)


def is_manifest(path: Column) -> Column:
    return path.rlike(C.MANIFEST_PATTERN)


def normalize(path: Column) -> Column:
    """Relative POSIX normalisation: drops '.' and empty parts, folds 'x/..'; a leading '..' stays."""
    empty = F.array().cast("array<string>")

    def step(acc: Column, part: Column) -> Column:
        can_pop = (F.size(acc) > 0) & (F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit("")) != "..")
        return (
            F.when((part == "") | (part == "."), acc)
            .when((part == "..") & can_pop, F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
            .otherwise(F.concat(acc, F.array(part)))
        )

    joined = F.array_join(F.aggregate(F.split(path, "/"), empty, step), "/")
    return F.when(joined == "", F.lit(".")).otherwise(joined)


def dotted_to_path(spec: Column, directory: Column) -> Column:
    """Dotted module name to a slash path; leading dots climb from `directory`, one level per dot after the first."""
    level = F.length(F.regexp_extract(spec, r"^(\.*)", 1))
    rest = F.replace(F.substring(spec, level + 1, F.length(spec)), F.lit("."), F.lit("/"))
    climb = F.repeat(F.lit("../"), F.greatest(level - 1, F.lit(0)))
    relative = F.regexp_replace(normalize(F.concat_ws("/", directory, climb, rest)), r"^(\.\./)+", "")
    return F.when(level > 0, relative).otherwise(F.replace(spec, F.lit("."), F.lit("/")))


def suffixes(path: Column) -> Column:
    """Every trailing run of segments, shortest first; the last is the whole path."""
    count = F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit(""))) + 1
    return F.transform(F.sequence(F.lit(1), count), lambda k: F.call_function("substring_index", path, F.lit("/"), -k))


def route_of_file(path: Column, name: Column) -> Column:
    """Route of a file-path router: app/**/route.* with a verb name, or pages/api/** with a default export."""
    app = F.regexp_extract(path, C.APP_ROUTE_FILE, 1)
    is_app = path.rlike(C.APP_ROUTE_FILE) & F.lower(name).isin(*C.HTTP_VERBS)
    kept = F.filter(F.split(app, "/"), lambda s: (s != "") & ~s.rlike(r"^\(.*\)$"))
    pages = F.regexp_extract(path, C.PAGES_ROUTE_FILE, 1)
    return F.when(is_app, F.concat(F.upper(name), F.lit(" /"), F.array_join(kept, "/"))).when(
        (pages != "") & (name == "default"), F.concat(F.lit("ANY /"), pages)
    )


def join_route(prefix: Column, path: Column) -> Column:
    """'/prefix/path' with doubled slashes collapsed and no trailing slash."""
    joined = F.regexp_replace(F.concat(F.lit("/"), prefix, F.lit("/"), path), "/+", "/")
    return F.when(F.length(joined) > 1, F.regexp_replace(joined, "/$", "")).otherwise(joined)
