"""Paths of files and names of modules. Null in, null out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Modules that come with the runtime: fixed values.
CORE_MODULES = (
    "assert buffer child_process cluster crypto dgram dns domain events fs fs/promises http https net os path punycode querystring readline stream string_decoder timers tls tty url util v8 vm zlib"
).split()
_ROOT = r"^((?:.*/)?node_modules/(?:@[^/]+/[^/]+|[^/@][^/]*))(?:/|$)"


def normal_path(path: Column) -> Column:
    """Forward slashes; one leading ./ and then one leading package/ taken off."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(path, r"\\", "/"), r"^\./", ""), r"^package/", "")


def module_root(path: Column) -> Column:
    """The innermost node_modules/<name>/ or node_modules/@scope/name/ with all before it; null outside any."""
    found = F.regexp_extract(normal_path(path), _ROOT, 1)
    return F.when(found != "", F.concat(found, F.lit("/")))


def package_root(path: Column) -> Column:
    """"" for a file of the package itself, null for one below node_modules."""
    return F.when(~F.contains(F.concat(F.lit("/"), normal_path(path)), F.lit("/node_modules/")), F.lit(""))


def root_depth(root: Column) -> Column:
    """How many node_modules/ are nested in a root."""
    return F.regexp_count(root, F.lit("node_modules/")).cast("long")


def root_package(root: Column) -> Column:
    """The package's name at the end of a root; null for other strings."""
    found = F.regexp_extract(root, r"(?:^|/)node_modules/(@[^/]+/[^/]+|[^/@][^/]*)/?$", 1)
    return F.when(found != "", found)


def path_is_under(path: Column, root: Column) -> Column:
    """Whether a root is a prefix of a path or occurs in it behind a slash; the root "" means: not below node_modules."""
    p = normal_path(path)
    return F.when(root == "", package_root(path).isNotNull()).otherwise(F.startswith(p, root) | F.contains(p, F.concat(F.lit("/"), root)))


def root_ancestors(path: Column) -> Column:
    """All roots, of one package or more nested ones, that a path is under, so that a prefix join is an equi join."""
    p = normal_path(path)
    names = F.regexp_extract_all(F.concat(F.lit("/"), p), F.lit(r"(?<=/)node_modules/(?:@[^/]+/[^/]+|[^/@][^/]*)/"), F.lit(0))
    runs = F.flatten(F.transform(F.sequence(F.lit(1), F.size(names)), lambda i: F.transform(F.sequence(i, F.size(names)), lambda j: F.array_join(F.slice(names, i, j - i + 1), ""))))
    return F.when(p.isNull(), F.lit(None)).when(F.size(names) == 0, F.array(F.lit(""))).otherwise(F.array_distinct(F.filter(runs, lambda r: path_is_under(path, r))))


def base_package(name: Column) -> Column:
    """@scope/name of a scoped name, else what stands before the first slash."""
    found = F.regexp_extract(name, r"^(@[^/]+/[^/]+|[^/]+)", 1)
    return F.when(found != "", found)


def is_core_module(name: Column) -> Column:
    """Whether a name, with or without the node: prefix, is the runtime's."""
    return F.regexp_replace(name, r"^node:", "").isin(CORE_MODULES)


def is_third_party(name: Column) -> Column:
    """A name that is neither the runtime's nor a path."""
    return ~is_core_module(name) & ~name.rlike(r"^(\.|/|[A-Za-z]:)") & (name != "")


def main_candidates(main: Column) -> Column:
    """Files that a manifest's main may mean: itself if it is a script, none for other extensions, else with .js and /index.js."""
    p = F.regexp_replace(main, r"^\./", "")
    return F.when(p.isNull(), F.lit(None)).when(p.rlike(r"\.(js|cjs|mjs)$"), F.array(p)).when(p.rlike(r"\.[A-Za-z0-9]+$"), F.array().cast("array<string>")).otherwise(F.array(F.concat(p, F.lit(".js")), F.concat(F.regexp_replace(p, "/$", ""), F.lit("/index.js"))))


def safe_entry_name(entry: Column) -> Column:
    """Characters that file names can't hold become dashes."""
    return F.regexp_replace(entry, r'[\\/:*?"<>|]', "-")


#: Extensions by which a path is taken for a binary or a script, and those that files to be read may have: fixed values.
BINARY_EXTENSIONS = "exe dll so dylib bin node o a lib wasm".split()
SCRIPT_EXTENSIONS = "js cjs mjs json sh bash zsh fish bat cmd ps1 py pl rb ts tsx jsx yaml yml toml ini cfg txt md".split()
READABLE_EXTENSIONS = "js cjs mjs json sh bat ps1 py pl rb".split()
INDEX_FILES = ("index.js", "index.cjs", "index.mjs")


def extension(path: Column) -> Column:
    """The part behind the last dot of a path's last name, in lower case; "" without one. A leading dot is none."""
    return F.lower(F.regexp_extract(path, r"[^/.][^/]*?\.([^./]*)$", 1))


def kind_of_path(path: Column) -> Column:
    """binary, script or unknown, by the extension; null and blank are unknown."""
    e = extension(F.trim(path))
    return F.when(e.isin(BINARY_EXTENSIONS), "binary").when(e.isin(SCRIPT_EXTENSIONS), "script").otherwise("unknown")


def is_bare_specifier(path: Column) -> Column:
    """The name of a module rather than of a file: scoped, or one part without a readable extension. Null and "" are."""
    bare = ~path.rlike(r"^(\./|\.\./|/)") & (F.startswith(path, F.lit("@")) | (~F.contains(path, F.lit("/")) & ~path.rlike(rf"\.({'|'.join(READABLE_EXTENSIONS)})$")))
    return F.when(F.coalesce(path, F.lit("")) == "", True).otherwise(bare)


def is_bare_command(path: Column) -> Column:
    """One part without a readable extension: a command rather than a file. Null and "" are."""
    bare = ~path.rlike(r"^(\./|\.\./)") & ~F.contains(path, F.lit("/")) & ~path.rlike(rf"\.({'|'.join(READABLE_EXTENSIONS)})$")
    return F.when(F.coalesce(path, F.lit("")) == "", True).otherwise(bare)


def resolved_path(path: Column) -> Column:
    """A path relative to the package's folder without . and .. parts; null where it leads out of it, or to nothing."""
    empty = F.array().cast("array<string>")

    def step(done: Column, part: Column) -> Column:
        up = F.when(F.size(done) == 0, F.array(F.lit(".."))).otherwise(F.when(F.element_at(done, -1) == "..", F.concat(done, F.array(F.lit("..")))).otherwise(F.slice(done, 1, F.size(done) - 1)))
        return F.when(part.isin("", "."), done).when(part == "..", up).otherwise(F.concat(done, F.array(part)))

    done = F.aggregate(F.split(path, "/"), empty, step)
    return F.when((F.size(done) > 0) & (F.get(done, F.lit(0)) != "..") & ~F.startswith(path, F.lit("/")), F.array_join(done, "/"))


def file_candidates(path: Column) -> Column:
    """Files of the package that a requested path may mean, in order: itself, then without an extension with each readable one,
    and the index files below it."""
    p = resolved_path(path)
    below = [F.concat(p, F.lit(f"/{i}")) for i in INDEX_FILES]
    return F.when(p.isNull(), F.array().cast("array<string>")).when(extension(p) == "", F.array(p, *[F.concat(p, F.lit(f".{e}")) for e in READABLE_EXTENSIONS], *below)).otherwise(F.array(p, *below))


def cleaned_paths(paths: Column) -> Column:
    """Requested paths without blanks at the ends, without one leading package/ (after ./ too), without empty ones, each once."""
    trimmed = F.transform(F.filter(paths, lambda p: p.isNotNull()), lambda p: F.trim(p))
    own = F.transform(trimmed, lambda p: F.coalesce(F.nullif(F.regexp_extract(p, r"^(?:\./)?package/+(.+)$", 1), F.lit("")), p))
    return F.coalesce(F.array_distinct(F.filter(own, lambda p: p != "")), F.array().cast("array<string>"))


#: Methods that values of the language itself have: fixed values.
INSTANCE_METHODS = (
    "at concat copyWithin entries every fill filter find findIndex findLast findLastIndex flat flatMap forEach includes indexOf join keys lastIndexOf map pop reduce reduceRight reverse shift "
    "slice some sort toLocaleString toReversed toSorted toSpliced toString values with resize transfer valueOf getBigInt64 getBigUint64 getFloat16 getFloat32 getFloat64 getInt16 getInt32 getInt8 "
    "getUint16 getUint32 getUint8 setBigInt64 setBigUint64 setFloat16 setFloat32 setFloat64 setInt16 setInt32 setInt8 setUint16 setUint32 setUint8 anchor big blink bold charAt charCodeAt "
    "codePointAt endsWith fixed fontcolor fontsize isWellFormed italics localeCompare match matchAll normalize padEnd padStart repeat replace replaceAll search small split startsWith strike sub "
    "substr substring sup toLocaleLowerCase toLocaleUpperCase toLowerCase toUpperCase toWellFormed trim trimEnd trimStart toJSON hasOwnProperty isPrototypeOf next return throw then push splice "
    "unshift clear delete get getOrInsert getOrInsertComputed has set add difference intersection isDisjointFrom isSubsetOf isSupersetOf symmetricDifference union catch finally compile exec test"
).split()


def is_instance_method(name: Column) -> Column:
    return name.isin(INSTANCE_METHODS)
