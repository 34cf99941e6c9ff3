"""Languages by file name, extension, first line and a look at the head."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# File names, extensions and interpreters of each language.
NAMES = {
    "ruby": "Rakefile Gemfile Podfile Fastfile Appfile Matchfile Vagrantfile Brewfile Dangerfile Guardfile Berksfile",
    "bash": ".bashrc .bash_profile .zshrc .zprofile .zshenv .profile PKGBUILD",
    "toml": "Cargo.lock Pipfile poetry.lock uv.lock",
    "json": ".babelrc .eslintrc .prettierrc .swcrc",
}
EXTENSIONS = {
    "rust": "rs",
    "python": "py pyi pyw",
    "javascript": "js mjs cjs jsx",
    "typescript": "ts mts cts",
    "tsx": "tsx",
    "go": "go",
    "java": "java",
    "c": "c",
    "cpp": "h cc cpp cxx c++ hpp hh hxx h++ ipp tpp inl cu cuh metal",
    "objc": "m mm",
    "csharp": "cs",
    "ruby": "rb rake gemspec ru podspec",
    "php": "php phtml",
    "bash": "sh bash zsh ksh command",
    "swift": "swift",
    "kotlin": "kt kts",
    "scala": "scala sc sbt",
    "lua": "lua",
    "luau": "luau",
    "markdown": "md markdown mdx mdc",
    "json": "json jsonc json5 geojson webmanifest code-workspace",
    "yaml": "yml yaml",
    "toml": "toml",
}
INTERPRETERS = {
    "bash": "bash sh zsh ksh dash",
    "python": "python",
    "javascript": "node deno bun",
    "ruby": "ruby",
    "php": "php",
    "lua": "lua luajit",
    "luau": "luau lune",
    "swift": "swift",
}
DATA = ("markdown", "json", "yaml", "toml")
# Extensions that are never searched.
SKIPPED = (
    "png jpg jpeg gif webp ico icns heic tiff bmp pdf zip gz tgz xz bz2 zst 7z rar dmg pkg a o so dylib rlib wasm class jar mp3 mp4 mov wav aiff "
    "ttf otf woff woff2 sqlite db car nib mlmodel pyc exe dll bin psd sketch"
).split()

BY_NAME = {n: lang for lang, names in NAMES.items() for n in names.split()}
BY_EXTENSION = {e: lang for lang, exts in EXTENSIONS.items() for e in exts.split()}
BY_INTERPRETER = {i: lang for lang, names in INTERPRETERS.items() for i in names.split()}
#: What shows that a header is Objective-C, or that a Lua file is Luau.
OBJC_HEAD = r"(?m)^\s*(?:@(?:interface|protocol|class|implementation|import|property)\b|#import\b)"
LUAU_HEAD = r"(?m)^--!(?:strict|nonstrict|nocheck|native|optimize)\b|^\s*(?:export\s+)?type\s+\w+\s*(?:<[^>\n]*>)?\s*=|^\s*local\s+\w+\s*:\s*[\w{(]|(?::|->)\s*\w+\??\s*(?:[,)=]|$)|\bcontinue\s*$|[+\-*/%^]=\s"


def _map(table: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in sorted(table.items()) for x in kv]), key)


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """The lower-case extension; null for names without one and for dot files."""
    name = file_name(path)
    return F.when(F.instr(F.substring(name, 2, 1 << 20), ".") > 0, F.lower(F.substring_index(name, ".", -1)))


def interpreter(head: Column) -> Column:
    """The interpreter that a first line names, without its path and version."""
    line = F.when(F.startswith(head, F.lit("#!")), F.regexp_extract(F.left(head, F.lit(256)), r"^#!([^\n]*)", 1))
    words = F.filter(F.split(F.trim(line), r"\s+"), lambda w: ~F.rlike(w, F.lit(r"(?:^|/)env$|^-")))
    return F.regexp_replace(F.substring_index(F.get(words, F.lit(0)), "/", -1), r"[0-9.]+$", "")


def detect(path: Column, head: Column) -> Column:
    """The language of a text by its path and its first characters, or null."""
    ext = extension(path)
    by_ext = F.when((ext == "h") & F.rlike(head, F.lit(OBJC_HEAD)), "objc").when((ext == "lua") & F.rlike(head, F.lit(LUAU_HEAD)), "luau").otherwise(_map(BY_EXTENSION, ext))
    return F.coalesce(_map(BY_NAME, file_name(path)), F.when(ext.isNotNull(), by_ext).otherwise(_map(BY_INTERPRETER, interpreter(head))))


def detect_python(path: str, head: str) -> str | None:
    """``detect`` on the driver."""
    name = path.rsplit("/", 1)[-1]
    if name in BY_NAME:
        return BY_NAME[name]
    stem, dot, ext = name.rpartition(".")
    if stem and dot:
        ext = ext.lower()
        if ext == "h" and re.search(OBJC_HEAD, head):
            return "objc"
        if ext == "lua" and re.search(LUAU_HEAD, head):
            return "luau"
        return BY_EXTENSION.get(ext)
    if head.startswith("#!"):
        words = [w for w in head[2:].split("\n", 1)[0].split() if not re.search(r"(?:^|/)env$|^-", w)]
        return BY_INTERPRETER.get(re.sub(r"[0-9.]+$", "", words[0].rsplit("/", 1)[-1])) if words else None
    return None


def searchable(path: Column) -> Column:
    """Whether a file is searched at all, by its extension."""
    return ~F.coalesce(extension(path).isin(SKIPPED), F.lit(False))
