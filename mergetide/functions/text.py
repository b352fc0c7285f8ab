"""Column functions over file paths and file contents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: white space that a trim strips at both ends, line ends included.
BLANK = "\t\n\x0b\x0c\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"


def normalised(content: Column) -> Column:
    """Line ends as ``\\n``, white space trimmed at both ends, null as empty: what contents are compared by."""
    text = F.replace(F.coalesce(content, F.lit("")), F.lit("\r\n"), F.lit("\n"))
    return F.btrim(text, F.lit(BLANK))


def content_hash(content: Column) -> Column:
    """Null for empty contents, so that a missing file and an empty one are alike."""
    text = normalised(content)
    return F.when(text != "", F.sha2(text.cast("binary"), 256))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """From the last dot of the file name; empty without one, or where the name begins with its only dot."""
    return F.regexp_extract(basename(path), r"^.+?(\.[^.]*)$", 1)


def slashes(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def relative_to(path: Column, root: Column) -> Column:
    """``path`` below ``root``, with forward slashes."""
    path, root = slashes(path), F.rtrim(slashes(root), F.lit("/"))
    return F.when(F.startswith(path, F.concat(root, F.lit("/"))), F.substring(path, F.length(root) + 2, F.length(path))).otherwise(path)


def tidy_path(path: Column) -> Column:
    """``.`` and ``..`` segments resolved; leading ``..`` of relative paths stay."""
    parts = F.filter(F.split(slashes(path), "/"), lambda x: (x != "") & (x != "."))

    def step(stack: Column, part: Column) -> Column:
        up = (part == "..") & (F.size(stack) > 0) & (F.element_at(stack, -1) != "..")
        return F.when(up, F.slice(stack, F.lit(1), F.greatest(F.size(stack) - 1, F.lit(0)))).otherwise(F.concat(stack, F.array(part)))

    # a null guard for element_at on the empty stack
    safe = F.aggregate(parts, F.array().cast("array<string>"), lambda s, p: F.when(F.size(s) == 0, F.array(p)).otherwise(step(s, p)))
    return F.concat(F.when(F.startswith(path, F.lit("/")), F.lit("/")).otherwise(F.lit("")), F.array_join(safe, "/"))


def folder(path: Column) -> Column:
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def beside(path: Column, name: Column) -> Column:
    """``name`` as seen from the folder of file ``path``."""
    at = folder(path)
    return tidy_path(F.concat(F.when(at != "", F.concat(at, F.lit("/"))).otherwise(F.lit("")), name))


def import_between(source: Column, target: Column) -> Column:
    """The relative import of file ``target`` in file ``source``: no .ts or .tsx, a leading dot, forward slashes."""
    a = F.filter(F.split(folder(slashes(source)), "/"), lambda x: x != "")
    b = F.filter(F.split(slashes(F.regexp_replace(target, r"\.tsx?$", "")), "/"), lambda x: x != "")
    n = F.least(F.size(a), F.size(b) - 1)
    same = F.aggregate(F.sequence(F.lit(0), n), F.lit(0), lambda k, i: F.when((i == k) & (i < n) & (F.get(a, i) == F.get(b, i)), k + 1).otherwise(k))
    ups = F.array_repeat(F.lit(".."), (F.size(a) - same).cast("int"))
    path = F.array_join(F.concat(ups, F.slice(b, same + 1, F.size(b))), "/")
    return F.when(F.startswith(path, F.lit(".")), path).otherwise(F.concat(F.lit("./"), path))


def file_type(path: Column) -> Column:
    """Kind of a file by its name, where no decorator says more."""
    stem = F.regexp_replace(basename(path), r"\.[^.]*$", "")
    kinds = [
        (r"\.component$", "component"), (r"\.service$", "service"), (r"\.module$", "module"), (r"\.directive$", "directive"), (r"\.pipe$", "pipe"),
        (r"\.guard$", "guard"), (r"\.interceptor$", "interceptor"), (r"\.(model|interface|dto)$", "model"), (r"\.(util|helper|utils)$", "util"),
    ]
    out = F.when(F.endswith(path, F.lit(".scss")), F.lit("util"))
    for pattern, kind in kinds:
        out = out.when(stem.rlike(pattern), F.lit(kind))
    return out.otherwise(F.lit("unknown"))


#: Parts of a lower-case path that name the kind of a state-store file, in order.
STATE_PARTS = [(".actions.", "action"), (".reducer.", "reducer"), (".effects.", "effect"), (".selectors.", "selector"), (".selector.", "selector"), (".state.", "state")]


def state_kind(path: Column) -> Column:
    """Kind of a state-store file by its path; null for others."""
    out = F.when(F.lit(False), F.lit(""))
    for part, kind in STATE_PARTS:
        out = out.when(F.lower(path).contains(part), F.lit(kind))
    return F.when(F.endswith(path, F.lit(".ts")), out)


def escaped_json(text: Column) -> Column:
    """JSON text that can stand inside HTML."""
    for sign, code in (("&", "\\u0026"), ("<", "\\u003c"), (">", "\\u003e")):
        text = F.replace(text, F.lit(sign), F.lit(code))
    return text
