"""Schema files: one is read with every file that it names, transitively, and becomes one schema with inner references.

All of it runs on the driver: a file has at most 1 MiB, and only files that a schema names are read.
"""

from __future__ import annotations

import posixpath
from collections.abc import Callable

import yaml

from ..schema import spine


def load(name: str, read: Callable[[str], bytes | None]) -> tuple[object, list[str]]:
    """A schema file's schema, and what keeps it from being used (nothing, or the schema is not to be used).

    read gives the bytes of a file of the schema folder, or None. A `$ref` to another file is taken from the folder of the
    file that has it, never from outside the schema folder, and is rewritten to a member of the root's `$defs`.
    """
    files: dict[str, object] = {}
    problems: list[str] = []

    def open_file(file: str) -> None:
        content = read(file)
        if content is None:
            problems.append(f"{file} isn't there")
            return
        if len(content) > spine.MAX_BYTES:
            problems.append(f"{file} is larger than 1 MiB")
            return
        try:
            files[file] = yaml.safe_load(content.decode())
        except (yaml.YAMLError, UnicodeDecodeError) as e:
            problems.append(f"{file} can't be read: {str(e).splitlines()[0]}")

    def rewritten(part: object, file: str) -> object:
        """A part of a file's schema with every `$ref` led into the bundle."""
        if isinstance(part, list):
            return [rewritten(x, file) for x in part]
        if not isinstance(part, dict):
            return part
        out = {k: v if k in ("enum", "const", "default", "examples") else rewritten(v, file) for k, v in part.items()}
        ref = part.get("$ref")
        if isinstance(ref, str):
            other, _, inner = ref.partition("#")
            target = posixpath.normpath(posixpath.join(posixpath.dirname(file), other)) if other else file
            if "://" in other or target.startswith(("/", "..")):
                problems.append(f"{file}: {ref} is outside the schema folder")
            else:
                if target != name and target not in wanted:
                    wanted.append(target)
                out["$ref"] = "#" + ("" if target == name else f"/$defs/{_member(target)}") + inner
        return out

    wanted: list[str] = []
    open_file(name)
    if name not in files:
        return None, problems
    root = rewritten(files[name], name)
    if not isinstance(root, dict):
        return root, problems + spine.problems(root)
    bundle = {}
    for target in wanted:  # grows while files name more files
        open_file(target)
        if target in files:
            bundle[_key(target)] = rewritten(files[target], target)
    if bundle:
        root = {**root, "$defs": {**(root.get("$defs") or {}), **bundle}}
    return root, problems or spine.problems(root)


def _key(file: str) -> str:
    """The member of `$defs` that holds a file; no definition that a schema writes has a line break in its name."""
    return f"file\n{file}"


def _member(file: str) -> str:
    return _key(file).replace("~", "~0").replace("/", "~1")
