"""Retention: which paths are kept, and by which rule a path is not."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P

#: The built-in profiles.
PROFILES = {
    "none": 'name = "none"',
    "no-build-products": """
name = "no-build-products"
exclude_dirs = [".git", ".cache", "node_modules", "__pycache__", ".venv", "venv", "target", "build", ".mypy_cache", ".pytest_cache"]
exclude_ext = ["pyc", "pyo", "so", "o", "a", "dylib", "wasm", "whl", "class"]
elf_min_bytes = 65536
""",
}
ELF = b"\x7fELF"


def _begins(prefixes: tuple[str, ...]):
    return lambda d: reduce(or_, [d.startswith(p) for p in prefixes])


@dataclass(frozen=True)
class Profile:
    name: str
    version: int = 1
    exclude_dirs: tuple[str, ...] = ()
    exclude_ext: tuple[str, ...] = ()
    max_bytes: int = 0
    elf_min_bytes: int = 0
    exclude_under: tuple[tuple[tuple[str, ...], tuple[str, ...], int], ...] = ()
    always_keep: tuple[str, ...] = ()
    always_exclude: tuple[str, ...] = ()

    @staticmethod
    def from_toml(text: str) -> Profile:
        t = tomllib.loads(text)
        under = tuple((tuple(u["dirs"]), tuple(u.get("ext", ())), u.get("max_bytes", 0)) for u in t.get("exclude_under", ()))
        lists = {k: tuple(t.get(k, ())) for k in ("exclude_dirs", "exclude_ext", "always_keep", "always_exclude")}
        return Profile(t["name"], t.get("version", 1), max_bytes=t.get("max_bytes", 0), elf_min_bytes=t.get("elf_min_bytes", 0), exclude_under=under, **lists)

    @staticmethod
    def resolve(name: str, base: str = ".") -> Profile:
        if name in PROFILES:
            return Profile.from_toml(PROFILES[name])
        with open(name if name.startswith("/") else f"{base}/{name}", encoding="utf-8") as f:
            return Profile.from_toml(f.read())

    def rule(self, path: Column, kind: Column, size: Column, head: Column | None = None) -> Column:
        """The name of the rule that excludes a path; null if it is kept. ``head``: its first bytes, for the test of executables."""
        parts = F.split(path, "/")
        dirs, name = F.slice(parts, 1, F.size(parts) - 1), F.element_at(parts, -1)
        ext = P.extension(name)
        strings = lambda xs: F.array(*[F.lit(x) for x in xs]).cast("array<string>")
        chain = F.when(P.matches(path, list(self.always_exclude)), "always_exclude").when(P.matches(path, list(self.always_keep)), F.lit(None))
        chain = chain.when(F.arrays_overlap(dirs, strings(self.exclude_dirs)) if self.exclude_dirs else F.lit(False), "exclude_dirs")
        chain = chain.when(kind == 1, F.lit(None))
        chain = chain.when(ext.isin(list(self.exclude_ext)) if self.exclude_ext else F.lit(False), "exclude_ext")
        if self.max_bytes:
            chain = chain.when(size > self.max_bytes, "max_bytes")
        for prefixes, exts, most in self.exclude_under:
            inside = F.exists(dirs, _begins(prefixes)) if prefixes else F.lit(False)
            if exts:
                chain = chain.when(inside & ext.isin(list(exts)), "exclude_under.ext")
            if most:
                chain = chain.when(inside & (size > most), "exclude_under.max_bytes")
        if self.elf_min_bytes and head is not None:
            chain = chain.when((ext == "") & (kind != 1) & (size >= self.elf_min_bytes) & (F.substring(head, 1, 4) == F.lit(ELF)), "elf")
        return chain.otherwise(F.lit(None))

    def pruned(self, directory: Column) -> Column:
        """The rule by which a whole directory goes; null if it must be walked."""
        subtrees = [g[:-3] for g in self.always_exclude if g.endswith("/**")]
        chain = F.when(P.matches(directory, subtrees), "always_exclude")
        if not self.always_keep and self.exclude_dirs:
            chain = chain.when(F.arrays_overlap(F.split(directory, "/"), F.array(*[F.lit(x) for x in self.exclude_dirs])), "exclude_dirs")
        return chain.otherwise(F.lit(None))


def decide(entries: DataFrame, profile: Profile, deleted: DataFrame | None = None) -> DataFrame:
    """``entries(path, kind, size[, head])`` with ``rule`` and ``excluded_path``.

    A file below a pruned directory is excluded by the topmost such directory, under that directory's path; one at or
    below a deleted path by the rule ``deleted``. ``kept``: rows without a rule; ``excluded``: one row each.
    """
    head = F.col("head") if "head" in entries.columns else None
    own = profile.rule(F.col("path"), F.col("kind"), F.col("size"), head)
    above = F.filter(P.ancestors(F.col("path")), lambda d: (d != "") & profile.pruned(d).isNotNull())
    top = F.when(F.size(above) > 0, F.element_at(above, 1))
    out = entries.withColumn("_top", top).withColumn("rule", F.coalesce(profile.pruned(F.col("_top")), own)).withColumn("excluded_path", F.when(F.col("rule").isNotNull(), F.coalesce("_top", "path"))).drop("_top")
    if deleted is not None:
        gone = deleted.select(F.col("path").alias("_gone")).distinct()
        hit = entries.select("path", F.explode(F.concat(P.ancestors(F.col("path")), F.array("path"))).alias("_gone")).join(gone, "_gone", "left_semi").select("path").distinct().withColumn("_deleted", F.lit(True))
        out = out.join(hit, "path", "left").withColumn("rule", F.when(F.col("_deleted"), "deleted").otherwise(F.col("rule"))).withColumn("excluded_path", F.when(F.col("_deleted"), F.col("path")).otherwise(F.col("excluded_path"))).drop("_deleted")
    return out


def excluded(decided: DataFrame) -> DataFrame:
    """One row for each excluded file or pruned directory; a directory has size 0."""
    return decided.where("rule is not null").groupBy(F.col("excluded_path").alias("path"), "rule").agg(F.max(F.when(F.col("excluded_path") == F.col("path"), F.col("size")).otherwise(0)).alias("size")).select("path", "size", "rule")
